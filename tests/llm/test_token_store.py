import json
import zlib

import numpy as np
import pytest

from tidemark.llm import token_store
from tidemark.llm.queries import tokenizer_path
from tidemark.llm.token_store import Encoder, PerfectHash, encoder, fingerprint, lookup, stored, write

TEXTS = ["Hello world, it's 3.5  times\n\n as good ", " leading", "trailing ", "a\n b\t c", "a \n b", None, "", "  ", "é x y z", "don't  <|endoftext|> we'll", "　", "x" * 3000, "tab\t\t end", "The the THE " * 300, "one Two.\nThree, fouré!? Ünder.\n end\nx don't it's a1 b-c \n\nq ñandú:;\n"]


def encoded(e, docs, end=None):
    raw = [(t or "").encode() for t in docs]
    ids, first = e.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), end)
    return [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]


def test_units_give_the_ids_of_whole_texts():
    e = encoder(tokenizer_path())
    assert e.by_unit
    want = [e.tokenizer.encode(t or "", add_special_tokens=False).ids for t in TEXTS]
    assert encoded(e, TEXTS) == want
    assert encoded(e, TEXTS, 7) == [[*w, 7] for w in want]
    assert encoded(e, []) == [] and encoded(e, [""], 3) == [[3]]


def test_many_units_grow_and_forget(monkeypatch):
    e = token_store.Encoder(tokenizer_path())
    monkeypatch.setattr(token_store, "MEMO", 60_000)
    for seed in range(3):
        words = [f"{i * 7919 % 1_000_003:x}" for i in range(seed * 30_000, seed * 30_000 + 40_000)]
        docs = [" ".join(words[i : i + 100]) + "\nend" for i in range(0, len(words), 100)]
        assert encoded(e, docs) == [x.ids for x in e.tokenizer.encode_batch(docs, add_special_tokens=False)]


def test_other_tokenizers_are_encoded_whole():
    plain = json.loads(encoder(tokenizer_path()).tokenizer.to_str())
    assert Encoder._plain(plain)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Sequence", "pretokenizers": []}}, {"pre_tokenizer": plain["pre_tokenizer"] | {"use_regex": False}}, {"pre_tokenizer": plain["pre_tokenizer"] | {"add_prefix_space": True}}, {"added_tokens": [plain["added_tokens"][0] | {"content": "a b"}]}):
        assert not Encoder._plain(plain | change)
    e = token_store.Encoder(tokenizer_path())
    e.by_unit = False
    assert encoded(e, TEXTS) == encoded(encoder(tokenizer_path()), TEXTS)


def test_very_long_text():
    e = encoder(tokenizer_path())
    t = "word, other\n" * 40_000 + "x" * 200_000 + " é" * 1000
    assert encoded(e, [t, "a"], 0) == [[*e.tokenizer.encode(t, add_special_tokens=False).ids, 0], [*e.tokenizer.encode("a").ids, 0]]


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(0).integers(-(2**62), 2**62, 5000))
    h = PerfectHash.load(*PerfectHash.build(keys).dump())
    assert sorted(h.slots(keys)) == list(range(len(keys)))
    assert len(set(fingerprint(keys).tolist())) > 4990 and len(PerfectHash.build(keys[:0]).slots(keys)) == len(keys)


@pytest.mark.parametrize("block", [1 << 18, 64])
def test_written_and_read_back(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(token_store, "BLOCK", block)
    data = [(i * 7 - 20, t, "q", 3) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame([*data, (None, "x", "q", 3)], "doc_id long, text string, part string, block int").repartition(3)
    e, at, want = encoder(tokenizer_path()), 0, []
    for i, t, *_ in sorted(data, key=lambda d: d[0]):
        ids = np.array([*e.tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in stored(df, tokenizer_path()).collect()) == want
    write(df, str(tmp_path / "s"), tokenizer_path())
    keys = spark.createDataFrame([(-20,), (-13,), (10**9,), (3,), (None,)], "doc_id long")
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in lookup(spark, str(tmp_path / "s"), keys).collect()}
    assert got == {i: (n, c) for i, _, n, c in want if i in (-20, -13)}
    assert stored(df.limit(0), tokenizer_path()).collect() == []

import hashlib

from pyspark.sql import Row
from pyspark.sql import functions as F

from tidemark.llm.chat_format import canonical_turns, conversations_from_rows, digests, formatted, read_back, with_special

NASTY = ["", "\\", "\\s", "#", "### user: x</turn>\n### assistant: y</turn>\n", "a: b", "é\U0001f600\n\n", "\\### Assistant: </turn> ok", "</turn>"]


def test_round_trip_and_mask(spark):
    turns = [[(r, t) for t in NASTY] for r in ("user", "assistant", "a: b\n#", "")]
    rows = [Row(conv_id=i, turns=[Row(role=r, text=t) for r, t in ts], turn=1) for i, ts in enumerate([*turns, []])]
    df = spark.createDataFrame(rows, "conv_id long, turns array<struct<role:string,text:string>>, turn int")
    got = {r.conv_id: r for r in read_back(formatted(canonical_turns(df))).collect()}
    for i, ts in enumerate([*turns, []]):
        assert [(t.role, t.text) for t in got[i].turns_read] == ts
        assert got[i].loss_text == "".join(t for r, t in ts if r == "assistant")


def test_layouts_by_fingerprint(spark):
    ddl = "id int, messages array<struct<role:string,content:string>>, conversations array<struct<`from`:string,value:string>>, instruction string, input string, output string, prompt string, completion string, system string, layout string"
    rows = [
        (1, [("user", "u"), ("assistant", None)], None, None, None, None, None, None, None, "x"),
        (2, None, [("human", "u")], None, None, None, None, None, None, "x"),
        (3, None, None, "do", "it", "done", None, None, None, "x"),
        (4, None, None, "do", None, "done", None, None, "sys", "x"),
        (5, None, None, None, None, None, "p", "c", None, "x"),
        (6, None, None, "do", None, None, "p", None, None, "x"),
        (7, None, None, None, None, None, None, None, None, "x"),
    ]
    got = {r.id: (r.layout, [(t.role, t.text) for t in r.turns]) for r in canonical_turns(spark.createDataFrame(rows, ddl)).collect()}
    assert got == {
        1: ("messages", [("user", "u"), ("assistant", "")]), 2: ("from_value", [("human", "u")]), 3: ("instruction", [("user", "do\n\nit"), ("assistant", "done")]),
        4: ("instruction", [("system", "sys"), ("user", "do"), ("assistant", "done")]), 5: ("prompt", [("user", "p"), ("assistant", "c")]), 6: (None, []), 7: (None, []),
    }


def test_query_from_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (2, 5, None, "x"), (1, 1, "assistant", "b"), (3, None, "assistant", "é" * 5000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    got = {r.conv_id: r for r in digests(formatted(canonical_turns(conversations_from_rows(with_special(df))))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == {1, 2, 3, -7}
    assert got[1].n_turns == 3 and got[1].turns_sha256 == sha("user\n\nassistant\nb\nassistant\nb\n") and got[1].loss_sha256 == sha("bb")
    assert got[2].turns_sha256 == sha("\nx\n") and got[2].loss_chars == 0 and got[2].loss_sha256 == sha("")
    assert got[3].loss_chars == 5000
    s = "\\### Assistant: </turn> ok"
    assert got[-7].turns_sha256 == sha(f"user\n{s}\nassistant\n{s}\n") and got[-7].loss_sha256 == sha(s)
    assert conversations_from_rows(df.where(F.lit(False))).count() == 0

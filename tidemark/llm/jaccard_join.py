"""N-gram Jaccard join by PartEnum signatures.

A document is the set of its distinct runs of k words. Sets of one size band differ in at most h elements if they are
similar enough. The domain is cut into n1 parts of n2 pieces by hashing; some part then holds at most k2 = h // n1 of
the differences, so all but k2 of its pieces are equal in both sets. A signature stands for the content of one choice
of n2 - k2 pieces of a part: similar sets share one for certain. A set also gets the signatures of the next band, for
partners that are a little larger.

Candidates share a signature and are then compared exactly. Equal sets are one node. In a group of sets that share a
signature, each is first compared with one pivot. Groups that are then in one component need no more comparisons. Those
that are not are compared pair by pair if small; large ones form clusters, and what lies outside a cluster's largest component is compared with all of the cluster in
blocks, which give edges between components only: no link that joins two components is lost, and no group is expanded
into rows of pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .exchange import shared_keys
from .graph import components
from .scratch import Scratch
from .text import U, mix, pieces, shingles, texts, tidy

#: Ids whose broadcast is surely small (8 bytes each).
SMALL = 500_000
#: Members of a group that is compared pair by pair: at most FEW / 2 pairs a member.
FEW = 16


def bands(num: int, den: int, largest: int) -> np.ndarray:
    """The largest size of each band: a set's partners (similarity num/den) are in its band or a neighbouring one."""
    ends, low = [], 1
    while low <= largest:
        ends.append(low * den // num)
        low = ends[-1] + 1
    return np.array([*ends, low * den // num], np.int64)


def shape(end: int, num: int, den: int) -> tuple[int, int, int, int]:
    """n1, n2, k2 and the spare parts among n1, for sets of at most ``end`` elements."""
    differ = 2 * end * (den - num) // (den + num)
    if differ == 0:
        return 1, 1, 0, 0
    n1 = (differ + 2) // 2
    n2 = 2
    while n2 < 4 and (n2 - 1) * end < 6 * n1 * n2:  # pieces kept in a signature: six elements or so
        n2 += 1
    spare = -(-n1 // 8) if n1 > 1 else 0
    return n1 + spare, n2, differ // n1, spare


def signed(s: np.ndarray, first: np.ndarray, num: int, den: int):
    """Signatures of sets of distinct hashes that lie one after another: keys, their sets, and what each key is of.

    The third is the part's number * 2, and 1 more in the next band. The fourth gives each set's room in its own band
    and the next: how many parts it could leave out besides those it does; -1 where it leaves out none.

    Pieces may be empty, and a signature of nothing says nothing. With ``spare`` more parts than needed, spare + 1 parts
    of similar sets agree; so a set in which no more than ``spare`` parts have such a signature leaves them out.
    """
    size = np.diff(first)
    ends = bands(num, den, int(size.max(initial=1)))
    own = np.searchsorted(ends, size)
    room = np.full((2, len(size)), -1, np.int64)
    keys, owners, places = [], [], []
    for up in (0, 1):
        for b in np.unique(own[size > 0]):
            every, band = np.flatnonzero((own == b) & (size > 0)), int(b) + up
            n1, n2, k2, spare = shape(int(ends[band]), num, den)
            step = max(1, MOST // (n1 * n2))
            for docs in (every[i : i + step] for i in range(0, len(every), step)):
                n = size[docs]
                h = s[np.repeat(first[docs] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                at = ((mix(h ^ U(band * 0x9E3779B9 + 1)) >> U(32)) * U(n1 * n2) >> U(32)).astype(np.int64) + np.repeat(np.arange(len(docs)), n) * (n1 * n2)
                h, cells = mix(h + U(band)), len(docs) * n1 * n2
                low, high = (np.bincount(at, x.astype(np.float64), cells).astype(U) for x in (h & U(0xFFFFFFFF), h >> U(32)))  # sums under 2**53
                held = (low + (high << U(32))).reshape(-1, n1, n2)
                full = np.bincount(at, minlength=cells).reshape(-1, n1, n2) > 0
                choices = list(combinations(range(n2), n2 - k2))
                told = np.stack([full[:, :, list(c)].any(2) for c in choices])
                left = (~told.all(0)).sum(1)
                told[:, left > spare] = True
                room[up, docs] = np.where(left > spare, -1, spare - left)
                held = [mix(held[:, :, c] + U(c + 1)) for c in range(n2)]
                for j, chosen in enumerate(choices):
                    got = mix(sum(held[c] for c in chosen) + U((band << 40) + (j << 32)) + np.arange(n1, dtype=U))
                    doc, part = np.nonzero(told[j])
                    keys.append(got[doc, part])
                    owners.append(docs[doc])
                    places.append(part * 2 + up)
    if not keys:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), room
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(places), room


#: Cells of parts that are held at a time.
MOST = 1 << 18


def sketches(s: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Of each set: how many hashes fall into each of 2**b equal ranges, four to a range at most on average."""
    size = np.diff(first)
    out = [b""] * len(size)
    for i in range(len(size)):
        bits = min(16, max(6, (int(size[i]) // 4).bit_length()))
        if size[i]:
            out[i] = np.minimum(np.bincount((s[first[i] : first[i + 1]] >> U(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()
    return out


def apart(x: bytes, y: bytes) -> int:
    """By how many elements two sets differ at least: by the sum of what their sketches differ."""
    a, b = np.frombuffer(x, np.uint8).astype(np.int32), np.frombuffer(y, np.uint8).astype(np.int32)
    n = min(len(a), len(b))
    return int(np.abs(a.reshape(n, -1).sum(1) - b.reshape(n, -1).sum(1)).sum()) if n else 0


def _sets(batch: pa.RecordBatch, k: int):
    """ids, and their sets of shingle hashes one after another with the start of each, of (id, text), piece by piece."""
    ids = np.asarray(batch.column(0))
    buf, off = texts(batch.column(1))
    for a, b, part, begin in pieces(buf, off, 1 << 19):
        yield ids[a:b], *shingles(part, begin, k)


def _digests(s: np.ndarray, first: np.ndarray, salt: int) -> np.ndarray:
    total = np.concatenate([np.zeros(1, U), np.cumsum(mix(s + U(salt)), dtype=U)])
    return (total[first[1:]] - total[first[:-1]]).view(np.int64)


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def jaccard_components(docs: DataFrame, words: int = 5, num: int = 8, den: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id): classes of equal sets, and components of sets with a Jaccard similarity of num/den or more.

    A null text, or one without words, has no shingles and links with nothing: its class and component are itself. A
    text of fewer words than ``words`` has its whole sequence as one shingle. Rows with a null id take no part. Rows
    repeated under one id are one document and give one row; if their texts differ, its set is the least of theirs (by
    size, then digest). Other columns, whatever their names, are not read. An empty table gives an empty result.
    class_id and component_id are the smallest ids. Sets are told apart by 128 bits and compared by 64 bits of each
    shingle.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    rows = _named(docs, id_col, text_col)

    def digest(batches):
        for batch in batches:
            for ids, s, first in _sets(batch, words):
                columns = [ids, np.diff(first), _digests(s, first, 0), _digests(s, first, 7)]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(sketches(s, first), pa.binary())], names=["id", "n", "a", "b", "counts"])

    sets = rows.mapInArrow(tidy(digest), "id long, n long, a long, b long, counts binary")
    sets = scratch.save(sets.groupBy("id").agg(F.min(F.struct("n", "a", "b", "counts")).alias("of")).select("id", "of.*"), "sets")
    classes = scratch.save(sets.where("n > 0").groupBy("a", "b", "n").agg(F.min("id").alias("class_id"), F.count("*").alias("c")).where("c > 1"), "classes")
    total, largest, every = sets.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0)), F.count("*")).first()
    member = scratch.save(_classed(sets.select("id", "n", "a", "b"), classes, every), "member")
    labels = _link(scratch, rows, sets, member, words, num, den, total)
    return member.join(labels.select(F.col("id").alias("class_id"), "label"), "class_id", "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "class_id", F.coalesce("label", "class_id").alias("component_id")
    )


#: A class of more than 1/HOT of all rows is joined by broadcast; there are fewer than HOT of these.
HOT = 1000


def _classed(sets: DataFrame, classes: DataFrame, every: int) -> DataFrame:
    """(id, n, class_id) of (id, n, a, b); the few classes that hold many rows are not dealt out by their key."""
    large = max(HOT, every // HOT)
    on = ["a", "b", "n"]
    hot = F.broadcast(classes.where(F.col("c") > large).select(*on, F.col("class_id").alias("hot")))
    found = sets.join(hot, on, "left")
    rest = found.where("hot is null").join(classes.where(F.col("c") <= large).select(*on, "class_id"), on, "left")
    return found.where("hot is not null").select("id", "n", F.col("hot").alias("class_id")).union(rest.select("id", "n", F.coalesce("class_id", "id").alias("class_id")))


def _only(rows: DataFrame, ids: DataFrame, n: int, how: str = "left_semi") -> DataFrame:
    """The rows of ``ids`` (or without them): by broadcast if these are surely small, else by their key."""
    return rows.join(F.broadcast(ids) if n <= SMALL else ids, "id", how)


def _shingled(rows: DataFrame, who: DataFrame, k: int) -> DataFrame:
    """(id, s: the hashes of its set, 8 bytes each) of (id, a: the set's digest)."""

    def run(batches):
        for batch in batches:
            for ids, s, first in _sets(batch, k):
                held = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer((first * 8).astype(np.int32)), pa.py_buffer(s)])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(_digests(s, first, 0), pa.int64()), held], names=["id", "a", "s"])

    n = who.count()
    s = _only(rows, who.select("id"), n).mapInArrow(tidy(run), "id long, a long, s binary")
    return s.join(F.broadcast(who) if n <= SMALL else who, ["id", "a"], "left_semi").select("id", "s")


def _hashes(x: pa.Scalar) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), np.int64)


def _link(scratch: Scratch, rows: DataFrame, sets: DataFrame, member: DataFrame, k: int, num: int, den: int, total: int) -> DataFrame:
    """(id, label) of the classes that have links."""

    def emit(batch):
        for ids, s, first in _sets(batch, k):
            key, owner, _, _ = signed(s, first, num, den)
            yield key, ids[owner], np.zeros(len(key), np.int64)

    copies = scratch.save(member.where("id <> class_id or n = 0").select("id"), "copies")
    found = shared_keys(_only(rows, copies, copies.count(), "left_anti"), emit, total * 4.0 * (den - num) / (den + num) * 1.5)
    found = scratch.save(found.select("key", F.col("owner").alias("id")), "found")
    heads = found.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("last"), F.count("*").alias("c")).where("pivot < last")
    groups = scratch.save(found.join(heads.select("key", "pivot", "c"), "key"), "groups")
    scratch.free(found, copies)
    labels = scratch.save(groups.select("id").distinct().select("id", F.col("id").alias("label")), "labels")

    def close(batches):
        for batch in batches:
            x, y, nx, ny, cx, cy = (batch.column(i) for i in range(6))
            most = (np.asarray(nx) + np.asarray(ny)) * (den - num)
            ok = [apart(a.as_py(), b.as_py()) * (den + num) <= m for a, b, m in zip(cx, cy, most, strict=True)]
            yield pa.RecordBatch.from_arrays([x, y], names=["x", "y"]).filter(pa.array(ok, pa.bool_()))

    def linked(pairs: DataFrame) -> DataFrame:
        """Of (x, y): those that are similar."""
        who = scratch.save(pairs.select(F.explode(F.array("x", "y")).alias("id")).distinct().join(sets.select("id", "a"), "id"), "who")
        s = scratch.save(_shingled(rows, who, k), "shingles", "none")  # hashes don't compress
        both = pairs.join(s.select(F.col("id").alias("x"), F.col("s").alias("sx")), "x").join(s.select(F.col("id").alias("y"), F.col("s").alias("sy")), "y").select("x", "y", "sx", "sy")

        def similar(batches):
            for batch in batches:
                ok = []
                for a, b in zip(batch.column(2), batch.column(3), strict=True):
                    a, b = _hashes(a), _hashes(b)
                    both_, all_ = len(np.intersect1d(a, b, assume_unique=True)), len(a) + len(b)
                    ok.append(den * both_ >= num * (all_ - both_))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

        out = scratch.save(both.mapInArrow(tidy(similar), "a long, b long").distinct(), "linked")
        scratch.free(s, who)
        return out

    def joined(labels: DataFrame, pairs: DataFrame) -> DataFrame:
        """``labels`` after comparing (x, y): each y with its first x, then with the others that this leaves in another component."""
        pairs = scratch.save(pairs, "pairs")
        of = lambda c: sets.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("counts").alias(f"c{c}"))
        sized = pairs.join(of("x"), "x").join(of("y"), "y").where(f"{den} * least(nx, ny) >= {num} * greatest(nx, ny)").select("x", "y", "nx", "ny", "cx", "cy")
        near = scratch.save(sized.mapInArrow(tidy(close), "x long, y long"), "close")
        scratch.free(pairs)
        first = scratch.save(near.groupBy("y").agg(F.min("x").alias("x")).select("x", "y"), "first")
        labels = _joined(labels, linked(first), scratch)
        of = lambda c: labels.select(F.col("id").alias(c), F.col("label").alias(f"l{c}"))
        rest = scratch.save(near.join(first, ["x", "y"], "left_anti").join(of("x"), "x").join(of("y"), "y").where("lx <> ly").select("x", "y"), "rest")
        scratch.free(near, first)
        return _joined(labels, linked(rest), scratch) if rest.limit(1).count() else labels

    # each against the first of its group, which joins nearly all of a group that hangs together
    labels = joined(labels, groups.where("id <> pivot").select(F.col("pivot").alias("x"), F.col("id").alias("y")).distinct())
    # groups of three or more in which some are not yet together
    at = groups.where("c > 2").join(labels, "id")
    left = at.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    at = scratch.save(at.join(left, "key").select("key", "id", "label", "c"), "left")
    if not at.limit(1).count():
        return labels
    stuck = _stuck(scratch, rows, sets, at.where(f"c > {FEW}"), k, num, den)
    at = at.where(f"c <= {FEW}").select("key", "id", "label").union(at.where(f"c > {FEW}").join(stuck, ["key", "id"], "left_semi").select("key", "id", "label"))
    heads = at.groupBy("key").agg(F.count("*").alias("c"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("id").alias("first")).where("lo < hi").select("key", "c", "first")
    at = scratch.save(at.join(heads, "key"), "left")
    # small ones pair by pair
    few = at.where(f"c <= {FEW}")
    pairs = few.select("key", F.col("id").alias("x"), "label").join(few.select("key", F.col("id").alias("y"), F.col("label").alias("to")), "key").where("x < y and label <> to")
    labels = joined(labels, pairs.select("x", "y").distinct())
    loose = scratch.save(at.where(f"c > {FEW}").select("id", "first").distinct(), "loose")
    if not loose.limit(1).count():
        return labels
    # firsts that share a member are tied to the least of them, so a member brings one edge and not one for each group
    least = scratch.save(loose.groupBy("id").agg(F.min("first").alias("least")), "least")
    ties = loose.join(least, "id").select("first", "least").where("first <> least").distinct().union(least.select("id", "least"))
    cluster = components(ties.toDF("a", "b"), scratch)
    clustered = scratch.save(cluster.select("id", F.col("label").alias("cluster")).join(labels, "id"), "clusters")
    who = scratch.save(clustered.select("id").join(sets.select("id", "a"), "id"), "who")
    s = _shingled(rows, who, k).dropDuplicates(["id"])
    return _joined(labels, _compared(clustered, s, num, den, scratch), scratch)


def _stuck(scratch: Scratch, rows: DataFrame, sets: DataFrame, heavy: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(key, id) of large groups, without the sets that can leave them out.

    Similar sets agree in spare + 1 parts. A set that leaves out no more parts than ``spare``, by empty signatures and by
    large groups together, shares another signature with each similar set, and that one's group is seen to elsewhere.
    """
    who = scratch.save(heavy.select("id").distinct(), "heavy")

    def parts(batches):
        for batch in batches:
            for ids, s, first in _sets(batch, k):
                key, owner, place, room = signed(s, first, num, den)
                columns = [(key & low).view(np.int64), ids[owner], place, room[place % 2, owner]]
                for a in range(0, len(key), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 100_000], pa.int64()) for c in columns], names=["key", "id", "place", "room"])

    low = ~U((1 << 24) - 1)  # what any exchange keeps of a key
    short = lambda c: F.col(c).bitwiseAND(F.lit(int(low.view(np.int64))))
    told = _only(rows, who, who.count()).mapInArrow(tidy(parts), "key long, id long, place long, room long")
    told = scratch.save(told.join(heavy.select(short("key").alias("key"), "id").distinct(), ["key", "id"]), "told")
    band = told.groupBy("id", (F.col("place") % 2).alias("up")).agg(F.countDistinct("place").alias("parts"), F.min("room").alias("room")).where("parts > room")
    left = told.withColumn("up", F.col("place") % 2).join(band.select("id", "up"), ["id", "up"], "left_semi").select(F.col("key").alias("short"), "id").distinct()
    return heavy.select("key", "id", short("key").alias("short")).join(left, ["short", "id"], "left_semi").select("key", "id").distinct()


def _joined(labels: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``labels`` (id, label) after joining the labels of the ids of ``edges`` (a, b); a label's own label is itself."""
    of = lambda c, to: labels.select(F.col("id").alias(c), F.col("label").alias(to))
    joined = components(edges.join(of("a", "la"), "a").join(of("b", "lb"), "b").where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")), scratch)
    return scratch.save(labels.join(joined.select(F.col("id").alias("label"), F.col("label").alias("to")), "label", "left").select("id", F.coalesce("to", "label").alias("label")), "labels")


#: Members of a cluster that a task compares with how many others.
ROWS, COLUMNS = 256, 1024


def _compared(member: DataFrame, sets: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    """Edges (a, b) between labels for the links within clusters (id, cluster, label).

    Those outside a cluster's largest component are compared with all of the cluster, block by block; a block gives at
    most as many edges as it has labels.
    """
    sizes = member.groupBy("cluster", "label").agg(F.count("*").alias("c")).groupBy("cluster").agg(F.sum("c").alias("all"), F.max(F.struct("c", "label")).alias("top"))
    sizes = sizes.select("cluster", F.col("top.label").alias("main"), F.ceil((F.col("all") - F.col("top.c")) / ROWS).cast("int").alias("rows"), F.ceil(F.col("all") / COLUMNS).cast("int").alias("columns"))
    full = scratch.save(member.join(sizes, "cluster").where("rows > 0").join(sets, "id"), "members")
    own = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    down = full.where("label <> main").select("cluster", own("rows", 1).alias("r"), every("columns").alias("c"), F.lit(0).alias("side"), "id", "label", "s")
    across = full.select("cluster", every("rows").alias("r"), own("columns", 2).alias("c"), F.lit(1).alias("side"), "id", "label", "s")

    def compare(batches):
        now, held = None, []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6)), batch.column(6), strict=True):
                if row[:3] != now:
                    yield from _edges(held, num, den)
                    now, held = row[:3], []
                held.append((*row[3:6], _hashes(row[6])))
        yield from _edges(held, num, den)

    keys = ["cluster", "r", "c"]
    return scratch.save(down.union(across).repartition(*keys).sortWithinPartitions(*keys, "side", "id").mapInArrow(tidy(compare), "a long, b long").distinct(), "edges")


def _edges(held: list[tuple], num: int, den: int):
    down, across = [h for h in held if h[0] == 0], [h for h in held if h[0] == 1]
    if not down or not across:
        return
    size = np.array([len(h[3]) for h in down + across])
    value, where = np.unique(np.concatenate([h[3] for h in down + across]), return_inverse=True)
    owner, often = np.repeat(np.arange(len(size)), size), np.bincount(where)
    place = np.cumsum(often > 1) - 1  # elements of one set only are never common
    keep = often[where] > 1
    owner, where, n = owner[keep], place[where[keep]], int((often > 1).sum())
    common = np.zeros((len(down), len(across)), np.float32)
    order = np.argsort(where, kind="stable")
    owner, where = owner[order], where[order]
    for lo in range(0, n, 4096):
        a, b = np.searchsorted(where, (lo, lo + 4096))
        has = np.zeros((len(size), min(4096, n - lo)), np.float32)
        has[owner[a:b], where[a:b] - lo] = 1
        common += has[: len(down)] @ has[len(down) :].T
    linked = den * common >= num * (size[: len(down), None] + size[None, len(down) :] - common)
    la, lb = np.array([h[2] for h in down]), np.array([h[2] for h in across])
    linked &= la[:, None] != lb[None, :]
    up: dict[int, int] = {}

    def top(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    out = []
    for x, y in {(int(la[i]), int(lb[j])) for i, j in np.argwhere(linked)}:
        p, q = top(x), top(y)
        if p != q:
            up[max(p, q)] = min(p, q)
            out.append((x, y))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])


def near_duplicates_dropped(docs: DataFrame, words: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """``docs`` with one document of each component: that of the smallest doc_id.

    Rows without a doc_id stay. Of rows repeated under one doc_id the one of the least text stays (nulls first).
    An empty table gives an empty one; columns are those of ``docs``, whatever else they hold.
    """
    part = jaccard_components(docs, words, num, den)
    gone = part.where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    again = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("__rows")).where("__rows > 1").select("doc_id")
    if not again.limit(1).count():
        return kept
    order = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_first(), *(F.xxhash64(c) for c in docs.columns if c not in ("doc_id", "text")))
    one = kept.join(again, "doc_id", "left_semi").withColumn("__row", F.row_number().over(order)).where("__row = 1")
    return kept.join(again, "doc_id", "left_anti").unionByName(one.drop("__row")).select(*docs.columns)

"""Chat formatting by schema fingerprints.

A record may hold its conversation as a list of messages, of turns, of from/value pairs, as instruction and output, or as
prompt and completion. The paths of its nested fields that are there, sorted and hashed, are its fingerprint; a registry
maps fingerprints to declarative mappings, which are Spark SQL expressions that give canonical turns (role, text). A
template marks the turns, with the control characters in roles and texts escaped, and the loss mask is a list of spans.
Reading back undoes all of it. Everything is built of Spark's own functions.

The template of a turn is ``### role: text</turn>`` and a line feed. Inside roles and texts ``\\`` is written ``\\s``, ``#``
``\\h``, ``<`` ``\\l``, and in roles also ``:`` ``\\c``; so ``###``, ``</turn>`` and the first ``: `` of a turn can only be marks.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURNS = "array<struct<role:string,text:string>>"
OPEN, BETWEEN, CLOSE = "### ", ": ", "</turn>\n"
TEXT_ESCAPES = (("\\", "\\s"), ("#", "\\h"), ("<", "\\l"))
ROLE_ESCAPES = (*TEXT_ESCAPES, (":", "\\c"))


@dataclass(frozen=True)
class Layout:
    """``needs`` and ``may``: field paths that such a record has, or may have. ``turns``: an expression over its columns."""

    name: str
    needs: tuple[str, ...]
    turns: str
    may: tuple[str, ...] = ()


def _pairs(column: str, role: str, text: str) -> str:
    return f"transform({column}, m -> struct(cast(m.{role} as string) as role, cast(m.{text} as string) as text))"


def _one(role: str, text: str) -> str:
    return f"array(struct('{role}' as role, {text} as text))"


SYSTEM = "if(system is null, cast(array() as array<struct<role:string,text:string>>), " + _one("system", "cast(system as string)") + ")"
NO_SYSTEM = "cast(array() as array<struct<role:string,text:string>>)"
LAYOUTS = (
    Layout("messages", ("messages[].role", "messages[].content"), _pairs("messages", "role", "content")),
    Layout("turns", ("turns[].role", "turns[].text"), _pairs("turns", "role", "text")),
    Layout("from_value", ("conversations[].from", "conversations[].value"), _pairs("conversations", "`from`", "value")),
    Layout("instruction", ("instruction", "output"), "concat({system}, " + _one("user", "concat_ws('\\n\\n', cast(instruction as string), {input})") + ", " + _one("assistant", "cast(output as string)") + ")", ("input", "system")),
    Layout("prompt", ("prompt", "completion"), "concat({system}, " + _one("user", "cast(prompt as string)") + ", " + _one("assistant", "cast(completion as string)") + ")", ("system",)),
    Layout("response", ("prompt", "response"), "concat({system}, " + _one("user", "cast(prompt as string)") + ", " + _one("assistant", "cast(response as string)") + ")", ("system",)),
)
#: Fields that tell layouts apart; others of a record say nothing of its layout.
KNOWN = {p.split("[")[0].split(".")[0] for lay in LAYOUTS for p in (*lay.needs, *lay.may)}


def leaf_paths(kind: T.DataType, at: str) -> list[str]:
    if isinstance(kind, T.ArrayType):
        return leaf_paths(kind.elementType, f"{at}[]")
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in leaf_paths(f.dataType, f"{at}.{f.name}")]
    return [at]


def fingerprint(df: DataFrame, columns: set[str] = KNOWN) -> Column:
    """Hash of the sorted paths of the nested fields that a row has: those under a column that isn't null."""
    there = [F.when(F.col(f"`{f.name}`").isNotNull(), F.array(*[F.lit(p) for p in leaf_paths(f.dataType, f.name)])).otherwise(F.array().cast("array<string>")) for f in df.schema.fields if f.name in columns]
    return F.sha2(F.array_join(F.array_sort(F.concat(*there)) if there else F.array().cast("array<string>"), "\n"), 256)


def canonical_turns(df: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``df`` with ``layout`` (null: none fits), ``fingerprint`` and ``turns``, in place of columns of these names.

    A row of no known layout has no turns (an empty list). A null text is empty and a null role too.
    """
    have = {f.name: set(leaf_paths(f.dataType, f.name)) for f in df.schema.fields}
    paths = set().union(*have.values()) if have else set()
    name, turns = F.lit(None).cast("string"), F.array().cast(TURNS)
    for lay in layouts:
        if not set(lay.needs) <= paths:
            continue
        may = [p for p in lay.may if p in paths]
        options = [[]]
        for p in may:
            options += [[*o, p] for o in options]
        prints = [F.sha2(F.lit("\n".join(sorted([*lay.needs, *o]))), 256) for o in options]
        made = F.expr(lay.turns.format(system=SYSTEM if "system" in paths else NO_SYSTEM, input="nullif(cast(input as string), '')" if "input" in paths else "cast(null as string)") if "{" in lay.turns else lay.turns)
        hit = F.col("__print").isin(*prints)
        name, turns = F.when(hit, lay.name).otherwise(name), F.when(hit, made).otherwise(turns)
    clean = F.transform("__turns", lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    got = df.withColumn("__print", fingerprint(df)).withColumn("__layout", name).withColumn("__turns", turns)
    return got.select(*[F.col(f"`{c}`") for c in df.columns if c not in ("layout", "fingerprint", "turns")], F.col("__layout").alias("layout"), F.col("__print").alias("fingerprint"), clean.alias("turns"))


def escape(text: Column, rules=TEXT_ESCAPES) -> Column:
    return reduce(lambda c, r: F.replace(c, F.lit(r[0]), F.lit(r[1])), rules, text)


def unescape(text: Column, rules=TEXT_ESCAPES) -> Column:
    return reduce(lambda c, r: F.replace(c, F.lit(r[1]), F.lit(r[0])), rules[::-1], text)


def formatted(df: DataFrame, learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``df`` with ``turns`` gets ``formatted`` and ``loss_spans`` (start from 1, length; in code points) over the learned roles' texts."""
    parts = F.transform("turns", lambda t: F.struct(F.concat(F.lit(OPEN), escape(t["role"], ROLE_ESCAPES), F.lit(BETWEEN)).alias("head"), escape(t["text"]).alias("body"), t["role"].isin(*learned).alias("learned")))
    whole = F.concat_ws("", F.transform("__parts", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))))
    # one pass over the turns, with the length so far
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def add(acc, p):
        at = acc["at"] + F.length(p["head"])
        spans = F.when(p["learned"], F.concat(acc["spans"], F.array(F.struct(at.alias("start"), F.length(p["body"]).alias("length"))))).otherwise(acc["spans"])
        return F.struct((at + F.length(p["body"]) + len(CLOSE)).alias("at"), spans.alias("spans"))

    return df.withColumn("__parts", parts).withColumn("formatted", whole).withColumn("loss_spans", F.aggregate("__parts", start, add, lambda acc: acc["spans"])).drop("__parts")


def read_back(df: DataFrame) -> DataFrame:
    """From ``formatted`` and ``loss_spans`` alone: ``turns_read`` and ``loss_text``."""
    pieces = F.split("formatted", CLOSE, -1)
    whole = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    head = F.length(F.lit(OPEN))
    turns = F.transform(whole, lambda p: F.struct(unescape(F.substring(F.substring_index(p, BETWEEN, 1), head + 1, F.length(p)), ROLE_ESCAPES).alias("role"), unescape(F.substring(p, F.length(F.substring_index(p, BETWEEN, 1)) + len(BETWEEN) + 1, F.length(p))).alias("text")))
    loss = F.concat_ws("", F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"], s["length"]))))
    return df.withColumn("turns_read", turns).withColumn("loss_text", loss)


def conversations_from_rows(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One record for each conversation from a table with a row for each turn: (conv_id, turns).

    Turns stand in the order of ``turn`` (null first), then role and text. Rows repeated are turns of their own.
    """
    one = F.struct(F.col(f"`{turn}`").alias("n"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    got = rows.groupBy(F.col(f"`{conv}`").alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("t"))
    return got.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def digests(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Lengths and hashes of what ``read_back`` gives."""
    got = read_back(df)
    told = F.concat_ws("", F.transform("turns_read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return got.select(F.col(id_col), F.size("turns_read").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "layout")


SPECIAL_ID, SPECIAL = -7, "\\### Assistant: </turn> ok"


def with_special(rows: DataFrame) -> DataFrame:
    """The table of turns plus conversation -7, whose texts look like the template's own marks."""
    extra = rows.sparkSession.range(2).select(F.lit(SPECIAL_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(SPECIAL).alias("text"))
    return rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(extra)


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, length(replace(replace(replace(text, '\', '\s'), '#', '\h'), '<', '\l')) AS body,
    length(replace(replace(replace(replace(role, '\', '\s'), '#', '\h'), '<', '\l'), ':', '\c')) AS head FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + head + 2 + body + 8) AS BIGINT) AS formatted_chars, 'turns' AS layout
FROM e GROUP BY conv_id
"""

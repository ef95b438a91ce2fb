"""License scan: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Units are the lines of a text (headers, notices) and, for licence files, the whole text; and
windows of words, in long lines and across lines, of licence files too: around each heavy word, windows of a template's length with the word where
the template has it, so that a complete notice is a window of its own whatever stands around it or breaks it, and overlapping
windows of twice the longest template for longer wordings. Where a line has the licence that is found, the line is the unit. The weight of a word is its count
times ln((1 + N) / (1 + df)) + 1 over all N texts; words that no template holds weigh 1. A unit has the licence of the
template with the largest cosine, if that is at least ``threshold``.

By the Cauchy-Schwarz inequality a unit that shares only light words with a template stays under the threshold, so units
without one of the heavy words are left out before anything is exploded, and none is lost.

A file without a licence of its own takes that of the nearest directory above it that has a licence file. Directories are
few beside files; ancestors are joined for distinct directories only. All of it is DataFrame and SQL functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Short forms, titles and tell-tale sentences of well-known licences, by SPDX identifier.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, either version 3 of the License"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
)
#: Names of licence files, without their extension.
FILES = r"(?i)(^|/)(licen[cs]e|copying|unlicense|notice)(\.(txt|md|rst))?$"

#: A window's first word and its length in one number; longer than any window.
BASE = 1 << 20


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits, lower case."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _words(text: str) -> list[str]:
    return [w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()]


def weights(templates, df: dict[str, int], n: int) -> tuple[list[dict[str, float]], list[float]]:
    idf = lambda w: math.log((1 + n) / (1 + df.get(w, 0))) + 1
    vectors = []
    for _, text in templates:
        own = _words(text)
        vectors.append({w: own.count(w) * idf(w) for w in sorted(set(own))})
    return vectors, [math.sqrt(sum(x * x for x in v.values())) for v in vectors]


def heavy_words(vectors: list[dict[str, float]], norms: list[float], threshold: float, idf: dict[str, float]) -> list[str]:
    """A unit with none of these is under the threshold for every template."""
    light: set[str] = set()
    for w in sorted(idf, key=lambda w: (idf[w], w)):
        if all(math.sqrt(sum(x * x for u, x in v.items() if u in light or u == w)) < threshold * norm * (1 - 1e-9) for v, norm in zip(vectors, norms, strict=True)):
            light.add(w)
    return sorted(set(idf) - light)


def _places(templates, heavy: list[str]) -> dict[str, list[tuple[int, int]]]:
    """By heavy word: its offsets in the templates that hold it, with their lengths."""
    out: dict[str, set[tuple[int, int]]] = {w: set() for w in heavy}
    for _, text in templates:
        own = _words(text)
        for o, w in enumerate(own):
            if w in out:
                out[w].add((o, len(own)))
    return {w: sorted(x) for w, x in out.items()}


def _windows(words: Column, places: dict[str, list[tuple[int, int]]], longest: int) -> Column:
    """Of an array of (w, line): windows [(at, length, their words)] around heavy words; (at, length) in one number."""
    offsets = F.create_map(*[x for w, p in places.items() for x in (F.lit(w), F.array(*[F.lit(o * BASE + n) for o, n in p]))])
    heavy = F.filter(F.transform(words, lambda s, i: F.struct(s["w"].alias("w"), i.cast("long").alias("i"))), lambda s: F.map_contains_key(offsets, s["w"]))
    aligned = lambda s: F.transform(offsets[s["w"]], lambda p: F.greatest(s["i"] - F.floor(p / BASE), F.lit(0)) * BASE + p % BASE)
    block = lambda s: F.floor(s["i"] / longest)
    wide = lambda s: F.array(*[F.greatest(block(s) - b, F.lit(0)) * longest * BASE + 2 * longest for b in (0, 1)])
    keys = F.array_distinct(F.flatten(F.transform(heavy, lambda s: F.concat(aligned(s), wide(s)))))
    return F.transform(keys, lambda key: F.struct(key.alias("key"), F.slice(words, (F.floor(key / BASE) + 1).cast("int"), (key % BASE).cast("int")).alias("words")))


def licensed(files: DataFrame, path_col: str = "path", text_col: str = "text", id_col: str = "doc_id", threshold: float = 0.6, templates=TEMPLATES) -> DataFrame:
    """(doc_id, license, score, origin, unit, licensed_by) of every row of ``files``.

    ``origin`` is "own" (a line, a window of words or, in a licence file, the whole text), "inherited" (``licensed_by`` is the licence file's
    path) or null without any. ``unit`` is the line's number from 0 (of a window, that of its first word), -1 for a licence file. Ties go to the larger score, the
    first unit, the first template. A null or empty text has no licence of its own; a null path inherits nothing; rows
    repeated each get a row, those of one id the same one (the best of them). Rows with a null id take no part. An empty
    table gives an empty result. Other columns are not read.
    """
    spark, scratch = files.sparkSession, Scratch(files.sparkSession, "license")
    names = sorted({w for _, t in templates for w in _words(t)})
    rows = files.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{path_col}`").cast("string").alias("path"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    vocabulary = F.array(*map(F.lit, names))
    counted = rows.select(F.explode(F.concat(F.array(F.lit("")), F.array_intersect(tokens(F.col("text")), vocabulary))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    df = {r["w"]: r["n"] for r in counted.collect()}  # of the templates' words only
    n = df.pop("", 0)
    vectors, norms = weights(templates, df, n)
    idf = {w: math.log((1 + n) / (1 + df.get(w, 0))) + 1 for w in names}
    heavies = heavy_words(vectors, norms, threshold, idf)
    heavy = F.array(*map(F.lit, heavies))
    is_file = F.coalesce(F.col("path").rlike(FILES), F.lit(False))
    lines = F.when(is_file, F.array(F.col("text"))).otherwise(F.split("text", "\n"))
    units = rows.select("id", is_file.alias("whole"), F.posexplode(lines).alias("unit", "line"))
    # the line's words once, and only of lines with a heavy one
    units = units.select("id", F.when(F.col("whole"), -1).otherwise(F.col("unit")).alias("unit"), tokens(F.col("line")).alias("words")).where(F.arrays_overlap("words", heavy))
    units = scratch.save(units.distinct(), "units")
    table = [(w, i, float(x)) for i, v in enumerate(vectors) for w, x in v.items()]
    by_word = F.broadcast(spark.createDataFrame(table, "w string, template int, weight double"))
    known = F.broadcast(spark.createDataFrame([(w, float(x)) for w, x in idf.items()], "w string, idf double"))
    about = F.broadcast(spark.createDataFrame([(i, name, float(norm)) for i, ((name, _), norm) in enumerate(zip(templates, norms, strict=True))], "template int, license string, of double"))

    def scores(units: DataFrame, key: str, name: str) -> DataFrame:
        terms = units.select("id", key, F.explode("words").alias("w")).groupBy("id", key, "w").agg(F.count("*").alias("tf"))
        terms = scratch.save(terms.join(known, "w", "left").select("id", key, "w", (F.col("tf") * F.coalesce("idf", F.lit(1.0))).alias("x")), name)
        length = terms.groupBy("id", key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
        dot = terms.join(by_word, "w").groupBy("id", key, "template").agg(F.sum(F.col("x") * F.col("weight")).alias("dot"))
        return dot.join(length, ["id", key]).join(about, "template").withColumn("score", F.round(F.col("dot") / (F.col("norm") * F.col("of")), 9)).where(F.col("score") >= threshold)

    prose = rows.where(F.arrays_overlap(tokens(F.col("text")), heavy)).select("id", is_file.alias("whole"), "text").distinct()
    of_line = lambda line, i: F.transform(tokens(line), lambda w: F.struct(w.alias("w"), i.alias("line")))
    spread = prose.select("id", F.struct("whole", F.xxhash64("text").alias("hash")).alias("text"), F.flatten(F.transform(F.split("text", "\n"), of_line)).alias("words"))
    longest = max(len(_words(t)) for _, t in templates)
    windows = spread.select("id", "text", F.explode(_windows(F.col("words"), _places(templates, heavies), longest)).alias("v"))
    windows = windows.select("id", F.struct("text", "v.key").alias("key"), F.col("v.words")[0]["line"].alias("line"), F.transform("v.words", lambda s: s["w"]).alias("words"))
    windows = scratch.save(windows, "windows")
    within = scores(windows, "key", "window_terms").join(windows.select("id", "key", "line"), ["id", "key"]).select("id", F.when(F.col("key.text.whole"), -1).otherwise(F.col("line")).alias("unit"), "template", "license", "score")
    # the licence by the best of lines and windows; where a line has that licence too, the line stands for it
    found = F.struct("score", (-F.col("unit")).alias("u"), (-F.col("template")).alias("t"))
    both = scores(units, "unit", "terms").select("id", "license", found.alias("line"), F.lit(None).cast("struct<score:double,u:int,t:int>").alias("part")).union(within.select("id", "license", F.lit(None).cast("struct<score:double,u:int,t:int>"), found))
    each = both.groupBy("id", "license").agg(F.max("line").alias("line"), F.max("part").alias("part"))
    order = F.struct(F.greatest("line.score", "part.score"), F.coalesce("line.score", F.lit(-1.0)), F.coalesce("line", "part").alias("b"), "license")
    best = each.groupBy("id").agg(F.max(order).alias("o")).select("id", "o.license", "o.b.score", (-F.col("o.b.u")).cast("int").alias("unit"))
    best = scratch.save(best, "best")
    own = rows.select("id", "path").join(best, "id", "left")
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.when(F.col("path").isNotNull(), F.lit("")))
    holders = own.where(F.col("license").isNotNull() & is_file).groupBy(folder.alias("above")).agg(F.max(F.struct("score", "path", "license")).alias("h"))
    # ancestors of every directory that holds a file without a licence
    bare = own.where("license is null").select(folder.alias("folder")).where("folder is not null").distinct()
    parts = F.split("folder", "/")
    above = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")))
    ways = bare.select("folder", F.explode(F.array_distinct(above)).alias("above")).join(holders, "above")
    nearest = ways.groupBy("folder").agg(F.max(F.struct(F.length("above").alias("depth"), "h")).alias("n")).select("folder", "n.h")
    out = own.withColumn("folder", folder).join(nearest, "folder", "left")
    inherits = F.col("license").isNull() & F.col("h").isNotNull()
    return out.select(
        F.col("id").alias("doc_id"), F.coalesce("license", "h.license").alias("license"), F.coalesce("score", "h.score").alias("score"),
        F.when(F.col("license").isNotNull(), "own").when(inherits, "inherited").alias("origin"), "unit", F.when(inherits, F.col("h.path")).alias("licensed_by"),
    )

"""Licence scan with DataFrame functions only: sparse TF-IDF cosine of headers, licence files and single statements
to templates, then inheritance from the nearest ancestor directory that has a licence file, by path joins."""

from __future__ import annotations

import collections
import functools
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import license_headers
from .common import Scratch, cut

# Licence identifiers and the usual wording of their notices.
TEMPLATES = (
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause Simplified License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause New or Revised License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under the CC0 1.0 Universal license."),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("ISC", "Licensed under the ISC License."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
)
#: What a text must hold for its headers and licence texts to be compared.
CUE = "(?i)licen[sc]|permi(t|ssion)|redistribut|public domain|spdx"
#: Common words; a choice of tokens takes others first.
COMMON = frozenset("a and any are by for in is may new not of or that the this to under use with without work you".split())
LICENCE_FILE = "(?i)^(licen[sc]e|copying|unlicense)([.-][^/]*)?$"
#: The same on a token. A window without one resembles no template.
TOKEN_CUE = "licen[sc]|permi(t|ssion)|redistribut|^domain$|spdx"
#: What comment lines begin with, besides signs that no token has.
COMMENT_WORD = "(?mi)^[ \\t]*@?(rem|dnl)[ \\t]"
#: The first line that is neither blank nor a comment line.
CODE_LINE = "(?mi)^[ \\t]*(?!#|//|/\\*|\\*|;|--|%|<!--|rem[ \\t]|dnl[ \\t])[^ \\t\\r\\n]"
#: A comment between marks at the start, after a line for the interpreter or the encoding.
BLOCK = "(?s)^(?:#[^\\n]*\\n|\\s)*+(/\\*.*?\\*/|<!--.*?-->|\"\"\".*?\"\"\"|'''.*?''')"
SPDX_TAG = "(?i)spdx-license-identifier:?[ \\t]*[(]*[ \\t]*([a-z0-9.+-]+)"
SENTENCE_END = "([.!?;])[ \\t\\r\\n]+"
NOT_TOKEN = "[^a-z0-9.+-]+"


def tokens(text: Column) -> Column:
    """Lower-case tokens without the points at their ends."""
    plain = F.regexp_replace(F.lower(text), NOT_TOKEN, " ")
    return F.filter(F.split(F.regexp_replace(plain, "[.]+( |$)", " "), " "), lambda x: x != "")


def telling(templates: tuple[tuple[str, str], ...], least: float) -> tuple[list[str], list[list[str]]]:
    """What a text holds if its cosine to some template is ``least``: one of the first tokens, or all of one of
    the groups. Without these, what it shares of each template's vector is shorter than ``least``, which bounds
    the cosine (Cauchy-Schwarz). Common words are only in groups, unless a template has little else."""
    bags = [collections.Counter(x for x in re.sub("[.]+( |$)", " ", re.sub(NOT_TOKEN, " ", body.lower())).split(" ") if x) for _, body in templates]
    df = collections.Counter(token for bag in bags for token in bag)
    single: set[str] = set()
    groups: list[list[str]] = []
    for bag in bags:
        square = {token: (tf * (math.log((1 + len(bags)) / (1 + df[token])) + 1)) ** 2 for token, tf in bag.items()}
        enough = (least - 1e-3) ** 2 * sum(square.values())
        left = sum(x for token, x in square.items() if token not in single)
        for token in sorted(set(bag) - single, key=lambda x: (x in COMMON, -square[x], x)):
            if left < enough:
                break
            needed = sorted(x for x in bag if x not in single and left - square[x] < enough)
            if token in COMMON and needed:
                groups.append(needed)
                break
            single.add(token)
            left -= square[token]
    return sorted(single), groups


def _any_of(names: list[str]) -> str:
    """A regular expression of any of some tokens, by their first letters, so that most places cost one look."""
    heads: dict[str, list[str]] = {}
    for x in names:
        heads.setdefault(x[0], []).append(re.escape(x[1:]))
    branches = "|".join(f"{k}(?:{'|'.join(v)})" for k, v in heads.items())
    return f"(?=[{''.join(heads)}])(?<![a-z0-9.+-])(?:{branches})(?![a-z0-9+-])"


def statements(text: Column, least: float, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> Column:
    """The lines and sentences of a whole text that can reach ``least`` with a template."""
    single, groups = telling(templates, least)

    def reaches(x: Column) -> Column:
        found = F.lower(x).rlike(_any_of(single)) if single else F.lit(False)
        for names in groups:
            found = found | functools.reduce(lambda a, b: a & b, (F.lower(x).contains(name) for name in sorted(names, key=len, reverse=True)))
        return found

    return F.filter(F.split(F.regexp_replace(text, SENTENCE_END, "$1\n"), "\n"), reaches)


def _sizes(lengths: list[int], ratio: float = 1.4) -> list[int]:
    """Window lengths such that each template is within a fifth or so of one."""
    out: list[int] = []
    for n in sorted(set(lengths)):
        if not out or n > out[-1] * 1.18:
            out.append(round(n * ratio / 1.18))
    return out


def pieces(texts: DataFrame, templates: tuple[tuple[str, str], ...]) -> DataFrame:
    """``text_id, text`` -> ``text_id, piece (array of tokens)``: what is compared with headers and licence texts. It is a
    text's leading comment, its start at the length of each template, the whole unless far longer than any
    template, SPDX tags, and windows of template length with a cue. An explode keeps Spark from making a step anew for each use."""
    lengths = sorted({n for _, body in templates if (n := len(re.findall("[a-z0-9.+-]*[a-z0-9][a-z0-9.+-]*", body.lower()))) > 2})
    longest = lengths[-1] * 3 // 2
    text, whole, n, size = F.col("text"), F.col("p.whole"), F.col("p.n"), F.col("w.size")
    once = lambda **columns: F.explode(F.array(F.struct(*(c.alias(k) for k, c in columns.items()))))
    at = F.regexp_instr(text, F.lit(CODE_LINE))
    lines = F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(F.lit(""))
    spdx = F.transform(F.regexp_extract_all(text, F.lit(SPDX_TAG), F.lit(1)), lambda x: F.array(F.lit("spdx-license-identifier"), F.regexp_replace(F.lower(x), "[.]+$", "")))
    read = texts.select("text_id", once(whole=header_tokens(text), lines=header_tokens(lines), block=header_tokens(F.regexp_extract(text, BLOCK, 1)), spdx=spdx).alias("p"))
    cues = F.filter(F.transform(whole, lambda x, i: F.when(x.rlike(TOKEN_CUE), i)), lambda x: x.isNotNull())
    read = read.select("text_id", once(whole=whole, n=F.size(whole), lines=F.col("p.lines"), block=F.col("p.block"), spdx=F.col("p.spdx"), cues=cues).alias("p"))
    kinds = [(x, 0) for x in lengths] + [(x, max(1, x // 6)) for x in _sizes(lengths)] + [(0, 0)]
    sizes = F.array(*(F.struct(F.lit(x).alias("size"), F.lit(step).alias("step")) for x, step in kinds))
    read = read.select("text_id", "p", F.explode(sizes).alias("w")).where((size < n) | (size == 0))
    # the windows that begin at a multiple of the step and hold a cue, the last one whole
    step = F.col("w.step")
    first = lambda c: F.greatest(F.lit(0), F.ceil((c - size + 1) / step).cast("int"))
    begins = F.flatten(F.transform("p.cues", lambda c: F.sequence(first(c), F.floor(c / step).cast("int"))))
    begins = F.array_distinct(F.transform(begins, lambda k: F.least(k * step, n - size)))
    whole_text = F.when(n <= longest, F.array(whole)).otherwise(F.array().cast("array<array<string>>"))
    found = F.when(size == 0, F.concat(F.array("p.lines", "p.block"), whole_text, "p.spdx"))
    found = found.when(step == 0, F.array(F.slice(whole, F.lit(1), size))).otherwise(F.transform(begins, lambda b: F.slice(whole, b + 1, size)))
    return read.select("text_id", F.explode(found).alias("piece")).where((F.size("piece") > 1) & (F.size("piece") <= longest))


def header_tokens(text: Column) -> Column:
    """Tokens of lines read as one, without what only decorates a comment."""
    return F.filter(tokens(F.regexp_replace(text, COMMENT_WORD, " ")), lambda x: x.rlike("[a-z0-9]"))


def headers(files: DataFrame, text: str, least: float, templates: tuple[tuple[str, str], ...]) -> DataFrame:
    """``files`` with ``text`` -> ``text_id, licence, score`` of the best piece of each text that reaches ``least``.

    Texts are dealt out once by their id, all else stays within a task. A piece goes on only if its tokens that
    templates have weigh enough for a cosine of ``least``; no other can reach it (Cauchy-Schwarz)."""
    cued = files.where(F.col(text).rlike(CUE)).groupBy(text_id(text).alias("text_id")).agg(F.first(text).alias("text"))
    parts = pieces(cued, templates).withColumn("piece_id", F.xxhash64("piece"))
    ids = ["text_id", "piece_id"]
    known, idf, default = _known(files, templates)
    counts = parts.select(*ids, F.explode("piece").alias("token")).groupBy(*ids, "token").agg(F.count(F.lit(1)).alias("tf"))
    w = counts.join(F.broadcast(idf), "token", "left").select(*ids, "token", F.col("idf").isNotNull().alias("has"), (F.col("tf") * F.coalesce("idf", F.lit(default))).alias("w"))
    square = F.col("w") * F.col("w")
    sums = w.groupBy(*ids).agg(F.sum(square).alias("all"), F.sum(F.when(F.col("has"), square)).alias("shared"), F.collect_list(F.when(F.col("has"), F.struct("token", "w"))).alias("own"))
    near = sums.where(F.col("shared") >= (least - 1e-4) ** 2 * F.col("all")).select(*ids, "all", F.explode("own").alias("t")).select(*ids, F.col("t.token").alias("token"), (F.col("t.w") / F.sqrt("all")).alias("w"))
    cosine = near.join(F.broadcast(known), "token").groupBy(*ids, "template", "licence").agg(F.sum(F.col("w") * F.col("tw")).alias("score"))
    cosine = cosine.withColumn("score", F.round("score", 4)).where(F.col("score") >= least)
    return cosine.groupBy("text_id").agg(F.max_by("licence", F.struct("score", -F.col("template"))).alias("licence"), F.max("score").alias("score"))


def text_id(text: str) -> Column:
    return F.xxhash64(text)


def _weighted(rows: DataFrame, ids: list[str], idf: DataFrame, text: str, default: float) -> DataFrame:
    """Sparse TF-IDF vectors of length one: ids, token, w."""
    counts = rows.select(*ids, F.explode(tokens(F.col(text))).alias("token")).groupBy(*ids, "token").agg(F.count(F.lit(1)).alias("tf"))
    w = counts.join(F.broadcast(idf), "token", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(default)))
    norms = w.groupBy(*ids).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norms, ids).select(*ids, "token", (F.col("w") / F.col("norm")).alias("w"))


def _known(rows: DataFrame, templates: tuple[tuple[str, str], ...]) -> tuple[DataFrame, DataFrame, float]:
    """Vectors of the templates (template, licence, token, tw), idf by token, and that of any other token.

    The template table is a constant of the operator, so its few rows are broadcast."""
    spark = rows.sparkSession
    table = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "template int, licence string, body string")
    df = table.select("template", F.explode(F.array_distinct(tokens(F.col("body")))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    n = len(templates)
    idf = df.select("token", (F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1).alias("idf"))
    unseen = F.log(F.lit(1.0) + n) + 1
    default = spark.range(1).select(unseen.alias("x")).first().x
    return _weighted(table, ["template", "licence"], idf, "body", default).withColumnRenamed("w", "tw"), idf, default


def matched(found: DataFrame, least: float, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """``found(statement)`` distinct -> ``statement, licence, score`` where the best cosine reaches ``least``."""
    known, idf, default = _known(found, templates)
    own = _weighted(found, ["statement"], idf, "statement", default)
    cosine = own.join(F.broadcast(known), "token").groupBy("statement", "template", "licence").agg(F.sum(F.col("w") * F.col("tw")).alias("score"))
    cosine = cosine.withColumn("score", F.round("score", 4)).where(F.col("score") >= least)
    best = cosine.groupBy("statement").agg(F.max_by("licence", F.struct("score", -F.col("template"))).alias("licence"), F.max("score").alias("score"))
    return best


def directory(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "[^/]*$", ""), "/$", "")


def scan(files: DataFrame, least: float = 0.7, key: str = "doc_id", path: str = "path", text: str = "text") -> DataFrame:
    """``key, path, licence, basis, score``: own licence (basis ``own``), else that of the nearest ancestor
    directory with a licence file (``inherited``), else null (``none``).

    A header or licence text that reaches ``least`` goes before single statements, which it may hold in a
    different sense (the first sentence of several licences is the same). Among either, a file takes the best
    match; of equal templates the earlier wins. A directory with
    several licence files takes the best match, ties to the first path. A null path has no directory and
    inherits nothing; null and empty texts have no statement. A null key stays null; rows that repeat
    (key, path) count once. Other columns aren't read. An empty table gives an empty one.

    What each file has of its own is made once, as a checkpoint. Statements are compared once for each distinct text, and directories are resolved once each, so neither a
    notice nor a directory that a third of all files share makes a large group.
    """
    rows = files.select(F.col(key).alias("key"), F.col(path).alias("path"), F.explode(statements(F.col(text), least)).alias("statement"))
    with Scratch(files.sparkSession) as scratch:
        cued = scratch.stored(rows.distinct())
        best = matched(cued.select("statement").distinct(), least)
        rank = F.struct("score", F.col("statement"))
        said = cued.join(best, "statement").groupBy("key", "path").agg(F.max_by(F.struct("licence", "score"), rank).alias("hit")).select("key", "path", F.lit(0).alias("whole"), "hit")
        named = files.where(F.col(text).rlike(CUE)).select(F.col(key).alias("key"), F.col(path).alias("path"), text_id(text).alias("text_id"))
        whole = named.join(headers(files, text, least, license_headers.templates()), "text_id").select("key", "path", F.lit(1).alias("whole"), F.struct("licence", "score").alias("hit"))
        best_of = F.max_by("hit", F.struct("whole", F.col("hit.score"), F.col("hit.licence"))).alias("hit")
        own = cut(said.union(whole).groupBy("key", "path").agg(best_of).select("key", "path", F.col("hit.licence").alias("own"), F.col("hit.score").alias("score")))
    everyone = files.select(F.col(key).alias("key"), F.col(path).alias("path")).distinct()
    same = everyone["key"].eqNullSafe(own["key"]) & everyone["path"].eqNullSafe(own["path"])
    all_files = everyone.join(own, same, "left").select(everyone["key"], everyone["path"], "own", "score").withColumn("dir", directory(F.col("path")))
    name = F.regexp_extract("path", "([^/]*)$", 1)
    declared = own.where(F.col("path").isNotNull() & name.rlike(LICENCE_FILE)).withColumn("dir", directory(F.col("path")))
    first = W.partitionBy("dir").orderBy(F.desc("score"), "path", "key")
    declared = declared.withColumn("rank", F.row_number().over(first)).where("rank = 1")
    declared = declared.select(F.col("dir").alias("ancestor"), F.col("own").alias("given"), F.col("score").alias("given_score"))
    parts = F.split("dir", "/")
    dirs = all_files.where("dir IS NOT NULL").select("dir").distinct()
    above = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("ancestor")))).alias("a"))
    above = above.select("dir", "a.depth", "a.ancestor").distinct()
    nearest = above.join(declared, "ancestor").groupBy("dir").agg(F.max_by(F.struct("given", "given_score"), "depth").alias("from"))
    out = all_files.join(nearest, "dir", "left")
    basis = F.when(F.col("own").isNotNull(), "own").when(F.col("from").isNotNull(), "inherited").otherwise("none")
    return out.select(
        F.col("key").alias(key), "path", F.coalesce("own", "from.given").alias("licence"), basis.alias("basis"),
        F.when(F.col("own").isNotNull(), F.col("score")).otherwise(F.col("from.given_score")).alias("score"),
    )


def document_path(key: str = "doc_id") -> Column:
    """Documents have no path; this gives one to each: thousand / hundred / twenty / name, where the first of a
    thousand, hundred or twenty is the licence file of that directory."""
    k = F.col(key)
    up = lambda n: F.floor(k / n).cast("string")
    licence = F.lit("LICENSE")
    return (
        F.when(k % 1000 == 0, F.concat_ws("/", up(1000), licence))
        .when(k % 100 == 0, F.concat_ws("/", up(1000), up(100), licence))
        .when(k % 20 == 0, F.concat_ws("/", up(1000), up(100), up(20), licence))
        .otherwise(F.concat_ws("/", up(1000), up(100), up(20), F.concat(k.cast("string"), F.lit(".txt"))))
    )


def oracle(least: float = 0.7, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> str:
    """The same scan of ``documents`` in DuckDB SQL, for texts without full headers; every statement is compared."""
    values = ", ".join(f"({i}, '{n}', '{t}')" for i, (n, t) in enumerate(templates))
    toks = lambda c: f"list_filter(string_split(regexp_replace(regexp_replace(lower({c}), '{NOT_TOKEN}', ' ', 'g'), '[.]+( |$)', ' ', 'g'), ' '), lambda x: x <> '')"
    return f"""
WITH templates(template, licence, body) AS (VALUES {values}),
files AS (SELECT DISTINCT doc_id, CASE
    WHEN doc_id % 1000 = 0 THEN concat_ws('/', CAST(doc_id // 1000 AS VARCHAR), 'LICENSE')
    WHEN doc_id % 100 = 0 THEN concat_ws('/', CAST(doc_id // 1000 AS VARCHAR), CAST(doc_id // 100 AS VARCHAR), 'LICENSE')
    WHEN doc_id % 20 = 0 THEN concat_ws('/', CAST(doc_id // 1000 AS VARCHAR), CAST(doc_id // 100 AS VARCHAR), CAST(doc_id // 20 AS VARCHAR), 'LICENSE')
    ELSE concat_ws('/', CAST(doc_id // 1000 AS VARCHAR), CAST(doc_id // 100 AS VARCHAR), CAST(doc_id // 20 AS VARCHAR), CAST(doc_id AS VARCHAR) || '.txt') END AS path, text FROM documents),
cued AS (SELECT DISTINCT doc_id, path, statement FROM
    (SELECT doc_id, path, unnest(string_split(regexp_replace(text, '([.!?;])[ \\t\\r\\n]+', '\\1' || chr(10), 'g'), chr(10))) AS statement FROM files)),
tdf AS (SELECT token, count(*) AS df FROM (SELECT template, unnest(list_distinct({toks("body")})) AS token FROM templates) GROUP BY token),
idf AS (SELECT token, ln((1.0 + {len(templates)}) / (1.0 + df)) + 1 AS idf FROM tdf),
tw AS (SELECT template, licence, token, count(*) * max(idf) AS w FROM (SELECT template, licence, unnest({toks("body")}) AS token FROM templates) JOIN idf USING (token) GROUP BY ALL),
tn AS (SELECT template, sqrt(sum(w * w)) AS norm FROM tw GROUP BY template),
sw AS (SELECT statement, token, count(*) * coalesce(max(idf), ln(1.0 + {len(templates)}) + 1) AS w
    FROM (SELECT statement, unnest({toks("statement")}) AS token FROM (SELECT DISTINCT statement FROM cued)) LEFT JOIN idf USING (token) GROUP BY statement, token),
sn AS (SELECT statement, sqrt(sum(w * w)) AS norm FROM sw GROUP BY statement),
cosine AS (SELECT statement, template, licence, round(sum((sw.w / sn.norm) * (tw.w / tn.norm)), 4) AS score
    FROM sw JOIN tw USING (token) JOIN sn USING (statement) JOIN tn USING (template) GROUP BY statement, template, licence),
best AS (SELECT statement, licence, score FROM cosine WHERE score >= {least} QUALIFY row_number() OVER (PARTITION BY statement ORDER BY score DESC, template) = 1),
own AS (SELECT doc_id, path, licence, score FROM cued JOIN best USING (statement) QUALIFY row_number() OVER (PARTITION BY doc_id, path ORDER BY score DESC, statement DESC) = 1),
everyone AS (SELECT f.doc_id, f.path, o.licence, o.score, regexp_replace(f.path, '/[^/]*$', '') AS dir FROM files f LEFT JOIN own o USING (doc_id)),
declared AS (SELECT dir, licence, score FROM everyone WHERE licence IS NOT NULL AND path LIKE '%/LICENSE' QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, path, doc_id) = 1),
dirs AS (SELECT DISTINCT dir FROM everyone),
nearest AS (SELECT a.dir, d.licence, d.score FROM dirs a JOIN declared d ON a.dir = d.dir OR starts_with(a.dir, d.dir || '/') QUALIFY row_number() OVER (PARTITION BY a.dir ORDER BY length(d.dir) DESC) = 1)
SELECT e.doc_id, e.path, coalesce(e.licence, n.licence) AS licence,
    CASE WHEN e.licence IS NOT NULL THEN 'own' WHEN n.licence IS NOT NULL THEN 'inherited' ELSE 'none' END AS basis,
    coalesce(e.score, n.score) AS score
FROM everyone e LEFT JOIN nearest n USING (dir)
"""

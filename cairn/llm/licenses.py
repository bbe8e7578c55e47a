"""License scans by diagonal voting over rolling word k-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm.words import ascii_lower

K = 3
#: Neighbouring diagonals up to this apart are one span (inserted or lost words).
GAP = 3
#: Least share of a template's words that a verified span covers.
COVER = 0.75

#: Words are split before A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# fixed values: base phrases, label then words
BASE = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
# fixed values: notices and openings of well-known public licenses, label then words
NOTICES = (
    ("agpl-3", "gnu affero general public license version 3"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright"),
    ("gpl", "gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("lgpl", "gnu lesser general public license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
)


def license_words(text: Column) -> Column:
    parts = F.split(F.coalesce(text, F.lit("")), SEPARATORS)
    return F.transform(F.filter(parts, lambda w: w != ""), ascii_lower)


def template_grams(spark: SparkSession) -> DataFrame:
    """(gram, tgram, tid, tpos, base, label, m): the positions of all templates, a fixed
    table of a few hundred rows; ``gram`` is the hash of the words ``tgram``."""
    rows = []
    for tid, (label, phrase) in enumerate(BASE + NOTICES):
        w = phrase.split()
        for p in range(len(w) - K + 1):
            rows.append((w[p : p + K], tid, p, tid < len(BASE), label, len(w)))
    grams = spark.createDataFrame(rows, "w array<string>, tid int, tpos int, base boolean, label string, m int")
    hashed = F.xxhash64(*[F.get("w", F.lit(j)) for j in range(K)])
    return grams.select(hashed.alias("gram"), F.array_join("w", " ").alias("tgram"), "tid", "tpos", "base", "label", "m")


def rolled_grams(w: Column, known: list[int]) -> Column:
    """(pos, gram, words) of every rolling k-gram of ``w``: its hash and, where a template
    has that hash, its words."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - K), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(K)]))
    rolled = F.transform(
        hashes,
        lambda h, i: F.struct(
            i.alias("pos"), h.alias("gram"),
            F.when(h.isin(known), F.concat_ws(" ", *[F.get(w, i + j) for j in range(K)])).alias("words"),
        ),
    )
    return F.when(F.size(w) >= K, rolled).otherwise(F.array().cast("array<struct<pos:int,gram:bigint,words:string>>"))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): counts, labels and spans.

    The hash of every rolling word k-gram of every whole text is joined to the template
    positions (a fixed, broadcast table), and a hit is verified on the words. Hits are
    summed by diagonal (word position minus template position); each diagonal is merged
    with those up to ``GAP`` beyond it, and a span is verified if its hits cover
    ``COVER`` of the template's words. A base phrase needs all its words on one diagonal.
    Of verified spans that chain up (neighbours at most ``GAP`` apart) the best is told,
    the first of equal ones.

    Null and empty texts have no words and no labels, score 0. Repeated rows return as
    often as they stand. Null ids are kept; an empty table gives no rows. Other columns
    of ``docs`` are ignored.
    """
    templates = template_grams(docs.sparkSession)
    known = sorted({r[0] for r in templates.select("gram").collect()})  # a fixed table
    own = F.struct(F.lit(-1).alias("pos"), F.lit(None).cast("bigint").alias("gram"), F.lit(None).cast("string").alias("words"))
    rolled = (
        docs.select("doc_id", F.xxhash64("text").alias("_h"), license_words(F.col("text")).alias("_w"))
        .select("doc_id", "_h", F.size("_w").cast("bigint").alias("n_words"), F.concat(F.array(own), rolled_grams(F.col("_w"), known)).alias("_g"))
        .select("doc_id", "_h", "n_words", F.inline_outer("_g"))
    )
    hits = rolled.join(F.broadcast(templates), "gram", "left").filter(
        (F.col("pos") < 0) | (F.col("tgram") == F.col("words"))
    )
    key = ["doc_id", "_h", "n_words"]
    diagonals = (
        hits.withColumn("diag", F.col("pos") - F.col("tpos"))
        .groupBy(*key, "tid", "base", "label", "m", "diag")
        .agg(
            F.count(F.lit(1)).alias("copies"),
            F.array_sort(F.collect_set("tpos")).alias("tpos"),
        )
    )
    near = Window.partitionBy(*key, "tid").orderBy("diag")
    merged = F.array_distinct(F.flatten(F.collect_list("tpos").over(near.rangeBetween(0, GAP))))
    covered = F.size(F.array_distinct(F.flatten(F.transform(merged, lambda t: F.sequence(t, t + F.lit(K - 1))))))
    cover = F.when(F.col("tid").isNotNull(), covered / F.col("m"))
    exact = F.size("tpos") == F.col("m") - K + 1
    apart = F.col("diag") - F.lag("diag").over(near)
    spans = (
        diagonals.withColumn("cover", cover)
        .withColumn("_new", F.coalesce((apart > GAP).cast("int"), F.lit(0)))
        .withColumn("_chain", F.sum("_new").over(near))
        # a base phrase is only ever exact
        .withColumn("ok", F.when(F.col("base"), exact).otherwise(F.col("cover") >= COVER))
        .groupBy(*key, "tid", "base", "label", "m", "_chain")
        .agg(
            F.max("copies").alias("copies"),
            F.max(F.when(F.col("ok"), F.struct("cover", (-F.col("diag")).alias("d")))).alias("best"),
            F.array_sort(F.collect_list(F.when(exact, F.col("diag")))).alias("exact"),
        )
    )
    judged = spans.select("*", F.col("best.cover").alias("cover"), (-F.col("best.d")).alias("d0"))
    ok = F.col("best").isNotNull()
    span = F.struct(
        F.col("d0").cast("bigint").alias("start"), F.col("m").alias("words"), "label", "cover"
    )
    flat = F.flatten(F.collect_list(F.when(F.col("base"), F.col("exact"))))
    per_doc = judged.groupBy(*key).agg(
        F.max(F.when(F.col("tid").isNull(), F.col("copies"))).alias("_copies"),
        flat.alias("_places"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base") & ok, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(ok, F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(ok, F.least(F.col("cover"), F.lit(1.0)))), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(ok & ~F.col("base"), span))).alias("spans"),
    )
    return (
        per_doc.withColumn("n_base", F.size("_places").cast("bigint"))
        .withColumn("first_word", F.array_min("_places").cast("bigint"))
        .withColumn("last_word", F.array_max("_places").cast("bigint"))
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies"))))
        .select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
    )


def op10_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan_licenses(docs).drop("spans")


def _values() -> str:
    return ", ".join(
        f"({tid}, '{label}', {str(tid < len(BASE)).lower()}, '{phrase}')"
        for tid, (label, phrase) in enumerate(BASE + NOTICES)
    )


ORACLE = f"""
WITH t AS (SELECT tid, label, base, string_split(phrase, ' ') AS w, len(string_split(phrase, ' ')) AS m FROM (VALUES {_values()}) x(tid, label, base, phrase)),
tg AS (SELECT tid, label, base, m, tpos, array_to_string(w[tpos + 1 : tpos + {K}], ' ') AS gram FROM (SELECT *, unnest(range(0, m - {K - 1})) AS tpos FROM t)),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
g AS (SELECT rid, pos, array_to_string(w[pos + 1 : pos + {K}], ' ') AS gram FROM (SELECT rid, w, unnest(range(0, len(w) - {K - 1})) AS pos FROM d WHERE len(w) >= {K})),
h AS (SELECT rid, tid, base, label, m, pos - tpos AS diag, tpos FROM g JOIN tg USING (gram)),
dg AS (SELECT rid, tid, base, label, m, diag, count(*) AS c FROM h GROUP BY ALL),
cv AS (SELECT dg.rid, dg.tid, dg.diag, count(DISTINCT h.tpos + k) AS covered FROM dg JOIN h ON h.rid = dg.rid AND h.tid = dg.tid AND h.diag BETWEEN dg.diag AND dg.diag + {GAP}, range({K}) r(k) GROUP BY ALL),
o AS (SELECT dg.*, covered / m AS cover, CASE WHEN base THEN c = m - {K - 1} ELSE covered / m >= {COVER} END AS ok FROM dg JOIN cv USING (rid, tid, diag)),
b AS (SELECT rid, count(*) AS n, min(diag) AS lo, max(diag) AS hi FROM dg WHERE base AND c = m - {K - 1} GROUP BY rid),
l AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS bl, string_agg(DISTINCT label, ',' ORDER BY label) AS al, max(least(cover, 1.0::DOUBLE)) AS score FROM o WHERE ok GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(b.n, 0) AS n_base, b.lo AS first_word, b.hi AS last_word, coalesce(l.bl, '') AS base_labels, coalesce(l.al, '') AS labels,
  coalesce(l.score, 0.0::DOUBLE) AS score FROM d LEFT JOIN b USING (rid) LEFT JOIN l USING (rid)
"""

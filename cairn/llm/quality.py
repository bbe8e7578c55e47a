"""Quality rules: hashed n-gram log-likelihood ratio between trusted and raw text."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.words import words
from cairn.session import checkpoint, small_or_shuffled


@dataclass(frozen=True)
class QualityConfig:
    """Parameters of the score.

    ``buckets`` bounds the two multinomials (and so the driver-side weight table);
    ``alpha`` is their additive smoothing. A text is scored without the trusted texts of
    its own one of ``folds`` folds, so that no text is measured against itself. The
    threshold is set by the trusted texts' own scores: ``spread`` times the gap between
    their ``low`` quantile and their median, below that quantile; ``grain`` is the width
    of the histogram that the quantiles are read from.
    """

    buckets: int = 16384
    alpha: float = 1.0
    folds: int = 4
    low: float = 0.01
    spread: float = 0.5
    grain: float = 1e-4
    scale: int = 1_000_000


RESULTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score", "base_failed", "kept",
)
SYMBOLS = r"[#*$%&|<>]"


def _grams(crc: Column, cfg: QualityConfig) -> Column:
    """Buckets of all words and of all pairs of adjacent words, from the words' crc32."""
    n = F.greatest(F.size(crc) - 1, F.lit(0))
    pairs = F.zip_with(
        F.slice(crc, 1, n), F.slice(crc, 2, n), lambda a, b: ((a * 31 + b) % cfg.buckets).cast("int")
    )
    return F.concat(F.transform(crc, lambda x: (x % cfg.buckets).cast("int")), pairs)


def word_crcs(w: Column) -> Column:
    return F.transform(w, lambda x: F.crc32(x.cast("binary")))


def window_hashes(w: Column, width: int = 3) -> Column:
    """64-bit hashes of all windows of ``width`` words, in order; none for fewer words."""
    n = F.size(w)
    return F.when(
        n >= width,
        F.transform(
            F.sequence(F.lit(0), n - width),
            lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def repeated_words(hashes: Column, repeated: Column, width: int = 3) -> Column:
    """Words that stand in a window found twice or more in the text.

    ``hashes`` are the windows in order, ``repeated`` the distinct values found twice.
    A few repeated windows are looked up; texts with many sort their windows instead, so
    that no text costs more than a sort.
    """
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-width).alias("p"))

    def covered(at: Column) -> Column:
        return F.aggregate(
            at,
            start,
            lambda acc, p: F.struct(
                (acc["n"] + F.least(p - acc["p"], F.lit(width))).alias("n"), p.alias("p")
            ),
            lambda acc: acc["n"],
        )

    few = F.filter(
        F.transform(hashes, lambda h, i: F.when(F.array_contains(repeated, h), i).otherwise(-1)),
        lambda i: i >= 0,
    )
    ranked = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def many(s: Column) -> Column:
        last = F.size(s) - 1
        flagged = F.transform(
            s,
            lambda x, i: F.when(
                ((i > 0) & (F.get(s, F.greatest(i - 1, F.lit(0)))["h"] == x["h"]))
                | ((i < last) & (F.get(s, i + 1)["h"] == x["h"])),
                x["i"],
            ).otherwise(F.lit(-1)),
        )
        return covered(F.array_sort(F.filter(flagged, lambda i: i >= 0)))

    # a one-element array binds the sorted windows once
    sorted_path = F.element_at(F.transform(F.array(ranked), many), 1)
    return (
        F.when(F.size(repeated) == 0, F.lit(0).cast("bigint"))
        .when(F.size(repeated) <= 32, covered(few))
        .otherwise(sorted_path)
    )


def base_features(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_w`` (words) and the base counts of every whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    w = F.col("_w")
    # arrays used more than once are columns of their own, so that each is made once
    with_words = docs.withColumn("_w", words(F.col("text"))).withColumn("_l", lines)
    return (
        with_words.withColumn("n_words", F.size(w).cast("bigint"))
        .withColumn("word_chars", F.length(F.array_join(w, "")).cast("bigint"))
        .withColumn("n_symbols", F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint"))
        .withColumn(
            "n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint")
        )
        .withColumn("_win", window_hashes(w))
        .withColumn("_sorted", F.sort_array("_win"))
        .withColumn(
            "_rep",
            F.array_distinct(
                F.filter("_sorted", lambda x, i: (i > 0) & (x == F.get("_sorted", F.greatest(i - 1, F.lit(0)))))
            ),
        )
        .withColumn("n_repeat_words", repeated_words(F.col("_win"), F.col("_rep")))
        .drop("_l", "_win", "_sorted", "_rep")
    )


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids that every label calls good and none calls toxic."""
    return (
        labels.filter(F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
        .filter((F.col("q") == 1) & (F.col("t") == 0))
        .select("doc_id")
    )


def _fold(text: Column, cfg: QualityConfig) -> Column:
    """The fold of a text; equal texts share it."""
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 4), 16, 10).cast("int") % cfg.folds).cast("int")


def distinct_texts(docs: DataFrame, target: DataFrame) -> DataFrame:
    """(text, _t) with every text once; ``_t`` is 1 if any of its rows is trusted.

    Only texts' digests are shuffled: of several copies the one with the least id stays,
    found by a join with the digests that stand more than once. Rows that repeat an id
    and its text are the one case in which texts themselves are grouped.
    """
    keyed = docs.select("doc_id", "text", F.md5(F.col("text").cast("binary")).alias("_d")).filter("text is not null")
    seen = keyed.select("_d", "doc_id").join(target, "doc_id", "left").groupBy("_d", "doc_id").agg(F.count(F.lit(1)).alias("m"), F.max("_t").alias("t"))
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id")))["doc_id"]
    many = seen.groupBy("_d").agg(F.sum("m").alias("n"), F.max("m").alias("m"), F.max("t").alias("t"), first.alias("rep")).filter("n > 1")
    many = checkpoint(many)
    marked = keyed.join(small_or_shuffled(many), "_d", "left").filter(F.col("n").isNull() | F.col("doc_id").eqNullSafe(F.col("rep")))
    out = marked.filter("m IS NULL OR m = 1").join(target, "doc_id", "left").select("text", F.coalesce("t", "_t").alias("_t"))
    if many.filter("m > 1").limit(1).count():
        again = marked.filter("m > 1").groupBy("text").agg(F.max("t").alias("_t"))
        out = out.unionByName(again)
    return out


def ratio_weights(docs: DataFrame, target: DataFrame, cfg: QualityConfig) -> list[int]:
    """Per fold and bucket the log ratio of the two multinomials, in units of 1/scale.

    Counts cover every n-gram of every distinct text, so that the number of its copies
    has no part in any score; a text is trusted if any copy is, and the target of a fold
    is the trusted texts of all others. Only ``buckets`` rows reach the driver.
    """
    in_fold = [F.count(F.when(F.col("_f") == k, F.col("_t"))).alias(f"t{k}") for k in range(cfg.folds)]
    counts = (
        distinct_texts(docs, target)
        .select("_t", _fold(F.col("text"), cfg).alias("_f"), word_crcs(words(F.col("text"))).alias("_c"))
        # an outer explode: the planner would else infer a filter that makes all grams twice
        .select("_t", "_f", F.explode_outer(_grams(F.col("_c"), cfg)).alias("b"))
        .filter("b is not null")
        .groupBy("b")
        .agg(F.count(F.lit(1)).alias("raw"), *in_fold)
    )
    rows = counts.collect()  # at most cfg.buckets rows
    by = {r["b"]: (r["raw"], [r[f"t{k}"] for k in range(cfg.folds)]) for r in rows}
    raw_n = sum(raw for raw, _ in by.values())
    flat = cfg.alpha * cfg.buckets
    empty = (0, [0] * cfg.folds)
    out = []
    for k in range(cfg.folds):
        tgt_n = sum(sum(t) - t[k] for _, t in by.values())
        for b in range(cfg.buckets):
            raw, t = by.get(b, empty)
            p = (sum(t) - t[k] + cfg.alpha) / (tgt_n + flat)
            q = (raw + cfg.alpha) / (raw_n + flat)
            out.append(round(cfg.scale * math.log(p / q)) if tgt_n else 0)
    return out


def _adding(table: Column):
    return lambda a, b: a + F.get(table, b)


def _score(crc: Column, fold: Column, n: Column, weights: list[int], cfg: QualityConfig) -> Column:
    """The mean weight of the n-grams of a text with ``n`` words."""
    grams, total = _grams(crc, cfg), None
    # a table per fold: an index that held the fold would be worked out anew for each n-gram
    for k in range(cfg.folds):
        own = ",".join(map(str, weights[k * cfg.buckets : (k + 1) * cfg.buckets]))
        table = F.split(F.lit(own), ",").cast("array<bigint>")
        part = F.aggregate(grams, F.lit(0).cast("bigint"), _adding(table))
        total = F.when(fold == k, part) if total is None else total.when(fold == k, part)
    return total / (F.greatest(2 * n - 1, F.lit(1)) * cfg.scale)


def threshold(docs: DataFrame, target: DataFrame, weights: list[int], cfg: QualityConfig) -> float | None:
    """The least accepted score, from the scores of all trusted documents of 50 words or
    more; None if there are none. Their histogram has a bounded number of bars."""
    trusted = docs.select("doc_id", "text").join(target, "doc_id", "left_semi")
    own = trusted.select(_fold(F.col("text"), cfg).alias("_f"), words(F.col("text")).alias("_w")).filter(F.size("_w") >= 50)
    own = own.select("_f", F.size("_w").cast("bigint").alias("n"), word_crcs(F.col("_w")).alias("_c"))
    score = _score(F.col("_c"), F.col("_f"), F.col("n"), weights, cfg)
    bars = own.select(F.floor(score * round(1 / cfg.grain)).cast("int").alias("bar")).groupBy("bar").count().orderBy("bar").collect()
    total, upto, found = sum(r["count"] for r in bars), 0, {}
    for r in bars:
        upto += r["count"]
        for q in (cfg.low, 0.5):
            if q not in found and upto >= q * total:
                found[q] = r["bar"]
    if not bars:
        return None
    return (found[cfg.low] - cfg.spread * (found[0.5] - found[cfg.low])) * cfg.grain


def score_quality(
    docs: DataFrame, labels: DataFrame, cfg: QualityConfig | None = None
) -> DataFrame:
    """All columns of ``docs`` plus base counts, ``score``, ``base_failed`` and ``kept``.

    Null or blank text: no words, score 0, base_failed. Without trusted documents every
    weight is 0 and the base rules alone decide. Repeated rows score alike, null ids are
    trusted by no label, texts of any length count whole, and an empty table gives no
    rows. Columns of ``docs`` named like a result are replaced.
    """
    cfg = cfg or QualityConfig()
    target = small_or_shuffled(trusted_ids(labels).withColumn("_t", F.lit(1)))
    pairs = docs.select("doc_id", "text")
    weights = ratio_weights(pairs, target, cfg)
    least = threshold(pairs, target, weights, cfg)
    # the row travels as one value, so that none of its names meets a name used here
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    feats = base_features(docs.select(row, F.col("text"))).withColumn("_c", word_crcs(F.col("_w")))
    n = F.col("n_words")
    failed = (n < 50) | (100 * F.col("n_repeat_words") > 50 * n)
    fold = _fold(F.coalesce(F.col("text"), F.lit("")), cfg)
    scored = feats.withColumn("score", _score(F.col("_c"), fold, n, weights, cfg)).withColumn("base_failed", failed)
    good = F.lit(True) if least is None else F.col("score") >= least
    scored = scored.withColumn("kept", ~failed & good)
    # the results leave through a generator: a filter on them is not pushed below it, where
    # it would be rewritten over the raw text and make every array again and again
    out = F.inline_outer(F.array(F.struct(*RESULTS)))
    return scored.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in RESULTS], out)


def op2_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    return score_quality(docs, labels).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "score",
    )


_CFG = QualityConfig()

#: The same rules in SQL; crc32 comes from its table, built by the polynomial's rule.
ORACLE = f"""
WITH RECURSIVE tab AS (
  SELECT x, CAST(x AS BIGINT) AS c, 0 AS k FROM range(256) r(x)
  UNION ALL SELECT x, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM tab WHERE k < 8),
t AS (SELECT list(c ORDER BY x) AS t FROM tab WHERE k = 8),
d AS (SELECT doc_id, text IS NULL AS none, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
  CAST('0x' || substr(md5(coalesce(text, '')), 1, 4) AS BIGINT) % {_CFG.folds} AS f FROM documents),
v AS (SELECT DISTINCT unnest(w) AS word FROM d),
vc AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, strlen(word)), lambda i: CAST('0x' || substr(hex(encode(word)), 2 * i + 1, 2) AS BIGINT))),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS crc FROM v, t),
p AS (SELECT d.doc_id, i, word, crc FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d) d JOIN vc USING (word)),
g AS (
  SELECT doc_id, crc % {_CFG.buckets} AS b FROM p
  UNION ALL SELECT x.doc_id, (x.crc * 31 + y.crc) % {_CFG.buckets} FROM p x JOIN p y ON y.doc_id = x.doc_id AND y.i = x.i + 1),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1 AND max(toxic) = 0),
one AS (SELECT min(d.doc_id) AS doc_id, any_value(f) AS f, count(good.doc_id) > 0 AS t FROM d LEFT JOIN good USING (doc_id) WHERE NOT none GROUP BY text),
c AS (SELECT b, count(*) AS r, {", ".join(f"count(*) FILTER (WHERE t AND f <> {k}) AS t{k}" for k in range(_CFG.folds))} FROM g JOIN one USING (doc_id) GROUP BY b),
u AS (SELECT b, r, unnest([{", ".join(f"t{k}" for k in range(_CFG.folds))}]) AS t, unnest(range({_CFG.folds})) AS f FROM c),
n AS (SELECT f, sum(r) AS r, sum(t) AS t FROM u GROUP BY f),
wt AS (SELECT f, b, CASE WHEN n.t = 0 THEN 0 ELSE CAST(round({_CFG.scale} * ln(((u.t + 1.0::DOUBLE) / (n.t + {_CFG.buckets}.0::DOUBLE)) / ((u.r + 1.0::DOUBLE) / (n.r + {_CFG.buckets}.0::DOUBLE)))) AS BIGINT) END AS w FROM u JOIN n USING (f)),
s AS (SELECT g.doc_id, CAST(sum(wt.w) AS BIGINT) AS total FROM g JOIN d USING (doc_id) JOIN wt ON wt.b = g.b AND wt.f = d.f GROUP BY g.doc_id),
sc AS (SELECT d.doc_id, coalesce(total, 0) / (greatest(2 * len(w) - 1, 1) * {_CFG.scale}) AS score, len(w) AS n FROM d LEFT JOIN s USING (doc_id)),
bar AS (SELECT CAST(floor(score * {round(1 / _CFG.grain)}) AS BIGINT) AS bar, count(*) AS k FROM sc JOIN good USING (doc_id) WHERE n >= 50 GROUP BY 1),
cum AS (SELECT bar, sum(k) OVER (ORDER BY bar) AS upto, sum(k) OVER () AS total FROM bar),
th AS (SELECT min(bar) FILTER (WHERE upto >= {_CFG.low}::DOUBLE * total) AS low, min(bar) FILTER (WHERE upto >= 0.5::DOUBLE * total) AS mid FROM cum),
win AS (SELECT x.doc_id, x.i, count(*) OVER (PARTITION BY x.doc_id, x.word, y.word, z.word) AS n
  FROM p x JOIN p y ON y.doc_id = x.doc_id AND y.i = x.i + 1 JOIN p z ON z.doc_id = x.doc_id AND z.i = x.i + 2),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM win, range(3) r(k) WHERE win.n > 1 GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
f AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, coalesce(ln.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
    sc.score
  FROM d LEFT JOIN ln USING (doc_id) LEFT JOIN rep USING (doc_id) JOIN sc USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND coalesce(score >= (low - {_CFG.spread}::DOUBLE * (mid - low)) * {_CFG.grain}::DOUBLE, true) AS kept, score FROM f, th
"""

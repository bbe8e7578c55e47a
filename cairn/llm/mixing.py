"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.session import checkpoint, small_or_shuffled

#: Bins of a source's ranking scale; the bin that holds the cut is ordered exactly.
BINS = 4096
#: Bins of a coarse one.
COARSE = 64
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(
    sizes: DataFrame, weights: Sequence[float], share: float, most: float
) -> DataFrame:
    """Per source (source, source_size): its rank by code point (null last) and target.

    ``share`` times all sizes is dealt by weight; a target stops at ``most`` times its
    source's size and the excess is dealt again by weight. That is water-filling: with
    sources in order of cap over weight, the level is the first that the rest of the
    amount supports, so one pass of running sums replaces the rounds. The table has one
    row per source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    dealt = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("_i", F.row_number().over(by_name)).withColumn(
        "weight", F.get(dealt, (F.col("_i") - 1) % len(weights))
    )
    cap = F.col("source_size") * F.lit(float(most))
    caps = ranked.withColumn("_cap", cap).withColumn("_r", F.col("_cap") / F.col("weight"))
    order = Window.orderBy("_r", "_i")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    level = (F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    run = caps.withColumn("_level", level)
    # the first sustainable level, from which on levels only fall, is the largest of them;
    # sources before it are capped
    top = F.max(F.when(F.col("_level") <= F.col("_r"), F.col("_level"))).over(every)
    return (
        run.withColumn("_top", top)
        .withColumn(
            "target",
            F.when(F.col("_top").isNull(), F.col("_cap")).otherwise(
                F.least(F.col("_cap"), F.col("_top") * F.col("weight"))
            ),
        )
        .select("source", "source_size", "weight", "target")
    )


def uniform(key: Column, seed: int) -> Column:
    """A uniform number in (0, 1) that depends only on ``key`` and ``seed``."""
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), key).cast("binary")), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(2**48)


def appeal(size: Column) -> Column:
    """What a document's expected copies are in proportion to: the fourth root of its
    words, so that a text of 800 words is wanted twice as much as one of 50."""
    return F.sqrt(F.sqrt(size.cast("double")))


def inclusion_rates(narrow: DataFrame, targets: DataFrame, most: float) -> DataFrame:
    """Per source its ``level``: a document's expected copies are level * appeal, at most
    ``most`` (level null: all have ``most``), and their words add up to the target.

    Water-filling again, over the distinct sizes of a source, which are far fewer than its
    documents: of sizes in descending order those before the first sustainable level are
    capped. ``due`` is what the certain whole copies leave of the target.
    """
    same = (
        narrow.filter("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("_x", appeal(F.col("size"))).withColumn("_words", F.col("size") * F.col("n"))
    )
    t, g = targets.alias("t"), same.alias("g")
    each = t.join(g, F.col("t.source").eqNullSafe(F.col("g.source")), "left").select("t.*", "size", "_x", "_words")
    each = each.withColumn("_cap", F.lit(float(most)) * F.col("_words")).withColumn("_r", F.lit(float(most)) / F.col("_x"))
    order = Window.partitionBy("source").orderBy(F.col("size").desc())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("target") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum(F.col("_x") * F.col("_words")).over(onward)
    run = each.withColumn("_level", level)
    top = F.max(F.when(F.col("_level") <= F.col("_r"), F.col("_level"))).over(Window.partitionBy("source"))
    rate = F.when(F.col("size").isNull(), F.lit(0.0)).otherwise(
        F.least(F.coalesce(F.col("level") * F.col("_x"), F.lit(float(most))), F.lit(float(most)))
    )
    whole = F.floor(rate + 1e-12) * F.coalesce("_words", F.lit(0))
    return (
        run.withColumn("level", top).groupBy("source", "source_size", "target", "level")
        .agg(F.greatest(F.col("target") - F.sum(whole), F.lit(0.0)).alias("due"))
    )


RESULTS = ("size", "source_size", "target", "copies", "taken")


def pareto_mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 17,
) -> DataFrame:
    """All columns of ``docs`` plus size, source_size, target, copies and taken.

    Documents of a source have unequal expected copies, in proportion to their
    :func:`appeal` and at most ``most``, whose words add up to the source's target. The
    whole part is given for certain. The fraction left is the inclusion probability p;
    with u uniform, documents rank by the random odds u / (1 - u) over the inclusion odds
    p / (1 - p), and the lowest are drawn until the words still due are filled; the
    document at the cut is drawn if that ends nearer. Size is the number of words (null
    text: 0), and a sample is fixed in words, so sources come within half a document of
    their targets.

    A source is never sorted as a whole: its ranking scale is cut into ``BINS`` bins,
    whose sums are formed before the shuffle, and only the bin with the cut is ordered.
    Rows of equal id and text tie and are interchangeable. Null ids and sources are
    ordinary values; texts without words, however many, are never drawn, and sources
    without words get target 0; an empty table gives no rows. Texts of any length are
    counted whole. Columns of ``docs`` named like a result are replaced.
    """
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("bigint").alias("size")
    u = uniform(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), seed).alias("u")
    key = [F.col("source"), size, u, F.xxhash64("doc_id", "text").alias("h")]
    narrow = checkpoint(docs.select(*key))
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = checkpoint(inclusion_rates(narrow, source_targets(sizes, weights, share, most), most))
    plan = small_or_shuffled(plan)

    def ranked(rows: DataFrame) -> DataFrame:
        """``rows`` with their whole copies, and p, rank q and its bin."""
        both = rows.alias("n").join(plan.alias("p"), F.col("n.source").eqNullSafe(F.col("p.source")), "left").drop(F.col("p.source"))
        wanted = F.least(F.coalesce(F.col("level") * appeal(F.col("size")), F.lit(float(most))), F.lit(float(most)))
        rate = F.when(F.col("size") > 0, wanted).otherwise(0.0)
        odds, incl = F.col("u") / (1 - F.col("u")), F.col("p") / (1 - F.col("p"))
        # v maps the rank to (0, 1) in the same order
        return (
            both.withColumn("whole", F.floor(rate + 1e-12).cast("int"))
            .withColumn("p", F.greatest(rate - F.col("whole"), F.lit(0.0)))
            .withColumn("q", F.when(F.col("p") > 0, odds / incl))
            .withColumn("bin", F.least(F.floor(F.col("q") / (1 + F.col("q")) * BINS), F.lit(BINS - 1)).cast("int"))
        )

    # the bin with the cut: among coarse bins first, then among the bins of that one, so that
    # no task orders more than a few dozen sums of a source
    bins = ranked(narrow).filter("p > 0").groupBy("source", "bin", "due").agg(F.sum("size").alias("s"))
    bins = checkpoint(bins.withColumn("coarse", F.floor(F.col("bin") / COARSE)))

    def cutting(sums: DataFrame, by: str) -> DataFrame:
        """(source, ``by``, before) of the first entry that passes what is due."""
        upto = Window.partitionBy("source").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        return (
            sums.withColumn("before", F.col("base") + F.coalesce(F.sum("s").over(upto), F.lit(0)))
            .filter((F.col("before") <= F.col("due")) & (F.col("before") + F.col("s") > F.col("due")))
            .groupBy("source").agg(F.min_by(F.struct(by, "before"), F.col(by)).alias("c")).select("source", "c.*")
        )

    whole = bins.groupBy("source", "coarse", "due").agg(F.sum("s").alias("s")).withColumn("base", F.lit(0).cast("bigint"))
    first = cutting(whole, "coarse").alias("c")
    within = (F.col("b.source").eqNullSafe(F.col("c.source"))) & (F.col("b.coarse") == F.col("c.coarse"))
    fine = bins.alias("b").join(first, within).select("b.source", "b.bin", "b.due", "b.s", F.col("c.before").alias("base"))
    cut = cutting(fine, "bin").select("source", F.col("bin").alias("cut_bin"), F.col("before").alias("cut_before"))
    # inside the cutting bin: exact order, least rank first
    inside = Window.partitionBy("source").orderBy("q", "u", "h", "size")
    so_far = inside.rowsBetween(Window.unboundedPreceding, -1)
    c = small_or_shuffled(checkpoint(cut))
    on_cut = F.col("n.source").eqNullSafe(F.col("c.source")) & (F.col("n.bin") == F.col("c.cut_bin"))
    at_cut = (
        ranked(narrow).filter("p > 0").alias("n").join(c.alias("c"), on_cut)
        .select("n.*", "c.cut_before")
        .withColumn("b", F.col("cut_before") + F.coalesce(F.sum("size").over(so_far), F.lit(0)))
        .filter((F.col("b") <= F.col("due")) & (F.col("b") + F.col("size") > F.col("due")))
        # the document that crosses the line: in if that leaves less of an error
        .withColumn("inn", (F.col("b") + F.col("size") - F.col("due")) < (F.col("due") - F.col("b")))
        .groupBy("source")
        .agg(F.min_by(F.struct("q", "h", "inn"), F.col("q")).alias("edge"))
    )
    edge = small_or_shuffled(checkpoint(at_cut)).alias("e")
    # the row travels as one value, so that none of its names meets a name used here
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *key)
    final = ranked(rows).alias("f").join(edge, F.col("f.source").eqNullSafe(F.col("e.source")), "left").select("f.*", "e.edge")
    e = F.col("edge")
    before_cut = (F.col("q") < e["q"]) | ((F.col("q") == e["q"]) & ((F.col("h") < e["h"]) | ((F.col("h") == e["h"]) & e["inn"])))
    drawn = (F.col("p") > 0) & F.coalesce(before_cut, F.lit(True))
    final = final.withColumn("copies", F.col("whole") + drawn.cast("int"))
    return final.select(
        *[F.col("row")[c].alias(c) for c in docs.columns if c not in RESULTS],
        "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("bigint").alias("taken"),
    )


def op9_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return pareto_mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


ORACLE = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         (CAST('0x' || substr(md5('17|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT) + 0.5::DOUBLE)
           / 281474976710656.0::DOUBLE AS u FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS i FROM s),
c AS (SELECT *, (CASE (i - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS weight,
             2.0::DOUBLE * source_size AS cap FROM w),
r AS (SELECT *, cap / weight AS r FROM c),
l AS (SELECT *, (1.5::DOUBLE * (SELECT CAST(sum(source_size) AS BIGINT) FROM s)
        - coalesce(sum(cap) OVER (ORDER BY r, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY r, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT source, source_size, CASE WHEN top IS NULL THEN cap ELSE least(cap, top * weight) END AS target
      FROM (SELECT *, max(CASE WHEN level <= r THEN level END) OVER () AS top FROM l)),
g AS (SELECT source, size, sqrt(sqrt(size::DOUBLE)) AS x, size * count(*) AS words FROM d WHERE size > 0 GROUP BY source, size),
y AS (SELECT t.*, g.size, x, words, 2.0::DOUBLE * words AS cap, 2.0::DOUBLE / x AS r FROM t JOIN g ON t.source IS NOT DISTINCT FROM g.source),
z AS (SELECT *, (target - coalesce(sum(cap) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(x * words) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM y),
h AS (SELECT source, size, least(coalesce(max(CASE WHEN level <= r THEN level END) OVER (PARTITION BY source) * x, 2.0::DOUBLE), 2.0::DOUBLE) AS rate FROM z),
p AS (SELECT d.doc_id, d.source, d.size, d.u, t.source_size, t.target, coalesce(rate, 0) AS rate, CAST(floor(coalesce(rate, 0) + 1e-12) AS INTEGER) AS whole
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN h ON d.source IS NOT DISTINCT FROM h.source AND d.size = h.size),
q AS (SELECT *, greatest(rate - whole, 0) AS p, greatest(target - sum(whole * size) OVER (PARTITION BY source), 0) AS due FROM p),
o AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY u / (1 - u) / (p / (1 - p)), u, doc_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM q WHERE p > 0),
x AS (SELECT q.*, whole + CASE WHEN q.p <= 0 THEN 0 WHEN b + q.size <= q.due THEN 1
        WHEN b <= q.due AND (b + q.size - q.due) < (q.due - b) THEN 1 ELSE 0 END AS copies
      FROM q LEFT JOIN (SELECT doc_id, b FROM o) USING (doc_id))
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(copies * size AS BIGINT) AS taken,
       CAST(copies AS INTEGER) AS copies FROM x
"""

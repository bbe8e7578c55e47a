"""Catalog tables derived from the generic test tables.

There is no package store here, so documents stand for store paths: a line is a chunk, a
source is a build root's owner, and two arithmetic references per document make a graph
with cycles, a self-loop and holes. ``NOW`` is always a parameter of the operators; the
queries use the one fixed here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NOW = 1706659200
DAY = 86400
PACK_BYTES = 20_000
HOLE = 10_000_000
#: Documents of a source that one task puts in order.
RANGE = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def path_of(doc_id) -> F.Column:
    """The 32-character key of a document's path."""
    return F.substring(F.sha2(F.concat(F.lit("doc-"), doc_id.cast("string")), 256), 1, 32)


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    i = F.col("doc_id")
    return d.select(
        "doc_id",
        path_of(i).alias("path"),
        F.sha2("text", 256).alias("nar_hash"),
        F.octet_length("text").cast("bigint").alias("nar_size"),
        (NOW - (i % 40) * DAY).alias("last_pushed"),
        (NOW - (i % 10) * DAY).alias("last_reachable"),
    )


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path keys alone, without a look at the texts."""
    return table(spark, sf_dir, "documents").select("doc_id", path_of(F.col("doc_id")).alias("path"))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges (src, dst); some destinations are in no catalog."""
    i = F.col("doc_id")
    ids = table(spark, sf_dir, "documents").select("doc_id")
    targets = F.array(F.floor(i / 3), F.floor(i / 5) + 1, F.when(i % 10 == 0, i + HOLE))
    return (
        ids.select("doc_id", F.explode(targets).alias("to"))
        .filter("to is not null")
        .select(path_of(i).alias("src"), path_of(F.col("to")).alias("dst"))
        .distinct()
    )


def file_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, lang, path, pos, chunk, size, data): non-empty lines in order."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    lines = d.select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("pos", "data"))
    return lines.filter(F.octet_length("data") > 0).select(
        "doc_id", "source", "lang", path_of(F.col("doc_id")).alias("path"),
        F.col("pos").cast("bigint").alias("pos"),
        F.substring(F.sha2("data", 256), 1, 32).alias("chunk"),
        F.octet_length("data").cast("bigint").alias("size"),
        "data",
    )


def first_seen(file_chunks: DataFrame) -> DataFrame:
    """One row per chunk, at its first place in (doc_id, pos) order."""
    at = F.struct("doc_id", "pos", "source", "size")
    return file_chunks.groupBy("chunk").agg(F.min(at).alias("f")).select("chunk", "f.*")


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunks: chunk, pack, offset, csize, usize, survived (and k, the pack's number)."""
    first = first_seen(file_chunks(spark, sf_dir).drop("data"))
    # a source is summed by ranges of documents first, so that no task orders all of it
    ranged = first.withColumn("_r", F.floor(F.col("doc_id") / RANGE))
    sums = ranged.groupBy("source", "_r").agg(F.sum("size").alias("_n"))
    upto = Window.partitionBy("source").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("source", "_r", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_base"))
    order = Window.partitionBy("source", "_r").orderBy("doc_id", "pos")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    run = ranged.join(base, ["source", "_r"]).withColumn("_at", F.col("_base") + before)
    packed = run.withColumn("k", F.floor(F.col("_at") / PACK_BYTES))
    start = F.min("_at").over(Window.partitionBy("source", "k"))
    return packed.select(
        "chunk",
        F.sha2(F.concat_ws("-", "source", F.col("k").cast("string")), 256).alias("pack"),
        (F.col("_at") - start).alias("offset"),
        F.col("size").alias("csize"),
        (2 * F.col("size")).alias("usize"),
        (F.col("doc_id") % 3).alias("survived"),
        "k",
    )


def packs(locations: DataFrame) -> DataFrame:
    """packs: pack, size, created, tier (and k)."""
    k = F.col("k")
    return locations.groupBy("pack", "k").agg(F.sum("csize").alias("size")).select(
        "pack", "size",
        F.when(k % 6 == 5, F.lit(NOW - 60)).otherwise(NOW - (k * 5) % 30 * DAY - 7200).alias("created"),
        F.when(k % 4 == 0, 0).otherwise(1).alias("tier"),
        "k",
    )


def root_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(root_key, path, updated, run_id), one row per member."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").filter("doc_id % 7 = 0")
    number = F.substring("source", 4, 9).cast("bigint")
    return d.select(
        F.concat_ws("-", "source", "lang").alias("root_key"),
        path_of(F.col("doc_id")).alias("path"),
        (NOW - number * DAY).alias("updated"),
        F.concat(F.lit("run-"), (F.col("doc_id") % 3).cast("string")).alias("run_id"),
    )


def observations(spark: SparkSession, sf_dir: str, packs: DataFrame) -> DataFrame:
    """Listing rows (key, created, last_accessed): some packs are gone, some listed twice,
    some clocks unknown (0), and some keys belong to no catalog."""
    k = F.col("k")
    seen = packs.filter(k % 9 != 4).select(
        F.concat(F.lit("pack-"), "pack").alias("key"), "created",
        F.when(k % 5 == 0, F.lit(0)).otherwise(NOW - k % 8 * DAY).alias("last_accessed"),
    )
    twice = packs.filter((k % 9 != 4) & (k % 3 == 0)).select(
        F.concat(F.lit("pack-"), "pack").alias("key"), "created", F.lit(NOW - 6 * DAY).alias("last_accessed")
    )
    n = F.col("p_partkey")
    foreign = table(spark, sf_dir, "part").select(
        F.when(n % 4 == 0, F.concat(F.lit("pack-"), n.cast("string")))
        .otherwise(F.concat(F.lit("pack-"), F.sha2(F.concat(F.lit("orphan-"), n.cast("string")), 256)))
        .alias("key"),
        (NOW - n % 3 * DAY).alias("created"),
        F.when(n % 5 == 0, F.lit(NOW - 60)).otherwise(NOW - n % 9 * DAY).alias("last_accessed"),
    )
    return seen.union(twice).union(foreign)

"""Analytic reports over the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedup_ratio(file_chunks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Chunks, distinct chunks and their bytes, overall or per group.

    One aggregation per chunk forms both counts, so the bytes move once.
    """
    by = by or []
    per = file_chunks.groupBy(*by, "chunk").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size"))
    return per.groupBy(*by).agg(
        F.sum("n").alias("chunks"), F.count(F.lit(1)).alias("unique_chunks"),
        F.sum(F.col("n") * F.col("size")).alias("bytes"), F.sum("size").alias("unique_bytes"),
    )


def new_bytes_per_generation(file_chunks: DataFrame, generation: str) -> DataFrame:
    """What each generation adds: chunks first seen in it, and their bytes."""
    first = file_chunks.groupBy("chunk").agg(F.min(generation).alias(generation), F.first("size").alias("size"))
    return first.groupBy(generation).agg(F.count(F.lit(1)).alias("new_chunks"), F.sum("size").alias("new_bytes"))


def last_generations(links: DataFrame, last: int) -> DataFrame:
    """(name, number) of the newest ``system-<n>-link`` names, in numeric order."""
    number = F.regexp_extract("name", r"^system-([0-9]+)-link$", 1)
    return links.select("name", F.when(number != "", number).try_cast("bigint").alias("number")).filter(
        "number is not null"
    ).orderBy(F.desc("number")).limit(last)


def layout_dump(file_chunks: DataFrame, locations: DataFrame, refs: DataFrame, members: DataFrame) -> DataFrame:
    """Per path: its chunk places in order (unknown places dropped, repeats kept), and its
    references inside the catalog other than itself."""
    placed = file_chunks.select("path", "pos", "chunk").join(locations.select("chunk", "pack", "offset"), "chunk")
    item = F.struct("pos", F.concat(F.substring("pack", 1, 8), F.lit("@"), F.col("offset").cast("string")).alias("at"))
    chunks = placed.groupBy("path").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["at"]), " ").alias("layout")
    )
    inside = refs.filter("src <> dst").join(members.select(F.col("path").alias("dst")), "dst", "left_semi")
    named = inside.groupBy(F.col("src").alias("path")).agg(F.array_join(F.array_sort(F.collect_set("dst")), " ").alias("refs"))
    out = members.select("path").join(chunks, "path", "left").join(named, "path", "left")
    return out.select("path", F.coalesce("layout", F.lit("")).alias("layout"), F.coalesce("refs", F.lit("")).alias("refs"))


def versions_to_delete(listing: DataFrame, prefix: str, now: int, min_age: int) -> DataFrame:
    """Listed catalog versions older than the newest and than ``min_age``; rows with an
    unknown clock stay."""
    from cairn.functions.text import version_index

    rows = listing.withColumn("idx", version_index(F.col("key"), prefix)).filter("idx is not null")
    newest = rows.crossJoin(F.broadcast(rows.agg(F.max("idx").alias("_top"))))
    old = (F.col("created") > 0) & (F.greatest(now - F.col("created"), F.lit(0)) > min_age)
    return newest.filter((F.col("idx") < F.col("_top")) & old).select("key", "idx")

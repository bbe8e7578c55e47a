"""Streaming ingest: requests from files, batches into a versioned catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.sources.store import VersionStore

REQUEST = "op string, paths array<string>"


def requests(lines: DataFrame) -> DataFrame:
    """JSON lines ``{"op": ..., "paths": [...]}`` as (op, path); bad lines have no op."""
    parsed = lines.select(F.from_json("value", REQUEST).alias("r"))
    return parsed.select("r.op", F.explode_outer("r.paths").alias("path"))


def replies(log: DataFrame) -> DataFrame:
    """``log`` (queue, seq, op, path; a row per added path) with the answer to each status
    and drain request: (queue, seq, op, buffered), the distinct paths added since the drain
    before it. A drain empties the buffer, whatever its batch then does.
    """
    order = Window.partitionBy("queue").orderBy("seq")
    before = order.rangeBetween(Window.unboundedPreceding, -1)
    # an epoch ends with its drain
    epochs = log.withColumn("_e", F.coalesce(F.sum((F.col("op") == "drain").cast("int")).over(before), F.lit(0)))
    first = Window.partitionBy("queue", "_e", "path").orderBy("seq", "op")
    new = (F.col("op") == "add") & F.col("path").isNotNull() & (F.row_number().over(first) == 1)
    marked = epochs.withColumn("_new", new.cast("int"))
    so_far = Window.partitionBy("queue", "_e").orderBy("seq").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    counted = marked.withColumn("buffered", F.sum("_new").over(so_far).cast("bigint"))
    return counted.filter(F.col("op").isin("status", "drain")).select("queue", "seq", "op", "buffered")


def drain(spark: SparkSession, source: DataFrame, store: VersionStore, checkpoint: str, now: int) -> int:
    """Runs all available requests of a streaming ``source`` into ``store``.

    Each micro-batch merges its added paths: the merge is idempotent and keyed, so a batch
    that is delivered twice changes nothing, and one that fails stays in the source.
    Returns the newest version. A store that cannot be written is left as it is, and so is
    the source.
    """
    if not store.writable():
        return store.newest()

    def commit(batch: DataFrame, _: int) -> None:
        added = (
            requests(batch).filter("op = 'add' AND path IS NOT NULL").select("path").distinct()
            .withColumn("last_pushed", F.lit(now))
        )

        def merge(current):
            have = current.get("paths")
            new = added if have is None else added.join(have, "path", "left_anti")
            if new.limit(1).count() == 0:
                return None
            return {"paths": new if have is None else have.unionByName(new)}

        store.save(merge)

    query = (
        source.writeStream.foreachBatch(commit)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return store.newest()


def access_sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    """(path, window, n) of runs of accesses with pauses up to ``gap``; the event-time form
    of stopping after idleness. ``events``: path, ts; rows later than ``late`` are dropped."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap), "path")
        .agg(F.count(F.lit(1)).alias("n"))
    )

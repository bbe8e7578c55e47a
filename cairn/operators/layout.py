"""Pack layout, location encoding and read planning."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PACK_TARGET = 64 << 20
GAP = 128 << 10
AHEAD = 4 << 20
EXPORT_WINDOW = 32 << 20


def _before(part: list[str], *order: str):
    return Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def folded(rows: DataFrame, part: str, order: list[str], out: str, start: Callable[[], Callable]) -> DataFrame:
    """``rows`` with columns ``out`` of a sequential fold over each ``part`` in ``order``.

    Rows are dealt by ``part``, sorted and streamed: ``start`` makes the step of a new part,
    a function of a row's ``size`` that returns the new values and keeps its own state, so
    a task holds one batch and one state however long a part is.
    """
    names = [c.split()[0] for c in out.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, step = None, None
        for batch in batches:
            made = []
            for key, size in zip(batch.column(part).to_pylist(), batch.column("size").to_pylist(), strict=True):
                if step is None or key != now:
                    now, step = key, start()
                made.append(step(size))
            cols = list(zip(*made, strict=True)) if made else [()] * len(names)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, pa.int64()) for c in cols]], [*batch.schema.names, *names])

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", " + out
    return rows.repartition(part).sortWithinPartitions(part, *order).mapInArrow(run, schema)


def greedy_packs(chunks: DataFrame, part: str, order: list[str], target: int = PACK_TARGET) -> DataFrame:
    """``chunks`` with pack_no and offset: a pack is sealed once an append reaches ``target``.

    Greedy sealing is a fold, sequential per builder; ``part`` names the builder, and
    only its narrow rows (order, size) are streamed through it.
    """

    def start():
        no = at = 0

        def step(size):
            nonlocal no, at
            placed = no, at
            at += size
            if at >= target:
                no, at = no + 1, 0
            return placed

        return step

    return folded(chunks.select("chunk", part, *order, "size"), part, order, "pack_no bigint, offset bigint", start)


def export_windows(items: DataFrame, part: str, order: list[str], most: int = EXPORT_WINDOW) -> DataFrame:
    """``items`` with window: closed before an item that would bring it over ``most``."""

    def start():
        no = total = held = 0

        def step(size):
            nonlocal no, total, held
            if held and total + size > most:
                no, total, held = no + 1, 0, 0
            total, held = total + size, held + 1
            return (no,)

        return step

    narrow = items.select(part, "path", *[c for c in order if c != "path"], "size")
    return folded(narrow, part, order, "window bigint", start)


def joined_blobs(rows: DataFrame, part: list[str], order: list[str], data: str) -> DataFrame:
    """(``part``, digest, size, blob): the ``data`` of each part put together in ``order``.

    Rows are dealt by part, sorted and streamed; a task holds one blob at a time.
    """
    cols = rows.select(*part, *order, data)
    kinds = [f"`{n}` {t}" for n, t in cols.dtypes[: len(part)]]

    def run(batches):
        def close(key, held):
            blob = b"".join(held)
            row = [*key, hashlib.sha256(blob).hexdigest(), len(blob), blob]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], [*part, "digest", "size", "blob"])

        now, held, types = None, [], []
        for batch in batches:
            types = [*[batch.schema.field(c).type for c in part], pa.string(), pa.int64(), pa.binary()]
            for *key, piece in zip(*(batch.column(c).to_pylist() for c in (*part, data)), strict=True):
                if key != now:
                    if now is not None:
                        yield close(now, held)
                    now, held = key, []
                held.append(piece)
        if now is not None:
            yield close(now, held)

    return cols.repartition(*part).sortWithinPartitions(*part, *order).mapInArrow(run, ", ".join(kinds) + ", digest string, size bigint, blob binary")


def wire_encode(locations: DataFrame) -> DataFrame:
    """(pack_index, delta, chunk, ...): dictionary-encoded packs, delta-encoded offsets."""
    by_pack = Window.partitionBy("pack").orderBy("offset", "chunk")
    # the dictionary holds one row per pack; its numbering is the only ordered pass
    names = locations.select("pack").distinct().withColumn(
        "pack_index", (F.row_number().over(Window.orderBy("pack")) - 1).cast("bigint")
    )
    delta = F.col("offset") - F.lag("offset", 1, 0).over(by_pack)
    return locations.withColumn("delta", delta).join(names, "pack").withColumn(
        "seq", (F.row_number().over(by_pack) - 1).cast("bigint")
    ).select("pack", "pack_index", "seq", "chunk", "delta", "csize")


def wire_decode(encoded: DataFrame) -> DataFrame:
    """Offsets back from deltas; a sum beyond 64 bits is an error, not a wrap."""
    run = Window.partitionBy("pack_index").orderBy("seq")
    total = F.sum(F.col("delta").cast("decimal(38,0)")).over(run)
    fits = total.between(0, 2**63 - 1)
    offset = F.when(fits, total.cast("bigint")).otherwise(F.raise_error(F.lit("offset overflow")))
    return encoded.select("pack", "chunk", offset.alias("offset"), "csize")


def pack_index(locations: DataFrame) -> DataFrame:
    """Per pack: number of spans, its sorted spans and the end of the last one."""
    span = F.struct("offset", "csize", "chunk")
    return locations.groupBy("pack").agg(
        F.count(F.lit(1)).alias("spans"),
        F.array_sort(F.collect_list(span)).alias("index"),
        F.max_by(F.col("offset") + F.col("csize"), span).alias("end"),
    )


def adjacent_runs(spans: DataFrame) -> DataFrame:
    """(pack, start, size, n): islands of exactly contiguous spans (pack, offset, csize)."""
    w = Window.partitionBy("pack").orderBy("offset", "csize")
    new = F.col("offset") != F.lag(F.col("offset") + F.col("csize")).over(w)
    run = spans.withColumn("_new", F.coalesce(new, F.lit(True)).cast("int")).withColumn(
        "_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    return run.groupBy("pack", "_run").agg(
        F.min("offset").alias("start"), F.sum("csize").alias("size"), F.count(F.lit(1)).alias("n")
    ).drop("_run")


def _islands(rows: DataFrame, start: Column, end: Column, slack: int) -> DataFrame:
    """(pack, start, end): ranges merged while the next begins within ``slack`` of the end."""
    rows = rows.select("pack", "pack_end", start.alias("start"), end.alias("end"))
    reach = F.max("end").over(_before(["pack"], "start", "end"))
    new = F.coalesce(F.col("start") > reach + slack, F.lit(True)).cast("int")
    w = Window.partitionBy("pack").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
        .groupBy("pack", "pack_end", "_run")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .drop("_run")
    )


def plan_pack_reads(spans: DataFrame, gap: int = GAP, ahead: int = AHEAD) -> DataFrame:
    """(pack, start, end) range reads for spans (pack, offset, csize, pack_end).

    Spans within ``gap`` join one run; a run reads ahead to ``ahead`` bytes but not
    beyond the pack; runs that then touch become one read.
    """
    runs = _islands(spans, F.col("offset"), F.col("offset") + F.col("csize"), gap)
    far = F.greatest("end", F.least(F.col("start") + ahead, F.col("pack_end")))
    return _islands(runs, F.col("start"), far, 0).drop("pack_end")


def chunks_in_reads(locations: DataFrame, reads: DataFrame) -> DataFrame:
    """Chunks that lie entirely inside a read of their pack.

    The pack is an equality key; the containment is a residual of it.
    """
    l, r = locations.alias("l"), reads.alias("r")  # noqa: E741
    inside = (F.col("l.offset") >= F.col("r.start")) & (F.col("l.offset") + F.col("l.csize") <= F.col("r.end"))
    return l.join(r, (F.col("l.pack") == F.col("r.pack")) & inside).select(
        "l.pack", "l.chunk", "l.offset", "l.csize", F.col("r.start").alias("read_start")
    )

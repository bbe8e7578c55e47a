"""Content-defined chunking, compression and extraction as Arrow-batched kernels."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.layout import greedy_packs, joined_blobs
from cairn.session import checkpoint

WINDOW = 64
HASH = 32  # hex digits of a chunk key


@dataclass(frozen=True)
class ChunkParams:
    """Least, average and greatest chunk size in bytes; input is cut at every segment end."""

    least: int = 64 << 10
    average: int = 256 << 10
    most: int = 1 << 20
    segment: int = 16 << 20


def _gear() -> np.ndarray:
    """256 fixed 64-bit values, from a rule: the head of the MD5 of 64 equal bytes."""
    return np.array([int.from_bytes(hashlib.md5(bytes([b]) * 64).digest()[:8], "big") for b in range(256)], dtype=np.uint64)


GEAR = _gear()


def _rolling(data: np.ndarray) -> np.ndarray:
    """At each byte the gear hash of the ``WINDOW`` bytes up to it, by doubling the width."""
    h = GEAR[data]
    width = 1
    while width < WINDOW:
        shifted = h.copy()
        shifted[width:] += h[:-width] << np.uint64(width)
        h, width = shifted, 2 * width
    return h


def _mask(bits: int) -> np.uint64:
    """``bits`` ones in the upper half, where a gear hash mixes most bytes."""
    return np.uint64(((1 << bits) - 1) << (64 - bits))


def boundaries(data: bytes, p: ChunkParams) -> list[int]:
    """End offsets of the chunks. Before the average size a cut needs more zero bits than
    after it, which narrows the sizes; a pure function of the content."""
    ends: list[int] = []
    bits = max(p.average.bit_length() - 1, 3)
    for base in range(0, len(data), p.segment):
        seg = np.frombuffer(data, dtype=np.uint8, offset=base, count=min(p.segment, len(data) - base))
        h = _rolling(seg)
        strict = np.flatnonzero((h & _mask(bits + 2)) == 0)
        loose = np.flatnonzero((h & _mask(bits - 2)) == 0)
        at = 0
        while at < len(seg):
            stop = min(at + p.most, len(seg))
            if len(seg) - at > p.least:
                i = np.searchsorted(strict, at + p.least)
                middle = min(at + p.average, stop)
                if i < len(strict) and strict[i] < middle:
                    stop = int(strict[i]) + 1
                else:
                    j = np.searchsorted(loose, max(middle, at + p.least))
                    if j < len(loose) and loose[j] < stop:
                        stop = int(loose[j]) + 1
            ends.append(base + stop)
            at = stop
    return ends


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()[:HASH]


def chunk_data(files: DataFrame, params: ChunkParams | None = None, keep_data: bool = True) -> DataFrame:
    """``files`` (path, data binary) -> (path, pos, offset, size, chunk[, data]).

    An empty file has no chunks. Each file is one task's work; chunks leave in batches.
    """
    p = params or ChunkParams()

    def run(batches):
        for batch in batches:
            rows = []
            for path, data in zip(batch.column("path").to_pylist(), batch.column("data").to_pylist(), strict=True):
                at = 0
                for pos, end in enumerate(boundaries(data or b"", p)):
                    part = data[at:end]
                    rows.append((path, pos, at, end - at, digest(part), part if keep_data else None))
                    at = end
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            names = ["path", "pos", "offset", "size", "chunk", "data"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    out = files.select("path", "data").mapInArrow(
        run, "path string, pos bigint, offset bigint, size bigint, chunk string, data binary"
    )
    return out if keep_data else out.drop("data")


def _swept(files: DataFrame, avg: int, generation: str, keep: bool) -> DataFrame:
    """Per chunk of one parameter set: n, size, g (the generation that first has it), data."""
    named = files.select(F.concat_ws("|", F.col(generation).cast("string"), "path").alias("path"), "data")
    cut = chunk_data(named, ChunkParams(avg // 4, avg, avg * 4), keep)
    rows = cut.withColumn("g", F.split_part("path", F.lit("|"), F.lit(1)).cast("bigint"))
    data = [F.first("data").alias("data")] if keep else []
    first = F.min(F.struct("g", "path", "pos")).alias("f")
    return rows.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size"), first, *data).select("chunk", "n", "size", "f.*", *(["data"] if keep else []))


#: Bytes of a location in a catalog: digest, offset step and size; and of a pack's name.
LOCATION_BYTES, PACK_BYTES = 28, 32


def sweep(files: DataFrame, averages: list[int], generation: str = "generation", target: int = 64 << 20) -> DataFrame:
    """Per average size: chunks, unique chunks, bytes, unique bytes, packed (compressed)
    bytes, packs, index bytes and new bytes of the last generation. ``files``: path, data,
    generation."""
    out = None
    for avg in averages:
        per = checkpoint(_swept(files, avg, generation, True))
        packed = checkpoint(compress(per).select("chunk", "csize"))
        order = packed.join(per.select("chunk", "path", "pos"), "chunk").select("chunk", F.lit(0).alias("builder"), "path", "pos", F.col("csize").alias("size"))
        packs = greedy_packs(order, "builder", ["path", "pos"], target).agg(F.coalesce(F.max("pack_no") + 1, F.lit(0)).alias("packs"))
        top = per.agg(F.max("g").alias("top"))
        sums = per.crossJoin(F.broadcast(top)).agg(
            F.lit(avg).alias("average"), F.sum("n").alias("chunks"), F.count(F.lit(1)).alias("unique_chunks"),
            F.sum(F.col("n") * F.col("size")).alias("bytes"), F.sum("size").alias("unique_bytes"),
            F.coalesce(F.sum(F.when(F.col("g") == F.col("top"), F.col("size"))), F.lit(0)).alias("last_new_bytes"),
        )
        one = sums.crossJoin(packed.agg(F.sum("csize").alias("packed_bytes"))).crossJoin(packs)  # one row each
        one = one.withColumn("index_bytes", F.col("unique_chunks") * LOCATION_BYTES + F.col("packs") * PACK_BYTES)
        out = one if out is None else out.union(one)
    return out


def sweep_generations(files: DataFrame, averages: list[int], generation: str = "generation") -> DataFrame:
    """(average, generation, new_chunks, new_bytes): what each generation adds."""
    out = None
    for avg in averages:
        one = _swept(files, avg, generation, False).groupBy(F.lit(avg).alias("average"), F.col("g").alias("generation")).agg(
            F.count(F.lit(1)).alias("new_chunks"), F.sum("size").alias("new_bytes")
        )
        out = one if out is None else out.union(one)
    return out


def compress(chunks: DataFrame, level: int = 3) -> DataFrame:
    """``chunks`` (chunk, size, data) -> (chunk, size, frame, csize), zstd per chunk."""

    def run(batches):
        import zstandard

        z = zstandard.ZstdCompressor(level=level)
        for b in batches:
            frames = [z.compress(d) for d in b.column("data").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("chunk"), b.column("size"), pa.array(frames, pa.binary()), pa.array([len(f) for f in frames], pa.int64())],
                ["chunk", "size", "frame", "csize"],
            )

    return chunks.select("chunk", "size", "data").mapInArrow(run, "chunk string, size bigint, frame binary, csize bigint")


def build_packs(frames: DataFrame, part: str, order: list[str], target: int) -> DataFrame:
    """``frames`` (chunk, frame, csize, ``part``, order) -> (part, pack_no, pack, size, blob).

    The layout comes from the narrow rows; frames join it last and are concatenated in
    order. A pack is named by the digest of its bytes.
    """
    narrow = frames.select("chunk", part, *order, F.col("csize").alias("size"))
    placed = greedy_packs(narrow, part, order, target).select("chunk", part, "pack_no", "offset")
    rows = placed.join(frames.select("chunk", "frame"), "chunk")
    return joined_blobs(rows, [part, "pack_no"], ["offset"], "frame").withColumnRenamed("digest", "pack").select(
        part, "pack_no", "pack", "size", "blob"
    )


def extract(spans: DataFrame, max_bytes: int = 1 << 20) -> DataFrame:
    """``spans`` (chunk, usize, frame) -> (chunk, ok, data, error): bounded decompression
    with a mandatory check of size and digest."""

    def run(batches):
        import zstandard

        for b in batches:
            out = []
            for chunk, size, frame in zip(*(b.column(c).to_pylist() for c in ("chunk", "usize", "frame")), strict=True):
                if size > max_bytes:
                    out.append((chunk, False, None, "oversize"))
                    continue
                try:
                    data = zstandard.ZstdDecompressor(max_window_size=1 << 21).decompress(frame, max_output_size=size)
                except zstandard.ZstdError:
                    out.append((chunk, False, None, "corrupt"))
                    continue
                good = len(data) == size and digest(data) == chunk
                out.append((chunk, good, data if good else None, None if good else "mismatch"))
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.bool_(), pa.binary(), pa.string()), strict=True)],
                ["chunk", "ok", "data", "error"],
            )

    return spans.select("chunk", "usize", "frame").mapInArrow(run, "chunk string, ok boolean, data binary, error string")

"""Reference normalization: overwrite known hashes by zeros and put them back."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 32
ZEROS = bytes(SIZE)
REWRITES = "array<struct<offset:bigint,ref_index:int>>"


def ref_table(hashes: F.Column) -> F.Column:
    """Sorted, distinct hashes of the right length; a rewrite names its place in it."""
    return F.array_sort(F.array_distinct(F.filter(hashes, lambda h: F.length(h) == SIZE)))


def scan(data: bytes, table: list[str]) -> list[tuple[int, int]]:
    """(offset, index) of all occurrences, leftmost first and without overlap."""
    import ahocorasick

    if not table or not data:
        return []
    auto = ahocorasick.Automaton()
    for i, h in enumerate(table):
        auto.add_word(h, i)
    auto.make_automaton()
    out, free = [], 0
    # Latin-1 keeps byte offsets; the hashes are ASCII and of one length
    for end, i in auto.iter(data.decode("latin-1")):
        start = end - SIZE + 1
        if start >= free:
            out.append((start, i))
            free = end + 1
    return out


def normalize(files: DataFrame) -> DataFrame:
    """``files`` (path, data, refs) -> (path, data, rewrites); the length stays."""

    def run(batches):
        for b in batches:
            datas, rewrites = [], []
            for data, refs in zip(b.column("data").to_pylist(), b.column("refs").to_pylist(), strict=True):
                buf = bytearray(data or b"")
                hits = scan(bytes(buf), refs or [])
                for at, _ in hits:
                    buf[at : at + SIZE] = ZEROS
                datas.append(bytes(buf))
                rewrites.append([{"offset": o, "ref_index": i} for o, i in hits])
            kind = pa.list_(pa.struct([("offset", pa.int64()), ("ref_index", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [b.column("path"), pa.array(datas, pa.binary()), pa.array(rewrites, kind)], ["path", "data", "rewrites"]
            )

    return files.select("path", "data", "refs").mapInArrow(run, f"path string, data binary, rewrites {REWRITES}")


def restore(files: DataFrame) -> DataFrame:
    """``files`` (path, data, rewrites, refs) -> (path, data): inverse of normalize.

    An index beyond the table or an offset beyond the data is an error.
    """

    def step(acc, r):
        known = r["ref_index"].between(0, F.size("refs") - 1)
        fits = (r["offset"] >= 0) & (r["offset"] + SIZE <= F.octet_length(acc))
        put = F.overlay(acc, F.get("refs", r["ref_index"]).cast("binary"), (r["offset"] + 1).cast("int"), F.lit(SIZE))
        return (
            F.when(~known, F.raise_error(F.lit("reference index out of range")).cast("binary"))
            .when(~fits, F.raise_error(F.lit("offset out of range")).cast("binary"))
            .otherwise(put)
        )

    return files.select("path", F.aggregate("rewrites", F.col("data"), step).alias("data"))

"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item is found inside a longer document by the containment of its word shingles.
A MinHash of the whole document would drown a short item, so the sketch is cut by a
threshold instead: an item keeps its ``SKETCH`` least shingle hashes, items are
partitioned by their number of shingles, and each partition has the largest hash that any
of its sketches keeps. Of a document only hashes up to that threshold matter to the
partition, and those of a contained item are all among them. Items that share enough of
their sketch are then compared shingle by shingle, on the words themselves.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

WIDTH = 5
SKETCH = 16
#: 100 * shared >= CONTAINED * shingles of the item
CONTAINED = 75
#: Sketch values that must be shared when the sketch is not the whole set: an item
#: contained at the threshold shares fewer with a chance below 1e-6.
LEAST = 3
#: Bytes of items (their text and ``EACH`` more for sketch and entries) handled in one pass
#: over the documents, which bounds what is broadcast; more are taken in further passes.
BLOCK = 64 << 20
EACH = 512

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def split_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased (as UTF-8)."""
    return text.encode("utf-8", "replace").translate(LOWER).split() if text else []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def rolling_hashes(words: list[bytes], width: int) -> np.ndarray:
    """Hash of every window of ``width`` words; empty if there are fewer."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    w = np.fromiter(map(zlib.crc32, words), dtype=np.uint64, count=len(words))
    h = w[:n].copy()
    for i in range(1, width):
        h = _mix(h) + w[i : i + n]
    return _mix(h)


@dataclass
class _Part:
    """Sketches of the items of one size class, in flat arrays."""

    limit: np.uint64
    values: np.ndarray  # sorted
    owner: np.ndarray  # item index of each value
    flags: np.ndarray  # membership by the low bits, to skip most hashes


class ItemIndex:
    """Items of one shingle width, partitioned by size; texts are kept as one string each."""

    FLAG_BITS = 20

    def __init__(self, items: list[tuple[object, list[bytes]]], width: int):
        self.width = width
        self.ids = [i for i, _ in items]
        self.texts = [b" ".join(w) for _, w in items]
        by_size: dict[int, list[tuple[int, np.ndarray]]] = {}
        self.need = np.zeros(len(items), dtype=np.int32)
        for k, (_, w) in enumerate(items):
            least = np.unique(rolling_hashes(w, width))
            n = len(least)
            self.need[k] = -(-CONTAINED * n // 100) if n <= SKETCH else LEAST
            by_size.setdefault(n.bit_length(), []).append((k, least[:SKETCH]))
        self.parts = []
        for _, group in sorted(by_size.items()):
            values = np.concatenate([s for _, s in group])
            owner = np.repeat(np.array([k for k, _ in group], dtype=np.int32), [len(s) for _, s in group])
            order = np.argsort(values, kind="stable")
            flags = np.zeros(1 << self.FLAG_BITS, dtype=bool)
            flags[(values & np.uint64((1 << self.FLAG_BITS) - 1)).astype(np.int64)] = True
            self.parts.append(_Part(values.max(), values[order], owner[order], flags))

    def candidates(self, hashes: np.ndarray) -> list[int]:
        """Items of which a document with these window hashes shares enough sketch values."""
        found = []
        mask = np.uint64((1 << self.FLAG_BITS) - 1)
        for p in self.parts:
            h = hashes[hashes <= p.limit]
            h = np.unique(h[p.flags[(h & mask).astype(np.int64)]])
            if not len(h):
                continue
            a, z = np.searchsorted(p.values, h, "left"), np.searchsorted(p.values, h, "right")
            n = z - a
            total = int(n.sum())
            if total:
                owners = p.owner[np.repeat(a - np.cumsum(n) + n, n) + np.arange(total)]
                which, n = np.unique(owners, return_counts=True)
                found += which[n >= self.need[which]].tolist()
        return found

    def contained(self, words: list[bytes]):
        """(item id, shared shingles, its shingles) of the items found and verified."""
        k = self.width
        found = self.candidates(rolling_hashes(words, k))
        if found:
            own = shingles(words, k)
            for i in found:
                item = shingles(self.texts[i].split(b" "), k)
                shared, n = len(item & own), len(item)
                if 100 * shared >= CONTAINED * n:
                    yield self.ids[i], shared, n


def shingles(words: list[bytes], width: int) -> set[tuple[bytes, ...]]:
    return set(zip(*[words[i:] for i in range(width)], strict=False))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, shared, item_shingles, containment) of every contained item.

    ``docs``: doc_id, text; ``benchmark``: item_id, text. An item of fewer than five
    words is one shingle of all its words, sought as such; items without words and null
    or empty documents match nothing. Repeated rows give repeated results, and an item
    that stands twice in a document counts once. Whole texts are searched, and null ids
    are ids like others. Without items or documents the result is empty. Other columns
    are ignored. Items are read in blocks of ``BLOCK`` bytes, each one pass over ``docs``.

    An item of more than ``SKETCH`` shingles is looked at if ``LEAST`` of its sketch are
    in the document; one contained at the threshold has fewer with a chance below 1e-6.
    """
    spark = docs.sparkSession
    d_kind = docs.schema["doc_id"].dataType.simpleString()
    i_kind = benchmark.schema["item_id"].dataType.simpleString()
    out = f"doc_id {d_kind}, item_id {i_kind}, shared bigint, item_shingles bigint"
    kinds = (to_arrow_type(benchmark.schema["item_id"].dataType), pa.int64(), pa.int64())

    def search(indexes):
        def run(batches):
            own = indexes.value
            for batch in batches:
                rows: list[tuple] = []
                at: list[int] = []
                for i, t in enumerate(batch.column("text").to_pylist()):
                    words = split_words(t)
                    for index in own:
                        for hit in index.contained(words):
                            at.append(i)
                            rows.append(hit)
                found = [pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(at, pa.int64())), *found], ["doc_id", "item_id", "shared", "item_shingles"]
                )

        return run

    found = spark.createDataFrame([], out)
    for indexes in _indexes(benchmark):
        found = found.union(docs.select("doc_id", "text").mapInArrow(search(indexes), out))
    return found.withColumn("containment", F.col("shared") / F.col("item_shingles"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that contain an item, all columns untouched.

    Null and empty texts contain none and stay, repeated rows share their fate; without
    items all documents stay.
    """

    def keep(indexes):
        def run(batches):
            own = indexes.value
            for batch in batches:
                clean = []
                for t in batch.column("text").to_pylist():
                    words = split_words(t)
                    clean.append(not any(True for x in own for _ in x.contained(words)))
                yield batch.filter(pa.array(clean, pa.bool_()))

        return run

    for indexes in _indexes(benchmark):
        docs = docs.mapInArrow(keep(indexes), docs.schema)
    return docs


def _indexes(benchmark: DataFrame):
    """Broadcast indexes of the items, block by block."""
    for block in _blocks(benchmark):
        by_width: dict[int, list] = {}
        for r in block:
            w = split_words(r["text"])
            if w:
                by_width.setdefault(min(len(w), WIDTH), []).append((r["item_id"], w))
        if by_width:
            yield benchmark.sparkSession.sparkContext.broadcast(
                [ItemIndex(items, width) for width, items in sorted(by_width.items())]
            )


def _blocks(benchmark: DataFrame):
    """The items in lists of at most ``BLOCK`` bytes, one partition on the driver at a time;
    an item of more bytes is a list of its own."""
    block, held = [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        size = len((r["text"] or "").encode("utf-8", "replace")) + EACH
        if block and held + size > BLOCK:
            yield block
            block, held = [], 0
        block.append(r)
        held += size
    if block:
        yield block


def op3_minhash_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = """
WITH t AS (
  SELECT 'd' AS k, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
w AS (
  SELECT k, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM t),
g AS (SELECT DISTINCT k, id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS s
      FROM w WHERE len(w) >= 5),
n AS (SELECT id, count(*) AS n FROM g WHERE k = 'i' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, count(*) AS shared, n.n AS item_shingles, count(*) / n.n AS containment
FROM g i JOIN g d ON i.s = d.s AND i.k = 'i' AND d.k = 'd' JOIN n ON n.id = i.id
GROUP BY d.id, i.id, n.n HAVING 100 * count(*) >= 75 * n.n
"""

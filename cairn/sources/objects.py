"""Keyed immutable objects with access clocks, kept as append-only Parquet.

A store is a folder: ``<root>/put`` holds the objects (key, namespace, clocks, blob) and
``<root>/event`` what happened to them since (touches and deletions). Every operation
appends one folder ``n=<number>-<id>`` in order; the state of a key follows from its last
put and the events after it. Nothing is rewritten, so readers never wait, and concurrent
puts of the same content are harmless: the first one counts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.session import checkpoint, small_or_shuffled

PUT = "key string, namespace string, created bigint, accessed bigint, size bigint, seq bigint"
EVENT = "key string, namespace string, kind string, at bigint, seq bigint"


class ObjectStore:
    def __init__(self, spark: SparkSession, root: str, namespace: str = "own"):
        self.spark, self.root, self.namespace = spark, root.rstrip("/"), namespace
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # -- log ------------------------------------------------------------------
    def _folders(self, kind: str) -> list[str]:
        top = self._path(f"{self.root}/{kind}")
        if not self._fs.exists(top):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(top) if s.getPath().getName()[0].isdigit())

    def _next(self) -> int:
        return max((int(n.split("-")[0]) for k in ("put", "event") for n in self._folders(k)), default=0) + 1

    def _append(self, kind: str, rows: DataFrame) -> int:
        """Writes ``rows`` aside and shows them by one rename; returns their number."""
        seq = self._next()
        tmp = f"{self.root}/{kind}/_tmp-{uuid.uuid4().hex}"
        rows.withColumn("seq", F.lit(seq).cast("bigint")).write.option("compression", "zstd").parquet(tmp)
        self._fs.rename(self._path(tmp), self._path(f"{self.root}/{kind}/{seq:012d}-{uuid.uuid4().hex}"))
        return seq

    def _read(self, kind: str, schema: str) -> DataFrame:
        folders = [f"{self.root}/{kind}/{n}" for n in self._folders(kind)]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    # -- state ----------------------------------------------------------------
    def every(self) -> DataFrame:
        """(key, namespace, created, accessed, size, seq) of the objects of all namespaces;
        ``seq`` names the put that an object stems from."""
        puts, events = self._read("put", PUT), self._read("event", EVENT)
        gone = events.filter("kind = 'delete'").groupBy("key", "namespace").agg(F.max("seq").alias("_gone"))
        seen = events.filter("kind = 'touch'").select("key", "namespace", "at", F.col("seq").alias("_t"))
        first = F.min(F.struct("seq", "created", "accessed", "size"))
        live = (
            puts.join(gone, ["key", "namespace"], "left").filter("_gone IS NULL OR seq > _gone")
            .groupBy("key", "namespace").agg(first.alias("f")).select("key", "namespace", "f.*")
        )
        touched = seen.join(live.select("key", "namespace", "seq"), ["key", "namespace"]).filter("_t > seq")
        clock = touched.groupBy("key", "namespace").agg(F.max("at").alias("_at"))
        return live.join(clock, ["key", "namespace"], "left").select(
            "key", "namespace", "created", F.greatest("accessed", "_at").alias("accessed"), "size", "seq"
        )

    def listing(self, prefix: str = "") -> DataFrame:
        """Objects of the own namespace whose key begins with ``prefix``; to be ordered by
        (created, key) where order matters."""
        own = self.every().filter(F.col("namespace") == self.namespace)
        return own.filter(F.col("key").startswith(prefix)) if prefix else own

    def listed(self, prefix: str, most: int) -> DataFrame | None:
        """The listing, or None if it has more than ``most`` rows: a part of it could be
        taken for the whole."""
        rows = checkpoint(self.listing(prefix))
        return rows if rows.limit(most + 1).count() <= most else None

    def observations(self) -> DataFrame:
        """(key, created, last_accessed) of the own packs, for the collector."""
        return self.listing("pack-").select("key", "created", F.col("accessed").alias("last_accessed"))

    # -- writes ---------------------------------------------------------------
    def put(self, objects: DataFrame, now: int) -> tuple[int, int]:
        """Stores ``objects`` (key, blob[, created, accessed]) whose keys are absent; the
        others are touched. Returns (stored, touched)."""
        clock = [F.coalesce(F.col(c), F.lit(now)).cast("bigint").alias(c) if c in objects.columns else F.lit(now).cast("bigint").alias(c) for c in ("created", "accessed")]
        rows = objects.dropDuplicates(["key"]).select("key", F.lit(self.namespace).alias("namespace"), *clock, F.octet_length("blob").cast("bigint").alias("size"), "blob")
        have = checkpoint(self.listing().select("key"))
        known = checkpoint(rows.select("key").join(have, "key", "left_semi"))
        touched = self.touch(known, now)
        before = self._next()
        self._append("put", rows.join(small_or_shuffled(have), "key", "left_anti"))
        stored = self._read("put", PUT).filter(F.col("seq") >= before).count()
        return stored, touched

    def touch(self, keys: DataFrame, now: int) -> int:
        """Sets the access clock of ``keys``; those that are gone are skipped."""
        return self._event(keys, "touch", now)

    def delete(self, keys: DataFrame, now: int = 0) -> int:
        """Deletes ``keys`` and returns how many there were; absent ones are no error."""
        return self._event(keys, "delete", now)

    def _event(self, keys: DataFrame, kind: str, now: int) -> int:
        there = checkpoint(keys.select("key").distinct().join(self.listing().select("key"), "key", "left_semi"))
        n = there.count()
        if n:
            at = F.lit(now).cast("bigint").alias("at")
            self._append("event", there.select("key", F.lit(self.namespace).alias("namespace"), F.lit(kind).alias("kind"), at))
        return n

    # -- reads ----------------------------------------------------------------
    def find(self, requests: DataFrame) -> DataFrame:
        """``requests`` (id, key, restore) with ``matched``: the key itself if it is there,
        else the newest key that begins with it, else of the first prefix in ``restore``
        that any key has the newest such key.

        One equality join per length of prefix (no longer than a key).
        """
        there = checkpoint(self.listing().select(F.col("key").alias("_k"), "created"))
        wanted = requests.select("id", F.posexplode(F.concat(F.array("key", "key"), F.array_except("restore", F.array("key")))).alias("turn", "prefix"))
        wanted = checkpoint(wanted.withColumn("_n", F.length("prefix")))
        hits = wanted.join(there, (F.col("turn") == 0) & (F.col("prefix") == F.col("_k"))).select("id", "turn", "_k", "created")
        for (n,) in wanted.filter("turn > 0").select("_n").distinct().collect():
            by = there.withColumn("_head", F.substring("_k", 1, n))
            part = wanted.filter((F.col("turn") > 0) & (F.col("_n") == n)).join(by, F.col("prefix") == F.col("_head"))
            hits = hits.union(part.select("id", "turn", "_k", "created"))
        best = hits.groupBy("id").agg(F.max_by("_k", F.struct((-F.col("turn")).alias("t"), "created", "_k")).alias("matched"))
        return requests.join(best, "id", "left")

    def read(self, ranges: DataFrame) -> DataFrame:
        """``ranges`` (key, start, end) with ``data``: exactly those bytes, else an error."""
        live = self.listing().select("key", "seq")
        blobs = self._read("put", PUT + ", blob binary").filter(F.col("namespace") == self.namespace)
        rows = ranges.join(blobs.join(live, ["key", "seq"]).dropDuplicates(["key"]).select("key", "blob"), "key", "left")
        data = F.expr("substring(blob, CAST(start + 1 AS INT), CAST(end - start AS INT))")
        short = F.raise_error(F.concat(F.lit("short read of "), F.col("key"))).cast("binary")
        whole = (F.col("start") >= 0) & (F.octet_length(data) == F.col("end") - F.col("start"))
        return rows.select("key", "start", "end", F.when(whole, data).otherwise(short).alias("data"))

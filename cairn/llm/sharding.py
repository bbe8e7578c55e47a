"""Sharding by size-tiered compaction with an atomically committed manifest.

A store is a folder that all executors share::

    runs/<run id>/part-*.parquet     immutable shards
    manifest/v<N>/part-*.parquet     one row per live shard of version N

Arrivals are appended as small shards without a shuffle. Compaction merges runs of the
same size tier, in order, until their bytes reach the target, and deals the rows of a
merge evenly over as many shards as keep each within ``SLACK`` times the target. Merged
shards are written beside the old ones, and one rename of the manifest folder makes them
live; the store therefore needs a file system whose rename onto an absent name is atomic
(HDFS, a shared POSIX folder). A job that dies leaves unreferenced files and the former
version; writers that lose the race for a version number start again from the new one.
Shards that no version refers to go with :meth:`ShardStore.vacuum`, never before, so that
readers of an older version keep their files.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.session import checkpoint, scratch, small_or_shuffled

#: A merged shard has at most this many times the target, a longer single text aside.
SLACK = 1.25
#: What is told of a document's shard beside its own columns.
TOLD = ("shard", "shard_rows", "shard_bytes", "tier", "version")
MANIFEST = "shard string, run string, rows bigint, bytes bigint, tier int, seq bigint, version bigint"


@dataclass(frozen=True)
class TierConfig:
    """``target`` bytes of text per merged shard; a tier spans a factor of ``ratio``,
    the lowest ends at ``least`` bytes; ``fan_in`` shards of a tier make it merge;
    ``arrival_rows`` bounds an appended shard."""

    target: int = 64 << 20
    least: int = 1 << 20
    ratio: int = 4
    fan_in: int = 4
    arrival_rows: int = 4096


def free_names(names: Sequence[str], taken: Sequence[str]) -> list[str]:
    """``names``, each with as many leading underscores as set it apart from ``taken``."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def _file() -> Column:
    """The file of a row, below runs/."""
    return F.regexp_extract(F.col("_metadata.file_path"), "/runs/([^/]+/.*)$", 1)


class ShardStore:
    """Append, compact and read one store."""

    def __init__(self, spark: SparkSession, root: str, cfg: TierConfig | None = None):
        self.spark, self.root, self.cfg = spark, root.rstrip("/"), cfg or TierConfig()
        self.fs, self.path = _fs(spark, self.root)

    # -- manifest -------------------------------------------------------------
    def version(self) -> int:
        """The newest committed version; 0 for an empty store."""
        top = self.path(f"{self.root}/manifest")
        if not self.fs.exists(top):
            return 0
        names = [s.getPath().getName() for s in self.fs.listStatus(top)]
        return max((int(n[1:]) for n in names if n[0] == "v" and n[1:].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        v = self.version() if version is None else version
        if not v:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/v{v}")

    def commit(self, shards: DataFrame, base: int) -> bool:
        """Publishes ``shards`` as version base + 1; False if that version exists."""
        v = base + 1
        tmp = f"{self.root}/manifest/_tmp-{uuid.uuid4().hex}"
        shards.withColumn("version", F.lit(v).cast("bigint")).select(
            *[c.split()[0] for c in MANIFEST.split(", ")]
        ).coalesce(1).write.parquet(tmp)
        final = self.path(f"{self.root}/manifest/v{v}")
        # mkdirs of the claim is not exclusive; the rename onto an absent folder is
        if not self.fs.exists(final) and self.fs.rename(self.path(tmp), final):
            nested = self.path(f"{self.root}/manifest/v{v}/{tmp.rsplit('/', 1)[1]}")
            if not self.fs.exists(nested):
                return True
            self.fs.delete(nested, True)
        self.fs.delete(self.path(tmp), True)
        return False

    # -- shards ---------------------------------------------------------------
    def _tier(self, size):
        c = self.cfg
        return F.when(size <= c.least, F.lit(0)).otherwise(
            F.ceil(F.log(size / c.least) / F.log(F.lit(float(c.ratio))) - 1e-9)
        ).cast("int")

    def _rows(self, runs: list[str], schema, **extra) -> DataFrame:
        """All rows of ``runs`` with further columns, such as the file they stand in."""
        reader = self.spark.read.schema(schema).option("recursiveFileLookup", "true")
        return reader.parquet(*[f"{self.root}/runs/{r}" for r in runs]).withColumns(extra)

    def _write(self, docs: DataFrame, run: str, **options) -> DataFrame:
        """Writes ``docs`` as the shards of ``run``; returns their manifest rows.

        Every row keeps the bytes of its text beside it, so that a shard is measured
        without a second look at the texts.
        """
        (octets,) = free_names(["octets"], docs.columns)
        size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
        docs.withColumn(octets, size).write.options(compression="zstd", **options).parquet(f"{self.root}/runs/{run}")
        sizes = self._rows([run], f"`{octets}` bigint", shard=_file())
        return (
            sizes.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.sum(octets).alias("bytes"))
            .withColumn("run", F.lit(run)).withColumn("tier", self._tier(F.col("bytes")))
        )

    def append(self, docs: DataFrame) -> int:
        """Writes ``docs`` as small immutable shards, one or more per input partition."""
        run = f"a{uuid.uuid4().hex}"
        new = checkpoint(self._write(docs, run, maxRecordsPerFile=self.cfg.arrival_rows))
        while True:
            base = self.version()
            old = self.manifest(base)
            at = old.agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0]
            order = Window.orderBy("shard")
            rows = new.withColumn("seq", F.lit(at) + F.row_number().over(order))
            if self.commit(old.drop("version").unionByName(rows), base):
                return base + 1

    def plan(self, shards: DataFrame) -> DataFrame:
        """``shards`` with ``merge``: the id of the merge a shard belongs to, or null.

        Tiers are taken from small to large. In each, shards in order of arrival are cut
        where their running bytes pass a multiple of the target; a cut of ``fan_in``
        shards or more, or one that fills half the target, is merged. Shards of the top
        tier are done. One row per shard, so a single ordered pass suffices.
        """
        c = self.cfg
        live = shards.withColumn("_open", F.col("bytes") < c.target)
        w = Window.partitionBy("_open", "tier").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
        cut = live.withColumn(
            "_cut", F.floor(F.coalesce(F.sum("bytes").over(w), F.lit(0)) / c.target)
        )
        g = Window.partitionBy("_open", "tier", "_cut")
        due = (F.count(F.lit(1)).over(g) >= c.fan_in) | (
            (F.sum("bytes").over(g) >= c.target // 2) & (F.count(F.lit(1)).over(g) > 1)
        )
        name = F.concat_ws("-", F.lit("m"), F.col("tier"), F.col("_cut"))
        return cut.withColumn("merge", F.when(F.col("_open") & due, name)).drop("_open", "_cut")

    def settle(self, shards: DataFrame) -> DataFrame:
        """``shards`` with ``merge``: the merged shard that the rounds of :meth:`plan` lead
        to, or null for shards that stay. The rounds run on the metadata alone, so that
        each row is rewritten once however many tiers it climbs."""
        state = checkpoint(shards.withColumn("merge", F.lit(None).cast("string")))
        turn = 0
        while True:
            turn += 1
            at = F.coalesce("merge", "shard").alias("shard")
            now = state.groupBy(at).agg(F.sum("bytes").alias("bytes"), F.min("seq").alias("seq"))
            now = now.withColumn("tier", self._tier(F.col("bytes")))
            step = self.plan(now).filter("merge is not null").select(
                F.col("shard").alias("_at"), F.concat(F.lit(f"{turn}-"), "merge").alias("_to")
            )
            step = checkpoint(step)
            if step.limit(1).count() == 0:
                return state
            here = F.coalesce("merge", "shard") == F.col("_at")
            state = checkpoint(
                state.join(small_or_shuffled(step), here, "left")
                .withColumn("merge", F.coalesce("_to", "merge")).drop("_at", "_to")
            )

    def dealt(self, plan: DataFrame) -> DataFrame:
        """(shard, base, k) of the merged shards of ``plan``: a merge's rows go to the
        files base to base + k - 1. One row per merge is numbered in order."""
        most = SLACK * self.cfg.target
        whole = plan.filter("merge is not null").groupBy("merge").agg(F.ceil(F.sum("bytes") / most).alias("k"))
        whole = whole.withColumn("k", F.greatest("k", F.lit(1)).cast("int"))
        order = Window.orderBy("merge").rowsBetween(Window.unboundedPreceding, -1)
        files = whole.withColumn("base", F.coalesce(F.sum("k").over(order), F.lit(0)).cast("int"))
        return plan.join(files, "merge").select("shard", "base", "k")

    def compact(self, schema) -> int:
        """Merges until no tier has a run to merge; returns the live version."""
        while True:
            base = self.version()
            plan = checkpoint(self.settle(self.manifest(base).drop("version")))
            runs = [r[0] for r in plan.filter("merge is not null").select("run").distinct().collect()]
            if not runs:
                return base
            deal = checkpoint(self.dealt(plan))
            n = deal.agg(F.max(F.col("base") + F.col("k"))).first()[0]
            file, row, first, k = free_names(["file", "row", "first", "k"], schema.names)
            tag = small_or_shuffled(deal.select(F.col("shard").alias(file), F.col("base").alias(first), F.col("k").alias(k)))
            moved = self._rows(runs, schema, **{file: _file(), row: F.col("_metadata.row_index")}).join(tag, file)
            # a merge's rows are dealt in turn, a file to a task: no task takes more than a shard
            to = (F.col(first) + F.pmod(F.col(row) + F.pmod(F.xxhash64(file), F.col(k)), F.col(k))).cast("int")
            run = f"m{uuid.uuid4().hex}"
            made = self._write(moved.repartitionById(n, to).select(*[f"`{c}`" for c in schema.names]), run)
            kept = plan.filter("merge is null").drop("merge")
            top = plan.agg(F.max("seq")).first()[0]
            made = made.withColumn("seq", F.lit(top) + F.row_number().over(Window.orderBy("shard")))
            if self.commit(kept.unionByName(made), base):
                return base + 1
            self.fs.delete(self.path(f"{self.root}/runs/{run}"), True)

    def vacuum(self, retain: int = 1) -> list[str]:
        """Forgets all but the ``retain`` newest versions, then deletes the runs that none
        of those refers to. Returns the deleted runs. Not to be run beside writers, whose
        new runs no version refers to yet."""
        newest = self.version()
        keep = range(max(newest - retain, 0) + 1, newest + 1)
        used = set()
        for v in keep:
            used |= {r[0] for r in self.manifest(v).select("run").distinct().collect()}
        for s in self.fs.listStatus(self.path(f"{self.root}/manifest")):
            name = s.getPath().getName()
            if name[0] == "v" and name[1:].isdigit() and int(name[1:]) not in keep:
                self.fs.delete(s.getPath(), True)
        names = [s.getPath().getName() for s in self.fs.listStatus(self.path(f"{self.root}/runs"))]
        gone = sorted(set(names) - used)
        for r in gone:
            self.fs.delete(self.path(f"{self.root}/runs/{r}"), True)
        return gone

    def read(self, schema) -> DataFrame:
        """Every live document with all its columns, then those of ``TOLD`` (with leading
        underscores where a document has a column of that name)."""
        names = free_names(TOLD, schema.names)
        m = self.manifest()
        live = m.select(*[F.col(c).alias(n) for c, n in zip(("shard", "rows", "bytes", "tier", "version"), names, strict=True)])
        runs = [r[0] for r in m.select("run").distinct().collect()]
        own = [f"`{c}`" for c in schema.names]
        if not runs:
            return self.spark.createDataFrame([], schema).crossJoin(live.limit(0)).select(*own, *names)
        return self._rows(runs, schema, **{names[0]: _file()}).join(small_or_shuffled(live), names[0]).select(*own, *names)


def shard_documents(docs: DataFrame, root: str | None = None, cfg: TierConfig | None = None) -> DataFrame:
    """Appends ``docs`` to a store, compacts it and reads the live shards back.

    Every row of ``docs`` returns exactly once, with all its columns under their own
    names, and the shard it ended in. Repeated rows and null ids are rows like others.
    Null and empty texts count no bytes; a text beyond the target makes a shard of its
    own size; an empty table gives an empty store. Without ``root`` a new store is made
    in the session's shared folder, for as long as the application lives.
    """
    spark = docs.sparkSession
    store = ShardStore(spark, root or scratch(spark, "shards"), cfg)
    store.append(docs)
    store.compact(docs.schema)
    return store.read(docs.schema)


def op6_size_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard_documents(docs).select("doc_id", *TOLD)

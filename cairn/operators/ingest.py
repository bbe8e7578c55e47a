"""Ingest: lookups, classification against the catalog, and batch statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import count_noun, human_bytes, pack_key, seconds, throughput, upstream_signed
from cairn.operators.graph import query_closure
from cairn.operators.layout import greedy_packs, joined_blobs
from cairn.operators.merge import merge_chunks, merge_packs, merge_paths, merge_roots
from cairn.session import checkpoint
from cairn.sources.objects import ObjectStore
from cairn.sources.store import VersionStore

PATH_SHAPE = r"^[0-9a-f]{32}$"


def lookup(requests: DataFrame, info: DataFrame, shape: str = PATH_SHAPE) -> DataFrame:
    """``requests`` (path, ...) with the source row and its status; requests keep their
    rows and order columns. Malformed keys are never looked up."""
    known = info.withColumn("_hit", F.lit(True))
    joined = requests.join(known, "path", "left")
    status = (
        F.when(F.col("path").isNull() | ~F.col("path").rlike(shape), "malformed")
        .when(F.col("_hit"), "found")
        .otherwise("unknown")
    )
    return joined.withColumn("status", status).drop("_hit")


def drv_bypass(edges: DataFrame, members: DataFrame, drvs: DataFrame) -> DataFrame:
    """Members of the closures of build recipes; they are pushed whoever signed them."""
    return query_closure(edges, members, drvs).filter("status = 'found'").select("path")


def classify(found: DataFrame, catalog_paths: DataFrame, bypass: DataFrame, trusted: list[str]) -> DataFrame:
    """``found`` (path, status, signatures) with outcome: bump, upstream, push or the status.

    Paths the catalog has are bumped; of the others, those signed upstream are skipped
    unless they are in ``bypass``.
    """
    have = catalog_paths.select("path", F.lit(True).alias("_have"))
    free = bypass.select("path", F.lit(True).alias("_free")).distinct()
    rows = found.join(have, "path", "left").join(free, "path", "left")
    signed = F.coalesce(upstream_signed(F.col("signatures"), trusted), F.lit(False))
    outcome = (
        F.when(F.col("status") != "found", F.col("status"))
        .when(F.col("_have"), "bump")
        .when(signed & F.col("_free").isNull(), "upstream")
        .otherwise("push")
    )
    return rows.withColumn("outcome", outcome).drop("_have", "_free")


def new_chunks(batch: DataFrame, catalog_chunks: DataFrame) -> DataFrame:
    """Chunks of a batch that the catalog lacks, once each. The catalog decides, not the
    storage: whether a listed pack still exists is the collector's concern."""
    return batch.dropDuplicates(["chunk"]).join(catalog_chunks.select("chunk"), "chunk", "left_anti")


def drain_stats(outcomes: DataFrame) -> DataFrame:
    """One row of counts and bytes over (outcome, nar_size)."""
    n = lambda kind: F.count_if(F.col("outcome") == kind)
    size = F.coalesce(F.sum(F.when(F.col("outcome") == "push", F.col("nar_size"))), F.lit(0))
    return outcomes.agg(
        n("push").alias("pushed"), n("bump").alias("skipped_existing"), n("upstream").alias("skipped_upstream"),
        n("unknown").alias("unknown"), n("malformed").alias("malformed"), size.cast("bigint").alias("pushed_bytes"),
    )


# fixed values: the words of the one-line reports
PARTS = (
    ("skipped_existing", "already cached"), ("skipped_upstream", "upstream-signed"), ("skipped_invalid", "invalid"),
    ("failed_verification", "FAILED VERIFICATION"), ("failed_chunking", "FAILED CHUNKING"),
)


def summarize(stats: DataFrame, family: str) -> DataFrame:
    """``stats`` with summary: one line of what a batch did.

    Columns: pushed, the names of ``PARTS``, packs_uploaded, bytes_uploaded, upload_ms,
    elapsed_ms, manifest_version. ``family`` names the versions.
    """
    c = F.col
    parts = [F.concat(F.lit("pushed "), count_noun(c("pushed"), "path"))]
    parts += [F.when(c(n) > 0, F.concat(c(n).cast("string"), F.lit(f" {what}"))) for n, what in PARTS]
    timed = F.concat(
        F.lit(" in "), seconds(c("elapsed_ms")), F.lit(", "), throughput(c("bytes_uploaded"), c("upload_ms"))
    )
    sent = F.concat(
        F.lit(" ("), human_bytes(c("bytes_uploaded")), F.when(c("upload_ms") > 0, timed).otherwise(""), F.lit(")")
    )
    end = F.when(
        c("manifest_version") > 0, F.concat(F.lit(f"; manifest {family}#"), c("manifest_version").cast("string"))
    ).otherwise("; nothing to commit")
    return stats.withColumn(
        "summary", F.concat(F.concat_ws(", ", *parts), F.when(c("packs_uploaded") > 0, sent).otherwise(""), end)
    )


def stage_breakdown(stats: DataFrame) -> DataFrame:
    """``stats`` with stages: where a batch spent its time."""
    c = F.col
    step = lambda name, ms: F.concat(F.lit(f"{name} "), seconds(c(ms)))
    counts = F.concat(
        F.lit(" ("), count_noun(c("new_chunks"), "chunk"), F.lit(", "), count_noun(c("packs_uploaded"), "pack"), F.lit(")")
    )
    rate = F.concat(F.lit(" ("), throughput(c("bytes_uploaded"), c("upload_ms")), F.lit(")"))
    fresh = c("new_chunks") > 0
    return stats.withColumn(
        "stages",
        F.concat_ws(
            ", ", step("load", "load_ms"), step("chunk", "chunk_ms"),
            F.when(fresh, F.concat(step("pack", "pack_ms"), counts)), F.when(fresh, F.concat(step("upload", "upload_ms"), rate)),
            step("commit", "commit_ms"), step("total", "elapsed_ms"),
        ),
    )


def outcome_status(failed_verification: Column, failed_chunking: Column) -> Column:
    """Exit status of a batch: 1 if anything failed; missing statistics are no failure."""
    bad = F.coalesce(failed_verification, F.lit(0)) + F.coalesce(failed_chunking, F.lit(0))
    return F.when(bad > 0, 1).otherwise(0)


def root_members(pushed: DataFrame, accessed: DataFrame, existing: DataFrame) -> DataFrame:
    """The paths of this run's root: pushed, accessed and already stored ones, once each."""
    return pushed.select("path").union(accessed.select("path")).union(existing.select("path")).distinct()


def same_catalog(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows: a commit of one over the other is a no-op."""
    b = b.select(*a.columns)
    return a.exceptAll(b).limit(1).count() == 0 and b.exceptAll(a).limit(1).count() == 0


def drain_total(drains: DataFrame) -> DataFrame:
    """One row for the drains (turn, counters, manifest_version) of a shutdown: counters
    added up, and the version of the last drain that committed one."""
    added = ("paths_received", "pushed", "new_chunks", "packs_uploaded", "bytes_uploaded")
    version = F.max_by("manifest_version", F.when(F.col("manifest_version") > 0, F.col("turn")))
    return drains.agg(*[F.sum(c).alias(c) for c in added], F.coalesce(version, F.lit(0)).alias("manifest_version"))


def is_populated(info: DataFrame) -> bool:
    """Whether a source of path records answers at all."""
    return info.limit(1).count() > 0


def ingested(files: DataFrame, paths: DataFrame, catalog: dict[str, DataFrame], now: int, target: int) -> dict[str, DataFrame]:
    """What a batch adds: paths, file_chunks, chunks, packs (with blob), all named anew.

    ``paths`` (path, nar_hash, nar_size) are those to push, ``files`` (path, pos, chunk,
    size, data) their chunks. Chunks that the catalog lacks are packed in order of (path,
    pos), each once.
    """
    own = files.join(paths.select("path"), "path", "left_semi")
    first = own.groupBy("chunk").agg(F.min(F.struct("path", "pos", "size")).alias("f")).select("chunk", "f.*")
    fresh = checkpoint(first.join(catalog["chunks"].select("chunk"), "chunk", "left_anti").withColumn("builder", F.lit(0)))
    placed = greedy_packs(fresh, "builder", ["path", "pos"], target)
    data = own.select("chunk", "data").dropDuplicates(["chunk"])
    rows = checkpoint(placed.join(data, "chunk"))
    blobs = checkpoint(joined_blobs(rows, ["pack_no"], ["offset"], "data"))
    where = rows.join(blobs.select("pack_no", F.col("digest").alias("pack")), "pack_no")
    size = F.col("size").cast("bigint")
    return {
        "paths": paths.select("path", "nar_hash", "nar_size", F.lit(now).cast("bigint").alias("last_pushed"), F.lit(now).cast("bigint").alias("last_reachable")),
        "file_chunks": own.select("path", "pos", "chunk"),
        "chunks": where.select("chunk", "pack", "offset", size.alias("csize"), size.alias("usize"), F.lit(0).cast("bigint").alias("survived")),
        "packs": blobs.select(F.col("digest").alias("pack"), "size", F.lit(now).cast("bigint").alias("created"), F.lit(0).alias("tier"), "blob"),
    }


def commit_batch(store: VersionStore, objects: ObjectStore, batch, root: DataFrame, now: int, target: int) -> int:
    """Ingests a batch into the four tables of ``store`` and returns the version.

    ``batch`` is a function of the current catalog that gives (paths to push, their files).
    Packs are stored before the version that names them; a lost race merges again. A merge
    that changes nothing but the clock of this run's own root (``root``: root_key, path,
    updated, run_id) is not committed.
    """
    kinds = {
        "paths": "path string, nar_hash string, nar_size bigint, last_pushed bigint, last_reachable bigint",
        "file_chunks": "path string, pos bigint, chunk string",
        "chunks": "chunk string, pack string, offset bigint, csize bigint, usize bigint, survived bigint",
        "packs": "pack string, size bigint, created bigint, tier int",
        "roots": "root_key string, path string, updated bigint, run_id string",
    }

    def merge(current):
        spark = store.spark
        have = {n: current[n] if n in current else spark.createDataFrame([], kind) for n, kind in kinds.items()}
        paths, files = batch(have)
        made = ingested(files, paths, have, now, target)
        objects.put(made["packs"].select(pack_key(F.col("pack")).alias("key"), "blob"), now)
        made["packs"] = made["packs"].drop("blob")
        out = {
            "paths": merge_paths(have["paths"], made["paths"]),
            "file_chunks": have["file_chunks"].unionByName(made["file_chunks"].join(have["paths"].select("path"), "path", "left_anti")),
            "chunks": merge_chunks(have["chunks"], made["chunks"]),
            "packs": merge_packs(have["packs"], made["packs"]),
            "roots": merge_roots(have["roots"].withColumn("version", F.lit(0)), root.withColumn("version", F.lit(1))),
        }
        clockless = lambda r: r.drop("updated")
        same = all(same_catalog(have[n], out[n]) for n in ("paths", "chunks", "packs", "file_chunks"))
        return None if same and same_catalog(clockless(have["roots"]), clockless(out["roots"])) else out

    return store.save(merge, now=now)

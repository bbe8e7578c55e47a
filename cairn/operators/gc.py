"""Garbage-collection planner and applier: DataFrames in, DataFrames out.

All clocks are unix seconds and ``now`` is a parameter. Ages saturate at 0 and limits are
strict, except recency, which includes its limit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.text import human_bytes
from cairn.operators.cdc import extract
from cairn.operators.graph import reachable
from cairn.operators.layout import PACK_TARGET, adjacent_runs, greedy_packs, joined_blobs
from cairn.session import checkpoint
from cairn.sources.objects import ObjectStore

HOUR, DAY = 3600, 86400
VOLATILE, STABLE = 0, 1
PACK_KEY = r"^pack-[0-9a-f]{64}$"


@dataclass(frozen=True)
class GcPolicy:
    path_grace: int = 72 * HOUR
    push_ttl: int = 14 * DAY
    root_ttl: int = 14 * DAY
    touch_age: int = 4 * DAY
    min_liveness: float = 0.5
    max_volatile_packs: int = 4
    stable_threshold: int = 2
    min_age: int = HOUR


def age(now: int, clock: str | Column) -> Column:
    return F.greatest(F.lit(now) - (F.col(clock) if isinstance(clock, str) else clock), F.lit(0))


def parse_pack_key(key: Column) -> Column:
    """The pack of a listing key; null unless it is ``pack-`` and 64 lowercase hex digits."""
    return F.when(key.rlike(PACK_KEY), F.substring(key, 6, 64))


def observed_lru(observations: DataFrame) -> DataFrame:
    """Per pack the stalest known access of any of its listed copies, 0 if none is known."""
    known = F.when(F.col("last_accessed") != 0, F.col("last_accessed"))
    return (
        observations.withColumn("pack", parse_pack_key(F.col("key"))).filter("pack is not null")
        .groupBy("pack").agg(F.coalesce(F.min(known), F.lit(0)).alias("lru"))
    )


def recent_packs(observations: DataFrame, now: int, min_age: int = HOUR) -> DataFrame:
    """Packs touched within ``min_age``; an unknown clock counts as recent."""
    clock = F.greatest("created", "last_accessed")
    zero = (F.col("created") == 0) | (F.col("last_accessed") == 0)
    return (
        observations.withColumn("pack", parse_pack_key(F.col("key"))).filter("pack is not null")
        .groupBy("pack").agg(F.bool_or(zero).alias("_z"), F.max(clock).alias("_c"))
        .filter(F.col("_z") | (age(now, "_c") <= min_age)).select("pack")
    )


def evicted_packs(packs: DataFrame, observations: DataFrame, now: int, p: GcPolicy) -> DataFrame:
    seen = observed_lru(observations).select("pack")
    return packs.filter(age(now, "created") > p.min_age).join(seen, "pack", "left_anti").select("pack")


def broken_paths(file_chunks: DataFrame, chunks: DataFrame, packs: DataFrame) -> DataFrame:
    """Paths with any chunk that has no location or whose pack is unknown."""
    sound = chunks.join(packs.select("pack"), "pack", "left_semi").select("chunk")
    return file_chunks.select("path", "chunk").join(sound, "chunk", "left_anti").select("path").distinct()


def expired_roots(roots: DataFrame, now: int, p: GcPolicy) -> DataFrame:
    return roots.filter(age(now, "updated") > p.root_ttl).select("root_key").distinct()


class _Kept:
    """The tables of a catalog, each written down when it is first asked for: a plan reads
    them many times, and what they derive from (documents, versions) is read once."""

    def __init__(self, tables: dict[str, DataFrame]):
        self.tables, self.made = tables, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.made:
            self.made[name] = checkpoint(self.tables[name])
        return self.made[name]


def unguarded(packs: DataFrame, *guards: DataFrame | None) -> DataFrame:
    """``packs`` less those in any of ``guards``: versions that still refer to them, and
    packs that another writer has just pushed or touched."""
    for g in guards:
        if g is not None:
            packs = packs.join(g.select("pack"), "pack", "left_anti")
    return packs


def retained_orphans(keys: DataFrame, committed: DataFrame, protected: DataFrame | None = None) -> DataFrame:
    """Orphan ``keys`` that neither the committed packs nor a protected version refer to; a
    key that names no pack is nobody's and stays in the set."""
    rows = keys.select("key", parse_pack_key(F.col("key")).alias("pack"))
    return unguarded(rows, committed, protected).select("key")


class Plan:
    """The plan sets, each a DataFrame built on first use.

    Inputs: paths (path, last_reachable, last_pushed), references (src, dst), file_chunks
    (path, chunk), chunks, packs, roots (root_key, path, updated), observations, and
    optionally protected packs of other versions.
    """

    def __init__(self, cat: dict[str, DataFrame], observations: DataFrame, now: int, policy: GcPolicy | None = None, protected: DataFrame | None = None):
        self._made: dict[str, DataFrame] = {}
        self.now, self.p, self.protected = now, policy or GcPolicy(), protected
        self.cat, self._obs = _Kept(cat), observations

    def _once(self, name: str, make) -> DataFrame:
        if name not in self._made:
            self._made[name] = checkpoint(make())
        return self._made[name]

    @property
    def obs(self) -> DataFrame:
        return self._once("obs", lambda: self._obs)

    @property
    def recent(self) -> DataFrame:
        return self._once("recent", lambda: recent_packs(self.obs, self.now, self.p.min_age))

    @property
    def evicted(self) -> DataFrame:
        return self._once("evicted", lambda: evicted_packs(self.cat["packs"], self.obs, self.now, self.p))

    @property
    def chunks(self) -> DataFrame:
        """Locations left once evicted packs are gone."""
        return self.cat["chunks"].join(self.evicted, "pack", "left_anti")

    @property
    def packs(self) -> DataFrame:
        return self.cat["packs"].join(self.evicted, "pack", "left_anti")

    @property
    def heal(self) -> DataFrame:
        """Paths that eviction broke; they leave the catalog to be pushed again."""
        return self._once("heal", lambda: broken_paths(self.cat["file_chunks"], self.chunks, self.packs))

    @property
    def drop_roots(self) -> DataFrame:
        return expired_roots(self.cat["roots"], self.now, self.p)

    @property
    def reached(self) -> DataFrame:
        def make():
            roots = self.cat["roots"].join(self.drop_roots, "root_key", "left_anti")
            members = self.cat["paths"].join(self.heal, "path", "left_anti")
            return reachable(self.cat["references"], members, roots)

        return self._once("reached", make)

    @property
    def drop_paths(self) -> DataFrame:
        """Unreachable, out of the grace period and out of the push period."""
        out = (age(self.now, "last_reachable") > self.p.path_grace) & (age(self.now, "last_pushed") > self.p.push_ttl)
        return self._once(
            "drop_paths",
            lambda: self.cat["paths"].join(self.heal, "path", "left_anti")
            .join(self.reached, "path", "left_anti").filter(out).select("path"),
        )

    @property
    def live_chunks(self) -> DataFrame:
        gone = self.drop_paths.union(self.heal)
        return self._once(
            "live", lambda: self.cat["file_chunks"].select("path", "chunk").join(gone, "path", "left_anti").select("chunk").distinct()
        )

    @property
    def pack_stats(self) -> DataFrame:
        """pack, tier, chunk_bytes, live_bytes, live_chunks, liveness, fully_live."""

        def make():
            live = self.live_chunks.withColumn("_live", F.lit(True))
            rows = self.chunks.join(live, "chunk", "left")
            stats = rows.groupBy("pack").agg(
                F.sum("csize").alias("chunk_bytes"),
                F.coalesce(F.sum(F.when(F.col("_live"), F.col("csize"))), F.lit(0)).alias("live_bytes"),
                F.count("_live").alias("live_chunks"),
            )
            return self.packs.select("pack", "tier").join(stats, "pack", "left").select(
                "pack", "tier",
                F.coalesce("chunk_bytes", F.lit(0)).alias("chunk_bytes"),
                F.coalesce("live_bytes", F.lit(0)).alias("live_bytes"),
                F.coalesce("live_chunks", F.lit(0)).alias("live_chunks"),
            ).withColumn("liveness", F.col("live_bytes") / F.greatest("chunk_bytes", F.lit(1))).withColumn(
                "fully_live", F.col("live_bytes") == F.col("chunk_bytes")
            )

        return self._once("stats", make)

    @property
    def sources(self) -> DataFrame:
        """Packs to repack: thinly live ones, and all live volatile ones if too many."""
        s = self.pack_stats.filter("live_chunks > 0")
        crowd = s.filter(F.col("tier") == VOLATILE).count() > self.p.max_volatile_packs  # a count only
        thin = F.col("liveness") < self.p.min_liveness
        return s.filter(thin | ((F.col("tier") == VOLATILE) & F.lit(crowd)))

    @property
    def copies(self) -> DataFrame:
        """(tier, pack, offset, chunk, csize, survived) of all repack jobs, without those
        whose single source would come out as it is."""

        def make():
            tier = F.when(F.col("survived") + 1 >= self.p.stable_threshold, STABLE).otherwise(VOLATILE)
            rows = (
                self.chunks.join(self.sources.select("pack", "fully_live"), "pack")
                .join(self.live_chunks, "chunk", "left_semi")
                .select(tier.alias("tier"), "pack", "offset", "chunk", "csize", "survived", "fully_live")
            )
            # a job that copies one whole, fully live pack changes nothing
            jobs = rows.groupBy("tier").agg(F.countDistinct("pack").alias("_n"), F.first("pack").alias("_p"), F.sum("csize").alias("_b"), F.bool_and("fully_live").alias("_f"))
            same = jobs.filter("_n = 1 AND _f").join(
                self.pack_stats.select(F.col("pack").alias("_p"), F.col("chunk_bytes").alias("_b")), ["_p", "_b"], "left_semi"
            )
            return rows.join(same.select("tier"), "tier", "left_anti").drop("fully_live")

        return self._once("copies", make)

    @property
    def repacked(self) -> DataFrame:
        return self.copies.select("pack").distinct()

    @property
    def delete_packs(self) -> DataFrame:
        """Dead packs and the sources of repack jobs, less protected ones."""
        dead = self.pack_stats.filter("live_chunks = 0").select("pack")
        gone = dead.union(self.repacked).distinct()
        return gone.join(self.protected, "pack", "left_anti") if self.protected is not None else gone

    @property
    def touch_packs(self) -> DataFrame:
        """(pack, ordinal): idle live packs in ascending value, least valuable first."""
        lru = observed_lru(self.obs)
        idle = (
            self.pack_stats.filter("live_chunks > 0").join(self.repacked, "pack", "left_anti")
            .join(lru, "pack").filter((F.col("lru") != 0) & (age(self.now, "lru") > self.p.touch_age))
        )
        order = Window.orderBy("tier", "live_bytes", "pack")
        return idle.select("pack", "tier", "live_bytes", (F.row_number().over(order) - 1).cast("bigint").alias("ordinal"))

    @property
    def orphan_keys(self) -> DataFrame:
        """Listed keys of packs in no version, all of whose copies are old."""
        rows = self.obs.withColumn("pack", parse_pack_key(F.col("key"))).filter("pack is not null")
        rows = rows.join(self.cat["packs"].select("pack"), "pack", "left_anti")
        if self.protected is not None:
            rows = rows.join(self.protected, "pack", "left_anti")
        return rows.join(self.recent, "pack", "left_anti").select("key").distinct()

    def summary(self) -> DataFrame:
        """(measure, value): the size of each plan set, and the bytes to download."""
        sets = {
            "evicted": self.evicted, "heal": self.heal, "drop_roots": self.drop_roots, "drop_paths": self.drop_paths,
            "repack_copies": self.copies, "delete_packs": self.delete_packs, "touch_packs": self.touch_packs, "orphans": self.orphan_keys,
        }
        sums = self.copies.agg(F.coalesce(F.sum("csize"), F.lit(0)).alias("b"), F.count_distinct("tier").alias("j"))
        out = sums.select(F.inline(F.array(
            F.struct(F.lit("download_bytes").alias("measure"), F.col("b").alias("value")),
            F.struct(F.lit("repack_jobs").alias("measure"), F.col("j").alias("value")),
        )))
        for name, df in sets.items():
            out = out.union(df.agg(F.count(F.lit(1))).select(F.lit(name), F.col("count(1)")))
        return out

    def apply(self, moved: DataFrame | None = None, new_packs: DataFrame | None = None) -> dict[str, DataFrame]:
        """The catalog after the plan. ``moved``: chunk, from_pack, pack, offset, survived
        of repacked chunks; a chunk that meanwhile lives elsewhere keeps its place. A pack
        that was already known keeps its higher tier. ``deletable`` has passed both guards:
        protected versions and recency."""
        c = self.cat
        paths = c["paths"].join(self.drop_paths.union(self.heal), "path", "left_anti")
        hit = self.reached.select("path", F.lit(True).alias("_hit"))
        clock = F.when(F.col("_hit"), F.greatest("last_reachable", F.lit(self.now))).otherwise(F.col("last_reachable"))
        paths = paths.join(hit, "path", "left").withColumn("last_reachable", clock).drop("_hit")
        chunks, packs = self.chunks, self.packs.select("pack", "size", "created", "tier")
        if moved is not None:
            m = moved.select("chunk", F.col("from_pack").alias("_f"), F.col("pack").alias("_p"), F.col("offset").alias("_o"), F.col("survived").alias("_s"))
            hit = F.col("pack") == F.col("_f")
            chunks = chunks.join(m, "chunk", "left").select(
                "chunk", F.when(hit, F.col("_p")).otherwise(F.col("pack")).alias("pack"),
                F.when(hit, F.col("_o")).otherwise(F.col("offset")).alias("offset"), "csize", "usize",
                F.when(hit, F.col("_s")).otherwise(F.col("survived")).alias("survived"),
            )
        if new_packs is not None:
            packs = packs.unionByName(new_packs).groupBy("pack").agg(
                F.max("size").alias("size"), F.min("created").alias("created"), F.max("tier").alias("tier")
            )
        chunks = chunks.join(self.live_chunks, "chunk", "left_semi")
        kept = packs.join(chunks.select("pack").distinct(), "pack", "left_semi")
        deletable = unguarded(self.delete_packs, kept, self.recent)
        return {
            "paths": paths,
            "file_chunks": c["file_chunks"].join(paths.select("path"), "path", "left_semi"),
            "references": c["references"].join(paths.select(F.col("path").alias("src")), "src", "left_semi"),
            "chunks": chunks,
            "packs": kept,
            "roots": c["roots"].join(self.drop_roots, "root_key", "left_anti"),
            "deletable": deletable,
        }


def plan_line(summary: DataFrame) -> DataFrame:
    """One line of what a plan would do, from its (measure, value) rows."""
    n = {m: F.max(F.when(F.col("measure") == m, F.col("value"))).alias(m) for m in (
        "evicted", "heal", "drop_roots", "drop_paths", "repack_jobs", "repack_copies", "download_bytes", "touch_packs", "delete_packs", "orphans")}
    text = lambda c: F.col(c).cast("string")
    return summary.agg(*n.values()).select(
        F.concat(
            F.lit("evicted "), text("evicted"), F.lit(" pack(s); heal "), text("heal"), F.lit(" path(s); drop "), text("drop_roots"),
            F.lit(" root(s) + "), text("drop_paths"), F.lit(" path(s); repack "), text("repack_jobs"), F.lit(" job(s) ("), text("repack_copies"),
            F.lit(" chunk(s), "), human_bytes(F.col("download_bytes")), F.lit(" copied); touch "), text("touch_packs"),
            F.lit(" pack(s); delete "), text("delete_packs"), F.lit(" pack(s) + "), text("orphans"), F.lit(" orphan(s)"),
        ).alias("line")
    )


def laid_out(copies: DataFrame, target: int) -> DataFrame:
    """Copies with the (tier, pack_no, at) of their new home: per tier in (pack, offset)
    order, a pack sealed once an append reaches ``target``."""
    rows = copies.select("chunk", "tier", "pack", F.col("offset").alias("from_offset"), F.col("csize").alias("size"))
    placed = greedy_packs(rows, "tier", ["pack", "from_offset"], target)
    home = placed.select("chunk", F.col("tier").alias("_t"), "pack_no", F.col("offset").alias("at"))
    return copies.join(home, "chunk").drop("_t")


def relocate(copies: DataFrame, now: int, target: int = PACK_TARGET) -> tuple[DataFrame, DataFrame]:
    """(moved, new packs) of repack jobs, from the metadata alone: a pack is named by the
    hash of its ordered chunks."""
    placed = checkpoint(laid_out(copies, target))
    names = placed.groupBy("tier", "pack_no").agg(
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "chunk"))), lambda x: x["chunk"]), ","), 256).alias("new"),
        F.sum("csize").alias("size"),
    )
    moved = placed.join(names, ["tier", "pack_no"]).select(
        "chunk", F.col("pack").alias("from_pack"), F.col("new").alias("pack"), F.col("at").alias("offset"), (F.col("survived") + 1).alias("survived")
    )
    packs = names.select(F.col("new").alias("pack"), "size", F.lit(now).alias("created"), "tier")
    return moved, packs


def raw_frames(frames: DataFrame) -> DataFrame:
    """``frames`` (chunk, frame, ...) stored as they are: an error unless they hash to
    their chunk."""
    good = F.substring(F.sha2("frame", 256), 1, 32) == F.col("chunk")
    return frames.withColumn("frame", F.when(good, F.col("frame")).otherwise(F.raise_error(F.concat(F.lit("corrupt chunk "), F.col("chunk"))).cast("binary")))


def zstd_frames(frames: DataFrame) -> DataFrame:
    """``frames`` (chunk, usize, frame, ...) that decompress to their chunk; else an error."""
    checked = extract(frames.select("chunk", "usize", "frame")).select("chunk", F.col("ok"), "error")
    bad = F.raise_error(F.concat(F.col("error"), F.lit(" chunk "), F.col("chunk"))).cast("binary")
    return frames.join(checked, "chunk").withColumn("frame", F.when(F.col("ok"), F.col("frame")).otherwise(bad)).drop("ok", "error")


def repack(copies: DataFrame, objects: ObjectStore, now: int, target: int = PACK_TARGET, verified=raw_frames) -> dict[str, DataFrame]:
    """Executes repack jobs on the stored bytes: moved, packs (with blob), downloaded (runs).

    Sources that have vanished are skipped, their chunks keep their places. Adjacent
    frames are one range read, which must return exactly its bytes; every frame is
    verified before it enters a new pack, named by the digest of its bytes.
    """
    there = objects.listing("pack-").select(F.substring("key", 6, 64).alias("pack")).distinct()
    copies = checkpoint(copies.join(there, "pack", "left_semi"))
    runs = adjacent_runs(copies.select("pack", "offset", "csize"))
    reads = objects.read(runs.select(F.concat(F.lit("pack-"), "pack").alias("key"), "start", (F.col("start") + F.col("size")).alias("end")))
    reads = reads.select(F.substring("key", 6, 64).alias("_p"), "start", "end", "data")
    inside = (F.col("pack") == F.col("_p")) & (F.col("offset") >= F.col("start")) & (F.col("offset") + F.col("csize") <= F.col("end"))
    piece = F.expr("substring(data, CAST(offset - start + 1 AS INT), CAST(csize AS INT))")
    frames = verified(laid_out(copies, target).join(reads, inside).withColumn("frame", piece).drop("_p", "start", "end", "data"))
    placed = checkpoint(frames)
    blobs = checkpoint(joined_blobs(placed, ["tier", "pack_no"], ["at"], "frame"))
    names = blobs.select("tier", "pack_no", F.col("digest").alias("new"))
    moved = placed.join(names, ["tier", "pack_no"]).select(
        "chunk", F.col("pack").alias("from_pack"), F.col("new").alias("pack"), F.col("at").alias("offset"), (F.col("survived") + 1).alias("survived")
    )
    packs = blobs.select(F.col("digest").alias("pack"), "size", F.lit(now).alias("created"), "tier", "blob")
    return {"moved": moved, "packs": packs, "runs": runs}

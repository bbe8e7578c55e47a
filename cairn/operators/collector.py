"""The collector at work: plan, repack, touch, commit, delete, in an order that survives a
crash after any step.

New packs are stored before the commit that names them, and nothing is deleted before the
commit that drops it. The commit plans anew against the version it builds on, so a push
that lands meanwhile keeps its paths; deletions pass two guards, the versions that still
refer to a pack and the packs that were just pushed or touched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import human_bytes
from cairn.operators.gc import GcPolicy, Plan, plan_line, raw_frames, recent_packs, repack, retained_orphans, unguarded
from cairn.operators.ingest import same_catalog
from cairn.operators.layout import PACK_TARGET
from cairn.session import checkpoint
from cairn.sources.objects import ObjectStore
from cairn.sources.store import Catalog, VersionStore

#: What a run reports, all counts or bytes but for the version (0: unchanged).
MEASURES = (
    "packs_uploaded", "bytes_downloaded", "bytes_uploaded", "packs_touched", "packs_deleted", "orphans_deleted", "versions_deleted", "version",
)


def _keys(packs: DataFrame) -> DataFrame:
    return packs.select(F.concat(F.lit("pack-"), "pack").alias("key"))


class Collector:
    """One store of versions and the objects that hold its packs."""

    def __init__(self, store: VersionStore, objects: ObjectStore, policy: GcPolicy | None = None, target: int = PACK_TARGET, verified=raw_frames):
        self.store, self.objects = store, objects
        self.policy, self.target, self.verified = policy or GcPolicy(), target, verified

    def plan(self, now: int) -> Plan:
        """The plan against the newest version, which must be readable, as must all others:
        with unknown references nothing may be deleted."""
        cat = self.store.load(strict=True)
        return Plan(cat, self.objects.observations(), now, self.policy, self.store.protected())

    def commit(self, repacked: dict[str, DataFrame], now: int) -> tuple[int, DataFrame, DataFrame]:
        """(version or 0, deletable packs, orphan keys). The listing is taken anew, and every
        attempt plans against the version it is shown; an unchanged catalog is not committed."""
        seen = checkpoint(self.objects.observations())
        protected = checkpoint(self.store.protected())
        out: dict[str, DataFrame] = {}

        def merge(current: Catalog) -> Catalog | None:
            fresh = Plan(current, seen, now, self.policy, protected)
            made = fresh.apply(repacked["moved"], repacked["packs"].drop("blob"))
            out["deletable"] = checkpoint(made.pop("deletable"))
            orphans = retained_orphans(fresh.orphan_keys, made["packs"], protected)
            out["orphans"] = checkpoint(orphans)
            return None if all(same_catalog(current[n], made[n]) for n in made) else made

        floor = self.store.newest()
        version = self.store.save(merge, floor, now)
        return (version if version > floor else 0), out["deletable"], out["orphans"]

    def run(self, now: int, dry_run: bool = False) -> dict[str, int]:
        """One collection; ``dry_run`` plans only. The keys are those of ``MEASURES``."""
        plan = self.plan(now)
        if dry_run:
            return dict.fromkeys(MEASURES, 0)
        repacked = repack(plan.copies, self.objects, now, self.target, self.verified)
        read = repacked["runs"].agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        packs = repacked["packs"].select(F.concat(F.lit("pack-"), "pack").alias("key"), "blob", "size")
        absent = packs.join(self.objects.listing("pack-").select("key"), "key", "left_anti")
        sent = absent.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        made = packs.count()
        self.objects.put(packs.select("key", "blob"), now)
        touched = self.objects.touch(_keys(plan.touch_packs), now)
        version, deletable, orphans = self.commit(repacked, now)
        # between the commit and here another writer may have pushed a pack again: it wins
        recent = recent_packs(self.objects.observations(), now, self.policy.min_age)
        gone = self.objects.delete(_keys(unguarded(deletable, recent)), now)
        lost = self.objects.delete(retained_orphans(orphans, recent), now)
        return dict(
            zip(MEASURES, (made, read, sent, touched, gone, lost, len(self.store.cleanup(now, self.policy.min_age)), version), strict=True)
        )

    def plan_line(self, now: int) -> str:
        return plan_line(self.plan(now).summary()).first()[0]


def report_line(reports: DataFrame) -> DataFrame:
    """``reports`` (a column per measure) with ``line``: what a run did, in one line."""
    text = lambda c: F.col(c).cast("string")
    version = F.when(F.col("version") > 0, text("version")).otherwise("unchanged")
    return reports.withColumn(
        "line",
        F.concat(
            F.lit("uploaded "), text("packs_uploaded"), F.lit(" pack(s) ("), human_bytes(F.col("bytes_downloaded")), F.lit(" down, "),
            human_bytes(F.col("bytes_uploaded")), F.lit(" up); touched "), text("packs_touched"), F.lit(" pack(s); deleted "), text("packs_deleted"),
            F.lit(" pack(s), "), text("orphans_deleted"), F.lit(" orphan(s), "), text("versions_deleted"),
            F.lit(" old manifest version(s); manifest version: "), version,
        ),
    )

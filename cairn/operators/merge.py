"""Reconciliation of concurrent catalog versions, key by key.

Versions are unioned and resolved by one aggregation per table, so any number of them
merges in one shuffle with map-side combining. Every resolver is a maximum or minimum in
a total order: commutative, associative and idempotent.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _all(versions: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, versions)


def merge_paths(*versions: DataFrame) -> DataFrame:
    """The entry with the greatest (last_pushed, nar_hash, content) wins; both clocks are
    the greatest seen. Content is compared as JSON text."""
    rows = _all(list(versions))
    body = [c for c in rows.columns if c not in ("path", "last_pushed", "last_reachable")]
    rank = F.struct("last_pushed", "nar_hash", F.to_json(F.struct(*body)))
    return (
        rows.groupBy("path")
        .agg(
            F.max_by(F.struct(*body), rank).alias("_b"),
            F.max("last_pushed").alias("last_pushed"),
            F.max("last_reachable").alias("last_reachable"),
        )
        .select("path", "_b.*", "last_pushed", "last_reachable")
    )


def merge_chunks(*versions: DataFrame) -> DataFrame:
    """The location with the greatest (survived, pack, offset, csize, usize) wins."""
    place = F.struct("survived", "pack", "offset", "csize", "usize")
    return (
        _all(list(versions)).groupBy("chunk").agg(F.max(place).alias("p"))
        .select("chunk", "p.pack", "p.offset", "p.csize", "p.usize", "p.survived")
    )


def merge_packs(*versions: DataFrame) -> DataFrame:
    """Greatest size and tier, least creation time."""
    return _all(list(versions)).groupBy("pack").agg(
        F.max("size").alias("size"), F.min("created").alias("created"), F.max("tier").alias("tier")
    )


def merge_roots(*versions: DataFrame) -> DataFrame:
    """(root_key, path, updated, run_id), one row per member.

    The latest run wins, and rows of that run are united. Ties are decided here so that
    the order of versions cannot matter: the winner is the greatest (updated, run_id or
    empty); rows without a run id unite with nobody, so of those with the winning clock
    the greatest sorted list of paths wins. ``versions`` need a ``version`` column.
    """
    rows = _all(list(versions))
    own = rows.groupBy("root_key", "version", "updated", "run_id").agg(
        F.array_sort(F.collect_set("path")).alias("paths")
    )
    rank = F.struct("updated", F.coalesce("run_id", F.lit("")), "paths")
    best = own.groupBy("root_key").agg(F.max(rank).alias("w"), F.max_by("run_id", rank).alias("run"))
    same = F.coalesce(own.run_id == F.col("run"), F.lit(False))
    alone = F.col("run").isNull() & own.run_id.isNull() & (own.paths == F.col("w.paths")) & (own.updated == F.col("w.updated"))
    return (
        own.join(best, "root_key").filter(same | alone)
        .select("root_key", F.explode("paths").alias("path"), F.col("w.updated").alias("updated"), F.col("run").alias("run_id"))
        .distinct()
    )


def merge_catalogs(*catalogs: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All four tables of any number of catalogs."""
    made = {
        "paths": merge_paths, "chunks": merge_chunks, "packs": merge_packs, "roots": merge_roots,
    }
    return {name: f(*[c[name] for c in catalogs]) for name, f in made.items()}

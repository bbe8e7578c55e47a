"""Reachability, closures and closure order over a reference graph.

Edges are (src, dst). The loops advance a frontier: each round reads the edges once,
joins them with the frontier and drops what was seen. State is checkpointed, so a lost
executor costs one round; nothing but row counts reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.session import checkpoint, small_or_shuffled


def _advance(edges: DataFrame, start: DataFrame, most: int) -> DataFrame:
    """(path, level) of all nodes reached; level is the round of the first visit."""
    frontier = checkpoint(start.select("path").distinct())
    seen = [frontier.withColumn("level", F.lit(0))]
    for level in range(1, most + 1):
        at = small_or_shuffled(frontier)
        out = edges.join(at, edges.src == at.path).select(F.col("dst").alias("path")).distinct()
        visited = reduce(DataFrame.unionByName, seen).select("path")
        frontier = checkpoint(out.join(visited, "path", "left_anti"))
        if frontier.limit(1).count() == 0:
            return reduce(DataFrame.unionByName, seen)
        seen.append(frontier.withColumn("level", F.lit(level)))
        if len(seen) > 8:  # keep the union short on deep graphs
            seen = [checkpoint(reduce(DataFrame.unionByName, seen))]
    raise RuntimeError(f"graph deeper than {most}")


def reachable(edges: DataFrame, members: DataFrame, roots: DataFrame, most: int = 10_000) -> DataFrame:
    """(path, level) reached from ``roots`` inside ``members``; holes are skipped,
    cycles and self-loops are harmless."""
    inside = checkpoint(edges.join(members.select(F.col("path").alias("dst")), "dst", "left_semi"))
    return _advance(inside, roots.join(members.select("path"), "path", "left_semi"), most)


def mark_reachable(paths: DataFrame, reached: DataFrame, now: int) -> DataFrame:
    """``paths`` with last_reachable raised to ``now`` where reached."""
    mark = reached.select("path", F.lit(True).alias("_hit"))
    clock = F.when(F.col("_hit"), F.greatest("last_reachable", F.lit(now))).otherwise(F.col("last_reachable"))
    return paths.join(mark, "path", "left").withColumn("last_reachable", clock).drop("_hit")


def query_closure(edges: DataFrame, members: DataFrame, start: DataFrame, most: int = 10_000) -> DataFrame:
    """(path, level, status) of the closure in a source; unknown targets stay, as unknown."""
    known = members.select("path", F.lit("found").alias("status"))
    inside = checkpoint(edges.join(members.select(F.col("path").alias("src")), "src", "left_semi"))
    return (
        _advance(inside, start, most)
        .join(known, "path", "left")
        .withColumn("status", F.coalesce("status", F.lit("unknown")))
    )


def closure_levels(edges: DataFrame, members: DataFrame, most: int = 10_000) -> DataFrame:
    """(path, level) on an acyclic graph: 0 without references, else one above the
    highest reference; ascending level lists references before referrers."""
    inside = checkpoint(
        edges.filter("src <> dst").join(members.select(F.col("path").alias("dst")), "dst", "left_semi")
    )
    current = checkpoint(members.select("path", F.lit(0).alias("level")))
    for _ in range(most):
        up = (
            inside.join(current, inside.dst == current.path)
            .groupBy("src").agg((F.max("level") + 1).alias("up"))
        )
        step = checkpoint(
            current.join(up, current.path == up.src, "left").select(
                "path", F.col("level").alias("old"), F.greatest("level", F.coalesce("up", F.lit(0))).alias("level")
            )
        )
        current = step.select("path", "level")
        if step.filter("old <> level").limit(1).count() == 0:
            return current
    raise RuntimeError("references form a cycle")


def closure_order(edges: DataFrame, members: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, ordinal): exact depth-first post-order of the closure of ``roots``.

    Depth-first order is sequential by nature: the references of the closure, which
    :func:`reachable` cuts out first, stream into one task in order and leave it in
    batches. Roots and references are taken in ascending order, self-references skipped,
    cycles entered once.
    """
    inside = reachable(edges, members, roots).select("path")
    kept = edges.filter("src <> dst").join(inside.select(F.col("path").alias("dst")), "dst", "left_semi")
    own = (
        inside.join(kept.withColumnRenamed("src", "path"), "path", "left")
        .join(roots.select(F.col("path"), F.lit(True).alias("root")).distinct(), "path", "left")
        .select("path", "dst", F.coalesce("root", F.lit(False)).alias("root"), F.lit(0).alias("closure"))
    )

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs: dict[str, list[str]] = {}
        starts: list[str] = []
        for batch in batches:
            for path, dst, root in zip(*(batch.column(c).to_pylist() for c in ("path", "dst", "root")), strict=True):
                if path not in refs:
                    refs[path] = []
                    if root:
                        starts.append(path)
                if dst is not None and refs[path][-1:] != [dst]:
                    refs[path].append(dst)
        done, out, at = set(), [], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(range(at, at + len(out)), pa.int64())], ["path", "ordinal"])

        for start in starts:
            stack = [] if start in done else [(start, iter(refs[start]))]
            done.add(start)
            while stack:
                node, rest = stack[-1]
                for r in rest:
                    if r not in done:
                        done.add(r)
                        stack.append((r, iter(refs[r])))
                        break
                else:
                    out.append(node)
                    stack.pop()
            if len(out) >= 10_000:
                yield flush()
                at, out = at + len(out), []
        yield flush()

    dealt = own.repartition("closure").sortWithinPartitions("closure", "path", "dst")
    return dealt.mapInArrow(order, "path string, ordinal bigint")

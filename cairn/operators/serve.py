"""Read path: availability, path records, reassembly with verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PRIORITY = 30


def missing_packs(packs: DataFrame, listing: DataFrame, most: int) -> DataFrame:
    """Indexed packs that a listing lacks; none if the listing exceeds ``most`` rows,
    since absence can only be read off a whole one."""
    whole = listing.limit(most + 1).count() <= most
    gone = packs.select("pack").join(listing.select("pack"), "pack", "left_anti")
    return gone if whole else gone.limit(0)


def available_paths(members: DataFrame, file_chunks: DataFrame, chunks: DataFrame, missing: DataFrame) -> DataFrame:
    """Paths none of whose chunks lies in a missing pack; a chunk without a known place
    does not count against its path."""
    lost = chunks.join(missing.select("pack"), "pack", "left_semi").select("chunk")
    hurt = file_chunks.select("path", "chunk").join(lost, "chunk", "left_semi").select("path").distinct()
    return members.select("path").distinct().join(hurt, "path", "left_anti")


def nar_hash_index(paths: DataFrame) -> DataFrame:
    """nar_hash -> path; of several the greatest."""
    return paths.groupBy("nar_hash").agg(F.max("path").alias("path"))


def narinfo(paths: DataFrame, refs: DataFrame, store: str = "/store") -> DataFrame:
    """(path, text): the record served for a path, fields in fixed order."""
    named = refs.groupBy(F.col("src").alias("path")).agg(F.array_join(F.array_sort(F.collect_set("dst")), " ").alias("_r"))
    full = F.concat(F.lit(f"{store}/"), F.col("path"))
    url = F.concat(F.lit("nar/"), F.col("nar_hash"), F.lit(".nar?hash="), F.col("path"))
    lines = F.concat_ws(
        "\n",
        F.concat(F.lit("StorePath: "), full), F.concat(F.lit("URL: "), url), F.lit("Compression: none"),
        F.concat(F.lit("NarHash: sha256:"), F.col("nar_hash")), F.concat(F.lit("NarSize: "), F.col("nar_size").cast("string")),
        F.concat(F.lit("References: "), F.coalesce("_r", F.lit(""))),
    )
    return paths.join(named, "path", "left").select("path", F.concat(lines, F.lit("\n")).alias("text"))


def cache_info(spark, store: str = "/store", priority: int = PRIORITY) -> DataFrame:
    return spark.range(1).select(
        F.lit(f"StoreDir: {store}\nWantMassQuery: 1\nPriority: {priority}\n").alias("text")
    )


def reassemble(file_chunks: DataFrame, data: DataFrame, sep: str = "\n") -> DataFrame:
    """(path, text): chunk texts of each path in order; a missing chunk is an error.

    Texts are joined last, so that only keys are shuffled before.
    """
    rows = file_chunks.select("path", "pos", "chunk").join(data.select("chunk", "data"), "chunk", "left")
    parts = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("data", F.lit("")).alias("data"))))
    whole = F.count(F.lit(1)) == F.count("data")
    text = F.array_join(F.transform(parts, lambda x: x["data"]), sep)
    return rows.groupBy("path").agg(
        F.when(whole, text).otherwise(F.raise_error(F.lit("missing chunk"))).alias("text")
    )


def verified(text: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, ok): whether the reassembled text has the size and digest of its record."""
    ok = (F.sha2("text", 256) == F.col("nar_hash")) & (F.octet_length("text") == F.col("nar_size"))
    return text.join(paths.select("path", "nar_hash", "nar_size"), "path").select("path", ok.alias("ok"))


def serve_archives(requests: DataFrame, served: DataFrame, newest: DataFrame) -> DataFrame:
    """``requests`` (id, at, nar_hash, hint) with path and status: what each is answered.

    ``served`` and ``newest`` are the paths (path, nar_hash, sound) of the version that is
    shown and of the newest one; ``sound`` says whether a path's bytes can be read and have
    their digest. A request names a path by ``hint`` if that path has the digest asked for,
    else the greatest path that has it. What the shown version cannot serve is tried once
    more on the newest; a digest that failed there is refused without a look from then on
    (``at`` orders requests). Status: served, reloaded, missing, corrupt or refused.
    """

    def resolved(paths: DataFrame, tag: str) -> DataFrame:
        exact = paths.select("path", "nar_hash", "sound").dropDuplicates(["path"])
        any_ = nar_hash_index(paths).join(exact.drop("nar_hash"), "path")
        hinted = exact.select(F.col("nar_hash"), F.col("path").alias("hint"), F.col("sound").alias(f"_h{tag}"))
        named = any_.select("nar_hash", F.col("path").alias(f"_p{tag}"), F.col("sound").alias(f"_s{tag}"))
        return hinted, named

    rows = requests
    for tag, paths in (("0", served), ("1", newest)):
        hinted, named = resolved(paths, tag)
        rows = rows.join(hinted, ["nar_hash", "hint"], "left").join(named, "nar_hash", "left")
        rows = rows.withColumn(f"_ok{tag}", F.coalesce(f"_h{tag}", f"_s{tag}")).withColumn(
            f"_at{tag}", F.when(F.col(f"_h{tag}").isNotNull(), F.col("hint")).otherwise(F.col(f"_p{tag}"))
        )
    good = lambda c: F.coalesce(F.col(c), F.lit(False))
    status = (
        F.when(good("_ok0"), "served").when(good("_ok1"), "reloaded")
        .when(F.col("_ok1").isNull(), "missing").otherwise("corrupt")
    )
    rows = rows.withColumn("status", status).withColumn("path", F.when(good("_ok0"), F.col("_at0")).when(good("_ok1"), F.col("_at1")))
    bad = F.col("status").isin("missing", "corrupt")
    first = F.min(F.when(bad, F.struct("at", "id"))).over(Window.partitionBy("nar_hash"))
    later = bad & (F.struct("at", "id") > first)
    return rows.select("id", "path", F.when(later, F.lit("refused")).otherwise(F.col("status")).alias("status"))


def lru_replay(accesses: DataFrame, budget: int, part: str = "cache") -> DataFrame:
    """``accesses`` (``part``, seq, item, size) with ``hit``: what a cache that evicts the
    least recently used items beyond ``budget`` bytes would have held.

    A replay is sequential per cache; its accesses stream in order past the cache's state,
    whose size the budget bounds.
    """
    from collections import OrderedDict

    import pyarrow as pa

    def run(batches):
        now, held, total = None, OrderedDict(), 0
        for batch in batches:
            hits = []
            for key, item, size in zip(*(batch.column(c).to_pylist() for c in (part, "item", "size")), strict=True):
                if key != now:
                    now, held, total = key, OrderedDict(), 0
                hits.append(item in held)
                if item in held:
                    held.move_to_end(item)
                    continue
                held[item] = size
                total += size
                while total > budget:
                    total -= held.popitem(last=False)[1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hits, pa.bool_())], [*batch.schema.names, "hit"])

    rows = accesses.select(part, "seq", "item", "size")
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", hit boolean"
    return rows.repartition(part).sortWithinPartitions(part, "seq").mapInArrow(run, schema)

"""Registry of the catalog queries; the SQL that checks them is in :mod:`cairn.plans.oracle`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions import text as txt
from cairn.functions.versions import tag_key
from cairn.operators import cdc, gc, graph, ingest, layout, matrix, merge, refnorm, report, serve, trees
from cairn.operators.collector import Collector, report_line
from cairn.plans.oracle import ORACLES  # noqa: F401
from cairn.session import checkpoint, scratch
from cairn.sources import derive as d
from cairn.sources.derive import DAY, NOW
from cairn.sources.objects import ObjectStore
from cairn.sources.store import VersionStore

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


# -- graph ---------------------------------------------------------------------
@query
def live_set_by_root(s, sf):
    """Per root the paths it holds, and of them those that references reach, with bytes."""
    paths, roots = d.paths(s, sf), d.root_members(s, sf)
    reached = graph.reachable(d.references(s, sf), d.members(s, sf), roots)
    size = paths.select("path", "nar_size").join(reached.select("path"), "path", "left_semi")
    own = roots.join(size, "path").groupBy("root_key").agg(F.count(F.lit(1)).alias("paths"), F.sum("nar_size").alias("bytes"))
    every = size.agg(F.lit("(all)").alias("root_key"), F.count(F.lit(1)).alias("paths"), F.sum("nar_size").alias("bytes"))
    return own.union(every)


@query
def reachable_paths(s, sf):
    return graph.reachable(d.references(s, sf), d.members(s, sf), d.root_members(s, sf)).select(
        "path", F.col("level").cast("bigint").alias("level")
    )


@query
def mark_reachable(s, sf):
    reached = graph.reachable(d.references(s, sf), d.members(s, sf), d.root_members(s, sf))
    return graph.mark_reachable(d.paths(s, sf).select("path", "last_reachable"), reached, NOW)


def _starts(s, sf):
    return d.members(s, sf).filter("doc_id % 50 = 0").select("path")


@query
def closure_with_status(s, sf):
    return graph.query_closure(d.references(s, sf), d.members(s, sf), _starts(s, sf)).select("path", "status")


def _dag(s, sf):
    """References that point to smaller ids only: no cycles."""
    i = F.col("doc_id")
    ids = d.table(s, sf, "documents").select("doc_id")
    to = F.array(F.floor(i / 3), F.when(F.floor(i / 5) + 1 < i, F.floor(i / 5) + 1))
    rows = ids.select("doc_id", F.explode(to).alias("to")).filter("to IS NOT NULL AND to < doc_id")
    return rows.select(d.path_of(i).alias("src"), d.path_of(F.col("to")).alias("dst")).distinct()


@query
def closure_levels(s, sf):
    return graph.closure_levels(_dag(s, sf), d.members(s, sf).select("path")).select(
        "path", F.col("level").cast("bigint").alias("level")
    )


@query
def closure_order(s, sf):
    return graph.closure_order(d.references(s, sf), d.members(s, sf), _starts(s, sf))


@query
def drv_bypass(s, sf):
    drvs = d.members(s, sf).filter("doc_id % 97 = 0").select("path")
    return ingest.drv_bypass(d.references(s, sf), d.members(s, sf), drvs)


# -- chunks and packs --------------------------------------------------------------
@query
def chunk_dedup_ratio(s, sf):
    return report.dedup_ratio(d.file_chunks(s, sf).select("chunk", "size"))


@query
def dedup_by_lang(s, sf):
    return report.dedup_ratio(d.file_chunks(s, sf).select("lang", "chunk", "size"), ["lang"])


@query
def new_bytes_per_generation(s, sf):
    return report.new_bytes_per_generation(d.file_chunks(s, sf).select("source", "chunk", "size"), "source")


@query
def last_generations(s, sf):
    names = d.table(s, sf, "part").select(
        F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("profile-"), F.col("p_partkey").cast("string")))
        .otherwise(F.concat(F.lit("system-"), F.col("p_partkey").cast("string"), F.lit("-link"))).alias("name")
    )
    return report.last_generations(names, 5)


@query
def first_seen_chunks(s, sf):
    return d.first_seen(d.file_chunks(s, sf).drop("data")).select("chunk", "doc_id", "pos")


@query
def new_chunks(s, sf):
    fc = d.file_chunks(s, sf).select("doc_id", "chunk", "size")
    return ingest.new_chunks(fc.filter("doc_id % 2 = 1").select("chunk", "size"), fc.filter("doc_id % 2 = 0"))


@query
def wire_encode_locations(s, sf):
    return layout.wire_encode(d.locations(s, sf))


@query
def wire_decode_locations(s, sf):
    return layout.wire_decode(layout.wire_encode(d.locations(s, sf)))


@query
def pack_layout_greedy(s, sf):
    first = d.first_seen(d.file_chunks(s, sf).drop("data"))
    return layout.greedy_packs(first, "source", ["doc_id", "pos"], d.PACK_BYTES).select("source", "chunk", "pack_no", "offset")


def _sparse(s, sf):
    """Two chunks in three: spans with gaps."""
    loc = d.locations(s, sf)
    ends = layout.pack_index(loc).select("pack", F.col("end").alias("pack_end"))
    return loc.join(ends, "pack").filter(F.conv(F.substring("chunk", 1, 4), 16, 10).cast("bigint") % 3 != 0)


@query
def pack_index(s, sf):
    return layout.pack_index(d.locations(s, sf)).select(
        "pack", "spans", "end", F.array_join(F.transform("index", lambda x: x["chunk"]), ",").alias("chunks")
    )


@query
def adjacent_runs(s, sf):
    return layout.adjacent_runs(_sparse(s, sf))


@query
def pack_read_plan(s, sf):
    return layout.plan_pack_reads(_sparse(s, sf), 256, 2048)


@query
def chunks_in_reads(s, sf):
    return layout.chunks_in_reads(d.locations(s, sf), layout.plan_pack_reads(_sparse(s, sf), 256, 2048))


@query
def export_windows(s, sf):
    items = d.table(s, sf, "documents").select("source", "doc_id", d.path_of(F.col("doc_id")).alias("path"), F.octet_length("text").cast("bigint").alias("size"))
    return layout.export_windows(items, "source", ["doc_id"], 8192).select("source", "path", "window")


@query
def layout_dump(s, sf):
    return report.layout_dump(d.file_chunks(s, sf).drop("data"), d.locations(s, sf), d.references(s, sf), d.members(s, sf))


# -- merge ---------------------------------------------------------------------------
def _versions(df, n=3):
    return [df(v) for v in range(n)]


@query
def merge_paths(s, sf):
    p = d.paths(s, sf)
    v = lambda i: p.filter((F.col("doc_id") + i) % 3 != 0).select(
        "path", "nar_hash", (F.col("nar_size") + i).alias("nar_size"),
        (F.col("last_pushed") + (F.col("doc_id") * (i + 1)) % 3).alias("last_pushed"),
        (F.col("last_reachable") + (F.col("doc_id") * (i + 2)) % 5).alias("last_reachable"),
    )
    return merge.merge_paths(*_versions(v))


@query
def merge_chunks(s, sf):
    l = d.locations(s, sf)  # noqa: E741
    v = lambda i: l.select(
        "chunk", F.when(F.lit(i == 2), F.sha2("pack", 256)).otherwise(F.col("pack")).alias("pack"), (F.col("offset") + i).alias("offset"),
        "csize", "usize", ((F.col("survived") * (i + 1)) % 4).alias("survived"),
    )
    return merge.merge_chunks(*_versions(v))


@query
def merge_packs(s, sf):
    p = d.packs(d.locations(s, sf))
    v = lambda i: p.select("pack", (F.col("size") - i).alias("size"), (F.col("created") + i * F.col("k")).alias("created"), ((F.col("tier") + i) % 2).alias("tier"))
    return merge.merge_packs(*_versions(v))


@query
def merge_roots(s, sf):
    r = d.root_members(s, sf)
    v = lambda i: r.filter(F.conv(F.substring("path", 1, 2), 16, 10).cast("bigint") % 3 != i).select(
        "root_key", "path", (F.col("updated") + (F.length("root_key") * (i + 1)) % 2).cast("bigint").alias("updated"),
        F.concat(F.lit("run-"), F.lit(str(i // 2))).alias("run_id"), F.lit(i).alias("version"),
    )
    return merge.merge_roots(*_versions(v))


# -- collector ------------------------------------------------------------------------
def _catalog(s, sf):
    loc = checkpoint(d.locations(s, sf))
    return {
        "paths": d.paths(s, sf).drop("doc_id"), "references": d.references(s, sf),
        "file_chunks": d.file_chunks(s, sf).select("path", "chunk"), "chunks": loc.drop("k"),
        "packs": d.packs(loc), "roots": d.root_members(s, sf).select("root_key", "path", "updated"),
    }


def _plan(s, sf, **policy):
    cat = _catalog(s, sf)
    return gc.Plan(cat, d.observations(s, sf, cat["packs"]), NOW, gc.GcPolicy(**policy))


@query
def observed_lru(s, sf):
    return gc.observed_lru(d.observations(s, sf, d.packs(d.locations(s, sf))))


@query
def recent_packs(s, sf):
    return gc.recent_packs(d.observations(s, sf, d.packs(d.locations(s, sf))), NOW, DAY)


@query
def protected_packs(s, sf):
    """Packs of two versions that a store still holds; a third has been cleaned up."""
    p = checkpoint(d.packs(d.locations(s, sf)))
    store = VersionStore(s, scratch(s, "protected"), "m3")
    for day, part in ((9, "k % 5 = 0"), (1, "k % 3 = 0"), (0, "k % 2 = 0")):
        store.save(lambda _, part=part: {"packs": p.filter(part)}, now=NOW - day * DAY)
    store.cleanup(NOW, 7 * DAY)
    return store.protected()


@query
def gc_evicted(s, sf):
    return _plan(s, sf).evicted


@query
def gc_heal(s, sf):
    return _plan(s, sf).heal


@query
def gc_drop_roots(s, sf):
    return _plan(s, sf).drop_roots


@query
def gc_drop_paths(s, sf):
    return _plan(s, sf).drop_paths


@query
def gc_pack_liveness(s, sf):
    return _plan(s, sf).pack_stats.select("pack", "tier", "chunk_bytes", "live_bytes", "live_chunks", "fully_live")


@query
def gc_repack_copies(s, sf):
    return _plan(s, sf).copies.select("tier", "pack", "offset", "chunk", "csize")


@query
def gc_delete_packs(s, sf):
    return _plan(s, sf, max_volatile_packs=10_000_000).delete_packs


@query
def gc_touch_packs(s, sf):
    return _plan(s, sf, max_volatile_packs=10_000_000).touch_packs.select("pack", "ordinal")


@query
def gc_orphans(s, sf):
    return _plan(s, sf).orphan_keys


@query
def gc_plan_summary(s, sf):
    return _plan(s, sf).summary()


@query
def gc_delete_packs_default(s, sf):
    return _plan(s, sf).delete_packs


@query
def gc_touch_packs_default(s, sf):
    return _plan(s, sf).touch_packs.select("pack", "ordinal")


@query
def gc_plan_line(s, sf):
    return gc.plan_line(_plan(s, sf).summary())


@query
def gc_apply_chunks(s, sf):
    """All chunks after the plan, repacked ones in packs sealed at the target."""
    p = _plan(s, sf)
    moved, new = gc.relocate(p.copies, NOW, d.PACK_BYTES)
    return p.apply(moved, new)["chunks"].select("chunk", "pack", "offset", "csize", F.col("survived").cast("bigint").alias("survived"))


@query
def gc_apply_repacked(s, sf):
    """The packs that the default plan leaves, new ones among them."""
    p = _plan(s, sf)
    moved, new = gc.relocate(p.copies, NOW, d.PACK_BYTES)
    return p.apply(moved, new)["packs"].select("pack", "size", "created", "tier")


def _protecting(s, sf):
    cat = _catalog(s, sf)
    protected = cat["packs"].filter("k % 4 = 1").select("pack")
    return gc.Plan(cat, d.observations(s, sf, cat["packs"]), NOW, protected=protected)


@query
def gc_guarded_deletes(s, sf):
    """What may be deleted after the commit: neither protected nor recently touched."""
    p = _protecting(s, sf)
    moved, new = gc.relocate(p.copies, NOW, d.PACK_BYTES)
    return p.apply(moved, new)["deletable"]


@query
def gc_retained_orphans(s, sf):
    """Of all listed keys those that no pack of the commit or of a protected version claims."""
    p = _protecting(s, sf)
    return gc.retained_orphans(p.obs.select("key").distinct(), p.apply()["packs"], p.protected)


def _stored(s, sf):
    """A store with one version, and the objects that hold its packs: some packs have no
    object, some objects no version, and one lies in another namespace."""
    cat = _catalog(s, sf)
    cat = {n: checkpoint(t) for n, t in cat.items()}
    top = scratch(s, "stored")
    store, objects = VersionStore(s, f"{top}/catalog", "m3"), ObjectStore(s, f"{top}/objects")
    store.save(lambda _: {n: t.drop("k") for n, t in cat.items()}, now=NOW - 2 * DAY)
    data = d.file_chunks(s, sf).select("chunk", F.col("data").cast("binary").alias("data")).dropDuplicates(["chunk"])
    blobs = layout.joined_blobs(cat["chunks"].join(data, "chunk"), ["pack"], ["offset"], "data").select("pack", "blob")
    k = F.col("k")
    own = cat["packs"].filter(k % 9 != 4).join(blobs, "pack").select(
        F.concat(F.lit("pack-"), "pack").alias("key"), "blob", "created", F.when(k % 5 == 0, 0).otherwise(NOW - k % 8 * DAY).alias("accessed")
    )
    n = F.col("p_partkey")
    foreign = d.table(s, sf, "part").select(
        F.when(n % 4 == 0, F.concat(F.lit("pack-"), n.cast("string"))).otherwise(F.concat(F.lit("pack-"), F.sha2(F.concat(F.lit("orphan-"), n.cast("string")), 256))).alias("key"),
        F.lit(b"x").alias("blob"), (NOW - n % 3 * DAY).alias("created"), F.when(n % 5 == 0, F.lit(NOW - 60)).otherwise(NOW - n % 9 * DAY).alias("accessed"),
    )
    objects.put(own.union(foreign), NOW)
    ObjectStore(s, f"{top}/objects", "other").put(own.limit(1), NOW)
    return Collector(store, objects, target=d.PACK_BYTES)


@query
def gc_repacked_packs(s, sf):
    """New packs made of stored bytes, each frame verified."""
    c = _stored(s, sf)
    made = gc.repack(c.plan(NOW).copies, c.objects, NOW, d.PACK_BYTES)
    return made["packs"].select("pack", "size", "tier")


@query
def gc_run(s, sf):
    """What a whole collection reports."""
    report = _stored(s, sf).run(NOW)
    return s.createDataFrame([(k, v) for k, v in report.items()], "measure string, value bigint")


@query
def gc_run_chunks(s, sf):
    """The chunks of the version that a collection commits."""
    c = _stored(s, sf)
    c.run(NOW)
    return c.store.load(strict=True)["chunks"].select("chunk", "pack", "offset", "csize", F.col("survived").cast("bigint").alias("survived"))


@query
def gc_report_line(s, sf):
    n = F.col("p_partkey")
    reports = d.table(s, sf, "part").select(
        n, (n % 4).alias("packs_uploaded"), (n * 4571).alias("bytes_downloaded"), (n * 7).alias("bytes_uploaded"), (n % 3).alias("packs_touched"),
        (n % 5).alias("packs_deleted"), (n % 2).alias("orphans_deleted"), (n % 6).alias("versions_deleted"), (n % 7).alias("version"),
    )
    return report_line(reports).select("p_partkey", "line")


@query
def gc_apply_packs(s, sf):
    """The packs that stay when nothing is repacked."""
    return _plan(s, sf).apply()["packs"].select("pack", "size", "created", "tier")


@query
def manifest_versions_to_delete(s, sf):
    k = F.col("p_partkey")
    rows = d.table(s, sf, "part").select(
        F.when(k % 7 == 0, F.concat(F.lit("m3#0"), k.cast("string"))).when(k % 5 == 0, F.concat(F.lit("m2#"), k.cast("string")))
        .otherwise(F.concat(F.lit("m3#"), k.cast("string"))).alias("key"),
        F.when(k % 9 == 0, 0).otherwise(NOW - k * 120).alias("created"),
    )
    return report.versions_to_delete(rows, "m3", NOW, 3600)


# -- ingest ---------------------------------------------------------------------------
def _requests(s, sf):
    """Added paths of the event stream: some malformed, some unknown."""
    u = F.col("user_id")
    e = d.table(s, sf, "events").filter(F.col("event_type").isin("purchase", "signup"))
    path = F.when(u % 41 == 0, F.concat(F.lit("bad-"), u.cast("string"))).otherwise(d.path_of(u))
    return e.select(path.alias("path")).distinct()


def _info(s, sf):
    i = F.col("doc_id")
    sign = F.when(i % 6 == 0, F.array(F.lit("cache.example-1:sig"))).when(i % 6 == 1, F.array(F.lit("cache.example-10:sig"), F.lit("own:sig"))).otherwise(F.array().cast("array<string>"))
    return d.paths(s, sf).filter("doc_id % 8 <> 7").select("path", "nar_size", sign.alias("signatures"))


def _outcomes(s, sf):
    found = ingest.lookup(_requests(s, sf), _info(s, sf))
    stored = d.members(s, sf).filter("doc_id % 4 = 0")
    drvs = d.members(s, sf).filter("doc_id % 97 = 0").select("path")
    free = ingest.drv_bypass(d.references(s, sf), d.members(s, sf), drvs)
    return ingest.classify(found, stored, free, ["cache.example-1"])


@query
def lookup_status(s, sf):
    return ingest.lookup(_requests(s, sf), _info(s, sf)).select("path", "status", "nar_size")


@query
def drain_classify(s, sf):
    return _outcomes(s, sf).select("path", "outcome")


@query
def drain_stats(s, sf):
    return ingest.drain_stats(_outcomes(s, sf))


@query
def drain_summary(s, sf):
    n = F.col("p_partkey")
    stats = d.table(s, sf, "part").select(
        "p_partkey", (n % 4).alias("pushed"), (n % 3).alias("skipped_existing"), (n % 5).alias("skipped_upstream"),
        (n % 2).alias("skipped_invalid"), F.when(n % 11 == 0, 1).otherwise(0).alias("failed_verification"),
        F.when(n % 13 == 0, 2).otherwise(0).alias("failed_chunking"), (n % 3).alias("packs_uploaded"), (n * 4571).alias("bytes_uploaded"),
        (n % 7 * 100).alias("upload_ms"), (n * 10).alias("elapsed_ms"), (n % 6).alias("manifest_version"),
    )
    return ingest.summarize(stats, "m3").select("p_partkey", "summary")


@query
def root_from_access_log(s, sf):
    e = d.table(s, sf, "events")
    of = lambda *kinds: e.filter(F.col("event_type").isin(*kinds)).select(d.path_of(F.col("user_id")).alias("path"))
    existing = d.members(s, sf).filter("doc_id % 7 = 0").select("path")
    return ingest.root_members(of("purchase", "signup"), of("view", "click"), existing)


@query
def ingest_stream_replay(s, sf):
    """Add requests as a file stream, drained into a versioned store, then read back."""
    from cairn.streaming.ingest import drain

    top = scratch(s, "stream")
    add = _requests(s, sf).select(F.to_json(F.struct(F.lit("add").alias("op"), F.array("path").alias("paths"))).alias("value"))
    add.repartition(3, "value").write.text(f"{top}/in")
    store = VersionStore(s, f"{top}/catalog", "m3")
    source = s.readStream.schema("value string").option("maxFilesPerTrigger", 2).text(f"{top}/in")
    drain(s, source, store, f"{top}/state", NOW)
    return store.load()["paths"].select("path", "last_pushed")


# -- serving -----------------------------------------------------------------------------
@query
def available_paths(s, sf):
    loc = d.locations(s, sf)
    p = d.packs(loc)
    missing = serve.missing_packs(p, p.filter("k % 9 <> 4"), 10_000_000)
    return serve.available_paths(d.members(s, sf), d.file_chunks(s, sf).select("path", "chunk"), loc, missing)


@query
def narinfo_text(s, sf):
    return serve.narinfo(d.paths(s, sf), d.references(s, sf))


@query
def nar_hash_index(s, sf):
    return serve.nar_hash_index(d.paths(s, sf).select("path", "nar_hash"))


@query
def cache_info(s, sf):
    return serve.cache_info(s)


@query
def reassemble_and_verify(s, sf):
    """Documents rebuilt from their lines; texts with empty lines differ, since empty
    input has no chunk."""
    fc = d.file_chunks(s, sf).select("path", "pos", "chunk", "data")
    text = serve.reassemble(fc, fc.select("chunk", "data").dropDuplicates(["chunk"]))
    return serve.verified(text, d.paths(s, sf))


# -- matrix ------------------------------------------------------------------------------
def _jobs(s, sf):
    n = F.col("p_partkey")
    system = F.element_at(F.array(*map(F.lit, ("x86_64-linux", "aarch64-linux", "aarch64-darwin", "riscv64-linux"))), (n % 4 + 1).cast("int"))
    os = F.when(n % 26 == 0, ',"os":["big","fast"]').when(n % 13 == 0, ',"os":"custom"').otherwise("")
    grp = F.when(n % 5 == 0, F.format_string(',"group":"g%d"', n % 40)).otherwise("")
    meta = F.concat(F.lit('{"build":{"x":0'), os, grp, F.lit("}}"))
    line = F.format_string('{"attr":"a.%d","drvPath":"/store/%d.drv","system":"%s","isCached":%s,"meta":%s}', n, n % 700, system, (n % 11 == 0).cast("string"), meta)
    return matrix.check(matrix.parse_jobs(d.table(s, sf, "part").select(n.alias("line_no"), line.alias("line"))))


def _rows(s, sf):
    return matrix.plan_rows(_jobs(s, sf), matrix.runner_map(["x86_64-linux=self-hosted, x64"]), "checks.", skip_unmapped=True)


@query
def matrix_rows(s, sf):
    return _rows(s, sf).select("line_no", "attr", "drv_path", "system", F.array_join("os", ",").alias("os"), F.coalesce("grp", F.lit("")).alias("grp"))


@query
def matrix_groups(s, sf):
    return matrix.collapse_groups(_rows(s, sf)).select(
        "line_no", "name", "attr", "drv_path", "system", F.array_join("os", ",").alias("os"), "installables", "mixed"
    )


@query
def matrix_json(s, sf):
    return matrix.outputs(matrix.collapse_groups(_rows(s, sf)), 7)


@query
def matrix_drvs(s, sf):
    return matrix.registered_drvs(_jobs(s, sf))


@query
def runner_map(s, sf):
    made = matrix.runner_map(["x86_64-linux=self-hosted, x64", "riscv64-linux=rv"])
    return s.createDataFrame([(k, ",".join(v)) for k, v in made.items()], "system string, labels string")


# -- text ---------------------------------------------------------------------------------
@query
def parse_timestamps(s, sf):
    e = d.table(s, sf, "events")
    base = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    i = F.col("event_id")
    text = (
        F.when(i % 6 == 0, F.concat(base, F.lit("Z"))).when(i % 6 == 1, F.concat(base, F.lit(".5Z"))).when(i % 6 == 2, F.concat(base, F.lit("+00:00")))
        .when(i % 6 == 3, F.concat(base, F.lit("+01:00"))).when(i % 6 == 4, F.concat(base, F.lit(".Z"))).otherwise(F.concat(F.substring(base, 1, 8), F.lit("31T23:59:60Z")))
    )
    sec = txt.parse_timestamp(text)
    return e.select("event_id", sec.alias("sec"), txt.format_timestamp(sec).alias("stamp"))


@query
def human_bytes(s, sf):
    n = F.col("p_partkey")
    size = F.when(n % 3 == 0, n).when(n % 3 == 1, n * n * 1021).otherwise(n * n * n * 524287)
    return d.table(s, sf, "part").select("p_partkey", txt.human_bytes(size).alias("text"))


@query
def key_parsing(s, sf):
    n = F.col("p_partkey")
    hexed = F.sha2(n.cast("string"), 256)
    key = F.when(n % 3 == 0, F.concat(F.lit("pack-"), hexed)).when(n % 3 == 1, F.concat(F.lit("pack-"), F.upper(hexed))).otherwise(F.concat(F.lit("m3#"), F.when(n % 2 == 0, "0").otherwise(""), n.cast("string")))
    b64 = F.base64(F.unhex(hexed))
    sri = F.when(n % 4 == 0, F.concat(F.lit("sha256-"), b64)).when(n % 4 == 1, F.concat(F.lit("sha256:"), hexed)).when(n % 4 == 2, hexed).otherwise("sha256-bad")
    r = txt.parse_range(txt.format_range(n, n * 3))
    return d.table(s, sf, "part").select(
        "p_partkey", gc.parse_pack_key(key).alias("pack"), txt.version_index(key, "m3").alias("version"), txt.parse_sha256(sri).alias("digest"),
        txt.store_path_key(F.concat(F.lit("/store/"), hexed, F.lit("-name"))).alias("store_key"), r["end"].alias("range_end"),
    )


@query
def tag_order(s, sf):
    """Release tags in ascending order of version."""
    from pyspark.sql import Window

    n = F.col("p_partkey")
    tag = F.concat(F.lit("v"), (n % 3).cast("string"), F.lit("."), (n % 12).cast("string"), F.when(n % 2 == 0, F.concat(F.lit("-rc."), (n % 11).cast("string"))).otherwise(""))
    tags = d.table(s, sf, "part").select(tag.alias("tag")).distinct()
    return tags.select("tag", F.row_number().over(Window.orderBy(tag_key(F.col("tag")))).cast("bigint").alias("ordinal"))


# -- byte kernels ----------------------------------------------------------------------------
def _files(s, sf):
    docs = d.table(s, sf, "documents")
    return docs.select(d.path_of(F.col("doc_id")).alias("path"), F.col("text").cast("binary").alias("data"), F.substring("source", 4, 9).cast("bigint").alias("generation"))


SMALL = cdc.ChunkParams(256, 1024, 4096)


@query
def cdc_chunks(s, sf):
    return cdc.chunk_data(_files(s, sf), SMALL, keep_data=False)


@query
def cdc_sweep(s, sf):
    return cdc.sweep(_files(s, sf), [512, 1024, 2048])


def _frames(s, sf):
    fc = d.file_chunks(s, sf)
    first = d.first_seen(fc.drop("data")).select("chunk", "source", "doc_id", "pos", "size")
    data = fc.select("chunk", F.col("data").cast("binary").alias("data")).dropDuplicates(["chunk"])
    return first, cdc.compress(data.join(first.select("chunk", "size"), "chunk"))


@query
def zstd_packs(s, sf):
    first, frames = _frames(s, sf)
    rows = frames.join(first.select("chunk", "source", "doc_id", "pos"), "chunk")
    return cdc.build_packs(rows, "source", ["doc_id", "pos"], d.PACK_BYTES).select("source", "pack_no", "pack", "size")


@query
def extract_verify(s, sf):
    _, frames = _frames(s, sf)
    return cdc.extract(frames.withColumnRenamed("size", "usize")).select("chunk", "ok", F.octet_length("data").alias("bytes"))


def _referring(s, sf):
    """Texts with the path keys of their references written into them."""
    refs = d.references(s, sf).groupBy(F.col("src").alias("path")).agg(refnorm.ref_table(F.collect_set("dst")).alias("refs"))
    docs = d.table(s, sf, "documents").select(d.path_of(F.col("doc_id")).alias("path"), "text")
    body = F.concat(F.substring("text", 1, 100), F.array_join("refs", "/"), F.expr("substring(text, 101)"), F.get("refs", F.lit(0)))
    return docs.join(refs, "path").select("path", body.cast("binary").alias("data"), "refs")


@query
def refnorm_positions(s, sf):
    made = refnorm.normalize(_referring(s, sf))
    return made.select("path", F.inline("rewrites")).select("path", "offset", F.col("ref_index").cast("bigint").alias("ref_index"))


@query
def refnorm_restore(s, sf):
    """Digests of the normalized and of the restored bytes, and the rewrites between them."""
    files = _referring(s, sf)
    made = checkpoint(refnorm.normalize(files))
    back = refnorm.restore(made.join(files.select("path", "refs"), "path"))
    norm = made.select("path", F.sha2("data", 256).alias("normalized"), F.size("rewrites").cast("bigint").alias("rewrites"))
    return norm.join(back.select("path", F.sha2("data", 256).alias("restored")), "path")


@query
def cdc_reassembled(s, sf):
    """Every file put together again from its chunks, whose offsets leave no gap."""
    cut = cdc.chunk_data(_files(s, sf), SMALL)
    back = layout.joined_blobs(cut, ["path"], ["pos"], "data")
    gaps = cut.groupBy("path").agg(F.sum("size").alias("total"), F.max(F.col("offset") + F.col("size")).alias("end"))
    return back.join(gaps, "path").select("path", "size", F.col("digest").alias("sha256"), (F.col("total") == F.col("end")).alias("whole"))


@query
def cdc_sweep_totals(s, sf):
    """Bytes of a sweep do not depend on the chunk size; compressed ones are fewer."""
    made = cdc.sweep(_files(s, sf), [512, 2048])
    fewer = (F.col("packed_bytes") > 0) & (F.col("unique_bytes") <= F.col("bytes")) & (F.col("packs") == 1)
    return made.select("average", "bytes", fewer.alias("sound"), (F.col("index_bytes") == F.col("unique_chunks") * 28 + 32).alias("indexed"))


@query
def cdc_sweep_generations(s, sf):
    return cdc.sweep_generations(_files(s, sf), [1024])


@query
def zstd_round_trip(s, sf):
    """Chunks cut out of packs by their places and decompressed again."""
    first, frames = _frames(s, sf)
    rows = checkpoint(frames.join(first.select("chunk", "source", "doc_id", "pos"), "chunk"))
    packs = cdc.build_packs(rows, "source", ["doc_id", "pos"], d.PACK_BYTES)
    narrow = rows.select("chunk", "source", "doc_id", "pos", F.col("csize").alias("size"))
    at = layout.greedy_packs(narrow, "source", ["doc_id", "pos"], d.PACK_BYTES).select("chunk", "source", "pack_no", "offset", F.col("size").alias("csize"))
    piece = F.expr("substring(blob, CAST(offset + 1 AS INT), CAST(csize AS INT))")
    cut = at.join(packs.select("source", "pack_no", "blob"), ["source", "pack_no"]).select("chunk", piece.alias("frame"))
    made = cdc.extract(cut.join(first.select("chunk", F.col("size").alias("usize")), "chunk"))
    return made.select("chunk", "ok", F.sha2("data", 256).alias("sha256"))


# -- objects ------------------------------------------------------------------------------
def _objects(s, sf):
    """Two overlapping puts, touches, deletions of present and absent keys, a put after a
    deletion, and another namespace."""
    store = ObjectStore(s, scratch(s, "objects"))
    i = F.col("doc_id")
    docs = d.table(s, sf, "documents").select(F.format_string("%s-%d", F.when(i % 3 == 0, "m3").otherwise("pack"), i).alias("key"), F.col("text").cast("binary").alias("blob"), i)
    store.put(docs.filter(i % 4 < 2), 1000)
    store.put(docs.filter(i % 4 > 0), 2000)
    store.touch(docs.filter(i % 5 == 0).select(F.concat("key", F.when(i % 10 == 0, "").otherwise("?")).alias("key")), 3000)
    store.delete(docs.filter(i % 7 == 0).select("key"), 4000)
    store.put(docs.filter(i % 21 == 0), 5000)
    ObjectStore(s, store.root, "other").put(docs.filter(i < 9), 10)
    return store


@query
def object_listing(s, sf):
    return _objects(s, sf).listing("pack-").select("key", "size", "created", "accessed")


@query
def object_counts(s, sf):
    """What puts, touches and deletions report."""
    store = ObjectStore(s, scratch(s, "objects"))
    i = F.col("doc_id")
    docs = d.table(s, sf, "documents").select(i.cast("string").alias("key"), F.lit(b"x").alias("blob"), i)
    first, again = store.put(docs.filter(i % 2 == 0), 1), store.put(docs.filter(i % 3 == 0), 2)
    gone = store.delete(docs.filter(i % 5 == 0).select("key"), 3)
    twice = store.delete(docs.filter(i % 5 == 0).select("key"), 4)
    touched = store.touch(docs.select("key"), 5)
    listed = store.listed("", 1)
    rows = [("first", first[0]), ("again", again[0]), ("bumped", again[1]), ("gone", gone), ("twice", twice), ("touched", touched), ("whole", int(listed is not None))]
    return s.createDataFrame(rows, "step string, n bigint")


@query
def object_lookup(s, sf):
    """Exact keys first, then the newest key of the first prefix that any key has."""
    i = F.col("doc_id")
    asked = d.table(s, sf, "documents").select(
        i.alias("id"), F.format_string("pack-%d", i).alias("key"),
        F.when(i % 2 == 0, F.array(F.format_string("none-%d", i), F.format_string("m3-%d", i % 10))).otherwise(F.array(F.lit("pack-9"), F.lit("m3"))).alias("restore"),
    )
    return _objects(s, sf).find(asked).select("id", F.coalesce("matched", F.lit("")).alias("matched"))


@query
def object_ranges(s, sf):
    store = _objects(s, sf)
    n = F.col("size")
    ranges = store.listing().select("key", F.floor(n / 3).alias("start"), F.greatest(F.floor(n / 3), F.floor(n / 2)).alias("end"))
    return store.read(ranges).select("key", F.sha2("data", 256).alias("sha256"))


# -- trees and archives --------------------------------------------------------------------
def _leaves(s, sf):
    i = F.col("doc_id")
    link = i % 11 == 0
    docs = d.table(s, sf, "documents")
    return docs.select(
        F.col("source").alias("tree"), F.concat_ws("/", "lang", F.format_string("d%d", i % 10), F.format_string("%d.txt", i)).alias("path"),
        F.when(link, "symlink").otherwise("regular").alias("kind"), (i % 7 == 0).alias("executable"),
        F.when(~link, F.col("text").cast("binary")).alias("data"), F.when(link, F.format_string("../d0/%d.txt", i + 1)).alias("target"),
    )


@query
def tree_flatten(s, sf):
    return trees.flatten_tree(_leaves(s, sf)).select("tree", "path", "kind", "ordinal")


@query
def tree_build(s, sf):
    """Nodes from bracketed events, which come from the flattened trees."""
    nodes = checkpoint(trees.flatten_tree(_leaves(s, sf)).select("tree", "path", "kind", "ordinal"))
    depth = F.when(F.col("path") == "", 0).otherwise(F.size(F.split("path", "/")))
    name = F.element_at(F.split("path", "/"), -1)
    begin = nodes.select("tree", "ordinal", F.lit(0).alias("turn"), F.when(F.col("kind") == "directory", "start").otherwise(F.col("kind")).alias("kind"), name.alias("name"))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    inside = nodes.filter("path <> ''").select("tree", "ordinal", F.explode(above).alias("path")).union(nodes.select("tree", "ordinal", "path"))
    last = inside.groupBy("tree", "path").agg(F.max("ordinal").alias("ordinal"))
    ends = last.join(nodes.filter("kind = 'directory'").select("tree", "path"), ["tree", "path"]).select("tree", "ordinal", (100 - depth).alias("turn"), F.lit("end").alias("kind"), name.alias("name"))
    order = Window.partitionBy("tree").orderBy("ordinal", "turn")
    return trees.build_tree(begin.union(ends).withColumn("seq", F.row_number().over(order))).select("tree", "path", "kind")


@query
def archive_digests(s, sf):
    return trees.write_archives(trees.flatten_tree(_leaves(s, sf))).select("tree", "digest", "size")


def _chain(s, sf):
    """References to a third of the own id: every closure is a chain down to 0."""
    i = F.col("doc_id")
    docs = d.table(s, sf, "documents").select("doc_id")
    return docs.filter("doc_id > 0").select(d.path_of(i).alias("src"), d.path_of(F.floor(i / 3)).alias("dst"))


@query
def closure_order_chain(s, sf):
    return graph.closure_order(_chain(s, sf), d.members(s, sf), _starts(s, sf))


@query
def closure_export(s, sf):
    """The export stream of a closure by windows: references first, each path framed."""
    order = checkpoint(graph.closure_order(_chain(s, sf), d.members(s, sf), _starts(s, sf)))
    docs = d.table(s, sf, "documents").select(d.path_of(F.col("doc_id")).alias("path"), F.col("text").cast("binary").alias("data")).join(order, "path")
    roots = docs.select(F.col("path").alias("tree"), F.lit("").alias("path"), F.lit("regular").alias("kind"), F.lit(False).alias("executable"), "data", F.lit(None).cast("string").alias("target"))
    archives = trees.write_archives(trees.flatten_tree(roots)).select(F.col("tree").alias("path"), "blob")
    refs = _chain(s, sf).groupBy(F.col("src").alias("path")).agg(F.array_sort(F.collect_set("dst")).alias("references"))
    paths = order.join(refs, "path", "left").select("path", F.coalesce("references", F.array().cast("array<string>")).alias("references"), F.lit(None).cast("string").alias("deriver"))
    sized = docs.select(F.lit(0).alias("stream"), "path", "ordinal", F.octet_length("data").cast("bigint").alias("size"))
    windows = layout.export_windows(sized, "stream", ["ordinal"], 8192).select("path", "ordinal", "window")
    frames = trees.export_frames(paths, archives).join(windows, "path")
    return layout.joined_blobs(frames, ["window"], ["ordinal"], "frame").select("window", "digest", "size")


# -- serving, continued -----------------------------------------------------------------------
@query
def archives_served(s, sf):
    """Requests by digest and hint against the shown and the newest version."""
    p = d.paths(s, sf)
    i = F.col("doc_id")
    shown = p.filter(i % 5 != 0).select("path", "nar_hash", (i % 7 != 0).alias("sound"))
    newest = p.filter(i % 25 != 0).select("path", "nar_hash", (i % 14 != 0).alias("sound"))
    u = F.col("user_id")
    asked = d.table(s, sf, "events").select(F.col("event_id").alias("id"), F.col("event_id").alias("at"), d.path_of(u).alias("_u"), F.when(u % 2 == 0, d.path_of(u)).otherwise(d.path_of(u + 1)).alias("hint"))
    asked = asked.join(p.select(F.col("path").alias("_u"), "nar_hash"), "_u", "left").withColumn("nar_hash", F.coalesce("nar_hash", F.lit("none"))).drop("_u")
    return serve.serve_archives(asked, shown, newest).select("id", F.coalesce("path", F.lit("")).alias("path"), "status")


@query
def cache_replay(s, sf):
    u = F.col("user_id")
    rows = d.table(s, sf, "events").select(F.col("event_type").alias("cache"), F.col("event_id").alias("seq"), u.alias("item"), (u % 97 + 1).alias("size"))
    return serve.lru_replay(rows, 2000).select("cache", "seq", "hit")


# -- ingest, continued ---------------------------------------------------------------------------
@query
def ingest_full(s, sf):
    """Two batches into paths, chunks, packs and roots, and the same again, which commits
    nothing; the chunks' places at the end."""
    top = scratch(s, "ingest")
    store, objects = VersionStore(s, f"{top}/catalog", "m3"), ObjectStore(s, f"{top}/objects")
    files = checkpoint(d.file_chunks(s, sf).select("doc_id", "path", "pos", "chunk", "size", F.col("data").cast("binary").alias("data")))
    p = checkpoint(d.paths(s, sf))
    i = F.col("doc_id")
    versions = []
    for turn, part in enumerate((i % 2 == 0, i % 3 == 0, i % 2 == 0)):
        root = d.root_members(s, sf).filter("run_id = 'run-0'").withColumn("updated", F.lit(NOW + turn).cast("bigint"))

        def batch(have, part=part):
            push = p.filter(part).join(have["paths"].select("path"), "path", "left_anti").select("path", "nar_hash", "nar_size")
            return push, files.filter(part).drop("doc_id")

        versions.append(ingest.commit_batch(store, objects, batch, root, NOW, d.PACK_BYTES))
    if versions != [1, 2, 2]:
        raise RuntimeError(f"versions {versions}")
    chunks = store.load()["chunks"]
    return chunks.join(objects.listing("pack-").select(F.substring("key", 6, 64).alias("pack")), "pack", "left_semi").select("chunk", "pack", "offset", "csize")


@query
def request_replies(s, sf):
    """What status and drain requests are told, per country's queue of requests."""
    from cairn.streaming.ingest import replies

    i, u = F.col("event_id"), F.col("user_id")
    op = F.when(i % 23 == 0, "drain").when(i % 7 == 0, "status").otherwise("add")
    log = d.table(s, sf, "events").select((u % 5).alias("queue"), i.alias("seq"), op.alias("op"), F.when(op == "add", (u % 40).cast("string")).alias("path"))
    return replies(log)


@query
def access_sessions(s, sf):
    """Runs of accesses to a path with pauses of less than three hours."""
    from cairn.streaming.ingest import access_sessions as sessions

    e = d.table(s, sf, "events").select(d.path_of(F.col("user_id")).alias("path"), F.col("ts").cast("timestamp").alias("ts"))
    made = sessions(e, "3 hours", "1 hour")
    return made.select("path", F.unix_micros("session_window.start").alias("start"), F.unix_micros("session_window.end").alias("end"), "n")


@query
def drain_total(s, sf):
    n = F.col("p_partkey")
    drains = d.table(s, sf, "part").select(
        n.alias("turn"), (n % 5).alias("paths_received"), (n % 4).alias("pushed"), (n % 9).alias("new_chunks"), (n % 3).alias("packs_uploaded"),
        (n * 7).alias("bytes_uploaded"), F.when(n % 10 == 3, n).otherwise(0).alias("manifest_version"),
    )
    return ingest.drain_total(drains)


@query
def key_formats(s, sf):
    """Keys, permits, namespaces and path lists."""
    n = F.col("p_partkey")
    t = n.cast("string")
    h = F.sha2(t, 256)
    args = F.when(n % 3 == 0, F.array(t, F.concat(t, F.lit(" x"))))
    env = F.when(n % 3 == 1, F.concat(F.lit(" a  "), t, F.lit("\n b\t")))
    return d.table(s, sf, "part").select(
        n, txt.pack_key(h).alias("pack_key"), txt.root_key(t, F.lit("attr")).alias("root_key"), txt.family_key("m3", n).alias("family_key"),
        txt.prefixed(F.when(n % 2 == 0, "").otherwise("checks.."), t).alias("attr"), F.array_join(txt.reference_hashes(F.array(F.concat(h, F.lit("-x")))), ",").alias("refs"),
        txt.lenient_index(F.concat(F.lit("m3#"), F.when(n % 2 == 0, "00").otherwise("+"), t), "m3").alias("idx"),
        F.array_join(txt.collect_paths(args, env), "|").alias("paths"), txt.chunk_permits(n * n * n * 97).alias("permits"),
        txt.name_to_string(t.cast("binary")).alias("name"), txt.cache_version(F.when(n % 2 == 0, t), "family-2").alias("namespace"),
        txt.clock_or_zero(F.when(n % 2 == 0, txt.format_timestamp(n * 1000)).otherwise(t)).alias("clock"),
    )


@query
def fullest_version(s, sf):
    """The version with the most paths, and the newest one."""
    store = VersionStore(s, scratch(s, "fullest"), "m3")
    m = d.members(s, sf).select("path", "doc_id")
    for part in ("doc_id % 2 = 0", "doc_id % 5 < 4", "doc_id % 3 = 0"):
        store.save(lambda _, part=part: {"paths": m.filter(part)})
    best = store.fullest()
    return s.createDataFrame([(best, store.newest())], "fullest bigint, newest bigint").crossJoin(store.load(best)["paths"].agg(F.count(F.lit(1)).alias("paths")))


@query
def matrix_strict(s, sf):
    """Groups that hold one system and one list of labels, checked before they collapse."""
    n = F.col("line_no")
    rows = _rows(s, sf).withColumn("grp", F.when(n % 5 == 0, F.concat_ws("-", "system", F.array_join("os", "+"))))
    return matrix.collapse_groups(matrix.checked_rows(rows)).select("line_no", "name", "installables", "mixed")

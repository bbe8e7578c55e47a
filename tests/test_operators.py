"""Golden cases, laws and round trips of the catalog operators."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from cairn.operators import cdc, gc, graph, ingest, layout, matrix, merge, refnorm, report, serve
from cairn.sources.store import VersionStore

NOW, DAY = 1_750_000_000, 86400


# -- graph ----------------------------------------------------------------------
def graph_of(spark, edges, members):
    return (
        spark.createDataFrame(edges, "src string, dst string"),
        spark.createDataFrame([(m,) for m in members], "path string"),
    )


def test_reachability_skips_holes_and_ends_on_cycles(spark):
    e, m = graph_of(spark, [("a", "b"), ("b", "a"), ("b", "hole"), ("hole", "z"), ("a", "a"), ("x", "y")], "abxyz")
    roots = spark.createDataFrame([("a",), ("gone",)], "path string")
    assert {r.path for r in graph.reachable(e, m, roots).collect()} == {"a", "b"}
    got = {(r.path, r.status) for r in graph.query_closure(e, m, roots).collect()}
    assert got == {("a", "found"), ("b", "found"), ("hole", "unknown"), ("gone", "unknown")}


def test_closure_order_lists_references_first(spark):
    rng = random.Random(4)
    names = [f"n{i:02}" for i in range(40)]
    edges = [(names[i], names[rng.randrange(i)]) for i in range(1, 40) for _ in range(2)] + [("n05", "n05")]
    e, m = graph_of(spark, edges, names)
    order = {r.path: r.ordinal for r in graph.closure_order(e, m, m.filter("path >= 'n30'")).collect()}
    for a, b in edges:
        if a in order and a != b:
            assert order[b] < order[a]
    level = {r.path: r.level for r in graph.closure_levels(e, m).collect()}
    assert all(level[b] < level[a] for a, b in edges if a != b)


# -- layout ---------------------------------------------------------------------------
GAP, AHEAD = layout.GAP, layout.AHEAD


# fixed values: the limits of a read plan, whose results must be just these
@pytest.mark.parametrize("spans,end,reads", [
    ([(0, 100), (GAP + 100, 100), (10 * AHEAD, 100)], 100 * AHEAD, [(0, AHEAD), (10 * AHEAD, 11 * AHEAD)]),
    ([(100 * AHEAD - 50, 50)], 100 * AHEAD, [(100 * AHEAD - 50, 100 * AHEAD)]),
    ([(0, 2**32 - 1)], 100, [(0, 2**32 - 1)]),
    ([(0, 100), (2 * GAP, 100)], 100 * AHEAD, [(0, 2 * GAP + AHEAD)]),
])
def test_read_plans(spark, spans, end, reads):
    df = spark.createDataFrame([("p", o, n, end) for o, n in spans], "pack string, offset bigint, csize bigint, pack_end bigint")
    assert sorted((r.start, r.end) for r in layout.plan_pack_reads(df).collect()) == reads


def test_chunks_inside_reads(spark):
    spans = spark.createDataFrame([("p", f"c{i}", o, n) for i, (o, n) in enumerate([(0, 100), (100, 100), (300, 100), (350, 100)])], "pack string, chunk string, offset bigint, csize bigint")
    reads = spark.createDataFrame([("p", 100, 400)], "pack string, start bigint, end bigint")
    assert sorted(r.chunk for r in layout.chunks_in_reads(spans, reads).collect()) == ["c1", "c2"]


def test_export_windows(spark):
    w = layout.EXPORT_WINDOW
    items = spark.createDataFrame([("r", f"p{i}", i, n) for i, n in enumerate([w // 2, w // 2, 3 * w, 1, 1])], "root string, path string, i bigint, size bigint")
    assert [r.window for r in layout.export_windows(items, "root", ["i"]).orderBy("i").collect()] == [0, 0, 1, 2, 2]


def test_offsets_survive_the_wire(spark):
    loc = spark.createDataFrame([(p, f"{p}{i}", i * i * 10, 5) for p in "ab" for i in range(20)], "pack string, chunk string, offset bigint, csize bigint")
    assert layout.wire_decode(layout.wire_encode(loc)).exceptAll(loc).count() == 0
    over = spark.createDataFrame([("a", 0, i, f"c{i}", 2**62, 1) for i in range(3)], "pack string, pack_index int, seq bigint, chunk string, delta bigint, csize bigint")
    with pytest.raises(Exception, match="overflow"):
        layout.wire_decode(over).collect()


# -- merge laws ---------------------------------------------------------------------------
def versions(spark, seed):
    rng = random.Random(seed)
    paths = [(rng.choice("abc"), rng.choice("xy"), rng.randrange(3), rng.randrange(3), rng.randrange(9)) for _ in range(5)]
    chunks = [(rng.choice("abc"), rng.choice("pq"), rng.randrange(3), 1, 2, rng.randrange(3)) for _ in range(5)]
    packs = [(rng.choice("pq"), rng.randrange(9), rng.randrange(9), rng.randrange(3)) for _ in range(4)]
    roots = [(rng.choice("rs"), rng.choice("abc"), rng.randrange(3), rng.choice([None, "run-1", "run-2"]), seed) for _ in range(3)]
    mk = spark.createDataFrame
    return {
        "paths": mk(paths, "path string, nar_hash string, nar_size int, last_pushed int, last_reachable int").dropDuplicates(["path"]),
        "chunks": mk(chunks, "chunk string, pack string, offset int, csize int, usize int, survived int").dropDuplicates(["chunk"]),
        "packs": mk(packs, "pack string, size int, created int, tier int").dropDuplicates(["pack"]),
        "roots": mk(roots, "root_key string, path string, updated int, run_id string, version int").dropDuplicates(["root_key"]),
    }


def rows(cat):
    return {n: sorted(map(str, df.collect())) for n, df in cat.items()}


@pytest.mark.parametrize("seed", range(3))
def test_merge_laws(spark, seed):
    a, b, c = (versions(spark, 10 * seed + i) for i in range(3))
    want = rows(merge.merge_catalogs(a, b, c))
    for order in itertools.islice(itertools.permutations((a, b, c)), 1, 6, 2):
        assert rows(merge.merge_catalogs(*order)) == want
    assert rows(merge.merge_catalogs(a, a, b, c)) == want
    for n in ("paths", "chunks", "packs"):
        ab = {n: merge.merge_catalogs(a, b)[n].select(*a[n].columns)}
        again = getattr(merge, f"merge_{n}")(ab[n], c[n])
        assert sorted(map(str, again.collect())) == want[n]


def test_roots_of_one_run_unite_and_a_newer_run_replaces(spark):
    mk = lambda v, *r: spark.createDataFrame([(*x, v) for x in r], "root_key string, path string, updated int, run_id string, version int")
    one = merge.merge_roots(mk(0, ("r", "a", 1, "x")), mk(1, ("r", "b", 2, "x")))
    assert {(r.path, r.updated) for r in one.collect()} == {("a", 2), ("b", 2)}
    two = merge.merge_roots(mk(0, ("r", "a", 1, "x")), mk(1, ("r", "b", 2, "y")))
    assert {r.path for r in two.collect()} == {"b"}
    none = merge.merge_roots(mk(0, ("r", "a", 2, None)), mk(1, ("r", "b", 2, None)))
    assert {r.path for r in none.collect()} == {"b"}


# -- collector --------------------------------------------------------------------------------
def pack(i):
    return f"{i:064x}"


def plan(spark, paths, chunks, packs, roots, seen=None, refs=(), policy=None, protected=None):
    """paths: (id, chunk ids, age pushed, age reachable); chunks: (id, pack, size, survived);
    packs: (id, tier, age, listed age or None); roots: (key, path, age). Ages in days."""
    mk = spark.createDataFrame
    t = lambda days: NOW - int(days * DAY)
    offs, loc = {}, []
    for c, p, n, s in chunks:
        loc.append((f"c{c}", pack(p), offs.get(p, 0), n, 2 * n, s))
        offs[p] = offs.get(p, 0) + n
    cat = {
        "paths": mk([(f"p{i}", t(r), t(q)) for i, _, q, r in paths], "path string, last_reachable bigint, last_pushed bigint"),
        "references": mk([(f"p{a}", f"p{b}") for a, b in refs], "src string, dst string"),
        "file_chunks": mk([(f"p{i}", f"c{c}") for i, cs, _, _ in paths for c in cs], "path string, chunk string"),
        "chunks": mk(loc, "chunk string, pack string, offset bigint, csize bigint, usize bigint, survived int"),
        "packs": mk([(pack(i), offs.get(i, 0), t(a), tier) for i, tier, a, _ in packs], "pack string, size bigint, created bigint, tier int"),
        "roots": mk([(k, f"p{p}", t(a)) for k, p, a in roots], "root_key string, path string, updated bigint"),
    }
    listed = [(f"pack-{pack(i)}", t(a), t(l) if l >= 0 else 0) for i, _, a, l in packs if l is not None] + list(seen or [])
    obs = mk(listed, "key string, created bigint, last_accessed bigint")
    return gc.Plan(cat, obs, NOW, policy, protected)


def ids(df):
    return sorted(r[0] for r in df.select(df.columns[0]).collect())


def test_expired_root_and_sweep_clocks(spark):
    p = plan(spark, [(1, [1], 30, 30), (2, [1], 30, 1), (3, [1], 1, 30), (4, [1], 30, 30)], [(1, 1, 100, 0)], [(1, 1, 30, 1)], [("old", 1, 15), ("new", 1, 13)])
    assert ids(p.drop_roots) == ["old"] and ids(p.drop_paths) == ["p4"]


def test_reachability_follows_references(spark):
    p = plan(spark, [(i, [1], 30, 30) for i in (1, 2, 3)], [(1, 1, 100, 0)], [(1, 1, 30, 1)], [("r", 1, 1)], refs=[(1, 2)])
    assert ids(p.drop_paths) == ["p3"]


def test_root_expiry_cascades_to_packs(spark):
    p = plan(spark, [(1, [1], 30, 30)], [(1, 1, 100, 0)], [(1, 1, 30, 1)], [("r", 1, 20)])
    assert (ids(p.drop_roots), ids(p.drop_paths), ids(p.delete_packs)) == (["r"], ["p1"], [pack(1)])
    assert p.copies.count() == 0


def test_eviction_heals_and_a_young_pack_is_spared(spark):
    p = plan(spark, [(1, [1], 1, 1), (2, [2], 1, 1)], [(1, 1, 9, 0), (2, 2, 9, 0)], [(1, 1, 10, 1), (2, 1, 10, None)], [("r", 1, 1), ("s", 2, 1)])
    assert (ids(p.evicted), ids(p.heal), ids(p.delete_packs)) == ([pack(2)], ["p2"], [])
    q = plan(spark, [(1, [1], 1, 1)], [(1, 1, 9, 0)], [(1, 1, 60 / DAY, None)], [("r", 1, 1)])
    assert q.evicted.count() == q.heal.count() == 0


def test_mostly_dead_pack_is_repacked(spark):
    p = plan(spark, [(1, [1], 1, 1)], [(1, 1, 200, 0), (2, 1, 400, 0)], [(1, 0, 9, 1)], [("r", 1, 1)])
    assert [(r.tier, r.chunk, r.csize) for r in p.copies.collect()] == [(0, "c1", 200)]
    assert ids(p.delete_packs) == [pack(1)]
    moved, new = gc.relocate(p.copies, NOW)
    after = p.apply(moved, new)
    assert [(r.survived, r.offset) for r in after["chunks"].collect()] == [(1, 0)]
    assert ids(after["deletable"]) == [pack(1)] and ids(after["packs"]) == ids(new.select("pack"))


def test_touch_order_and_unknown_clocks(spark):
    live = [(i, [i], 1, 1) for i in range(1, 5)]
    chunks = [(1, 1, 300, 0), (2, 2, 100, 0), (3, 3, 200, 0), (4, 4, 50, 0)]
    packs = [(1, 1, 9, 5), (2, 1, 9, 6), (3, 1, 9, 1), (4, 1, 9, -1)]
    p = plan(spark, live, chunks, packs, [(f"r{i}", i, 1) for i in range(1, 5)])
    assert [(r.pack, r.ordinal) for r in p.touch_packs.orderBy("ordinal").collect()] == [(pack(2), 0), (pack(1), 1)]


def test_consolidation_and_the_copy_that_changes_nothing(spark):
    live = [(i, [i], 1, 1) for i in range(1, 6)]
    roots = [(f"r{i}", i, 1) for i in range(1, 6)]
    packs = [(i, 0, 9, 1) for i in range(1, 6)]
    p = plan(spark, live, [(i, i, 100, 0) for i in range(1, 6)], packs, roots)
    assert p.copies.count() == 5 and p.delete_packs.count() == 5
    packs[0] = (1, 0, 9, 5)
    q = plan(spark, live, [(i, i, 100, int(i == 1)) for i in range(1, 6)], packs, roots)
    assert q.copies.count() == 4 and pack(1) not in ids(q.delete_packs)
    assert ids(q.touch_packs) == [pack(1)]


def test_orphans(spark):
    key = lambda i: f"pack-{pack(i)}"
    t = lambda s: NOW - s
    seen = [(key(7), t(9 * DAY), t(9 * DAY)), (key(7), t(9 * DAY), t(9 * DAY)), (key(8), t(60), t(60)), (key(9), t(9 * DAY), t(60)), ("other-1", t(9 * DAY), t(9 * DAY)), (key(6), t(9 * DAY), 0), (key(5), t(9 * DAY), t(9 * DAY))]
    protected = spark.createDataFrame([(pack(5),)], "pack string")
    p = plan(spark, [], [], [(1, 0, 9, 9)], [], seen, protected=protected)
    assert ids(p.orphan_keys) == [key(7)]


def test_clean_catalog_gives_an_empty_plan_and_apply_is_idempotent(spark):
    args = ([(1, [1], 1, 1), (2, [2], 40, 40)], [(1, 1, 100, 0), (2, 2, 70, 0)], [(1, 1, 9, 1), (2, 1, 9, 1)], [("r", 1, 1)])
    p = plan(spark, *args)
    after = p.apply()
    again = gc.Plan(after, p.obs, NOW)
    sizes = {r.measure: r.value for r in again.summary().collect()}
    assert all(v == 0 for m, v in sizes.items() if m != "orphans")
    assert {r.measure: r.value for r in p.summary().collect()}["drop_paths"] == 1


# -- ingest and serving ------------------------------------------------------------------------
def test_summaries(spark):
    """One batch with failures and one that found all its paths stored."""
    first = {
        "pushed": 1, "skipped_existing": 0, "skipped_upstream": 5, "skipped_invalid": 0, "failed_verification": 2, "failed_chunking": 1,
        "packs_uploaded": 3, "bytes_uploaded": 3_500_000, "upload_ms": 1400, "elapsed_ms": 9100, "manifest_version": 12,
        "new_chunks": 1, "load_ms": 40, "chunk_ms": 7777, "pack_ms": 320, "commit_ms": 1999,
    }
    second = dict.fromkeys(first, 0) | {"skipped_existing": 12, "load_ms": 200, "elapsed_ms": 300}
    df = spark.createDataFrame([tuple(first.values()), tuple(second.values())], ", ".join(f"{n} bigint" for n in first))
    made = ingest.stage_breakdown(ingest.summarize(df, "m3")).collect()
    assert made[0].summary == "pushed 1 path, 5 upstream-signed, 2 FAILED VERIFICATION, 1 FAILED CHUNKING (3.3 MiB in 9.1s, 2.4 MiB/s); manifest m3#12"
    assert made[0].stages == "load 0.0s, chunk 7.8s, pack 0.3s (1 chunk, 3 packs), upload 1.4s (2.4 MiB/s), commit 2.0s, total 9.1s"
    assert made[1].summary == "pushed 0 paths, 12 already cached; nothing to commit"
    assert made[1].stages == "load 0.2s, chunk 0.0s, commit 0.0s, total 0.3s"


def test_lookup_and_missing_chunk(spark):
    asked = spark.createDataFrame([("a" * 32,), ("b" * 32,), ("nope",), (None,)], "path string")
    info = spark.createDataFrame([("a" * 32, 5)], "path string, nar_size int")
    assert {r.path: r.status for r in ingest.lookup(asked, info).collect()} == {"a" * 32: "found", "b" * 32: "unknown", "nope": "malformed", None: "malformed"}
    fc = spark.createDataFrame([("p", 0, "c")], "path string, pos int, chunk string")
    with pytest.raises(Exception, match="missing chunk"):
        serve.reassemble(fc, spark.createDataFrame([], "chunk string, data string")).collect()
    assert serve.missing_packs(spark.createDataFrame([("x",)], "pack string"), spark.createDataFrame([("y",), ("z",)], "pack string"), 1).count() == 0


def test_same_catalog(spark):
    a = spark.createDataFrame([(1,), (1,)], "x int")
    assert ingest.same_catalog(a, a) and not ingest.same_catalog(a, a.distinct())


# -- matrix -----------------------------------------------------------------------------------
def jobs(spark, *lines):
    return matrix.parse_jobs(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "line_no int, line string"))


def test_matrix_problems(spark):
    with pytest.raises(matrix.MatrixError, match="a: boom"):
        matrix.check(jobs(spark, '{"attr":"a","error":"boom"}'))
    with pytest.raises(matrix.MatrixError, match="drvPath"):
        matrix.check(jobs(spark, '{"attr":"a","system":"s"}'))
    with pytest.raises(matrix.MatrixError, match="malformed"):
        matrix.check(jobs(spark, "{nope"))
    for bad in ("x", "=a", "s=", "s= , "):
        with pytest.raises(matrix.MatrixError):
            matrix.runner_map([bad])


def test_matrix_rows_and_groups(spark):
    line = lambda a, d, s="x86_64-linux", c="false", m="{}": f'{{"attr":"{a}","drvPath":"{d}","system":"{s}","isCached":{c},"meta":{{"build":{m}}}}}'
    made = matrix.check(jobs(spark, line("c", "d1", c="true"), line("dup", "d1"), "", line("a", "d2", m='{"group":"g"}'), line("b", "d3", m='{"os":"own"}'), line("e", "d4", m='{"group":"g","os":["ubuntu-latest"]}'), line("u", "d5", s="mips")))
    rows = matrix.plan_rows(made, matrix.runner_map([]), "pre.")
    assert {r.attr: (r.os, r.unmapped) for r in rows.collect()} == {"pre.a": (["ubuntu-latest"], False), "pre.b": (["own"], False), "pre.e": (["ubuntu-latest"], False), "pre.u": (None, True)}
    groups = matrix.collapse_groups(rows.filter("NOT unmapped")).orderBy("line_no").collect()
    assert [(r.name, r.installables, r.mixed) for r in groups] == [("g", "d2^* d4^*", False), ("pre.b", "d3^*", False)]
    out = {r.name: r.value for r in matrix.outputs(matrix.collapse_groups(rows.limit(0)), 3).collect()}
    assert out == {"matrix": '{"include":[]}', "any-jobs": "false", "manifest-version": "3"}


# -- byte kernels -------------------------------------------------------------------------------
def noise(n, seed):
    return random.Random(seed).randbytes(n)


@pytest.mark.parametrize("n", [0, 100, 1 << 20, (1 << 22) + 1234])
def test_chunks_cover_the_data(n):
    p = cdc.ChunkParams(segment=1 << 21)
    data = noise(n, n)
    ends = cdc.boundaries(data, p)
    assert (ends[-1] if ends else 0) == n and ends == sorted(set(ends))
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert all(x <= p.most for x in sizes)
    assert all(x > p.least or e == n or e % p.segment == 0 for x, e in zip(sizes, ends))
    assert ends == cdc.boundaries(data, p)


def test_most_chunks_survive_a_shift():
    p = cdc.ChunkParams(256, 1024, 4096)
    data = noise(400_000, 9)

    def cut(d):
        ends = cdc.boundaries(d, p)
        return {cdc.digest(d[a:b]) for a, b in zip([0, *ends], ends)}

    a, b = cut(data), cut(b"prefix" + data)
    assert len(a & b) > len(a) * 0.9 and 600 < len(data) / len(a) < 2000


def test_compress_pack_extract(spark):
    files = spark.createDataFrame([("p", noise(50_000, 1)), ("q", b"")], "path string, data binary")
    chunks = cdc.chunk_data(files, cdc.ChunkParams(256, 1024, 4096)).cache()
    frames = cdc.compress(chunks.select("chunk", "size", "data"))
    packs = cdc.build_packs(frames.join(chunks.select("chunk", F.lit("s").alias("part"), "pos"), "chunk"), "part", ["pos"], 20_000).orderBy("pack_no").collect()
    assert len(packs) == 3 and all(r.size >= 20_000 for r in packs[:-1])
    good = cdc.extract(frames.withColumnRenamed("size", "usize"))
    assert good.filter("NOT ok").count() == 0
    bad = frames.withColumn("frame", F.lit(b"junk")).withColumnRenamed("size", "usize")
    assert {r.error for r in cdc.extract(bad).collect()} == {"corrupt"}
    wrong = frames.withColumn("chunk", F.lit("0" * 32)).withColumnRenamed("size", "usize")
    assert {r.error for r in cdc.extract(wrong).collect()} == {"mismatch"}
    assert {r.error for r in cdc.extract(frames.withColumn("usize", F.lit(1 << 30))).collect()} == {"oversize"}


def test_references_are_restored(spark):
    a, b = "a" * 32, "b" * 32
    body = b"x" + a.encode() + b"\x00\xff" + b.encode() + a.encode() + b"tail"
    files = spark.createDataFrame([("p", body, [a, b]), ("q", b"none", [])], "path string, data binary, refs array<string>")
    made = refnorm.normalize(files)
    got = {r.path: r for r in made.collect()}
    assert [tuple(x) for x in got["p"].rewrites] == [(1, 0), (35, 1), (67, 0)]
    assert got["p"].data.count(bytes(32)) == 3 and len(got["p"].data) == len(body)
    back = refnorm.restore(made.join(files.select("path", "refs"), "path"))
    assert {r.path: bytes(r.data) for r in back.collect()} == {"p": body, "q": b"none"}
    bad = spark.createDataFrame([("p", bytes(10), [(0, 5)], [a])], f"path string, data binary, rewrites {refnorm.REWRITES}, refs array<string>")
    with pytest.raises(Exception, match="out of range"):
        refnorm.restore(bad).collect()


# -- versions ----------------------------------------------------------------------------------------
def test_versions_commit_in_order(spark, tmp_path):
    store = VersionStore(spark, str(tmp_path), "m3")
    rows = lambda *x: {"packs": spark.createDataFrame([(v,) for v in x], "pack string")}
    assert store.newest() == 0 and store.load() == {}
    assert store.save(lambda cur: rows("a")) == 1
    assert store.save(lambda cur: None) == 1

    def late(cur):
        if store.newest() == 1:  # another writer commits meanwhile
            VersionStore(spark, str(tmp_path), "m3").save(lambda c: {"packs": c["packs"].union(rows("b")["packs"])})
        return {"packs": cur["packs"].union(rows("c")["packs"])}

    assert store.save(late) == 3
    assert sorted(r.pack for r in store.load()["packs"].collect()) == ["a", "b", "c"]
    assert sorted(r.pack for r in store.protected().collect()) == ["a", "b", "c"]
    (tmp_path / "m3#007").mkdir()
    (tmp_path / "m2#9").mkdir()
    assert [n for n, _ in store.versions()] == [1, 2, 3]
    assert store.cleanup(NOW * 2, 3600) == [1, 2] and store.newest() == 3
    assert store.save(lambda cur: cur, floor=9) == 10


def test_damaged_versions(spark, tmp_path):
    store = VersionStore(spark, str(tmp_path), "m3")
    (tmp_path / "m3#1" / "packs").mkdir(parents=True)
    (tmp_path / "m3#1" / "packs" / "x.parquet").write_bytes(b"junk")
    assert store.load() == {}
    with pytest.raises(Exception):
        store.load(strict=True)


def test_version_cleanup_uses_the_family(spark):
    rows = [("m3#1", NOW - 9999), ("m3#2", 0), ("m3#3", NOW - 10), ("m3#4", NOW - 9999), ("m#9", NOW - 9999), ("m3#05", NOW - 9999)]
    df = spark.createDataFrame(rows, "key string, created bigint")
    assert [r.key for r in report.versions_to_delete(df, "m3", NOW, 3600).collect()] == ["m3#1"]

"""Objects, versions, trees and collections, step by step."""

import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from cairn.functions import base32, text
from cairn.operators import cdc, gc, graph, ingest, layout, matrix, serve, trees
from cairn.operators.collector import Collector
from cairn.sources.objects import ObjectStore
from cairn.sources.store import CommitConflict, Served, VersionStore

NOW, DAY = 1_700_000_000, 86400


def objects(spark, tmp_path, rows, now=NOW):
    store = ObjectStore(spark, str(tmp_path / "o"))
    store.put(spark.createDataFrame(rows, "key string, blob binary"), now)
    return store


# -- objects -----------------------------------------------------------------------------
def test_put_if_absent_touch_and_delete(spark, tmp_path):
    store = objects(spark, tmp_path, [("pack-a", b"one"), ("pack-b", b"two")], 10)
    again = spark.createDataFrame([("pack-a", b"one"), ("x", b"")], "key string, blob binary")
    assert store.put(again, 20) == (1, 1)
    seen = {r.key: (r.created, r.accessed, r.size) for r in store.listing().collect()}
    assert seen == {"pack-a": (10, 20, 3), "pack-b": (10, 10, 3), "x": (20, 20, 0)}
    key = spark.createDataFrame([("pack-a",), ("none",)], "key string")
    assert store.delete(key, 30) == 1 and store.delete(key, 31) == 0 and store.touch(key, 32) == 0
    assert store.put(again, 40) == (1, 1)
    assert {r.key: r.created for r in store.listing("pack-").collect()} == {"pack-a": 40, "pack-b": 10}
    assert store.listed("", 2) is None and store.listed("", 3).count() == 3
    assert ObjectStore(spark, store.root, "other").listing().count() == 0


def test_ranges_are_exact(spark, tmp_path):
    store = objects(spark, tmp_path, [("k", bytes(range(100)))])
    read = lambda *r: store.read(spark.createDataFrame(list(r), "key string, start bigint, end bigint")).collect()
    assert [bytes(r.data) for r in read(("k", 3, 7))] == [bytes(range(3, 7))]
    for bad in (("k", 90, 101), ("gone", 0, 1)):
        with pytest.raises(Exception, match="short read"):
            read(bad)


# -- versions -----------------------------------------------------------------------------
def test_versions_served_and_awaited(spark, tmp_path):
    store = VersionStore(spark, str(tmp_path / "v"), "m3")
    one = spark.createDataFrame([("p",)], "path string")
    assert store.save(lambda _: {"paths": one}, floor=4, now=NOW) == 5 and store.versions() == [(5, NOW)]
    assert store.wait_for(5, 0) and not store.wait_for(6, 0.3)
    served = Served(store)
    assert served.set_if_newer(5) and not served.set_if_newer(5) and not served.set_if_newer(3)
    assert served.tables["paths"].count() == 1
    store.save(lambda c: {"paths": c["paths"].union(c["paths"])})
    served.set_version(5)
    assert served.number == 5 and store.fullest() == 6


def test_lost_races_are_counted(spark, tmp_path):
    store = VersionStore(spark, str(tmp_path / "v"), "m3", attempts=3)
    rival = VersionStore(spark, str(tmp_path / "v"), "m3")
    row = spark.createDataFrame([("p",)], "path string")
    turns = []

    def merge(_):
        if len(turns) < 2:
            rival.save(lambda _: {"paths": row})
        turns.append(1)
        return {"paths": row}

    assert store.save(merge) == 3 and store.conflicts == {1: 1, 2: 1}

    def always(_):
        rival.save(lambda _: {"paths": row})
        return {"paths": row}

    with pytest.raises(CommitConflict):
        store.save(always)


# -- collector --------------------------------------------------------------------------------
def stored(spark, tmp_path, packs, live, protected_day=2):
    """A store whose packs hold the given chunk texts; ``live`` are the rooted texts."""
    name = lambda t: hashlib.sha256(t).hexdigest()[:32]
    sha = lambda ts: hashlib.sha256(b"".join(ts)).hexdigest()
    chunks, table, blobs, files = [], [], [], []
    for tier, texts in packs:
        at, pack = 0, sha(texts)
        for t in texts:
            chunks.append((name(t), pack, at, len(t), len(t), 0))
            files.append((f"p-{name(t)}", 0, name(t)))
            at += len(t)
        table.append((pack, at, NOW - 9 * DAY, tier))
        blobs.append((f"pack-{pack}", b"".join(texts), NOW - 9 * DAY, NOW - DAY))
    paths = [(p, "h", 1, NOW - 20 * DAY, NOW - 20 * DAY) for p, _, _ in files]
    roots = [("r", f"p-{name(t)}", NOW) for t in live]
    cat = {
        "paths": spark.createDataFrame(paths, "path string, nar_hash string, nar_size bigint, last_pushed bigint, last_reachable bigint"),
        "references": spark.createDataFrame([], "src string, dst string"),
        "file_chunks": spark.createDataFrame(files, "path string, pos bigint, chunk string"),
        "chunks": spark.createDataFrame(chunks, "chunk string, pack string, offset bigint, csize bigint, usize bigint, survived bigint"),
        "packs": spark.createDataFrame(table, "pack string, size bigint, created bigint, tier int"),
        "roots": spark.createDataFrame(roots, "root_key string, path string, updated bigint"),
    }
    store, objs = VersionStore(spark, str(tmp_path / "v"), "m3"), ObjectStore(spark, str(tmp_path / "o"))
    store.save(lambda _: cat, now=NOW - protected_day * DAY)
    objs.put(spark.createDataFrame(blobs, "key string, blob binary, created bigint, accessed bigint"), NOW)
    return Collector(store, objs, target=100)


def test_thin_packs_are_repacked_then_deleted(spark, tmp_path):
    texts = [bytes([65 + i]) * 40 for i in range(10)]
    c = stored(spark, tmp_path, [(1, texts[:5]), (1, texts[5:])], [texts[0], texts[6], texts[7]])
    assert "repack 1 job(s) (3 chunk(s), 120 B copied)" in c.plan_line(NOW) or "repack 1 job(s)" in c.plan_line(NOW)
    assert set(c.run(NOW, dry_run=True).values()) == {0} and c.store.newest() == 1
    first = c.run(NOW)
    # the old version still refers to the sources, so nothing goes yet
    assert first["version"] == 2 and first["packs_uploaded"] >= 1 and first["packs_deleted"] == 0 and first["versions_deleted"] == 1
    kept = c.store.load(strict=True)
    assert kept["paths"].count() == 3 and kept["chunks"].count() == 3
    later = c.run(NOW + 2 * 3600)
    assert later["orphans_deleted"] == 2 or later["packs_deleted"] == 2
    size = c.objects.listing("pack-").agg(F.sum("size")).first()[0]
    assert size <= 1.2 * 120  # stored over live
    blobs = {r.key[5:] for r in c.objects.listing().collect()}
    assert {r.pack for r in c.store.load()["chunks"].collect()} <= blobs


def test_recent_packs_survive_the_guards(spark, tmp_path):
    texts = [bytes([65 + i]) * 40 for i in range(4)]
    c = stored(spark, tmp_path, [(1, texts[:2]), (1, texts[2:])], [texts[0], texts[1]])
    plan = gc.Plan(c.store.load(), c.objects.observations(), NOW)
    dead = plan.delete_packs.collect()
    assert len(dead) == 1 and plan.apply()["deletable"].count() == 1
    c.objects.touch(spark.createDataFrame([(f"pack-{dead[0].pack}",)], "key string"), NOW - 5)
    plan = gc.Plan(c.store.load(), c.objects.observations(), NOW)
    assert plan.delete_packs.count() == 1 and plan.apply()["deletable"].count() == 0


def test_vanished_sources_are_skipped_and_bad_frames_refused(spark, tmp_path):
    texts = [bytes([65 + i]) * 40 for i in range(10)]
    c = stored(spark, tmp_path, [(1, texts[:5]), (1, texts[5:])], [texts[0], texts[6]])
    copies = c.plan(NOW).copies
    assert copies.count() == 2
    one = copies.orderBy("pack").first().pack
    c.objects.delete(spark.createDataFrame([(f"pack-{one}",)], "key string"))
    made = gc.repack(copies, c.objects, NOW, 100)
    assert made["moved"].count() == 1 and made["moved"].filter(F.col("from_pack") == one).count() == 0
    wrong = copies.withColumn("chunk", F.lit("0" * 32))
    with pytest.raises(Exception, match="corrupt chunk"):
        gc.repack(wrong, c.objects, NOW, 100)["moved"].count()
    long = copies.withColumn("csize", F.lit(4000).cast("bigint"))
    with pytest.raises(Exception, match="short read"):
        gc.repack(long, c.objects, NOW, 100)["moved"].count()


def test_compressed_frames_are_copied_as_they_are(spark, tmp_path):
    import zstandard

    data = [bytes([i]) * 500 + str(i).encode() for i in range(4)]
    frames = [zstandard.ZstdCompressor().compress(x) for x in data]
    store = objects(spark, tmp_path, [("pack-" + "a" * 64, b"".join(frames))])
    at, rows = 0, []
    for x, f in zip(data, frames):
        rows.append((1, "a" * 64, at, cdc.digest(x), len(f), len(x), 3))
        at += len(f)
    copies = spark.createDataFrame(rows[1:], "tier int, pack string, offset bigint, chunk string, csize bigint, usize bigint, survived bigint")
    made = gc.repack(copies, store, NOW, 10_000, gc.zstd_frames)
    pack = made["packs"].collect()
    assert len(pack) == 1 and bytes(pack[0].blob) == b"".join(frames[1:]) and {r.survived for r in made["moved"].collect()} == {4}


def test_greedy_sealing_restarts_at_zero(spark):
    """A pack is sealed by the append that reaches the target; the next starts empty."""
    sizes = [70, 50, 40, 30, 90, 20, 60, 10]
    rows = [(f"c{i}", 0, i, s) for i, s in enumerate(sizes)]
    got = layout.greedy_packs(spark.createDataFrame(rows, "chunk string, b int, i int, size bigint"), "b", ["i"], 100).orderBy("i").collect()
    assert [(r.pack_no, r.offset) for r in got] == [(0, 0), (0, 70), (1, 0), (1, 40), (1, 70), (2, 0), (2, 20), (2, 80)]
    copies = spark.createDataFrame([(1, "p", 100 * i, c, s, 0) for c, _, i, s in rows], "tier int, pack string, offset bigint, chunk string, csize bigint, survived bigint")
    moved, packs = gc.relocate(copies, NOW, 100)
    assert sorted(r["size"] for r in packs.collect()) == [90, 120, 160]
    assert {r.chunk: r.offset for r in moved.collect()}["c7"] == 80


# -- trees ---------------------------------------------------------------------------------
def nodes(spark, *rows):
    return trees.flatten_tree(spark.createDataFrame(list(rows), trees.NODE))


def test_archives_of_known_trees(spark):
    """The empty directory has a well-known digest; others are framed by hand."""
    made = trees.write_archives(nodes(spark, ("e", "", "directory", False, None, None), ("f", "", "regular", True, b"hi", None), ("l", "", "symlink", False, None, "t")))
    got = {r.tree: r for r in made.collect()}
    # fixed value: the digest of an empty directory's archive
    assert base64.b64encode(bytes.fromhex(got["e"].digest)) == b"pQpattmS9VmO3ZIQUFn66az8GSmB4IvYhTTCFn6SUmo="
    s = lambda x: len(x).to_bytes(8, "little") + x + bytes(-len(x) % 8)
    assert bytes(got["f"].blob) == b"".join(map(s, (b"nix-archive-1", b"(", b"type", b"regular", b"executable", b"", b"contents", b"hi", b")")))
    assert bytes(got["l"].blob) == b"".join(map(s, (b"nix-archive-1", b"(", b"type", b"symlink", b"target", b"t", b")")))
    deep = trees.write_archives(nodes(spark, ("d", "b/c/x", "regular", False, b"1", None), ("d", "a", "regular", False, b"", None), ("d", "b-", "directory", False, None, None)))
    entry = lambda n, *body: b"".join(map(s, (b"entry", b"(", b"name", n, b"node"))) + b"".join(body) + s(b")")
    file = lambda x: b"".join(map(s, (b"(", b"type", b"regular", b"contents", x, b")")))
    folder = lambda *e: b"".join(map(s, (b"(", b"type", b"directory"))) + b"".join(e) + s(b")")
    want = s(b"nix-archive-1") + folder(entry(b"a", file(b"")), entry(b"b", folder(entry(b"c", folder(entry(b"x", file(b"1")))))), entry(b"b-", folder()))
    assert bytes(deep.first().blob) == want


def test_event_streams(spark):
    def built(*rows):
        events = spark.createDataFrame([("t", i, k, n) for i, (k, n) in enumerate(rows)], "tree string, seq int, kind string, name string")
        return {(r.path, r.kind) for r in trees.build_tree(events).collect()}

    assert built(("start", "root"), ("regular", "a"), ("start", "d"), ("symlink", "l"), ("end", "d"), ("end", "root")) == {("", "directory"), ("a", "regular"), ("d", "directory"), ("d/l", "symlink")}
    assert built(("regular", "any")) == {("", "regular")}
    for bad, why in (
        ([("end", "x")], "end without start"), ([("start", "x")], "unclosed"), ([("regular", "a"), ("regular", "b")], "multiple root"),
        ([("start", "r"), ("regular", "a"), ("start", "a"), ("end", "a"), ("end", "r")], "duplicate entry"),
    ):
        with pytest.raises(Exception, match=why):
            built(*bad)


def test_files_are_read_where_they_lie(spark, tmp_path):
    top = tmp_path / "tree"
    (top / "sub").mkdir(parents=True)
    (top / "sub" / "a b+.txt").write_bytes(b"abc" * 9000)
    (top / "same").write_bytes(b"abc" * 9000)
    (top / "tool").write_bytes(b"#!")
    marks = spark.createDataFrame([("tool", True, None), ("link", False, "tool")], "path string, executable boolean, target string")
    made = {r.path: r for r in trees.flatten_tree(trees.read_tree(spark, str(top), marks)).collect()}
    assert set(made) == {"", "sub", "sub/a b+.txt", "same", "tool", "link"}
    assert made["tool"].executable and made["link"].kind == "symlink" and made["link"].data is None and made[""].kind == "directory"
    assert bytes(made["sub/a b+.txt"].data) == b"abc" * 9000
    all_, chunks = trees.chunk_path(spark, str(top), cdc.ChunkParams(1 << 10, 4 << 10, 16 << 10))
    assert all_.count() == 5 and {r.path for r in chunks.collect()} <= {"same", "tool"}
    upper = trees.map_contents(all_, lambda x: F.upper(x.cast("string")).cast("binary")).filter("path = 'same'").first()
    assert bytes(upper.data) == b"ABC" * 9000


def test_a_path_without_archive_is_an_error(spark):
    paths = spark.createDataFrame([("p", [], None)], "path string, references array<string>, deriver string")
    none = spark.createDataFrame([], "path string, blob binary")
    with pytest.raises(Exception, match="no archive of p"):
        trees.export_frames(paths, none).collect()
    some = spark.createDataFrame([("p", b"N")], "path string, blob binary")
    s = lambda x: len(x).to_bytes(8, "little") + x + bytes(-len(x) % 8)
    n = lambda x: x.to_bytes(8, "little")
    frame = trees.export_frames(paths, some).first().frame
    assert bytes(frame) == n(1) + b"N" + n(0x4558494E) + s(b"/store/p") + n(0) + s(b"") + n(0)


# -- serving and ingest --------------------------------------------------------------------------
def test_cache_replay_drops_what_never_fits(spark):
    rows = [("c", i, x, s) for i, (x, s) in enumerate([("a", 4), ("b", 4), ("a", 4), ("c", 4), ("b", 4), ("big", 99), ("a", 4), ("big", 99)])]
    df = spark.createDataFrame(rows, "cache string, seq int, item string, size int")
    assert [r.hit for r in serve.lru_replay(df, 10).orderBy("seq").collect()] == [False, False, True, False, False, False, False, False]


def test_only_the_clock_of_the_own_root_is_no_commit(spark, tmp_path):
    store, objs = VersionStore(spark, str(tmp_path / "v"), "m3"), ObjectStore(spark, str(tmp_path / "o"))
    chunk = lambda t: hashlib.sha256(t).hexdigest()[:32]
    files = spark.createDataFrame([("p", 0, chunk(b"ab"), 2, b"ab"), ("p", 1, chunk(b"c"), 1, b"c"), ("q", 0, chunk(b"ab"), 2, b"ab")], "path string, pos bigint, chunk string, size bigint, data binary")
    paths = spark.createDataFrame([("p", "h", 3), ("q", "h2", 2)], "path string, nar_hash string, nar_size bigint")
    root = lambda t, run="r1": spark.createDataFrame([("k", "p", t, run)], "root_key string, path string, updated bigint, run_id string")
    batch = lambda have: (paths.join(have["paths"].select("path"), "path", "left_anti"), files)
    assert ingest.commit_batch(store, objs, batch, root(NOW), NOW, 100) == 1
    assert ingest.commit_batch(store, objs, batch, root(NOW + 9), NOW + 9, 100) == 1
    assert ingest.commit_batch(store, objs, batch, root(NOW + 9, "r2"), NOW + 9, 100) == 2
    cat = store.load()
    assert cat["chunks"].count() == 2 and cat["packs"].count() == 1 and objs.listing("pack-").count() == 1
    assert sorted((r.offset, r.csize) for r in cat["chunks"].collect()) == [(0, 2), (2, 1)]


# -- small ones ------------------------------------------------------------------------------------
def test_strict_rows_and_outputs(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "line_no int, attr string, drv_path string, system string, os array<string>, grp string, unmapped boolean")
    good = [(1, "a", "/d1", "x", ["l"], "g", False), (2, "b", "/d2", "x", ["l"], "g", False), (3, "c", "/d3", "y", ["m"], None, False)]
    assert matrix.checked_rows(rows(*good)).count() == 3
    for bad, why in (((4, "d", "/d", "y", ["l"], "g", False), "systems"), ((4, "d", "/d", "x", ["m"], "g", False), "runners"), ((4, "d", "/d", "z", None, None, True), "no runner")):
        with pytest.raises(matrix.MatrixError, match=why):
            matrix.checked_rows(rows(*good, bad))
    out = spark.createDataFrame([("b", "2"), ("a", "1=1")], "name string, value string")
    matrix.emit_outputs(out, str(tmp_path / "out"))
    matrix.emit_outputs(out.limit(1), str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["a=1=1", "b=2", "b=2"]


def test_names_indices_digests_and_status(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    with pytest.raises(Exception, match="not UTF-8"):
        one(text.name_to_string(F.lit(b"\xff")))
    for bad in ("m3#x", "m2#1", "m3#"):
        with pytest.raises(Exception, match="no index"):
            one(text.lenient_index(F.lit(bad), "m3"))
    assert one(text.lenient_index(F.lit("m3#007"), "m3")) == 7
    digest = hashlib.sha256(b"x").digest()
    spelled = spark.createDataFrame([(base32.encode(digest),), ("zz",), (None,)], "s string")
    assert [r.h for r in spelled.select(base32.base32_to_hex("s").alias("h")).collect()] == [digest.hex(), None, None]
    assert [one(ingest.outcome_status(F.lit(a), F.lit(b))) for a, b in ((0, 0), (1, 0), (0, 2), (None, None))] == [0, 1, 1, 0]
    assert ingest.is_populated(spark.range(2)) and not ingest.is_populated(spark.range(0))


def test_order_of_a_deep_closure(spark):
    """Six hundred references deep: references before referrers, each once."""
    rows = [(f"{i:04d}", f"{i + 1:04d}") for i in range(600)] + [("0003", "0001"), ("0002", "0002")]
    edges = spark.createDataFrame(rows, "src string, dst string")
    inside = spark.createDataFrame([(f"{i:04d}",) for i in range(601)], "path string")
    order = graph.closure_order(edges, inside, spark.createDataFrame([("0590",), ("0595",)], "path string")).orderBy("ordinal").collect()
    assert [r.path for r in order] == [f"{i:04d}" for i in range(600, 589, -1)]

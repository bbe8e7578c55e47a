"""DuckDB SQL for the catalog queries, built from shared table expressions.

The derivations and operators are written out here a second time, in another dialect and
without a look at the DataFrame code: agreement is the check.
"""

from __future__ import annotations

NOW = 1706659200
_KEY = "substr(sha256('doc-' || {}), 1, 32)"
_DOC = _KEY.format("doc_id")

# name -> (table expressions it needs, its own SQL)
CTE: dict[str, tuple[list[str], str]] = {
    "p": ([], f"SELECT doc_id, {_DOC} AS path, sha256(text) AS nar_hash, strlen(text) AS nar_size, {NOW} - (doc_id % 40) * 86400 AS last_pushed, {NOW} - (doc_id % 10) * 86400 AS last_reachable FROM documents"),
    "e": ([], f"SELECT DISTINCT {_DOC} AS src, {_KEY.format('t')} AS dst FROM (SELECT doc_id, unnest([doc_id // 3, doc_id // 5 + 1, CASE WHEN doc_id % 10 = 0 THEN doc_id + 10000000 END]) AS t FROM documents) WHERE t IS NOT NULL"),
    "fc": ([], f"SELECT doc_id, source, lang, {_DOC} AS path, pos, substr(sha256(data), 1, 32) AS chunk, strlen(data) AS size, data FROM (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS data, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents) WHERE data <> ''"),
    "fs": (["fc"], "SELECT chunk, doc_id, pos, source, size FROM fc QUALIFY row_number() OVER (PARTITION BY chunk ORDER BY doc_id, pos) = 1"),
    "l0": (["fs"], "SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY doc_id, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ran FROM fs"),
    "loc": (["l0"], "SELECT chunk, sha256(source || '-' || k) AS pack, ran - min(ran) OVER (PARTITION BY source, k) AS \"offset\", size AS csize, 2 * size AS usize, doc_id % 3 AS survived, k FROM (SELECT *, ran // 20000 AS k FROM l0)"),
    "pk": (["loc"], f"SELECT pack, k, CAST(sum(csize) AS BIGINT) AS size, CASE WHEN k % 6 = 5 THEN {NOW} - 60 ELSE {NOW} - (k * 5) % 30 * 86400 - 7200 END AS created, CASE WHEN k % 4 = 0 THEN 0 ELSE 1 END AS tier FROM loc GROUP BY pack, k"),
    "rm": ([], f"SELECT source || '-' || lang AS root_key, {_DOC} AS path, {NOW} - CAST(substr(source, 4) AS BIGINT) * 86400 AS updated, 'run-' || doc_id % 3 AS run_id FROM documents WHERE doc_id % 7 = 0"),
    "ob": (["pk"], f"""SELECT 'pack-' || pack AS key, created, CASE WHEN k % 5 = 0 THEN 0 ELSE {NOW} - k % 8 * 86400 END AS last_accessed FROM pk WHERE k % 9 <> 4
        UNION ALL SELECT 'pack-' || pack, created, {NOW} - 6 * 86400 FROM pk WHERE k % 9 <> 4 AND k % 3 = 0
        UNION ALL SELECT CASE WHEN p_partkey % 4 = 0 THEN 'pack-' || p_partkey ELSE 'pack-' || sha256('orphan-' || p_partkey) END, {NOW} - p_partkey % 3 * 86400,
          CASE WHEN p_partkey % 5 = 0 THEN {NOW} - 60 ELSE {NOW} - p_partkey % 9 * 86400 END FROM part"""),
    "op": (["ob"], "SELECT *, substr(key, 6) AS pack FROM ob WHERE regexp_full_match(key, 'pack-[0-9a-f]{64}')"),
    "lru": (["op"], "SELECT pack, coalesce(min(nullif(last_accessed, 0)), 0) AS lru FROM op GROUP BY pack"),
    "rc": ([], ""),  # filled in by recent()
    "rch": (["p", "e", "rm"], "SELECT path FROM rm UNION SELECT e.dst FROM rch JOIN e ON e.src = rch.path JOIN p ON p.path = e.dst"),
    "lvl": (["p", "e", "rm"], "SELECT path, 0 AS level FROM rm UNION SELECT e.dst, level + 1 FROM lvl JOIN e ON e.src = lvl.path JOIN p ON p.path = e.dst WHERE level < 40"),
    # collector
    "ev": (["pk", "lru"], f"SELECT pack FROM pk WHERE greatest({NOW} - created, 0) > 3600 AND pack NOT IN (SELECT pack FROM lru)"),
    "ch": (["loc", "ev"], "SELECT * FROM loc WHERE pack NOT IN (SELECT pack FROM ev)"),
    "pks": (["pk", "ev"], "SELECT * FROM pk WHERE pack NOT IN (SELECT pack FROM ev)"),
    "heal": (["fc", "ch"], "SELECT DISTINCT path FROM fc WHERE chunk NOT IN (SELECT chunk FROM ch)"),
    "dr": (["rm"], f"SELECT DISTINCT root_key FROM rm WHERE greatest({NOW} - updated, 0) > 14 * 86400"),
    "gp": (["p", "heal"], "SELECT * FROM p WHERE path NOT IN (SELECT path FROM heal)"),
    "gr": (["gp", "rm", "dr", "e"], "SELECT path FROM rm WHERE root_key NOT IN (SELECT root_key FROM dr) AND path IN (SELECT path FROM gp) UNION SELECT e.dst FROM gr JOIN e ON e.src = gr.path JOIN gp ON gp.path = e.dst"),
    "dp": (["gp", "gr"], f"SELECT path FROM gp WHERE path NOT IN (SELECT path FROM gr) AND greatest({NOW} - last_reachable, 0) > 72 * 3600 AND greatest({NOW} - last_pushed, 0) > 14 * 86400"),
    "lc": (["fc", "dp", "heal"], "SELECT DISTINCT chunk FROM fc WHERE path NOT IN (SELECT path FROM dp) AND path NOT IN (SELECT path FROM heal)"),
    "st": (["pks", "ch", "lc"], "SELECT pks.pack, pks.tier, CAST(sum(csize) AS BIGINT) AS chunk_bytes, CAST(coalesce(sum(csize) FILTER (WHERE lc.chunk IS NOT NULL), 0) AS BIGINT) AS live_bytes, count(lc.chunk) AS live_chunks FROM pks JOIN ch ON ch.pack = pks.pack LEFT JOIN lc ON lc.chunk = ch.chunk GROUP BY pks.pack, pks.tier"),
    "src": (["st"], "SELECT * FROM st WHERE live_chunks > 0 AND (live_bytes < 0.5 * chunk_bytes OR (tier = 0 AND (SELECT count(*) FROM st WHERE tier = 0 AND live_chunks > 0) > 4))"),
    "srcq": (["st"], "SELECT * FROM st WHERE live_chunks > 0 AND live_bytes < 0.5 * chunk_bytes"),
    "cp0": (["ch", "src", "lc"], "SELECT CASE WHEN survived + 1 >= 2 THEN 1 ELSE 0 END AS tier, ch.pack, \"offset\", ch.chunk, csize, survived, src.chunk_bytes AS cb, src.live_bytes = src.chunk_bytes AS fl FROM ch JOIN src ON src.pack = ch.pack WHERE ch.chunk IN (SELECT chunk FROM lc)"),
    "cp": (["cp0"], "SELECT * FROM cp0 WHERE tier NOT IN (SELECT tier FROM cp0 GROUP BY tier HAVING count(DISTINCT pack) = 1 AND bool_and(fl) AND sum(csize) = any_value(cb))"),
    "cpq0": (["ch", "srcq", "lc"], "SELECT CASE WHEN survived + 1 >= 2 THEN 1 ELSE 0 END AS tier, ch.pack, csize, srcq.chunk_bytes AS cb, srcq.live_bytes = srcq.chunk_bytes AS fl FROM ch JOIN srcq ON srcq.pack = ch.pack WHERE ch.chunk IN (SELECT chunk FROM lc)"),
    "cpq": (["cpq0"], "SELECT * FROM cpq0 WHERE tier NOT IN (SELECT tier FROM cpq0 GROUP BY tier HAVING count(DISTINCT pack) = 1 AND bool_and(fl) AND sum(csize) = any_value(cb))"),
    "del": (["st", "cp"], "SELECT pack FROM st WHERE live_chunks = 0 UNION SELECT pack FROM cp"),
    "delq": (["st", "cpq"], "SELECT pack FROM st WHERE live_chunks = 0 UNION SELECT pack FROM cpq"),
    "tch": (["st", "cp", "lru"], f"SELECT pack, tier, live_bytes FROM st JOIN lru USING (pack) WHERE live_chunks > 0 AND pack NOT IN (SELECT pack FROM cp) AND lru <> 0 AND greatest({NOW} - lru, 0) > 4 * 86400"),
    "tchq": (["st", "cpq", "lru"], f"SELECT pack, tier, live_bytes FROM st JOIN lru USING (pack) WHERE live_chunks > 0 AND pack NOT IN (SELECT pack FROM cpq) AND lru <> 0 AND greatest({NOW} - lru, 0) > 4 * 86400"),
    "orp": (["op", "pk", "rc"], "SELECT DISTINCT key FROM op WHERE pack NOT IN (SELECT pack FROM pk) AND pack NOT IN (SELECT pack FROM rc)"),
    # where copies go: per tier in order, sealed once an append reaches the target
    "cpo": (["cp"], 'SELECT *, row_number() OVER (PARTITION BY tier ORDER BY pack, "offset") AS rn FROM cp'),
    "pl": (["cpo"], """SELECT tier, chunk, pack, rn, 0::BIGINT AS no, 0::BIGINT AS offs, csize, survived FROM cpo WHERE rn = 1
        UNION ALL SELECT c.tier, c.chunk, c.pack, c.rn, CASE WHEN pl.offs + pl.csize >= 20000 THEN pl.no + 1 ELSE pl.no END,
          CASE WHEN pl.offs + pl.csize >= 20000 THEN 0 ELSE pl.offs + pl.csize END, c.csize, c.survived FROM pl JOIN cpo c ON c.tier = pl.tier AND c.rn = pl.rn + 1"""),
    "np": (["pl"], "SELECT tier, no, sha256(string_agg(chunk, ',' ORDER BY offs)) AS pack, CAST(sum(csize) AS BIGINT) AS size FROM pl GROUP BY tier, no"),
    "apc": (["ch", "lc", "pl", "np"], """SELECT ch.chunk, coalesce(np.pack, ch.pack) AS pack, coalesce(pl.offs, ch."offset") AS "offset", ch.csize, ch.survived + CASE WHEN pl.chunk IS NULL THEN 0 ELSE 1 END AS survived
        FROM ch LEFT JOIN pl ON pl.chunk = ch.chunk LEFT JOIN np ON np.tier = pl.tier AND np.no = pl.no WHERE ch.chunk IN (SELECT chunk FROM lc)"""),
    "prt": (["pk"], "SELECT pack FROM pk WHERE k % 4 = 1"),
    "delp": (["del", "prt", "apc", "rc"], "SELECT pack FROM del WHERE pack NOT IN (SELECT pack FROM prt) AND pack NOT IN (SELECT pack FROM apc) AND pack NOT IN (SELECT pack FROM rc)"),
    # bytes of chunks, and copies whose source has an object
    "dat": (["fc"], "SELECT chunk, any_value(data) AS data FROM fc GROUP BY chunk"),
    "bpk": (["pl", "dat"], "SELECT tier, no, sha256(string_agg(data, '' ORDER BY offs)) AS pack, CAST(sum(csize) AS BIGINT) AS size FROM pl JOIN dat USING (chunk) GROUP BY tier, no"),
    # spans with gaps, and the reads for them
    "sp": (["loc"], "SELECT * FROM (SELECT *, max(\"offset\" + csize) OVER (PARTITION BY pack) AS pack_end FROM loc) WHERE CAST('0x' || substr(chunk, 1, 4) AS BIGINT) % 3 <> 0"),
    "rn1": (["sp"], "SELECT *, sum(CASE WHEN \"offset\" <= reach + 256 THEN 0 ELSE 1 END) OVER (PARTITION BY pack ORDER BY \"offset\") AS run FROM (SELECT *, max(\"offset\" + csize) OVER (PARTITION BY pack ORDER BY \"offset\" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sp)"),
    "rn2": (["rn1"], "SELECT pack, min(\"offset\") AS s, greatest(max(\"offset\" + csize), least(min(\"offset\") + 2048, max(pack_end))) AS t FROM rn1 GROUP BY pack, run"),
    "rd": (["rn2"], "SELECT pack, min(s) AS \"start\", max(t) AS \"end\" FROM (SELECT *, sum(CASE WHEN s <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY pack ORDER BY s) AS run FROM (SELECT *, max(t) OVER (PARTITION BY pack ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM rn2)) GROUP BY pack, run"),
    # ingest
    "rq": ([], f"SELECT DISTINCT CASE WHEN user_id % 41 = 0 THEN 'bad-' || user_id ELSE {_KEY.format('user_id')} END AS path FROM events WHERE event_type IN ('purchase', 'signup')"),
    "inf": (["p"], "SELECT path, nar_size, doc_id % 6 = 0 AS signed FROM p WHERE doc_id % 8 <> 7"),
    "by": (["p", "e"], f"SELECT path FROM p WHERE doc_id % 97 = 0 UNION SELECT e.dst FROM \"by\" JOIN e ON e.src = \"by\".path JOIN p ON p.path = e.dst"),
    "lk": (["rq", "inf"], "SELECT rq.path, nar_size, signed, CASE WHEN NOT regexp_full_match(rq.path, '[0-9a-f]{32}') THEN 'malformed' WHEN inf.path IS NULL THEN 'unknown' ELSE 'found' END AS status FROM rq LEFT JOIN inf ON inf.path = rq.path"),
    "oc": (["lk", "p", "by"], "SELECT path, nar_size, CASE WHEN status <> 'found' THEN status WHEN path IN (SELECT path FROM p WHERE doc_id % 4 = 0) THEN 'bump' WHEN signed AND path NOT IN (SELECT path FROM \"by\") THEN 'upstream' ELSE 'push' END AS outcome FROM lk"),
    # matrix
    "jl": ([], """SELECT p_partkey AS line_no, '{"attr":"a.' || p_partkey || '","drvPath":"/store/' || p_partkey % 700 || '.drv","system":"' ||
        ['x86_64-linux', 'aarch64-linux', 'aarch64-darwin', 'riscv64-linux'][p_partkey % 4 + 1] || '","isCached":' || (p_partkey % 11 = 0) || ',"meta":{"build":{"x":0' ||
        CASE WHEN p_partkey % 26 = 0 THEN ',"os":["big","fast"]' WHEN p_partkey % 13 = 0 THEN ',"os":"custom"' ELSE '' END ||
        CASE WHEN p_partkey % 5 = 0 THEN ',"group":"g' || p_partkey % 40 || '"' ELSE '' END || '}}}' AS line FROM part"""),
    "jb": (["jl"], """SELECT line_no, json_extract_string(line, '$.attr') AS attr, json_extract_string(line, '$.drvPath') AS drv_path, json_extract_string(line, '$.system') AS system,
        CAST(json_extract(line, '$.isCached') AS BOOLEAN) AS cached, json_extract_string(line, '$.meta.build.group') AS grp,
        CASE json_type(line, '$.meta.build.os') WHEN 'ARRAY' THEN CAST(json_extract(line, '$.meta.build.os') AS VARCHAR[]) WHEN 'VARCHAR' THEN [json_extract_string(line, '$.meta.build.os')] END AS ovr FROM jl"""),
    "mr": (["jb"], """SELECT line_no, 'checks.' || attr AS attr, drv_path, system, grp, coalesce(ovr, CASE system WHEN 'x86_64-linux' THEN ['self-hosted', 'x64'] WHEN 'aarch64-linux' THEN ['ubuntu-24.04-arm'] WHEN 'aarch64-darwin' THEN ['macos-latest'] END) AS os
        FROM (SELECT *, row_number() OVER (PARTITION BY drv_path ORDER BY line_no) AS n FROM jb) WHERE n = 1 AND NOT cached"""),
    "mg": (["mr"], """SELECT min(line_no) AS line_no, arg_min(coalesce(grp, attr), line_no) AS name, arg_min(attr, line_no) AS attr, arg_min(drv_path, line_no) AS drv_path, arg_min(system, line_no) AS system, arg_min(os, line_no) AS os,
        string_agg(drv_path || '^*', ' ' ORDER BY line_no) AS installables, count(DISTINCT system) > 1 OR count(DISTINCT array_to_string(os, ',')) > 1 AS mixed
        FROM mr WHERE os IS NOT NULL GROUP BY coalesce('g:' || grp, 'j:' || line_no)"""),
}
CTE["rc"] = (["op"], f"SELECT pack FROM op GROUP BY pack HAVING bool_or(created = 0 OR last_accessed = 0) OR greatest({NOW} - max(greatest(created, last_accessed)), 0) <= 3600")


def sql(body: str, *needs: str, **own: tuple[list[str], str]) -> str:
    """``body`` behind the table expressions it needs, each once and in order."""
    table = CTE | own
    out: list[str] = []

    def add(name: str) -> None:
        if name not in out:
            for n in table[name][0]:
                add(n)
            out.append(name)

    for n in needs:
        add(n)
    listed = ",\n".join(f'"{n}" AS ({table[n][1]})' for n in out)
    return f"WITH RECURSIVE {listed}\n{body}" if out else body


#: The listing of a store whose packs are objects (none twice), and the copies whose source
#: still has its object.
STORED = {
    "ob": (["pk"], f"""SELECT 'pack-' || pack AS key, created, CASE WHEN k % 5 = 0 THEN 0 ELSE {NOW} - k % 8 * 86400 END AS last_accessed FROM pk WHERE k % 9 <> 4
        UNION ALL SELECT CASE WHEN p_partkey % 4 = 0 THEN 'pack-' || p_partkey ELSE 'pack-' || sha256('orphan-' || p_partkey) END, {NOW} - p_partkey % 3 * 86400,
          CASE WHEN p_partkey % 5 = 0 THEN {NOW} - 60 ELSE {NOW} - p_partkey % 9 * 86400 END FROM part"""),
    "cpo": (["cp", "lru"], 'SELECT *, row_number() OVER (PARTITION BY tier ORDER BY pack, "offset") AS rn FROM cp WHERE pack IN (SELECT pack FROM lru)'),
}


ORACLES: dict[str, str] = {
    "live_set_by_root": sql(
        "SELECT root_key, count(*) AS paths, CAST(sum(nar_size) AS BIGINT) AS bytes FROM rm JOIN p USING (path) GROUP BY root_key UNION ALL SELECT '(all)', count(*), CAST(sum(nar_size) AS BIGINT) FROM p WHERE path IN (SELECT path FROM rch)", "rch"),
    "reachable_paths": sql("SELECT path, CAST(min(level) AS BIGINT) AS level FROM lvl GROUP BY path", "lvl"),
    "mark_reachable": sql(f"SELECT path, CASE WHEN path IN (SELECT path FROM rch) THEN greatest(last_reachable, {NOW}) ELSE last_reachable END AS last_reachable FROM p", "rch"),
    "closure_with_status": sql("SELECT path, CASE WHEN path IN (SELECT path FROM p) THEN 'found' ELSE 'unknown' END AS status FROM c", "c",
        c=(["p", "e"], "SELECT path FROM p WHERE doc_id % 50 = 0 UNION SELECT e.dst FROM c JOIN e ON e.src = c.path")),
    "closure_levels": sql("SELECT p.path, CAST(coalesce(max(h.level), 0) AS BIGINT) AS level FROM p LEFT JOIN h ON h.path = p.path GROUP BY p.path", "p", "h",
        g=([], f"SELECT DISTINCT {_DOC} AS src, {_KEY.format('t')} AS dst FROM (SELECT doc_id, unnest([doc_id // 3, CASE WHEN doc_id // 5 + 1 < doc_id THEN doc_id // 5 + 1 END]) AS t FROM documents) WHERE t < doc_id"),
        h=(["p", "g"], "SELECT path, 0 AS level FROM p UNION SELECT g.src, h.level + 1 FROM h JOIN g ON g.dst = h.path")),
    "drv_bypass": sql('SELECT path FROM "by"', "by"),
    "chunk_dedup_ratio": sql("SELECT CAST(sum(n) AS BIGINT) AS chunks, count(*) AS unique_chunks, CAST(sum(n * size) AS BIGINT) AS bytes, CAST(sum(size) AS BIGINT) AS unique_bytes FROM (SELECT chunk, count(*) AS n, min(size) AS size FROM fc GROUP BY chunk)", "fc"),
    "dedup_by_lang": sql("SELECT lang, CAST(sum(n) AS BIGINT) AS chunks, count(*) AS unique_chunks, CAST(sum(n * size) AS BIGINT) AS bytes, CAST(sum(size) AS BIGINT) AS unique_bytes FROM (SELECT lang, chunk, count(*) AS n, min(size) AS size FROM fc GROUP BY lang, chunk) GROUP BY lang", "fc"),
    "new_bytes_per_generation": sql("SELECT source, count(*) AS new_chunks, CAST(sum(size) AS BIGINT) AS new_bytes FROM (SELECT chunk, min(source) AS source, min(size) AS size FROM fc GROUP BY chunk) GROUP BY source", "fc"),
    "last_generations": "SELECT 'system-' || p_partkey || '-link' AS name, p_partkey AS number FROM part WHERE p_partkey % 7 <> 0 ORDER BY p_partkey DESC LIMIT 5",
    "first_seen_chunks": sql("SELECT chunk, doc_id, pos FROM fs", "fs"),
    "new_chunks": sql("SELECT DISTINCT chunk, size FROM fc WHERE doc_id % 2 = 1 AND chunk NOT IN (SELECT chunk FROM fc WHERE doc_id % 2 = 0)", "fc"),
    "wire_encode_locations": sql('SELECT pack, dense_rank() OVER (ORDER BY pack) - 1 AS pack_index, row_number() OVER w - 1 AS seq, chunk, "offset" - lag("offset", 1, 0) OVER w AS delta, csize FROM loc WINDOW w AS (PARTITION BY pack ORDER BY "offset", chunk)', "loc"),
    "wire_decode_locations": sql('SELECT pack, chunk, "offset", csize FROM loc', "loc"),
    "pack_layout_greedy": sql('SELECT source, chunk, no AS pack_no, off AS "offset" FROM g', "g",
        o=(["fs"], "SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, pos) AS rn FROM fs"),
        g=(["o"], "SELECT source, chunk, rn, 0::BIGINT AS no, 0::BIGINT AS off, size FROM o WHERE rn = 1 UNION ALL SELECT o.source, o.chunk, o.rn, CASE WHEN g.off + g.size >= 20000 THEN g.no + 1 ELSE g.no END, CASE WHEN g.off + g.size >= 20000 THEN 0 ELSE g.off + g.size END, o.size FROM g JOIN o ON o.source = g.source AND o.rn = g.rn + 1")),
    "pack_index": sql('SELECT pack, count(*) AS spans, arg_max("offset" + csize, "offset") AS "end", string_agg(chunk, \',\' ORDER BY "offset") AS chunks FROM loc GROUP BY pack', "loc"),
    "adjacent_runs": sql('SELECT pack, min("offset") AS "start", CAST(sum(csize) AS BIGINT) AS size, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY pack ORDER BY "offset") AS run FROM (SELECT *, CASE WHEN "offset" = lag("offset" + csize) OVER (PARTITION BY pack ORDER BY "offset") THEN 0 ELSE 1 END AS new FROM sp)) GROUP BY pack, run', "sp"),
    "pack_read_plan": sql('SELECT pack, "start", "end" FROM rd', "rd"),
    "chunks_in_reads": sql('SELECT loc.pack, chunk, "offset", csize, rd."start" AS read_start FROM loc JOIN rd ON rd.pack = loc.pack AND "offset" >= rd."start" AND "offset" + csize <= rd."end"', "loc", "rd"),
    "export_windows": sql('SELECT source, path, no AS "window" FROM g', "g",
        o=(["p"], "SELECT d.source, p.path, p.nar_size AS size, row_number() OVER (PARTITION BY d.source ORDER BY d.doc_id) AS rn FROM documents d JOIN p USING (doc_id)"),
        g=(["o"], "SELECT source, path, rn, 0::BIGINT AS no, size AS total FROM o WHERE rn = 1 UNION ALL SELECT o.source, o.path, o.rn, CASE WHEN g.total + o.size > 8192 THEN g.no + 1 ELSE g.no END, CASE WHEN g.total + o.size > 8192 THEN o.size ELSE g.total + o.size END FROM g JOIN o ON o.source = g.source AND o.rn = g.rn + 1")),
    "layout_dump": sql("SELECT p.path, coalesce(layout, '') AS layout, coalesce(refs, '') AS refs FROM p LEFT JOIN a ON a.path = p.path LEFT JOIN b ON b.path = p.path", "p", "a", "b",
        a=(["fc", "loc"], "SELECT path, string_agg(substr(pack, 1, 8) || '@' || \"offset\", ' ' ORDER BY pos) AS layout FROM fc JOIN loc USING (chunk) GROUP BY path"),
        b=(["e", "p"], "SELECT src AS path, string_agg(dst, ' ' ORDER BY dst) AS refs FROM e WHERE src <> dst AND dst IN (SELECT path FROM p) GROUP BY src")),
    "merge_paths": sql("SELECT path, arg_max(nar_hash, row(last_pushed, nar_hash, nar_size)) AS nar_hash, arg_max(nar_size, row(last_pushed, nar_hash, '{\"nar_hash\":\"' || nar_hash || '\",\"nar_size\":' || nar_size || '}')) AS nar_size, max(last_pushed) AS last_pushed, max(last_reachable) AS last_reachable FROM v GROUP BY path", "v",
        v=(["p"], "SELECT path, nar_hash, nar_size + i AS nar_size, last_pushed + (doc_id * (i + 1)) % 3 AS last_pushed, last_reachable + (doc_id * (i + 2)) % 5 AS last_reachable FROM p, range(3) t(i) WHERE (doc_id + i) % 3 <> 0")),
    "merge_chunks": sql('SELECT chunk, m.pack AS pack, m."offset" AS "offset", m.csize AS csize, m.usize AS usize, m.survived AS survived FROM (SELECT chunk, max({survived: survived, pack: pack, "offset": "offset", csize: csize, usize: usize}) AS m FROM v GROUP BY chunk)', "v",
        v=(["loc"], 'SELECT chunk, CASE WHEN i = 2 THEN sha256(pack) ELSE pack END AS pack, "offset" + i AS "offset", csize, usize, (survived * (i + 1)) % 4 AS survived FROM loc, range(3) t(i)')),
    "merge_packs": sql("SELECT pack, max(size - i) AS size, min(created + i * k) AS created, CAST(max((tier + i) % 2) AS INTEGER) AS tier FROM pk, range(3) t(i) GROUP BY pack", "pk"),
    "merge_roots": sql("SELECT DISTINCT v.root_key, v.path, w.updated, w.run_id FROM v JOIN w ON w.root_key = v.root_key AND w.run_id = v.run_id", "v", "w",
        v=(["rm"], "SELECT root_key, path, updated + (length(root_key) * (i + 1)) % 2 AS updated, 'run-' || i // 2 AS run_id, i FROM rm, range(3) t(i) WHERE CAST('0x' || substr(path, 1, 2) AS BIGINT) % 3 <> i"),
        w=(["v"], "SELECT root_key, m.updated AS updated, m.run_id AS run_id FROM (SELECT root_key, max({updated: updated, run_id: run_id}) AS m FROM v GROUP BY root_key)")),
    "observed_lru": sql("SELECT pack, lru FROM lru", "lru"),
    "recent_packs": sql(f"SELECT pack FROM op GROUP BY pack HAVING bool_or(created = 0 OR last_accessed = 0) OR greatest({NOW} - max(greatest(created, last_accessed)), 0) <= 86400", "op"),
    "protected_packs": sql("SELECT pack FROM pk WHERE k % 3 = 0 OR k % 2 = 0", "pk"),
    "gc_evicted": sql("SELECT pack FROM ev", "ev"),
    "gc_heal": sql("SELECT path FROM heal", "heal"),
    "gc_drop_roots": sql("SELECT root_key FROM dr", "dr"),
    "gc_drop_paths": sql("SELECT path FROM dp", "dp"),
    "gc_pack_liveness": sql("SELECT pack, tier, chunk_bytes, live_bytes, live_chunks, live_bytes = chunk_bytes AS fully_live FROM st", "st"),
    "gc_repack_copies": sql('SELECT tier, pack, "offset", chunk, csize FROM cp', "cp"),
    "gc_delete_packs": sql("SELECT pack FROM delq", "delq"),
    "gc_touch_packs": sql("SELECT pack, row_number() OVER (ORDER BY tier, live_bytes, pack) - 1 AS ordinal FROM tchq", "tchq"),
    "gc_orphans": sql("SELECT key FROM orp", "orp"),
    "gc_plan_summary": sql("""SELECT 'download_bytes' AS measure, CAST(coalesce(sum(csize), 0) AS BIGINT) AS value FROM cp UNION ALL SELECT 'evicted', count(*) FROM ev UNION ALL SELECT 'heal', count(*) FROM heal
        UNION ALL SELECT 'drop_roots', count(*) FROM dr UNION ALL SELECT 'drop_paths', count(*) FROM dp UNION ALL SELECT 'repack_jobs', count(DISTINCT tier) FROM cp UNION ALL SELECT 'repack_copies', count(*) FROM cp UNION ALL SELECT 'delete_packs', count(*) FROM del
        UNION ALL SELECT 'touch_packs', count(*) FROM tch UNION ALL SELECT 'orphans', count(*) FROM orp""", "cp", "ev", "heal", "dr", "dp", "del", "tch", "orp"),
    "gc_delete_packs_default": sql("SELECT pack FROM del", "del"),
    "gc_touch_packs_default": sql("SELECT pack, row_number() OVER (ORDER BY tier, live_bytes, pack) - 1 AS ordinal FROM tch", "tch"),
    "gc_plan_line": sql("""SELECT 'evicted ' || (SELECT count(*) FROM ev) || ' pack(s); heal ' || (SELECT count(*) FROM heal) || ' path(s); drop ' || (SELECT count(*) FROM dr) || ' root(s) + ' ||
        (SELECT count(*) FROM dp) || ' path(s); repack ' || (SELECT count(DISTINCT tier) FROM cp) || ' job(s) (' || (SELECT count(*) FROM cp) || ' chunk(s), ' || (SELECT hb(b) FROM (SELECT CAST(sum(csize) AS BIGINT) AS b FROM cp)) ||
        ' copied); touch ' || (SELECT count(*) FROM tch) || ' pack(s); delete ' || (SELECT count(*) FROM del) || ' pack(s) + ' || (SELECT count(*) FROM orp) || ' orphan(s)' AS line""", "cp", "ev", "heal", "dr", "dp", "del", "tch", "orp"),
    "gc_apply_chunks": sql('SELECT chunk, pack, "offset", csize, survived FROM apc', "apc"),
    "gc_apply_repacked": sql(f"SELECT pack, size, created, tier FROM pks WHERE pack IN (SELECT pack FROM apc) UNION ALL SELECT pack, size, {NOW}, tier FROM np", "pks", "apc", "np"),
    "gc_guarded_deletes": sql("SELECT pack FROM delp", "delp"),
    "gc_retained_orphans": sql("""SELECT DISTINCT key FROM ob WHERE NOT regexp_full_match(key, 'pack-[0-9a-f]{64}') OR (substr(key, 6) NOT IN (SELECT pack FROM prt)
        AND substr(key, 6) NOT IN (SELECT pack FROM pks WHERE pack IN (SELECT pack FROM ch WHERE chunk IN (SELECT chunk FROM lc))))""", "ob", "prt", "pks", "ch", "lc"),
    "gc_repacked_packs": sql("SELECT pack, size, tier FROM bpk", "bpk", **STORED),
    "gc_run": sql("""SELECT 'packs_uploaded' AS measure, count(*) AS value FROM bpk UNION ALL SELECT 'bytes_downloaded', CAST(sum(size) AS BIGINT) FROM bpk UNION ALL SELECT 'bytes_uploaded', CAST(sum(size) AS BIGINT) FROM bpk
        UNION ALL SELECT 'packs_touched', count(*) FROM tch UNION ALL SELECT 'packs_deleted', 0 UNION ALL SELECT 'orphans_deleted', count(*) FROM orp UNION ALL SELECT 'versions_deleted', 1 UNION ALL SELECT 'version', 2""", "bpk", "tch", "orp", **STORED),
    "gc_run_chunks": sql('SELECT chunk, pack, "offset", csize, survived FROM apc', "apc", **STORED, np=(["bpk"], "SELECT tier, no, pack, size FROM bpk")),
    "gc_report_line": """SELECT p_partkey, 'uploaded ' || p_partkey % 4 || ' pack(s) (' || hb(b) || ' down, ' || hb(u) || ' up); touched ' || p_partkey % 3 || ' pack(s); deleted ' || p_partkey % 5 || ' pack(s), ' || p_partkey % 2 || ' orphan(s), ' ||
        p_partkey % 6 || ' old manifest version(s); manifest version: ' || CASE WHEN p_partkey % 7 = 0 THEN 'unchanged' ELSE CAST(p_partkey % 7 AS VARCHAR) END AS line FROM (SELECT p_partkey, p_partkey * 4571 AS b, p_partkey * 7 AS u FROM part)""",
    "gc_apply_packs": sql("SELECT pack, size, created, tier FROM pks WHERE pack IN (SELECT pack FROM ch WHERE chunk IN (SELECT chunk FROM lc))", "pks", "ch", "lc"),
    "manifest_versions_to_delete": """SELECT 'm3#' || p_partkey AS key, p_partkey AS idx FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 5 <> 0 AND p_partkey % 9 <> 0 AND p_partkey * 120 > 3600
        AND p_partkey < (SELECT max(p_partkey) FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 5 <> 0)""",
    "lookup_status": sql("SELECT path, status, nar_size FROM lk", "lk"),
    "drain_classify": sql("SELECT path, outcome FROM oc", "oc"),
    "drain_stats": sql("SELECT count(*) FILTER (WHERE outcome = 'push') AS pushed, count(*) FILTER (WHERE outcome = 'bump') AS skipped_existing, count(*) FILTER (WHERE outcome = 'upstream') AS skipped_upstream, count(*) FILTER (WHERE outcome = 'unknown') AS \"unknown\", count(*) FILTER (WHERE outcome = 'malformed') AS malformed, CAST(coalesce(sum(nar_size) FILTER (WHERE outcome = 'push'), 0) AS BIGINT) AS pushed_bytes FROM oc", "oc"),
    "root_from_access_log": sql(f"SELECT {_KEY.format('user_id')} AS path FROM events WHERE event_type IN ('purchase', 'signup', 'view', 'click') UNION SELECT path FROM p WHERE doc_id % 7 = 0", "p"),
    "ingest_stream_replay": sql(f"SELECT path, {NOW} AS last_pushed FROM rq", "rq"),
    "available_paths": sql("SELECT path FROM p WHERE path NOT IN (SELECT path FROM fc WHERE chunk IN (SELECT chunk FROM loc WHERE k % 9 = 4))", "p", "fc", "loc"),
    "narinfo_text": sql("SELECT p.path, 'StorePath: /store/' || p.path || chr(10) || 'URL: nar/' || nar_hash || '.nar?hash=' || p.path || chr(10) || 'Compression: none' || chr(10) || 'NarHash: sha256:' || nar_hash || chr(10) || 'NarSize: ' || nar_size || chr(10) || 'References: ' || coalesce(r, '') || chr(10) AS text FROM p LEFT JOIN (SELECT src, string_agg(dst, ' ' ORDER BY dst) AS r FROM e GROUP BY src) ON src = p.path", "p", "e"),
    "nar_hash_index": sql("SELECT nar_hash, max(path) AS path FROM p GROUP BY nar_hash", "p"),
    "cache_info": "SELECT 'StoreDir: /store' || chr(10) || 'WantMassQuery: 1' || chr(10) || 'Priority: 30' || chr(10) AS text",
    "reassemble_and_verify": sql("SELECT t.path, sha256(t.text) = p.nar_hash AND strlen(t.text) = p.nar_size AS ok FROM (SELECT path, string_agg(data, chr(10) ORDER BY pos) AS text FROM fc GROUP BY path) t JOIN p ON p.path = t.path", "fc", "p"),
    "matrix_rows": sql("SELECT line_no, attr, drv_path, system, array_to_string(os, ',') AS os, coalesce(grp, '') AS grp FROM mr WHERE os IS NOT NULL", "mr"),
    "matrix_groups": sql("SELECT line_no, name, attr, drv_path, system, array_to_string(os, ',') AS os, installables, mixed FROM mg", "mg"),
    "matrix_json": sql("""SELECT 'matrix' AS name, '{"include":[' || string_agg('{"attr":"' || attr || '","drvPath":"' || drv_path || '","installables":"' || installables || '","name":"' || name || '","os":["' || array_to_string(os, '","') || '"],"system":"' || system || '"}', ',' ORDER BY line_no) || ']}' AS value FROM mg
        UNION ALL SELECT 'any-jobs', 'true' UNION ALL SELECT 'manifest-version', '7'""", "mg"),
    "matrix_drvs": sql("SELECT DISTINCT drv_path FROM jb", "jb"),
    "runner_map": "SELECT * FROM (VALUES ('x86_64-linux', 'self-hosted,x64'), ('aarch64-linux', 'ubuntu-24.04-arm'), ('x86_64-darwin', 'macos-15-intel'), ('aarch64-darwin', 'macos-latest'), ('riscv64-linux', 'rv')) t(system, labels)",
    "parse_timestamps": """SELECT event_id, sec, CASE WHEN sec IS NOT NULL THEN strftime(make_timestamp(sec * 1000000), '%Y-%m-%dT%H:%M:%SZ') END AS stamp FROM (
        SELECT event_id, CASE WHEN event_id % 6 < 3 THEN CAST(floor(epoch(ts)) AS BIGINT) WHEN event_id % 6 = 5 AND day(last_day(ts)) = 31 THEN CAST(epoch(date_trunc('month', ts)) AS BIGINT) + 31 * 86400 - 1 END AS sec FROM events)""",
    "human_bytes": """SELECT p_partkey, CASE WHEN n < 1024 THEN n || ' B' WHEN n / 1024.0::DOUBLE < 1023.95 THEN printf('%.1f KiB', n / 1024.0::DOUBLE) WHEN n / 1048576.0::DOUBLE < 1023.95 THEN printf('%.1f MiB', n / 1048576.0::DOUBLE)
        WHEN n / 1073741824.0::DOUBLE < 1023.95 THEN printf('%.1f GiB', n / 1073741824.0::DOUBLE) ELSE printf('%.1f TiB', n / 1099511627776.0::DOUBLE) END AS text FROM (
        SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_partkey WHEN 1 THEN p_partkey * p_partkey * 1021 ELSE p_partkey * p_partkey * p_partkey * 524287 END AS n FROM part)""",
    "key_parsing": """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN h END AS pack, CASE WHEN p_partkey % 3 = 2 AND p_partkey % 2 = 1 THEN p_partkey END AS version,
        CASE WHEN p_partkey % 4 < 3 THEN h END AS digest, substr(h, 1, 32) AS store_key, CASE WHEN p_partkey > 0 THEN p_partkey * 3 END AS range_end FROM (SELECT p_partkey, sha256(CAST(p_partkey AS VARCHAR)) AS h FROM part)""",
    "tag_order": """SELECT tag, row_number() OVER (ORDER BY a, b, release, c) AS ordinal FROM (SELECT DISTINCT p_partkey % 3 AS a, p_partkey % 12 AS b, p_partkey % 2 AS release, CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 11 ELSE 0 END AS c,
        'v' || p_partkey % 3 || '.' || p_partkey % 12 || CASE WHEN p_partkey % 2 = 0 THEN '-rc.' || p_partkey % 11 ELSE '' END AS tag FROM part)""",
    "drain_summary": """SELECT p_partkey, 'pushed ' || p_partkey % 4 || CASE WHEN p_partkey % 4 = 1 THEN ' path' ELSE ' paths' END
        || CASE WHEN p_partkey % 3 > 0 THEN ', ' || p_partkey % 3 || ' already cached' ELSE '' END || CASE WHEN p_partkey % 5 > 0 THEN ', ' || p_partkey % 5 || ' upstream-signed' ELSE '' END
        || CASE WHEN p_partkey % 2 > 0 THEN ', 1 invalid' ELSE '' END || CASE WHEN p_partkey % 11 = 0 THEN ', 1 FAILED VERIFICATION' ELSE '' END || CASE WHEN p_partkey % 13 = 0 THEN ', 2 FAILED CHUNKING' ELSE '' END
        || CASE WHEN p_partkey % 3 > 0 THEN ' (' || hb(b) || CASE WHEN u > 0 THEN ' in ' || printf('%.1fs', p_partkey * 10 / 1000.0::DOUBLE) || ', ' || hb(CAST(floor(b::DOUBLE * 1000 / u) AS BIGINT)) || '/s' ELSE '' END || ')' ELSE '' END
        || CASE WHEN p_partkey % 6 > 0 THEN '; manifest m3#' || p_partkey % 6 ELSE '; nothing to commit' END AS summary FROM (SELECT p_partkey, p_partkey * 4571 AS b, p_partkey % 7 * 100 AS u FROM part)""",
    "refnorm_restore": sql("SELECT DISTINCT src AS path, true AS same FROM e", "e"),
}


def _le(n: str) -> str:
    """Hex of a number as eight bytes, the lowest first."""
    return "(" + " || ".join(f"substr(printf('%016X', CAST({n} AS BIGINT)), {i}, 2)" for i in range(15, 0, -2)) + ")"


def _str(x: str) -> str:
    """Hex of a string in the wire format: length, bytes, zeros up to eight."""
    return f"({_le(f'strlen({x})')} || hex(encode({x})) || repeat('00', CAST((8 - strlen({x}) % 8) % 8 AS INTEGER)))"


def _words(*words: str) -> str:
    """Hex of fixed words; a literal."""
    out = ""
    for w in words:
        raw = w.encode()
        out += (len(raw).to_bytes(8, "little") + raw + bytes(-len(raw) % 8)).hex().upper()
    return f"'{out}'"


# fixed values below: the words of the archive format and the marker of the export stream
_TREE = {
    "lv": ([], """SELECT source AS tree, lang || '/d' || doc_id % 10 || '/' || doc_id || '.txt' AS path, CASE WHEN doc_id % 11 = 0 THEN 'symlink' ELSE 'regular' END AS kind, doc_id % 7 = 0 AS x,
        text, '../d0/' || (doc_id + 1) || '.txt' AS target FROM documents"""),
    "nd": (["lv"], """SELECT tree, path, kind, x, text, target FROM lv UNION ALL SELECT DISTINCT tree, d, 'directory', false, NULL, NULL FROM
        (SELECT tree, unnest(['', split_part(path, '/', 1), substr(path, 1, length(path) - length(split_part(path, '/', 3)) - 1)]) AS d FROM lv)"""),
    "od": (["nd"], "SELECT *, row_number() OVER w - 1 AS ordinal, CASE WHEN path = '' THEN 0 ELSE len(string_split(path, '/')) END AS depth, lead(CASE WHEN path = '' THEN 0 ELSE len(string_split(path, '/')) END, 1, 0) OVER w AS nxt FROM nd WINDOW w AS (PARTITION BY tree ORDER BY CASE WHEN path = '' THEN [] ELSE string_split(path, '/') END)"),
    "pc": (["od"], f"""SELECT tree, ordinal, CASE WHEN depth = 0 THEN {_words("nix-archive-1")} ELSE {_words("entry", "(", "name")} || {_str("string_split(path, '/')[-1]")} || {_words("node")} END ||
        CASE kind WHEN 'directory' THEN {_words("(", "type", "directory")} WHEN 'symlink' THEN {_words("(", "type", "symlink", "target")} || {_str("target")}
          ELSE {_words("(", "type", "regular")} || CASE WHEN x THEN {_words("executable", "")} ELSE '' END || {_words("contents")} || {_str("text")} END ||
        CASE WHEN nxt > depth THEN '' ELSE repeat({_words(")", ")")}, CAST(depth - greatest(nxt, 1) + 1 AS INTEGER)) || CASE WHEN nxt = 0 THEN {_words(")")} ELSE '' END END AS piece FROM od"""),
}

#: Starts in order of their path; a node of their chains belongs to the first that reaches it.
_CHAIN = {
    "sr": ([], f"SELECT doc_id, row_number() OVER (ORDER BY {_DOC}) AS rk FROM documents WHERE doc_id % 50 = 0"),
    "cn": (["sr"], "SELECT rk, doc_id AS id, 0 AS d FROM sr UNION ALL SELECT rk, id // 3, d + 1 FROM cn WHERE id > 0"),
    "co": (["cn"], f"SELECT id, {_KEY.format('id')} AS path, row_number() OVER (ORDER BY rk, d DESC) - 1 AS ordinal FROM (SELECT id, min(rk) AS rk, arg_min(d, rk) AS d FROM cn GROUP BY id)"),
}

#: The life of an object: puts at 1000 and 2000, touches at 3000, deletions, puts at 5000.
_OBJ = {
    "ob": ([], """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'm3-' ELSE 'pack-' END || doc_id AS key, strlen(text) AS size, text, CASE WHEN doc_id % 7 <> 0 THEN CASE WHEN doc_id % 4 < 2 THEN 1000 WHEN doc_id % 4 > 0 THEN 2000 END WHEN doc_id % 21 = 0 THEN 5000 END AS created,
        CASE WHEN doc_id % 7 = 0 THEN 5000 WHEN doc_id % 10 = 0 THEN 3000 WHEN doc_id % 4 = 1 THEN 2000 WHEN doc_id % 4 = 0 THEN 1000 ELSE 2000 END AS accessed FROM documents"""),
    "lo": (["ob"], "SELECT * FROM ob WHERE created IS NOT NULL"),
}

_REF = {
    "rt": (["e"], "SELECT src AS path, list_sort(list(DISTINCT dst)) AS refs FROM e GROUP BY src"),
    "rf": (["rt"], f"SELECT rt.path, refs, substr(text, 1, 100) AS a, array_to_string(refs, '/') AS b, substr(text, 101) AS c FROM rt JOIN (SELECT {_DOC} AS path, text FROM documents) USING (path)"),
}

_BATCH = {
    "b1": (["fc"], "SELECT chunk, min(ROW(path, pos)) AS fst, any_value(size) AS size, any_value(data) AS data, 1 AS batch FROM fc WHERE doc_id % 2 = 0 GROUP BY chunk"),
    "b2": (["fc", "b1"], "SELECT chunk, min(ROW(path, pos)) AS fst, any_value(size) AS size, any_value(data) AS data, 2 AS batch FROM fc WHERE doc_id % 3 = 0 AND doc_id % 2 <> 0 AND chunk NOT IN (SELECT chunk FROM b1) GROUP BY chunk"),
    "bo": (["b1", "b2"], "SELECT *, row_number() OVER (PARTITION BY batch ORDER BY fst) AS rn FROM (SELECT * FROM b1 UNION ALL SELECT * FROM b2)"),
    "bg": (["bo"], """SELECT batch, chunk, data, rn, 0::BIGINT AS no, 0::BIGINT AS offs, size FROM bo WHERE rn = 1 UNION ALL SELECT o.batch, o.chunk, o.data, o.rn, CASE WHEN bg.offs + bg.size >= 20000 THEN bg.no + 1 ELSE bg.no END,
        CASE WHEN bg.offs + bg.size >= 20000 THEN 0 ELSE bg.offs + bg.size END, o.size FROM bg JOIN bo o ON o.batch = bg.batch AND o.rn = bg.rn + 1"""),
    "bb": (["bg"], "SELECT batch, no, sha256(string_agg(data, '' ORDER BY offs)) AS pack FROM bg GROUP BY batch, no"),
}

ORACLES |= {
    "refnorm_positions": sql("SELECT path, CAST(off AS BIGINT) AS \"offset\", CAST(i - 1 AS BIGINT) AS ref_index FROM (SELECT path, unnest(range(1, len(refs) + 1)) AS i, strlen(a) + 33 * (unnest(range(1, len(refs) + 1)) - 1) AS off FROM rf UNION ALL SELECT path, 1, strlen(a || b || c) FROM rf)", "rf", **_REF),
    "refnorm_restore": sql("""SELECT path, sha256(a || array_to_string(list_transform(refs, lambda r: repeat(chr(0), 32)), '/') || c || repeat(chr(0), 32)) AS normalized, sha256(a || b || c || refs[1]) AS restored, CAST(len(refs) + 1 AS BIGINT) AS rewrites FROM rf""", "rf", **_REF),
    "extract_verify": sql("SELECT chunk, true AS ok, any_value(size) AS bytes FROM fc GROUP BY chunk", "fc"),
    "zstd_round_trip": sql("SELECT chunk, true AS ok, sha256(any_value(data)) AS sha256 FROM fc GROUP BY chunk", "fc"),
    "cdc_reassembled": sql("SELECT path, nar_size AS size, nar_hash AS sha256, true AS whole FROM p WHERE nar_size > 0", "p"),
    "cdc_sweep_totals": sql("SELECT unnest([512, 2048]) AS average, CAST(sum(nar_size) AS BIGINT) AS bytes, true AS sound, true AS indexed FROM p", "p"),
    "object_listing": sql("SELECT key, size, created, accessed FROM lo WHERE key LIKE 'pack-%'", "lo", **_OBJ),
    "object_counts": """SELECT 'first' AS step, count(*) FILTER (WHERE doc_id % 2 = 0) AS n FROM documents UNION ALL SELECT 'again', count(*) FILTER (WHERE doc_id % 3 = 0 AND doc_id % 2 <> 0) FROM documents
        UNION ALL SELECT 'bumped', count(*) FILTER (WHERE doc_id % 6 = 0) FROM documents UNION ALL SELECT 'gone', count(*) FILTER (WHERE doc_id % 5 = 0 AND (doc_id % 2 = 0 OR doc_id % 3 = 0)) FROM documents UNION ALL SELECT 'twice', 0
        UNION ALL SELECT 'touched', count(*) FILTER (WHERE doc_id % 5 <> 0 AND (doc_id % 2 = 0 OR doc_id % 3 = 0)) FROM documents UNION ALL SELECT 'whole', 0""",
    "object_lookup": sql("""SELECT doc_id AS id, coalesce(k, '') AS matched FROM documents LEFT JOIN (SELECT id, arg_max(key, ROW(-turn, created, key)) AS k FROM
        (SELECT doc_id AS id, 0 AS turn, 'pack-' || doc_id AS p, true AS whole FROM documents UNION ALL SELECT doc_id, 1, 'pack-' || doc_id, false FROM documents
         UNION ALL SELECT doc_id, 2, CASE WHEN doc_id % 2 = 0 THEN 'm3-' || doc_id % 10 ELSE 'pack-9' END, false FROM documents UNION ALL SELECT doc_id, 3, 'm3', false FROM documents WHERE doc_id % 2 = 1) r
        JOIN lo ON CASE WHEN whole THEN lo.key = p ELSE starts_with(lo.key, p) END GROUP BY id) ON id = doc_id""", "lo", **_OBJ),
    "object_ranges": sql("SELECT key, sha256(from_hex(substr(hex(encode(text)), 2 * (size // 3) + 1, 2 * (greatest(size // 3, size // 2) - size // 3)))) AS sha256 FROM lo", "lo", **_OBJ),
    "tree_flatten": sql("SELECT tree, path, kind, ordinal FROM od", "od", **_TREE),
    "tree_build": sql("SELECT tree, path, kind FROM nd", "nd", **_TREE),
    "archive_digests": sql("SELECT tree, sha256(from_hex(string_agg(piece, '' ORDER BY ordinal))) AS digest, CAST(sum(length(piece)) // 2 AS BIGINT) AS size FROM pc GROUP BY tree", "pc", **_TREE),
    "closure_order_chain": sql("SELECT path, ordinal FROM co", "co", **_CHAIN),
    "closure_export": sql(f"""SELECT no AS "window", sha256(from_hex(string_agg(frame, '' ORDER BY rn))) AS digest, CAST(sum(length(frame)) // 2 AS BIGINT) AS size FROM g JOIN f USING (id) GROUP BY no""", "g", "f", **_CHAIN,
        oo=(["co"], "SELECT co.*, strlen(text) AS size, text, ordinal + 1 AS rn FROM co JOIN documents ON doc_id = id"),
        g=(["oo"], "SELECT id, rn, 0::BIGINT AS no, size AS total FROM oo WHERE rn = 1 UNION ALL SELECT oo.id, oo.rn, CASE WHEN g.total + oo.size > 8192 THEN g.no + 1 ELSE g.no END, CASE WHEN g.total + oo.size > 8192 THEN oo.size ELSE g.total + oo.size END FROM g JOIN oo ON oo.rn = g.rn + 1"),
        f=(["oo"], f"""SELECT id, {_le('1')} || {_words("nix-archive-1", "(", "type", "regular", "contents")} || {_str("text")} || {_words(")")} || {_le(str(0x4558494E))} || {_str("('/store/' || path)")} ||
          CASE WHEN id = 0 THEN {_le('0')} ELSE {_le('1')} || {_str("('/store/' || " + _KEY.format('(id // 3)') + ")")} END || {_words("")} || {_le('0')} AS frame FROM oo""")),
    "archives_served": sql("""SELECT id, CASE WHEN s0 THEN a0 WHEN s1 THEN a1 ELSE '' END AS path, CASE WHEN bad AND (at0, id) > min(CASE WHEN bad THEN ROW(at0, id) END) OVER (PARTITION BY nar_hash) THEN 'refused' ELSE st END AS status FROM
        (SELECT *, st IN ('missing', 'corrupt') AS bad FROM (SELECT *, CASE WHEN s0 THEN 'served' WHEN s1 THEN 'reloaded' WHEN s1 IS NULL THEN 'missing' ELSE 'corrupt' END AS st FROM
        (SELECT rq.id, rq.at0, rq.nar_hash, coalesce(h0.sound, n0.sound) AS s0, coalesce(h1.sound, n1.sound) AS s1, coalesce(h0.path, n0.path) AS a0, coalesce(h1.path, n1.path) AS a1 FROM rq
          LEFT JOIN v0 h0 ON h0.nar_hash = rq.nar_hash AND h0.path = rq.hint LEFT JOIN i0 n0 ON n0.nar_hash = rq.nar_hash LEFT JOIN v1 h1 ON h1.nar_hash = rq.nar_hash AND h1.path = rq.hint LEFT JOIN i1 n1 ON n1.nar_hash = rq.nar_hash)))""", "rq", "v0", "v1", "i0", "i1",
        rq=(["p"], f"SELECT event_id AS id, event_id AS at0, coalesce(nar_hash, 'none') AS nar_hash, CASE WHEN user_id % 2 = 0 THEN {_KEY.format('user_id')} ELSE {_KEY.format('(user_id + 1)')} END AS hint FROM events LEFT JOIN p ON p.doc_id = user_id"),
        v0=(["p"], "SELECT path, nar_hash, doc_id % 7 <> 0 AS sound FROM p WHERE doc_id % 5 <> 0"),
        v1=(["p"], "SELECT path, nar_hash, doc_id % 14 <> 0 AS sound FROM p WHERE doc_id % 25 <> 0"),
        i0=(["v0"], "SELECT nar_hash, max(path) AS path, arg_max(sound, path) AS sound FROM v0 GROUP BY nar_hash"),
        i1=(["v1"], "SELECT nar_hash, max(path) AS path, arg_max(sound, path) AS sound FROM v1 GROUP BY nar_hash")),
    # an item is still held if the distinct items used since, and itself, fit the budget
    "cache_replay": sql("SELECT cache, seq, prev IS NOT NULL AND size + coalesce((SELECT sum(y.size) FROM x y WHERE y.cache = x.cache AND y.seq > x.prev AND y.seq < x.seq AND (y.prev IS NULL OR y.prev <= x.prev)), 0) <= 2000 AS hit FROM x", "x",
        x=([], "SELECT event_type AS cache, event_id AS seq, user_id AS item, user_id % 97 + 1 AS size, lag(event_id) OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS prev FROM events")),
    "ingest_full": sql('SELECT chunk, pack, offs AS "offset", size AS csize FROM bg JOIN bb USING (batch, no)', "bg", "bb", **_BATCH),
    "request_replies": sql("""SELECT queue, seq, op, coalesce((SELECT count(DISTINCT path) FROM r a WHERE a.queue = r.queue AND a.op = 'add' AND a.seq < r.seq
          AND a.seq > coalesce((SELECT max(x.seq) FROM r x WHERE x.queue = r.queue AND x.op = 'drain' AND x.seq < r.seq), -1)), 0) AS buffered FROM r WHERE op <> 'add'""", "r",
        r=([], "SELECT user_id % 5 AS queue, event_id AS seq, CASE WHEN event_id % 23 = 0 THEN 'drain' WHEN event_id % 7 = 0 THEN 'status' ELSE 'add' END AS op, CAST(user_id % 40 AS VARCHAR) AS path FROM events")),
    "access_sessions": sql(f"""SELECT path, min(us) AS "start", max(us) + 10800000000 AS "end", count(*) AS n FROM (SELECT *, sum(CASE WHEN us - prev < 10800000000 THEN 0 ELSE 1 END) OVER (PARTITION BY path ORDER BY us) AS k FROM x) GROUP BY path, k""", "x",
        x=([], f"SELECT {_KEY.format('user_id')} AS path, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events")),
    "drain_total": """SELECT CAST(sum(p_partkey % 5) AS BIGINT) AS paths_received, CAST(sum(p_partkey % 4) AS BIGINT) AS pushed, CAST(sum(p_partkey % 9) AS BIGINT) AS new_chunks, CAST(sum(p_partkey % 3) AS BIGINT) AS packs_uploaded,
        CAST(sum(p_partkey * 7) AS BIGINT) AS bytes_uploaded, max(CASE WHEN p_partkey % 10 = 3 THEN p_partkey ELSE 0 END) AS manifest_version FROM part""",
    "key_formats": """SELECT p_partkey, 'pack-' || h AS pack_key, p_partkey || '#attr' AS root_key, 'm3#' || p_partkey AS family_key, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'checks.' END || p_partkey AS attr, substr(h, 1, 32) AS refs, p_partkey AS idx,
        CASE p_partkey % 3 WHEN 0 THEN p_partkey || '|' || p_partkey || ' x' WHEN 1 THEN 'a|' || p_partkey || '|b' ELSE '' END AS paths, least(greatest(p_partkey * p_partkey * p_partkey * 97, 1), 1073741824) AS permits, CAST(p_partkey AS VARCHAR) AS name,
        sha256('family-2' || CASE WHEN p_partkey % 2 = 0 THEN ':' || p_partkey ELSE '' END) AS namespace, CASE WHEN p_partkey % 2 = 0 THEN p_partkey * 1000 ELSE 0 END AS clock FROM (SELECT p_partkey, sha256(CAST(p_partkey AS VARCHAR)) AS h FROM part)""",
    "fullest_version": "SELECT 2::BIGINT AS fullest, 3::BIGINT AS newest, count(*) AS paths FROM documents WHERE doc_id % 5 < 4",
    "matrix_strict": sql("""SELECT min(line_no) AS line_no, arg_min(CASE WHEN line_no % 5 = 0 THEN g ELSE attr END, line_no) AS name, string_agg(drv_path || '^*', ' ' ORDER BY line_no) AS installables, false AS mixed
        FROM (SELECT *, system || '-' || array_to_string(os, '+') AS g FROM mr WHERE os IS NOT NULL) GROUP BY CASE WHEN line_no % 5 = 0 THEN g ELSE 'j:' || line_no END""", "mr"),
}


def _inline_human(body: str) -> str:
    """Writes out hb(x), since a query is one statement without macros."""
    import re

    def form(m: re.Match) -> str:
        x = m[1]
        return (
            f"CASE WHEN {x} < 1024 THEN {x} || ' B' WHEN {x} / 1024.0::DOUBLE < 1023.95 THEN printf('%.1f KiB', {x} / 1024.0::DOUBLE) "
            f"WHEN {x} / 1048576.0::DOUBLE < 1023.95 THEN printf('%.1f MiB', {x} / 1048576.0::DOUBLE) ELSE printf('%.1f GiB', {x} / 1073741824.0::DOUBLE) END"
        )

    body = re.sub(r"hb\((CAST\(floor\(.*?\) AS BIGINT\))\)", form, body)
    return re.sub(r"hb\((\w+)\)", form, body)


for _name in ("drain_summary", "gc_plan_line", "gc_report_line"):
    ORACLES[_name] = _inline_human(ORACLES[_name])

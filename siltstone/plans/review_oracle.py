"""The DuckDB SQL of the review queries, written from their definitions."""

from __future__ import annotations

from siltstone.operators import rules as R
from siltstone.plans import oracle as O

SQL: dict[str, str] = {}


def text(x: str | None) -> str:
    """A string literal."""
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


def choice(column: str, table: dict, of=lambda v: v) -> str:
    """A CASE over the keys of a table, without an end."""
    return f"CASE {column} " + " ".join(f"WHEN {text(k)} THEN {text(of(v))}" for k, v in table.items())


SUGGESTING = ", ".join(map(text, R.SUGGESTING_TRACKS))
M = f"""WITH o AS (SELECT 'c' || o_custkey AS cluster_id, o_custkey AS k, o_orderkey AS id, floor(o_totalprice)::BIGINT AS size_bytes, CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 1000)::DOUBLE / 100 END AS quality,
  ['near_identical_image', 'semantic_image', 'near_dup_document', 'version_chain', 'screenshot_burst', 'ranked_clutter'][o_custkey % 6 + 1] AS track,
  max(o_orderkey) OVER (PARTITION BY o_custkey) AS last, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
m AS (SELECT *, track IN ({SUGGESTING}) AND k % 5 <> 0 AND id = last AS is_keep,
  CASE WHEN track IN ('near_identical_image', 'screenshot_burst') THEN (k % 15)::DOUBLE WHEN track = 'semantic_image' THEN (k % 100)::DOUBLE / 1000 WHEN track = 'ranked_clutter' THEN (k % 50)::DOUBLE / 10 ELSE (90 + k % 10)::DOUBLE / 100 END AS raw FROM o),
c AS (SELECT cluster_id, any_value(track) AS track, any_value(raw) AS raw, any_value(k) AS k, count(*) AS n_members, sum(size_bytes)::BIGINT AS bytes, min(id) FILTER (is_keep) AS keep_id, min(id) AS first_id,
  max(quality) FILTER (is_keep) AS keep_quality, max(quality) FILTER (NOT is_keep) AS best_other, count(*) FILTER (NOT is_keep AND quality IS NULL) AS n_unscored FROM m GROUP BY cluster_id)"""
SQL["review_queue"] = f"{M} SELECT cluster_id, track, n_members, bytes, CASE WHEN keep_id IS NOT NULL THEN 'deletion_suggestions' ELSE 'browse_only' END AS queue FROM c"
SQL["representative_member"] = f"{M} SELECT cluster_id, coalesce(keep_id, first_id) AS representative_id FROM c"
NUMBER = "printf('%.3f', raw)"
SQL["presented_clusters"] = f"""{M}, t AS (SELECT *,
  CASE WHEN track = 'screenshot_burst' THEN CASE WHEN keep_id IS NOT NULL THEN {text(R.BURST_DISPOSABLE)} ELSE {text(R.BURST_MEANINGFUL)} END END AS l1,
  CASE WHEN track IN ('near_identical_image', 'screenshot_burst') AND keep_id IS NOT NULL THEN {text(R.QUALITY_REASON)} || CASE WHEN n_members = 2 THEN 'copy.' ELSE 'copies.' END
    || CASE WHEN keep_quality IS NOT NULL AND n_members > 1 AND n_unscored = 0 THEN printf({text(R.QUALITY_SCORES)}, keep_quality, best_other) ELSE '' END END AS l2,
  CASE WHEN track = 'near_dup_document' AND keep_id IS NOT NULL THEN {text(R.DOCUMENT_KEEP)} WHEN track = 'ranked_clutter' THEN {text(R.CLUTTER_NOTE)} END AS l3 FROM c)
SELECT cluster_id, CASE WHEN track = 'semantic_image' THEN n_members || {text(R.SCENE_HEADLINE)} ELSE {choice("track", R.HEADLINES)} END END AS headline, concat_ws(chr(10), l1, l2, l3) AS detail,
CASE WHEN track = 'semantic_image' THEN {text(R.BROWSE_NOTE)} WHEN track = 'near_identical_image' AND keep_id IS NULL THEN {text(R.UNSCORED_NOTE)} WHEN track = 'version_chain' AND keep_id IS NULL THEN {text(R.VERSION_NOTE)}
  WHEN track = 'ranked_clutter' THEN {text(R.CLUTTER_NOTE)} ELSE '' END AS browse_note, CASE WHEN keep_id IS NOT NULL THEN '/m/' || keep_id || '.jpg' ELSE '' END AS keep,
CASE track WHEN 'near_identical_image' THEN 'Hamming distance ' || raw::INT || ' of 64 bits (lower = more similar)' WHEN 'screenshot_burst' THEN 'Hamming distance ' || raw::INT || ' of 64 bits (lower = more similar)'
  WHEN 'semantic_image' THEN 'CLIP cosine distance ' || {NUMBER} || ' (lower = more similar)' WHEN 'ranked_clutter' THEN 'Clutter-likelihood ranker score ' || {NUMBER} || ' (higher sorts first — a ranking signal, not a probability)'
  ELSE 'Cosine similarity ' || {NUMBER} || ' (higher = more similar)' END AS technical_detail FROM t"""
SQL["chain_lines"] = f"{M} SELECT cluster_id, id, nth || ' of ' || n || CASE WHEN is_keep THEN {text(R.CHAIN_KEEP)} ELSE '' END AS line FROM m WHERE track = 'version_chain' AND k % 5 <> 0"
SQL["burst_review"] = """WITH s AS (SELECT label::BIGINT AS burst, vec_id AS id, NOT (label % 3 = 0 AND vec_id % 11 = 0) AS transient, CASE WHEN vec_id % 4 <> 0 AND label % 4 <> 1 THEN (vec_id % 37)::DOUBLE / 10 END AS quality,
  array_to_string(list_transform(embedding[1:64], lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '')::BIT AS h FROM embeddings),
w AS (SELECT a.burst, max(bit_count(xor(a.h, b.h)))::DOUBLE AS widest FROM s a JOIN s b ON a.burst = b.burst AND a.id < b.id GROUP BY a.burst),
g AS (SELECT burst, CASE WHEN bool_and(transient) AND count(quality) >= 2 THEN 'keeper' WHEN bool_and(transient) THEN 'too_few_scored' ELSE 'meaningful_content' END AS verdict FROM s GROUP BY burst),
r AS (SELECT burst, id, row_number() OVER (PARTITION BY burst ORDER BY quality DESC, id) AS nth FROM s WHERE quality IS NOT NULL)
SELECT s.burst, s.id, verdict, widest, verdict = 'keeper' AND coalesce(nth = 1, false) AS is_keep FROM s JOIN g ON s.burst = g.burst LEFT JOIN w ON s.burst = w.burst LEFT JOIN r ON s.id = r.id"""
SIZES = ", ".join(f"'{w}x{h}'" for w, h in R.SCREEN_SIZES)
SQL["common_resolution"] = f"""WITH s AS (SELECT o_orderkey, [1920, 1080, 2560, 4000, 1170, 2532][o_orderkey % 6 + 1] AS w, [1080, 1920, 1440, 3000, 2532][o_orderkey % 5 + 1] AS h FROM orders)
SELECT o_orderkey, w || 'x' || h IN ({SIZES}) OR h || 'x' || w IN ({SIZES}) AS common FROM s"""
SQL["ranked_entries"] = f"{O.FIL} SELECT 'ranked-clutter-' || file_id AS cluster_id, 'ranked_clutter' AS track, path, size AS size_bytes, false AS is_keep, (file_id % 77)::DOUBLE / 10 AS raw_score FROM files"
GROUPS = (*R.PLAIN_CATEGORIES, "user_selected", "ai_new_group", "other")
SQL["plain_categories"] = f"""WITH s AS (SELECT s_suppkey, [{", ".join(map(text, GROUPS))}][s_suppkey % {len(GROUPS)} + 1] AS g FROM supplier)
SELECT s_suppkey, {choice("g", R.PLAIN_CATEGORIES, lambda v: v[0])} WHEN 'user_selected' THEN 'Individually Selected Items' WHEN 'other' THEN 'Uncategorized' ELSE 'Ai New Group' END AS name, coalesce({choice("g", R.PLAIN_CATEGORIES, lambda v: v[1])} END, '-') AS reason FROM s"""
D = f"""{O.CANDS}, de AS (SELECT category_group, count(*) AS n, sum(size_bytes)::BIGINT AS bytes, CASE WHEN min(tier) = max(tier) THEN min(tier) ELSE 'both' END AS tier,
  CASE WHEN count(DISTINCT coalesce(retention_days, -1)) = 1 THEN max(retention_days) END AS days FROM cands GROUP BY category_group),
fp AS (SELECT *, left(sha256('{{"category_group": "' || category_group || '", "file_count": ' || n || ', "retention_days": ' || coalesce(days::VARCHAR, 'null') || ', "tier": "' || tier || '", "total_size_bytes": ' || bytes || '}}'), 32) AS fingerprint FROM de)"""
SQL["descriptor_fingerprint"] = f"{D} SELECT category_group, fingerprint FROM fp"
SQL["explanation_cache"] = f"{D}, x AS (SELECT category_group, tier = 'A' AND category_group <> 'crash_dumps' AS hit FROM fp) SELECT category_group, hit, CASE WHEN hit THEN 'about ' || category_group ELSE '-' END AS explanation FROM x"
SQL["suggestions_stale"] = "SELECT o_orderkey, o_orderkey % 13 = 0 OR o_orderkey % 4 <> o_custkey % 4 AS stale FROM orders"
SQL["scan_rollup"] = """SELECT count(*) AS n_roots, sum(s_suppkey * 3)::BIGINT AS dirs_visited, sum(s_suppkey * 7)::BIGINT AS entries_total, sum(s_suppkey % 10)::BIGINT AS files_written, sum(s_suppkey % 4)::BIGINT AS files_pruned,
sum(s_suppkey % 3)::BIGINT AS skipped, 'completed' AS status FROM supplier"""
SQL["keep_rationale"] = f"""{O.DUP} SELECT path, 'Exact duplicate of ''' || path || ''' (byte-identical, full-hash match); kept copy is ' || CASE WHEN git_repo_root IS NOT NULL THEN 'inside git repository ''' || git_repo_root || '''' WHEN risky_place THEN {text(R.KEPT_RISKY)} ELSE {text(R.KEPT_ELSEWHERE)} END
  || ', created ' || strftime(make_timestamp((ctime * 1000000)::BIGINT), '%Y-%m-%dT%H:%M:%S') || '+00:00, path depth ' || (len(string_split(path, '/')) - 1) || {text(R.KEPT_BY)} AS rationale
FROM (SELECT *, list_contains(seg, 'downloads') OR list_contains(seg, 'temp') AS risky_place FROM ke WHERE path = keep_path)"""
SQL["restorable_counts"] = f"""WITH g AS (SELECT batch_id, count(*) AS n_items, count(*) FILTER (step IN ('restore', 'destination_occupied')) AS n, count(*) FILTER (step = 'outside_vault') AS n_out, count(*) FILTER (step = 'already_restored') AS n_back FROM ({SQL.get('restore_plan', O.SQL['restore_plan'])}) GROUP BY batch_id)
SELECT batch_id, n_items, CASE WHEN n_out > 0 THEN 0 ELSE n END AS n_restorable, CASE WHEN n_out > 0 THEN 'outside_vault' WHEN n > 0 THEN '-' WHEN n_back > 0 THEN 'already_restored' ELSE 'nothing_restorable' END AS error FROM g"""
GUARD = f"{O.FIL}, g AS (SELECT path, content, CASE WHEN content IS NULL THEN 'unreadable' WHEN size > 10000000 THEN 'timeout' END AS reason FROM files)"
SQL["guarded_hashes"] = f"{GUARD} SELECT path, sha256(content) AS hash FROM g WHERE reason IS NULL"
SQL["hash_skips"] = f"{GUARD}, s AS (SELECT path, reason, count(*) OVER () AS n_all FROM g WHERE reason IS NOT NULL) SELECT path, reason, n_all, greatest(n_all - 10, 0) AS n_more FROM s ORDER BY path, reason LIMIT 10"
SQL["label_rows"] = f"""{M} SELECT cluster_id, ['duplicates', 'not_duplicates', 'unsure'][c_custkey % 3 + 1] AS decision, c_custkey % 50 AS keep_id, c_custkey AS seq, track, raw AS raw_score, n_members FROM c JOIN customer ON c.k = c_custkey"""
SQL["event_log_roundtrip"] = f"""{O.EV}, x AS (SELECT CASE WHEN seq % 2 = 0 THEN phase ELSE 'done' END AS phase, CASE WHEN seq % 2 = 0 THEN operation ELSE 'apply' END AS operation, size_bytes, seq % 2 = 0 AND restored AS restored FROM ev)
SELECT phase, operation, 1 AS schema_version, count(*) AS n, sum(size_bytes)::BIGINT AS bytes, count(*) FILTER (restored) AS n_restored FROM x GROUP BY phase, operation"""
SQL["vault_table"] = """SELECT '/f/' || c_custkey AS original_path, '/v/' || c_name AS vault_path, c_custkey * 11 AS size_bytes FROM customer WHERE c_custkey % 10 <> 3 AND c_custkey % 7 <> 0
UNION ALL SELECT '(malformed)', '', count(*) FROM customer WHERE c_custkey % 10 = 3 OR c_custkey % 7 = 0"""
SQL["scanned_tree"] = "SELECT 'n_nationkey=' || n_nationkey AS folder, strlen(n_name) + 1 AS size, sha256(n_name || chr(10)) AS sha, false AS is_dir FROM nation"
SQL["variant_blocks"] = """WITH g AS (SELECT p_partkey // 4 AS block, count(*) FILTER (p_partkey % 4 = 0 OR p_partkey % 9 = 0) AS o, max(p_partkey) FILTER (p_partkey % 4 = 0 OR p_partkey % 9 = 0) AS original, count(*) FILTER (p_partkey % 4 <> 0 AND p_partkey % 9 <> 0) AS n_variants FROM part GROUP BY 1)
SELECT block, original, n_variants FROM g WHERE o = 1 AND n_variants > 0"""
SQL["promotion_guard"] = """WITH s AS (SELECT s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE s_suppkey % 5 END AS r, CASE WHEN s_suppkey % 2 = 0 THEN 0 ELSE 3 END AS y, s_suppkey % 4 AS t FROM supplier)
SELECT name, CASE WHEN r = 0 AND y = 0 THEN 'adversarial_tail_only' WHEN r = 0 AND t = 0 THEN 'synthetic_only' ELSE '-' END AS refused FROM s"""
SQL["long_prefix"] = r"SELECT s_suppkey, ['', '', '\\?\UNC\', '\\srv\'][s_suppkey % 4 + 1] || 'C:\data\' || s_name AS path FROM supplier"
SQL["vault_names"] = f"{O.EV} SELECT seq, '/vault/' || batch_id || '/' || left(sha256(batch_id || '|' || original_path || '|' || seq), 32) || '_' || regexp_extract(original_path, '[^/]*$') AS vault_path FROM ev"
SQL["pair_sample"] = """WITH h AS (SELECT vec_id AS id, array_to_string(list_transform(embedding[1:64], lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '')::BIT AS h FROM embeddings),
b AS (SELECT min(id) AS low, max(id) - min(id) + 1 AS n FROM h),
d AS (SELECT i AS draw, low + ('0x' || left(md5('42-' || i || '-a'), 12))::BIGINT % n AS x, low + ('0x' || left(md5('42-' || i || '-b'), 12))::BIGINT % n AS y FROM range(20000) t(i), b),
u AS (SELECT least(x, y) AS a, greatest(x, y) AS b, min(draw) AS draw FROM d WHERE x <> y GROUP BY 1, 2),
p AS (SELECT draw, a, b, bit_count(xor(p.h, q.h))::INT AS distance FROM u JOIN h p ON p.id = a JOIN h q ON q.id = b),
s AS (SELECT *, CASE WHEN distance <= 25 THEN 'boundary' ELSE 'negative_control' END AS stratum FROM p WHERE distance > 10)
SELECT stratum, draw, a, b, distance FROM s QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY draw) <= 60"""
SQL["review_tracks"] = f"""{O.REPS} SELECT 'near_dup_document' AS track, 'run' AS state, count(*) AS n_rows, count(DISTINCT id) AS n_ids, false AS has_reason FROM reps WHERE id > rep UNION ALL SELECT 'screenshot_burst', 'run', count(*), count(DISTINCT event_id), false FROM events
UNION ALL SELECT 'semantic_image', 'skipped', 0, 0, true UNION ALL SELECT 'ocr', 'skipped', 0, 0, true"""
LETTERS = ", ".join(f"(length(lower(text)) - length(replace(lower(text), '{c}', '')))::DOUBLE" for c in "abcdefghijklmnopqrstuvwxyz")
SQL["two_stage_documents"] = f"""{O.COMPS.replace(">= 0.5)", ">= 0.1)")}, v AS (SELECT doc_id AS id, [{LETTERS}] AS v FROM documents WHERE regexp_matches(text, '[a-zA-Z]')),
st AS (SELECT comp.id, component AS grp, v FROM comp JOIN v ON comp.id = v.id), co AS (SELECT a.grp, a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS c FROM st a JOIN st b ON a.grp = b.grp AND a.id < b.id),
l2 AS (SELECT a, b FROM co WHERE c >= 0.99 UNION SELECT b, a FROM co WHERE c >= 0.99), r2 AS (SELECT a AS id, a AS r FROM l2 UNION SELECT l2.b, r2.r FROM r2 JOIN l2 ON l2.a = r2.id), c2 AS (SELECT id, min(r) AS cluster FROM r2 GROUP BY id),
worst AS (SELECT x.cluster, min(c) AS w FROM co JOIN c2 x ON x.id = a JOIN c2 y ON y.id = b AND x.cluster = y.cluster GROUP BY x.cluster)
SELECT id, c2.cluster, round(w, 6) AS raw_score FROM c2 JOIN worst ON c2.cluster = worst.cluster"""
SQL["cand_safe_mode"] = f"{O.CANDS} SELECT path, category_group FROM cands WHERE category_group IN ('package_caches', 'temp_and_browser_caches', 'crash_dumps')"
SQL["stored_hashes"] = f"""{O.SCAN} SELECT o.path, o.size, CASE WHEN n.path IS NULL THEN 'old' ELSE 'new' END AS partial_hash, CASE WHEN n.path IS NULL THEN '-' ELSE md5(o.path) END AS full_hash FROM old o LEFT JOIN (SELECT path FROM new WHERE file_id % 2 = 0) n ON o.path = n.path"""
SQL["selected_totals"] = f"{O.CANDS} SELECT count(*) AS n_items, coalesce(sum(size_bytes), 0)::BIGINT AS bytes FROM cands WHERE regexp_matches(path, '[0268]\\.')"
SQL["supported_documents"] = f"{O.FIL} SELECT path, regexp_matches(lower(path), '\\.(txt|md|docx|pdf)$') AS supported FROM files"

# ---- images, settings and states ----
SQL["image_features"] = """WITH p AS (SELECT vec_id, embedding::DOUBLE[] AS p FROM embeddings),
l AS (SELECT vec_id, p, list_transform(range(0, 36), lambda j: p[(j // 6) * 8 + j % 6 + 2] + p[(j // 6 + 2) * 8 + j % 6 + 2] + p[(j // 6 + 1) * 8 + j % 6 + 1] + p[(j // 6 + 1) * 8 + j % 6 + 3] - 4 * p[(j // 6 + 1) * 8 + j % 6 + 2]) AS l FROM p)
SELECT vec_id, array_to_string(list_transform(range(0, 56), lambda j: CASE WHEN p[(j // 7) * 8 + j % 7 + 2] > p[(j // 7) * 8 + j % 7 + 1] THEN '1' ELSE '0' END), '') AS dhash, round(list_var_pop(l), 6) AS sharpness, round(list_stddev_pop(p), 6) AS spread FROM l"""
LABELS = R.CATEGORY_LABELS | {"ai_new_group": "Ai New Group"}
SQL["category_labels"] = f"WITH s AS (SELECT s_suppkey, [{', '.join(map(text, GROUPS))}][s_suppkey % {len(GROUPS)} + 1] AS g FROM supplier) SELECT s_suppkey, {choice('g', LABELS)} END AS label FROM s"
SQL["settings_listing"] = f"""WITH g AS (SELECT unnest(['dev_artifacts', 'package_caches', 'model_caches', 'temp_and_browser_caches', 'crash_dumps', 'old_installers', 'large_logs', 'archive_pairs', 'duplicates']) AS category_group)
SELECT category_group, category_group IN ('dev_artifacts', 'package_caches', 'temp_and_browser_caches', 'crash_dumps') AS enabled, CASE WHEN enabled THEN -1 ELSE 30 END::INT AS retention_days,
category_group IN ('duplicates', 'model_caches', 'dev_artifacts') AS forced_off, {choice("category_group", LABELS)} END AS label FROM g"""
SQL["batch_estimates"] = f"{O.EV} SELECT batch_id, count(*) AS n_items, round(count(*) * 0.008088::DOUBLE, 6) AS seconds, count(*) * 0.008088::DOUBLE >= 2 AS warn FROM ev GROUP BY batch_id"
SQL["shown_reconciliation"] = """WITH s AS (SELECT s_suppkey, s_suppkey % 3 <> 1 AND s_suppkey % 2 = 0 AND s_suppkey % 5 IN (0, 2) AS whole FROM supplier)
SELECT s_suppkey, CASE WHEN whole THEN s_suppkey * 10 ELSE -1 END AS delta_bytes, CASE WHEN whole THEN s_suppkey / 4 ELSE -1 END::DOUBLE AS delta_percent FROM s"""
SQL["eligible_paths"] = f"{O.INV}, v AS (SELECT path, {O.reason(True)} AS reason_code FROM inv) SELECT path FROM v WHERE {O.VERDICT} = 'eligible' AND length(path) % 2 = 0"
SQL["cache_roots"] = """WITH s AS (SELECT p_partkey, '/hub/' || ['models', 'Datasets', 'spaces', 'other'][p_partkey % 4 + 1] || '--' || p_brand AS base, ['/blobs/', '/snapshots', '/x/', '/refs/'][p_partkey % 5 + 1] AS sub FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 4 <> 3 AND sub IN ('/blobs/', '/refs/') THEN base ELSE '-' END AS root FROM s"""
SQL["protected_roots"] = "SELECT s_suppkey, s_suppkey % 6 <> 1 AS protected FROM supplier"
SQL["restore_violations"] = f"""{O.EV}, x AS (SELECT original_path, 'outside_vault' AS why FROM lastd WHERE NOT starts_with(vault_path, '/vault/') UNION ALL SELECT original_path, 'protected_root' FROM lastd WHERE starts_with(original_path, '/files/click/'))
SELECT original_path, why, count(*) AS n FROM x GROUP BY ALL"""
SQL["purge_records"] = f"""{O.EV}, x AS (SELECT original_path || '.PDF' AS path, coalesce(seq % 3 = 0 AND seq % 2 = 0, false) AS is_dir, size_bytes FROM lastd)
SELECT path, is_dir, CASE WHEN is_dir THEN '' ELSE '.pdf' END AS ext, 'eligible' AS verdict, sum(size_bytes)::BIGINT AS bytes FROM x GROUP BY ALL"""
SQL["notification_states"] = """SELECT user_id % 50 AS volume, max(event_id) FILTER (event_id % 4 IN (0, 3))::DOUBLE AS last_notified, arg_max(event_id::DOUBLE + event_id % 5 * 86400.0, event_id) FILTER (event_id % 4 = 1)::DOUBLE AS snoozed_until FROM events GROUP BY 1"""
SQL["listed_bytes"] = f"""{O.INV}, c AS (SELECT parent, sum(size)::BIGINT AS b FROM inv WHERE NOT is_dir AND size % 3 <> 0 GROUP BY parent)
SELECT path, coalesce(b, -1)::BIGINT AS bytes, b IS NOT NULL AS partial FROM inv LEFT JOIN c ON c.parent = inv.path WHERE is_dir"""
SQL["groups_still_there"] = """WITH m AS (SELECT vec_id AS id, vec_id // 3 AS "group", count(*) OVER (PARTITION BY vec_id // 3) AS n_members FROM embeddings WHERE label % 4 <> 1) SELECT * FROM m WHERE n_members > 1"""
SQL["ranking_rows"] = f"""{O.FIL} SELECT file_id, CASE WHEN size % 2 = 0 THEN mtime ELSE 0 END::DOUBLE AS mtime, CASE WHEN size % 2 = 0 THEN ctime ELSE 0 END::DOUBLE AS ctime, size % 2 = 0 AND is_cloud_placeholder AS is_cloud_placeholder FROM files"""
SQL["residual_images"] = """WITH h AS (SELECT vec_id AS id, list_transform(range(0, 16), lambda i: (embedding[4 * i + 1]::DOUBLE + embedding[4 * i + 2]::DOUBLE + embedding[4 * i + 3]::DOUBLE + embedding[4 * i + 4]::DOUBLE) > 0) AS s FROM embeddings)
SELECT a.id FROM h a WHERE NOT EXISTS (SELECT 1 FROM h b WHERE a.id <> b.id AND len(list_filter(list_zip(a.s, b.s), lambda z: z[1] <> z[2])) <= 1)"""
SQL["candidate_display"] = f"""WITH c AS ({O.CANDS} SELECT path, category_group, size_bytes AS n FROM cands), d AS ({O.DUP} SELECT path, keep_path FROM ke WHERE path <> keep_path),
u AS (SELECT *, CASE WHEN n >= 1099511627776 THEN 4 WHEN n >= 1073741824 THEN 3 WHEN n >= 1048576 THEN 2 WHEN n >= 1024 THEN 1 ELSE 0 END AS k FROM c)
SELECT u.path, {choice("category_group", R.CATEGORY_LABELS)} END AS label, CASE WHEN k = 0 THEN n || ' B' ELSE printf('%.1f', round_even(n / pow(1024.0, k), 1)) || ' ' || ['KB', 'MB', 'GB', 'TB'][k] END AS shown, coalesce(keep_path, '-') AS keep_path
FROM u LEFT JOIN d ON u.path = d.path"""
SQL["member_hashes"] = f"""{O.FIL} SELECT path, CASE WHEN file_id % 5 <> 0 AND length(path) % 2 = 0 THEN md5(path) ELSE coalesce(sha256(content), '-') END AS hash FROM files"""
SQL["log_of_batch"] = f"{O.EV} SELECT original_path, seq, method FROM lastd WHERE batch_id = 'b7'"
SQL["stat_cache"] = f"{O.INV} SELECT path, size, mtime FROM inv WHERE starts_with(path, '/src2/de/') AND NOT is_dir"

# ---- all tracks over one inventory ----

WIDE_HASH = "array_to_string(list_transform(flatten(list_transform(range(0, 16), lambda i: list_transform([1, 1, 1, 1], lambda o: embedding[4 * i + 1]::DOUBLE + embedding[4 * i + 2]::DOUBLE + embedding[4 * i + 3]::DOUBLE + embedding[4 * i + 4]::DOUBLE))), lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '')::BIT"
LINKED = "AS (SELECT a AS id, a AS r FROM {0} UNION SELECT e.b, x.r FROM {1} x JOIN {0} e ON e.a = x.id)"
TRACKS = f"""WITH RECURSIVE im AS (SELECT vec_id * 2 AS id, vec_id, CASE WHEN vec_id % 41 = 0 THEN 50000000 ELSE (vec_id % 7 + 1) * 1000 END::BIGINT AS size, vec_id * 37 % 5000 AS t, label, CASE WHEN vec_id % 29 <> 0 THEN {WIDE_HASH} END AS h, embedding::DOUBLE[] AS v FROM embeddings),
ok AS (SELECT * FROM im WHERE vec_id % 41 <> 0),
e1 AS (SELECT x.id AS a, y.id AS b, bit_count(xor(x.h, y.h)) AS n FROM ok x JOIN ok y ON x.id <> y.id AND bit_count(xor(x.h, y.h)) <= 14), r1 {LINKED.format("e1", "r1")}, c1 AS (SELECT id, min(r) AS cluster FROM r1 GROUP BY id),
w1 AS (SELECT x.cluster, max(bit_count(xor(p.h, q.h)))::DOUBLE AS w FROM c1 x JOIN c1 y ON x.cluster = y.cluster AND x.id < y.id JOIN ok p ON p.id = x.id JOIN ok q ON q.id = y.id GROUP BY 1),
rest AS (SELECT * FROM ok WHERE id NOT IN (SELECT id FROM c1)),
e2 AS (SELECT x.id AS a, y.id AS b, list_cosine_similarity(x.v, y.v) AS n FROM rest x JOIN rest y ON x.id <> y.id AND list_cosine_similarity(x.v, y.v) >= 0.35), r2 {LINKED.format("e2", "r2")}, c2 AS (SELECT id, min(r) AS cluster FROM r2 GROUP BY id),
w2 AS (SELECT cluster, 1 - min(n) AS w FROM e2 JOIN c2 ON c2.id = e2.a GROUP BY 1),
shots AS (SELECT * FROM ok WHERE vec_id % 3 = 0), e4 AS (SELECT x.id AS a, y.id AS b FROM shots x JOIN shots y ON x.id <> y.id AND x.label = y.label AND abs(x.t - y.t) <= 60 AND bit_count(xor(x.h, y.h)) <= 14), r4 {LINKED.format("e4", "r4")}, c4 AS (SELECT id, min(r) AS cluster FROM r4 GROUP BY id),
w4 AS (SELECT x.cluster, max(bit_count(xor(p.h, q.h)))::DOUBLE AS w FROM c4 x JOIN c4 y ON x.cluster = y.cluster AND x.id < y.id JOIN ok p ON p.id = x.id JOIN ok q ON q.id = y.id GROUP BY 1),
docs AS (SELECT * FROM documents WHERE doc_id % 53 <> 0),
{O.PAIRS.removeprefix("WITH ").replace("FROM documents", "FROM docs").replace(">= 0.5)", ">= 0.1)")},
ed AS (SELECT a, b FROM pairs UNION SELECT rep, id FROM reps WHERE id > rep), eb AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed), r3 {LINKED.format("eb", "r3")}, g3 AS (SELECT id, min(r) AS grp FROM r3 GROUP BY id),
lv AS (SELECT doc_id AS id, [{LETTERS}] AS v FROM docs WHERE regexp_matches(text, '[a-zA-Z]')), st AS (SELECT g3.id, grp, v FROM g3 JOIN lv ON g3.id = lv.id),
co AS (SELECT a.grp, a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS c FROM st a JOIN st b ON a.grp = b.grp AND a.id < b.id), l3 AS (SELECT a, b FROM co WHERE c >= 0.99 UNION SELECT b, a FROM co WHERE c >= 0.99),
r5 {LINKED.format("l3", "r5")}, c3 AS (SELECT id, min(r) AS cluster FROM r5 GROUP BY id), w3 AS (SELECT x.cluster, min(c) AS w FROM co JOIN c3 x ON x.id = a JOIN c3 y ON y.id = b AND x.cluster = y.cluster GROUP BY 1),
n3 AS (SELECT cluster, bool_or(id % 4 = 0) AS named FROM c3 GROUP BY 1),
m AS (SELECT 'near_identical_image' AS track, c1.cluster, id, w AS raw_score FROM c1 JOIN w1 ON c1.cluster = w1.cluster UNION ALL SELECT 'semantic_image', c2.cluster, id, w FROM c2 JOIN w2 ON c2.cluster = w2.cluster
  UNION ALL SELECT 'screenshot_burst', c4.cluster, id, w FROM c4 JOIN w4 ON c4.cluster = w4.cluster
  UNION ALL SELECT CASE WHEN named THEN 'version_chain' ELSE 'near_dup_document' END, c3.cluster * 2 + 1, id * 2 + 1, w FROM c3 JOIN w3 ON c3.cluster = w3.cluster JOIN n3 ON c3.cluster = n3.cluster),
seen AS (SELECT 'near_identical_image' AS track, count(*) AS n FROM ok UNION ALL SELECT 'semantic_image', count(*) FROM rest UNION ALL SELECT unnest(['near_dup_document', 'version_chain']), count(*) FROM docs UNION ALL SELECT 'screenshot_burst', count(*) FROM shots),
sized AS (SELECT m.*, size FROM m JOIN (SELECT id, size FROM im UNION ALL SELECT doc_id * 2 + 1, CASE WHEN doc_id % 53 = 0 THEN 50000000 ELSE n_chars END FROM documents) f ON m.id = f.id),
o AS (SELECT track, cluster, count(*) AS n_members, sum(size)::BIGINT AS bytes, min(id) AS id FROM sized GROUP BY 1, 2)"""
SQL["analysis_members"] = f"{TRACKS} SELECT track, cluster, id, round(raw_score, 5) AS raw_score FROM m"
SQL["analysis_order"] = f"{TRACKS} SELECT track, cluster, n_members, bytes, id, row_number() OVER (ORDER BY track = 'semantic_image', bytes DESC, track, cluster) AS place FROM o"
SQL["analysis_tracks"] = f"""{TRACKS} SELECT seen.track, 'run' AS state, false AS has_reason, n AS n_considered, count(id) AS n_members, count(DISTINCT cluster) AS n_clusters FROM seen LEFT JOIN m ON seen.track = m.track GROUP BY 1, 4
UNION ALL SELECT 'ranked_clutter', 'skipped', true, (SELECT count(*) FROM o), 0, 0 UNION ALL SELECT 'too large: image', 'left out', true, count(*), 0, 0 FROM im WHERE vec_id % 41 = 0 HAVING count(*) > 0 UNION ALL SELECT 'too large: document', 'left out', true, count(*), 0, 0 FROM documents WHERE doc_id % 53 = 0 HAVING count(*) > 0"""
SQL["emb_groups_all"] = f"""WITH RECURSIVE v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), e AS (SELECT x.id AS a, y.id AS b, list_cosine_similarity(x.v, y.v) AS n FROM v x JOIN v y ON x.id <> y.id AND list_cosine_similarity(x.v, y.v) >= 0.35),
r {LINKED.format("e", "r")}, c AS (SELECT id, min(r) AS g FROM r GROUP BY id), w AS (SELECT g, 1 - min(n) AS d FROM e JOIN c ON c.id = e.a GROUP BY g) SELECT id, c.g AS "group", round(d, 5) AS distance FROM c JOIN w ON c.g = w.g"""

# ---- walking a tree ----

TREE = """WITH g AS (SELECT '/c_nationkey=' || c_nationkey AS n, '/c_nationkey=' || c_nationkey || '/c_mktsegment=' || c_mktsegment AS f, sum(strlen(c_name) + 1)::BIGINT AS size FROM customer GROUP BY 1, 2), n AS (SELECT DISTINCT n FROM g)"""
SQL["walked_tree"] = f"""{TREE} SELECT f AS place, 'file' AS kind, size, '-' AS error FROM g UNION ALL SELECT f, 'dir', 0, '-' FROM g UNION ALL SELECT n, 'dir', 0, '-' FROM n UNION ALL SELECT n || '/link', 'link', 0, '-' FROM n
UNION ALL SELECT n || '/deep', 'unreadable', 0, 'OSError' FROM n"""
SQL["walk_stats"] = f"{TREE} SELECT (SELECT count(*) FROM g) AS n_files, (SELECT count(*) FROM n) AS n_links, (SELECT sum(size) FROM g)::BIGINT AS bytes, (SELECT count(*) FROM n) AS n_skipped, 0 AS skipped_bytes_known, least(20, (SELECT count(*) FROM n))::INT AS n_shown"

# ---- ranking of lists ----

SQL["rank_features_all"] = f"""{O.FIL}, x AS (SELECT *, file_id AS i, lower(regexp_extract(path, '(\\.[^.]+)$')) AS ext, {O.CLASS} AS cls, ['near_identical_image', 'semantic_image', 'near_dup_document', 'version_chain', 'screenshot_burst', 'ranked_clutter'][file_id % 6 + 1] AS cat FROM files)
SELECT i AS id, round(ln(1 + greatest(size, 0)::DOUBLE), 6) AS log_size, round(greatest((1700000000.0 - mtime) / 86400, 0), 6)::DOUBLE AS age_days, round(greatest((1700000000.0 - ctime) / 86400, 0), 6)::DOUBLE AS lived_days,
{O.BUCKET.format('cls')}::DOUBLE AS class_bucket, {O.BUCKET.format('cat')}::DOUBLE AS category_bucket, {O.BUCKET.format('ext')}::DOUBLE AS ext_bucket, (i % 6 + 1)::DOUBLE AS cluster_size, (i % 3 = 0)::INT::DOUBLE AS keep, (i % 100)::DOUBLE / 100 AS raw_score,
is_cloud_placeholder::INT::DOUBLE AS cloud, (i % 5)::DOUBLE AS prior_accepted, (i % 7)::DOUBLE AS prior_rejected, (i % 4)::DOUBLE AS prior_kept FROM x"""

# ---- digests of ranges ----

SQL["dup_tree_hash"] = f"""{O.FIL.replace("WITH ", "WITH RECURSIVE ", 1)}, b AS (SELECT path, encode(content) AS c, octet_length(encode(content)) AS size FROM files WHERE content IS NOT NULL),
r AS (SELECT path, size, greatest(1, (size + 999) // 1000) AS n, c, unnest(range(0, greatest(1, (size + 999) // 1000))) AS pos FROM b),
t AS (SELECT path, size, n, pos, sha256('\\x00'::BLOB || c[pos * 1000 + 1:pos * 1000 + 1000]) AS digest FROM r
  UNION ALL SELECT path, size, (n + 7) // 8, pos // 8, sha256('\\x01'::BLOB || encode(string_agg(digest, '' ORDER BY pos))) FROM t WHERE n > 1 GROUP BY path, size, n, pos // 8),
h AS (SELECT path, size, digest AS tree_hash FROM t WHERE n = 1)
SELECT path, size, tree_hash, CASE WHEN size > 0 THEN count(*) OVER (PARTITION BY size, tree_hash) ELSE 1 END AS cluster_size FROM h"""

# ---- what is to be labelled ----

SQL["label_candidates"] = f"""WITH RECURSIVE h AS (SELECT vec_id AS id, array_to_string(list_transform(embedding[1:64], lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '')::BIT AS h FROM embeddings),
e AS (SELECT x.id AS a, y.id AS b FROM h x JOIN h y ON x.id <> y.id AND bit_count(xor(x.h, y.h)) <= 15), r {LINKED.format("e", "r")}, c AS (SELECT id, min(r) AS cluster FROM r GROUP BY id),
l AS (SELECT min(id) AS low, max(id) - min(id) + 1 AS n FROM h),
d AS (SELECT i AS draw, low + ('0x' || left(md5('42-' || i || '-a'), 12))::BIGINT % n AS x, low + ('0x' || left(md5('42-' || i || '-b'), 12))::BIGINT % n AS y FROM range(20000) t(i), l),
u AS (SELECT least(x, y) AS a, greatest(x, y) AS b, min(draw) AS draw FROM d WHERE x <> y GROUP BY 1, 2),
p AS (SELECT draw, a, b, bit_count(xor(p.h, q.h))::INT AS distance FROM u JOIN h p ON p.id = a JOIN h q ON q.id = b LEFT JOIN c x ON x.id = a LEFT JOIN c y ON y.id = b WHERE x.cluster IS NULL OR y.cluster IS NULL OR x.cluster <> y.cluster),
s AS (SELECT *, CASE WHEN distance <= 25 THEN 'boundary' ELSE 'negative_control' END AS stratum FROM p WHERE distance > 10 QUALIFY row_number() OVER (PARTITION BY CASE WHEN distance <= 25 THEN 'boundary' ELSE 'negative_control' END ORDER BY draw) <= 60)
SELECT 'near_duplicate' AS stratum, 'near-' || cluster AS candidate, id, -1 AS distance FROM c UNION ALL SELECT stratum, stratum || '-' || draw, unnest([a, b]), distance FROM s"""

# ---- texts of documents ----

SQL["document_paragraphs"] = r"""WITH d AS (SELECT doc_id AS k, '/d/' || doc_id || CASE doc_id % 5 WHEN 1 THEN '.txt' WHEN 2 THEN '.pdf' ELSE '.docx' END AS path, regexp_replace(text, '[\x00-\x08\x0B-\x1F\x{FFFE}\x{FFFF}]', '', 'g') AS text FROM documents),
r AS (SELECT *, CASE WHEN k % 7 = 3 OR (text IS NULL AND k % 11 <> 4) THEN 'unreadable' WHEN k % 5 = 1 THEN NULL WHEN text IS NULL THEN 'unreadable' WHEN k % 5 = 2 THEN 'unsupported' WHEN k % 11 = 4 THEN 'not_a_package' END AS reason FROM d)
SELECT path, sha256(CASE WHEN reason IS NULL THEN text ELSE '-' END) AS sha, coalesce(reason, '-') AS reason FROM r"""

# ---- repositories, decisions, texts that differ, pairs with their truth, settings of the kinds there are ----

SQL["repositories_clean"] = f"""{O.INV}, m AS (SELECT path FROM inv WHERE is_dir AND regexp_matches(path, '/projects/p[0-9]*[05]$')),
n AS (SELECT f.path, max(m.path) AS root FROM inv f LEFT JOIN m ON starts_with(f.path, m.path || '/') WHERE NOT f.is_dir GROUP BY f.path)
SELECT path, coalesce(root, '-') AS git_repo_root, coalesce(regexp_matches(root, '0$'), false) AS git_repo_clean FROM n"""
SQL["feedback_rows"] = """WITH o AS (SELECT 'c' || o_custkey AS cluster_id, o_orderkey AS id, floor(o_totalprice)::BIGINT AS size_bytes, ['accepted', 'rejected', 'kept'][o_orderkey % 3 + 1] AS decision, count(*) OVER (PARTITION BY o_custkey) AS cluster_size FROM orders)
SELECT cluster_id, id, id AS seq, decision, size_bytes, cluster_size, count(*) FILTER (decision = 'accepted') OVER w AS n_accepted, count(*) FILTER (decision = 'rejected') OVER w AS n_rejected, count(*) FILTER (decision = 'kept') OVER w AS n_kept
FROM o WINDOW w AS (PARTITION BY cluster_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
SQL["text_perturbed"] = r"""WITH t AS (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '[ \t\n\v\f\r]+', '', 'g') <> '') AS l, list_filter(regexp_split_to_array(text, '[ \t\n\v\f\r]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
k AS (SELECT *, CASE WHEN len(l) > 1 THEN l[1:len(l) - 1] ELSE l END AS p FROM t), i AS (SELECT *, len(p) AS n, ('0x' || left(md5(text), 8))::BIGINT % greatest(1, len(p)) AS i, ('0x' || substr(md5(text), 9, 8))::BIGINT % greatest(1, len(p) - 1) AS j0 FROM k),
s AS (SELECT *, (i + 1 + j0) % greatest(1, n) AS j FROM i)
SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g')) AS cleaned,
sha256(array_to_string(CASE WHEN n > 2 THEN list_transform(range(0, n), lambda x: CASE WHEN x = i THEN p[j + 1] WHEN x = j THEN p[i + 1] ELSE p[x + 1] END) ELSE p END, chr(10))) AS reordered,
sha256(array_to_string(w[1:greatest(1, floor(len(w) * 0.7::DOUBLE)::INT)], ' ')) AS pasted FROM s"""
SQL["pair_truth"] = """WITH p AS (SELECT p_partkey // 24 AS "set", p_partkey AS id, p_partkey // 4 AS block FROM part) SELECT x."set", x.id AS a, y.id AS b, x.block = y.block AS is_same FROM p x JOIN p y ON x."set" = y."set" AND x.id < y.id"""
SQL["settings_of_groups"] = f"""{O.CANDS}, g AS ({SQL["settings_listing"].replace("WITH g AS", "WITH gg AS").replace("FROM g", "FROM gg")}), f AS (SELECT category_group, count(*) AS n, sum(size_bytes)::BIGINT AS bytes FROM cands GROUP BY 1)
SELECT g.category_group, enabled, retention_days, forced_off, label, coalesce(n, 0) AS n, coalesce(bytes, 0)::BIGINT AS bytes FROM g LEFT JOIN f ON g.category_group = f.category_group"""

# ---- applying batches ----

APPLIED = """WITH o AS (SELECT o_orderkey AS i, o_custkey % 60 AS b, '/f/' || o_orderkey AS path, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 60 END AS days, trunc(o_totalprice * 10000)::BIGINT AS size, o_orderkey * 31 % 100000 AS entries FROM orders),
g AS (SELECT *, (size >= 1073741824 AND i % 4 <> 0) OR entries >= 87882 AS guarded, bool_or(b < 9 AND i % 97 = 0) OVER (PARTITION BY b) AS blocked FROM o),
m AS (SELECT *, CASE WHEN days IS NULL AND NOT guarded THEN 'direct_delete' ELSE 'vault' END AS method, days IS NULL AND guarded AND i % 2 = 0 AS zero FROM g),
k AS (SELECT *, CASE WHEN blocked THEN 'refused' WHEN i % 47 = 0 OR (i % 53 = 0 AND method <> 'vault') OR i % 59 = 0 OR (i % 61 = 0 AND method = 'direct_delete') THEN 'skipped' ELSE 'applied' END AS outcome FROM m)"""
SQL["apply_report"] = f"""{APPLIED} SELECT 'b' || b AS batch_id, CASE WHEN bool_or(blocked) THEN 'blocked_item' ELSE '-' END AS refusal, count(*) AS n_items, count(*) FILTER (outcome = 'applied') AS n_applied, count(*) FILTER (outcome = 'skipped') AS n_skipped,
coalesce(sum(size) FILTER (outcome = 'applied'), 0)::BIGINT AS bytes, count(*) FILTER (outcome = 'applied' AND zero) AS n_purged, coalesce(sum(size) FILTER (outcome = 'applied' AND zero), 0)::BIGINT AS bytes_purged FROM k GROUP BY b"""
SQL["apply_events"] = f"""{APPLIED}, e AS (SELECT 'b' || b AS batch_id, path, method, 0 AS stage, unnest([0, 1]) AS phase FROM k WHERE outcome = 'applied' UNION ALL SELECT 'b' || b, path, method, 1, unnest([0, 1]) FROM k WHERE outcome = 'applied' AND zero)
SELECT row_number() OVER (ORDER BY batch_id, stage, path, phase) - 1 AS seq, batch_id, path AS original_path, CASE stage WHEN 0 THEN 'apply' ELSE 'purge' END AS operation, CASE phase WHEN 0 THEN 'intent' ELSE 'done' END AS phase, method, stage = 1 AND e.phase = 1 AS purged FROM e"""

# ---- images of files, names in other forms, what is live, and lines shown ----

SQL["decoded_images"] = """WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: greatest(0, least(255, floor(x::DOUBLE * 64 + 128)))::INT) AS p FROM embeddings),
r AS (SELECT *, CASE vec_id % 10 WHEN 1 THEN 'cut' WHEN 2 THEN 'not_png' WHEN 3 THEN 'unreadable' END AS reason FROM p)
SELECT vec_id, CASE WHEN reason IS NULL THEN 8 ELSE -1 END AS width, CASE WHEN reason IS NULL THEN array_to_string(list_transform(range(0, 56), lambda i: CASE WHEN p[i // 7 * 8 + i % 7 + 2] > p[i // 7 * 8 + i % 7 + 1] THEN '1' ELSE '0' END), '') ELSE '-' END AS dhash, coalesce(reason, '-') AS reason FROM r"""
SQL["paths_reread"] = f"""{O.FIL}, f AS (SELECT file_id, size, path || CASE file_id % 3 WHEN 0 THEN 'e' || chr(769) WHEN 1 THEN chr(233) ELSE 'e' END AS path FROM files),
a AS (SELECT CASE WHEN file_id % 7 = 0 THEN path || '?' ELSE replace(path, chr(233), 'e' || chr(769)) END AS path FROM f), o AS (SELECT CASE WHEN length(path) % 2 = 0 THEN replace(path, 'e' || chr(769), chr(233)) ELSE path END AS asked FROM a)
SELECT asked, f.path, f.size FROM o JOIN f ON nfc_normalize(o.asked) = nfc_normalize(f.path)"""
SQL["live_subtree"] = f"""{O.INV}, r AS (SELECT path, is_dir, is_reparse_point OR (is_dir AND regexp_matches(path, '/projects/p[0-9]*[37]$')) AS gate FROM inv WHERE path = '/src2' OR starts_with(path, '/src2/'))
SELECT path, is_dir FROM r WHERE NOT EXISTS (SELECT 1 FROM r g WHERE g.gate AND starts_with(r.path, g.path || '/'))"""
SQL["any_records"] = f"{O.FIL} SELECT string_split(path, '/')[2] AS source, bool_or(is_reparse_point) AS has_links, (SELECT count(*) > 0 FROM files) AS has_any FROM files GROUP BY 1"
SQL["immaterial_note"] = f"""{O.INV}, s AS (SELECT size, count(*) AS n, (count(*) - 1) * size AS surplus FROM inv WHERE NOT is_dir AND size > 0 AND NOT is_cloud_placeholder GROUP BY size HAVING count(*) >= 2),
t AS (SELECT count(*) AS n_buckets, coalesce(sum(surplus), 0)::BIGINT AS bytes FROM s WHERE surplus < 200000)
SELECT ext, count(*) AS n, any_value(n_buckets || ' sizes that several files share could free less than 200,000 bytes each and weren''t hashed; at best ' || format('{{:,}}', bytes) || ' bytes') AS line FROM inv, t WHERE NOT is_dir AND n_buckets > 0 GROUP BY ext"""
SQL["duplicate_members"] = f"""{O.DUP}, k AS (SELECT full_hash, path, path = keep_path AS is_keep FROM ke), pg AS (SELECT *, row_number() OVER (PARTITION BY full_hash ORDER BY is_keep DESC, path) - 1 AS pos FROM k)
SELECT full_hash, pos // 3 AS page, count(*)::INT AS n, string_agg(CASE WHEN is_keep THEN '+' ELSE '-' END || path, ',' ORDER BY pos) AS members FROM pg GROUP BY 1, 2"""
SQL["live_mode"] = "SELECT o_custkey, arg_max(CASE WHEN o_orderstatus = 'O' THEN 'power' ELSE 'safe' END, o_orderkey) AS mode, (SELECT arg_max(CASE WHEN o_orderstatus = 'O' THEN 'power' ELSE 'safe' END, o_orderkey) FROM orders) AS of_all FROM orders GROUP BY o_custkey"
SQL["burst_same_size"] = f"""WITH RECURSIVE h AS (SELECT vec_id AS id, label % 3 AS w, vec_id % 2 AS g, vec_id * 37 % 5000 AS t, {WIDE_HASH} AS h FROM embeddings), e AS (SELECT x.id AS a, y.id AS b FROM h x JOIN h y ON x.w = y.w AND x.g = y.g AND abs(x.t - y.t) <= 60 AND bit_count(xor(x.h, y.h)) <= 14),
r {LINKED.format("e", "r")} SELECT id, min(r) AS burst FROM r GROUP BY id"""

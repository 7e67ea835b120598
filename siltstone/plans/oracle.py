"""The DuckDB SQL of the queries, written from their definitions."""

from __future__ import annotations

from siltstone.sources.adapters import FILES_SQL, INVENTORY_SQL

INV, FIL = f"WITH {INVENTORY_SQL}", f"WITH {FILES_SQL}"
SQL: dict[str, str] = {}

# ---- inventory ----
SQL["inv_by_name"] = f"{INV} SELECT path, is_dir FROM inv WHERE lower(name) IN ('node_modules', 'package.json', 'docs')"
SQL["inv_by_ext"] = f"{INV} SELECT path, size FROM inv WHERE ext IN ('.zip', '.exe') AND NOT is_dir"
SQL["inv_larger_than"] = f"{INV} SELECT path, size FROM inv WHERE size >= 5000000 AND NOT is_dir"
SQL["inv_glob"] = f"{INV} SELECT path FROM inv WHERE lower(path) LIKE '/src_/%/downloads/%.zip'"
SQL["inv_children"] = f"{INV} SELECT path, is_dir FROM inv WHERE parent = '/src0'"
SQL["inv_subtree"] = f"{INV} SELECT path, size FROM inv WHERE (path = '/src1/en' OR starts_with(path, '/src1/en/')) AND NOT is_cloud_placeholder"
SQL["inv_directory_totals"] = f"""{INV}, up AS (
  SELECT d.path, CASE WHEN NOT i.is_dir THEN i.size ELSE 0 END AS b, (NOT i.is_cloud_placeholder)::INT AS n
  FROM inv i, (SELECT path FROM inv WHERE is_dir) d WHERE i.path = d.path OR starts_with(i.path, d.path || '/'))
SELECT path, sum(b)::BIGINT AS subtree_bytes, sum(n)::BIGINT AS subtree_entries FROM up GROUP BY path"""
SQL["inv_exists"] = f"{INV} SELECT path FROM inv WHERE NOT is_dir AND (file_id IS NULL OR file_id % 3 <> 0)"
SQL["inv_ext_profile"] = f"{INV} SELECT (len(string_split(path, '/')) - 1)::INT AS depth, ext, count(*) AS n_files, sum(size)::BIGINT AS bytes FROM inv WHERE NOT is_dir GROUP BY ALL"
SCAN = f"""{FIL}, old AS (SELECT * FROM files WHERE file_id % 5 <> 0),
new AS (SELECT path, size + (file_id % 4 = 0)::INT AS size, mtime + CASE WHEN file_id % 6 = 0 THEN 0.5 ELSE 0 END AS mtime, file_id, dev, ino FROM files WHERE file_id % 7 <> 0)"""
SQL["inv_change_class"] = f"""{SCAN} SELECT n.path, CASE WHEN o.path IS NULL THEN 'new' WHEN o.size = n.size AND o.mtime = n.mtime THEN 'unchanged' ELSE 'changed' END AS change
FROM new n LEFT JOIN old o ON n.path = o.path"""
SQL["inv_prune_unseen"] = f"{SCAN} SELECT path FROM old WHERE starts_with(path, '/src2/') AND path NOT IN (SELECT path FROM new)"
SQL["inv_upsert"] = f"""{SCAN} SELECT coalesce(n.path, o.path) AS path, coalesce(n.size, o.size) AS size, coalesce(n.mtime, o.mtime) AS mtime, coalesce(o.size * 2, -1) AS hash_size, CASE WHEN o.path IS NOT NULL THEN 'h' END AS partial_hash
FROM old o FULL JOIN new n ON n.path = o.path"""
SQL["inv_replace_partition"] = f"{SCAN} SELECT path, size FROM old WHERE NOT starts_with(path, '/src3/') UNION ALL SELECT path, size FROM new WHERE starts_with(path, '/src3/')"
SQL["hash_cache_valid"] = f"""{SCAN}, c AS (SELECT n.path, coalesce(o.size = n.size AND o.mtime = n.mtime, false) AS valid, 'p' || o.file_id AS p FROM new n LEFT JOIN old o ON n.path = o.path)
SELECT path, CASE WHEN valid THEN p END AS partial_hash, NULL::VARCHAR AS full_hash, valid FROM c"""
SQL["inv_logical_bytes"] = f"{INV} SELECT sum(size)::BIGINT AS logical_bytes FROM inv WHERE NOT is_dir"
SQL["inv_physical_bytes"] = f"""{INV}, k AS (SELECT dev, ino, max(size) AS size FROM inv WHERE NOT is_dir AND (dev <> 0 OR ino <> 0) GROUP BY ALL UNION ALL SELECT dev, ino, size FROM inv WHERE NOT is_dir AND dev = 0 AND ino = 0)
SELECT sum(size)::BIGINT AS physical_bytes FROM k"""
FREE = "CASE WHEN nlink IS NULL OR is_reparse_point THEN 0 WHEN nlink <= 1 THEN size WHEN n >= nlink AND r = 1 THEN size ELSE 0 END"
SQL["link_freeable"] = f"""{FIL}, w AS (SELECT *, count(*) OVER (PARTITION BY dev, ino) AS n, row_number() OVER (PARTITION BY dev, ino ORDER BY path) AS r FROM files)
SELECT path, ({FREE})::BIGINT AS freeable_bytes, NOT (nlink IS NULL OR is_reparse_point) AS resolved FROM w"""
SQL["link_freeable_all"] = SQL["link_freeable"]
LOST = "lost AS (SELECT path, CASE WHEN file_id % 3 <> 0 THEN size END AS size_estimate_bytes FROM files WHERE file_id % 13 = 0)"
SQL["inaccessible_summary"] = f"{FIL}, {LOST} SELECT count(*) AS n_paths, coalesce(sum(size_estimate_bytes), 0)::BIGINT AS known_bytes, count(*) FILTER (size_estimate_bytes IS NULL) AS n_unknown FROM lost"
SQL["inaccessible_sample"] = f"{FIL}, {LOST} SELECT path, coalesce(size_estimate_bytes, -1) AS size_estimate_bytes FROM lost ORDER BY path LIMIT 20"
SQL["disk_reconcile"] = f"""{INV}, {LOST}, k AS (SELECT max(size) AS size FROM inv WHERE NOT is_dir AND (dev <> 0 OR ino <> 0) GROUP BY dev, ino UNION ALL SELECT size FROM inv WHERE NOT is_dir AND dev = 0 AND ino = 0),
s AS (SELECT (SELECT sum(size)::BIGINT FROM k) AS physical_bytes, (SELECT coalesce(sum(size_estimate_bytes), 0)::BIGINT FROM lost) AS known_bytes)
SELECT physical_bytes, known_bytes, 10000000000::BIGINT AS used_bytes, 10000000000 - physical_bytes - known_bytes AS delta_bytes, round((10000000000 - physical_bytes - known_bytes) * 100.0 / 10000000000, 4)::DOUBLE AS delta_percent FROM s"""
SQL["git_root_nearest"] = f"""{INV}, m AS (SELECT path FROM inv WHERE is_dir AND regexp_matches(path, '/projects(/p[0-9]*[05])?$'))
SELECT f.path, arg_max(m.path, length(m.path)) AS marker FROM inv f LEFT JOIN m ON starts_with(f.path, m.path || '/') WHERE NOT f.is_dir GROUP BY f.path"""
CLASS = """CASE WHEN is_cloud_placeholder THEN 'cloud_sync_placeholder' WHEN git_repo_root IS NOT NULL THEN 'git_repo' WHEN list_contains(string_split(lower(path), '/'), 'downloads') THEN 'downloads'
 WHEN list_contains(string_split(lower(path), '/'), 'desktop') THEN 'desktop' WHEN list_contains(string_split(lower(path), '/'), 'documents') THEN 'documents'
 WHEN list_contains(string_split(lower(path), '/'), 'temp') OR list_contains(string_split(lower(path), '/'), 'tmp') THEN 'temp' ELSE 'other' END"""
SQL["path_class"] = f"{INV} SELECT path, {CLASS} AS path_class FROM inv"


# ---- safety and detectors ----
def reason(dev: bool, deny: str = "false", allow: str = "false") -> str:
    """The reason code in SQL; only rules that these inventories can meet are told apart."""
    modules = "list_contains(string_split(lower(path), '/'), 'node_modules')"
    exempt = f"({modules} AND git_repo_clean AND {str(dev).lower()})"
    token = "regexp_matches(lower(name), 'tax|1099|w2|w-2|invoice|receipt|statement|contract|agreement|legal|irs')"
    return f"""CASE WHEN git_repo_root IS NOT NULL AND NOT {exempt} AND {modules} AND NOT git_repo_clean THEN 'git_node_modules_dirty'
 WHEN git_repo_root IS NOT NULL AND NOT {exempt} THEN 'in_git_repository' WHEN ext IN ('.kdbx', '.ppk', '.pem', '.key', '.pfx', '.crt', '.gpg') THEN 'protected_extension'
 WHEN ext IN ('.db', '.sqlite', '.mdf') THEN 'database_file' WHEN ext IN ('.vhdx', '.vmdk', '.qcow2') THEN 'vm_image' WHEN is_cloud_placeholder THEN 'cloud_placeholder' WHEN {deny} THEN 'user_denied'
 WHEN {token} AND {allow} THEN 'finance_token_allowed' WHEN {token} THEN 'finance_token' WHEN {allow} THEN 'user_allowed' WHEN git_repo_root IS NOT NULL AND {exempt} THEN 'node_modules_exempt' ELSE 'default_eligible' END"""


VERDICT = "CASE WHEN reason_code = 'finance_token' THEN 'review_only' WHEN reason_code IN ('finance_token_allowed', 'user_allowed', 'node_modules_exempt', 'default_eligible') THEN 'eligible' ELSE 'blocked' END"
SQL["safety_verdict"] = f"""{INV}, v AS (SELECT path, {reason(True, "path GLOB '*/crash/*'", "path GLOB '*/docs/tax_1*'")} AS reason_code FROM inv) SELECT path, {VERDICT} AS verdict, reason_code FROM v"""
SQL["safety_reason_counts"] = f"{INV}, v AS (SELECT {reason(False)} AS reason_code FROM inv) SELECT {VERDICT} AS verdict, reason_code, count(*) AS n FROM v GROUP BY ALL"
DETECT = f"""{INV},
d1 AS (SELECT path, 'dev_artifacts' AS category_group, 'dev_artifact_node_modules' AS category, 1 AS ordinal FROM inv d WHERE is_dir AND name = 'node_modules' AND EXISTS (SELECT 1 FROM inv m WHERE m.parent = d.parent AND m.name = 'package.json' AND NOT m.is_dir)),
d2 AS (SELECT path, 'package_caches' AS category_group, 'package_cache' AS category, 2 AS ordinal FROM inv WHERE is_dir AND (path LIKE '/src12/%/projects/p1_' OR path LIKE '/src15/%/projects/%')),
d3 AS (SELECT path, 'model_caches' AS category_group, 'model_cache' AS category, 3 AS ordinal FROM inv WHERE (is_dir AND path LIKE '/src18/%/downloads') OR (NOT is_dir AND ext = '.zip' AND path LIKE '/src18/%/downloads/%')),
d4 AS (SELECT path, 'temp_and_browser_caches' AS category_group, 'browser_cache' AS category, 4 AS ordinal FROM inv WHERE path LIKE '/src11/%/logs' UNION ALL
  SELECT path, 'temp_and_browser_caches', 'temp_file', 4 FROM inv WHERE parent IN (SELECT path FROM inv WHERE is_dir AND path LIKE '/%/temp') AND (1700000000.0 - mtime) / 3600 >= 168),
d5 AS (SELECT path, 'crash_dumps' AS category_group, 'crash_dump' AS category, 5 AS ordinal FROM inv WHERE NOT is_dir AND ext = '.dmp' UNION ALL SELECT path, 'crash_dumps', 'crash_dump', 5 FROM inv WHERE parent IN (SELECT path FROM inv WHERE is_dir AND path LIKE '/src19/%/keys')),
d6 AS (SELECT path, 'old_installers' AS category_group, 'old_installer' AS category, 6 AS ordinal FROM inv WHERE ext IN ('.exe', '.msi', '.iso') AND path LIKE '%/downloads/%' AND (1700000000.0 - mtime) / 86400 >= 90),
d8 AS (SELECT path, 'large_logs' AS category_group, 'large_log' AS category, 8 AS ordinal FROM inv WHERE NOT is_dir AND size >= 1000000 AND (ext = '.log' OR contains(lower(name), 'log')) AND (1700000000.0 - mtime) / 86400 >= 30),
raw AS (SELECT * FROM d1 UNION ALL SELECT * FROM d2 UNION ALL SELECT * FROM d3 UNION ALL SELECT * FROM d4 UNION ALL SELECT * FROM d5 UNION ALL SELECT * FROM d6 UNION ALL SELECT * FROM d8),
wins AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY path ORDER BY ordinal, category) = 1),
dirs_in AS (SELECT w.path FROM wins w JOIN inv i ON w.path = i.path WHERE i.is_dir),
kept AS (SELECT * FROM wins w WHERE NOT EXISTS (SELECT 1 FROM dirs_in d WHERE starts_with(w.path, d.path || '/')))"""
for k, name in enumerate(("dev_artifacts", "package_caches", "model_caches", "temp_and_browser", "crash_dumps", "old_installers"), 1):
    SQL[f"det_{name}"] = f"{DETECT} SELECT path, category_group, category, ordinal FROM d{k}"
SQL["det_large_logs"] = f"{DETECT} SELECT path, category_group, category, ordinal FROM d8"
SQL["cand_first_wins"] = f"{DETECT} SELECT path, category_group, category FROM wins"
# unpacked directories are named like their archive with an x behind, or with old- before: only the first come near enough, by 2n / (2n + 1)
UNPACKED = DETECT.replace("raw AS (", """z AS (SELECT *, regexp_replace(name, '\\.zip$', '') AS stem FROM inv WHERE ext = '.zip' AND file_id % 3 = 0),
x AS (SELECT *, CASE WHEN file_id % 2 = 0 THEN stem || 'x' ELSE 'old-' || stem END AS made FROM z),
d7 AS (SELECT i.path, 'archive_pairs' AS category_group, 'archive_pair' AS category, 7 AS ordinal FROM inv i WHERE ext = '.zip' AND EXISTS (SELECT 1 FROM x WHERE x.parent = i.parent AND x.made = regexp_replace(i.name, '\\.zip$', 'x'))),
raw AS (SELECT * FROM d7 UNION ALL """)
SQL["det_archive_pairs"] = f"{UNPACKED} SELECT path, category_group, category, ordinal FROM d7"  # names of other archives come near enough from ten characters on, which the sizes tested don't have
SQL["cand_all_detectors"] = f"{UNPACKED} SELECT path, category_group, category FROM wins"
SQL["cand_nested_drop"] = f"{DETECT} SELECT path, category_group FROM kept"
CANDS = f"""{DETECT},
v AS (SELECT k.path, i.is_dir, k.category_group, k.category, CASE WHEN i.is_dir THEN coalesce((SELECT sum(size) FROM inv f WHERE NOT f.is_dir AND starts_with(f.path, i.path || '/')), 0) ELSE i.size END::BIGINT AS size_bytes,
  {reason(True).replace("path)", "i.path)")} AS reason_code FROM kept k JOIN inv i ON k.path = i.path),
c AS (SELECT path, is_dir, category_group, category, size_bytes, {VERDICT} AS verdict, reason_code,
  CASE WHEN reason_code = 'finance_token' OR category_group IN ('model_caches', 'old_installers', 'large_logs') THEN 'B' ELSE 'A' END AS tier,
  CASE WHEN category_group IN ('model_caches', 'old_installers', 'large_logs') THEN 30 END::INT AS retention_days FROM v),
cands AS (SELECT * FROM c WHERE verdict <> 'blocked'),
eff AS (SELECT *, CASE WHEN category_group = 'temp_and_browser_caches' THEN size_bytes // 2 ELSE size_bytes END AS b FROM cands)"""
SQL["cand_assembled"] = f"{CANDS} SELECT * REPLACE (coalesce(retention_days, -1) AS retention_days) FROM cands"
SQL["cand_link_aware"] = f"""{DETECT}, roots AS (SELECT k.path FROM kept k JOIN inv i ON k.path = i.path WHERE i.is_dir),
u AS (SELECT r.path AS root, f.*, count(*) OVER (PARTITION BY r.path, dev, ino) AS n, row_number() OVER (PARTITION BY r.path, dev, ino ORDER BY f.path) AS r FROM roots r JOIN inv f ON starts_with(f.path, r.path || '/') WHERE NOT f.is_dir AND NOT f.is_cloud_placeholder),
s AS (SELECT root, sum({FREE})::BIGINT AS b FROM u GROUP BY root)
SELECT roots.path, coalesce(b, 0)::BIGINT AS freeable_bytes FROM roots LEFT JOIN s ON roots.path = s.root"""
SQL["cards"] = f"{CANDS} SELECT category_group, tier, count(*) AS n_items, sum(b)::BIGINT AS bytes FROM eff GROUP BY ALL"
SQL["summary"] = f"{CANDS} SELECT count(*) FILTER (tier = 'A') AS n_a, coalesce(sum(b) FILTER (tier = 'A'), 0)::BIGINT AS bytes_a, count(*) FILTER (tier = 'B') AS n_b, coalesce(sum(b) FILTER (tier = 'B'), 0)::BIGINT AS bytes_b FROM eff"
SQL["one_click"] = f"{CANDS} SELECT category_group, count(*) AS n_items, coalesce(sum(b), 0)::BIGINT AS bytes FROM eff WHERE tier = 'A' AND category_group IN ('package_caches', 'temp_and_browser_caches', 'crash_dumps', 'dev_artifacts') GROUP BY ROLLUP (category_group)"
SQL["treemap_top60"] = f"""{CANDS}, t AS (SELECT parent AS path, sum(size)::BIGINT AS bytes FROM inv WHERE NOT is_dir GROUP BY parent HAVING sum(size) > 0),
g AS (SELECT path, min(category_group) AS category_group FROM cands GROUP BY path)
(SELECT t.path, bytes, coalesce(category_group, 'other') AS category_group FROM t LEFT JOIN g ON t.path = g.path ORDER BY bytes DESC, t.path LIMIT 60) UNION ALL SELECT '(inaccessible)', 12345, 'inaccessible'"""
SQL["top10_candidates"] = f"{CANDS} SELECT path, size_bytes FROM eff ORDER BY b DESC, path LIMIT 10"
SQL["category_descriptor"] = f"""{CANDS} SELECT category_group, count(*) AS n_items, sum(size_bytes)::BIGINT AS bytes, CASE WHEN min(tier) = max(tier) THEN min(tier) ELSE 'both' END AS tier,
coalesce(CASE WHEN count(DISTINCT coalesce(retention_days, -1)) = 1 THEN max(retention_days) END, -1) AS retention_days FROM cands GROUP BY category_group"""
SQL["cand_selected"] = f"{CANDS} SELECT path, tier FROM cands WHERE category = 'temp_file' OR category_group = 'temp_file'"
SQL["count_capped"] = f"""{FIL}, e AS (SELECT path, lower(regexp_extract(path, '(\\.[^.]+)$')) AS ext FROM files)
SELECT ext, path, greatest(count(*) OVER (PARTITION BY ext) - 30, 0) AS n_over FROM e QUALIFY row_number() OVER (PARTITION BY ext ORDER BY path) <= 30"""

# ---- duplicates ----
DUP = f"""{FIL}, ok AS (SELECT *, string_split(lower(path), '/') AS seg, regexp_extract(path, '[^/]*$') AS name, lower(regexp_extract(path, '(\\.[^.]+)$')) AS ext FROM files WHERE size > 0 AND NOT is_cloud_placeholder
  UNION ALL BY NAME SELECT path, false AS is_dir, 100 AS size, 1700000000.0 AS mtime, 1700000000.0 AS ctime, 0 AS dev, 0 AS ino, 1 AS nlink, NULL AS git_repo_root, false AS git_repo_clean, false AS is_cloud_placeholder, false AS is_reparse_point, NULL AS file_id, NULL AS content, string_split(path, '/') AS seg, 'package.json' AS name, '.json' AS ext
    FROM (SELECT DISTINCT regexp_extract(path, '^(.*/p[0-9]+)/', 1) || '/package.json' AS path FROM files WHERE file_id % 10 = 2 AND (file_id % 37) % 2 = 0)),
b AS (SELECT size, count(*) AS n, ((count(*) - 1) * size)::BIGINT AS surplus_bytes FROM ok GROUP BY size HAVING count(*) >= 2),
s AS (SELECT * FROM ok WHERE size IN (SELECT size FROM b WHERE surplus_bytes >= 200000)),
p AS (SELECT *, sha256(CASE WHEN length(content) <= 1000 THEN content ELSE left(content, 500) || right(content, 500) END) AS partial_hash, sha256(content) AS full_hash FROM s),
cl AS (SELECT *, count(*) OVER (PARTITION BY size, full_hash) AS cluster_size FROM p WHERE content IS NOT NULL QUALIFY cluster_size >= 2),
rk AS (SELECT *, list_contains(seg, 'downloads') OR list_contains(seg, 'temp') AS risky, CASE WHEN git_repo_root IS NOT NULL THEN 0 WHEN list_contains(seg, 'downloads') OR list_contains(seg, 'temp') THEN 2 ELSE 1 END AS lr FROM cl),
ke AS (SELECT *, first_value(path) OVER w AS keep_path, first_value(risky) OVER w AND bool_or(NOT risky) OVER (PARTITION BY size, full_hash) AS needs_review FROM rk WINDOW w AS (PARTITION BY size, full_hash ORDER BY lr, len(seg), ctime, path)),
vv AS (SELECT *, {reason(True)} AS reason_code FROM ke WHERE path <> keep_path),
cd AS (SELECT *, {VERDICT} AS verdict FROM vv),
du AS (SELECT *, CASE WHEN verdict = 'review_only' OR needs_review THEN 'B' ELSE 'A' END AS tier FROM cd QUALIFY NOT bool_or(verdict = 'blocked') OVER (PARTITION BY size, full_hash))"""
SQL["dup_size_buckets"] = f"{DUP} SELECT size, n, surplus_bytes FROM b WHERE surplus_bytes >= 200000"
SQL["dup_immaterial"] = f"{DUP} SELECT count(*) AS n_buckets, coalesce(sum(surplus_bytes), 0)::BIGINT AS bytes FROM b WHERE surplus_bytes < 200000"
SQL["dup_size_candidates"] = f"{DUP} SELECT path, size FROM s"
SQL["dup_partial_hash"] = f"{DUP} SELECT path, partial_hash FROM p"
SQL["dup_clusters"] = f"{DUP} SELECT path, full_hash, cluster_size FROM cl"
SQL["dup_keep"] = f"{DUP} SELECT path, keep_path, path = keep_path AS is_keep, needs_review FROM ke"
SQL["dup_candidates"] = f"{DUP} SELECT path, keep_path, full_hash, size, verdict, needs_review, tier FROM du"
SQL["dup_freeable"] = f"""{DUP}, w AS (SELECT *, count(*) OVER (PARTITION BY dev, ino) AS n, row_number() OVER (PARTITION BY dev, ino ORDER BY path) AS r FROM du), x AS (SELECT size, {FREE} AS f FROM w)
SELECT sum(size)::BIGINT AS logical_bytes, sum(f)::BIGINT AS freeable_bytes, count(*) FILTER (f = 0) AS n_nothing FROM x"""
SQL["dup_review_top15"] = f"{DUP} SELECT full_hash, keep_path, count(*) AS n_duplicates, sum(size)::BIGINT AS bytes FROM du GROUP BY ALL ORDER BY bytes DESC, full_hash LIMIT 15"

# ---- event logs ----
EV = """WITH e AS (SELECT event_id AS seq, 'b' || (user_id % 40) AS batch_id, '/files/' || event_type || '/' || (user_id % 9) AS original_path, floor(value * 100)::BIGINT AS size_bytes, event_type AS category,
  CASE WHEN event_id % 3 = 0 THEN 'direct_delete' ELSE 'vault' END AS method,
  CASE WHEN event_id % 17 <> 0 THEN CASE WHEN event_id % 19 = 0 THEN '/else/' ELSE '/vault/' END || event_type || (user_id % 9) END AS vault_path,
  1700000000.0::DOUBLE + floor(date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 1000000)::DOUBLE AS at_,
  CASE WHEN event_id % 4 = 1 THEN 'restore' WHEN event_id % 4 = 3 THEN 'purge' ELSE 'apply' END AS operation,
  CASE WHEN event_id % 5 = 0 THEN 'intent' WHEN event_id % 11 = 0 THEN 'aborted' ELSE 'done' END AS phase, CASE WHEN event_id % 20 = 0 THEN 'o' || event_id ELSE 'i' || (event_id // 2) END AS intent_id, event_id % 2 = 0 AS rebuildable, event_id AS i FROM events),
ev AS (SELECT *, operation = 'restore' AS restored, operation = 'purge' AS purged, CASE WHEN i % 3 <> 0 THEN at_ + (i % 30) * 86400.0 END AS retention_until FROM e),
present AS (SELECT DISTINCT original_path AS path FROM ev WHERE right(original_path, 1) IN ('1', '4')),
lastd AS (SELECT * FROM ev WHERE phase = 'done' QUALIFY row_number() OVER (PARTITION BY batch_id, original_path ORDER BY seq DESC) = 1),
lasta AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY batch_id, original_path ORDER BY seq DESC) = 1),
elig AS (SELECT *, original_path IN (SELECT path FROM present) AS stale FROM lastd WHERE method = 'vault' AND NOT restored AND NOT purged),
el AS (SELECT * FROM elig WHERE stale OR (retention_until IS NOT NULL AND retention_until <= 1701728000.0)),
orph AS (SELECT *, CASE WHEN operation = 'apply' THEN original_path ELSE vault_path END AS source, CASE WHEN operation = 'apply' AND method = 'vault' THEN vault_path WHEN operation = 'restore' THEN original_path END AS target
  FROM ev WHERE phase = 'intent' AND intent_id NOT IN (SELECT intent_id FROM ev WHERE phase <> 'intent'))"""
SQL["log_fold_latest"] = f"{EV} SELECT batch_id, original_path, seq, method, restored FROM lastd"
SQL["log_batches"] = f"{EV} SELECT batch_id, min(at_) AS first_at, count(*) AS n_items, sum(size_bytes)::BIGINT AS bytes, count(*) FILTER (restored) AS n_restored, bool_or(method = 'vault') AS any_vault, bool_or(method = 'direct_delete') AS any_direct FROM lasta GROUP BY batch_id"
SQL["log_totals"] = f"{EV} SELECT batch_id, count(*) AS n_processed, count(*) FILTER (phase = 'done') AS n_succeeded, count(*) FILTER (phase <> 'done') AS n_failed, coalesce(sum(size_bytes) FILTER (phase = 'done'), 0)::BIGINT AS freed_bytes FROM ev WHERE phase <> 'intent' GROUP BY batch_id"
SQL["log_categories"] = f"{EV} SELECT category, count(*) AS n_items, sum(size_bytes)::BIGINT AS bytes FROM ev WHERE phase = 'done' GROUP BY category"
SQL["purge_eligible"] = f"{EV} SELECT batch_id, original_path, seq, stale FROM el"
SQL["purge_plan"] = f"{EV} SELECT batch_id, original_path, 'purge' AS decision FROM el WHERE rebuildable"
SQL["recovery_orphans"] = f"{EV} SELECT seq, intent_id, batch_id FROM orph"
OUT = "CASE WHEN target IS NULL THEN CASE WHEN {s} THEN 'aborted' ELSE 'completed' END WHEN {s} AND NOT {t} THEN 'aborted' WHEN NOT {s} AND {t} THEN 'completed' ELSE 'needs_review' END"
SQL["recovery_classify"] = (
    f"{EV}, pp AS (SELECT path FROM present UNION SELECT replace(path, '/files/', '/vault/') FROM present), x AS (SELECT *, coalesce(source IN (SELECT path FROM pp), false) AS hs, coalesce(target IN (SELECT path FROM pp), false) AS ht FROM orph) SELECT seq, source, target, {OUT.format(s='hs', t='ht')} AS outcome FROM x"
)
SQL["recovery_events"] = f"""{EV}, x AS (SELECT *, coalesce(source IN (SELECT path FROM present), false) AS hs, coalesce(target IN (SELECT path FROM present), false) AS ht FROM orph), y AS (SELECT *, {OUT.format(s='hs', t='ht')} AS outcome FROM x)
SELECT intent_id, batch_id, original_path, CASE WHEN outcome = 'completed' THEN 'done' ELSE outcome END AS phase, outcome = 'completed' AND operation = 'restore' AS restored, outcome = 'completed' AND operation = 'purge' AS purged, 1701728000.0::DOUBLE AS at FROM y"""
SQL["apply_method_plan"] = """WITH o AS (SELECT o_orderkey AS i, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 60 END AS days, trunc(o_totalprice * 10000)::BIGINT AS size, o_orderkey * 31 % 100000 AS entries FROM orders),
g AS (SELECT *, (size >= 1073741824 AND i % 4 <> 0) OR entries >= 87882 AS guarded FROM o)
SELECT i AS o_orderkey, CASE WHEN days IS NULL AND guarded THEN 'vault' WHEN days IS NULL THEN 'direct_delete' ELSE 'vault' END AS method, coalesce(CASE WHEN days IS NULL AND guarded THEN CASE WHEN i % 2 = 0 THEN 0 ELSE 30 END ELSE days END, -1)::INT AS effective_days FROM g"""
SQL["apply_skip_reason"] = """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'file_in_use' WHEN o_orderkey % 5 = 0 AND o_orderkey % 2 <> 0 THEN 'hardlink_shared' WHEN o_orderkey % 11 = 0 THEN 'identity_changed'
 WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 <> 0 THEN 'subtree_changed' END AS skip_reason FROM orders"""
SQL["subtree_mismatch"] = f"""{SCAN}, o AS (SELECT regexp_replace(path, '/[^/]*$', '') AS root, path, dev, ino FROM old), l AS (SELECT regexp_replace(path, '/[^/]*$', '') AS root, path, dev, ino + (ino % 23 = 0)::INT AS ino FROM new),
w AS (SELECT l.root, l.path, CASE WHEN o.path IS NULL THEN 'extra_path' WHEN o.dev <> l.dev OR o.ino <> l.ino THEN 'identity_differs' END AS why FROM l LEFT JOIN o ON o.root = l.root AND o.path = l.path),
f AS (SELECT root, min(path) AS path, arg_min(why, path) AS mismatch FROM w WHERE why IS NOT NULL GROUP BY root)
SELECT r.root, f.path, f.mismatch FROM (SELECT DISTINCT root FROM o) r LEFT JOIN f ON f.root = r.root"""
SQL["restore_plan"] = f"""{EV} SELECT batch_id, original_path, CASE WHEN restored THEN 'already_restored' WHEN vault_path IS NULL THEN 'no_vault_path' WHEN NOT starts_with(vault_path, '/vault/') THEN 'outside_vault'
 WHEN original_path IN (SELECT path FROM present) THEN 'destination_occupied' ELSE 'restore' END AS step FROM lastd"""
SQL["sibling_context"] = """WITH d AS (SELECT conv_id AS cluster_id, turn AS seq, CASE role WHEN 'user' THEN 'accepted' WHEN 'assistant' THEN 'rejected' ELSE 'kept' END AS decision FROM conversations)
SELECT *, count(*) FILTER (decision = 'accepted') OVER w AS n_accepted_before, count(*) FILTER (decision = 'rejected') OVER w AS n_rejected_before, count(*) FILTER (decision = 'kept') OVER w AS n_kept_before
FROM d WINDOW w AS (PARTITION BY cluster_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
SQL["label_progress"] = """WITH l AS (SELECT user_id, arg_max(event_type, event_id) AS stratum FROM events GROUP BY user_id) SELECT stratum, count(*) AS n_labelled, count(*) >= 30 AS target_met FROM l GROUP BY stratum"""
SQL["disk_alert"] = """SELECT event_id, CASE WHEN event_id % 31 = 0 THEN 'disabled' WHEN event_id % 29 = 0 OR value IS NULL THEN 'failed' WHEN value >= 50 THEN 'ok' WHEN event_id % 3 = 0 THEN 'snoozed'
 WHEN event_id % 2 = 0 AND event_id % 40 < 20 THEN 'debounced' ELSE 'notify' END AS state FROM events"""
SQL["log_tail"] = f"{EV} SELECT seq, phase FROM ev ORDER BY seq DESC LIMIT 25"
SQL["stream_fold_latest"] = f"{EV} SELECT batch_id, original_path, seq FROM lastd"
SQL["stream_daily"] = "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL"
SQL["stream_sessions"] = """WITH g AS (SELECT user_id, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 60 SECOND THEN 0 ELSE 1 END AS new FROM events)
SELECT user_id, sum(new)::BIGINT AS n_sessions, count(*)::BIGINT AS n_events FROM g GROUP BY user_id"""
SQL["stream_alerts"] = """WITH RECURSIVE e AS (SELECT (user_id % 50)::VARCHAR AS volume, event_id AS seq, epoch_us(ts) / 1e6 AS t, event_id % 17 = 0 AS snooze, CASE WHEN event_id % 29 <> 0 THEN value END AS free, event_id % 31 <> 0 AS enabled, (event_id % 3)::DOUBLE / 4 AS days,
  row_number() OVER (PARTITION BY user_id % 50 ORDER BY ts, event_id) AS n FROM events),
s AS (SELECT volume, 0::BIGINT AS n, NULL::BIGINT AS seq, NULL::DOUBLE AS last, NULL::DOUBLE AS until, NULL::VARCHAR AS state FROM (SELECT DISTINCT volume FROM e)
  UNION ALL SELECT volume, n, seq, CASE WHEN st = 'notify' THEN t ELSE last END, CASE WHEN snooze THEN t + days * 86400 ELSE until END, st
  FROM (SELECT s.volume, e.n, e.seq, e.t, e.snooze, e.days, s.last, s.until, CASE WHEN e.snooze THEN NULL WHEN NOT enabled THEN 'disabled' WHEN free IS NULL THEN 'failed' WHEN free >= 50 THEN 'ok' WHEN t < s.until THEN 'snoozed' WHEN t - s.last < 14400 THEN 'debounced' ELSE 'notify' END AS st
    FROM s JOIN e ON e.volume = s.volume AND e.n = s.n + 1) x)
SELECT volume, seq, state FROM s WHERE state IS NOT NULL"""

# ---- similarity ----
WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}_]+')"
SHINGLES = f"""WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w)"""
SQL["doc_shingle_counts"] = f"{SHINGLES} SELECT doc_id, len(s)::INT AS n_shingles FROM g"
REPS = f"{SHINGLES}, q AS (SELECT doc_id AS id, list_sort(s) AS s FROM g WHERE len(s) > 0), reps AS (SELECT id, min(id) OVER (PARTITION BY s) AS rep FROM q)"
SQL["doc_representatives"] = f"{REPS} SELECT id, rep FROM reps"
PAIRS = f"""{REPS}, x AS (SELECT id, len(s) AS n, unnest(s) AS h FROM q WHERE id IN (SELECT rep FROM reps)),
c AS (SELECT a.id AS a, b.id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM x a JOIN x b ON a.h = b.h AND a.id < b.id GROUP BY 1, 2),
pairs AS (SELECT a, b, c / (na + nb - c) AS j FROM c WHERE c / (na + nb - c) >= 0.5)"""
SQL["doc_jaccard_pairs"] = f"{PAIRS} SELECT a, b, round(j, 6) AS jaccard FROM pairs"
COMPS = f"""{PAIRS.replace('WITH w AS', 'WITH RECURSIVE w AS', 1)}, ed AS (SELECT a, b FROM pairs UNION SELECT rep, id FROM reps WHERE id > rep), e2 AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed),
reach AS (SELECT a AS id, a AS r FROM e2 UNION SELECT e2.b, reach.r FROM reach JOIN e2 ON e2.a = reach.id), comp AS (SELECT id, min(r) AS component FROM reach GROUP BY id)"""
SQL["doc_components"] = f"{COMPS} SELECT id, component FROM comp"
SQL["doc_keep"] = f"""{COMPS}, m AS (SELECT c.id, component, n_chars * 1000 AS size, 1700000000.0 - ((c.id % 400) * 86400) AS mtime FROM comp c JOIN documents ON doc_id = c.id)
SELECT id, component, first_value(id) OVER w AS keep_id, id = first_value(id) OVER w AS is_keep FROM m WINDOW w AS (PARTITION BY component ORDER BY size DESC, mtime DESC, id)"""
SQL["version_rank"] = """SELECT doc_id AS file_id, CASE doc_id % 6 WHEN 0 THEN (doc_id % 9)::DOUBLE WHEN 1 THEN (doc_id % 5)::DOUBLE WHEN 2 THEN 1.0 WHEN 3 THEN 1000.0 + doc_id % 4 WHEN 4 THEN 1000.0 END AS version_rank FROM documents"""
SQL["version_chain"] = """WITH m AS (SELECT doc_id AS id, doc_id // 50 AS chain_id, (doc_id % 7)::DOUBLE AS version_rank, 1700000000.0 - ((doc_id % 400) * 86400) AS mtime FROM documents WHERE doc_id % 10 = 4),
bad AS (SELECT DISTINCT a.chain_id FROM m a JOIN m b ON a.chain_id = b.chain_id AND a.version_rank < b.version_rank AND a.mtime > b.mtime),
p AS (SELECT *, (row_number() OVER (PARTITION BY chain_id ORDER BY version_rank, mtime, id) - 1)::INT AS position, count(*) OVER (PARTITION BY chain_id) AS n, chain_id NOT IN (SELECT chain_id FROM bad) AS signals_agree FROM m)
SELECT id, chain_id, version_rank, position, signals_agree, signals_agree AND position = n - 1 AS is_keep FROM p"""
KNN = """WITH RECURSIVE v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT x.id AS a, y.id AS b, list_cosine_similarity(x.v, y.v) AS c FROM v x JOIN v y ON x.id <> y.id),
nn AS (SELECT * FROM s WHERE c >= 0.35 QUALIFY row_number() OVER (PARTITION BY a ORDER BY c DESC, b) <= 10)"""
SQL["emb_knn"] = f"{KNN} SELECT a, b, round(c, 4) AS cosine FROM nn"
SQL["emb_groups"] = f"""{KNN}, e2 AS (SELECT a, b FROM nn UNION SELECT b, a FROM nn), reach AS (SELECT a AS id, a AS r FROM e2 UNION SELECT e2.b, reach.r FROM reach JOIN e2 ON e2.a = reach.id),
comp AS (SELECT id, min(r) AS g FROM reach GROUP BY id), worst AS (SELECT g, 1 - min(c) AS d FROM nn JOIN comp ON nn.a = comp.id GROUP BY g) SELECT id, comp.g AS "group", round(d, 4) AS distance FROM comp JOIN worst ON comp.g = worst.g"""
SQL["hash_hamming_pairs"] = """WITH h AS (SELECT vec_id AS id, array_to_string(list_transform(flatten(list_transform(range(0, 16), lambda i: list_transform([1, 1, 1, 1], lambda o: embedding[4 * i + 1]::DOUBLE + embedding[4 * i + 2]::DOUBLE + embedding[4 * i + 3]::DOUBLE + embedding[4 * i + 4]::DOUBLE))), lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '')::BIT AS h FROM embeddings),
f AS (SELECT h, min(id) AS r FROM h GROUP BY h)
SELECT x.r AS a, y.r AS b, bit_count(xor(x.h, y.h))::INT AS distance FROM f x JOIN f y ON x.r < y.r AND bit_count(xor(x.h, y.h)) <= 14 UNION ALL SELECT r, id, 0 FROM h JOIN f ON h.h = f.h AND id > r"""
SQL["burst_groups"] = """WITH e AS (SELECT event_id AS id, user_id, floor(epoch(ts))::BIGINT AS t FROM events), n AS (SELECT *, CASE WHEN t - lag(t) OVER w <= 3600 THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, id)),
b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, id ROWS UNBOUNDED PRECEDING)::BIGINT AS burst FROM n) SELECT user_id, burst, count(*) AS n, min(id) AS first_id FROM b GROUP BY ALL"""
SQL["burst_alike"] = """WITH RECURSIVE h AS (SELECT vec_id AS id, label, vec_id * 37 % 5000 AS t, array_to_string(list_transform(flatten(list_transform(range(0, 16), lambda i: list_transform([1, 1, 1, 1], lambda o: embedding[4 * i + 1]::DOUBLE + embedding[4 * i + 2]::DOUBLE + embedding[4 * i + 3]::DOUBLE + embedding[4 * i + 4]::DOUBLE))), lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '')::BIT AS h FROM embeddings),
e AS (SELECT x.id AS a, y.id AS b FROM h x JOIN h y ON x.label = y.label AND abs(x.t - y.t) <= 60 AND bit_count(xor(x.h, y.h)) <= 14), reach AS (SELECT id, id AS r FROM h UNION SELECT e.b, reach.r FROM reach JOIN e ON e.a = reach.id)
SELECT id, min(r) AS burst FROM reach GROUP BY id"""


def _hits(words: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"contains(l, '{w}')::INT" for w in words) + ")"


def _scores() -> str:
    from siltstone.operators import rules as R

    count = lambda regex: f"len(regexp_extract_all(t, '{regex}'))"
    symbols, short = count("[{}();=<>]"), "len(list_filter(lines, lambda x: len(list_filter(regexp_split_to_array(x, '\\s+'), lambda y: y <> '')) <= 8))"
    parts = {
        "receipt": f"{count('[$€£]\\s?\\d+[.,]\\d{2}\\b')} * 1.5::DOUBLE + {_hits(R.RECEIPT_KEYWORDS)}",
        "code": f"{symbols} * 0.3::DOUBLE + {_hits(R.CODE_KEYWORDS)} * 1.5::DOUBLE + CASE WHEN w > 0 AND {symbols} / greatest(w, 1) > 0.15 THEN 2.0 ELSE 0.0 END",
        "chat": f"{count('\\b\\d{1,2}:\\d{2}\\s?(?:AM|PM|am|pm)?\\b')} + {_hits(R.CHAT_KEYWORDS)} * 1.5::DOUBLE + CASE WHEN len(lines) >= 3 AND {short} / len(lines) > 0.6 THEN 1.5 ELSE 0.0 END",
        "transient_ui": f"{_hits(R.TRANSIENT_KEYWORDS)} * 2.0::DOUBLE + CASE WHEN w > 0 AND w <= 8 THEN 1.0 WHEN w <= 15 THEN 0.5 ELSE 0.0 END",
        "document": f"{_hits(R.DOCUMENT_KEYWORDS)} + CASE WHEN w >= 25 AND {count('[.!?]\\s|[.!?]$')} >= 2 THEN 1.5 ELSE 0.0 END",
    }
    columns = ", ".join(f"round(CASE WHEN w = 0 THEN 0 ELSE ({x})::DOUBLE END, 6) AS score_{k}" for k, x in parts.items())
    return f"""WITH a AS (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations),
b AS (SELECT *, lower(t) AS l, len(list_filter(regexp_split_to_array(t, '\\s+'), lambda y: y <> '')) AS w, list_filter(regexp_split_to_array(t, '\\r\\n|[\\n\\r]'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g')) <> '') AS lines FROM a),
sc AS (SELECT conv_id, turn, {columns} FROM b)"""


SQL["content_scores"] = f"{_scores()} SELECT * FROM sc"
SQL["content_tag"] = f"""{_scores()}, m AS (SELECT *, greatest(score_receipt, score_code, score_chat, score_transient_ui, score_document) AS s FROM sc)
SELECT conv_id, turn, CASE WHEN s < 1.5 THEN 'unknown' WHEN score_receipt = s THEN 'receipt' WHEN score_code = s THEN 'code' WHEN score_chat = s THEN 'chat' WHEN score_transient_ui = s THEN 'transient_ui' ELSE 'document' END AS tag, s AS tag_score FROM m"""
BUCKET = "(('0x' || substr(sha256({0}), 1, 8))::BIGINT % 256)::INT"
SQL["rank_features"] = f"""{FIL}, x AS (SELECT *, lower(regexp_extract(path, '(\\.[^.]+)$')) AS ext, {CLASS} AS cls FROM files)
SELECT file_id AS id, round(ln(1 + size::DOUBLE), 6) AS log_size, round(greatest((1700000000.0 - mtime) / 86400, 0), 6)::DOUBLE AS age_days, round(greatest((1700000000.0 - ctime) / 86400, 0), 6)::DOUBLE AS lived_days,
{BUCKET.format('ext')} AS ext_bucket, {BUCKET.format('cls')} AS class_bucket FROM x"""
SQL["rank_fallback"] = """SELECT o_custkey % 50 AS batch_id, o_orderkey AS cluster_id, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey % 3 = 0 DESC, floor(o_totalprice) DESC, o_orderkey)::INT AS place FROM orders"""

# ---- metrics ----
SQL["eval_bcubed"] = """WITH e AS (SELECT vec_id % 13 AS p, label AS t FROM embeddings), c AS (SELECT *, count(*) OVER (PARTITION BY p, t) AS n, count(*) OVER (PARTITION BY p) AS np, count(*) OVER (PARTITION BY t) AS nt FROM e),
r AS (SELECT avg(n / np) AS p, avg(n / nt) AS r FROM c) SELECT round(p, 8) AS precision, round(r, 8) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 8) AS f1 FROM r"""
CURVE = """WITH s AS (SELECT doc_id AS id, (n_chars % 97)::DOUBLE AS score, quality = 1 AS positive FROM labels JOIN documents USING (doc_id)),
c AS (SELECT id, score, row_number() OVER w AS rank, sum(positive::INT) OVER w AS tp, sum(positive::INT) OVER () AS p FROM s WINDOW w AS (ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING)),
curve AS (SELECT id, rank, tp / rank AS precision, tp / p AS recall FROM c)"""
SQL["eval_pr_curve"] = f"{CURVE} SELECT id, rank, round(precision, 8) AS precision, round(recall, 8) AS recall FROM curve"
SQL["eval_operating_point"] = f"{CURVE} SELECT id, rank, round(precision, 8) AS precision, round(recall, 8) AS recall FROM (SELECT * FROM curve WHERE precision >= 0.85 ORDER BY recall DESC, rank LIMIT 1) WHERE recall >= 0.1"
GRID = """WITH s AS (SELECT (n_chars % 97) / 97 AS s1, doc_id % 89 / 89 AS s2, quality = 1 AS positive FROM labels JOIN documents USING (doc_id)), t AS (SELECT unnest([0.0, 0.1, 0.2, 0.4, 0.6, 0.8]::DOUBLE[]) AS v),
g AS (SELECT x.v AS x, y.v AS y, count(*) FILTER (s1 >= x.v AND s2 >= y.v) AS n, count(*) FILTER (s1 >= x.v AND s2 >= y.v AND positive) AS tp, count(*) FILTER (positive) AS p FROM s, t x, t y GROUP BY ALL),
grid AS (SELECT x, y, CASE WHEN n = 0 THEN 1.0 ELSE tp / n END AS precision, CASE WHEN p = 0 THEN 0 ELSE tp / p END AS recall FROM g)"""
SQL["eval_joint_grid"] = f"{GRID} SELECT x, y, round(precision, 8) AS precision, round(recall, 8) AS recall FROM grid"
SQL["eval_joint_point"] = f"{GRID} SELECT x, y, round(recall, 8) AS recall FROM grid WHERE precision >= 0.855 ORDER BY recall DESC, x, y LIMIT 1"
SQL["eval_tier_point"] = """WITH s AS (SELECT doc_id % 3 AS tier, quality = 1 AS positive, doc_id % 89 / 89 AS s FROM labels), t AS (SELECT unnest([0.0, 0.1, 0.2, 0.4, 0.6, 0.8]::DOUBLE[]) AS threshold),
g AS (SELECT threshold, tier, count(*) FILTER (s >= threshold AND positive) / greatest(count(*) FILTER (s >= threshold), 1) AS p, count(*) FILTER (s >= threshold AND positive) / greatest(count(*) FILTER (positive), 1) AS r FROM s, t GROUP BY ALL)
SELECT threshold, round(min(r), 8) AS worst_recall FROM g GROUP BY threshold HAVING bool_and(p >= 0.8) ORDER BY min(r) DESC, threshold LIMIT 1"""
RANKS = "WITH o AS (SELECT conv_id AS g, turn AS item, row_number() OVER (PARTITION BY conv_id ORDER BY length(text), turn) AS predicted, turn + 1 AS truth, length(text) % 5 AS relevance FROM conversations)"
SQL["eval_kendall"] = f"{RANKS}, p AS (SELECT a.g, avg(sign((a.predicted - b.predicted) * (a.truth - b.truth))) AS tau FROM o a JOIN o b ON a.g = b.g AND a.item < b.item GROUP BY a.g) SELECT o.g, round(coalesce(any_value(tau), 1.0), 8) AS tau FROM o LEFT JOIN p ON o.g = p.g GROUP BY o.g"
SQL["eval_exact_order"] = f"{RANKS} SELECT g, bool_and(predicted = truth) AS exact FROM o GROUP BY g"
SQL["eval_cohen"] = """WITH t AS (SELECT count(*) AS n, count(*) FILTER (quality = toxic) AS same FROM labels), m AS (SELECT sum(a.n * b.n) AS xy FROM (SELECT quality AS v, count(*) AS n FROM labels GROUP BY 1) a JOIN (SELECT toxic AS v, count(*) AS n FROM labels GROUP BY 1) b ON a.v = b.v),
k AS (SELECT same / n AS po, xy / (n * n) AS pe FROM t, m) SELECT round(CASE WHEN pe = 1 THEN 1.0 ELSE (po - pe) / (1 - pe) END, 8)::DOUBLE AS kappa FROM k"""
SQL["eval_fleiss"] = """WITH r AS (SELECT doc_id AS item, unnest([quality, toxic, (doc_id % 2)::INT]) AS c FROM labels), n AS (SELECT item, c, count(*) AS n FROM r GROUP BY ALL), i AS (SELECT item, sum(n * (n - 1)) / (3 * 2) AS p FROM n GROUP BY item),
e AS (SELECT sum(q * q) AS pe FROM (SELECT sum(n) / (SELECT count(*) FROM r) AS q FROM n GROUP BY c)), k AS (SELECT (SELECT avg(p) FROM i) AS p, pe FROM e) SELECT round(CASE WHEN pe = 1 THEN 1.0 ELSE (p - pe) / (1 - pe) END, 8)::DOUBLE AS kappa FROM k"""
SQL["eval_ndcg"] = f"""{RANKS}, r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY relevance DESC, item) AS ideal FROM o),
s AS (SELECT g, coalesce(sum((pow(2, relevance) - 1) / log2(predicted + 1)) FILTER (predicted <= 3), 0) AS d, coalesce(sum((pow(2, relevance) - 1) / log2(ideal + 1)) FILTER (ideal <= 3), 0) AS i FROM r GROUP BY g) SELECT g, round(CASE WHEN i = 0 THEN 1.0 ELSE d / i END, 8) AS ndcg FROM s"""
SQL["eval_precision_at_k"] = f"{RANKS} SELECT g, round(avg((relevance >= 2)::INT), 8) AS precision_at_k FROM o WHERE predicted <= 3 GROUP BY g"
SQL["eval_split"] = """WITH g AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) <= greatest(1, floor((SELECT count(DISTINCT conv_id) FROM conversations) * 0.75)) AS is_train FROM (SELECT DISTINCT conv_id FROM conversations))
SELECT conv_id, turn, is_train FROM conversations JOIN g USING (conv_id)"""

# ---- scalars ----
SQL["format_bytes"] = """WITH b AS (SELECT doc_id AS file_id, n_chars * 1000 * (doc_id % 1000 + 1) AS n FROM documents), u AS (SELECT *, CASE WHEN n >= 1099511627776 THEN 4 WHEN n >= 1073741824 THEN 3 WHEN n >= 1048576 THEN 2 WHEN n >= 1024 THEN 1 ELSE 0 END AS k FROM b)
SELECT file_id, CASE WHEN k = 0 THEN n || ' B' ELSE printf('%.1f', round_even(n / pow(1024.0, k), 1)) || ' ' || ['KB', 'MB', 'GB', 'TB'][k] END AS shown FROM u"""
SQL["selection_hash"] = f"""{FIL} SELECT file_id % 25 AS g, sha256('{{"id":"docs","paths":[' || string_agg('"' || path || '"', ',' ORDER BY path) || '],"scan_id":"scan-1","tier":"A"}}') AS hash FROM files GROUP BY 1"""
SQL["version_compare"] = "SELECT o_orderkey, ((o_orderkey % 4) * 100 + o_orderkey % 7) * 100 > ((o_orderkey % 3) * 100 + o_orderkey % 5) * 100 + o_orderkey % 2 AS newer FROM orders"
SQL["uint64_roundtrip"] = """WITH u AS (SELECT o_orderkey, 18446744073709551615::HUGEINT - o_orderkey::HUGEINT * 1000000007 AS u FROM orders)
SELECT o_orderkey, (CASE WHEN u >= 9223372036854775808::HUGEINT THEN u - 18446744073709551616::HUGEINT ELSE u END)::BIGINT AS signed, true AS same FROM u"""
SQL["text_labels"] = f"""{FIL} SELECT file_id, strftime(to_timestamp(ctime) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') || '+00:00' AS created, {BUCKET.format('path')} AS bucket, (len(string_split(path, '/')) - 1)::INT AS depth FROM files"""


# ---- selections, caches and checks ----
SQL["dup_ineligible"] = f"""{DUP}, mk AS (SELECT DISTINCT regexp_extract(path, '^(.*/p[0-9]+)/', 1) AS m FROM files WHERE file_id % 10 = 2 AND (file_id % 37) % 2 = 0),
en AS (SELECT path, keep_path, CASE WHEN regexp_extract(path, '^(.*/projects/p[0-9]+)/', 1) IN (SELECT m FROM mk) THEN regexp_extract(path, '^(.*/projects/p[0-9]+)/', 1) END AS env FROM ke)
SELECT a.path, CASE WHEN a.path GLOB '/src4/*/downloads/*' THEN 'model_cache_managed' WHEN a.env IS NOT NULL AND a.env IS DISTINCT FROM b.env THEN 'cross_environment' ELSE 'none' END AS ineligible
FROM en a LEFT JOIN en b ON a.keep_path = b.path WHERE a.path <> a.keep_path"""
SQL["link_shared"] = f"""{FIL}, w AS (SELECT path, dev, ino, string_split(path, '/')[2] AS env FROM files), g AS (SELECT dev, ino, count(DISTINCT env) > 1 AS shared FROM w WHERE dev <> 0 OR ino <> 0 GROUP BY ALL)
SELECT path, coalesce(shared, false) AS shared FROM w LEFT JOIN g USING (dev, ino)"""
SQL["link_identity_changed"] = f"""{SCAN}, o AS (SELECT path, CASE WHEN file_id % 9 = 0 THEN 0 ELSE dev END AS dev, CASE WHEN file_id % 9 = 0 THEN 0 ELSE ino END AS ino FROM old), l AS (SELECT path, dev, ino + (file_id % 6 = 0)::INT AS ino FROM new)
SELECT o.path, coalesce(l.path IS NOT NULL AND NOT (o.dev = 0 AND o.ino = 0) AND (o.dev <> l.dev OR o.ino <> l.ino), false) AS changed FROM o LEFT JOIN l ON o.path = l.path"""
SQL["user_selection"] = f"""{CANDS}, asked AS (SELECT path FROM inv WHERE file_id % 4 = 0), uv AS (SELECT path, {reason(True)} AS reason_code FROM inv WHERE path IN (SELECT path FROM asked) AND path NOT IN (SELECT path FROM cands))
SELECT path, category_group, tier FROM cands WHERE path IN (SELECT path FROM asked) UNION ALL SELECT path, 'user_selected', 'B' FROM uv WHERE {VERDICT} <> 'blocked'"""
SQL["embedding_cache"] = "SELECT doc_id AS file_id, doc_id % 3 <> 0 AND doc_id % 5 <> 0 AND doc_id % 7 <> 0 AS hit FROM documents"
SQL["ocr_text"] = "SELECT user_id, coalesce(string_agg(event_type, chr(10) ORDER BY event_id) FILTER (value / 100 >= 0.9), '-') AS text FROM events GROUP BY user_id"
SQL["image_keep_best"] = """WITH RECURSIVE h AS (SELECT vec_id AS id, array_to_string(list_transform(flatten(list_transform(range(0, 16), lambda i: list_transform([1, 1, 1, 1], lambda o: embedding[4 * i + 1]::DOUBLE + embedding[4 * i + 2]::DOUBLE + embedding[4 * i + 3]::DOUBLE + embedding[4 * i + 4]::DOUBLE))), lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '')::BIT AS h FROM embeddings),
e2 AS (SELECT x.id AS a, y.id AS b FROM h x JOIN h y ON x.id <> y.id AND bit_count(xor(x.h, y.h)) <= 14), reach AS (SELECT a AS id, a AS r FROM e2 UNION SELECT e2.b, reach.r FROM reach JOIN e2 ON e2.a = reach.id),
c AS (SELECT id, min(r) AS component FROM reach GROUP BY id), s AS (SELECT *, round(2 * ln(1 + id % 50) + ln(1 + (id % 30) * 1000) - 0.05 * abs(id % 90 - 60), 9) AS score FROM c)
SELECT id, component, id = first_value(id) OVER (PARTITION BY component ORDER BY score DESC, id) AS is_keep FROM s"""
SQL["cluster_track"] = "SELECT doc_id // 3 AS g, CASE WHEN bool_or(doc_id % 10 = 4) THEN 'version_chain' ELSE 'near_duplicate' END AS track FROM documents GROUP BY 1"
SQL["pair_strata"] = """WITH h AS (SELECT vec_id AS id, array_to_string(list_transform(embedding[1:64], lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '')::BIT AS h FROM embeddings),
p AS (SELECT x.id AS a, y.id AS b, bit_count(xor(x.h, y.h)) AS d FROM h x JOIN h y ON y.id BETWEEN x.id + 1 AND x.id + 3 WHERE x.id % 4 <> 0), b AS (SELECT a, b, CASE WHEN d <= 10 THEN 'near' WHEN d <= 25 THEN 'middle' ELSE 'far' END AS bin FROM p)
SELECT a, b, bin FROM b QUALIFY row_number() OVER (PARTITION BY bin ORDER BY sha256(a || '-' || b || '-42')) <= 60"""
SQL["judge_agreement"] = """WITH g AS (SELECT doc_id % 7 <> 0 AS complete, quality = toxic AND toxic = doc_id % 2 AS same FROM labels)
SELECT count(*) FILTER (complete) AS n_complete, count(*) FILTER (complete AND same) AS n_unanimous, round(1 - count(*) FILTER (complete AND same) / count(*), 8) AS excluded_share FROM g"""
SQL["text_chunks"] = r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS w FROM documents), c AS (SELECT doc_id, w, unnest(range(0, (len(w) + 299) // 300)) AS chunk FROM w)
SELECT doc_id, chunk::INT AS chunk, sha256(array_to_string(w[chunk * 300 + 1:chunk * 300 + 300], ' ')) AS sha FROM c"""
SQL["text_cleaned"] = r"SELECT doc_id, sha256(regexp_replace(regexp_replace(coalesce(text, ''), '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g')) AS sha FROM documents"
SQL["mode_transitions"] = "SELECT o_orderkey, o_orderstatus <> 'O' OR o_orderpriority = '1-URGENT' AS accepted FROM orders"
SQL["vault_audit"] = f"""{EV}, pv AS (SELECT regexp_replace(path, '^/files/(.*)/([0-9])$', '/vault/\\1\\2') AS path FROM present) SELECT count(*) AS n_checked, count(*) FILTER (vault_path IS NULL OR vault_path NOT IN (SELECT path FROM pv)) AS n_missing
FROM lastd WHERE method = 'vault' AND NOT restored AND NOT purged"""
SQL["apply_postcondition"] = "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'source_remains' WHEN o_orderkey % 3 <> 1 AND o_orderkey % 7 = 0 THEN 'target_missing' ELSE 'ok' END AS state FROM orders"
SQL["scan_eta"] = "SELECT o_orderkey, CASE WHEN o_orderkey % 100 <= 0 OR o_orderkey % 13 <= 0 THEN -1.0::DOUBLE ELSE round(greatest(80 - o_orderkey % 100, 0) / ((o_orderkey % 100) / (o_orderkey % 13)), 6) END AS eta FROM orders"
SQL["label_pair_keys"] = "SELECT x.conv_id, x.turn AS a, y.turn AS b FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND x.turn < y.turn"
SQL["state_lenient"] = "SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INT), -1) AS k FROM events"
SQL["cloud_roots"] = "SELECT c_custkey, c_custkey % 3 <> 2 OR c_custkey % 5 = 0 AS is_root FROM customer"
SQL["eval_tier_joint"] = """WITH s AS (SELECT (n_chars % 97) / 97 AS s1, doc_id % 89 / 89 AS s2, quality = 1 AS positive, floor((n_chars % 97) / 97 * 2) AS tier FROM labels JOIN documents USING (doc_id)), t AS (SELECT unnest([0.0, 0.1, 0.2, 0.4, 0.6, 0.8]::DOUBLE[]) AS v),
g AS (SELECT tier, x.v AS x, y.v AS y, count(*) FILTER (s1 >= x.v AND s2 >= y.v) AS n, count(*) FILTER (s1 >= x.v AND s2 >= y.v AND positive) AS tp, count(*) FILTER (positive) AS p FROM s, t x, t y GROUP BY ALL),
r AS (SELECT x, y, CASE WHEN n = 0 THEN 1.0 ELSE tp / n END AS pr, CASE WHEN p = 0 THEN 0 ELSE tp / p END AS re FROM g)
SELECT x, y, round(min(re), 8) AS worst_recall FROM r GROUP BY x, y HAVING bool_and(pr >= 0.8) ORDER BY min(re) DESC, x, y LIMIT 1"""
OBSERVED = """WITH s AS (SELECT ((n_chars % 97) / 97)::DOUBLE AS s1, (doc_id % 89 / 89)::DOUBLE AS s2, quality = 1 AS positive, floor((n_chars % 97) / 97 * 2) AS tier FROM labels JOIN documents USING (doc_id)),
v AS (SELECT x, y FROM (SELECT DISTINCT s1 AS x FROM s), (SELECT DISTINCT s2 AS y FROM s)), k AS (SELECT DISTINCT tier FROM s),
c AS (SELECT k.tier, v.x, v.y, count(s.s1) AS n, count(s.s1) FILTER (positive) AS tp FROM k CROSS JOIN v LEFT JOIN s ON s.tier = k.tier AND s.s1 >= v.x AND s.s2 >= v.y GROUP BY ALL),
p AS (SELECT tier, count(*) FILTER (positive) AS p FROM s GROUP BY tier)"""
SQL["eval_joint_all"] = f"{OBSERVED} SELECT x, y, round(sum(tp) / (SELECT sum(p) FROM p), 8) AS recall FROM c GROUP BY x, y HAVING sum(n) > 0 AND sum(tp) / sum(n) >= 0.9 ORDER BY recall DESC, x, y LIMIT 1"
SQL["eval_tier_joint_all"] = f"""{OBSERVED} SELECT x, y, round(min(tp / p), 8) AS worst_recall FROM c JOIN p ON c.tier = p.tier GROUP BY x, y HAVING bool_and(n > 0 AND tp / greatest(n, 1) >= 0.88 AND tp / p >= 0.01) ORDER BY worst_recall DESC, x, y LIMIT 1"""

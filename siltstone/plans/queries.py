"""Queries over the driver's tables: each applies operators to adapted relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import paths as P
from siltstone.functions import scalars as S
from siltstone.operators import detectors as D
from siltstone.operators import duplicates as U
from siltstone.operators import eventlog as E
from siltstone.operators import inventory as I
from siltstone.operators import joint as JT
from siltstone.operators import metrics as M
from siltstone.operators import ranking as K
from siltstone.operators import report as T
from siltstone.operators import rules as R
from siltstone.operators import safety as Y
from siltstone.operators import selection as Z
from siltstone.operators import similarity as N
from siltstone.operators import tagging as G
from siltstone.sources.adapters import NOW, files, inventory, table
from siltstone.sources.shared import written
from siltstone.streaming import alerts as AL
from siltstone.streaming import folds as W

QUERIES: dict = {}


def query(f):
    """Registers a query under its function's name."""
    QUERIES[f.__name__] = f
    return f


# ---- inventory ----


@query
def inv_by_name(spark: SparkSession, d: str) -> DataFrame:
    return I.by_name(inventory(spark, d), ["node_modules", "Package.json", "docs"]).select("path", "is_dir")


@query
def inv_by_ext(spark: SparkSession, d: str) -> DataFrame:
    return I.by_ext(inventory(spark, d), [".zip", ".exe"], False).select("path", "size")


@query
def inv_larger_than(spark: SparkSession, d: str) -> DataFrame:
    return I.larger_than(inventory(spark, d), 5_000_000).select("path", "size")


@query
def inv_glob(spark: SparkSession, d: str) -> DataFrame:
    return I.matching(inventory(spark, d), "/src?/*/Downloads/*.zip").select("path")


@query
def inv_children(spark: SparkSession, d: str) -> DataFrame:
    return I.children(inventory(spark, d), "/src0").select("path", "is_dir")


@query
def inv_subtree(spark: SparkSession, d: str) -> DataFrame:
    return I.subtree(inventory(spark, d), "/src1/en", placeholders=False).select("path", "size")


@query
def inv_directory_totals(spark: SparkSession, d: str) -> DataFrame:
    return I.directory_totals(inventory(spark, d))


@query
def inv_exists(spark: SparkSession, d: str) -> DataFrame:
    paths = inventory(spark, d).filter(~F.col("is_dir")).select(F.regexp_replace("path", "\\.(log|tmp)$", ".$1").alias("path"), "file_id")
    asked = paths.select(F.when(F.col("file_id") % 3 == 0, F.concat("path", F.lit("x"))).otherwise(F.col("path")).alias("path"))
    return I.existing(asked, inventory(spark, d))


@query
def inv_ext_profile(spark: SparkSession, d: str) -> DataFrame:
    return T.by_depth(inventory(spark, d))


def _rescan(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    f = files(spark, d).drop("content")
    old = f.filter(F.col("file_id") % 5 != 0)
    i = F.col("file_id")
    new = f.filter(i % 7 != 0).withColumn("size", F.col("size") + F.when(i % 4 == 0, 1).otherwise(0)).withColumn("mtime", F.col("mtime") + F.when(i % 6 == 0, 0.5).otherwise(0.0))
    return old, new


@query
def inv_change_class(spark: SparkSession, d: str) -> DataFrame:
    return I.change_classes(*_rescan(spark, d))


@query
def inv_prune_unseen(spark: SparkSession, d: str) -> DataFrame:
    old, new = _rescan(spark, d)
    return I.unseen(old, new, "/src2").select("path")


@query
def inv_upsert(spark: SparkSession, d: str) -> DataFrame:
    old, new = _rescan(spark, d)
    old = old.select("path", "size", "mtime", (F.col("size") * 2).alias("hash_size"), F.lit("h").alias("partial_hash"))
    return I.upserted(old, new.select("path", "size", "mtime")).withColumn("hash_size", F.coalesce("hash_size", F.lit(-1)))


@query
def inv_replace_partition(spark: SparkSession, d: str) -> DataFrame:
    old, new = _rescan(spark, d)
    fresh = new.filter(P.in_subtree(F.col("path"), "/src3")).select("path", "size")
    return I.replaced_under(old.select("path", "size"), fresh, "/src3")


@query
def hash_cache_valid(spark: SparkSession, d: str) -> DataFrame:
    old, new = _rescan(spark, d)
    cached = old.select("path", F.col("size").alias("hash_size"), F.col("mtime").alias("hash_mtime"), F.concat(F.lit("p"), "file_id").alias("partial_hash"), F.lit(None).cast("string").alias("full_hash"))
    return I.valid_hashes(new.select("path", "size", "mtime").join(cached, "path", "left"))


@query
def inv_logical_bytes(spark: SparkSession, d: str) -> DataFrame:
    return I.logical_bytes(inventory(spark, d))


@query
def inv_physical_bytes(spark: SparkSession, d: str) -> DataFrame:
    return I.physical_bytes(inventory(spark, d))


@query
def link_freeable(spark: SparkSession, d: str) -> DataFrame:
    return I.freeable(files(spark, d), F.col("path")).select("path", "freeable_bytes", "resolved")


@query
def link_freeable_all(spark: SparkSession, d: str) -> DataFrame:
    """What deleting every file gives back, link by link; link_freeable under its second name."""
    return I.freeable(files(spark, d), F.col("path")).select("path", "freeable_bytes", "resolved")


def _inaccessible(spark: SparkSession, d: str) -> DataFrame:
    f = files(spark, d).filter(F.col("file_id") % 13 == 0)
    return f.select("path", F.when(F.col("file_id") % 3 != 0, F.col("size")).alias("size_estimate_bytes"))


@query
def inaccessible_summary(spark: SparkSession, d: str) -> DataFrame:
    return I.inaccessible_summary(_inaccessible(spark, d))


@query
def inaccessible_sample(spark: SparkSession, d: str) -> DataFrame:
    return _inaccessible(spark, d).orderBy("path").limit(20).withColumn("size_estimate_bytes", F.coalesce("size_estimate_bytes", F.lit(-1)))


@query
def disk_reconcile(spark: SparkSession, d: str) -> DataFrame:
    return I.reconciliation(inventory(spark, d), _inaccessible(spark, d), 10_000_000_000)


@query
def git_root_nearest(spark: SparkSession, d: str) -> DataFrame:
    inv = inventory(spark, d)
    markers = inv.filter(F.col("is_dir") & F.col("path").rlike("/projects(/p[0-9]*[05])?$")).select("path")
    return I.nearest_marker(inv.filter(~F.col("is_dir")), markers)


@query
def path_class(spark: SparkSession, d: str) -> DataFrame:
    inv = inventory(spark, d)
    return inv.select("path", I.path_class(F.col("path"), F.col("is_cloud_placeholder"), F.col("git_repo_root"), R.PATH_CLASSES).alias("path_class"))


# ---- safety and detectors ----


@query
def safety_verdict(spark: SparkSession, d: str) -> DataFrame:
    return Y.with_verdict(inventory(spark, d), deny=("*/crash/*",), allow=("*/docs/tax_1*",)).select("path", "verdict", "reason_code")


@query
def safety_reason_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = Y.with_verdict(inventory(spark, d), dev_artifacts=False)
    return rows.groupBy("verdict", "reason_code").agg(F.count(F.lit(1)).alias("n"))


@query
def det_dev_artifacts(spark: SparkSession, d: str) -> DataFrame:
    return D.dev_artifacts(inventory(spark, d))


PACKAGE_GLOBS, MODEL_GLOBS, TEMP_GLOBS, CACHE_GLOBS, DUMP_GLOBS = ("/src12/*/projects/p1?", "/src15/*/projects/*"), ("/src18/*/downloads",), ("/*/temp",), ("/src11/*/logs",), ("/src19/*/keys",)


@query
def det_package_caches(spark: SparkSession, d: str) -> DataFrame:
    return D.package_caches(inventory(spark, d), PACKAGE_GLOBS)


@query
def det_model_caches(spark: SparkSession, d: str) -> DataFrame:
    return D.model_caches(inventory(spark, d), MODEL_GLOBS, (".zip",))


@query
def det_temp_and_browser(spark: SparkSession, d: str) -> DataFrame:
    return D.temp_and_browser_caches(inventory(spark, d), CACHE_GLOBS, TEMP_GLOBS, NOW)


@query
def det_crash_dumps(spark: SparkSession, d: str) -> DataFrame:
    return D.crash_dumps(inventory(spark, d), DUMP_GLOBS)


@query
def det_old_installers(spark: SparkSession, d: str) -> DataFrame:
    return D.old_installers(inventory(spark, d), NOW)


@query
def det_large_logs(spark: SparkSession, d: str) -> DataFrame:
    return D.large_logs(inventory(spark, d), NOW, 1_000_000)


def _with_extracted(spark: SparkSession, d: str) -> DataFrame:
    inv = inventory(spark, d)
    zips = inv.filter((F.col("ext") == ".zip") & (F.col("file_id") % 3 == 0))
    stem = D.archive_stem(F.col("name"))
    near = F.when(F.col("file_id") % 2 == 0, F.concat(stem, F.lit("x"))).otherwise(F.concat(F.lit("old-"), stem))
    extra = zips.withColumn("name", near).withColumn("path", F.concat("parent", F.lit("/"), "name")).withColumn("is_dir", F.lit(True)).withColumn("ext", F.lit("")).withColumn("size", F.lit(0).cast("long"))
    return inv.unionByName(extra)


@query
def det_archive_pairs(spark: SparkSession, d: str) -> DataFrame:
    return D.archive_pairs(_with_extracted(spark, d))


def _detected(inv: DataFrame) -> DataFrame:
    return D.run_all(inv, NOW, PACKAGE_GLOBS, MODEL_GLOBS, CACHE_GLOBS, TEMP_GLOBS, DUMP_GLOBS, (".zip",), 1_000_000)


def _raw(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    inv = written(inventory(spark, d))  # every detector reads it
    raw = _detected(inv)
    return inv, raw


@query
def cand_first_wins(spark: SparkSession, d: str) -> DataFrame:
    return D.first_wins(_raw(spark, d)[1]).select("path", "category_group", "category")


@query
def cand_all_detectors(spark: SparkSession, d: str) -> DataFrame:
    """What each of the eight detectors is first to find, over an inventory with unpacked archives."""
    return D.first_wins(_detected(written(_with_extracted(spark, d)))).select("path", "category_group", "category")


@query
def cand_nested_drop(spark: SparkSession, d: str) -> DataFrame:
    inv, raw = _raw(spark, d)
    return D.without_nested(D.first_wins(raw), inv).select("path", "category_group")


def _cands(spark: SparkSession, d: str) -> DataFrame:
    inv, raw = _raw(spark, d)
    return D.assembled(raw, inv)


@query
def cand_assembled(spark: SparkSession, d: str) -> DataFrame:
    return _cands(spark, d).withColumn("retention_days", F.coalesce("retention_days", F.lit(-1)))


@query
def cand_link_aware(spark: SparkSession, d: str) -> DataFrame:
    inv, raw = _raw(spark, d)
    dirs = D.without_nested(D.first_wins(raw), inv).join(inv.select("path", "is_dir"), "path")
    return D.link_aware(dirs, inv)


def _effective(spark: SparkSession, d: str) -> DataFrame:
    return _cands(spark, d).withColumn("freeable_bytes", F.when(F.col("category_group") == "temp_and_browser_caches", F.floor(F.col("size_bytes") / 2)).cast("long"))


@query
def cards(spark: SparkSession, d: str) -> DataFrame:
    return T.cards(_effective(spark, d))


@query
def summary(spark: SparkSession, d: str) -> DataFrame:
    return T.summary(_effective(spark, d))


@query
def one_click(spark: SparkSession, d: str) -> DataFrame:
    return T.one_click(_effective(spark, d))


@query
def treemap_top60(spark: SparkSession, d: str) -> DataFrame:
    return T.treemap(inventory(spark, d), _cands(spark, d), 12_345)


@query
def top10_candidates(spark: SparkSession, d: str) -> DataFrame:
    return T.largest(_effective(spark, d)).select("path", "size_bytes")


@query
def category_descriptor(spark: SparkSession, d: str) -> DataFrame:
    return T.group_descriptor(_cands(spark, d)).withColumn("retention_days", F.coalesce("retention_days", F.lit(-1)))


@query
def cand_selected(spark: SparkSession, d: str) -> DataFrame:
    return T.selected(_cands(spark, d), ("A", "B"), "temp_file").select("path", "tier")


@query
def count_capped(spark: SparkSession, d: str) -> DataFrame:
    return T.capped(files(spark, d).withColumn("ext", P.ext_of(P.name_of(F.col("path")))).select("ext", "path"), "ext", "path", 30)


# ---- duplicates ----

FLOOR = 200_000


@query
def dup_size_buckets(spark: SparkSession, d: str) -> DataFrame:
    return U.size_buckets(inventory(spark, d), FLOOR)


@query
def dup_immaterial(spark: SparkSession, d: str) -> DataFrame:
    return U.immaterial(inventory(spark, d), FLOOR)


@query
def dup_size_candidates(spark: SparkSession, d: str) -> DataFrame:
    return U.size_candidates(inventory(spark, d), FLOOR).select("path", "size")


@query
def dup_partial_hash(spark: SparkSession, d: str) -> DataFrame:
    return U.size_candidates(inventory(spark, d, content=True), FLOOR).select("path", U.partial_hash(F.col("content"), 500).alias("partial_hash"))


@query
def dup_clusters(spark: SparkSession, d: str) -> DataFrame:
    return U.clusters(inventory(spark, d, content=True), FLOOR, 500).select("path", "full_hash", "cluster_size")


def _kept(spark: SparkSession, d: str) -> DataFrame:
    return U.with_keep(U.clusters(inventory(spark, d, content=True), FLOOR, 500))


@query
def dup_keep(spark: SparkSession, d: str) -> DataFrame:
    return _kept(spark, d).select("path", "keep_path", "is_keep", "needs_review")


@query
def dup_candidates(spark: SparkSession, d: str) -> DataFrame:
    return U.candidates(_kept(spark, d)).select("path", "keep_path", "full_hash", "size", "verdict", "needs_review", "tier")


@query
def dup_freeable(spark: SparkSession, d: str) -> DataFrame:
    return I.freeable(U.candidates(_kept(spark, d)), F.col("path")).agg(F.sum("size").alias("logical_bytes"), F.sum("freeable_bytes").alias("freeable_bytes"), F.sum((F.col("freeable_bytes") == 0).cast("long")).alias("n_nothing"))


@query
def dup_review_top15(spark: SparkSession, d: str) -> DataFrame:
    return T.capped(U.review_top(U.candidates(_kept(spark, d))).withColumn("k", F.lit(1)), "k", "full_hash", 15).drop("k", "n_over")


# ---- event logs ----


def _events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    i, u = F.col("event_id"), F.col("user_id")
    phase = F.when(i % 5 == 0, "intent").when(i % 11 == 0, "aborted").otherwise("done")
    at = F.lit(NOW) + F.timestamp_diff("SECOND", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts")).cast("double")
    op = F.when(i % 4 == 1, "restore").when(i % 4 == 3, "purge").otherwise("apply")
    path = F.concat(F.lit("/files/"), F.col("event_type"), F.lit("/"), (u % 9).cast("string"))
    vault = F.when(i % 17 != 0, F.concat(F.when(i % 19 == 0, F.lit("/else/")).otherwise(F.lit("/vault/")), F.col("event_type"), (u % 9).cast("string")))
    return e.select(
        i.alias("seq"),
        F.concat(F.lit("b"), (u % 40).cast("string")).alias("batch_id"),
        path.alias("original_path"),
        F.floor(F.col("value") * 100).cast("long").alias("size_bytes"),
        F.col("event_type").alias("category"),
        F.when(i % 3 == 0, "direct_delete").otherwise("vault").alias("method"),
        vault.alias("vault_path"),
        at.alias("at"),
        F.when(i % 3 != 0, at + (i % 30) * 86400.0).alias("retention_until"),
        (op == "restore").alias("restored"),
        (op == "purge").alias("purged"),
        phase.alias("phase"),
        F.when(i % 20 == 0, F.concat(F.lit("o"), i.cast("string"))).otherwise(F.concat(F.lit("i"), F.floor(i / 2).cast("string"))).alias("intent_id"),
        op.alias("operation"),
        (i % 2 == 0).alias("rebuildable"),
    )


LOG_NOW = NOW + 20 * 86400.0


def _present(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select("original_path").distinct().filter(F.substring("original_path", -1, 1).isin("1", "4")).select(F.col("original_path").alias("path"))


@query
def log_fold_latest(spark: SparkSession, d: str) -> DataFrame:
    return E.fold_latest(_events(spark, d)).select("batch_id", "original_path", "seq", "method", "restored")


@query
def log_batches(spark: SparkSession, d: str) -> DataFrame:
    return E.batches(_events(spark, d))


@query
def log_totals(spark: SparkSession, d: str) -> DataFrame:
    return E.volume_change(_events(spark, d))


@query
def log_categories(spark: SparkSession, d: str) -> DataFrame:
    return E.category_breakdown(_events(spark, d))


@query
def purge_eligible(spark: SparkSession, d: str) -> DataFrame:
    return E.purge_eligible(_events(spark, d), LOG_NOW, _present(spark, d)).select("batch_id", "original_path", "seq", "stale")


@query
def purge_plan(spark: SparkSession, d: str) -> DataFrame:
    ok = E.purge_eligible(_events(spark, d), LOG_NOW, _present(spark, d))
    none = _present(spark, d).limit(0)
    return E.purge_plan(ok, none, rebuildable_only=True).select("batch_id", "original_path", "decision")


@query
def recovery_orphans(spark: SparkSession, d: str) -> DataFrame:
    return E.orphan_intents(_events(spark, d)).select("seq", "intent_id", "batch_id")


@query
def recovery_classify(spark: SparkSession, d: str) -> DataFrame:
    p = _present(spark, d)
    return E.recovery(E.orphan_intents(_events(spark, d)), p.unionByName(p.select(F.replace("path", F.lit("/files/"), F.lit("/vault/")).alias("path")))).select("seq", "source", "target", "outcome")


@query
def recovery_events(spark: SparkSession, d: str) -> DataFrame:
    return E.resolving_events(E.recovery(E.orphan_intents(_events(spark, d)), _present(spark, d)), LOG_NOW)


@query
def apply_method_plan(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("o_orderkey")
    o = table(spark, d, "orders").select(
        i,
        F.lit("vault").alias("requested_method"),
        F.when(i % 3 != 0, (i % 60).cast("int")).alias("retention_days"),
        (F.col("o_totalprice") * 10000).cast("long").alias("size_bytes"),
        (i * 31 % 100000).alias("entry_count"),
        (i % 4 == 0).alias("size_guard_exempt"),
        (i % 2 == 0).alias("rebuildable"),
    )
    return E.method_plan(o).select("o_orderkey", "method", F.coalesce("effective_days", F.lit(-1)).alias("effective_days"))


@query
def apply_skip_reason(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("o_orderkey")
    method = F.when(i % 2 == 0, "vault").otherwise("direct_delete")
    return table(spark, d, "orders").select("o_orderkey", E.skip_reason(method, i % 7 == 0, i % 5 == 0, i % 11 == 0, i % 3 == 0).alias("skip_reason"))


@query
def subtree_mismatch(spark: SparkSession, d: str) -> DataFrame:
    old, new = _rescan(spark, d)
    pick = lambda f: f.select(P.parent_of(F.col("path")).alias("root"), "path", "dev", "ino")
    live = pick(new).withColumn("ino", F.col("ino") + (F.col("ino") % 23 == 0).cast("int"))
    return E.subtree_mismatch(pick(old), live, pick(old).select("root").distinct())


@query
def restore_plan(spark: SparkSession, d: str) -> DataFrame:
    return E.restore_plan(_events(spark, d), None, _present(spark, d), "/vault").select("batch_id", "original_path", "step")


@query
def sibling_context(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    decision = F.when(F.col("role") == "user", "accepted").when(F.col("role") == "assistant", "rejected").otherwise("kept")
    return E.sibling_context(c.select(F.col("conv_id").alias("cluster_id"), F.col("turn").alias("seq"), decision.alias("decision")))


@query
def label_progress(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return E.label_progress(e.select(F.col("user_id").alias("cluster_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("stratum")), 30)


@query
def disk_alert(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    free, now = F.when(i % 29 != 0, F.col("value")), i.cast("double")
    state = E.alert_state(free, F.lit(50.0), i % 31 != 0, now, F.when(i % 3 == 0, now + 5), F.when(i % 2 == 0, now - (i % 40)), 20.0)
    return table(spark, d, "events").select("event_id", state.alias("state"))


@query
def log_tail(spark: SparkSession, d: str) -> DataFrame:
    return T.tail(_events(spark, d).select("seq", "phase"), 25)


@query
def stream_fold_latest(spark: SparkSession, d: str) -> DataFrame:
    """The streaming fold run over the whole event table once."""
    path = _stream_copy(spark, d)
    return _finished(spark, W.fold_stream(_stream(spark, path)).select("batch_id", "original_path", "seq"), "complete")


@query
def stream_daily(spark: SparkSession, d: str) -> DataFrame:
    e = spark.readStream.schema(table(spark, d, "events").schema).parquet(_events_folder(spark, d)).withColumn("at", F.col("ts").cast("timestamp"))
    out = _finished(spark, W.daily_stream(e, "at", "event_type", "value"), "complete")
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))


@query
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    e = spark.readStream.schema(table(spark, d, "events").schema).parquet(_events_folder(spark, d)).withColumn("at", F.col("ts").cast("timestamp"))
    out = _finished(spark, W.session_stream(e, "user_id", "at", "60 seconds"), "complete")
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_sessions"), F.sum("n").alias("n_events"))


def _events_folder(spark: SparkSession, d: str) -> str:
    # a stream source reads folders; the table may be a file
    from siltstone.sources.shared import scratch

    path = scratch(spark)
    table(spark, d, "events").write.parquet(path)
    return path


def _stream_copy(spark: SparkSession, d: str) -> str:
    from siltstone.sources.shared import scratch

    path = scratch(spark)
    _events(spark, d).write.parquet(path)
    return path


def _stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def _finished(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """What a stream holds once its input is used up, from a table in the shared folder."""
    from siltstone.sources.shared import scratch

    out = scratch(spark)

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    run = stream.writeStream.outputMode(mode).option("checkpointLocation", scratch(spark)).trigger(availableNow=True).foreachBatch(put).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query
def stream_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Events as readings and snoozes of fifty volumes: what a keyed state machine says of each reading."""
    from siltstone.sources.shared import scratch

    i = F.col("event_id")
    e = spark.readStream.schema(table(spark, d, "events").schema).parquet(_events_folder(spark, d)).withColumn("ts", F.col("ts").cast("timestamp"))
    rows = e.select(
        (F.col("user_id") % 50).cast("string").alias("volume"), i.alias("seq"), "ts", (F.unix_micros("ts") / 1e6).alias("at"), F.when(i % 17 == 0, "snooze").otherwise("reading").alias("kind"),
        F.when(i % 29 != 0, F.col("value")).alias("free"), F.lit(50.0).alias("threshold"), (i % 31 != 0).alias("enabled"), ((i % 3) / 4).alias("days"),
    )
    out, name = scratch(spark), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, AL.STORE)
    try:
        put = lambda batch, k: batch.write.mode("overwrite").parquet(f"{out}/batch={k}")  # noqa: E731 - a batch tried again replaces itself
        AL.alerts(rows, 4 * 3600.0, late="30 days").writeStream.outputMode("append").option("checkpointLocation", scratch(spark)).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(AL.OUTPUT).parquet(out).select("volume", "seq", "state")


# ---- similarity ----


@query
def doc_shingle_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(N.shingles(F.col("text"))).alias("n_shingles"))


@query
def doc_jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    out = N.jaccard_pairs(table(spark, d, "documents"), 0.5)
    return out.select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query
def doc_representatives(spark: SparkSession, d: str) -> DataFrame:
    return N.representatives(table(spark, d, "documents"), "doc_id", "text")


@query
def doc_components(spark: SparkSession, d: str) -> DataFrame:
    return N.jaccard_components(written(N.shingle_sets(table(spark, d, "documents"), "doc_id", "text")), 0.5)


@query
def doc_keep(spark: SparkSession, d: str) -> DataFrame:
    rows = doc_components(spark, d).join(files(spark, d).select(F.col("file_id").alias("id"), "size", "mtime"), "id")
    return N.document_keep(rows).select("id", "component", "keep_id", "is_keep")


@query
def doc_minhash(spark: SparkSession, d: str) -> DataFrame:
    """Signatures of documents against the next document's, as estimates."""
    s = N.minhash(table(spark, d, "documents"), "doc_id", "text")
    n = s.select((F.col("id") - 1).alias("id"), F.col("signature").alias("other"))
    return s.join(n, "id").select("id", "n", N.signature_likeness(F.col("signature"), F.col("other")).alias("likeness"))


@query
def version_rank(spark: SparkSession, d: str) -> DataFrame:
    f = files(spark, d)
    i = F.col("file_id")
    stem = F.when(i % 6 == 0, F.concat(F.lit("plan v"), i % 9)).when(i % 6 == 1, F.concat(F.lit("plan ("), i % 5, F.lit(")"))).when(i % 6 == 2, "plan_copy").when(i % 6 == 3, F.concat(F.lit("plan_v"), i % 4, F.lit("_final"))).when(i % 6 == 4, "plan-FINAL").otherwise("planv2finals")
    return f.select("file_id", S.version_rank(stem).alias("version_rank"))


@query
def version_chain(spark: SparkSession, d: str) -> DataFrame:
    f = files(spark, d).filter(F.col("path").rlike(r"_v[0-9]+_[0-9]+\.txt$"))  # stems with a version
    rows = f.select(F.floor(F.col("file_id") / 50).alias("chain_id"), P.name_of(F.col("path")).alias("stem"), "mtime", F.col("file_id").alias("id"))
    rows = rows.withColumn("stem", F.regexp_replace("stem", "_[0-9]+\\.txt$", ""))
    return N.version_chain(rows).select("id", "chain_id", "version_rank", "position", "signals_agree", "is_keep")


@query
def emb_knn(spark: SparkSession, d: str) -> DataFrame:
    return N.knn(table(spark, d, "embeddings"), 10, 0.35).select("a", "b", F.round("cosine", 4).alias("cosine"))


@query
def emb_groups(spark: SparkSession, d: str) -> DataFrame:
    near = written(N.knn(table(spark, d, "embeddings"), 10, 0.35))
    return N.semantic_groups(near).select("id", "group", F.round("distance", 4).alias("distance"))


def _wide_hash():
    # the signs of sixteen sums of four elements, four bits each, so that some vectors are near
    e = [F.get("embedding", i).cast("double") for i in range(64)]
    sums = F.array(*(e[i] + e[i + 1] + e[i + 2] + e[i + 3] for i in range(0, 64, 4)))
    return N.sign_hash(F.flatten(F.transform(sums, lambda x: F.array_repeat(x, 4))))


@query
def hash_hamming_pairs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), _wide_hash().alias("hash"))
    return N.hamming_pairs(e, 14)


@query
def burst_groups(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))
    return N.bursts(e, ["user_id"], "at", 3600.0).groupBy("user_id", "burst").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@query
def burst_alike(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as shots of their label's group: bursts near in time and in bits."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", (F.col("vec_id") * 37 % 5000).alias("at"), _wide_hash().alias("hash"))
    return N.alike_bursts(e, ["label"], "at", "hash", 60.0, 14)


@query
def content_scores(spark: SparkSession, d: str) -> DataFrame:
    s = G.scores(table(spark, d, "conversations").select("conv_id", "turn", "text"))
    return s.select("conv_id", "turn", *(F.round(f"score_{k}", 6).alias(f"score_{k}") for k in G.TAGS))


@query
def content_tag(spark: SparkSession, d: str) -> DataFrame:
    s = G.tagged(table(spark, d, "conversations").select("conv_id", "turn", "text"))
    return s.select("conv_id", "turn", "tag", F.round("tag_score", 6).alias("tag_score"))


def _feature_rows(spark: SparkSession, d: str) -> DataFrame:
    f = files(spark, d)
    i = F.col("file_id")
    cls = I.path_class(F.col("path"), F.col("is_cloud_placeholder"), F.col("git_repo_root"), R.PATH_CLASSES)
    return f.select(
        i.alias("id"), "size", "mtime", "ctime", P.ext_of(P.name_of(F.col("path"))).alias("ext"), cls.alias("path_class"),
        (i % 6 + 1).cast("int").alias("cluster_size"), (i % 4).cast("int").alias("position"), (i % 100 / 100.0).alias("raw_score"), (i % 2 == 0).alias("is_keep"),
    )


@query
def rank_features(spark: SparkSession, d: str) -> DataFrame:
    x = K.features(_feature_rows(spark, d), NOW)
    return x.select("id", F.round("log_size", 6).alias("log_size"), F.round("age_days", 6).alias("age_days"), F.round("lived_days", 6).alias("lived_days"), "ext_bucket", "class_bucket")


@query
def rank_fallback(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    c = o.select((F.col("o_custkey") % 50).alias("batch_id"), F.col("o_orderkey").alias("cluster_id"), (F.col("o_orderkey") % 3 == 0).alias("suggests_deletion"), F.floor("o_totalprice").cast("long").alias("bytes"))
    return K.fallback_order(c).select("batch_id", "cluster_id", "place")


@query
def ranked_clutter(spark: SparkSession, d: str) -> DataFrame:
    rows = K.features(_feature_rows(spark, d), NOW)
    rows = rows.join(table(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality"), "id", "left")
    model = K.fitted(rows.filter("quality IS NOT NULL").withColumn("quality", F.col("quality").cast("double")), "quality")
    return K.ranked(model, rows.select("id", *K.FEATURES)).select("id", "score")


# ---- metrics ----


@query
def eval_bcubed(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("item"), (F.col("vec_id") % 13).alias("predicted"), F.col("label").alias("truth"))
    out = M.bcubed(e)
    return out.select(*(F.round(c, 8).alias(c) for c in out.columns))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return x.select(F.col("doc_id").alias("id"), (F.col("n_chars") % 97).cast("double").alias("score"), (F.col("quality") == 1).alias("positive"))


@query
def eval_pr_curve(spark: SparkSession, d: str) -> DataFrame:
    return M.pr_curve(_scored(spark, d)).select("id", "rank", F.round("precision", 8).alias("precision"), F.round("recall", 8).alias("recall"))


@query
def eval_operating_point(spark: SparkSession, d: str) -> DataFrame:
    p = M.operating_point(M.pr_curve(_scored(spark, d)), 0.85, 0.1)
    return p.select("id", "rank", F.round("precision", 8).alias("precision"), F.round("recall", 8).alias("recall"))


def _two(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select((F.col("score") / 97).alias("s1"), (F.col("id") % 89 / 89.0).alias("s2"), "positive")


GRID = [0.0, 0.1, 0.2, 0.4, 0.6, 0.8]


@query
def eval_joint_grid(spark: SparkSession, d: str) -> DataFrame:
    return M.grid_counts(_two(spark, d), GRID, GRID).select("x", "y", F.round("precision", 8).alias("precision"), F.round("recall", 8).alias("recall"))


@query
def eval_joint_point(spark: SparkSession, d: str) -> DataFrame:
    p = M.joint_point(M.grid_counts(_two(spark, d), GRID, GRID), 0.855)
    return p.select("x", "y", F.round("recall", 8).alias("recall"))


@query
def eval_tier_point(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "labels").select((F.col("doc_id") % 3).alias("tier"), (F.col("quality") == 1).alias("positive"), (F.col("doc_id") % 89 / 89.0).alias("s"))
    t = F.explode(F.array(*map(F.lit, GRID))).alias("threshold")
    g = x.select("tier", "positive", "s", t).groupBy("threshold", "tier")
    hit = F.col("s") >= F.col("threshold")
    p = g.agg(F.sum((hit & F.col("positive")).cast("long")).alias("tp"), F.sum(hit.cast("long")).alias("n"), F.sum(F.col("positive").cast("long")).alias("p"))
    p = p.select("threshold", "tier", (F.col("tp") / F.greatest("n", F.lit(1))).alias("precision"), (F.col("tp") / F.greatest("p", F.lit(1))).alias("recall"))
    return M.tier_point(p, 0.8).select("threshold", F.round("worst_recall", 8).alias("worst_recall"))


def _orders(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy(F.length("text"), "turn")
    return c.select(F.col("conv_id").alias("g"), F.col("turn").alias("item"), F.row_number().over(w).alias("predicted"), (F.col("turn") + 1).alias("truth"), (F.length("text") % 5).alias("relevance"))


@query
def eval_kendall(spark: SparkSession, d: str) -> DataFrame:
    return M.kendall_tau(_orders(spark, d)).select("g", F.round("tau", 8).alias("tau"))


@query
def eval_exact_order(spark: SparkSession, d: str) -> DataFrame:
    return M.exact_order(_orders(spark, d))


@query
def eval_cohen(spark: SparkSession, d: str) -> DataFrame:
    return M.cohens_kappa(table(spark, d, "labels").select(F.col("quality").alias("a"), F.col("toxic").alias("b"))).select(F.round("kappa", 8).alias("kappa"))


@query
def eval_fleiss(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "labels")
    r = x.select(F.col("doc_id").alias("item"), F.explode(F.array(F.col("quality"), F.col("toxic"), (F.col("doc_id") % 2).cast("int"))).alias("category"))
    return M.fleiss_kappa(r).select(F.round("kappa", 8).alias("kappa"))


@query
def eval_ndcg(spark: SparkSession, d: str) -> DataFrame:
    r = _orders(spark, d).select("g", "item", F.col("predicted").alias("position"), "relevance")
    return M.ndcg(r, 3).select("g", F.round("ndcg", 8).alias("ndcg"))


@query
def eval_precision_at_k(spark: SparkSession, d: str) -> DataFrame:
    r = _orders(spark, d).select("g", "item", F.col("predicted").alias("position"), "relevance")
    return M.precision_at(r, 3, 2.0).select("g", F.round("precision_at_k", 8).alias("precision_at_k"))


@query
def eval_split(spark: SparkSession, d: str) -> DataFrame:
    return M.grouped_split(table(spark, d, "conversations").select("conv_id", "turn"), "conv_id")


# ---- scalars ----


@query
def format_bytes(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).select("file_id", S.format_bytes(F.col("size") * (F.col("file_id") % 1000 + 1)).alias("shown"))


@query
def selection_hash(spark: SparkSession, d: str) -> DataFrame:
    f = files(spark, d).groupBy((F.col("file_id") % 25).alias("g")).agg(F.collect_list("path").alias("paths"))
    return f.select("g", S.selection_hash(F.lit("scan-1"), F.lit("A"), F.lit("docs"), F.col("paths")).alias("hash"))


@query
def version_compare(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("o_orderkey")
    a = F.concat(F.lit("v"), i % 4, F.lit("."), i % 7, F.lit("-rc1"))
    b = F.concat(i % 3, F.lit("."), i % 5, F.lit("."), i % 2)
    return table(spark, d, "orders").select("o_orderkey", S.is_newer(a, b).alias("newer"))


@query
def uint64_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    u = F.lit("18446744073709551615").cast("decimal(20,0)") - F.col("o_orderkey").cast("decimal(20,0)") * 1_000_000_007
    s = S.to_signed(u)
    return table(spark, d, "orders").select("o_orderkey", s.alias("signed"), (S.to_unsigned(s) == u).alias("same"))


@query
def text_labels(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).select("file_id", S.iso_time(F.col("ctime")).alias("created"), S.bucket_of(F.col("path")).alias("bucket"), P.depth_of(F.col("path")).alias("depth"))


# ---- selections, caches and checks ----


@query
def dup_ineligible(spark: SparkSession, d: str) -> DataFrame:
    kept = written(_kept(spark, d))
    markers = inventory(spark, d).filter(F.col("name") == "package.json").select(F.col("parent").alias("path"))
    env = I.nearest_marker(kept.select("path"), markers)
    rows = Z.ineligible(kept, env, P.matches_any(F.col("path"), ("/src4/*/downloads/*",)))
    return rows.select("path", F.coalesce("ineligible", F.lit("none")).alias("ineligible"))


@query
def link_shared(spark: SparkSession, d: str) -> DataFrame:
    return Z.shared_elsewhere(files(spark, d).withColumn("env", F.split("path", "/")[1]), "env")


@query
def link_identity_changed(spark: SparkSession, d: str) -> DataFrame:
    old, new = _rescan(spark, d)
    i = F.col("file_id")
    return Z.identity_changed(old.withColumn("dev", F.when(i % 9 == 0, 0).otherwise(F.col("dev"))).withColumn("ino", F.when(i % 9 == 0, 0).otherwise(F.col("ino"))), new.withColumn("ino", F.col("ino") + (i % 6 == 0).cast("int")))


@query
def user_selection(spark: SparkSession, d: str) -> DataFrame:
    inv = written(inventory(spark, d))
    asked = inv.filter(F.col("file_id") % 4 == 0).select("path").unionByName(spark.createDataFrame([("/not/there",)], "path string"))
    return Z.resolved(asked, _cands(spark, d), inv).select("path", "category_group", "tier")


@query
def embedding_cache(spark: SparkSession, d: str) -> DataFrame:
    rows = files(spark, d).select("path", "size", "mtime", F.lit("m1").alias("model"), "file_id")
    i = F.col("file_id")
    cache = rows.filter(i % 3 != 0).withColumn("mtime", F.col("mtime") + (i % 5 == 0).cast("double")).withColumn("model", F.when(i % 7 == 0, "m0").otherwise("m1"))
    return Z.cached(rows, cache).select("file_id", "hit")


@query
def ocr_text(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("conf", F.col("value") / 100)
    out = Z.confident_text(e, "user_id", "event_id", "event_type", "conf", 0.9)
    return out.select("user_id", F.coalesce("text", F.lit("-")).alias("text"))


@query
def image_keep_best(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), _wide_hash().alias("hash"))
    c = N.components(N.hamming_links(e, 14))
    i = F.col("id")
    m = c.withColumn("score", F.round(Z.quality(i % 50, (i % 30) * 1000, (i % 90).cast("double")), 9))
    return Z.keep_best(m, "component", "score").select("id", "component", "is_keep")


@query
def cluster_track(spark: SparkSession, d: str) -> DataFrame:
    f = files(spark, d).withColumn("g", F.floor(F.col("file_id") / 3)).withColumn("stem", P.name_of(F.col("path")))
    return Z.routed(f, "g", S.version_rank(F.col("stem")))


@query
def pair_strata(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("a"), N.sign_hash(F.col("embedding")).alias("h"))
    near = e.select("a", "h", F.explode(F.array(*(F.col("a") + k for k in (1, 2, 3)))).alias("b"))
    pairs = near.join(e.select(F.col("a").alias("b"), F.col("h").alias("g")), "b").select("a", "b", S.hamming(F.col("h"), F.col("g")).alias("distance"))
    return Z.stratified(pairs, pairs.filter(F.col("a") % 4 == 0)).select("a", "b", "bin")


@query
def judge_agreement(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "labels").select(F.col("doc_id").alias("record"), F.posexplode(F.array("quality", "toxic", F.when(F.col("doc_id") % 7 != 0, (F.col("doc_id") % 2).cast("int")))).alias("judge", "grade"))
    return Z.unanimous(x, 3).select("n_complete", "n_unanimous", F.round("excluded_share", 8).alias("excluded_share"))


@query
def text_chunks(spark: SparkSession, d: str) -> DataFrame:
    return Z.chunks(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "chunk", F.sha2("text", 256).alias("sha"))


@query
def text_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(Z.cleaned(F.col("text")), 256).alias("sha"))


@query
def mode_transitions(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "power").otherwise("safe").alias("to_mode"), F.col("o_orderpriority").alias("phrase"))
    return Z.transitions(o, "1-URGENT").select("o_orderkey", "accepted")


@query
def vault_audit(spark: SparkSession, d: str) -> DataFrame:
    p = _present(spark, d).select(F.regexp_replace("path", "^/files/(.*)/([0-9])$", "/vault/$1$2").alias("path"))
    return Z.vault_audit(E.fold_latest(_events(spark, d)), p)


@query
def apply_postcondition(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("o_orderkey")
    op = F.when(i % 3 == 0, "vault").when(i % 3 == 1, "direct_delete").otherwise("restore")
    return table(spark, d, "orders").select("o_orderkey", Z.postcondition(op, i % 5 == 0, i % 7 != 0).alias("state"))


@query
def scan_eta(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(F.round(Z.eta_seconds(i % 100, F.lit(80), (i % 13).cast("double")), 6), F.lit(-1.0)).alias("eta"))


@query
def label_pair_keys(spark: SparkSession, d: str) -> DataFrame:
    return Z.pair_keys(table(spark, d, "conversations"), "conv_id", "turn")


@query
def state_lenient(spark: SparkSession, d: str) -> DataFrame:
    state = F.from_json("props", "k string")
    return table(spark, d, "events").select("event_id", F.coalesce(state["k"].try_cast("int"), F.lit(-1)).alias("k"))


@query
def cloud_roots(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    name = F.concat(F.when(F.col("c_custkey") % 3 == 0, "OneDrive - ").when(F.col("c_custkey") % 3 == 1, "dropbox").otherwise("my "), "c_name")
    return c.select("c_custkey", Z.cloud_root(name, F.col("c_custkey") % 5 == 0).alias("is_root"))


@query
def eval_tier_joint(spark: SparkSession, d: str) -> DataFrame:
    x = _two(spark, d).withColumn("tier", F.floor(F.col("s1") * 2).cast("int"))
    grid = None
    for t in (0, 1):
        g = M.grid_counts(x.filter(F.col("tier") == t), GRID, GRID)
        grid = g if grid is None else grid.unionByName(g)
    best = grid.groupBy("x", "y").agg(F.bool_and(F.col("precision") >= 0.8).alias("ok"), F.min("recall").alias("worst")).filter("ok").orderBy(F.desc("worst"), "x", "y").limit(1)
    return best.select("x", "y", F.round("worst", 8).alias("worst_recall"))


@query
def eval_joint_all(spark: SparkSession, d: str) -> DataFrame:
    """The best pair of thresholds of all that are observed."""
    return JT.joint_best(_two(spark, d), 0.9).select("x", "y", F.round("worst_recall", 8).alias("recall"))


@query
def eval_tier_joint_all(spark: SparkSession, d: str) -> DataFrame:
    """The same with tiers that are each to be precise enough."""
    x = _two(spark, d).withColumn("tier", F.floor(F.col("s1") * 2).cast("int"))
    return JT.joint_best(x, 0.88, 0.01, "tier").withColumn("worst_recall", F.round("worst_recall", 8))

"""Queries over review, presentation, samples and round trips of the log sources."""

from __future__ import annotations

import os
import shutil
from contextlib import suppress

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import paths as P
from siltstone.functions import scalars as S
from siltstone.operators import applying as AP
from siltstone.operators import duplicates as U
from siltstone.operators import eventlog as E
from siltstone.operators import groups as GR
from siltstone.operators import inventory as I
from siltstone.operators import listwise as LW
from siltstone.operators import pairs as PR
from siltstone.operators import report as T
from siltstone.operators import review as V
from siltstone.operators import rules as R
from siltstone.operators import safety as Y
from siltstone.operators import selection as Z
from siltstone.operators import similarity as N
from siltstone.operators import tracks as A
from siltstone.operators import treehash as TH
from siltstone.plans import queries as Q
from siltstone.sources import files as X
from siltstone.sources import images as IM
from siltstone.sources import logs as L
from siltstone.sources import walk as WK
from siltstone.sources.adapters import files, table
from siltstone.sources.shared import scratch, written

QUERIES: dict = {}
TRACKS = ("near_identical_image", "semantic_image", "near_dup_document", "version_chain", "screenshot_burst", "ranked_clutter")
KINDS = ("max_pairwise_hamming_distance", "max_pairwise_cosine_distance", "min_pairwise_cosine_similarity_within_cluster", "min_pairwise_content_similarity_within_chain", "max_pairwise_hamming_distance", "clutter_likelihood_lambdamart")
GROUPS = (*R.PLAIN_CATEGORIES, "user_selected", "ai_new_group", "other")


def query(f):
    """Registers a query under its function's name."""
    QUERIES[f.__name__] = f
    return f


def _at(values, index):
    return F.get(F.array(*map(F.lit, values)), index.cast("int"))


def _members(spark: SparkSession, d: str) -> DataFrame:
    """Orders as members of their customer's cluster."""
    k, i = F.col("o_custkey"), F.col("o_orderkey")
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.floor("o_totalprice").cast("long").alias("size_bytes"))
    last = o.groupBy("o_custkey").agg(F.max("o_orderkey").alias("last"))
    o = o.join(last, "o_custkey").withColumn("track", _at(TRACKS, k % 6))
    position = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    raw = F.when((k % 6).isin(0, 4), (k % 15).cast("double")).when(k % 6 == 1, (k % 100) / 1000.0).when(k % 6 == 5, (k % 50) / 10.0).otherwise((90 + k % 10) / 100.0)
    return o.select(
        F.concat(F.lit("c"), k.cast("string")).alias("cluster_id"), "track", i.alias("id"), F.concat(F.lit("/m/"), i.cast("string"), F.lit(".jpg")).alias("path"), "size_bytes",
        F.when(i % 7 != 0, (i % 1000) / 100.0).alias("quality"), (F.col("track").isin(*R.SUGGESTING_TRACKS) & (k % 5 != 0) & (i == F.col("last"))).alias("is_keep"),
        F.when(F.col("track") == "version_chain", position).alias("position"), raw.alias("raw_score"), _at(KINDS, k % 6).alias("score_kind"),
    )


@query
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    return V.queued(V.clusters(_members(spark, d))).select("cluster_id", "track", "n_members", "bytes", "queue")


@query
def representative_member(spark: SparkSession, d: str) -> DataFrame:
    return V.clusters(_members(spark, d)).select("cluster_id", "representative_id")


@query
def presented_clusters(spark: SparkSession, d: str) -> DataFrame:
    return V.presented(V.clusters(_members(spark, d))).select("cluster_id", "headline", "detail", F.coalesce("browse_note", F.lit("")).alias("browse_note"), F.coalesce("shown_keep", F.lit("")).alias("keep"), "technical_detail")


@query
def chain_lines(spark: SparkSession, d: str) -> DataFrame:
    return V.chain_lines(_members(spark, d))


@query
def burst_review(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("vec_id")
    tag = F.when((F.col("label") % 3 == 0) & (i % 11 == 0), "receipt").otherwise("transient_ui")
    quality = F.when((i % 4 != 0) & (F.col("label") % 4 != 1), (i % 37) / 10.0)
    e = table(spark, d, "embeddings").select(F.col("label").cast("long").alias("burst"), i.alias("id"), tag.alias("tag"), quality.alias("quality"), N.sign_hash(F.col("embedding")).alias("hash"))
    return V.burst_review(e).select("burst", "id", "verdict", "widest", "is_keep")


@query
def common_resolution(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("o_orderkey")
    w, h = _at((1920, 1080, 2560, 4000, 1170, 2532), i % 6), _at((1080, 1920, 1440, 3000, 2532), i % 5)
    return table(spark, d, "orders").select("o_orderkey", V.common_resolution(w, h).alias("common"))


@query
def ranked_entries(spark: SparkSession, d: str) -> DataFrame:
    f = files(spark, d).select(F.col("file_id").alias("id"), "path", F.col("size").alias("size_bytes"), ((F.col("file_id") % 77) / 10.0).alias("score"))
    return V.ranked_entries(f).select("cluster_id", "track", "path", "size_bytes", "is_keep", "raw_score")


@query
def plain_categories(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey", V.plain_category(_at(GROUPS, F.col("s_suppkey") % len(GROUPS))).alias("c"))
    return s.select("s_suppkey", "c.name", F.coalesce("c.reason", F.lit("-")).alias("reason"))


def _descriptors(spark: SparkSession, d: str) -> DataFrame:
    g = T.group_descriptor(Q._cands(spark, d))
    print_of = V.descriptor_fingerprint(F.col("category_group"), F.col("n_items"), F.col("bytes"), F.col("tier"), F.col("retention_days"))
    return g.withColumn("fingerprint", print_of)


@query
def descriptor_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return _descriptors(spark, d).select("category_group", "fingerprint")


@query
def explanation_cache(spark: SparkSession, d: str) -> DataFrame:
    g = written(_descriptors(spark, d))
    whole = F.to_json(F.struct("category_group", F.concat(F.lit("about "), "category_group").alias("explanation")))
    body = F.when(F.col("tier") == "A", whole).when(F.length("category_group") % 2 == 0, "{broken").otherwise('{"category_group": "x"}')
    cache = g.filter("category_group <> 'crash_dumps'").select("fingerprint", body.alias("body"))
    return V.explained(g, cache).select("category_group", "hit", F.coalesce("explanation", F.lit("-")).alias("explanation"))


@query
def suggestions_stale(spark: SparkSession, d: str) -> DataFrame:
    i, k = F.col("o_orderkey"), F.col("o_custkey")
    made = F.when(i % 13 != 0, V.scan_id(i % 4))
    return table(spark, d, "orders").select("o_orderkey", V.stale(made, V.scan_id(k % 4)).alias("stale"))


@query
def scan_rollup(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier").select((k * 3).alias("dirs_visited"), (k * 7).alias("entries_total"), (k % 10).alias("files_written"), (k % 4).alias("files_pruned"), (k % 3).alias("skipped"), (k == -1).alias("cancelled"))
    return V.scan_rollup(s, ("dirs_visited", "entries_total", "files_written", "files_pruned", "skipped"))


@query
def keep_rationale(spark: SparkSession, d: str) -> DataFrame:
    kept = Q._kept(spark, d).filter("is_keep")
    return kept.select("path", V.keep_rationale(F.col("path"), F.col("git_repo_root"), F.col("ctime")).alias("rationale"))


@query
def restorable_counts(spark: SparkSession, d: str) -> DataFrame:
    out = V.restorable(E.restore_plan(Q._events(spark, d), None, Q._present(spark, d), "/vault"))
    return out.withColumn("error", F.coalesce("error", F.lit("-")))


def _guarded(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    f = files(spark, d)
    error = F.when(F.col("content").isNull(), "unreadable").when(F.col("size") > 10_000_000, "timeout")
    return V.guarded_hashes(f, F.sha2("content", 256), error)


@query
def guarded_hashes(spark: SparkSession, d: str) -> DataFrame:
    return _guarded(spark, d)[0]


@query
def hash_skips(spark: SparkSession, d: str) -> DataFrame:
    return V.skip_report(_guarded(spark, d)[1])


def _decisions(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c_custkey")
    return table(spark, d, "customer").select(F.concat(F.lit("c"), c.cast("string")).alias("cluster_id"), _at(("duplicates", "not_duplicates", "unsure"), c % 3).alias("decision"), (c % 50).alias("keep_id"), c.alias("seq"))


@query
def label_rows(spark: SparkSession, d: str) -> DataFrame:
    """Labels written as a log of JSON lines and read back."""
    rows = V.label_rows(_members(spark, d), _decisions(spark, d))
    path = scratch(spark)
    rows.write.mode("append").json(path)
    back = spark.read.schema("cluster_id string, decision string, keep_id long, seq long, track string, raw_score double, score_kind string, n_members long").json(path)
    return back.select("cluster_id", "decision", "keep_id", "seq", "track", "raw_score", "n_members")


@query
def event_log_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The event log in two batches, one tried twice, the later lines without the newer fields, and lines cut short, read back with defaults."""
    e, path = Q._events(spark, d).drop("rebuildable"), scratch(spark)
    L.append_events(e.filter("seq % 2 = 0"), path, "even")
    L.append_events(e.filter("seq % 2 = 1").drop("phase", "operation", "restored", "purged"), path, "odd")
    L.append_events(e.filter("seq % 2 = 0"), path, "even")
    e.select(F.substring(F.to_json(F.struct("seq", "batch_id", "original_path")), 1, 30)).write.mode("append").text(f"{path}/sink_batch=cut")
    back = L.read_events(spark, path)
    return back.groupBy("phase", "operation", "schema_version").agg(F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("bytes"), F.sum(F.col("restored").cast("long")).alias("n_restored"))


@query
def vault_table(spark: SparkSession, d: str) -> DataFrame:
    """A tab-separated list with a mark at its start and malformed lines, as rows and counts of lines left out."""
    k = F.col("c_custkey")
    mark = F.when(k == 1, "\ufeff").otherwise("")
    cells = F.concat_ws("\t", F.concat(mark, F.lit("/f/"), k.cast("string")), F.concat(F.lit("/v/"), "c_name"), F.when(k % 7 == 0, "many").otherwise((k * 11).cast("string")))
    lines = table(spark, d, "customer").select(F.when(k % 10 == 3, "only\ttwo").otherwise(cells).alias("value"))
    path = scratch(spark)
    lines.write.text(path)
    rows, bad = L.read_vault_table(spark, path)
    return rows.unionByName(bad.groupBy().agg(F.count(F.lit(1)).alias("size_bytes")).select(F.lit("(malformed)").alias("original_path"), F.lit("").alias("vault_path"), "size_bytes"))


@query
def scanned_tree(spark: SparkSession, d: str) -> DataFrame:
    """A tree of text files, listed as inventory rows with their texts."""
    path = scratch(spark)
    table(spark, d, "nation").select("n_nationkey", "n_name").coalesce(1).write.partitionBy("n_nationkey").text(path)
    found = X.scan(spark, path, content=True).filter(F.col("ext") == ".txt")
    both = found.join(X.texts(found), "path")
    return both.select(P.name_of(F.col("parent")).alias("folder"), "size", F.sha2("text", 256).alias("sha"), "is_dir")


@query
def variant_blocks(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    images = table(spark, d, "part").select(F.floor(k / 4).alias("block"), k.alias("id"), ((k % 4 == 0) | (k % 9 == 0)).alias("is_original"))
    return V.with_variants(images)


@query
def promotion_guard(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.when(k % 3 == 0, 0).otherwise(k % 5).alias("realistic"), F.when(k % 2 == 0, 0).otherwise(3).alias("synthetic"), (k % 4).alias("tail"))
    return V.promotable(s).select("name", F.coalesce("refused", F.lit("-")).alias("refused"))


@query
def long_prefix(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    p = F.concat(_at(("", "\\\\?\\", "\\\\?\\UNC\\", "\\\\srv\\"), k % 4), F.lit("C:\\data\\"), "s_name")
    return table(spark, d, "supplier").select("s_suppkey", V.without_long_prefix(p).alias("path"))


@query
def vault_names(spark: SparkSession, d: str) -> DataFrame:
    e = Q._events(spark, d)
    return e.select("seq", V.vault_name("/vault", F.col("batch_id"), F.col("original_path"), F.col("seq")).alias("vault_path"))


@query
def pair_sample(spark: SparkSession, d: str) -> DataFrame:
    """Pairs for labels, drawn from all pairs of all vectors."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), N.sign_hash(F.col("embedding")).alias("h"))
    return V.sampled_pairs(e, S.hamming, draws=20_000)


@query
def review_tracks(spark: SparkSession, d: str) -> DataFrame:
    """The state of each track of an analysis, one of which can't run."""

    def without_model() -> DataFrame:
        raise FileNotFoundError("no model given")

    def failing() -> DataFrame:
        return table(spark, d, "events").select(F.raise_error(F.lit("unreadable")).cast("long").alias("cluster"), F.col("event_id").alias("id"))

    shots = table(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))
    tracks = {
        "near_dup_document": lambda: N.representatives(table(spark, d, "documents"), "doc_id", "text").filter("id > rep").select(F.col("rep").alias("cluster"), "id"),
        "semantic_image": without_model,
        "screenshot_burst": lambda: N.bursts(shots, ["user_id"], "at", 3600.0).select(F.col("burst").alias("cluster"), "id"),
        "ocr": failing,
    }
    rows, states = V.run_tracks(spark, tracks)
    per = rows.groupBy("track").agg(F.count_distinct("id").alias("n_ids"))
    return states.join(per, "track", "left").select("track", "state", "n_rows", F.coalesce("n_ids", F.lit(0)).alias("n_ids"), F.col("reason").isNotNull().alias("has_reason"))


def _letter_counts() -> Column:
    """How often each letter of the alphabet is in a text, as its vector; null without any."""

    @F.pandas_udf("array<double>")
    def counted(low: pd.Series) -> pd.Series:
        # bytes of these letters are part of no other character
        return pd.Series([None if x is None else np.bincount(np.frombuffer(x.encode(), dtype=np.uint8), minlength=256)[97:123].astype(np.float64) for x in low], dtype=object)

    return F.when(F.regexp_like("text", F.lit("[a-zA-Z]")), counted(F.lower("text")))


def _letters(spark: SparkSession, d: str) -> DataFrame:
    """The letter counts of each document as its vector."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), _letter_counts().alias("v"))


@query
def two_stage_documents(spark: SparkSession, d: str) -> DataFrame:
    """Document clusters by shingles, then by vectors within each group."""
    sets = N.shingle_sets(table(spark, d, "documents"), "doc_id", "text")
    out = V.two_stage_clusters(sets, _letters(spark, d), 0.1, 0.99)
    return out.select("id", "cluster", F.round("raw_score", 6).alias("raw_score"))


@query
def cand_safe_mode(spark: SparkSession, d: str) -> DataFrame:
    """Candidates that are left in the careful mode."""
    on = [g for g, (is_on, _, _) in Y.categories("safe").items() if is_on]
    return Q._cands(spark, d).filter(F.col("category_group").isin(*on)).select("path", "category_group")


@query
def stored_hashes(spark: SparkSession, d: str) -> DataFrame:
    old, new = Q._rescan(spark, d)
    known = old.select("path", "size", F.lit("old").alias("partial_hash"), F.lit(None).cast("string").alias("full_hash"))
    fresh = new.filter(F.col("file_id") % 2 == 0).select("path", F.lit("new").alias("partial_hash"), F.md5("path").alias("full_hash"))
    return I.stored_hashes(known, fresh).select("path", "size", "partial_hash", F.coalesce("full_hash", F.lit("-")).alias("full_hash"))


@query
def selected_totals(spark: SparkSession, d: str) -> DataFrame:
    c = written(Q._cands(spark, d))
    return V.selected_totals(c, c.filter(F.col("path").rlike("[02468]\\.")), c.filter(F.col("path").rlike("4\\.")).select("path"))


@query
def supported_documents(spark: SparkSession, d: str) -> DataFrame:
    f = files(spark, d)
    return f.select("path", P.ext_of(P.name_of(F.col("path"))).isin(*R.DOCUMENT_EXTENSIONS).alias("supported"))


# ---- images, settings and states ----


@query
def image_features(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as grey images of 8 times 8."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("pixels"))
    return V.image_features(e, "pixels", 8, 8).select("vec_id", "dhash", F.round("sharpness", 6).alias("sharpness"), F.round("spread", 6).alias("spread"))


@query
def category_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select("s_suppkey", V.category_label(_at(GROUPS, F.col("s_suppkey") % len(GROUPS))).alias("label"))


@query
def settings_listing(spark: SparkSession, d: str) -> DataFrame:
    return V.settings(spark, "safe").withColumn("retention_days", F.coalesce("retention_days", F.lit(-1)))


@query
def batch_estimates(spark: SparkSession, d: str) -> DataFrame:
    return V.batch_estimates(Q._events(spark, d), 2.0).select("batch_id", "n_items", F.round("seconds", 6).alias("seconds"), "warn")


@query
def shown_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier").select("s_suppkey", _at(("completed", "cancelled", "completed"), k % 3).alias("status"), (k % 2 + 1).alias("n_roots"), _at(("/c", "/c/users", "/d"), k % 5).alias("root"), (k * 10).alias("delta_bytes"), (k / 4).alias("delta_percent"))
    out = V.shown_reconciliation(s)
    return out.select("s_suppkey", F.coalesce("delta_bytes", F.lit(-1)).alias("delta_bytes"), F.coalesce("delta_percent", F.lit(-1.0)).alias("delta_percent"))


@query
def eligible_paths(spark: SparkSession, d: str) -> DataFrame:
    inv = Q.inventory(spark, d)
    asked = inv.select(F.when(F.length("path") % 2 == 0, F.col("path")).otherwise(F.concat("path", F.lit("?"))).alias("path"))
    return V.eligible_paths(asked, Y.with_verdict(inv))


@query
def cache_roots(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    path = F.concat(F.lit("/hub/"), _at(("models", "Datasets", "spaces", "other"), k % 4), F.lit("--"), "p_brand", _at(("/blobs/", "/snapshots", "/x/", "/refs/"), k % 5), k.cast("string"))
    return table(spark, d, "part").select("p_partkey", F.coalesce(V.cache_object_root(path), F.lit("-")).alias("root"))


@query
def protected_roots(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    path = F.concat(_at(("C:/Windows/", "C:/Users/", "//srv/share/", "//?/UNC/srv/", "//?/C:/Windows/", "c:/program files/"), k % 6), "s_name")
    return table(spark, d, "supplier").select("s_suppkey", V.protected_root(path).alias("protected"))


@query
def restore_violations(spark: SparkSession, d: str) -> DataFrame:
    last = E.fold_latest(Q._events(spark, d))
    return V.restore_violations(last, "/vault", ("/files/click/*",)).groupBy("original_path", "why").agg(F.count(F.lit(1)).alias("n"))


@query
def purge_records(spark: SparkSession, d: str) -> DataFrame:
    last = E.fold_latest(Q._events(spark, d)).withColumn("is_dir", F.when(F.col("seq") % 3 == 0, F.col("seq") % 2 == 0)).withColumn("original_path", F.concat("original_path", F.lit(".PDF")))
    return Y.with_verdict(V.purge_records(last)).groupBy("path", "is_dir", "ext", "verdict").agg(F.sum("size").alias("bytes"))


@query
def notification_states(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    log = table(spark, d, "events").select((F.col("user_id") % 50).alias("volume"), i.alias("seq"), i.cast("double").alias("at"), _at(("notified", "snooze", "other", "notified"), i % 4).alias("kind"), (i % 5).alias("days"))
    return V.notification_state(log)


@query
def listed_bytes(spark: SparkSession, d: str) -> DataFrame:
    inv = Q.inventory(spark, d)
    return V.listed_bytes(inv.filter("is_dir"), inv.filter((F.col("size") % 3 != 0) & ~F.col("is_dir"))).select("path", F.coalesce("size_estimate_bytes", F.lit(-1)).alias("bytes"), "partial")


@query
def groups_still_there(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    members = e.select(F.col("vec_id").alias("id"), F.floor(F.col("vec_id") / 3).alias("group"))
    return V.still_there(members, e.filter("label % 4 <> 1").select(F.col("vec_id").alias("id")))


@query
def ranking_rows(spark: SparkSession, d: str) -> DataFrame:
    f = files(spark, d)
    members = f.select("file_id", F.when(F.col("size") % 2 == 0, F.col("path")).otherwise("/gone").alias("path"))
    return V.ranking_rows(members, f).select("file_id", "mtime", "ctime", "is_cloud_placeholder")


@query
def residual_images(spark: SparkSession, d: str) -> DataFrame:
    """Vectors that no near pair has, for the next track."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), Q._wide_hash().alias("hash"))
    used = N.hamming_links(e, 4).select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return e.join(used.hint("merge"), "id", "left_anti").select("id")


@query
def candidate_display(spark: SparkSession, d: str) -> DataFrame:
    """Candidates with the copy that is kept of their content, where they are duplicates."""
    kept = Q._kept(spark, d).filter(~F.col("is_keep")).select("path", "keep_path")
    rows = Q._cands(spark, d).join(kept, "path", "left")
    return rows.select("path", V.category_label(F.col("category_group")).alias("label"), S.format_bytes(F.col("size_bytes")).alias("shown"), F.coalesce("keep_path", F.lit("-")).alias("keep_path"))


@query
def member_hashes(spark: SparkSession, d: str) -> DataFrame:
    """The cached hash where it still counts, else a new one."""
    old, _ = Q._rescan(spark, d)
    cache = old.select("path", F.col("size").alias("hash_size"), F.when(F.length("path") % 2 == 0, F.col("mtime")).otherwise(0.0).alias("hash_mtime"), F.md5("path").alias("partial_hash"), F.lit(None).cast("string").alias("full_hash"))
    f = files(spark, d)
    valid = I.valid_hashes(f.select("path", "size", "mtime").join(cache, "path", "left")).select("path", "partial_hash")
    return f.join(valid, "path").select("path", F.coalesce("partial_hash", F.sha2("content", 256), F.lit("-")).alias("hash"))


@query
def log_of_batch(spark: SparkSession, d: str) -> DataFrame:
    e = Q._events(spark, d)
    return E.fold_latest(e.filter(F.col("batch_id") == "b7")).select("original_path", "seq", "method")


@query
def stat_cache(spark: SparkSession, d: str) -> DataFrame:
    return I.subtree(Q.inventory(spark, d), "/src2/de").filter(~F.col("is_dir")).select("path", "size", "mtime")


# ---- all tracks over one inventory ----


def _media(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as images and texts as documents of one inventory, with even and odd ids; the analysis writes them once."""
    i, name = F.col("vec_id"), F.when(F.col("vec_id") % 3 == 0, "Screenshot_").otherwise("photo_")
    images = table(spark, d, "embeddings").select(
        (i * 2).alias("id"), F.concat(F.lit("/pics/"), F.col("label").cast("string"), F.lit("/"), name, i.cast("string"), F.when(i % 5 == 0, ".jpg").otherwise(".PNG")).alias("path"),
        F.when(i % 41 == 0, 50_000_000).otherwise((i % 7 + 1) * 1000).cast("long").alias("size"), (i * 37 % 5000).cast("double").alias("mtime"), (F.col("label") * 100 + 800).cast("int").alias("width"), F.lit(600).alias("height"),
        F.when(i % 29 != 0, Q._wide_hash()).alias("hash"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"), F.lit(None).cast("string").alias("text"),
    )
    k = F.col("doc_id")
    stem = F.concat(F.when(k % 4 == 0, F.concat(F.lit("plan_v"), (k % 9).cast("string"), F.lit("_"))).otherwise(F.lit("note_")), k.cast("string"))
    texts = table(spark, d, "documents").select(
        (k * 2 + 1).alias("id"), F.concat(F.lit("/docs/"), stem, F.lit(".txt")).alias("path"), F.when(k % 53 == 0, 50_000_000).otherwise(F.col("n_chars")).cast("long").alias("size"), F.lit(0.0).alias("mtime"),
        F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), F.lit(None).cast("long").alias("hash"), _letter_counts().alias("vector"), "text",
    )
    return images.unionByName(texts)


def _analysis(spark: SparkSession, d: str, whole: bool) -> tuple[DataFrame, A.Analysis]:
    inv = _media(spark, d)
    return inv, A.analysis(inv, vector=0.35, text=0.99, whole=whole)


@query
def analysis_tracks(spark: SparkSession, d: str) -> DataFrame:
    """The state of each of the six tracks over one inventory, and the files left out."""
    a = _analysis(spark, d, False)[1]
    states = a.states.select("track", "state", F.col("reason").isNotNull().alias("has_reason"), "n_considered", "n_members", "n_clusters")
    none = F.lit(0).cast("long")
    return states.unionByName(a.left_out.select(F.concat(F.lit("too large: "), "kind").alias("track"), F.lit("left out").alias("state"), F.lit(True).alias("has_reason"), F.col("n").alias("n_considered"), none.alias("n_members"), none.alias("n_clusters")))


@query
def analysis_members(spark: SparkSession, d: str) -> DataFrame:
    """The members of all clusters of all tracks with their scores; images claimed by one track aren't in the next. A track that fails is an error."""
    return _analysis(spark, d, True)[1].members.withColumn("raw_score", F.round("raw_score", 5))


@query
def analysis_order(spark: SparkSession, d: str) -> DataFrame:
    """All clusters of an analysis in the order without a model. A track that fails is an error."""
    inv, a = _analysis(spark, d, True)
    return A.in_order(a.members, inv)


@query
def emb_groups_all(spark: SparkSession, d: str) -> DataFrame:
    """Groups of vectors by all links of a likeness, however many copies are near."""
    return GR.threshold_groups(table(spark, d, "embeddings"), 0.35).select("id", "group", F.round("distance", 5).alias("distance"))


# ---- walking a tree ----


def _plant(batches):
    """Makes in each folder a link to itself and directories so deep that the last can't be looked at under its path; making them again changes nothing."""
    for batch in batches:
        for folder in batch["path"]:
            if not os.path.lexists(f"{folder}/link"):
                os.symlink(folder, f"{folder}/link")
            here = os.open(folder, os.O_RDONLY)
            for _ in range(18):
                with suppress(FileExistsError):
                    os.mkdir("d" * 250, dir_fd=here)
                below = os.open("d" * 250, os.O_RDONLY, dir_fd=here)
                os.close(here)
                here = below
            os.close(here)
        yield batch


def _pull_up(batches):
    """Removes the deep directories that _plant() made, which other programs may stumble over."""
    for batch in batches:
        for folder in batch["path"]:
            shutil.rmtree(f"{folder}/{'d' * 250}", ignore_errors=True)
        yield batch


def _walked(spark: SparkSession, d: str) -> tuple[str, DataFrame]:
    """The walk of a tree with a folder for each nation and segment of customers, their names in a file, and what _plant() adds to each nation's folder for as long as the walk takes."""
    path = scratch(spark)
    names = table(spark, d, "customer").select("c_nationkey", "c_mktsegment", "c_name")
    names.repartition("c_nationkey", "c_mktsegment").write.partitionBy("c_nationkey", "c_mktsegment").text(path)
    root = "/" + path.removeprefix("file:").lstrip("/")
    nations = WK.entries(WK.read_tree(spark, root)).filter(F.col("is_dir") & (F.col("parent") == root)).select("path")
    nations = written(nations)
    nations.mapInPandas(_plant, "path string").count()
    rows = written(WK.read_tree(spark, root))
    nations.mapInPandas(_pull_up, "path string").count()
    return root, rows


@query
def walked_tree(spark: SparkSession, d: str) -> DataFrame:
    """The walk of a tree: folders, files, links that aren't followed, and what can't be read."""
    root, rows = _walked(spark, d)
    kind = F.when(F.col("error").isNotNull(), "unreadable").when(F.col("is_reparse_point"), "link").when(F.col("is_dir"), "dir").otherwise("file")
    short = F.regexp_replace(F.replace(F.when(kind == "file", F.col("parent")).otherwise(F.col("path")), F.lit(root), F.lit("")), "/d{250}.*$", "/deep")
    rows = rows.filter(~F.startswith("name", F.lit(".")) & ~F.startswith("name", F.lit("_"))).select(short.alias("place"), kind.alias("kind"), F.when(kind == "file", F.col("size")).otherwise(0).alias("size"), F.coalesce(F.split("error", ":")[0], F.lit("-")).alias("error"))
    return rows.filter("kind <> 'dir' OR NOT endswith(place, '/deep')")


@query
def walk_stats(spark: SparkSession, d: str) -> DataFrame:
    """What a scan says of itself: files, links, bytes, the exact number of skips and the size of their sample."""
    rows = _walked(spark, d)[1].filter(~F.startswith("name", F.lit(".")) & ~F.startswith("name", F.lit("_")))
    return WK.scan_stats(rows).select("n_files", "n_links", "bytes", "n_skipped", "skipped_bytes_known", F.size("skips").alias("n_shown"))


# ---- ranking of lists ----


def _lists(spark: SparkSession, d: str) -> DataFrame:
    """Files as rows of twenty lists with all thirteen features and a relevance: one for each of old, large and not kept, now and then one less."""
    f = files(spark, d)
    i = F.col("file_id")
    cls = I.path_class(F.col("path"), F.col("is_cloud_placeholder"), F.col("git_repo_root"), R.PATH_CLASSES)
    rows = f.select(
        F.concat(F.lit("list"), (i % 20).cast("string")).alias("grp"), i.alias("id"), "size", "mtime", "ctime", cls.alias("path_class"), _at(TRACKS, i % 6).alias("category"), P.ext_of(P.name_of(F.col("path"))).alias("ext"),
        (i % 6 + 1).alias("cluster_size"), (i % 3 == 0).alias("is_keep"), (i % 100 / 100.0).alias("raw_score"), "is_cloud_placeholder", (i % 5).alias("n_accepted"), (i % 7).alias("n_rejected"), (i % 4).alias("n_kept"),
    )
    x = LW.features(rows, Q.NOW)
    label = (F.col("age_days") > 200).cast("int") + (F.col("size") > 2_000_000).cast("int") + (~F.col("is_keep")).cast("int")
    return x.withColumn("label", F.greatest(F.lit(0), label - (F.col("id") % 11 == 0).cast("int")).cast("int"))


@query
def rank_features_all(spark: SparkSession, d: str) -> DataFrame:
    x = _lists(spark, d)
    return x.select("id", *(F.round(c, 6).alias(c) for c in LW.FEATURES))


@query
def ranked_listwise(spark: SparkSession, d: str) -> DataFrame:
    """The places that a ranker of lists, which has learnt from the first ten, gives all rows in their lists."""
    x = written(_lists(spark, d))
    first = F.regexp_extract("grp", "([0-9]+)", 1).cast("int") < 10
    model = LW.fitted(x.filter(first).select("grp", "id", "label", *LW.FEATURES), rounds=10)
    return model.ranked(x).select("grp", "id", "label", "place")


# ---- digests of ranges ----


@query
def dup_tree_hash(spark: SparkSession, d: str) -> DataFrame:
    """Whole contents by the digests of their ranges: equal ones, and how many of each."""
    leaves = TH.leaves_of(files(spark, d), "path", "content", 1000)
    hashes = TH.tree_hashes(leaves, "path", 1000, 8)
    same = TH.tree_clusters(hashes).select("path", "cluster_size")
    return hashes.join(same, "path", "left").select("path", "size", "tree_hash", F.coalesce("cluster_size", F.lit(1)).alias("cluster_size"))


# ---- what is to be labelled ----


@query
def label_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of near hashes, and pairs of the other strata from outside them, drawn until each stratum is full."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), N.sign_hash(F.col("embedding")).alias("h"))
    return PR.label_candidates(e).withColumn("distance", F.coalesce("distance", F.lit(-1)))


# ---- texts of documents ----


@query
def document_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Texts packed as word-processor files and read again; some are cut short, some of another kind or missing."""
    k = F.col("doc_id")
    path = F.concat(F.lit("/d/"), k.cast("string"), F.when(k % 5 == 1, ".txt").when(k % 5 == 2, ".pdf").otherwise(".docx"))
    # the characters that such files can't hold are left out first
    clean = F.regexp_replace("text", "[\\x00-\\x08\\x0B-\\x1F\\x{FFFE}\\x{FFFF}]", "")
    rows = table(spark, d, "documents").select(k, path.alias("path"), clean.alias("text"))
    packed = X.packed(rows).join(rows.select("path", k, F.col("text").alias("said")), "path")
    content = F.when(k % 7 == 3, None).when(k % 5 == 1, F.encode("said", "utf-8")).when(k % 11 == 4, F.substring("content", F.lit(1), F.lit(40))).otherwise(F.col("content"))
    out = X.document_texts(packed.select("path", P.ext_of(P.name_of(F.col("path"))).alias("ext"), content.alias("content")))
    return out.select("path", F.sha2(F.coalesce("text", F.lit("-")), 256).alias("sha"), F.coalesce("reason", F.lit("-")).alias("reason"))


# ---- repositories, decisions, texts that differ, pairs with their truth, settings of the kinds there are ----


@query
def repositories_clean(spark: SparkSession, d: str) -> DataFrame:
    """Files with the nearest repository and whether an outside check found it clean; a check that failed doesn't."""
    inv = Q.inventory(spark, d)
    roots = inv.filter(F.col("is_dir") & F.col("path").rlike("/projects/p[0-9]*[05]$"))
    marks = roots.select(F.concat("path", F.lit("/.git")).alias("path"), F.lit(True).alias("is_dir"), F.lit(".git").alias("name"), F.col("path").alias("parent"))
    rows = inv.select("path", "is_dir", "name", "parent").unionByName(marks)
    clean = roots.select(F.col("path").alias("root"), F.when(F.col("path").rlike("0$"), True).when(F.length("path") % 2 == 0, F.lit(None).cast("boolean")).otherwise(False).alias("is_clean"))
    out = WK.with_repository(rows, clean).filter(~F.col("is_dir"))
    return out.select("path", F.coalesce("git_repo_root", F.lit("-")).alias("git_repo_root"), "git_repo_clean")


@query
def feedback_rows(spark: SparkSession, d: str) -> DataFrame:
    """Decisions on members with what the ranking looks at, and the decisions before each in its cluster, through a log of lines."""
    rows = V.feedback_rows(_members(spark, d), _decided(spark, d))
    path = scratch(spark)
    L.append_events(rows, path, "all")
    back, _ = L.parsed(spark.read.option("recursiveFileLookup", "true").text(path), V.FEEDBACK)
    return back.select("cluster_id", "id", "seq", "decision", "size_bytes", "cluster_size", "n_accepted", "n_rejected", "n_kept")


def _decided(spark: SparkSession, d: str) -> DataFrame:
    """A decision on each order as a member, in order of its number."""
    i = F.col("o_orderkey")
    return table(spark, d, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("cluster_id"), i.alias("id"), i.alias("seq"), _at(("accepted", "rejected", "kept"), i % 3).alias("decision"))


@query
def text_perturbed(spark: SparkSession, d: str) -> DataFrame:
    """Texts changed in the three mild ways that an evaluation of likeness takes."""
    t = table(spark, d, "documents").filter("text IS NOT NULL")
    return t.select("doc_id", *(F.sha2(f(F.col("text")), 256).alias(n) for n, f in (("cleaned", Z.cleaned), ("reordered", V.reordered), ("pasted", V.pasted))))


@query
def pair_truth(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of the images of a few blocks each, with whether they are of one block."""
    k = F.col("p_partkey")
    images = table(spark, d, "part").select(F.floor(k / 24).alias("set"), k.alias("id"), F.floor(k / 4).alias("block"))
    return V.pairs_with_truth(images)


@query
def settings_of_groups(spark: SparkSession, d: str) -> DataFrame:
    """The settings of every group with what is found of it, in the careful mode."""
    found = Q._cands(spark, d).groupBy("category_group").agg(F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("bytes"))
    rows = V.settings(spark, "safe").join(found, "category_group", "left")
    return rows.select("category_group", "enabled", F.coalesce("retention_days", F.lit(-1)).alias("retention_days"), "forced_off", "label", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


# ---- applying batches ----


def _applied(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders as items of sixty batches, in some of which one is blocked."""
    i = F.col("o_orderkey")
    items = table(spark, d, "orders").select(
        F.concat(F.lit("b"), (F.col("o_custkey") % 60).cast("string")).alias("batch_id"), F.concat(F.lit("/f/"), i.cast("string")).alias("path"), F.lit("vault").alias("requested_method"), F.when(i % 3 != 0, (i % 60).cast("int")).alias("retention_days"),
        (F.col("o_totalprice") * 10000).cast("long").alias("size_bytes"), (i * 31 % 100000).alias("entry_count"), (i % 4 == 0).alias("size_guard_exempt"), (i % 2 == 0).alias("rebuildable"),
        F.when((F.col("o_custkey") % 60 < 9) & (i % 97 == 0), Y.BLOCKED).otherwise("eligible").alias("verdict"), (i % 47 == 0).alias("in_use"), (i % 53 == 0).alias("is_shared"), (i % 59 == 0).alias("is_changed"), (i % 61 == 0).alias("subtree_differs"),
    )
    return AP.applied(items, "/vault", Q.NOW)


@query
def apply_report(spark: SparkSession, d: str) -> DataFrame:
    """What applying whole batches would do: refusals, skips, bytes, and what is purged at once."""
    return _applied(spark, d)[2].withColumn("refusal", F.coalesce("refusal", F.lit("-")))


@query
def apply_events(spark: SparkSession, d: str) -> DataFrame:
    """The log that applying whole batches would leave."""
    return _applied(spark, d)[1].select("seq", "batch_id", "original_path", "operation", "phase", "method", "purged")


# ---- images of files, names in other forms, what is live, and lines shown ----


@query
def decoded_images(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as grey PNG files of 8 times 8, some cut, changed or missing: sizes, hash and reasons."""
    i = F.col("vec_id")
    grey = F.transform("embedding", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(x.cast("double") * 64 + 128))).cast("int"))
    packed = IM.encoded(table(spark, d, "embeddings").select(i.cast("string").alias("path"), grey.alias("pixels")), 8, 8)
    k = F.col("path").cast("long")
    broken = F.when(k % 10 == 1, F.substring("content", F.lit(1), F.lit(50))).when(k % 10 == 2, F.concat(F.lit(b"GIF89a"), "content")).when(k % 10 == 3, F.lit(None)).otherwise(F.col("content"))
    out = IM.decoded(packed.select("path", broken.alias("content")))
    hashed = V.image_features(out.select("path", "width", "height", "reason", "pixels"), "pixels", 8, 8)
    return hashed.select(k.alias("vec_id"), F.coalesce("width", F.lit(-1)).alias("width"), F.coalesce("dhash", F.lit("-")).alias("dhash"), F.coalesce("reason", F.lit("-")).alias("reason"))


@query
def paths_reread(spark: SparkSession, d: str) -> DataFrame:
    """Asked paths whose names are written apart, against names that are composed, and the other way round."""
    f = files(spark, d).select("file_id", "size", F.concat("path", F.when(F.col("file_id") % 3 == 0, "e\u0301").when(F.col("file_id") % 3 == 1, "\u00e9").otherwise("e")).alias("path"))
    asked = f.select(F.when(F.col("file_id") % 7 == 0, F.concat("path", F.lit("?"))).otherwise(F.replace(F.col("path"), F.lit("\u00e9"), F.lit("e\u0301"))).alias("path"))
    other = asked.select(F.when(F.length("path") % 2 == 0, F.replace(F.col("path"), F.lit("e\u0301"), F.lit("\u00e9"))).otherwise(F.col("path")).alias("path"))
    return I.reread(other, f).select("asked", "path", "size")


@query
def live_subtree(spark: SparkSession, d: str) -> DataFrame:
    """What is live below a folder: nothing behind a link."""
    inv = Q.inventory(spark, d)
    gate = F.col("is_dir") & F.col("path").rlike("/projects/p[0-9]*[37]$")
    return I.live_subtree(inv.withColumn("is_reparse_point", gate | F.col("is_reparse_point")), "/src2").select("path", "is_dir")


@query
def any_records(spark: SparkSession, d: str) -> DataFrame:
    """Which sources have any record of some kind."""
    f = files(spark, d).select(F.split("path", "/")[1].alias("source"), "is_reparse_point")
    known = f.groupBy("source").agg(F.bool_or("is_reparse_point").alias("has_links"))
    return known.crossJoin(F.broadcast(I.has_any(f)))  # one row


@query
def immaterial_note(spark: SparkSession, d: str) -> DataFrame:
    """The line on sizes that aren't worth hashing, beside each extension that they are of."""
    inv = Q.inventory(spark, d)
    line = U.immaterial_line(U.immaterial(inv, Q.FLOOR), Q.FLOOR)
    return inv.filter(~F.col("is_dir")).groupBy("ext").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(line))  # one row at most


@query
def duplicate_members(spark: SparkSession, d: str) -> DataFrame:
    """The members of duplicate clusters in pages of three, the kept one first."""
    rows = U.member_rows(Q._kept(spark, d), 3)
    shown = F.array_join(F.transform("members", lambda m: F.concat(F.when(m["is_keep"], "+").otherwise("-"), m["path"])), ",")
    return rows.select("full_hash", "page", F.size("members").alias("n"), shown.alias("members"))


@query
def live_mode(spark: SparkSession, d: str) -> DataFrame:
    """The mode that each customer's log of changes ends in."""
    o = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderstatus") == "O", "power").otherwise("safe").alias("to_mode"))
    whole = Y.current_mode(o.select("seq", "to_mode"))
    return o.groupBy("o_custkey").agg(F.max_by("to_mode", "seq").alias("mode")).crossJoin(F.broadcast(whole.withColumnRenamed("mode", "of_all")))  # one row


@query
def burst_same_size(spark: SparkSession, d: str) -> DataFrame:
    """Bursts of images of equal width and height, near in time and in bits."""
    i = F.col("vec_id")
    shots = table(spark, d, "embeddings").select(i.alias("id"), (F.col("label") % 3 * 100 + 800).alias("width"), (i % 2 * 100 + 600).alias("height"), (i * 37 % 5000).alias("at"), Q._wide_hash().alias("hash"))
    return N.alike_bursts(shots, ["width", "height"], "at", "hash", 60.0, 14)

"""Append-only event logs: folds, retention, recovery, method choice, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators import rules as R
from siltstone.operators.places import running

KEY = ("batch_id", "original_path")


def fold_latest(events: DataFrame, phases: tuple[str, ...] | None = ("done",)) -> DataFrame:
    """The last event of each (batch_id, original_path) in log order, of the given phases only or of all (None).

    The maximum by sequence has partial results, so a key with very many events is no
    one task's work.
    """
    rows = events if phases is None else events.filter(F.col("phase").isin(*phases))
    rest = [c for c in rows.columns if c not in KEY]
    last = rows.groupBy(*KEY).agg(F.max(F.struct("seq", *(c for c in rest if c != "seq"))).alias("e"))
    return last.select(*KEY, *(F.col(f"e.{c}").alias(c) for c in rest))


def batches(events: DataFrame) -> DataFrame:
    """Per batch, from the last event of any phase: first time, items, bytes, restored items, methods; newest first."""
    last = fold_latest(events, None)
    return last.groupBy("batch_id").agg(
        F.min("at").alias("first_at"),
        F.count(F.lit(1)).alias("n_items"),
        F.sum("size_bytes").alias("bytes"),
        F.sum(F.col("restored").cast("long")).alias("n_restored"),
        F.bool_or(F.col("method") == "vault").alias("any_vault"),
        F.bool_or(F.col("method") == "direct_delete").alias("any_direct"),
    )


def purge_eligible(events: DataFrame, now: float, present: DataFrame) -> DataFrame:
    """Vault items to purge: their original path exists again (stale), or their retention is over."""
    last = fold_latest(events).filter((F.col("method") == "vault") & ~F.col("restored") & ~F.col("purged"))
    back = present.select(F.col("path").alias("original_path")).distinct().withColumn("stale", F.lit(True))
    rows = last.join(back, "original_path", "left").withColumn("stale", F.coalesce("stale", F.lit(False)))
    over = F.col("retention_until").isNotNull() & (F.col("retention_until") <= now)
    return rows.filter(F.col("stale") | over)


def purge_plan(eligible: DataFrame, blocked: DataFrame, mode: str = "power", rebuildable_only: bool = False) -> DataFrame:
    """The items of a purge run with its decision: refused as a whole in the safe mode or if any item is blocked."""
    rows = eligible.filter(F.col("rebuildable")) if rebuildable_only else eligible
    marked = rows.join(blocked.select(F.col("path").alias("original_path"), F.lit(True).alias("_b")).distinct(), "original_path", "left")
    veto = marked.agg(F.coalesce(F.bool_or(F.col("_b")), F.lit(False)).alias("_any"))
    out = marked.crossJoin(F.broadcast(veto))  # veto is one row
    decision = F.when(F.lit(mode == "safe"), "refused_safe_mode").when(F.col("_any"), "refused_blocked_item").otherwise("purge")
    return out.withColumn("decision", decision).drop("_b", "_any")


def method_plan(cands: DataFrame, mode: str = "power", size_guard: int = R.SIZE_GUARD, entry_guard: int = R.ENTRY_GUARD) -> DataFrame:
    """Method and retention of each item.

    Needs requested_method, retention_days, size_bytes, entry_count, size_guard_exempt and
    rebuildable. The safe mode recycles. Without a retention the item is deleted at once,
    unless it is too large (and not exempt) or has too many entries: then it goes to the
    vault, for no days if it can be rebuilt and 30 otherwise.
    """
    guarded = ((F.col("size_bytes") >= size_guard) & ~F.col("size_guard_exempt")) | (F.col("entry_count") >= entry_guard)
    direct = F.col("retention_days").isNull()
    method = F.when(F.lit(mode == "safe"), "recycle_bin").when(direct & guarded, "vault").when(direct, "direct_delete").otherwise(F.col("requested_method"))
    days = F.when(F.lit(mode == "safe"), F.lit(None).cast("int")).when(direct & guarded, F.when(F.col("rebuildable"), 0).otherwise(R.SIZE_GUARD_DAYS)).otherwise(F.col("retention_days"))
    return cands.withColumn("method", method).withColumn("effective_days", days.cast("int"))


def skip_reason(method: Column, in_use: Column, shared: Column, changed: Column, differs: Column) -> Column:
    """Why an item is skipped before it is touched; null for none."""
    return (
        F.when(in_use, "file_in_use")
        .when(shared & (method != "vault"), "hardlink_shared")
        .when(changed, "identity_changed")
        .when(differs & (method == "direct_delete"), "subtree_changed")
    )


def subtree_mismatch(recorded: DataFrame, live: DataFrame, roots: DataFrame) -> DataFrame:
    """Per root: the first path that a live subtree has beyond the record or with another identity; missing ones are fine.

    ``recorded`` and ``live`` have (root, path, dev, ino).
    """
    r = recorded.select("root", "path", F.col("dev").alias("rd"), F.col("ino").alias("ri"), F.lit(True).alias("known"))
    both = live.join(r, ["root", "path"], "left")
    why = F.when(F.col("known").isNull(), "extra_path").when((F.col("dev") != F.col("rd")) | (F.col("ino") != F.col("ri")), "identity_differs")
    found = both.withColumn("why", why).filter(F.col("why").isNotNull()).groupBy("root").agg(F.min(F.struct("path", "why")).alias("f"))
    return roots.join(found, "root", "left").select("root", F.col("f.path").alias("path"), F.col("f.why").alias("mismatch"))


def restore_plan(events: DataFrame, batch: Column | None, occupied: DataFrame, vault_dir: str) -> DataFrame:
    """Per item of a batch: already_restored, no_vault_path, outside_vault, destination_occupied or restore."""
    last = fold_latest(events)
    last = last if batch is None else last.filter(F.col("batch_id") == batch)
    there = occupied.select(F.col("path").alias("original_path"), F.lit(True).alias("_o")).distinct()
    rows = last.join(there, "original_path", "left")
    inside = (F.col("vault_path") == vault_dir) | F.col("vault_path").startswith(vault_dir + "/")
    step = F.when(F.col("restored"), "already_restored").when(F.col("vault_path").isNull(), "no_vault_path").when(~inside, "outside_vault").when(F.col("_o"), "destination_occupied").otherwise("restore")
    return rows.withColumn("step", step).drop("_o")


def orphan_intents(events: DataFrame) -> DataFrame:
    """Intents that no later phase resolves."""
    resolved = events.filter((F.col("phase") != "intent") & F.col("intent_id").isNotNull()).select("intent_id").distinct()
    return events.filter(F.col("phase") == "intent").join(resolved, "intent_id", "left_anti")


def recovery(orphans: DataFrame, present: DataFrame) -> DataFrame:
    """Orphans with the outcome that what is on disk shows.

    Apply moves the original path to the vault and restore moves it back; purge and
    direct deletes have no target. Source and no target: aborted; target and no source,
    or neither where there is none: completed; else review.
    """
    source = F.when(F.col("operation") == "apply", F.col("original_path")).otherwise(F.col("vault_path"))
    target = F.when((F.col("operation") == "apply") & (F.col("method") == "vault"), F.col("vault_path")).when(F.col("operation") == "restore", F.col("original_path"))
    p = present.select("path").distinct()
    rows = orphans.withColumn("source", source).withColumn("target", target)
    rows = rows.join(p.select(F.col("path").alias("source"), F.lit(True).alias("has_source")), "source", "left")
    rows = rows.join(p.select(F.col("path").alias("target"), F.lit(True).alias("has_target")), "target", "left")
    s, t = F.coalesce("has_source", F.lit(False)), F.coalesce("has_target", F.lit(False))
    outcome = F.when(F.col("target").isNull(), F.when(s, "aborted").otherwise("completed")).when(s & ~t, "aborted").when(~s & t, "completed").otherwise("needs_review")
    return rows.withColumn("outcome", outcome).drop("has_source", "has_target")


def resolving_events(recovered: DataFrame, now: float) -> DataFrame:
    """The events that close orphans: done with its flags, aborted, or needs_review."""
    done = F.col("outcome") == "completed"
    return recovered.select(
        "intent_id",
        *KEY,
        F.when(done, "done").otherwise(F.col("outcome")).alias("phase"),
        (done & (F.col("operation") == "restore")).alias("restored"),
        (done & (F.col("operation") == "purge")).alias("purged"),
        F.lit(now).alias("at"),
    )


def sibling_context(decisions: DataFrame) -> DataFrame:
    """Each decision with the accepted, rejected and kept ones before it in its cluster."""
    kinds = ("accepted", "rejected", "kept")
    out = running(decisions.select("cluster_id", "seq", "decision"), "cluster_id", ("seq",), {f"n_{d}_before": F.col("decision") == d for d in kinds})
    return out.select("cluster_id", "seq", "decision", *(f"n_{d}_before" for d in kinds))


def label_progress(labels: DataFrame, target: int) -> DataFrame:
    """Per stratum the clusters labelled, by their last label, and whether the target is met."""
    last = labels.groupBy("cluster_id").agg(F.max_by("stratum", "seq").alias("stratum"))
    return last.groupBy("stratum").agg(F.count(F.lit(1)).alias("n_labelled")).withColumn("target_met", F.col("n_labelled") >= target)


def alert_state(free: Column, threshold: Column, enabled: Column, now: Column, snoozed_until: Column, last_notified: Column, debounce_s: float) -> Column:
    """What a low-disk check does: disabled, failed, ok, snoozed, debounced or notify."""
    return (
        F.when(~enabled, "disabled")
        .when(free.isNull(), "failed")
        .when(free >= threshold, "ok")
        .when(snoozed_until.isNotNull() & (now < snoozed_until), "snoozed")
        .when(last_notified.isNotNull() & (now - last_notified < debounce_s), "debounced")
        .otherwise("notify")
    )


def batch_seconds(n: Column) -> Column:
    """How long writing n events takes, at the measured 8.088 ms each."""
    return n * 0.008088


def volume_change(events: DataFrame) -> DataFrame:
    """Totals of a batch report: processed, succeeded, failed, freed bytes of what succeeded."""
    ok = F.col("phase") == "done"
    return events.filter(F.col("phase") != "intent").groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n_processed"),
        F.sum(ok.cast("long")).alias("n_succeeded"),
        F.sum((~ok).cast("long")).alias("n_failed"),
        F.coalesce(F.sum(F.when(ok, F.col("size_bytes"))), F.lit(0)).alias("freed_bytes"),
    )


def category_breakdown(events: DataFrame) -> DataFrame:
    """Succeeded items by category."""
    return events.filter(F.col("phase") == "done").groupBy("category").agg(F.count(F.lit(1)).alias("n_items"), F.sum("size_bytes").alias("bytes"))

"""What applying batches of candidates would do, item by item, without touching a disk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators import eventlog as E
from siltstone.operators import review as V
from siltstone.operators import safety as S
from siltstone.operators.places import placed
from siltstone.sources.shared import written

#: Why whole batches are refused, the first that holds.
REFUSALS = ("unknown_method", "no_vault", "safe_mode_method", "blocked_item")


def planned(cands: DataFrame, vault_dir: str | None, mode: str = "power") -> DataFrame:
    """Items (batch_id, path, ...) with refusal, method, effective_days, skip_reason, outcome, vault_path and purged_at_once.

    Needs what method_plan() does, verdict, and in_use, is_shared, is_changed, subtree_differs.
    A batch is refused as a whole, before any of its items is looked at, if an item asks
    for anything but the vault or the recycle bin, if one goes to the vault and there is none, if the careful mode is on and an item asks for more
    than the recycle bin, or if an item is blocked by now. Else an item is skipped for its
    own reason, or applied. An item that would have been deleted at once, but was too
    large for that and goes to the vault for no days, is purged from there at once.
    """
    rows = E.method_plan(cands, mode)
    asked = F.col("requested_method")
    why = {
        "unknown_method": ~F.coalesce(asked.isin("vault", "recycle_bin"), F.lit(False)),
        "no_vault": (F.col("method") == "vault") & F.lit(vault_dir is None),
        "safe_mode_method": F.lit(mode == "safe") & (asked != "recycle_bin"),
        "blocked_item": F.col("verdict") == S.BLOCKED,
    }
    refused = rows.groupBy(F.col("batch_id").alias("_b")).agg(*(F.coalesce(F.bool_or(why[r]), F.lit(False)).alias(r) for r in REFUSALS))
    first = F.lit(None).cast("string")
    for r in reversed(REFUSALS):
        first = F.when(F.col(r), r).otherwise(first)
    out = rows.join(refused.select("_b", first.alias("refusal")), F.col("batch_id").eqNullSafe(F.col("_b"))).drop("_b")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    skip = E.skip_reason(F.col("method"), flag("in_use"), flag("is_shared"), flag("is_changed"), flag("subtree_differs"))
    out = out.withColumn("skip_reason", F.when(F.col("refusal").isNull(), skip))
    out = out.withColumn("outcome", F.when(F.col("refusal").isNotNull(), "refused").when(F.col("skip_reason").isNotNull(), "skipped").otherwise("applied"))
    goes = (F.col("outcome") == "applied") & (F.col("method") == "vault")
    name = V.vault_name(vault_dir or "", F.col("batch_id"), F.col("path"), F.lit(0))
    at_once = goes & F.col("retention_days").isNull() & (F.col("effective_days") == 0)
    return out.withColumn("vault_path", F.when(goes, name)).withColumn("purged_at_once", F.coalesce(at_once, F.lit(False)))


def events(plan: DataFrame, now: float) -> DataFrame:
    """The log of a plan (seq, batch_id, original_path, operation, phase, intent_id, method, vault_path, size_bytes, purged, at): an intent and what became of it for each applied item.

    All items of a batch come before its first purge, so that what went to the vault is
    on record before anything is taken out of it.
    """
    done = plan.filter("outcome = 'applied'")
    step = lambda operation, phase, stage, k: F.struct(F.lit(operation).alias("operation"), F.lit(phase).alias("phase"), F.lit(stage).alias("stage"), F.lit(k).alias("k"))
    apply_ = [step("apply", "intent", 0, 0), step("apply", "done", 0, 1)]
    purge = [step("purge", "intent", 1, 0), step("purge", "done", 1, 1)]
    each = done.withColumn("_e", F.explode(F.when(F.col("purged_at_once"), F.array(*apply_, *purge)).otherwise(F.array(*apply_))))
    rows = each.select(
        "batch_id", F.col("path").alias("original_path"), "_e.*", F.sha2(F.concat_ws("|", "batch_id", "path", "_e.operation"), 256).alias("intent_id"), "method", "vault_path", "size_bytes",
        ((F.col("_e.operation") == "purge") & (F.col("_e.phase") == "done")).alias("purged"),
    )
    out = placed(rows.withColumn("_all", F.lit(0)), "_all", ("batch_id", "stage", "original_path", "k"), "_n")
    return out.withColumn("seq", F.col("at")).withColumn("at", F.lit(now)).drop("_all", "_n", "stage", "k")


def report(plan: DataFrame) -> DataFrame:
    """Per batch: its refusal, items by outcome, bytes applied, and what was purged at once."""
    n = lambda c: F.sum(c.cast("long"))
    applied = F.col("outcome") == "applied"
    return plan.groupBy("batch_id").agg(
        F.max("refusal").alias("refusal"), F.count(F.lit(1)).alias("n_items"), n(applied).alias("n_applied"), n(F.col("outcome") == "skipped").alias("n_skipped"),
        F.coalesce(F.sum(F.when(applied, F.col("size_bytes"))), F.lit(0)).alias("bytes"), n(F.col("purged_at_once")).alias("n_purged"), F.coalesce(F.sum(F.when(F.col("purged_at_once"), F.col("size_bytes"))), F.lit(0)).alias("bytes_purged"),
    )


def applied(cands: DataFrame, vault_dir: str | None, now: float, mode: str = "power") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The plan, its log and its report."""
    plan = written(planned(cands, vault_dir, mode))
    return plan, events(plan, now), report(plan)

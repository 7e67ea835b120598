"""Roll-ups of candidates and inventories for reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import paths as P
from siltstone.operators import rules as R
from siltstone.operators.places import first_rows


def effective_bytes():
    """Freeable bytes where known, else the size."""
    return F.coalesce(F.col("freeable_bytes"), F.col("size_bytes"))


def cards(cands: DataFrame) -> DataFrame:
    """Count and bytes by category group and tier."""
    return cands.groupBy("category_group", "tier").agg(F.count(F.lit(1)).alias("n_items"), F.sum(effective_bytes()).alias("bytes"))


def summary(cands: DataFrame) -> DataFrame:
    """Totals of both tiers."""
    part = lambda t: F.coalesce(F.sum(F.when(F.col("tier") == t, effective_bytes())), F.lit(0))
    count = lambda t: F.coalesce(F.sum((F.col("tier") == t).cast("long")), F.lit(0))
    return cands.agg(count("A").alias("n_a"), part("A").alias("bytes_a"), count("B").alias("n_b"), part("B").alias("bytes_b"))


def one_click(cands: DataFrame) -> DataFrame:
    """The safe groups of tier A and, with a null group, their total."""
    safe = cands.filter(F.col("category_group").isin(*R.ONE_CLICK) & (F.col("tier") == "A"))
    return safe.rollup("category_group").agg(F.count(F.lit(1)).alias("n_items"), F.coalesce(F.sum(effective_bytes()), F.lit(0)).alias("bytes"))


def treemap(inv: DataFrame, cands: DataFrame, inaccessible_bytes: int, most: int = 60) -> DataFrame:
    """The largest directories of a level with their group, and a node of what can't be read after them."""
    total = inv.filter(~F.col("is_dir")).groupBy("parent").agg(F.sum("size").alias("bytes")).filter("bytes > 0")
    group = cands.groupBy("path").agg(F.min("category_group").alias("category_group"))
    rows = total.withColumnRenamed("parent", "path").join(group, "path", "left")
    top = rows.orderBy(F.desc("bytes"), "path").limit(most).select("path", "bytes", F.coalesce("category_group", F.lit("other")).alias("category_group"))
    extra = inv.sparkSession.range(1 if inaccessible_bytes > 0 else 0).select(F.lit("(inaccessible)").alias("path"), F.lit(inaccessible_bytes).cast("long").alias("bytes"), F.lit("inaccessible").alias("category_group"))
    return top.unionByName(extra)


def largest(cands: DataFrame, n: int = 10) -> DataFrame:
    """The n candidates of most bytes."""
    return cands.orderBy(F.desc(effective_bytes()), "path").limit(n)


def group_descriptor(cands: DataFrame) -> DataFrame:
    """Per group: count, bytes, tier label, and the retention where there is only one (no retention counts as one)."""
    distinct = F.size(F.collect_set(F.coalesce(F.col("retention_days"), F.lit(-1))))
    tier = F.when(F.min("tier") == F.max("tier"), F.min("tier")).otherwise("both")
    return cands.groupBy("category_group").agg(
        F.count(F.lit(1)).alias("n_items"), F.sum("size_bytes").alias("bytes"), tier.alias("tier"), F.when(distinct == 1, F.max("retention_days")).alias("retention_days")
    )


def selected(cands: DataFrame, tiers: tuple[str, ...], group: str) -> DataFrame:
    """Candidates of some tiers with a category or group of that name; unknown tiers are an error."""
    if set(tiers) - {"A", "B"}:
        raise ValueError(f"unknown tier in {tiers}")
    return cands.filter(F.col("tier").isin(*tiers) & ((F.col("category") == group) | (F.col("category_group") == group)))


def capped(rows: DataFrame, kind: str, order: str, cap: int) -> DataFrame:
    """The first ``cap`` rows of each kind, with how many there are over the cap."""
    n = rows.groupBy(F.col(kind).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    few = first_rows(rows, kind, (order,), cap, "_place").drop("_place").join(n, F.col(kind).eqNullSafe(F.col("_k")))
    return few.withColumn("n_over", F.greatest(F.col("_n") - cap, F.lit(0))).drop("_k", "_n")


def tail(rows: DataFrame, n: int) -> DataFrame:
    """The last n lines of a log (seq, ...), in order."""
    return rows.orderBy(F.desc("seq")).limit(n).orderBy("seq")


def by_depth(inv: DataFrame) -> DataFrame:
    """Files and bytes by depth and extension."""
    f = inv.filter(~F.col("is_dir"))
    return f.groupBy(P.depth_of(F.col("path")).alias("depth"), "ext").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("bytes"))

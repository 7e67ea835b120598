"""Evaluation metrics as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.places import first_rows


def f1(p: Column, r: Column) -> Column:
    """Harmonic mean; 0 where both are 0."""
    return F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))


def bcubed(items: DataFrame) -> DataFrame:
    """Mean precision, recall and F1 of (item, predicted, truth).

    An item's common set is counted by its (predicted, truth) cell, so each cell and not
    each pair of items is a row.
    """
    cell = items.groupBy("predicted", "truth").agg(F.count(F.lit(1)).alias("n"))
    cell = cell.join(items.groupBy("predicted").agg(F.count(F.lit(1)).alias("np")), "predicted").join(items.groupBy("truth").agg(F.count(F.lit(1)).alias("nt")), "truth")
    n = F.col("n")
    out = cell.agg((F.sum(n * n / F.col("np")) / F.sum(n)).alias("precision"), (F.sum(n * n / F.col("nt")) / F.sum(n)).alias("recall"))
    return out.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def pr_curve(scored: DataFrame, higher: bool = True) -> DataFrame:
    """A point per item of (id, score, positive): threshold, precision, recall when all up to it are taken.

    Ties are ordered by id and stay separate points. Ranks come from counts of ranges and
    from ranks within them, so no task sorts all items. Ranges are cut by score; a score
    that fills several of them is a range of its own, cut again by id.
    """
    s = F.col("score") if not higher else -F.col("score")
    rows = scored.withColumn("_s", s)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = [i / parts for i in range(1, parts)] or [0.5]
    cuts = sorted(rows.agg(F.percentile_approx("_s", share, 10_000)).first()[0] or [])
    cut = F.array(*map(F.lit, sorted(set(cuts)))) if cuts else F.array().cast("array<double>")
    at = 2 * F.size(F.filter(cut, lambda c: c < F.col("_s"))) + F.exists(cut, lambda c: c == F.col("_s")).cast("int")
    # the scores that fill ranges, fewer than there are partitions, with the cuts of their ids
    often = [c for c in set(cuts) if cuts.count(c) > 1]
    by_id = rows.filter(F.col("_s").isin(often)).groupBy(F.col("_s").alias("_h")).agg(F.percentile_approx("id", share, 10_000).alias("_ids"))
    rows = rows.join(F.broadcast(by_id), F.col("_s") == F.col("_h"), "left")
    rows = rows.withColumn("_b", F.struct(at.alias("s"), F.coalesce(F.size(F.filter("_ids", lambda c: c < F.col("id"))), F.lit(0)).alias("i"))).drop("_h", "_ids")
    # each range's totals, at most as many as the square of the partitions
    per = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("positive").cast("long")).alias("p"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("_b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("p").over(before), F.lit(0)).alias("p0"), F.sum("p").over(Window.partitionBy(F.lit(1))).alias("all_p"))
    inner = Window.partitionBy("_b").orderBy("_s", "id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(base, "_b")
    rank = F.col("n0") + F.row_number().over(Window.partitionBy("_b").orderBy("_s", "id"))
    hits = F.col("p0") + F.sum(F.col("positive").cast("long")).over(inner)
    return rows.select("id", "score", rank.alias("rank"), (hits / rank).alias("precision"), F.when(F.col("all_p") == 0, F.lit(0.0)).otherwise(hits / F.col("all_p")).alias("recall"))


def operating_point(curve: DataFrame, least_precision: float, least_recall: float | None = None) -> DataFrame:
    """The point of most recall with enough precision, the first on ties; no row without one or below the least recall."""
    best = curve.filter(F.col("precision") >= least_precision).agg(F.max_by(F.struct(*curve.columns), F.struct("recall", -F.col("rank"))).alias("p"))
    out = best.filter("p IS NOT NULL").select("p.*")
    return out if least_recall is None else out.filter(F.col("recall") >= least_recall)


def grid_counts(pairs: DataFrame, xs: list[float], ys: list[float]) -> DataFrame:
    """(x, y, precision, recall) for two thresholds over (s1, s2, positive); pairs pass if both scores do.

    Pairs are first counted by how many thresholds each score passes, so the grid meets
    counts and not pairs.
    """
    xs, ys = sorted(xs), sorted(ys)
    passed = lambda c, ts: F.size(F.filter(F.array(*map(F.lit, ts)), lambda t: t <= F.col(c)))
    cells = pairs.groupBy(passed("s1", xs).alias("i"), passed("s2", ys).alias("j")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("positive").cast("long")).alias("p"))
    spark = pairs.sparkSession
    gx = spark.createDataFrame([(k + 1, x) for k, x in enumerate(xs)], "gi int, x double")
    gy = spark.createDataFrame([(k + 1, y) for k, y in enumerate(ys)], "gj int, y double")
    grid = F.broadcast(gx.join(gy, F.lit(True)))  # as many rows as thresholds given
    hit = (F.col("i") >= F.col("gi")) & (F.col("j") >= F.col("gj"))
    sums = cells.join(grid, F.col("i") >= 0).groupBy("x", "y").agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n"), F.sum(F.when(hit, F.col("p")).otherwise(0)).alias("tp"), F.sum("p").alias("all_p"))
    return sums.select("x", "y", F.when(F.col("n") == 0, F.lit(1.0)).otherwise(F.col("tp") / F.col("n")).alias("precision"), F.when(F.col("all_p") == 0, F.lit(0.0)).otherwise(F.col("tp") / F.col("all_p")).alias("recall"))


def joint_point(grid: DataFrame, least_precision: float) -> DataFrame:
    """The grid point of most recall with enough precision; the least thresholds on ties."""
    ok = grid.filter(F.col("precision") >= least_precision)
    return ok.orderBy(F.desc("recall"), "x", "y").limit(1)


def tier_point(points: DataFrame, least_precision: float) -> DataFrame:
    """The threshold at which every tier of (threshold, tier, precision, recall) has enough precision and the worst recall is best."""
    g = points.groupBy("threshold").agg(F.bool_and(F.col("precision") >= least_precision).alias("ok"), F.min("recall").alias("worst_recall"))
    return g.filter("ok").orderBy(F.desc("worst_recall"), "threshold").limit(1).select("threshold", "worst_recall")


def exact_order(ranks: DataFrame) -> DataFrame:
    """Per group of (g, item, predicted, truth): whether both orders are the same."""
    return ranks.groupBy("g").agg(F.bool_and(F.col("predicted") == F.col("truth")).alias("exact"))


def kendall_tau(ranks: DataFrame, block: int = 8192) -> DataFrame:
    """Tau-a per group of (g, item, predicted, truth), whole-number ranks; 1 for a single item.

    No pairs are made. Two truths differ first at one bit, so a pair is counted at that
    bit, among the items whose higher bits agree: items in predicted order, how many of
    the other bit came before each. A group is cut into blocks of predicted ranks. Counts
    between blocks come from the blocks' totals, those within one from running sums.
    """
    base = ranks.groupBy("g", "predicted", "truth").agg(F.count(F.lit(1)).alias("n"))
    low, high = base.agg(F.min("truth"), F.max("truth")).first()
    levels = max(1, int(high - low).bit_length()) if low is not None else 1
    t = F.col("truth").cast("long") - F.lit(int(low or 0))
    bits = base.withColumn("t", t).withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    one = F.expr("shiftright(t, level) & 1")
    bits = bits.select("g", "level", F.expr("shiftright(t, level + 1)").alias("above"), F.floor(F.col("predicted") / block).alias("blk"), F.col("predicted").cast("long").alias("p"), (F.col("n") * one).alias("o"), (F.col("n") * (1 - one)).alias("z"))
    net = lambda w: F.col("o") * F.coalesce(F.sum("z").over(w), F.lit(0)) - F.col("z") * F.coalesce(F.sum("o").over(w), F.lit(0))
    inner = Window.partitionBy("g", "level", "above", "blk").orderBy("p").rangeBetween(Window.unboundedPreceding, -1)
    within = bits.select("g", net(inner).alias("c"))
    totals = bits.groupBy("g", "level", "above", "blk").agg(F.sum("o").alias("o"), F.sum("z").alias("z"))
    across = totals.select("g", net(Window.partitionBy("g", "level", "above").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)).alias("c"))
    sums = within.unionByName(across).groupBy("g").agg(F.sum("c").alias("c"))
    sizes = base.groupBy("g").agg(F.sum("n").cast("double").alias("n"))
    tau = F.col("c") / (F.col("n") * (F.col("n") - 1) / 2)
    return sizes.join(sums, "g").select("g", F.when(F.col("n") < 2, F.lit(1.0)).otherwise(tau).alias("tau"))


def cohens_kappa(rated: DataFrame) -> DataFrame:
    """Agreement of (a, b) beyond chance; 1 where chance alone agrees wholly."""
    c = rated.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    total = c.agg(F.sum("n").alias("t"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    ma = c.groupBy(F.col("a").alias("v")).agg(F.sum("n").alias("x"))
    mb = c.groupBy(F.col("b").alias("v")).agg(F.sum("n").alias("y"))
    chance = ma.join(mb, "v").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("xy"))
    out = total.join(chance, F.lit(True)).select((F.col("same") / F.col("t")).alias("po"), (F.col("xy") / (F.col("t") * F.col("t"))).alias("pe"))
    return out.select(F.when(F.col("pe") == 1, F.lit(1.0)).otherwise((F.col("po") - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"))


def fleiss_kappa(ratings: DataFrame) -> DataFrame:
    """Agreement of (item, category) ratings, equally many an item; 1 where chance alone agrees wholly."""
    c = ratings.groupBy("item", "category").agg(F.count(F.lit(1)).alias("n"))
    items = c.groupBy("item").agg(F.sum("n").alias("r"), F.sum(F.col("n") * (F.col("n") - 1)).alias("agree"))
    p = items.agg(F.avg(F.col("agree") / (F.col("r") * (F.col("r") - 1))).alias("p"), F.sum("r").alias("t"))
    cat = c.groupBy("category").agg(F.sum("n").alias("k"))
    pe = cat.join(p, F.lit(True)).agg(F.sum((F.col("k") / F.col("t")) * (F.col("k") / F.col("t"))).alias("pe"), F.max("p").alias("p"))
    return pe.select(F.when(F.col("pe") == 1, F.lit(1.0)).otherwise((F.col("p") - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"))


def ndcg(ranked: DataFrame, k: int) -> DataFrame:
    """NDCG at k per group of (g, item, position, relevance); 1 where the ideal is 0."""
    gain = F.sum((F.pow(F.lit(2.0), F.col("relevance")) - 1) / F.log2(F.col("at") + 1.0))
    shown = first_rows(ranked, "g", ("position", "item"), k, "at").groupBy(F.col("g").alias("_x")).agg(gain.alias("d"))
    ideal = first_rows(ranked, "g", (F.desc("relevance"), F.asc("item")), k, "at").groupBy("g").agg(gain.alias("i"))
    s = ideal.join(shown, F.col("g").eqNullSafe(F.col("_x")))
    return s.select("g", F.when(F.col("i") == 0, F.lit(1.0)).otherwise(F.col("d") / F.col("i")).alias("ndcg"))


def precision_at(ranked: DataFrame, k: int, floor: float) -> DataFrame:
    """The share of the first k (or all, if fewer) with at least that relevance, per group."""
    r = first_rows(ranked, "g", ("position", "item"), k, "at")
    return r.groupBy("g").agg(F.avg((F.col("relevance") >= floor).cast("double")).alias("precision_at_k"))


def grouped_split(rows: DataFrame, group: str, share: float = 0.75, ranges: int = 1000) -> DataFrame:
    """Rows with is_train: the first groups by number, at least one, train; no group is split.

    The last group that trains is found by counts of ranges, then within its range, so
    no task sorts all groups.
    """
    groups = rows.select(F.col(group).alias("g")).filter("g IS NOT NULL").distinct()
    cuts = groups.agg(F.percentile_approx("g", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] or []
    cut = F.array(*map(F.lit, sorted(set(cuts)))) if cuts else F.array().cast("array<bigint>")
    at = groups.withColumn("r", F.size(F.filter(cut, lambda c: c < F.col("g"))))
    sizes = dict(at.groupBy("r").count().collect())  # a number for each range
    left = max(1, int(sum(sizes.values()) * share))
    for r in sorted(sizes):
        if left <= sizes[r]:
            break
        left -= sizes[r]
    last = at.filter(F.col("r") == (r if sizes else 0)).orderBy("g").limit(left).agg(F.max("g")).first()[0]
    return rows.withColumn("is_train", F.coalesce(F.col(group) <= F.lit(last), F.lit(False)))

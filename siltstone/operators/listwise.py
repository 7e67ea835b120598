"""A ranker that learns orders: boosted trees on the gradients of a list's discounted gain.

A round weighs each pair of rows of one list (query group) by what swapping them would change in
NDCG@k, sums that up to a gradient and a second derivative for each row, and fits a
tree to their quotient with the second derivative as weight, whose leaves are Newton
steps. Pairs count only if one of them is among the first k of its list, so a row
meets at most k others, and a list of any size is spread over all tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.scalars import bucket_of
from siltstone.operators.places import placed
from siltstone.sources.shared import written

FEATURES = (
    "log_size", "age_days", "lived_days", "class_bucket", "category_bucket", "ext_bucket", "cluster_size", "keep", "raw_score", "cloud", "prior_accepted", "prior_rejected", "prior_kept",
)
#: The first places that count, boosting rounds and rate, depth of a tree, and what keeps leaves of little weight small.
K, ROUNDS, RATE, DEPTH, DAMPING = 5, 20, 0.2, 4, 1e-3
#: Salts of the first of two selections of a list's first rows.
SALTS = 32


def features(rows: DataFrame, now: float) -> DataFrame:
    """The thirteen features of (size, mtime, ctime, path_class, category, ext, cluster_size, is_keep, raw_score, is_cloud_placeholder, n_accepted, n_rejected, n_kept).

    Sizes below 0 count as 0, times after ``now`` as now; names become stable buckets, so
    a name never seen before has one too.
    """
    age = lambda c: F.greatest((F.lit(now) - F.col(c)) / 86400.0, F.lit(0.0))
    number = lambda c: F.col(c).cast("double")
    return rows.withColumns(
        {
            "log_size": F.log1p(F.greatest(number("size"), F.lit(0.0))),
            "age_days": age("mtime"),
            "lived_days": age("ctime"),
            "class_bucket": bucket_of(F.col("path_class")).cast("double"),
            "category_bucket": bucket_of(F.col("category")).cast("double"),
            "ext_bucket": bucket_of(F.col("ext")).cast("double"),
            "cluster_size": number("cluster_size"),
            "keep": F.col("is_keep").cast("double"),
            "raw_score": number("raw_score"),
            "cloud": F.col("is_cloud_placeholder").cast("double"),
            "prior_accepted": number("n_accepted"),
            "prior_rejected": number("n_rejected"),
            "prior_kept": number("n_kept"),
        }
    )


def gain(label: Column) -> Column:
    """What a relevance is worth."""
    return F.pow(F.lit(2.0), label) - 1


def discount(place: Column, k: int = K) -> Column:
    """The weight of a place from 1 on; nothing behind the k-th."""
    return F.when(place <= k, F.lit(1.0) / F.log2(place + 1)).otherwise(0.0)


def first_rows(scored: DataFrame, k: int = K) -> DataFrame:
    """(grp, tops): the k rows of greatest score of each list as structs (rank, id, label, score), the least ids first on ties."""
    order = (F.desc("score"), F.asc("id"))
    some = scored.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    some = some.withColumn("_r", F.row_number().over(Window.partitionBy("grp", "_salt").orderBy(*order))).filter(F.col("_r") <= k)
    few = some.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(*order))).filter(F.col("rank") <= k)  # at most k rows of each salt
    return few.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "label", "score"))).alias("tops"))


def ideal(scored: DataFrame, k: int = K) -> DataFrame:
    """(grp, ideal): the gain of the best order of each list, from the numbers of its labels."""
    n = scored.groupBy("grp", "label").agg(F.count(F.lit(1)).alias("n"))
    after = F.sum("n").over(Window.partitionBy("grp").orderBy(F.desc("label")))  # a row for each label
    rows = n.withColumn("_to", F.least(after, F.lit(k))).withColumn("_from", after - F.col("n") + 1)
    weight = F.aggregate(F.when(F.col("_from") <= F.col("_to"), F.sequence("_from", "_to")).otherwise(F.array().cast("array<long>")), F.lit(0.0), lambda a, p: a + discount(p, k))
    return rows.groupBy("grp").agg(F.sum(gain(F.col("label")) * weight).alias("ideal"))


def gradients(scored: DataFrame, k: int = K) -> DataFrame:
    """(grp, id, g, h) of rows (grp, id, label, score): which way and how strongly NDCG@k moves each row's score."""
    lists = first_rows(scored, k).join(ideal(scored, k), "grp").filter("ideal > 0")
    lists = lists.select(F.concat("grp", F.lit("")).alias("grp"), "tops", "ideal")  # a shuffle of its own, in which a large list is split
    rows = scored.join(lists, "grp")
    own = F.aggregate("tops", F.lit(k + 1), lambda a, t: F.when(t["id"] == F.col("id"), t["rank"]).otherwise(a))
    rows = rows.withColumn("_rank", own)

    def pull(t: Column) -> Column:
        """What a pair moves this row by, up or down, and its second derivative; nothing for equal labels and the row itself."""
        change = F.abs(gain(F.col("label")) - gain(t["label"])) * F.abs(discount(F.col("_rank"), k) - discount(t["rank"], k)) / F.col("ideal")
        sign = F.signum((F.col("label") - t["label"]).cast("double"))
        rho = 1 / (1 + F.exp(sign * (F.col("score") - t["score"])))
        return F.struct((sign * change * rho).alias("g"), F.when(sign != 0, change * rho * (1 - rho)).otherwise(0.0).alias("h"))

    rows = rows.withColumn("_p", F.transform("tops", pull))
    total = lambda c: F.aggregate("_p", F.lit(0.0), lambda a, p: a + p[c])
    mine = rows.select("grp", "id", total("g").alias("g"), total("h").alias("h"))
    # rows behind the k-th move the first ones the other way; each list adds up k sums of them
    behind = rows.filter(F.col("_rank") > k)
    sums = behind.groupBy("grp").agg(*(F.sum(F.coalesce(F.get("_p", F.lit(i))[c], F.lit(0.0))).alias(f"{c}{i}") for i in range(k) for c in "gh"))
    back = F.array(*(F.struct((-F.col(f"g{i}")).alias("g"), F.col(f"h{i}").alias("h")) for i in range(k)))
    theirs = sums.join(lists, "grp").select("grp", F.explode(F.arrays_zip(F.col("tops").alias("tops"), back.alias("back"))).alias("z")).filter("z.tops IS NOT NULL")
    theirs = theirs.select("grp", F.col("z.tops.id").alias("id"), F.col("z.back.g").alias("g"), F.col("z.back.h").alias("h"))
    return mine.unionByName(theirs).groupBy("grp", "id").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))


@dataclass(frozen=True)
class Ranker:
    """The trees of all rounds, the weight of each, and the features that they look at."""

    trees: list[DecisionTreeRegressionModel]
    rate: float
    names: tuple[str, ...]

    def scored(self, rows: DataFrame) -> DataFrame:
        """The rows with ``score``; null where a feature is missing."""
        out = VectorAssembler(inputCols=list(self.names), outputCol="_x", handleInvalid="keep").transform(rows)
        parts = []
        for i, tree in enumerate(self.trees):
            out = tree.setPredictionCol(f"_p{i}").transform(out)
            parts.append(F.col(f"_p{i}"))
        total = sum(parts[1:], parts[0]) * self.rate if parts else F.lit(0.0)
        known = F.lit(True)
        for c in self.names:
            known = known & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
        return out.withColumn("score", F.when(known, total)).select(*rows.columns, "score")

    def ranked(self, rows: DataFrame) -> DataFrame:
        """Rows (grp, id, ...) with score and ``place`` in their list from 1 on; rows without a score last, ties by id."""
        out = placed(written(self.scored(rows)), "grp", (F.desc_nulls_last("score"), "id"), "_n")
        return out.withColumn("place", F.col("at") + 1).drop("at", "_n")


def fitted(rows: DataFrame, names: tuple[str, ...] = FEATURES, rounds: int = ROUNDS, rate: float = RATE, depth: int = DEPTH, k: int = K, seed: int = 7) -> Ranker:
    """A ranker fitted to rows (grp string, id, label, features): lists with their relevances, whole numbers from 0.

    Scores are written each round, which cuts the plan. Lists of one label teach nothing.
    """
    data = VectorAssembler(inputCols=list(names), outputCol="_x", handleInvalid="skip").transform(rows).select("grp", "id", "label", "_x")
    data = written(data.withColumn("score", F.lit(0.0)))
    trees = []
    for i in range(rounds):
        moves = gradients(data.select("grp", "id", "label", "score"), k).filter("h > 0")
        moves = moves.select("grp", (F.col("id") + F.lit(0)).alias("id"), (F.col("g") / (F.col("h") + DAMPING)).alias("_y"), (F.col("h") + DAMPING).alias("_w"))
        taught = written(data.join(moves.hint("merge"), ["grp", "id"]).select("_x", "_y", "_w"))
        if taught.isEmpty():
            break
        tree = DecisionTreeRegressor(featuresCol="_x", labelCol="_y", weightCol="_w", maxDepth=depth, maxBins=256, minInstancesPerNode=3, seed=seed + i).fit(taught)
        trees.append(tree)
        data = written(tree.setPredictionCol("_step").transform(data).withColumn("score", F.col("score") + rate * F.col("_step")).drop("_step"))
    return Ranker(trees, rate, tuple(names))


def ndcg(ranked: DataFrame, k: int = K) -> DataFrame:
    """(grp, ndcg) of rows (grp, id, label, place); lists without any relevance are left out."""
    got = ranked.filter(F.col("place") <= k).groupBy("grp").agg(F.sum(gain(F.col("label")) * discount(F.col("place"), k)).alias("dcg"))
    return ideal(ranked, k).filter("ideal > 0").join(got, "grp").select("grp", (F.col("dcg") / F.col("ideal")).alias("ndcg"))

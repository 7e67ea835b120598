"""Ranking of review candidates: features, a learned score, and an order without one."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.scalars import bucket_of
from siltstone.operators.places import placed

FEATURES = ("log_size", "age_days", "lived_days", "ext_bucket", "class_bucket", "cluster_size", "position", "raw_score", "is_keep")


def features(rows: DataFrame, now: float) -> DataFrame:
    """Numeric features of (id, size, mtime, ctime, ext, path_class, cluster_size, position, raw_score, is_keep)."""
    age = lambda c: F.greatest((F.lit(now) - F.col(c)) / 86400.0, F.lit(0.0))
    return rows.withColumns(
        {
            "log_size": F.log1p(F.col("size").cast("double")),
            "age_days": age("mtime"),
            "lived_days": age("ctime"),
            "ext_bucket": bucket_of(F.col("ext")),
            "class_bucket": bucket_of(F.col("path_class")),
            "is_keep": F.col("is_keep").cast("double"),
        }
    )


def fitted(rows: DataFrame, label: str, seed: int = 7):
    """A boosted-tree model of a relevance label over the features."""
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    return GBTRegressor(featuresCol="features", labelCol=label, maxIter=12, maxDepth=4, seed=seed, maxBins=256).fit(data)


def ranked(model, rows: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows with score, the best first in ``place``; rows without a score come last, ties go by id."""
    data = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="keep").transform(rows))
    score = F.when(F.isnan("prediction"), F.lit(None)).otherwise(F.col("prediction"))
    return data.select(*rows.columns, score.alias("score")).orderBy(F.desc_nulls_last("score"), id_col)


def fallback_order(clusters: DataFrame) -> DataFrame:
    """(cluster_id, place): deletion suggestions first, then by bytes, then by index, per batch; ranges of a batch are numbered."""
    out = placed(clusters, "batch_id", (F.desc("suggests_deletion"), F.desc("bytes"), F.asc("cluster_id")), "_n")
    return out.withColumn("place", (F.col("at") + 1).cast("int")).drop("at", "_n")

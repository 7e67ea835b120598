"""Gradients against all pairs, and lists ranked better than row by row."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import listwise as W
from siltstone.operators import ranking as K


def brute(rows, k):
    out = {}
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[3], r[1]))
        gain = lambda r: 2.0 ** r[2] - 1
        disc = [1 / math.log2(i + 2) if i < k else 0.0 for i in range(len(own))]
        best = sum(x * d for x, d in zip(sorted(map(gain, own), reverse=True), disc, strict=True))
        if best == 0:
            continue
        for r in own:
            out[g, r[1]] = [0.0, 0.0]
        for i, a in enumerate(own):
            for j in range(i + 1, len(own)):
                b = own[j]
                if i >= k or a[2] == b[2]:
                    continue
                change = abs(gain(a) - gain(b)) * abs(disc[i] - disc[j]) / best
                hi, lo = (a, b) if a[2] > b[2] else (b, a)
                rho = 1 / (1 + math.exp(hi[3] - lo[3]))
                for r, s in ((hi, 1), (lo, -1)):
                    out[g, r[1]][0] += s * change * rho
                    out[g, r[1]][1] += change * rho * (1 - rho)
    return out


@pytest.mark.parametrize("k", [1, 3, 5])
def test_gradients(spark, k):
    rng = random.Random(k)
    rows = [(f"g{i % 3}", i, rng.randrange(4), round(rng.random(), 3)) for i in range(60)] + [("one", 100, 2, 0.1), ("same", 101, 0, 0.5), ("same", 102, 0, 0.4), ("few", 103, 0, 0.4), ("few", 104, 1, 0.4)]
    df = spark.createDataFrame(rows, "grp string, id long, label int, score double")
    got = {(r["grp"], r["id"]): (r["g"], r["h"]) for r in W.gradients(df, k).collect()}
    want = brute(rows, k)
    assert set(got) == set(want)
    for key, (g, h) in want.items():
        assert np.allclose(got[key], (g, h), atol=1e-12)


def test_held_out_lists(spark):
    """Lists whose relevance shows only against the rest of the list: better than the pointwise model, and well above a floor."""
    rng = np.random.default_rng(11)
    rows = []
    for g in range(60):
        level = rng.normal() * 4  # differs by list, so a row's relevance can't be read off it alone
        quality = rng.normal(size=25)
        cut = np.sort(quality)[[-8, -4, -2]]
        for i in range(25):
            label = int((quality[i] >= cut).sum())
            rows.append((f"g{g:02}", g * 100 + i, label, float(quality[i] + 0.35 * rng.normal()), float(level + label + rng.normal()), float(rng.random())))
    df = spark.createDataFrame(rows, "grp string, id long, label int, a double, b double, c double").cache()
    train, test = df.filter("grp < 'g40'"), df.filter("grp >= 'g40'")
    model = W.fitted(train, ("a", "b", "c"), rounds=12)
    listwise = W.ndcg(model.ranked(test)).agg(F.avg("ndcg")).first()[0]
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    put = VectorAssembler(inputCols=["a", "b", "c"], outputCol="x")
    point = GBTRegressor(featuresCol="x", labelCol="label", maxIter=12, maxDepth=4, seed=7, maxBins=256).fit(put.transform(train))
    from siltstone.operators.places import placed

    order = placed(point.transform(put.transform(test)), "grp", (F.desc("prediction"), "id"), "n").withColumn("place", F.col("at") + 1)
    pointwise = W.ndcg(order).agg(F.avg("ndcg")).first()[0]
    assert listwise > 0.85 and listwise > pointwise, (listwise, pointwise)


def test_features(spark):
    rows = [(-5, 10.0, 2e9, "a", "b", ".x", 2, True, 0.5, False, 1, 2, 3)]
    df = spark.createDataFrame(rows, "size long, mtime double, ctime double, path_class string, category string, ext string, cluster_size long, is_keep boolean, raw_score double, is_cloud_placeholder boolean, n_accepted long, n_rejected long, n_kept long")
    r = W.features(df, 86410.0).first()
    assert (r["log_size"], r["age_days"], r["lived_days"], r["keep"], r["cloud"], r["prior_kept"]) == (0.0, 1.0, 0.0, 1.0, 0.0, 3.0)
    assert len(W.FEATURES) == 13 and set(W.FEATURES) <= set(r.asDict()) and K.FEATURES


def test_query_on_held_out_lists(spark):
    from siltstone.plans import catalogue

    out = catalogue.QUERIES["ranked_listwise"](spark, "/root/testdata/sf0.01")
    held = out.filter("cast(substring(grp, 5) as int) >= 10")
    assert W.ndcg(held).agg(F.avg("ndcg")).first()[0] > 0.9

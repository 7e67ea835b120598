"""The best pair of thresholds against all pairs."""

import random

import pytest

from siltstone.operators import joint as J


def brute(rows, p, r):
    tiers = {t: [x for x in rows if x[0] == t] for t in {x[0] for x in rows}}
    best = None
    known = [x for x in rows if x[1] is not None and x[2] is not None]
    for x in sorted({k[1] for k in known}):
        for y in sorted({k[2] for k in known}):
            recalls = []
            for own in tiers.values():
                passed = [k for k in own if k[1] is not None and k[2] is not None and k[1] >= x and k[2] >= y]
                good, every = sum(k[3] for k in passed), sum(k[3] for k in own)
                recall = good / every if every else 0.0
                if not passed or good / len(passed) < p or recall < r:
                    break
                recalls.append(recall)
            else:
                if best is None or min(recalls) > best[2]:
                    best = (x, y, min(recalls))
    return best


def rows_of(seed, n, values, tiers):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        a, b = rng.random(), rng.random()
        out.append((f"t{rng.randrange(tiers)}", round(a * values), round(b * values), rng.random() < (a + b) / 2))
    return out


@pytest.mark.parametrize(("seed", "n", "values", "tiers", "p", "r", "lines"), [(1, 300, 40, 1, 0.8, 0.0, 4), (2, 300, 1000, 1, 0.75, 0.1, 8), (3, 400, 60, 3, 0.7, 0.0, 64), (4, 200, 30, 2, 0.9, 0.05, 3), (5, 80, 3, 1, 0.99, 0.9, 4), (6, 250, 10**6, 2, 0.0, 0.0, 2)])
def test_all_thresholds(spark, seed, n, values, tiers, p, r, lines):
    rows = rows_of(seed, n, values, tiers)
    df = spark.createDataFrame([(t, float(a), float(b), c) for t, a, b, c in rows], "tier string, s1 double, s2 double, positive boolean").repartition(3)
    got = [tuple(x) for x in J.joint_best(df, p, r, "tier", lines).collect()]
    want = brute(rows, p, r)
    assert got == ([] if want is None else [want])


def test_odd_rows(spark):
    schema = "s1 double, s2 double, positive boolean"
    assert J.joint_best(spark.createDataFrame([], schema), 0.5).count() == 0
    assert J.joint_best(spark.createDataFrame([(None, 1.0, True)], schema), 0.5).count() == 0
    df = spark.createDataFrame([(1.0, 1.0, True), (1.0, 1.0, True), (None, 2.0, True), (0.5, 1.0, None), (2.0, 0.1, False)], schema)
    assert [tuple(r) for r in J.joint_best(df, 1.0).collect()] == [(1.0, 1.0, 2 / 3)]

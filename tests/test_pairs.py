"""Stratified pairs: full strata, rare ones, exclusions."""

import random

import pytest

from siltstone.operators import pairs as R


def all_pairs(items):
    out = {}
    for i, (a, h, c) in enumerate(items):
        for b, g, e in items[i + 1 :]:
            d = ((h ^ g) & (2**64 - 1)).bit_count()
            if d > 10 and (c is None or e is None or c != e):
                out[min(a, b), max(a, b)] = d
    return out


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def checked(got, items, each):
    every = all_pairs(items)
    strata = {}
    for r in got.collect():
        assert every[r["a"], r["b"]] == r["distance"] and (r["stratum"] == "boundary") == (r["distance"] <= 25)
        strata.setdefault(r["stratum"], set()).add((r["a"], r["b"]))
        strata.setdefault(r["stratum"] + " draws", set()).add(r["draw"])
    for s, test in (("boundary", lambda d: d <= 25), ("negative_control", lambda d: d > 25)):
        want = min(each, sum(map(test, every.values())))
        assert len(strata.get(s, ())) == want == len(strata.get(s + " draws", ()))
    return strata


@pytest.mark.parametrize(("n", "each", "block", "first"), [(60, 20, 2048, 20_000), (150, 60, 32, 64), (150, 5, 32, 64)])
def test_strata(spark, n, each, block, first):
    rng = random.Random(n)
    items = [(i * 2, signed(rng.getrandbits(64)), i // 20 if i % 3 else None) for i in range(n)]
    items += [(1001, items[0][1], None), (1003, signed((items[0][1] ^ 0xFFFFF) & (2**64 - 1)), None)]  # a boundary pair
    df = spark.createDataFrame([*items, (5000, None, None)], "id long, h long, cluster long")
    one = checked(R.stratified_pairs(df, each, first=first, most=4 * first, block=block), items, each)
    two = checked(R.stratified_pairs(df.repartition(5), each, first=first, most=4 * first, block=block), items, each)
    assert one == two


def test_a_rare_stratum_is_filled(spark):
    """Three boundary pairs among very many others, which few draws don't meet."""
    rng = random.Random(4)
    items = [(i, signed(0x00000000FFFFFFFF if i % 2 else 0xFFFFFFFF00000000), i % 2) for i in range(200)]
    items += [(300 + k, signed(rng.getrandbits(64)), None) for k in range(2)]
    items += [(400, signed(items[0][1] ^ 0xFFFFF), 0), (401, signed(items[0][1] ^ 0xFFFFF), None)]
    got = R.stratified_pairs(spark.createDataFrame(items, "id long, h long, cluster long"), 50, first=16, most=16, block=64)
    checked(got, items, 50)
    assert R.stratified_pairs(spark.createDataFrame(items[:1], "id long, h long, cluster long")).count() == 0


def test_candidates(spark):
    rng = random.Random(9)
    items = [(i, signed(rng.getrandbits(64))) for i in range(80)]
    items += [(100 + i, items[i][1] ^ 7) for i in range(5)]
    out = R.label_candidates(spark.createDataFrame(items, "id long, h long"), each=10).collect()
    near = {}
    for r in out:
        if r["stratum"] == "near_duplicate":
            near.setdefault(r["candidate"], set()).add(r["id"])
    assert {frozenset((i, 100 + i)) for i in range(5)} <= set(map(frozenset, near.values()))
    pairs = {}
    for r in out:
        if r["stratum"] != "near_duplicate":
            pairs.setdefault(r["candidate"], set()).add(r["id"])
    assert len(pairs) == 20 and all(len(p) == 2 and not any(p <= c for c in near.values()) for p in pairs.values())

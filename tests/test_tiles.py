"""Tiles: hashes and vectors that meet in blocks, against brute force, and what reaches the driver."""

import random

import numpy as np
import pytest

from siltstone.operators import similarity as N
from siltstone.operators import tiles as TL
from siltstone.plans import catalogue


def hashes(seed, n=120):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(10)]
    out = []
    for i in range(n):
        h = base[i % 10]
        for bit in rng.sample(range(64), rng.randrange(0, 10)):
            h ^= 1 << bit
        out.append(h - (1 << 64) if h >> 63 else h)
    return [*out, *out[:5]]


def far(a, b):
    return ((a ^ b) & (2**64 - 1)).bit_count()


def components(n, edges):
    label = list(range(n))
    while True:
        new = list(label)
        for a, b in edges:
            new[a] = new[b] = min(new[a], new[b])
        if new == label:
            return label
        label = new


def plan(df):
    df.count()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("block", "cells"), [(TL.BLOCK, TL.CELLS), (30, TL.CELLS), (30, 50)])
def test_hamming_in_tiles(spark, monkeypatch, block, cells):
    h = hashes(block + cells)
    monkeypatch.setattr(TL, "CELLS", cells)
    df = spark.createDataFrame([*enumerate(h), (500, None)], "id long, hash long")
    first = {x: h.index(x) for x in h}
    want = {(a, b, far(h[a], h[b])) for a in first.values() for b in first.values() if a < b and far(h[a], h[b]) <= 9} | {(first[x], i, 0) for i, x in enumerate(h) if first[x] != i}
    got = [tuple(r) for r in N.hamming_pairs(df, 9, block=block).collect()]
    assert set(got) == want and len(got) == len(want)
    links = [tuple(r) for r in N.hamming_links(df, 9, block=block).collect()]
    assert {(a, b) for a, b in links if far(h[a], h[b]) <= 9} <= {(a, b) for a, b, _ in want}
    assert components(len(h), links) == components(len(h), [(a, b) for a, b, _ in want])


def test_hamming_sends_no_hashes_to_the_driver(spark):
    df = spark.createDataFrame(list(enumerate(hashes(1))), "id long, hash long")
    assert "Broadcast" not in plan(N.hamming_pairs(df, 14)) and "Broadcast" not in plan(N.hamming_pairs(df, 4, chunks=2))
    assert "Broadcast" not in plan(N.hamming_links(df, 14))


@pytest.mark.parametrize("name", ["image_keep_best", "residual_images", "label_candidates"])
def test_queries_of_links_list_no_pairs(spark, monkeypatch, name):
    monkeypatch.setattr(N, "hamming_pairs", None)
    out = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
    if name == "residual_images":
        assert "Broadcast" not in plan(out)
    assert out.count() > 0


@pytest.mark.parametrize(("block", "least"), [(TL.BLOCK, 0.35), (25, 0.35), (25, -2.0)])
def test_knn_in_tiles(spark, monkeypatch, block, least):
    rng = np.random.default_rng(block)
    m = np.concatenate([rng.normal(size=(80, 6)), rng.normal(size=(4, 6)).repeat(5, axis=0)])
    monkeypatch.setattr(TL, "CELLS", 200)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = u @ u.T
    df = spark.createDataFrame([*((i, [float(x) for x in v]) for i, v in enumerate(m)), (900, None)], "vec_id long, embedding array<double>")
    got = {}
    out = N.knn(df, 3, least, block_rows=block)
    for r in out.collect():
        got.setdefault(r["a"], []).append((-round(r["cosine"], 6), r["b"]))
    for i in range(len(m)):
        want = sorted((-round(s[i, j], 6), j) for j in range(len(m)) if j != i and s[i, j] >= least)[:3]
        assert sorted(got.get(i, [])) == want
    assert "Broadcast" not in plan(out)


def test_bursts_send_no_classes_to_the_driver(spark):
    h = hashes(2)
    shots = spark.createDataFrame([(i, i % 2, float(i * 7 % 90), x) for i, x in enumerate(h)], "id long, g int, at double, hash long")
    assert "Broadcast" not in plan(N.alike_bursts(shots, ["g"], "at", "hash", 10.0, 9))

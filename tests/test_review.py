"""Review operators on small cases, and block steps against whole groups."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import review as V
from siltstone.operators import similarity as N


def grouped(spark, n=60, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(int(i), int(i % 4), [float(x) for x in rng.normal(size=5) + 3 * (i % 4 == 0)]) for i in range(n)]
    rows += [(1000, 77, [1.0, 0.0, 0.0, 0.0, 0.0])]
    return rows, spark.createDataFrame(rows, "id long, grp long, v array<double>")


@pytest.mark.parametrize("block", [2, 7, 4096])
def test_extremes_and_edges(spark, block):
    rows, df = grouped(spark)
    unit = {i: np.array(v) / np.linalg.norm(v) for i, _, v in rows}
    ids = {g: [i for i, h, _ in rows if h == g] for g in {r[1] for r in rows}}
    worst = {g: min(float(unit[a] @ unit[b]) for a in m for b in m) for g, m in ids.items() if len(m) > 1}
    got = {r["grp"]: -r["extreme"] for r in V.extremes(df, V.least_cosine, block).collect()}
    assert got == pytest.approx(worst)
    links = V.near_edges(df, 0.8, block)
    near = {(a, b) for m in ids.values() for a in m for b in m if a < b and unit[a] @ unit[b] >= 0.8}
    made = {(min(r["a"], r["b"]), max(r["a"], r["b"])) for r in links.collect()}
    component = {r["id"]: r["component"] for r in N.components(links).collect()}
    up = {i: i for i in unit}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in near:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    assert component == {i: find(i) for i in unit if any(i in p for p in near)}
    assert made and len(near) > 10


def test_bits():
    a = np.array([[0], [-1], [5]])
    assert V.widest_bits(a, a) == 64 and V.widest_bits(a[:1], a[2:]) == 2


def test_burst_review(spark):
    rows = [(1, 1, "transient_ui", 2.0, 0), (1, 2, "transient_ui", 2.0, 7), (1, 3, "transient_ui", None, 1), (2, 4, "transient_ui", 1.0, 0), (2, 5, "transient_ui", None, 0), (3, 6, "receipt", 1.0, 0), (3, 7, "transient_ui", 2.0, 3), (4, 8, None, 1.0, 0), (4, 9, "transient_ui", 1.0, 0)]
    out = V.burst_review(spark.createDataFrame(rows, "burst long, id long, tag string, quality double, hash long")).collect()
    assert {r["burst"]: (r["verdict"], r["widest"]) for r in out} == {1: ("keeper", 3.0), 2: ("too_few_scored", 0.0), 3: ("meaningful_content", 2.0), 4: ("meaningful_content", 0.0)}
    assert [r["id"] for r in out if r["is_keep"]] == [1] and len(out) == len(rows)


def test_tracks_are_apart(spark):
    def broken():
        raise ValueError("no such thing")

    good = lambda: spark.createDataFrame([(1, 2), (1, 3)], "cluster long, id long")
    late = lambda: good().withColumn("id", F.raise_error(F.lit("late")).cast("long"))
    rows, states = V.run_tracks(spark, {"a": broken, "b": good, "c": late})
    assert {(r["track"], r["state"], r["n_rows"]) for r in states.collect()} == {("a", "skipped", 0), ("b", "run", 2), ("c", "skipped", 0)}
    assert {(r["track"], r["id"]) for r in rows.collect()} == {("b", 2), ("b", 3)}
    rows, states = V.run_tracks(spark, {"a": broken})
    assert rows.count() == 0 and "no such thing" in states.first()["reason"]


def test_two_stages(spark):
    """Documents alike in words split where their vectors aren't, and the other way round."""
    words = [f"w{i}" for i in range(40)]
    docs = [(1, " ".join(words)), (2, " ".join(words[:36])), (3, " ".join(words[4:])), (4, "quite another text with other words in it"), (5, " ".join(words)), (6, None)]
    vectors = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0]), (4, [1.0, 0.0]), (5, [0.1, 1.0]), (6, [1.0, 0.0])]
    sets = N.shingle_sets(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text")
    out = V.two_stage_clusters(sets, spark.createDataFrame(vectors, "id long, v array<double>"), 0.1, 0.95).collect()
    assert {r["id"]: r["cluster"] for r in out} == {1: 1, 2: 1, 3: 3, 5: 3}
    assert all(r["raw_score"] == pytest.approx(1 / np.sqrt(1.01)) for r in out)


def test_sampled_pairs(spark):
    rng = random.Random(0)
    hashes = [(i * 3, rng.getrandbits(63)) for i in range(80)] + [(600, 0), (603, 3)]
    items = spark.createDataFrame(hashes, "id long, h long")
    bits = lambda a, b: F.bit_count(a.bitwiseXOR(b))
    known = dict(hashes)
    out = V.sampled_pairs(items, bits, draws=30_000, each=25).collect()
    assert len({(r["a"], r["b"]) for r in out}) == len(out)
    for r in out:
        d = (known[r["a"]] ^ known[r["b"]]).bit_count()
        assert r["distance"] == d and r["stratum"] == ("boundary" if d <= 25 else "negative_control") and d > 10
    assert {r["stratum"] for r in out} == {"boundary", "negative_control"} and sum(r["stratum"] == "negative_control" for r in out) == 25
    assert out == V.sampled_pairs(items.repartition(5), bits, draws=30_000, each=25).collect() or sorted(out) == sorted(V.sampled_pairs(items, bits, draws=30_000, each=25).collect())
    assert V.sampled_pairs(items.limit(0), bits, draws=10).count() == 0


def test_image_features(spark):
    rng = np.random.default_rng(1)
    a = rng.random((9, 10))
    rows = [(1, a.reshape(-1).tolist()), (2, (a + 0.001 * rng.random((9, 10))).reshape(-1).tolist()), (3, rng.random(90).tolist()), (4, None), (5, [1.0])]
    out = {r["id"]: r for r in V.image_features(spark.createDataFrame(rows, "id long, pixels array<double>"), "pixels", 10, 9).collect()}
    assert out[4]["phash"] is None and out[5]["dhash"] is None
    far = lambda x, y, c: sum(p != q for p, q in zip(out[x][c], out[y][c], strict=True))
    assert far(1, 2, "phash") <= 4 < 14 < far(1, 3, "phash") and far(1, 2, "dhash") <= 6
    assert len(out[1]["phash"]) == 64 and len(out[1]["dhash"]) == 81 and out[1]["spread"] == pytest.approx(a.std())
    wave = [[sum(a[y, x] * np.cos(np.pi * u * (2 * y + 1) / 18) * np.cos(np.pi * v * (2 * x + 1) / 20) for y in range(9) for x in range(10)) for v in range(8)] for u in range(8)]
    assert out[1]["phash"] == "".join("1" if w > np.median(wave) else "0" for row in wave for w in row)


def test_paths(spark):
    df = spark.createDataFrame([("\\\\?\\C:\\a",), ("\\\\?\\UNC\\s\\a",), ("C:\\a",)], "p string")
    assert [r["x"] for r in df.select(V.without_long_prefix(F.col("p")).alias("x")).collect()] == ["C:\\a", "\\\\?\\UNC\\s\\a", "C:\\a"]
    roots = spark.createDataFrame([("/c/hub/models--a--b/blobs/x",), ("/c/hub/models--a/snapshots",), ("/c/models--a/x",)], "p string")
    assert [r["x"] for r in roots.select(V.cache_object_root(F.col("p")).alias("x")).collect()] == ["/c/hub/models--a--b", "/c/hub/models--a", None]

"""Operators that are cut into blocks and ranges, against brute force; queries without SQL against small checks."""

import math
import random
import re
from collections import Counter, defaultdict
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import detectors as D
from siltstone.operators import metrics as M
from siltstone.operators import similarity as N
from siltstone.plans import catalogue

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("block", [1, 3, 8192])
def test_kendall(spark, block):
    rng = random.Random(block)
    rows = [(g, i, rng.randrange(n), rng.randrange(n) - 3) for g, n in enumerate((1, 2, 5, 12, 40)) for i in range(n)]
    want = {}
    for g in {r[0] for r in rows}:
        x = [r for r in rows if r[0] == g]
        signs = [np.sign((a[2] - b[2]) * (a[3] - b[3])) for k, a in enumerate(x) for b in x[k + 1 :]]
        want[g] = float(np.mean(signs)) if signs else 1.0
    got = {r["g"]: r["tau"] for r in M.kendall_tau(spark.createDataFrame(rows, "g int, item int, predicted int, truth int"), block).collect()}
    assert got == pytest.approx(want)
    assert M.kendall_tau(spark.createDataFrame([], "g int, item int, predicted int, truth int")).count() == 0


@pytest.mark.parametrize("higher", [True, False])
def test_pr_curve_of_one_score(spark, higher):
    rng = random.Random(1)
    rows = [(i * 7 % 500, 0.5 if i % 3 else rng.choice([0.1, 0.9, 0.5, rng.random()]), rng.random() < 0.4) for i in range(500)]
    order = sorted(rows, key=lambda r: (-r[1] if higher else r[1], r[0]))
    hits, want = 0, {}
    for k, (i, _, p) in enumerate(order, 1):
        hits += p
        want[i] = (k, hits / k, hits / sum(r[2] for r in rows))
    out = M.pr_curve(spark.createDataFrame(rows, "id long, score double, positive boolean"), higher).collect()
    assert {r["id"]: (r["rank"], r["precision"], r["recall"]) for r in out} == want


@pytest.mark.parametrize("n", [0, 1, 2, 7, 3000])
def test_grouped_split(spark, n):
    rows = spark.range(n).select((F.col("id") * 3 - 5).alias("g")).unionByName(spark.range(n).select((F.col("id") * 3 - 5).alias("g")))
    out = M.grouped_split(rows, "g").collect()
    assert len(out) == 2 * n
    assert {r["g"] for r in out if r["is_train"]} == {k * 3 - 5 for k in range(max(1, math.floor(n * 0.75)) if n else 0)}


def test_bursts_over_stretches(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("ab"), None if i % 50 == 0 else rng.randrange(60_000)) for i in range(900)]
    out = N.bursts(spark.createDataFrame(rows, "id int, g string, at int"), ["g"], "at", 10.0).collect()
    for g in "ab":
        mine = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
        burst, last, want = 0, None, {}
        for i, _, at in mine:
            burst += not (at is not None and last is not None and at - last <= 10)
            want[i], last = burst, at
        assert {r["id"]: r["burst"] for r in out if r["g"] == g} == want


@pytest.mark.parametrize(("most", "chunks"), [(0, None), (3, None), (14, None), (14, 15), (9, 4)])
def test_hamming(spark, most, chunks):
    rng = random.Random(most)
    base = [rng.getrandbits(64) for _ in range(12)]
    hashes = []
    for b in base:
        for _ in range(8):
            for bit in rng.sample(range(64), rng.randrange(0, 12)):
                b ^= 1 << bit
            hashes.append(b - (1 << 64) if b >> 63 else b)
    hashes += hashes[:4]
    out = N.hamming_pairs(spark.createDataFrame(list(enumerate(hashes)), "id int, hash long"), most, chunks=chunks).collect()
    first = {h: hashes.index(h) for h in hashes}
    far = lambda a, b: ((hashes[a] ^ hashes[b]) & (2**64 - 1)).bit_count()
    want = {(a, b, far(a, b)) for a in first.values() for b in first.values() if a < b and far(a, b) <= most}
    want |= {(first[h], i, 0) for i, h in enumerate(hashes) if first[h] != i}
    assert {tuple(r) for r in out} == want and len(out) == len(want)


def sets_of(rows, k=5):
    out = {}
    for i, t in rows:
        w = re.findall(r"\w+", (t or "").lower())
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    return out


def test_minhash_estimates(spark):
    """The estimates of doc_minhash against exact likeness, and near pairs among them."""
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    exact = sets_of(docs)
    got = {r["id"]: r for r in catalogue.QUERIES["doc_minhash"](spark, DIR).collect()}
    assert all(r["n"] == len(exact[i]) for i, r in got.items())
    for i, r in got.items():
        a, b = exact[i], exact.get(i + 1, set())
        if a and b:
            assert abs(r["likeness"] - len(a & b) / len(a | b)) < 0.2
        else:
            assert r["likeness"] is None
    words = [f"w{k}" for k in range(400)]
    near = [(k, " ".join(words[: 400 - 30 * k])) for k in range(8)] + [(90, None), (91, "")]
    s = {r["id"]: r["signature"] for r in N.minhash(spark.createDataFrame(near, "doc_id long, text string")).collect()}
    sets = sets_of(near)
    assert s[90] is None and s[91] is None
    errors = [abs(np.mean(np.array(s[a]) == np.array(s[b])) - len(sets[a] & sets[b]) / len(sets[a] | sets[b])) for a in range(8) for b in range(8)]
    assert max(errors) < 0.16 and np.mean(errors) < 0.05


def test_archive_pairs(spark):
    rows = spark.createDataFrame(
        [("/d", "photos-2021.zip", False), ("/d", "photos-2021", True), ("/d", "photos_2021", True), ("/d", "a.tar.gz", False), ("/d", "a", True), ("/d", "b.gz", False), ("/d", "b", True), ("/e", "photos-2021.zip", False), ("/d", ".zip", False), ("/d", "Photos-2021x.ZIP", False)],
        "parent string, name string, is_dir boolean",
    )
    out = D.archive_pairs(rows.withColumn("path", F.concat_ws("/", "parent", "name"))).collect()
    assert {r["path"] for r in out} == {"/d/photos-2021.zip", "/d/a.tar.gz", "/d/Photos-2021x.ZIP"}


def test_archive_pairs_of_the_inventory(spark):
    from siltstone.plans.queries import _with_extracted

    inv = [r.asDict() for r in _with_extracted(spark, DIR).select("path", "parent", "name", "is_dir").collect()]
    dirs = defaultdict(list)
    for r in inv:
        if r["is_dir"]:
            dirs[r["parent"]].append(r["name"].lower())
    want = set()
    for r in inv:
        low = r["name"].lower()
        suffix = next((x for x in D.R.ARCHIVE_SUFFIXES if low.endswith(x)), None)
        if suffix and not r["is_dir"]:
            stem = low[: -len(suffix)]
            want |= {r["path"] for d in dirs[r["parent"]] if SequenceMatcher(None, stem, d).ratio() >= 0.9}
    assert {r["path"] for r in catalogue.QUERIES["det_archive_pairs"](spark, DIR).collect()} == want and want


def test_ranker(spark):
    """The ranked rows are all rows, and the ranker puts a label that follows from a feature in front."""
    from siltstone.operators import ranking as K

    out = catalogue.QUERIES["ranked_clutter"](spark, DIR).collect()
    scores = [r["score"] for r in out]
    assert len(out) == spark.read.parquet(f"{DIR}/documents.parquet").count() == len({r["id"] for r in out})
    assert scores == sorted(scores, reverse=True) and len(set(scores)) > 1
    rows = spark.range(600).select("id", *(F.rand(k).alias(c) for k, c in enumerate(K.FEATURES)))
    rows = rows.withColumn("y", (F.col("age_days") > 0.6).cast("double")).cache()
    model = K.fitted(rows.filter("id % 2 = 0"), "y")
    best = K.ranked(model, rows.filter("id % 2 = 1").select("id", "age_days", *(c for c in K.FEATURES if c != "age_days"))).collect()
    top = best[: sum(r["age_days"] > 0.6 for r in best)]
    assert np.mean([r["age_days"] > 0.6 for r in top]) > 0.9


def test_jaccard_pairs(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(60)}" for _ in range(50)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(50)] = f"v{rng.randrange(9)}"
        rows.append((i, " ".join(w)))
    rows += [(100, rows[0][1]), (101, None), (102, ""), (103, "one two"), (104, "One  two")]
    sets = sets_of(rows)
    first = {}
    for i in sorted(sets):
        first.setdefault(frozenset(sets[i]), i)
    ids = sorted(i for s, i in first.items() if s)
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in ids for b in ids if a < b and len(sets[a] & sets[b]) >= 0.3 * len(sets[a] | sets[b])}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r["a"], r["b"]): r["jaccard"] for r in N.jaccard_pairs(df, 0.3).collect()} == want and len(want) > 50
    assert {r["id"]: r["rep"] for r in N.representatives(df, "doc_id", "text").collect()} == {i: first[frozenset(s)] for i, s in sets.items() if s}
    assert Counter(len(s) for s in sets.values())[0] == 2

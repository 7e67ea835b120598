"""Substring, line and near-duplicate operators against brute force."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from fixtures import documents, empty, words
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import line_dedup as L
from siltstone.llm import near_dedup as N
from siltstone.llm import substring_dedup as S


def brute_windows(docs, window):
    first = {}
    for d in sorted(docs):
        w = docs[d]
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), (d, i))
    out = {}
    for d, w in docs.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (d, i):
                gone.update(range(i, i + window))
        out[d] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


@pytest.mark.parametrize("window", [3, 20])
def test_substrings(spark, window):
    df = documents(spark)
    want = brute_windows({r["doc_id"]: words(r["text"]) for r in df.collect()}, window)
    out = S.substring_dedup(df, window)
    assert out.columns == ["doc_id", "text", "_keys", "n_words", "n_removed", "kept_text"]
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in out.collect()} == want
    assert any(v[1] for v in want.values())


def test_substrings_rows(spark):
    rows = [(None, "a b c a b c"), (5, "p q r s"), (5, "p q r s"), (9, "z p q r s")]
    out = S.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 3).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in out) == [(0, 0), (5, 0), (5, 0), (9, 4)]
    assert S.substring_dedup(empty(spark)).count() == 0


def test_heavy_grams_only_route(spark, monkeypatch):
    df = documents(spark)
    want = {r["doc_id"]: r["kept_text"] for r in S.substring_dedup(df, 20).collect()}
    monkeypatch.setattr(S, "HEAVY", 10_000)
    assert {r["doc_id"]: r["kept_text"] for r in S.substring_dedup(df, 20).collect()} == want


def test_hash_collisions(monkeypatch):
    """Windows of one hash but other words are told apart."""
    monkeypatch.setattr(S, "window_hashes", lambda h, w: np.zeros(max(0, len(h) - w + 1), dtype=np.uint64))
    text = [b"a b c d", b"x y z w", b"b c d e"]
    ids, starts, counts, sizes = np.array([1, 2, 3]), np.zeros(3, dtype=np.int64), np.array([2, 2, 2]), np.array([7, 7, 7])
    found = S.repeated_windows(ids, starts, counts, sizes, b"".join(text), 3)
    assert [tuple(int(v) for v in x) for x in zip(*found, strict=True)] == [(3, 0, 1)]


def brute_lines(docs, least):
    keys = {d: [x.strip(" \t\n\v\f\r").encode().lower().decode() for x in (t or "").split("\n")] for d, t in docs.items()}
    first = {}
    for d in sorted(docs):
        for k in keys[d]:
            first.setdefault(k, d)
    out = {}
    for d, t in docs.items():
        lines = (t or "").split("\n")
        keep = [x for x, k in zip(lines, keys[d], strict=True) if len(k) < least or first[k] == d]
        out[d] = (len(lines), len(lines) - len(keep), "\n".join(keep))
    return out


def test_lines(spark):
    df = documents(spark)
    want = brute_lines({r["doc_id"]: r["text"] for r in df.collect()}, 10)
    out = L.line_dedup(df)
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_text"]) for r in out.collect()} == want
    assert sum(v[1] for v in want.values()) > 5


def test_lines_rows(spark):
    rows = [(None, "a line of some length"), (5, "a line of some length"), (5, "a line of some length"), (9, "A LINE of some length  ")]
    out = L.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_dropped"]) for r in out) == [(0, 0), (5, 0), (5, 0), (9, 1)]
    assert L.line_dedup(empty(spark)).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.sets(st.tuples(st.integers(1, 2**64 - 1), st.integers(0, 2**64 - 1)), min_size=1, max_size=300))
def test_perfect_hash(keys):
    k = np.array(sorted(keys), dtype=np.uint64)
    h = L.PerfectHash.load(L.PerfectHash.build(k).dump())
    assert sorted(h.slots(k).tolist()) == list(range(len(k)))


def test_perfect_hash_leftovers(monkeypatch):
    monkeypatch.setattr(L, "LEVELS", 1)
    k = np.random.default_rng(0).integers(1, 2**63, size=(500, 2)).astype(np.uint64)
    h = L.PerfectHash.load(L.PerfectHash.build(k).dump())
    assert len(h.rest) and sorted(h.slots(k).tolist()) == list(range(500))


def test_hot_shards(spark, monkeypatch):
    """Shards with very many probes are read by several groups."""
    monkeypatch.setattr(L, "parts_for", lambda s: 1)
    rows = [(i, f"the same line again\nown line number {i}") for i in range(300)]
    out = L.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sum(r["n_dropped"] for r in out) == 299


def brute_near(docs, k, percent):
    sets = {}
    for d, t in docs.items():
        w = [x.decode() for x in (t or "").encode().lower().split()]
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    up = {d: d for d in docs}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in docs:
        for b in docs:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in docs}


@pytest.mark.parametrize("shingle", [2, 5])
def test_near(spark, shingle):
    df = documents(spark)
    want = brute_near({r["doc_id"]: r["text"] for r in df.collect()}, shingle, 80)
    out = N.near_duplicates(df, shingle)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out.collect()} == want
    assert len({v[1] for v in want.values()}) < len(want) - 5


def test_near_family(spark):
    """A family of near copies some of which only link to some others, and some to none."""
    import random

    rng = random.Random(2)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randrange(0, 12)):
            w[rng.randrange(60)] = f"v{rng.randrange(15)}"
        rows.append((i, " ".join(w)))
    want = brute_near(dict(rows), 2, 80)
    out = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out.collect()}
    assert got == want
    assert len({v[1] for v in want.values()}) > 3


def test_near_blocks(spark, monkeypatch):
    """Keys cut into blocks give what whole keys give."""
    monkeypatch.setattr(N, "BLOCK_ROWS", 7)
    test_near_family(spark)


def test_near_rows(spark):
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (6, "A B c d e f"), (7, None)]
    out = N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in out) == [(0, 0), (4, 4), (4, 4), (6, 4), (7, 7)]
    assert N.near_duplicates(empty(spark)).count() == 0


def test_bitmaps_miss_nothing():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 2**63, size=rng.integers(5, 300)).astype(np.uint64)) for _ in range(20)]
    sets += [np.unique(np.concatenate([s[: int(len(s) * 0.9)], rng.integers(0, 2**63, size=max(1, len(s) // 20)).astype(np.uint64)])) for s in sets]
    n = np.array([len(s) for s in sets])
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            c = len(np.intersect1d(a, b))
            if 100 * c >= 80 * (len(a) + len(b) - c):
                words_ = min(len(N.bitmap(a)), len(N.bitmap(b))) // 8
                x, y = N.folded([N.bitmap(a)], words_), N.folded([N.bitmap(b)], words_)
                assert N.may_link(x, y, n[[i]], n[[j]], 80).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(50, 40), (60, 50)]
    out = {r["id"]: r["component"] for r in N.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(out[i] == 0 for i in range(31)) and out[60] == out[50] == out[40] == 40


def test_pigeonhole():
    """All signatures within the guaranteed distance share a key."""
    rng = np.random.default_rng(1)
    m = N.CHUNKS * N.WIDTH
    for _ in range(50):
        a = rng.integers(0, 2**16, size=m).astype(np.uint16)
        b = a.copy()
        b[rng.choice(m, 2 * N.CHUNKS - 1, replace=False)] ^= 1
        ka, kb = N.chunk_keys(np.stack([a, b]))
        assert set(ka) & set(kb)
        first = N.first_keys(a[None], b[None])[0]
        assert ka[first] == kb[first] and not (set(ka[:first]) & set(kb[:first]) - {ka[first]})


def test_queries(spark, duck, same):
    from siltstone.llm import registry

    assert defaultdict(int)["x"] == 0 and hashlib.sha256
    for name in ("op1_substring_dedup", "op3_line_dedup"):
        same(registry.QUERIES[name](spark, "/root/testdata/sf0.001"), duck.sql(registry.SQL[name]))

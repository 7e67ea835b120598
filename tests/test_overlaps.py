"""Likeness of sets by blocks, against brute force, and what is shuffled for it."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import overlaps as O
from siltstone.operators import review as V
from siltstone.operators import similarity as N
from siltstone.operators import tracks as A
from siltstone.plans import catalogue, review
from siltstone.sources.shared import written

DIR = "/root/testdata/sf0.001"
#: Bytes that 300 near copies may shuffle; with a set for each of their 45 thousand pairs it was 19 MB.
MOST = 4 << 20


def families(seed, n=150):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        base = random.Random(i % 12)
        s = {base.getrandbits(63) - 2**62 for _ in range(5 + 4 * (i % 12))}
        s = {h for h in s if rng.random() > 0.05 * (i % 9)} | {rng.randrange(40) for _ in range(rng.randrange(6))}
        out.append((i * 3 + 1, sorted(s)))
    return [*out, (900, out[7][1]), (0, out[8][1]), (901, []), (902, [5]), (903, [5])]


def linked(ids, edges):
    label = {i: i for i in ids}
    while True:
        new = dict(label)
        for a, b in edges:
            new[a] = new[b] = min(new[a], new[b])
        if new == label:
            return label
        label = new


def shuffled(spark, job):
    """Bytes that the stages of a job write to shuffles."""
    jvm, store = spark._jvm, spark.sparkContext._jsc.sc().statusStore()

    def total():
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(stages.apply(k).stageId(), stages.apply(k).attemptId()): stages.apply(k).shuffleWriteBytes() for k in range(stages.size())}

    before = total()
    job()
    return sum(v for k, v in total().items() if k not in before)


@pytest.mark.parametrize("least", [0.1, 0.5, 0.8])
@pytest.mark.parametrize("n_blocks", [1, 4, 7])
def test_against_brute_force(spark, monkeypatch, least, n_blocks):
    monkeypatch.setattr(O, "LEAST", 1 if n_blocks > 1 else 1 << 30)
    monkeypatch.setattr(O, "SPREAD", n_blocks)
    monkeypatch.setattr(O, "BUCKET", 200)
    rows = families(n_blocks)
    first = {}
    for i, s in sorted(rows):
        first.setdefault(frozenset(s), i)
    sets = [(i, s) for s, i in first.items() if s]
    want = {(min(i, j), max(i, j)): len(s & t) / len(s | t) for k, (i, s) in enumerate(sets) for j, t in sets[:k] if len(s & t) / len(s | t) >= least}
    df = spark.createDataFrame(rows, "id long, s array<long>").repartition(3)
    got = [tuple(r) for r in O.jaccard_pairs(df, least).collect()]
    assert {(a, b): j for a, b, j in got} == want and len(got) == len(want) > 20
    links = [tuple(r) for r in O.jaccard_links(df, least).collect()]
    assert linked(first.values(), links) == linked(first.values(), want)
    copies = [(first[frozenset(s)], i) for i, s in rows if s and first[frozenset(s)] != i]
    of = {i: c for i, c in linked([i for i, _ in rows], [*want, *copies]).items()}
    many = {c for c in of.values() if list(of.values()).count(c) > 1}
    assert {r["id"]: r["component"] for r in N.jaccard_components(df, least).collect()} == {i: c for i, c in of.items() if c in many}


def test_few_values_at_once(spark):
    """Comparisons and deals are cut where they are large; empty and null rows have no pairs."""
    assert list(O.pieces(np.array([3, 3, 9, 1]), 6)) == [(0, 2), (2, 3), (3, 4)] and list(O.pieces(np.zeros(0, dtype=int), 6)) == []
    rows = [(None, [1, 2]), (1, None), (2, []), (3, [1, 2])]
    df = spark.createDataFrame(rows, "id long, s array<long>")
    assert O.jaccard_pairs(df, 0.5).count() == 0 and O.jaccard_links(df.limit(0), 0.5).count() == 0


def pairs_of_sets(spark, n=2000, size=60):
    """Sets of which each two in a row differ in one hash and share none with the others."""
    h = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.xxhash64(F.when(k == 0, F.col("id") + n).otherwise(F.floor(F.col("id") / 2)), k))
    return written(spark.range(0, n, 1, 4).select("id", F.sort_array(h).alias("s")))


def test_counts_in_bytes():
    k = np.array([1, 254, 255, 256, 3, 1000])
    code, edges = O.counted(k)
    assert code.tolist() == [1, 254, 255, 0, 255, 1, 3, 255, 255, 255, 235] and edges.tolist() == [0, 1, 2, 4, 6, 7, 11]
    assert (np.bincount(O.uncounted(code)) == k).all() and (np.diff(O.uncounted(code)) >= 0).all()


def test_buckets_are_sorted_in_parts(monkeypatch):
    """Large buckets are sorted a part at a time, with the hashes that several digests have, each pair once."""
    rng = np.random.default_rng(3)
    d, row, h = np.array([7, -7, 9, 7]), rng.integers(0, 4, 3000, dtype=np.int32), rng.integers(-700, 700, 3000) * 5
    of = {}
    for k, x in zip(row, h, strict=True):
        of.setdefault(int(x), []).append(int(d[k]))
    want = sorted((x, c) for x, cs in of.items() if len(cs) > 1 for c in set(cs))
    for most in (5000, 700, 10):
        monkeypatch.setattr(O, "DEALT", most)
        got = [np.concatenate(x) for x in zip(*O.several(d, row, h, 5), strict=True)]
        assert sorted(zip(got[1].tolist(), got[0].tolist(), strict=True)) == want
        assert (got[1][1:] != got[1][:-1]).sum() + 1 == len(set(got[1].tolist()))


@pytest.mark.parametrize("n_blocks", [2, 16, 50])
def test_guests_only_where_one_can_be_like_them(spark, monkeypatch, n_blocks):
    """A set goes where it may meet one like it, not to half of the blocks; more blocks than places lose nothing."""
    monkeypatch.setattr(O, "LEAST", 1)
    monkeypatch.setattr(O, "SPREAD", n_blocks)
    sets = written(O.shared_hashes(pairs_of_sets(spark), 0.5))
    assert sets.count() == 2000 and O.met(sets).count() < 3 * 2000
    assert sorted((r["a"], r["b"]) for r in O.like_pairs(sets, 0.5).collect()) == [(i, i + 1) for i in range(0, 2000, 2)]
    assert sorted(tuple(sorted(r)) for r in O.like_links(sets, 0.5).collect()) == [(i, i + 1) for i in range(0, 2000, 2)]


def test_more_blocks_take_no_more_guests(spark, monkeypatch):
    """A set is a guest where one like it can be, not in half of the blocks that a row of places is cut into."""
    monkeypatch.setattr(O, "BLOCK", 1000 * 59 // 100)
    sets = written(O.shared_hashes(pairs_of_sets(spark, 1000), 0.5))
    assert sets.count() == 1000 and O.met(sets).count() < 3 * 1000
    assert sorted((r["a"], r["b"]) for r in O.like_pairs(sets, 0.5).collect()) == [(i, i + 1) for i in range(0, 1000, 2)]


def test_more_buckets_shuffle_little_more(spark, monkeypatch):
    """Of a set there goes a digest and a byte to each of its buckets, so few hashes in each cost little."""
    s = F.sort_array(F.transform(F.sequence(F.lit(1), F.lit(300)), lambda k: F.xxhash64("id", k)))
    sets, bytes_ = written(spark.range(0, 2000, 1, 4).select("id", s.alias("s"))), []
    for n in (4, 100):
        monkeypatch.setattr(O, "FEWEST", n)
        bytes_.append(shuffled(spark, lambda: O.shared_hashes(sets, 0.5).count()))
    assert bytes_[1] < 1.4 * bytes_[0]


def near_copies(spark, n=300, words=400):
    """Texts of which each has a word of its own in place of one."""
    w = F.transform(F.sequence(F.lit(0), F.lit(words - 1)), lambda k: F.when(k == F.col("id") % words, F.concat(F.lit("own"), F.col("id").cast("string"))).otherwise(F.concat(F.lit("w"), k.cast("string"))))
    return spark.range(0, n, 1, 4).select(F.col("id").alias("doc_id"), F.array_join(w, " ").alias("text"))


@pytest.fixture
def merged(spark):
    """Without broadcasts of what is small here and large elsewhere."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["doc_components", "doc_keep", "two_stage_documents"])
def test_groups_shuffle_no_sets_with_pairs(spark, merged, tmp_path, name):
    """Sets are shuffled a bounded number of times, not once for each pair of near copies."""
    near_copies(spark).withColumns({"lang": F.lit("en"), "source": F.lit("web"), "n_chars": F.length("text").cast("long")}).write.parquet(f"{tmp_path}/documents.parquet")
    out = []
    bytes_ = shuffled(spark, lambda: out.extend(catalogue.QUERIES[name](spark, str(tmp_path)).collect()))
    assert len(out) == 300 and {r["cluster" if name == "two_stage_documents" else "component"] for r in out} == {0}
    assert bytes_ < MOST


def test_documents_of_an_analysis_shuffle_no_sets_with_pairs(spark, merged):
    texts = near_copies(spark).select(F.col("doc_id").alias("id"), F.lit("/a/plan_v1.txt").alias("path"), F.array(F.lit(1.0), F.lit(2.0)).alias("vector"), "text")
    out = []
    bytes_ = shuffled(spark, lambda: out.extend(A.documents(texts).collect()))
    assert len(out) == 300 and {(r["cluster"], r["track"]) for r in out} == {(0, "version_chain")}
    assert bytes_ < MOST


def test_the_inventory_of_an_analysis_is_made_without_a_join(spark):
    """Texts aren't shuffled to meet their own letters, and aren't written before the analysis writes them."""
    plan = review._media(spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "/documents.parquet" in plan


def test_pairs_shuffle_no_sets_with_pairs(spark, merged):
    out = []
    bytes_ = shuffled(spark, lambda: out.append(N.jaccard_pairs(near_copies(spark), 0.5).count()))
    assert out == [300 * 299 // 2]
    assert bytes_ < MOST


def tabled(spark, tmp_path):
    near_copies(spark).withColumns({"lang": F.lit("en"), "source": F.lit("web"), "n_chars": F.length("text").cast("long")}).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def writes(spark, job):
    """MB that the stages of a job write to tables."""
    jvm, store = spark._jvm, spark.sparkContext._jsc.sc().statusStore()

    def total():
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(stages.apply(k).stageId(), stages.apply(k).attemptId()): stages.apply(k).outputBytes() for k in range(stages.size())}

    before = total()
    job()
    return sum(v for k, v in total().items() if k not in before)


@pytest.mark.parametrize("narrow", [True, False])
def test_shared_hashes_are_numbered(spark, monkeypatch, narrow):
    """Each hash that several sets have has one number in all of them, in 32 bits where there aren't too many."""
    monkeypatch.setattr(O, "NARROW", 1 << 32 if narrow else 0)
    monkeypatch.setattr(O, "BUCKET", 200)
    rng = random.Random(5)
    rows = [(i, sorted({rng.randrange(-300, 300) * 2**50 for _ in range(40)})) for i in range(60)]
    got = O.shared_hashes(written(spark.createDataFrame(rows, "id long, s array<long>")), 0.1)
    assert got.schema["s"].dataType.simpleString() == ("array<int>" if narrow else "array<bigint>")
    sets = {r["id"]: r["s"] for r in got.collect()}
    whole = dict(rows)
    of = {}
    for i, s in rows:
        for h in s:
            of.setdefault(h, set()).add(i)
    holders = sorted(tuple(sorted(x)) for x in of.values() if len(x) > 1)
    numbered = {}
    for i, s in sets.items():
        assert len(set(s)) == len(s) == sum(len(of[h]) > 1 for h in whole[i])
        for x in s:
            numbered.setdefault(x, []).append(i)
    assert sorted(tuple(sorted(x)) for x in numbered.values()) == holders and len(sets) == 60


def test_two_stages_write_no_sets(spark, tmp_path):
    """Sets of 300 texts (0.9 MB of hashes) are made where they are dealt; what is written are the hashes that several share."""
    d = tabled(spark, tmp_path)
    sets = writes(spark, lambda: written(N.shingle_sets(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", "text")))
    both = []
    shared = writes(spark, lambda: both.append(written(O.shared_hashes(written(N.shingle_sets(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", "text")), 0.1)))) - sets
    whole = writes(spark, lambda: catalogue.QUERIES["two_stage_documents"](spark, d).count())
    assert whole < shared + sets / 2 + 250_000


def test_many_small_groups_are_no_calls_of_their_own(spark):
    """2,000 groups of three rows: the result of all pairs, without a call from Spark for each group."""
    rows = spark.range(6000).select(F.floor(F.col("id") / 3).alias("grp"), "id", F.array(F.cos(F.col("id") % 3 / 10.0), F.sin(F.col("id") % 3 / 10.0)).alias("v"))
    edges, worst = V.near_edges(rows, 0.99), V.extremes(rows, V.least_cosine)
    for df in (edges, worst):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroups" not in plan and "REPARTITION_BY_NUM" in plan
    assert {(r["component"], r["id"]) for r in N.components(edges).collect()} == {(3 * (i // 3), i) for i in range(6000)}
    got = worst.collect()
    assert len(got) == 2000 and {round(-r["extreme"], 9) for r in got} == {round(float(np.cos(0.2)), 9)}


def test_letters_of_texts(spark):
    """As the SQL counts them: lower-cased, other characters left out, null where no ASCII letter is."""
    texts = ["aAbz", "\u212a", "\u212a x", "\u0130e", "\u00e9\u4e2d", "", None, "1 2"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["v"] for r in df.select("doc_id", review._letter_counts().alias("v")).collect()}
    some = lambda s: [float(s.count(c)) for c in "abcdefghijklmnopqrstuvwxyz"]
    assert got == {0: some("aabz"), 1: None, 2: some("kx"), 3: some("ie"), 4: None, 5: None, 6: None, 7: None}


def test_groups_in_strips(spark):
    """Blocks of a group are compared a strip at a time, with the result of all pairs."""
    n = 3000
    rows = spark.range(n).select(F.lit(1).cast("long").alias("grp"), "id", F.array(F.cos(F.col("id") / n), F.sin(F.col("id") / n)).alias("v"))
    for block in (n, 512):
        assert len({r["component"] for r in N.components(V.near_edges(rows, 0.99, block)).collect()}) == 1
        assert V.extremes(rows, V.least_cosine, block).first()["extreme"] == pytest.approx(-np.cos((n - 1) / n))

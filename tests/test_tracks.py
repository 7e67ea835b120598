"""The analysis in tracks: who claims what, and what a failure leaves."""

import pytest
from pyspark.sql import functions as F

from siltstone.operators import tracks as A
from siltstone.operators.places import placed
from siltstone.plans import catalogue

SCHEMA = "id long, path string, size long, mtime double, width int, height int, hash long, vector array<double>, text string"
WORDS = " ".join(f"w{i}" for i in range(40))
ROWS = [
    (1, "/p/a.png", 10, 0.0, 8, 8, 0, [1.0, 0.0], None),
    (2, "/p/b.png", 10, 0.0, 8, 8, 3, [1.0, 0.0], None),
    (3, "/p/c.jpg", 10, 0.0, 8, 8, -1, [1.0, 0.1], None),
    (4, "/p/d.JPG", 10, 0.0, 8, 8, 0x0F0F0F0F0F0F0F0F, [1.0, 0.1], None),
    (5, "/p/Screenshot 1.png", 10, 5.0, 8, 8, 0x5555555555555555, [0.0, 1.0], None),
    (6, "/p/screenshot2.png", 10, 50.0, 8, 8, 0x5555555555555554, [0.0, -1.0], None),
    (7, "/p/screenshot3.png", 10, 50.0, 9, 8, 0x5555555555555554, None, None),
    (8, "/p/huge.png", 10**9, 0.0, 8, 8, 0, [1.0, 0.0], None),
    (9, "/d/plan_v1.txt", 10, 0.0, None, None, None, [1.0, 0.0], WORDS),
    (10, "/d/plan_v2.txt", 30, 0.0, None, None, None, [1.0, 0.0], WORDS + " end"),
    (11, "/d/a.md", 10, 0.0, None, None, None, [0.0, 1.0], "some other text of a few words"),
    (12, "/d/b.md", 10, 0.0, None, None, None, [0.0, 1.0], "some other text of a few words"),
    (13, "/x/tool.exe", 10, 0.0, None, None, None, None, None),
]


def clusters(members):
    out = {}
    for r in members.collect():
        out.setdefault((r["track"], r["cluster"]), set()).add(r["id"])
    return out


def test_tracks(spark):
    inv = spark.createDataFrame(ROWS, SCHEMA)
    a = A.analysis(inv, scorer=lambda c: c.select("cluster", "id", F.col("bytes").cast("double").alias("raw_score")))
    got = clusters(a.members.filter("track <> 'ranked_clutter'"))
    assert got == {
        ("near_identical_image", 1): {1, 2},
        ("near_identical_image", 5): {5, 6, 7},
        ("semantic_image", 3): {3, 4},
        ("version_chain", 9): {9, 10},
        ("near_dup_document", 11): {11, 12},
        ("screenshot_burst", 5): {5, 6},
    }
    states = {r["track"]: (r["state"], r["n_considered"], r["n_clusters"]) for r in a.states.collect()}
    assert states["semantic_image"] == ("run", 2, 1) and states["near_identical_image"] == ("run", 7, 2) and states["ranked_clutter"] == ("run", 6, 5)
    assert [tuple(r) for r in a.left_out.collect()] == [("image", 1)]
    order = [(r["track"], r["cluster"]) for r in A.in_order(a.members, inv).orderBy("place").collect()]
    assert order == [("version_chain", 9), ("near_identical_image", 5), ("near_dup_document", 11), ("near_identical_image", 1), ("screenshot_burst", 5), ("semantic_image", 3)]


def test_a_failing_track_leaves_its_rows(spark, monkeypatch):
    def broken(images, most):
        return images.select(F.raise_error(F.lit("no decoder")).cast("long").alias("cluster"), "id", F.lit(0.0).alias("raw_score"))

    monkeypatch.setattr(A, "near_identical", broken)
    a = A.analysis(spark.createDataFrame(ROWS, SCHEMA))
    states = {r["track"]: (r["state"], r["n_considered"]) for r in a.states.collect()}
    assert states["near_identical_image"] == ("skipped", 7) and states["semantic_image"] == ("run", 7) and states["ranked_clutter"][0] == "skipped"
    assert clusters(a.members)[("semantic_image", 1)] == {1, 2, 3, 4}
    empty = A.analysis(spark.createDataFrame([], SCHEMA))
    assert empty.members.count() == 0 and empty.states.filter("state = 'run'").count() == 5


DIR = "/root/testdata/sf0.001"


def no_search(*_):
    raise OSError("no space left on device")


@pytest.mark.parametrize("name", ["analysis_members", "analysis_order"])
@pytest.mark.parametrize("track", ["near_identical", "documents"])
def test_members_without_those_of_a_failed_track_are_no_result(spark, monkeypatch, name, track):
    monkeypatch.setattr(A, track, no_search)
    with pytest.raises(RuntimeError, match="isn't whole") as e:
        catalogue.QUERIES[name](spark, DIR)
    assert isinstance(e.value.__cause__, OSError)


def test_places(spark):
    df = spark.range(0, 3000, 1, 5).select(F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("g"), F.col("id"))
    rows = placed(df, "g", (F.desc("id"),), "n").collect()
    for g, n in (("a", 2700), ("b", 300)):
        own = sorted((r["at"], r["id"]) for r in rows if r["g"] == g)
        assert [at for at, _ in own] == list(range(n)) and [i for _, i in own] == sorted((i for _, i in own), reverse=True)
        assert {r["n"] for r in rows if r["g"] == g} == {n}


def test_running_sums_and_first_rows(spark):
    import random

    from siltstone.operators.places import first_rows, running

    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.randrange(3)) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, seq long, k int").repartition(6)
    got = {r["seq"]: (r["n0"], r["s"]) for r in running(df, "g", ("seq",), {"n0": F.col("k") == 0, "s": F.col("k")}).collect()}
    for g, i, _ in rows:
        before = [k for h, j, k in rows if h == g and j < i]
        assert got[i] == (before.count(0), sum(before))
    first = sorted(((r["g"] or "", r["place"], r["seq"]) for r in first_rows(df, "g", (F.desc("seq"),), 3).collect()))
    want = [(g or "", p, i) for g in (None, "a", "b") for p, i in enumerate(sorted((j for h, j, _ in rows if h == g), reverse=True)[:3], 1)]
    assert first == want
    at = {r["seq"]: (r["at"], r["n"]) for r in placed(df, "g", ("seq",), "n").collect()}
    none = sorted(j for h, j, _ in rows if h is None)
    assert [at[j] for j in none] == [(p, len(none)) for p in range(len(none))]

"""Archives and unpacked directories beside them: the ratio decides, and few names meet."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from siltstone.operators import detectors as D


def made(n, short):
    """Names of one folder that are near each other, some over 200 characters, and some whose lower case is longer."""
    rng = random.Random(n)
    word = lambda k: "".join(rng.choice("abAB_İé1") for _ in range(k))
    rows = []
    for _ in range(n):
        stem = word(rng.choice([1, 2, 5, 9, 10, 11, 12] if short else [10, 21, 40, 230]))
        near = list(stem)
        for _ in range(rng.randrange(3)):
            near[rng.randrange(len(near))] = rng.choice("ab1")
        rows += [("/d", stem + rng.choice([".zip", ".TAR.gz", ".tar"]), False), ("/d", "".join(near) + rng.choice(["", "x"]), True), ("/e", stem, True)]
    return rows


@pytest.mark.parametrize("short", [True, False])
@pytest.mark.parametrize("compared", [1 << 16, 7])
def test_against_all_pairs(spark, monkeypatch, short, compared):
    monkeypatch.setattr(D, "COMPARED", compared)
    rows = sorted(set(made(150, short)))
    dirs = {name.lower() for parent, name, is_dir in rows if parent == "/d" and is_dir}
    stem = lambda name: next(name[: -len(x)] for x in D.R.ARCHIVE_SUFFIXES if name.lower().endswith(x))
    want = {f"/d/{name}" for _, name, is_dir in rows if not is_dir and any(SequenceMatcher(None, stem(name).lower(), d).ratio() >= 0.9 for d in dirs)}
    df = spark.createDataFrame(rows, "parent string, name string, is_dir boolean").withColumn("path", F.concat_ws("/", "parent", "name"))
    got = [r["path"] for r in D.archive_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want and 20 < len(want) < 150


def test_few_names_meet(spark, monkeypatch, tmp_path):
    """2,000 archives and 2,000 directories of one folder and length are compared with few of each other, not with all."""
    seen = spark.sparkContext.accumulator(0)
    bound = D.common_bound

    def counted(a, b):
        seen.add(len(a))
        return bound(a, b)

    monkeypatch.setattr(D, "common_bound", counted)
    df = spark.range(2000).select(F.lit("/d").alias("parent"), F.explode(F.array(F.struct(F.concat(F.lit("pack_"), F.col("id") + 10000, F.lit(".zip")).alias("name"), F.lit(False).alias("is_dir")), F.struct(F.concat(F.lit("pack_"), F.col("id") + 10000).alias("name"), F.lit(True).alias("is_dir")))).alias("f")).select("parent", "f.*")
    out = D.archive_pairs(df.withColumn("path", F.concat_ws("/", "parent", "name"))).count()
    assert out == 2000 and 2000 <= seen.value < 500_000


def test_fewest_common():
    for total in range(1, 400):
        m = D.fewest_common(total, 0.9)
        assert 2.0 * m / total >= 0.9 and (m == 0 or 2.0 * (m - 1) / total < 0.9)

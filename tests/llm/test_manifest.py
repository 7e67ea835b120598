"""The manifest against trees built by hand."""

import hashlib

import pytest
from pyspark.sql import functions as F

from siltstone.llm import manifest as M
from siltstone.operators.places import placed

COLUMNS = ("doc_id", "lang", "text")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(digests):
    """(root, proofs): the siblings of each leaf from its level up."""
    proofs, at, level = [""] * len(digests), list(range(len(digests))), digests
    while len(level) > 1:
        runs = [level[i : i + 8] for i in range(0, len(level), 8)]
        for k in range(len(digests)):
            proofs[k] += "".join(x for i, x in enumerate(runs[at[k] // 8]) if i != at[k] % 8)
            at[k] //= 8
        level = [sha("".join(r)) for r in runs]
    return level[0], proofs


def expected(rows):
    """(leaf, subroot, proof) of each row, and the root."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    found, subs = [], []
    for g in langs:
        leaves = sorted(((r[0] is not None, r[0] or 0, sha("".join(map(enc, r)))) for r in groups[g]))
        sub, proofs = tree([x[2] for x in leaves])
        subs.append(sub)
        found += [(len(subs) - 1, x[2], sub, p) for x, p in zip(leaves, proofs, strict=True)]
    root, upper = tree(subs)
    return sorted((leaf, sub, p + upper[g]) for g, leaf, sub, p in found), root


@pytest.mark.parametrize("langs", [1, 3, 70])
def test_manifest(spark, langs):
    rows = [(i, None if i % langs == 1 else f"l{i % langs}", None if i == 5 else f"Text {i} é") for i in range(700 if langs < 9 else 150)]
    rows += [(None, "l0", "no id"), (3, "alone", "x"), (12, "l0", "A"), (12, "l0", "A"), (-4, "l0", ""), (9, "", "empty name")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, lang string, text string, at long, `a.b` string").repartition(3)
    m = M.build(df, "doc_id", "lang", COLUMNS, F.when(F.col("doc_id") % 5 == 0, F.sha2("text", 256)).alias("tampered"))
    got = M.paths(m).withColumn("proof", M.siblings(F.col("path"))).withColumn("folded", M.folded(F.coalesce("tampered", "leaf"), F.col("path"))).collect()
    want, root = expected(rows)
    assert m.root == root
    assert sorted((r["leaf"], r["subroot"], r["proof"]) for r in got) == want
    for r in got:
        assert (r["folded"] == root) == (r["tampered"] is None)


def test_small_manifests(spark):
    none = spark.createDataFrame([], "doc_id long, lang string, text string")
    m = M.build(none, "doc_id", "lang", COLUMNS)
    assert m.root is None and M.paths(m).count() == 0
    one = M.build(spark.createDataFrame([(None, None, None)], none.schema), "doc_id", "lang", COLUMNS)
    assert one.root == sha("---")
    assert [(r["subroot"], list(r["path"])) for r in M.paths(one).collect()] == [(one.root, [])]


def test_places_of_one_large_group(spark):
    """A tree over several ranges of ids is counted through."""
    df = spark.range(0, 5000, 1, 7).select(F.col("id"), F.lit("x").alias("_tree"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"))
    out = placed(df, "_tree", ("id", "leaf"), "n")
    assert out.filter((F.col("at") != F.col("id")) | (F.col("n") != 5000)).count() == 0

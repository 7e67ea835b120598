"""Columns of any name beside those that operators use."""

import pytest
from fixtures import texts
from pyspark.sql import functions as F

from siltstone.llm import chat, collocations, contamination, fingerprints, line_dedup, manifest, near_dedup, packing, pieces, quality_rules, substring_dedup, token_counts

NAMES = ("_id", "a.b", "tick`s", "_KEYS", "_starts", "_counts", "_ID", "n_words2", "__id", "Key", "h", "pos", "doc", "kept")


def rows(spark):
    from siltstone.llm._blocks import quoted

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts()[:25])], "doc_id long, text string").repartition(2)
    return df.select("*", *(F.lit(f"{k}-{n}").alias(n) for k, n in enumerate(NAMES) if n.lower() not in {m.lower() for m in NAMES[:k]})), quoted


PASSING = {
    "lines": lambda df: line_dedup.line_dedup(df),
    "substrings": lambda df: substring_dedup.substring_dedup(df, 20),
    "quality": lambda df: quality_rules.quality_rules(df.drop("kept"), None),
}


@pytest.mark.parametrize("name", sorted(PASSING))
def test_columns_pass_through(spark, name):
    df, quoted = rows(spark)
    out = PASSING[name](df)
    kept = [c for c in df.columns if name != "quality" or c != "kept"]
    assert out.columns[: len(kept)] == kept
    first = out.select(*map(quoted, kept[2:])).distinct().collect()
    assert len(first) == 1 and all(v.endswith(f"-{c}") for c, v in first[0].asDict().items())
    plain = PASSING[name](df.select("doc_id", "text", *(["kept"] if name != "quality" else [])))
    new = [c for c in out.columns if c not in kept]
    assert sorted(map(str, out.select("doc_id", *new).collect())) == sorted(map(str, plain.select("doc_id", *new).collect()))


OTHERS = {
    "near": lambda df: near_dedup.near_duplicates(df, 2, 80),
    "packing": lambda df: packing.pack_documents(df, 2048),
    "tokens": lambda df: token_counts.token_budget(df, 2048),
    "pieces": lambda df: pieces.piece_digests(df),
    "fingerprints": lambda df: fingerprints.with_next(df),
    "contamination": lambda df: contamination.contamination(df, df.select(F.col("doc_id").alias("item_id"), "text").limit(3)),
    "collocations": lambda df: collocations.collocations(df.withColumn("lang", F.lit("en")), 3),
    "manifest": lambda df: manifest.paths(manifest.build(df, "doc_id", "h", ("doc_id", "a.b", "text"))),
    "chat": lambda df: chat.rotate_perspectives(df.withColumn("conv_id", F.lit(1)).withColumn("turn", F.col("doc_id")).withColumn("role", F.lit("x"))),
}


@pytest.mark.parametrize("name", sorted(OTHERS))
def test_columns_are_ignored(spark, name):
    df, _ = rows(spark)
    assert OTHERS[name](df).count() > 0

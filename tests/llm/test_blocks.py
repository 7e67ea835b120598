"""Operators over one batch that is cut into many blocks: slices, nulls at their edges, texts longer than a block."""

import numpy as np
import pytest
import test_dedup
import test_others
import test_tokens
from fixtures import texts, words

from siltstone.llm import fingerprints as B
from siltstone.llm import line_dedup as L
from siltstone.llm import near_dedup as N
from siltstone.llm import packing as K
from siltstone.llm import pieces as P
from siltstone.llm import quality_rules as Q
from siltstone.llm import substring_dedup as S
from siltstone.llm import token_counts as T
from siltstone.llm import vocab

SMALL = 300
CONSTANTS = [(S, "BLOCK"), (L, "BLOCK_BYTES"), (T, "BLOCK"), (Q, "BLOCK"), (K, "BLOCK"), (P, "BLOCK"), (N, "BLOCK_BYTES"), (N, "SET_BLOCK")]


def one_batch(spark, extra=True):
    """All texts in one partition, each third row a null, so that blocks begin and end with nulls."""
    rows = []
    for i, t in enumerate(texts()):
        rows += [(3 * i, t), (3 * i + 1, t if i % 4 == 0 else None), (3 * i + 2, None if i % 2 else "")]
    np.random.default_rng(3).shuffle(rows)
    rows = [(int(i), t) for i, t in rows]
    if not extra:
        return spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    return spark.createDataFrame([(i, t, 7, "clash", 9) for i, t in rows], "doc_id long, text string, n_words long, kept_text string, _keys long").coalesce(1)


@pytest.fixture
def cut(monkeypatch):
    for module, name in CONSTANTS:
        monkeypatch.setattr(module, name, SMALL)
    for module in (test_dedup, test_tokens, test_others):
        monkeypatch.setattr(module, "documents", one_batch)


@pytest.fixture(scope="module")
def library():
    return vocab.word_vocabulary(vocab.default_path("word_bpe_49k.json")).library


@pytest.mark.parametrize("window", [3, 20])
def test_substrings(spark, cut, window):
    test_dedup.test_substrings(spark, window)


def test_substrings_without_ids(spark, cut):
    """Rows without an id in the midst of a block remove nothing."""
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(None if i % 3 == 0 else i, f"{passage} own{i}") for i in range(40)]
    out = S.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in out) == sorted((i if i % 3 else 0, 30 if i % 3 and i > 1 else 0) for i in range(40))


def test_lines(spark, cut):
    test_dedup.test_lines(spark)


def test_budget(spark, cut, library):
    test_tokens.test_budget(spark, library)


def test_base_rules(spark, cut):
    test_others.test_base_rules(spark)


def test_field(spark, monkeypatch):
    """The fitted field's verdicts don't depend on blocks."""
    docs, labels = (spark.read.parquet(f"{test_others.DIR}/{t}.parquet") for t in ("documents", "labels"))
    field = Q.fit_field(docs, labels)
    want = {r["doc_id"]: (r["kept"], r["n_words"]) for r in Q.quality_rules(docs.coalesce(1), field).collect()}
    monkeypatch.setattr(Q, "BLOCK", SMALL)
    assert {r["doc_id"]: (r["kept"], r["n_words"]) for r in Q.quality_rules(docs.coalesce(1), field).collect()} == want


def test_packing(spark, cut, library):
    test_tokens.test_packing(spark, library)


@pytest.mark.parametrize("shingle", [2, 5])
def test_near(spark, cut, shingle):
    test_dedup.test_near(spark, shingle)


def test_pieces(spark, cut):
    test_tokens.test_pieces(spark)


def test_pipeline(spark, cut):
    test_others.test_pipeline(spark)


@pytest.mark.parametrize("wide", [1, 2, 5, 1024])
def test_runs(spark, monkeypatch, wide):
    """Fingerprints meet their next document however ids are cut into runs."""
    monkeypatch.setattr(B, "RUN_BYTES", 50)
    monkeypatch.setattr(B, "WIDEST", wide)
    test_others.test_fingerprints(spark)
    rng = np.random.default_rng(4)
    ids = sorted({*range(20), *(int(x) for x in rng.integers(-(2**60), 2**60, size=40)), 2**63 - 1, -(2**63)})
    out = B.with_next(spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string").repartition(3)).collect()
    assert {r["doc_id"]: r["next_text"] for r in out} == {i: f"text {n}" for i, n in zip(ids, ids[1:] + ids[:1], strict=True)}


def test_words_of_slices():
    """A slice of a column gives what a copy of it gives."""
    import pyarrow as pa

    from siltstone.llm._blocks import word_codes

    column = pa.array(texts())
    for low in range(0, len(column), 3):
        codes, offsets, table = word_codes(column.slice(low, 3))
        table = table.to_pylist()
        assert [[table[c] for c in codes[a:b]] for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [words(t) for t in column.slice(low, 3).to_pylist()]

"""Phrase and proximity matches against brute force."""

import random
import re

import pytest
from fixtures import texts
from pyspark.sql import functions as F

from siltstone.llm import contamination as C


def split(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low) if w]


def brute(docs, items, size, within):
    """(n_words, n_hit, item ids, near ids) of each document."""
    asked = {}
    for k, t in items:
        w = split(t)
        for s in range(max(1, len(w) - size + 1)) if w else ():
            asked.setdefault(tuple(w[s : s + size]), set()).add(k)
    out = []
    for d, t in docs:
        w, hit, got, near = split(t), set(), set(), set()
        for p, ids in asked.items():
            at = [s for s in range(len(w) - len(p) + 1) if tuple(w[s : s + len(p)]) == p]
            hit |= {s + k for s in at for k in range(len(p))}
            got |= ids if at else set()
            near |= ids if any(set(p) <= set(w[k : k + within]) for k in range(len(w))) else set()
        listed = lambda x: sorted(str(i) for i in x if i is not None)
        out.append((d, len(w), len(hit), listed(got), listed(near)))
    return sorted(out, key=repr)


def items_of(seed):
    """Items cut out of the texts, turned round, short, empty, equal, without id."""
    rng = random.Random(seed)
    said = [t for t in texts() if t and len(split(t)) > 30]
    out = [(i, " ".join(split(said[i])[3 : 3 + rng.randrange(4, 25)]).upper()) for i in range(10)]
    out += [(20, " ".join(reversed(split(said[1])[4:12]))), (21, "nowhere to be found in any of the texts at all"), (22, "one"), (23, ""), (24, None), (25, out[0][1]), (None, out[1][1]), (26, "the the the"), (4, "mixed ends")]
    return out


@pytest.mark.parametrize(("size", "within"), [(10, 20), (3, 2), (1, 1)])
def test_contamination(spark, size, within):
    docs = [(i * 3 + 1, t) for i, t in enumerate(texts())] + [(4, "one"), (4, "of two texts"), (None, "one two"), (1000, "of two texts"), (7, None)]
    items = items_of(1)
    df = spark.createDataFrame([(*d, 1, "x", "y", 2) for d in docs], "doc_id long, text string, pos int, term string, `a.b` string, _doc int").repartition(3)
    got = C.contamination(df, spark.createDataFrame(items, "item_id long, text string"), size, within)
    assert got.columns == ["doc_id", "n_words", "n_hit", "item_ids", "near_ids"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, items, size, within)


def test_repeated_rows_and_empty_tables(spark):
    none, one = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b c")] * 2, "doc_id long, text string")
    items = one.withColumnRenamed("doc_id", "item_id")
    assert C.contamination(none, items).count() == 0
    assert [(r["n_hit"], r["item_ids"]) for r in C.contamination(one, items).collect()] == [(3, ["1"])] * 2
    assert [r["n_hit"] for r in C.contamination(one, items.limit(0)).collect()] == [0, 0]


def test_index(spark):
    rows = C.build_index(spark.createDataFrame([(1, "B a, b"), (2, None)], "doc_id long, text string"))
    terms = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "term string, tid long").withColumn("h", C.term_hash(F.col("term")))
    assert sorted((r["tid"], r["doc"], r["pos"]) for r in C.lists_of(rows, terms).collect()) == [(1, 1, 1), (2, 1, 0), (2, 1, 2)]
    assert all(r["postings"] == sorted(r["postings"]) and len(r["postings"]) == r["n_words"] for r in rows.collect())


def test_terms_of_one_hash(spark, monkeypatch):
    """Terms whose hashes are equal are told apart by the words themselves."""
    monkeypatch.setattr(C, "term_hash", lambda term: F.xxhash64(F.length(term)).bitwiseAND(F.lit(-1 << 32)))
    docs, items = [(i, t) for i, t in enumerate(texts()) if t is None or len(t) < 1000], items_of(2)
    got = C.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 4, 5)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, items, 4, 5)

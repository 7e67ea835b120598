"""The automaton against all substrings, phrases against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from fixtures import texts
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import collocations as C
from siltstone.llm.automaton import SuffixAutomaton


@given(st.lists(st.integers(-1, 3), max_size=60), st.integers(2, 5))
@settings(max_examples=60, deadline=None)
def test_automaton(codes, depth):
    found = SuffixAutomaton(np.array(codes, dtype=np.int32), 4, depth)
    ends = {}
    for i in range(len(codes)):
        for d in range(1, depth + 1):
            s = tuple(codes[i : i + d])
            if len(s) == d and min(s) >= 0:
                ends.setdefault(s, set()).add(i + d - 1)
    got = {}
    for length, end, least, count in found.states():
        for e, a, n in zip(end.tolist(), least.tolist(), count.tolist(), strict=True):
            state = [tuple(codes[e - d + 1 : e + 1]) for d in range(a, length + 1)]
            assert all(len(ends[s]) == n and ends[s] == ends[state[-1]] for s in state)
            if a > 1:  # the link: the next shorter suffix ends at more places
                assert len(ends[state[0][1:]]) > n
            got |= dict.fromkeys(state, n)
    assert got == {s: len(e) for s, e in ends.items()}
    for s in ends:  # the automaton reads all of its substrings
        at = s[0]
        for d, code in enumerate(s[1:], 1):
            at = found.transition(d, at, code)
            assert at >= 0
        assert len(s) == depth or found.transition(len(s), at, 9) == -1


def brute(rows, least, longest, top):
    counts, n, out = {}, Counter(), []
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            n[lang] += len(w)
            for d in range(1, longest + 1):
                for i in range(len(w) - d + 1):
                    counts.setdefault(lang, Counter())[tuple(w[i : i + d])] += 1
    for lang, c in counts.items():
        good = {p: a for p, a in c.items() if a >= least and len(p) > 1}
        within = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        found = []
        for p, a in good.items():
            if not any(len(q) > len(p) and 100 * b >= 100 * a and within(p, q) for q, b in good.items()):
                score, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), a, c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), a, left, right, n[lang], -score) for i, (score, _, p, a, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def rows_of(seed):
    rng = random.Random(seed)
    said = [t for t in texts(seed) if t is None or len(t) < 4000]
    out = [(t, rng.choice(["en", "en", "de", None, "und"])) for t in said + said[:6]]
    return [*out, ("new york, New York; new\tyork x\x0bnew york", "en"), ("é é. É é", "fr"), ("", "none"), (None, None)]


@pytest.mark.parametrize(("least", "longest", "top", "words"), [(2, 5, 2000, 1 << 20), (3, 3, 7, 50), (1, 2, 5, 300), (4, 5, 30, 1)])
def test_collocations(spark, monkeypatch, least, longest, top, words):
    monkeypatch.setattr(C, "SHARD_WORDS", words)
    df = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows_of(3)], "text string, lang string, n long, phrase string, `a.b` double").repartition(3)
    got = C.collocations(df, least, longest, top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows_of(3), least, longest, top)


def test_rare_phrases_that_pass_for_frequent_change_nothing(spark, monkeypatch):
    """Hashed counts only rule out: with everything let through the result is the same."""
    real = C.promising
    monkeypatch.setattr(C, "promising", lambda shards, n_buckets, min_count: real(shards, n_buckets, 1))
    df = spark.createDataFrame(rows_of(4), "text string, lang string").repartition(2)
    assert sorted(map(tuple, C.collocations(df, 2, 5, 100).collect())) == brute(rows_of(4), 2, 5, 100)


def test_no_rows(spark):
    assert C.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert C.collocations(spark.createDataFrame([(None, None), (" ", "en")], "text string, lang string")).count() == 0


def test_products_past_64_bits(spark):
    """The score's arithmetic is exact where products pass 64 bits."""
    big = 3 * 10**12 + 7
    got = spark.range(1).selectExpr(f"div(cast({big} * 1000 as decimal(19,0)) * cast({big + 1} as decimal(19,0)), cast({big} as decimal(19,0)) * cast(1234567 as decimal(19,0))) as s").first()["s"]
    assert got == big * 1000 * (big + 1) // (big * 1234567)

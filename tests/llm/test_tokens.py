"""Token counts, piece tables and packing against the libraries."""

import hashlib
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from fixtures import documents, empty
from pyspark.sql import functions as F

from siltstone.llm import packing as K
from siltstone.llm import pieces as P
from siltstone.llm import token_counts as T
from siltstone.llm import vocab


@pytest.fixture(scope="module")
def library():
    return vocab.word_vocabulary(vocab.default_path("word_bpe_49k.json")).library


def encoded(library, texts):
    return [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_budget(spark, library):
    df = documents(spark)
    rows = {r["doc_id"]: r["text"] or "" for r in df.collect()}
    want = dict(zip(rows, encoded(library, list(rows.values())), strict=True))
    for r in T.token_budget(df, 40).collect():
        t, n = rows[r["doc_id"]], len(want[r["doc_id"]])
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 40)
        assert len(encoded(library, [t[: r["cut_chars"]]])[0]) <= 40
    assert T.token_budget(empty(spark)).count() == 0


def test_every_prefix(spark, library):
    texts = ["it's they've 're \n\tx", "É́ naïve 汉字", "a<|endoftext|>b <|end", "", None, "Straße!!'s 12a", "'re've"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in T.token_prefix_counts(df).collect():
        t = texts[r["doc_id"]] or ""
        assert r["prefix_counts"] == [len(x) for x in encoded(library, [t[:k] for k in range(len(t) + 1)])]
    counts = spark.createDataFrame([([0, 1, 1, 3, 2],)], "c array<int>")
    row = counts.select(T.tokens_at(F.col("c"), 2).alias("a"), T.tokens_at(F.col("c"), 99).alias("b"), T.longest_within(F.col("c"), 2).alias("l")).first()
    assert tuple(row) == (1, 2, 4)


def test_words_of_the_tables(library):
    v = vocab.word_vocabulary(vocab.default_path("word_bpe_49k.json"))
    words = sorted({w for t in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist() for w in t.split()})
    want = encoded(library, words)
    assert [x.tolist() for x in v.word_ids(words)] == want
    assert [int(x[-1]) for x in v.prefix_counts(words)] == [len(x) for x in want]
    assert v.tokens_before(b"incomprehensibilities") == encoded(library, ["incomprehensibilities"])[0]


HARD = [*"a'srevlmt!<1 \x85\xa0\x1cÉß", "\u0301", "\u0323", "\u0344", "\u0345", "İ", "Σ", "“", "’", "漢", "字", "ก", "ิ", "่", "\u1100", "\u1161", "\u11a8", "각", "К", "й", "½", "Ⅷ", "🙂", "\u200d", "\u3000", "\u09c7", "\u09be", "K", "<|endoftext|>", "\u16d67", "\U0001d15e"]


def test_prefixes_of_odd_words(library):
    v = vocab.word_vocabulary(vocab.default_path("word_bpe_49k.json"))
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(HARD, size=rng.integers(1, 12))) for _ in range(1500)]
    words += ["don’t", "“It’s", "’re", "'r\u0301e", "'re\u0301", "a\u0323\u0301\u0323", "İ'll", "'L\u0327l"]
    for w in words:
        got, at = v.counts_of_odd(w), 0
        for k, c in enumerate(w):
            at += len(c.encode())
            assert got[at - 1] == len(library.encode(w[: k + 1], add_special_tokens=False).ids), (w, k)


@pytest.mark.parametrize("letters", ["漢字文書処理一二三、。", "กิ่นป้าไทยที่", "e\u0301", "\u0301", "Привет—"])
def test_long_word_without_blanks(library, monkeypatch, letters):
    class Few:
        """The library, which refuses more text than a few times the word."""

        def __getattr__(self, name):
            return getattr(library, name)

        def encode_batch(self, texts, **how):
            assert sum(map(len, texts)) < 200_000
            return library.encode_batch(texts, **how)

    v = vocab.word_vocabulary(vocab.default_path("word_bpe_49k.json"))
    monkeypatch.setattr(v, "library", Few())
    rng = np.random.default_rng(6)
    word = letters * (50_000 // len(letters)) if len(letters) < 3 else "".join(rng.choice(list(letters), size=50_000))
    got = v.new_counts([word])[0]
    assert len(got) == len(word.encode())
    for k in [1, 2, 3, 999, 2000, *rng.integers(1, 50_000, size=5).tolist(), len(word)]:
        assert got[len(word[:k].encode()) - 1] == len(library.encode(word[:k], add_special_tokens=False).ids)


def test_pieces(spark):
    model = P.piece_table(vocab.default_path(P.MODEL)).model
    df = documents(spark)
    rows = {r["doc_id"]: r["text"] or "" for r in df.collect()}
    out = P.piece_digests(df, with_ids=True).collect()
    assert len(out) == len(rows)
    for r in out:
        ids = model.encode(rows[r["doc_id"]])
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == model.decode(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(model.decode(ids).encode()).hexdigest()
    assert P.piece_digests(empty(spark)).count() == 0


def test_packing(spark, library):
    df = documents(spark)
    rows = {r["doc_id"]: r["text"] or "" for r in df.collect()}
    want = {}
    for d, ids in zip(rows, encoded(library, list(rows.values())), strict=True):
        ids = np.array([*ids, 0], dtype="<u4")
        for k in range(0, len(ids), 64):
            want[d, k // 64] = (k, min(64, len(ids) - k), zlib.crc32(ids[k : k + 64].tobytes()))
    out = K.pack_documents(df, 64).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in out} == want and len(out) == len(want)
    sequences = {}
    for r in sorted(out, key=lambda r: r["offset"]):
        assert r["offset"] == sequences.get(r["sequence_id"], 0)
        sequences[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(sequences.values()) <= 64
    assert len(sequences) <= -(-sum(v[1] for v in want.values()) // 64) + 2
    assert K.pack_documents(empty(spark), 64).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_plan(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(rng.geometric(0.01 * (seed + 1), size=3000), 256)
    h = np.bincount(lengths, minlength=257)
    plan = K.plan_for(h, 256)
    used = np.zeros(plan.sequences, dtype=np.int64)
    slots = {}
    for n, runs in plan.runs.items():
        ends = [r[0] for r in runs[1:]] + [plan.given[n]]
        assert plan.given[n] == h[n]
        for (first, base, offset), end in zip(runs, ends, strict=True):
            for k in range(end - first):
                slots.setdefault(base + k, []).append((offset, n))
    for s, pieces in slots.items():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        used[s] = at
    assert (used > 0).all() and used.max() <= 256
    assert plan.sequences <= -(-int((h * np.arange(257)).sum()) // 256) * 1.02 + 1

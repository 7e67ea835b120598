"""Phrases whose words keep company, by language.

Texts are coded into shards. Each shard's suffix automaton counts its words and pairs;
hashed counts of all shards, added up in buckets, tell each shard which of its words and
pairs can be frequent enough. A deeper automaton over those alone gives longer phrases
with their counts, which are added up by phrase, so all counts that matter are exact
and nothing with a rare word or pair travels as text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm._blocks import as_list, blocks, gather, mix, parts_for, quoted, release, text_bytes, texts_of, word_hashes, written
from siltstone.llm.automaton import SuffixAutomaton

#: What ends a piece of text; no phrase goes over it.
PIECE_ENDS = r"[.,;:!?\x0A-\x0D]"
#: Words of a shard, about.
SHARD_WORDS = 1 << 20
#: Bytes of text whose counts a bucket takes, about.
BUCKET_TEXT = 24 << 20
#: Salts of the first of two rankings.
SALTS = 64
TOKENS = "shard long, lang string, n_words long, words binary, codes binary"


def pieces(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes of the words of all texts one after the other, -1 after each piece, and the distinct words."""
    marked = pc.replace_substring_regex(pc.ascii_lower(texts_of(column)), PIECE_ENDS, " . ")  # no word holds a full stop
    flat, _ = as_list(pc.ascii_split_whitespace(pc.binary_join_element_wise(marked, ".", " ")))
    coded = flat.dictionary_encode()
    codes, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    real = pc.invert(pc.is_in(words, pa.array(["", "."]))).to_numpy(zero_copy_only=False)
    new = np.where(real, np.cumsum(real) - 1, -1)
    if len(words) and (blank := pc.index(words, "").as_py()) >= 0:
        codes = codes[codes != blank]
    return new[codes].astype(np.int32), words.filter(pa.array(real))


def coded(df: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """Written shards (shard, lang, n_words, words, codes): the words of a language in a task's texts, coded and compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, held, n, made = zstandard.ZstdCompressor(level=1), {}, 0, TaskContext.get().partitionId() << 32

        def shards() -> Iterator[pa.RecordBatch]:
            nonlocal made
            for lang, (known, parts) in held.items():
                codes = np.concatenate(parts)
                row = (made, lang, int((codes >= 0).sum()), packer.compress("\n".join(known).encode()), packer.compress(codes.tobytes()))
                made += 1
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["shard", "lang", "n_words", "words", "codes"])

        for block in blocks(batches):
            langs = block.column(1)
            for lang in langs.unique().to_pylist():
                codes, words = pieces(block.column(0).filter(pc.equal(langs, lang)))
                known, parts = held.setdefault(lang, ({}, []))
                new = np.fromiter((known.setdefault(w, len(known)) for w in words.to_pylist()), dtype=np.int32, count=len(words))
                parts.append(np.append(new, np.int32(-1))[codes])
                n += len(codes)
            if n >= SHARD_WORDS:
                yield from shards()
                held, n = {}, 0
        yield from shards()

    rows = df.select(F.col(quoted(text_col)).alias("text"), F.coalesce(F.col(quoted(lang_col)).cast("string"), F.lit("und")).alias("lang"))
    return written(rows.mapInArrow(run, TOKENS))


def opened(words: bytes, codes: bytes) -> tuple[list[str], np.ndarray]:
    """The distinct words and the codes of a shard."""
    opener = zstandard.ZstdDecompressor()
    text = opener.decompress(words).decode()
    return text.split("\n") if text else [], np.frombuffer(opener.decompress(codes), dtype=np.int32)


def keys_of(words: list[str], lang: str, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hashes of the words and then of the pairs of a language."""
    own = mix(word_hashes(pa.array(words, pa.string())) + word_hashes(pa.array([lang]), seed=1))
    return np.concatenate((own, mix(own[first] * np.uint64(0x9E3779B97F4A7C15) + own[second])))


def by_bucket(keys: np.ndarray, n_buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """The places of the keys of each bucket."""
    bucket = (keys % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.concatenate(([True], np.diff(bucket[order]) != 0, [True]))) if len(keys) else np.zeros(1, dtype=np.int64)
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        yield int(bucket[order[low]]), order[low:high]


def promising(shards: DataFrame, n_buckets: int, min_count: int) -> DataFrame:
    """(shard, bucket, alive): bits that say which of a shard's words and pairs of a bucket have ``min_count`` occurrences in all shards.

    Counts are added up by hash, so a rare pair may pass for a frequent one, never the
    other way round. A shard sends each word and pair once, with a count that needs no
    more than ``min_count``; so no key is hot.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, codes = opened(row["words"], row["codes"])
                found = SuffixAutomaton(codes, len(words), 2)
                keys = keys_of(words, row["lang"], *found.pairs())
                counts = np.minimum(np.concatenate([x.count for x in found.levels]), min_count).astype("<u4")
                small = counts.astype("<u2") if min_count < 1 << 16 else counts
                rows = [(b, row["shard"], (keys[at] >> np.uint64(32)).astype("<u4").tobytes(), small[at].tobytes()) for b, at in by_bucket(keys, n_buckets)]
                del found, keys, counts, small
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64() if k < 2 else pa.binary()) for k in range(4)], names=["bucket", "shard", "keys", "counts"])
                del rows
                release()

    def add(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x, dtype="<u4") for x in table["keys"].to_pylist()]
        counts = np.frombuffer(b"".join(table["counts"].to_pylist()), dtype="<u2" if min_count < 1 << 16 else "<u4")
        _, number = np.unique(np.concatenate(keys), return_inverse=True)
        alive = (np.bincount(number, weights=counts) >= min_count)[number]
        ends = np.cumsum([len(k) for k in keys])
        bits = [np.packbits(alive[end - len(k) : end]).tobytes() for k, end in zip(keys, ends, strict=True)]
        return pa.table([table["shard"].combine_chunks(), table["bucket"].combine_chunks(), pa.array(bits, pa.binary())], names=["shard", "bucket", "alive"])

    sent = shards.mapInArrow(send, "bucket long, shard long, keys binary, counts binary")
    return sent.groupBy("bucket").applyInArrow(add, "shard long, bucket long, alive binary")


def phrase_hashes(own: np.ndarray, codes: np.ndarray, end: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the phrases of ``length`` words that end at some places, from those of the words."""
    out = np.full(len(end), length, dtype=np.uint64)
    for k in range(length - 1, -1, -1):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + own[codes[end - k]])
    return out


def substrings(found: SuffixAutomaton, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, ends, counts) of the substrings that an automaton's states stand for."""
    states = list(found.states())
    for k in range(1, longest + 1):
        own = [(end[least <= k], count[least <= k]) for length, end, least, count in states if length >= k]
        yield k, np.concatenate([e for e, _ in own]), np.concatenate([c for _, c in own])


def counted(shards: DataFrame, alive: DataFrame, n_buckets: int, min_count: int, longest: int) -> DataFrame:
    """(lang, phrase, length, f): the phrases of at least ``min_count`` occurrences in all shards.

    A shard's automaton over promising words and pairs gives its phrases and counts, which
    travel packed by bucket, a phrase once for each shard, and are added up there.
    """

    def grow(shard: pa.Table, bits: pa.Table) -> pa.Table:
        rows, packer = [], zstandard.ZstdCompressor(level=1)
        for row in shard.to_pylist():
            words, codes = opened(row["words"], row["codes"])
            keys = keys_of(words, row["lang"], *SuffixAutomaton(codes, len(words), 2).pairs())
            told = {r["bucket"]: r["alive"] for r in bits.to_pylist()}
            good = np.zeros(len(keys), dtype=bool)
            for b, at in by_bucket(keys, n_buckets):
                good[at] = np.unpackbits(np.frombuffer(told[b], dtype=np.uint8), count=len(at)).astype(bool)
            own, names = keys[: len(words)], pa.array(words, pa.string())
            for length, end, count in substrings(SuffixAutomaton(codes, len(words), longest, (good[: len(words)], good[len(words) :])), longest):
                flat = names.take(pa.array(codes[gather(end - length + 1, np.full(len(end), length))]))
                phrases = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.arange(len(end) + 1) * length, pa.int32()), flat), " ")
                for b, at in by_bucket(phrase_hashes(own, codes, end, length), n_buckets):
                    rows.append((b, row["lang"], length, packer.compress("\n".join(phrases.take(pa.array(at)).to_pylist()).encode()), packer.compress(count[at].astype("<i8").tobytes())))
        release()
        types = (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary())
        return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["bucket", "lang", "length", "phrases", "counts"])

    def add(table: pa.Table) -> pa.Table:
        opener, parts = zstandard.ZstdDecompressor(), []
        for row in table.to_pylist():
            phrases = pa.array(opener.decompress(row["phrases"]).decode().split("\n"), pa.string())
            counts = pa.array(np.frombuffer(opener.decompress(row["counts"]), dtype="<i8"))
            parts.append(pa.table({"lang": pa.array([row["lang"]] * len(phrases), pa.string()).dictionary_encode(), "phrase": phrases, "length": pa.array(np.full(len(phrases), row["length"])), "f": counts}))
        whole = pa.concat_tables(parts).unify_dictionaries().group_by(["lang", "phrase", "length"]).aggregate([("f", "sum")])
        whole = whole.filter(pc.greater_equal(whole["f_sum"], min_count))
        release()
        return pa.table({"lang": whole["lang"].cast(pa.string()), "phrase": whole["phrase"], "length": whole["length"], "f": whole["f_sum"]})

    packed = shards.groupBy("shard").cogroup(alive.groupBy("shard")).applyInArrow(grow, "bucket long, lang string, length long, phrases binary, counts binary")
    return packed.groupBy("bucket").applyInArrow(add, "lang string, phrase string, length long, f long")


def part(words: Column, start: Column | int, length: Column | int) -> Column:
    """Some of the words of a phrase, as a phrase; the first word is 1."""
    return F.array_join(F.slice(words, start, length), " ")


def phrase_counts(df: DataFrame, min_count: int = 100, longest: int = 5, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, length, f) of all phrases of up to ``longest`` words with at least ``min_count`` occurrences, and (lang, n), the words of each language. Both are written."""
    shards = coded(df, text_col, lang_col)
    n_buckets = max(2 * parts_for(df.sparkSession), text_bytes(df.select(F.col(quoted(text_col)).alias("text"))) // BUCKET_TEXT + 1)
    counts = counted(shards, promising(shards, n_buckets, min_count), n_buckets, min_count, max(2, longest)).filter(F.col("length") <= longest)
    return written(counts), written(shards.groupBy("lang").agg(F.sum("n_words").alias("n")))


def collocations(df: DataFrame, min_count: int = 100, longest: int = 5, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language.

    Texts are lower-cased (A-Z) and split at ``[.,;:!?\\x0A-\\x0D]`` into pieces, those at
    blanks and tabs into words. Candidates are phrases of 2 to ``longest`` words that
    occur ``a`` >= ``min_count`` times within pieces. Of the cuts of a candidate into two
    parts with l and r occurrences, that with the least floor(1000 * a * n / (l * r))
    counts, of equal ones the first; n are all words of the language. A candidate within
    a longer one of as many occurrences is left out: such a one has a phrase one word
    longer, at its start or end, in the same end or start class, so it is enough to pass
    each candidate's count on to its suffix link and its prefix. Ties of score go by a, then
    phrase by UTF-8 bytes. Null and empty texts have no words, a null language is
    ``und``; repeated rows count as often as they are there; ids and other columns don't
    matter, whatever their names. No rows give none.
    """
    counts, totals = phrase_counts(df, min_count, longest, text_col, lang_col)
    words = F.split("phrase", " ")
    candidates = counts.filter(F.col("length") > 1).select("lang", "phrase", "length", F.col("f").alias("a"))
    shorter = F.array(part(words, 2, F.col("length") - 1), part(words, 1, F.col("length") - 1))
    inside = candidates.filter(F.col("length") > 2).select("lang", F.explode(shorter).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = candidates.join(inside, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("longer") < F.col("a"))).drop("longer")
    cuts = left.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("length") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", part(words, 1, F.col("k")).alias("head"), part(words, F.col("k") + 1, F.col("length") - F.col("k")).alias("tail"))
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"]).join(totals, "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.expr("div(_over, _under)").cast("long")
    cuts = cuts.withColumn("_over", (F.col("a") * 1000).cast("decimal(19,0)") * wide("n")).withColumn("_under", wide("l") * wide("r")).withColumn("score", score)
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("s")).select("lang", "phrase", "a", "n", "s.score", "s.l", "s.r")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    best = best.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    best = best.withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).filter(F.col("_r") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language of documents."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents
), p AS (SELECT doc, lang, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS at_piece FROM d
), w AS (SELECT doc, lang, at_piece, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS words FROM p
), t AS (SELECT lang, sum(len(words))::BIGINT AS n FROM w GROUP BY lang
), g AS (
  SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS st FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(words) >= k
), c AS (SELECT lang, array_to_string(words[st:st + k - 1], ' ') AS phrase, k, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100
), b AS (SELECT lang, phrase, string_split(phrase, ' ') AS words, k, f AS a FROM c WHERE k >= 2
), x AS (
  SELECT lang, array_to_string(words[st:st + j - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, words, a, k, j, unnest(range(1, k - j + 2)) AS st FROM b, (SELECT unnest([2, 3, 4]) AS j) WHERE j < k) GROUP BY ALL
), o AS (SELECT b.* FROM b LEFT JOIN x ON b.lang = x.lang AND b.phrase = x.phrase WHERE longer IS NULL OR 100 * longer < 100 * a
), s AS (
  SELECT o.lang, o.phrase, o.a, cut, l.f AS l, r.f AS r, n, ((1000::HUGEINT * o.a * n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM o) o JOIN t ON o.lang = t.lang
  JOIN c l ON l.lang = o.lang AND l.phrase = array_to_string(o.words[1:cut], ' ') JOIN c r ON r.lang = o.lang AND r.phrase = array_to_string(o.words[cut + 1:o.k], ' ')
), m AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS nth FROM s
), q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM m WHERE nth = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM q WHERE rank <= 2000
"""

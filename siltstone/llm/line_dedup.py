"""Line deduplication with a sharded minimal perfect hash over distinct line hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm._blocks import BLOCK_BYTES, as_list, blocks, ddl, fields, mix, parts_for, plain, quoted, row_of, text_bytes, texts_of, written

#: Characters stripped at both ends of a line for its key.
BLANK = " \t\n\v\f\r"
#: Keys that a shard holds, about.
SHARD_KEYS = 16_384
#: Text bytes of a line, about; only for the number of shards.
LINE_BYTES = 64
#: Bits per key and level of the hash, and its most levels; keys left after those are listed.
SPREAD, LEVELS = 2, 24


def line_keys(column: pa.Array, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Lines of each text: (key codes, row edges, hashes, lines).

    ``hashes[code]`` are the two 64-bit halves of the key's hash; (0, 0) stands for
    keys of fewer than ``min_chars`` code points, which never repeat.
    """
    from xxhash import xxh3_128_intdigest

    texts = texts_of(column)
    lines, edges = as_list(pc.split_pattern(texts, "\n"))
    coded = pc.ascii_lower(pc.ascii_trim(lines, characters=BLANK)).dictionary_encode()
    keys = coded.dictionary
    long = pc.greater_equal(pc.utf8_length(keys), min_chars).to_numpy(zero_copy_only=False)
    hashes = np.zeros((len(keys), 2), dtype=np.uint64)
    for i, key in zip(np.flatnonzero(long), keys.filter(pa.array(long)).cast(pa.binary()).to_pylist(), strict=True):
        h = xxh3_128_intdigest(key)
        hashes[i] = h >> 64 or 1, h & 0xFFFFFFFFFFFFFFFF
    return coded.indices.to_numpy(zero_copy_only=False), edges, hashes, lines


class PerfectHash:
    """A minimal perfect hash of distinct 128-bit keys: levels of bit arrays and the ranks of their bits."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray, rest: np.ndarray):
        self.sizes, self.words, self.rest = sizes, words, rest
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))

    @staticmethod
    def places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        """Bit of each key within a level."""
        return (mix(keys[:, 0] + np.uint64(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) + (keys[:, 1] << np.uint64(1))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """Keys alone on their bit of a level stay there; the others go on to the next."""
        sizes, bits, left = [], [], keys
        while len(left) and len(sizes) < LEVELS:
            size = -(-max(64, SPREAD * len(left)) // 64) * 64
            at = cls.places(left, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(alone)
            left = left[~alone[at]]
        packed = np.packbits(np.concatenate(bits), bitorder="little").view("<u8") if bits else np.empty(0, dtype="<u8")
        return cls(np.array(sizes, dtype=np.int64), packed, left[np.lexsort((left[:, 1], left[:, 0]))])

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for some keys that aren't in the set; others of those get a slot of another key."""
        out = np.full(len(keys), -1, dtype=np.int64)
        todo, start = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = start + self.places(keys[todo], level, int(size))
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = (self.words[word] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(self.words[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[todo[hit]] = self.before[word[hit]] + below
            todo = todo[~hit]
            start += int(size)
            if not len(todo):
                break
        listed = {(int(a), int(b)): self.before[-1] + i for i, (a, b) in enumerate(self.rest)}
        for i in todo if listed else ():
            out[i] = listed.get((int(keys[i, 0]), int(keys[i, 1])), -1)
        return out

    def dump(self) -> bytes:
        """As bytes."""
        head = np.array([len(self.sizes), len(self.words), len(self.rest)], dtype="<i8")
        return head.tobytes() + self.sizes.astype("<i8").tobytes() + self.words.astype("<u8").tobytes() + self.rest.astype("<u8").tobytes()

    @classmethod
    def load(cls, raw: bytes) -> PerfectHash:
        """From bytes."""
        n, w, r = np.frombuffer(raw, dtype="<i8", count=3)
        sizes = np.frombuffer(raw, dtype="<i8", count=n, offset=24)
        words = np.frombuffer(raw, dtype="<u8", count=w, offset=24 + 8 * n)
        return cls(sizes, words, np.frombuffer(raw, dtype="<u8", count=2 * r, offset=24 + 8 * (n + w)).reshape(r, 2))


def _per_shard(shards: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(shards, kind="stable")
    edges = np.flatnonzero(np.concatenate(([True], np.diff(shards[order]) != 0, [True]))) if len(shards) else np.array([0])
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        yield int(shards[order[low]]), order[low:high]


def _doc_keys(block: pa.RecordBatch, min_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """Each (doc_id, key) of a block once: ids and hashes. Rows without an id have none."""
    codes, edges, hashes, _ = line_keys(block.column(1), min_chars)
    rows = row_of(edges)
    use = (hashes[codes, 0] != 0) & block.column(0).is_valid().to_numpy(zero_copy_only=False)[rows]
    ids = pc.fill_null(block.column(0), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    pairs = np.unique(rows[use] * np.int64(len(hashes)) + codes[use])
    return ids[pairs // len(hashes)], hashes[pairs % len(hashes)]


def line_index(df: DataFrame, min_chars: int = 10, n_shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The sharded index of all distinct line keys of at least ``min_chars`` code points.

    One row per shard: (shard, n_keys, load, hash, prints, counts, firsts): the perfect
    hash and, by its slots, 32-bit fingerprints, documents counted for the key, and
    the smallest id holding it. Each task counts its keys before they travel.
    """
    n_shards = n_shards or shards_for(df, text_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, limit=BLOCK_BYTES):
            ids, hashes = _doc_keys(block, min_chars)
            order = np.lexsort((ids, hashes[:, 1], hashes[:, 0]))
            ids, hashes = ids[order], hashes[order]
            first = np.flatnonzero(np.concatenate(([True], (hashes[1:] != hashes[:-1]).any(axis=1)))) if len(ids) else np.empty(0, dtype=np.int64)
            counts = np.diff(np.append(first, len(ids)))
            hashes, ids = hashes[first], ids[first]
            rows = [(s, hashes[at].tobytes(), counts[at].astype("<i8").tobytes(), ids[at].astype("<i8").tobytes()) for s, at in _per_shard((hashes[:, 1] % np.uint64(n_shards)).astype(np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64() if k == 0 else pa.binary()) for k in range(4)], names=["shard", "keys", "counts", "firsts"])

    def build(table: pa.Table) -> pa.Table:
        keys = np.frombuffer(b"".join(table["keys"].to_pylist()), dtype=np.uint64).reshape(-1, 2)
        counts = np.frombuffer(b"".join(table["counts"].to_pylist()), dtype="<i8")
        firsts = np.frombuffer(b"".join(table["firsts"].to_pylist()), dtype="<i8")
        order = np.lexsort((firsts, keys[:, 1], keys[:, 0]))
        keys, counts, firsts = keys[order], counts[order], firsts[order]
        start = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1))))
        keys, counts, firsts = keys[start], np.add.reduceat(counts, start), firsts[start]
        table_hash = PerfectHash.build(keys)
        slot = table_hash.slots(keys)
        prints, by_slot, first = np.empty(len(keys), dtype="<u4"), np.empty(len(keys), dtype="<u4"), np.empty(len(keys), dtype="<i8")
        prints[slot], by_slot[slot], first[slot] = fingerprint(keys), np.minimum(counts, 0xFFFFFFFF), firsts
        shard = table["shard"][0].as_py()
        row = [[shard], [len(keys)], [int(counts.sum())], [table_hash.dump()], [prints.tobytes()], [by_slot.tobytes()], [first.tobytes()]]
        return pa.table(row, names=["shard", "n_keys", "load", "hash", "prints", "counts", "firsts"])

    counted = df.select(F.col(quoted(id_col)), F.col(quoted(text_col)).alias("text")).mapInArrow(count, "shard long, keys binary, counts binary, firsts binary")
    return counted.groupBy("shard").applyInArrow(build, "shard long, n_keys long, load long, hash binary, prints binary, counts binary, firsts binary")


def fingerprint(keys: np.ndarray) -> np.ndarray:
    """32 bits that tell a key from others on its slot."""
    return (mix(keys[:, 1] ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(32)).astype(np.uint32)


def shards_for(df: DataFrame, text_col: str = "text") -> int:
    """Shards by the size of the texts, so that one stays small at any size."""
    return max(2 * parts_for(df.sparkSession), text_bytes(df, text_col) // LINE_BYTES // SHARD_KEYS + 1)


def repeated_keys(df: DataFrame, index: DataFrame, n_shards: int, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, key): the keys of each document that an earlier document holds, from probes of the index arrays.

    Probes travel by shard, packed. Shards with more probes than a share of all (at
    most twice as many as partitions can be) are read by several groups of probes.
    """
    spark = df.sparkSession
    parts = parts_for(spark)
    total = index.agg(F.sum("load")).first()[0] or 0
    share = max(1, total // (2 * parts))
    hot = {r["shard"]: min(4 * parts, -(-r["load"] // share)) for r in index.filter(F.col("load") > share).select("shard", "load").collect()}

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, limit=BLOCK_BYTES):
            ids, hashes = _doc_keys(block, min_chars)
            rows = []
            for s, at in _per_shard((hashes[:, 1] % np.uint64(n_shards)).astype(np.int64)):
                copies = hot.get(s, 1)
                for salt, own in _per_shard((mix(ids[at].view(np.uint64)) % np.uint64(copies)).astype(np.int64)):
                    rows.append((s, salt, hashes[at[own]].tobytes(), ids[at[own]].astype("<i8").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64() if k < 2 else pa.binary()) for k in range(4)], names=["shard", "salt", "keys", "ids"])

    def answer(probes: pa.Table, shard: pa.Table) -> pa.Table:
        if not len(probes) or not len(shard):
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64())], names=["id", "key"])
        keys = np.frombuffer(b"".join(probes["keys"].to_pylist()), dtype=np.uint64).reshape(-1, 2)
        ids = np.frombuffer(b"".join(probes["ids"].to_pylist()), dtype="<i8")
        slot = PerfectHash.load(shard["hash"][0].as_py()).slots(keys)
        prints, counts, firsts = (np.frombuffer(shard[c][0].as_py(), dtype=t) for c, t in (("prints", "<u4"), ("counts", "<u4"), ("firsts", "<i8")))
        known = slot >= 0
        known[known] = prints[slot[known]] == fingerprint(keys[known])
        known[known] = (counts[slot[known]] > 1) & (firsts[slot[known]] < ids[known])
        return pa.table([pa.array(ids[known]), pa.array(keys[known, 0].view(np.int64))], names=["id", "key"])

    probes = df.select(F.col(quoted(id_col)), F.col(quoted(text_col)).alias("text")).mapInArrow(probe, "shard long, salt long, keys binary, ids binary")
    if hot:
        copies = spark.createDataFrame(list(hot.items()), "shard long, copies long")
        index = index.join(F.broadcast(copies), "shard", "left")  # at most twice the number of partitions
        index = index.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("copies", F.lit(1)) - 1))).drop("copies")
    else:
        index = index.withColumn("salt", F.lit(0).cast("long"))
    found = probes.groupBy("shard", "salt").cogroup(index.groupBy("shard", "salt")).applyInArrow(answer, "id long, key long")
    return found.select(F.col("id").alias(id_col), "key")


def line_dedup(df: DataFrame, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents without the lines that a document of smaller id holds too.

    A line's key is the line stripped of blanks at both ends with A-Z in lower case;
    keys of fewer than ``min_chars`` code points never count. Returns the columns of
    ``df`` (of those named n_lines, n_dropped or kept_text the results stand instead)
    with n_lines, n_dropped and kept_text. Null and empty texts are one empty line.
    Rows without an id keep all lines and lend none. Rows of one id are one document:
    none of its lines is dropped for another row of it. Empty tables give no rows. Other
    columns pass through, whatever their names.
    """
    names = fields(df, ("n_lines", "n_dropped", "kept_text"))
    rows, (id_, text) = plain(df, names, id_col, text_col)
    n_shards = shards_for(rows, text)
    index = written(line_index(rows, min_chars, n_shards, id_, text))
    repeated = repeated_keys(rows, index, n_shards, min_chars, id_, text)
    return drop_lines(rows, repeated, min_chars, id_, text).toDF(*names, "n_lines", "n_dropped", "kept_text")


def drop_lines(df: DataFrame, repeated: DataFrame, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """The lines of each document whose keys are among its repeated ones are dropped."""
    names = df.columns
    keys = repeated.groupBy(F.col(id_col).alias("_id")).agg(F.collect_set("key").alias("_keys"))
    joined = df.join(keys.hint("shuffle_hash"), F.col(id_col) == F.col("_id"), "left").select(*names, F.coalesce("_keys", F.array().cast("array<bigint>")).alias("_keys"))
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text_col, BLOCK_BYTES):
            codes, edges, hashes, lines = line_keys(block.column(at), min_chars)
            rows = row_of(edges)
            drop_keys, key_edges = as_list(block.column(len(names)))
            wanted = mix(drop_keys.to_numpy(zero_copy_only=False).view(np.uint64)) + row_of(key_edges).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            own = mix(hashes[codes, 0]) + rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            drop = np.isin(own, wanted) & (hashes[codes, 0] != 0)
            n_dropped = np.bincount(rows[drop], minlength=block.num_rows)
            kept_lines = lines.filter(pa.array(~drop))
            kept_edges = np.concatenate(([0], np.cumsum(np.bincount(rows[~drop], minlength=block.num_rows))))
            kept = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept_edges, pa.int32()), kept_lines), "\n")
            columns = [*block.columns[:-1], pa.array(np.diff(edges)), pa.array(n_dropped.astype(np.int64)), kept]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "n_lines", "n_dropped", "kept_text"])

    return joined.mapInArrow(run, f"{ddl(df, names)}, n_lines long, n_dropped long, kept_text string")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without lines of earlier documents, as digests."""
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), f AS (
  SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10 GROUP BY key
), d AS (
  SELECT k.*, coalesce(f.first_doc < k.doc_id, false) AS dropped FROM k LEFT JOIN f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""

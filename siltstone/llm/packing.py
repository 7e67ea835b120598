"""Packing of token pieces into sequences by length patterns fitted with non-negative least squares."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm._blocks import blocks, gather, parts_for, text_batches, word_codes, written
from siltstone.llm.vocab import default_path, word_vocabulary

VOCABULARY = "word_bpe_49k.json"
#: Text bytes encoded at once.
BLOCK = 20 << 20
#: The id that ends each document.
END_ID = 0
#: Patterns that the fit chooses from, at most.
MOST_PATTERNS = 60_000
#: Steps of the fit.
FIT_STEPS = 150


def token_pieces(df: DataFrame, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """The pieces of each document: (id_col, piece, start, length, ids_crc32).

    A document is its token ids and an end id; only documents of more than ``limit``
    ids are cut. Null and empty texts are the end id alone.
    """
    path = path or default_path(VOCABULARY)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = word_vocabulary(path)
        for block in blocks(batches, limit=BLOCK):
            codes, offsets, words = word_codes(block.column(1))
            words = words.to_pylist()
            tables = vocabulary.word_ids(words, np.bincount(codes, minlength=len(words))) if words else []
            sizes = np.fromiter(map(len, tables), dtype=np.int64, count=len(tables))
            starts = np.cumsum(sizes) - sizes
            flat = np.concatenate(tables).astype("<u4") if tables else np.empty(0, dtype="<u4")
            total = np.concatenate(([0], np.cumsum(sizes[codes])))[offsets]
            rows, pieces, begins, lengths, sums = [], [], [], [], []
            for r in range(block.num_rows):
                n = int(total[r + 1] - total[r]) + 1
                ids = np.full(n, END_ID, dtype="<u4")
                own = codes[offsets[r] : offsets[r + 1]]
                if len(own):
                    ids[:-1] = flat[gather(starts[own], sizes[own])]
                raw = ids.tobytes()
                for k, start in enumerate(range(0, n, limit)):
                    length = min(limit, n - start)
                    rows.append(r)
                    pieces.append(k)
                    begins.append(start)
                    lengths.append(length)
                    sums.append(zlib.crc32(raw[4 * start : 4 * (start + length)]))
            columns = [block.column(0).take(pa.array(rows, pa.int64())), pa.array(pieces, pa.int32()), pa.array(begins, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "piece", "start", "length", "ids_crc32"])

    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long"
    return df.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, schema)


class Plan:
    """Which sequences and offsets the pieces of each length take, as runs of ranks."""

    def __init__(self):
        self.runs: dict[int, list[tuple[int, int, int]]] = {}
        self.given: dict[int, int] = {}
        self.sequences = 0

    def put(self, length: int, n: int, sequence: int, offset: int) -> None:
        """The next n pieces of a length go to n sequences from ``sequence`` on."""
        rank = self.given.get(length, 0)
        self.runs.setdefault(length, []).append((rank, sequence, offset))
        self.given[length] = rank + n

    def new(self, n: int) -> int:
        """Numbers of n more sequences."""
        first = self.sequences
        self.sequences += n
        return first


def patterns_of(histogram: np.ndarray, limit: int) -> np.ndarray:
    """Patterns of two to four lengths that fill a sequence wholly, from the lengths that occur.

    Rows hold lengths from long to short, 0 where a pattern has fewer. Patterns whose
    rarest length is most frequent come first, MOST_PATTERNS at most.
    """
    have = np.flatnonzero(histogram[:limit]).astype(np.int64)
    if not len(have):
        return np.empty((0, 4), dtype=np.int64)
    often = histogram.astype(np.float64)
    found = []
    two = np.stack([have, limit - have], axis=1)
    found.append(two[(two[:, 0] >= two[:, 1])])
    # for more lengths, the frequent ones of each size class are enough
    some = np.sort(have[np.argsort(-often[have], kind="stable")][:320])
    a, b = (x.reshape(-1) for x in np.meshgrid(some, some, indexing="ij"))
    c = limit - a - b
    ok = (a >= b) & (b >= c) & (c > 0)
    found.append(np.stack([a[ok], b[ok], c[ok]], axis=1))
    few = np.sort(have[np.argsort(-often[have], kind="stable")][:60])
    a, b, c = (x.reshape(-1) for x in np.meshgrid(few, few, few, indexing="ij"))
    d = limit - a - b - c
    ok = (a >= b) & (b >= c) & (c >= d) & (d > 0)
    found.append(np.stack([a[ok], b[ok], c[ok], d[ok]], axis=1))
    found = [np.pad(x, ((0, 0), (0, 4 - x.shape[1]))) for x in found]
    out = np.concatenate(found)
    real = np.where(out > 0, histogram[out], np.iinfo(np.int64).max).min(axis=1)
    out, real = out[real > 0], real[real > 0]
    return out[np.argsort(-real, kind="stable")[:MOST_PATTERNS]]


def fitted(histogram: np.ndarray, patterns: np.ndarray) -> np.ndarray:
    """Repeat counts x >= 0 with patterns' lengths near the histogram in least squares, by multiplicative steps."""
    n = len(histogram)
    used = patterns > 0
    goal = histogram.astype(np.float64)
    goal[0] = 0
    upper = np.where(used, goal[patterns], 0).sum(axis=1)
    x = np.where(used, goal[patterns], np.inf).min(axis=1) / 8
    for _ in range(FIT_STEPS):
        made = np.bincount(patterns[used], weights=np.broadcast_to(x[:, None], patterns.shape)[used], minlength=n)
        lower = np.where(used, made[patterns], 0).sum(axis=1)
        x = x * upper / np.maximum(lower, 1e-12)
    return x


def best_fit(histogram: np.ndarray, limit: int, plan: Plan) -> None:
    """Best-fit decreasing of all pieces of a histogram, equal ones together."""
    room: dict[int, list[tuple[int, int]]] = {}  # free space: sequences as (first, n)
    spaces = np.zeros(limit + 1, dtype=bool)

    def free(space: int, first: int, n: int) -> None:
        if space:
            room.setdefault(space, []).append((first, n))
            spaces[space] = True

    for length in range(limit, 0, -1):
        left = int(histogram[length])
        while left:
            fits = np.flatnonzero(spaces[length:])
            if len(fits):
                space = int(fits[0]) + length
                first, n = room[space].pop()
                if not room[space]:
                    spaces[space] = False
            else:
                per = limit // length
                space, n = limit, -(-left // per)
                first = plan.new(n)
            take = min(n, left)
            plan.put(length, take, first, limit - space)
            left -= take
            free(space - length, first, take)
            if take < n:
                free(space, first + take, n - take)


def plan_for(histogram: np.ndarray, limit: int) -> Plan:
    """The packing plan of a length histogram: patterns with fitted and rounded repeat counts, then the rest by best fit.

    The size of the work depends on ``limit`` alone, not on the number of pieces.
    Fitted counts are scaled down step by step where long pieces would lack short ones
    to fill up with, and the plan with the fewest sequences stays.
    """
    best = None
    patterns = patterns_of(histogram, limit)
    x = fitted(histogram, patterns) if len(patterns) else np.empty(0)
    for share in (1.0, 0.9, 0.75, 0.5):
        plan, rest = Plan(), histogram.copy()
        repeats = np.floor(x * share).astype(np.int64)
        for i in np.argsort(-repeats, kind="stable"):
            if repeats[i] <= 0:
                break
            lengths, times = np.unique(patterns[i][patterns[i] > 0], return_counts=True)
            n = int(min(repeats[i], (rest[lengths] // times).min()))
            if n <= 0:
                continue
            first, offset = plan.new(n), 0
            for length in patterns[i][patterns[i] > 0].tolist():
                plan.put(length, n, first, offset)
                offset += length
                rest[length] -= n
        best_fit(rest, limit, plan)
        if best is None or plan.sequences < best.sequences:
            best = plan
    return best


def pack(pieces: DataFrame, limit: int = 2048, id_col: str = "doc_id") -> DataFrame:
    """Each piece with its sequence_id and offset; sequences hold at most ``limit`` tokens and have no gaps.

    ``pieces`` has (id_col, piece, length) and may have more columns; it should be a
    stored table, as it is read more than once. Only the histogram (at most ``limit``
    counts) reaches the driver, and the plan that goes to the tasks is bounded by
    ``limit`` as well. Ranks within a length come from counts of (length, bucket), so a
    length that a third of all pieces share is no single task's work. The fit chooses from at
    most MOST_PATTERNS patterns; pieces that its patterns leave are packed all the same.
    """
    spark = pieces.sparkSession
    counted = pieces.groupBy("length").count().collect()
    if not counted:
        return pieces.withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")})
    histogram = np.zeros(limit + 1, dtype=np.int64)
    for r in counted:
        histogram[r["length"]] += r["count"]
    plan = plan_for(histogram, limit)
    tables = {n: tuple(np.array(x, dtype=np.int64) for x in zip(*runs, strict=True)) for n, runs in plan.runs.items()}
    n_buckets = max(64, 8 * parts_for(spark))
    names = [c for c in pieces.columns if c not in ("_bucket", "_before", "_rank")]
    p = pieces.select(*names).withColumn("_bucket", F.pmod(F.xxhash64(id_col), F.lit(n_buckets)))
    so_far = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = p.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = before.select("length", "_bucket", F.coalesce(F.sum("_n").over(so_far), F.lit(0)).alias("_before"))
    in_bucket = Window.partitionBy("length", "_bucket").orderBy(id_col, "piece")
    ranked = p.join(before, ["length", "_bucket"]).withColumn("_rank", F.col("_before") + F.row_number().over(in_bucket) - 1)
    out = ranked.select(*names, F.col("_rank").cast("long").alias("_rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.empty(len(rank), dtype=np.int64), np.empty(len(rank), dtype=np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                first, base, start = tables[int(n)]
                run = np.searchsorted(first, rank[at], side="right") - 1
                sequence[at] = base[run] + rank[at] - first[run]
                offset[at] = start[run]
            columns = [batch.column(c) for c in names] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in names)
    return out.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Documents cut into pieces and packed: (id_col, piece, start, length, ids_crc32, sequence_id, offset).

    The pieces, a few numbers each, are written to the shared folder first, so texts
    are segmented once. An empty table gives no rows; repeated rows are packed each.
    """
    with text_batches(docs.sparkSession, 5000):
        pieces = written(token_pieces(docs, limit, id_col, text_col, path))
    return pack(pieces, limit, id_col)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))

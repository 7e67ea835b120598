"""Exact removal of repeated word windows by super-k-mer partitioning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm._blocks import as_list, blocks, ddl, fields, gather, mix, opened, parts_for, plain, quoted, release, row_of, squeezed, text_bytes, word_codes, word_hashes

#: Words of the grams that minimisers are taken from.
GRAM = 5
#: Bytes of packed super-k-mers in a bucket, about. Packing makes about three bytes of one.
BUCKET_BYTES, PACKED = 6 << 20, 3
#: Text bytes of one block.
BLOCK = 6 << 20
#: A gram is heavy if its share of all grams is over 1 / (HEAVY * partitions); so at most HEAVY * partitions are.
HEAVY = 32
HIGH = np.uint64(1 << 63)


def grams_of(hashes: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each run of ``gram`` words, by its first word's position; they also run over row ends."""
    n = len(hashes) - gram + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(gram):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    return mix(out) & ~HIGH


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def window_hashes(hashes: np.ndarray, window: int) -> np.ndarray:
    """A 64-bit hash of each run of ``window`` words."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(window):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + n]
    return mix(out)


def range_hashes(hashes: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range of words, from running sums."""
    base, inverse = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
    n = len(hashes)
    up = np.cumprod(np.concatenate(([1], np.full(n, base, dtype=np.uint64))).astype(np.uint64), dtype=np.uint64)
    down = np.cumprod(np.concatenate(([1], np.full(n, inverse, dtype=np.uint64))).astype(np.uint64), dtype=np.uint64)
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(hashes * up[:n], dtype=np.uint64)))
    return mix((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64))


def valid_starts(offsets: np.ndarray, length: int) -> np.ndarray:
    """Positions where a run of ``length`` words lies in one row."""
    counts = np.maximum(np.diff(offsets) - length + 1, 0)
    return gather(offsets[:-1], counts)


def heavy_grams(df: DataFrame, window: int, gram: int, text_col: str) -> np.ndarray:
    """The grams that hold over 1 / (HEAVY * partitions) of all, sorted.

    Each task reports only grams with that share of its own, and no more than
    HEAVY * partitions can have it among all, which bounds what the driver gets. The
    list only routes windows; no result depends on it.
    """
    most = HEAVY * parts_for(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, limit=BLOCK):
            codes, offsets, words = word_codes(block.column(0))
            h = grams_of(word_hashes(words)[codes], gram)[valid_starts(offsets, gram)] if len(codes) else np.empty(0, dtype=np.uint64)
            h.sort()
            edges = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1], [True]))) if len(h) else np.array([0])
            times = np.diff(edges)
            often = times >= max(2, len(h) // (2 * most))
            grams, times = h[edges[:-1][often]].view(np.int64), times[often]
            grams, times = np.append(grams, -1), np.append(times, len(h))  # -1: all of them
            yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(times)], names=["gram", "n"])

    found = df.select(F.col(text_col).alias("text")).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    found = found.filter(f"gram = -1 OR n >= {2}").orderBy(F.desc("n")).limit(most + 1).collect()
    total = max((r["n"] for r in found if r["gram"] == -1), default=0)
    return np.sort(np.array([r["gram"] for r in found if r["gram"] != -1 and r["n"] * most >= total], dtype=np.int64).view(np.uint64))


def demoted(grams: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """The order of grams by hash, with heavy ones after all others."""
    if not len(heavy):
        return grams
    bits = np.zeros(1 << 16, dtype=bool)
    bits[(heavy & np.uint64(0xFFFF)).astype(np.int64)] = True
    at = np.flatnonzero(bits[(grams & np.uint64(0xFFFF)).astype(np.int64)])
    found = np.searchsorted(heavy, grams[at])
    found[found == len(heavy)] = 0
    grams[at[heavy[found] == grams[at]]] |= HIGH
    return grams


def packed(ids: np.ndarray, starts: np.ndarray, counts: np.ndarray, sizes: np.ndarray, text: bytes) -> bytes:
    """Super-k-mers of one bucket as one compressed string."""
    head = np.array([len(ids)], dtype="<i8").tobytes()
    body = (np.diff(ids, prepend=0).astype("<i8"), starts.astype("<i4"), counts.astype("<i4"), sizes.astype("<i4"))
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(x.tobytes() for x in body) + text)


def unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """What packed() took."""
    raw = zstandard.ZstdDecompressor().decompress(raw)
    n = int(np.frombuffer(raw, dtype="<i8", count=1)[0])
    ids = np.cumsum(np.frombuffer(raw, dtype="<i8", count=n, offset=8))
    at = 8 + 8 * n
    starts, counts, sizes = (np.frombuffer(raw, dtype="<i4", count=n, offset=at + 4 * n * k).astype(np.int64) for k in range(3))
    return ids, starts, counts, sizes, raw[at + 12 * n :]


def equal_spans(raw: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether bytes from a and from b on are the same, for each pair, a few megabytes at a time."""
    out = np.empty(len(a), dtype=bool)
    ends = np.cumsum(sizes)
    low = 0
    while low < len(a):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + (4 << 20), side="right")))
        n = sizes[low:high]
        same = raw[gather(a[low:high], n)] == raw[gather(b[low:high], n)]
        out[low:high] = np.add.reduceat(same, np.cumsum(n) - n) == n
        low = high
    return out


def super_kmers(block: pa.RecordBatch, window: int, gram: int, heavy: np.ndarray, n_buckets: int) -> Iterator[tuple[int, bytes | None, bytes | None]]:
    """(bucket, packed super-k-mers, known repeats) of a block.

    Runs of windows with one minimiser go to its bucket, each distinct run once a
    block: the first of equal runs travels, the later ones are repeats already.
    """
    ids = block.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
    codes, offsets, words = word_codes(block.column(1))
    first = valid_starts(offsets, window)
    if not len(first):
        return
    hashes = word_hashes(words)[codes]
    least = sliding_min(demoted(grams_of(hashes, gram), heavy), window - gram + 1)[first]
    rows = np.searchsorted(offsets, first, side="right") - 1
    new = np.concatenate(([True], (least[1:] != least[:-1]) | (rows[1:] != rows[:-1])))
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(first)))
    begin, key, doc = first[at], least[at], ids[rows[at]]
    stop = begin + counts + window - 1
    start = begin - offsets[rows[at]]
    spaced = pc.binary_join_element_wise(words.cast(pa.binary()), pa.scalar(b" "), pa.scalar(b"")).cast(pa.binary()).take(pa.array(codes))
    edges = spaced.offsets.to_numpy() if hasattr(spaced, "offsets") else np.frombuffer(spaced.buffers()[1], dtype=np.int32)[: len(codes) + 1]
    edges = edges.astype(np.int64)
    raw = np.frombuffer(spaced.buffers()[2], dtype=np.uint8)
    low, size = edges[begin], edges[stop] - edges[begin]
    content = range_hashes(hashes, begin, stop)
    order = np.lexsort((start, doc, content))
    same = content[order][1:] == content[order][:-1]
    lead = np.maximum.accumulate(np.where(np.concatenate(([True], ~same)), np.arange(len(order)), 0))
    head = order[lead]
    later = np.zeros(len(order), dtype=bool)
    maybe = (lead != np.arange(len(order))) & (size[order] == size[head]) & ((doc[order] != doc[head]) | (start[order] != start[head]))
    maybe = np.flatnonzero(maybe)
    maybe = maybe[equal_spans(raw, low[order[maybe]], low[head[maybe]], size[order[maybe]])] if len(maybe) else maybe
    later[order[maybe]] = True
    if later.any():
        k = np.flatnonzero(later)
        joined = np.concatenate(([False], (k[1:] == k[:-1] + 1) & (rows[at[k[1:]]] == rows[at[k[:-1]]])))
        edge = np.flatnonzero(~joined)
        total = np.add.reduceat(counts[k], edge)
        yield int(key[k[0]] % np.uint64(n_buckets)), None, np.stack([doc[k[edge]], start[k[edge]], total]).astype("<i8").tobytes()
    travel = np.flatnonzero(~later)
    bucket = (mix(key[travel]) % np.uint64(n_buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.concatenate(([True], np.diff(bucket[by]) != 0, [True])))
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        k = travel[by[a:b]]
        yield int(bucket[by[a]]), packed(doc[k], start[k], counts[k], size[k], raw[gather(low[k], size[k])].tobytes()), None


def repeated_windows(ids: np.ndarray, starts: np.ndarray, counts: np.ndarray, sizes: np.ndarray, text: bytes, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (id, start, windows) of the windows in a bucket that also start earlier; sorting brings equal ones together."""
    edges = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    strings = pa.StringArray.from_buffers(len(sizes), pa.py_buffer(edges.tobytes()), pa.py_buffer(text))
    codes, offsets, words = word_codes(strings)
    first = gather(offsets[:-1], counts)
    rows = np.repeat(np.arange(len(counts)), counts)
    doc, pos = ids[rows], starts[rows] + first - offsets[rows]
    h = window_hashes(word_hashes(words)[codes], window)[first]
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    shared = np.concatenate(([False], same)) | np.concatenate((same, [False]))
    w = order[shared]
    w = w[np.lexsort((pos[w], doc[w], h[w]))]
    if not len(w):
        return (np.empty(0, dtype=np.int64),) * 3
    begins = np.concatenate(([True], h[w][1:] != h[w][:-1]))
    lead = w[np.maximum.accumulate(np.where(begins, np.arange(len(w)), 0))]
    equal = np.ones(len(w), dtype=bool)
    for k in range(window):
        equal &= codes[first[w] + k] == codes[first[lead] + k]
    if not equal.all():  # different windows of one hash: all windows of such hashes are told apart by their words
        mixed = np.isin(h[w], h[w[~equal]])
        _, group = np.unique(codes[first[w[mixed]][:, None] + np.arange(window)], axis=0, return_inverse=True)
        m = w[mixed]
        by = np.lexsort((pos[m], doc[m], group.reshape(-1)))
        g = group.reshape(-1)[by]
        heads = np.maximum.accumulate(np.where(np.concatenate(([True], g[1:] != g[:-1])), np.arange(len(g)), 0))
        w, lead = np.concatenate((w[~mixed], m[by])), np.concatenate((lead[~mixed], m[by][heads]))
    later = (doc[w] != doc[lead]) | (pos[w] != pos[lead])
    marked = np.zeros(len(first), dtype=bool)
    marked[w[later]] = True
    k = np.flatnonzero(marked)
    edge = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1] + 1) | (rows[k[1:]] != rows[k[:-1]])))) if len(k) else np.empty(0, dtype=np.int64)
    return doc[k[edge]], pos[k[edge]], np.diff(np.append(edge, len(k)))


def repeated_runs(df: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, n): runs of n windows from word ``start`` on that also start earlier, in all of ``df``.

    A window's bucket follows from its minimiser, the least hash of its grams. Heavy
    grams rank after all others, so the windows around a passage that very many
    documents share spread by the words beside it.
    """
    gram = min(GRAM, window)
    df = df.filter(F.col(quoted(id_col)).isNotNull())  # rows without an id remove nothing
    heavy = heavy_grams(df, window, gram, text_col)
    n_buckets = max(2 * parts_for(df.sparkSession), text_bytes(df, text_col) * PACKED // BUCKET_BYTES + 1)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, limit=BLOCK):
            rows = list(super_kmers(block, window, gram, heavy, n_buckets))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "packed", "known"])

    def count(table: pa.Table) -> pa.Table:
        out = [np.frombuffer(x, dtype="<i8").reshape(3, -1) for x in table["known"].drop_null().to_pylist()]
        parts = [unpacked(x) for x in table["packed"].drop_null().to_pylist()]
        if parts:
            columns = [np.concatenate([p[k] for p in parts]) for k in range(4)]
            out.append(np.stack(repeated_windows(*columns, b"".join(p[4] for p in parts), window)))
            del parts, columns
        release()
        rows = np.concatenate(out, axis=1) if out else np.empty((3, 0), dtype=np.int64)
        return pa.table([pa.array(x) for x in rows], names=["id", "start", "n"])

    moved = df.select(F.col(quoted(id_col)).cast("long"), F.col(quoted(text_col)).alias("text")).mapInArrow(cut, "bucket long, packed binary, known binary")
    return moved.groupBy("bucket").applyInArrow(count, "id long, start long, n long")


def substring_dedup(df: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents without the words of windows that start earlier elsewhere.

    Words are ``[^\\x20\\x09-\\x0D]+``. A word goes if a window of ``window`` words over
    it has the words of another window that starts earlier: in a document of smaller
    id, or further ahead in the same one. Windows are judged on the input. Returns the
    columns of ``df`` (of those named n_words, n_removed or kept_text the results
    stand instead) with n_words, n_removed and kept_text, the kept words joined by
    one space. Null and empty texts have no words. Rows without an id keep theirs and
    remove none. Rows of one id are one document: what goes in one of them goes in all,
    and neither removes words of the other from the same place. Other columns pass
    through, whatever their names.
    """
    names = fields(df, ("n_words", "n_removed", "kept_text"))
    rows, (id_, text) = plain(df, names, id_col, text_col)
    out = without_runs(rows, repeated_runs(rows, window, id_, text), window, id_, text)
    return out.toDF(*names, "n_words", "n_removed", "kept_text")


def without_runs(df: DataFrame, runs: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """The documents without the words of runs of windows."""
    names = df.columns
    by_doc = runs.groupBy(F.col("id").alias("_id")).agg(F.collect_list(F.struct("start", "n")).alias("_runs"))
    by_doc = by_doc.select("_id", F.col("_runs.start").alias("_starts"), F.col("_runs.n").alias("_counts"))
    none = F.array().cast("array<bigint>")
    joined = squeezed(df, text_col).join(by_doc.hint("shuffle_hash"), F.col(id_col) == F.col("_id"), "left")
    joined = joined.select(*names, F.coalesce("_starts", none).alias("_starts"), F.coalesce("_counts", none).alias("_counts"))
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in opened(batches, text_col, BLOCK):
            codes, offsets, words = word_codes(block.column(at))
            starts, edges = as_list(block.column(len(names)))
            counts, _ = as_list(block.column(len(names) + 1))
            starts, counts = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (starts, counts))
            rows = row_of(edges)
            low = np.minimum(offsets[rows] + starts, offsets[rows + 1])
            high = np.minimum(low + counts + window - 1, offsets[rows + 1])
            depth = np.bincount(low, minlength=len(codes) + 1) - np.bincount(high, minlength=len(codes) + 1)
            keep = np.cumsum(depth)[: len(codes)] == 0
            kept_edges = np.concatenate(([0], np.cumsum(keep)))[offsets]
            kept = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept_edges, pa.int32()), words.take(pa.array(codes[keep]))), " ")
            n_words = np.diff(offsets)
            columns = [*block.columns[:-2], pa.array(n_words), pa.array(n_words - np.diff(kept_edges)), kept]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "n_words", "n_removed", "kept_text"])

    return joined.mapInArrow(run, f"{ddl(df, names)}, n_words long, n_removed long, kept_text string")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without windows of 20 words that start earlier, as digests."""
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), 20)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS words FROM documents
), w AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos, len(words) AS n FROM d
), g AS (
  SELECT doc_id, word, pos, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS win FROM w
), r AS (
  SELECT doc_id, word, pos, CASE WHEN pos + 19 <= n THEN row_number() OVER (PARTITION BY CASE WHEN pos + 19 <= n THEN win END ORDER BY doc_id, pos) END AS nth FROM g
), c AS (
  SELECT doc_id, word, pos, coalesce(max(CASE WHEN nth > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) = 1 AS gone FROM r
), k AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM c GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""

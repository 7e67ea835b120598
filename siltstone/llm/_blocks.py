"""Helpers for Arrow-batched text work inside Spark tasks.

Spark decides how rows are split and shuffled; these helpers only turn one Arrow
batch of texts into word codes with vectorised Arrow and numpy calls.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession

from siltstone.sources.shared import scratch, written  # noqa: F401 - the operators' own imports

#: Text bytes that one vectorised step takes at once.
BLOCK_BYTES = 4 << 20


def release() -> None:
    """Gives memory that no step holds any more back to the machine, where an executor's other workers and its JVM need it."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about ``limit`` bytes of ``column`` or a single row."""
    release()
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < n:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
        batch = None
        release()


def texts_of(column: pa.Array) -> pa.Array:
    """The texts as strings; null counts as empty."""
    return pc.fill_null(column.cast(pa.string()), "")


def as_list(pieces: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """The flat values of a list array and the row boundaries within them."""
    offsets = pieces.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    return pieces.flatten(), offsets - offsets[0]


def word_codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text as codes into a table of distinct words.

    Returns (codes, offsets, words): row i holds codes[offsets[i]:offsets[i + 1]].
    """
    texts = texts_of(column)
    flat, offsets = as_list(pc.ascii_split_whitespace(texts))
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    words = coded.dictionary
    empty = pc.index(words, "").as_py() if len(words) else -1
    if empty >= 0:
        keep = codes != empty
        offsets = np.concatenate(([0], np.cumsum(keep)))[offsets]
        codes = codes[keep]
        codes = codes - (codes > empty)
        words = pa.concat_arrays([words.slice(0, empty), words.slice(empty + 1)])
    return codes, offsets, words


def row_of(offsets: np.ndarray) -> np.ndarray:
    """The row that each flat element belongs to."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges [start, start + length)."""
    total = int(lengths.sum())
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return shift + np.arange(total)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; equal inputs give equal outputs."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(words: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit hash of each distinct word."""
    from xxhash import xxh3_64_intdigest

    return np.fromiter((xxh3_64_intdigest(w, seed) for w in words.cast(pa.binary()).to_pylist()), dtype=np.uint64, count=len(words))


def squeezed(df: DataFrame, column: str) -> DataFrame:
    """The rows with a text column compressed, for a shuffle of whole texts; opened() has them back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            raw = [None if x is None else packer.compress(x) for x in batch.column(column).cast(pa.binary()).to_pylist()]
            yield batch.set_column(batch.schema.get_field_index(column), column, pa.array(raw, pa.binary()))

    schema = ", ".join(f"{quoted(c)} {'binary' if c == column else df.schema[c].dataType.simpleString()}" for c in df.columns)
    return df.mapInArrow(run, schema)


def opened(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of squeezed() batches with their texts, of about ``limit`` bytes of text or a single row."""
    opener = zstandard.ZstdDecompressor()
    for batch in batches:
        texts, raw = None, batch.column(column).to_pylist()
        ends = np.cumsum([0 if x is None else zstandard.frame_content_size(x) for x in raw])
        start = 0
        while start < len(raw):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            texts = [None if x is None else opener.decompress(x) for x in raw[start:stop]]
            yield batch.slice(start, stop - start).set_column(batch.schema.get_field_index(column), column, pa.array(texts, pa.binary()).cast(pa.string()))
            start = stop
        batch = raw = texts = None
        release()


def own_shuffle(side: DataFrame, *keys: str) -> DataFrame:
    """An aggregate's rows with keys, whole numbers or strings, that Spark doesn't take to be dealt out already.

    A join on the aggregate's own keys would run within its stage, where adaptive
    execution can't split a hot key of the other side. This way both sides of the join
    are shuffled for it, and a hot key is split.
    """
    from pyspark.sql import functions as F

    same = lambda c: F.concat(F.col(c), F.lit("")) if side.schema[c].dataType.typeName() == "string" else F.col(c) + F.lit(0)
    return side.select(*(same(c).alias(c) if c in keys else F.col(c) for c in side.columns))


@contextmanager
def text_batches(spark: SparkSession, rows: int = 2000) -> Iterator[None]:
    """While texts are written right away: Arrow batches of fewer rows, since a batch of whole texts is held twice outside the heap."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def parts_for(spark: SparkSession) -> int:
    """The number of shuffle partitions that the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(df: DataFrame, text_col: str = "text") -> int:
    """UTF-8 bytes of all texts, to size buckets by."""
    from pyspark.sql import functions as F

    return int(df.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0)


def quoted(name: str) -> str:
    """A column's name as a reference that stands for it alone, whatever dots or backticks it has."""
    return f"`{name.replace('`', '``')}`"


def plain(df: DataFrame, names: list[str], *wanted: str) -> tuple[DataFrame, list[str]]:
    """Some columns under names that clash with nothing (c0, c1, ...), and the new names of the wanted ones.

    Arrow steps address columns by name, which dots, backticks and names that differ in
    case don't survive.
    """
    return df.select(*map(quoted, names)).toDF(*(f"c{i}" for i in range(len(names)))), [f"c{names.index(w)}" for w in wanted]


def fields(df: DataFrame, leave: tuple[str, ...] = ()) -> list[str]:
    """The names of the columns that pass through, without those that results replace."""
    return [c for c in df.columns if c not in leave]


def ddl(df: DataFrame, names: list[str]) -> str:
    """The schema string of some columns."""
    return ", ".join(f"{quoted(c)} {df.schema[c].dataType.simpleString()}" for c in names)

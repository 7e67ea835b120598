"""Token counts at every prefix of a text, from prefix dynamic programming."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm._blocks import blocks, gather, texts_of, word_codes
from siltstone.llm.vocab import default_path, word_vocabulary

VOCABULARY = "word_bpe_49k.json"
#: Text bytes whose distinct words are encoded at once.
BLOCK = 8 << 20
#: Text bytes whose prefix counts one step holds.
STEP_BYTES = 4 << 20
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def byte_counts(column: pa.Array, path: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Prefix counts of each text of a block, a few megabytes at a time.

    Yields (first row, rows, counts, ends, starts_char): ``counts[b]`` is the exact
    number of tokens of the row's text up to and including byte b (where b ends a
    character), ``ends`` the row boundaries, ``starts_char`` which bytes start one.
    """
    codes, offsets, words = word_codes(column)
    words = words.to_pylist()
    times = np.bincount(codes, minlength=len(words))
    tables = word_vocabulary(path).prefix_counts(words, times) if words else []
    lengths = np.fromiter(map(len, tables), dtype=np.int64, count=len(tables))
    totals = np.fromiter((t[-1] for t in tables), dtype=np.int64, count=len(tables))
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(tables) else lengths
    flat = np.concatenate(tables) if tables else np.empty(0, dtype=np.int32)
    texts = texts_of(column)
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    edges = np.concatenate(([0], np.cumsum(sizes)))
    row, n = 0, len(texts)
    while row < n:
        stop = max(row + 1, int(np.searchsorted(edges, edges[row] + STEP_BYTES, side="right")) - 1)
        piece = texts.slice(row, stop - row)
        raw = np.frombuffer(b"".join(piece.cast(pa.binary()).to_pylist()), dtype=np.uint8)
        ends = edges[row : stop + 1] - edges[row]
        c = codes[offsets[row] : offsets[stop]]
        before = np.concatenate(([0], np.cumsum(totals[c])))  # tokens before each word of this step
        base = before[offsets[row:stop] - offsets[row]]  # and before each row
        per_row = np.diff(offsets[row : stop + 1])
        blank = SPACE[raw]
        counts = np.empty(len(raw), dtype=np.int32)
        if len(c):
            own = before[:-1] - np.repeat(base, per_row)
            counts[~blank] = flat[gather(starts[c], lengths[c])] + np.repeat(own, lengths[c]).astype(np.int32)
        if blank.any():
            at = np.flatnonzero(blank)
            begins = ~blank
            begins[1:] &= blank[:-1]
            begins[ends[:-1][ends[:-1] < len(raw)]] = ~blank[ends[:-1][ends[:-1] < len(raw)]]
            words_before = np.cumsum(begins)[at]
            of_row = np.searchsorted(ends, at, side="right") - 1
            counts[at] = before[words_before] - base[of_row]
        yield row, stop - row, counts, ends, (raw & 0xC0) != 0x80
        row = stop


def _char_ends(starts_char: np.ndarray, low: int, high: int) -> np.ndarray:
    """The last byte of each character between two row edges."""
    at = np.flatnonzero(starts_char[low:high]) + low
    return np.append(at[1:], high) - 1 if len(at) else at


def token_prefix_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """The exact token count of every prefix of every text.

    Returns (id_col, prefix_counts array<int>): element k (from 0) is the number of
    tokens of the first k characters as the vocabulary's library gives them, so a
    length or budget question is an array lookup. Null and empty texts have the one
    element 0. Rows keep their number; equal rows give equal results; other columns
    are ignored, whatever their names.
    """
    path = path or default_path(VOCABULARY)
    kind = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, limit=BLOCK):
            ids = block.column(0)
            for row, n, counts, ends, starts_char in byte_counts(block.column(1), path):
                lists, edges = [], [0]
                for r in range(n):
                    lists.append(np.concatenate(([0], counts[_char_ends(starts_char, ends[r], ends[r + 1])])))
                    edges.append(edges[-1] + len(lists[-1]))
                values = pa.array(np.concatenate(lists).astype(np.int32))
                yield pa.RecordBatch.from_arrays([ids.slice(row, n), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), values)], names=[id_col, "prefix_counts"])

    return df.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind.simpleString()}, prefix_counts array<int>")


def tokens_at(counts, n_chars):
    """The token count of the first ``n_chars`` characters (the whole text where it is shorter)."""
    return F.get(counts, F.least(F.greatest(F.lit(n_chars), F.lit(0)), F.size(counts) - 1))


def longest_within(counts, budget: int):
    """The length in characters of the longest prefix of at most ``budget`` tokens."""
    fits = F.transform(counts, lambda c, k: F.when(c <= budget, k).otherwise(F.lit(0)))
    return F.array_max(fits)


def token_budget(df: DataFrame, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Answers from the prefix counts, without shipping them out of the task.

    Returns (id_col, n_bytes, n_tokens, over_limit, cut_chars): the size of the text
    in UTF-8, its exact tokens, whether these pass ``limit``, and the length of the
    longest prefix that doesn't. Null texts count as empty: 0 tokens.
    """
    path = path or default_path(VOCABULARY)
    kind = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, limit=BLOCK):
            ids = block.column(0)
            for row, n, counts, ends, starts_char in byte_counts(block.column(1), path):
                sizes = np.diff(ends)
                tokens = np.zeros(n, dtype=np.int64)
                tokens[sizes > 0] = counts[ends[1:][sizes > 0] - 1]
                cut = np.zeros(n, dtype=np.int64)
                for r in range(n):
                    low, high = ends[r], ends[r + 1]
                    if tokens[r] <= limit:
                        cut[r] = np.count_nonzero(starts_char[low:high])
                    else:
                        within = np.flatnonzero(counts[_char_ends(starts_char, low, high)] <= limit)
                        cut[r] = within[-1] + 1 if len(within) else 0
                columns = [ids.slice(row, n), pa.array(sizes), pa.array(tokens), pa.array(tokens > limit), pa.array(cut)]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_bytes", "n_tokens", "over_limit", "cut_chars"])

    schema = f"`{id_col}` {kind.simpleString()}, n_bytes long, n_tokens long, over_limit boolean, cut_chars long"
    return df.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, schema)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text of documents, with the cut that 2048 tokens allow."""
    return token_budget(spark.read.parquet(f"{sf_dir}/documents.parquet"), 2048)

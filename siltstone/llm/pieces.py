"""SentencePiece encoding and decoding through a table of distinct marked words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm._blocks import as_list, blocks, texts_of
from siltstone.llm.vocab import KEPT_WORDS, default_path

MODEL = "piece_bpe_32k.model"
#: Text bytes encoded at once.
BLOCK = 16 << 20
MARK = "▁"


class PieceTable:
    """Segmentations of distinct chunks: a run of white-space markers and the characters up to the next marker."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        crossing = [p for p in pieces if MARK in p.lstrip(MARK)]
        if crossing:
            raise ValueError(f"pieces cross white-space markers: {crossing[:3]}")
        self.lone = self.model.piece_to_id(MARK)
        self.known: dict[str, tuple[np.ndarray, bytes, bytes]] = {}

    def lookup(self, chunks: list[str], times: np.ndarray) -> list[tuple[np.ndarray, bytes, bytes]]:
        """(ids, their decimal text with a comma after each, decoded text) of chunks like ``▁▁word``."""
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        out = [self.known.get(c) for c in chunks]
        at = [i for i, x in enumerate(out) if x is None]
        # the model itself puts one marker before a text, so a chunk goes in without its first
        found = self.model.encode([chunks[i][1:] for i in at], num_threads=1) if at else []
        for i, ids in zip(at, found, strict=True):
            chunk = chunks[i]
            if chunk == MARK:
                ids = [self.lone]
            # a decoder drops one leading space of the whole text; a mark before the chunk keeps this chunk's own
            text = self.model.decode([self.lone, *ids])
            out[i] = (np.array(ids, dtype=np.int32), ("".join([f"{x}," for x in ids])).encode(), text.encode())
            if times[i] > 1:
                self.known[chunk] = out[i]
        return out


@lru_cache(maxsize=2)
def piece_table(path: str) -> PieceTable:
    """One table for each model and Python worker."""
    return PieceTable(path)


def chunk_codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The chunks of each text as (codes, row offsets, distinct chunks)."""
    texts = pc.replace_substring(texts_of(column), MARK, " ")
    flat, edges = as_list(pc.split_pattern(texts, " "))
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    table = coded.dictionary.to_pylist()
    empty = table.index("") if "" in table else -1
    # every part carries one marker; empty parts pass theirs on to the next part of the row
    last = np.zeros(len(codes), dtype=bool)
    last[edges[1:] - 1] = True
    whole = pc.binary_length(texts).to_numpy(zero_copy_only=False) == 0
    ends = (codes != empty) | last
    ends[edges[:-1][whole]] = False  # empty texts have no chunk
    at = np.flatnonzero(ends)
    rows = np.searchsorted(edges, at, side="right") - 1
    previous = np.concatenate(([-1], at[:-1]))
    marks = at - np.maximum(previous, edges[rows] - 1)
    codes = codes[at]
    chunks = [MARK + w for w in table]
    odd = np.flatnonzero(marks > 1)
    if len(odd):
        pairs, inverse = np.unique(np.stack([marks[odd], codes[odd]]), axis=1, return_inverse=True)
        codes[odd] = len(chunks) + inverse.reshape(-1)
        chunks += [MARK * int(m) + table[c] for m, c in pairs.T]
    return codes, np.searchsorted(at, edges), chunks


def piece_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Texts encoded and decoded again through the distinct-chunk table.

    Returns (id_col, n_tokens, ids_sha256, decoded_sha256) and with ``with_ids`` also
    the real outputs ``ids`` array<int> and ``decoded`` string. No piece holds a
    marker after another character, so ids of the chunks joined by position are the
    ids of the text; the model is checked for that. Null and empty texts have no ids
    and decode to an empty text. Rows keep their number, other columns are ignored.
    """
    path = path or default_path(MODEL)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(path)
        for block in blocks(batches, limit=BLOCK):
            codes, edges, chunks = chunk_codes(block.column(1))
            times = np.bincount(codes, minlength=len(chunks))
            used = np.flatnonzero(times)
            found: list = [None] * len(chunks)
            for i, x in zip(used, table.lookup([chunks[i] for i in used], times[used]), strict=True):
                found[i] = x
            sizes = np.array([0 if x is None else len(x[0]) for x in found], dtype=np.int64)
            total = np.concatenate(([0], np.cumsum(sizes[codes])))
            n_tokens = total[edges[1:]] - total[edges[:-1]]
            ids_sha, text_sha, all_ids, texts = [], [], [], []
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                own = [found[c] for c in codes[low:high].tolist()]
                ids_sha.append(hashlib.sha256(b"".join([x[1] for x in own])[:-1]).hexdigest())
                text = b"".join([x[2] for x in own])[1:]  # without the marker that the model put first
                text_sha.append(hashlib.sha256(text).hexdigest())
                if with_ids:
                    all_ids.append(np.concatenate([x[0] for x in own]) if own else np.empty(0, dtype=np.int32))
                    texts.append(text.decode())
            columns = [block.column(0), pa.array(n_tokens), pa.array(ids_sha), pa.array(text_sha)]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return df.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(run, schema)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, encoded and decoded."""
    return piece_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))

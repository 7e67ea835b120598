"""Grey images of PNG files, and such files from grey values."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples of a pixel by colour type: grey, RGB, grey and alpha, RGB and alpha.
SAMPLES = {0: 1, 2: 3, 4: 2, 6: 4}
#: The weights of red, green and blue in a grey value, and the most pixels that are unpacked.
GREY, MOST_PIXELS = (299, 587, 114), 1 << 26


def chunks(raw: bytes) -> Iterator[tuple[bytes, bytes]]:
    """The (type, data) chunks of a file; a wrong checksum or a cut is an error."""
    if not raw.startswith(SIGNATURE):
        raise ValueError("not_png")
    at = len(SIGNATURE)
    while at < len(raw):
        if at + 12 > len(raw):
            raise ValueError("cut")
        size, kind = struct.unpack_from(">I4s", raw, at)
        data = raw[at + 8 : at + 8 + size]
        if len(data) < size or at + 12 + size > len(raw):
            raise ValueError("cut")
        if zlib.crc32(kind + data) != struct.unpack_from(">I", raw, at + 8 + size)[0]:
            raise ValueError("checksum")
        yield kind, data
        at += 12 + size
        if kind == b"IEND":
            return
    raise ValueError("cut")


def unfiltered(lines: np.ndarray, step: int) -> np.ndarray:
    """The samples of lines (filter byte, filtered bytes), each of which may build on the pixel before and the line above."""
    kinds, rows = lines[:, 0], lines[:, 1:].astype(np.int64)
    out = np.zeros((len(rows) + 1, rows.shape[1] + step), dtype=np.int64)
    for y, (kind, row) in enumerate(zip(kinds.tolist(), rows, strict=True), 1):
        up = out[y - 1]
        if kind == 0:
            out[y, step:] = row
        elif kind == 1:
            out[y, step:] = row.reshape(-1, step).cumsum(axis=0).reshape(-1) & 255
        elif kind == 2:
            out[y, step:] = (row + up[step:]) & 255
        elif kind in (3, 4):
            for x in range(step, out.shape[1]):
                left, above, corner = int(out[y, x - step]), int(up[x]), int(up[x - step])
                if kind == 3:
                    guess = (left + above) // 2
                else:
                    p = left + above - corner
                    guess = min((abs(p - left), 0, left), (abs(p - above), 1, above), (abs(p - corner), 2, corner))[2]
                out[y, x] = (int(row[x - step]) + guess) & 255
        else:
            raise ValueError("filter")
    return out[1:, step:]


def grey_png(raw: bytes) -> tuple[int, int, np.ndarray]:
    """(width, height, grey values row by row) of a PNG file of 8 bits a sample; other files are an error that says why."""
    parts = list(chunks(raw))
    if parts[0][0] != b"IHDR" or len(parts[0][1]) != 13:
        raise ValueError("header")
    width, height, bits, colour, packing, filtering, interlaced = struct.unpack(">IIBBBBB", parts[0][1])
    if bits != 8 or colour not in SAMPLES or packing or filtering or interlaced:
        raise ValueError("kind")
    if not width or not height or width * height > MOST_PIXELS:
        raise ValueError("size")
    step, unpack = SAMPLES[colour], zlib.decompressobj()
    wanted = height * (1 + width * step)
    try:
        data = unpack.decompress(b"".join(d for k, d in parts if k == b"IDAT"), wanted + 1)
    except zlib.error:
        raise ValueError("packed") from None
    if len(data) != wanted:
        raise ValueError("length")
    pixels = unfiltered(np.frombuffer(data, dtype=np.uint8).reshape(height, -1), step).reshape(-1, step)
    if step < 3:
        return width, height, pixels[:, 0]
    return width, height, (pixels[:, :3] @ np.array(GREY) + 500) // 1000


def png_of(width: int, height: int, grey: np.ndarray) -> bytes:
    """A PNG file of grey values."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = np.concatenate([np.zeros((height, 1), dtype=np.uint8), grey.astype(np.uint8).reshape(height, width)], axis=1)
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def decoded(images: DataFrame) -> DataFrame:
    """(path, width, height, pixels array<double>, reason) of files (path, content); one that can't be decoded has nulls and the reason."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for content in batch.column(1).to_pylist():
                try:
                    if content is None:
                        raise ValueError("unreadable")
                    w, h, grey = grey_png(content)
                    out.append((w, h, grey.astype(np.float64).tolist(), None))
                except ValueError as e:
                    out.append((None, None, None, str(e)))
            types = (pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in out], t) for k, t in enumerate(types))], names=["path", "width", "height", "pixels", "reason"])

    return images.select("path", F.col("content").cast("binary")).mapInArrow(run, "path string, width int, height int, pixels array<double>, reason string")


def encoded(images: DataFrame, width: int, height: int) -> DataFrame:
    """(path, content): grey values (path, pixels) as PNG files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "content": [None if p is None else png_of(width, height, np.asarray(p)) for p in batch["pixels"]]})

    return images.select("path", "pixels").mapInPandas(run, "path string, content binary")

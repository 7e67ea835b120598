"""Images of PNG files: every filter, every kind of pixel, and files that are none."""

import struct
import zlib

import numpy as np
import pytest

from siltstone.operators import duplicates as U
from siltstone.operators import inventory as I
from siltstone.sources import images as M


def paeth(a, b, c):
    p = a + b - c
    pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
    return a if pa <= pb and pa <= pc else b if pb <= pc else c


def written(pixels, colour, filters):
    """A PNG file of (height, width, samples) with one of the filters on each line."""
    height, width, step = pixels.shape
    flat, out = pixels.reshape(height, -1).astype(int), b""
    for y in range(height):
        kind = filters[y % len(filters)]
        line = []
        for x in range(width * step):
            a = flat[y, x - step] if x >= step else 0
            b = flat[y - 1, x] if y else 0
            c = flat[y - 1, x - step] if y and x >= step else 0
            line.append((flat[y, x] - [0, a, b, (a + b) // 2, paeth(a, b, c)][kind]) & 255)
        out += bytes([kind, *line])
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    packed = zlib.compress(out)
    return M.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + chunk(b"tEXt", b"x") + chunk(b"IDAT", packed[:7]) + chunk(b"IDAT", packed[7:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("filters", [[0], [1], [2], [3], [4], [4, 3, 2, 1, 0]])
@pytest.mark.parametrize(("colour", "step"), [(0, 1), (2, 3), (4, 2), (6, 4)])
def test_every_filter(filters, colour, step):
    pixels = np.random.default_rng(step).integers(0, 256, size=(6, 5, step))
    w, h, grey = M.grey_png(written(pixels, colour, filters))
    want = pixels[..., 0] if step < 3 else (pixels[..., :3] @ np.array(M.GREY) + 500) // 1000
    assert (w, h) == (5, 6) and (grey.reshape(6, 5) == want).all()


def test_files(spark):
    good = M.png_of(3, 2, np.arange(6))
    short = good.replace(struct.pack(">IIBBBBB", 3, 2, 8, 0, 0, 0, 0), struct.pack(">IIBBBBB", 3, 9, 8, 0, 0, 0, 0))
    fixed = short[:29] + struct.pack(">I", zlib.crc32(short[12:29])) + short[33:]
    deep = good[:24] + bytes([16]) + good[25:29] + struct.pack(">I", zlib.crc32(good[12:24] + bytes([16]) + good[25:29])) + good[33:]
    rows = {"good": good, "cut": good[:-5], "changed": good[:20] + b"\xff" + good[21:], "length": fixed, "kind": deep, "gif": b"GIF89a", "empty": b"", "none": None}
    out = {r["path"]: r for r in M.decoded(spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in rows.items()], "path string, content binary")).collect()}
    assert (out["good"]["width"], out["good"]["height"], out["good"]["pixels"]) == (3, 2, [0.0, 1.0, 2.0, 3.0, 4.0, 5.0])
    assert {k: r["reason"] for k, r in out.items()} == {"good": None, "cut": "cut", "changed": "checksum", "length": "length", "kind": "kind", "gif": "not_png", "empty": "not_png", "none": "unreadable"}


def test_look_ups(spark):
    inv = spark.createDataFrame([("/a/café", False), ("/a/plain", True), ("/a/plain/x", False), ("/b", False), ("/a", False)], "path string, is_reparse_point boolean")
    asked = spark.createDataFrame([("/a/café",), ("/a/plain",), ("/a/none",)], "path string")
    assert {(r["asked"], r["path"]) for r in I.reread(asked, inv).collect()} == {("/a/café", "/a/café"), ("/a/plain", "/a/plain")}
    assert {r["path"] for r in I.live_subtree(inv, "/a").collect()} == {"/a", "/a/café", "/a/plain"}
    assert [I.has_any(x).first()[0] for x in (inv, inv.limit(0))] == [True, False]
    stats = spark.createDataFrame([(0, 0), (3, 1234)], "n_buckets long, bytes long")
    assert [r["line"] for r in U.immaterial_line(stats, 5000).collect()] == ["3 sizes that several files share could free less than 5,000 bytes each and weren't hashed; at best 1,234 bytes"]
    members = spark.createDataFrame([("h", f"/{i}", i == 4) for i in range(7)], "full_hash string, path string, is_keep boolean")
    pages = {r["page"]: [m["path"] for m in r["members"]] for r in U.member_rows(members, 3).collect()}
    assert pages == {0: ["/4", "/0", "/1"], 1: ["/2", "/3", "/5"], 2: ["/6"]}

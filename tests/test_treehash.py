"""Tree hashes of ranges against whole contents."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import treehash as T


def whole(data, size, fan):
    level = [hashlib.sha256(b"\x00" + data[i : i + size]).hexdigest() for i in range(0, max(1, len(data)), size)]
    while len(level) > 1:
        level = [hashlib.sha256(b"\x01" + "".join(level[i : i + fan]).encode()).hexdigest() for i in range(0, len(level), fan)]
    return level[0]


def contents():
    rng = random.Random(1)
    out = {f"f{i}": rng.randbytes(rng.choice([0, 1, 63, 64, 65, 700, 4096, 5000])) for i in range(20)}
    out["big"] = rng.randbytes(60_000)
    out["copy of big"] = out["big"]
    out["near big"] = out["big"][:-1] + b"x"
    return out


@pytest.mark.parametrize(("size", "fan"), [(64, 4), (1 << 20, 128), (1000, 2)])
def test_rows_and_files(spark, tmp_path, size, fan):
    files = contents()
    want = {k: whole(v, size, fan) for k, v in files.items()}
    rows = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()] + [("null", None)], "path string, content binary")
    got = T.tree_hashes(T.leaves_of(rows, range_bytes=size), range_bytes=size, fan=fan)
    assert {r["path"]: r["tree_hash"] for r in got.collect()} == want
    for k, v in files.items():
        (tmp_path / k).write_bytes(v)
    listed = spark.createDataFrame([(f"file:{tmp_path}/{k}" if i % 2 else f"{tmp_path}/{k}", len(v)) for i, (k, v) in enumerate(files.items())], "path string, size long")
    read = T.read_leaves(listed, size)
    assert read.filter("error IS NOT NULL").count() == 0
    assert {r["path"].rpartition("/")[2]: r["tree_hash"] for r in T.tree_hashes(read, range_bytes=size, fan=fan).collect()} == want
    same = {r["path"] for r in T.tree_clusters(got).collect()}
    assert {"big", "copy of big"} <= same and "near big" not in same and not any(files[p] == b"" for p in same)


def test_what_cannot_be_read(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"x" * 100)
    rows = spark.createDataFrame([(f"{tmp_path}/a", 100), (f"{tmp_path}/a", 130), (f"{tmp_path}/gone", 5), (str(tmp_path), 5)], "path string, size long")
    out = T.read_leaves(rows, 64)
    errors = {(r["path"].rpartition("/")[2], r["size"], r["error"]) for r in out.collect()}
    assert ("a", 100, None) in errors and ("a", 130, "changed") in errors and ("gone", 5, "FileNotFoundError") in errors and len({e for e in errors if e[2]}) == 3
    assert [r["size"] for r in T.tree_hashes(out, range_bytes=64).collect()] == [100]
    part = out.filter("size = 100 AND at = 1")
    assert T.tree_hashes(part, range_bytes=64).count() == 0


def test_a_hot_file_is_many_rows(spark):
    """Ranges of one file are dealt out over the partitions."""
    df = spark.createDataFrame([("/none", 100_000)], "path string, size long")
    spread = T.read_leaves(df, 10).withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert len(spread) == 4 and max(r["count"] for r in spread) < 4000

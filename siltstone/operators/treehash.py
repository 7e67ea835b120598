"""Digests of whole files from their byte ranges, so that no task holds or reads a whole file.

A range's digest is a leaf; every FAN consecutive digests have a parent, until one is
left, the file's tree hash. Files of equal size and tree hash have equal contents, as
with a plain digest, but each range can be read by another task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.sources.shared import written

#: Bytes of a range, children of a parent, bytes read at once, and bytes that a task reads, about.
RANGE, FAN, STEP, TASK = 16 << 20, 128, 1 << 20, 1 << 30
#: What stands before the bytes of a leaf and before the digests of a parent, so that neither can pass for the other.
LEAF, NODE = b"\x00", b"\x01"


def range_starts(size: Column, range_bytes: int = RANGE) -> Column:
    """The numbers of a file's ranges; an empty file has one."""
    return F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(size / range_bytes).cast("long") - 1, F.lit(0).cast("long")))


def leaf(content: Column) -> Column:
    """The digest of a range's bytes."""
    return F.sha2(F.concat(F.lit(LEAF), content.cast("binary")), 256)


def leaves_of(rows: DataFrame, key: str = "path", content: str = "content", range_bytes: int = RANGE) -> DataFrame:
    """(key, size, at, digest) of contents that are in rows; null contents have none."""
    data = rows.filter(F.col(content).isNotNull()).select(key, F.col(content).cast("binary").alias("_c"))
    each = data.select(key, "_c", F.octet_length("_c").cast("long").alias("size"), F.explode(range_starts(F.octet_length("_c"), range_bytes)).alias("at"))
    return each.select(key, "size", "at", leaf(F.substring("_c", (F.col("at") * range_bytes + 1).cast("int"), F.lit(range_bytes))).alias("digest"))


def opened(path: str) -> pa.NativeFile:
    """A file for reading at any place, by a plain path or one with a scheme."""
    if "://" not in path and not path.startswith("file:"):
        return pa.OSFile(path)
    if path.startswith("file:"):
        return pa.OSFile("/" + path.removeprefix("file:").lstrip("/"))
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def read_leaves(files: DataFrame, range_bytes: int = RANGE) -> DataFrame:
    """(path, size, at, digest, error) of files (path, size) read where they are, a range a row.

    Ranges are dealt out over all tasks whatever file they are of; each is read in steps
    and only its digest goes on. A range that can't be read, or a file that has become
    shorter or longer than ``size``, gives an error and no digest.
    """
    each = files.select("path", F.col("size").cast("long").alias("size"), F.explode(range_starts(F.col("size"), range_bytes)).alias("at"))

    def digest(path: str, size: int, at: int) -> tuple[str | None, str | None]:
        start, stop, h = at * range_bytes, min(size, (at + 1) * range_bytes), hashlib.sha256(LEAF)
        try:
            with opened(path) as f:
                if f.size() != size:
                    return None, "changed"
                f.seek(start)
                while start < stop:
                    part = f.read(min(STEP, stop - start))
                    if not part:
                        return None, "changed"
                    h.update(part)
                    start += len(part)
        except (OSError, pa.ArrowException) as e:
            return None, type(e).__name__
        return h.hexdigest(), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [digest(*row) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([d for d, _ in found], pa.string()), pa.array([e for _, e in found], pa.string())], names=["path", "size", "at", "digest", "error"])

    # by number, since rows of paths are so small that adaptive execution would put all of them into one task
    parts = max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(files.agg(F.sum("size")).first()[0] or 0) // TASK + 1)
    return each.repartition(parts, "path", "at").mapInArrow(run, "path string, size long, at long, digest string, error string")


def tree_hashes(leaves: DataFrame, key: str = "path", range_bytes: int = RANGE, fan: int = FAN) -> DataFrame:
    """(key, size, tree_hash) of files all of whose ranges have a digest.

    A level is a grouping of ``fan`` rows each, so no group grows with a file; levels grow
    with the logarithm of the largest file. Ranges that are there twice count once; a
    file with a range missing has no hash.
    """
    nodes = leaves.filter(F.col("digest").isNotNull()).groupBy(key, "size", "at").agg(F.min("digest").alias("digest"))
    nodes = written(nodes.withColumn("n", F.greatest(F.ceil(F.col("size") / range_bytes).cast("long"), F.lit(1).cast("long"))))
    most, done = nodes.agg(F.max("n")).first()[0] or 0, [nodes.filter("n = 1")]
    while most > 1:
        below = F.sort_array(F.collect_list(F.struct("at", "digest")))
        groups = nodes.filter("n > 1").groupBy(key, "size", "n", F.floor(F.col("at") / fan).alias("at")).agg(below.alias("b"))
        # a parent is made of all its children, or not at all
        whole = F.size("b") == F.least(F.lit(fan), F.col("n") - F.col("at") * fan)
        digest = F.sha2(F.concat(F.lit(NODE), F.array_join(F.transform("b", lambda x: x["digest"]), "").cast("binary")), 256)
        nodes = written(groups.filter(whole).select(key, "size", "at", digest.alias("digest"), F.ceil(F.col("n") / fan).alias("n")))
        done.append(nodes.filter("n = 1"))
        most = -(-most // fan)
    return reduce(DataFrame.unionByName, done).select(key, "size", F.col("digest").alias("tree_hash"))


def tree_clusters(hashes: DataFrame, key: str = "path") -> DataFrame:
    """Files of equal size and tree hash, with cluster_size, where there are several; empty files aren't duplicates."""
    several = hashes.filter("size > 0").groupBy("size", "tree_hash").agg(F.count(F.lit(1)).alias("cluster_size")).filter("cluster_size > 1")
    return hashes.join(several.select((F.col("size") + F.lit(0)).alias("size"), F.concat("tree_hash", F.lit("")).alias("tree_hash"), "cluster_size"), ["size", "tree_hash"]).select(key, "size", "tree_hash", "cluster_size")

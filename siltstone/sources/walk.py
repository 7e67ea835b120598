"""File trees walked where they are: directories, links, and what can't be read, with the reason.

``read_tree`` is a Spark data source with a partition for each subtree. The folder has
to be one that all executors see under the same path.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from siltstone.functions import paths as P

#: Rows of an Arrow batch, subtrees that a walk is cut into at least if it has as many, and skips that a summary lists.
BATCH, SUBTREES, SHOWN_SKIPS = 5000, 64, 20
FIELDS = (
    ("path", pa.string(), "string"),
    ("is_dir", pa.bool_(), "boolean"),
    ("is_reparse_point", pa.bool_(), "boolean"),
    ("size", pa.int64(), "long"),
    ("mtime", pa.float64(), "double"),
    ("ctime", pa.float64(), "double"),
    ("dev", pa.int64(), "long"),
    ("ino", pa.int64(), "long"),
    ("nlink", pa.int64(), "long"),
    ("error", pa.string(), "string"),
    ("size_estimate_bytes", pa.int64(), "long"),
    ("is_lower_bound", pa.bool_(), "boolean"),
)
#: What git keeps in a folder that it looks after.
MARKER = ".git"


@dataclass
class Subtree(InputPartition):
    """A directory to walk, with all below it or with its own entries alone."""

    path: str
    whole: bool


def signed(n: int) -> int:
    """An unsigned 64-bit number as a signed one of the same bits."""
    return n - (1 << 64) if n >= 1 << 63 else n


def skipped(path: str, error: OSError, known: tuple[int, bool] | None = None) -> tuple:
    """The row of what couldn't be read: its error, and the bytes of what was listed of it before, a lower bound."""
    why = f"{type(error).__name__}: {error.strerror or error}"
    return (path, None, None, None, None, None, None, None, None, why, known[0] if known and known[1] else None, bool(known and known[1]))


def listed(path: str) -> tuple[list[tuple[os.DirEntry, os.stat_result | OSError]], OSError | None]:
    """The entries of a directory with what is known of each, and the error that ended the listing, if any."""
    found: list[tuple[os.DirEntry, os.stat_result | OSError]] = []
    try:
        with os.scandir(path) as entries:
            for entry in entries:
                try:
                    found.append((entry, entry.stat(follow_symlinks=False)))
                except OSError as e:
                    found.append((entry, e))
    except OSError as e:
        return found, e
    return found, None


def walked(start: str, whole: bool = True) -> Iterator[tuple]:
    """A row for each entry below a directory; links and other reparse points are rows but never followed.

    A directory that can't be listed has a second row with the error, and what was listed
    of it before counts as a lower bound of its size. An entry that can't be looked at has
    a row with its error only.
    """
    left = [start]
    while left:
        here = left.pop()
        found, error = listed(here)
        if error is not None:
            yield skipped(here, error, (sum(s.st_size for _, s in found if not isinstance(s, OSError)), bool(found)))
        for entry, s in found:
            path = os.path.join(here, entry.name)
            if isinstance(s, OSError):
                yield skipped(path, s)
                continue
            is_dir, is_link = stat.S_ISDIR(s.st_mode), stat.S_ISLNK(s.st_mode)
            yield (path, is_dir, is_link, 0 if is_dir else s.st_size, s.st_mtime, s.st_ctime, signed(s.st_dev), signed(s.st_ino), s.st_nlink, None, None, False)
            if is_dir and whole:
                left.append(path)


def subtrees(root: str, least: int) -> list[Subtree]:
    """Partitions of a tree: level by level, until there are enough directories to walk whole; those above are listed alone.

    The driver lists the upper levels only, and no level after the one that has enough.
    """
    alone, level = [], [root]
    while level and len(level) < least:
        below = [os.path.join(here, e.name) for here in level for e, s in listed(here)[0] if not isinstance(s, OSError) and stat.S_ISDIR(s.st_mode)]
        alone += [Subtree(here, False) for here in level]
        level = below
    return alone + [Subtree(here, True) for here in level]


class TreeReader(DataSourceReader):
    """Reads the subtrees of a root."""

    def __init__(self, root: str, least: int):
        self.root, self.least = root, least

    def partitions(self) -> list[Subtree]:
        return subtrees(self.root, self.least)

    def read(self, partition: Subtree) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for row in walked(partition.path, partition.whole):
            rows.append(row)
            if len(rows) == BATCH:
                yield batch_of(rows)
                rows = []
        if rows:
            yield batch_of(rows)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    """Rows as an Arrow batch; bytes of a name that aren't text become replacement marks."""
    columns = list(zip(*rows, strict=True))
    columns[0] = tuple(p.encode("utf-8", "surrogateescape").decode("utf-8", "replace") for p in columns[0])
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t, _) in zip(columns, FIELDS, strict=True)], names=[n for n, _, _ in FIELDS])


class TreeSource(DataSource):
    """``spark.read.format("file_tree").option("root", folder)``."""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return ", ".join(f"{n} {t}" for n, _, t in FIELDS)

    def reader(self, schema) -> TreeReader:  # noqa: ANN001 - Spark's type
        return TreeReader(self.options["root"], int(self.options.get("subtrees", SUBTREES)))


def read_tree(spark: SparkSession, root: str, least: int = SUBTREES) -> DataFrame:
    """The entries below a folder that all executors see: files, directories and links, and rows with ``error`` for what can't be read.

    Columns: those of FIELDS with name, parent and ext. A root that can't be listed gives
    one row with the error. The tree is cut into subtrees level by level, so the walk is
    as wide as the tree; a single directory is one task's.
    """
    spark.dataSource.register(TreeSource)
    local = root.removeprefix("file:")
    rows = spark.read.format("file_tree").option("root", f"/{local.lstrip('/')}".rstrip("/") or "/").option("subtrees", str(least)).load()
    name = P.name_of(F.col("path"))
    return rows.withColumns({"name": name, "parent": P.parent_of(F.col("path")), "ext": F.when(F.coalesce("is_dir", F.lit(False)), F.lit("")).otherwise(P.ext_of(name))})


def entries(rows: DataFrame) -> DataFrame:
    """The rows that were read."""
    return rows.filter("error IS NULL").drop("error", "size_estimate_bytes", "is_lower_bound")


def with_repository(rows: DataFrame, clean: DataFrame) -> DataFrame:
    """Entries with git_repo_root, the nearest folder above (or the folder itself) that git looks after, and whether it is clean.

    ``clean`` has (root, is_clean) as an outside check found it; a root that is missing
    there, or whose check failed (null), isn't clean.
    """
    roots = rows.filter(F.col("name") == MARKER).select(F.col("parent").alias("a"))
    up = rows.select("path", F.explode(F.concat(P.proper_ancestors(F.col("path")), F.when(F.col("is_dir"), F.array("path")).otherwise(F.array().cast("array<string>")))).alias("a"))
    nearest = up.join(roots.distinct(), "a").groupBy("path").agg(F.max_by("a", F.length("a")).alias("git_repo_root"))
    known = clean.groupBy(F.col("root").alias("git_repo_root")).agg(F.bool_and(F.coalesce("is_clean", F.lit(False))).alias("git_repo_clean"))
    out = rows.join(nearest, "path", "left").join(known, "git_repo_root", "left")
    return out.withColumn("git_repo_clean", F.coalesce("git_repo_clean", F.lit(False)))


def scan_stats(rows: DataFrame, shown: int = SHOWN_SKIPS) -> DataFrame:
    """One row: entries, directories, files and their bytes, links, and skips with their number, known bytes and a sample of the first by path.

    The number of skips is exact; only the sample has a limit.
    """
    bad = F.col("error").isNotNull()
    file = ~bad & ~F.col("is_dir") & ~F.col("is_reparse_point")
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    whole = rows.agg(
        count(~bad).alias("n_entries"),
        count(~bad & F.col("is_dir")).alias("n_dirs"),
        count(file).alias("n_files"),
        F.coalesce(F.sum(F.when(file, F.col("size"))), F.lit(0)).alias("bytes"),
        count(~bad & F.col("is_reparse_point")).alias("n_links"),
        count(bad).alias("n_skipped"),
        F.coalesce(F.sum("size_estimate_bytes"), F.lit(0)).alias("skipped_bytes_known"),
    )
    first = rows.filter(bad).orderBy("path").limit(shown).agg(F.sort_array(F.collect_list(F.struct("path", "error", "size_estimate_bytes", "is_lower_bound"))).alias("skips"))
    return whole.crossJoin(first)  # one row each

"""Exact duplicates: size buckets, hashes of survivors, the copy to keep, and vetoes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import paths as P
from siltstone.operators import rules as R
from siltstone.operators import safety as S
from siltstone.operators.places import placed

EDGE = 64 * 1024


def _countable(inv: DataFrame) -> DataFrame:
    return inv.filter(~F.col("is_dir") & (F.col("size") > 0) & ~F.col("is_cloud_placeholder"))


def size_buckets(inv: DataFrame, floor: int = R.DUPLICATE_FLOOR) -> DataFrame:
    """(size, n, surplus_bytes) of sizes that several files share and that could free at least ``floor``."""
    b = _countable(inv).groupBy("size").agg(F.count(F.lit(1)).alias("n")).withColumn("surplus_bytes", (F.col("n") - 1) * F.col("size"))
    return b.filter((F.col("n") >= 2) & (F.col("surplus_bytes") >= floor))


def immaterial(inv: DataFrame, floor: int = R.DUPLICATE_FLOOR) -> DataFrame:
    """How many shared sizes fall below the floor, and their bytes."""
    b = _countable(inv).groupBy("size").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    s = (F.col("n") - 1) * F.col("size")
    return b.filter(s < floor).agg(F.count(F.lit(1)).alias("n_buckets"), F.coalesce(F.sum(s), F.lit(0)).alias("bytes"))


def size_candidates(inv: DataFrame, floor: int = R.DUPLICATE_FLOOR) -> DataFrame:
    """Files in size buckets worth hashing."""
    return _countable(inv).join(size_buckets(inv, floor).select("size"), "size", "left_semi")


def partial_hash(content: Column, edge: int = EDGE) -> Column:
    """The digest of a short content, or of both ends of a long one."""
    ends = F.concat(F.left(content, F.lit(edge)), F.right(content, F.lit(edge)))
    return F.sha2(F.when(F.length(content) <= 2 * edge, content).otherwise(ends), 256)


def clusters(inv: DataFrame, floor: int = R.DUPLICATE_FLOOR, edge: int = EDGE) -> DataFrame:
    """Members of exact-duplicate clusters with their full hash: size, then ends, then whole content must agree.

    Both hashes are taken where the rows are read, so that no content is shuffled; each
    step drops singles before the next one. A hot content spreads over partial counts.
    """
    hashed = _countable(inv).withColumns({"partial_hash": partial_hash(F.col("content"), edge), "full_hash": F.sha2("content", 256)}).drop("content")
    rows = hashed.join(size_buckets(inv, floor).select("size"), "size", "left_semi")
    several = rows.groupBy("size", "partial_hash").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").drop("n")
    rows = rows.join(several, ["size", "partial_hash"], "left_semi")
    whole = rows.groupBy("size", "full_hash").agg(F.count(F.lit(1)).alias("cluster_size")).filter("cluster_size >= 2")
    return rows.join(whole, ["size", "full_hash"])


def location_rank() -> Column:
    """0 in a repository, 2 in downloads or temp, else 1."""
    return F.when(F.col("git_repo_root").isNotNull(), 0).when(P.in_downloads_or_temp(F.col("path")), 2).otherwise(1)


def risky() -> Column:
    """Whether a copy is a poor one to be left alone."""
    return P.in_downloads_or_temp(F.col("path")) | F.col("is_cloud_placeholder")


def with_keep(members: DataFrame) -> DataFrame:
    """Members with keep_path, is_keep and needs_review of their cluster.

    Kept is the least by (location rank, depth, ctime, path). Review is asked for if the
    kept copy is risky while another isn't.
    """
    order = F.struct(location_rank(), P.depth_of(F.col("path")), F.col("ctime"), F.col("path"))
    best = members.groupBy("size", "full_hash").agg(
        F.min_by("path", order).alias("keep_path"), F.min_by(risky(), order).alias("_keep_risky"), F.bool_or(~risky()).alias("_any_safe")
    )
    out = members.join(best, ["size", "full_hash"]).withColumn("is_keep", F.col("path") == F.col("keep_path"))
    return out.withColumn("needs_review", F.col("_keep_risky") & F.col("_any_safe")).drop("_keep_risky", "_any_safe")


def candidates(kept: DataFrame, enabled: bool = True, mode: str = "power") -> DataFrame:
    """Duplicates to remove: whole clusters go if any member that isn't kept is blocked."""
    rows = S.with_verdict(kept.filter(~F.col("is_keep")))
    vetoed = rows.filter(F.col("verdict") == S.BLOCKED).select("size", "full_hash").distinct()
    rows = rows.join(vetoed, ["size", "full_hash"], "left_anti")
    tier = F.when(F.lit(mode == "safe") | (F.col("verdict") == S.REVIEW) | F.col("needs_review") | F.lit(not enabled), "B").otherwise("A")
    return rows.select("path", "keep_path", "full_hash", "size", "verdict", "needs_review", tier.alias("tier"), *(c for c in ("dev", "ino", "nlink", "is_reparse_point") if c in rows.columns))


def review_top(cands: DataFrame, limit: int = 15) -> DataFrame:
    """The clusters with most bytes to free."""
    g = cands.groupBy("full_hash", "keep_path").agg(F.count(F.lit(1)).alias("n_duplicates"), F.sum("size").alias("bytes"))
    return g.orderBy(F.desc("bytes"), "full_hash").limit(limit)


def immaterial_line(stats: DataFrame, floor: int = R.DUPLICATE_FLOOR) -> DataFrame:
    """(line): what is said of immaterial() sizes; no row where there are none."""
    number = lambda c: F.format_number(c, 0)
    line = F.concat(F.col("n_buckets").cast("string"), F.lit(" sizes that several files share could free less than "), number(F.lit(floor)), F.lit(" bytes each and weren't hashed; at best "), number(F.col("bytes")), F.lit(" bytes"))
    return stats.filter("n_buckets > 0").select(line.alias("line"))


def member_rows(members: DataFrame, block: int = 100) -> DataFrame:
    """(full_hash, page, members array<struct<path, is_keep>>): the members of each cluster in pages, the kept one first, then by path.

    A cluster of very many copies has many pages, so none is one row.
    """
    order = (F.desc("is_keep"), F.asc("path"))
    placed_ = placed(members.select("full_hash", "path", "is_keep"), "full_hash", order, "_n")
    pages = placed_.withColumn("page", F.floor(F.col("at") / block)).groupBy("full_hash", "page").agg(F.sort_array(F.collect_list(F.struct("at", "path", "is_keep"))).alias("m"))
    return pages.select("full_hash", "page", F.transform("m", lambda x: F.struct(x["path"].alias("path"), x["is_keep"].alias("is_keep"))).alias("members"))

"""Inventory maintenance: look-ups, subtree sums, merges, change classes, link-aware sizes."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import paths as P


def by_name(inv: DataFrame, names: list[str], is_dir: bool | None = None) -> DataFrame:
    """Rows with one of the names, whatever the case; none for an empty list."""
    out = inv.filter(F.lower("name").isin([n.lower() for n in names]) if names else F.lit(False))
    return out if is_dir is None else out.filter(F.col("is_dir") == is_dir)


def by_ext(inv: DataFrame, exts: list[str], is_dir: bool | None = None) -> DataFrame:
    """Rows with one of the extensions; none for an empty list."""
    out = inv.filter(F.col("ext").isin(list(exts)) if exts else F.lit(False))
    return out if is_dir is None else out.filter(F.col("is_dir") == is_dir)


def larger_than(inv: DataFrame, least: int, is_dir: bool = False) -> DataFrame:
    """Rows of at least that size."""
    return inv.filter((F.col("size") >= least) & (F.col("is_dir") == is_dir))


def matching(inv: DataFrame, glob: str, is_dir: bool | None = None) -> DataFrame:
    """Rows whose path matches a glob in which ``*`` crosses slashes."""
    out = inv.filter(P.matches_glob(F.col("path"), glob))
    return out if is_dir is None else out.filter(F.col("is_dir") == is_dir)


def children(inv: DataFrame, parent: str) -> DataFrame:
    """Immediate children of a directory."""
    return inv.filter(P.in_subtree(F.col("path"), parent) & (F.col("parent") == parent))


def subtree(inv: DataFrame, root: str | None, placeholders: bool = True) -> DataFrame:
    """All rows below a root, or all; candidates leave placeholders out."""
    out = inv if root is None else inv.filter(P.in_subtree(F.col("path"), root))
    return out if placeholders else out.filter(~F.col("is_cloud_placeholder"))


def existing(paths: DataFrame, inv: DataFrame) -> DataFrame:
    """The paths that the inventory holds."""
    return paths.join(inv.select("path"), "path", "left_semi")


def directory_totals(inv: DataFrame) -> DataFrame:
    """(path, subtree_bytes, subtree_entries) of every directory, in one pass over its descendants.

    Bytes are those of files; entries are rows that aren't placeholders, the directory
    itself included. Each row goes to its ancestors, and partial sums travel.
    """
    up = F.concat(P.proper_ancestors(F.col("path")), F.when(F.col("is_dir"), F.array("path")).otherwise(F.array().cast("array<string>")))
    spread = inv.select(F.explode(up).alias("path"), F.when(~F.col("is_dir"), F.col("size")).otherwise(F.lit(0)).alias("b"), (~F.col("is_cloud_placeholder")).cast("long").alias("n"))
    return spread.groupBy("path").agg(F.sum("b").alias("subtree_bytes"), F.sum("n").alias("subtree_entries"))


def change_classes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) of a scan against the stored rows: new, changed or unchanged (size and mtime both equal)."""
    o = old.select("path", F.col("size").alias("old_size"), F.col("mtime").alias("old_mtime"), F.lit(True).alias("known"))
    same = (F.col("size") == F.col("old_size")) & (F.col("mtime") == F.col("old_mtime"))
    change = F.when(F.col("known").isNull(), "new").when(same, "unchanged").otherwise("changed")
    return new.join(o, "path", "left").select("path", change.alias("change"))


def upserted(old: DataFrame, new: DataFrame, kept: tuple[str, ...] = ("hash_size", "hash_mtime", "partial_hash", "full_hash")) -> DataFrame:
    """Old rows overlaid with new ones by path; the ``kept`` columns stay as stored."""
    columns = [c for c in old.columns if c != "path"]
    n = new.select("path", *(F.col(c).alias(f"_new_{c}") for c in columns if c in new.columns and c not in kept), F.lit(True).alias("_given"))
    both = old.join(n, "path", "full")
    pick = lambda c: F.when(F.col("_given"), F.col(f"_new_{c}")).otherwise(F.col(c)) if f"_new_{c}" in n.columns else F.col(c)
    return both.select("path", *(pick(c).alias(c) for c in columns))


def unseen(inv: DataFrame, seen: DataFrame, root: str | None, cancelled: bool = False) -> DataFrame:
    """Rows under the root that a scan didn't see; none if it was cancelled."""
    rows = subtree(inv, root)
    return rows.limit(0) if cancelled else rows.join(seen.select("path"), "path", "left_anti")


def replaced_under(old: DataFrame, new: DataFrame, root: str) -> DataFrame:
    """Rows outside the root with the new ones of it."""
    return old.filter(~P.in_subtree(F.col("path"), root)).unionByName(new)


def valid_hashes(inv: DataFrame) -> DataFrame:
    """Cached hashes that still count: stored for the present size and mtime."""
    ok = (F.col("hash_size") == F.col("size")) & (F.col("hash_mtime") == F.col("mtime"))
    return inv.select("path", F.when(ok, F.col("partial_hash")).alias("partial_hash"), F.when(ok, F.col("full_hash")).alias("full_hash"), F.coalesce(ok, F.lit(False)).alias("valid"))


def stored_hashes(inv: DataFrame, hashes: DataFrame) -> DataFrame:
    """The inventory with new hashes written to rows it has."""
    h = hashes.select("path", F.col("partial_hash").alias("_p"), F.col("full_hash").alias("_f"))
    out = inv.join(h, "path", "left")
    return out.withColumn("partial_hash", F.coalesce("_p", "partial_hash")).withColumn("full_hash", F.coalesce("_f", "full_hash")).drop("_p", "_f")


def logical_bytes(inv: DataFrame) -> DataFrame:
    """The sum of file sizes."""
    return inv.filter(~F.col("is_dir")).agg(F.coalesce(F.sum("size"), F.lit(0)).alias("logical_bytes"))


def physical_bytes(inv: DataFrame) -> DataFrame:
    """The sum of sizes with each (dev, ino) once; rows without identity (0, 0) count each."""
    f = inv.filter(~F.col("is_dir"))
    linked = f.filter((F.col("dev") != 0) | (F.col("ino") != 0)).groupBy("dev", "ino").agg(F.max("size").alias("size")).select("size")
    return f.filter((F.col("dev") == 0) & (F.col("ino") == 0)).select("size").unionByName(linked).agg(F.coalesce(F.sum("size"), F.lit(0)).alias("physical_bytes"))


def freeable(rows: DataFrame, order: Column) -> DataFrame:
    """Rows with freeable_bytes and resolved: what deleting them all gives back.

    One link or fewer frees the size; a reparse point or missing link count frees
    nothing and is unresolved; of several links, the first row of the file frees the
    size if the rows hold all links, else none does. Only rows of several links meet by
    file; such a row whose file isn't known (no dev and ino, or 0 for both) is unresolved.
    """
    unknown = F.col("dev").isNull() | F.col("ino").isNull() | ((F.col("dev") == 0) & (F.col("ino") == 0))
    several = F.coalesce(F.col("nlink") > 1, F.lit(False))
    linked = rows.filter(several & ~unknown).withColumn("_o", order)
    groups = linked.groupBy("dev", "ino").agg(F.count(F.lit(1)).alias("_n"), F.min("_o").alias("_first"))
    groups = groups.select((F.col("dev") + F.lit(0)).alias("dev"), (F.col("ino") + F.lit(0)).alias("ino"), "_n", "_first")  # a shuffle of its own for the join
    lost = F.col("is_reparse_point") | F.col("nlink").isNull()
    first = ~lost & (F.col("_n") >= F.col("nlink")) & (F.col("_o") == F.col("_first"))
    met = linked.join(groups, ["dev", "ino"]).withColumn("freeable_bytes", F.when(first, F.col("size")).otherwise(F.lit(0)).cast("long")).withColumn("resolved", ~lost)
    alone = rows.filter(~several | unknown).withColumn("resolved", ~lost & ~several)
    alone = alone.withColumn("freeable_bytes", F.when(F.col("resolved"), F.col("size")).otherwise(F.lit(0)).cast("long"))
    names = [*rows.columns, "freeable_bytes", "resolved"]
    return alone.select(*names).unionByName(met.select(*names))


def nearest_marker(paths: DataFrame, markers: DataFrame) -> DataFrame:
    """(path, marker): the deepest ancestor of each path that is a marker directory (column ``path`` of markers)."""
    up = paths.select("path", F.explode(P.proper_ancestors(F.col("path"))).alias("a"))
    hit = up.join(markers.select(F.col("path").alias("a")).distinct(), "a")
    found = hit.groupBy("path").agg(F.max_by("a", F.length("a")).alias("marker"))
    return paths.select("path").join(found, "path", "left")


def inaccessible_summary(rows: DataFrame) -> DataFrame:
    """How many paths can't be read, their known bytes, and how many have none known."""
    unknown = F.sum(F.col("size_estimate_bytes").isNull().cast("long"))
    return rows.agg(F.count(F.lit(1)).alias("n_paths"), F.coalesce(F.sum("size_estimate_bytes"), F.lit(0)).alias("known_bytes"), F.coalesce(unknown, F.lit(0)).alias("n_unknown"))


def reconciliation(inv: DataFrame, inaccessible: DataFrame, used: int) -> DataFrame:
    """Physical and inaccessible bytes against those in use: delta, and its share in percent (0 if none are in use)."""
    both = physical_bytes(inv).crossJoin(inaccessible_summary(inaccessible))  # one row each
    delta = F.lit(used) - F.col("physical_bytes") - F.col("known_bytes")
    percent = F.lit(0.0) if used == 0 else F.round(delta * 100.0 / used, 4)
    return both.select("physical_bytes", "known_bytes", F.lit(used).cast("long").alias("used_bytes"), delta.cast("long").alias("delta_bytes"), percent.alias("delta_percent"))


def path_class(path: Column, placeholder: Column, git_root: Column, classes: tuple[tuple[str, str], ...]) -> Column:
    """One location label: placeholder, repository, a special folder in the order of the table, other."""
    out = F.when(placeholder, "cloud_sync_placeholder").when(git_root.isNotNull(), "git_repo")
    for segment, label in classes:
        out = out.when(P.has_segment(path, segment), label)
    return out.otherwise("other")


def composed(names: pd.Series) -> pd.Series:
    """Names in their composed form, in which equal names are equal strings."""
    return names.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def reread(asked: DataFrame, inv: DataFrame) -> DataFrame:
    """(asked, path, ...): the rows of an inventory that asked paths stand for, by folder and composed name; none for paths that aren't there.

    Only names may be written in another form; folders are as they are. Names without
    other than plain letters need no composing.
    """
    compose = F.pandas_udf(composed, "string")
    plain = lambda c: F.when(F.rlike(c, F.lit("^[\\x00-\\x7F]*$")), c).otherwise(compose(c))
    left = asked.select(F.col("path").alias("asked"), P.parent_of(F.col("path")).alias("_f"), plain(P.name_of(F.col("path"))).alias("_k"))
    right = inv.withColumn("_f", P.parent_of(F.col("path"))).withColumn("_k", plain(P.name_of(F.col("path"))))
    return left.join(right, ["_f", "_k"]).drop("_f", "_k")


def live_subtree(inv: DataFrame, root: str) -> DataFrame:
    """The root and what is below it, without what lies behind a link or other reparse point, which itself is there."""
    rows = inv.filter(P.in_subtree(F.col("path"), root))
    gates = rows.filter(F.col("is_reparse_point")).select(F.col("path").alias("a"))
    behind = rows.select("path", F.explode(P.proper_ancestors(F.col("path"))).alias("a")).join(gates, "a", "left_semi").select("path").distinct()
    return rows.join(behind, "path", "left_anti")


def has_any(inv: DataFrame) -> DataFrame:
    """One row: whether there is any record; the scan ends at the first."""
    return inv.select(F.lit(1)).limit(1).agg((F.count(F.lit(1)) > 0).alias("has_any"))

"""Rule detectors and the assembly of candidates."""

from __future__ import annotations

import math
import re
from difflib import SequenceMatcher
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import paths as P
from siltstone.operators import inventory as I
from siltstone.operators import rules as R
from siltstone.operators import safety as S
from siltstone.sources.shared import written


def _raw(df: DataFrame, group: str, category: Column | str, ordinal: int) -> DataFrame:
    c = F.lit(category) if isinstance(category, str) else category
    return df.select("path", F.lit(group).alias("category_group"), c.alias("category"), F.lit(ordinal).alias("ordinal"))


def dev_artifacts(inv: DataFrame) -> DataFrame:
    """Build and dependency directories beside one of their manifests, and byte-code caches anywhere."""
    dirs = inv.filter(F.col("is_dir") & F.lower("name").isin(*(d for d, _, _ in R.DEV_ARTIFACTS), R.BYTECODE_DIR))
    pairs = F.lit(None).cast("array<string>")
    category = F.lit(None).cast("string")
    for name, kind, manifests in R.DEV_ARTIFACTS:
        pairs = F.when(F.lower("name") == name, F.array(*map(F.lit, manifests))).otherwise(pairs)
        category = F.when(F.lower("name") == name, F.lit(kind)).otherwise(category)
    needs = dirs.filter(F.lower("name") != R.BYTECODE_DIR).select("path", "parent", category.alias("category"), F.explode(pairs).alias("manifest"))
    known = sorted({m for _, _, ms in R.DEV_ARTIFACTS for m in ms})
    have = inv.filter(~F.col("is_dir") & F.col("name").isin(*known)).select("parent", F.col("name").alias("manifest"))
    proven = needs.join(have, ["parent", "manifest"], "left_semi").select("path", "category").distinct()
    free = dirs.filter(F.lower("name") == R.BYTECODE_DIR).select("path", F.lit("dev_artifact_pycache").alias("category"))
    return _raw(proven.unionByName(free), "dev_artifacts", F.col("category"), 1)


def matching_first(inv: DataFrame, patterns: tuple[str, ...]) -> DataFrame:
    """(path, nth): rows that match a glob and the number of the first that does."""
    nth = F.lit(None).cast("int")
    for k in range(len(patterns) - 1, -1, -1):
        nth = F.when(P.matches_glob(F.col("path"), patterns[k]), F.lit(k)).otherwise(nth)
    return inv.withColumn("nth", nth).filter(F.col("nth").isNotNull())


def package_caches(inv: DataFrame, patterns: tuple[str, ...]) -> DataFrame:
    """Directories at configured places."""
    return _raw(matching_first(inv.filter("is_dir"), patterns), "package_caches", "package_cache", 2)


def model_caches(inv: DataFrame, patterns: tuple[str, ...], exts: tuple[str, ...] = R.MODEL_EXTENSIONS) -> DataFrame:
    """Directories at configured places, and model files below those."""
    dirs = matching_first(inv.filter("is_dir"), patterns)
    files = matching_first(inv.filter(~F.col("is_dir") & F.col("ext").isin(*exts)), tuple(f"{p}/*" for p in patterns))
    return _raw(dirs.unionByName(files), "model_caches", "model_cache", 3)


def temp_and_browser_caches(inv: DataFrame, cache_globs: tuple[str, ...], temp_globs: tuple[str, ...], now: float, hours: float = R.TEMP_AGE_HOURS) -> DataFrame:
    """Browser and thumbnail caches, and old enough children of temp directories."""
    kind = F.when(F.lower("name").startswith("thumbcache_"), "thumbnail_cache").otherwise("browser_cache")
    caches = matching_first(inv, cache_globs).select("path", kind.alias("category"))
    roots = matching_first(inv.filter("is_dir"), temp_globs).select(F.col("path").alias("parent"))
    old = inv.join(roots, "parent", "left_semi").filter((F.lit(now) - F.col("mtime")) / 3600.0 >= hours)
    return _raw(caches.unionByName(old.select("path", F.lit("temp_file").alias("category"))), "temp_and_browser_caches", F.col("category"), 4)


def crash_dumps(inv: DataFrame, root_globs: tuple[str, ...]) -> DataFrame:
    """Dump files anywhere, and children of the configured directories."""
    files = inv.filter(~F.col("is_dir") & (F.col("ext") == ".dmp")).select("path")
    roots = matching_first(inv.filter("is_dir"), root_globs).select(F.col("path").alias("parent"))
    return _raw(files.unionByName(inv.join(roots, "parent", "left_semi").select("path")), "crash_dumps", "crash_dump", 5)


def old_installers(inv: DataFrame, now: float, days: int = R.INSTALLER_AGE_DAYS) -> DataFrame:
    """Installers in a downloads directory, old enough."""
    rows = inv.filter(~F.col("is_dir") & F.col("ext").isin(*R.INSTALLER_EXTENSIONS) & P.has_segment(F.col("path"), "downloads"))
    return _raw(rows.filter((F.lit(now) - F.col("mtime")) / R.DAY >= days), "old_installers", "old_installer", 6)


ARCHIVE = f"(?is)^(.*?)(?:{'|'.join(map(re.escape, R.ARCHIVE_SUFFIXES))})$"


def archive_stem(name: Column) -> Column:
    """The name without its archive suffix; null for other files."""
    return F.when(F.rlike(name, F.lit(ARCHIVE)), F.regexp_extract(name, ARCHIVE, 1))


#: Pairs of names that are compared at once, about, where all of two lengths are, and bins of characters.
COMPARED, BINS = 1 << 16, 64


def fewest_common(total: int, ratio: float) -> int:
    """The fewest characters that two names of so many together have in common where SequenceMatcher's ratio is as wanted."""
    m = max(0, math.ceil(ratio * total / 2) - 1)
    while 2.0 * m / total < ratio:
        m += 1
    return m


def common_bound(a: pd.Series, b: pd.Series) -> np.ndarray:
    """For each two names, no fewer characters than SequenceMatcher can match."""

    def counts(names: pd.Series) -> np.ndarray:
        code = np.frombuffer("".join(names).encode("utf-32-le"), dtype=np.uint32) % BINS
        row = np.repeat(np.arange(len(names)), names.str.len().to_numpy(dtype=np.int64))
        return np.bincount(row * BINS + code, minlength=len(names) * BINS).reshape(-1, BINS)

    return np.minimum(counts(a), counts(b)).sum(axis=1)


def archive_pairs(inv: DataFrame, ratio: float = R.ARCHIVE_RATIO) -> DataFrame:
    """Archives with a sibling directory of nearly their name; only the archive is proposed.

    What SequenceMatcher matches is a common subsequence, so two names so alike share one of the fewest characters
    that their lengths ask for. Archives and directories of a folder meet under all of that length, or each with
    each where these are fewer comparisons than subsequences; the ratio itself decides.
    """

    @F.pandas_udf("string")
    def lowered(names: pd.Series) -> pd.Series:
        return names.str.lower()

    @F.pandas_udf("m int, keyed boolean, salts int")
    def ways(la: pd.Series, lb: pd.Series, na: pd.Series, nb: pd.Series) -> pd.DataFrame:
        m = [fewest_common(x + y, ratio) for x, y in zip(la, lb, strict=True)]
        own = [math.comb(x, k) * i + math.comb(y, k) * j for x, y, i, j, k in zip(la, lb, na, nb, m, strict=True)]
        return pd.DataFrame({"m": m, "keyed": [k < i * j for k, i, j in zip(own, na, nb, strict=True)], "salts": [min(i, -(-i * j // COMPARED)) for i, j in zip(na, nb, strict=True)]})

    @F.pandas_udf("array<string>")
    def subsequences(names: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([list({"".join(c) for c in combinations(x, k)}) for x, k in zip(names, m, strict=True)])

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series, m: pd.Series) -> pd.Series:
        out = common_bound(a, b) >= m.to_numpy()
        for k in np.flatnonzero(out):
            out[k] = SequenceMatcher(None, a.iat[k], b.iat[k]).ratio() >= ratio
        return pd.Series(out)

    name = F.when(F.col("is_dir"), F.col("name")).otherwise(archive_stem(F.col("name")))
    named = inv.select("path", "parent", "is_dir", name.alias("name")).filter("name <> ''")
    named = written(named.withColumn("low", lowered("name")).withColumn("n", F.length("low")).drop("name"))
    archives = named.filter(~F.col("is_dir")).select("path", "parent", F.col("low").alias("stem"), F.col("n").alias("la"))
    dirs = named.filter("is_dir").select("parent", F.col("low").alias("sibling"), F.col("n").alias("lb")).distinct()
    of_a = archives.groupBy("parent", "la").agg(F.count(F.lit(1)).alias("na"))
    of_b = dirs.groupBy("parent", "lb").agg(F.count(F.lit(1)).alias("nb"))
    plan = of_a.join(of_b, "parent").filter(2 * F.least("la", "lb") >= ratio * (F.col("la") + F.col("lb")))
    plan = written(plan.withColumn("w", ways("la", "lb", "na", "nb")).select("parent", "la", "lb", "w.*"))
    salt = lambda k: F.concat(F.lit("/"), k.cast("string"))

    def meeting(rows: DataFrame, low: str, n: str, alone: Column) -> DataFrame:
        with_plan = rows.join(plan, ["parent", n])
        keyed = with_plan.filter("keyed").withColumn("key", F.explode(subsequences(low, "m")))
        return keyed.unionByName(with_plan.filter("NOT keyed").withColumn("key", F.explode(alone))).drop("keyed", "salts")

    x = meeting(archives, "stem", "la", F.array(salt(F.pmod(F.xxhash64("path"), F.col("salts")))))
    y = meeting(dirs, "sibling", "lb", F.transform(F.sequence(F.lit(0), F.col("salts") - 1), salt)).drop("m")
    both = x.join(y, ["parent", "la", "lb", "key"])
    found = both.filter(alike("stem", "sibling", "m")).select("path").distinct()
    return _raw(found, "archive_pairs", "archive_pair", 7)


def large_logs(inv: DataFrame, now: float, least: int = R.LOG_BYTES, days: int = R.LOG_AGE_DAYS) -> DataFrame:
    """Large logs not written for long."""
    log = (F.col("ext") == ".log") | F.contains(F.lower("name"), F.lit("log"))
    return _raw(inv.filter(~F.col("is_dir") & (F.col("size") >= least) & log & ((F.lit(now) - F.col("mtime")) / R.DAY >= days)), "large_logs", "large_log", 8)


def run_all(inv: DataFrame, now: float, package_globs: tuple[str, ...], model_globs: tuple[str, ...], cache_globs: tuple[str, ...], temp_globs: tuple[str, ...], dump_globs: tuple[str, ...], model_exts: tuple[str, ...] = R.MODEL_EXTENSIONS, log_bytes: int = R.LOG_BYTES) -> DataFrame:
    """The raw candidates of all detectors in their fixed order; ``ordinal`` says which comes first."""
    found = (
        dev_artifacts(inv),
        package_caches(inv, package_globs),
        model_caches(inv, model_globs, model_exts),
        temp_and_browser_caches(inv, cache_globs, temp_globs, now),
        crash_dumps(inv, dump_globs),
        old_installers(inv, now),
        archive_pairs(inv),
        large_logs(inv, now, log_bytes),
    )
    return reduce(DataFrame.unionByName, found)


def first_wins(raw: DataFrame) -> DataFrame:
    """One row per path: the one of the earliest detector."""
    order = Window.partitionBy("path").orderBy("ordinal", "category")
    return raw.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def without_nested(raw: DataFrame, inv: DataFrame) -> DataFrame:
    """Candidates that no candidate directory contains; a kept one exists above exactly if any does."""
    dirs = raw.join(inv.filter("is_dir").select("path"), "path", "left_semi").select(F.col("path").alias("a"))
    inside = raw.select("path", F.explode(P.proper_ancestors(F.col("path"))).alias("a")).join(dirs, "a", "left_semi").select("path").distinct()
    return raw.join(inside, "path", "left_anti")


def assembled(raw: DataFrame, inv: DataFrame, mode: str = "power") -> DataFrame:
    """Candidates with size, verdict, tier and retention.

    Rows missing from the inventory and blocked ones go. Tier B where the mode is safe,
    the verdict asks for review, the group is off by default, or models are cached;
    else A. A directory counts with the files below it.
    """
    chosen = without_nested(first_wins(raw), inv)
    table = S.categories(mode)
    on, days = F.lit(False), F.lit(None).cast("int")
    for g, (enabled, keep, _) in table.items():
        on = F.when(F.col("category_group") == g, F.lit(enabled)).otherwise(on)
        days = F.when(F.col("category_group") == g, F.lit(keep).cast("int")).otherwise(days)
    rows = chosen.join(inv, "path")
    rows = S.with_verdict(rows, dev_artifacts=table["dev_artifacts"][0]).filter(F.col("verdict") != S.BLOCKED)
    totals = I.directory_totals(inv).select("path", "subtree_bytes")
    rows = rows.join(totals, "path", "left")
    tier = F.when(F.lit(mode == "safe") | (F.col("verdict") == S.REVIEW) | ~on | (F.col("category_group") == "model_caches"), "B").otherwise("A")
    return rows.select(
        "path",
        "is_dir",
        "category_group",
        "category",
        F.when(F.col("is_dir"), F.coalesce("subtree_bytes", F.lit(0))).otherwise(F.col("size")).alias("size_bytes"),
        "verdict",
        "reason_code",
        tier.alias("tier"),
        days.alias("retention_days"),
    )


def link_aware(candidates: DataFrame, inv: DataFrame) -> DataFrame:
    """(path, freeable_bytes) of directory candidates: what their files free once links are resolved.

    Files of one link are added up; only those of several meet by file within a directory.
    """
    dirs = candidates.filter("is_dir").select(F.col("path").alias("root"))
    members = inv.filter(~F.col("is_dir") & ~F.col("is_cloud_placeholder"))
    under = members.withColumn("root", F.explode(P.proper_ancestors(F.col("path")))).join(dirs, "root", "left_semi")
    lost = F.col("nlink").isNull() | F.col("is_reparse_point")
    unknown = (F.col("dev") == 0) & (F.col("ino") == 0)
    one = under.filter(~lost & (F.col("nlink") <= 1)).groupBy("root").agg(F.sum("size").alias("bytes"))
    files = under.filter((F.col("nlink") > 1) & ~unknown).groupBy("root", "dev", "ino")
    files = files.agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("size", "nlink", lost.alias("lost")), "path").alias("f"))
    several = files.filter(~F.col("f.lost") & (F.col("n") >= F.col("f.nlink"))).groupBy("root").agg(F.sum("f.size").alias("bytes"))
    sums = one.unionByName(several).groupBy("root").agg(F.sum("bytes").cast("long").alias("freeable_bytes"))
    return dirs.join(sums, "root", "left").select(F.col("root").alias("path"), F.coalesce("freeable_bytes", F.lit(0)).alias("freeable_bytes"))

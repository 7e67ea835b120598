"""Selections, caches and checks around candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators import safety as Y


def ineligible(members: DataFrame, env_of: DataFrame, managed: Column) -> DataFrame:
    """Members that aren't kept with the reason why they can't be removed: model_cache_managed, cross_environment, or null.

    ``env_of`` has (path, marker), the nearest environment of each path. A duplicate in an
    environment other than the kept copy's is cross_environment; one in none is fine.
    """
    env = env_of.select("path", F.col("marker").alias("env"))
    keep = env_of.select(F.col("path").alias("keep_path"), F.col("marker").alias("keep_env"))
    rows = members.filter(~F.col("is_keep")).join(env, "path", "left").join(keep, "keep_path", "left")
    cross = F.col("env").isNotNull() & ~F.col("env").eqNullSafe(F.col("keep_env"))
    return rows.withColumn("ineligible", F.when(managed, "model_cache_managed").when(cross, "cross_environment"))


def shared_elsewhere(rows: DataFrame, env: str) -> DataFrame:
    """(path, shared): whether another link of the file lies in another environment."""
    known = F.col("dev").isNotNull() & ((F.col("dev") != 0) | (F.col("ino") != 0))
    envs = rows.filter(known).groupBy("dev", "ino").agg(F.min(env).alias("lo"), F.max(env).alias("hi"))
    out = rows.join(envs, ["dev", "ino"], "left")
    return out.select("path", F.coalesce(F.col("lo") != F.col("hi"), F.lit(False)).alias("shared"))


def identity_changed(recorded: DataFrame, live: DataFrame) -> DataFrame:
    """(path, changed): the live identity differs from the recorded one; unreadable paths and unrecorded identities don't count."""
    now = live.select("path", F.col("dev").alias("d"), F.col("ino").alias("i"))
    unknown = (F.col("dev") == 0) & (F.col("ino") == 0)
    changed = F.col("d").isNotNull() & ~unknown & ((F.col("d") != F.col("dev")) | (F.col("i") != F.col("ino")))
    return recorded.join(now, "path", "left").select("path", F.coalesce(changed, F.lit(False)).alias("changed"))


def resolved(asked: DataFrame, cands: DataFrame, inv: DataFrame, days: int = 30) -> DataFrame:
    """Asked paths as items: candidates as they are; other known paths judged again and, if not blocked, as user_selected in tier B."""
    found = cands.join(asked.select("path").distinct(), "path", "left_semi").select("path", "category_group", "tier", "retention_days")
    rest = asked.select("path").distinct().join(cands.select("path"), "path", "left_anti")
    own = Y.with_verdict(inv.join(rest, "path", "left_semi")).filter(F.col("verdict") != Y.BLOCKED)
    return found.unionByName(own.select("path", F.lit("user_selected").alias("category_group"), F.lit("B").alias("tier"), F.lit(days).alias("retention_days")))


def cached(rows: DataFrame, cache: DataFrame, key: tuple[str, ...] = ("path", "size", "mtime", "model")) -> DataFrame:
    """Rows with hit: whether the cache holds their whole key."""
    known = cache.select(*key).distinct().withColumn("hit", F.lit(True))
    return rows.join(known, list(key), "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def confident_text(lines: DataFrame, image: str, order: str, text: str, confidence: str, least: float = 0.5) -> DataFrame:
    """(image, text): recognised lines of enough confidence in order; null where none is left. An image has few lines."""
    ok = F.when(F.col(confidence) >= least, F.struct(F.col(order).alias("o"), F.col(text).alias("t")))
    joined = lines.groupBy(image).agg(F.sort_array(F.collect_list(ok)).alias("l"))
    return joined.select(image, F.when(F.size("l") > 0, F.array_join("l.t", "\n")).alias("text"))


def quality(sharpness: Column, pixels: Column, spread: Column) -> Column:
    """The combined quality of an image."""
    return 2 * F.log1p(sharpness) + F.log1p(pixels) - 0.05 * F.abs(spread - 60)


def keep_best(members: DataFrame, cluster: str, score: str, id_col: str = "id") -> DataFrame:
    """Members with is_keep: the best score of each cluster, the least id on ties."""
    best = members.groupBy(cluster).agg(F.max_by(id_col, F.struct(F.col(score), -F.col(id_col))).alias("_k"))
    return members.join(best, cluster).withColumn("is_keep", F.col(id_col) == F.col("_k")).drop("_k")


def routed(members: DataFrame, cluster: str, rank: Column) -> DataFrame:
    """(cluster, track): version_chain if any member has a version rank, else near_duplicate."""
    return members.groupBy(cluster).agg(F.when(F.bool_or(rank.isNotNull()), "version_chain").otherwise("near_duplicate").alias("track"))


def stratified(pairs: DataFrame, clustered: DataFrame, each: int = 60, seed: int = 42) -> DataFrame:
    """At most ``each`` pairs (a, b, distance) of each distance bin, in the order of a seeded hash, without clustered ones."""
    bin_ = F.when(F.col("distance") <= 10, "near").when(F.col("distance") <= 25, "middle").otherwise("far")
    rest = pairs.join(clustered.select("a", "b"), ["a", "b"], "left_anti").withColumn("bin", bin_)
    order = Window.partitionBy("bin").orderBy(F.sha2(F.concat_ws("-", F.col("a"), F.col("b"), F.lit(seed)), 256))
    return rest.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= each).drop("_r")


def unanimous(grades: DataFrame, judges: int) -> DataFrame:
    """(n_complete, n_unanimous, excluded_share) of (record, judge, grade)."""
    g = grades.groupBy("record").agg(F.count("grade").alias("n"), (F.min("grade") == F.max("grade")).alias("same"))
    out = g.agg(F.count(F.lit(1)).alias("n_all"), F.sum((F.col("n") == judges).cast("long")).alias("n_complete"), F.sum(((F.col("n") == judges) & F.col("same")).cast("long")).alias("n_unanimous"))
    return out.select("n_complete", "n_unanimous", (1 - F.col("n_unanimous") / F.col("n_all")).alias("excluded_share"))


def chunks(df: DataFrame, id_col: str, text_col: str, words_each: int = 300) -> DataFrame:
    """(id, chunk, text): texts cut into chunks of that many words; the last one takes what is left."""
    words = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")
    rows = df.select(F.col(id_col), words.alias("w")).filter(F.size("w") > 0)
    n = F.ceil(F.size("w") / words_each).cast("int")
    spread = rows.select(id_col, "w", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk"))
    return spread.select(id_col, "chunk", F.array_join(F.slice("w", F.col("chunk") * words_each + 1, F.lit(words_each)), " ").alias("text"))


def cleaned(text: Column) -> Column:
    """A text with runs of blanks as one and lines trimmed."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "[ \\t]+", " "), " ?\\n ?", "\n")


def transitions(requests: DataFrame, phrase: str) -> DataFrame:
    """Mode changes with accepted: leaving the safe mode takes the exact phrase, going back nothing."""
    return requests.withColumn("accepted", (F.col("to_mode") == "safe") | (F.col("phrase") == phrase))


def vault_audit(last: DataFrame, present: DataFrame) -> DataFrame:
    """How many vault items were looked at, and how many aren't where the log has them."""
    v = last.filter((F.col("method") == "vault") & ~F.col("restored") & ~F.col("purged"))
    have = present.select(F.col("path").alias("vault_path")).distinct().withColumn("_h", F.lit(True))
    both = v.join(have, "vault_path", "left")
    return both.agg(F.count(F.lit(1)).alias("n_checked"), F.coalesce(F.sum(F.col("_h").isNull().cast("long")), F.lit(0)).alias("n_missing"))


def postcondition(operation: Column, source_there: Column, target_there: Column) -> Column:
    """Whether what is on disk fits an operation: its source gone and, but for deletes, its target there."""
    moved = operation.isin("vault", "restore")
    return F.when(source_there, "source_remains").when(moved & ~target_there, "target_missing").otherwise("ok")


def eta_seconds(done: Column, total: Column, elapsed: Column) -> Column:
    """Seconds left at the present rate; null before anything is done."""
    rate = done / elapsed
    return F.when((done <= 0) | (elapsed <= 0) | total.isNull(), F.lit(None).cast("double")).otherwise(F.greatest(total - done, F.lit(0)) / rate)


def cloud_root(name: Column, marked: Column) -> Column:
    """Whether a directory looks like the root of a cloud folder."""
    low = F.lower(name)
    return low.startswith("onedrive") | low.startswith("dropbox") | low.startswith("google drive") | marked


def pair_keys(members: DataFrame, cluster: str, item: str) -> DataFrame:
    """(cluster, a, b): unordered pairs within small clusters, for labelling."""
    x, y = members.select(cluster, F.col(item).alias("a")), members.select(cluster, F.col(item).alias("b"))
    return x.join(y, cluster).filter("a < b")

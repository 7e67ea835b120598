"""The engine's relations built from the driver's tables, for queries and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import paths as P

NOW = 1_700_000_000.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of an inventory, with their texts as content."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    top = F.concat(F.lit("/"), F.col("source"), F.lit("/"), F.col("lang"))
    project = F.concat(top, F.lit("/projects/p"), (i % 37).cast("string"))
    at = lambda base, a, b: F.concat(base, F.lit(a), i.cast("string"), F.lit(b))
    k = i % 10
    path = (
        F.when(k == 0, at(top, "/downloads/setup_", ".exe"))
        .when(k == 1, at(top, "/logs/app_", ".log"))
        .when(k == 2, at(project, "/node_modules/f", ".js"))
        .when(k == 3, at(top, "/temp/t", ".tmp"))
        .when(k == 4, F.concat(top, F.lit("/docs/report_v"), (i % 7).cast("string"), F.lit("_"), i.cast("string"), F.lit(".txt")))
        .when(k == 5, at(project, "/src/main_", ".py"))
        .when(k == 6, at(top, "/crash/dump_", ".dmp"))
        .when(k == 7, at(top, "/docs/tax_", ".pdf"))
        .when(k == 8, at(top, "/downloads/pack_", ".zip"))
        .otherwise(at(top, "/keys/key_", ".pem"))
    )
    linked = k.isin(3, 8)
    rooted = k.isin(2, 5) & ((i % 37) % 3 == 0)
    mtime = F.lit(NOW) - ((i % 400) * 86400).cast("double")
    return d.select(
        path.alias("path"),
        F.lit(False).alias("is_dir"),
        (F.col("n_chars") * 1000).alias("size"),
        mtime.alias("mtime"),
        (mtime - (i % 11).cast("double")).alias("ctime"),
        F.lit(1).cast("long").alias("dev"),
        F.when(linked & (i % 20 >= 10), i - 10).otherwise(i).alias("ino"),
        F.when(linked, 2 + (F.floor(i / 20) % 3 == 0).cast("int")).otherwise(1).cast("int").alias("nlink"),
        F.when(rooted, project).alias("git_repo_root"),
        (rooted & ((i % 37) % 6 == 0)).alias("git_repo_clean"),
        (i % 50 == 7).alias("is_cloud_placeholder"),
        (i % 97 == 0).alias("is_reparse_point"),
        i.alias("file_id"),
        F.col("text").alias("content"),
    )


def inventory(spark: SparkSession, sf_dir: str, content: bool = False) -> DataFrame:
    """Files, manifests of some projects and all directories above them."""
    real = files(spark, sf_dir)
    i = F.col("file_id")
    made = real.filter((i % 10 == 2) & ((i % 37) % 2 == 0)).select(F.concat(F.regexp_extract("path", "^(.*/p[0-9]+)/", 1), F.lit("/package.json")).alias("path")).distinct()
    blank = {"size": 100, "mtime": NOW, "ctime": NOW, "dev": 1, "ino": 0, "nlink": 1}
    fill = lambda df, is_dir, size: df.select(
        "path",
        F.lit(is_dir).alias("is_dir"),
        F.lit(size).cast("long").alias("size"),
        F.lit(blank["mtime"]).alias("mtime"),
        F.lit(blank["ctime"]).alias("ctime"),
        F.lit(0).cast("long").alias("dev"),
        F.lit(0).cast("long").alias("ino"),
        F.lit(1).alias("nlink"),
        F.when(root_index % 3 == 0, F.regexp_extract("path", ROOT, 1)).alias("git_repo_root"),
        F.coalesce(root_index % 6 == 0, F.lit(False)).alias("git_repo_clean"),
        F.lit(False).alias("is_cloud_placeholder"),
        F.lit(False).alias("is_reparse_point"),
        F.lit(None).cast("long").alias("file_id"),
        F.lit(None).cast("string").alias("content"),
    )
    root_index = F.nullif(F.regexp_extract("path", ROOT, 2), F.lit("")).cast("int")
    dirs = real.select("path").unionByName(made).select(F.explode(P.proper_ancestors(F.col("path"))).alias("path")).distinct()
    out = real.unionByName(fill(made, False, 100)).unionByName(fill(dirs, True, 0))
    out = out if content else out.drop("content")
    name = P.name_of(F.col("path"))
    return out.withColumn("name", name).withColumn("parent", P.parent_of(F.col("path"))).withColumn("ext", F.when(F.col("is_dir"), F.lit("")).otherwise(P.ext_of(name)))


ROOT = "^(/[^/]+/[^/]+/projects/p([0-9]+))(?:/|$)"

FILES_SQL = r"""
f0 AS (SELECT doc_id AS i, doc_id % 10 AS k, '/' || source || '/' || lang AS top, n_chars, text FROM documents),
f1 AS (SELECT *, top || '/projects/p' || (i % 37) AS project, 1700000000.0::DOUBLE - ((i % 400) * 86400)::DOUBLE AS mtime FROM f0),
files AS (
  SELECT CASE k WHEN 0 THEN top || '/downloads/setup_' || i || '.exe' WHEN 1 THEN top || '/logs/app_' || i || '.log' WHEN 2 THEN project || '/node_modules/f' || i || '.js'
    WHEN 3 THEN top || '/temp/t' || i || '.tmp' WHEN 4 THEN top || '/docs/report_v' || (i % 7) || '_' || i || '.txt' WHEN 5 THEN project || '/src/main_' || i || '.py'
    WHEN 6 THEN top || '/crash/dump_' || i || '.dmp' WHEN 7 THEN top || '/docs/tax_' || i || '.pdf' WHEN 8 THEN top || '/downloads/pack_' || i || '.zip' ELSE top || '/keys/key_' || i || '.pem' END AS path,
    false AS is_dir, n_chars * 1000 AS size, mtime, mtime - (i % 11)::DOUBLE AS ctime, 1::BIGINT AS dev,
    CASE WHEN k IN (3, 8) AND i % 20 >= 10 THEN i - 10 ELSE i END AS ino, (CASE WHEN k IN (3, 8) THEN 2 + ((i // 20) % 3 = 0)::INT ELSE 1 END)::INT AS nlink,
    CASE WHEN k IN (2, 5) AND (i % 37) % 3 = 0 THEN project END AS git_repo_root, k IN (2, 5) AND (i % 37) % 3 = 0 AND (i % 37) % 6 = 0 AS git_repo_clean,
    i % 50 = 7 AS is_cloud_placeholder, i % 97 = 0 AS is_reparse_point, i AS file_id, text AS content
  FROM f1)"""

INVENTORY_SQL = (
    FILES_SQL
    + r""",
made AS (SELECT DISTINCT regexp_extract(path, '^(.*/p[0-9]+)/', 1) || '/package.json' AS path FROM files WHERE file_id % 10 = 2 AND (file_id % 37) % 2 = 0),
steps AS (SELECT string_split(path, '/') AS s FROM (SELECT path FROM files UNION ALL SELECT path FROM made)),
dirs AS (SELECT DISTINCT array_to_string(s[1:n], '/') AS path FROM (SELECT s, unnest(range(2, len(s))) AS n FROM steps)),
rest AS (SELECT path, false AS is_dir, 100::BIGINT AS size FROM made UNION ALL SELECT path, true, 0::BIGINT FROM dirs),
rooted AS (SELECT *, regexp_extract(path, '^(/[^/]+/[^/]+/projects/p([0-9]+))(?:/|$)', 1) AS r, TRY_CAST(regexp_extract(path, '^(/[^/]+/[^/]+/projects/p([0-9]+))(?:/|$)', 2) AS INT) AS n FROM rest),
base AS (
  SELECT * FROM files
  UNION ALL SELECT path, is_dir, size, 1700000000.0, 1700000000.0, 0, 0, 1, CASE WHEN n % 3 = 0 THEN r END, coalesce(n % 6 = 0, false), false, false, NULL, NULL FROM rooted),
inv AS (
  SELECT *, regexp_extract(path, '[^/]*$') AS name, regexp_replace(path, '/[^/]*$', '') AS parent,
    CASE WHEN is_dir THEN '' ELSE lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+(\.[^.]+)$', 1)) END AS ext FROM base)"""
)

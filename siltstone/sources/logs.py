"""JSON-lines logs with explicit schemas and defaults for older lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = (
    "seq long, batch_id string, original_path string, size_bytes long, is_dir boolean, category string, method string, vault_path string, "
    "retention_days int, at double, retention_until double, restored boolean, purged boolean, phase string, intent_id string, operation string, schema_version int"
)
#: What older lines lack.
DEFAULTS = {"restored": False, "purged": False, "is_dir": False, "phase": "done", "operation": "apply", "schema_version": 1}


def with_defaults(events: DataFrame) -> DataFrame:
    """Missing fields of older lines filled in."""
    return events.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in DEFAULTS.items() if c in events.columns})


def read_event_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The events of a log and its malformed lines (``value``), which are no events.

    Blank lines are skipped, unknown fields ignored, missing ones of older lines filled in.
    """
    good, bad = parsed(spark.read.option("recursiveFileLookup", "true").text(path), EVENTS)
    return with_defaults(good), bad


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The events of a log, without its malformed lines."""
    return read_event_log(spark, path)[0]


def append_events(events: DataFrame, path: str, batch: str | None = None) -> None:
    """Events added to a log folder.

    A batch with an id has a folder of its own, which writing the same batch again
    replaces, so a rerun adds nothing twice.
    """
    if batch is None:
        events.write.mode("append").json(path)
    else:
        named = events.withColumn("sink_batch", F.lit(batch))
        named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("sink_batch").json(path)


def append_stream(events: DataFrame, path: str, checkpoint: str, name: str = "stream") -> StreamingQuery:
    """A stream of events into a log folder, each micro-batch once, however often it is tried."""
    add = lambda batch, number: append_events(batch, path, f"{name}-{number}")
    return events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def parsed(lines: DataFrame, schema: str, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """JSON lines as rows, and the lines that aren't JSON objects."""
    row = lines.withColumn("_p", F.from_json(column, f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE"}))
    bad = F.col("_p").isNull() | F.col("_p._corrupt_record").isNotNull()
    used = row.filter(F.trim(column) != "")
    return used.filter(~bad).select("_p.*").drop("_corrupt_record"), used.filter(bad).select(column)


def read_vault_table(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A tab-separated list of three columns (original, vault, size), and its malformed lines."""
    lines = spark.read.text(path).withColumn("value", F.regexp_replace("value", "^﻿", ""))
    cells = lines.withColumn("c", F.split("value", "\t"))
    size = F.get("c", F.lit(2)).try_cast("long")
    good = (F.size("c") == 3) & size.isNotNull()
    rows = cells.filter(good).select(F.get("c", F.lit(0)).alias("original_path"), F.get("c", F.lit(1)).alias("vault_path"), size.alias("size_bytes"))
    return rows, cells.filter(~F.coalesce(good, F.lit(False)) & (F.trim("value") != "")).select("value")

"""Streams run to the end of their input, against the batch forms."""

import random
import time

from siltstone.streaming import folds


def test_alerts(spark, tmp_path):
    rows = [("c", 0.0, 5.0, 10.0), ("c", 10.0, 4.0, 10.0), ("c", 40.0, 3.0, 10.0), ("d", 5.0, 50.0, 10.0)]
    spark.createDataFrame(rows, "volume string, at double, free double, threshold double").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("volume string, at double, free double, threshold double").parquet(str(tmp_path / "in"))
    q = folds.alert_stream(source, 30.0).writeStream.format("memory").queryName("alerts").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    out = {(r["volume"], r["at"]): r["state"] for r in spark.table("alerts").collect()}
    assert out == {("c", 0.0): "notify", ("c", 10.0): "debounced", ("c", 40.0): "notify", ("d", 5.0): "ok"}


def expected(rows, debounce):
    out, last, until = {}, {}, {}
    for seq, v, at, kind, free, threshold, enabled, days in sorted(rows, key=lambda r: (r[2], r[0])):
        if kind == "snooze":
            until[v] = at + days * 86400
        elif not enabled:
            out[seq] = "disabled"
        elif free is None:
            out[seq] = "failed"
        elif free >= threshold:
            out[seq] = "ok"
        elif at < until.get(v, -1):
            out[seq] = "snoozed"
        elif v in last and at - last[v] < debounce:
            out[seq] = "debounced"
        else:
            out[seq], last[v] = "notify", at
    return out


def test_alert_states(spark, tmp_path, monkeypatch):
    """The states over several micro-batches, with snoozes that end in between, are those of one pass in order."""
    from pyspark.sql import functions as F

    from siltstone.streaming import alerts as A

    rng = random.Random(2)
    rows = [(i, f"v{rng.randrange(3)}", float(1000 + i * 900), rng.choice(["reading"] * 6 + ["snooze"]), rng.choice([None, 1.0, 5.0, 20.0]), 10.0, rng.random() > 0.1, rng.choice([0.0, 0.05, 0.5])) for i in range(240)]
    schema = "seq long, volume string, at double, kind string, free double, threshold double, enabled boolean, days double"
    for k in range(3):
        part = spark.createDataFrame(rows[80 * k : 80 * k + 80], schema).withColumn("ts", F.timestamp_micros((F.col("at") * 1_000_000).cast("long")))
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"k={k}"))
        time.sleep(1.1)  # so that files are read in order
    source = spark.readStream.schema(f"{schema}, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, A.STORE)
    try:
        q = A.alerts(source, 7200.0).writeStream.format("memory").queryName("states").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
        q.awaitTermination()
    finally:
        spark.conf.set(name, before)
    assert {r["seq"]: r["state"] for r in spark.table("states").collect()} == expected(rows, 7200.0)


def test_events_are_appended_once(spark, tmp_path):
    from siltstone.sources import logs as L

    spark.createDataFrame([(i, "b") for i in range(20)], "seq long, batch_id string").repartition(4).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema("seq long, batch_id string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for checkpoint in ("c1", "c1", "c2"):  # the last run has lost its checkpoint and tries all batches again
        L.append_stream(source(), str(tmp_path / "log"), str(tmp_path / checkpoint)).awaitTermination()
    assert sorted(r["seq"] for r in L.read_events(spark, str(tmp_path / "log")).collect()) == list(range(20))

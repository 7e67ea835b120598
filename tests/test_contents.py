"""Contents are hashed where they are read."""

import re

import pyarrow as pa

from siltstone.operators import duplicates as U
from siltstone.sources import files as X


def test_no_content_is_shuffled(spark):
    rows = [(f"/{i}", False, 1000 + i % 3, False, None if i == 9 else "abc"[i % 3] * 50 + ("x" if i == 4 else "")) for i in range(12)]
    inv = spark.createDataFrame(rows, "path string, is_dir boolean, size long, is_cloud_placeholder boolean, content string")
    out = U.clusters(inv, 1, 5)
    got = {(r["path"], r["cluster_size"]) for r in out.collect()}
    assert got == {(f"/{i}", n) for n, own in ((3, (0, 3, 6)), (3, (1, 7, 10)), (4, (2, 5, 8, 11))) for i in own}
    passed_on = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Project" in x and re.search(r"[\[ ]content#\d+[,\]]", x)]
    assert not passed_on and "content" not in out.columns


def test_few_files_are_held_at_once():
    batch = pa.RecordBatch.from_arrays([pa.array(range(1001))], names=["x"])
    got = list(X.small(iter([batch, batch.slice(0, 0), batch])))
    assert max(b.num_rows for b in got) <= 200 and [v for b in got for v in b.column(0).to_pylist()] == [*range(1001), *range(1001)]

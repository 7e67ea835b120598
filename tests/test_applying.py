"""Refusals of whole batches, and the order of their logs."""

import pytest

from siltstone.operators import applying as A

SCHEMA = "batch_id string, path string, requested_method string, retention_days int, size_bytes long, entry_count long, size_guard_exempt boolean, rebuildable boolean, verdict string, in_use boolean, is_shared boolean, is_changed boolean, subtree_differs boolean"


def item(batch, path, days=30, size=10, entries=1, rebuildable=True, verdict="eligible", method="vault", **flags):
    return (batch, path, method, days, size, entries, False, rebuildable, verdict, *(flags.get(f, False) for f in ("in_use", "is_shared", "is_changed", "subtree_differs")))


ROWS = [
    item("a", "/a1"), item("a", "/a2", days=None), item("a", "/a3", days=None, size=1 << 40), item("a", "/a4", days=None, size=1 << 40, rebuildable=False), item("a", "/a5", in_use=True), item("a", "/a6", days=0),
    item("b", "/b1"), item("b", "/b2", verdict="blocked"),
    item(None, "/n1", days=None, subtree_differs=None), item("c", "/c1", method="recycle_bin"),
]


@pytest.mark.parametrize(("vault", "mode", "refused"), [("/v", "power", {"b": "blocked_item"}), (None, "power", {"a": "no_vault", "b": "no_vault"}), ("/v", "safe", {"a": "safe_mode_method", "b": "safe_mode_method", None: "safe_mode_method"})])
def test_batches(spark, vault, mode, refused):
    plan, log, report = A.applied(spark.createDataFrame(ROWS, SCHEMA), vault, 5.0, mode)
    got = {r["batch_id"]: r["refusal"] for r in report.collect()}
    assert got == {b: refused.get(b) for b in ("a", "b", None, "c")}
    rows = {r["path"]: r for r in plan.collect()}
    assert all((r["outcome"] == "refused") == (r["batch_id"] in refused) for r in rows.values())
    if mode == "safe":
        assert {r["method"] for r in rows.values()} == {"recycle_bin"}
    if not refused.get("a"):
        assert rows["/a5"]["skip_reason"] == "file_in_use" and [p for p, r in sorted(rows.items()) if r["purged_at_once"]] == ["/a3"]
        assert rows["/a4"]["effective_days"] == 30 and rows["/a2"]["vault_path"] is None and rows["/a1"]["vault_path"].startswith("/v/a/")
        events = [(r["original_path"], r["operation"], r["phase"], r["purged"]) for r in log.filter("batch_id = 'a'").orderBy("seq").collect()]
        assert events[-2:] == [("/a3", "purge", "intent", False), ("/a3", "purge", "done", True)] and len(events) == 12
    odd = spark.createDataFrame([item("z", "/z", method="direct_delete"), item("y", "/y", method=None)], SCHEMA)
    assert {r["refusal"] for r in A.planned(odd, vault, mode).collect()} == {"unknown_method"}
    n = log.count()
    assert sorted(r["seq"] for r in log.collect()) == list(range(n)) and n % 2 == 0
    assert A.applied(spark.createDataFrame([], SCHEMA), vault, 5.0, mode)[2].count() == 0

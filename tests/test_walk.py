"""Walking a tree, with what can't be read."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from siltstone.sources import walk as W


def deep(folder):
    """Directories of names so long that the last can't be listed under its path."""
    here, fd = str(folder), os.open(folder, os.O_RDONLY)
    for _ in range(18):
        name = "d" * 250
        os.mkdir(name, dir_fd=fd)
        new = os.open(name, os.O_RDONLY, dir_fd=fd)
        os.close(fd)
        here, fd = f"{here}/{name}", new
    os.close(fd)
    return here


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for i in range(7):
        (root / f"s{i}" / "in").mkdir(parents=True)
        (root / f"s{i}" / "in" / f"f{i}.TXT").write_text("x" * i)
    (root / "top.txt").write_text("top")
    (root / "repo" / ".git").mkdir(parents=True)
    (root / "repo" / "a" / "b").mkdir(parents=True)
    (root / "repo" / "a" / "b" / "c.py").write_text("c")
    (root / "loop").symlink_to(root)
    (root / "gone").symlink_to("/nowhere")
    (root / "long").mkdir()
    deep(root / "long")
    os.link(root / "top.txt", root / "again.txt")
    yield root
    shutil.rmtree(root / "long")


@pytest.mark.parametrize("least", [1, 4, 500])
def test_walk(spark, tree, least):
    every = W.read_tree(spark, f"file://{tree}", least)
    rows = {r["path"]: r for r in W.entries(every).collect()}
    unread = {r["path"] for r in every.filter("error IS NOT NULL").collect()}
    want = {os.path.join(at, n) for at, dirs, names in os.walk(tree) for n in dirs + names}
    assert set(rows) == want - unread and len(unread) == 1
    assert rows[f"{tree}/loop"]["is_reparse_point"] and not rows[f"{tree}/loop"]["is_dir"] and rows[f"{tree}/gone"]["is_reparse_point"]
    f = rows[f"{tree}/s3/in/f3.TXT"]
    assert (f["size"], f["ext"], f["name"], f["parent"]) == (3, ".txt", "f3.TXT", f"{tree}/s3/in")
    assert rows[f"{tree}/top.txt"]["ino"] == rows[f"{tree}/again.txt"]["ino"] and rows[f"{tree}/top.txt"]["nlink"] == 2


def test_skips(spark, tree):
    rows = W.read_tree(spark, str(tree), 4)
    stats = W.scan_stats(rows).first()
    assert stats["n_skipped"] == 1 and stats["skips"][0]["error"].startswith("OSError: File name too long") and stats["skips"][0]["path"].endswith("d" * 250)
    assert stats["n_entries"] == W.entries(rows).count() and stats["n_links"] == 2 and stats["bytes"] >= 21
    missing = W.read_tree(spark, f"{tree}/nothing").collect()
    assert [r["error"].split(":")[0] for r in missing] == ["FileNotFoundError"]


def test_listing_that_breaks_off(monkeypatch, tmp_path):
    """What was listed before an error counts as a lower bound."""
    for i in range(3):
        (tmp_path / f"f{i}").write_text("xy")
    real = os.scandir

    class Broken:
        def __init__(self, path):
            self.inner = real(path)
            self.n = 0

        def __enter__(self):
            return self

        def __exit__(self, *a):
            self.inner.close()

        def __iter__(self):
            return self

        def __next__(self):
            self.n += 1
            if self.n > 2:
                raise PermissionError(13, "Permission denied")
            return next(self.inner)

    monkeypatch.setattr(W.os, "scandir", Broken)
    out = list(W.walked(str(tmp_path)))
    bad = [r for r in out if r[9]]
    assert len(out) == 3 and bad == [(str(tmp_path), *[None] * 8, "PermissionError: Permission denied", 4, True)]


def test_repositories(spark, tree):
    rows = W.entries(W.read_tree(spark, str(tree)))
    clean = spark.createDataFrame([(f"{tree}/repo", True), (f"{tree}/s1", True)], "root string, is_clean boolean")
    out = {r["path"]: (r["git_repo_root"], r["git_repo_clean"]) for r in W.with_repository(rows, clean).collect()}
    assert out[f"{tree}/repo/a/b/c.py"] == (f"{tree}/repo", True) and out[f"{tree}/repo"] == (f"{tree}/repo", True) and out[f"{tree}/s1/in"] == (None, False)
    failed = clean.withColumn("is_clean", F.lit(None).cast("boolean"))
    assert {r["git_repo_clean"] for r in W.with_repository(rows, failed).collect()} == {False}

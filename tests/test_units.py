"""Small cases worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from siltstone.functions import paths as P
from siltstone.functions import scalars as S
from siltstone.operators import detectors as D
from siltstone.operators import duplicates as U
from siltstone.operators import eventlog as E
from siltstone.operators import inventory as I
from siltstone.operators import metrics as M
from siltstone.operators import report as T
from siltstone.operators import safety as Y
from siltstone.operators import similarity as N
from siltstone.operators import tagging as G
from siltstone.sources import files as X
from siltstone.sources import logs as L


def one(spark, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}")


def got(spark, column, value, kind="string"):
    return one(spark, value, kind).select(column.alias("y")).first()["y"]


@pytest.mark.parametrize(("name", "ext"), [("a.txt", ".txt"), (".bashrc", ""), ("a.tar.gz", ".gz"), ("a.", ""), ("noext", ""), ("A.B.C", ".c")])
def test_ext(spark, name, ext):
    assert got(spark, P.ext_of(F.col("x")), name) == ext


def test_paths(spark):
    assert got(spark, P.proper_ancestors(F.col("x")), "/a/b/c") == ["/a", "/a/b"]
    assert got(spark, P.proper_ancestors(F.col("x")), "/a") == []
    assert got(spark, P.in_subtree(F.col("x"), "/a/b"), "/a/bc") is False
    assert got(spark, P.in_subtree(F.col("x"), "/a/b"), "/a/b/c") is True
    assert got(spark, P.matches_glob(F.col("x"), "/a/*.log"), "/a/b/C.LOG") is True
    assert got(spark, P.matches_any(F.col("x"), ("re:secret[0-9]+",)), "/x/SECRET42/y") is True
    assert got(spark, P.matches_any(F.col("x"), ("*/[ab]*.txt",)), "/x/bag.txt") is True
    assert got(spark, P.matches_any(F.col("x"), ("/x/[!ab]*.txt",)), "/x/bag.txt") is False
    assert got(spark, P.is_network_path(F.col("x")), "\\\\host\\share") is True
    assert got(spark, P.is_network_path(F.col("x")), "//?/C:/x") is False


@pytest.mark.parametrize(("n", "text"), [(0, "0 B"), (1023, "1023 B"), (1024, "1.0 KB"), (1280, "1.2 KB"), (5 * 1024**3, "5.0 GB"), (3 * 1024**5, "3072.0 TB")])
def test_format_bytes(spark, n, text):
    assert got(spark, S.format_bytes(F.col("x")), n, "long") == text


@pytest.mark.parametrize(("stem", "rank"), [("report_v3", 3.0), ("report (2)", 2.0), ("report copy", 1.0), ("report_final", 1000.0), ("report_v3_final", 1003.0), ("version 7", 7.0), ("finals", None), ("x", None)])
def test_version_rank(spark, stem, rank):
    assert got(spark, S.version_rank(F.col("x")), stem) == rank


def inventory_row(path, **more):
    base = dict(path=path, is_dir=False, ext="." + path.rpartition(".")[2] if "." in path else "", git_repo_root=None, git_repo_clean=False, is_cloud_placeholder=False)
    return base | more


SCHEMA = "path string, is_dir boolean, ext string, git_repo_root string, git_repo_clean boolean, is_cloud_placeholder boolean"


@pytest.mark.parametrize(
    ("row", "code"),
    [
        (inventory_row("C:/Windows/x.dll"), "protected_system_root"),
        (inventory_row("//host/share/a.txt"), "unc_network_path"),
        (inventory_row("/r/a.py", git_repo_root="/r"), "in_git_repository"),
        (inventory_row("/r/node_modules/a.js", git_repo_root="/r"), "git_node_modules_dirty"),
        (inventory_row("/r/node_modules/a.js", git_repo_root="/r", git_repo_clean=True), "node_modules_exempt"),
        (inventory_row("/k/a.pem"), "protected_extension"),
        (inventory_row("/home/.ssh/config"), "ssh_directory"),
        (inventory_row("/d/a.sqlite"), "database_file"),
        (inventory_row("/d/a.vmdk"), "vm_image"),
        (inventory_row("/u/AppData/Local/Docker/x.bin"), "docker_wsl_root"),
        (inventory_row("/d/a.txt", is_cloud_placeholder=True), "cloud_placeholder"),
        (inventory_row("/d/syntax.txt"), "finance_token"),
        (inventory_row("/ok/invoice.txt"), "finance_token_allowed"),
        (inventory_row("/no/a.txt"), "user_denied"),
        (inventory_row("/d/a.txt"), "default_eligible"),
    ],
)
def test_safety(spark, row, code):
    df = spark.createDataFrame([tuple(row.values())], SCHEMA)
    assert Y.with_verdict(df, deny=("/no/*",), allow=("/ok/*", "/no/*")).first()["reason_code"] == code


def test_links(spark):
    rows = [("/a", 1, 1, 2, False), ("/b", 1, 1, 2, False), ("/c", 1, 2, 3, False), ("/d", 1, 3, 1, False), ("/e", 1, 4, 1, True), ("/f", 1, 5, None, False)]
    df = spark.createDataFrame([(*r, 10) for r in rows], "path string, dev long, ino long, nlink int, is_reparse_point boolean, size long")
    out = {r["path"]: (r["freeable_bytes"], r["resolved"]) for r in I.freeable(df, F.col("path")).collect()}
    assert out == {"/a": (10, True), "/b": (0, True), "/c": (0, True), "/d": (10, True), "/e": (0, False), "/f": (0, False)}
    lost = spark.createDataFrame([("/a", 0, 0, 2, False, 10), ("/b", 0, 0, 2, False, 10), ("/c", 0, 0, 1, False, 7), ("/d", None, 3, 2, False, 7)], df.schema)
    assert {r["path"]: (r["freeable_bytes"], r["resolved"]) for r in I.freeable(lost, F.col("path")).collect()} == {"/a": (0, False), "/b": (0, False), "/c": (7, True), "/d": (0, False)}


def test_nested(spark):
    inv = spark.createDataFrame([("/a", True), ("/a/b", True), ("/a/b/c", False), ("/ab", False), ("/a_/x", False)], "path string, is_dir boolean")
    raw = spark.createDataFrame([(p, "g") for p in ("/a", "/a/b", "/a/b/c", "/ab", "/a_/x")], "path string, category_group string")
    assert {r["path"] for r in D.without_nested(raw, inv).collect()} == {"/a", "/ab", "/a_/x"}


def test_archive_stem(spark):
    assert got(spark, D.archive_stem(F.col("x")), "Data.TAR.GZ") == "Data"
    assert got(spark, D.archive_stem(F.col("x")), "data.gz") is None


def test_partial_hash(spark):
    a, b = "x" * 10 + "M" * 5 + "y" * 10, "x" * 10 + "N" * 5 + "y" * 10
    h = lambda t: got(spark, U.partial_hash(F.col("x"), 10), t)
    assert h(a) == h(b)
    assert got(spark, U.partial_hash(F.col("x"), 13), a) != got(spark, U.partial_hash(F.col("x"), 13), b)


def test_fold(spark):
    e = spark.createDataFrame([(1, "b", "/x", "done", 5), (2, "b", "/x", "intent", 6), (3, "b", "/y", "intent", 7)], "seq long, batch_id string, original_path string, phase string, size_bytes long")
    assert [(r["original_path"], r["seq"]) for r in E.fold_latest(e).collect()] == [("/x", 1)]
    assert sorted((r["original_path"], r["seq"]) for r in E.fold_latest(e, None).collect()) == [("/x", 2), ("/y", 3)]
    assert E.fold_latest(e.limit(0)).count() == 0


def test_log_source(spark, tmp_path):
    (tmp_path / "log.json").write_text('{"seq": 1, "batch_id": "b", "original_path": "/x", "restored": true}\n\n{"seq": 2, "batch_id": "b", "phase": "intent"}\n')
    rows = L.read_events(spark, str(tmp_path / "log.json")).orderBy("seq").collect()
    assert [(r["phase"], r["restored"], r["schema_version"]) for r in rows] == [("done", True, 1), ("intent", False, 1)]
    L.append_events(spark.createDataFrame([(3, "c")], "seq long, batch_id string"), str(tmp_path / "out"))
    L.append_events(spark.createDataFrame([(4, "c")], "seq long, batch_id string"), str(tmp_path / "out"))
    assert L.read_events(spark, str(tmp_path / "out")).count() == 2
    (tmp_path / "cut.json").write_text('{"seq": 1, "batch_id": "b"}\n{"seq": 2, "batch_id": "b", "original_pa\nnull\n[1]\n{"seq": "x"}\n')
    rows, bad = L.read_event_log(spark, str(tmp_path / "cut.json"))
    assert [r["seq"] for r in rows.collect()] == [1] and bad.count() == 4
    one = spark.createDataFrame([(5, "d"), (6, "d")], "seq long, batch_id string")
    for batch in ("a", "b", "a"):
        L.append_events(one, str(tmp_path / "once"), batch)
    assert sorted(r["seq"] for r in L.read_events(spark, str(tmp_path / "once")).collect()) == [5, 5, 6, 6]
    good, bad = L.parsed(spark.createDataFrame([('{"a": 1}',), ("{bad",), (" ",)], "value string"), "a int")
    assert (good.count(), bad.count()) == (1, 1)
    (tmp_path / "v.tsv").write_text("﻿/a\t/v/a\t5\nbroken\n/b\t/v/b\tx\n")
    rows, odd = L.read_vault_table(spark, str(tmp_path / "v.tsv"))
    assert [tuple(r) for r in rows.collect()] == [("/a", "/v/a", 5)]
    assert odd.count() == 2


def test_file_source(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.TXT").write_bytes(b"ok \xff")
    (tmp_path / "d" / "b.bin").write_bytes(b"123")
    inv = X.scan(spark, str(tmp_path), content=True)
    assert {(r["name"], r["size"], r["ext"]) for r in inv.collect()} == {("a.TXT", 4, ".txt"), ("b.bin", 3, ".bin")}
    assert {r["text"] for r in X.texts(inv).collect()} == {"ok �", None}


def test_tags(spark):
    texts = ["Subtotal $12.00\nTax $1.20\nTotal $13.20", "def f(x): return {x: (1);}", "", "word", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r["tag"] for r in G.tagged(df).collect()] == ["receipt", "code", "unknown", "unknown", "unknown"]


def test_shingles(spark):
    assert got(spark, F.sort_array(N.shingles(F.col("x"), 2)), "Ä b  ä B c") == ["b c", "b ä", "ä b"]
    assert got(spark, N.shingles(F.col("x")), "a b") == ["a b"]
    assert got(spark, N.shingles(F.col("x")), None) == []


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 101)]
    out = {r["id"]: r["component"] for r in N.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert set(out.values()) == {0, 100} and out[40] == 0 and out[101] == 100


def test_hamming(spark):
    import random

    rng = random.Random(3)
    base = [rng.getrandbits(63) for _ in range(30)]
    hashes = base + [b ^ (1 << rng.randrange(60)) ^ (1 << rng.randrange(60)) for b in base] + base[:3]
    df = spark.createDataFrame(list(enumerate(hashes)), "id long, hash long")
    found = {(r["a"], r["b"]) for r in N.hamming_pairs(df, 3).collect()}
    want = {(i, j) for i in range(len(hashes)) for j in range(i + 1, len(hashes)) if (hashes[i] ^ hashes[j]).bit_count() <= 3 and hashes[i] != hashes[j] and hashes.index(hashes[i]) == i and hashes.index(hashes[j]) == j}
    assert found == want | {(i, 60 + i) for i in range(3)}


def test_knn(spark):
    import numpy as np

    m = np.random.default_rng(0).normal(size=(60, 8))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], "vec_id long, embedding array<double>")
    out = {}
    for r in N.knn(df, 3, -1.0, block_rows=16).collect():
        out.setdefault(r["a"], set()).add(r["b"])
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    assert out == {i: set(np.argsort(-s[i])[:3].tolist()) for i in range(60)}


@pytest.mark.parametrize("block_rows", [8, 100])
def test_knn_of_copies(spark, block_rows):
    axis = lambda k: [float(i == k) for i in range(4)]
    rows = [(i, axis(0)) for i in range(0, 40, 2)] + [(i, axis(1)) for i in range(1, 40, 2)] + [(40 + i, [0.8, 0.6, 0.0, float(i == 3)]) for i in range(6)] + [(50, axis(2))]
    v = dict(rows)
    size = lambda x: sum(p * p for p in x) ** 0.5
    want = set()
    for a in v:
        near = sorted((-round(sum(p * q for p, q in zip(v[a], v[b], strict=True)) / size(v[a]) / size(v[b]), 9), b) for b in v if b != a)
        want |= {(a, b, -c) for c, b in near[:3] if -c >= 0.35}
    out = N.knn(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 3, 0.35, block_rows=block_rows).collect()
    assert {(r["a"], r["b"], round(r["cosine"], 9)) for r in out} == want and len(out) == len(want)


def test_alike_bursts(spark):
    import random

    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(3)]
    rows = [(i, r.choice(["x", None]), r.choice([None, *(k / 2 for k in range(60))]), r.choice(base) ^ sum(1 << r.randrange(64) for _ in range(r.choice([0, 5, 14]))) % 2**64) for i in range(150)]
    rows = [(i, g, t, h - 2**64 if h >= 2**63 else h) for i, g, t, h in rows]
    parent = {i: i for i, *_ in rows}

    def top(i):
        return i if parent[i] == i else top(parent[i])

    for i, g, t, h in rows:
        for j, g2, t2, h2 in rows[:i]:
            if t is not None and t2 is not None and g == g2 and abs(t - t2) <= 1.5 and ((h ^ h2) % 2**64).bit_count() <= 14:
                low, high = sorted((top(i), top(j)))
                parent[high] = low
    out = N.alike_bursts(spark.createDataFrame(rows, "id long, g string, at double, hash long"), ["g"], "at", "hash", 1.5, 14)
    assert {r["id"]: r["burst"] for r in out.collect()} == {i: top(i) for i in parent}


def test_version_conflict(spark):
    rows = [(1, "a_v1", 1.0, 1), (1, "a_v2", 2.0, 2), (1, "a_final", 1.5, 3), (2, "b", 5.0, 4), (2, "b_v2", 9.0, 5)]
    out = N.version_chain(spark.createDataFrame(rows, "chain_id long, stem string, mtime double, id long")).collect()
    assert {r["id"] for r in out if r["is_keep"]} == {5}
    assert [r["id"] for r in sorted(out, key=lambda r: (r["chain_id"], r["position"]))] == [1, 2, 3, 4, 5]


def test_metrics(spark):
    items = spark.createDataFrame([(1, "x", "a"), (2, "x", "a"), (3, "x", "b"), (4, "y", "b")], "item long, predicted string, truth string")
    b = M.bcubed(items).first()
    assert math.isclose(b["precision"], (2 / 3 + 2 / 3 + 1 / 3 + 1) / 4) and math.isclose(b["recall"], (1 + 1 + 0.5 + 0.5) / 4)
    order = spark.createDataFrame([(1, "p", 1, 1), (1, "q", 2, 3), (1, "r", 3, 2), (2, "z", 1, 1)], "g long, item string, predicted int, truth int")
    assert {r["g"]: round(r["tau"], 6) for r in M.kendall_tau(order).collect()} == {1: round(1 / 3, 6), 2: 1.0}
    same = spark.createDataFrame([(1, 1), (1, 1)], "a int, b int")
    assert M.cohens_kappa(same).first()["kappa"] == 1.0
    scored = spark.createDataFrame([(1, 0.9, True), (2, 0.8, False), (3, 0.7, True)], "id long, score double, positive boolean")
    curve = {r["id"]: (r["precision"], r["recall"]) for r in M.pr_curve(scored).collect()}
    assert curve == {1: (1.0, 0.5), 2: (0.5, 0.5), 3: (2 / 3, 1.0)}
    assert M.operating_point(M.pr_curve(scored), 0.6).first()["id"] == 3
    assert M.operating_point(M.pr_curve(scored), 0.6, 1.1).count() == 0
    ranked = spark.createDataFrame([(1, "a", 1, 0), (1, "b", 2, 3)], "g long, item string, position int, relevance int")
    assert math.isclose(M.ndcg(ranked, 2).first()["ndcg"], (7 / math.log2(3)) / 7)


def test_selection(spark):
    c = spark.createDataFrame([("/a", "A", "x", "g"), ("/b", "B", "g", "h")], "path string, tier string, category string, category_group string")
    assert {r["path"] for r in T.selected(c, ("A", "B"), "g").collect()} == {"/a", "/b"}
    with pytest.raises(ValueError):
        T.selected(c, ("C",), "g")


def test_modes(spark):
    log = spark.createDataFrame([(1, "power"), (2, "safe")], "seq long, to_mode string")
    assert Y.current_mode(log).first()["mode"] == "safe"
    assert Y.current_mode(log.limit(0)).first()["mode"] == "safe"
    assert Y.categories("safe")["dev_artifacts"][0] is False


def test_upsert(spark):
    old = spark.createDataFrame([("/a", 1, 1.0, "h"), ("/b", 2, 2.0, "i")], "path string, size long, mtime double, partial_hash string")
    new = spark.createDataFrame([("/a", 5, 3.0), ("/c", 7, 4.0)], "path string, size long, mtime double")
    assert {tuple(r) for r in I.upserted(old, new).collect()} == {("/a", 5, 3.0, "h"), ("/b", 2, 2.0, "i"), ("/c", 7, 4.0, None)}
    assert I.unseen(old, new, None, cancelled=True).count() == 0


def test_plans(spark):
    """Filters and columns reach the scan."""
    from siltstone.sources.adapters import files

    plan = files(spark, "/root/testdata/sf0.001").select("path")._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.split("ReadSchema")[1]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = I.subtree(docs.withColumnRenamed("source", "path"), "/src1").select("path")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(source" in plan

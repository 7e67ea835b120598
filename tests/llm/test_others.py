"""Quality rules, archives, fingerprints, perspectives, the pipeline."""

import base64
import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from fixtures import documents, empty, words
from pyspark.sql import functions as F

from siltstone.llm import chat as C
from siltstone.llm import fingerprints as B
from siltstone.llm import quality_rules as Q
from siltstone.llm import registry
from siltstone.llm import warc as W

DIR = "/root/testdata/sf0.001"


def test_base_rules(spark):
    df = documents(spark)
    rows = {r["doc_id"]: r["text"] or "" for r in df.collect()}
    out = Q.quality_rules(df, None)
    assert out.columns[:4] == ["doc_id", "text", "kept_text", "_keys"]
    for r in out.collect():
        t = rows[r["doc_id"]]
        w = words(t)
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if words(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert r["kept"] == (not r["base_failed"])
        assert len(r["line_labels"]) == len(t.split("\n"))
    assert Q.quality_rules(empty(spark), None).count() == 0


def test_one_text_of_very_many_words():
    text = " ".join(map(str, range((1 << 21) + 10))) + " 0 1 2"
    base = Q.measured(pa.array([text, "a b c a b c d", None])).base
    assert base["n_words"].tolist() == [(1 << 21) + 13, 7, 0] and base["n_repeat_words"].tolist() == [6, 6, 0]


def test_viterbi_and_marginals():
    rng = np.random.default_rng(0)
    edges = np.array([0, 1, 1, 5, 8])
    scores, turn = rng.normal(size=(8, 2)), rng.normal(size=(2, 2))
    got, (single, pairs) = Q.viterbi(scores, edges, turn), Q.marginals(scores, edges, turn)
    all_pairs = np.zeros((2, 2))
    for low, high in itertools.pairwise(edges):
        paths = list(itertools.product((0, 1), repeat=high - low))
        value = np.array([sum(scores[low + k, s] for k, s in enumerate(p)) + sum(turn[a, b] for a, b in itertools.pairwise(p)) for p in paths])
        if high > low:
            assert tuple(got[low:high]) == paths[int(value.argmax())]
        p = np.exp(value) / np.exp(value).sum()
        for k in range(high - low):
            assert np.isclose(single[low + k, 1], sum(x for x, path in zip(p, paths, strict=True) if path[k]))
        for x, path in zip(p, paths, strict=True):
            for a, b in itertools.pairwise(path):
                all_pairs[a, b] += x
    assert np.allclose(pairs, all_pairs)


def test_field_on_held_out(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    even = labels.filter("doc_id % 2 = 0")
    field = Q.fit_field(docs, even)
    out = Q.quality_rules(docs, field).join(labels.filter("doc_id % 2 = 1"), "doc_id").select("quality", "content_share").collect()
    right = np.mean([(r["content_share"] >= 0.5) == (r["quality"] == 1) for r in out])
    assert right > 0.95
    good = [r["content_share"] >= 0.5 for r in out if r["quality"] == 1]
    assert np.mean(good) > 0.98
    assert Q.fit_field(docs, labels.filter("quality = 1")) is None
    assert Q.fit_field(docs, labels.limit(0)) is None


def test_line_labels_within_documents(spark):
    """Lines planted in good documents among ever new neighbours are boilerplate, the lines beside them content."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    planted = "Share this page, sign in or see our terms"
    good = labels.filter("quality = 1").select("doc_id")
    rows = docs.join(good, "doc_id", "left_semi").filter("size(split(text, '\\n')) >= 4 AND doc_id % 3 = 0")
    cut = F.split("text", "\n")
    text = F.array_join(F.concat(F.slice(cut, 1, 2), F.array(F.lit(planted)), F.slice(cut, F.lit(3), F.size(cut))), "\n")
    changed = docs.join(rows.select("doc_id", text.alias("new")), "doc_id", "left").withColumn("text", F.coalesce("new", "text")).drop("new")
    out = Q.quality_rules(changed, Q.fit_field(changed, labels)).filter(F.contains("text", F.lit(planted)) & ~F.col("base_failed")).collect()
    assert len(out) > 30
    lines = [(x, y, len(words(x))) for r in out for x, y in zip(r["text"].split("\n"), r["line_labels"], strict=True)]
    assert np.mean([y == 0 for x, y, _ in lines if x == planted]) > 0.95
    assert np.mean([y == 1 for x, y, n in lines if x != planted and n > 15]) > 0.95
    mixed = [r["content_share"] for r in Q.quality_rules(docs, Q.fit_field(docs, labels)).filter(~F.col("base_failed")).collect() if len(set(r["line_labels"])) > 1]
    assert len(mixed) > 100 and min(mixed) > 0 and max(mixed) < 1


def test_copies_do_not_recur(spark):
    same = [(i, "a line of many copies\nand another one beside it") for i in range(50)]
    apart = [(100 + i, f"first words of {i}\nA LINE that stands among others \nlast words of {i}") for i in range(50)]
    found = Q.recurring_lines(spark.createDataFrame([*same, *apart, (200, None), (201, "")], "doc_id long, text string"))
    assert found.tolist() == Q.line_hashes(pa.array(["a line that stands among others"])).tolist()


def pages(spark):
    html = ["<p>a</p>", "<p>b</p>", "<p>a</p>", None, "", "é" * 5000, "<p>a</p>"]
    return spark.createDataFrame([(i * 2, f"http://x/{i}\r\nX: y" if i != 1 else None, h, "clash") for i, h in enumerate(html)], "page_id long, url string, html string, payload string")


def test_archives(spark):
    rows = {r["page_id"]: (r["html"] or "").encode() for r in pages(spark).collect()}
    out = W.read_archives(W.write_archives(pages(spark)), with_payload=True).collect()
    assert len(out) == len(rows)
    last = {v: max(p for p, x in rows.items() if x == v) for v in rows.values()}
    for r in out:
        page = int(r["record_id"].rpartition(":")[2])
        raw = rows[page]
        assert r["payload_bytes"] == len(raw) and r["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        lead = last[raw]
        assert r["record_type"] == ("response" if lead == page else "revisit")
        assert r["refers_to"] == (None if lead == page else f"{W.RECORD_ID}{lead}")
        if lead == page:
            assert r["payload"] == raw
    least = W.read_archives(W.write_archives(pages(spark), least_bytes=1)).collect()
    assert sum(r["record_type"] == "revisit" for r in least) == 2
    assert W.write_archives(pages(spark).limit(0)).count() == 0


def archive(compress=True, n=4):
    out = []
    for i in range(n):
        raw = W.record_bytes(f"urn:x:{i}", f"http://x/{i}", f"payload {i} ".encode() * 20, "1970-01-01T00:00:00Z", None, None)
        if compress:
            z = zlib.compressobj(9, zlib.DEFLATED, 31)
            raw = z.compress(raw) + z.flush()
        out.append(raw)
    return out


@pytest.mark.parametrize("compress", [True, False])
def test_salvage(compress):
    parts = archive(compress)
    whole = W.salvage(b"".join(parts))
    assert len(whole.records) == 4 and not whole.gaps
    at = len(parts[0]) + len(parts[1]) // 2
    raw = bytearray(b"".join(parts))
    raw[at] ^= 0xFF
    found = W.salvage(bytes(raw))
    assert [r.headers["warc-record-id"] for r in found.records] == ["<urn:x:0>", "<urn:x:2>", "<urn:x:3>"]
    assert [(a, b) for a, b, _ in found.gaps] == [(len(parts[0]), len(parts[0]) + len(parts[1]))]
    cut = W.salvage(b"".join(parts)[:-9])
    assert len(cut.records) == 3 and cut.gaps[0][:2] == (sum(map(len, parts[:3])), sum(map(len, parts)) - 9)
    junk = W.salvage(b"junk" + b"".join(parts[:2]) + b"WARC/1. no record" + parts[2])
    assert len(junk.records) == 3 and [g[0] for g in junk.gaps] == [0, 4 + len(parts[0]) + len(parts[1])]
    assert W.salvage(b"") == W.Salvage()


def test_salvage_every_byte():
    """Wherever a byte is spoilt, the other records come back and the gap covers the byte."""
    parts = archive(True, 3)
    edges = np.cumsum([0, *map(len, parts)])
    for at in range(0, edges[-1], 7):
        raw = bytearray(b"".join(parts))
        raw[at] ^= 0x55
        found = W.salvage(bytes(raw))
        hit = int(np.searchsorted(edges, at, side="right")) - 1
        ids = {r.headers["warc-record-id"] for r in found.records}
        assert {f"<urn:x:{i}>" for i in range(3) if i != hit} <= ids
        if f"<urn:x:{hit}>" not in ids:
            assert any(a <= at < b for a, b, _ in found.gaps)


def gzipped(raw, level=9):
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def ids(found):
    return [int(r.headers["warc-record-id"].strip("<>").rpartition(":")[2]) for r in found.records]


@pytest.mark.parametrize("bad", [0, 2, 4])
def test_salvage_inside_member(bad):
    parts = archive(False, 5)
    parts[bad] = parts[bad].replace(b"payload", b"PAYLOAD")
    text, other = gzipped(b"".join(parts)), archive(True, 1)[0]
    found = W.salvage(other + text + other)
    assert ids(found) == [0, *(i for i in range(5) if i != bad), 0]
    start = sum(map(len, parts[:bad]))
    assert found.gaps == [(len(other), len(other) + len(text), f"text bytes {start} to {start + len(parts[bad])}: block digest differs")]


@pytest.mark.parametrize("level", [0, 9])
def test_salvage_damaged_member(level):
    rng = np.random.default_rng(3)
    parts = [W.record_bytes(f"urn:x:{i}", None, rng.bytes(3000), "1970-01-01T00:00:00Z", None, None) for i in range(200)]
    text, other = gzipped(b"".join(parts), level), archive(True, 1)[0]
    doubtful = lambda found: [int(r.headers["warc-record-id"][7:-1]) for r, _ in found.doubtful]
    for rest in (b"", other):  # cut short
        found = W.salvage(text[: len(text) // 2] + rest)
        got = sorted(doubtful(found) + ids(found))
        assert got[-1] >= 98 and got == sorted([*range(got[-1] + 1), *([0] if rest else [])])
    checksum = bytearray(text)
    checksum[-6] ^= 1
    found = W.salvage(bytes(checksum) + other)
    assert sorted(doubtful(found) + ids(found)) == [0, *range(200)]
    if level:
        assert ids(found) == [0] and [g[:2] for g in found.gaps] == [(0, len(text))]


@pytest.mark.parametrize("compress", [True, False])
def test_very_long_url(compress):
    raw = W.record_bytes("urn:x:7", "http://x/" + "🙂" * 260_000, b"long", "1970-01-01T00:00:00Z", None, None)
    parts = archive(compress, 2)
    found = W.salvage(parts[0] + (gzipped(raw) if compress else raw) + parts[1])
    assert ids(found) == [0, 7, 1] and not found.gaps


def test_stored_archives(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(b"".join(archive()))
    (tmp_path / "b.warc").write_bytes(b"?" + b"".join(archive(False)))
    out = W.read_stored(spark, str(tmp_path)).collect()
    assert sum(r["reason"] is None for r in out) == 8
    assert [(r["offset"], r["end"]) for r in out if r["reason"] is not None] == [(0, 1)]


def test_fingerprints(spark):
    df = documents(spark)
    rows = {r["doc_id"]: r["text"] or "" for r in df.collect()}
    ids = sorted(rows)
    out = {r["doc_id"]: r for r in B.with_next(df).collect()}
    assert len(out) == len(rows)
    for i, d in enumerate(ids):
        assert out[d]["next_text"] == rows[ids[(i + 1) % len(ids)]]
        assert out[d]["next_sketch"] == out[ids[(i + 1) % len(ids)]]["sketch"]
    same = {}
    for d in ids:
        assert same.setdefault(rows[d], out[d]["sketch"]) == out[d]["sketch"]
    assert B.with_next(empty(spark)).count() == 0
    one = spark.createDataFrame([(1, "a b"), (None, "x")], "doc_id long, text string")
    assert {r["doc_id"]: r["next_text"] for r in B.with_next(one).collect()} == {1: "a b", None: ""}


def test_sketch_estimates(spark):
    a, b = " ".join(f"a{i}" for i in range(3004)), " ".join(f"a{i}" for i in range(2000, 5004))
    df = spark.createDataFrame([(a, b, "x y")], "a string, b string, c string")
    s = df.select(B.sketch(F.col("a")).alias("a"), B.sketch(F.col("b")).alias("b"), B.sketch(F.col("c")).alias("c"), B.sketch(F.concat_ws(" ", "a", F.lit("| | | | |"), "b")).alias("ab"))
    r = s.select(
        B.resemblance(F.col("a"), F.col("b")).alias("j"),
        B.containment(F.col("a"), F.col("b")).alias("in_b"),
        B.distinct_shingles(F.col("a")).alias("n"),
        B.distinct_shingles(F.col("c")).alias("few"),
        B.resemblance(B.merged(F.col("a"), F.col("b")), F.col("ab")).alias("merged"),
    ).first()
    assert abs(r["j"] - 0.2) < 0.12 and abs(r["in_b"] - 1 / 3) < 0.17 and abs(r["n"] / 3000 - 1) < 0.3 and r["few"] == 1 and r["merged"] > 0.9
    parts = s.select(F.explode(F.array("a", "b")).alias("sketch"), F.lit(1).alias("id"))
    assert B.merge_parts(parts, "id").first()["sketch"] == s.select(B.merged(F.col("a"), F.col("b")).alias("m")).first()["m"]


def test_perspectives(spark, monkeypatch):
    rows = [(1, 0, "system", "rules"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", None), (1, 3, "ann", "bye"), (2, 0, "system", "x"), (None, 0, None, "lone"), (1, 3, "ann", "bye")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, said long")
    out = {(r["conv_id"], r["perspective"]): r for r in C.rotate_perspectives(df).collect()}
    assert set(out) == {(1, "ann"), (1, "bob"), (None, "unknown")}
    r = out[1, "ann"]
    m = "<|im_start|>"
    assert r["rendered"] == f"{m}system\nrules<|im_end|>\n{m}assistant\nhi < |im_end|><|im_end|>\n{m}user name=bob\n<|im_end|>\n" + f"{m}assistant\nbye<|im_end|>\n" * 2
    assert [r["rendered"][s["start"] : s["end"]] for s in r["target_spans"]] == ["hi < |im_end|><|im_end|>", "bye<|im_end|>", "bye<|im_end|>"]
    monkeypatch.setattr(C, "PART_TURNS", 2)
    parts = [p for p in C.rotate_perspectives(df).collect() if (p["conv_id"], p["perspective"]) == (1, "ann")]
    parts.sort(key=lambda p: p["part"])
    assert len(parts) == 3 and "".join(p["rendered"] for p in parts) == r["rendered"]
    assert [p["start_char"] for p in parts] == [0, len(parts[0]["rendered"]), len(parts[0]["rendered"]) + len(parts[1]["rendered"])]
    assert C.rotate_perspectives(df.limit(0)).count() == 0


def test_hot_dialogue(spark, monkeypatch):
    """One dialogue with most rows, with and without turn numbers; no text is sorted by perspective."""
    monkeypatch.setattr(C, "PART_TURNS", 4)
    monkeypatch.setattr(C, "MOST_IN_BLOCK", 16)
    rows = [(1, i, "ab"[i % 2], f"turn {i}") for i in range(500)] + [(1, None, "a", f"none {i:03}") for i in range(90)] + [(1, 8, "c", f"again {i:03}") for i in range(70)] + [(2, 0, "a", "x"), (2, 1, "b", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = C.rotate_perspectives(df)
    out = got.filter("conv_id = 1 AND perspective = 'b'").orderBy("part").collect()
    order = sorted(((t is not None, t or 0, w, x) for c, t, w, x in rows if c == 1))
    said = "".join(f"<|im_start|>{'assistant' if w == 'b' else f'user name={w}'}\n{x}<|im_end|>\n" for _, _, w, x in order)
    assert "".join(r["rendered"] for r in out) == said
    assert [r["part"] for r in out] == list(range(len(out))) and max(r["n_turns"] for r in out) <= 4
    at = 0
    for r in out:
        assert r["start_char"] == at and all(r["rendered"][s["start"] : s["end"]].endswith("<|im_end|>") for s in r["target_spans"])
        at += len(r["rendered"])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    by_perspective = [line for line in plan.splitlines() if "Window [" in line and "perspective" in line.split("], [")[1]]
    assert by_perspective and not any(c in line for line in by_perspective for c in ("rendered", "body", "said"))


@pytest.mark.parametrize("name", ["op2_perspectives", "op4_warc", "op11_decontamination", "op12_collocations", "op13_manifest"])
def test_sql(spark, duck, same, name):
    same(registry.QUERIES[name](spark, DIR), duck.sql(registry.SQL[name]))


def test_native_plans(spark):
    """No Python in the plans of the operators that are to be native."""
    for name in ("op2_perspectives", "op10_fingerprints", "op11_decontamination"):
        plan = registry.QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_pipeline(spark):
    """Each stage against brute force on its own input."""
    import corpus_pipeline as P
    from test_dedup import brute_lines, brute_near, brute_windows

    before = spark.read.parquet(f"{DIR}/documents.parquet")
    stages = dict(P.STAGES)
    at = {}
    for name, f in P.STAGES:
        path = P.scratch(spark)
        f(spark, before, DIR).write.parquet(path)
        before = spark.read.parquet(path)
        at[name] = before
    rows = {n: {r["doc_id"]: r["text"] for r in at[n].collect()} for n in list(stages)[:4]}
    assert all(df.columns == list(P.COLUMNS) for df in list(at.values())[:4])
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    assert all(texts[d] == t for d, t in rows["quality rules"].items()) and 100 < len(rows["quality rules"]) < 200
    assert rows["line dedup"] == {d: v[2] for d, v in brute_lines(rows["quality rules"], 10).items()}
    near = brute_near(rows["line dedup"], 5, 80)
    assert rows["near duplicates"] == {d: t for d, t in rows["line dedup"].items() if near[d][1] == d}
    cut = brute_windows({d: words(t) for d, t in rows["near duplicates"].items()}, 20)
    assert rows["substring dedup"] == {d: cut[d][2] if cut[d][1] else t for d, t in rows["near duplicates"].items()}
    assert {r["doc_id"] for r in at["packing"].collect()} == set(rows["substring dedup"])
    assert P.run(spark, DIR).count() == at["packing"].count()

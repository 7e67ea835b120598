"""Texts of documents of several kinds, and texts changed for evaluations."""

import io
import zipfile

from pyspark.sql import functions as F

from siltstone.operators import review as V
from siltstone.sources import files as X

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(xml, name="word/document.xml"):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(name, xml)
    return raw.getvalue()


def test_document_texts(spark):
    good = docx(f'<w:document {W}><w:body><w:p><w:r><w:t>One </w:t><w:tab/><w:t>two &amp; é</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:hyperlink><w:r><w:t>link</w:t><w:br/></w:r></w:hyperlink></w:p></w:body></w:document>')
    bomb = docx('<!DOCTYPE x [<!ENTITY a "aaaa">]><x>&a;</x>')
    rows = [
        ("/good", ".docx", good),
        ("/cut", ".docx", good[: len(good) // 2]),
        ("/other", ".docx", docx("<x/>", "other.xml")),
        ("/broken", ".docx", docx("<w:document")),
        ("/nobody", ".docx", docx(f"<w:document {W}/>")),
        ("/bomb", ".docx", bomb),
        ("/a", ".txt", b"ok \xff"),
        ("/b", ".pdf", b"%PDF"),
        ("/c", ".docx", None),
        ("/d", ".docx", b""),
    ]
    df = spark.createDataFrame([(p, e, None if c is None else bytearray(c)) for p, e, c in rows], "path string, ext string, content binary")
    out = {r["path"]: (r["text"], r["reason"]) for r in X.document_texts(df).collect()}
    assert out["/good"] == ("One \ttwo & é\n\nlink\n", None) and out["/a"] == ("ok \ufffd", None)
    assert {p: r for p, (t, r) in out.items() if t is None} == {
        "/cut": "not_a_package", "/other": "no_text_part", "/broken": "malformed", "/nobody": "no_body", "/bomb": "declares_a_type", "/b": "unsupported", "/c": "unreadable", "/d": "not_a_package",
    }
    corrupt = bytearray(good)
    corrupt[60] ^= 0xFF  # within the packed text
    assert X.paragraphs(bytes(corrupt))[0] is None
    assert X.document_texts(df.limit(0)).count() == 0


def test_round_trip(spark):
    said = [("/a", "one\ntwo  <x> & y\n\n"), ("/b", ""), ("/c", None)]
    packed = X.packed(spark.createDataFrame(said, "path string, text string")).withColumn("ext", F.lit(".docx"))
    assert sorted((r["path"], r["text"]) for r in X.document_texts(packed).collect()) == said


def test_changed_texts(spark):
    df = spark.createDataFrame([("a\n \nb\nc\nd",), ("one",), ("",), ("x y  z\nw",), (None,)], "t string")
    out = [tuple(r) for r in df.select(V.reordered(F.col("t")), V.pasted(F.col("t"))).collect()]
    assert sorted(out[0][0].split("\n")) == ["a", "b", "c"] and out[0][0] != "a\nb\nc" and out[0][1] == "a b"
    assert out[1] == ("one", "one") and out[2] == ("", "") and out[3] == ("x y  z", "x y") and out[4] == (None, None)


def test_feedback(spark):
    members = spark.createDataFrame([("c", i, f"/m/{i}.JPG", "t", 5, i == 1, i, 0.5, "k") for i in (1, 2)], "cluster_id string, id long, path string, track string, size_bytes long, is_keep boolean, position long, raw_score double, score_kind string")
    done = spark.createDataFrame([("c", 1, 1, "kept"), ("c", 2, 2, "rejected"), ("c", 9, 3, "kept"), ("z", 1, 4, "kept")], "cluster_id string, id long, seq long, decision string")
    rows = V.feedback_rows(members, done).orderBy("seq").collect()
    assert [(r["id"], r["n_kept"], r["n_rejected"], r["cluster_size"], r["ext"]) for r in rows] == [(1, 0, 0, 2, ".jpg"), (2, 1, 0, 2, ".jpg")]

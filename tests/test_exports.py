import time
import zipfile
from xml.etree import ElementTree

import pandas as pd
import pytest

from parcelforge.operators import documents, spatial
from parcelforge.sources import dossiers, sinks
from parcelforge.streaming import files


def test_no_two_files_get_one_name(spark):
    names = ["a.pdf", "A.pdf", "a__2.pdf", "a.pdf", "a__3.pdf", "a.pdf", "a__2.pdf", "b", "B", "b__2", "a__x.pdf", "c__1.pdf", "c.pdf", "c.pdf"]
    rows = [(i, f, n) for f in ("x", "y") for i, n in enumerate(names)]
    got = dossiers.unique_destinations(spark.createDataFrame(rows, "i int, folder string, name string"), "folder", "name", "i").collect()
    for f in ("x", "y"):
        made = {r.i: r.destination for r in got if r.folder == f}
        assert len(made) == len({d.lower() for d in made.values()}) == len(names)
        assert made[0] == "a.pdf" and made[1] == "A__4.pdf" and made[2] == "a__2.pdf" and made[3] == "a__5.pdf" and made[13] == "c__2.pdf"


def test_workbook_and_archive(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a & <b>"), (2, None)], "n int, t string")
    sinks.write_workbook({"one": rows, "two": rows.limit(0)}, str(tmp_path / "w.xlsx"))
    with zipfile.ZipFile(tmp_path / "w.xlsx") as z:
        sheet = ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml"))
        assert [t.text or "" for t in sheet.iter("{http://schemas.openxmlformats.org/spreadsheetml/2006/main}t")] == ["n", "t", "1", "a & <b>", "2", ""]
        assert all(ElementTree.fromstring(z.read(n)) is not None for n in z.namelist())
    sinks.write_archive(spark.createDataFrame([("b.md", "two"), ("a.md", "one"), ("a.md", "x")], "file_name string, content string"), str(tmp_path / "m.zip"))
    with zipfile.ZipFile(tmp_path / "m.zip") as z:
        assert z.namelist() == ["a.md", "b.md"] and z.read("b.md") == b"two"
    assert [sinks._column(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]


def test_artifacts(spark, tmp_path):
    sinks.write_artifacts(spark.createDataFrame([("d", "crop", "c1", bytearray(b"1")), ("d", "preview", "p", bytearray(b"2")), ("e", "crop", "c", bytearray(b"3"))], "doc_id string, kind string, name string, content binary"), str(tmp_path / "a"))
    assert sinks.read_artifacts(spark, str(tmp_path / "a"), "d").count() == 2
    assert bytes(sinks.read_artifacts(spark, str(tmp_path / "a"), "d", "crop").first().content) == b"1"


def test_pages_of_files(spark, tmp_path):
    for name, content in (("a.pdf", b"123"), ("b.png", b"9"), ("c.doc", b"x"), ("d.jpg", b"!")):
        (tmp_path / name).write_bytes(content)

    def render(content, ending):
        if content == b"!":
            raise ValueError("broken")
        return [(int(chr(b)), ending) for b in content]

    got = dossiers.load_pages(spark, str(tmp_path), render, "n int, kind string", max_pages=2).collect()
    found = sorted((r.doc_id.rsplit("/", 1)[-1], r.page_index, r.n, r.kind, r.error) for r in got)
    assert found == [("a.pdf", 0, 1, "pdf", None), ("a.pdf", 1, 2, "pdf", None), ("b.png", 0, 9, "png", None), ("c.doc", None, None, None, "unsupported file type: doc"), ("d.jpg", None, None, None, "ValueError: broken")]


def test_watchdog(monkeypatch):
    failed = lambda batch, why: batch.assign(out=None, error=why)

    def detect(batch):
        if batch["n"].iloc[0] == 2:
            raise RuntimeError("bad")
        if batch["n"].iloc[0] == 3:
            time.sleep(2)
        return batch.assign(out=1, error=None)

    monkeypatch.setattr(files, "max", lambda a, b: 0.3, raising=False)
    got = files.with_watchdog(detect, 900, failed)(pd.DataFrame({"n": [1, 2, 3]}))
    assert got["error"].tolist() == [None, "RuntimeError: bad", "timeout"]


def test_labelled_fields_by_template(spark):
    tokens = [("d", 0, 0, "Thửa đất số: 12", 0.9, 0.0, 0.0, 150.0, 20.0), ("d", 0, 1, "Diện tích", 0.9, 0.0, 60.0, 90.0, 80.0), ("d", 0, 2, "120,5", 0.9, 0.0, 100.0, 60.0, 120.0), ("e", 0, 0, "Sơ đồ thửa đất Thửa đất số: 7", 0.9, 0.0, 0.0, 300.0, 20.0)]
    t = spark.createDataFrame(tokens, "doc_id string, page_index int, ord int, text string, confidence double, x1 double, y1 double, x2 double, y2 double")
    config = spark.createDataFrame([("mau_A", "so_thua", "Thửa đất số", None, None), ("mau_A", "dien_tich", "Diện tích", ["dien tich"], "bottom"), ("mau_B", "so_thua", "khác", None, None)], "template string, field string, label string, aliases array<string>, direction string")
    templates = spark.createDataFrame([("d", 0, "unknown"), ("e", 0, "mau_A")], "doc_id string, page_index int, template string")
    got = {(r.doc_id, r.field): r.value for r in documents.extract_all_fields(t, documents.label_table(config), templates).collect()}
    assert got == {("d", "so_thua"): "12", ("d", "dien_tich"): "120,5"}


@pytest.mark.parametrize("threshold", [60.0, 75.0, 90.0])
def test_anchors_lose_nothing_to_the_filter(spark, threshold):
    """Every text that either ratio lets through is scored."""
    from parcelforge.functions.fuzzy import best_window, indel

    texts = ["Thửa đất số: 12", "thua dat so", "Dien tich", "diện tích (m2)", "tich", "số vào sổ cấp", "Địa chỉ thửa đất", "abc", "đất số thửa", "dt"]
    t = spark.createDataFrame([("d", 0, i, x, 0.9, 0.0, 0.0, 1.0, 1.0) for i, x in enumerate(texts)], "doc_id string, page_index int, ord int, text string, confidence double, x1 double, y1 double, x2 double, y2 double")
    labels = ["thửa đất số", "diện tích", "địa chỉ"]
    got = {(r.text, r.label): r.score for r in spatial.find_anchors(t, spark.createDataFrame([(x, x) for x in labels], "field string, label string"), threshold).collect()}
    for x in texts:
        for label in labels:
            low = x.lower()
            short = len(label.split()) >= 2 and len(low.split()) == 1 and len(low) <= 5
            part, full = best_window(label, low), indel(label, low)
            score = 100.0 if label in low else 0.4 * part + 0.6 * full if len(label.split()) >= 2 and len(low) < 0.5 * len(label) else max(part, full)
            assert (not short and score >= threshold) == ((x, label) in got), (x, label, score)

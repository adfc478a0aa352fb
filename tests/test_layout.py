import random

import pytest
from pyspark.sql import functions as F

from parcelforge.operators import pages, spatial

SCHEMA = "doc_id string, page_index int, ord int, text string, confidence double, x1 double, y1 double, x2 double, y2 double"


def boxes(spark, *rows, doc="d"):
    return spark.createDataFrame([(doc, 0, i, t, 0.95, float(a), float(b), float(c), float(d)) for i, (t, a, b, c, d) in enumerate(rows)], SCHEMA)


def test_right_neighbour_and_inline(spark):
    t = boxes(spark, ("Thửa đất số:", 0, 100, 150, 130), ("123", 160, 100, 220, 130), ("Other", 0, 200, 100, 230))
    got = spatial.right_neighbours(t.where("ord = 0"), t).collect()
    assert [r.text for r in got] == ["123"]
    assert spark.range(1).select(spatial.inline_value(F.lit("Thửa đất số: 456"), F.lit("Thửa đất số")).alias("v")).first().v == "456"


@pytest.mark.parametrize("label", ["Tờ bản đồ số:", "Tờ bàn đồ số:"])
def test_extract_field(spark, label):
    t = boxes(spark, (label, 0, 100, 150, 130), ("78", 160, 100, 200, 130), ("Ghi chú", 0, 300, 100, 330))
    labels = spark.createDataFrame([("to_ban_do", "Tờ bản đồ số"), ("so_thua", "Thửa đất số")], "field string, label string")
    got = {r.field: r for r in spatial.extract_fields(t, labels).collect()}
    assert got["to_ban_do"].value == "78" and (got["to_ban_do"].x1, got["to_ban_do"].x2) == (160, 200)


def test_value_below(spark):
    t = boxes(spark, ("Mã vạch", 10, 100, 110, 120), ("9988", 20, 140, 100, 160))
    labels = spark.createDataFrame([("ma", "Mã vạch")], "field string, label string")
    assert [r.value for r in spatial.extract_fields(t, labels).collect()] == ["9988"]
    assert spatial.nearest_below(t.where("ord = 0"), t).first().text == "9988"


def test_split_serial(spark):
    t = boxes(spark, ("CD", 500, 850, 550, 880), ("754219", 560, 850, 700, 880), ("123456", 900, 850, 990, 880))
    assert [r.candidate for r in spatial.split_serials(t).collect()] == ["CD 754219"]


def plain_order(rows, tolerance=12.0):
    lines = []
    for r in sorted(rows, key=lambda r: (r[2], r[1], r[0])):
        for line in lines:
            if abs(r[2] - sum(x[2] for x in line) / len(line)) <= tolerance:
                line.append(r)
                break
        else:
            lines.append([r])
    lines.sort(key=lambda line: sum(x[2] for x in line) / len(line))
    return [r[0] for line in lines for r in sorted(line, key=lambda r: r[1])]


def test_reading_order_is_that_of_the_loop(spark):
    rng = random.Random(2)
    docs = {f"d{k}": [(i, float(rng.randrange(0, 40)), float(rng.randrange(0, 120))) for i in range(rng.randrange(1, 40))] for k in range(12)}
    rows = [(d, 0, i, "t", 0.9, x, y, x + 5, y + 5) for d, own in docs.items() for i, x, y in own]
    got = spatial.reading_order(spark.createDataFrame(rows, SCHEMA)).collect()
    for d, own in docs.items():
        assert [r.ord for r in sorted((r for r in got if r.doc_id == d), key=lambda r: r.position)] == plain_order([(i, x, y) for i, x, y in own])


def test_polygons_and_boxes(spark):
    t = spark.createDataFrame([([[1.0, 2.0], [5.0, 2.0], [5.0, 2.5], [1.0, 2.5]],)], "bbox array<array<double>>")
    r = spatial.with_box(t).first()
    assert (r.x1, r.y1, r.x2, r.y2, r.cx, r.w, r.h) == (1, 2, 5, 2.5, 3, 4, 1)
    b = boxes(spark, ("1", 100, 100, 200, 200)).select(*spatial.expand_box(F.lit(205.0), F.lit(1000.0))).first()
    assert (b.x1, b.y1, b.x2, b.y2) == (80, 75, 205, 225)


def test_thinning_and_bands(spark):
    c = spatial.thin_anchors(F.array(*[F.lit(float(x)) for x in (0, 10, 16, 30, 40)]), 15)
    assert spark.range(1).select(c.alias("r")).first().r == [0, 16, 40]


def test_templates_and_roles(spark):
    t = boxes(spark, ("TRANG BỔ SUNG GIẤY CHỨNG NHẬN", 0, 0, 10, 10), ("x", 0, 900, 10, 1000))
    assert pages.classify_template(t).first().template == "mau_B"
    role = lambda s, k="mau_A": spark.range(1).select(pages.page_role(F.lit(s), F.lit(k)).alias("r")).first().r
    assert role("IV. Những thay đổi sau khi cấp giấy") == "changes"
    assert role("CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM GIẤY CHỨNG NHẬN", "mau_B") == "cover"
    assert role("CỘNG HÒA XÃ HỘI GIẤY CHỨNG NHẬN thửa đất số 1") == role("Sơ đồ thửa đất") == "cover_and_content"
    assert role("Sơ đồ thửa đất, chiều dài cạnh", "mau_B") == "diagram" and role("", "mau_B") == role(" ") == "unknown"
    assert role("I. Người sử dụng đất II. Thửa đất", "mau_B") == role("Thửa đất số: 3", "mau_B") == role("gì đó", "mau_B") == "content"
    assert role("Trang bổ sung giấy chứng nhận", "mau_B") == "changes"


def test_page_selection(spark):
    rows = [("a", i, 900.0, 600.0, "") for i in range(2)] + [("a", 2, 500.0, 700.0, ""), ("a", 3, 500.0, 700.0, ""), ("a", 4, 500.0, 700.0, ""), ("a", 5, 600.0, 800.0, "")]
    rows += [("b", i, 600.0, 800.0, t) for i, t in enumerate(["Đơn đăng ký giấy chứng nhận", "GIẤY  CHỨNG NHẬN", "Biên lai thu tiền, diện tích: 5", "Thửa đất số 3", "y"])] + [("c", i, 1.0, 2.0, "") for i in range(4)]
    got = pages.select_certificate_pages(spark.createDataFrame(rows, "doc_id string, page_index int, width double, height double, text string")).collect()
    kept = {}
    for r in got:
        kept.setdefault(r.doc_id, []).append(r.page_index)
    assert {k: sorted(x) for k, x in kept.items()} == {"a": [0, 1, 2, 3], "b": [1, 3], "c": [0, 1, 2, 3]}
    halves = pages.split_spread(spark.createDataFrame([("a", 100.0, 50.0), ("b", 50.0, 100.0)], "doc_id string, width double, height double")).collect()
    assert sorted((r.doc_id, r.half, r.x_from, r.x_to) for r in halves) == [("a", 0, 0, 55), ("a", 1, 45, 100), ("b", 0, 0, 50)]

import pytest
from pyspark.sql import functions as F

from parcelforge.operators import tables

SCHEMA = "doc_id string, page_index int, ord int, text string, confidence double, x1 double, y1 double, x2 double, y2 double"
HEADS = [("Tờ bản đồ", 40, 200, 110, 220), ("Thửa đất số", 120, 200, 200, 220), ("Riêng", 220, 240, 270, 260), ("Chung", 300, 240, 350, 260), ("Mục đích sử dụng", 380, 200, 500, 220), ("Thời hạn sử dụng", 520, 200, 640, 220), ("Nguồn gốc sử dụng", 700, 200, 900, 220)]
TOTAL = [("a) Tổng số thửa đất: 3 thửa", 100, 120, 400, 140), ("b) Diện tích: 1500,5 m2", 100, 142, 400, 160)]
ROWS = [("12", "101", "500,5", "Đất trồng cây lâu năm", "Đến 10/2043", "Công nhận QSDĐ như giao đất không thu tiền"), ("", "102", "400,0", "trồng lúa nước", "?", "không rõ"), ("", "12103", "600,0", "đất ở tại nông thôn", "Lâu dài", "nhận chuyển nhượng")]
PLACES = ((60, 90), (140, 165), (220, 270), (380, 500), (520, 640), (700, 1200))
EDGE = ("x", 1200, 900, 1230, 910)


def frame(spark, boxes, doc="d"):
    return spark.createDataFrame([(doc, 0, i, t, 0.9, *map(float, at)) for i, (t, *at) in enumerate(boxes)], SCHEMA)


def cells(rows, top=300, step=60, shift=0):
    return [(t, a + shift, top + step * i, b + shift, top + step * i + 20) for i, r in enumerate(rows) for t, (a, b) in zip(r, PLACES, strict=True) if t]


def table(spark, boxes):
    return sorted(tables.extract_parcel_table(frame(spark, boxes)).collect(), key=lambda r: r.stt)


def test_rows_and_cells(spark):
    got = table(spark, [*TOTAL, *HEADS, *cells(ROWS), ("2. Nhà ở: -/-", 100, 600, 300, 620), ("999,9", 220, 650, 270, 670), EDGE])
    assert [(r.stt, r.so_thua, r.to_ban_do, r.dien_tich) for r in got] == [(1, "101", "12", 500.5), (2, "102", "12", 400.0), (3, "103", "12", 600.0)]
    assert [(r.ma_muc_dich, r.thoi_han, r.nguon_goc_ky_hieu) for r in got] == [("CLN", "Đến 10/2043", "CNQ-KTT"), ("LUC", "?", ""), ("ONT", "Lâu dài", "NCN")]
    assert {(r.total_parcels, r.total_area) for r in got} == {(3, 1500.5)}
    s = tables.table_summary(tables.extract_parcel_table(frame(spark, [*TOTAL, *HEADS, *cells(ROWS), EDGE]))).first()
    assert (s.so_thua, s.to_ban_do, s.n_rows) == ("101+102+103", "12", 3)


def test_default_columns_have_sheets_before_parcels(spark):
    """Without headings the first column is the sheet, the second the parcel, and areas follow."""
    got = table(spark, [TOTAL[0], *cells([(s, p, a, "", "", "") for s, p, a, *_ in (("5", "7", "120,5"), ("5", "8", "230,0"), ("6", "9", "90,0"))], top=400), EDGE])
    assert [(r.to_ban_do, r.so_thua, r.dien_tich) for r in got] == [("5", "7", 120.5), ("5", "8", 230.0), ("6", "9", 90.0)]


def test_equal_rows_where_areas_do_not_fit(spark):
    """Two areas for three rows: the table's height is cut in three."""
    rows = [("1", "11", "100,0", "", "", ""), ("1", "12", "", "", "", ""), ("1", "13", "300,0", "", "", "")]
    got = table(spark, [TOTAL[0], *HEADS, *cells(rows, top=320, step=190), EDGE])
    assert [(r.so_thua, r.dien_tich) for r in got] == [("11", 100.0), ("12", 300.0), ("13", 300.0)]


@pytest.mark.parametrize(("lines", "want"), [
    (["a) Tổng s6 thửa đất:6 thửa"], (True, 6)), (["aTong sthura dat:3thua"], (True, 3)), (["a) Tổng số: 4"], (True, 4)), (["Tổng số thửa đất: 1"], (False, None)), (["Tổng số thửa đất: 250"], (False, None)),
    (["a) Thửa đất số: 3", "b) Địa chỉ: x", "c) Diện tích: 20 m2"], (False, None)), (["Tờ bản đồ", "Thửa đất", "Diện tích", "120,5", "120,5"], (False, None)), (["Tờ bản đồ", "Thửa đất", "Diện tích", "120,5", "99,1"], (True, 2)),
    (["CMND 012345678", "Thửa đất số 5"], (False, None)),
])
def test_multi_parcel_pages(spark, lines, want):
    r = tables.multi_parcel_pages(frame(spark, [(t, 0, 30 * i, 10, 30 * i + 10) for i, t in enumerate(lines)])).first()
    assert (r.is_multi, r.total_parcels) == want


def test_no_table(spark):
    assert tables.extract_parcel_table(frame(spark, [("abc", 0, 0, 10, 10)])).count() == 0
    assert tables.extract_parcel_table(frame(spark, [*TOTAL, *HEADS, EDGE])).count() == 0
    assert tables.extract_parcel_table(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sheets_are_carried(spark):
    rows = [("1", None, None), (None, "5", None), ("2", "6", None), (None, None, "2107"), (None, None, "9999")]
    c = tables.carry_sheets(F.array(*[F.struct(*[F.lit(x).cast("string").alias(n) for x, n in zip(r, ("sheet", "parcel", "glued"), strict=True)]) for r in rows]))
    got = spark.range(1).select(c.alias("r")).first().r
    assert [tuple(x) for x in got] == [("1", None), ("1", "5"), ("2", "6"), ("2", "107"), ("1", None)]

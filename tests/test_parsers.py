import pytest
from pyspark.sql import functions as F

from parcelforge.functions import parsers as p
from parcelforge.operators import changes, gazetteer, tables

SCHEMA = "doc_id string, page_index int, ord int, text string, confidence double, x1 double, y1 double, x2 double, y2 double"


def at(spark, c):
    return spark.range(1).select(c.alias("r")).first().r


def boxes(spark, *rows):
    return spark.createDataFrame([("d", 0, i, t, 0.9, float(a), float(b), float(c), float(d)) for i, (t, a, b, c, d) in enumerate(rows)], SCHEMA)


def lines(*texts):
    return F.array(*[F.lit(t) for t in texts])


@pytest.mark.parametrize(("text", "want"), [("1.250,5 m²", 1250.5), ("1,250.5 m2", 1250.5), ("125,5", 125.5), ("125.5 m2", 125.5), ("1.250", 1250.0), ("12", 12.0), ("không", None)])
def test_numbers(spark, text, want):
    assert at(spark, p.parse_number(F.lit(text))) == want


def test_area_page(spark):
    page = spark.range(1).select(lines("c) Diện tích: 150,5 m²", "Bằng chữ: một trăm năm mươi phẩy năm mét vuông", "Sử dụng riêng: 150,5 m²; chung: 0 m²").alias("l"))
    area = page.select(p.parse_area(F.col("l")).alias("a"))
    r = area.select("a", p.area_from_words(F.col("a")).alias("n")).select("n", p.settle_area(F.col("a"), F.col("n")).alias("s")).first()
    assert r.n == 150.5 and (r.s.granted, r.s.private, r.s.shared) == (150.5, 150.5, 0.0)
    only = spark.range(1).select(lines("Bằng chữ: (một trăm mét vuông)").alias("l")).select(p.parse_area(F.col("l")).alias("a"))
    s = only.select("a", p.area_from_words(F.col("a")).alias("n")).select(p.settle_area(F.col("a"), F.col("n")).alias("s")).first().s
    assert (s.granted, s.private) == (100.0, 100.0)
    u = at(spark, p.parse_area_text(F.lit("1.250,5 mét vuông")))
    assert (u.value, u.unit) == (1250.5, "mét vuông")


def test_identity(spark):
    assert at(spark, p.identity_numbers(F.lit("CMND 168234567, CCCD 001092001234, 168234567, 12345"))) == ["168234567", "001092001234"]
    assert at(spark, p.birth_years(F.lit("sinh năm 1950, 2001; 12345"))) == ["1950", "2001"]
    card = lines("CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM", "CĂN CƯỚC CÔNG DÂN", "Số / No.: 001 092 001 234", "Họ và tên / Full name:", "NGUYỄN VĂN AN", "Ngày sinh: 05/02/1992", "Giới tính / Sex: Nam", "Nơi thường trú: xã Hoa Thám")
    r = at(spark, p.parse_id_card(card))
    assert (r.so_cccd, r.ho_ten, r.ngay_sinh, r.gioi_tinh, r.noi_thuong_tru) == ("001092001234", "NGUYỄN VĂN AN", "05/02/1992", "nam", "xã Hoa Thám")
    back = lines("IDVNM0920012340001092001234<<8", "9202053M2502051VNM<<<<<<<<<<<4", "NGUYEN<<VAN<AN<<<<<<<<<<<<<<<<")
    z = at(spark, p.machine_readable(back))
    assert (z.ho_ten, z.ngay_sinh, z.gioi_tinh) == ("NGUYEN VAN AN", "05/02/1992", "nam")
    assert at(spark, p.parse_id_card(back)).ho_ten == "NGUYEN VAN AN"
    audit = lambda s, *r: tuple(at(spark, p.audit_identity(F.lit(s), lines(*r))))
    assert audit("001092001234", "001 092 001 234") == ("supported", "digits_agree")
    assert audit("001092001234", "168234567") == ("review_required", "digits_differ") and audit("1", "x")[0] == "not_available"


def test_barcode_prune_and_purpose(spark):
    step = lambda *a: tuple(at(spark, p.barcode_ladder(*a)))
    none = F.array().cast("array<string>")
    assert step(F.lit("1234567890123"), F.lit(0.95), F.lit(None).cast("string"), none) == ("1234567890123", "direct")
    assert step(F.lit("12"), F.lit(0.95), F.lit("123456789012345"), none) == ("123456789012345", "reread")
    assert step(F.lit("12"), F.lit(0.95), F.lit(""), F.array(F.lit("12345678901234")))[1] == "page"
    r = at(spark, p.prune_border(F.lit("Diện tích: 120,5 m2."), "diện tích", True))
    assert (r.raw, r.pruned) == ("Diện tích: 120,5 m2.", "120,5") and r.removed
    assert at(spark, p.prune_border(F.lit("a) - Giá trị ;"))).pruned == "Giá trị"
    code = lambda c, w: at(spark, p.map_purpose(F.lit(c), F.lit(w)))
    assert [code("", "Đất ở tại đô thị"), code("LUA", ""), code("CLN", ""), code("", "đất trồng cây lâu năm"), code("", "???")] == ["ODT", "LUC", "CLN", "CLN", ""]
    assert at(spark, p.word_error_rate(F.lit("a b x"), F.lit("a b c d"))) == 0.5
    up = F.array(F.struct(F.lit("GIẤY CHỨNG NHẬN").alias("text"), F.lit(900.0).alias("y")))
    assert at(spark, p.upside_down(up, F.lit(1000.0)))
    box = lambda *b: F.struct(*[F.lit(float(x)).alias(n) for x, n in zip(b, ("x1", "y1", "x2", "y2"), strict=True)])
    assert at(spark, p.signing_block(box(100, 100, 300, 130), box(120, 200, 320, 230))) and not at(spark, p.signing_block(box(100, 100, 300, 130), box(120, 2000, 320, 2030)))


def test_mutations(spark):
    t = boxes(
        spark,
        ("Nội dung thay đổi và cơ sở pháp lý", 50, 50, 500, 80),
        ("Xác nhận của cơ quan có thẩm quyền", 700, 50, 1100, 80),
        ("Thế chấp tại ngân hàng", 60, 100, 500, 130),
        ("hồ sơ số 123.TC ngày 05/2/2019", 60, 135, 500, 165),
        ("Xóa thế chấp ngày 06/03/2020", 60, 300, 500, 330),
        ("Chi nhánh Văn phòng đăng ký đất đai", 700, 110, 1100, 140),
        ("Người được cấp giấy chứng nhận không được sửa chữa", 50, 1500, 900, 1530),
    )
    got = sorted(changes.extract_mutations(t).collect(), key=lambda r: r.stt)
    assert [(r.stt, r.type, r.date, r.file_no) for r in got] == [(1, "the_chap", "05/02/2019", "123.TC"), (2, "the_chap", "06/03/2020", None)]
    assert got[0].agency == "CHI NHANH VAN PHONG DANG KY DAT DAI" and got[0].content == "Thế chấp tại ngân hàng hồ sơ số 123.TC ngày 05/2/2019" and got[1].confirmation == ""
    assert changes.extract_mutations(boxes(spark, ("x", 0, 0, 1, 1))).count() == 0


def test_endorsements(spark):
    rows = [("d", 1, "Đăng ký thế chấp ngày 01/02/2018 hồ sơ 123456.TC.001"), ("d", 2, "Xóa đăng ký thế chấp ngày 01/02/2019"), ("d", 3, "Chuyển nhượng cho ông Trần Văn Bình, sinh năm 1970"), ("e", 1, "Thế chấp tại ngân hàng")]
    e = changes.parse_endorsements(spark.createDataFrame(rows, "doc_id string, stt int, text string"))
    assert [(r.kind, r.new_owner) for r in sorted(e.collect(), key=lambda r: (r.doc_id, r.stt))] == [("mortgage", None), ("release", None), ("transfer", "Trần Văn Bình"), ("mortgage", None)]
    assert e.where("stt = 1 and doc_id = 'd'").first().file_no == "123456.TC.001"
    assert {r.doc_id: (r.mortgage_active, r.current_owner) for r in changes.endorsement_state(e).collect()} == {"d": (False, "Trần Văn Bình"), "e": (True, None)}


def test_gazetteer(spark):
    provinces = spark.createDataFrame([("20", "Tỉnh Lạng Sơn"), ("10", "Tỉnh Lào Cai")], "code string, name string")
    districts = spark.createDataFrame([("181", "Huyện Bình Gia", "20"), ("182", "Huyện Văn Lãng", "20"), ("80", "Huyện Bát Xát", "10")], "code string, name string, province_code string")
    wards = spark.createDataFrame([("1", "Xã Hoa Thám", "181"), ("2", "Xã Hưng Đạo", "181")], "code string, name string, district_code string")
    m = gazetteer.match_level(spark.createDataFrame([("Lang Sm",), ("Xyz",)], "text string"), provinces, "province").collect()
    assert [(r.text, r.province_code, r.province_score) for r in m] == [("Lang Sm", "20", pytest.approx(80.0))]
    rows = [(1, "thôn Bản Cao, xã Hoa Tham, huyện Bình Gia, tỉnh Lạng Sơn"), (2, "xã Hưng Đạo, huyện Binh Gia, tỉnh Qqq"), (3, "không rõ"), (4, None)]
    got = {r.id: r for r in gazetteer.resolve_addresses(spark.createDataFrame(rows, "id int, address string"), provinces, districts, wards).collect()}
    assert (got[1].province_code, got[1].district_code, got[1].ward_code, got[1].rest) == ("20", "181", "1", "thôn Bản Cao")
    assert (got[2].province_code, got[2].district_code, got[2].ward_code) == ("20", "181", "2") and got[3].province is None and got[4].ward is None and len(got) == 4


def test_parcels_of_a_text(spark):
    pairs = at(spark, tables.parcels_from_text(F.lit("Số thửa Tờ bản đồ Diện tích 12 45 120,5 13 45 230 Ghi chú")))
    assert [(r.so_thua, r.dien_tich) for r in pairs] == [(12.0, 120.5), (13.0, 230.0)]


def test_registration_table(spark):
    t = boxes(
        spark,
        ("Đăng ký đất đai, tài sản khác gắn liền", 50, 100, 450, 130), ("Theo chỉ thị 299", 600, 100, 900, 130), ("Số thửa", 80, 150, 160, 170), ("Số tờ bản đồ", 250, 150, 360, 170),
        ("38", 100, 200, 140, 220), ("109", 280, 200, 330, 220), ("06", 650, 200, 690, 220), ("03", 800, 200, 840, 220),
    )
    r = tables.registration_parcel(t).first()
    assert (r.parcel, r.sheet) == ("38", "109")
    assert tables.registration_parcel(boxes(spark, ("Số thửa", 0, 0, 10, 10), ("38", 0, 20, 10, 30))).count() == 0

import pytest
from pyspark.sql import functions as F

from parcelforge.functions import addresses
from parcelforge.operators import certificate as c
from parcelforge.operators import documents, registration

PAGES = f"doc_id string, page_index int, template string, lines array<string>, fields map<string,string>, confidence map<string,double>, parcels {c.PARCEL}, heirs {c.HEIRS}"
TOKENS = "doc_id string, page_index int, ord int, text string, confidence double, x1 double, y1 double, x2 double, y2 double"
P = [("1", "5", "thôn A", 100.0, "đất ở tại nông thôn", "ONT", "Lâu dài", "nhận chuyển nhượng", ""), ("2", "5", "", 50.5, "", "", "", "", "")]
ROWS = [
    ("d", 0, "mau_B", ["CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM", "I. Người sử dụng đất"], {"ho_ten_chu_1": "Ông Nguyễn Văn An và vợ bà Trần Thị Bình", "cmnd_chu_1": "012345678, 001185001234", "ngay_sinh_chu_1": "1960, 1962", "dia_chi_thuong_tru": "Địa chỉ thường trú: thôn Bản Cao, xã Hoa Thám", "so_phat_hanh": "rác"}, {}, [], []),
    ("d", 1, "mau_B", ["II. Thửa đất", "Tổng số thửa: 3", "Mục đích sử dụng"], {"so_thua": "1+2", "to_ban_do": "05", "dien_tich_cap": "150,5", "muc_dich_su_dung": "Đất ở tại nông thôn", "thoi_han": "lâu dài", "nguon_goc": "công nhận QSDĐ như giao đất có thu tiền", "ma_muc_dich": "ONT+ODT", "ngay_cap": "ngày 15 tháng 10 năm 2018", "ty_le": "1/2001"}, {"so_thua": 0.8}, P, []),
    ("d", 2, "mau_B", ["TM. UBND huyện Bình Gia", "KT. CHỦ TỊCH", "Nguyễn Văn Sơn", "Số vào sổ cấp GCN: CH 00123"], {"chuc_vu_nguoi_ky": "Chủ tịch", "so_phat_hanh": "BP 425774", "noi_cap": "UBND huyện Khác"}, {}, [], []),
    ("d", 3, "mau_B", ["IV. Những thay đổi sau khi cấp", "không được sửa chữa", "0600123456789"], {"thong_tin_bien_dong": "chuyển nhượng cho ông Trần Văn Cường", "ten_chuyen_nhuong_moi": "Trần Văn Cường"}, {}, [], []),
    ("e", 0, "unknown", [], {}, {}, [], [("Lê Văn Tư", "012345678", "1950", "nam")]),
    ("f", 0, "mau_A", ["giấy chứng nhận"], {"ho_ten_chu_1": "Hộ ông Lê Văn Tư", "cmnd_chu_1": "thôn Bản", "noi_cap": "UBND huyện Khác", "dien_tich_cap": "sàn", "dien_tich_rieng": "80,0", "cccd_chu_2": "001185001234", "ho_ten_chu_2": "-"}, {}, [], []),
]


@pytest.fixture(scope="module")
def merged(spark):
    out = c.merge_pages(spark.createDataFrame(ROWS, PAGES))
    return spark.createDataFrame(out.collect(), out.schema)


def test_fields_of_a_couple(merged):
    d = {r.doc_id: r for r in merged.collect()}["d"]
    value = lambda f: (d[f].value, d[f].page, d[f].status)
    assert value("so_phat_hanh") == ("BP 425774", 3, "valid") and d.so_phat_hanh.confidence == 0.9
    assert value("so_vao_so") == ("CH00123", 3, "valid") and value("ma_vach") == ("0600123456789", 4, "valid")
    assert (d.ho_ten_chu_1.value, d.ho_ten_chu_2.value, d.loai_chu.value, d.dong_su_dung) == ("Nguyễn Văn An", "Trần Thị Bình", "Vợ chồng / Đồng sở hữu", "Có (Vợ chồng)")
    assert (d.cccd_chu_1.value, d.cccd_chu_2.value, d.nam_sinh_chu_1.value, d.nam_sinh_chu_2.value) == ("012345678", "001185001234", "1960", "1962")
    assert value("so_thua") == ("1+2", 2, "valid") and d.so_thua.confidence == 0.8 and value("to_ban_do") == ("5", 2, "valid")
    assert (d.ma_muc_dich.value, d.thoi_han_su_dung.value, d.nguon_goc_ky_hieu, d.ngay_cap.value) == ("ONT", "Lâu dài", "GT", "15/10/2018")
    assert value("ty_le_ban_do")[2] == "review_required" and d.ty_le_ban_do.confidence <= 0.4 and d.ty_le_ban_do.reason == "suspect"
    # authority and signer are read from lines, never taken from fields
    assert d.noi_cap.value == "Ủy ban nhân dân huyện Binh Gia" and d.nguoi_ky_qd.value == "Nguyễn Văn Sơn"
    assert d.parcel_reasons == ["row_count_mismatch:2!=3"] and [p.dia_chi for p in d.parcels] == ["thôn A", "thôn A"]
    # a document's origin is not every parcel's
    assert [p.nguon_goc_ky_hieu for p in d.parcels] == ["NCN", ""] and d.dia_chi_thua.value == "thôn A"
    assert d.thong_tin_bien_dong.status == "valid" and d.ten_chuyen_nhuong_moi == "Trần Văn Cường"
    assert d.can_review == ["danh_sach_thua", "ty_le_ban_do"]


def test_fields_without_evidence(merged):
    got = {r.doc_id: r for r in merged.collect()}
    e, f = got["e"], got["f"]
    assert e.loai_chu.value == "Đồng thừa kế" and e.ho_ten_chu_2.status == "not_applicable" and e.so_thua.status == "missing" and e.template == "mau_A"
    assert e.can_review == ["nguoi_ky_qd", "noi_cap", "so_vao_so"]
    assert f.noi_cap.value is None and f.noi_cap.status == "review_required" and f.loai_chu.value == "Hộ gia đình"
    assert f.cccd_chu_1.status == "missing" and f.ho_ten_chu_2.status == "not_applicable"
    assert (f.dien_tich_cap.value, f.dien_tich_rieng.value, f.hinh_thuc_su_dung.value) == ("80.0", "80.0", "Sử dụng riêng")


def test_changes_and_answers(spark, merged):
    flat = c.flat_values(merged)
    changes = spark.createDataFrame([("d", 3, 1, "Đính chính tờ bản đồ số thành 7"), ("d", 3, 2, "thay đổi CCCD thành 001160001111"), ("f", 0, 1, "x")], "doc_id string, page_index int, stt int, content string")
    got = {r.doc_id: r for r in c.apply_mutations(flat, changes).collect()}
    assert (got["d"].to_ban_do, got["d"].to_ban_do_goc, got["d"].cccd_chu_1, got["d"].cccd_chu_1_goc, got["d"].changed_by) == ("7", "5", "001160001111", "012345678", "rules")
    assert [p.to_ban_do for p in got["d"].parcels] == ["7", "7"] and got["e"].changed_by is None and got["f"].changed_by is None
    answers = spark.createDataFrame([("d", "9", None)], "doc_id string, to_ban_do string, so_thua string")
    d = {r.doc_id: r for r in c.apply_mutations(flat, changes, answers).collect()}["d"]
    assert (d.to_ban_do, d.cccd_chu_1, d.cccd_chu_1_goc, d.changed_by) == ("9", "012345678", None, "model")


def test_serial_scores(spark):
    rows = [("BP 425774", 100, 100, 200, 120), ("Số phát hành: CV 260084", 100, 200, 300, 220), ("CD", 100, 700, 130, 720), ("754219", 150, 702, 220, 722), ("AB 123456", 400, 900, 500, 920), ("CMND số AA 111111", 0, 300, 90, 320)]
    t = spark.createDataFrame([("d", 0, i, x, 0.8, *map(float, at)) for i, (x, *at) in enumerate(rows)], TOKENS)
    got = {r.serial: (r.score, r.strategy, r.confidence) for r in c.serial_candidates(t).collect()}
    assert got == {"CV 260084": (100, "anchor", 0.95), "BP 425774": (50, "standalone", 0.8), "CD 754219": (80, "split_box", 0.8), "AB 123456": (85, "cover_bottom", 0.8)}
    assert c.best_serials(c.serial_candidates(t)).first().best.serial == "CV 260084"


def test_land_codes(spark):
    one = lambda code, text: spark.range(1).select(c.select_land_code(F.lit(code), F.lit(text)).alias("r")).first().r
    assert one("ONT+ODT", "đất ở tại đô thị") == "ODT" and one("CLN", "") == "CLN" and one("", "") == ""
    assert one("CLN", "đất ở tại nông thôn, đất trồng cây lâu năm") == "CLN" and one("", "đất ở tại nông thôn và đất trồng cây lâu năm") == "ONT+CLN"


ADDRESSES = [
    ("Địa chỉ thường trú: Thôn Khuổi Dui, xa Vinh Yên huyện Bình Gia tỉnh Lang Sơn BH 405659", ("", "", "Thôn Khuổi Dụi", "Vĩnh Yên", "Bình Gia", "Lạng Sơn", "Thôn Khuổi Dụi, xã Vĩnh Yên, huyện Bình Gia, tỉnh Lạng Sơn")),
    ("Số 12/3 đường Tôn Đức Tháng, phường An Dương, quận Lê Châu, thành phố Hải Phòng Nguyễn Văn", ("12/3", "Tôn Đức Thắng", "", "An Dương", "Lê Chân", "Hải Phòng", "Số 12/3 đường Tôn Đức Thắng, phường An Dương, quận Lê Chân, thành phố Hải Phòng")),
    ("UBND huyện Cao Lộc", ("",) * 7), ("Nguyễn Văn A", ("",) * 7), (None, ("",) * 7), ("", ("",) * 7),
    ("Diện tích 20 m2 Thôn Bản Cao, xã Hoa Thám; abc", ("", "", "Thôn Bản Cao", "Hoa Thám", "", "", "Thôn Bản Cao, xã Hoa Thám")),
    ("thôn Bản Cao, xã Hoa Thám, Và bà: Trần Thị B", ("", "", "thôn Bản Cao", "Hoa Thám", "", "", "thôn Bản Cao, xã Hoa Thám")),
]


def test_addresses(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(ADDRESSES)], "i int, t string")
    got = df.select("i", addresses.decompose_address(F.col("t")).alias("p"), addresses.is_contaminated_address(F.col("t")).alias("bad"), addresses.looks_like_table_noise(F.col("t")).alias("noise")).collect()
    for r in got:
        assert tuple(r.p[k] for k in addresses.PARTS) == ADDRESSES[r.i][1], ADDRESSES[r.i]
    assert {r.i for r in got if r.bad} == {2, 4, 5, 6} and {r.i for r in got if r.noise} == {6}
    whole = spark.range(1).select(addresses.with_upper_units(F.lit("thôn A, xã B"), F.lit("Cao Lộc"), F.lit("Lạng Sơn")).alias("x")).first().x
    assert whole == "thôn A, xã B, huyện Cao Lộc, tỉnh Lạng Sơn"


def test_registration_rows(spark):
    schema = f"doc_id string, ho_ten_chu_1 string, cccd_chu_1 string, dia_chi_thuong_tru string, so_thua string, to_ban_do string, dien_tich_cap string, muc_dich_su_dung string, so_phat_hanh string, source_path string, raw_text string, nha_o string, parcels {c.PARCEL}, heirs {c.HEIRS}"
    home = "Thôn Khuổi Dui, xã Vĩnh Yên, huyện Bình Gia, tỉnh Lạng Sơn"
    rows = [
        ("a", "Ông Nguyễn Văn An và vợ bà Trần Thị Bình", "012345678", home, "1+2", "5", "150,5", "", "BP 425774", "/x/Tờ 12/Thửa 3/BP425774.pdf", "sinh năm 01/02/1960\nSố vào sổ cấp GCN: CH 00123\nngày 15\ntháng 10 năm 2018", "Nhà cấp 4", P, []),
        ("b", "Ông Lê Văn Tư", "", "", "7", "3", "20", "LUA", "", "", "", "", [], [("Lê Văn Tư", "012345678", "1950", "nam"), ("bà Lê Thị Năm", "001185001234", "1985", "nữ")]),
        ("c", None, None, None, None, None, None, None, None, None, None, None, None, None),
    ]
    out = registration.registration_rows(spark.createDataFrame(rows, schema))
    assert [x for x in out.columns if not x.startswith("_")] == ["doc_id", *registration.COLUMNS] and len(registration.COLUMNS) == 129
    a1, a2, b1, b2, c1 = sorted(out.collect(), key=lambda r: (r.doc_id, r.STT))
    assert (a1.GCN_soPhatHanh, a1.GCN_soVaoSo, a1.GCN_ngayCap, a1.DDK_maDon, a2.DDK_maDon) == ("BP 425774", "CH00123", "15/10/2018", "DON_1", "DON_2")
    assert (a1.CHU_hoTen, a1.VC_hoTen, a1.CHU_loaiGiayChungNhan, a1.GT_loaiGiayTo, a1.CHU_gioiTinh, a1.VC_gioiTinh) == ("Nguyễn Văn An", "Trần Thị Bình", "Vợ chồng", "CMND", "1", "0")
    assert (a1.CHU_tenTDP, a1.CHU_tenXa, a1.VC_tenHuyen, a1.VC_tenTinh, a1.NHA_tenTDP) == ("Thôn Khuổi Dụi", "Vĩnh Yên", "Bình Gia", "Lạng Sơn", a1.TD_tenTDP)
    assert [(r.TD_soThuTuThua, r.TD_soHieuToBanDo, r.TD_dienTich, r.TD_maMucDichSuDung) for r in (a1, a2)] == [("1", "5", 100.0, "ONT"), ("2", "5", 50.5, "")]
    assert a2._reasons == ["missing_land_use_purpose", "missing_land_use_term", "missing_land_use_origin"] and a2._missing_core == ["TD_maMucDichSuDung"]
    assert (b1.CHU_hoTen, b1.VC_hoTen, b1.DDK_capGiayNguoiDaiDien, b1.TD_maMucDichSuDung) == ("Lê Văn Tư", "", "1", "LUC")
    assert (b2.CHU_hoTen, b2.VC_hoTen, b2.GT_loaiGiayTo, b2.CHU_ngaySinh, b2.CHU_loaiGiayChungNhan, b2.STT) == ("Lê Thị Năm", "Lê Văn Tư", "CCCD", "1985", "Đồng thừa kế", 2)
    assert c1.CHU_hoTen == "" and c1._core_incomplete == 1 and len(c1._missing_core) == 10


def page(doc, index, *lines):
    return [(doc, index, i, t, 0.9, 100.0, 60.0 + 40 * i, 100.0 + 12 * len(t), 80.0 + 40 * i) for i, t in enumerate(lines)]


def test_tokens_to_rows(spark):
    """The whole way from tokens to the sheet."""
    tokens = page("x", 0, "CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM", "GIẤY CHỨNG NHẬN", "I. Người sử dụng đất", "Ông: Nguyễn Văn An, sinh năm 1960, CMND số 012345678", "Địa chỉ thường trú: thôn Bản Cao, xã Hoa Thám, huyện Bình Gia, tỉnh Lạng Sơn", "Số phát hành: BP 425774")
    tokens += page("x", 1, "II. Thửa đất", "a) Thửa đất số: 12, tờ bản đồ số: 5", "b) Địa chỉ: thôn Bản Cao, xã Hoa Thám", "c) Diện tích: 150,5 m2", "đ) Mục đích sử dụng: Đất ở tại nông thôn", "e) Thời hạn sử dụng: Lâu dài", "g) Nguồn gốc sử dụng: nhận chuyển nhượng", "Bình Gia, ngày 15 tháng 10 năm 2018", "TM. UBND huyện Bình Gia", "CHỦ TỊCH", "Nguyễn Văn Sơn", "Số vào sổ cấp GCN: CH 00123")
    frame = spark.createDataFrame(tokens, TOKENS)
    r = documents.process_documents(frame, spark.createDataFrame([("x", "/in/x.pdf")], "doc_id string, source_path string")).first()
    assert (r.GCN_soPhatHanh, r.GCN_soVaoSo, r.GCN_ngayCap, r.GCN_tenNguoiKy, r.GCN_donViCap) == ("BP 425774", "CH00123", "15/10/2018", "Nguyễn Văn Sơn", "Ủy ban nhân dân huyện Binh Gia")
    assert (r.CHU_hoTen, r.CHU_ngaySinh, r.GT_soGiayTo, r.CHU_tenXa) == ("Nguyễn Văn An", "1960", "012345678", "Hoa Thám")
    assert (r.TD_soThuTuThua, r.TD_soHieuToBanDo, r.TD_dienTich, r.TD_maMucDichSuDung, r.TD_thoiHanSuDung) == ("12", "5", 150.5, "ONT", "Lâu dài")
    assert r.TD_diaChiChiTiet == "thôn Bản Cao, xã Hoa Thám, huyện Bình Gia, tỉnh Lạng Sơn" and r.HS_duongDanHSQ == "/in/x.pdf"

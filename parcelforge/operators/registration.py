"""The fixed registration layout: its columns by section, rows from merged documents, and the sheet's alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelforge.functions import parsers
from parcelforge.functions import validators as v
from parcelforge.functions.addresses import clean_mapped_address, decompose_address, is_authority_text, is_contaminated_address, looks_like_table_noise, with_upper_units
from parcelforge.functions.labels import after_label, before_label, holds
from parcelforge.functions.lines import extract_registry_number
from parcelforge.functions.text import clean_person_name, contains_any, detect_gender, digits_only, fold_accents, nullify_placeholder
from parcelforge.operators.expand import missing_core
from parcelforge.operators.merge import cross_validate_serial, split_couple

# ---------------------------------------------------------------- fixed values
# Section, its key and its column codes, in the order of the sheet.
SECTIONS = (
    ("Chung", "chung", "STT"),
    ("Đơn đăng ký", "ddk", "DDK_maXa DDK_maDon DDK_ngayTiepNhan DDK_coQuyenQuanLy DDK_coQuyenSuDung DDK_coQuyenSoHuu DDK_thoiDiemDangKyLanDau DDK_thoiDiemDangKy DDK_capGiayNguoiDaiDien"),
    ("Giấy chứng nhận", "gcn", "GCN_soPhatHanh GCN_soVaoSo GCN_soVaoSoCu GCN_ngayCap GCN_tenNguoiKy GCN_maVach GCN_donViCap GCN_daCongNhanPhapLy GCN_ghiChuTrang1 GCN_ghiChuTrang2"),
    ("Thông tin chủ sử dụng/đại diện", "chu", "CHU_loaiGiayChungNhan CHU_loaiDoiTuongSuDungDat CHU_hoTen CHU_ngaySinh CHU_soDienThoai CHU_gioiTinh CHU_maSoThue CHU_danToc CHU_quocTich CHU_diaChiChiTiet CHU_soNha CHU_tenDuongPho CHU_tenTDP CHU_tenXa"),
    ("Giấy tờ tùy thân (Chủ)", "gt_chu", "CHU_tenHuyen CHU_tenTinh GT_loaiGiayTo GT_soGiayTo GT_ngayCap GT_noiCap VC_hoTen"),
    ("Thông tin vợ/chồng", "vc", "VC_ngaySinh VC_soDienThoai VC_gioiTinh VC_maSoThue VC_danToc VC_quocTich VC_diaChiChiTiet VC_soNha"),
    ("Giấy tờ tùy thân (Vợ/Chồng)", "gt_vc", "VC_tenDuongPho VC_tenTDP VC_tenXa VC_tenHuyen VC_tenTinh GT_VC_loaiGiayTo GT_VC_soGiayTo"),
    ("Giấy tờ tùy thân", "chung", "GT_VC_ngayCap GT_VC_noiCap"),
    ("Thông tin tổ chức", "chung", "TC_tenToChuc TC_maSoThue TC_loaiToChuc TC_maDoanhNghiep TC_diaChi"),
    ("Tài liệu đo đạc", "chung", "TL_loaiBanDoDiaChinh TL_donViDoDac TL_phuongPhapDo TL_mucDoChinhXac TL_tyLeDoDac TL_ngayHoanThanh"),
    ("Thửa đất", "thua_dat", "TD_loaiThuaDat TD_soThuTuThua TD_soHieuToBanDo TD_soThuTuThuaCu TD_soHieuToBanDoCu TD_dienTich TD_dienTichPhapLy TD_diaChiChiTiet TD_soNha TD_tenDuongPho TD_tenTDP TD_laDoiTuongChiemDat TD_inSoLieuCu TD_maMucDichSuDung TD_maMucDichSuDungQuyHoach TD_maMucDichSuDungPhu TD_dienTichMDSD TD_ngayHetHanSuDung TD_thoiHanSuDung TD_nguonGoc TD_nguonGocChuyenQuyen TD_dienTichNguonGoc"),
    ("Nhà Riêng Lẻ/Nhà Chung Cư", "nha_rieng", "NHA_loaiNhaRiengLe NHA_loaiQuyenSoHuuNhaRiengLe NHA_tenNha NHA_diaChiChiTiet NHA_soNha NHA_tenDuongPho NHA_tenTDP NHA_dienTichSan NHA_dienTichSanPhu NHA_dienTichSuDung NHA_dienTichXayDung NHA_capHang NHA_ketCau NHA_soTang NHA_soTangHam NHA_tongSoCan NHA_namXayDung NHA_namHoanThanh NHA_thoiHanSoHuu"),
    ("Hạng Mục Sở Hữu Chung Của Chung Cư", "chung", "HM_tenHangMuc HM_viTriTang HM_dienTich HM_ghiChu"),
    ("Căn Hộ", "chung", "CH_loaiCanHo CH_tangSo CH_soHieuCanHo CH_loaiQuyenSoHuuCanHo CH_dienTichSan CH_dienTichSuDung"),
    ("Cây Lâu Năm", "cay", "CLN_tenCayLauNam CLN_loaiCayTrong CLN_dienTich"),
    ("Rừng Trồng", "rung", "RT_tenRung RT_loaiCayRung RT_dienTich"),
    ("Hồ sơ", "chung", "HS_duongDanHSQ COL_128 COL_129"),
)
CORE = ("GCN_soPhatHanh", "GCN_soVaoSo", "GCN_ngayCap", "CHU_hoTen", "GT_soGiayTo", "TD_soThuTuThua", "TD_soHieuToBanDo", "TD_dienTich", "TD_maMucDichSuDung", "TD_diaChiChiTiet")
#: What the sheet colours, besides the registry number.
ALERT_CORE = ("GCN_soPhatHanh", "GCN_soVaoSo", "GCN_ngayCap", "GCN_tenNguoiKy", "GCN_donViCap", "CHU_hoTen", "GT_soGiayTo", "TD_soThuTuThua", "TD_soHieuToBanDo", "TD_dienTich")
#: Numbers that stand for none, longest values, the nationality and the kind of subject that rows get.
NO_REGISTRY, SERIAL_SIGNS, REGISTRY_SIGNS, CODE_SIGNS, NATIONALITY, SUBJECT = ("CH00000", "CN00000"), 15, 25, 15, "VNM", "GDC"
#: Lines whose dates are not the date of issue.
OTHER_DATES = ("sinh năm", "hạn sử dụng", "thời hạn", "đến ngày", "mục đích", "chuyển nhượng", "thu hồi", "nội dung thay đổi", "nội dung bổ sung")
#: Parcel numbers that are corners of a drawing, and what a sheet number never holds.
CORNERS, SHEET_NOISE = ("0+0", "0+0+2+0", "7+3", "0", "00"), ("tray", "bk", "m-", "bản đồ", "tỷ lệ")
SPOUSE_MARKS = ("va ba", "va ong", "vo la ba", "vo la", "chong la ong", "chong la", "va vo la ba", "va vo la", "va chong la")
KIND_COUPLE, KIND_HOUSEHOLD, KIND_PERSON, KIND_HEIR = "Vợ chồng", "Hộ gia đình", "Cá nhân", "Đồng thừa kế"
HOUSE_NAME, TREES, FOREST = "Nhà ở", "Cây lâu năm", "Rừng trồng"
TREE_WORDS, FOREST_WORDS = ("cây", "cay", "ăn quả"), ("rừng", "rung", "sản xuất")
# ---------------------------------------------------------------- end of fixed values

COLUMNS = tuple(code for _, _, codes in SECTIONS for code in codes.split())
#: Columns of an address in the sheet and its parts.
ADDRESS = {"diaChiChiTiet": "dia_chi_chi_tiet", "soNha": "so_nha", "tenDuongPho": "ten_duong_pho", "tenTDP": "ten_tdp", "tenXa": "ten_xa", "tenHuyen": "ten_huyen", "tenTinh": "ten_tinh"}


def catalogue(spark) -> DataFrame:
    """col, code, section, section_key of the layout's columns."""
    rows = [(code, title, key) for title, key, codes in SECTIONS for code in codes.split()]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows, 1)], "col int, code string, section string, section_key string")


def project_section(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(*[c for _, k, codes in SECTIONS if k == key for c in codes.split() if c in rows.columns])


def _shown(c: Column) -> Column:
    return v.let(c, lambda x: F.coalesce(nullify_placeholder(x), F.lit("")))


def normalise_parcel(p: Column) -> Column:
    """A parcel struct with its accepted values, blank or null for refused ones, and ``reasons``: missing_* and invalid_* in order."""
    raw = F.struct(*[_shown(p[c].cast("string")).alias(c) for c in ("so_thua", "to_ban_do", "dien_tich", "ma_muc_dich", "muc_dich_su_dung", "thoi_han", "nguon_goc", "dia_chi")])

    def judge(r: Column) -> Column:
        use = F.coalesce(F.nullif(r["ma_muc_dich"], F.lit("")), r["muc_dich_su_dung"])
        code = F.when(looks_like_table_noise(use), "").otherwise(parsers.map_purpose(use, r["muc_dich_su_dung"]))
        checks = F.struct(v.v_parcel(r["so_thua"]).alias("parcel"), v.v_map_sheet(r["to_ban_do"]).alias("sheet"), v.v_area(r["dien_tich"]).alias("area"), code.alias("code"), v.v_term(r["thoi_han"]).alias("term"), v.v_origin(r["nguon_goc"]).alias("origin"), use.alias("use"))
        why = lambda ok, text, name: F.when(~ok & (text != ""), f"invalid_{name}").when(~ok, f"missing_{name}")
        kept = lambda c: F.when(c["ok"], c["value"]).otherwise("")
        return v.let(checks, lambda c: F.struct(
            kept(c["parcel"]).alias("so_thua"), kept(c["sheet"]).alias("to_ban_do"), F.when(c["area"]["ok"], c["area"]["value"].cast("double")).alias("dien_tich"), c["code"].alias("ma_muc_dich"), kept(c["term"]).alias("thoi_han"), F.coalesce(c["origin"]["value"], F.lit("")).alias("nguon_goc"), r["dia_chi"].alias("dia_chi"),
            F.array_compact(F.array(why(c["parcel"]["ok"], r["so_thua"], "parcel_number"), why(c["sheet"]["ok"], r["to_ban_do"], "map_sheet"), why(c["area"]["ok"], r["dien_tich"], "area"), why(c["code"] != "", c["use"], "land_use_purpose"), why(c["term"]["ok"], r["thoi_han"], "land_use_term"), why(c["origin"]["ok"], r["nguon_goc"], "land_use_origin"))).alias("reasons"),
        ))

    return v.let(raw, judge)


def _by_parcel(documents: DataFrame) -> DataFrame:
    """A row for each parcel with a number, with ``_p``, its normalised values; documents without parcels stay one row, a joined parcel number is dealt out."""
    have = set(documents.columns)
    if "parcels" not in have:
        return documents.withColumns({"_pos": F.lit(0), "_p": F.lit(None).cast("struct<so_thua:string,to_ban_do:string,dien_tich:double,ma_muc_dich:string,thoi_han:string,nguon_goc:string,dia_chi:string,reasons:array<string>>")})
    real = F.filter("parcels", lambda x: nullify_placeholder(x["so_thua"]).isNotNull())
    rows = documents.withColumn("_real", real).select(*documents.columns, F.posexplode_outer("_real").alias("_at", "_raw"))
    return rows.withColumns({"_pos": F.coalesce("_at", F.lit(0)), "_p": F.when(F.col("_raw").isNotNull(), normalise_parcel(F.col("_raw")))}).drop("_at", "_raw")


def _people(rows: DataFrame, field) -> DataFrame:
    """The two owners of each row: names, gender, numbers, births and kind. The second comes from its own field, the first's name, or the first's address, and goes if it is the first, or if the latest change names one person alone."""
    name1, name2, home = field("ho_ten_chu_1"), field("ho_ten_chu_2"), field("dia_chi_thuong_tru")
    couple = split_couple(name1)
    beside = F.trim(F.regexp_extract(before_label(after_label(home, SPOUSE_MARKS, anywhere=True), ("sinh nam", "nam sinh", "cmnd", "cccd", "so", "sn")), r"^([\p{L} ]+)", 1))
    in_home = holds(home, SPOUSE_MARKS) & (F.size(F.split(beside, r"\s+")) >= 2) & ~contains_any(F.lower(beside), ("huyện", "tỉnh", "thôn", "xã", "diện tích"))
    own = nullify_placeholder(name2)
    out = rows.withColumns({"_n1": F.when(own.isNull() & couple["joint"], couple["first"]).otherwise(name1), "_n2": F.coalesce(own, F.when(couple["joint"], couple["second"]), F.when(in_home, beside), F.lit("")), "_in_home": own.isNull() & ~couple["joint"] & in_home})
    out = out.withColumns({"_p1": _shown(clean_person_name(F.col("_n1"))), "_p2": _shown(clean_person_name(F.col("_n2"))), "_g1": F.coalesce(detect_gender(F.col("_n1")), detect_gender(field("ho_ten_goc")), detect_gender(field("gioi_tinh")))})
    changed = nullify_placeholder(field("ten_chuyen_nhuong_moi")).isNotNull() & nullify_placeholder(field("ten_chuyen_nhuong_2")).isNull() & ~contains_any(F.lower(F.coalesce(field("thong_tin_bien_dong"), F.lit(""))), ("và vợ", "và chồng", "vợ là", "chồng là"))
    alone = (F.lower("_p2") == F.lower("_p1")) | changed
    out = out.withColumns({"_p2": F.when(alone, "").otherwise(F.col("_p2")), "_single": changed})

    def number(own: Column, *beside: Column) -> Column:
        return F.coalesce(F.when(v.v_identity(own)["ok"], digits_only(own)), F.get(parsers.identity_numbers(F.concat_ws(" ", own, *beside)), F.lit(0)), F.lit(""))

    def born(own: Column, *beside: Column) -> Column:
        return F.coalesce(F.when(v.v_birth_year(own)["ok"], v.v_birth_year(own)["value"]), F.get(parsers.birth_years(F.concat_ws(" ", *beside)), F.lit(0)), F.lit(""))

    second = F.col("_p2") != ""
    out = out.withColumns({
        "_id1": number(field("cccd_chu_1"), F.col("_n1"), field("ho_ten_goc")), "_y1": born(field("nam_sinh_chu_1"), F.col("_n1"), field("ho_ten_goc")),
        "_id2": F.when(second, number(field("cccd_chu_2"), F.col("_n2"), F.when(F.col("_in_home"), home))).otherwise(""), "_y2": F.when(second, born(field("nam_sinh_chu_2"), F.col("_n2"), F.when(F.col("_in_home"), home))).otherwise(""),
        "_kind": F.when(F.col("_single"), KIND_PERSON).when(second | F.lower("_n1").contains("vợ"), KIND_COUPLE).when(F.lower("_n1").contains("hộ"), KIND_HOUSEHOLD).otherwise(KIND_PERSON),
    })
    return out


def _homes(rows: DataFrame, field) -> DataFrame:
    """Addresses in parts: of the first owner (else the second's, the text's, or the parcel's), of the second (else the first's) and of the parcel."""
    text = F.split(F.coalesce(field("raw_text"), F.lit("")), "\n")
    in_text = F.get(F.filter(F.transform(F.filter(text, lambda x: holds(x, ("dia chi thuong tru", "dia chi"))), lambda x: clean_mapped_address(after_label(x, ("dia chi thuong tru", "dia chi"), anywhere=True))), lambda x: x != ""), F.lit(0))
    out = rows.withColumns({"_c1": clean_mapped_address(field("dia_chi_thuong_tru")), "_c2": clean_mapped_address(field("dia_chi_thuong_tru_chu_2")), "_ct": in_text if "raw_text" in rows.columns else F.lit(None).cast("string")})
    raw = F.coalesce(nullify_placeholder(F.col("_p.dia_chi")), nullify_placeholder(field("dia_chi_thua")))
    raw = F.when(is_contaminated_address(F.col("_p.dia_chi")), nullify_placeholder(field("dia_chi_thua"))).otherwise(raw)
    out = out.withColumn("_raw_td", raw)
    out = out.withColumn("_a1", decompose_address(F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("_c1", "_c2", "_ct")], clean_mapped_address(F.col("_raw_td"))), cleaned=True))
    office, headed = is_authority_text(F.col("_raw_td")) | contains_any(F.lower("_raw_td"), ("kính gửi", "kinh gui")), contains_any(F.lower("_raw_td"), ("diện tích", "dien tich", "thời hạn", "thoi han", "mục đích", "muc dich", "riêng", "chung"))
    own = clean_mapped_address(v.clean_address(F.col("_raw_td")))
    parcel = F.when(F.col("_raw_td").isNull(), F.col("_a1.dia_chi_chi_tiet")).when(office, "").when(headed & (own == ""), F.col("_a1.dia_chi_chi_tiet")).otherwise(own)
    out = out.withColumns({"_a2": F.when(F.col("_c2") != "", decompose_address(F.col("_c2"), cleaned=True)).otherwise(F.col("_a1")), "_td": with_upper_units(parcel, F.col("_a1.ten_huyen"), F.col("_a1.ten_tinh"))})
    return out.withColumn("_at", decompose_address(F.coalesce("_td", F.lit("")), cleaned=True))


def _first_date(lines: Column) -> Column:
    """The first date of issue in a text's lines, in one line or over three, lines of other dates aside."""
    windows = F.transform(lines, lambda x, i: F.struct(x.alias("own"), F.array_join(F.slice(lines, i + 1, F.lit(3)), " ").alias("three")))
    read = F.transform(F.filter(windows, lambda w: ~contains_any(F.lower(w["own"]), OTHER_DATES)), lambda w: v.let(F.struct(v.v_date(w["own"]).alias("a"), v.v_date(w["three"]).alias("b")), lambda d: F.when(d["a"]["ok"], d["a"]["value"]).when(d["b"]["ok"], d["b"]["value"])))
    return F.get(F.filter(read, lambda d: d.isNotNull()), F.lit(0))


def registration_rows(documents: DataFrame) -> DataFrame:
    """The layout's rows, all 129 columns: one for each document and parcel, and for each of these one for each heir.

    ``documents`` has doc_id and the merged fields as text columns
    (``certificate.flat_values``), and may have parcels, heirs, source_path,
    raw_text, card_ngay_cap and card_noi_cap, nha_o, rung_cay and ghi_chu.
    Values that their validators refuse are blank, never made up; a map scale
    that is not read is blank, with ``_scale_missing``. A file's name decides a
    serial, a parcel and a sheet as the reading's own fit does not.
    ``_missing_core`` lists the core columns without a value, ``_reasons`` why a
    parcel needs review. STT counts a document's rows from 1, or from its STT.
    """
    have = set(documents.columns)
    field = lambda n: F.col(n) if n in have else F.lit(None).cast("string")
    valid = lambda c, check: v.let(check(c), lambda r: F.when(r["ok"], r["value"]).otherwise(""))
    lines = F.split(F.coalesce(field("raw_text"), F.lit("")), "\n")
    rows = _homes(_people(_by_parcel(documents), field), field)
    path = _shown(field("source_path"))
    none = F.lit(None).cast("string")
    rows = rows.withColumns({"_reg": valid(field("so_vao_so"), v.v_registry), "_reg2": extract_registry_number(lines) if "raw_text" in have else none, "_day": valid(field("ngay_cap"), v.v_date), "_day2": _first_date(lines) if "raw_text" in have else none, "_own": F.when(F.col("_p").isNotNull(), F.col("_p.so_thua")).otherwise(valid(field("so_thua"), v.v_parcel))})
    known = lambda c: F.when(~F.col(c).isin("", *NO_REGISTRY), F.col(c))
    registry, issued = F.coalesce(known("_reg"), known("_reg2"), F.lit("")), F.coalesce(F.nullif(F.col("_day"), F.lit("")), F.col("_day2"), F.lit(""))
    folder = F.regexp_extract(fold_accents(path), r"(?<![a-z])to\s*(\d+)", 1)
    file_parcel = F.upper(F.regexp_extract(fold_accents(path), r"(?<![a-z])thua\s*(\d+[a-z]?(?:\+\d+[a-z]?)*)", 1))
    several = F.col("_p").isNotNull()
    own_parcel = F.col("_own")
    corner = own_parcel.isin(*CORNERS) | own_parcel.rlike(r"^\d\+\d$")
    parcel = F.when((file_parcel != "") & ((own_parcel == "") | corner | (own_parcel.contains("+") & ~file_parcel.contains("+"))), file_parcel).otherwise(own_parcel)
    raw_sheet = F.coalesce(F.when(several, F.nullif(F.col("_p.to_ban_do"), F.lit(""))), nullify_placeholder(field("to_ban_do")), F.lit(""))
    rows = rows.withColumn("_sheet", raw_sheet)
    raw_sheet = F.col("_sheet")
    odd = raw_sheet.contains("+") | (F.length(raw_sheet) > 4) | contains_any(F.lower(raw_sheet), SHEET_NOISE)
    sheet = F.when((folder != "") & odd, folder).otherwise(F.coalesce(F.nullif(valid(raw_sheet, v.v_map_sheet), F.lit("")), folder))
    area = F.coalesce(F.when(several, F.col("_p.dien_tich")), v.let(v.v_area(F.coalesce(nullify_placeholder(field("dien_tich_cap")), F.lit(""))), lambda r: F.when(r["ok"], r["value"].cast("double"))))
    optional = lambda n: v.let(v.v_area(field(n)), lambda r: F.when(r["ok"], r["value"].cast("double")))
    code = F.coalesce(F.when(several, F.nullif(F.col("_p.ma_muc_dich"), F.lit(""))), parsers.map_purpose(_shown(field("ma_muc_dich")), _shown(field("muc_dich_su_dung"))))
    term = F.coalesce(F.when(several, F.nullif(F.col("_p.thoi_han"), F.lit(""))), valid(field("thoi_han_su_dung"), v.v_term))
    origin = F.coalesce(F.when(several, F.nullif(F.col("_p.nguon_goc"), F.lit(""))), v.v_origin(field("nguon_goc_su_dung"))["value"], F.lit(""))
    paper = lambda c: F.when(F.length(c) == 12, "CCCD").when(F.length(c) == 9, "CMND").otherwise("")
    second = F.col("_p2") != ""
    if_second = lambda c: F.when(second, c).otherwise("")
    house, trees = _shown(field("nha_o")) != "", F.lower(_shown(field("rung_cay")))
    has_trees, has_forest = contains_any(trees, TREE_WORDS), contains_any(trees, FOREST_WORDS)
    shown_if = lambda test, c: F.when(test, c).otherwise("")
    stt = (F.col("STT") if "STT" in have else F.lit(1)) + F.col("_pos")
    values = {
        "STT": stt, "DDK_maDon": F.concat(F.lit("DON_"), stt.cast("string")), "DDK_coQuyenSuDung": F.lit("1"), "DDK_coQuyenSoHuu": shown_if(house, "1"),
        "GCN_soPhatHanh": F.substring(_shown(cross_validate_serial(field("so_phat_hanh"), path, field("ma_vach"))["value"]), 1, SERIAL_SIGNS),
        "GCN_soVaoSo": F.substring(registry, 1, REGISTRY_SIGNS), "GCN_ngayCap": issued, "GCN_tenNguoiKy": _shown(v.n_signer(field("nguoi_ky_qd"))), "GCN_maVach": valid(field("ma_vach"), v.v_barcode), "GCN_donViCap": _shown(v.n_authority(field("noi_cap"))),
        "GCN_daCongNhanPhapLy": F.lit("1"), "GCN_ghiChuTrang2": _shown(field("ghi_chu")),
        "CHU_loaiGiayChungNhan": F.col("_kind"), "CHU_loaiDoiTuongSuDungDat": F.lit(SUBJECT), "CHU_hoTen": F.col("_p1"), "CHU_ngaySinh": F.col("_y1"), "CHU_gioiTinh": F.coalesce(F.col("_g1").cast("string"), F.lit("")), "CHU_quocTich": F.lit(NATIONALITY),
        **{f"CHU_{c}": F.col(f"_a1.{part}") for c, part in ADDRESS.items()},
        "GT_loaiGiayTo": paper(F.col("_id1")), "GT_soGiayTo": F.col("_id1"), "GT_ngayCap": _shown(field("card_ngay_cap")), "GT_noiCap": _shown(field("card_noi_cap")),
        "VC_hoTen": F.col("_p2"), "VC_ngaySinh": F.col("_y2"), "VC_gioiTinh": if_second(F.when(F.col("_g1") == 0, "1").otherwise("0")), "VC_quocTich": if_second(F.lit(NATIONALITY)),
        **{f"VC_{c}": if_second(F.col(f"_a2.{part}")) for c, part in ADDRESS.items()},
        "GT_VC_loaiGiayTo": paper(F.col("_id2")), "GT_VC_soGiayTo": F.col("_id2"),
        "TL_tyLeDoDac": valid(field("ty_le_ban_do"), v.v_scale),
        "TD_soThuTuThua": parcel, "TD_soHieuToBanDo": sheet, "TD_dienTich": area, "TD_dienTichPhapLy": optional("dien_tich_phap_ly"), "TD_dienTichMDSD": optional("dien_tich_mdsd"), "TD_dienTichNguonGoc": optional("dien_tich_nguon_goc"),
        **{f"TD_{c}": F.col(f"_at.{ADDRESS[c]}") for c in ("diaChiChiTiet", "soNha", "tenDuongPho", "tenTDP")},
        "TD_maMucDichSuDung": F.substring(code, 1, CODE_SIGNS), "TD_thoiHanSuDung": term, "TD_nguonGoc": origin,
        "NHA_loaiNhaRiengLe": shown_if(house, "0"), "NHA_loaiQuyenSoHuuNhaRiengLe": shown_if(house, "0"), "NHA_tenNha": shown_if(house, HOUSE_NAME),
        **{f"NHA_{c}": shown_if(house, F.col(f"_at.{ADDRESS[c]}")) for c in ("diaChiChiTiet", "soNha", "tenDuongPho", "tenTDP")},
        "CLN_tenCayLauNam": shown_if(has_trees, field("rung_cay")), "CLN_loaiCayTrong": shown_if(has_trees, TREES), "RT_tenRung": shown_if(has_forest, field("rung_cay")), "RT_loaiCayRung": shown_if(has_forest, FOREST),
        "HS_duongDanHSQ": path,
    }
    heirs = [F.col("heirs").alias("_heirs")] if "heirs" in have else []
    out = rows.select("doc_id", *[values.get(c, F.lit("")).alias(c) for c in COLUMNS], F.coalesce("_p.reasons", F.array().cast("array<string>")).alias("_reasons"), *heirs)
    if heirs:
        out = _by_heir(out)
    missing = missing_core(CORE)
    return out.withColumns({"_missing_core": missing, "_core_incomplete": (F.size(missing) > 0).cast("int"), "_scale_missing": F.col("TL_tyLeDoDac") == ""})


def _by_heir(rows: DataFrame) -> DataFrame:
    """A row for each named heir of a row: the heir is the subject, the representative its companion, unless they are the same person; rows without heirs stay. A document's rows are numbered anew from its first."""
    named = F.filter(F.transform("_heirs", lambda h: F.struct(_shown(clean_person_name(h["ho_ten"])).alias("name"), digits_only(_shown(h["cmnd"])).alias("id"), _shown(h["ngay_sinh"]).alias("born"), F.coalesce(detect_gender(h["ho_ten"]), detect_gender(h["gioi_tinh"])).alias("gender"))), lambda h: h["name"] != "")
    out = rows.withColumn("_named", named).select(*rows.columns, F.posexplode_outer("_named").alias("_hp", "_h")).drop("_heirs")
    heir = F.col("_h").isNotNull()
    own = heir & (F.lower("_h.name") == F.lower("CHU_hoTen"))
    number = F.when(F.length("_h.id").isin(9, 12), F.col("_h.id")).otherwise("")
    year = v.let(v.v_birth_year(F.col("_h.born")), lambda r: F.when(r["ok"], r["value"]).otherwise(""))
    before = F.row_number().over(Window.partitionBy("doc_id").orderBy("STT", F.coalesce("_hp", F.lit(0)))) - 1
    stt = F.min("STT").over(Window.partitionBy("doc_id")) + before
    change = {"CHU_loaiGiayChungNhan": F.lit(KIND_HEIR), "CHU_hoTen": F.col("_h.name"), "CHU_ngaySinh": year, "CHU_gioiTinh": F.coalesce(F.col("_h.gender").cast("string"), F.lit("")), "GT_loaiGiayTo": F.when(F.length(number) == 12, "CCCD").when(number != "", "CMND").otherwise(""), "GT_soGiayTo": number, "GT_ngayCap": F.lit(""), "GT_noiCap": F.lit(""), "DDK_capGiayNguoiDaiDien": F.when(own, "1").otherwise("0")}
    pairs = {"VC_hoTen": "CHU_hoTen", "VC_ngaySinh": "CHU_ngaySinh", "VC_gioiTinh": "CHU_gioiTinh", "VC_quocTich": "CHU_quocTich", **{f"VC_{c}": f"CHU_{c}" for c in ADDRESS}, "GT_VC_loaiGiayTo": "GT_loaiGiayTo", "GT_VC_soGiayTo": "GT_soGiayTo", "GT_VC_ngayCap": "GT_ngayCap", "GT_VC_noiCap": "GT_noiCap"}
    change |= {a: F.when(own, "").otherwise(F.col(b)) for a, b in pairs.items()}
    numbered = {"STT": stt, "DDK_maDon": F.concat(F.lit("DON_"), stt.cast("string"))}
    return out.select("doc_id", *[(numbered[c] if c in numbered else F.when(heir, change[c]).otherwise(F.col(c)) if c in change else F.col(c)).alias(c) for c in COLUMNS], "_reasons")


def with_alerts(rows: DataFrame) -> DataFrame:
    """``alert_level`` as the sheet colours it: soft without a registry number, hard if it has not five digits, soft without any other core value, else none."""
    digits = F.length(digits_only(F.regexp_extract("GCN_soVaoSo", r"^([^/]*)", 1)))
    registry = F.when(F.col("GCN_soVaoSo") == "", "soft").when(digits != 5, "hard")
    return rows.withColumn("alert_level", F.coalesce(registry, F.when(F.size(missing_core(ALERT_CORE)) > 0, "soft"), F.lit("none")))


def plan_rows(documents: DataFrame) -> DataFrame:
    """The flat rows of the cleaning plan's sheet, an identity card's values before the certificate's.

    ``documents`` has stt, the fields as text, and card_* of the card. A land
    type and an origin that cannot be told get the sheet's usual wording, with a
    flag that says so.
    """
    from parcelforge.functions.text import fold_accents

    have = set(documents.columns)
    field = lambda *names: F.coalesce(*[nullify_placeholder(F.col(n)) for n in names if n in have], F.lit(""))
    land, origin = fold_accents(field("muc_dich_su_dung")), v.v_origin(field("nguon_goc_su_dung"))["value"]
    kind = F.when(land.rlike("nong thon|ont"), "Đất ở tại nông thôn").when(land.rlike("do thi|odt"), "Đất ở tại đô thị").when(land.rlike(r"dat o\b"), "Đất ở")
    couple = field("ho_ten_chu_2") != ""
    return documents.select(
        "stt",
        field("so_phat_hanh").alias("so_phat_hanh"),
        field("ngay_cap").alias("ngay_cap"),
        field("so_vao_so").alias("so_vao_so"),
        field("card_ho_ten", "ho_ten_chu_1").alias("ho_ten"),
        field("card_ngay_sinh", "nam_sinh_chu_1").alias("ngay_sinh"),
        field("card_gioi_tinh").alias("gioi_tinh"),
        field("card_so_cccd", "cccd_chu_1").alias("so_cccd"),
        field("card_noi_thuong_tru", "dia_chi_thuong_tru").alias("dia_chi_thuong_tru"),
        F.when(couple, "Vợ chồng").otherwise("Cá nhân").alias("phap_nhan"),
        F.when(couple, "Đồng sở hữu").otherwise("Cá nhân").alias("vai_tro"),
        field("ten_chuyen_nhuong").alias("ten_nguoi_moi"),
        F.when(field("ten_chuyen_nhuong") != "", "Chuyển nhượng").otherwise("").alias("ly_do_thay_doi"),
        field("to_ban_do").alias("so_to"),
        field("so_thua").alias("so_thua"),
        field("dia_chi_thua").alias("dia_chi_thua"),
        F.regexp_replace(F.regexp_replace(field("dien_tich_cap"), ",", "."), r"\.0+$", "").alias("dien_tich"),
        F.coalesce(kind, F.lit("Đất ở")).alias("loai_dat"),
        kind.isNull().alias("loai_dat_defaulted"),
        F.coalesce(origin, F.lit("")).alias("nguon_goc"),
        origin.isNull().alias("nguon_goc_missing"),
    )


def propagate_parcel_defaults(parcels: Column, address: Column, purpose: Column, code: Column, term: Column, origin: Column) -> Column:
    """Parcels (so_thua, dia_chi, muc_dich_su_dung, ma_muc_dich, thoi_han, nguon_goc) with the document's values where theirs are blank; the origin only of a single parcel."""
    fill = lambda own, other: F.coalesce(nullify_placeholder(own), other)
    alone = F.size(parcels) == 1
    return F.transform(
        parcels,
        lambda p: F.struct(
            p["so_thua"].alias("so_thua"),
            fill(p["dia_chi"], address).alias("dia_chi"),
            fill(p["muc_dich_su_dung"], purpose).alias("muc_dich_su_dung"),
            fill(p["ma_muc_dich"], code).alias("ma_muc_dich"),
            fill(p["thoi_han"], term).alias("thoi_han"),
            F.when(alone, fill(p["nguon_goc"], origin)).otherwise(nullify_placeholder(p["nguon_goc"])).alias("nguon_goc"),
        ),
    )

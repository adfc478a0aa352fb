from pyspark.sql import functions as F

from parcelforge.functions import lines as ln
from parcelforge.operators import readings
from parcelforge.sources import database


def at(spark, c):
    return spark.range(1).select(c.alias("r")).first().r


def lines(*texts):
    return F.array(*[F.lit(t) for t in texts])


def test_addresses(spark):
    assert at(spark, ln.expand_abbreviations(F.lit("số 5, P. Tam Thanh, TP Lạng Sơn ,T. Lạng Sơn"))) == "số 5, phường Tam Thanh, thành phố Lạng Sơn, tỉnh Lạng Sơn"
    assert at(spark, ln.truncate_after_province(F.lit("xã Hoa Thám, huyện Bình Gia, tỉnh Lạng Sơn, BP 425774"))) == "xã Hoa Thám, huyện Bình Gia, tỉnh Lạng Sơn"
    assert at(spark, ln.truncate_after_province(F.lit("xã Hoa Thám, huyện Bình Gia theo hồ sơ số 1"))) == "xã Hoa Thám, huyện Bình Gia"


def test_owner_and_heirs(spark):
    o = at(spark, ln.parse_owner(lines("I. Người sử dụng đất", "Ông Nguyễn Văn An, sinh năm 1950, CMND 168234567", "Bà Trần Thị Bình, sinh năm 1955, CMND 168234568", "Địa chỉ thường trú: xã Hoa Thám, huyện Bình Gia")))
    assert (o.ho_ten_chu_1, o.cmnd_chu_1, o.ngay_sinh_chu_1) == ("Nguyễn Văn An", "168234567", "1950")
    assert (o.ho_ten_chu_2, o.cmnd_chu_2, o.ngay_sinh_chu_2, o.loai_chu) == ("Trần Thị Bình", "168234568", "1955", "vo_chong")
    assert o.dia_chi_thuong_tru == "xã Hoa Thám, huyện Bình Gia" and o.dong_thua_ke == []
    couple = at(spark, ln.parse_owner(lines("Ông Nguyễn Văn An và vợ là bà Trần Thị Bình")))
    assert (couple.ho_ten_chu_1, couple.ho_ten_chu_2, couple.loai_chu) == ("Nguyễn Văn An", "Trần Thị Bình", "vo_chong")
    assert at(spark, ln.parse_owner(lines("CÔNG TY TNHH Một Thành Viên"))).loai_chu == "to_chuc"
    heirs = at(spark, ln.extract_heirs(lines("Ông A là người đại diện của những người thừa kế", "1. Ông Nguyễn Văn Ba, sinh năm 1970", "2. Bà Lê Thị Cúc, CMND 123456789", "Bà Lê Thị Cúc", "khác")))
    assert [(h.ho_ten, h.cmnd, h.ngay_sinh, h.gioi_tinh) for h in heirs] == [("Nguyễn Văn Ba", None, "1970", "nam"), ("Lê Thị Cúc", "123456789", None, "nữ")]
    assert at(spark, ln.extract_heirs(lines("x"))) == []


def test_transfer(spark):
    t = at(spark, ln.parse_transfer(lines("Thế chấp", "Chuyển nhượng cho ông Trần Văn Bình, CCCD 001092001234 và bà Lê Thị Cúc, CCCD 001192001235; địa chỉ: xã Hoa Thám; hồ sơ 123456.CN.001 ngày 05/02/2022")))
    assert (t.ben_nhan_1, t.ben_nhan_2, t.cmnd_1, t.cmnd_2) == ("Trần Văn Bình", "Lê Thị Cúc", "001092001234", "001192001235")
    assert (t.so_ho_so, t.ngay, t.dia_chi) == ("123456.CN.001", "05/02/2022", "xã Hoa Thám")
    assert at(spark, ln.parse_transfer(lines("Thế chấp"))) is None


def test_certification(spark):
    c = at(spark, ln.parse_certification(lines("Hộ chiếu số CV 260085", "CV 260084", "Bình Gia, ngày 15 tháng 10 năm 2018", "TM. ỦY BAN NHÂN DÂN", "HUYỆN BÌNH GIA", "KT. CHỦ TỊCH", "PHÓ CHỦ TỊCH", "Nguyễn Văn An", "Số vào sổ cấp GCN: CH 00123", "1234567890123")))
    assert (c.so_phat_hanh, c.so_vao_so, c.ma_vach, c.ngay_cap) == ("CV 260084", "CH00123", "1234567890123", "15/10/2018")
    assert (c.noi_cap, c.nguoi_ky_qd, c.chuc_vu_nguoi_ky) == ("Ủy ban nhân dân huyện Binh Gia", "Nguyễn Văn An", "Chủ Tịch")
    none = at(spark, ln.parse_certification(lines("Ủy ban nhân dân", "x")))
    assert none.noi_cap is None and none.nguoi_ky_qd is None and none.so_vao_so is None
    assert at(spark, readings.should_retry_rotated(F.lit("abc"), F.lit(0.9), F.lit(""), F.lit(0.0), F.lit(0.0)))


def test_settings_and_aliases(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"a": 1, "b": {"c": [2]}}')
    assert {r.key: r.value for r in database.read_settings(spark, str(tmp_path / "s.json")).collect()} == {"a": "1", "b": '{"c":[2]}'}
    (tmp_path / "t.csv").write_text("6,X,,\n7,BP 42,5,12\n8,,7,\n")
    got = database.read_ground_truth(spark, str(tmp_path / "t.csv"), "excel_row int, serial string, sheet string, parcel string").collect()
    assert [(r.serial_key, r.place_key) for r in got] == [("BP42", "5_12"), ("", "")]
    names = spark.createDataFrame([("Ng Văn A",), ("xx Trần yy",), ("khác",)], "name string")
    exact = spark.createDataFrame([("ng văn a", "Nguyễn Văn A")], "alias string, canonical string")
    rules = spark.createDataFrame([(2, "Trần", "late"), (1, "Tr.n", "Trần Văn B")], "priority int, pattern string, canonical string")
    assert {r.name: r.canonical for r in database.alias_lookup(names, exact, rules).collect()} == {"Ng Văn A": "Nguyễn Văn A", "xx Trần yy": "Trần Văn B", "khác": None}

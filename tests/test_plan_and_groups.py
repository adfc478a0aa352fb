from pyspark.sql import functions as F

from parcelforge.operators import pages, registration


def test_plan_rows(spark):
    docs = spark.createDataFrame([(1, "BP 425774", "An", "Nguyễn An", "Bình", "đất ở tại nông thôn", "nhận chuyển nhượng", "120,0"), (2, "", "Cy", "", "", "?", "?", "12,5")], "stt int, so_phat_hanh string, ho_ten_chu_1 string, card_ho_ten string, ho_ten_chu_2 string, muc_dich_su_dung string, nguon_goc_su_dung string, dien_tich_cap string")
    a, b = sorted(registration.plan_rows(docs).collect(), key=lambda r: r.stt)
    assert (a.ho_ten, a.phap_nhan, a.loai_dat, a.loai_dat_defaulted, a.nguon_goc, a.dien_tich) == ("Nguyễn An", "Vợ chồng", "Đất ở tại nông thôn", False, "Nhận chuyển nhượng quyền sử dụng đất", "120")
    assert (b.ho_ten, b.phap_nhan, b.loai_dat_defaulted, b.nguon_goc, b.nguon_goc_missing, b.dien_tich) == ("Cy", "Cá nhân", True, "", True, "12.5")


def test_parcel_defaults(spark):
    schema = "p array<struct<so_thua:string,dia_chi:string,muc_dich_su_dung:string,ma_muc_dich:string,thoi_han:string,nguon_goc:string>>"
    fill = lambda rows: spark.createDataFrame([(rows,)], schema).select(registration.propagate_parcel_defaults(F.col("p"), *[F.lit(x) for x in ("a", "b", "c", "d", "e")]).alias("p")).first().p
    one = fill([("1", "", None, "X", "-", "")])[0]
    assert tuple(one) == ("1", "a", "b", "X", "d", "e")
    assert [x.nguon_goc for x in fill([("1", "", "", "", "", ""), ("2", "", "", "", "", "own")])] == [None, "own"]


def test_groups_and_crops(spark):
    rows = spark.createDataFrame([("g", 0, "s"), ("g", 1, None), ("h", 0, "a"), ("h", 1, "b")], "group_id string, page_index int, serial string")
    assert {r.group_id: r.ok for r in pages.validate_groups(rows).collect()} == {"g": True, "h": False}
    values = spark.createDataFrame([("d", 15, 0), ("d", 7, 1), ("d", 7, 2), ("d", 15, 3), ("d", 9, 4)], "doc string, v int, ord int")
    assert tuple(pages.most_common(values, ["doc"], "v", "ord").first()) == ("d", 15, 2)
    tokens = spark.createDataFrame([("d", 0, 0, "Số vào sổ: CH 1", 0.8, 100.0, 100.0, 200.0, 120.0), ("d", 0, 1, "số vào sổ", 0.9, 300.0, 100.0, 400.0, 120.0)], "doc_id string, page_index int, ord int, text string, confidence double, x1 double, y1 double, x2 double, y2 double")
    got = pages.crop_manifest(tokens, spark.createDataFrame([("so_vao_so", "vao so")], "field string, pattern string"), F.lit(1000.0), F.lit(1000.0)).first()
    assert (got.field, got.ord, got.x1, got.y2) == ("so_vao_so", 1, 280.0, 145.0)

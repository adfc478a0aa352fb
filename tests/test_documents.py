import datetime as dt

import pytest
from pyspark.sql import functions as F

from parcelforge.operators import evaluate, expand, merge, readings, registration, rendering, review, store
from parcelforge.sources import dossiers, sinks
from parcelforge.streaming import files


def at(spark, c):
    return spark.range(1).select(c.alias("r")).first().r


def test_scope_truth_table(spark):
    rows = [(1, "p1", "me"), (2, "p1", "you"), (3, "p2", "me"), (4, "p2", "you"), (5, "p3", "me")]
    records = spark.createDataFrame(rows, "id int, project_id string, created_by string")
    seen = lambda s: {r.id for r in records.where(store.scope_filter(s, F.col("project_id"), F.col("created_by"))).collect()}
    assert seen(None) == seen(store.Scope(admin=True)) == {1, 2, 3, 4, 5}
    assert seen(store.Scope("me", managed=["p1"])) == {1, 2}
    assert seen(store.Scope("me", managed=["p1"], member=["p2"])) == {1, 2, 3}
    assert seen(store.Scope("me")) == set()
    members = spark.createDataFrame([("p1", "me", "truong_phong"), ("p2", "me", "thanh_vien")], "project_id string, user_id string, role_in_project string")
    assert {r.id for r in store.record_filter(records, members, "me").collect()} == {1, 2, 3}
    assert {r.id for r in store.record_filter(records, members, "me", office_head=True).collect()} == {1, 2, 3, 4}


def test_delete_project_keeps_other_audits(spark):
    tables = {
        "ocr_batches": spark.createDataFrame([("b1", "p1"), ("b2", "p2"), ("b3", None)], "batch_id string, project_id string"),
        "ocr_records": spark.createDataFrame([("r1", "p1"), ("r2", "p2")], "id string, project_id string"),
        "cccd_crop_audits": spark.createDataFrame([("b1", 1), ("b2", 2)], "batch_id string, n int"),
        "ocr_field_reviews": spark.createDataFrame([("r1", 1), ("r2", 2)], "document_id string, n int"),
    }
    out = {k: sorted(str(tuple(r)) for r in t.collect()) for k, t in store.delete_project(tables, "p1").items()}
    assert out == {"ocr_batches": ["('b2', 'p2')", "('b3', None)"], "ocr_records": ["('r2', 'p2')"], "cccd_crop_audits": ["('b2', 2)"], "ocr_field_reviews": ["('r2', 2)"]}


def test_upsert_and_page(spark):
    now = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, keep string")
    changes = spark.createDataFrame([(1, "new", None, 1), (1, None, None, 2), (3, "c", "z", 1)], "k int, v string, keep string, t int")
    assert sorted(tuple(r) for r in store.upsert(now, changes, ["k"], ["t"], ["keep"]).collect()) == [(1, None, "x"), (2, "b", "y"), (3, "c", "z")]
    with pytest.raises(ValueError):
        store.page(now, [F.col("k")], 0)


def test_parcels_expand_and_collapse(spark):
    docs = spark.createDataFrame([("d", "101+102", "15", "ONT+CLN", "a+b+c"), ("e", "7", "3", "LUC", "")], "doc string, so_thua string, to_ban_do string, ma_muc_dich string, thoi_han string")
    rows = expand.expand_parcels(docs)
    assert sorted(tuple(r) for r in rows.collect()) == [("d", 1, "101", "15", "ONT", ""), ("d", 2, "102", "15", "CLN", ""), ("e", 1, "7", "3", "LUC", "")]
    one = {r.doc: r for r in expand.collapse_parcels(rows, ["doc"], ["so_thua", "to_ban_do"], "parcel_no").collect()}
    assert (one["d"].so_thua, one["d"].to_ban_do, one["d"].n_parcels) == ("101; 102", "15; 15", 2)


def test_heirs_numbers_and_carry(spark):
    rows = spark.createDataFrame([(1, "An", None, [("An",), ("Ba",)]), (2, "Cy", "Dy", [])], "stt int, CHU_hoTen string, VC_hoTen string, dong_thua_ke array<struct<ho_ten:string>>")
    got = sorted((r.stt, r.heir_no, r.CHU_hoTen, r.VC_hoTen) for r in expand.expand_heirs(rows).collect())
    assert got == [(1, 1, "An", None), (1, 2, "Ba", "An"), (2, 1, "Cy", "Dy")]
    numbers = expand.running_number(spark.range(1000).withColumn("k", F.xxhash64("id")), ["k"]).collect()
    assert [r.stt for r in sorted(numbers, key=lambda r: r.k)] == list(range(1, 1001))
    sheets = spark.createDataFrame([(1, ""), (2, "5"), (3, None), (4, "6"), (5, "")], "n int, s string").withColumn("g", F.lit(1))
    assert [r.s for r in sorted(expand.carry_forward(sheets, ["g"], ["n"], "s").collect(), key=lambda r: r.n)] == ["5", "5", "5", "6", "6"]
    reasons = expand.parcel_reasons(F.lit("6 thửa"), F.lit(""), F.lit("12,5"), F.lit("ODT"))
    assert at(spark, reasons) == ["invalid_so_thua", "missing_to_ban_do"]


LADDER = [
    (False, "12,5", 0.9, "12.6", 0.8, "p", "numeric_highest_confidence"),
    (False, "abc", 0.9, "1,2", 0.1, "v", "numeric_highest_confidence"),
    (False, "abc", 0.9, "12", 0.1, "p", "vietocr_low_confidence"),
    (True, "x", 0.9, "1234567890123", 0.7, "v", "barcode_vietocr"),
    (True, "x", 0.9, "123", 0.7, "p", "barcode_paddle"),
    (False, "CMND: 168234567", 0.8, "abc", 0.9, "p", "identity_paddle_only"),
    (False, "", 0.0, "abc", 0.9, "v", "vietocr_only"),
    (False, "abc", 0.9, "abd", 0.4, "p", "vietocr_low_confidence"),
    (False, "nguyen van an", 0.9, "Nguyễn Văn An", 0.6, "v", "vietocr_text_agrees_with_paddle"),
    (False, "abcd1", 0.9, "wxyz", 0.8, "v", "vietocr_strong_text"),
    (False, "abcd1", 0.9, "wxyz", 0.6, "p", "paddle_stronger_disagreement"),
    (False, "abcd1", 0.65, "wxyz", 0.55, "p", "paddle_fallback"),
]


def test_reading_ladder(spark):
    rows = [(i, *r) for i, r in enumerate(LADDER)]
    t = spark.createDataFrame(rows, "i int, is_barcode_box boolean, p_text string, p_conf double, v_text string, v_conf double, side string, reason string")
    for r in readings.select_readings(t).collect():
        assert (r.selected.side, r.selected.reason) == (r.side, r.reason), r


def test_numbers_and_turned_readings(spark):
    """Whole numbers are no decimals; the surer of two readings of the recogniser counts; texts without letters and digits are not alike."""
    rows = [
        ("123", 0.90, "125 m", 0.95, None, None, "v", "vietocr", "vietocr_strong_text"),
        ("12,5", 0.90, "12.5 m", 0.95, None, None, "p", "paddle", "numeric_highest_confidence"),
        ("abc", 0.90, "x", 0.55, "abc", 0.80, "v", "vietocr_180", "vietocr_text_agrees_with_paddle"),
        ("abc", 0.90, "", 0.99, "abd", 0.60, "p", "paddle", "paddle_stronger_disagreement"),
        ("...", 0.90, "---", 0.60, None, None, "p", "paddle", "paddle_stronger_disagreement"),
        ("012345678", 0.80, "cmnd x", 0.95, None, None, "p", "paddle", "identity_paddle_only"),
        (None, None, None, None, None, None, "v", "", "vietocr_only"),
    ]
    t = spark.createDataFrame([(i, False, *r) for i, r in enumerate(rows)], "i int, is_barcode_box boolean, p_text string, p_conf double, v_text string, v_conf double, v180_text string, v180_conf double, side string, engine string, reason string")
    for r in readings.select_readings(t).collect():
        if r.i == 3:  # "abd" is two thirds alike
            assert r.selected.engine in ("paddle", "vietocr_180")
            continue
        assert (r.selected.side, r.selected.engine, r.selected.reason) == (r.side, r.engine, r.reason), r


@pytest.mark.parametrize(
    ("reading", "name", "code", "want"),
    [("BP 425774", "BP425774.pdf", None, ("BP 425774", 1.0)), ("BP 425775", "BP425774.pdf", "99425774", ("BP 425774", 0.95)), ("BP 42577599", "BP425774.pdf", "", ("BP 425774", 0.9)), ("BP 425775", "BP425774.pdf", "", ("BP 425774", 0.85)), (None, "BP425774.pdf", None, ("BP 425774", 0.85)), ("BP 425775", "scan.pdf", None, ("BP 425775", 0.8)), (None, "scan", None, (None, 0.0))],
)
def test_serial_cross_check(spark, reading, name, code, want):
    s = lambda x: F.lit(x).cast("string")
    r = at(spark, merge.cross_validate_serial(s(reading), s(name), s(code)))
    assert (r.value, r.confidence) == want


def test_owner_rules(spark):
    r = at(spark, merge.split_couple(F.lit("Nguyễn Văn An và vợ là bà Trần Thị Bình")))
    assert (r.first, r.second, r.joint) == ("Nguyễn Văn An", "Trần Thị Bình", True)
    assert at(spark, merge.birth_from_identity(F.lit("001 092 001 234"))) == "1992"
    kind = lambda name, n=0, lines=(): at(spark, merge.owner_type(F.lit(name), F.lit(n), F.array(*[F.lit(x) for x in ("", *lines)])))
    assert kind("Hộ ông Nguyễn Văn An") == kind("Nguyễn Văn An", 0, ["Chủ hộ gia đình"]) == "ho_gia_dinh"
    assert kind("Ban quản lý dự án") == "to_chuc" and kind("Chùa Bà Đá") == "cong_dong" and kind("Ông A và bà B") == "vo_chong"
    assert kind("Nguyễn Văn An", 2) == "dong_thua_ke" and kind("Nguyễn Văn An", 0, ["x"] * 15 + ["công ty"]) == "ca_nhan"
    kinds = ["Xóa đăng ký thế chấp", "Thế chấp tại ngân hàng", "Chuyển nhượng cho ông A", "Đính chính", "x"]
    assert [at(spark, merge.endorsement_type(F.lit(k))) for k in kinds] == ["release", "mortgage", "transfer", "correction", "other"]
    changes = F.array(*[F.lit(x) for x in ("Đính chính tờ bản đồ số thành 17", "Chuyển nhượng cho ông Trần Văn Bình, CCCD 001092001234", "Chuyển nhượng cho Ngân hàng Nông nghiệp")])
    c = at(spark, merge.fallback_changes(changes))
    assert (c.sheet, c.owner, c.identity) == ("17", "Trần Văn Bình", "001092001234")
    h = at(spark, merge.path_hint_check(F.lit(""), F.lit("12")))
    assert (h.value, h.status) == ("12", "filled_from_path")


def test_evaluation(spark):
    e = lambda a, b: at(spark, evaluate.set_equal(F.lit(a), F.lit(b)))
    assert e("66+68", "68+66") and not e("66", "66468") and not e("1265", "265")
    assert at(spark, evaluate.same_person(F.lit("Ông Nguyễn Văn An"), F.lit("NGUYỄN VĂN AN")))
    assert not at(spark, evaluate.same_person(F.lit("Nguyễn Văn An"), F.lit("Trần Văn An")))
    assert at(spark, evaluate.field_match("area", F.lit("100,04"), F.lit("100"))) and at(spark, evaluate.field_match("sheet", F.lit("07"), F.lit("7")))
    rows = spark.createDataFrame([(1, "S1", "5_9"), (2, "", "5_9"), (3, "", "")], "id int, serial string, place string")
    truth = spark.createDataFrame([("t1", "S1", ""), ("t2", "", "5_9")], "tid string, serial string, place string")
    got = evaluate.lookup_with_fallback(rows, truth, [(F.col("serial"), F.col("serial")), (F.col("place"), F.col("place"))], "id", "tid")
    assert {(r.id, r.tid, r.by_key) for r in got.collect()} == {(1, "t1", 0), (2, "t2", 1)}


def test_review(spark):
    tokens = spark.createDataFrame([("d", 0, 0, "Số CH 00123", 0.9), ("d", 1, 1, "CH00123", 0.8)], "doc_id string, page_index int, ord int, text string, confidence double")
    fields = spark.createDataFrame([("d", "so_vao_so", "CH00123", 0, False), ("d", "so_thua", "", None, False), ("d", "ma_vach", "999", None, False), ("d", "x", "00123", 1, True)], "doc_id string, field_key string, value string, raw_page int, flagged boolean")
    reviews = spark.createDataFrame([("d", "x", "ok", "1", 1, 1), ("d", "x", "bad", "2", 2, 2)], "doc_id string, field_key string, review_status string, corrected_value string, created_at int, id int")
    got = {r.field_key: r for r in review.project(fields, tokens, reviews).collect()}
    assert {k: r.status for k, r in got.items()} == {"so_vao_so": "ready", "so_thua": "missing", "ma_vach": "needs_review", "x": "needs_review"}
    assert got["so_vao_so"].ord == 1 and got["x"].decision.review_status == "bad"
    assert tuple(review.summary(review.project(fields, tokens)).first()) == ("d", 4, 3)


def test_registration_layout(spark, tmp_path):
    assert len(registration.COLUMNS) == len(set(registration.COLUMNS)) == 129
    assert registration.catalogue(spark).where("section_key = 'thua_dat'").count() == 22
    docs = spark.createDataFrame(
        [("d", 1, "BP.425774", "CH 123", "15/10/2018", "Nguyễn Văn An", "UBND huyện Bình Gia", "Ông Trần Văn Bình", "001092001234", "12", "05", "120,5", "1/2001"), ("e", 2, *[""] * 11)],
        "doc_id string, STT int, so_phat_hanh string, so_vao_so string, ngay_cap string, nguoi_ky_qd string, noi_cap string, ho_ten_chu_1 string, cccd_chu_1 string, so_thua string, to_ban_do string, dien_tich_cap string, ty_le_ban_do string",
    )
    rows = registration.registration_rows(docs)
    got = {r.doc_id: r for r in registration.with_alerts(rows).collect()}
    d = got["d"]
    assert (d.GCN_soPhatHanh, d.GCN_soVaoSo, d.TD_soHieuToBanDo, d.TD_dienTich, d.DDK_maDon, d.alert_level, d._missing_core) == ("BP 425774", "CH00123", "5", 120.5, "DON_1", "none", ["TD_maMucDichSuDung", "TD_diaChiChiTiet"])
    assert d._scale_missing and d.TL_tyLeDoDac == "" and got["e"].alert_level == "soft" and len(got["e"]._missing_core) == 10
    sinks.write_registration(rows, str(tmp_path / "csv"), "csv")
    back = spark.read.option("header", "true").csv(str(tmp_path / "csv"))
    assert back.columns[:-1] == list(registration.COLUMNS) and back.count() == 2


def test_markdown_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([("d", "BP 425774", None, [("1", "5", "10", "LUC"), ("2", "5", "20", "ONT")])], "doc_id string, so_phat_hanh string, so_vao_so string, parcels array<struct<so_thua:string,to_ban_do:string,dien_tich:string,ma_muc_dich:string>>")
    text = rendering.fields_markdown(F.col("doc_id"), [("so_phat_hanh", F.col("so_phat_hanh")), ("so_vao_so", F.col("so_vao_so"))], F.col("parcels"))
    md = docs.select("doc_id", text.alias("markdown"))
    r = rendering.parse_markdown(md).first()
    assert r.heading == "d" and r.fields == {"so_phat_hanh": "BP 425774"} and [p.so_thua for p in r.parcels] == ["1", "2"]
    named = sinks.markdown_names(md.withColumns({"n": F.lit(7), "name": F.lit("a/b: c"), "key": F.lit("0123456789")}), "n", "name", "key")
    assert named.first().file_name == "007_ab c_01234567.md"
    sinks.write_markdown(named, str(tmp_path / "md"))
    sinks.write_flat(docs.drop("parcels"), str(tmp_path / "flat"))
    sinks.write_results(docs.select("doc_id", "so_phat_hanh"), str(tmp_path / "results"))
    assert sinks.read_results(spark, str(tmp_path / "results"), "doc_id string, so_phat_hanh string").first().file_name.endswith(".json")


def test_directories_dossiers_and_pairs(spark, tmp_path):
    for name in ("x/1 GCN.pdf", "x/bia.PDF", "y/a.jpg", "y/note.txt", "z/scan.pdf"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    found = dossiers.scan_directory(spark, str(tmp_path))
    assert found.count() == 4
    assert [r.path.rsplit("/", 1)[1] for r in dossiers.number_files(found, 1, 2).collect()] == ["bia.PDF", "a.jpg"]
    chosen = {r.folder.rsplit("/", 1)[1]: (r.how, (r.path or "").rsplit("/", 1)[-1]) for r in dossiers.select_dossier_files(found.withColumn("landscape", F.col("path").contains("/z/"))).collect()}
    assert chosen == {"x": ("name", "bia.PDF"), "y": ("skipped", ""), "z": ("landscape", "scan.pdf")}
    h = at(spark, dossiers.path_hints(F.lit("/data/Tờ 12/Thửa 34/Nguyễn Văn An/file.pdf")))
    assert (h.sheet, h.parcel, h.owner) == ("12", "34", "Nguyễn Văn An")
    files = spark.createDataFrame([(f"/p/{n}.pdf",) for n in ("001-GCN", "001-GT", "002_gt", "003", "001")], "path string")
    assert {(r.pair_id, r.status) for r in dossiers.scan_pairs(files).collect()} == {("001", "both"), ("002", "gt_only"), ("003", "gcn_only")}
    renamed = sinks.rename_manifest(spark.createDataFrame([("/f/a.PDF", "5", "12"), ("/f/b.pdf", "5", "12"), ("/f/c.pdf", "", "")], "path string, sheet string, parcel string"))
    assert [r.destination for r in sorted(renamed.collect(), key=lambda r: r.path)] == ["5-12.pdf", "5-12__2.pdf", "c.pdf"]


def test_streams(spark, tmp_path):
    src, out, schema = str(tmp_path / "in"), str(tmp_path / "out"), "document_id string, field_key string, id long, review_status string, created_at timestamp"
    t = lambda h: dt.datetime(2024, 1, 1, h)
    batches = [[("d", "f", 1, "ok", t(1)), ("d", "g", 2, "ok", t(1))], [("d", "f", 3, "bad", t(3))], [("d", "f", 4, "old", t(2))]]
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(src)
    files.run_batches(files.file_batches(spark, src, schema, 1), files.into_table(out, ["id"]), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(out).count() == 4
    stream = files.file_batches(spark, src, schema, 1)
    q = files.latest_reviews(stream).writeStream.outputMode("update").format("memory").queryName("latest").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    seen = [tuple(r) for r in spark.sql("SELECT field_key, id FROM latest").collect()]
    assert ("f", 3) in seen and ("g", 2) in seen and ("f", 4) not in seen[seen.index(("f", 3)) :]
    counted = files.tumbling(stream.withColumn("value", F.lit(1.0)), "created_at", "1 hour", "1 day", ["document_id"]).writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    counted.awaitTermination()
    assert spark.sql("SELECT sum(n) AS n FROM windows").first().n == 4

"""Pages, tables, certificates and registration rows made from whole tables; the SQL computes the rules from the same made texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from parcelforge.functions import addresses, lines, parsers
from parcelforge.operators import certificate, changes, documents, evaluate, expand, merge, pages, readings, registration, review, spatial, store, tables
from parcelforge.plans.registry import query, table
from parcelforge.sources import dossiers

T = table
PAGE = ("doc_id", "page_index")


def pieces(key, *parts):
    """One of each part's texts by the key's remainders, joined by a space: all combinations come up."""
    out, width = [], 1
    for texts in parts:
        at = F.floor(key / width) % len(texts)
        piece = F
        for i, t in enumerate(texts):
            piece = piece.when(at == i, F.lit(t))
        out.append(piece)
        width *= len(texts)
    return F.concat_ws(" ", *out)


def sql_pieces(key, *parts):
    """The same as SQL."""
    out, width = [], 1
    for texts in parts:
        out.append(f"CASE ({key} // {width}) % {len(texts)} " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(texts)) + " END")
        width *= len(texts)
    return "concat_ws(' ', " + ", ".join(out) + ")"


def sql_any(column, words):
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


# ------------------------------------------------------------------ readings
_P = ("", "12,5", "123", "abcdef", "cmnd abc", "012345678", "Nguyen Van An")
_V = ("", "12.6", "99", "wxyz", "ABCDEF", "AB 123456", "Nguyễn Văn An", "1234567890123")
_LADDER = f"""
WITH e AS (SELECT event_id, event_id % 5 = 0 AS barcode, {sql_pieces('event_id', _P)} AS p, (event_id % 101) / 100.0 AS pc, {sql_pieces('event_id // 7', _V)} AS a, (user_id % 97) / 96.0 AS ac, {sql_pieces('event_id // 11', ('', 'abcdef', '12,7'))} AS b, (event_id % 89) / 88.0 AS bc FROM events),
s AS (SELECT *, CASE WHEN a = '' OR (b <> '' AND bc > ac) THEN b ELSE a END AS v, CASE WHEN a = '' AND b = '' THEN 0 WHEN a = '' OR (b <> '' AND bc > ac) THEN bc ELSE ac END AS vc FROM e),
f AS (SELECT *, p IN ('12,5') AS pn, v IN ('12.6', '12,7') AS vn, strip_accents(lower(p)) AS pf, strip_accents(lower(v)) AS vf, p IN ('cmnd abc', '012345678') AS pk, v IN ('AB 123456', '1234567890123') AS vk, regexp_matches(p, '[0-9]') AS pd, regexp_matches(v, '[0-9]') AS vd FROM s),
"""


@query(_LADDER + """g AS (SELECT * FROM f WHERE pn OR vn OR barcode OR p = '' OR v = '' OR vc < 0.5 OR (pk AND NOT vk AND pc >= 0.75) OR pf = vf OR (p IN ('abcdef', '123') AND v = 'wxyz'))
SELECT event_id, CASE WHEN NOT barcode AND pn AND (NOT vn OR pc >= vc) THEN 'p' WHEN NOT barcode AND (pn OR vn) THEN 'v' WHEN barcode AND v = '1234567890123' AND vc >= 0.6 THEN 'v' WHEN barcode THEN 'p'
  WHEN pk AND NOT vk AND pc >= 0.75 THEN 'p' WHEN p = '' THEN 'v' WHEN v = '' OR vc < 0.5 THEN 'p' WHEN pf = vf THEN 'v' WHEN vc >= 0.7 AND vc + 0.12 >= pc THEN 'v' ELSE 'p' END AS side,
  CASE WHEN NOT barcode AND (pn OR vn) THEN 'numeric_highest_confidence' WHEN barcode AND v = '1234567890123' AND vc >= 0.6 THEN 'barcode_vietocr' WHEN barcode THEN 'barcode_paddle' WHEN pk AND NOT vk AND pc >= 0.75 THEN 'identity_paddle_only'
  WHEN p = '' THEN 'vietocr_only' WHEN v = '' OR vc < 0.5 THEN 'vietocr_low_confidence' WHEN pf = vf THEN 'vietocr_text_agrees_with_paddle' WHEN vc >= 0.7 AND vc + 0.12 >= pc THEN 'vietocr_strong_text' WHEN pc >= vc + 0.18 THEN 'paddle_stronger_disagreement' ELSE 'paddle_fallback' END AS reason FROM g
UNION ALL SELECT event_id, 'p or v', 'by likeness' FROM f WHERE event_id NOT IN (SELECT event_id FROM g)""")
def select_ocr_candidate(spark, d):
    """The ladder on readings of every event; where it hangs on a likeness between 0 and 1, only that it decides by likeness is compared."""
    e, k = T(spark, d, "events"), F.col("event_id")
    div = lambda n: F.floor(k / n)
    t = e.select("event_id", (k % 5 == 0).alias("is_barcode_box"), pieces(k, _P).alias("p_text"), ((k % 101) / 100.0).alias("p_conf"), pieces(div(7), _V).alias("v_text"), ((F.col("user_id") % 97) / 96.0).alias("v_conf"), pieces(div(11), ("", "abcdef", "12,7")).alias("v180_text"), ((k % 89) / 88.0).alias("v180_conf"))
    out = readings.select_readings(t)
    like = readings.likeness(F.col("p_text"), F.when(F.col("selected.side") == "v", F.col("selected.text")).otherwise(readings.surer(("", F.col("v_text"), F.col("v_conf")), ("", F.col("v180_text"), F.col("v180_conf")))["text"]))
    late = F.col("selected.reason").isin("vietocr_text_agrees_with_paddle", "vietocr_pure_text_priority", "vietocr_strong_text", "paddle_stronger_disagreement", "vietocr_text_priority", "paddle_fallback")
    between = late & (like < 1) & ~(F.col("p_text").isin("abcdef", "123") & (readings.surer(("", F.col("v_text"), F.col("v_conf")), ("", F.col("v180_text"), F.col("v180_conf")))["text"] == "wxyz"))
    return out.select("event_id", F.when(between, "p or v").otherwise(F.col("selected.side")).alias("side"), F.when(between, "by likeness").otherwise(F.col("selected.reason")).alias("reason"))


# --------------------------------------------------------------------- pages
_ROLE = (("", "Trang bổ sung", "chuyển nhượng cho", "x"), ("", "Người sử dụng đất", "y"), ("", "Thửa đất số: 3", "II. Thửa đất", "diện tích: 5"), ("", "Sơ đồ thửa đất"))


@query(f"""
WITH p AS (SELECT event_id, lower({sql_pieces('event_id', *_ROLE)}) AS t, CASE (event_id // 96) % 3 WHEN 0 THEN 'mau_A' WHEN 1 THEN 'mau_B' ELSE 'unknown' END AS template FROM events)
SELECT event_id, CASE WHEN trim(t) = '' THEN 'unknown' WHEN {sql_any('t', ('trang bổ sung', 'chuyển nhượng cho'))} THEN 'changes' WHEN template = 'mau_A' THEN 'cover_and_content'
  WHEN contains(t, 'người sử dụng đất') AND NOT {sql_any('t', ('thửa đất số:', 'ii. thửa đất'))} THEN 'cover' WHEN {sql_any('t', ('thửa đất số', 'ii. thửa đất', 'diện tích:'))} THEN 'content' WHEN contains(t, 'sơ đồ thửa đất') THEN 'diagram' ELSE 'content' END AS role FROM p""")
def classify_page_role(spark, d):
    k = F.col("event_id")
    template = F.when(F.floor(k / 96) % 3 == 0, "mau_A").when(F.floor(k / 96) % 3 == 1, "mau_B").otherwise("unknown")
    return T(spark, d, "events").select("event_id", pages.page_role(pieces(k, *_ROLE), template).alias("role"))


_PAPER = (("", "Giấy chứng nhận", "DIỆN TÍCH: 5", "tờ khác"), ("", "Biên lai thu tiền", "Văn bản công chứng", "z"))


@query(f"""
WITH p AS (SELECT o_custkey AS doc_id, o_orderkey, lower({sql_pieces('o_orderkey', *_PAPER)}) AS t, CASE WHEN o_orderkey % 3 > 0 THEN 1000 ELSE 540 END AS w, 750 AS h FROM orders),
q AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o_orderkey) - 1 AS page_index, count(*) OVER (PARTITION BY doc_id) AS n FROM p),
r AS (SELECT *, bool_and(page_index > 1 OR w > 1.25 * h) OVER (PARTITION BY doc_id) AS spread FROM q)
SELECT o_orderkey FROM r WHERE n <= 4 OR CASE WHEN spread THEN page_index < 2 OR (page_index < 4 AND w = 540) ELSE {sql_any('t', ('giấy chứng nhận', 'diện tích:'))} AND NOT {sql_any('t', ('biên lai thu', 'văn bản công chứng'))} END""")
def select_certificate_pages(spark, d):
    """A customer's orders as the pages of a file, with texts and sizes."""
    k = F.col("o_orderkey")
    p = T(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), "o_orderkey", pieces(k, *_PAPER).alias("text"), F.when(k % 3 > 0, 1000.0).otherwise(540.0).alias("width"), F.lit(750.0).alias("height"))
    p = p.withColumn("page_index", F.row_number().over(Window.partitionBy("doc_id").orderBy("o_orderkey")) - 1)
    return pages.select_certificate_pages(p).select("o_orderkey")


@query("SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS page FROM orders")
def page_number(spark, d):
    return pages.page_number(T(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("page_index"))).select(F.col("page_index").alias("o_orderkey"), "page")


_TEMPLATE = (("", "Cấp cho hộ ông", "Sổ hồng", "Thể hiện tại mã QR"), ("", "UBND tỉnh", "Quyền sở hữu nhà"))
_TOP = {"mau_A": ("cap cho ho ong", "cap cho ho", "ubnd tinh"), "mau_B": ("so hong", "quyen so huu nha"), "mau_2024": ("the hien tai ma qr",)}


@query(f"""
WITH p AS (SELECT event_id, strip_accents(lower({sql_pieces('event_id', _TEMPLATE[0])})) AS top, strip_accents(lower({sql_pieces('event_id // 4', _TEMPLATE[1])})) AS low FROM events),
f AS (SELECT *, top || ' ' || low AS whole FROM p),
s AS (SELECT event_id, CASE WHEN contains(whole, 'the hien tai ma qr') THEN 2 ELSE 0 END + CASE WHEN contains(top, 'the hien tai ma qr') THEN 3 ELSE 0 END AS n,
  {' + '.join(f"CASE WHEN contains(whole, '{w}') THEN 1 ELSE 0 END + CASE WHEN contains(CASE WHEN top = '' THEN whole ELSE top END, '{w}') THEN 2 ELSE 0 END" for w in _TOP['mau_A'])} AS a,
  {' + '.join(f"CASE WHEN contains(whole, '{w}') THEN 1 ELSE 0 END + CASE WHEN contains(CASE WHEN top = '' THEN whole ELSE top END, '{w}') THEN 2 ELSE 0 END" for w in _TOP['mau_B'])} AS b, whole FROM f)
SELECT event_id, CASE WHEN n >= 3 THEN 'mau_2024' WHEN b >= a AND b >= 1 THEN 'mau_B' WHEN a >= 1 THEN 'mau_A' ELSE 'unknown' END AS template FROM s WHERE trim(whole) <> ''""")
def classify_template(spark, d):
    """Pages of two tokens, one in the upper part and one below."""
    k = F.col("event_id")
    token = lambda i, text, y: T(spark, d, "events").select(k.alias("doc_id"), F.lit(0).alias("page_index"), F.lit(i).alias("ord"), text.alias("text"), F.lit(float(y)).alias("y1"), F.lit(y + 20.0).alias("y2"))
    t = token(0, pieces(k, _TEMPLATE[0]), 10).unionByName(token(1, pieces(F.floor(k / 4), _TEMPLATE[1]), 900))
    return pages.classify_template(t).select(F.col("doc_id").alias("event_id"), "template")


_BOX = (("123456", "12 34", "CCCD 123456789", "diện tích 1234567", "12a", "Số 1234567"),)


@query(f"""
WITH t AS (SELECT l_orderkey, l_partkey, l_suppkey, {sql_pieces('l_partkey', *_BOX)} AS t, min(l_quantity) * 20 AS y, min(l_linenumber) * 20 AS w FROM lineitem GROUP BY 1, 2, 3)
SELECT l_orderkey, l_partkey, l_suppkey, y + 10 >= 650 AND w >= 40 AND t IN ('123456', '12 34', 'Số 1234567') AS barcode FROM t""")
def is_barcode_box(spark, d):
    li = T(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey", "l_suppkey").agg((F.min("l_quantity") * 20).cast("double").alias("y1"), (F.min("l_linenumber") * 20).cast("double").alias("x2"))
    li = li.select("l_orderkey", "l_partkey", "l_suppkey", pieces(F.col("l_partkey"), *_BOX).alias("text"), F.lit(0.0).alias("x1"), "x2", "y1", (F.col("y1") + 20).alias("y2"))
    return li.select("l_orderkey", "l_partkey", "l_suppkey", spatial.is_barcode_box(F.lit(1000.0)).alias("barcode"))


@query("""
WITH t AS (SELECT l_orderkey, l_partkey, l_suppkey, min(l_linenumber) * 100.0 AS w, min(l_quantity) * 2.0 AS h FROM lineitem GROUP BY 1, 2, 3)
SELECT l_orderkey, l_partkey, l_suppkey, CAST(CASE WHEN l_partkey % 2 = 0 THEN greatest(6, least(40, round_even(w * 0.025, 0))) ELSE greatest(2, least(20, round_even(w * 0.008, 0))) END AS INTEGER) AS pad_x, CAST(greatest(2, least(CASE WHEN l_partkey % 2 = 0 THEN 14 ELSE 12 END, round_even(h * 0.2, 0))) AS INTEGER) AS pad_y FROM t""")
def crop_padding(spark, d):
    li = T(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey", "l_suppkey").agg((F.min("l_linenumber") * 100.0).alias("w"), (F.min("l_quantity") * 2.0).alias("h"))
    kind = F.when(F.col("l_partkey") % 2 == 0, "barcode").otherwise("default")
    return li.select("l_orderkey", "l_partkey", "l_suppkey", pages.crop_padding(kind, F.col("w").cast("double"), F.col("h").cast("double")).alias("p")).select("l_orderkey", "l_partkey", "l_suppkey", "p.pad_x", "p.pad_y")


# -------------------------------------------------------------------- tables
def parcel_pages(spark, d):
    """Every order as a page with a table: a row for each line number, a sheet in the first row of the odd orders and all rows of the even ones."""
    li = T(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"), F.min("l_quantity").alias("q"))
    li = li.withColumns({"k": F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")), "n": F.count("*").over(Window.partitionBy("l_orderkey"))})
    box = lambda text, x1, x2, y: F.struct(text.cast("string").alias("text"), F.lit(float(x1)).alias("x1"), F.lit(float(x2)).alias("x2"), y.cast("double").alias("y1"))
    y, top = 300 + 60 * F.col("k"), lambda v: F.lit(v)
    sheet = F.when((F.col("l_orderkey") % 2 == 0) | (F.col("k") == 1), F.col("s") % 90 + 1)
    cells = F.array(box(sheet, 60, 90, y), box(F.col("p") % 900 + 1, 140, 165, y), box(F.concat(F.col("q").cast("long"), F.lit(",5")), 220, 270, y), box(F.element_at(F.array(F.lit("Đất trồng cây lâu năm"), F.lit("đất ở tại đô thị"), F.lit("?")), (F.col("q").cast("int") % 3 + 1)), 380, 500, y))
    heads = F.when(F.col("k") == 1, F.array(box(F.concat(F.lit("a) Tổng số thửa đất: "), F.col("n")), 100, 400, top(120)), box(F.lit("Tờ bản đồ"), 40, 110, top(200)), box(F.lit("Thửa đất số"), 120, 200, top(200)), box(F.lit("Riêng"), 220, 270, top(240)), box(F.lit("Chung"), 300, 350, top(240)), box(F.lit("Mục đích sử dụng"), 380, 500, top(200)), box(F.lit("Thời hạn sử dụng"), 520, 640, top(200)), box(F.lit("Nguồn gốc sử dụng"), 700, 900, top(200)), box(F.lit("."), 1200, 1230, top(1500)))).otherwise(F.array().cast("array<struct<text:string,x1:double,x2:double,y1:double>>"))
    t = li.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_index"), F.col("k"), F.posexplode(F.concat(heads, cells)).alias("at", "b")).where("b.text is not null")
    return t.select("doc_id", "page_index", (F.col("k") * 20 + F.col("at")).alias("ord"), "b.text", F.lit(0.9).alias("confidence"), "b.x1", "b.y1", "b.x2", (F.col("b.y1") + 20).alias("y2"))


_PARCELS = """
WITH li AS (SELECT l_orderkey, l_linenumber, min(l_partkey) % 900 + 1 AS p, min(l_suppkey) % 90 + 1 AS s, floor(min(l_quantity)) AS q FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n, first_value(s) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS first FROM li)"""


@query(_PARCELS + """
SELECT l_orderkey AS doc_id, CAST(k AS INTEGER) AS stt, CAST(p AS VARCHAR) AS so_thua, CAST(CASE WHEN l_orderkey % 2 = 0 THEN s ELSE first END AS VARCHAR) AS to_ban_do, CAST(q + 0.5 AS DOUBLE) AS dien_tich, CASE q % 3 WHEN 0 THEN 'CLN' WHEN 1 THEN 'ODT' ELSE '' END AS ma_muc_dich, CAST(n AS INTEGER) AS total_parcels FROM r WHERE n >= 2""")
def extract_parcel_table(spark, d):
    return tables.extract_parcel_table(parcel_pages(spark, d)).select("doc_id", "stt", "so_thua", "to_ban_do", "dien_tich", "ma_muc_dich", "total_parcels")


@query(_PARCELS + " SELECT l_orderkey AS doc_id, max(n) >= 2 AS is_multi, CAST(CASE WHEN max(n) >= 2 THEN max(n) END AS INTEGER) AS total_parcels FROM r GROUP BY 1")
def is_multi_parcel_page(spark, d):
    return tables.multi_parcel_pages(parcel_pages(spark, d)).select("doc_id", "is_multi", "total_parcels")


@query("""
WITH o AS (SELECT DISTINCT l_orderkey FROM lineitem), e AS (SELECT unnest(['to_ban_do', 'so_thua', 'dien_tich_rieng', 'dien_tich_chung', 'muc_dich', 'thoi_han', 'nguon_goc']) AS c, unnest([30, 117.5, 202.5, 285, 382.5, 510, 690]) AS a, unnest([117.5, 202.5, 285, 382.5, 510, 690, 1280]) AS b)
SELECT l_orderkey AS doc_id, c AS col, CAST(a AS DOUBLE) AS col_from, CAST(b AS DOUBLE) AS col_to FROM o, e""")
def detect_columns(spark, d):
    cols = tables.detect_columns(parcel_pages(spark, d))
    every = F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"{c}_from").alias("col_from"), F.col(f"{c}_to").alias("col_to")) for c in tables.COLUMNS if c != "dia_chi"])
    return cols.select("doc_id", F.explode(every).alias("c")).select("doc_id", "c.*")


@query("""
WITH t AS (SELECT l_orderkey AS doc_id, l_partkey AS ord, min(l_linenumber) AS n FROM lineitem GROUP BY 1, 2), y AS (SELECT *, CAST(n AS DOUBLE) * 40 AS top, CAST(n * 37 % 7 * 100 AS DOUBLE) AS x FROM t)
SELECT doc_id, CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY top) - 1 AS INTEGER) AS line, string_agg(CAST(ord AS VARCHAR), ' ' ORDER BY x, ord) AS text FROM y GROUP BY doc_id, top""")
def group_lines(spark, d):
    """Tokens of one height of 40, so a line is a line number's."""
    t = T(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("ord")).agg(F.min("l_linenumber").alias("n"))
    t = t.select("doc_id", "ord", F.lit(0).alias("page_index"), F.col("ord").cast("string").alias("text"), F.lit(0.9).alias("confidence"), (F.col("n") * 37 % 7 * 100).cast("double").alias("x1"), (F.col("n") * 40).cast("double").alias("y1"))
    return spatial.group_lines(t.withColumns({"x2": F.col("x1") + 80, "y2": F.col("y1") + 20})).select("doc_id", "line", "text")


# -------------------------------------------------------------- certificates
def certificate_pages(spark, d):
    """Every customer as a document of three pages, whose fields are on different ones or blank."""
    c, k = T(spark, d, "customer"), F.col("c_custkey")
    s = lambda x: x.cast("string")
    opt = lambda test, x: F.when(test, x).otherwise(F.lit(""))
    n6, n9 = F.lpad(s(k), 6, "4"), F.lpad(s(k), 9, "1")
    field = lambda **x: F.map_from_entries(F.array(*[F.struct(F.lit(n).alias("key"), v.alias("value")) for n, v in x.items()]))
    one = field(ho_ten_chu_1=F.concat(F.lit("Ông Nguyễn Văn A"), s(k)), cmnd_chu_1=F.when(k % 3 == 0, n9).when(k % 3 == 1, F.lit("thôn Bản")).otherwise(F.concat(F.lit("0010"), F.lpad(s(k % 100), 2, "0"), F.lit("001234"))), so_phat_hanh=opt(k % 2 == 0, F.concat(F.lit("BP."), n6)), so_thua=opt(k % 5 == 0, F.lit("99")), ngay_sinh_chu_1=opt(k % 3 == 0, s(1950 + k % 40)))
    two = field(so_thua=opt(k % 4 > 0, s(k)), to_ban_do=F.concat(F.lit("0"), s(k % 80 + 1)), dien_tich_cap=s(F.round(F.abs("c_acctbal"), 2)), ma_muc_dich=F.lit("ONT+ODT"), muc_dich_su_dung=F.when(k % 2 == 0, "đất ở tại đô thị").otherwise("đất ở tại nông thôn"), so_phat_hanh=opt(k % 3 > 0, F.concat(F.lit("CD "), n6)), ty_le=F.when(k % 2 == 0, "1:500").otherwise("1/2001"))
    three = field(so_vao_so=F.concat(F.lit("CH "), s(k)), ma_vach=F.lpad(s(k), 13, "8"), so_phat_hanh=F.concat(F.lit("DO "), n6))
    page = lambda i, fields, *texts: F.struct(F.lit(i).alias("page_index"), fields.alias("fields"), F.array(*[F.lit(t) for t in texts]).alias("lines"))
    rows = c.select(F.col("c_custkey").alias("doc_id"), F.explode(F.array(page(0, one, "CỘNG HÒA XÃ HỘI", "Người sử dụng đất"), page(1, two, "Thửa đất số"), page(2, three, "Chứng nhận"))).alias("p")).select("doc_id", "p.*")
    return rows.select("doc_id", "page_index", F.lit("mau_B").alias("template"), "lines", "fields", F.create_map().cast("map<string,double>").alias("confidence"), F.array().cast(certificate.PARCEL).alias("parcels"), F.array().cast(certificate.HEIRS).alias("heirs"))


@query("""
SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 2 = 0 THEN 'BP ' ELSE CASE WHEN c_custkey % 3 > 0 THEN 'CD ' ELSE 'DO ' END END || lpad(c_custkey::VARCHAR, 6, '4') AS so_phat_hanh, CAST(CASE WHEN c_custkey % 2 = 0 THEN 1 WHEN c_custkey % 3 > 0 THEN 2 ELSE 3 END AS INTEGER) AS serial_page,
  CASE WHEN c_custkey % 4 > 0 THEN c_custkey::VARCHAR WHEN c_custkey % 5 = 0 THEN '99' END AS so_thua, CAST(c_custkey % 80 + 1 AS VARCHAR) AS to_ban_do, CASE WHEN c_custkey % 3 = 0 THEN lpad(c_custkey::VARCHAR, 9, '1') WHEN c_custkey % 3 = 2 THEN '0010' || lpad((c_custkey % 100)::VARCHAR, 2, '0') || '001234' END AS cccd,
  CASE c_custkey % 3 WHEN 0 THEN (1950 + c_custkey % 40)::VARCHAR WHEN 2 THEN '19' || lpad((c_custkey % 100)::VARCHAR, 2, '0') END AS born, CASE WHEN c_custkey % 2 = 0 THEN 'ODT' ELSE 'ONT' END AS code, CASE WHEN c_custkey > 0 THEN 'CH' || lpad(c_custkey::VARCHAR, CAST(greatest(5, length(c_custkey::VARCHAR)) AS INTEGER), '0') END AS registry, lpad(c_custkey::VARCHAR, 13, '8') AS barcode,
  concat_ws(',', 'nguoi_ky_qd', 'noi_cap', CASE WHEN c_custkey = 0 THEN 'so_vao_so' END, CASE WHEN c_custkey % 2 = 1 THEN 'ty_le_ban_do' END) AS review FROM customer""")
def merge_pages(spark, d):
    """Serials by rank, fields by their pages, births from numbers, codes by wording, and what needs review."""
    m = certificate.merge_pages(certificate_pages(spark, d))
    v = lambda f, name: F.col(f"{f}.value").alias(name)
    return m.select("doc_id", v("so_phat_hanh", "so_phat_hanh"), F.col("so_phat_hanh.page").alias("serial_page"), v("so_thua", "so_thua"), v("to_ban_do", "to_ban_do"), v("cccd_chu_1", "cccd"), v("nam_sinh_chu_1", "born"), v("ma_muc_dich", "code"), v("so_vao_so", "registry"), v("ma_vach", "barcode"), F.array_join("can_review", ",").alias("review"))


_ANCHORED = (("BP", "Số phát hành: CD", "CMND số BP"),)


@query("""
WITH t AS (SELECT c_custkey AS doc_id, c_custkey % 3 AS kind, lpad(c_custkey::VARCHAR, 6, '4') AS n, (c_custkey % 10) * 100 + 10 AS y FROM customer)
SELECT doc_id, CASE kind WHEN 0 THEN 'BP ' WHEN 1 THEN 'CD ' END || n AS serial, CAST(CASE WHEN kind = 1 THEN 100 WHEN y >= 600 THEN 85 ELSE 50 END AS INTEGER) AS score FROM t WHERE kind < 2
UNION ALL SELECT doc_id, 'AB ' || n, CAST(CASE WHEN y >= 600 THEN 80 ELSE 75 END AS INTEGER) FROM t WHERE kind = 2""")
def rank_serials(spark, d):
    """A page with one text, and for every third customer a number in two boxes."""
    c, k = T(spark, d, "customer"), F.col("c_custkey")
    n, y = F.lpad(k.cast("string"), 6, "4"), ((k % 10) * 100).cast("double")
    box = lambda i, text, x1: F.struct(F.lit(i).alias("ord"), text.alias("text"), F.lit(float(x1)).alias("x1"), F.lit(x1 + 50.0).alias("x2"))
    own = F.array(box(0, F.concat(pieces(k, *_ANCHORED), F.lit(" "), n), 500))
    split = F.array(box(1, F.lit("AB"), 100), box(2, n, 160))
    t = c.select(k.alias("doc_id"), F.lit(0).alias("page_index"), y.alias("y1"), F.explode(F.when(k % 3 == 2, F.concat(own, split)).otherwise(own)).alias("b")).select("doc_id", "page_index", "b.*", "y1", (F.col("y1") + 20).alias("y2"), F.lit(0.9).alias("confidence"))
    return certificate.best_serials(certificate.serial_candidates(t)).select("doc_id", "best.serial", "best.score")


@query("""
WITH c AS (SELECT c_custkey AS doc_id, c_custkey % 4 AS k, CAST(c_custkey % 70 + 1 AS VARCHAR) AS old, CAST(c_custkey % 90 + 100 AS VARCHAR) AS new FROM customer)
SELECT doc_id, CASE WHEN k = 1 THEN new ELSE old END AS to_ban_do, CASE WHEN k = 1 THEN old END AS to_ban_do_goc, CASE WHEN k = 2 THEN '0010000' || lpad((doc_id % 100000)::VARCHAR, 5, '0') ELSE '012345678' END AS cccd, CASE WHEN k IN (1, 2) THEN 'rules' WHEN k = 3 THEN 'model' END AS changed_by, CASE WHEN k = 3 THEN 'x' ELSE CAST(doc_id AS VARCHAR) END AS so_thua FROM c""")
def apply_mutations(spark, d):
    c, k = T(spark, d, "customer"), F.col("c_custkey")
    s = lambda x: x.cast("string")
    docs = c.select(k.alias("doc_id"), s(k % 70 + 1).alias("to_ban_do"), s(k).alias("so_thua"), F.lit("1").alias("dien_tich_cap"), F.lit("012345678").alias("cccd_chu_1"), F.lit("A").alias("ho_ten_chu_1"), F.array().cast(certificate.PARCEL).alias("parcels"))
    text = F.when(k % 4 == 1, F.concat(F.lit("Đính chính tờ bản đồ số thành "), s(k % 90 + 100))).when(k % 4 == 2, F.concat(F.lit("thay đổi thành 0010000"), F.lpad(s(k % 100000), 5, "0"))).when(k % 4 == 3, "khác")
    said = c.select(k.alias("doc_id"), F.lit(3).alias("page_index"), F.lit(1).alias("stt"), text.alias("content")).where("content is not null")
    answers = c.where("c_custkey % 4 = 3").select(k.alias("doc_id"), F.lit("x").alias("so_thua"))
    return certificate.apply_mutations(docs, said, answers).select("doc_id", "to_ban_do", "to_ban_do_goc", F.col("cccd_chu_1").alias("cccd"), "changed_by", "so_thua")


# ----------------------------------------------------------- registration
_STREET, _HAMLET, _WARD = ("", "Số 12 đường Lê Lợi, "), ("", "thôn Bản Cao, ", "tổ dân phố 5, "), ("xã Hoa Thám", "phường Tam Thanh")


@query(f"""
WITH a AS (SELECT c_custkey, (c_custkey % 2) AS street, (c_custkey // 2) % 3 AS hamlet, (c_custkey // 6) % 2 AS ward, (c_custkey // 12) % 3 AS upper FROM customer)
SELECT c_custkey, CASE WHEN street = 1 THEN '12' ELSE '' END AS so_nha, CASE WHEN street = 1 THEN 'Lê Lợi' ELSE '' END AS ten_duong_pho, CASE hamlet WHEN 1 THEN 'thôn Bản Cao' WHEN 2 THEN 'tổ dân phố 5' ELSE '' END AS ten_tdp, CASE ward WHEN 0 THEN 'Hoa Thám' ELSE 'Tam Thanh' END AS ten_xa,
  CASE upper WHEN 0 THEN '' WHEN 1 THEN 'Bình Gia' ELSE 'Lê Chân' END AS ten_huyen, CASE upper WHEN 0 THEN '' WHEN 1 THEN 'Lạng Sơn' ELSE 'Hải Phòng' END AS ten_tinh,
  CASE WHEN street = 1 THEN 'Số 12 đường Lê Lợi, ' ELSE '' END || CASE hamlet WHEN 1 THEN 'thôn Bản Cao, ' WHEN 2 THEN 'tổ dân phố 5, ' ELSE '' END || CASE ward WHEN 0 THEN 'xã Hoa Thám' ELSE 'phường Tam Thanh' END || CASE upper WHEN 1 THEN ', huyện Bình Gia, tỉnh Lạng Sơn' WHEN 2 THEN ', quận Lê Chân' ELSE '' END AS dia_chi_chi_tiet FROM a""")
def decompose_address(spark, d):
    """All combinations of parts, with a label before and misread places and a serial behind."""
    k = F.col("c_custkey")
    part = lambda width, texts: F.element_at(F.array(*[F.lit(t) for t in texts]), (F.floor(k / width) % len(texts) + 1).cast("int"))
    text = F.concat(F.lit("Địa chỉ thường trú: "), part(1, _STREET), part(2, _HAMLET), part(6, _WARD), part(12, ("", " huyện Bình Giu tinh Lang Sơn", ", quận Lê Châu")), part(36, ("", " BH 405659")))
    return T(spark, d, "customer").select("c_custkey", addresses.decompose_address(text).alias("p")).select("c_custkey", "p.*")


_NOISE = (("thôn A", "UBND xã B", "văn phòng đăng ký", "diện tích 5", ""), ("", "m2", "tờ bản đồ", "1 2 3"))


@query(f"""
WITH t AS (SELECT p_partkey, lower(trim({sql_pieces('p_partkey', *_NOISE)})) AS t FROM part)
SELECT p_partkey, {sql_any('t', ('ubnd', 'văn phòng đăng ký'))} AS authority, t = '' OR {sql_any('t', ('ubnd', 'văn phòng đăng ký', 'diện tích', 'm2', 'tờ bản đồ'))} AS contaminated, {sql_any('t', ('diện tích', 'tờ bản đồ'))} OR len(regexp_extract_all(t, '[0-9]+')) >= 3 AS noise FROM t""")
def is_contaminated_address(spark, d):
    t = F.trim(pieces(F.col("p_partkey"), *_NOISE))
    return T(spark, d, "part").select("p_partkey", addresses.is_authority_text(t).alias("authority"), addresses.is_contaminated_address(t).alias("contaminated"), addresses.looks_like_table_noise(t).alias("noise"))


@query("""
WITH p AS (SELECT p_partkey, p_partkey % 3 AS a, (p_partkey // 3) % 2 AS b, (p_partkey // 6) % 3 AS c, (p_partkey // 18) % 2 AS t, (p_partkey // 36) % 2 AS o FROM part)
SELECT p_partkey, concat_ws(',', CASE a WHEN 0 THEN 'missing_parcel_number' WHEN 1 THEN 'invalid_parcel_number' END, CASE WHEN b = 0 THEN 'missing_map_sheet' END, CASE c WHEN 0 THEN 'missing_area' WHEN 1 THEN 'invalid_area' END, CASE WHEN p_partkey % 5 = 0 THEN 'missing_land_use_purpose' WHEN p_partkey % 5 = 1 THEN 'invalid_land_use_purpose' END, CASE WHEN t = 0 THEN 'missing_land_use_term' END, CASE WHEN o = 0 THEN 'invalid_land_use_origin' END) AS reasons,
  CASE WHEN a = 2 THEN CAST(p_partkey AS VARCHAR) ELSE '' END AS so_thua, CASE WHEN p_partkey % 5 IN (2, 3, 4) THEN 'CLN' ELSE '' END AS code FROM p""")
def normalise_parcel_item(spark, d):
    k = F.col("p_partkey")
    s = lambda x: x.cast("string")
    at = lambda width, n: F.floor(k / width) % n
    use = F.when(k % 5 == 0, "").when(k % 5 == 1, "gì đó").otherwise("đất trồng cây lâu năm")
    p = F.struct(F.when(at(1, 3) == 0, "-").when(at(1, 3) == 1, "6 thửa").otherwise(s(k)).alias("so_thua"), F.when(at(3, 2) == 0, "").otherwise("05").alias("to_ban_do"), F.when(at(6, 3) == 0, "").when(at(6, 3) == 1, "0.1").otherwise("12.5").alias("dien_tich"), F.lit("").alias("ma_muc_dich"), use.alias("muc_dich_su_dung"), F.when(at(18, 2) == 0, "").otherwise("lâu dài").alias("thoi_han"), F.when(at(36, 2) == 0, "không rõ gì").otherwise("nhận chuyển nhượng").alias("nguon_goc"), F.lit("").alias("dia_chi"))
    return T(spark, d, "part").select("p_partkey", registration.normalise_parcel(p).alias("r")).select("p_partkey", F.array_join("r.reasons", ",").alias("reasons"), "r.so_thua", F.col("r.ma_muc_dich").alias("code"))


_OWNER = (("Nguyễn Văn An", "Hộ ông Lê Tư", "Công ty X", "Ông A và bà B", "Chùa Hai"), ("", "ubnd xã", "tôn giáo", "hộ khẩu"))


@query(f"""
WITH t AS (SELECT c_custkey, lower({sql_pieces('c_custkey', _OWNER[0])}) AS own, lower({sql_pieces('c_custkey // 5', _OWNER[1])}) AS line FROM customer), p AS (SELECT *, own || ' ' || line || ' ' AS page FROM t)
SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'dong_thua_ke' WHEN contains(page, 'hộ ') THEN 'ho_gia_dinh' WHEN {sql_any('page', ('công ty', 'ubnd'))} THEN 'to_chuc' WHEN {sql_any('page', ('tôn giáo', 'chùa'))} THEN 'cong_dong' WHEN contains(own, 'và bà') THEN 'vo_chong' ELSE 'ca_nhan' END AS kind FROM p""")
def owner_type(spark, d):
    k = F.col("c_custkey")
    return T(spark, d, "customer").select("c_custkey", merge.owner_type(pieces(k, _OWNER[0]), F.when(k % 7 == 0, 2).otherwise(0), F.array(pieces(F.floor(k / 5), _OWNER[1]))).alias("kind"))


_CODES, _WORDS = ("", "CLN", "LUA", "ONT+ODT", "xyz"), ("", "khu đô thị", "đất nông thôn", "phường 5", "xã Hoa", "cây hàng năm", "đất nuôi trồng thủy sản", "?")


@query(f"""
WITH t AS (SELECT p_partkey, {sql_pieces('p_partkey', _CODES)} AS code, {sql_pieces('p_partkey // 5', _WORDS)} AS w FROM part), o AS (SELECT *, CASE WHEN code = '' THEN w ELSE code END AS own, CASE WHEN w = '' THEN code ELSE w END AS said FROM t)
SELECT p_partkey, CASE WHEN own = '' THEN '' WHEN contains(said, 'đô thị') THEN 'ODT' WHEN contains(said, 'nông thôn') THEN 'ONT' WHEN own = 'LUA' THEN 'LUC' WHEN own = 'ONT+ODT' THEN CASE WHEN contains(said, 'phường') THEN 'ODT' WHEN contains(said, 'xã') THEN 'ONT' ELSE 'ODT' END WHEN own = 'CLN' THEN 'CLN'
  WHEN own = 'đất nuôi trồng thủy sản' THEN 'NTS' WHEN contains(said, 'hàng năm') THEN 'HNK' WHEN contains(said, 'thủy sản') THEN 'NTS' ELSE '' END AS code FROM o""")
def map_purpose(spark, d):
    k = F.col("p_partkey")
    return T(spark, d, "part").select("p_partkey", parsers.map_purpose(pieces(k, _CODES), pieces(F.floor(k / 5), _WORDS)).alias("code"))


@query("""
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Ông: ' WHEN 1 THEN 'Bà: ' WHEN 2 THEN 'Hộ ông: ' ELSE '' END || 'Nguyễn Văn A' || c_custkey AS name FROM customer""")
def title_name(spark, d):
    k = F.col("c_custkey")
    lead = F.element_at(F.array(*[F.lit(x) for x in ("ông ", "BÀ: ", "hộ gia đình ông ", "")]), (k % 4 + 1).cast("int"))
    return T(spark, d, "customer").select("c_custkey", lines.title_name(F.concat(lead, F.lit("nguyễn  VĂN a"), k.cast("string"))).alias("name"))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(c_custkey AS VARCHAR) END AS so_thua, CAST(c_custkey % 80 + 1 AS VARCHAR) AS to_ban_do, CASE WHEN c_custkey % 2 = 0 THEN 'ONT' ELSE 'CLN' END AS ma_muc_dich, CASE WHEN c_custkey % 3 = 0 THEN 'Lâu dài' END AS thoi_han, CAST(c_custkey AS VARCHAR) || '.5' AS dien_tich FROM customer""")
def parse_parcel(spark, d):
    """Labels with their values beside them or on the line below, two labels on a line, and a total in place of a number."""
    k = F.col("c_custkey")
    s = lambda x: x.cast("string")
    number = F.when(k % 5 == 0, F.lit("6 thửa")).otherwise(s(k))
    text = F.array(F.lit("2. THÔNG TIN"), F.concat(F.lit("a) Thửa đất số: "), number, F.lit(", tờ bản đồ số: 0"), s(k % 80 + 1)), F.lit("đ) Mục đích sử dụng:"), F.when(k % 2 == 0, "Đất ở tại nông thôn").otherwise("đất trồng cây lâu năm"), F.concat(F.lit("e) Thời hạn sử dụng: "), F.when(k % 3 == 0, "lâu dài").otherwise("abc")), F.concat(F.lit("c) Diện tích: "), s(k), F.lit(",5 m2")))
    return T(spark, d, "customer").select("c_custkey", lines.parse_parcel(text).alias("p")).select("c_custkey", "p.so_thua", "p.to_ban_do", "p.ma_muc_dich", "p.thoi_han", F.col("p.dien_tich_cap").alias("dien_tich"))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN lpad(c_custkey::VARCHAR, 12, '0') ELSE 'old' END AS cccd, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 = 0 THEN 'CARD' WHEN c_custkey % 3 = 0 THEN 'Họ và tên' ELSE c_name END AS name, CASE WHEN c_custkey % 2 = 0 AND length(c_name || c_mktsegment) > 27 THEN c_name || c_mktsegment ELSE 'xã Hoa Thám, tỉnh Lạng Sơn.' END AS home FROM customer""")
def enrich_owner_from_id(spark, d):
    """A card's number always wins, its name only over a label, its address only if it is longer."""
    c, k = T(spark, d, "customer"), F.col("c_custkey")
    docs = c.select(k.alias("doc_id"), F.when(k % 3 == 0, "Họ và tên").otherwise(F.col("c_name")).alias("ho_ten_chu_1"), F.lit("old").alias("cccd_chu_1"), F.lit("xã Hoa Thám, tỉnh Lạng Sơn.").alias("dia_chi_thuong_tru"))
    cards = c.where("c_custkey % 2 = 0").select(k.alias("doc_id"), F.lpad(k.cast("string"), 12, "0").alias("so_cccd"), F.lit("CARD").alias("ho_ten"), F.lit(None).cast("string").alias("ngay_sinh"), F.lit(None).cast("string").alias("gioi_tinh"), F.concat("c_name", "c_mktsegment").alias("noi_thuong_tru"))
    return merge.enrich_owner_from_card(docs, cards).select(F.col("doc_id").alias("c_custkey"), F.col("cccd_chu_1").alias("cccd"), F.col("ho_ten_chu_1").alias("name"), F.col("dia_chi_thuong_tru").alias("home"))


# -------------------------------------------------------- store and the rest
@query("""
WITH m AS (SELECT o_custkey % 40 AS p, o_orderkey % 25 AS u, bool_or(o_orderkey % 7 = 0) AS manager FROM orders GROUP BY 1, 2), r AS (SELECT c_custkey, c_custkey % 40 AS p, c_custkey % 25 AS u, c_custkey % 50 = 0 AS admin, c_custkey % 9 = 0 AS head, c_custkey % 3 = 0 AS own FROM customer)
SELECT c_custkey, manager IS NOT NULL AS is_member, admin OR (manager IS NOT NULL AND (manager OR head OR own)) AS can_access, admin OR (manager IS NOT NULL AND (manager OR head)) AS can_delete FROM r LEFT JOIN m USING (p, u)""")
def can_access(spark, d):
    o, k = F.col("o_orderkey"), F.col("c_custkey")
    members = T(spark, d, "orders").select((F.col("o_custkey") % 40).alias("project_id"), (o % 25).alias("user_id"), F.when(o % 7 == 0, "truong_phong").otherwise("thanh_vien").alias("role_in_project"))
    asked = T(spark, d, "customer").select("c_custkey", (k % 40).alias("project_id"), (k % 25).alias("user_id"), (k % 50 == 0).alias("is_admin"), (k % 9 == 0).alias("is_head"), F.when(k % 3 == 0, k % 25).otherwise(-1).alias("created_by"))
    return store.access(asked, members).select("c_custkey", "is_member", "can_access", "can_delete")


@query("SELECT count(*) FILTER (k = 0) AS both, count(*) FILTER (k = 1) AS gcn_only, count(*) FILTER (k = 2) AS gt_only, count(*) AS pairs FROM (SELECT event_id % 3 AS k FROM events)")
def pair_status_counts(spark, d):
    k = F.col("event_id") % 3
    return merge.pair_status_counts(T(spark, d, "events").select(F.when(k == 0, "both").when(k == 1, "gcn_only").otherwise("gt_only").alias("status")))


@query("SELECT count(*) FILTER (k = 0) AS supported, count(*) FILTER (k = 1) AS review_required, count(*) FILTER (k = 2) AS not_available FROM (SELECT event_id % 4 AS k FROM events)")
def audit_status_counts(spark, d):
    k = F.col("event_id") % 4
    return merge.audit_status_counts(T(spark, d, "events").select(F.when(k == 0, "supported").when(k == 1, "review_required").when(k == 2, "not_available").otherwise("other").alias("status")))


@query("SELECT o_custkey AS doc_id, string_agg(o_orderpriority || ',' || o_orderstatus, ',' ORDER BY o_orderkey) AS texts FROM orders GROUP BY 1")
def union_text_sources(spark, d):
    p = T(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("page_index"), F.array("o_orderpriority", "o_orderstatus").alias("mutations"))
    return store.union_text_sources(p).select("doc_id", F.array_join("mutations", ",").alias("texts"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{"a":' || event_id || '}' ELSE '{}' END AS payload FROM events""")
def json_coerce(spark, d):
    k = F.col("event_id")
    text = F.when(k % 3 == 0, F.concat(F.lit('{"a":'), k.cast("string"), F.lit("}"))).when(k % 3 == 1, F.when(k % 2 == 0, F.lit("[1]")).otherwise("{broken")).otherwise(F.lit(None))
    return T(spark, d, "events").select("event_id", review.json_coerce(text).alias("payload"))


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 5000")
def oldest_documents(spark, d):
    """The limit is the feature: the oldest 5,000."""
    o = T(spark, d, "orders").withColumn("rows", F.lit("[]"))
    return store.oldest_documents(o, [F.col("o_orderdate").asc(), F.col("o_orderkey").asc()]).select("o_orderkey", "o_orderdate")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 10000")
def dump_records(spark, d):
    """The limit is the feature: the newest 10,000."""
    return store.dump(T(spark, d, "orders"), [F.col("o_orderdate").desc(), F.col("o_orderkey").asc()]).select("o_orderkey", "o_orderdate")


@query("""SELECT doc_id, CASE WHEN k = 1 THEN n ELSE regexp_replace(n, '[.]pdf$', '') || '__' || (k + CASE WHEN lower(n) = 'a.pdf' AND k >= 3 THEN 1 ELSE 0 END) || '.pdf' END AS destination
FROM (SELECT doc_id, n, folder, row_number() OVER (PARTITION BY folder, lower(n) ORDER BY doc_id) AS k FROM (SELECT doc_id, doc_id % 50 AS folder, CASE doc_id // 50 % 3 WHEN 0 THEN 'a.pdf' WHEN 1 THEN 'A.pdf' ELSE 'a__3.pdf' END AS n FROM documents))""")
def unique_destination(spark, d):
    """A file whose own name looks made keeps it, and made names pass it over."""
    k = F.floor(F.col("doc_id") / 50) % 3
    files = T(spark, d, "documents").select("doc_id", (F.col("doc_id") % 50).alias("folder"), F.when(k == 0, "a.pdf").when(k == 1, "A.pdf").otherwise("a__3.pdf").alias("name"))
    return dossiers.unique_destinations(files, "folder", "name", F.col("doc_id")).select("doc_id", "destination")


@query("SELECT l_orderkey AS doc_id, bool_or(l_linenumber = 3) AS is_mutation FROM lineitem GROUP BY 1")
def is_mutation_page(spark, d):
    t = T(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_index"), F.when(F.col("l_linenumber") == 3, "Nội dung thay đổi và cơ sở pháp lý").otherwise("khác").alias("text"))
    return changes.is_mutation_page(t).select("doc_id", "is_mutation")


@query("""
WITH li AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k FROM li)
SELECT l_orderkey AS doc_id, CAST(k AS INTEGER) AS stt, CASE p % 3 WHEN 0 THEN 'the_chap' WHEN 1 THEN 'chuyen_nhuong' ELSE 'dinh_chinh' END AS type, lpad((p % 28 + 1)::VARCHAR, 2, '0') || '/05/2019' AS date, p || '.TC' AS file_no, CASE WHEN p % 2 = 0 THEN 'UBND' END AS agency FROM r""")
def extract_mutations(spark, d):
    """Every order as a change table: an entry for each line number, half of them confirmed in the right column."""
    li = T(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    li = li.withColumn("k", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")))
    p, y = F.col("p"), 100 + 300 * F.col("k")
    box = lambda i, text, x1, x2, at: F.struct(F.lit(i).alias("i"), text.alias("text"), F.lit(float(x1)).alias("x1"), F.lit(float(x2)).alias("x2"), at.cast("double").alias("y1"))
    entry = F.concat(F.when(p % 3 == 0, "Thế chấp").when(p % 3 == 1, "Chuyển nhượng").otherwise("Đính chính"), F.lit(" hồ sơ số "), p.cast("string"), F.lit(".TC ngày "), (p % 28 + 1).cast("string"), F.lit("/5/2019"))
    cells = F.array(box(0, entry, 60, 500, y), box(1, F.when(p % 2 == 0, "UBND xã"), 700, 900, y + 10))
    heads = F.when(F.col("k") == 1, F.array(box(2, F.lit("Nội dung thay đổi và cơ sở pháp lý"), 50, 500, F.lit(50)), box(3, F.lit("Xác nhận của cơ quan"), 700, 1100, F.lit(50)))).otherwise(F.array().cast("array<struct<i:int,text:string,x1:double,x2:double,y1:double>>"))
    t = li.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_index"), "k", F.explode(F.concat(cells, heads)).alias("b")).where("b.text is not null")
    t = t.select("doc_id", "page_index", (F.col("k") * 4 + F.col("b.i")).alias("ord"), "b.text", "b.x1", "b.y1", "b.x2", (F.col("b.y1") + 20).alias("y2"))
    return changes.extract_mutations(t).select("doc_id", F.col("stt").cast("int").alias("stt"), "type", "date", "file_no", "agency")


@query()
def sample_files(spark, d):
    """The sample is the feature: 50 pages by a seeded hash, which SQL has not."""
    return evaluate.sample_files(T(spark, d, "pages").select("page_id", "url"), 50, path="url")


@query("""
WITH p AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE c_custkey || '+' || c_custkey + 1 END AS parcels, CASE c_custkey % 2 WHEN 0 THEN '7' ELSE '1+2' END AS sheets FROM customer)
SELECT c_custkey, CAST(i AS INTEGER) AS parcel_no, CASE WHEN c_custkey % 3 = 0 THEN parcels ELSE CAST(c_custkey + i - 1 AS VARCHAR) END AS so_thua, CASE WHEN c_custkey % 3 = 0 THEN sheets WHEN c_custkey % 2 = 0 THEN '7' ELSE CAST(i AS VARCHAR) END AS to_ban_do FROM p, unnest(range(1, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 3 END)) t(i)""")
def expand_parcels_function(spark, d):
    """The table function under its SQL name."""
    expand.register_expand_parcels(spark)
    k = F.col("c_custkey")
    T(spark, d, "customer").select("c_custkey", F.when(k % 3 == 0, k.cast("string")).otherwise(F.concat_ws("+", k.cast("string"), (k + 1).cast("string"))).alias("parcels"), F.when(k % 2 == 0, "7").otherwise("1+2").alias("sheets")).createOrReplaceTempView("joined_parcels")
    return spark.sql("SELECT c_custkey, parcel_no, so_thua, to_ban_do FROM joined_parcels, LATERAL expand_parcels(parcels, sheets, '', '')")


@query("""
SELECT s_suppkey AS doc_id, 1 AS "STT", 'BP ' || lpad(s_suppkey::VARCHAR, 6, '4') AS "GCN_soPhatHanh", CASE WHEN s_suppkey > 0 THEN 'CH' || lpad(s_suppkey::VARCHAR, 5, '0') ELSE '' END AS "GCN_soVaoSo", '15/10/2018' AS "GCN_ngayCap", 'Nguyễn Văn An' AS "CHU_hoTen", '1960' AS "CHU_ngaySinh",
  lpad(s_suppkey::VARCHAR, 9, '1') AS "GT_soGiayTo", 'Hoa Thám' AS "CHU_tenXa", s_suppkey::VARCHAR AS "TD_soThuTuThua", '5' AS "TD_soHieuToBanDo", s_suppkey + 0.5::DOUBLE AS "TD_dienTich", 'ONT' AS "TD_maMucDichSuDung" FROM supplier""")
def process_documents(spark, d):
    """Every supplier as a certificate of two pages, from tokens to registration rows."""
    c, k = T(spark, d, "supplier"), F.col("s_suppkey")
    s = k.cast("string")
    page = lambda i, *texts: F.transform(F.array(*texts), lambda t, n: F.struct(F.lit(i).alias("page_index"), n.alias("ord"), t.alias("text"), (60.0 + 40 * n).alias("y1")))
    one = page(0, F.lit("CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM"), F.lit("I. Người sử dụng đất"), F.concat(F.lit("Ông: Nguyễn Văn An, sinh năm 1960, CMND số "), F.lpad(s, 9, "1")), F.lit("Địa chỉ thường trú: thôn Bản Cao, xã Hoa Thám, huyện Bình Gia, tỉnh Lạng Sơn"), F.concat(F.lit("Số phát hành: BP "), F.lpad(s, 6, "4")))
    two = page(1, F.lit("II. Thửa đất"), F.concat(F.lit("a) Thửa đất số: "), s, F.lit(", tờ bản đồ số: 5")), F.concat(F.lit("c) Diện tích: "), s, F.lit(",5 m2")), F.lit("đ) Mục đích sử dụng: Đất ở tại nông thôn"), F.lit("Bình Gia, ngày 15 tháng 10 năm 2018"), F.concat(F.lit("Số vào sổ cấp GCN: CH "), s))
    t = c.select(k.alias("doc_id"), F.explode(F.concat(one, two)).alias("b")).select("doc_id", "b.page_index", "b.ord", "b.text", F.lit(0.9).alias("confidence"), F.lit(100.0).alias("x1"), "b.y1", (100.0 + 12 * F.length("b.text")).alias("x2"), (F.col("b.y1") + 20).alias("y2"))
    return documents.process_documents(t).select("doc_id", "STT", "GCN_soPhatHanh", "GCN_soVaoSo", "GCN_ngayCap", "CHU_hoTen", "CHU_ngaySinh", "GT_soGiayTo", "CHU_tenXa", "TD_soThuTuThua", "TD_soHieuToBanDo", "TD_dienTich", "TD_maMucDichSuDung")

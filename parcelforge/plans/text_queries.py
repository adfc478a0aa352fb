"""Scalar functions, validators and renderings on the driver's tables; texts for validators are made from keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelforge.functions import fuzzy, text, validators
from parcelforge.operators import evaluate, expand, rendering
from parcelforge.plans.registry import query, table
from parcelforge.sources.dossiers import unique_destinations

T = table


@query(r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS h FROM documents")
def clean_text(spark, d):
    return T(spark, d, "documents").select("doc_id", F.md5(text.clean_text(F.col("text"))).alias("h"))


@query("SELECT doc_id, md5(regexp_replace(text, '[^0-9]', '', 'g')) AS h, CAST(length(regexp_replace(text, '[^0-9]', '', 'g')) AS INTEGER) AS n FROM documents")
def digits_only(spark, d):
    c = text.digits_only(F.col("text"))
    return T(spark, d, "documents").select("doc_id", F.md5(c).alias("h"), F.length(c).alias("n"))


@query("SELECT doc_id, md5(strip_accents(lower(text))) AS h FROM documents")
def fold_accents(spark, d):
    return T(spark, d, "documents").select("doc_id", F.md5(text.fold_accents(F.col("text"))).alias("h"))


@query("SELECT doc_id, md5(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]', '', 'g')) AS h FROM documents")
def comparable_text(spark, d):
    return T(spark, d, "documents").select("doc_id", F.md5(text.comparable_text(F.col("text"))).alias("h"))


@query("""
SELECT s_suppkey, CASE WHEN lower(trim(v)) IN ('', '-', 'n/a') THEN NULL ELSE trim(v) END AS v FROM (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN ' - ' WHEN 1 THEN 'N/A' WHEN 2 THEN '' ELSE ' ' || s_name END AS v FROM supplier)""")
def nullify_placeholder(spark, d):
    k = F.col("s_suppkey") % 4
    v = F.when(k == 0, " - ").when(k == 1, "N/A").when(k == 2, "").otherwise(F.concat(F.lit(" "), F.col("s_name")))
    return T(spark, d, "supplier").select("s_suppkey", text.nullify_placeholder(v).alias("v"))


@query("""
WITH p AS (SELECT p_partkey, p_brand || p_size AS x, regexp_replace(p_brand || p_size, '[^0-9]', '', 'g') AS n, p_brand, p_name FROM part),
q AS (SELECT p_partkey, lower(x) AS x, lower(CASE p_partkey % 5 WHEN 0 THEN upper(x) || ' -' WHEN 1 THEN 'No. ' || n WHEN 2 THEN '9' || n || '9' WHEN 3 THEN p_brand ELSE p_name END) AS y FROM p),
r AS (SELECT *, regexp_replace(x, '[^a-z0-9]', '', 'g') AS s, regexp_replace(y, '[^a-z0-9]', '', 'g') AS t, regexp_replace(x, '[^0-9]', '', 'g') AS dx, regexp_replace(y, '[^0-9]', '', 'g') AS dy FROM q)
SELECT p_partkey, round(CASE WHEN s = t THEN 1.0 WHEN dx = dy AND dx <> '' THEN 0.98 WHEN least(length(dx), length(dy)) >= 3 AND (contains(dx, dy) OR contains(dy, dx)) THEN 0.82
  WHEN least(length(s), length(t)) >= 3 AND (contains(s, t) OR contains(t, s)) THEN 0.6 + 0.35 * least(length(s), length(t)) / greatest(length(s), length(t)) ELSE 0.0 END, 4) AS score FROM r""")
def token_match_score(spark, d):
    """Brand and size of every part against a token of the same row: in capitals, its digits, its digits within others, the brand, the name."""
    x, k = F.concat("p_brand", "p_size"), F.col("p_partkey") % 5
    n = text.digits_only(x)
    y = F.when(k == 0, F.concat(F.upper(x), F.lit(" -"))).when(k == 1, F.concat(F.lit("No. "), n)).when(k == 2, F.concat(F.lit("9"), n, F.lit("9"))).when(k == 3, F.col("p_brand")).otherwise(F.col("p_name"))
    return T(spark, d, "part").select("p_partkey", F.round(text.token_match_score(x, y), 4).alias("score"))


@query(r"""
WITH b AS (SELECT item_id, regexp_replace(text, '[^\x00-\x7F]', '?', 'g') AS t FROM benchmark)
SELECT a.item_id AS a, b.item_id AS b, CAST(levenshtein(a.t, b.t) AS INTEGER) AS d, round(levenshtein(a.t, b.t) / length(b.t), 6) AS cer FROM b a JOIN b ON a.item_id % 10 = b.item_id % 10""")
def levenshtein_cer(spark, d):
    """The character error rate of whole items against others of the same last digit; signs beyond ASCII are one sign, as the SQL side counts bytes."""
    b = T(spark, d, "benchmark").withColumn("text", F.regexp_replace("text", r"[^\x00-\x7F]", "?"))
    a, t = F.col("a_text"), F.col("b_text")
    p = b.select(F.col("item_id").alias("a"), F.col("text").alias("a_text"), (F.col("item_id") % 10).alias("k")).join(b.select(F.col("item_id").alias("b"), F.col("text").alias("b_text"), (F.col("item_id") % 10).alias("k")), "k")
    return p.select("a", "b", F.levenshtein(a, t).alias("d"), F.round(text.char_error_rate(a, t), 6).alias("cer"))


@query()
def fuzzy_best(spark, d):
    """Each benchmark item's first word with the document source word it is most like; indel similarity has no SQL."""
    w = lambda c: F.element_at(F.split(F.trim(c), r"\s+"), 1)
    left = T(spark, d, "benchmark").select("item_id", w("text").alias("word"))
    right = T(spark, d, "conversations").select(w("text").alias("other")).distinct()
    return fuzzy.fuzzy_best(left, right, "word", "other", cutoff=60.0)


@query("""
SELECT a.p_partkey AS a, b.p_partkey AS b, list_sort(list_distinct(string_split(upper(a.p_name), ' '))) = list_sort(list_distinct(string_split(upper(b.p_name), ' '))) AS same
FROM part a JOIN part b ON a.p_size = b.p_size AND a.p_brand = b.p_brand AND a.p_partkey <= b.p_partkey""")
def set_equal(spark, d):
    return evaluate.set_equal_pairs(T(spark, d, "part"), "p_partkey", "p_name", ["p_size", "p_brand"])


@query("""
WITH p AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE (c_custkey || '+' || c_custkey + 1 || '+' || c_custkey + 2) END AS parcels, CASE c_custkey % 4 WHEN 0 THEN '7' WHEN 1 THEN '1+2+3' ELSE '8+9' END AS sheets FROM customer),
s AS (SELECT *, string_split(parcels, '+') AS ps, string_split(sheets, '+') AS ss FROM p)
SELECT c_custkey, CAST(i AS INTEGER) AS parcel_no, ps[i] AS so_thua, CASE WHEN len(ps) = 1 THEN sheets WHEN len(ss) = len(ps) THEN ss[i] WHEN len(ss) = 1 THEN ss[1] ELSE '' END AS to_ban_do FROM s, unnest(range(1, len(ps) + 1)) t(i)""")
def split_zip_broadcast(spark, d):
    k = F.col("c_custkey")
    s = lambda n: (k + n).cast("string")
    docs = T(spark, d, "customer").select("c_custkey", F.when(k % 3 == 0, s(0)).otherwise(F.concat_ws("+", s(0), s(1), s(2))).alias("so_thua"), F.when(k % 4 == 0, "7").when(k % 4 == 1, "1+2+3").otherwise("8+9").alias("to_ban_do"))
    return expand.expand_parcels(docs, "so_thua", ["to_ban_do"])


@query(r"""
SELECT page_id, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS INTEGER) AS links FROM pages""")
def html_kv_parse(spark, d):
    return T(spark, d, "pages").select("page_id", F.regexp_extract("html", r'<html lang="([a-z]+)"', 1).alias("lang"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), 1)).alias("links"))


@query("""
SELECT conv_id, '# ' || conv_id || chr(10) || string_agg('## ' || role || ' ' || turn || chr(10) || text, chr(10) ORDER BY turn, role, text) AS markdown FROM conversations GROUP BY 1""")
def document_markdown(spark, d):
    """A document of titled blocks, in order."""
    return rendering.blocks_markdown(T(spark, d, "conversations"), "conv_id", F.concat_ws(" ", F.col("role"), F.col("turn").cast("string")), F.col("text"), ["turn", "role", "text"])


@query("""
SELECT doc_id, CASE WHEN k = 1 THEN n || '.pdf' ELSE n || '__' || k || '.pdf' END AS destination
FROM (SELECT doc_id, n, row_number() OVER (PARTITION BY lang, lower(n) ORDER BY doc_id) AS k FROM (SELECT doc_id, lang, CASE WHEN doc_id % 2 = 0 THEN source ELSE upper(source) END AS n FROM documents))""")
def rename_manifest(spark, d):
    n = F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(F.upper("source"))
    names = T(spark, d, "documents").select("doc_id", "lang", F.concat(n, F.lit(".pdf")).alias("name"))
    return unique_destinations(names, "lang", "name", F.col("doc_id")).select("doc_id", "destination")


@query("""
SELECT event_id, strftime(ts + INTERVAL 7 HOUR, '%d/%m/%Y %H:%M:%S') AS shown FROM events""")
def format_vn_datetime(spark, d):
    return T(spark, d, "events").select("event_id", text.vietnam_time(F.col("ts").cast("timestamp")).alias("shown"))


@query("""
SELECT doc_id, sha256(doc_id || '|' || source) AS full_hash, left(sha256(doc_id || '|' || source), 24) AS short_hash FROM documents""")
def salted_key(spark, d):
    h = F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("source")), 256)
    return T(spark, d, "documents").select("doc_id", h.alias("full_hash"), F.substring(h, 1, 24).alias("short_hash"))


def _checked(spark, d, kind, value):
    k = T(spark, d, "customer").withColumn("v", value)
    return k.select("c_custkey", validators.ALL[kind](F.col("v")).alias("r")).select("c_custkey", "r.ok", "r.value", "r.reason")


K = F.col


def _pick(*values):
    out = F.when(K("c_custkey") % len(values) == 0, values[0])
    for i, v in enumerate(values[1:], 1):
        out = out.when(K("c_custkey") % len(values) == i, v)
    return out


def _key(n):
    return F.lpad(K("c_custkey").cast("string"), n, "0")


@query("""
WITH t AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN lpad(c_custkey::VARCHAR, 12, '0') WHEN 1 THEN 'CMND ' || lpad(c_custkey::VARCHAR, 9, '1') WHEN 2 THEN '19' || lpad((c_custkey % 100)::VARCHAR, 2, '0') WHEN 3 THEN '' ELSE c_name END AS t FROM customer), u AS (SELECT *, regexp_replace(t, '[^0-9]', '', 'g') AS g FROM t)
SELECT c_custkey, t <> '' AND length(g) IN (9, 12) AS ok, CASE WHEN t = '' THEN NULL WHEN length(g) IN (4, 9, 12) THEN g ELSE t END AS value, CASE WHEN t = '' THEN 'empty' WHEN length(g) = 4 THEN 'year' WHEN length(g) NOT IN (9, 12) THEN 'malformed' END AS reason FROM u""")
def validators_identity(spark, d):
    return _checked(spark, d, "identity", _pick(_key(12), F.concat(F.lit("CMND "), F.lpad(K("c_custkey").cast("string"), 9, "1")), F.concat(F.lit("19"), F.lpad((K("c_custkey") % 100).cast("string"), 2, "0")), F.lit(""), K("c_name")))


@query("""
WITH t AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN lpad(c_custkey::VARCHAR, 13, '8') WHEN 1 THEN lpad(c_custkey::VARCHAR, 15, '8') || ' .' WHEN 2 THEN lpad(c_custkey::VARCHAR, 12, '8') ELSE '  ' END AS t FROM customer), u AS (SELECT c_custkey, trim(t) AS t, regexp_replace(t, '[^0-9]', '', 'g') AS g FROM t)
SELECT c_custkey, length(g) BETWEEN 13 AND 15 AS ok, CASE WHEN t = '' THEN NULL WHEN length(g) BETWEEN 13 AND 15 THEN g ELSE t END AS value, CASE WHEN t = '' THEN 'empty' WHEN NOT length(g) BETWEEN 13 AND 15 THEN 'malformed' END AS reason FROM u""")
def validators_barcode(spark, d):
    n = lambda k: F.lpad(K("c_custkey").cast("string"), k, "8")
    return _checked(spark, d, "barcode", _pick(n(13), F.concat(n(15), F.lit(" .")), n(12), F.lit("  ")))


@query("""
WITH t AS (SELECT c_custkey, c_custkey % 31 + 1 AS dd, c_custkey % 14 + 1 AS mm, 1940 + c_custkey % 90 AS yy FROM customer),
u AS (SELECT *, CASE c_custkey % 3 WHEN 0 THEN dd || '/' || mm || '/' || yy WHEN 1 THEN 'ngày ' || dd || ' tháng ' || mm || ' năm ' || yy ELSE dd || '-' || mm || '.' || yy END AS t, try_strptime(lpad(dd::VARCHAR, 2, '0') || '/' || lpad(mm::VARCHAR, 2, '0') || '/' || yy, '%d/%m/%Y') AS x FROM t)
SELECT c_custkey, x IS NOT NULL AND yy BETWEEN 1950 AND 2026 AS ok, CASE WHEN x IS NOT NULL AND yy BETWEEN 1950 AND 2026 THEN strftime(x, '%d/%m/%Y') ELSE t END AS value, CASE WHEN x IS NULL THEN 'calendar' WHEN NOT yy BETWEEN 1950 AND 2026 THEN 'year' END AS reason FROM u""")
def validators_date(spark, d):
    s = lambda c: c.cast("string")
    dd, mm, yy = s(K("c_custkey") % 31 + 1), s(K("c_custkey") % 14 + 1), s(1940 + K("c_custkey") % 90)
    return _checked(spark, d, "date", _pick(F.concat_ws("/", dd, mm, yy), F.concat(F.lit("ngày "), dd, F.lit(" tháng "), mm, F.lit(" năm "), yy), F.concat(dd, F.lit("-"), mm, F.lit("."), yy)))


@query("""
WITH t AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 500 WHEN 1 THEN 2001 WHEN 2 THEN 1000 WHEN 3 THEN 1234 WHEN 4 THEN 25000 ELSE 198 END AS n FROM customer)
SELECT c_custkey, n IN (500, 1000, 25000) AS ok, '1:' || n AS value, CASE WHEN n IN (2001, 198) THEN 'suspect' WHEN n = 1234 THEN 'nonstandard' END AS reason FROM t""")
def validators_scale(spark, d):
    return _checked(spark, d, "scale", _pick(F.lit("Tỷ lệ: 1/500"), F.lit("1/2001"), F.lit("1:1000"), F.lit("TL 1:1234"), F.lit("1/25000"), F.lit("1:198")))


@query("""
WITH t AS (SELECT c_custkey, round(c_acctbal, 2) AS a FROM customer)
SELECT c_custkey, a >= 0.5 AS ok, CASE WHEN a >= 0.5 THEN CAST(a AS VARCHAR) WHEN a > 0 THEN CAST(a AS VARCHAR) END AS value, CASE WHEN a < 0 THEN 'negative' WHEN a = 0 THEN 'not positive' WHEN a < 0.5 THEN 'small' END AS reason FROM t""")
def validators_area(spark, d):
    return _checked(spark, d, "area", F.concat(F.regexp_replace(F.round("c_acctbal", 2).cast("string"), r"\.", ","), F.lit(" m2")))


@query("""
SELECT c_custkey, c_custkey % 5 < 3 AS ok, CASE c_custkey % 5 WHEN 0 THEN c_custkey::VARCHAR WHEN 1 THEN c_custkey || '+' || c_custkey + 1 WHEN 2 THEN c_custkey || 'B' WHEN 3 THEN c_custkey || ' thửa' ELSE 'Mục đích ' || c_custkey END AS value,
  CASE c_custkey % 5 WHEN 3 THEN 'total' WHEN 4 THEN 'heading' END AS reason FROM customer""")
def validators_parcel(spark, d):
    k = K("c_custkey").cast("string")
    return _checked(spark, d, "parcel", _pick(F.concat(F.lit("Thửa đất số: "), k, F.lit(".")), F.concat(k, F.lit(", "), (K("c_custkey") + 1).cast("string")), F.concat(k, F.lit("b, tờ bản đồ số: 4")), F.concat(k, F.lit(" thửa")), F.concat(F.lit("Mục đích "), k)))


@query("""
SELECT c_custkey, c_custkey % 4 < 3 AS ok, CASE c_custkey % 4 WHEN 0 THEN c_custkey::VARCHAR WHEN 1 THEN c_custkey || '+98' WHEN 2 THEN c_custkey::VARCHAR ELSE 'Tổng số ' || c_custkey END AS value, CASE WHEN c_custkey % 4 = 3 THEN 'heading' END AS reason FROM customer""")
def validators_map_sheet(spark, d):
    k = K("c_custkey").cast("string")
    return _checked(spark, d, "map_sheet", _pick(F.concat(F.lit("00"), k), F.concat(k, F.lit(", 98")), F.concat(F.lit("Tờ bản đồ số: "), k), F.concat(F.lit("Tổng số "), k)))


@query("""
SELECT c_custkey, c_custkey % 4 <> 3 AS ok, CASE c_custkey % 4 WHEN 0 THEN 'HNK+LUC' WHEN 1 THEN 'ODT' WHEN 2 THEN 'CLN' ELSE 'XYZ UNKNOWN' END AS value, CASE WHEN c_custkey % 4 = 3 THEN 'unknown code' END AS reason FROM customer""")
def validators_land_code(spark, d):
    return _checked(spark, d, "land_code", _pick(F.lit("HNK, LUC, HNK"), F.lit("odt"), F.lit("dat trong cay (CLN) va LUC"), F.lit("XYZ unknown")))


@query("""
SELECT c_custkey, c_custkey % 4 < 2 AS ok, CASE c_custkey % 4 WHEN 0 THEN 'Nguyễn Văn A' || c_custkey WHEN 1 THEN 'Trần Thị B' WHEN 2 THEN 'Một' ELSE 'UBND huyện ' || c_custkey END AS value, CASE c_custkey % 4 WHEN 2 THEN 'one word' WHEN 3 THEN 'agency' END AS reason FROM customer""")
def validators_person(spark, d):
    k = K("c_custkey").cast("string")
    return _checked(spark, d, "person", _pick(F.concat(F.lit("Ông: NGUYỄN VĂN A"), k), F.lit("hộ bà trần  thị b"), F.lit("Một"), F.concat(F.lit("UBND huyện "), k)))


@query("""
WITH t AS (SELECT c_custkey, lpad(c_custkey::VARCHAR, 6, '4') AS s FROM customer)
SELECT c_custkey, c_custkey % 5 < 3 AS ok, CASE c_custkey % 5 WHEN 0 THEN 'BP ' || s WHEN 1 THEN 'DO ' || s WHEN 2 THEN 'BP ' || s WHEN 3 THEN 'TP ' || s ELSE 'ABC 1234' END AS value, CASE WHEN c_custkey % 5 >= 3 THEN 'malformed' END AS reason FROM t""")
def validators_serial(spark, d):
    s = F.lpad(K("c_custkey").cast("string"), 6, "4")
    return _checked(spark, d, "serial", _pick(F.concat(F.lit("BP."), s), F.concat(F.lit("Số phát hành: D0 "), s), F.concat(F.lit("bp "), s, F.lit("3")), F.concat(F.lit("TP "), s), F.lit("ABC 1234")))


@query("""
WITH t AS (SELECT c_custkey, lpad((c_custkey + 1)::VARCHAR, 5, '0') AS s FROM customer)
SELECT c_custkey, c_custkey % 4 < 3 AS ok, CASE c_custkey % 4 WHEN 0 THEN 'CH' || s WHEN 1 THEN 'CS' || s || '/TNH' WHEN 2 THEN '12' || s ELSE NULL END AS value, CASE WHEN c_custkey % 4 = 3 THEN 'noise' END AS reason FROM t""")
def validators_registry(spark, d):
    s = F.lpad((K("c_custkey") + 1).cast("string"), 5, "0")
    return _checked(spark, d, "registry", _pick(F.concat(F.lit("Số vào sổ cấp GCN: CH "), s), F.concat(F.lit("C.S"), s, F.lit("/tnh")), F.concat(F.lit("12"), s), F.concat(F.lit("diện tích "), s)))


@query("""
WITH t AS (SELECT o_orderkey, round(o_totalprice, 2) AS g, CASE WHEN o_orderkey % 3 = 0 THEN round(o_totalprice, 2) WHEN o_orderkey % 3 = 1 THEN NULL ELSE round(o_totalprice, 2) + 9 END AS p FROM orders)
SELECT o_orderkey, o_orderkey % 3 < 2 AS ok, g AS granted, round(coalesce(p, g), 2) AS private, CAST(0 AS DOUBLE) AS shared, CASE WHEN o_orderkey % 3 = 2 THEN 'balance' END AS reason FROM t""")
def validators_area_balance(spark, d):
    g = F.round("o_totalprice", 2)
    k = F.col("o_orderkey") % 3
    p = F.when(k == 0, g).when(k == 2, g + 9)
    return T(spark, d, "orders").select("o_orderkey", validators.v_area_balance(g, p, F.lit(None)).alias("r")).select("o_orderkey", "r.*")


@query("""
SELECT c_custkey, c_custkey % 4 < 3 AS ok, CASE c_custkey % 4 WHEN 0 THEN 'Lâu dài' WHEN 1 THEN 'Đến 06/2018+Đến 12/2031' WHEN 2 THEN 'Đến 01/2040' ELSE 'sử dụng' END AS value, CASE WHEN c_custkey % 4 = 3 THEN 'malformed' END AS reason FROM customer""")
def validators_term(spark, d):
    return _checked(spark, d, "term", _pick(F.lit("lâu dài"), F.lit("Đến 06/2018, Đến 12/2031, Đến 06/2018"), F.lit("01/2040"), F.lit("sử dụng")))


@query("""
SELECT c_custkey, c_custkey % 4 < 3 AS ok, CASE c_custkey % 4 WHEN 0 THEN 'Công nhận QSDĐ như giao đất không thu tiền sử dụng đất' WHEN 1 THEN 'Nhận chuyển nhượng quyền sử dụng đất' WHEN 2 THEN 'Được tặng cho quyền sử dụng đất' END AS value,
  CASE c_custkey % 4 WHEN 0 THEN 'CNQ-KTT' WHEN 1 THEN 'NCN' WHEN 2 THEN 'TC' END AS code, CASE WHEN c_custkey % 4 = 3 THEN 'heading' END AS reason FROM customer""")
def validators_origin(spark, d):
    v = _pick(F.lit("Công nhận QSDĐ như giao đất không thu tiền Đến 12/2031"), F.lit("nhận chuyển nhượng"), F.lit("Được tặng cho QSDĐ"), F.lit("Nguồn gốc sử dụng"))
    return T(spark, d, "customer").select("c_custkey", validators.v_origin(v).alias("r")).select("c_custkey", "r.*")


@query("""
SELECT c_custkey, c_custkey % 3 < 2 AS ok, CASE c_custkey % 3 WHEN 0 THEN 'Đất ở tại nông thôn' WHEN 1 THEN 'Đất bằng trồng cây hàng năm khác, Đất chuyên trồng lúa nước' ELSE 'Diện tích' END AS value, CASE c_custkey % 3 WHEN 0 THEN 'ONT' WHEN 1 THEN 'HNK+LUC' END AS code, CASE WHEN c_custkey % 3 = 2 THEN 'heading' END AS reason FROM customer""")
def validators_purpose(spark, d):
    v = _pick(F.lit("Đất ở tại nông thôn"), F.lit("Đất bằng trồng cây hàng năm khác; đất chuyên trồng lúa nước"), F.lit("Diện tích"))
    return T(spark, d, "customer").select("c_custkey", validators.v_purpose(v).alias("r")).select("c_custkey", "r.*")

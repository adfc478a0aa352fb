"""Merging, expansion, review and parsing operators on the driver's tables; documents are made from keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelforge.functions import parsers, text, validators
from parcelforge.operators import changes, evaluate, expand, merge, pages, registration, review, store
from parcelforge.plans.registry import query, table
from parcelforge.sources import dossiers

T = table


def key():
    return F.col("c_custkey")


def pick(*values):
    """The value whose place is the key modulo their number."""
    out = F.when(key() % len(values) == 0, values[0])
    for i, x in enumerate(values[1:], 1):
        out = out.when(key() % len(values) == i, x)
    return out


@query("""
SELECT c_custkey, round(CAST(CASE WHEN c_custkey % 3 = 0 THEN c_custkey * 1000 + 0.5 WHEN c_custkey % 3 = 1 THEN c_custkey + 0.25 ELSE c_custkey * 1000 END AS DOUBLE), 2) AS value, CASE WHEN c_custkey % 2 = 0 THEN 'm²' END AS unit FROM customer""")
def parse_area_string(spark, d):
    """Areas of every key, its digits grouped by thousands with points or with commas."""
    american = F.format_number(key(), 0)
    european, unit = F.translate(american, ",", "."), F.when(key() % 2 == 0, " m²").otherwise("")
    t = F.concat(pick(F.concat(european, F.lit(".000,5")), F.concat(european, F.lit(",25")), F.concat(american, F.lit(",000"))), unit)
    return T(spark, d, "customer").select("c_custkey", parsers.parse_area_text(t).alias("a")).select("c_custkey", F.round("a.value", 2).alias("value"), "a.unit")


@query("""
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '19' WHEN 1 THEN '19' WHEN 2 THEN '20' END || CASE WHEN c_custkey % 4 < 3 THEN lpad((c_custkey % 100)::VARCHAR, 2, '0') END AS birth FROM customer""")
def infer_birth_from_id(spark, d):
    n = F.concat(F.lit("001"), (key() % 4).cast("string"), F.lpad((key() % 100).cast("string"), 2, "0"), F.lit("000123"))
    return T(spark, d, "customer").select("c_custkey", merge.birth_from_identity(pick(n, n, n, F.substring(n, 1, 9))).alias("birth"))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'BP ' || lpad(c_custkey::VARCHAR, 6, '4') END AS serial FROM customer""")
def serial_from_filename(spark, d):
    s = F.lpad(key().cast("string"), 6, "4")
    return T(spark, d, "customer").select("c_custkey", merge.serial_from_name(pick(F.concat(F.lit("scan_bp-"), s, F.lit(".pdf")), F.concat(F.lit("XBP"), s), F.concat(F.lit("BP"), s, F.lit("9")))).alias("serial"))


@query("""
WITH t AS (SELECT c_custkey, 'BP ' || lpad(c_custkey::VARCHAR, 6, '4') AS f, 'BP ' || lpad((c_custkey + 1)::VARCHAR, 6, '4') AS o, lpad(c_custkey::VARCHAR, 6, '4') AS n FROM customer)
SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN f WHEN 1 THEN f WHEN 2 THEN f WHEN 3 THEN o END AS value, CAST(CASE c_custkey % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.95 WHEN 2 THEN 0.85 WHEN 3 THEN 0.8 ELSE 0 END AS DOUBLE) AS confidence FROM t""")
def cross_validate_serial(spark, d):
    n, m = F.lpad(key().cast("string"), 6, "4"), F.lpad((key() + 1).cast("string"), 6, "4")
    own, other, file = F.concat(F.lit("BP "), n), F.concat(F.lit("BP "), m), F.concat(F.lit("BP"), n, F.lit(".pdf"))
    none = F.lit(None).cast("string")
    r = merge.cross_validate_serial(pick(own, other, other, other, none), pick(file, file, file, F.lit("scan.pdf"), F.lit("scan.pdf")), pick(none, F.concat(F.lit("99"), n), F.lit("0"), none, none))
    return T(spark, d, "customer").select("c_custkey", r.alias("r")).select("c_custkey", "r.value", "r.confidence")


@query("""
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '12' WHEN 1 THEN '12' WHEN 2 THEN 'a' ELSE 'b' END AS value, CASE c_custkey % 4 WHEN 0 THEN 'not_available' WHEN 1 THEN 'filled_from_path' WHEN 2 THEN 'matched' ELSE 'mismatch' END AS status FROM customer""")
def path_hint_cross_check(spark, d):
    r = merge.path_hint_check(pick(F.lit("12"), F.lit("-"), F.lit("a"), F.lit("b")), pick(F.lit(""), F.lit("12"), F.lit(" A"), F.lit("c")))
    return T(spark, d, "customer").select("c_custkey", r.alias("r")).select("c_custkey", "r.value", "r.status")


@query("""
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'missing' WHEN event_id % 3 = 0 OR (event_id % 100) / 100.0 < 0.6 THEN 'needs_review' WHEN event_id % 5 = 0 THEN 'no_evidence' ELSE 'ready' END AS status FROM events""")
def review_status(spark, d):
    e = F.col("event_id")
    s = review.review_status(F.when(e % 4 == 0, "-").otherwise("x"), e % 3 == 0, (e % 100) / 100, e % 5 != 0)
    return T(spark, d, "events").select("event_id", s.alias("status"))


@query("""
WITH h AS (SELECT conv_id, list(DISTINCT role ORDER BY role) AS hs FROM conversations GROUP BY 1)
SELECT conv_id, CAST(i AS INTEGER) AS heir_no, hs[i] AS owner, CASE WHEN hs[i] <> 'user' THEN 'user' END AS companion FROM h, unnest(range(1, len(hs) + 1)) t(i)""")
def expand_heirs(spark, d):
    """Speakers as heirs of the user."""
    h = T(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_set("role")), lambda r: F.struct(r.alias("ho_ten"))).alias("heirs"))
    rows = h.withColumns({"owner": F.lit("user"), "companion": F.lit(None).cast("string")})
    return expand.expand_heirs(rows, "heirs", "owner", "companion").select("conv_id", "heir_no", "owner", "companion")


@query("""
WITH e AS (SELECT user_id, event_id, ts, CASE WHEN event_id % 4 = 0 THEN event_type END AS v FROM events), f AS (
  SELECT user_id, event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS b, first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM e)
SELECT user_id, event_id, coalesce(b, a) AS v FROM f""")
def carry_sheet(spark, d):
    e = T(spark, d, "events").select("user_id", "event_id", "ts", F.when(F.col("event_id") % 4 == 0, F.col("event_type")).otherwise(" ").alias("v"))
    return expand.carry_forward(e, ["user_id"], ["ts", "event_id"], "v").select("user_id", "event_id", "v")


@query("SELECT o_orderkey, CASE WHEN o_custkey % 13 > 5 AND o_orderkey % 7 > 0 THEN round((o_orderkey % 7) / ((o_custkey % 13) / 60.0), 1) END AS rate, left(o_orderpriority, 3) AS cut FROM orders")
def progress_metrics(spark, d):
    n, s = (F.col("o_orderkey") % 7).cast("double"), (F.col("o_custkey") % 13).cast("double")
    return T(spark, d, "orders").select("o_orderkey", store.files_per_minute(n, s).alias("rate"), store.bounded_text(F.col("o_orderpriority"), 3).alias("cut"))


@query("""
SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'release' WHEN 1 THEN 'mortgage' WHEN 2 THEN 'transfer' WHEN 3 THEN 'correction' ELSE 'other' END AS kind,
  CASE c_custkey % 5 WHEN 2 THEN '123456.CN.' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') END AS file_no, CASE c_custkey % 5 WHEN 2 THEN 'Trần Văn Bình' END AS new_owner FROM customer""")
def parse_endorsements(spark, d):
    file = F.concat(F.lit("Chuyển nhượng cho ông Trần Văn Bình, hồ sơ 123456.CN."), F.lpad((key() % 1000).cast("string"), 3, "0"))
    t = T(spark, d, "customer").select("c_custkey", pick(F.lit("Xóa đăng ký thế chấp"), F.lit("Thế chấp tại ngân hàng"), file, F.lit("Đính chính năm sinh"), F.lit("khác")).alias("text"))
    return changes.parse_endorsements(t).select("c_custkey", "kind", "file_no", "new_owner")


@query("SELECT doc_id, CAST(len(list_distinct(list_filter(regexp_extract_all(text, '[0-9]+'), lambda x: len(x) IN (9, 12)))) AS INTEGER) AS n FROM documents")
def extract_identity_numbers(spark, d):
    """Numbers of every text; the SQL side takes whole runs of digits by their length, so it needs no look-around."""
    return T(spark, d, "documents").select("doc_id", F.size(parsers.identity_numbers(F.col("text"))).alias("n"))


@query("""
WITH f AS (SELECT lpad((doc_id % 300)::VARCHAR, 3, '0') AS id, CASE doc_id % 3 WHEN 0 THEN 'GCN' WHEN 1 THEN 'GT' ELSE 'ONE' END AS kind FROM documents)
SELECT id AS pair_id, CASE WHEN NOT bool_or(kind = 'GT') THEN 'gcn_only' WHEN NOT bool_or(kind = 'GCN') THEN 'gt_only' ELSE 'both' END AS status FROM f GROUP BY 1""")
def scan_pairs(spark, d):
    i = F.lpad((F.col("doc_id") % 300).cast("string"), 3, "0")
    end = F.when(F.col("doc_id") % 3 == 0, "-GCN").when(F.col("doc_id") % 3 == 1, "_gt").otherwise("")
    return dossiers.scan_pairs(T(spark, d, "documents").select(F.concat(F.lit("/p/"), i, end, F.lit(".pdf")).alias("path"))).select("pair_id", "status")


@query("""
SELECT c_custkey % 50 AS folder, CASE WHEN bool_or(c_custkey % 4 = 0) THEN 'name' WHEN bool_or(c_custkey % 4 = 2) THEN 'landscape' ELSE 'skipped' END AS how, count(*) AS files FROM customer GROUP BY 1""")
def scan_dossiers(spark, d):
    name = pick(F.lit(" gcn"), F.lit(" x"), F.lit(" y"), F.lit(" z"))
    files = T(spark, d, "customer").select(F.concat((key() % 50).cast("string"), F.lit("/"), key().cast("string"), name, F.lit(".pdf")).alias("path"), (key() % 4 == 2).alias("landscape"))
    return dossiers.select_dossier_files(files).select(F.col("folder").cast("long").alias("folder"), "how", "files")


@query("""
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '12' END AS sheet, CAST(doc_id AS VARCHAR) AS parcel, CASE WHEN doc_id % 3 = 0 THEN 'Nguyễn A' END AS owner FROM documents""")
def path_hints(spark, d):
    p = F.concat(F.lit("/x/"), F.when(F.col("doc_id") % 2 == 0, "Tờ 12/").otherwise("khac/"), F.lit("Thửa "), F.col("doc_id").cast("string"), F.lit("/"), F.when(F.col("doc_id") % 3 == 0, "Nguyễn A/f.pdf").otherwise("f.pdf"))
    return T(spark, d, "documents").select("doc_id", dossiers.path_hints(p).alias("h")).select("doc_id", "h.sheet", "h.parcel", "h.owner")


@query("""
WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey::VARCHAR END AS k0, (o_orderkey % 25)::VARCHAR AS k1, abs(o_orderkey % 100)::VARCHAR AS name FROM orders),
c AS (SELECT c_custkey, c_custkey::VARCHAR AS k0, c_nationkey::VARCHAR AS k1, nullif(regexp_replace(replace(strip_accents(lower(regexp_replace(trim(c_name), '^(ông|ong|bà|ba)\\s*[:.]?\\s*', '', 'i'))), 'đ', 'd'), '[^a-z0-9]', '', 'g'), '') AS name FROM customer WHERE c_custkey IS NOT NULL),
held AS (SELECT c_custkey, name, 0 AS step, k0 AS k FROM c UNION ALL SELECT c_custkey, name, 1, k1 FROM c WHERE k1 IS NOT NULL),
l AS (SELECT o.*, CASE WHEN k0 IN (SELECT k FROM held WHERE step = 0) THEN 0 WHEN k1 IN (SELECT k FROM held WHERE step = 1) THEN 1 ELSE 2 END AS by_key FROM o),
near AS (SELECT k0, arg_min(k, place) AS k FROM (SELECT DISTINCT k0 FROM l WHERE by_key = 2 AND k0 IS NOT NULL) JOIN (SELECT k, min((c_custkey, step)) AS place FROM held WHERE length(k) >= 4 GROUP BY k) ON contains(k0, k) OR contains(k, k0) GROUP BY k0),
a AS (SELECT o_orderkey, l.name, by_key, CASE by_key WHEN 0 THEN l.k0 WHEN 1 THEN k1 ELSE near.k END AS k FROM l LEFT JOIN near ON by_key = 2 AND l.k0 = near.k0),
hit AS (SELECT a.by_key, a.k, a.name, coalesce(min(c_custkey) FILTER (contains(a.name, h.name) OR contains(h.name, a.name)), min(c_custkey)) AS c_custkey FROM (SELECT DISTINCT by_key, k, name FROM a) a JOIN (SELECT * FROM held UNION ALL SELECT c_custkey, name, 2, k FROM held) h ON a.by_key = h.step AND a.k = h.k GROUP BY ALL)
SELECT o_orderkey, c_custkey, by_key FROM a JOIN hit USING (by_key, k, name)""")
def ground_truth_lookup(spark, d):
    """By a first key where there is one, else by a second, else by a key that contains the first or is in it; of several truths the one with the row's name, here two digits of its key."""
    s = lambda c: c.cast("string")
    keys = [(F.when(F.col("o_orderkey") % 3 == 0, s(F.col("o_custkey"))), s(key())), (s(F.col("o_orderkey") % 25), s(F.col("c_nationkey")))]
    names = F.concat(F.lit("Bà "), s(F.col("o_orderkey") % 100)), F.col("c_name")
    return evaluate.lookup_with_fallback(T(spark, d, "orders"), T(spark, d, "customer"), keys, "o_orderkey", "c_custkey", names)


@query("""
WITH a AS (SELECT c_mktsegment AS field_key, round(avg(c_custkey), 2) AS x FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1), b AS (SELECT c_mktsegment AS field_key, round(avg(c_custkey), 2) AS y FROM customer GROUP BY 1)
SELECT field_key, x AS before, y AS after, round(y - x, 2) AS delta FROM a FULL JOIN b USING (field_key)""")
def ab_compare(spark, d):
    c = T(spark, d, "customer").withColumnRenamed("c_mktsegment", "field_key")
    rate = F.round(F.avg("c_custkey"), 2).alias("accuracy")
    return evaluate.ab_compare(c.where("c_custkey % 2 = 0").groupBy("field_key").agg(rate), c.groupBy("field_key").agg(rate))


@query("""
SELECT p_partkey, CASE WHEN w / h > 1.25 THEN i ELSE 0 END AS half, CASE WHEN w / h > 1.25 AND i = 1 THEN w / 2 - 5 ELSE 0 END AS x_from, CASE WHEN w / h > 1.25 AND i = 0 THEN w / 2 + 5 ELSE w END AS x_to
FROM (SELECT p_partkey, CAST(p_size * 40 AS DOUBLE) AS w, CAST(1000 AS DOUBLE) AS h FROM part), (VALUES (0), (1)) v(i) WHERE i = 0 OR w / h > 1.25""")
def split_a3(spark, d):
    p = T(spark, d, "part").select("p_partkey", (F.col("p_size") * 40).cast("double").alias("width"), F.lit(1000.0).alias("height"))
    return pages.split_spread(p).select("p_partkey", "half", "x_from", "x_to")


@query("""
SELECT p_partkey, concat_ws(',', CASE WHEN p_size < 10 THEN 'blurry' END, CASE WHEN p_size * 6 < 50 THEN 'dark' END, CASE WHEN p_size * 6 > 220 THEN 'bright' END) AS faults FROM part""")
def image_quality(spark, d):
    s = F.col("p_size")
    return T(spark, d, "part").select("p_partkey", F.array_join(pages.image_quality(s * 5 + 1, s * 6), ",").alias("faults"))


@query("""
WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 3 > 0 THEN event_type END AS s FROM events)
SELECT user_id, event_id, coalesce(s, 'unknown_' || row_number() OVER (PARTITION BY user_id, s IS NULL ORDER BY event_id) - 1) AS group_id FROM e""")
def unknown_counter(spark, d):
    e = T(spark, d, "events").select(F.col("user_id").alias("batch_id"), F.col("event_id").alias("page_index"), F.when(F.col("event_id") % 3 > 0, F.col("event_type")).alias("serial"))
    return pages.fill_page_ids(e).select(F.col("batch_id").alias("user_id"), F.col("page_index").alias("event_id"), "group_id")


@query("""
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'soft' WHEN 1 THEN 'hard' ELSE 'soft' END AS alert_level, CAST(CASE c_custkey % 4 WHEN 2 THEN 9 ELSE CASE WHEN c_custkey % 4 IN (0, 3) THEN 10 ELSE 9 END END AS INTEGER) AS missing FROM customer""")
def registration_alerts(spark, d):
    """The layout's rows of documents that have a registry number only."""
    docs = T(spark, d, "customer").select(key().alias("doc_id"), pick(F.lit(""), F.lit("CN 123"), F.lit("CH 12345"), F.lit("-")).alias("so_vao_so"))
    rows = registration.with_alerts(registration.registration_rows(docs))
    return rows.select(F.col("doc_id").alias("c_custkey"), "alert_level", F.size("_missing_core").alias("missing"))


@query("""
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'supported' WHEN 1 THEN 'review_required' WHEN 2 THEN 'not_available' ELSE 'review_required' END AS status, CASE c_custkey % 4 WHEN 0 THEN 'digits_agree' WHEN 1 THEN 'digits_differ' WHEN 2 THEN 'no_reading' ELSE 'no_source' END AS reason FROM customer""")
def audit_id_crop(spark, d):
    n = F.lpad(key().cast("string"), 12, "0")
    r = parsers.audit_identity(pick(n, n, n, F.lit("")), F.array(pick(n, F.lit("123456789"), F.lit("12"), n), F.lit("x")))
    return T(spark, d, "customer").select("c_custkey", r.alias("r")).select("c_custkey", "r.status", "r.reason")


@query("""
SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_custkey % 2 = 0 THEN 'missing_so_thua' END, CASE WHEN c_custkey % 3 = 0 THEN 'invalid_to_ban_do' END, CASE WHEN round(c_acctbal, 2) < 0.5 THEN 'invalid_dien_tich' END, CASE WHEN c_custkey % 5 = 0 THEN 'missing_ma_muc_dich' END], lambda x: x IS NOT NULL), ',') AS reasons FROM customer""")
def parcel_quality(spark, d):
    r = expand.parcel_reasons(F.when(key() % 2 == 0, "-").otherwise(key().cast("string")), F.when(key() % 3 == 0, "abc").otherwise("05"), F.format_string("%.2f", F.col("c_acctbal").cast("double")), F.when(key() % 5 == 0, "").otherwise("ONT"))
    return T(spark, d, "customer").select("c_custkey", F.array_join(r, ",").alias("reasons"))

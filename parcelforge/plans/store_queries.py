"""Store queries bound to the driver's tables: orders as records, customers as batches, segments as projects, events as logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelforge.operators import evaluate, expand, store
from parcelforge.plans.registry import query, table

T = table


@query("""
WITH r AS (
  SELECT o.*, c.c_name, c.c_mktsegment FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  WHERE (c.c_mktsegment IN ('BUILDING', 'MACHINERY') OR (c.c_mktsegment = 'AUTOMOBILE' AND o.o_custkey % 7 = 3))
    AND (o.o_orderpriority ILIKE '%1%' OR c.c_name ILIKE '%1%')
)
SELECT o_orderkey, o_custkey, o_orderstatus, c_name, CAST(length(c_name) AS INTEGER) AS name_length, (SELECT count(*) FROM r) AS total
FROM r ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100""")
def records_scoped_page(spark, d):
    """A page of what a manager of two segments, who made some of a third's records, finds for '1', with the total."""
    batches = T(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    joined = T(spark, d, "orders").join(batches, "o_custkey", "left").withColumn("owner", F.when(F.col("o_custkey") % 7 == 3, "me").otherwise("other"))
    scope = store.Scope("me", managed=["BUILDING", "MACHINERY"], member=["AUTOMOBILE"])
    found = joined.where(store.scope_filter(scope, F.col("c_mktsegment"), F.col("owner"))).where(store.search_any([F.col("o_orderpriority"), F.col("c_name")], "1"))
    page = store.page(found, [F.desc("o_orderdate"), F.col("o_orderkey")], 50, 100)
    return page.select("o_orderkey", "o_custkey", "o_orderstatus", "c_name", F.length("c_name").alias("name_length")).join(F.broadcast(found.agg(F.count("*").alias("total"))))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE 1 = 0")
def records_scope_empty(spark, d):
    """A user without projects sees nothing."""
    return T(spark, d, "orders").where(store.scope_filter(store.Scope("nobody"), F.col("o_orderstatus"), F.col("o_orderpriority"))).select("o_orderkey", "o_custkey")


@query("SELECT count(*) AS total, count(*) FILTER (c_mktsegment IS NOT NULL) AS with_batch FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'")
def records_total(spark, d):
    q = store.RecordQuery(equal={"o_orderstatus": "F", "o_orderpriority": "all"})
    records = T(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    out = store.list_records(records, T(spark, d, "customer"), q, key="c_custkey", project="o_orderstatus", creator="o_orderpriority")
    return out.agg(F.count("*").alias("total"), F.count("c_mktsegment").alias("with_batch"))


@query("""
SELECT o_orderkey, c_custkey, c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal >= 100 AND c_acctbal <= 5000 AND o_orderpriority LIKE '%U%'""")
def records_batch_size(spark, d):
    """Bounds on the batch drop records without one."""
    records = T(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey").where(store.source_filter(F.col("o_orderstatus"), F.col("o_orderpriority"), "U"))
    q = store.RecordQuery(least_batch=100, most_batch=5000)
    return store.list_records(records, T(spark, d, "customer"), q, key="c_custkey", project="o_orderstatus", creator="o_orderpriority", batch_size="c_acctbal").select("o_orderkey", "c_custkey", "c_acctbal")


@query("SELECT coalesce(nullif(source, ''), lang, 'other') AS value, count(*) AS n, min(doc_id) AS first_at, max(doc_id) AS last_at FROM documents GROUP BY 1")
def filter_folders(spark, d):
    return store.facet(T(spark, d, "documents"), F.coalesce(F.nullif(F.col("source"), F.lit("")), F.col("lang"), F.lit("other")), F.col("doc_id"))


@query("SELECT source AS value, count(*) AS n FROM documents WHERE trim(source) <> '' GROUP BY 1")
def filter_sources(spark, d):
    return store.facet(T(spark, d, "documents"), F.col("source"), skip_empty=True)


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def newest_batches(spark, d):
    return store.page(T(spark, d, "orders"), [F.desc("o_orderdate"), F.col("o_orderkey")], 50).select("o_orderkey", "o_custkey")


@query("""
SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS success, count(*) FILTER (o_orderstatus = 'P') AS error, count(DISTINCT o_orderpriority) AS folders,
  (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING') AS batches FROM orders""")
def stats_overview(spark, d):
    return store.stats(T(spark, d, "orders"), T(spark, d, "customer").where("c_mktsegment = 'BUILDING'"), "o_orderstatus", "o_orderpriority", "F", "P")


@query("""
SELECT DISTINCT s_suppkey, coalesce(nullif(n_name, 'NATION_3'), r_name, 'none') AS region FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def projects_by_region(spark, d):
    """A project's region, or its creator's."""
    n = T(spark, d, "nation").join(T(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    out = T(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    own = F.when(F.col("n_name") == "NATION_3", "").otherwise(F.col("n_name"))
    return out.select("s_suppkey", store.effective_region(own, F.col("r_name"), "none").alias("region")).distinct()


@query("""
SELECT c_custkey, n_name, count(*) AS orders FROM customer JOIN orders ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'O' GROUP BY 1, 2""")
def projects_for_user(spark, d):
    o = T(spark, d, "orders").where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.count("*").alias("orders"))
    c = T(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"))
    return c.join(T(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name", "orders")


@query("""
SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1""")
def latest_per_key(spark, d):
    return store.latest_value(T(spark, d, "events"), ["user_id", "event_type"], ["event_id", "value"], ["ts", "event_id"])


@query("""
SELECT user_id, event_type, event_id, props FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 2""")
def latest_two_per_key(spark, d):
    """The last rows whole, by a window."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id", "event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    return T(spark, d, "events").withColumn("k", F.row_number().over(w)).where("k <= 2").select("user_id", "event_type", "event_id", "props")


@query("""
SELECT user_id, arg_max(event_type, struct_pack(ts, event_id)) AS event_type, arg_max(value, struct_pack(ts, event_id)) FILTER (event_type <> 'view') AS value, count(*) AS versions FROM events GROUP BY user_id""")
def upsert_coalesce(spark, d):
    """A chain of saves: the last type wins, the value stays where a save brings none (views bring none)."""
    e = T(spark, d, "events").withColumn("given", F.when(F.col("event_type") != "view", F.col("value")))
    out = store.coalescing_fold(e, ["user_id"], ["event_type", "given"], ["ts", "event_id"]).withColumnRenamed("given", "value")
    return out.join(e.groupBy("user_id").agg(F.count("*").alias("versions")), "user_id")


@query("""
WITH ch AS (SELECT o_custkey AS c_custkey, max(o_orderkey) AS k, arg_max(o_orderstatus, o_orderkey) AS seg FROM orders WHERE o_orderkey % 5 = 0 GROUP BY 1)
SELECT coalesce(c.c_custkey, ch.c_custkey) AS c_custkey, coalesce(ch.seg, c.c_mktsegment) AS c_mktsegment FROM customer c FULL JOIN ch USING (c_custkey)""")
def upsert_record(spark, d):
    c = T(spark, d, "customer").select("c_custkey", "c_mktsegment")
    changes = T(spark, d, "orders").where("o_orderkey % 5 = 0").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("c_mktsegment"), "o_orderkey")
    return store.upsert(c, changes, ["c_custkey"], ["o_orderkey"], ["c_mktsegment"])


@query("SELECT o_orderkey, nullif(o_orderstatus, 'O') AS status FROM orders WHERE nullif(o_orderstatus, 'O') IS DISTINCT FROM 'F'")
def retain_except(spark, d):
    o = T(spark, d, "orders").select("o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("O")).alias("status"))
    return store.retain_except(o, "status", "F")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def orphans_anti(spark, d):
    c = T(spark, d, "customer").select("c_custkey", "c_name")
    return store.orphans(c, T(spark, d, "orders").where("o_orderstatus = 'P'"), "c_custkey", "o_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def members_semi(spark, d):
    return store.id_in(T(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", T(spark, d, "orders").where("o_totalprice > 400000").select("o_custkey"))


@query("SELECT s_suppkey FROM supplier UNION SELECT p_partkey FROM part WHERE p_size = 7")
def insert_if_absent(spark, d):
    s = T(spark, d, "supplier").select("s_suppkey")
    return store.insert_if_absent(s, T(spark, d, "part").where("p_size = 7").select(F.col("p_partkey").alias("s_suppkey")), ["s_suppkey"])[0]


@query("""
SELECT coalesce(l.doc_id, x.doc_id) AS pair_id, CASE WHEN l.doc_id IS NULL THEN 'gcn_only' WHEN x.doc_id IS NULL THEN 'gt_only' ELSE 'both' END AS status
FROM (SELECT doc_id FROM labels WHERE doc_id % 3 <> 1) l FULL JOIN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0) x ON l.doc_id = x.doc_id""")
def pair_full_outer(spark, d):
    from parcelforge.sources.dossiers import pair_status

    a = T(spark, d, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("pair_id"))
    return pair_status(a, T(spark, d, "labels").where("doc_id % 3 <> 1").select(F.col("doc_id").alias("pair_id")), "pair_id")


@query("""
SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), d.lang) AS identity, CASE WHEN l.doc_id IS NOT NULL AND length(d.source) > 4 THEN d.source ELSE d.lang END AS address
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def enrich_precedence(spark, d):
    """An identity card's number wins over what a page has, its address only if it is longer."""
    from parcelforge.operators.merge import longer_wins

    out = T(spark, d, "documents").join(T(spark, d, "labels"), "doc_id", "left")
    card = F.when(F.col("quality").isNotNull() & (F.length("source") > 4), F.col("source"))
    return out.select("doc_id", F.coalesce(F.col("quality").cast("string"), "lang").alias("identity"), longer_wins(F.col("lang"), card).alias("address"))


@query("SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn, role) AS stt, length(text) AS n FROM conversations")
def explode_running_stt(spark, d):
    """Turns collected and exploded again, numbered over all conversations."""
    docs = T(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    rows = expand.explode_rows(docs, "turns").select("conv_id", "pos", "row.turn", F.length("row.text").cast("long").alias("n"))
    return expand.running_number(rows, ["conv_id", "pos"]).select("conv_id", "turn", F.col("stt").cast("long").alias("stt"), "n")


@query("""
WITH k AS (SELECT l_orderkey, l_partkey, l_suppkey, l_returnflag, min(l_linenumber) AS line FROM lineitem GROUP BY 1, 2, 3, 4)
SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY line, l_partkey, l_suppkey, l_returnflag) AS STT,
  'DON_' || row_number() OVER (PARTITION BY l_orderkey ORDER BY line, l_partkey, l_suppkey, l_returnflag) AS "DDK_maDon" FROM k""")
def dedup_identity_renumber(spark, d):
    lines = T(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", F.col("l_linenumber").alias("line"))
    first = expand.dedup_first(lines, ["l_orderkey"], ["l_partkey", "l_suppkey", "l_returnflag"], ["line"])
    out = expand.renumber_export(first, ["l_orderkey"], ["line", "l_partkey", "l_suppkey", "l_returnflag"])
    return out.withColumn("STT", F.col("STT").cast("long"))


@query("""
WITH s AS (SELECT l_orderkey, sum(round(l_extendedprice, 2)) AS x, count(*) AS n FROM lineitem GROUP BY 1)
SELECT o_orderkey, coalesce(n, 0) AS n_parts, CASE WHEN n IS NULL THEN 'no_parts' WHEN abs(x - o_totalprice) > greatest(0.5, 0.01 * o_totalprice) THEN 'mismatch' ELSE 'ok' END AS reason
FROM orders LEFT JOIN s ON o_orderkey = l_orderkey""")
def area_sum_quality(spark, d):
    parts = T(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return expand.area_quality(parts, T(spark, d, "orders"), "o_orderkey", F.round("l_extendedprice", 2), F.col("o_totalprice"))


@query("""
SELECT o_orderkey, count(l_orderkey) AS n_rows, CAST(o_custkey % 8 AS BIGINT) AS stated, count(l_orderkey) = o_custkey % 8 AS ok FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_custkey""")
def row_count_quality(spark, d):
    parts = T(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return expand.row_count_quality(parts, T(spark, d, "orders"), "o_orderkey", F.col("o_custkey") % 8)


_LONG = """
long AS (
  SELECT d.doc_id, f.field AS field_key, CASE f.field WHEN 'quality' THEN CAST(l.quality AS VARCHAR) WHEN 'toxic' THEN CAST(l.toxic AS VARCHAR) ELSE d.lang END AS truth,
    CASE f.field WHEN 'quality' THEN CASE WHEN d.n_chars > 500 THEN '1' WHEN d.n_chars > 60 THEN '0' END WHEN 'toxic' THEN CASE WHEN d.doc_id % 9 = 0 THEN '1' ELSE '0' END ELSE CASE WHEN d.doc_id % 11 = 0 THEN '' ELSE 'en' END END AS found,
    d.doc_id % 4 = 0 AS flagged
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id, (VALUES ('quality'), ('toxic'), ('lang')) f(field)
), judged AS (
  SELECT *, CASE WHEN truth IS NULL THEN 'not_applicable' WHEN found IS NULL OR found = '' THEN 'missing' WHEN truth = found THEN 'match' ELSE 'mismatch' END AS result FROM long
)"""


def _judged(spark, d):
    j = T(spark, d, "documents").join(T(spark, d, "labels"), "doc_id", "left")
    text = lambda c: F.col(c).cast("string")
    guess = F.when(F.col("n_chars") > 500, "1").when(F.col("n_chars") > 60, "0")
    fields = [("quality", text("quality"), guess), ("toxic", text("toxic"), F.when(F.col("doc_id") % 9 == 0, "1").otherwise("0")), ("lang", F.col("lang"), F.when(F.col("doc_id") % 11 == 0, "").otherwise("en"))]
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("field_key"), t.alias("truth"), f.alias("found")) for n, t, f in fields]))
    long = j.select("doc_id", (F.col("doc_id") % 4 == 0).alias("flagged"), rows.alias("r")).select("doc_id", "flagged", "r.*")
    match = evaluate.field_match("text", F.col("truth"), F.col("found"))
    return long.withColumn("result", evaluate.verdict(F.col("truth"), F.col("found"), match))


@query(f"""
WITH {_LONG}, g AS (
  SELECT field_key, count(*) FILTER (result <> 'not_applicable') AS applicable, count(*) FILTER (result IN ('match', 'mismatch')) AS has_value, count(*) FILTER (result = 'match') AS matches,
    count(*) FILTER (result IN ('mismatch', 'missing')) AS mismatches, count(*) FILTER (flagged) AS flagged_n, count(*) FILTER (flagged AND result IN ('mismatch', 'missing')) AS caught FROM judged GROUP BY 1)
SELECT *, round(100 * has_value / applicable, 2) AS coverage, round(100 * matches / applicable, 2) AS accuracy, round(100 * caught / mismatches, 2) AS catch_rate FROM g""")
def field_metrics(spark, d):
    return evaluate.field_metrics(_judged(spark, d))


@query(f"""
WITH {_LONG}, p AS (SELECT doc_id, bool_and(result IN ('match', 'not_applicable')) AS k FROM judged WHERE field_key IN ('quality', 'toxic') GROUP BY 1)
SELECT count(*) AS documents, count(*) FILTER (k) AS core_matches, round(100 * count(*) FILTER (k) / count(*), 2) AS core_rate FROM p""")
def core_match_rate(spark, d):
    return evaluate.core_match_rate(_judged(spark, d), "doc_id", ["quality", "toxic"])


@query("""
WITH a AS (SELECT c_custkey AS k, c_nationkey % 3 AS v FROM customer), b AS (SELECT o_custkey AS k, CAST(max(o_orderkey) % 3 AS INTEGER) AS v FROM orders GROUP BY 1), c AS (SELECT s_suppkey AS k, s_nationkey % 3 AS v FROM supplier),
j AS (SELECT k, a.v AS va, b.v AS vb, c.v AS vc FROM a FULL JOIN b USING (k) FULL JOIN c USING (k))
SELECT k, CASE WHEN va = vb AND vb = vc THEN 'all' WHEN va = vb THEN 'a_b' WHEN va = vc THEN 'a_c' WHEN vb = vc THEN 'b_c' ELSE 'none' END AS agree FROM j""")
def three_way(spark, d):
    a = T(spark, d, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_nationkey") % 3).alias("v"))
    b = T(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg((F.max("o_orderkey") % 3).cast("int").alias("v"))
    c = T(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_nationkey") % 3).alias("v"))
    return evaluate.three_way(a, b, c, "k", "v").select("k", "agree")


@query("""
WITH e AS (SELECT user_id, count(*) FILTER (event_type IN ('purchase', 'signup')) AS success, count(*) FILTER (event_type = 'error') AS error, count(*) AS total FROM events GROUP BY 1)
SELECT *, success + error AS processed, round(100 * (success + error) / total, 1) AS percent, success + error >= total AS complete FROM e""")
def batch_progress(spark, d):
    return store.progress(T(spark, d, "events"), "user_id", F.col("event_type"), ["purchase", "signup"], ["error"])


@query("""
SELECT user_id, event_type, count(*) AS n, array_to_string(list_sort(list_distinct(list(CAST(json_extract(props, '$.k') AS VARCHAR)))), ',') AS keys FROM events GROUP BY 1, 2""")
def engine_counts(spark, d):
    """Tokens by engine and the distinct evidence of each, joined."""
    e = T(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k"))
    return e.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("k")), ",").alias("keys"))


@query("SELECT user_id, count(*) FILTER (event_type = 'signup') > count(*) FILTER (event_type = 'purchase') AS active FROM events GROUP BY 1")
def mortgage_active(spark, d):
    from parcelforge.operators.merge import more_of

    return T(spark, d, "events").groupBy("user_id").agg(more_of(F.col("event_type"), "signup", "purchase").alias("active"))


@query("SELECT user_id, arg_max(event_id, struct_pack(ts, event_id)) FILTER (event_type = 'purchase') AS current_owner FROM events GROUP BY 1")
def current_owner(spark, d):
    """The last transfer decides."""
    at = F.when(F.col("event_type") == "purchase", F.struct("ts", "event_id"))
    return T(spark, d, "events").groupBy("user_id").agg(F.max_by("event_id", at).alias("current_owner"))


@query("""
WITH g AS (SELECT user_id, event_id, epoch(date_trunc('second', ts)) AS s, lag(epoch(date_trunc('second', ts))) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
i AS (SELECT user_id, event_id, sum(CASE WHEN p IS NULL OR s - p > 20000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS n, min(event_id) AS first_event FROM i GROUP BY 1, 2""")
def gap_sessions(spark, d):
    """Entries that a long gap separates."""
    from pyspark.sql import Window

    from parcelforge.operators.spatial import gap_islands

    e = T(spark, d, "events").withColumn("s", F.unix_seconds(F.col("ts").cast("timestamp")))
    e = e.withColumn("p", F.lag("s").over(Window.partitionBy("user_id").orderBy("s", "event_id")))
    return gap_islands(e, ["user_id"], ["s", "event_id"], F.col("s") - F.col("p") > 20000).groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query("SELECT o_orderstatus, count(*) AS n, count(*) FILTER (o_totalprice > 100000) AS large, CAST(sum(o_custkey) AS BIGINT) AS keys, max(o_orderkey) AS last_key FROM orders GROUP BY 1")
def running_total_stats(spark, d):
    return T(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 100000).alias("large"), F.sum("o_custkey").alias("keys"), F.max("o_orderkey").alias("last_key"))


@query("SELECT s_suppkey, s_name FROM supplier WHERE contains(lower(CAST(s_suppkey AS VARCHAR) || chr(1) || s_name || chr(1) || CAST(s_nationkey AS VARCHAR)), '7')")
def search_any_value(spark, d):
    s = T(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    return store.search_any_value(s, "7").select("s_suppkey", "s_name")


@query("SELECT event_id, coalesce(json_extract_string(props, '$.missing'), json_extract_string(props, '$.k')) AS v FROM events")
def json_path_fallback(spark, d):
    from parcelforge.operators.review import path_value

    return T(spark, d, "events").select("event_id", path_value(F.col("props"), "$.missing", "$.k").alias("v"))

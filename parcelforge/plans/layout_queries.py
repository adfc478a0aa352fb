"""Layout queries on boxes made from line items: an order is a page, a line item a token at (10 * line number, quantity)."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelforge.operators import merge, spatial
from parcelforge.plans.registry import query, table

T = table
PAGE = ("doc_id", "page_index")


def tokens(spark, d):
    """Distinct boxes: doc_id, page_index, ord, text, confidence and corners, whole numbers throughout."""
    li = T(spark, d, "lineitem")
    k = li.groupBy(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 2).alias("page_index"), F.col("l_partkey").alias("ord")).agg(F.min("l_linenumber").alias("n"), F.min("l_quantity").alias("q"), F.min("l_discount").alias("disc"))
    x, y = (F.col("n") * 37 % 7 * 100).cast("double"), (F.floor(F.col("q")) * 4).cast("double")
    return k.select(
        "doc_id", "page_index", "ord", (F.col("ord") % 1000).cast("string").alias("text"), (1 - F.col("disc")).alias("confidence"), x.alias("x1"), y.alias("y1"), (x + 80).alias("x2"), (y + 20).alias("y2")
    )


_TOKENS = """
k AS (SELECT l_orderkey AS doc_id, l_linenumber % 2 AS page_index, l_partkey AS ord, min(l_linenumber) AS n, min(l_quantity) AS q FROM lineitem GROUP BY 1, 2, 3),
t AS (SELECT doc_id, page_index, ord, CAST(ord % 1000 AS VARCHAR) AS text, CAST(n * 37 % 7 * 100 AS DOUBLE) AS x1, CAST(floor(q) * 4 AS DOUBLE) AS y1, CAST(n * 37 % 7 * 100 AS DOUBLE) + 80 AS x2, CAST(floor(q) * 4 AS DOUBLE) + 20 AS y2 FROM k)"""


@query(f"""
WITH {_TOKENS}, p AS (
  SELECT a.doc_id, a.page_index, a.ord AS a_ord, b.ord, CAST(row_number() OVER (PARTITION BY a.doc_id, a.page_index, a.ord ORDER BY b.x1, b.ord) AS INTEGER) AS nth
  FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.page_index = b.page_index AND a.ord <> b.ord
  WHERE b.x1 >= a.x1 + 40 AND b.x1 <= a.x1 + 800 AND greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) / 20 >= 0.4)
SELECT doc_id, page_index, a_ord, ord, nth FROM p""")
def range_neighbors(spark, d):
    t = tokens(spark, d)
    return spatial.right_neighbours(t, t).select(*PAGE, "a_ord", "ord", "nth")


@query(f"""
WITH {_TOKENS}, p AS (
  SELECT a.doc_id, a.page_index, a.ord AS a_ord, b.ord, CAST(row_number() OVER (PARTITION BY a.doc_id, a.page_index, a.ord ORDER BY b.y1, b.x1, b.ord) AS INTEGER) AS nth
  FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.page_index = b.page_index AND a.ord <> b.ord WHERE b.y1 BETWEEN a.y2 - 5 AND a.y2 + 250 AND b.x2 >= a.x1 - 150 AND b.x1 <= a.x2 + 150)
SELECT doc_id, page_index, a_ord, ord, nth FROM p""")
def bottom_neighbors(spark, d):
    t = tokens(spark, d)
    return spatial.lower_neighbours(t, t).select(*PAGE, "a_ord", "ord", "nth")


@query(f"""
WITH {_TOKENS}, p AS (
  SELECT a.doc_id, a.page_index, a.ord AS a_ord, b.ord, b.text, b.y1 - a.y1 AS dy, row_number() OVER (PARTITION BY a.doc_id, a.page_index, a.ord ORDER BY b.y1 - a.y1, b.ord) AS k
  FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.page_index = b.page_index AND a.ord <> b.ord WHERE b.y1 - a.y1 BETWEEN 0 AND 240 AND (b.x1 + b.x2) / 2 BETWEEN a.x1 AND a.x2)
SELECT doc_id, page_index, a_ord, ord, text, dy FROM p WHERE k = 1""")
def nearest_below(spark, d):
    t = tokens(spark, d)
    return spatial.nearest_below(t, t)


@query(f"""
WITH {_TOKENS}, p AS (
  SELECT a.doc_id, a.page_index, b.ord, min(abs(b.y1 - a.y1) + 0.15 * abs(b.x1 - a.x1)) AS cost FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.page_index = b.page_index AND a.ord <> b.ord WHERE a.ord % 5 = 0 GROUP BY 1, 2, 3),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, page_index ORDER BY round(cost, 6), ord) AS INTEGER) AS nth FROM p)
SELECT doc_id, page_index, ord, nth FROM r WHERE nth <= 3""")
def top_k_nearest(spark, d):
    t = tokens(spark, d)
    near = spatial.top_k_nearest(t.where("ord % 5 = 0"), t, 1000)
    from pyspark.sql import Window

    w = Window.partitionBy(*PAGE).orderBy(F.round("cost", 6), "ord")
    return near.withColumn("nth", F.row_number().over(w)).where("nth <= 3").select(*PAGE, "ord", "nth")


@query(f"""
WITH {_TOKENS} SELECT a.doc_id, a.page_index, a.ord AS a_ord, b.ord FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.page_index = b.page_index AND a.ord <> b.ord WHERE a.x1 < 300 AND b.x1 >= 300 AND b.y2 >= a.y1 - 60 AND b.y1 <= a.y2 + 80""")
def interval_overlap(spark, d):
    t = tokens(spark, d)
    return spatial.interval_overlap(t.where("x1 < 300"), t.where("x1 >= 300")).select(*PAGE, "a_ord", "ord")


@query(f"""
WITH {_TOKENS}, p AS (
  SELECT a.doc_id, a.page_index, a.ord AS a_ord, b.ord, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.page_index = b.page_index WHERE a.ord % 2 = 0 AND b.ord % 2 = 1),
r AS (SELECT *, i / (3200 - i) AS iou, row_number() OVER (PARTITION BY doc_id, page_index, a_ord ORDER BY i DESC, ord) AS k FROM p WHERE i / (3200 - i) >= 0.3)
SELECT doc_id, page_index, a_ord, ord, round(iou, 6) AS iou FROM r WHERE k = 1""")
def iou_match(spark, d):
    t = tokens(spark, d)
    return spatial.iou_match(t.where("ord % 2 = 0"), t.where("ord % 2 = 1"), 0.3).select(*PAGE, "a_ord", "ord", F.round("iou", 6).alias("iou"))


@query("""
WITH a AS (SELECT DISTINCT l_orderkey, l_quantity FROM lineitem)
SELECT l_orderkey, l_quantity, coalesce((lag(l_quantity) OVER w + l_quantity) / 2, l_quantity) AS band_from, coalesce((lead(l_quantity) OVER w + l_quantity) / 2, l_quantity) AS band_to FROM a WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_quantity)""")
def row_bands(spark, d):
    return spatial.row_bands(T(spark, d, "lineitem").select("l_orderkey", "l_quantity").distinct(), ["l_orderkey"], "l_quantity")


@query("""
WITH a AS (SELECT DISTINCT l_suppkey, l_quantity, l_partkey FROM lineitem), g AS (SELECT *, l_partkey - lag(l_partkey) OVER (PARTITION BY l_suppkey ORDER BY l_partkey, l_quantity) AS d FROM a),
c AS (SELECT l_suppkey, l_partkey, sum(CASE WHEN d IS NULL OR d > 25 THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY l_partkey, l_quantity ROWS UNBOUNDED PRECEDING) AS cluster FROM g)
SELECT l_suppkey, CAST(cluster AS BIGINT) AS cluster, min(l_partkey) AS low, max(l_partkey) AS high FROM c GROUP BY 1, 2""")
def x_clusters(spark, d):
    a = T(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    return spatial.clusters_1d(a, ["l_suppkey"], "l_partkey").groupBy("l_suppkey", "cluster").agg(F.min("l_partkey").alias("low"), F.max("l_partkey").alias("high"))


@query("""
WITH RECURSIVE a AS (SELECT l_orderkey AS k, list_sort(list(DISTINCT l_quantity)) AS v FROM lineitem GROUP BY 1),
f AS (SELECT k, v, 1 AS i, [v[1]] AS kept FROM a UNION ALL SELECT k, v, i + 1, CASE WHEN v[i + 1] - kept[-1] > 5 THEN list_append(kept, v[i + 1]) ELSE kept END FROM f WHERE i < len(v))
SELECT k AS l_orderkey, array_to_string(list_transform(kept, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',') AS kept FROM f WHERE i = len(v)""")
def anchor_thinning(spark, d):
    a = T(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_quantity")).alias("v"))
    return a.select("l_orderkey", F.array_join(F.transform(spatial.thin_anchors(F.col("v"), 5), lambda x: x.cast("long").cast("string")), ",").alias("kept"))


@query()
def reading_order(spark, d):
    """Sequential clustering of tokens into lines; tested against a plain loop."""
    return spatial.reading_order(tokens(spark, d)).select(*PAGE, "ord", "line", "position")


@query()
def anchor_fields(spark, d):
    """Field values beside fuzzy label anchors; tested on the fixtures."""
    labels = spark.createDataFrame([("parcel", "77"), ("sheet", "150 0")], "field string, label string")
    return spatial.extract_fields(tokens(spark, d), labels).select(*PAGE, "field", "value", "match_score")


@query("""
WITH v AS (SELECT user_id, event_type, event_id, CASE WHEN event_id % 3 = 0 THEN '-' WHEN event_id % 5 = 0 THEN '0' ELSE CAST(event_id AS VARCHAR) END AS value, CASE WHEN event_id % 2 = 0 THEN 0 ELSE 1 END AS r FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY r, event_id) AS n FROM v WHERE value NOT IN ('-', '0'))
SELECT user_id, event_type, event_id, value FROM k WHERE n = 1""")
def first_non_empty(spark, d):
    e = T(spark, d, "events").select("user_id", "event_type", "event_id", F.when(F.col("event_id") % 3 == 0, "-").when(F.col("event_id") % 5 == 0, "0").otherwise(F.col("event_id").cast("string")).alias("value"))
    return merge.first_non_empty(e, ["user_id"], "event_type", "value", [F.when(F.col("event_id") % 2 == 0, 0).otherwise(1), F.col("event_id")])


@query("""
WITH k AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_linenumber <= 2 THEN 90 ELSE 70 END DESC, l_quantity DESC, l_linenumber, l_partkey) AS n FROM lineitem)
SELECT l_orderkey, l_partkey AS best FROM k WHERE n = 1""")
def rank_candidates(spark, d):
    best = merge.best_candidate(F.col("l_partkey"), [F.when(F.col("l_linenumber") <= 2, 90).otherwise(70), F.col("l_quantity"), -F.col("l_linenumber")], F.col("l_partkey"))
    return T(spark, d, "lineitem").groupBy("l_orderkey").agg(best.alias("best"))

"""The queries over whole tables leave no row of theirs out."""

from pyspark.sql import functions as F

from parcelforge import queries
from parcelforge.plans.registry import table


def plain_thinning(values, gap):
    kept = []
    for v in sorted(set(values)):
        if not kept or v - kept[-1] > gap:
            kept.append(v)
    return ",".join(str(int(v)) for v in kept)


def test_anchors_of_every_order(spark, sf):
    orders = {}
    for r in table(spark, sf, "lineitem").select("l_orderkey", "l_quantity").collect():
        orders.setdefault(r.l_orderkey, []).append(r.l_quantity)
    got = {r.l_orderkey: r.kept for r in queries.QUERIES["anchor_thinning"](spark, sf).collect()}
    assert got == {k: plain_thinning(v, 5) for k, v in orders.items()}


def test_every_part_is_scored(spark, sf):
    got = queries.QUERIES["token_match_score"](spark, sf)
    keys = [r.p_partkey for r in table(spark, sf, "part").select("p_partkey").collect()]
    assert sorted(r.p_partkey for r in got.collect()) == sorted(keys)
    best = {r.k: (r.low, r.high) for r in got.groupBy((F.col("p_partkey") % 5).alias("k")).agg(F.min("score").alias("low"), F.max("score").alias("high")).collect()}
    assert best[0] == (1.0, 1.0) and best[1] == (0.98, 0.98) and best[2][1] == 0.82 and 0.6 < best[3][0] <= best[3][1] < 0.95 and best[4] == (0.0, 0.0)


def test_areas_of_keys_of_four_and_more_digits(spark, tmp_path):
    spark.createDataFrame([(k,) for k in (0, 7, 999, 1000, 1234, 14998, 1234567, 1234568)], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    got = {r.c_custkey: (r.value, r.unit) for r in queries.QUERIES["parse_area_string"](spark, str(tmp_path)).collect()}
    m = "m²"
    assert got == {0: (0.5, m), 7: (7.25, None), 999: (999000.5, None), 1000: (1000.25, m), 1234: (1234.25, m), 14998: (14998.25, m), 1234567: (1234567.25, None), 1234568: (1234568000.0, m)}


def test_identity_numbers_beside_other_digits(spark, tmp_path):
    texts = ["001099012345 on 01/02/2020", "1,5 and 123456789", "123456789 123456789,987654321", "1234567890 at 10:30", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.n for r in queries.QUERIES["extract_identity_numbers"](spark, str(tmp_path)).collect()}
    assert got == {0: 1, 1: 1, 2: 2, 3: 0, 4: None}

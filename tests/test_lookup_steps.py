"""A lookup's last steps: a key that holds the row's or is in it, and the truth with the row's name."""

import duckdb
from parcelforge import queries
from parcelforge.operators import evaluate
from pyspark.sql import functions as F


def both(name):
    return F.col(name), F.col(name)


def look(spark, rows, truth, **options):
    rows = spark.createDataFrame([r + (None,) * (4 - len(r)) for r in rows], "id int, serial string, place string, name string")
    truth = spark.createDataFrame([r + (None,) * (4 - len(r)) for r in truth], "tid int, serial string, place string, name string")
    got = [tuple(r) for r in evaluate.lookup_with_fallback(rows, truth, [both("serial"), both("place")], "id", "tid", **options).collect()]
    assert len(dict((r[0], r) for r in got)) == len(got)
    return {r[0]: r[1:] for r in got}


def test_a_key_that_holds_the_other_is_the_last_step(spark):
    truth = [(7, "AB123456", "17_345"), (3, "", "9_12"), (5, "CD1", "1_2"), (4, "XAB123456Y", None), (None, "ZZ9999", "1_99")]
    rows = [(1, "AB123456", "0_0"), (2, "no", "17_345"), (3, "HS-AB123456", ""), (4, "B1234", None), (5, "17_345_GCN", None), (6, "CD1X", None), (7, "D1", None), (8, "9_1", "8_8"), (9, None, "7_34"), (10, "", ""), (11, "ZZ9999", None), (12, "XAB123456YZ", None)]
    want = {1: (7, 0), 2: (7, 1), 3: (7, 2), 4: (4, 2), 5: (7, 2), 8: (3, 2), 12: (4, 2)}
    assert look(spark, rows, truth) == want
    assert look(spark, [(6, "CD1X"), (7, "D1")], truth, least=3) == {6: (5, 2), 7: (5, 2)}


def test_of_several_truths_the_one_with_the_name(spark):
    truth = [(1, "S1000", "5_9", "Trần Thị B"), (2, "S1000", "5_9", "Ông: Nguyễn Văn Đạt"), (3, "S1000", "", "nguyen van dat"), (4, "S2", "5_9", ""), (5, "S2", "", None)]
    rows = [(1, "S1000", None, "NGUYỄN VĂN ĐẠT"), (2, "S1000", None, "Bà Lê C"), (3, "S1000", None, None), (4, "", "5_9", "Văn Đạt"), (5, "S2", None, "x"), (6, "HS S1000", None, "bà Nguyễn Văn Đạt và vợ"), (7, "S10", None, "Ông"), (8, "S100", None, "Thị  B")]
    want = {1: (2, 0), 2: (1, 0), 3: (1, 0), 4: (2, 1), 5: (4, 0), 6: (2, 2), 7: (1, 2), 8: (1, 2)}
    assert look(spark, rows, truth, names=both("name")) == want


def test_rows_of_an_id_are_all_looked_up(spark):
    rows = spark.createDataFrame([(1, "S1"), (1, "S1"), (1, "S2")], "id int, serial string")
    truth = spark.createDataFrame([(1, "S1"), (2, "S2")], "tid int, serial string")
    got = evaluate.lookup_with_fallback(rows, truth, [both("serial")], "id", "tid").collect()
    assert sorted(map(tuple, got)) == [(1, 1, 0), (1, 1, 0), (1, 2, 0)]


def test_query_where_customers_are_missing(spark, sf, tmp_path):
    con = duckdb.connect()
    con.execute(f"CREATE TABLE customer AS SELECT * REPLACE (c_custkey + 5000 AS c_custkey, CASE c_custkey % 11 WHEN 0 THEN NULL WHEN 1 THEN 'Bà ' || c_custkey WHEN 2 THEN 'ÔNG: ' WHEN 3 THEN 'Đỗ ' || c_custkey ELSE c_name END AS c_name) FROM '{sf}/customer.parquet' WHERE c_nationkey < 9")
    con.execute("UPDATE customer SET c_nationkey = c_nationkey + 5090 WHERE c_nationkey > 6")
    con.execute("INSERT INTO customer SELECT NULL, 'x', 24, 0, 'x'")
    con.execute(f"CREATE TABLE orders AS SELECT * REPLACE (CASE o_orderkey % 8 WHEN 0 THEN o_custkey + 5000 WHEN 1 THEN o_custkey + 150000 WHEN 2 THEN 5000000 + o_custkey WHEN 3 THEN NULL ELSE o_custkey END AS o_custkey) FROM '{sf}/orders.parquet'")
    for name in ("customer", "orders"):
        con.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet'")
    got = queries.QUERIES["ground_truth_lookup"](spark, str(tmp_path)).select("o_orderkey", "c_custkey", "by_key").collect()
    want = con.execute(f"SELECT o_orderkey, c_custkey, by_key FROM ({queries.SQL['ground_truth_lookup']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
    assert {r.by_key for r in got} == {0, 1, 2}

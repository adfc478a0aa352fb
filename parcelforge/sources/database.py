"""Tables of a relational store, through JDBC where its driver is on the class path, and small files of settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelforge.session import counted_broadcast


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, low: int = 0, high: int = 0, parts: int = 16, **options: str) -> DataFrame:
    """A table, read in parts by a numeric key if it is given; filters and columns are pushed down."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key:
        reader = reader.options(partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
    return reader.load()


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """key and value (JSON text) of a JSON object in a file."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))


def read_ground_truth(spark: SparkSession, path: str, schema: str, skip: int = 6) -> DataFrame:
    """A reference sheet as CSV, its rows after the heading ones, with the keys it is looked up by: the serial, and sheet and parcel."""
    rows = spark.read.schema(schema).csv(path).where(F.col("excel_row") > skip)
    bare = lambda c: F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), r"[^A-Z0-9]", "")
    return rows.withColumns({"serial_key": bare(F.col("serial")), "place_key": F.when((F.col("sheet") != "") & (F.col("parcel") != ""), F.concat_ws("_", "sheet", "parcel")).otherwise("")})


def alias_lookup(names: DataFrame, exact: DataFrame, rules: DataFrame, name: str = "name") -> DataFrame:
    """``names`` with ``canonical``: of the exact aliases (alias, canonical), else of the first pattern in order (priority, pattern, canonical) that the name has. Both tables are settings of some hundred rows."""
    out = names.join(counted_broadcast(exact.select(F.lower("alias").alias("_a"), F.col("canonical").alias("_exact"))), F.lower(F.trim(name)) == F.col("_a"), "left")
    texts = out.where("_exact is null").select(name).distinct().join(counted_broadcast(rules), F.expr(f"{name} rlike pattern"))
    first = texts.groupBy(name).agg(F.min_by("canonical", "priority").alias("_rule"))
    return out.join(first, name, "left").withColumn("canonical", F.coalesce("_exact", "_rule")).drop("_a", "_exact", "_rule")

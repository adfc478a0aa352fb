"""Session settings that results depend on, and the shared folder for intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def configure(spark: SparkSession) -> SparkSession:
    """UTC timestamps, adaptive execution with skewed joins, and the engine's functions under SQL names."""
    from parcelforge.functions.fuzzy import register_all

    for key, value in (("spark.sql.session.timeZone", "UTC"), ("spark.sql.adaptive.enabled", "true"), ("spark.sql.adaptive.skewJoin.enabled", "true")):
        spark.conf.set(key, value)
    register_all(spark)
    return spark


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of our own only where it is unset and all tasks run in this one process. On a cluster an unset folder is an error, never a machine's own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir names no shared folder for intermediate tables")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="parcelforge-")
    return _OWN[app]


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` computed once: a table in the shared folder, read back."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a configuration table (labels, aliases, patterns, places of one level) that may be sent to every task.
CONFIGURATION_ROWS = 20_000


def counted_broadcast(df: DataFrame, most: int = CONFIGURATION_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to have ``most`` rows at most, else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df

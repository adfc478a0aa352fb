"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing Parquet under ``spark.checkpoint.dir``; a lost
executor costs the tasks it ran, never a table.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of our own only where it is unset and all tasks run in this one process. On a cluster an unset folder is an error, never a machine's own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir names no shared folder for intermediate tables")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="parcelforge-")
    return _OWN[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as a shared table and read it back."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete shared tables that nothing reads any more: all that was made of them is written."""
    for df in tables:
        if path := vars(df).pop("_shared_path", None):
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


#: Rows and bytes of a batch that goes to Python, so that a worker's memory does not depend on how long texts are.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def in_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session sends Python no larger batches than these; a setting that is smaller stays. A row is never split."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(key, None)
        number = int(re.sub(r"\D", "", now)) if now and re.fullmatch(r"\d+b?", now) else 0
        if not 0 < number <= most:
            conf.set(key, str(most))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def private(df: DataFrame, *names: str) -> list[str]:
    """A name like each of ``names`` that no column of ``df`` has, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


#: Rows of one key from which it is hot: such keys are fewer than all rows over this number.
HOT_ROWS = 20_000
#: Hot keys that may be sent to every task; more of them are joined by a shuffle like the others.
BROADCAST_HOT = 200_000


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], count: str, how: str = "inner") -> DataFrame:
    """``left`` joined to ``right``, which has one row a key and in ``count`` how many rows of ``left`` have it.

    Rows of hot keys stay where they are and meet the few hot rows of ``right``
    there, so no key's rows come to one task; all other rows are shuffled.
    ``how`` is inner or left; ``count`` is not in the result.
    """
    hot = right.where(F.col(count) >= HOT_ROWS).drop(count)
    most = hot.count()
    if not 0 < most <= BROADCAST_HOT:
        return left.join(right.drop(count), keys, how)
    spread = left.join(F.broadcast(hot), keys)
    rest = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(right.where(F.col(count) < HOT_ROWS).drop(count), keys, how)
    return spread.unionByName(rest)


def maybe_broadcast(small: DataFrame, max_rows: int) -> DataFrame:
    """``small`` with a broadcast hint if it has at most ``max_rows`` rows (narrow rows only); else as it is, for a shuffled join."""
    return F.broadcast(small) if small.count() <= max_rows else small

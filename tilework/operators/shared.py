"""Tables in the folder that a cluster's machines share: they cut lineage and outlive executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


#: Rows of a table that one task sorts by key.
ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only on one machine may that be unset."""
    path = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_shared_tables", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("on a cluster, spark.checkpoint.dir must name a folder that all executors share")
        path = spark._shared_tables = "file://" + tempfile.mkdtemp(prefix="tilework-")
    return path.rstrip("/")


def dealt(df: DataFrame, *keys: str, rows: int = ROWS) -> DataFrame:
    """``df`` dealt by ``keys`` to tasks of about ``rows`` rows, so that what a task sorts does not grow with the table. Windows and
    aggregations by the keys, or by them and others, need no other shuffle. ``df`` is counted first: it should be a scan of a table."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-df.count() // rows)), *keys)


def numbers_first(df: DataFrame, keys: Sequence[str]) -> list[str]:
    """``keys`` with those that are no strings first: sorts compare a few bytes of the first column at once, and names of methods are alike."""
    types = dict(df.dtypes)
    return sorted(keys, key=lambda k: types.get(k) == "string")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tilework-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

"""Shared helpers: tables in the cluster's shared folder and shipping of this package to the workers."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset (tests on one machine) a temporary one is set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = getattr(spark, "_tilework_dir", None)
        if not path:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("on a cluster, spark.checkpoint.dir must name a folder that all executors share")
            path = "file://" + tempfile.mkdtemp(prefix="tilework-")
            spark._tilework_dir = path
    return path.rstrip("/")


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tilework-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._tilework_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a table made by :func:`written` once nothing reads it any more."""
    path = getattr(df, "_tilework_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


#: Rows that a Python worker gets at once, unless the session says otherwise: texts are long, and Spark's 10,000 take too much memory.
ROWS_AT_ONCE = 2000


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers when ``PYTHONPATH`` does not already do so, and bound what they get at once."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, ROWS_AT_ONCE)
    root = str(Path(__file__).resolve().parents[2])
    if root in os.environ.get("PYTHONPATH", "").split(":") or getattr(spark.sparkContext, "_tilework_shipped", False):
        return
    where = os.path.join(tempfile.mkdtemp(prefix="tilework-zip-"), "tilework_src.zip")
    with zipfile.ZipFile(where, "w") as z:
        for p in Path(root, "tilework").rglob("*.py"):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(where)
    if where in sys.path:
        sys.path.remove(where)
    spark.sparkContext._tilework_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(col) -> F.Column:
    """crc32 of an id written as text, modulo 4; rows with 2 are held out from training."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % 4


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the CRC-32 of an ASCII text, bit by bit; the polynomial is a fixed value."""
    byte = f"CASE WHEN i % 8 = 0 THEN xor(c, ascii(substr({text}, i // 8 + 1, 1))) ELSE c END"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], range(8 * length({text}))), lambda c, i: xor(({byte}) >> 1, CASE WHEN ({byte}) % 2 = 1 THEN 3988292384 ELSE 0 END)), 4294967295)"

"""Steps of iterative plans: small or narrow tables that are written once a round, so that lineage stays short and lost executors cost one round."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only a session on one machine that has none gets a folder of its own, a cluster without one is an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        own = tempfile.mkdtemp(prefix="fieldglass-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        base = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", base)
    return (base if "://" in base or base.startswith("file:") else f"file://{base}").rstrip("/")


def settle(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/fieldglass/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """``df`` with its rows dealt out to as many tasks as the session shuffles to: before work that is heavy per row, since a file of one row group is one task, whatever its size."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts go to Python in batches of at most ``rows``; a smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def mark(spark: SparkSession, path: str) -> bool:
    """Creates an empty file that must not exist yet; False if it does. The one step that makes written tables count, on any file system."""
    fs, target = _fs(spark, path)
    return bool(fs.createNewFile(target))


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files in a folder; none if there is no folder."""
    fs, target = _fs(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []


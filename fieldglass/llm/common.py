"""What the operators of this subpackage share: shared storage, word splitting, sizing."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and the session runs on one machine (local tests) a folder of our own is set; on a cluster it is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        own = tempfile.mkdtemp(prefix="fieldglass-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        base = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base if "://" in base or base.startswith("file:") else f"file://{base}"


@contextlib.contextmanager
def session_settings(spark: SparkSession, values: dict) -> Iterator[None]:
    """Settings of the session for work that is done inside the block; set back after it."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, str(v))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


_made: list[str] = []
_own: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("own", default=())


def new_folder(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/fieldglass/{label}-{uuid.uuid4().hex}"
    for made in (_made, *_own.get()):
        made.append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def working_tables(spark: SparkSession) -> Iterator[list[str]]:
    """The folders made inside the block (in this thread), in turn; those still listed at its end are deleted."""
    own: list[str] = []
    token = _own.set((*_own.get(), own))
    try:
        yield own
    finally:
        _own.reset(token)
        for path in own:
            _delete(spark, path)
            if path in _made:
                _made.remove(path)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a compressed table in the shared folder and read it back.

    Cuts lineage like ``checkpoint()``, but columnar and compressed, and any later
    stage reads only the columns it needs. Survives the loss of executors. Row groups are small, so that writing holds little.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    # what was shuffled for the table is of no use once it is written
    with session_settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        df.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete the working tables that this process made, once their results are no longer needed; any file system."""
    while _made:
        _delete(spark, _made.pop())


def word_count(text: Column | str) -> Column:
    """Number of words; a null text has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; ``bytes.split`` cuts at exactly the six characters of ``SPACE``."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def shards_for(df: DataFrame, text_col: str, mb: float) -> int:
    """How many shards of about ``mb`` MB the whole texts make (one narrow aggregate over the column)."""
    total = df.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0
    return max(1, -(-int(total) // int(mb * 1_000_000)))


def split_id(col: Column) -> list[Column]:
    """An id as two columns without nulls; pandas would make a long column that holds nulls a float one."""
    return [F.coalesce(col.cast("long"), F.lit(0)).alias("d"), col.isNull().alias("dn")]


def joined_id(batch: pd.DataFrame):
    """The nullable ids of a batch that has the columns of :func:`split_id`."""
    return pd.arrays.IntegerArray(batch["d"].to_numpy(np.int64), batch["dn"].to_numpy(bool))


def spread(df: DataFrame, mb_per_core: float = 4) -> DataFrame:
    """Deals rows out evenly when the input is so small that its files would keep few cores busy; else unchanged.

    Sizes come from the plan's statistics, no job is run. Only worth its shuffle before work that is heavy per row.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * mb_per_core * 1_000_000 else df


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts go to Python in batches of at most ``rows``, so that a worker holds little at a time; a smaller setting of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def ordered_rows(df: DataFrame, order: list[Column | str], label: str) -> DataFrame:
    """``df`` as a written table with ``place``: each row's rank from 0 in the given order over the whole table.

    Rows are split by sampled ranges of the order and numbered within their range; one count a range gives the
    offsets. So no task sees more than a range, ties included if the order tells rows apart. Columns of the order should be short: they are sampled on the driver.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place_", F.monotonically_increasing_id())
    table = materialize(ranged, label)
    part = F.shiftright("place_", 33)
    counts = table.groupBy(part.alias("part_")).agg(F.count(F.lit(1)).alias("n_"))
    # one row a range
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("offset_"))
    return table.join(F.broadcast(offsets), part == F.col("part_")).withColumn("place", F.col("offset_") + F.col("place_").bitwiseAND((1 << 33) - 1)).drop("place_", "part_", "offset_")

"""Token ids of a corpus as shards, each one wavelet-matrix file in a shared folder.

``write`` range-partitions documents by id, encodes each partition in ascending order and cuts it into
files of about ``shard_tokens`` ids at document borders. Only file facts (one row a shard) come back. ``read``
opens each file in a task and returns documents with their global start. ``count_token`` and
``locate_token`` answer from the files by rank and select without decoding them.

Nulls and edges: a null text counts as empty (only the end id); documents with a null id come first;
rows that repeat an id stay separate documents, ordered by their text's hash; an empty table gives no file.
A retried task writes the same bytes to the same name through a rename, so losing executors does no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldglass.llm.common import materialize, new_folder, shards_for, small_batches, split_id
from fieldglass.llm.tokens import encode_all, tokenizer
from fieldglass.llm.wavelet import WaveletFile, build

SHARDS = "part int, seq int, path string, n_docs long, n_tokens long"
DOCS = "doc_id long, start long, n_tokens long, ids binary"


def _open(path: str, mode: str):
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path)
    return (system, place) if mode == "w" else system.open_input_file(place)


def _put(path: str, data: bytes, attempt: int) -> None:
    system, place = _open(path, "w")
    system.create_dir(place.rpartition("/")[0], recursive=True)
    draft = f"{place}.attempt-{attempt}"
    with system.open_output_stream(draft) as f:
        f.write(data)
    system.move(draft, place)


def write(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, end_id: int = 2, shard_tokens: int = 4_000_000, partition_mb: float = 64) -> DataFrame:
    """Write all documents; returns one row a shard: part, seq, path, n_docs, n_tokens."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or new_folder(spark, "wavelet")
    rows = docs.select(*split_id(F.col(id_col)), F.col(text_col).alias("t"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), shards_for(rows, "t", partition_mb))

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        bits = max(1, int(max(tokenizer(tokenizer_path).get_vocab_size() - 1, end_id)).bit_length())
        ids, docs_in, held, seq = [], [], 0, 0

        def flush():
            path = f"{folder}/part-{task.partitionId():06d}-{seq:06d}.wm"
            _put(path, build(np.concatenate(ids), docs_in, [len(x) for x in ids], bits), task.taskAttemptId())
            return pd.DataFrame({"part": np.int32(task.partitionId()), "seq": np.int32(seq), "path": [path], "n_docs": len(ids), "n_tokens": held})

        for batch in batches:
            for d, gone, x in zip(batch["d"], batch["dn"], encode_all(batch["t"].tolist(), tokenizer_path, end_id)):
                ids.append(x)
                docs_in.append(None if gone else int(d))
                held += len(x)
                if held >= shard_tokens:
                    yield flush()
                    ids, docs_in, held, seq = [], [], 0, seq + 1
        if ids:
            yield flush()

    order = (F.col("dn").desc(), F.col("d"), F.xxhash64("t"))
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return materialize(ordered.mapInPandas(shards, SHARDS), "shards")


def with_start(shards: DataFrame) -> DataFrame:
    """Adds the global position of each shard: prefix sums within a part, then over the parts' totals (a row each)."""
    inner = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    outer = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("base"))
    return shards.join(bases, "part").withColumn("shard_start", F.col("base") + F.coalesce(F.sum("n_tokens").over(inner), F.lit(0))).drop("base")


def _spread(shards: DataFrame, columns: list) -> DataFrame:
    """One shard a task."""
    return shards.select(*columns).repartition(max(1, shards.count()), "path")


def read(shards: DataFrame) -> DataFrame:
    """Every document of the files: doc_id, start (ids before it), n_tokens, ids (little-endian unsigned 32-bit)."""

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, base in zip(batch["path"], batch["shard_start"]):
                with _open(path, "r") as f:
                    wave = WaveletFile(f, cached_blocks=1 << 20)
                    ids = wave.decode().astype("<u4")
                n = wave.doc_tokens.astype(np.int64)
                ends = np.cumsum(n)
                for at in range(0, len(n), 1000):
                    part = slice(at, at + 1000)
                    yield pd.DataFrame({"doc_id": pd.array(wave.doc_ids[part], dtype="Int64"), "start": int(base) + (ends - n)[part], "n_tokens": n[part], "ids": [ids[b - k : b].tobytes() for b, k in zip(ends[part], n[part])]})

    return _spread(with_start(shards), ["path", "shard_start"]).mapInPandas(load, DOCS)


def count_token(shards: DataFrame, token: int) -> DataFrame:
    """path, n: how often each file has ``token`` (two ranks a bit-plane)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                with _open(path, "r") as f:
                    yield pd.DataFrame({"path": [path], "n": [WaveletFile(f).count(token)]})

    return _spread(shards, ["path"]).mapInPandas(count, "path string, n long")


def locate_token(shards: DataFrame, token: int) -> DataFrame:
    """position: every global position of ``token``, by select."""

    def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, base in zip(batch["path"], batch["shard_start"]):
                with _open(path, "r") as f:
                    yield pd.DataFrame({"position": np.array(WaveletFile(f).locate(token), dtype=np.int64) + int(base)})

    return _spread(with_start(shards), ["path", "shard_start"]).mapInPandas(locate, "position long")


def token_at(spark: SparkSession, shards: DataFrame, position: int) -> int:
    """The id at a global position; opens one file only."""
    row = with_start(shards).filter((F.col("shard_start") <= position) & (F.col("shard_start") + F.col("n_tokens") > position)).first()
    if row is None:
        raise IndexError(position)
    with _open(row["path"], "r") as f:
        return WaveletFile(f).access(position - row["shard_start"])

"""Target-distribution importance resampling with hashed n-gram features, by suffix arrays of word ids.

Features are all runs of 1 to 3 consecutive words, hashed to buckets; a bucket's gain is the log ratio of its share in the
target texts to its share in the corpus; a document's weight is the sum of the gains of its features; the draw takes the
highest weights after Gumbel noise, which is sampling without replacement in proportion to the weights' exponentials.

1. *Suffix arrays.* Each task cuts its texts into chunks of about ``chunk_mb``. Words of a chunk become ids and its suffixes
   are sorted to the depth of the longest feature. The array of common-prefix lengths (capped there, and ended by the document) splits
   the order into runs: a run of length n or more is one distinct n-gram with all its occurrences. Each run is hashed
   once, from the checksums of its words (checksums of joined strings follow from those of the parts), and the bucket goes back to every occurrence.
2. *Counts.* Every task adds up its buckets: one row of ``buckets`` numbers a task, whatever its rows, summed by bucket.
3. *Scores.* Buckets of the occurrences were written beside their documents (two bytes each), so texts are read and
   hashed once; gains, one number a bucket, go to all tasks.
4. *Draw.* Ranks come from sampled ranges of the score and one offset a range; no task sees all documents.

Nulls and edges: a null, empty or wordless text has no features, weight zero and is never drawn; a null id hashes as an
empty string and comes last among ties; rows that share an id are scored and drawn as rows; an empty target leaves only smoothing; an
empty corpus gives an empty result; columns beyond those named are ignored. A feature never crosses documents.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.common import materialize, ordered_rows, session_settings, split_id

#: A-Z become lower case; other ASCII characters but digits and letters become spaces; bytes of other characters stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
FEATURE_SCHEMA = "d long, dn boolean, n_words long, n_features long, ids binary, counts binary"
DEPTH = 3


@functools.lru_cache(maxsize=4096)
def _shift(length: int) -> np.ndarray:
    """Tables (4, 256) that move a CRC-32 past ``length`` further bytes; the step is linear, so powers of it are by squaring."""
    step = np.array([0xEDB88320 if i == 0 else 1 << (i - 1) for i in range(32)], dtype=np.uint32)  # past one bit
    power, left = np.uint32(1) << np.arange(32, dtype=np.uint32), 8 * length
    apply = lambda op, x: np.bitwise_xor.reduce(np.where((x[..., None] >> np.arange(32, dtype=np.uint32)) & 1, op, np.uint32(0)), axis=-1)
    while left:
        if left & 1:
            power = apply(step, power)
        step = apply(step, step)
        left >>= 1
    values = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    return apply(power, values.astype(np.uint32))


def joined_crc(left: np.ndarray, right: np.ndarray, kind: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """CRC-32 of joined strings from those of their parts; ``kind`` numbers the length of the right part in ``tables``."""
    moved = right.copy()
    for k in range(4):
        moved ^= tables[kind, k, (left >> np.uint32(8 * k)) & np.uint32(255)]
    return moved


def _sorted_suffixes(columns: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes by their first three ids, and the length of each one's common prefix with the one before (0 to 3)."""
    if bits * DEPTH <= 63:
        key = (columns[0] << (2 * bits)) | (columns[1] << bits) | columns[2]
        order = np.argsort(key)
    else:
        order = np.lexsort(columns[::-1])
    same = np.ones(len(order) - 1, bool)
    common = np.zeros(len(order), np.int8)
    for c in columns:
        c = c[order]
        same &= (c[1:] == c[:-1]) & (c[1:] > 0)
        common[1:] += same
    return order, common


def buckets_of(texts: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words and features of each text, and the buckets of all features, text after text."""
    split = [t.translate(FOLD).split() for t in texts]
    n_words = np.array([len(w) for w in split], dtype=np.int64)
    n_features = np.where(n_words >= DEPTH, DEPTH * n_words - 3, np.maximum(2 * n_words - 1, 0))
    total = int(n_words.sum())
    if not total:
        return n_words, n_features, np.zeros(0, np.uint16)
    coded = pa.array([w for doc in split for w in doc], pa.large_binary()).dictionary_encode()
    vocabulary = coded.dictionary.to_pylist()
    ids = coded.indices.to_numpy().astype(np.int64) + 1
    crc = np.array([0] + [zlib.crc32(w) for w in vocabulary], dtype=np.uint32)
    spaced = np.array([0] + [zlib.crc32(w + b" ") for w in vocabulary], dtype=np.uint32)
    sizes, kind = np.unique([0] + [len(w) for w in vocabulary], return_inverse=True)
    tables = np.stack([_shift(int(s)) for s in sizes])
    tables_spaced = np.stack([_shift(int(s) + 1) for s in sizes])
    # ids of the next words; zero past the end of the document
    doc = np.repeat(np.arange(len(split)), n_words)
    columns = [ids]
    for k in range(1, DEPTH):
        follow = np.zeros(total, np.int64)
        if total > k:
            follow[:-k] = np.where(doc[:-k] == doc[k:], ids[k:], 0)
        columns.append(follow)
    order, common = _sorted_suffixes(columns, int(len(vocabulary) + 1).bit_length())
    out = np.empty((total, DEPTH), dtype=np.uint16)
    for n in range(1, DEPTH + 1):
        head = common < n
        first = order[head]  # one occurrence a run
        words = [columns[k][first] for k in range(n)]
        h = crc[words[0]] if n == 1 else spaced[words[0]]
        for k in range(1, n):
            h = joined_crc(h, crc[words[k]], kind[words[k]], tables) if k == n - 1 else joined_crc(h, spaced[words[k]], kind[words[k]], tables_spaced)
        out[order, n - 1] = (h % np.uint32(buckets)).astype(np.uint16)[np.cumsum(head) - 1]
    real = np.stack([c > 0 for c in columns], axis=1)
    return n_words, n_features, out[real]


def hash_features(buckets: int, chunk_mb: float):
    """For ``mapInArrow``: a row a document with the buckets of its features, and a row a task with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, size = np.zeros(buckets, np.int64), [], 0

        def chunk() -> pa.RecordBatch:
            d, dn, texts = ([x for part in held for x in part[k]] for k in range(3))
            n_words, n_features, found = buckets_of(texts, buckets)
            counts[:] += np.bincount(found, minlength=buckets)
            offsets = np.concatenate([[0], np.cumsum(2 * n_features)]).astype(np.int32)
            packed = pa.BinaryArray.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(found.astype("<u2").tobytes())])
            columns = [pa.array(d, pa.int64()), pa.array(dn, pa.bool_()), pa.array(n_words), pa.array(n_features), packed, pa.nulls(len(texts), pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["d", "dn", "n_words", "n_features", "ids", "counts"])

        for batch in batches:
            d, dn, texts = (batch.column(c).to_pylist() for c in ("d", "dn", "t"))
            begin = 0
            for i, t in enumerate(texts):
                size += len(t)
                if size >= chunk_mb * 1_000_000:
                    held.append((d[begin : i + 1], dn[begin : i + 1], texts[begin : i + 1]))
                    yield chunk()
                    held, size, begin = [], 0, i + 1
            held.append((d[begin:], dn[begin:], texts[begin:]))
        if held:
            yield chunk()
        if counts.any():
            columns = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.bool_()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([counts.astype("<i8").tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["d", "dn", "n_words", "n_features", "ids", "counts"])

    return run


def _spread_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for packed in batch.column("counts").to_pylist():
            n = np.frombuffer(packed, "<i8")
            bucket = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(n[bucket])], ["bucket", "n"])


def hashed(docs: DataFrame, id_col: str | None, text_col: str, buckets: int, chunk_mb: float, label: str) -> DataFrame:
    """The written table of :func:`hash_features`."""
    ids = split_id(F.col(id_col)) if id_col else [F.lit(0).cast("long").alias("d"), F.lit(False).alias("dn")]
    rows = docs.select(*ids, F.encode(F.coalesce(text_col, F.lit("")), "UTF-8").alias("t"))
    with session_settings(docs.sparkSession, {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000}):
        return materialize(rows.mapInArrow(hash_features(buckets, chunk_mb), FEATURE_SCHEMA), label)


def bucket_counts(table: DataFrame) -> DataFrame:
    """bucket, n: sums over the tasks' counts."""
    spread = table.filter("counts is not null").select("counts").mapInArrow(_spread_counts, "bucket int, n long")
    return spread.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int, scale: int) -> DataFrame:
    """bucket, gain for all buckets: the scaled log ratio of target share to corpus share, each smoothed by one a bucket; floored."""
    one = corpus.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    every = one.unionByName(corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t")))
    cell = every.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    total = cell.agg(F.sum("s").alias("ss"), F.sum("t").alias("tt"))
    number = lambda c: F.col(c).cast("double")
    ratio = (number("t") + 1) * (number("ss") + buckets) / ((number("s") + 1) * (number("tt") + buckets))
    return cell.crossJoin(total).select("bucket", F.floor(scale * F.log(ratio)).alias("gain"))


def add_weights(gain: np.ndarray):
    """For ``mapInArrow``: sums the gains over each document's buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            n = batch.column("n_features").to_numpy(zero_copy_only=False)
            found = np.frombuffer(b"".join(ids.to_pylist()), "<u2")
            total = np.concatenate([[0], np.cumsum(gain[found])])
            ends = np.cumsum(n)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("d", "dn", "n_words", "n_features")] + [pa.array(total[ends] - total[ends - n])], ["d", "dn", "n_words", "n_features", "weight"])

    return run


def noise(doc_id: Column, seed: int, scale: int) -> Column:
    """Scaled Gumbel noise from a digest of seed and id; floored."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-scale * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: tuple[int, int] = (5, 100), least_words: int = 20, buckets: int = 10_000, scale: int = 1000, seed: int = 42, chunk_mb: float = 3) -> DataFrame:
    """id, n_words, n_features, weight, score, rank: one row a document; rank from 1 for the drawn ones, else null.

    Of the N documents with at least ``least_words`` words, ``share[0] * N // share[1]`` are drawn. ``buckets`` is at most 65,536.
    """
    table = hashed(docs, id_col, text_col, buckets, chunk_mb, "features")
    wanted = bucket_counts(hashed(target, None, text_col, buckets, chunk_mb, "target"))
    gain = np.zeros(buckets, np.int64)
    for row in gains(bucket_counts(table), wanted, buckets, scale).collect():  # as many rows as buckets, whatever the input
        gain[row["bucket"]] = row["gain"]
    with session_settings(docs.sparkSession, {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000}):
        weighed = materialize(table.filter("counts is null").select("d", "dn", "n_words", "n_features", "ids").mapInArrow(add_weights(gain), "d long, dn boolean, n_words long, n_features long, weight long"), "weights")
    doc_id = F.when(~F.col("dn"), F.col("d"))
    scored = weighed.select(doc_id.alias("id_"), "n_words", "n_features", "weight", (F.col("weight") + noise(doc_id, seed, scale)).alias("score"))
    fit = F.col("n_words") >= least_words
    eligible = ordered_rows(scored.filter(fit), [F.desc("score"), F.asc_nulls_last("id_")], "scores")
    drawn = share[0] * scored.filter(fit).count() // share[1]
    rank = F.when(F.col("place") < drawn, F.col("place") + 1)
    out = eligible.withColumn("rank", rank).drop("place").unionByName(scored.filter(~fit).withColumn("rank", F.lit(None).cast("long")))
    return out.withColumnRenamed("id_", id_col)

"""Exact dedup by a sort of contents.

Texts are equal when they are identical after lower-casing A-Z. The rows are sorted by content and neighbours are compared in full:

1. *Splitters.* Spark samples sort keys and cuts the key space into ranges of about equally many rows. A key is the head of the
   normalised text, its digest and the id, so the sample that meets on the driver is small however long texts are, texts
   with a common head are spread by their digest, and copies of one text by their id: no range grows with a group of copies.
2. *Sort.* Each range is sorted (externally, spilling) by head, digest, whole text, id; so equal texts are adjacent, best row first.
3. *Comparison.* A pass over each sorted range compares every text with the one before it in full and ends a run where they
   differ. It holds one batch and the ids of the open run. A run that touches a range's border also leaves its text.
4. *Borders.* The last text of a range is compared in full with the first one of the next; runs that go on are added
   up. Two rows a range take part, whatever the input.

Nulls and edges: a null text counts as empty; a null id stays only if no row of the group has an id; of rows that share text
and id one stays; ids tie no further; an empty table gives an empty result; columns beyond the two named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.llm.common import materialize, session_settings, split_id

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN_SCHEMA = "part int, run long, d long, dn boolean, digest string, head boolean, keep long, keep_null boolean, size long, edge string, text string"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


class _Run:
    """The run that is still open at the end of a batch: its ids, not its texts, but for one."""

    def __init__(self):
        self.text: pa.Scalar | None = None
        self.digest = ""
        self.d: list[np.ndarray] = []
        self.dn: list[np.ndarray] = []


def _rows(part: int, run: np.ndarray, d: np.ndarray, dn: np.ndarray, digest, edge: np.ndarray | None = None, text=None) -> pa.RecordBatch:
    """Rows of whole runs, each with its run's first id and size."""
    head = np.concatenate([[True], run[1:] != run[:-1]])
    begin = np.flatnonzero(head)
    size = np.diff(np.concatenate([begin, [len(run)]]))
    first = np.repeat(begin, size)
    nothing = pa.nulls(len(run), pa.string())
    columns = [pa.array(np.full(len(run), part, np.int32)), pa.array(run), pa.array(d), pa.array(dn), digest, pa.array(head), pa.array(d[first]), pa.array(dn[first]), pa.array(np.repeat(size, size)), nothing if edge is None else edge, nothing if text is None else text]
    return pa.RecordBatch.from_arrays(columns, ["part", "run", "d", "dn", "digest", "head", "keep", "keep_null", "size", "edge", "text"])


def _edge_rows(part: int, run: int, state: _Run, edge: str) -> pa.RecordBatch:
    """The rows of a run at a border; the first carries the text."""
    d, dn = np.concatenate(state.d), np.concatenate(state.dn)
    n = len(d)
    text = pa.concat_arrays([pa.array([state.text.as_py()], pa.string()), pa.nulls(n - 1, pa.string())])
    return _rows(part, np.full(n, run, np.int64), d, dn, pa.array([state.digest] * n, pa.string()), pa.array([edge] * n, pa.string()), text)


def find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, d, dn, digest, text) of a sorted range to rows of runs; runs are numbered within the range."""
    state, run, part = _Run(), 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        text, digest = batch.column("norm"), batch.column("digest")
        d, dn = batch.column("d").to_numpy(zero_copy_only=False), batch.column("dn").to_numpy(zero_copy_only=False)
        part = batch.column("part")[0].as_py()
        same = np.zeros(len(text), bool)
        same[1:] = pc.equal(text[1:], text[:-1]).to_numpy(zero_copy_only=False)
        same[0] = state.text is not None and text[0].equals(state.text)
        starts = np.flatnonzero(~same)
        # rows before the first start go on with the open run
        into = starts[0] if len(starts) else len(text)
        if into:
            state.d.append(d[:into])
            state.dn.append(dn[:into])
        if not len(starts):
            continue
        if state.text is not None:
            if run == 0:
                yield _edge_rows(part, 0, state, "first")
            else:
                ids = np.concatenate(state.d)
                yield _rows(part, np.full(len(ids), run, np.int64), ids, np.concatenate(state.dn), pa.array([state.digest] * len(ids), pa.string()))
            run += 1
        last = starts[-1]
        if into < last:
            number = run + np.cumsum(~same[into:last]) - 1
            whole = into
            if run == 0:  # the first run of the range ends in this batch
                until = int(starts[1])
                first = _Run()
                first.text, first.digest, first.d, first.dn = text[into], digest[into].as_py(), [d[into:until]], [dn[into:until]]
                yield _edge_rows(part, 0, first, "first")
                whole = until
            if whole < last:
                yield _rows(part, number[whole - into :], d[whole:last], dn[whole:last], digest[whole:last])
            run = int(number[-1]) + 1
        state = _Run()
        state.text, state.digest, state.d, state.dn = text[last], digest[last].as_py(), [d[last:]], [dn[last:]]
    if state.text is not None:
        yield _edge_rows(part, run, state, "last" if run else "only")


def _border_groups(runs: DataFrame) -> DataFrame:
    """part, run, keep, keep_null, size, joined for the runs at borders: those of one text over several ranges together."""
    edges = runs.filter("text is not null").select("part", "run", "edge", "text", "keep", "keep_null", "size")
    # windows over one or two rows a range, without texts
    place = edges.select("part").distinct().withColumn("k", F.row_number().over(Window.orderBy("part")))
    placed = edges.join(F.broadcast(place), "part")
    ends = placed.filter("edge <> 'first'").select((F.col("k") + 1).alias("k"), F.col("text").alias("before"))
    joined = placed.filter("edge <> 'last'").join(ends, "k").filter(F.col("text") == F.col("before")).select("part", "run", F.lit(1).alias("joined"))
    marked = placed.drop("text").join(joined, ["part", "run"], "left").withColumn("joined", F.coalesce("joined", F.lit(0)))
    order = Window.orderBy("part", "run")
    chained = marked.withColumn("chain", F.sum(1 - F.col("joined")).over(order))
    group = chained.groupBy("chain").agg(F.min(F.struct("part", "run", "keep", "keep_null")).alias("first"), F.sum("size").alias("total"))
    return chained.join(group, "chain").select("part", "run", F.col("joined") == 1, F.col("first.keep"), F.col("first.keep_null"), F.col("total")).toDF("part", "run", "joined", "chain_keep", "chain_keep_null", "chain_size")


def dedup_content(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head: int = 32, batch_rows: int = 1000) -> DataFrame:
    """id, keep_id (the largest id of the equal texts), group_size, kept, text_sha256 (of the normalised text): one row a document."""
    rows = docs.select(*split_id(F.col(id_col)), normalised(F.col(text_col)).alias("norm")).withColumn("digest", F.sha2("norm", 256)).withColumn("lead", F.substring("norm", 1, head))
    best = [F.col("dn").asc(), F.col("d").desc()]
    ranged = rows.repartitionByRange("lead", "digest", *best).sortWithinPartitions("lead", "digest", "norm", *best)
    sorted_rows = ranged.select(F.spark_partition_id().alias("part"), "d", "dn", "digest", "norm")
    with session_settings(docs.sparkSession, {"spark.sql.execution.arrow.maxRecordsPerBatch": batch_rows}):
        runs = materialize(sorted_rows.mapInArrow(find_runs, RUN_SCHEMA), "runs")
    # two rows a range at most, so the broadcast is bounded by the number of ranges
    out = runs.join(F.broadcast(_border_groups(runs)), ["part", "run"], "left")
    chained = F.col("joined").isNotNull()
    keep = F.when(chained, F.when(~F.col("chain_keep_null"), F.col("chain_keep"))).otherwise(F.when(~F.col("keep_null"), F.col("keep")))
    return out.select(F.when(~F.col("dn"), F.col("d")).alias(id_col), keep.alias("keep_id"), F.coalesce("chain_size", "size").alias("group_size"), (F.col("head") & ~F.coalesce("joined", F.lit(False))).alias("kept"), F.col("digest").alias("text_sha256"))

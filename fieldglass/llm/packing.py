"""Concatenate and cut: documents become one endless token stream, cut into fixed windows.

Two passes. The first tokenizes every document once, writes the ids to a table in the
shared folder and notes for each document its task and its offset within that task. The totals
of the tasks (one row a task) give each task's global offset by a prefix sum. The second pass reads
the table and cuts each document at the window borders; a document that crosses a border
leaves boundary records (one piece on each side). Nothing is shuffled in either pass.

Nulls and edges: a null text packs as an empty one (only the end id); an empty table gives an
empty result; repeated rows are packed once each; rows with a null id are packed under a null id; a text of any length is cut like others.
Documents stand in the order in which their rows are dealt to tasks, so the layout (not the ids of a document) follows the files and, for small inputs, the cores.
Columns of the input other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.common import joined_id, materialize, small_batches, split_id, spread
from fieldglass.llm.tokens import encode_all

#: Ids go on in frames of about this size, so a worker holds few.
FRAME_BYTES = 2 << 20
TOKENS = "doc_id long, part int, within long, n_tokens long, ids binary"
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def token_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, end_id: int = 2) -> DataFrame:
    """First pass: one row a document with its ids (little-endian unsigned 32-bit) and its place in its task."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, within = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, coded, done, held = joined_id(batch), [], 0, 0
            for x in encode_all(batch["t"].tolist(), tokenizer_path, end_id):
                coded.append(x.astype("<u4").tobytes())
                held += len(coded[-1])
                if held < FRAME_BYTES and done + len(coded) < len(ids):
                    continue
                n = np.array([len(c) // 4 for c in coded], dtype=np.int64)
                ends = within + np.cumsum(n)
                yield pd.DataFrame({"doc_id": ids[done : done + len(n)], "part": np.int32(part), "within": ends - n, "n_tokens": n, "ids": coded})
                within, done, coded, held = int(ends[-1]), done + len(n), [], 0

    small_batches(docs.sparkSession)
    return spread(docs.select(*split_id(F.col(id_col)), F.col(text_col).alias("t"))).mapInPandas(encode, TOKENS)


def cut(tokens: DataFrame, length: int = 4096) -> DataFrame:
    """Second pass: the pieces of every document of a materialized :func:`token_table`."""
    totals = tokens.groupBy("part").agg(F.max(F.col("within") + F.col("n_tokens")).alias("n")).orderBy("part").collect()  # one row a task
    base, so_far = {}, 0
    for row in totals:
        base[row["part"]] = so_far
        so_far += row["n"]
    offsets = tokens.sparkSession.sparkContext.broadcast(base)

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            begin = batch["within"].to_numpy(np.int64) + np.array([offsets.value[p] for p in batch["part"]], dtype=np.int64)
            n = batch["n_tokens"].to_numpy(np.int64)
            first, last = begin // length, (begin + np.maximum(n, 1) - 1) // length
            row = np.repeat(np.arange(len(n)), last - first + 1)
            seq = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1)
            lo = np.maximum(begin[row], seq * length)
            hi = np.minimum((begin + n)[row], (seq + 1) * length)
            ids = batch["ids"].tolist()
            yield pd.DataFrame({
                "doc_id": joined_id(batch)[row], "start": lo - begin[row], "length": hi - lo,
                "ids": [ids[r][4 * a : 4 * b] for r, a, b in zip(row, lo - begin[row], hi - begin[row])],
                "doc_tokens": n[row], "sequence_id": seq, "offset": lo - seq * length,
            })

    return tokens.select(*split_id(F.col("doc_id")), "part", "within", "n_tokens", "ids").mapInPandas(pieces, PIECES)


def pack(docs: DataFrame, length: int = 4096, **of_tokens) -> DataFrame:
    """Pieces of all documents in sequences of ``length`` ids, without gaps; only the last may be shorter."""
    return cut(materialize(token_table(docs, **of_tokens), "tokens"), length)

"""Prefix trie of conversations by partition refinement.

A node is a distinct sequence of first turns (role and text); its name is the smallest conversation that starts with it,
together with its depth. All conversations start in one class, the root. Round d splits every active class by turn d:

1. Members of a class that have a turn d are grouped by (class, turn): each group is a child node, counted before the shuffle.
2. A group of one is retired: the rest of that conversation is a unary chain, which is written out at the end, not
   refined. The others go on as active classes; members without a further turn end at their class.
3. When no class is active, the levels fold back from the deepest to the root: children, leaves and bytes saved are sums over the children.

A turn counts by the SHA-256 digest of role and text, so texts move once. Rounds number as many as the turns that two
conversations share at most. Turns get their places in the conversation from sampled ranges and one offset a range, so
one conversation may hold most of all rows; a class may hold most of all conversations, as it is only ever
counted, joined or, for the digest of its ends, packed in pieces by ranges.

Nulls and edges: a null role or text counts as empty; a null turn comes first; turns of equal number are ordered by their
digest; repeated rows are turns of their own; rows with a null conversation are left out; an empty table gives no
node, not even a root; columns beyond those named are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.common import materialize, ordered_rows

#: Ids that are packed to one piece of a list.
PIECE = 10_000
EMPTY = hashlib.sha256(b"").hexdigest()
NODE_SCHEMA = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def numbered_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Turns (c, place, key, bytes), ``place`` counting all turns in order; conversations (c, n, first), ``first`` the place of their first turn."""
    said, who = F.coalesce(text, F.lit("")), F.coalesce(role, F.lit(""))
    key = F.unhex(F.sha2(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said), 256))
    rows = conversations.filter(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("c"), F.col(turn).alias("turn"), key.alias("key"), F.octet_length(said).cast("long").alias("bytes"))
    turns = ordered_rows(rows, ["c", F.asc_nulls_first("turn"), "key"], "turns")
    return turns, turns.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))


def rebuilt(turns: DataFrame, convs: DataFrame, every: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns come from another one: each starts with the first h turns of conversation c - c % ``every``, h = crc32(c) % ``most``.

    Returns turns (c, pos, key, bytes) and conversations (c, total), both written.
    """
    h = F.crc32(F.col("c").cast("string").cast("binary")) % most
    named = convs.select("c", "n", "first", (F.col("c") - F.col("c") % every).alias("b"), h.cast("long").alias("h"))
    base = convs.select(F.col("c").alias("b"), F.col("n").alias("n_base"))
    known = named.join(base, "b", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0)))).withColumn("total", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    known = materialize(known, "conversations")
    placed = turns.join(known, "c").withColumn("i", F.col("place") - F.col("first") + 1)
    own = placed.filter("i > h").select("c", (F.col("taken") + F.col("i") - F.col("h")).alias("pos"), "key", "bytes")
    lent = placed.filter(F.col("i") < most).select(F.col("c").alias("b"), "i", "key", "bytes")
    borrowed = lent.join(known.select("c", "b", "h"), "b").filter("i <= h").select("c", F.col("i").alias("pos"), "key", "bytes")
    return materialize(own.unionByName(borrowed).repartitionByRange("pos", "c").sortWithinPartitions("pos", "c"), "rebuilt"), known.select("c", "total")


def refine(turns: DataFrame, convs: DataFrame, root: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Per depth from 1: the groups (cls, key, node, n, bytes, total) of its round; per depth from 0: members (c, cls, total) of active classes."""
    active, groups = [convs.select("c", F.lit(root).cast("long").alias("cls"), "total")], []
    while True:
        depth = len(active)
        going = active[-1].filter(F.col("total") >= depth).join(turns.filter(F.col("pos") == depth).select("c", "key", "bytes"), "c")
        level = materialize(going.groupBy("cls", "key").agg(F.min("c").alias("node"), F.count(F.lit(1)).alias("n"), F.max("bytes").alias("bytes"), F.max("total").alias("total")), "classes")
        groups.append(level)
        split = level.filter("n > 1").select("cls", "key", "node")
        if split.isEmpty():
            return groups, active
        active.append(materialize(going.join(split, ["cls", "key"]).select("c", F.col("node").alias("cls"), "total"), "members"))


def fold(groups: list[DataFrame]) -> tuple[list[DataFrame], DataFrame]:
    """Per depth from 1: shared nodes (node, cls, n, n_children, n_leaves, saved), written; and the sums (cls, ...) below the root."""
    none = lambda c, other: F.coalesce(c, F.lit(other).cast("long"))
    shared: list[DataFrame] = []
    below = None
    for level in reversed(groups):
        nodes = level.filter("n > 1").select("node", "cls", "n", "bytes")
        if below is None:
            done = nodes.select("node", "cls", "n", F.lit(0).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), ((F.col("n") - 1) * F.col("bytes")).alias("saved"))
        else:
            kids = below.select(F.col("cls").alias("node"), F.col("n_children").alias("k"), F.col("n_leaves").alias("l"), F.col("saved").alias("s"))
            done = nodes.join(kids, "node", "left").select("node", "cls", "n", none(F.col("k"), 0).alias("n_children"), none(F.col("l"), 1).alias("n_leaves"), (none(F.col("s"), 0) + (F.col("n") - 1) * F.col("bytes")).alias("saved"))
        shared.append(materialize(done, "folded"))
        one = F.lit(1).cast("long")
        every = shared[-1].select("cls", "n_leaves", "saved").unionByName(level.filter("n = 1").select("cls", one.alias("n_leaves"), F.lit(0).cast("long").alias("saved")))
        below = every.groupBy("cls").agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    return shared[::-1], below


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ends (depth, cls, c) to pieces (depth, cls, first, ids): at most ``PIECE`` ids, comma-joined."""
    node, ids, out = None, [], []

    def piece():
        out.append((*node, ids[0], ",".join(map(str, ids))))

    for batch in batches:
        for depth, cls, c in zip(*(batch.column(k).to_pylist() for k in ("depth", "cls", "c"))):
            if node != (depth, cls) or len(ids) == PIECE:
                if ids:
                    piece()
                node, ids = (depth, cls), []
            ids.append(c)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["depth", "cls", "first", "ids"])
            out = []
    if ids:
        piece()
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["depth", "cls", "first", "ids"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to one digest a node, hashed as they pass by."""
    node, state, out = None, None, []
    names, types = ["depth", "cls", "ends"], (pa.int64(), pa.int64(), pa.string())
    for batch in batches:
        for depth, cls, ids in zip(*(batch.column(k).to_pylist() for k in ("depth", "cls", "ids"))):
            if node == (depth, cls):
                state.update(b",")
            else:
                if node:
                    out.append((*node, state.hexdigest()))
                node, state = (depth, cls), hashlib.sha256()
            state.update(ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names)
            out = []
    if node:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*node, state.hexdigest()), types)], names)


def ends_digests(ends: DataFrame) -> DataFrame:
    """depth, cls, ends: SHA-256 of the conversations that end at each node, ascending and comma-joined. A node's list is split over ranges and never held."""
    pieces = ends.repartitionByRange("depth", "cls", "c").sortWithinPartitions("depth", "cls", "c").mapInArrow(_pack, "depth long, cls long, first long, ids string")
    return pieces.repartition("depth", "cls").sortWithinPartitions("depth", "cls", "first").mapInArrow(_digest, "depth long, cls long, ends string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row a node (columns of ``NODE_SCHEMA``) of the trie over turns (c, pos from 1, key, bytes) and conversations (c, total)."""
    whole = convs.agg(F.min("c").alias("root"), F.count(F.lit(1)).alias("n")).first()
    if not whole["n"]:
        return convs.sparkSession.createDataFrame([], NODE_SCHEMA)
    groups, active = refine(turns, convs, whole["root"])
    shared, below = fold(groups)
    long = lambda x: F.lit(x).cast("long")
    # sums below the root: one row, or none if no conversation has a turn
    top = convs.sparkSession.range(1).select(long(whole["root"]).alias("node")).join(below.withColumnRenamed("cls", "node"), "node", "left")
    top = top.select("node", long(0).alias("depth"), F.lit(None).cast("long").alias("parent"), long(whole["n"]).alias("n"), F.coalesce("n_children", long(0)).alias("n_children"), F.coalesce("n_leaves", long(1)).alias("n_leaves"), F.coalesce("saved", long(0)).alias("saved"))
    levels = [top] + [x.select("node", long(d).alias("depth"), F.col("cls").alias("parent"), "n", "n_children", "n_leaves", "saved") for d, x in enumerate(shared, 1)]
    nodes = functools.reduce(DataFrame.unionByName, levels)
    ends = functools.reduce(DataFrame.unionByName, [x.filter(F.col("total") == d).select(long(d).alias("depth"), "cls", "c") for d, x in enumerate(active)])
    digests = ends_digests(ends).select(F.col("cls").alias("node"), "depth", "ends")
    inner = nodes.join(digests, ["node", "depth"], "left").select("node", "depth", "parent", "n", "n_children", "n_leaves", "saved", F.coalesce("ends", F.lit(EMPTY)).alias("ends"))
    alone = functools.reduce(DataFrame.unionByName, [x.filter("n = 1").select(F.col("node").alias("c"), "cls", "total", long(d).alias("begin")) for d, x in enumerate(groups, 1)])
    chain = turns.select("c", "pos").join(alone, "c").filter("pos >= begin")
    tail = F.when(F.col("pos") == F.col("total"), F.sha2(F.col("c").cast("string").cast("binary"), 256)).otherwise(F.lit(EMPTY))
    tails = chain.select(F.col("c").alias("node"), F.col("pos").alias("depth"), F.when(F.col("pos") == F.col("begin"), F.col("cls")).otherwise(F.col("c")).alias("parent"), long(1).alias("n"), (F.col("pos") < F.col("total")).cast("long").alias("n_children"), long(1).alias("n_leaves"), long(0).alias("saved"), tail.alias("ends"))
    return inner.unionByName(tails).toDF(*[c.split()[0] for c in NODE_SCHEMA.split(", ")])

"""SimHash near-duplicates by pigeonhole blocks.

Every text gets a 64-bit fingerprint: per bit the majority over the hashes of its word shingles. Distinct fingerprints are
classes. A fingerprint is split into ``m`` blocks; two that differ in at most ``k`` bits agree on at least
``m - k`` of them, so they share one of the C(m, k) choices of ``m - k`` blocks. Classes are joined on those keys.
Within a key's group the Hamming distances are checked and a minimum spanning forest of the pairs
within ``k`` is passed on: links enough for the same components, never all pairs. A key with many
classes is cut into chunks and every two chunks are compared in a task of their own, so groups are bounded and no pair is missed.

Nulls and edges: a null or empty text has fingerprint zero and links like any other; a null id never is a component's
smallest unless all ids of it are null; repeated rows stay rows of one component; an empty table gives an empty result; other
columns are ignored. The number of blocks grows with the number of classes so that keys stay selective;
the result does not depend on it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.llm.common import joined_id, materialize, session_settings, small_batches, split_id, spread, words, working_tables
from fieldglass.llm.components import components

CHUNK = 1024
#: Prefix keys with so many texts at most give pairs; those with more are compared in chunks.
FEW = 16
#: Texts whose frequent shingles order the prefixes; bears on speed only.
SAMPLE_TEXTS = 32_768


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of the text's word shingles in turn; a shorter text is one shingle, so is one without words."""
    w = words(text.translate(_LOWER) if text else text)
    grams = map(b" ".join, zip(*(w[i:] for i in range(shingle)))) if len(w) >= shingle else [b" ".join(w)]
    return np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), dtype="<u8")


#: The hash of the only shingle of a text without words.
NO_WORDS = xxhash.xxh64_intdigest(b"", 42)


def fingerprint(text: str | None, shingle: int) -> int:
    return majority(shingle_hashes(text, shingle))


def majority(h: np.ndarray) -> int:
    """Majority bits over the shingle hashes of a text; zero for one without words."""
    if len(h) == 1 and h[0] == NO_WORDS:
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


_LOWER = {c: c + 32 for c in range(65, 91)}


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long), text_hash: one row a document."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = np.array([fingerprint(t, shingle) for t in batch["t"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": joined_id(batch), "fp": fp, "text_hash": batch["h"]})

    small_batches(docs.sparkSession)
    rows = docs.select(*split_id(F.col(id_col)), F.col(text_col).alias("t"), F.xxhash64(text_col).alias("h"))
    return spread(rows).mapInPandas(each, "doc_id long, fp long, text_hash long")


def block_masks(n: int, k: int) -> list[int]:
    """Masks (signed) of the choices of blocks on which two of ``n`` fingerprints within ``k`` bits must agree."""
    m = k + 1
    while (m - k) * (64 // m) < math.log2(max(n, 2)) + 2 and m < k + 8:
        m += 1
    edges = [64 * i // m for i in range(m + 1)]
    blocks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(m)]
    masks = [sum(c) for c in combinations(blocks, m - k)]
    return [x - (1 << 64) if x >= 1 << 63 else x for x in masks]


def _forest(fp: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of a minimum spanning forest over the pairs within ``k`` bits (Prim's method on one vector at a time)."""
    n, a, b = len(fp), [], []
    best, whence, open_ = np.full(n, 255, dtype=np.uint8), np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    at = 0
    while True:
        open_[at] = False
        d = np.bitwise_count(fp ^ fp[at]).astype(np.uint8)
        nearer = d < best
        best[nearer], whence[nearer] = d[nearer], at
        left = np.where(open_, best, 255)
        nxt = int(left.argmin())
        if left[nxt] == 255:
            return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
        if left[nxt] <= k:
            a.append(whence[nxt])
            b.append(nxt)
        at = nxt


def links(classes: DataFrame, n: int, k: int, reach: int | None = None) -> DataFrame:
    """(a, b): class representatives ``rep`` whose fingerprints ``fp`` are within ``k`` bits, enough to connect them all.

    With a larger ``reach``, also those up to ``reach`` bits apart that happen to share a key; such pairs are found with high probability only.
    """
    reach = reach or k
    keys = classes.select("fp", "rep", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(x)) for x in block_masks(n, k)])).alias("c", "key"))
    live = keys.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("c", "key"))).filter("n > 1")
    few = live.filter(F.col("n") <= CHUNK).select("c", "key", F.lit(0).alias("lo"), F.lit(0).alias("hi"), "fp", "rep")
    many = live.filter(F.col("n") > CHUNK).withColumn("q", F.ceil(F.col("n") / CHUNK).cast("int"))
    many = many.withColumn("i", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("q")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("q") - 1)))
    live = few.unionByName(many.select("c", "key", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "fp", "rep"))
    group = ["c", "key", "lo", "hi"]

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tail = None
        for batch in batches:
            batch = batch if tail is None else pd.concat([tail, batch], ignore_index=True)
            ids = batch[group].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]).any(axis=1)]))
            tail = batch.iloc[starts[-1] :]
            yield _pairs(batch["fp"].to_numpy(np.int64).view(np.uint64), batch["rep"].to_numpy(np.int64), starts)
        if tail is not None and len(tail):
            yield _pairs(tail["fp"].to_numpy(np.int64).view(np.uint64), tail["rep"].to_numpy(np.int64), np.array([0, len(tail)]))

    def _pairs(fp: np.ndarray, rep: np.ndarray, starts: np.ndarray) -> pd.DataFrame:
        sizes = np.diff(starts)
        two = starts[:-1][sizes == 2]
        two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= reach]
        a, b = [rep[two]], [rep[two + 1]]
        for s, n in zip(starts[:-1][sizes > 2], sizes[sizes > 2]):
            x, y = _forest(fp[s : s + n], reach)
            a.append(rep[s + x])
            b.append(rep[s + y])
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    found = live.repartition(*group).sortWithinPartitions(*group).mapInPandas(verify, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 4, max_distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, text_hash, component_id (the smallest id reachable over links): one row a document."""
    prints = materialize(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    by_print = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    # a class of null ids only gets a negative stand-in, so that it can still connect others
    classes = materialize(by_print.withColumn("rep", F.coalesce("least", F.lit(-(1 << 62)) + F.shiftrightunsigned("fp", 2))), "classes")
    groups = components(links(classes, classes.count(), max_distance))
    placed = classes.join(groups, F.col("rep") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "rep").alias("group"))
    smallest = placed.groupBy("group").agg(F.min("least").alias("component_id"))
    of_print = placed.join(smallest, "group").select(F.col("fp").alias("its"), "component_id", "group")
    return prints.join(of_print, F.col("fp") == F.col("its")).select("doc_id", "fp", "text_hash", "component_id", "group")


def prefix(s: np.ndarray, least: float, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first members of a set, uncommon ones first: two sets of similarity ``least`` or more share one of these.

    They have ``least`` times the larger size in common, so not all of that lies behind either's first ``n - ceil(least * n) + 1``.
    This holds for any order; ``common`` (sorted) and ``rank`` (more for more frequent) only keep the keys selective.
    """
    r = np.zeros(len(s), dtype=np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
        r = np.where(common[at] == s, rank[at], 0)
    return s[np.lexsort((s, r))[: len(s) - math.ceil(least * len(s) - 1e-9) + 1]]


def parity(s: np.ndarray) -> bytes:
    """Whether each residue of a set's members is held an odd number of times, one bit each; as many residues as the power of two not below the size (64 at least).

    Two sets differ in at least as many members as these bits do. Bits of more residues, halved by exclusive or, are those of fewer.
    """
    width = 1 << max(6, math.ceil(math.log2(max(len(s), 1))))
    return np.packbits(np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1 == 1, bitorder="little").tobytes()


def _halved(bits: list[bytes], width: int) -> np.ndarray:
    """Parities as rows of ``width`` bytes."""
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(b, np.uint8).reshape(-1, width), axis=0) for b in bits]).view(np.uint64)


def _may_differ(size, other, least: float):
    """In how many members two sets of such sizes differ at most, if their similarity is ``least`` or more."""
    return (size + other) * ((1 - least) / (1 + least)) + 1e-9


def _common(docs: DataFrame, shingle: int, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of about ``SAMPLE_TEXTS`` texts, sorted, and their ranks."""
    texts = docs.select(F.col(text_col).alias("t"), F.xxhash64(text_col).alias("h"))
    every = max(1, docs.count() // SAMPLE_TEXTS)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"s": np.concatenate([np.unique(shingle_hashes(t, shingle)) for t in batch["t"]] or [np.zeros(0, "<u8")]).view(np.int64)})

    seen = texts.filter(F.pmod(F.xxhash64("h"), F.lit(every)) == 0).mapInPandas(each, "s long")
    frequent = materialize(seen.groupBy("s").count().filter("count > 2"), "frequent")
    # as columns: as rows, each would be objects on the driver, many times its 16 bytes
    with session_settings(docs.sparkSession, {"spark.sql.execution.arrow.pyspark.enabled": "true"}):
        top = frequent.orderBy(F.desc("count"), "s").limit(1 << 18).toPandas()
    values = top["s"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(values)
    return values[order], (len(values) - np.arange(len(values)))[order]


def prefixes(docs: DataFrame, shingle: int, least: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, fp, size (of the shingle set), bits (its :func:`parity`), keys (its prefix): one row a document, each text hashed once."""
    spark = docs.sparkSession
    small_batches(spark)
    order = spark.sparkContext.broadcast(_common(docs, shingle, text_col))  # at most 262,144 shingles

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            grams = [shingle_hashes(t, shingle) for t in batch["t"]]
            fp = np.array([majority(g) for g in grams], dtype=np.uint64).view(np.int64)
            sets = [np.unique(g) for g in grams]
            keys = [prefix(s, least, *order.value).view(np.int64) for s in sets]
            yield pd.DataFrame({"doc_id": joined_id(batch), "text_hash": batch["h"], "fp": fp, "size": [len(s) for s in sets], "bits": [parity(s) for s in sets], "keys": keys})

    rows = docs.select(*split_id(F.col(id_col)), F.col(text_col).alias("t"), F.xxhash64(text_col).alias("h"))
    return spread(rows).mapInPandas(each, "doc_id long, text_hash long, fp long, size int, bits binary, keys array<long>")


def likely(pairs: DataFrame, marks: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets, by their sizes and parities (``marks``: h, size, bits), can have a similarity of ``least``: all that have, and few others.

    So texts, which are many times as long, are only sent for these. Pairs that share a shingle by chance grow faster than the table, similar ones do not.
    """
    first = pairs.join(marks.withColumnsRenamed({"h": "a", "size": "sa", "bits": "ba"}), "a")
    both = first.join(marks.withColumnsRenamed({"h": "b", "size": "sb", "bits": "bb"}), "b")

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            most = _may_differ(batch["sa"].to_numpy(np.int64), batch["sb"].to_numpy(np.int64), least)
            differ = [int(np.bitwise_count(np.bitwise_xor(*_halved([x, y], min(len(x), len(y))))).sum()) for x, y in zip(batch["ba"], batch["bb"])]
            yield batch.loc[np.array(differ, dtype=np.int64) <= most, ["a", "b"]]

    return both.select("a", "b", "sa", "sb", "ba", "bb").mapInPandas(close, "a long, b long")


def _partners(size: np.ndarray, group: np.ndarray, early: np.ndarray, bits: list[bytes], least: float) -> np.ndarray:
    """Which of these texts have another of a different group beside them that, by sizes and parities, can be similar, the smaller of both ``early``."""
    order = np.argsort(size, kind="stable")
    size, group, early, bits = size[order], group[order], early[order], [bits[i] for i in order]
    alike = np.concatenate([[0], np.flatnonzero(size[1:] != size[:-1]) + 1, [len(size)]])
    # of sets of one size either may be the early one
    early = np.repeat(np.logical_or.reduceat(early, alike[:-1]), np.diff(alike))
    stop = np.searchsorted(size, size / least + 1e-9, "right")
    width = np.array([len(b) for b in bits])
    found = np.zeros(len(size), dtype=bool)
    for w in np.unique(width):
        lo, hi = np.searchsorted(width, [w, w + 1])
        rows = _halved(bits[lo : int(stop[hi - 1])], int(w))
        for i in lo + np.flatnonzero(early[lo:hi]):
            other = i + 1 + np.flatnonzero((group[i + 1 : stop[i]] != group[i]) & ~(found[i] & found[i + 1 : stop[i]]))
            if len(other):
                near = other[np.bitwise_count(rows[other - lo] ^ rows[i - lo]).sum(axis=1) <= _may_differ(size[i], size[other], least)]
                found[near], found[i] = True, found[i] or len(near) > 0
    out = np.empty(len(size), dtype=bool)
    out[order] = found
    return out


def _chunked(live: DataFrame) -> DataFrame:
    """Rows of keys that ``n`` texts share, with (lo, hi): every two chunks of a key's texts meet in a group (key, lo, hi)."""
    q = F.ceil(F.col("n") / CHUNK).cast("int")
    parts = live.withColumn("i", F.pmod(F.xxhash64("h", F.lit(1)), q).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), q - 1)))
    return parts.withColumns({"lo": F.least("i", "j"), "hi": F.greatest("i", "j")}).drop("i", "j")


def with_partners(live: DataFrame, marks: DataFrame, least: float) -> DataFrame:
    """key, pos, h, size of those rows of ``live`` (see :func:`_apart`) that can be similar to another text of their key and of a different group."""
    group = ["key", "lo", "hi"]
    columns = ["key", "pos", "h", "size"]
    rows = _chunked(live).select(*group, "pos", "h", "size", "g", "early").join(marks.select("h", "bits"), "h")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tail = None
        for batch in batches:
            batch = batch if tail is None else pd.concat([tail, batch], ignore_index=True)
            ids = batch[group].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]).any(axis=1)])) if len(batch) else np.zeros(1, np.int64)
            tail = batch.iloc[starts[-1] :]
            yield _left(batch, starts)
        if tail is not None and len(tail):
            yield _left(tail, np.array([0, len(tail)]))

    def _left(batch: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        size, g, early, bits = batch["size"].to_numpy(np.int64), batch["g"].to_numpy(np.int64), batch["early"].to_numpy(bool), batch["bits"].tolist()
        left = np.zeros(len(batch), dtype=bool)
        for a, b in zip(starts[:-1], starts[1:]):
            left[a:b] = _partners(size[a:b], g[a:b], early[a:b], bits[a:b], least)
        return batch.loc[left, columns]

    return rows.repartition(*group).sortWithinPartitions(*group).mapInPandas(verify, "key long, pos int, h long, size int").distinct()


def _needed(docs: DataFrame, ends: DataFrame, text_col: str) -> DataFrame:
    """h, t: the texts whose hashes are among ``ends`` (h), once each."""
    hashed = docs.select(F.xxhash64(text_col).alias("h"), F.col(text_col).alias("t"))
    return hashed.join(ends.distinct(), "h", "left_semi").dropDuplicates(["h"])


def confirm(pairs: DataFrame, docs: DataFrame, shingle: int, least: float, text_col: str = "text") -> DataFrame:
    """The pairs (a, b: hashes of texts) whose sets of word shingles have a Jaccard similarity of at least ``least``."""
    texts = _needed(docs, pairs.select(F.col("a").alias("h")).unionByName(pairs.select(F.col("b").alias("h"))), text_col)
    first = pairs.join(texts.withColumnsRenamed({"h": "a", "t": "ta"}), "a")
    both = first.join(texts.withColumnsRenamed({"h": "b", "t": "tb"}), "b")

    def similar(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            near = [_jaccard(x, y, shingle) >= least for x, y in zip(batch["ta"], batch["tb"])]
            yield batch.loc[near, ["a", "b"]]

    return both.select("a", "b", "ta", "tb").mapInPandas(similar, "a long, b long")


def _shingles(text: str | None, shingle: int) -> set[tuple]:
    w = words(text.translate(_LOWER) if text else text)
    return set(zip(*(w[i:] for i in range(shingle)))) if len(w) >= shingle else {tuple(w)}


def _jaccard(x: str | None, y: str | None, shingle: int) -> float:
    a, b = _shingles(x, shingle), _shingles(y, shingle)
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def _placed(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows with the group ``g`` of their text ``h``; a text that no link has reached is a group of its own."""
    return rows.join(groups, F.col("h") == F.col("node"), "left").withColumn("g", F.coalesce("component", "h")).drop("node", "component")


def _apart(placed: DataFrame, least: float) -> DataFrame:
    """Rows (key, pos, h, size, g) whose key is held by texts of different groups, with the key's rows ``n`` and ``early``.

    If a key is the first that two similar sets share, nothing before it counts, so in the smaller set it is among the
    first ``n - ceil(2 * least / (1 + least) * n) + 1``: it is ``early`` there. A key that is early nowhere is dropped.
    Rows are dealt by key once, and what is known of a key is found in that dealing; a key with very many texts is some narrow rows in one task.
    """
    early = F.col("pos") <= F.col("size") - F.ceil(F.col("size") * (2 * least / (1 + least)) - 1e-9)
    key = Window.partitionBy("key")
    rows = placed.select("key", "pos", "h", "size", "g", early.alias("early"))
    known = rows.select("*", F.min("g").over(key).alias("lo"), F.max("g").over(key).alias("hi"), F.max("early").over(key).alias("any"), F.count(F.lit(1)).over(key).alias("n"))
    return known.filter("lo <> hi and any").drop("lo", "hi", "any")


def _joined(sets: list[np.ndarray], group: np.ndarray, early: np.ndarray, least: float) -> Iterator[tuple[int, int]]:
    """Positions of pairs of similarity ``least`` or more, whose smaller is ``early``, enough to connect the groups that such pairs connect."""
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    size, early, label = size[order], early[order], np.unique(group[order], return_inverse=True)[1]
    ids = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)[1]
    ends = np.concatenate([[0], np.cumsum(size)])
    mark = np.zeros(int(ids.max()) + 1, dtype=np.int32)
    alike = np.concatenate([[0], np.flatnonzero(size[1:] != size[:-1]) + 1, [len(size)]])
    # of sets of one size either may be the early one
    early = np.repeat(np.logical_or.reduceat(early, alike[:-1]), np.diff(alike))
    for i in np.flatnonzero(early[:-1]):
        stop = int(np.searchsorted(size, size[i] / least + 1e-9, "right"))
        other = i + 1 + np.flatnonzero(label[i + 1 : stop] != label[i])
        if not len(other):
            continue
        mark[ids[ends[i] : ends[i + 1]]] = 1
        # those of other groups only: gathered where they are few, else summed over the whole range
        if 8 * len(other) < stop - i:
            both = np.array([mark[ids[ends[j] : ends[j + 1]]].sum() for j in other])
        else:
            both = np.add.reduceat(mark[ids[ends[i + 1] : ends[stop]]], ends[i + 1 : stop] - ends[i + 1])[other - i - 1]
        mark[ids[ends[i] : ends[i + 1]]] = 0
        for j in other[both / (size[i] + size[other] - both) >= least]:
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                yield order[i], order[j]


def all_links(live: DataFrame, docs: DataFrame, shingle: int, least: float, text_col: str = "text") -> DataFrame:
    """(a, b) for rows (key, h, g, early, n): every two chunks of a key's ``n`` texts are compared whole in a task, which passes a forest on."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"h": batch["h"], "s": [np.unique(shingle_hashes(t, shingle)).tobytes() for t in batch["t"]]})

    sets = _needed(docs, live.select("h"), text_col).mapInPandas(hashed, "h long, s binary")
    group = ["key", "lo", "hi"]
    rows = _chunked(live).select(*group, "h", "g", "early").join(sets, "h")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, []
        for batch in batches:
            for at, *row in zip(zip(*(batch[c] for c in group)), batch["h"], batch["g"], batch["early"], batch["s"]):
                if at != last and held:
                    yield _edges(held)
                    held = []
                last = at
                held.append(row)
        if held:
            yield _edges(held)

    def _edges(held: list) -> pd.DataFrame:
        h = np.array([r[0] for r in held], dtype=np.int64)
        found = list(_joined([np.frombuffer(r[3], dtype="<u8") for r in held], np.array([r[1] for r in held], dtype=np.int64), np.array([r[2] for r in held], dtype=bool), least))
        at = np.array(found, dtype=np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": h[at[:, 0]], "b": h[at[:, 1]]})

    return rows.repartition(*group).sortWithinPartitions(*group).mapInPandas(verify, "a long, b long").distinct()


def similar_texts(docs: DataFrame, shingle: int = 5, least: float = 0.8, guaranteed: int = 4, reach: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, group: the connected components of texts over all pairs of similarity ``least`` or more.

    Nodes are distinct texts (by 64-bit hash). Fingerprints come first: texts of one fingerprint, and forests of those that share a block
    key, are confirmed on their shingle sets, which joins most families cheaply. Whatever they miss is found after that: texts
    of different groups that share a member of their prefixes (see :func:`prefix`) are all compared, those of keys
    with few texts as pairs, the others in chunks. So the result does not depend on ``guaranteed``, ``reach`` or the number of texts.
    Before texts are sent anywhere, sizes and parities of their sets (see :func:`parity`), a fortieth as long, rule out nearly all that are not similar, and never one that is.
    Texts that keys with many texts hold together are compared in one place, each text there once, where there are at most ``CHUNK`` of them;
    beyond, key by key, each text's widest key first, which unites most of a large family, so little is left to compare under its other keys.

    Nulls and edges: null and empty texts are one text each without words; null ids and repeated rows keep their rows; an empty table gives an empty result.
    """
    with working_tables(docs.sparkSession) as tables:
        groups = materialize(_similar(docs, shingle, least, guaranteed, reach, id_col, text_col), "groups")
        tables.pop()  # stays, all others go
    return groups


def _similar(docs: DataFrame, shingle: int, least: float, guaranteed: int, reach: int, id_col: str, text_col: str) -> DataFrame:
    prints = materialize(prefixes(docs, shingle, least, id_col, text_col), "prefixes")
    texts = prints.select("text_hash", "fp", "size", "keys").dropDuplicates(["text_hash"])
    classes = materialize(prints.groupBy("fp").agg(F.min("text_hash").alias("rep")), "classes")
    same = prints.select("fp", "text_hash").distinct().join(classes, "fp").filter(~F.col("text_hash").eqNullSafe(F.col("rep"))).select(F.col("rep").alias("a"), F.col("text_hash").alias("b"))
    marks = prints.select(F.col("text_hash").alias("h"), "size", "bits").dropDuplicates(["h"])
    close = materialize(likely(links(classes, classes.count(), guaranteed, reach).unionByName(same), marks, least), "close")
    groups = components(materialize(confirm(close, docs, shingle, least, text_col), "links"))
    # texts meet their groups before their keys are listed, which are many more
    placed = _placed(texts.select(F.col("text_hash").alias("h"), "size", "keys"), groups)
    live = materialize(_apart(placed.select("h", "size", "g", F.posexplode("keys").alias("pos", "key")), least), "shared")
    few = live.filter(F.col("n") <= FEW)
    other = few.select("key", F.col("h").alias("b"), F.col("g").alias("gb"), F.col("size").alias("size_b"), F.col("pos").alias("pos_b"))
    # similar sets have so much in common, and all of it from their first shared key on
    both = (F.col("size") + F.col("size_b")) * (least / (1 + least)) - 1e-9
    near = few.join(other, "key").filter((F.col("h") < F.col("b")) & (F.col("g") != F.col("gb")) & (F.least(F.col("size") - F.col("pos"), F.col("size_b") - F.col("pos_b")) >= both))
    pairs = materialize(likely(near.select(F.col("h").alias("a"), "b").distinct(), marks, least), "pairs")

    def joined(found: DataFrame) -> None:
        nonlocal groups
        found = materialize(found, "links")
        if not found.isEmpty():
            groups = components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(found))

    joined(confirm(pairs, docs, shingle, least, text_col))
    wide = live.filter(F.col("n") > FEW).drop("g", "early", "n")
    # keys that texts share by chance go before sets are sent and before texts of common keys count as held together
    wide = materialize(with_partners(_apart(_placed(wide, groups), least), marks, least), "wide")
    many = materialize(_apart(_placed(wide, groups), least), "shared")
    if not many.isEmpty():
        bins = components(many.select(F.col("h").alias("a"), F.col("key").alias("b")))
        own = many.select("h", "g").distinct().join(bins, F.col("h") == F.col("node")).select(F.col("component").alias("key"), "h", "g")
        sizes = own.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        joined(all_links(own.join(sizes.filter(F.col("n") <= CHUNK), "key").withColumn("early", F.lit(True)), docs, shingle, least, text_col))
        large = bins.join(sizes.filter(F.col("n") > CHUNK), F.col("component") == F.col("key")).select(F.col("node").alias("h"))
        wide = materialize(wide.join(large, "h", "left_semi"), "wide")
        for first in (True, False):
            many = materialize(_apart(_placed(wide, groups), least), "shared")
            if many.isEmpty():
                break
            if first:
                widest = many.groupBy("h").agg(F.max(F.struct("n", "key")).alias("x")).select(F.col("h").alias("own"), F.col("x.key").alias("at"))
                many = many.join(widest, (F.col("h") == F.col("own")) & (F.col("key") == F.col("at"))).select("key", "h", "g", "early", "n")
            joined(all_links(many, docs, shingle, least, text_col))
    return prints.join(groups, F.col("text_hash") == F.col("node"), "left").select("doc_id", "text_hash", F.coalesce("component", "text_hash").alias("group"))


def keep_one(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each group (doc_id, text_hash, group) the smallest id (null last), once.

    Texts are dealt once, by id and hash; repeated rows are dropped and the rest is joined within that dealing. All columns stay, whatever their names.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "text_hash")).alias("first")
    stays = groups.groupBy("group").agg(first).select(F.col("first.none").alias("none"), F.col("first.id").alias("id"), F.coalesce("first.text_hash", F.lit(0)).alias("hash"))
    own = docs.select(F.col(id_col).isNull().alias("none"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"), F.xxhash64(text_col).alias("hash"), F.struct("*").alias("row"))
    key = ["none", "id", "hash"]
    return own.repartition(*key).dropDuplicates(key).join(stays, key).select("row.*")

"""Substring dedup with repeated-phrase automata.

A *window* is ``window`` consecutive words of a document. A word is removed when a window that covers it
has a word sequence that starts earlier: in a smaller doc_id, or further left in the same document. The work
runs over shards of whole documents, about ``shard_mb`` of text each, dealt by a hash of the id:

1. *Candidates.* Each window is marked by its smallest ``gram``-word hash (its anchor), so equal windows have equal anchors.
   Every shard sends the distinct anchors it holds, packed by hash range (one range for every ``PER_RANGE`` shards). Anchors seen twice come
   back, with the number of shards that hold them.
2. *Confirmation.* For windows with a recurring anchor each shard sends anchor, window hash (together 128 bits) and the
   first place in the shard, packed by hash range: once a shard, however many copies it holds. An anchor that very many shards hold, like
   that of a line in ever other surroundings, is split by window hash into as many parts as keep ``PER_PART`` shards each.
   The least place of all shards is where the passage first stands. Each shard gets back those of its
   passages that recur, as runs of consecutive windows with the place where each first stands.
3. *Automata.* Each shard compiles its confirmed passages into an Aho-Corasick automaton (phrases
   spaced so that every window has one; matches are widened as text) and streams all its documents through it. Every occurrence
   but the first one of all is marked, and the words under the marks go.

Texts are dealt once; the three passes read the same exchange. Sizes of all messages are bounded by the
shard, so a passage that a third of all documents share costs one row a shard.

Nulls and edges: a null or empty text has no words; rows with equal ids are ordered by their text, then any order (they
are equal); a null id counts as larger than any other; an empty table gives an empty result; other columns stay as they are.
"""

from __future__ import annotations


import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.common import joined_id, shards_for, split_id, words

LAST = (1 << 63) - 1
#: Shards whose anchors meet in one task, and shards whose windows of one anchor do.
PER_RANGE, PER_PART = 16, 64


def _powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of a base modulo 2**64."""
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shard:
    """The documents of a shard in order, as one buffer of words joined by single spaces, with hashes of word ranges."""

    def __init__(self, docs: pd.DataFrame):
        ids = np.where(docs["dn"].to_numpy(bool), LAST, docs["d"].to_numpy(np.int64))
        split = [words(t) for t in docs["t"]]
        texts = [b" ".join(w) for w in split]
        order = sorted(range(len(texts)), key=lambda i: (ids[i], texts[i]))
        self.rows = np.array(order, dtype=np.int64)
        self.doc = ids[self.rows]
        self.texts = [texts[i] for i in order]
        self.n_words = np.array([len(split[i]) for i in order], dtype=np.int64)
        new = np.concatenate([[True], self.doc[1:] != self.doc[:-1]]) if len(order) else np.zeros(0, bool)
        begun = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0)) if len(order) else np.zeros(0, np.int64)
        self.sub = np.arange(len(new)) - begun  # which row of its id
        self.first = np.concatenate([[0], np.cumsum(self.n_words)]).astype(np.int64)

    def windows(self, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of every window: its first word (counted over the shard), its document, its anchor's word and hash."""
        full = [t for t in self.texts if t]
        buffer = np.frombuffer(b" ".join(full), dtype=np.uint8)
        n = int(self.first[-1])
        gaps = np.flatnonzero(buffer == 32)
        self.start, self.end = np.concatenate([[0], gaps + 1])[:n], np.concatenate([gaps, [len(buffer)]])[:n]
        self.buffer = buffer
        doc = np.repeat(np.arange(len(self.doc)), self.n_words)
        if n < window:
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
        h = self.hashes(np.arange(n - gram + 1), gram, 0x9E3779B97F4A7C15)
        least, at, done, span = h, np.arange(len(h)), 1, window - gram + 1
        while done < span:
            step = min(done, span - done)
            lower = least[step:] < least[:-step]
            least, at, done = np.where(lower, least[step:], least[:-step]), np.where(lower, at[step:], at[:-step]), done + step
        inside = np.flatnonzero(doc[: n - window + 1] == doc[window - 1 :])
        return inside, doc[inside], at[inside], least[inside]

    def hashes(self, begin: np.ndarray, length: int, base: int) -> np.ndarray:
        """64-bit hashes of the ranges of ``length`` words that begin at the given words."""
        total = np.zeros(len(self.buffer) + 1, dtype=np.uint64)
        np.multiply(_powers(base, len(self.buffer)), self.buffer + np.uint64(1), out=total[1:])
        np.cumsum(total, out=total)
        lo, hi = self.start[begin], self.end[begin + length - 1]
        h = total[hi] - total[lo]
        del total
        return _mixed(h * _powers(pow(base, -1, 1 << 64), len(self.buffer) + 1)[lo])


def _ranges(h: np.ndarray, parts: int) -> np.ndarray:
    """Range of a hash; rises with it."""
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _bytes(*arrays: np.ndarray) -> list[bytes]:
    return [np.ascontiguousarray(a).tobytes() for a in arrays]


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, gram: int = 8, shard_mb: float = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space), and the columns in ``keep``: one row a document."""
    n = shards_for(docs, text_col, shard_mb)
    # a text that is kept goes once; all passes take the same columns, so that they read one exchange
    carried = ["t" if c == text_col else f"k{i}" for i, c in enumerate(keep)]
    rows = docs.select(*split_id(F.col(id_col)), F.col(text_col).alias("t"), *(F.col(c).alias(k) for c, k in zip(keep, carried) if k != "t"))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("d", "dn"), F.lit(n)).cast("int")).repartition(n, "shard")
    n_ranges, per_part = -(-n // PER_RANGE), PER_PART

    def send_anchors(docs: pd.DataFrame) -> pd.DataFrame:
        _, _, at, h = Shard(docs).windows(window, gram)
        _, one = np.unique(at, return_index=True)
        u, times = np.unique(h[one], return_counts=True)
        parts = _ranges(u, n_ranges)
        cuts = np.searchsorted(parts, np.arange(n_ranges + 1))
        out = [(int(p), int(docs["shard"].iloc[0]), *_bytes(u[a:b], times[a:b] > 1)) for p in np.unique(parts) for a, b in [(cuts[p], cuts[p + 1])]]
        return pd.DataFrame(out, columns=["part", "shard", "h", "twice"])

    def find_recurring(sent: pd.DataFrame) -> pd.DataFrame:
        h = [np.frombuffer(x, np.uint64) for x in sent["h"]]
        twice = np.concatenate([np.frombuffer(x, bool) for x in sent["twice"]])
        u, where, times = np.unique(np.concatenate(h), return_inverse=True, return_counts=True)
        often = times > 1
        often[where[twice]] = True
        found = []
        for s, x in zip(sent["shard"], h):
            at = np.searchsorted(u, x)
            pick = often[at]
            found.append((int(s), *_bytes(x[pick], times[at[pick]].astype(np.uint32))))
        return pd.DataFrame([x for x in found if x[1]], columns=["shard", "h", "held"])

    def send_windows(docs: pd.DataFrame, recurring: pd.DataFrame) -> pd.DataFrame:
        columns = ["part", "sub", "shard", "anchor", "doc", "key", "n", "w", "twice"]
        if not len(docs) or not len(recurring):
            return pd.DataFrame(columns=columns)
        shard = Shard(docs)
        word, doc, at, h = shard.windows(window, gram)
        known, held = np.concatenate([np.frombuffer(x, np.uint64) for x in recurring["h"]]), np.concatenate([np.frombuffer(x, np.uint32) for x in recurring["held"]])
        by_hash = np.argsort(known)
        known, held = known[by_hash], held[by_hash]
        spot = np.minimum(np.searchsorted(known, h), len(known) - 1)
        pick = np.flatnonzero(known[spot] == h)
        word, doc, at, h, held = word[pick], doc[pick], at[pick], h[pick], held[spot[pick]].astype(np.int64)
        w = shard.hashes(word, window, 0xC2B2AE3D27D4EB4F)
        order = np.lexsort((word, w, h))
        fresh = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (w[order][1:] != w[order][:-1])]) if len(order) else np.zeros(0, bool)
        heads = np.flatnonzero(fresh)
        times = np.diff(np.concatenate([heads, [len(order)]]))
        one = order[heads]
        by_place = np.argsort(one)
        one, times = one[by_place], times[by_place]
        word, doc, at, h, w, held = word[one], doc[one], at[one], h[one], w[one], held[one]
        part, sub = _ranges(h, n), (w % (-(-held // per_part)).astype(np.uint64)).astype(np.int64)
        order = np.lexsort((np.arange(len(part)), sub, part))
        word, doc, at, h, w, times, part, sub = (x[order] for x in (word, doc, at, h, w, times, part, sub))
        other = (part[1:] != part[:-1]) | (sub[1:] != sub[:-1])
        head = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (word[1:] != word[:-1] + 1) | other])) if len(at) else np.zeros(0, np.int64)
        size = np.diff(np.concatenate([head, [len(at)]]))
        key = (shard.sub[doc] << 32) + word - shard.first[doc]
        out = []
        begins = np.concatenate([[0], np.flatnonzero(other) + 1]) if len(at) else np.zeros(0, np.int64)
        for a, b in zip(begins, np.append(begins[1:], len(at))):
            i, j = np.searchsorted(head, [a, b])
            x = head[i:j]
            out.append((int(part[a]), int(sub[a]), int(docs["shard"].iloc[0]), *_bytes(h[x], shard.doc[doc[x]], key[x], size[i:j].astype(np.uint16), w[a:b], times[a:b] > 1)))
        return pd.DataFrame(out, columns=columns)

    def confirm(sent: pd.DataFrame) -> pd.DataFrame:
        anchor, doc, key, size, w, twice = (np.concatenate([np.frombuffer(x, kind) for x in sent[c]]) for c, kind in (("anchor", np.uint64), ("doc", np.int64), ("key", np.int64), ("n", np.uint16), ("w", np.uint64), ("twice", bool)))
        runs = np.repeat(np.arange(len(size)), size)
        source = np.repeat(np.arange(len(sent)), [len(x) // 8 for x in sent["w"]])
        shard = sent["shard"].to_numpy(np.int64)[source]
        offset = np.arange(len(runs)) - np.repeat(np.cumsum(size.astype(np.int64)) - size, size)
        anchor, doc, key = anchor[runs], doc[runs], key[runs] + offset
        order = np.lexsort((key, doc, w, anchor))
        fresh = np.concatenate([[True], (anchor[order][1:] != anchor[order][:-1]) | (w[order][1:] != w[order][:-1])])
        head = np.flatnonzero(fresh)
        times = np.diff(np.concatenate([head, [len(order)]]))
        first_of = np.empty(len(order), dtype=np.int64)
        first_of[order] = np.repeat(order[head], times)
        alone = np.empty(len(order), dtype=bool)
        alone[order] = np.repeat(times == 1, times)
        # a passage matters to a shard unless its only place there is the first of all
        use = np.flatnonzero((first_of != np.arange(len(order))) | twice)
        use = use[~(alone[use] & ~twice[use])]
        if not len(use):
            return pd.DataFrame(columns=["shard", "runs"])
        by = use[np.lexsort((key[use], doc[use], shard[use]))]
        table = np.stack([doc[by], key[by], np.ones(len(by), np.int64), doc[first_of[by]], key[first_of[by]]], axis=1)
        found, own = [], shard[by]
        for s in np.unique(own):
            found.append((int(s), _runs(table[own == s] if len(np.unique(own)) == 1 else table[slice(*np.searchsorted(own, [s, s + 1]))]).tobytes()))
        return pd.DataFrame(found, columns=["shard", "runs"])

    def mark(docs: pd.DataFrame, confirmed: pd.DataFrame) -> pd.DataFrame:
        shard = Shard(docs)
        removed = locate(shard, [np.frombuffer(x, np.int64).reshape(-1, 5) for x in confirmed["runs"]], window)
        left = []
        for text, gone in zip(shard.texts, removed):
            left.append(text if gone is None else b" ".join([x for x, out in zip(text.split(b" "), gone) if not out]))
        out = docs.iloc[shard.rows].reset_index(drop=True)
        result = pd.DataFrame({"doc_id": joined_id(out), "n_words": shard.n_words, "n_removed": [0 if g is None else int(g.sum()) for g in removed], "kept": [x.decode("utf-8", "surrogatepass") for x in left]})
        return result.assign(**{f"k{i}": out[k] for i, k in enumerate(carried)})

    anchors = rows.groupBy("shard").applyInPandas(send_anchors, "part int, shard int, h binary, twice binary")
    recurring = anchors.groupBy("part").applyInPandas(find_recurring, "shard int, h binary, held binary")
    sent = rows.groupBy("shard").cogroup(recurring.groupBy("shard")).applyInPandas(send_windows, "part int, sub int, shard int, anchor binary, doc binary, key binary, n binary, w binary, twice binary")
    confirmed = sent.groupBy("part", "sub").applyInPandas(confirm, "shard int, runs binary")
    types = {c: t for c, t in rows.dtypes}
    schema = "doc_id long, n_words long, n_removed long, kept string" + "".join(f", k{i} {types[k]}" for i, k in enumerate(carried))
    result = rows.groupBy("shard").cogroup(confirmed.groupBy("shard")).applyInPandas(mark, schema)
    return result.withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})


def _runs(table: np.ndarray) -> np.ndarray:
    """Joins rows (document, place, windows, first document, first place) that follow one another in both."""
    if not len(table):
        return table
    doc, key, size, f_doc, f_key = table.T
    head = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1] + size[:-1]) | (f_doc[1:] != f_doc[:-1]) | (f_key[1:] != f_key[:-1] + size[:-1])]))
    joined = table[head].copy()
    joined[:, 2] = np.add.reduceat(size, head)
    return joined


def _spaces(text: str) -> np.ndarray:
    return np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) == 32)


def _agree(text: str, i: int, passage: str, j: int) -> int:
    """How many characters agree from ``text[i]`` and ``passage[j]`` on."""
    low, high = 0, min(len(text) - i, len(passage) - j)
    if text.startswith(passage[j : j + high], i):
        return high
    while low + 1 < high:
        mid = (low + high) // 2
        low, high = (mid, high) if text.startswith(passage[j : j + mid], i) else (low, mid)
    return low


def _agree_back(text: str, i: int, passage: str, j: int) -> int:
    """How many characters agree before ``text[i]`` and ``passage[j]``."""
    low, high = 0, min(i, j)
    if text.endswith(passage[j - high : j], 0, i):
        return high
    while low + 1 < high:
        mid = (low + high) // 2
        low, high = (mid, high) if text.endswith(passage[j - mid : j], 0, i) else (low, mid)
    return low


def locate(shard: Shard, runs: list[np.ndarray], window: int, seed: int = 12) -> list[np.ndarray | None]:
    """Per document of the shard, which words a passage covers that first stands elsewhere; None: no match.

    The automaton holds every passage's phrases of ``seed`` words, spaced so that any window of the passage has a whole one;
    a match is widened as text to the left and right as far as the passage goes.
    """
    removed: list[np.ndarray | None] = [None] * len(shard.texts)
    table = np.concatenate([x for x in runs if len(x)] or [np.zeros((0, 5), np.int64)])
    if not len(table):
        return removed
    table = _runs(table[np.lexsort((table[:, 1], table[:, 0]))])
    row_of = {(d, s): i for i, (d, s) in enumerate(zip(shard.doc.tolist(), shard.sub.tolist()))}
    phrases: dict[str, list[tuple[int, int]]] = {}
    passages, split, seed = [], {}, min(seed, window)
    for doc, key, size, f_doc, f_key in table.tolist():
        i = row_of[doc, key >> 32]
        if i not in split:
            split = {i: shard.texts[i].decode("utf-8", "surrogatepass").split(" ")}
        at = key & 0xFFFFFFFF
        own = split[i][at : at + size + window - 1]
        for offset in range(0, len(own) - seed + 1, window - seed + 1):
            phrases.setdefault(f" {' '.join(own[offset : offset + seed])} ", []).append((len(passages), offset))
        whole = f" {' '.join(own)} "
        passages.append((whole, _spaces(whole), f_doc, f_key))
    automaton = ahocorasick.Automaton()
    for phrase, uses in phrases.items():
        automaton.add_word(phrase, (len(phrase), uses))
    automaton.make_automaton()
    for i, raw in enumerate(shard.texts):
        if shard.n_words[i] < window:
            continue
        text, edges, marks, seen = f" {raw.decode('utf-8', 'surrogatepass')} ", None, None, {}
        doc, place = int(shard.doc[i]), int(shard.sub[i]) << 32
        for end, (length, uses) in automaton.iter(text):
            begin = end - length + 1
            if edges is None:
                edges = _spaces(text)
                marks = np.zeros(len(edges) + 1, dtype=np.int64)
            word = int(edges.searchsorted(begin))
            for p, offset in uses:
                shift = word - offset  # where the passage's first word would stand
                if seen.get((p, shift), 0) >= word + seed:
                    continue
                passage, gaps, f_doc, f_key = passages[p]
                from_char = int(gaps[offset])
                right = int(gaps.searchsorted(from_char + _agree(text, begin, passage, from_char))) - 1
                left = int(gaps.searchsorted(from_char - _agree_back(text, begin, passage, from_char)))
                seen[p, shift] = shift + right
                if right - left >= window and (f_doc, f_key + left) != (doc, place + shift + left):
                    marks[shift + left] += 1
                    marks[shift + right] -= 1
        if marks is not None:
            removed[i] = np.cumsum(marks)[: shard.n_words[i]] > 0
    return removed


def digest(result: DataFrame) -> DataFrame:
    """Adds ``kept_sha256``: lowercase hex SHA-256 of the kept words."""
    return result.withColumn("kept_sha256", F.sha2(F.encode("kept", "UTF-8"), 256))

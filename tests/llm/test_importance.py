import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from fieldglass.llm import importance


def features(text):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)
    return w, [" ".join(w[i : i + n]) for i in range(len(w)) for n in (1, 2, 3) if i + n <= len(w)]


def brute(rows, target, share=(5, 100)):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = Counter(bucket(f) for _, x in rows for f in features(x)[1]), Counter(bucket(f) for x in target for f in features(x)[1])
    ss, tt = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((float(t[b]) + 1) * (float(ss) + 10_000) / ((float(s[b]) + 1) * (float(tt) + 10_000)))) for b in s}
    out = []
    for d, x in rows:
        w, f = features(x)
        weight = sum(gain[bucket(y)] for y in f)
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    fit = sorted((x for x in out if x[5] >= 20), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for rank, x in enumerate(fit[: share[0] * len(fit) // share[1]], 1):
        x[4] = rank
    return sorted((tuple(x[:5]) for x in out), key=str)


def got(docs, target, **options):
    found = importance.resample(docs, target, **options).collect()
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in found), key=str)


TARGET = ["alpha1 beta2 gamma3. Delta4", None, "", "epsilon5 alpha1 beta2"]


def test_odd(spark, odd_docs):
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    want = brute(rows, TARGET, (50, 100))
    assert got(odd_docs, target, share=(50, 100)) == want
    assert got(odd_docs, target, share=(50, 100), chunk_mb=0.0001) == want
    assert any(x[4] for x in want)


def test_empty(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "text string")
    assert got(no_docs, none) == []
    assert got(odd_docs, none) == brute([(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()], [])


def test_buckets_in_order_of_occurrence():
    """Every feature's bucket in place: repeats, short texts, other scripts, controls, a long word, and too many words to pack ids."""
    rng = random.Random(3)
    texts = ["", "one", "Two WORDS", "a b a b a b a b", "é-ü É_x\x00y\x7f日本 語", "x" * 70_000 + " y z", " ".join(str(rng.randrange(50)) for _ in range(3000))]
    n_words, n_features, found = importance.buckets_of([t.encode() for t in texts], 10_000)
    assert found.tolist() == [zlib.crc32(f.encode()) % 10_000 for t in texts for f in features(t)[1]]
    assert n_words.tolist() == [len(features(t)[0]) for t in texts] and n_features.tolist() == [len(features(t)[1]) for t in texts]
    columns = [np.array(x) for x in ([3, 1, 3, 1], [1, 3, 1, 0], [3, 1, 0, 0])]
    packed, sorted_ = importance._sorted_suffixes(columns, 2), importance._sorted_suffixes(columns, 30)
    assert packed[0].tolist() == sorted_[0].tolist() == [3, 1, 2, 0] and packed[1].tolist() == sorted_[1].tolist() == [0, 1, 0, 2]

import hashlib
import os
import random

import numpy as np
import pandas as pd
import pytest

from fieldglass.llm import common, simhash, substrings
from fieldglass.llm import components as star_graph
from fieldglass.llm.common import materialize
from fieldglass.llm.components import components


def brute_substrings(rows, window=20):
    docs = sorted(((d is None, d or 0, (t or "").encode().split()) for d, t in rows), key=lambda x: (x[0], x[1], b" ".join(x[2])))
    seen, out = set(), []
    for none, d, w in docs:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            key = b" ".join(w[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        out.append((None if none else d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def got_substrings(docs, **options):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.digest(substrings.dedup_substrings(docs, **options)).collect()), key=str)


@pytest.mark.parametrize("shard_mb", [6, 0.001])
def test_substrings_odd(odd_docs, shard_mb):
    want = brute_substrings([(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()])
    assert got_substrings(odd_docs, shard_mb=shard_mb) == want
    assert sum(x[2] for x in want) > 200


def test_a_frequent_line_in_many_surroundings(spark, monkeypatch):
    """One line of 12 words in thousands of texts gives all its windows one anchor; its parts stay small, messages few, and results whole."""
    rng = random.Random(2)
    line = " ".join(f"line{i}" for i in range(12))
    other = lambda n: " ".join(str(rng.randrange(10**6)) for _ in range(n))
    texts = [f"{other(6)} {line} {other(6)}" for _ in range(3000)]
    rows = list(enumerate(texts + texts[:50] + [f"{line} {other(3)} {t} x" for t in texts[100:140]]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(substrings, "PER_PART", 3)
    assert got_substrings(docs, shard_mb=0.005) == brute_substrings(rows)


@pytest.mark.parametrize("seed", range(4))
def test_substrings_random(spark, seed):
    """Few words, so passages repeat, overlap and nest in many ways, also within a document."""
    rng = random.Random(seed)
    vocab = ["a", "b", "cc", "é"][: 2 + seed % 3]
    pool = [[rng.choice(vocab) for _ in range(rng.randrange(5, 60))] for _ in range(6)]
    rows = []
    for i in range(40):
        w = []
        for _ in range(rng.randrange(0, 5)):
            p = rng.choice(pool)
            a = rng.randrange(len(p))
            w += p[a : a + rng.randrange(1, 60)] if rng.random() < 0.8 else [str(rng.randrange(10**6))] * rng.randrange(1, 45)
        rows.append((rng.choice([i, i, 3]), "\n ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got_substrings(docs, shard_mb=rng.choice([1, 0.0005])) == brute_substrings(rows)


def test_substrings_empty_and_columns(no_docs, odd_docs):
    assert got_substrings(no_docs) == []
    out = substrings.dedup_substrings(odd_docs, keep=("lang", "t", "text"))
    assert out.columns == ["doc_id", "n_words", "n_removed", "kept", "lang", "t", "text"]
    assert {r.t for r in out.collect()} == {"x"}


def test_texts_are_dealt_once(spark, odd_docs):
    """All three passes read one exchange of the texts, other columns and the text itself kept beside them."""
    out = substrings.dedup_substrings(odd_docs, keep=("text", "lang"))
    with common.session_settings(spark, {"spark.sql.adaptive.enabled": "false"}):
        assert out.select("*")._jdf.queryExecution().executedPlan().toString().count("ReusedExchange") == 2
    assert sorted(str((r.doc_id, r.text, r.lang)) for r in out.collect()) == sorted(str((r.doc_id, r.text, r.lang)) for r in odd_docs.collect())


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, i) for i in range(5001, 5200)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_components_of_other_types(spark):
    """Strings take the rounds, which longs of a small table need not; both find the same."""
    rng = random.Random(8)
    edges = [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(130)] + [(i, i + 1) for i in range(2000, 2040)] + [(9000, i) for i in range(8000, 8050)]
    table = spark.createDataFrame(edges, "a long, b long")
    want = {str(r.node): str(r.component) for r in components(table).collect()}
    assert {r.node: r.component for r in components(table.selectExpr("string(a) a", "string(b) b")).collect()} == want


def test_stars_within_a_task(monkeypatch):
    rng = random.Random(9)
    path = rng.sample(range(-500, 500), 600)
    ends = np.array([*zip(path, path[1:]), (1000, 1001), (1002, 1001), (7000, 7003), (7003, 7001)], dtype=np.int64)
    u, v = star_graph._stars(ends.max(axis=1), ends.min(axis=1))
    assert dict(zip(u.tolist(), v.tolist())) == {x: min(path) for x in path if x != min(path)} | {1001: 1000, 1002: 1000, 7003: 7000, 7001: 7000}
    # cut anywhere, what comes out connects the same
    monkeypatch.setattr(star_graph, "AT_ONCE", 40)
    some = [pd.DataFrame({"u": ends[i : i + 25].max(axis=1), "v": ends[i : i + 25].min(axis=1)}) for i in range(0, len(ends), 25)]
    out = pd.concat(star_graph._contracted(iter(some)))
    assert len(out) <= len(ends) and (out.u > out.v).all()
    u2, v2 = star_graph._stars(out.u.to_numpy(), out.v.to_numpy())
    assert dict(zip(u2.tolist(), v2.tolist())) == dict(zip(u.tolist(), v.tolist()))
    assert list(star_graph._contracted(iter([]))) == []


def test_components_load_on_the_driver(spark):
    """Small tables of long paths take one written table, and a round's plan reads its edges four times at most."""
    edges = [(i * 7919 % 10007, (i + 1) * 7919 % 10007) for i in range(2000)]
    at = len(common._made)
    assert components(spark.createDataFrame(edges, "a long, b long")).select("component").distinct().count() == 1
    assert len(common._made) - at == 1
    table = materialize(spark.createDataFrame(edges, "u long, v long"), "edges")
    plan = star_graph.small_star(star_graph.large_star(table))._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan") <= 4


def test_forest_equals_all_pairs(spark):
    """Chunked groups, chains at the exact distance, repeated classes."""
    rng = random.Random(4)
    prints = [0, (1 << 64) - 1]
    for _ in range(30):
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 12)):
            prints.append(x)
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                x ^= 1 << b
    prints = list(dict.fromkeys(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    classes = spark.createDataFrame([(p, i) for i, p in enumerate(signed)], "fp long, rep long")
    old, simhash.CHUNK = simhash.CHUNK, 3
    try:
        got = {r.node: r.component for r in components(simhash.links(classes, len(prints), 4)).collect()}
    finally:
        simhash.CHUNK = old
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    assert {i: got.get(i, i) for i in range(len(prints))} == {i: find(i) for i in range(len(prints))}


@pytest.mark.parametrize("n", [10, 10**5, 10**8, 5 * 10**10])
def test_masks_cover_pigeonhole(n):
    rng = random.Random(n)
    masks = [m & ((1 << 64) - 1) for m in simhash.block_masks(n, 4)]
    for _ in range(200):
        flip = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(not flip & m for m in masks)


def test_near_duplicates_odd(odd_docs, no_docs):
    got = simhash.near_duplicates(odd_docs).toPandas()
    rows = odd_docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    prints = sorted(simhash.fingerprint(r.text, 4) for r in rows)
    assert sorted(int(x) & ((1 << 64) - 1) for x in got.fp) == prints
    by = {d: c for d, c in zip(got.doc_id, got.component_id)}
    assert by[1] == by[2] == by[11] == 1 and by[3] == by[4] == by[5] == 3
    assert simhash.near_duplicates(no_docs).count() == 0


def test_keep_one_keeps_one_of_each_group(spark, odd_docs, no_docs):
    groups = simhash.similar_texts(odd_docs)
    kept = simhash.keep_one(odd_docs, groups)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 2 not in ids and 11 not in ids and 13 not in ids and ids.count(7) == 1 and 1 in ids and 10 in ids
    assert len(ids) == groups.select("group").distinct().count()
    assert simhash.keep_one(no_docs, simhash.similar_texts(no_docs)).count() == 0


def families(seed):
    """Texts with planted copies of similarity 0.75-0.95, chains and families of edited copies, a line that most hold, and short texts."""
    rng = random.Random(seed)
    line = [f"common{i}" for i in range(15)]
    texts = []
    for f in range(60):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([8, 60, 200, 400]))]
        base[3:3] = line
        for _ in range(rng.choice([1, 2, 2, 3, 40 if f < 2 else 6])):
            w = list(base)
            for at in rng.sample(range(len(w)), round(len(w) * rng.choice([0, 0.005, 0.01, 0.02, 0.022, 0.025, 0.03]))):
                w[at] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(w))
            base = w if rng.random() < 0.3 else base
    texts += [None, "", " ", "one", "ONE", "one two"]
    return list(dict.fromkeys(texts))


@pytest.mark.parametrize("few", [16, 1])
def test_similar_texts_equals_all_pairs(spark, few):
    """Groups are the components over all pairs of similarity 0.8, also those that no fingerprint finds."""
    texts = families(7)
    sets = [simhash._shingles(t, 5) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both / (len(sets[i]) + len(sets[j]) - both) >= 0.8:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    old, simhash.FEW, chunk, simhash.CHUNK = simhash.FEW, few, simhash.CHUNK, 10
    try:
        got = {r.doc_id: r.group for r in simhash.similar_texts(docs).collect()}
    finally:
        simhash.FEW, simhash.CHUNK = old, chunk
    least = {}
    for i in range(len(texts)):
        least.setdefault(got[i], i)
    assert [least[got[i]] for i in range(len(texts))] == [find(i) for i in range(len(texts))]


def test_shared_keys_are_dealt_once(spark):
    """Keys of prefixes, many times the texts, cross the network once; the groups of texts join before they are listed."""
    rows = spark.createDataFrame([(1, k, h, 10, h // 10) for k in range(5) for h in (10, 11, 20)] + [(1, 9, 10, 10, 1), (1, 9, 11, 10, 1), (10, 8, 10, 10, 1), (10, 8, 20, 10, 2)], "pos int, key long, h long, size int, g long")
    found = simhash._apart(rows, 0.8)
    assert {(r.key, r.h, r.n, r.early) for r in found.collect()} == {(k, h, 3, True) for k in range(5) for h in (10, 11, 20)}
    assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") == 1


def test_parity_rules_out_no_similar_sets():
    """Parities differ in no more bits than sets in members, whatever their widths; partners of similarity 0.8 are all found, sets of other words are not."""
    rng = np.random.default_rng(6)
    sets, family = [], []
    for f in range(60):
        base = rng.integers(0, 1 << 63, int(rng.choice([1, 5, 60, 64, 65, 300, 1030])), dtype=np.uint64)
        for _ in range(3):
            sets.append(np.unique(np.concatenate([base[rng.random(len(base)) > rng.choice([0, 0.02, 0.1])], rng.integers(0, 1 << 63, int(len(base) * rng.choice([0, 0.03, 0.12])) + 1, dtype=np.uint64)])))
            family.append(f)
    bits, size, want = [simhash.parity(s) for s in sets], np.array([len(s) for s in sets]), np.zeros(len(sets), dtype=bool)
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            both = len(np.intersect1d(x, y))
            rows = simhash._halved([bits[i], bits[j]], min(len(bits[i]), len(bits[j])))
            assert np.bitwise_count(rows[0] ^ rows[1]).sum() <= len(x) + len(y) - 2 * both
            if both / (len(x) + len(y) - both) >= 0.8:
                want[[i, j]] = True
    found = simhash._partners(size, np.arange(len(sets)), np.ones(len(sets), dtype=bool), bits, 0.8)
    assert want.sum() > 60 and not (want & ~found).any() and found[size > 40].sum() <= want[size > 40].sum() + 30
    # none in a group of their own families only, none where the smaller is not early
    assert not simhash._partners(size, np.zeros(len(sets), dtype=np.int64), np.ones(len(sets), dtype=bool), bits, 0.8).any()
    assert not simhash._partners(size, np.arange(len(sets)), np.zeros(len(sets), dtype=bool), bits, 0.8).any()


def test_texts_alike_by_chance_are_not_sent(spark, monkeypatch):
    """Texts of other words that share a shingle, in a key of few texts or of many, are told apart by their marks; only likely pairs have their texts sent."""
    rng = random.Random(3)
    first = []  # shingles whose hashes are so small that they lead the prefixes
    while len(first) < 2:
        line = " ".join(f"s{rng.randrange(10**6)}" for _ in range(5))
        if int(simhash.shingle_hashes(line, 5)[0]) < (1 << 64) // 5000:
            first.append(line)
    text = lambda line: " ".join([*(f"w{rng.randrange(10**7)}" for _ in range(60)), line, *(f"w{rng.randrange(10**7)}" for _ in range(60))])
    texts = [text(first[0]) for _ in range(40)] + [text(first[1]) for _ in range(10)]
    texts += [f"{t} changed" for t in texts[:3]]
    sent, rows, confirm, all_links = [], [], simhash.confirm, simhash.all_links
    monkeypatch.setattr(simhash, "SAMPLE_TEXTS", 1)
    monkeypatch.setattr(simhash, "confirm", lambda pairs, *a: sent.append(pairs.count()) or confirm(pairs, *a))
    monkeypatch.setattr(simhash, "all_links", lambda live, *a: rows.append(live.count()) or all_links(live, *a))
    got = {r.doc_id: r.group for r in simhash.similar_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(set(got.values())) == 50 and all(got[i] == got[50 + i] for i in range(3))
    assert sum(sent) <= 3 and sum(rows) <= 6


def test_working_tables_go(spark, odd_docs):
    """Of all tables on the way to the groups only the groups stay."""
    at = len(common._made)
    groups = simhash.similar_texts(odd_docs)
    assert len(common._made) - at == 1 and groups.count() == odd_docs.count()
    with common.working_tables(spark) as own:
        path = materialize(spark.range(3), "kept").inputFiles()[0].removeprefix("file://")
        assert len(own) == 1 and os.path.exists(path)
    assert not os.path.exists(path) and len(common._made) - at == 1

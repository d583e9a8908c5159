import random

import numpy as np

from fieldglass.llm import mixing


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        total = sum(w[s] for s in open_)
        add = {s: left * w[s] / total for s in open_}
        left = 0.0
        for s in list(open_):
            target[s] += add[s]
            if target[s] > cap * sizes[s]:
                left += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
                open_.discard(s)
    return target


def test_targets_match_repeated_resharing(spark):
    rng = random.Random(3)
    for trial in range(6):
        sizes = {s: rng.choice([0, 5, 1000, 20000]) + rng.randrange(50) for s in ["a", "B", "é", "zz", "m", None][: trial + 1]}
        df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        got = {r.source: r.target for r in mixing.source_targets(df).collect()}
        want = brute_targets(sizes)
        assert got.keys() == want.keys()
        for s in want:
            assert abs(got[s] - want[s]) < 1e-6 * max(1, want[s]), (trial, s, got, want)


def test_flight_keeps_both_totals_and_is_unbiased():
    rng = random.Random(1)
    size = np.array([rng.randrange(1, 500) for _ in range(60)])
    pi = np.full(60, 0.37)
    hits = np.zeros(60)
    for trial in range(400):
        out = mixing.flight(pi, size, random.Random(trial))
        assert ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 2
        assert abs(out.sum() - pi.sum()) < 1e-6 and abs((out * size).sum() - (pi * size).sum()) < 1e-4
        hits += out
    assert abs(hits / 400 - 0.37).max() < 0.12


def test_landing_is_nearest():
    size = np.array([10, 20, 40])
    assert (mixing.landing(np.array([0.5, 0.5, 0.5]), size) @ size) in (30, 40)


def test_mix(spark, odd_docs):
    first = mixing.mix(odd_docs, block_docs=4).toPandas()
    again = mixing.mix(odd_docs.repartition(7), block_docs=4).toPandas()
    key = ["doc_id", "source", "size", "taken"]
    assert first[key].astype(str).sort_values(key).values.tolist() == again[key].astype(str).sort_values(key).values.tolist()
    assert len(first) == odd_docs.count() and (first.taken <= 2 * first["size"]).all() and (first.taken == first.copies * first["size"]).all()
    want = {r.doc_id: len((r.text or "").encode().split()) for r in odd_docs.collect() if r.doc_id not in (7, None)}
    assert {d: n for d, n in zip(first.doc_id, first["size"]) if d in want} == want


def test_mix_blocks_reach_targets(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randrange(1, 60), rng.choice(["a", "a", "a", "b", None]), str(i)) for i in range(3000)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string, pi string"), block_docs=64).toPandas()
    for _, g in out.groupby("source", dropna=False):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 3
        assert g["size"].sum() == g.source_size.iloc[0]


def test_mix_empty(no_docs):
    assert mixing.mix(no_docs).count() == 0

"""Constraints, graphs, sweeps, cached results, histories, rule indexes and array files against brute force and planted cases."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldglass.functions.stages import names_in
from fieldglass.operators import cache, constraints, graph, ruleindex, sweep
from fieldglass.plans import integrity
from fieldglass.sources import arrays
from fieldglass.streaming import history

NAN = float("nan")


def test_constraints_on_odd_names_and_missing_values(spark):
    rows = [(1, "a", 1.0, "x"), (1, "b", 2.0, "x"), (2, None, NAN, "y"), (None, "c", -1.0, "y"), (None, "c", 9.0, None), (3, "A", None, "z")]
    df = spark.createDataFrame(rows, "`the.key` long, `it's` string, v double, w string")
    rules = [
        {"name": "present", "kind": "not_null", "columns": ["it's", "v"]}, {"name": "low", "kind": "range", "columns": ["v"], "low": 0}, {"name": "both", "kind": "range", "columns": ["v"], "low": 0, "high": 1.5},
        {"name": "letters", "kind": "pattern", "columns": ["it's"], "pattern": "a|b"}, {"name": "listed", "kind": "enum", "columns": ["the.key"], "allowed": [1, 2]}, {"name": "unique", "kind": "key", "columns": ["the.key"]},
        {"name": "known", "kind": "foreign_key", "columns": ["it's"], "reference": "r", "target": ["a.b"]}, {"name": "decides", "kind": "functional", "columns": ["it's"], "determines": ["v", "w"]}, {"name": "same", "kind": "functional", "columns": ["the.key"], "determines": ["w"]},
    ]
    refs = {"r": spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "`a.b` string")}
    want = {"present": 2, "low": 1, "both": 3, "letters": 3, "listed": 1, "unique": 2, "known": 3, "decides": 2, "same": 0}
    assert {r.rule: r.n_violations for r in constraints.violations(df, rules, refs).collect()} == want
    found = constraints.violating_rows(df, rules, ["it's", "v"], refs).groupBy("rule").count().collect()
    assert {r.rule: r["count"] for r in found} == {k: v for k, v in want.items() if v}
    assert {r.n_violations for r in constraints.violations(df.limit(0), rules, refs).collect()} == {0}
    with pytest.raises(ValueError):
        constraints.violations(df, [{"name": "?", "kind": "odd", "columns": ["v"]}])


def brute_components(edges):
    nodes = {x for e in edges for x in e}
    reach = {n: {b for a, b in edges if a == n} for n in nodes}
    for k in nodes:
        for n in nodes:
            if k in reach[n]:
                reach[n] |= reach[k]
    out = {}
    for n in nodes:
        mates = {m for m in reach[n] if n in reach[m]} | {n}
        out[n] = (min(mates), len(mates), n in reach[n])
    return out


@pytest.mark.parametrize("seed", range(2))
def test_strong_components(spark, seed):
    rng = random.Random(seed)
    edges = {(rng.randrange(40), rng.randrange(40)) for _ in range(45 + 20 * seed)} | {(50, 51), (51, 52), (52, 50), (52, 60), (60, 61), (61, 60), (70, 70), (80, 81)}
    table = spark.createDataFrame([*edges, (50, 51), (None, 3), (4, None)], "a long, b long")
    assert {r.node: (r.component, r["size"], r.recursive) for r in graph.strong_components(table).collect()} == brute_components(edges)
    assert graph.strong_components(table.limit(0)).count() == 0


def test_sweep_with_a_hot_group(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot"] * 8 + ["a", None]), s, None if rng.random() < 0.1 else s + rng.randrange(-2, 9), None if rng.random() < 0.05 else float(rng.randrange(1, 9))) for s in (rng.randrange(60) for _ in range(1500))]
    want = {}
    for g in ("hot", "a", None):
        own = [(s, e, w) for k, s, e, w in rows if k == g and w is not None and (e is None or e > s)]
        moments = sorted({x for s, e, _ in own for x in (s, e) if x is not None})
        alive = {t: sum(w for s, e, w in own if s <= t and (e is None or e > t)) for t in moments}
        peak = max(alive.values())
        want[g] = (peak, min(t for t in moments if alive[t] == peak), len(moments))
    df = spark.createDataFrame(rows, "g string, s long, e long, w double").withColumn("s", F.timestamp_seconds("s")).withColumn("e", F.timestamp_seconds("e"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.g: (r.peak, r.at, r.n_moments) for r in sweep.peaks(df, ["g"], F.col("s"), F.col("e"), F.col("w")).select("g", "peak", F.unix_seconds("peak_at").alias("at"), "n_moments").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert got == want
    assert sweep.peaks(df.limit(0), ["g"], F.col("s"), F.col("e"), F.col("w")).count() == 0


def test_cache_computes_only_what_changed(spark, tmp_path):
    path, seen = f"file://{tmp_path}/cache", []

    def totals(rows):
        seen.append(sorted((r.k or "-") for r in rows.select("k").distinct().collect()))
        return rows.groupBy("k").agg(F.sum("v").alias("v"))

    table = lambda *rows: spark.createDataFrame(rows, "k string, v long")
    values = lambda r: {x.k: (x.v, x.version) for x in r.result.collect()}
    first = cache.refresh(table(("a", 1), ("a", 2), ("b", 3), (None, 4)), ["k"], totals, path)
    assert values(first) == {"a": (3, 1), "b": (3, 1), None: (4, 1)} and first.n_computed == 3
    again = cache.refresh(table((None, 4), ("b", 3), ("a", 2), ("a", 1)), ["k"], totals, path)
    assert (again.version, again.n_computed, again.n_removed) == (1, 0, 0) and values(again) == values(first)
    # a repeated row and a new group count, a group goes
    third = cache.refresh(table(("a", 1), ("a", 2), ("a", 2), ("c", 0), (None, 4)), ["k"], totals, path)
    assert values(third) == {"a": (5, 2), "c": (0, 2), None: (4, 1)} and (third.n_computed, third.n_removed) == (2, 1)
    # a refresh that fails leaves nothing that counts, and a group that comes back is computed
    with pytest.raises(Exception, match="no such"):
        cache.refresh(table(("a", 9)), ["k"], lambda rows: rows.select(F.raise_error(F.lit("no such")).cast("long").alias("v"), "k"), path)
    fourth = cache.refresh(table(("a", 1), ("a", 2), ("a", 2), ("b", 3), (None, 4)), ["k"], totals, path)
    assert values(fourth) == {"a": (5, 2), "b": (3, 3), None: (4, 1)}
    assert seen == [["-", "a", "b"], ["a", "c"], ["b"]]
    empty = cache.refresh(table(), ["k"], totals, path)
    assert values(empty) == {} and empty.n_removed == 3


def test_history_takes_each_batch_once(spark, tmp_path):
    base = f"file://{tmp_path}"
    events = spark.range(100).select("id", (F.col("id") % 3).alias("v"))
    events.repartitionByRange(5, "id").write.parquet(f"{base}/in")
    start = lambda: history.record(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(f"{base}/in"), f"{base}/table", f"{base}/checkpoint").awaitTermination()
    start()
    append = history.append_once(f"{base}/table")
    append(events, 1)
    # half a batch that never reached the ledger is not seen, and is replaced
    events.limit(7).write.parquet(f"{base}/table/rows/stream-{9:012d}")
    assert sorted(r.id for r in history.read_history(spark, f"{base}/table").collect()) == list(range(100))
    append(spark.range(500, 503).select("id", F.lit(0).cast("long").alias("v")), 9)
    spark.range(200, 203).select("id", F.lit(1).cast("long").alias("v")).write.mode("append").parquet(f"{base}/in")
    start()
    assert sorted(r.id for r in history.read_history(spark, f"{base}/table").collect()) == [*range(100), *range(200, 203), *range(500, 503)]
    assert len(names_in(spark, f"{base}/table/ledger")) >= 4
    assert history.read_history(spark, f"{base}/none", "id long").count() == 0


PATTERNS = [r"import torch|nn\.Module|torch\.", r"\.iterrows\(\)", r"(?i)ATTENTION", r"multi.?head", r"x+yz", r"colou?r", r"[ab]c", r"a|b", r"\d{3}", r"to\(['\"]cuda", r"(foo|bar)baz", r"\bword\b", r"é+cole", r"caf\.é", r"new\nline", "", r"(?i)É"]


def test_rule_index_equals_every_pair(spark):
    rng = random.Random(1)
    pieces = ["import torch", "nn.Module", "df.iterrows()", "Attention", "attention", "multihead", "multi-head", "xyz", "yz", "color", "colour", "bc", "123", "to('cuda", "foobaz", "bazfoo", "word", "sword", "école", "ÉCOLE", "caf.é", "new\nline", "nothing", " ", "TORCH."]
    texts = [(i, rng.choice([" ", "", "\n"]).join(rng.sample(pieces, rng.randrange(0, 9)))) for i in range(60)] + [(None, "import torch word"), (3, "nn.Module again"), (70, None), (71, "")]
    rules = [(f"r{i}", p, "nothing" if i % 4 == 1 else None) for i, p in enumerate(PATTERNS)] + [("r0", PATTERNS[0], None), ("null", None, None)]
    java = lambda p: re.compile(p.replace("(?i)", ""), re.I | re.A if "(?i)" in p else re.A)
    want = {(i, r) for i, t in texts for r, p, u in rules if t is not None and p is not None and java(p).search(t) and not (u and u in t)} - {(i, "r16") for i, _ in texts}
    frame = spark.createDataFrame(texts, "id long, body string").repartition(3)
    got = {(r.id, r.rule) for r in ruleindex.match_rules(frame, spark.createDataFrame(rules, "rule string, pattern string, unless string"), "id", "body").collect()}
    assert {x for x in got if x[1] != "r16"} == want
    none = spark.createDataFrame([], "rule string, pattern string, unless string")
    assert ruleindex.match_rules(frame, none, "id", "body").count() == 0


def test_rule_index_has_no_nested_loop(spark):
    rules = spark.range(300).select(F.concat(F.lit("r"), "id").alias("rule"), F.concat(F.lit("needle"), "id").alias("pattern"), F.lit(None).cast("string").alias("unless"))
    plan = ruleindex.match_rules(spark.createDataFrame([(1, "a needle12 b")], "id long, body string"), rules, "id", "body")
    assert {r.rule for r in plan.collect()} == {"r1", "r12"}
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_array_files(spark, tmp_path):
    arrays.register(spark)
    rng = np.random.default_rng(1)
    wide = rng.normal(size=(1000, 3))
    load = lambda path, **o: spark.read.format("arrays").options(path=str(path), **o).load()
    rows = lambda df: np.array([list(r)[1:] for r in df.orderBy("row").collect()])
    np.save(tmp_path / "c.npy", wide)
    df = load(tmp_path / "c.npy", rows_per_task=99)
    assert df.rdd.getNumPartitions() == 11 and df.columns == ["row", "c0", "c1", "c2"]
    assert (rows(df) == wide).all() and (rows(load(f"file://{tmp_path}/c.npy")) == wide).all()
    np.save(tmp_path / "f.npy", np.asfortranarray(wide))
    assert (rows(load(tmp_path / "f.npy", rows_per_task=10)) == wide).all()
    np.save(tmp_path / "i.npy", np.arange(24, dtype=np.int16).reshape(4, 3, 2))
    assert (rows(load(tmp_path / "i.npy")) == np.arange(24).reshape(4, 6)).all()
    np.save(tmp_path / "one.npy", np.array([1.5, np.nan]))
    assert load(tmp_path / "one.npy").columns == ["row", "c0"]
    np.savez(tmp_path / "z.npz", a=wide, b=wide[:7] * 2)
    assert (rows(load(tmp_path / "z.npz", rows_per_task=33)) == wide).all() and (rows(load(tmp_path / "z.npz", array="b")) == wide[:7] * 2).all()
    np.savez_compressed(tmp_path / "zc.npz", a=wide)
    assert (rows(load(tmp_path / "zc.npz", rows_per_task=33)) == wide).all()
    np.save(tmp_path / "empty.npy", np.zeros((0, 2)))
    assert load(tmp_path / "empty.npy").count() == 0
    out = tmp_path / "out"
    written = spark.createDataFrame([(float(i), i * i, None if i % 7 == 0 else 0.5) for i in range(250)], "a double, b long, c double").repartition(3)
    written.write.format("arrays").mode("append").options(path=str(out), rows_per_file=40).save()
    back = load(out)
    assert len(list(out.iterdir())) >= 7 and sorted(r["row"] for r in back.collect()) == list(range(250))
    assert sorted((r.c0, r.c1, np.isnan(r.c2)) for r in back.collect()) == [(float(i), float(i * i), i % 7 == 0) for i in range(250)]


def test_rule_index_looks_phrases_up_whole(spark):
    assert ruleindex.required_literals(r"(?:^|\s)of[\x20\x09-\x0D]+the\s+day(?:\s|$)") == ["of the day"]
    assert ruleindex.required_literals(r"(?i)(mask|l1)") == ["mask", "l1"] and ruleindex.required_literals(r"(mask|l1)?end") == ["end"] and ruleindex.required_literals(r"(?U)a\sb") == [""]
    rules = spark.createDataFrame([("p", r"of\s+the\s+day", None)], "rule string, pattern string, unless string")
    texts = spark.createDataFrame([(1, "the day of"), (2, "one of \n the\tday"), (3, "of  the day"), (4, "OF the day")], "id long, body string")
    assert {(r.id, r.rule) for r in ruleindex.match_rules(texts, rules, "id", "body").collect()} == {(2, "p"), (3, "p")}


def test_refresh_deals_rows_by_their_number(spark, monkeypatch):
    seen, real = [], cache.refresh
    monkeypatch.setattr(cache, "refresh", lambda df, *rest: seen.append(df) or real(df, *rest))
    integrity.inc_supplier_refresh(spark, "/root/testdata/sf0.001")
    assert "Repartition 3" not in seen[-1]._jdf.queryExecution().logical().toString()

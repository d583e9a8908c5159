import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldglass.llm import quality, revisits, toxicity, urls, vectors

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_quality(text):
    text = text or ""
    w = WORD.findall(text)
    times = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if times[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_quality_against_brute_force(spark, odd_docs, no_docs):
    more = [(100 + i, t) for i, t in enumerate(["a b c a b c", "a b c d a b c", "x x x x", "<#>|*$%&\n\n<\n<", "é\u00a0é b\x1cc", "a a\r\na a\na a\n a a", "one two"])]
    docs = spark.createDataFrame([(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()] + more, "doc_id long, text string")
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = Counter((r.doc_id, *(r[c] for c in cols)) for r in quality.judge(docs).collect())
    assert got == Counter((r.doc_id, *brute_quality(r.text)) for r in docs.collect())
    assert quality.judge(no_docs).count() == 0
    assert set(odd_docs.columns) <= set(quality.judge(odd_docs).columns)


def test_quality_lines(spark):
    good = " ".join(f"w{i}" for i in range(60)) + "."
    junk = " ".join(f"j{i}$$$" for i in range(40))
    menu = " | ".join(f"m{i}" for i in range(12))
    docs = spark.createDataFrame([(1, good), (2, f"{good}\n{menu}\nHome\nAll rights reserved"), (3, f"{junk}$$$ a\n{junk}$$$ b\n" + good[:80] + "."), (4, None)], "doc_id long, text string")
    out = {r.doc_id: r for r in quality.judge(docs).filter("kept").collect()}
    assert set(out) == {1, 2} and out[2].cleaned == good and out[1].cleaned == good


def test_urls(spark):
    rules = spark.createDataFrame([("com", "/", "allow"), ("bad.org", "/", "block"), ("bad.org", "/ok/", "allow"), ("org", "/x", "block")], "host string, path string, verdict string")
    pages = [(1, "http://A.COM/x"), (2, "http://bad.org/a#top"), (3, "http://alias.net/1"), (4, "http://alias.net/2"), (5, "https://www.bad.org/ok/z?q"), (6, None), (7, "no scheme"), (8, "http://notbad.org/y"), (9, "http://org"), (3, "http://alias.net/1"), (10, "http://both.net/"), (11, "http://sub.org/x://y/x"), (12, "http://far.net/")]
    edges = [("http://alias.net/1", "http://bad.org/a"), ("http://alias.net/1#f", "http://alias.net/2"), ("http://both.net/", "http://bad.org/b"), ("http://both.net/", "http://c.com/"), ("http://unseen.net/", "http://alias.net/2"), ("http://far.net/", "http://unseen.net/"), (None, "http://q.net/"), ("http://z.net/", "http://z.net/")]
    df = spark.createDataFrame(pages, "page_id long, url string").withColumn("verdict", F.lit("clash")).withColumn("host", F.lit(1))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(df, rules, spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got[1] == ("a.com", "/x", "com/", "allow")
    assert got[2] == ("bad.org", "/a", "bad.org/", "block")
    assert got[3][2:] == got[4][2:] == got[12][2:] == (None, "block")
    assert got[5][2:] == ("bad.org/ok/", "allow")
    assert got[6] == got[7] == ("", "", None, "allow")
    assert got[8][2:] == (None, "allow") and got[9] == ("org", "", None, "allow")
    assert got[10][3] == "allow" and got[11][:3] == ("sub.org", "/x://y/x", "org/x")
    assert urls.judge_urls(df, rules, spark.createDataFrame(edges, "a string, b string")).count() == len(pages)
    assert urls.judge_urls(df.limit(0), rules, spark.createDataFrame([], "a string, b string")).count() == 0


def test_page_edges(spark):
    html = [("http://a/1", '<link href="http://b/1" rel="canonical">'), ("http://a/2", "<META http-equiv='Refresh' content='0; url=http://c/2'>"), ("http://a/3", '<link rel=canonical href="/relative">'), ("http://a/4", None), (None, "")]
    got = {(r.a, r.b) for r in urls.page_edges(spark.createDataFrame(html, "url string, html string")).collect()}
    assert got == {("http://a/1", "http://b/1"), ("http://a/2", "http://c/2"), ("http://a/3", "http://a/relative")}


def test_page_edges_relative_and_several(spark):
    link = lambda *hrefs: "".join(f'<link rel="canonical" href="{h}">' for h in hrefs)
    html = [("https://a.b/c/d?q=1#f", link("x", "../y", "./z?k&amp;l", "//h/p", "/r/../s", "?n", "#top", "mailto:a@b", "")), ("https://a.b", link("x")), ("no host", link("x", "http://k/")), ("http://e/f", None)]
    got = {(r.a, r.b) for r in urls.page_edges(spark.createDataFrame(html, "url string, html string")).collect()}
    first = {"https://a.b/c/x", "https://a.b/y", "https://a.b/c/z?k&l", "https://h/p", "https://a.b/s", "https://a.b/c/d?n"}
    assert got == {("https://a.b/c/d?q=1#f", x) for x in first} | {("https://a.b", "https://a.b/x"), ("no host", "http://k/")}


def test_class_decides_where_no_rule_fits(spark):
    """Pages whose links join them to a blocked or an allowed page; neither a rule of their own nor the default gives these verdicts."""
    pages = [(1, "http://x.net/es/a", ""), (2, "http://other.org/1", '<link rel="canonical" href="http://x.net/es/a">'), (3, "http://other.org/2", '<link rel="canonical" href="1">'), (4, "http://free.org/", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    rules = spark.createDataFrame([("net", "/es/", "block"), ("com", "/", "allow")], "host string, path string, verdict string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge_urls(df, rules, urls.page_edges(df)).collect()}
    assert got == {1: ("net/es/", "block"), 2: (None, "block"), 3: (None, "block"), 4: (None, "allow")}


def test_page_edges_any_case(spark):
    html = [("http://a/1", '<LINK REL="CANONICAL" HREF="http://b/1">'), ("http://a/2", '<link rel="Canonical" href="http://b/2">'), ("http://a/3", "<META HTTP-EQUIV=REFRESH CONTENT='0; URL=http://c/3'>")]
    got = {(r.a, r.b) for r in urls.page_edges(spark.createDataFrame(html, "url string, html string")).collect()}
    assert got == {("http://a/1", "http://b/1"), ("http://a/2", "http://b/2"), ("http://a/3", "http://c/3")}


def test_vectors_recall_and_edges(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 24)) + 3 * rng.normal(size=(20, 24))[rng.integers(0, 20, 3000)]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(3001 + i, x[50].tolist()) for i in range(40)]
    rows += [(9000, None), (9050, [0.0] * 24), (9100, [float("nan")] + [1.0] * 23), (9150, [1.0] * 5), (9200, []), (9250, [None] + [1.0] * 23), (None, [1.0] * 24), (9300, [float("inf")] + [1.0] * 23)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("clash")).withColumn("s", F.lit(1))
    got = vectors.neighbours(df, shard=700, block=20).toPandas()
    x = np.concatenate([x, np.repeat(x[50:51], 40, axis=0)])
    ids = np.array([r[0] for r in rows[:3040]])
    assert set(got.query_id) == {int(i) for i in ids if i % 50 == 0}
    hit = 0
    for q, g in got.groupby("query_id"):
        i = int(np.flatnonzero(ids == q)[0])
        score = x @ x[i] / np.sqrt((x**2).sum(axis=1) * (x[i] ** 2).sum())
        score[i] = -9
        order = np.lexsort((ids, -score))[:5]
        g = g.sort_values("rank")
        assert list(g["rank"]) == [1, 2, 3, 4, 5] and q not in set(g.vec_id)
        assert all(abs(score[np.flatnonzero(ids == v)[0]] - s) < 1e-12 for v, s in zip(g.vec_id, g.score))
        hit += len(set(ids[order]) & set(g.vec_id))
    assert hit / len(got) >= 0.9
    assert list(got[got.query_id == 50].sort_values("rank").vec_id) == [3001, 3002, 3003, 3004, 3005]


def test_vectors_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id) for r in vectors.neighbours(few).orderBy("rank").collect()] == [(0, 2), (0, 1)]
    one = vectors.neighbours(few.filter("vec_id = 0"))
    assert one.count() == 0
    assert vectors.neighbours(few.limit(0)).count() == 0 and vectors.neighbours(few.filter("vec_id = 1")).count() == 0


def test_pigeonhole_retrieves_every_code():
    rng = np.random.default_rng(2)
    v = rng.normal(size=(500, 16))
    index = vectors.Index(np.arange(500), v, vectors.fit(v / np.linalg.norm(v, axis=1, keepdims=True)), 5)
    for code in index.packed[:20]:
        for r in range(0, 17):
            want = np.flatnonzero(np.unpackbits(index.packed ^ code, axis=1).sum(axis=1) <= r)
            assert set(index.within(code, r)) == set(want)


def test_grammar_events():
    s = toxicity.Scorer({"idiot": 3.0, "scu*": 2.0, "scum*": 1.0})
    names = {e: i for i, e in enumerate(toxicity.EVENTS)}

    def events(text):
        x = s.features(text)
        return {e for e, i in names.items() if x[1 + 2 * i] > 0}

    assert events("what an idiot.") == {"insult"}
    assert events("you are an idiot") == {"insult at target"} and events("idiot, all of you") == {"insult", "insult at target"}
    assert events("you are not an idiot") == {"negated"} and events("she said idiot") == {"reported"}
    assert events("no more of that rubbish you idiot") == {"insult at target"}
    assert events("I will kill you") == {"threat", "threat at target"}
    assert events("you. idiot") == {"insult"} and events("scumbag!") == {"insult"}
    assert events(None) == events("") == events("you not said") == set()
    assert len(s.features("x")) == toxicity.N_FEATURES


def test_weights_do_not_depend_on_the_order():
    s = toxicity.Scorer({"idiot": 3.0, "fool": 2.0})
    most = lambda text: dict(zip(toxicity.EVENTS, s.features(text)[2::2]))
    assert most("idiot you")["insult at target"] == most("you idiot")["insult at target"] == 3.0
    assert most("kill you")["threat at target"] == most("you kill")["threat at target"] == 1.0
    assert most("idiot not fool you")["insult at target"] == 3.0
    assert most("not fool")["negated"] == most("he said fool")["reported"] == 1.0


def test_composed_weights_are_products_along_the_path():
    rng = random.Random(1)
    machines = toxicity.negation(), toxicity.reported(), toxicity.targeted()
    machine = toxicity.grammar()
    for _ in range(300):
        states, state = [t.start for t in machines], machine.start
        for x in [rng.choice(["I", "H", "T", "N", "R", "o"]) for _ in range(rng.randrange(12))]:
            want, middle = 1.0, x
            for k, t in enumerate(machines):
                want *= t.weight(states[k], middle)
                states[k], middle = t.step(states[k], middle)
            assert machine.weight(state, x) == want
            state, _ = machine.step(state, x)


def test_composition_equals_running_in_turn():
    rng = random.Random(0)
    a, b, c = toxicity.negation(), toxicity.reported(), toxicity.targeted()
    machine = toxicity.grammar()
    for _ in range(300):
        word = [rng.choice(["I", "H", "T", "N", "R", "o"]) for _ in range(rng.randrange(12))]
        states, got, state = [a.start, b.start, c.start], [], machine.start
        want = []
        for symbol in word:
            x = symbol
            for k, t in enumerate((a, b, c)):
                states[k], x = t.step(states[k], x)
            want.append(x)
            state, out = machine.step(state, symbol)
            got.append(out)
        assert got == want


def test_toxicity_learns(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(900):
        toxic = rng.random() < 0.2
        w = [f"w{rng.randrange(80)}" for _ in range(30)]
        if toxic:
            w.insert(rng.randrange(30), rng.choice(["vermin", "gutter" + str(i), "dolt"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic) if i % 9 else None))
    rows += [(5000, None), (5001, ""), (None, "vermin"), (3, "dolt dolt")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(1)).withColumn("toxic", F.lit("clash")).withColumn("d", F.lit(0))
    got = toxicity.toxicity(docs, spark.createDataFrame(labels + [(4, 1), (4, 0)], "doc_id long, toxic int")).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    truth = dict(labels)
    held = [r for r in got if r.held_out and truth.get(r.doc_id) is not None]
    assert len(held) > 100 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert [r.held_out for r in got if r.doc_id is None] == [False]


@pytest.mark.parametrize("labels,score", [([], 0.0), ([(1, 0), (2, 0)], 0.0), ([(1, 1), (2, 1)], 1.0)])
def test_toxicity_without_both_kinds(spark, labels, score):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "doc_id long, text string")
    out = toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert all(abs(r.score - score) < 1e-6 for r in out) and len(out) == 3
    assert toxicity.toxicity(docs.limit(0), spark.createDataFrame(labels, "doc_id long, toxic int")).count() == 0


def test_revisits_against_brute_force(spark):
    rng = random.Random(7)
    rows = []
    for i in range(400):
        url = rng.choice(["http://A.com", "http://a.com:80/", "https://b.org/x#f", "https://b.org/x", None, "http://c.net/" + str(i % 7)])
        kind, http = rng.choice([("response", 200), ("response", 200), ("response", 404), ("revisit", 304), ("revisit", 304), ("metadata", None)])
        headers = rng.choice([None, {}, {"ETag": rng.choice(['"1"', 'W/"1"', '"2"'])}, {"last-modified": rng.choice("ab"), "Content-Type": kind}, {"etag": '"1"', "Vary": "v" + str(i)}])
        rows.append((i, url, rng.choice([None, *[float(rng.randrange(12))] * 9]), kind, http, headers, rng.choice([None, "d1", "d2"]), "clash"))
    df = spark.createDataFrame(rows, "record_id long, url string, ts double, kind string, http_status int, headers map<string,string>, digest string, near string")
    keys = {r[0]: r[1] for r in df.select("record_id", revisits.canonical_url(F.col("url"))).collect()}
    assert keys[next(i for i, r in enumerate(rows) if r[1] == "http://A.com")] == keys[next(i for i, r in enumerate(rows) if r[1] == "http://a.com:80/")] == "http://a.com/"
    low = lambda h: {k.lower(): v for k, v in (h or {}).items()}
    for chunk in (86400, 2):
        got = {r.record_id: r for r in revisits.resolve(df, chunk).collect()}
        assert got.keys() == {r[0] for r in rows if r[3] == "revisit"}
        for i, r in got.items():
            me = rows[i]
            earlier = [x for x in rows if x[3] == "response" and x[4] == 200 and x[2] is not None and me[2] is not None and me[1] is not None and keys[x[0]] == keys[i] and (x[2], x[0]) < (me[2], i)]
            if not earlier:
                assert r.status == "missing" and r.response_id is None and r.headers is None
                continue
            base = max(earlier, key=lambda x: (x[2], x[0]))
            a, b = low(me[5]), low(base[5])
            same = None
            if a.get("etag") and b.get("etag"):
                same = a["etag"].removeprefix("W/") == b["etag"].removeprefix("W/")
            elif a.get("last-modified") and b.get("last-modified"):
                same = a["last-modified"] == b["last-modified"]
            elif me[6] and base[6]:
                same = me[6] == base[6]
            assert r.response_id == base[0] and r.status == {None: "unverified", True: "resolved", False: "mismatch"}[same]
            if same is not False:
                assert r.headers == b | {k: v for k, v in a.items() if k in revisits.PERMITTED} and r.digest == base[6]
    assert revisits.resolve(df.limit(0)).count() == 0


def test_only_long_lines_need_the_end_of_a_sentence(spark):
    """A short first line without one stays; a line of 25 words without one goes, wherever it stands."""
    short, long_ = "a title without a stop", " ".join(f"w{i}" for i in range(25))
    body = "\n".join(" ".join(f"x{k}y{i}" for i in range(12)) + "." for k in range(8))
    rows = [(1, f"{short}\n{body}\n{short}"), (2, f"{long_}\n{body}\n{long_} end."), (3, f"{body}\n{long_}")]
    out = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1].cleaned == rows[0][1] and out[1].n_lost_words == 0
    assert out[2].cleaned == f"{body}\n{long_} end." and out[2].n_lost_words == 25
    assert out[3].cleaned == body


def test_judge_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "one two.", 3, "x", 5, 6)], "doc_id long, text string, words int, `row` string, sorted int, fg_words int")
    out = quality.judge(df).first()
    assert (out["words"], out["row"], out["sorted"], out["fg_words"]) == (3, "x", 5, 6)

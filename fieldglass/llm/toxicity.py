"""Toxicity by a weighted finite-state grammar over clauses.

A lexical step turns each word into a class: insult (with a learned weight), threat, target, negation, reported speech or
other. Three small weighted transducers follow and are composed into one machine, whose arcs carry the product of their weights: negation marks insults and threats
within its scope and halves them, reported speech marks what follows it in the clause and halves that, and the target machine joins an insult
or a threat with a target before or after it, at the weight of the insult or threat. Insults weigh what was learned, threats 1.
The machine runs over each clause that holds an insult or a threat and emits weighted
events; a document is described by its events (how many clauses, what weight), and
logistic weights learned from labels turn them into a score. Whether a negated or reported insult still
counts is thus learned, not assumed.

Learning takes at most ``sample_rows`` labelled rows, those with the smallest hash of their id. Insult words and
word stems (at most ``most`` of them, 20,000, the surest first: the lexicon goes to every worker) are terms that stand in at least 19 toxic documents for each other one, and so often that few
among all terms would by chance (a likelihood-ratio test).

Nulls and edges: a null or empty text has no events and gets the score of such texts; rows with a null or missing
label teach nothing; a repeated id in the labels counts as toxic if any row says so; a null id is not held out; without labels
of both kinds every score is the share of toxic labels (0 if there are none); an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.common import joined_id, materialize, small_batches, split_id, spread

#: Words of the grammar's closed classes in English, German, French and Spanish.
THREATS = "kill hurt destroy punish beat shoot stab hang burn attack töten umbringen verprügeln tuer frapper détruire matar golpear destruir".split()
TARGETS = "you your yours u ur he she they them him her people everyone du dich dir euch ihr sie tu te toi vous ils elles tú usted ustedes ellos ellas".split()
NEGATIONS = "not no never nobody nothing without isn aren wasn don doesn didn won nicht kein keine niemals nie pas jamais aucun ne nunca jamás ni".split()
REPORTS = "said says saying wrote quoted claimed reported according called tells told sagte schrieb zitierte dit écrit selon dijo escribió según".split()

TOKEN = re.compile(r"\w+|[.!?;\n]")
STOPS = frozenset(".!?;\n")
STEMS = (4, 5, 6, 7)
EVENTS = ("insult", "insult at target", "threat", "threat at target", "negated", "reported")


class Transducer:
    """Deterministic and weighted: ``arcs[state, symbol] = (next state, output, weight)``; a missing arc stays in the state, copies the symbol and weighs 1."""

    def __init__(self, arcs: dict, start=0):
        self.arcs, self.start = arcs, start

    def step(self, state, symbol):
        return self.arcs.get((state, symbol), (state, symbol, 1.0))[:2]

    def weight(self, state, symbol) -> float:
        return self.arcs.get((state, symbol), (state, symbol, 1.0))[2]


def compose(first: Transducer, second: Transducer, symbols: list[str]) -> Transducer:
    """The machine that feeds the output of ``first`` to ``second``; built from the reachable pairs of states."""
    start = (first.start, second.start)
    arcs, open_, seen = {}, [start], {start}
    while open_:
        pair = open_.pop()
        for symbol in symbols:
            a, middle = first.step(pair[0], symbol)
            b, out = second.step(pair[1], middle)
            arcs[pair, symbol] = ((a, b), out, first.weight(pair[0], symbol) * second.weight(pair[1], middle))
            if (a, b) not in seen:
                seen.add((a, b))
                open_.append((a, b))
    return Transducer(arcs, start)


def negation(scope: int = 3) -> Transducer:
    """I and H within ``scope`` words after N become nI and nH."""
    arcs = {}
    for left in range(scope + 1):
        arcs[left, "N"] = (scope, "o", 1.0)
        for symbol in "IHTRo":
            marked = left and symbol in "IH"
            arcs[left, symbol] = (max(0, left - 1), "n" + symbol if marked else symbol, 0.5 if marked else 1.0)
    return Transducer(arcs)


def reported() -> Transducer:
    """I and H after R in a clause become rI and rH."""
    arcs = {(s, "R"): (1, "o", 1.0) for s in (0, 1)}
    return Transducer(arcs | {(1, x): (1, "r" + x, 0.5) for x in "IH"})


def targeted() -> Transducer:
    """Joins insults and threats with a target before or after them; outputs events."""
    arcs = {}
    for state in ("", "T", "I", "H"):
        arcs[state, "T"] = ("T", {"I": "insult at target", "H": "threat at target"}.get(state, "o"), 1.0)
        arcs[state, "I"] = ("I", "insult at target" if state == "T" else "insult", 1.0)
        arcs[state, "H"] = ("H", "threat at target" if state == "T" else "threat", 1.0)
        for symbol in ("nI", "nH"):
            arcs[state, symbol] = (state, "negated", 1.0)
        for symbol in ("rI", "rH"):
            arcs[state, symbol] = (state, "reported", 1.0)
    return Transducer(arcs, "")


def grammar() -> Transducer:
    symbols = ["I", "H", "T", "N", "R", "o"]
    return compose(compose(negation(), reported(), symbols), targeted(), symbols)


class Scorer:
    """Lexicon and machine; ``features`` describes a text by the events of its clauses."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.machine, self.known = lexicon, grammar(), {}
        self.closed = {w: c for c, ws in (("H", THREATS), ("T", TARGETS), ("N", NEGATIONS), ("R", REPORTS)) for w in ws}

    def classify(self, word: str) -> tuple[str, float]:
        found = self.known.get(word)
        if found is None:
            weight = max([self.lexicon.get(word, 0.0), *(self.lexicon.get(word[:n] + "*", 0.0) for n in STEMS if len(word) >= n)])
            found = ("I", weight) if weight > 0 else (c := self.closed.get(word, "o"), 1.0 if c == "H" else 0.0)
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[word] = found
        return found

    def events(self, clause: list[tuple[str, float]]) -> Iterator[tuple[str, float]]:
        """The machine's weighted events over the symbols of a clause. A target that comes after its insult or threat takes that one's weight."""
        state, held = self.machine.start, 0.0
        for symbol, weight in clause:
            factor = self.machine.weight(state, symbol)
            state, out = self.machine.step(state, symbol)
            if out in EVENTS:
                own = factor * (held if symbol == "T" else weight)
                held = held if out in ("negated", "reported") else own
                yield out, own

    def features(self, text: str | None) -> list[float]:
        """1, then per event log(1 + clauses) and the largest weight, then the log of the number of words."""
        times, most, n = Counter(), {}, 0
        clause: list[tuple[str, float]] = []
        hit, seen = False, set()
        for token in [*TOKEN.findall((text or "").lower()), "."]:
            if token in STOPS:
                if hit:
                    for out, weight in self.events(clause):
                        seen.add(out)
                        most[out] = max(most.get(out, 0.0), weight)
                    times.update(seen)
                clause, hit, seen = [], False, set()
                continue
            n += 1
            found = self.classify(token)
            clause.append(found)
            hit = hit or found[0] in "IH"
        return [1.0, *(x for e in EVENTS for x in (math.log1p(times[e]), most.get(e, 0.0))), math.log1p(n) / 10]


N_FEATURES = 2 + 2 * len(EVENTS)


def _terms(text: str | None) -> set[str]:
    found = {w for w in TOKEN.findall((text or "").lower()) if w not in STOPS}
    return found | {w[:n] + "*" for w in found for n in STEMS if len(w) >= n}


def term_counts(sample: DataFrame) -> DataFrame:
    """term, pos, neg: labelled documents with the term (counted per batch in the tasks, then summed)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pos, neg = Counter(), Counter()
            for text, toxic in zip(batch["t"], batch["toxic"]):
                (pos if toxic else neg).update(_terms(text))
            terms = list(pos.keys() | neg.keys())
            yield pd.DataFrame({"term": terms, "pos": [pos[x] for x in terms], "neg": [neg[x] for x in terms]})

    return sample.select("t", "toxic").mapInPandas(count, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def choose_terms(counts: DataFrame, n_pos: int, n_neg: int, most: int = 20_000) -> dict[str, float]:
    """Terms that mark toxic documents, with their log-odds; at most ``most`` of them, the surest first."""
    base = n_pos / (n_pos + n_neg)
    n = F.col("pos") + F.col("neg")
    q = F.col("pos") / n
    surprise = F.col("pos") * F.log(q / F.lit(base)) + F.when(F.col("neg") > 0, F.col("neg") * F.log((1 - q) / F.lit(1 - base))).otherwise(0.0)
    odds = F.log((F.col("pos") + 0.5) / F.lit(n_pos + 1.0)) - F.log((F.col("neg") + 0.5) / F.lit(n_neg + 1.0))
    fits = counts.filter(F.col("pos") > 2).select("term", "pos", "neg", odds.alias("odds"), surprise.alias("surprise")).filter("pos > 19 * neg")
    limit = math.log(max(counts.count(), 1)) - 2
    return {r["term"]: float(r["odds"]) for r in fits.filter(F.col("surprise") >= limit).orderBy(F.desc("surprise"), "term").limit(most).collect()}


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(id_col: Column, parts: int = 4, part: int = 2) -> Column:
    """Rows kept from learning: crc32 of the id as text leaves ``part``."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = 20_000) -> DataFrame:
    """t, toxic: the texts of the ``sample_rows`` labelled ids with the smallest hashes, none held out."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    drawn = known.orderBy(F.xxhash64("id"), "id").limit(sample_rows)  # at most sample_rows narrow rows, so a broadcast is bounded
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(F.broadcast(drawn), "id").select("t", "toxic")


def learn(sample: DataFrame) -> tuple[dict[str, float], np.ndarray]:
    """Lexicon and weights from rows (t, toxic), whose number the caller bounds."""
    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_pos, n_neg = totals.get(1, 0), totals.get(0, 0)
    if not n_pos or not n_neg:
        share = min(max(n_pos / max(n_pos + n_neg, 1), 1e-9), 1 - 1e-9)
        return {}, np.array([math.log(share / (1 - share)), *[0.0] * (N_FEATURES - 1)])
    lexicon = choose_terms(materialize(term_counts(sample), "terms"), n_pos, n_neg)
    described = describe(sample.select("t", "toxic"), lexicon).toPandas()
    return lexicon, fit_logistic(np.stack(described["x"].to_numpy()), described["toxic"].to_numpy(float))


def describe(sample: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """toxic, x (features) of each sample row."""
    shared = sample.sparkSession.sparkContext.broadcast(lexicon)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield pd.DataFrame({"toxic": batch["toxic"], "x": [scorer.features(t) for t in batch["t"]]})

    return sample.mapInPandas(features, "toxic int, x array<double>")


def score(docs: DataFrame, lexicon: dict[str, float], weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1): one row a document, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, weights))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, w = shared.value
        scorer = Scorer(words)
        for batch in batches:
            x = np.array([scorer.features(t) for t in batch["t"]]).reshape(-1, len(w))
            yield pd.DataFrame({"doc_id": joined_id(batch), "score": 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))})

    return spread(docs.select(*split_id(F.col(id_col)), F.col(text_col).alias("t"))).mapInPandas(each, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted: one row a document."""
    small_batches(docs.sparkSession)
    sample = materialize(spread(training_rows(docs, labels, id_col, text_col, label_col, sample_rows)), "labelled")
    lexicon, weights = learn(sample)
    scored = score(docs, lexicon, weights, id_col, text_col)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

"""Many patterns over many texts by an inverted index of literal grams.

Every alternative of a pattern has a literal that each of its matches must contain. The literals' grams form a posting list; of the grams
of a text only those of the posting list are kept and counted. Each alternative is looked up by its rarest gram, in
an equi-join, and a text that has it is a candidate; the regular expression then decides. So the cost follows the candidates,
not texts times rules. Grams are runs of bytes by their hash, as long as the literal allows, so that few texts hold one by chance. A text's
grams are told from others by a bitmap of bounded size, before the join; what it lets through by chance goes there. Patterns without a literal
of ``sizes[0]`` bytes (``a``, ``\\d+``) are unindexed: each text is tried against each of them, as any method must.

Letter case of A-Z and kind and number of white space are folded in the index only, so it serves patterns with and without ``(?i)``, and with ``\\s+`` between words.

Nulls and edges: a null text matches nothing; rows that share an id are one text with several parts; a null id is an id; a
null pattern never matches and a null ``unless`` never excepts; repeated rules count once; empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldglass.functions.stages import dealt, settle, small_batches

FOLDED = bytes(range(256)).translate(bytes.maketrans(bytes(range(65, 91)) + b"\t\n\v\f\r", bytes(range(97, 123)) + b"     "))
#: White space in patterns: one blank in the index.
BLANKS = (r"[\x20\x09-\x0D]", r"\s", "[ ]")
#: The bitmap of the posting list has 2 ** BITS places.
BITS = 24
META = set(".^$|()[]{}*+?\\")


def _closing(pattern: str, at: int) -> int:
    """Where the bracket or parenthesis that opens at ``at`` closes."""
    if pattern[at] == "[":
        end = at + 1 + (pattern[at + 1 : at + 2] == "^")
        end += pattern[end : end + 1] == "]"
        while end < len(pattern) and pattern[end] != "]":
            end += 2 if pattern[end] == "\\" else 1
        return end
    depth, end = 0, at
    while end < len(pattern):
        c = pattern[end]
        if c == "\\":
            end += 1
        elif c == "[":
            end = _closing(pattern, end)
        elif c in "()":
            depth += 1 if c == "(" else -1
            if not depth:
                return end
        end += 1
    return end


def required_literals(pattern: str) -> list[str]:
    """For each alternative of a regular expression the longest literal that all its matches contain; ``""`` where none is sure. White space counts as a blank.

    A group that must occur and has a literal in each of its alternatives stands for them, if its shortest is longer than what is outside the group.
    Cautious: classes, escapes of kinds and quantified characters only end a literal; an unknown construct ends it too.
    """
    out, best, run, at, inner = [], "", "", 0, []

    def end_run() -> None:
        nonlocal best, run
        best, run = (run if len(run) > len(best) else best), ""

    def end_alternative() -> None:
        nonlocal best, inner
        end_run()
        out.extend(inner if inner and min(map(len, inner)) > len(best) else [best])
        best, inner = "", []

    while at < len(pattern):
        c = pattern[at]
        if c == "|":
            end_alternative()
            at += 1
            continue
        literal = c if c not in META else None
        after, group, blank = at + 1, None, False
        if c in "([":
            if pattern.startswith("(?-", at) or re.match(r"\(\?[a-zA-Z]*[xuU]", pattern[at:]):
                return [""]
            after = _closing(pattern, at) + 1
            group = pattern[at + 1 : after - 1].removeprefix("?:") if c == "(" else None
            blank = pattern[at:after] in BLANKS
        elif c == "\\":
            after = at + 2
            nxt = pattern[at + 1 : at + 2]
            if nxt in ("Q", "E"):
                return [""]
            if nxt in ("x", "u", "0", "c", "p", "P", "k"):
                # a code or name of several characters follows; nothing after it is sure
                end_run()
                rest = pattern.find("|", after)
                if rest >= 0:
                    return [""]
                break
            blank = pattern[at:after] in BLANKS
            literal = nxt if nxt and not nxt.isalnum() else None
        quantifier = pattern[after : after + 1]
        if quantifier in ("*", "?", "{"):
            literal, group, blank = None, None, False
        if blank:
            literal = " "
        if group and not group.startswith("?") and all(found := required_literals(group)) and min(map(len, found)) > min(map(len, inner), default=0):
            inner = found
        if literal is None:
            end_run()
        else:
            run += literal
        if quantifier and quantifier in "*?+{":
            if not (blank and quantifier == "+"):
                end_run()
            after = pattern.find("}", after) + 1 if quantifier == "{" and "}" in pattern[after:] else after + 1
            if pattern[after : after + 1] in ("?", "+"):
                after += 1
        at = after
    end_alternative()
    return out


def folded(text: str) -> bytes:
    """UTF-8 with A-Z in lower case and runs of white space as one blank."""
    return re.sub(b"  +", b" ", text.encode("utf-8", "surrogatepass").translate(FOLDED))


def _grams(text: str, sizes: Sequence[int]) -> dict[int, np.ndarray]:
    """Of each size the hashes of all runs of so many bytes of the folded text."""
    b = np.frombuffer(folded(text), dtype=np.uint8).astype(np.uint64)
    out, h = {}, np.zeros(len(b), dtype=np.uint64)
    for k in range(max(sizes)):
        if k >= len(b):
            break
        h = h[: len(b) - k] * np.uint64(0x100000001B3) + b[k:] + np.uint64(1)
        if k + 1 in sizes:
            x = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            out[k + 1] = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return out


def posting_list(rules: DataFrame, sizes: Sequence[int] = (2, 4, 8, 16)) -> tuple[DataFrame, DataFrame]:
    """(rule, alternative, gram) of the indexed rules, and the rules (rule) that have no sure literal.

    Grams are of the largest of ``sizes`` that the literal holds.
    """

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.LongType())))
    def listed(pattern: pd.Series) -> pd.Series:
        grams = lambda p: [[] if not (g := _grams(x, sizes)) else np.unique(g[max(g)]).view(np.int64).tolist() for x in required_literals(p)]
        return pattern.map(grams)

    found = rules.filter("pattern is not null").select("rule", listed("pattern").alias("grams"))
    short = F.exists("grams", lambda x: F.size(x) == 0)
    return found.filter(~short).select("rule", F.posexplode("grams").alias("alternative", "g")).select("rule", "alternative", F.explode("g").alias("gram")), found.filter(short).select("rule")


def match_rules(texts: DataFrame, rules: DataFrame, id_col: str, text_col: str, sizes: Sequence[int] = (2, 4, 8, 16)) -> DataFrame:
    """id, rule: the texts that a rule's pattern (Java regular expression) finds something in and its ``unless``, if any, does not.

    ``rules`` has rule, pattern and unless.
    """
    spark = texts.sparkSession
    small_batches(spark)
    rules = settle(rules.select("rule", "pattern", "unless").distinct(), "rules")
    posting, unindexed = posting_list(rules, sizes)
    posting, unindexed = settle(posting, "posting"), settle(unindexed, "unindexed")
    read = dealt(texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null"))
    wanted = posting.select("gram").distinct()
    # at most 2 ** BITS numbers
    places = wanted.select(F.shiftrightunsigned("gram", 64 - BITS).cast("int").alias("x")).distinct().toPandas()["x"].to_numpy(np.int64)
    bitmap = np.zeros(1 << BITS, dtype=bool)
    bitmap[places] = True
    bits = spark.sparkContext.broadcast(np.packbits(bitmap))

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def known(text: pd.Series) -> pd.Series:
        let = np.unpackbits(bits.value).view(bool)

        def of(x: str) -> list[int]:
            return [y for h in _grams(x, sizes).values() for y in np.unique(h[let[(h >> np.uint64(64 - BITS)).astype(np.int64)]]).view(np.int64).tolist()]

        return text.map(of)

    hits = settle(read.select("id", F.explode(known("text")).alias("gram")).join(wanted, "gram", "left_semi").distinct(), "hits")
    often = hits.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # an alternative of which any gram occurs nowhere matches nowhere
    rarest = posting.join(often, "gram", "left").groupBy("rule", "alternative").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.bool_and(F.col("n").isNotNull()).alias("occurs"))
    anchors = rarest.filter("occurs").select("rule", "gram").distinct()
    # a text's candidates in one row, at most all rules; so each text is read once, and shuffled without being copied
    candidates = hits.join(anchors, "gram").select(F.col("id").alias("of"), "rule").distinct().join(rules, "rule")
    listed = settle(candidates.groupBy("of").agg(F.collect_list(F.struct("rule", "pattern", "unless")).alias("rules_")), "candidates")
    matches = lambda r: F.rlike(F.col("text"), r["pattern"]) & (r["unless"].isNull() | ~F.rlike(F.col("text"), r["unless"]))
    named = lambda found, of: found.select(F.col("id").alias(id_col), F.explode(of).alias("rule"))
    found = named(read.join(listed, F.col("id").eqNullSafe(F.col("of"))), F.transform(F.filter("rules_", matches), lambda r: r["rule"]))
    rest = unindexed.join(rules, "rule").select("rule", "pattern", "unless").collect()  # patterns that every text must be tried against
    if rest:
        always = [F.when(F.rlike("text", F.lit(r["pattern"])) & (~F.rlike("text", F.lit(r["unless"])) if r["unless"] is not None else F.lit(True)), F.lit(r["rule"])) for r in rest]
        found = found.unionByName(named(read, F.array_compact(F.array(*always))))
    return found.distinct()


def severest(found: DataFrame, rules: DataFrame, ranks: Sequence[str], id_col: str, most: int) -> DataFrame:
    """The ``most`` severest rules of each text, ties by name: a top list per text. ``rules`` has rule and severity, one of ``ranks`` from mild to severe."""
    rank = F.array_position(F.array(*[F.lit(x) for x in ranks]), F.col("severity"))
    rated = found.join(rules.select("rule", "severity").distinct(), "rule")
    order = Window.partitionBy(id_col).orderBy(F.desc(rank), "rule")
    return rated.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)

"""Line-first cleaning and document rules, as DataFrame functions only.

Each line with a word is judged on its own: *punctuation* (a long line without the end of a sentence, or
symbols for half its words), *navigation* (items strung together by separators, or a bare link or menu word) and *boilerplate*
(policy phrases in a short line). Lines that fail are removed. A document is rejected when the words it lost are more
than ``max_lost`` of its words, or when it fails the base rules: fewer than ``min_words`` words, or more than half of
its words in three-word windows that occur twice or more.

Nulls and edges: a null text counts as empty and is rejected (no words); repeated rows are judged alike, each on
its own; an empty table gives an empty result. All columns of the input stay; a column of the same name
as one made here is replaced. Texts are judged whole, whatever their length.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.common import WORD, spread

#: The end of a sentence, symbols, separators of menus, and phrases of menu and boilerplate lines.
SENTENCE = r"[.!?…。！？][\"'”’»)\]]*(\s|$)"
SYMBOLS = r"[#*$%&|<>]"
SEPARATORS = r"[|»›•·]|\s>\s|\s/\s"
MENU = r"(?i)^\s*(home|menu|login|log in|sign in|sign up|search|next|previous|back to top|skip to content|share|tweet|read more|subscribe)\s*[»>›|]*\s*$"
LINK = r"(?i)^\s*(https?://|www\.)\S+\s*$"
BOILERPLATE = r"(?i)all rights reserved|privacy policy|terms of (use|service)|cookie (policy|settings)|accept (all )?cookies|lorem ipsum|enable javascript|copyright (©|\(c\))|©\s*\d{4}"


MADE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lost_words", "cleaned", "base_failed", "kept")


#: A boilerplate phrase holds one of these (lower case); looked for before the pattern, which is dear.
HINTS = ("reserved", "policy", "terms of", "cookie", "lorem", "javascript", "copyright", "©")


def _count(line: Column, pattern: str) -> Column:
    return F.regexp_count(line, F.lit(pattern))


def _word_list(text: Column) -> Column:
    """The words of a text; cut at a single character, which needs no regular expression."""
    return F.filter(F.split(F.translate(text, "\t\n\v\f\r", "     "), " ", -1), lambda w: w != "")


def line_fails(line: Column, n: Column | None = None, hinted: Column | bool = True, long_line: int = 25) -> Column:
    """True for a line of ``n`` words that a rule removes; ``hinted`` is false where no boilerplate phrase can be in it."""
    n = _count(line, WORD) if n is None else n
    punctuation = ((n >= long_line) & ~line.rlike(SENTENCE)) | ((n >= 3) & (2 * _count(line, SYMBOLS) >= n))
    separators = _count(line, SEPARATORS)
    navigation = ((n <= 6) & (line.rlike(MENU) | line.rlike(LINK))) | ((separators >= 3) & (5 * separators >= n))
    boilerplate = F.lit(hinted) & (n <= 40) & line.rlike(BOILERPLATE)
    return punctuation | navigation | boilerplate


def _repeat_words(w: Column, sorted_starts: Column) -> Column:
    """Words in windows that occur twice or more, from the ordered starts of those windows."""
    return F.when(F.size(sorted_starts) == 0, F.lit(0)).otherwise(
        F.aggregate(
            sorted_starts,
            F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
            lambda acc, x: F.struct(x.alias("last"), (acc["n"] + F.least(F.lit(3), x - acc["last"])).alias("n")),
            lambda acc: acc["n"],
        )
    )


def judge(docs: DataFrame, text_col: str = "text", min_words: int = 50, max_repeat: float = 0.5, max_lost: float = 0.5) -> DataFrame:
    """All columns of ``docs`` and: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lost_words, cleaned, kept.

    The windows of a document are hashed and sorted within its row, so nothing is shuffled.
    """
    text = F.coalesce(F.col("row")[text_col], F.lit(""))
    low = F.lower(text)
    hinted = functools.reduce(Column.__or__, [low.contains(x) for x in HINTS])
    one = spread(docs).select(F.struct("*").alias("row")).withColumns({
        "words": _word_list(text),
        "lines": F.transform(F.split(text, "\n", -1), lambda x: F.struct(x.alias("x"), _count(x, WORD).alias("n"))),
        "n_symbols": _count(text, SYMBOLS).cast("long"),
        "hinted": hinted,
    })
    w = F.col("words")
    starts = F.when(F.size(w) >= 3, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>"))
    two = one.withColumns({
        "sorted": F.array_sort(F.transform(starts, lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("i")))),
        "judged": F.transform("lines", lambda x: F.struct(x["x"].alias("x"), x["n"].alias("n"), ((x["n"] > 0) & line_fails(x["x"], x["n"], F.col("hinted"))).alias("bad"))),
    })
    s = F.col("sorted")
    twice = F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | (F.get(s, k + 1)["h"] == x["h"]))
    full = F.transform(F.filter("judged", lambda x: x["n"] > 0), lambda x: x["x"])
    three = two.withColumns({"starts": F.array_sort(F.transform(twice, lambda x: x["i"])), "full": full})
    four = three.withColumns({
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_dup_lines": (F.size("full") - F.size(F.array_distinct("full"))).cast("long"),
        "n_repeat_words": _repeat_words(w, F.col("starts")).cast("long"),
        "n_lost_words": F.aggregate("judged", F.lit(0), lambda acc, x: acc + F.when(x["bad"], x["n"]).otherwise(0)).cast("long"),
        "cleaned": F.array_join(F.transform(F.filter("judged", lambda x: ~x["bad"]), lambda x: x["x"]), "\n"),
    })
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") > F.col("n_words") * F.lit(float(max_repeat)))
    kept = ~failed & (F.col("n_lost_words") <= F.col("n_words") * F.lit(float(max_lost)))
    made = F.struct(*MADE[:-2], failed.alias("base_failed"), kept.alias("kept"))
    # generated, so that a filter on a result is not pushed below and these expressions are not worked out once per reference
    return four.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in MADE], F.inline(F.array(made)))

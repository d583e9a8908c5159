"""Exact quantiles of any number of groups at once, by selection in rounds.

Each wanted order statistic has a bracket: two values of its group, how many values lie below them, and its rank. A round counts the values
inside all brackets in a fixed number of bins and keeps, of each, the bin that holds the rank; the bin's smallest and
largest value are the next bracket. It ends when every bracket is one value. Only counts are shuffled, at most ``bins`` a
bracket and task, so a group with most of all rows needs no more memory than any other; nothing is sampled. Values are held only of groups
with at most ``HELD`` of them, which are sorted as one row each and take no round.

Bins split a bracket's values evenly in rounds 1, 3, ... and by magnitude in rounds 2, 4, ...; both ends have a bin of
their own. So smooth data ends after two rounds, and values over hundreds of orders of magnitude take a few more, never one per value.

Nulls and edges: null and NaN count as missing; groups without a value have no row; a null key is a group; infinite
values are values; an empty table gives an empty result. Quantiles interpolate linearly between neighbours; one that falls on a value is that value.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldglass.functions.stages import settle

#: Groups of so many values at most are sorted whole: for them, counts in bins would be as many rows as the values.
HELD = 4096
#: Beyond this natural-log span, magnitudes split a bracket better than distances.
WIDE = 3.0


def _magnitude(v: Column) -> Column:
    """Rises with v: signed logarithm of its size, moved so that the smallest sizes are near zero."""
    size = F.log(F.least(F.greatest(F.abs(v), F.lit(1e-300)), F.lit(1e308))) + 300 * math.log(10)
    return F.when(v < 0, -size).otherwise(size)


def _bin(v: Column, lo: Column, hi: Column, bins: int, by_magnitude: bool) -> Column:
    """Bin of a value between lo and hi: 0 for lo, bins - 1 for hi, the others by their place between."""
    even = (v * 0.5 - lo * 0.5) / (hi * 0.5 - lo * 0.5)
    place = even
    if by_magnitude:
        low, span = _magnitude(lo), _magnitude(hi) - _magnitude(lo)
        place = F.when(span > WIDE, (_magnitude(v) - low) / span).otherwise(even)
    inner = F.least(F.greatest(F.floor(F.nanvl(place, F.lit(0.0)) * (bins - 2)), F.lit(0)), F.lit(bins - 3)) + 1
    return F.when(v == lo, 0).when(v == hi, bins - 1).otherwise(inner).cast("int")


def _same(left: Sequence[Column], right: Sequence[Column]) -> Column:
    out = F.lit(True)
    for a, b in zip(left, right):
        out = out & a.eqNullSafe(b)
    return out


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: Column, at: Sequence[float], bins: int = 4096) -> DataFrame:
    """keys, n, q0, q1, ...: the number of values and their quantiles ``at`` (0 to 1), for each group that has a value."""
    names = [f"key_{i}" for i in range(len(keys))]
    v = value.cast("double")
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(keys, names)], v.alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    rows = rows.withColumn("v", F.col("v") + F.lit(0.0))  # one zero
    sizes = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).filter("n > 0")
    held = None
    if names:
        sizes = settle(sizes, "sizes")
        few = sizes.filter(F.col("n") <= HELD).select(*[F.col(k).alias(f"b{k}") for k in names])
        if not few.isEmpty():
            of_few = rows.join(few, _same([F.col(k) for k in names], [F.col(f"b{k}") for k in names]), "left_semi")
            held = of_few.groupBy(*names).agg(F.sort_array(F.collect_list("v")).alias("all")).withColumn("n", F.size("all").cast("long"))
        sizes = sizes.filter(F.col("n") > HELD)
    wanted = []
    for i, p in enumerate(at):
        place = F.lit(float(p)) * (F.col("n") - 1)
        wanted += [F.struct(F.lit(2 * i).alias("t"), F.floor(place).alias("r")), F.struct(F.lit(2 * i + 1).alias("t"), F.ceil(place).alias("r"))]
    first = sizes.select(*names, "n", "lo", "hi", F.explode(F.array(*wanted)).alias("w")).select(*names, "n", F.col("w.t").alias("t"), F.col("w.r").alias("r"), F.lit(0).cast("long").alias("below"), "lo", "hi")
    lo, hi = F.when(F.col("r") == F.col("n") - 1, F.col("hi")).otherwise(F.col("lo")), F.when(F.col("r") == 0, F.col("lo")).otherwise(F.col("hi"))
    # brackets of one group are alike or apart, so they are numbered by their lower ends: two a quantile at most
    numbered = lambda df: df.withColumn("slot", F.dense_rank().over(Window.partitionBy(*names).orderBy("lo")) - 1)
    state = settle(numbered(first.select(*names, "n", "t", "r", "below", lo.alias("lo"), hi.alias("hi"))), "brackets")
    closed = [state.filter("lo = hi")]
    turn = 0
    while not (open_ := state.filter("lo < hi")).isEmpty():
        brackets = open_.select(*[F.col(k).alias(f"b{k}") for k in names], F.col("slot").alias("b_slot"), F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi")).distinct()
        group = [F.col(f"b{k}") for k in names]
        inside = rows.join(brackets, _same([F.col(k) for k in names], group) & F.col("v").between(F.col("b_lo"), F.col("b_hi")))
        bin_ = _bin(F.col("v"), F.col("b_lo"), F.col("b_hi"), bins, turn % 2 == 1)
        of = [*[f"b{k}" for k in names], "b_slot"]
        cells = inside.groupBy(*of, bin_.alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("a"), F.max("v").alias("z"))
        # at most ``bins`` rows a bracket
        earlier = Window.partitionBy(*of).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        cells = cells.withColumn("before", F.coalesce(F.sum("c").over(earlier), F.lit(0)))
        off = F.col("r") - F.col("below") - F.col("before")
        here = _same([F.col(k) for k in names], group) & (F.col("slot") == F.col("b_slot")) & (off >= 0) & (off < F.col("c"))
        found = open_.join(cells, here)
        state = found.select(*names, "n", "t", "r", (F.col("below") + F.col("before")).alias("below"), F.when(off == F.col("c") - 1, F.col("z")).otherwise(F.col("a")).alias("lo"), F.when(off == 0, F.col("a")).otherwise(F.col("z")).alias("hi"))
        state = settle(numbered(state), "brackets")
        closed.append(state.filter("lo = hi"))
        turn += 1
    done = closed[0]
    for part in closed[1:]:
        done = done.unionByName(part)
    out = done.groupBy(*names, "n").agg(*[F.max(F.when(F.col("t") == t, F.col("lo"))).alias(f"s{t}") for t in range(2 * len(at))])
    if held is not None:
        place = lambda t: F.lit(float(at[t // 2])) * (F.col("n") - 1)
        out = out.unionByName(held.select(*names, "n", *[F.element_at("all", (F.ceil(place(t)) if t % 2 else F.floor(place(t))).cast("int") + 1).alias(f"s{t}") for t in range(2 * len(at))]))
    quantiles = []
    for i, p in enumerate(at):
        place = F.lit(float(p)) * (F.col("n") - 1)
        a, b, f = F.col(f"s{2 * i}"), F.col(f"s{2 * i + 1}"), place - F.floor(place)
        quantiles.append(F.when(a == b, a).otherwise((1 - f) * a + f * b).alias(f"q{i}"))
    return out.select(*[F.col(k).alias(c) for c, k in zip(keys, names)], "n", *quantiles)


def with_quantiles(grouped: DataFrame, df: DataFrame, keys: Sequence[str], value: Column, at: Sequence[float], names: Sequence[str]) -> DataFrame:
    """``grouped`` (one row a group of ``keys``) with the exact quantiles beside it; null for groups without a value."""
    found = exact_quantiles(df, keys, value, at)
    found = found.select(*[F.col(k).alias(f"on_{i}") for i, k in enumerate(keys)], *[F.col(f"q{i}").alias(name) for i, name in enumerate(names)])
    if not keys:
        return grouped.join(found, F.lit(True), "left")
    joined = grouped.join(found, _same([F.col(k) for k in keys], [F.col(f"on_{i}") for i in range(len(keys))]), "left")
    return joined.drop(*[f"on_{i}" for i in range(len(keys))])

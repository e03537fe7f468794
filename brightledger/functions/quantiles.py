"""Exact quantiles of whole columns without gathering a column in one task.

``percentile`` keeps every distinct value of a column in one aggregation buffer. It is used only while the
buffers of a job stay under a checked number of values. Larger columns are narrowed: a sketch brackets the
wanted order statistic, one counting pass tells where the bracket lies, and this repeats on the open
interval between the bracket ends until few enough values are left to look at. Every pass is a column-pruned
scan with a fixed-size aggregate and no shuffle of rows, and the result is exact.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import durable
from .joins import join_few

BUFFER_VALUES = 250_000
LAST_VALUES = 20_000
SKETCH = 10_000
#: Cells that a class's sketch cuts its interval into.
LATTICE = 256


@dataclass
class _Wanted:
    """The k-th smallest (from 0) of the ``size`` values strictly between ``low`` and ``high``."""

    name: str
    k: int
    size: int
    low: float | None = None
    high: float | None = None
    value: float | None = None

    def inside(self, x: Column) -> Column:
        cond = x.isNotNull()
        if self.low is not None:
            cond = cond & (x > F.lit(self.low))
        if self.high is not None:
            cond = cond & (x < F.lit(self.high))
        return cond


def quantiles(
    df: DataFrame,
    columns: dict[str, Column],
    probs: list[float],
    buffer_values: int = BUFFER_VALUES,
    last_values: int = LAST_VALUES,
    counts: dict[str, int] | None = None,
) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles of every column, nulls left out; all null for an empty column."""
    names = list(columns)
    work = df.select(*[columns[n].cast("double").alias(f"q{i}") for i, n in enumerate(names)])
    if counts is None:
        row = work.agg(*[F.count(f"q{i}").alias(f"q{i}") for i in range(len(names))]).first()
        counts = {n: row[i] for i, n in enumerate(names)}
    out: dict[str, list[float | None]] = {n: [None] * len(probs) for n in names if counts[n] == 0}
    position = {n: f"q{i}" for i, n in enumerate(names)}
    filled = [n for n in names if counts[n] > 0]
    if sum(counts[n] for n in filled) <= buffer_values:
        if filled:
            row = work.agg(*[F.percentile(position[n], F.array(*map(F.lit, probs))).alias(position[n]) for n in filled]).first()
            out.update({n: list(row[position[n]]) for n in filled})
        return out

    slots: dict[tuple[str, int], _Wanted] = {}
    places: dict[str, list[tuple[int, int, float]]] = {}
    for n in filled:
        places[n] = []
        for p in probs:
            at = p * (counts[n] - 1)
            k = math.floor(at)
            nxt = min(k + 1, counts[n] - 1)
            places[n].append((k, nxt, at - k))
            for r in (k, nxt):
                slots.setdefault((n, r), _Wanted(n, r, counts[n]))
    _resolve(work, position, list(slots.values()), last_values)
    for n in filled:
        out[n] = []
        for k, nxt, part in places[n]:
            lower, upper = slots[(n, k)].value, slots[(n, nxt)].value
            out[n].append(lower if part == 0 else lower * (1 - part) + upper * part)
    return out


def _resolve(work: DataFrame, position: dict[str, str], slots: list[_Wanted], last_values: int) -> None:
    while True:
        wide = [s for s in slots if s.value is None and s.size > last_values]
        if not wide:
            break
        # One sketch per interval answers for all its slots; neighbouring ranks share a bracket.
        intervals = _grouped(wide, lambda s: (s.name, s.low, s.high))
        bracket_of = {}
        aggs, asked = [], []
        for (name, _, _), members in intervals.items():
            x = F.col(position[name])
            probs = sorted({p for s in members for p in _around(s)})
            aggs.append(F.percentile_approx(F.when(members[0].inside(x), x), F.array(*map(F.lit, probs)), SKETCH).alias(f"s{len(aggs)}"))
            asked.append((members, probs))
        row = work.agg(*aggs).first()
        for i, (members, probs) in enumerate(asked):
            found = dict(zip(probs, row[i]))
            for s in members:
                bracket_of[id(s)] = tuple(found[p] for p in _around(s))
        counted = _grouped(wide, lambda s: (s.name, s.low, s.high, *bracket_of[id(s)]))
        aggs = []
        for (name, _, _, lo, hi), members in counted.items():
            x = F.col(position[name])
            inside = members[0].inside(x)
            aggs.append(F.struct(
                F.count_if(inside & (x < F.lit(lo))).alias("below"),
                F.count_if(inside & (x == F.lit(lo))).alias("at_lo"),
                F.count_if(inside & (x > F.lit(lo)) & (x < F.lit(hi))).alias("between"),
                F.count_if(inside & (x == F.lit(hi))).alias("at_hi"),
            ).alias(f"s{len(aggs)}"))
        tallies = work.agg(*aggs).first()
        for i, members in enumerate(counted.values()):
            for s in members:
                _step(s, bracket_of[id(s)], tallies[i])
    last = _grouped([s for s in slots if s.value is None], lambda s: (s.name, s.low, s.high))
    if last:
        row = work.agg(*[
            F.sort_array(F.collect_list(F.when(members[0].inside(F.col(position[name])), F.col(position[name])))).alias(f"s{i}")
            for i, ((name, _, _), members) in enumerate(last.items())
        ]).select(*[
            F.array(*[F.element_at(F.col(f"s{i}"), s.k + 1) for s in members]).alias(f"s{i}") for i, members in enumerate(last.values())
        ]).first()
        for i, members in enumerate(last.values()):
            for s, v in zip(members, row[i]):
                s.value = v


def _grouped(slots: list[_Wanted], key) -> dict:
    out: dict = {}
    for s in slots:
        out.setdefault(key(s), []).append(s)
    return out


def _around(s: _Wanted) -> tuple[float, float]:
    """Probabilities that bracket a rank, on a fixed lattice so that close ranks get the same ones."""
    cell = math.floor((s.k + 0.5) / s.size * SKETCH)
    return max(0, cell - 2) / SKETCH, min(SKETCH, cell + 3) / SKETCH


def _step(s: _Wanted, bracket, tally) -> None:
    lo, hi = bracket
    below, at_lo, between = tally["below"], tally["at_lo"], tally["between"]
    at_hi = tally["at_hi"] if hi != lo else 0
    if s.k < below:
        s.high, s.size = lo, below
    elif s.k < below + at_lo:
        s.value = lo
    elif s.k < below + at_lo + between:
        s.k -= below + at_lo
        s.low, s.high, s.size = lo, hi, between
    elif s.k < below + at_lo + between + at_hi:
        s.value = hi
    else:
        taken = below + at_lo + between + at_hi
        s.k -= taken
        s.low, s.size = hi, s.size - taken


def quantiles_by_class(df: DataFrame, label: Column, value: Column, probs: list[float], class_rows: int = BUFFER_VALUES, last_values: int = LAST_VALUES) -> DataFrame:
    """(class, q array): exact quantiles of ``value`` inside every class.

    Classes up to ``class_rows`` rows use one grouped ``percentile``. All larger ones are narrowed together: a sketch a
    class brackets the wanted ranks, one pass counts where the brackets lie, and this repeats on the open intervals
    until few values are left in each. What is shuffled by class are sketches, counts and the last few values.
    """
    pairs = df.select(label.alias("class"), value.cast("double").alias("v")).where("class is not null and v is not null")
    sizes = durable(pairs.groupBy("class").agg(F.count(F.lit(1)).alias("n")))
    large = sizes.where(F.col("n") > class_rows)
    if large.isEmpty():
        return pairs.groupBy("class").agg(F.percentile("v", F.array(*map(F.lit, probs))).alias("q"))
    few = join_few(pairs, large.select("class"), "class", "left_anti")
    small = few.groupBy("class").agg(F.percentile("v", F.array(*map(F.lit, probs))).alias("q"))
    found = _ranks_by_class(pairs, _wanted_ranks(large, probs), last_values)
    at = lambda end: F.col(f"m.{end}")
    value = F.when(F.col("part") == 0, at("low")).otherwise(at("low") * (1 - F.col("part")) + at("high") * F.col("part"))
    ends = found.groupBy("class", "p").agg(F.max("part").alias("part"), F.struct(F.max(F.when(F.col("end") == 0, F.col("value"))).alias("low"), F.max(F.when(F.col("end") == 1, F.col("value"))).alias("high")).alias("m"))
    wide = ends.select("class", "p", value.alias("x")).groupBy("class").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias("q"))
    return small.unionByName(wide)


def _wanted_ranks(sizes: DataFrame, probs: list[float]) -> DataFrame:
    """One row a class, probability and end: the rank k (from 0) to find among the class's n values, all of them open."""
    each = sizes.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(len(probs) - 1))))
    place = F.element_at(F.array(*map(F.lit, map(float, probs))), F.col("p") + 1) * (F.col("n") - 1)
    low = F.floor(place)
    each = each.withColumn("part", place - low).withColumn("k", low).withColumn("end", F.explode(F.array(F.lit(0), F.lit(1))))
    k = F.least(F.col("k") + F.col("end"), F.col("n") - 1)
    nothing = F.lit(None).cast("double")
    return each.select("class", "p", "end", "part", k.alias("k"), F.col("n").alias("size"), nothing.alias("lo"), nothing.alias("hi"), nothing.alias("value"))


def _inside() -> Column:
    return F.coalesce(F.col("v") > F.col("lo"), F.lit(True)) & F.coalesce(F.col("v") < F.col("hi"), F.lit(True))


def _ranks_by_class(pairs: DataFrame, state: DataFrame, last_values: int) -> DataFrame:
    """The state with every value found."""
    keys = ["class", "p", "end"]
    lattice = [i / LATTICE for i in range(LATTICE + 1)]
    state = durable(state)
    while True:
        open_ = state.where(F.col("value").isNull() & (F.col("size") > last_values))
        if open_.isEmpty():
            break
        # Ranks that are still in one interval share its sketch.
        intervals = durable(open_.groupBy("class").agg(F.collect_set(F.struct("lo", "hi")).alias("intervals")))
        spread = join_few(pairs, intervals, "class").select("class", "v", F.explode("intervals").alias("i")).select("class", "v", "i.*").where(_inside())
        sketches = spread.groupBy("class", "lo", "hi").agg(F.percentile_approx("v", F.array(*map(F.lit, lattice)), SKETCH).alias("marks"))
        cell = F.floor((F.col("k") + 0.5) / F.col("size") * LATTICE)
        mark = lambda i: F.element_at("marks", F.greatest(F.lit(0), F.least(F.lit(LATTICE), i)).cast("int") + 1)
        chosen = open_.alias("s").join(sketches.alias("k"), reduce(lambda a, b: a & b, [F.col(f"s.{c}").eqNullSafe(F.col(f"k.{c}")) for c in ("class", "lo", "hi")]))
        chosen = durable(chosen.select(*[F.col(f"s.{c}").alias(c) for c in state.columns], mark(cell - 1).alias("a"), mark(cell + 2).alias("b")))
        asked = durable(chosen.groupBy("class").agg(F.collect_list(F.struct(*keys, "lo", "hi", "a", "b")).alias("asked")))
        rows = join_few(pairs, asked, "class").select("v", F.explode("asked").alias("x")).select("v", "x.*").where(_inside())
        a, b = F.col("v") < F.col("a"), F.col("v") > F.col("b")
        tally = rows.groupBy(*keys).agg(
            F.count_if(a).alias("below"), F.count_if(F.col("v") == F.col("a")).alias("at_a"), F.count_if((F.col("v") > F.col("a")) & (F.col("v") < F.col("b"))).alias("between"),
            F.count_if((F.col("v") == F.col("b")) & (F.col("b") != F.col("a"))).alias("at_b"))
        c = chosen.join(tally, keys)
        e1 = F.col("below")
        e2, e3 = e1 + F.col("at_a"), e1 + F.col("at_a") + F.col("between")
        e4, k = e3 + F.col("at_b"), F.col("k")
        moved = c.select(
            *keys, "part", F.when(k < e1, k).when(k < e3, k - e2).otherwise(k - e4).alias("k"),
            F.when(k < e1, e1).when(k < e3, F.col("between")).otherwise(F.col("size") - e4).alias("size"),
            F.when(k < e1, F.col("lo")).when(k < e3, F.col("a")).otherwise(F.col("b")).alias("lo"),
            F.when(k < e1, F.col("a")).when(k < e3, F.col("b")).otherwise(F.col("hi")).alias("hi"),
            F.when((k >= e1) & (k < e2), F.col("a")).when((k >= e3) & (k < e4), F.col("b")).alias("value"),
        )
        closed = state.where(F.col("value").isNotNull() | (F.col("size") <= last_values))
        state = durable(closed.unionByName(moved))
    last = durable(state.where("value IS NULL").groupBy("class").agg(F.collect_list(F.struct(*keys, "k", "lo", "hi", "part")).alias("asked")))
    rows = join_few(pairs, last, "class").select("v", F.explode("asked").alias("x")).select("v", "x.*").where(_inside())
    found = rows.groupBy(*keys).agg(F.max("part").alias("part"), F.max("k").alias("k"), F.sort_array(F.collect_list("v")).alias("vs"))
    found = found.select(*keys, "part", F.element_at("vs", (F.col("k") + 1).cast("int")).alias("value"))
    return state.where("value IS NOT NULL").select(*keys, "part", "value").unionByName(found)


def medians(df: DataFrame, columns: dict[str, Column]) -> dict[str, float | None]:
    return {n: v[0] for n, v in quantiles(df, columns, [0.5]).items()}

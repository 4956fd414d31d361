"""Exact order statistics and quantiles without gathering a column in one task.

``percentile`` keeps every distinct value of a column in one task. Here each pass is a plain partial aggregation:
approximate quantiles bracket the wanted rank, counts around the bracket say where the rank really lies, and the few
values strictly inside a small bracket are read exactly. A bracket shrinks by about the sketch accuracy per round, so
one round serves 10^8 rows and two rounds 10^12; equal values are counted, never listed, so a value that fills a third
of the table costs nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearwell.functions.numeric import present
from clearwell.functions.types import quoted

ACCURACY = 10_000
MAX_INSIDE = 50_000
COLUMNS_PER_JOB = 16


@dataclass
class _Search:
    """One wanted rank (0-based) of one column inside an open interval of values."""

    column: str
    rank: int
    anchor: int  # ranks of one quantile share a bracket around this one
    low: float | None = None
    high: float | None = None
    not_above_low: int = 0
    below_high: int = 0
    answer: float | None = None
    bracket: tuple[float, float] = (0.0, 0.0)

    @property
    def size(self) -> int:
        return self.below_high - self.not_above_low

    @property
    def interval(self) -> tuple:
        return self.column, self.low, self.high

    def fractions(self) -> list[float]:
        at, margin = self.anchor - self.not_above_low, 2 * self.size / ACCURACY
        return [min(1.0, max(0.0, f / self.size)) for f in (at - margin, at + 2 + margin)]


def exact_quantiles(
    df: DataFrame,
    columns: list[str],
    probabilities: list[float],
    max_inside: int = MAX_INSIDE,
) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles per column, null and NaN ignored; ``None`` where a column has no value.

    Runs a few jobs over ``df``; what reaches the driver is one row of counts and at most ``max_inside`` values per
    rank. The path is the same for every number of rows. Persist or write an expensive ``df`` first.
    """
    out: dict[str, list[float | None]] = {}
    for start in range(0, len(columns), COLUMNS_PER_JOB):
        chunk = columns[start : start + COLUMNS_PER_JOB]
        types = dict(df.dtypes)
        narrow = df.select(
            *[present(F.col(quoted(c)), types[c]).cast("double").alias(f"v{i}") for i, c in enumerate(chunk)]
        )
        counts = narrow.agg(*[F.count(v).alias(v) for v in narrow.columns]).first().asDict()
        filled = {v: n for v, n in counts.items() if n}
        found = _narrowing(narrow, filled, probabilities, max_inside) if filled else {}
        out.update({c: found.get(f"v{i}") or [None] * len(probabilities) for i, c in enumerate(chunk)})
    return out


def exact_medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    return {c: q[0] for c, q in exact_quantiles(df, columns, [0.5]).items()} if columns else {}


def _narrowing(
    narrow: DataFrame, counts: dict[str, int], probabilities: list[float], max_inside: int
) -> dict[str, list[float]]:
    positions = {c: [p * (n - 1) for p in probabilities] for c, n in counts.items()}
    searches: dict[tuple[str, int], _Search] = {}
    for c, wanted in positions.items():
        for pos in wanted:
            for rank in (math.floor(pos), math.ceil(pos)):
                searches.setdefault((c, rank), _Search(c, rank, math.floor(pos), below_high=counts[c]))

    while open_ := [s for s in searches.values() if s.answer is None]:
        _bracket(narrow, open_)
        _locate(narrow, open_, max_inside)

    out: dict[str, list[float]] = {}
    for c, wanted in positions.items():
        out[c] = []
        for pos in wanted:
            low, high = searches[(c, math.floor(pos))].answer, searches[(c, math.ceil(pos))].answer
            out[c].append(low if low == high else low + (high - low) * (pos - math.floor(pos)))
    return out


def _between(value: Column, low: float | None, high: float | None) -> Column:
    cond = value.isNotNull()
    if low is not None:
        cond = cond & (value > F.lit(low))
    if high is not None:
        cond = cond & (value < F.lit(high))
    return cond


def _bracket(narrow: DataFrame, searches: list[_Search]) -> None:
    """Approximate values just below and just above every wanted rank, one sketch per column and interval."""
    groups: dict[tuple, list[_Search]] = {}
    for s in searches:
        groups.setdefault(s.interval, []).append(s)
    exprs = []
    for g, ((c, low, high), members) in enumerate(groups.items()):
        inside = F.when(_between(F.col(c), low, high), F.col(c))
        fractions = [f for s in members for f in s.fractions()]
        exprs.append(F.percentile_approx(inside, fractions, ACCURACY).alias(f"g{g}"))
    row = narrow.agg(*exprs).first()
    for g, members in enumerate(groups.values()):
        for i, s in enumerate(members):
            s.bracket = (row[f"g{g}"][2 * i], row[f"g{g}"][2 * i + 1])


def _locate(narrow: DataFrame, searches: list[_Search], max_inside: int) -> None:
    """Count around each bracket, then answer or narrow the search."""
    bounds = sorted({(s.column, x) for s in searches for x in s.bracket})
    name = {key: i for i, key in enumerate(bounds)}
    exprs = []
    for (c, x), i in name.items():
        exprs += [F.count_if(F.col(c) < x).alias(f"lt{i}"), F.count_if(F.col(c) <= x).alias(f"le{i}")]
    # The sketch bounds what can lie strictly between: bracket width plus its error on both ends.
    readable = {
        (s.column, *s.bracket): None for s in searches if 8 * s.size / ACCURACY + 16 <= max_inside
    }
    for i, (c, a, b) in enumerate(readable):
        v = F.col(c)
        exprs.append(F.sort_array(F.collect_list(F.when((v > a) & (v < b), v))).alias(f"in{i}"))
    row = narrow.agg(*exprs).first().asDict()
    inside = {key: row[f"in{i}"] for i, key in enumerate(readable)}
    for s in searches:
        a, b = s.bracket
        i, j = name[(s.column, a)], name[(s.column, b)]
        lt_a, le_a, lt_b, le_b = row[f"lt{i}"], row[f"le{i}"], row[f"lt{j}"], row[f"le{j}"]
        if s.rank < lt_a:
            s.high, s.below_high = a, lt_a
        elif s.rank < le_a:
            s.answer = a
        elif s.rank < lt_b:
            values = inside.get((s.column, a, b))
            if values is not None:
                s.answer = values[s.rank - le_a]
            else:
                s.low, s.high, s.not_above_low, s.below_high = a, b, le_a, lt_b
        elif s.rank < le_b:
            s.answer = b
        else:
            s.low, s.not_above_low = b, le_b

"""String expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from clearwell.functions.fixed_values import DATE_LAYOUTS, NULL_SENTINELS, WHITESPACE


def strip(c: Column) -> Column:
    """Trim every Unicode whitespace character on both ends, nulls stay null."""
    return F.btrim(c, F.lit(WHITESPACE))


def null_sentinels(c: Column) -> Column:
    """Texts such as ``NA`` or ``null`` become null."""
    return F.when(~c.isin(*NULL_SENTINELS), c)


def title_case(c: Column) -> Column:
    """Capitalize the first cased letter after anything that is not one (``O'Neil A-B C3Po``).

    ``initcap`` only looks at spaces, so the text is cut into runs of cased letters and the rest.
    """
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"([\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+)"), F.lit(1))

    def capitalize(run: Column) -> Column:
        head = F.upper(F.substring(run, 1, 1))  # may grow: one sharp s becomes two letters
        return F.concat(F.substring(head, 1, 1), F.lower(F.substr(head, F.lit(2))), F.substr(run, F.lit(2)))

    return F.when(c.isNotNull(), F.array_join(F.transform(runs, capitalize), ""))


def contains_any(c: Column, phrases: tuple[str, ...]) -> Column:
    """True where the text holds one of the phrases; plain substring search stays in generated code."""
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(p)) for p in phrases])


def first_group(c: Column, groups: tuple, default: str) -> Column:
    """Name of the first (name, phrases) group with a phrase in the lower-cased text."""
    low = F.lower(c)
    chain = None
    for name, phrases in groups:
        hit = contains_any(low, phrases)
        chain = F.when(hit, F.lit(name)) if chain is None else chain.when(hit, F.lit(name))
    return chain.otherwise(F.lit(default))


def parse_timestamp(c: Column, layouts: tuple = DATE_LAYOUTS) -> Column:
    """ISO text first, then the listed layouts; unparseable text is null.

    A failing layout parser raises and catches an exception per row, so each one only sees text of its own shape.
    """
    c = strip(c)
    slow = F.coalesce(
        F.when(c.rlike("[0-9][tz]"), F.upper(c).try_cast("timestamp")),  # ISO text after lower-casing
        *[F.when(c.rlike(shape), F.try_to_timestamp(c, F.lit(p))) for p, shape in layouts],
    )
    return F.coalesce(c.try_cast("timestamp"), slow)

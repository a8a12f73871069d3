"""Null-aware column expressions shared by every operator.

Missing values are NULL throughout (never NaN), comparisons with a missing value
count as false where a rate is taken, and rounding is half-to-even unless an
operator says otherwise. All helpers build plain Spark expressions, so they stay
inside whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c: Column | str, lo: float | None = None, hi: float | None = None) -> Column:
    """Bound a value and keep NULL as NULL (greatest/least alone would skip it)."""
    c = col(c)
    bounded = c
    if lo is not None:
        bounded = F.greatest(bounded, F.lit(float(lo)))
    if hi is not None:
        bounded = F.least(bounded, F.lit(float(hi)))
    return F.when(c.isNotNull(), bounded)


def ratio(n: Column | str, d: Column | str, fill: float | None = 0.0) -> Column:
    """n / d; a zero or missing divisor or a missing dividend gives ``fill``."""
    q = F.try_divide(col(n), col(d))
    return q if fill is None else F.coalesce(q, F.lit(float(fill)))


def holds(cond: Column) -> Column:
    """A condition with unknown read as false."""
    return F.coalesce(cond, F.lit(False))


def share(cond: Column) -> Column:
    """Aggregate: share of rows where the condition holds, unknown counted as not."""
    return F.avg(holds(cond).cast("double"))


def total(c: Column | str) -> Column:
    """Aggregate: sum that is 0 for an all-missing group."""
    return F.coalesce(F.sum(col(c)), F.lit(0.0))


def number(c: Column | str) -> Column:
    """Tolerant numeric reading: unreadable text and NaN become NULL."""
    text = F.trim(col(c).cast("string"))
    # the pattern keeps out the type suffixes ("12d") a plain cast would accept
    return F.when(text.rlike(r"(?i)^[+-]?(inf|infinity|[0-9.]+(e[+-]?[0-9]+)?)$"), text.try_cast("double"))


def clean_double(c: Column | str) -> Column:
    """A numeric column as double with NaN turned into NULL."""
    return F.nullif(col(c).cast("double"), F.lit(float("nan")))


def recode(c: Column | str, mapping: Mapping[str, object]) -> Column:
    """Look a value up in a small fixed table; anything else is NULL."""
    pairs = [F.lit(v) for item in mapping.items() for v in item]
    return F.try_element_at(F.create_map(*pairs), col(c))


def allowed(c: Column | str, levels: Sequence[str]) -> Column:
    c = col(c).cast("string")
    return F.when(c.isin(*levels), c)


def first_match(cases: Sequence[tuple[Column, object]], otherwise: object = None) -> Column:
    """A when-chain from (condition, value) pairs."""
    chain = F
    for cond, value in cases:
        chain = chain.when(cond, value if isinstance(value, Column) else F.lit(value))
    if otherwise is None:
        return chain
    return chain.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def upper_closed_band(c: Column, low: float | None, bands: Sequence[tuple[float, str]],
                      top: str | None = None) -> Column:
    """Label of the first band (previous, edge] that holds the value."""
    cases = [(c <= F.lit(float(edge)), label) for edge, label in bands]
    chosen = first_match(cases, top)
    inside = c.isNotNull() if low is None else c > F.lit(float(low))
    return F.when(inside, chosen)


def lower_closed_rank(c: Column, edges: Sequence[float]) -> Column:
    """Number of the band [edge, next edge) that holds the value, as a double."""
    cases = [(c < F.lit(float(edge)), float(i)) for i, edge in enumerate(edges[1:])]
    return F.when(c >= F.lit(float(edges[0])), first_match(cases))


def yes_no(c: Column | str) -> Column:
    text = F.lower(F.trim(col(c).cast("string")))
    return first_match([
        (text.isin("yes", "true", "y", "1"), "Yes"),
        (text.isin("no", "false", "n", "0"), "No"),
    ])


def names_where(conditions: Mapping[str, Column]) -> Column:
    """Array of the names whose condition holds, in the given order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in conditions.items()]))


def values_of(one_row: DataFrame, *names: str) -> dict[str, Column]:
    """Columns of a one-row table for use in another query: one scalar subquery, however
    many of its fields are read, and no join."""
    names = names or tuple(one_row.columns)
    row = one_row.select(F.struct(*names)).scalar()
    return {n: row[n] for n in names}


def half_even(c: Column | str, places: int = 0) -> Column:
    """Round half to even on the double itself, as the numeric libraries do (Spark's own
    ``bround`` works on the printed decimal and differs where that ends in a 5)."""
    scale = float(10 ** places)
    return F.rint(col(c) * F.lit(scale)) / F.lit(scale) if places else F.rint(col(c))


def percent_change(old: Column | str, new: Column | str) -> Column:
    """Change in percent of the old magnitude, 2 places; NULL from zero or missing."""
    old, new = col(old), col(new)
    return half_even(F.try_divide(F.lit(100.0) * (new - old), F.abs(old)), 2)


def fixed(c: Column, places: int = 0) -> Column:
    """Number text with thousands separators (rounds half to even)."""
    return F.format_number(c, places)


def plain(c: Column, places: int = 0) -> Column:
    """Number text without thousands separators."""
    return F.regexp_replace(fixed(c, places), ",", "")


def percent(c: Column, places: int = 0) -> Column:
    return F.concat(plain(c * F.lit(100.0), places), F.lit("%"))


def worded(sentence: str, **slots: Column) -> Column:
    """A sentence with its named slots filled by columns; it is taken apart when the plan is built."""
    pieces = Formatter().parse(sentence)
    return F.concat(*[c for text, slot, _, _ in pieces for c in
                      ([F.lit(text)] if text else []) + ([slots[slot]] if slot else [])])


def sentence_list(items: Column) -> Column:
    """['a','b','c'] -> 'a, b and c'."""
    n = F.size(items)
    return F.when(n <= 1, F.array_join(items, "")).otherwise(
        F.concat(F.array_join(F.slice(items, F.lit(1), F.greatest(n - 1, F.lit(1))), ", "),
                 F.lit(" and "), F.try_element_at(items, F.lit(-1)))
    )


def shorten(c: Column | str, limit: int = 80) -> Column:
    c = col(c)
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.left(c, F.lit(limit)), F.lit("…")))


def initials(c: Column | str) -> Column:
    words = F.filter(F.split(F.trim(col(c)), r"\s+"), lambda w: F.length(w) > 0)
    return F.array_join(F.transform(words, lambda w: F.left(w, F.lit(1))), "")


def age_text(then: Column, now: Column) -> Column:
    """Elapsed time in the largest whole unit among minutes, hours and days."""
    minutes = F.floor((F.unix_timestamp(now) - F.unix_timestamp(then)) / F.lit(60))
    return first_match([
        (minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago"))),
        (minutes < 1440, F.concat(F.floor(minutes / 60).cast("string"), F.lit("h ago"))),
    ], F.concat(F.floor(minutes / 1440).cast("string"), F.lit("d ago")))

"""What-if table: every application under every adjustment set."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocabulary as v
from ..functions.expr import first_match, fixed, half_even, plain, worded


def scenario_table(applications: DataFrame, scenarios: Mapping[str, Mapping[str, Column | float | str]],
                   rescore: Callable[[DataFrame], DataFrame], id_col: str = "application_id",
                   keep: Sequence[str] = ()) -> DataFrame:
    """Rescore each application under each named set of adjusted fields.

    ``rescore`` appends ``risk_score`` and ``risk_level``. The scenarios are a handful
    of literals, so each row is expanded in place by an array of structs: no join, and
    one scoring pass over baseline and variants. The adjusted values may be columns
    (e.g. ``F.col("Income") * 1.2``).
    """
    fields = [c for c in v.BASE if c in applications.columns]
    kept = [id_col, *keep]

    def variant(name: str, changes: Mapping[str, Column | float | str]) -> Column:
        cols = []
        for f in fields:
            new = changes.get(f)
            if new is None:
                cols.append(F.col(f))
                continue
            new = new if isinstance(new, Column) else F.lit(new)
            kind = "double" if f in v.NUMERIC_BOUNDS else "string"
            cols.append(F.coalesce(new.cast(kind), F.col(f)).alias(f))
        return F.struct(F.lit(name).alias("scenario"), *cols)

    base = rescore(applications).select(
        "*", F.col("risk_score").alias("baseline_score"), F.col("risk_level").alias("baseline_level"),
    ).drop("risk_score", "risk_level")
    expanded = base.select(
        *kept, "baseline_score", "baseline_level", F.struct(*fields).alias("_base"),
        F.inline(F.array(*[variant(n, c) for n, c in scenarios.items()])))
    out = rescore(expanded)
    delta = F.col("risk_score") - F.col("baseline_score")
    changed = F.array_compact(F.array(*[
        F.when(F.col(f).isNotNull() & ~F.col(f).eqNullSafe(F.col(f"_base.{f}")),
               F.concat(F.lit(v.LABELS[f] + " -> "),
                        plain(F.col(f), 2) if f in v.NUMERIC_BOUNDS else F.col(f)))
        for f in fields]))
    return out.select(
        *kept, "scenario", "baseline_score", "baseline_level", "risk_score", "risk_level",
        half_even(delta, 2).alias("score_change"), (delta < 0).alias("improved"),
        changed.alias("changed_fields"), movement_sentence(
            F.col("baseline_score"), F.col("risk_score"), changed).alias("narrative"))


def movement_sentence(before: Column, after: Column, changed: Column) -> Column:
    delta = after - before
    what = F.when(F.size(changed) > 0, F.array_join(changed, ", ")).otherwise("no fields")
    say = lambda way, **slots: worded(v.SCORE_MOVED[way], what=what, before=fixed(before), after=fixed(after), **slots)
    return first_match([(F.abs(delta) < F.lit(0.5), say("unchanged")), (delta < 0, say("lower", points=plain(-delta)))],
                       say("higher", points=plain(delta)))

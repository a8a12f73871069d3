"""Probability -> score -> level -> confidence -> decision, as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocabulary as v
from .expr import clip, col, first_match


@dataclass(frozen=True)
class Cutoffs:
    """Probability cut points tuned on a validation set."""

    low: float
    high: float
    decision: float = 0.5


def risk_score(p: Column | str, cut: Cutoffs) -> Column:
    """Piecewise-linear 0-100 score with the cut points landing on 25 and 75."""
    p = clip(p, 0.0, 1.0)
    knots = [(0.0, 0.0), (cut.low, v.LOW_SCORE), (cut.high, v.HIGH_SCORE), (1.0, 100.0)]
    pieces = []
    for (x0, y0), (x1, y1) in zip(knots, knots[1:]):
        width = x1 if x0 == 0.0 else max(x1 - x0, 1e-9)
        line = F.lit(y0) + F.lit(y1 - y0) * (p - F.lit(x0)) / F.lit(width)
        pieces.append((p <= F.lit(x1), line))
    return clip(first_match(pieces), 0.0, 100.0)


def risk_level(score: Column | str) -> Column:
    s = col(score)
    return F.when(s.isNotNull(), first_match(
        [(s < F.lit(v.LOW_SCORE), "low"), (s >= F.lit(v.HIGH_SCORE), "high")], "medium"))


def confidence(p: Column | str, cut: Cutoffs | None = None) -> Column:
    """Distance from maximal doubt and from the nearest band edge, 0.55 to 1."""
    p = clip(p, 0.0, 1.0)
    separation = F.abs(p - F.lit(0.5)) * F.lit(2.0)
    if cut is None:
        return clip(F.lit(0.55) + F.lit(0.45) * separation, 0.0, 1.0)
    nearest = F.least(F.abs(p - F.lit(cut.low)), F.abs(p - F.lit(cut.high)))
    margin = clip(nearest / F.lit(0.15), 0.0, 1.0)
    return clip(F.lit(0.55) + F.lit(0.25) * separation + F.lit(0.20) * margin, 0.0, 1.0)


def recommendation(score: Column | str, fraud: Column | str,
                   approve_at: float = v.LOW_SCORE, reject_at: float = v.HIGH_SCORE) -> Column:
    """Automatic decision. A score of exactly ``approve_at`` is approved here although
    its level is already medium; both readings are kept on purpose."""
    s, f = col(score), F.coalesce(col(fraud), F.lit(False))
    return first_match([
        ((s <= F.lit(approve_at)) & ~f, "approve"),
        ((s >= F.lit(reject_at)) | f, "reject"),
    ], "review")


def status_after(decision: Column) -> Column:
    return first_match([(decision == "approve", "approved"), (decision == "reject", "rejected")],
                       "under_review")


def psi_status(psi: Column | str) -> Column:
    p = col(psi)
    return first_match([(p >= F.lit(v.PSI_ALERT), "alert"), (p >= F.lit(v.PSI_WARN), "warning")],
                       "stable")


def eligibility_points(income: Column, loan: Column, credit_score: Column,
                       dti_percent: Column, years_employed: Column) -> Column:
    """Applicant-side points, 0-850, higher is better (a scale of its own)."""
    d = lambda c: c.cast("double")
    lti = F.try_divide(d(loan), d(income))
    # zero income makes the ratio unbounded, which earns nothing
    lti_points = F.coalesce(F.greatest(F.lit(0.0), (F.lit(5.0) - lti) / F.lit(5.0)), F.lit(0.0))
    points = (F.lit(400.0)
              + F.least(d(credit_score) / F.lit(850.0), F.lit(1.0)) * F.lit(200.0)
              + F.greatest(F.lit(0.0), (F.lit(36.0) - d(dti_percent)) / F.lit(36.0)) * F.lit(100.0)
              + F.least(d(years_employed) / F.lit(10.0), F.lit(1.0)) * F.lit(50.0)
              + lti_points * F.lit(80.0)
              + F.when(d(income) > F.lit(60000.0), F.lit(20.0)).otherwise(F.lit(0.0)))
    return F.floor(clip(points, 0.0, 850.0) + F.lit(0.5)).cast("int")


def eligibility_band(points: Column) -> Column:
    return first_match([(points >= 700, "Likely Eligible"), (points >= 550, "Potentially Eligible")],
                       "May Need Improvement")


def eligibility_risk(points: Column) -> Column:
    return first_match([(points >= 700, "Low Risk"), (points >= 550, "Moderate Risk")], "High Risk")

"""Attribution of a score to source features, and its wording."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from string import Formatter

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocabulary as v
from ..functions.expr import first_match, fixed, half_even, percent, plain, sentence_list, worded


def source_groups(encoded: Sequence[str]) -> dict[str, list[int]]:
    """Source feature -> positions of its encoded columns (``Education_PhD`` -> Education)."""
    groups: dict[str, list[int]] = {}
    for i, name in enumerate(encoded):
        source = name if name in v.ALL_NUMERIC else next(
            (c for c in v.ALL_CATEGORICAL if name.startswith(c + "_")), name)
        groups.setdefault(source, []).append(i)
    return groups


def contributions(features: Column | str, weights: Sequence[float], background: Sequence[float],
                  groups: Mapping[str, Sequence[int]]) -> Column:
    """Array of struct (feature, contribution): weight x (value - background mean), summed
    per source feature. With a linear model's coefficients this is its exact
    attribution; with tree importances it is an approximation of rank and direction.

    One ``zip_with`` over two literal arrays and one pass per group; no Python on rows.
    """
    x = vector_to_array(F.col(features) if isinstance(features, str) else features)
    w = F.array(*[F.lit(float(a)) for a in weights])
    base = F.array(*[F.lit(float(a * b)) for a, b in zip(weights, background)])
    parts = F.zip_with(F.zip_with(x, w, lambda a, b: a * b), base, lambda a, b: a - b)
    def summed(ix: Sequence[int]) -> Column:
        total = F.element_at(parts, ix[0] + 1)
        for i in ix[1:]:
            total = total + F.element_at(parts, i + 1)
        return total

    return F.array(*[F.struct(F.lit(name).alias("feature"), summed(ix).alias("contribution"))
                     for name, ix in groups.items()])


def top_factors(contribs: Column | str, values: Mapping[str, Column] | None = None, k: int = 5,
                hidden: Sequence[str] = tuple(v.HISTORY_NUMERIC)) -> Column:
    """The k largest presentable contributions of a row with their share of the total.

    Features no applicant can supply are left out and the weights are renormalised over
    the rest. Ties go by name.
    """
    c = F.col(contribs) if isinstance(contribs, str) else contribs
    shown = F.filter(c, lambda f: ~f["feature"].isin(*hidden)) if hidden else c
    total = F.aggregate(shown, F.lit(0.0), lambda a, f: a + F.abs(f["contribution"]))
    ranked = F.array_sort(shown, lambda a, b: first_match([
        (F.abs(a["contribution"]) > F.abs(b["contribution"]), -1),
        (F.abs(a["contribution"]) < F.abs(b["contribution"]), 1),
        (a["feature"] < b["feature"], -1), (a["feature"] > b["feature"], 1)], 0))
    labels = F.create_map(*[F.lit(x) for kv in v.LABELS.items() for x in kv])
    value_map = F.create_map(*[x for n, col in (values or {}).items()
                               for x in (F.lit(n), col.cast("string"))]) if values else None
    return F.transform(F.slice(ranked, 1, k), lambda f: F.struct(
        F.coalesce(F.try_element_at(labels, f["feature"]), f["feature"]).alias("feature"),
        f["feature"].alias("raw_feature"),
        F.when(f["contribution"] > 0, "negative").otherwise("positive").alias("impact"),
        F.coalesce(half_even(F.try_divide(F.abs(f["contribution"]), total), 4), F.lit(0.0)).alias("weight"),
        half_even(f["contribution"], 6).alias("contribution"),
        (F.try_element_at(value_map, f["feature"]) if value_map is not None
         else F.lit(None).cast("string")).alias("value")))


def helping_and_hurting(contribs: Column | str) -> tuple[Column, Column]:
    """Maps of the contributions that lower and that raise the risk."""
    c = F.map_from_entries(F.col(contribs) if isinstance(contribs, str) else contribs)
    return F.map_filter(c, lambda k, x: x < 0), F.map_filter(c, lambda k, x: x > 0)


def global_importance(df: DataFrame, contribs: str, k: int = 15) -> DataFrame:
    """Mean absolute contribution per feature over the table, with its share."""
    means = (df.select(F.inline(contribs)).groupBy("feature")
             .agg(F.avg(F.abs("contribution")).alias("importance")))
    total = means.agg(F.sum("importance")).scalar()
    return means.select("feature", half_even("importance", 6).alias("importance"),
                        F.coalesce(half_even(F.try_divide(F.col("importance"), total), 4),
                                   F.lit(0.0)).alias("relative_importance")
                        ).orderBy(F.desc("importance"), "feature").limit(k)


# ---- wording -----------------------------------------------------------------------

def phrase_table() -> Column:
    """The phrases as one literal map, so that they travel in the plan and need no join: for each the text
    round its slot and the slot's name ("" for none)."""
    def around(sentence: str) -> Column:
        pieces = [(text, slot) for text, slot, _, _ in Formatter().parse(sentence)]
        before, slot = pieces[0]
        after = "".join(text for text, _ in pieces[1:])
        return F.struct(F.lit(before).alias("a"), F.lit(slot or "").alias("f"), F.lit(after).alias("b"))

    return F.create_map(*[x for (f, i), sentence in v.FACTOR_PHRASES.items() for x in (F.lit(f"{f}|{i}"), around(sentence))])


def clauses(items: Column) -> Column:
    """Wording of an array of factor structs (raw_feature, feature, impact, value).

    The phrase and the numeric value are looked up once per factor and carried in a
    struct, because lambda bodies are evaluated as written."""
    phrases = phrase_table()
    found = F.transform(items, lambda f: F.struct(
        f.alias("f"), f["value"].try_cast("double").alias("x"),
        F.try_element_at(phrases, F.concat_ws("|", f["raw_feature"], f["impact"])).alias("p")))

    def word(t: Column) -> Column:
        f, x, phrase = t["f"], t["x"], t["p"]
        missing = first_match([(phrase["f"] == "percent", v.SHARE_MISSING),
                               (f["raw_feature"].isin(*v.MONEY_FIELDS), v.MONEY_MISSING)], v.VALUE_MISSING)
        shown = first_match([
            (phrase["f"] == "", ""), (phrase["f"] == "text", F.coalesce(f["value"], F.lit("None"))),
            (x.isNull(), missing), (phrase["f"] == "percent", percent(x)), (phrase["f"] == "tenths", fixed(x, 1)),
            (phrase["f"] == "hundredths", fixed(x, 2))], fixed(x, 0))
        label = F.lower(f["feature"])
        return F.when(phrase.isNotNull(), F.concat(phrase["a"], shown, phrase["b"])).when(
            f["value"].isNull(), label).otherwise(F.concat(label, F.lit(" of "), f["value"]))

    return F.transform(found, word)


def with_narrative(df: DataFrame, factors: str = "factors", audience: str = "officer", fraud: bool = False,
                   output: str = "sentences") -> DataFrame:
    """Adds the sentences built from risk_score, risk_level, probability, confidence and
    the factors (and fraud_flag, fraud_reasons with ``fraud``).

    The clauses are a projection of their own below the sentences, so each is worded once.
    """
    of = lambda impact: clauses(F.slice(F.filter(F.col(factors), lambda f: f["impact"] == impact), 1, 3))
    staged = df.withColumns({"_adverse": of("negative"), "_favourable": of("positive")})
    score, level, p, conf = (F.col(c) for c in ("risk_score", "risk_level", "probability", "confidence"))
    adverse, favourable = F.col("_adverse"), F.col("_favourable")
    words = first_match([(level == k, w) for k, w in v.LEVEL_WORDS.items()], F.concat(level, F.lit(" risk")))
    advice = first_match([(level == k, t) for k, t in v.ADVICE_BY_LEVEL.items()], v.ADVICE_BY_LEVEL["medium"])
    say = lambda name, **slots: worded(v.NARRATIVE[name], **slots)
    sure = percent(conf)
    parts = [
        say("score", score=plain(score), level=words, probability=plain(p * 100.0, 1)),
        F.when(F.size(adverse) > 0, say("adverse", factors=sentence_list(adverse))),
        F.when(F.size(favourable) > 0, say("favourable", factors=sentence_list(favourable))),
        first_match([(conf >= F.lit(0.85), say("sure", confidence=sure)),
                     (conf >= F.lit(0.70), say("fairly_sure", confidence=sure))], say("unsure", confidence=sure)),
    ]
    if fraud:
        parts.append(F.when(F.col("fraud_flag"), say("fraud", reasons=F.array_join(F.slice("fraud_reasons", 1, 2), " "))))
    parts.append(advice)
    if audience == "applicant":
        parts.append(F.when(F.size(adverse) > 0, say("improve", factor=F.try_element_at(adverse, F.lit(1)))))
    return staged.withColumn(output, F.array_compact(F.array(*parts))).drop("_adverse", "_favourable")


def factor_description(factor: Column) -> Column:
    shown = F.coalesce(F.concat(F.lit(" (value: "), factor["value"], F.lit(")")), F.lit(""))
    verb = F.when(factor["impact"] == "negative", "increases").otherwise("reduces")
    return worded(v.FACTOR_LINE, feature=factor["feature"], shown=shown, verb=verb, weight=percent(factor["weight"]))


def describe_factors(factors: str = "factors") -> Column:
    """Factors with the one-line description added."""
    return F.transform(F.col(factors), lambda f: f.withField("description", factor_description(f)))

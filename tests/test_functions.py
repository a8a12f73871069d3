import numpy as np
import pytest
from pyspark.sql import functions as F

from lendframe.functions import expr as E
from lendframe.functions import ordered as O
from lendframe.functions import scoring as S

CUT = S.Cutoffs(0.05, 0.30, 0.20)


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_clip_keeps_null(spark):
    n = F.lit(None).cast("double")
    assert tuple(one(spark, E.clip(n, 1, 2), E.clip(F.lit(5.0), 1, 2), E.clip(F.lit(0.0), lo=1))) == (None, 2.0, 1.0)


def test_ratio_fills_zero_divisor(spark):
    assert tuple(one(spark, E.ratio(F.lit(1.0), F.lit(0.0)), E.ratio(F.lit(1.0), F.lit(None).cast("double")),
                     E.ratio(F.lit(1.0), F.lit(4.0)))) == (0.0, 0.0, 0.25)


@pytest.mark.parametrize("text,want", [("12.5", 12.5), (" 7 ", 7.0), ("abc", None), ("nan", None), ("12d", None),
                                       ("1e3", 1000.0), ("", None), ("-.5", -0.5)])
def test_number(spark, text, want):
    assert one(spark, E.number(F.lit(text)))[0] == want


@pytest.mark.parametrize("text,want", [("Yes", "Yes"), (" TRUE ", "Yes"), ("y", "Yes"), ("1", "Yes"), ("No", "No"),
                                       ("0", "No"), ("maybe", None)])
def test_yes_no(spark, text, want):
    assert one(spark, E.yes_no(F.lit(text)))[0] == want


def test_half_even_follows_the_double(spark):
    assert tuple(one(spark, E.half_even(F.lit(0.5)), E.half_even(F.lit(1.5)), E.half_even(F.lit(2.5)),
                     E.half_even(F.lit(0.65875), 4))) == (0.0, 2.0, 2.0, float(np.round(0.65875, 4)))


def test_percent_change(spark):
    n = F.lit(None).cast("double")
    assert tuple(one(spark, E.percent_change(F.lit(50000.0), F.lit(100000.0)), E.percent_change(F.lit(0.0), F.lit(1.0)),
                     E.percent_change(n, F.lit(1.0)))) == (100.0, None, None)


def test_text_helpers(spark):
    arr = lambda *x: F.array(*[F.lit(i) for i in x])
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    at = lambda s: F.lit(s).cast("timestamp")
    got = one(spark, E.sentence_list(arr("a", "b", "c")), E.sentence_list(arr("a")), E.sentence_list(arr("a", "b")),
              E.fixed(F.lit(1234567.0)), E.percent(F.lit(0.234)), E.initials(F.lit("Ann Bo")), E.shorten(F.lit("abcdef"), 3),
              E.age_text(at("2024-01-01 23:30:00"), now), E.age_text(at("2024-01-01 20:00:00"), now),
              E.age_text(at("2023-12-30 00:00:00"), now))
    assert tuple(got) == ("a, b and c", "a", "a and b", "1,234,567", "23%", "AB", "abc…", "30m ago", "4h ago", "3d ago")


@pytest.mark.parametrize("p,score", [(0.0, 0.0), (0.05, 25.0), (0.30, 75.0), (1.0, 100.0)])
def test_score_anchors(spark, p, score):
    assert one(spark, S.risk_score(F.lit(p), CUT))[0] == pytest.approx(score)


def test_score_is_monotone_and_bounded(spark):
    rows = spark.range(0, 1001).select((F.col("id") / 1000.0).alias("p")).select("p", S.risk_score("p", CUT).alias("s")).orderBy("p").collect()
    s = [r["s"] for r in rows]
    assert all(a <= b for a, b in zip(s, s[1:])) and s[0] >= 0 and s[-1] <= 100


@pytest.mark.parametrize("s,level", [(0, "low"), (24.9, "low"), (25, "medium"), (50, "medium"), (74.9, "medium"),
                                     (75, "high"), (100, "high")])
def test_levels(spark, s, level):
    assert one(spark, S.risk_level(F.lit(float(s))))[0] == level


def test_confidence(spark):
    near, far, free = one(spark, S.confidence(F.lit(0.30), CUT), S.confidence(F.lit(0.99), CUT), S.confidence(F.lit(0.5)))
    assert near < far and free == pytest.approx(0.55)


@pytest.mark.parametrize("score,fraud,want", [(25.0, False, "approve"), (25.0, True, "reject"), (75.0, False, "reject"),
                                              (50.0, False, "review"), (10.0, None, "approve")])
def test_recommendation(spark, score, fraud, want):
    assert one(spark, S.recommendation(F.lit(score), F.lit(fraud).cast("boolean")))[0] == want


# ---- order statistics against NumPy --------------------------------------------

def skewed(spark, n=30_000):
    """A third of all rows share one value; some are missing or not finite."""
    r = F.pmod(F.xxhash64("id"), F.lit(1_000_003)).cast("double") / 1_000_003.0
    x = (F.when(F.col("id") % 3 == 0, 0.25).when(F.col("id") % 101 == 0, None)
         .when(F.col("id") % 103 == 0, float("inf")).otherwise(r * r))
    return spark.range(n).select("id", x.alias("x"), F.floor(r * 5).cast("double").alias("few"), (r > 0.7).cast("int").alias("y"))


@pytest.mark.parametrize("n", [7, 30_000])
def test_exact_quantiles(spark, n):
    df = skewed(spark, n)
    pdf = df.toPandas()
    probs = [0.0, 0.005, 0.1, 0.25, 0.5, 0.95, 0.995, 1.0]
    got = O.quantile_constants(df, ["x", "few"], probs)
    for c in ("x", "few"):
        values = pdf[c].to_numpy(dtype=float)
        values = values[np.isfinite(values)]
        np.testing.assert_allclose(got[c], np.quantile(values, probs), rtol=0, atol=1e-12)


def test_quantiles_of_an_empty_column(spark):
    df = spark.range(5).select(F.lit(None).cast("double").alias("x"), F.col("id").cast("double").alias("z"))
    assert O.quantile_constants(df, ["x", "z"], [0.5]) == {"x": [None], "z": [2.0]}


@pytest.mark.parametrize("shape", ["tail_up", "tail_down", "ties", "huge", "one"])
def test_exact_quantiles_of_hard_shapes(spark, shape):
    rng = np.random.default_rng(3)
    x = {"tail_up": np.exp(rng.normal(0, 8, 40_000)), "tail_down": -np.exp(rng.normal(0, 8, 40_000)),
         "ties": np.where(rng.random(40_000) < 0.98, 3.0, rng.normal(0, 1e9, 40_000)),
         "huge": rng.choice([-1.7e308, -1.0, 0.0, 5e-324, 1.7e308], 999), "one": np.array([4.5])}[shape]
    probs = [0.0, 0.005, 0.5, 0.9, 0.995, 1.0]
    df = spark.createDataFrame([(float(z),) for z in x], "x double").repartition(5)
    got = O.quantile_constants(df, ["x"], probs)["x"]
    with np.errstate(over="ignore", invalid="ignore"):
        want = np.quantile(x, probs)
    exact = np.sort(x)[np.floor(np.array(probs) * (len(x) - 1)).astype(int)] if shape == "huge" else want
    np.testing.assert_allclose(got, exact if shape == "huge" else want, rtol=1e-13, atol=0)


def test_quantiles_from_merged_stored_sketches(spark, tmp_path):
    df = skewed(spark, 20_000).select("x", "few")
    for part in (0, 1, 2):
        O.sketches(df.filter(F.pmod(F.hash("x"), F.lit(3)) == part), ["x", "few"]).write.mode("append").parquet(str(tmp_path / "kept"))
    stored = O.merged_sketches(spark.read.parquet(str(tmp_path / "kept")))
    values = lambda q: {(r["feature"], r["prob"]): r["value"] for r in q.collect()}
    probs = [0.01, 0.5, 0.99]
    assert values(O.exact_quantiles(df, ["x", "few"], probs, stored)) == values(O.exact_quantiles(df, ["x", "few"], probs))


def test_a_bracket_that_misses_its_rank_is_replaced(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("x"))
    wrong = O.sketches(spark.range(1000).select(F.col("id").cast("double").alias("x")).filter("x < 300 or x = 999"), ["x"])
    got = O.exact_quantiles(df, ["x"], [0.5, 0.9], wrong).orderBy("prob").collect()
    assert [r["value"] for r in got] == [499.5, 899.1]


@pytest.mark.parametrize("cells", [1, 4, 1 << 20])
def test_running_totals_do_not_depend_on_cells(spark, cells):
    df = skewed(spark, 2000).filter("x <= 1").select(F.lit("g").alias("k"), "x", F.lit(1).alias("one"))
    got = O.running_totals(df, ["k"], "x", ["one"], cells=cells).toPandas().sort_values("x", ascending=False)
    assert (got["one"].cumsum().to_numpy() == got["cum_one"].to_numpy()).all()
    assert got["place"].tolist() == list(range(1, len(got) + 1))


def test_hash_order_cuts_pick_the_kth_row(spark):
    df = spark.range(3000).select("id", (F.col("id") % 10 == 0).cast("int").alias("y"), O.hash_position("id", 5).alias("u"))
    cuts = {r["y"]: r for r in O.hash_order_cuts(df, "y", "u", "id", {"a": F.lit(17), "b": F.col("smallest")}).collect()}
    pdf = df.toPandas().sort_values(["u", "id"])
    for y, g in pdf.groupby("y"):
        assert tuple(cuts[y]["a"]) == tuple(g.iloc[16][["u", "id"]])
        assert tuple(cuts[y]["b"]) == tuple(g.iloc[299][["u", "id"]])


def test_running_totals_of_crowded_scores(spark):
    """Scores that crowd at both ends: cells follow the scores, and the totals are those of one ordered pass."""
    from lendframe.functions.ordered import axis_cell, running_totals
    ps = [2.0 ** -k for k in range(1, 400, 3)] + [1 - 2.0 ** -k for k in range(2, 50, 3)] + [0.0, 1.0, 0.5, 0.3, 1e-9, 1e-9, 3e-9]
    df = spark.createDataFrame([(p, 1) for p in ps], "p double, m int")
    cells = sorted((r["p"], r["c"]) for r in df.select("p", axis_cell(F.col("p")).alias("c")).distinct().collect())
    assert [c for _, c in cells] == sorted(c for _, c in cells) and len({c for _, c in cells}) > 0.9 * len(cells)
    got = {r["p"]: (r["m"], r["cum_m"]) for r in running_totals(df, [], "p", ["m"]).collect()}
    assert got == {p: (ps.count(p), sum(q >= p for q in ps)) for p in ps}


def test_a_split_holds_its_cuts_and_wide_jobs_stay_compiled(spark):
    from lendframe.learn.preprocess import stratified_split
    from lendframe.session import compiled
    df = spark.range(400).selectExpr("id", "cast(id % 4 = 0 AS int) AS y")
    out = stratified_split(df, "y", "id")
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()  # the histogram is not counted again by every read
    found = {(r["y"], r["split"]): r["count"] for r in out.groupBy("y", "split").count().collect()}
    assert found == {(1, "test"): 15, (1, "val"): 15, (1, "train"): 70, (0, "test"): 45, (0, "val"): 45, (0, "train"): 210}
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    with compiled(spark):
        assert spark.conf.get(key) == "8000"
    assert spark.conf.get(key) == before

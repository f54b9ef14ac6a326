"""Hand-computed goldens for the estimators (FIXTURES.md §2, §3) and the
properties of SURVEY §5."""

import pytest
from pyspark.sql import functions as F

from panelstat.operators import estimators as est
from panelstat.operators import indicators as ind
from panelstat.operators.quality import valid_households
from panelstat.operators.weights import with_design_weight, with_raw_weight
from panelstat.sources.codebooks import AGE_BANDS
from tests.conftest import rows

OK = "household surveyed: original"
HH = [
    # id, state, sector, size, type, religion, survey, response, mult, nss, nsc, q, exp
    ("H1", "kerala", "urban", 4.0, "self-employed", "hinduism", OK, "co-operative and capable", 1000.0, 2, 2, 4, 10000.0),
    ("H2", "kerala", "urban", 2.0, "regular", "islam", OK, "Co-Operative and Capable x", 800.0, 1, 2, 4, 20000.0),
    ("H3", "kerala", "urban", 3.0, "self-employed", "hinduism", OK, "CO-OPERATIVE AND CAPABLE", 1200.0, 4, 4, 2, 30000.0),
    ("H4", "kerala", "rural", 5.0, "others", "hinduism", OK, "co-operative and capable", 400.0, None, 3, 4, None),
    ("H5", "kerala", "urban", 9.0, "others", "islam", "household surveyed: substitute", "co-operative and capable",
     1000.0, 1, 1, 4, 99.0),
    ("H6", "bihar", "urban", 9.0, "others", "islam", OK, None, 1000.0, 1, 1, 4, 99.0),
    ("H7", None, "urban", 9.0, "others", "islam", OK, "co-operative and capable", 1000.0, 1, 1, 4, 99.0),
]
HH_SCHEMA = ("id string, state string, sector string, household_size double, household_type string, religion string, "
             "survey_code string, response_code string, multiplier double, nss bigint, nsc bigint, quarters bigint, "
             "expenditure double")


@pytest.fixture(scope="module")
def hh(spark):
    df = spark.createDataFrame(HH, HH_SCHEMA)
    return with_design_weight(valid_households(df))


def test_validity_and_weights(hh):
    got = dict(rows(hh, "id", "weight"))
    assert got == {"H1": 2.5, "H2": 1.0, "H3": 6.0, "H4": 0.5, "H7": 2.5}


def test_raw_weight_absent_column(spark):
    df = spark.createDataFrame([(1,)], "a int")
    assert with_raw_weight(df).first()["weight"] == 1.0


def test_totals_means_median(hh):
    keys = ["state", "sector"]
    tot = dict(((r[0], r[1]), r[2]) for r in rows(est.weighted_total(hh, keys, "weight")))
    assert tot == {("kerala", "urban"): 9.5, ("kerala", "rural"): 0.5}
    pop = dict(((r[0], r[1]), r[2]) for r in rows(est.weighted_total(hh, keys, "weight", size="household_size")))
    assert pop == {("kerala", "urban"): 30.0, ("kerala", "rural"): 2.5}
    mean = {(r[0], r[1]): (r[2], r[3]) for r in rows(est.weighted_mean(hh, keys, ["household_size", "expenditure"], "weight"))}
    assert mean[("kerala", "urban")][0] == pytest.approx(3.1578947368)
    assert mean[("kerala", "urban")][1] == pytest.approx(23684.2105263158)
    assert mean[("kerala", "rural")] == (5.0, None)
    med = dict(((r[0], r[1]), r[2]) for r in rows(est.weighted_median(hh, keys, "expenditure", "weight")))
    assert med == {("kerala", "urban"): 30000.0}


def test_distribution_rounding_and_other(spark):
    df = spark.createDataFrame([("g", c, float(w)) for c, w in [("a", 5), ("b", 3), ("c", 2), ("d", 1)]],
                               "g string, v string, w double")
    two = rows(est.weighted_distribution(df, ["g"], "v", "w", top_n=2, digits=2), "category", "share")
    assert two == [("a", 0.45), ("b", 0.27), ("other", 0.27)]
    four = rows(est.weighted_distribution(df, ["g"], "v", "w", top_n=4, digits=2), "category")
    assert ("other",) not in four


def test_household_type_distribution(hh):
    d = rows(est.weighted_distribution(hh, ["state", "sector"], "household_type", "weight", top_n=100, digits=3),
             "sector", "category", "share")
    assert d == [("rural", "others", 1.0), ("urban", "regular", 0.105), ("urban", "self-employed", 0.895)]


def test_median_is_lower_data_value(spark):
    df = spark.createDataFrame([("g", float(v), 1.0) for v in [1, 2, 3, 4]], "g string, v double, w double")
    assert est.weighted_median(df, ["g"], "v", "w").first()["median"] == 2.0
    df2 = spark.createDataFrame([("g", 10.0, 2.5), ("g", 20.0, 1.0), ("g", 30.0, 6.0), ("g", None, 9.0)],
                                "g string, v double, w double")
    assert est.weighted_median(df2, ["g"], "v", "w").first()["median"] == 30.0


def test_describe_matches_pandas(spark):
    df = spark.createDataFrame([("g", float(v)) for v in [1, 2, 4, 10]], "g string, v double")
    r = est.describe(df, ["g"], "v").first()
    assert r["count"] == 4 and r["mean"] == 4.25
    assert r["std"] == pytest.approx(4.031128874149275)
    assert (r["p10"], r["p25"], r["p50"], r["p75"], r["p90"]) == pytest.approx((1.3, 1.75, 3.0, 5.5, 8.2))
    a = est.describe(df, ["g"], "v", approx=True).first()
    assert a["min"] == 1.0 and a["max"] == 10.0


def test_age_bands_null_in_denominator(spark):
    df = spark.createDataFrame([("g", 10.0, 2.0), ("g", 29.0, 1.0), ("g", None, 3.0), ("g", 60.0, 4.0)],
                               "g string, age double, w double")
    got = dict(rows(est.banded_share(df, ["g"], "age", AGE_BANDS, "w"), "band", "share"))
    assert got == pytest.approx({"0-14": 0.2, "15-29": 0.1, "30-59": 0.0, "60+": 0.4})


def test_unweighted_distribution_over_all_rows(spark):
    df = spark.createDataFrame([("g", "x"), ("g", "x"), ("g", "y"), ("g", None)], "g string, v string")
    got = dict(rows(est.distribution(df, ["g"], "v"), "category", "share"))
    assert got == {"x": 0.5, "y": 0.25}


def test_mode_smallest_on_ties(spark):
    df = spark.createDataFrame([("g", v) for v in "baba"], "g string, v string")
    assert est.mode_of(df, ["g"], "v").first()["mode"] == "a"


def test_yes_no(spark):
    df = spark.createDataFrame([("g", v, 1.0) for v in ["received formal", "did not receive any", "Yes", None]],
                               "g string, v string, w double")
    d = df.withColumn("yn", est.yes_no("v"))
    got = dict(rows(est.weighted_distribution(d, ["g"], "yn", "w", digits=2), "category", "share"))
    assert got == {"yes": 0.67, "no": 0.33}


def test_labour_rates(spark):
    cats = ["employed"] * 6 + ["unemployed"] * 2 + ["not_in_labor_force"] * 4
    df = spark.createDataFrame([("g", c, 1.0) for c in cats], "g string, status_category string, weight double")
    r = ind.labour_rates(df, ["g"]).first()
    assert (r["wpr"], r["lfpr"], r["ur"]) == pytest.approx((0.5, 0.666667, 0.25), abs=1e-6)
    empty = spark.createDataFrame([("g", "not_in_labor_force", 1.0)], "g string, status_category string, weight double")
    assert ind.labour_rates(empty, ["g"]).first()["ur"] == 0.0


def test_weight_scaling_invariance(hh):
    scaled = hh.withColumn("weight", F.col("weight") * 7.0)
    a = rows(est.weighted_distribution(hh, ["state", "sector"], "religion", "weight", digits=4))
    b = rows(est.weighted_distribution(scaled, ["state", "sector"], "religion", "weight", digits=4))
    assert a == b
    assert rows(est.weighted_median(hh, ["state"], "expenditure", "weight")) == \
        rows(est.weighted_median(scaled, ["state"], "expenditure", "weight"))


def test_partition_count_invariance(spark):
    from panelstat.plans.catalog import QUERIES
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        one = rows(QUERIES["wmedian"](spark, "/root/testdata/sf0.001"))
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        eight = rows(QUERIES["wmedian"](spark, "/root/testdata/sf0.001"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert one == eight


def test_arg_extreme_and_top_k(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 3.0), ("d", None)], "state string, v double")
    assert ind.arg_extreme(df, "v").first()["argmax"] == "b"
    assert ind.arg_extreme(df, "v", largest=False).first()["argmin"] == "a"
    assert [r["state"] for r in ind.top_k(df, "v", 2).orderBy("rank").collect()] == ["b", "c"]


def test_cube_all_label(spark):
    df = spark.createDataFrame([("s1", "urban", "employed", 1.0), ("s2", "rural", "unemployed", 1.0)],
                               "state string, sector string, status_category string, weight double")
    out = ind.subgroup_totals(df, ["state", "sector"], ind.labour_rate_exprs())
    total = [r for r in out.collect() if r["state"] == "all" and r["sector"] == "all"][0]
    assert total["wpr"] == 0.5 and total["gid"] == 3

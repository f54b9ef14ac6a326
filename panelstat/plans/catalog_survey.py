"""Registered survey-estimation queries (A1-A20, I*, T2, T3) and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelstat.operators import estimators as est
from panelstat.operators import indicators as ind
from panelstat.operators.lookups import status_category
from panelstat.operators.quality import valid_households
from panelstat.operators.weights import with_design_weight, with_raw_weight
from panelstat.plans import sqlgen as S
from panelstat.plans.registry import r6, register, sql_r6
from panelstat.plans.views import (HOUSEHOLD_RAW_SQL, WEIGHT_SQL, household_raw, households, persons,
                                   with_views)
from panelstat.sources.codebooks import AGE_BANDS, STATUS, bounded, status_codebook

HH_KEYS = ["state", "sector"]
STATUS_SQL = S.values_table([(c, cat) for c, _, cat in STATUS], ["code", "category"], "sc")


def persons_with_status(spark, sf_dir):
    return status_category(persons(spark, sf_dir), status_codebook(spark))


PERSON_STATUS_SQL = (f"(SELECT p.*, coalesce(sc.category, 'unknown') AS status_category FROM person_v p "
                     f"LEFT JOIN {STATUS_SQL} ON sc.code = p.status_code)")


def industry_codebook(spark):
    """Two-digit division codes with labels; divisions ending in 4 have none."""
    ids = spark.range(1, 100).where(F.col("id") % 10 != 4)
    code = F.lpad(F.col("id").cast("string"), 2, "0")
    return bounded(ids.select(code.alias("code"), F.concat(F.lit("industry division "), code).alias("label")), 99)


INDUSTRY_SQL = ("(SELECT lpad(CAST(i AS VARCHAR), 2, '0') AS code, 'industry division ' || lpad(CAST(i AS VARCHAR), 2, '0') AS label "
                "FROM range(1, 100) AS t(i) WHERE i % 10 <> 4)")


def occupation_codebook(spark):
    """Three-digit occupation groups; multiples of 7 have no label."""
    ids = spark.range(100, 1000).where(F.col("id") % 7 != 0)
    code = F.col("id").cast("string")
    return bounded(ids.select(code.alias("code"), F.concat(F.lit("occupation group "), code).alias("label")), 900)


OCCUPATION_SQL = ("(SELECT CAST(i AS VARCHAR) AS code, 'occupation group ' || CAST(i AS VARCHAR) AS label "
                  "FROM range(100, 1000) AS t(i) WHERE i % 7 <> 0)")


# ------------------------------------------------------------------ flagship (A1+A3+A4+A6)

@register("household_summary", with_views(sql_r6(f"""
SELECT state, sector, sum(weight) AS total_households,
  {S.wmean('household_size')} AS avg_household_size,
  {S.wmean('expenditure')} AS avg_monthly_expenditure,
  sum(household_size * weight) AS population_estimate
FROM household_v WHERE state IS NOT NULL AND sector IS NOT NULL GROUP BY state, sector""",
    ["total_households", "avg_household_size", "avg_monthly_expenditure", "population_estimate"])))
def q_household_summary(spark, sf_dir):
    hh = households(spark, sf_dir)
    out = hh.groupBy(*HH_KEYS).agg(
        F.sum("weight").alias("total_households"),
        est.weighted_mean_expr("household_size", "weight").alias("avg_household_size"),
        est.weighted_mean_expr("expenditure", "weight").alias("avg_monthly_expenditure"),
        F.sum(F.col("household_size") * F.col("weight")).alias("population_estimate"))
    return r6(est._drop_null_keys(out, HH_KEYS))


# --------------------------------------------------------------------------- A1, A2, F1

@register("design_weight", with_views(sql_r6(f"""
SELECT hh_id, {WEIGHT_SQL} AS weight FROM ({HOUSEHOLD_RAW_SQL}) h""",
    ["weight"])))
def q_design_weight(spark, sf_dir):
    return r6(with_design_weight(household_raw(spark, sf_dir)).select("hh_id", "weight"))


@register("raw_weight", with_views(sql_r6("""
SELECT state, sum(multiplier) AS raw_total, CAST(count(*) AS DOUBLE) AS fallback_total, count(*) AS n
FROM household_v GROUP BY state""", ["raw_total"])))
def q_raw_weight(spark, sf_dir):
    """The multiplier, and 1.0 where the column is absent."""
    hh = with_raw_weight(households(spark, sf_dir), "multiplier", out="raw_w")
    hh = with_raw_weight(hh, "no_such_column", out="fallback_w")
    return r6(hh.groupBy("state").agg(F.sum("raw_w").alias("raw_total"), F.sum("fallback_w").alias("fallback_total"),
                                      F.count(F.lit(1)).alias("n")))


@register("valid_households", with_views("""
SELECT sector, count(*) AS n FROM household_v GROUP BY sector"""))
def q_valid_households(spark, sf_dir):
    hh = valid_households(household_raw(spark, sf_dir))
    return hh.groupBy("sector").agg(F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------------------- A3 / T1

@register("wdist_type", with_views(sql_r6(S.wdist("household_v", HH_KEYS, "household_type", top_n=100, digits=3),
                                          ["share"])))
def q_wdist_type(spark, sf_dir):
    return r6(est.weighted_distribution(households(spark, sf_dir), HH_KEYS, "household_type", "weight",
                                        top_n=100, digits=3))


@register("wdist_religion", with_views(sql_r6(S.wdist("household_v", HH_KEYS, "religion", top_n=100, digits=2),
                                              ["share"])))
def q_wdist_religion(spark, sf_dir):
    return r6(est.weighted_distribution(households(spark, sf_dir), HH_KEYS, "religion", "weight",
                                        top_n=100, digits=2))


@register("wdist_top5_other", with_views(sql_r6(S.wdist("person_v", ["state"], "general_education", top_n=5),
                                                ["share"])))
def q_wdist_top5_other(spark, sf_dir):
    return r6(est.weighted_distribution(persons(spark, sf_dir), ["state"], "general_education", "weight", top_n=5))


# --------------------------------------------------------------------------- A4, A5, A6, A7

@register("wmean", with_views(sql_r6(f"""
SELECT state, sector, {S.wmean('household_size')} AS household_size, {S.wmean('expenditure')} AS expenditure
FROM household_v WHERE state IS NOT NULL AND sector IS NOT NULL GROUP BY state, sector""",
    ["household_size", "expenditure"])))
def q_wmean(spark, sf_dir):
    return r6(est.weighted_mean(households(spark, sf_dir), HH_KEYS, ["household_size", "expenditure"], "weight"))


@register("wmedian", with_views(sql_r6(S.wmedian("household_v", HH_KEYS, "expenditure"), ["median"])))
def q_wmedian(spark, sf_dir):
    return r6(est.weighted_median(households(spark, sf_dir), HH_KEYS, "expenditure", "weight"))


@register("wtotal", with_views(sql_r6("""
SELECT state, sector, sum(weight) AS total FROM household_v
WHERE state IS NOT NULL AND sector IS NOT NULL GROUP BY state, sector""", ["total"])))
def q_wtotal(spark, sf_dir):
    return r6(est.weighted_total(households(spark, sf_dir), HH_KEYS, "weight"))


@register("population", with_views(sql_r6("""
SELECT state, sector, sum(household_size * weight) AS population FROM household_v
WHERE state IS NOT NULL AND sector IS NOT NULL GROUP BY state, sector""", ["population"])))
def q_population(spark, sf_dir):
    return r6(est.weighted_total(households(spark, sf_dir), HH_KEYS, "weight", size="household_size",
                                 name="population"))


@register("wmedian_ties", with_views("""
SELECT state, sector, CAST(min(age) AS DOUBLE) AS median FROM (
  SELECT state, sector, age, row_number() OVER (PARTITION BY state, sector ORDER BY age) AS r,
    count(*) OVER (PARTITION BY state, sector) AS n
  FROM person_v WHERE state IS NOT NULL AND sector IS NOT NULL AND age IS NOT NULL) t
WHERE 2 * r >= n GROUP BY state, sector"""))
def q_wmedian_ties(spark, sf_dir):
    """All weights are a third: half of the total is reached exactly, in any order of adding up."""
    p = persons(spark, sf_dir).withColumn("third", F.lit(1.0) / 3)
    return est.weighted_median(p, HH_KEYS, "age", "third")


# --------------------------------------------------------------------------- A8

@register("describe", with_views(sql_r6(f"""
SELECT state, sector, count(expenditure) AS count, avg(expenditure) AS mean, stddev_samp(expenditure) AS std,
  min(expenditure) AS min, max(expenditure) AS max,
  {S.quantile_cols('expenditure', est.DESCRIBE_PROBS, est.DESCRIBE_NAMES)}
FROM household_v WHERE state IS NOT NULL AND sector IS NOT NULL GROUP BY state, sector""",
    ["mean", "std", "min", "max", *est.DESCRIBE_NAMES])))
def q_describe(spark, sf_dir):
    return r6(est.describe(households(spark, sf_dir), HH_KEYS, "expenditure"))


# --------------------------------------------------------------------------- A9 - A16

@register("age_bands", with_views(sql_r6(f"""
UNPIVOT (SELECT state, sector, {S.bands('age', AGE_BANDS, prefix='b_')} FROM person_v
         WHERE state IS NOT NULL AND sector IS NOT NULL GROUP BY state, sector)
ON {", ".join(f'"b_{b[0]}" AS \'{b[0]}\'' for b in AGE_BANDS)} INTO NAME band VALUE share""", ["share"])))
def q_age_bands(spark, sf_dir):
    return r6(est.banded_share(persons(spark, sf_dir), HH_KEYS, "age", AGE_BANDS, "weight"))


@register("dist_unweighted", with_views(sql_r6(
    S.wdist("person_v", ["state"], "vocational_training", weight=None, top_n=None, denominator="all"), ["share"])))
def q_dist_unweighted(spark, sf_dir):
    return r6(est.distribution(persons(spark, sf_dir), ["state"], "vocational_training"))


@register("mean_median", with_views(sql_r6("""
SELECT state, avg(age) AS mean, quantile_cont(age, 0.5) AS median FROM person_v
WHERE state IS NOT NULL GROUP BY state""", ["mean", "median"])))
def q_mean_median(spark, sf_dir):
    return r6(est.unweighted_mean_median(persons(spark, sf_dir), ["state"], "age"))


@register("mode", with_views("""
SELECT state, general_education AS mode FROM (
  SELECT state, general_education, row_number() OVER (PARTITION BY state ORDER BY count(*) DESC, general_education) AS rn
  FROM person_v WHERE state IS NOT NULL AND general_education IS NOT NULL GROUP BY state, general_education) t
WHERE rn = 1"""))
def q_mode(spark, sf_dir):
    return est.mode_of(persons(spark, sf_dir), ["state"], "general_education")


@register("group_count", with_views("""
SELECT state, sector, count(*) AS n FROM person_v WHERE state IS NOT NULL AND sector IS NOT NULL
GROUP BY state, sector"""))
def q_group_count(spark, sf_dir):
    return est.group_count(persons(spark, sf_dir), HH_KEYS)


@register("indicator_share", with_views(sql_r6("""
SELECT state, sum(CASE WHEN coalesce(status_code = '31', FALSE) THEN weight ELSE 0.0 END) / nullif(sum(weight), 0) AS share
FROM person_v WHERE state IS NOT NULL GROUP BY state""", ["share"])))
def q_indicator_share(spark, sf_dir):
    return r6(est.indicator_share(persons(spark, sf_dir), ["state"], F.col("status_code") == "31", "weight"))


@register("yes_no", with_views(sql_r6(S.wdist(
    "(SELECT *, CASE WHEN vocational_training IS NULL THEN NULL "
    "WHEN regexp_matches(lower(vocational_training), 'received|yes') THEN 'yes' ELSE 'no' END AS voc FROM person_v)",
    HH_KEYS, "voc", top_n=5, digits=2), ["share"])))
def q_yes_no(spark, sf_dir):
    p = persons(spark, sf_dir).withColumn("voc", est.yes_no("vocational_training"))
    return r6(est.weighted_distribution(p, HH_KEYS, "voc", "weight", top_n=5, digits=2))


# --------------------------------------------------------------------------- A17

@register("coded_dist_industry", with_views(sql_r6(S.wdist(
    f"(SELECT p.*, coalesce(cb.label, substr(p.industry_code, 1, 2)) AS _label FROM person_v p "
    f"LEFT JOIN {INDUSTRY_SQL} cb ON cb.code = substr(p.industry_code, 1, 2))",
    ["state"], "_label", top_n=5), ["share"])))
def q_coded_dist_industry(spark, sf_dir):
    return r6(ind.coded_distribution(persons(spark, sf_dir), ["state"], "industry_code",
                                     industry_codebook(spark), 2, "weight", top_n=5))


@register("coded_dist_occupation", with_views(sql_r6(S.wdist(
    f"(SELECT p.*, coalesce(cb.label, substr(p.occupation_code, 1, 3)) AS _label FROM person_v p "
    f"LEFT JOIN {OCCUPATION_SQL} cb ON cb.code = substr(p.occupation_code, 1, 3))",
    ["state"], "_label", top_n=5), ["share"])))
def q_coded_dist_occupation(spark, sf_dir):
    return r6(ind.coded_distribution(persons(spark, sf_dir), ["state"], "occupation_code",
                                     occupation_codebook(spark), 3, "weight", top_n=5))


# --------------------------------------------------------------------------- A18, A20

def _rates_sql(keys_sel: str, group: str) -> str:
    return f"""
SELECT {keys_sel},
  coalesce(sum(CASE WHEN status_category = 'employed' THEN weight ELSE 0.0 END) / nullif(sum(weight), 0), 0.0) AS wpr,
  coalesce(sum(CASE WHEN status_category IN ('employed', 'unemployed') THEN weight ELSE 0.0 END) / nullif(sum(weight), 0), 0.0) AS lfpr,
  coalesce(sum(CASE WHEN status_category = 'unemployed' THEN weight ELSE 0.0 END)
           / nullif(sum(CASE WHEN status_category IN ('employed', 'unemployed') THEN weight ELSE 0.0 END), 0), 0.0) AS ur
FROM {PERSON_STATUS_SQL} ps WHERE state IS NOT NULL AND sector IS NOT NULL AND gender IS NOT NULL {group}"""


@register("labour_rates", with_views(sql_r6(_rates_sql("state, sector", "GROUP BY state, sector"),
                                            ["wpr", "lfpr", "ur"])))
def q_labour_rates(spark, sf_dir):
    return r6(ind.labour_rates(persons_with_status(spark, sf_dir), HH_KEYS))


@register("rates_cube", with_views(sql_r6(
    _rates_sql("coalesce(state, 'all') AS state, coalesce(sector, 'all') AS sector, coalesce(gender, 'all') AS gender, "
               "CAST(grouping(state, sector, gender) AS BIGINT) AS gid", "GROUP BY CUBE (state, sector, gender)"),
    ["wpr", "lfpr", "ur"])))
def q_rates_cube(spark, sf_dir):
    p = persons_with_status(spark, sf_dir)
    sums, finish = ind.labour_rate_sums()
    return r6(ind.cube_of_sums(p, ["state", "sector", "gender"], sums, finish))


# --------------------------------------------------------------------------- T2, T3, I*

@register("argmax_state", with_views(sql_r6(f"""
SELECT sector, arg_min(state, struct_pack(o := -wpr, k := state)) AS argmax, max(wpr) AS wpr
FROM ({_rates_sql('state, sector', 'GROUP BY state, sector')}) r GROUP BY sector""", ["wpr"])))
def q_argmax_state(spark, sf_dir):
    rates = ind.labour_rates(persons_with_status(spark, sf_dir), HH_KEYS)
    return r6(ind.arg_extreme(rates, "wpr", "state", ["sector"], largest=True))


@register("argmin_state", with_views(sql_r6(f"""
SELECT sector, arg_min(state, struct_pack(o := ur, k := state)) AS argmin, min(ur) AS ur
FROM ({_rates_sql('state, sector', 'GROUP BY state, sector')}) r GROUP BY sector""", ["ur"])))
def q_argmin_state(spark, sf_dir):
    rates = ind.labour_rates(persons_with_status(spark, sf_dir), HH_KEYS)
    return r6(ind.arg_extreme(rates, "ur", "state", ["sector"], largest=False))


@register("topk_states", with_views(sql_r6("""
SELECT state, total_expenditure, CAST(row_number() OVER (ORDER BY total_expenditure DESC, state) AS INTEGER) AS rank
FROM (SELECT state, sum(expenditure * weight) AS total_expenditure FROM household_v
      WHERE state IS NOT NULL GROUP BY state) t
QUALIFY rank <= 5""", ["total_expenditure"])))
def q_topk_states(spark, sf_dir):
    tot = est.weighted_total(households(spark, sf_dir).where(F.col("expenditure").isNotNull()), ["state"],
                             "weight", size="expenditure", name="total_expenditure")
    return r6(ind.top_k(tot, "total_expenditure", 5, "state"))


@register("wage_by_group", with_views(sql_r6(f"""
SELECT coalesce(state, 'all') AS state, coalesce(sector, 'all') AS sector, coalesce(gender, 'all') AS gender,
  CAST(grouping(state, sector, gender) AS BIGINT) AS gid,
  {S.wmean('regular_earning')} AS regular_wage, {S.wmean('self_employed_earning')} AS self_employed_earning,
  {S.wmean('casual_wage')} AS casual_wage
FROM person_v WHERE state IS NOT NULL AND sector IS NOT NULL AND gender IS NOT NULL
GROUP BY CUBE (state, sector, gender)""", ["regular_wage", "self_employed_earning", "casual_wage"])))
def q_wage_by_group(spark, sf_dir):
    sums, finish = ind.mean_sums({"regular_wage": "regular_earning", "self_employed_earning": "self_employed_earning",
                                  "casual_wage": "casual_wage"})
    return r6(ind.cube_of_sums(persons(spark, sf_dir), ["state", "sector", "gender"], sums, finish))


@register("pay_gap", with_views(sql_r6(f"""
SELECT state, max(CASE WHEN gender = 'male' THEN m END) AS regular_earning_male,
  max(CASE WHEN gender = 'female' THEN m END) AS regular_earning_female,
  max(CASE WHEN gender = 'male' THEN m END) - max(CASE WHEN gender = 'female' THEN m END) AS gap
FROM (SELECT state, gender, {S.wmean('regular_earning')} AS m FROM person_v
      WHERE state IS NOT NULL AND gender IS NOT NULL GROUP BY state, gender) t GROUP BY state""",
    ["regular_earning_male", "regular_earning_female", "gap"])))
def q_pay_gap(spark, sf_dir):
    means = est.weighted_mean(persons(spark, sf_dir), ["state", "gender"], "regular_earning", "weight")
    return r6(ind.pivot_gap(means, ["state"], "gender", "regular_earning", "male", "female"))


@register("pay_gap_argmax", with_views(sql_r6(f"""
SELECT arg_min(state, struct_pack(o := -gap, k := state)) AS argmax, max(gap) AS gap FROM (
SELECT state, max(CASE WHEN gender = 'male' THEN m END) - max(CASE WHEN gender = 'female' THEN m END) AS gap
FROM (SELECT state, gender, {S.wmean('regular_earning')} AS m FROM person_v
      WHERE state IS NOT NULL AND gender IS NOT NULL GROUP BY state, gender) t GROUP BY state) g
WHERE gap IS NOT NULL""", ["gap"])))
def q_pay_gap_argmax(spark, sf_dir):
    means = est.weighted_mean(persons(spark, sf_dir), ["state", "gender"], "regular_earning", "weight")
    gap = ind.pivot_gap(means, ["state"], "gender", "regular_earning", "male", "female")
    return r6(ind.arg_extreme(gap, "gap", "state", [], largest=True))


def _status_share_sql() -> str:
    return f"""
SELECT state, sector,
  sum(CASE WHEN status_code IN ('11', '12', '21') THEN weight ELSE 0.0 END) / nullif(sum(weight), 0) AS self_employed,
  sum(CASE WHEN status_code = '31' THEN weight ELSE 0.0 END) / nullif(sum(weight), 0) AS regular,
  sum(CASE WHEN status_code IN ('41', '51') THEN weight ELSE 0.0 END) / nullif(sum(weight), 0) AS casual
FROM {PERSON_STATUS_SQL} ps WHERE status_category = 'employed' AND state IS NOT NULL AND sector IS NOT NULL
GROUP BY state, sector"""


@register("status_share", with_views(sql_r6(_status_share_sql(), ["self_employed", "regular", "casual"])))
def q_status_share(spark, sf_dir):
    workers = persons_with_status(spark, sf_dir).where(F.col("status_category") == "employed")
    return r6(ind.status_shares(workers, HH_KEYS))


@register("sex_ratio", with_views(sql_r6("""
SELECT state, 1000.0 * (sum(CASE WHEN gender = 'female' THEN weight ELSE 0.0 END)
  / nullif(sum(CASE WHEN gender = 'male' THEN weight ELSE 0.0 END), 0)) AS ratio
FROM person_v WHERE state IS NOT NULL AND sector = 'rural' GROUP BY state""", ["ratio"])))
def q_sex_ratio(spark, sf_dir):
    p = persons(spark, sf_dir).where(F.col("sector") == "rural")
    return r6(ind.ratio_per(p, ["state"], F.col("gender") == "female", F.col("gender") == "male"))

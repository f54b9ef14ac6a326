"""Registered indicator queries for the question surface (I10, I17-I20) and
the reference-compatible coded distribution (A17 compat)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelstat.operators import estimators as est
from panelstat.operators import indicators as ind
from panelstat.plans import sqlgen as S
from panelstat.plans.catalog_survey import (INDUSTRY_SQL, PERSON_STATUS_SQL, industry_codebook,
                                            persons_with_status)
from panelstat.plans.registry import r6, register, sql_r6
from panelstat.plans.views import households, persons, with_views

NOT_LITERATE = "not literate"
GRADUATE = "graduate and above"
AGRI_DIVISIONS = ("01", "02", "03")


def _share_sql(cond: str, weight: str = "weight") -> str:
    return f"sum(CASE WHEN coalesce({cond}, FALSE) THEN {weight} ELSE 0.0 END) / nullif(sum({weight}), 0)"


@register("literacy_gap", with_views(sql_r6(f"""
SELECT state, max(CASE WHEN gender = 'male' THEN lit END) AS literacy_male,
  max(CASE WHEN gender = 'female' THEN lit END) AS literacy_female,
  max(CASE WHEN gender = 'male' THEN lit END) - max(CASE WHEN gender = 'female' THEN lit END) AS gap
FROM (SELECT state, gender, 1.0 - {_share_sql(f"general_education = '{NOT_LITERATE}'")} AS lit
      FROM person_v WHERE state IS NOT NULL AND gender IS NOT NULL GROUP BY state, gender) t GROUP BY state""",
    ["literacy_male", "literacy_female", "gap"])))
def q_literacy_gap(spark, sf_dir):
    """Literacy rate (1 - share not literate) by sex and the male-female gap."""
    nl = est.indicator_share(persons(spark, sf_dir), ["state", "gender"],
                             F.col("general_education") == NOT_LITERATE, "weight", name="_nl")
    lit = nl.select("state", "gender", (F.lit(1.0) - F.col("_nl")).alias("literacy"))
    return r6(ind.pivot_gap(lit, ["state"], "gender", "literacy", "male", "female"))


@register("education_share", with_views(sql_r6(f"""
SELECT state, {_share_sql("general_education = 'secondary'")} AS secondary,
  {_share_sql(f"general_education = '{GRADUATE}'")} AS graduate
FROM person_v WHERE state IS NOT NULL GROUP BY state""", ["secondary", "graduate"])))
def q_education_share(spark, sf_dir):
    p = est._drop_null_keys(persons(spark, sf_dir), ["state"])
    w = F.col("weight")

    def share(v, name):
        return F.try_divide(F.sum(F.when(F.coalesce(F.col("general_education") == v, F.lit(False)), w)
                                  .otherwise(0.0)), F.sum(w)).alias(name)
    return r6(p.groupBy("state").agg(share("secondary", "secondary"), share(GRADUATE, "graduate")))


@register("graduate_argmax", with_views(sql_r6(f"""
SELECT arg_min(state, struct_pack(o := -graduate, k := state)) AS argmax, max(graduate) AS graduate FROM (
  SELECT state, {_share_sql(f"general_education = '{GRADUATE}'")} AS graduate FROM person_v
  WHERE state IS NOT NULL GROUP BY state) t WHERE graduate IS NOT NULL""", ["graduate"])))
def q_graduate_argmax(spark, sf_dir):
    """State with the highest share of graduates and above."""
    s = est.indicator_share(persons(spark, sf_dir), ["state"], F.col("general_education") == GRADUATE, "weight",
                            name="graduate")
    return r6(ind.arg_extreme(s, "graduate", "state"))


@register("vocational_top3", with_views(sql_r6(f"""
SELECT state, voc, CAST(row_number() OVER (ORDER BY voc DESC, state) AS INTEGER) AS rank FROM (
  SELECT state, {_share_sql("regexp_matches(lower(vocational_training), 'received|yes')")} AS voc
  FROM person_v WHERE state IS NOT NULL GROUP BY state) t
WHERE voc IS NOT NULL QUALIFY rank <= 3""", ["voc"])))
def q_vocational_top3(spark, sf_dir):
    """Top 3 states by share with vocational/technical training."""
    s = est.indicator_share(persons(spark, sf_dir), ["state"], est.yes_no("vocational_training") == "yes",
                            "weight", name="voc")
    return r6(ind.top_k(s, "voc", 3, "state"))


@register("youth_unemployment_argmax", with_views(sql_r6(f"""
SELECT arg_min(state, struct_pack(o := -ur, k := state)) AS argmax, max(ur) AS ur FROM (
  SELECT state, coalesce(sum(CASE WHEN status_category = 'unemployed' THEN weight ELSE 0.0 END)
    / nullif(sum(CASE WHEN status_category IN ('employed', 'unemployed') THEN weight ELSE 0.0 END), 0), 0.0) AS ur
  FROM {PERSON_STATUS_SQL} ps WHERE state IS NOT NULL AND age >= 15 AND age < 30 GROUP BY state) t""", ["ur"])))
def q_youth_unemployment_argmax(spark, sf_dir):
    """State with the highest unemployment rate among ages 15-29."""
    youth = persons_with_status(spark, sf_dir).where((F.col("age") >= 15) & (F.col("age") < 30))
    return r6(ind.arg_extreme(ind.labour_rates(youth, ["state"]), "ur", "state"))


@register("agri_top5", with_views(sql_r6(f"""
SELECT state, agri, CAST(row_number() OVER (ORDER BY agri DESC, state) AS INTEGER) AS rank FROM (
  SELECT state, {_share_sql("substr(industry_code, 1, 2) IN ('01', '02', '03')")} AS agri
  FROM {PERSON_STATUS_SQL} ps WHERE state IS NOT NULL AND status_category = 'employed' GROUP BY state) t
WHERE agri IS NOT NULL QUALIFY rank <= 5""", ["agri"])))
def q_agri_top5(spark, sf_dir):
    """Top 5 states by share of the workforce in agriculture divisions."""
    workers = persons_with_status(spark, sf_dir).where(F.col("status_category") == "employed")
    s = est.indicator_share(workers, ["state"], F.substring("industry_code", 1, 2).isin(*AGRI_DIVISIONS), "weight",
                            name="agri")
    return r6(ind.top_k(s, "agri", 5, "state"))


@register("industry_top3", with_views(sql_r6(S.wdist(
    f"(SELECT p.*, coalesce(cb.label, substr(p.industry_code, 1, 2)) AS _label FROM {PERSON_STATUS_SQL} p "
    f"LEFT JOIN {INDUSTRY_SQL} cb ON cb.code = substr(p.industry_code, 1, 2) WHERE p.status_category = 'employed')",
    ["state"], "_label", top_n=3), ["share"])))
def q_industry_top3(spark, sf_dir):
    """Top three industries employing the most people in each state."""
    workers = persons_with_status(spark, sf_dir).where(F.col("status_category") == "employed")
    return r6(ind.coded_distribution(workers, ["state"], "industry_code", industry_codebook(spark), 2, "weight",
                                     top_n=3))


@register("household_size_expenditure", with_views(sql_r6(f"""
SELECT state, {S.wmean('household_size')} AS avg_household_size, sum(expenditure * weight) AS total_expenditure
FROM household_v WHERE state IS NOT NULL GROUP BY state""", ["avg_household_size", "total_expenditure"])))
def q_household_size_expenditure(spark, sf_dir):
    """Mean household size and total estimated monthly expenditure per state."""
    hh = est._drop_null_keys(households(spark, sf_dir), ["state"])
    return r6(hh.groupBy("state").agg(est.weighted_mean_expr("household_size", "weight").alias("avg_household_size"),
                                      F.sum(F.col("expenditure") * F.col("weight")).alias("total_expenditure")))


_NUMPFX_SQL = ("coalesce(substr(CAST(CAST(trunc(TRY_CAST(category AS DOUBLE)) AS BIGINT) AS VARCHAR), 1, 2), category)")


@register("coded_dist_compat", with_views(sql_r6(f"""
SELECT state, coalesce(cb.label, pfx) AS category, max(rank) AS rank, arg_max(share, rank) AS share
FROM (SELECT *, CASE WHEN rank <= 5 THEN {_NUMPFX_SQL} ELSE category END AS pfx
      FROM ({S.wdist('person_v', ['state'], 'industry_code', top_n=5)}) d) t
LEFT JOIN {INDUSTRY_SQL} cb ON cb.code = t.pfx
GROUP BY state, coalesce(cb.label, pfx)""", ["share"])))
def q_coded_dist_compat(spark, sf_dir):
    """A17 in the reference's order of work: distribution of raw codes, then
    numeric prefix -> label (leading zeros lost), last label wins."""
    return r6(ind.coded_distribution(persons(spark, sf_dir), ["state"], "industry_code", industry_codebook(spark), 2,
                                     "weight", top_n=5, compat=True))

"""Registered queries on workers by status and industry."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelstat.operators import estimators as est
from panelstat.operators import indicators as ind
from panelstat.operators import lookups as lk
from panelstat.plans import sqlgen as S
from panelstat.plans.catalog_survey import INDUSTRY_SQL, PERSON_STATUS_SQL, industry_codebook, persons_with_status
from panelstat.plans.registry import r6, register, sql_r6
from panelstat.plans.views import persons, with_views

SHARES = ["self_employed", "regular", "casual"]


def _workers(spark, sf_dir):
    """Employed persons with their industry; divisions without a label keep the code."""
    workers = persons_with_status(spark, sf_dir).where(F.col("status_category") == "employed")
    workers = lk.decode_prefix(workers, industry_codebook(spark), "industry_code", "industry", 2)
    return workers.withColumn("industry", F.coalesce("industry", F.substring("industry_code", 1, 2)))


WORKER_SQL = (f"(SELECT ps.*, coalesce(ic.label, substr(ps.industry_code, 1, 2)) AS industry FROM {PERSON_STATUS_SQL} ps "
              f"LEFT JOIN {INDUSTRY_SQL} ic ON ic.code = substr(ps.industry_code, 1, 2) "
              "WHERE ps.status_category = 'employed')")


def _shares_sql(keys: str, where: str = "TRUE") -> str:
    not_null = " AND ".join(f"{k.strip()} IS NOT NULL" for k in keys.split(","))
    return f"""SELECT {keys},
  sum(CASE WHEN status_code IN ('11', '12', '21') THEN weight ELSE 0.0 END) / nullif(sum(weight), 0) AS self_employed,
  sum(CASE WHEN status_code = '31' THEN weight ELSE 0.0 END) / nullif(sum(weight), 0) AS regular,
  sum(CASE WHEN status_code IN ('41', '51') THEN weight ELSE 0.0 END) / nullif(sum(weight), 0) AS casual
FROM {WORKER_SQL} w WHERE {not_null} AND {where} GROUP BY {keys}"""


@register("status_by_industry", with_views(sql_r6(_shares_sql("sector, industry"), SHARES)))
def q_status_by_industry(spark, sf_dir):
    """Shares of the activity statuses among the workers of each industry."""
    return r6(ind.status_shares(_workers(spark, sf_dir), ["sector", "industry"]))


@register("status_industry_argmax", with_views(sql_r6(f"""
SELECT sector, arg_min(industry, struct_pack(o := -round(regular, 9), k := industry)) AS argmax, max(round(regular, 9)) AS regular
FROM ({_shares_sql("sector, industry")}) t GROUP BY sector""", ["regular"])))
def q_status_industry_argmax(spark, sf_dir):
    """I8: the industry with the largest share of regular workers."""
    shares = ind.status_shares(_workers(spark, sf_dir), ["sector", "industry"]).withColumn("regular", F.round("regular", 9))
    return r6(ind.arg_extreme(shares, "regular", "industry", ["sector"]))


@register("status_industry_gap", with_views(sql_r6(f"""
SELECT industry, max(CASE WHEN gender = 'male' THEN regular END) AS regular_male,
  max(CASE WHEN gender = 'female' THEN regular END) AS regular_female,
  max(CASE WHEN gender = 'male' THEN regular END) - max(CASE WHEN gender = 'female' THEN regular END) AS gap
FROM ({_shares_sql("industry, gender")}) t GROUP BY industry""", ["regular_male", "regular_female", "gap"])))
def q_status_industry_gap(spark, sf_dir):
    """I8: two groups compared within each industry."""
    shares = ind.status_shares(_workers(spark, sf_dir), ["industry", "gender"])
    return r6(ind.pivot_gap(shares, ["industry"], "gender", "regular", "male", "female"))


def _extreme_sql(share: str, largest: bool, keys: str, by: str, where: str = "TRUE") -> str:
    sign, pick = ("-", "max") if largest else ("", "min")
    name = "argmax" if largest else "argmin"
    group = f" GROUP BY {by}" if by else ""
    return f"""SELECT {by + ', ' if by else ''}arg_min(state, struct_pack(o := {sign}round({share}, 9), k := state)) AS {name},
  {pick}(round({share}, 9)) AS {share} FROM ({_shares_sql(keys, where)}) t{group}"""


@register("status_argmax_state", with_views(sql_r6(_extreme_sql("casual", True, "state, sector", "sector"), ["casual"])))
def q_status_argmax_state(spark, sf_dir):
    """Per sector the state with the largest share of casual workers."""
    shares = ind.status_shares(_workers(spark, sf_dir), ["state", "sector"]).withColumn("casual", F.round("casual", 9))
    return r6(ind.arg_extreme(shares, "casual", "state", ["sector"]))


@register("status_argmin_state", with_views(sql_r6(_extreme_sql("regular", False, "state, sector", "sector"), ["regular"])))
def q_status_argmin_state(spark, sf_dir):
    """Per sector the state with the smallest share of regular workers."""
    shares = ind.status_shares(_workers(spark, sf_dir), ["state", "sector"]).withColumn("regular", F.round("regular", 9))
    return r6(ind.arg_extreme(shares, "regular", "state", ["sector"], largest=False))


@register("self_employed_female_argmax", with_views(sql_r6(
    _extreme_sql("self_employed", True, "state", "", "gender = 'female'"), ["self_employed"])))
def q_self_employed_female_argmax(spark, sf_dir):
    """The state with the largest share of self-employed among female workers."""
    women = _workers(spark, sf_dir).where(F.col("gender") == "female")
    shares = ind.status_shares(women, ["state"]).withColumn("self_employed", F.round("self_employed", 9))
    return r6(ind.arg_extreme(shares, "self_employed", "state"))


@register("industry_share_workers", with_views(sql_r6(
    S.wdist(WORKER_SQL + " w", ["state"], "industry", top_n=None), ["share"])))
def q_industry_share_workers(spark, sf_dir):
    """Every industry's share of a state's workers."""
    return r6(est.weighted_distribution(_workers(spark, sf_dir), ["state"], "industry", "weight", top_n=None))


@register("sex_ratio_argmax", with_views(sql_r6("""
SELECT arg_min(state, struct_pack(o := -round(ratio, 6), k := state)) AS argmax, max(round(ratio, 6)) AS ratio FROM (
SELECT state, 1000.0 * (sum(CASE WHEN gender = 'female' THEN weight ELSE 0.0 END)
  / nullif(sum(CASE WHEN gender = 'male' THEN weight ELSE 0.0 END), 0)) AS ratio
FROM person_v WHERE state IS NOT NULL AND sector = 'rural' GROUP BY state) t""", ["ratio"])))
def q_sex_ratio_argmax(spark, sf_dir):
    """I16 as asked: the state with the highest ratio."""
    p = persons(spark, sf_dir).where(F.col("sector") == "rural")
    ratio = ind.ratio_per(p, ["state"], F.col("gender") == "female", F.col("gender") == "male")
    return r6(ind.arg_extreme(ratio.withColumn("ratio", F.round("ratio", 6)), "ratio", "state"))

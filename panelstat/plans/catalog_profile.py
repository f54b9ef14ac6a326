"""Registered profile queries (A19, J9, J10, S13) and oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelstat.plans import sqlgen as S
from panelstat.plans.catalog_survey import INDUSTRY_SQL, OCCUPATION_SQL, industry_codebook, occupation_codebook
from panelstat.plans.profile import (HH_DISTS, PER_DISTS, TRAINED, attach_left, household_metrics, person_metrics,
                                      state_profile, state_profile_unweighted, state_profile_v2)
from panelstat.plans.registry import r6, register, sql_r6
from panelstat.plans.views import by_panel, households, panel_sql, persons, with_views
from panelstat.sources.codebooks import AGE_BANDS, STATUS, status_codebook
from panelstat.sources.sinks import profile_json

_K = "state IS NOT NULL AND sector IS NOT NULL"

_PER_SRC = f"""(SELECT p.*,
  CASE WHEN vocational_training IS NULL THEN NULL
       WHEN regexp_matches(lower(vocational_training), 'received|yes') THEN 'yes' ELSE 'no' END AS _voc,
  coalesce(ci.label, substr(p.industry_code, 1, 2)) AS _ind,
  coalesce(co.label, substr(p.occupation_code, 1, 3)) AS _occ
FROM person_v p LEFT JOIN {INDUSTRY_SQL} ci ON ci.code = substr(p.industry_code, 1, 2)
  LEFT JOIN {OCCUPATION_SQL} co ON co.code = substr(p.occupation_code, 1, 3))"""


def _unpivot_sql(src: str, cols: dict[str, str]) -> str:
    return "(" + " UNION ALL ".join(
        f"SELECT state, sector, weight, '{m}' AS metric, CAST({c} AS VARCHAR) AS value FROM {src} s"
        for m, c in cols.items()) + ")"


def _kc(keys) -> tuple[str, str]:
    return ", ".join(keys), " AND ".join(f"{k} IS NOT NULL" for k in keys)


def _scalar(metric: str, expr: str, src: str, keys=("state", "sector")) -> str:
    ks, cond = _kc(keys)
    return (f"SELECT {ks}, '{metric}' AS metric, CAST(NULL AS VARCHAR) AS category, {expr} AS value "
            f"FROM {src} s WHERE {cond} GROUP BY {ks}")


def _median(metric: str, col: str, src: str, keys=("state", "sector")) -> str:
    ks, _ = _kc(keys)
    return (f"SELECT {ks}, '{metric}' AS metric, CAST(NULL AS VARCHAR) AS category, median AS value "
            f"FROM ({S.wmedian(src, list(keys), col)}) m")


def _unpivot_k(src: str, cols: dict[str, str], keys) -> str:
    ks, _ = _kc(keys)
    return "(" + " UNION ALL ".join(
        f"SELECT {ks}, weight, '{m}' AS metric, CAST({c} AS VARCHAR) AS value FROM {src} s"
        for m, c in cols.items()) + ")"


def profile_sql(keys=("state", "sector"), rounded: bool = True, left: bool = False) -> str:
    """Oracle text of ``state_profile(keys, rounded)``; with ``left`` persons only where there are households."""
    keys = list(keys)
    ks, cond = _kc(keys)
    hh_dist = S.wdist(_unpivot_k("household_v", {m: c for m, (c, _) in HH_DISTS.items()}, keys),
                      [*keys, "metric"], "value", top_n=100)
    per_dist = S.wdist(_unpivot_k(_PER_SRC, PER_DISTS, keys), [*keys, "metric"], "value", top_n=5,
                       digits=2 if rounded else None)
    hh_value = ("CASE WHEN metric = 'household_type' THEN round(share, 3) ELSE round(share, 2) END"
                if rounded else "share")
    bands = " UNION ALL ".join(
        f"SELECT {ks}, 'age_distribution' AS metric, '{b[0]}' AS category, \"b_{b[0]}\" AS value FROM "
        f"(SELECT {ks}, {S.bands('age', AGE_BANDS, prefix='b_')} FROM person_v WHERE {cond} GROUP BY {ks}) b"
        for b in AGE_BANDS)
    describe = " UNION ALL ".join(
        f"SELECT {ks}, 'expenditure_distribution' AS metric, '{k}' AS category, {e} AS value "
        f"FROM household_v WHERE {cond} GROUP BY {ks} HAVING count(expenditure) > 0"
        for k, e in _DESC_COLS)
    house = " UNION ALL ".join([
        _scalar("total_households", "sum(weight)", "household_v", keys),
        _scalar("avg_household_size", S.wmean("household_size"), "household_v", keys),
        _scalar("avg_monthly_expenditure", S.wmean("expenditure"), "household_v", keys),
        _median("median_monthly_expenditure", "expenditure", "household_v", keys),
        f"SELECT {ks}, metric, category, {hh_value} AS value FROM ({hh_dist}) d",
        describe])
    people = " UNION ALL ".join([
        _scalar("avg_years_formal_education", S.wmean("years_formal_education"), "person_v", keys),
        _scalar("avg_regular_wage_earning", S.wmean("regular_earning"), "person_v", keys),
        _scalar("avg_self_employed_earning", S.wmean("self_employed_earning"), "person_v", keys),
        bands,
        _median("median_regular_wage_earning", "regular_earning", "person_v", keys),
        _median("median_self_employed_earning", "self_employed_earning", "person_v", keys),
        f"SELECT {ks}, metric, category, share AS value FROM ({per_dist}) d",
    ])
    if not left:
        return f"{house} UNION ALL {people}"
    return f"{house} UNION ALL SELECT * FROM ({people}) pp WHERE ({ks}) IN (SELECT ({ks}) FROM household_v WHERE {cond})"


_DESC_COLS = [("count", "CAST(count(expenditure) AS DOUBLE)"), ("mean", "avg(expenditure)"),
              ("std", "stddev_samp(expenditure)"), ("min", "min(expenditure)"),
              ("10%", "quantile_cont(expenditure, 0.1)"), ("25%", "quantile_cont(expenditure, 0.25)"),
              ("50%", "quantile_cont(expenditure, 0.5)"), ("75%", "quantile_cont(expenditure, 0.75)"),
              ("90%", "quantile_cont(expenditure, 0.9)"), ("max", "max(expenditure)")]
PROFILE_SQL = profile_sql()


@register("profile_urban_rural", with_views(sql_r6(PROFILE_SQL, ["value"])))
def q_profile(spark, sf_dir):
    return r6(state_profile(households(spark, sf_dir), persons(spark, sf_dir), industry_codebook(spark),
                            occupation_codebook(spark)))


# Households of one file, persons of the other: urban first visits with urban revisits, and the other way round.
HH_PANELS = {"urban": "first_visit", "rural": "revisit"}
PER_PANELS = {"urban": "revisit", "rural": "first_visit"}


@register("profile_panels", with_views(sql_r6(PROFILE_SQL, ["value"]), panel_sql(HH_PANELS), panel_sql(PER_PANELS)))
def q_profile_panels(spark, sf_dir):
    """The profile with one panel per side and sector."""
    return r6(state_profile(by_panel(households(spark, sf_dir), HH_PANELS), by_panel(persons(spark, sf_dir), PER_PANELS),
                            industry_codebook(spark), occupation_codebook(spark)))


_HH_STATES = "state <> 'NATION_3' OR state IS NULL"  # a state that only persons have


@register("profile_left", with_views(sql_r6(profile_sql(["state"], rounded=False, left=True), ["value"]), _HH_STATES))
def q_profile_left(spark, sf_dir):
    """Whole profiles, persons attached to the states that have households."""
    hh = households(spark, sf_dir).where(F.col("state").isNull() | (F.col("state") != "NATION_3"))
    return r6(attach_left(household_metrics(hh, ["state"], rounded=False),
                          person_metrics(persons(spark, sf_dir), industry_codebook(spark), occupation_codebook(spark),
                                         ["state"], rounded=False), ["state"]))


_JSON_SQL = f"""
SELECT state, '{{' || string_agg('"' || sector || '":' || j, ',' ORDER BY sector) || '}}' AS profile FROM (
  SELECT state, sector, '{{' || string_agg('"' || metric || '":' || j, ',' ORDER BY metric) || '}}' AS j FROM (
    SELECT state, sector, metric,
      CASE WHEN bool_and(category IS NULL) THEN coalesce(CAST(max(value) AS VARCHAR), 'null')
           ELSE '{{' || string_agg('"' || category || '":' || CAST(value AS VARCHAR), ',' ORDER BY category) || '}}'
      END AS j
    FROM ({sql_r6(PROFILE_SQL, ["value"])}) l GROUP BY state, sector, metric) m
  GROUP BY state, sector) s
GROUP BY state"""


@register("profile_json", with_views(_JSON_SQL))
def q_profile_json(spark, sf_dir):
    """Nested state -> sector -> metric JSON documents."""
    long = state_profile(households(spark, sf_dir), persons(spark, sf_dir), industry_codebook(spark),
                         occupation_codebook(spark))
    return profile_json(r6(long))


_STATUS_VALUES = S.values_table([(c, l) for c, l, _ in STATUS], ["code", "label"], "st")
_PER_STATUS = (f"(SELECT d.*, st.label AS _status FROM {_PER_SRC} d LEFT JOIN {_STATUS_VALUES} ON st.code = d.status_code)")
_DRAFT_DISTS = {**{m: c for m, c in PER_DISTS.items() if m != "vocational_training"}, "principal_activity_status": "_status"}
_IN_HH = "state IN (SELECT state FROM household_v WHERE state IS NOT NULL)"


def _draft_describe() -> str:
    return " UNION ALL ".join(
        f"SELECT state, 'expenditure_distribution' AS metric, '{k}' AS category, {e} AS value "
        f"FROM household_v WHERE state IS NOT NULL GROUP BY state HAVING count(expenditure) > 0" for k, e in _DESC_COLS)


def profile_v2_sql() -> str:
    k = ["state"]
    hh = "(SELECT * REPLACE (multiplier AS weight) FROM household_v)"
    per = f"(SELECT * REPLACE (multiplier AS weight) FROM {_PER_STATUS} s0)"
    bands = " UNION ALL ".join(
        f"SELECT state, 'age_distribution' AS metric, '{b[0]}' AS category, \"b_{b[0]}\" AS value FROM "
        f"(SELECT state, {S.bands('age', AGE_BANDS, prefix='b_')} FROM {per} s WHERE state IS NOT NULL GROUP BY state) b"
        for b in AGE_BANDS)

    def dist(src: str, cols: dict[str, str]) -> str:
        return (f"SELECT state, metric, category, share AS value FROM "
                f"({S.wdist(_unpivot_k(src, cols, k), ['state', 'metric'], 'value', top_n=5)}) d")
    people = " UNION ALL ".join([
        _scalar("total_population", "sum(weight)", per, k), bands, dist(per, _DRAFT_DISTS),
        _scalar("avg_years_formal_education", S.wmean("years_formal_education"), per, k),
        _scalar("avg_regular_wage_earning", S.wmean("regular_earning"), per, k),
        _scalar("avg_self_employed_earning", S.wmean("self_employed_earning"), per, k),
        _median("median_regular_wage_earning", "regular_earning", per, k),
        _median("median_self_employed_earning", "self_employed_earning", per, k),
        _scalar(TRAINED, "sum(CASE WHEN _voc = 'yes' THEN weight ELSE 0.0 END) / nullif(sum(weight), 0)", per, k)])
    return " UNION ALL ".join([
        _scalar("total_households", "sum(weight)", hh, k),
        _scalar("population_estimate", "sum(household_size * weight)", hh, k),
        _scalar("avg_household_size", S.wmean("household_size"), hh, k),
        _scalar("avg_monthly_expenditure", S.wmean("expenditure"), hh, k),
        _median("median_monthly_expenditure", "expenditure", hh, k),
        dist(hh, {m: c for m, (c, _) in HH_DISTS.items()}), _draft_describe(),
        f"SELECT * FROM ({people}) pp WHERE {_IN_HH}"])


@register("profile_v2", with_views(sql_r6(profile_v2_sql(), ["value"])))
def q_profile_v2(spark, sf_dir):
    """Older draft: raw multipliers, per state, top-5 unrounded shares, all its metrics, left merge."""
    return r6(state_profile_v2(households(spark, sf_dir), persons(spark, sf_dir), industry_codebook(spark),
                               occupation_codebook(spark), status_codebook(spark)))


def profile_unweighted_sql() -> str:
    def dist(src: str, cols: dict[str, str]) -> str:
        return " UNION ALL ".join(
            f"SELECT g.state, '{m}' AS metric, CAST({c} AS VARCHAR) AS category, count(*) / max(t.n)::DOUBLE AS value "
            f"FROM {src} g JOIN (SELECT state, count(*) AS n FROM {src} c GROUP BY state) t ON t.state = g.state "
            f"WHERE {c} IS NOT NULL GROUP BY g.state, category" for m, c in cols.items())

    k = ["state"]
    bands = " UNION ALL ".join(
        f"SELECT state, 'age_distribution' AS metric, '{n}' AS category, count(*) FILTER ("
        + " AND ".join(([f"age >= {lo}"] if lo is not None else ["age IS NOT NULL"]) + ([f"age < {hi}"] if hi is not None else []))
        + f") / count(*)::DOUBLE AS value FROM {_PER_STATUS} s WHERE state IS NOT NULL GROUP BY state HAVING value > 0"
        for n, lo, hi in AGE_BANDS)
    people = " UNION ALL ".join([
        _scalar("total_population", "count(*)::DOUBLE", _PER_STATUS, k), bands, dist(_PER_STATUS, _DRAFT_DISTS),
        _scalar("avg_years_formal_education", "avg(years_formal_education)", _PER_STATUS, k),
        _scalar("avg_regular_wage_earning", "avg(regular_earning)", _PER_STATUS, k),
        _scalar("median_regular_wage_earning", "quantile_cont(regular_earning, 0.5)", _PER_STATUS, k),
        _scalar("avg_self_employed_earning", "avg(self_employed_earning)", _PER_STATUS, k),
        _scalar("median_self_employed_earning", "quantile_cont(self_employed_earning, 0.5)", _PER_STATUS, k),
        _scalar(TRAINED, "count(*) FILTER (_voc = 'yes') / count(*)::DOUBLE", _PER_STATUS, k)])
    return " UNION ALL ".join([
        _scalar("total_households", "count(*)::DOUBLE", "household_v", k),
        _scalar("avg_household_size", "avg(household_size)", "household_v", k),
        _scalar("avg_monthly_expenditure", "avg(expenditure)", "household_v", k),
        _scalar("median_monthly_expenditure", "quantile_cont(expenditure, 0.5)", "household_v", k),
        dist("household_v", {m: c for m, (c, _) in HH_DISTS.items()}), _draft_describe(),
        f"SELECT * FROM ({people}) pp WHERE {_IN_HH} AND (value IS NOT NULL OR starts_with(metric, 'avg_'))"])


@register("profile_unweighted", with_views(sql_r6(profile_unweighted_sql(), ["value"])))
def q_profile_unweighted(spark, sf_dir):
    """First draft: every row counts once."""
    return r6(state_profile_unweighted(households(spark, sf_dir), persons(spark, sf_dir), industry_codebook(spark),
                                       occupation_codebook(spark), status_codebook(spark)))


@register("profile_by_state", with_views(sql_r6(profile_sql(["state"], rounded=False), ["value"])))
def q_profile_by_state(spark, sf_dir):
    """Profile without the sector split and without rounded shares."""
    return r6(state_profile(households(spark, sf_dir), persons(spark, sf_dir), industry_codebook(spark),
                            occupation_codebook(spark), keys=["state"], rounded=False))

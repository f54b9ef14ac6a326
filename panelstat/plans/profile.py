"""State profile (A19, J9, J10, S13): every household and person metric per
(state, sector) as long rows ``state, sector, metric, category, value``.

Physical shape, per side: one scan of the source, every metric input
unpivoted to ``(keys, metric, category, num, weight)`` and partially
aggregated in a single shuffle, written once to the checkpoint folder; all scalar means, totals, age
bands, distributions (one top-n pass for all categorical metrics) and medians
(one cumulative pass) derive from that narrow table. The two sides are merged
by union - a full outer merge on (state, sector) needs no join in long form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelstat.operators import estimators as est
from panelstat.operators.lookups import lookup
from panelstat.session import materialize
from panelstat.sources.codebooks import AGE_BANDS

KEYS = ["state", "sector"]
HH_DISTS = {"household_type": ("household_type", 3), "religion": ("religion", 2),
            "social_group": ("social_group", 2)}
PER_DISTS = {"gender_ratio": "gender", "marital_status": "marital_status", "education": "general_education",
             "technical_education": "technical_education", "vocational_training": "_voc",
             "occupation": "_occ", "industry": "_ind"}


TRAINED = "vocational_training_percentage"
BANDED = ("age",)
ALL_ROWS = "*"  # the metric of the entry that every row has


def metric_preaggregate(df: DataFrame, keys, categorical: dict[str, str], numeric: dict[str, str],
                        weight: str = "weight") -> DataFrame:
    """One pass over the rows: every metric input becomes an entry
    ``(metric, category, num)`` and the weights are summed per
    ``(keys, metric, category, num)``. Every metric family below derives from
    this one partially-aggregated table, so the source is scanned (and joined)
    once and all consumers share the same exchange."""
    names = [*categorical, *numeric, ALL_ROWS]  # grouped by number, named at the end

    def entry(metric: str, category=None, num=None):
        return F.struct(F.lit(names.index(metric)).alias("_m"), F.lit(category).cast("string").alias("category"),
                        F.lit(num).cast("double").alias("num"))
    entries = [*[entry(m, category=F.col(c)) for m, c in categorical.items()],
               *[entry(m, num=F.col(c)) for m, c in numeric.items()], entry(ALL_ROWS)]
    # The weight is made exact once per row, below the entries: per entry, this took most of the time.
    w = F.col(weight).cast("double")
    rows = df.select(*keys, w.alias("_x"), w.cast(est.WEIGHT_TYPE).alias("_w"),
                     *{c: F.col(c) for c in [*categorical.values(), *numeric.values()]}.values())
    ex = rows.select(*keys, "_x", "_w", F.inline(F.array(*entries)))
    # null values count in no metric but the bands, whose denominator is every row; every row counts in ALL_ROWS
    always = [k for k, m in enumerate(names) if m in BANDED or m == ALL_ROWS]
    told = ex.where(F.col("category").isNotNull() | F.col("num").isNotNull() | F.col("_m").isin(*always))
    pre = (told.groupBy(*keys, "_m", "category", "num")
           .agg(F.sum("_w").alias("w"), F.sum("_x").alias("x"),
                F.count(F.lit(1)).alias("n")))  # w: exact, for ranks and medians; x: for ratios
    pre = pre.select(*keys, F.element_at(F.array(*map(F.lit, names)), F.col("_m") + 1).alias("metric"),
                     "category", "num", "w", "x", "n")
    # Consumers filter by metric and Catalyst would push those filters below
    # the aggregate, giving each consumer its own scan. Writing this narrow,
    # pre-aggregated table to the shared checkpoint folder keeps it to one
    # scan and survives executor loss.
    return materialize(pre, "profile_pre")


def _means(pre: DataFrame, keys, metrics: dict[str, str]) -> DataFrame:
    """Weighted means from the pre-aggregate: out-name -> input metric."""
    # one aggregate for all; groups without a value keep a null mean
    v = {out: F.when(F.col("metric") == inp, F.col("num")) for out, inp in metrics.items()}
    wide = pre.groupBy(*keys).agg(*[est._ratio(F.sum(c * F.col("x")), F.sum(F.when(c.isNotNull(), F.col("x")))).alias(out)
                                    for out, c in v.items()])
    pairs = ", ".join(f"'{out}', `{out}`" for out in metrics)
    return wide.select(*keys, F.expr(f"stack({len(metrics)}, {pairs}) AS (metric, value)")).select(
        *keys, "metric", F.lit(None).cast("string").alias("category"), "value")


def _medians(pre: DataFrame, keys, metrics: dict[str, str]) -> DataFrame:
    src = pre.where(F.col("metric").isin(*metrics.values()))
    med = est.weighted_median(src, [*keys, "metric"], "num", "w", name="value")
    rename = F.lit(None).cast("string")
    for out, inp in metrics.items():
        rename = F.when(F.col("metric") == inp, F.lit(out)).otherwise(rename)
    return med.select(*keys, rename.alias("metric"), F.lit(None).cast("string").alias("category"), "value")


def _total(pre: DataFrame, keys, name: str) -> DataFrame:
    """Sum of the weights of all rows."""
    return (pre.where(F.col("metric") == ALL_ROWS).groupBy(*keys).agg(F.sum("x").alias("value"))
            .select(*keys, F.lit(name).alias("metric"), F.lit(None).cast("string").alias("category"), "value"))


DESCRIBE_NAMES = ["count", "mean", "std", "min", "10%", "25%", "50%", "75%", "90%", "max"]


def _describe(pre: DataFrame, keys, metric: str, name: str, cum: DataFrame | None = None) -> DataFrame:
    """Unweighted describe (A8) of one numeric metric from the pre-aggregate:
    row counts per distinct value give count/mean/min/max, a second pass over
    the distinct values gives the sample std, and the cumulative counts give
    the interpolated quantiles."""
    src = pre.where((F.col("metric") == metric) & F.col("num").isNotNull())
    n, v = F.col("n").cast("double"), F.col("num")
    mom = src.groupBy(*keys).agg(F.sum(n).alias("count"), F.try_divide(F.sum(v * n), F.sum(n)).alias("mean"),
                                 F.min(v).alias("min"), F.max(v).alias("max"))
    dev = (src.join(mom.select(*keys, "mean"), keys)
           .groupBy(*keys).agg(F.sum(n * (v - F.col("mean")) * (v - F.col("mean"))).alias("_ss"),
                               F.sum(n).alias("_n")))
    std = dev.select(*keys, F.sqrt(F.try_divide(F.col("_ss"), F.when(F.col("_n") > 1, F.col("_n") - 1))).alias("std"))
    qnames = ["q10", "q25", "q50", "q75", "q90"]
    q = (est.quantiles_from_cumulative(cum, keys, est.DESCRIBE_PROBS, qnames, "_ncum", "_ntot") if cum is not None
         else est.exact_quantiles(src, keys, "num", est.DESCRIBE_PROBS, qnames, count="n"))
    wide = mom.join(std, keys, "left").join(q, keys, "left")
    cols = {"count": "count", "mean": "mean", "std": "std", "min": "min", "10%": "q10", "25%": "q25",
            "50%": "q50", "75%": "q75", "90%": "q90", "max": "max"}
    pairs = ", ".join(f"'{k}', CAST(`{c}` AS DOUBLE)" for k, c in cols.items())
    return wide.select(*keys, F.lit(name).alias("metric"),
                       F.expr(f"stack({len(cols)}, {pairs}) AS (category, value)"))


def household_metrics(hh: DataFrame, keys=KEYS, rounded: bool = True, top_n: int = 100,
                      population: bool = False) -> DataFrame:
    """Household metrics per key; ``population`` adds the estimate from the
    household sizes (A7)."""
    keys = list(keys)
    hh = est._drop_null_keys(hh, keys)
    pre = metric_preaggregate(hh, keys, {m: c for m, (c, _) in HH_DISTS.items()},
                              {"household_size": "household_size", "expenditure": "expenditure"})
    total = _total(pre, keys, "total_households")
    means = _means(pre, keys, {"avg_household_size": "household_size", "avg_monthly_expenditure": "expenditure"})
    # one cumulative pass over expenditure serves the weighted median and the
    # count-based describe quantiles
    exp = pre.where(F.col("metric") == "expenditure")
    cum = est._cumulative(exp, keys, "num", "w", count_col="n")
    med = (cum.where(F.col("_cum") + F.col("_cum") >= F.col("_tot")).groupBy(*keys)
           .agg(F.min("_v").cast("double").alias("value"))
           .select(*keys, F.lit("median_monthly_expenditure").alias("metric"),
                   F.lit(None).cast("string").alias("category"), "value"))
    dist = est.weighted_distribution(pre.where(F.col("metric").isin(*HH_DISTS)), [*keys, "metric"], "category",
                                     "w", top_n=top_n)
    value = (F.when(F.col("metric") == "household_type", F.round("share", 3)).otherwise(F.round("share", 2))
             if rounded else F.col("share"))
    dist = dist.select(*keys, "metric", "category", value.alias("value"))
    desc = _describe(pre, keys, "expenditure", "expenditure_distribution", cum)
    cols = [*keys, "metric", "category", "value"]
    out = (total.select(cols).unionByName(means.select(cols)).unionByName(med.select(cols)).unionByName(dist)
           .unionByName(desc.select(cols)))
    return out.unionByName(_weighted_sum(pre, keys, "household_size", "population_estimate")) if population else out


def _decoded_persons(per: DataFrame, industry: DataFrame, occupation: DataFrame) -> DataFrame:
    per = per.withColumn("_voc", est.yes_no("vocational_training"))
    per = lookup(per.withColumn("_ipfx", F.substring("industry_code", 1, 2)), industry, {"code": F.col("_ipfx")},
                 out="_ind")
    per = lookup(per.withColumn("_opfx", F.substring("occupation_code", 1, 3)), occupation,
                 {"code": F.col("_opfx")}, out="_occ")
    return per.withColumns({"_ind": F.coalesce("_ind", "_ipfx"), "_occ": F.coalesce("_occ", "_opfx")})


def person_metrics(per: DataFrame, industry: DataFrame, occupation: DataFrame, keys=KEYS, rounded: bool = True,
                   statuses: DataFrame | None = None) -> DataFrame:
    """Person metrics per key; with ``statuses`` also the older draft's total
    population, shares of the principal activity statuses and of the persons
    with vocational training (null counts as without, A15)."""
    keys = list(keys)
    per = _decoded_persons(est._drop_null_keys(per, keys), industry, occupation)
    dists = dict(PER_DISTS)
    if statuses is not None:
        per = lookup(per, statuses, {"code": F.col("status_code")}, out="_status")
        per = per.withColumn("_trained", F.when(F.col("_voc") == "yes", F.lit("yes")).otherwise(F.lit("no")))
        dists = {**{m: c for m, c in dists.items() if m != "vocational_training"},
                 "principal_activity_status": "_status", TRAINED: "_trained"}
    pre = metric_preaggregate(per, keys, dists,
                              {"years_formal_education": "years_formal_education", "regular_earning": "regular_earning",
                               "self_employed_earning": "self_employed_earning", "age": "age"})
    means = _means(pre, keys, {"avg_years_formal_education": "years_formal_education",
                               "avg_regular_wage_earning": "regular_earning",
                               "avg_self_employed_earning": "self_employed_earning"})
    ages = pre.where(F.col("metric") == "age").groupBy(*keys).agg(*est.band_exprs("num", AGE_BANDS, "x", prefix="age_"))
    band_pairs = ", ".join(f"'{b[0]}', `age_{b[0]}`" for b in AGE_BANDS)
    bands = ages.select(*keys, F.lit("age_distribution").alias("metric"),
                        F.expr(f"stack({len(AGE_BANDS)}, {band_pairs}) AS (category, value)"))
    med = _medians(pre, keys, {"median_regular_wage_earning": "regular_earning",
                               "median_self_employed_earning": "self_employed_earning"})
    dist = est.weighted_distribution(pre.where(F.col("metric").isin(*dists)), [*keys, "metric"], "category",
                                     "w", top_n=5, digits=2 if rounded else None).withColumnRenamed("share", "value")
    cols = [*keys, "metric", "category", "value"]
    out = (means.select(cols).unionByName(bands.select(cols)).unionByName(med.select(cols))
           .unionByName(dist.where(F.col("metric") != TRAINED).select(cols)))
    if statuses is None:
        return out
    trained = pre.where(F.col("metric") == TRAINED).groupBy(*keys).agg(est._ratio(
        F.sum(F.when(F.col("category") == "yes", F.col("x")).otherwise(0.0)), F.sum("x")).alias("value"))
    trained = trained.select(*keys, F.lit(TRAINED).alias("metric"), F.lit(None).cast("string").alias("category"), "value")
    return out.unionByName(_total(pre, keys, "total_population")).unionByName(trained)


def state_profile(hh: DataFrame, per: DataFrame, industry: DataFrame, occupation: DataFrame, keys=KEYS,
                  rounded: bool = True) -> DataFrame:
    """All metrics, both sides, long form (A19 + J9 full-outer merge by union).
    ``keys=["state"]``, ``rounded=False`` gives the variant without the sector
    split and without rounded shares."""
    return household_metrics(hh, keys, rounded).unionByName(person_metrics(per, industry, occupation, keys, rounded))


def attach_left(households: DataFrame, persons: DataFrame, keys) -> DataFrame:
    """Person metrics beside household metrics, for the keys that have
    household metrics (J10); in long form a left merge is a union."""
    known = households.select(*keys).distinct()
    return households.unionByName(persons.join(known, list(keys), "left_semi"))


def _weighted_sum(pre: DataFrame, keys, metric: str, name: str) -> DataFrame:
    """Sum of value x weight of one numeric metric (A7 population estimate)."""
    return (pre.where(F.col("metric") == metric).groupBy(*keys).agg(F.sum(F.col("num") * F.col("x")).alias("value"))
            .select(*keys, F.lit(name).alias("metric"), F.lit(None).cast("string").alias("category"), "value"))


def state_profile_v2(hh: DataFrame, per: DataFrame, industry: DataFrame, occupation: DataFrame,
                     statuses: DataFrame, keys=("state",)) -> DataFrame:
    """The older draft: raw multipliers as weights (A2), per state, top-5
    unrounded shares, population estimate, activity statuses; person metrics
    for states with households only."""
    hh = hh.withColumn("weight", F.col("multiplier").cast("double"))
    per = per.withColumn("weight", F.col("multiplier").cast("double"))
    return attach_left(household_metrics(hh, keys, rounded=False, top_n=5, population=True),
                       person_metrics(per, industry, occupation, keys, rounded=False, statuses=statuses), keys)


def _unweighted(df: DataFrame, keys, categorical: dict[str, str], numeric: dict[str, str], means: dict[str, str],
                medians: dict[str, str], total: str) -> tuple[DataFrame, DataFrame]:
    """(metrics, the pre-aggregate) of the unweighted draft: counts, means,
    interpolating medians, and shares over all rows."""
    pre = metric_preaggregate(df.withColumn("weight", F.lit(1.0)), keys, categorical, numeric)
    cols = [*keys, "metric", "category", "value"]
    rows = pre.where(F.col("metric") == ALL_ROWS).groupBy(*keys).agg(F.sum("n").cast("double").alias("rows"))
    totals = rows.select(*keys, F.lit(total).alias("metric"), F.lit(None).cast("string").alias("category"),
                         F.col("rows").alias("value"))
    counted = pre.where(F.col("metric").isin(*categorical)).groupBy(*keys, "metric", "category").agg(F.sum("n").alias("n"))
    shares = counted.join(rows, list(keys)).select(*keys, "metric", "category",
                                                   (F.col("n") / F.col("rows")).alias("value"))
    names = F.create_map(*[F.lit(x) for out, inp in medians.items() for x in (inp, out)])
    mid = est.exact_quantiles(pre.where(F.col("metric").isin(*medians.values())), [*keys, "metric"], "num", [0.5],
                              ["value"], count="n")
    mid = mid.select(*keys, F.element_at(names, F.col("metric")).alias("metric"),
                     F.lit(None).cast("string").alias("category"), "value")
    return totals.select(cols).unionByName(shares).unionByName(_means(pre, keys, means).select(cols)).unionByName(mid), pre


def state_profile_unweighted(hh: DataFrame, per: DataFrame, industry: DataFrame, occupation: DataFrame,
                             statuses: DataFrame, keys=("state",)) -> DataFrame:
    """The first draft: every row counts once, shares over all rows of the
    group, person metrics for states with households only."""
    keys = list(keys)
    hh = est._drop_null_keys(hh, keys)
    house, pre = _unweighted(hh, keys, {m: c for m, (c, _) in HH_DISTS.items()},
                             {"household_size": "household_size", "expenditure": "expenditure"},
                             {"avg_household_size": "household_size", "avg_monthly_expenditure": "expenditure"},
                             {"median_monthly_expenditure": "expenditure"}, "total_households")
    house = house.unionByName(_describe(pre, keys, "expenditure", "expenditure_distribution"))
    per = _decoded_persons(est._drop_null_keys(per, keys), industry, occupation)
    per = lookup(per, statuses, {"code": F.col("status_code")}, out="_status")
    trained = F.when(F.col("_voc") == "yes", F.lit("yes"))
    bands = {f"_age_{n}": F.when((F.coalesce(F.col("age") >= (lo or 0), F.lit(False)) if lo is not None else F.col("age").isNotNull())
                                 & (F.coalesce(F.col("age") < hi, F.lit(False)) if hi is not None else F.lit(True)), F.lit("in"))
             for n, lo, hi in AGE_BANDS}
    per = per.withColumns({"_trained": trained, **bands})
    dists = {**{m: c for m, c in PER_DISTS.items() if m != "vocational_training"},
             "principal_activity_status": "_status", TRAINED: "_trained", **{c: c for c in bands}}
    earned = {"regular_wage_earning": "regular_earning", "self_employed_earning": "self_employed_earning"}
    people, _ = _unweighted(per, keys, dists, {"years_formal_education": "years_formal_education",
                                               **{c: c for c in earned.values()}},
                            {"avg_years_formal_education": "years_formal_education",
                             **{f"avg_{m}": c for m, c in earned.items()}},
                            {f"median_{m}": c for m, c in earned.items()}, "total_population")
    # shares of single conditions: bands become categories of one metric, the trained a plain number
    metric = F.when(F.col("metric").startswith("_age_"), F.lit("age_distribution")).otherwise(F.col("metric"))
    category = (F.when(F.col("metric").startswith("_age_"), F.substring(F.col("metric"), 6, 100))
                .when(F.col("metric") != TRAINED, F.col("category")))
    people = people.select(*keys, metric.alias("metric"), category.alias("category"), "value")
    return attach_left(house, people, keys)

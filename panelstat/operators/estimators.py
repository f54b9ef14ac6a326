"""Weighted and unweighted estimators.

All estimators are DataFrame -> DataFrame and return *long* rows keyed by the
group keys. Design points for scale:

* every estimator starts with a partial (map-side) aggregation on
  ``(keys, value)``, so rows never move before they are combined;
* null group keys are dropped (a survey row without a state belongs to no
  state);
* top-n ranking and cumulative weights never put a whole group into one
  task: top-n is taken per ``(keys, hash bucket)`` first, and cumulative
  sums run over range partitions of ``(keys, value)`` with per-partition
  offsets, so one hot state is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelstat.functions import _c

OTHER = "other"
_TOPN_BUCKETS = 64


def _keys(keys) -> list[str]:
    if keys is None:
        return []
    return [keys] if isinstance(keys, str) else list(keys)


def _w(weight) -> Column:
    return F.lit(1.0) if weight is None else _c(weight).cast("double")


# Weights are added up as decimals wherever sums are compared or ranked: sums of
# doubles depend on the order of the rows, and so on the partitions.
WEIGHT_TYPE, SUM_TYPE = "decimal(26,12)", "decimal(36,12)"


def _exact(weight) -> Column:
    return F.lit(1).cast(WEIGHT_TYPE) if weight is None else _c(weight).cast(WEIGHT_TYPE)


def _sum(col: Column | str) -> Column:
    """An exact sum of weights or of sums of weights."""
    return F.sum(col).cast(SUM_TYPE)


def _drop_null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    cond = None
    for k in keys:
        c = F.col(k).isNotNull()
        cond = c if cond is None else cond & c
    return df if cond is None else df.where(cond)


def _ratio(num: Column, den: Column) -> Column:
    return F.try_divide(num.cast("double"), den.cast("double"))


def _round(c: Column, digits: int | None) -> Column:
    return c if digits is None else F.round(c, digits)


def _wsum(col: Column, window) -> Column:
    """An exact sum of weight sums over a window."""
    return F.sum(col.cast(SUM_TYPE)).over(window).cast(SUM_TYPE)


# --------------------------------------------------------------------------- A3


def weighted_distribution(df: DataFrame, keys, value: str, weight=None, top_n: int | None = 5,
                          digits: int | None = None, other_label: str = OTHER,
                          denominator: str = "nonnull") -> DataFrame:
    """Share of weight per category inside each group.

    Null values are dropped; the ``top_n`` heaviest categories (ties broken by
    category text) are kept and the rest folded into ``other_label`` when its
    weight is positive. ``denominator='all'`` divides by the weight of all rows
    including null values (the unweighted variant, A10).

    Returns ``keys..., category, rank, share`` (rank of ``other`` = top_n + 1).
    """
    keys = _keys(keys)
    base = _drop_null_keys(df, keys).select(*keys, _c(value).cast("string").alias("category"),
                                            _exact(weight).alias("_wt"))
    # weight per category, null values kept as a null category for the
    # all-rows denominator
    per_cat = base.groupBy(*keys, "category").agg(_sum("_wt").alias("_cw"))
    kw = Window.partitionBy(*keys)
    order = [F.col("_cw").desc(), F.col("category")]

    if top_n is None:
        # a rank for every category: range partitions and offsets, as for medians
        totals = per_cat.groupBy(*keys).agg(
            _sum(F.when(F.col("category").isNotNull() | F.lit(denominator == "all"), F.col("_cw"))).alias("_tot"))
        ranked = _running(per_cat.where(F.col("category").isNotNull()).withColumn("_one", F.lit(1)), keys, order,
                          {"_one": ("rank", "_all")})
        joined = (ranked.join(totals, keys) if keys else ranked.withColumn("_k", F.lit(0))
                  .join(totals.withColumn("_k", F.lit(0)), "_k"))
        return joined.select(*keys, "category", F.col("rank").cast("int").alias("rank"),
                             _round(_ratio(F.col("_cw"), F.col("_tot")), digits).alias("share"))

    # Top-n in two steps so no task holds every category of a hot group:
    # each (keys, hash bucket) keeps its best n categories plus one
    # remainder row; one window over keys then ranks at most
    # buckets x (n + 2) rows and totals the weight. Each step reuses the
    # previous partitioning, so the source is scanned once. The weight of
    # null values rides along for the all-rows denominator.
    bucketed = per_cat.withColumn("_b", F.pmod(F.xxhash64("category"), F.lit(_TOPN_BUCKETS)))
    r = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(F.col("category").isNull(), *order))
    marked = bucketed.withColumn("_r", F.when(F.col("category").isNotNull(), r))
    cand = F.struct(F.col("_cw").alias("w"), F.col("category").alias("c"))
    zero = F.lit(0).cast(SUM_TYPE)
    buckets = marked.groupBy(*keys, "_b").agg(
        F.collect_list(F.when(F.col("_r") <= top_n, cand)).alias("_cands"),
        F.coalesce(_sum(F.when(F.col("_r") > top_n, F.col("_cw"))), zero).alias("_rem"),
        F.coalesce(_sum(F.when(F.col("category").isNull(), F.col("_cw"))), zero).alias("_nul"))
    rows_ = F.concat(F.col("_cands"), F.array(F.struct(F.col("_rem").alias("w"), F.lit(None).cast("string").alias("c"))))
    ex = buckets.select(*keys, F.posexplode(rows_).alias("_i", "_e"), "_nul").select(
        *keys, F.col("_e.c").alias("category"), F.col("_e.w").alias("_cw"),
        F.when((F.col("_i") == 0) & F.lit(denominator == "all"), F.col("_nul")).otherwise(zero).alias("_extra"))
    rank_order = [F.col("category").isNull(), *order]
    folded = (ex.withColumn("_tot", _wsum(F.col("_cw") + F.col("_extra"), kw))
              .withColumn("rank", F.row_number().over(kw.orderBy(*rank_order)))
              .withColumn("_top", F.col("category").isNotNull() & (F.col("rank") <= top_n)))

    # top rows keep their category, everything else folds into one 'other'
    # row; the data is already partitioned by keys, so no shuffle here
    cat = F.when(F.col("_top"), F.col("category")).otherwise(F.lit(other_label))
    out = (folded.groupBy(*keys, "_top", cat.alias("_cat"))
           .agg(_sum("_cw").alias("_cw"), F.max("_tot").alias("_tot"), F.min("rank").alias("_rk"))
           .where(F.col("_top") | (F.col("_cw") > 0)))
    rank = F.when(F.col("_top"), F.col("_rk")).otherwise(F.lit(top_n + 1)).cast("int")
    return out.select(*keys, F.col("_cat").alias("category"), rank.alias("rank"),
                      _round(_ratio(F.col("_cw"), F.col("_tot")), digits).alias("share"))


def distribution(df: DataFrame, keys, value: str, top_n: int | None = None,
                 digits: int | None = None) -> DataFrame:
    """Unweighted distribution: non-null counts over *all* rows (A10)."""
    return weighted_distribution(df, keys, value, None, top_n=top_n, digits=digits, denominator="all")


# ------------------------------------------------------------------ A4, A6, A7, A11, A14


def weighted_mean_expr(value, weight) -> Column:
    v = _c(value).cast("double")
    w = _w(weight)
    return _ratio(F.sum(v * w), F.sum(F.when(v.isNotNull(), w)))


def weighted_mean(df: DataFrame, keys, values, weight, suffix: str = "") -> DataFrame:
    """Sum(v*w)/Sum(w over non-null v) for each value column in one pass (A4)."""
    keys = _keys(keys)
    values = [values] if isinstance(values, str) else list(values)
    aggs = [weighted_mean_expr(v, weight).alias(f"{v}{suffix}") for v in values]
    return _drop_null_keys(df, keys).groupBy(*keys).agg(*aggs)


def weighted_total(df: DataFrame, keys, weight, size=None, name: str = "total") -> DataFrame:
    """Sum of weights (A6) or of size*weight."""
    keys = _keys(keys)
    expr = _w(weight) if size is None else _c(size).cast("double") * _w(weight)
    return _drop_null_keys(df, keys).groupBy(*keys).agg(F.sum(expr).alias(name))


def group_count(df: DataFrame, keys, name: str = "n") -> DataFrame:
    keys = _keys(keys)
    return _drop_null_keys(df, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


# --------------------------------------------------------------------------- A9, A15


def band_exprs(value, bands, weight=None, prefix: str = "") -> list[Column]:
    """Share of weight per band; null values stay in the denominator."""
    v = _c(value)
    w = _w(weight)
    out = []
    for name, lo, hi in bands:
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (v >= lo)
        if hi is not None:
            cond = cond & (v < hi)
        cond = F.coalesce(cond, F.lit(False))
        out.append(_ratio(F.sum(F.when(cond, w).otherwise(F.lit(0.0))), F.sum(w)).alias(f"{prefix}{name}"))
    return out


def banded_share(df: DataFrame, keys, value: str, bands, weight=None, long: bool = True) -> DataFrame:
    keys = _keys(keys)
    wide = _drop_null_keys(df, keys).groupBy(*keys).agg(*band_exprs(value, bands, weight, prefix="b_"))
    if not long:
        return wide
    names = [b[0] for b in bands]
    stack = ", ".join(f"'{n}', `b_{n}`" for n in names)
    return wide.select(*keys, F.expr(f"stack({len(names)}, {stack}) as (band, share)"))


def indicator_share(df: DataFrame, keys, cond: Column, weight=None, name: str = "share") -> DataFrame:
    """Weighted share of rows where ``cond`` holds; null counts as false."""
    keys = _keys(keys)
    w = _w(weight)
    hit = F.when(F.coalesce(cond, F.lit(False)), w).otherwise(F.lit(0.0))
    return _drop_null_keys(df, keys).groupBy(*keys).agg(_ratio(F.sum(hit), F.sum(w)).alias(name))


# --------------------------------------------------------------------------- A13


def mode_of(df: DataFrame, keys, value: str, name: str = "mode") -> DataFrame:
    """Most frequent non-null value; smallest on ties."""
    keys = _keys(keys)
    counts = (_drop_null_keys(df, keys).where(F.col(value).isNotNull())
              .groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n")))
    # max_by over (count desc, value asc): pack into a sortable struct
    best = counts.groupBy(*keys).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col("_v").alias("v"))).alias("_b"))
    return best.select(*keys, F.col("_b.v").alias(name))


# --------------------------------------------------------------------------- A16


def yes_no(col) -> Column:
    """'yes' when the text contains 'received' or 'yes' (any case), else 'no';
    null stays null (A16)."""
    c = _c(col)
    return F.when(c.isNull(), F.lit(None)).when(F.lower(c.cast("string")).rlike("received|yes"), "yes").otherwise("no")


# ------------------------------------------------------------- cumulative


def _running(rows: DataFrame, keys: list[str], order: list[Column], sums: dict[str, tuple[str, str]]) -> DataFrame:
    """Adds running sums in ``order`` within each group, and the groups'
    totals: ``sums`` maps a column of exact numbers to the names of both.

    The rows are range-partitioned on (keys, order), so a hot group is
    spread across partitions; each partition's running sum is offset by the
    sums of the earlier partitions of the same group. The partition id is
    written out with the rows (a Parquet table in the shared checkpoint
    folder), so the ids used for the offsets are the ones the rows keep if a
    task is retried."""
    from panelstat.session import materialize

    spark = rows.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = materialize(rows.repartitionByRange(n_parts, *[F.col(k) for k in keys], *order)
                         .withColumn("_pid", F.spark_partition_id()), "running")
    kinds = dict(ranged.dtypes)
    part = ranged.groupBy(*keys, "_pid").agg(*[F.sum(c).cast(_sum_type(kinds[c])).alias(f"_ps{c}") for c in sums])
    group = Window.partitionBy(*keys) if keys else Window.partitionBy()
    earlier = group.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = part.select(*keys, "_pid", *[x for c, (_, total) in sums.items() for x in (
        F.coalesce(F.sum(f"_ps{c}").over(earlier).cast(_sum_type(kinds[c])), F.lit(0).cast(_sum_type(kinds[c]))).alias(f"_off{c}"),
        F.sum(f"_ps{c}").over(group).cast(_sum_type(kinds[c])).alias(total))])
    within = Window.partitionBy(*keys, "_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumns({name: F.sum(c).over(within).cast(_sum_type(kinds[c])) for c, (name, _) in sums.items()})
    joined = local.join(offsets, [*keys, "_pid"])
    return joined.withColumns({name: (F.col(name) + F.col(f"_off{c}")).cast(_sum_type(kinds[c]))
                               for c, (name, _) in sums.items()}).drop("_pid", *[f"_off{c}" for c in sums])


def _sum_type(kind: str) -> str:
    return SUM_TYPE if kind.startswith("decimal") else "bigint"


def _cumulative(df: DataFrame, keys: list[str], value: str, weight, count_col: str | None = None) -> DataFrame:
    """Rows ``keys, _v, _cw, _cum, _tot``: weight per distinct value and the
    running weight up to and including it, in value order within each group
    (see ``_running``), as exact decimals.

    With ``count_col`` a second running sum of that column (row counts) is
    carried in the same pass as ``_cn, _ncum, _ntot``, so a weighted median
    and count-based quantiles share one range partitioning.
    """
    sums = [_sum(_exact(weight)).alias("_cw")] + (
        [F.sum(F.col(count_col).cast("bigint")).alias("_cn")] if count_col else [])
    pre = (_drop_null_keys(df, keys).where(_c(value).isNotNull())
           .groupBy(*keys, _c(value).alias("_v")).agg(*sums))
    return _running(pre, keys, [F.col("_v")], {"_cw": ("_cum", "_tot"), **({"_cn": ("_ncum", "_ntot")} if count_col else {})})


def weighted_median(df: DataFrame, keys, value: str, weight=None, name: str = "median") -> DataFrame:
    """Lower weighted median: first value (ascending) whose cumulative weight
    reaches half the total; no interpolation (A5). Groups with no non-null
    value produce no row."""
    keys = _keys(keys)
    cum = _cumulative(df, keys, value, weight)
    return (cum.where(F.col("_cum") + F.col("_cum") >= F.col("_tot"))
            .groupBy(*keys).agg(F.min("_v").cast("double").alias(name)))


def exact_quantiles(df: DataFrame, keys, value: str, probs: Sequence[float],
                    names: Sequence[str] | None = None, count=None) -> DataFrame:
    """Unweighted quantiles with linear interpolation (pandas/`percentile`
    semantics) computed from the distributed cumulative counts, so a hot group
    needs no single in-memory value map. ``count`` names a column of row
    counts when ``df`` is already aggregated per value."""
    keys = _keys(keys)
    names = list(names) if names else [f"p{int(round(p * 100))}" for p in probs]
    cum = _cumulative(df, keys, value, count)  # _cw = count, _cum = running count
    return quantiles_from_cumulative(cum, keys, probs, names)


def quantiles_from_cumulative(cum: DataFrame, keys, probs: Sequence[float], names: Sequence[str],
                              cum_col: str = "_cum", tot_col: str = "_tot") -> DataFrame:
    """Interpolated quantiles from running row counts (see ``_cumulative``)."""
    keys = _keys(keys)
    # value at 0-based rank k is the first value with running count > k
    lo_hi = []
    for p, nm in zip(probs, names):
        pos = (F.col(tot_col).cast("double") - 1) * F.lit(float(p))
        lo_hi += [
            F.min(F.when(F.col(cum_col) > F.floor(pos), F.col("_v"))).alias(f"{nm}__lo"),
            F.min(F.when(F.col(cum_col) > F.ceil(pos), F.col("_v"))).alias(f"{nm}__hi"),
        ]
    agg = cum.groupBy(*keys).agg(F.max(tot_col).alias("_n"), *lo_hi)
    outs = []
    for p, nm in zip(probs, names):
        pos = (F.col("_n").cast("double") - 1) * F.lit(float(p))
        frac = pos - F.floor(pos)
        lo = F.col(f"{nm}__lo").cast("double")
        hi = F.col(f"{nm}__hi").cast("double")
        outs.append(F.when(frac == 0, lo).otherwise(lo + (hi - lo) * frac).alias(nm))
    return agg.select(*keys, *outs)


DESCRIBE_PROBS = (0.1, 0.25, 0.5, 0.75, 0.9)
DESCRIBE_NAMES = ("p10", "p25", "p50", "p75", "p90")


def value_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, _v, _n, _cum, _tot``: non-null values, how many rows hold them
    and the running counts; the source is read once, for the table that
    ``_running`` writes, and moments and quantiles both follow from it."""
    cum = _cumulative(df.withColumn("_value", F.col(value).cast("double")), keys, "_value", None)
    return cum.select(*keys, "_v", *[F.col(c).cast("long").alias(n) for c, n in (("_cw", "_n"), ("_cum", "_cum"), ("_tot", "_tot"))])


def moments(counts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, count, mean, std, min, max`` of value counts."""
    n, v = F.col("_n").cast("double"), F.col("_v")
    first = counts.groupBy(*keys).agg(F.sum("_n").alias("count"), (F.sum(v * n) / F.sum(n)).alias("mean"),
                                      F.min("_v").alias("min"), F.max("_v").alias("max"))
    about = _join(counts, first.select(*keys, "mean"), keys, "inner")
    spread = about.groupBy(*keys).agg(F.sum(n * (v - F.col("mean")) * (v - F.col("mean"))).alias("_ss"))
    std = F.when(F.col("count") > 1, F.sqrt(F.try_divide(F.col("_ss"), F.col("count") - 1)))
    return _join(first, spread, keys, "left").select(*keys, "count", "mean", std.alias("std"), "min", "max")


def _join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Joins per group; without keys, a right side of one row to every row."""
    if keys:
        return left.join(right, keys, how)
    return left.withColumn("_k", F.lit(0)).join(right.withColumn("_k", F.lit(0)), "_k", how).drop("_k")


def describe(df: DataFrame, keys, value: str, approx: bool = False, accuracy: int = 10000) -> DataFrame:
    """Unweighted count, mean, sample std, min, 10/25/50/75/90 %, max (A8), all
    from one pass over the source. Groups without a non-null value give no row.

    ``approx=True`` uses ``percentile_approx`` (bounded sketch per group)."""
    keys = _keys(keys)
    base = _drop_null_keys(df, keys)
    if approx:
        v = F.col(value).cast("double")
        q = base.groupBy(*keys).agg(
            F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"),
            F.max(v).alias("max"), F.percentile_approx(v, list(DESCRIBE_PROBS), accuracy).alias("_q"))
        return q.select(*keys, "count", "mean", "std", "min", "max",
                        *[F.col("_q")[i].alias(n) for i, n in enumerate(DESCRIBE_NAMES)])
    counts = value_counts(df, keys, value)
    q = quantiles_from_cumulative(counts, keys, DESCRIBE_PROBS, DESCRIBE_NAMES)
    return _join(moments(counts, keys), q, keys, "left")


def unweighted_mean_median(df: DataFrame, keys, value: str) -> DataFrame:
    """Mean (A11) and interpolating median (A12) from one pass over the source."""
    keys = _keys(keys)
    counts = value_counts(df, keys, value)
    med = quantiles_from_cumulative(counts, keys, [0.5], ["median"])
    return _join(moments(counts, keys).select(*keys, "mean"), med, keys, "left")

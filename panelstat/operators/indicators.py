"""Labour-force indicators, subgroup totals and rankings (A17, A18, A20, T2, T3, I*)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelstat.functions import _c
from panelstat.functions.text import numeric_prefix
from panelstat.operators.estimators import _drop_null_keys, _keys, _w, weighted_distribution
from panelstat.operators.lookups import lookup
from panelstat.sources.codebooks import CASUAL_CODES, REGULAR_CODES, SELF_EMPLOYED_CODES

ALL = "all"


def labour_rate_exprs(category: str = "status_category", weight="weight") -> list[Column]:
    """WPR, LFPR, UR; 0.0 when a denominator is empty."""
    w = _w(weight)
    cat = F.col(category)
    emp = F.sum(F.when(cat == "employed", w).otherwise(0.0))
    unemp = F.sum(F.when(cat == "unemployed", w).otherwise(0.0))
    total = F.sum(w)
    lf = emp + unemp

    def safe(n, d):
        return F.coalesce(F.try_divide(n, F.when(d > 0, d)), F.lit(0.0))
    return [safe(emp, total).alias("wpr"), safe(lf, total).alias("lfpr"), safe(unemp, lf).alias("ur")]


def labour_rates(df: DataFrame, keys, category: str = "status_category", weight="weight") -> DataFrame:
    keys = _keys(keys)
    return _drop_null_keys(df, keys).groupBy(*keys).agg(*labour_rate_exprs(category, weight))


def subgroup_totals(df: DataFrame, keys: Sequence[str], aggs: Sequence[Column],
                    all_label: str = ALL) -> DataFrame:
    """Every subset of ``keys`` in one pass (``cube``), with the rolled-up key
    shown as ``all_label`` and ``grouping_id`` kept (A20). Rows whose key is
    null in the data are dropped first so 'all' never mixes with a null group."""
    keys = list(keys)
    base = _drop_null_keys(df, keys)
    cubed = base.cube(*keys).agg(F.grouping_id(*keys).alias("gid"), *aggs)
    return cubed.select(*[F.coalesce(F.col(k).cast("string"), F.lit(all_label)).alias(k) for k in keys],
                        *[c for c in cubed.columns if c not in keys])


def cube_of_sums(df: DataFrame, keys: Sequence[str], sums: dict[str, Column], finish: dict[str, Column],
                 all_label: str = ALL) -> DataFrame:
    """Subgroup totals for ratio-of-sums indicators (A20, SURVEY §4.6).

    Sums are aggregated once at the finest key (partial aggregation, one
    shuffle), the small result is cubed, and ``finish`` expressions (ratios
    of the summed columns) are applied last - so rows are never multiplied by
    the 2^k grouping sets before they are combined."""
    keys = list(keys)
    fine = _drop_null_keys(df, keys).groupBy(*keys).agg(*[e.alias(n) for n, e in sums.items()])
    cubed = fine.cube(*keys).agg(F.grouping_id(*keys).alias("gid"), *[F.sum(n).alias(n) for n in sums])
    return cubed.select(*[F.coalesce(F.col(k).cast("string"), F.lit(all_label)).alias(k) for k in keys], "gid",
                        *[e.alias(n) for n, e in finish.items()])


def labour_rate_sums(category: str = "status_category", weight="weight") -> tuple[dict, dict]:
    """(sums, finish) for labour rates through ``cube_of_sums``."""
    w = _w(weight)
    cat = F.col(category)
    sums = {"_emp": F.sum(F.when(cat == "employed", w).otherwise(0.0)),
            "_unemp": F.sum(F.when(cat == "unemployed", w).otherwise(0.0)),
            "_tot": F.sum(w)}

    def safe(n, d):
        return F.coalesce(F.try_divide(n, F.when(d > 0, d)), F.lit(0.0))
    lf = F.col("_emp") + F.col("_unemp")
    finish = {"wpr": safe(F.col("_emp"), F.col("_tot")), "lfpr": safe(lf, F.col("_tot")),
              "ur": safe(F.col("_unemp"), lf)}
    return sums, finish


def mean_sums(values: dict[str, str], weight="weight") -> tuple[dict, dict]:
    """(sums, finish) for weighted means through ``cube_of_sums``."""
    w = _w(weight)
    sums, finish = {}, {}
    for out, v in values.items():
        c = F.col(v).cast("double")
        sums[f"_{out}_vw"] = F.sum(c * w)
        sums[f"_{out}_w"] = F.sum(F.when(c.isNotNull(), w))
        finish[out] = F.try_divide(F.col(f"_{out}_vw"), F.col(f"_{out}_w"))
    return sums, finish


def status_shares(workers: DataFrame, keys: Sequence[str], code: str = "status_code", weight="weight") -> DataFrame:
    """Shares of self-employed, regular and casual workers per group (I5-I8);
    rows with a null key are in no group."""
    w, status = _w(weight), F.col(code)

    def share(codes, name: str) -> Column:
        return F.try_divide(F.sum(F.when(status.isin(*codes), w).otherwise(0.0)), F.sum(w)).alias(name)
    kept = workers
    for k in keys:
        kept = kept.where(F.col(k).isNotNull())
    return kept.groupBy(*keys).agg(share(SELF_EMPLOYED_CODES, "self_employed"), share(REGULAR_CODES, "regular"),
                                   share(CASUAL_CODES, "casual"))


def arg_extreme(df: DataFrame, value: str, key: str = "state", by: Sequence[str] = (),
                largest: bool = True, name: str | None = None) -> DataFrame:
    """Key with the largest (or smallest) value per ``by`` group; null values
    excluded; ties -> smallest key (T2). One aggregate, no sort."""
    by = list(by)
    v = F.col(value)
    # min over struct(-v, key) picks max v then min key; min over (v, key) the min
    packed = F.struct((-v if largest else v).alias("o"), F.col(key).alias("k"), v.alias("v"))
    out = (df.where(v.isNotNull() & F.col(key).isNotNull()).groupBy(*by)
           .agg(F.min(packed).alias("_b")))
    name = name or ("argmax" if largest else "argmin")
    return out.select(*by, F.col("_b.k").alias(name), F.col("_b.v").alias(value))


def top_k(df: DataFrame, value: str, k: int, key: str = "state", ascending: bool = False) -> DataFrame:
    """Top-k rows by value (ties by key) (T3); plans as TakeOrderedAndProject,
    a bounded heap per task."""
    order = [F.col(value).asc() if ascending else F.col(value).desc(), F.col(key)]
    ranked = df.where(F.col(value).isNotNull()).orderBy(*order).limit(k)
    return ranked.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def coded_distribution(df: DataFrame, keys, code: str, codebook: DataFrame, prefix_len: int,
                       weight="weight", top_n: int | None = 5, digits: int | None = None,
                       compat: bool = False) -> DataFrame:
    """Distribution of coded values by label.

    Default: first ``prefix_len`` characters of the code (kept as a string, so
    leading zeros survive) -> label (unknown prefix passes through) -> A3.
    ``compat=True`` reproduces the older order of work: A3 on raw codes, then
    numeric prefix -> label, where colliding labels keep the last (lowest
    ranked) share."""
    keys = _keys(keys)
    if not compat:
        key = F.substring(F.col(code).cast("string"), 1, prefix_len)
        lab = lookup(df.withColumn("_pfx", key), codebook, {"code": F.col("_pfx")}, out="_label")
        lab = lab.withColumn("_label", F.coalesce(F.col("_label"), F.col("_pfx")))
        return weighted_distribution(lab, keys, "_label", weight, top_n=top_n, digits=digits)
    dist = weighted_distribution(df, keys, code, weight, top_n=top_n, digits=digits)
    pfx = F.when(F.col("rank") <= (top_n or 10 ** 9), numeric_prefix("category", prefix_len)).otherwise(F.col("category"))
    lab = lookup(dist.withColumn("_pfx", pfx), codebook, {"code": F.col("_pfx")}, out="_label")
    lab = lab.withColumn("category", F.coalesce(F.col("_label"), F.col("_pfx")))
    return (lab.groupBy(*keys, "category")
            .agg(F.max_by("share", "rank").alias("share"), F.max("rank").alias("rank"))
            .select(*keys, "category", "rank", "share"))


def pivot_gap(df: DataFrame, keys, pivot: str, value: str, a: str, b: str, name: str = "gap") -> DataFrame:
    """value[a] - value[b] per key after a pivot with fixed values (I4)."""
    keys = _keys(keys)
    wide = df.groupBy(*keys).pivot(pivot, [a, b]).agg(F.first(value))
    return wide.select(*keys, F.col(a).alias(f"{value}_{a}"), F.col(b).alias(f"{value}_{b}"),
                       (F.col(a) - F.col(b)).alias(name))


def ratio_per(df: DataFrame, keys, cond_num: Column, cond_den: Column, weight="weight",
              scale: float = 1000.0, name: str = "ratio") -> DataFrame:
    """scale * Σw[num] / Σw[den] per group, e.g. females per 1000 males (I16)."""
    keys = _keys(keys)
    w = _w(weight)
    num = F.sum(F.when(F.coalesce(cond_num, F.lit(False)), w).otherwise(0.0))
    den = F.sum(F.when(F.coalesce(cond_den, F.lit(False)), w).otherwise(0.0))
    return _drop_null_keys(df, keys).groupBy(*keys).agg(
        (F.lit(scale) * F.try_divide(num, F.when(den > 0, den))).alias(name))

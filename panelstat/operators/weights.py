"""Design weights (A1, A2) - row-level, narrow, codegen'd."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelstat.functions import _c


def design_weight_expr(multiplier="multiplier", nss="nss", nsc="nsc", quarters="quarters") -> Column:
    """mult/100/q when the two sub-sample counts agree, else mult/200/q (A1).

    A null count compares as not-equal and takes the /200 branch; a zero
    quarter count gives null instead of infinity."""
    m = _c(multiplier).cast("double")
    divisor = F.when(_c(nss) == _c(nsc), F.lit(100.0)).otherwise(F.lit(200.0))
    return F.try_divide(m / divisor, _c(quarters))


def with_design_weight(df: DataFrame, out: str = "weight", **cols) -> DataFrame:
    return df.withColumn(out, design_weight_expr(**cols))


def with_raw_weight(df: DataFrame, multiplier: str = "multiplier", out: str = "weight") -> DataFrame:
    """The raw multiplier, or 1.0 when the column is absent (A2)."""
    w = F.col(multiplier).cast("double") if multiplier in df.columns else F.lit(1.0)
    return df.withColumn(out, w)

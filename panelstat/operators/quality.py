"""Filters and validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelstat.functions import _c
from panelstat.sources.codebooks import RESPONSE_PHRASE, SURVEY_ORIGINAL


def valid_households(df: DataFrame, survey: str = "survey_code", response: str = "response_code") -> DataFrame:
    """Original surveyed households whose response contains the co-operation
    phrase, any case; a null response is dropped (F1)."""
    return df.where((F.col(survey) == SURVEY_ORIGINAL)
                    & F.lower(F.col(response)).contains(RESPONSE_PHRASE))


def prefix_filter(df: DataFrame, col: str, prefix: str) -> DataFrame:
    """Rows whose column starts with ``prefix``, case-insensitive."""
    return df.where(F.lower(F.col(col)).startswith(prefix.lower()))


def well_formed_heading(col) -> Column:
    """Heading holds an opening and a closing parenthesis."""
    return _c(col).rlike(r"\(.*\)")


def require_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Raise when a required column is absent (F5, column check)."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def quarantine_split(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(good, quarantine) by presence of every required field (F5, row check)."""
    require_columns(df, cols)
    ok = F.lit(True)
    for c in cols:
        ok = ok & F.col(c).isNotNull()
    flagged = df.withColumn("_ok", ok)
    return flagged.where("_ok").drop("_ok"), flagged.where(~F.col("_ok")).drop("_ok")


def with_quarantine_flag(df: DataFrame, cols: Sequence[str], name: str = "quarantined") -> DataFrame:
    require_columns(df, cols)
    bad = F.lit(False)
    for c in cols:
        bad = bad | F.col(c).isNull()
    return df.withColumn(name, bad)


def missing_keys(json_text, required: Sequence[str]) -> Column:
    """Required keys that a record's JSON text does not have, in their order.
    A key whose value is null is present. Text that is no JSON object lacks all."""
    keys = F.coalesce(F.json_object_keys(_c(json_text)), F.array().cast("array<string>"))
    return F.array_except(F.array(*[F.lit(k) for k in required]), keys)


def require_keys(df: DataFrame, json_text: str, required: Sequence[str]) -> DataFrame:
    """All rows, or an error at run time that names the first record's missing keys (F5, strict)."""
    missing = missing_keys(json_text, required)
    ok = F.when(F.size(missing) > 0, F.raise_error(F.concat(F.lit("missing fields: "), F.array_join(missing, ", "))).cast("boolean"))
    return df.where(ok.isNull())


def split_by_keys(df: DataFrame, json_text: str, required: Sequence[str], name: str = "missing") -> tuple[DataFrame, DataFrame]:
    """(records with all keys, the others with their missing keys) (F5, lenient)."""
    flagged = df.withColumn(name, missing_keys(json_text, required))
    return flagged.where(F.size(name) == 0).drop(name), flagged.where(F.size(name) > 0)


def url_ok(col) -> Column:
    """Text starts with 'http' (F6)."""
    return _c(col).startswith("http")


def in_range_or_null(col, lo: int, hi: int) -> Column:
    """Lenient domain check: out-of-range -> null."""
    c = _c(col)
    return F.when((c >= lo) & (c <= hi), c)


def in_range_or_fail(col, lo: int, hi: int, what: str = "value") -> Column:
    """Strict domain check: out-of-range raises at run time."""
    c = _c(col)
    return F.when((c >= lo) & (c <= hi), c).otherwise(
        F.raise_error(F.concat(F.lit(f"{what} out of range ({lo}-{hi}): "), c.cast("string"))))

"""Codebooks as small DataFrames.

Operators never hard-wire a codebook: they take a ``(code, label)`` (or
``(context, code, label)``) DataFrame. The built-ins below are tiny and fixed,
so broadcasting them is bounded by construction. Larger codebooks (industry,
occupation, district, region) are read from files with the readers in
``panelstat.sources.readers`` or derived from data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the survey's published code lists.
# Household type by sector (rural and urban use different code lists; any
# other code decodes to "others").
HOUSEHOLD_TYPE = [
    ("rural", "1", "self-employed in agriculture"),
    ("rural", "2", "self-employed in non-agriculture"),
    ("rural", "3", "regular wage/salary earning"),
    ("rural", "4", "casual labour in agriculture"),
    ("rural", "5", "casual labour in non-agriculture"),
    ("rural", "9", "others"),
    ("urban", "1", "self-employed"),
    ("urban", "2", "regular wage/salary earning"),
    ("urban", "3", "casual labour"),
    ("urban", "9", "others"),
]
HOUSEHOLD_TYPE_DEFAULT = "others"

# Activity status codes, their labels and their labour-force category.
STATUS = [
    ("11", "worked in h.h. enterprise (self-employed): own account worker", "employed"),
    ("12", "worked in h.h. enterprise (self-employed): employer", "employed"),
    ("21", "worked as helper in h.h. enterprise (unpaid family worker)", "employed"),
    ("31", "worked as regular salaried/wage employee", "employed"),
    ("41", "worked as casual wage labour: in public works", "employed"),
    ("51", "worked as casual wage labour: in other types of work", "employed"),
    ("81", "did not work but was seeking and/or available for work", "unemployed"),
    ("91", "attended educational institution", "not_in_labor_force"),
    ("92", "attended domestic duties only", "not_in_labor_force"),
    ("93", "attended domestic duties and was also engaged in free collection of goods "
           "(vegetables, roots, firewood, cattle feed, etc.), sewing, tailoring, weaving, "
           "etc. for household use", "not_in_labor_force"),
    ("94", "rentiers, pensioners, remittance recipients, etc.", "not_in_labor_force"),
    ("95", "not able to work due to disability", "not_in_labor_force"),
    ("97", "others (including begging, prostitution, etc.)", "not_in_labor_force"),
]
STATUS_DEFAULT_CATEGORY = "unknown"

# Worker classes used by the status-share questions.
SELF_EMPLOYED_CODES = ("11", "12", "21")
REGULAR_CODES = ("31",)
CASUAL_CODES = ("41", "51")

# Quarter and visit enums; unknown values pass through unchanged.
QUARTER = [("Q1", "Quarter 1"), ("Q2", "Quarter 2"), ("Q3", "Quarter 3"), ("Q4", "Quarter 4")]
VISIT = [("V1", "Visit 1"), ("V2", "Visit 2"), ("V3", "Visit 3"), ("V4", "Visit 4")]

# Validity of a surveyed household.
SURVEY_ORIGINAL = "household surveyed: original"
RESPONSE_PHRASE = "co-operative and capable"

# Age bands: left-closed [lo, hi); None = open end.
AGE_BANDS = [("0-14", None, 15), ("15-29", 15, 30), ("30-59", 30, 60), ("60+", 60, None)]

# Default ministry when a record names none; district miss label.
DEFAULT_MINISTRY = "Ministry of Power"
UNKNOWN_DISTRICT = "UNKNOWN_DISTRICT"
# ---------------------------------------------------------------------------


def literal_table(spark: SparkSession, rows, names: list[str]) -> DataFrame:
    """A small constant table built JVM-side (``inline`` of a literal array),
    so no Python worker is involved and its size is fixed by construction."""
    structs = [F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names)]) for r in rows]
    return bounded(spark.range(1).select(F.inline(F.array(*structs))), len(rows))


def bounded(df: DataFrame, max_rows: int) -> DataFrame:
    """Mark a DataFrame whose row count is bounded by construction, so lookups
    may broadcast it without a counting job."""
    df._panelstat_max_rows = max_rows
    return df


def household_type_codebook(spark: SparkSession) -> DataFrame:
    return literal_table(spark, HOUSEHOLD_TYPE, ["sector", "code", "label"])


def status_codebook(spark: SparkSession) -> DataFrame:
    return literal_table(spark, STATUS, ["code", "label", "category"])


def map_literal(pairs) -> "F.Column":
    """A ``map<string,string>`` literal for a bounded code list (no join at all)."""
    flat = []
    for k, v in pairs:
        flat += [F.lit(k), F.lit(v)]
    return F.create_map(*flat)

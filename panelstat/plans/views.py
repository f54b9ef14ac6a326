"""Survey views bound to the driver tables.

The survey microdata itself is not public, so household and person records
are derived from the order/customer/lineitem tables by fixed rules. The same
rules are written twice: as Spark column expressions (what the library runs)
and as DuckDB SQL (what the correctness oracle runs). Keep them in step.

Scale notes: households come from orders ⋈ customer (a shuffle join the
planner sizes; nation is tiny and auto-broadcast), persons from lineitem ⋈
orders on the order key. Only the columns each query needs survive column
pruning down to the Parquet scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelstat.operators.weights import design_weight_expr
from panelstat.sources.codebooks import HOUSEHOLD_TYPE, household_type_codebook
from panelstat.operators.lookups import decode_household_type

STATUS_CODES = ["11", "12", "21", "31", "41", "51", "81", "91", "92", "93", "94", "95", "97"]
EDUCATION = ["not literate", "literate without formal schooling", "below primary", "primary",
             "secondary", "graduate and above"]
MARITAL = ["never married", "currently married", "widowed", "divorced/separated"]
TECHNICAL = ["no technical education", "technical degree", "diploma or certificate"]
SOCIAL = {"F": "others", "O": "other backward class"}
SOCIAL_ELSE = "scheduled caste"


_TABLES: dict[tuple, DataFrame] = {}


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores where a scan has fewer splits than these: a file of
    one row group is one task, however many splits it has. Larger inputs
    have more splits and stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores, however many splits there are: those of a large file of
    one row group are many, and one of them has all rows. For work on each row
    that costs more than shuffling it."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A source table, opened once per session (file listing and footer
    schema are read once; every query still scans the files)."""
    key = (id(spark), spark.sparkContext.applicationId, sf_dir, name)
    if key not in _TABLES:
        _TABLES[key] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return _TABLES[key]


def _case_mod(key: Column, values: list[str]) -> Column:
    """values[key % len(values)] as a CASE chain (same text in the SQL)."""
    n = len(values)
    m = key % n
    expr = F.when(m == 0, F.lit(values[0]))
    for i, v in enumerate(values[1:], start=1):
        expr = expr.when(m == i, F.lit(v))
    return expr


def _sql_case_mod(key: str, values: list[str]) -> str:
    n = len(values)
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE ({key}) % {n} {arms} END"


# --------------------------------------------------------------------------- households


def household_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    ok, ck = F.col("o_orderkey"), F.col("o_custkey")
    return j.select(
        ok.alias("hh_id"),
        F.col("n_name").alias("state"),
        (ck % 30 + 1).cast("string").alias("district_code"),
        (F.col("c_nationkey") % 7).cast("string").alias("region_code"),
        F.when(ok % 2 == 0, "urban").otherwise("rural").alias("sector"),
        (ck % 8 + 1).cast("double").alias("household_size"),
        F.when(ck % 6 == 5, "9").otherwise((ck % 6 + 1).cast("string")).alias("hh_type_code"),
        F.lower(F.col("c_mktsegment")).alias("religion"),
        F.when(F.col("o_orderstatus") == "F", SOCIAL["F"]).when(F.col("o_orderstatus") == "O", SOCIAL["O"])
         .otherwise(SOCIAL_ELSE).alias("social_group"),
        F.when(ok % 17 == 0, F.lit(None).cast("double")).otherwise(F.col("o_totalprice")).alias("expenditure"),
        F.when(ok % 11 == 0, "household surveyed: substitute").otherwise("household surveyed: original")
         .alias("survey_code"),
        F.when(ok % 5 == 0, F.lit(None).cast("string")).when(ok % 5 == 1, "Co-operative and capable")
         .when(ok % 5 == 2, "co-operative but not capable").when(ok % 5 == 3, "CO-OPERATIVE AND CAPABLE")
         .otherwise("busy").alias("response_code"),
        (ck % 900 + 100).cast("double").alias("multiplier"),
        F.when(ok % 13 == 0, F.lit(None).cast("bigint")).otherwise(ok % 3 + 1).alias("nss"),
        (ck % 3 + 1).alias("nsc"),
        (ok % 4 + 1).alias("quarters"),
        F.concat(F.lit("Q"), (ok % 5 + 1).cast("string")).alias("quarter"),
        F.concat(F.lit("V"), (ck % 5 + 1).cast("string")).alias("visit"),
        F.when(ok % 4 < 2, "first_visit").otherwise("revisit").alias("panel"),
    )


HOUSEHOLD_RAW_SQL = """
SELECT o.o_orderkey AS hh_id, n.n_name AS state,
  CAST(o.o_custkey % 30 + 1 AS VARCHAR) AS district_code,
  CAST(c.c_nationkey % 7 AS VARCHAR) AS region_code,
  CASE WHEN o.o_orderkey % 2 = 0 THEN 'urban' ELSE 'rural' END AS sector,
  CAST(o.o_custkey % 8 + 1 AS DOUBLE) AS household_size,
  CASE WHEN o.o_custkey % 6 = 5 THEN '9' ELSE CAST(o.o_custkey % 6 + 1 AS VARCHAR) END AS hh_type_code,
  lower(c.c_mktsegment) AS religion,
  CASE WHEN o.o_orderstatus = 'F' THEN 'others' WHEN o.o_orderstatus = 'O' THEN 'other backward class'
       ELSE 'scheduled caste' END AS social_group,
  CASE WHEN o.o_orderkey % 17 = 0 THEN NULL ELSE o.o_totalprice END AS expenditure,
  CASE WHEN o.o_orderkey % 11 = 0 THEN 'household surveyed: substitute' ELSE 'household surveyed: original' END AS survey_code,
  CASE WHEN o.o_orderkey % 5 = 0 THEN NULL WHEN o.o_orderkey % 5 = 1 THEN 'Co-operative and capable'
       WHEN o.o_orderkey % 5 = 2 THEN 'co-operative but not capable' WHEN o.o_orderkey % 5 = 3 THEN 'CO-OPERATIVE AND CAPABLE'
       ELSE 'busy' END AS response_code,
  CAST(o.o_custkey % 900 + 100 AS DOUBLE) AS multiplier,
  CASE WHEN o.o_orderkey % 13 = 0 THEN NULL ELSE o.o_orderkey % 3 + 1 END AS nss,
  o.o_custkey % 3 + 1 AS nsc,
  o.o_orderkey % 4 + 1 AS quarters,
  'Q' || CAST(o.o_orderkey % 5 + 1 AS VARCHAR) AS quarter,
  'V' || CAST(o.o_custkey % 5 + 1 AS VARCHAR) AS visit,
  CASE WHEN o.o_orderkey % 4 < 2 THEN 'first_visit' ELSE 'revisit' END AS panel
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
"""

WEIGHT_SQL = ("CASE WHEN nss = nsc THEN multiplier / 100.0 / quarters "
              "ELSE multiplier / 200.0 / quarters END")


def _household_type_values_sql() -> str:
    rows = ", ".join(f"('{s}', '{c}', '{l}')" for s, c, l in HOUSEHOLD_TYPE)
    return f"(VALUES {rows}) AS ht(sector, code, label)"


def households(spark: SparkSession, sf_dir: str, valid_only: bool = True) -> DataFrame:
    """Decoded, weighted household view (``household_v``)."""
    from panelstat.operators.quality import valid_households
    raw = household_raw(spark, sf_dir)
    raw = decode_household_type(raw, household_type_codebook(spark))
    if valid_only:
        raw = valid_households(raw)
    return raw.withColumn("weight", design_weight_expr())


HOUSEHOLD_SQL = f"""
SELECT h.*, coalesce(ht.label, 'others') AS household_type, {WEIGHT_SQL} AS weight
FROM ({HOUSEHOLD_RAW_SQL}) h LEFT JOIN {_household_type_values_sql()}
  ON ht.sector = h.sector AND ht.code = h.hh_type_code
WHERE h.survey_code = 'household surveyed: original'
  AND contains(lower(h.response_code), 'co-operative and capable')
"""

# --------------------------------------------------------------------------- persons


def person_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    # Resolve each order's state first (orders-sized joins), then join
    # lineitem once on the order key: a single lineitem-sized shuffle, and the
    # result stays partitioned by hh_id for person x household joins.
    order_state = (o.join(c, F.col("o_custkey") == c.c_custkey).join(n, F.col("c_nationkey") == n.n_nationkey)
                   .select("o_orderkey", "n_name"))
    j = li.join(order_state, li.l_orderkey == order_state.o_orderkey)
    lo, lp, ls, ln = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    status = _case_mod(lp, STATUS_CODES)
    edu = _case_mod(lo, EDUCATION)
    base = j.select(
        lo.alias("hh_id"), ln.alias("person_no"),
        F.col("n_name").alias("state"),
        F.when(F.col("l_linestatus") == "O", "urban").otherwise("rural").alias("sector"),
        F.when(F.col("l_returnflag") == "N", "male").otherwise("female").alias("gender"),
        F.when(ln == 7, F.lit(None).cast("double"))
         .otherwise(F.col("l_quantity") + (lp % 31).cast("double")).alias("age"),
        status.alias("status_code"),
        F.concat(F.lpad((ls % 99 + 1).cast("string"), 2, "0"), F.lpad((lp % 1000).cast("string"), 3, "0"))
         .alias("industry_code"),
        (lp % 900 + 100).cast("string").alias("occupation_code"),
        edu.alias("general_education"),
        _case_mod(lo, MARITAL).alias("marital_status"),
        _case_mod(ls, TECHNICAL).alias("technical_education"),
        F.when(lo % 6 == 0, F.lit(None).cast("double")).otherwise(((lo % 6) * 3).cast("double"))
         .alias("years_formal_education"),
        F.when(ln % 4 == 0, F.lit(None).cast("string")).when(ln % 4 == 1, "received formal vocational training")
         .when(ln % 4 == 2, "did not receive any").otherwise("Yes, non-formal").alias("vocational_training"),
        F.when(status == "31", F.col("l_extendedprice")).alias("regular_earning"),
        F.when(status.isin("11", "12", "21"), F.col("l_extendedprice") * F.col("l_tax")).alias("self_employed_earning"),
        F.when(status.isin("41", "51"), F.col("l_extendedprice") * F.col("l_discount")).alias("casual_wage"),
        F.when(ln == 6, F.lit("")).otherwise((ls % 30 + 1).cast("string")).alias("district_code"),
        ((lp + ls) % 900 + 100).cast("double").alias("multiplier"),
        (lo % 3 + 1).alias("nss"),
        (ls % 3 + 1).alias("nsc"),
        (ln % 4 + 1).alias("quarters"),
        F.when(lo % 2 == 0, "first_visit").otherwise("revisit").alias("panel"),
    )
    return base


PERSON_RAW_SQL = f"""
SELECT l.l_orderkey AS hh_id, l.l_linenumber AS person_no, n.n_name AS state,
  CASE WHEN l.l_linestatus = 'O' THEN 'urban' ELSE 'rural' END AS sector,
  CASE WHEN l.l_returnflag = 'N' THEN 'male' ELSE 'female' END AS gender,
  CASE WHEN l.l_linenumber = 7 THEN NULL ELSE l.l_quantity + CAST(l.l_partkey % 31 AS DOUBLE) END AS age,
  {_sql_case_mod('l.l_partkey', STATUS_CODES)} AS status_code,
  lpad(CAST(l.l_suppkey % 99 + 1 AS VARCHAR), 2, '0') || lpad(CAST(l.l_partkey % 1000 AS VARCHAR), 3, '0') AS industry_code,
  CAST(l.l_partkey % 900 + 100 AS VARCHAR) AS occupation_code,
  {_sql_case_mod('l.l_orderkey', EDUCATION)} AS general_education,
  {_sql_case_mod('l.l_orderkey', MARITAL)} AS marital_status,
  {_sql_case_mod('l.l_suppkey', TECHNICAL)} AS technical_education,
  CASE WHEN l.l_orderkey % 6 = 0 THEN NULL ELSE CAST((l.l_orderkey % 6) * 3 AS DOUBLE) END AS years_formal_education,
  CASE WHEN l.l_linenumber % 4 = 0 THEN NULL WHEN l.l_linenumber % 4 = 1 THEN 'received formal vocational training'
       WHEN l.l_linenumber % 4 = 2 THEN 'did not receive any' ELSE 'Yes, non-formal' END AS vocational_training,
  l.l_extendedprice AS _price, l.l_tax AS _tax, l.l_discount AS _disc,
  CASE WHEN l.l_linenumber = 6 THEN '' ELSE CAST(l.l_suppkey % 30 + 1 AS VARCHAR) END AS district_code,
  CAST((l.l_partkey + l.l_suppkey) % 900 + 100 AS DOUBLE) AS multiplier,
  l.l_orderkey % 3 + 1 AS nss,
  l.l_suppkey % 3 + 1 AS nsc,
  l.l_linenumber % 4 + 1 AS quarters,
  CASE WHEN l.l_orderkey % 2 = 0 THEN 'first_visit' ELSE 'revisit' END AS panel
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
"""

PERSON_SQL = f"""
SELECT * EXCLUDE (_price, _tax, _disc),
  CASE WHEN status_code = '31' THEN _price END AS regular_earning,
  CASE WHEN status_code IN ('11', '12', '21') THEN _price * _tax END AS self_employed_earning,
  CASE WHEN status_code IN ('41', '51') THEN _price * _disc END AS casual_wage,
  {WEIGHT_SQL} AS weight
FROM ({PERSON_RAW_SQL}) p
"""


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted person view (``person_v``). Persons are not validity-filtered."""
    return person_raw(spark, sf_dir).withColumn("weight", design_weight_expr())


def by_panel(df: DataFrame, panels: dict[str, str]) -> DataFrame:
    """The rows of one panel per sector."""
    keep = F.lit(False)
    for sector, panel in panels.items():
        keep = keep | ((F.col("sector") == sector) & (F.col("panel") == panel))
    return df.where(keep)


def panel_sql(panels: dict[str, str]) -> str:
    return " OR ".join(f"(sector = '{s}' AND panel = '{p}')" for s, p in panels.items())


def with_views(sql: str, households_where: str = "TRUE", persons_where: str = "TRUE") -> str:
    """Prefix an oracle query with the household/person CTEs."""
    return (f"WITH household_v AS (SELECT * FROM ({HOUSEHOLD_SQL}) hv WHERE {households_where}),\n"
            f"person_v AS (SELECT * FROM ({PERSON_SQL}) pv WHERE {persons_where})\n{sql}")

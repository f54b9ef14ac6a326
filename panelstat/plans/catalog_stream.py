"""Registered streaming queries (ST1-ST3).

The person records stream from the lineitem Parquet file through the file
source; the decode (status code -> label and labour-force category via map
literals, industry prefix -> label via a stream-static broadcast join with a
bounded codebook, blank -> null) runs per micro-batch; the sink is read back
as a table and summarised so the oracle can check every row landed.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from panelstat.operators import lookups as lk
from panelstat.operators import schema as sc
from panelstat.plans.catalog_survey import INDUSTRY_SQL, industry_codebook
from panelstat.plans.registry import register
from panelstat.plans.views import STATUS_CODES, _case_mod, _sql_case_mod
from panelstat.sources import codebooks as cb
from panelstat.session import shared_path
from panelstat.sources.readers import read_stream_records
from panelstat.sources.sinks import write_records
from panelstat.streaming.decode import decode_stream, progress, run_available, with_progress

_CAT = [(c, cat) for c, _, cat in cb.STATUS]


def decode_persons(df, industry):
    """Batch-or-stream decode of raw lineitem-shaped person rows."""
    status = _case_mod(F.col("l_partkey"), STATUS_CODES)
    raw = df.select("l_orderkey", "l_linenumber",
                    status.alias("status_code"),
                    F.concat(F.lpad((F.col("l_suppkey") % 99 + 1).cast("string"), 2, "0"),
                             F.lpad((F.col("l_partkey") % 1000).cast("string"), 3, "0")).alias("industry_code"),
                    F.when(F.col("l_linenumber") == 6, F.lit("")).otherwise(F.col("l_returnflag")).alias("flag"))
    out = raw.withColumn("status_category", F.coalesce(F.element_at(cb.map_literal(_CAT), F.col("status_code")),
                                                       F.lit(cb.STATUS_DEFAULT_CATEGORY)))
    out = lk.decode_prefix(out, industry, "industry_code", "industry", 2)
    return sc.blank_to_null(out, exclude=["industry_code", "status_code"])


@register("decode_stream", f"""
SELECT coalesce(CASE {_sql_case_mod('l_partkey', STATUS_CODES)} {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _CAT)} END,
                'unknown') AS status_category,
  i.label AS industry, count(*) AS n, count(nullif(CASE WHEN l_linenumber = 6 THEN '' ELSE l_returnflag END, '')) AS n_flag
FROM lineitem l LEFT JOIN {INDUSTRY_SQL} i ON i.code = lpad(CAST(l_suppkey % 99 + 1 AS VARCHAR), 2, '0')
GROUP BY 1, 2""")
def q_decode_stream(spark, sf_dir):
    """The rows land as JSON lines, as many files as the scan has tasks; the
    stream reads them a few files at a time."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag")
    landed = shared_path(spark, "landed-lineitem")
    write_records(rows, landed)
    stream = read_stream_records(spark, landed, rows.schema, max_files=64)
    decoded = decode_stream(stream, lambda d: decode_persons(d, industry_codebook(spark)))
    out = spark.read.schema(decoded.schema).parquet(run_available(decoded, "decode"))
    return out.groupBy("status_category", "industry").agg(F.count(F.lit(1)).alias("n"),
                                                           F.count("flag").alias("n_flag"))


def stream_table(spark, sf_dir, name):
    """A stream of the table's files, be it one file or a folder of parts: the
    pattern matches either, and a folder is listed."""
    path = f"{sf_dir}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/{name}.parque[t]")


@register("projection_stream", """
SELECT l_orderkey AS hh_id, l_linenumber AS person_no, l_returnflag AS flag FROM lineitem""")
def q_projection_stream(spark, sf_dir):
    stream = stream_table(spark, sf_dir, "lineitem")
    proj = sc.select_and_rename(stream, ["l_orderkey", "l_linenumber", "no_such_col", "l_returnflag"],
                                {"l_orderkey": "hh_id", "l_linenumber": "person_no", "l_returnflag": "flag"})
    return spark.read.schema(proj.schema).parquet(run_available(with_progress(proj), "project"))


@register("stream_progress", """
SELECT count(*) AS rows, CAST(12 AS BIGINT) AS batches, count(*) AS total FROM customer""")
def q_stream_progress(spark, sf_dir):
    """ST3: a row per micro-batch in the progress table, whose total is the input."""
    landed = shared_path(spark, "landed-customers")
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name")
    rows.repartitionByRange(12, "c_custkey").write.json(landed)
    stream = with_progress(read_stream_records(spark, landed, rows.schema, max_files=1))
    run_available(stream, "customers")
    return progress(spark, "customers").agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("batches"),
                                            F.max("total").alias("total"))

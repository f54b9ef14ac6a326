"""Registered round trips of the sources and sinks (S1-S15, F4, F7, P7, T4, T5,
E7): the driver's tables are written to the shared folder in each format and
read back by the reader under test."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelstat.operators import evaluation as ev
from panelstat.operators import quality as qa
from panelstat.operators import records as rec
from panelstat.operators import schema as sc
from panelstat.plans.catalog_eval import SCORED_SQL, eval_items
from panelstat.plans.catalog_profile import PROFILE_SQL, industry_codebook, occupation_codebook
from panelstat.plans.profile import state_profile
from panelstat.plans.registry import r6, register, sql_r6
from panelstat.plans.views import households, persons, spread, table, with_views
from panelstat.session import shared_path
from panelstat.sources import readers, sinks
from panelstat.streaming.decode import run_available

_CUSTOMER = ["c_custkey", "c_name", "c_mktsegment", "c_acctbal"]
_CUSTOMER_DDL = "c_custkey long, c_name string, c_mktsegment string, c_acctbal double"
_CUSTOMER_SQL = f"SELECT {', '.join(_CUSTOMER)} FROM customer"


def _customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(*_CUSTOMER)


@register("records_json_lines", _CUSTOMER_SQL)
def q_records_json_lines(spark, sf_dir):
    """S12 written, S2 and S8 read: JSON lines are recognised."""
    path = shared_path(spark, "customers") + ".json"
    sinks.write_records(_customers(spark, sf_dir), path)
    return readers.read_any(spark, path, _CUSTOMER_DDL)


@register("records_json_array", _CUSTOMER_SQL)
def q_records_json_array(spark, sf_dir):
    """S1 and S2 on records that span lines: arrays of pretty-printed objects, an
    array for each part of the table."""
    path = shared_path(spark, "customers") + ".json"
    sinks.write_array(_customers(spark, sf_dir).repartition(8, "c_custkey"), path, pretty=True)
    return readers.read_records_auto(spark, path, _CUSTOMER_DDL).select(*_CUSTOMER)


_LINE = ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "note"]
_LINE_DDL = "l_orderkey long, l_linenumber long, l_quantity double, l_returnflag string, note string"


def _lines_with_notes(spark, sf_dir):
    note = F.when(F.col("l_orderkey") % 9 == 0, F.lit(None)).when(
        F.col("l_orderkey") % 9 == 1, F.lit('says "hi", [1, 2] { \u00e9')).otherwise(F.lit("plain"))
    return table(spark, sf_dir, "lineitem").select(*_LINE[:-1], note.alias("note")).withColumns(
        {c: F.col(c).cast("long") for c in _LINE[:2]})


_LINE_SQL = """SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(l_quantity AS DOUBLE) AS l_quantity,
  l_returnflag, CASE l_orderkey % 9 WHEN 0 THEN NULL WHEN 1 THEN 'says "hi", [1, 2] { \u00e9' ELSE 'plain' END AS note FROM lineitem"""


@register("json_array_items", _LINE_SQL)
def q_json_array_items(spark, sf_dir):
    """S3: arrays read record by record, several tasks to a file."""
    path = shared_path(spark, "lines-array")
    sinks.write_array(_lines_with_notes(spark, sf_dir).coalesce(2), path)
    return readers.read_array_items(spark, path, _LINE_DDL)


@register("json_array_stream", f"SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS quantity FROM ({_LINE_SQL}) l GROUP BY 1")
def q_json_array_stream(spark, sf_dir):
    """S3 and ST1: the same items through a stream of files."""
    path = shared_path(spark, "lines-arrays")
    sinks.write_array(_lines_with_notes(spark, sf_dir).repartition(6, "l_orderkey"), path, pretty=True)
    stream = readers.read_stream_array_items(spark, path, _LINE_DDL, max_files=2)
    out = spark.read.schema(stream.schema).parquet(run_available(stream, "array-items"))
    return out.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


@register("json_array_pieces", """
SELECT c_custkey % 10 = 3 AS bad, count(*) AS records, count(DISTINCT c_custkey) AS customers FROM customer GROUP BY 1""")
def q_json_array_pieces(spark, sf_dir):
    """S3: records with a nested object or a brace in a string are quarantined."""
    path = shared_path(spark, "nested-array")
    k = F.col("c_custkey")
    nested = F.concat(F.lit('{"c_custkey": '), k.cast("string"), F.lit(', "c_name": {"first": "x", "id": '), k.cast("string"), F.lit("}}"))
    flat = F.concat(F.lit('{"c_custkey": '), k.cast("string"), F.lit(', "c_name": "n"}'))
    text = F.when(k % 10 == 3, nested).otherwise(flat)
    table(spark, sf_dir, "customer").select(F.concat(text, F.lit(",")).alias("value")).write.text(path)
    got = readers.read_array_items(spark, path, "c_custkey long, c_name string", quarantine="piece")
    # a nested record leaves two pieces: its own and the brace that closes it
    key = F.coalesce("c_custkey", F.regexp_extract("piece", r'"c_custkey": (\d+)', 1).try_cast("long"))
    found = got.select(F.col("piece").isNotNull().alias("bad"), key.alias("key")).where("key is not null")
    return found.groupBy("bad").agg(F.count(F.lit(1)).alias("records"), F.count_distinct("key").alias("customers"))


@register("json_lines_broken", """
SELECT CASE WHEN c_custkey % 1000 <> 7 THEN c_custkey END AS c_custkey, CASE WHEN c_custkey % 1000 <> 7 THEN c_name END AS c_name,
  CASE WHEN c_custkey % 1000 = 7 THEN '{"c_custkey":' || CAST(c_custkey AS VARCHAR) || ',"c_na' END AS broken FROM customer""")
def q_json_lines_broken(spark, sf_dir):
    """Broken lines among records go to quarantine, never become rows of nulls."""
    path = shared_path(spark, "broken-lines") + ".json"
    k = F.col("c_custkey")
    line = F.to_json(F.struct("c_custkey", "c_name"))
    cut = F.concat(F.lit('{"c_custkey":'), k.cast("string"), F.lit(',"c_na'))
    table(spark, sf_dir, "customer").select(F.when(k % 1000 == 7, cut).otherwise(line).alias("value")).write.text(path)
    return readers.read_records_auto(spark, path, "c_custkey long, c_name string", quarantine="broken")


@register("missing_keys", """
SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 AND c_custkey % 5 = 0 THEN 'c_name, c_mktsegment' WHEN c_custkey % 7 = 0 THEN 'c_name'
  WHEN c_custkey % 5 = 0 THEN 'c_mktsegment' END AS missing, c_custkey % 3 = 0 OR c_custkey % 7 = 0 AS unnamed FROM customer""")
def q_missing_keys(spark, sf_dir):
    """F5 per record: a key that is absent is missing, one that is null is not."""
    path = shared_path(spark, "records-with-gaps") + ".json"
    k = F.col("c_custkey")
    text = F.concat(F.lit('{"c_custkey":'), k.cast("string"),
                    F.when(k % 7 == 0, F.lit("")).when(k % 3 == 0, F.lit(',"c_name":null')).otherwise(F.lit(',"c_name":"x"')),
                    F.when(k % 5 == 0, F.lit("")).otherwise(F.lit(',"c_mktsegment":"s"')), F.lit("}"))
    table(spark, sf_dir, "customer").select(text.alias("value")).write.text(path)
    whole, gaps = qa.split_by_keys(spark.read.text(path), "value", ["c_custkey", "c_name", "c_mktsegment"])
    both = whole.withColumn("missing", F.lit(None).cast("string")).unionByName(gaps.withColumn("missing", F.array_join("missing", ", ")))
    record = F.from_json("value", "c_custkey long, c_name string")
    return both.select(record["c_custkey"].alias("c_custkey"), "missing", record["c_name"].isNull().alias("unnamed"))


@register("csv_records", _CUSTOMER_SQL.replace("c_acctbal", "round(c_acctbal, 2) AS c_acctbal"))
def q_csv_records(spark, sf_dir):
    """S14 written, S4 read."""
    path = shared_path(spark, "customers-csv")
    sinks.write_csv(_customers(spark, sf_dir).withColumn("c_acctbal", F.round("c_acctbal", 2)), path)
    return readers.read_csv_records(spark, path, _CUSTOMER, _CUSTOMER_DDL)


@register("csv_tolerant", """
SELECT CAST(c_custkey AS VARCHAR) AS a, CASE WHEN c_custkey % 5 <> 1 THEN c_mktsegment END AS b,
  CASE WHEN c_custkey % 5 NOT IN (1, 2) THEN 'x' END AS c FROM customer WHERE c_custkey % 5 <> 0""")
def q_csv_tolerant(spark, sf_dir):
    """Lines with a cell too many go, lines with cells too few are padded."""
    k = F.col("c_custkey")
    line = F.concat_ws(",", k.cast("string"), F.when(k % 5 != 1, F.col("c_mktsegment")),
                       F.when(~(k % 5).isin(1, 2), F.lit("x")), F.when(k % 5 == 0, F.lit("extra")))
    path = shared_path(spark, "ragged-csv")
    _customers(spark, sf_dir).select(line.alias("value")).write.text(path)
    header = "a string, b string, c string"
    # the written parts have no header line of their own
    return _headless(spark, path, header)


def _headless(spark, path, ddl):
    """The tolerant reader over files that start with a header line each."""
    names = ",".join(f.split()[0] for f in ddl.split(", "))
    landed = shared_path(spark, "ragged-csv-with-header")
    whole = spark.read.text(path, wholetext=True).select(F.concat(F.lit(names + "\n"), F.rtrim("value")).alias("value"))
    whole.write.text(landed)
    return readers.read_csv_records(spark, landed, ["a", "b", "c"], ddl, tolerant=True)


@register("codebook_csv", """
SELECT CAST(c_nationkey AS VARCHAR) AS code, 'last ' || CAST(max(c_custkey) AS VARCHAR) AS label
FROM customer GROUP BY c_nationkey""")
def q_codebook_csv(spark, sf_dir):
    """Banner rows go, codes are trimmed before the last one wins."""
    k = F.col("c_custkey")
    code = F.when(k % 2 == 0, F.concat(F.lit(" "), F.col("c_nationkey").cast("string"))).otherwise(
        F.col("c_nationkey").cast("string"))
    rows = table(spark, sf_dir, "customer").select(k, F.concat(code, F.lit(",last "), k.cast("string")).alias("value"))
    banner = spark.range(1).select(F.lit(-1).cast("long").alias("c_custkey"), F.lit("Code,Label").alias("value"))
    path = shared_path(spark, "codebook-csv")
    rows.unionByName(banner).repartitionByRange(3, "c_custkey").sortWithinPartitions("c_custkey").select("value").write.text(path)
    return readers.read_codebook_csv(spark, path)


@register("codebook_json", "SELECT CAST(n_nationkey AS VARCHAR) AS code, n_name AS label FROM nation")
def q_codebook_json(spark, sf_dir):
    pairs = F.map_from_entries(F.collect_list(F.struct(F.col("n_nationkey").cast("string"), "n_name")))
    path = shared_path(spark, "codebook-json")
    table(spark, sf_dir, "nation").agg(F.to_json(pairs).alias("value")).write.text(path)
    return readers.read_codebook_json(spark, path)


@register("read_documents", """
SELECT md5(html || chr(10)) AS digest, length(html) + 1 AS n, count(*) AS files FROM pages GROUP BY 1, 2""")
def q_read_documents(spark, sf_dir):
    """One text file per page, read whole, in the order of the names."""
    path = shared_path(spark, "page-files")
    sinks.write_files(spread(table(spark, sf_dir, "pages").select(F.lit("part").alias("name"), F.col("html").alias("value"))), path)
    docs = readers.file_order(readers.read_documents(spark, path), "file")
    return docs.groupBy(F.md5(F.col("text").cast("binary")).alias("digest"), F.length("text").cast("long").alias("n")).agg(
        F.count(F.lit(1)).alias("files"))


@register("valid_files", """
SELECT 'page-' || CAST(page_id AS VARCHAR) AS name, page_id % 4 <> 1 AS ok FROM pages""")
def q_valid_files(spark, sf_dir):
    """A file per page, some without the signature."""
    path = shared_path(spark, "signed-files")
    page = F.col("page_id")
    body = F.concat(F.when(page % 4 == 1, F.lit("<html>")).otherwise(F.lit("%PDF-1.4\n")), F.coalesce("html", F.lit("")))
    name = F.concat(F.lit("page-"), page.cast("string"))
    sinks.write_files(spread(table(spark, sf_dir, "pages").select(name.alias("name"), body.alias("value"))), path)
    found = readers.valid_files(spark, path, "*.txt")
    return found.select(F.regexp_substr(F.substring_index("path", "/", -1), F.lit(r"^page--?\d+")).alias("name"), "ok")


@register("write_profile", with_views(f"""
SELECT state, sector, metric, category, value FROM ({sql_r6(PROFILE_SQL, ["value"])}) l
WHERE value IS NOT NULL"""))
def q_write_profile(spark, sf_dir):
    """Every metric of the written nested objects, read back; a metric is
    a number or an object of numbers."""
    long = r6(state_profile(households(spark, sf_dir), persons(spark, sf_dir), industry_codebook(spark),
                            occupation_codebook(spark)))
    path = shared_path(spark, "profiles")
    sinks.write_profile(long, path)
    docs = readers.read_records_auto(spark, path, "state string, profile map<string,map<string,string>>")
    metrics = docs.select("state", F.explode("profile").alias("sector", "m")).select(
        "state", "sector", F.explode("m").alias("metric", "text"))
    nested = F.col("text").startswith("{")
    pairs = F.when(nested, F.from_json("text", "map<string,double>")).otherwise(
        F.create_map(F.lit(""), F.col("text").cast("double")))
    return metrics.select("state", "sector", "metric", nested.alias("_nested"), F.explode(pairs).alias("_c", "value")).select(
        "state", "sector", "metric", F.when(F.col("_nested"), F.col("_c")).alias("category"), "value").where("value is not null")


@register("score_files", sql_r6(f"""
SELECT replace(model, '-', '_') AS model_file, count(*) AS items, avg(score) AS mean_score
FROM (SELECT doc_id, 'model-' || CAST(doc_id % 3 AS VARCHAR) AS model, score FROM ({SCORED_SQL}) s) t
WHERE score IS NOT NULL GROUP BY 1""", ["mean_score"]))
def q_score_files(spark, sf_dir):
    """Read the items, score, write one folder per model, read back."""
    items = eval_items(spark, sf_dir).withColumn("model", F.concat(F.lit("model-"), (F.col("doc_id") % 3).cast("string")))
    landed, path = shared_path(spark, "items"), shared_path(spark, "scores")
    sinks.write_records(items, landed)
    scored, _ = ev.split_scored(ev.score_responses(readers.read_records_auto(spark, landed, items.schema)))
    sinks.write_per_model(scored, path)
    back = spark.read.schema("doc_id long, model string, score double, _model_file string").json(path)
    return r6(back.groupBy(F.col("_model_file").alias("model_file")).agg(
        F.count(F.lit(1)).alias("items"), F.avg("score").alias("mean_score")))


@register("decimals_to_double", sql_r6("""
SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(18, 2)) AS DOUBLE) AS price FROM lineitem""", ["price"]))
def q_decimals_to_double(spark, sf_dir):
    """P7."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber",
                                                F.col("l_extendedprice").cast("decimal(18,2)").alias("price"))
    return r6(sc.decimals_to_double(li))


@register("question_domain", """
SELECT doc_id, CASE WHEN doc_id % 6000 BETWEEN 1 AND 4000 THEN CAST(doc_id % 6000 AS INTEGER) END AS question,
  NOT doc_id % 6000 BETWEEN 1 AND 4000 AS quarantined FROM documents""")
def q_question_domain(spark, sf_dir):
    """numbers outside the domain become null and go to quarantine."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 6000).cast("int").alias("n"))
    kept = docs.select("doc_id", qa.in_range_or_null("n", 1, 4000).alias("question"))
    return qa.with_quarantine_flag(kept, ["question"])


@register("file_list", """
SELECT file_no, count(*) AS questions FROM (
SELECT unnest(CASE WHEN q <= 375 THEN
    CASE WHEN q IN (64, 113, 123, 215) THEN [4371 - 2 * (q - 1) + before] ELSE [4370 - 2 * (q - 1) + before, 4371 - 2 * (q - 1) + before] END
  ELSE [4001 - q] END) AS file_no
FROM (SELECT doc_id % 5000 AS q, (CASE WHEN doc_id % 5000 > 64 THEN 1 ELSE 0 END) + (CASE WHEN doc_id % 5000 > 113 THEN 1 ELSE 0 END)
  + (CASE WHEN doc_id % 5000 > 123 THEN 1 ELSE 0 END) + (CASE WHEN doc_id % 5000 > 215 THEN 1 ELSE 0 END) AS before
  FROM documents WHERE doc_id % 5000 BETWEEN 1 AND 4000) t) f GROUP BY file_no""")
def q_file_list(spark, sf_dir):
    """T4 and R14 over many questions: the files that they need; numbers
    outside the domain are left to a quarantine."""
    files = rec.question_files((F.col("doc_id") % 5000).cast("string"), strict=False)
    rows = table(spark, sf_dir, "documents").select(F.explode(files).alias("file_no"))
    return rows.groupBy(F.col("file_no").cast("long").alias("file_no")).agg(F.count(F.lit(1)).alias("questions"))

"""Registered document-record queries (R1-R15, F7) and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelstat.operators import records as rec
from panelstat.plans.docs import DATE_TEXT_SQL, EXPECTED_SQL, expected, record_docs
from panelstat.plans.registry import register
from panelstat.plans.views import table

FIELDS = ["ministry", "question_no", "title", "asked_by", "question", "answered_date", "answered_by", "answer"]


def _records(spark, sf_dir):
    return rec.extract_records(record_docs(spark, sf_dir).drop("date_text"))


@register("extract_records", expected("doc_id, file, " + ", ".join(FIELDS) + ", status, detail"))
def q_extract_records(spark, sf_dir):
    return _records(spark, sf_dir)


def _field_query(field: str):
    def q(spark, sf_dir):
        return _records(spark, sf_dir).select("doc_id", field)
    q.__name__ = f"q_{field}"
    return q


for _name, _field in [("ministry", "ministry"), ("question_no", "question_no"), ("title", "title"),
                      ("question_text", "question"), ("asked_by", "asked_by"), ("answered_by", "answered_by"),
                      ("final_answer", "answer")]:
    register(_name, expected(f"doc_id, {_field}"))(_field_query(_field))


@register("date_norm", expected("doc_id, answered_date", unread=False))
def q_date_norm(spark, sf_dir):
    d = record_docs(spark, sf_dir)
    return d.select("doc_id", rec.normalise_date("date_text").alias("answered_date"))


@register("answer_parts", f"""
SELECT doc_id, 1 AS part_no, 'a' AS markers, _body AS text FROM ({EXPECTED_SQL}) e
UNION ALL
SELECT doc_id, 2 AS part_no, CASE WHEN doc_id % 2 = 0 THEN 'b,c' ELSE 'b' END AS markers,
  'Details are given.' AS text FROM ({EXPECTED_SQL}) e""")
def q_answer_parts(spark, sf_dir):
    docs = record_docs(spark, sf_dir, unread=False)
    # the answer block of each record: lines after the minister's name line
    body = F.regexp_extract(F.col("text"), r"(?s)\n(\(a\) : .*)\n\*\*\*\*\*$", 1)
    lines = F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    d = docs.select("doc_id", F.array_join(lines, "\n").alias("answer_raw"))
    return rec.answer_part_rows(d, "answer_raw", "doc_id")


@register("question_files", """
WITH q AS (SELECT doc_id, doc_id % 4000 + 1 AS q FROM documents WHERE doc_id % 7 <> 0 AND doc_id % 97 NOT IN (5, 6, 7)),
f AS (SELECT doc_id, q,
  CASE WHEN q <= 375 THEN
    CASE WHEN q IN (64, 113, 123, 215)
         THEN [4372 - 2 * (q - 1) + (CAST(q > 64 AS INTEGER) + CAST(q > 113 AS INTEGER) + CAST(q > 123 AS INTEGER) + CAST(q > 215 AS INTEGER)) - 1]
         ELSE [4372 - 2 * (q - 1) + (CAST(q > 64 AS INTEGER) + CAST(q > 113 AS INTEGER) + CAST(q > 123 AS INTEGER) + CAST(q > 215 AS INTEGER)) - 2,
               4372 - 2 * (q - 1) + (CAST(q > 64 AS INTEGER) + CAST(q > 113 AS INTEGER) + CAST(q > 123 AS INTEGER) + CAST(q > 215 AS INTEGER)) - 1]
    END
  ELSE [4001 - q] END AS files FROM q)
SELECT doc_id, CAST(q AS INTEGER) AS question, CAST(unnest(files) AS INTEGER) AS file_no FROM f""")
def q_question_files(spark, sf_dir):
    recs = _records(spark, sf_dir).select("doc_id", "question_no").where(F.col("question_no") != rec.NA)
    qn = F.col("question_no").cast("int")
    return recs.select("doc_id", qn.alias("question"), F.explode(rec.question_files(qn)).alias("file_no"))


@register("headings", """
SELECT page_id, CAST(pos AS INTEGER) AS pos, tag, heading, FALSE AS well_formed,
  CAST(NULL AS VARCHAR) AS label, CAST(NULL AS VARCHAR) AS variable FROM (
  SELECT page_id, 1 AS pos, 'title' AS tag, trim(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1)) AS heading FROM pages
  UNION ALL
  SELECT page_id, 2 AS pos, 'h1' AS tag, trim(regexp_extract(html, '<h1[^>]*>(.*?)</h1>', 1)) AS heading FROM pages) t
UNION ALL
SELECT page_id, 3 AS pos, 'h2' AS tag, 'Weight (old) of item ' || page_id || ' (var_' || page_id || ')' AS heading, TRUE AS well_formed,
  'Weight (old) of item ' || page_id AS label, 'var_' || page_id AS variable FROM pages WHERE page_id % 3 = 0""")
def q_headings(spark, sf_dir):
    """Every third page also has a data-dictionary heading, ``label (variable)``."""
    page = F.col("page_id").cast("string")
    heading = F.concat(F.lit("<h2> Weight (old) of item "), page, F.lit(" (var_"), page, F.lit(") </h2>"))
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat_ws(
        "", "html", F.when(F.col("page_id") % 3 == 0, heading)).alias("html"))
    return rec.headings(pages)


@register("strict_date", """
SELECT doc_id, CASE WHEN doc_id % 4 = 1 AND doc_id % 8 = 5 AND doc_id % 12 + 1 <> 5 THEN NULL
                    ELSE make_date(2025, CAST(doc_id % 12 + 1 AS INTEGER), CAST(doc_id % 28 + 1 AS INTEGER)) END AS answered_on
FROM documents""")
def q_strict_date(spark, sf_dir):
    """R4 strict mode: a real date, null for unknown or abbreviated months."""
    d = record_docs(spark, sf_dir)
    return d.select("doc_id", rec.strict_date("date_text").alias("answered_on"))

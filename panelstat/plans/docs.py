"""Record documents derived from the driver's ``documents`` table (docs_v).

Each document's full text becomes the body of a parliamentary question/answer
record whose header fields are planted by rule from ``doc_id``, ``source``
and ``lang``. The planted values are known in closed form, so the oracle SQL
checks the extractor against what was planted, not against a second copy of
the extractor. Variants by ``doc_id`` cover every branch: missing government
line, missing ministry line (default), missing number (N/A), four date forms
plus an abbreviated month, numbered / unnumbered / fallback askers, answer
anchor with or without the ANSWER line, page breaks as form feeds, five
minister title forms and one- or two-marker answer parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelstat.operators.records import MONTHS
from panelstat.plans.views import spread, table

WEEKDAYS = ["MONDAY", "TUESDAY", "WEDNESDAY", "THURSDAY", "FRIDAY", "SATURDAY", "SUNDAY"]


def record_docs(spark: SparkSession, sf_dir: str, unread: bool = True) -> DataFrame:
    """The records; with ``unread`` some have no text (null), an empty one, or
    one that holds no field."""
    d = spread(table(spark, sf_dir, "documents"))  # per-row work heavy enough to need every core
    did = F.col("doc_id")
    q = (did % 4000 + 1).cast("string")
    src = F.upper("source")
    lg = F.upper("lang")
    day = (did % 28 + 1).cast("string")
    month_no = (did % 12 + 1).cast("int")
    month = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), month_no)
    month_or_abbr = (F.when(did % 16 == 13, F.concat(F.substring(month, 1, 3), F.lit("X")))
                     .when(did % 8 == 5, F.substring(month, 1, 3)).otherwise(month))
    gap = F.when(did % 6 == 1, F.lit("\u00a0")).otherwise(F.lit(" "))  # as extracted from page layouts
    weekday = F.element_at(F.array(*[F.lit(w) for w in WEEKDAYS]), (did % 7 + 1).cast("int"))
    date_text = (F.when(did % 4 == 0, F.concat(day, F.lit("."), month_no.cast("string"), F.lit(".2025")))
                 .when(did % 4 == 1, F.concat(F.lit("THE "), day, F.lit("TH"), gap, month_or_abbr, F.lit(","), gap, F.lit("2025")))
                 .when(did % 4 == 2, F.concat(weekday, F.lit(", "), month, F.lit(" "), day, F.lit(", 2025")))
                 .otherwise(F.concat(day, F.lit("/"), month_no.cast("string"), F.lit("/2025"))))
    v = did % 3
    ask1 = F.when(v == 2, F.concat(F.lit("DR. "), src, F.lit(" RAO:"))).otherwise(
        F.concat(q, F.lit(". SHRI "), src, F.lit(" KUMAR:")))
    ask2 = (F.when(v == 0, F.concat(F.lit("SMT. "), lg, F.lit(" DEVI:")))
            .when(v == 2, F.concat(F.lit("PROF. "), lg, F.lit(" IYER:"))))
    t = did % 5
    minister_name = (F.when(t == 0, F.concat(F.lit("(SHRI "), lg, F.lit(" KUMAR)")))
                     .when(t == 1, F.concat(F.lit("(SMT."), gap, lg, gap, F.lit("KUMAR)")))
                     .when(t == 2, F.concat(F.lit("(DR. "), lg, F.lit(" KUMAR)")))
                     .when(t == 3, F.concat(F.lit("(SHRIMATI "), lg, F.lit(" KUMAR)")))
                     .otherwise(F.concat(F.lit("("), lg, F.lit(" KUMAR)"))))
    amp = F.when(did % 6 == 4, F.lit("\u00a0")).otherwise(F.lit(" "))
    second = (F.when(did % 2 == 0, F.concat(F.lit("(b)"), amp, F.lit("&"), amp, F.lit("(c) : Details are given.")))
              .otherwise(F.lit("(b) : Details are given.")))
    record = F.concat_ws(
        "\n",
        F.when(did % 5 != 0, F.lit("GOVERNMENT OF INDIA")),
        F.when(did % 10 != 0, F.concat(F.lit("MINISTRY OF "), src)),
        F.lit("LOK SABHA"),
        F.when(did % 7 != 0, F.concat(F.lit("UNSTARRED"), gap, F.lit("QUESTION"), gap, F.lit("NO."), gap, q)).otherwise(F.lit("UNSTARRED QUESTION")),
        F.concat(F.lit("ANSWERED ON "), date_text),
        F.concat(lg, F.lit(" POLICY REVIEW "), did.cast("string")),
        ask1, ask2,
        F.concat(F.lit("Will the Minister of "), src, F.lit(" be pleased to state:")),
        F.concat(F.lit("(a) whether the "), lg, F.lit(" report is ready; and")),
        F.lit("(b) if so, the details thereof?"),
        F.when(did % 4 != 3, F.lit("ANSWER")),
        F.concat(F.when(did % 6 == 0, F.lit("\f")).otherwise(F.lit("")), F.lit("THE MINISTER OF STATE FOR "), src),
        minister_name,
        F.concat(F.lit("(a) : "), F.coalesce(F.col("text"), F.lit(""))),
        second,
        F.lit("*****"),
    )
    if unread:
        record = (F.when(did % 97 == 5, F.lit(None)).when(did % 97 == 6, F.lit(""))
                  .when(did % 97 == 7, F.lit("This page is left blank.\n\n- 2 -")).otherwise(record))
    return d.select("doc_id", F.concat(F.lit("doc_"), did.cast("string"), F.lit(".txt")).alias("file"),
                    record.alias("text"), date_text.alias("date_text"))


# --------------------------------------------------------------------------- oracle

_SQL_MONTHS = "[" + ", ".join(f"'{m}'" for m in MONTHS) + "]"
_SQL_WEEKDAYS = "[" + ", ".join(f"'{w}'" for w in WEEKDAYS) + "]"

EXPECTED_SQL = f"""
SELECT doc_id, 'doc_' || CAST(doc_id AS VARCHAR) || '.txt' AS file,
  CASE WHEN doc_id % 10 = 0 THEN 'Ministry of Power'
       WHEN doc_id % 5 = 0 THEN 'Ministry OF ' || upper(source)
       ELSE 'MINISTRY OF ' || upper(source) END AS ministry,
  CASE WHEN doc_id % 7 = 0 THEN 'N/A' ELSE CAST(doc_id % 4000 + 1 AS VARCHAR) END AS question_no,
  upper(lang) || ' POLICY REVIEW ' || CAST(doc_id AS VARCHAR) AS title,
  CASE doc_id % 3 WHEN 0 THEN 'SMT. ' || upper(lang) || ' DEVI'
       WHEN 1 THEN CASE WHEN doc_id % 7 = 0 THEN 'N/A' ELSE 'SHRI ' || upper(source) || ' KUMAR' END
       ELSE 'DR. ' || upper(source) || ' RAO, PROF. ' || upper(lang) || ' IYER' END AS asked_by,
  'Will the Minister of ' || upper(source) || ' be pleased to state: (a) whether the ' || upper(lang)
    || ' report is ready; and (b) if so, the details thereof?' AS question,
  lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') || '/' ||
    CASE WHEN doc_id % 4 = 1 AND doc_id % 8 = 5 AND doc_id % 12 + 1 <> 5 THEN '01'
         ELSE lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0') END || '/2025' AS answered_date,
  CASE doc_id % 5 WHEN 0 THEN 'Shri. ' WHEN 1 THEN 'Smt. ' WHEN 2 THEN 'Dr. ' WHEN 3 THEN 'Smt. ' ELSE '' END
    || upper(substr(lang, 1, 1)) || lower(substr(lang, 2)) || ' Kumar' AS answered_by,
  '(a) ' || regexp_replace(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g') || ' '
    || CASE WHEN doc_id % 2 = 0 THEN '(b) & (c)' ELSE '(b)' END || ' Details are given.' AS answer,
  regexp_replace(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g') AS _body,
  CAST(NULL AS VARCHAR) AS status, CAST(NULL AS VARCHAR) AS detail
FROM documents
"""

DATE_TEXT_SQL = f"""
CASE WHEN doc_id % 4 = 0 THEN CAST(doc_id % 28 + 1 AS VARCHAR) || '.' || CAST(doc_id % 12 + 1 AS VARCHAR) || '.2025'
     WHEN doc_id % 4 = 1 THEN 'THE ' || CAST(doc_id % 28 + 1 AS VARCHAR) || 'TH ' ||
          CASE WHEN doc_id % 16 = 13 THEN substr({_SQL_MONTHS}[doc_id % 12 + 1], 1, 3) || 'X'
              WHEN doc_id % 8 = 5 THEN substr({_SQL_MONTHS}[doc_id % 12 + 1], 1, 3) ELSE {_SQL_MONTHS}[doc_id % 12 + 1] END || ', 2025'
     WHEN doc_id % 4 = 2 THEN {_SQL_WEEKDAYS}[doc_id % 7 + 1] || ', ' || {_SQL_MONTHS}[doc_id % 12 + 1] || ' '
          || CAST(doc_id % 28 + 1 AS VARCHAR) || ', 2025'
     ELSE CAST(doc_id % 28 + 1 AS VARCHAR) || '/' || CAST(doc_id % 12 + 1 AS VARCHAR) || '/2025' END"""


# Texts without fields give error rows.
_FIELDS = ("ministry", "question_no", "title", "asked_by", "question", "answered_date", "answered_by", "answer")
_UNREAD = ", ".join(f"CASE WHEN doc_id % 97 NOT IN (5, 6, 7) THEN {c} END AS {c}" for c in _FIELDS)


def expected(cols: str, unread: bool = True) -> str:
    if not unread:
        return f"SELECT {cols} FROM ({EXPECTED_SQL}) AS e"
    return f"""SELECT {cols} FROM (SELECT doc_id, file, {_UNREAD},
  CASE WHEN doc_id % 97 IN (5, 6, 7) THEN 'Error' END AS status,
  CASE WHEN doc_id % 97 = 5 THEN 'no text' WHEN doc_id % 97 IN (6, 7) THEN 'no fields found' END AS detail
  FROM ({EXPECTED_SQL}) AS i) AS e"""

"""Registered evaluation queries (E1-E7, A22, J12, X8-X10, X14) and oracle SQL.

``eval_v`` binds documents to evaluation items: the question asks
for a document's length, the truth is ``n_chars`` written with thousands
commas, the model is the document's ``source`` and the response is free text
around a perturbed number (or no number at all). ``judge_text`` holds judge
outputs in the forms the score parser must handle.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from panelstat.operators import evaluation as ev
from panelstat.functions.scoring import first_number, numeric_score, parse_score, text_score, truth_number
from panelstat.plans.registry import r6, register, sql_r6
from panelstat.plans.views import dealt, table

MODELS = ["gpt-4o", "gemini-1.5", "qwen-2", "llama-3", "other-7b"]


def _commas(n):
    return F.when(n >= 1000, F.concat(F.floor(n / 1000).cast("bigint").cast("string"), F.lit(","),
                                      F.lpad((n % 1000).cast("string"), 3, "0"))).otherwise(n.cast("string"))


def _commas_sql(n: str) -> str:
    return (f"CASE WHEN {n} >= 1000 THEN CAST(CAST(floor({n} / 1000) AS BIGINT) AS VARCHAR) || ',' || "
            f"lpad(CAST({n} % 1000 AS VARCHAR), 3, '0') ELSE CAST({n} AS VARCHAR) END")


def eval_items(spark, sf_dir):
    j = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    did, n = F.col("doc_id"), F.col("n_chars")
    k = did % 5
    response = (F.when(k == 0, (n + did % 50).cast("string"))
                .when(k == 1, F.concat(F.lit("About "), _commas(n + did % 300), F.lit(" characters.")))
                .when(k == 2, F.concat(F.lit("₹"), (n * 2).cast("string")))
                .when(k == 3, F.lit("I do not know."))
                .otherwise(F.concat(F.lit("Roughly "), F.floor(n / 2).cast("bigint").cast("string"), F.lit("% of it"))))
    j8 = did % 8
    judge = (F.when(j8 == 0, F.concat(F.lit("Score: 0."), F.lpad((did % 100).cast("string"), 2, "0")))
             .when(j8 == 1, F.lit("-1")).when(j8 == 2, F.lit("85%")).when(j8 == 3, F.lit(".5"))
             .when(j8 == 4, F.lit("1/2")).when(j8 == 5, F.lit("-0.5")).when(j8 == 6, F.lit("10"))
             .otherwise(F.lit("none")))
    return j.select("doc_id", F.col("source").alias("model"),
                    F.concat(F.lit("How many characters does document "), did.cast("string"), F.lit(" have?")).alias("query"),
                    _commas(n).alias("ground_truth"), response.alias("response"), judge.alias("judge_text"))


EVAL_SQL = f"""
SELECT d.doc_id, d.source AS model,
  'How many characters does document ' || CAST(d.doc_id AS VARCHAR) || ' have?' AS query,
  {_commas_sql('d.n_chars')} AS ground_truth,
  CASE d.doc_id % 5
    WHEN 0 THEN CAST(d.n_chars + d.doc_id % 50 AS VARCHAR)
    WHEN 1 THEN 'About ' || {_commas_sql('(d.n_chars + d.doc_id % 300)')} || ' characters.'
    WHEN 2 THEN '₹' || CAST(d.n_chars * 2 AS VARCHAR)
    WHEN 3 THEN 'I do not know.'
    ELSE 'Roughly ' || CAST(CAST(floor(d.n_chars / 2) AS BIGINT) AS VARCHAR) || '% of it' END AS response,
  CASE d.doc_id % 8
    WHEN 0 THEN 'Score: 0.' || lpad(CAST(d.doc_id % 100 AS VARCHAR), 2, '0')
    WHEN 1 THEN '-1' WHEN 2 THEN '85%' WHEN 3 THEN '.5' WHEN 4 THEN '1/2' WHEN 5 THEN '-0.5' WHEN 6 THEN '10'
    ELSE 'none' END AS judge_text
FROM documents d
"""

FIRST_NUMBER_SQL = ("TRY_CAST(nullif(regexp_extract(regexp_replace(response, '(\\d),(\\d)', '\\1\\2', 'g'), "
                    "'-?\\d+(?:\\.\\d+)?', 0), '') AS DOUBLE)")
TRUTH_SQL = "TRY_CAST(trim(regexp_replace(trim(ground_truth), '[,%₹$]|Rs\\.?', '', 'g')) AS DOUBLE)"
PARSE_SQL = ("CASE WHEN regexp_extract(judge_text, '[-+]?\\d*\\.\\d+|\\d+', 0) <> '' THEN "
             "greatest(0.0, least(1.0, TRY_CAST(regexp_extract(judge_text, '[-+]?\\d*\\.\\d+|\\d+', 0) AS DOUBLE))) END")


def _tok(c: str) -> str:
    return (f"list_distinct(list_filter(string_split(trim(lower(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))), ' '), "
            f"lambda x: x <> ''))")


def _text_score_sql(a: str, b: str) -> str:
    ta, tb = _tok(a), _tok(b)
    inter = f"len(list_intersect({ta}, {tb}))"
    return (f"CASE WHEN array_to_string(list_sort({ta}), ' ') = array_to_string(list_sort({tb}), ' ') THEN 1.0 "
            f"ELSE CAST({inter} AS DOUBLE) / nullif(len({ta}) + len({tb}) - {inter}, 0) END")


NUMSCORE_SQL = "greatest(0.0, least(1.0, 1.0 - abs(predicted - truth_value) / greatest(abs(truth_value), 1.0)))"

SCORED_SQL = f"""
SELECT *, CASE WHEN response IS NULL THEN NULL WHEN predicted IS NOT NULL AND truth_value IS NOT NULL THEN 'numeric'
               ELSE 'text' END AS method,
  CASE WHEN response IS NULL THEN NULL WHEN predicted IS NOT NULL AND truth_value IS NOT NULL THEN {NUMSCORE_SQL}
       ELSE {_text_score_sql('response', 'ground_truth')} END AS score
FROM (SELECT *, {FIRST_NUMBER_SQL} AS predicted, {TRUTH_SQL} AS truth_value FROM ({EVAL_SQL}) e) s
"""


PROMPT_SQL = f"""CASE split_part(m.model, '-', 1)
  WHEN 'gpt' THEN '{ev.SYSTEM_PROMPT}' || chr(10) || e.query || chr(10) || '{ev.FAMILY_HINTS["gpt"]}'
  WHEN 'other' THEN e.query ELSE '{ev.SYSTEM_PROMPT}' || chr(10) || e.query END"""
MODELS_SQL = f"(VALUES {', '.join(f"('{m}')" for m in MODELS)}) AS m(model)"


@register("build_requests", f"""
SELECT e.doc_id, m.model, {PROMPT_SQL} AS prompt FROM ({EVAL_SQL}) e, {MODELS_SQL}""")
def q_build_requests(spark, sf_dir):
    items = eval_items(spark, sf_dir).select("doc_id", "query")
    return ev.build_requests(items, MODELS).select("doc_id", "model", "prompt")


def _requests(spark, sf_dir):
    """Requests of all items; the items are dealt out first, as a request that fails is asked several times."""
    items = dealt(eval_items(spark, sf_dir).select("doc_id", "query"))
    return ev.build_requests(items, MODELS).select("doc_id", "model", "prompt")


def _lengths(prompts: pd.Series) -> pd.Series:
    """In plain Python, as a batch may be a single request."""
    return pd.Series([f"len:{len(p)}" if isinstance(p, str) else None for p in prompts], dtype=object)


def _length_answer(pdf: pd.DataFrame) -> pd.Series:
    """Deterministic stand-in model: reports the prompt length, and fails on
    every request about a document whose number ends in 7."""
    if (pdf["doc_id"].to_numpy() % 10 == 7).any():
        raise ValueError("no answer")
    return _lengths(pdf["prompt"])


@register("run_batch", f"""
SELECT e.doc_id, m.model, CASE WHEN e.doc_id % 10 <> 7 THEN 'len:' || CAST(length({PROMPT_SQL}) AS VARCHAR) END AS response,
  CASE WHEN e.doc_id % 10 = 7 THEN 'ValueError: no answer' END AS error
FROM ({EVAL_SQL}) e, {MODELS_SQL}""")
def q_run_batch(spark, sf_dir):
    return ev.run_batch(_requests(spark, sf_dir), _length_answer).select("doc_id", "model", "response", "error")


# From which document on each model fails, and at which documents from there on.
_STOPS = {"gpt-4o": (300, 10), "qwen-2": (0, 7), "other-7b": (90_000_000, 1)}
_STOP_SQL = " OR ".join(f"(m.model = '{m}' AND e.doc_id >= {a} AND e.doc_id % {b} = 3)" for m, (a, b) in _STOPS.items())


def _failing_answer(pdf: pd.DataFrame) -> pd.Series:
    model, doc = pdf["model"].to_numpy(), pdf["doc_id"].to_numpy()
    for m, (start, step) in _STOPS.items():
        if ((model == m) & (doc >= start) & (doc % step == 3)).any():
            raise ValueError("model is gone")
    return _lengths(pdf["prompt"])


@register("run_until_failure", f"""
SELECT doc_id, model, response FROM (
  SELECT e.doc_id, m.model, 'len:' || CAST(length({PROMPT_SQL}) AS VARCHAR) AS response,
    min(CASE WHEN {_STOP_SQL} THEN e.doc_id END) OVER (PARTITION BY m.model) AS stop
  FROM ({EVAL_SQL}) e, {MODELS_SQL}) t WHERE stop IS NULL OR doc_id < stop""")
def q_run_until_failure(spark, sf_dir):
    """Each model's answers up to its first failure."""
    return ev.run_until_failure(_requests(spark, sf_dir), _failing_answer, "doc_id").select("doc_id", "model", "response")


@register("parse_score", sql_r6(f"""
SELECT doc_id, {PARSE_SQL} AS score, CASE WHEN {PARSE_SQL} IS NULL THEN 'Error' END AS status
FROM ({EVAL_SQL}) e""", ["score"]))
def q_parse_score(spark, sf_dir):
    return r6(ev.judge_scores(eval_items(spark, sf_dir)).select("doc_id", "score", "status"))


@register("numeric_score", sql_r6(f"""
SELECT doc_id, predicted, truth_value, {NUMSCORE_SQL} AS score
FROM (SELECT doc_id, {FIRST_NUMBER_SQL} AS predicted, {TRUTH_SQL} AS truth_value FROM ({EVAL_SQL}) e) s
WHERE predicted IS NOT NULL AND truth_value IS NOT NULL""", ["predicted", "truth_value", "score"]))
def q_numeric_score(spark, sf_dir):
    e = eval_items(spark, sf_dir).select("doc_id", first_number("response").alias("predicted"),
                                         truth_number("ground_truth").alias("truth_value"))
    e = e.where(F.col("predicted").isNotNull() & F.col("truth_value").isNotNull())
    return r6(e.withColumn("score", numeric_score(F.col("predicted"), F.col("truth_value"))))


@register("text_score", sql_r6(f"""
SELECT doc_id, {_text_score_sql('response', 'query')} AS score FROM ({EVAL_SQL}) e""", ["score"]))
def q_text_score(spark, sf_dir):
    e = eval_items(spark, sf_dir)
    return r6(e.select("doc_id", text_score(F.col("response"), F.col("query")).alias("score")))


@register("score_responses", sql_r6(f"""
SELECT doc_id, model, method, score FROM ({SCORED_SQL}) s WHERE score IS NOT NULL""", ["score"]))
def q_score_responses(spark, sf_dir):
    scored, _failed = ev.split_scored(ev.score_responses(eval_items(spark, sf_dir)))
    return r6(scored.select("doc_id", "model", "method", "score"))


@register("leaderboard", sql_r6(f"""
SELECT model, replace(model, '-', '_') AS model_file, count(*) AS items, avg(score) AS mean_score,
  count_if(score = 1.0) AS exact, count_if(score = 0.0) AS zero, quantile_cont(score, 0.5) AS median_score
FROM ({SCORED_SQL}) s WHERE score IS NOT NULL GROUP BY model""", ["mean_score", "median_score"]))
def q_leaderboard(spark, sf_dir):
    scored, _ = ev.split_scored(ev.score_responses(eval_items(spark, sf_dir)))
    return r6(ev.model_file(ev.leaderboard(scored)))


@register("unscored", f"""
SELECT e.model, e.query FROM ({EVAL_SQL}) e
WHERE NOT EXISTS (SELECT 1 FROM ({EVAL_SQL}) j WHERE j.model = e.model AND j.query = e.query AND {PARSE_SQL.replace('judge_text', 'j.judge_text')} IS NOT NULL)""")
def q_unscored(spark, sf_dir):
    items = eval_items(spark, sf_dir)
    judged, _ = ev.split_scored(ev.judge_scores(items))
    return ev.unscored(items.select("model", "query"), judged)


# Planted answers by document: (truth, response) as SQL text that both engines read, and the score that they must get.
_MEANINGS = [
    ("concat(n_chars, '')", "concat('₹', n_chars, ' (PLFS 2022-23, per month)')", "1.0"),
    ("concat(n_chars * 1000, '')", "concat('In 2023 about ', n_chars, ' thousand people')", "1.0"),
    ("concat(n_chars * 100000, '')", "concat('Rs. ', n_chars, ' lakh')", "1.0"),
    ("concat(n_chars, '')", "concat('PLFS 2019: ', n_chars * 2, ' per cent')", "0.0"),
    ("'Uttar Pradesh'", "'UP'", "1.0"),
    ("'Worker population ratio of women'", "'The WPR of females'", "1.0"),
    ("'Agriculture'", "'agricultur sector'", "1.0 - 1.0 / 11"),
    ("concat('Region ', doc_id)", "'no idea'", "0.0"),
    ("'regular labour'", "cast(null as string)", "cast(null as double)"),
    ("concat(n_chars, '')", "'I do not know.'", "0.0"),
]


def _meaning_case(k: int, text: str = "string") -> str:
    arms = " ".join(f"WHEN {i} THEN {m[k]}" for i, m in enumerate(_MEANINGS))
    return f"CASE doc_id % {len(_MEANINGS)} {arms} END".replace("as string", f"as {text}")


@register("meaning_score", sql_r6(f"""
SELECT doc_id, CASE WHEN doc_id % 10 IN (0, 1, 2, 3, 9) THEN 'numeric' ELSE 'text' END AS method, {_meaning_case(2)} AS score
FROM documents""", ["score"]))
def q_meaning_score(spark, sf_dir):
    """E5: units, currencies, abbreviations and near words against planted scores."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(_meaning_case(0)).alias("ground_truth"),
                                                 F.expr(_meaning_case(1)).alias("response"))
    return r6(ev.meaning_scores(d).select("doc_id", "method", "score"))

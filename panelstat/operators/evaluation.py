"""Answer evaluation.

Requests fan out per model with ``explode`` over a bounded model list (no
join). Model calls run through ``mapInPandas`` with an injected,
Arrow-batched function, so a live client can be plugged in without changing
the plan; tests use pure functions. Scores are column expressions, and the
leaderboard is one grouped aggregate.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, StringType, StructField, StructType

from panelstat.functions.scoring import (aligned_score, first_number, meaning_tokens, numeric_score, parse_score, quantity,
                                         text_score, truth_number)
from panelstat.functions.text import file_safe
from panelstat.operators.estimators import moments, quantiles_from_cumulative, value_counts
from panelstat.operators.quality import require_columns
from panelstat.session import materialize

SYSTEM_PROMPT = "Answer with a single number or a short phrase."
FAMILIES = ("gemini", "gpt", "qwen", "llama", "llamma")
# What some families are told besides, behind the query.
FAMILY_HINTS = {"gpt": "Use the latest data that you know and do not answer with a question."}


def build_requests(queries: DataFrame, models: Sequence[str], query: str = "query",
                   hints: dict[str, str] = FAMILY_HINTS) -> DataFrame:
    """Every query for every model, with the prompt text for the model
    family (E1): the known families get the system prompt, those with a hint
    also that behind the query, any other the bare query. ``models`` is a bounded list, so each
    query row fans out in place - no join."""
    require_columns(queries, [query])
    out = queries.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    family = F.lower(F.split("model", "[-/:]")[0])
    hint = F.lit("")
    for name, text in hints.items():
        hint = F.when(family == name, F.lit("\n" + text)).otherwise(hint)
    prompt = (F.when(family.isin(*FAMILIES), F.concat(F.lit(SYSTEM_PROMPT + "\n"), F.col(query), hint))
              .otherwise(F.col(query)))
    return out.withColumn("prompt", prompt)


# Rows of the pieces in which a failed batch is asked again: the first size below the
# batch's, then each smaller one for the pieces that fail.
_PIECES = (256, 8, 1)


def _ask(answer_fn: Callable[[pd.DataFrame], pd.Series], pdf: pd.DataFrame) -> list:
    answers = answer_fn(pdf)
    if len(answers) != len(pdf):
        raise ValueError(f"{len(answers)} answers to {len(pdf)} requests")
    if isinstance(answers, pd.Series) and answers.dtype == object:
        return answers.tolist()  # made text with the batch's others
    return list(pd.Series(answers).astype("string"))


def _ask_in_pieces(answer_fn: Callable[[pd.DataFrame], pd.Series], pdf: pd.DataFrame) -> tuple[list, list]:
    """Responses and errors of the rows. Only a row that fails by itself has an error;
    a row is asked once per size of ``_PIECES`` at most, and once with its batch."""
    try:
        return _ask(answer_fn, pdf), [None] * len(pdf)
    except Exception as e:  # noqa: BLE001 - failure becomes data
        if len(pdf) <= 1:
            return [None] * len(pdf), [f"{type(e).__name__}: {e}"] * len(pdf)
    size = next(s for s in _PIECES if s < len(pdf))
    responses, errors = [], []
    for k in range(0, len(pdf), size):
        r, e = _ask_in_pieces(answer_fn, pdf.iloc[k:k + size])
        responses += r
        errors += e
    return responses, errors


def _ask_to_stop(answer_fn: Callable[[pd.DataFrame], pd.Series], pdf: pd.DataFrame, position: str,
                 stop) -> tuple[list[tuple[pd.DataFrame, list, list]], object]:
    """One model's requests, in order of ``position``, up to its first failure: (rows with
    responses and errors, the failure's position). Requests behind ``stop`` or a failure
    found are not asked; a failed piece is halved, its front first, so that all
    pieces that fail have twice the rows of the batch at most."""
    done, todo = [], [pdf]
    while todo:
        part = todo.pop()
        if stop is not None:
            part = part[~(part[position] > stop)]
        if not len(part):
            continue
        try:
            done.append((part, _ask(answer_fn, part), [None] * len(part)))
        except Exception as e:  # noqa: BLE001 - failure becomes data
            if len(part) > 1:
                half = len(part) // 2
                todo += [part.iloc[half:], part.iloc[:half]]
                continue
            done.append((part, [None], [f"{type(e).__name__}: {e}"]))
            if pd.notna(at := part[position].iloc[0]):
                stop = at
    return done, stop


def run_batch(requests: DataFrame, answer_fn: Callable[[pd.DataFrame], pd.Series], position: str | None = None,
              model: str = "model") -> DataFrame:
    """Call ``answer_fn`` on Arrow batches of requests (E2). Where a batch
    fails, its rows are asked in smaller pieces and those of the pieces that fail one by one,
    so that only the rows that fail by themselves get a null response and the error text.

    With ``position`` a model stops at its first failure: requests of which the task knows that they
    lie behind a failure of their model are not asked and have no row. Those before any
    failure are all asked."""
    schema = StructType(list(requests.schema.fields) + [StructField("response", StringType()),
                                                        StructField("error", StringType())])

    def answered(pdf: pd.DataFrame, responses: list, errors: list) -> pd.DataFrame:
        return pdf.assign(response=pd.Series(responses, dtype="string", index=pdf.index),
                          error=pd.Series(errors, dtype="string", index=pdf.index))

    def call(batches):
        for pdf in batches:
            yield answered(pdf, *_ask_in_pieces(answer_fn, pdf))

    def call_to_stop(batches):
        stops = {}
        for pdf in batches:
            for name, rows in pdf.groupby(model, dropna=False, sort=False):
                name = None if pd.isna(name) else name
                done, stops[name] = _ask_to_stop(answer_fn, rows.sort_values(position), position, stops.get(name))
                if done:
                    yield pd.concat([answered(*d) for d in done])

    # only types that pandas orders as Spark does
    ordered = position is not None and isinstance(requests.schema[position].dataType, (NumericType, DateType))
    return requests.mapInPandas(call_to_stop if ordered else call, schema)


def until_failure(answered: DataFrame, position: str, model: str = "model", error: str = "error") -> DataFrame:
    """The answers of each model before its first failure, by ``position`` (E2: a model
    stops at its first failure and what it has answered is kept). The answers are
    written first, so that no request is asked twice. A model's stop is one
    aggregate of all its rows, and the stops, a row per model that failed, are looked up
    by every row: no model's answers are brought together."""
    from panelstat.operators.lookups import bounded_broadcast

    answered = materialize(answered, "answered")
    stops = answered.where(F.col(error).isNotNull()).groupBy(F.col(model).alias("_model")).agg(F.min(position).alias("_stop"))
    rows = answered.join(bounded_broadcast(materialize(stops, "stops")), F.col(model).eqNullSafe(F.col("_model")), "left")
    return rows.where(F.col("_stop").isNull() | (F.col(position) < F.col("_stop"))).drop("_model", "_stop")


def run_until_failure(requests: DataFrame, answer_fn: Callable[[pd.DataFrame], pd.Series], position: str,
                      model: str = "model") -> DataFrame:
    """``run_batch``, cut at each model's first failure; a task that has met a failure asks
    that model nothing behind it."""
    return until_failure(run_batch(requests, answer_fn, position, model), position, model).drop("error")


def score_responses(df: DataFrame, response: str = "response", truth: str = "ground_truth") -> DataFrame:
    """Numeric rule when both sides carry numbers, token similarity otherwise
    (E4, E5, E6). Adds ``predicted``, ``truth_value``, ``method`` and ``score``."""
    p = first_number(F.col(response))
    t = truth_number(F.col(truth))
    out = df.withColumns({"predicted": p, "truth_value": t})
    num = numeric_score(F.col("predicted"), F.col("truth_value"))
    both = F.col("predicted").isNotNull() & F.col("truth_value").isNotNull()
    return out.withColumns({
        "method": F.when(F.col(response).isNull(), F.lit(None)).when(both, F.lit("numeric")).otherwise(F.lit("text")),
        "score": F.when(F.col(response).isNull(), F.lit(None)).when(both, num)
        .otherwise(text_score(F.col(response), F.col(truth)))})


def meaning_scores(df: DataFrame, response: str = "response", truth: str = "ground_truth") -> DataFrame:
    """Scores by meaning (E5): where the truth is a number, the numeric rule on the
    quantities that both state, units resolved; otherwise the truth's tokens, abbreviations
    written out, aligned with the response's, each weighted by its rarity among all truths. Adds
    ``method`` and ``score``. Token weights are counted over the distinct truths and
    joined to these, so that a truth of many items is looked up once."""
    t, r = F.col(truth), F.col(response)
    number = truth_number(t).isNotNull()
    texts = materialize(df.where(t.isNotNull() & ~number).select(t.alias("_truth")).distinct(), "truths")
    words = texts.select("_truth", F.explode(meaning_tokens("_truth")).alias("_t"))
    count = texts.count()
    weights = words.groupBy("_t").agg(F.log(F.lit(1.0) + F.lit(float(count)) / F.count(F.lit(1))).alias("_w"))
    weighted = words.join(weights, "_t").groupBy("_truth").agg(
        F.sort_array(F.collect_list(F.struct(F.col("_t").alias("t"), F.col("_w").alias("w")))).alias("_weights"))
    out = df.join(weighted, t == F.col("_truth"), "left").drop("_truth")
    none = F.array().cast("array<struct<t:string,w:double>>")
    text = aligned_score(meaning_tokens(F.coalesce(r, F.lit(""))), F.coalesce("_weights", none))
    score = F.when(number, F.when(quantity(r).isNotNull(), numeric_score(quantity(r), truth_number(t))).otherwise(0.0)).otherwise(text)
    return out.withColumns({"method": F.when(number, F.lit("numeric")).otherwise(F.lit("text")),
                            "score": F.when(r.isNotNull(), score)}).drop("_weights")


def judge_scores(df: DataFrame, judge_text: str = "judge_text") -> DataFrame:
    """Scores parsed from judge output (E3); unparseable rows get
    ``status='Error'`` instead of failing the run."""
    s = parse_score(F.col(judge_text))
    return df.withColumns({"score": s, "status": F.when(s.isNull(), F.lit("Error"))})


def split_scored(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scored, failed) - failed rows are dropped from scores."""
    return df.where(F.col("score").isNotNull()), df.where(F.col("score").isNull())


def leaderboard(scores: DataFrame, model: str = "model", score: str = "score") -> DataFrame:
    """Per model: items, mean, median, exact (1.0) and zero counts."""
    base = scores.where(F.col(score).isNotNull())
    counts = value_counts(base, [model], score)
    n = F.col("_n")
    rows = counts.groupBy(model).agg(F.sum(F.when(F.col("_v") == 1.0, n).otherwise(0)).alias("exact"),
                                     F.sum(F.when(F.col("_v") == 0.0, n).otherwise(0)).alias("zero"))
    med = quantiles_from_cumulative(counts, [model], [0.5], ["median_score"])
    return (moments(counts, [model]).join(rows, model).join(med, model, "left")
            .select(model, F.col("count").alias("items"), F.col("mean").alias("mean_score"), "exact", "zero", "median_score"))


def unscored(items: DataFrame, scored: DataFrame, keys: Sequence[str] = ("model", "query")) -> DataFrame:
    """Items with no score (J12): left anti join on the item keys."""
    return items.join(scored.select(*keys).distinct(), list(keys), "left_anti")


def model_file(df: DataFrame, model: str = "model") -> DataFrame:
    """File-safe model name."""
    return df.withColumn("model_file", file_safe(model))

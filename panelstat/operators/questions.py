"""Answers to a catalogue of questions (I1-I20) in one job.

A question is one or two operands, each an indicator within a scope (a value per
dimension, or none), and a form: the value itself, a gap or a ratio of the two
operands, a comparison, or the ends of a ranking over one dimension. All
indicators are ratios of sums, so one table of sums at the finest key serves
every question: it is rolled up to the grouping sets that the questions name and no
others, and the questions, a relation themselves, join its cells. The rows are read
once, however many questions there are.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ANY, RANGED = "*", "?"  # rolled up; the dimension that a ranking runs over


@dataclass(frozen=True)
class Operand:
    indicator: str
    scope: dict = field(default_factory=dict)  # dimension -> value
    label: str = ""


@dataclass(frozen=True)
class Question:
    """``form``: value, gap (first less second), ratio (first by second, times
    ``scale``), yes_no (is the first larger?), larger (whose label?), top (the ``k``
    largest of ``over``) or bottom. A gap or ratio with ``over`` is ranked, too."""
    id: str
    form: str
    operands: Sequence[Operand]
    over: str | None = None
    k: int = 1
    digits: int = 1
    scale: float = 1.0


@dataclass(frozen=True)
class Indicator:
    """``scale`` x sum of ``part`` / sum of ``whole`` (1 for a plain sum), names of summed columns."""
    part: str
    whole: str | None = None
    scale: float = 100.0


def _combined(q: Question) -> str:
    """How two operands become the value that is shown or ranked."""
    return q.form if q.form in ("gap", "ratio") else "gap" if q.form in ("yes_no", "larger") else (
        "gap" if len(q.operands) == 2 and q.scale == 1.0 else "ratio" if len(q.operands) == 2 else "value")


def specifications(spark: SparkSession, questions: Sequence[Question], dims: Sequence[str]) -> DataFrame:
    """The questions as a relation, one row per operand."""
    rows = []
    for q in questions:
        for n, o in enumerate(q.operands):
            place = [RANGED if d == q.over else o.scope.get(d, ANY) for d in dims]
            rows.append((q.id, q.form, _combined(q), q.k, q.digits, q.scale, n, o.label, o.indicator, *place))
    return spark.createDataFrame(rows, "question_id string, form string, combined string, k int, digits int, scale double, "
                                       "operand int, name string, indicator string, " + ", ".join(f"{d} string" for d in dims))


def lattice(rows: DataFrame, dims: Sequence[str], sums: dict[str, Column], indicators: dict[str, Indicator],
            questions: Sequence[Question]) -> DataFrame:
    """Cells (dims, over_key, indicator, value) of the grouping sets that the
    questions name. A dimension that is rolled up shows ANY, one that is ranked
    RANGED and its value in ``over_key``."""
    dims = list(dims)
    mine = [q for q in questions if any(o.indicator in indicators for o in q.operands)]
    wanted = {tuple(d for d in dims if d == q.over or d in o.scope) for q in mine for o in q.operands}
    fine = rows.groupBy(*dims).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    rolled = fine.groupingSets([[F.col(d) for d in s] for s in sorted(wanted)], *dims).agg(
        *[F.grouping(d).alias(f"_{d}") for d in dims], *[F.sum(n).alias(n) for n in sums])
    for d in dims:  # a null in the data is in no group
        rolled = rolled.where((F.col(f"_{d}") == 1) | F.col(d).isNotNull())
    values = [F.struct(F.lit(n).alias("indicator"), (
        F.col(i.part) if i.whole is None else F.lit(i.scale) * F.try_divide(F.col(i.part), F.col(i.whole))).alias("value"))
        for n, i in indicators.items()]
    shown = {d: F.when(F.col(f"_{d}") == 1, F.lit(ANY)).otherwise(F.col(d)) for d in dims}
    over = sorted({q.over for q in mine if q.over})
    places = [F.struct(*[shown[d].alias(d) for d in dims], F.lit(None).cast("string").alias("over_key"))]
    places += [F.when(F.col(f"_{r}") == 0, F.struct(*[(F.lit(RANGED) if d == r else shown[d]).alias(d) for d in dims],
                                                    F.col(r).alias("over_key"))) for r in over]
    cells = rolled.select(F.explode(F.filter(F.array(*places), lambda p: p.isNotNull())).alias("p"), F.array(*values).alias("v"))
    return cells.select("p.*", F.inline("v"))


def answers(specs: DataFrame, cells: DataFrame, dims: Sequence[str]) -> DataFrame:
    """(question_id, answer, value) for every question; both null where nothing is in its scope.
    Rankings tell their keys, best first, ties by key; comparisons yes or no, or a label."""
    found = specs.join(cells, [*dims, "indicator"], "left")
    first, second = F.col("operand") == 0, F.col("operand") == 1
    both = found.groupBy("question_id", "form", "combined", "k", "digits", "scale", "over_key").agg(
        F.max(F.when(first, F.col("value"))).alias("a"), F.max(F.when(second, F.col("value"))).alias("b"),
        F.max(F.when(first, F.col("name"))).alias("a_name"), F.max(F.when(second, F.col("name"))).alias("b_name"))
    a, b, form = F.col("a"), F.col("b"), F.col("form")
    value = (F.when(F.col("combined") == "gap", a - b).when(F.col("combined") == "ratio", F.col("scale") * F.try_divide(a, b))
             .otherwise(a))
    both = both.withColumn("value", F.round(value, 9))
    # one ranking for all forms: those without a ranking have one row
    order = F.when(form == "bottom", F.col("value")).otherwise(-F.col("value"))
    ranked = both.withColumn("place", F.row_number().over(
        Window.partitionBy("question_id").orderBy(order.asc_nulls_last(), "over_key")))
    shown = (F.when(F.col("digits") == 0, F.format_number("value", 0)).when(F.col("digits") == 1, F.format_number("value", 1))
             .otherwise(F.format_number("value", 2)))
    answer = (F.when(F.col("value").isNull(), F.lit(None)).when(form == "yes_no", F.when(F.col("value") > 0, "Yes").otherwise("No"))
              .when(form == "larger", F.when(F.col("value") > 0, F.col("a_name")).when(F.col("value") < 0, F.col("b_name"))
                    .otherwise("equal"))
              .otherwise(F.coalesce("over_key", shown)))
    top = ranked.where(F.col("place") <= F.col("k")).select("question_id", "place", answer.alias("answer"), "value")
    listed = F.sort_array(F.collect_list(F.struct("place", "answer", "value")))  # k rows at most
    return top.groupBy("question_id").agg(listed.alias("l")).select(
        "question_id", F.nullif(F.array_join("l.answer", ", "), F.lit("")).alias("answer"), F.col("l")[0]["value"].alias("value"))

"""The question catalogue: one job, one scan, every form."""

import io
import re
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from panelstat.operators.questions import Indicator, Operand, Question, answers, lattice, specifications
from panelstat.plans.catalog_questions import QUESTIONS, q_answer_questions

from tests.conftest import SMALL


def test_every_question_is_answered_from_one_scan(spark):
    df = q_answer_questions(spark, SMALL)
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    details = out.getvalue().split("\n\n\n")
    scans = [d for d in details if re.search(r"Scan parquet", d) and "l_linenumber" in d]
    assert len(scans) == 1
    got = {r["question_id"]: r for r in df.collect()}
    assert len(got) == len(QUESTIONS) == 110 and set(got) == {q.id for q in QUESTIONS}
    empty = [q for q, r in got.items() if r["answer"] is None]
    assert len(empty) <= 11, empty  # cells without a row in the small tables
    assert got["I8-2"]["answer"] in ("Yes", "No") and got["I8-3"]["answer"] in ("male", "female", "equal")
    assert len(got["I17-3"]["answer"].split(", ")) == 5


DIMS = ["state", "gender"]
ROWS = [("A", "male", 2.0, 10.0), ("A", "female", 1.0, 4.0), ("B", "male", 1.0, 6.0), ("B", "female", 1.0, 6.0),
        ("C", "male", 1.0, None), ("C", None, 5.0, 100.0), (None, "female", 1.0, 8.0)]


def ask(spark, *questions):
    rows = spark.createDataFrame(ROWS, "state string, gender string, weight double, pay double")
    w = F.col("weight")
    sums = {"pay": F.coalesce(F.col("pay") * w, F.lit(0.0)), "paid": F.when(F.col("pay").isNotNull(), w).otherwise(0.0), "all": w}
    indicators = {"pay": Indicator("pay", "paid", 1.0), "people": Indicator("all")}
    cells = lattice(rows, DIMS, sums, indicators, questions)
    return {r["question_id"]: (r["answer"], r["value"])
            for r in answers(specifications(spark, questions, DIMS), cells, DIMS).collect()}


def test_forms_and_nulls(spark):
    male, female = (Operand("pay", {"gender": g}, g) for g in ("male", "female"))
    got = ask(spark, Question("all", "value", [Operand("pay")]), Question("b", "value", [Operand("pay", {"state": "B"})], digits=0),
              Question("none", "value", [Operand("pay", {"state": "Z"})]), Question("c", "value", [Operand("pay", {"state": "C", "gender": "male"})]),
              Question("gap", "top", [male, female], over="state"), Question("low", "bottom", [Operand("people")], over="state"),
              Question("two", "top", [Operand("people")], over="state", k=2), Question("yes", "yes_no", [male, female]),
              Question("who", "larger", [female, male]), Question("ratio", "ratio", [
                  Operand("people", {"gender": "female"}), Operand("people", {"gender": "male"})], scale=1000.0, digits=2))
    assert got["all"][1] == round((20 + 4 + 6 + 6 + 500 + 8) / 11, 9)
    assert got["b"] == ("6", 6.0) and got["none"] == (None, None) and got["c"] == (None, None)
    assert got["gap"] == ("A", 6.0)
    assert got["low"] == ("B", 2.0)  # the row without a state is in no group
    assert got["two"][0] == "C, A"
    assert got["yes"][0] == "Yes" and got["who"][0] == "male"
    assert got["ratio"] == ("750.00", 750.0)

"""Scoring by meaning: quantities, abbreviations, near words, rare words first."""

import pytest

from panelstat.functions.scoring import meaning_tokens, quantity
from panelstat.operators.evaluation import meaning_scores
@pytest.mark.parametrize("text,value", [
    ("₹17,000 (PLFS 2019-20, monthly)", 17000.0), ("PLFS (2019–20): ₹10,610 per month", 10610.0), ("2.1 lakh", 210000.0),
    ("Rs. 1.5 crore", 1.5e7), ("about 21k", 21000.0), ("In 2022, 83.2% of them", 83.2), ("83.2 per cent", 83.2),
    ("between 2019 and 2020", 2019.0), ("3.5 million people", 3.5e6), ("2.1-lakh", 210000.0), ("no number", None), (None, None),
    ("-4.5", -4.5), ("1,23,456", 123456.0), ("2000 people", 2000.0), ("5 km", 5.0), ("in 2011: 940 per 1000", 940.0),
])
def test_quantities(spark, text, value):
    assert spark.createDataFrame([(text,)], "t string").select(quantity("t")).first()[0] == value


def test_tokens_write_out_abbreviations(spark):
    got = spark.createDataFrame([("The WPR in UP",)], "t string").select(meaning_tokens("t")).first()[0]
    assert got == ["worker", "population", "ratio", "uttar", "pradesh"]


def scores(spark, *rows):
    df = spark.createDataFrame([(i, t, r) for i, (t, r) in enumerate(rows)], "i int, ground_truth string, response string")
    return [r["score"] for r in meaning_scores(df).orderBy("i").collect()]


def test_scores(spark):
    got = scores(spark, ("15,839", "15.839 thousand"), ("80.6", "80.6%"), ("Dadra & Nagar Haveli", "dadra and nagar haveli"),
                 ("Kerala", "Karela"), ("Bihar", "UP"), ("Kerala", None), (None, "x"), ("", "x"), ("100", "150"))
    assert got[:3] == [1.0, 1.0, 1.0] and 0.0 <= got[3] < 1.0 and got[4] == 0.0
    assert got[5] is None and got[6] is None and got[7] is None and got[8] == 0.5


def test_rare_words_weigh_more(spark):
    rows = [(f"state {n} pradesh", "x") for n in ("alpha", "beta", "gamma")] + [("alpha pradesh", "alpha"), ("beta pradesh", "pradesh")]
    *_, rare, common = scores(spark, *rows)
    assert rare > 0.5 > common > 0

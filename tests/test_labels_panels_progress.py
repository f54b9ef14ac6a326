"""Value labels over many columns, panels in one scan, stored joins, stopped models, durable progress."""

import io
import json
import os
from contextlib import redirect_stdout

import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelstat.operators import evaluation as ev, lookups as lk, schema as sc
from panelstat.plans.catalog_lookup import q_panels_one_scan, q_value_labels_many
from panelstat.session import shared_path
from panelstat.sources.readers import read_stream_records
from panelstat.sources.sinks import stored
from panelstat.streaming.decode import milestones, progress, run_available, with_progress
from tests.conftest import SMOKE


def plan_of(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


CODED = [(1, "1", "x", None), (2, "2", "y", "1"), (2, "9", None, "2"), (None, None, None, None)]
LABELS = [("a", "1", "one"), ("a", "2", "two"), ("b", "x", "ex"), ("c", "2", None), ("zz", "1", "no such column"), ("a", None, "never")]


@pytest.mark.parametrize("most", [100, 2])
def test_labels_as_maps_and_by_one_join(spark, most):
    df = spark.createDataFrame(CODED, "k int, a string, b string, c string")
    labels = spark.createDataFrame(LABELS, "column string, code string, label string")
    got = lk.apply_value_labels(df, labels, ["a", "b", "c", "absent"], most=most)
    assert got.columns == df.columns
    want = [(1, "one", "ex", None), (2, "two", "y", "1"), (2, "9", None, "2"), (None, None, None, None)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_sixty_columns_need_no_join(spark):
    assert "Join" not in plan_of(q_value_labels_many(spark, SMOKE))
    df = spark.range(50).select("id", *[(F.col("id") % 5).cast("string").alias(f"v{i}") for i in range(60)])
    labels = spark.range(300).select(F.concat(F.lit("v"), (F.col("id") % 60).cast("string")).alias("column"),
                                     F.floor(F.col("id") / 60).cast("string").alias("code"),
                                     F.concat(F.lit("l"), F.col("id").cast("string")).alias("label"))
    wide = lk.apply_value_labels(df, labels, [f"v{i}" for i in range(60)], most=10)
    assert plan_of(wide).count("Join") <= 2  # one with the labels, one that puts them back
    assert {r["v7"] for r in wide.collect()} == {f"l{60 * c + 7}" for c in range(5)}


def test_panels_are_one_scan(spark, tmp_path):
    assert plan_of(q_panels_one_scan(spark, SMOKE)).count("FileScan text") == 1
    for name, rows in {"p1": [{"ID": 1, "State": "A", "x": 2.5}], "p2": [{"id": 2, "state": "B"}, {"id": 3}]}.items():
        os.makedirs(tmp_path / name)
        (tmp_path / name / "part.json").write_text("\n".join(map(json.dumps, rows)))
    got = sc.read_panels(spark, {n: str(tmp_path / n) for n in ("p1", "p2")},
                         {"id": {"p1": "ID"}, "state": {"p1": "State"}, "x": {"p2": None}}, {"id": "long", "x": "double"})
    assert got.columns == ["id", "state", "x", "panel"]
    assert sorted(map(tuple, got.collect())) == [(1, "A", 2.5, "p1"), (2, "B", None, "p2"), (3, None, None, "p2")]


def test_stored_tables_join_without_an_exchange(spark):
    left = stored(spark, spark.range(500).select((F.col("id") % 90).alias("k"), "id"), "k", "left", 4)
    right = stored(spark, spark.range(90).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")), "k", "right", 4)
    joined = left.join(right.hint("merge"), "k")
    assert "SortMergeJoin" in plan_of(joined) and "Exchange" not in plan_of(joined)
    assert joined.count() == 500 and joined.where("v <> 2 * k").count() == 0


def test_a_model_stops_at_its_first_failure(spark):
    """A hot model with a third of all requests; models that never fail, fail at once, fail often."""
    rows = [(i, m) for i in range(300) for m in ("hot", "fine", "dead", None)] + [(i, "hot") for i in range(300, 900)]
    fails = {("hot", 700), ("hot", 650), ("dead", 0), ("dead", 9), (None, 20)}

    def answer(pdf: pd.DataFrame) -> pd.Series:
        if any((None if pd.isna(m) else m, i) in {("hot", 700), ("hot", 650), ("dead", 0), ("dead", 9), (None, 20)}
               for m, i in zip(pdf["model"], pdf["n"])):
            raise ValueError("down")
        return "a" + pdf["n"].astype(str)
    df = spark.createDataFrame(rows, "n int, model string").repartition(6)
    got = sorted(((r["model"], r["n"], r["response"]) for r in ev.run_until_failure(df, answer, "n").collect()), key=str)
    first = {m: min(i for x, i in fails if x == m) for m in {x for x, _ in fails}}
    want = sorted(((m, i, f"a{i}") for i, m in rows if i < first.get(m, 10**9)), key=str)
    assert got == want
    assert ev.run_until_failure(df.limit(0), answer, "n").count() == 0


def test_progress_outlives_the_recent_updates(spark):
    """More micro-batches than a query remembers."""
    landed = shared_path(spark, "many-files")
    folder = landed.removeprefix("file:")
    os.makedirs(folder)
    n, per = 120, 250
    for i in range(n):
        with open(f"{folder}/f{i:04d}.json", "w") as f:
            f.write("\n".join(json.dumps({"id": i * per + k}) for k in range(per)))
    stream = with_progress(read_stream_records(spark, landed, "id long", max_files=1))
    sink = run_available(stream, "many")
    rows = progress(spark, "many")
    assert rows.count() == n and rows.agg(F.sum("rows")).first()[0] == n * per == spark.read.parquet(sink).count()
    passed = milestones(rows, 10_000).orderBy("batch").collect()
    assert [r["total"] for r in passed] == [10_000, 20_000, 30_000]

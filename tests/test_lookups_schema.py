"""Lookups, schema alignment, filters, readers and sinks (J*, P*, F*, S*)."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from panelstat.functions.text import numeric_prefix, split_lines, strip_ws, zfill
from panelstat.operators import lookups as lk
from panelstat.operators import quality as qa
from panelstat.operators import schema as sc
from panelstat.sources import codebooks as cb
from panelstat.sources import readers as rd
from panelstat.sources import sinks as sk
from tests.conftest import rows


def test_zfill_never_truncates(spark):
    df = spark.createDataFrame([("7",), ("281",)], "c string")
    assert [r[0] for r in df.select(zfill("c", 2)).collect()] == ["07", "281"]


def test_strip_and_split_lines(spark):
    df = spark.createDataFrame([("\t a  ", "x\r\ny\x0cz\n\n  \nw")], "a string, b string")
    r = df.select(strip_ws("a").alias("s"), split_lines("b").alias("l")).first()
    assert r["s"] == "a" and list(r["l"]) == ["x", "y", "z", "w"]


def test_numeric_prefix(spark):
    df = spark.createDataFrame([("1234",), ("01234",), ("abc",), ("12.7",)], "c string")
    assert [r[0] for r in df.select(numeric_prefix("c", 2)).collect()] == ["12", "12", "abc", "12"]


def test_household_type_lookup(spark):
    df = spark.createDataFrame([("rural", "2"), ("urban", "2"), ("urban", "4"), ("Rural", "2")],
                               "sector string, hh_type_code string")
    got = [r["household_type"] for r in lk.decode_household_type(df, cb.household_type_codebook(spark)).collect()]
    assert sorted(got) == sorted(["self-employed in non-agriculture", "regular wage/salary earning", "others", "others"])


def test_enum_passthrough(spark):
    df = spark.createDataFrame([("Q1",), ("Q9",)], "q string")
    assert sorted(r[0] for r in df.select(lk.enum_passthrough("q", cb.QUARTER)).collect()) == ["Q9", "Quarter 1"]


def test_lookup_is_broadcast(spark):
    df = spark.createDataFrame([("31",)], "status_code string")
    plan = lk.status_category(df, cb.status_codebook(spark))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan or "BroadcastExchange" in plan


def test_rename_collision_later_wins(spark):
    df = spark.createDataFrame([(1, "a", "b")], "id int, x string, y string")
    out = sc.rename_columns(df, {"x": "z", "y": "z"})
    assert out.columns == ["id", "z"] and out.first()["z"] == "b"


def test_select_present_and_align(spark):
    df = spark.createDataFrame([(1, 2.0, None)], "id int, `Salarid` double, other string")
    assert sc.select_present(df, ["id", "missing", "other"]).columns == ["id", "other"]
    al = sc.align_schema(df, {"earning": ["Salaried", "Salarid"], "training": ["vocational"]},
                         types={"earning": "double"})
    r = al.first()
    assert r["earning"] == 2.0 and r["training"] is None and "Salarid" not in al.columns


def test_blank_to_null_and_matching(spark):
    df = spark.createDataFrame([("", "x", "31", "81")], "a string, b string, status_d1 string, status_d2 string")
    assert sc.blank_to_null(df).first()["a"] is None
    pairs = [(c, cat) for c, _, cat in cb.STATUS]
    m = sc.transform_matching(df, "status_d", lambda c: lk.enum_passthrough(c, pairs)).first()
    assert (m["status_d1"], m["status_d2"]) == ("employed", "unemployed")


def test_union_panels_and_headers(spark):
    a = spark.createDataFrame([(1,)], "x int")
    b = spark.createDataFrame([(2, "y")], "x int, extra string")
    u = sc.union_panels({"first_visit": a, "revisit": b})
    assert sorted(rows(u, "panel", "x")) == [("first_visit", 1), ("revisit", 2)]
    assert sc.normalise_headers(spark.createDataFrame([(1,)], "` ab ` int")).columns == ["AB"]


def test_quarantine_and_require(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    good, bad = qa.quarantine_split(df, ["v"])
    assert good.count() == 1 and bad.first()["id"] == 2
    with pytest.raises(ValueError):
        qa.require_columns(df, ["nope"])


def test_domain_checks(spark):
    df = spark.createDataFrame([(5,), (5000,)], "q int")
    assert [r[0] for r in df.select(qa.in_range_or_null("q", 1, 4000)).collect()] == [5, None]
    with pytest.raises(Exception):
        df.select(qa.in_range_or_fail("q", 1, 4000)).collect()


def test_readers_and_sinks(spark):
    d = tempfile.mkdtemp(prefix="panelstat-io-")
    with open(os.path.join(d, "a.json"), "w") as f:
        json.dump([{"query": "q1", "ground_truth": "1,000"}, {"query": "q2", "ground_truth": "7"}], f)
    with open(os.path.join(d, "one.json"), "w") as f:
        json.dump({"query": "q3", "ground_truth": "x"}, f)
    with open(os.path.join(d, "codes.csv"), "w") as f:
        f.write('"x","y"\n"Value","Category"\n"11","old"\n"11","new"\n"31","reg"\n')
    with open(os.path.join(d, "doc1.txt"), "w") as f:
        f.write("line one\nline two")
    with open(os.path.join(d, "ok.pdf"), "wb") as f:
        f.write(b"%PDF-1.4 body")
    with open(os.path.join(d, "bad.pdf"), "wb") as f:
        f.write(b"<html>")
    assert rd.read_records_auto(spark, os.path.join(d, "a.json")).count() == 2
    assert rd.read_any(spark, os.path.join(d, "one.json")).first()["query"] == "q3"
    with pytest.raises(ValueError):
        rd.read_any(spark, os.path.join(d, "x.xlsx"))
    assert dict(rows(rd.read_codebook_csv(spark, os.path.join(d, "codes.csv")))) == {"11": "new", "31": "reg"}
    docs = rd.read_documents(spark, d, "*.txt").first()
    assert docs["file"] == "doc1.txt" and docs["text"] == "line one\nline two"
    assert dict((os.path.basename(p), ok) for p, ok in rows(rd.valid_files(spark, d))) == {"ok.pdf": True,
                                                                                          "bad.pdf": False}
    out = os.path.join(d, "out")
    sk.write_records(spark.createDataFrame([("é", None)], "a string, b string"), out)
    lines = [ln for p in sorted(os.listdir(out)) if p.endswith(".json")
             for ln in open(os.path.join(out, p), encoding="utf-8").read().splitlines() if ln.strip()]
    assert [json.loads(ln) for ln in lines] == [{"a": "é", "b": None}]


def test_profile_json_shape(spark):
    long = spark.createDataFrame([("kerala", "urban", "total", None, 9.5), ("kerala", "urban", "religion", "islam", 0.11),
                                  ("kerala", "urban", "religion", "hinduism", 0.89)],
                                 "state string, sector string, metric string, category string, value double")
    doc = json.loads(sk.profile_json(long).first()["profile"])
    assert doc == {"urban": {"religion": {"hinduism": 0.89, "islam": 0.11}, "total": 9.5}}


def test_constant_decimal_positional_source(spark):
    df = spark.createDataFrame([(1, "a", 2)], "id int, x string, y int").withColumn("d", F.lit(1.5).cast("decimal(5,2)"))
    out = sc.decimals_to_double(sc.with_constant(df, "file_id", "First Visit Household 7"))
    assert dict(out.dtypes)["d"] == "double" and out.first()["file_id"] == "First Visit Household 7"
    assert sc.positional(df, 1, 3).columns == ["x", "y"]
    d = tempfile.mkdtemp(prefix="panelstat-src-")
    spark.range(3).write.parquet(os.path.join(d, "t"))
    files = {r["file"] for r in sc.with_source_file(spark.read.parquet(os.path.join(d, "t"))).collect()}
    assert all(f.endswith(".parquet") for f in files)


def test_csv_and_per_model_sinks(spark):
    d = tempfile.mkdtemp(prefix="panelstat-sink-")
    df = spark.createDataFrame([("gpt-4o", 1.0), ("llama-3", 0.5)], "model string, score double")
    sk.write_csv(df, os.path.join(d, "csv"))
    assert spark.read.option("header", True).csv(os.path.join(d, "csv")).count() == 2
    sk.write_per_model(df, os.path.join(d, "per"))
    assert sorted(p for p in os.listdir(os.path.join(d, "per")) if p.startswith("_model_file=")) == [
        "_model_file=gpt_4o", "_model_file=llama_3"]


def test_cube_of_sums_equals_direct_cube(spark):
    from panelstat.operators import indicators as ind
    rows_ = [(s, sec, g, c, float(w)) for s, sec, g, c, w in [
        ("a", "urban", "male", "employed", 2), ("a", "rural", "female", "unemployed", 1),
        ("b", "urban", "female", "employed", 3), ("b", "urban", "male", "not_in_labor_force", 4)]]
    df = spark.createDataFrame(rows_, "state string, sector string, gender string, status_category string, weight double")
    sums, finish = ind.labour_rate_sums()
    a = sorted((r["state"], r["sector"], r["gender"], round(r["wpr"], 9), round(r["ur"], 9))
               for r in ind.cube_of_sums(df, ["state", "sector", "gender"], sums, finish).collect())
    b = sorted((r["state"], r["sector"], r["gender"], round(r["wpr"], 9), round(r["ur"], 9))
               for r in ind.subgroup_totals(df, ["state", "sector", "gender"], ind.labour_rate_exprs()).collect())
    assert a == b


def test_region_codes_from_text(spark):
    text = "Table 281 Coastal Northern Kerala (12) 282 Inland Southern Kerala (3) 281 Coast North Goa (1)"
    df = spark.createDataFrame([(1, text)], "o int, text string")
    got = dict(rows(rd.region_codes_from_text(df, "text", "o")))
    assert got == {"281": "Coast North", "282": "Inland Southern"}


def test_build_district_codebook(spark):
    sheet = spark.createDataFrame([(" kerala ", "7", "Old", 1), ("KERALA", "07", " New ", 2), ("goa", "12", "North", 3)],
                                  "s string, c string, n string, o int")
    got = rows(lk.build_district_codebook(sheet, "s", "c", "n", "o"))
    assert got == [("GOA", "12", "North"), ("KERALA", "07", "New")]

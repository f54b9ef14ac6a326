"""JSON layouts: lines, arrays, broken lines, items of arrays by several tasks, keys per record."""

import json
import os

import pytest
from pyspark.sql import functions as F

from panelstat.operators import quality as qa
from panelstat.session import shared_path
from panelstat.sources import readers as rd, sinks

DDL = "k long, s string"
ROWS = [{"k": i, "s": None if i % 5 == 0 else f'v{i} "q" [é,'} for i in range(2000)]


def put(tmp_path, name, text):
    path = os.path.join(tmp_path, name)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def found(df):
    return sorted((r["k"], r["s"]) for r in df.collect())


WANT = sorted((r["k"], r["s"]) for r in ROWS)
LAYOUTS = {
    "lines": "\n".join(map(json.dumps, ROWS)) + "\n\n",
    "compact array": json.dumps(ROWS, separators=(",", ":")),
    "array, indented": json.dumps(ROWS, indent=4),
    "array, a record a line": "[\n" + ",\n".join(map(json.dumps, ROWS)) + "\n]\n",
    "array, brackets beside records": "[" + ",\n".join(map(json.dumps, ROWS)) + "]",
    "array, commas first": "[ " + "\n, ".join(map(json.dumps, ROWS)) + "\n]",
}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_layouts_give_the_same_records(spark, tmp_path, layout):
    path = put(tmp_path, "rows.json", LAYOUTS[layout])
    assert found(rd.read_records_auto(spark, path, DDL)) == WANT
    assert found(rd.read_records_auto(spark, path, DDL, quarantine="bad").where("bad is null")) == WANT
    if layout != "lines":
        assert found(rd.read_array_items(spark, path, DDL)) == WANT


def test_one_object_over_lines(spark, tmp_path):
    path = put(tmp_path, "one.json", '{\n "k": 1,\n "s": "x"\n}\n')
    assert found(rd.read_records_auto(spark, path, DDL)) == [(1, "x")]


def test_a_broken_line_is_quarantined_or_an_error(spark, tmp_path):
    lines = list(map(json.dumps, ROWS))
    lines[999] = lines[999][:-4]
    path = put(tmp_path, "broken.json", "\n".join(lines))
    with pytest.raises(ValueError, match="1 of 2000 lines"):
        rd.read_records_auto(spark, path, DDL)
    got = rd.read_records_auto(spark, path, DDL, quarantine="bad").collect()
    assert [r["bad"] for r in got if r["bad"] is not None] == [lines[999]]
    assert sorted(r["k"] for r in got if r["bad"] is None) == [i for i in range(2000) if i != 999]


def test_items_of_one_file_are_read_by_several_tasks(spark, tmp_path):
    path = put(tmp_path, "rows.json", LAYOUTS["array, indented"])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        got = rd.read_array_items(spark, path, DDL)
        assert got.rdd.getNumPartitions() >= 4 and found(got) == WANT
        assert got.select(F.spark_partition_id().alias("p")).distinct().count() >= 4
        assert found(rd.read_records(spark, path, DDL)) == WANT
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_items_that_are_not_flat_are_never_taken_for_records(spark, tmp_path):
    rows = ['{"k": 1, "s": "a"}', '{"k": 2, "s": "b } c"}', '{"k": 3, "s": {"t": 1}}', '{"k": 4, "s": "}, {\\"k\\": 9"}',
            '{"k": "five", "s": "e"}', '{"k": 6, "s": "f"}']
    path = put(tmp_path, "odd.json", "[" + ", ".join(rows) + "]")
    got = rd.read_array_items(spark, path, DDL, quarantine="piece").collect()
    assert [(r["k"], r["s"]) for r in got if r["piece"] is None] == [(1, "a"), (6, "f")]
    assert all(r["k"] is None and r["s"] is None for r in got if r["piece"] is not None)
    with pytest.raises(Exception, match="not a flat record"):
        rd.read_array_items(spark, path, DDL).collect()
    for text in ("[]", "", " [ ] \n"):
        assert rd.read_array_items(spark, put(tmp_path, "none.json", text), DDL).count() == 0


def test_arrays_that_are_written_parse(spark):
    path = shared_path(spark, "arrays")
    df = spark.createDataFrame([(r["k"], r["s"]) for r in ROWS], DDL)
    for pretty in (False, True):
        sinks.write_array(df.repartition(3), path, pretty)
        folder = path.removeprefix("file:")
        rows = [r for n in os.listdir(folder) if n.endswith(".txt") and os.path.getsize(f"{folder}/{n}")
                for r in json.load(open(f"{folder}/{n}", encoding="utf-8"))]
        assert sorted((r["k"], r["s"]) for r in rows) == WANT


def test_absent_keys_and_null_values_differ(spark):
    texts = ['{"a":1,"b":null}', '{"a":1}', '{"b":2,"c":3}', "{}", "no json", None, "[1]"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["m"] for r in df.select("i", qa.missing_keys("t", ["a", "b"]).alias("m")).collect()}
    assert got == {0: [], 1: ["b"], 2: ["a"], 3: ["a", "b"], 4: ["a", "b"], 5: ["a", "b"], 6: ["a", "b"]}
    whole, gaps = qa.split_by_keys(df, "t", ["a", "b"])
    assert whole.columns == df.columns and whole.count() == 1 and gaps.count() == 6
    assert qa.require_keys(df.where("i = 0"), "t", ["a", "b"]).count() == 1
    with pytest.raises(Exception, match="missing fields: b"):
        qa.require_keys(df.where("i < 2"), "t", ["a", "b"]).collect()

"""Answers do not depend on the partitioning; streams read folders of files;
readers handle ragged and multi-line input; the entry works without llm."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from panelstat.operators import estimators as est
from panelstat.operators import evaluation as ev
from panelstat.operators import lookups as lk
from panelstat.operators import records as rec
from panelstat.plans.catalog_stream import stream_table
from panelstat.sources import readers
from panelstat.streaming.decode import run_available


@pytest.fixture
def partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    yield lambda n: spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("n,weight,median", [(20, 1 / 3, 10.0), (30, 0.1, 15.0)])
def test_medians_of_equal_weights(spark, partitions, n, weight, median):
    got = set()
    for parts in (1, 2, 3, 5, 8):
        partitions(parts)
        df = spark.range(1, n + 1).repartition(parts).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("v"),
                                                             F.lit(weight).alias("w"))
        got.add(est.weighted_median(df, ["g"], "v", "w").first()["median"])
    assert got == {median}


@pytest.mark.parametrize("top_n", [1, None])
def test_ties_go_by_the_category(spark, partitions, top_n):
    rows = [("g", c, w) for c, ws in (("b", (.1, .2, .3)), ("a", (.3, .2, .1))) for w in ws]
    for parts in (1, 3, 8):
        partitions(parts)
        df = spark.createDataFrame(rows, "g string, c string, w double").repartition(parts)
        got = est.weighted_distribution(df, ["g"], "c", "w", top_n=top_n).where("rank = 1").collect()
        assert [(r["category"], r["share"]) for r in got] == [("a", 0.5)]


def test_unweighted_shares_of_all_rows(spark):
    rows = [("g", c) for c in ["x", "x", "y", None, None, "z", "z", "z"]]
    df = spark.createDataFrame(rows, "g string, c string")
    full = {r["category"]: (r["rank"], r["share"]) for r in est.distribution(df, ["g"], "c").collect()}
    assert full == {"z": (1, 0.375), "x": (2, 0.25), "y": (3, 0.125)}
    top = {r["category"]: r["share"] for r in est.distribution(df, ["g"], "c", top_n=1).collect()}
    assert top == {"z": 0.375, "other": 0.375}
    assert {r["category"]: r["share"] for r in est.distribution(df, [], "c").collect()} == {"z": .375, "x": .25, "y": .125}


def test_stream_reads_a_folder_of_parts(spark, tmp_path):
    spark.range(600).repartition(6).write.parquet(str(tmp_path / "numbers.parquet"))
    spark.range(40).coalesce(1).write.parquet(str(tmp_path / "one"))
    part = next(f for f in os.listdir(tmp_path / "one") if f.endswith(".parquet"))
    os.rename(tmp_path / "one" / part, tmp_path / "single.parquet")
    for name, n in (("numbers", 600), ("single", 40)):
        assert spark.read.parquet(run_available(stream_table(spark, str(tmp_path), name), name)).count() == n


def test_one_bad_request_costs_one_row(spark):
    reqs = ev.build_requests(spark.range(50).select("id", F.col("id").cast("string").alias("query")).coalesce(1), ["gpt-x"])

    def answer(pdf):
        if (pdf["id"] == 7).any():
            raise RuntimeError("no")
        return pdf["query"]
    got = {r["id"]: (r["response"], r["error"]) for r in ev.run_batch(reqs, answer).collect()}
    assert got.pop(7) == (None, "RuntimeError: no")
    assert all(v == (str(k), None) for k, v in got.items())


def test_value_labels_of_any_size(spark):
    labels = spark.range(20_000).select(F.lit("c").alias("column"), F.col("id").cast("string").alias("code"),
                                        F.concat(F.lit("label "), F.col("id").cast("string")).alias("label"))
    df = spark.createDataFrame([(19_999, "x"), (20_000, "y"), (None, "z")], "c int, d string")
    got = {r["d"]: r["c"] for r in lk.apply_value_labels(df, labels, ["c", "absent"]).collect()}
    assert got == {"x": "label 19999", "y": "20000", "z": None}


def test_json_layouts(spark, tmp_path):
    texts = {"object": '\n{\n "a": 1\n}', "array": '[{"a": 1},\n {"a": 2}]', "lines": '\n{"a": 1}\n{"a": 2}\n', "one": '{"a": 3}'}
    got = {}
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
        got[name] = sorted(r["a"] for r in readers.read_any(spark, str(tmp_path / f"{name}.json")).collect())
    assert got == {"object": [1], "array": [1, 2], "lines": [1, 2], "one": [3]}


@pytest.mark.parametrize("columns", [["a", "b", "c"], ["a"], ["c"]])
def test_tolerant_csv_whatever_is_asked_for(spark, tmp_path, columns):
    path = tmp_path / "x.csv"
    path.write_text("a,b,c\n1,2,3\n4,5\n6,7,8,9\n10,11,\n12,13,14,\n")
    got = readers.read_csv_records(spark, str(path), columns, tolerant=True).collect()
    want = [{"a": "1", "b": "2", "c": "3"}, {"a": "4", "b": "5", "c": None}, {"a": "10", "b": "11", "c": None}]
    assert [r.asDict() for r in got] == [{c: w[c] for c in columns} for w in want]


def test_signatures_without_reading_whole_files(spark, tmp_path):
    for name, data in (("a.pdf", b"%PDF-1.7\n\xff\xfe"), ("b.pdf", b"<html>\n%PDF"), ("c.pdf", b"")):
        (tmp_path / name).write_bytes(data)
    got = {r["path"].rpartition("/")[2]: r["ok"] for r in readers.valid_files(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": True, "b.pdf": False}


def test_codes_are_trimmed_before_the_last_wins(spark, tmp_path):
    (tmp_path / "c.csv").write_text("Code,Name\n11,first\n 11,second\n12 ,other\n")
    got = {r["code"]: r["label"] for r in readers.read_codebook_csv(spark, str(tmp_path / "c.csv")).collect()}
    assert got == {"11": "second", "12": "other"}


def test_no_break_spaces_and_months(spark):
    texts = ["18TH MARCH, 2025", "TUESDAY, MARCH 18, 2025", "3RD MAYS, 2024", "3RD JANX, 2024"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(rec.normalise_date("t")).collect()] == ["18/03/2025", "18/03/2025", "03/05/2024", "03/01/2024"]
    part = spark.createDataFrame([("(a) & (b) : yes",)], "t string").select(rec.answer_parts("t").alias("p")).first()["p"]
    assert [(list(p["markers"]), p["text"]) for p in part] == [(["a", "b"], "yes")]


def test_question_numbers_can_be_lenient(spark):
    df = spark.createDataFrame([("4000",), ("4001",), ("99999999999999",), ("x",), (None,)], "q string")
    assert [r[0] for r in df.select(rec.question_files("q", strict=False)).collect()] == [[1], None, None, None, None]


def test_entry_without_the_training_data_operators():
    code = """
import importlib.abc, sys
class Gone(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path, target=None):
        if name in ("panelstat.llm", "corpus_pipeline"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert len(e.queries()) > 90 and not [q for q in e.queries() if q.startswith("op") or q == "pipeline"]
assert set(e.oracle_sql()) <= set(e.queries())
"""
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=here, check=True)


def test_page_files_lie_in_one_folder(spark):
    """A file per page without a folder per page."""
    import glob

    from panelstat.plans.catalog_sources import q_read_documents
    from panelstat.session import checkpoint_dir
    from tests.conftest import SMOKE

    pages = spark.read.parquet(f"{SMOKE}/pages.parquet").count()
    folders = checkpoint_dir(spark).removeprefix("file:") + "/tables/page-files-*"
    before = set(glob.glob(folders))
    assert q_read_documents(spark, SMOKE).agg(F.sum("files")).first()[0] == pages
    (folder,) = set(glob.glob(folders)) - before
    assert not [p for p in os.listdir(folder) if os.path.isdir(f"{folder}/{p}")]
    assert len(glob.glob(f"{folder}/part-*.txt")) == pages


def test_files_of_rows_keep_names_and_texts(spark, tmp_path):
    """Names that repeat, are hidden from readers, hold slashes or are null; texts that are null or have no line."""
    from panelstat.sources import sinks

    path = str(tmp_path / "files")
    given = [("a", "x"), ("a", "x"), ("a", "é\ny"), ("_b/c d", "z"), (".e", ""), (None, "n"), ("f", None)]
    df = spark.createDataFrame(given, "name string, value string").coalesce(2)
    assert sinks.write_files(df, path) == len(given)
    docs = readers.read_documents(spark, path).collect()
    assert sorted(d["text"] for d in docs) == sorted((text or "") + "\n" for _, text in given)
    assert sorted(f.rsplit("-", 2)[0] for f in os.listdir(path)) == ["", "%2Ee", "%5Fb%2Fc%20d", "a", "a", "a", "f"]
    assert sinks.write_files(df.limit(0), str(tmp_path / "none")) == 0
    # a second attempt leaves the same files
    before = {f: open(f"{path}/{f}", "rb").read() for f in os.listdir(path)}
    assert sinks.write_files(df, path) == len(given)
    assert {f: open(f"{path}/{f}", "rb").read() for f in os.listdir(path)} == before


def test_signatures_of_names_with_blanks(spark, tmp_path):
    for name in ("a b.pdf", "c+d.pdf", "e%20f.pdf", "é#?.pdf"):
        (tmp_path / name).write_bytes(b"%PDF-1.7\n")
    got = {r["path"].rpartition("/")[2]: r["ok"] for r in readers.valid_files(spark, str(tmp_path)).collect()}
    assert got == {"a b.pdf": True, "c+d.pdf": True, "e%20f.pdf": True, "é#?.pdf": True}


def test_valid_files_needs_no_folder_per_page(spark, tmp_path):
    """A file per row of the table in one folder, listed once; a page that stands twice has two files."""
    import glob

    from panelstat.plans.catalog_sources import q_valid_files
    from panelstat.session import checkpoint_dir

    pages = [(0, "a"), (1, "b"), (1, "b"), (2, None), (-3, "c"), (10, "%PDF")]
    spark.createDataFrame(pages, "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    folders = checkpoint_dir(spark).removeprefix("file:") + "/tables/signed-files-*"
    before = set(glob.glob(folders))
    got = q_valid_files(spark, str(tmp_path))
    assert sorted((r["name"], r["ok"]) for r in got.collect()) == sorted((f"page-{k}", k % 4 != 1 or k < 0) for k, _ in pages)
    (folder,) = set(glob.glob(folders)) - before
    assert all(os.path.isfile(f"{folder}/{p}") for p in os.listdir(folder))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1


def test_requests_of_one_row_group_go_to_all_cores(spark, tmp_path):
    """A file of many splits whose rows are all in one of them."""
    from panelstat.plans.catalog_eval import q_run_batch, q_run_until_failure

    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.col("id").alias("n_chars"))
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "1k")
    try:
        for query, least in ((q_run_batch, 10_000), (q_run_until_failure, 4000)):
            tasks = query(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
            assert sum(r["count"] for r in tasks) >= least
            if query is q_run_batch:
                assert len(tasks) >= spark.sparkContext.defaultParallelism
                assert max(r["count"] for r in tasks) <= 5000
    finally:
        spark.conf.set(key, before)

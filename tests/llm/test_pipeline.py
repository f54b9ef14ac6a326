"""The pipeline's stages, each on its own input, against brute force."""

import random

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from panelstat.llm import quality as Q
from panelstat.llm import mixing
from panelstat.llm.mixing import mix_positions
from panelstat.session import materialize

from .test_copies import brute_components, lowered

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """Name of each stage to (rows in, rows out)."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        made = materialize(stage(spark, docs, SF), name)
        out[name] = ([r.asDict() for r in docs.collect()], [r.asDict() for r in made.collect()], made.columns)
        docs = made
    return out


def ids(rows):
    return sorted(r["doc_id"] for r in rows)


def test_stages_are_registered():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_copies", "near_copies", "mix", "pieces"]
    names = list(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_rows_pass_whole(stages):
    for name, (before, after, columns) in stages.items():
        assert columns[:5] == COLUMNS and (columns == COLUMNS or name == "pieces")
        was = {r["doc_id"]: r for r in before}
        assert all({c: r[c] for c in COLUMNS} == was[r["doc_id"]] for r in [
            {c: a[c] for c in COLUMNS} for a in after] if set(was[r["doc_id"]]) == set(COLUMNS))


def test_quality_stage(spark, stages):
    before, after, _ = stages["quality"]
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scores = Q.quality_scores(docs, Q.fit(docs, labels)).where("predicted = 1").collect()
    assert ids(after) == sorted(r["doc_id"] for r in scores)
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    # this table has some 65 labelled rows to learn from and keeps 73 of 76 good ones; 0.95 of held-out rows
    # of the larger table are asked for in test_models.py
    assert len(good & set(ids(after))) >= 0.9 * len(good)


def test_exact_stage(stages):
    before, after, _ = stages["exact_copies"]
    last = {}
    for r in before:
        last[lowered(r["text"])] = max(r["doc_id"], last.get(lowered(r["text"]), -1))
    assert ids(after) == sorted(last.values())


def test_near_stage(stages):
    before, after, _ = stages["near_copies"]
    parts = brute_components([(r["doc_id"], r["text"]) for r in before], 5, 80)
    assert ids(after) == sorted({c for _, _, c in parts})


def test_mix_stage(spark, stages):
    before, after, _ = stages["mix"]
    assert ids(before) == ids(after)
    docs = spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in before], "doc_id long, text string, lang string, source string, n_chars long")
    order = [r["doc_id"] for r in mix_positions(docs).orderBy("position").collect()]
    assert sorted(order) == ids(after)


def test_the_mix_decides_the_result(spark, make):
    """Each source's share of the pipeline's rows, in their order, is within
    one block of its weight for as long as every source has rows."""
    counts = {"src0": 60, "src1": 9, "src2": 9, "src5": 5, "src10": 3, None: 9}  # blocks; src0 has far more than its share
    sources = [s for s, n in counts.items() for _ in range(n * mixing.BLOCK)]
    docs = make([(7 * i % 100003, "text", s) for i, s in enumerate(sources)]).repartition(5)
    stages = dict(corpus_pipeline.STAGES)
    quota = {s: mixing.SHARES.get(s, mixing.OTHER) for s in counts}

    def worst(rows):
        sent, most = dict.fromkeys(quota, 0), 0
        for t, r in enumerate(rows, 1):
            sent[r["source"]] += 1
            most = max(most, *(abs(n - t * quota[s] / sum(quota.values())) for s, n in sent.items()))
        return most

    def result(before):
        made = materialize(stages["pieces"](spark, materialize(before, "mix-test"), SF), "pieces-test")
        rows = sorted(made.repartition(3).select("doc_id", "source", "mix_order", "in_mix").collect(), key=lambda r: r["mix_order"])
        assert [r["mix_order"] for r in rows] == list(range(len(sources)))
        return rows

    rows = result(stages["mix"](spark, docs, SF))
    want = mix_positions(docs).orderBy("position").collect()
    assert [(r["doc_id"], r["in_mix"]) for r in rows] == [(r["doc_id"], r["in_mix"]) for r in want]
    live = [r for r in rows if r["in_mix"]]
    assert len(live) > 40 * mixing.BLOCK and worst(live) <= mixing.BLOCK
    assert worst(result(docs)[:len(live)]) > mixing.BLOCK  # without the stage


def test_pieces_stage(stages):
    before, after, _ = stages["pieces"]
    assert ids(before) == ids(after) and all(r["sp_round_trip"] and len(r["sp_piece_ids"]) == 4 * r["sp_n_pieces"] for r in after)


@pytest.mark.parametrize("rows", ["odd", "empty"])
def test_stages_take_odd_and_empty_tables(spark, odd, empty, rows):
    docs = odd if rows == "odd" else empty
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        made = materialize(stage(spark, docs, SF), name)
        assert made.columns[:len(columns)] == columns
        if name != "quality":  # what is kept of odd texts is the classifier's matter, and tested with it
            docs = made
    # empty texts, repeated and equal rows and the near copy 7 are gone: 2, 3, 5, 5, 6, 8 and the row without an id stay
    assert docs.count() == (0 if rows == "empty" else 7)


@pytest.mark.parametrize("name", ["op4_mix_sources", "op7_exact_dedup", "op10_license_scan"])
def test_oracle_parity(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    got = entry.queries()[name](spark, SF)
    want = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))

"""Token ids, Simple-8b, token files, section counts."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st

from panelstat.llm import simple8b, token_counts, token_files
from panelstat.llm.bpe import ByteBpe
from panelstat.session import shared_path

from .conftest import ODD

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = "aAbZ  \n\n\t .,!'s't123é²½٣世ß  \x1c\x85\x00😀_-Ωа"


@pytest.fixture(scope="module")
def bpe():
    return ByteBpe(VOCABULARY, memo_units=50)


def library_ids(bpe, text):
    return bpe.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_library_on_random_texts(bpe):
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 15)))
        assert np.frombuffer(bpe.encode(text), "<u4").tolist() == library_ids(bpe, text), repr(text)
    for text in ("a <|endoftext|> b", "<|endoftext|>", " lead", "\nline\n\nline  ", "x" * 3000):
        assert np.frombuffer(bpe.encode(text), "<u4").tolist() == library_ids(bpe, text)


def test_ids_of_a_vocabulary_with_another_pre_tokeniser():
    words = ByteBpe(public_tokenizers.path("word_bpe_49k.json"), memo_units=50)
    rng = random.Random(4)
    for text in ["", "Hello  World 123's", "É x\n\ny"] + ["".join(rng.choices(ALPHABET, k=12)) for _ in range(300)]:
        assert np.frombuffer(words.encode(text), "<u4").tolist() == library_ids(words, text), repr(text)
    with pytest.raises(ValueError):
        words.byte_lengths


def test_memo_keeps_what_is_asked_often(bpe):
    text = " ".join(f"often w{i} often" for i in range(400))
    for _ in range(2):
        assert np.frombuffer(bpe.encode(text), "<u4").tolist() == library_ids(bpe, text)
    assert len(bpe.units) <= 50 and len(bpe.units.former) <= 50


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=400),
       st.integers(0, 3))
def test_simple8b_round_trip(values, blocks):
    values = np.concatenate([np.array(values, dtype=np.uint64), np.arange(blocks * 4000, dtype=np.uint64)])
    words, starts = simple8b.encode(values)
    assert (simple8b.decode(words, len(values), starts) == values).all()
    for b in range(1, len(starts)):  # any block on its own
        last = starts[b + 1] if b + 1 < len(starts) else len(words)
        part = values[b * simple8b.BLOCK:(b + 1) * simple8b.BLOCK]
        assert (simple8b.decode(words[starts[b]:last], len(part), np.array([0])) == part).all()


def expected_files(bpe, rows):
    out, start = [], 0
    for doc_id, text in rows:
        ids = np.array(library_ids(bpe, text) + [0], dtype="<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), ids.tolist()))
        start += len(ids)
    return out


def test_token_files_against_brute_force(spark, bpe):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    path = shared_path(spark, "test-files")
    manifest = token_files.write_token_files(docs.repartition(5), path, VOCABULARY)
    assert len(manifest) > 1
    got = [tuple(r) for r in token_files.read_token_files(spark, path).orderBy("start").collect()]
    assert got == expected_files(bpe, sorted((r["doc_id"], r["text"]) for r in docs.collect()))


def test_token_files_of_odd_rows(spark, odd, bpe):
    path = shared_path(spark, "test-files")
    token_files.write_token_files(odd, path, VOCABULARY)
    got = token_files.read_token_files(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, None, 1, 2, 3, 4, 5, 5, 5, 6, 7, 8]
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got])[:-1].tolist()
    texts = sorted(library_ids(bpe, r[1]) + [0] for r in ODD)
    assert sorted(r["ids"] for r in got) == texts


def test_token_files_of_an_empty_table(spark, empty):
    path = shared_path(spark, "test-files")
    assert token_files.write_token_files(empty, path, VOCABULARY) == []
    assert token_files.read_token_files(spark, path).count() == 0


def brute_sections(bpe, text, spans, rule):
    counts = dict.fromkeys(range(len(spans)), 0.0)
    for a, b in bpe.tokenizer.encode(text, add_special_tokens=False).offsets:
        if rule == "start":
            for k, (_, lo, hi) in enumerate(spans):
                counts[k] += lo <= a < hi
            continue
        shares = [max(0, min(b, hi) - max(a, lo)) for _, lo, hi in spans]
        if rule == "split":
            for k, s in enumerate(shares):
                counts[k] += s / (b - a)
        elif max(shares, default=0):
            counts[shares.index(max(shares))] += 1
    return [counts[k] for k in range(len(spans))]


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_section_counts_against_the_library_offsets(bpe, rule):
    rng = random.Random(5)
    lengths = bpe.byte_lengths
    for _ in range(400):
        text = "".join(rng.choice("abc the  \n.,éß123 ing") for _ in range(rng.randint(0, 40)))
        cuts = sorted(rng.randint(0, len(text)) for _ in range(rng.randint(0, 6)))
        spans = [(str(k), a, b) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if rng.random() < 0.8]
        ids = np.frombuffer(bpe.encode(text), np.uint32)
        starts, ends = token_counts.token_spans(text, ids, lengths)
        lo, hi = (np.array([s[j] for s in spans], dtype=np.int64) for j in (1, 2))
        counts, _, outside = token_counts.attribute(starts, ends, lo, hi, rule)
        # é and ß are split in two tokens at most; the library's offsets are then those of the character
        assert counts.tolist() == pytest.approx(brute_sections(bpe, text, spans, rule)), (text, spans)
        assert counts.sum() + outside == pytest.approx(len(ids))


def test_crossing_tokens():
    starts, ends = np.array([0, 3, 8]), np.array([3, 8, 9])
    lo, hi = np.array([0, 4]), np.array([4, 9])
    for rule, want in (("most", [1, 2]), ("start", [2, 1]), ("split", [1.2, 1.8])):
        counts, crossing, outside = token_counts.attribute(starts, ends, lo, hi, rule)
        assert counts.tolist() == pytest.approx(want) and crossing.tolist() == [1, 1] and outside == pytest.approx(0)


def test_section_tokens_of_odd_rows(spark, odd, empty, bpe):
    got = token_counts.section_tokens(odd, VOCABULARY)
    per_doc = got.groupBy("doc_id").sum("n_tokens").collect()
    want: dict = {}
    for doc_id, text, *_ in ODD:
        want[doc_id] = want.get(doc_id, 0) + len(library_ids(bpe, text))
    assert {r[0]: r[1] for r in per_doc} == want
    assert got.where("doc_id = 2").collect()[0][1:] == ("0", 0, 0, 0.0, 0)
    assert token_counts.section_tokens(empty, VOCABULARY).count() == 0


def test_section_tokens_of_given_spans(spark):
    df = spark.createDataFrame([(1, "title body text here", [("title", 0, 5), ("body", 6, 99)]), (2, "none", None)],
                               "doc_id long, text string, fields array<struct<name:string,start:int,end:int>>")
    got = {(r["doc_id"], r["section"]): r["n_tokens"]
           for r in token_counts.section_tokens(df, VOCABULARY, spans_col="fields").collect()}
    assert got == {(1, "title"): 1.0, (1, "body"): 3.0, (2, None): 1.0}


def test_odd_spans(spark):
    text = "title body text here"
    fields = {1: [("all", None, None)], 2: [("late", 6, None), None, ("early", None, 5)], 3: [("back", 9, 4), ("far", 50, 60)],
              4: [("b", 5, 15), ("a", 0, 10)], 5: [("in", 0, 5), ("in", 0, 20)], 6: [(None, -3, 5)]}
    df = spark.createDataFrame([(i, text, f) for i, f in fields.items()],
                               "doc_id long, text string, fields array<struct<name:string,start:int,end:int>>")
    got = {}
    for r in token_counts.section_tokens(df, VOCABULARY, spans_col="fields").orderBy("start", "end").collect():
        got.setdefault(r["doc_id"], []).append((r["section"], r["start"], r["end"], r["n_tokens"]))
    assert got[1] == [("all", 0, 20, 4.0)]
    assert [s for s in got[2] if s[0]] == [("early", 0, 5, 1.0), ("late", 6, 20, 3.0)]
    assert sorted(got[3], key=str) == sorted([(None, None, None, 4.0), ("back", 9, 9, 0.0), ("far", 20, 20, 0.0)], key=str)
    assert [s for s in got[4] if s[0]] == [("a", 0, 10, 2.0), ("b", 10, 15, 1.0)]
    assert got[5] == [("in", 0, 5, 1.0), ("in", 5, 20, 3.0)]
    assert (None, 0, 5, 1.0) in got[6]
    for rows in got.values():
        assert sum(r[3] for r in rows) == 4.0

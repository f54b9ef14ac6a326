"""Quality classifier, mixing, edit fingerprints, piece transducer."""

import hashlib
import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from panelstat.llm import edit_fingerprint as E, mixing as M, quality as Q
from panelstat.llm.piece_transducer import MARK, PieceTransducer, encode_pieces, with_pieces

from .conftest import ODD

SMALL = "/root/testdata/sf0.01"
MODEL = public_tokenizers.path("piece_bpe_32k.model")


# quality classifier

@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, Q.fit(docs, labels)


def test_held_out_accuracy(fitted):
    docs, labels, model = fitted
    got = Q.quality_scores(docs, model).join(labels, "doc_id").toPandas()
    assert (got["held_out"] == got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    aside = got[got["held_out"]]
    assert (aside["predicted"] == aside["quality"]).mean() >= 0.95
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.7) == (got["predicted"] == 1)).all()


def test_held_out_good_documents_are_kept(fitted):
    """The bound that the smallest table has too few labels for."""
    docs, labels, model = fitted
    kept = Q.keep_quality(docs, model).select("doc_id")
    good = labels.where((F.col("quality") == 1) & Q.held_out(F.col("doc_id"))).join(docs.select("doc_id"), "doc_id")
    n, stay = good.count(), good.join(kept, "doc_id", "left_semi").count()
    print("held-out good documents:", n, "kept:", stay)
    assert n >= 50 and stay >= 0.97 * n


def test_held_out_labels_are_never_read(fitted):
    docs, labels, model = fitted
    flipped = labels.withColumn("quality", F.when(Q.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = Q.fit(docs, flipped)
    texts = [r["text"] for r in docs.select("text").limit(50).collect()]
    assert np.array_equal(model.scores(texts), other.scores(texts))


def test_word_vectors_do_not_depend_on_the_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert np.array_equal(Q.word_vectors(docs.repartition(1)), Q.word_vectors(docs.repartition(7)))


def test_quality_of_odd_rows(spark, odd, empty, fitted):
    _, _, model = fitted
    got = Q.quality_scores(odd, model).collect()
    assert sorted((r["doc_id"] for r in got), key=str) == sorted((r[0] for r in ODD), key=str)
    assert all(0 <= r["score"] <= 1 for r in got) and not [r for r in got if r["doc_id"] is None and r["held_out"]]
    kept = Q.keep_quality(odd, model)
    assert kept.schema == odd.schema
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((r["doc_id"] for r in got if r["predicted"]), key=str)
    assert Q.quality_scores(empty, model).count() == Q.keep_quality(empty, model).count() == 0
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    assert Q.fit(odd, none).scores(["any", None]).tolist() == [1.0, 1.0]
    assert Q.fit(empty, none).scores([""]).tolist() == [1.0]


# mixing

@pytest.mark.parametrize("shares", [[5, 3, 1], [20] + [8] * 4 + [4] * 5 + [2] * 10, [1], [7, 7, 7, 2], [1000, 1, 1]])
def test_pfair_windows_and_deviation(shares):
    period, sent = sum(shares), [0] * len(shares)
    for i, k, slot, release, deadline in M.pfair_period(shares):
        assert k == sent[i] and release <= slot < deadline
        sent[i] += 1
        for j, q in enumerate(shares):
            assert abs(sent[j] - (slot + 1) * q / period) < 1
    assert sent == shares


def test_mixture_keeps_the_weights(make):
    rng = random.Random(1)
    rows = [(i, "t", rng.choice(["src0"] * 6 + ["src1", "src2", None, "odd"])) for i in range(3000)]
    got = M.mix_positions(make(rows), {"src0": 5, "src1": 2, "absent": 9}, 3, block=10).collect()
    assert len(got) == len(rows) and len({r["position"] for r in got}) == len(rows)
    quota, by = {"src0": 5, "src1": 2, None: 3}, defaultdict(list)
    for r in got:
        by[r["source"] if r["source"] in quota else None].append(r)
    for name, mine in by.items():
        assert sorted(r["rank"] for r in mine) == list(range(len(mine)))
        want = sorted(mine, key=lambda r: (hashlib.md5(str(r["doc_id"]).encode()).hexdigest(), r["doc_id"]))
        assert [r["rank"] for r in want] == list(range(len(mine)))
    slots = {r["slot"]: r["source"] if r["source"] in quota else None for r in got}
    live = max(r["slot"] for r in got if r["in_mix"]) + 1
    assert set(range(live)) <= set(slots) and live not in slots
    sent = dict.fromkeys(quota, 0)
    for t in range(live):
        sent[slots[t]] += 1
        for name, q in quota.items():
            assert abs(sent[name] - (t + 1) * q / 10) < 1


def test_mixing_odd_rows(odd, empty):
    got = M.mix_positions(odd).collect()
    assert sorted((r["doc_id"] for r in got), key=str) == sorted((r[0] for r in ODD), key=str)
    assert len({r["position"] for r in got}) == len(ODD)
    rows = M.mixed(odd, block=1)
    assert rows.schema == odd.schema
    place = {(r["doc_id"], r["source"]): r["position"] for r in M.mix_positions(odd, block=1).collect()}
    order = [place[r["doc_id"], r["source"]] for r in rows.collect()]
    assert len(order) == len(ODD)
    assert order == sorted(order) or len(set(place)) < len(ODD)
    assert M.mix_positions(empty).count() == M.mixed(empty).count() == 0
    with pytest.raises(ValueError):
        M.mix_positions(odd, {"src0": M.PERIOD_MOST}, 1)


# edit fingerprints

def brute_edits(rows):
    """(id, text) rows in order."""
    out = []
    for k, (i, text) in enumerate(rows):
        following, half = rows[(k + 1) % len(rows)][1], len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        a, b, c = E.fingerprint(text), E.fingerprint(edited), E.fingerprint(following)
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, E.likeness(a, b), E.likeness(a, c)))
    return out


@pytest.mark.parametrize("parts", [1, 5])
def test_edits_against_brute_force(spark, parts):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(parts)
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), reverse=True)
    assert sorted(tuple(r) for r in E.fingerprint_edits(docs).collect()) == sorted(brute_edits(rows))


def test_edits_of_odd_rows(make, empty):
    rows = [(3, "x" * 500), (None, None), (9, ""), (-4, "héllo wörld 世界 \U0001F600" * 9), (7, None), (12, "tail of it" * 30)]
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    got = E.fingerprint_edits(make([(i, t, "s") for i, t in rows])).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(brute_edits(ordered), key=str)
    assert E.fingerprint_edits(empty).count() == 0
    assert len(E.fingerprint_edits(make([(1, "alone here", "s")])).collect()) == 1


def test_repeated_ids_are_all_there(odd):
    got = E.fingerprint_edits(odd).collect()
    assert sorted((r["doc_id"] for r in got), key=str) == sorted((r[0] for r in ODD), key=str)


def test_likeness_follows_edits():
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefgh ") for _ in range(4000))
    other = "".join(rng.choice("abcdefgh ") for _ in range(4000))
    slight = text[:1000] + "zz" + text[1003:]
    half = text[:2000] + other[:2000]
    prints = [E.fingerprint(t) for t in (text, slight, half, other)]
    like = [E.likeness(prints[0], p) for p in prints]
    assert like[0] == 1.0 and like[1] > 0.9 > 0.65 > like[2] > 0.4 > 0.3 > like[3]
    assert E.likeness(E.fingerprint(""), E.fingerprint("")) == 1.0
    across = E.likeness(E.fingerprint(text[:2040]), E.fingerprint(text[:2060]))  # either side of a level
    assert across > 0.9


def test_near_groups(make):
    rng = random.Random(8)
    rows = []
    for g in range(30):
        base = "".join(rng.choice("abcdefghij ") for _ in range(rng.randint(300, 2500)))
        for c in range(4):
            at = rng.randrange(len(base))
            rows.append((10 * g + c, base if c < 2 else base[:at] + "zz" + base[at + 1:], "s"))
    prints = E.fingerprint_edits(make(rows)).select("doc_id", "fingerprint")
    got = dict(E.near_groups(prints).collect())
    same = [got[10 * g + c] == 10 * g for g in range(30) for c in range(4)]
    assert sum(same) >= 0.9 * len(same)
    assert all(v // 10 == k // 10 for k, v in got.items())


# piece transducer

@pytest.fixture(scope="module")
def pieces():
    return PieceTransducer(MODEL)


def test_ids_equal_the_library(pieces, spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(6)
    texts = ["".join(rng.choice("aAbZthe  \n\n\t .,!'s123é²½世😀_-ΩofMENTing▁") for _ in range(rng.randint(0, 16)))
             for _ in range(3000)]
    texts += [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for text in texts:
        packed = pieces.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == library.encode(text), repr(text)
        assert pieces.decode(packed) == text.replace(MARK, " ")


def merged(cost, text):
    """The merge procedure: the neighbours whose joint piece costs least, the first of equals, become one."""
    symbols = list(text)
    while True:
        joint = [(cost[a + b], k) for k, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in cost]
        if not joint:
            return symbols
        k = min(joint)[1]
        symbols[k:k + 2] = [symbols[k] + symbols[k + 1]]


def test_paths_equal_the_merge_procedure(pieces):
    rng = random.Random(9)
    for _ in range(1500):
        text = "".join(rng.choice("aeinrstхи中ing") for _ in range(rng.randint(1, 25)))
        assert pieces.shortest(text) == merged(pieces.cost, text)


def write_model(path, scores, kind, fallback=True):
    """A model file of the given pieces and scores; ``kind`` is 1 (unigram) or 2 (BPE)."""
    def field(number, value):
        if isinstance(value, int):
            return bytes([number << 3 & 127 | (128 if number > 15 else 0)]) + (bytes([number >> 4]) if number > 15 else b"") + bytes([value])
        if isinstance(value, float):
            return bytes([number << 3 | 5]) + struct.pack("<f", value)
        size = len(value)
        return bytes([number << 3 | 2]) + (bytes([size]) if size < 128 else bytes([size & 127 | 128, size >> 7])) + value

    listed = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(p, s, 1) for p, s in scores.items()]
    listed += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] if fallback else []
    made = [field(1, field(1, p.encode()) + field(2, float(s)) + field(3, t)) for p, s, t in listed]
    made.append(field(2, field(3, kind) + field(35, int(fallback))))
    made.append(field(3, field(1, b"identity") + field(3, 1) + field(4, 0) + field(5, 1)))
    path.write_bytes(b"".join(made))
    return str(path)


@pytest.mark.parametrize("kind", [1, 2])
@pytest.mark.parametrize("fallback", [True, False])
def test_other_models_equal_the_library(tmp_path, kind, fallback):
    """Random models: weighted paths of unigram models; BPE models whose pieces
    came in any order, so that a merge may free a cheaper one."""
    import sentencepiece

    rng = random.Random(10 * kind + fallback)
    for trial in range(60):
        some = {"".join(rng.choice("abcé") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(2, 40))}
        some = sorted({*some, *(MARK + p for p in some if rng.random() < 0.4), "a", "b", MARK})
        rng.shuffle(some)
        # different sums of steps of 1/64, so that no two paths of a text are equal but by chance
        scores = {p: -rng.randint(1, 700) / 64 if kind == 1 else -float(k) for k, p in enumerate(some)}
        model = write_model(tmp_path / f"{kind}-{trial}.model", scores, kind, fallback)
        library, own = sentencepiece.SentencePieceProcessor(model_file=model), PieceTransducer(model, memo=200)
        for _ in range(60):
            text = "".join(rng.choice("aaabbcé d\n世") for _ in range(rng.randint(0, 18)))
            got = np.frombuffer(own.encode(text), "<u4").tolist()
            assert got == library.encode(text), (scores, text)
            if kind == 1:  # every way to cut the text, by plain recursion over its ends
                full, least = own.normalised(text), [0.0]
                for end in range(1, len(full) + 1):
                    least.append(min(least[at] + (own.cost.get(full[at:end], own.unknown_cost if end == at + 1 else np.inf))
                                     for at in range(end)))
                cuts = [arc for word in own.words(full) for arc in own.shortest(word)]
                assert sum(own.cost.get(arc, own.unknown_cost) for arc in cuts) == least[-1]


def test_pieces_of_odd_rows(odd, empty):
    got = encode_pieces(odd, MODEL).collect()
    assert sorted((r["doc_id"] for r in got), key=str) == sorted((r[0] for r in ODD), key=str)
    assert all(r["round_trip"] for r in got)
    assert [r["n_pieces"] for r in got if r["doc_id"] in (1, 2)] == [0, 0]
    assert with_pieces(odd, MODEL, prefix="sp_").columns[:len(odd.columns)] == odd.columns
    assert encode_pieces(empty, MODEL).count() == 0

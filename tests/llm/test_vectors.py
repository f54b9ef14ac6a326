"""Embedding near-duplicates, hard negatives, fill-in-middle, against brute force."""

import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F, types as T

from panelstat.llm import embedding_copies as C, fill_middle as FM, hard_negatives as H

from .conftest import CLASHES, ODD

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())),
                        T.StructField("label", T.IntegerType())]
                       + [T.StructField(c, T.StringType()) for c in CLASHES if c != "label"])


def vectors(spark, rows):
    return spark.createDataFrame([(i, v if v is None else [x if x is None else float(x) for x in v], lab)
                                  + ("clash",) * (len(CLASHES) - 1) for i, v, lab in rows], VECTORS)


def usable(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v)


def near_groups(seed, n, dim, groups):
    """Noise, and groups of near copies about the linking distance."""
    rng = np.random.default_rng(seed)
    rows = list(rng.normal(size=(n, dim)))
    for size, spread in groups:
        centre = rng.normal(size=dim)
        rows += [centre + spread * rng.normal(size=dim) for _ in range(size)]
    labels = rng.integers(0, 4, len(rows))
    return [(i, r.tolist(), int(lab)) for i, (r, lab) in enumerate(zip(rows, labels))]


def brute_components(rows):
    scaled = [np.array(v, float) / max(map(abs, v)) if usable(v) and any(v) else None for _, v, _ in rows]
    units = [v if v is None else v / np.linalg.norm(v) for v in scaled]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            if units[a] is not None and units[b] is not None and len(units[a]) == len(units[b]) and units[a] @ units[b] >= 0.95:
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    least = {}
    for a, (i, _, _) in enumerate(rows):
        if i is not None:
            least[root(a)] = min(i, least.get(root(a), i))
    parts = [least.get(root(a)) for a in range(len(rows))]
    return sorted(((i, n, c, i is not None and i == c) for (i, _, _), n, c in zip(rows, links, parts)), key=str)


def components(df, **how):
    return sorted((tuple(r) for r in C.embedding_components(df, **how).collect()), key=str)


ODD_VECTORS = [
    (1, None, 1), (2, [], 2), (3, [0, 0, 0, 0], 3), (4, [1, None, 0, 0], 1), (5, [float("nan"), 1, 0, 0], 1),
    (6, [float("inf"), 1, 0, 0], 1), (7, [1, 0, 0, 0], 0), (8, [2, 0.1, 0, 0], 0), (9, [1, 0.2, 0, 0], 3),
    (9, [1, 0.2, 0, 0], 3), (9, [0, 0, 1, 0], 2), (10, [0, 0, 1, 0], 2), (11, [1, 0], 1), (12, [1, 0.1], 1),
    (None, [1, 0.1, 0, 0], 0), (None, None, None), (13, [-1, 0, 0, 0], 2), (100, [1, 0, 0, 0], None),
    (200, [1, 0.5, -0.0, 0], 1), (300, [1, 0.5, 0.0, 0], 1), (400, [1e-300, 2e-300, 0, 0], 1), (500, [1e300, 2e300, 0, 0], 1),
]


@pytest.mark.parametrize("dim,groups", [(16, [(40, 0.1), (25, 0.2), (25, 0.22), (1, 0)]), (64, [(60, 0.15), (30, 0.21)]), (3, [])])
def test_links_are_those_of_brute_force(spark, dim, groups):
    rows = near_groups(3, 300 if dim > 3 else 200, dim, groups)
    rows += [(len(rows) + k, rows[k][1], 0) for k in range(0, 12, 3)]  # exact copies
    assert components(vectors(spark, rows)) == brute_components(rows)


def test_small_sample_and_small_blocks_lose_nothing(spark, monkeypatch):
    rows = near_groups(5, 250, 12, [(60, 0.1), (60, 0.24)])
    monkeypatch.setattr(C, "MEMBERS", 16)
    monkeypatch.setattr(C, "QUERIES", 64)
    assert components(vectors(spark, rows).repartition(5), sample=30) == brute_components(rows)


def test_recall_on_the_given_table_is_whole(spark):
    df = spark.read.parquet("/root/testdata/check_h/embeddings.parquet").where("vec_id < 3000")
    got = C.embedding_components(df).toPandas().sort_values("vec_id")
    units = np.stack(df.toPandas().sort_values("vec_id")["embedding"]).astype(float)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    links = (units @ units.T >= 0.95).sum(axis=1) - 1
    assert links.sum() > 1_000 and (got["n_links"].to_numpy() == links).all()


def test_odd_vectors(spark):
    assert components(vectors(spark, ODD_VECTORS)) == brute_components(ODD_VECTORS)
    assert components(vectors(spark, [])) == []
    assert components(vectors(spark, [(1, None, None)])) == [(1, 0, 1, True)]
    single = vectors(spark, ODD_VECTORS).withColumn("embedding", F.col("embedding").cast("array<float>"))
    assert len(components(single)) == len(ODD_VECTORS)


# hard negatives

def brute_negatives(rows, every, k=5, percent=80):
    seen, use = set(), []
    for i, v, lab in sorted((r for r in rows if r[0] is not None and r[2] is not None and usable(r[1])),
                            key=lambda r: (r[0], r[2], [math.floor(256 * x) for x in r[1]])):
        q = [math.floor(256 * x) for x in v]
        if max(map(abs, q)) < H.LARGEST and (i, len(q)) not in seen:
            seen.add((i, len(q)))
            use.append((i, lab, q))
    out = []
    for i, lab, q in use:
        if i % every:
            continue
        others = sorted((-sum(a * b for a, b in zip(q, w)), j, m) for j, m, w in use if j != i and len(w) == len(q))
        for s, j, m in [o for o in others if o[2] == lab][:k]:
            found = [o for o in others if o[2] != lab and percent * -s <= 100 * -o[0] <= 100 * -s][:k]
            out += [(i, j, n + 1, o[1], -s, -o[0]) for n, o in enumerate(found)]
    return sorted(out)


def negatives(df, every, **how):
    got = H.hard_negatives(df, anchors=F.col("vec_id") % every == 0, label=F.col("label"), **how)
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("dim", [1, 5, 32, 70])
def test_negatives_are_those_of_brute_force(spark, dim):
    rows = near_groups(dim, 260, dim, [(30, 0.2), (30, 0.4)])
    rows = [(i, [round(x, 1) for x in v], lab) for i, v, lab in rows]  # ties
    want = brute_negatives(rows, 10)
    assert want and negatives(vectors(spark, rows), 10) == want


def test_negatives_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(H, "ROWS", 20)
    monkeypatch.setattr(H, "ANCHORS", 7)
    rows = near_groups(9, 200, 24, [(50, 0.3)])
    for k, percent in ((5, 80), (2, 30), (40, 95)):
        assert negatives(vectors(spark, rows).repartition(3), 6, k=k, percent=percent) == brute_negatives(rows, 6, k, percent)


def test_negatives_of_odd_vectors(spark):
    assert negatives(vectors(spark, ODD_VECTORS), 1) == brute_negatives(ODD_VECTORS, 1)
    assert negatives(vectors(spark, []), 1) == []
    large = [(i, [1e5 * (i + 1), 3e5 - i, 7.0], i % 3) for i in range(40)]
    assert negatives(vectors(spark, large), 4) == brute_negatives(large, 4)


def test_bounds_hold_and_close_in():
    rng = np.random.default_rng(0)
    q = np.floor(256 * rng.normal(size=(200, 30)))
    exact, wide = q @ q[7], None
    for level in H.summaries(q):
        lower, upper = H.bounds(level, level[7])
        assert (lower <= exact).all() and (exact <= upper).all()
        assert wide is None or (upper - lower).mean() < wide
        wide = (upper - lower).mean()


# fill in the middle

def brute_middle(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    d = hashlib.sha256(("1:" + ("" if doc_id is None else str(doc_id))).encode()).hexdigest()
    h1, h2, h3, h4 = (int(d[k:k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


MORE = [(i, t, "src0") for i, t in enumerate([
    "a<b <P <S <M P> S>", "<", "<P>", "x<M>y", "<P<S<M", "a\nb\r\nc", "\x00\x1f", "éa世b😀😀c", "word", "  ", " x", "ſK"] * 25)]


def test_middles_are_those_of_brute_force(make, odd, empty):
    for df, rows in ((make(MORE), [(i, t) for i, t, _ in MORE]), (odd, [(r[0], r[1]) for r in ODD])):
        got = FM.with_restored(FM.fill_in_middle(df)).collect()
        assert sorted((tuple(r)[:6] for r in got), key=str) == sorted((brute_middle(*r) for r in rows), key=str)
        assert sorted(r["restored"] for r in got) == sorted(t or "" for _, t in rows)
    assert {r["form"] for r in FM.fill_in_middle(make(MORE)).collect()} == {"plain", "psm", "spm"}
    assert FM.with_restored(FM.fill_in_middle(empty)).count() == 0


def test_slices_are_bounded_and_whole(make, monkeypatch):
    monkeypatch.setattr(FM, "BATCH_BYTES", 10)
    got = FM.fill_in_middle(make(MORE).repartition(2))
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute_middle(i, t) for i, t, _ in MORE)

"""Exact dedup and the n-gram Jaccard join."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelstat.llm import jaccard_join as J
from panelstat.llm.components import component_labels
from panelstat.llm.exact_dedup import drop_exact_copies, exact_groups

from .conftest import LOWER_TABLE, ODD


def lowered(text):
    return (text or "").translate(LOWER_TABLE)


def expected_groups(rows):
    sizes, winner = Counter(lowered(t) for _, t in rows), {}
    for i, t in rows:
        k = lowered(t)
        winner[k] = max((x for x in (winner.get(k), i) if x is not None), default=None)
    return sorted(((i, winner[lowered(t)], sizes[lowered(t)], i == winner[lowered(t)],
                    hashlib.sha256(lowered(t).encode()).hexdigest()) for i, t in rows), key=str)


@pytest.mark.parametrize("digest", [None, F.length, lambda c: F.lit("one digest")])
def test_exact_groups_compare_whole_texts(odd, digest):
    """Also with digests under which many different texts collide."""
    got = exact_groups(odd, **({"digest": digest} if digest else {}))
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected_groups([r[:2] for r in ODD])


def test_exact_groups_of_one_hot_text(spark, make):
    rows = [(i, "Hot Text" if i % 3 else f"text {i}", "src0") for i in range(300)]
    got = exact_groups(make(rows).repartition(7), salts=4).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected_groups([r[:2] for r in rows])


def test_drop_exact_copies(odd, empty):
    kept = drop_exact_copies(odd)
    assert kept.columns == odd.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=str)
    # 1 and one null id hold the empty text like 2; the repeated row of 5 is one document
    assert ids == sorted([2, 3, 5, 5, 6, 7, None, 8], key=str)
    assert drop_exact_copies(empty).count() == 0 and exact_groups(empty).count() == 0


def brute_components(rows, size, percent):
    sets = [(i, shingles(t, size)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1:]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), find(i) if i is not None else None) for i, s in sets), key=str)


def shingles(text, size):
    words = lowered(text).encode().split()
    return {tuple(words[k:k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


def near_copies(rng, n_groups, copies, words):
    rows, i = [], 0
    for g in range(n_groups):
        base = [f"g{g}w{k}" for k in range(words)]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randint(0, 2)):
                text[rng.randrange(len(text))] = f"edit{rng.random()}"
            rows.append((i, " ".join(text), "src0"))
            i += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80)])
def test_components_against_brute_force(make, size, percent):
    rng = random.Random(11)
    passage = [f"p{k}" for k in range(60)]
    rows = near_copies(rng, 6, 14, 70)
    # texts that share a passage and little else, chains of slow drift, short texts
    rows += [(1000 + k, " ".join(passage + [f"own{k}x{j}" for j in range(rng.choice([3, 8, 80]))]), "src1") for k in range(25)]
    chain = [f"c{k}" for k in range(80)]
    for k in range(12):
        chain[6 * k % 80] = f"drift{k}"
        rows.append((2000 + k, " ".join(chain), "src1"))
    rows += [(3000 + k, t, "src2") for k, t in enumerate(["a b", "A b", "b a", "a", "a b c d", "a b c d e", "", " "])]
    got = J.jaccard_components(make(rows).repartition(4), size=size, percent=percent).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_components([r[:2] for r in rows], size, percent)


def rows_of(tokens, counts, cut, percent):
    """Signature to (apart, place, among), as the join's rows have them."""
    made, singles, rare = J.signatures(tokens, counts, cut, percent)
    n = len(tokens)
    return {h: (rare, k - singles, n - rare) if k >= singles else (0, k, n) for k, h in enumerate(made.tolist())}


def proven(a, b):
    """Mismatches that the rows of one signature prove."""
    return a[0] + b[0] + abs(a[1] - b[1]) + abs(a[2] - a[1] - b[2] + b[1])


@pytest.mark.parametrize("percent", [80, 85, 95])
def test_every_link_has_a_signature_in_common(percent):
    """Whatever the counter table says is frequent."""
    rng = np.random.default_rng(2)
    met = 0
    for _ in range(3000):
        n = int(rng.integers(1, 60))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        lose, gain = rng.integers(0, max(1, len(a) // 8) + 1, 2)
        b = np.unique(np.concatenate([a[rng.permutation(len(a))[lose:]], rng.integers(0, 2**63, gain).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both < percent * (len(a) + len(b) - both) or np.array_equal(a, b):
            continue
        counts = rng.integers(0, 100, J.CELLS).astype(np.int32)
        cut = int(rng.choice([-1, 0, 5, 30, 70, 95, 100]))
        x, y = (rows_of(s, counts, cut, percent) for s in (a, b))
        allowed = (100 - percent) * (len(a) + len(b)) // (100 + percent)
        assert any(proven(x[h], y[h]) <= allowed for h in set(x) & set(y)), (len(a), len(b), both, cut)
        met += 1
    assert met > 200


def test_components_of_odd_rows(odd, empty):
    got = sorted((tuple(r) for r in J.jaccard_components(odd).collect()), key=str)
    rows = [r[:2] for r in ODD]
    want = brute_components(rows, 5, 80)
    assert [r for r in got if r[0] != 5] == [r for r in want if r[0] != 5]
    assert {r[2] for r in got if r[0] == 5 and r[1] == 4} == {4}  # linked with 4, whatever else has this id
    assert J.jaccard_components(empty).count() == 0
    kept = J.drop_near_copies(odd)
    assert kept.columns == odd.columns and 7 not in {r["doc_id"] for r in kept.collect()}
    assert {6, 4, 1, 2, 3, None, 8} <= {r["doc_id"] for r in kept.collect()}
    assert J.drop_near_copies(empty).count() == 0


def test_one_row_of_each_component_stays_when_ids_repeat(make):
    words = {c: [f"{c}{k}" for k in range(60)] for c in "abcde"}
    near = {c: " ".join(w[:-1]) for c, w in words.items()}  # lacks the last word
    text = {c: " ".join(w) for c, w in words.items()}
    rows = [(5, text["a"]), (7, near["a"]), (5, text["b"]), (3, near["b"]),  # a's least id is dropped in b
            (9, text["c"]), (9, text["c"]), (11, near["c"]),  # equal in id and text
            (5, text["d"]), (5, near["d"]), (12, text["d"]),  # one id, two near texts
            (20, text["e"]), (20, near["a"]), (21, ""), (21, None), (21, " "), (None, text["a"]), (None, text["a"])]
    got = J.drop_near_copies(make([(i, t, "s") for i, t in rows]).repartition(3)).collect()
    kept = sorted(((r["doc_id"], r["text"] or "") for r in got), key=str)
    d = [x for x in kept if x[1] in (text["d"], near["d"])]
    assert len(d) == 1 and d[0][0] == 5
    assert sorted([x for x in kept if x not in d], key=str) == sorted(
        [(5, text["a"]), (3, near["b"]), (9, text["c"]), (20, text["e"]), (21, ""), (21, " "),
         (None, text["a"]), (None, text["a"])], key=str)


def test_component_labels_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = dict(component_labels(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_family_just_below_the_threshold(spark, make, monkeypatch):
    """2,000 texts around one another, most pairs just below the threshold; small
    blocks, so that groups of blocks are compared, too."""
    monkeypatch.setattr(J, "BLOCK", 64)
    rng = random.Random(11)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(2000):
        words = list(base)
        for at in rng.sample(range(120), 3 if i % 50 else 1):
            words[at] = f"x{i}y{at}"
        rows.append((i, " ".join(words), "src0"))
    got = {r["doc_id"]: r["component_id"] for r in J.jaccard_components(make(rows), size=4, percent=80).collect()}
    grams = [frozenset(zip(*(t.split()[k:] for k in range(4)))) for _, t, _ in rows]
    number = {g: n for n, g in enumerate(sorted(set().union(*grams)))}
    held = np.zeros((len(rows), len(number)), np.float32)
    for i, g in enumerate(grams):
        held[i, [number[x] for x in g]] = 1
    both, sizes = held @ held.T, held.sum(axis=1)
    linked = both * 100 >= (sizes[:, None] + sizes - both) * 80
    parent = np.arange(len(rows))
    while True:
        least = np.where(linked, parent, len(rows)).min(axis=1)
        if (least == parent).all():
            break
        parent = least
    assert 1 < len(set(parent)) < len(rows)
    assert [got[i] for i in range(len(rows))] == parent.tolist()


def test_sketches_never_differ_in_more_cells_than_sets():
    rng = np.random.default_rng(4)
    for n, m, common in ((10, 12, 9), (900, 700, 650), (5, 3000, 5), (4000, 4000, 3999), (1, 1, 0)):
        pool = rng.integers(0, 2**63, n + m, dtype=np.uint64)
        a, b = np.unique(pool[:n]), np.unique(np.concatenate([pool[:common], pool[n:n + m - common]]))
        assert J.differing(J.sketch(a), J.sketch(b)) <= len(np.setxor1d(a, b))
        assert J.differing(J.sketch(a), J.sketch(a)) == 0

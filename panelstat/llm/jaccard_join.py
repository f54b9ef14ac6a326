"""N-gram Jaccard join by token-combination prefixes, and its components.

A document is the set of its word n-grams, hashed to 64 bits. All tokens have
one global order: by how many documents hold them, as estimated by a counter
table of fixed size over all documents, then by hash. The rare ones come
first; those that stand out of the table's noise are the frequent class.

Signatures. Let a set of n tokens, r of them rare, link with another at a
Jaccard similarity of t. It lacks at most d = n - ceil(t n) of its own tokens there.

* Single tokens: the rare ones among its first d + 1 tokens.
* If r <= d, pairs of frequent tokens that are neighbours in the order, from an
  extended prefix. Either the two sets share a rare token, which both have
  indexed, or all r rare ones are among the d lacking ones. Then, with D =
  floor(n (1 - t) / t) bounding all mismatches, the first D - r + 2 common
  tokens of both sets stand within the first (d - r) + (D - r + 2) frequent
  ones, and since D - r mismatches can part only so many neighbours, one
  pair of common tokens is adjacent in both sets.

So a link always has a signature in common, while a pair of frequent tokens is
far rarer than either. Positions bound the mismatches of a candidate from below: those
before and those behind the signature, in the whole sets for a single token; for
a pair, in the frequent tokens, and all rare tokens of both sets on top, since
sets that share a rare token also meet there. Candidates with more
mismatches than the threshold allows go. So do those whose parity sketches
differ in more bits: a sketch tells for each cell whether the set has an odd number of tokens
there, so two sketches differ in no more cells than the sets have mismatches. Only
sets of candidates that are left are read. The tables' noise changes how many candidates
there are, never which links are found.

Candidates. Equal sets are one node. Every signature's sets are first compared
with one centre, the set with the largest share of signatures that others have;
links join components. Only signatures whose sets are still in more than
one component then give pairs across components, which are all compared, too. Thus large
groups of near copies need no pairs among themselves, and no link between
components is missed. Comparison is exact on whole sets.

Defined results. Null or empty texts and texts without words: an empty set,
linked with nothing, its own component. Fewer words than n: the whole sequence
is one token. Null ids: never linked, null component. Rows that repeat an id:
each has its own set; links of both join the id's component by value. Equal
texts: one component. Empty table: no rows. Extra columns are not read by
``jaccard_components`` and are kept by ``drop_near_copies``, which leaves
exactly one row of each component of sets, whatever ids its rows share with other
components; of rows that repeat an id and an empty set's text one stays, too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelstat.llm.common import (LOWER_BYTES, Memo, hot_join, materialize, mix64, read_table, summed_table, task_partitions,
                                  worker_memo)
from panelstat.llm.components import component_labels

CELLS = 1 << 20  # of the counter table
BITS_MOST = 1 << 26  # of a broadcast bitmap, which only spares rows a shuffle
MEMO_WORDS = 200_000
BLOCK = 2_048  # sets under one signature that a task compares with as many others
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _word_hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Ascending distinct hashes of the word n-grams of the whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split()
    if not words:
        return np.zeros(0, np.uint64)
    known = worker_memo("word hashes", lambda: Memo(_word_hash, MEMO_WORDS))
    hashes = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(size, len(words))
    grams = np.full(len(words) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        grams = grams * _FACTOR + hashes[k:len(hashes) - width + k + 1]
    return np.unique(mix64(grams))


def signatures(tokens: np.ndarray, counts: np.ndarray, cut: int, percent: int) -> tuple[np.ndarray, int, int]:
    """Single rare tokens and then pairs of neighbouring frequent tokens of the
    (extended) prefix, hashed; the number of singles; the number of rare
    tokens. ``counts`` is the counter table."""
    n = len(tokens)
    seen = counts[(tokens >> np.uint64(44)).astype(np.int64)]
    order = np.lexsort((tokens, seen))
    ordered, rare = tokens[order], int(np.count_nonzero(seen <= cut))
    lacking = n - -(-percent * n // 100)
    singles = ordered[:min(lacking + 1, rare)]
    if rare > lacking:
        return singles, len(singles), rare
    mismatches = max(0, n * (100 - percent) // percent - rare)
    prefix = ordered[rare:rare + (lacking - rare) + mismatches + 2]
    return np.concatenate([singles, mix64(prefix[:-1] * _FACTOR + prefix[1:])]), len(singles), rare


def token_counts(docs: DataFrame, size: int, text_col: str) -> tuple[np.ndarray, int]:
    """The counter table over all documents, and the largest count of the rare class."""
    def count(batch: pa.RecordBatch, table: np.ndarray) -> None:
        held, total = [], 0
        for text in batch.column(0):
            held.append((shingle_set(text.as_py(), size) >> np.uint64(44)).astype(np.int64))
            total += len(held[-1])
            if total > 1 << 20:
                table += np.bincount(np.concatenate(held), minlength=len(table))
                held, total = [], 0
        if total:
            table += np.bincount(np.concatenate(held), minlength=len(table))

    table = summed_table(docs.select(text_col), count, CELLS)
    mean = table.mean()
    return np.minimum(table, 2**31 - 1).astype(np.int32), int(mean + 8 * mean ** 0.5 + 64)


def _bitmap(keys: DataFrame) -> np.ndarray:
    """Packed bits of the column ``key`` modulo a power of two of at most
    BITS_MOST; the driver receives a number per 64 bits, whatever the input."""
    rows = keys.count()
    bits = 1 << 16
    while bits < 16 * rows and bits < BITS_MOST:
        bits *= 2
    cell = F.pmod(F.col("key"), F.lit(bits))
    words = (keys.groupBy(F.shiftright(cell, 6).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(key, 64) as int))")).alias("mask")).toArrow())
    out = np.zeros(bits // 64, dtype=np.int64)
    out[words["word"].to_numpy()] = words["mask"].to_numpy()
    return out.view(np.uint8)


def _marked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the keys may be in a bitmap; none that is fails."""
    cell = keys & (8 * len(bits) - 1)
    return (bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1


def sketch(tokens: np.ndarray) -> bytes:
    """Which of at least half as many cells as there are tokens hold an odd number of them."""
    cells = 256
    while 2 * cells < len(tokens):
        cells *= 2
    return np.packbits(np.bincount((tokens & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1 == 1,
                       bitorder="little").tobytes()


def differing(a: bytes, b: bytes) -> int:
    """In how many cells two sketches differ; the longer one is folded."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    while len(y) > len(x):
        y = y[:len(y) // 2] ^ y[len(y) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches folded to their first 256 cells, a row of four words each."""
    out = np.zeros((len(sketches), 4), np.uint64)
    for k, sketched in enumerate(sketches):
        x = np.frombuffer(sketched, np.uint64)
        out[k] = np.bitwise_xor.reduce(x.reshape(-1, 4), axis=0)
    return out


def _named(pairs: DataFrame, sets: DataFrame):
    """A broadcast bitmap of the documents that stand for the sets that pairs name."""
    named = pairs.select(F.col("u").alias("sid")).unionByName(pairs.select(F.col("v").alias("sid"))).distinct()
    return pairs.sparkSession.sparkContext.broadcast(
        _bitmap(materialize(sets.join(named, "sid").select(F.col("rep").alias("key")), "needed")))


def _both_sides(pairs: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    """The pairs with both sets' columns; shuffled whatever their number: the plan is the same at every size."""
    sides = [rows.select(F.col("sid").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in columns]) for s in "uv"]
    return pairs.join(sides[0].hint("merge"), "u").join(sides[1].hint("merge"), "v")


def _linked(pairs: DataFrame, sets: DataFrame, signed: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (u, v) of set numbers whose sets reach the threshold. First by
    sketches; then texts are read again, of the documents that stand for the sets of a pair."""
    # a document that only shares its bit with a named one meets no pair below
    shared = _named(pairs, sets)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marked = _marked(shared.value, batch.column(0).to_numpy(zero_copy_only=False))
            yield batch.filter(pa.array(marked)).select(["sid", "n", "sketch"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = (batch.column(2).to_numpy() + batch.column(3).to_numpy()) * (100 - percent) // (100 + percent)
            apart = [differing(a.as_py(), b.as_py()) for a, b in zip(batch.column(4), batch.column(5))]
            yield batch.select(["u", "v"]).filter(pa.array(np.array(apart, np.int64) <= most))

    rows = signed.where("doc_id is not null and sid is not null").select("doc_id", "sid", "n", "sketch").mapInArrow(
        pick, "sid long, n long, sketch binary").dropDuplicates(["sid"])
    pairs = materialize(_both_sides(pairs, rows, "n", "sketch").select("u", "v", "u_n", "v_n", "u_sketch", "v_sketch")
                        .mapInArrow(near, "u long, v long"), "near")
    shared.destroy()
    again = _named(pairs, sets)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(_marked(again.value, batch.column(0).to_numpy(zero_copy_only=False))))
            for at in range(0, batch.num_rows, 256):
                found = [shingle_set(t.as_py(), size) for t in batch.column(1).slice(at, 256)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_set_keys(f)[0] for f in found], pa.int64()),
                     pa.array([f.view(np.int64) for f in found], pa.list_(pa.int64()))], names=["sid", "tokens"])

    tokens = docs.where("doc_id is not null").mapInArrow(read, "sid long, tokens array<long>")
    both, least = F.size(F.array_intersect("u_tokens", "v_tokens")).cast("long"), F.size("u_tokens") + F.size("v_tokens")
    return (_both_sides(pairs, tokens, "tokens").withColumn("both", both)
            .where(F.col("both") * 100 >= (least - F.col("both")) * percent).select("u", "v"))


def _across(percent: int):
    """Over groups (sign, i, j) of sets of two blocks, or of one where i = j, sorted:
    pairs of sets of different components within the bounds."""
    def compare(rows: dict[str, np.ndarray], group: np.ndarray) -> Iterator[pa.RecordBatch]:
        at, gap = np.arange(len(group)), 0
        while True:  # every row with the next, with the one behind it, ... of its group
            gap += 1
            at = at[at + gap < len(group)]
            at = at[group[at] == group[at + gap]]
            if not len(at):
                return
            a, b = ({c: v[k] for c, v in rows.items()} for k in (at, at + gap))
            before = np.abs(a["place"] - b["place"])
            behind = np.abs((a["n"] - a["apart"] - a["place"]) - (b["n"] - b["apart"] - b["place"]))
            allowed = (a["n"] + b["n"]) * (100 - percent) // (100 + percent)
            keep = ((a["label"] != b["label"]) & ((a["side"] != b["side"]) | (a["i"] == a["j"]))
                    & (a["apart"] + b["apart"] + before + behind <= allowed))
            keep[keep] = np.bitwise_count(a["fold"][keep] ^ b["fold"][keep]).sum(axis=1) <= allowed[keep]
            for k in np.nonzero(keep & (np.minimum(a["n"], b["n"]) > 512))[0]:  # the fold is too short for these
                keep[k] = differing(a["sketch"][k], b["sketch"][k]) <= allowed[k]
            u, v = a["sid"][keep], b["sid"][keep]
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def marks() -> np.ndarray:
            return np.concatenate([[0], np.cumsum(np.any([np.diff(held[c]) != 0 for c in ("sign", "i", "j")], axis=0))])

        for batch in batches:
            if not batch.num_rows:
                continue
            new = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
            new["fold"] = folded(new["sketch"].tolist())
            held = {c: np.concatenate([held[c], v]) if held else v for c, v in new.items()}
            group = marks()
            cut = int(np.searchsorted(group, group[-1]))  # the last group may go on
            yield from compare({c: v[:cut] for c, v in held.items()}, group[:cut])
            held = {c: v[cut:] for c, v in held.items()}
        if held:
            yield from compare(held, marks())
    return run


def _set_keys(tokens: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit hashes of a set."""
    with np.errstate(over="ignore"):
        first = mix64(np.array([tokens.sum(dtype=np.uint64)]) + np.uint64(len(tokens)))[0]
        second = mix64(tokens ^ _FACTOR).sum(dtype=np.uint64)
    return int(first.view(np.int64)), int(second.view(np.int64))


def _may_link(percent: int) -> Column:
    """Whether the mismatches that sizes and positions prove of the sets of a
    row (n, apart, place) and of another (o_...) leave room for a link.
    ``apart``: rare tokens that a pair of frequent ones proves to differ (0 for
    a single token); ``place``: the signature's position among the others."""
    n, o_n = F.col("n"), F.col("o_n")
    before = F.abs(F.col("place") - F.col("o_place"))
    behind = F.abs((n - F.col("apart") - F.col("place")) - (o_n - F.col("o_apart") - F.col("o_place")))
    allowed = F.floor((n + o_n) * (100 - percent) / (100 + percent) + F.lit(1e-9))
    return ((F.least(n, o_n) * 100 >= F.greatest(n, o_n) * percent)
            & (F.col("apart") + F.col("o_apart") + before + behind <= allowed))


def _placed_rows(df: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """One row per row of ``df``: doc_id, n, the set (sid, key2), its component
    of sets (group, group2; null for an empty set) and component_id."""
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    counts, cut = token_counts(docs, size, "text")
    shared = spark.sparkContext.broadcast(counts)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                ids, sizes, keys, signs, kinds, sketches = batch.column(0).slice(at, 512), [], [], [], [], []
                for doc_id, text in zip(ids, batch.column(1).slice(at, 512)):
                    tokens = shingle_set(text.as_py(), size)
                    linkable = len(tokens) and doc_id.is_valid
                    sizes.append(len(tokens))
                    keys.append(_set_keys(tokens) if linkable else (None, None))
                    made, *kind = signatures(tokens if linkable else tokens[:0], shared.value, cut, percent)
                    signs.append(made.view(np.int64))
                    kinds.append(kind)
                    sketches.append(sketch(tokens) if linkable else None)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(sizes, pa.int64()), pa.array([k[0] for k in keys], pa.int64()),
                     pa.array([k[1] for k in keys], pa.int64()), pa.array(signs, pa.list_(pa.int64())),
                     pa.array([k[0] for k in kinds], pa.int64()), pa.array([k[1] for k in kinds], pa.int64()),
                     pa.array(sketches, pa.binary())],
                    names=["doc_id", "n", "sid", "key2", "signs", "singles", "rare", "sketch"])

    signed = materialize(docs.mapInArrow(
        sign, "doc_id long, n long, sid long, key2 long, signs array<long>, singles long, rare long, sketch binary"), "signed")
    shared.destroy()
    sets = materialize(signed.where("sid is not null").groupBy("sid", "key2").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "sets")

    # which signatures do different sets share?
    common = (signed.where("sid is not null").select(F.explode("signs").alias("key"), "sid")
              .groupBy("key").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi")).where("lo < hi").select("key"))
    bits = spark.sparkContext.broadcast(_bitmap(materialize(common, "common")))
    reps = spark.sparkContext.broadcast(_bitmap(sets.select(F.col("rep").alias("key"))))

    def popular(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each common signature of a set, with the share of its
        signatures that are common; only of rows that may stand for their set."""
        table = bits.value
        for batch in batches:
            batch = batch.filter(pa.array(_marked(reps.value, batch.column(0).to_numpy(zero_copy_only=False))))
            out = []
            sids, sizes, singles, rares = (batch.column(k).to_pylist() for k in range(1, 5))
            for sid, n, single, rare, signs in zip(sids, sizes, singles, rares, batch.column(5)):
                own = signs.values.to_numpy()
                place = np.nonzero(_marked(table, own))[0]
                pair = place >= single
                out.append(np.stack([
                    own[place], np.full(len(place), sid), np.full(len(place), n),
                    np.full(len(place), len(place) * 1000 // max(len(own), 1)), np.where(pair, rare, 0),
                    np.where(pair, place - single, place)]))
            columns = np.concatenate(out, axis=1) if out else np.zeros((6, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    names = ["sign", "sid", "n", "share", "apart", "place"]
    rows = materialize(signed.where("sid is not null").select("doc_id", "sid", "n", "singles", "rare", "signs").mapInArrow(
        popular, ", ".join(f"{c} long" for c in names)), "popular")
    bits.destroy()
    reps.destroy()

    # every signature's sets beside its centre; a set that stands twice gives the same pairs twice
    other = [F.col(c).alias(f"o_{c}") for c in ("sid", "n", "apart", "place")]
    pair = [F.least("sid", "o_sid").alias("u"), F.greatest("sid", "o_sid").alias("v")]
    centres = (rows.groupBy("sign").agg(F.max(F.struct("share", "sid", "n", "apart", "place")).alias("c"),
                                        F.min("sid").alias("lo"), F.max("sid").alias("hi"), F.count(F.lit(1)).alias("held"))
               .where("lo < hi").select("sign", "held", "c.*").select("sign", "held", *other))
    total = rows.count()
    pairs = hot_join(rows.drop("share"), materialize(centres, "centres"), "sign", "held", total)
    pairs = materialize(pairs.where((F.col("sid") != F.col("o_sid")) & _may_link(percent)).select(*pair).distinct(), "centre-pairs")
    edges = materialize(_linked(pairs, sets, signed, docs, size, percent), "links")
    labels = materialize(component_labels(edges), "labels")

    # signatures whose sets are not yet in one component; two sets have been compared by now
    labelled = materialize(rows.join(labels, rows["sid"] == labels["node"], "left").select(
        "sign", "sid", "n", "apart", "place", F.coalesce("label", "sid").alias("label")), "labelled")
    several = (labelled.groupBy("sign").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("held"))
               .where("lo < hi and held > 2").select("sign", "held", F.ceil(F.col("held") / BLOCK).cast("int").alias("blocks")))
    last = F.col("blocks") - 1
    mine = F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")
    beside = F.explode(F.sequence(F.lit(0), last)).alias("other")
    sketches = signed.where("sid is not null").select("sid", "sketch").dropDuplicates(["sid"])
    groups = (hot_join(labelled, materialize(several, "several"), "sign", "held", total).join(sketches, "sid")
              .select("sign", "sketch", mine.alias("own"), beside, "sid", "label", "n", "apart", "place")
              .select("sign", "sketch", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                      (F.col("own") > F.col("other")).cast("int").alias("side"), "sid", "label", "n", "apart", "place"))
    groups = (groups.repartition(task_partitions(spark), "sign", "i", "j").sortWithinPartitions("sign", "i", "j", "side"))
    across = groups.mapInArrow(_across(percent), "u long, v long").distinct().join(pairs, ["u", "v"], "left_anti")
    across = materialize(across, "across")
    if not across.isEmpty():
        more = materialize(_linked(across, sets, signed, docs, size, percent), "links")
        if not more.isEmpty():
            stars = labels.select(F.col("node").alias("u"), F.col("label").alias("v"))
            labels = materialize(component_labels(stars.unionByName(more)), "labels")

    placed = materialize(sets.join(labels, sets["sid"] == labels["node"], "left").select("sid", "key2", "rep", "copies", "label"),
                         "placed")
    least = materialize(placed.where("label is not null").groupBy("label").agg(
        F.min("rep").alias("component"), F.sum("copies").alias("held")), "least")
    total = signed.count()
    linked = hot_join(placed.where("label is not null"), least, "label", "held", total).select(
        "sid", "key2", "copies", F.col("label").alias("group"), F.lit(0).cast("long").alias("group2"), "component")
    alone = placed.where("label is null").select("sid", "key2", "copies", F.col("sid").alias("group"),
                                                 F.col("key2").alias("group2"), F.col("rep").alias("component"))
    parts = materialize(linked.unionByName(alone), "parts")
    ids, none = signed.select("doc_id", "n", "sid", "key2"), F.lit(None).cast("long")
    out = hot_join(ids.where("sid is not null"), parts, ["sid", "key2"], "copies", total).select(
        "doc_id", "n", "sid", "key2", "group", "group2", F.col("component").alias("component_id"))
    return out.unionByName(ids.where("sid is null").select(
        "doc_id", "n", "sid", "key2", none.alias("group"), none.alias("group2"), F.col("doc_id").alias("component_id")))


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5,
                       percent: int = 80) -> DataFrame:
    """One row per row of ``df``: ``id_col``, ``n_shingles`` and
    ``component_id``, the smallest id that is reachable by links of at least
    ``percent`` hundredths Jaccard similarity of ``size``-word shingles."""
    return _placed_rows(df, id_col, text_col, size, percent).select(
        F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def _first_of_repeated(rows: DataFrame, parts: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """Of rows whose ids repeat, those that stay: a row of each component whose
    least id is theirs, and one of each id and text without words."""

    @F.pandas_udf("sid long, key2 long")
    def keys(texts):
        import pandas as pd

        found = [shingle_set(t, size) for t in texts]
        return pd.DataFrame([_set_keys(f) if len(f) else (None, None) for f in found], columns=["sid", "key2"], dtype="Int64")

    keyed = rows.withColumn("__set__", keys(F.col(text_col)))
    first = (parts.where("doc_id = component_id and sid is not null").groupBy("group", "group2")
             .agg(F.min(F.struct("doc_id", "sid", "key2")).alias("first")).select("first.*"))
    with_set = keyed.join(first, (keyed[id_col] == first["doc_id"]) & (keyed["__set__.sid"] == first["sid"])
                          & (keyed["__set__.key2"] == first["key2"]), "left_semi").dropDuplicates([id_col, "__set__"])
    without = (keyed.where("__set__.sid is null").withColumn("__text__", F.coalesce(text_col, F.lit("")))
               .dropDuplicates([id_col, "__text__"]).drop("__text__"))
    return with_set.unionByName(without).drop("__set__")


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5,
                     percent: int = 80) -> DataFrame:
    """One row of each component, that with the smallest id; all columns as
    they were. Ids that stand once decide by themselves, those that repeat
    with their sets. Rows that no dropped or repeated id can match skip the join."""
    parts = materialize(_placed_rows(df, id_col, text_col, size, percent), "components")
    repeated = materialize(parts.where("doc_id is not null").groupBy(F.col("doc_id").alias("key"))
                           .agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("key"), "repeated")
    dropped = materialize(parts.where("doc_id <> component_id").select(F.col("doc_id").alias("key")).distinct()
                          .unionByName(repeated).distinct(), "dropped")
    bits = df.sparkSession.sparkContext.broadcast(_bitmap(dropped))

    @F.pandas_udf("boolean")
    def maybe(ids):
        import pandas as pd

        table = bits.value
        return pd.Series(_marked(table, ids.to_numpy()))

    flagged = F.col(id_col).isNotNull() & maybe(F.coalesce(F.col(id_col).cast("long"), F.lit(0)))
    unsure = df.where(flagged)
    kept = df.where(~flagged).unionByName(unsure.join(dropped, unsure[id_col] == dropped["key"], "left_anti"))
    if repeated.isEmpty():
        return kept
    again = unsure.join(repeated, unsure[id_col] == repeated["key"], "left_semi")
    return kept.unionByName(_first_of_repeated(again, parts.join(repeated, parts["doc_id"] == repeated["key"], "left_semi"),
                                               id_col, text_col, size))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"), size=4, percent=85)


# Brute force in SQL: all pairs that share a shingle, whole intersections.
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS words FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
         ELSE list_distinct(list_transform(range(len(words) - 3), lambda i: array_to_string(words[i + 1:i + 4], ' '))) END AS shingles
  FROM d),
kinds AS (SELECT list_sort(shingles) AS shingles, min(doc_id) AS doc_id, len(list_sort(shingles)) AS n FROM sets
          WHERE len(shingles) > 0 GROUP BY list_sort(shingles)),
tokens AS (SELECT doc_id, n, unnest(shingles) AS shingle FROM kinds),
shared AS (SELECT a.doc_id AS u, b.doc_id AS v, any_value(a.n + b.n) AS n, count(*) AS common
           FROM tokens a JOIN tokens b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
                AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id),
links AS (SELECT u, v FROM shared WHERE 100 * common >= 85 * (n - common)),
edges AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (SELECT doc_id AS u, doc_id AS v FROM kinds UNION SELECT r.u, b.v FROM reach r JOIN edges b ON r.v = b.u),
labels AS (SELECT u AS doc_id, min(v) AS component_id FROM reach GROUP BY u)
SELECT s.doc_id, len(s.shingles)::BIGINT AS n_shingles, coalesce(l.component_id, s.doc_id) AS component_id
FROM sets s LEFT JOIN kinds k ON list_sort(s.shingles) = k.shingles LEFT JOIN labels l ON l.doc_id = k.doc_id
"""

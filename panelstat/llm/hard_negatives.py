"""Hard negatives by segment summaries.

A vector of whole numbers is cut into segments; of each its mean and deviation are
stored. The inner product of two vectors over a segment of s components is s times
the product of the means, plus or minus s times the product of the deviations
at most (Cauchy and Schwarz). The sums over all segments bound a score from both
sides, and finer segments bound it closer. ``LEVELS`` halves them step by step:
at each level the rows whose upper bound cannot reach what an anchor still needs go, and
only the others are looked at one level finer; those left at the end are scored exactly.

Positives are the best ``k`` rows of the anchor's label: a row is needed while its
upper bound reaches the k-th largest lower bound. A positive of score p asks for the
best ``k`` rows of other labels with scores in [share p, p]: a row is needed while its
bounds meet that range, and while its upper bound reaches the k-th largest lower bound
of those rows that surely lie in the range. Both rules lose nothing.

Rows are dealt into blocks of bounded size and anchors into larger ones, and each
pair of blocks is a group: rows are held (sorted by label, with their summaries),
anchors are streamed. A group sends ``k`` rows for each anchor or positive; the best of
these over all blocks follow by a window over as many rows as there are blocks.

Defined results. Rows with a null id or label, with a null or empty vector, or with a null
or non-finite component take no part; nor do components of 2**27 or more 1/256ths,
whose products a long could not hold. Rows of one id and
length: the smallest by label and components takes part. Vectors of different lengths: no partners. Ties:
the smaller id. Empty table: no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from panelstat.llm.common import materialize, read_table, task_partitions
from panelstat.llm.vectors import grouped, whole_vectors

LEVELS = (4, 16, 32)  # segments, as far as there are components
ROWS, ANCHORS = 16_384, 65_536  # of a block
LARGEST = 1 << 27
ROW = "dim int, id long, label long, q array<int>"


def _quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, label, vector) that take part, with floor(256 x)."""
    for batch in batches:
        lengths, starts, values = whole_vectors(batch.column(2))
        whole = np.floor(256 * np.where(np.isfinite(values), values, 0))
        large = np.concatenate([[0], np.cumsum(np.abs(whole) >= LARGEST)])
        starts_end = starts + lengths
        use = (lengths > 0) & (large[starts_end] == large[starts])
        use &= np.asarray(batch.column(0).is_valid()) & np.asarray(batch.column(1).is_valid())
        keep = pa.array(use)
        whole = np.where(np.abs(whole) < LARGEST, whole, 0).astype(np.int32)
        vectors = [whole[a:b] for a, b in zip(starts[use], starts_end[use])]
        yield pa.RecordBatch.from_arrays(
            [pa.array(lengths[use], pa.int32()), batch.column(0).filter(keep), batch.column(1).filter(keep),
             pa.array(vectors, pa.list_(pa.int32()))], names=["dim", "id", "label", "q"])


def _numbers(column: pa.Array, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy().reshape(-1, dim).astype(np.float64)


def summaries(q: np.ndarray) -> list[np.ndarray]:
    """Per level the matrix of segments' means and deviations, each times the root
    of the segment's length: products of rows then are the two sums of the bounds."""
    out = []
    for segments in sorted({min(s, q.shape[1]) for s in LEVELS}):
        edges = np.linspace(0, q.shape[1], segments + 1).astype(int)
        size = np.diff(edges)
        mean = np.add.reduceat(q, edges[:-1], axis=1) / size
        rest = np.add.reduceat((q - np.repeat(mean, size, axis=1)) ** 2, edges[:-1], axis=1)
        out.append(np.concatenate([mean * np.sqrt(size), np.sqrt(rest)], axis=1))
    return out


def bounds(rows: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of summarised rows with one anchor;
    the slack covers the rounding of doubles."""
    half = rows.shape[1] // 2
    middle, spread = rows[:, :half] @ anchor[:half], rows[:, half:] @ anchor[half:]
    slack = 1e-9 * (np.abs(middle) + spread) + 0.5
    return middle - spread - slack, middle + spread + slack


def _scores(rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    if np.abs(rows).max(initial=0) * np.abs(anchor).max() * rows.shape[1] < 2 ** 52:
        return (rows @ anchor).astype(np.int64)  # whole numbers, exact in doubles
    return rows.astype(np.int64) @ anchor.astype(np.int64)


class Block:
    """Rows of one block, by label, with their summaries."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray):
        order = np.lexsort((ids, labels))
        if len(np.unique(ids)) < len(ids):  # of rows of one id, the smallest by label and components
            order = np.lexsort((*q.T[::-1], labels, ids))
            order = order[np.concatenate([[True], np.diff(ids[order]) != 0])]
            order = order[np.lexsort((ids[order], labels[order]))]
        self.ids, self.labels, self.q = ids[order], labels[order], q[order]
        self.levels = summaries(self.q)

    def _refined(self, at: np.ndarray, anchor: list[np.ndarray], needed) -> np.ndarray:
        """The rows ``at`` that all levels leave; ``needed(lower, upper)`` tells which to keep."""
        for level, summary in zip(self.levels, anchor):
            if not len(at):
                break
            at = at[needed(*bounds(level[at], summary))]
        return at

    def _best(self, at: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        if len(at) > 4 * k:
            keep = scores >= np.partition(scores, -k)[-k]
            at, scores = at[keep], scores[keep]
        order = np.lexsort((self.ids[at], -scores))[:k]
        return self.ids[at[order]], scores[order]

    def positives(self, own: int, label: int, q: np.ndarray, anchor: list[np.ndarray], k: int):
        """The ids and scores of the best k other rows of the label."""
        lo, hi = np.searchsorted(self.labels, [label, label + 1])
        at = np.arange(lo, hi)
        at = at[self.ids[at] != own]

        def needed(lower, upper):
            return upper >= (np.partition(lower, -k)[-k] if len(lower) > k else -np.inf)
        at = self._refined(at, anchor, needed)
        return self._best(at, _scores(self.q[at], q), k)

    def negatives(self, label: int, q: np.ndarray, anchor: list[np.ndarray], positive: np.ndarray, k: int, percent: int):
        """For each positive score the ids and scores of the best k rows of other
        labels between ``percent`` hundredths of it and itself."""
        lo, hi = np.searchsorted(self.labels, [label, label + 1])
        at = np.concatenate([np.arange(lo), np.arange(hi, len(self.ids))])
        ranges = np.unique(positive[positive >= 0])  # below 0 no score is in range

        def needed(lower, upper):
            keep = np.zeros(len(lower), dtype=bool)
            for p in ranges:
                least = p * percent / 100
                sure = lower[(lower >= least) & (upper <= p)]
                floor = np.partition(sure, -k)[-k] if len(sure) > k else least
                keep |= (upper >= max(floor, least)) & (lower <= p)
            return keep
        at = self._refined(at, anchor, needed)
        scores = _scores(self.q[at], q)
        for p in positive.tolist():
            inside = (percent * p <= 100 * scores) & (scores <= p)
            yield self._best(at[inside], scores[inside], k)


def _mine(work, names: list[str]):
    """Runs ``work(block, anchors)`` over each group of a block's rows (role 0) and anchors (role 1)."""
    def run(dim: int, parts) -> Iterator[pa.RecordBatch]:
        held, block = [], None
        for part in parts:
            cut = int(np.searchsorted(part.column(3).to_numpy(zero_copy_only=False), 1))
            if cut:
                held.append(part.slice(0, cut))
            anchors = part.slice(cut)
            if not anchors.num_rows or not (held or block):
                continue  # no rows: the run is read to its end
            if block is None:
                table = pa.Table.from_batches(held)
                block = Block(table["id"].to_numpy(), table["label"].to_numpy(), _numbers(table["q"], dim))
                held = []
            for lo in range(0, anchors.num_rows, 1_024):
                step = anchors.slice(lo, 1_024)
                q = _numbers(step.column("q"), dim)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in work(block, step, q, summaries(q))], names=names)

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, parts in grouped(batches, 3):
            yield from run(key[0], parts)
    return mine


def _columns(parts: list, width: int) -> list[np.ndarray]:
    """Parts (fixed values..., ids, scores) as columns, a row per id."""
    return [np.concatenate([np.zeros(0, np.int64)] + [np.broadcast_to(p[c], len(p[-1])) for p in parts]) for c in range(width)]


def _groups(rows: DataFrame, anchors: DataFrame, sizes: DataFrame) -> DataFrame:
    """Every block of rows beside every block of anchors of its length."""
    spark = rows.sparkSession
    deal = F.xxhash64("id")
    none = F.lit(None).cast("array<struct<id:bigint,score:bigint>>").alias("positives")
    held = (rows.join(sizes, "dim").withColumn("r", F.pmod(deal, F.col("rb")).cast("int"))
            .withColumn("a", F.explode(F.sequence(F.lit(0), F.col("ab") - 1)))
            .select("dim", "r", "a", F.lit(0).alias("role"), "id", "label", "q", none))
    asked = (anchors.join(sizes, "dim").withColumn("a", F.pmod(deal, F.col("ab")).cast("int"))
             .withColumn("r", F.explode(F.sequence(F.lit(0), F.col("rb") - 1)))
             .select("dim", "r", "a", F.lit(1).alias("role"), "id", "label", "q",
                     "positives" if "positives" in anchors.columns else none))
    return (held.unionByName(asked).repartition(task_partitions(spark), "dim", "r", "a")
            .sortWithinPartitions("dim", "r", "a", "role"))


def hard_negatives(df: DataFrame, anchors: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding",
                   k: int = 5, percent: int = 80) -> DataFrame:
    """For the rows that ``anchors`` marks, their best ``k`` positives and for each of
    these the best ``k`` negatives: anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score. ``label`` is the label that counts."""
    rows = materialize(df.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"),
                                 F.col(vector_col).alias("vec"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
                       .select("id", "label", "vec").mapInArrow(_quantised, ROW), "quantised")
    ids = df.where(anchors).select(F.col(id_col).cast("long").alias("id")).distinct()
    chosen = materialize(rows.join(ids, "id", "left_semi").groupBy("dim", "id").agg(F.min(F.struct("label", "q")).alias("c"))
                         .select("dim", "id", "c.*"), "anchors")
    # one row per length of vectors: how many blocks its rows and its anchors make
    sizes = (rows.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / ROWS).cast("int").alias("rb"))
             .join(chosen.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / ANCHORS).cast("int").alias("ab")), "dim"))
    sizes = materialize(sizes, "sizes")

    def find_positives(block, step, q, levels):
        out = []
        for n, (own, lab) in enumerate(zip(step.column("id").to_pylist(), step.column("label").to_pylist())):
            out.append((q.shape[1], own, *block.positives(own, lab, q[n], [s[n] for s in levels], k)))
        return _columns(out, 4)

    def find_negatives(block, step, q, levels):
        out = []
        for n, (own, lab, some) in enumerate(zip(*(step.column(c).to_pylist() for c in ("id", "label", "positives")))):
            scores = np.array([p["score"] for p in some], np.int64)
            found = block.negatives(lab, q[n], [s[n] for s in levels], scores, k, percent)
            out += [(own, p["id"], p["score"], *f) for p, f in zip(some, found)]
        return _columns(out, 5)

    positives = _groups(rows, chosen, sizes).mapInArrow(
        _mine(find_positives, ["dim", "id", "p_id", "p_score"]), "dim long, id long, p_id long, p_score long")
    best = Window.partitionBy("dim", "id").orderBy(F.desc("p_score"), "p_id")
    positives = (positives.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
                 .groupBy("dim", "id").agg(F.collect_list(F.struct(F.col("p_id").alias("id"), F.col("p_score").alias("score"))).alias("positives")))
    asked = materialize(chosen.join(positives, ["dim", "id"]), "asked")  # k positives per anchor
    names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
    found = _groups(rows, asked, sizes).mapInArrow(_mine(find_negatives, names), ", ".join(f"{c} long" for c in names))
    best = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = """
WITH vecs AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
    FROM vecs a JOIN vecs b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER w::INTEGER AS rank, vec_id AS negative_id, positive_score,
       score AS negative_score
FROM positives p JOIN scores n USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY rank <= 5
"""


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(read_table(spark, sf_dir, "embeddings"), anchors=F.col("vec_id") % 100 == 0, label=label)

"""Embedding near-duplicates by product quantisation.

Index. Equal vectors are one node with a number of copies. A bounded sample
(``SAMPLE`` nodes with the smallest digests) trains coarse centroids, about the
square root of the nodes and ``LISTS_MOST`` at most, and codebooks for the residuals
in subspaces of about four components, 16 entries each. Every node goes to the list of
its nearest centroid and is stored as its residual's codes, with the length of
what the codes leave out.

Sufficient probes. A node searches its own list and every list whose bisector
with its own centroid is nearer than half the linking distance. Let x and y link
across two lists: the segment between them crosses the bisector, so one of the two
is within half of their distance of it and searches the other's list.
So no link is lost by the probes, whatever the data, and a pair that both sides
find is told by the probes that members carry.

Distances. A query's table of squared distances to all codebook entries is looked up
with the members' codes. What the codes leave out bounds the error, so a
member whose distance exceeds the linking distance by more goes; the others are
compared exactly, by cosine in double precision. Codes decide the cost only.

Hot lists. Members and queries of a list are dealt into blocks of bounded size,
and each pair of blocks is a group of its own; members are held, queries are
streamed. A group sends per node the number of links and a spanning forest
of them, never the pairs, so that a large group of near copies needs no list of
its pairs; components are joined by ``component_labels``.

Defined results. Null, zero and empty vectors and those with null or
non-finite components: no link, their own component. Vectors of different lengths: no
link. Repeated rows: each is a vector, linked with the others. Rows that repeat an
id with other vectors: each has its own links; component ids are by value. A null
id counts as another's link; its component is the least id reached, null if there
is none. Empty table: no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from panelstat.llm.common import hot_join, materialize, read_table, task_partitions
from panelstat.llm.components import component_labels
from panelstat.llm.vectors import grouped, stacked, whole_vectors

SAMPLE = 20_000  # nodes that train the index
LISTS_MOST = 1_024
ENTRIES = 16  # of a subspace's codebook
MEMBERS, QUERIES, STEP = 4_096, 32_768, 256  # of a group; queries compared at once


def _means(points: np.ndarray, centres: np.ndarray, rounds: int, spherical: bool) -> np.ndarray:
    """Lloyd's rounds; a centre without points stays. Spherical ones compare by angle."""
    for _ in range(rounds):
        if spherical:
            length = np.linalg.norm(centres, axis=1, keepdims=True)
            near = (points @ (centres / np.where(length > 0, length, 1)).T).argmax(axis=1)
        else:
            near = ((centres ** 2).sum(axis=1) - 2 * points @ centres.T).argmin(axis=1)
        counts = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


class Index:
    """Centroids and codebooks of unit vectors of one length."""

    def __init__(self, sample: np.ndarray, lists: int, similarity: float, dtype: str):
        self.similarity, self.dtype = similarity, dtype
        self.reach = float(np.sqrt(max(0.0, 2 - 2 * similarity)))
        means = _means(sample, sample[np.linspace(0, len(sample) - 1, lists).astype(int)], 6, True)
        length = np.linalg.norm(means, axis=1)
        means = means[length > 1e-6] if (length > 1e-6).any() else sample[:1]
        units = means / np.linalg.norm(means, axis=1, keepdims=True)
        _, first = np.unique(units.round(9), axis=0, return_index=True)
        self.means, self.units = means[np.sort(first)], units[np.sort(first)]
        apart = np.maximum(0, 2 - 2 * self.units @ self.units.T) ** 0.5
        np.fill_diagonal(apart, np.inf)
        self.apart = apart
        rest = sample - self.means[(sample @ self.units.T).argmax(axis=1)]
        dim = sample.shape[1]
        self.parts = np.array_split(np.arange(dim), max(1, dim // 4))
        self.books = [_means(rest[:, p], rest[np.linspace(0, len(rest) - 1, ENTRIES).astype(int)][:, p], 8, False)
                      for p in self.parts]

    def place(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """List, whether each list is searched, codes, and length of the rest."""
        near = units @ self.units.T
        own = near.argmax(axis=1)
        gap = near[np.arange(len(own)), own][:, None] - near
        probed = gap <= (self.reach / 2 + 1e-9) * self.apart[own]
        probed[np.arange(len(own)), own] = True
        rest = units - self.means[own]
        codes = np.empty((len(units), len(self.parts)), np.uint8)
        for k, (part, book) in enumerate(zip(self.parts, self.books)):
            codes[:, k] = ((book ** 2).sum(axis=1) - 2 * rest[:, part] @ book.T).argmin(axis=1)
            rest[:, part] -= book[codes[:, k]]
        return own, probed, codes, np.linalg.norm(rest, axis=1)

    def distances(self, at: int, codes: np.ndarray, queries: np.ndarray) -> np.ndarray:
        """Squared distances (members, queries) by table lookup, for a list's members."""
        rest = queries - self.means[at]
        total = np.zeros((len(codes), len(queries)), np.float32)
        for k, (part, book) in enumerate(zip(self.parts, self.books)):
            table = ((rest[:, part] ** 2).sum(axis=1) - 2 * book @ rest[:, part].T + (book ** 2).sum(axis=1)[:, None])
            total += table.astype(np.float32)[codes[:, k]]
        return total


def _unit(vectors: np.ndarray) -> np.ndarray:
    # scaled first, so that squares neither overflow nor vanish
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _digests(dtype: str):
    """Each row with its vector's digest, length and numbers; null where it links with nothing."""
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, starts, values = whole_vectors(batch.column(1))
            values = values + 0.0  # one zero
            blobs = []
            for n, at in zip(lengths, starts):
                row = values[at:at + n]
                blobs.append(row.astype(dtype).tobytes() if n and row.any() else None)
            keys = [b and hashlib.blake2b(b, digest_size=16).digest() for b in blobs]
            dims = [n if b else None for n, b in zip(lengths.tolist(), blobs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(dims, pa.int32()),
                                              pa.array(blobs, pa.binary())], names=["vec_id", "key", "dim", "vec"])
    return digests


def _roots(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the nodes i and j, pair by pair, in a forest of pointers to smaller nodes."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label != label[label]).any():
            label[:] = label[label]


def _search(shared):
    """Per group of a list's members (role 0) and queries (role 1): rows (node,
    links, other): numbers of links, and edges to another node. ``shared`` is the
    broadcast index."""
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])

    def rows(node, links, other):
        return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(links, pa.int64()),
                                           pa.array(other, pa.int64(), from_pandas=True)], schema=schema)

    def run(index: Index, at: int, parts) -> Iterator[pa.RecordBatch]:
        held, members, queued = [], None, []
        for part in parts:
            role = part.column(3).to_numpy(zero_copy_only=False)
            cut = int(np.searchsorted(role, 1))
            if cut:
                held.append(part.slice(0, cut))
            queued = part.slice(cut)
            if not queued.num_rows:
                continue
            if members is None:
                if not held:
                    for _ in parts:
                        pass
                    return
                table = pa.Table.from_batches(held).combine_chunks()
                node, copies = (table[c].to_numpy() for c in ("node", "copies"))
                vectors = _unit(stacked(table["vec"], index.dtype))
                codes = stacked(table["codes"], "u1").astype(np.intp)
                searched = np.unpackbits(stacked(table["probed"], "u1").astype(np.uint8), axis=1).astype(bool)
                allowed = ((index.reach + table["rest"].to_numpy()) ** 2 + 1e-4).astype(np.float32)[:, None]
                found, label = np.zeros(len(node), np.int64), np.arange(len(node))
                members, held = True, []
            for lo in range(0, queued.num_rows, STEP):
                step = queued.slice(lo, STEP)
                q_node, q_copies, q_own = (step.column(c).to_numpy() for c in ("node", "copies", "own"))
                q_vectors = _unit(stacked(step.column("vec"), index.dtype))
                i, j = np.nonzero(index.distances(at, codes, q_vectors) <= allowed)
                keep = np.zeros(len(i), dtype=bool)
                for lo2 in range(0, len(i), 1 << 17):
                    cut2 = slice(lo2, lo2 + (1 << 17))
                    keep[cut2] = np.einsum("ij,ij->i", vectors[i[cut2]], q_vectors[j[cut2]]) >= index.similarity
                keep &= node[i] != q_node[j]
                i, j = i[keep], j[keep]
                if not len(i):
                    continue
                links = np.bincount(j, weights=copies[i], minlength=len(q_node)).astype(np.int64)
                alone = ~searched[i, q_own[j]]  # the member does not search the query's list
                np.add.at(found, i[alone], q_copies[j[alone]])
                some = np.nonzero(links)[0]
                first = np.zeros(len(q_node), np.int64)
                first[j[::-1]] = i[::-1]
                _roots(label, i, first[j])
                yield rows(q_node[some], links[some], node[first[some]])
        if members is not None:
            some = np.nonzero(found)[0]
            yield rows(node[some], found[some], np.full(len(some), np.nan))
            tied = np.nonzero(label != np.arange(len(label)))[0]
            yield rows(node[tied], np.zeros(len(tied), np.int64), node[label[tied]])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, parts in grouped(batches, 3):
            yield from run(shared.value, key[0], parts)
    return search


def _found(nodes: DataFrame, similarity: float, sample: int, dtype: str) -> DataFrame:
    """(node, links, other) of the nodes of one length."""
    spark = nodes.sparkSession
    number = nodes.count()
    drawn = nodes.orderBy("key").limit(sample).select("vec").toArrow()["vec"].combine_chunks()
    index = Index(_unit(stacked(drawn, dtype)), min(max(1, int(number ** 0.5)), LISTS_MOST, len(drawn)), similarity, dtype)
    shared = spark.sparkContext.broadcast(index)  # LISTS_MOST centroids at most

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2_048):
                part = batch.slice(lo, 2_048)
                own, probed, codes, rest = shared.value.place(_unit(stacked(part.column("vec"), dtype)))
                bits = np.packbits(probed, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(own, pa.int32()), pa.array([np.nonzero(p)[0] for p in probed], pa.list_(pa.int32())),
                     pa.array([b.tobytes() for b in bits], pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary()),
                     pa.array(rest, pa.float64())],
                    names=["node", "vec", "copies", "own", "lists", "probed", "codes", "rest"])

    placed = materialize(nodes.select("node", "vec", "copies").mapInArrow(
        place, "node long, vec binary, copies long, own int, lists array<int>, probed binary, codes binary, rest double"), "placed")
    queries = placed.select(F.explode("lists").alias("list"), "node", "vec", "copies", "own")
    # one row per list: how many blocks its members and its queries make
    blocks = (placed.groupBy(F.col("own").alias("list")).agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("mb"))
              .join(placed.select(F.explode("lists").alias("list")).groupBy("list")
                    .agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("qb")), "list"))
    blocks = F.broadcast(materialize(blocks, "blocks"))  # LISTS_MOST rows at most
    deal = F.xxhash64("node")
    members = (placed.withColumnRenamed("own", "list").join(blocks, "list")
               .withColumn("m", F.pmod(deal, F.col("mb")).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("qb") - 1)))
               .select("list", "m", "q", F.lit(0).alias("role"), "node", "vec", "copies", F.col("list").alias("own"),
                       "probed", "codes", "rest"))
    asked = (queries.join(blocks, "list").withColumn("q", F.pmod(deal, F.col("qb")).cast("int"))
             .withColumn("m", F.explode(F.sequence(F.lit(0), F.col("mb") - 1)))
             .select("list", "m", "q", F.lit(1).alias("role"), "node", "vec", "copies", "own",
                     F.lit(None).cast("binary").alias("probed"), F.lit(None).cast("binary").alias("codes"),
                     F.lit(None).cast("double").alias("rest")))
    groups = (members.unionByName(asked).repartition(task_partitions(spark), "list", "m", "q")
              .sortWithinPartitions("list", "m", "q", "role"))
    return groups.mapInArrow(_search(shared), "node long, links long, other long")


def embedding_components(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", similarity: float = 0.95,
                         sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``df``: ``id_col``, ``n_links`` (other rows with a
    cosine of ``similarity`` or more), ``component_id`` (smallest id reachable by
    links, the row's own included) and ``kept`` (the row has that id)."""
    dtype = "<f4" if df.schema[vector_col].dataType.elementType == T.FloatType() else "<f8"
    rows = materialize(df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vec"))
                       .mapInArrow(_digests(dtype), "vec_id long, key binary, dim int, vec binary"), "vectors")
    nodes = rows.where("key is not null").groupBy("key").agg(
        F.first("dim").alias("dim"), F.first("vec").alias("vec"), F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    found = None
    for r in nodes.groupBy("dim").count().where("count > 1").orderBy("dim").collect():  # one row per length of vectors
        part = materialize(_found(nodes.where(F.col("dim") == r["dim"]), similarity, sample, dtype), "found")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = nodes.limit(0).select("node", F.lit(0).cast("long").alias("links"), F.col("node").alias("other"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = materialize(component_labels(found.where("other is not null").select(
        F.col("node").alias("u"), F.col("other").alias("v"))), "labels")
    placed = materialize(nodes.select("key", "node", "rep", "copies").join(links, "node", "left").join(labels, "node", "left")
                         .withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1).drop("links"), "placed")
    least = materialize(placed.where("label is not null").groupBy("label")
                        .agg(F.min("rep").alias("component_id"), F.sum("copies").alias("total")), "least")
    total = rows.count()
    linked = hot_join(placed.where("label is not null"), least, "label", "total", total)
    alone = placed.where("label is null").withColumn("component_id", F.col("rep"))
    parts = materialize(linked.unionByName(alone).select("key", "copies", "n_links", "component_id"), "parts")
    narrow = rows.select("vec_id", "key")
    out = (hot_join(narrow.where("key is not null"), parts, "key", "copies", total).select("vec_id", "n_links", "component_id")
           .unionByName(narrow.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                                           F.col("vec_id").alias("component_id"))))
    return out.select(F.col("vec_id").alias(id_col), "n_links", "component_id",
                      F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


ORACLE = """
WITH RECURSIVE
good AS (
    SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
    SELECT a.vec_id AS u, b.vec_id AS w FROM good a JOIN good b
      ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.95),
reach(u, w) AS (
    SELECT u, w FROM links
    UNION
    SELECT reach.u, links.w FROM reach JOIN links ON reach.w = links.u),
least AS (SELECT u, min(w) AS w FROM reach GROUP BY u),
counts AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(l.w, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(l.w, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN counts c ON c.u = e.vec_id LEFT JOIN least l ON l.u = e.vec_id
"""


def op11_embedding_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(read_table(spark, sf_dir, "embeddings"))

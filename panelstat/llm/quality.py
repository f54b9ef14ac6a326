"""Quality classifier: random-indexing word vectors, pooled per document, and a
two-layer network with temperature-calibrated probabilities.

1. Word vectors cover every document. Words and their shapes (``Thre***`` is
   ``Aa*``) are hashed to a fixed number of rows; each row sums the sparse
   random index vectors of the words that stand within two places of it. The
   table's size is a parameter, not the vocabulary's.
2. A document is the mean of its words' unit vectors, the mean of its shapes',
   the lengths of both means, and how much its words repeat.
3. A network of one hidden layer learns ``labels.quality`` from at most
   ``SAMPLE`` labelled rows of the training folds; a temperature, fitted on rows
   set aside from these, calibrates its probabilities.

Held out are the rows whose crc32(doc_id as text) mod 4 is 2; their labels are
never read. Scores use the text only.

Defined results. Null text: as the empty text, whose features are zeros; it
gets a score like any other. Null ids: not held out, and no label finds them.
Labels that are null are left out; labels that repeat count each time; with
labels of one kind only, that kind's share is every score, and with none the score
is 1, so that nothing is rejected unseen. Repeated rows are scored one by one.
Empty table: no rows. Extra columns are not read by ``quality_scores`` and
are kept by ``keep_quality``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelstat.llm.common import Memo, mix64, read_table, summed_table, worker_memo

WORD_ROWS, SHAPE_ROWS, DIMENSIONS = 1 << 14, 1 << 10, 32
SAMPLE = 20_000  # labelled rows that the network learns from, at most
HIDDEN, EPOCHS, BATCH, SEED = 32, 14, 256, 7
THRESHOLD = 0.7
CHUNK = 200_000  # words whose neighbours are added up at once
MEMO_WORDS = 200_000

_SHAPE = str.maketrans({**{c: "a" for c in map(chr, range(97, 123))}, **{c: "A" for c in map(chr, range(65, 91))},
                        **{c: "9" for c in "0123456789"}})
_REPEATS = re.compile(r"(.)\1+", re.DOTALL)


def _shape(word: str) -> str:
    if not word.isascii():
        word = "".join("A" if c.isupper() else "a" if c.isalpha() else c for c in word)
    return _REPEATS.sub(r"\1", word.translate(_SHAPE))


def _row(word: str) -> int:
    """A word's row times SHAPE_ROWS plus its shape's row."""
    return zlib.crc32(word.encode()) % WORD_ROWS * SHAPE_ROWS + zlib.crc32(_shape(word).encode()) % SHAPE_ROWS


def _word_rows(text: str | None) -> np.ndarray:
    words = (text or "").split()
    return np.fromiter(map(worker_memo("word rows", lambda: Memo(_row, MEMO_WORDS)).__getitem__, words), dtype=np.int64, count=len(words))


def _index_dimensions(rows: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each row's index vector has its +1 and its -1."""
    bits = mix64(np.arange(rows, dtype=np.uint64) + np.uint64(salt))
    return (bits % np.uint64(DIMENSIONS)).astype(np.int64), ((bits >> np.uint64(32)) % np.uint64(DIMENSIONS)).astype(np.int64)


def _add_neighbours(rows: np.ndarray, same: np.ndarray, table: np.ndarray, salt: int) -> None:
    """Adds to ``table`` (flat) the index vectors of the neighbours of each
    word; ``same`` numbers the document of each word."""
    plus, minus = _index_dimensions(len(table) // DIMENSIONS, salt)
    ups, downs = [], []
    for gap in (1, 2):
        a, b = rows[:-gap], rows[gap:]
        inside = same[:-gap] == same[gap:]
        a, b = a[inside], b[inside]
        for left, right in ((a, b), (b, a)):
            ups.append(left * DIMENSIONS + plus[right])
            downs.append(left * DIMENSIONS + minus[right])
    table += np.bincount(np.concatenate(ups), minlength=len(table))
    table -= np.bincount(np.concatenate(downs), minlength=len(table))


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Unit vectors, float32, of the word rows and then the shape rows, summed
    over every word of every document."""
    split = WORD_ROWS * DIMENSIONS

    def count(batch: pa.RecordBatch, table: np.ndarray) -> None:
        held: list[np.ndarray] = []

        def flush() -> None:
            rows = np.concatenate(held)
            same = np.repeat(np.arange(len(held)), [len(h) for h in held])
            _add_neighbours(rows // SHAPE_ROWS, same, table[:split], 1)
            _add_neighbours(rows % SHAPE_ROWS, same, table[split:split + SHAPE_ROWS * DIMENSIONS], 2)
            held.clear()

        size = 0
        for text in batch.column(0):
            rows = _word_rows(text.as_py())
            if len(rows):
                held.append(rows)
                size += len(rows)
            if size >= CHUNK:
                flush()
                size = 0
        if held:
            flush()

    table = summed_table(docs.select(text_col), count, (WORD_ROWS + SHAPE_ROWS) * DIMENSIONS)
    vectors = table.reshape(-1, DIMENSIONS).astype(np.float64)
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return (vectors / np.where(norms > 0, norms, 1)).astype(np.float32)


def document_features(text: str | None, vectors: np.ndarray) -> np.ndarray:
    rows = _word_rows(text)
    n = len(rows)
    out = np.zeros(2 * DIMENSIONS + 5, dtype=np.float64)
    if n:
        words, shapes = rows // SHAPE_ROWS, rows % SHAPE_ROWS
        kinds, counts = np.unique(words, return_counts=True)
        out[:DIMENSIONS] = counts @ vectors[kinds] / n
        kinds_of_shape, shape_counts = np.unique(shapes, return_counts=True)
        out[DIMENSIONS:2 * DIMENSIONS] = shape_counts @ vectors[WORD_ROWS + kinds_of_shape] / n
        out[-5] = np.linalg.norm(out[:DIMENSIONS])
        out[-4] = np.linalg.norm(out[DIMENSIONS:2 * DIMENSIONS])
        out[-3] = np.count_nonzero(rows[1:] == rows[:-1]) / n
        out[-2] = len(kinds) / n
        out[-1] = np.log1p(n)
    return out


@dataclass
class QualityModel:
    vectors: np.ndarray
    center: np.ndarray
    scale: np.ndarray
    weights: tuple[np.ndarray, ...] | None  # hidden, its bias, output, its bias
    temperature: float = 1.0
    constant: float = 1.0  # the score of every text if nothing could be learned

    def logits(self, features: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.tanh((features - self.center) / self.scale @ w1 + b1) @ w2 + b2

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.weights is None or not texts:
            return np.full(len(texts), self.constant)
        features = np.stack([document_features(t, self.vectors) for t in texts])
        return 1 / (1 + np.exp(-np.clip(self.logits(features) / self.temperature, -500, 500)))


def _adam(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    rng = np.random.default_rng(SEED)
    weights = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
               rng.normal(0, HIDDEN ** -0.5, HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    for epoch in range(max(EPOCHS, min(400, 40_000 // max(len(x), 1)))):
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            rows = order[at:at + BATCH]
            hidden = np.tanh(x[rows] @ weights[0] + weights[1])
            error = (1 / (1 + np.exp(-np.clip(hidden @ weights[2] + weights[3], -500, 500))) - y[rows]) / len(rows)
            back = np.outer(error, weights[2]) * (1 - hidden ** 2)
            grads = [x[rows].T @ back + 1e-4 * weights[0], back.sum(0), hidden.T @ error + 1e-4 * weights[2],
                     np.array([error.sum()])]
            step += 1
            for k, g in enumerate(grads):
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                weights[k] = weights[k] - 0.01 * (first[k] / (1 - 0.9 ** step)) / (
                    np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    return tuple(weights)


def train(features: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> QualityModel:
    """Fits the network on five sixths of the rows and the temperature on the rest."""
    width = 2 * DIMENSIONS + 5
    if len(labels) < 12 or labels.min() == labels.max():
        constant = float(labels.mean()) if len(labels) else 1.0
        return QualityModel(vectors, np.zeros(width), np.ones(width), None, constant=constant)
    center, scale = features.mean(0), features.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    aside = np.arange(len(labels)) % 6 == 5
    x = (features - center) / scale
    model = QualityModel(vectors, center, scale, _adam(x[~aside], labels[~aside].astype(float)))
    logits, y = model.logits(features[aside]), labels[aside]
    losses = {t: np.logaddexp(0, np.where(y == 1, -logits, logits) / t).mean() for t in np.geomspace(0.25, 8, 61)}
    model.temperature = float(min(losses, key=losses.get))
    return model


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", sample: int = SAMPLE) -> QualityModel:
    """Vectors from all of ``docs``, the network from at most ``sample``
    labelled rows outside the held-out fold, those with the smallest hashes."""
    vectors = word_vectors(docs, text_col)
    chosen = (labels.where(~held_out(F.col(id_col)) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
              .select(F.col(id_col).alias("chosen_id"), F.col(label_col).cast("int").alias("label"))
              .orderBy(F.xxhash64("chosen_id"), "label").limit(sample))
    rows = docs.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("text"))
    rows = rows.join(F.broadcast(chosen), rows["row_id"] == F.col("chosen_id")).select("row_id", "label", "text")
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [document_features(t.as_py(), shared.value).tolist() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1),
                                              pa.array(found, pa.list_(pa.float64()))],
                                             names=["row_id", "label", "features"])

    got = rows.mapInArrow(features, "row_id long, label int, features array<double>")
    # ids may repeat in both tables: the first rows in a full order, whatever the partitions
    got = got.orderBy("row_id", "label", "features").limit(sample).toPandas()
    x = np.stack(got["features"].to_list()) if len(got) else np.zeros((0, 2 * DIMENSIONS + 5))
    order = np.random.default_rng(SEED).permutation(len(got))
    return train(x[order], got["label"].to_numpy()[order], vectors)


def quality_scores(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text",
                   threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``held_out``, ``score``, ``predicted``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.scores(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(score, f"id {kind}, score double").select(
        F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, all columns as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.scores(batch.column(at).to_pylist())
            yield batch.filter(pc.greater_equal(pa.array(scores, pa.float64()), threshold))

    return docs.mapInArrow(keep, docs.schema)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality_scores(docs, fit(docs, read_table(spark, sf_dir, "labels")))

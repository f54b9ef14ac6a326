"""Document fingerprints by randomised edit embedding.

A walk over a text stays at a character or steps to the next one, as shared
random bits r(position, character) say, and writes the character that it
stands at. Two texts that are a few edits apart fall into step again soon
after each edit, so their edit distance becomes a Hamming distance of what the
walks write. (The bits repeat every ``PERIOD`` positions; characters are
dealt to ``CLASSES`` classes.)

A fingerprint samples the walk's output: at level b, for texts of up to 2**b
characters, the positions below 3 * 2**b whose hash is small enough that about
``SAMPLES`` of them are chosen, each as four bits of its character's hash, or 0
behind the walk's end. The choices of a level are among those of every level
below, so fingerprints of any two lengths compare at the longer one's
level. Likeness is the share of equal samples, corrected for chance.

Near fingerprints: ``BANDS`` bands of ``BAND`` sampled positions each, at a text's
own level and the next, are join keys; every key's texts are compared with
the key's centre, then those of keys that are still in several components
with each other, and each pair is verified on the whole fingerprints.

Defined results. Null text: as the empty text, whose fingerprint is its level
alone; two of these have likeness 1. Order: by id, descending; null ids last;
rows that repeat an id by a hash of the text, then the text. Next after the
last is the first; a single row is its own next. Empty table: no rows. Extra
columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelstat.llm.common import materialize, mix64, range_bounds, read_table, task_partitions
from panelstat.llm.components import component_labels

PERIOD, CLASSES, SAMPLES, LEAST_LEVEL = 4096, 64, 256, 4
BANDS, BAND = 12, 8
NO_ID = -(1 << 63)  # where null ids stand in the order


@functools.lru_cache(maxsize=1)
def _jumps() -> list[list[int]]:
    """For each class and position: how far the walk goes before it leaves a
    character of that class."""
    cells = mix64(np.arange(CLASSES * PERIOD, dtype=np.uint64) + np.uint64(1 << 40))
    steps = (cells & np.uint64(1)).astype(bool).reshape(CLASSES, PERIOD)
    steps[:, -1] = True
    out = []
    for row in steps:
        ends = np.nonzero(row)[0]
        nearest = ends[np.searchsorted(ends, np.arange(PERIOD))]
        out.append((nearest - np.arange(PERIOD) + 1).tolist())
    return out


@functools.lru_cache(maxsize=64)
def sample_positions(level: int) -> np.ndarray:
    end = 3 << level
    limit = np.uint64(min((1 << 64) - 1, (SAMPLES << 64) // end))
    chosen = []
    for at in range(0, end, 1 << 20):
        block = np.arange(at, min(end, at + (1 << 20)), dtype=np.uint64)
        chosen.append(block[mix64(block + np.uint64(1 << 50)) <= limit])
    return np.concatenate(chosen).astype(np.int64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)


def walk(codes: np.ndarray, position: int = 0) -> np.ndarray:
    """Where the walk that is at ``position`` reaches each character, and where it ends."""
    jumps, mask = _jumps(), PERIOD - 1
    starts = [position]
    add = starts.append
    for c in (mix64(codes) % np.uint64(CLASSES)).tolist():
        position += jumps[c][position & mask]
        add(position)
    return np.array(starts, dtype=np.int64)


def level_of(chars: int) -> int:
    return max(LEAST_LEVEL, (max(chars, 1) - 1).bit_length())


def _sampled(codes: np.ndarray, starts: np.ndarray, level: int) -> np.ndarray:
    """1 to 15 at each sampled position of the level, 0 behind the walk's end."""
    where = sample_positions(level)
    inside = where[:np.searchsorted(where, starts[-1])]
    at = np.searchsorted(starts, inside, side="right") - 1
    out = np.zeros(len(where), dtype=np.uint8)
    out[:len(inside)] = (mix64(codes[at] + np.uint64(1 << 33)) % np.uint64(15)).astype(np.uint8) + 1
    return out


_HEX = np.frombuffer(b"0123456789abcdef", dtype=np.uint8)


def _spelled(codes: np.ndarray, starts: np.ndarray) -> str:
    level = level_of(len(codes))
    if not len(codes):
        return f"{level:02x}"
    return f"{level:02x}" + _HEX[_sampled(codes, starts, level)].tobytes().decode()


def fingerprint(text: str) -> str:
    codes = _codes(text)
    return _spelled(codes, walk(codes))


def samples_at(print_: str, level: int) -> np.ndarray:
    """A fingerprint's samples at its own or a higher level."""
    own = int(print_[:2], 16)
    raw = np.frombuffer(print_[2:].encode(), dtype=np.uint8)
    values = np.where(raw >= 97, raw - 87, raw - 48).astype(np.uint8)
    if not len(values):
        return np.zeros(len(sample_positions(level)), np.uint8)
    if own == level:
        return values
    wanted, have = sample_positions(level), sample_positions(own)
    low = wanted[:np.searchsorted(wanted, 3 << own)]
    out = np.zeros(len(wanted), dtype=np.uint8)
    out[:len(low)] = values[np.searchsorted(have, low)]
    return out


def likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    level = max(int(a[:2], 16), int(b[:2], 16))
    x, y = samples_at(a, level), samples_at(b, level)
    either = (x > 0) | (y > 0)
    if not either.any():
        return 0.0
    share = np.count_nonzero((x == y) & either) / np.count_nonzero(either)
    return round(max(0.0, (share - 1 / 15) / (1 - 1 / 15)), 6)


def band_keys(print_: str) -> list[int]:
    """Keys of the bands at the fingerprint's own level and the next."""
    own, keys = int(print_[:2], 16), []
    for level in (own, own + 1):
        values = samples_at(print_, level)
        if not values.any():
            continue
        deal = np.argsort(mix64(np.arange(len(values), dtype=np.uint64) + np.uint64(level << 20)))
        for band in range(BANDS):
            chosen = values[np.sort(deal[(band * BAND + np.arange(BAND)) % len(deal)])]
            if chosen.any():
                digest = hashlib.blake2b(bytes([level, band]) + chosen.tobytes(), digest_size=8).digest()
                keys.append(int.from_bytes(digest, "little", signed=True))
    return keys


def fingerprint_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: ``id_col``, ``n_chars``, ``fingerprint``; and of
    the edited text, whose last half the next row's first characters replace, its
    ``edited_sha256``, ``edited_fingerprint`` and ``near_edited``; ``near_next``."""
    spark = df.sparkSession
    parts = task_partitions(spark)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"),
                     F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("place"),
                     F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bounds = np.array(range_bounds(rows, "place", parts), dtype=np.int64)

    @F.pandas_udf("int")
    def range_of(place):
        import pandas as pd

        return pd.Series(np.searchsorted(bounds, place.to_numpy(), side="right").astype(np.int32))

    # the greatest id of each range is also what the next range above needs; the least range's comes round to the top
    heads = {r["part"]: r["head"] for r in rows.select("place", range_of("place").alias("part"))
             .groupBy("part").agg(F.max("place").alias("head")).collect()}  # a row per range
    order = sorted(heads)
    also = {heads[p]: order[(k + 1) % len(order)] for k, p in enumerate(order)}

    @F.pandas_udf("array<int>")
    def ranges(place):
        import pandas as pd

        own = np.searchsorted(bounds, place.to_numpy(), side="right").tolist()
        return pd.Series([[p, also[x]] if x in also else [p] for p, x in zip(own, place)])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            texts = pa.array([pack(t.as_py().encode("utf-8", "surrogatepass")) for t in batch.column(4)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], texts],
                                             names=["doc_id", "place", "parts", "tie", "packed"])

    tie = F.xxhash64("text")
    dealt = rows.select("doc_id", "place", ranges("place").alias("parts"), tie.alias("tie"), "text").mapInArrow(
        packed, "doc_id long, place long, parts array<int>, tie long, packed binary")
    # the copy of a head comes second in the array; it closes its range, so it sorts behind all of that range's rows
    dealt = dealt.select("*", F.posexplode("parts").alias("halo", "part")).drop("parts")
    dealt = (dealt.repartitionById(parts, "part")
             .sortWithinPartitions("halo", F.col("place").desc(), "tie", "packed"))

    def walk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        held = None  # the row before: doc_id, text, codes, starts, fingerprint

        def row(now: tuple, following: tuple) -> dict:
            doc_id, text, codes, starts, own = now
            half = len(codes) // 2
            keep = len(codes) - half
            edited = text[:keep] + following[1][:half]
            tail = following[2][:half]
            edited_codes = np.concatenate([codes[:keep], tail])
            edited_starts = np.concatenate([starts[:keep], walk(tail, int(starts[keep]))])
            other = _spelled(edited_codes, edited_starts)
            return {"doc_id": doc_id, "n_chars": len(codes), "fingerprint": own, "edited_fingerprint": other,
                    "edited_sha256": hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                    "near_edited": likeness(own, other), "near_next": likeness(own, following[4])}

        done = False
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                if done:
                    break
                text = unpack(batch.column("packed")[k].as_py()).decode("utf-8", "surrogatepass")
                codes = _codes(text)
                starts = walk(codes)
                now = (batch.column("doc_id")[k].as_py(), text, codes, starts, _spelled(codes, starts))
                if held is not None:
                    out.append(row(held, now))
                held, done = now, batch.column("halo")[k].as_py() == 1
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    arrow = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                       ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
                       ("near_edited", pa.float64()), ("near_next", pa.float64())])
    made = dealt.mapInArrow(walk_rows, "doc_id long, n_chars long, edited_sha256 string, fingerprint string,"
                                       " edited_fingerprint string, near_edited double, near_next double")
    return made.withColumnRenamed("doc_id", id_col)


def near_groups(prints: DataFrame, least: float = 0.8, id_col: str = "doc_id",
                print_col: str = "fingerprint") -> DataFrame:
    """One row per row of ``prints``: ``id_col`` and ``group_id``, the smallest
    id that is reachable by verified likeness of at least ``least`` between
    fingerprints that share a band. Null ids are in no group."""
    rows = prints.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(print_col).alias("fp"))
    kinds = materialize(rows.groupBy("fp").agg(F.min("id").alias("node")), "prints")

    @F.pandas_udf("array<long>")
    def keys(fp):
        return fp.map(lambda x: sorted(set(band_keys(x))))

    @F.pandas_udf("boolean")
    def alike(a, b):
        import pandas as pd

        return pd.Series([likeness(x, y) >= least for x, y in zip(a, b)])

    banded = materialize(kinds.select("node", F.explode(keys("fp")).alias("key")), "bands")

    def verified(pairs: DataFrame) -> DataFrame:
        left = kinds.select(F.col("node").alias("u"), F.col("fp").alias("a"))
        right = kinds.select(F.col("node").alias("v"), F.col("fp").alias("b"))
        return pairs.join(left, "u").join(right, "v").where(alike("a", "b")).select("u", "v")

    centres = banded.groupBy("key").agg(F.min("node").alias("c"), F.max("node").alias("z")).where("c < z").select("key", "c")
    pairs = banded.join(centres, "key").where("node > c").select(F.col("c").alias("u"), F.col("node").alias("v")).distinct()
    labels = component_labels(verified(pairs))
    labelled = banded.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    several = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    mixed = materialize(labelled.join(several, "key"), "mixed")
    other = mixed.select("key", F.col("node").alias("o"), F.col("label").alias("o_label"))
    across = mixed.join(other, "key").where("label < o_label").select(
        F.least("node", "o").alias("u"), F.greatest("node", "o").alias("v")).distinct()
    links = labels.select(F.col("node").alias("u"), F.col("label").alias("v")).unionByName(verified(across))
    labels = component_labels(links)
    placed = kinds.join(labels, "node", "left").select("fp", F.coalesce("label", "node").alias("group_id"))
    found = prints.select(F.col(id_col).alias("row_id"), F.col(print_col).alias("fp")).join(placed, "fp", "left")
    return found.select(F.col("row_id").alias(id_col),
                        F.when(F.col("row_id").isNotNull(), F.col("group_id")).alias("group_id"))


def op5_edit_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(read_table(spark, sf_dir, "documents"))

"""What several of the operators share: reading the tables, lower-casing
ASCII letters, sums of fixed-size tables over all rows, range buckets."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelstat.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z and nothing else; null stays null."""
    return F.translate(col, UPPER, LOWER)


def task_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a fixed, seedless hash of 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def summed_table(df: DataFrame, count: Callable[[pa.RecordBatch, np.ndarray], None], cells: int,
                 shards: int = 64) -> np.ndarray:
    """One int64 table of ``cells`` numbers, summed over every row of ``df``.

    ``count(batch, table)`` adds a batch to its task's table. Tables are cut
    into ``shards`` and travel packed, one row per task and shard; each shard
    is summed batch by batch, so that no task holds more than one table, and
    the driver receives ``cells`` numbers whatever the size of the input.
    Whole numbers make the sum independent of the order of the tasks. An empty
    input gives zeros.
    """
    import zlib

    size = -(-cells // shards)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size * shards, dtype=np.int64)
        for batch in batches:
            count(batch, table)
        parts = [(s, table[s * size:(s + 1) * size]) for s in range(shards)]
        parts = [(s, zlib.compress(p.astype("<i8").tobytes(), 1)) for s, p in parts if p.any()]
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in parts], pa.int32()),
                                          pa.array([p for _, p in parts], pa.binary())], names=["shard", "part"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, p in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(zlib.decompress(p.as_py()), dtype="<i8")
                sums[s] = sums[s] + part if s in sums else part
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()),
                                          pa.array([zlib.compress(v.tobytes(), 1) for v in sums.values()],
                                                   pa.binary())], names=["shard", "part"])

    parts = df.mapInArrow(local, "shard int, part binary")
    # two rounds: pairs of (shard, sender group) first, so that no task meets every sender of a shard
    parts = (parts.withColumn("salt", F.spark_partition_id() % F.lit(8)).repartition(shards, "shard", "salt")
             .select("shard", "part").mapInArrow(merge, "shard int, part binary"))
    parts = parts.repartition(shards, "shard").mapInArrow(merge, "shard int, part binary")
    out = np.zeros(size * shards, dtype=np.int64)
    for row in parts.collect():  # at most `shards` rows
        out[row["shard"] * size:(row["shard"] + 1) * size] = np.frombuffer(zlib.decompress(row["part"]), dtype="<i8")
    return out[:cells]


def hot_join(rows: DataFrame, table: DataFrame, key: str | list[str], size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has one row per ``key`` and, in
    ``size``, at most how many of the ``total`` rows have it. Keys of more than a
    thousandth of all rows, a thousand at most, are broadcast, so that their rows stay
    where they are; the others are shuffled."""
    keys = [key] if isinstance(key, str) else key
    hot = F.broadcast(table.where(F.col(size) * 1000 > total).drop(size))
    rest = table.where(F.col(size) * 1000 <= total).drop(size)
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(rest, keys))


class Memo(dict):
    """A dict that computes what it lacks. At ``limit`` entries it starts anew and keeps
    the former ones beside it, so that what is asked often is never computed again."""

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self.make, self.limit, self.former = make, limit, {}

    def __missing__(self, key):
        value = self.former.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.former = dict(self)
            self.clear()
        self[key] = value
        return value


_WORKER: dict = {}


def _give_back() -> None:
    """Returns freed memory to the system, as far as its C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def worker_memo(owner, make):
    """What an operator keeps from task to task in a Python worker, made at first
    use. A worker holds only what the operator that ran last in it keeps, so that a
    session with many operators needs no more memory than its largest one."""
    if owner not in _WORKER:
        _WORKER.clear()
        _give_back()
        _WORKER[owner] = make()
    return _WORKER[owner]


def range_bounds(df: DataFrame, column: str, parts: int) -> list[int]:
    """Up to ``parts - 1`` ascending cut points that deal the column's values
    into ranges of about equal size. Nulls are left out; an empty table has
    no cut points."""
    if parts < 2:
        return []
    probs = [i / parts for i in range(1, parts)]
    row = df.agg(F.percentile_approx(F.col(column), probs, 100 * parts).alias("q")).first()
    return sorted(set(int(x) for x in row["q"] or []))


__all__ = ["LOWER_BYTES", "Memo", "ascii_lower", "hot_join", "materialize", "mix64", "range_bounds", "read_table", "summed_table",
           "task_partitions", "worker_memo"]

"""Mixing sources to target weights by Pfair scheduling, with DataFrame
functions only.

Every source is a periodic task. With integer shares q that add up to Q, its
k-th block of documents may not go out before slot floor(k Q / q) (release)
and must before ceil((k + 1) Q / q) (deadline). Earliest deadline first over
the released blocks fills every slot of a period of Q slots and meets all
deadlines, so that after any number t of slots a source has sent more than
t q / Q - 1 and fewer than t q / Q + 1 blocks. The period repeats, so it is worked
out once for the shares, which are a parameter of at most ``PERIOD_MOST``;
documents find their slots through a literal table of Q rows.

A source's documents go in the order of md5(id). Their ranks come from counts
per (source, first three digits of md5) and row numbers within these, so that a
source with a third of all rows is spread over thousands of groups.

All rows stay. Once a source has run out, its slots stay empty and the others
keep their slots; ``in_mix`` says whether a slot comes before the first empty one,
that is, whether the target weights still hold.

Defined results. Sources without a share of their own, null included, form
one class with the share ``other``. Sources with a share but no rows are left
out of the period. Null ids and texts are mixed like others. Rows that repeat an id
take neighbouring ranks, in the order of all their columns. Texts are not
looked at. Empty table: no rows. Extra columns are not read by
``mix_positions`` and are kept by ``mixed``.

``mixed`` adds no column; its order is the mix, and it stands in the written
files' numbers and the rows' places in them. A scan packs files by size and
does not keep that order, so whoever reads the files takes it from there:
``mix_order`` gives it as a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from panelstat.llm.common import read_table, task_partitions

PERIOD_MOST = 4096
BLOCK = 32  # documents

# The production mix: shares of the named sources, and of all others together.
SHARES = {"src0": 20, **{f"src{i}": 8 for i in range(1, 5)}, **{f"src{i}": 4 for i in range(5, 10)},
          **{f"src{i}": 2 for i in range(10, 20)}}
OTHER = 8


def pfair_period(shares: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(task, block, slot, release, deadline) of every slot of one period of
    sum(shares) slots; tasks are numbered as given, and equal deadlines go to
    the lower number."""
    period, sent, out = sum(shares), [0] * len(shares), []
    for slot in range(period):
        ready = [(-(-(sent[i] + 1) * period // q), i) for i, q in enumerate(shares) if sent[i] * period // q <= slot]
        deadline, i = min(ready)
        out.append((i, sent[i], slot, sent[i] * period // shares[i], deadline))
        sent[i] += 1
    return out


def _class(source: Column, names: list[str]) -> Column:
    """The number of the source's class: its place among ``names``, else their number."""
    out = F.lit(len(names))
    for i, name in reversed(list(enumerate(names))):
        out = F.when(source == name, F.lit(i)).otherwise(out)
    return out


def _first_empty(slots: list[tuple[int, int, int, int, int]], blocks: list[int], quota: list[int]) -> int:
    """The first slot that one of the tasks, with so many blocks, leaves empty."""
    at = {(i, k): slot for i, k, slot, _, _ in slots}
    return min((n // q * sum(quota) + at[i, n % q] for i, (n, q) in enumerate(zip(blocks, quota))), default=0)


def _ordered(shares: dict[str, int], other: int) -> tuple[list[str], list[int]]:
    """The named sources, largest share first, and the weights of all classes."""
    names = sorted(shares, key=lambda s: (-shares[s], s))
    return names, [shares[n] for n in names] + [other]


def _positions(rows: DataFrame, shares: dict[str, int], other: int, block: int) -> DataFrame:
    """Adds rank, block, slot, release, deadline, position and in_mix to rows
    of (id, source, ...); ties of the id go by the remaining columns."""
    names, weights = _ordered(shares, other)
    if min(weights) < 1 or sum(weights) > PERIOD_MOST:
        raise ValueError(f"shares are whole numbers from 1 on that add up to {PERIOD_MOST} at most")
    ties = [c for c in rows.columns if c not in ("id", "source")]
    keyed = (rows.withColumn("cls", _class(F.col("source"), names))
             .withColumn("order_key", F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")))
             .withColumn("bucket", F.substring("order_key", 1, 3)))
    counts = keyed.groupBy("cls", "bucket").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("cls").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("cls", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))

    total = {r["cls"]: r["n"] for r in counts.groupBy("cls").agg(F.sum("n").alias("n")).collect()}  # a row per class
    live = sorted(total)
    quota = [weights[c] for c in live]
    period = sum(quota)
    slots = pfair_period(quota)
    first_empty = _first_empty(slots, [-(-total[c] // block) for c in live], quota)
    table = [F.struct(F.lit(live[i]).alias("cls"), F.lit(quota[i]).alias("quota"), F.lit(k).alias("k"),
                      F.lit(slot).alias("in_period"), F.lit(release).alias("release_in"),
                      F.lit(deadline).alias("deadline_in")) for i, k, slot, release, deadline in slots]
    if not table:
        table = [F.struct(*[F.lit(1).alias(n) for n in ("cls", "quota", "k", "in_period", "release_in", "deadline_in")])]
    spark = rows.sparkSession
    period_table = spark.range(1).select(F.inline(F.array(*table)))  # PERIOD_MOST rows at most
    quotas = spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("cls"), F.lit(q).alias("quota")) for c, q in zip(live or [0], quota or [1])])))

    within = Window.partitionBy("cls", "bucket").orderBy("order_key", "id", *ties)
    ranked = (keyed.withColumn("number", F.row_number().over(within) - 1)
              .join(F.broadcast(quotas), "cls")
              .join(offsets, ["cls", "bucket"]).withColumn("rank", F.col("offset") + F.col("number"))
              .withColumn("block", F.floor(F.col("rank") / block))
              .withColumn("k", (F.col("block") % F.col("quota")).cast("int"))
              .withColumn("start", F.floor(F.col("block") / F.col("quota")) * period))
    return (ranked.join(F.broadcast(period_table.drop("quota")), ["cls", "k"])
            .withColumn("slot", F.col("start") + F.col("in_period"))
            .withColumn("release", F.col("start") + F.col("release_in"))
            .withColumn("deadline", F.col("start") + F.col("deadline_in"))
            .withColumn("position", F.col("slot") * block + F.col("rank") % block)
            .withColumn("in_mix", F.col("slot") < F.lit(first_empty)))


def mix_positions(df: DataFrame, shares: dict[str, int] = SHARES, other: int = OTHER, block: int = BLOCK,
                  id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """One row per row of ``df``: id, source, its rank within its class, block,
    slot, release, deadline, position (unique, in sending order) and in_mix."""
    rows = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"))
    return _positions(rows, shares, other, block).select(
        F.col("id").alias(id_col), F.col("source").alias(source_col),
        *[F.col(c).cast("long").alias(c) for c in ("rank", "block", "slot", "release", "deadline", "position")], "in_mix")


def mixed(df: DataFrame, shares: dict[str, int] = SHARES, other: int = OTHER, block: int = BLOCK,
          id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """All rows and columns of ``df``, dealt and sorted by position, so that
    the files written from it hold the mix in order."""
    rows = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.struct("*").alias("original"))
    placed = _positions(rows, shares, other, block).select("position", "original")
    return (placed.repartitionByRange(task_partitions(df.sparkSession), "position")
            .sortWithinPartitions("position").select("original.*"))


def mix_order(df: DataFrame, shares: dict[str, int] = SHARES, other: int = OTHER, block: int = BLOCK,
              source_col: str = "source") -> DataFrame:
    """``df``, as read from the files that ``mixed`` was written to, with
    ``mix_order`` (0, 1, 2, ... in sending order) and ``in_mix``: the row goes
    out before the first slot that stays empty. The numbers of files and the
    classes' counts decide, so only these are collected or broadcast."""
    file = F.col("_metadata.file_name")
    rows = df.select(F.struct("*").alias("original"), file.alias("file"), F.col("_metadata.row_index").alias("place"))
    number = F.regexp_extract("file", r"^part-(\d+)", 1).cast("long")
    earlier = Window.orderBy(number, "file").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    files = (df.select(file.alias("file")).groupBy("file").agg(F.count(F.lit(1)).alias("n"))
             .select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start")))

    names, weights = _ordered(shares, other)
    total = {r["cls"]: r["n"] for r in df.select(_class(F.col(source_col), names).alias("cls"))
             .groupBy("cls").agg(F.count(F.lit(1)).alias("n")).collect()}
    live = sorted(total)
    quota = [weights[c] for c in live]
    slots = pfair_period(quota)
    periods, rest = divmod(_first_empty(slots, [-(-total[c] // block) for c in live], quota), max(1, sum(quota)))
    sent = [periods * q + sum(j == i for j, *_ in slots[:rest]) for i, q in enumerate(quota)]
    mixed_rows = sum(min(total[c], n * block) for c, n in zip(live, sent))
    placed = rows.join(F.broadcast(files), "file").withColumn("at", F.col("start") + F.col("place"))
    return placed.select("original.*", F.col("at").alias("mix_order"), (F.col("at") < F.lit(mixed_rows)).alias("in_mix"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_positions(read_table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """The schedule by a recursive query, ranks by one window per class."""
    names = sorted(SHARES, key=lambda s: (-SHARES[s], s))
    cases = " ".join(f"WHEN source = '{n}' THEN {i}" for i, n in enumerate(names))
    weights = ", ".join(f"({i}, {w})" for i, w in enumerate([SHARES[n] for n in names] + [OTHER]))
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, source, CASE {cases} ELSE {len(names)} END AS cls,
                            md5(coalesce(doc_id::VARCHAR, '')) AS order_key FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY order_key, doc_id) - 1 AS rank FROM d),
c AS (SELECT cls, q, row_number() OVER (ORDER BY cls) AS i, n
      FROM (VALUES {weights}) w(cls, q) JOIN (SELECT cls, count(*) AS n FROM d GROUP BY cls) USING (cls)),
p AS (SELECT list(q ORDER BY i) AS qs, sum(q)::BIGINT AS period, count(*) AS m FROM c),
sim AS (
  SELECT 0::BIGINT AS t, list_transform(qs, lambda q: 0::BIGINT) AS sent, 0::BIGINT AS pick, 0::BIGINT AS k FROM p
  UNION ALL
  SELECT t + 1, list_transform(range(1, m + 1), lambda j: sent[j] + CASE WHEN j = best THEN 1 ELSE 0 END), best, sent[best]
  FROM (SELECT t, sent, m, list_min(list_transform(list_filter(range(1, m + 1),
               lambda j: sent[j] * period // qs[j] <= t),
               lambda j: ((sent[j] + 1) * period + qs[j] - 1) // qs[j] * 10000 + j)) % 10000 AS best
        FROM sim, p WHERE t < period)),
s AS (SELECT cls, q, n, k, t - 1 AS in_period, k * period // q AS release_in,
             ((k + 1) * period + q - 1) // q AS deadline_in, period
      FROM sim JOIN c ON c.i = sim.pick, p WHERE t > 0),
e AS (SELECT min((n + {BLOCK - 1}) // {BLOCK} // q * period + in_period) AS first_empty FROM s
      WHERE k = (n + {BLOCK - 1}) // {BLOCK} % q)
SELECT doc_id, source, rank::BIGINT AS rank, (rank // {BLOCK})::BIGINT AS block,
       (rank // {BLOCK} // q * period + in_period)::BIGINT AS slot,
       (rank // {BLOCK} // q * period + release_in)::BIGINT AS release,
       (rank // {BLOCK} // q * period + deadline_in)::BIGINT AS deadline,
       ((rank // {BLOCK} // q * period + in_period) * {BLOCK} + rank % {BLOCK})::BIGINT AS position,
       rank // {BLOCK} // q * period + in_period < first_empty AS in_mix
FROM r JOIN s ON r.cls = s.cls AND rank // {BLOCK} % q = k, e
"""


ORACLE = _oracle()

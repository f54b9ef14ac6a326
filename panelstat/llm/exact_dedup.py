"""Exact dedup by skew-safe combining, with DataFrame functions only.

Texts are equal when they are identical after lower-casing A-Z; null counts
as empty. Copies are combined in three steps, and each compares whole texts:

1. every task combines its own copies (the map side of the first aggregate);
2. groups of (digest, salt, text) are merged; the salt is the sending task's
   number, so a text that a third of all rows share is spread over ``salts``
   reducers and no reducer sees more than one row per sender;
3. the salts' winners are combined per (digest, text): at most ``salts`` rows
   for any text.

Rows then find their group through narrow digests (two independent ones and
the length); should two different texts ever agree in all three, the query
fails instead of merging them.

Defined results. Null text: as the empty text. Null ids: they lose to any
other id; a group of nulls only has a null ``keep_id`` and keeps its rows.
Rows that repeat an id and text: all carry the same flags, and
``drop_exact_copies`` leaves one of them. Empty table: no rows. Extra columns
are not read by ``exact_groups`` and are kept by ``drop_exact_copies``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from panelstat.llm.common import ascii_lower, materialize, read_table

SALTS = 16


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS,
                 digest: Callable[[Column], Column] = sha256_hex) -> DataFrame:
    """One row per row of ``df``: ``id_col``, ``keep_id`` (largest id with
    that text), ``group_size``, ``kept`` and ``text_sha256``."""
    rows = df.select(F.col(id_col).alias("row_id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("norm"))
    digested = rows.select("row_id", "norm", digest(F.col("norm")).alias("digest"))

    salted = (digested.withColumn("salt", F.spark_partition_id() % salts)
              .groupBy("digest", "salt", "norm").agg(F.max("row_id").alias("winner"), F.count(F.lit(1)).alias("copies")))
    groups = (salted.groupBy("digest", "norm").agg(F.max("winner").alias("keep_id"), F.sum("copies").alias("group_size"))
              .select("digest", F.md5(F.col("norm").cast("binary")).alias("second"),
                      F.length("norm").alias("chars"), "keep_id", "group_size"))
    groups = (groups.groupBy("digest", "second", "chars")
              .agg(F.count(F.lit(1)).alias("texts"), F.max("keep_id").alias("keep_id"),
                   F.max("group_size").alias("group_size"))
              .withColumn("group_size", F.when(F.col("texts") == 1, F.col("group_size"))
                          .otherwise(F.raise_error(F.lit("different texts agree in every digest")))))
    # one column joins them: the groups are dealt anew for it, and Spark can split the rows of a hot text
    key = F.concat_ws(":", "digest", "second", "chars").alias("key")
    keyed = digested.select("row_id", "digest", F.md5(F.col("norm").cast("binary")).alias("second"),
                            F.length("norm").alias("chars"), sha256_hex(F.col("norm")).alias("text_sha256"))
    keyed = keyed.select("row_id", "text_sha256", key)
    return keyed.join(groups.select(key, "keep_id", "group_size"), "key").select(
        F.col("row_id").alias(id_col), "keep_id", F.col("group_size").cast("long").alias("group_size"),
        F.col("row_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows of ``df`` that stay, all columns as they were. Ids decide, so
    a row whose id repeats with another text stays if that id stays with
    either; rows equal in id and text are one."""
    kept = (exact_groups(df, id_col, text_col, salts).where("kept")
            .groupBy(F.col(id_col).alias("kept_id"), F.col("text_sha256").alias("kept_sha"))
            .agg(F.count(F.lit(1)).alias("times")))
    kept = materialize(kept, "kept")  # narrow, read twice below
    digest = sha256_hex(ascii_lower(F.coalesce(df[text_col], F.lit(""))))

    def found(which: DataFrame) -> DataFrame:
        return df.join(which, df[id_col].eqNullSafe(which["kept_id"]) & (digest == which["kept_sha"]), "left_semi")

    repeated = found(kept.where("times > 1")).withColumn("__sha__", digest).dropDuplicates([id_col, "__sha__"])
    return found(kept.where("times = 1")).unionByName(repeated.drop("__sha__"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read_table(spark, sf_dir, "documents"))


ORACLE = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
           FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM d
"""

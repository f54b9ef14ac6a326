"""Sinks (S12-S15). Every sink is a distributed write; nothing is gathered on
the driver."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelstat.functions.text import file_safe
from panelstat.session import shared_path


def write_records(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """UTF-8 JSON lines; non-ASCII kept, nulls written as explicit null."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_array(df: DataFrame, path: str, pretty: bool = False) -> None:
    """Every part file is one JSON array of its rows (S12), written row by row."""
    rows = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false", "pretty": str(pretty).lower()}).alias("value"))

    def bracketed(batches):
        import pyarrow as pa

        held = None
        for batch in batches:
            rows = batch.column(0).to_pylist()
            if not rows:
                continue
            before = [] if held is None else [held + ","]
            rows[0] = "[" + rows[0] if held is None else rows[0]
            held = rows.pop()
            yield pa.RecordBatch.from_arrays([pa.array(before + [r + "," for r in rows], pa.string())], names=["value"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held + "]"], pa.string())], names=["value"])

    rows.mapInArrow(bracketed, "value string").write.mode("overwrite").text(path)


def stored(spark, df: DataFrame, key: str, name: str, buckets: int | None = None) -> DataFrame:
    """``df`` written as a table bucketed and sorted by ``key`` under the shared folder.
    Tables of one key and number of buckets join without an exchange (J13)."""
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = shared_path(spark, name)
    table = f"{name}_{path[-32:]}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
    return spark.table(table)


def _json_key(c) -> "F.Column":
    """A string as a quoted JSON key."""
    return F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")


def _json_object(entries, key: str, val: str) -> "F.Column":
    """``{key: raw-json-value, ...}`` from an array of structs, keys sorted."""
    return F.concat(F.lit("{"), F.array_join(F.transform(F.sort_array(entries), lambda e: F.concat(
        _json_key(e[key]), F.lit(":"), e[val])), ","), F.lit("}"))


def profile_json(long: DataFrame, outer: str = "state", inner: str = "sector",
                 metric: str = "metric", category: str = "category", value: str = "value") -> DataFrame:
    """Long metric rows -> one JSON document per ``outer`` key:
    ``{inner: {metric: value | {category: value}}}`` (S13).

    Scalar metrics carry a null category. Each level is a grouped aggregate
    over a bounded number of entries (sectors x metrics x top-n categories),
    so the nesting runs in parallel per key. Keys are sorted at every level,
    so the text is deterministic."""
    v = F.col(value).cast("double")
    scalars = (long.where(F.col(category).isNull())
               .select(outer, inner, metric, F.coalesce(v.cast("string"), F.lit("null")).alias("_j")))
    dists = (long.where(F.col(category).isNotNull())
             .groupBy(outer, inner, metric)
             .agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(category), v)))))
                  .alias("_j")))
    metrics = scalars.unionByName(dists)
    per_inner = (metrics.groupBy(outer, inner)
                 .agg(_json_object(F.collect_list(F.struct(F.col(metric).alias("k"), F.col("_j").alias("v"))),
                                   "k", "v").alias("_j")))
    return (per_inner.groupBy(outer)
            .agg(_json_object(F.collect_list(F.struct(F.col(inner).alias("k"), F.col("_j").alias("v"))),
                              "k", "v").alias("profile")))


def write_profile(long: DataFrame, path: str, outer: str = "state", **kw) -> None:
    """One JSON line per ``outer`` key with the nested object itself."""
    docs = profile_json(long, outer, **kw)
    line = F.concat(F.lit("{"), _json_key(F.lit(outer)), F.lit(":"), _json_key(F.col(outer).cast("string")),
                    F.lit(',"profile":'), F.col("profile"), F.lit("}"))
    docs.select(line.alias("value")).write.mode("overwrite").text(path)


def _files_of_rows(folder: str):
    """Task of ``write_files``: rows (name, text) in order become files, a count comes out."""

    def write(batches):
        import uuid
        from urllib.parse import quote

        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        store, top = fs.FileSystem.from_uri(folder)
        part, hidden = TaskContext.get().partitionId(), f"{top}/_{uuid.uuid4().hex}"
        files, last, k = 0, None, 0
        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1)):
                name = name.as_py()
                last, k = name, (k + 1 if name == last else 0)
                with store.open_output_stream(hidden) as out:
                    out.write(text.as_buffer() or b"")
                    out.write(b"\n")
                shown = re.sub("^[._]", lambda m: f"%{ord(m[0]):02X}", quote(name, safe=""))  # readers skip others
                store.move(hidden, f"{top}/{shown}-{part}-{k}.txt")
                files += 1
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], names=["files"])

    return write


def write_files(df: DataFrame, path: str, name: str = "name", text: str = "value") -> int:
    """A UTF-8 text file per row, all in the new folder ``path``: ``<name>-<task>-<number>.txt``, the name
    percent-encoded, the text (null: empty) and a line break. Returns the number of files.

    Spark's writers name no files, and a folder per name costs the writer, the commit and every
    listing more than the file. Tasks write the files themselves, in a store that pyarrow knows
    (local, HDFS, S3, GCS, Azure). Rows are in order in each task and files are moved
    to their names when whole, so that a second attempt leaves the same files."""
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(folder)
    uri = re.sub(r"^file:/+", "/", store.makeQualified(folder).toString())
    rows = df.select(F.coalesce(F.col(name), F.lit("")).alias("name"), F.col(text).alias("text"))
    written = rows.sortWithinPartitions("name", "text").mapInArrow(_files_of_rows(uri), "files long")
    return written.agg(F.sum("files")).first()[0] or 0


def write_csv(df: DataFrame, path: str) -> None:
    """Header CSV, no index."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_per_model(df: DataFrame, path: str, model: str = "model") -> None:
    """One output folder per model, name '-' -> '_' (S15)."""
    (df.withColumn("_model_file", file_safe(model)).write.mode("overwrite")
       .partitionBy("_model_file").json(path))

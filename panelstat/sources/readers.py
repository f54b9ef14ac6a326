"""Readers (S1-S11). All return lazy DataFrames; the driver only learns, from two
counts over all lines, how JSON files are laid out."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from panelstat.functions.text import strip_ws


def read_records(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """JSON array (or one object) of flat records (S1). Not splittable: land
    once as Parquet before heavy use."""
    r = spark.read.option("multiLine", True)
    if schema is not None:
        r = r.schema(schema)
    return r.json(path)


# Brackets and commas around a line's records are an array's layout.
_LAYOUT_RE = r"^[\s\[,]+|[\s\],]+$"
_CORRUPT = "_corrupt"


def _record_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that hold more than layout: value, body (without it), whole (records and nothing else)."""
    lines = spark.read.text(path).withColumn("body", F.regexp_replace("value", _LAYOUT_RE, "")).where("body <> ''")
    items = F.from_json(F.concat(F.lit("["), "body", F.lit("]")), "array<map<string,string>>")
    return lines.withColumn("whole", items.isNotNull() & F.col("body").startswith("{") & F.col("body").endswith("}"))


def read_records_auto(spark: SparkSession, path: str, schema=None, quarantine: str | None = None) -> DataFrame:
    """JSON lines, and where that fails one array or object that spans lines.

    Counts over all lines decide. If no line is a record by itself, each file is read as a
    whole. If only some are not, they are no records: with ``quarantine`` and a schema they
    become rows whose column of that name holds the line, null elsewhere;
    without it, an error says how many there are. Brackets and commas around the records
    of a line are layout."""
    lines = _record_lines(spark, path)
    got = lines.agg(F.count(F.lit(1)).alias("n"), F.count_if("whole").alias("good"),
                    F.count_if(F.col("body") != F.trim("value")).alias("laid")).first()
    n, good, plain = got["n"], got["good"], got["laid"] == 0
    if 0 < good < n and quarantine is None:
        raise ValueError(f"{n - good} of {n} lines in {path} are no JSON records")
    r = spark.read.option("multiLine", n > 0 and (good == 0 or not plain))
    if schema is None:
        return r.json(path)
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if good in (0, n) and (plain or good == 0):
        read = r.schema(fields).json(path)
        return read if quarantine is None else read.withColumn(quarantine, F.lit(None).cast("string"))
    records = F.from_json(F.concat(F.lit("["), "body", F.lit("]")), ArrayType(fields))
    records = F.when(F.col("whole"), records).otherwise(F.array(F.lit(None).cast(fields)))
    rows = lines.select("value", "whole", F.explode(records).alias("r"))
    out = [F.col(f"r.`{f.name}`").alias(f.name) for f in fields.fields]
    return rows.select(*out, *([F.when(~F.col("whole"), F.col("value")).alias(quarantine)] if quarantine else []))


def _with_corrupt(fields: StructType) -> StructType:
    return StructType([*fields.fields, StructField(_CORRUPT, StringType())])


def _array_items(pieces: DataFrame, schema: StructType | str, quarantine: str | None) -> DataFrame:
    """Records from the text between closing braces."""
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    piece = F.regexp_replace("value", r"^[\s,]*\[?[\s,]*", "")
    items = pieces.select(piece.alias("_piece")).where(~F.col("_piece").rlike(r"^[\s\]]*$"))
    item = F.concat("_piece", F.lit("}"))
    one = F.from_json(item, _with_corrupt(fields), {"columnNameOfCorruptRecord": _CORRUPT})
    bad = ~F.col("_piece").startswith("{") | F.col("r").isNull() | F.col(f"r.{_CORRUPT}").isNotNull()
    got = items.select("_piece", one.alias("r")).select("_piece", "r", bad.alias("_bad"))
    values = [F.when(~F.col("_bad"), F.col(f"r.`{f.name}`")).alias(f.name) for f in fields.fields]
    if quarantine is not None:
        return got.select(*values, F.when(F.col("_bad"), F.col("_piece")).alias(quarantine))
    # without a quarantine a piece that is no record ends the read
    fail = F.raise_error(F.concat(F.lit("not a flat record: "), F.substring("_piece", 1, 80)))
    return got.where(F.when(F.col("_bad"), fail.cast("boolean")).otherwise(F.lit(True))).select(*values)


def read_array_items(spark: SparkSession, path: str, schema: StructType | str, quarantine: str | None = None) -> DataFrame:
    """Items of JSON arrays of flat records, a file read by as many tasks as it
    has splits (S1, S3). A flat record ends at its closing brace, so braces divide the
    text into records, however it is laid out in lines. A brace within a string or a nested object
    leaves pieces that do not parse: they are quarantined, or an error; never taken for records."""
    return _array_items(spark.read.option("lineSep", "}").text(path), schema, quarantine)


def read_stream_array_items(spark: SparkSession, path: str, schema: StructType | str, quarantine: str | None = None,
                            max_files: int | None = None) -> DataFrame:
    """``read_array_items`` as a stream of files (S3, ST1)."""
    r = spark.readStream.option("lineSep", "}")
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return _array_items(r.text(path), schema, quarantine)


def read_stream_records(spark: SparkSession, path: str, schema: StructType | str, multiline: bool = False,
                        max_files: int | None = None) -> DataFrame:
    """Incremental record source (S3) - the Structured Streaming file source."""
    r = spark.readStream.schema(schema).option("multiLine", multiline)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.json(path)


def read_csv_records(spark: SparkSession, path: str, required: Sequence[str], schema=None,
                     tolerant: bool = False) -> DataFrame:
    """Header CSV keeping only required columns (S4). ``tolerant`` drops lines
    with too many cells and pads those with too few (S5), whichever columns
    are asked for."""
    columns = schema if schema is not None else spark.read.option("header", True).csv(path).schema
    if isinstance(columns, str):
        columns = StructType.fromDDL(columns)
    names = [f.name for f in columns.fields]
    missing = [c for c in required if c not in names]
    if missing:
        raise ValueError(f"CSV missing required columns: {missing}")
    r = spark.read.option("header", True)
    if not tolerant:
        return r.schema(columns).csv(path).select(*[F.col(f"`{c}`") for c in required])
    # whole lines that do not fit come along; a mark behind their last cell tells how many cells there are
    line, mark = "_line", "\u0001end"
    df = r.schema(StructType(columns.fields + [StructField(line, StringType())])).option(
        "columnNameOfCorruptRecord", line).option("columnPruning", False).csv(path)
    cells = F.from_csv(F.concat(F.col(line), F.lit("," + mark)), ", ".join(f"c{k} string" for k in range(len(names) + 1)))
    fits = F.col(line).isNull()
    for k in range(len(names) + 1):
        fits = fits | F.coalesce(cells[f"c{k}"] == mark, F.lit(False))
    return df.where(fits).select(*[F.col(f"`{c}`") for c in required])


def codebook_from_rows(df: DataFrame, code: str = "_c0", label: str = "_c1", order: str | Column | None = None) -> DataFrame:
    """Rows with both cells -> (code, label), codes without the blanks around
    them; the last duplicate wins (S6, U4).

    ``order`` gives file order; without it the order of a read of one split is
    used (``monotonically_increasing_id``)."""
    o = F.monotonically_increasing_id() if order is None else F.col(order) if isinstance(order, str) else order
    rows = df.select(strip_ws(F.col(code)).alias("code"), F.col(label).alias("label"), o.alias("_o")) \
             .where((F.col("code") != "") & F.col("label").isNotNull())
    return rows.groupBy("code").agg(F.max_by("label", "_o").alias("label"))


def read_codebook_csv(spark: SparkSession, path: str, numeric_code: bool = True) -> DataFrame:
    """Headerless two-column codebook CSV (S6). Banner/header rows are dropped
    by predicate - the code must look like a code - not by position (S7).
    Later lines win, of several files those of the last by name."""
    df = spark.read.option("header", False).csv(path)
    order = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    cb = codebook_from_rows(df.select("_c0", "_c1", order.alias("_at")), order="_at")
    return cb.where(F.col("code").rlike(r"^\d+$")) if numeric_code else cb


def read_codebook_json(spark: SparkSession, path: str) -> DataFrame:
    """``{"code": "label", ...}`` object -> (code, label) rows."""
    m = spark.read.text(path, wholetext=True)
    parsed = m.select(F.from_json("value", "map<string,string>").alias("m"))
    return parsed.select(F.explode("m").alias("code", "label"))


def read_any(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """JSON or CSV by extension (S8); anything else is an error."""
    ext = os.path.splitext(path)[1].lower()
    if ext == ".json":
        return read_records_auto(spark, path, schema)
    if ext == ".csv":
        r = spark.read.option("header", True)
        return (r.schema(schema) if schema is not None else r).csv(path)
    raise ValueError(f"unsupported file type: {path}")


def read_documents(spark: SparkSession, directory: str, glob: str = "*.txt") -> DataFrame:
    """``file, text`` for every matching file, whole text, invalid UTF-8 bytes
    dropped (S9, S10). Name order is applied only at output."""
    df = (spark.read.option("pathGlobFilter", glob).text(directory, wholetext=True)
          .select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text")))
    return df.withColumn("text", F.regexp_replace("text", "�", ""))


def valid_files(spark: SparkSession, directory: str, glob: str = "*.pdf", magic: bytes = b"%PDF") -> DataFrame:
    """Files whose content begins with the (ASCII) signature (S11): path, ok.
    Empty files have no row, as Spark does not list them.

    The first bytes come from the first line of each file's first split, as text, so that no
    file is held whole and the folder is listed once."""
    lines = (spark.read.option("pathGlobFilter", glob).text(directory)
             .select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
                     F.substring("value", 1, len(magic)).alias("_head"), F.monotonically_increasing_id().alias("_at"))
             .where("_start = 0"))
    heads = lines.groupBy("_file").agg(F.min_by("_head", "_at").alias("_head"))
    # the metadata column encodes blanks and the like, the path itself does not
    path = F.url_decode(F.replace(F.col("_file"), F.lit("+"), F.lit("%2B")))
    return heads.select(path.alias("path"), (F.col("_head") == magic.decode("ascii")).alias("ok"))


def file_order(df: DataFrame, col: str = "file") -> DataFrame:
    """Output order by file name (T5)."""
    return df.orderBy(col)


def last_per_key(df: DataFrame, key: str, value: str, order) -> DataFrame:
    """Dictionary build: keep the last value per key (U4)."""
    o = F.col(order) if isinstance(order, str) else order
    return df.groupBy(key).agg(F.max_by(F.col(value), o).alias(value))


# Fixed pattern: a three-digit region code, its name, then a "Word (digits)"
# that follows it in the survey's region listing.
REGION_LINE_RE = r"(?U)(\d{3})\s+([A-Za-z\-\&\. ]+?)\s+(?=[A-Za-z]+\s*\(\d+\))"


def region_codes_from_text(df: DataFrame, text: str, order: str) -> DataFrame:
    """Region table from extracted text (X7): every code/name pair in each
    row's whole text, one row per pair; a code seen again later (by ``order``,
    then position in the text) replaces the earlier name (U4)."""
    codes = F.regexp_extract_all(F.col(text), F.lit(REGION_LINE_RE), 1)
    names = F.regexp_extract_all(F.col(text), F.lit(REGION_LINE_RE), 2)
    pairs = F.transform(codes, lambda c, i: F.struct(c.alias("code"), F.get(names, i).alias("name"), i.alias("pos")))
    ex = df.select(F.col(order).alias("_o"), F.explode(pairs).alias("_p"))
    return (ex.groupBy(F.col("_p.code").alias("code"))
            .agg(F.max_by(F.trim(F.col("_p.name")), F.struct("_o", F.col("_p.pos"))).alias("name")))

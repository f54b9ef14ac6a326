"""Projection, renaming and schema alignment.

All of these are pure projections: they compile into the scan's column list
and cost nothing at run time.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename known columns, keep the others (P1). When two columns end up with
    the same name the later one (in input order) wins, as in a dict rebuild."""
    final: dict[str, str] = {}
    for c in df.columns:
        final[mapping.get(c, c)] = c  # later source overwrites earlier
    return df.select(*[F.col(f"`{src}`").alias(dst) for dst, src in final.items()])


def select_present(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keep the listed columns that exist, in list order; ignore absent ones."""
    have = set(df.columns)
    return df.select(*[F.col(f"`{c}`") for c in cols if c in have])


def select_and_rename(df: DataFrame, cols: Sequence[str], mapping: Mapping[str, str]) -> DataFrame:
    """P2 then P1."""
    return rename_columns(select_present(df, cols), mapping)


def transform_matching(df: DataFrame, substring: str, fn) -> DataFrame:
    """Apply ``fn(Column) -> Column`` to every column whose name contains
    ``substring``, in one projection (P4)."""
    targets = [c for c in df.columns if substring in c]
    return df.withColumns({c: fn(F.col(f"`{c}`")) for c in targets})


def with_constant(df: DataFrame, name: str, value) -> DataFrame:
    """Constant column, e.g. a file identity (P5)."""
    return df.withColumn(name, F.lit(value))


def blank_to_null(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Empty strings -> null on every string column not excluded."""
    skip = set(exclude)
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType) and f.name not in skip]
    return df.withColumns({c: F.nullif(F.col(f"`{c}`"), F.lit("")) for c in cols})


def decimals_to_double(df: DataFrame) -> DataFrame:
    """Decimal columns -> double."""
    from pyspark.sql.types import DecimalType
    return df.withColumns({f.name: F.col(f"`{f.name}`").cast("double")
                           for f in df.schema.fields if isinstance(f.dataType, DecimalType)})


def normalise_headers(df: DataFrame) -> DataFrame:
    """Strip + upper-case every column name."""
    return df.toDF(*[c.strip().upper() for c in df.columns])


def align_schema(df: DataFrame, aliases: Mapping[str, Sequence[str]], types: Mapping[str, str] | None = None,
                 keep_others: bool = True) -> DataFrame:
    """Canonical column <- first present alias; typed null when none.

    ``aliases`` maps canonical name -> candidate source names (the canonical
    name itself is tried first)."""
    types = types or {}
    have = set(df.columns)
    used: set[str] = set()
    out: list[Column] = []
    for canon, cands in aliases.items():
        present = [c for c in [canon, *cands] if c in have]
        used.update(present)
        if present:
            col = F.coalesce(*[F.col(f"`{c}`") for c in present]) if len(present) > 1 else F.col(f"`{present[0]}`")
        else:
            col = F.lit(None)
        if canon in types:
            col = col.cast(types[canon])
        elif not present:
            col = col.cast("string")
        out.append(col.alias(canon))
    rest = [F.col(f"`{c}`") for c in df.columns if c not in used and c not in aliases] if keep_others else []
    return df.select(*out, *rest)


def union_panels(frames: Mapping[str, DataFrame], panel_col: str = "panel") -> DataFrame:
    """Stack survey panels by column name, tagging each with its panel."""
    out = None
    for name, df in frames.items():
        tagged = df.withColumn(panel_col, F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def read_panels(spark, paths: Mapping[str, str], aliases: Mapping[str, Mapping[str, str | None]],
                types: Mapping[str, str] | None = None, panel_col: str = "panel") -> DataFrame:
    """All panels' JSON lines in one scan, by canonical columns.

    ``paths`` maps a panel to its folder, ``aliases`` a canonical column to each
    panel's own name for it: None where the panel lacks it, the canonical name where a panel is not listed.
    A record's keys are read as they stand, and its file's path tells which apply."""
    types = types or {}
    own = {c: {p: names.get(p, c) for p in paths} for c, names in aliases.items()}
    # keys as they stand: names of two panels may differ by case alone
    record = F.from_json("value", "map<string,string>").alias("__record")
    rows = spark.read.text(list(paths.values())).select(record, F.col("_metadata.file_path").alias("__file"))
    panel = F.lit(None).cast("string")
    for name, path in paths.items():
        folder = path.split(":", 1)[-1].strip("/") + "/"
        panel = F.when(F.contains("__file", F.lit("/" + folder)), F.lit(name)).otherwise(panel)
    rows = rows.withColumn("__panel", panel)
    out = []
    for canon, names in own.items():
        value = F.lit(None).cast("string")
        for source in sorted({n for n in names.values() if n is not None}):
            of = [p for p, n in names.items() if n == source]
            value = F.when(F.col("__panel").isin(*of), F.element_at("__record", F.lit(source))).otherwise(value)
        out.append((value.cast(types[canon]) if canon in types else value).alias(canon))
    return rows.select(*out, F.col("__panel").alias(panel_col))


def positional(df: DataFrame, start: int, stop: int | None = None) -> DataFrame:
    """Columns by position."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns[start:stop]])


def with_source_file(df: DataFrame, name: str = "file") -> DataFrame:
    """File name of each record from the scan metadata."""
    return df.withColumn(name, F.col("_metadata.file_name"))

"""Code -> label lookups.

Lookups are left outer equi-joins against a codebook. A codebook is
broadcast only after its row count is checked against ``max_rows`` (a bounded
``limit(n+1).count()``); a larger codebook falls back to the planner's
shuffle join. Bounded enum maps (quarter, visit, status) are applied as a
``map`` literal, which needs no join at all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelstat.functions import _c
from panelstat.functions.text import zfill
from panelstat.session import materialize
from panelstat.sources.codebooks import (HOUSEHOLD_TYPE_DEFAULT, STATUS_DEFAULT_CATEGORY,
                                         UNKNOWN_DISTRICT, map_literal)

BROADCAST_MAX_ROWS = 100_000


def bounded_broadcast(cb: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, known_rows: int | None = None) -> DataFrame:
    """Broadcast hint only when the codebook is proven small: by a bound
    known from construction, else by counting at most ``max_rows + 1`` rows."""
    known = known_rows if known_rows is not None else getattr(cb, "_panelstat_max_rows", None)
    n = known if known is not None else cb.limit(max_rows + 1).count()
    return F.broadcast(cb) if n <= max_rows else cb


def lookup(df: DataFrame, codebook: DataFrame, on: dict[str, Column | str], label: str = "label",
           out: str | None = None, default=None, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Generic left lookup. ``on`` maps codebook column -> key expression on
    ``df``. The label lands in ``out`` (default: ``label``), ``default`` on a
    miss."""
    out = out or label
    tmp = {k: f"__k_{k}" for k in on}
    left = df.withColumns({tmp[k]: _c(v) for k, v in on.items()})
    right = codebook.select(*[F.col(k).alias(tmp[k]) for k in on], F.col(label).alias("__label"))
    joined = left.join(bounded_broadcast(right, max_rows, getattr(codebook, "_panelstat_max_rows", None)),
                       list(tmp.values()), "left")
    lab = F.col("__label") if default is None else F.coalesce(F.col("__label"), F.lit(default))
    return joined.withColumn(out, lab).drop("__label", *tmp.values())


def build_district_codebook(df: DataFrame, state: str, code: str, name: str, order) -> DataFrame:
    """Sheet rows -> (STATE, zero-filled code, name); the last row wins for a
    repeated (state, code) (J1 codebook, U4)."""
    from panelstat.functions.text import strip_ws
    o = F.col(order) if isinstance(order, str) else order
    rows = df.select(F.upper(strip_ws(F.col(state))).alias("state"), zfill(strip_ws(F.col(code).cast("string")), 2)
                     .alias("code"), strip_ws(F.col(name)).alias("label"), o.alias("_o"))
    return rows.groupBy("state", "code").agg(F.max_by("label", "_o").alias("label"))


def decode_district(df: DataFrame, districts: DataFrame, state: str = "state", code: str = "district_code",
                    out: str = "district", default: str | None = UNKNOWN_DISTRICT) -> DataFrame:
    """(upper(state), zero-filled code) -> district name; miss -> default.
    ``districts`` has columns ``state, code, label`` with upper-case states."""
    return lookup(df, districts, {"state": F.upper(F.col(state)), "code": zfill(code, 2)},
                  out=out, default=default)


def decode_region(df: DataFrame, regions: DataFrame, code: str = "region_code", out: str = "region") -> DataFrame:
    """Zero-filled code -> region; miss -> null."""
    return lookup(df, regions, {"code": zfill(code, 2)}, out=out)


def decode_household_type(df: DataFrame, types: DataFrame, sector: str = "sector", code: str = "hh_type_code",
                          out: str = "household_type") -> DataFrame:
    """(sector, code) -> label, case-sensitive sector; miss -> 'others' (J3)."""
    return lookup(df, types, {"sector": F.col(sector), "code": F.col(code).cast("string")},
                  out=out, default=HOUSEHOLD_TYPE_DEFAULT)


def decode_prefix(df: DataFrame, codebook: DataFrame, code: str, out: str, prefix_len: int | None = 2,
                  width: int = 2) -> DataFrame:
    """Label from the first ``prefix_len`` characters, zero-filled to
    ``width`` (J4). ``prefix_len=None`` uses the full code."""
    c = F.col(code).cast("string")
    key = zfill(c if prefix_len is None else F.substring(c, 1, prefix_len), width)
    return lookup(df, codebook, {"code": key}, out=out)


def decode_full(df: DataFrame, codebook: DataFrame, code: str, out: str) -> DataFrame:
    """Full code -> label, miss -> null."""
    return lookup(df, codebook, {"code": F.col(code).cast("string")}, out=out)


def enum_passthrough(col, pairs) -> Column:
    """Bounded enum map; unknown values pass unchanged."""
    c = _c(col)
    return F.coalesce(F.element_at(map_literal(pairs), c), c)


def status_category(df: DataFrame, statuses: DataFrame, code: str = "status_code",
                    out: str = "status_category") -> DataFrame:
    """Numeric status code -> labour-force category, miss -> 'unknown' (J7).
    Joins on the code, not on the status sentence."""
    return lookup(df, statuses, {"code": F.col(code).cast("string")}, label="category",
                  out=out, default=STATUS_DEFAULT_CATEGORY)


LABELS_MOST = 10_000  # labels that stand in the plan as maps


def apply_value_labels(df: DataFrame, labels: DataFrame, columns: Sequence[str], most: int = LABELS_MOST) -> DataFrame:
    """Replace codes by labels in each of ``columns``.

    ``labels`` has ``column, code, label``, one label per column and code. Up to ``most``
    labels, counted first, become a map for each column and no join is needed; more are met by
    one join for all columns: the codes are unpivoted, labelled and put back
    by row. Codes without a label pass through."""
    columns = [c for c in columns if c in df.columns]
    used = labels.where(F.col("column").isin(*columns)).select("column", F.col("code").cast("string").alias("code"), "label")
    small = used.limit(most + 1).collect()
    if len(small) <= most:
        maps: dict[str, dict] = {}
        for r in small:
            if r["code"] is not None:
                maps.setdefault(r["column"], {})[r["code"]] = r["label"]
        return df.withColumns({c: F.coalesce(F.element_at(map_literal(list(maps[c].items())), F.col(f"`{c}`").cast("string")),
                                             F.col(f"`{c}`").cast("string")) if c in maps else F.col(f"`{c}`").cast("string")
                               for c in columns})
    rows = materialize(df.withColumn("__row", F.monotonically_increasing_id()), "coded")
    codes = rows.select("__row", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("code")) for c in columns])).alias("e"))
    found = (codes.select("__row", "e.*").where("code is not null").join(used, ["column", "code"])
             .groupBy("__row").agg(F.map_from_entries(F.collect_list(F.struct("column", "label"))).alias("__labels")))
    out = rows.join(found, "__row", "left")  # a row's map has as many entries as there are columns, at most
    return out.withColumns({c: F.coalesce(F.element_at("__labels", F.lit(c)), F.col(f"`{c}`").cast("string"))
                            for c in columns}).drop("__row", "__labels")


def unmatched_codes(df: DataFrame, codebook: DataFrame, key: Column, name: str = "code") -> DataFrame:
    """Codes with no label, with their row counts."""
    left = df.select(key.alias(name)).where(F.col(name).isNotNull())
    cb = bounded_broadcast(codebook.select(F.col("code").alias(name)),
                           known_rows=getattr(codebook, "_panelstat_max_rows", None))
    return left.join(cb, name, "left_anti").groupBy(name).agg(F.count(F.lit(1)).alias("n"))

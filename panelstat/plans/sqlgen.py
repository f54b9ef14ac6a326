"""SQL text for the DuckDB oracle, mirroring the Spark estimators.

Used only to build the reference answers in ``oracle_sql()``; the library
itself never runs these strings.
"""

from __future__ import annotations


def _k(keys):
    return ", ".join(keys)


def _notnull(keys):
    return " AND ".join(f"{k} IS NOT NULL" for k in keys) or "TRUE"


def wdist(src: str, keys: list[str], value: str, weight: str | None = "weight", top_n: int | None = 5,
          digits: int | None = None, where: str = "TRUE", denominator: str = "nonnull") -> str:
    k = _k(keys)
    w = f"CAST({'1' if weight is None else weight} AS DECIMAL(26, 12))"
    share = "_cw / nullif(_tot, 0)"
    share = share if digits is None else f"round({share}, {digits})"
    totals = ("SELECT {k}, sum(_cw) AS _tot FROM per_cat GROUP BY {k}" if denominator == "nonnull"
              else "SELECT {k}, sum(_wt) AS _tot FROM base GROUP BY {k}").format(k=k)
    head = f"""WITH base AS (SELECT {k}, {value} AS _v, {w} AS _wt FROM {src} WHERE {_notnull(keys)} AND ({where})),
per_cat AS (SELECT {k}, CAST(_v AS VARCHAR) AS category, sum(_wt) AS _cw FROM base WHERE _v IS NOT NULL GROUP BY {k}, category),
totals AS ({totals}),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY {k} ORDER BY _cw DESC, category) AS INTEGER) AS rank FROM per_cat)"""
    if top_n is None:
        return f"""{head}
SELECT {k}, category, rank, {share} AS share FROM ranked JOIN totals USING ({k})"""
    return f"""{head},
_both AS (SELECT {k}, category, rank, _cw FROM ranked WHERE rank <= {top_n}
         UNION ALL
         SELECT {k}, 'other' AS category, CAST({top_n + 1} AS INTEGER) AS rank, sum(_cw) AS _cw FROM ranked
         WHERE rank > {top_n} GROUP BY {k} HAVING sum(_cw) > 0)
SELECT {k}, category, rank, {share} AS share FROM _both JOIN totals USING ({k})"""


def wmean(value: str, weight: str = "weight") -> str:
    return (f"sum(CAST({value} AS DOUBLE) * {weight}) / "
            f"nullif(sum(CASE WHEN {value} IS NOT NULL THEN {weight} END), 0)")


def cumulative(src: str, keys: list[str], value: str, weight: str | None = "weight", where: str = "TRUE") -> str:
    """keys, _v, _cw, _cum, _tot as in estimators._cumulative."""
    k = _k(keys)
    w = f"CAST({'1' if weight is None else weight} AS DECIMAL(26, 12))"
    part = f"PARTITION BY {k}" if keys else ""
    sel = f"{k}, " if keys else ""
    return f"""SELECT {sel}_v, _cw,
  sum(_cw) OVER ({part} ORDER BY _v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _cum,
  sum(_cw) OVER ({part}) AS _tot
FROM (SELECT {sel}{value} AS _v, sum({w}) AS _cw FROM {src}
      WHERE {_notnull(keys)} AND {value} IS NOT NULL AND ({where}) GROUP BY {sel}{value}) AS _pre"""


def wmedian(src: str, keys: list[str], value: str, weight: str = "weight", name: str = "median",
            where: str = "TRUE") -> str:
    k = _k(keys)
    return (f"SELECT {k}, CAST(min(_v) AS DOUBLE) AS {name} FROM ({cumulative(src, keys, value, weight, where)}) AS _c "
            f"WHERE _cum + _cum >= _tot GROUP BY {k}")


def quantile_cols(value: str, probs, names) -> str:
    return ", ".join(f"quantile_cont(CAST({value} AS DOUBLE), {p}) AS {n}" for p, n in zip(probs, names))


def bands(value: str, bands_, weight: str | None = "weight", prefix: str = "") -> str:
    w = "1.0" if weight is None else weight
    out = []
    for name, lo, hi in bands_:
        conds = []
        if lo is not None:
            conds.append(f"{value} >= {lo}")
        if hi is not None:
            conds.append(f"{value} < {hi}")
        cond = " AND ".join(conds) or "TRUE"
        out.append(f"sum(CASE WHEN coalesce({cond}, FALSE) THEN {w} ELSE 0.0 END) / nullif(sum({w}), 0) AS \"{prefix}{name}\"")
    return ", ".join(out)


def values_table(rows, cols: list[str], alias: str) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, (int, float)):
            return repr(v)
        return "'" + str(v).replace("'", "''") + "'"
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS {alias}({', '.join(cols)})"

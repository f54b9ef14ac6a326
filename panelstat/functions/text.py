"""Column -> Column helpers (JVM-side expressions, no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelstat.functions import _c

# Line breaks recognised by Python's str.splitlines (CR LF counts once).
_LINE_BREAKS = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"
# Characters Python's str.strip() treats as whitespace.
WS_CHARS = (" \t\n\u000b\u000c\r\u001c\u001d\u001e\u001f\u0085\u00a0\u1680"
            "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
            "\u2028\u2029\u202f\u205f\u3000")
_WS = "[\\s\u001c-\u001f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def zfill(col, width: int) -> Column:
    """Left-pad with zeros to ``width``; never truncates."""
    c = _c(col).cast("string")
    return F.when(F.length(c) >= width, c).otherwise(F.lpad(c, width, "0"))


def strip_ws(col) -> Column:
    """Strip all leading/trailing whitespace, not just spaces."""
    return F.btrim(_c(col), F.lit(WS_CHARS))


def collapse_ws(col) -> Column:
    """Runs of whitespace -> one space (X11)."""
    return F.regexp_replace(_c(col), f"{_WS}+", " ")


def remove_ws(col) -> Column:
    """Remove all whitespace (X11); a character translation, no regex."""
    return F.translate(_c(col), WS_CHARS, "")


def numeric_prefix(col, n: int) -> Column:
    """First ``n`` characters of the integer part of a numeric code; non-numeric
    codes pass unchanged (X5)."""
    c = _c(col).cast("string")
    num = c.try_cast("double").try_cast("bigint").cast("string")
    return F.coalesce(F.substring(num, 1, n), c)


def split_lines(col) -> Column:
    """Non-blank, stripped lines, split like Python's splitlines."""
    parts = F.split(_c(col), _LINE_BREAKS)
    return F.array_remove(F.transform(parts, lambda s: strip_ws(s)), "")


def file_safe(col) -> Column:
    """Model names: '-' -> '_' (X14)."""
    return F.translate(_c(col), "-", "_")


def number_from_text(col) -> Column:
    """Strip currency signs, thousands commas and percent, then parse."""
    cleaned = F.regexp_replace(strip_ws(_c(col)), "[,%₹$]|Rs\\.?", "")
    return strip_ws(cleaned).try_cast("double")


def heading_parts(col, label_to_last_paren: bool = True) -> Column:
    """``label (variable)`` heading -> struct(label, variable).

    The variable is the text inside the last pair of parentheses. The label
    runs to the last ``(`` (or the first one when ``label_to_last_paren`` is
    False)."""
    c = _c(col)
    var = F.regexp_extract(c, r"\(([^()]*)\)[^()]*$", 1)
    if label_to_last_paren:
        label = F.regexp_extract(c, r"^(.*)\([^()]*\)[^()]*$", 1)
    else:
        label = F.regexp_extract(c, r"^([^(]*)\(", 1)
    return F.struct(strip_ws(label).alias("label"), strip_ws(var).alias("variable"))

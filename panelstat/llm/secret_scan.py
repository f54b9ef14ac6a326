"""Secret scans: keyword prefilter, anchored patterns near hits, checksums.

An Aho-Corasick automaton finds every keyword in one pass over the whole
text; a pattern is tried only where its keyword stands, from left to right and
never inside the match before. Runs of hexadecimal digits have no keyword:
their long runs are found by one plain pattern. Tokens that carry their own
checksum are reported only if it is right.

Kinds of the contract: assign, access, hex. Kinds that the method adds:
``github`` and ``npm`` (30 characters and the CRC-32 of these in base 62),
``card`` (payment numbers of known issuers that pass the Luhn check) and
``private_key`` (PEM headers).

Defined results. Null text: as the empty text, which holds nothing: zeros, the
digest of the empty string and an empty ``spans``. Repeated rows are scanned
one by one. Very long texts are scanned whole. Empty table: no rows. Extra
columns are not read. Positions count code points.
"""

from __future__ import annotations

import functools
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from panelstat.llm.common import LOWER, UPPER, read_table

# Patterns and least lengths of the contract.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, ACCESS_LEAST = r"AKIA[A-Z0-9]+", 16
HEX, HEX_LEAST = r"[0-9a-f]+", 32
ASSIGN_LEAST = 8
# Kinds in the order of equal starts, and public token formats.
KINDS = ("assign", "access", "hex", "github", "npm", "card", "private_key")
BASE_KINDS = KINDS[:3]
KEYWORDS = [
    ("password", "assign"), ("passwd", "assign"), ("secret", "assign"), ("token", "assign"),
    ("apikey", "assign"), ("api_key", "assign"), ("akia", "access"),
    ("ghp_", "github"), ("gho_", "github"), ("ghu_", "github"), ("ghs_", "github"), ("ghr_", "github"),
    ("npm_", "npm"), ("-----begin", "private_key"),
]
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

_ASCII_LOWER = str.maketrans(UPPER, LOWER)
_ASSIGN = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(ACCESS)
_HEX = re.compile(f"[0-9a-f]{{{HEX_LEAST},}}")
_CHECKED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----")
_CARD = re.compile(r"(?<![0-9])(?:4[0-9]{3}|5[1-5][0-9]{2}|3[47][0-9]{2})[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{3,4}(?![0-9])")


def base62_crc(body: str) -> str:
    """Six base-62 digits of the CRC-32 of ``body``."""
    value, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits = BASE62[digit] + digits
    return digits


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


@functools.lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for word, kind in KEYWORDS:
        found.add_word(word, (len(word), kind))
    found.make_automaton()
    return found


def _folded(text: str) -> str:
    """Lower case with the same positions as ``text``."""
    folded = text.lower()
    return folded if len(folded) == len(text) else text.translate(_ASCII_LOWER)


def _match(kind: str, text: str, at: int) -> tuple[int, bool] | None:
    """(end, whether it counts) of the kind's match that starts at ``at``."""
    if kind == "assign":
        m = _ASSIGN.match(text, at)
        return m and (m.end(), len(m[2]) >= ASSIGN_LEAST)
    if kind == "access":
        m = _ACCESS.match(text, at)
        return m and (m.end(), m.end() - at >= ACCESS_LEAST)
    if kind == "private_key":
        m = _PEM.match(text, at)
        return m and (m.end(), True)
    m = _CHECKED.match(text, at)
    return m and (m.end(), base62_crc(m[1]) == m[2])


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every secret, by start and then by kind."""
    spans, reach = [], dict.fromkeys(KINDS, 0)
    hits = sorted((last - size + 1, kind) for last, (size, kind) in _automaton().iter(_folded(text)))
    for at, kind in hits:
        if at >= reach[kind] and (m := _match(kind, text, at)):
            reach[kind] = m[0]
            if m[1]:
                spans.append((kind, at, m[0]))
    spans += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    spans += [("card", m.start(), m.end()) for m in _CARD.finditer(text)
              if luhn(m[0].replace(" ", "").replace("-", ""))]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: ``id_col`` and ``spans``, an array of
    (kind, start, end) in the order of ``find_secrets``."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end"), s)) for s in find_secrets(t.as_py() or "")]
                     for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(span))], names=["id", "spans"])

    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(scan, f"id {kind}, spans array<struct<kind:string,start:long,end:long>>")
    return found.withColumnRenamed("id", id_col)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    def lines(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return scan_secrets(read_table(spark, sf_dir, "documents")).select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(lines(base), 256).alias("base_sha256"), lines(F.col("spans")).alias("spans"))

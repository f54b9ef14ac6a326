"""Fill-in-middle rewriting of documents with pyarrow.compute.

A batch's texts are cut into units (runs of ASCII letters, else single code points):
a mark that no UTF-8 text holds is put behind every match, and texts are split at
the marks into a list array. The lists are flattened beside their parents' indices;
a unit's ordinal is its place less its parent's first place; two cuts per
document, drawn from digests of its id, give each unit a role. Units are filtered by
role, lists are rebuilt from the counts, and ``binary_join`` makes the pieces, which
are joined in the order of the document's form. Batches are cut to a bounded number
of bytes; a text is never cut.

Forms. ``plain``: the text as it is, where it is empty, holds a marker, or the draw
says so. ``psm``: prefix, suffix, middle, each behind its marker. ``spm``: suffix,
prefix, middle. No piece of the last two holds a marker, and a marker cannot
arise where a piece meets one, so ``restored`` splits the output at the markers.

Defined results. Null text: as an empty one. Null id: its digests are those of no
digits. Repeated ids: the same draws, each row its own cuts by its own number of
units. Empty table: no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelstat.llm.common import read_table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNITS = rb"([A-Za-z]+|[^A-Za-z\x80-\xFF]|[\xC0-\xFF][\x80-\xBF]*)"  # over the bytes of UTF-8
MARK = b"\xff"
BATCH_BYTES = 1 << 21


def draws(ids: pa.Array, seed: str) -> np.ndarray:
    """Four unsigned 32-bit numbers per id: the head of the SHA-256 of seed and decimal id."""
    heads = [hashlib.sha256((seed + ("" if i is None else str(i))).encode()).digest()[:16] for i in ids.to_pylist()]
    return np.frombuffer(b"".join(heads), dtype=">u4").reshape(-1, 4).astype(np.int64)


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of about BATCH_BYTES of text, one row at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo = 0
    while lo < batch.num_rows:
        before = sizes[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(sizes, before + BATCH_BYTES, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def transformed(ids: pa.Array, texts: pa.Array, seed: str, plain_from: int, spm_below: int) -> list[pa.Array]:
    """n, form, prefix_chars, middle_chars and output of each text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    marked = pc.replace_substring_regex(texts.cast(pa.large_binary()), pattern=UNITS, replacement=b"\\1" + MARK)
    lists = pc.split_pattern(marked, pattern=MARK).cast(pa.large_list(pa.large_binary()))
    # behind the last mark every list has one more, empty unit
    n = pc.list_value_length(lists).to_numpy().astype(np.int64) - 1
    h = draws(ids, seed)
    low, high = np.minimum(h[:, 0] % (n + 1), h[:, 1] % (n + 1)), np.maximum(h[:, 0] % (n + 1), h[:, 1] % (n + 1))

    units, parent = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
    first = np.concatenate([[0], np.cumsum(n + 1)])[:-1]
    ordinal = np.arange(len(units)) - first[parent]
    role = (ordinal >= low[parent]).astype(np.int8) + (ordinal >= high[parent])

    def piece(which: int, counts: np.ndarray) -> pa.Array:
        ends = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int64())
        rebuilt = pa.LargeListArray.from_arrays(ends, units.filter(pa.array(role == which)))
        return pc.binary_join(rebuilt, pa.scalar(b"", pa.large_binary())).cast(pa.large_string())

    prefix, middle, suffix = piece(0, low), piece(1, high - low), piece(2, n + 1 - high)
    plain = pa.array((n == 0) | (h[:, 2] % 100 >= plain_from))
    for marker in (PREFIX, SUFFIX, MIDDLE):
        plain = pc.or_(plain, pc.match_substring(texts, marker))
    spm = pa.array(h[:, 3] % 100 < spm_below)
    p, s, m, none = (pa.scalar(x, pa.large_string()) for x in (PREFIX, SUFFIX, MIDDLE, ""))
    by_prefix = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, none)
    by_suffix = pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, none)
    form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))
    blank = pa.scalar(None, pa.int64())
    return [pa.array(n), form, pc.if_else(plain, blank, pc.utf8_length(prefix).cast(pa.int64())),
            pc.if_else(plain, blank, pc.utf8_length(middle).cast(pa.int64())),
            pc.if_else(plain, texts, pc.if_else(spm, by_suffix, by_prefix)).cast(pa.string())]


def restored(outputs: pa.Array, forms: pa.Array) -> pa.Array:
    """The texts that made the outputs."""
    outputs = outputs.cast(pa.large_string())
    plain = pc.equal(forms, "plain")
    # a plain output may hold any markers: it stands aside, and three empty pieces in its place
    parts = pc.split_pattern_regex(pc.if_else(plain, PREFIX + SUFFIX + MIDDLE, outputs), pattern="<[PSM]>")
    one, two, middle = (pc.list_element(parts, k) for k in (1, 2, 3))
    spm = pc.equal(forms, "spm")
    none = pa.scalar("", pa.large_string())
    whole = pc.binary_join_element_wise(pc.if_else(spm, two, one), middle, pc.if_else(spm, one, two), none)
    return pc.if_else(plain, outputs, whole).cast(pa.string())


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1:", plain_from: int = 90,
                   spm_below: int = 20) -> DataFrame:
    """One row per row of ``df``: ``id_col``, n (units), form, prefix_chars and
    middle_chars (code points, null where plain), and output, the rewritten text.
    Of a hundred documents ``plain_from`` are cut, ``spm_below`` in a hundred of those as spm."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 1):
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *transformed(part.column(0), part.column(1), seed, plain_from, spm_below)],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")
    return rows.withColumnRenamed("doc_id", id_col)


def with_restored(df: DataFrame) -> DataFrame:
    """``fill_in_middle``'s rows and the text rebuilt from output and form alone, as ``restored``."""
    place = [df.columns.index(c) for c in ("output", "form")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, place[0]):
                yield pa.RecordBatch.from_arrays([*part.columns, restored(*(part.column(k) for k in place))],
                                                 names=[*part.schema.names, "restored"])

    return df.mapInArrow(run, df.withColumn("restored", F.lit(None).cast("string")).schema)


ORACLE = r"""
WITH units AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
           sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d
    FROM documents),
heads AS (
    SELECT *, len(u) AS n, ('0x' || substr(d, 1, 8))::UBIGINT AS h1, ('0x' || substr(d, 9, 8))::UBIGINT AS h2,
           ('0x' || substr(d, 17, 8))::UBIGINT AS h3, ('0x' || substr(d, 25, 8))::UBIGINT AS h4
    FROM units),
cuts AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1))::BIGINT AS lo, greatest(h1 % (n + 1), h2 % (n + 1))::BIGINT AS hi,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90
                THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM heads),
pieces AS (
    SELECT *, coalesce(array_to_string(u[1:lo], ''), '') AS p, coalesce(array_to_string(u[lo + 1:hi], ''), '') AS m,
           coalesce(array_to_string(u[hi + 1:], ''), '') AS s
    FROM cuts)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM pieces
"""


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = with_restored(fill_in_middle(read_table(spark, sf_dir, "documents")))
    digest = [F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digest)

"""Token counts by offset-mapped attribution.

Every whole document is encoded once. A byte-level vocabulary's ids spell the
text's bytes, so running sums of their byte lengths give every token's span, and
the text's bytes turn it into characters (a token that holds part of a
character covers that character). An interval join, by binary search over
sorted section starts, finds the sections that each token overlaps. A token
that crosses a boundary is allocated by an explicit rule:

* ``most``: to the section with most of its characters, the earlier one if equal;
* ``start``: to the section of its first character;
* ``split``: to all of them, by shares of its characters.

Sections are the lines of a text, or spans from a column of (name, start, end)
in characters, end exclusive, which may leave gaps; where spans overlap, the
characters belong to the span that starts first (of equal starts, ends first), and the
other one starts behind it. Tokens without any section are counted for the section null.

Defined results. Null text: as the empty text. An empty text has one empty
line; an empty section counts no token. Spans beyond the text are cut;
null spans: no sections; a null start is the text's, a null end the text's, and a
span that ends before its start is empty. Repeated rows are counted one by one. Empty table: no
rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelstat.llm.bpe import byte_bpe
from panelstat.llm.common import read_table

RULES = ("most", "start", "split")
FLUSH = 50_000  # output rows held at once, besides one document's


def line_sections(text: str) -> list[tuple[str, int, int]]:
    """The lines of a text, each with its line break."""
    out, start = [], 0
    for k, line in enumerate(text.split("\n")):
        end = min(start + len(line) + 1, len(text))
        out.append((str(k), start, end))
        start = end
    return out


def token_spans(text: str, ids: np.ndarray, byte_lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and end, exclusive, of every token."""
    ends = np.cumsum(byte_lengths[ids])
    starts = ends - byte_lengths[ids]
    if text.isascii():
        return starts, ends
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    char_of = np.cumsum((raw & 0xC0) != 0x80) - 1
    return char_of[starts], char_of[ends - 1] + 1


def attribute(starts: np.ndarray, ends: np.ndarray, lo: np.ndarray, hi: np.ndarray,
              rule: str) -> tuple[np.ndarray, np.ndarray, float]:
    """Tokens per section (``lo`` ascending, not overlapping), tokens that
    cross into each of them, and tokens outside all."""
    m = len(lo)
    counts, crossing = np.zeros(m), np.zeros(m, dtype=np.int64)
    if not len(starts):
        return counts, crossing, 0.0
    if not m:
        return counts, crossing, float(len(starts))
    first = np.searchsorted(hi, starts, side="right")  # the first section that ends behind the token's start
    last = np.searchsorted(lo, ends, side="left") - 1  # the last one that starts before its end
    reach = np.maximum(last - first + 1, 0)
    token = np.repeat(np.arange(len(starts)), reach)
    section = np.arange(len(token)) - np.repeat(np.cumsum(reach) - reach, reach) + first[token]
    overlap = np.minimum(ends[token], hi[section]) - np.maximum(starts[token], lo[section])
    token, section, overlap = token[overlap > 0], section[overlap > 0], overlap[overlap > 0]
    met = np.bincount(token, minlength=len(starts))
    inside = np.bincount(token, weights=overlap, minlength=len(starts))
    # a token crosses if part of it lies in another section, or in none
    partial = (met[token] > 1) | (inside[token] < (ends - starts)[token])
    crossing += np.bincount(section[partial], minlength=m)
    if rule == "split":
        counts += np.bincount(section, weights=overlap / (ends - starts)[token], minlength=m)
        return counts, crossing, float(len(starts) - counts.sum())
    if rule == "start":
        own = (lo[section] <= starts[token])
    else:
        order = np.lexsort((section, -overlap, token))  # each token's best section comes first
        own = np.zeros(len(token), dtype=bool)
        own[order[np.unique(token[order], return_index=True)[1]]] = True
    counts += np.bincount(section[own], minlength=m)
    return counts, crossing, float(len(starts) - np.count_nonzero(own))


def disjoint_spans(given: list, n: int) -> list[tuple[str | None, int, int]]:
    """(name, start, end) of the given spans in a text of ``n`` characters,
    ascending and without overlaps."""
    cut = []
    for s in given:
        if s is not None:
            start = min(max(s["start"] or 0, 0), n)
            cut.append((s["name"], start, n if s["end"] is None else min(max(s["end"], start), n)))
    out, reach = [], 0
    for name, start, end in sorted(cut, key=lambda s: (s[1], s[2])):
        start = max(start, reach)
        reach = max(end, start)
        out.append((name, start, reach))
    return out


def section_tokens(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
                   spans_col: str | None = None, rule: str = "most") -> DataFrame:
    """One row per section of each row of ``df``: ``id_col``, ``section``,
    ``start``, ``end``, ``n_tokens`` (double) and ``n_crossing``; and one with
    a null section if tokens lie outside all sections."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text"), *([df[spans_col].alias("spans")] if spans_col else []))
    kind = rows.schema["id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(vocabulary)
        lengths = bpe.byte_lengths
        for batch in batches:
            held: list[list] = [[] for _ in range(6)]

            def out() -> pa.RecordBatch:
                types = [batch.column(0).type, pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
                made = pa.RecordBatch.from_arrays([pa.array(h, t) for h, t in zip(held, types)],
                                                  names=["id", "section", "start", "end", "n_tokens", "n_crossing"])
                for h in held:
                    h.clear()
                return made

            for k in range(batch.num_rows):
                doc_id, text = batch.column(0)[k].as_py(), batch.column(1)[k].as_py() or ""
                if spans_col:
                    spans = disjoint_spans(batch.column(2)[k].as_py() or [], len(text))
                else:
                    spans = line_sections(text)
                ids = np.frombuffer(bpe.encode(text), dtype=np.uint32)
                lo, hi = (np.array([s[j] for s in spans], dtype=np.int64) for j in (1, 2))
                counts, crossing, outside = attribute(*token_spans(text, ids, lengths), lo, hi, rule)
                for s, n, c in zip(spans, counts.tolist(), crossing.tolist()):
                    for h, v in zip(held, (doc_id, *s, n, c)):
                        h.append(v)
                if outside > 1e-9:
                    for h, v in zip(held, (doc_id, None, None, None, outside, 0)):
                        h.append(v)
                if len(held[0]) >= FLUSH:
                    yield out()
            yield out()

    made = rows.mapInArrow(count, f"id {kind}, section string, start long, end long, n_tokens double, n_crossing long")
    return made.withColumnRenamed("id", id_col)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counts = section_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.select("doc_id", F.col("section").cast("long").alias("line"), "start", "end",
                         F.col("n_tokens").cast("long").alias("n_tokens"), "n_crossing")

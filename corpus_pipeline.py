"""Corpus pipeline: five stages over ``documents``, each by one operator.

Every stage works on all that its predecessor kept, written as Parquet and read
again, and all but the last return the columns of ``documents`` (extra columns are
carried along). Nulls, empty texts, ties and empty tables: see the operators'
docstrings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelstat.llm.common import read_table
from panelstat.llm.exact_dedup import drop_exact_copies
from panelstat.llm.jaccard_join import drop_near_copies
from panelstat.llm.mixing import mix_order, mixed
from panelstat.llm.piece_transducer import with_pieces
from panelstat.llm.quality import fit, keep_quality
from panelstat.session import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return keep_quality(docs, fit(docs, read_table(spark, sf_dir, "labels")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the row with the largest doc_id stays."""
    return drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five-word shingles, Jaccard similarity
    0.8 or more) the row with the smallest doc_id stays."""
    return drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, in the order that interleaves the sources at their target
    weights. The order is the files' numbers and the rows' places in them; the
    next stage makes it a column. A source that has run out leaves its slots
    empty, and the others go on in their order."""
    return mixed(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns, the mix's decision for each (``mix_order``, and
    ``in_mix``: the target weights hold up to this row), and their piece ids
    (packed unsigned 32-bit numbers), counts, digest and round-trip check, named
    ``sp_...``."""
    import public_tokenizers

    return with_pieces(mix_order(docs), public_tokenizers.path("piece_bpe_32k.model"), prefix="sp_",
                       memo=120_000)  # the session holds other operators' memory, too


STAGES = [
    ("quality", quality),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("mix", mix),
    ("pieces", pieces),
]

# The classifier's decisions are learned, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

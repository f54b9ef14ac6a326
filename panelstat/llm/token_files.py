"""Token ids of whole documents in Simple-8b files, written and read back.

Writing: documents are dealt by ranges of ``doc_id`` (texts that repeat an id,
by a hash of the text), sorted within each range and encoded; every task
writes one file, block by block, and reports its name and counts. The driver
keeps one line per file: a manifest that gives each file's first id position
and lists the files of the attempts that succeeded; others are deleted.

A file holds, little-endian: the magic ``S8B1`` padded to 8 bytes; the words of
all blocks (``simple8b``); the first word of each block; per document its id, 1 if
the id is null else 0, and its number of ids; and a footer with the numbers of
words, blocks, documents and ids. Readers take 256 blocks at a time.

Defined results. Null or empty text: the end id alone. Null ids come first.
Rows that repeat an id stay apart, ordered by a hash of the text, then by the
text. Very long texts span blocks. Empty table: no files and no rows. Extra
columns are not read.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelstat.llm import simple8b
from panelstat.llm.bpe import byte_bpe
from panelstat.llm.common import read_table, task_partitions
from panelstat.session import shared_path

MAGIC = b"S8B1\0\0\0\0"
GROUP = 64  # blocks that are encoded or decoded at once


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


class _Writer:
    """Appends ids to one file; holds at most GROUP blocks of them."""

    def __init__(self, stream):
        self.stream, self.words, self.block_start = stream, 0, []
        self.ids, self.held, self.doc_rows, self.total = [], 0, [], 0
        stream.write(MAGIC)

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.doc_rows.append((0 if doc_id is None else doc_id, int(doc_id is None), len(ids)))
        self.ids.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= GROUP * simple8b.BLOCK:
            self._flush(self.held // simple8b.BLOCK * simple8b.BLOCK)

    def _flush(self, count: int) -> None:
        values = np.concatenate(self.ids) if self.ids else np.zeros(0, np.uint32)
        words, starts = simple8b.encode(values[:count])
        self.stream.write(words.astype("<u8").tobytes())
        self.block_start.extend((starts + self.words).tolist())
        self.words += len(words)
        self.ids, self.held = [values[count:]], len(values) - count

    def close(self) -> None:
        self._flush(self.held)
        self.stream.write(np.array(self.block_start, dtype="<i8").tobytes())
        self.stream.write(np.array(self.doc_rows, dtype="<i8").reshape(-1, 3).tobytes())
        self.stream.write(np.array([self.words, len(self.block_start), len(self.doc_rows), self.total], "<i8").tobytes())


def read_file(path: str) -> Iterator[tuple[int | None, Iterator[np.ndarray]]]:
    """(doc_id, its ids in chunks) of each document of a file, in order."""
    filesystem, name = _filesystem(path)
    with filesystem.open_input_file(name) as f:
        size = f.size()
        words, blocks, docs, total = np.frombuffer(f.read_at(32, size - 32), "<i8").tolist()
        if f.read_at(8, 0) != MAGIC:
            raise ValueError(f"{path} is not a token file")
        index = 8 + 8 * words
        block_start = np.frombuffer(f.read_at(8 * blocks, index), "<i8")
        rows = np.frombuffer(f.read_at(24 * docs, index + 8 * blocks), "<i8").reshape(-1, 3)

        def chunks() -> Iterator[np.ndarray]:
            for b in range(0, blocks, GROUP):
                first, last = int(block_start[b]), int(block_start[b + GROUP]) if b + GROUP < blocks else words
                data = np.frombuffer(f.read_at(8 * (last - first), 8 + 8 * first), "<u8")
                count = min(GROUP * simple8b.BLOCK, total - b * simple8b.BLOCK)
                yield simple8b.decode(data, count, block_start[b:b + GROUP] - first)

        source, rest = chunks(), np.zeros(0, np.uint64)
        for doc_id, is_null, count in rows.tolist():
            parts = []
            while count > len(rest):
                parts.append(rest)
                count -= len(rest)
                rest = next(source)
            parts.append(rest[:count])
            rest = rest[count:]
            yield (None if is_null else doc_id), parts


def write_token_files(df: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
                      end_id: int = 0) -> list[dict]:
    """Encodes every whole text of ``df`` with the vocabulary file, adds
    ``end_id`` and writes files below ``path`` in ascending order of the ids.
    Returns the manifest: file, docs, ids and start of each file."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bpe, end = byte_bpe(vocabulary), np.array([end_id], dtype=np.uint32)
        part = TaskContext.get().partitionId()
        target, writer, stream = f"{path}/part-{part:06d}-{uuid.uuid4().hex}.s8b", None, None
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if writer is None:
                    filesystem, name = _filesystem(target)
                    filesystem.create_dir(name.rpartition("/")[0], recursive=True)
                    stream = filesystem.open_output_stream(name)
                    writer = _Writer(stream)
                ids = np.frombuffer(bpe.encode(text.as_py() or ""), dtype=np.uint32)
                writer.add(doc_id, np.concatenate([ids, end]))
        if writer is not None:
            writer.close()
            stream.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "file": target, "docs": len(writer.doc_rows),
                                               "ids": writer.total}])

    tie = F.xxhash64("text")
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = (rows.repartitionByRange(task_partitions(df.sparkSession), F.col("doc_id").asc_nulls_first(), tie)
            .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie, "text"))
    made = rows.mapInArrow(write, "part long, file string, docs long, ids long").collect()  # a line per file

    manifest, start = [], 0
    for r in sorted(made, key=lambda r: r["part"]):
        manifest.append({"file": r["file"], "docs": r["docs"], "ids": r["ids"], "start": start})
        start += r["ids"]
    from pyarrow import fs

    filesystem, folder = _filesystem(path)
    filesystem.create_dir(folder, recursive=True)
    listed = {m["file"].rpartition("/")[2] for m in manifest}
    for info in filesystem.get_file_info(fs.FileSelector(folder)):  # attempts that were lost
        if info.base_name.endswith(".s8b") and info.base_name not in listed:
            filesystem.delete_file(info.path)
    with filesystem.open_output_stream(f"{folder}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """One row per document of the files below ``path``: doc_id, start,
    n_tokens, ids_crc32 and, unless ``with_ids`` is false, ids."""
    filesystem, folder = _filesystem(path)
    with filesystem.open_input_file(f"{folder}/manifest.json") as f:
        manifest = json.loads(f.read())
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for line in batch.to_pylist():
                out, held, start = [], 0, line["start"]
                for doc_id, parts in read_file(line["file"]):
                    count, crc = sum(map(len, parts)), 0
                    for p in parts:
                        crc = zlib.crc32(p.astype("<u4").tobytes(), crc)
                    row = {"doc_id": doc_id, "start": start, "n_tokens": count, "ids_crc32": crc}
                    out.append(row | {"ids": np.concatenate(parts).astype(np.int64)} if with_ids else row)
                    start, held = start + count, held + 1 + count * with_ids
                    if held > 50_000:
                        yield pa.RecordBatch.from_pylist(out, schema=arrow)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)

    arrow = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")]
                      + ([("ids", pa.list_(pa.int64()))] if with_ids else []))
    files = spark.createDataFrame([(m["file"], m["start"]) for m in manifest], "file string, start long")
    return files.repartition(max(1, len(manifest))).mapInArrow(read, schema)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_path(spark, "token-files")
    write_token_files(read_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(spark, path, with_ids=False)

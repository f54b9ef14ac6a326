"""SentencePiece encoding and decoding by a weighted finite-state transducer.

A model file is compiled into transducers that are composed with each input on
the fly:

* the normaliser: a blank in front of a text that is not empty, blanks as the
  piece mark;
* the pieces: an arc for every piece that stands at a position. In a unigram
  model its weight is minus the piece's score. A character without a piece goes
  through byte fallback, one arc that writes its UTF-8 bytes; in a unigram
  model it weighs ``UNKNOWN_PENALTY`` more than the heaviest piece;
* of BPE models, whose scores only order the merges, the merge order: an acceptor
  of pairs of neighbouring arcs, made of the pieces' chains. A piece's chain
  holds a state for each of its own merges: the symbol at its left edge, the one
  at its right edge, the cost of the next merge. A pair runs the left arc's
  chain against the right arc's, the cheaper next merge first. It costs
  infinity if the symbols on both sides of the boundary would merge before
  one of the chains goes on, else 0. A sequence of pieces is the model's encoding if
  and only if each piece and each pair of neighbours is its own encoding: up to
  the first merge across a boundary, all merges within the two pieces happen as if
  they stood alone.

The encoding is the shortest path in the tropical semiring: positions are
relaxed from left to right, each arc by (min, +). In a BPE model the finite
paths to a position are encodings of the text before it, of which there is one,
so that one state is kept for each position there, too. Sums are in double
precision; of equal paths the one whose last arc is longest stays. Where no
piece of the model holds two neighbouring characters, no arc crosses, and the
path factors there; each task keeps the paths of the factors that it has met.

Models of other kinds, with normalisation rules of their own, user-defined
pieces or pieces with a blank behind a character raise.

Defined results. Null text: as the empty text, no pieces. Round trips give
the text with the piece mark itself read as a blank. Repeated rows are encoded
one by one. Empty table: no rows. Extra columns are not read by
``encode_pieces`` and are kept by ``with_pieces``.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T

from panelstat.llm.common import Memo, read_table, worker_memo

MARK = "▁"
# Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0
INFINITY = float("inf")
MEMO = 400_000  # entries of a memo, and of its former generation


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol-buffers message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, data[at:at + size]
            at += size


class PieceTransducer:
    def __init__(self, path: str, memo: int = MEMO):
        with open(path, "rb") as f:
            model = list(_fields(f.read()))
        trainer = dict(_fields(next(v for n, v in model if n == 2)))
        spec = dict(_fields(next(v for n, v in model if n == 3)))
        if trainer.get(3, UNIGRAM) not in (UNIGRAM, BPE):
            raise ValueError("neither a unigram nor a BPE model")
        self.unigram = trainer.get(3, UNIGRAM) == UNIGRAM
        if spec.get(2) or spec.get(4, 1) or not spec.get(5, 1):
            raise ValueError("the model's normaliser has rules that are not compiled here")
        self.prefix = bool(spec.get(3, 1))
        self.cost: dict[str, float] = {}
        self.number: dict[str, int] = {}
        self.bytes_of: list[bytes] = []
        self.byte_ids: dict[int, int] = {}
        self.unknown = 0
        for i, piece in enumerate(v for n, v in model if n == 1):
            got = dict(_fields(piece))
            text, kind = got[1].decode(), got.get(3, NORMAL)
            self.bytes_of.append(text.replace(MARK, " ").encode() if kind == NORMAL else b"")
            if kind == USER_DEFINED:
                raise ValueError("user-defined pieces are not compiled here")
            if kind == NORMAL:
                self.number[text] = i
                self.cost[text] = -struct.unpack("<f", got[2])[0] if 2 in got else 0.0
            elif kind == BYTE:
                self.byte_ids[int(text[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(text[3:5], 16)])
            elif kind == UNKNOWN:
                self.unknown = i
        self.inner = {p[k:k + 2] for p in self.number for k in range(len(p) - 1)}  # neighbours within a piece
        self.starts = {p[:k] for p in self.number for k in range(2, len(p))}
        self.longest: dict[str, int] = {}
        for p in self.number:
            self.longest[p[0]] = max(self.longest.get(p[0], 0), len(p))
        if any(pair[0] != MARK and pair[1] == MARK for pair in self.inner):
            raise ValueError("pieces that hold a blank behind a character are not compiled here")
        newline = any("\n" in pair for pair in self.inner)
        self.words = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+" if newline else f"\n|{MARK}*[^{MARK}\n]+|{MARK}+").findall
        self.unknown_cost = max(self.cost.values(), default=0.0) + UNKNOWN_PENALTY
        self.least = min(self.cost.values(), default=0.0) if self.unigram else 0.0  # no arc weighs less
        self.chains = Memo(self._chain, len(self.number) + memo)
        self.pairs = Memo(lambda ab: self.pair_weight(*ab), memo)
        self.factors = Memo(self._factor, memo)
        self.known = Memo(self._word, memo)

    def _chain(self, piece: str) -> list[tuple[str, str, float]]:
        """The states of a piece's own merges: symbols at its left and right
        edge, cost of the next merge (infinity in the last). Empty if the merges
        do not end in the piece, so that no encoding holds it."""
        symbols, states, cost = list(piece), [], self.cost
        while len(symbols) > 1:
            least, at = min((cost.get(symbols[k] + symbols[k + 1], INFINITY), k) for k in range(len(symbols) - 1))
            states.append((symbols[0], symbols[-1], least))
            if least == INFINITY:
                break
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
        else:
            states.append((piece, piece, INFINITY))
        return states if len(symbols) == 1 else []

    def pair_weight(self, left: str, right: str) -> float:
        """0, or infinity if a merge across the boundary comes before the two
        chains have ended. Of equal costs the leftmost merge comes first."""
        a, b, cost = self.chains[left], self.chains[right], self.cost
        i = j = 0
        while True:
            (_, x, before), (y, _, behind) = a[i], b[j]
            across = cost.get(x + y, INFINITY)
            if across < before and across <= behind:
                return INFINITY
            if before <= behind:
                if before == INFINITY:
                    return 0.0
                i += 1
            else:
                j += 1

    def shortest(self, text: str) -> list[str]:
        """The arcs of the shortest path through one factor."""
        n, pairs, chains, cost, unigram = len(text), self.pairs, self.chains, self.cost, self.unigram
        least, longest, starts, unknown = self.least, self.longest, self.starts, self.unknown_cost
        best = [0.0] + [INFINITY] * n
        last = [""] * (n + 1)
        for at in range(n):
            here, before = best[at], last[at]
            for end in range(at + 1, min(n, at + longest.get(text[at], 1)) + 1):
                if here + least >= best[end]:
                    continue
                arc = text[at:end]
                if arc in cost:
                    weight = cost[arc] if unigram else INFINITY if not chains[arc] else pairs[before, arc] if at else 0.0
                elif end == at + 1:
                    weight = unknown if unigram else pairs[before, arc] if at else 0.0
                elif arc in starts:
                    continue
                else:
                    break
                if here + weight < best[end]:
                    best[end], last[end] = here + weight, arc
        path, at = [], n
        while at:
            path.append(last[at])
            at -= len(last[at])
        return path[::-1]

    def _factor(self, text: str) -> bytes:
        ids = array("I")
        for arc in self.shortest(text):
            if arc in self.number:
                ids.append(self.number[arc])
            elif self.byte_ids:
                ids.extend(self.byte_ids[b] for b in arc.encode("utf-8", "surrogatepass"))
            else:
                ids.append(self.unknown)
        return ids.tobytes()

    def _word(self, word: str) -> bytes:
        start, out, inner = 0, [], self.inner
        for k in range(1, len(word)):
            if word[k - 1:k + 1] not in inner:
                out.append(self.factors[word[start:k]])
                start = k
        out.append(self.factors[word[start:]])
        return b"".join(out)

    def normalised(self, text: str) -> str:
        return (MARK if self.prefix and text else "") + text.replace(" ", MARK)

    def encode(self, text: str) -> bytes:
        """The ids of the whole text as unsigned 32-bit numbers, packed."""
        packed = b"".join(map(self.known.__getitem__, self.words(self.normalised(text))))
        if self.byte_ids:
            return packed
        ids = array("I")
        ids.frombytes(packed)  # without byte fallback, neighbouring unknown characters are one unknown piece
        return array("I", [x for k, x in enumerate(ids) if x != self.unknown or not k or ids[k - 1] != x]).tobytes()

    def decode(self, packed: bytes) -> str:
        ids = array("I")
        ids.frombytes(packed)
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        if self.prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


def transducer(path: str, memo: int = MEMO) -> PieceTransducer:
    """One compiled model per Python worker and model file."""
    return worker_memo(("pieces", path, memo), lambda: PieceTransducer(path, memo))


def with_pieces(df: DataFrame, model: str, text_col: str = "text", prefix: str = "", memo: int = MEMO) -> DataFrame:
    """``df`` with the columns ``piece_ids`` (packed unsigned 32-bit numbers),
    ``n_pieces``, ``n_byte_pieces``, ``ids_crc32`` and ``round_trip`` (decoding
    gives the text again), each name with ``prefix`` in front."""
    at = df.columns.index(text_col)
    added = [("piece_ids", T.BinaryType()), ("n_pieces", T.LongType()), ("n_byte_pieces", T.LongType()),
             ("ids_crc32", T.LongType()), ("round_trip", T.BooleanType())]
    schema = T.StructType(df.schema.fields + [T.StructField(prefix + n, t) for n, t in added])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = transducer(model, memo)
        fallback = set(pieces.byte_ids.values())
        for batch in batches:
            for start in range(0, max(batch.num_rows, 1), 512):
                part, rows = batch.slice(start, 512), []
                for t in part.column(at):
                    text = t.as_py() or ""
                    packed = pieces.encode(text)
                    ids = array("I")
                    ids.frombytes(packed)
                    rows.append((packed, len(ids), sum(map(fallback.__contains__, ids)), zlib.crc32(packed),
                                 pieces.decode(packed) == text.replace(MARK, " ")))
                columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(
                    (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[f.name for f in schema])

    return df.mapInArrow(encode, schema)


def encode_pieces(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: ``id_col`` and the columns of ``with_pieces``."""
    return with_pieces(df.select(id_col, text_col), model, text_col).drop(text_col)


def op8_piece_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    made = encode_pieces(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return made.drop("piece_ids")

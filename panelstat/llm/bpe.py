"""Byte-level BPE ids through the tokenizers library, at corpus speed.

The library's pre-tokeniser never joins characters across a run of white
space except for one blank before a word, so a text splits at blanks into
units that encode on their own. Each task remembers the ids of the units it
has met; the library's model encodes every unit that is new. Texts whose white
space does not split that way (runs of blanks, empty lines) go through the same
pre-tokeniser pattern, and units with letters beyond Latin, whose classes could
differ between libraries, through the whole tokenizer. A vocabulary file that declares
another normaliser, pre-tokeniser or kind of model is served by the library alone.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from array import array

import numpy as np

from panelstat.llm.common import Memo, worker_memo

# The white space and the last code point of the Latin blocks of Unicode.
WHITE = "\t-\r \x85\xa0  -     　"
LATIN_END = 0x24F
MEMO_UNITS = 400_000


def _char_class(major: str) -> str:
    chars = [chr(c) for c in range(LATIN_END + 1) if unicodedata.category(chr(c))[0] == major]
    return "".join(map(re.escape, chars))


class ByteBpe:
    """``encode(text)`` gives the ids as unsigned 32-bit numbers, packed."""

    def __init__(self, path: str, memo_units: int = MEMO_UNITS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known = self._known(self.tokenizer)
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        letters, numbers = _char_class("L"), _char_class("N")
        self.pieces = re.compile(
            f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{WHITE}{letters}{numbers}]+"
            f"|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+").findall
        self.beyond = re.compile(f"[^\\x00-{chr(LATIN_END)}]").search
        self.white = frozenset(chr(c) for c in range(0x3001) if re.match(f"[{WHITE}]", chr(c)))
        self.limit = memo_units
        self.alphabet = self._alphabet()
        self.blank = self.alphabet[32]
        self.units = Memo(self._unit, memo_units)
        self.parts = Memo(self._piece, memo_units // 2)

    @staticmethod
    def _known(tokenizer) -> bool:
        """Whether the file declares the pre-tokeniser that this module splits by."""
        declared = json.loads(tokenizer.pre_tokenizer.__getstate__()) if tokenizer.pre_tokenizer else {}
        model = tokenizer.model
        return (tokenizer.normalizer is None and declared.get("type") == "ByteLevel" and declared.get("use_regex") is True
                and declared.get("add_prefix_space") is False and type(model).__name__ == "BPE"
                and not (model.dropout or model.continuing_subword_prefix or model.end_of_word_suffix))

    @staticmethod
    def _alphabet() -> dict[int, str]:
        """Byte to the printable character that stands for it in the vocabulary:
        printable Latin-1 bytes stand for themselves, the others, in order, for
        the code points from 256 on."""
        own = {b for b in range(256) if 33 <= b <= 126 or (161 <= b <= 255 and b != 173)}
        rest = [b for b in range(256) if b not in own]
        return {b: chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)}

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():
            spelled = piece.replace(" ", self.blank)
        else:
            spelled = piece.encode().decode("latin-1").translate(self.alphabet)
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _any(self, text: str) -> bytes:
        if not text.isascii():
            if self.beyond(text):
                return self._whole(text)
        elif text[1:].isalpha() and (text[0] == " " or text[0].isalpha()):
            return self.parts[text]
        return b"".join(map(self.parts.__getitem__, self.pieces(text)))

    def _unit(self, unit: str) -> bytes | None:
        """Ids of one part between blanks, its blank included; None if the part
        does not stand on its own."""
        if not unit or unit[-1] in self.white:
            return None
        if unit.isascii() and unit.isalpha():  # one piece, kept as a unit alone
            return self._piece(" " + unit)
        return self._any(unit if unit[0] == "\n" else " " + unit)

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.known or any(s in text for s in self.special):
            return self._whole(text)
        first, *units = text.replace("\n", " \n").split(" ")
        if first and first[-1] in self.white:
            return self._any(text)
        try:
            return (self._any(first) if first else b"") + b"".join(map(self.units.__getitem__, units))
        except TypeError:  # a None: white space that does not split at blanks
            return self._any(text)

    @functools.cached_property
    def byte_lengths(self) -> np.ndarray:
        """Bytes that each id stands for."""
        if not self.known:
            raise ValueError("ids of this vocabulary file do not spell the text's bytes")
        size = self.tokenizer.get_vocab_size()
        out = np.zeros(size, dtype=np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            out[i] = len(token)  # one character of the vocabulary's alphabet per byte
        for i, t in self.tokenizer.get_added_tokens_decoder().items():
            out[i] = len(t.content.encode())
        return out


def byte_bpe(path: str) -> ByteBpe:
    """One encoder per Python worker and vocabulary file."""
    return worker_memo(("byte bpe", path), lambda: ByteBpe(path))

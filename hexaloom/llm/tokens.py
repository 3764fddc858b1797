"""Token ids by the tokenizers library, with memory of the pieces already met.

A tokenizer that splits a text into words before its merges gives every word the same ids wherever it
stands. So a text may be cut at certain blanks, each piece encoded by itself, once, and the ids joined.
The cuts are safe for the two kinds of public tokenizer files that are named in KINDS and no others;
any other file is used without memory, text by text.
"""

from __future__ import annotations

import re
import struct

import numpy as np
from tokenizers import Tokenizer

#: "byte": byte-level words, in which the blank before a word belongs to it, so that a blank between
#: two other characters always begins a word. "word": lower case, words with an end sign, no blanks.
KINDS = ("byte", "word")
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Where none of these occurs, no blank stands beside another one.
_DOUBLE = ("  ", " \n", "\n ", *"\t\r\x0b\x0c\x1c\x1d\x1e\x1f")
_WIDE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def _cut(text: str) -> list[str]:
    """Cut at the blanks that stand between two characters that aren't blank."""
    if any(d in text for d in _DOUBLE) or text[0] == " " or text[-1] == " " or not (text.isascii() or _WIDE.search(text) is None):
        return _CUT.split(text)
    return text.split(" ")


#: Plain letters, then marks none of which can begin a contraction: two words for either kind.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
_TWO_LINES = re.compile(r"(\S+)\n(\S+)")


def _shown_bytes() -> dict[int, str]:
    """The letters by which byte-level tokenizers show bytes: printable Latin-1 as it is, the rest from U+0100 on."""
    shown = {b: chr(b) for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
    rest = [b for b in range(256) if b not in shown]
    return shown | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Pieces(dict):
    """Piece -> ids; learns what it hasn't met. Holds two generations of about `limit` bytes: what is met again passes from the old one to the new."""

    def __init__(self, learn, limit: int):
        super().__init__()
        self.learn, self.limit, self.held, self.old = learn, limit, 0, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        return self.learn(piece) if ids is None else self.keep(piece, ids)

    def keep(self, piece: str, ids: bytes) -> bytes:
        if len(piece) < 200:
            if self.held >= self.limit:
                self.old, self.held = dict(self), 0
                self.clear()
            self[piece] = ids
            self.held += 190 + len(piece) + len(ids)
        return ids


class Encoder:
    """Ids of whole texts as little-endian bytes of 4-byte numbers, as Tokenizer.encode(text, add_special_tokens=False) gives them.

    specials: names of special tokens in a text are those tokens, as is the library's default; otherwise they are text. Known
    pieces, first pieces and marks are remembered within about 3 * limit bytes.
    """

    def __init__(self, path: str, kind: str | None, limit: int = 72 << 20, specials: bool = True):
        if kind not in (*KINDS, None):
            raise ValueError(f"kind is one of {KINDS} or None")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not specials
        self.kind = kind
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.merges, self.shown = self.tokenizer.model, _shown_bytes()
        self.blank = self.shown[32]
        self.pieces, self.heads, self.marks = _Pieces(self._learn_piece, limit), _Pieces(self._learn_head, limit // 4), _Pieces(self._learn_marks, limit // 4)
        # a text that may hold one of these isn't cut
        names = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if kind else []
        self.first = sorted({c for n in names for c in (n[0].lower(), n[0].upper())})
        self.named = re.compile("|".join(map(re.escape, names)), re.IGNORECASE)

    def _raw(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of one plain word, blank included, past the steps that only find words."""
        if word.isascii():  # letters are shown as they are
            shown = self.blank + word[1:] if word[0] == " " else word
        else:
            shown = word.encode().decode("latin-1").translate(self.shown)
        ids = [t.id for t in self.merges.tokenize(shown)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _learn(self, memory: _Pieces, piece: str, blank: str) -> bytes:
        if piece.isascii() and piece.isalpha():
            ids = self._word(blank + piece if self.kind == "byte" else piece.lower())
        elif m := _PLAIN.fullmatch(piece):
            word, marks = m.groups()
            if not marks:
                ids = self._word(blank + word if self.kind == "byte" else word.lower())
            else:
                met = word in memory or word in memory.old
                ids = memory[word] + self.marks[marks]
                if not met:  # most such words never come again, with these marks even less
                    return ids
        elif self.kind == "byte" and (m := _TWO_LINES.fullmatch(piece)):
            ids = memory[m[1]] + self.marks["\n"] + self.heads[m[2]]
        else:
            ids = self._raw(blank + piece)
        return memory.keep(piece, ids)

    def _learn_piece(self, piece: str) -> bytes:
        return self._learn(self.pieces, piece, " " if self.kind == "byte" else "")

    def _learn_head(self, piece: str) -> bytes:
        return self._learn(self.heads, piece, "")

    def _learn_marks(self, piece: str) -> bytes:
        return self.marks.keep(piece, self._raw(piece))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(c in text for c in self.first) and self.named.search(text):
            return self._raw(text)
        if self.kind == "byte":
            pieces = _cut(text)
            first = self.heads[pieces[0]]
            return first + b"".join(map(self.pieces.__getitem__, pieces[1:]))
        if self.kind == "word":
            return b"".join(map(self.pieces.__getitem__, text.replace("\n", " ").split(" ")))
        return self._raw(text)


_KEPT: dict[tuple[str, str | None], Encoder] = {}


def encoder(path: str, kind: str | None) -> Encoder:
    """This process's encoder; a reused Python worker keeps what it has learnt."""
    if (path, kind) not in _KEPT:
        _KEPT.clear()
        _KEPT[path, kind] = Encoder(path, kind)
    return _KEPT[path, kind]

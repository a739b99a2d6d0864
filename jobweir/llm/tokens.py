"""Token ids of whole texts, with the tokenizers library, made fast by a cache.

Byte-level BPE never joins a word to the next one: a blank between two other
characters starts the next word's token, and a line end is a token of its own.
Texts are therefore cut before blanks and line ends, each distinct piece is
encoded by the library once, and pieces that come again stay in a cache of
bounded bytes, which a worker process keeps between tasks. Texts with runs of
white space, or white space of other kinds, are cut by a stricter rule; the ids
always equal those of the whole text (tests hold this against the library).
"""

from __future__ import annotations

import os
import re
from array import array
from itertools import chain

from .common import give_back

#: Bytes of pieces and ids that a worker keeps, with what Python adds to each.
CACHE_BYTES, OVERHEAD = 64 << 20, 150
#: Longer pieces are not kept.
LONG = 64
#: Pieces that are encoded together: the library's results take about 1 KB each.
AT_ONCE = 4096
#: Characters of text that are looked up together.
CHARS = 1 << 18


class Encoder:
    """batch(texts): their token ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        give_back()  # reading the file takes several times what the tokenizer keeps
        self.cut = re.compile(r"(?<=\S)(?= \S)")
        #: By piece, as _pieces gives it: the ids.
        self.cache: dict[str | bytes, bytes] = {}
        self.held = 0

    @classmethod
    def of(cls, path: str) -> "Encoder":
        """This process's encoder for a tokenizer file."""
        import tokenizers

        held = vars(tokenizers).setdefault("_encoders_of_jobweir", {})
        if path not in held:
            held[path] = cls(path)
        return held[path]

    def _encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(texts), AT_ONCE):
            found = self.tokenizer.encode_batch_fast(texts[at : at + AT_ONCE], add_special_tokens=False)
            out += [array("I", e.ids).tobytes() for e in found]
        return out

    def _pieces(self, text: str) -> list[str | bytes]:
        """A text's pieces. A blank before a piece is left out, and a line end
        stands for itself; a piece that has no blank before it is UTF-8 bytes,
        so that no character of a text can be taken for a mark."""
        n = text.count(" ") + text.count("\n")
        words = text.split()
        # as many words as separators and one, and nothing else between them
        if len(words) == n + 1 and len(text) - sum(map(len, words)) == n:
            pieces: list[str | bytes] = text.replace("\n", " \n").split(" ")
            pieces[0] = pieces[0].encode()
            return pieces
        return [p.encode() for p in self.cut.split(text)]

    @staticmethod
    def _full(piece: str | bytes) -> str:
        """The stretch of text that a piece stands for."""
        if isinstance(piece, bytes):
            return piece.decode()
        return piece if piece[:1] == "\n" else " " + piece

    def _chunk(self, texts: list[str]) -> list[bytes]:
        parts = [self._pieces(t) for t in texts]
        ids = list(map(self.cache.get, chain.from_iterable(parts)))
        if None in ids:
            pieces = list(chain.from_iterable(parts))
            lacking = list({p for p, x in zip(pieces, ids) if x is None})
            new = dict(zip(lacking, self._encode([self._full(p) for p in lacking])))
            ids = [new[p] if x is None else x for p, x in zip(pieces, ids)]
            for p, x in new.items():
                if self.held >= CACHE_BYTES:
                    break
                if len(p) <= LONG:
                    self.cache[p] = x
                    self.held += len(p) + len(x) + OVERHEAD
        out, at = [], 0
        for p in parts:
            out.append(b"".join(ids[at : at + len(p)]))
            at += len(p)
        return out

    def batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= CHARS):
                size += len(texts[to])
                to += 1
            out += self._chunk(texts[at:to])
            at = to
        return out

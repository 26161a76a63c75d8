"""Token ids by the tokenizers library, over a cache of pieces of text.

The vocabulary is in lower case, drops white space and never joins letters with punctuation, so the ids of a
text are the ids of its pieces in order.  Everything beyond that cut is left to the library.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from functools import cache

import numpy as np

from tessera.llm.common import CACHES, Words

#: Pieces kept by each Python worker, about 200 bytes each.
CACHE_PIECES = 400_000
#: A lower-case word of letters of ASCII and Latin-1.
PLAIN = re.compile("[a-zß-öø-ÿ]+")
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def distinct(data: np.ndarray, at: np.ndarray) -> tuple[list[str], Words, np.ndarray]:
    """The different pieces of some texts, all their pieces, and for each of these which one it is.

    Pieces are words, cut where a letter meets ASCII punctuation, with ASCII letters in lower case unless a
    further character follows that may be combined with them.  Texts that may hold special strings stay as they are.
    """
    split = None
    if len(data) and b"<|" not in data.tobytes():
        upper = (data >= 65) & (data <= 90)
        upper[:-1] &= data[1:] < 128
        data = data + (upper * np.uint8(32)).astype(np.uint8)
        letter = _LETTER[data]
        letter[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        split = _MARK[data]
        split[0] = False
        split[1:] &= letter[:-1]
    all_ = Words(data, at, False, split)
    _, first, inverse = np.unique(all_.hash, return_index=True, return_inverse=True)
    raw = data.tobytes()
    return [raw[i:j].decode() for i, j in zip(all_.start[first].tolist(), all_.end[first].tolist())], all_, inverse


class Encoder:
    """ids(texts): the ids of each text as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        self.tok = tokenizer(path)
        words = self.tok.get_vocab()
        self.closing = np.zeros(max(words.values()) + 1, bool)
        self.closing[[i for w, i in words.items() if w.endswith("</w>")]] = True
        self.piece: dict[str, bytes] = {}

    def _learn(self, pieces: list[str]) -> None:
        """A thousand plain words are encoded as one text and cut after each closing symbol, others one by one."""
        plain = [w for w in pieces if PLAIN.fullmatch(w)]
        other = [w for w in pieces if not PLAIN.fullmatch(w)] if len(plain) < len(pieces) else []
        for i in range(0, len(plain), 1000):
            group = plain[i : i + 1000]
            ids = np.array(self.tok.encode_batch_fast([" ".join(group)], add_special_tokens=False)[0].ids, "<u4")
            ends = (np.flatnonzero(self.closing[ids]) + 1).tolist()
            if len(ends) == len(group):
                raw, begin = ids.tobytes(), 0
                for w, j in zip(group, ends):
                    self.piece[w] = raw[4 * begin : 4 * j]
                    begin = j
            else:
                other += group
        for i in range(0, len(other), 1000):  # an encoding takes far more memory than its ids
            for w, e in zip(other[i : i + 1000], self.tok.encode_batch_fast(other[i : i + 1000], add_special_tokens=False)):
                self.piece[w] = array("I", e.ids).tobytes()

    def look_up(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece; new ones are learned."""
        new = [w for w in pieces if w not in self.piece]
        if len(self.piece) + len(new) > CACHE_PIECES:  # the cache starts again
            self.piece, new = {}, pieces
        if new:
            self._learn(new)
        return list(map(self.piece.__getitem__, pieces))

    def ids(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts in a row, and where each text's ids start (one more entry: the end)."""
        words, which, inverse = distinct(data, at)
        found = self.look_up(words)
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), "<u4")
        begin = np.cumsum(size) - size
        each = size[inverse]
        ends = np.cumsum(each)
        out = flat[np.repeat(begin[inverse] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)]
        return out, np.concatenate([[0], ends])[which.doc]


@cache
def encoder(path: str) -> Encoder:
    """One for each Python worker, kept for its later tasks."""
    return Encoder(path)


CACHES += [tokenizer, encoder]


def crc(data: bytes) -> int:
    return zlib.crc32(data)

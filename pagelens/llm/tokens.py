"""Token ids of whole texts by the tokenizers library, for the operators that write or pack ids.

Byte-level BPE never joins what stands before a white-space run with the run, nor letters with the signs behind them
(but for an apostrophe), so a text is cut there and each different piece is encoded once.  Runs of white space of any
length stay one piece, and so does the special token.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

#: Where a text may be cut: in front of white space that follows none.
CUT = re.compile(r"(?<=\S)(?=[ \t\r\n])")
#: What lies between such places.
PIECE = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[^\w'])|\s*(?:\S+|[^\S \t\r\n]\s*)+|\s+")
#: Characters that are cut into pieces at a time, and up to which a piece is remembered; pieces of a generation of the memory.
STRETCH, SHORT, KNOWN = 1 << 18, 40, 700_000
#: Signs that are no white space for certain.
SOLID = re.compile("[!-~À-ÖØ-öø-ÿ]")


def vocabulary(file: str | None = None) -> str:
    """The tokenizer's file; the public byte-level BPE unless another is named."""
    return file or public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(maxsize=4)
def tokenizer(file: str) -> Tokenizer:
    return Tokenizer.from_file(file)


def id_width(file: str) -> int:
    """Bytes that hold every id of the vocabulary."""
    return 2 if tokenizer(file).get_vocab_size() <= 1 << 16 else 4


class Ids(dict):
    """The ids of pieces as little-endian unsigned integers of `width` bytes, remembered in two generations.

    New pieces that start with a space and end with a solid sign are encoded together, as one text: in front of white space that
    follows none a text may be cut.  The bytes that tokens stand for tell where each piece ends.
    """

    def __init__(self, file: str, width: int = 4):
        self.tokenizer, self.width, self.older = tokenizer(file), width, {}
        self.sizes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, number in self.tokenizer.get_vocab().items():
            self.sizes[number] = len(token)

    def encoded(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, f"<u{self.width}")

    def learn(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """The ids of pieces that are not remembered; the short ones are, from now on."""
        if len(self) >= KNOWN:
            self.older = dict(self)
            self.clear()
        found, words = {}, []
        for piece in pieces:
            if (ids := self.older.get(piece)) is not None:
                found[piece] = self[piece] = ids
            elif len(piece) <= SHORT and piece[0] in " \n" and SOLID.match(piece[-1]) and "<|" not in piece:
                words.append(piece)
            else:
                found[piece] = self.encoded(piece).tobytes()
                if len(piece) <= SHORT:
                    self[piece] = found[piece]
        if words:
            ids = self.encoded("".join(words))
            ends = np.cumsum(self.sizes[ids])
            stops = np.searchsorted(ends, np.cumsum([len(w.encode()) for w in words])) + 1
            data, start = ids.tobytes(), 0
            for piece, stop in zip(words, (stops * self.width).tolist(), strict=True):
                found[piece] = self[piece] = data[start:stop]
                start = stop
        return found

    def of(self, text: str) -> bytes:
        """All ids of a text."""
        out = []
        for start, end in stretches(text):
            pieces = PIECE.findall(text, start, end)
            found = list(map(self.get, pieces))
            if None in found:
                places = [i for i, ids in enumerate(found) if ids is None]
                new = self.learn({pieces[i] for i in places})
                for i in places:
                    found[i] = new[pieces[i]]
            out.append(b"".join(found))
        return b"".join(out)


@functools.lru_cache(maxsize=4)
def shared_ids(file: str, width: int) -> Ids:
    """What the tasks of one Python worker remember together."""
    return Ids(file, width)


def stretches(text: str) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive parts of a text that end where it may be cut."""
    start = 0
    while start < len(text):
        found = CUT.search(text, start + STRETCH) if len(text) - start > STRETCH else None
        end = found.start() if found else len(text)
        yield start, end
        start = end

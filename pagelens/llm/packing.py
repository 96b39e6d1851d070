"""Hierarchical multi-length packing of tokenised documents.

Each task packs the documents of its partition; nothing is shuffled and only one buffer of ids is held.  A document is
its byte-BPE ids and then id 0.  Full windows of the longest tier are cut off first.  What remains of a document is
routed to the smallest tier (a power of two) that holds it.  The longest tier is packed first: a remainder opens a
window, the gap is filled with whole remainders of the shorter tiers, largest first, and what is then still open is
closed with a piece cut from a short one.  The other tiers are packed into windows of their own size.  What is left in
the end is cut into windows of falling powers of two, so no window needs padding.  Windows are then dealt to step
groups, the longest first to the group with the fewest tokens, so that the groups of a buffer are of like size.

Defined results: a null text counts as empty, and an empty one is the single id 0; repeated rows are packed as often as
they occur; null doc_ids are kept; an empty table gives no rows; extra columns are ignored; a text longer than any
window is cut.  sequence_id and step_id hold the number of the partition in their upper bits.
"""

from __future__ import annotations

import base64
import bisect
import functools
import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm import tokens
from pagelens.llm.common import trim

#: Fixed value: the special token of the vocabulary, the next id after its ranks.
END = "<|endoftext|>"
TIERS = (64, 128, 256, 512, 1024)
#: Runs of white space, and from how many characters on they are long.
WHITE, LONG_RUN = re.compile(r"\s{2,}"), 20_000
#: Tokens that a task gathers before it packs them.
BUFFER = 2_000_000
#: Tokens of a step group.
STEP = 64 * 1024
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_id long"


@functools.lru_cache(maxsize=4)
def encoder(ranks_file: str) -> tiktoken.Encoding:
    """The byte-BPE vocabulary; its ranks are the ids of byte_bpe_50k.json, whose ids a test compares."""
    with open(ranks_file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={END: len(ranks)})


def ids_of(text: str, encoding: tiktoken.Encoding) -> list[int]:
    """The ids of a text; `END` inside a text is one token, as the tokenizer's own file has it.

    The pattern matcher of the rank encoder ends the process on a very long run of white space; such texts go to the other
    library, which has the same ids.
    """
    if len(text) > LONG_RUN and max(map(len, WHITE.findall(text)), default=0) > LONG_RUN:
        return np.frombuffer(tokens.shared_ids(tokens.vocabulary(), 4).of(text), "<u4").tolist()
    return encoding.encode(text, allowed_special={END}) if END in text else encoding.encode_ordinary(text)


class Packer:
    """Packs the documents of one partition; `rows` are the pieces made so far."""

    def __init__(self, partition: int, tiers: tuple[int, ...] = TIERS, step: int = STEP):
        self.tiers, self.step, self.base = tuple(sorted(tiers)), step, partition << 32
        self.sequences = self.steps = 0
        self.docs: list[tuple[int | None, np.ndarray]] = []
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, ids))
        self.held += len(ids)

    def windows(self) -> Iterator[list[tuple[int, int, int]]]:
        """Windows as lists of pieces (document, start, length)."""
        top = self.tiers[-1]
        rest: dict[int, list[tuple[int, int, int]]] = {t: [] for t in self.tiers}  # (length, document, start)
        for d, (_, ids) in enumerate(self.docs):
            whole = len(ids) - len(ids) % top
            for start in range(0, whole, top):
                yield [(d, start, top)]
            if left := len(ids) - whole:
                rest[self.tiers[bisect.bisect_left(self.tiers, left)]].append((left, d, whole))
        short = [t for t in self.tiers[:-1] if rest[t]]
        for t in short:
            rest[t].sort()
        spare: list[tuple[int, int, int]] = []
        for length, d, start in sorted(rest[top], reverse=True):
            window, gap = [(d, start, length)], top - length
            while gap and short:
                for t in reversed(short):
                    at = bisect.bisect_right(rest[t], (gap, len(self.docs), 0)) - 1
                    if at >= 0:
                        length, d, start = rest[t].pop(at)
                        break
                else:  # nothing fits whole: cut the shortest
                    t = short[0]
                    length, d, start = rest[t].pop(0)
                    bisect.insort(rest[short[0]], (length - gap, d, start + gap))
                    length = gap
                window.append((d, start, length))
                gap -= length
                short = [t for t in short if rest[t]]
            if gap:  # no short remainders left
                spare += window
            else:
                yield window
        rest[top] = []
        for t in reversed(self.tiers):
            open_, room = [], t
            for length, d, start in [*((n, d, s) for d, s, n in spare), *reversed(rest[t])]:
                while length:
                    take = min(room, length)
                    open_.append((d, start, take))
                    start, length, room = start + take, length - take, room - take
                    if not room:
                        yield open_
                        open_, room = [], t
            spare = open_
        yield from self.falling(spare)

    @staticmethod
    def falling(pieces: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
        """Windows whose sizes are the powers of two that make up the length of the pieces."""
        total, pieces = sum(n for _, _, n in pieces), list(pieces)
        for bit in range(total.bit_length() - 1, -1, -1):
            room, window = total & (1 << bit), []
            while room:
                d, start, n = pieces.pop(0)
                take = min(room, n)
                window.append((d, start, take))
                room -= take
                if take < n:
                    pieces.insert(0, (d, start + take, n - take))
            if window:
                yield window

    def flush(self) -> pa.RecordBatch:
        made = sorted(self.windows(), key=lambda w: -sum(n for _, _, n in w))
        groups = [(0, k) for k in range(max(1, -(-self.held // self.step)))]
        columns: list[list] = [[] for _ in range(9)]
        for window in made:
            size = sum(n for _, _, n in window)
            tokens, k = heapq.heappop(groups)
            heapq.heappush(groups, (tokens + size, k))
            offset = 0
            for d, start, n in window:
                doc_id, ids = self.docs[d]
                row = (doc_id, start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids), self.base | self.sequences, offset, self.tiers[min(bisect.bisect_left(self.tiers, size), len(self.tiers) - 1)], self.base | (self.steps + k))
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
                offset += n
            self.sequences += 1
        self.steps += len(groups)
        self.docs, self.held = [], 0
        kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def pack(docs: DataFrame, ranks_file: str | None = None, tiers: tuple[int, ...] = TIERS, buffer: int = BUFFER, step: int = STEP) -> DataFrame:
    """One row for each piece of a document (SCHEMA)."""
    ranks_file = ranks_file or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(ranks_file)
        packer = Packer(TaskContext.get().partitionId(), tiers, step)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                ids = ids_of(text.as_py() or "", encoding)
                ids.append(0)
                packer.add(doc_id.as_py(), np.array(ids, "<u4"))
                if packer.held >= buffer:
                    yield packer.flush()
        if packer.docs:
            yield packer.flush()
        trim()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)

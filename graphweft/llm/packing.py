"""Sum-of-squares online packing of token sequences.

Each partition packs its own stream of documents, so nothing is shuffled and
a lost task is repeated alone. A document of more than a window is cut into
full windows; what is left, or a shorter document, goes to the fill level
that makes the sum of squared counts of partly filled windows smallest. The
counts are kept in an array by level. At the end of a partition, and whenever
the open windows hold OPEN_TOKENS, they are poured together by cutting: all but
one come out full, and that one stays open. So memory is bounded and at most
one window of each partition is left part full.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft.llm.common import pick
from graphweft.llm.tokens import cached_tokenizer, slices

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = [x.split()[0] for x in PIECES.split(", ")]
#: A partition's sequence ids start at its number times this.
STRIDE = 1 << 40
#: Tokens in open windows from which they are poured together (four bytes each).
OPEN_TOKENS = 1 << 22


class SumOfSquares:
    """Places items of 1 to window - 1 tokens. put() returns the windows that
    an item fills; flush() returns the rest, at most one of them part full."""

    def __init__(self, window: int):
        self.window, self.held = window, 0  # held: tokens in open windows
        self.count = np.zeros(window + 1, np.int64)  # open windows by fill level; the ends stay 0
        self.open: list[list[list]] = [[] for _ in range(window)]

    def level(self, size: int) -> int:
        """The fill level to place an item at; 0 opens a window. Ties: the fullest."""
        w, n = self.window, self.count
        # by how much the sum of squares grows, halved, with its constant left out
        at = np.arange(w - size, 0, -1)
        at = at[n[at] > 0]
        rise = n[at + size] - n[at] + 1.0
        rise[at + size == w] -= 0.5  # a full window is not counted
        if len(at):
            k = int(np.argmin(rise))
            if rise[k] <= n[size] + 0.5:
                return int(at[k])
        return 0

    def put(self, piece: tuple, size: int) -> list | None:
        h = self.level(size)
        if h:
            pieces = self.open[h].pop()
            self.count[h] -= 1
            pieces.append(piece)
        else:
            pieces = [piece]
        self.held += size
        if h + size == self.window:
            self.held -= self.window
            return pieces
        self.open[h + size].append(pieces)
        self.count[h + size] += 1
        return None

    def pour(self, cut) -> list[list]:
        """The full windows of flush(); one that isn't full stays open."""
        out = self.flush(cut)
        if out and (size := sum(p[2] for p in out[-1])) < self.window:
            self.open[size].append(out.pop())
            self.count[size] += 1
            self.held = size
        return out

    def flush(self, cut) -> list[list]:
        """cut(piece, k): the first k tokens of a piece, and the rest."""
        left = [p for level in range(self.window - 1, 0, -1) for p in self.open[level]]
        self.__init__(self.window)
        out: list[list] = []
        low, high = 0, len(left) - 1
        while low <= high:
            pieces = left[low]
            low += 1
            room = self.window - sum(p[2] for p in pieces)
            while room and low <= high:
                last = left[high][-1]
                if last[2] <= room:
                    pieces.append(left[high].pop())
                    room -= last[2]
                else:
                    head, left[high][-1] = cut(last, room)
                    pieces.append(head)
                    room = 0
                if not left[high]:
                    high -= 1
            out.append(pieces)
        return out


def cut(piece: tuple, k: int) -> tuple[tuple, tuple]:
    doc, start, length, raw, total = piece
    return (doc, start, k, raw[: 4 * k], total), (doc, start + k, length - k, raw[4 * k :], total)


def _pack(batches, tokenizer: str, white_space_dropped: bool, end_id: int, window: int):
    coder, end = cached_tokenizer(tokenizer, white_space_dropped), end_id.to_bytes(4, "little")
    packer, sequence = SumOfSquares(window), TaskContext.get().partitionId() * STRIDE
    rows: list[tuple] = []

    def emit(pieces: list) -> None:
        nonlocal sequence
        offset = 0
        for doc, start, length, raw, total in pieces:
            rows.append((doc, start, length, zlib.crc32(raw), total, sequence, offset))
            offset += length
        sequence += 1

    def taken():
        cols = list(zip(*rows, strict=True))
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=NAMES)

    for b in batches:
        for ids, texts in slices(b):
            for doc, raw in zip(ids, coder.encode(texts), strict=True):
                raw += end
                total = len(raw) // 4
                whole = total // window * window
                for s in range(0, whole, window):
                    emit([(doc, s, window, raw[4 * s : 4 * (s + window)], total)])
                if whole < total and (full := packer.put((doc, whole, total - whole, raw[4 * whole :], total), total - whole)):
                    emit(full)
                if packer.held >= OPEN_TOKENS:
                    for pieces in packer.pour(cut):
                        emit(pieces)
            if len(rows) > 5000:
                yield taken()
    for pieces in packer.flush(cut):
        emit(pieces)
        if len(rows) > 5000:
            yield taken()
    if rows:
        yield taken()


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, window: int = 1024, white_space_dropped: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): a
    row for each piece of a document in a sequence of at most `window` ids.

    Null and empty texts are the end id alone; repeated rows are packed as
    documents of their own; no documents give no rows.
    """
    fn = functools.partial(_pack, tokenizer=tokenizer, white_space_dropped=white_space_dropped, end_id=end_id, window=window)
    return pick(docs, id_col, text_col).mapInArrow(fn, PIECES)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, n_pieces, length) of packed pieces."""
    return pieces.groupBy("sequence_id").agg(F.count(F.lit(1)).alias("n_pieces"), F.sum("length").alias("length"))

"""Hard negatives by bit-sliced integer products.

Components become integers and are cut into bit planes. A row's product with
an anchor is built from the most significant plane on (the sign plane first);
after each plane the planes still to come can add no more than
(2^k - 1) * (sum of the anchor's positive components), and no less than
(2^k - 1) * (sum of its negative ones). Once a pair's interval lies outside
what its anchor still looks for, the pair is dropped. While many pairs of a
block are left, planes are multiplied as matrices; then pair by pair.

Anchors are handled in blocks of a stated size: one block at a time is sent to
the tasks, each of which streams its rows past it and keeps the best of each
anchor; the rows themselves are never shuffled after they are cleaned. A
second pass of the same kind has the positives' scores and with them the band
that a negative's score must lie in.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphweft.llm.common import stored

SCALE = 256
#: Components saturate here, so that all sums of up to 8,192 of them are exact in doubles.
LARGEST = (1 << 20) - 1
#: Bytes of anchors in a block, at four a component: what is sent to a task at once.
BLOCK_BYTES = 8 << 20
#: Rows and anchors whose products are held at once.
ROWS, ANCHORS = 2048, 256
#: With fewer pairs left than one in so many, planes are multiplied pair by pair.
SPARSE = 16


def prepare(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, vector array<int>) of the rows that take part."""
    x = F.col(vector_col).cast("array<double>")
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    whole = F.transform(x, lambda c: F.greatest(F.least(F.floor(c * SCALE), F.lit(LARGEST)), F.lit(-LARGEST - 1)).cast("int"))
    key = F.col(id_col).cast("long")
    label = F.col(label_col).cast("int")
    told = F.when(key % 7 == 0, (label + 1) % 10).otherwise(label)
    own = vectors.where(key.isNotNull() & label.isNotNull() & x.isNotNull() & ~odd)
    return own.select(key.alias("vec_id"), told.alias("label"), whole.alias("vector")).distinct()


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of ints as one matrix; shorter vectors count as ended by zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    if len(size) and (size == width).all():
        return flat.reshape(-1, width).astype(np.float64)
    out = np.zeros((len(size), width))
    row = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    inside = at < width
    out[row[inside], at[inside]] = flat[inside]
    return out


class Planes:
    """Rows of whole numbers as bit planes: bits (besides the sign), the sign
    plane and, by place, the planes of 2^place."""

    def __init__(self, rows: np.ndarray):
        whole = rows.astype(np.int64)
        self.n, self.most = len(rows), np.abs(rows).max(initial=1)
        self.bits = int(np.maximum(whole, ~whole).max(initial=0)).bit_length()
        self.sign = (whole < 0).astype(np.float32)
        self.planes = [((whole >> k) & 1).astype(np.float32) for k in range(self.bits)]

    def part(self, own: slice) -> Planes:
        out = object.__new__(Planes)
        out.bits, out.most, out.sign, out.planes = self.bits, self.most, self.sign[own], [p[own] for p in self.planes]
        out.n = len(out.sign)
        return out


def sliced(rows: Planes, anchors: np.ndarray, wanted) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, score) of the pairs that `wanted` never refused. wanted(low,
    high, row, anchor) tells which pairs may still qualify, given that their
    scores lie from low to high; row and anchor are index arrays that go with
    low, or slices of the whole block."""
    none = np.zeros(0, np.int64)
    if not rows.n or not len(anchors):
        return none, none, none
    # whole numbers below 2^24 are exact in single floats, whatever the order of sums
    kind = np.float32 if (rows.most * 2 + 1) * np.abs(anchors).sum(1).max(initial=1) < 1 << 24 else np.float64
    a = anchors.T.astype(kind)
    plus, minus = np.maximum(anchors, 0).sum(1), np.minimum(anchors, 0).sum(1)
    at = by = score = None
    dense = -(1 << rows.bits) * (rows.sign.astype(kind, copy=False) @ a)
    for k in range(rows.bits, -1, -1):
        if k < rows.bits:
            plane = rows.planes[k]
            if at is None:
                dense += (1 << k) * (plane.astype(kind, copy=False) @ a)
            else:
                for lo in range(0, len(at), 1 << 14):
                    part = slice(lo, lo + (1 << 14))
                    score[part] += (1 << k) * np.einsum("ij,ij->i", plane[at[part]].astype(np.float64), anchors[by[part]])
        rest = (1 << k) - 1
        if at is None:
            left = wanted(dense + rest * minus, dense + rest * plus, slice(None), slice(None))
            if not k or np.count_nonzero(left) * SPARSE < left.size:
                at, by = np.nonzero(left)
                score = dense[at, by].astype(np.float64)
        else:
            left = wanted(score + rest * minus[by], score + rest * plus[by], at, by)
            at, by, score = at[left], by[left], score[left]
        if at is not None and not len(at):
            break
    return at, by, score.astype(np.int64)


class Kept:
    """The first `most` of each slot seen so far by score, then id, and the
    score of the last where a slot is full."""

    def __init__(self, slots: int, most: int):
        self.most, self.slots = most, slots
        self.slot = self.ids = self.score = np.zeros(0, np.int64)
        self.floor = np.full(slots, -(2.0**62))

    def add(self, slot: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        if not len(slot):
            return
        slot, ids, score = (np.concatenate(p) for p in ((self.slot, slot), (self.ids, ids), (self.score, score)))
        order = np.lexsort((ids, -score, slot))
        slot = slot[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        held = rank < self.most
        order = order[held]
        self.slot, self.ids, self.score = slot[held], ids[order], score[order]
        last = rank[held] == self.most - 1
        self.floor[self.slot[last]] = self.score[last]


class Block:
    """A block of anchors by label; with their positives and those' scores
    (nan where there is none), a column for each, once they are known."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        order = np.argsort(labels, kind="stable")
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        self.positives = self.scores = None

    def parts(self, begin: int, end: int):
        return ((lo, min(lo + ANCHORS, end)) for lo in range(begin, end, ANCHORS))


def _chunks(batches, width: int):
    """(ids, labels, planes) of at most ROWS rows, sorted by label."""
    for b in batches:
        for lo in range(0, b.num_rows, ROWS):
            part = b.slice(lo, ROWS)
            labels = part.column(1).to_numpy()
            order = np.argsort(labels, kind="stable")
            yield part.column(0).to_numpy()[order], labels[order], Planes(matrix(part.column(2), width)[order])


BEST = pa.schema([("anchor", pa.int32()), ("slot", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _told(kept: dict[int, Kept], slots: int):
    for lo, own in kept.items():
        yield pa.RecordBatch.from_arrays([pa.array((lo + own.slot // slots).astype(np.int32)), pa.array((own.slot % slots).astype(np.int32)), pa.array(own.ids), pa.array(own.score)], schema=BEST)


def _positives(batches, block: Block, most: int):
    """The task's best `most` rows of each anchor's label."""
    kept: dict[int, Kept] = {}
    for ids, labels, rows in _chunks(batches, block.vectors.shape[1]):
        for label in np.unique(labels):
            own = slice(*np.searchsorted(labels, [label, label + 1]))
            mine, planes = ids[own], rows.part(own)
            for lo, hi in block.parts(*np.searchsorted(block.labels, [label, label + 1])):
                held = kept.setdefault(lo, Kept(hi - lo, most))
                names, floor = block.ids[lo:hi], held.floor

                def wanted(low, high, at, by, names=names, floor=floor, mine=mine):
                    if isinstance(at, slice):
                        return (high >= floor) & (mine[:, None] != names)
                    return high >= floor[by]

                at, by, score = sliced(planes, block.vectors[lo:hi], wanted)
                held.add(by, mine[at], score)
    yield from _told(kept, 1)


def _negatives(batches, block: Block, most: int, low_cent: int, high_cent: int):
    """The task's best `most` rows of another label in each positive's band."""
    slots = block.scores.shape[1]
    # low_cent * positive <= 100 * negative <= high_cent * positive, in whole numbers; nan is never met
    least, last = np.ceil(low_cent * block.scores / 100), np.floor(high_cent * block.scores / 100)
    kept: dict[int, Kept] = {}
    for ids, labels, rows in _chunks(batches, block.vectors.shape[1]):
        for lo, hi in block.parts(0, len(block.ids)):
            held = kept.setdefault(lo, Kept((hi - lo) * slots, most))
            floors, tops = np.maximum(least[lo:hi], held.floor.reshape(-1, slots)), last[lo:hi]

            def wanted(low, high, at, by, own=block.labels[lo:hi], floors=floors, tops=tops, labels=labels):
                met = np.zeros(high.shape, bool)
                for j in range(slots):  # the interval meets what is still open of a positive's band
                    met |= (high >= floors[by, j]) & (low <= tops[by, j])
                return met & (labels[:, None] != own) if isinstance(at, slice) else met

            at, by, score = sliced(rows, block.vectors[lo:hi], wanted)
            place, slot = np.nonzero((score[:, None] >= floors[by]) & (score[:, None] <= tops[by]))
            held.add(by[place] * slots + slot, ids[at[place]], score[place])
    yield from _told(kept, slots)


TOLD = "anchor int, slot int, vec_id long, score long"


def first(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """rows with `rank`, the first `most` of each key by score, then id. Each
    task has sent no more than `most` a key, and sends no more after its own ranking."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def _blocks(anchors: DataFrame, block_bytes: int) -> int:
    total = anchors.agg(F.sum(F.size("vector").cast("long") * 4 + 16)).first()[0] or 0
    return -(-total // block_bytes)


OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(
    vectors: DataFrame, every: int = 100, positives: int = 5, most: int = 10, low_cent: int = 30, high_cent: int = 90, block_bytes: int = BLOCK_BYTES,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score):
    for each anchor (vec_id divisible by `every`) and each of its first
    `positives` other rows of its label, the first `most` rows of other labels
    with low_cent * positive <= 100 * negative <= high_cent * positive; higher
    scores come first, ties by smaller vec_id.

    Rows with a null id, label, vector or component, or one that isn't finite,
    take no part; rows equal in id, label and vector count once; rows that
    share an id but not the rest are rows of their own, and none is a positive
    of its own id. Components beyond 2^20 saturate. Vectors of unequal lengths
    are taken as ended by zeros; an empty one scores 0. No anchors, or none
    with a positive or a negative: no rows. Other columns are left behind."""
    spark = vectors.sparkSession
    rows = stored(prepare(vectors, id_col, vector_col, label_col), "vectors")
    anchors = rows.where(F.col("vec_id") % every == 0)
    n_blocks = _blocks(anchors, block_bytes)
    own = anchors.withColumn("block", F.pmod(F.xxhash64("vec_id", "label", "vector"), F.lit(max(n_blocks, 1))))
    out = spark.createDataFrame([], OUT)
    for k in range(n_blocks):
        held = own.where(F.col("block") == k).select("vec_id", "label", "vector").toArrow().combine_chunks()
        if not held.num_rows:
            continue
        width = int(pc.max(pc.list_value_length(held.column(2))).as_py())
        block = Block(held.column(0).to_numpy(), held.column(1).to_numpy(), matrix(held.column(2), width))
        found = first(rows.mapInArrow(functools.partial(_positives, block=block, most=positives), TOLD), ["anchor"], positives)
        found = found.select("anchor", "vec_id", "score", "rank").toArrow()  # `positives` a row of the block at most
        at, rank = found.column(0).to_numpy(), found.column(3).to_numpy() - 1
        block.positives = np.zeros((len(block.ids), positives), np.int64)
        block.scores = np.full((len(block.ids), positives), np.nan)
        block.positives[at, rank], block.scores[at, rank] = found.column(1).to_numpy(), found.column(2).to_numpy()
        sent = rows.mapInArrow(functools.partial(_negatives, block=block, most=most, low_cent=low_cent, high_cent=high_cent), TOLD)
        ranked = first(sent, ["anchor", "slot"], most).mapInArrow(functools.partial(_named, ids=block.ids, positives=block.positives, scores=block.scores), OUT)
        out = out.union(stored(ranked, "negatives")) if n_blocks > 1 else ranked
    return out


def _named(batches, ids: np.ndarray, positives: np.ndarray, scores: np.ndarray):
    """Ids and scores in place of an anchor's place in its block and its positive's."""
    for b in batches:
        at, slot = b.column(0).to_numpy(), b.column(1).to_numpy()
        columns = [ids[at], positives[at, slot], b.column(4).to_numpy().astype(np.int32), b.column(2).to_numpy(), scores[at, slot].astype(np.int64), b.column(3).to_numpy()]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[x.split()[0] for x in OUT.split(", ")])

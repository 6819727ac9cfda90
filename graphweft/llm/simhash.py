"""SimHash near-duplicates over an inverted index of positional bytes.

Two 64-bit fingerprints that differ in at most `bits` bits differ in at most
so many of their eight bytes, so at least `8 - bits` bytes agree in place: the
guaranteed minimum. The index's postings are keyed by a few positions with
their bytes. Not every set of positions is needed: the sets of COVER are
chosen so that any four positions hold one of them, hence any pair with the
guaranteed matches meets in a posting. There the shared positional bytes of
each pair are tallied, pairs that reach the minimum are retained, and their
differing bits counted. Postings of one position would make a pair of every
256th fingerprint with every other; three keep them short.

A posting may be very long where thousands of distinct fingerprints lie close
together. Those fingerprints are linked instead through the values within
half the distance of each: two that reach a common value are linked, two
that are linked reach one, and a value's fingerprints are all linked to the
smallest of them, so the work grows with the fingerprints, not their pairs.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft.llm.common import batch_of, pick, stored
from graphweft.llm.components import components
from graphweft.llm.tokens import slices

#: Postings with more distinct fingerprints are linked through common values.
LONG_POSTING = 4096
#: Places that a component's name is sent to.
SPREAD = 16


def fingerprint(text: str, width: int = 4, seed: int = 42) -> int:
    """ASCII letters lower-cased; words between ASCII white space; a bit is set
    if it is in over half of the shingles' XXH64."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    if n < width:
        return xxhash.xxh64_intdigest(joined, seed)
    stop = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    start = np.concatenate([[0], stop[: n - width] + 1])
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(start.tolist(), stop[width - 1 :].tolist(), strict=True)], "<u8")
    tally = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 15):
        part = np.unpackbits(hashes[lo : lo + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        tally += part.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(tally * 2 > len(hashes), bitorder="little").tobytes(), "little")


def _fingerprints(batches, width: int):
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
    for b in batches:
        for ids, texts in slices(b, 1024):
            values = np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64)
            yield batch_of(schema, {"doc_id": ids, "fp": values})


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long; 0 for texts without words."""
    return pick(docs, id_col, text_col).mapInArrow(functools.partial(_fingerprints, width=width), "doc_id long, fp long")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def posting_sets(shared: int) -> list[tuple[int, ...]]:
    """Sets of positions such that any `shared` positions hold one of them.
    For four: three groups in a ring; the triples within a group, or with two
    of a group and one of the next. Four positions always hold such a triple."""
    if shared != 4:
        return list(itertools.combinations(range(8), shared))
    group = (0, 0, 0, 1, 1, 1, 2, 2)
    fits = lambda at, g: sorted((group[p] - g) % 3 for p in at) in ([0, 0, 0], [0, 0, 1])
    return [at for at in itertools.combinations(range(8), 3) for g in range(3) if fits(at, g)]


def posting_masks(bits: int) -> list[int]:
    return [signed(sum(0xFF << (8 * p) for p in at)) for at in posting_sets(8 - bits)]


def roots(fps: np.ndarray, bits: int) -> np.ndarray:
    """For each of a posting's fingerprints the index of its component's first."""
    n = len(fps)
    linked = np.zeros((n, n), bool)
    for lo in range(0, n, 256):
        differ = fps[lo : lo + 256, None] ^ fps[None, :]
        tally = (differ.view(np.uint8).reshape(len(differ), n, 8) == 0).sum(axis=2, dtype=np.int8)
        at, other = np.nonzero(tally >= 8 - bits)  # count filter; the rest is not verified
        near = np.bitwise_count(differ[at, other]) <= bits
        linked[lo + at[near], other[near]] = True
    label = np.arange(n)
    while True:
        # a few rows at a time: labels of all pairs at once take eight bytes each, 134 MB in the longest posting
        new = np.concatenate([np.where(linked[lo : lo + 256], label[None, :], n).min(axis=1) for lo in range(0, n, 256)])
        new = np.minimum(new, label)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _links(batches, bits: int):
    """Rows (k, fp) sorted by k; links between the fingerprints of each k."""
    held_k, held_f = np.zeros(0, np.int64), np.zeros(0, np.int64)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def linked(k: np.ndarray, f: np.ndarray):
        cut = np.flatnonzero(np.diff(k)) + 1
        start = np.concatenate([[0], cut])
        size = np.diff(np.concatenate([start, [len(k)]]))
        two = start[size == 2]
        differ = f[two] ^ f[two + 1]
        tally = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1, dtype=np.int8)
        near = tally >= 8 - bits
        near[near] = np.bitwise_count(differ[near].view(np.uint64)) <= bits
        a, b = [f[two][near]], [f[two + 1][near]]
        for s, m in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            own = f[s : s + m]
            root = roots(own.view(np.uint64), bits)
            moved = np.flatnonzero(root != np.arange(m))
            a.append(own[moved])
            b.append(own[root[moved]])
        return batch_of(schema, {"a": np.concatenate(a), "b": np.concatenate(b)})

    for batch in batches:
        k = np.concatenate([held_k, batch.column(0).to_numpy(zero_copy_only=False)])
        f = np.concatenate([held_f, batch.column(1).to_numpy(zero_copy_only=False)])
        last = int(np.searchsorted(k, k[-1])) if len(k) else 0
        if last:
            yield linked(k[:last], f[:last])
        held_k, held_f = k[last:], f[last:]
    if len(held_k):
        yield linked(held_k, held_f)


def links(distinct: DataFrame, bits: int = 4, long_posting: int = LONG_POSTING) -> DataFrame:
    """Links (a, b) that join up the same components as all pairs of the
    distinct fingerprints `fp` at `bits` or fewer differing bits."""
    masks = posting_masks(bits)
    # A few bytes become many: they are dealt to as many tasks as the postings first.
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = distinct.repartition(tasks, "fp").select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("p", "own")).select(F.xxhash64("p", "own").alias("k"), "fp")
    counts = keys.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    shared = keys.join(counts, "k")
    short = shared.where(F.col("n") <= long_posting).select("k", "fp").repartition("k").sortWithinPartitions("k")
    found = short.mapInArrow(functools.partial(_links, bits=bits), "a long, b long")
    crowded = shared.where(F.col("n") > long_posting).select("fp").distinct()
    half, other = bits // 2, bits - bits // 2
    flips = lambda r: [signed(sum(1 << p for p in at)) for n in range(r + 1) for at in itertools.combinations(range(64), n)]

    def values(r: int) -> DataFrame:
        return crowded.select("fp", F.explode(F.array(*[F.lit(x) for x in flips(r)])).alias("flip")).select(F.expr("fp ^ flip").alias("value"), "fp")

    if half == other:
        least = values(half).groupBy("value").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).where(F.col("b") < F.col("top")).select("value", "b")
        through = values(half).join(least, "value").where(F.col("fp") != F.col("b")).select(F.col("fp").alias("a"), "b")
    else:  # an odd distance: one end reaches a value within half of it, the other within the rest
        near, far = values(half), values(other).withColumnRenamed("fp", "b")
        through = near.join(far, "value").where(F.col("fp") != F.col("b")).select(F.col("fp").alias("a"), "b")
    return found.union(through.distinct()).distinct()


def near_duplicates(docs: DataFrame, width: int = 4, bits: int = 4, long_posting: int = LONG_POSTING, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id).

    component_id is the smallest doc_id among all documents reachable over
    links of `bits` or fewer differing bits. Null and empty texts have
    fingerprint 0 and are linked like any other; a null doc_id is nobody's
    component; repeated rows give repeated rows.
    """
    rows = stored(fingerprints(docs, width, id_col, text_col), "fingerprints")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    parts = components(links(distinct.select("fp"), bits, long_posting)).withColumnRenamed("node", "fp")
    rooted = stored(distinct.join(parts, "fp", "left"), "components")
    # One component may hold very many fingerprints: its name goes to SPREAD places.
    linked = rooted.where("root is not null").withColumn("part", F.pmod(F.xxhash64("fp"), F.lit(SPREAD)))
    named = linked.groupBy("root").agg(F.min("least").alias("component_id")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)).cast("array<long>")))
    classes = linked.join(named, ["root", "part"]).select("fp", "component_id").union(rooted.where("root is null").select("fp", "least"))
    return rows.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, width: int = 4, bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that are in the group of a smaller doc_id. Rows with
    a null doc_id stay; rows that repeat a kept doc_id stay."""
    found = near_duplicates(docs, width, bits, id_col=id_col, text_col=text_col)
    gone = found.where(F.col("doc_id") > F.col("component_id")).select(F.col("doc_id").alias("_gw_gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["_gw_gone"], "left_anti")

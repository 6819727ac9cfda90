"""Periodic runs of words: an all-lag scan.

A text's words become ids; the id array is compared with itself shifted by
each lag up to n / 3, a block of lags in one vectorised comparison, and true
stretches are measured. Each task takes a document with a range of lags: a
text whose n * n / 3 comparisons exceed `UNIT` is dealt out, one range a task,
and what its ranges find is gathered by document (a text has fewer runs than
words). All other texts have one range and are never shuffled.
"""

from __future__ import annotations

import functools
import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft.llm.common import batch_of, pick, stored
from graphweft.llm.quality import SPACES

#: A run has at least so many words, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Comparisons of words in one range of lags, about.
UNIT = 1 << 26
#: Comparisons held at once.
CELLS = 1 << 20
ALL_TRUE = np.uint64(0x0101010101010101)


def ids_of(words: list[bytes]) -> np.ndarray:
    """A number for each word; equal words, equal numbers, from 0."""
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))
    return ids.astype(np.uint16) if len(known) < 65_000 else ids


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Every tenth document by crc32 of its id gets a periodic tail; without an id none does."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def stretches(ids: np.ndarray, first: int, last: int) -> np.ndarray:
    """(start, length, period) of each maximal stretch in which words `period`
    apart are identical, for the periods from first to last, of the least length."""
    n = len(ids)
    width = -(-n // 8) * 8
    top = np.iinfo(ids.dtype).max
    here = np.full(width, top, ids.dtype)
    here[:n] = ids
    there = np.full(width + last, top - 1, ids.dtype)  # never equal to what pads `here`
    there[:n] = ids
    shifted = np.lib.stride_tricks.sliding_window_view(there, width)
    out = []
    step = max(1, CELLS // max(width, 1))
    for lo in range(first, last + 1, step):
        hi = min(lo + step, last + 1)
        same = shifted[lo:hi] == here
        # a long enough stretch covers eight words that begin at a multiple of eight
        for k in np.flatnonzero((same.view(np.uint64) == ALL_TRUE).any(1)):
            q = lo + int(k)
            edge = np.flatnonzero(np.diff(np.concatenate(([0], same[k].view(np.int8), [0]))))
            start, size = edge[::2], edge[1::2] - edge[::2] + q
            good = size >= max(LEAST_WORDS, LEAST_PERIODS * q)
            if good.any():
                out.append(np.stack([start[good], size[good], np.full(int(good.sum()), q)], 1))
    return np.concatenate(out).astype(np.int64) if out else np.zeros((0, 3), np.int64)


def smallest(found: np.ndarray) -> np.ndarray:
    """Runs by start, then period. A stretch of three periods or more that has
    a smaller one too is, by Fine and Wilf, the same stretch under that lag."""
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    fresh = np.ones(len(found), bool)
    fresh[1:] = (found[1:, :2] != found[:-1, :2]).any(1)
    found = found[fresh]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def runs_of(words: list[bytes]) -> np.ndarray:
    """Every run (start, length, period) of the words."""
    last = len(words) // LEAST_PERIODS
    if len(words) < LEAST_WORDS:
        return np.zeros((0, 3), np.int64)
    return smallest(stretches(ids_of(words), 1, last))


def strongest(runs: np.ndarray) -> tuple[int, int, int] | None:
    """The run of the greatest length / period; the smallest start, then period, among equals."""
    best = None
    for start, length, period in runs.tolist():
        if best is None or length * best[2] > best[1] * period:
            best = (start, length, period)
    return best


def collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """words without what any run repeats after its first period."""
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    cover = np.cumsum(edge[:-1])
    return [words[k] for k in np.flatnonzero(cover == 0)]


OUT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
NAMES = [x.split()[0] for x in OUT.split(", ")]
_OUT = pa.schema([(n, pa.string() if n.endswith("256") else pa.int64()) for n in NAMES])
TEXTS = "doc_id long, n_runs long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_TEXTS = pa.schema([("doc_id", pa.int64()), ("n_runs", pa.int64()), ("runs", _RUN), ("collapsed", pa.binary())])


def _row(doc_id: int | None, words: list[bytes], runs: np.ndarray, digest: bool) -> tuple:
    kept = b" ".join(collapsed(words, runs))
    if not digest:
        return doc_id, len(runs), [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs.tolist()], kept
    told = "".join(f"{s},{n},{p}\n" for s, n, p in runs.tolist())
    best = strongest(runs)
    start, length, period = best or (None, None, None)
    milli = 1000 * length // period if best else None
    return doc_id, len(runs), start, length, period, milli, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return batch_of(schema, {f.name: [r[k] for r in rows] for k, f in enumerate(schema)})


def _short(batches, digest: bool, plant: bool):
    """doc_id, text: all lags at once."""
    schema = _OUT if digest else _TEXTS
    for b in batches:
        for lo in range(0, b.num_rows, 64):
            part, rows = b.slice(lo, 64), []
            for d, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                words = text.as_py().split()
                words = planted(d, words) if plant else words
                rows.append(_row(d, words, runs_of(words), digest))
            yield _batch(rows, schema)


FOUND = pa.schema([(n, pa.int64()) for n in ("key", "start", "length", "period")])


def _range(batches, plant: bool):
    """key, doc_id, text, part, parts: one range of lags of a text."""
    for b in batches:
        for k in range(b.num_rows):
            key, d, text, part, parts = (b.column(j)[k].as_py() for j in range(5))
            words = text.split()
            words = planted(d, words) if plant else words
            last = len(words) // LEAST_PERIODS
            lo, hi = 1 + last * part // parts, last * (part + 1) // parts
            found = smallest(stretches(ids_of(words), lo, hi)) if hi >= lo and len(words) >= LEAST_WORDS else np.zeros((0, 3), np.int64)
            for at in range(0, len(found), 1 << 16):
                rows = found[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), key)), *(pa.array(np.ascontiguousarray(rows[:, j])) for j in range(3))], schema=FOUND)


def _long(batches, digest: bool, plant: bool):
    """doc_id, text, found: the runs that all ranges of a text have found."""
    schema = _OUT if digest else _TEXTS
    for b in batches:
        for k in range(b.num_rows):
            d, text, found = (b.column(j)[k].as_py() for j in range(3))
            words = text.split()
            words = planted(d, words) if plant else words
            runs = np.array([(r["start"], r["length"], r["period"]) for r in found or ()], np.int64).reshape(-1, 3)
            yield _batch([_row(d, words, smallest(runs), digest)], schema)


def find_runs(docs: DataFrame, digest: bool = False, plant: bool = False, unit: int = UNIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_runs, runs, collapsed) of every document: its runs by start,
    then period, and its words but those that a run repeats after its first
    period, joined by a space. digest: the strongest run and hashes instead.
    plant: give every tenth document a periodic tail first.

    A null, empty or blank text has no words, no runs (nulls for the strongest)
    and the hashes of nothing. Repeated rows and ids, null ids too, each give a
    row of their own; a null id has no planted tail. Any other column, whatever
    its name, is left behind. Words are bytes between ASCII white space."""
    schema = OUT if digest else TEXTS
    # no text has more words than white space characters, and one; nor than half its bytes, and one
    ranges = lambda words: F.greatest(F.ceil(words.cast("double") * words / LEAST_PERIODS / unit), F.lit(1))
    few = ranges(F.octet_length(text_col) / 2 + 1)
    parts = F.when(few.isNull() | (few == 1), F.lit(1)).otherwise(ranges(F.length(text_col) - F.length(F.translate(text_col, SPACES, "")) + 1))
    own = pick(docs, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("text"), parts.cast("int").alias("parts"))
    short = own.where("parts = 1").select("doc_id", "text").mapInArrow(functools.partial(_short, digest=digest, plant=plant), schema)
    long = stored(own.where("parts > 1").withColumn("key", F.monotonically_increasing_id()), "long-texts")
    ranges = long.select("key", "doc_id", "text", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "parts").repartition("key", "part")
    found = ranges.mapInArrow(functools.partial(_range, plant=plant), "key long, start long, length long, period long")
    gathered = found.groupBy("key", "start", "length").agg(F.min("period").alias("period")).groupBy("key").agg(F.collect_list(F.struct("start", "length", "period")).alias("found"))
    rest = long.join(gathered, "key", "left").select("doc_id", "text", "found").mapInArrow(functools.partial(_long, digest=digest, plant=plant), schema)
    return short.union(rest)

"""Token ids as binary shards with Elias-Fano document boundaries.

A shard is one self-contained blob:

    magic "EFS2", then little-endian uint64: documents, ids, bytes per id,
    documents with a null id (they come first); the smallest id (int64);
    for the ends and for the ids' distances from the smallest: low bits, words
    of the low part, words of the high part, select samples;
    for both: the low part, the high part (uint64 words), the select samples
    (uint32); then the ids (uint16 or uint32).

The boundaries are the ends of the documents in the shard's concatenated
ids. An end's low bits are packed; its high part sets one bit of a unary bit
vector, so n ends below u take about n * (2 + log2(u / n)) bits. Every 64th
set bit's position is sampled; select(k) starts at a sample and counts words. The
ascending document ids are kept in the same way, so a shard has no table of
64-bit numbers; readers take every offset and id from select.
"""

from __future__ import annotations

import functools
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphweft.llm.common import batch_of, pick, stored
from graphweft.llm.tokens import cached_tokenizer, slices

MAGIC, HEAD, EVERY = b"EFS2", struct.Struct("<4Qq8Q"), 64
#: A shard is closed once it holds so many ids; one long document may exceed it.
SHARD_IDS = 1 << 20


class EliasFano:
    """A non-decreasing sequence of non-negative integers."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        if not n:
            return cls(0, 0, np.zeros(0, "<u8"), np.zeros(0, "<u8"), np.zeros(0, "<u4"))
        low_bits = max(0, (int(v[-1]) // n).bit_length() - 1)
        at = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros((int(at[-1]) + 64) // 64 * 64, np.uint8)
        bits[at] = 1
        lows = ((v[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
        return cls(n, low_bits, words(lows), words(bits), at[::EVERY].astype("<u4"))

    def low_at(self, k: int) -> int:
        out, at, left = 0, k * self.low_bits, self.low_bits
        for shift in range(0, self.low_bits, 64):
            word, bit = divmod(at + shift, 64)
            take = int(self.low[word]) >> bit
            if bit and word + 1 < len(self.low):
                take |= int(self.low[word + 1]) << (64 - bit)
            out |= (take & ((1 << min(64, left)) - 1)) << shift
            left -= 64
        return out

    def select(self, k: int) -> int:
        """The k-th value, without unpacking the others."""
        if not 0 <= k < self.n:
            raise IndexError(k)
        at, left = int(self.samples[k // EVERY]), k % EVERY
        word, bit = divmod(at, 64)
        here = int(self.high[word]) >> bit << bit  # the sampled bit and those after it
        while (ones := here.bit_count()) <= left:
            left -= ones
            word += 1
            here = int(self.high[word])
        for _ in range(left):
            here &= here - 1
        high = word * 64 + (here & -here).bit_length() - 1 - k
        return high << self.low_bits | self.low_at(k)

    def all(self) -> np.ndarray:
        """select(0), select(1), ... at once."""
        at = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))[: self.n]
        out = (at - np.arange(self.n)).astype(np.int64) << self.low_bits
        if self.low_bits:
            bits = np.unpackbits(self.low.view(np.uint8), bitorder="little")[: self.n * self.low_bits].reshape(self.n, -1)
            out |= bits.astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))
        return out


def words(bits: np.ndarray) -> np.ndarray:
    padded = np.zeros((len(bits) + 63) // 64 * 64, np.uint8)
    padded[: len(bits)] = bits
    return np.packbits(padded, bitorder="little").view("<u8")


class Ids:
    """A shard's document ids: nulls first, then ascending ones."""

    def __init__(self, nulls: int, least: int, apart: EliasFano):
        self.nulls, self.least, self.apart = nulls, least, apart

    def __len__(self) -> int:
        return self.nulls + self.apart.n

    def __getitem__(self, k: int) -> int | None:
        return None if k < self.nulls else self.least + self.apart.select(k - self.nulls)


def write_shard(doc_ids: list[int | None], parts: list[bytes], wide: bool) -> bytes:
    """parts: each document's ids as little-endian uint32. wide: keep four bytes an id."""
    ends = EliasFano.of(np.cumsum([len(p) // 4 for p in parts], dtype=np.int64))
    ids = np.frombuffer(b"".join(parts), "<u4")
    known = [d for d in doc_ids if d is not None]
    least = known[0] if known else 0
    apart = EliasFano.of(np.array([d - least for d in known], np.uint64))
    sizes = [n for e in (ends, apart) for n in (e.low_bits, len(e.low), len(e.high), len(e.samples))]
    head = HEAD.pack(len(doc_ids), len(ids), 4 if wide else 2, len(doc_ids) - len(known), least, *sizes)
    kept = [x.tobytes() for e in (ends, apart) for x in (e.low, e.high, e.samples)]
    return b"".join([MAGIC, head, *kept, ids.astype("<u4" if wide else "<u2").tobytes()])


def read_shard(blob: bytes) -> tuple[Ids, EliasFano, np.ndarray]:
    """(document ids, ends, ids); all are views of the blob."""
    if blob[:4] != MAGIC:
        raise ValueError("not a token shard")
    n, n_ids, width, nulls, least, *sizes = HEAD.unpack_from(blob, 4)
    at = 4 + HEAD.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(blob, kind, count, at)
        at += out.nbytes
        return out

    def sequence(count: int, low_bits: int, n_low: int, n_high: int, n_samples: int) -> EliasFano:
        return EliasFano(count, low_bits, take("<u8", n_low), take("<u8", n_high), take("<u4", n_samples))

    ends = sequence(n, *sizes[:4])
    apart = sequence(n - nulls, *sizes[4:])
    return Ids(nulls, least, apart), ends, take("<u2" if width == 2 else "<u4", n_ids)


def document(blob: bytes, k: int) -> np.ndarray:
    """Ids of the shard's k-th document, by two selects."""
    _, ends, ids = read_shard(blob)
    return ids[ends.select(k - 1) if k else 0 : ends.select(k)]


SHARDS = "part long, seq long, n_docs long, n_ids long, blob binary"


def _write(batches, tokenizer: str, white_space_dropped: bool, end_id: int, wide: bool):
    part, seq = TaskContext.get().partitionId(), 0
    coder, end = cached_tokenizer(tokenizer, white_space_dropped), end_id.to_bytes(4, "little")
    docs: list = []
    parts: list[bytes] = []
    held = 0

    def closed():
        nonlocal docs, parts, held, seq
        row = {"part": [part], "seq": [seq], "n_docs": [len(docs)], "n_ids": [held], "blob": [write_shard(docs, parts, wide)]}
        docs, parts, held, seq = [], [], 0, seq + 1
        return batch_of(pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("blob", pa.binary())]), row)

    for b in batches:
        for ids, texts in slices(b):
            for d, raw in zip(ids, coder.encode(texts), strict=True):
                docs.append(d)
                parts.append(raw + end)
                held += len(raw) // 4 + 1
                if held >= SHARD_IDS:
                    yield closed()
    if docs:
        yield closed()


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, white_space_dropped: bool = False, wide: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, append end_id, and write shards in ascending
    doc_id order to the shared folder; returns the written table of SHARDS.

    Spark's writer is the carrier, so any store will do and lost tasks are
    repeated; each blob is a complete file image. Null and empty texts hold
    the end id alone; null ids come first; rows of one doc_id are ordered by
    text. wide=False keeps two bytes an id, for vocabularies below 65,536.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = pick(docs, id_col, text_col).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    fn = functools.partial(_write, tokenizer=tokenizer, white_space_dropped=white_space_dropped, end_id=end_id, wide=wide)
    return stored(ordered.mapInArrow(fn, SHARDS), "tokens")


def with_starts(shards: DataFrame) -> DataFrame:
    """Add `base`, the ids in all shards before. Partition totals (a row each)
    are summed in order first, then the shards of each partition."""
    sizes = shards.select("part", "seq", "n_ids")
    totals = sizes.groupBy("part").agg(F.sum("n_ids").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("part_base"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", "seq", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("in_part")).join(bases, "part")
    return shards.join(starts.select("part", "seq", (F.col("part_base") + F.col("in_part")).alias("base")), ["part", "seq"])


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _read(batches, digest: bool):
    for b in batches:
        for base, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            docs, ends, ids = read_shard(blob.as_py())
            stops = [ends.select(k) for k in range(ends.n)]
            begins = [0, *stops[:-1]]
            out = {"doc_id": [docs[k] for k in range(len(docs))], "start": [base + s for s in begins], "n_tokens": [e - s for s, e in zip(begins, stops, strict=True)]}
            if digest:
                whole = ids.astype("<u4")
                out["ids_crc32"] = [zlib.crc32(whole[s:e]) for s, e in zip(begins, stops, strict=True)]
                kind = pa.int64()
            else:
                out["ids"] = [ids[s:e].astype("i4") for s, e in zip(begins, stops, strict=True)]
                kind = pa.list_(pa.int32())
            yield batch_of(pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32" if digest else "ids", kind)]), out)


def read_tokens(shards: DataFrame, digest: bool = False) -> DataFrame:
    """The documents of written shards: (doc_id, start, n_tokens, ids), or with
    the ids' CRC-32 in place of them. No shards give no rows."""
    rows = with_starts(shards).select("base", "blob")
    return rows.mapInArrow(functools.partial(_read, digest=digest), READ if digest else "doc_id long, start long, n_tokens long, ids array<int>")


def open_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARDS).parquet(path)

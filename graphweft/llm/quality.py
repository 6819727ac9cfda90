"""Quality rules: plain counts of a text, and a hashed n-gram log-likelihood
ratio between trusted text and the raw corpus.

Character trigrams are hashed to `BUCKETS` counts. The raw multinomial counts
every document; the trusted one counts every document labelled good. A document's verdict is the mean over its trigrams of the logarithm of
their ratio, so length doesn't count, against a fixed threshold.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft.llm.common import batch_of, numbered, pick, place
from graphweft.llm.tokens import slices

BITS = 15
BUCKETS = 1 << BITS
#: Documents without an id go to so many places of the join with the labels.
SPREAD = 1024
#: Documents with a smaller mean ratio go.
THRESHOLD = -0.25
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"


def trigrams(text: str) -> np.ndarray:
    """The bucket of each three characters in a row; shorter texts have one of all they have."""
    c = np.frombuffer(text.encode("utf-32-le"), "<u4")
    if len(c) < 3:
        c = np.concatenate([c, np.zeros(3 - len(c), np.uint32)])
    h = c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA77) + c[2:] * np.uint32(0xC2B2AE3D)
    return (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - BITS)


def _count(batches):
    raw, trusted = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for b in batches:
        for text, good in zip(b.column(0), b.column(1).to_pylist(), strict=True):
            n = np.bincount(trigrams(text.as_py()), minlength=BUCKETS)
            raw += n
            if good:
                trusted += n
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(trusted[at])], names=["bucket", "raw", "trusted"])


def trusted(labels: DataFrame) -> DataFrame:
    """Every doc_id labelled good, once."""
    return labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()


def counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(bucket, raw, trusted) over all documents and all that are labelled good.
    Good ids grow with the corpus, so the join is a merge join at any size.
    Documents without an id meet none and are spread by a second key; an id of
    many rows is left to be split where it is skewed. Each task sums its documents before the shuffle."""
    good = trusted(labels).select("doc_id", F.lit(0).alias("part"), F.lit(True).alias("good"))
    part = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(SPREAD)).cast("int")).otherwise(0)
    flagged = pick(docs, id_col, text_col).withColumn("part", part).join(good.hint("merge"), ["doc_id", "part"], "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))
    return flagged.mapInArrow(_count, "bucket long, raw long, trusted long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted"))


def ratios(counted: DataFrame) -> np.ndarray:
    """log(trusted / raw) by bucket, with half a count added to each. The table
    has BUCKETS rows at most whatever the corpus. Without trusted text: zeros."""
    raw, trusted = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for bucket, r, t in counted.collect():
        raw[bucket], trusted[bucket] = r, t
    if not trusted.sum():
        return np.zeros(BUCKETS, np.float32)
    share = (trusted + 0.5) / (trusted.sum() + 0.5 * BUCKETS)
    return np.log(share / ((raw + 0.5) / (raw.sum() + 0.5 * BUCKETS))).astype(np.float32)


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words in windows that are found twice or more in the text."""
    n = len(words)
    if n <= width:
        return 0
    ids: dict[bytes, int] = {}
    code = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    bits = max(1, (len(ids) - 1).bit_length())
    if len(ids) == n:
        return 0
    m = n - width + 1
    key = code[:m].copy()
    if width * bits <= 63:  # the whole window fits in a number
        for k in range(1, width):
            key = (key << bits) | code[k : k + m]
    else:
        for k in range(1, width):
            key = np.unique(key, return_inverse=True)[1] * np.int64(len(ids)) + code[k : k + m]
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    found = np.flatnonzero(np.isin(key, twice))
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, found, 1)
    np.add.at(edge, found + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def plain_counts(text: str) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    words = text.encode().split()
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip(SPACES):
            seen.add(line)
    return (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dup, repeated_words(words))


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _judge(batches, table: np.ndarray, threshold: float):
    kind = [("doc_id", pa.int64()), *((n, pa.int64()) for n in NAMES), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("score", pa.float64())]
    for b in batches:
        for ids, texts in slices(b, 1024):
            out: dict[str, list] = {k: [] for k, _ in kind}
            for d, text in zip(ids, texts, strict=True):
                plain = plain_counts(text)
                failed = plain[0] < 10 or 100 * plain[4] > 20 * plain[0]
                score = float(table[trigrams(text)].mean(dtype=np.float64)) if text else 0.0
                for (k, _), v in zip(kind, (d, *plain, failed, not failed and score >= threshold, score), strict=True):
                    out[k].append(v)
            yield batch_of(pa.schema(kind), out)


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, the plain counts, base_failed, kept, score) of every document.

    Null and empty texts have no words and fail; without labels, or with none
    good, the score is 0 and the plain rules decide; repeated rows give
    repeated rows with equal verdicts.
    """
    table = ratios(counts(docs, labels, id_col, text_col))
    schema = "doc_id long, " + ", ".join(f"{n} long" for n in NAMES) + ", base_failed boolean, kept boolean, score double"
    return pick(docs, id_col, text_col).mapInArrow(functools.partial(_judge, table=table, threshold=threshold), schema)


def _passing(batches, k: int, table: np.ndarray, threshold: float):
    for b in batches:
        keep = []
        for text in b.column(k).to_pylist():
            text = text or ""
            plain = plain_counts(text)
            keep.append(plain[0] >= 10 and 100 * plain[4] <= 20 * plain[0] and float(table[trigrams(text)].mean(dtype=np.float64)) >= threshold)
        yield b.filter(pa.array(keep))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, that judge() keeps."""
    table = ratios(counts(docs, labels, id_col, text_col))
    own = numbered(docs)
    return own.mapInArrow(functools.partial(_passing, k=place(docs, text_col), table=table, threshold=threshold), own.schema).toDF(*docs.columns)

"""Language identification: sparse multinomial logistic regression on TF-IDF
character n-grams.

N-grams of one to three characters are hashed to `BUCKETS` features. Document
frequencies cover every document that may be learned from. A bounded sample
of them, in a fixed order, streams through one task that trains by
follow-the-regularised-leader with elastic-net penalties, holding the weights
only, and then fits a temperature on rows that it did not train on. Every text
is scored whole.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweft.llm.common import batch_of, pick
from graphweft.llm.tokens import slices

BITS = 16
BUCKETS = 1 << BITS
#: N-grams have one to so many characters.
LONGEST = 3
#: At most so many documents are learned from, shared evenly among the languages.
FIT_ROWS = 4_000
#: Every so many of the sampled documents are kept from training, to fit the temperature.
HELD_BACK = 5
#: How often the sample is gone through.
EPOCHS = 2
#: Rate, smoothing and penalties of follow-the-regularised-leader.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-3, 1e-4
#: Characters of a text that are hashed at once.
STEP = 1 << 18
MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, count) of the n-grams of a text in small letters, between blanks."""
    total = None
    text = f" {text.lower()} "
    for lo in range(0, len(text), STEP):
        c = np.frombuffer(text[lo : lo + STEP + LONGEST - 1].encode("utf-32-le", "surrogatepass"), "<u4")
        h = np.zeros(len(c), np.uint32)
        for k in range(min(LONGEST, len(c))):
            h = h[: len(c) - k] + c[k:] * np.uint32(MULTIPLIERS[k])
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * k)
            own = np.bincount(mixed[:STEP] >> np.uint32(32 - BITS), minlength=BUCKETS)
            total = own if total is None else total + own
    at = np.flatnonzero(total)
    return at, total[at]


def weighted(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF of a text's buckets: log(1 + count) * idf, of unit length."""
    x = np.log1p(n) * idf[at]
    return x / max(np.linalg.norm(x), 1e-12)


class Leader:
    """Follow-the-regularised-leader, proximal: the weights are told by sums of
    gradients (z) and of their squares (n), and are zero while |z| <= L1."""

    def __init__(self, n_classes: int, buckets: int = BUCKETS):
        self.z, self.n = np.zeros((buckets, n_classes)), np.zeros((buckets, n_classes))

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = softmax(x @ w)
        p[label] -= 1
        g = x[:, None] * p
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of logits, from 1/64 to 64, under which the labels are
    likeliest, by golden section on its logarithm; 1 without rows. One further
    row of each class is spread over all rows, so that a few rows that are all
    told right don't make the model certain of everything."""
    if not len(labels):
        return 1.0
    spread = logits.shape[1] / (len(labels) + logits.shape[1])

    def loss(t: float) -> float:
        scaled = logits / np.exp(t)
        scaled = scaled - scaled.max(1, keepdims=True)
        told = (1 - spread) * scaled[np.arange(len(labels)), labels] + spread * scaled.mean(1)
        return float(np.mean(np.log(np.exp(scaled).sum(1)) - told))

    lo, hi, ratio = -np.log(64), np.log(64), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


@dataclass
class Model:
    names: list[str]
    idf: np.ndarray
    weights: np.ndarray  # buckets x languages, single floats
    temperature: float


def held_out(doc_id: Column, of: int = 4, remainder: int = 2) -> Column:
    """Whether a document is never learned from; one without an id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % of == remainder, F.lit(False))


def _frequencies(batches):
    """(bucket, n) of a task's documents; bucket -1 has how many they are."""
    n, total = np.zeros(BUCKETS, np.int64), 0
    for b in batches:
        for text in b.column(0):
            n[counted(text.as_py())[0]] += 1
            total += 1
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(n[at], total))], names=["bucket", "n"])


def inverse_frequencies(texts: DataFrame) -> np.ndarray:
    """log((1 + documents) / (1 + documents with it)) + 1 by bucket, over all texts."""
    rows = texts.mapInArrow(_frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # BUCKETS + 1 at most
    own, total = np.zeros(BUCKETS), 0
    for bucket, n in rows:
        if bucket < 0:
            total = n
        else:
            own[bucket] = n
    return np.log((1 + total) / (1 + own)) + 1


WEIGHTS = "temperature double, weights binary"


def _train(batches, names: list[str], idf: np.ndarray):
    """Rows (epoch, lang, text) in order; the last epoch's fit the temperature."""
    leader, place = Leader(len(names)), {n: k for k, n in enumerate(names)}
    last, logits, labels = None, [], []
    for b in batches:
        for epoch, lang, text in zip(*(b.column(k) for k in range(3)), strict=True):
            at, n = counted(text.as_py())
            x, label = weighted(at, n, idf), place[lang.as_py()]
            if epoch.as_py() < EPOCHS:
                leader.learn(at, x, label)
                continue
            last = leader.weights() if last is None else last
            logits.append(x @ last[at])
            labels.append(label)
    last = leader.weights() if last is None else last
    t = temperature(np.array(logits).reshape(-1, len(names)), np.array(labels, int))
    yield pa.RecordBatch.from_arrays([pa.array([t]), pa.array([last.astype(np.float32).tobytes()])], names=["temperature", "weights"])


def learn(docs: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model of the languages of all documents with an id, a text and a
    language that aren't held out; None if there are none. Its sample is the
    same whatever the partitions."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    own = own.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["count"] for r in own.groupBy("lang").count().collect()}  # a row a language
    if not sizes:
        return None
    names = sorted(sizes)
    idf = inverse_frequencies(own.select("text"))
    # the least hashes of each language, by a bound below which more than enough are expected, then exactly
    share = max(1, fit_rows // len(names))
    place = F.xxhash64("doc_id", "text")
    bound = F.coalesce(*[F.when(F.col("lang") == n, F.lit(min(1.0, 2 * share / k + 64 / k))) for n, k in sizes.items()])
    unit = place / F.lit(2.0**64) + 0.5
    few = own.withColumn("place", place).where(unit <= bound).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id"))).where(F.col("rank") <= share)
    few = few.withColumn("back", F.col("rank") % HELD_BACK == 0)
    epochs = few.select(F.explode(F.when(F.col("back"), F.array(F.lit(EPOCHS))).otherwise(F.sequence(F.lit(0), F.lit(EPOCHS - 1)))).alias("epoch"), "lang", "text", "place", "doc_id")
    ordered = epochs.repartition(1).sortWithinPartitions("epoch", "place", "doc_id", "lang").select("epoch", "lang", "text")
    row = ordered.mapInArrow(functools.partial(_train, names=names, idf=idf), WEIGHTS).collect()[0]
    return Model(names, idf, np.frombuffer(bytes(row["weights"]), np.float32).reshape(BUCKETS, len(names)), row["temperature"])


OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def _predict(batches, model: Model | None):
    for b in batches:
        held = b.column(2).to_pylist()
        done = 0
        for ids, texts in slices(b, 128):
            langs, scores = [], []
            for text in texts:
                lang, score = "und", 0.0
                if model and any(map(str.isalpha, text)):
                    at, n = counted(text)
                    p = softmax(weighted(at, n, model.idf) @ model.weights[at] / model.temperature)
                    k = int(p.argmax())
                    lang, score = model.names[k], float(p[k])
                langs.append(lang)
                scores.append(score)
            yield batch_of(OUT, {"doc_id": ids, "held_out": held[done : done + len(ids)], "lang_pred": langs, "score": scores})
            done += len(ids)


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document; score is the
    calibrated probability of the language told."""
    own = pick(docs, id_col, text_col).withColumn("held_out", held_out(F.col("doc_id")))
    return own.mapInArrow(functools.partial(_predict, model=model), "doc_id long, held_out boolean, lang_pred string, score double")


def languages(docs: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the documents that aren't held out, then predict all.

    Texts that are null or have no letter are `und`, score 0; so are all where
    there is nothing to learn from. With one language all others are that, score 1.
    Among equal probabilities the first name counts. Repeated rows and ids each
    give a row. A document without an id is never learned from, nor held out.
    Any other column, whatever its name, is left behind."""
    return predict(docs, learn(docs, fit_rows, id_col, text_col, lang_col), id_col, text_col)

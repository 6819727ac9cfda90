"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word enters as the sum of a hashed word vector and the mean of its hashed
character n-grams' vectors. Both directions read windows of `WINDOW` words,
`STRIDE` apart; attention pools their states to one logit a window. All
windows of a text are scored; a logistic rule that rises with the largest
logit, the mean and the sum of the windows' probabilities makes the document's
score. It is all trained here, in numpy, on a bounded sample of labelled rows.

A toxic text need not be toxic throughout. All its windows are learned from at
first; later only those that the model itself finds toxic, and the one it
finds most so.
"""

from __future__ import annotations

import functools
import pickle
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphweft.llm.common import batch_of, pick, stored
from graphweft.llm.tokens import slices

WINDOW, STRIDE = 64, 48
DIM, HIDDEN = 12, 12
WORD_BUCKETS, GRAM_BUCKETS, GRAMS = 1 << 14, 1 << 15, (3, 4, 5)
#: Labelled rows of each class that are learned from, at most, and their
#: characters in all: rows are taken until either bound is met, each whole.
ROWS_A_CLASS, CHARS_A_CLASS = 2500, 16_000_000
#: Rows of more than this part of CHARS_A_CLASS come after all others, the shortest first.
LONG_PART = 64
#: The windows are gone through EPOCHS times, or often enough for LEAST_STEPS
#: steps, in batches of BATCH, or of a CUT-th of the windows if that is less.
EPOCHS, LEAST_STEPS, BATCH, CUT, RATE = 2, 600, 160, 40, 0.006
#: So often the model is held against documents that it doesn't learn from; the best stays.
CHECKS = 3
#: The score from which a text is predicted toxic.
THRESHOLD = 0.7
PUNCTUATION = ".,;:!?\"'()[]{}#*$%&|<>"
F32 = np.float32


def words_of(text: str) -> list[str]:
    return [w.decode("utf-8", "replace") for w in text.lower().encode().split()]


def bare(word: str) -> str:
    return word.strip(PUNCTUATION) or word


@dataclass
class Model:
    """Parameters by name; the words' vectors come from two hashed tables."""

    p: dict[str, np.ndarray] = field(default_factory=dict)
    rule: np.ndarray | None = None

    @classmethod
    def new(cls, seed: int = 7) -> Model:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(F32)
        p = {"word": draw(WORD_BUCKETS, DIM, scale=0.05), "gram": draw(GRAM_BUCKETS, DIM, scale=0.1)}
        for d in "fb":
            p |= {f"W{d}": draw(DIM, 3 * HIDDEN, scale=DIM**-0.5), f"U{d}": draw(HIDDEN, 3 * HIDDEN, scale=0.7 * HIDDEN**-0.5), f"b{d}": np.zeros(3 * HIDDEN, F32)}
        p |= {"A": draw(2 * HIDDEN, HIDDEN, scale=(2 * HIDDEN) ** -0.5), "v": draw(HIDDEN, scale=0.3), "w": draw(2 * HIDDEN, scale=0.3), "c": np.zeros(1, F32)}
        return cls(p)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For distinct words: the word's bucket; and of their character n-grams
    the bucket, the word, and one over how many its word has."""
    own = np.array([zlib.crc32(w.encode()) for w in words], np.uint32) % np.uint32(WORD_BUCKETS)
    c = np.frombuffer("".join([f"<{w}>\0" for w in words]).encode("utf-32-le"), "<u4")
    word = np.cumsum(c == 0) - (c == 0)
    buckets, at = [], []
    for n in GRAMS:
        m = len(c) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint32)
        for k in range(n):
            h = h * np.uint32(0x01000193) ^ c[k : k + m]
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        inside = (word[:m] == word[n - 1 :]) & (c[n - 1 :] != 0)
        buckets.append((h[inside] >> np.uint32(32 - 15)) % np.uint32(GRAM_BUCKETS))
        at.append(word[:m][inside])
    bucket, at = np.concatenate(buckets), np.concatenate(at)
    order = np.argsort(at, kind="stable")
    bucket, at = bucket[order], at[order]
    share = (1 / np.maximum(1, np.bincount(at, minlength=len(words))))[at].astype(F32)
    return own.astype(np.int64), bucket.astype(np.int64), at, share


def vectors(p: dict, feats: tuple) -> np.ndarray:
    own, bucket, at, share = feats
    x = p["word"][own]
    if len(at):
        start = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
        x[at[start]] += np.add.reduceat(p["gram"][bucket] * share[:, None], start, axis=0)
    return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def recur(p: dict, d: str, x: np.ndarray, mask: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """States (T, B, H) of one direction over x (T, B, D); keep: what the way back needs."""
    steps, n = mask.shape
    U, H = p[f"U{d}"], HIDDEN
    xw = x @ p[f"W{d}"] + p[f"b{d}"]
    h, out, held = np.zeros((n, H), F32), np.empty((steps, n, H), F32), []
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        hu = h @ U
        zr = sigmoid(xw[t, :, : 2 * H] + hu[:, : 2 * H])
        z, r = zr[:, :H], zr[:, H:]
        g = np.tanh(xw[t, :, 2 * H :] + r * hu[:, 2 * H :])
        m = mask[t][:, None]
        new = h + m * (1 - z) * (g - h)
        if keep:
            held.append((t, h, z, r, g, hu[:, 2 * H :], m))
        out[t] = h = new
    return out, held


def forward(p: dict, x: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Logit of each window; x (T, B, D), mask (T, B) of ones and zeros."""
    states, held = zip(recur(p, "f", x, mask, keep), recur(p, "b", x, mask, keep), strict=True)
    both = np.concatenate(states, axis=2)
    a = np.tanh(both @ p["A"])
    e = a @ p["v"] + (mask - 1) * F32(1e4)
    e = np.exp(e - e.max(axis=0)) * mask
    e /= np.maximum(e.sum(axis=0), F32(1e-9))
    pooled = np.einsum("tb,tbh->bh", e, both)
    logit = pooled @ p["w"] + p["c"][0]
    return logit, (held, both, a, e, pooled) if keep else None


def backward(p: dict, x: np.ndarray, dlogit: np.ndarray, kept: tuple) -> tuple[dict, np.ndarray]:
    """Gradients of the dense parameters and of x."""
    held, both, a, e, pooled = kept
    H, g = HIDDEN, {"w": pooled.T @ dlogit, "c": np.array([dlogit.sum()], F32)}
    dpool = dlogit[:, None] * p["w"]
    dboth = e[:, :, None] * dpool
    de = np.einsum("tbh,bh->tb", both, dpool)
    ds = e * (de - (e * de).sum(axis=0))
    g["v"] = np.einsum("tb,tbh->h", ds, a)
    da = ds[:, :, None] * p["v"] * (1 - a * a)
    g["A"] = np.einsum("tbi,tbj->ij", both, da, optimize=True)
    dboth = dboth + da @ p["A"].T
    dx = np.zeros_like(x)
    for k, d in enumerate("fb"):
        U, W = p[f"U{d}"], p[f"W{d}"]
        dxw, gU = np.empty((*x.shape[:2], 3 * H), F32), np.zeros_like(U)
        carry = np.zeros_like(held[k][0][1])
        for t, h, z, r, n, hn, m in reversed(held[k]):
            dh = carry + dboth[t, :, k * H : (k + 1) * H]
            dn = dh * m * (1 - z) * (1 - n * n)
            dz = dh * m * (h - n) * z * (1 - z)
            dr = dn * hn * r * (1 - r)
            dhu = np.concatenate([dz, dr, dn * r], axis=1)
            gU += h.T @ dhu
            carry = dh * (1 - m * (1 - z)) + dhu @ U.T
            dxw[t] = np.concatenate([dz, dr, dn], axis=1)
        g[f"U{d}"], g[f"b{d}"] = gU, dxw.sum(axis=(0, 1))
        g[f"W{d}"] = np.einsum("tbi,tbj->ij", x, dxw, optimize=True)
        dx += dxw @ W.T
    return g, dx


def summed(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows added up by index: (distinct indices, sums)."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    start = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
    return at[start], np.add.reduceat(rows[order], start, axis=0)


def spread(windows: list[list[str]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words; the windows as (T, B) of their indices; the mask."""
    ids: dict[str, int] = {}
    at = np.zeros((len(windows), WINDOW), np.int64)
    mask = np.zeros((len(windows), WINDOW), F32)
    for k, window in enumerate(windows):
        at[k, : len(window)] = [ids.setdefault(w, len(ids)) for w in window]
        mask[k, : len(window)] = 1
    return list(ids) or [""], np.ascontiguousarray(at.T), np.ascontiguousarray(mask.T)


def fit(windows: list[list[str]], labels: np.ndarray, bags: np.ndarray, check, seed: int = 7) -> Model:
    """Adam over the windows' cross-entropy; a word's own vector is left out at
    random, so that rare words are read by their characters. bags: the
    document of each window. check(parameters): a loss on other documents."""
    model, rng = Model.new(seed), np.random.default_rng(seed)
    p = model.p
    one, two = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    batch = max(24, min(BATCH, len(windows) // CUT))
    steps = max(LEAST_STEPS, EPOCHS * len(windows) // batch)
    toxic = np.flatnonzero(labels == 1)
    used, least, best = np.ones(len(windows), bool), np.inf, None
    order, at_order = np.zeros(0, np.int64), 0
    for step in range(1, steps + 1):
        if at_order >= len(order):
            order, at_order = rng.permutation(np.flatnonzero(used)), 0
            n_toxic = (labels[order] == 1).sum()
            weight = np.where(labels == 1, 0.5 / max(1, n_toxic), 0.5 / max(1, len(order) - n_toxic)) * len(order)
        own = order[at_order : at_order + batch]
        at_order += batch
        words, at, mask = spread([windows[k] for k in own])
        feats = features(words)
        shown = (rng.random(len(words)) < 0.5).astype(F32)[:, None]
        vec = vectors(p, feats) - (1 - shown) * p["word"][feats[0]]
        x = vec[at]
        logit, kept = forward(p, x, mask, keep=True)
        d = ((sigmoid(logit) - labels[own]) * weight[own] / len(own)).astype(F32)
        g, dx = backward(p, x, d, kept)
        touched, dvec = summed(at.ravel(), (dx * mask[:, :, None]).reshape(-1, DIM))
        whole = np.zeros_like(vec)
        whole[touched] = dvec
        sparse = {"word": summed(feats[0], whole * shown)}
        if len(feats[2]):
            sparse["gram"] = summed(feats[1], whole[feats[2]] * feats[3][:, None])
        rate = RATE * (1 - 0.9 * step / steps) * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
        for k, (rows, grad) in [*((k, (slice(None), v)) for k, v in g.items()), *sparse.items()]:
            one[k][rows] = m = 0.9 * one[k][rows] + 0.1 * grad
            two[k][rows] = s = 0.999 * two[k][rows] + 0.001 * grad * grad
            p[k][rows] -= (rate * m / (np.sqrt(s) + 1e-8)).astype(F32)
        if step * CHECKS // steps > (step - 1) * CHECKS // steps:
            if (loss := check(p)) <= least:
                least, best = loss, {k: v.copy() for k, v in p.items()}
            if step < steps:
                logits = coded_logits(p, *coded([windows[k] for k in toxic]))
                most = np.full(int(bags.max()) + 1, -np.inf)
                np.maximum.at(most, bags[toxic], logits)
                used[toxic] = (logits > 0) | (logits >= most[bags[toxic]])
                at_order = len(order)
    model.p = best or p
    return model


def cut_windows(n: int) -> list[tuple[int, int]]:
    """Overlapping windows that cover n words; none for none."""
    out, at = [], 0
    while at < n:
        out.append((at, min(n, at + WINDOW)))
        if at + WINDOW >= n:
            break
        at += STRIDE
    return out


def coded(windows: list[list]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, windows as rows of their indices, words of each window)."""
    ids: dict[str, int] = {}
    at, size = np.zeros((len(windows), WINDOW), np.int64), np.zeros(len(windows), np.int64)
    for k, window in enumerate(windows):
        at[k, : len(window)], size[k] = [ids.setdefault(w, len(ids)) for w in window], len(window)
    return list(ids) or [""], at, size


def coded_logits(p: dict, words: list[str], at: np.ndarray, size: np.ndarray) -> np.ndarray:
    vec = vectors(p, features(words))
    order = np.argsort(size, kind="stable")  # short windows together take few steps
    out = np.empty(len(at), F32)
    for lo in range(0, len(at), 1024):
        own = order[lo : lo + 1024]
        steps = int(size[own].max())
        mask = np.ascontiguousarray((np.arange(steps)[:, None] < size[own]).astype(F32))
        out[own] = forward(p, vec[at[own, :steps].T], mask)[0]
    return out


def window_codes(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """coded() of all windows of all texts in order, and windows of each text."""
    ids: dict[str, int] = {}
    codes = [np.array([ids.setdefault(w, len(ids)) for w in words_of(t)], np.int64) for t in texts]
    pieces = [cut_windows(len(c)) for c in codes]
    count = np.array([len(x) for x in pieces], np.int64)
    bares: dict[str, int] = {}
    same = np.array([bares.setdefault(bare(w), len(bares)) for w in ids], np.int64)
    total = int(count.sum())
    at, size = np.zeros((total, WINDOW), np.int64), np.zeros(total, np.int64)
    k = 0
    for c, xs in zip(codes, pieces, strict=True):
        if xs:
            c = same[c]
        for a, z in xs:
            at[k, : z - a], size[k] = c[a:z], z - a
            k += 1
    return list(bares) or [""], at, size, count


def window_logits(p: dict, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(logits of all windows of all texts in order, windows of each text)."""
    words, at, size, count = window_codes(texts)
    return coded_logits(p, words, at, size) if len(at) else np.zeros(0, F32), count


def document_features(logits: np.ndarray, count: np.ndarray) -> np.ndarray:
    """(1, largest logit, mean probability, log of one plus their sum) by document."""
    out = np.zeros((len(count), 4))
    out[:, 0] = 1
    full = np.flatnonzero(count)
    out[count == 0, 1] = -8
    if len(full):
        start = np.concatenate([[0], np.cumsum(count[full])[:-1]])
        prob = sigmoid(logits.astype(np.float64))
        out[full, 1] = np.clip(np.maximum.reduceat(logits, start), -8, 8)
        total = np.add.reduceat(prob, start)
        out[full, 2], out[full, 3] = 4 * total / count[full], np.log1p(total)
    return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weighted logistic regression by Newton steps."""
    b = np.zeros(x.shape[1])
    hold = ridge * np.eye(x.shape[1])
    hold[0, 0] = 1e-6
    for _ in range(40):
        q = sigmoid(x @ b)
        s = np.maximum(q * (1 - q), 1e-6) * weight
        move = np.linalg.solve((x * s[:, None]).T @ x + hold, x.T @ (weight * (y - q)) - hold @ b)
        b += np.clip(move, -3, 3)
        if np.abs(move).max() < 1e-6:
            break
    return b


def rising(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """logistic() whose weights, but for the constant, are not negative: what
    comes out negative is left out and the rest fitted anew."""
    kept = list(range(x.shape[1]))
    while True:
        b = np.zeros(x.shape[1])
        b[kept] = logistic(x[:, kept], y, weight)
        if (b[1:] >= 0).all():
            return b
        kept = [k for k in kept if not k or b[k] >= 0]


def scores(model: Model, texts: list[str]) -> np.ndarray:
    """0 to 1; texts without words score 0."""
    if model.rule is None:
        return np.zeros(len(texts))
    logits, count = window_logits(model.p, texts)
    return np.where(count > 0, sigmoid(document_features(logits, count) @ model.rule), 0.0)


def train(rows: list[tuple[int, int, str]], share: float) -> Model:
    """rows: (doc_id, toxic, text), sorted. Four of five documents of each
    class fit the network; on the fifth it is checked while it learns, and
    the document rule is fitted. share: of toxic among all labelled rows; the
    rule is weighted to it. Without two documents of both classes all scores are 0."""
    net_rows, rule_rows = [], []
    for toxic in (0, 1):
        own = [r for r in rows if r[1] == toxic]
        if len(own) < 2:
            return Model.new()
        rule_rows += own[1::5]
        net_rows += own[::5] + own[2::5] + own[3::5] + own[4::5]
    windows, labels, bags = [], [], []
    for bag, (_, toxic, text) in enumerate(net_rows):
        words = [bare(w) for w in words_of(text)]
        pieces = cut_windows(len(words))
        windows += [words[a:z] for a, z in pieces]
        labels += [toxic] * len(pieces)
        bags += [bag] * len(pieces)
    if len(set(labels)) < 2:
        return Model.new()
    *codes, count = window_codes([t for _, _, t in rule_rows])
    y = np.array([t for _, t, _ in rule_rows])

    def ruled(p: dict, prior: float) -> tuple[np.ndarray, float]:
        """The rule for these parameters and its loss, at this share of toxic documents."""
        x = document_features(coded_logits(p, *codes) if len(codes[1]) else np.zeros(0, F32), count)
        weight = np.where(y == 1, prior / max(1, y.sum()), (1 - prior) / max(1, (1 - y).sum())) * len(y)
        b = rising(x, y, weight)
        z = x @ b
        return b, float(np.average(np.logaddexp(0, np.where(y == 1, -z, z)), weights=weight))

    model = fit(windows, np.array(labels), np.array(bags), lambda p: ruled(p, 0.5)[1])
    model.rule = ruled(model.p, share)[0]
    return model


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, rows_a_class: int = ROWS_A_CLASS, chars_a_class: int = CHARS_A_CLASS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, float]:
    """(doc_id, toxic, text) to learn from, and the share of toxic among all
    labelled rows: of documents that aren't held out, of each class those with
    the smallest hashes of their doc_id, at most rows_a_class of them and
    chars_a_class characters. A text that is long for that bound waits behind
    the others, so it can't keep them out, and the first of a class is always
    taken: a class that has labelled rows is learned from. An id labelled both
    ways counts as toxic; of rows that repeat an id the least text is taken."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where(~held_out("doc_id"))
    share = known.agg(F.avg("toxic")).first()[0] or 0.0
    wanted = None
    for toxic in (0, 1):
        part = known.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_a_class)
        wanted = part if wanted is None else wanted.union(part)
    found = pick(docs, id_col, text_col).join(F.broadcast(wanted), "doc_id")  # rows_a_class ids of each class at most
    held = stored(found.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text")), "labelled")
    long = F.col("n") > chars_a_class // LONG_PART
    order = Window.partitionBy("toxic").orderBy(long, F.when(long, F.col("n")), F.xxhash64("doc_id"), "doc_id")
    sizes = held.select("doc_id", "toxic", F.length("text").alias("n")).withColumn("upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    chosen = sizes.where((F.col("upto") <= chars_a_class) | (F.col("upto") == F.col("n")))
    return held.join(F.broadcast(chosen.select("doc_id")), "doc_id").select("doc_id", "toxic", "text"), share


def _train(batches, share: float):
    rows = [r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(sorted(rows), share))], pa.binary())], names=["model"])


def learn(docs: DataFrame, labels: DataFrame, rows_a_class: int = ROWS_A_CLASS, chars_a_class: int = CHARS_A_CLASS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on sample(), in one task: its rows and characters are bounded. The
    driver gets the parameters only."""
    rows, share = sample(docs, labels, rows_a_class, chars_a_class, id_col, text_col)
    models = rows.repartition(1).mapInArrow(functools.partial(_train, share=share), "model binary").collect()
    return pickle.loads(models[0]["model"]) if models else Model.new()


def _score(batches, model: Model, threshold: float):
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])
    for b in batches:
        for ids, texts in slices(b, 256):
            s = scores(model, texts)
            yield batch_of(schema, {"doc_id": ids, "score": s, "predicted": (s >= threshold).astype("i4")})


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every whole text.

    Null and empty texts score 0; repeated rows score alike; the model never
    sees anything but the text.
    """
    return pick(docs, id_col, text_col).mapInArrow(functools.partial(_score, model=model, threshold=threshold), "doc_id long, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn from the labels that aren't held out and score every document."""
    found = score(docs, learn(docs, labels, id_col=id_col, text_col=text_col), id_col=id_col, text_col=text_col)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")

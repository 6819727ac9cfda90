"""Language identification, periodic runs and hard negatives against plain
Python, over nulls, empty and very long rows, ties, repeats and empty tables."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from oracle import compare
from pyspark.sql import functions as F

from graphweft.llm import language, negatives, queries, runs

SF = "/root/testdata/sf0.01"

# --- periodic runs -----------------------------------------------------------


def plain_runs(words):
    """Every run by its definition: each lag, each maximal stretch, smallest period tested word by word."""
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(24, 3 * q):
                own = words[i : i + length]
                if next(p for p in range(1, q + 1) if all(own[k] == own[k + p] for k in range(length - p))) == q:
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    dropped = {k for s, m, q in found for k in range(s + q, s + m)}
    kept = b" ".join(w for k, w in enumerate(words) if k not in dropped)
    best = min(found, key=lambda r: (-r[1] * math.lcm(*[x[2] for x in found]) // r[2], r[0], r[2])) if found else (None,) * 3
    told = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def run_texts():
    rng = random.Random(11)
    out = [(None, "again " * 40), (1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "a\x1cb c\xa0d " * 30), (6, "x " * 24), (7, "x " * 23), (8, "9" * 50_000), (9, "x " * 24), (9, "x " * 24), (10, "é ß " * 15 + "é")]
    for k in range(11, 260):
        n, few = rng.randint(1, 150), rng.choice([1, 2, 3, 50])
        words = [str(rng.randrange(few)) for _ in range(n)]
        if k % 3:
            a, p = rng.randrange(n), rng.randint(1, 12)
            words = words[:a] + [words[a + i % min(p, n - a)] for i in range(n - a)]
        out.append((k, rng.choice([" ", "\n", " \t"]).join(words)))
    return out


@pytest.fixture(scope="module")
def run_docs(spark):
    return spark.createDataFrame([(d, t, 1, "r", 2) for d, t in run_texts()], "doc_id long, text string, runs int, collapsed string, key int").repartition(3)


@pytest.mark.parametrize("unit", [runs.UNIT, 200])
def test_runs_equal_plain_rules(run_docs, unit):
    got = runs.find_runs(run_docs, digest=True, plant=True, unit=unit).collect()
    assert Counter(map(tuple, got)) == Counter(plain_row(d, t) for d, t in run_texts())


def test_runs_without_planting_give_texts(run_docs):
    got = {r["doc_id"]: r for r in runs.find_runs(run_docs).collect()}
    assert [tuple(x) for x in got[6]["runs"]] == [(0, 24, 1)] and bytes(got[6]["collapsed"]) == b"x"
    assert got[7]["n_runs"] == 0 and bytes(got[7]["collapsed"]) == b" ".join([b"x"] * 23)
    assert bytes(got[10]["collapsed"]) == "é ß".encode() and got[1]["runs"] == []


def test_equal_exponents_take_the_smallest_start():
    words = [b"a"] * 24 + [b"-"] + [b"b"] * 24
    assert runs.strongest(runs.runs_of(words)) == (0, 24, 1)


def test_ranges_of_lags_find_what_one_scan_finds():
    rng = random.Random(3)
    words = [str(rng.randrange(2)).encode() for _ in range(40)] * 9 + [b"t"] * 60
    ids, last = runs.ids_of(words), len(words) // 3
    parts = [runs.stretches(ids, 1 + last * k // 7, last * (k + 1) // 7) for k in range(7)]
    assert runs.smallest(np.concatenate(parts)).tolist() == runs.runs_of(words).tolist() == [list(r) for r in plain_runs(words)]


def test_runs_of_no_documents(run_docs):
    assert runs.find_runs(run_docs.where("false"), digest=True, plant=True).count() == 0


# --- hard negatives ----------------------------------------------------------


def plain_negatives(rows, every=100, positives=5, most=10):
    own = {}
    for vec_id, label, vector in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        own[(vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, tuple(math.floor(256 * x) for x in vector))] = 1
    out = []
    for a, la, va in own:
        if a % every:
            continue
        score = [(sum(x * y for x, y in zip(va, v, strict=False)), d, label) for d, label, v in own]
        near = sorted(((s, d) for s, d, label in score if label == la and d != a), key=lambda r: (-r[0], r[1]))[:positives]
        for ps, p in near:
            far = sorted(((s, d) for s, d, label in score if label != la and 30 * ps <= 100 * s <= 90 * ps), key=lambda r: (-r[0], r[1]))[:most]
            out += [(a, p, k + 1, d, ps, s) for k, (s, d) in enumerate(far)]
    return out


def vectors(spark, rows):
    return spark.createDataFrame([(d, v, label, 1, "s") for d, label, v in rows], "vec_id long, embedding array<float>, label int, anchor int, score string").repartition(3)


def odd_rows():
    rng = random.Random(2)
    f = lambda x: float(np.float32(x))
    rows = [(k, rng.randrange(3), [f(rng.choice([-0.5, 0.25, 0.5, rng.gauss(0.2, 0.4)])) for _ in range(8)]) for k in range(320)]
    rows += [(400, 1, [0.5] * 8), (401, 1, [0.5] * 8), (402, 2, [0.25] * 8), (403, 2, [0.25] * 8), (403, 2, [0.25] * 8), (500, None, [1.0] * 8), (600, 1, None), (700, 1, [None] + [1.0] * 7), (800, 1, [math.nan] * 8), (801, 1, [math.inf] + [0.0] * 7)]
    rows += [(None, 1, [1.0] * 8), (900, 1, []), (1000, 0, [0.0] * 8), (1001, 0, [3.0] * 4), (1002, 1, [1.0] * 12), (1100, 77, [0.5] * 8), (-100, 1, [f(-0.3)] * 8), (400, 2, [0.75] * 8)]
    return rows


@pytest.mark.parametrize("block_bytes", [negatives.BLOCK_BYTES, 200])
def test_negatives_equal_plain_rules(spark, block_bytes):
    got = [tuple(r) for r in negatives.hard_negatives(vectors(spark, odd_rows()), block_bytes=block_bytes).collect()]
    want = plain_negatives(odd_rows())
    assert len(want) > 100 and Counter(got) == Counter(want)


def test_negatives_of_large_components_are_exact(spark):
    rng = random.Random(4)
    rows = [(k, k % 2, [rng.choice([-1, 1]) * rng.random() * 3000 for _ in range(16)]) for k in range(201)]
    rows = [(d, label, [float(np.float32(x)) for x in v]) for d, label, v in rows]
    got = [tuple(r) for r in negatives.hard_negatives(vectors(spark, rows)).collect()]
    assert Counter(got) == Counter(plain_negatives(rows))


@pytest.mark.parametrize("rows", [[], [(1, 1, [0.5])], [(100, 1, [0.5])], [(100, 1, [0.5]), (101, 1, [0.5])]])
def test_negatives_of_next_to_nothing(spark, rows):
    assert negatives.hard_negatives(vectors(spark, rows)).count() == 0


def test_intervals_hold_every_score():
    """After each plane the interval has the true score in it, and pairs are refused only on that ground."""
    rng = np.random.default_rng(5)
    rows, anchors = rng.integers(-200, 200, (50, 12)).astype(float), rng.integers(-200, 200, (7, 12)).astype(float)
    true = rows @ anchors.T

    def wanted(low, high, at, by):
        s = true[at, by]
        assert (low <= s).all() and (s <= high).all()
        return high >= 50_000

    at, by, score = negatives.sliced(negatives.Planes(rows), anchors, wanted)
    assert sorted(zip(at.tolist(), by.tolist(), score.tolist(), strict=True)) == sorted((i, j, int(true[i, j])) for i, j in zip(*np.nonzero(true >= 50_000), strict=True))


def test_negatives_equal_sql(spark):
    assert compare(queries.queries()["op13_negatives"](spark, SF), queries.oracle_sql()["op13_negatives"], SF) is None


# --- language identification -------------------------------------------------


def plain_ngrams(text):
    """Bucket counts by plain integers."""
    c, out = [ord(x) for x in f" {text.lower()} "], Counter()
    for i in range(len(c)):
        h = 0
        for k in range(min(language.LONGEST, len(c) - i)):
            h = (h + c[i + k] * language.MULTIPLIERS[k]) & 0xFFFFFFFF
            out[(((h ^ (h >> 15)) * (0x2C1B3C6D + 2 * k)) & 0xFFFFFFFF) >> (32 - language.BITS)] += 1
    return out


@pytest.mark.parametrize("text", ["", "a", "ab", "Ça et là", "x" * 50, "\U0001f600 ok", "word " * 3000])
def test_ngrams_equal_plain_counts(text, monkeypatch):
    monkeypatch.setattr(language, "STEP", 7)
    at, n = language.counted(text)
    assert dict(zip(at.tolist(), n.tolist(), strict=True)) == plain_ngrams(text)


def test_leader_equals_plain_ftrl():
    """Weights after some steps against the published per-coordinate rule."""
    rng = random.Random(9)
    data = [(sorted(rng.sample(range(12), 4)), [rng.random() for _ in range(4)], rng.randrange(3)) for _ in range(40)]
    leader = language.Leader(3, 12)
    z, n = [[0.0] * 3 for _ in range(12)], [[0.0] * 3 for _ in range(12)]

    def weight(i, j):
        if abs(z[i][j]) <= language.L1:
            return 0.0
        return -(z[i][j] - math.copysign(language.L1, z[i][j])) / ((language.BETA + math.sqrt(n[i][j])) / language.ALPHA + language.L2)

    for at, x, label in data:
        leader.learn(np.array(at), np.array(x), label)
        w = {i: [weight(i, j) for j in range(3)] for i in at}
        logits = [sum(v * w[i][j] for i, v in zip(at, x, strict=True)) for j in range(3)]
        total = sum(math.exp(v) for v in logits)
        for i, v in zip(at, x, strict=True):
            for j in range(3):
                g = v * (math.exp(logits[j]) / total - (j == label))
                sigma = (math.sqrt(n[i][j] + g * g) - math.sqrt(n[i][j])) / language.ALPHA
                z[i][j] += g - sigma * w[i][j]
                n[i][j] += g * g
    assert np.allclose(leader.weights(), [[weight(i, j) for j in range(3)] for i in range(12)])


def test_temperature_calibrates():
    rng = np.random.default_rng(1)
    true = rng.normal(0, 1.5, (4000, 3))
    labels = np.array([rng.choice(3, p=p) for p in language.softmax(true)])
    assert abs(language.temperature(true * 5, labels) - 5) < 0.5
    assert language.temperature(np.zeros((0, 3)), np.zeros(0, int)) == 1.0


def test_languages_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.queries()["op11_language"](spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert all(0 < r["score"] <= 1 for r in got)


def test_languages_never_see_held_out_rows_or_labels(spark):
    """Held-out labels and the source may say anything: no prediction moves."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    spoiled = docs.withColumn("lang", F.when(language.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang"))).withColumn("source", F.lit(None).cast("string"))
    a, b = ({r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.languages(d.repartition(n)).collect()} for d, n in ((docs, 2), (spoiled, 5)))
    assert a == b and "xx" not in {x for x, _ in b.values()}


def test_languages_of_odd_rows(spark):
    rng = random.Random(1)
    words = {"aa": ["kala", "mina", "sura"], "bb": ["thorp", "grund", "wick"]}
    rows = [(k, " ".join(rng.choice(words[lang]) for _ in range(30)), lang, 1) for k, lang in enumerate(["aa", "bb"] * 60)]
    rows += [(500, None, "aa", 1), (501, "", "bb", 1), (502, "12 34 !?", "aa", 1), (503, "kala " * 40_000, None, 1), (None, "grund wick thorp " * 9, "bb", 1), (504, "é", None, 1), (1, "grund thorp", "bb", 1), (1, "grund thorp", "bb", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int").repartition(3)
    got = language.languages(docs).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[k]["lang_pred"] == "und" and by[k]["score"] == 0 for k in (500, 501, 502))
    assert by[503]["lang_pred"] == "aa" and by[None]["lang_pred"] == "bb" and not by[None]["held_out"] and by[504]["lang_pred"] in ("aa", "bb")
    assert language.languages(docs.where("false")).count() == 0
    unlabelled = language.languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r["lang_pred"], r["score"]) for r in unlabelled} == {("und", 0.0)}
    one = language.languages(docs.where("lang = 'aa' or lang is null")).collect()
    assert {(r["lang_pred"], r["score"]) for r in one} == {("und", 0.0), ("aa", 1.0)}

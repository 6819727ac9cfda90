"""Each operator against a brute-force version, over a small table with nulls,
empty, very long, tied and repeated texts and columns of clashing names."""

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from graphweft.llm import binary, components, packing, passages, pii, quality, simhash, sketches, tokens, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = "the river kept its own counsel while lanterns drifted past the mill and every evening someone counted boats aloud until the bells of the far chapel called them home again".split()


def texts():
    rng = random.Random(5)
    words = [a + b for a in ("ka", "lo", "mi", "Nu", "pé") for b in ("ra", "sto", "ven", "xi")]
    out: list = [None, "", " \n\t", "one", "one two three", "ÄÖ ß é", "a  b\n\nc\td \r\n e\x1cf g"]
    for k in range(36):
        out.append(" ".join(rng.choice(words) for _ in range(rng.randint(3, 120))) + ".\n" + "end " * (k % 4))
    passage = " ".join(BASE)
    out += [f"{out[20]} {passage} {out[21]}", f"{out[22]}\n{passage}", passage, passage[4:] + " tail", out[25], out[25], out[25] + " x"]
    out += ["write to ann.lee@mail.example.com or +1 (555) 123-4567, card 4111 1111 1111 1111, host 10.0.0.255", "9" * 30000, "word " * 4000]
    out += ["line one here\nline two here\nline one here\n", "%%% ### junk*** " * 20, " ".join(rng.choice(words) for _ in range(9000))]
    return out


@pytest.fixture(scope="module")
def rows():
    own = list(enumerate(texts()))
    own += [own[10], (12, "another text under an id that is taken already"), (None, "a row without id " + " ".join(BASE))]
    random.Random(3).shuffle(own)
    return own


@pytest.fixture(scope="module")
def docs(spark, rows):
    data = [(d, t, "en", f"s{d}", len(t or ""), "fp", 1, "x") for d, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, spans string, fp int, key string").repartition(3)


@pytest.fixture(scope="module")
def labels(spark, rows):
    return spark.createDataFrame([(d, 0 if "%%%" in (t or "") else 1, 0) for d, t in rows if d is not None], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


def same(df, expected):
    got = Counter(tuple(r) for r in df.collect())
    want = Counter(expected)
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])


# --- personal data


def brute_base(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 16 <= len(d) <= 19 and sum(sum(divmod(2 * x, 10)) if k % 2 else x for k, x in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_base_spans_equal_plain_patterns():
    rng = random.Random(1)
    for _ in range(4000):
        t = "".join(rng.choice("a1.2@-+ (5)9%_0") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == brute_base(t), t
    for t in ("4111-1111 1111 1111", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "x@y.z.", "+49 (0) 170-1234567", "300.1.1.1", "@@a@b..c"):
        assert pii.base_spans(t) == brute_base(t)


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("mail jane.doe (at) mail (dot) example (dot) com now", "email", "jane.doe (at) mail (dot) example (dot) com"),
        ("mail jane [at] example [dot] org now", "email", "jane [at] example [dot] org"),
        ("mail jane at example dot com now", "email", "jane at example dot com"),
        ("mail jаne@exаmple.com now", "email", "jаne@exаmple.com"),
        ("mail ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ now", "email", "ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
        ("call plus four nine one seven zero one two three four five six seven now", "phone", "plus four nine one seven zero one two three four five six seven"),
        ("card four one one one one one one one one one one one one one one one end", "card", "four one one one one one one one one one one one one one one one"),
        ("host one nine two dot one six eight dot one dot seven up", "ip", "one nine two dot one six eight dot one dot seven"),
        ("call +1 ５５５ １２３ ４５６７ now", "phone", "+1 ５５５ １２３ ４５６７"),
    ],
)
def test_disguises_map_back_to_source(text, kind, found):
    assert [(k, text[s:e]) for k, s, e, base in pii.find_spans(text) if not base and k == kind] == [(kind, found)]


@pytest.mark.parametrize("text", ["look at the dot on the map", "we met at noon. un un un un bon", "one two three steps", "at last (at home) we sat", "Наша цена", "naïve café at work.com is"])
def test_clean_text_has_no_spans(text):
    assert [s for s in pii.find_spans(text) if not s[3]] == []


@pytest.mark.parametrize("extra", ["", " Наша цена"])
@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("mail jane.doe @ example.com now", ["jane.doe @ example.com"]),
        ("mail jane.doe @ example . com now", ["jane.doe @ example . com"]),
        ("mail jane.doe@example .com now", ["jane.doe@example .com"]),
        ("mail jane@ mail.example. com now", ["jane@ mail.example. com"]),
        ("mail jane @ example.com. Then joe @ example.org. In time", ["jane @ example.com", "joe @ example.org"]),
        ("mail jane [at] example.shop now", ["jane [at] example.shop"]),
        ("mail jane (at) mail.example.online. Then go", ["jane (at) mail.example.online"]),
        ("mail jane@example.com. In time", []),
        ("mail jane@example.com. Then go", []),
    ],
)
def test_spaced_and_bracketed_addresses_whatever_stands_beside(text, found, extra):
    text += extra
    assert [text[s:e] for k, s, e, base in pii.find_spans(text) if not base] == found


@pytest.mark.parametrize("unit", ["1.", "a-", "a.", " @", "a @ ", "one ", "1 ", "+1 ", "a@", " at a", "а", "[at] ", "x (at) y (dot) ", "x @ y . ", "1.1.1.1", "one-", "@a.b . "])
def test_a_long_text_takes_time_in_proportion(unit):
    n = 300_000 // len(unit)
    for text in (unit * n + " [at] x", "x [at] " + unit * n):
        began = time.perf_counter()
        pii.find_spans(text)
        assert time.perf_counter() - began < 20  # minutes to hours, were it quadratic


def test_stages_keep_columns_of_any_name(spark, labels):
    frame = spark.createDataFrame([(1, "mail ann@example.com now and then and so on for ever and ever", "p", 1), (2, None, "q", 2), (3, "", None, 3)], "doc_id long, text string, `a.b` string, `c d.e` int")
    for out in (quality.keep_good(frame, labels.where("false")), pii.redact(frame), passages.remove_repeats(frame), simhash.keep_one(frame)):
        assert out.columns == frame.columns and out.dtypes == frame.dtypes
        assert out.where("doc_id = 1").select("`a.b`", "`c d.e`").collect() == [("p", 1)]
    assert "[EMAIL]" in pii.redact(frame).where("doc_id = 1").first()["text"]


def test_pii_query(docs, rows, nothing):
    got = {(r["doc_id"], r["base_sha256"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in pii.pii_digest(docs).collect()}
    want = set()
    for d, t in rows:
        spans = brute_base(t or "")
        n = Counter(s[0] for s in spans)
        want.add((d, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest(), n["email"], n["ip"], n["card"], n["phone"]))
    assert got == want
    clean = pii.redact(docs)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    assert clean.where("text like '%[EMAIL] or [PHONE], card [CARD], host [IP]%'").count() == 1
    assert clean.where("text is null").count() == docs.where("text is null").count()
    assert pii.pii_digest(nothing).count() == pii.redact(nothing).count() == 0
    assert pii.find_pii(docs).where("size(spans) > 0").count() == sum(bool(brute_base(t or "")) for _, t in rows)


# --- SimHash


def brute_fp(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, bits):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in itertools.combinations(sorted(values), 2):
        if (a ^ b).bit_count() <= bits:
            root[find(b)] = find(a)
    return {v: find(v) for v in values}


def test_near_duplicates(docs, rows, nothing):
    fps = [(d, brute_fp(t or "")) for d, t in rows]
    part = brute_components({f for _, f in fps}, 4)
    least = {}
    for d, f in fps:
        if d is not None:
            least[part[f]] = min(d, least.get(part[f], d))
    same(simhash.near_duplicates(docs), [(d, f"{f:016x}", least.get(part[f])) for d, f in fps])
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r[0] for r in kept.select("doc_id").collect()} - {None} == set(least.values())


@pytest.mark.parametrize("long_posting", [4096, 3])
def test_links_lose_no_component(spark, long_posting):
    rng = random.Random(8)
    values = set()
    for _ in range(12):
        v = rng.getrandbits(64)
        for _ in range(12):
            values.add(v)
            for _ in range(rng.randint(1, 5)):
                v ^= 1 << rng.randrange(64)
    frame = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")
    roots = {r["node"]: r["root"] for r in components.components(simhash.links(frame, 4, long_posting)).collect()}
    part = brute_components(values, 4)
    want, got = {}, {}
    for v in values:
        want.setdefault(part[v], set()).add(v)
        got.setdefault(roots.get(simhash.signed(v), simhash.signed(v)), set()).add(v)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_chain(spark):
    n = 70
    links = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(200, 201), (5, 5)], "a long, b long")
    got = {tuple(r) for r in components.components(links).collect()}
    assert got == {(k, 0) for k in range(n + 1)} | {(200, 200), (201, 200)}


# --- tokens


def fresh(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


@pytest.mark.parametrize(("name", "dropped"), [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_cached_tokenizer_equals_the_library(rows, name, dropped):
    own = [t or "" for _, t in rows] + ["  a\n\n b \t c ", "it's <|endoftext|> I'LL don't", "\r\n a\r b", "ﬁ ǅ İstanbul ΣΑΣ", "é é ́x", "日本語 テスト。 x", "Äh. Öl, \n.x", " ​ x \x85 y"]
    coder, library = tokens.CachedTokenizer(public_tokenizers.path(name), dropped, limit=50), fresh(name)
    signs = ["a", "B", "é", "ß", "É", " ", "  ", "\n", "\n\n", " \n", "\t", ".", ",", "$$$", "'s", "'", "7", "_", "\r", "日", " ", "-", "word ", "Next\n", "\x00", "don't", "`"]
    rng = random.Random(4)
    own += ["".join(rng.choice(signs) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    for lo in range(0, len(own), 9):
        for t, raw in zip(own[lo : lo + 9], coder.encode(own[lo : lo + 9]), strict=True):
            assert np.frombuffer(raw, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize(("name", "dropped"), [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_added_tokens_are_encoded_as_a_plain_library_call_does(name, dropped):
    plain = fresh(name)
    own = ["foo<|endoftext|>bar", "a <|endoftext|> b", "<|startoftext|>x y<|endoftext|>", "<|endof text|> <|ENDOFTEXT|>", "foo bar", ""]
    got = tokens.CachedTokenizer(public_tokenizers.path(name), dropped).encode(own)
    assert [np.frombuffer(raw, "<u4").tolist() for raw in got] == [plain.encode(t, add_special_tokens=False).ids for t in own]


def ids_of(name):
    coder = fresh(name)
    return lambda t: coder.encode(t or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_binary_round_trip(docs, rows, nothing, monkeypatch):
    encode = ids_of("word_bpe_49k.json")
    own = sorted(((d is not None, d or 0, t or "") for d, t in rows))
    want, start = [], 0
    for known, d, t in own:
        ids = [*encode(t), 2]
        want.append((d if known else None, start, len(ids), crc(ids)))
        start += len(ids)
    shards = binary.write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), 2, True)
    same(binary.read_tokens(shards, digest=True), want)
    assert binary.read_tokens(shards).agg(F.sum(F.size("ids"))).first()[0] == start
    assert binary.read_tokens(binary.write_tokens(nothing, public_tokenizers.path("word_bpe_49k.json"), 2, True)).count() == 0


def test_elias_fano():
    rng = random.Random(2)
    for case in ([0], [5], [0, 0, 0], list(range(300)), sorted(rng.randrange(1 << 40) for _ in range(500)), sorted(rng.randrange(50) for _ in range(400)), [1 << 50]):
        e = binary.EliasFano.of(np.array(case))
        assert e.all().tolist() == case == [e.select(k) for k in range(len(case))]
    assert binary.EliasFano.of(np.array([], int)).all().tolist() == []
    far = [-(1 << 63), -5, 0, 3, 3, (1 << 63) - 1]
    known = binary.read_shard(binary.write_shard([None, *far], [b"\0\0\0\0"] * 7, False))[0]
    assert [known[k] for k in range(7)] == [None, *far]
    parts = [np.array(x, "<u4").tobytes() for x in ([1, 2, 3], [9], [7, 7])]
    for wide in (False, True):
        blob = binary.write_shard([None, 4, 5], parts, wide)
        known = binary.read_shard(blob)[0]
        assert [known[k] for k in range(len(known))] == [None, 4, 5]
        assert [binary.document(blob, k).tolist() for k in range(3)] == [[1, 2, 3], [9], [7, 7]]


def test_byte_bpe(docs, rows, nothing):
    loaded = tokens.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    want = []
    for d, t in rows:
        ids = loaded[0].encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    args = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    same(tokens.bpe_digest(docs, *args), want)
    assert tokens.bpe_encode(docs, *args).where("size(ids) > 0").count() == sum(bool(t) for _, t in rows)
    assert tokens.bpe_digest(nothing, *args).count() == 0


def test_long_texts_are_split_safely():
    loaded = tokens.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = random.Random(4)
    mixed = "".join(rng.choice(["a", "B", "7", " ", "  ", "\n", "\t", " ", "é", "!", "'s"]) for _ in range(150_000))
    plain = "".join(rng.choice(["a", "B", "7", " ", "  ", "\n", "\t", "é", "!", "'s"]) for _ in range(150_000))
    args = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    for t in (mixed, plain, "ab" * 12_000 + " c", " " * 20_000 + "x", "é" * 18_000, "x" + "\n" * 17_000, "y\r" + " " * 17_000 + "x"):
        assert tokens.encode_text(t, *args).tolist() == loaded[0].encode_ordinary(t)
    for t in (" " * 1_000_000 + "x", "\n" * 1_000_000, "!" * 1_000_000):  # beyond what one match of the library takes
        assert loaded[0].decode_bytes(tokens.encode_text(t, *args).tolist()) == t.encode()


def test_token_counts(docs, rows, nothing):
    args = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    encoding, _, _ = tokens.load_ranks(*args)
    want = []
    for d, t in rows:
        t = t or ""
        ids = encoding.encode_ordinary(t)
        if len(t) > 5000:
            continue
        lines = t.split("\n")
        lines = [x + "\n" for x in lines[:-1]] + [lines[-1]] * bool(lines[-1])
        owner = [k for k, line in enumerate(lines) for _ in line.encode()]  # of each byte
        counts, crossing, at = [0] * len(lines), 0, 0
        for i in ids:
            size = len(encoding.decode_single_token_bytes(i))
            counts[owner[at]] += 1
            crossing += owner[at] != owner[at + size - 1]
            at += size
        want.append((d, len(ids), len(lines), crossing, ",".join(map(str, counts))))
    same(tokens.token_counts(docs, *args).join(docs.where("length(text) > 5000").select("doc_id"), "doc_id", "left_anti"), want)
    total = tokens.section_tokens(docs, *args, rule="largest").agg(F.sum("n_tokens")).first()[0]
    assert total == tokens.token_counts(docs, *args).agg(F.sum("n_tokens")).first()[0]
    assert tokens.token_counts(nothing, *args).count() == 0
    with pytest.raises(ValueError):
        tokens.token_counts(docs, *args, rule="none")


def test_boundary_rules():
    start, stop, bounds = np.array([0, 2, 5]), np.array([2, 5, 6]), np.array([0, 3, 6])
    assert [tokens.attribute(start, stop, bounds, r)[0].tolist() for r in tokens.RULES] == [[2, 1], [1, 2], [1, 2]]


# --- packing


def test_packing(docs, rows, nothing):
    encode = ids_of("byte_bpe_50k.json")
    found = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    by_doc, by_sequence = {}, {}
    for r in found:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    expected = {}
    for d, t in rows:
        expected.setdefault(d, []).append([*encode(t), 0])
    for d, lists in expected.items():
        if len(lists) == 1:
            at = 0
            for r in sorted(by_doc[d], key=lambda r: r["start"]):
                piece = lists[0][at : at + r["length"]]
                assert (r["start"], r["ids_crc32"], r["doc_tokens"]) == (at, crc(piece), len(lists[0])) and piece
                at += r["length"]
            assert at == len(lists[0])
    assert sum(r["length"] for r in found) == sum(len(x) for xs in expected.values() for x in xs)
    part_full = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
        part_full += at < 1024
    assert part_full <= docs.rdd.getNumPartitions()
    assert packing.pack(nothing, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_sum_of_squares_takes_the_best_level():
    rng = random.Random(6)
    packer = packing.SumOfSquares(16)
    for _ in range(3000):
        size = rng.randint(1, 15)
        n = packer.count.copy()
        best = min(
            (sum(int(c) ** 2 for c in after[1:16]), -h)
            for h in range(0, 17 - size)
            if h == 0 or n[h]
            for after in [n - np.eye(17, dtype=int)[h] * (h > 0) + np.eye(17, dtype=int)[h + size]]
        )
        h = packer.level(size)
        after = n - np.eye(17, dtype=int)[h] * (h > 0) + np.eye(17, dtype=int)[h + size]
        assert sum(int(c) ** 2 for c in after[1:16]) == best[0]
        packer.put((0, 0, size, b"", size), size)


def test_pouring_keeps_every_token_and_one_window_open():
    rng = random.Random(7)
    packer, out, given = packing.SumOfSquares(16), [], 0
    for k in range(500):
        size = rng.randint(9, 15)  # such items never pair
        given += size
        if full := packer.put((k, 0, size, bytes(4 * size), size), size):
            out.append(full)
        if packer.held >= 200:
            out += packer.pour(packing.cut)
            assert packer.held < 16 and sum(map(len, packer.open)) <= 1
    assert all(sum(p[2] for p in pieces) == 16 for pieces in out)
    assert sum(p[2] for pieces in [*out, *packer.flush(packing.cut)] for p in pieces) == given


# --- quality


def brute_plain(text):
    words = WORD.findall(text)
    lines = text.split("\n")
    dup = sum(bool(WORD.search(x)) and x in lines[:k] for k, x in enumerate(lines))
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    hit = {j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(k, k + 5)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit))


def test_quality(docs, labels, rows, nothing):
    table_raw, table_good = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    for d, t in rows:
        n = np.bincount(quality.trigrams(t or ""), minlength=quality.BUCKETS)
        table_raw += n
        table_good += n * (d in good)
    ratio = np.log((table_good + 0.5) / (table_good.sum() + 0.5 * quality.BUCKETS)) - np.log((table_raw + 0.5) / (table_raw.sum() + 0.5 * quality.BUCKETS))
    want = []
    for d, t in rows:
        plain = brute_plain(t or "")
        failed = plain[0] < 10 or 100 * plain[4] > 20 * plain[0]
        score = ratio[quality.trigrams(t)].mean() if t else 0
        want.append((d, *plain, failed, bool(not failed and score >= quality.THRESHOLD)))
    found = quality.judge(docs, labels)
    same(found.drop("score"), want)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(w[-1] for w in want)
    assert quality.judge(nothing, labels).count() == 0
    assert quality.judge(docs, labels.where("false")).where("score <> 0").count() == 0


def test_quality_counts_every_good_row(spark):
    docs = spark.range(20_500).selectExpr("nullif(id, 7) as doc_id", "'ab' || id as text")
    labels = spark.range(20_500).selectExpr("id as doc_id", "1 as quality")
    row = quality.counts(docs, labels).selectExpr("sum(raw) as raw", "sum(trusted) as trusted").first()
    assert row.raw - row.trusted == len("ab7") - 2 and row.raw == sum(len(str(k)) for k in range(20_500))


# --- sketches


def test_sketches(spark, docs, rows, nothing):
    own = sorted(((d is not None, d or 0, t or "") for d, t in rows))
    following = own[1:] + own[:1]
    plain = {d: r["sketch"] for r in sketches.fingerprints(docs).collect() for d in [r["doc_id"]]}
    want = []
    for (known, d, t), (_, _, nxt) in zip(own, following, strict=True):
        q = len(t) // 4
        want.append((d if known else None, len(t), hashlib.sha256((t[: len(t) - q] + nxt[:q]).encode()).hexdigest()))
    found = sketches.compare_with_edited(docs)
    same(found.select("doc_id", "n_chars", "edited_sha256"), want)
    print_of = {}
    for r, t in ((r, dict(rows)[r["doc_id"]]) for r in found.collect()):
        if r["doc_id"] not in (None, 12, 10):
            print_of.setdefault(t or "", set()).add(r["fingerprint"])
            assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert all(len(v) == 1 for v in print_of.values())
    assert len({next(iter(v)) for v in print_of.values()}) == len(print_of)
    assert len(plain) and sketches.compare_with_edited(nothing).count() == 0
    single = sketches.compare_with_edited(docs.where("doc_id = 20")).first()
    assert single["near_next"] == 1.0


def test_sketch_keeps_the_fraction_and_estimates(spark):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(5000)]
    a = [rng.choice(words) for _ in range(4000)]
    b = a[:2000] + [rng.choice(words) for _ in range(2000)]
    frame = spark.createDataFrame([(" ".join(a), " ".join(b), " ".join(a[:500]))], "a string, b string, c string")
    s = {c: sketches.sketch(F.col(c)) for c in "abc"}
    row = frame.select(F.size(s["a"]).alias("n"), sketches.likeness(s["a"], s["b"], F.lit(False)).alias("j"), sketches.containment(s["c"], s["a"]).alias("k"), sketches.merged(s["a"], s["b"]).alias("m")).first()
    assert abs(row["n"] / 3996 - 0.25) < 0.03 and abs(row["j"] - 1 / 3) < 0.05 and row["k"] == 1.0
    assert row["m"] == sorted(set(row["m"]))


def test_sketches_equal_plain_python(spark, docs, rows):
    own = sketches.fingerprints(docs).select("doc_id", "sketch", "fingerprint").collect()
    shingles = {t: [" ".join(x) for x in zip(*(WORD.findall(t)[k:] for k in range(5)), strict=False)] for t in {t or "" for _, t in rows}}
    hashed = spark.createDataFrame([(s.split(" "),) for s in {s for v in shingles.values() for s in v}], "w array<string>").select(F.array_join("w", " ").alias("s"), F.xxhash64("w").alias("h"))
    h = {r["s"]: (r["h"] & (1 << 64) - 1) >> 32 for r in hashed.collect()}
    want = {}
    for t, v in shingles.items():
        every = sorted({h[s] for s in v})
        want[t] = [x for x in every if x < 1 << 30] if sum(x < 1 << 30 for x in every) >= 8 else every[:8]
    got = Counter((r["doc_id"], tuple(r["sketch"])) for r in own if len(r["sketch"]) != 1)
    assert got == Counter((d, tuple(want[t or ""])) for d, t in rows if len(want[t or ""]) > 1)
    assert all(r["fingerprint"][16:] == "".join(f"{x:08x}" for x in r["sketch"]) for r in own)


def test_likeness_of_whole_sketches_is_exact(spark):
    rng = random.Random(3)
    cases = []
    for n in (1, 3, 7, 8, 40):
        a = sorted({rng.randrange(1 << 32) for _ in range(n)})
        cases.append((a[: 1 + n // 2], a))
    frame = spark.createDataFrame(cases, "a array<long>, b array<long>")
    for r in frame.select("a", "b", sketches.likeness(F.col("a"), F.col("b"), F.lit(False)).alias("j")).collect():
        upto = min((1 << 32) if len(x) < 8 else max(1 << 30, x[-1] + 1) for x in (r["a"], r["b"]))
        a, b = ({x for x in v if x < upto} for v in (r["a"], r["b"]))
        assert abs(r["j"] - len(a & b) / len(a | b)) < 1e-12


# --- passages


def brute_kept(rows):
    starts: dict = {}
    for d, t in rows:
        words = WORD.findall(t or "")
        if d is not None:
            for k in range(len(words) - 12):
                w = tuple(words[k : k + 13])
                starts[w] = min(d, starts.get(w, d))
    for d, t in rows:
        words = WORD.findall(t or "")
        gone = {j for k in range(len(words) - 12) if d is not None and starts[tuple(words[k : k + 13])] < d for j in range(k, k + 13)}
        yield d, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)


@pytest.mark.parametrize(("crowded", "shard"), [(10_000, 4_000), (2, 3)])
def test_passages(docs, rows, nothing, crowded, shard):
    want = list(brute_kept(rows))
    assert sum(w[2] > 0 for w in want) >= 4
    same(passages.kept_words(docs, crowded=crowded, shard=shard), want)
    same(passages.kept_words(docs, digest=True), [(d, n, r, hashlib.sha256(k.encode()).hexdigest()) for d, n, r, k in want])
    assert passages.kept_words(nothing).count() == 0


def test_segments_summed_in_small_parts_are_the_same():
    import pyarrow as pa

    rng = random.Random(5)
    spots = lambda: [{"a": a, "n": 2, "h": a % 3, "crowded": a % 2 == 0} for a in range(0, 8, 2)] + [{"a": 1, "n": 3, "h": 7, "crowded": False}]
    rows = [{"doc_id": d, "th": 0, "text": " ".join(rng.choice("ab") for _ in range(15)), "spots": spots() if d % 4 else None} for d in range(40)]
    batch = pa.RecordBatch.from_pylist(rows)
    wanted: dict = {}
    for part in passages._places([batch], 4):
        for r in part.to_pylist():
            k = r["key"], r["segment"]
            wanted[k] = min(r["doc_id"], wanted.get(k, r["doc_id"]))
    assert wanted and not list(passages._summed([batch.slice(0, 1)], 4))
    for held, chars in ((1, 10**6), (7, 10**6), (10**6, 1), (10**6, 40), (10**6, 10**6)):
        found: dict = {}
        for part in passages._summed([batch], 4, held, chars):
            assert part.num_rows <= held
            for r in part.to_pylist():
                k = r["key"], r["segment"]
                found[k] = min(r["first"], found.get(k, r["first"]))
        assert found == wanted


def test_passages_of_random_overlaps(spark):
    rng = random.Random(12)
    pool = [[f"{rng.choice('abcd')}{rng.randrange(40)}" for _ in range(60)] for _ in range(5)]
    rows = []
    for d in range(60):
        words = []
        for _ in range(rng.randint(1, 4)):
            p, s = rng.choice(pool), rng.randrange(40)
            words += p[s : s + rng.randint(5, 40)] + [f"z{rng.randrange(9)}"] * rng.randint(0, 20)
        rows.append((d, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for crowded, shard in ((10_000, 4_000), (5, 2)):
        same(passages.kept_words(frame, crowded=crowded, shard=shard), list(brute_kept(rows)))


def test_cleaned_text_keeps_columns(docs, rows):
    clean = passages.remove_repeats(docs)
    assert clean.columns == docs.columns and clean.dtypes == docs.dtypes
    parts = lambda k: tuple(w.decode() for w in k.encode().split())
    want = Counter((d, parts(k)) if t is not None else (d, None) for (d, t), (_, _, _, k) in zip(rows, brute_kept(rows), strict=True))
    got = Counter((r["doc_id"], None if r["text"] is None else parts(r["text"])) for r in clean.collect())
    assert got == want


# --- toxicity


@pytest.fixture(scope="module")
def toxic_docs(spark):
    rng = random.Random(2)
    calm = ["kara", "lono", "mimi", "ruvo", "tesa", "bano", "doli", "fen", "gora"]
    rude = ["skumbag", "vileness", "skumvile"]
    rows = []
    for d in range(420):
        words = [rng.choice(calm) for _ in range(rng.randint(20, 200))]
        if d % 3 == 0:
            for _ in range(max(2, len(words) // 20)):
                words[rng.randrange(len(words))] = rng.choice(rude)
        rows.append((d, " ".join(words), int(d % 3 == 0)))
    rows += [(1000, None, 0), (1001, "", 0), (1002, "kara " * 20_000, 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return frame.drop("toxic").withColumn("score", F.lit("clash")), frame.select("doc_id", "toxic", F.lit(1).alias("quality"))


def test_toxicity_learns_and_holds_out(toxic_docs):
    docs, labels = toxic_docs
    found = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(found) == 423
    for d, r in found.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        assert r["predicted"] == int(r["score"] >= 0.7)
    test = [d for d, r in found.items() if r["held_out"] and d < 420]
    assert np.mean([found[d]["predicted"] == (d % 3 == 0) for d in test]) > 0.9
    assert found[1000]["score"] == found[1001]["score"] == 0
    none = toxicity.toxicity(docs.limit(5), labels.where("false"))
    assert [r["score"] for r in none.collect()] == [0.0] * 5
    assert toxicity.toxicity(docs.where("false"), labels).count() == 0


def test_gradients(monkeypatch):
    monkeypatch.setattr(toxicity, "F32", np.float64)
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in toxicity.Model.new().p.items()}
    x, mask, d = rng.standard_normal((5, 3, toxicity.DIM)), np.ones((5, 3)), np.array([0.3, -0.7, 1.1])
    mask[3:, 1] = 0
    g, dx = toxicity.backward(p, x, d, toxicity.forward(p, x, mask, keep=True)[1])
    for k in g:
        at = tuple(rng.integers(0, s) for s in p[k].shape)
        ends = []
        for e in (1e-5, -2e-5):
            p[k][at] += e
            ends.append(toxicity.forward(p, x, mask)[0] @ d)
        p[k][at] += 1e-5
        assert abs(g[k][at] - (ends[0] - ends[1]) / 2e-5) < 1e-5


def test_learning_takes_one_row_an_id_and_whole_rows_up_to_a_bound(toxic_docs):
    docs, labels = toxic_docs
    seen = [toxicity.sample(docs.union(docs), labels.union(labels), rows_a_class=30)[0].collect(), toxicity.sample(docs, labels, chars_a_class=5000)[0].collect()]
    assert len(seen[0]) == 60 == len({d for d, _, _ in seen[0]})
    for toxic in (0, 1):
        assert 3000 < sum(len(t) for _, x, t in seen[1] if x == toxic) <= 5000


def test_learning_never_loses_a_class_to_a_long_text(spark):
    seen = []
    ids = [d for d in range(400) if zlib.crc32(str(d).encode()) % 3 != 1][:200]
    for longs in (set(ids[:150]), set(ids)):  # most texts, then all, are over the bound
        docs = spark.createDataFrame([(d, "w " * (4000 if d in longs else 30)) for d in ids], "doc_id long, text string")
        seen.append(toxicity.sample(docs, spark.createDataFrame([(d, d % 2) for d in ids], "doc_id long, toxic int"), chars_a_class=5000)[0].collect())
    for toxic in (0, 1):
        short = [d for d in ids[150:] if d % 2 == toxic]
        assert {d for d, x, _ in seen[0] if x == toxic} == set(short)
        assert len([1 for _, x, _ in seen[1] if x == toxic]) == 1


def test_forward_equals_a_plain_network():
    """The gates, both directions and the attention pooling, number by number."""
    rng = random.Random(3)
    p = {k: v.astype(np.float64) for k, v in toxicity.Model.new().p.items()}
    H, D = toxicity.HIDDEN, toxicity.DIM
    x = [[rng.gauss(0, 1) for _ in range(D)] for _ in range(6)]
    sig = lambda v: 1 / (1 + math.exp(-v))
    dot = lambda row, m, j: sum(v * m[i][j] for i, v in enumerate(row))

    def run(d, order):
        h, out = [0.0] * H, {}
        for t in order:
            w = [dot(x[t], p[f"W{d}"], j) + p[f"b{d}"][j] for j in range(3 * H)]
            u = [dot(h, p[f"U{d}"], j) for j in range(3 * H)]
            z, r = [sig(w[j] + u[j]) for j in range(H)], [sig(w[H + j] + u[H + j]) for j in range(H)]
            g = [math.tanh(w[2 * H + j] + r[j] * u[2 * H + j]) for j in range(H)]
            h = [z[j] * h[j] + (1 - z[j]) * g[j] for j in range(H)]
            out[t] = h
        return out

    f, b = run("f", range(6)), run("b", range(5, -1, -1))
    both = [f[t] + b[t] for t in range(6)]
    a = [[math.tanh(dot(row, p["A"], j)) for j in range(p["A"].shape[1])] for row in both]
    e = [math.exp(sum(v * w for v, w in zip(row, p["v"], strict=True))) for row in a]
    pooled = [sum(e[t] * both[t][j] for t in range(6)) / sum(e) for j in range(2 * H)]
    want = sum(v * w for v, w in zip(pooled, p["w"], strict=True)) + p["c"][0]
    padded = np.zeros((9, 2, D))
    padded[:6, 0], padded[:6, 1] = x, x[::-1]
    mask = np.zeros((9, 2))
    mask[:6] = 1
    assert abs(toxicity.forward(p, padded.astype(np.float32), mask.astype(np.float32))[0][0] - want) < 1e-4


def test_windows_cover_every_word():
    for n in (0, 1, 63, 64, 65, 112, 113, 1000):
        cuts = toxicity.cut_windows(n)
        assert {k for a, z in cuts for k in range(a, z)} == set(range(n))
        assert all(z - a <= toxicity.WINDOW for a, z in cuts)


def test_a_long_posting_is_labelled_a_few_rows_at_a_time():
    import tracemalloc

    close = [sum(1 << p for p in at) for at in itertools.combinations(range(64), 3)][: simhash.LONG_POSTING]
    tracemalloc.start()
    found = simhash.roots(np.array(close, np.uint64), 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(found.tolist()) == {0} and peak < 100e6

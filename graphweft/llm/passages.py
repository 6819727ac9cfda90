"""Removal of passages that already stand in an earlier document.

Of equal texts only the one with the smallest doc_id is looked into; all windows
of the others begin there. A window is `width` consecutive words. Every window is represented by the
smallest hash of the shorter phrases in it, so equal windows have equal
anchors, and neighbouring windows mostly share theirs: only one row for each
run of windows is counted. Anchors that stand in documents of two ids are
recurring; around each of their places the words are cut out as a segment.
Equal segments are summed to one with its smallest doc_id before anything is
gathered. Sorted by anchor, segments are taken in shards of bounded size: the
windows that segments of different documents share are confirmed by counting
and compiled into an Aho-Corasick automaton over words, and the shard's
segments - all text around recurring anchors - are streamed through it, which
locates each occurrence, word for word, and so the earliest document of each.

An anchor that stands in very many places is not gathered: there each window
is a segment of its own, so that equal ones are summed.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphweft.llm.common import WORD, batch_of, numbered, place

WORDS = re.compile(WORD)
#: Words of the phrases of which a window's smallest hash is its anchor.
PHRASE = 5
#: Windows of one run at most, so that a run's windows fit a bit mask.
RUN = 32
#: An anchor with more places has its windows taken one by one.
CROWDED = 10_000
#: Segments in an automaton, unless one anchor has more.
SHARD = 4_000
#: Distinct segments, or characters of them, that a task sums before it sends them on.
HELD, HELD_CHARS = 50_000, 8_000_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def anchor_runs(words: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, number of windows) of each run."""
    n, phrase = len(words), min(PHRASE, width)
    if n < width:
        none = np.zeros(0, np.int64)
        return none, none, none
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(w) for w in words], np.uint64)
    g = np.zeros(n - phrase + 1, np.uint64)
    for k in range(phrase):
        g = mixed(g + h[k : k + len(g)])
    least = g[: n - width + 1].copy()
    for k in range(1, width - phrase + 1):
        np.minimum(least, g[k : k + len(least)], out=least)
    start = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    size = np.diff(np.concatenate([start, [len(least)]]))
    if (size > RUN).any():
        start = np.concatenate([np.arange(s, s + m, RUN) for s, m in zip(start, size, strict=True)])
        size = np.diff(np.concatenate([start, [len(least)]]))
    return least[start].view(np.int64), start.astype(np.int64), size.astype(np.int64)


def _anchors(batches, width: int):
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("h", pa.int64()), ("a", pa.int32()), ("n", pa.int32())])
    for b in batches:
        at = {name: b.schema.get_field_index(name) for name in ("doc_id", "th", "text", "copy")}
        for lo in range(0, b.num_rows, 512):
            part = b.slice(lo, 512)
            ids, ths, copies = (part.column(at[k]).to_pylist() for k in ("doc_id", "th", "copy"))
            own = [k for k, d in enumerate(ids) if d is not None and not copies[k]]
            texts = part.column(at["text"])
            runs = [anchor_runs(texts[k].as_py().encode().split(), width) for k in own]
            if not sum(len(r[0]) for r in runs):
                continue
            times = [len(r[0]) for r in runs]
            h, a, n = (np.concatenate([r[k] for r in runs]) for k in range(3))
            repeated = lambda xs: np.repeat(np.array([xs[k] for k in own], np.int64), times)
            yield batch_of(schema, {"doc_id": repeated(ids), "th": repeated(ths), "h": h, "a": a.astype("i4"), "n": n.astype("i4")})


def _around(batches, width: int):
    """Input columns end with doc_id, th, text, spots; yields for each 256 rows
    the text around each spot as (key, segment, doc_id, th, first window)."""
    for b in batches:
        at = {name: b.schema.get_field_index(name) for name in ("doc_id", "th", "text", "spots")}
        for lo in range(0, b.num_rows, 256):
            part = b.slice(lo, 256)
            yield _cut(zip(*(part.column(at[k]).to_pylist() for k in ("doc_id", "th", "text", "spots")), strict=True), width)


def _cut(rows, width: int):
    for d, th, text, spots in rows:
        if not spots:
            continue
        words = WORDS.findall(text)
        done = set()
        for spot in spots:
            a, n, h = spot["a"], spot["n"], spot["h"]
            if a in done:  # the same text may stand twice under one id
                continue
            done.add(a)
            for s, m in [(a, n)] if not spot["crowded"] else [(s, 1) for s in range(a, a + n)]:
                segment = " ".join(words[s : s + m + width - 1])
                yield h if not spot["crowded"] else xxhash.xxh64_intdigest(segment.encode()) - (1 << 63), segment, d, th, s


def _places(batches, width: int):
    """Each segment's place; its text only for its hash and length, which are
    taken before anything is shuffled."""
    schema = pa.schema([("key", pa.int64()), ("segment", pa.string()), ("doc_id", pa.int64()), ("th", pa.int64()), ("a", pa.int32())])
    for found in _around(batches, width):
        columns = list(zip(*found, strict=True)) or [()] * len(schema)
        yield batch_of(schema, {f.name: c for f, c in zip(schema, columns, strict=True)})


def _summed(batches, width: int, held: int = HELD, held_chars: int = HELD_CHARS):
    """(key, segment, first): equal segments of a task summed to one with its
    smallest doc_id, as far as `held` segments or `held_chars` characters go;
    what is held is then sent on, so a segment may come more than once."""
    schema = pa.schema([("key", pa.int64()), ("segment", pa.string()), ("first", pa.int64())])
    least: dict[tuple[int, str], int] = {}
    chars = 0

    def sent() -> pa.RecordBatch:
        out = batch_of(schema, {"key": [k for k, _ in least], "segment": [s for _, s in least], "first": list(least.values())})
        least.clear()
        return out

    for found in _around(batches, width):
        for key, segment, d, _, _ in found:
            before = least.get((key, segment))
            if before is None:
                chars += len(segment)
                least[key, segment] = d
            elif d < before:
                least[key, segment] = d
            if len(least) >= held or chars >= held_chars:
                yield sent()
                chars = 0
    if least:
        yield sent()


def confirmed(codes: list[np.ndarray], firsts: list[int], width: int) -> list[tuple[int, ...]]:
    """Windows that stand in segments of different first documents. Hashes are
    counted to find them, so a window may be among them that does not recur;
    the automaton's matches, word for word, decide."""
    size = np.array([len(c) - width + 1 for c in codes])
    flat = np.concatenate(codes)
    g = np.zeros(len(flat) - width + 1, np.uint64)
    for k in range(width):
        g = mixed(g + flat[k : k + len(g)].astype(np.uint64) + np.uint64(1))
    begin = np.concatenate([[0], np.cumsum([len(c) for c in codes])[:-1]])
    at = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    own, g = np.repeat(np.array(firsts, np.int64), size), g[at]
    order = np.lexsort((own, g))
    g, own, at = g[order], own[order], at[order]
    start = np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1])
    stop = np.concatenate([start[1:], [len(g)]])
    recurs = np.repeat(own[start] != own[stop - 1], stop - start)
    return list({tuple(flat[a : a + width].tolist()) for a in at[recurs].tolist()})


def located(segments: list[str], firsts: list[int], width: int) -> list[int]:
    """For each segment the mask of its windows that begin in a document before
    the segment's first. Confirmed windows are compiled into an automaton over
    words, and every segment is streamed through it: its matches are the
    occurrences, and a window's earliest document is the least of them."""
    import ahocorasick

    ids: dict[str, int] = {}
    codes = [np.array([ids.setdefault(w, len(ids)) for w in s.split(" ")], np.int64) for s in segments]
    masks, phrases = [0] * len(segments), confirmed(codes, firsts, width)
    if not phrases:
        return masks
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for k, window in enumerate(phrases):
        automaton.add_word(window, k)
    automaton.make_automaton()
    earliest: list[int | None] = [None] * len(phrases)
    found = []
    for at, (code, first) in enumerate(zip(codes, firsts, strict=True)):
        for end, k in automaton.iter(tuple(code.tolist())):
            found.append((at, end - width + 1, k))
            if earliest[k] is None or first < earliest[k]:
                earliest[k] = first
    for at, begin, k in found:
        if earliest[k] < firsts[at]:
            masks[at] |= 1 << begin
    return masks


def _confirmed(batches, width: int, shard: int):
    """Distinct segments (key, segment, sh, first) sorted by key, in shards of whole keys."""
    schema = pa.schema([("key", pa.int64()), ("sh", pa.int64()), ("first", pa.int64()), ("mask", pa.int64())])
    held: pa.Table | None = None

    def done(t: pa.Table):
        key = t.column("key").to_numpy()
        same = np.zeros(len(key), bool)
        same[1:] |= key[1:] == key[:-1]
        same[:-1] |= key[1:] == key[:-1]
        mask = np.zeros(len(key), np.int64)
        at = np.flatnonzero(same)
        ends = np.flatnonzero(np.diff(key[at])) + 1
        lo = 0
        while lo < len(at):  # whole keys, about `shard` segments at a time
            stop = np.searchsorted(ends, lo + shard)
            hi = int(ends[stop]) if stop < len(ends) else len(at)
            rows = at[lo:hi]
            some = t.take(pa.array(rows))
            mask[rows] = located(some.column("segment").to_pylist(), some.column("first").to_pylist(), width)
            lo = hi
        return pa.RecordBatch.from_arrays([t.column(n).combine_chunks() for n in ("key", "sh", "first")] + [pa.array(mask)], schema=schema)

    for b in batches:
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t])
        key = held.column("key").to_numpy()
        last = int(np.searchsorted(key, key[-1])) if len(key) else 0
        if last >= shard:
            yield done(held.slice(0, last).combine_chunks())
            held = held.slice(last)
    if held is not None and held.num_rows:
        yield done(held.combine_chunks())


def covered(n_words: int, hits: list[dict] | None, width: int) -> np.ndarray:
    """Which words stand in a window that is to be removed."""
    edge = np.zeros(n_words + 1, np.int64)
    for hit in hits or ():
        mask, s = hit["mask"], hit["a"]
        while mask:
            bit = (mask & -mask).bit_length() - 1
            edge[s + bit] += 1
            edge[min(n_words, s + bit + width)] -= 1
            mask &= mask - 1
    return np.cumsum(edge[:-1]) > 0


def repeats(keyed: DataFrame, width: int = 13, crowded: int = CROWDED, shard: int = SHARD) -> DataFrame:
    """keyed (doc_id, th, text and any more) with `copy`, true where the same
    text stands under a smaller doc_id, and for the others `hits`: the windows
    that also begin in a document of a smaller doc_id, as (a, mask)."""
    # Texts are shuffled once: every join to them is a left join on the same key.
    texts = keyed.select("doc_id", "th", F.md5(F.col("text")).alias("same")).where("doc_id is not null")
    first_of = texts.groupBy("same").agg(F.min("doc_id").alias("least"))
    copies = texts.join(first_of, "same").where("doc_id > least").select("doc_id", "th").distinct().withColumn("copy", F.lit(True))
    marked = keyed.join(copies, ["doc_id", "th"], "left")
    anchors = marked.mapInArrow(functools.partial(_anchors, width=width), "doc_id long, th long, h long, a int, n int")
    # Anchors are shuffled once too. One has a row for each run of a document, and equal
    # texts count once, so even one that a third of all documents share has a small
    # part of the rows.
    same = Window.partitionBy("h")
    counted = anchors.withColumns({"lo": F.min("doc_id").over(same), "hi": F.max("doc_id").over(same), "places": F.count(F.lit(1)).over(same)}).where("lo < hi")
    spots = counted.groupBy("doc_id", "th").agg(F.collect_list(F.struct("a", "n", "h", (F.col("places") > crowded).alias("crowded"))).alias("spots"))
    spotted = marked.join(spots, ["doc_id", "th"], "left")
    segments = spotted.mapInArrow(functools.partial(_places, width=width), "key long, segment string, doc_id long, th long, a int").withColumn("sh", F.xxhash64("segment"))
    # Segments are shuffled once, summed by each task before: dealt out by key, equal ones
    # are together too.
    dealt = spotted.mapInArrow(functools.partial(_summed, width=width), "key long, segment string, first long").repartition("key").withColumn("sh", F.xxhash64("segment"))
    distinct = dealt.groupBy("key", "sh", "segment").agg(F.min("first").alias("first"))
    ordered = distinct.select("key", "segment", "sh", "first").sortWithinPartitions("key")
    found = ordered.mapInArrow(functools.partial(_confirmed, width=width, shard=shard), "key long, sh long, first long, mask long")
    whole = (1 << RUN) - 1
    n_windows = F.size(F.split("segment", " ")) - F.lit(width - 1)
    places = segments.select("key", "sh", "doc_id", "th", "a", n_windows.alias("n")).join(found, ["key", "sh"])
    mask = F.when(F.col("doc_id") > F.col("first"), F.expr(f"{whole}L >> ({RUN} - n)")).otherwise(F.col("mask"))
    hits = places.select("doc_id", "th", F.col("a"), mask.alias("mask")).where("mask <> 0").groupBy("doc_id", "th").agg(F.collect_set(F.struct("a", "mask")).alias("hits"))
    return marked.join(hits, ["doc_id", "th"], "left")


def keyed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rest: bool = False) -> DataFrame:
    """(doc_id, th, text and, if asked, the row as a struct of numbered
    columns). th tells texts of one doc_id apart; it is 0 where no doc_id
    repeats, as a column of zeros takes no room. Rows without an id are spread by it."""
    unique = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long")).count().where("count > 1").isEmpty()
    own = numbered(docs)
    d, t = (F.col(f"c{place(docs, c)}") for c in (id_col, text_col))
    d, t = d.cast("long"), F.coalesce(t.cast("string"), F.lit(""))
    th = F.when(d.isNull(), F.xxhash64(t)).otherwise(F.lit(0).cast("long")) if unique else F.xxhash64(t)
    return own.select(d.alias("doc_id"), th.alias("th"), t.alias("text"), *([F.struct(*own.columns).alias("rest")] if rest else []))


def _kept(batches, width: int, digest: bool):
    kind = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256" if digest else "kept", pa.string())]
    for b in batches:
        at = {name: b.schema.get_field_index(name) for name in ("doc_id", "text", "hits", "copy")}
        for lo in range(0, b.num_rows, 512):
            part = b.slice(lo, 512)
            out: dict[str, list] = {k: [] for k, _ in kind}
            for d, text, hits, copy in zip(*(part.column(at[k]).to_pylist() for k in ("doc_id", "text", "hits", "copy")), strict=True):
                words = text.encode().split()
                gone = covered(len(words), hits, width) if hits else np.full(len(words), bool(copy) and len(words) >= width)
                kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                for (k, _), v in zip(kind, (d, len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest() if digest else kept.decode()), strict=True):
                    out[k].append(v)
            yield batch_of(pa.schema(kind), out)


def kept_words(docs: DataFrame, width: int = 13, digest: bool = False, id_col: str = "doc_id", text_col: str = "text", crowded: int = CROWDED, shard: int = SHARD) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): the words of each text that no
    window covers which also starts in a document of a smaller doc_id, joined
    by one blank; with digest=True their SHA-256 in place of them.

    Null and empty texts have no words; texts shorter than a window lose
    none; rows of one doc_id never remove each other's words; rows with a
    null doc_id are neither before nor after any other and lose none.
    """
    rows = repeats(keyed_rows(docs, id_col, text_col), width, crowded, shard)
    schema = f"doc_id long, n_words long, n_removed long, {'kept_sha256' if digest else 'kept'} string"
    return rows.mapInArrow(functools.partial(_kept, width=width, digest=digest), schema)


def kept_text(text: str, hits: list[dict] | None, width: int, copy: bool = False) -> str:
    """The text without the covered words: each stretch between them as it
    stands, white space included, joined by one blank."""
    if copy:
        return text if len(text.encode().split()) < width else ""
    if not hits:
        return text
    spans = [m.span() for m in WORDS.finditer(text)]
    gone = covered(len(spans), hits, width)
    keep = np.flatnonzero(~gone)
    if not len(keep):
        return ""
    cut = np.flatnonzero(np.diff(keep) > 1)
    first, last = np.concatenate([[keep[0]], keep[cut + 1]]), np.concatenate([keep[cut], [keep[-1]]])
    return " ".join(text[spans[a][0] : spans[z][1]] for a, z in zip(first, last, strict=True))


def _cleaned(batches, width: int):
    for b in batches:
        at = {name: b.schema.get_field_index(name) for name in ("text", "hits", "copy", "rest")}
        own = zip(*(b.column(at[k]).to_pylist() for k in ("text", "hits", "copy")), strict=True)
        new = pa.array([kept_text(t, h, width, bool(c)) for t, h, c in own], pa.string())
        yield pa.RecordBatch.from_arrays([new, b.column(at["rest"])], names=["text", "rest"])


def remove_repeats(docs: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the covered words cut out of text_col; a null text stays null,
    other columns stay as they are."""
    rows = repeats(keyed_rows(docs, id_col, text_col, rest=True), width)
    schema = T.StructType([T.StructField("text", T.StringType()), rows.schema["rest"]])
    cleaned = rows.mapInArrow(functools.partial(_cleaned, width=width), schema)
    own = [F.col("rest").getField(f"c{k}") for k in range(len(docs.columns))]
    k = place(docs, text_col)
    own[k] = F.when(own[k].isNotNull(), F.col("text"))
    return cleaned.select(*own).toDF(*docs.columns)

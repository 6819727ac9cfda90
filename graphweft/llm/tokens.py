"""Byte-level BPE with tiktoken ranks, cached encoding with the tokenizers
library, and attribution of tokens to sections.

All three rest on one fact about the tokenizers' split patterns: a piece
never holds white space after a character that isn't white space. Between
such a character and a blank, tab or newline a text can be cut, and the ids
of the parts concatenate to the ids of the whole. Texts with any other white
space are encoded uncut, because libraries differ in what they count as such.
"""

from __future__ import annotations

import array
import base64
import functools
import hashlib
import os
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft.llm.common import batch_of, pick

#: White space, or what some library counts as such, besides blank, tab, newline.
ODD = re.compile("[\r\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -​    　﻿]")
CHUNK = re.compile(r"[ \n\t]*[^ \n\t]+|[ \n\t]+")
SAFE = re.compile(r"(?<=[^ \n\t])(?=[ \n\t])")
#: Texts over so many characters are cut at safe boundaries before tiktoken sees them.
LONG = 1 << 16
#: Runs of white space over so many characters are split by the pattern here.
RUN = 1 << 14


# --- tiktoken --------------------------------------------------------------


@functools.lru_cache(maxsize=4)
def load_ranks(path: str, pattern: str):
    import tiktoken

    ranks: dict[bytes, int] = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return encoding, ranks, lengths


@functools.lru_cache(maxsize=4)
def whole_pieces(path: str, pattern: str):
    """The same ranks, with a pattern that takes all it is given as one piece."""
    import tiktoken

    return tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=load_ranks(path, pattern)[1], special_tokens={})


def safe_parts(text: str, size: int = LONG):
    """Parts of about size characters, cut at safe boundaries only."""
    start, n = 0, len(text)
    while n - start > size:
        cut = SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


#: White space that the library's own matching can't take in one run.
LONG_RUN = re.compile(r"\s{%d}" % RUN)


def encode_text(text: str, ranks_path: str, pattern: str) -> np.ndarray:
    """Ids of a text as uint32, by tiktoken. Long texts are cut at safe
    boundaries first. A part with a very long run of white space is split by
    the pattern here, and tiktoken merges each piece."""
    encoding = load_ranks(ranks_path, pattern)[0]
    if len(text) <= RUN:
        return np.asarray(encoding.encode_ordinary(text), dtype="<u4")
    out = []
    for part in [text] if ODD.search(text) else safe_parts(text):
        if LONG_RUN.search(part):
            merge = whole_pieces(ranks_path, pattern).encode_ordinary
            out += [np.asarray(merge(m.group()), dtype="<u4") for m in regex.finditer(pattern, part)]
        else:
            out.append(np.asarray(encoding.encode_ordinary(part), dtype="<u4"))
    return np.concatenate(out)


BPE_SCHEMA = "doc_id long, ids array<int>, decoded binary"


def _bpe(batches, ranks_path: str, pattern: str, digest: bool):
    decode = load_ranks(ranks_path, pattern)[0].decode_bytes
    for b in batches:
        docs, texts = b.column(0), b.column(1).to_pylist()
        for lo in range(0, len(texts), 256):
            cols: list[tuple] = []
            for text in texts[lo : lo + 256]:
                ids = encode_text(text, ranks_path, pattern)
                raw = decode(ids.tolist())
                cols.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest()) if digest else (ids.astype("i4"), raw))
            parts = [pa.array(list(c)) if digest else pa.array(list(c), type=t) for c, t in zip(zip(*cols), (pa.list_(pa.int32()), pa.binary()), strict=False)] if not digest else [pa.array([c[0] for c in cols], pa.int64()), pa.array([c[1] for c in cols], pa.string()), pa.array([c[2] for c in cols], pa.string())]
            names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays([docs.slice(lo, 256), *parts], names=["doc_id", *names])


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded bytes) of every whole text.

    Null and empty texts give no ids and no bytes; repeated rows give repeated
    rows; a text of any length is encoded whole.
    """
    return pick(docs, id_col, text_col).mapInArrow(functools.partial(_bpe, ranks_path=ranks_path, pattern=pattern, digest=False), BPE_SCHEMA)


def bpe_digest(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As bpe_encode, but counts and SHA-256 sums in place of the ids and bytes."""
    return pick(docs, id_col, text_col).mapInArrow(functools.partial(_bpe, ranks_path=ranks_path, pattern=pattern, digest=True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


# --- the tokenizers library, with a cache of chunks --------------------------


def byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: visible
    Latin-1 characters stand for themselves, the rest are numbered from 256."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = (chr(256 + k) for k in range(256))
    return [chr(b) if b in shown else next(rest) for b in range(256)]


#: Latin letters, and signs behind them that are a piece of their own.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


class CachedTokenizer:
    """encode(texts) gives each text's ids as little-endian uint32 bytes, equal
    to the library's own. Distinct chunks go through the library once: plain
    Latin words and the signs behind them straight to its BPE model, of which
    they are a piece each already, any other chunk through the library's whole
    chain. A text that holds one of the vocabulary's added tokens goes to the
    library whole.

    Where white space is not dropped, a chunk is a word with the blank or the
    newline before it; a text with any other white space is cut by CHUNK.
    Chunks are held in two generations of at most `limit` / 2 each: when the
    newer is full it becomes the older, so what is met often stays."""

    def __init__(self, path: str, white_space_dropped: bool, limit: int = 1_600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = [re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added) or "(?!)", re.I)
        self.model, self.lower = self.library.model, white_space_dropped
        self.model._resize_cache(0)  # chunks are held here instead
        self.limit = limit
        #: By chunk without its blank; by chunk as it stands (first words and odd ones).
        self.held: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.begun: dict[str, bytes] = {}
        self.signs: dict[str, bytes] = {"": b""}
        stand = byte_chars()
        self.table = {c: "".join(stand[b] for b in chr(c).encode()) for c in range(256)}
        self.blank, self.newline = self.table[32], self.raw("\n")

    def piece(self, text: str) -> bytes:
        return array.array("I", [t.id for t in self.model.tokenize(text if text.isascii() else text.translate(self.table))]).tobytes()

    def raw(self, text: str) -> bytes:
        return array.array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def chunk(self, c: str, before: str) -> bytes:
        """Ids of a chunk after `before`, a blank or nothing."""
        m = PLAIN.fullmatch(c)
        if not m:
            return self.raw(before + c)
        word, sign = m[1], m[2]
        if self.lower:
            word = word.lower()
        if sign and (self.lower or before) and (held := self.held.get(word) or self.older.get(word)):
            pass
        else:
            held = self.piece(self.blank + word if before else word)
        if sign not in self.signs:
            if len(self.signs) > 10_000:
                self.signs = {"": b""}
            self.signs[sign] = self.piece(sign)
        return held + self.signs[sign]

    def first(self, c: str) -> bytes:
        """A chunk that stands at the begin of a text or line, or is cut by CHUNK."""
        if c not in self.begun:
            if len(self.begun) > self.limit // 8:
                self.begun.clear()
            self.begun[c] = self.chunk(c, "")
        return self.begun[c]

    def learned(self, w: str) -> bytes | None:
        """Ids of a word, held from now on; None if it isn't cut by single blanks."""
        if (ids := self.older.get(w)) is None:
            if self.lower:
                ids = self.chunk(w, "")
            elif w in ("", "\n") or "\t" in w:
                return None
            else:
                ids = self.newline + self.first(w[1:]) if w[0] == "\n" else self.chunk(w, " ")
        self.held[w] = ids
        return ids

    def one(self, text: str) -> bytes:
        if ODD.search(text) or self.added.search(text):
            return self.raw(text)
        if self.lower:
            words, begin = text.split(), b""
        elif not text or text[0] in " \n\t":
            return b"".join(map(self.first, CHUNK.findall(text)))
        else:
            start, *words = text.replace("\n", " \n").split(" ")
            if "\t" in start:
                return b"".join(map(self.first, CHUNK.findall(text)))
            begin = self.first(start)
        if len(self.held) > self.limit // 2:
            self.older, self.held = self.held, {}
        found = list(map(self.held.get, words))
        for k in [k for k, ids in enumerate(found) if ids is None]:
            w = words[k]
            if (ids := self.held.get(w) or self.learned(w)) is None:
                return b"".join(map(self.first, CHUNK.findall(text)))
            found[k] = ids
        return begin + b"".join(found)

    def encode(self, texts: list[str]) -> list[bytes]:
        return [self.one(text) for text in texts]


@functools.lru_cache(maxsize=4)
def cached_tokenizer(path: str, white_space_dropped: bool) -> CachedTokenizer:
    return CachedTokenizer(path, white_space_dropped)


def slices(b: pa.RecordBatch, size: int = 128):
    """(doc_ids, texts) of at most `size` rows, so that what a batch yields stays small."""
    for lo in range(0, b.num_rows, size):
        part = b.slice(lo, size)
        yield part.column(0).to_pylist(), part.column(1).to_pylist()


# --- attribution of tokens to sections ---------------------------------------

#: Where a token that crosses a section boundary counts.
RULES = ("first", "last", "largest")


def token_spans(text: str, ranks_path: str, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """Character spans of the tokens of a text, encoded once. A token that
    holds a part of a character spans that character."""
    lengths = load_ranks(ranks_path, pattern)[2]
    ids = encode_text(text, ranks_path, pattern)
    stop = np.cumsum(lengths[ids]) if len(ids) else np.zeros(0, np.int64)
    start = stop - lengths[ids] if len(ids) else stop
    if len(text) == (len(stop) and stop[-1]):  # ASCII
        return start, stop
    raw = np.frombuffer(text.encode(), np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1  # the character that each byte belongs to
    return char[start], char[stop - 1] + 1


def attribute(start: np.ndarray, stop: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens for each section [bounds[k], bounds[k+1]), and how many cross a
    boundary. bounds ascend from 0 to the text's length."""
    n = len(bounds) - 1
    first = np.searchsorted(bounds, start, "right") - 1
    last = np.searchsorted(bounds, stop - 1, "right") - 1
    crossing = first != last
    to = last.copy() if rule == "last" else first.copy()
    if rule == "largest":
        for t in np.flatnonzero(crossing):
            k = np.arange(first[t], last[t] + 1)
            share = np.minimum(stop[t], bounds[k + 1]) - np.maximum(start[t], bounds[k])
            to[t] = k[np.argmax(share)]  # ties: the earlier section
    return np.bincount(to, minlength=n)[:n], int(crossing.sum())


def line_bounds(text: str) -> np.ndarray:
    """Sections are lines with their newline; a text without characters has none."""
    if not text:
        return np.zeros(1, np.int64)
    cuts = [m.end() for m in re.finditer("\n", text)]
    if not cuts or cuts[-1] != len(text):
        cuts.append(len(text))
    return np.array([0, *cuts], np.int64)


def _sections(batches, ranks_path: str, pattern: str, rule: str, whole: bool):
    for b in batches:
        for ids, texts in slices(b, 256):
            out: dict[str, list] = {k: [] for k in ("doc_id", "n_tokens", "n_sections", "n_crossing", "section_tokens")}
            flat: dict[str, list] = {k: [] for k in ("doc_id", "section", "start", "end", "n_tokens")}
            for d, text in zip(ids, texts, strict=True):
                start, stop = token_spans(text, ranks_path, pattern)
                bounds = line_bounds(text)
                counts, crossing = attribute(start, stop, bounds, rule)
                if whole:
                    for k, v in (("doc_id", d), ("n_tokens", len(start)), ("n_sections", len(counts)), ("n_crossing", crossing), ("section_tokens", ",".join(map(str, counts.tolist())))):
                        out[k].append(v)
                else:
                    n = len(counts)
                    for k, v in (("doc_id", [d] * n), ("section", range(n)), ("start", bounds[:-1].tolist()), ("end", bounds[1:].tolist()), ("n_tokens", counts.tolist())):
                        flat[k].extend(v)
            if whole:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield batch_of(pa.schema(list(zip(out, kinds, strict=True))), out)
            else:
                yield batch_of(pa.schema([(k, pa.int64()) for k in flat]), flat)


def section_tokens(docs: DataFrame, ranks_path: str, pattern: str, rule: str = "first", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, section, start, end, n_tokens): a row for each line of each
    text. Each document is encoded once, whole; the token spans are joined to
    the line intervals; a token over a boundary counts where `rule` says.

    Null and empty texts have no sections and no rows; a line may have no
    tokens of its own; repeated rows give repeated rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    fn = functools.partial(_sections, ranks_path=ranks_path, pattern=pattern, rule=rule, whole=False)
    return pick(docs, id_col, text_col).mapInArrow(fn, "doc_id long, section long, start long, end long, n_tokens long")


def token_counts(docs: DataFrame, ranks_path: str, pattern: str, rule: str = "first", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """section_tokens with one row a document: (doc_id, n_tokens, n_sections,
    n_crossing, section_tokens as comma-joined counts). Null and empty: zeros."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    fn = functools.partial(_sections, ranks_path=ranks_path, pattern=pattern, rule=rule, whole=True)
    return pick(docs, id_col, text_col).mapInArrow(fn, "doc_id long, n_tokens long, n_sections long, n_crossing long, section_tokens string").withColumn("section_tokens", F.coalesce("section_tokens", F.lit("")))

"""Offset-preserving search for personal data.

Plain identifiers are found in the text as it stands. Then transducers
normalise disguises - look-alike characters, spelled digits, "at" and "dot" -
each output character remembering the source span it came from; the same
patterns run over the normalised text, and what they find beyond the plain
matches is mapped back to source characters.
"""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft.llm.common import batch_of, numbered, pick, place
from graphweft.llm.tokens import slices

KINDS = ("email", "ip", "card", "phone")

# Written so that each takes time in proportion to the text: an address is
# looked for around each "@"; a run of digits is entered at its start only.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if k % 2:
            v = 2 * v - 9 * (v > 4)
        total += v
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind that pass its test."""
    out, after, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > after and LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append(("email", start, after := m.end()))
        at = text.find("@", at + 1)
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            out.append(("phone", *m.span()))
    return out


# --- transducers --------------------------------------------------------------

#: Letters of other scripts that look like Latin ones; the rest follows from
#: Unicode's own compatibility forms and digit values.
LOOKS = dict(zip("АВЕЅІЈКМНОРСТУХаеосрхуіјѕһԁӏΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲ", "ABESIJKMHOPCTYXaeocpxyijshdlABEZHIKMNOPTYXovc", strict=True))
HIDDEN = frozenset("­​‌‍⁠﻿")
DASHES = frozenset("‐‑‒–—−")
ASCII = re.compile(r"[\x00-\x7f]*")
#: Characters that any transducer of characters changes are outside Latin letters.
CHANGED = re.compile(r"[^\x00-\x7f¡-©«-±´-¸»-ɏ]")

#: Digit words in four languages.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_ONE = "(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + ")"
#: At least four digits in a row, spelled or not, of which two are spelled.
SPELLED = re.compile(rf"(?<!\w)(?:(plus)[\x20-])?(?:{_ONE}|[0-9])(?:[\x20-](?:dot[\x20-])?(?:{_ONE}|[0-9])(?!\w)){{3,}}", re.I)
WORDS_IN = re.compile(rf"(?P<digit>{_ONE}|[0-9])(?!\w)|(?P<plus>plus)|(?P<dot>\x20?dot\x20?)|(?P<gap>[\x20-])", re.I)
#: A cheap sign that SPELLED may match.
SPELLED_SIGN = re.compile(rf"(?<!\w){_ONE}[\x20-](?:dot[\x20-])?(?:{_ONE}|[0-9])(?!\w)", re.I)

_OPEN, _SHUT = r"\x20?[\[({<]\x20?", r"\x20?[\])}>]\x20?"
#: What may stand for the sign between name and host; names are read backward from it.
AT = re.compile(rf"{_OPEN}(?:at|@|arroba){_SHUT}|\x20(?:at|arroba)\x20|\x20?@\x20?", re.I)
#: The host behind it. A part is taken whole, so no text is read twice.
HOST = re.compile(
    rf"[A-Za-z0-9-]++(?:(?:{_OPEN}(?:dot|punkt|point|punto|\.){_SHUT}|\x20(?:dot|punkt|point|punto)\x20|\x20?\.\x20?(?=[a-z0-9])|\.)[A-Za-z0-9-]++)+",
    re.I,
)
DOT = re.compile(rf"{_OPEN}(?:dot|punkt|point|punto|\.){_SHUT}|\x20(?:dot|punkt|point|punto)\x20|\x20?\.\x20?", re.I)
#: A cheap sign that at_and_dot may find a disguise: each way to write one that it knows.
AT_SIGN = re.compile(
    rf"{_OPEN}(?:at|@|arroba){_SHUT}|\x20(?:dot|punkt|point|punto)\x20|{_OPEN}(?:dot|punkt|point|punto|\.){_SHUT}"
    r"|\x20@|@\x20|@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+(?:\x20\.|\.\x20)",
    re.I,
)
#: Endings that make a bare "at ... dot", or dots as they are, an address.
ENDINGS = frozenset("com org net edu gov mil int info biz io co ai app dev me tv de fr es uk eu us ca ch at be nl it pt ru pl cz se no dk fi jp cn in br mx ar au nz example test invalid".split())


class Mapped:
    """A text under change, with the source span of each of its characters."""

    def __init__(self, text: str):
        self.text, self.start, self.stop = text, range(len(text)), range(1, len(text) + 1)

    def edit(self, changes: list[tuple[int, int, str]]) -> None:
        """Replace spans, in order. Each new character stands for the whole span."""
        if not changes:
            return
        text, start, stop, at = [], [], [], 0
        for a, b, new in changes:
            text.append(self.text[at:a])
            start.extend(self.start[at:a])
            stop.extend(self.stop[at:a])
            text.append(new)
            if new:
                start.extend([self.start[a]] * len(new))
                stop.extend([self.stop[b - 1]] * len(new))
            at = b
        text.append(self.text[at:])
        start.extend(self.start[at:])
        stop.extend(self.stop[at:])
        self.text, self.start, self.stop = "".join(text), start, stop

    def source(self, a: int, b: int) -> tuple[int, int]:
        return self.start[a], self.stop[b - 1]


@functools.lru_cache(maxsize=65536)
def plain(c: str) -> str:
    """What a character looks like, in ASCII; itself where there is no such."""
    if c in LOOKS:
        return LOOKS[c]
    if c in HIDDEN:
        return ""
    if c in DASHES:
        return "-"
    if (d := unicodedata.decimal(c, None)) is not None:
        return str(int(d))
    form = unicodedata.normalize("NFKC", c)
    return form if form.isascii() and form.isprintable() else c


def look_alikes(m: Mapped) -> None:
    m.edit([(x.start(), x.end(), new) for x in CHANGED.finditer(m.text) if (new := plain(x.group())) != x.group()])


def spelled_digits(m: Mapped) -> None:
    changes = []
    for run in SPELLED.finditer(m.text):
        parts = [(x.lastgroup, *x.span()) for x in WORDS_IN.finditer(m.text, *run.span())]
        if sum(b - a > 1 for kind, a, b in parts if kind == "digit") < 2:
            continue
        for kind, a, b in parts:
            new = {"plus": "+", "dot": ".", "gap": ""}.get(kind, "")
            if kind == "digit":
                new = DIGIT_WORDS.get(m.text[a:b].lower(), m.text[a:b])
            changes.append((a, b, new))
    m.edit(changes)


def at_and_dot(m: Mapped) -> None:
    changes, text, after, x = [], m.text, 0, AT.search(m.text)
    while x:
        start = x.start()
        while start > after and LOCAL.match(text, start - 1):
            start -= 1
        host = HOST.match(text, x.end()) if start < x.start() else None
        if not host:
            x = AT.search(text, x.start() + 1)
            continue
        at, end = x.group(), host.end()
        dots = [(d.start(), d.end()) for d in DOT.finditer(text, *host.span())]
        bracketed, bare = re.search(r"[\[({<]", at), not re.search(r"[\[({<@]", at)

        def ends(a: int, b: int, dot: str, bracketed=bracketed) -> bool:
            """Whether the label after a dot may end an address of plain dots."""
            label = m.text[a:b]
            return label.lower() in ENDINGS or bool(bracketed) and dot == "." and b - a > 1 and label.isascii() and label.isalpha()

        edges = [*dots, (end, end)]
        for k in range(1, len(dots)):  # ". " after an ending ends a sentence, unless a small ending follows
            (p, q), (a, b), c = edges[k - 1], edges[k], edges[k + 1][0]
            if m.text[a:b] == ". " and ends(q, a, m.text[p:q]) and not (m.text[b:c].islower() and m.text[b:c] in ENDINGS):
                dots, end = dots[:k], a
                break
        disguised = at != "@" or any(m.text[a:b] != "." for a, b in dots)
        spelled = any(m.text[a:b].strip(" .") for a, b in dots)
        if disguised and not (bare and not spelled) and (not bare and spelled or ends(dots[-1][1], end, m.text[slice(*dots[-1])])):
            changes.append((*x.span(), "@"))
            changes += [(a, b, ".") for a, b in dots]
        after, x = end, AT.search(text, end)
    m.edit(changes)


def find_spans(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) by kind in the order of KINDS, then start."""
    found = {s: True for s in base_spans(text)}
    look, spell, at = CHANGED.search(text), SPELLED_SIGN.search(text), AT_SIGN.search(text)
    if look or spell or at:
        m = Mapped(text)
        if look:
            look_alikes(m)
        if spell or look:
            spelled_digits(m)
        if at or look:
            at_and_dot(m)
        if m.text != text:
            for kind, a, b in base_spans(m.text):
                s, e = m.source(a, b)
                if not any(k == kind and x <= s and e <= y for k, x, y in found):
                    found[(kind, s, e)] = False
    return sorted(((*s, base) for s, base in found.items()), key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def redacted(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
    """Each span, overlapping ones as one, replaced by its first kind's name."""
    out, at = [], 0
    merged: list[list] = []
    for kind, s, e, _ in sorted(spans, key=lambda x: (x[1], -x[2], KINDS.index(x[0]))):
        if merged and s < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], e)
        else:
            merged.append([kind, s, e])
    for kind, s, e in merged:
        out += [text[at:s], f"[{kind.upper()}]"]
        at = e
    return "".join([*out, text[at:]])


SPANS = "array<struct<kind:string,start:long,end:long,base:boolean>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def _find(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("spans", _SPANS), ("redacted", pa.string())])
    for b in batches:
        for ids, texts in slices(b):
            found = [find_spans(t) for t in texts]
            yield batch_of(schema, {"doc_id": ids, "spans": [[dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in ss] for ss in found], "redacted": [redacted(t, ss) if ss else t for t, ss in zip(texts, found, strict=True)]})


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans, redacted text). Spans are in source characters, end
    exclusive; `base` marks plain matches.

    Null and empty texts have no spans and an empty redacted text; every row
    gets a row; texts of any length are searched whole.
    """
    return pick(docs, id_col, text_col).mapInArrow(_find, f"doc_id long, spans {SPANS}, redacted string")


def _redact(batches, k: int):
    for b in batches:
        column = b.column(k)
        new = pa.array([t and (redacted(t, s) if (s := find_spans(t)) else t) for t in column.to_pylist()], column.type)
        yield pa.RecordBatch.from_arrays([new if i == k else c for i, c in enumerate(b.columns)], schema=b.schema)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with personal data in text_col replaced by [KIND]; other columns,
    whatever their names, and null texts stay as they are."""
    own = numbered(docs)
    return own.mapInArrow(functools.partial(_redact, k=place(docs, text_col)), own.schema).toDF(*docs.columns)


def _digest(batches):
    kinds = [("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())]
    for b in batches:
        for ids, texts in slices(b, 512):
            out: dict[str, list] = {k: [] for k, _ in kinds}
            for d, text in zip(ids, texts, strict=True):
                spans = find_spans(text)
                base = [s for s in spans if s[3]]
                out["doc_id"].append(d)
                for k in KINDS:
                    out[f"n_{k}"].append(sum(s[0] == k for s in base))
                out["base_sha256"].append(hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e, _ in base).encode()).hexdigest())
                out["spans"].append(",".join(f"{k}:{s}:{e}" for k, s, e, _ in spans))
                out["n_added"].append(len(spans) - len(base))
            yield batch_of(pa.schema(kinds), out)


def pii_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """find_pii in the digest columns of its query; the counts are of base spans."""
    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long"
    return pick(docs, id_col, text_col).mapInArrow(_digest, schema).withColumn("spans", F.coalesce("spans", F.lit("")))

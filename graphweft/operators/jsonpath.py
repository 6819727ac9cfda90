"""Paths into JSON documents, in Catalyst over variants. set_value and
delete_value are the rules for one document, such as a manifest on the driver."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweft.storage import path_of, stored

APPEND = object()
#: Keys that a path must not set.
FORBIDDEN = ("__proto__", "constructor", "prototype")


class PathError(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def parse(path: str) -> list:
    """Steps of `a.b`, `a[key.with.dots]`, `a[0]` and, to set only, `a[]`."""
    if not path:
        raise PathError("EEMPTYPATH", "an empty path")
    steps: list = []
    for m in re.finditer(r"\[([^\]]*)\]|([^.\[\]]+)|(\.)|(.)", path):
        if m[4]:
            raise PathError("EINVALIDSYNTAX", f"can't read {path!r}")
        if m[3]:
            continue
        key = m[1] if m[1] is not None else m[2]
        if m[1] == "":
            steps.append(APPEND)
        elif m[1] is not None and re.fullmatch(r"[0-9]+", key):
            steps.append(int(key))
        else:
            steps.append(key)
    if any(s is APPEND for s in steps[:-1]):
        raise PathError("ENOAPPEND", "only a path's end can append")
    return steps


def _quoted(key: str) -> str:
    return "$['" + key.replace("'", "\\'") + "']"


def get(document: Column, path: str, unwrap: bool = True) -> Column:
    """Map of path, as it is given, to variant. A key that meets an array fans
    out to each element and stops there: `keys[i].key`, where keys are those
    before it, one after another. With unwrap, an array of one element stands
    for the element and an empty one for nothing. Nothing found: an empty map."""
    none = F.create_map().cast("map<string,variant>")

    def held(prefix: str, value: Column) -> Column:
        if unwrap:
            items = F.try_variant_get(value, "$", "array<variant>")
            value = F.when(F.size(items) <= 1, F.try_element_at(items, F.lit(1))).otherwise(value)
        return F.when(value.isNotNull(), F.create_map(F.lit(prefix), value)).otherwise(none)

    def build(value: Column, steps: list, prefix: str) -> Column:
        if not steps:
            return held(path, value)
        first, rest = steps[0], steps[1:]
        if first is APPEND:
            raise PathError("EINVALIDSYNTAX", "an empty index only sets")
        if isinstance(first, int):
            return build(F.try_variant_get(value, f"$[{first}]", "variant"), rest, f"{prefix}{first}")
        here = prefix + first
        items = F.try_variant_get(value, "$", "array<variant>")
        pairs = F.transform(items, lambda v, i: F.struct(F.concat(F.lit(prefix + "["), i.cast("string"), F.lit(f"].{first}")).alias("k"), F.try_variant_get(v, _quoted(first), "variant").alias("v")))
        fanned = F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))
        return F.when(items.isNotNull(), fanned).otherwise(build(F.try_variant_get(value, _quoted(first), "variant"), rest, here))

    return build(document, parse(path), "")


def get_many(document: Column, paths: list[str]) -> Column:
    """The maps of several paths as one; the last wins."""
    out = F.create_map().cast("map<string,variant>")
    for p in paths:
        new = get(document, p)
        out = F.map_concat(_without(out, new), new)
    return out


def _without(old: Column, new: Column) -> Column:
    return F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k))


def set_value(document, path: str, value, force: bool = False):
    """The document with value at path; containers are made on the way."""
    steps = parse(path)
    if any(s in FORBIDDEN for s in steps if isinstance(s, str)):
        raise PathError("EFORBIDDENKEY", f"{path!r} names a forbidden key")

    def put(at, steps):
        if not steps:
            return value
        first, rest = steps[0], steps[1:]
        listed = first is APPEND or isinstance(first, int)
        if at is None:
            at = [] if listed else {}
        elif not isinstance(at, list if listed else dict):
            if isinstance(at, (list, dict)):
                if not (isinstance(at, dict) and isinstance(first, int)):
                    if not force:
                        raise PathError("ENOAPPEND" if first is APPEND else "ENOADDPROP", f"can't set {first!r} there")
                    at = [] if listed else {}
                else:
                    first = str(first)
            else:
                if not force:
                    raise PathError("EOVERRIDEVALUE", f"{path!r} would take a value's place")
                at = [] if listed else {}
        if isinstance(at, list):
            at = list(at)
            k = len(at) if first is APPEND else first
            at += [None] * (k + 1 - len(at))
            at[k] = put(at[k], rest)
            return at
        return {**at, first: put(at.get(first), rest)}

    return put(document, steps)


def delete_value(document, path: str):
    """The document without what is at path; array elements close up."""
    steps = parse(path)

    def cut(at, steps):
        first, rest = steps[0], steps[1:]
        inside = (isinstance(at, list) and isinstance(first, int) and first < len(at)) or (isinstance(at, dict) and first in at)
        if not inside:
            return at
        if isinstance(at, list):
            return at[:first] + at[first + 1 :] if not rest else [*at[:first], cut(at[first], rest), *at[first + 1 :]]
        if not rest:
            return {k: v for k, v in at.items() if k != first}
        return {**at, first: cut(at[first], rest)}

    return cut(document, steps)


def _bound(value: Column, then) -> Column:
    """then(value), where value is worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


_MAP, _LIST = "map<string,variant>", "array<variant>"
_NULL = "null"


def set_variant(document: Column, path: str, value: Column, force: bool = False) -> Column:
    """set_value over a column of variants, in Catalyst; value is a variant.
    What can't be set fails the query with the code; keys come out sorted."""
    steps = parse(path)
    if any(s in FORBIDDEN for s in steps if isinstance(s, str)):
        raise PathError("EFORBIDDENKEY", f"{path!r} names a forbidden key")
    fail = lambda code: F.raise_error(F.lit(f"{code}: {path}")).cast("variant")
    null = F.parse_json(F.lit(_NULL))

    def put(at: Column, steps: list) -> Column:
        if not steps:
            return value
        first, rest = steps[0], steps[1:]

        def into_object(m: Column, key: str) -> Column:
            own = F.try_element_at(m, F.lit(key))
            return F.to_variant_object(F.map_concat(F.map_filter(m, lambda k, _: k != key), F.create_map(F.lit(key), put(own, rest))))

        def into_list(a: Column) -> Column:
            if first is APPEND:
                return F.to_variant_object(F.concat(a, F.array(value)))
            own = F.try_element_at(a, F.lit(first + 1))
            padded = F.concat(F.slice(a, 1, first), F.array_repeat(null, F.greatest(F.lit(first) - F.size(a), F.lit(0))))
            after = F.slice(a, F.lit(first + 2), F.greatest(F.size(a) - first - 1, F.lit(0)))
            return F.to_variant_object(F.concat(padded, F.array(put(own, rest)), after))

        listed = first is APPEND or isinstance(first, int)
        no_map, no_list = F.create_map().cast(_MAP), F.array().cast(_LIST)
        new = into_list(no_list) if listed else into_object(no_map, str(first))

        def choose(v: Column) -> Column:
            m, a = F.try_variant_get(v, "$", _MAP), F.try_variant_get(v, "$", _LIST)
            if listed:
                at_object = into_object(m, str(first)) if isinstance(first, int) else new if force else fail("ENOAPPEND")
                at_list = into_list(a)
            else:
                at_object, at_list = into_object(m, first), new if force else fail("ENOADDPROP")
            empty = v.isNull() | F.coalesce(F.is_variant_null(v), F.lit(True))
            return F.when(empty, new).when(m.isNotNull(), at_object).when(a.isNotNull(), at_list).otherwise(new if force else fail("EOVERRIDEVALUE"))

        return _bound(at, choose)

    return put(document, steps)


def delete_variant(document: Column, path: str) -> Column:
    """delete_value over a column of variants, in Catalyst; keys come out sorted."""

    def cut(at: Column, steps: list) -> Column:
        first, rest = steps[0], steps[1:]
        if first is APPEND:
            return at

        def choose(v: Column) -> Column:
            m, a, key = F.try_variant_get(v, "$", _MAP), F.try_variant_get(v, "$", _LIST), str(first)
            others = F.map_filter(m, lambda k, _: k != key)
            fewer = others if not rest else F.map_concat(others, F.create_map(F.lit(key), cut(F.try_element_at(m, F.lit(key)), rest)))
            out = F.when(F.coalesce(F.map_contains_key(m, F.lit(key)), F.lit(False)) & F.lit(isinstance(first, str)), F.to_variant_object(fewer))
            if isinstance(first, int):
                kept = [] if not rest else [F.array(cut(F.try_element_at(a, F.lit(first + 1)), rest))]
                after = F.slice(a, F.lit(first + 2), F.greatest(F.size(a) - first - 1, F.lit(0)))
                out = out.when(F.size(a) > first, F.to_variant_object(F.concat(F.slice(a, 1, first), *kept, after)))
            return out.otherwise(v)

        return _bound(at, choose)

    return cut(document, parse(path))


def set_column(document: Column, path: str, value: Column, force: bool = False) -> Column:
    """set_variant over a column of JSON text."""
    return F.to_json(set_variant(F.parse_json(document), path, value, force))


def delete_column(document: Column, path: str) -> Column:
    return F.to_json(delete_variant(F.parse_json(document), path))


def field_paths(rows: DataFrame, key: str, document: str) -> DataFrame:
    """(key, path): all paths of each row's document (a variant), but those of
    fields that begin with "_" or hold a dot, and what is below them. A round
    opens the objects and lists of one depth; as many rounds as the deepest."""
    level = rows.select(F.col(key).alias("key"), F.lit("").alias("path"), F.col(document).alias("v"))
    parts = []
    while True:
        m, a = F.try_variant_get("v", "$", _MAP), F.try_variant_get("v", "$", _LIST)
        fields = F.transform(F.filter(F.map_entries(m), lambda e: ~e["key"].startswith("_") & ~e["key"].contains(".")), lambda e: F.struct(F.concat(F.when(F.col("path") == "", "").otherwise(F.concat("path", F.lit("."))), e["key"]).alias("path"), e["value"].alias("v")))
        items = F.transform(a, lambda v, k: F.struct(F.concat("path", F.lit("["), k.cast("string"), F.lit("]")).alias("path"), v.alias("v")))
        level = stored(level.select("key", F.explode(F.coalesce(fields, items)).alias("e")).select("key", "e.path", "e.v"), "paths")
        if level.isEmpty():
            break
        parts.append(path_of(level))
    if not parts:
        return level.select("key", "path")
    return rows.sparkSession.read.schema(level.schema).parquet(*parts).select("key", "path")


def assignments(args: list[str], as_json: bool = False) -> list[tuple[str, object]]:
    """(path, value) of arguments `path=value`; as_json reads values as JSON.
    An argument without = is refused."""
    out = []
    for arg in args:
        path, eq, value = arg.partition("=")
        if not eq or not path:
            raise PathError("EUSAGE", f"{arg!r} is no path=value")
        out.append((path, json.loads(value) if as_json else value))
    return out


def set_arguments(document: Column, args: list[str], as_json: bool = False, force: bool = False) -> Column:
    """A variant with all of the arguments `path=value` set, in their order."""
    for path, value in assignments(args, as_json):
        document = set_variant(document, path, F.parse_json(F.lit(json.dumps(value))), force)
    return document


def fixed(manifest: Column) -> Column:
    """A manifest (variant) as it is written after repair: names and versions
    trimmed, `v` and `=` before a version left out, a `bin` of one text under
    the package's name, dependency lists that are no objects left out."""
    m = F.try_variant_get(manifest, "$", _MAP)
    text_at = lambda k: F.trim(F.try_variant_get(manifest, f"$.{k}", "string"))
    said = lambda c: F.variant_get(F.to_variant_object(F.array(c)), "$[0]", "variant")
    is_text = lambda k: F.schema_of_variant(F.try_variant_get(manifest, f"$.{k}", "variant")) == "STRING"
    base = F.regexp_extract(text_at("name"), "([^/]+)$", 1)
    new = {"name": F.when(is_text("name"), said(text_at("name"))), "version": F.when(is_text("version"), said(F.regexp_replace(text_at("version"), r"^[v=\s]+", ""))), "bin": F.when(is_text("bin") & (base != ""), F.to_variant_object(F.create_map(base, text_at("bin"))))}
    lists = ("dependencies", "devDependencies", "optionalDependencies", "peerDependencies")
    bad = F.array_compact(F.array(*[F.when(F.map_contains_key(m, F.lit(k)) & F.try_variant_get(manifest, f"$.{k}", _MAP).isNull(), F.lit(k)) for k in lists]))
    put = F.map_filter(F.create_map(*[x for k, v in new.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())
    return F.to_variant_object(F.map_concat(F.map_filter(m, lambda k, _: ~F.array_contains(bad, k) & ~F.map_contains_key(put, k)), put))

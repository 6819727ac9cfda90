"""Small text functions: globs, specs, sizes, names and addresses."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(glob: str) -> str:
    """A file glob as a regular expression: `*` and `?` stay within a path part,
    which they don't begin with a dot for; `**` spans parts; {a,b} are choices."""
    out, k, depth, start = [], 0, 0, True
    while k < len(glob):
        c = glob[k]
        if glob.startswith("**", k) and start and (k + 2 == len(glob) or glob[k + 2] == "/"):
            if k + 2 == len(glob):
                out.append(r"(?:(?!\.)[^/]+(?:/(?!\.)[^/]+)*)?")
                k += 2
            else:
                out.append(r"(?:(?!\.)[^/]+/)*")
                k += 3
            continue
        if c == "*":
            out.append(r"(?!\.)[^/]+" if start and (k + 1 == len(glob) or glob[k + 1] == "/") else (r"(?!\.)[^/]*" if start else "[^/]*"))
        elif c == "?":
            out.append("[^/]")
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "[" and "]" in glob[k + 1 :]:
            end = glob.index("]", k + 1)
            body = glob[k + 1 : end]
            out.append("[" + ("^" + body[1:] if body[:1] in "!^" else body) + "]")
            k = end
        else:
            out.append(re.escape(c))
        start = c == "/"
        k += 1
    return "^" + "".join(out) + "$"


def resolve_path(base: str, path: str) -> str:
    """path against base, with "." and ".." taken out."""
    parts: list[str] = [] if path.startswith("/") else [p for p in base.split("/") if p]
    for p in path.split("/"):
        if p == "..":
            parts = parts[:-1]
        elif p not in ("", "."):
            parts.append(p)
    return "/" + "/".join(parts)


_RANGE = r"^[\s]*(\*|x|X|([<>=~^]*\s*v?[0-9xX*]+(\.[0-9xX*]+)*(-[0-9A-Za-z.-]+)?(\+[0-9A-Za-z.-]+)?)((\s*\|\|\s*|\s+-\s+|\s+)[<>=~^]*\s*v?[0-9xX*]+(\.[0-9xX*]+)*(-[0-9A-Za-z.-]+)?)*)?[\s]*$"
_EXACT = r"^[\s]*[v=\s]*[0-9]+\.[0-9]+\.[0-9]+(-[0-9A-Za-z.-]+)?(\+[0-9A-Za-z.-]+)?[\s]*$"


def spec_type(spec: Column) -> Column:
    """What a requirement names: alias, git, remote, file, directory, version, range or tag."""
    return (
        F.when(spec.startswith("npm:"), "alias")
        .when(spec.rlike(r"^(git(\+[a-z]+)?:|github:|gitlab:|bitbucket:|gist:)|^[^@:/\s.~][^:@/\s]*/[^:@/\s]+(#.*)?$|\.git(#.*)?$"), "git")
        .when(spec.rlike(r"^https?:"), "remote")
        .when(spec.rlike(r"^(file:|\.{1,2}/|/|~/).*\.(tgz|tar\.gz|tar)$"), "file")
        .when(spec.rlike(r"^(file:|link:|workspace:|\.{1,2}/|/|~/)"), "directory")
        .when(spec.rlike(_EXACT), "version")
        .when(spec.rlike(_RANGE) | (spec == ""), "range")
        .otherwise("tag")
    )


def is_registry(kind: Column) -> Column:
    return kind.isin("tag", "version", "range", "alias")


def legacy_spec(version: Column, asked: Column, integrity: Column, resolved: Column) -> Column:
    """The requirement that an entry of an old lock stands for. The version, if
    the entry has an integrity or it names a repository; else what was asked
    for (`asked`), where nothing is resolved, and its version if that was a
    registry's; else the resolved address. Empty counts as null. What was asked
    for, if no valid tag, leaves the version; a version that is none gives null."""
    has = lambda c: F.coalesce(c != "", F.lit(False))
    bad = lambda c: (spec_type(c) == "tag") & ~c.rlike(r"^[A-Za-z0-9_.!~*'()-]+$")
    own = F.when(has(version), version)
    return (
        F.when(has(version) & bad(version), F.lit(None))
        .when(has(version) & (has(integrity) | (spec_type(version) == "git")), version)
        .when(has(asked) & (bad(asked) | (is_registry(spec_type(asked)) & has(version))), own)
        .when(has(asked) & ~has(resolved), asked)
        .when(has(resolved), resolved)
        .otherwise(own)
    )


def json_digest(document: Column) -> Column:
    """`sha512-` and the base64 digest of a JSON text with sorted keys and
    without blanks: texts that differ in order or white space have one digest.
    Keys sort by their UTF-8 bytes; what is no JSON gives null."""
    plain = F.to_json(F.try_parse_json(document))
    return F.concat(F.lit("sha512-"), F.regexp_replace(F.base64(F.unhex(F.sha2(plain, 512))), r"\s", ""))


def format_bytes(n: Column, space: bool = True) -> Column:
    """Sizes in steps of 1000 with one decimal; whole bytes below."""
    gap = " " if space else ""
    at = lambda size, unit: F.concat(F.regexp_replace(F.format_number(F.floor(n / size * 10 + 0.5) / 10, 1), ",", ""), F.lit(gap + unit))
    return F.when(n < 1000, F.concat(n.cast("string"), F.lit(gap + "B"))).when(n < 1_000_000, at(1e3, "kB")).when(n < 1_000_000_000, at(1e6, "MB")).otherwise(at(1e9, "GB"))


def valid_web_address(url: Column) -> Column:
    """An http or https address with a host."""
    host = F.try_parse_url(url, F.lit("HOST"))
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https") & (F.length(host) > 0), F.lit(False))


def person(name: Column, email: Column, url: Column) -> Column:
    """`name <email> (url)` with what there is."""
    return F.concat_ws("", name, F.when(email != "", F.concat(F.lit(" <"), email, F.lit(">"))), F.when(url != "", F.concat(F.lit(" ("), url, F.lit(")"))))


def purl(name: Column, version: Column) -> Column:
    return F.concat(F.lit("pkg:npm/"), F.regexp_replace(name, "^@", "%40"), F.lit("@"), version)


def spdx_id(name: Column, version: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(name, "@", ""), "/", ".")
    return F.concat_ws("-", F.lit("SPDXRef-Package"), clean, F.when(version != "", version))


def hex_digest(sri: Column) -> Column:
    """The digest of `algorithm-base64` in hexadecimal."""
    return F.lower(F.hex(F.unbase64(F.regexp_extract(sri, "^[a-z0-9]+-([A-Za-z0-9+/=]+)", 1))))


def name_key(name: Column) -> Column:
    """Names compare without case; compatibility forms are left as they are."""
    return F.lower(name)


def tarball_name(url: Column) -> Column:
    """Package name of a registry tarball address, scope included."""
    return F.regexp_extract(url, r"/((?:@[^/]+/)?[^/]+)/-/[^/]+\.tgz$", 1)


def tarball_version(url: Column) -> Column:
    return F.regexp_extract(url, r"/-/[^/]*?-([0-9]+\.[0-9]+\.[0-9]+(?:-[0-9A-Za-z.-]+)?(?:\+[0-9A-Za-z.-]+)?)\.tgz$", 1)


# --- paths and addresses -----------------------------------------------------------


def _segments(path: Column) -> Column:
    """A path's names, `.` left out and `..` followed."""
    step = lambda acc, x: F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(F.filter(F.split(path, "/"), lambda x: ~x.isin("", ".")), F.array().cast("array<string>"), step)


def absolute_path(base: Column, path: Column) -> Column:
    """path as seen from the folder base."""
    return F.concat(F.lit("/"), F.array_join(_segments(F.when(path.startswith("/"), path).otherwise(F.concat(base, F.lit("/"), path))), "/"))


def relative_path(base: Column, path: Column) -> Column:
    """The way from the folder base to path, both absolute."""
    a, b = _segments(base), _segments(path)
    shared = F.size(F.filter(F.sequence(F.lit(0), F.least(F.size(a), F.size(b))), lambda k: (k > 0) & (F.slice(a, F.lit(1), k) == F.slice(b, F.lit(1), k))))
    return F.array_join(F.concat(F.array_repeat(F.lit(".."), F.size(a) - shared), F.slice(b, shared + 1, F.size(b))), "/")


#: Hosts with short names for their repositories.
HOSTS = {"github": "github.com", "gitlab": "gitlab.com", "bitbucket": "bitbucket.org"}
_OWNED = r"([^/:#@\s]+)/([^/:#\s]+?)(?:\.git)?(#.*)?$"


def consistent_resolve(resolved: Column, base: Column, to: Column | None = None) -> Column:
    """One form for each address that a lock may record. Files become `file:`
    and an absolute path, or the way from `to`; a repository of a known host
    git+https where it is asked for by https, else git+ssh, with its commit;
    name@spec the spec, unless that is *. Other addresses, of git servers,
    archives and registries, stay as they are; nothing stays nothing."""
    path = F.regexp_replace(resolved, "^file:(//)?", "")
    full = absolute_path(base, path)
    file = F.concat(F.lit("file:"), full if to is None else relative_path(to, full))
    out = F.when(resolved.isNull() | (resolved == ""), None).when(resolved.rlike(r"^(file:|\.{1,2}(/|$)|/)"), file)
    for short, host in HOSTS.items():
        dotted = host.replace(".", r"\.")
        https = rf"^(?:git\+)?https://((?:[^/@\s]+@)?{dotted})/{_OWNED}"
        ssh = rf"^(?:(?:git\+)?(?:ssh|git)://(?:[^/@\s]+@)?{dotted}[/:]|(?:[^/@\s]+@){dotted}:|{short}:){_OWNED}"
        out = out.when(resolved.rlike(https), F.regexp_replace(resolved, https, "git+https://$1/$2/$3.git$4"))
        out = out.when(resolved.rlike(ssh), F.regexp_replace(resolved, ssh, f"git+ssh://git@{host}/$1/$2.git$3"))
    bare = rf"^(?![@.~]){_OWNED}"
    named = r"^((?:@[^/@\s]+/)?[^@/:\s]+)@([^*\s].*)$"
    out = out.when(resolved.rlike(bare), F.regexp_replace(resolved, bare, "git+ssh://git@github.com/$1/$2.git$3"))
    return out.when(resolved.rlike(named), F.regexp_extract(resolved, named, 2)).otherwise(resolved)

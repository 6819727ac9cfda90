"""The selector fixture as data: a small project with workspaces, an alias, a
bundle, an override, a cycle, an invalid and a missing dependency."""

import json
from datetime import datetime, timedelta

from graphweft.operators import graph as G

NOW = datetime(2024, 5, 10, 12)
YESTERDAY, BEFORE = NOW - timedelta(days=1), NOW - timedelta(days=2)
AT = "/work/project"

PACKAGES = {
    "": {"name": "query-selector-all-tests", "version": "1.0.0", "bundleDependencies": ["abbrev"], "workspaces": ["a", "b", "c"]},
    "a": {"name": "a", "version": "1.0.0"},
    "b": {"name": "b", "version": "1.0.0", "private": True},
    "c": {"name": "c", "version": "1.0.0"},
    "node_modules/@npmcli/abbrev": {"name": "@npmcli/abbrev", "version": "2.0.0-beta.45"},
    "node_modules/abbrev": {"name": "abbrev", "version": "1.1.1", "license": "ISC", "engines": {"node": "^16.0.0"}},
    "node_modules/bar": {
        "name": "bar", "version": "2.0.0", "engines": {"node": ">= 14.0.0"},
        "arbitrary": {"foo": [False, "foo", "bar", {"funding": {"type": "GH"}}, {"funding": {"type": "MS"}}, 10000, 13000, 15000], "bar": "bar", "baz": ["a", "b", "c"]},
    },
    "node_modules/baz": {"name": "baz", "version": "1.0.0", "license": ["ISC", "Something"], "scripts": {"test": "tap"}, "engines": {"node": "nope"}},
    "node_modules/dash-separated-pkg": {"name": "dash-separated-pkg", "version": "1.0.0", "description": "One of the best libraries every dev should know about."},
    "node_modules/dasher": {"name": "dasher", "version": "2.0.0", "description": "The best library ever."},
    "node_modules/foo": {"name": "foo", "version": "2.2.2", "arbitrary": "foo key"},
    "node_modules/foo/node_modules/bar": {"name": "bar", "version": "1.4.0"},
    "node_modules/ipsum": {"name": "sit", "version": "1.0.0", "keywords": ["lorem", "ipsum", "dolor"]},
    "node_modules/lorem": {"name": "lorem", "version": "1.0.0", "keywords": ["lorem", "ipsum", "sit", "amet"], "funding": [{"type": "GitHub", "url": "https://github.com/sponsors"}]},
    "node_modules/moo": {"name": "moo", "version": "3.0.0"},
    "node_modules/recur": {"name": "recur", "version": "1.0.0"},
    "node_modules/sive": {"name": "sive", "version": "1.0.0"},
}
LINKS = {"node_modules/a": "a", "node_modules/b": "b", "node_modules/c": "c"}
N = "node_modules/"
EDGES = [
    ("", "a", N + "a", "workspace", "file:a"), ("", "b", N + "b", "workspace", "file:b"), ("", "c", N + "c", "workspace", "file:c"),
    ("", "abbrev", N + "abbrev", "prod", "^1.1.1"), ("", "bar", N + "bar", "prod", "^2.0.0"), ("", "ipsum", N + "ipsum", "prod", "npm:sit@1.0.0"),
    ("", "foo", N + "foo", "dev", "^2.0.0"), ("", "moo", N + "moo", "dev", "^3.0.0"), ("", "recur", N + "recur", "dev", "1.0.0"),
    ("a", "baz", N + "baz", "optional", "^1.0.0"), ("b", "a", N + "a", "dev", "^1.0.0"), ("b", "bar", N + "bar", "prod", "^2.0.0"), ("c", "b", N + "b", "prod", "^1.0.0"),
    (N + "bar", "moo", N + "moo", "prod", "3.0.0"), (N + "baz", "lorem", N + "lorem", "prod", "latest"),
    (N + "foo", "bar", N + "foo/node_modules/bar", "prod", "^1.0.0"), (N + "foo", "dash-separated-pkg", N + "dash-separated-pkg", "prod", "^1.0.0"),
    (N + "foo/node_modules/bar", "dasher", N + "dasher", "peer", "2.0.0"), (N + "ipsum", "missing-dep", None, "prod", "^1.0.0"),
    (N + "recur", "sive", N + "sive", "prod", "1.0.0"), (N + "sive", "recur", N + "recur", "prod", "1.0.0"),
]
VERSIONS = [
    ("a", "1.0.0", NOW), ("abbrev", "1.1.1", BEFORE), ("abbrev", "1.2.0", YESTERDAY), ("b", "1.0.0", NOW), ("bar", "1.4.0", BEFORE), ("bar", "2.0.0", NOW),
    ("baz", "1.0.0", None), ("baz", "1.0.1", YESTERDAY), ("c", "1.0.0", NOW), ("dash-separated-pkg", "1.0.0", BEFORE), ("dash-separated-pkg", "2.0.0", YESTERDAY),
    ("dasher", "2.0.0", NOW), ("foo", "2.2.2", NOW), ("lorem", "1.0.0", NOW), ("moo", "3.0.0", NOW), ("recur", "1.0.0", NOW), ("sive", "1.0.0", NOW),
]
ADVISORIES = [("foo", "test-vuln", "high", [], "*"), ("sive", "test-vuln", "low", ["CWE-123"], "*"), ("moo", "test-vuln", None, [], "<1.0.0")]


def build(spark):
    rows = []
    for at, package in PACKAGES.items():
        name = at.rpartition("node_modules/")[2] or package["name"]
        rows.append((at, name, package["name"], package["version"], f"{AT}/{at}".rstrip("/"), json.dumps(package), False, None, "" if at in ("a", "b", "c") else None, at == "", at in ("a", "b", "c"), at == N + "abbrev", at == N + "dasher"))
    for at, target in LINKS.items():
        p = PACKAGES[target]
        rows.append((at, p["name"], p["name"], p["version"], f"{AT}/{target}", json.dumps(p), True, target, None, False, True, False, False))
    schema = "location string, name string, package_name string, version string, realpath string, package string, is_link boolean, target_location string, resolve_parent string, is_root boolean, is_workspace boolean, in_bundle boolean, overridden boolean"
    nodes = spark.createDataFrame(rows, schema)
    edges = spark.createDataFrame([(*e, "MISSING" if e[2] is None else "INVALID" if e[4] == "latest" else None) for e in EDGES], "src string, name string, dst string, type string, spec string, error string")
    flags = G.dependency_flags(nodes, edges)
    nodes = G.complete(nodes.join(flags, "location")).persist()
    return G.Graph(
        nodes, edges, "", AT,
        versions=spark.createDataFrame(VERSIONS, "name string, version string, published_at timestamp"),
        advisories=spark.createDataFrame(ADVISORIES, "name string, id string, severity string, cwe array<string>, vulnerable_versions string"),
    )

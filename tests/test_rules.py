"""Manifest extensions, differences and filter sets, addresses and inert nodes on small trees."""

import json

import pytest
from pyspark.sql import functions as F

from graphweft.functions import text
from graphweft.operators import diffs, extensions, graph, jsonpath, reports, resolve
from graphweft.operators.graph import Graph, complete
from graphweft.sources import lockfile


@pytest.mark.parametrize(
    ("raw", "code"),
    [
        ([], "EEXTENSIONROOT"), ({"a@latest": {}}, "EEXTENSIONSELECTOR"), ({"a@": {}}, "EEXTENSIONSELECTOR"), ({"": {}}, "EEXTENSIONSELECTOR"), ({"a": 1}, "EEXTENSIONVALUE"), ({"a": {"bin": {}}}, "EEXTENSIONFIELD"),
        ({"a": {"dependencies": [1]}}, "EEXTENSIONVALUE"), ({"a": {"peerDependencies": {"b": "-"}}}, "EEXTENSIONDELETE"), ({"a": {"peerDependenciesMeta": {"b": None}}}, "EEXTENSIONVALUE"),
    ],
)
def test_extension_rules_are_checked(spark, raw, code):
    with pytest.raises(extensions.ExtensionError) as e:
        extensions.extension_rules(spark, raw)
    assert e.value.code == code


@pytest.fixture(scope="module")
def packages(spark):
    meta = {"peerDependencies": {"p": "^1"}, "peerDependenciesMeta": {"p": {"optional": False, "kept": True}}}
    rows = [("", "top", "1.0.0", {}), ("a", "a", "1.0.0", {"dependencies": {"x": "1"}}), ("a2", "a", "2.0.0", {}), ("b", "@s/b", "1.0.0", meta), ("c", "c", "not-a-version", {}), ("d", "d", "1.0.0", {})]
    return complete(spark.createDataFrame([(at, at or "top", n, v, json.dumps(m), at == "") for at, n, v, m in rows], "location string, name string, package_name string, version string, package string, is_root boolean"))


def test_extensions_merge(spark, packages):
    rules = extensions.extension_rules(spark, {"a@^1": {"dependencies": {"y": "2"}, "optionalDependencies": {"z": "3"}}, "@s/b": {"peerDependencies": {"p": "^2", "q": "*"}, "peerDependenciesMeta": {"p": {"optional": True}}}, "c": {"dependencies": {"y": "1"}}, "d": {"dependencies": {"y": "1"}, "optionalDependencies": {"y": "2"}}})
    got = {r["location"]: r for r in extensions.extended(packages, rules).collect()}
    assert set(got) == {"a", "b", "c", "d"}
    assert got["a"]["dependencies"] == {"x": "1", "y": "2"} and got["a"]["optionalDependencies"] == {"z": "3"} and got["a"]["applied"] == ["dependencies.y", "optionalDependencies.z"]
    assert got["b"]["peerDependencies"] == {"p": "^2", "q": "*"} and got["b"]["peerDependenciesMeta"] == {"p": {"optional": True, "kept": True}}
    assert got["d"]["error"] == "EEXTENSIONDUPDEP: y" and got["d"]["dependencies"] == {} and got["d"]["applied"] is None


def test_extension_state_of_a_lock(spark, packages):
    rules = extensions.extension_rules(spark, {"a": {}, "a@1": {}, "@s/b@>1": {}})
    nodes = packages.withColumn("applied_selector", F.when(F.col("location") == "b", "@s/b@>1").when(F.col("location") == "c", "gone"))
    told = lambda *digests: sorted(r["error"] for r in extensions.validate_extensions(nodes, rules, *digests).collect())
    assert told("h", "h") == ["Invalid: several packageExtensions selectors match a@1.0.0: a, a@1", 'Invalid: stale packageExtensions provenance for b@1.0.0 (selector "@s/b@>1")', 'Invalid: stale packageExtensions provenance for c@not-a-version (selector "gone")']
    assert told("h", None) == ["Missing: packageExtensions state from lock file"] and told("h", "g") == ["Invalid: packageExtensions in package.json do not match the lock file"]
    assert told(None, "h") == ["Invalid: lock file records packageExtensions state but package.json has none"]


def test_diff_rule_by_rule(spark):
    kinds = "location string, version string, integrity string, resolved string, patch string, is_root boolean, in_bundle boolean, patch_removed boolean, bins_missing boolean"
    one = lambda at, version="1", integrity=None, resolved=None, patch=None, **k: (at, version, integrity, resolved, patch, at == "", k.get("bundle", False), k.get("reverted", False), k.get("bins", False))
    pairs = {
        "": (one("", "1"), one("", "2")), "gone": (one("gone"), None), "new": (None, one("new")), "bundled": (None, one("bundled", bundle=True)), "version": (one("version"), one("version", "2")), "patch": (one("patch"), one("patch", patch="p")),
        "reverted": (one("reverted"), one("reverted", reverted=True)), "plain": (one("plain"), one("plain")), "address": (one("address", resolved="r"), one("address", resolved="r")), "moved": (one("moved", resolved="r"), one("moved", resolved="s")), "located": (one("located"), one("located", resolved="r")),
        "locked": (one("locked", resolved="r"), one("locked", integrity="sha512-a", resolved="r")), "same": (one("same", integrity="sha1-b sha512-a", resolved="r"), one("same", integrity="sha512-a", resolved="s")), "bits": (one("bits", integrity="sha512-a"), one("bits", integrity="sha512-b")), "bins": (one("bins"), one("bins", bins=True)),
    }
    frame = lambda k: spark.createDataFrame([p[k] for p in pairs.values() if p[k]], kinds)
    got = {r["location"]: r["action"] for r in diffs.diff_actions(frame(0), frame(1)).collect()}
    assert got == {"gone": "REMOVE", "new": "ADD"} | dict.fromkeys(("version", "patch", "reverted", "moved", "located", "locked", "bits", "bins"), "CHANGE")
    some = spark.createDataFrame([("new",), ("bits",)], "location string")
    assert {r["location"] for r in diffs.diff_actions(frame(0), frame(1), some).collect()} == {"new", "bits"}


def test_filter_set_takes_both_trees(spark):
    nodes = complete(spark.createDataFrame([("", False, None, False), ("node_modules/w", True, "packages/w", False), ("packages/w", False, None, False), ("node_modules/a", False, None, False), ("node_modules/a/node_modules/lost", False, None, True), ("node_modules/other", False, None, True), ("node_modules/b", False, None, False), ("node_modules/c", False, None, False)], "location string, is_link boolean, target_location string, extraneous boolean").withColumn("name", F.col("location")))
    graph = lambda edges: Graph(nodes, spark.createDataFrame(edges, "src string, dst string"))
    actual = graph([("", "node_modules/w"), ("packages/w", "node_modules/a"), ("", "node_modules/c")])
    ideal = graph([("", "node_modules/w"), ("packages/w", "node_modules/b"), ("", "node_modules/c")])
    got = {r["location"] for r in diffs.filter_set(actual, ideal, nodes.where("location = 'packages/w'")).collect()}
    assert got == {"", "node_modules/w", "packages/w", "node_modules/a", "node_modules/a/node_modules/lost", "node_modules/b"}


def test_inert_nodes(spark):
    nodes = spark.createDataFrame([(x,) for x in ("", "a", "b", "c", "d", "e")], "location string")
    edges = spark.createDataFrame([("", "a", "optional"), ("a", "b", "prod"), ("b", "c", "prod"), ("c", "d", "prod"), ("", "e", "prod"), ("e", "d", "prod")], "src string, dst string, type string")
    got = {r["location"] for r in resolve.mark_inert(nodes, edges, nodes.where("location = 'b'")).where("inert").collect()}
    assert got == {"a", "b", "c"}  # d is still needed by e


def test_bundlers(spark):
    """The walk up the folders, node by node, against one closure over folders."""
    import random

    rng = random.Random(8)
    places, names = [""], "abcde"
    for _ in range(40):
        at = rng.choice(places)
        new = f"{at}/node_modules/{rng.choice(names)}".lstrip("/")
        if new not in places and new.count("node_modules") < 4:
            places.append(new)
    wants = {p: rng.sample(names, rng.randint(1, 2)) for p in places if rng.random() < 0.3}
    edges = {(s, d) for s in places for d in places if d and rng.random() < 0.05}
    parent = {p: p.rpartition("node_modules/")[0].rstrip("/") for p in places if p}

    def bundler(n, path=()):
        if n in path or n not in parent:
            return None
        path = (*path, n)
        up = parent[n]
        above = bundler(up, path)
        if above is not None:
            return above
        if n.rpartition("/")[2] in wants.get(up, ()):
            return up
        return up if any(d == n and bundler(s, path) == up for s, d in edges) else None

    nodes = complete(spark.createDataFrame([(p, p.rpartition("/")[2], json.dumps({"bundleDependencies": wants.get(p, [])})) for p in places], "location string, name string, package string"))
    got = {r["location"]: r["bundler"] for r in graph.bundled(nodes, spark.createDataFrame(sorted(edges), "src string, dst string")).collect()}
    assert got == {p: b for p in places if (b := bundler(p)) is not None} and len(set(got.values())) > 2


def test_paths(spark):
    row = spark.range(1).select(
        text.absolute_path(F.lit("/a/b"), F.lit("../c/./d")).alias("a"), text.absolute_path(F.lit("/a"), F.lit("/x/../y")).alias("b"), text.absolute_path(F.lit("/"), F.lit("../..")).alias("c"),
        text.relative_path(F.lit("/a/b/c"), F.lit("/a/x")).alias("d"), text.relative_path(F.lit("/a"), F.lit("/a")).alias("e"), text.relative_path(F.lit("/a/b"), F.lit("/a/b/c/d")).alias("f"), text.relative_path(F.lit("/"), F.lit("/q")).alias("g"),
    ).first()
    assert tuple(row) == ("/a/c/d", "/y", "/", "../../x", "", "c/d", "q")


def test_explanations_leave_out_what_isnt_valid(spark):
    nodes = complete(spark.createDataFrame([("", "top", "1.0.0", '{"bundleDependencies":["a"]}'), ("a", "a", "1.0.0", "{}"), ("b", "b", "1.0.0", "{}"), ("c", "c", "1.0.0", "{}")], "location string, name string, version string, package string"))
    edges = spark.createDataFrame([("", "a", "a", "prod", "^2", "INVALID"), ("a", "c", "c", "prod", "*", None), ("b", "c", "c", "prod", "^9", "INVALID"), ("c", "a", "a", "prod", "*", None)], "src string, name string, dst string, type string, spec string, error string")
    got = {(r["location"], r["dependent"], r["error"], r["bundled"], r["depth"]) for r in reports.explain_dependents(Graph(nodes, edges), nodes.where("name = 'c'")).collect()}
    assert got == {("c", "a", None, False, 0), ("a", "", "INVALID", True, 1), ("a", "c", None, False, 1), ("", None, None, False, 2)}


def test_cached_scans(spark):
    at = lambda s: __import__("datetime").datetime(2026, 1, 1, 0, 0, s)
    manifests = spark.createDataFrame([("", at(59)), ("a", at(1)), ("b", at(30)), ("new", at(1))], "location string, modified timestamp")
    locked = spark.createDataFrame([("", False), ("a", False), ("b", False), ("gone", False), ("link", True)], "location string, is_link boolean")
    got = {(r["location"], r["breach"]) for r in lockfile.snapshot_breaches(manifests, locked, at(10)).collect()}
    assert got == {("b", "newer than the lockfile"), ("new", "not in the lockfile"), ("gone", "not there")}
    assert lockfile.snapshot_valid(manifests.where("location = 'a'"), at(10), locked.where("location in ('', 'a', 'link')")) and not lockfile.snapshot_valid(manifests, at(10), locked)


def test_bulk_advisories(spark, tmp_path):
    one = {"id": 7, "url": "u", "title": "t", "severity": "high", "vulnerable_versions": "<2", "cwe": ["CWE-1"], "cvss": {"score": 7.5, "vectorString": None}}
    (tmp_path / "a.json").write_text(json.dumps({"x": [one, {**one, "id": 8, "cwe": None, "cvss": None}], "y": []}))
    (tmp_path / "b.json").write_text(json.dumps({"x": [one]}))
    got = {(r["name"], r["id"], r["severity"], r["vulnerable_versions"], tuple(r["cwe"]), r["score"]) for r in lockfile.read_advisories(spark, str(tmp_path)).collect()}
    assert got == {("x", "7", "high", "<2", ("CWE-1",), 7.5), ("x", "8", "high", "<2", (), None)}


def test_missing_edges_are_looked_for_above_the_tree(spark):
    edges = spark.createDataFrame([("", "a", None, "MISSING"), ("x", "b", None, "MISSING"), ("", "c", None, "MISSING"), ("", "d", "d", None)], "src string, name string, dst string, error string")
    folders = spark.createDataFrame([("/node_modules/a",), ("/srv/node_modules/a",), ("/node_modules/b",), ("/srv/app/node_modules/c",)], "path string")
    got = {(r["src"], r["name"], r["path"]) for r in graph.edges_found_outside(edges, folders, "/srv/app").collect()}
    assert got == {("", "a", "/srv/node_modules/a"), ("x", "b", "/node_modules/b")}


def test_what_can_be_deduped(spark):
    rows = [("", "top", "1.0.0", False), ("node_modules/a", "a", "1.2.0", False), ("node_modules/p", "p", "1.0.0", False)]
    cases = {"none": ("1.0.0", None), "same": ("1.2.0", "*"), "newer": ("1.1.0", "^1"), "held": ("1.1.0", "~1.1.0"), "older": ("1.3.0", "^1"), "over": ("1.1.0", "^1"), "alone": ("1.0.0", "^1")}
    edges = [("", "a", "node_modules/a", "^1")]
    for k, (version, spec) in cases.items():
        name = "b" if k == "alone" else "a"
        at = f"node_modules/p/node_modules/{k}/node_modules/{name}"
        rows += [(f"node_modules/p/node_modules/{k}", k, "1.0.0", False), (at, name, version, k == "over")]
        edges += [("node_modules/p", k, f"node_modules/p/node_modules/{k}", "*"), *([(f"node_modules/p/node_modules/{k}", name, at, spec)] if spec else [])]
    nodes = complete(spark.createDataFrame(rows, "location string, name string, version string, overridden boolean"))
    e = spark.createDataFrame(edges, "src string, name string, dst string, spec string")
    told = lambda **o: {r["location"].split("/")[3]: r["verdict"] for r in graph.can_dedupe(nodes, e, **o).where("location rlike '/[ab]$'").collect()}
    assert told() == {"none": "unwanted", "same": "same", "newer": "newer", "held": None, "older": None, "over": None, "alone": None}
    assert told(prefer=True) == told() | {"older": "preferred", "over": "preferred", "newer": "preferred"}


def test_views_and_selectors_that_meet_nothing(spark):
    v = spark.createDataFrame([("a", "2.0.0", '{"dist":{"size":2},"list":[{"k":1},{"k":2}]}'), ("a", "1.10.0", '{"dist":{"size":1}}'), ("a", "3.0.0", "{}"), ("b", "1.0.0", "{}")], "name string, version string, m string").withColumn("manifest", F.parse_json("m"))
    got = [(r["version"], json.loads(r["f"])) for r in reports.view_fields(v, "a", "<3", ["dist.size", "list.k"]).select("version", F.to_json("fields").alias("f")).collect()]
    assert got == [("1.10.0", {"dist.size": 1}), ("2.0.0", {"dist.size": 2, "list[0].k": 1, "list[1].k": 2})]
    s = spark.createDataFrame([("a@1", "a", "1"), ("a@9", "a", "9"), ("c", "c", None), ("b", "b", None)], "selector string, name string, range string")
    assert {r["selector"] for r in reports.unused_selectors(v, s).collect()} == {"a@9", "c"}


def test_install_counts(spark):
    nodes = complete(spark.createDataFrame([("", True, False), ("a", False, False), ("w", False, True)], "location string, is_root boolean, is_workspace boolean").withColumn("name", F.col("location")))
    diff = spark.createDataFrame([("a", "ADD"), ("b", "ADD"), ("c", "REMOVE")], "location string, action string")
    assert tuple(reports.install_counts(diff, nodes, funded=3).first()) == (2, 1, 0, 1, 3, None)


def test_manifest_commands(spark):
    one = lambda c: json.loads(spark.range(1).select(F.to_json(c)).first()[0])
    doc = F.parse_json(F.lit('{"name": " @s/a ", "version": "v1.0.0", "bin": "./x.js", "dependencies": ["no"], "devDependencies": {"d": "1"}, "k": 1}'))
    assert one(jsonpath.fixed(doc)) == {"name": "@s/a", "version": "1.0.0", "bin": {"a": "./x.js"}, "devDependencies": {"d": "1"}, "k": 1}
    assert one(jsonpath.set_arguments(doc, ["k=2", "x.y=z=1"]))["x"] == {"y": "z=1"} and one(jsonpath.set_arguments(doc, ["l[]=[1]"], as_json=True))["l"] == [[1]]
    assert one(jsonpath.get(F.parse_json(F.lit('{"a b": {"c": 1}}')), "[a b].c")) == {"[a b].c": 1}
    with pytest.raises(jsonpath.PathError):
        jsonpath.assignments(["nothing"])

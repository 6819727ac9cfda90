"""Versions, JSON paths, search, locks, resolution and file differences."""

import io
import json
import random
import tarfile

import pytest
from pyspark.sql import functions as F

from graphweft.functions import semver, text
from graphweft.operators import closure, filediff, graph, jsonpath, reports, resolve, search
from graphweft.sources import lockfile

VERSIONS = ["0.0.1", "0.2.3", "0.2.9", "0.3.0", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0", "1.2.3", "1.10.0", "2.0.0-0", "2.0.0-rc.1", "2.0.0", "2.3.4", "3.0.0"]
RANGES = ["*", "", "^1.0.0", "~1.2", "1.x", ">=1.0.0 <2", "1.2.3 - 2.3", "<=1", ">1", "^0.2.3", "^0.0.1", "1.0.0 || >=2.3", "^1.0.0-beta.2", "=1.2.3", ">= 2.0.0-rc.0", "<2.0.0-0", "x", "2 - *"]


def test_order_of_versions(spark):
    shuffled = VERSIONS[:]
    random.Random(1).shuffle(shuffled)
    rows = spark.createDataFrame([(v,) for v in shuffled], "v string").orderBy(semver.sv(F.col("v"))).collect()
    assert [r[0] for r in rows] == VERSIONS == sorted(VERSIONS, key=semver.parse)


def test_ranges_in_columns_equal_plain_python(spark):
    pairs = spark.createDataFrame([(v, r) for v in [*VERSIONS, "nope"] for r in RANGES], "v string, spec string")
    rows = pairs.join(semver.range_terms(pairs), "spec").select("v", "spec", semver.sv_satisfies(semver.sv(F.col("v")), F.col("terms")).alias("got"), semver.sv_satisfies(semver.sv(F.col("v")), F.col("terms"), True).alias("pre")).collect()
    assert len(rows) == (len(VERSIONS) + 1) * len(RANGES)
    for r in rows:
        assert r["got"] == semver.satisfies(r["v"], r["spec"]), r
        assert r["pre"] == semver.satisfies(r["v"], r["spec"], True), r
    frame = spark.createDataFrame([(v,) for v in VERSIONS], "v string")
    for range_ in RANGES:
        got = {r[0] for r in frame.where(semver.in_range(semver.sv(F.col("v")), range_)).collect()}
        assert got == {v for v in VERSIONS if semver.satisfies(v, range_)}, range_


@pytest.mark.parametrize(
    ("version", "range_", "expected"),
    [("1.2.3", "^1.0.0", True), ("2.0.0", "^1.0.0", False), ("0.2.9", "^0.2.3", True), ("0.3.0", "^0.2.3", False), ("2.0.0-rc.1", "*", False), ("2.0.0-rc.1", "^2.0.0-rc.0", True), ("3.0.0-a", "^2.0.0", False), ("1.9.9", "<=1", True), ("1.5.0", ">1", False), ("2.3.9", "1.2.3 - 2.3", True), ("1.2.3", "nope", False)],
)
def test_satisfies(version, range_, expected):
    assert semver.satisfies(version, range_) is expected


def test_range_algebra():
    assert semver.intersects("^16.0.0", ">= 14") and not semver.intersects("^1", "^2") and semver.intersects("1.x || 3.x", "3.0.1")
    assert semver.subset("^1.2.0", "^1.0.0") and not semver.subset("^1.0.0", "^1.2.0") and semver.subset("1.2.3", ">=1 <2")
    assert semver.outside("1.0.0", "^1.1.1", "<") and semver.outside("3.0.0", "^1.1.1", ">") and not semver.outside("1.2.0", "^1.1.1", "<")
    assert [semver.difference(*p) for p in (("1.0.0", "2.0.0"), ("1.0.0", "1.1.0"), ("1.0.0", "1.0.1"), ("1.0.0", "1.0.0"), ("1.0.0", "2.0.0-a"))] == ["major", "minor", "patch", None, "premajor"]


@pytest.mark.parametrize(
    ("version", "asked", "integrity", "resolved", "expected"),
    [
        ("1.2.3", "^1.0.0", "sha512-x", "https://r/a.tgz", "1.2.3"),
        ("git+ssh://git@host.test/a/b.git#0", None, None, None, "git+ssh://git@host.test/a/b.git#0"),
        ("1.2.3", "^1.0.0", None, "https://r/a.tgz", "1.2.3"),
        ("1.2.3", "latest", "", None, "1.2.3"),
        (None, "^1.0.0", None, None, "^1.0.0"),
        ("1.2.3", "file:../a", None, None, "file:../a"),
        ("1.2.3", "file:../a", None, "file:../b", "file:../b"),
        ("1.2.3", "a@^1", None, "https://r/a.tgz", "1.2.3"),
        (None, "a@^1", None, "https://r/a.tgz", None),
        ("1.2.3", None, None, "https://r/a.tgz", "https://r/a.tgz"),
        ("1.2.3", None, None, None, "1.2.3"),
        ("a@1", None, "sha512-x", None, None),
        ("", "", "", "", None),
        (None, None, None, None, None),
    ],
)
def test_specs_of_old_locks(spark, version, asked, integrity, resolved, expected):
    row = spark.createDataFrame([(version, asked, integrity, resolved)], "v string, f string, i string, r string")
    assert row.select(text.legacy_spec(*map(F.col, "vfir"))).first()[0] == expected


def test_digest_of_json(spark):
    import base64
    import hashlib

    value = {"b@1": {"peer": {"z": "^1 || 2", "a/é": "*"}, "n": [1, True, None, "x y"]}, "a": {}}
    plain = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    texts = [json.dumps(value), json.dumps(value, indent=2, sort_keys=True), plain, "{nope", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(text.json_digest(F.col("t"))).collect()]
    assert got == ["sha512-" + base64.b64encode(hashlib.sha512(plain.encode()).digest()).decode()] * 3 + [None, None]


def test_globs():
    import re

    m = lambda g, s: bool(re.match(text.glob_regex(g), s))
    assert m("a/*", "a/b") and not m("a/*", "a/b/c") and m("a/**/c", "a/c") and m("a/**/c", "a/x/y/c") and m("{a,b}?", "bz") and not m("*", ".x")


def test_json_paths(spark):
    doc = {"a": {"b": [1, {"c": 2}]}, "list": [{"k": 1}, {"k": 2}], "one": ["x"], "d.e": {"f": 0}}
    frame = spark.createDataFrame([(json.dumps(doc),)], "t string").withColumn("v", F.parse_json("t"))
    get = lambda p, **o: json.loads(frame.select(F.to_json(jsonpath.get(F.col("v"), p, **o))).first()[0])
    assert get("a.b[1].c") == {"a.b[1].c": 2} and get("list.k") == {"list[0].k": 1, "list[1].k": 2}
    assert get("one") == {"one": "x"} and get("one", unwrap=False) == {"one": ["x"]} and get("none.x") == {} and get("[d.e].f") == {"[d.e].f": 0}
    assert frame.select(F.to_json(jsonpath.get(F.parse_json(F.lit('{"x": {"l": [{"k": 1}]}}')), "x.l.k"))).first()[0] == '{"xl[0].k":1}'
    assert jsonpath.set_value({}, "a.b[1]", 5) == {"a": {"b": [None, 5]}} and jsonpath.set_value({"a": [1]}, "a[]", 2) == {"a": [1, 2]}
    assert jsonpath.delete_value(doc, "list[0]")["list"] == [{"k": 2}] and jsonpath.delete_value({"a": {"b": 1}}, "a.b") == {"a": {}}
    for bad, code in (("__proto__.x", "EFORBIDDENKEY"), ("a[].b", "ENOAPPEND")):
        with pytest.raises(jsonpath.PathError) as e:
            jsonpath.set_value({}, bad, 1)
        assert e.value.code == code
    with pytest.raises(jsonpath.PathError):
        jsonpath.set_value({"a": 1}, "a.b", 1)
    assert jsonpath.set_value({"a": 1}, "a.b", 1, force=True) == {"a": {"b": 1}}
    held = spark.createDataFrame([(1, '{"a": {"b": 1}, "_x": {"y": 1}, "l": [1, {"m": null}], "p.q": 2}'), (2, "7"), (3, None)], "k int, t string").withColumn("v", F.parse_json("t"))
    assert sorted(tuple(r) for r in jsonpath.field_paths(held, "k", "v").collect()) == [(1, "a"), (1, "a.b"), (1, "l"), (1, "l[0]"), (1, "l[1]"), (1, "l[1].m")]
    assert jsonpath.field_paths(held.where("k = 2"), "k", "v").count() == 0


PATHS = ("a", "a.b", "a.b.c", "x[0]", "x[2]", "x[]", "a.x[1].y", "[k.k].z", "x[0].y[]", "a[3]")


@pytest.mark.parametrize("force", [False, True])
def test_json_set_and_delete_follow_the_plain_rules(spark, force):
    """Each document and path in Catalyst as set_value and delete_value have it, errors included."""
    docs = [{}, None, 5, [], {"a": 1}, {"a": {"b": {"c": 2}, "z": None}}, {"x": [1, 2, 3]}, {"x": [{"y": [0]}, 2]}, {"x": {"0": 1}, "k.k": {"z": 1}}, {"a": None, "x": "s"}, {"a": ["l"]}, {"a": {"x": [1]}}]
    for path in PATHS:
        want, good = [], []
        for d in docs:
            try:
                want.append(jsonpath.set_value(d, path, {"new": 1}, force))
                good.append(d)
            except jsonpath.PathError as e:
                bad = spark.createDataFrame([(json.dumps(d),)], "t string")
                with pytest.raises(Exception, match=e.code):
                    bad.select(jsonpath.set_column(F.col("t"), path, F.parse_json(F.lit('{"new":1}')), force)).collect()
        frame = spark.createDataFrame([(k, json.dumps(d)) for k, d in enumerate(good)], "k int, t string").coalesce(1)
        got = frame.select("k", jsonpath.set_column(F.col("t"), path, F.parse_json(F.lit('{"new":1}')), force).alias("s"), jsonpath.delete_column(F.col("t"), path).alias("d")).orderBy("k").collect()
        assert [json.loads(r["s"]) for r in got] == want, path
        assert [json.loads(r["d"]) for r in got] == [jsonpath.delete_value(d, path) for d in good], path
    with pytest.raises(jsonpath.PathError):
        jsonpath.set_column(F.col("t"), "a.constructor.b", F.lit(1))


def plain_search(docs, terms):
    out = []
    for d, content in docs:
        has = lambda s: any(t.lower() in s.lower() for t in terms)
        if not has(content):
            continue
        lines = [x for x in __import__("re").split("\n+", content)]
        keep, k = set(), 0
        while k < len(lines):
            if k + 1 < len(lines) and lines[k + 1] and has(lines[k + 1]):
                keep |= {k, k + 1, k + 2}
                k += 3
            elif has(lines[k]):
                keep |= {k, k + 1}
                k += 2
            else:
                k += 1
        pruned: list = []
        for k, line in enumerate(lines):
            if k in keep:
                pruned.append(line)
            elif pruned and pruned[-1] is not None:
                pruned.append(None)
        while pruned and pruned[-1] is None:
            pruned.pop()
        counts = [sum((x or "").lower().count(t.lower()) for x in pruned) for t in terms]
        out.append((d, pruned, sum(c > 0 for c in counts), sum(counts)))
    return sorted(out, key=lambda r: (-r[2], -r[3], -len(r[1]), r[0]))


def test_help_search(spark):
    rng = random.Random(3)
    docs = [(d, "\n".join(rng.choice(["plain text", "has Token here", "two token token", "other Word", ""]) if rng.random() < 0.4 else "nothing" for _ in range(rng.randint(1, 25)))) for d in range(40)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = [tuple(r) for r in search.help_search(frame, ["token", "word"]).collect()]
    assert got == plain_search(docs, ["token", "word"])[:10]


def test_closure_equals_plain_walk(spark):
    rng = random.Random(4)
    edges = {(rng.randrange(30), rng.randrange(30)) for _ in range(60)}
    frame = spark.createDataFrame([(str(a), str(b)) for a, b in edges], "src string, dst string")
    got = {(r["location"], r["depth"]) for r in closure.closure(frame, spark.createDataFrame([("0",)], "location string")).collect()}
    seen, level, depth = {"0": 0}, {"0"}, 0
    while level:
        depth += 1
        level = {str(b) for a, b in edges if str(a) in level} - set(seen)
        seen |= dict.fromkeys(level, depth)
    assert got == set(seen.items())


LOCK = {
    "name": "top", "version": "1.0.0", "lockfileVersion": 3,
    "packages": {
        "": {"name": "top", "version": "1.0.0", "dependencies": {"x": "^1.0.0", "gone": "1"}, "devDependencies": {"y": "2"}, "workspaces": ["w"]},
        "node_modules/x": {"version": "1.2.0", "dependencies": {"y": "^3.0.0"}}, "node_modules/x/node_modules/y": {"version": "3.0.1"}, "node_modules/y": {"version": "1.0.0", "dev": True},
        "w": {"name": "w", "version": "1.0.0", "dependencies": {"x": "*"}}, "node_modules/w": {"resolved": "w", "link": True},
    },
}


def test_lockfiles(spark, tmp_path):
    (tmp_path / "lock.json").write_text(json.dumps(LOCK))
    g = lockfile.load_virtual(spark, str(tmp_path / "lock.json"))
    edges = {(r["src"], r["name"]): (r["dst"], r["type"], r["error"]) for r in g.edges.collect()}
    assert edges == {
        ("", "x"): ("node_modules/x", "prod", None), ("", "gone"): (None, "prod", "MISSING"), ("", "y"): ("node_modules/y", "dev", "INVALID"),
        ("", "w"): ("node_modules/w", "workspace", None), ("node_modules/x", "y"): ("node_modules/x/node_modules/y", "prod", None), ("w", "x"): ("node_modules/x", "prod", None),
    }
    assert graph.check_tree(g).where("n > 0").count() == 0
    text_ = lockfile.to_lockfile(g.nodes, "top").first()[0]
    assert json.loads(text_)["packages"]["node_modules/x"]["version"] == "1.2.0"
    old = {"name": "t", "version": "1.0.0", "dependencies": {"a": {"version": "1.0.0", "requires": {"b": "^2"}, "dependencies": {"b": {"version": "2.0.0"}}}}}
    assert set(lockfile.migrated(old)) == {"", "node_modules/a", "node_modules/a/node_modules/b"}
    (tmp_path / "new.json").write_text(json.dumps({**LOCK, "lockfileVersion": 9}))
    with pytest.raises(Exception, match="newer than"):
        lockfile.read_packages(spark, str(tmp_path / "new.json")).count()


def test_yarn_round_trip(spark, tmp_path):
    content = '# yarn lockfile v1\n\n\na@^1.0.0, a@^1.1.0:\n  version "1.1.0"\n  resolved "https://r.example/a.tgz"\n  dependencies:\n    b "^2.0.0"\n\n"@s/b@^2.0.0":\n  version "2.0.0"\n'
    parsed = lockfile.parse_yarn(content)
    assert parsed["a@^1.1.0"]["dependencies"] == {"b": "^2.0.0"} and parsed["@s/b@^2.0.0"]["version"] == "2.0.0"
    assert lockfile.parse_yarn(lockfile.to_yarn(parsed)) == parsed
    (tmp_path / "yarn.lock").write_text(content)
    assert lockfile.read_yarn(spark, str(tmp_path / "yarn.lock")).count() == 3


def test_archives_and_differences(spark, tmp_path):
    for name, body in (("a", b"one\ntwo\n"), ("b", b"one\n2\n")):
        with tarfile.open(tmp_path / f"{name}.tgz", "w:gz") as t:
            for inner, data in (("package/index.js", body), ("package/same.txt", b"same")):
                info = tarfile.TarInfo(inner)
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
    a, b = (lockfile.read_archives(spark, str(tmp_path / f"{x}.tgz")) for x in "ab")
    rows = filediff.file_diff(a, b).collect()
    assert [r["path"] for r in rows] == ["index.js"] and "-two" in rows[0]["patch"] and "+2" in rows[0]["patch"]
    assert lockfile.archive_totals(a).first()["size"] == 12


def test_registry_files(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"name": "p", "dist-tags": {"latest": "1.0.0"}, "time": {"1.0.0": "2024-01-01T00:00:00Z"}, "versions": {"1.0.0": {"license": "MIT"}}}))
    versions, tags = lockfile.read_packuments(spark, str(tmp_path / "p.json"))
    assert versions.select("version", F.year("published_at")).first()[1] == 2024 and tags.first()["tag"] == "latest"


def test_resolution():
    packages = {("x", "1.0.0"): [("y", "prod", "^1.0.0")], ("y", "1.0.0"): [], ("y", "2.0.0"): [], ("z", "1.0.0"): [("y", "peer", "^2.0.0")]}
    placed, problems = resolve.resolve([("x", "prod", "^1.0.0"), ("y", "prod", "^2.0.0"), ("none", "optional", "1")], packages)
    assert placed == [("node_modules/x", "x", "1.0.0"), ("node_modules/x/node_modules/y", "y", "1.0.0"), ("node_modules/y", "y", "2.0.0")] and not problems
    placed, _ = resolve.resolve([("x", "prod", "*"), ("z", "prod", "*")], packages)
    assert ("node_modules/y", "y", "1.0.0") in placed or ("node_modules/y", "y", "2.0.0") in placed
    assert resolve.add_dependency({"dependencies": {"a": "1"}}, "a", "2", "dev") == {"devDependencies": {"a": "2"}}
    with pytest.raises(ValueError):
        resolve.resolve([], {}, "none")


def test_sets_and_overrides(spark):
    edges = spark.createDataFrame([("", "a", "prod"), ("a", "b", "prod"), ("b", "c", "prod"), ("", "c", "prod"), ("b", "d", "peer")], "src string, dst string, type string").withColumn("name", F.col("dst")).withColumn("spec", F.lit("^1.0.0"))
    start = spark.createDataFrame([("a",)], "location string")
    assert {r[0] for r in graph.closed_set(edges, start).collect()} == {"a", "b", "d"}
    rules = spark.createDataFrame([("b", 1, 1, "c", "*", "9.0.0"), ("b", 0, 2, "c", "^2.0.0", "8.0.0")], "src string, distance int, rule_id int, name string, key_spec string, value string")
    assert [tuple(r) for r in graph.override_rule(edges, rules).collect()] == [("b", "c", 1, "9.0.0")]
    clash = spark.createDataFrame([("k", 1, "1.0.0"), ("k", 2, "2.0.0"), ("k", 3, "$x")], "key string, rule_id int, value string")
    assert [tuple(r) for r in graph.override_conflicts(clash).collect()] == [("k", 1, 2)]


def test_peer_sets_equal_plain_components(spark):
    rng = random.Random(7)
    pairs = {(f"n{rng.randrange(90)}", f"n{rng.randrange(90)}") for _ in range(60)} | {(f"c{k}", f"c{k + 1}") for k in range(40)} | {("loop", "loop")}
    rows = [(a, b, rng.choice(("peer", "peerOptional"))) for a, b in pairs] + [("n1", "c1", "prod"), ("c1", None, "peer")]
    got = [tuple(r) for r in graph.peer_sets(spark.createDataFrame(rows, "src string, dst string, type string")).collect()]
    part = {x: x for p in pairs for x in p}
    for _ in part:
        for a, b in pairs:
            part[a] = part[b] = min(part[a], part[b])
    assert sorted(got) == sorted(part.items())


def test_paths_end_only_at_repeats(spark):
    edges = spark.createDataFrame([(str(k), str(k + 1)) for k in range(24)] + [("24", "0")], "src string, dst string")
    got = [r["path"] for r in closure.paths(edges, spark.createDataFrame([("0",)], "location string")).collect()]
    assert sorted(map(len, got)) == list(range(1, 26)) and max(got, key=len) == [str(k) for k in range(25)]
    assert closure.paths(edges, spark.createDataFrame([("0",)], "location string"), 2).count() == 3


def test_diff_hides_what_is_below_a_change(spark):
    a = spark.createDataFrame([("node_modules/x", "1"), ("node_modules/x/node_modules/y", "1"), ("node_modules/z", "1")], "location string, version string")
    b = spark.createDataFrame([("node_modules/x", "2"), ("node_modules/x/node_modules/y", "2"), ("node_modules/new", "1")], "location string, version string")
    assert {tuple(r)[:2] for r in reports.tree_diff(a, b).collect()} == {("node_modules/x", "CHANGE"), ("node_modules/z", "REMOVE"), ("node_modules/new", "ADD")}

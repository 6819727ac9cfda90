"""Trees and fixpoints against plain Python walks, on graphs with cycles, links,
missing and extraneous nodes."""

import random

import pytest
from pyspark.sql import functions as F

from graphweft.operators import audits, fixpoints, trees
from graphweft.operators.graph import Graph, complete


def random_graph(seed, n=24, versions=3):
    """Nodes (location, name, version) and edges (src, name, dst) with cycles and packages at several places."""
    rng = random.Random(seed)
    names = [f"p{k}" for k in range(n // 2)]
    nodes = {"": ("root", "1.0.0")} | {f"n{k}": (rng.choice(names), f"{rng.randint(1, versions)}.0.0") for k in range(n)}
    edges = {}
    for src in nodes:
        for dst in rng.sample(sorted(set(nodes) - {""}), rng.randint(1, 4)):
            edges[(src, nodes[dst][0])] = dst
    return nodes, edges


def frames(spark, nodes, edges):
    own = complete(spark.createDataFrame([(at, name, v, at == "") for at, (name, v) in nodes.items()], "location string, name string, version string, is_root boolean"))
    return own, spark.createDataFrame([(s, name, d, "prod", "*", None) for (s, name), d in edges.items()], "src string, name string, dst string, type string, spec string, error string")


def plain_fund(nodes, edges, funded):
    """The walk itself: a node claims all it leads to, then each claim takes its turn."""
    key = lambda at: "@".join(nodes[at])
    seen, rows = {key("")}, {}

    def turn(at, parent, depth):
        claimed = []
        for (src, _), dst in sorted(edges.items()):
            if src == at and dst != "" and key(dst) not in seen:
                seen.add(key(dst))
                rows[key(dst)] = [dst, parent, depth, None, False]
                claimed.append(dst)
        tree, trailing = {}, {}
        for dst in claimed:
            inner = turn(dst, key(dst), depth + 1)
            if funded(dst):
                tree[nodes[dst][0]] = (key(dst), inner)
            else:
                trailing |= inner
        return tree | trailing

    def show(tree, place):
        for own, inner in tree.values():
            rows[own][3:] = place, True
            show(inner, own)

    show(turn("", None, 1), None)
    return rows


@pytest.mark.parametrize("seed", [1, 3])
def test_fund_tree_equals_the_walk(spark, seed):
    nodes, edges = random_graph(seed)
    funded = {at for at in nodes if at and int(at[1:]) % 3}
    want = plain_fund(nodes, edges, funded.__contains__)
    own, e = frames(spark, nodes, edges)
    got = {r["key"]: r for r in trees.fund_tree(own, e, F.col("location").isin(*funded)).collect()}
    assert {k: (r["location"], r["parent"], r["depth"]) for k, r in got.items()} == {k: tuple(v[:3]) for k, v in want.items()}
    assert {k: r["place"] for k, r in got.items() if r["shown"]} == {k: v[3] for k, v in want.items() if v[4]}


def plain_listing(nodes, edges, limit, spaces):
    """Breadth first with a queue; children in order of their ids."""
    ident = lambda at: "@".join(nodes[at])
    seen, queue, rows = {""}, [("", (), 0)], [((), "", "", 0)]
    while queue:
        at, path, cur = queue.pop(0)
        if limit is not None and cur > limit:
            continue
        for pkgid, dst in sorted((ident(d) if d else f"{name}@*", d or "") for (s, name), d in edges.items() if s == at):
            mark = "missing" if not dst else "deduped" if dst in seen else ""
            rows.append(((*path, (pkgid, dst)), dst, mark, cur + 1))
            if not mark:
                seen.add(dst)
                queue.append((dst, (*path, (pkgid, dst)), 0 if dst in spaces else cur + 1))
    return [(dst or None, mark, depth) if path else ("", mark, depth) for path, dst, mark, depth in sorted(rows)]


@pytest.mark.parametrize("limit", [None, 1])
def test_ls_tree_equals_the_walk(spark, limit):
    nodes, edges = random_graph(7)
    edges[("n1", "zz")] = edges[("", "none")] = None
    spaces = {"n3", "n5"}
    own, e = frames(spark, nodes, edges)
    own = own.withColumn("is_workspace", F.col("location").isin(*spaces))
    e = e.withColumn("error", F.when(F.col("dst").isNull(), "MISSING"))
    got = trees.ls_tree(Graph(own, e), limit).orderBy("n").collect()
    assert [(r["location"], r["mark"], r["depth"]) for r in got] == plain_listing(nodes, edges, limit, spaces)
    assert [r["n"] for r in got] == list(range(1, len(got) + 1))


@pytest.fixture(scope="module")
def small(spark):
    """Two workspaces behind links, an invalid, an optional, an alias and stray folders."""
    rows = [
        ("", "top", "1.0.0", {}), ("node_modules/a", "a", "1.0.0", {"is_link": True, "target_location": "packages/a"}), ("packages/a", "a", "1.0.0", {"is_workspace": True}),
        ("node_modules/w", "w", "2.0.0", {"is_link": True, "target_location": "packages/w"}), ("packages/w", "w", "2.0.0", {"is_workspace": True}),
        ("node_modules/b", "b", "3.0.0", {"overridden": True}), ("node_modules/b/node_modules/lost", "lost", "0.0.1", {"extraneous": True}), ("node_modules/al", "al", "1.1.1", {"package_name": "real"}),
    ]
    nodes = spark.createDataFrame([(at, n, v, at == "", *(more.get(k, d) for k, d in (("is_link", False), ("target_location", None), ("is_workspace", False), ("overridden", False), ("extraneous", False), ("package_name", n)))) for at, n, v, more in rows], "location string, name string, version string, is_root boolean, is_link boolean, target_location string, is_workspace boolean, overridden boolean, extraneous boolean, package_name string")
    edges = [("", "a", "node_modules/a", "workspace", "file:packages/a", None), ("", "w", "node_modules/w", "workspace", "file:packages/w", None), ("", "b", "node_modules/b", "dev", "^4.0.0", "INVALID"), ("", "maybe", None, "optional", "^1", None), ("packages/a", "b", "node_modules/b", "prod", "*", None), ("packages/a", "al", "node_modules/al", "dev", "*", None), ("packages/w", "gone", None, "prod", "^9", "MISSING"), ("node_modules/b", "al", "node_modules/al", "dev", "*", None)]
    return Graph(complete(nodes), spark.createDataFrame(edges, "src string, name string, dst string, type string, spec string, error string"))


def labels(graph, *args, **filters):
    return [("  " * r["level"]) + r["label"] for r in trees.ls_tree(graph, *args, **filters).orderBy("n").collect()]


def test_listing_labels(small):
    assert labels(small, None) == [
        "top@1.0.0", "  a@1.0.0", "    al@npm:real@1.1.1", "    b@3.0.0 deduped overridden", '  b@3.0.0 invalid: "^4.0.0" from the root project overridden', "    al@npm:real@1.1.1 deduped",
        "    lost@0.0.1 extraneous", "  UNMET OPTIONAL DEPENDENCY maybe@^1", "  w@2.0.0", "    UNMET DEPENDENCY gone@^9",
    ]


def test_listing_filters(small):
    assert labels(small, None, link=True) == ["top@1.0.0", "  a@1.0.0", "  w@2.0.0"]
    assert labels(small, 0, omit=("dev", "optional")) == ["top@1.0.0", "  a@1.0.0", "    b@3.0.0 overridden", "  w@2.0.0", "    UNMET DEPENDENCY gone@^9"]
    assert labels(small, None, workspaces=["w"]) == ["top@1.0.0", "  w@2.0.0", "    UNMET DEPENDENCY gone@^9"]
    assert labels(small, None, workspaces=["w"], include_root=True)[1].startswith("  b@3.0.0 invalid")
    assert [x.split()[0] for x in labels(small, 0, workspaces_enabled=False)] == ["top@1.0.0", "b@3.0.0", "UNMET"]
    assert "    al@npm:real@1.1.1 deduped" not in labels(small, None, linked=True)


def test_listing_of_what_matches_keeps_its_dependents(small):
    assert labels(small, None, F.col("name") == "al") == ["top@1.0.0", "  a@1.0.0", "    al@npm:real@1.1.1", '  b@3.0.0 invalid: "^4.0.0" from the root project overridden', "    al@npm:real@1.1.1 deduped"]


# --- fixpoints ---------------------------------------------------------------------


def reach(edges, start):
    out, todo = {start}, [start]
    while todo:
        for s, d in edges:
            if s == todo[-1] and d not in out:
                out.add(d)
                todo.insert(0, d)
        todo.pop()
    return out


@pytest.fixture(scope="module")
def cyclic():
    rng = random.Random(4)
    edges = {(f"{g}{a:02}", f"{g}{rng.randrange(12):02}") for g in "abcdef" for a in range(12) for _ in range(rng.choice([0, 1, 1, 2]))}
    nodes = {f"{g}{a:02}" for g in "abcdef" for a in range(12)} | {"lone"}
    return sorted(nodes), sorted(edges)


def graph_frames(spark, nodes, edges):
    return spark.createDataFrame([(n,) for n in nodes], "location string"), spark.createDataFrame(edges, "src string, dst string")


def test_strong_components_and_levels(spark, cyclic):
    nodes, edges = cyclic
    n, e = graph_frames(spark, nodes, edges)
    within = {x: reach(edges, x) for x in nodes}
    got = {r["location"]: r["component"] for r in fixpoints.strong_components(n, e).collect()}
    assert all((got[a] == got[b]) == (a in within[b] and b in within[a]) for a in nodes for b in nodes) and all(c in got for c in got.values())
    on_cycle = {x for x in nodes if any(x != d and x in within[d] for s, d in edges if s == x)}

    def level(x):
        return 1 + max((level(d) for s, d in edges if s == x and d != x), default=-1)

    want = {x: None if within[x] & on_cycle else level(x) for x in nodes}
    assert {r["location"]: r["level"] for r in fixpoints.levels(n, e).collect()} == want


def test_content_keys_tell_content(spark, cyclic):
    """Copies of a graph have equal keys; a change below changes all that lead to it, and nothing else."""
    nodes, edges = cyclic
    copy = lambda x: "z" + x
    every, links = nodes + [copy(x) for x in nodes], edges + [(copy(a), copy(b)) for a, b in edges]
    n, e = graph_frames(spark, every, links)
    own = F.concat(F.lit("id"), F.substring("location", -3, 3))
    got = {r["location"]: r["key"] for r in fixpoints.content_keys(n, e, own).collect()}
    assert all(got[x] == got[copy(x)] for x in nodes) and len({got[x] for x in nodes}) == len(nodes)
    changed = "zb05"
    new = {r["location"]: r["key"] for r in fixpoints.content_keys(n, e, F.when(F.col("location") == changed, "other").otherwise(own)).collect()}
    assert {x for x in every if new[x] != got[x]} == {x for x in every if changed in reach(links, x)}


def test_least_along_cycles(spark, cyclic):
    nodes, edges = cyclic
    n, e = graph_frames(spark, nodes, edges)
    value = {x: (sum(map(ord, x)) * 7919) % 101 for x in nodes}
    own = spark.createDataFrame(list(value.items()), "location string, value int")
    back = {x: min(value[y] for y in nodes if x in reach(edges, y)) for x in nodes}
    assert {r["location"]: r["value"] for r in fixpoints.least_along(e, own).collect()} == back


def test_link_targets(spark):
    links = {f"c{k}": f"c{k + 1}" for k in range(300)} | {"c300": "real", "loop1": "loop2", "loop2": "loop1", "into": "loop1/x", "self": "self", "grows": "grows/a", "dir": "real/dir", "real/dir/in": "deep", "via": "dir/in/file"}
    got = {r["location"]: (r["real"], r["loops"]) for r in fixpoints.link_targets(spark.createDataFrame(list(links.items()), "location string, target string")).collect()}
    want = {f"c{k}": ("real", False) for k in range(301)} | {x: (None, True) for x in ("loop1", "loop2", "into", "self", "grows")}
    assert got == want | {"dir": ("real/dir", False), "real/dir/in": ("deep", False), "via": ("deep/file", False)}


def test_override_rules_are_rows():
    rules = fixpoints.override_rules({"a": "", "@s/b@^1": {".": "2.0.0", "c": "$c"}, "d@^3": {"e": "1"}})
    assert [(r["parent"], r["name"], r["key_spec"], r["value"]) for r in rules] == [(None, None, None, None), (0, "a", "*", "*"), (0, "@s/b", "^1", "2.0.0"), (2, "c", "*", "$c"), (0, "d", "^3", "^3"), (4, "e", "*", "1")]


def test_override_states(spark):
    """Two paths bring different rules to one node; references, bundled targets and both kinds of spec."""
    nodes = complete(spark.createDataFrame([("", "top", "1.0.0", False), ("a", "a", "1.0.0", False), ("b", "b", "1.0.0", False), ("c", "c", "2.0.0", False), ("d", "d", "1.0.0", False), ("r", "r", "3.1.0", False), ("s", "s", "8.23.0", False), ("t", "t", "8.24.0", False), ("z", "z", "1.0.0", True)], "location string, name string, version string, in_bundle boolean"))
    rows = [("", "a", "a", "^1"), ("", "b", "b", "^1"), ("", "r", "r", "^3.0.0"), ("a", "c", "c", "^1"), ("b", "c", "c", "^1"), ("c", "d", "d", "*"), ("a", "r", "r", "^1"), ("b", "s", "s", "^8.0.0"), ("b", "t", "t", "^8.0.0"), ("b", "z", "z", "^1"), ("d", "a", "a", "*"), ("b", "none", None, "*")]
    edges = spark.createDataFrame([(s, n, d, "prod", spec) for s, n, d, spec in rows], "src string, name string, dst string, type string, spec string")
    overrides = {"a": {"c": "2.0.0"}, "b": {"c": "3.0.0"}, "r": "$r", "s@8.23.0": "9.0.0", "t@8.23.0": "9.0.0", "z": "5.0.0"}
    got = {(r["src"], r["name"]): r for r in fixpoints.override_states(nodes, edges, overrides).collect()}
    told = lambda *at: (got[at]["spec"], got[at]["error"], got[at]["conflict"])
    assert told("a", "c") == ("2.0.0", None, False)  # c stands under the first of the two that conflict
    assert told("b", "c") == ("3.0.0", "INVALID", True)
    assert told("a", "r") == ("^3.0.0", None, False) and got[("a", "r")]["raw_spec"] == "^1"
    assert told("b", "s") == ("9.0.0", "INVALID", False)  # meets the raw spec, but is what the rule replaces
    assert told("b", "t") == ("9.0.0", None, False)
    assert told("b", "z") == ("5.0.0", None, False) and told("b", "none") == ("*", "MISSING", False)


def plain_simple(versions, holds, text):
    v, sets, first, prev = sorted(versions), [], None, None
    for x in v:
        if holds(x):
            first, prev = first or x, x
        elif prev:
            sets.append((first, prev))
            first = prev = None
    if first:
        sets.append((first, None))
    show = lambda x: ".".join(map(str, x))
    parts = [show(a) if a == b else "*" if b is None and a == v[0] else f">={show(a)}" if b is None else f"<={show(b)}" if a == v[0] else f"{show(a)} - {show(b)}" for a, b in sets]
    out = " || ".join(parts)
    return out if len(out) < len(text) else text


def test_simple_ranges(spark):
    rng = random.Random(6)
    tests = {"<2.0.0 || 1.0.0 - 2.9.9": lambda x: x < (3, 0, 0), ">=3.0.0 || >=2.0.0 <2.2.0-0": lambda x: x >= (3, 0, 0) or (2, 0, 0) <= x < (2, 2, 0), ">=1.0.0 <1.1.0 || >=1.1.0": lambda x: x >= (1, 0, 0), "1": lambda x: x[0] == 1, ">90.0.0 || >91.0.0": lambda x: False}
    known = {f"n{k}": {(rng.randint(0, 4), rng.randint(0, 3), rng.randint(0, 2)) for _ in range(rng.randint(1, 14))} for k in range(8)}
    versions = spark.createDataFrame([(n, ".".join(map(str, v))) for n, vs in known.items() for v in vs], "name string, version string")
    ranges = spark.createDataFrame([(n, t) for n in known for t in tests] + [("unknown", "1 || 2")], "name string, range string")
    got = {(r["name"], r["range"]): r["simple"] for r in audits.simple_ranges(ranges, versions).collect()}
    assert got == {(n, t): plain_simple(vs, holds, t) for n, vs in known.items() for t, holds in tests.items()} | {("unknown", "1 || 2"): "1 || 2"}

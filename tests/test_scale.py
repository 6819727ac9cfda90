"""What must not depend on how large a table seems to be: no table that grows
with the graph is broadcast, and lines and flags stay narrow."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from graphweft import graph_queries, queries  # noqa: F401
from graphweft.operators import closure as C
from graphweft.operators import audits, fixpoints, reports, trees
from graphweft.operators import graph as G
from graphweft.plans.compiler import Compiler
from graphweft.sources import star

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["outdated_any", "outdated_as_of", "outdated_in_range", "outdated_major", "outdated_minor", "outdated_out_of_range", "outdated_patch", "query_context", "sel_id_version"])
def test_locations_are_merged_not_broadcast(spark, name):
    text = plan(queries.QUERIES[name](spark, SF))
    assert not re.findall(r"BroadcastHashJoin \[(?:location#|name#\d+, version#|name#\d+\], \[name#\d+\], Inner, BuildLeft).*", text)


def test_versions_of_a_name_are_not_paired(spark):
    text = plan(queries.QUERIES["query_context"](spark, SF))
    assert not re.search(r"Join.*\(_n#\d+ > _v#\d+\)", text)
    # what is long meets the nodes by their packages, and isn't shuffled with them
    assert not re.search(r"Join \[location#", text)


def test_newer_versions_by_their_order(spark):
    nodes = spark.sql("""select * from values ('', 'a', '1.0.0', true, '{}'), ('x', 'a', '1.0.0', false, '{}'), ('y', 'a', '2.0.0', false, '{}'), ('z', 'a', '1.9.0', false, '{"private": true}'),
      ('u', 'a', 'odd', false, '{}'), ('v', 'a', null, false, '{}'), ('w', 'b', '1.0.0', false, '{}') as t(location, name, version, is_root, json)""").withColumn("package", F.parse_json("json")).drop("json")
    versions = spark.sql("select *, timestamp'2020-01-01' as published_at from values ('a', '1.0.0'), ('a', '1.0.0+x'), ('a', '1.5.0-b'), ('a', '10.0.0'), ('a', '2.0.0'), ('a', '2.0.0'), ('a', 'odd'), ('c', '9.0.0') as t(name, version)")
    advisories = spark.sql("select * from values ('a', 'A1', '<2.0.0'), ('a', 'A2', '1.0.0') as t(name, id, vulnerable_versions)")
    g = G.Graph(nodes, None, "", "/", versions=versions, advisories=advisories)
    assert {r.location: r.newer for r in Compiler(g).outdated().collect()} == {"x": ["10.0.0", "2.0.0", "1.5.0-b"], "y": ["10.0.0"]}
    told = {r.location: (sorted(a["id"] for a in r.advisories or ()), r.versions) for r in reports.query_context(g, nodes).collect()}
    assert told == {"": (["A1", "A2"], None), "x": (["A1", "A2"], ["10.0.0", "2.0.0", "1.5.0-b"]), "y": ([], ["10.0.0"]), "z": (["A1"], None), "u": ([], None), "v": ([], None), "w": ([], None)}


def test_plain_conditions_need_no_join(spark):
    assert "Join" not in plan(queries.QUERIES["sel_attr_dash"](spark, SF))


def test_parts_are_merged_and_lines_are_narrow(spark):
    edges = star.project(spark, SF).edges
    text = plan(edges)
    assert not [line for line in text.splitlines() if "BroadcastHashJoin [l_partkey" in line]
    assert "map(" not in text and "keys: [" not in text


def test_flags_copy_no_edges(spark, monkeypatch):
    g = star.star_graph(spark, SF)

    def refused(df, name):
        raise AssertionError(f"{name} written")

    monkeypatch.setattr(G, "stored", refused)
    assert G.dependency_flags(g.nodes, g.edges).count() == g.nodes.count()


def test_flags_over_a_cycle_and_a_link(spark):
    nodes = spark.createDataFrame([(x, x == "l", "t" if x == "l" else None) for x in ("", "a", "b", "c", "l", "t", "x")], "location string, is_link boolean, target_location string")
    edges = spark.createDataFrame([("", "a", "dev"), ("a", "b", "prod"), ("b", "a", "prod"), ("", "b", "optional"), ("b", "c", "peer"), ("c", "l", "prod"), ("", None, "prod"), ("", "x", "peerOptional")], "src string, dst string, type string")
    got = {r.location: tuple(r)[1:] for r in G.dependency_flags(nodes, edges).collect()}
    assert got == {
        "": (False, False, False, False, False), "a": (False, False, False, False, True), "b": (False, False, False, False, True), "c": (False, False, False, True, True),
        "l": (False, False, False, True, True), "t": (False, False, False, True, True), "x": (True, False, True, True, False),
    }


def test_a_round_of_a_closure_shuffles_only_what_it_leads_to(spark, monkeypatch):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y"), ("d", None)], "src string, dst string")
    seen, own = [], C.dealt

    def told(df, name, *keys, **more):
        seen.append((name, plan(df)))
        return own(df, name, *keys, **more)

    monkeypatch.setattr(C, "dealt", told)
    start = spark.createDataFrame([("a",)], "location string")
    assert sorted(map(tuple, C.closure(edges, start).collect())) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    rounds = [text for name, text in seen if name == "found"][1:]
    assert len(rounds) == 4
    for text in rounds:
        assert text.count("Exchange") == 1 and text.count("Bucketed: true") == 3 and "Broadcast" not in text and "LeftAnti" not in text
    seeds = spark.createDataFrame([("1", "a"), ("2", "x"), ("3", "d")], "seed string, location string")
    assert sorted(map(tuple, C.closure(edges, seeds, 1).collect())) == [("1", "a", 0), ("1", "b", 1), ("2", "x", 0), ("2", "y", 1), ("3", "d", 0)]


def test_a_closed_set_broadcasts_nothing(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("x", "c"), ("c", "d"), ("b", "e"), ("x", "a")], "src string, dst string")
    got = G.closed_set(edges, spark.createDataFrame([("a",)], "location string"))
    assert "BroadcastHashJoin" not in plan(got)
    assert sorted(r.location for r in got.collect()) == ["a", "b", "e"]


def test_override_states_sends_no_edge_without_a_reference_to_one_task(spark):
    nodes = G.complete(spark.createDataFrame([(x, x or "root", "1.0.0") for x in ("", "a", "b", "c")], "location string, name string, version string"))
    edges = spark.createDataFrame([("", "a", "prod", "a", "*"), ("a", "b", "prod", "b", "^1.0.0"), ("b", "a", "prod", "a", "*"), ("b", "c", "prod", "c", "*"), ("c", "x", "prod", None, "*")], "src string, name string, type string, dst string, spec string")
    told = lambda rules: fixpoints.override_states(nodes, edges, rules)
    plain = told({"a": {"c": "2.0.0"}})
    assert "[_ref#" not in plan(plain) and plan(plain).count("Bucketed: true") > 1
    assert {(r.src, r.name): (r.rule, r.spec, r.error) for r in plain.collect()} == {
        ("", "a"): (1, "*", None), ("a", "b"): (1, "^1.0.0", None), ("b", "a"): (1, "*", None), ("b", "c"): (2, "2.0.0", "INVALID"), ("c", "x"): (2, "*", "MISSING"),
    }
    assert {(r.src, r.name): r.spec for r in told({"b": "$a"}).collect()}["a", "b"] == "*"


def test_a_listing_carries_places_not_texts_and_shuffles_no_listed_edge(spark, monkeypatch):
    own, seen = trees.stored, []

    def told(df, name):
        seen.append((name, df.schema, plan(df)))
        return own(df, name)

    monkeypatch.setattr(trees, "stored", told)
    nodes = G.complete(spark.createDataFrame([(x, x or "root", "1.0.0") for x in ("", "a", "b")], "location string, name string, version string"))
    edges = spark.createDataFrame([("", "a", "prod", "a", "*", None), ("", "b", "prod", "b", "*", None), ("b", "a", "prod", "a", "*", None), ("b", "aa", "prod", None, "1", "MISSING"), ("b", "x", "prod", "x", "*", None)], "src string, name string, type string, dst string, spec string, error string")
    rows = trees.ls_tree(G.Graph(nodes, edges), None).orderBy("n").collect()
    assert [r.label for r in rows] == ["root@1.0.0", "a@1.0.0", "b@1.0.0", "a@1.0.0 deduped", "UNMET DEPENDENCY aa@1", "x@*"]
    rounds = [(schema, text) for name, schema, text in seen if name == "shown"][1:]
    assert rounds and all("_k" in schema["path"].dataType.elementType.names and "Bucketed: true" in text for schema, text in rounds)


def test_content_keys_look_for_components_only_below_a_cycle(spark, monkeypatch):
    """The star graph's cycles are nations and their regions: no order is searched for one."""
    sizes, own = [], fixpoints.strong_components

    def counted(nodes, edges):
        sizes.append((nodes.count(), edges.count()))
        return own(nodes, edges)

    monkeypatch.setattr(fixpoints, "strong_components", counted)
    assert queries.QUERIES["store_keys"](spark, SF).count() == star.star_graph(spark, SF).nodes.count()
    assert sizes == [(30, 50)]


def test_content_keys_without_a_cycle_and_with_a_step_to_itself(spark):
    """Keys of a plain graph are those of its formula; ends that are no nodes and repeated edges don't count."""
    nodes = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C"), ("d", "C")], "location string, id string")
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "c"), ("a", "d"), ("b", "b"), ("b", "c"), ("c", "gone"), ("d", None)], "src string, dst string")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()

    def keyed(own, among, below):
        return f"{own}-{sha(sha('|'.join((own, among, ','.join(sorted(own + '>' + k for k in below))))) + '|' + own)[:32]}"

    c = keyed("C", "", [])
    b = keyed("B", "B>B", [c])
    want = {"a": keyed("A", "", {b, c}), "b": b, "c": c, "d": c}
    assert {r.location: r.key for r in fixpoints.content_keys(nodes, edges, F.col("id")).collect()} == want


def test_an_audit_tests_each_version_once_and_rounds_shuffle_few_rows_for_few_ranges(spark, monkeypatch):
    """Orders share one version and few ranges; what is judged is written, so Spark sees how few it is."""
    seen, own = {}, reports.stored

    def kept(df, name):
        seen.setdefault(name, []).append(own(df, name))
        return seen[name][-1]

    monkeypatch.setattr(reports, "stored", kept)
    g = graph_queries.held_graph(spark, SF)
    tested = g.versions.select("version").union(g.nodes.select("version")).distinct().count() * g.resolved.select("spec").distinct().count()
    found = audits.fix_chain(g, reports.audit(g), g.nodes.where("is_workspace").select("location"))
    assert found.count() > 0
    assert len(seen["let_in"]) == 2 and all(t.count() <= tested and t.distinct().count() == t.count() for t in seen["let_in"])
    assert len(seen["judged"]) >= 2 and seen["judged"][-1].isEmpty()


def test_let_in_keeps_every_row(spark):
    rows = spark.createDataFrame([("a", "1.2.3", "^1.0.0"), ("b", "1.2.3", "^1.0.0"), ("b", "2.0.0", "^1.0.0"), ("c", "1.2.3-pre", "^1.0.0"), ("d", "1.0.0", "file:x"), ("e", None, "*"), ("f", "no", "*"), ("g", "1.0.0", None)], "name string, version string, spec string")
    assert {(r.name, r.version): r._in for r in reports.let_in(rows).collect()} == {("a", "1.2.3"): True, ("b", "1.2.3"): True, ("b", "2.0.0"): False, ("c", "1.2.3-pre"): False, ("d", "1.0.0"): False, ("e", None): False, ("f", "no"): False, ("g", "1.0.0"): False}


def test_claims_shuffle_no_step_in_a_round(spark, monkeypatch):
    """Steps lie dealt out by where they start, whatever Spark may broadcast."""
    plans, own = [], trees.stored

    def kept(df, name):
        plans.extend([plan(df)] if name == "claims" else [])
        return own(df, name)

    monkeypatch.setattr(trees, "stored", kept)
    g = star.star_graph(spark, SF)
    assert trees.fund_tree(g.nodes, g.edges, F.col("location").endswith("3")).count() > 0
    rounds = plans[1:]
    assert len(rounds) > 3
    assert all("ShuffledHashJoin [src" in text and "Bucketed: true" in text and len(re.findall("Exchange hashpartitioning", text)) == 2 for text in rounds)


def test_peer_sets_fold_what_nothing_leads_to(spark, monkeypatch):
    written = []

    def noted(df, name, store=C.stored):
        out = store(df, name)
        written.append((name, out.count()))
        return out

    monkeypatch.setattr(C, "stored", noted)
    links = spark.sql("select concat('o', id) as src, concat('s', pmod(xxhash64(id, k), 50)) as dst, 'peer' as type from range(3000) cross join (select explode(sequence(1, 4)) as k)")
    assert G.peer_sets(links).groupBy("peer_set").count().collect()[0]["count"] == 3050
    names = [n for n, _ in written]
    assert names.count("folded") == 1 and names.count("drawn") <= 4
    assert all(n <= 50 for name, n in written if name not in ("folded", "links"))


def test_long_chains_are_joined_in_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(C, "stored", lambda df, name, store=C.stored: (rounds.append(name), store(df, name))[1])
    chain = spark.sql("select lpad(id, 5, '0') as src, lpad(id + 1, 5, '0') as dst from range(2000) union all select 'x', 'x' union all select 'z', 'y'")
    got = {r.location: r.least for r in C.least_joined(chain).collect()}
    assert got == {f"{k:05}": "00000" for k in range(2001)} | {"x": "x", "y": "y", "z": "y"}
    assert rounds.count("drawn") <= 25


def test_edges_of_a_listing_wait_without_what_is_known_of_their_ends(spark, monkeypatch):
    """And an end that is no node has its own place for each requirement."""
    waiting = []
    monkeypatch.setattr(trees, "dealt", lambda df, name, *keys, store=trees.dealt, **more: (waiting.append((name, df.columns)), store(df, name, *keys, **more))[1])
    nodes = G.complete(spark.createDataFrame([(x, x or "root", "1.0.0") for x in ("", "a", "b")], "location string, name string, version string"))
    edges = spark.createDataFrame([("", "a", "prod", "a", "*", None), ("", "b", "prod", "b", "2", "INVALID"), ("b", "x", "prod", "x", "*", None), ("a", "x", "prod", "x", "2", None), ("a", "x", "peer", "x", "1", None), ("b", "root", "peer", None, "1.0.0", "MISSING")], "src string, name string, type string, dst string, spec string, error string")
    rows = trees.ls_tree(G.Graph(nodes, edges), None).orderBy("n").collect()
    assert [("  " * r.level) + r.label for r in rows] == [
        "root@1.0.0", "  a@1.0.0", "    x@1", "    x@2 deduped", '  b@1.0.0 invalid: "2" from the root project', "    UNMET DEPENDENCY root@1.0.0", "    x@* deduped",
    ]
    assert not {"pkgid", "matches", "_at", "is_workspace", "spec"} & set(dict(waiting)["listed"])

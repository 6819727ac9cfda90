"""Every registered query with SQL against that SQL; the rest against plain rules."""

import pytest
from oracle import compare

from graphweft import graph_queries, queries  # noqa: F401
from graphweft.sources import star

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, SF), queries.SQL[name], SF) is None


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_without_sql_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_peer_sets_take_every_order(spark):
    got = {r["location"]: r["peer_set"] for r in queries.QUERIES["peer_sets"](spark, SF).collect()}
    pairs = {(f"orders/{r[0]}", f"supplier/{r[1]}") for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_suppkey").collect()}
    part, before = {x: x for p in pairs for x in p}, None
    while part != before:
        before = dict(part)
        for a, b in pairs:
            part[a] = part[b] = min(part[a], part[b])
    assert got == part


def test_explain_goes_on_to_the_root(spark):
    got = [r["path"] for r in queries.QUERIES["explain_paths"](spark, SF).collect()]
    own = {t: spark.read.parquet(f"{SF}/{t}.parquet").collect() for t in ("region", "nation", "customer", "supplier", "orders", "lineitem")}
    up = {}
    for src, dst in {
        *((f"nation/{r.n_nationkey}", f"region/{r.n_regionkey}") for r in own["nation"]),
        *((f"customer/{r.c_custkey}", f"nation/{r.c_nationkey}") for r in own["customer"]),
        *((f"supplier/{r.s_suppkey}", f"nation/{r.s_nationkey}") for r in own["supplier"]),
        *((f"orders/{r.l_orderkey}", f"supplier/{r.l_suppkey}") for r in own["lineitem"]),
        *((f"customer/{r.o_custkey}", f"orders/{r.o_orderkey}") for r in own["orders"]),
        *(("", f"customer/{r.c_custkey}") for r in own["customer"] if r.c_acctbal > 0),
    }:
        up.setdefault(dst, []).append(src)
    held = [[f"region/{r.r_regionkey}"] for r in own["region"] if r.r_name == "AFRICA"]
    want = list(held)
    while held:
        held = [[*p, x] for p in held for x in up.get(p[-1], ()) if x not in p]
        want += held
    assert sorted(got) == sorted(" < ".join(p) for p in want)


def test_reports_take_every_node(spark):
    g = star.star_graph(spark, SF)
    nodes = [(r.location, r.name, r.version) for r in g.nodes.select("location", "name", "version").collect()]
    into, out = {}, {}
    for src, dst in g.edges.where("dst is not null").select("src", "dst").collect():
        into.setdefault(dst, set()).add(src)
        out.setdefault(src, set()).add(dst)
    got = [tuple(r) for r in queries.QUERIES["query_report"](spark, SF).select("location", "name", "version", "n_from", "from", "to").collect()]
    told = lambda side, at: ",".join(sorted(side.get(at, ())))
    assert sorted(got) == sorted((at, name, version, len(into.get(at, ())), told(into, at), told(out, at)) for at, name, version in nodes)
    newest = {}
    for _, name, version in nodes:
        newest[name] = max(newest.get(name, (0, 0, 0)), tuple(map(int, version.split("."))))
    got = {r["name"]: r["version"] for r in queries.QUERIES["newest_by_name"](spark, SF).collect()}
    assert got == {name: ".".join(map(str, v)) for name, v in newest.items()}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

"""A property graph out of star-schema tables.

The root holds customers with a positive balance as workspaces; customers hold
orders; an order needs the parts of its lines (one of each name) and, as
peers, their suppliers; customers and suppliers need nations, nations regions.
The SQL is common to Spark and other engines, so that results can be held
against them.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.functions import semver
from graphweft.operators.closure import many
from graphweft.operators.graph import Graph, complete
from graphweft.storage import stored

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

#: A part's version: its brand number by fives, the rest, and its size.
PARTS = """select 'part/' || p_partkey as location, p_name as name,
 cast(cast((b - b % 5) / 5 as int) as varchar(9)) || '.' || cast(b % 5 as varchar(9)) || '.' || cast(p_size as varchar(9)) as version,
 p_type as kind, p_brand as brand, cast(p_size as varchar(9)) as size
 from (select *, cast(substr(p_brand, 7) as int) as b from {part}) z"""

NODES = f"""select '' as location, 'root' as name, '1.0.0' as version, 'root' as kind, cast(null as varchar(99)) as brand, cast(null as varchar(9)) as size
union all select 'region/' || r_regionkey, r_name, '1.0.0', 'region', null, null from {{region}}
union all select 'nation/' || n_nationkey, n_name, '1.0.0', 'nation', null, null from {{nation}}
union all select 'customer/' || c_custkey, c_name, '1.0.0', c_mktsegment, null, null from {{customer}}
union all select 'supplier/' || s_suppkey, s_name, '1.0.0', 'supplier', null, null from {{supplier}}
union all select 'orders/' || o_orderkey, 'order-' || o_orderkey, '1.0.0', o_orderpriority, null, o_orderstatus from {{orders}}
union all {PARTS}"""

#: The parts that orders need; {more} may name further columns of them.
PART_LINES = """select 'orders/' || l_orderkey as src, 'part/' || l_partkey as dst, p_name as name,
 case when p_size <= 10 then 'dev' when p_size <= 18 then 'optional' when l_returnflag = 'N' then 'prod' when l_returnflag = 'A' then 'dev' else 'optional' end as type,
 '^' || cast((l_linenumber - 1) % 5 + 1 as varchar(9)) || '.0.0' as spec{more}
 from (select l_orderkey, l_partkey, l_returnflag, l_linenumber, p_name, p_size{more},
  row_number() over (partition by l_orderkey, p_name order by l_linenumber, l_partkey, l_suppkey, l_returnflag) as rn
  from {lineitem} join {part} on p_partkey = l_partkey) pe where rn = 1"""
#: All the ranges that PART_LINES asks for.
PART_SPECS = tuple(f"^{k}.0.0" for k in range(1, 6))

OWN_EDGES = """select '' as src, 'customer/' || c_custkey as dst, c_name as name, 'workspace' as type, '*' as spec from {customer} where c_acctbal > 0
union all select 'customer/' || o_custkey, 'orders/' || o_orderkey, 'order-' || o_orderkey, 'prod', '*' from {orders}
union all select 'customer/' || c_custkey, 'nation/' || c_nationkey, n_name, 'prod', '*' from {customer} join {nation} on n_nationkey = c_nationkey"""
PEER_EDGES = "select distinct 'orders/' || l_orderkey, 'supplier/' || l_suppkey, 'supplier-' || l_suppkey, 'peer', '*' from {lineitem}"
PLACE_EDGES = """select 'supplier/' || s_suppkey, 'nation/' || s_nationkey, n_name, 'prod', '*' from {supplier} join {nation} on n_nationkey = s_nationkey
union all select 'nation/' || n_nationkey, 'region/' || n_regionkey, r_name, 'prod', '*' from {nation} join {region} on r_regionkey = n_regionkey"""

EDGES = f"{OWN_EDGES}\nunion all {PEER_EDGES}\nunion all {PLACE_EDGES} union all {PART_LINES.replace('{more}', '')}"


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}


#: Written graphs by application and folder.
_HELD: dict[tuple[str, str], Graph] = {}


def star_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph, with versions and advisories drawn from the parts. It is
    projected and written once for each application and folder; queries read
    the written tables, column by column."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _HELD:
        g = project(spark, sf_dir)
        _HELD[key] = replace(g, nodes=stored(g.nodes, "nodes"), edges=stored(g.edges, "edges"), versions=stored(g.versions, "versions"), advisories=stored(g.advisories, "advisories"))
    return replace(_HELD[key], _held={})


def project(spark: SparkSession, sf_dir: str) -> Graph:
    own = tables(spark, sf_dir)
    nodes = spark.sql(NODES, **own)
    # "*" is always met; only parts are asked for by ranges, and each range is tested once for each part
    brand = F.expr("cast(substr(p_brand, 7) as int)")
    version = semver.sv(F.concat_ws(".", F.floor(brand / 5), brand % 5, "p_size"))
    # (a bit for each, as lines carry it), and parts are never broadcast: they grow with the orders
    met = F.array_position(F.array(*map(F.lit, PART_SPECS)), F.col("spec"))
    mets = reduce(lambda a, b: a.bitwiseOR(b), [F.when(semver.in_range(version, spec), 1 << k).otherwise(0) for k, spec in enumerate(PART_SPECS)]).cast("tinyint")
    lines = spark.sql(PART_LINES.replace("{more}", ", mets"), lineitem=own["lineitem"], part=many(own["part"].withColumn("mets", mets)))
    wrong = F.when((met > 0) & (F.getbit("mets", F.greatest(met - 1, F.lit(0)).cast("int")) == 0), "INVALID")
    peers = _peers(own["lineitem"])
    plain = spark.sql(OWN_EDGES, **{t: own[t] for t in ("customer", "orders", "nation")}).union(peers).union(spark.sql(PLACE_EDGES, **{t: own[t] for t in ("supplier", "nation", "region")}))
    edges = plain.withColumn("error", F.lit(None).cast("string")).unionByName(lines.select("src", "dst", "name", "type", "spec", wrong.alias("error")))
    edges = edges.select("src", "dst", "name", "type", "spec", "error")
    package = F.to_variant_object(F.struct("name", "version", "kind", "brand", F.struct("size", F.split("name", " ").alias("words")).alias("detail")))
    nodes = nodes.withColumn("package", package).withColumn("is_root", F.col("location") == "").withColumn("is_workspace", F.col("location").startswith("customer/"))
    nodes = nodes.withColumn("realpath", F.concat(F.lit("/star/"), "location"))
    return Graph(complete(nodes), edges, "", "/star", versions=versions(spark, own["part"]), advisories=advisories(spark, own["part"]))


def _peers(lineitem: DataFrame) -> DataFrame:
    # pairs are told apart by their keys, before they become texts
    text = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    return lineitem.select("l_orderkey", "l_suppkey").distinct().select(text("orders/", "l_orderkey").alias("src"), text("supplier/", "l_suppkey").alias("dst"), text("supplier-", "l_suppkey").alias("name"), F.lit("peer").alias("type"), F.lit("*").alias("spec"))


def peer_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All the graph's peer edges, for what needs no others: where the graph
    isn't written yet, it isn't projected for them."""
    held = _HELD.get((spark.sparkContext.applicationId, sf_dir))
    return held.edges.where("type = 'peer'") if held else _peers(tables(spark, sf_dir)["lineitem"])


def versions(spark: SparkSession, part: DataFrame) -> DataFrame:
    """Every version of each part name; published so many days into 1996 as the part is large."""
    found = spark.sql(PARTS, part=part).groupBy("name", "version").agg(F.min(F.col("size").cast("int")).alias("days"))
    return found.select("name", "version", F.expr("timestamp'1996-01-01 00:00:00' + make_interval(0, 0, 0, days)").alias("published_at"))


#: Severity by the first letter of a name, and the range that it spoils.
SEVERITIES = (("b", "critical", "<2.0.0"), ("h", "high", ">=3.0.0"), ("o", "moderate", "1.0.0 - 2.9.9"), ("r", "low", "~4.1.0"))


def advisories(spark: SparkSession, part: DataFrame) -> DataFrame:
    names = part.select(F.col("p_name").alias("name")).distinct()
    severity, spoiled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for letter, level, range_ in SEVERITIES:
        severity = F.when(F.col("name").startswith(letter), level).otherwise(severity)
        spoiled = F.when(F.col("name").startswith(letter), range_).otherwise(spoiled)
    rows = names.select("name", F.concat(F.lit("ADV-"), "name").alias("id"), severity.alias("severity"), F.when(F.length("name") % 2 == 0, F.array(F.lit("CWE-79"))).otherwise(F.array().cast("array<string>")).alias("cwe"), spoiled.alias("vulnerable_versions"))
    return rows.where("severity is not null")

"""Registered queries over the star graph, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.functions import semver, text
from graphweft.operators import graph as G
from graphweft.operators import jsonpath, reports, search
from graphweft.operators.closure import closure, reached
from graphweft.operators.filediff import file_diff
from graphweft.operators.ordering import numbered
from graphweft.operators.resolve import ideal_trees
from graphweft.plans.compiler import select
from graphweft.sources import lockfile, star

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# --- common SQL --------------------------------------------------------------------

_P = {t: t for t in star.TABLES}
N, E = star.NODES.format(**_P), star.EDGES.format(**_P)
PART_V = "cast(split_part(version, '.', 1) as int) as a, cast(split_part(version, '.', 2) as int) as b, cast(split_part(version, '.', 3) as int) as c"
GRAPH = f"n as ({N}), e as materialized ({E}), major as (select location, cast(split_part(version, '.', 1) as int) as m from n), bad as (select e.* from e join major on location = dst where spec <> '*' and try_cast(substr(split_part(spec, '.', 1), 2) as int) <> m)"
VER = f"ver as (select distinct name, version, {PART_V}, cast(split_part(version, '.', 3) as int) as days from ({star.PARTS.format(**_P)}) p)"
ADV = "adv as (select distinct p_name as name, 'ADV-' || p_name as id, case when p_name like 'b%' then 'critical' when p_name like 'h%' then 'high' when p_name like 'o%' then 'moderate' when p_name like 'r%' then 'low' end as severity, length(p_name) % 2 = 0 as weak from part where p_name similar to '(b|h|o|r).*')"
HIT = "hit as (select n.location, n.name, n.version, id, severity, weak from n join adv on adv.name = n.name where case severity when 'critical' then cast(split_part(version, '.', 1) as int) < 2 when 'high' then cast(split_part(version, '.', 1) as int) >= 3 when 'moderate' then cast(split_part(version, '.', 1) as int) between 1 and 2 and not (split_part(version, '.', 1) = '2' and (cast(split_part(version, '.', 2) as int), cast(split_part(version, '.', 3) as int)) > (9, 9)) else split_part(version, '.', 1) = '4' and split_part(version, '.', 2) = '1' end)"


def nodes_of(where: str, more: str = "") -> str:
    return f"with recursive {GRAPH}{more} select location, name, version from n where {where}"


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def selector(name: str, text_: str, sql: str | None, **options) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return select(star.star_graph(spark, sf_dir), text_, **options).select("location", "name", "version")

    query(name, sql)(run)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- selectors ---------------------------------------------------------------------

W = "location like 'customer/%'"
selector("sel_universal", "*", nodes_of("true"))
selector("sel_id", "#NATION_3", nodes_of("name = 'NATION_3'"))
selector("sel_list_union", "[kind=BUILDING], [kind=region], #NATION_1", nodes_of("kind in ('BUILDING', 'region') or name = 'NATION_1'"))
selector("sel_compound", ".workspace[kind=BUILDING]:not(#Customer\\#000000001)", nodes_of(f"{W} and kind = 'BUILDING' and name <> 'Customer#000000001'"))
selector("sel_flagship", ":root > .workspace:not([kind=BUILDING])", nodes_of(f"{W} and kind <> 'BUILDING' and location in (select dst from e where src = '')"))
selector("sel_child", "[kind=BUILDING] > [kind=\"1-URGENT\"]", nodes_of("kind = '1-URGENT' and location in (select dst from e join n p on p.location = e.src where p.kind = 'BUILDING')"))
selector("sel_sibling", "[brand=\"Brand#3\"] ~ [kind=PROMO]", nodes_of("kind = 'PROMO' and brand <> 'Brand#3' and location in (select dst from e where src in (select src from e join n p on p.location = e.dst where p.brand = 'Brand#3'))"))
selector("sel_descendant", "[kind=BUILDING] [kind=region]", nodes_of("kind = 'region' and location in (select location from down)", ", down as (select e.dst as location from e join n p on p.location = e.src where p.kind = 'BUILDING' union select e.dst from e join down on down.location = e.src)"))
selector("sel_not", ":not([kind=PROMO])", nodes_of("kind <> 'PROMO'"))
selector("sel_is", ":is([kind=PROMO], [kind=ECONOMY])[size=5], :is(:root > [kind=BUILDING])", f"with recursive {GRAPH} select location, name, version from n where kind = 'BUILDING' and location in (select dst from e where src = '')")
selector("sel_has_child", ".workspace:has(> [kind=\"1-URGENT\"])", nodes_of(f"{W} and location in (select src from e join n c on c.location = e.dst where c.kind = '1-URGENT')"))
selector("sel_has_desc", "[kind=supplier]:has([kind=supplier] #ASIA)", nodes_of("kind = 'supplier' and location in (select e.src from e join e f on f.src = e.dst join n r on r.location = f.dst where r.name = 'ASIA')"))
selector("sel_attr_exists", "[brand]", nodes_of("brand is not null"))
selector("sel_attr_eq", "[kind=PROMO]", nodes_of("kind = 'PROMO'"))
selector("sel_attr_word", "[name~=ring]", nodes_of("list_contains(regexp_extract_all(name, '\\w+'), 'ring')"))
selector("sel_attr_contains", "[name*=ing]", nodes_of("contains(name, 'ing')"))
selector("sel_attr_dash", "[name|=order]", nodes_of("starts_with(name, 'order-')"))
selector("sel_attr_prefix", "[name^=small]", nodes_of("starts_with(name, 'small')"))
selector("sel_attr_suffix", "[name$=plate]", nodes_of("suffix(name, 'plate')"))
selector("sel_attr_ci", "[kind=promo i]", nodes_of("lower(kind) = 'promo'"))
selector("sel_attr_nested", ":attr(detail, [size=7])", nodes_of("size = '7'"))
selector("sel_attr_array", ":attr(detail, [words=red])", nodes_of("list_contains(string_split(name, ' '), 'red')"))
selector("sel_empty", ":empty", nodes_of("location not in (select src from e)"))
selector("sel_deduped", ":deduped", nodes_of("location in (select dst from e group by dst having count(*) > 1)"))
selector("sel_invalid", ":invalid", nodes_of("location in (select dst from bad)"))
selector("sel_root_scope", ":root, :scope", nodes_of("location = ''"))
selector("sel_type_range", ":type(range)", nodes_of("location in (select dst from e)"))
selector("sel_path_glob", ":path(part/*5)", nodes_of("regexp_full_match(location, 'part/[^/]*5')"))
selector("sel_semver_satisfies", ":semver(^2.1.0)", nodes_of("split_part(version, '.', 1) = '2' and cast(split_part(version, '.', 2) as int) >= 1"))
selector("sel_semver_cmp", ":semver(3.2.10, [version], gt)", nodes_of("(cast(split_part(version, '.', 1) as int), cast(split_part(version, '.', 2) as int), cast(split_part(version, '.', 3) as int)) > (3, 2, 10)"))
selector("sel_semver_infer", ":semver(1 - 2)", nodes_of("split_part(version, '.', 1) in ('1', '2')"))
selector("sel_semver_gtr", ":semver(<=2.3.0, [version], gtr)", nodes_of("(cast(split_part(version, '.', 1) as int), cast(split_part(version, '.', 2) as int), cast(split_part(version, '.', 3) as int)) > (2, 3, 0)"))
selector("sel_semver_ltr", ":semver(^1.1.1, [version], ltr)", nodes_of("(cast(split_part(version, '.', 1) as int), cast(split_part(version, '.', 2) as int), cast(split_part(version, '.', 3) as int)) < (1, 1, 1)"))
LED = "flagged_{t} as (select location from flags where {t}), up_{t} as (select location from flagged_{t} union select dst from e where type = '{t}' union select e.dst from e join up_{t} on up_{t}.location = e.src)"
REACH = "r_{k} as (select '' as location union select e.dst from e join r_{k} on r_{k}.location = e.src where {w})"
FREE = {"all": "type <> 'peerOptional'", "dev": "type <> 'dev'", "opt": "type not in ('optional', 'peerOptional')", "peer": "type not in ('peer', 'peerOptional')", "both": "type not in ('dev', 'optional', 'peerOptional')"}
FLAGS = ", " + ", ".join(REACH.format(k=k, w=w) for k, w in FREE.items()) + """, flags as (select location, location not in (select location from r_all) as extraneous, location not in (select location from r_dev) as dev,
 location not in (select location from r_opt) as optional, location not in (select location from r_peer) as peer, location not in (select location from r_both) as both_ from n)"""


def flagged_graph(spark: SparkSession, sf_dir: str) -> G.Graph:
    g = star.star_graph(spark, sf_dir)
    g.nodes = g.nodes.drop("extraneous", "dev", "optional", "peer", "dev_optional").join(G.dependency_flags(g.nodes, g.edges), "location")
    return g


def flag_selector(name: str, text_: str, where: str, more: str = "") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return select(flagged_graph(spark, sf_dir), text_).select("location", "name", "version")

    query(name, nodes_of(where, FLAGS + more))(run)


flag_selector("sel_extraneous", ":extraneous", "location in (select location from flags where extraneous)")
flag_selector("sel_prod", ".prod", "location in (select location from flags where not dev)")
for _t in ("dev", "optional", "peer"):
    flag_selector(f"sel_class_{_t}", f".{_t}", f"location in (select location from up_{_t})", ", " + LED.format(t=_t))


@query("sel_missing", f"with {GRAPH}, gone as (select location from n where location like 'part/%' and cast(size as int) > 45) select name, spec as version from e where dst in (select location from gone) and type not in ('optional', 'peerOptional')")
def sel_missing(spark, sf_dir):
    g = star.star_graph(spark, sf_dir)
    large = F.col("location").startswith("part/") & (F.split_part("version", F.lit("."), F.lit(3)).cast("int") > 45)
    gone = g.nodes.where(large).select(F.col("location").alias("dst"), F.lit(True).alias("_gone"))
    edges = g.edges.join(gone, "dst", "left").withColumn("dst", F.when(F.col("_gone").isNull(), F.col("dst"))).drop("_gone")
    g.edges = edges.withColumn("error", F.when(F.col("dst").isNull(), F.when(~F.col("type").isin("optional", "peerOptional"), "MISSING")).otherwise(F.col("error")))
    g.nodes = g.nodes.where(~large)
    return select(g, ":missing").select("name", "version")


def changed_selector(name: str, text_: str, where: str, change: Callable[[G.Graph], None]) -> None:
    """A selector over the graph with something that its tables don't have."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = star.star_graph(spark, sf_dir)
        change(g)
        return select(g, text_).select("location", "name", "version")

    query(name, nodes_of(where))(run)


KIND = "variant_get(package, '$.kind', 'string')"


def _linked(g: G.Graph) -> None:
    g.nodes = g.nodes.withColumn("is_link", F.expr(f"{KIND} = 'PROMO'"))


def _private(g: G.Graph) -> None:
    hidden = F.parse_json(F.when(F.expr(f"{KIND} = 'LARGE'"), '{"private":true}').otherwise('{"private":false}'))
    g.nodes = g.nodes.withColumn("package", hidden)


def _from_git(g: G.Graph) -> None:
    g.edges = g.edges.withColumn("spec", F.when(F.col("name").startswith("red"), "github:a/b").otherwise(F.col("spec")))


changed_selector("sel_link", ":link", "kind = 'PROMO'", _linked)
changed_selector("sel_private", ":private", "kind = 'LARGE'", _private)
changed_selector("sel_type_git", ":type(git)", "location in (select dst from e where starts_with(name, 'red'))", _from_git)

# --- outdated ----------------------------------------------------------------------

NEWER = "newer as (select n.location, n.name, n.version, v.version as other, v.days, cast(split_part(n.version, '.', 1) as int) as na, cast(split_part(n.version, '.', 2) as int) as nb, cast(split_part(n.version, '.', 3) as int) as nc, v.a, v.b, v.c from n join ver v on v.name = n.name where n.location <> '' and (v.a, v.b, v.c) > (cast(split_part(n.version, '.', 1) as int), cast(split_part(n.version, '.', 2) as int), cast(split_part(n.version, '.', 3) as int)))"
OUT = f"with {GRAPH}, {VER}, {NEWER} select distinct newer.location, newer.name, newer.version from newer"
IN_RANGE = "(e.spec = '*' or try_cast(substr(split_part(e.spec, '.', 1), 2) as int) = a)"
selector("outdated_any", ":outdated", OUT)
selector("outdated_major", ":outdated(major)", f"{OUT} where a <> na")
selector("outdated_minor", ":outdated(minor)", f"{OUT} where a = na and b <> nb")
selector("outdated_patch", ":outdated(patch)", f"{OUT} where a = na and b = nb")
selector("outdated_in_range", ":outdated(in-range)", f"{OUT} join e on e.dst = newer.location where {IN_RANGE}")
selector("outdated_out_of_range", ":outdated(out-of-range)", f"{OUT} join e on e.dst = newer.location where not ({IN_RANGE})")
selector("outdated_as_of", ":outdated", f"{OUT} where days <= 19", before="1996-01-20 00:00:00")


@query("outdated_report", f"""with {GRAPH}, {VER}, edge as (select e.*, n.version as current from e join n on n.location = e.dst where spec <> '*' and e.name in (select name from ver)),
 best as (select edge.src, edge.name, edge.type, edge.current, arg_max(v.version, (v.a, v.b, v.c)) filter (where v.a = try_cast(substr(split_part(edge.spec, '.', 1), 2) as int)) as wanted, arg_max(v.version, (v.a, v.b, v.c)) as latest from edge join ver v on v.name = edge.name group by all)
 select name, current, wanted, latest, src as dependent, type from best where wanted is not null and (current <> wanted or wanted <> latest)""")
def outdated_report(spark, sf_dir):
    return reports.outdated(star.star_graph(spark, sf_dir))


# --- vulnerabilities ---------------------------------------------------------------

selector("vuln_any", ":vuln", f"with {GRAPH}, {ADV}, {HIT} select distinct location, name, version from hit")
selector("vuln_severity", ":vuln([severity=high])", f"with {GRAPH}, {ADV}, {HIT} select distinct location, name, version from hit where severity = 'high'")
selector("vuln_cwe", ":vuln([cwe=79])", f"with {GRAPH}, {ADV}, {HIT} select distinct location, name, version from hit where weak")


@query("vuln_match", f"with {GRAPH}, {ADV}, {HIT} select location, name, version, id, severity from hit")
def vuln_match(spark, sf_dir):
    return reports.vulnerable_nodes(star.star_graph(spark, sf_dir)).select("location", "name", "version", "id", "severity")


@query("vuln_summary", f"with {GRAPH}, {ADV}, {HIT} select name, max(severity) as severity, count(distinct location) as n_nodes, bool_or(location in (select dst from e where src = '' or src like 'customer/%')) as is_direct from hit group by name")
def vuln_summary(spark, sf_dir):
    return reports.vulnerability_summary(star.star_graph(spark, sf_dir)).select("name", "severity", "n_nodes", "is_direct")


@query("vuln_counts", f"with {GRAPH}, {ADV}, {HIT}, s as (select distinct name, severity from hit) select count(*) filter (severity = 'info') as info, count(*) filter (severity = 'low') as low, count(*) filter (severity = 'moderate') as moderate, count(*) filter (severity = 'high') as high, count(*) filter (severity = 'critical') as critical, count(*) as total from s")
def vuln_counts(spark, sf_dir):
    return reports.severity_counts(reports.vulnerability_summary(star.star_graph(spark, sf_dir)))


@query("audit_fixpoint", f"""with {GRAPH}, {VER}, {ADV}, {HIT}, own as (select distinct name, version, severity, id as via from hit),
 judged as (select s.name, spec, max(own.severity) as severity from (select distinct name, spec from e where spec <> '*') s join ver on ver.name = s.name and try_cast(substr(split_part(spec, '.', 1), 2) as int) = a left join own on own.name = ver.name and own.version = ver.version group by all having count(*) = count(own.name)),
 orders_ as (select n.name, n.version, severity, e.name as via from e join judged using (name, spec) join n on n.location = e.src),
 levels as (select name, max(list_position(['low', 'moderate', 'high', 'critical'], severity)) as level from orders_ group by name),
 customers_ as (select n.name, n.version, ['low', 'moderate', 'high', 'critical'][level] as severity, e.name as via from e join levels using (name) join n on n.location = e.src)
 select name, version, severity, via from own union all select distinct * from orders_ union all select distinct * from customers_""")
def audit_fixpoint(spark, sf_dir):
    return reports.audit(star.star_graph(spark, sf_dir))


@query("audit_fix", f"with {GRAPH}, {VER}, {ADV}, {HIT}, spoiled as (select distinct name, version from hit), good as (select * from ver where (name, version) not in (select name, version from spoiled)), near as (select distinct good.name from good join (select distinct name, spec from e where spec <> '*') s on s.name = good.name and try_cast(substr(split_part(s.spec, '.', 1), 2) as int) = good.a) select distinct name, case when name in (select name from near) then 'in range' when name in (select name from good) then 'major' else 'none' end as fix from hit")
def audit_fix(spark, sf_dir):
    g = star.star_graph(spark, sf_dir)
    return reports.fix_available(reports.vulnerability_summary(g), g.versions, g.advisories, g.edges.select("name", "spec").distinct())


# --- closures ----------------------------------------------------------------------

TRANSITIONS = "select event_type as src, lead(event_type) over (partition by user_id order by ts, event_id) as dst from {events}"


@query("closure_cyclic", f"with recursive t as (select distinct src, dst from ({TRANSITIONS.format(events='events')}) x where dst is not null), r as (select src as seed, src as location from t union select r.seed, t.dst from r join t on t.src = r.location) select seed, location from r")
def closure_cyclic(spark, sf_dir):
    steps = spark.sql(TRANSITIONS, events=table(spark, sf_dir, "events")).where("dst is not null").distinct()
    return reached(steps, steps.select(F.col("src").alias("seed"), F.col("src").alias("location")).distinct()).select("seed", "location")


@query("closure_depth", f"with recursive {GRAPH}, r as (select '' as location, 0 as depth union select e.dst, r.depth + 1 from e join r on r.location = e.src) select location, min(depth) as depth from r group by location")
def closure_depth(spark, sf_dir):
    return closure(star.star_graph(spark, sf_dir).resolved, spark.createDataFrame([("",)], "location string")).select("location", "depth")


@query("dep_flags", f"with recursive {GRAPH}{FLAGS} select location, extraneous, dev, optional, peer, both_ and not dev and not optional as dev_optional from flags")
def dep_flags(spark, sf_dir):
    g = star.star_graph(spark, sf_dir)
    return G.dependency_flags(g.nodes, g.edges)


@query("workspace_closure", f"with recursive {GRAPH}, r as (select location from n where kind = 'BUILDING' union select e.dst from e join r on r.location = e.src) select location from r")
def workspace_closure(spark, sf_dir):
    g = star.star_graph(spark, sf_dir)
    return reached(g.descent(), g.nodes.where("is_workspace and variant_get(package, '$.kind', 'string') = 'BUILDING'").select("location"))


@query("closed_dep_set", f"""with recursive {GRAPH}, r as (select location from n where kind = 'BUILDING' union select e.dst from e join r on r.location = e.src),
 o as (select e.dst as location from e where e.src not in (select location from r) and e.dst in (select location from r) and e.dst not in (select location from n where kind = 'BUILDING')
  union select e.dst from e join o on o.location = e.src where e.dst not in (select location from n where kind = 'BUILDING'))
 select location from r where location not in (select location from o)""")
def closed_dep_set(spark, sf_dir):
    g = star.star_graph(spark, sf_dir)
    return G.closed_set(g.resolved, g.nodes.where("variant_get(package, '$.kind', 'string') = 'BUILDING'").select("location")).select("location")


@query("dep_counts", f"with recursive {GRAPH}{FLAGS} select count(*) filter (not dev and not optional and not peer) as prod, count(*) filter (dev) as dev, count(*) filter (optional) as optional, count(*) filter (peer) as peer, cast(0 as bigint) as \"peerOptional\", count(*) as total from flags where location <> ''")
def dep_counts(spark, sf_dir):
    return reports.dependency_counts(flagged_graph(spark, sf_dir).nodes)


@query("peer_sets")
def peer_sets(spark, sf_dir):
    return G.peer_sets(star.peer_edges(spark, sf_dir))


# --- reports -----------------------------------------------------------------------


@query("query_report", f"""with {GRAPH}, i as (select dst, string_agg(distinct src, ',' order by src) as c, count(distinct src) as k from e group by dst), o as (select src, string_agg(distinct dst, ',' order by dst) as c from e group by src)
 select n.location, n.name, n.version, '/star/' || n.location as realpath, coalesce(i.k, 0) as n_from, coalesce(i.c, '') as "from", coalesce(o.c, '') as "to", false as dev, false as in_bundle, false as deduped, false as overridden from n left join i on i.dst = n.location left join o on o.src = n.location""")
def query_report(spark, sf_dir):
    g = star.star_graph(spark, sf_dir)
    rows = reports.query_report(g, g.nodes)
    return rows.select("location", "name", "version", F.size("from").cast("long").alias("n_from"), F.array_join("to", ",").alias("to"), "realpath", F.array_join("from", ",").alias("from"), "dev", F.col("inBundle").alias("in_bundle"), "deduped", "overridden")


@query("dedupe_by_rank", f"with {GRAPH} select name, location, version from (select *, row_number() over (partition by name order by case when kind = 'PROMO' then 2 when kind = 'ECONOMY' then 1 else 0 end desc, location) rn from n) z where rn = 1")
def dedupe_by_rank(spark, sf_dir):
    n = star.star_graph(spark, sf_dir).nodes.withColumn("kind", F.expr("variant_get(package, '$.kind', 'string')"))
    rank = F.when(F.col("kind") == "PROMO", 2).when(F.col("kind") == "ECONOMY", 1).otherwise(0)
    return reports.one_a_place(n, "name", rank, "location").select("name", "location", "version")


@query("ls_depth2", f"with {GRAPH}, a as (select distinct dst from e where src = ''), b as (select distinct e.dst from e join a on a.dst = e.src where e.dst not in (select dst from a)) select '' as location, 0 as depth union all select dst, 1 from a union all select dst, 2 from b")
def ls_depth2(spark, sf_dir):
    return reports.tree(star.star_graph(spark, sf_dir), depth=1).select("location", "depth")


@query("ls_ancestors", f"with recursive {GRAPH}, up as (select location from n where kind = 'PROMO' and size = '7' union select e.src from e join up on up.location = e.dst) select location from up")
def ls_ancestors(spark, sf_dir):
    g = star.star_graph(spark, sf_dir)
    return reports.with_ancestors(g, select(g, "[kind=PROMO]:attr(detail, [size=7])"))


@query("problems", f"with recursive {GRAPH}{FLAGS} select distinct 'invalid' as problem, name, dst as location from bad union all select 'extraneous', n.name, n.location from n join flags using (location) where extraneous")
def problems(spark, sf_dir):
    return reports.problems(flagged_graph(spark, sf_dir))


@query("dup_names", f"with {GRAPH} select name, count(*) as n from n where location <> '' group by name having count(*) > 1")
def dup_names(spark, sf_dir):
    return reports.duplicate_names(star.star_graph(spark, sf_dir).nodes)


@query("license_hist", f"with {GRAPH}, h as (select kind as value, count(*) as n from n group by kind) select row_number() over (order by value is null, n desc, value) as rank, value, n from h")
def license_hist(spark, sf_dir):
    found = reports.histogram(star.star_graph(spark, sf_dir).nodes, F.expr("variant_get(package, '$.kind', 'string')"))
    return numbered(found, F.col("value").isNull(), F.desc("n"), "value", name="rank")


@query("index_values", "select distinct p_brand as value from part")
def index_values(spark, sf_dir):
    return reports.index_values(star.star_graph(spark, sf_dir).nodes, F.expr("try_variant_get(package, '$.brand', 'string')"))


LATER = "select location, case when kind = 'PROMO' then '9.0.0' else version end as version from n where kind <> 'ECONOMY' union all select 'new/' || location, version from n where kind = 'LARGE'"


def snapshots(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    n = star.star_graph(spark, sf_dir).nodes.select("location", "name", "version", F.expr("variant_get(package, '$.kind', 'string')").alias("kind"))
    later = n.where("kind <> 'ECONOMY'").withColumn("version", F.when(F.col("kind") == "PROMO", "9.0.0").otherwise(F.col("version")))
    new = n.where("kind = 'LARGE'").withColumn("location", F.concat(F.lit("new/"), "location"))
    return n.drop("kind"), later.unionByName(new).drop("kind")


@query("tree_diff", f"with {GRAPH}, l as ({LATER}) select coalesce(n.location, l.location) as location, case when n.location is null then 'ADD' when l.location is null then 'REMOVE' else 'CHANGE' end as action, n.version as was, l.version as will from n full join l on n.location = l.location where n.version is distinct from l.version")
def tree_diff(spark, sf_dir):
    return reports.tree_diff(*snapshots(spark, sf_dir))


@query("install_summary", f"with {GRAPH}, l as ({LATER}) select case when n.location is null then 'ADD' when l.location is null then 'REMOVE' else 'CHANGE' end as action, count(*) as n from n full join l on n.location = l.location where n.version is distinct from l.version group by 1")
def install_summary(spark, sf_dir):
    return reports.install_summary(reports.tree_diff(*snapshots(spark, sf_dir))).select("action", "n")


@query("lock_validate", f"with {GRAPH}, l as ({LATER}) select n.location, case when l.location is null then 'Missing: ' || name || '@' || n.version || ' from lock file' else 'Invalid: lock file''s ' || name || '@' || l.version || ' does not satisfy ' || name || '@' || n.version end as error from n left join l on n.location = l.location where n.version is distinct from l.version")
def lock_validate(spark, sf_dir):
    now, later = snapshots(spark, sf_dir)
    return reports.validate_lock(later, now)


@query("newest_by_name", f"with {GRAPH} select name, arg_max(version, ({', '.join(f"cast(split_part(version, '.', {k}) as int)" for k in (1, 2, 3))})) as version from n group by name")
def newest_by_name(spark, sf_dir):
    return reports.newest_by_name(star.star_graph(spark, sf_dir).nodes)


@query("sbom_dependencies", f"with {GRAPH}, r as (select location, name || '@' || version as ref from n), d as (select a.ref, b.ref as dep from e join r a on a.location = e.src join r b on b.location = e.dst) select r.ref, 'pkg:npm/' || r.ref as purl, count(distinct dep) as n_depends from (select distinct ref from r) r left join d on d.ref = r.ref group by r.ref")
def sbom_dependencies(spark, sf_dir):
    return reports.bill_components(star.star_graph(spark, sf_dir)).select("ref", "purl", F.size("depends_on").cast("long").alias("n_depends"))


@query("sbom_relationships", f"with {GRAPH}, r as (select location, 'SPDXRef-Package-' || replace(replace(name, '@', ''), '/', '.') || '-' || version as id from n) select distinct b.id as \"from\", case type when 'dev' then 'DEV_DEPENDENCY_OF' when 'optional' then 'OPTIONAL_DEPENDENCY_OF' else 'DEPENDENCY_OF' end as relation, a.id as \"to\" from e join r a on a.location = e.src join r b on b.location = e.dst")
def sbom_relationships(spark, sf_dir):
    return reports.bill_relationships(star.star_graph(spark, sf_dir))


@query("explain_paths", f"with recursive {GRAPH}, up as (select distinct src, dst from e), p as (select location, [location] as path from n where name = 'AFRICA' union all select up.src, list_append(path, up.src) from up join p on p.location = up.dst where not list_contains(path, up.src)) select array_to_string(path, ' < ') as path from p")
def explain_paths(spark, sf_dir):
    g = star.star_graph(spark, sf_dir)
    return reports.explain(g, g.nodes.where("name = 'AFRICA'")).select(F.array_join("path", " < ").alias("path"))


@query("brief_dependents", f"with {GRAPH}, d as (select distinct dst, src from e), r as (select dst as location, list(src order by src) as l from d group by dst) select location, array_to_string(l[1:2], ', ') as shown, greatest(len(l) - 2, 0) as more from r")
def brief_dependents(spark, sf_dir):
    return reports.brief_dependents(star.star_graph(spark, sf_dir).edges, 4).select("location", "shown", F.col("more").cast("long").alias("more"))


@query("printable", f"""with {GRAPH}, o as (select src, ',"edgesOut":[' || string_agg('{{"name":"' || e.name || '","type":"' || type || '","spec":"' || spec || '","to":"' || dst || '"' || case when spec <> '*' and try_cast(substr(split_part(spec, '.', 1), 2) as int) <> m then ',"error":"INVALID"' else '' end || '}}', ',' order by e.name, type, spec, dst) || ']' as edges from e join major on location = dst group by src)
 select location, '{{"name":"' || name || '","version":"' || version || '","location":"' || location || '"' || coalesce(edges, '') || '}}' as json from n left join o on src = location""")
def printable(spark, sf_dir):
    return reports.printable(star.star_graph(spark, sf_dir))


@query("tree_checks", f"""with {GRAPH}, twice as (select count(*) as c from e where type = 'workspace'), lone as (select count(*) as c from n where kind = 'supplier'),
 lost as (select count(*) as c from e where src like 'supplier/%'), past as (select count(*) as c from e where dst like 'supplier/%'), link as (select count(*) as c from n where kind = 'PROMO' and size = '7'), again as (select count(*) as c from n where kind = 'region')
 select 'duplicate edge' as "check", c as n from twice union all select 'duplicate location', c from again union all select 'edge from nowhere', c from lost
 union all select 'edge to nowhere', c from past union all select 'link without target', c from link union all select 'no single root', case when c > 0 then 1 else 0 end from lone""")
def tree_checks(spark, sf_dir):
    """On a graph with breaches of every kind: suppliers gone but their edges
    kept, regions and workspace edges doubled, a second root, some parts
    links to nothing."""
    g = star.star_graph(spark, sf_dir)
    kind = F.expr("variant_get(package, '$.kind', 'string')")
    dangling = (kind == "PROMO") & (F.expr("variant_get(package, '$.detail.size', 'string')") == "7")
    n = g.nodes.where(kind != "supplier").withColumn("is_link", dangling).withColumn("target_location", F.when(dangling, "nowhere"))
    roots = n.where("is_root").withColumn("location", F.lit("second"))
    g.nodes = n.unionByName(n.where(kind == "region")).unionByName(roots)
    g.edges = g.edges.unionByName(g.edges.where("type = 'workspace'"))
    return G.check_tree(g)


@query("tree_checks_sound", "select * from (values ('duplicate edge', 0::bigint), ('duplicate location', 0), ('edge from nowhere', 0), ('edge to nowhere', 0), ('link without target', 0), ('no single root', 0)) z(\"check\", n)")
def tree_checks_sound(spark, sf_dir):
    return G.check_tree(star.star_graph(spark, sf_dir))


# --- policies, registry views --------------------------------------------------------


@query("engine_check", "select 'part/' || p_partkey as location, p_name as name, '>=' || cast(p_size as varchar) as wants from part where p_size > 18")
def engine_check(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.concat(F.lit("part/"), "p_partkey").alias("location"), F.col("p_name").alias("name"), F.to_variant_object(F.struct(F.struct(F.concat(F.lit(">="), "p_size").alias("node")).alias("engines"))).alias("package"))
    return reports.engine_check(part, "18.0.0")


@query("extension_choice", f"with {GRAPH}, m as (select n.location, s.selector from n join (values ('new red', 'red ring', 3, 9), ('old red', 'red ring', 0, 2), ('two', 'red ring', 2, 2), ('plates', 'hot plate', 0, 9)) s(selector, name, lo, hi) on s.name = n.name and cast(split_part(version, '.', 1) as int) between lo and hi) select location, min(selector) as selector, count(*) as n from m group by location")
def extension_choice(spark, sf_dir):
    rows = [("new red", "red ring", ">=3.0.0"), ("old red", "red ring", "<3.0.0"), ("two", "red ring", "2.x"), ("plates", "hot plate", "*")]
    return reports.chosen_extension(star.star_graph(spark, sf_dir).nodes, spark.createDataFrame(rows, "selector string, name string, range string"))


@query("patch_choice", f"with {GRAPH} select location, case when version = '2.0.5' then 'exact' when split_part(version, '.', 1) = '2' and split_part(version, '.', 2) = '1' then 'narrow' when split_part(version, '.', 1) = '2' then 'wide' else 'any' end as selector, false as ambiguous from n where name = 'red ring'")
def patch_choice(spark, sf_dir):
    rows = [("exact", "red ring", "2.0.5"), ("narrow", "red ring", "~2.1.0"), ("wide", "red ring", "^2.0.0"), ("any", "red ring", None)]
    return reports.chosen_patch(star.star_graph(spark, sf_dir).nodes, spark.createDataFrame(rows, "selector string, name string, range string"))


@query("script_review", "select 'part/' || p_partkey as location, p_name as name, case when p_type = 'LARGE' and p_name = 'red ring' then 'deny' when p_name = 'red ring' then 'deny' when p_name = 'hot plate' then 'allow' end as verdict from part where p_type = 'LARGE'")
def script_review(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.concat(F.lit("part/"), "p_partkey").alias("location"), F.col("p_name").alias("name"), F.lit("1.0.0").alias("version"), F.to_variant_object(F.struct(F.struct(F.when(F.col("p_type") == "LARGE", "build").alias("install")).alias("scripts"))).alias("package"))
    policy = spark.createDataFrame([("red ring", None, True), ("red ring", "1.0.0", False), ("hot plate", None, True)], "name string, version string, allow boolean")
    return reports.script_review(G.complete(part), policy)


@query("signature_states", "select 'part/' || p_partkey as location, case when p_type = 'SMALL' then 'missing' when p_type = 'LARGE' then 'invalid' else 'verified' end as state from part")
def signature_states(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    key = F.concat(F.lit("part/"), "p_partkey")
    nodes = G.complete(part.select(key.alias("location"), key.alias("name"), F.lit("1.0.0").alias("version")))
    signed = part.where("p_type <> 'SMALL'").select(key.alias("name"), F.lit("1.0.0").alias("version"), (F.col("p_type") != "LARGE").alias("valid"))
    return reports.signature_states(nodes, signed)


@query("view_versions", f"with {VER} select version from ver where name = 'red ring' and a in (2, 3)")
def view_versions(spark, sf_dir):
    return reports.view_versions(star.star_graph(spark, sf_dir).versions, "red ring", "2 || 3").select("version")


@query("dist_tags", f"with {VER}, t as (select name, 'latest: ' || arg_max(version, (a, b, c)) as line, 0 as k from ver group by name union all select name, 'first: ' || arg_min(version, (a, b, c)), 1 from ver group by name union all select name, 'any: ' || arg_max(version, (a, b, c)), 1 from ver group by name) select row_number() over (order by name, k, line) as rank, name, line from t")
def dist_tags(spark, sf_dir):
    v = star.star_graph(spark, sf_dir).versions.withColumn("v", semver.sv(F.col("version")))
    tags = v.groupBy("name").agg(F.max_by("version", "v").alias("latest"), F.min_by("version", "v").alias("first"))
    told = tags.selectExpr("name", "stack(3, 'first', first, 'any', latest, 'latest', latest) as (tag, version)")
    return numbered(told, "name", F.col("tag") != "latest", "tag", name="rank").select("rank", "name", reports.tag_line().alias("line"))


@query("roster", "select row_number() over (order by c_name) as rank, c_name as name, case c_mktsegment when 'BUILDING' then 'builder' else c_mktsegment end as role from customer where c_nationkey = 3")
def roster(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("role"), F.col("c_nationkey").alias("team"))
    return reports.roster(rows, "team", 3, {"BUILDING": "builder"}, "role", "name").select("name", "role").transform(numbered, "name", name="rank")


@query("cache_keys", "select 'https://registry.example/red-ring/-/red-ring-' || l_linenumber || '.' || (l_partkey % 7) || '.' || l_suppkey || '.tgz' as key from lineitem where l_linenumber = 2 group by all")
def cache_keys(spark, sf_dir):
    keys = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("https://registry.example/red-ring/-/red-ring-"), "l_linenumber", F.lit("."), F.col("l_partkey") % 7, F.lit("."), "l_suppkey", F.lit(".tgz")).alias("key")).distinct()
    return reports.cache_keys(keys, "red-ring", "2.x")


@query("config_cascade", "select cast(c_nationkey as varchar) as key, max(case when c_mktsegment = 'BUILDING' then c_name end) as cli, max(case when c_mktsegment = 'MACHINERY' then c_name end) as env, coalesce(max(case when c_mktsegment = 'BUILDING' then c_name end), max(case when c_mktsegment = 'MACHINERY' then c_name end), 'none') as value from customer group by 1")
def config_cascade(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("key", F.col("c_nationkey").cast("string"))
    layer = lambda s: c.where(F.col("c_mktsegment") == s).groupBy("key").agg(F.max("c_name").alias("value"))
    cli, env = layer("BUILDING"), layer("MACHINERY")
    found = reports.config_cascade([("cli", cli), ("env", env), ("default", c.select("key", F.lit("none").alias("value")).distinct())])
    return found.join(cli.withColumnRenamed("value", "cli"), "key", "left").join(env.withColumnRenamed("value", "env"), "key", "left").select("key", "cli", "env", "value")


# --- documents ---------------------------------------------------------------------


@query("json_get", "select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def json_get(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("v", F.try_parse_json("props"))
    return e.select("event_id", F.try_variant_get(F.try_element_at(jsonpath.get(F.col("v"), "k"), F.lit("k")), "$", "long").alias("k"))


@query("json_multi_get", "select event_id, '{\"k\":' || cast(json_extract(props, '$.k') as bigint) || '}' as found from events")
def json_multi_get(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("v", F.try_parse_json("props"))
    return e.select("event_id", F.to_json(jsonpath.get_many(F.col("v"), ["k", "none.at[0]"])).alias("found"))


@query("json_set_delete", """select event_id, '{"k":[' || json_extract_string(props, '$.k') || ',null,"' || event_type || '"],"n":{"at":[' || user_id || ',' || event_id || ']}}' as props from events""")
def json_set_delete(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("doc", F.parse_json("props"))
    held = lambda c: F.to_variant_object(F.array(c))
    doc = jsonpath.set_variant(F.col("doc"), "n.at", held("user_id"))
    doc = jsonpath.set_variant(doc, "n.at[]", F.parse_json(F.col("event_id").cast("string")))
    doc = jsonpath.set_variant(jsonpath.set_variant(doc, "gone.x[1].y", held("event_id")), "k", F.to_variant_object(F.array(F.try_variant_get("doc", "$.k", "variant"))))
    doc = jsonpath.set_variant(doc, "k[2]", F.parse_json(F.to_json(F.array("event_type"))).cast("variant"))
    doc = jsonpath.set_variant(doc, "k[2]", F.try_variant_get(doc, "$.k[2][0]", "variant"), force=True)
    return e.select("event_id", F.to_json(jsonpath.delete_variant(jsonpath.delete_variant(doc, "gone"), "k[9]")).alias("props"))


@query("json_paths", """select event_id, case event_id % 3 when 0 then 'id,list,list[0],list[0].k,type' when 1 then 'id,list,type' else 'id,list,list[0],list[0].k,list[1],list[1].k,type' end as paths from events""")
def json_paths(spark, sf_dir):
    some = F.expr("case event_id % 3 when 0 then array(named_struct('k', 1, '_h', 2)) when 1 then array() else array(named_struct('k', 1, '_h', 2), named_struct('k', 3, '_h', 4)) end")
    doc = F.to_variant_object(F.struct(F.col("event_id").alias("id"), some.alias("list"), F.col("event_type").alias("type"), F.lit(1).alias("_own"), F.lit(2).alias("a.b")))
    found = jsonpath.field_paths(table(spark, sf_dir, "events").withColumn("doc", doc), "event_id", "doc")
    return found.groupBy(F.col("key").alias("event_id")).agg(F.array_join(F.sort_array(F.collect_list("path")), ",").alias("paths"))


@query("help_search_hits", "select doc_id, cast((length(lower(text)) - length(replace(lower(text), 'ring', ''))) / 4 as bigint) + cast((length(lower(text)) - length(replace(lower(text), 'tion', ''))) / 4 as bigint) as hits from documents where contains(lower(text), 'ring') or contains(lower(text), 'tion')")
def help_search_hits(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(F.lower("text").contains("ring") | F.lower("text").contains("tion"))
    return d.select("doc_id", (search.occurrences(F.col("text"), "ring") + search.occurrences(F.col("text"), "tion")).alias("hits"))


@query("help_search", """with d as (select doc_id, string_split_regex(text, '\\n+') as l from documents where contains(lower(text), 'ring') or contains(lower(text), 'idiot')),
 h as (select doc_id, l, array_to_string(list_transform(l, lambda x: case when contains(lower(x), 'ring') or contains(lower(x), 'idiot') then '1' else '0' end), '') as m from d),
 f as (select doc_id, l, array_to_string(list_transform(regexp_extract_all(m, '[01]1[01]?|1[01]?|0'), lambda x: repeat(case when contains(x, '1') then 'k' else '-' end, len(x))), '') as f from h),
 k as (select doc_id, l, list_filter(range(1, len(l) + 1), lambda i: f[i] = 'k') as keep from f),
 g as (select doc_id, list_transform(keep, lambda i: l[i]) as kept, list_transform(range(1, len(keep) + 1), lambda j: case when j > 1 and keep[j - 1] < keep[j] - 1 then '...' || chr(10) else '' end || l[keep[j]]) as lines, len(list_filter(range(2, len(keep) + 1), lambda j: keep[j - 1] < keep[j] - 1)) as gaps from k),
 c as (select *, list_sum(list_transform(kept, lambda x: (len(x) - len(replace(lower(x), 'ring', ''))) // 4)) as a, list_sum(list_transform(kept, lambda x: (len(x) - len(replace(lower(x), 'idiot', ''))) // 5)) as b from g)
 select doc_id, array_to_string(lines, chr(10)) as lines, cast((a > 0)::int + (b > 0)::int as int) as found, cast(a + b as bigint) as hits from c order by found desc, hits desc, len(lines) + gaps desc, doc_id limit 10""")
def help_search(spark, sf_dir):
    return search.help_search(table(spark, sf_dir, "documents"), ["ring", "idiot"]).select("doc_id", F.array_join("lines", "\n", "...").alias("lines"), "found", "hits")


@query("search_exclude", "select doc_id from documents where not (contains(lower(source || ' ' || lang || ' ' || text), 'idiot') or regexp_matches(lower(source || ' ' || lang || ' ' || text), 'src1[0-9]? '))")
def search_exclude(spark, sf_dir):
    words = search.search_words(F.col("source"), F.array("lang"), F.array("text"))
    return table(spark, sf_dir, "documents").where("text is not null").where(~search.excluded(words, ["idiot", "/src1[0-9]? /"])).select("doc_id")


@query("did_you_mean", "select name, distance from (select distinct p_name as name, cast(levenshtein('smal ringg', p_name) as int) as distance from part) z where distance < 4.0 order by distance, name limit 3")
def did_you_mean(spark, sf_dir):
    return search.suggestions(table(spark, sf_dir, "part").select(F.col("p_name").alias("name")), "smal ringg")


@query("fund_url_groups", "select host as url, string_agg(distinct lang, ', ' order by lang) as names from (select regexp_extract(url, '^(https?://[^/]+)', 1) as host, regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) as lang from pages where regexp_matches(url, '^https?://[^/?#]+')) z group by host")
def fund_url_groups(spark, sf_dir):
    p = table(spark, sf_dir, "pages").where(text.valid_web_address(F.col("url")))
    return reports.by_address(p.select(F.regexp_extract("url", "^(https?://[^/]+)", 1).alias("url"), F.regexp_extract("url", "^https?://[^/]+/([a-z]+)/", 1).alias("name")))


@query("funding_valid", "select page_id from pages where regexp_matches(url, '^https?://[^/?#]+')")
def funding_valid(spark, sf_dir):
    p = table(spark, sf_dir, "pages").withColumn("package", F.to_variant_object(F.struct(F.struct("url").alias("funding"))))
    return reports.funding(p, F.col("package")).select("page_id")


@query("file_diff")
def file_diff_query(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    a = p.select(F.col("p_name").alias("k"), "p_brand").groupBy("k").agg(F.array_join(F.sort_array(F.collect_list("p_brand")), "\n").alias("content")).select(F.col("k").alias("path"), "content", F.lit("100644").alias("mode"))
    b = p.where("p_size <= 40").select(F.col("p_name").alias("k"), "p_brand").groupBy("k").agg(F.array_join(F.sort_array(F.collect_list("p_brand")), "\n").alias("content")).select(F.col("k").alias("path"), "content", F.lit("100644").alias("mode"))
    return file_diff(a, b)


@query("file_diff_names", "select path from (select p_name as path, list(p_brand order by p_brand) as l, list(p_brand order by p_brand) filter (p_size <= 40) as m from part group by 1) z where l is distinct from m")
def file_diff_names(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    side = lambda q: q.groupBy(F.col("p_name").alias("path")).agg(F.array_join(F.sort_array(F.collect_list("p_brand")), "\n").alias("content")).withColumn("mode", F.lit("100644"))
    return file_diff(side(p), side(p.where("p_size <= 40")), name_only=True)


@query("format_bytes", "select o_orderkey, case when v < 1000 then cast(v as varchar) || ' B' when v < 1000000 then printf('%.1f', floor(v / 1000.0 * 10 + 0.5) / 10) || ' kB' else printf('%.1f', floor(v / 1000000.0 * 10 + 0.5) / 10) || ' MB' end as size from (select o_orderkey, cast(floor(o_totalprice) as bigint) * 4 as v from orders) z")
def format_bytes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.floor("o_totalprice").cast("long") * 4).alias("v"))
    return o.select("o_orderkey", text.format_bytes(F.col("v")).alias("size"))


@query("spec_types", f"with {GRAPH} select type, count(*) as n from (select case when name like 'small%' then 'alias' when name like 'red%' then 'git' when name like 'hot%' then 'remote' when name like 'old%' then 'directory' when spec = '*' then 'range' when spec = '^2.0.0' then 'version' when spec = '^3.0.0' then 'tag' when spec = '^4.0.0' then 'file' else 'range' end as type from e) z group by type")
def spec_types(spark, sf_dir):
    e = star.star_graph(spark, sf_dir).edges
    starts = lambda p: F.col("name").startswith(p)
    spec = F.when(starts("small"), "npm:x@1").when(starts("red"), "github:a/b").when(starts("hot"), "https://h.example/a.tgz").when(starts("old"), "file:../a").when(F.col("spec") == "^2.0.0", "2.0.0").when(F.col("spec") == "^3.0.0", "beta").when(F.col("spec") == "^4.0.0", "file:../a.tgz").otherwise(F.col("spec"))
    return e.select(text.spec_type(spec).alias("type")).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("ideal_trees")
def ideal_tree_query(spark, sf_dir):
    """A graph for each order: its parts are wanted, parts of one name compete."""
    own = star.tables(spark, sf_dir)
    edges = spark.sql(star.EDGES, **own).where("src like 'orders/%' and dst like 'part/%'")
    parts = spark.sql(star.PARTS, part=own["part"])
    wanted = edges.select(F.col("src").alias("graph_id"), F.lit(None).cast("string").alias("owner"), F.lit(None).cast("string").alias("owner_version"), "name", F.lit("prod").alias("type"), "spec")
    offered = edges.join(parts.select(F.col("location").alias("dst"), "version"), "dst").select(F.col("src").alias("graph_id"), F.col("name").alias("owner"), F.col("version").alias("owner_version"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("spec"))
    return ideal_trees(wanted.unionByName(offered))



# --- selectors by name and version, nodes by argument, edge choice -------------------

selector("sel_id_version", "#NATION_3@^1.0.0, #NATION_4@2", nodes_of("name = 'NATION_3'"))


def finding(name: str, wanted: str, where: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return reports.find_nodes(star.star_graph(spark, sf_dir), wanted).select("location", "name", "version")

    query(name, nodes_of(where))(run)


finding("find_by_location", "nation/3", "location = 'nation/3'")
finding("find_by_path", "/star/region/2", "location = 'region/2'")
finding("find_by_name", "red ring", "name = 'red ring'")
finding("find_by_range", "red ring@2 || 3", "name = 'red ring' and split_part(version, '.', 1) in ('2', '3')")


@query("edges_default", f"with {GRAPH} select src, dst, name from e where src = '' or src like 'customer/%'")
def edges_default(spark, sf_dir):
    return reports.select_edges(star.star_graph(spark, sf_dir)).select("src", "dst", "name")


@query("edges_by_name", f"with {GRAPH} select src, dst, name from e where name in ('red ring', 'ASIA')")
def edges_by_name(spark, sf_dir):
    return reports.select_edges(star.star_graph(spark, sf_dir), ["red ring", "ASIA"]).select("src", "dst", "name")


OUT_EDGES = f"with {GRAPH}, {VER}, edge as (select e.*, n.version as current from e join n on n.location = e.dst where spec <> '*' and e.name in (select name from ver))"


@query("outdated_tagged", f"""{OUT_EDGES}, tag as (select name, arg_min(version, (a, b, c)) as tagged from ver group by name),
 best as (select edge.src, edge.name, edge.type, edge.current, arg_max(v.version, (v.a, v.b, v.c)) filter (where v.a = try_cast(substr(split_part(edge.spec, '.', 1), 2) as int)) as wanted from edge join ver v on v.name = edge.name group by all)
 select name, current, wanted, tagged as latest, src as dependent, type from best join tag using (name) where wanted is not null and (current <> wanted or wanted <> tagged)""")
def outdated_tagged(spark, sf_dir):
    g = star.star_graph(spark, sf_dir)
    tags = g.versions.groupBy("name").agg(F.min_by("version", semver.sv(F.col("version"))).alias("version")).withColumn("tag", F.lit("latest"))
    return reports.outdated(g, tags=tags)


@query("outdated_before", f"""{OUT_EDGES}, old as (select * from ver where days <= 24),
 best as (select edge.src, edge.name, edge.type, edge.current, arg_max(v.version, (v.a, v.b, v.c)) filter (where v.a = try_cast(substr(split_part(edge.spec, '.', 1), 2) as int)) as wanted, arg_max(v.version, (v.a, v.b, v.c)) as latest from edge join old v on v.name = edge.name group by all)
 select name, current, wanted, latest, src as dependent, type from best where wanted is not null and (current <> wanted or wanted <> latest)""")
def outdated_before(spark, sf_dir):
    return reports.outdated(star.star_graph(spark, sf_dir), before="1996-01-25 00:00:00")


@query("outdated_folded", f"""{OUT_EDGES},
 best as (select edge.src, edge.dst, edge.name, edge.type, edge.current, arg_max(v.version, (v.a, v.b, v.c)) filter (where v.a = try_cast(substr(split_part(edge.spec, '.', 1), 2) as int)) as wanted, arg_max(v.version, (v.a, v.b, v.c)) as latest from edge join ver v on v.name = edge.name group by all)
 select name, count(*) as n, string_agg(concat_ws(' ', current, wanted, latest, src, type), ',' order by concat_ws(' ', current, wanted, latest, src, type)) as entries from best where wanted is not null and (current <> wanted or wanted <> latest) and type <> 'dev' group by name""")
def outdated_folded(spark, sf_dir):
    return reports.folded_by_name(reports.outdated(star.star_graph(spark, sf_dir), omit=("dev",))).select("name", F.size("entries").cast("long").alias("n"), F.array_join(F.array_sort(F.transform("entries", lambda x: F.concat_ws(" ", x["current"], x["wanted"], x["latest"], x["dependent"], x["type"]))), ",").alias("entries"))


@query("page_of_names", "select row_number() over (order by p_name, p_partkey) as rank, p_partkey as location, p_name as name from part qualify rank between 121 and 170")
def page_of_names(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("location"), F.col("p_name").alias("name"))
    found = numbered(reports.page(rows, ["name", "location"], 120, 50), "name", "location", name="rank")
    return found.withColumn("rank", F.col("rank") + 120)


@query("audit_request", f"with n as ({N}) select name, string_agg(distinct version, ',' order by version) as versions from n where location <> '' group by name")
def audit_request(spark, sf_dir):
    return reports.bulk_request(star.star_graph(spark, sf_dir).nodes).select("name", F.array_join("versions", ",").alias("versions"))


@query("audit_ranges", f"with {GRAPH}, {ADV}, {HIT} select name, case any_value(severity) when 'critical' then '<2.0.0' when 'high' then '>=3.0.0' when 'moderate' then '1.0.0 - 2.9.9' else '~4.1.0' end as ranges from hit group by name")
def audit_ranges(spark, sf_dir):
    return reports.vulnerability_summary(star.star_graph(spark, sf_dir)).select("name", "ranges")


@query("audit_fix_age", f"""with {VER}, asked as (select distinct name, m from ver, (select unnest([1, 2, 3, 4]) as m) z where name like 'b%' or name like 'h%'),
 good as (select asked.name, m, version, a, b, c, days from asked join ver using (name) where a = m and not (case when name like 'b%' then a < 2 else a >= 3 end))
 select name, '^' || m || '.0.0' as spec, arg_max(version, (a, b, c)) as fix from good group by name, m having min(days) > 20""")
def audit_fix_age(spark, sf_dir):
    g = star.star_graph(spark, sf_dir)
    specs = F.explode(F.array(*[F.lit(f"^{m}.0.0") for m in range(1, 5)])).alias("spec")
    wanted = g.versions.select("name").distinct().join(g.advisories.select("name", "vulnerable_versions"), "name").where("name like 'b%' or name like 'h%'").select("name", "vulnerable_versions", specs)
    return reports.fix_blocked_by_age(wanted, g.versions, "1996-01-21 00:00:00")


@query("parseable_nodes", f"with n as ({N}) select location || ':' || name || '@' || version || ':' || coalesce(brand, '') as value from n where location <> ''")
def parseable_nodes(spark, sf_dir):
    rows = star.star_graph(spark, sf_dir).nodes.where("not is_root").select("location", F.concat("name", F.lit("@"), "version").alias("id"), F.try_variant_get("package", "$.brand", "string").alias("brand"))
    return lockfile.parseable(rows, "location", "id", "brand")


@query("json_lines", "select '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' as value from region")
def json_lines(spark, sf_dir):
    return lockfile.json_lines(table(spark, sf_dir, "region").select("r_regionkey", "r_name"))


@query("place_ranks", "select p_partkey as location, case when p_size % 3 = 0 then case when p_size % 2 = 0 then 0 else 1 end else 2 end as rank from part")
def place_ranks(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("location"), reports.place_rank(F.col("p_partkey"), F.col("p_size") % 2 == 0, F.col("p_size") % 3 == 0).alias("rank"))


@query("licences", "select p_partkey as location, case when p_size % 7 < 6 then p_type end as licence from part")
def licences(spark, sf_dir):
    forms = ('{"license":"%s"}', '{"license":{"type":"%s"}}', '{"licence":"%s"}', '{"licenses":[{"type":"%s"},{"type":"other"}]}', '{"licenses":["%s"]}', '{"license":["%s"]}', '{"name":"%s"}')
    picked = F.element_at(F.array(*[F.format_string(f, "p_type") for f in forms]), (F.col("p_size") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("location"), reports.licence(F.parse_json(picked)).alias("licence"))


@query("platform", "select 'supplier/' || s_suppkey as location, case when s_suppkey % 4 < 2 then 'os' when s_suppkey % 3 = 0 then 'cpu' end as failed from supplier where s_suppkey % 4 < 2 or s_suppkey % 3 = 0")
def platform(spark, sf_dir):
    os = ('["darwin","win32"]', '["!linux"]', '["linux","!win32"]', "null")
    manifest = F.format_string('{"os":%s,"cpu":%s}', F.element_at(F.array(*map(F.lit, os)), (F.col("s_suppkey") % 4 + 1).cast("int")), F.when(F.col("s_suppkey") % 3 == 0, F.lit('["arm64"]')).otherwise(F.lit('["any"]')))
    nodes = table(spark, sf_dir, "supplier").select(F.concat(F.lit("supplier/"), "s_suppkey").alias("location"), F.col("s_name").alias("name"), F.parse_json(manifest).alias("package"))
    return reports.platform_check(nodes, "linux", "x64").select("location", "failed")


@query("identity", """select a.p_partkey as a, case when a.p_name <> b.p_name then false when a.p_size % 3 > 0 and b.p_size % 3 > 0 then a.p_brand = b.p_brand
 when a.p_size % 2 > 0 and b.p_size % 2 > 0 then a.p_type = b.p_type else a.p_size = b.p_size end as same from part a join part b on b.p_name = a.p_name and b.p_partkey = a.p_partkey + 1 or b.p_partkey = a.p_partkey + 7""")
def identity(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    size = F.col("p_size")
    node = F.struct(F.col("p_name").alias("name"), F.col("p_name").alias("package_name"), size.cast("string").alias("version"), F.lit(False).alias("is_link"), F.lit(None).cast("string").alias("target_location"), F.when(size % 3 > 0, F.col("p_brand")).alias("integrity"), F.when(size % 2 > 0, F.col("p_type")).alias("resolved"))
    a = part.select(F.col("p_partkey").alias("a"), node.alias("x"))
    b = part.select(F.explode(F.array(F.col("p_partkey") - 1, F.col("p_partkey") - 7)).alias("a"), F.col("p_partkey").alias("b"), node.alias("y"))
    pairs = a.join(b, "a").where((F.col("b") == F.col("a") + 7) | (F.col("x.name") == F.col("y.name")))
    return pairs.select("a", G.matches(F.col("x"), F.col("y")).alias("same"))


@query("can_replace", f"with {GRAPH} select location, coalesce(bool_and(spec = '*' or spec = '^2.0.0'), true) as ok from n left join e on dst = location and src <> '' group by location")
def can_replace(spark, sf_dir):
    g = star.star_graph(spark, sf_dir)
    candidates = g.nodes.select("location", F.lit("2.3.4").alias("version"))
    return G.can_replace(g.edges, candidates).select("location", "ok")


@query("optional_set", f"""with recursive {GRAPH}, up as (select 'part/1' as location union select e.src from e join up on up.location = e.dst where type not in ('optional', 'peerOptional')),
 s as (select location from up where location <> ''), r as (select location from s union select e.dst from e join r on r.location = e.src),
 o as (select e.dst as location from e where e.src not in (select location from r) and e.dst in (select location from r) and e.dst not in (select location from s)
  union select e.dst from e join o on o.location = e.src where e.dst not in (select location from s))
 select location from r where location not in (select location from o)""")
def optional_set(spark, sf_dir):
    return G.optional_set(star.star_graph(spark, sf_dir).edges, spark.createDataFrame([("part/1",)], "location string")).select("location")


# --- folders: nations hold customers and, the even ones, a region of their own ---------

FOLDERS = """select '' as location, 'root' as name, '1.0.0' as version
union all select 'node_modules/r' || r_regionkey, 'r' || r_regionkey, (r_regionkey + 1) || '.0.0' from {region}
union all select 'node_modules/n' || n_nationkey, 'n' || n_nationkey, '1.0.0' from {nation}
union all select 'node_modules/n' || n_nationkey || '/node_modules/r' || n_regionkey, 'r' || n_regionkey, (n_regionkey + 2) || '.0.0' from {nation} where n_nationkey % 2 = 0
union all select 'node_modules/n' || c_nationkey || '/node_modules/c' || c_custkey, 'c' || c_custkey, '1.0.0' from {customer}"""
NEEDS = """select 'node_modules/n' || c_nationkey || '/node_modules/c' || c_custkey as src, 'r' || n_regionkey as name, case when c_custkey % 3 > 0 then 'prod' else 'optional' end as type, '^' || (c_custkey % 5 + 1) || '.0.0' as spec from {customer} join {nation} on n_nationkey = c_nationkey
union all select 'node_modules/n' || c_nationkey || '/node_modules/c' || c_custkey, 'n' || c_nationkey, 'peer', '*' from {customer}
union all select 'node_modules/n' || c_nationkey || '/node_modules/c' || c_custkey, 'gone', case when c_custkey % 2 = 0 then 'optional' else 'prod' end, '^1.0.0' from {customer}
union all select 'node_modules/n' || n_nationkey, 'r' || n_regionkey, 'peer', '*' from {nation}"""
_FOUND = f"""need as ({NEEDS.format(**_P)}), placed as (select *, cast(regexp_extract(src, 'node_modules/n([0-9]+)', 1) as int) % 2 = 0 as own, split_part(src, '/node_modules/', 1) as nation from need),
 found as (select src, name, type, spec, case when name = 'gone' then null when name like 'n%' then 'node_modules/' || name when own then nation || '/node_modules/' || name else 'node_modules/' || name end as dst from placed)"""


def folders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    own = star.tables(spark, sf_dir)
    nodes = G.complete(spark.sql(FOLDERS, **{t: own[t] for t in ("region", "nation", "customer")}))
    return nodes, G.resolve_edges(nodes, spark.sql(NEEDS, **{t: own[t] for t in ("nation", "customer")}))


@query("edge_resolution", f"with {_FOUND} select src, name, dst from found")
def edge_resolution(spark, sf_dir):
    return folders(spark, sf_dir)[1].select("src", "name", "dst")


@query("edge_states", f"""with {_FOUND}, f as ({FOLDERS.format(**_P)}) select src, found.name, type, case when dst is null then case when type = 'prod' then 'MISSING' end when type = 'peer' and starts_with(dst, src || '/node_modules/') then 'PEER LOCAL'
 when spec <> '*' and split_part(version, '.', 1) <> substr(split_part(spec, '.', 1), 2) then 'INVALID' end as error from found left join f on f.location = dst""")
def edge_states(spark, sf_dir):
    nodes, edges = folders(spark, sf_dir)
    return G.edge_errors(edges, nodes).select("src", "name", "type", "error")


@query("folder_depths", f"select location, cast((length(location) - length(replace(location, 'node_modules/', ''))) / 13 as int) as depth, '' as top from ({FOLDERS.format(**_P)}) f")
def folder_depths(spark, sf_dir):
    return G.depths(folders(spark, sf_dir)[0]).select("location", "depth", "top")


@query("deepest_targets", f"""with f as ({FOLDERS.format(**_P)}) select location, case when location like '%node_modules/r%' then location when location like '%/node_modules/c%' then '' when location like 'node_modules/n%' then '' else location end as target from f""")
def deepest_targets(spark, sf_dir):
    nodes, edges = folders(spark, sf_dir)
    peers = edges.where("type = 'peer'").withColumn("name", F.lit("host"))
    return G.deepest_target(peers, nodes, "host").select("location", "target")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

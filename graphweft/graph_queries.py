"""Further registered queries over the star graph: trees, fixpoints and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphweft.functions import text
from graphweft.operators import audits, bills, diffs, extensions, fixpoints, reports, resolve, trees
from graphweft.operators.ordering import by_name, numbered
from graphweft.queries import ADV, GRAPH, HIT, LATER, PART_V, SQL, VER, query, snapshots
from graphweft.sources import star

# --- trees -------------------------------------------------------------------------

_STEP = "e.name || chr(1) || k.key"
_CLAIMS = f"""k as (select location, name, version, name || '@' || version as key, coalesce(try_cast(right(location, 1) as int) % 3 = 0, false) as funded from n),
 c as (select k.key, k.location, [{_STEP}] as path from e join k on k.location = e.dst where src = ''),
 o as (select k.key, k.location, list_append(c.path, {_STEP}) as path from c join e on e.src = c.location join k on k.location = e.dst where e.dst like 'orders/%'),
 leaf as (select key, location, path from (select k.key, k.location, list_append(o.path, {_STEP}) as path, row_number() over (partition by k.key order by o.path, e.name, e.dst) as rn from o join e on e.src = o.location join k on k.location = e.dst) z where rn = 1),
 na as (select key, location, path from (select k.key, k.location, list_append(u.path, {_STEP}) as path, row_number() over (partition by k.key order by u.path, e.name) as rn from (select * from c union all select * from leaf) u join e on e.src = u.location join k on k.location = e.dst where e.dst like 'nation/%') z where rn = 1),
 re as (select key, location, path from (select k.key, k.location, list_append(na.path, {_STEP}) as path, row_number() over (partition by k.key order by na.path, e.name) as rn from na join e on e.src = na.location join k on k.location = e.dst) z where rn = 1),
 claimed as (select t.key, t.location, path, len(path) as depth, k.name, k.version, k.funded from (select * from c union all select * from o union all select * from leaf union all select * from na union all select * from re) t join k using (location)),
 up as (select key, pos, split_part(path[pos], chr(1), 2) as above from (select key, path, depth, unnest(range(1, depth)) as pos from claimed) z),
 near as (select up.key, max(pos) as pos from up join claimed on claimed.key = above and funded group by up.key),
 placed as (select claimed.*, coalesce(pos, 0) as pos, split_part(path[pos], chr(1), 2) as place, list_transform(range(coalesce(pos, 0) + 1, depth + 1), lambda i: struct_pack(through := i < depth, name := split_part(path[i], chr(1), 1))) as way from claimed left join near using (key)),
 lost as (select key from (select key, row_number() over (partition by place, name order by way desc) as rn from placed where funded) z where rn > 1),
 hidden as (select key from lost union select up.key from up where above in (select key from lost))"""


@query("fund_tree", f"""with {GRAPH}, {_CLAIMS} select key, location, name, version, case when depth > 1 then split_part(path[depth - 1], chr(1), 2) end as parent, cast(depth as int) as depth, funded, place,
 funded and key not in (select key from hidden) as shown from placed""")
def fund_tree(spark, sf_dir):
    g = star.star_graph(spark, sf_dir)
    return trees.fund_tree(g.nodes, g.edges, F.expr("try_cast(right(location, 1) as int) % 3 = 0"))


def _listing(levels: int, first: str = "true", deeper: str = "true", cut: str = "true") -> str:
    """SQL of the listing, a level a pair of tables: all places, then those shown whole."""
    out = "k as (select location, name || '@' || version as pkgid from n), a0 as (select '' as location, null as src, pkgid, 0 as level, 0 as depth, '' as mark, null as type, [pkgid || chr(1) || location] as path, 0 as cur from k where location = ''), f0 as (select * from a0)"
    for j in range(1, levels + 1):
        known = " union all ".join(f"select location from f{i}" for i in range(j))
        out += f""", a{j} as (select e.dst as location, e.src, k.pkgid, {j} as level, p.cur + 1 as depth, e.type, list_append(p.path, k.pkgid || chr(1) || e.dst) as path, case when e.dst like 'customer/%' then 0 else p.cur + 1 end as cur
  from f{j - 1} p join e on e.src = p.location join k on k.location = e.dst where ({cut}) and (case when p.cur = 0 then {first} else {deeper} end)),
 m{j} as (select *, row_number() over (partition by location order by path) = 1 and location not in ({known}) as own from a{j}), f{j} as (select * from m{j} where own)"""
    return out + ", listed as (select location, src, level, depth, '' as mark, type, path, pkgid from a0" + "".join(f" union all select location, src, level, depth, case when own then '' else 'deduped' end, type, path, pkgid from m{j}" for j in range(1, levels + 1)) + ")"


_LISTED = """select row_number() over (order by path) as n, l.location, l.src, pkgid, cast(level as int) as level, cast(depth as int) as depth, mark, l.type, case when b.src is not null then '"' || b.spec || '" from ' || b.src end as invalid,
 pkgid || case when mark = 'deduped' then ' deduped' else '' end || case when b.src is not null then ' invalid: "' || b.spec || '" from ' || b.src else '' end as label from listed l left join bad b on b.src = l.src and b.dst = l.location"""
_SHOWN = ("n", "location", "src", "pkgid", "level", "depth", "mark", "type", "invalid", "label")


@query("ls_tree", f"with {GRAPH}, {_listing(5)} {_LISTED}")
def ls_tree(spark, sf_dir):
    return trees.ls_tree(star.star_graph(spark, sf_dir), None).select(*_SHOWN)


@query("ls_tree_shallow", f"""with {GRAPH}, {_listing(5, "e.type <> 'dev'", "true", "p.cur <= 1")} {_LISTED}""")
def ls_tree_shallow(spark, sf_dir):
    return trees.ls_tree(star.star_graph(spark, sf_dir), 1, omit=("dev",)).select(*_SHOWN)


_MATCH = "pkgid like 'A%' or pkgid like 'small%'"


@query("ls_tree_matching", f"""with {GRAPH}, {_listing(5, "e.src <> '' or k.pkgid similar to '.*[1-4]@1.0.0'")}, wanted as (select distinct unnest(list_transform(range(1, len(path) + 1), lambda i: path[:i])) as path from listed where {_MATCH}),
 kept as (select listed.* from listed semi join wanted using (path)) {_LISTED.replace('listed l', 'kept l')}""")
def ls_tree_matching(spark, sf_dir):
    g = star.star_graph(spark, sf_dir)
    few = g.nodes.where("is_workspace and name rlike '[1-4]$'").select("location")
    near = g.edges.join(few.select(F.col("location").alias("dst")), "dst", "left_semi").where("src = ''").unionByName(g.edges.where("src <> ''"))
    g.edges = near.select(*g.edges.columns)
    return trees.ls_tree(g, None, F.concat("name", F.lit("@"), "version").rlike("^(A|small)")).select(*_SHOWN)


# --- audits ------------------------------------------------------------------------

_AUDITED = f"audited as ({SQL['audit_fixpoint']})"


@query("audit_effects", f"""with {_AUDITED}, worst as (select name, max(list_position(['low', 'moderate', 'high', 'critical'], severity)) as level, string_agg(distinct via, ',' order by via) as via from audited group by name),
 caused as (select via, string_agg(distinct name, ',' order by name) as effects from audited group by via)
 select name, ['low', 'moderate', 'high', 'critical'][level] as severity, worst.via, coalesce(effects, '') as effects from worst left join caused on caused.via = name""")
def audit_effects(spark, sf_dir):
    told = audits.effects(reports.audit(star.star_graph(spark, sf_dir)))
    return told.select("name", "severity", F.array_join("via", ",").alias("via"), F.array_join("effects", ",").alias("effects"))


def held_graph(spark, sf_dir):
    """The graph below its root, where customers hold orders to patches of 1.0; every fifth order has a 1.5.0 too, every third a 2.0.0."""
    g = star.star_graph(spark, sf_dir)
    held = F.col("src").startswith("customer/") & F.col("dst").startswith("orders/")
    g.edges = g.edges.where("src <> ''").withColumn("spec", F.when(held, "~1.0.0").otherwise(F.col("spec")))
    orders = g.nodes.where("location like 'orders/%'").select("name", F.expr("try_cast(substring(name, 7) as bigint)").alias("k"))
    more = orders.where("k % 5 = 0").select("name", F.lit("1.5.0").alias("version")).union(orders.where("k % 3 = 0").select("name", F.lit("2.0.0")))
    g.versions = g.versions.unionByName(more.withColumn("published_at", F.lit("1996-02-01").cast("timestamp")))
    return g


@query("audit_fix_chain", f"""with {_AUDITED}, o as (select distinct name, cast(substr(name, 7) as bigint) as k from audited where name like 'order-%'),
 own as (select name, case when k % 5 = 0 then 2 when k % 3 = 0 then 1 else 0 end as rank, case when k % 5 = 0 or k % 3 = 0 then name end as fix_name, case when k % 5 = 0 then '1.5.0' when k % 3 = 0 then '2.0.0' end as fix_version from o),
 offered as (select * from own union all select distinct a.via, rank, fix_name, fix_version from audited a join own using (name) where a.via in (select name from audited) union all select distinct name, 3, null, null from audited),
 worst as (select *, row_number() over (partition by name order by rank, fix_name nulls first, fix_version nulls first) as rn from offered)
 select name, case rank when 0 then 'none' when 3 then 'within' else 'outside' end as fix, fix_name, fix_version, rank = 1 as major from worst where rn = 1""")
def audit_fix_chain(spark, sf_dir):
    g = held_graph(spark, sf_dir)
    return audits.fix_chain(g, reports.audit(g), g.nodes.where("is_workspace").select("location"))


_RANGES = ("<2.0.0 || 1.0.0 - 2.9.9", ">=3.0.0 || ~4.1.0", "~4.1.0 || <2.0.0 || >=99.0.0", "1.0.0 - 2.9.9 || >=4.0.0")


@query("audit_ranges_simple", f"""with {VER}, r as (select *, ['{"', '".join(_RANGES)}'][length(name) % 4 + 1] as range, case length(name) % 4 when 0 then a <= 2 when 1 then a >= 3 when 2 then a = 4 and b = 1 or a < 2 else a between 1 and 2 or a >= 4 end as inside from ver),
 z as (select *, row_number() over (partition by name order by a, b, c) as k, count(*) over (partition by name) as n from r), y as (select *, k - row_number() over (partition by name order by k) as run from z where inside),
 runs as (select name, range, run, min(k) as lo, max(k) as hi, any_value(n) as n, arg_min(version, k) as first, arg_max(version, k) as last from y group by name, range, run),
 told as (select name, range, string_agg(case when hi = n and lo = 1 then '*' when hi = n then '>=' || first when lo = hi then first when lo = 1 then '<=' || last else first || ' - ' || last end, ' || ' order by lo) as simple from runs group by name, range)
 select distinct r.name, r.range, case when length(coalesce(simple, '')) < length(r.range) then coalesce(simple, '') else r.range end as simple from r left join told using (name)""")
def audit_ranges_simple(spark, sf_dir):
    v = star.star_graph(spark, sf_dir).versions
    ranges = v.select("name", F.element_at(F.array(*map(F.lit, _RANGES)), F.length("name") % 4 + 1).alias("range"))
    return audits.simple_ranges(ranges, v)


# --- overrides ---------------------------------------------------------------------

#: A supplier that orders of two workspaces need, the first, and the first and last of those.
_SHARED = "select l_suppkey as s, min(c_name) as a, max(c_name) as b from (select distinct l_suppkey, c_name from {lineitem} join {orders} on o_orderkey = l_orderkey join {customer} on c_custkey = o_custkey where c_acctbal > 0) z group by l_suppkey having count(*) > 1 order by l_suppkey limit 1"


def _fold(of: str) -> str:
    return "case when bool_or(R in (3, 4)) then case when bool_or(R = 4) then 4 else 3 end when bool_or(R = 6) then 6 when bool_or(R = 5) then 5 when bool_or(R = 0) then 0 end".replace("R", of)


@query("override_states", f"""with {GRAPH}, pick as ({_SHARED.format(**{t: t for t in star.TABLES})}), one as (select p_name from part where p_partkey = 1),
 cs as (select dst as location, case when name = (select a from pick) then 3 when name = (select b from pick) then 5 else 0 end as state from e where src = ''),
 os as (select e.dst as location, state from e join cs on cs.location = e.src where e.dst like 'orders/%'),
 oe as (select e.*, case when state is null then null when e.name = (select p_name from one) and spec = '^2.0.0' then 2 when e.name = 'supplier-' || (select s from pick) and state = 3 then 4 when e.name = 'supplier-' || (select s from pick) and state = 5 then 6 else state end as rule from e left join os on os.location = e.src where e.src like 'orders/%'),
 ss as (select dst as location, {_fold('rule')} as state from oe where dst like 'supplier/%' group by dst),
 ne as (select e.*, coalesce(cs.state, ss.state) as rule from e left join cs on cs.location = e.src left join ss on ss.location = e.src where e.src like 'customer/%' or e.src like 'supplier/%'),
 ns as (select dst as location, {_fold('rule')} as state from ne where dst like 'nation/%' group by dst),
 re as (select e.*, case when state is null then null when e.name = 'ASIA' then 1 else state end as rule from e left join ns on ns.location = e.src where e.src like 'nation/%'),
 ruled as (select e.*, state as rule, cast(null as int) as target from e join cs on cs.location = e.dst where src = '' union all select oe.*, ss.state from oe left join ss on ss.location = dst union all select ne.*, ns.state from ne left join ns on ns.location = dst union all select re.*, null from re),
 told as (select ruled.*, coalesce(rule in (3, 4) and target in (5, 6) or rule in (5, 6) and target in (3, 4), false) as conflict,
  case when rule = 1 then '1.0.0' when rule = 2 then '>=3.0.0' when rule = 4 and ruled.name like 'supplier-%' then '2.0.0' when rule = 6 and ruled.name like 'supplier-%' then '3.0.0' else spec end as said,
  case when rule = 2 then m >= 3 when rule in (4, 6) and ruled.name like 'supplier-%' then false when spec = '*' then true else m = cast(substr(split_part(spec, '.', 1), 2) as int) end as valid from ruled join major on location = dst)
 select src, name, dst, type, spec as raw_spec, said as spec, cast(rule as int) as rule, case when not valid or conflict then 'INVALID' end as error, conflict from told""")
def override_states(spark, sf_dir):
    g = star.star_graph(spark, sf_dir)
    own = star.tables(spark, sf_dir)
    two = spark.sql(_SHARED, **{t: own[t] for t in ("lineitem", "orders", "customer")}).first()
    one = own["part"].where("p_partkey = 1").first()["p_name"]
    shared = f"supplier-{two['s']}"
    return fixpoints.override_states(g.nodes, g.edges, {"ASIA": "1.0.0", f"{one}@^2.0.0": ">=3.0.0", two["a"]: {shared: "2.0.0"}, two["b"]: {shared: "3.0.0"}})


# --- levels, content keys, links ---------------------------------------------------


@query("dependency_levels", f"with recursive {GRAPH}, ne as (select distinct a.name as a, b.name as b from e join n a on a.location = e.src join n b on b.location = e.dst), r as (select distinct name, 0 as level from n where name not in (select a from ne) union select a, level + 1 from ne join r on r.name = ne.b) select name, cast(max(level) as int) as level from r group by name")
def dependency_levels(spark, sf_dir):
    g = star.star_graph(spark, sf_dir)
    return fixpoints.name_levels(g.nodes, g.resolved)


_KEY = "id || '-' || substr(sha256(content || '|' || id), 1, 32)"


def _keyed(name: str, where: str, below: str) -> str:
    """SQL of the keys of one level of single nodes."""
    return f"""{name} as (select location, {_KEY} as key from (select x.location, x.id, sha256(concat_ws('|', x.id, '', coalesce(string_agg(distinct x.id || '>' || b.key, ',' order by x.id || '>' || b.key), ''))) as content from i x left join e on e.src = x.location left join {below} b on b.location = e.dst where {where} group by x.location, x.id) z)"""


@query("store_keys", f"""with {GRAPH}, i as (select location, name || '@' || version as id from n),
 ring as (select location, 'region/' || case when location like 'nation/%' then (select cast(n_regionkey as varchar) from nation where 'nation/' || n_nationkey = location) else split_part(location, '/', 2) end as c, id from i where location like 'region/%' or location like 'nation/%'),
 pairs as (select a.c, a.id || '>' || b.id as p from e join ring a on a.location = e.src join ring b on b.location = e.dst union all select a.c, b.id || '>' || a.id from e join ring a on a.location = e.src join ring b on b.location = e.dst),
 body as (select m.c, sha256(m.ids || '|' || p.ps || '|') as content from (select c, string_agg(id, ',' order by id) as ids from ring group by c) m join (select c, string_agg(p, ',' order by p) as ps from pairs group by c) p using (c)),
 k0 as (select location, {_KEY} as key from ring join body using (c)),
 {_keyed('k1', "x.location like 'part/%'", '(select null as location, null as key)')}, {_keyed('k2', "x.location like 'supplier/%'", 'k0')}, k3 as (select * from k1 union all select * from k2),
 {_keyed('k4', "x.location like 'orders/%'", 'k3')}, k5 as (select * from k0 union all select * from k4), {_keyed('k6', "x.location like 'customer/%'", 'k5')}, {_keyed('k7', "x.location = ''", 'k6')}
 select * from k0 union all select * from k3 union all select * from k4 union all select * from k6 union all select * from k7""")
def store_keys(spark, sf_dir):
    g = star.star_graph(spark, sf_dir)
    back = g.resolved.where("src like 'nation/%'").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return fixpoints.content_keys(g.nodes, g.resolved.select("src", "dst").union(back), F.concat("name", F.lit("@"), "version"))


@query("link_targets", """with n as (select max(p_partkey) as n from part), t as (select p_partkey as i, cast(ceil(p_partkey / 100.0) as bigint) * 100 as e from part),
 r as (select i, case when e > n then 'l/' || (n + 1) when (e // 100 - 1) % 3 <> 1 then 'real/' || e end as real, e <= n and (e // 100 - 1) % 3 = 1 as loops from t, n)
 select 'l/' || i as location, real, loops from r union all select 'd/' || i, real || '/sub', loops from r where i % 10 = 0""")
def link_targets(spark, sf_dir):
    own = star.tables(spark, sf_dir)["part"]
    i = F.col("p_partkey")
    end = F.when(((i / 100).cast("long") - 1) % 3 == 1, F.concat(F.lit("l/"), i - 99)).otherwise(F.concat(F.lit("real/"), i))
    chain = own.select(F.concat(F.lit("l/"), i).alias("location"), F.when(i % 100 == 0, end).otherwise(F.concat(F.lit("l/"), i + 1)).alias("target"))
    inner = own.where(i % 10 == 0).select(F.concat(F.lit("d/"), i), F.concat(F.lit("l/"), i, F.lit("/sub")))
    return fixpoints.link_targets(chain.union(inner))


# --- bills, items, explanations ----------------------------------------------------

_REACHED = "r as (select '' as location union select e.dst from e join r on r.location = e.src)"


@query("sbom_document", f"""with recursive {GRAPH}, {_REACHED}, b as (select n.location, name, version, name || '@' || version as ref from n join r using (location)),
 f as (select * from b where location <> '' qualify row_number() over (partition by ref order by location) = 1),
 d as (select x.ref, string_agg(distinct '"' || y.ref || '"', ',' order by '"' || y.ref || '"') as needs from e join (select * from f union all select * from b where location = '') x on x.location = e.src join b y on y.location = e.dst group by x.ref),
 c as (select ref, '{{"bom-ref":"' || ref || '","type":"library","name":"' || name || '","version":"' || version || '","scope":"required","purl":"pkg:npm/' || ref || '","properties":[],"externalReferences":[]}}' as value from (select * from f union all select * from b where location = '') z),
 lines as (select 0 as s, '' as k, '{{"$schema":"http://cyclonedx.org/schema/bom-1.5.schema.json","bomFormat":"CycloneDX","specVersion":"1.5","serialNumber":"urn:uuid:0","version":1,"metadata":{{"timestamp":"1996-01-01T00:00:00Z","lifecycles":[{{"phase":"build"}}],"tools":[{{"name":"graphweft"}}],"component":' || (select value from c where ref = 'root@1.0.0') || '}},"components":[' as value
  union all select 1, ref, value || case when ref = (select max(ref) from f) then '' else ',' end from c where ref <> 'root@1.0.0' union all select 2, '', '],"dependencies":['
  union all select 3, case when ref = 'root@1.0.0' then '' else ref end, '{{"ref":"' || ref || '","dependsOn":[' || coalesce(needs, '') || ']}}' || case when ref = (select max(ref) from f) then '' else ',' end from c left join d using (ref) union all select 4, '', ']}}')
 select row_number() over (order by s, k) as n, value from lines""")
def sbom_document(spark, sf_dir):
    g = star.star_graph(spark, sf_dir)
    return bills.cyclonedx(g, bills.selection(g), "0", "1996-01-01T00:00:00Z")


@query("sbom_selected", f"""with recursive {GRAPH}, {_REACHED}, d as (select dst as location from e where type = 'dev' union select e.dst from e join d on d.location = e.src)
 select location from r where location not in (select location from d) or location = ''""")
def sbom_selected(spark, sf_dir):
    return bills.selection(star.star_graph(spark, sf_dir), omit=("dev",)).select("location")


@query("bill_errors", f"with recursive {GRAPH}, {_REACHED} select distinct 'invalid: ' || a.name || '@' || a.version || ', ' || spec || ' required by ' || b.name || '@' || b.version as error from bad join n a on a.location = dst join n b on b.location = src join r on r.location = src")
def bill_errors(spark, sf_dir):
    g = star.star_graph(spark, sf_dir)
    return bills.bill_errors(g, bills.selection(g))


@query("query_items", f"""with {GRAPH}, i as (select dst, string_agg(src, ',' order by src) as c, count(*) as k from e group by dst), o as (select src, string_agg(dst, ',' order by dst) as c from e group by src)
 select name || '@' || version as pkgid, location, '/star' || case when location = '' then '' else '/' || location end as path, '/star/' || location as realpath, cast(null as varchar) as resolved,
 '{{"brand":' || coalesce('"' || brand || '"', 'null') || ',"detail":{{"size":' || coalesce('"' || size || '"', 'null') || ',"words":["' || replace(name, ' ', '","') || '"]}},"kind":"' || kind || '","name":"' || name || '","version":"' || version || '"}}' as manifest,
 coalesce(i.c, '') as from_, coalesce(o.c, '') as to_, false as dev, false as in_bundle, coalesce(i.k, 0) > 1 as deduped, false as overridden from n left join i on i.dst = location left join o on o.src = location""")
def query_items(spark, sf_dir):
    g = star.star_graph(spark, sf_dir)
    joined = lambda c: F.array_join(c, ",")
    return reports.query_items(g, g.nodes, strict_compat=False).withColumns({"from_": joined("from"), "to_": joined("to"), "in_bundle": F.col("inBundle"), "manifest": F.to_json("manifest")}).drop("from", "to", "inBundle")


@query("explain_dependents", f"""with recursive {GRAPH}, ok as (select e.*, b.src is not null as wrong from e left join bad b on b.src = e.src and b.dst = e.dst where b.src is null or e.src = ''),
 up as (select location, 0 as depth from n where name = 'AFRICA' or location = 'part/2' union select ok.src, depth + 1 from ok join up on up.location = ok.dst), near as (select location, min(depth) as depth from up group by location)
 select near.location, n.name, n.version, near.location like 'customer/%' as is_workspace, cast(near.depth as int) as depth, ok.src as dependent, ok.type, ok.name as edge, ok.spec, case when wrong then 'INVALID' end as error from near join n using (location) left join ok on ok.dst = near.location""")
def explain_dependents(spark, sf_dir):
    g = star.star_graph(spark, sf_dir)
    return reports.explain_dependents(g, g.nodes.where("name = 'AFRICA' or location = 'part/2'")).drop("bundled")


@query("inert_nodes", f"""with recursive {GRAPH}, fail as (select location from n where location like 'part/%' and cast(size as int) between 11 and 12 and location in (select dst from e where type = 'optional') and location not in (select dst from e where type <> 'optional')),
 up as (select location from fail union select e.src from e join up on up.location = e.dst where type not in ('optional', 'peerOptional')),
 s as (select location from up where location <> ''), r as (select location from s union select e.dst from e join r on r.location = e.src),
 o as (select e.dst as location from e where e.src not in (select location from r) and e.dst in (select location from r) and e.dst not in (select location from s)
  union select e.dst from e join o on o.location = e.src where e.dst not in (select location from s))
 select n.location, n.location in (select location from r where location not in (select location from o)) as inert from n""")
def inert_nodes(spark, sf_dir):
    g = star.star_graph(spark, sf_dir)
    sized = g.nodes.where("location like 'part/%' and variant_get(package, '$.detail.size', 'int') between 11 and 12")
    only = g.resolved.groupBy(F.col("dst").alias("location")).agg(F.bool_and(F.col("type") == "optional").alias("only")).where("only")
    return resolve.mark_inert(g.nodes, g.edges, sized.join(only, "location", "left_semi"))


@query("query_context", f"""with {GRAPH}, {VER}, {ADV}, {HIT}, h as (select location, string_agg(id || ' ' || severity, ',') as advisories from hit group by location),
 o as (select location, string_agg(ver.version, ',' order by ver.a desc, ver.b desc, ver.c desc) as versions from (select location, name, {PART_V} from n) m join ver using (name) where (ver.a, ver.b, ver.c) > (m.a, m.b, m.c) group by location)
 select n.location, coalesce(advisories, '') as advisories, coalesce(versions, '') as versions from n left join h using (location) left join o using (location)""")
def query_context(spark, sf_dir):
    g = star.star_graph(spark, sf_dir)
    listed = lambda advisories: F.array_join(F.array_sort(F.transform(advisories, lambda a: F.concat_ws(" ", a["id"], a["severity"]))), ",")
    told = reports.query_context(g, g.nodes, advisories=listed, versions=lambda newer: F.array_join(newer, ","))
    return told.select("location", F.coalesce("advisories", F.lit("")).alias("advisories"), F.coalesce("versions", F.lit("")).alias("versions"))


# --- differences -------------------------------------------------------------------

_NOW = "select 'part/' || p_partkey as location, p_size || '.0.0' as version, case when p_partkey % 2 = 0 then 'sha512-a sha1-b' end as integrity, case when p_partkey % 3 = 0 then 'r1' end as resolved, case when p_partkey % 19 = 0 then 'p1' end as patch, false as in_bundle, p_partkey as i from {part}"
_THEN = """select 'part/' || p_partkey as location, case when p_partkey % 13 = 0 then '9' else p_size || '' end || '.0.0' as version, case when p_partkey % 2 = 0 then case when p_partkey % 5 = 0 then 'sha512-c' else 'sha1-b' end when p_partkey % 7 = 0 then 'sha512-a' end as integrity,
 case when p_partkey % 3 = 0 then case when p_partkey % 9 = 0 then 'r2' else 'r1' end end as resolved, case when p_partkey % 38 = 0 then 'p1' end as patch, false as in_bundle, p_partkey as i from {part} where p_partkey % 11 > 0
 union all select 'more/' || p_partkey, '1.0.0', null, null, null, p_partkey % 2 = 0, p_partkey from {part} where p_partkey % 17 = 0"""


@query("diff_actions", f"""with a as ({_NOW.format(part='part')}), b as ({_THEN.format(part='part')}) select coalesce(a.location, b.location) as location, case when b.location is null then 'REMOVE' when a.location is null then 'ADD' else 'CHANGE' end as action, a.version as was, b.version as will
 from a full join b on a.location = b.location where b.location is null or a.location is null and not b.in_bundle or a.location is not null and (a.version <> b.version or a.patch is distinct from b.patch
  or case when a.i % 2 = 0 then a.i % 5 = 0 when a.i % 7 = 0 then true else a.i % 9 = 0 end)""")
def diff_actions(spark, sf_dir):
    part = star.tables(spark, sf_dir)["part"]
    return diffs.diff_actions(spark.sql(_NOW, part=part), spark.sql(_THEN, part=part))


@query("diff_filtered", f"""with recursive {GRAPH}, r as (select location from n where kind = 'BUILDING' union select e.dst from e join r on r.location = e.src), l as ({LATER})
 select coalesce(n.location, l.location) as location, case when n.location is null then 'ADD' when l.location is null then 'REMOVE' else 'CHANGE' end as action, n.version as was, l.version as will
 from n full join l on n.location = l.location where n.version is distinct from l.version and coalesce(n.location, l.location) in (select location from r union all select '')""")
def diff_filtered(spark, sf_dir):
    g = star.star_graph(spark, sf_dir)
    now, later = snapshots(spark, sf_dir)
    chosen = g.nodes.where("variant_get(package, '$.kind', 'string') = 'BUILDING'")
    return diffs.diff_actions(now, later, diffs.filter_set(g, g, chosen))


# --- extensions --------------------------------------------------------------------

_EXTENSIONS = {
    "order-1": {"dependencies": {"extra": "^1.0.0"}}, "order-2@^1.0.0": {"optionalDependencies": {"own": "2"}}, "order-3@^2.0.0": {"dependencies": {"never": "1"}}, "order-4": {"dependencies": {"own": "1"}},
    "order-5": {"peerDependencies": {"p": "^2"}, "peerDependenciesMeta": {"p": {"optional": True}}}, "order-6": {"peerDependenciesMeta": {"lost": {"optional": True}}}, "order-7": {}, "order-7@*": {"dependencies": {"x": "1"}},
}


@query("extended_manifests", """with o as (select o_orderkey as k, 'orders/' || o_orderkey as location from orders where o_orderkey between 1 and 7 and o_orderkey <> 3)
 select location, case k when 2 then 'order-2@^1.0.0' else 'order-' || k end as selector, 'own' || case when k = 1 then ',extra' else '' end as dependencies, case when k = 5 then 'p ^2,q ^1' else 'p ^1,q ^1' end as peers, case k when 1 then 'dependencies.extra' when 5 then 'peerDependencies.p,peerDependenciesMeta.p' end as applied,
 case when k in (2, 4) then 'EEXTENSIONDUPDEP: own' when k = 6 then 'EEXTENSIONORPHANMETA: lost' when k = 7 then 'EEXTENSIONCONFLICT: order-7, order-7@*' end as error from o""")
def extended_manifests(spark, sf_dir):
    manifest = F.parse_json(F.lit('{"dependencies":{"own":"^1.0.0"},"peerDependencies":{"p":"^1","q":"^1"}}'))
    nodes = star.star_graph(spark, sf_dir).nodes.withColumn("package", manifest)
    told = extensions.extended(nodes, extensions.extension_rules(spark, _EXTENSIONS))
    peers = F.array_join(F.array_sort(F.transform(F.map_entries("peerDependencies"), lambda e: F.concat_ws(" ", e["key"], e["value"]))), ",")
    return told.select("location", "selector", F.array_join(F.reverse(F.array_sort(F.map_keys("dependencies"))), ",").alias("dependencies"), peers.alias("peers"), F.array_join("applied", ",").alias("applied"), "error")


# --- addresses and names -----------------------------------------------------------

_FORMS = (
    ("file:../x/%s", "file:/srv/x/%s"), ("./a/../%s", "file:/srv/app/%s"), ("github:u/%s#v1", "git+ssh://git@github.com/u/%s.git#v1"), ("u/%s", "git+ssh://git@github.com/u/%s.git"), ("git+ssh://git@gitlab.com/u/%s.git#c", "git+ssh://git@gitlab.com/u/%s.git#c"),
    ("https://github.com/u/%s", "git+https://github.com/u/%s.git"), ("git+https://t@bitbucket.org/u/%s.git#c", "git+https://t@bitbucket.org/u/%s.git#c"), ("git@github.com:u/%s.git", "git+ssh://git@github.com/u/%s.git"), ("git://h.example/u/%s.git", "git://h.example/u/%s.git"),
    ("https://registry.example/p/-/p-%s.0.0.tgz", "https://registry.example/p/-/p-%s.0.0.tgz"), ("p@%s.x", "%s.x"), ("https://github.com/u/r/archive/%s.tgz", "https://github.com/u/r/archive/%s.tgz"), ("", None),
)


@query("resolved_addresses", "select p_partkey as part, case p_partkey % 13 " + " ".join(f"when {k} then " + ("null" if to is None else f"replace('{to}', '%s', p_partkey || '')") for k, (_, to) in enumerate(_FORMS)) + " end as resolved, case p_partkey % 13 when 0 then 'file:../../x/' || p_partkey when 1 then 'file:../' || p_partkey end as relative from part")
def resolved_addresses(spark, sf_dir):
    part = star.tables(spark, sf_dir)["part"]
    form = F.element_at(F.array(*[F.lit(a) for a, _ in _FORMS]), (F.col("p_partkey") % 13 + 1).cast("int"))
    said = F.replace(form, F.lit("%s"), F.col("p_partkey").cast("string"))
    base = F.lit("/srv/app")
    return part.select(F.col("p_partkey").alias("part"), text.consistent_resolve(said, base).alias("resolved"), F.when(F.col("p_partkey") % 13 < 2, text.consistent_resolve(said, base, F.lit("/srv/app/sub"))).alias("relative"))


@query("ranked_names", "with n as (select distinct case when p_size % 2 = 0 then upper(p_name[1]) || p_name[2:] else p_name end as name from part) select row_number() over (order by lower(name), name desc) as rank, name from n")
def ranked_names(spark, sf_dir):
    name = F.when(F.col("p_size") % 2 == 0, F.concat(F.upper(F.substring("p_name", 1, 1)), F.expr("substring(p_name, 2)"))).otherwise(F.col("p_name"))
    return numbered(star.tables(spark, sf_dir)["part"].select(name.alias("name")).distinct(), by_name(F.col("name")), name="rank")

"""Relational reports over a graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweft.functions import semver, text
from graphweft.operators import jsonpath
from graphweft.operators.closure import closure, many, reached
from graphweft.operators.graph import Graph
from graphweft.plans.compiler import Compiler, package_id
from graphweft.storage import stored, written

SEVERITY = ("info", "low", "moderate", "high", "critical")


def severity_rank(c: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITY)), c), F.lit(0))


# --- query report ------------------------------------------------------------------


def query_report(graph: Graph, nodes: DataFrame, strict_compat: bool = True) -> DataFrame:
    """Each node with the locations that lead to it and that it leads to.
    strict_compat: `deduped` is always false, as long known; else whether more
    than one edge leads to it."""
    e = graph.resolved
    into = e.groupBy(F.col("dst").alias("location")).agg(F.sort_array(F.collect_set("src")).alias("from"))
    out = e.groupBy(F.col("src").alias("location")).agg(F.sort_array(F.collect_set("dst")).alias("to"))
    none = F.array().cast("array<string>")
    found = nodes.join(into, "location", "left").join(out, "location", "left")
    deduped = F.lit(False) if strict_compat else F.size(F.coalesce("from", none)) > 1
    return found.select("name", "version", "location", "realpath", F.coalesce("from", none).alias("from"), F.coalesce("to", none).alias("to"), "dev", F.col("in_bundle").alias("inBundle"), deduped.alias("deduped"), "overridden")


def query_items(graph: Graph, nodes: DataFrame, strict_compat: bool = True) -> DataFrame:
    """What a query tells of each place: (pkgid, location, path, realpath,
    resolved, manifest, from, to, dev, inBundle, deduped, overridden). A link
    is told as its target, a link into the store under its own location. Of
    several rows of one place the one nearest the top stays, see place_rank.
    from and to have an entry for each edge, in order; deduped as in query_report."""
    store = F.col("location").contains("node_modules/.store/")
    resolved = F.col("resolved") if "resolved" in graph.nodes.columns else F.lit(None).cast("string")
    real = graph.nodes.select(F.col("location").alias("_real"), package_id(F.col("name"), F.col("package_name"), F.col("version")).alias("pkgid"), "realpath", resolved.alias("resolved"), F.col("package").alias("manifest"), "dev", F.col("in_bundle").alias("inBundle"), F.col("in_store").alias("_stored"))
    found = nodes.select("location", "is_link", "overridden", store.alias("_store"), F.coalesce(F.when(F.col("is_link"), F.col("target_location")), F.col("location")).alias("_real")).join(real, "_real")
    found = one_a_place(found, "_real", place_rank(F.col("location"), F.col("is_link"), F.col("_store")), "location")
    e = graph.resolved
    into = e.groupBy(F.col("dst").alias("_real")).agg(F.sort_array(F.collect_list("src")).alias("from"))
    out = e.groupBy(F.col("src").alias("_real")).agg(F.sort_array(F.collect_list("dst")).alias("to"))
    none = F.array().cast("array<string>")
    rows = found.join(into, "_real", "left").join(out, "_real", "left").withColumn("from", F.coalesce("from", none))
    at = F.when(F.col("_stored") & F.col("is_link"), F.col("location")).otherwise(F.col("_real"))
    path = F.concat(F.lit(graph.root_path.rstrip("/")), F.when(at == "", "").otherwise(F.concat(F.lit("/"), at)))
    deduped = F.lit(False) if strict_compat else F.size("from") > 1
    return rows.select("pkgid", at.alias("location"), path.alias("path"), "realpath", "resolved", "manifest", "from", F.coalesce("to", none).alias("to"), "dev", "inBundle", deduped.alias("deduped"), "overridden")


def query_context(graph: Graph, nodes: DataFrame, before: str | None = None, **shown: Callable[[Column], Column]) -> DataFrame:
    """(location, advisories, versions): what a query for vulnerable or outdated
    nodes notes of each: the advisories whose range it is in, and the newer
    versions that there are (as of `before`); null where there are none.
    shown: what is made of either column. It is made once for each package, not
    each node, and met by the nodes last, so that what is long isn't shuffled
    for every node."""
    c = Compiler(graph, None, before, ())
    as_is = lambda column: column
    own = nodes.select("location", "name", "version", c.may_be_outdated().alias("_may"))
    advised = c.advised().withColumn("advisories", shown.get("advisories", as_is)(F.col("advisories")))
    newer = c.newer_versions().select("name", "version", shown.get("versions", as_is)(F.col("newer")).alias("versions"))
    told = own.join(many(advised), ["name", "version"], "left").join(many(newer), ["name", "version"], "left")
    return told.select("location", "advisories", F.when(F.col("_may"), F.col("versions")).alias("versions"))


def one_a_place(rows: DataFrame, place: str, rank: Column, order: str) -> DataFrame:
    """The row of the highest rank at each place; the first among equals."""
    w = Window.partitionBy(place).orderBy(rank.desc(), F.col(order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def place_rank(location: Column, is_link: Column, in_store: Column) -> Column:
    return F.when(in_store, F.when(is_link, 0).otherwise(1)).otherwise(2)


def expect_results(nodes: DataFrame, expected: bool | int) -> bool:
    """Whether a query found any (True), none (False), or so many nodes."""
    if isinstance(expected, bool):
        return nodes.isEmpty() != expected
    return nodes.count() == expected


# --- outdated ----------------------------------------------------------------------


def outdated(graph: Graph, edges: DataFrame | None = None, omit: tuple[str, ...] = (), tags: DataFrame | None = None, before: str | None = None) -> DataFrame:
    """(name, current, wanted, latest, dependent, type) of edges whose target
    isn't the best version that the spec lets in, or that isn't the newest.
    What a spec lets in is looked for once for each name and spec, not each edge.
    tags (name, tag, version): `latest` is what that tag says, the highest
    version only where there is none. before: versions published later don't count."""
    e = (graph.edges if edges is None else edges).where(text.is_registry(text.spec_type(F.col("spec"))))
    for kind in omit:
        e = e.where(F.col("type") != kind)
    published = graph.versions if before is None else graph.versions.where(F.col("published_at") <= F.lit(before).cast("timestamp"))
    v = published.select("name", "version", semver.sv(F.col("version")).alias("v")).where("v is not null")
    current = graph.nodes.select(F.col("location").alias("dst"), F.col("version").alias("current"))
    asked = e.select("name", "spec").distinct()
    pairs = asked.join(v, "name").join(semver.range_terms(asked.select("spec")), "spec")
    one = F.struct("v", "version")
    best = pairs.groupBy("name", "spec").agg(F.max(F.when(semver.sv_satisfies(F.col("v"), F.col("terms")), one))["version"].alias("wanted"), F.max(one)["version"].alias("latest"))
    if tags is not None:
        tagged = tags.where("tag = 'latest'").join(v.select("name", "version"), ["name", "version"], "left_semi").select("name", F.col("version").alias("_tagged"))
        best = best.join(tagged, "name", "left").withColumn("latest", F.coalesce("_tagged", "latest")).drop("_tagged")
    rows = e.join(best, ["name", "spec"]).join(current, "dst", "left").where(F.col("current").isNotNull() | (F.col("type") == "prod"))
    differs = F.col("current").isNull() | ~F.col("current").eqNullSafe(F.col("wanted")) | ~F.col("wanted").eqNullSafe(F.col("latest"))
    return rows.where(F.col("wanted").isNotNull() & differs).select("name", "current", "wanted", "latest", F.col("src").alias("dependent"), "type")


def select_edges(graph: Graph, names: list[str] | None = None, every: bool = False) -> DataFrame:
    """The edges that a report looks at: those into nodes of the names, else
    all, else those out of the root and its workspaces."""
    e = graph.edges
    if names:
        return e.where(F.col("name").isin(names))
    if every:
        return e
    top = graph.nodes.where("is_root or is_workspace").select(F.col("location").alias("src"))
    return e.join(top, "src", "left_semi")


def page(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """`limit` rows in an order that leaves no ties, after the first `offset`."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def folded_by_name(rows: DataFrame) -> DataFrame:
    """One row a name; what several edges say becomes a list."""
    rest = [c for c in rows.columns if c != "name"]
    return rows.groupBy("name").agg(F.collect_list(F.struct(*rest)).alias("entries"))


# --- ls ----------------------------------------------------------------------------


def tree(graph: Graph, start: DataFrame | None = None, depth: int | None = 0) -> DataFrame:
    """(location, depth): nodes by the fewest steps from the start; the start is
    at depth 0 and its own dependencies, shown by `depth` 0, at 1."""
    start = graph.nodes.where("is_root").select("location") if start is None else start
    return closure(graph.descent(), start, None if depth is None else depth + 1)


def with_ancestors(graph: Graph, found: DataFrame) -> DataFrame:
    """found and all that leads to it."""
    up = graph.descent().select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reached(up, found.select("location"))


def problems(graph: Graph) -> DataFrame:
    """(problem, name, location): missing, invalid and extraneous dependencies."""
    e, n = graph.edges, graph.nodes
    missing = e.where("error = 'MISSING'").select(F.lit("missing").alias("problem"), "name", F.col("src").alias("location"))
    invalid = e.where("error = 'INVALID'").select(F.lit("invalid").alias("problem"), "name", F.col("dst").alias("location"))
    extraneous = n.where("extraneous").select(F.lit("extraneous").alias("problem"), "name", "location")
    return missing.union(invalid).union(extraneous).distinct()


# --- histograms, lookups -----------------------------------------------------------


def licence(package: Column) -> Column:
    """license, else licence, else the first of licenses; of objects their type."""
    get = lambda p: F.try_variant_get(package, p, "string")
    array = F.try_variant_get(package, "$.license", "array<string>")
    return F.coalesce(F.when(array.isNotNull(), F.array_join(array, " OR ")), get("$.license.type"), get("$.license"), get("$.licence"), get("$.licenses[0].type"), get("$.licenses[0]"))


def histogram(rows: DataFrame, key: Column, name: str = "value") -> DataFrame:
    """(value, n), the most first, then by value, no value last."""
    found = rows.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("n"))
    return found.orderBy(F.col(name).isNull(), F.desc("n"), name)


def duplicate_names(nodes: DataFrame) -> DataFrame:
    return nodes.where("not is_root").groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def index_values(nodes: DataFrame, key: Column) -> DataFrame:
    return nodes.select(key.alias("value")).where("value is not null").distinct()


# --- vulnerabilities ---------------------------------------------------------------


def vulnerable_nodes(graph: Graph, eligible: Column | None = None) -> DataFrame:
    """(location, name, version, id, severity, vulnerable_versions): nodes in an
    advisory's range, by package name; root and links are left out."""
    a = graph.advisories
    own = graph.nodes.where("version is not null and not is_root and not is_link")
    if eligible is not None:
        own = own.where(eligible)
    ranged = a.join(semver.range_terms(a.select(F.col("vulnerable_versions").alias("spec"))), F.col("vulnerable_versions") == F.col("spec")).drop("spec")
    pairs = own.select("location", F.col("package_name").alias("name"), "version", semver.sv(F.col("version")).alias("_v")).join(ranged, "name")
    return pairs.where(semver.sv_satisfies(F.col("_v"), F.col("terms"), include_prerelease=True)).drop("_v", "terms")


def vulnerability_summary(graph: Graph) -> DataFrame:
    """(name, severity, n_nodes, ranges, is_direct): worst severity of each name."""
    hits = stored(vulnerable_nodes(graph), "hits")
    direct_from = graph.nodes.where("is_root or is_workspace").select(F.col("location").alias("src"))
    direct = graph.resolved.join(direct_from, "src", "left_semi").select(F.col("dst").alias("location")).distinct().withColumn("direct", F.lit(True))
    rows = hits.join(direct, "location", "left")
    return rows.groupBy("name").agg(
        F.max_by("severity", severity_rank(F.col("severity"))).alias("severity"),
        F.countDistinct("location").alias("n_nodes"),
        F.array_join(F.sort_array(F.collect_set("vulnerable_versions")), " || ").alias("ranges"),
        F.coalesce(F.bool_or("direct"), F.lit(False)).alias("is_direct"),
    )


def bulk_request(nodes: DataFrame) -> DataFrame:
    """(name, versions): distinct versions of each package name, sorted as
    text; root, links and nodes without a version are left out."""
    own = nodes.where("not is_root and not is_link and version is not null")
    return own.groupBy(F.col("package_name").alias("name")).agg(F.sort_array(F.collect_set("version")).alias("versions"))


def fix_blocked_by_age(vulnerable: DataFrame, versions: DataFrame, cutoff: str) -> DataFrame:
    """(name, spec, fix): the highest version that the spec lets in and no
    advisory spoils, where each such version is newer than the cutoff.
    vulnerable: name, spec, vulnerable_versions."""
    asked = vulnerable.select("name", "spec", "vulnerable_versions").distinct()
    terms = lambda c, to: semver.range_terms(asked.select(F.col(c).alias("spec"))).select(F.col("spec").alias(c), F.col("terms").alias(to))
    v = versions.select("name", "version", "published_at", semver.sv(F.col("version")).alias("v"))
    pairs = asked.join(v, "name").join(terms("spec", "allows"), "spec").join(terms("vulnerable_versions", "spoils"), "vulnerable_versions")
    spoiled = semver.sv_satisfies(F.col("v"), F.col("spoils"), include_prerelease=True)
    good = pairs.where(semver.sv_satisfies(F.col("v"), F.col("allows"))).groupBy("name", "spec", "version").agg(F.bool_or(spoiled).alias("bad"), F.first("v").alias("v"), F.min("published_at").alias("at")).where("not bad")
    old = F.max(F.col("at") <= F.lit(cutoff).cast("timestamp"))
    return good.groupBy("name", "spec").agg(F.max_by("version", "v").alias("fix"), old.alias("old")).where("not old").drop("old")


def severity_counts(summary: DataFrame) -> DataFrame:
    """One row: how many names by severity, and in all."""
    return summary.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITY], F.count(F.lit(1)).alias("total"))


def dependency_counts(nodes: DataFrame, strict_compat: bool = True) -> DataFrame:
    """One row: nodes by dependency flag; prod has none. strict_compat: none is
    counted as peerOptional, as long known."""
    none = ~F.col("dev") & ~F.col("optional") & ~F.col("peer")
    own = nodes.where("not is_root")
    optional_peer = F.lit(0).cast("long") if strict_compat else F.count_if(F.col("peer") & F.col("optional"))
    return own.agg(F.count_if(none).alias("prod"), F.count_if("dev").alias("dev"), F.count_if("optional").alias("optional"), F.count_if("peer").alias("peer"), optional_peer.alias("peerOptional"), F.count(F.lit(1)).alias("total"))


def let_in(rows: DataFrame) -> DataFrame:
    """rows (version, spec, ...) with `_in`, whether the range lets the version
    in: each version is parsed and tested once for each range, not in each row."""
    rows = stored(rows, "asked")
    tests = rows.select("version", "spec").distinct()
    told = tests.join(semver.range_terms(tests.select("spec")), "spec").where(semver.sv_satisfies(semver.sv(F.col("version")), F.col("terms")))
    return rows.join(stored(told.select("version", "spec", F.lit(True).alias("_in")), "let_in"), ["version", "spec"], "left").withColumn("_in", F.coalesce("_in", F.lit(False)))


def audit(graph: Graph) -> DataFrame:
    """(name, severity, via): advisories, then the names that depend on them
    such that every version that the spec lets in is vulnerable, until no more
    are found. That last rule is our definition of a dependent's vulnerability."""
    own = vulnerable_nodes(graph).select("name", "version", "severity", F.col("id").alias("via")).distinct()
    found = [written(own, "audit")]
    known = graph.versions.select("name", "version").union(graph.nodes.select("name", "version")).distinct()
    pairs = graph.resolved.select("src", "name", "spec")  # repeats fall with the rows that they make
    allowed = stored(let_in(pairs.select("name", "spec").distinct().join(known, "name")).where("_in").select("name", "spec", "version"), "allowed")
    places = graph.nodes.where("not is_root").select(F.col("location").alias("src"), F.col("name").alias("owner"), F.col("version").alias("owner_version"))
    read = lambda paths: graph.nodes.sparkSession.read.schema(own.schema).parquet(*paths)
    while True:
        last = read(found[-1:])
        if last.isEmpty():
            return read(found)
        # only specs of names that the last round found more of can have become vulnerable
        names = last.select("name").distinct()
        asked = allowed.join(names, "name", "left_semi")
        bad = read(found).join(names, "name", "left_semi").groupBy("name", "version").agg(F.max_by("severity", severity_rank(F.col("severity"))).alias("severity"))
        judged = stored(asked.join(bad, ["name", "version"], "left").groupBy("name", "spec").agg(F.bool_and(F.col("severity").isNotNull()).alias("all_bad"), F.max_by("severity", severity_rank(F.col("severity"))).alias("severity")).where("all_bad"), "judged")  # few as they may be, Spark sees it
        if judged.isEmpty():
            return read(found)
        more = pairs.join(judged, ["name", "spec"]).join(places, "src").select(F.col("owner").alias("name"), F.col("owner_version").alias("version"), "severity", F.col("name").alias("via")).distinct()
        found.append(written(more.join(read(found), ["name", "version", "via"], "left_anti").select(*own.columns), "audit"))


def fix_available(summary: DataFrame, versions: DataFrame, advisories: DataFrame, specs: DataFrame) -> DataFrame:
    """(name, fix): for each vulnerable name, 'in range' if the spec lets in a
    version that isn't vulnerable, 'major' if some version isn't, else 'none'.
    specs: name, spec."""
    v = versions.select("name", "version", semver.sv(F.col("version")).alias("v")).where("v is not null")
    bad = advisories.select("name", F.col("vulnerable_versions").alias("spec"))
    spoiled = v.join(bad, "name").join(semver.range_terms(bad.select("spec")), "spec").where(semver.sv_satisfies(F.col("v"), F.col("terms"), True)).select("name", "version").distinct()
    good = v.join(spoiled, ["name", "version"], "left_anti")
    let_in = good.join(specs.distinct(), "name").join(semver.range_terms(specs.select("spec")), "spec").where(semver.sv_satisfies(F.col("v"), F.col("terms"))).select("name").distinct()
    state = summary.select("name").join(let_in.withColumn("near", F.lit(True)), "name", "left").join(good.select("name").distinct().withColumn("far", F.lit(True)), "name", "left")
    return state.select("name", F.when(F.col("near"), "in range").when(F.col("far"), "major").otherwise("none").alias("fix"))


# --- snapshots ---------------------------------------------------------------------


def tree_diff(actual: DataFrame, ideal: DataFrame) -> DataFrame:
    """(location, action, was, will): ADD, REMOVE or CHANGE. Below a node that is
    removed or changed nothing more is told. Both sides: location, version,
    and perhaps integrity."""
    both = lambda c: c if c in actual.columns and c in ideal.columns else None
    a = actual.select("location", F.col("version").alias("was"), *([F.col("integrity").alias("a_int")] if both("integrity") else []))
    b = ideal.select("location", F.col("version").alias("will"), *([F.col("integrity").alias("b_int")] if both("integrity") else []))
    rows = a.withColumn("_a", F.lit(True)).join(b.withColumn("_b", F.lit(True)), "location", "full_outer").where("location <> ''")
    changed = ~F.col("was").eqNullSafe(F.col("will"))
    if both("integrity"):
        changed = changed | (F.col("a_int").isNotNull() & F.col("b_int").isNotNull() & (F.col("a_int") != F.col("b_int")))
    action = F.when(F.col("_a").isNull(), "ADD").when(F.col("_b").isNull(), "REMOVE").when(changed, "CHANGE")
    rows = rows.select("location", action.alias("action"), "was", "will").where("action is not null")
    parts = F.split("location", "/node_modules/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/node_modules/"))
    nested = rows.where(F.size(parts) > 1).select("location", F.explode(above).alias("above"))
    hidden = nested.join(rows.where("action in ('REMOVE', 'CHANGE')").select(F.col("location").alias("above")), "above").select("location").distinct()
    return rows.join(hidden, "location", "left_anti")


def install_counts(diff: DataFrame, nodes: DataFrame, funded: int | None = None, vulnerable: int | None = None) -> DataFrame:
    """One row, as an installation ends: added, removed, changed, audited (all
    but the root, links and workspaces), funding, vulnerabilities."""
    own = nodes.agg(F.count_if(~F.col("is_root") & ~F.col("is_link") & ~F.col("is_workspace")).alias("audited"))
    told = diff.agg(*[F.count_if(F.col("action") == a).alias(n) for a, n in (("ADD", "added"), ("REMOVE", "removed"), ("CHANGE", "changed"))])
    return told.join(own, how="inner").select("*", F.lit(funded).cast("long").alias("funding"), F.lit(vulnerable).cast("long").alias("vulnerabilities"))  # a row and a row


def install_summary(diff: DataFrame) -> DataFrame:
    return diff.groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("location")).alias("locations"))


def validate_lock(virtual: DataFrame, ideal: DataFrame) -> DataFrame:
    """(location, error): what the ideal tree has that the lock lacks or has otherwise."""
    rows = ideal.where("location <> ''").select("location", "name", F.col("version").alias("need")).join(virtual.select("location", F.col("version").alias("has"), F.lit(True).alias("_in")), "location", "left")
    error = F.when(F.col("_in").isNull(), F.concat(F.lit("Missing: "), "name", F.lit("@"), "need", F.lit(" from lock file"))).when(
        ~F.col("need").eqNullSafe(F.col("has")), F.concat(F.lit("Invalid: lock file's "), "name", F.lit("@"), "has", F.lit(" does not satisfy "), "name", F.lit("@"), "need")
    )
    return rows.select("location", error.alias("error")).where("error is not null")


# --- funding, bills of materials ---------------------------------------------------


def funding(rows: DataFrame, package: Column) -> DataFrame:
    """rows with `funding`, an array of {type, url}: of a text, an object or a
    list of them, kept only if all are web addresses."""
    one = F.try_variant_get(package, "$.funding", "variant")
    items = F.coalesce(F.try_variant_get(package, "$.funding", "array<variant>"), F.when(one.isNotNull(), F.array(one)))
    url = lambda v: F.coalesce(F.try_variant_get(v, "$.url", "string"), F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))
    shaped = F.transform(items, lambda v: F.struct(F.try_variant_get(v, "$.type", "string").alias("type"), url(v).alias("url")))
    rows = rows.withColumn("funding", shaped)
    return rows.where((F.size("funding") > 0) & F.forall("funding", lambda f: text.valid_web_address(f["url"])))


def by_address(rows: DataFrame) -> DataFrame:
    """(url, names): who is funded where; rows: name, url."""
    return rows.groupBy("url").agg(F.array_join(F.sort_array(F.collect_set("name")), ", ").alias("names"))


def newest_by_name(nodes: DataFrame) -> DataFrame:
    found = nodes.withColumn("_v", semver.sv(F.col("version"))).where("_v is not null")
    return found.groupBy("name").agg(F.max_by("version", "_v").alias("version"))


def bill_components(graph: Graph) -> DataFrame:
    """First node of each name and version: ref, purl, and the refs it depends on."""
    n = graph.nodes.where("not is_link").withColumn("ref", F.concat("name", F.lit("@"), "version"))
    refs = n.select("location", "ref")
    depends = graph.resolved.join(refs.select(F.col("location").alias("src"), F.col("ref").alias("from")), "src").join(refs.select(F.col("location").alias("dst"), F.col("ref").alias("to")), "dst")
    gathered = depends.groupBy(F.col("from").alias("ref")).agg(F.sort_array(F.collect_set("to")).alias("depends_on"))
    first = one_a_place(n, "ref", F.lit(0), "location").select("ref", "name", "version", text.purl(F.col("name"), F.col("version")).alias("purl"), licence(F.col("package")).alias("license"))
    return first.join(gathered, "ref", "left").withColumn("depends_on", F.coalesce("depends_on", F.array().cast("array<string>")))


#: How an edge's type is told in a bill of materials.
RELATION = {"dev": "DEV_DEPENDENCY_OF", "optional": "OPTIONAL_DEPENDENCY_OF", "peerOptional": "OPTIONAL_DEPENDENCY_OF", "peer": "DEPENDENCY_OF", "prod": "DEPENDENCY_OF", "workspace": "DEPENDENCY_OF"}


def bill_relationships(graph: Graph) -> DataFrame:
    """Distinct (from, relation, to) between package ids."""
    ids = graph.nodes.select("location", text.spdx_id(F.col("name"), F.col("version")).alias("id"))
    kind = F.lit("DEPENDENCY_OF")
    for name, told in RELATION.items():
        kind = F.when(F.col("type") == name, told).otherwise(kind)
    e = graph.resolved.join(ids.select(F.col("location").alias("src"), F.col("id").alias("owner")), "src").join(ids.select(F.col("location").alias("dst"), F.col("id").alias("dep")), "dst")
    return e.select(F.col("dep").alias("from"), kind.alias("relation"), F.col("owner").alias("to")).distinct()


def cyclonedx(graph: Graph) -> DataFrame:
    """The bill as one JSON document a component row, ready to be gathered."""
    c = bill_components(graph)
    return c.select(F.to_json(F.struct(F.lit("library").alias("type"), F.col("ref").alias("bom-ref"), "name", "version", "purl", "license", F.col("depends_on").alias("dependsOn"))).alias("component"))


# --- explanations ------------------------------------------------------------------


def explain(graph: Graph, target: DataFrame, most: int | None = None) -> DataFrame:
    """(path, location): every chain of dependents from the targets up, without
    repeats. most: the number of steps at most."""
    from graphweft.operators.closure import paths

    up = graph.resolved.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return paths(up, target.select("location"), most)


def explain_dependents(graph: Graph, target: DataFrame) -> DataFrame:
    """(location, name, version, is_workspace, depth, dependent, type, edge,
    spec, error, bundled): the targets and all that leads to them, with a row
    for each edge that holds a node where it is, and one without for a node
    that none holds. Edges that aren't valid hold nothing, but the root's. This
    is the explanation with each node's part told once, however many chains
    pass through it; depth is the fewest steps from a target."""
    e = graph.resolved.where(F.col("error").isNull() | (F.col("src") == graph.root))
    near = closure(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), target.select("location"))
    own = graph.nodes.select("location", "name", "version", "is_workspace")
    bundles = graph.nodes.select(F.col("location").alias("dependent"), F.try_variant_get("package", "$.bundleDependencies", "array<string>").alias("_bundles"))
    held = e.select(F.col("dst").alias("location"), F.col("src").alias("dependent"), "type", F.col("name").alias("edge"), "spec", "error")
    rows = near.join(own, "location").join(held, "location", "left").join(bundles, "dependent", "left")
    return rows.select("location", "name", "version", "is_workspace", "depth", "dependent", "type", "edge", "spec", "error", F.coalesce(F.array_contains("_bundles", F.col("edge")), F.lit(False)).alias("bundled"))


def find_nodes(graph: Graph, wanted: str) -> DataFrame:
    """Nodes that an argument names: a location, else a realpath, else a name,
    else a name with a range behind its last @. The first kind that finds any decides."""
    name, _, range_ = wanted.rpartition("@")
    tries = [F.col("location") == wanted, F.col("realpath") == wanted, F.col("name") == wanted]
    if name:
        tries.append((F.col("name") == name) & F.coalesce(semver.in_range(semver.sv(F.col("version")), range_), F.lit(False)))
    kind = F.lit(None).cast("int")
    for k, hit in reversed(list(enumerate(tries))):
        kind = F.when(F.coalesce(hit, F.lit(False)), k).otherwise(kind)
    found = graph.nodes.withColumn("_kind", kind).where("_kind is not null")
    first = found.agg(F.min("_kind")).first()[0]
    return found.where(F.col("_kind") == F.lit(first)).drop("_kind")


def brief_dependents(edges: DataFrame, depth: int) -> DataFrame:
    """(location, shown, more): the first ceil(depth / 2) dependents, and how many others."""
    k = (depth + 1) // 2
    found = edges.where("dst is not null").groupBy(F.col("dst").alias("location")).agg(F.sort_array(F.collect_set("src")).alias("all"))
    return found.select("location", F.array_join(F.slice("all", 1, k), ", ").alias("shown"), F.greatest(F.size("all") - k, F.lit(0)).alias("more"))


# --- policies ----------------------------------------------------------------------


def script_review(nodes: DataFrame, policy: DataFrame) -> DataFrame:
    """(location, name, verdict): nodes with install scripts; deny beats allow
    beats none. policy: name, version (null: any), allow."""
    scripts = F.coalesce(*[F.try_variant_get("package", f"$.scripts.{s}", "string") for s in ("preinstall", "install", "postinstall")])
    own = nodes.where(~F.col("is_root") & ~F.col("is_workspace") & ~F.col("is_link") & ~F.col("in_bundle") & scripts.isNotNull())
    p = policy.select("name", F.col("version").alias("p_version"), "allow")
    met = own.join(p, "name", "left").where("p_version is null or p_version = version or allow is null")
    rank = F.min(F.when(~F.col("allow"), 0).when(F.col("allow"), 1))
    return met.groupBy("location", "name").agg(F.when(rank == 0, "deny").when(rank == 1, "allow").alias("verdict"))


def chosen_extension(nodes: DataFrame, selectors: DataFrame) -> DataFrame:
    """(location, selector, n): selectors (selector, name, range) that meet each
    node; where n is over 1 they conflict."""
    terms = semver.range_terms(selectors.select(F.col("range").alias("spec"))).withColumnRenamed("spec", "range")
    met = nodes.select("location", "name", semver.sv(F.col("version")).alias("_v")).join(selectors.join(terms, "range"), "name").where(semver.sv_satisfies(F.col("_v"), F.col("terms")))
    return met.groupBy("location").agg(F.min("selector").alias("selector"), F.count(F.lit(1)).alias("n"))


def chosen_patch(nodes: DataFrame, selectors: DataFrame) -> DataFrame:
    """(location, selector, ambiguous): an exact version beats the narrowest
    range beats the name alone; ranges of which neither is narrower are ambiguous."""
    kinds = selectors.withColumn("rank", F.when(F.col("range").isNull(), 2).when(F.col("range").rlike(semver.VERSION), 0).otherwise(1))
    terms = semver.range_terms(kinds.select(F.col("range").alias("spec"))).withColumnRenamed("spec", "range")
    met = nodes.select("location", "name", semver.sv(F.col("version")).alias("_v")).join(kinds.join(terms, "range", "left"), "name").where(F.col("range").isNull() | semver.sv_satisfies(F.col("_v"), F.col("terms"))).select("location", "name", "selector", "range", "rank")
    best = met.withColumn("_r", F.min("rank").over(Window.partitionBy("location"))).where("rank = _r").drop("_r")
    ranges = best.where("rank = 1")
    pairs = ranges.alias("a").join(ranges.alias("b"), ["location", "name"]).where("a.selector <> b.selector").select("location", F.col("a.selector").alias("selector"), F.col("a.range").alias("a"), F.col("b.range").alias("b"))
    inside = pairs.select("a", "b").distinct().withColumn("within", semver.pair_test("subset")("a", "b"))
    judged = pairs.join(inside, ["a", "b"]).groupBy("location", "selector").agg(F.bool_and("within").alias("narrowest"))
    rows = best.join(judged, ["location", "selector"], "left").withColumn("good", F.coalesce("narrowest", F.lit(True)))
    return rows.groupBy("location").agg(F.min(F.when(F.col("good"), F.col("selector"))).alias("selector"), (F.count_if("good") != 1).alias("ambiguous"))


def unused_selectors(nodes: DataFrame, selectors: DataFrame) -> DataFrame:
    """Selectors (selector, name, range) that meet no node."""
    terms = semver.range_terms(selectors.select(F.col("range").alias("spec"))).withColumnRenamed("spec", "range")
    met = nodes.select("name", semver.sv(F.col("version")).alias("_v")).join(selectors.join(terms, "range", "left"), "name").where(F.col("range").isNull() | semver.sv_satisfies(F.col("_v"), F.col("terms")))
    return selectors.join(met.select("selector").distinct(), "selector", "left_anti").select("selector")


def engine_check(nodes: DataFrame, runtime: str) -> DataFrame:
    """(location, name, wants): nodes whose engines.node range the runtime doesn't satisfy."""
    wants = F.try_variant_get("package", "$.engines.node", "string")
    rows = nodes.select("location", "name", wants.alias("wants")).where("wants is not null")
    tested = rows.select("wants").distinct().withColumn("ok", semver.pair_test("satisfies")(F.lit(runtime), "wants"))
    return rows.join(tested, "wants").where("not ok").select("location", "name", "wants")


def platform_check(nodes: DataFrame, os: str, cpu: str, libc: str | None = None) -> DataFrame:
    """(location, name, failed): nodes whose os, cpu or libc list shuts this
    platform out, and the first list that does. A list of names lets in only
    those, or all with `any`; a name with ! before it is shut out."""

    def shut(key: str, here: str | None) -> Column:
        listed = F.coalesce(F.try_variant_get("package", f"$.{key}", "array<string>"), F.transform(F.array_compact(F.array(F.try_variant_get("package", f"$.{key}", "string"))), lambda x: x))
        let_in = F.filter(listed, lambda x: ~x.startswith("!"))
        if here is None:  # unknown: only a list that lets in something shuts it out
            return F.coalesce(F.size(let_in) > 0, F.lit(False))
        wrong = F.array_contains(listed, f"!{here}") | ((F.size(let_in) > 0) & ~F.array_contains(let_in, here) & ~F.array_contains(let_in, "any"))
        return F.coalesce(wrong, F.lit(False))

    failed = F.when(shut("os", os), "os").when(shut("cpu", cpu), "cpu").when(shut("libc", libc), "libc")
    return nodes.select("location", "name", failed.alias("failed")).where("failed is not null")


def signature_states(nodes: DataFrame, signatures: DataFrame) -> DataFrame:
    """(location, state): missing, invalid or verified, a row for each location.
    signatures: name, version, valid."""
    rows = nodes.where("not is_link and not is_root").join(signatures, ["name", "version"], "left")
    return rows.groupBy("location").agg(F.when(F.bool_and(F.col("valid").isNull()), "missing").when(F.coalesce(F.bool_and("valid"), F.lit(False)), "verified").otherwise("invalid").alias("state"))


# --- registry views ----------------------------------------------------------------


def view_versions(versions: DataFrame, name: str, range_: str) -> DataFrame:
    """Versions of a package in a literal range."""
    return versions.where((F.col("name") == name) & semver.in_range(semver.sv(F.col("version")), range_))


def view_fields(versions: DataFrame, name: str, range_: str, fields: list[str]) -> DataFrame:
    """(version, fields): of each version of a package in a literal range, what
    its manifest (a variant) has at the paths, as a map of paths to values;
    oldest first. versions: name, version, manifest."""
    found = view_versions(versions, name, range_).withColumn("_v", semver.sv(F.col("version"))).orderBy("_v")
    return found.select("version", jsonpath.get_many(F.col("manifest"), fields).alias("fields"))


def tag_line() -> Column:
    """`tag: version`, as tags are listed."""
    return F.concat("tag", F.lit(": "), "version")


def dist_tags(tags: DataFrame) -> DataFrame:
    """`tag: version` of each package, latest first, then by tag."""
    return tags.orderBy("name", F.col("tag") != "latest", "tag").select("name", tag_line().alias("line"))


def roster(rows: DataFrame, key: str, value: str | None, relabel: dict[str, str], field: str, order: str) -> DataFrame:
    """Rows of a remote list: one key kept, a field's codes told in words, in order."""
    if value is not None:
        rows = rows.where(F.col(key) == value)
    told = F.col(field)
    for code, word in relabel.items():
        told = F.when(F.col(field) == code, word).otherwise(told)
    return rows.withColumn(field, told).orderBy(order)


def config_cascade(layers: list[tuple[str, DataFrame]]) -> DataFrame:
    """(key, value, layer): of each key the value of the first layer that has it."""
    rows = None
    for k, (name, df) in enumerate(layers):
        own = df.select("key", "value", F.lit(name).alias("layer"), F.lit(k).alias("rank")).where("value is not null")
        rows = own if rows is None else rows.unionByName(own)
    return rows.groupBy("key").agg(F.min_by("value", "rank").alias("value"), F.min_by("layer", "rank").alias("layer"))


def cache_keys(keys: DataFrame, name: str, range_: str) -> DataFrame:
    """Cache keys (key) of tarballs of a package in a range, and of its packument."""
    tarball = (text.tarball_name(F.col("key")) == name) & semver.in_range(semver.sv(text.tarball_version(F.col("key"))), range_)
    return keys.where(tarball | F.col("key").rlike(rf"/{name.replace('/', '(?:/|%2[fF])')}$"))


def printable(graph: Graph) -> DataFrame:
    """(location, json): each node with its edges in order of name, as canonical JSON."""
    e = graph.edges.groupBy(F.col("src").alias("location")).agg(F.sort_array(F.collect_list(F.struct("name", "type", "spec", F.col("dst").alias("to"), "error"))).alias("edgesOut"))
    rows = graph.nodes.join(e, "location", "left")
    return rows.select("location", F.to_json(F.struct("name", "version", "location", "edgesOut")).alias("json"))

"""The property graph: nodes, edges, flags and the rules that derive them.

nodes: location (key), name, package_name, version, realpath, package
(variant), is_link, target_location, resolve_parent, is_root, is_workspace,
in_bundle, in_store, dev, optional, dev_optional, peer, extraneous, overridden.
edges: src, name, dst (null where nothing is found), type, spec, error.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweft.functions import semver, text
from graphweft.operators.closure import closure, least_joined, many, marks_reached, reached
from graphweft.storage import stored  # noqa: F401 (tests refuse it here)

#: Columns that a node may leave out, with what then holds.
NODE_DEFAULTS = {
    "package_name": F.col, "version": "string", "realpath": "string", "is_link": False, "target_location": "string", "resolve_parent": "string",
    "is_root": False, "is_workspace": False, "in_bundle": False, "in_store": False, "dev": False, "optional": False, "dev_optional": False,
    "peer": False, "extraneous": False, "overridden": False,
}
REGISTRY_EDGE = ("prod", "dev", "optional", "peer", "peerOptional", "workspace")


def complete(nodes: DataFrame) -> DataFrame:
    """nodes with every column; `package` from JSON text where it is a string."""
    for name, value in NODE_DEFAULTS.items():
        if name not in nodes.columns:
            if name == "package_name":
                nodes = nodes.withColumn(name, F.col("name"))
            else:
                nodes = nodes.withColumn(name, F.lit(None).cast("string") if value == "string" else F.lit(value))
    if "package" not in nodes.columns:
        nodes = nodes.withColumn("package", F.parse_json(F.to_json(F.struct("name", "version"))))
    elif nodes.schema["package"].dataType.typeName() == "string":
        nodes = nodes.withColumn("package", F.parse_json("package"))
    return nodes


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    root: str = ""
    root_path: str = ""
    versions: DataFrame | None = None  # name, version, published_at
    advisories: DataFrame | None = None  # name, id, severity, cwe, vulnerable_versions
    _held: dict = field(default_factory=dict)

    @property
    def resolved(self) -> DataFrame:
        return self.edges.where("dst is not null")

    def by_type(self, kind: str) -> DataFrame:
        """Locations that have the flag, or are led to by an edge of the type or from such a node."""
        if kind not in self._held:
            flagged = self.nodes.where(F.col(kind)).select("location")
            led = self.resolved.where(F.col("type") == kind).select(F.col("dst").alias("location"))
            self._held[kind] = reached(self.resolved, flagged.union(led))
        return self._held[kind]

    def descent(self) -> DataFrame:
        """Steps down: edges, from a containing folder to a top node, from link to target."""
        tops = self.nodes.where("resolve_parent is not null").select(F.col("resolve_parent").alias("src"), F.col("location").alias("dst"))
        links = self.nodes.where("is_link").select(F.col("location").alias("src"), F.col("target_location").alias("dst"))
        return self.resolved.select("src", "dst").union(tops).union(links)


# --- edges -------------------------------------------------------------------------


def declared_edges(nodes: DataFrame) -> DataFrame:
    """(src, name, type, spec) from manifests: optional peers over peers, then
    prod, optional and dev, each over what came before; workspace edges last of
    all. dev counts for top nodes only."""
    kinds = (("peerDependencies", "peer", 1), ("dependencies", "prod", 3), ("optionalDependencies", "optional", 4), ("devDependencies", "dev", 5))
    out = None
    for key, kind, rank in kinds:
        source = nodes.where("resolve_parent is not null or is_root") if kind == "dev" else nodes
        own = source.where("not is_link").select(F.col("location").alias("src"), F.explode(F.try_variant_get("package", f"$.{key}", "map<string,string>")).alias("name", "spec"), F.try_variant_get("package", "$.peerDependenciesMeta", "map<string,map<string,boolean>>").alias("meta"))
        if kind == "peer":
            optional = F.coalesce(F.col("meta")[F.col("name")]["optional"], F.lit(False))
            own = own.select("src", "name", "spec", F.when(optional, "peerOptional").otherwise("peer").alias("type"), F.when(optional, 2).otherwise(1).alias("rank"))
        else:
            own = own.select("src", "name", "spec", F.lit(kind).alias("type"), F.lit(rank).alias("rank"))
        out = own if out is None else out.unionByName(own)
    last = F.max_by(F.struct("name", "type", "spec"), "rank").alias("e")
    return out.groupBy("src", text.name_key(F.col("name")).alias("key")).agg(last).select("src", "e.*")


def ancestors(nodes: DataFrame) -> DataFrame:
    """(location, ancestor, depth): each location and the folders that contain it
    as a node, nearest the deepest."""
    parts = F.split("location", "/node_modules/")
    chain = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/node_modules/"))
    return nodes.select("location", F.posexplode(F.concat(F.array(F.lit("")), chain)).alias("depth", "ancestor")).distinct()


def resolve_edges(nodes: DataFrame, declared: DataFrame) -> DataFrame:
    """Each declared edge's dst: the node of its name nearest up the folders."""
    places = nodes.select(F.col("location").alias("dst"), text.name_key(F.regexp_extract("location", r"(?:^|/)node_modules/((?:@[^/]+/)?[^/]+)$", 1)).alias("key"), F.regexp_replace("location", r"(?:^|/)node_modules/(?:@[^/]+/)?[^/]+$", "").alias("ancestor")).where("key <> ''")
    up = ancestors(nodes.where("not is_link").select("location")).withColumnRenamed("location", "src")
    wanted = declared.withColumn("key", text.name_key(F.col("name")))
    found = wanted.join(up, "src").join(places, ["key", "ancestor"]).groupBy("src", "key").agg(F.max_by("dst", "depth").alias("dst"))
    return wanted.join(found, ["src", "key"], "left").drop("key")


def edge_errors(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with `error`: MISSING, INVALID, PEER LOCAL or null. Ranges are
    tested over distinct specs."""
    target = nodes.select(F.col("location").alias("dst"), F.col("version").alias("_v"), F.col("package_name").alias("_package"), F.col("resolved").alias("_resolved") if "resolved" in nodes.columns else F.lit(None).cast("string").alias("_resolved"), F.col("is_link").alias("_link"))
    terms = semver.range_terms(edges.select("spec"))
    with_target = edges.join(target, "dst", "left").join(terms, "spec", "left")
    kind = text.spec_type(F.col("spec"))
    alias = F.regexp_extract("spec", r"^npm:((?:@[^/]+/)?[^@]+)", 1)
    valid = (
        F.when(F.col("spec").isin("", "*"), True)
        .when(kind.isin("range", "version"), semver.sv_satisfies(semver.sv(F.col("_v")), F.col("terms")))
        .when(kind == "alias", (F.col("_package") == alias))
        .when(kind == "directory", F.col("_link"))
        .when(kind == "tag", F.coalesce(F.col("_resolved").rlike("^https?:"), F.lit(False)))
        .otherwise(F.coalesce(F.col("_resolved") == F.col("spec"), F.lit(False)))
    )
    local = F.col("type").isin("peer", "peerOptional") & (F.col("src") != "") & F.col("dst").startswith(F.concat(F.col("src"), F.lit("/node_modules/")))
    error = F.when(F.col("dst").isNull(), F.when(~F.col("type").isin("optional", "peerOptional"), "MISSING")).when(local, "PEER LOCAL").when(~F.coalesce(valid, F.lit(False)), "INVALID")
    return with_target.select(*edges.columns, error.alias("error"))


def edges_found_outside(edges: DataFrame, folders: DataFrame, root_path: str) -> DataFrame:
    """(src, name, path): missing edges whose package stands in a node_modules
    folder above the tree: the nearest of the folders (path) up from the
    root's. Nearest the root wins, as when a package looks for what it needs."""
    parts = [p for p in root_path.split("/") if p][:-1]
    above = ["/" + "/".join(parts[:k]) for k in range(len(parts) + 1)]
    missing = edges.where("dst is null and error = 'MISSING'").select("src", "name")
    steps = F.explode(F.array(*[F.struct(F.lit(k).alias("depth"), F.lit(p.rstrip("/")).alias("base")) for k, p in enumerate(above)])).alias("s")
    asked = missing.select("src", "name", steps).select("src", "name", "s.depth", F.concat("s.base", F.lit("/node_modules/"), "name").alias("path"))
    return asked.join(folders.select("path").distinct(), "path").groupBy("src", "name").agg(F.max_by("path", "depth").alias("path"))


# --- flags -------------------------------------------------------------------------


def dependency_flags(nodes: DataFrame, edges: DataFrame, root: str = "") -> DataFrame:
    """(location, extraneous, dev, optional, peer, dev_optional). A flag is
    unset on what the root reaches without edges of its kind. All five are
    followed in one closure, a bit for each, over the edges that it allows."""
    kind = F.col("type")
    allowed = {
        "extraneous": kind != "peerOptional",
        "dev": kind != "dev",
        "optional": ~kind.isin("optional", "peerOptional"),
        "peer": ~kind.isin("peer", "peerOptional"),
        "both": ~kind.isin("dev", "optional", "peerOptional"),
    }
    bit = {name: 1 << k for k, name in enumerate(allowed)}
    every = F.lit(sum(bit.values()))
    marks = reduce(lambda a, b: a.bitwiseOR(b), [F.when(ok, bit[name]).otherwise(0) for name, ok in allowed.items()])
    steps = edges.where("dst is not null").select("src", "dst", marks.alias("marks"))
    links = nodes.where("is_link").select(F.col("location").alias("src"), F.col("target_location").alias("dst"), every.alias("marks"))
    start = nodes.sparkSession.createDataFrame([(root, sum(bit.values()))], "location string, marks int")
    free = marks_reached(steps.union(links), start)
    found = nodes.select("location").join(many(free), "location", "left").withColumn("_free", F.coalesce("marks", F.lit(0)))
    has = lambda name: F.col("_free").bitwiseAND(bit[name]) == 0
    return found.select("location", *[has(k).alias(k) for k in ("extraneous", "dev", "optional", "peer")], (has("both") & ~has("dev") & ~has("optional")).alias("dev_optional"))


# --- sets --------------------------------------------------------------------------


def closed_set(edges: DataFrame, start: DataFrame) -> DataFrame:
    """What start leads to, less all that something outside leads to, and what
    that leads to; start itself stays."""
    inside = reached(edges, start)
    held = edges.where("dst is not null").select("src", "dst")
    at = lambda rows, c: many(rows.select(F.col("location").alias(c)))
    outside = held.join(at(inside, "src"), "src", "left_anti").join(at(inside, "dst"), "dst", "left_semi").select(F.col("dst").alias("location")).join(many(start), "location", "left_anti")
    within = held.join(at(inside, "dst"), "dst", "left_semi").join(at(start, "dst"), "dst", "left_anti")
    return inside.join(many(reached(within, outside)), "location", "left_anti")


def optional_set(edges: DataFrame, node: DataFrame) -> DataFrame:
    """Up from node over edges that aren't optional, then the closed set of what is found."""
    up = edges.where("dst is not null and type not in ('optional', 'peerOptional')").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    found = reached(up, node)
    return closed_set(edges, found.where("location <> ''"))


def peer_sets(edges: DataFrame) -> DataFrame:
    """(location, peer_set): nodes joined by peer edges, either way, named by their least."""
    peers = edges.where("dst is not null and type in ('peer', 'peerOptional')").select("src", "dst")
    return least_joined(peers).withColumnRenamed("least", "peer_set")


def workspace_set(graph: Graph, names: list[str] | None = None) -> DataFrame:
    """All that the chosen workspaces (all by default) lead to, themselves included."""
    chosen = graph.nodes.where("is_workspace")
    if names is not None:
        chosen = chosen.where(F.col("name").isin(names))
    return reached(graph.descent(), chosen.select("location"))


def without_workspaces(graph: Graph) -> DataFrame:
    """All that the root leads to other than through workspaces."""
    spark = graph.nodes.sparkSession
    spaces = graph.nodes.where("is_workspace").select(F.col("location").alias("dst"))
    return reached(graph.resolved.join(spaces, "dst", "left_anti"), spark.createDataFrame([(graph.root,)], "location string"))


#: A node's own folder at the end of its location.
FOLDER = r"(?:^|/)node_modules/(?:@[^/]+/)?[^/]+$"


def bundled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(location, bundler): the outermost node that bundles each node. A node
    bundles those in its folder that its bundleDependencies name, those in its
    folder that what it bundles leads to, and all inside their folders.

    An edge counts for the folder of its end, from whatever in that folder
    holds its start, so each is followed once, and a folder has a row for each
    node in it at most."""
    folder = lambda c: F.regexp_replace(c, FOLDER, "")
    own = nodes.where(F.col("location").rlike(FOLDER)).select("location", folder("location").alias("seed"), "name")
    wants = nodes.select(F.col("location").alias("seed"), F.explode(F.try_variant_get("package", "$.bundleDependencies", "array<string>")).alias("name")).distinct()
    start = own.join(wants, ["seed", "name"]).select("seed", "location")
    prefix = F.concat("seed", F.when(F.col("seed") == "", "node_modules/").otherwise("/node_modules/"))
    inner = F.regexp_extract(F.expr("substring(src, length(_prefix) + 1)"), "^((?:@[^/]+/)?[^/]+)", 1)
    steps = edges.where("dst is not null").where(F.col("dst").rlike(FOLDER)).select("src", "dst", folder("dst").alias("seed")).withColumn("_prefix", prefix)
    steps = steps.where(F.col("src").startswith(F.col("_prefix"))).select("seed", F.concat("_prefix", inner).alias("src"), "dst").where("src <> dst").distinct()
    found = closure(steps, start).select(F.col("location").alias("held"), F.col("seed").alias("bundler"))
    names = F.split("location", "/node_modules/")
    above = F.transform(F.sequence(F.lit(1), F.size(names)), lambda k: F.array_join(F.slice(names, 1, k), "/node_modules/"))
    places = nodes.select("location", F.posexplode(above).alias("at", "held"))
    return places.join(found, "held").groupBy("location").agg(F.min_by("bundler", "at").alias("bundler"))


def depths(nodes: DataFrame) -> DataFrame:
    """(location, depth, top): folders above, and the outermost node."""
    parts = F.split("location", "(?:^|/)node_modules/")
    return nodes.select("location", (F.size(parts) - 1).alias("depth"), parts[0].alias("top"))


def deepest_target(edges: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """(location, target): going up from each node, the first that has no peer edge of the name."""
    peers = edges.where(F.col("type").isin("peer", "peerOptional") & (F.col("name") == name)).select(F.col("src").alias("ancestor"), F.lit(True).alias("_peer"))
    up = ancestors(nodes).join(peers, "ancestor", "left")
    return up.where("_peer is null").groupBy("location").agg(F.max_by("ancestor", "depth").alias("target"))


# --- overrides ---------------------------------------------------------------------


def override_rule(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """For each edge its rule: the nearest up the chain for each key; a rule of
    the name holds if its key is * or its range meets the edge's.

    rules: src (where it applies), distance, rule_id, name, key_spec, value."""
    pairs = edges.join(rules, ["src", "name"]).select("src", "name", "spec", "key_spec", "rule_id", "value", "distance")
    nearest = Window.partitionBy("src", "name", "key_spec").orderBy("distance")
    near = pairs.withColumn("_n", F.row_number().over(nearest)).where("_n = 1").drop("_n")
    tested = near.select("spec", "key_spec").distinct().withColumn("meets", (F.col("key_spec") == "*") | semver.pair_test("intersects")("spec", "key_spec"))
    first = Window.partitionBy("src", "name").orderBy("distance", "rule_id")
    return near.join(tested, ["spec", "key_spec"]).where("meets").withColumn("_n", F.row_number().over(first)).where("_n = 1").select("src", "name", "rule_id", "value")


def override_conflicts(rules: DataFrame) -> DataFrame:
    """Pairs of rules of one key whose values can't both hold; values that
    refer to another dependency ($name) never conflict."""
    a = rules.select("key", F.col("rule_id").alias("a"), F.col("value").alias("a_value")).where("value not like '$%'")
    b = rules.select("key", F.col("rule_id").alias("b"), F.col("value").alias("b_value")).where("value not like '$%'")
    pairs = a.join(b, "key").where("a < b and a_value <> b_value")
    tested = pairs.select("a_value", "b_value").distinct().withColumn("meets", semver.pair_test("intersects")("a_value", "b_value"))
    return pairs.join(tested, ["a_value", "b_value"]).where("not meets").select("key", "a", "b")


# --- identity and checks -----------------------------------------------------------


def matches(a: Column, b: Column) -> Column:
    """Whether two node structs are one package: by name, then integrity, then
    resolved address, then name and version."""
    return (
        F.when(a["name"] != b["name"], False)
        .when(a["is_link"] | b["is_link"], F.coalesce(a["is_link"] & b["is_link"] & (a["target_location"] == b["target_location"]), F.lit(False)))
        .when(a["integrity"].isNotNull() & b["integrity"].isNotNull(), a["integrity"] == b["integrity"])
        .when(a["resolved"].isNotNull() & b["resolved"].isNotNull(), a["resolved"] == b["resolved"])
        .otherwise((a["package_name"] == b["package_name"]) & a["version"].eqNullSafe(b["version"]))
    )


def can_replace(edges: DataFrame, candidates: DataFrame, root: str = "") -> DataFrame:
    """candidates (location, version): whether each edge into the location that
    isn't the root's own would be satisfied by the version."""
    others = edges.where("dst is not null").where(F.col("src") != root)
    terms = semver.range_terms(others.select("spec"))
    into = candidates.join(others.select(F.col("dst").alias("location"), "spec"), "location").join(terms, "spec", "left")
    held = into.groupBy("location", "version").agg(F.bool_and(semver.sv_satisfies(semver.sv(F.col("version")), F.col("terms"))).alias("ok"))
    return candidates.join(held, ["location", "version"], "left").withColumn("ok", F.coalesce("ok", F.lit(True)))


def can_dedupe(nodes: DataFrame, edges: DataFrame, prefer: bool = False) -> DataFrame:
    """(location, verdict) of nodes in folders of folders, but bundled ones:
    whether each could go, as the package of its name next above its folder
    would do. `unwanted`: no edge leads to it; `same`: that one is the same
    package; `equal` or `newer`: it meets all edges into the node and its
    version is equal, or higher and the node isn't overridden; `preferred`: it
    meets them, and with `prefer` that is enough. null: it must stay."""
    text_of = lambda c: F.col(c) if c in nodes.columns else F.lit(None).cast("string")
    own = nodes.select("location", "name", "package_name", "version", "is_link", "target_location", "overridden", "in_bundle", text_of("integrity").alias("integrity"), text_of("resolved").alias("resolved"))
    inner = own.where(F.col("location").rlike(FOLDER) & ~F.col("in_bundle")).withColumn("folder", F.regexp_replace("location", FOLDER, "")).where(F.col("folder") != "")
    chain = inner.select("location", "name", F.regexp_replace("folder", FOLDER, "").alias("_from"))
    up = ancestors(chain.select(F.col("_from").alias("location"))).withColumnRenamed("location", "_from")
    seen = chain.join(up, "_from").select("location", "depth", F.concat("ancestor", F.when(F.col("ancestor") == "", "node_modules/").otherwise("/node_modules/"), "name").alias("at"))
    other = own.select(F.col("location").alias("at"), F.struct(*own.columns).alias("o"))
    nearest = seen.join(other, "at").groupBy("location").agg(F.max_by("o", "depth").alias("o"))
    into = edges.where("dst is not null").groupBy(F.col("dst").alias("location")).agg(F.count(F.lit(1)).alias("_n"))
    meets = can_replace(edges, nearest.select("location", F.col("o.version").alias("version"))).select("location", F.col("ok").alias("_ok"))
    rows = inner.join(nearest, "location", "left").join(into, "location", "left").join(meets, "location", "left")
    mine, theirs = F.struct(*own.columns), F.col("o")
    a, b = semver.sv(F.col("version")), semver.sv(F.col("o.version"))
    verdict = (
        F.when(F.col("_n").isNull(), "unwanted").when(F.col("o").isNull(), None).when(matches(theirs, mine), "same").when(~F.coalesce("_ok", F.lit(False)), None)
        .when(a == b, "equal").when(F.lit(prefer), "preferred").when(~F.col("overridden") & (b > a), "newer")
    )
    return rows.select("location", verdict.alias("verdict"))


def check_tree(graph: Graph) -> DataFrame:
    """(check, n): breaches of what must hold of any graph; all zero if sound."""
    n, e = graph.nodes, graph.edges
    known = n.select(F.col("location").alias("at"))
    found = [
        ("duplicate location", n.groupBy("location").count().where("count > 1")),
        ("duplicate edge", e.groupBy("src", "name").count().where("count > 1")),
        ("edge from nowhere", e.join(known, e["src"] == known["at"], "left_anti")),
        ("edge to nowhere", e.where("dst is not null").join(known, e["dst"] == known["at"], "left_anti")),
        ("link without target", n.where("is_link").join(known, n["target_location"] == known["at"], "left_anti")),
        ("no single root", n.where("is_root").agg(F.count(F.lit(1)).alias("c")).where("c <> 1")),
    ]
    out = None
    for name, bad in found:
        row = bad.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n")
        out = row if out is None else out.union(row)
    return out

"""Selectors to Spark plans.

A set of items is a table of keys - `location`, or (`seed`, `location`) inside
a correlated query - and a list of conditions on the nodes not yet applied.
Conditions are applied together in one filter; combinators are semi joins over
edges; descendants are closures. `:has` runs its inner query once for all
items, each row carrying the item it started from, instead of once an item.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweft.functions import semver, text
from graphweft.operators.closure import closure, many
from graphweft.operators.graph import Graph
from graphweft.plans.parser import Attribute, QueryError, Token, parse
from graphweft.storage import buckets

SEMVER_OF_VERSIONS = ("eq", "neq", "gt", "gte", "lt", "lte")
SEMVER_OF_RANGES = ("gtr", "ltr", "satisfies", "intersects", "subset")


@dataclass(frozen=True)
class Items:
    """keys None: the whole inventory."""

    keys: DataFrame | None = None
    where: tuple[Column, ...] = ()

    def also(self, condition: Column) -> Items:
        return replace(self, where=(*self.where, condition))


# --- attributes --------------------------------------------------------------------


def step(name: str) -> str:
    return "$['" + name.replace("'", "\\'") + "']"


def truthy(value: Column) -> Column:
    """Whether a variant counts as there: not null, empty text, zero or false."""
    kind = F.schema_of_variant(value)
    plain = F.try_variant_get(value, "$", "string")
    empty = ((kind == "STRING") & (plain == "")) | ((kind == "BOOLEAN") & (plain == "false")) | (kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") & (F.try_variant_get(value, "$", "double") == 0))
    return F.coalesce(value.isNotNull() & (kind != "VOID") & ~empty, F.lit(False))


def compare(value: Column, a: Attribute) -> Column:
    """One text against an attribute's operator."""
    wanted, value = a.value, F.coalesce(value, F.lit(""))
    if a.insensitive:
        wanted, value = wanted.lower(), F.lower(value)
    if a.operator == "=":
        return value == wanted
    if a.operator == "~=":
        return F.array_contains(F.regexp_extract_all(value, F.lit(r"\w+"), F.lit(0)), wanted)
    if a.operator == "*=":
        return value.contains(wanted)
    if a.operator == "|=":
        return value.startswith(wanted + "-")
    if a.operator == "^=":
        return value.startswith(wanted)
    return value.endswith(wanted)


def attribute_match(value: Column, a: Attribute) -> Column:
    """A variant object's attribute against a matcher; of an array any element."""
    at = F.try_variant_get(value, step(a.name), "variant")
    if not a.operator:
        return truthy(at)
    plain = lambda v: F.when(truthy(v), F.try_variant_get(v, "$", "string"))
    items = F.try_variant_get(value, step(a.name), "array<variant>")
    return F.when(items.isNotNull(), F.exists(items, lambda v: compare(plain(v), a))).otherwise(compare(plain(at), a))


def walk(value: Column, path: tuple[str, ...]) -> Column:
    """The objects at the end of a path, as an array of variants. Arrays on the
    way are gone through; "[]" goes through one more level."""
    def through(v: Column) -> Column:
        return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))

    def into(name: str):
        def one(v: Column) -> Column:
            at = F.try_variant_get(v, step(name), "variant")
            return F.coalesce(F.try_variant_get(v, step(name), "array<variant>"), F.when(truthy(at), F.array(at)), F.array().cast("array<variant>"))

        return one

    found = F.array(value)
    for name in path:
        found = F.flatten(F.transform(found, through if name == "[]" else into(name)))
    return found


# --- the compiler ------------------------------------------------------------------


class Compiler:
    def __init__(self, graph: Graph, scope: str | None = None, before: str | None = None, exclude: tuple[str, ...] = ()):
        """scope: the location that :scope stands for. before: versions published
        later, or at no known time, don't count, but for names in exclude."""
        self.g, self.scope, self.before, self.exclude = graph, graph.root if scope is None else scope, before, exclude
        self.missing: DataFrame | None = None

    # sets of keys

    def table(self, items: Items) -> DataFrame:
        """The items' keys with all conditions applied."""
        if items.keys is None:
            out = self.g.nodes
        elif not items.where:
            return items.keys
        else:
            out = many(items.keys).join(self.g.nodes, "location")
        for c in items.where:
            out = out.where(c)
        return out.select(*self.cols(items))

    def cols(self, items: Items) -> list[str]:
        return ["seed", "location"] if items.keys is not None and "seed" in items.keys.columns else ["location"]

    def kept(self, items: Items, other: DataFrame, how: str = "left_semi") -> Items:
        """items within (or, by left_anti, without) a table of locations, by seed where both have it."""
        keys = self.table(items)
        on = [c for c in ("seed", "location") if c in keys.columns and c in other.columns]
        return Items(keys.join(many(other.select(*on).distinct()), on, how))

    # evaluation

    def query(self, text_: str) -> DataFrame:
        """Nodes of the query, with missing dependencies as rows of their own."""
        selectors = parse(text_)
        if not selectors:
            return self.g.nodes.where("false")
        found = self.list(selectors, Items(), Items())
        nodes = self.g.nodes
        if found.keys is None:  # conditions only: no join
            for c in found.where:
                nodes = nodes.where(c)
        else:
            nodes = nodes.join(many(self.table(found).distinct()), "location", "left_semi")
        if self.missing is not None:
            made = self.missing.select(F.concat(F.lit("?"), "src", F.lit(">"), "name").alias("location"), "name", F.col("spec").alias("version"))
            rest = [f for f in self.g.nodes.schema.fields if f.name not in ("location", "name", "version")]
            made = made.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in rest])
            nodes = nodes.unionByName(made)
        return nodes

    def list(self, selectors, initial: Items, first: Items) -> Items:
        """Union of the selectors. Only the first starts at the given items
        when it begins with a combinator; the others then start from none."""
        if len(selectors) == 1:
            return self.selector(selectors[0], initial, initial)
        tables = [self.table(self.selector(s, initial, initial if k == 0 else None)) for k, s in enumerate(selectors)]
        out = tables[0]
        for t in tables[1:]:
            out = out.unionByName(t)
        return Items(out.distinct())

    def selector(self, tokens: tuple[Token, ...], initial: Items, current: Items | None) -> Items:
        none = Items(self.table(initial).where("false"))
        current = none if current is None else current
        pending: str | None = None
        for k, token in enumerate(tokens):
            if token.kind == "combinator":
                pending = token.value
                continue
            base = initial if k == 0 else (Items() if tokens[k - 1].kind == "combinator" else current)
            found = self.token(token, base)
            if pending:
                current, pending = self.combine(pending, current, found), None
            else:
                current = found
        return current

    def combine(self, how: str, left: Items, right: Items) -> Items:
        keys = self.table(left)
        if how == ">":
            other = self.children(keys)
        elif how == " ":
            other = closure(self.g.descent(), self.children(keys)).drop("depth")
        else:
            seeds = [c for c in keys.columns if c == "seed"]
            up = many(keys).join(self.g.resolved.select(F.col("dst").alias("location"), "src"), "location").select(*seeds, F.col("src").alias("location")).distinct()
            other = self.children(up).join(many(keys), keys.columns, "left_anti")
        if "seed" in keys.columns and (right.keys is None or "seed" not in right.keys.columns):
            own = self.table(right).distinct()
            return Items(other.join(many(own), "location", "left_semi").select("seed", "location"))
        return self.kept(right, other)

    def children(self, keys: DataFrame) -> DataFrame:
        """Nodes with an edge from the keys (from its target for a link), and top
        nodes of a containing folder that holds a link to them."""
        n = self.g.nodes
        seeds = [c for c in keys.columns if c == "seed"]
        links = n.where("is_link").select("location", "target_location")
        source = keys.join(many(links), "location", "left").select(*seeds, F.coalesce("target_location", "location").alias("src")).distinct()
        by_edge = many(source).join(self.g.resolved.select("src", "dst"), "src").select(*seeds, F.col("dst").alias("location"))
        tops = n.where("resolve_parent is not null and not in_store").select("location", F.col("resolve_parent").alias("src"))
        parents = n.where("is_link").select(F.col("target_location").alias("location"), F.regexp_replace("location", r"(?:^|/)node_modules/(?:@[^/]+/)?[^/]+$", "").alias("src"))
        by_link = many(source).join(many(tops).join(parents, ["location", "src"]), "src").select(*seeds, "location")
        return by_edge.union(by_link).distinct()

    # tokens

    def token(self, t: Token, base: Items) -> Items:
        if t.kind == "universal":
            return base
        if t.kind == "id":
            return base.also((F.col("name") == t.value) | (F.col("package_name") == t.value))
        if t.kind == "attribute":
            return base.also(attribute_match(F.col("package"), t.attribute))
        if t.kind == "class":
            return self.dependency_class(t.value, base)
        return getattr(self, f"pseudo_{t.value}")(t, base)

    def dependency_class(self, kind: str, base: Items) -> Items:
        if kind == "prod":
            return base.also(~F.col("dev"))
        if kind == "workspace":
            return base.also(F.col("is_workspace"))
        if kind == "bundled":
            return base.also(F.col("in_bundle"))
        return self.kept(base, self.g.by_type(kind))

    def pseudo_root(self, t: Token, base: Items) -> Items:
        return base.also(F.col("location") == self.g.root)

    def pseudo_scope(self, t: Token, base: Items) -> Items:
        if base.keys is not None and "seed" in base.keys.columns:
            return base.also(F.col("location") == F.col("seed"))
        return base.also(F.col("location") == self.scope)

    def pseudo_private(self, t: Token, base: Items) -> Items:
        return base.also(truthy(F.try_variant_get("package", "$.private", "variant")))

    def pseudo_extraneous(self, t: Token, base: Items) -> Items:
        return base.also(F.col("extraneous"))

    def pseudo_overridden(self, t: Token, base: Items) -> Items:
        return base.also(F.col("overridden"))

    def pseudo_link(self, t: Token, base: Items) -> Items:
        return base.also(F.col("is_link") | (F.col("resolve_parent").isNotNull() & ~F.col("is_root")))

    def pseudo_attr(self, t: Token, base: Items) -> Items:
        return base.also(F.exists(walk(F.col("package"), t.args), lambda v: attribute_match(v, t.attribute)))

    def pseudo_empty(self, t: Token, base: Items) -> Items:
        return self.kept(base, self.g.edges.select(F.col("src").alias("location")), "left_anti")

    def pseudo_invalid(self, t: Token, base: Items) -> Items:
        return self.kept(base, self.g.resolved.where("error = 'INVALID'").select(F.col("dst").alias("location")))

    def pseudo_deduped(self, t: Token, base: Items) -> Items:
        """Of a link the edges into its target count."""
        into = self.g.resolved.groupBy(F.col("dst").alias("location")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("location")
        links = self.g.nodes.where("is_link").select(F.col("location").alias("link"), F.col("target_location").alias("location"))
        of_links = many(links).join(into, "location").select(F.col("link").alias("location"))
        return self.kept(base, into.join(many(links.select(F.col("link").alias("location"))), "location", "left_anti").union(of_links))

    def pseudo_missing(self, t: Token, base: Items) -> Items:
        """Rows made from missing edges, whatever the items so far."""
        self.missing = self.g.edges.where("error = 'MISSING'")
        return Items(self.table(base).where("false"))

    def pseudo_path(self, t: Token, base: Items) -> Items:
        if not t.args or not t.args[0]:
            return base
        pattern = text.glob_regex(text.resolve_path(self.g.root_path, t.args[0]))
        return base.also(F.coalesce(F.col("realpath").rlike(pattern), F.lit(False)))

    def pseudo_not(self, t: Token, base: Items) -> Items:
        return self.kept(base, self.table(self.list(t.nested, base, base)), "left_anti")

    def pseudo_is(self, t: Token, base: Items) -> Items:
        """The inner query's result as it is: not cut down to the items when it has a combinator."""
        return Items(self.table(self.list(t.nested, base, base)).distinct())

    def pseudo_has(self, t: Token, base: Items) -> Items:
        keys = self.table(base)
        if "seed" in keys.columns:  # a query within a query: its items are the seeds now
            items = keys.select(F.col("location").alias("seed")).distinct()
        else:
            items = keys.select(F.col("location").alias("seed"))
        seeded = Items(items.select("seed", F.col("seed").alias("location")))
        found = self.table(self.list(t.nested, seeded, seeded)).select(F.col("seed").alias("location"))
        return self.kept(base, found)

    def pseudo_type(self, t: Token, base: Items) -> Items:
        if not t.args or not t.args[0]:
            return base
        kind = text.spec_type(F.col("spec"))
        same = text.is_registry(kind) if t.args[0] == "registry" else kind == t.args[0]
        return self.kept(base, self.g.resolved.where(same).select(F.col("dst").alias("location")))

    def pseudo_semver(self, t: Token, base: Items) -> Items:
        if not t.args or not t.args[0]:
            return base
        wanted, path, fn = t.args
        literal = semver.parse(wanted)
        if literal is None and not semver.valid_range(wanted):
            raise QueryError("EQUERYINVALIDSEMVER", f"`{wanted}` is not a version or range")
        if fn not in ("infer", *SEMVER_OF_VERSIONS, *SEMVER_OF_RANGES):
            raise QueryError("EQUERYINVALIDOPERATOR", f"`semver.{fn}` is not an operator")
        # of a nested path only the first key is followed
        package = F.explode(walk(F.col("package"), path[:1])).alias("object") if path else F.col("package").alias("object")
        first = F.try_variant_get("object", step(t.attribute.name), "variant")
        source = self.g.nodes.select("location", package)
        if t.attribute.operator:
            source = source.where(attribute_match(F.col("object"), t.attribute))
        held = source.where(F.schema_of_variant(first) == "STRING").select("location", F.try_variant_get(first, "$", "string").alias("value"))
        exact = held.where(F.col("value").rlike(semver.VERSION))
        v = semver.sv(F.col("value"))
        as_version = fn if fn != "infer" else ("eq" if literal else "satisfies")
        test = F.lit(False)
        if literal:
            b = semver.literal(literal)
            test = {"eq": v == b, "neq": v != b, "gt": v > b, "gte": v >= b, "lt": v < b, "lte": v <= b}.get(as_version, test)
        if as_version == "satisfies":
            test = semver.in_range(v, wanted)
        found = exact.where(test).select("location")
        others = held.where(~F.col("value").rlike(semver.VERSION))
        if as_version in ("gtr", "ltr", "intersects", "subset"):
            others = held  # the rest is tested on distinct texts
        as_range = fn if fn != "infer" else ("satisfies" if literal else "intersects")
        if as_range in SEMVER_OF_RANGES:
            pairs = others.select("value").distinct().withColumn("wanted", F.lit(wanted))
            if as_range in ("intersects", "subset"):
                good = semver.pair_test(as_range)("value", "wanted")
            elif literal:
                good = semver.pair_test(as_range)("wanted", "value")
            else:
                good = F.col("value").rlike(semver.VERSION) & semver.pair_test(as_range)("value", "wanted")
            found = found.union(others.join(many(pairs.where(good).select("value")), "value", "left_semi").select("location"))
        return self.kept(base, found)

    def pseudo_vuln(self, t: Token, base: Items) -> Items:
        return self.kept(base, self.vulnerable(t.args).select("location"))

    def vulnerable(self, groups: tuple = ()) -> DataFrame:
        """(location, advisories) of nodes that some advisory's range meets."""
        nodes = self.g.nodes.select("location", "name", "version")
        return many(nodes).join(self.advised(groups), ["name", "version"]).select("location", "advisories")

    def advised(self, groups: tuple = ()) -> DataFrame:
        """(name, version, advisories) of packages that some advisory's range meets."""
        a = self.g.advisories
        keep = F.lit(not groups)
        for severities, weaknesses in groups:
            one = F.lit(True)
            if severities and "*" not in severities:
                one = one & F.coalesce(F.col("severity").isin(*severities), F.lit(False))
            if "*" in weaknesses:
                one = one & (F.size(F.coalesce("cwe", F.array().cast("array<string>"))) > 0)
            else:
                for w in weaknesses:
                    one = one & F.array_contains(F.coalesce("cwe", F.array().cast("array<string>")), f"CWE-{w}")
            keep = keep | one
        own = a.where(keep).join(semver.range_terms(a.select(F.col("vulnerable_versions").alias("spec"))), F.col("vulnerable_versions") == F.col("spec")).drop("spec")
        pairs = many(self.packages()).join(own, "name")
        hit = pairs.where(semver.sv_satisfies(F.col("_v"), F.col("terms"), include_prerelease=True))
        return hit.groupBy("name", "version").agg(F.collect_list(F.struct(*[c for c in a.columns if c != "name"])).alias("advisories"))

    def packages(self) -> DataFrame:
        """(name, version, _v): each package once, however many nodes hold it."""
        return self.g.nodes.select("name", "version").distinct().withColumn("_v", semver.sv(F.col("version")))

    def pseudo_outdated(self, t: Token, base: Items) -> Items:
        return self.kept(base, self.outdated(t.args[0] if t.args and t.args[0] else "any").select("location"))

    def available(self) -> DataFrame:
        """(name, newer, _n): versions of each name, as of `before`."""
        v = self.g.versions.select("name", "version", "published_at")
        if self.before is not None:
            spared = F.lit(False)
            for glob in self.exclude:
                spared = spared | F.col("name").rlike(text.glob_regex(glob))
            v = v.where(F.coalesce(F.col("published_at") <= F.lit(self.before).cast("timestamp"), F.lit(False)) | spared)
        return v.select("name", F.col("version").alias("newer"), semver.sv(F.col("version")).alias("_n")).where("_n is not null").distinct()

    @staticmethod
    def may_be_outdated() -> Column:
        return ~F.col("is_root") & ~truthy(F.try_variant_get("package", "$.private", "variant"))

    def newer_versions(self) -> DataFrame:
        """(name, version, newer): the packages that have newer versions, with
        these, the highest first. A name's versions are gathered and sorted once;
        what is newer than one of them is the head of that list, as long as a
        count along the order tells, so versions are never paired."""
        there = self.available()
        listed = there.groupBy("name").agg(F.reverse(F.array_sort(F.collect_set(F.struct("_n", "newer")))).alias("_all"))
        listed = listed.select("name", F.transform("_all", lambda x: x["newer"]).alias("_all"))
        asked = self.packages().where("_v is not null").select("name", "version", F.col("_v").alias("_n"), F.lit(0).alias("_one"))
        both = asked.unionByName(there.select("name", "_n", F.lit(1).alias("_one")), allowMissingColumns=True)
        each = Window.partitionBy("name")
        above = F.sum("_one").over(each) - F.sum("_one").over(each.orderBy("_n"))  # the latter with its equals
        placed = both.withColumns({"_above": above.cast("int"), "_own": F.col("_one") == 0}).where("_own and _above > 0")
        # dealt out by hand, since lists of few names look small and would be joined in one task
        parts = buckets(self.g.nodes.sparkSession)
        found = many(placed.repartition(parts, "name")).join(listed.repartition(parts, "name"), "name")
        return found.select("name", "version", F.slice("_all", F.lit(1), F.col("_above")).alias("newer"))

    def outdated(self, kind: str = "any") -> DataFrame:
        """(location, newer): nodes with a newer version of the kind. Versions are
        compared once for each installed version of a name, and for each range
        that asks for it where ranges count, not for each node."""
        own = self.g.nodes.where(self.may_be_outdated()).select("location", "name", "version")
        if kind == "any":
            return many(own).join(self.newer_versions(), ["name", "version"]).select("location", "newer")
        own = own.join(self.available().select("name").distinct(), "name", "left_semi")
        by = ["name", "version"]
        if kind in ("in-range", "out-of-range"):
            by.append("spec")
            own = many(own).join(self.g.resolved.select(F.col("dst").alias("location"), "spec").distinct(), "location")
        asked = own.select(*by).distinct().withColumn("_v", semver.sv(F.col("version")))
        pairs = many(asked).join(self.available(), "name").where(F.col("_n") > F.col("_v"))
        if kind in ("major", "minor", "patch"):
            pairs = pairs.where(semver.sv_difference(F.col("_v"), F.col("_n")) == kind)
        elif len(by) == 3:
            let_in = semver.sv_satisfies(F.col("_n"), F.col("terms"))
            pairs = pairs.join(semver.range_terms(self.g.resolved.select("spec")), "spec").where(let_in if kind == "in-range" else ~let_in)
        elif len(by) == 2:
            pairs = pairs.where("false")
        found = pairs.groupBy(*by).agg(F.array_sort(F.collect_set(F.struct("_n", "newer"))).alias("newer"))
        told = many(own).join(found.select(*by, F.transform("newer", lambda x: x["newer"]).alias("newer")), by)
        if len(by) == 2:
            return told.select("location", F.reverse("newer").alias("newer"))
        return told.groupBy("location").agg(F.array_distinct(F.flatten(F.collect_list("newer"))).alias("newer"))


def select(graph: Graph, query: str, scope: str | None = None, before: str | None = None, exclude: tuple[str, ...] = ()) -> DataFrame:
    """The nodes that a selector finds."""
    return Compiler(graph, scope, before, exclude).query(query)


def package_id(name: Column, package_name: Column, version: Column) -> Column:
    """name@version, or name@npm:package@version for an alias."""
    alias = F.when(name != package_name, F.concat(F.lit("npm:"), package_name, F.lit("@"))).otherwise(F.lit(""))
    return F.concat(name, F.lit("@"), alias, F.coalesce(version, F.lit("")))



"""Rules of a root manifest that add to other packages' manifests, and whether
a lockfile still agrees with them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.functions import semver

FIELDS = ("dependencies", "optionalDependencies", "peerDependencies", "peerDependenciesMeta")
NORMAL = FIELDS[:2]
RULES = "selector string, name string, range string, dependencies map<string,string>, optionalDependencies map<string,string>, peerDependencies map<string,string>, peerDependenciesMeta map<string,map<string,boolean>>"


class ExtensionError(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def selector_of(key: str) -> tuple[str, str | None]:
    """(name, range) of `name` or `name@range`; tags, addresses and blank ranges are refused."""
    name, at, range_ = key.partition("@") if not key.startswith("@") else (lambda p: ("@" + p[0], p[1], p[2]))(key[1:].partition("@"))
    if not name or name != name.strip() or (at and (not range_.strip() or not semver.valid_range(range_))):
        raise ExtensionError("EEXTENSIONSELECTOR", f"{key!r} is no package name with a range")
    return name, range_ if at else None


def extension_rules(spark: SparkSession, raw: dict) -> DataFrame:
    """A manifest's extensions, checked, a row for each selector."""
    if not isinstance(raw, dict):
        raise ExtensionError("EEXTENSIONROOT", "extensions must be an object")
    rows = []
    for key, held in raw.items():
        name, range_ = selector_of(key)
        if not isinstance(held, dict):
            raise ExtensionError("EEXTENSIONVALUE", f"{key!r} must be an object")
        for field, value in held.items():
            if field not in FIELDS:
                raise ExtensionError("EEXTENSIONFIELD", f"{key!r} has {field!r}, which can't be extended")
            if not isinstance(value, dict) or (field == FIELDS[3] and not all(isinstance(m, dict) for m in value.values())):
                raise ExtensionError("EEXTENSIONVALUE", f"{field!r} of {key!r} must hold objects")
            if field != FIELDS[3] and any(v in (None, False, "-") for v in value.values()):
                raise ExtensionError("EEXTENSIONDELETE", f"{field!r} of {key!r} can't delete")
        rows.append((key, name, range_, *(held.get(f) or {} for f in FIELDS)))
    return spark.createDataFrame(rows, RULES)


def digest_of(raw: dict) -> str:
    """The raw rules as JSON text, to be hashed by text.json_digest."""
    return json.dumps(raw)


def matches(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """(location, selectors): the selectors of the package's own name that its
    version meets, in order; a selector without a range meets any version."""
    terms = semver.range_terms(rules.select(F.col("range").alias("spec"))).withColumnRenamed("spec", "range")
    own = rules.select(F.col("name").alias("package_name"), "selector", "range").join(terms, "range", "left")
    met = nodes.select("location", "package_name", semver.sv(F.col("version")).alias("_v")).join(own, "package_name")
    met = met.where(F.col("range").isNull() | semver.sv_satisfies(F.col("_v"), F.col("terms")))
    return met.groupBy("location").agg(F.sort_array(F.collect_list("selector")).alias("selectors"))


def extended(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """(location, selector, dependencies, optionalDependencies,
    peerDependencies, peerDependenciesMeta, applied, error) of the nodes that a
    selector meets: their fields with what it adds, and the names added by
    field.

    Dependencies, optional or not, are only added: one that the manifest has in
    either field is EEXTENSIONDUPDEP. Peers take the place of the manifest's;
    their meta is merged key by key, and one without a peer is
    EEXTENSIONORPHANMETA. A node that several selectors meet is
    EEXTENSIONCONFLICT. A node with an error keeps its own fields."""
    kind = lambda f: "map<string,map<string,boolean>>" if f == FIELDS[3] else "map<string,string>"
    got = lambda f: F.coalesce(F.try_variant_get("package", f"$.{f}", kind(f)), F.create_map().cast(kind(f)))
    own = nodes.select("location", F.struct(*[got(f).alias(f) for f in FIELDS]).alias("own"))
    rows = matches(nodes, rules).withColumn("selector", F.element_at("selectors", 1)).join(own, "location")
    rows = rows.join(rules.select("selector", F.struct(*FIELDS).alias("more")), "selector")
    keys = lambda m: F.map_keys(m)
    has = F.array_union(keys("own.dependencies"), keys("own.optionalDependencies"))
    adds = F.concat(keys("more.dependencies"), keys("more.optionalDependencies"))
    over = lambda a, b: F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)
    peers = over(F.col("own.peerDependencies"), F.col("more.peerDependencies"))
    meta = F.col("more.peerDependenciesMeta")
    merged_meta = over(F.col("own.peerDependenciesMeta"), F.transform_values(meta, lambda k, m: over(F.coalesce(F.try_element_at(F.col("own.peerDependenciesMeta"), k), F.create_map().cast("map<string,boolean>")), m)))
    twice = F.concat(F.array_intersect(has, adds), F.array_intersect(keys("more.dependencies"), keys("more.optionalDependencies")))
    orphans = F.array_except(keys(meta), keys(peers))
    error = (
        F.when(F.size("selectors") > 1, F.concat(F.lit("EEXTENSIONCONFLICT: "), F.array_join("selectors", ", ")))
        .when(F.size(twice) > 0, F.concat(F.lit("EEXTENSIONDUPDEP: "), F.array_join(F.array_sort(twice), ", ")))
        .when(F.size(orphans) > 0, F.concat(F.lit("EEXTENSIONORPHANMETA: "), F.array_join(F.array_sort(orphans), ", ")))
    )
    rows = rows.withColumn("error", error)
    new = {FIELDS[0]: over(F.col("own.dependencies"), F.col("more.dependencies")), FIELDS[1]: over(F.col("own.optionalDependencies"), F.col("more.optionalDependencies")), FIELDS[2]: peers, FIELDS[3]: merged_meta}
    under = lambda f: F.transform(F.array_sort(keys(f"more.{f}")), lambda n: F.concat(F.lit(f + "."), n))
    applied = F.when(F.col("error").isNull(), F.flatten(F.array(*[under(f) for f in FIELDS])))
    return rows.select("location", "selector", *[F.when(F.col("error").isNull(), new[f]).otherwise(F.col(f"own.{f}")).alias(f) for f in FIELDS], applied.alias("applied"), "error")


def state_error(wanted: str | None, locked: str | None) -> str | None:
    """What is wrong if the digest of the manifest's rules and the lock's differ."""
    if wanted == locked:
        return None
    if wanted and not locked:
        return "Missing: packageExtensions state from lock file"
    if locked and not wanted:
        return "Invalid: lock file records packageExtensions state but package.json has none"
    return "Invalid: packageExtensions in package.json do not match the lock file"


def validate_extensions(nodes: DataFrame, rules: DataFrame, wanted: str | None, locked: str | None) -> DataFrame:
    """(error): of a lock's nodes (with `applied_selector`, null where none was
    applied) under the rules. Digests that differ are the only error then."""
    spark = nodes.sparkSession
    state = state_error(wanted, locked)
    if state:
        return spark.createDataFrame([(state,)], "error string")
    own = nodes.where("not is_root and not is_workspace")
    told = own.join(matches(own, rules), "location", "left").join(rules.select(F.col("selector").alias("applied_selector"), F.lit(True).alias("_known")), "applied_selector", "left")
    ref = F.concat("package_name", F.lit("@"), F.coalesce("version", F.lit("")))
    conflict = F.when(F.size("selectors") > 1, F.concat(F.lit("Invalid: several packageExtensions selectors match "), ref, F.lit(": "), F.array_join("selectors", ", ")))
    stale = F.when(F.col("applied_selector").isNotNull() & (F.col("_known").isNull() | F.col("selectors").isNull()), F.concat(F.lit("Invalid: stale packageExtensions provenance for "), "name", F.lit("@"), F.coalesce("version", F.lit("")), F.lit(' (selector "'), "applied_selector", F.lit('")')))
    return told.select(F.explode(F.array_compact(F.array(conflict, stale))).alias("error"))

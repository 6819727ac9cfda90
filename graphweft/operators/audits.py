"""What an audit says beyond its hits: effects, fixes carried along, simple ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft.functions import semver, text
from graphweft.operators.fixpoints import least_along
from graphweft.operators.graph import Graph
from graphweft.operators.ordering import numbered
from graphweft.operators.reports import let_in, severity_rank
from graphweft.storage import stored


def effects(audited: DataFrame) -> DataFrame:
    """(name, severity, via, effects) of each vulnerable name: its worst
    severity, what makes it vulnerable (advisories and names) and the names that
    it makes vulnerable. audited: reports.audit."""
    names = audited.groupBy("name").agg(F.max_by("severity", severity_rank(F.col("severity"))).alias("severity"), F.sort_array(F.collect_set("via")).alias("via"))
    caused = audited.select(F.col("via").alias("_of"), "name").distinct().groupBy("_of").agg(F.sort_array(F.collect_set("name")).alias("effects"))
    return names.join(caused, F.col("name") == F.col("_of"), "left").select("name", "severity", "via", F.coalesce("effects", F.array().cast("array<string>")).alias("effects"))


#: How bad a fix is: none, one that needs a new major version, one outside the range, one within.
NONE, MAJOR, MINOR, WITHIN = range(4)
_FIX = "rank int, name string, version string"


def fixes(graph: Graph, audited: DataFrame, tops: DataFrame) -> DataFrame:
    """(name, spec, fix) for each vulnerable name that a top node needs, and
    each range in which it does. The fix, {rank, name, version}, is WITHIN where
    the range lets in a version that isn't vulnerable; else MINOR, to the highest
    good version within a caret of the highest that the range lets in; else
    MAJOR, to the highest good version; else, and for anything but ranges of a
    registry, NONE. tops: location."""
    # written, so that no condition on its specs is tested on each edge instead
    asked = stored(graph.resolved.join(tops.select(F.col("location").alias("src")), "src", "left_semi").select("name", "spec").distinct().join(audited.select("name").distinct(), "name", "left_semi"), "asked")
    ranged = asked.where(text.is_registry(text.spec_type(F.col("spec"))))
    # what is vulnerable: versions found so, and versions in an advisory's range
    ranges = graph.advisories.select("name", F.col("vulnerable_versions").alias("spec"))
    v = graph.versions.select("name", "version").union(graph.nodes.select("name", "version")).distinct().join(asked.select("name").distinct(), "name", "left_semi")
    parsed = stored(v.select("version").distinct().withColumn("v", semver.sv(F.col("version"))).where("v is not null"), "parsed")
    v = v.join(parsed, "version").select("name", "version", "v")
    told = v.join(ranges, "name").join(semver.range_terms(ranges.select("spec")), "spec").where(semver.sv_satisfies(F.col("v"), F.col("terms"), True)).select("name", "version")
    bad = told.union(audited.select("name", "version")).distinct().withColumn("bad", F.lit(True))
    judged = stored(v.join(bad, ["name", "version"], "left").select("name", "version", "v", F.col("bad").isNull().alias("good")), "judged")
    inside = let_in(ranged.join(judged, "name")).withColumn("_in", F.coalesce(F.col("spec").isin("", "*") | F.col("_in"), F.lit(False)))
    found = inside.groupBy("name", "spec").agg(
        F.bool_or(F.col("_in") & F.col("good")).alias("within"), F.max_by("version", F.when(F.col("_in"), F.col("v"))).alias("first"), F.max_by("version", F.when(F.col("good"), F.col("v"))).alias("far"),
    )
    found = stored(found, "found")
    near = found.where("not within and first is not null").select("name", "spec", F.concat(F.lit("^"), "first").alias("caret"))
    caret = semver.range_terms(near.select(F.col("caret").alias("spec"))).withColumnRenamed("spec", "caret")
    close = near.join(caret, "caret").join(judged.where("good"), "name").where(semver.sv_satisfies(F.col("v"), F.col("terms"))).groupBy("name", "spec").agg(F.max_by("version", "v").alias("close"))
    rows = asked.join(found, ["name", "spec"], "left").join(close, ["name", "spec"], "left")
    value = lambda rank, version: F.struct(F.lit(rank).alias("rank"), (F.col("name") if version else F.lit(None).cast("string")).alias("name"), (F.col(version) if version else F.lit(None).cast("string")).alias("version"))
    fix = F.when(F.col("within"), value(WITHIN, None)).when(F.col("close").isNotNull(), value(MINOR, "close")).when(F.col("far").isNotNull() & F.col("first").isNotNull(), value(MAJOR, "far")).otherwise(value(NONE, None))
    return rows.select("name", "spec", fix.alias("fix"))


def fix_chain(graph: Graph, audited: DataFrame, tops: DataFrame) -> DataFrame:
    """(name, fix, fix_name, fix_version, major) of each vulnerable name: the
    worst of its own fixes and of those of all names that it makes vulnerable,
    however far: a package that a top node holds in place holds what it needs.
    fix: none, outside (its range) or within. What no top node holds is fixed
    within its range. Of equally bad fixes the least name and version count."""
    own = fixes(graph, audited, tops).select(F.col("name").alias("location"), F.col("fix").alias("value"))
    free = audited.select(F.col("name").alias("location")).distinct().select("location", F.struct(F.lit(WITHIN).alias("rank"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("version")).alias("value"))
    names = audited.select(F.col("name").alias("dst")).distinct()
    links = audited.select(F.col("name").alias("src"), F.col("via").alias("dst")).distinct().join(names, "dst", "left_semi")
    worst = least_along(links.select("src", "dst"), own.unionByName(free))
    told = F.when(F.col("value.rank") == NONE, "none").when(F.col("value.rank") == WITHIN, "within").otherwise("outside")
    return worst.select(F.col("location").alias("name"), told.alias("fix"), F.col("value.name").alias("fix_name"), F.col("value.version").alias("fix_version"), (F.col("value.rank") == MAJOR).alias("major"))


def simple_ranges(ranges: DataFrame, versions: DataFrame) -> DataFrame:
    """(name, range, simple): each name's range told by the known versions that
    it lets in: a stretch of them in order is one version, or from its first to
    its last; `>=` if it goes on to the highest known, `<=` if it begins at the
    lowest, `*` if both; stretches are joined by ||. Kept as it is where that
    is no shorter. ranges: name, range; versions: name, version.

    Stretches are found by numbering all versions, then those let in, over the
    whole table in one order each: their difference stays the same within a
    stretch. So no name's versions need meet in one task."""
    asked = ranges.select("name", "range").distinct()
    terms = semver.range_terms(asked.select(F.col("range").alias("spec"))).withColumnRenamed("spec", "range")
    v = versions.select("name", "version").distinct().withColumn("v", semver.sv(F.col("version"))).where("v is not null")
    pairs = v.join(asked, "name").join(terms, "range").withColumn("_in", semver.sv_satisfies(F.col("v"), F.col("terms"), True)).drop("terms")
    every = numbered(pairs, "name", "range", "v", "version", name="_all")
    every = stored(every, "numbered")
    let_in = numbered(every.where("_in"), "_all", name="_own").withColumn("_run", F.col("_all") - F.col("_own"))
    runs = let_in.groupBy("name", "range", "_run").agg(F.min("_all").alias("lo"), F.max("_all").alias("hi"), F.min_by("version", "_all").alias("a"), F.max_by("version", "_all").alias("b"))
    ends = every.groupBy("name", "range").agg(F.min("_all").alias("least"), F.max("_all").alias("most"))
    r = runs.join(ends, ["name", "range"])
    opens, shuts = F.col("hi") == F.col("most"), F.col("lo") == F.col("least")
    said = F.when(opens & shuts, "*").when(opens, F.concat(F.lit(">="), "a")).when(F.col("a") == F.col("b"), F.col("a")).when(shuts, F.concat(F.lit("<="), "b")).otherwise(F.concat("a", F.lit(" - "), "b"))
    joined = r.groupBy("name", "range").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("lo", said.alias("said")))), lambda x: x["said"]), " || ").alias("_simple"))
    found = asked.join(joined, ["name", "range"], "left").withColumn("_simple", F.coalesce("_simple", F.lit("")))
    known = asked.join(ends.select("name", "range", F.lit(True).alias("_known")), ["name", "range"], "left_semi").withColumn("_known", F.lit(True))
    found = found.join(known, ["name", "range"], "left")
    return found.select("name", "range", F.when(F.col("_known") & (F.length("_simple") < F.length("range")), F.col("_simple")).otherwise(F.col("range")).alias("simple"))

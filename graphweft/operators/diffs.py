"""What takes one tree to another, node by node, and which nodes a partial change may touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweft.operators.closure import reached
from graphweft.operators.graph import FOLDER, Graph


def digests_meet(a: Column, b: Column) -> Column:
    """Whether two integrity texts, each of one or more digests, have one in common."""
    return F.coalesce(F.arrays_overlap(F.split(a, r"\s+"), F.split(b, r"\s+")), F.lit(False))


#: Columns that a side may leave out.
DEFAULTS = {"integrity": "string", "resolved": "string", "patch": "string", "is_root": "boolean", "in_bundle": "boolean", "patch_removed": "boolean", "bins_missing": "boolean"}


def diff_actions(actual: DataFrame, ideal: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """(location, action, was, will): REMOVE, ADD or CHANGE of each node that
    isn't left alone. Both sides: location, version and perhaps integrity,
    resolved, patch (its digest), is_root; ideal perhaps in_bundle,
    patch_removed, bins_missing. within: the locations that may change.

    Bundled nodes aren't added, the root never changes. A node changes if its
    version or patch does, its patch goes, or its bins are missing; if neither
    side has integrity it stays where both have the same address or none;
    otherwise it changes unless both have integrity with a digest in common."""

    def side(df: DataFrame, mark: str) -> DataFrame:
        held = [(F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in DEFAULTS.items()]
        return df.select("location", F.struct(F.col("version"), *held).alias(mark))

    rows = side(actual, "a").join(side(ideal, "i"), "location", "full_outer")
    if within is not None:
        rows = rows.join(within.select("location").distinct(), "location", "left_semi")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    alike = lambda c: F.col(f"a.{c}").eqNullSafe(F.col(f"i.{c}"))
    neither = F.col("a.integrity").isNull() & F.col("i.integrity").isNull()
    keeps = neither & ~yes("i.bins_missing") & alike("resolved")
    same = digests_meet(F.col("a.integrity"), F.col("i.integrity")) & ~yes("i.bins_missing")
    action = (
        F.when(F.col("i").isNull(), "REMOVE").when(F.col("a").isNull(), F.when(~yes("i.in_bundle"), "ADD")).when(yes("i.is_root") & yes("a.is_root"), None)
        .when(~alike("version") | ~alike("patch") | yes("i.patch_removed"), "CHANGE").when(keeps | same, None).otherwise("CHANGE")
    )
    return rows.select("location", action.alias("action"), F.col("a.version").alias("was"), F.col("i.version").alias("will")).where("action is not null")


def filter_set(actual: Graph, ideal: Graph, chosen: DataFrame) -> DataFrame:
    """(location): what a change of the chosen nodes (location) may touch: the
    root, the chosen and links to them, all that either tree leads to from
    there, links' targets included, and extraneous nodes in the folders of what
    the actual tree has there."""
    spark = chosen.sparkSession
    links = lambda g: g.nodes.where("is_link").select(F.col("location").alias("src"), F.col("target_location").alias("dst"))
    steps = actual.resolved.select("src", "dst").union(ideal.resolved.select("src", "dst"))
    ways = steps.union(links(actual)).union(links(ideal))
    inside = reached(ways, chosen.select("location"))
    direct = steps.where(F.col("src") == ideal.root).select("dst")
    to_chosen = links(actual).union(links(ideal)).join(chosen.select(F.col("location").alias("dst")), "dst", "left_semi").join(direct.withColumnRenamed("dst", "src"), "src", "left_semi").select(F.col("src").alias("location"))
    strays = actual.nodes.where(F.col("extraneous") & F.col("location").rlike(FOLDER)).select("location", F.regexp_replace("location", FOLDER, "").alias("folder"))
    held = strays.join(inside.select(F.col("location").alias("folder")), "folder", "left_semi").select("location")
    root = spark.createDataFrame([(ideal.root,)], "location string")
    return inside.union(to_chosen).union(held).union(root).distinct()

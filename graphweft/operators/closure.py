"""Reachability by semi-naive rounds.

Each round joins the last frontier to the edges and keeps what no earlier
frontier had. Frontiers are written to the shared folder, so plans stay flat,
nothing is recomputed, and cycles end the loop as nothing new turns up. Edges
and what is known lie there dealt out by location, so rounds don't shuffle them. With a
`seed` column the same rounds run for many starts at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphweft.storage import dealt, stored, table_of, written


def many(rows: DataFrame) -> DataFrame:
    """rows of a join that may be as many as there are nodes, to be merged, never
    broadcast. Spark tells sizes by the widths of columns: a variant counts for
    2,048 bytes, so locations out of a table with packages look a hundredth of
    what they are and would go through the driver whole."""
    return rows.hint("merge")


def closure(edges: DataFrame, start: DataFrame, most: int | None = None) -> DataFrame:
    """start (location, perhaps seed) and all that edges (src, dst) lead to from
    it, with `depth`, the fewest steps. most: the number of rounds at most.
    Edges that have a seed too are followed from that seed only."""
    keys = [c for c in ("seed", "location") if c in start.columns]
    own = [c for c in ("seed",) if c in edges.columns and c in keys]
    steps = dealt(edges.select(*own, F.col("src").alias("location"), "dst").where("location is not null and dst is not null"), "steps", *own, "location")
    found = dealt(start.select(*keys).distinct().withColumn("depth", F.lit(0)), "found", *keys)
    depth = 0
    while (most is None or depth < most) and not found.where(F.col("depth") == depth).isEmpty():
        found = dealt(_next(found, steps, depth, keys, own), "found", *keys, to=table_of(found))
        depth += 1
    return found


def _next(found: DataFrame, steps: DataFrame, depth: int, keys: list[str], own: list[str]) -> DataFrame:
    """What steps newly lead to from what was found at a depth. Neither steps nor
    what is known is shuffled, only the locations that are led to."""
    ahead = found.where(F.col("depth") == depth).select(*keys)
    # locations occur once unless there are seeds: a part of them is hashed, so that steps aren't sorted in each round
    moved = (many(ahead) if "seed" in keys else ahead.hint("shuffle_hash")).join(steps, [*own, "location"])
    moved = moved.select(*[c for c in keys if c != "location"], F.col("dst").alias("location")).distinct()
    # no anti join: Spark would move it down to the steps, and shuffle all of them by their ends
    known = many(found.select(*keys, F.lit(True).alias("_known")))
    return moved.join(known, keys, "left").where("_known is null").select(*keys, F.lit(depth + 1).alias("depth"))


def marks_reached(steps: DataFrame, start: DataFrame) -> DataFrame:
    """(location, marks): the bits (int) of start (location, marks) carried along
    steps (src, dst, marks), each over the steps that have it too. As closure()
    for many seeds, with one row for all the bits of a step or a location."""
    spark = start.sparkSession
    known_by = lambda rows: rows.groupBy("location").agg(F.bit_or("marks").alias("marks"))
    read = lambda paths: spark.read.schema("location string, marks int").parquet(*paths)
    along = steps.select(F.col("src").alias("location"), "dst", F.col("marks").alias("_let")).where("dst is not null")
    paths = [written(known_by(start.select("location", F.col("marks").cast("int").alias("marks"))), "marks")]
    while True:
        ahead = read(paths[-1:])
        if ahead.isEmpty():
            break
        moved = ahead.join(along, "location").select(F.col("dst").alias("location"), F.col("marks").bitwiseAND(F.col("_let")).alias("marks"))
        offers = known_by(moved.where("marks <> 0"))
        known = known_by(read(paths)).withColumnRenamed("marks", "_known")
        new = offers.join(known, "location", "left").select("location", F.col("marks").bitwiseAND(F.bitwise_not(F.coalesce("_known", F.lit(0)))).alias("marks"))
        paths.append(written(new.where("marks <> 0"), "marks"))
    return known_by(read(paths))


def reached(edges: DataFrame, start: DataFrame) -> DataFrame:
    """closure() without depth."""
    return closure(edges, start).drop("depth")


def least_joined(links: DataFrame) -> DataFrame:
    """(location, least): each end of the links (src, dst), taken either way,
    with the least location that it is joined to.

    First each src is folded onto the least of its dsts: these are linked to
    each other instead, so a src that nothing leads to is out of the rounds.
    Then each round draws every end onto that neighbour, or itself, whose hash
    is the least and keeps one link of each pair that is left. A hash of its
    own each round makes ends fewer by a constant share, chains too, and what
    is shuffled for the choice is summed before."""
    found = links.select("src", "dst").where("src is not null and dst is not null")
    hub = F.min("dst").over(Window.partitionBy("src"))
    folded = stored(found.withColumn("hub", hub), "folded")
    leaves = folded.where("dst = hub").select("src", "hub").distinct()
    ends = folded.select(F.col("dst").alias("location")).distinct()
    both = leaves.join(many(ends), F.col("src") == F.col("location"), "left_semi")
    pairs = folded.where("dst <> hub").select(F.col("dst").alias("a"), F.col("hub").alias("b")).unionByName(both.where("src <> hub").select(F.col("src").alias("a"), F.col("hub").alias("b")))
    drawn = []
    while True:
        pairs = stored(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct() if drawn else pairs, "links")
        if pairs.isEmpty():
            break
        rank = lambda c: F.struct(F.xxhash64(F.lit(len(drawn)), c).alias("h"), F.col(c).alias("to"))  # noqa: B023, E731
        either = pairs.select("a", "b").union(pairs.select("b", "a"))
        nearest = either.groupBy("a").agg(F.min(rank("b")).alias("near"))
        drawn.append(stored(nearest.select(F.col("a").alias("location"), F.least("near", rank("a"))["to"].alias("to")), "drawn"))
        at = lambda c, new: drawn[-1].select(F.col("location").alias(c), F.col("to").alias(new))
        pairs = pairs.join(at("a", "_a"), "a").join(at("b", "_b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    told = None  # (location, top): where each end is in the last round; what no round draws on is there itself
    for step in reversed(drawn):
        if told is not None:
            later = told.select(F.col("location").alias("to"), "top")
            step = step.join(later, "to", "left").select("location", F.coalesce("top", "to").alias("top"))
        told = stored(step.select("location", "top") if "top" in step.columns else step.select("location", F.col("to").alias("top")), "told")
    # the least below each end counts for it, so leaves meet their hubs only
    low = ends.withColumn("low", F.col("location")).unionByName(leaves.select(F.col("hub").alias("location"), F.col("src").alias("low")))
    low = low.groupBy("location").agg(F.min("low").alias("low"))
    if told is not None:
        low = low.join(told, "location", "left")
    low = stored(low.select("location", "low", F.coalesce("top", "location").alias("top") if told is not None else F.col("location").alias("top")), "low")
    least = low.groupBy("top").agg(F.min("low").alias("least"))
    known = stored(low.join(least, "top").select("location", "least"), "least")
    only = leaves.join(many(ends), F.col("src") == F.col("location"), "left_anti")
    return known.unionByName(only.join(known.withColumnRenamed("location", "hub"), "hub").select(F.col("src").alias("location"), "least"))


def paths(edges: DataFrame, start: DataFrame, most: int | None = None) -> DataFrame:
    """(path, location): every path without repeats from start against or along
    edges, as arrays of locations. Their number may be exponential. most: the
    number of steps at most."""
    spark = start.sparkSession
    level = start.select(F.array("location").alias("path"), "location")
    out = [written(level, "paths")]
    schema = level.schema
    while most is None or len(out) <= most:
        held = spark.read.schema(schema).parquet(out[-1])
        if held.isEmpty():
            break
        moved = held.join(edges.select("src", "dst"), F.col("location") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        out.append(written(moved.select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("location")), "paths"))
    return spark.read.schema(schema).parquet(*out)

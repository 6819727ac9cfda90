"""Fixpoints over graphs beyond reachability: least values along links, levels,
strongly connected components, content keys, link targets and override rules.

All run in rounds of joins whose tables are written to the shared folder; a
round carries only what changed, where the rule allows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweft.functions import semver, text
from graphweft.operators.closure import many, reached
from graphweft.storage import buckets, dealt, dropped, stored, table_of, written

# --- least values ------------------------------------------------------------------


def least_along(links: DataFrame, own: DataFrame) -> DataFrame:
    """(location, value): of each location the least of its own value and of
    those of all that links (src, dst) lead from to it. own: location, value (of
    any type with an order). A round sends on only what has got less."""
    spark = own.sparkSession
    steps = links.select(F.col("src").alias("location"), "dst").where("location is not null and dst is not null").distinct()
    parts = [written(own.groupBy("location").agg(F.min("value").alias("value")), "least")]
    schema = own.select("location", "value").schema
    read = lambda paths: spark.read.schema(schema).parquet(*paths)
    while True:
        ahead = read(parts[-1:])
        if ahead.isEmpty():
            break
        offers = ahead.join(steps, "location").groupBy("dst").agg(F.min("value").alias("_offer")).withColumnRenamed("dst", "location")
        known = read(parts).groupBy("location").agg(F.min("value").alias("value"))
        better = offers.join(known, "location", "left").where(F.col("value").isNull() | (F.col("_offer") < F.col("value")))
        parts.append(written(better.select("location", F.col("_offer").alias("value")), "least"))
    return read(parts).groupBy("location").agg(F.min("value").alias("value"))


# --- levels ------------------------------------------------------------------------


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(location, level): 0 for what leads to nothing, else one more than the
    highest level of all that it leads to, so that each level leads to lower
    ones only. null for what is on a cycle or leads to one. Rounds take off what
    leads only to what is off already: an edge is counted once, in the round
    after its end's."""
    spark = nodes.sparkSession
    steps = stored(edges.where("dst is not null and src <> dst").select("src", "dst").distinct(), "steps")
    own = nodes.select("location").distinct()
    owed = stored(own.join(steps.groupBy(F.col("src").alias("location")).agg(F.count(F.lit(1)).alias("owed")), "location", "left").select("location", F.coalesce("owed", F.lit(0).cast("long")).alias("owed")), "owed")
    found = [written(owed.where("owed = 0").select("location", F.lit(0).alias("level")), "levels")]
    schema = "location string, level int"
    level = 0
    while True:
        last = spark.read.schema(schema).parquet(found[-1])
        if last.isEmpty():
            break
        level += 1
        paid = steps.join(last.select(F.col("location").alias("dst")), "dst").groupBy(F.col("src").alias("location")).agg(F.count(F.lit(1)).alias("paid"))
        left = stored(owed.join(paid, "location", "left").select("location", (F.col("owed") - F.coalesce("paid", F.lit(0))).alias("owed"), (F.col("paid") > 0).alias("_touched")).where("owed > 0 or _touched"), "owed")
        found.append(written(left.where("owed = 0").select("location", F.lit(level).alias("level")), "levels"))
        dropped(owed)
        owed = stored(left.where("owed > 0").select("location", "owed"), "owed")
        dropped(left)
    return own.join(spark.read.schema(schema).parquet(*found), "location", "left")


def name_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """levels() of package names: a name leads to the names that any node of it
    needs. (name, level)"""
    ids = nodes.select("location", F.col("package_name").alias("of"))
    e = edges.join(ids.withColumnsRenamed({"location": "src", "of": "a"}), "src").join(ids.withColumnsRenamed({"location": "dst", "of": "b"}), "dst")
    return levels(ids.select(F.col("of").alias("location")), e.select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumnRenamed("location", "name")


# --- components and content keys ---------------------------------------------------


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(location, component): nodes that lead to each other have one component,
    named by a member; all others are their own. What isn't on a cycle is taken
    off by rounds that drop nodes without an edge in or out. On the rest, each
    node is coloured by the least node that leads to it; a colour's own node and
    all of its colour that lead back to it are a component, and leave."""
    left = stored(edges.where("dst is not null and src <> dst").select("src", "dst").distinct(), "cyclic")
    found: DataFrame | None = None
    while True:
        while True:
            n = left.count()
            ends = lambda c: left.select(F.col(c).alias("location")).distinct()
            trimmed = stored(left.join(ends("dst").withColumnRenamed("location", "src"), "src", "left_semi").join(ends("src").withColumnRenamed("location", "dst"), "dst", "left_semi").select("src", "dst"), "cyclic")
            dropped(left)
            left = trimmed
            if left.count() == n:
                break
        if left.isEmpty():
            break
        own = left.select(F.col("src").alias("location")).union(left.select("dst")).distinct()
        colour = stored(least_along(left, own.withColumn("value", F.col("location"))).withColumnRenamed("value", "colour"), "colours")
        at = lambda c: colour.select(F.col("location").alias(c), F.col("colour").alias(f"_{c}"))
        inside = left.join(at("src"), "src").join(at("dst"), "dst").where("_src = _dst")
        back = reached(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")), colour.where("location = colour").select("location"))
        members = stored(back.join(colour, "location").select("location", F.col("colour").alias("component")), "components")
        found = members if found is None else found.unionByName(members)
        gone = lambda c: members.select(F.col("location").alias(c))
        rest = stored(left.join(gone("src"), "src", "left_anti").join(gone("dst"), "dst", "left_anti").select("src", "dst"), "cyclic")
        dropped(left)
        left = rest
    every = nodes.select("location").distinct()
    if found is None:
        return every.withColumn("component", F.col("location"))
    return every.join(found, "location", "left").withColumn("component", F.coalesce("component", "location"))


def peeled(nodes: DataFrame, steps: DataFrame) -> DataFrame:
    """(k, round) of what no cycle leads to: 0 where nothing leads to a node, else
    one more than the highest round of all that leads to it. nodes: k; steps: (k,
    d), dealt out by k. A node's tally is the number of steps to it; a round takes
    off those of the nodes that the last round found, so it shuffles a row for
    each end that they lead to, and neither steps nor what is known."""
    ends = steps.where("k <> d").groupBy(F.col("d").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    tally = dealt(nodes.select("k", F.lit(0).cast("long").alias("n")).unionByName(ends).withColumn("round", F.lit(0)), "tally", "k")
    off, turn = None, 0
    while True:
        free = tally.groupBy("k").agg(F.sum("n").alias("n"), F.max("round").alias("round")).where((F.col("n") == 0) & (F.col("round") == turn))
        off = dealt(free.select("k", "round"), "off", "k", to=table_of(off) if off is not None else None)
        last = off.where(F.col("round") == turn)
        if last.isEmpty():
            return off
        turn += 1
        paid = last.select("k").hint("shuffle_hash").join(steps, "k").where("k <> d").groupBy(F.col("d").alias("k")).agg((-F.count(F.lit(1))).alias("n"))
        tally = dealt(paid.withColumn("round", F.lit(turn)), "tally", "k", to=table_of(tally))


def content_keys(nodes: DataFrame, edges: DataFrame, own_id: Column) -> DataFrame:
    """(location, key): a key of a node's own id and of all that it leads to:
    equal keys, equal content below. Nodes that lead to each other are hashed
    as one, by their members, the edges among them and the keys that they lead
    to. Nodes have numbers, and steps lie dealt out by where they start. What no
    cycle leads to is peeled off from above, what is left is hashed by its
    components, and the rounds then follow from the last to the first: an edge
    is sent once to its end's key, and the key once to where the edge starts."""
    ids = dealt(nodes.select("location", own_id.alias("id"), F.monotonically_increasing_id().alias("k")), "ids", "location")
    own = dealt(ids, "nodes", "k")
    at = lambda c, k: ids.select(F.col("location").alias(c), F.col("k").alias(k)).hint("shuffle_hash")
    pairs = edges.where("dst is not null").select("src", "dst").join(at("src", "k"), "src").join(at("dst", "d"), "dst")
    steps = dealt(pairs.select("k", "d"), "steps", "k")
    off = peeled(own, steps)
    turns = off.select("k", F.lit(True).alias("_off")).hint("shuffle_hash")
    left = lambda rows: rows.join(turns, "k", "left").where("_off is null").drop("_off")
    cyclic = stored(left(own), "cyclic")
    texts = lambda rows, *c: rows.select(*[F.col(x).cast("string").alias(y) for x, y in c])
    held = cyclic.select("k", "location", F.lit(None).cast("string").alias("key")).limit(0)
    if not cyclic.isEmpty():
        found = _component_keys(texts(cyclic, ("k", "location"), ("id", "id")), stored(texts(left(steps), ("k", "src"), ("d", "dst")), "cyclic"))
        held = cyclic.join(found.select(F.col("location").cast("long").alias("k"), "key"), "k").select("k", "location", "key")
    keys = dealt(held, "keys", "k")
    itself = steps.where("k = d").select("k", F.lit(True).alias("_self")).distinct()
    highest = off.agg(F.max("round")).first()[0]
    for turn in range(-1 if highest is None else highest, -1, -1):
        last = off.where(F.col("round") == turn).select("k")
        asks = last.hint("shuffle_hash").join(steps, "k").where("k <> d")
        # many steps may share an end, and there are fewer ends than steps
        told = asks.join(keys.select(F.col("k").alias("d"), "key").hint("shuffle_hash"), "d").repartition(buckets(nodes.sparkSession), "k").groupBy("k").agg(F.collect_set("key").alias("_keys"))
        rows = own.join(last, "k").join(told, "k", "left").join(itself, "k", "left")
        below = F.array_join(F.transform(F.sort_array(F.coalesce("_keys", F.array().cast("array<string>"))), lambda t: F.concat("id", F.lit(">"), t)), ",")
        among = F.when(F.col("_self"), F.concat("id", F.lit(">"), "id")).otherwise("")
        content = F.sha2(F.concat_ws("|", "id", among, below), 256)
        keys = dealt(rows.select("k", "location", _key(content).alias("key")), "keys", "k", to=table_of(keys))
    return keys.select("location", "key")


def _key(content: Column) -> Column:
    """A node's key: its id and a digest of the content and the id."""
    return F.concat("id", F.lit("-"), F.substring(F.sha2(F.concat(content, F.lit("|"), "id"), 256), 1, 32))


def _component_keys(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """content_keys() of nodes (location, id) that may lead to each other:
    components are hashed level by level, so each edge counts once."""
    spark = nodes.sparkSession
    comp = stored(strong_components(nodes, edges).join(nodes.select("location", "id"), "location"), "components")
    steps = edges.where("dst is not null").select("src", "dst").distinct()
    at = lambda c, *more: comp.select(F.col("location").alias(c), F.col("component").alias(f"_{c}"), *more)
    e = stored(steps.join(at("src", F.col("id").alias("a")), "src").join(at("dst", F.col("id").alias("b")), "dst"), "steps")
    across = e.where("_src <> _dst")
    level = stored(levels(comp.select(F.col("component").alias("location")), across.select(F.col("_src").alias("src"), F.col("_dst").alias("dst"))).withColumnRenamed("location", "component"), "levels")
    listed = lambda c: F.array_join(F.sort_array(F.collect_list(c)), ",")
    members = comp.groupBy("component").agg(listed("id").alias("_members"))
    among = e.where("_src = _dst").groupBy(F.col("_src").alias("component")).agg(listed(F.concat("a", F.lit(">"), "b")).alias("_among"))
    fixed = stored(level.join(members, "component").join(among, "component", "left"), "members")
    out = stored(across.select(F.col("_src").alias("component"), "a", "dst"), "across")
    highest = level.agg(F.max("level")).first()[0]
    keys, schema = [], "location string, key string"
    for k in range(0 if highest is None else highest + 1):
        rows = fixed.where(F.col("level") == k)
        if k:
            below = out.join(rows.select("component"), "component", "left_semi").join(spark.read.schema(schema).parquet(*keys).withColumnRenamed("location", "dst"), "dst")
            told = below.select("component", F.concat("a", F.lit(">"), "key").alias("t")).distinct().groupBy("component").agg(listed("t").alias("_below"))
            rows = rows.join(told, "component", "left")
        else:
            rows = rows.withColumn("_below", F.lit(""))
        content = F.sha2(F.concat_ws("|", "_members", F.coalesce("_among", F.lit("")), F.coalesce("_below", F.lit(""))), 256)
        named = rows.select("component", content.alias("_content")).join(comp, "component")
        keys.append(written(named.select("location", _key(F.col("_content")).alias("key")), "keys"))
    return spark.read.schema(schema).parquet(*keys) if keys else spark.createDataFrame([], schema)


# --- links -------------------------------------------------------------------------

#: A path that takes more hops than this over links loops.
HOPS = 2000


def link_targets(links: DataFrame) -> DataFrame:
    """(location, real, loops): where each link ends when all links on the way,
    its target's folders included, are followed; null where that never ends.
    links: location, target (paths from one root, without . and ..). Pointers
    are doubled: a round puts each link's target so far in place of the first
    link on a path, so a chain of n links takes log n rounds."""
    spark = links.sparkSession
    held = stored(links.select("location", F.col("target").alias("path"), F.lit(1).cast("long").alias("hops")), "links")
    done, schema = [], "location string, real string, loops boolean"
    while not held.isEmpty():
        parts = F.split("path", "/")
        on = held.select("location", "path", "hops", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("at", "above"))
        known = held.select(F.col("location").alias("above"), F.col("path").alias("_to"), F.col("hops").alias("_more"))
        ends = [spark.read.schema(schema).parquet(*done).select(F.col("location").alias("above"), F.col("real").alias("_to"), F.when(F.col("loops"), HOPS + 1).otherwise(1).cast("long").alias("_more"))] if done else []
        for more in ends:
            known = known.unionByName(more)
        first = on.join(known, "above").groupBy("location").agg(F.min_by(F.struct("above", "_to", "_more"), "at").alias("f"))
        moved = stored(held.join(first, "location", "left").select(
            "location", F.when(F.col("f").isNull(), F.col("path")).otherwise(F.concat("f._to", F.expr("substring(path, length(f.above) + 1)"))).alias("path"),
            (F.col("hops") + F.coalesce("f._more", F.lit(0))).alias("hops"), F.col("f").isNull().alias("_real"),
        ), "links")
        loops = F.col("path").isNull() | (F.col("hops") > HOPS)
        ended = moved.where(F.col("_real") | loops)
        done.append(written(ended.select("location", F.when(~loops, F.col("path")).alias("real"), loops.alias("loops")), "targets"))
        held = stored(moved.where(~F.col("_real") & ~loops).select("location", "path", "hops"), "links")
        dropped(moved)
    return spark.read.schema(schema).parquet(*done) if done else spark.createDataFrame([], schema)


# --- overrides ---------------------------------------------------------------------


def override_rules(overrides: dict) -> list[dict]:
    """A manifest's overrides as rows: rule (0: the root), parent, key, name,
    key_spec, value. A text is a rule's value; an object's "." is, and its
    other entries hold for what the named package leads to."""
    rows = [{"rule": 0, "parent": None, "key": None, "name": None, "key_spec": None, "value": None}]

    def add(entries: dict, parent: int) -> None:
        for key, held in entries.items():
            if key == ".":
                continue
            name, at, key_spec = key.rpartition("@") if "@" in key[1:] else (key, "", "")
            inner = held if isinstance(held, dict) else {".": held}
            value = inner.get(".")
            value = "*" if value == "" else value or key_spec or "*"
            rows.append({"rule": len(rows), "parent": parent, "key": key, "name": name, "key_spec": key_spec or "*", "value": value})
            add(inner, len(rows) - 1)

    add(overrides, 0)
    return rows


def _above(rules: dict[int, dict], rule: int) -> list[int]:
    """A rule and what holds it, nearest first."""
    out = [rule]
    while rules[out[-1]]["parent"] is not None:
        out.append(rules[out[-1]]["parent"])
    return out


def _in_force(rules: dict[int, dict], state: int) -> dict[str, int]:
    """By key, the rules that hold in a state: of each holder its own rules,
    then itself; the nearest for each key."""
    out: dict[str, int] = {}
    for holder in _above(rules, state):
        for r in rules.values():
            if r["parent"] == holder:
                out.setdefault(r["key"], r["rule"])
        if holder:
            out.setdefault(rules[holder]["key"], holder)
    return out


def _clash(rules: dict[int, dict], a: int, b: int) -> bool:
    """Whether two states have rules of one key whose ranges can't both hold."""
    first, second = _in_force(rules, a), _in_force(rules, b)
    for key in first.keys() & second.keys():
        x, y = rules[first[key]]["value"], rules[second[key]]["value"]
        if first[key] != second[key] and not x.startswith("$") and not y.startswith("$") and semver.valid_range(x) and semver.valid_range(y) and not semver.intersects(x, y):
            return True
    return False


def override_states(nodes: DataFrame, edges: DataFrame, overrides: dict, root: str = "") -> DataFrame:
    """(src, name, dst, type, raw_spec, spec, rule, error, conflict): each edge
    under the rules that hold where it starts.

    A node's state is the rule that it stands under: the root's is the whole
    set. An edge's rule is the first in its source's state of its name whose
    key meets the edge's spec, else the source's state. Of the rules that lead
    to a node the more specific holds, whatever it holds takes the place of
    what holds it; several that neither holds agree on what holds them all, or
    conflict where they have rules that can't both be met (then the first
    stays). States are found round by round from the root until none changes,
    or until rounds repeat, as they may around cycles. A node has a count of the
    edges by which each rule leads to it; where a state changes, what it told
    before is taken off and what it tells now put on, so a round follows only
    the edges of nodes that changed, and shuffles a row for each end and rule.

    The spec is the rule's value if the rule is of the edge's name and says
    more than *; $name stands for what the root, else the source, asks of that
    name. A target that meets the spec is valid, and so is one that meets the
    raw spec but not the rule's key. A bundled target is held against the raw
    spec. Where an edge's rule and its target's state conflict, and the target
    leads on, the edge is invalid too."""
    spark = nodes.sparkSession
    rules = {r["rule"]: r for r in override_rules(overrides)}  # one manifest's
    kinds = "state int, place int, next int, name string, key_spec string"
    force = spark.createDataFrame([(s, k, r, rules[r]["name"], rules[r]["key_spec"]) for s in rules for k, r in enumerate(_in_force(rules, s).values())], kinds)
    raw = F.coalesce(F.regexp_extract("spec", r"^npm:(?:@[^/]+/)?[^@]+@(.+)$", 1), F.lit(""))
    named_by = sorted({r["name"] for r in rules.values() if r["name"]})
    asked = edges.where(F.col("name").isin(named_by)).select("name", "spec").distinct().withColumn("_plain", F.when(raw != "", raw).otherwise(F.col("spec")))
    pairs = asked.join(force, "name")
    tests = pairs.where("key_spec <> '*'").select("_plain", "key_spec").distinct().withColumn("_meets", semver.pair_test("intersects")("_plain", "key_spec"))
    kind = text.spec_type(F.col("_plain"))
    meets = F.when(F.col("key_spec") == "*", True).when(kind.isin("range", "version"), F.coalesce("_meets", F.lit(False))).when(kind == "git", False).otherwise(True)
    moves = stored(pairs.join(tests, ["_plain", "key_spec"], "left").where(meets).groupBy("state", "name", "spec").agg(F.min_by("next", "place").alias("next")), "moves")

    table = lambda f: F.create_map(*[x for r in rules for x in (F.lit(r), F.array(*map(F.lit, f(r))).cast("array<int>"))])
    above, holders = table(lambda r: _above(rules, r)), table(lambda r: _above(rules, r)[1:])
    clashes = table(lambda r: [o for o in rules if o not in _above(rules, r) and r not in _above(rules, o) and _clash(rules, r, o)])
    clash = F.exists("most", lambda a: F.exists("most", lambda b: F.array_contains(F.element_at(clashes, a), b)))
    common = F.aggregate("most", F.element_at(above, F.try_element_at("most", F.lit(1))), lambda acc, s: F.array_intersect(acc, F.element_at(above, s)))
    folded = F.when(F.size("most") == 1, F.try_element_at("most", F.lit(1))).when(clash, F.array_min("most")).otherwise(F.try_element_at(common, F.lit(1)))

    def fold(rows: DataFrame, states: str, state: str) -> DataFrame:
        most = F.filter(states, lambda s: ~F.exists(states, lambda t: F.array_contains(F.element_at(holders, t), s)))
        return rows.withColumn("most", most).withColumn(state, F.when(F.size(states) > 0, folded)).drop("most")

    steps = dealt(edges.select(F.col("src").alias("location"), "name", "dst", "type", "spec"), "steps", "location")
    ruled = lambda e: e.join(moves, ["state", "name", "spec"], "left").withColumn("rule", F.coalesce("next", "state")).drop("next")
    tally = dealt(spark.createDataFrame([(root, 0, 1, 0)], "location string, rule int, n long, round int"), "tally", "location")
    told, mark, marks, rounds = F.col("round"), (0, 0), [], 0
    rules_of = lambda c: F.sort_array(F.collect_set(F.when(F.col(c) > 0, F.col("rule"))))
    while True:
        # the tally lies dealt out by location: neither grouping shuffles
        by_rule = tally.groupBy("location", "rule").agg(F.sum("n").alias("n"), F.sum(F.when(told < rounds, F.col("n")).otherwise(0)).alias("was"), F.max("round").alias("last"))
        touched = by_rule.groupBy("location").agg(rules_of("n").alias("now"), rules_of("was").alias("was"), F.max("last").alias("last")).where(F.col("last") == rounds)
        changed = fold(fold(touched, "now", "new"), "was", "old").where(~F.col("new").eqNullSafe(F.col("old"))).select("location", "old", "new")
        changed = dealt(changed, "changed", "location")
        hashed = lambda c: F.coalesce(F.sum(F.when(F.col(c).isNotNull(), F.xxhash64("location", c)).cast("decimal(38,0)")), F.lit(0))
        more = changed.agg(F.count("new") - F.count("old"), hashed("new") - hashed("old")).first()
        mark = (mark[0] + more[0], mark[1] + int(more[1]))
        if mark in marks:
            break
        marks.append(mark)
        rounds += 1
        says = F.explode(F.array(F.struct(F.col("old").alias("state"), F.lit(-1).alias("n")), F.struct(F.col("new").alias("state"), F.lit(1).alias("n")))).alias("says")
        along = changed.hint("shuffle_hash").join(steps.select("location", "name", "spec", "dst").where((F.col("dst").isNotNull()) & (F.col("dst") != root)), "location")
        sent = ruled(along.select("name", "spec", "dst", says).select("name", "spec", F.col("dst").alias("location"), "says.*").where("state is not null"))
        sent = sent.groupBy("location", "rule").agg(F.sum("n").alias("n")).where("n <> 0")
        tally = dealt(sent.repartition(buckets(spark), "location").select("location", "rule", "n", F.lit(rounds).alias("round")), "tally", "location", to=table_of(tally))
    sums = tally.groupBy("location", "rule").agg(F.sum("n").alias("n")).groupBy("location").agg(rules_of("n").alias("now"))
    held = dealt(fold(sums, "now", "state").where("state is not null").select("location", "state"), "states", "location")

    own = spark.createDataFrame([(r["rule"], r["name"], r["key_spec"], r["value"]) for r in rules.values()], "rule int, _name string, _key string, _value string")
    e = ruled(steps.join(held.hint("shuffle_hash"), "location", "left")).join(own, "rule", "left").withColumnsRenamed({"spec": "raw_spec", "location": "src"})
    named = F.coalesce((F.col("_name") == F.col("name")) & (F.col("_value") != "*"), F.lit(False))
    e = e.withColumn("_ref", F.when(named & F.col("_value").startswith("$"), F.expr("substring(_value, 2)")))
    plain = e.where("_ref is null").withColumn("spec", F.when(named, F.col("_value")).otherwise(F.col("raw_spec")))
    if any(str(r["value"]).startswith("$") for r in rules.values()):  # only these edges ask what others say
        asks = lambda who: who.select(F.col("src"), F.col("name").alias("_ref"), F.col("spec").alias("_said"))
        refers = e.where("_ref is not null").join(asks(edges).where(F.col("src") == root).select("_ref", F.col("_said").alias("_root")).distinct(), "_ref", "left").join(asks(edges), ["src", "_ref"], "left")
        plain = plain.unionByName(refers.withColumn("spec", F.coalesce("_root", "_said", "raw_spec")).select(*plain.columns))
    e = plain.drop("_ref")
    # all specs there can be, written: as few as they mostly are, Spark sees it and shuffles no edge for them
    texts = edges.select("spec").union(spark.createDataFrame([(r[c],) for r in rules.values() for c in ("key_spec", "value") if r[c]] or [("*",)], "spec string"))
    known = stored(semver.range_terms(texts.where("spec is not null").distinct()).select("spec", "terms"), "terms")
    terms = lambda c: known.select(F.col("spec").alias(c), F.col("terms").alias(f"_t{c}"))
    # all that an edge must know of its end comes by one join
    leads = steps.where("dst is not null").select("location").distinct().withColumn("_leads", F.lit(True))
    ends = nodes.select("location", semver.sv(F.col("version")).alias("_v"), "in_bundle").join(many(held.withColumnRenamed("state", "_state").join(many(leads), "location", "full")), "location", "full").withColumnRenamed("location", "dst")
    e = e.join(many(ends), "dst", "left").join(terms("spec"), "spec", "left").join(terms("raw_spec"), "raw_spec", "left").join(terms("_key"), "_key", "left")
    ok = lambda c: F.col(c).isin("", "*") | F.coalesce(semver.sv_satisfies(F.col("_v"), F.col(f"_t{c}")), F.lit(False))
    valid = F.when(F.col("in_bundle"), ok("raw_spec")).when(F.coalesce("rule", F.lit(0)) == 0, ok("spec")).otherwise(ok("spec") | (ok("raw_spec") & ~ok("_key")))
    conflict = F.coalesce(F.col("_leads") & F.array_contains(F.element_at(clashes, F.col("rule")), F.col("_state")), F.lit(False))
    local = F.col("type").isin("peer", "peerOptional") & (F.col("src") != root) & F.col("dst").startswith(F.concat("src", F.lit("/node_modules/")))
    error = F.when(F.col("dst").isNull(), F.when(~F.col("type").isin("optional", "peerOptional"), "MISSING")).when(local, "PEER LOCAL").when(~valid | conflict, "INVALID")
    return e.select("src", "name", "dst", "type", "raw_spec", "spec", "rule", error.alias("error"), (F.col("dst").isNotNull() & conflict).alias("conflict"))

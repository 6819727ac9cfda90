"""Placing dependencies: a sequential search for each graph, graphs in parallel.

Resolution depends on order, so one graph is one task's work on the driver's
terms - breadth first, each requirement met by what is already in sight, else
by the best version placed as high as it fits. Many graphs are resolved side
by side, one group each.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft.functions import semver
from graphweft.operators.graph import optional_set

STRATEGIES = ("hoisted", "nested", "shallow")


def pick(versions: list[str], spec: str, latest: str | None = None) -> str | None:
    """The version that a spec asks for: `latest` if it lets that in, else the highest."""
    good = [v for v in versions if semver.satisfies(v, spec)]
    if latest in good:
        return latest
    return max(good, key=semver.parse, default=None)


def resolve(root: list[tuple[str, str, str]], packages: dict[tuple[str, str], list[tuple[str, str, str]]], strategy: str = "hoisted") -> tuple[list, list]:
    """(placed, problems). root and packages hold requirements (name, type,
    spec); placed are (location, name, version), problems (location, name, spec, reason)."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    known: dict[str, list[str]] = {}
    for name, version in packages:
        known.setdefault(name, []).append(version)
    tree: dict[str, tuple[str, str]] = {"": ("", "")}
    problems: list = []
    queue = deque([("", root)])

    def up(at: str):
        yield at
        while at:
            at = at.rpartition("node_modules/")[0].rstrip("/")
            yield at

    def place(at: str, name: str) -> str:
        return f"{at}/node_modules/{name}".lstrip("/")

    def seen_by(at: str, name: str) -> str | None:
        return next((place(a, name) for a in up(at) if place(a, name) in tree), None)

    def free(at: str, name: str, version: str, asker: str) -> bool:
        """No node there, and none below that would now find this one and not want it."""
        if place(at, name) in tree:
            return False
        below = [loc for loc in tree if loc and loc.startswith(at)]
        for loc in below:
            for n, kind, spec in packages.get(tree[loc], ()):
                if n == name and loc != asker and kind != "dev":
                    held = seen_by(loc, name)
                    if held is not None and len(held) < len(place(at, name)) and not semver.satisfies(version, spec):
                        return False
        return True

    while queue:
        at, wants = queue.popleft()
        for name, kind, spec in sorted(wants):
            if kind == "dev" and at:
                continue
            held = seen_by(at, name)
            if held is not None and semver.satisfies(tree[held][1], spec):
                continue
            if held is None and kind == "peerOptional":
                continue
            version = pick(known.get(name, []), spec)
            if version is None:
                if kind not in ("optional", "peerOptional"):
                    problems.append((at, name, spec, "no version"))
                continue
            chain = list(up(at))
            if kind == "peer":  # a peer stands beside or above its dependent
                if held is not None and held == place(at.rpartition("node_modules/")[0].rstrip("/"), name):
                    problems.append((at, name, spec, "peer conflict"))
                    continue
                chain = chain[1:] or [""]
            if strategy == "nested":
                chain = chain[:1]
            elif strategy == "shallow":
                chain = [chain[0], *([""] if chain[-1] == "" else [])]
            target = None
            for a in chain:
                if free(a, name, version, at):
                    target = a
                else:
                    break
            if target is None:
                problems.append((at, name, spec, "conflict"))
                continue
            loc = place(target, name)
            tree[loc] = (name, version)
            queue.append((loc, packages.get((name, version), [])))
    return [(loc, *nv) for loc, nv in sorted(tree.items()) if loc], problems


def ideal_trees(requirements: DataFrame, strategy: str = "hoisted") -> DataFrame:
    """(graph_id, location, name, version) for each graph. requirements:
    graph_id, owner, owner_version (both null for the root), name, type, spec."""

    def run(batches):
        for b in batches:
            out = []
            for graph_id, wants in zip(b["graph_id"], b["wants"], strict=True):
                root, packages = [], {}
                for w in wants:
                    if w["owner"] is None:
                        root.append((w["name"], w["type"], w["spec"]))
                    else:
                        own = packages.setdefault((w["owner"], w["owner_version"]), [])
                        if w["name"] is not None:
                            own.append((w["name"], w["type"], w["spec"]))
                out += [(graph_id, *p) for p in resolve(root, packages, strategy)[0]]
            yield pd.DataFrame(out, columns=["graph_id", "location", "name", "version"])

    wants = F.sort_array(F.collect_list(F.struct("owner", "owner_version", "name", "type", "spec"))).alias("wants")
    return requirements.groupBy("graph_id").agg(wants).mapInPandas(run, "graph_id string, location string, name string, version string")


def problem_edges(edges: DataFrame, update: list[str] | None = None, vulnerable: DataFrame | None = None) -> DataFrame:
    """Edges that need placing anew: missing (optional peers aside), invalid,
    named for update, or into a vulnerable node."""
    bad = (F.col("error").isin("MISSING", "INVALID", "PEER LOCAL") & (F.col("type") != "peerOptional"))
    if update:
        bad = bad | F.col("name").isin(update)
    found = edges.where(F.coalesce(bad, F.lit(False)))
    if vulnerable is not None:
        found = found.union(edges.join(vulnerable.select(F.col("location").alias("dst")), "dst", "left_semi").select(*edges.columns))
    return found.distinct()


def pruned(nodes: DataFrame) -> DataFrame:
    return nodes.where("not extraneous")


def add_dependency(manifest: dict, name: str, spec: str, kind: str | None = None) -> dict:
    """A manifest with a dependency in its map of the kind, and in no other;
    the kind defaults to where it is now."""
    maps = {"prod": "dependencies", "dev": "devDependencies", "optional": "optionalDependencies", "peer": "peerDependencies", "peerOptional": "peerDependencies"}
    if kind is None:
        kind = next((k for k in ("dev", "optional", "peer") if name in manifest.get(maps[k], {})), "prod")
    out = remove_dependency(manifest, name)
    out[maps[kind]] = dict(sorted({**out.get(maps[kind], {}), name: spec}.items()))
    if kind == "peerOptional":
        out["peerDependenciesMeta"] = {**out.get("peerDependenciesMeta", {}), name: {"optional": True}}
    return out


def remove_dependency(manifest: dict, name: str) -> dict:
    out = dict(manifest)
    for key in ("dependencies", "devDependencies", "optionalDependencies", "peerDependencies", "peerDependenciesMeta"):
        if name in out.get(key, {}):
            out[key] = {k: v for k, v in out[key].items() if k != name}
            if not out[key]:
                del out[key]
    return out


def mark_inert(nodes: DataFrame, edges: DataFrame, failed: DataFrame) -> DataFrame:
    """(location, inert): whether a node is left out since an optional
    dependency can't be installed: the failed nodes (location), what needs them
    up to the optional edges above, and what only those lead to."""
    out = optional_set(edges, failed.select("location").distinct()).select("location", F.lit(True).alias("inert"))
    return nodes.select("location").join(out, "location", "left").select("location", F.coalesce("inert", F.lit(False)).alias("inert"))

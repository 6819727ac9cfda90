"""Lockfiles, manifests and other text sources as nodes and edges, and back."""

from __future__ import annotations

import io
import json
import re
import tarfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphweft.functions import text
from graphweft.operators import graph as G

NEWEST = 4
FLAGS = ("dev", "optional", "devOptional", "peer", "extraneous", "inBundle")


def migrated(lock: dict) -> dict:
    """A version 1 lock's nested dependencies as flat locations."""
    packages = {"": {k: lock[k] for k in ("name", "version") if k in lock}}

    def go(dependencies: dict, at: str) -> None:
        for name, d in dependencies.items():
            place = f"{at}/node_modules/{name}".lstrip("/")
            own = {k: d[k] for k in ("version", "resolved", "integrity", "dev", "optional", "peer") if k in d}
            if "bundled" in d:
                own["inBundle"] = d["bundled"]
            if "requires" in d and isinstance(d["requires"], dict):
                own["dependencies"] = d["requires"]
            packages[place] = own
            go(d.get("dependencies") or {}, place)

    go(lock.get("dependencies") or {}, "")
    return packages


def _packages(batches):
    for b in batches:
        rows = []
        for graph_id, content in zip(b["graph_id"], b["content"], strict=True):
            lock = json.loads(content)
            version = lock.get("lockfileVersion", 1)
            if version > NEWEST:
                raise ValueError(f"lockfile version {version} is newer than {NEWEST}")
            for location, p in (lock.get("packages") or migrated(lock)).items():
                name = p.get("name") or location.rpartition("node_modules/")[2] or lock.get("name")
                rows.append((graph_id, location, location.rpartition("node_modules/")[2] or name, name, p.get("version"), p.get("resolved"), p.get("integrity"), bool(p.get("link")), json.dumps({"name": name, **p}), *[bool(p.get(f)) for f in FLAGS]))
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")])


SCHEMA = "graph_id string, location string, name string, package_name string, version string, resolved string, integrity string, is_link boolean, manifest string, " + ", ".join(f"{f} boolean" for f in FLAGS)


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """A row for each package of each lockfile under path, versions 1 to 4."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("graph_id"), F.col("value").alias("content"))
    return files.mapInPandas(_packages, SCHEMA)


def load_virtual(spark: SparkSession, path: str) -> G.Graph:
    """One lockfile as a graph. A link whose target is not there is an error."""
    p = read_packages(spark, path)
    target = F.when(F.col("is_link"), F.col("resolved"))
    places = p.where("location <> '' and location not like '%node_modules/%'")
    nodes = p.select(
        "location", "name", "package_name", "version", "resolved", "integrity", "is_link", target.alias("target_location"), F.parse_json("manifest").alias("package"),
        "dev", "optional", F.col("devOptional").alias("dev_optional"), "peer", "extraneous", F.col("inBundle").alias("in_bundle"), (F.col("location") == "").alias("is_root"),
        F.when((F.col("location") != "") & ~F.col("location").contains("node_modules/"), F.lit("")).alias("resolve_parent"), F.concat(F.lit("/"), F.coalesce(target, "location")).alias("realpath"),
    )
    lost = nodes.where("is_link").join(places.select(F.col("location").alias("at")), F.col("target_location") == F.col("at"), "left_anti")
    if not lost.isEmpty():
        raise ValueError("EMISSINGTARGET: a link's target isn't in the lockfile")
    linked = nodes.where("is_link").select(F.col("target_location").alias("location"), F.lit(True).alias("_ws"))
    nodes = G.complete(nodes.join(linked, "location", "left").withColumn("is_workspace", F.coalesce("_ws", F.lit(False)) | F.col("is_link")).drop("_ws"))
    declared = G.declared_edges(nodes)
    spaces = nodes.where("is_link").select(F.lit("").alias("src"), "name", F.lit("workspace").alias("type"), F.concat(F.lit("file:"), "target_location").alias("spec"))
    declared = declared.join(spaces.select("src", "name"), ["src", "name"], "left_anti").unionByName(spaces)
    edges = G.edge_errors(G.resolve_edges(nodes, declared), nodes)
    return G.Graph(nodes, edges, "", "/")


def stale_edges(lock_root: DataFrame, manifest_root: DataFrame) -> DataFrame:
    """Root edges (name, type, spec) that lock and manifest tell differently."""
    a = lock_root.select("name", F.col("type").alias("was_type"), F.col("spec").alias("was_spec"))
    b = manifest_root.select("name", "type", "spec")
    return a.join(b, "name", "full_outer").where("not (was_type <=> type) or not (was_spec <=> spec)")


def to_lockfile(nodes: DataFrame, name: str, version: str = "1.0.0") -> DataFrame:
    """One row: the lockfile's text, packages in order of location."""
    own = F.struct(F.col("location").alias("key"), F.struct("version", *[c for c in ("resolved", "integrity") if c in nodes.columns], *[F.when(F.col(c), True).alias(c) for c in ("dev", "optional", "peer", "extraneous")]).alias("value"))
    packages = nodes.agg(F.map_from_entries(F.sort_array(F.collect_list(own))).alias("packages"))
    return packages.select(F.to_json(F.struct(F.lit(name).alias("name"), F.lit(version).alias("version"), F.lit(3).alias("lockfileVersion"), F.lit(True).alias("requires"), "packages")).alias("value"))


# --- other lock and text formats -----------------------------------------------------


def parse_yarn(content: str) -> dict[str, dict]:
    """Entries of a yarn lock by each of their specs."""
    out: dict[str, dict] = {}
    entry: dict | None = None
    section = None
    for line in content.splitlines():
        if not line.strip() or line.startswith("#"):
            continue
        depth = len(line) - len(line.lstrip())
        words = line.strip()
        if depth == 0:
            entry, section = {}, None
            for spec in words.rstrip(":").split(", "):
                out[spec.strip('"')] = entry
        elif depth == 2 and words.endswith(":"):
            section = entry.setdefault(words[:-1], {})
        else:
            m = re.match(r'("(?:[^"\\]|\\.)*"|\S+)\s+(.*)', words)
            if not m or entry is None:
                raise ValueError(f"corrupt yarn lock: {words!r}")
            key, value = m[1].strip('"'), m[2].strip('"')
            if key == "resolved" and depth == 2:
                value = value.partition("#")[0]
            (section if depth >= 4 and section is not None else entry)[key] = value
    return out


def to_yarn(entries: dict[str, dict]) -> str:
    """A yarn lock's text, specs of one entry together, in order."""
    groups: dict[int, list[str]] = {}
    for spec, e in entries.items():
        groups.setdefault(id(e), []).append(spec)
    quote = lambda s: f'"{s}"' if re.search(r"[:\s,\"]|^(true|false|[^A-Za-z])", s) else s
    lines = ["# yarn lockfile v1", ""]
    for specs in sorted(sorted(g) for g in groups.values()):
        e = entries[specs[0]]
        lines += ["", ", ".join(map(quote, specs)) + ":"]
        for k, v in e.items():
            if isinstance(v, dict):
                lines.append(f"  {k}:")
                lines += [f"    {quote(a)} {quote(b)}" for a, b in sorted(v.items())]
            else:
                lines.append(f'  {k} "{v}"')
    return "\n".join(lines) + "\n"


def read_yarn(spark: SparkSession, path: str) -> DataFrame:
    """(spec, version, resolved, integrity) of yarn locks under path."""

    def run(batches):
        for b in batches:
            rows = [(s, e.get("version"), e.get("resolved"), e.get("integrity")) for c in b["value"] for s, e in parse_yarn(c).items()]
            yield pd.DataFrame(rows, columns=["spec", "version", "resolved", "integrity"])

    return spark.read.text(path, wholetext=True).mapInPandas(run, "spec string, version string, resolved string, integrity string")


def read_packuments(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(versions, dist_tags) of packument files: (name, version, published_at,
    manifest) and (name, tag, version)."""
    docs = spark.read.text(path, wholetext=True).select(F.from_json("value", "name string, `dist-tags` map<string,string>, time map<string,string>, versions map<string,string>").alias("d")).select("d.*")
    versions = docs.select("name", F.explode("versions").alias("version", "manifest"), "time").select("name", "version", F.expr("try_to_timestamp(time[version])").alias("published_at"), F.parse_json("manifest").alias("manifest"))
    return versions, docs.select("name", F.explode("dist-tags").alias("tag", "version"))


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """(location, name, version, package) of package.json files under path."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "package.json").text(path, wholetext=True)
    at = F.regexp_replace(F.col("_metadata.file_path"), "/package.json$", "")
    return files.select(at.alias("location"), F.parse_json("value").alias("package"), F.col("_metadata.file_modification_time").alias("modified")).withColumn("name", F.try_variant_get("package", "$.name", "string")).withColumn("version", F.coalesce(F.try_variant_get("package", "$.version", "string"), F.lit("")))


def snapshot_breaches(manifests: DataFrame, locked: DataFrame, lock_time) -> DataFrame:
    """(location, breach): why a cached scan no longer holds: a manifest that is
    newer than it, one that it doesn't have, or one that it has and that is gone.
    manifests: location, modified; locked: location. Links count as there."""
    known = locked.where("location <> ''").select("location", *(["is_link"] if "is_link" in locked.columns else [F.lit(False).alias("is_link")])).withColumn("_locked", F.lit(True))
    rows = manifests.where("location <> ''").select("location", "modified").join(known, "location", "full_outer")
    breach = F.when(F.col("_locked").isNull(), "not in the lockfile").when(F.col("modified") > F.lit(lock_time), "newer than the lockfile").when(F.col("modified").isNull() & ~F.col("is_link"), "not there")
    return rows.select("location", breach.alias("breach")).where("breach is not null")


def snapshot_valid(manifests: DataFrame, lock_time, locked: DataFrame | None = None) -> bool:
    """Whether a cached scan holds: no manifest is newer than it and, where its
    locations are given, both have the same ones."""
    if locked is None:
        return manifests.where(F.col("modified") > F.lit(lock_time)).isEmpty()
    return snapshot_breaches(manifests, locked, lock_time).isEmpty()


ADVISORY = "id string, url string, title string, severity string, vulnerable_versions string, cwe array<string>, cvss struct<score:double,vectorString:string>"


def read_advisories(spark: SparkSession, path: str) -> DataFrame:
    """(name, id, url, title, severity, vulnerable_versions, cwe, score) of bulk
    answers, each an object of lists of advisories by package name. The same
    advisory in several answers is one row."""
    lists = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,array<struct<{ADVISORY.replace(' string', ':string').replace(' array', ':array').replace(' struct', ':struct')}>>>")).alias("name", "all"))
    return lists.select("name", F.explode("all").alias("a")).select("name", "a.id", "a.url", "a.title", "a.severity", "a.vulnerable_versions", F.coalesce("a.cwe", F.array().cast("array<string>")).alias("cwe"), F.col("a.cvss.score").alias("score")).distinct()


def read_archives(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(archive, path, mode, content) of the text files in tarballs, without the
    first folder of their paths."""
    wanted = re.compile(text.glob_regex(glob)) if glob else None

    def run(batches):
        for b in batches:
            rows = []
            for name, content in zip(b["path"], b["content"], strict=True):
                with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as t:
                    for m in t:
                        inner = m.name.partition("/")[2]
                        if m.isfile() and (wanted is None or wanted.match(inner)):
                            rows.append((name, inner, oct(m.mode | 0o100000)[2:], t.extractfile(m).read().decode("utf-8", "replace")))
            yield pd.DataFrame(rows, columns=["archive", "path", "mode", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, path string, mode string, content string")


def archive_totals(files: DataFrame) -> DataFrame:
    """(archive, n_files, size) of archive entries."""
    return files.groupBy("archive").agg(F.count(F.lit(1)).alias("n_files"), F.sum(F.octet_length("content")).alias("size"))


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of markdown files, front matter left out."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", r"(?s)^---\n.*?\n---\n?", "").alias("text"))


def read_pages(spark: SparkSession, pages: list[str]) -> DataFrame:
    """Items of paged responses in the order of the pages, each file {items:
    [...], total}: at most as many as the first page's total, if it has one."""
    out = None
    for k, page in enumerate(pages):
        rows = spark.read.text(page, wholetext=True).select(F.lit(k).alias("page"), F.from_json("value", "items array<string>, total long").alias("p"))
        out = rows if out is None else out.union(rows)
    before = F.coalesce(F.sum(F.size("p.items")).over(Window.orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a page
    total = F.first("p.total").over(Window.orderBy("page"))
    placed = out.select("page", "p", before.alias("before"), total.alias("total")).select("before", "total", F.posexplode("p.items").alias("at", "item"))
    return placed.where("total is null or before + at < total").select("item")


def spec_overrides(declared: DataFrame, entries: DataFrame) -> DataFrame:
    """declared edges (src, name, spec) with the version, address and integrity
    that a yarn lock's entry of the raw spec (`name@spec`) fixes, if any."""
    own = entries.select(F.col("spec").alias("_raw"), "version", "resolved", "integrity")
    return declared.join(own, F.concat("name", F.lit("@"), "spec") == F.col("_raw"), "left").drop("_raw")


def json_lines(rows: DataFrame) -> DataFrame:
    """(value): each row as a JSON object, as the buffered sink writes them."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def parseable(rows: DataFrame, *columns: str, separator: str = ":") -> DataFrame:
    """(value): the columns of each row joined by a separator; a null is empty."""
    return rows.select(F.concat_ws(separator, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).alias("value"))

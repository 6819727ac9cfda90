"""Bills of materials: what goes in, its components, and whole documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweft.functions import text
from graphweft.operators.closure import many
from graphweft.operators.graph import Graph
from graphweft.operators.reports import one_a_place
from graphweft.plans.compiler import select
from graphweft.sources.documents import document, text_of
from graphweft.storage import stored


def selection(graph: Graph, omit: tuple[str, ...] = (), workspaces: list[str] | None = None, workspaces_enabled: bool = True) -> DataFrame:
    """The nodes of a bill: the root and all below it, or below the chosen
    workspaces, or without workspaces; extraneous nodes too, unless workspaces
    are chosen. omit: dependency types whose nodes stay out."""
    omits = "".join(f":not(.{o})" for o in omit)
    if not workspaces_enabled:
        wanted = f":root > :not(.workspace){omits},:root > :not(.workspace) *{omits},:extraneous"
    elif workspaces:
        wanted = ",".join(f"#{w},#{w} *{omits}" for w in workspaces)
    else:
        wanted = f":root *{omits},:extraneous"
    return select(graph, f":root,{wanted}")


def bill_errors(graph: Graph, chosen: DataFrame) -> DataFrame:
    """(error): missing dependencies that aren't optional, and invalid ones, of the chosen nodes."""
    ids = graph.nodes.select("location", F.concat("package_name", F.lit("@"), F.coalesce("version", F.lit(""))).alias("_id"))
    e = graph.edges.join(chosen.select(F.col("location").alias("src")), "src", "left_semi").where("error in ('MISSING', 'INVALID')")
    e = e.join(ids.withColumnsRenamed({"location": "src", "_id": "_from"}), "src").join(ids.withColumnsRenamed({"location": "dst", "_id": "_to"}), "dst", "left")
    missing = F.concat(F.lit("missing: "), "name", F.lit("@"), "spec", F.lit(", required by "), "_from")
    invalid = F.concat(F.lit("invalid: "), "_to", F.lit(", "), "spec", F.lit(" required by "), "_from")
    return e.select(F.when(F.col("error") == "MISSING", missing).otherwise(invalid).alias("error")).distinct()


def licence_text(package: Column) -> Column:
    """license, else the type of an object, else licenses joined by OR."""
    get = lambda p, kind="string": F.try_variant_get(package, p, kind)
    several = F.filter(F.transform(get("$.licenses", "array<variant>"), lambda v: F.coalesce(F.try_variant_get(v, "$.type", "string"), F.try_variant_get(v, "$", "string"))), lambda x: x.isNotNull())
    return F.coalesce(get("$.license.type"), get("$.license"), F.when(F.size(several) > 0, F.array_join(several, " OR ")))


def _told(chosen: DataFrame) -> DataFrame:
    """Chosen nodes with what both kinds of bill say of them."""
    get = lambda p: F.try_variant_get("package", p, "string")
    column = lambda c: F.col(c) if c in chosen.columns else F.lit(None).cast("string")
    git = F.coalesce(column("resolved").rlike(r"^git(\+|:)|\.git(#|$)"), F.lit(False))
    return chosen.select(
        "location", "is_root", "is_link", F.col("package_name").alias("name"), "version", F.concat("package_name", F.lit("@"), F.coalesce("version", F.lit(""))).alias("ref"),
        F.concat(text.purl(F.col("package_name"), F.col("version")), F.when(git, F.concat(F.lit("?vcs_url="), F.url_encode(column("resolved")))).otherwise("")).alias("purl"),
        (F.col("optional") | F.col("dev_optional")).alias("_optional"), "dev", "extraneous", "in_bundle", column("resolved").alias("resolved"), column("integrity").alias("integrity"),
        F.coalesce(get("$.author.name"), get("$.author")).alias("author"), get("$.description").alias("description"), F.coalesce(F.try_variant_get("package", "$.private", "boolean"), F.lit(False)).alias("private"),
        get("$.repository.url").alias("vcs"), get("$.homepage").alias("homepage"), get("$.bugs.url").alias("bugs"), licence_text(F.col("package")).alias("licence"),
    )


#: Names of digests in either kind of bill.
DIGESTS = {"sha1": "SHA-1", "sha256": "SHA-256", "sha384": "SHA-384", "sha512": "SHA-512"}
PROPERTIES = {"dev": "cdx:npm:package:development", "private": "cdx:npm:package:private", "extraneous": "cdx:npm:package:extraneous", "in_bundle": "cdx:npm:package:bundled"}
REFERENCES = {"resolved": "distribution", "vcs": "vcs", "homepage": "website", "bugs": "issue-tracker"}
#: A licence that is one identifier; several joined by AND, OR, WITH are an expression.
ONE_LICENCE = r"^[A-Za-z0-9][A-Za-z0-9.+-]*$"
EXPRESSION = r"^\(?[A-Za-z0-9][A-Za-z0-9.+() -]* (AND|OR|WITH) [A-Za-z0-9.+() -]+$"


def component(kind: str = "library") -> Column:
    """A component of a CycloneDX bill, of _told() rows; what isn't known is left out."""
    algorithm = F.regexp_extract("integrity", "^(sha[0-9]+)-", 1)
    digest = F.when(algorithm != "", F.array(F.struct(F.coalesce(F.create_map(*[F.lit(x) for kv in DIGESTS.items() for x in kv])[algorithm], F.lit("SHA-512")).alias("alg"), text.hex_digest(F.col("integrity")).alias("content"))))
    properties = F.array_compact(F.array(*[F.when(F.col(c), F.struct(F.lit(told).alias("name"), F.lit("true").alias("value"))) for c, told in PROPERTIES.items()]))
    references = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(told).alias("type"), F.col(c).alias("url"))) for c, told in REFERENCES.items()]))
    single = F.col("licence").rlike(ONE_LICENCE)
    licences = F.when(single | F.col("licence").rlike(EXPRESSION), F.array(F.struct(F.when(single, F.struct(F.col("licence").alias("id"))).alias("license"), F.when(~single, F.col("licence")).alias("expression"))))
    return F.struct(
        F.col("ref").alias("bom-ref"), F.lit(kind).alias("type"), "name", "version", F.when(F.col("_optional"), "optional").otherwise("required").alias("scope"), "author", "description", "purl",
        properties.alias("properties"), references.alias("externalReferences"), digest.alias("hashes"), licences.alias("licenses"),
    )


def _parts(graph: Graph, chosen: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The root; the first node of each ref that is neither root nor link; all
    chosen; edges between chosen nodes with both refs."""
    rows = stored(_told(chosen), "bill")
    first = one_a_place(rows.where("not is_root and not is_link"), "ref", F.lit(0), "location")
    at = lambda c, to: rows.select(F.col("location").alias(c), F.col("ref").alias(to))
    e = graph.resolved.join(at("src", "owner"), "src").join(at("dst", "needed"), "dst")
    return rows.where("is_root"), first, rows, e


def cyclonedx(graph: Graph, chosen: DataFrame, serial: str, timestamp: str, tool: str = "graphweft", kind: str = "library") -> DataFrame:
    """(n, value): the lines of a CycloneDX 1.5 document: one component for each
    name and version, and what each depends on, both in order of refs."""
    root, first, rows, _ = _parts(graph, chosen)
    top = root.select(F.to_json(component(kind)).alias("c")).first()["c"]
    # edges are cut down to those told of before they carry any ref: first by their sources, then by their ends
    owners = many(root.select("location", "ref").union(first.select("location", "ref")).select(F.col("location").alias("src"), F.col("ref").alias("owner")))
    told = graph.resolved.select("src", "dst").join(owners, "src").select("owner", "dst").join(many(rows.select(F.col("location").alias("dst"), F.col("ref").alias("needed"))), "dst")
    depends = told.groupBy(F.col("owner").alias("ref")).agg(F.sort_array(F.collect_set("needed")).alias("dependsOn"))
    every = root.select(F.lit("").alias("key"), "ref").union(first.select("ref", "ref")).join(many(depends), "ref", "left")
    needs = every.select("key", F.to_json(F.struct("ref", F.coalesce("dependsOn", F.array().cast("array<string>")).alias("dependsOn"))).alias("value"))
    head = f'{{"$schema":"http://cyclonedx.org/schema/bom-1.5.schema.json","bomFormat":"CycloneDX","specVersion":"1.5","serialNumber":{text_of("urn:uuid:" + serial)},"version":1,"metadata":{{"timestamp":{text_of(timestamp)},"lifecycles":[{{"phase":"build"}}],"tools":[{{"name":{text_of(tool)}}}],"component":{top}}},"components":['
    return document([(head, first.select(F.col("ref").alias("key"), F.to_json(component()).alias("value")), '],"dependencies":['), ("", needs, "]}")])


#: How an edge's type is told; all others are DEPENDENCY_OF.
RELATIONS = {"peer": "HAS_PREREQUISITE", "optional": "OPTIONAL_DEPENDENCY_OF", "dev": "DEV_DEPENDENCY_OF"}


def spdx(graph: Graph, chosen: DataFrame, namespace: str, timestamp: str, tool: str = "graphweft", kind: str | None = None) -> DataFrame:
    """(n, value): the lines of an SPDX 2.3 document: a package for each name and
    version, and the distinct relations between them; extraneous nodes are
    optional dependencies of the root."""
    root, first, rows, e = _parts(graph, chosen)
    of = lambda name, version: text.spdx_id(F.col(name), F.col(version))
    algorithm = F.regexp_extract("integrity", "^(sha[0-9]+)-", 1)
    none = lambda c: F.coalesce(c, F.lit("NOASSERTION"))
    package = lambda purpose: F.struct(
        "name", of("name", "version").alias("SPDXID"), F.col("version").alias("versionInfo"), F.col("location").alias("packageFileName"), "description", F.lit(purpose).alias("primaryPackagePurpose"),
        none(F.when(~F.col("is_link"), F.col("resolved"))).alias("downloadLocation"), F.lit(False).alias("filesAnalyzed"), none(F.col("homepage")).alias("homepage"), none(F.col("licence")).alias("licenseDeclared"),
        F.array(F.struct(F.lit("PACKAGE-MANAGER").alias("referenceCategory"), F.lit("purl").alias("referenceType"), F.col("purl").alias("referenceLocator"))).alias("externalRefs"),
        F.when(algorithm != "", F.array(F.struct(F.upper(algorithm).alias("algorithm"), text.hex_digest(F.col("integrity")).alias("checksumValue")))).alias("checksums"),
    )
    top = root.select(F.to_json(package(kind.upper() if kind else None)).alias("p"), of("name", "version").alias("id"), "ref").first()
    ids = rows.select("location", of("name", "version").alias("id"))
    told = F.lit("DEPENDENCY_OF")
    for t, r in RELATIONS.items():
        told = F.when(F.col("type") == t, r).otherwise(told)
    links = e.join(ids.withColumnsRenamed({"location": "src", "id": "a"}), "src").join(ids.withColumnsRenamed({"location": "dst", "id": "b"}), "dst").select(F.col("b").alias("x"), F.col("a").alias("y"), told.alias("r"))
    stray = rows.where("extraneous").select(of("name", "version").alias("x"), F.lit(top["id"]).alias("y"), F.lit(RELATIONS["optional"]).alias("r"))
    relation = F.to_json(F.struct(F.col("x").alias("spdxElementId"), F.col("y").alias("relatedSpdxElement"), F.col("r").alias("relationshipType")))
    relations = links.union(stray).distinct().select(F.concat_ws("\x01", "y", "x", "r").alias("key"), relation.alias("value"))
    describes = f'{{"spdxElementId":"SPDXRef-DOCUMENT","relatedSpdxElement":{text_of(top["id"])},"relationshipType":"DESCRIBES"}}'
    packages = first.select(F.concat(F.lit("\x01"), "ref").alias("key"), F.to_json(package(None)).alias("value")).union(graph.nodes.sparkSession.createDataFrame([("", top["p"])], "key string, value string"))
    relations = relations.union(graph.nodes.sparkSession.createDataFrame([("", describes)], "key string, value string"))
    head = f'{{"spdxVersion":"SPDX-2.3","dataLicense":"CC0-1.0","SPDXID":"SPDXRef-DOCUMENT","name":{text_of(top["ref"])},"documentNamespace":{text_of(namespace)},"creationInfo":{{"created":{text_of(timestamp)},"creators":[{text_of("Tool: " + tool)}]}},"documentDescribes":[{text_of(top["id"])}],"packages":['
    return document([(head, packages, '],"relationships":['), ("", relations, "]}")])

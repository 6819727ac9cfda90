"""Bills and lockfiles as ordered documents, and searches in pages."""

import json
import random

import pytest
from pyspark.sql import functions as F

from graphweft.operators import bills
from graphweft.operators.graph import Graph, complete
from graphweft.operators.ordering import numbered
from graphweft.sources import documents, pages


@pytest.fixture(scope="module")
def graph(spark):
    sha = "sha512-" + "A" * 86 + "=="
    rows = [
        ("", "top", "1.0.0", None, None, {"license": "ISC", "description": 'says "hi"'}, False),
        ("node_modules/@s/a", "@s/a", "1.2.3", "https://r.example/a.tgz", sha, {"license": "MIT OR Apache-2.0", "author": {"name": "Ann"}, "homepage": "https://a.example"}, False),
        ("node_modules/b", "b", "2.0.0", "git+ssh://git@h.example/b.git#1", None, {"license": {"type": "MIT"}, "repository": {"url": "git://b"}, "bugs": {"url": "https://b/bugs"}, "private": True}, True),
        ("node_modules/@s/a/node_modules/b", "b", "2.0.0", None, None, {"licenses": [{"type": "MIT"}, "ISC"], "author": "Bob"}, False),
        ("node_modules/stray", "stray", "0.1.0", None, None, {}, False),
    ]
    nodes = spark.createDataFrame([(at, n, n, v, r, i, json.dumps({"name": n, **p}), at == "", dev, "stray" in at) for at, n, v, r, i, p, dev in rows], "location string, name string, package_name string, version string, resolved string, integrity string, package string, is_root boolean, dev boolean, extraneous boolean")
    edges = [("", "@s/a", "node_modules/@s/a", "prod", "^1.0.0", None), ("", "b", "node_modules/b", "dev", "^2.0.0", None), ("node_modules/@s/a", "b", "node_modules/@s/a/node_modules/b", "peer", "*", None), ("node_modules/@s/a", "gone", None, "prod", "^9", "MISSING"), ("node_modules/@s/a", "b2", "node_modules/b", "prod", "^3", "INVALID")]
    return Graph(complete(nodes), spark.createDataFrame(edges, "src string, name string, dst string, type string, spec string, error string"))


def whole(lines):
    return json.loads("\n".join(r["value"] for r in lines.orderBy("n").collect()))


def test_cyclonedx_document(graph):
    bom = whole(bills.cyclonedx(graph, bills.selection(graph), "0-0", "2026-01-01T00:00:00Z"))
    assert bom["metadata"]["component"]["description"] == 'says "hi"' and bom["serialNumber"] == "urn:uuid:0-0"
    a, b, stray = bom["components"]
    assert [c["bom-ref"] for c in bom["components"]] == ["@s/a@1.2.3", "b@2.0.0", "stray@0.1.0"]
    assert a["purl"] == "pkg:npm/%40s/a@1.2.3" and a["licenses"] == [{"expression": "MIT OR Apache-2.0"}] and a["author"] == "Ann" and a["scope"] == "required"
    assert a["hashes"] == [{"alg": "SHA-512", "content": "0" * 128}] and [r["type"] for r in a["externalReferences"]] == ["distribution", "website"]
    assert b["author"] == "Bob" and b["licenses"] == [{"expression": "MIT OR ISC"}]  # the first place of a name and version speaks
    assert stray["properties"] == [{"name": "cdx:npm:package:extraneous", "value": "true"}]
    assert bom["dependencies"] == [{"ref": "top@1.0.0", "dependsOn": ["@s/a@1.2.3", "b@2.0.0"]}, {"ref": "@s/a@1.2.3", "dependsOn": ["b@2.0.0"]}, {"ref": "b@2.0.0", "dependsOn": []}, {"ref": "stray@0.1.0", "dependsOn": []}]


def test_spdx_document(graph):
    bom = whole(bills.spdx(graph, bills.selection(graph), "http://x.example/1", "2026-01-01T00:00:00Z"))
    assert [p["SPDXID"] for p in bom["packages"]] == ["SPDXRef-Package-top-1.0.0", "SPDXRef-Package-s.a-1.2.3", "SPDXRef-Package-b-2.0.0", "SPDXRef-Package-stray-0.1.0"]
    assert bom["packages"][1]["checksums"] == [{"algorithm": "SHA512", "checksumValue": "0" * 128}] and bom["packages"][3]["licenseDeclared"] == "NOASSERTION"
    told = {(r["spdxElementId"].rpartition("Package-")[2], r["relatedSpdxElement"].rpartition("Package-")[2], r["relationshipType"]) for r in bom["relationships"]}
    assert told == {("SPDXRef-DOCUMENT", "top-1.0.0", "DESCRIBES"), ("s.a-1.2.3", "top-1.0.0", "DEPENDENCY_OF"), ("b-2.0.0", "top-1.0.0", "DEV_DEPENDENCY_OF"), ("b-2.0.0", "s.a-1.2.3", "HAS_PREREQUISITE"), ("b-2.0.0", "s.a-1.2.3", "DEPENDENCY_OF"), ("stray-0.1.0", "top-1.0.0", "OPTIONAL_DEPENDENCY_OF")}
    assert bom["relationships"][0]["relationshipType"] == "DESCRIBES"


def test_bill_selection_and_errors(graph):
    got = {r["location"] for r in bills.selection(graph, omit=("dev",)).collect()}
    assert got == {"", "node_modules/@s/a", "node_modules/@s/a/node_modules/b", "node_modules/stray"}
    assert {r["error"] for r in bills.bill_errors(graph, bills.selection(graph)).collect()} == {"missing: gone@^9, required by @s/a@1.2.3", "invalid: b@2.0.0, ^3 required by @s/a@1.2.3"}


@pytest.mark.parametrize("version", [2, 3])
def test_lockfile_document(graph, version):
    lock = whole(documents.lockfile_document(graph.nodes, "top", lock_version=version))
    assert list(lock["packages"]) == sorted(lock["packages"]) and lock["lockfileVersion"] == version
    assert lock["packages"]["node_modules/b"] == {"version": "2.0.0", "resolved": "git+ssh://git@h.example/b.git#1", "dev": True, "license": {"type": "MIT"}}


def test_documents_are_written_by_ranges(spark, tmp_path):
    """Many files, each a range; joined they are the document, and no file has it all."""
    n = 20_000
    rows = spark.range(n).select(F.format_string("%08d", F.col("id") * 7919 % n).alias("key"), F.format_string('{"k":%d}', F.col("id") * 7919 % n).alias("value"))
    path = str(tmp_path / "doc")
    documents.write_document(documents.document([('{"a":[', rows, '],"b":['), ("", rows.where("false"), "]}")]), path, files=4)
    files = sorted((tmp_path / "doc").glob("part-*"))
    assert len(files) > 1 and max(f.stat().st_size for f in files) < 0.6 * sum(f.stat().st_size for f in files)
    documents.join_files(spark, path, str(tmp_path / "doc.json"))
    assert json.loads((tmp_path / "doc.json").read_text()) == {"a": [{"k": k} for k in range(n)], "b": []}


def test_numbers_follow_the_order(spark):
    keys = [f"{random.Random(k).random()}" for k in range(500)]
    got = numbered(spark.createDataFrame([(k,) for k in keys], "k string").repartition(7), "k").collect()
    assert sorted((r["n"], r["k"]) for r in got) == list(enumerate(sorted(keys), 1))
    assert numbered(spark.createDataFrame([], "k string"), "k").count() == 0


# --- pages -------------------------------------------------------------------------


def hit(k):
    return {"package": {"name": f"p{k}", "version": f"{k}.0.0", "note": "é[]{}\"" * (k % 3)}, "score": {"final": k / 10}}


def put(folder, page, hits, cut=None):
    text = json.dumps({"total": 95, "objects": hits}, ensure_ascii=False)
    (folder / f"page-{page}.json").write_text(text[:cut] if cut else text)


@pytest.fixture
def folder(tmp_path):
    for page in range(10):
        put(tmp_path, page, [hit(k) for k in range(page * 10, min(page * 10 + 10, 95))])
    return tmp_path


@pytest.fixture(scope="module")
def source(spark):
    spark.dataSource.register(pages.PagedSearch)
    return spark


def test_pages_are_partitions_and_offsets_are_pushed_in(source, folder):
    read = source.read.format("paged_search").option("page_size", 10)
    assert [r["name"] for r in read.load(str(folder)).orderBy("at").collect()] == [f"p{k}" for k in range(95)]
    (folder / "page-0.json").write_text("broken")
    (folder / "page-9.json").write_text("broken")
    some = read.option("from", 15).option("size", 30).load(str(folder))
    assert some.rdd.getNumPartitions() == 4
    assert [(r["at"], r["version"], r["score"]) for r in some.orderBy("at").collect()] == [(k, f"{k}.0.0", k / 10) for k in range(15, 45)]
    assert json.loads(some.where("at = 20").first()["package"]) == hit(20)["package"]


def test_a_page_that_fails_is_told(source, folder):
    put(folder, 3, [hit(k) for k in range(30, 40)], cut=200)
    with pytest.raises(Exception, match="page 3 of"):
        source.read.format("paged_search").option("page_size", 10).option("wait", 0).load(str(folder)).collect()


def test_a_page_that_fails_once_is_read_again_without_repeats(folder, monkeypatch):
    own, failed = pages.Pages({"path": str(folder), "page_size": "10", "wait": "0"}), []
    real = pages.elements

    def flaky(read, key):
        for k, x in enumerate(real(read, key)):
            if k == 4 and not failed:
                failed.append(1)
                raise OSError("lost")
            yield x

    monkeypatch.setattr(pages, "elements", flaky)
    assert [h[0] for h in own.hits(2)] == list(range(20, 30)) and failed


def test_stream_goes_on_where_it_stopped(source, tmp_path):
    folder, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    folder.mkdir()

    def run():
        q = source.readStream.format("paged_search").option("page_size", 10).option("wait", 0).load(str(folder)).writeStream.format("parquet").option("checkpointLocation", mark).trigger(availableNow=True).start(out)
        q.awaitTermination(120)
        return sorted(r["at"] for r in source.read.parquet(out).collect())

    for page in (0, 1):
        put(folder, page, [hit(k) for k in range(page * 10, page * 10 + 10)])
    put(folder, 2, [hit(k) for k in range(20, 30)], cut=100)  # not whole yet
    assert run() == list(range(20))
    put(folder, 2, [hit(k) for k in range(20, 30)])
    put(folder, 3, [hit(k) for k in range(30, 35)])
    assert run() == list(range(35))


@pytest.mark.parametrize("size", [1, 7, 1 << 16])
def test_elements_come_one_at_a_time(size, monkeypatch):
    import io

    monkeypatch.setattr(pages, "CHUNK", size)
    text = json.dumps({"x": {"objects": 3}, "objects": [1, 23, "é]", {"a": [1, {"b": None}]}, [], -4.5e3, True], "z": 1}, ensure_ascii=False).encode()
    assert list(pages.elements(io.BytesIO(text).read, "objects")) == [1, 23, "é]", {"a": [1, {"b": None}]}, [], -4500.0, True]
    with pytest.raises(ValueError):
        list(pages.elements(io.BytesIO(text[:40]).read, "objects"))
    assert list(pages.elements(io.BytesIO(b'{"other": 1}').read, "objects")) == []

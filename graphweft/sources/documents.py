"""One ordered text document, or many rows of it, out of DataFrames.

A document is a header, sections of entries in order and a footer. Its lines
are numbered over ranges of the order and written by Spark a file a range, so
that the files one after another are the document; no task holds more than its
own range, and Spark's commit shows all files or none.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.operators.ordering import numbered
from graphweft.storage import stored

#: (what goes before the entries, entries (key, value), what goes after them).
Section = tuple[str, DataFrame, str]


def document(sections: list[Section], separator: str = ",") -> DataFrame:
    """(n, value): the lines of a document in order. Entries of a section are
    in order of their keys, which are unique, and all but its last end in the
    separator. A section without entries is its header and footer alone."""
    spark = sections[0][1].sparkSession
    out = spark.createDataFrame([(k, part, line) for k, (head, _, foot) in enumerate(sections) for part, line in ((0, head), (2, foot)) if line], "section int, part int, value string").withColumn("key", F.lit("")).select("section", "part", "key", "value")
    for k, (_, entries, _) in enumerate(sections):
        out = out.unionByName(entries.select(F.lit(k).alias("section"), F.lit(1).alias("part"), F.col("key").cast("string").alias("key"), "value"))
    lines = stored(numbered(out, "section", "part", "key"), "lines")
    last = lines.where("part = 1").groupBy("section").agg(F.max("n").alias("_last"))  # a row a section
    ends = lines.join(F.broadcast(last), "section", "left")
    return ends.select("n", F.when((F.col("part") == 1) & (F.col("n") < F.col("_last")), F.concat("value", F.lit(separator))).otherwise(F.col("value")).alias("value"))


def write_document(lines: DataFrame, path: str, files: int | None = None) -> None:
    """Write (n, value) as text files whose names are in the order of the lines;
    how many, unless it is said, follows from the lines' size."""
    lines.repartitionByRange(*([files] if files else []), "n").sortWithinPartitions("n").select("value").write.text(path)


def join_files(spark: SparkSession, path: str, target: str) -> None:
    """One file of all that write_document() wrote, copied by Hadoop's streams a buffer at a time."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at, to = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, target))
    source, sink = at.getFileSystem(conf), to.getFileSystem(conf)
    held = to.suffix(".part")
    out = sink.create(held, True)
    for name in sorted(s.getPath().getName() for s in source.listStatus(at)):
        if name.startswith("part-"):
            file = source.open(jvm.org.apache.hadoop.fs.Path(at, name))
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(file, out, 1 << 16, False)
            file.close()
    out.close()
    sink.delete(to, False)
    if not sink.rename(held, to):
        raise OSError(f"{target}: the finished document could not be put in place")


def text_of(value: str) -> str:
    return json.dumps(value, ensure_ascii=False)


def lockfile_document(nodes: DataFrame, name: str, version: str = "1.0.0", lock_version: int = 3) -> DataFrame:
    """(n, value): a lockfile's lines. Versions 2 and 3 list packages by
    location, each with what its node says: version, resolved, integrity, link,
    flags that hold, and its manifest's dependencies, engines, bin and licence."""
    if lock_version not in (2, 3):
        raise ValueError("only versions 2 and 3 list packages by location")
    flags = {"dev": "dev", "optional": "optional", "dev_optional": "devOptional", "peer": "peer", "extraneous": "extraneous", "in_bundle": "inBundle", "is_link": "link"}
    held = [F.when(F.col(c), True).alias(told) for c, told in flags.items() if c in nodes.columns]
    maps = [F.try_variant_get("package", f"$.{k}", "map<string,string>").alias(k) for k in ("dependencies", "optionalDependencies", "peerDependencies", "devDependencies", "engines", "bin")]
    texts = [c for c in ("resolved", "integrity") if c in nodes.columns]
    body = F.to_json(F.struct("version", *texts, *held, *maps, F.try_variant_get("package", "$.license", "variant").alias("license")))
    quoted = F.regexp_extract(F.to_json(F.struct(F.col("location").alias("k"))), r"^\{\"k\":(.*)\}$", 1)
    rows = nodes.select(F.col("location").alias("key"), F.concat(quoted, F.lit(":"), body).alias("value"))
    head = f'{{"name":{text_of(name)},"version":{text_of(version)},"lockfileVersion":{lock_version},"requires":true,"packages":{{'
    return document([(head, rows, "}}")])

"""Tables written to the cluster's shared folder, to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: What is written and read again takes up a third less disk than by the default.
CODEC = "zstd"


def work_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a session without
    other machines, as in tests, gets a local folder; any other fails, since
    its executors and driver don't share one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined():
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors and the driver share")
            spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="graphweft-"))
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get()
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> str:
    """Write df there as Parquet; returns the path."""
    path = f"{work_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=CODEC)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df there and read it back; `path_of` tells where."""
    path = written(df, name)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._gw_path = path
    return out


def path_of(df: DataFrame) -> str:
    return df._gw_path


def dropped(df: DataFrame) -> None:
    """Delete what stored() wrote; df must not be read any more."""
    spark, at = df.sparkSession, df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path_of(df))
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def buckets(spark: SparkSession) -> int:
    """How many parts dealt() deals rows into: as many as a shuffle has."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt(df: DataFrame, name: str, *keys: str, to: str | None = None) -> DataFrame:
    """Write df there as a bucketed table: a join or grouping on exactly these
    keys reads it as it lies, however often, and shuffles the other side only.
    to: append to what dealt() wrote before, as `table_of` tells."""
    spark = df.sparkSession
    at = to or f"graphweft_{name}_{uuid.uuid4().hex}"
    rows = df.repartition(buckets(spark), *keys) if to is None else df
    rows.write.bucketBy(buckets(spark), *keys).mode("append").format("parquet").option("compression", CODEC).option("path", f"{work_folder(spark)}/{at}").saveAsTable(at)
    out = spark.table(at)
    out._gw_table = at
    return out


def table_of(df: DataFrame) -> str:
    return df._gw_table

"""A stream of lockfiles as rows of packages. The batch reader's parser runs on
each arriving file; nothing is kept between batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphweft.sources.lockfile import SCHEMA, _packages


def stream_packages(spark: SparkSession, path: str) -> DataFrame:
    files = spark.readStream.format("text").option("wholetext", True).load(path)
    return files.select(F.input_file_name().alias("graph_id"), F.col("value").alias("content")).mapInPandas(_packages, SCHEMA)

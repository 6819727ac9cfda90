"""Shared plumbing of the text operators: column picking, Arrow maps and
tables written to the shared work folder."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft.storage import written

#: Words of every contract that speaks of words.
WORD = r"[^\x20\x09-\x0D]+"


def pick(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string): a null text counts as empty; any other
    column, whatever its name, is left behind."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def numbered(docs: DataFrame) -> DataFrame:
    """docs with plain column names, by place: names with dots or clashing
    names are no matter then. toDF(*docs.columns) gives the names back."""
    return docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])


def place(docs: DataFrame, column: str) -> int:
    return [c.lower() for c in docs.columns].index(column.lower())


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage is cut and
    a lost executor costs only a reread."""
    path = written(df, name)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._gw_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete what stored() wrote; df must not be read any more."""
    spark, path = df.sparkSession, getattr(df, "_gw_path", None)
    if path:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def batch_of(schema: pa.Schema, columns: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)

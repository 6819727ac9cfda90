"""Differences between the files of two packages."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Endings of files that are only named, not shown line by line.
BINARY = ("png", "jpg", "jpeg", "gif", "ico", "bmp", "webp", "zip", "gz", "tgz", "bz2", "xz", "7z", "rar", "tar", "pdf", "exe", "dll", "so", "dylib", "wasm", "woff", "woff2", "ttf", "otf", "eot", "mp3", "mp4", "ogg", "wav", "avi", "mov", "class", "jar", "bin")


def file_diff(a: DataFrame, b: DataFrame, name_only: bool = False, context: int = 3) -> DataFrame:
    """(path, patch) of files that differ in content or mode. Both sides: path,
    content, mode. Patches are made in Arrow batches, only of what differs."""
    both = a.select("path", F.col("content").alias("was"), F.col("mode").alias("was_mode")).join(b.select("path", F.col("content").alias("will"), F.col("mode").alias("will_mode")), "path", "full_outer")
    rows = both.where(~F.col("was").eqNullSafe(F.col("will")) | ~F.col("was_mode").eqNullSafe(F.col("will_mode")))
    if name_only:
        return rows.select("path")

    @F.pandas_udf("string")
    def patch(path: pd.Series, was: pd.Series, will: pd.Series, was_mode: pd.Series, will_mode: pd.Series) -> pd.Series:
        out = []
        for p, x, y, m, n in zip(path, was, will, was_mode, will_mode, strict=True):
            head = [f"diff --git a/{p} b/{p}"]
            if x is None:
                head.append(f"new file mode {n}")
            elif y is None:
                head.append(f"deleted file mode {m}")
            elif m != n:
                head += [f"old mode {m}", f"new mode {n}"]
            if p.rpartition(".")[2].lower() not in BINARY:
                head += difflib.unified_diff((x or "").splitlines(), (y or "").splitlines(), f"a/{p}" if x is not None else "/dev/null", f"b/{p}" if y is not None else "/dev/null", n=context, lineterm="")
            out.append("\n".join(head))
        return pd.Series(out, dtype=object)

    return rows.select("path", patch("path", "was", "will", "was_mode", "will_mode").alias("patch"))

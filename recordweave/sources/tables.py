"""Readers of the record-book tables."""

from __future__ import annotations

import functools
import pathlib
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The parquet table ``name`` under ``root`` (a file or a folder of files)."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def read_schema_files(folder: str) -> list[dict]:
    """Every ``*.json`` type definition of a local folder, by name (a dictionary, not data)."""
    import json

    base = pathlib.Path(urlparse(folder).path or folder)
    return [json.loads(p.read_text(encoding="utf-8")) for p in sorted(base.glob("*.json"))]


def read_text_folder(spark: SparkSession, path: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Markdown and text files below ``path`` as rows (name, text); ``exclude`` lists names to skip."""
    from pyspark.sql import functions as F

    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,txt}").text(path)
    base = pathlib.PurePosixPath(urlparse(path).path or path)
    named = raw.select(F.regexp_replace(F.col("_metadata.file_path"), f"^.*?{base.as_posix()}/?", "").alias("name"), F.col("value").alias("text"))
    return functools.reduce(lambda df, n: df.where(F.col("name") != n), exclude, named)

"""Tables of a folder: one file or folder of files for each, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Readers by ending.
FORMATS = {"parquet": "parquet", "orc": "orc", "jsonl": "json", "csv": "csv"}


def read_table(spark: SparkSession, folder: str, name: str, kind: str = "parquet") -> DataFrame:
    """The table folder/name.kind; csv files have a header, and their columns' types are inferred."""
    if kind not in FORMATS:
        raise ValueError(f"{kind} is none of {', '.join(FORMATS)}")
    reader = spark.read.format(FORMATS[kind])
    return (reader.option("header", True).option("inferSchema", True) if kind == "csv" else reader).load(f"{folder}/{name}.{kind}")

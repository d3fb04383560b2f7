"""Runs query texts over tables in Spark, and writes the same for the checking engine."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.dialect import DUCK, SPARK
from ..sources.tables import read_table
from .fixtures import DERIVED, GIVEN

NAME = re.compile(r"@([a-z_]+)")
#: Derived tables that Spark makes by a function of the other tables, where the checking engine has a plain text.
BUILT: dict[str, Callable[[Tables], DataFrame]] = {}


def apply(spark: SparkSession, text: Callable, tables: dict[str, DataFrame]) -> DataFrame:
    """The query's result over these tables; they are named by @name in the text."""
    sql = text(SPARK)
    used = {n: tables[n] for n in NAME.findall(sql)}
    return spark.sql(NAME.sub(r"{\1}", sql.replace("{", "{{").replace("}", "}}")), **used)


class Tables(dict):
    """The given tables of a folder and those derived from them, planned when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        if name in GIVEN:
            self[name] = read_table(self.spark, self.sf_dir, name)
        elif name in BUILT:
            self[name] = BUILT[name](self)
        else:
            self[name] = apply(self.spark, DERIVED[name], self)
        return self[name]


def query(text: Callable) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: apply(spark, text, Tables(spark, sf_dir))


def oracle(text: Callable) -> str:
    """One statement: the derived tables that the query needs come first, as common table expressions."""
    parts: dict[str, str] = {}

    def need(sql: str) -> str:
        for n in NAME.findall(sql):
            if n not in GIVEN and n not in parts:
                own = need(DERIVED[n](DUCK))
                parts[n] = own
        return NAME.sub(r"\1", sql)

    sql = need(text(DUCK)).strip().replace("count_if(", "count(*) FILTER (WHERE ")  # whose count is a plain long there
    head = ", ".join(f"{n} AS MATERIALIZED ({s})" for n, s in parts.items())
    if not head:
        return sql
    return f"WITH {head}, {sql[5:]}" if sql.upper().startswith("WITH ") else f"WITH {head} {sql}"

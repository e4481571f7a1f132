"""Reading and writing group tables, vector tables and their parameters."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.groups import from_table, to_table

EXACT = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def read_csv(spark: SparkSession, path: str, match_format: str = "detect", count_column: str = "count", **options) -> DataFrame:
    """A group table from CSV with a header. All cells are text, an empty cell is an empty string; counts are numbers."""
    quoting = {"header": True, "escape": '"', "multiLine": True} | EXACT
    names = spark.read.options(**quoting).csv(path).columns
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = spark.read.options(**quoting).schema(schema).csv(path)
    rows = rows.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in names))
    if count_column in names:
        rows = rows.withColumn(count_column, F.col(count_column).try_cast("long"))
    return from_table(rows, match_format, count_column=count_column, **options)


def write_csv(matches: DataFrame, path: str, singletons: bool = True) -> None:
    to_table(matches, singletons, sort=False).write.mode("overwrite").options(header=True, escape='"', quoteAll=True, emptyValue="", **EXACT).csv(path)


def save_vectors(vectors: DataFrame, path: str, **parameters: float | str | bool) -> None:
    """Vectors as Parquet, the parameters (alpha, exponent, ...) as one line of JSON beside them."""
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    vectors.sparkSession.createDataFrame([(json.dumps(parameters, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/parameters")


def load_vectors(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, float | str | bool]]:
    (row,) = spark.read.text(f"{path}/parameters").collect()
    return spark.read.parquet(f"{path}/vectors"), json.loads(row["value"])

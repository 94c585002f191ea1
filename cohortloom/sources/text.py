"""CSV inputs."""

from __future__ import annotations

import csv
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def headerless_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Positional string columns; a row of another width fails the scan."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("mode", "FAILFAST").option("enforceSchema", "true").csv(path)


def clean_header(cell: str) -> str:
    return re.sub(r"\s+", "_", cell.strip().lower()).replace(".", "")


def repaired_csv(spark: SparkSession, path: str, header_line: str | None = None) -> DataFrame:
    """CSV whose header has one quoted cell standing for two columns.

    Without `header_line` each file starts with the header, which is then skipped.
    """
    line = header_line or spark.read.text(path).first()[0]
    cells = [part for cell in next(csv.reader([line])) for part in cell.split(",")]
    schema = T.StructType([T.StructField(clean_header(c), T.StringType()) for c in cells])
    return spark.read.schema(schema).option("header", header_line is None).option("enforceSchema", "true").csv(path)


def commented_csv(spark: SparkSession, path: str) -> DataFrame:
    """All-string CSV with a header and # comment lines; blanks stay blank, they mean clear."""
    df = spark.read.option("header", True).option("comment", "#").option("emptyValue", "").csv(path)
    return df.fillna("")

"""Registry tables: typed reads and JSON text columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def decode_json_columns(df: DataFrame, schemas: dict[str, str] | None = None) -> DataFrame:
    """Decode every ``*_json`` text column: to the given type, else to VARIANT.

    Text that is not JSON becomes NULL, so one bad row does not fail the scan.
    """
    schemas = schemas or {}
    decoded = {
        c: F.from_json(c, schemas[c]) if c in schemas else F.try_parse_json(c)
        for c, kind in df.dtypes
        if c.endswith("_json") and kind == "string"
    }
    return df.withColumns(decoded) if decoded else df


def read_registry(spark: SparkSession, path: str, schemas: dict[str, str] | None = None) -> DataFrame:
    """A registry table; files written by older versions may lack the newer columns."""
    return decode_json_columns(spark.read.option("mergeSchema", True).parquet(path), schemas)

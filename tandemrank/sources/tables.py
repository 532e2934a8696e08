"""Table scans with a stated schema, by suffix, with column pruning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def scan(spark: SparkSession, path: str, columns: Sequence[str] | None = None, schema: str | None = None) -> DataFrame:
    """Read parquet, CSV (with header) or JSON by suffix and keep ``columns``; CSV and JSON want a ``schema``."""
    kind = next((k for k in ("csv", "json", "jsonl") if path.rstrip("/").endswith(f".{k}")), "parquet")
    if kind != "parquet" and schema is None:
        raise ValueError(f"a schema is needed to read {kind}: inferring it would scan the data twice")
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == "csv":
        df = reader.csv(path, header=True)
    elif kind in ("json", "jsonl"):
        df = reader.json(path)
    else:
        df = reader.parquet(path)
    return df.select(*columns) if columns else df

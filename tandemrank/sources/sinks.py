"""Sinks with a content hash, file inventory and result manifest."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Files up to this size, and text files, are hashed whole; larger ones by their two ends and length.
WHOLE_BYTES = 10 * 1024 * 1024
EDGE_BYTES = 4096
# Suffixes that always count as text.
TEXT_SUFFIXES = ["json", "jsonl", "yaml", "yml", "md", "csv"]


@F.pandas_udf(T.StringType())
def _stream_hash(path: pd.Series, size: pd.Series, whole: pd.Series) -> pd.Series:
    """SHA-256 of large files, streamed: all of a text file, else its two ends and its length."""
    out = []
    for p, n, w in zip(path, size, whole):
        store, name = fs.FileSystem.from_uri(p)
        digest = hashlib.sha256()
        if w:
            with store.open_input_stream(name) as f:
                while chunk := f.read(1 << 20):
                    digest.update(chunk)
        else:
            with store.open_input_file(name) as f:
                digest.update(f.read_at(EDGE_BYTES, 0))
                digest.update(f.read_at(EDGE_BYTES, max(EDGE_BYTES, n - EDGE_BYTES)))
            digest.update(str(n).encode())
        out.append(digest.hexdigest())
    return pd.Series(out, dtype=object)


def content_hash(df: DataFrame) -> DataFrame:
    """Row count and an order-insensitive hash of all rows, in one pass (128 bits from two seeded sums)."""
    row = ", ".join([f"`{c}`" for c in df.columns] + [f"`{c}` IS NULL" for c in df.columns])  # the hash skips nulls
    return df.selectExpr(f"xxhash64({row}) AS _a", f"xxhash64(1, {row}) AS _b").agg(
        F.expr("count(*) AS n_rows"), F.expr("CAST(sum(CAST(_a AS DECIMAL(38, 0))) AS STRING) AS _s"),
        F.expr("bit_xor(_b) AS _x"),
    ).selectExpr("n_rows", "sha2(concat_ws('|', _s, CAST(_x AS STRING)), 256) AS content_hash")


def write_table(df: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists") -> DataFrame:
    """Write and return path, row count and content hash of what was written."""
    writer = df.write.mode(mode)
    if format == "csv":
        writer.option("header", True).csv(path)
        back = df.sparkSession.read.schema(df.schema).csv(path, header=True)
    elif format == "json":
        writer.json(path)
        back = df.sparkSession.read.schema(df.schema).json(path)
    else:
        writer.parquet(path)
        back = df.sparkSession.read.parquet(path)
    return content_hash(back).select(F.lit(path).alias("path"), "n_rows", "content_hash")


def inventory(spark: SparkSession, path: str, role: str | None = None, glob: str = "*") -> DataFrame:
    """Size, time, suffix, fingerprint and role of every file below ``path``, read by the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    text = ", ".join(f"'{s}'" for s in TEXT_SUFFIXES)
    named = files.selectExpr("*", "lower(regexp_extract(path, '[.]([^./]+)$', 1)) AS extension")
    head = ["path", "length AS size_bytes", "modificationTime AS modified", "extension"]
    # The length filter reaches the scan, so the content of a large file is never loaded as one value.
    small = named.filter(f"length <= {WHOLE_BYTES}").selectExpr(
        *head, "sha2(content, 256) AS fingerprint", "'full_sha256' AS scan_strategy"
    )
    large = named.filter(f"length > {WHOLE_BYTES}").selectExpr(*head, f"extension IN ({text}) AS _whole")
    large = large.withColumn("fingerprint", _stream_hash("path", "size_bytes", "_whole"))
    large = large.selectExpr(*[c.split()[-1] for c in head], "fingerprint", "IF(_whole, 'full_sha256', 'head_tail_hash') AS scan_strategy")
    return small.unionByName(large).withColumn("role", F.lit(role).cast("string"))


def inventory_summary(files: DataFrame) -> DataFrame:
    return files.groupBy("extension", "role").agg(F.expr("count(*) AS n_files"), F.expr("sum(size_bytes) AS total_bytes"))


def manifest(spark: SparkSession, path: str, tables: dict[str, DataFrame]) -> DataFrame:
    """One row per result table: name, rows and content hash, and the number and size of its files below ``path``."""
    files = inventory(spark, path).withColumn("name", F.expr(f"split_part(substring(path, instr(path, '{path}') + {len(path) + 1}), '/', 1)"))
    sizes = files.groupBy("name").agg(F.expr("count(*) AS n_files"), F.expr("sum(size_bytes) AS total_bytes"))
    out = None
    for name, df in tables.items():
        part = content_hash(df).withColumn("name", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.join(sizes, "name", "left")

"""Session helpers: a local session for tests, shared scratch tables, bounded broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A table may be broadcast only after it was counted and found to hold at most this many rows and bytes.
BROADCAST_ROWS = 50_000
BROADCAST_BYTES = 32 << 20
# Folder of scratch tables that go with the pass that wrote them.
PASS = "spark.tandemrank.pass"


def local_session(cores: str = "8", partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tandemrank")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """Folder for written intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``; it must be shared storage, so that a table outlives
    the executor that wrote it. Only a local master may fall back to a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder on shared storage")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tandemrank-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as parquet into the shared folder and read it back: cuts lineage, keeps pruning."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{spark.conf.get(PASS, '')}{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, folder: str = "") -> None:
    """Drop every scratch table this application wrote, or those in one folder of them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/{folder}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def in_passes(spark: SparkSession, parts: Iterable[Any], run: Callable[[Any], DataFrame]) -> DataFrame:
    """The rows of ``run`` for every part, one part after the other; the scratch tables of a part go when its rows are written.

    Those of a single part stay, as in any other step.
    """
    parts = list(parts)
    if len(parts) == 1:
        return run(parts[0])
    paths, schema, outer = [], None, spark.conf.get(PASS, "")
    for part in parts:
        folder = f"{outer}{uuid.uuid4().hex}/"
        spark.conf.set(PASS, folder)
        try:
            df = run(part)
            schema = df.schema
            paths.append(f"{scratch_dir(spark)}/{outer}{uuid.uuid4().hex}")
            df.write.option("compression", "zstd").parquet(paths[-1])
        finally:
            spark.conf.set(PASS, outer)
            release(spark, folder)
    return spark.read.schema(schema).parquet(*paths)


def bounded(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows of BROADCAST_BYTES together, else ``df`` itself.

    At most ``limit + 1`` rows reach the driver, and the broadcast table is those very rows.
    """
    rows = df.limit(limit + 1).toArrow()
    if rows.num_rows > limit or rows.nbytes > BROADCAST_BYTES:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, schema=df.schema))


def spread_join(
    rows: DataFrame, table: DataFrame, keys: list[str], spread: str, how: str = "inner", salts: int = 64
) -> DataFrame:
    """Join ``rows`` to ``table`` on ``keys`` when a few keys may own most of ``rows``.

    A small table is broadcast. Otherwise every key with over 1/1000 of the rows (so at most 1000 keys) is
    split by a hash of ``spread`` into as many parts as its share of the rows asks for, with at least ``salts`` parts for
    all rows together, and its table rows are repeated once per part. Null keys are spread as they match nothing.
    """
    small = bounded(table)
    if small is not table:
        return rows.join(small, keys, how)
    counts = materialize(rows.groupBy(*keys).count())
    total = counts.agg(F.sum("count")).first()[0] or 0
    # A key gets a task's share of rows per salt; at most 1000 keys can have over 1/1000 of the rows.
    share = max(1.0, total / max(salts, 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    hot = F.broadcast(
        counts.filter(F.col("count") > total / 1000.0).select(*keys, F.ceil(F.col("count") / share).cast("int").alias("_hot"))
    )
    hot_salts = F.coalesce(F.greatest(F.lit(1), F.col("_hot")), F.lit(1))
    unmatched = F.lit(False)
    for k in keys:  # a null key meets no row of the table, so its rows may go anywhere
        unmatched = unmatched | F.col(k).isNull()
    left = (
        rows.join(hot, keys, "left")
        .withColumn("_salt", F.pmod(F.xxhash64(spread), F.when(unmatched, 1 << 20).otherwise(hot_salts)).cast("int"))
        .drop("_hot")
    )
    right = (
        table.join(hot, keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), hot_salts - 1)))
        .drop("_hot")
    )
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def with_each(rows: DataFrame, values: DataFrame, spread: str, size: int = 1000) -> DataFrame:
    """Each row of ``rows`` with each row of ``values`` (levels, sources, models, scopes): the grid that a report asks for.

    ``values`` is written and packed into arrays of about ``size`` rows, so no single row or task holds all of them; every row
    is sent to each block once and unfolds there.
    """
    values = materialize(values)
    blocks = -(-values.count() // size)
    if not blocks:
        return rows.crossJoin(values.limit(0))
    number = F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in values.columns]), F.lit(blocks)).cast("int")
    packed = values.groupBy(number.alias("_block")).agg(F.collect_list(F.struct("*")).alias("_values"))
    sent = rows.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = spread_join(sent, packed, ["_block"], spread)
    return met.select(*rows.columns, F.inline("_values"))

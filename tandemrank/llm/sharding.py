"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tandemrank.llm.common import materialize, number_rows, table
from tandemrank.llm.registry import query

SHARDS, PART_ROWS, MOST_PARTS = 24, 4096, 4096


def hypergeometric(good: int, bad: int, draws: int, u: float) -> int:
    """Quantile ``u`` of the number of good ones among ``draws`` from ``good + bad``, for counts of any size.

    The probabilities follow from their ratios to the mode's; values further from it than 12 standard deviations
    and 64 have together less than 1e-30, below a double's resolution of ``u``.
    """
    n = good + bad
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (n + 2)))
    spread = draws * (good / n) * (bad / n) * ((n - draws) / max(1, n - 1))
    reach = int(12 * spread**0.5) + 64
    low, high = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(low, high, dtype=np.float64)
    ratio = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(n - good - draws + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(ratio)])
    p = np.exp(logs - logs.max())
    c = np.cumsum(p)
    return low + int(np.searchsorted(c, u * c[-1], side="right").clip(0, high - low))


def matrix(rows: list[int], columns: list[int], seed: int) -> np.ndarray:
    """Row counts and column counts to a random table with these margins, as a uniform shuffle gives it."""
    rng, left = np.random.default_rng(seed), list(columns)
    out = np.zeros((len(rows), len(columns)), np.int64)
    for i, n in enumerate(rows):
        rest = sum(left)
        for j, good in enumerate(left):
            rest -= good
            out[i, j] = hypergeometric(good, rest, n, rng.random())
            n -= out[i, j]
            left[j] -= out[i, j]
    return out


def shuffle(df: DataFrame, shards: int = SHARDS, seed: int = 8, part_rows: int = PART_ROWS) -> DataFrame:
    """Deal all rows of ``df`` uniformly into ``shards`` shards whose row counts differ by at most one.

    Returns ``row`` (a struct of all columns of ``df``, whatever their names), ``shard`` (from 0) and ``slot`` (from 0,
    gapless within a shard). The rows are written once with a row number and dealt into source parts; counts of parts
    (at most 4096) go to the driver, which draws how many rows each part sends to each shard. Each part is permuted and
    cut by these counts, and each shard is permuted again, in cells of about ``part_rows`` rows, so no task holds a
    whole shard. Repeated rows, nulls and equal values need no care: only row numbers matter. An empty table stays so.
    Select narrow columns first when texts need not travel.
    """
    spark = df.sparkSession
    rows = number_rows(df)
    n = rows.count()
    parts = max(1, min(MOST_PARTS, -(-n // part_rows)))
    cells = max(1, min(MOST_PARTS, -(-n // (part_rows * shards))))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("rid", F.lit(seed)), F.lit(parts)).cast("int"))
    sent = sorted((r["part"], r["count"]) for r in rows.groupBy("part").count().collect())
    sizes = [n // shards + (j < n % shards) for j in range(shards)]
    cuts = np.cumsum(matrix([c for _, c in sent], sizes, seed), axis=1)
    plan = spark.createDataFrame(
        [(p, c.tolist()) for (p, _), c in zip(sent, cuts)], "part int, cuts array<bigint>"
    )
    local = Window.partitionBy("part").orderBy(F.xxhash64("rid", F.lit(seed + 1)), "rid")
    dealt = (
        rows.withColumn("spot", F.row_number().over(local))
        .join(plan, "part")
        .select(
            "row", "rid", F.size(F.filter("cuts", lambda c: c < F.col("spot"))).alias("shard"),
            F.pmod(F.xxhash64("rid", F.lit(seed + 2)), F.lit(cells)).cast("int").alias("cell"),
        )
    )
    dealt = materialize(dealt)
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy("shard", "cell").count()
        .select("shard", "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    )
    again = Window.partitionBy("shard", "cell").orderBy(F.xxhash64("rid", F.lit(seed + 3)), "rid")
    return (
        dealt.withColumn("spot", F.row_number().over(again))
        .join(starts, ["shard", "cell"])
        .select("row", "shard", (F.col("start") + F.col("spot") - 1).cast("bigint").alias("slot"))
    )


@query("op8_hypergeometric_shuffle")
def op8(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    slim = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 8).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return shuffle(slim).select(
        "row.*", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast(T.IntegerType()).alias("grown_shard")
    )

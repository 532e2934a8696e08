"""Pair, tensor and formula views over the driver tables, in Spark and as SQL text for the check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandemrank.operators.quantile import quantiles
from tandemrank.session import bounded, materialize


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pairs_part(spark: SparkSession, sf: str) -> DataFrame:
    price = (
        table(spark, sf, "lineitem").groupBy("l_partkey")
        .agg(F.round(F.avg(F.col("l_extendedprice") / F.col("l_quantity")), 6).alias("right"))
    )
    return table(spark, sf, "part").join(price, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("grp"), F.col("p_type").alias("stratum"),
        F.col("p_size").cast("double").alias("dist"), F.col("p_retailprice").alias("left"), "right",
    )


def pairs_rev(spark: SparkSession, sf: str) -> DataFrame:
    sums = (
        table(spark, sf, "lineitem").filter(F.col("l_returnflag") != "R").groupBy("l_partkey")
        .agg(
            F.sum("l_quantity").alias("left"),
            F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 6).alias("right"),
        )
    )
    return table(spark, sf, "part").join(sums, F.col("l_partkey") == F.col("p_partkey"), "left").select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("grp"), F.col("p_type").alias("stratum"),
        F.col("p_size").cast("double").alias("dist"), "left", "right",
    )


def pairs_cust(spark: SparkSession, sf: str) -> DataFrame:
    sums = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count("*").cast("double").alias("left"), F.round(F.sum("o_totalprice"), 6).alias("right")
    )
    return table(spark, sf, "customer").join(sums, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("string").alias("grp"),
        F.col("c_mktsegment").alias("stratum"), F.abs("c_acctbal").alias("dist"), "left", "right",
    )


def long_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Both part metrics in long form."""
    return (
        pairs_part(spark, sf).withColumn("metric", F.lit("a"))
        .unionByName(pairs_rev(spark, sf).withColumn("metric", F.lit("b")))
    )


def panel_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Long pairs in nested panels: P0 all, P1 without one stratum, P2 the P1 rows up to P1's median distance."""
    rows = materialize(long_pairs(spark, sf))
    p1 = rows.filter(F.col("stratum") != "ECONOMY")
    med = bounded(quantiles(p1, ["metric"], "dist", "id", {"med": 0.5}))
    p1_flag = F.col("stratum") != "ECONOMY"
    panel = F.array_compact(
        F.array(
            F.lit("P0"), F.when(p1_flag, F.lit("P1")), F.when(p1_flag & (F.col("dist") <= F.col("med")), F.lit("P2"))
        )
    )
    return rows.join(med, "metric").withColumn("panel", F.explode(panel)).drop("med")


def tensors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("label").cast("string").alias("grp"),
        F.slice("embedding", 1, 27).cast("array<double>").alias("t"),
    )


PART = """
pairs_part AS (
  SELECT p.p_partkey AS id, p.p_brand AS grp, p.p_type AS stratum, CAST(p.p_size AS DOUBLE) AS dist,
         p.p_retailprice AS "left", a.r AS "right"
  FROM part p JOIN (SELECT l_partkey, round(avg(l_extendedprice / l_quantity), 6) AS r FROM lineitem
                    GROUP BY l_partkey) a ON a.l_partkey = p.p_partkey)"""
REV = """
pairs_rev AS (
  SELECT p.p_partkey AS id, p.p_brand AS grp, p.p_type AS stratum, CAST(p.p_size AS DOUBLE) AS dist,
         a.q AS "left", a.v AS "right"
  FROM part p LEFT JOIN (SELECT l_partkey, sum(l_quantity) AS q,
                                round(sum(l_extendedprice * (1 - l_discount)), 6) AS v
                         FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_partkey) a ON a.l_partkey = p.p_partkey)"""
CUST = """
pairs_cust AS (
  SELECT c.c_custkey AS id, CAST(c.c_nationkey AS VARCHAR) AS grp, c.c_mktsegment AS stratum,
         abs(c.c_acctbal) AS dist, o.n AS "left", o.v AS "right"
  FROM customer c LEFT JOIN (SELECT o_custkey, CAST(count(*) AS DOUBLE) AS n, round(sum(o_totalprice), 6) AS v
                             FROM orders GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey)"""
LONG = PART + "," + REV + """,
long_pairs AS (SELECT *, 'a' AS metric FROM pairs_part UNION ALL SELECT *, 'b' AS metric FROM pairs_rev)"""
PANELS = LONG + """,
p1_median AS (SELECT metric, quantile_cont(dist, 0.5) AS med FROM long_pairs WHERE stratum <> 'ECONOMY' GROUP BY metric),
panel_pairs AS (
  SELECT *, 'P0' AS panel FROM long_pairs
  UNION ALL SELECT *, 'P1' AS panel FROM long_pairs WHERE stratum <> 'ECONOMY'
  UNION ALL SELECT l.*, 'P2' AS panel FROM long_pairs l JOIN p1_median m USING (metric)
            WHERE stratum <> 'ECONOMY' AND dist <= med)"""
FINITE = '"left" IS NOT NULL AND "right" IS NOT NULL AND NOT isnan("left") AND NOT isnan("right")'


def ranked_sql(source: str, by: str, name: str = "ranked") -> str:
    """Ranked rows: positions (ties by id), tie runs and size per key."""
    return f"""
{name} AS (
  SELECT *, l_first + l_cnt - 1 AS l_last, r_first + r_cnt - 1 AS r_last,
         l_first + (l_cnt - 1) / 2.0 AS l_avg, r_first + (r_cnt - 1) / 2.0 AS r_avg
  FROM (SELECT *, count(*) OVER (PARTITION BY {by}) AS n,
               row_number() OVER (PARTITION BY {by} ORDER BY "left" DESC, id) AS l_pos,
               row_number() OVER (PARTITION BY {by} ORDER BY "right" DESC, id) AS r_pos,
               rank() OVER (PARTITION BY {by} ORDER BY "left" DESC) AS l_first,
               rank() OVER (PARTITION BY {by} ORDER BY "right" DESC) AS r_first,
               count(*) OVER (PARTITION BY {by}, "left") AS l_cnt,
               count(*) OVER (PARTITION BY {by}, "right") AS r_cnt
        FROM {source} WHERE {FINITE}))"""


def log_choose(n: str, k: str) -> str:
    return f"(lgamma({n} + 1.0) - lgamma({k} + 1.0) - lgamma({n} - {k} + 1.0))"


def null_sql(source: str, name: str = "nulls") -> str:
    """Exact null per distinct (n, k): E[J], and the probabilities themselves as ``pmf(n, k, x, p)``."""
    pmf = f"exp({log_choose('k', 'x')} + {log_choose('(n - k)', '(k - x)')} - {log_choose('n', 'k')})"
    return f"""
{name}_pmf AS (
  SELECT n, k, x, {pmf} AS p
  FROM (SELECT n, k, unnest(range(greatest(0, 2 * k - n), k + 1)) AS x FROM (SELECT DISTINCT n, k FROM {source}))),
{name} AS (SELECT n, k, sum(p * x / (2.0 * k - x)) / sum(p) AS ej FROM {name}_pmf GROUP BY n, k)"""


def curve_sql(by: str, ranked: str = "ranked", qs: str = "range(1, 51)", name: str = "curve") -> str:
    """Overlap curve with exact null from ranked rows."""
    return f"""
{name}_counts AS (
  SELECT {by}, q, n, k, count(*) FILTER (WHERE greatest(l_pos, r_pos) <= k) AS overlap,
         avg(abs(l_avg - r_avg)) FILTER (WHERE least(l_pos, r_pos) <= k) AS mean_shift,
         median(abs(l_avg - r_avg)) FILTER (WHERE least(l_pos, r_pos) <= k) AS median_shift
  FROM (SELECT *, CAST(greatest(1, floor(q / 100.0 * n)) AS BIGINT) AS k
        FROM {ranked}, (SELECT CAST(unnest({qs}) AS DOUBLE) AS q))
  GROUP BY {by}, q, n, k),{null_sql(name + '_counts', name + '_null')},
{name} AS (
  SELECT c.*, ej, overlap / (2.0 * k - overlap) AS j,
         (overlap / (2.0 * k - overlap) - ej) / (1.0 - ej) AS adj
  FROM {name}_counts c JOIN {name}_null USING (n, k))"""

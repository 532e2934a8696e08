"""Nearest neighbours by collision counting over query-centred windows of sorted projections."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tandemrank.llm.common import materialize, table
from tandemrank.llm.registry import query

PROJECTIONS, WIDTH, RATIO = 96, 0.25, 1.25
SHARE = 0.64  # collision threshold, as a share of the projections
AT_LEAST, FLOOR = 0.12, 256  # vectors to verify: as a share of a block, and in any case
BLOCK, QUERY_BLOCK = 8192, 1024


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(id, v)`` with finite, non-null, non-zero components; rows with a null id take no part. Repeated rows count once."""
    c = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return (
        vectors.select(F.col(id_col).cast("bigint").alias("id"), c.alias("v"))
        .filter(F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", ok) & F.exists("v", lambda x: x != 0))
        .distinct()
    )


def directions(dim: int, count: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((count, dim))


def search_block(q: np.ndarray, x: np.ndarray, k: int, count: int = PROJECTIONS, seed: int = 1) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each row of ``q`` the candidates among the rows of ``x`` (both of unit length) and their cosines.

    Each projection is one sorted array. A query's window on it is centred on the query's own value and widened by
    RATIO a round (virtual rehashing); a vector inside at least SHARE of the windows has collided often enough and is
    verified. The rounds end once FLOOR are verified and k of them lie within the current radius, or at least
    max(k, FLOOR, AT_LEAST of the block) were verified; windows over everything end them at the latest.
    """
    a = directions(x.shape[1], count, seed)
    px, pq = x @ a.T, q @ a.T
    order = np.argsort(px, axis=0, kind="stable")
    value = np.take_along_axis(px, order, axis=0).T.copy()
    order = order.T.copy()
    n, need = len(x), int(np.ceil(SHARE * count))
    enough, least = max(k, FLOOR, int(AT_LEAST * n)), min(k, n)
    out: list = [None] * len(q)
    waiting, radius = np.arange(len(q)), WIDTH
    hits = np.zeros((len(q), n), np.uint16)
    low = high = np.stack([np.searchsorted(v, pq[:, j]) for j, v in enumerate(value)], axis=1)
    while len(waiting):
        lo = np.stack([np.searchsorted(v, pq[waiting, j] - radius) for j, v in enumerate(value)], axis=1)
        hi = np.stack([np.searchsorted(v, pq[waiting, j] + radius, side="right") for j, v in enumerate(value)], axis=1)
        more = []
        for w, i in enumerate(waiting):
            grown = [o[s:e] for o, s, e in zip(order, lo[w], low[w])] + [o[s:e] for o, s, e in zip(order, high[w], hi[w])]
            hits[i] += np.bincount(np.concatenate(grown), minlength=n).astype(np.uint16)
            found = np.flatnonzero(hits[i] >= need)
            whole = not lo[w].any() and (hi[w] == n).all()
            if whole or len(found) >= least:
                cos = x[found] @ q[i]
                near = len(found) >= enough or len(found) >= FLOOR and np.count_nonzero(cos >= 1 - radius * radius / 2) >= least
                if whole or near:
                    out[i] = (found, cos)
                    continue
            more.append(w)
        waiting, low, high, radius = waiting[more], lo[more], hi[more], radius * RATIO
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str, vec_col: str) -> DataFrame:
    """``query_id, rank, vec_id, score``: of each query vector its ``k`` nearest found by cosine, never a row of its own id.

    Equal vectors are one index entry with their k + 1 smallest ids, which is all that can be reported, so a hot vector
    costs nothing. Entries are dealt by hash into blocks of about BLOCK, queries into blocks of about QUERY_BLOCK; each
    pair of blocks is one bounded group that searches its own sorted projections, and a window keeps the best k over
    the blocks. Vectors of another length than the query's never meet. Ties go to the smaller id. Unusable vectors
    (null, empty, zero, with null or non-finite components) and null ids take no part; several vectors of one query id
    are searched together and a reported id keeps its best score; an empty table gives no row.
    """
    top = Window.partitionBy("v").orderBy("id")
    entries = (
        usable(vectors, id_col, vec_col).withColumn("nth", F.row_number().over(top)).filter(F.col("nth") <= k + 1)
        .groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    )
    entries = materialize(entries)
    asked = materialize(usable(queries, id_col, vec_col))
    n, m = entries.count(), asked.count()
    blocks, rounds = max(1, -(-n // BLOCK)), max(1, -(-m // QUERY_BLOCK))
    left = entries.select(
        F.pmod(F.xxhash64("v"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round"),
        F.size("v").alias("dim"), "v", "ids",
    )
    right = asked.select(
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("block"),
        F.pmod(F.xxhash64("id", "v"), F.lit(rounds)).cast("int").alias("round"), F.size("v").alias("dim"), "v", "id",
    )

    def run(x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple[int, int, float]] = []
        if len(x) and len(q):
            raw, asks = np.stack(x["v"].to_numpy()), np.stack(q["v"].to_numpy())
            unit = lambda a: (a / np.abs(a).max(axis=1, keepdims=True)) / np.linalg.norm(a / np.abs(a).max(axis=1, keepdims=True), axis=1, keepdims=True)
            unit_x, unit_q = unit(raw), unit(asks)
            ids = x["ids"].tolist()
            for qid, (found, cos) in zip(q["id"], search_block(unit_q, unit_x, k + 1)):
                best, worst = np.argsort(-cos, kind="stable"), None
                kept: list[tuple[float, int]] = []
                for j in best:
                    if worst is not None and cos[j] < worst:
                        break
                    kept += [(-float(cos[j]), int(v)) for v in ids[found[j]] if v != qid]
                    if len(kept) >= k and worst is None:
                        worst = cos[j]
                rows += [(int(qid), v, -c) for c, v in sorted(kept)[:k]]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

    keys = ["block", "round", "dim"]
    got = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, "query_id bigint, vec_id bigint, score double")
    got = got.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return got.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


@query("op1_collision_counting")
def op1(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter(F.col("vec_id") % 50 == 0), 5, "vec_id", "embedding")

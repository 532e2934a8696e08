"""Exact Kendall tau-b of any number of pairs, optionally weighted by multiplicity.

tau-b needs the discordant pairs and the ties. Ties are value counts. Discordant pairs are split over blocks of
neighbouring values: those inside one left block, those inside one right block but different left blocks, and those
apart on both sides. The last kind is the same question on block ids with cell counts as weights, so the table
shrinks and the same two steps repeat until the cells fit one task. No task ever holds more than a few blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandemrank.frame import finite_pairs
from tandemrank.functions.null_model import normal_two_sided
from tandemrank.operators.rank import tie_ranks
from tandemrank.session import materialize

# Rows one task may hold. An executor runs several tasks, each with its columns, their codes and sorted copies in Python.
TASK_ROWS = 1 << 17


def discordant(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Total weight of pairs with x rising and y falling; ties on either side do not count.

    Rows are put in (x, y) order; then, bit by bit from the top of y's rank, each row with a 0 bit is preceded
    inside its group by some rows with a 1 bit, and those are its discordant partners at that bit.
    """
    order = np.lexsort((y, x))
    code = np.unique(y, return_inverse=True)[1][order].astype(np.int64)
    w = w[order].astype(np.float64)
    total = 0.0
    for bit in range(int(code.max(initial=0)).bit_length() - 1, -1, -1):
        one = (code >> bit) & 1
        group = code >> (bit + 1)
        ones = np.concatenate(([0.0], np.cumsum(w * one)))[:-1]
        start = np.concatenate(([True], group[1:] != group[:-1]))
        ahead = ones - np.repeat(ones[start], np.diff(np.append(np.flatnonzero(start), len(group))))
        total += float(np.dot(w * (1 - one), ahead))
        move = np.argsort(code >> bit, kind="stable")
        code, w = code[move], w[move]
    return total


def tie_weight(values: np.ndarray, w: np.ndarray) -> float:
    """Pairs of copies that share a value: sum of c (c - 1) / 2 over the total weight c of each value."""
    c = np.bincount(np.unique(values, return_inverse=True)[1], weights=w)
    return float(np.sum(c * (c - 1.0) / 2.0))


def _by_schema(rows: DataFrame, by: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*by).schema)


SUMS = ["n", "ties_left", "ties_right", "ties_both", "discordant"]


def _subsets(pdf: pd.DataFrame, nested: bool) -> list[tuple[list, np.ndarray | slice]]:
    """Key values and rows of the sets to count: all rows, or both sides of every step of the nested sets."""
    if not nested:
        return [([], slice(None))]
    c, steps = pdf["_c"].to_numpy(), int(pdf["_m"].iloc[0])
    return [([j, inside], np.flatnonzero((c <= j) == inside)) for j in range(steps) for inside in (True, False)]


def _parts_schema(df: DataFrame, by: list[str], nested: bool) -> str:
    own = ["_j int", "_in boolean"] if nested else []
    return ", ".join([_by_schema(df, by), *own, *(f"{c} double" for c in SUMS)])


def _count(rows: DataFrame, by: list[str], group: list[str], x: str, y: str, side: str = "", nested: bool = False) -> DataFrame:
    """Sums of each group of rows: discordant pairs and what ``side`` says: the ties of a left block (equal pairs lie in one),
    those of a right block, or the size."""

    def kernel(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        x, y, w = (pdf[c].to_numpy() for c in ("_x", "_y", "_w"))
        for subset, at in _subsets(pdf, nested):
            xs, ys, ws = x[at], y[at], w[at]
            left, right, both = side == "left", side == "right", side == "left" and _pair(xs, ys)
            out.append((
                *key[: len(by)], *subset, float(ws.sum()) if side == "size" else 0.0, tie_weight(xs, ws) if left else 0.0,
                tie_weight(ys, ws) if right else 0.0, tie_weight(both, ws) if left else 0.0, discordant(xs, ys, ws),
            ))
        return pd.DataFrame(out, columns=names)

    names = [*by, *(["_j", "_in"] if nested else []), *SUMS]
    own = ["_c", "_m"] if nested else []
    slim = rows.select(*by, *group, *own, F.expr(x).alias("_x"), F.expr(y).alias("_y"), "_w")
    return slim.groupBy(*by, *group).applyInPandas(kernel, _parts_schema(rows, by, nested))


def _pair(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.unique(x, return_inverse=True)[1] * (len(y) + 1) + np.unique(y, return_inverse=True)[1]


def _small_parts(df: DataFrame, by: list[str], nested: bool) -> DataFrame:
    """All counts of keys that each fit one task, in one shuffle."""

    def kernel(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        every = [pdf[c].to_numpy(dtype=np.float64) for c in ("left", "right", "_w")]
        for subset, at in _subsets(pdf, nested):
            x, y, w = (v[at] for v in every)
            ties = tie_weight(x, w), tie_weight(y, w), tie_weight(_pair(x, y), w)
            out.append((*key, *subset, float(w.sum()), *ties, discordant(x, y, w)))
        return pd.DataFrame(out, columns=names)

    names = [*by, *(["_j", "_in"] if nested else []), *SUMS]
    own = ["_c", "_m"] if nested else []
    slim = df.select(*by, *own, F.col("left").cast("double"), F.col("right").cast("double"), "_w")
    return slim.groupBy(*by).applyInPandas(kernel, _parts_schema(df, by, nested))


def _heavy_ties(df: DataFrame, by: list[str], values: list[str], out: str, nested: bool) -> DataFrame:
    """Tied pairs of rows that no block gathers, added up by value."""
    key = [*by, "_j", "_in"] if nested else by
    cells = df.groupBy(*by, *values, *(["_c", "_m"] if nested else [])).agg(F.sum("_w").alias("_w"))
    if nested:
        cells = cells.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_m") - 1))).withColumn("_in", F.expr("_c <= _j"))
        cells = cells.groupBy(*key, *values).agg(F.sum("_w").alias("_w"))
    v = F.col("_w")
    sums = cells.groupBy(*key).agg(F.sum(v * (v - 1) / 2).alias("_t"))
    return sums.select(*key, *[F.col("_t").alias(c) if c == out else F.lit(0.0).alias(c) for c in SUMS])


def value_blocks(df: DataFrame, by: list[str], id: str = "id", size: int = TASK_ROWS) -> DataFrame:
    """Add block ids ``_bl`` and ``_br`` of neighbouring values and flags for blocks of one repeated value.

    Equal values share a block. A value with more than ``size`` rows gets a block of its own (an odd id), which
    holds no discordant pair of its side and is never gathered; every other block has at most twice ``size`` rows.
    """
    df = tie_ranks(df, by, "left", id, "l", count="_n1")
    df = tie_ranks(df, by, "right", id, "r", count="_n2").drop("_n1", "_n2")
    for s in ("l", "r"):
        heavy = F.col(f"{s}_last") - F.col(f"{s}_first") + 1 > size
        df = df.withColumn(f"_h{s}", heavy).withColumn(
            f"_b{s}", F.floor((F.col(f"{s}_first") - 1) / F.lit(size)) * 2 + heavy.cast("bigint")
        )
    return df


def with_blocks(df: DataFrame, by: list[str], id: str = "id", size: int = TASK_ROWS) -> tuple[DataFrame, int]:
    """``df``, written with the columns of ``value_blocks`` if a key has over ``size`` rows, and the rows of the largest key.

    Replicates and subsets of the rows keep these blocks, so that scores are sorted once and not once per replicate.
    """
    largest = df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    if largest > size:
        df = materialize(value_blocks(df, by, id, size).select(*df.columns, "_bl", "_br", "_hl", "_hr"))
    return df, largest


def kendall_parts(
    df: DataFrame, by: list[str], id: str = "id", weight: str | None = None, size: int = TASK_ROWS,
    largest: int | None = None, nested: bool = False,
) -> DataFrame:
    """Per key: ``pairs``, ``ties_left``, ``ties_right``, ``ties_both`` and ``discordant`` as doubles.

    ``weight`` is a multiplicity: a row of weight w stands for w equal copies. If ``df`` already carries block
    columns from ``value_blocks`` (of the unweighted rows, at the same ``size``) they are reused. ``largest`` is an
    upper bound on the rows of a key, if the caller knows one; otherwise the keys are counted first.

    With ``nested`` a key has ``_m`` nested sets, the j-th of which holds its rows of ``_c`` <= j, and is counted for every
    set (``_j``) and its complement (``_in``); rows are shuffled once for all of them.
    """
    df = finite_pairs(df)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    df = df.withColumn("_w", w)
    blocked = "_bl" in df.columns
    if not blocked:
        if largest is None:
            largest = df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
        if largest <= size:
            return _with_pairs(_small_parts(df, by, nested))
        df = value_blocks(df, by, id, size)
    own = ["_c", "_m"] if nested else []

    parts = [
        _count(df.filter(~F.col("_hl")), by, ["_bl"], "`left`", "`right`", "left", nested),
        # block ids run against the values
        _count(df.filter(~F.col("_hr")), by, ["_br"], "-_bl", "`right`", "right", nested),
        _heavy_ties(df.filter("_hl"), by, ["left"], "ties_left", nested),
        _heavy_ties(df.filter("_hl"), by, ["left", "right"], "ties_both", nested),
        _heavy_ties(df.filter("_hr"), by, ["right"], "ties_right", nested),
    ]
    cells = df.groupBy(*by, "_bl", "_br", *own).agg(F.sum("_w").alias("_w"))
    if largest is None:
        top = df.select(F.max("_bl"), F.max("_br")).first()
        blocks = max(top[0] or 0, top[1] or 0) + 1
    else:
        blocks = (largest - 1) // size * 2 + 2
    while blocks * blocks > 4 * size:
        # Super-blocks of neighbouring blocks, each with at most ``size`` cells.
        factor = max(2, size // blocks)
        cells = cells.withColumn("_sl", F.floor(F.col("_bl") / factor)).withColumn(
            "_sr", F.floor(F.col("_br") / factor)
        )
        parts += [
            _count(cells, by, ["_sl"], "_bl", "_br", "", nested), _count(cells, by, ["_sr"], "_sl", "_br", "", nested)
        ]
        cells = cells.groupBy(*by, F.col("_sl").alias("_bl"), F.col("_sr").alias("_br"), *own).agg(F.sum("_w").alias("_w"))
        blocks = blocks // factor + 1
    parts.append(_count(cells, by, [], "_bl", "_br", "size", nested))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    key = [*by, "_j", "_in"] if nested else by
    return _with_pairs(out.groupBy(*key).agg(*[F.sum(c).alias(c) for c in SUMS]))


def _with_pairs(sums: DataFrame) -> DataFrame:
    """Sums of keys and sets that have rows, with the number of pairs."""
    return sums.filter("n > 0").withColumn("pairs", F.expr("n * (n - 1) / 2"))


def tau_from_parts(parts: DataFrame, out: str = "tau") -> DataFrame:
    c = F.col
    num = c("pairs") - c("ties_left") - c("ties_right") + c("ties_both") - 2 * c("discordant")
    den = F.sqrt(c("pairs") - c("ties_left")) * F.sqrt(c("pairs") - c("ties_right"))
    return parts.withColumn(out, F.when(den > 0, num / den))


def kendall_tau(
    df: DataFrame, by: list[str], id: str = "id", weight: str | None = None, size: int = TASK_ROWS, out: str = "tau",
    largest: int | None = None, nested: bool = False,
) -> DataFrame:
    """Per key (and nested set, see ``kendall_parts``): ``n`` and tau-b (null where a side is constant)."""
    parts = tau_from_parts(kendall_parts(df, by, id, weight, size, largest, nested), out)
    return parts.select(*by, *(["_j", "_in"] if nested else []), F.col("n").cast("bigint").alias("n"), out)


def kendall_test(df: DataFrame, by: list[str], id: str = "id", size: int = TASK_ROWS) -> DataFrame:
    """tau-b with its tie-corrected normal approximation p-value; null for two pairs or fewer and for a constant side."""
    df = finite_pairs(df)
    sums = None
    for side in ("left", "right"):
        t = F.col("_t").cast("double")
        part = df.groupBy(*by, side).agg(F.count("*").alias("_t")).groupBy(*by).agg(
            F.sum(t * (t - 1) * (2 * t + 5)).alias(f"_v_{side}"),
            F.sum(t * (t - 1) * (t - 2)).alias(f"_w_{side}"),
        )
        sums = part if sums is None else sums.join(part, by)
    c = F.col
    parts = tau_from_parts(kendall_parts(df, by, id, None, size)).join(sums, by)
    n, m = c("n"), c("pairs") * 2
    var = (
        (m * (2 * n + 5) - c("_v_left") - c("_v_right")) / 18
        + F.try_divide(2 * c("ties_left") * c("ties_right"), m)
        + F.try_divide(c("_w_left") * c("_w_right"), 9 * m * (n - 2))
    )
    num = c("pairs") - c("ties_left") - c("ties_right") + c("ties_both") - 2 * c("discordant")
    return parts.withColumn("pvalue", normal_two_sided(F.try_divide(num, F.sqrt(F.when(var > 0, var))))).select(
        *by, n.cast("bigint").alias("n"), "tau", "pvalue"
    )

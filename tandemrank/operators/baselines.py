"""Baseline predictions for every pair of training and evaluation source: zero, group means and keyed ridge regressions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandemrank.functions import tensors as fn
from tandemrank.operators.models import _solve, error_summary, group_mean_baseline, zero_baseline
from tandemrank.operators.pairing import distance_histogram
from tandemrank.session import bounded, materialize, with_each

KEY = ["train_source", "eval_source", "split", "seed"]
POOLED = "pooled"
# Gram matrices that a task may hold before it hands them on, in numbers; test rows of one key that meet in a task.
HELD_NUMBERS, TASK_ROWS = 8_000_000, 20_000


def distance_features(
    points: DataFrame, id: str, order: str, axes: Sequence[str], bins: int = 20, top: float = 10.0, out: str = "distances"
) -> DataFrame:
    """``id`` and the array of its pair distances' shares per bin, for ids with points; see ``distance_histogram``."""
    shares = distance_histogram(points, [id], order, axes, bins, top)
    return shares.groupBy(id).agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "share"))), lambda s: s["share"]).alias(out))


def with_distance_features(records: DataFrame, features: DataFrame, id: str, x: str, bins: int = 20, out: str = "distances") -> DataFrame:
    """Append distance shares to the feature vector ``x``; records without points get zeros."""
    rows = records.join(features.withColumnRenamed(out, "_d").hint("merge"), id, "left")
    return rows.withColumn(x, F.concat(x, F.coalesce("_d", F.array_repeat(F.lit(0.0), bins)))).drop("_d")


def with_token(records: DataFrame, source: str, sources: Sequence[str], x: str, out: str) -> DataFrame:
    """``out``: the vector ``x`` with a 1 for the row's source among ``sources`` and 0 for the others."""
    token = [F.when(F.col(source) == F.lit(s), 1.0).otherwise(0.0) for s in sources]
    return records.withColumn(out, F.concat(x, F.array(*token)))


def training_grams(rows: DataFrame, model: str, source: str, tests: str, x: str, y: str) -> DataFrame:
    """``model, train_source, part, i, row``: sums of [1 x]'[1 x | y], of all rows (part -1) and of each seed's test rows.

    ``tests`` is the array of the seeds whose test fold holds the row. Each row is read once; sums over all sources are
    added up under "pooled" on the way. A task hands on what it holds after HELD_NUMBERS numbers; the parts of one
    matrix row meet in one task.
    """

    def partial(batches):
        held: dict = {}

        def out():
            pooled: dict = {}
            for (name, _, part), g in held.items():
                pooled[name, POOLED, part] = pooled.get((name, POOLED, part), 0.0) + g
            for (name, s, part), g in [*held.items(), *pooled.items()]:
                yield pd.DataFrame({"model": name, "train_source": s, "part": part, "i": range(len(g)), "row": list(g)})
            held.clear()

        for b in batches:
            seeds = [set(map(int, s)) for s in b[tests]]
            for (name, s), at in b.groupby([model, source], sort=False).indices.items():
                m = np.stack([np.asarray(v, np.float64) for v in b[x].iloc[at]])
                m = np.concatenate((np.ones((len(m), 1)), m), axis=1)
                both = np.concatenate((m, np.stack([np.asarray(v, np.float64) for v in b[y].iloc[at]])), axis=1)
                parts: dict[int, list[int]] = {-1: list(range(len(at)))}
                for k, row in enumerate(at):
                    for seed in seeds[row]:
                        parts.setdefault(seed, []).append(k)
                for part, own in parts.items():
                    held[name, s, part] = held.get((name, s, part), 0.0) + m[own].T @ both[own]
                if sum(g.size for g in held.values()) > HELD_NUMBERS:
                    yield from out()
        yield from out()

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum(np.stack([np.asarray(v, np.float64) for v in pdf["row"]]), axis=0)
        return pd.DataFrame({"model": [key[0]], "train_source": [key[1]], "part": [key[2]], "i": [key[3]], "row": [total]})

    schema = "model string, train_source string, part int, i int, row array<double>"
    slim = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(source).isNotNull())
    parts = slim.select(model, F.col(source).cast("string").alias(source), tests, x, y).mapInPandas(partial, schema)
    return parts.groupBy("model", "train_source", "part", "i").applyInPandas(add, schema)


def keyed_weights(grams: DataFrame, seeds: Sequence[int], alpha: float) -> DataFrame:
    """``model, train_source, seed, n_train, width, beta``: ridge weights of the rows outside each seed's test fold.

    The training sums are all sums less those of the test fold. Sources without training rows have no weights.
    """

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        parts = {p: np.stack([np.asarray(r, np.float64) for r in g.sort_values("i")["row"]]) for p, g in pdf.groupby("part")}
        out = []
        for seed in seeds:
            g = parts[-1] - parts.get(seed, 0.0)
            if round(g[0, 0]) > 0:
                out.append((*key, seed, round(g[0, 0]), len(g), _solve(g, len(g), alpha).ravel()))
        return pd.DataFrame(out, columns=["model", "train_source", "seed", "n_train", "width", "beta"])

    return grams.groupBy("model", "train_source").applyInPandas(solve, "model string, train_source string, seed int, n_train bigint, width int, beta array<double>")


def ridge_predictions(test: DataFrame, weights: DataFrame, x: str, y: str, size: int) -> DataFrame:
    """``model, train_source, eval_source, split, seed, y, pred`` for test rows whose training source has weights.

    Rows and weights meet by key; a key's rows are dealt to as many parts as TASK_ROWS asks for, so weights are copied once
    a part and never once a row.
    """
    rows = test.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select("model", *KEY, x, y)
    most = rows.groupBy("model", "train_source", "seed").count().agg(F.max("count")).first()[0] or 0
    parts = max(1, -(-most // TASK_ROWS))
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(x, y), F.lit(parts).cast("bigint")))
    keyed = weights.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))))

    def apply(key: tuple, own: pd.DataFrame, w: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(w):
            return pd.DataFrame({c: [] for c in ["model", *KEY, y, "pred"]})
        beta = np.asarray(w["beta"].iloc[0], np.float64).reshape(int(w["width"].iloc[0]), size)
        m = np.stack([np.asarray(v, np.float64) for v in own[x]])
        return own[["model", *KEY, y]].assign(pred=list(beta[0] + m @ beta[1:]))

    by = ["model", "train_source", "seed", "_part"]
    schema = f"model string, train_source string, eval_source string, split string, seed int, `{y}` array<double>, pred array<double>"
    return rows.groupBy(*by).cogroup(keyed.groupBy(*by)).applyInPandas(apply, schema)


def baseline_matrix(
    records: DataFrame, id: str, source: str, group: str, t: str, folds: Sequence[int], fold_text: str, size: int = 27,
    ridges: dict[str, str] | None = None, alpha: float = 1.0,
) -> DataFrame:
    """Metrics of the baselines for every (train source, eval source, split, seed); each seed's test fold is held out.

    Zero, group mean and source-specific group mean, and for each of ``ridges`` (model name: feature column) a ridge
    regression fitted for every training source and seed from one pass of Gram sums; three-index tensors (27
    components) are symmetrised as the reference table has them. Rows without features take no part in a ridge.
    Sources are a table that meets the test rows in blocks, so their number is not bounded; "pooled" trains on all.
    """
    ridges = ridges or {}
    records = materialize(records.withColumn("_s", F.col(source).cast("string")))
    seeds = ", ".join(str(s) for s in folds)
    held = f"filter(array({seeds}), seed -> {fold_text})"
    marked = records.selectExpr("*", f"{held} AS _tests")
    seeded = marked.selectExpr("*", f"explode(array({seeds})) AS seed")
    train = seeded.filter("NOT array_contains(_tests, seed)").select(group, t, "seed", F.explode(F.array("_s", F.lit(POOLED))).alias("train_source"))
    own = seeded.filter("NOT array_contains(_tests, seed)").select(group, t, "seed", F.col("_s").alias("eval_source"))
    sources = records.select(F.col("_s").alias("train_source")).filter("_s IS NOT NULL").distinct()
    sources = sources.union(records.sparkSession.createDataFrame([(POOLED,)], "train_source string"))
    test = marked.selectExpr("*", "explode(_tests) AS seed").select(
        id, group, t, *dict.fromkeys(ridges.values()), F.col("seed").cast("int").alias("seed"), F.col("_s").alias("eval_source")
    )
    test = with_each(test, sources, id).withColumn(
        "split", F.expr(f"CASE WHEN train_source = '{POOLED}' THEN 'pooled' WHEN train_source = eval_source THEN 'in_source' ELSE 'held_out' END")
    )
    parts = {
        "zero": zero_baseline(test, size),
        "group_mean": group_mean_baseline(train, test, ["train_source", "seed"], group, t, size),
        "source_group_mean": group_mean_baseline(own, test, ["eval_source", "seed"], group, t, size).filter(f"train_source = '{POOLED}'"),
    }
    out = None
    for name, pred in parts.items():
        part = error_summary(pred, KEY, t, "pred").withColumn("model", F.lit(name))
        out = part if out is None else out.unionByName(part)
    if ridges:
        each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(x).alias("x")) for m, x in ridges.items()]))
        unfold = lambda df: df.withColumn("_m", each).withColumns({"model": F.col("_m.model"), "_x": F.col("_m.x")}).drop("_m")
        grams = training_grams(unfold(marked.drop("model")), "model", "_s", "_tests", "_x", t)
        pred = ridge_predictions(unfold(test), keyed_weights(grams, list(folds), alpha), "_x", t, size)
        pred = pred.withColumn("pred", F.expr(fn.symmetrize("pred"))) if size == 27 else pred
        out = out.unionByName(error_summary(pred, ["model", *KEY], t, "pred"))
    n_train = train.groupBy("train_source", "seed").agg(F.expr("count(*) AS n_train"))
    return out.join(bounded(n_train), ["train_source", "seed"], "left")

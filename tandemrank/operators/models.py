"""Baselines, error metrics, leaderboards, gap-to-error ratios, calibration and regression on feature vectors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandemrank.functions import tensors as fn
from tandemrank.operators.quantile import ascending, quantile_at, quantiles
from tandemrank.operators.resample import bootstrap_means, bootstrap_medians, percentile_ci
from tandemrank.session import bounded, materialize, with_each

KEY = ["model", "train_source", "eval_source", "split"]


def prediction_errors(df: DataFrame, y: str, pred: str) -> DataFrame:
    """Per row: absolute and normalised norm error, component MAE, cosine and amplitude ratio."""
    mae = f"aggregate(zip_with({y}, {pred}, (a, b) -> abs(a - b)), 0D, (s, x) -> s + x) / size({y})"
    return df.selectExpr(
        "*", f"{fn.diff_norm(y, pred)} AS absolute_error", f"{fn.normalized_difference(y, pred)} AS normalized_error",
        f"{mae} AS component_mae", f"{fn.cosine(y, pred)} AS cosine", f"{fn.amplitude_ratio(y, pred)} AS amplitude_ratio",
    )


ERRORS = ["absolute_error", "normalized_error", "component_mae", "cosine", "amplitude_ratio"]


def error_summary(df: DataFrame, by: list[str], y: str, pred: str) -> DataFrame:
    return prediction_errors(df, y, pred).groupBy(*by).agg(
        F.expr("count(*) AS n_test"), *[F.expr(f"avg({e}) AS {e}") for e in ERRORS]
    )


def vector_mean(df: DataFrame, by: list[str], t: str, size: int, out: str) -> DataFrame:
    """Component-wise mean of an array column per key, combined map-side."""
    sums = df.groupBy(*by).agg(*[F.avg(F.col(t)[i]).alias(f"_{i}") for i in range(size)])
    return sums.select(*by, F.array(*[F.col(f"_{i}") for i in range(size)]).alias(out))


def ensemble(df: DataFrame, id: str, pred: str, size: int) -> DataFrame:
    """Mean and population deviation of predictions over seeds, per component."""
    agg = df.groupBy(id).agg(
        *[F.avg(F.col(pred)[i]).alias(f"_m{i}") for i in range(size)],
        *[F.stddev_pop(F.col(pred)[i]).alias(f"_s{i}") for i in range(size)],
    )
    pack = lambda c: F.array(*[F.col(f"_{c}{i}") for i in range(size)])
    return agg.select(id, pack("m").alias("pred_mean"), pack("s").alias("pred_std"))


def zero_baseline(test: DataFrame, size: int = 27) -> DataFrame:
    return test.withColumn("pred", F.expr(f"array_repeat(0D, {size})"))


def group_mean_baseline(
    train: DataFrame, test: DataFrame, by: list[str], group: str, t: str, size: int = 27
) -> DataFrame:
    """Mean training vector of the row's group (inside ``by``); a group without training rows gets zeros."""
    means = vector_mean(train, [*by, group], t, size, "_mean")
    rows = test.join(bounded(means), [*by, group], "left")
    return rows.selectExpr(*[f"`{c}`" for c in test.columns], f"coalesce(_mean, array_repeat(0D, {size})) AS pred")


def leaderboard(metrics: DataFrame) -> DataFrame:
    """By model, sources and split: seeds, sizes of the first seed, means and sample deviations."""
    return metrics.groupBy(*KEY).agg(
        F.expr("count(DISTINCT seed) AS n_seeds"), F.expr("min_by(n_train, seed) AS n_train"),
        F.expr("min_by(n_test, seed) AS n_test"), F.expr("avg(absolute_error) AS absolute_mean"),
        F.expr("stddev_samp(absolute_error) AS absolute_std"), F.expr("avg(normalized_error) AS normalized_mean"),
        F.expr("avg(component_mae) AS component_mean"), F.expr("avg(cosine) AS cosine_mean"),
    )


def rank_inversion(board: DataFrame) -> DataFrame:
    """In-source against held-out error per model and evaluation source; errors equal up to rounding are no inversion."""
    pick = "max(IF(split = '{s}', absolute_mean, NULL)) AS {a}"
    return board.groupBy("model", "eval_source").agg(
        F.expr(pick.format(s="in_source", a="in_source_mae")), F.expr(pick.format(s="held_out", a="held_out_mae"))
    ).filter("in_source_mae IS NOT NULL AND held_out_mae IS NOT NULL").selectExpr(
        "*", "held_out_mae / (in_source_mae + 1e-12D) AS degradation_ratio", "held_out_mae > in_source_mae + 1e-12D AS rank_inversion"
    )


def paired_gain(board: DataFrame, base: str, other: str) -> DataFrame:
    """Error of two models on the same (evaluation source, split) and their difference."""
    pick = "max(IF(model = '{m}', absolute_mean, NULL)) AS {a}"
    return board.groupBy("train_source", "eval_source", "split").agg(
        F.expr(pick.format(m=base, a="base_mae")), F.expr(pick.format(m=other, a="other_mae"))
    ).filter("base_mae IS NOT NULL AND other_mae IS NOT NULL").selectExpr("*", "base_mae - other_mae AS improvement")


def valid_models(board: DataFrame, baselines: Sequence[str]) -> DataFrame:
    """In-source rows whose mean error is below that of every named baseline on the same (evaluation source, split)
    by more than rounding."""
    names = ", ".join(f"'{b}'" for b in baselines)
    floor = board.filter(f"model IN ({names})").groupBy("eval_source", "split").agg(F.expr("min(absolute_mean) AS _floor"))
    return board.join(floor, ["eval_source", "split"], "left").selectExpr(
        *[f"`{c}`" for c in board.columns],
        "split = 'in_source' AND absolute_mean < coalesce(_floor, double('inf')) - 1e-12D AS valid",
    )


def gap_ratios(
    errors: DataFrame, gaps: DataFrame, reps: int, seed: int, id: str = "id", valid: DataFrame | None = None
) -> DataFrame:
    """Ratios of paired gaps to model errors per (model, train_source, scope), with both sides resampled.

    ``errors``: model, train_source, unit (unique per model and source, such as source and seed), absolute_error,
    normalized_error. ``gaps``: scope, id, gap. ``valid`` (model, train_source) keeps the named models alone. Replicate b of
    a ratio divides replicate b of the gaps (stream ``seed``) by replicate b of that model's errors (stream ``seed + 1``):
    means by means, medians by medians, so an interval carries the spread of both. Missing errors and gaps
    are left out; a model without an error or a scope without a gap has no row. Only means and medians per
    replicate meet, never rows; models and scopes are tables of any length.
    """
    by = ["model", "train_source", "kind"]
    if valid is not None:
        errors = errors.join(bounded(valid.select("model", "train_source").distinct()), ["model", "train_source"], "left_semi")
    kinds = "stack(2, 'absolute', double(absolute_error), 'normalized', double(normalized_error)) AS (kind, error)"
    long = materialize(errors.selectExpr("model", "train_source", "unit", kinds).filter("error IS NOT NULL AND NOT isnan(error)"))
    gaps = materialize(gaps.select("scope", id, "gap").filter("gap IS NOT NULL AND NOT isnan(gap)"))
    sides = {}
    for name, df, key, value, unit, stream in (("error", long, by, "error", "unit", seed + 1), ("gap", gaps, ["scope"], "gap", id, seed)):
        points = df.groupBy(*key).agg(F.expr("count(*) AS n"), F.expr(f"avg({value}) AS mean")).join(
            quantiles(df, key, value, unit, {"median": 0.5}), key
        )
        draws = bootstrap_means(df, key, unit, [value], reps, stream, unit).withColumnRenamed(value, "mean_rep")
        draws = draws.join(bootstrap_medians(df, key, value, reps, stream, unit).withColumnRenamed(value, "median_rep"), [*key, "rep"])
        sides[name] = materialize(points), materialize(draws)
    (error, error_reps), (gap, gap_reps) = sides["error"], sides["gap"]
    own = gap.selectExpr("scope", "n AS n_pairs", "mean AS mean_gap", "median AS median_gap")
    for s in ("mean", "median"):
        own = own.join(percentile_ci(gap_reps, ["scope"], f"{s}_rep", reps, f"{s}_gap"), "scope")
    own = materialize(own)
    each = error.selectExpr(*by, "n AS n_errors", "mean AS mean_error", "median AS median_error")
    points = with_each(each, own, "model").selectExpr(
        "*", "mean_gap / (mean_error + 1e-12D) AS ratio_mean", "median_gap / (median_error + 1e-12D) AS ratio_median"
    )
    met = error_reps.withColumnsRenamed({"mean_rep": "_me", "median_rep": "_de"}).join(bounded(gap_reps), "rep")
    met = met.selectExpr(*by, "scope", "mean_rep / (_me + 1e-12D) AS ratio_mean", "median_rep / (_de + 1e-12D) AS ratio_median")
    key = [*by, "scope"]
    for s in ("mean", "median"):
        points = points.join(percentile_ci(met, key, f"ratio_{s}", reps, f"ratio_{s}"), key)
    pick = lambda kind, c: F.expr(f"max(IF(kind = '{kind}', {c}, NULL)) AS {c}" + ("" if kind == "absolute" else "_normalized"))
    gap_columns = ["n_pairs", *[f"{s}_gap{x}" for s in ("mean", "median") for x in ("", "_low", "_high")]]
    per_kind = ["n_errors", "mean_error", "median_error", *[f"ratio_{s}{x}" for s in ("mean", "median") for x in ("", "_low", "_high")]]
    return points.groupBy("model", "train_source", "scope").agg(
        *[F.max(c).alias(c) for c in gap_columns], *[pick(k, c) for k in ("absolute", "normalized") for c in per_kind]
    )


def smallest_gap(gaps: DataFrame, best_error: DataFrame, id: str = "id") -> DataFrame:
    """Median gap of each scope over the smallest valid model error (one row in ``best_error``)."""
    best = F.lit(best_error.first()["best_error"]).cast("double")
    med = quantiles(gaps, ["scope"], "gap", id, {"median_gap": 0.5})
    return med.select("scope", (F.col("median_gap") / (best + 1e-12)).alias("gap_index"))


def scale_calibration(df: DataFrame, source: str, error: str, coverage: float, id: str = "id") -> DataFrame:
    """Per source: the error at position ceil(coverage * n) over the median, and the coverage it achieves."""
    rows = materialize(ascending(df.select(source, error, id), [source], error, id))
    spot = f"least(ceil({coverage}D * n), n)"
    cut = rows.groupBy(source).agg(
        F.expr(f"max(IF(pos = {spot}, `{error}`, NULL)) AS _at"), quantile_at(0.5, F.col(error)).alias("_med")
    ).selectExpr(source, "_med", "_at / greatest(_med, 1e-12D) AS factor")
    return rows.join(bounded(cut), source).groupBy(source).agg(
        F.expr("max(factor) AS factor"), F.expr(f"avg(IF(`{error}` <= factor * _med, 1D, 0D)) AS achieved_coverage"),
        F.expr("max(factor * _med) AS sharpness"),
    )


def interval_coverage(df: DataFrame, by: list[str], error: str, alphas: Sequence[float], id: str = "id") -> DataFrame:
    """Share of errors within their own 1 - alpha quantile, per alpha."""
    rows = materialize(df.select(*by, error, id))
    q = quantiles(rows, by, error, id, {f"_q{i}": 1 - a for i, a in enumerate(alphas)})
    out = rows.join(bounded(q), by).groupBy(*by).agg(
        *[F.expr(f"avg(IF(`{error}` <= _q{i}, 1D, 0D)) AS _c{i}") for i in range(len(alphas))],
        *[F.expr(f"max(_q{i}) AS _v{i}") for i in range(len(alphas))],
    )
    items = ", ".join(f"named_struct('alpha', {a}D, 'quantile', _v{i}, 'coverage', _c{i})" for i, a in enumerate(alphas))
    return out.selectExpr(*by, f"inline(array({items}))")


def gram_rows(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Rows of [1 x]'[1 x | y] per key: ``i`` and the summed row. Each task adds up its own part first; parts of one
    row meet in one task, so no task holds more than (tasks x width) numbers."""
    fields = [f for f in df.schema if f.name in by]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def partial(batches):
        sums: dict = {}
        for b in batches:
            for key, part in b.groupby(by, sort=False) if by else [((), b)]:
                m = np.stack([np.asarray(v, dtype=np.float64) for v in part[x]])
                t = np.stack([np.atleast_1d(np.asarray(v, dtype=np.float64)) for v in part[y]])
                m = np.concatenate((np.ones((len(m), 1)), m), axis=1)
                g = m.T @ np.concatenate((m, t), axis=1)
                sums[key] = sums.get(key, 0.0) + g
        for key, g in sums.items():
            key = key if isinstance(key, tuple) else (key,)
            yield pd.DataFrame({**dict(zip(by, ([k] * len(g) for k in key))), "i": range(len(g)), "row": list(g)})

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum(np.stack([np.asarray(v, dtype=np.float64) for v in pdf["row"]]), axis=0)
        return pd.DataFrame({**{c: [k] for c, k in zip([*by, "i"], key)}, "row": [total]})

    out = f"{schema}, i int, row array<double>" if schema else "i int, row array<double>"
    parts = df.select(*by, x, y).mapInPandas(partial, out)
    return parts.groupBy(*by, "i").applyInPandas(add, out)


def _solve(gram: np.ndarray, width: int, alpha: float) -> np.ndarray:
    """Ridge weights with an unpenalised intercept; first row is the intercept."""
    a = gram[:, :width].copy()
    a[np.arange(1, width), np.arange(1, width)] += alpha
    return np.linalg.lstsq(a, gram[:, width:], rcond=None)[0]


def _fetch(gram: DataFrame, by: list[str]) -> dict[tuple, np.ndarray]:
    """Summed Gram matrices by key: features x (features + targets) numbers each."""
    pdf = gram.toPandas().sort_values([*by, "i"])
    groups = pdf.groupby(by, sort=False) if by else [((), pdf)]
    return {
        (k if isinstance(k, tuple) else (k,)): np.stack([np.asarray(r, dtype=np.float64) for r in g["row"]])
        for k, g in groups
    }


def fourier_features(df: DataFrame, x: str, width: int, components: int, gamma: float, seed: int, out: str) -> DataFrame:
    """Random cosine features of a vector column; the projection is drawn once from ``seed``."""
    rng = np.random.default_rng(seed)
    weights = np.sqrt(2 * gamma) * rng.standard_normal((width, components))
    offset = rng.uniform(0, 2 * np.pi, components)

    def lift(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in batches:
            m = np.stack([np.asarray(r, dtype=np.float64) for r in v])
            yield pd.Series(list(np.sqrt(2.0 / components) * np.cos(m @ weights + offset)))

    udf = F.pandas_udf(lift, T.ArrayType(T.DoubleType()))
    return df.withColumn(out, udf(x))


def ridge(train: DataFrame, test: DataFrame, x: str, y: str, alpha: float = 1.0, out: str = "pred") -> DataFrame:
    """Multi-output ridge: distributed Gram sums, a features-by-features solve on the driver, Arrow prediction."""
    gram = _fetch(gram_rows(train, [], x, y), [])[()]
    beta = _solve(gram, gram.shape[0], alpha)

    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in batches:
            m = np.stack([np.asarray(r, dtype=np.float64) for r in v])
            yield pd.Series(list(beta[0] + m @ beta[1:]))

    udf = F.pandas_udf(apply, T.ArrayType(T.DoubleType()))
    return test.withColumn(out, udf(x))


def _nested_fit(grams: dict, alpha: float) -> tuple:
    """n, R2, RMSE, correlation, mean and deviation of held-out R2 from the Gram matrices of the folds."""
    total = sum(grams.values())
    n, width = total[0, 0], len(total) - 1
    if n < 10:
        return int(n), None, None, None, None, None
    mean = total[0, 1 : width + 1] / n
    sd = np.sqrt(np.maximum(np.diag(total[1:, 1 : width + 1]) / n - mean**2, 0))
    sd[sd == 0] = 1.0
    # standardise: z = S [1 x]
    s = np.zeros((width + 1, width + 1))
    s[0, 0] = 1.0
    s[1:, 0] = -mean / sd
    s[np.arange(1, width + 1), np.arange(1, width + 1)] = 1 / sd

    def scaled(g: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        return s @ g[:, : width + 1] @ s.T, s @ g[:, width + 1], g[0, width + 2]

    def fit(g: np.ndarray) -> np.ndarray:
        a, b, _ = scaled(g)
        return _solve(np.column_stack((a, b)), width + 1, alpha)[:, 0]

    def score(g: np.ndarray, beta: np.ndarray) -> tuple[float | None, float, float | None]:
        a, b, yy = scaled(g)
        m, y1 = a[0, 0], b[0]
        sse = yy - 2 * beta @ b + beta @ a @ beta
        p1, pp = beta @ a[0], beta @ a @ beta
        cov, vy, vp = beta @ b - p1 * y1 / m, yy - y1**2 / m, pp - p1**2 / m
        r = cov / np.sqrt(vy * vp) if vy > 0 and vp > 0 else None
        return 1 - sse / vy if vy > 0 else None, np.sqrt(max(sse, 0) / m), r

    held = [score(g, fit(total - g))[0] for g in grams.values() if 2 <= g[0, 0] < n]
    held = [x for x in held if x is not None]
    return int(n), *score(total, fit(total)), np.mean(held) if held else None, np.std(held) if held else None


def nested_regression(
    df: DataFrame, sets: dict[str, Sequence[str]], target: str, fold: str, alpha: float = 1.0, by: Sequence[str] = ()
) -> DataFrame:
    """Ridge fit of each feature set within each key ``by`` with grouped cross-validation: R2, RMSE, correlation, mean and
    deviation of held-out R2.

    One scan gives a Gram matrix per (key, feature set, fold); training sums are the total minus the fold, features are
    standardised inside the algebra, and a task solves one key's set. A set counts the rows that have all its features,
    the target and a fold; each set has a row, without statistics below 10 such rows or where the target is constant.
    """
    by = list(by)
    key = [*by, "model"]
    has = lambda c: f"`{c}` IS NOT NULL AND NOT isnan(`{c}`)"
    items = ", ".join(
        f"named_struct('model', '{name}', 'x', IF({' AND '.join(map(has, cols))}, array({', '.join(f'CAST(`{c}` AS DOUBLE)' for c in cols)}), NULL))"
        for name, cols in sets.items()
    )
    rows = df.filter(f"`{fold}` IS NOT NULL AND {has(target)}").selectExpr(
        *[f"`{c}`" for c in by], f"`{fold}` AS fold", f"array(CAST(`{target}` AS DOUBLE), pow(CAST(`{target}` AS DOUBLE), 2)) AS y",
        f"inline(array({items}))",
    )
    grams = gram_rows(rows.filter("x IS NOT NULL"), [*key, "fold"], "x", "y")
    stats = "n_pairs bigint, r2 double, rmse double, pearson_r double, cv_r2_mean double, cv_r2_std double"
    names = [f.split(" ")[0] for f in stats.split(", ")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in by), "model string", stats])

    def solve(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        parts = {k: np.stack(list(g.sort_values("i")["row"])) for k, g in pdf.groupby("fold")}
        return pd.DataFrame([dict(zip([*sorted_by, "model", *names], (*group, *_nested_fit(parts, alpha))))])

    sorted_by = [f.name for f in df.schema if f.name in by]
    fits = grams.groupBy(*sorted_by, "model").applyInPandas(solve, schema)
    every = ", ".join(f"'{name}'" for name in sets)
    spine = (df.select(*by).distinct() if by else df.sparkSession.range(1)).selectExpr(*[f"`{c}`" for c in by], f"explode(array({every})) AS model")
    return spine.join(fits, key, "left").withColumn("n_pairs", F.coalesce("n_pairs", F.lit(0)).cast("bigint"))

"""Pairing two sources: quarantine, tiers, nested panels, splits, reconciliation, pair-distance histograms."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandemrank.operators.quantile import quantiles
from tandemrank.operators.rank import positions
from tandemrank.operators.resample import counter_hash
from tandemrank.session import bounded, materialize, spread_join

# Pair distances: chunks that a group is cut into as long as they hold at most so many points; pairs worked out at once.
MOST_CHUNKS, MOST_POINTS, HELD_PAIRS = 16, 4096, 1 << 17


def prefixed(df: DataFrame, prefix: str, key: str) -> DataFrame:
    return df.select(F.col(key), *[F.col(c).alias(f"{prefix}{c}") for c in df.columns if c != key])


def pair_sources(
    candidates: DataFrame, left: DataFrame, right: DataFrame, left_id: str, right_id: str, checks: Sequence[tuple[str, str]]
) -> DataFrame:
    """Candidates with both records' columns (``l_``, ``r_``) and a ``reason`` that is null for usable pairs.

    ``checks`` are (reason, SQL condition on the joined row) in order of precedence after ``missing_source_record``.
    """
    l = prefixed(left, "l_", left_id).withColumn("_l", F.lit(True))
    r = prefixed(right, "r_", right_id).withColumn("_r", F.lit(True))
    # A join reads its rows twice, to count the keys and to join; what they come from is worked out once.
    rows = materialize(spread_join(materialize(candidates), l, [left_id], right_id, "left"))
    rows = spread_join(rows, r, [right_id], left_id, "left")
    arms = " ".join(f"WHEN {cond} THEN '{reason}'" for reason, cond in checks)
    case = f"CASE WHEN _l IS NULL OR _r IS NULL THEN 'missing_source_record' {arms} END"
    return rows.withColumn("reason", F.expr(case)).drop("_l", "_r")


def enrich(pairs: DataFrame, source: DataFrame, key: str, columns: Sequence[str], prefix: str, spread: str) -> DataFrame:
    """Left join of chosen attributes of one source under a prefix; unknown keys give nulls."""
    return spread_join(pairs, prefixed(source.select(key, *columns), prefix, key), [key], spread, "left")


def tier(df: DataFrame) -> DataFrame:
    """Tier and reasons from precomputed match measures.

    Needs ``parse_error``, ``same_count``, ``same_formula``, ``fit`` (booleans), ``relation`` and ``rotation_class``.
    """
    bad_rotation = "coalesce(rotation_class IN ('deformation', 'unresolved'), false)"
    reasons = f"""array_compact(CASE
        WHEN parse_error THEN array('parse_error')
        WHEN NOT same_count THEN array('different_counts')
        WHEN NOT same_formula THEN array('different_formula')
        WHEN NOT fit THEN array(IF(relation = 'different', 'relation_different', NULL), 'match_failed', concat('relation:', relation))
        ELSE array(IF(relation = 'different', 'relation_different', NULL), IF(relation = 'different', 'mismatch_kept_for_review', NULL),
                   IF({bad_rotation}, concat('rotation_unresolved:', rotation_class), NULL)) END)"""
    return df.selectExpr(
        "*",
        f"""CASE WHEN parse_error THEN 'quarantine' WHEN NOT same_count OR NOT same_formula THEN 'tier_3'
            WHEN NOT fit OR relation = 'different' OR {bad_rotation} THEN 'quarantine' ELSE 'tier_1' END AS tier""",
        f"{reasons} AS reasons",
    )


def funnel(rows: DataFrame, steps: dict[str, str]) -> DataFrame:
    """How many candidates pass each step, in one pass."""
    return rows.agg(*[F.expr(f"count_if({cond}) AS `{name}`") for name, cond in steps.items()])


def nested_panels(
    pairs: DataFrame, by: list[str], related: str, distances: Sequence[str], lineage: str, id: str
) -> DataFrame:
    """P0 all; P1 related; P2 within P1's median of every distance; P3 with full lineage on both sides."""
    p1 = pairs.filter(related)
    out = pairs
    limits = []
    for d in distances:
        known = p1.filter(f"{d} IS NOT NULL AND NOT isnan({d})").select(*by, id, d)
        out = out.join(bounded(quantiles(known, by, d, id, {f"_med_{d}": 0.5})), by, "left")
        limits.append(f"coalesce({d} <= _med_{d}, false)")
    return out.selectExpr(
        *[f"`{c}`" for c in pairs.columns], "true AS P0", f"coalesce({related}, false) AS P1",
        f"coalesce({related}, false) AND {' AND '.join(limits)} AS P2",
        f"coalesce({related}, false) AND {' AND '.join(limits)} AND coalesce({lineage}, false) AS P3",
    )


def sublayer(site_max: str, strain: str, equal: str) -> str:
    """SQL text of the shift sublayer; an unknown site distance counts as infinite."""
    return (
        f"CASE WHEN {strain} IS NULL THEN 'unparsed' WHEN {site_max} < 0.05D AND {strain} < 0.05D AND {equal} THEN 'T1a' "
        f"WHEN {site_max} < 0.2D AND {strain} < 0.1D THEN 'T1b' ELSE 'T1c' END"
    )


def core_extended(pairs: DataFrame, residuals: DataFrame, key: list[str], limit: float = 0.25) -> DataFrame:
    """All pairs with ``is_core`` and the exclusion ``reason``.

    A T1a pair is core if each source's native residual is within the limit, or is explained by low transported and
    common residuals. ``residuals`` holds one row per (pair, source).
    """
    kinds = ("native", "transport", "common")
    wide = residuals.groupBy(*key).pivot("source", ["left", "right"]).agg(
        *[F.avg(f"{k}_residual_normalized").alias(k) for k in kinds]
    )
    rows = pairs.join(wide, key, "left")
    why = []
    for s in ("left", "right"):
        native, moved, common = (f"{s}_{k}" for k in kinds)
        explained = f"coalesce({moved} <= {limit}D AND {common} <= {limit}D, false)"
        why.append(
            f"CASE WHEN {native} IS NULL OR isnan({native}) THEN '{s}_native_unresolved' "
            f"WHEN {native} > {limit}D AND NOT {explained} THEN '{s}_native_high' END"
        )
    reason = f"CASE WHEN sublayer != 'T1a' THEN concat('not_T1a (', sublayer, ')') ELSE nullif(concat_ws('; ', {', '.join(why)}), '') END"
    rows = rows.withColumn("reason", F.expr(reason))
    return rows.withColumn("is_core", F.col("reason").isNull())


def hold_out_groups(df: DataFrame, group: str, share: float, seed: int) -> DataFrame:
    """Distinct groups chosen for testing: the first ``round(share * groups)`` (at least one) in hash order."""
    groups = df.select(group).distinct().withColumn("_k", F.lit(1)).withColumn(
        "_h", F.expr(counter_hash(str(seed), f"`{group}`"))
    )
    ranked = positions(groups, ["_k"], [F.col("_h").asc(), F.col(group).asc()])
    return ranked.filter(f"pos <= greatest(1, bround({share}D * n))").select(group)


def train_pool(records: DataFrame, test: DataFrame, id: str, formula: str, prototype: str) -> DataFrame:
    """Records that share neither an id of either side, nor a formula, nor a prototype with the test panel."""
    out = records
    for column, names in ((id, ["left_id", "right_id"]), (formula, [formula]), (prototype, [prototype])):
        for name in names:
            out = out.join(bounded(test.select(F.col(name).alias(column)).distinct()), column, "left_anti")
    return out


def eval_sets(left: DataFrame, right: DataFrame, test: DataFrame, id: str, formula: str, prototype: str) -> DataFrame:
    """Tagged evaluation rows: in-source, formula-disjoint, prototype-disjoint, and each side's mates in the other."""
    plan = []
    for name, source, own in (("left", left, "left_id"), ("right", right, "right_id")):
        plan += [
            (f"{name}_insource", source, own, id), (f"{name}_formula_disjoint", source, formula, formula),
            (f"{name}_prototype_disjoint", source, prototype, prototype),
        ]
    plan += [("counterfactual_left", right, "right_id", id), ("counterfactual_right", left, "left_id", id)]
    out = None
    for tag, source, column, key in plan:
        part = source.join(bounded(test.select(F.col(column).alias(key)).distinct()), key, "left_semi")
        part = part.select(*source.columns).withColumn("eval_set", F.lit(tag))
        out = part if out is None else out.unionByName(part)
    return out


def disjoint(sets: DataFrame, train: DataFrame, id: str) -> DataFrame:
    """Per evaluation set, how many rows are also in the training pool, and whether none is."""
    both = sets.join(train.select(id).distinct().withColumn("_t", F.lit(True)), id, "left")
    return both.groupBy("eval_set").agg(
        F.expr("count(*) AS n"), F.expr("count_if(_t) AS shared"), F.expr("count_if(_t) = 0 AS is_disjoint")
    )


def reconcile(independent: DataFrame, primary: DataFrame, key: list[str], tolerance: float) -> DataFrame:
    """Full outer comparison of two (key, value) tables: differences and pass / fail / missing_or_nonfinite."""
    rows = independent.withColumnRenamed("value", "independent").join(
        primary.withColumnRenamed("value", "primary"), key, "full_outer"
    )
    bad = " OR ".join(f"{c} IS NULL OR isnan({c}) OR abs({c}) = double('inf')" for c in ("independent", "`primary`"))
    diff = "abs(independent - `primary`)"
    return rows.selectExpr(
        "*", f"IF({bad}, NULL, {diff}) AS abs_diff", f"IF({bad}, NULL, {diff} / greatest(abs(`primary`), 1e-12D)) AS rel_diff",
        f"{tolerance}D AS tolerance",
        f"CASE WHEN {bad} THEN 'missing_or_nonfinite' WHEN {diff} <= {tolerance}D THEN 'pass' ELSE 'fail' END AS status",
    )


def distance_histogram(
    points: DataFrame, group: list[str], id: str, axes: Sequence[str], bins: int = 20, top: float = 10.0,
    chunk: int = 4096,
) -> DataFrame:
    """Shares of a group's pair distances per bin of [0, top]; longer distances count in the total only.

    A group is cut into chunks of points and every two chunks meet in one task, which returns counts: no pair is
    emitted, and a large group is spread over (chunks)^2 / 2 tasks. A row is sent once per chunk of its group, so chunks
    hold at least ``chunk`` points and grow with the group up to MOST_POINTS as long as it has over MOST_CHUNKS of them.
    """
    rows = positions(points.select(*group, id, *axes), group, [F.col(id).asc()])
    rows = rows.withColumn("_size", F.expr(f"greatest({chunk}, least({MOST_POINTS}, ceil(n / {MOST_CHUNKS})))"))
    rows = rows.selectExpr(
        *group, *axes, "n", "(pos - 1) div _size AS _c", "explode(sequence(0L, (n - 1) div _size)) AS _d"
    ).selectExpr(*group, *axes, "n", "_c", "least(_c, _d) AS _lo", "greatest(_c, _d) AS _hi")
    width = top / bins

    def kernel(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = key[-2], key[-1]
        xyz = pdf[list(axes)].to_numpy(dtype=np.float64)
        side = pdf["_c"].to_numpy()
        a, b = xyz[side == lo], xyz[side == hi]
        counts = np.zeros(bins, dtype=np.int64)
        step = max(1, HELD_PAIRS // max(len(b), 1))
        for i in range(0, len(a), step):
            d = np.sqrt(sum((a[i : i + step, None, k] - b[None, :, k]) ** 2 for k in range(len(axes))))
            keep = d <= top
            if lo == hi:
                keep &= np.arange(len(b)) > np.arange(i, i + len(d))[:, None]
            counts += np.bincount(np.minimum((d[keep] / width).astype(int), bins - 1), minlength=bins)
        out = {c: [v] * bins for c, v in zip(group, key)}
        return pd.DataFrame({**out, "bin": np.arange(bins), "_k": counts, "_n": int(pdf["n"].iloc[0])})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.select(*group).schema)
    parts = rows.groupBy(*group, "_lo", "_hi").applyInPandas(kernel, f"{schema}, bin int, _k bigint, _n bigint")
    return parts.groupBy(*group, "bin").agg(
        F.expr("sum(_k) / (max(_n) * (max(_n) - 1) / 2D + 1e-12D) AS share")
    )


def membership(df: DataFrame, keys: list[str], sets: dict[str, DataFrame], spread: str) -> DataFrame:
    """One boolean column per named key set."""
    for name, keyset in sets.items():
        marked = keyset.select(*keys).distinct().withColumn(name, F.lit(True))
        df = spread_join(df, marked, keys, spread, "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))
    return df

"""Audit samples, quota samples and candidate lists. Lists have a fixed length; pools are never gathered."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tandemrank.operators.rank import positions, rank_both
from tandemrank.operators.resample import counter_hash
from tandemrank.operators.strata import cut_by_quantiles
from tandemrank.session import bounded, materialize


def audit_sample(
    df: DataFrame, value: str, anomaly: str, id: str, each: int = 15, total: int = 60, seed: int = 42, by: Sequence[str] = ()
) -> DataFrame:
    """In each key ``by``: lowest, middle and highest ``each`` rows by value and the most anomalous, without repeats, topped
    up to ``total`` in hash order. ``part`` says which slice a row came from; ``id`` is unique inside a key."""
    rows = materialize(df.withColumn("_k", F.lit(1)))
    key = list(by) or ["_k"]
    ranked = positions(rows, key, [F.col(value).asc(), F.col(id).asc()])
    mid = f"greatest(0L, n div 2 - {each // 2})"
    names = [f"`{c}`" for c in (*key, id)]
    slices = ranked.selectExpr(
        *names,
        f"""inline(array_compact(array(IF(pos <= {each}, named_struct('rank', 1, 'part', 'low'), NULL),
            IF(pos > {mid} AND pos <= {mid} + {each}, named_struct('rank', 2, 'part', 'middle'), NULL),
            IF(pos > n - {each}, named_struct('rank', 3, 'part', 'high'), NULL))))""",
    )
    # Row numbers below a limit: each task keeps only so many rows of a key before the shuffle.
    turn = lambda *order: F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    worst = rows.withColumn("_i", turn(F.col(anomaly).desc(), F.col(id).asc())).filter(F.col("_i") <= each)
    picked = slices.unionByName(worst.selectExpr(*names, "4 AS rank", "'anomalous' AS part"))
    picked = materialize(picked.groupBy(*key, id).agg(F.expr("min_by(part, rank) AS part")))
    have = picked.groupBy(*key).agg(F.count("*").alias("_have"))
    rest = rows.join(picked.select(*key, id), [*key, id], "left_anti").withColumn("_h", F.expr(counter_hash(str(seed), f"`{id}`")))
    extra = rest.withColumn("_i", turn("_h", id)).filter(F.col("_i") <= total).join(have, key).filter(F.col("_i") <= total - F.col("_have"))
    return picked.unionByName(extra.selectExpr(*names, "'extra' AS part")).drop("_k")


def stratified_sample(
    df: DataFrame, stratum: str, value: str, id: str, quotas: dict[str, int] | DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """Low, middle and high rows of each stratum of a key ``by``, a third of its quota each; strata under three rows give none.

    ``quotas`` are numbers by stratum, or a table ``(*by, stratum, quota)`` with one row each (see ``quota_table``).
    """
    key = [*by, stratum]
    ranked = positions(df, key, [F.col(value).asc(), F.col(id).asc()]).filter("n >= 3")
    if isinstance(quotas, DataFrame):
        rows = ranked.join(bounded(quotas.select(*key, F.col("quota").alias("_q"))), key)
    else:
        rows = ranked.withColumn("_q", F.coalesce(*[F.when(F.col(stratum) == F.lit(s), F.lit(q)) for s, q in quotas.items()], F.lit(0)))
    rows = rows.selectExpr("*", "n div 2 - (_q div 3) div 2 AS _s", "_q div 3 AS _t")
    part = """CASE WHEN pos <= _t THEN 'low' WHEN pos > _s AND pos <= _s + _t THEN 'middle' WHEN pos > n - (_q - 2 * _t) THEN 'high' END"""
    return rows.selectExpr(*[f"`{c}`" for c in df.columns], f"{part} AS part").filter("part IS NOT NULL")


def equal_quotas(strata: Sequence[str], total: int) -> dict[str, int]:
    """``total`` split evenly; the first strata take the remainder."""
    base, extra = divmod(total, len(strata))
    return {s: base + (1 if i < extra else 0) for i, s in enumerate(strata)}


def quota_table(df: DataFrame, stratum: str, total: int, by: Sequence[str] = ()) -> DataFrame:
    """``equal_quotas`` of the strata of each key as a table, for any number of keys and strata; a null stratum has none."""
    strata = df.select(*by, stratum).filter(F.col(stratum).isNotNull()).distinct()
    placed = positions(strata, list(by), [F.col(stratum).asc()], "_i", "_strata")
    quota = F.expr(f"CAST({total} div _strata + IF(_i <= {total} % _strata, 1, 0) AS BIGINT)")
    return materialize(placed.select(*by, stratum, quota.alias("quota")))


def endpoint_table(pairs: DataFrame, metric: str, id: str = "id") -> DataFrame:
    """Per pair over all endpoints: mean percentile and elite flag of each side, and the largest absolute score."""
    ranked = rank_both(pairs, [metric], id, ties=True)
    pct = "(n + 1.0D - ({s}_first + {s}_last) / 2.0D) / n"
    return ranked.groupBy(id).agg(
        F.expr(f"avg({pct.format(s='l')}) AS agg_l"), F.expr(f"avg({pct.format(s='r')}) AS agg_r"),
        F.expr("bool_or(l_pos <= greatest(1L, floor(0.10D * n))) AS elite_l"),
        F.expr("bool_or(r_pos <= greatest(1L, floor(0.10D * n))) AS elite_r"),
        F.expr("max(greatest(abs(`left`), abs(`right`))) AS peak"),
    )


CANDIDATE_STRATA = ["consensus_elite", "left_only_elite", "right_only_elite", "consensus_low", "diversity_balanced"]


def candidate_list(
    pairs: DataFrame, metric: str, attributes: DataFrame, stratum: str, size: str, formula: str, member: str,
    quotas: Sequence[int] = (10, 10, 10, 8, 10), id: str = "id",
) -> DataFrame:
    """Stratified candidates: consensus elite, one-sided elites, consensus low, then a diversity fill.

    The first four are ordered takes from set expressions over endpoint tables. The fill balances ``member`` over
    the whole list and repeatedly takes the pair whose stratum, size tercile and formula are rarest in it.
    """
    table = endpoint_table(pairs, metric, id).withColumn("_k", F.lit(1))
    for side in ("l", "r"):
        table = positions(table, ["_k"], [F.col(f"agg_{side}").desc(), F.col(id).asc()], f"_top_{side}", f"_n_{side}")
        table = positions(table, ["_k"], [F.col(f"agg_{side}").asc(), F.col(id).asc()], f"_low_{side}", count=None)
    k10, k20 = "greatest(1L, floor(0.10D * _n_l))", "greatest(1L, floor(0.20D * _n_l))"
    table = table.join(attributes.select(id, stratum, size, formula, member), id)
    table = materialize(cut_by_quantiles(table, ["_k"], size, id, [1 / 3, 2 / 3], ["0", "1", "2"], "_bin"))
    rules = [
        ("elite_l AND elite_r", "agg_l + agg_r", False), (f"_top_l <= {k10} AND NOT elite_r", "agg_l", False),
        (f"_top_r <= {k10} AND NOT elite_l", "agg_r", False),
        (f"_low_l <= {k20} AND _low_r <= {k20} AND peak > 0", "agg_l + agg_r", True),
    ]
    keep = [id, stratum, formula, member, "_bin"]
    schema = table.select(*keep).schema
    chosen: list = []
    spark = pairs.sparkSession

    def left_over() -> DataFrame:
        used = spark.createDataFrame([(r[2][id],) for r in chosen], table.select(id).schema)
        return table.join(F.broadcast(used), id, "left_anti")

    for (where, score, up), name, quota in zip(rules, CANDIDATE_STRATA, quotas):
        pool = left_over().filter(where).withColumn("_score", F.expr(score))
        order = F.col("_score").asc() if up else F.col("_score").desc()
        chosen += [(name, i + 1, r) for i, r in enumerate(pool.orderBy(order, id).select(*keep).limit(quota).collect())]
    fill = quotas[4]
    want = max(0, min(fill, sum(quotas) // 2 - sum(bool(r[2][member]) for r in chosen)))
    place = 0
    for flag, count in ((False, fill - want), (True, want)):
        for _ in range(count):
            pool = left_over().filter(F.col(member) == F.lit(flag))
            seen = spark.createDataFrame([r[2] for r in chosen], schema)
            for i, c in enumerate((stratum, "_bin", formula)):
                tally = seen.groupBy(c).agg(F.count("*").alias(f"_t{i}"))
                pool = pool.join(F.broadcast(tally), c, "left").fillna(0, [f"_t{i}"])
            best = pool.orderBy("_t0", "_t1", "_t2", id).select(*keep).limit(1).collect()
            if not best:
                break
            place += 1
            chosen.append((CANDIDATE_STRATA[4], place, best[0]))
    picks = spark.createDataFrame(
        [(n, i, r[id]) for n, i, r in chosen], f"candidate_stratum string, selection_order int, `{id}` {schema[id].dataType.simpleString()}"
    )
    return attributes.join(F.broadcast(picks), id)


def balance_report(candidates: DataFrame, strata: Sequence[str], caps: dict[str, int]) -> DataFrame:
    """Counts per candidate stratum with zero fill, and the largest count of each capped column with its verdict."""
    spark = candidates.sparkSession
    fixed = spark.createDataFrame([(s,) for s in strata], "value string")
    counts = candidates.groupBy(F.col("candidate_stratum").alias("value")).count()
    out = fixed.join(counts, "value", "left").selectExpr(
        "'candidate_stratum' AS item", "value", "coalesce(count, 0L) AS n", "CAST(NULL AS BOOLEAN) AS passed"
    )
    for c, cap in caps.items():
        top = candidates.groupBy(c).count().agg(F.max("count").alias("n"))
        out = out.unionByName(top.selectExpr(f"'{c}' AS item", "'largest' AS value", "n", f"n <= {cap} AS passed"))
    return out


PICK_QUOTAS = {"consensus_elite": 3, "left_only": 3, "right_only": 3, "consensus_low": 2}


def illustrative_picks(ranked: DataFrame, formula: str, member: str, id: str = "id", by: Sequence[str] = ()) -> DataFrame:
    """Examples per key ``by`` and category from ranked pairs: nearest the diagonal for consensus, farthest for disputes;
    members preferred where there are enough. Picks of one category may share a formula, those of two may not; a null
    formula equals none."""
    pct = "({s}_first + {s}_last) / 2.0D / n * 100"
    keys = [f"`{c}`" for c in by]
    rows = ranked.selectExpr(
        *keys, f"`{id}`", f"`{formula}`", f"`{member}`", f"{pct.format(s='l')} AS pct_l", f"{pct.format(s='r')} AS pct_r"
    ).selectExpr(
        "*", "abs(pct_l - pct_r) AS gap",
        """CASE WHEN pct_l <= 10 AND pct_r <= 10 THEN 'consensus_elite' WHEN pct_l <= 10 THEN 'left_only'
           WHEN pct_r <= 10 THEN 'right_only' WHEN pct_l >= 80 AND pct_r >= 80 THEN 'consensus_low' END AS category""",
    ).filter("category IS NOT NULL")
    key = list(by) or ["_k"]
    rows = materialize(rows if by else rows.withColumn("_k", F.lit(1)))
    out = None
    for name, quota in PICK_QUOTAS.items():
        pool = rows.filter(F.col("category") == name)
        if out is not None:
            pool = pool.join(out.select(*key, formula).distinct(), [*key, formula], "left_anti")
        order = F.col("gap").asc() if name.startswith("consensus") else F.col("gap").desc()
        # Row numbers up to the quota: each task keeps only so many rows of a key before the shuffle.
        first = lambda df: df.withColumn("_i", F.row_number().over(Window.partitionBy(*key).orderBy(order, F.col(id).asc()))).filter(F.col("_i") <= quota)  # noqa: B023, E731
        members = first(pool.filter(F.col(member)))
        full = members.filter(F.col("_i") == quota).select(*key)
        picked = members.join(full, key, "left_semi").unionByName(first(pool).join(full, key, "left_anti")).drop("_i")
        out = materialize(picked if out is None else out.unionByName(picked))
    return out.drop("_k")


def deduplicate(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row per key: the one with the smallest ``order``."""
    fields = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.min_by(F.struct(*fields), F.col(order)).alias("_b"))
    return best.select(*key, *[F.col(f"_b.{c}").alias(c) for c in fields])



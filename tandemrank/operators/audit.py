"""Field provenance, panel characterisation, distance audit and key numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandemrank.operators.quantile import summarize


def field_provenance(df: DataFrame, attributes: dict[str, tuple[str, str]], share: float = 0.05) -> DataFrame:
    """Per attribute: common and missing values per side, equal values, and a flag for suspected copying."""
    items = ", ".join(
        f"named_struct('attribute', '{a}', 'l', CAST(`{l}` AS DOUBLE), 'r', CAST(`{r}` AS DOUBLE))"
        for a, (l, r) in attributes.items()
    )
    def ok(c: str) -> str:
        return f"({c} IS NOT NULL AND NOT isnan({c}) AND abs({c}) != double('inf'))"

    out = df.selectExpr(f"inline(array({items}))").groupBy("attribute").agg(
        F.expr("count(*) AS n_pairs"), F.expr(f"count_if({ok('l')} AND {ok('r')}) AS common_n"),
        F.expr(f"count_if(NOT {ok('l')}) AS left_missing"), F.expr(f"count_if(NOT {ok('r')}) AS right_missing"),
        F.expr(f"count_if({ok('l')} OR {ok('r')}) AS available_n"),
        F.expr(f"count_if({ok('l')} AND {ok('r')} AND l = r) AS identical_values"),
    )
    return out.selectExpr(
        "*", "identical_values / CAST(nullif(common_n, 0) AS DOUBLE) AS fraction_identical",
        f"coalesce(identical_values / CAST(nullif(common_n, 0) AS DOUBLE) > {share}D, false) AS same_field_copy_flag",
    )


def panel_counts(long: DataFrame, by: list[str], conditions: dict[str, str]) -> DataFrame:
    """Rows per panel and how many meet each condition."""
    return long.groupBy(*by).agg(
        F.expr("count(*) AS n"), *[F.expr(f"count_if({c}) AS `{name}`") for name, c in conditions.items()]
    )


def distance_audit(long: DataFrame, by: list[str], distances: Sequence[str], id: str = "id") -> DataFrame:
    """Mean, median and maximum of every distance per panel, in long form over the distances."""
    items = ", ".join(f"named_struct('distance', '{d}', 'value', CAST(`{d}` AS DOUBLE))" for d in distances)
    rows = long.selectExpr(*by, f"`{id}`", f"inline(array({items}))").filter("value IS NOT NULL AND NOT isnan(value)")
    return summarize(
        rows, [*by, "distance"], "value", id, {"median": 0.5},
        {"n_rows": F.expr("count(*)"), "mean": F.expr("avg(value)"), "maximum": F.expr("max(value)")},
    )


def key_numbers(tables: Sequence[tuple[DataFrame, str, dict[str, str]]]) -> DataFrame:
    """Named scalars (name, value) out of result tables: ``(table, filter, {name: SQL aggregate})``."""
    out = None
    for table, where, values in tables:
        row = table.filter(where).agg(*[F.expr(f"CAST({e} AS DOUBLE) AS `{n}`") for n, e in values.items()])
        stack = ", ".join(f"'{n}', `{n}`" for n in values)
        part = row.selectExpr(f"stack({len(values)}, {stack}) AS (name, value)")
        out = part if out is None else out.unionByName(part)
    return out

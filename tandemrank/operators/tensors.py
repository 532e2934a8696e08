"""Operators on tensor tables: lineage audit, scores, discrepancy variants, residuals, alignment, soft modes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandemrank.functions import tensors as fn


def lineage_audit(df: DataFrame, trusted: str, project: str, stored: str, tol: float = 1e-6) -> DataFrame:
    """Differences between three versions of a tensor; ``verified`` if both converters give the stored one."""
    rel = "greatest(" + fn.norm(stored) + ", 1e-12D)"
    return df.selectExpr(
        "*",
        f"{fn.diff_norm(trusted, project)} AS diff_trusted_project",
        f"{fn.diff_norm(trusted, stored)} AS diff_trusted_stored",
        f"{fn.diff_norm(project, stored)} AS diff_project_stored",
        f"{fn.shear_diff(trusted, stored)} AS shear_trusted_stored",
        f"{fn.shear_diff(project, stored)} AS shear_project_stored",
        f"{fn.diff_norm(trusted, stored)} / {rel} AS relative_trusted_stored",
        f"{fn.norm(stored)} AS stored_norm", f"{fn.norm(trusted)} AS trusted_norm", f"{fn.norm(project)} AS project_norm",
    ).selectExpr(
        "*",
        f"""CASE WHEN diff_trusted_stored IS NULL OR diff_project_stored IS NULL THEN 'unavailable'
            WHEN diff_trusted_stored < {tol}D AND diff_project_stored < {tol}D THEN 'verified' ELSE 'mismatch' END AS status""",
    )


def score_table(df: DataFrame, t: str = "t") -> DataFrame:
    """All scalar scores of a tensor column: norm, largest singular value, Kelvin operator norm, directional maximum."""
    df = df.selectExpr("*", f"{fn.norm(t)} AS frobenius")
    df = fn.with_top_singular(df, t, "top_singular")
    df = fn.with_top_singular(df, t, "kelvin", kelvin=True)
    return df.withColumn("longitudinal", fn.max_longitudinal(F.col(t)))


def exact_transported(df: DataFrame, left: str, right: str, rotation: str) -> DataFrame:
    """Discrepancy after moving the right tensor into the left frame."""
    df = df.withColumn("_r", fn.transport(F.col(right), F.col(rotation)))
    return df.selectExpr(*df.columns, *fn.discrepancy(left, "_r"), f"`{rotation}` IS NOT NULL AS rotation_available").drop("_r")


def domain_aware(df: DataFrame, left: str, right: str, rotation: str) -> DataFrame:
    """As ``exact_transported``, with the sign of the right tensor free; flags the flip."""
    df = df.withColumn("_t", fn.transport(F.col(right), F.col(rotation)))
    df = df.selectExpr("*", f"{fn.diff_norm(left, fn.negate('_t'))} < {fn.diff_norm(left, '_t')} AS polar_domain_flip")
    df = df.selectExpr("*", f"IF(polar_domain_flip, {fn.negate('_t')}, _t) AS _r")
    return df.selectExpr(*df.columns, *fn.discrepancy(left, "_r")).drop("_t", "_r")


def residuals(df: DataFrame, t: str, rotations: str, prefix: str) -> DataFrame:
    """Distance of a tensor from its average over a set of rotations, raw and relative; null without rotations."""
    df = df.withColumn("_p", fn.project(F.col(t), F.col(rotations)))
    return df.selectExpr(
        *[f"`{c}`" for c in df.columns if c != "_p"], f"{fn.diff_norm(t, '_p')} AS {prefix}_residual_raw",
        f"{fn.diff_norm(t, '_p')} / ({fn.norm(t)} + 1e-12D) AS {prefix}_residual_normalized",
        f"IF(_p IS NULL, NULL, {fn.norm('_p')} / ({fn.norm(t)} + 1e-12D)) AS {prefix}_norm_retention",
    )


def native_residuals(
    pairs: DataFrame, keep: list[str], left: str, right: str, left_set: str, right_set: str, rotation: str
) -> DataFrame:
    """One row per (pair, source) with native, transported and common residuals and the frame status.

    The transported frame uses the source's rotations seen through the pair's rotation; the common one the left
    set, or the right set where the left has none.
    """
    pairs = pairs.withColumn("_aligned", fn.transport(F.col(right), F.col(rotation)))
    pairs = pairs.selectExpr("*", f"coalesce({left_set}, {right_set}) AS _common")
    rows = pairs.selectExpr(
        *keep, rotation, "_common",
        f"inline(array(named_struct('source', 'left', '_t', {left}, '_moved', {left}, '_set', {left_set}), "
        f"named_struct('source', 'right', '_t', {right}, '_moved', _aligned, '_set', {right_set})))",
    )
    rows = rows.withColumn("_seen", fn.conjugate(F.col("_set"), F.col(rotation)))
    rows = residuals(rows, "_t", "_set", "native")
    rows = residuals(rows, "_moved", "_seen", "transport")
    rows = residuals(rows, "_moved", "_common", "common")
    blank = "CASE WHEN _set IS NULL THEN NULL ELSE {c} END AS {c}"
    cols = [f"{k}_residual_{w}" for k in ("native", "transport", "common") for w in ("raw", "normalized")]
    return rows.selectExpr(
        *keep, "source", f"{fn.norm('_t')} AS norm", *[blank.format(c=c) for c in cols],
        "IF(_set IS NULL OR size(_set) = 0, 'native_frame_unresolved', 'native_frame_verified') AS native_frame_status",
    )


VARIANTS = [
    "source_native_invariant", "exact_transported", "proper_orbit", "domain_aware", "point_group_equivalent",
    "symmetry_projected",
]


def hierarchy(pairs: DataFrame, keep: list[str], left: str, right: str, rotations: str, rotation: str) -> DataFrame:
    """Six discrepancy variants per pair in long form, from the weakest to the strongest alignment."""
    c = F.col
    df = pairs.withColumn("_t", fn.transport(c(right), c(rotation)))
    usable = F.when(c(rotation).isNotNull(), c("_t"))
    df = df.withColumns(
        {
            "_proper": fn.closest_proper(c(left), usable, c(rotations)),
            "_any": fn.closest_any(c(left), usable, c(rotations)),
            "_pl": fn.project(c(left), c(rotations)), "_pr": fn.project(c("_t"), c(rotations)),
        }
    )
    df = df.selectExpr(
        "*", f"{fn.diff_norm(left, fn.negate('_t'))} < {fn.diff_norm(left, '_t')} AS _flip",
        f"({fn.norm('_pl')} + {fn.norm('_pr')}) / ({fn.norm(left)} + {fn.norm('_t')} + 1e-12D) AS _kept",
    )
    items = [
        ("exact_transported", left, "_t", "1D", "false"), ("proper_orbit", left, "_proper", "1D", "false"),
        ("domain_aware", left, f"IF(_flip, {fn.negate('_t')}, _t)", "1D", "_flip"),
        ("point_group_equivalent", left, "_any", "1D", "false"), ("symmetry_projected", "_pl", "_pr", "_kept", "false"),
    ]
    structs = ", ".join(
        f"named_struct('variant', '{n}', '_a', {a}, '_b', {b}, 'norm_retention', {k}, 'polar_domain_flip', {f})"
        for n, a, b, k, f in items
    )
    long = df.selectExpr(*keep, f"`{rotation}` IS NOT NULL AS rotation_available", f"inline(array({structs}))")
    long = long.selectExpr(
        *keep, "variant", *fn.discrepancy("_a", "_b"), "rotation_available", "polar_domain_flip", "norm_retention"
    )
    gap = f"abs({fn.norm(left)} - {fn.norm('_t')})"
    native = df.selectExpr(
        *keep, "'source_native_invariant' AS variant", f"{gap} AS absolute",
        f"2 * {gap} / ({fn.norm(left)} + {fn.norm('_t')} + 1e-12D) AS normalized", "0D AS sign_flip_fraction",
        "1D AS cosine_similarity", f"{fn.amplitude_ratio(left, '_t')} AS amplitude_ratio",
        f"`{rotation}` IS NOT NULL AS rotation_available", "false AS polar_domain_flip", "1D AS norm_retention",
    )
    return native.unionByName(long)


def rigid_alignment(points: DataFrame, pair: list[str], p: list[str], q: list[str]) -> DataFrame:
    """Best proper and improper rotation taking point set q onto p per pair, with the RMS of each.

    The sums that define the problem are plain aggregates, so a pair may have any number of points; one 3x3
    decomposition per pair follows. RMS is over coordinates: the mean squared distance per axis, square root.
    """
    sums = [f"sum({a}) AS _s{a}" for a in (*p, *q)]
    sums += [f"sum({b} * {a}) AS _h{j}{i}" for j, b in enumerate(q) for i, a in enumerate(p)]
    sums += [f"sum({' + '.join(f'{a} * {a}' for a in p)}) AS _pp", f"sum({' + '.join(f'{b} * {b}' for b in q)}) AS _qq"]
    agg = points.groupBy(*pair).agg(F.expr("count(*) AS n"), *[F.expr(s) for s in sums])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.select(*pair).schema)
    schema += ", n bigint, rotation_proper array<double>, rotation_improper array<double>, rms_proper double, rms_improper double"

    def solve(batches):
        for b in batches:
            n = b["n"].to_numpy(dtype=np.float64)
            sp = b[[f"_s{a}" for a in p]].to_numpy(dtype=np.float64)
            sq = b[[f"_s{a}" for a in q]].to_numpy(dtype=np.float64)
            h = b[[f"_h{j}{i}" for j in range(3) for i in range(3)]].to_numpy(dtype=np.float64).reshape(-1, 3, 3)
            h = h - sq[:, :, None] * sp[:, None, :] / n[:, None, None]
            spread = b["_pp"] - (sp**2).sum(1) / n + b["_qq"] - (sq**2).sum(1) / n
            u, s, vt = np.linalg.svd(h)
            sign = np.sign(np.linalg.det(vt.transpose(0, 2, 1) @ u.transpose(0, 2, 1)))
            out = b[[*pair, "n"]].copy()
            for name, want in (("proper", 1.0), ("improper", -1.0)):
                flip = np.ones((len(b), 3))
                flip[:, 2] = sign * want
                r = (vt.transpose(0, 2, 1) * flip[:, None, :]) @ u.transpose(0, 2, 1)
                left = np.clip(spread.to_numpy() - 2 * (s * flip).sum(1), 0.0, None)
                out[f"rotation_{name}"] = list(r.reshape(-1, 9))
                out[f"rms_{name}"] = np.sqrt(left / (3 * n))
            yield out[[*pair, "n", "rotation_proper", "rotation_improper", "rms_proper", "rms_improper"]]

    return agg.mapInPandas(solve, schema)


def soft_modes(df: DataFrame, eigen: str, born: str, strain: str, total: str, ionic: str, vectors: str | None = None):
    """Sensitivity features from eigenvalues and factor arrays; null features where an optical mode is unstable.

    The three largest eigenvalues are translations. With ``vectors`` (per mode a flat array over atoms and axes, in
    eigenvalue order) the mode-resolved charge vectors give the summed softness.
    """
    df = df.selectExpr("*", f"array_sort({eigen}) AS _e").selectExpr("*", "slice(_e, 1, size(_e) - 3) AS _opt")
    ok = "size(_opt) > 0 AND forall(_opt, x -> x < 0)"
    out = df.selectExpr(
        "*", f"{ok} AS stable",
        f"IF({ok}, array_min(_opt), NULL) AS min_optical_eigenvalue",
        f"IF({ok}, array_max(_opt), NULL) AS max_optical_eigenvalue",
        f"IF({ok}, array_max(_opt) / (array_min(_opt) + 1e-12D), NULL) AS optical_condition_number",
        f"IF({ok}, {fn.norm(born)}, NULL) AS born_charge_norm", f"IF({ok}, {fn.norm(strain)}, NULL) AS internal_strain_norm",
        f"IF({ok}, {fn.norm(ionic)} / ({fn.norm(total)} + 1e-12D), NULL) AS ionic_fraction",
    )
    if vectors:
        # z_m[x] = sum over (atom, axis) of charge[atom, axis, x] * vector_m[atom, axis]
        dim = "aggregate(zip_with(v, filter({b}, (c, i) -> i % 3 = {x}), (p, q) -> p * q), 0D, (a, p) -> a + p)"
        z2 = " + ".join(f"pow({dim.format(b=born, x=x)}, 2)" for x in range(3))
        order = f"array_sort(zip_with({eigen}, {vectors}, (e, v) -> named_struct('e', e, 'v', v)), (a, b) -> CAST(sign(a.e - b.e) AS INT))"
        scale = f"IF(size({strain}) = 27, {fn.norm(strain)}, 1D)"
        soft = f"aggregate(slice({order}, 1, size({eigen}) - 3), 0D, (a, m) -> a + {scale} * m.z / pow(abs(m.e) + 1e-4D, 2))"
        order_z = order.replace("named_struct('e', e, 'v', v)", f"named_struct('e', e, 'z', sqrt({z2}))")
        out = out.selectExpr("*", f"IF({ok}, {soft.replace(order, order_z)}, NULL) AS s_soft")
    return out.drop("_e", "_opt")


def shape_audit(df: DataFrame, born: str, strain: str) -> DataFrame:
    """Shapes of nested arrays and whether the strain array resolves every atom."""
    atoms = f"size({born})"
    return df.selectExpr(
        "*", f"{atoms} AS n_atoms", f"concat_ws('x', size({strain}), size({strain}[0]), size({strain}[0][0])) AS strain_shape",
    ).selectExpr(
        "*", "strain_shape = concat_ws('x', n_atoms, 3, 6) AS full_candidate"
    )

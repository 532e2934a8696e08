"""Column functions on flat tensors: array<double> of 27 (rank 3), 18 (3x6), 9 (rotation) and 36 (6x6) values.

Index order is row-major. Functions that return text give SQL expressions; the others are Arrow UDFs that work on
whole batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The pair (j, k) behind each of the six columns xx, yy, zz, yz, xz, xy of the 3x6 form.
PAIRS = [(0, 0), (1, 1), (2, 2), (1, 2), (0, 2), (0, 1)]
# The same columns in the order xx, yy, zz, xy, yz, zx.
OTHER_ORDER = [0, 1, 2, 5, 3, 4]


def _column_of(j: int, k: int) -> int:
    return PAIRS.index((min(j, k), max(j, k)))


def _gather(v: str, index: list[int], size: int) -> str:
    items = ", ".join(f"{v}[{i}]" for i in index)
    return f"IF(size({v}) = {size}, array({items}), NULL)"


def to_3x6(t: str) -> str:
    """27 to 18 values, no factor on the shear columns."""
    return _gather(t, [9 * i + 3 * j + k for i in range(3) for j, k in PAIRS], 27)


def to_3x3x3(v: str) -> str:
    """18 to 27 values; inverse of ``to_3x6`` on tensors symmetric in the last two indices."""
    return _gather(v, [6 * i + _column_of(j, k) for i in range(3) for j in range(3) for k in range(3)], 18)


def strain_to_3x3x3(v: str) -> str:
    """18 to 27 values for strain-type columns, whose shear entries carry a factor 2."""
    return f"transform({to_3x3x3(v)}, (x, i) -> IF((i div 3) % 3 = i % 3, x, x / 2))"


def strain_to_3x6(t: str) -> str:
    return f"transform({to_3x6(t)}, (x, i) -> IF(i % 6 >= 3, x * 2, x))"


def reorder_3x6(v: str) -> str:
    return _gather(v, [6 * i + a for i in range(3) for a in OTHER_ORDER], 18)


def symmetrize(t: str) -> str:
    """Mean of the tensor and itself with the last two indices swapped."""
    swap = [9 * i + 3 * k + j for i in range(3) for j in range(3) for k in range(3)]
    return f"zip_with({t}, {_gather(t, swap, 27)}, (a, b) -> 0.5D * (a + b))"


def coalesce_tensor(full: str, reduced: str) -> str:
    """The 27-value form if well shaped, else the expanded 18-value form, else null."""
    return f"coalesce(IF(size({full}) = 27, {full}, NULL), {to_3x3x3(reduced)})"


def norm(t: str) -> str:
    return f"sqrt(aggregate({t}, 0D, (a, x) -> a + x * x))"


def diff_norm(a: str, b: str) -> str:
    return f"sqrt(aggregate(zip_with({a}, {b}, (x, y) -> (x - y) * (x - y)), 0D, (a, x) -> a + x))"


def shear_diff(a: str, b: str) -> str:
    """Norm of the difference in the shear columns of the 3x6 forms."""
    terms = [
        f"pow({a}[{9 * i + 3 * j + k}] - {b}[{9 * i + 3 * j + k}], 2)" for i in range(3) for j, k in PAIRS[3:]
    ]
    return f"sqrt({' + '.join(terms)})"


def dot(a: str, b: str) -> str:
    return f"aggregate(zip_with({a}, {b}, (x, y) -> x * y), 0D, (a, x) -> a + x)"


def normalized_difference(a: str, b: str, eps: float = 1e-6) -> str:
    return f"{diff_norm(a, b)} / (0.5D * ({norm(a)} + {norm(b)}) + {eps}D)"


def cosine(a: str, b: str) -> str:
    return f"{dot(a, b)} / ({norm(a)} * {norm(b)} + 1e-12D)"


def amplitude_ratio(a: str, b: str) -> str:
    return f"{norm(b)} / ({norm(a)} + 1e-12D)"


def sign_disagreement(a: str, b: str, floor: float = 1e-6) -> str:
    """Share of components with opposite sign among those not near zero on both sides; 0 if there are none."""
    pairs = f"filter(arrays_zip({a}, {b}), p -> abs(p['{a}']) > {floor}D OR abs(p['{b}']) > {floor}D)"
    bad = f"size(filter({pairs}, p -> p['{a}'] * p['{b}'] < 0))"
    return f"IF(size({pairs}) = 0, 0D, {bad} / CAST(size({pairs}) AS DOUBLE))"


def negate(t: str) -> str:
    return f"transform({t}, x -> -x)"


def discrepancy(left: str, right: str) -> list[str]:
    """The five pair measures, as named SQL expressions over two array columns."""
    return [
        f"{diff_norm(left, right)} AS absolute", f"{normalized_difference(left, right)} AS normalized",
        f"{sign_disagreement(left, right)} AS sign_flip_fraction", f"{cosine(left, right)} AS cosine_similarity",
        f"{amplitude_ratio(left, right)} AS amplitude_ratio",
    ]


def gram(v: str, kelvin: bool = False) -> list[str]:
    """The six distinct entries of A A' for a 3x6 matrix; ``kelvin`` weights the shear columns by 2."""
    weight = "(x, i) -> IF(i >= 3, 2 * x, x)" if kelvin else "(x, i) -> x"
    row = [f"slice({v}, {6 * i + 1}, 6)" for i in range(3)]
    return [
        f"aggregate(transform(zip_with({row[a]}, {row[b]}, (x, y) -> x * y), {weight}), 0D, (a, x) -> a + x)"
        for a, b in ((0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2))
    ]


def largest_eigenvalue(a: str, b: str, c: str, d: str, e: str, f: str) -> str:
    """Largest eigenvalue of [[a, d, e], [d, b, f], [e, f, c]] by the trigonometric closed form."""
    q = f"(({a} + {b} + {c}) / 3)"
    p = f"sqrt((pow({a} - {q}, 2) + pow({b} - {q}, 2) + pow({c} - {q}, 2) + 2 * ({d} * {d} + {e} * {e} + {f} * {f})) / 6)"
    x, y, z = f"({a} - {q})", f"({b} - {q})", f"({c} - {q})"
    det = f"({x} * ({y} * {z} - {f} * {f}) - {d} * ({d} * {z} - {f} * {e}) + {e} * ({d} * {f} - {y} * {e}))"
    r = f"greatest(-1D, least(1D, {det} / (2 * pow({p}, 3))))"
    return f"IF({p} = 0, {q}, {q} + 2 * {p} * cos(acos({r}) / 3))"


def with_top_singular(df, t: str, out: str, kelvin: bool = False):
    """Add the largest singular value of the 3x6 form of ``t`` (Kelvin-weighted after symmetrising, if asked)."""
    v = to_3x6(symmetrize(t) if not kelvin else "_sym")
    if kelvin:
        df = df.selectExpr("*", f"{symmetrize(t)} AS _sym")
    else:
        v = to_3x6(t)
    g = [f"_g{i}" for i in range(6)]
    df = df.selectExpr("*", f"{v} AS _v")
    df = df.selectExpr("*", *[f"{e} AS {n}" for e, n in zip(gram("_v", kelvin), g)])
    return df.selectExpr("*", f"sqrt(greatest(0D, {largest_eigenvalue(*g)})) AS `{out}`").drop("_v", "_sym", *g)


def trace(m: str) -> str:
    """Trace of a 3x3 (9 values), or sum of the first three of six."""
    return f"CASE size({m}) WHEN 9 THEN {m}[0] + {m}[4] + {m}[8] WHEN 6 THEN {m}[0] + {m}[1] + {m}[2] END"


_ARRAY = T.ArrayType(T.DoubleType())


def _stack(s: pd.Series, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the wanted length as one matrix, and which rows they are."""
    ok = np.array([v is not None and len(v) == size for v in s], dtype=bool)
    rows = [np.asarray(v, dtype=np.float64) for v in s[ok]]
    return (np.stack(rows) if rows else np.empty((0, size))), ok


def _spread(values: np.ndarray, ok: np.ndarray) -> pd.Series:
    out = pd.Series([None] * len(ok), dtype=object)
    out[np.flatnonzero(ok)] = pd.Series(list(values), index=np.flatnonzero(ok), dtype=object)
    return out


def _rotate(t: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Batch of rank-3 tensors in rotated axes, one index at a time."""
    t = t.reshape(-1, 3, 3, 3)
    r = r.reshape(-1, 3, 3)
    for _ in range(3):
        t = np.einsum("bil,blmn->bmni", r, t)
    return t.reshape(-1, 27)


@F.pandas_udf(_ARRAY)
def transport(t: pd.Series, r: pd.Series) -> pd.Series:
    """Tensor in rotated axes; unchanged where no rotation is given."""
    tensors, ok_t = _stack(t, 27)
    _, ok_r = _stack(r, 9)
    both = ok_t & ok_r
    out = _spread(tensors, ok_t)
    if both.any():
        moved = _rotate(_stack(t[both], 27)[0], _stack(r[both], 9)[0])
        out[np.flatnonzero(both)] = pd.Series(list(moved), index=np.flatnonzero(both), dtype=object)
    return out


@F.pandas_udf(_ARRAY)
def transport_axial(t: pd.Series, r: pd.Series) -> pd.Series:
    """Axial form: the polar transform times the determinant of the rotation."""
    a, ok_t = _stack(t, 27)
    _, ok_r = _stack(r, 9)
    both = ok_t & ok_r
    if not both.any():
        return pd.Series([None] * len(t), dtype=object)
    rot = _stack(r[both], 9)[0]
    moved = _rotate(_stack(t[both], 27)[0], rot) * np.linalg.det(rot.reshape(-1, 3, 3))[:, None]
    return _spread(moved, both)


def _each_rotation(t: pd.Series, sets: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All rotated copies, the copies' rotations, the first copy of each usable row, and which rows those are."""
    ok = np.array([v is not None and len(v) == 27 and s is not None and len(s) > 0 for v, s in zip(t, sets)], bool)
    counts = np.array([len(s) for s in sets[ok]], dtype=int)
    starts = np.concatenate(([0], np.cumsum(counts)[:-1])) if len(counts) else counts
    rots = np.array([np.asarray(r, dtype=np.float64) for s in sets[ok] for r in s]).reshape(-1, 9)
    base = np.repeat(_stack(t[ok], 27)[0], counts, axis=0) if len(counts) else np.empty((0, 27))
    return _rotate(base, rots), rots, starts, ok


@F.pandas_udf(_ARRAY)
def project(t: pd.Series, sets: pd.Series) -> pd.Series:
    """Average over a set of rotations, symmetrised in the last two indices; null without rotations."""
    copies, _, starts, ok = _each_rotation(t, sets)
    if not ok.any():
        return pd.Series([None] * len(t), dtype=object)
    counts = np.diff(np.append(starts, len(copies)))
    mean = (np.add.reduceat(copies, starts, axis=0) / counts[:, None]).reshape(-1, 3, 3, 3)
    return _spread((0.5 * (mean + mean.transpose(0, 1, 3, 2))).reshape(-1, 27), ok)


def _closest(left: pd.Series, right: pd.Series, sets: pd.Series, proper: bool) -> pd.Series:
    copies, rots, starts, ok = _each_rotation(right, sets)
    out = pd.Series([None] * len(left), dtype=object)
    ends = np.append(starts, len(copies))[1:]
    det = np.linalg.det(rots.reshape(-1, 3, 3)) if len(rots) else np.empty(0)
    for row, a, b in zip(np.flatnonzero(ok), starts, ends):
        gap = np.linalg.norm(copies[a:b] - np.asarray(left[row], dtype=np.float64), axis=1)
        gap = np.where(det[a:b] > 0, gap, np.inf) if proper else gap
        best = int(np.argmin(gap))
        if np.isfinite(gap[best]):
            out[row] = copies[a + best]
    return out


@F.pandas_udf(_ARRAY)
def closest_proper(left: pd.Series, right: pd.Series, sets: pd.Series) -> pd.Series:
    """The copy of ``right`` closest to ``left`` over the proper rotations of the row's set."""
    return _closest(left, right, sets, True)


@F.pandas_udf(_ARRAY)
def closest_any(left: pd.Series, right: pd.Series, sets: pd.Series) -> pd.Series:
    """The copy of ``right`` closest to ``left`` over all rotations of the row's set."""
    return _closest(left, right, sets, False)


@F.pandas_udf(T.ArrayType(_ARRAY))
def conjugate(sets: pd.Series, frame: pd.Series) -> pd.Series:
    """Rotations of a set seen from another frame: R G R^-1."""
    out = []
    for s, r in zip(sets, frame):
        if s is None or r is None or len(s) == 0:
            out.append(None)
            continue
        m = np.asarray(r, dtype=np.float64).reshape(3, 3)
        g = np.stack([np.asarray(x, dtype=np.float64) for x in s]).reshape(-1, 3, 3)
        out.append(list((m @ g @ np.linalg.inv(m)).reshape(-1, 9)))
    return pd.Series(out, dtype=object)


def _half_sphere(step: float) -> np.ndarray:
    """Directions on rings about ``step`` radians apart, from the pole to the equator: the scored form is odd."""
    rings = []
    for polar in np.arange(0.0, np.pi / 2 + step / 2, step):
        count = max(1, int(np.ceil(2 * np.pi * np.sin(polar) / step)))
        turn = 2 * np.pi * np.arange(count) / count
        flat = np.full(count, np.sin(polar))
        rings.append(np.stack((flat * np.cos(turn), flat * np.sin(turn), np.full(count, np.cos(polar))), axis=1))
    return np.concatenate(rings)


# The cubic form of a direction has ten monomials; each is fed by the components with those indices.
_MONOMIALS = sorted({tuple(sorted((i, j, k))) for i in range(3) for j in range(3) for k in range(3)})
_FEED = np.zeros((27, 10))
for _i in range(27):
    _FEED[_i, _MONOMIALS.index(tuple(sorted((_i // 9, _i // 3 % 3, _i % 3))))] = 1.0


def _monomials(d: np.ndarray) -> np.ndarray:
    return np.stack([d[..., a] * d[..., b] * d[..., c] for a, b, c in _MONOMIALS], axis=-1)


_GRID = _half_sphere(0.05)
_GRID_MONOMIALS = _monomials(_GRID)


def longitudinal_maximum(tensors: np.ndarray, starts: int = 4) -> np.ndarray:
    """max over unit n of |n_i e_ijk n_j n_k| for a batch.

    All directions of a grid are scored at once; around the best of them the patch is scanned again, ever finer.
    """
    coef = tensors @ _FEED
    score = np.abs(coef @ _GRID_MONOMIALS.T)
    best = np.take_along_axis(score, np.argpartition(-score, starts, axis=1)[:, :starts], axis=1).max(axis=1)
    seeds = np.argpartition(-score, starts, axis=1)[:, :starts]
    u, v = np.meshgrid(np.linspace(-1, 1, 7), np.linspace(-1, 1, 7))
    patch = np.stack((u.ravel(), v.ravel()), axis=1)
    for s in range(starts):
        d = _GRID[seeds[:, s]]
        width = 0.06
        for _ in range(9):
            helper = np.where(np.abs(d[:, :1]) < 0.9, [[1.0, 0.0, 0.0]], [[0.0, 1.0, 0.0]])
            e1 = np.cross(d, helper)
            e1 /= np.linalg.norm(e1, axis=1, keepdims=True)
            e2 = np.cross(d, e1)
            near = d[:, None] + width * (patch[:, :1] * e1[:, None] + patch[:, 1:] * e2[:, None])
            near /= np.linalg.norm(near, axis=2, keepdims=True)
            val = np.abs(np.einsum("bpm,bm->bp", _monomials(near), coef))
            top = val.argmax(axis=1)
            d = near[np.arange(len(d)), top]
            best = np.maximum(best, val.max(axis=1))
            width /= 2.5
    return best


@F.pandas_udf(T.DoubleType())
def max_longitudinal(t: pd.Series) -> pd.Series:
    out = pd.Series(np.nan, index=range(len(t)))
    a, ok = _stack(t, 27)
    for lo in range(0, len(a), 2048):
        out[np.flatnonzero(ok)[lo : lo + 2048]] = longitudinal_maximum(a[lo : lo + 2048])
    return out


def _inverse(m: np.ndarray) -> np.ndarray:
    """Batch inverse; singular matrices come back as NaN."""
    out = np.full_like(m, np.nan)
    good = np.abs(np.linalg.det(m)) > 0
    out[good] = np.linalg.inv(m[good])
    return out


@F.pandas_udf(T.DoubleType())
def bulk_modulus(c: pd.Series) -> pd.Series:
    """Mean of the Voigt and Reuss bulk moduli of a 6x6 stiffness."""
    out = pd.Series(np.nan, index=range(len(c)))
    a, ok = _stack(c, 36)
    if ok.any():
        m = a.reshape(-1, 6, 6)

        def block(x: np.ndarray) -> np.ndarray:
            return x[:, 0, 0] + x[:, 1, 1] + x[:, 2, 2] + 2 * (x[:, 0, 1] + x[:, 1, 2] + x[:, 0, 2])

        out[np.flatnonzero(ok)] = 0.5 * (block(m) / 9.0 + 1.0 / block(_inverse(m)))
    return out


@F.pandas_udf(T.DoubleType())
def compliance_norm(t: pd.Series, c: pd.Series) -> pd.Series:
    """Norm of the 3x3x3 form of e C^-1 from the 3x6 form of e."""
    out = pd.Series(np.nan, index=range(len(t)))
    _, ok_t = _stack(t, 27)
    _, ok_c = _stack(c, 36)
    ok = ok_t & ok_c
    if ok.any():
        e = _stack(t[ok], 27)[0].reshape(-1, 3, 3, 3)
        v = np.stack([e[:, :, j, k] for j, k in PAIRS], axis=2)
        d = v @ _inverse(_stack(c[ok], 36)[0].reshape(-1, 6, 6)).transpose(0, 2, 1)
        # off-diagonal entries appear twice in the full tensor
        out[np.flatnonzero(ok)] = np.sqrt((d**2 * np.array([1, 1, 1, 2, 2, 2])).sum(axis=(1, 2)))
    return out



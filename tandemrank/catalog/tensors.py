"""Tensor codecs, scores, discrepancies, symmetry residuals, alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from tandemrank.catalog.registry import query, r9, rounded
from tandemrank.catalog.views import table, tensors
from tandemrank.functions import tensors as fn
from tandemrank.operators import tensors as ops

T_SQL = """
tens AS (SELECT vec_id AS id, CAST(label AS VARCHAR) AS grp, CAST(embedding[1:27] AS DOUBLE[]) AS t,
                CAST(embedding[28:63] AS DOUBLE[]) AS c FROM embeddings),
tp AS (SELECT a.id, a.grp, a.t, b.t AS u, [cos(radians(a.id)), -sin(radians(a.id)), 0.0, sin(radians(a.id)), cos(radians(a.id)), 0.0, 0.0, 0.0, 1.0] AS r
       FROM tens a JOIN tens b ON b.id = a.id + 1)"""
ROTATION = (
    "array(cos(radians(id)), -sin(radians(id)), 0D, sin(radians(id)), cos(radians(id)), 0D, 0D, 0D, 1D)"
)
# Four turns about the third axis, and the same four with all axes reversed.
TURNS = [
    [1, 0, 0, 0, 1, 0, 0, 0, 1], [0, -1, 0, 1, 0, 0, 0, 0, 1], [-1, 0, 0, 0, -1, 0, 0, 0, 1], [0, 1, 0, -1, 0, 0, 0, 0, 1],
]
FULL = TURNS + [[-x for x in r] for r in TURNS]


def sets_text(rots) -> str:
    return "array(" + ", ".join("array(" + ", ".join(f"{x}D" for x in r) + ")" for r in rots) + ")"


def with_stiffness(spark, sf):
    return table(spark, sf, "embeddings").selectExpr(
        "vec_id AS id", "CAST(slice(embedding, 1, 27) AS ARRAY<DOUBLE>) AS t",
        "CAST(slice(embedding, 28, 36) AS ARRAY<DOUBLE>) AS c",
    )


def tensor_pairs(spark, sf):
    t = tensors(spark, sf)
    return t.join(t.selectExpr("id - 1 AS id", "t AS u"), "id").selectExpr("*", f"{ROTATION} AS r")


def nsql(x: str) -> str:
    return f"sqrt(list_sum([v * v for v in {x}]))"


def dsql(a: str, b: str) -> str:
    return f"sqrt(list_sum([({a}[i] - {b}[i]) * ({a}[i] - {b}[i]) for i in range(1, 28)]))"


def disc_sql(a: str, b: str) -> str:
    big = f"[i for i in range(1, 28) if abs({a}[i]) > 1e-6 OR abs({b}[i]) > 1e-6]"
    return f"""round({dsql(a, b)}, 9) + 0.0 AS absolute, round({dsql(a, b)} / (0.5 * ({nsql(a)} + {nsql(b)}) + 1e-6), 9) + 0.0 AS normalized,
      round(coalesce(len([i for i in range(1, 28) if {a}[i] * {b}[i] < 0 AND (abs({a}[i]) > 1e-6 OR abs({b}[i]) > 1e-6)]) / nullif(len({big}), 0), 0.0), 9) + 0.0 AS sign_flip_fraction,
      round(list_dot_product({a}, {b}) / ({nsql(a)} * {nsql(b)} + 1e-12), 9) + 0.0 AS cosine_similarity,
      round({nsql(b)} / ({nsql(a)} + 1e-12), 9) + 0.0 AS amplitude_ratio"""


MEASURES = ["absolute", "normalized", "sign_flip_fraction", "cosine_similarity", "amplitude_ratio"]


def rotate_sql(src: str, e: str, r: str, keep: str, name: str) -> str:
    """Three contractions, each over the first index, which moves to the end."""
    def step(a: str) -> str:
        return f"[{r}[3 * (x % 3) + 1] * {a}[x // 3 + 1] + {r}[3 * (x % 3) + 2] * {a}[9 + x // 3 + 1] + {r}[3 * (x % 3) + 3] * {a}[18 + x // 3 + 1] for x in range(27)]"

    return f"""
{name}_1 AS (SELECT {keep}, {r}, {step(e)} AS e1 FROM {src}),
{name}_2 AS (SELECT {keep}, {r}, {step('e1')} AS e2 FROM {name}_1),
{name} AS (SELECT {keep}, {step('e2')} AS moved FROM {name}_2)"""


V_SQL = "flatten([[t[9*i+1], t[9*i+5], t[9*i+9], t[9*i+6], t[9*i+3], t[9*i+2]] for i in range(3)])"
S_SQL = "[0.5 * (t[x + 1] + t[9 * (x // 9) + 3 * (x % 3) + (x // 3) % 3 + 1]) for x in range(27)]"


@query(
    "tensor_codec",
    f"""WITH {T_SQL}, v AS (SELECT id, t, {V_SQL} AS v FROM tens),
    b AS (SELECT id, v, flatten([[v[6*i+1], v[6*i+6], v[6*i+5], v[6*i+6], v[6*i+2], v[6*i+4], v[6*i+5], v[6*i+4], v[6*i+3]] for i in range(3)]) AS b FROM v)
    SELECT id, round(list_sum([v[i] * i for i in range(1, 19)]), 9) + 0.0 AS v_check, round(list_sum([b[i] * i for i in range(1, 28)]), 9) + 0.0 AS full_check,
      round(list_sum([v[i] for i in range(4, 7)]) * 2 + v[1] + v[2] + v[3], 9) + 0.0 AS strain_row,
      true AS reordered FROM b""",
)
def _(spark, sf):
    df = tensors(spark, sf).selectExpr("id", f"{fn.to_3x6('t')} AS v", f"{fn.strain_to_3x6('t')} AS s")
    df = df.selectExpr("*", f"{fn.to_3x3x3('v')} AS b", f"{fn.reorder_3x6('v')} AS o")
    check = "aggregate(transform({x}, (e, i) -> e * (i + 1)), 0D, (a, e) -> a + e)"
    return df.selectExpr(
        "id", f"round({check.format(x='v')}, 9) + 0D AS v_check", f"round({check.format(x='b')}, 9) + 0D AS full_check",
        "round(s[0] + s[1] + s[2] + s[3] + s[4] + s[5], 9) + 0D AS strain_row",
        "array(o[3], o[4], o[5]) = array(v[5], v[3], v[4]) AS reordered",
    )


@query(
    "tensor_coalesce",
    f"""WITH {T_SQL} SELECT id, CASE id % 3 WHEN 0 THEN round(list_sum(t), 9) + 0.0 WHEN 1 THEN
      round(list_sum([t[6*i+1] + t[6*i+2] + t[6*i+3] + 2 * (t[6*i+4] + t[6*i+5] + t[6*i+6]) for i in range(3)]), 9) + 0.0 END AS total FROM tens""",
)
def _(spark, sf):
    df = tensors(spark, sf).selectExpr(
        "id", "IF(id % 3 = 0, t, slice(t, 1, 5)) AS full", "CASE id % 3 WHEN 1 THEN slice(t, 1, 18) WHEN 2 THEN slice(t, 1, 4) END AS reduced"
    )
    df = df.selectExpr("id", f"{fn.coalesce_tensor('full', 'reduced')} AS t")
    return df.selectExpr("id", "round(aggregate(t, 0D, (a, x) -> a + x), 9) + 0D AS total")


def eig_sql(g: list[str]) -> str:
    a, b, c, d, e, f = g
    q = f"(({a} + {b} + {c}) / 3)"
    p = f"sqrt((pow({a} - {q}, 2) + pow({b} - {q}, 2) + pow({c} - {q}, 2) + 2 * ({d} * {d} + {e} * {e} + {f} * {f})) / 6)"
    det = f"(({a} - {q}) * (({b} - {q}) * ({c} - {q}) - {f} * {f}) - {d} * ({d} * ({c} - {q}) - {f} * {e}) + {e} * ({d} * {f} - ({b} - {q}) * {e}))"
    return f"{q} + 2 * {p} * cos(acos(greatest(-1.0, least(1.0, {det} / (2 * pow({p}, 3))))) / 3)"


def grams_sql(v: str, w: str) -> str:
    pairs = [(0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2)]
    return ", ".join(
        f"list_sum([{v}[{6 * i} + x] * {v}[{6 * j} + x] * {w} for x in range(1, 7)]) AS g{n}" for n, (i, j) in enumerate(pairs)
    )


@query(
    "tensor_scores",
    f"""WITH {T_SQL}, v AS (SELECT id, t, {V_SQL} AS v, {S_SQL} AS s FROM tens),
    sv AS (SELECT id, t, v, flatten([[s[9*i+1], s[9*i+5], s[9*i+9], s[9*i+6], s[9*i+3], s[9*i+2]] for i in range(3)]) AS sv FROM v),
    g AS (SELECT id, t, sv, {grams_sql('v', '1')} FROM sv), e AS (SELECT id, t, sv, sqrt({eig_sql([f'g{i}' for i in range(6)])}) AS top FROM g),
    h AS (SELECT id, t, top, {grams_sql('sv', '(CASE WHEN x > 3 THEN 2 ELSE 1 END)')} FROM e)
    SELECT id, round({nsql('t')}, 9) + 0.0 AS frobenius, round(top, 8) + 0.0 AS top_singular,
           round(sqrt({eig_sql([f'g{i}' for i in range(6)])}), 8) + 0.0 AS kelvin FROM h""",
)
def _(spark, sf):
    df = tensors(spark, sf).selectExpr("id", "t", f"{fn.norm('t')} AS frobenius")
    df = fn.with_top_singular(fn.with_top_singular(df, "t", "top_singular"), "t", "kelvin", kelvin=True)
    return rounded(df.select("id", r9("frobenius").alias("frobenius"), "top_singular", "kelvin"), "top_singular", "kelvin", digits=8)


@query("tensor_score_table")
def _(spark, sf):
    return ops.score_table(tensors(spark, sf)).drop("t")


@query("longitudinal_maximum")
def _(spark, sf):
    return tensors(spark, sf).select("id", fn.max_longitudinal("t").alias("longitudinal"))


@query("longitudinal_axial", "SELECT vec_id AS id, round(abs(CAST(embedding[4] AS DOUBLE)), 5) + 0.0 AS longitudinal FROM embeddings")
def _(spark, sf):
    """Axial tensors a n n n, whose maximum over directions is |a|."""
    norm = "sqrt(aggregate(slice(embedding, 1, 3), 0D, (s, x) -> s + CAST(x AS DOUBLE) * x))"
    rows = table(spark, sf, "embeddings").selectExpr("vec_id AS id", "CAST(embedding[3] AS DOUBLE) AS a", f"transform(slice(embedding, 1, 3), x -> x / {norm}) AS n")
    axial = rows.selectExpr("id", "transform(sequence(0, 26), i -> a * n[i div 9] * n[(i div 3) % 3] * n[i % 3]) AS t")
    return rounded(axial.select("id", fn.max_longitudinal("t").alias("longitudinal")), "longitudinal", digits=5)


@query("stiffness_scalars")
def _(spark, sf):
    df = with_stiffness(spark, sf)
    return df.select("id", fn.bulk_modulus("c").alias("bulk_modulus"), fn.compliance_norm("t", "c").alias("d_norm"))


@query(
    "tensor_traces",
    f"""WITH {T_SQL} SELECT id, round(CASE WHEN id % 2 = 0 THEN t[1] + t[5] + t[9] ELSE t[1] + t[2] + t[3] END, 9) + 0.0 AS trace,
        round(abs(t[1]) / (id % 7 + 1), 9) + 0.0 AS volume_per_unit FROM tens""",
)
def _(spark, sf):
    df = tensors(spark, sf).selectExpr("id", "t", "IF(id % 2 = 0, slice(t, 1, 9), slice(t, 1, 6)) AS m")
    return df.selectExpr(
        "id", f"round({fn.trace('m')}, 9) + 0D AS trace", "round(abs(t[0]) / (id % 7 + 1), 9) + 0D AS volume_per_unit"
    )


@query(
    "lineage_audit",
    f"""WITH {T_SQL}, v AS (SELECT id, t, {V_SQL} AS v FROM tens),
    b AS (SELECT id, t, flatten([[v[6*i+1], v[6*i+6], v[6*i+5], v[6*i+6], v[6*i+2], v[6*i+4], v[6*i+5], v[6*i+4], v[6*i+3]] for i in range(3)]) AS b FROM v),
    s AS (SELECT id, b, CASE WHEN id % 2 = 0 THEN b ELSE t END AS t FROM b)
    SELECT id, round({dsql('b', 't')}, 9) + 0.0 AS diff_trusted_stored, round({dsql('b', 't')} / greatest({nsql('t')}, 1e-12), 9) + 0.0 AS relative_trusted_stored,
      round(sqrt(list_sum([pow(b[9*i+6]-t[9*i+6],2) + pow(b[9*i+3]-t[9*i+3],2) + pow(b[9*i+2]-t[9*i+2],2) for i in range(3)])), 9) + 0.0 AS shear_trusted_stored,
      CASE WHEN {dsql('b', 't')} < 1e-6 THEN 'verified' ELSE 'mismatch' END AS status FROM s""",
)
def _(spark, sf):
    df = tensors(spark, sf).selectExpr("id", "t", f"{fn.to_3x6('t')} AS v").selectExpr("*", f"{fn.to_3x3x3('v')} AS b")
    df = df.selectExpr("id", "b AS trusted", "b AS project", "IF(id % 2 = 0, b, t) AS stored")
    out = ops.lineage_audit(df, "trusted", "project", "stored")
    return rounded(
        out.select("id", "diff_trusted_stored", "relative_trusted_stored", "shear_trusted_stored", "status"),
        "diff_trusted_stored", "relative_trusted_stored", "shear_trusted_stored",
    )


@query("pair_discrepancy", f"WITH {T_SQL} SELECT id, {disc_sql('t', 'u')} FROM tp")
def _(spark, sf):
    return rounded(tensor_pairs(spark, sf).selectExpr("id", *fn.discrepancy("t", "u")), *MEASURES)


@query(
    "transport",
    f"""WITH {T_SQL}, {rotate_sql('tp', 'u', 'r', 'id, t', 'mv')} SELECT id, {disc_sql('t', 'moved')}, true AS rotation_available FROM mv""",
)
def _(spark, sf):
    out = ops.exact_transported(tensor_pairs(spark, sf), "t", "u", "r")
    return rounded(out.select("id", *MEASURES, "rotation_available"), *MEASURES)


@query("transport_axial", f"""WITH {T_SQL}, neg AS (SELECT id, t, u, [-x for x in r] AS r FROM tp), {rotate_sql('neg', 'u', 'r', 'id, t', 'mv')}
    SELECT id, round(-list_sum([moved[i] * i for i in range(1, 28)]), 8) + 0.0 AS check_sum FROM mv""")
def _(spark, sf):
    df = tensor_pairs(spark, sf).selectExpr("id", "u", "transform(r, x -> -x) AS r")
    df = df.withColumn("m", fn.transport_axial("u", "r"))
    return df.selectExpr("id", "round(aggregate(transform(m, (e, i) -> e * (i + 1)), 0D, (a, e) -> a + e), 8) + 0D AS check_sum")


@query(
    "domain_aware",
    f"""WITH {T_SQL}, {rotate_sql('tp', 'u', 'r', 'id, t', 'mv')},
    n AS (SELECT id, t, moved, [-x for x in moved] AS neg FROM mv),
    f AS (SELECT id, t, {dsql('t', 'neg')} < {dsql('t', 'moved')} AS flip, moved, neg FROM n), g AS (SELECT id, t, flip, CASE WHEN flip THEN neg ELSE moved END AS w FROM f)
    SELECT id, flip AS polar_domain_flip, {disc_sql('t', 'w')} FROM g""",
)
def _(spark, sf):
    out = ops.domain_aware(tensor_pairs(spark, sf), "t", "u", "r")
    return rounded(out.select("id", "polar_domain_flip", *MEASURES), *MEASURES)




def orbit_sql(rots) -> str:
    text = str([[float(x) for x in r] for r in rots])
    return f"""WITH {T_SQL}, rs AS (SELECT id, t, u, unnest({text}) AS g FROM tp), {rotate_sql('rs', 'u', 'g', 'id, t', 'mv')},
    d AS (SELECT id, {dsql('t', 'moved')} AS d FROM mv) SELECT id, round(min(d), 9) + 0.0 AS absolute FROM d GROUP BY id"""


@query("orbit_proper", orbit_sql(TURNS))
def _(spark, sf):
    df = tensor_pairs(spark, sf).selectExpr("*", f"{sets_text(FULL)} AS g")
    df = df.withColumn("w", fn.closest_proper("t", "u", "g"))
    return df.selectExpr("id", f"round({fn.diff_norm('t', 'w')}, 9) + 0D AS absolute")


@query("orbit_full", orbit_sql(FULL))
def _(spark, sf):
    df = tensor_pairs(spark, sf).selectExpr("*", f"{sets_text(FULL)} AS g")
    df = df.withColumn("w", fn.closest_any("t", "u", "g"))
    return df.selectExpr("id", f"round({fn.diff_norm('t', 'w')}, 9) + 0D AS absolute")


def project_sql(e: str) -> str:
    text = str([[float(x) for x in r] for r in TURNS])
    return f"""rs AS (SELECT id, {e} AS e, unnest({text}) AS g FROM tp), {rotate_sql('rs', 'e', 'g', 'id, e', 'mv')},
    comp AS (SELECT id, any_value(e) AS e, x, avg(moved[x]) AS m FROM mv, range(1, 28) t(x) GROUP BY id, x),
    mean AS (SELECT id, any_value(e) AS e, list(m ORDER BY x) AS m FROM comp GROUP BY id),
    proj AS (SELECT id, e, [0.5 * (m[x + 1] + m[9 * (x // 9) + 3 * (x % 3) + (x // 3) % 3 + 1]) for x in range(27)] AS p FROM mean)"""


@query(
    "group_projection",
    f"""WITH {T_SQL}, {project_sql('t')} SELECT id, round({dsql('e', 'p')}, 9) + 0.0 AS native_residual_raw,
      round({dsql('e', 'p')} / ({nsql('e')} + 1e-12), 9) + 0.0 AS native_residual_normalized, round({nsql('p')} / ({nsql('e')} + 1e-12), 9) + 0.0 AS native_norm_retention FROM proj""",
)
def _(spark, sf):
    df = tensor_pairs(spark, sf).selectExpr("id", "t", f"{sets_text(TURNS)} AS g")
    out = ops.residuals(df, "t", "g", "native").drop("t", "g")
    return rounded(out, *[c for c in out.columns if c != "id"])


@query(
    "allowed_components",
    f"""WITH {T_SQL}, pr AS (SELECT grp, c AS component, [CASE WHEN y = c OR y = 9 * (c // 9) + 3 * (c % 3) + (c // 3) % 3 THEN 1.0 ELSE 0.0 END for y in range(27)] AS e
       FROM (SELECT DISTINCT grp FROM tens), range(27) r(c)),
    rs AS (SELECT grp, component, e, unnest({[[float(x) for x in r] for r in TURNS]}) AS g FROM pr), {rotate_sql('rs', 'e', 'g', 'grp, component', 'mv')},
    m AS (SELECT grp, component, x, avg(moved[x]) AS m FROM mv, range(1, 28) t(x) GROUP BY ALL), l AS (SELECT grp, component, list(m ORDER BY x) AS m FROM m GROUP BY ALL)
    SELECT grp, CAST(component AS INT) AS component, list_sum([pow(0.5 * (m[x + 1] + m[9 * (x // 9) + 3 * (x % 3) + (x // 3) % 3 + 1]), 2) for x in range(27)]) > 1e-16 AS allowed FROM l""",
)
def _(spark, sf):
    """Components that survive the projection, from unit probes of every tensor's index pairs."""
    df = tensors(spark, sf).selectExpr("grp", f"{sets_text(TURNS)} AS g").groupBy("grp").agg(F.first("g").alias("g"))
    df = df.selectExpr(
        "*", "inline(transform(sequence(0, 26), x -> named_struct('component', x, 'probe', "
        "transform(sequence(0, 26), y -> IF(y = x OR y = 9 * (x div 9) + 3 * (x % 3) + (x div 3) % 3, 1D, 0D)))))"
    ).withColumn("p", fn.project("probe", "g"))
    return df.selectExpr("grp", "component", f"{fn.norm('p')} > 1e-8 AS allowed")


@query("native_residuals")
def _(spark, sf):
    df = tensor_pairs(spark, sf).selectExpr(
        "*", f"{sets_text(TURNS)} AS gl", f"IF(id % 5 = 0, NULL, {sets_text(FULL)}) AS gr"
    )
    return ops.native_residuals(df, ["id", "grp"], "t", "u", "gl", "gr", "r")


@query("discrepancy_hierarchy")
def _(spark, sf):
    df = tensor_pairs(spark, sf).selectExpr("*", f"{sets_text(FULL)} AS g")
    return ops.hierarchy(df, ["id", "grp"], "t", "u", "g", "r")


@query("rigid_alignment")
def _(spark, sf):
    """Each vector's first 63 values as 21 points, aligned with those of the next vector."""
    e = table(spark, sf, "embeddings").selectExpr("vec_id AS id", "embedding AS e")
    pairs = e.join(e.selectExpr("id - 1 AS id", "e AS f"), "id")
    pts = pairs.selectExpr(
        "id", "inline(transform(sequence(0, 20), k -> named_struct('px', double(e[3 * k]), 'py', double(e[3 * k + 1]), "
        "'pz', double(e[3 * k + 2]), 'qx', double(f[3 * k]), 'qy', double(f[3 * k + 1]), 'qz', double(f[3 * k + 2]))))"
    )
    return ops.rigid_alignment(pts, ["id"], ["px", "py", "pz"], ["qx", "qy", "qz"])


@query(
    "soft_modes",
    """WITH e AS (SELECT vec_id AS id, CAST(embedding[1:9] AS DOUBLE[]) AS x, CAST(embedding[10:18] AS DOUBLE[]) AS born, CAST(embedding[19:45] AS DOUBLE[]) AS st,
        [-abs(v) - 0.001 for v in CAST(embedding[1:9] AS DOUBLE[])] AS ev FROM embeddings),
    o AS (SELECT *, list_sort(ev)[1:6] AS opt FROM e)
    SELECT id, true AS stable, list_min(opt) AS min_optical_eigenvalue, list_max(opt) AS max_optical_eigenvalue,
      round(list_max(opt) / (list_min(opt) + 1e-12), 9) + 0.0 AS optical_condition_number,
      round(sqrt(list_sum([v * v for v in born])), 9) + 0.0 AS born_charge_norm, round(sqrt(list_sum([v * v for v in st])), 9) + 0.0 AS internal_strain_norm,
      round(sqrt(list_sum([v * v for v in born])) / (sqrt(list_sum([v * v for v in st])) + 1e-12), 9) + 0.0 AS ionic_fraction FROM o""",
)
def _(spark, sf):
    df = table(spark, sf, "embeddings").selectExpr(
        "vec_id AS id", "transform(slice(embedding, 1, 9), v -> -abs(double(v)) - 0.001D) AS ev",
        "CAST(slice(embedding, 10, 9) AS ARRAY<DOUBLE>) AS born", "CAST(slice(embedding, 19, 27) AS ARRAY<DOUBLE>) AS st",
    )
    out = ops.soft_modes(df, "ev", "born", "st", "st", "born").drop("ev", "born", "st")
    return rounded(out, "optical_condition_number", "born_charge_norm", "internal_strain_norm", "ionic_fraction")


@query("soft_mode_sum")
def _(spark, sf):
    """Two atoms, six modes: charges of 18 values and one six-vector per mode."""
    df = table(spark, sf, "embeddings").selectExpr(
        "vec_id AS id", "transform(slice(embedding, 1, 6), v -> -abs(double(v)) - 0.001D) AS ev",
        "CAST(slice(embedding, 7, 18) AS ARRAY<DOUBLE>) AS born", "CAST(slice(embedding, 25, 27) AS ARRAY<DOUBLE>) AS st",
        "transform(sequence(0, 5), m -> transform(slice(embedding, 1 + 6 * m, 6), v -> double(v))) AS vec",
    )
    return ops.soft_modes(df, "ev", "born", "st", "st", "born", "vec").select("id", "stable", "s_soft")


@query(
    "shape_audit",
    """WITH s AS (SELECT vec_id AS id, label % 3 + 2 AS k FROM embeddings)
    SELECT k || 'x3x' || CASE WHEN id % 2 = 0 THEN 6 ELSE 3 END AS strain_shape, id % 2 = 0 AS full_candidate, count(*) AS n
    FROM s GROUP BY ALL""",
)
def _(spark, sf):
    df = table(spark, sf, "embeddings").selectExpr("vec_id AS id", "embedding AS e", "label % 3 + 2 AS k").selectExpr(
        "id", "transform(sequence(1, k), a -> slice(e, a, 9)) AS born",
        "transform(sequence(1, k), a -> transform(sequence(1, 3), b -> slice(e, a + b, IF(id % 2 = 0, 6, 3)))) AS strain",
    )
    return ops.shape_audit(df, "born", "strain").groupBy("strain_shape", "full_candidate").agg(F.count("*").alias("n"))

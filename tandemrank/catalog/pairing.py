"""Formula and scalar preparers, pairing, panels, splits, reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tandemrank.catalog.registry import query, rounded
from tandemrank.catalog.resampling import h_sql
from tandemrank.catalog.views import FINITE, LONG, long_pairs, table
from tandemrank.functions import formula as fm
from tandemrank.functions import scalars as sc
from tandemrank.operators import pairing
from tandemrank.session import materialize

# Formulas built from the part table: two or three elements with amounts that follow from the key and size.
ELEMENTS = ["Na", "Cl", "Li", "Se", "Co", "S", "Ho", "O", "Ba", "F", "Te", "N"]
_E = "array(" + ", ".join(f"'{e}'" for e in ELEMENTS) + ")"
_D = "[" + ", ".join(f"'{e}'" for e in ELEMENTS) + "]"
AMOUNT = "CASE {x} WHEN 0 THEN '' ELSE CAST({x} + 1 AS {t}) END"


def formulas(spark, sf):
    amount = [AMOUNT.format(x=x, t="STRING") for x in ("p_size % 4", "(p_partkey % 3) * 2", "p_partkey % 5")]
    return table(spark, sf, "part").selectExpr(
        "p_partkey AS id",
        f"""CASE WHEN p_partkey % 97 = 0 THEN 'x?' ELSE concat({_E}[p_partkey % 12], {amount[0]}, {_E}[(p_partkey div 12 + 5) % 12], {amount[1]},
            IF(p_size % 2 = 0, concat({_E}[(p_size + 3) % 12], {amount[2]}), '')) END AS formula""",
    )


_AM = [AMOUNT.format(x=x, t="VARCHAR") for x in ("(p_size % 4)", "((p_partkey % 3) * 2)", "(p_partkey % 5)")]
FORMULAS = f"""
forms AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 97 = 0 THEN 'x?' ELSE {_D}[p_partkey % 12 + 1] || {_AM[0]} || {_D}[(p_partkey // 12 + 5) % 12 + 1] || {_AM[1]} ||
   CASE WHEN p_size % 2 = 0 THEN {_D}[(p_size + 3) % 12 + 1] || {_AM[2]} ELSE '' END END AS formula FROM part),
toks AS (SELECT id, formula, unnest(regexp_extract_all(formula, '{fm.TOKEN}', 1)) AS e, unnest(regexp_extract_all(formula, '{fm.TOKEN}', 2)) AS a FROM forms WHERE formula <> 'x?'),
cnt AS (SELECT id, e, sum(CASE WHEN a = '' THEN 1.0 ELSE CAST(a AS DOUBLE) END) AS n FROM toks GROUP BY id, e)"""


@query(
    "reduced_formula",
    f"""WITH {FORMULAS}, r AS (SELECT id, e, n / min(n) OVER (PARTITION BY id) AS r FROM cnt),
    s AS (SELECT id, string_agg(e || CASE WHEN abs(r - 1) < 1e-9 THEN '' ELSE CAST(CAST(round_even(r, 0) AS BIGINT) AS VARCHAR) END, '' ORDER BY e) AS f FROM r GROUP BY id)
    SELECT id, coalesce(f, formula) AS reduced_formula FROM forms LEFT JOIN s USING (id)""",
)
def _(spark, sf):
    return fm.reduced_formula(formulas(spark, sf), "formula").select("id", "reduced_formula")


@query(
    "prototype_keys",
    f"""WITH {FORMULAS}, a AS (SELECT id, CAST(n AS BIGINT) AS n, e FROM cnt), l AS (SELECT id, list(n ORDER BY n DESC) AS ns, string_agg(e, '-' ORDER BY e) AS k FROM a GROUP BY id),
    g AS (SELECT id, k, ns, list_reduce(ns, lambda x, y: gcd(x, y)) AS g FROM l)
    SELECT id, k AS element_key, array_to_string([chr(CAST(64 + i AS INT)) || CASE WHEN ns[i] // g > 1 THEN CAST(ns[i] // g AS VARCHAR) ELSE '' END for i in range(1, len(ns) + 1)], '') AS prototype
    FROM forms LEFT JOIN g USING (id)""",
)
def _(spark, sf):
    df = fm.element_key(fm.prototype(formulas(spark, sf), "formula"), "formula")
    return df.select("id", "element_key", "prototype")


CLASS_CASE = "CASE e " + " ".join(f"WHEN '{e}' THEN '{c}'" for e, c in fm.CLASSES.items()) + " END"


@query(
    "chemistry_class",
    f"""WITH {FORMULAS}, c AS (SELECT id, e, {CLASS_CASE} AS c FROM cnt), f AS (SELECT id, c, min(e) AS e FROM c WHERE c IS NOT NULL GROUP BY id, c),
    s AS (SELECT id, string_agg(c, '_' ORDER BY e) AS s FROM f GROUP BY id)
    SELECT id, CASE WHEN formula = 'x?' THEN 'unknown' ELSE coalesce(s, 'other') END AS chemistry_class FROM forms LEFT JOIN s USING (id)""",
)
def _(spark, sf):
    return fm.chemistry_class(formulas(spark, sf), "formula").select("id", "chemistry_class")


Z_LIST = "[" + ", ".join(f"'{s}'" for s in fm.SYMBOLS) + "]"


@query(
    "composition",
    f"""WITH {FORMULAS}, z AS (SELECT id, n, list_position({Z_LIST}, e) AS z FROM cnt),
    s AS (SELECT id, sum(n) FILTER (WHERE z > 20) AS h, sum(n) AS t, count(*) AS c, max(z) AS m, sum(n * z) AS w FROM z GROUP BY id)
    SELECT id, round(coalesce(h, 0) / t, 9) + 0.0 AS heavy_fraction, t AS atom_count, CAST(c AS INT) AS n_elements, CAST(m AS INT) AS max_z, round(w / t, 7) + 0.0 AS mean_z
    FROM forms LEFT JOIN s USING (id)""",
)
def _(spark, sf):
    df = fm.with_source_token(
        fm.composition(formulas(spark, sf), "formula").withColumn("source", F.lit("left")), "source", ["left", "right"]
    )
    df = df.selectExpr(
        "id", "heavy_fraction", "atom_count", "n_elements", "max_z",
        "aggregate(transform(slice(fractions, 1, 94), (x, i) -> x * (i + 1)), 0D, (a, x) -> a + x) AS mean_z",
    )
    return rounded(rounded(df, "heavy_fraction"), "mean_z", digits=7)


@query(
    "code_classes",
    """SELECT p_partkey AS id, p_partkey % 240 AS code, CASE WHEN p_partkey % 240 BETWEEN 1 AND 2 THEN 'triclinic' WHEN p_partkey % 240 BETWEEN 3 AND 15 THEN 'monoclinic'
      WHEN p_partkey % 240 BETWEEN 16 AND 74 THEN 'orthorhombic' WHEN p_partkey % 240 BETWEEN 75 AND 142 THEN 'tetragonal' WHEN p_partkey % 240 BETWEEN 143 AND 167 THEN 'trigonal'
      WHEN p_partkey % 240 BETWEEN 168 AND 194 THEN 'hexagonal' WHEN p_partkey % 240 BETWEEN 195 AND 230 THEN 'cubic' ELSE 'unknown' END AS class FROM part""",
)
def _(spark, sf):
    return table(spark, sf, "part").selectExpr(
        "p_partkey AS id", "p_partkey % 240 AS code", f"{sc.code_class('(p_partkey % 240)')} AS class"
    )


@query(
    "record_labels",
    """SELECT p_partkey AS id, CASE WHEN p_size % 9 = 0 THEN 'unresolved' WHEN p_size % 3 = 0 THEN 'L2' ELSE 'L1' END AS level,
      CASE WHEN p_brand = 'Brand#' || (p_size % 25) THEN p_brand ELSE 'cross_source_mismatch' END AS stratum,
      CASE WHEN p_name = p_type THEN 'identical' WHEN contains(p_name, substr(p_name, 1, p_size % 6)) THEN CASE WHEN length(p_name) <= p_size % 6 THEN 'identical' ELSE 'related_setting' END ELSE 'different' END AS relation,
      coalesce(CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_type END, p_brand) AS preferred FROM part""",
)
def _(spark, sf):
    df = table(spark, sf, "part").selectExpr(
        "*", "IF(p_size % 9 = 0, NULL, p_name) AS reduced", "p_name AS full", "IF(p_size % 3 = 0, '', p_type) AS stamp",
        "concat('Brand#', p_size % 25) AS other", "substr(p_name, 1, p_size % 6) AS part_name",
        "IF(p_size % 5 = 0, NULL, p_type) AS first_choice",
    )
    return df.selectExpr(
        "p_partkey AS id", f"{sc.provenance_level('reduced', 'full', ['stamp'])} AS level",
        f"{sc.stratum_label('p_brand', 'other')} AS stratum", f"{sc.relation('p_name', 'part_name')} AS relation",
        "coalesce(first_choice, p_brand) AS preferred",
    )


@query(
    "cell_distances",
    """WITH e AS (SELECT a.vec_id AS id, [abs(CAST(v AS DOUBLE)) + 1 for v in a.embedding[1:3]] AS x, [abs(CAST(v AS DOUBLE)) + 1 for v in b.embedding[1:3]] AS y
                  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
    s AS (SELECT id, x, y, pow((x[1] * x[2] * x[3]) / (y[1] * y[2] * y[3] + 1e-12), 1.0 / 3.0) AS s FROM e)
    SELECT id, round(list_max([abs(x[i] - y[i] * s) / (abs(x[i]) + 1e-6) for i in range(1, 4)]), 9) + 0.0 AS lattice_distance,
      round(list_max([abs(x[i] / y[i] - 1) for i in range(1, 4)]), 9) + 0.0 AS lattice_strain, round((x[1] * x[2] * x[3]) / (y[1] * y[2] * y[3]), 9) + 0.0 AS volume_ratio FROM s""",
)
def _(spark, sf):
    e = table(spark, sf, "embeddings").selectExpr(
        "vec_id AS id", *[f"abs(double(embedding[{i}])) + 1 AS x{i}" for i in range(3)]
    )
    f = e.selectExpr("id - 1 AS id", *[f"x{i} AS y{i}" for i in range(3)])
    x, y = [f"x{i}" for i in range(3)], [f"y{i}" for i in range(3)]
    df = e.join(f, "id").selectExpr("*", "x0 * x1 * x2 AS vx", "y0 * y1 * y2 AS vy")
    df = df.selectExpr(
        "id", f"{sc.lattice_distance(x, y, 'vx', 'vy')} AS lattice_distance",
        f"{sc.lattice_strain(x, y)} AS lattice_strain", "vx / vy AS volume_ratio",
    )
    return rounded(df, "lattice_distance", "lattice_strain", "volume_ratio")


@query(
    "decode_arrays",
    """SELECT vec_id AS id, CASE WHEN vec_id % 4 = 3 THEN NULL ELSE round(embedding[1] + embedding[2] + embedding[3] + embedding[4], 4) + 0.0 END AS total, vec_id % 4 <> 3 AS shaped
       FROM (SELECT vec_id, [CAST(x AS DOUBLE) for x in embedding] AS embedding FROM embeddings)""",
)
def _(spark, sf):
    e = table(spark, sf, "embeddings").selectExpr(
        "vec_id AS id",
        "format_string('[[%s, %s], [%s%s]]', string(double(embedding[0])), string(double(embedding[1])), string(double(embedding[2])), "
        "IF(vec_id % 4 = 3, '', concat(', ', string(double(embedding[3]))))) AS text",
    )
    e = e.selectExpr("id", f"{sc.decode_matrix('text', 2, 2)} AS m")
    return e.selectExpr("id", "round(aggregate(m, 0D, (a, x) -> a + x), 4) + 0D AS total", "m IS NOT NULL AS shaped")


CANDIDATES = """
cand AS (SELECT DISTINCT l_partkey AS left_id, l_suppkey AS right_id FROM lineitem),
lsrc AS (SELECT p_partkey AS left_id, CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_name END AS text, p_type AS kind, p_retailprice AS score FROM part WHERE p_partkey % 11 <> 0),
rsrc AS (SELECT s_suppkey AS right_id, s_name AS text, CAST(s_nationkey AS VARCHAR) AS kind, CASE WHEN s_suppkey % 13 = 0 THEN NULL ELSE s_acctbal END AS score FROM supplier WHERE s_suppkey % 7 <> 0),
joined AS (SELECT left_id, right_id, l.text AS lt, r.text AS rt, l.score AS ls, r.score AS rs,
  CASE WHEN l.score IS NULL AND l.kind IS NULL OR r.kind IS NULL THEN 'missing_source_record' WHEN l.text IS NULL OR r.text IS NULL THEN 'missing_text'
       WHEN l.score IS NULL OR r.score IS NULL THEN 'conversion_failed' END AS reason
  FROM cand LEFT JOIN lsrc l USING (left_id) LEFT JOIN rsrc r USING (right_id))"""


def sources(spark, sf):
    cand = table(spark, sf, "lineitem").selectExpr("l_partkey AS left_id", "l_suppkey AS right_id").distinct()
    left = table(spark, sf, "part").filter("p_partkey % 11 != 0").selectExpr(
        "p_partkey AS left_id", "IF(p_size % 10 = 0, NULL, p_name) AS text", "p_type AS kind", "p_retailprice AS score"
    )
    right = table(spark, sf, "supplier").filter("s_suppkey % 7 != 0").selectExpr(
        "s_suppkey AS right_id", "s_name AS text", "string(s_nationkey) AS kind", "IF(s_suppkey % 13 = 0, NULL, s_acctbal) AS score"
    )
    return cand, left, right


CHECKS = [
    ("missing_text", "l_text IS NULL OR r_text IS NULL"), ("conversion_failed", "l_score IS NULL OR r_score IS NULL"),
]


@query("pair_quarantine", f"WITH {CANDIDATES} SELECT left_id, right_id, reason FROM joined")
def _(spark, sf):
    return pairing.pair_sources(*sources(spark, sf), "left_id", "right_id", CHECKS).select("left_id", "right_id", "reason")


@query(
    "enrich_panel",
    f"WITH {CANDIDATES} SELECT left_id, right_id, l.kind AS left_kind, l.score AS left_score, r.kind AS right_kind FROM cand LEFT JOIN lsrc l USING (left_id) LEFT JOIN rsrc r USING (right_id)",
)
def _(spark, sf):
    cand, left, right = sources(spark, sf)
    rows = pairing.enrich(cand, left, "left_id", ["kind", "score"], "left_", "right_id")
    rows = pairing.enrich(rows, right, "right_id", ["kind"], "right_", "left_id")
    return rows.select("left_id", "right_id", "left_kind", "left_score", "right_kind")


@query(
    "panel_funnel",
    f"""WITH {CANDIDATES} SELECT count(*) AS candidates, count(*) FILTER (WHERE reason IS NULL OR reason <> 'missing_source_record') AS both_present,
      count(*) FILTER (WHERE reason IS NULL) AS usable, count(*) FILTER (WHERE reason IS NULL AND ls > 1000) AS panel FROM joined""",
)
def _(spark, sf):
    rows = pairing.pair_sources(*sources(spark, sf), "left_id", "right_id", CHECKS)
    return pairing.funnel(
        rows, {"candidates": "true", "both_present": "reason IS NULL OR reason != 'missing_source_record'", "usable": "reason IS NULL",
               "panel": "reason IS NULL AND l_score > 1000"},
    )


@query(
    "match_tiers",
    """WITH m AS (SELECT o_orderkey AS id, o_orderkey % 29 = 0 AS pe, o_orderkey % 5 <> 0 AS sc, o_orderkey % 7 <> 0 AS sf, o_orderkey % 3 <> 0 AS fit,
        CASE o_orderkey % 4 WHEN 0 THEN 'different' WHEN 1 THEN 'identical' ELSE 'related_setting' END AS rel, CASE o_custkey % 6 WHEN 0 THEN 'deformation' WHEN 1 THEN 'unresolved' WHEN 2 THEN NULL ELSE 'proper' END AS rc FROM orders)
    SELECT id, CASE WHEN pe THEN 'quarantine' WHEN NOT sc OR NOT sf THEN 'tier_3' WHEN NOT fit THEN 'quarantine' WHEN rel = 'different' OR rc IN ('deformation', 'unresolved') THEN 'quarantine' ELSE 'tier_1' END AS tier,
      CASE WHEN pe THEN 'parse_error' WHEN NOT sc THEN 'different_counts' WHEN NOT sf THEN 'different_formula'
        WHEN NOT fit THEN CASE WHEN rel = 'different' THEN 'relation_different|' ELSE '' END || 'match_failed|relation:' || rel
        ELSE concat_ws('|', CASE WHEN rel = 'different' THEN 'relation_different' END, CASE WHEN rel = 'different' THEN 'mismatch_kept_for_review' END,
             CASE WHEN rc IN ('deformation', 'unresolved') THEN 'rotation_unresolved:' || rc END) END AS reasons FROM m""",
)
def _(spark, sf):
    m = table(spark, sf, "orders").selectExpr(
        "o_orderkey AS id", "o_orderkey % 29 = 0 AS parse_error", "o_orderkey % 5 != 0 AS same_count",
        "o_orderkey % 7 != 0 AS same_formula", "o_orderkey % 3 != 0 AS fit",
        "CASE o_orderkey % 4 WHEN 0 THEN 'different' WHEN 1 THEN 'identical' ELSE 'related_setting' END AS relation",
        "CASE o_custkey % 6 WHEN 0 THEN 'deformation' WHEN 1 THEN 'unresolved' WHEN 2 THEN NULL ELSE 'proper' END AS rotation_class",
    )
    return pairing.tier(m).selectExpr("id", "tier", "array_join(reasons, '|') AS reasons")


@query(
    "nested_panels",
    f"""WITH {LONG}, p1 AS (SELECT metric, quantile_cont(dist, 0.5) AS d, quantile_cont("right", 0.5) AS r FROM long_pairs WHERE stratum <> 'ECONOMY' GROUP BY metric)
    SELECT l.metric, id, true AS P0, stratum <> 'ECONOMY' AS P1, stratum <> 'ECONOMY' AND dist <= d AND coalesce("right" <= r, false) AS P2,
      stratum <> 'ECONOMY' AND dist <= d AND coalesce("right" <= r, false) AND id % 3 <> 0 AS P3 FROM long_pairs l JOIN p1 USING (metric)""",
)
def _(spark, sf):
    rows = materialize(long_pairs(spark, sf).withColumnRenamed("right", "cell"))
    out = pairing.nested_panels(rows, ["metric"], "stratum != 'ECONOMY'", ["dist", "cell"], "id % 3 != 0", "id")
    return out.select("metric", "id", "P0", "P1", "P2", "P3")


RESID = """
res AS (SELECT a.vec_id AS id, s.source, abs(CAST(a.embedding[s.k] AS DOUBLE)) * 3 AS nat, abs(CAST(a.embedding[s.k + 2] AS DOUBLE)) * 2 AS tr, abs(CAST(a.embedding[s.k + 4] AS DOUBLE)) * 2 AS co
        FROM embeddings a, (VALUES ('left', 1), ('right', 2)) s(source, k) WHERE a.vec_id % 9 <> 0 OR s.source = 'left'),
prs AS (SELECT vec_id AS id, abs(CAST(embedding[8] AS DOUBLE)) / 3 AS site, abs(CAST(embedding[9] AS DOUBLE)) / 3 AS strain, label % 4 <> 0 AS eq FROM embeddings),
sub AS (SELECT id, CASE WHEN site < 0.05 AND strain < 0.05 AND eq THEN 'T1a' WHEN site < 0.2 AND strain < 0.1 THEN 'T1b' ELSE 'T1c' END AS sublayer FROM prs)"""


@query(
    "core_extended",
    f"""WITH {RESID}, w AS (SELECT id, max(nat) FILTER (WHERE source = 'left') AS ln, max(tr) FILTER (WHERE source = 'left') AS lt, max(co) FILTER (WHERE source = 'left') AS lc,
        max(nat) FILTER (WHERE source = 'right') AS rn, max(tr) FILTER (WHERE source = 'right') AS rt, max(co) FILTER (WHERE source = 'right') AS rc FROM res GROUP BY id),
    y AS (SELECT sub.id, sublayer, CASE WHEN sublayer <> 'T1a' THEN 'not_T1a (' || sublayer || ')' ELSE nullif(concat_ws('; ',
        CASE WHEN ln IS NULL THEN 'left_native_unresolved' WHEN ln > 0.25 AND NOT (lt <= 0.25 AND lc <= 0.25) THEN 'left_native_high' END,
        CASE WHEN rn IS NULL THEN 'right_native_unresolved' WHEN rn > 0.25 AND NOT (rt <= 0.25 AND rc <= 0.25) THEN 'right_native_high' END), '') END AS reason FROM sub LEFT JOIN w USING (id))
    SELECT id, sublayer, reason, reason IS NULL AS is_core FROM y""",
)
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    val = "abs(double(embedding[k - 1{d}])) * {m}"
    res = e.selectExpr("*", "inline(array(named_struct('source', 'left', 'k', 1), named_struct('source', 'right', 'k', 2)))")
    res = res.filter("vec_id % 9 != 0 OR source = 'left'").selectExpr(
        "vec_id AS id", "source", f"{val.format(d='', m=3)} AS native_residual_normalized",
        f"{val.format(d=' + 2', m=2)} AS transport_residual_normalized", f"{val.format(d=' + 4', m=2)} AS common_residual_normalized",
    )
    prs = e.selectExpr(
        "vec_id AS id", "abs(double(embedding[7])) / 3 AS site", "abs(double(embedding[8])) / 3 AS strain", "label % 4 != 0 AS eq"
    ).selectExpr("id", f"{pairing.sublayer('site', 'strain', 'eq')} AS sublayer")
    return pairing.core_extended(prs, res, ["id"]).select("id", "sublayer", "reason", "is_core")


# Two sources: parts by parity of their size; the test panel pairs neighbours whose prototype is held out.
def split_inputs(spark, sf):
    # Written before it is filtered: a filter on the key would be pushed below and compute it once more per test.
    recs = materialize(fm.prototype(formulas(spark, sf), "formula")).filter("prototype IS NOT NULL AND prototype != ''")
    left, right = recs.filter("id % 2 = 0"), recs.filter("id % 2 = 1")
    held = pairing.hold_out_groups(recs, "prototype", 0.2, 42)
    test = left.selectExpr("id AS left_id", "id + 1 AS right_id", "formula", "prototype").join(F.broadcast(held), "prototype", "left_semi")
    return recs, left, right, materialize(test)


SPLITS = f"""{FORMULAS},
a AS (SELECT id, CAST(n AS BIGINT) AS n FROM cnt), l AS (SELECT id, list(n ORDER BY n DESC) AS ns FROM a GROUP BY id),
g AS (SELECT id, ns, list_reduce(ns, lambda x, y: gcd(x, y)) AS g FROM l),
recs AS (SELECT id, formula, array_to_string([chr(CAST(64 + i AS INT)) || CASE WHEN ns[i] // g > 1 THEN CAST(ns[i] // g AS VARCHAR) ELSE '' END for i in range(1, len(ns) + 1)], '') AS prototype
         FROM forms JOIN g USING (id)),
protos AS (SELECT DISTINCT prototype FROM recs),
ord AS (SELECT prototype, row_number() OVER (ORDER BY {h_sql('42', 'prototype')}, prototype) AS p, count(*) OVER () AS n FROM protos),
held AS (SELECT prototype FROM ord WHERE p <= greatest(1, round_even(0.2 * n, 0))),
test AS (SELECT id AS left_id, id + 1 AS right_id, formula, prototype FROM recs WHERE id % 2 = 0 AND prototype IN (SELECT prototype FROM held)),
pool AS (SELECT * FROM recs WHERE id NOT IN (SELECT left_id FROM test) AND id NOT IN (SELECT right_id FROM test)
         AND formula NOT IN (SELECT formula FROM test) AND prototype NOT IN (SELECT prototype FROM test)),
evals AS (
  SELECT id, 'left_insource' AS eval_set FROM recs WHERE id % 2 = 0 AND id IN (SELECT left_id FROM test)
  UNION ALL SELECT id, 'right_insource' FROM recs WHERE id % 2 = 1 AND id IN (SELECT right_id FROM test)
  UNION ALL SELECT id, CASE WHEN id % 2 = 0 THEN 'left' ELSE 'right' END || '_formula_disjoint' FROM recs WHERE formula IN (SELECT formula FROM test)
  UNION ALL SELECT id, CASE WHEN id % 2 = 0 THEN 'left' ELSE 'right' END || '_prototype_disjoint' FROM recs WHERE prototype IN (SELECT prototype FROM test)
  UNION ALL SELECT id, 'counterfactual_left' FROM recs WHERE id % 2 = 1 AND id IN (SELECT right_id FROM test)
  UNION ALL SELECT id, 'counterfactual_right' FROM recs WHERE id % 2 = 0 AND id IN (SELECT left_id FROM test))"""


@query("train_pool", f"WITH {SPLITS} SELECT id, formula, prototype FROM pool")
def _(spark, sf):
    recs, _, _, test = split_inputs(spark, sf)
    return pairing.train_pool(recs, test, "id", "formula", "prototype").select("id", "formula", "prototype")


@query("eval_sets", f"WITH {SPLITS} SELECT eval_set, id FROM evals")
def _(spark, sf):
    _, left, right, test = split_inputs(spark, sf)
    return pairing.eval_sets(left, right, test, "id", "formula", "prototype").select("eval_set", "id")


@query(
    "split_disjointness",
    f"""WITH {SPLITS} SELECT eval_set, count(*) AS n, count(p.id) AS shared, count(p.id) = 0 AS is_disjoint FROM evals LEFT JOIN pool p USING (id) GROUP BY eval_set""",
)
def _(spark, sf):
    recs, left, right, test = split_inputs(spark, sf)
    pool = pairing.train_pool(recs, test, "id", "formula", "prototype")
    return pairing.disjoint(pairing.eval_sets(left, right, test, "id", "formula", "prototype"), pool, "id")


@query(
    "reconcile",
    f"""WITH {LONG}, a AS (SELECT metric, grp, avg("left") AS v FROM long_pairs WHERE {FINITE} AND grp <> 'Brand#3' GROUP BY metric, grp),
    b AS (SELECT metric, grp, avg("left") + CASE WHEN metric = 'a' THEN 0 ELSE 1 END AS v FROM long_pairs WHERE {FINITE} AND grp <> 'Brand#4' GROUP BY metric, grp)
    SELECT metric, grp, CASE WHEN a.v IS NULL OR b.v IS NULL THEN 'missing_or_nonfinite' WHEN abs(a.v - b.v) <= 1e-6 THEN 'pass' ELSE 'fail' END AS status, round(abs(a.v - b.v), 6) + 0.0 AS abs_diff
    FROM a FULL OUTER JOIN b USING (metric, grp)""",
)
def _(spark, sf):
    from tandemrank.frame import finite_pairs

    rows = finite_pairs(long_pairs(spark, sf))
    a = rows.filter("grp != 'Brand#3'").groupBy("metric", "grp").agg(F.expr("avg(`left`) AS value"))
    b = rows.filter("grp != 'Brand#4'").groupBy("metric", "grp").agg(
        F.expr("avg(`left`) + IF(metric = 'a', 0, 1) AS value")
    )
    out = pairing.reconcile(a, b, ["metric", "grp"], 1e-6)
    return rounded(out.select("metric", "grp", "status", "abs_diff"), "abs_diff", digits=6)


@query(
    "distance_histogram",
    """WITH p AS (SELECT vec_id AS id, label AS grp, [CAST(embedding[i] AS DOUBLE) * 20 for i in range(1, 4)] AS x FROM embeddings),
    d AS (SELECT a.grp, sqrt(pow(a.x[1] - b.x[1], 2) + pow(a.x[2] - b.x[2], 2) + pow(a.x[3] - b.x[3], 2)) AS d FROM p a JOIN p b ON a.grp = b.grp AND a.id < b.id),
    n AS (SELECT grp, count(*) AS n FROM d GROUP BY grp), k AS (SELECT grp, least(19, CAST(floor(d / 0.5) AS INT)) AS bin, count(*) AS k FROM d WHERE d <= 10 GROUP BY ALL)
    SELECT n.grp, CAST(b.bin AS INT) AS bin, round(coalesce(k, 0) / n, 9) + 0.0 AS share FROM n CROSS JOIN range(20) b(bin) LEFT JOIN k ON k.grp = n.grp AND k.bin = b.bin""",
)
def _(spark, sf):
    pts = table(spark, sf, "embeddings").selectExpr(
        "vec_id AS id", "label AS grp", *[f"double(embedding[{i}]) * 20 AS x{i}" for i in range(3)]
    )
    return rounded(pairing.distance_histogram(pts, ["grp"], "id", ["x0", "x1", "x2"], chunk=32), "share")


@query(
    "scope_membership",
    f"""WITH {LONG}, one AS (SELECT * FROM long_pairs WHERE {FINITE}), m AS (SELECT metric, median(greatest("left", "right")) AS m FROM one GROUP BY metric)
    SELECT metric, id, dist <= 10 AS core, stratum = 'PROMO' AS t1a, greatest("left", "right") >= m AS high_response FROM one JOIN m USING (metric)""",
)
def _(spark, sf):
    from tandemrank.frame import finite_pairs
    from tandemrank.operators.quantile import quantiles
    from tandemrank.session import bounded

    one = materialize(finite_pairs(long_pairs(spark, sf)).selectExpr("*", "greatest(`left`, `right`) AS big"))
    med = bounded(quantiles(one, ["metric"], "big", "id", {"m": 0.5}))
    sets = {
        "core": one.filter("dist <= 10"), "t1a": one.filter("stratum = 'PROMO'"),
        "high_response": one.join(med, "metric").filter("big >= m"),
    }
    return pairing.membership(one.select("metric", "id"), ["metric", "id"], sets, "id")

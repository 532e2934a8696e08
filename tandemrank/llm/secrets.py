"""Secrets in texts, and weak candidates that count only next to complementary parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tandemrank.llm.common import materialize, table
from tandemrank.llm.registry import query

# Kind: pattern, capture group with the value, least length of that group. The order is that of spans with equal starts.
# The first three.
PATTERNS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
    "ident": (r"""(?i)(access_?key_?id|client_?id|user_?name|login|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]+)""", 2, 3),
    "bare": (r"[A-Za-z0-9+/_=-]{32,}", 0, 32),
    "endpoint": (r"https?://[A-Za-z0-9.-]+(:[0-9]+)?[A-Za-z0-9/_.-]*", 0, 10),
}
BASE, WEAK = ("assign", "access", "hex"), ("ident", "bare", "endpoint")
# A weak kind is reported only when each class of parts in its set occurs in its scope.
PARTS = {"identifier": ("access", "ident"), "secret": ("assign", "hex", "bare")}
NEEDS = {"ident": ("secret",), "bare": ("identifier",), "endpoint": ("identifier", "secret")}
REACH, LINES = 300, 3


def _places(text: Column, kind: str) -> Column:
    """Matches of a kind as (gap, lines, len, ok): code points and line ends since the match before, its length, whether it counts.

    The pieces between matches and the matches themselves come from the same pattern, so they alternate.
    """
    pattern, group, least = PATTERNS[kind]
    whole, value = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pieces = F.slice(F.split(text, pattern, -1), 1, F.size(whole))

    def place(p: Column) -> Column:
        piece, match, v = p["p"], p["m"], p["v"]
        good = F.length(v) >= least
        if kind == "bare":  # looks random: both cases and a digit
            good &= v.rlike("[A-Z]") & v.rlike("[a-z]") & v.rlike("[0-9]")
        return F.struct(
            F.length(piece).alias("gap"), (F.length(piece) - F.length(F.replace(piece, F.lit("\n"), F.lit("")))).alias("lines"),
            F.length(match).alias("len"), good.alias("ok"),
        )

    zipped = F.arrays_zip(pieces.alias("p"), whole.alias("m"), value.alias("v"))
    empty = F.array().cast("array<struct<gap:int,lines:int,len:int,ok:boolean>>")
    return F.when(text.rlike(pattern), F.transform(zipped, place)).otherwise(empty)


def find(docs: DataFrame, reach: int = REACH, lines: int = LINES) -> tuple[DataFrame, DataFrame]:
    """All documents as ``(rid, doc_id)``, and their spans ``(rid, kind, start, end)`` in code points, end exclusive.

    Base kinds are reported wherever they occur. A scope is ``reach`` code points and ``lines`` line ends around a
    span: an identifier-like, random-looking or address-like span (the weak kinds) is reported only if its complements
    (NEEDS) occur in that scope; a random-looking one must also lie outside the base spans. Spans and scopes meet in an
    equi-join on document and cell of ``reach`` code points, and only their existence is asked, so no pairs are
    emitted. Texts are read once; only places of matches are written. A null text is empty; repeated rows each have
    their own spans; only doc_id and text are read, so other columns may have any names.
    """
    text = F.coalesce("text", F.lit(""))
    found = materialize(
        docs.select(
            F.monotonically_increasing_id().alias("rid"), "doc_id",
            *[_places(text, k).alias(f"at_{k}") for k in PATTERNS],
        )
    )
    each = reduce(
        DataFrame.union,
        [
            found.select("rid", F.lit(k).alias("kind"), F.lit(i).alias("nth"), F.posexplode(f"at_{k}").alias("pos", "at"))
            for i, k in enumerate(PATTERNS)
        ],
    )
    run = Window.partitionBy("rid", "kind").orderBy("pos")
    spans = materialize(
        each.select("rid", "kind", "nth", "pos", "at.*")
        .withColumn("end", F.sum(F.col("gap") + F.col("len")).over(run).cast("int"))
        .withColumn("line", F.sum("lines").over(run).cast("int"))
        .filter("ok")
        .select("rid", "kind", "nth", (F.col("end") - F.col("len")).alias("start"), "end", "line")
    )
    return found.select("rid", "doc_id"), _link(spans, reach, lines)


def _link(spans: DataFrame, reach: int, lines: int) -> DataFrame:
    """Base spans and the weak ones whose complements are in scope."""
    cell = lambda c: F.floor(F.col(c) / reach)
    cells = lambda a, b: F.explode(F.sequence(cell(a), cell(b)))
    base, weak = spans.filter(F.col("kind").isin(*BASE)), spans.filter(F.col("kind").isin(*WEAK))
    weak = weak.withColumn("from", F.greatest(F.lit(0), F.col("start") - reach)).withColumn("to", F.col("end") + reach)
    others = spans.select(
        "rid", F.col("kind").alias("k2"), F.col("start").alias("s2"), F.col("end").alias("e2"), F.col("line").alias("l2"),
        cells("start", "end").alias("cell"),
    )
    overlap = (F.col("s2") < F.col("end")) & (F.col("start") < F.col("e2"))
    bare = weak.filter("kind = 'bare'").withColumn("cell", cells("start", "end"))
    covered = (
        bare.join(others.filter(F.col("k2").isin(*BASE)), ["rid", "cell"]).filter(overlap)
        .select("rid", "kind", "start").distinct()
    )
    weak = weak.join(covered, ["rid", "kind", "start"], "left_anti")
    kinds = ["rid", "kind", "nth", "start", "end", "line"]
    near = (F.col("s2") <= F.col("to")) & (F.col("e2") >= F.col("from")) & (F.abs(F.col("l2") - F.col("line")) <= lines) & ~overlap
    out = base.select(*kinds)
    for kind, needs in NEEDS.items():
        left = weak.filter(F.col("kind") == kind)
        for part in needs:
            side = others.filter(F.col("k2").isin(*PARTS[part]))
            hit = left.withColumn("cell", cells("from", "to")).alias("w").join(
                side.alias("o"),
                (F.col("w.rid") == F.col("o.rid")) & (F.col("w.cell") == F.col("o.cell")) & near, "left_semi",
            )
            left = hit.drop("cell").distinct()
        out = out.union(left.select(*kinds))
    return out.drop("line")


def report(docs: DataFrame, **scope: int) -> DataFrame:
    """One row per document: counts of the base kinds, a digest of the base spans, and all spans as text.

    A document without spans has counts 0, an empty text and the digest of the empty string.
    """
    rows, spans = find(docs, **scope)
    said = lambda c: F.concat_ws(":", c["kind"], c["start"], c["end"])
    of = lambda k: lambda c: c["kind"] == k
    each = F.array_sort(F.collect_list(F.struct("start", "nth", "end", "kind")))
    lists = spans.groupBy("rid").agg(each.alias("all"))
    texts = lists.select(
        "rid", F.array_join(F.transform("all", said), ",").alias("spans"),
        F.array_join(F.transform(F.filter("all", lambda c: c["kind"].isin(*BASE)), said), ",").alias("base"),
        *[F.size(F.filter("all", of(k))).alias(f"n_{k}") for k in (*BASE, *WEAK)],
    )
    return rows.join(texts, "rid", "left").select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("bigint").alias(f"n_{k}") for k in BASE],
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
        F.coalesce(sum(F.col(f"n_{k}") for k in WEAK), F.lit(0)).cast("bigint").alias("n_linked"),
    )


def _sql() -> str:
    """The same report in SQL over the documents table."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    listed = lambda kinds: ", ".join(map(quoted, kinds))
    matches = " UNION ALL ".join(
        f"SELECT rid, '{k}' AS kind, {i} AS nth, {least} AS least, string_split_regex(t, {quoted(p)}) AS p, "
        f"regexp_extract_all(t, {quoted(p)}, 0) AS w, regexp_extract_all(t, {quoted(p)}, {g}) AS v FROM d WHERE regexp_matches(t, {quoted(p)})"
        for i, (k, (p, g, least)) in enumerate(PATTERNS.items())
    )
    overlap = "o.s < w.e AND w.s < o.e"
    near = f"o.rid = w.rid AND NOT ({overlap}) AND o.s <= w.e + {REACH} AND o.e >= greatest(0, w.s - {REACH}) AND abs(o.line - w.line) <= {LINES}"
    wanted = " OR ".join(
        f"(w.kind = '{k}' AND " + " AND ".join(f"EXISTS (SELECT 1 FROM spans o WHERE {near} AND o.kind IN ({listed(PARTS[part])}))" for part in needs) + ")"
        for k, needs in NEEDS.items()
    )
    said = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, nth)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({matches}),
each AS (SELECT rid, kind, nth, least, unnest(range(1, len(w) + 1)) AS i, p, w, v FROM m),
places AS (SELECT rid, kind, nth, least, v[i] AS v, length(w[i]) AS n,
  CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s,
  CAST(list_sum(list_transform(p[1:i], lambda x: length(x) - length(replace(x, chr(10), '')))) AS BIGINT) AS line FROM each),
spans AS (SELECT rid, kind, nth, s, s + n AS e, line FROM places WHERE length(v) >= least
  AND (kind <> 'bare' OR (regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[0-9]')))),
kept AS (SELECT * FROM spans w WHERE kind IN ({listed(BASE)}) OR (
  NOT (kind = 'bare' AND EXISTS (SELECT 1 FROM spans o WHERE o.rid = w.rid AND o.kind IN ({listed(BASE)}) AND {overlap}))
  AND ({wanted}))),
found AS (SELECT rid, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)},
  {said} FILTER (kind IN ({listed(BASE)})) AS base, {said} AS spans,
  count(*) FILTER (kind IN ({listed(WEAK)})) AS n_linked FROM kept GROUP BY rid)
SELECT doc_id, {', '.join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_linked, 0) AS n_linked FROM d LEFT JOIN found USING (rid)"""


@query("op6_multipart_secrets", _sql())
def op6(spark, sf_dir):
    return report(table(spark, sf_dir, "documents"))

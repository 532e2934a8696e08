"""Document rates for target domain weights, from soft domain memberships."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandemrank.llm.common import drop, materialize, table, train_row
from tandemrank.llm.registry import query

TRAIN_ROWS, VOCABULARY, CLEAR, STEEPEST, SMOOTH = 16_000, 512, 5.0, 4.0, 0.5
ROUNDS, ROUNDS_A_WRITE = 40, 8
DOMAINS = ("good", "low", "toxic")
# Shares of all tokens that the mixture should have.
TARGETS = {"good": 0.90, "low": 0.07, "toxic": 0.03}


def label_domains(labels: DataFrame) -> DataFrame:
    """``(doc_id, domain)`` from the labels table: toxic before low before good; rows without both labels say nothing."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when((F.col("quality") == 1) & (F.col("toxic") == 0), "good")
    return labels.select("doc_id", domain.alias("domain")).filter("domain is not null")


def words(text: str = "text") -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), "")


def with_traits(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``_n``, its number of words, and ``_traits`` in place of the text.

    Traits are the distinct words of the whole text, their last two characters (after a tilde), and the share of distinct words in
    tenths. Each step is a projection of its own, so that no array is computed twice.
    """
    keep = [c for c in df.columns if c != text]
    df = df.select(*keep, words(text).alias("_w"))
    df = df.select(*keep, F.size("_w").cast("bigint").alias("_n"), F.array_distinct("_w").alias("_own"))
    ends = F.array_distinct(F.transform("_own", lambda x: F.concat(F.lit("~"), F.substring(x, -2, 2))))
    share = F.when(F.col("_n") > 0, F.array(F.concat(F.lit("~~"), F.floor(F.size("_own") * 10 / F.col("_n")))))
    return df.select(*keep, "_n", F.concat("_own", ends, F.coalesce(share, F.array().cast("array<string>"))).alias("_traits"))


def train(docs: DataFrame, domains: DataFrame, names: tuple[str, ...] = DOMAINS, rows: int = TRAIN_ROWS) -> tuple[list[float], list[tuple], list[float]]:
    """Scores without traits, ``(trait, weight per domain)``, and the domains' shares of the labelled rows, for at most VOCABULARY traits that clearly tell domains apart.

    Learnt from the ``rows`` labelled ids with the smallest hashes among those with crc32(doc_id) mod 5 <> 0; ids with two
    domains are left out and equal texts count once. The first domain is the plain case: only traits typical of the
    others speak, those CLEAR standard deviations above chance in a domain. Their presence counts by the logarithm of
    their share in the domain over that elsewhere, their absence likewise, both up to STEEPEST; absences are part of the score
    without traits, so a weight is the difference. Only counts of traits are shuffled; the driver gets the chosen
    traits. Without labelled rows all domains are equally likely.
    """
    known = (
        domains.filter(train_row() & F.col("domain").isin(*names)).groupBy("doc_id").agg(F.min("domain").alias("domain"), F.max("domain").alias("other"))
        .filter("domain = other").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select("doc_id", "domain")
    )
    known = materialize(known)  # at most `rows` rows: a proven bound for the broadcast
    mine = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").dropDuplicates(["domain", "text"])
    mine = materialize(with_traits(mine.select("domain", "text")))
    sizes = {r["domain"]: r["count"] for r in mine.groupBy("domain").count().collect()}
    total = sum(sizes.values())
    if not total:
        return [-float(np.log(len(names)))] * len(names), [], [1 / len(names)] * len(names)
    n = [sizes.get(d, 0) for d in names]
    counts = mine.select("domain", F.explode("_traits").alias("trait")).groupBy("trait").agg(F.count("*").alias("c"), *[F.count_if(F.col("domain") == d).alias(f"c_{i}") for i, d in enumerate(names)])
    share = (F.col("c") + SMOOTH) / (total + 2 * SMOOTH)
    z, w, absent = [], [], []
    for i, size in enumerate(n):
        chance = (F.col(f"c_{i}") - size * share) / F.sqrt(size * share * (1 - share) + 1e-9)
        own = (F.col(f"c_{i}") + SMOOTH * share) / (size + SMOOTH)
        rest = (F.col("c") - F.col(f"c_{i}") + SMOOTH * share) / (total - size + SMOOTH)
        typical = (chance >= CLEAR) if i else F.lit(False)
        seen, missed = (F.when(typical, F.least(F.lit(STEEPEST), x)).otherwise(0.0) for x in (F.ln(own / rest), F.abs(F.ln((1 - own) / (1 - rest)))))
        z.append(F.when(typical, chance).otherwise(0.0))
        absent.append((-missed).alias(f"a_{i}"))
        w.append((seen + missed).alias(f"w_{i}"))
    best = counts.filter((F.col("c") >= 5) & (F.col("c") < total - 5)).select("trait", F.greatest(*z).alias("z"), *w, *absent)
    chosen = best.filter(F.col("z") >= CLEAR).orderBy(F.desc("z"), "trait").limit(VOCABULARY).collect()
    priors = [
        float(np.log((x + SMOOTH) / (total + SMOOTH * len(names)))) + sum(r[f"a_{i}"] for r in chosen) for i, x in enumerate(n)
    ]
    return priors, [(r["trait"], *[r[f"w_{i}"] for i in range(len(names))]) for r in chosen], [(x + SMOOTH) / (total + SMOOTH * len(names)) for x in n]


def posteriors(df: DataFrame, model: tuple[list[float], list[tuple], list[float]], names: tuple[str, ...] = DOMAINS) -> DataFrame:
    """``df`` (with a ``text``) with ``n_tokens`` and each domain's probability ``p_<domain>`` in place of the text."""
    priors, chosen, _ = model
    keep = [c for c in df.columns if c != "text"]
    list_of = F.array(*[F.lit(c[0]) for c in chosen]) if chosen else F.array().cast("array<string>")
    df = with_traits(df).select(*keep, "_n", F.array_intersect("_traits", list_of).alias("_hit"))
    scores = []
    for i, p in enumerate(priors):
        weighty = [c for c in chosen if c[i + 1]]
        score = F.lit(p)
        if weighty:
            weights = F.map_from_arrays(F.array(*[F.lit(c[0]) for c in weighty]), F.array(*[F.lit(float(c[i + 1])) for c in weighty]))
            score = score + F.aggregate("_hit", F.lit(0.0), _adder(weights))
        scores.append(score.alias(f"_s{i}"))
    df = df.select(*keep, "_n", *scores)
    top = F.greatest(*[F.col(f"_s{i}") for i in range(len(names))])
    df = df.select(*keep, "_n", *[F.exp(F.col(f"_s{i}") - top).alias(f"_e{i}") for i in range(len(names))])
    total = sum((F.col(f"_e{i}") for i in range(1, len(names))), F.col("_e0"))
    return df.select(*keep, F.col("_n").alias("n_tokens"), *[(F.col(f"_e{i}") / total).alias(f"p_{d}") for i, d in enumerate(names)])


def _adder(weights: Column):
    return lambda acc, x: acc + F.coalesce(F.element_at(weights, x), F.lit(0.0))


def fit_rates(soft: DataFrame, targets: dict[str, float], total: float | None = None, most: float | None = None, rounds: int = ROUNDS) -> DataFrame:
    """``soft`` (with ``n_tokens`` and ``p_<domain>`` columns) and a nonnegative ``rate`` of each row.

    Projected gradient descent on the squared distance between the expected domain token totals and ``targets`` times
    ``total`` (by default all tokens), from rate 1: each round sums rate * tokens * probability per domain (a few
    numbers reach the driver), and moves a rate by its memberships in the domains that have too much or too little,
    cut to [0, most]. A step is scaled by document length and domain mass, so short and long documents move alike and the
    rates stay as near to 1 as the targets allow. Rates are expressions of the written table; they are
    written every ROUNDS_A_WRITE rounds. A domain without any mass cannot be raised and stays as it is. Rows
    without tokens keep rate 1.
    """
    names = list(targets)
    mass = [F.sum(F.col("n_tokens") * F.col(f"p_{d}")).alias(f"m{i}") for i, d in enumerate(names)]
    inner = [F.sum(F.col("n_tokens") * F.col(f"p_{a}") * F.col(f"p_{b}")).alias(f"q{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names)]
    state = materialize(soft.withColumn("rate", F.lit(1.0)))
    first = state.agg(F.sum("n_tokens").alias("all"), *mass, *inner).first()
    goal_all = float(total if total is not None else first["all"] or 0)
    goal = np.array([targets[d] * goal_all for d in names])
    k = len(names)
    gram = np.array([[first[f"q{i}_{j}"] or 0.0 for j in range(k)] for i in range(k)])
    scale = np.where(np.diag(gram) > 0, 1 / np.maximum(np.diag(gram), 1e-300), 0.0)
    widest = max(np.abs(np.linalg.eigvals(gram * scale[None, :])).max(), 1e-300) if goal_all else 1.0
    now = np.array([first[f"m{i}"] or 0.0 for i in range(k)])
    rate = F.col("rate")
    sums = [F.sum(F.col("n_tokens") * F.col(f"p_{d}") * F.col("rate")).alias(f"m{i}") for i, d in enumerate(names)]
    pending = 0
    for step in range(rounds):
        off = now - goal
        if np.abs(off).max(initial=0) <= 1e-9 * max(1.0, goal_all):
            break
        moves = off * scale / widest
        rate = rate - sum((F.lit(float(m)) * F.col(f"p_{d}") for m, d in zip(moves, names)), F.lit(0.0))
        rate = F.greatest(F.lit(0.0), rate if most is None else F.least(F.lit(float(most)), rate))
        rate = F.when(F.col("n_tokens") > 0, rate).otherwise(1.0)
        pending += 1
        if pending == ROUNDS_A_WRITE:
            before, state = state, materialize(state.withColumn("rate", rate))
            drop(before)
            rate, pending = F.col("rate"), 0
        got = state.withColumn("rate", rate).agg(*sums).first()
        now = np.array([got[f"m{i}"] or 0.0 for i in range(k)])
    return state.withColumn("rate", rate)


def memberships(docs: DataFrame, domains: DataFrame, names: tuple[str, ...] = DOMAINS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``n_tokens`` (words) and ``p_<domain>`` of every document; a null text has no words."""
    return posteriors(docs.select(*keep, "text"), train(docs, domains, names), names)


def thin_out(docs: DataFrame, domains: DataFrame, keep: dict[str, float]) -> DataFrame:
    """``docs`` with each domain's expected tokens brought to the share ``keep`` of what they are, by rates up to 1.

    Only evidence thins: a membership in any domain but the first counts as far as it exceeds the domain's share of
    the labelled rows, and the rest belongs to the first. A document stays if a hash of its id and text, uniform in [0, 1), is below its rate, so equal rows fare alike and
    documents that surely belong to a domain with share 1 all stay.
    """
    names, first = tuple(keep), next(iter(keep))
    model = train(docs, domains, names)
    shares = dict(zip(names, model[2]))
    soft = posteriors(docs.select(F.struct("*").alias("row"), "text"), model, names)
    above = {d: F.greatest(F.lit(0.0), F.col(f"p_{d}") - F.lit(shares[d] + 1e-9)) / F.lit(max(1 - shares[d], 1e-9)) for d in names if d != first}
    rest = F.greatest(F.lit(0.0), F.lit(1.0) - sum(above.values(), F.lit(0.0)))
    soft = materialize(soft.select("row", "n_tokens", rest.alias(f"p_{first}"), *[c.alias(f"p_{d}") for d, c in above.items()]))
    now = soft.agg(*[F.sum(F.col("n_tokens") * F.col(f"p_{d}")).alias(d) for d in names]).first()
    rated = fit_rates(soft, {d: keep[d] * float(now[d] or 0.0) for d in names}, total=1.0, most=1.0)
    chance = F.pmod(F.xxhash64("row.doc_id", "row.text", F.lit(7)), F.lit(1 << 52)) / float(1 << 52)
    return rated.filter(chance < F.col("rate")).select("row.*")


@query("op7_soft_membership_mixing")
def op7(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return fit_rates(memberships(docs, label_domains(labels)), TARGETS)

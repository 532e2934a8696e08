"""Ranked lexical search of many queries at once: shared term sets are accumulated once and combined along a graph of sums."""

from __future__ import annotations

import heapq
import pickle
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tandemrank.llm.common import materialize, number_rows, table
from tandemrank.llm.registry import query

TOP, BLOCK_TERMS, DOCS, PIECE = 50, 1 << 16, 1024, 1 << 22
# Letters and digits of ASCII (in lower case) and all bytes of other characters are parts of terms, all else is a gap.
_TERM = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def term_counts(text: str | None) -> tuple[int, Counter]:
    """Number of terms of a whole text with repeats, and how often each occurs. Null and empty texts have none."""
    data = (text or "").encode("utf-8", "replace").translate(_TERM)
    if len(data) <= PIECE:
        terms = data.split()
        return len(terms), Counter(terms)
    counts, at = Counter(), 0
    while at < len(data):  # a piece ends at a gap, or where a longer term than a piece ends
        cut = data.rfind(b" ", at, at + PIECE) if at + PIECE < len(data) else len(data)
        if cut < 0:
            cut = data.find(b" ", at + PIECE)
        cut = len(data) if cut < 0 else cut
        counts.update(data[at:cut].split())
        at = cut + 1
    return counts.total(), counts


def sharing_plan(items: dict[int, list[bytes]]) -> dict:
    """The graph of sums for ``{item: its distinct terms}``.

    Terms that occur in exactly the same items form a leaf. Then, as long as two nodes stand together in two or more
    items, the pair that stands together in the most becomes a node of its own and takes their place there; so a sum that
    several items need is worked out once. Returns ``leaf`` (of each term), ``sums`` (pairs of nodes, in order; their
    numbers follow the leaves') and ``parts`` (nodes whose sum is an item's score).
    """
    holders = defaultdict(list)
    for i in sorted(items):
        for t in items[i]:
            holders[t].append(i)
    groups = defaultdict(list)
    for t in sorted(holders):
        groups[tuple(holders[t])].append(t)
    leaf, holds = {}, []
    for n, (own, terms) in enumerate(sorted(groups.items())):
        leaf |= dict.fromkeys(terms, n)
        holds.append(set(own))
    leaves = len(holds)
    parts = {i: set() for i in items}
    for n, own in enumerate(holds):
        for i in own:
            parts[i].add(n)
    met = Counter(p for i in parts for p in combinations(sorted(n for n in parts[i] if len(holds[n]) > 1), 2))
    heap = [(-c, p) for p, c in met.items() if c > 1]
    heapq.heapify(heap)
    sums = []
    while heap:
        c, (x, y) = heapq.heappop(heap)
        both = holds[x] & holds[y]
        if len(both) < 2:
            continue
        if len(both) != -c:  # fewer than when it was put here
            heapq.heappush(heap, (-len(both), (x, y)))
            continue
        z = leaves + len(sums)
        sums.append((x, y))
        holds[x] -= both
        holds[y] -= both
        near = Counter()
        for i in sorted(both):
            parts[i] -= {x, y}
            near.update(parts[i])
            parts[i].add(z)
        holds.append(both)
        for n, c in near.items():
            if c > 1:
                heapq.heappush(heap, (-c, (n, z)))
    return {"leaf": leaf, "leaves": leaves, "sums": sums, "parts": {i: sorted(p) for i, p in parts.items()}}


def _blocks(items: DataFrame) -> tuple[DataFrame, int]:
    """``(rid, block, terms)`` of the numbered items, dealt to blocks of at most BLOCK_TERMS terms or few items each."""

    def cut(batches):
        for b in batches:
            terms = [sorted(term_counts(t.as_py())[1]) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("rid"), pa.array(terms, pa.list_(pa.binary()))], names=["rid", "terms"])

    each = materialize(items.select("rid", F.col("row.text").alias("text")).mapInArrow(cut, "rid bigint, terms array<binary>"))
    rows, total = each.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    blocks = max(1, -(-total // BLOCK_TERMS))
    while True:
        dealt = each.withColumn("block", F.pmod(F.xxhash64("rid"), F.lit(blocks)).cast("int"))
        most = dealt.groupBy("block").agg(F.sum(F.size("terms")).alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= BLOCK_TERMS or blocks >= 4 * rows:
            return dealt, blocks
        blocks *= 2


def _plans(dealt: DataFrame) -> DataFrame:
    """``(block, plan)``: the graph of each block of items, made in the tasks."""

    def plan(frame: pd.DataFrame) -> pd.DataFrame:
        found = sharing_plan({int(r): [bytes(t) for t in ts] for r, ts in zip(frame["rid"], frame["terms"])})
        return pd.DataFrame({"block": [int(frame["block"].iloc[0])], "plan": [pickle.dumps(found)]})

    return materialize(dealt.groupBy("block").applyInPandas(plan, "block int, plan binary"))


def _postings(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """``(doc_id, n, terms, tfs)`` of each document with at least one term: its length and its terms among ``terms``, by number."""
    number = {t: i for i, t in enumerate(terms)}

    def run(batches):
        for b in batches:
            ids, ns, offsets, found, tfs = [], [], [0], [], []
            for d, t in zip(b.column("doc_id"), b.column("text")):
                n, counts = term_counts(t.as_py())
                if n:
                    own = counts.keys() & number.keys()
                    ids.append(d.as_py())
                    ns.append(n)
                    found += [number[x] for x in own]
                    tfs += [counts[x] for x in own]
                    offsets.append(len(found))
            lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, kind)) for x, kind in ((found, pa.int32()), (tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return slim.mapInArrow(run, "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>")


class _Best:
    """The best ``top`` documents of each item so far."""

    def __init__(self, items: int, top: int):
        self.top, self.least, self.rows, self.waiting = top, np.ones(items, np.int64), [], 0

    def add(self, scores: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        item, doc = np.nonzero(scores >= self.least[:, None])
        if len(item):
            self.rows.append((item, scores[item, doc], ids[doc], none[doc]))
            self.waiting += len(item)
        if self.waiting > 8 * self.top * len(self.least):
            self.prune()

    def prune(self) -> tuple[np.ndarray, ...]:
        if not self.rows:
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        item, score, doc, none = (np.concatenate(x) for x in zip(*self.rows))
        order = np.lexsort((doc, none, -score, item))
        item = item[order]
        first = np.searchsorted(item, np.arange(len(self.least)))
        turn = np.arange(len(item)) - first[item]
        kept = order[turn < self.top]
        full = np.flatnonzero(turn == self.top - 1)
        self.least[item[full]] = score[order[full]]
        self.rows = [(item[turn < self.top], score[kept], doc[kept], none[kept])]
        self.waiting = len(kept)
        return self.rows[0]


def accumulate(plan: dict, term: np.ndarray, doc: np.ndarray, gain: np.ndarray, docs: int, leaf: np.ndarray) -> np.ndarray:
    """Scores (items by documents) from the gains of ``(term, doc)``: leaves are summed once, then the graph is followed."""
    sums = np.zeros((plan["leaves"] + len(plan["sums"]), docs), np.int64)
    np.add.at(sums, (leaf[term], doc), gain)
    for z, (x, y) in enumerate(plan["sums"], plan["leaves"]):
        np.add(sums[x], sums[y], out=sums[z])
    return np.stack([sums[p].sum(axis=0) for p in plan["parts"].values()])


def _scored(found: DataFrame, plan: dict, weights: np.ndarray, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """``(rid, doc_id, score)``: of each task the best ``top`` documents of each item."""
    leaf = np.array(list(plan["leaf"].values()), np.int64)
    rids = np.array(list(plan["parts"]), np.int64)

    def run(batches):
        best = _Best(len(rids), top)
        for b in batches:
            lists = b.column("terms")
            offsets, terms, tfs = lists.offsets.to_numpy(), lists.values.to_numpy(), b.column("tfs").values.to_numpy()
            none = np.array(b.column("doc_id").is_null())
            ids = b.column("doc_id").fill_null(0).to_numpy()
            m = np.array([100 - 50 + 50 * n * n_docs // n_terms for n in b.column("n").to_pylist()], np.int64)
            for at in range(0, b.num_rows, DOCS):
                to = min(at + DOCS, b.num_rows)
                own = slice(offsets[at], offsets[to])
                doc = np.repeat(np.arange(to - at), np.diff(offsets[at : to + 1]))
                tf = tfs[own]
                gain = weights[terms[own]] * (1_000_000_000 * tf // (1000 * tf + 20 * m[at:to][doc]))
                best.add(accumulate(plan, terms[own], doc, gain, to - at, leaf), ids[at:to], none[at:to])
        item, score, doc, none = best.prune()
        yield pa.RecordBatch.from_arrays(
            [pa.array(rids[item]), pa.array(doc, pa.int64(), mask=none.astype(bool)), pa.array(score, pa.int64())], names=["rid", "doc_id", "score"]
        )

    return found.select("doc_id", "n", "terms", "tfs").mapInArrow(run, "rid bigint, doc_id bigint, score bigint")


def _ranked(scored: DataFrame, top: int) -> DataFrame:
    """The best of all tasks, first within 64 parts of each item, so that no task sorts what all tasks found."""
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    part = Window.partitionBy("rid", "part").orderBy(*order)
    some = scored.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(64))).withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("rid").orderBy(*order))).filter(F.col("rank") <= top).select("rid", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """``row`` (all columns of an item), ``rank`` (from 1), ``doc_id``, ``score``: the best ``top`` documents of each item.

    ``docs`` needs ``doc_id`` and ``text``, ``items`` needs ``text``; other columns may have any names. Terms are runs of
    letters, digits and characters outside ASCII, A-Z in lower case. A document's score for an item is the sum, over the
    item's distinct terms, of weight * (10**9 * tf div (1000 * tf + 20 * m)), with the weight floor(1000 ln((2N + 2) /
    (2 df + 1))) and m = 50 + 50 n N div L; only scores above 0 count, equal ones go by doc_id, null ids last. Null and
    empty texts have no terms: such documents are never found and count in no statistic, such items find nothing.
    Repeated documents are ranked separately, repeated items answered separately; empty tables give no rows.

    Items are dealt to blocks of at most BLOCK_TERMS terms (one item may have more); a block's graph of shared sums
    goes to the tasks. Documents are read once a block, to postings of its terms, which are written; tasks then add up
    shared sums for DOCS documents at a time and keep the best of each item.
    """
    spark = docs.sparkSession
    items = number_rows(items)
    dealt, blocks = _blocks(items)
    plans = _plans(dealt)
    out = None
    for block in range(blocks):
        got = plans.filter(F.col("block") == block).select("plan").first()
        if got is None:
            continue
        plan = pickle.loads(got["plan"])
        found = materialize(_postings(docs, list(plan["leaf"])))
        n_docs, n_terms = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        held = dict(found.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator())
        df = np.array([held.get(t, 0) for t in range(len(plan["leaf"]))], np.float64)
        weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
        best = _ranked(_scored(found, plan, weights, n_docs, n_terms, top), top)
        out = best if out is None else out.union(best)
    if out is None:
        out = spark.createDataFrame([], "rid bigint, rank int, doc_id bigint, score bigint")
    return out.join(items, "rid").select("row", "rank", "doc_id", "score")


_SQL = r"""
WITH lower AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
own AS (SELECT doc_id, r, ts, len(ts) AS n FROM lower WHERE len(ts) > 0),
total AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS lt FROM own),
items AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
posted AS (SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ts) AS t FROM own) WHERE t IN (SELECT t FROM items) GROUP BY r, t),
weight AS (SELECT t, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM posted, total GROUP BY t, nd),
gains AS (
  SELECT r, t, doc_id, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * nd) // lt))) AS gain
  FROM posted JOIN weight USING (t) JOIN own USING (r), total),
scored AS (SELECT item_id, r, doc_id, sum(gain)::BIGINT AS score FROM gains JOIN items USING (t) GROUP BY item_id, r, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""


@query("op13_shared_lexical_search", _SQL)
def op13(spark, sf_dir):
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("row.item_id", "rank", "doc_id", "score")

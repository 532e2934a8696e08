"""Similarity join of documents on word n-grams: a forest of MinHash prefix tries, then exact Jaccard similarity."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tandemrank.llm.common import components, fold_pieces, materialize, mix, table, words_of
from tandemrank.llm.registry import query

WORDS, SIMILARITY, TREES, DEPTH, RECALL = 5, 0.8, 32, 9, 0.9995
BLOCK, FILTER_BITS, MARGIN = 512, 24, 0.1
_SEEDS = mix(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def text_key(text: str = "text") -> Column:
    """16 bytes that stand for a whole text; a null text is an empty one."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``n``-word sequences of a whole text, words split at white space, lower case.

    A text of fewer words is one sequence; a text without words has none.
    """
    carry, parts, count = np.zeros(0, np.uint64), [], 0
    for piece in fold_pieces((text or "").lower().encode("utf-8", "replace")):
        h = np.concatenate([carry, words_of(piece, signs=False)[0]])
        if len(h) >= n:
            got = np.zeros(len(h) - n + 1, np.uint64)
            for j in range(n):
                got = mix(got * np.uint64(31) + h[j : len(h) - n + 1 + j] + np.uint64(j))
            parts.append(got)
        carry, count = h[-(n - 1) :], count + len(h) - len(carry)
    if parts:
        return np.unique(np.concatenate(parts))
    if not len(carry):
        return carry
    one = np.array([len(carry)], np.uint64)
    for x in carry:
        one = mix(one * np.uint64(31) + x)
    return one


def signature(grams: np.ndarray) -> np.ndarray:
    """For each tree and level the top 16 bits of the smallest hash of ``grams``: TREES x DEPTH."""
    low = np.full(len(_SEEDS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 2048):
        low = np.minimum(low, (grams[at : at + 2048, None] * _SEEDS[None, :]).min(axis=0))
    return (mix(low) >> np.uint64(48)).astype(">u2").reshape(TREES, DEPTH)


def met(similarity, depth: int):
    """Probability that a pair of this similarity shares a prefix of ``depth`` levels in some tree (a number or a column)."""
    return 1 - (1 - similarity**depth) ** TREES


def least_depth(similarity: float, recall: float = RECALL) -> int:
    """The depth below which no prefix need be shortened: there every pair of the similarity is met with probability ``recall``."""
    return next((d for d in range(DEPTH, 1, -1) if met(similarity, d) >= recall), 1)


def _signatures(docs: DataFrame) -> DataFrame:
    """Each distinct text's key and tree labels; copies are merged before anything else is shuffled."""
    schema = pa.schema([("k", pa.binary()), ("sig", pa.binary())])

    def run(batches):
        for b in batches:
            ks, sigs, seen = [], [], {}
            for k, t in zip(b.column("k").to_pylist(), b.column("text")):
                if k not in seen:
                    s = shingles(t.as_py())
                    seen[k] = signature(s).tobytes() if len(s) else None
                    if len(s):
                        ks.append(k)
                        sigs.append(seen[k])
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.binary()), pa.array(sigs, pa.binary())], schema=schema)

    each = docs.select(text_key().alias("k"), "text").mapInArrow(run, "k binary, sig binary")
    return each.groupBy("k").agg(F.min("sig").alias("sig"))


def _forest(sigs: DataFrame, low: int) -> tuple[DataFrame, DataFrame]:
    """The tries below their prefixes of ``low`` levels, without what stands alone there: leaves and entries.

    A leaf is a whole label: ``bucket`` (tree and first ``low`` levels), ``tail`` (the levels after) and for each depth
    ``h<d>``, the smallest key under its prefix of d levels. Entries are ``(k, bucket, tail)``. Equal labels combine before
    the leaves of a bucket are sorted by their tails, so a large group of near copies comes as few leaves.
    """
    part = lambda t, at, n: F.substring("sig", t * F.lit(2 * DEPTH) + F.lit(2 * at + 1), F.lit(2 * n))
    labels = F.transform(
        F.sequence(F.lit(0), F.lit(TREES - 1)),
        lambda t: F.struct(F.xxhash64(t, part(t, 0, low)).alias("bucket"), part(t, low, DEPTH - low).alias("tail")),
    )
    rows = sigs.select("k", F.explode(labels).alias("at")).select("k", "at.bucket", "at.tail")
    leaves = rows.groupBy("bucket", "tail").agg(F.count("*").alias("n"), F.min("k").alias(f"h{DEPTH}"))
    leaves = leaves.withColumn("met", F.sum("n").over(Window.partitionBy("bucket"))).filter("met > 1")
    for d in range(low, DEPTH):
        leaves = leaves.withColumn(f"h{d}", F.min(f"h{DEPTH}").over(_under(d, low)))
    leaves = materialize(leaves.drop("met", "n"))
    return leaves, rows.join(leaves.select("bucket", "tail"), ["bucket", "tail"], "left_semi")


def _under(depth: int, low: int) -> Window:
    """All leaves under the same prefix of ``depth`` levels."""
    return Window.partitionBy("bucket", F.substring("tail", F.lit(1), F.lit(2 * (depth - low))))


def _agreement(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """``pairs(k, hub, depth)`` with ``near``, the share of equal values of their signatures: an estimate of their similarity."""
    both = pairs.join(sigs, "k").join(sigs.select(F.col("k").alias("hub"), F.col("sig").alias("other")), "hub")

    def share(frames):
        for f in frames:
            if len(f):
                one, two = (np.frombuffer(b"".join(f[c]), ">u2").reshape(len(f), -1) for c in ("sig", "other"))
                yield pd.DataFrame({"k": f["k"], "hub": f["hub"], "depth": f["depth"], "near": (one == two).mean(axis=1)})

    return both.mapInPandas(share, "k binary, hub binary, depth int, near double")


def _depths(entries: DataFrame, leaves: DataFrame, sigs: DataFrame, similarity: float, recall: float, low: int) -> DataFrame:
    """``(k, depth)``: the greatest depth at which a text's prefixes need no more shortening; texts not named need ``low``.

    A text is compared by signature with the smallest key under each of its prefixes, and so are those keys with it. Each
    partner of estimated similarity s found at depth d stands for 1 / met(s, d) partners. Found over estimated ones is the
    text's recall at d; at the greatest d where it reaches ``recall`` the shortening ends. Partners a little below
    ``similarity`` count too, as estimates scatter; a text that meets no partner goes on to ``low``.
    """
    depths = range(DEPTH, low - 1, -1)
    tops = F.array(*[F.struct(F.lit(d).alias("depth"), F.col(f"h{d}").alias("hub")) for d in depths])
    star = entries.join(leaves, ["bucket", "tail"]).select("k", F.explode(F.array_distinct(tops)).alias("at")).select("k", "at.hub", "at.depth")
    star = star.filter("k <> hub").groupBy("k", "hub").agg(F.max("depth").alias("depth"))
    judged = materialize(_agreement(star, sigs).filter(F.col("near") >= similarity - MARGIN))
    sides = judged.select("k", "depth", "near").union(judged.select("hub", "depth", "near"))
    found = {d: F.count(F.when(F.col("depth") >= d, 1)) for d in depths}
    stand = {d: F.sum(F.when(F.col("depth") >= d, 1 / met(F.col("near"), d))) for d in depths}
    enough = [F.when(found[d] >= F.lit(recall) * stand[d], d) for d in depths]
    return sides.groupBy("k").agg(F.coalesce(*enough, F.lit(low)).cast("int").alias("depth"))


def _buckets(sigs: DataFrame, similarity: float, recall: float) -> DataFrame:
    """``(bucket, k, hub)``: texts that share a prefix in some tree, with the smallest key of the bucket.

    Prefixes start at DEPTH levels. One is shortened as long as a text under the shorter one still asks for it (see
    ``_depths``), so how deep the buckets lie follows from the data, tree by tree and branch by branch.
    """
    low = least_depth(similarity, recall)
    leaves, entries = _forest(sigs, low)
    entries = materialize(entries)
    depths = materialize(_depths(entries, leaves, sigs, similarity, recall, low))
    asked = entries.join(depths, "k", "left").groupBy("bucket", "tail").agg(F.min(F.coalesce("depth", F.lit(low))).alias("asked"))
    cut = leaves.join(asked, ["bucket", "tail"])
    for d in range(low, DEPTH):
        cut = cut.withColumn(f"a{d}", F.min("asked").over(_under(d, low)))
    depth = F.coalesce(*[F.when(F.col(f"a{d}") <= d, d) for d in range(low, DEPTH)], F.lit(DEPTH))
    cut = cut.withColumn("depth", depth)
    hub = F.coalesce(*[F.when(F.col("depth") == d, F.col(f"h{d}")) for d in range(low, DEPTH + 1)])
    name = F.xxhash64("bucket", "depth", F.expr(f"substring(tail, 1, 2 * (depth - {low}))"))
    cut = cut.select("bucket", "tail", name.alias("name"), hub.alias("hub"))
    rows = entries.join(cut, ["bucket", "tail"]).select(F.col("name").alias("bucket"), "k", "hub")
    shared = rows.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket")
    return rows.join(shared, "bucket", "left_semi")


def _verify(frame: pd.DataFrame, similarity: float, left: int, right: int) -> pd.DataFrame:
    """Exact similarity of the pairs of two blocks that share a bucket: number of links of each text and a forest of links."""
    key = frame["k"].tolist()
    block = frame["block"].to_numpy()
    sets = [np.frombuffer(s, np.uint64) for s in frame["grams"]]
    size = np.array([len(s) for s in sets])
    member = np.repeat(np.arange(len(frame)), frame["buckets"].map(len))
    bucket = np.concatenate(frame["buckets"].tolist())
    order = np.argsort(bucket, kind="stable")
    member, bucket = member[order], bucket[order]
    runs = np.split(member, np.flatnonzero(np.diff(bucket)) + 1)
    partner: list[set[int]] = [set() for _ in key]
    for run in runs:
        if len(run) > 1:
            for x in run:
                partner[x].update(run.tolist())
    links, root = np.zeros(len(key), np.int64), list(range(len(key)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x in np.flatnonzero(block == left):
        others = np.array(sorted(y for y in partner[x] if block[y] == right and (left != right or y > x)), np.int64)
        if len(others):
            others = others[(size[others] >= similarity * size[x]) & (size[x] >= similarity * size[others])]
        for some in np.array_split(others, -(-int(size[others].sum()) // 2_000_000) or 1):
            if not len(some):
                continue
            flat = np.concatenate([sets[y] for y in some])
            at = np.searchsorted(sets[x], flat).clip(0, size[x] - 1)
            ends = np.cumsum(size[some])
            both = np.diff(np.concatenate([[0], np.cumsum(sets[x][at] == flat)[ends - 1]]))
            near = some[both * (1 + similarity) >= similarity * (size[x] + size[some]) - 1e-9]
            links[x] += len(near)
            links[near] += 1
            for y in near:
                a, b = find(x), find(int(y))
                if a != b:
                    root[max(a, b, key=lambda i: key[i])] = min(a, b, key=lambda i: key[i])
    hit = np.flatnonzero(links)
    return pd.DataFrame({"k": [key[i] for i in hit], "root": [key[find(int(i))] for i in hit], "links": links[hit]})


def near_texts(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """``(k, root, n_links)`` of each distinct text with at least one other text of Jaccard similarity ``similarity``.

    ``root`` is the smallest key of the connected group, ``n_links`` the number of other distinct texts linked to this
    one. Candidates are the texts that share a trie prefix (see ``_buckets``); they are grouped into connected candidate sets, a set is
    cut into blocks of about BLOCK texts by hash, and a task compares two blocks and returns counts and a forest, so
    no pair is ever emitted and every pair is compared once. Word sequences of candidates alone are read again.
    """
    sigs = materialize(_signatures(docs))
    shared = materialize(_buckets(sigs, similarity, recall))
    sets = components(shared.select(F.col("k").alias("a"), F.col("hub").alias("b")).distinct())
    place = materialize(shared.groupBy("k").agg(F.array_sort(F.collect_list("bucket")).alias("buckets")).join(sets, F.col("k") == F.col("node")).select("k", F.col("root").alias("part"), "buckets"))
    # One bit per hash of a wanted key: a table of at most 2**(FILTER_BITS - 6) rows, whatever the input's size.
    spot = F.pmod(F.xxhash64("k"), F.lit(1 << FILTER_BITS))
    bits = place.select(F.shiftright(spot, 6).alias("cell"), F.expr(f"shiftleft(1L, cast(pmod(pmod(xxhash64(k), {1 << FILTER_BITS}), 64) as int))").alias("bit")).groupBy("cell").agg(F.bit_or("bit").alias("bits"))
    asked = docs.select(text_key().alias("k"), "text").withColumn("cell", F.shiftright(spot, 6))
    asked = asked.join(F.broadcast(bits), "cell").filter(F.expr(f"(shiftrightunsigned(bits, cast(pmod(pmod(xxhash64(k), {1 << FILTER_BITS}), 64) as int)) & 1) = 1"))
    texts = asked.groupBy("k").agg(F.min("text").alias("text"))

    def cut(frames):
        for f in frames:
            yield pd.DataFrame({"k": f["k"], "grams": [shingles(t).tobytes() for t in f["text"]]})

    grams = texts.mapInPandas(cut, "k binary, grams binary")
    sizes = place.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    # Dealt to every pair of blocks that a text's own block belongs to.
    own = F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("left"), F.greatest(o, F.col("block")).alias("right")))
    dealt = (
        place.join(grams, "k").join(sizes, "part").withColumn("block", own)
        .withColumn("pair", F.explode(pairs)).select("k", "part", "block", "buckets", "grams", "pair.left", "pair.right")
    )

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        return _verify(frame, similarity, int(frame["left"].iloc[0]), int(frame["right"].iloc[0]))

    found = materialize(dealt.groupBy("part", "left", "right").applyInPandas(compare, "k binary, root binary, links bigint"))
    groups = components(found.select(F.col("k").alias("a"), F.col("root").alias("b")))
    return found.groupBy("k").agg(F.sum("links").alias("n_links")).join(groups, F.col("k") == F.col("node")).select("k", "root", "n_links")


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: ``doc_id, class_id, n_links, n_copies, k, root``.

    Documents with equal texts, and those whose texts are connected by links, are one class; ``class_id`` is its
    smallest doc_id (null if all are null). ``n_links`` counts linked distinct texts, ``n_copies`` the rows with this very
    text, itself included. A text without words links to nothing, so only equal ones share a class. Only doc_id and
    text are read.
    """
    near = materialize(near_texts(docs, similarity))
    each = materialize(docs.select("doc_id", text_key().alias("k")))
    copies = each.groupBy("k").agg(F.count("*").alias("n_copies"), F.min("doc_id").alias("first"))
    texts = materialize(copies.join(near, "k", "left").select("k", F.coalesce("root", "k").alias("root"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), "n_copies", "first"))
    ids = texts.groupBy("root").agg(F.min("first").alias("class_id"))
    return each.join(texts.join(ids, "root"), "k").select("doc_id", "class_id", "n_links", "n_copies", "k", "root", "first")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class, with all its columns: that with the smallest doc_id (a null one last), then text key."""
    found = classes(docs, similarity)
    best = F.min(F.struct(F.col("first").isNull().alias("none"), "first", "k")).alias("best")
    one = found.groupBy("root").agg(best).select(F.col("best.k").alias("_k"), F.col("best.first").alias("_id"))
    row = docs.select(F.struct("*").alias("row"), text_key().alias("_k"), F.col("doc_id").alias("_own"))
    kept = row.join(one.withColumnRenamed("_k", "_one"), (F.col("_k") == F.col("_one")) & F.col("_own").eqNullSafe(F.col("_id")))
    turn = Window.partitionBy("_k", "_own").orderBy(F.xxhash64("row"))
    return kept.withColumn("_turn", F.row_number().over(turn)).filter("_turn = 1").select("row.*")


@query("op10_ngram_jaccard_join")
def op10(spark, sf_dir):
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")

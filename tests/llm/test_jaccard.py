import hashlib
import random

import numpy as np
import pytest

from tandemrank.llm import jaccard
from tandemrank.llm.common import components
from tandemrank.llm.jaccard import classes, keep_one, least_depth, met, shingles


def sets(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows, t=0.8):
    texts = sorted({x or "" for _, x in rows})
    s = [sets(x) for x in texts]
    root, links = list(range(len(texts))), [0] * len(texts)

    def find(x):
        return x if root[x] == x else find(root[x])

    for i in range(len(texts)):
        for j in range(i):
            if s[i] and s[j] and len(s[i] & s[j]) >= t * len(s[i] | s[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    ids = {}
    for d, x in rows:
        ids.setdefault(find(texts.index(x or "")), []).append(d)
    of = {x: (find(i), links[i]) for i, x in enumerate(texts)}
    pick = lambda g: min((d for d in ids[g] if d is not None), default=None)
    return sorted(((d, pick(of[x or ""][0]), of[x or ""][1], sum((y or "") == (x or "") for _, y in rows)) for d, x in rows), key=str)


def made(seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdef") for _ in range(4))
    rows = [(i, " ".join(word() for _ in range(r.randrange(1, 120)))) for i in range(60)]
    for i in range(60, 160):
        w = rows[r.randrange(60)][1].split(" ")
        for _ in range(r.choice([0, 1, 1, 2, 3])):
            w[r.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    base = [word() for _ in range(300)]
    for i in range(160, 220):  # one large group of near copies
        w = list(base)
        w[r.randrange(300)] = word()
        rows.append((i, " ".join(w)))
    return rows + [(500, None), (501, ""), (502, " \n"), (503, "One  two"), (504, "one two"), (3, rows[3][1]), (None, rows[5][1]), (None, "alone now"), (None, "alone now")]


def test_shingles_follow_words():
    text = " ".join(f"w{i}" for i in range(3000))
    assert len(shingles(text)) == 2996 and len(shingles("A b c\td e")) == 1 and len(shingles("a b")) == 1 and not len(shingles(" "))
    assert (shingles("A  b\nC d e f") == shingles("a b c d e f")).all() and shingles("a b")[0] != shingles("b a")[0]


def test_pieces_do_not_matter(monkeypatch):
    from tandemrank.llm.common import fold_pieces

    text = " ".join(f"w{i % 977}" for i in range(3000))
    whole = shingles(text)
    monkeypatch.setattr(jaccard, "fold_pieces", lambda d: fold_pieces(d, 700))
    assert np.array_equal(shingles(text), whole)


def test_least_depth_reaches_the_recall():
    d = least_depth(0.8)
    assert met(0.8, d) >= jaccard.RECALL > met(0.8, d + 1)
    assert least_depth(0.99) == jaccard.DEPTH and least_depth(0.01) == 1


def swapped(base, share, n, r):
    """``n`` variants of the words ``base``, each with that share of single words replaced at random places."""
    out = []
    for _ in range(n):
        w = list(base)
        for at in r.sample(range(len(w)), round(share * len(w))):
            w[at] = f"new{r.random()}"
        out.append(" ".join(w))
    return out


def test_prefixes_shorten_only_where_the_data_ask_for_it(docs):
    r = random.Random(3)
    close = swapped([f"c{i}" for i in range(2000)], 0.001, 20, r)  # similarities of about 0.98
    far = swapped([f"f{i}" for i in range(2000)], 0.01, 20, r)  # about 0.82
    alone = [" ".join(f"a{i}x{j}" for j in range(50)) for i in range(20)]
    low = least_depth(0.8)

    def depth_of(texts):
        sigs = jaccard.materialize(jaccard._signatures(docs(list(enumerate(texts)))))
        leaves, entries = jaccard._forest(sigs, low)
        got = jaccard._depths(entries, leaves, sigs, 0.8, jaccard.RECALL, low).collect()
        return {bytes(x.k): x.depth for x in got}

    key = lambda t: hashlib.md5(t.encode()).digest()
    got = depth_of(close + far + alone)
    assert {got[key(t)] for t in close} == {jaccard.DEPTH}
    assert sum(got[key(t)] < jaccard.DEPTH for t in far) > 15 and not any(key(t) in got for t in alone)


def test_buckets_are_shared_prefixes(docs):
    texts = [x or "" for _, x in made()]
    sigs = jaccard.materialize(jaccard._signatures(docs(list(enumerate(texts)))))
    label = {bytes(x.k): np.frombuffer(x.sig, ">u2").reshape(jaccard.TREES, jaccard.DEPTH) for x in sigs.collect()}
    low = least_depth(0.8)
    buckets = {}
    for x in jaccard._buckets(sigs, 0.8, jaccard.RECALL).collect():
        buckets.setdefault(x.bucket, []).append((bytes(x.k), bytes(x.hub)))
    shared = []
    for rows in buckets.values():
        keys = [k for k, _ in rows]
        assert len(set(keys)) == len(keys) > 1 and {h for _, h in rows} == {min(keys)}
        same = [min(int((label[k][t] == label[keys[0]][t]).cumprod().sum()) for k in keys) for t in range(jaccard.TREES)]
        assert max(same) >= low
        shared.append(max(same))
    assert min(shared) < jaccard.DEPTH
    # Whole prefixes of full length always meet.
    met_pairs = {frozenset((a, b)) for rows in buckets.values() for a, _ in rows for b, _ in rows if a != b}
    keys = sorted(label)
    full = {frozenset((a, b)) for i, a in enumerate(keys) for b in keys[:i] if (label[a] == label[b]).all(axis=1).any()}
    assert full <= met_pairs


@pytest.mark.parametrize("block", [512, 16])
def test_against_brute_force(docs, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = made()
    got = classes(docs(rows)).select("doc_id", "class_id", "n_links", "n_copies").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_keeps_one_of_each_class(docs):
    rows = made(2)
    d = docs(rows).selectExpr("*", "1 as k", "2 as root")
    kept = keep_one(d)
    assert kept.columns == d.columns
    want = brute(rows)
    named = sorted(x.doc_id for x in kept.collect() if x.doc_id is not None)
    assert named == sorted({c for _, c, _, _ in want if c is not None}) and kept.filter("doc_id is null").count() == 1
    assert classes(docs([])).count() == 0 and keep_one(docs([])).count() == 0


def test_components(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)] + [(7, 7), (900, 900)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0

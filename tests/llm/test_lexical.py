import math
import random
import re
from collections import Counter

import numpy as np

from tandemrank.llm import lexical
from tandemrank.llm.lexical import search, sharing_plan, term_counts

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top=50):
    own = [(d, Counter(terms(t))) for d, t in docs]
    own = [(d, c) for d, c in own if c]
    n_docs, n_terms = len(own), sum(c.total() for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in own:
            m = 100 - 50 + 50 * c.total() * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
                for t in set(terms(text)) if t in c
            )
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(found, key=lambda x: x[:3])[:top], 1)]
    return sorted(out, key=str)


def ran(spark, docs, items, top=50):
    docs = spark.createDataFrame([(d, t, 7, "x") for d, t in docs], "doc_id bigint, text string, score int, rid string")
    items = spark.createDataFrame([(i, t, 1, "y") for i, t in items], "item_id bigint, text string, rank int, doc_id string")
    return sorted((tuple(r) for r in search(docs, items, top).select("row.item_id", "rank", "doc_id", "score").collect()), key=str)


def test_terms_follow_the_pattern(monkeypatch):
    text = "Él a-b_c É\x7fNaïve 42nd　x" + "".join(map(chr, range(256)))
    assert term_counts(text) == (len(terms(text)), Counter(t.encode() for t in terms(text)))
    assert term_counts(None) == term_counts("") == term_counts(" .-\n") == (0, Counter())
    monkeypatch.setattr(lexical, "PIECE", 50)
    long = " ".join(random.Random(1).choice(["ab", "Cde", "x" * 120, "é!"]) for _ in range(500))
    assert term_counts(long) == (len(terms(long)), Counter(t.encode() for t in terms(long)))


def test_plan_sums_each_item_once_and_shares():
    r = random.Random(2)
    shared = [[f"s{k}{j}".encode() for j in range(4)] for k in range(6)]
    items = {i: sorted({t for k in r.sample(range(6), 3) for t in shared[k]} | {f"own{i}{j}".encode() for j in range(5)}) for i in range(40)}
    items[40], items[41] = items[0], []
    plan = sharing_plan(items)
    terms_of = [set() for _ in range(plan["leaves"])]
    for t, n in plan["leaf"].items():
        terms_of[n].add(t)
    for x, y in plan["sums"]:
        assert not terms_of[x] & terms_of[y]
        terms_of.append(terms_of[x] | terms_of[y])
    for i, own in items.items():
        got = [t for n in plan["parts"][i] for t in terms_of[n]]
        assert sorted(got) == own
    additions = len(plan["sums"]) + sum(max(0, len(p) - 1) for p in plan["parts"].values())
    assert plan["sums"] and additions < 0.5 * sum(len(x) - 1 for x in items.values() if x)
    doc = np.repeat(np.arange(3), len(plan["leaf"]))
    term = np.tile(np.arange(len(plan["leaf"])), 3)
    gain = np.arange(len(doc)) ** 2
    scores = lexical.accumulate(plan, term, doc, gain, 3, np.array(list(plan["leaf"].values())))
    number = {t: k for k, t in enumerate(plan["leaf"])}
    for row, own in zip(scores, items.values()):
        assert row.tolist() == [sum(int(gain[d * len(number) + number[t]]) for t in own) for d in range(3)]


def test_search_equals_brute_force(spark, monkeypatch):
    r = random.Random(3)
    words = ["the", "of", "And", "ÉTÉ", "x1", *[f"w{i}" for i in range(40)]]
    text = lambda n: r.choice([" ", ", ", "-"]).join(r.choice(words[: r.choice([4, 45])]) for _ in range(n))
    docs = [(i, text(r.randrange(1, 60))) for i in range(150)]
    docs += [(i, docs[5][1]) for i in (900, 901, 900)] + [(None, docs[5][1]), (None, "w1"), (7000, None), (7001, ""), (7002, "..."), (7003, text(30000))]
    items = [(i, text(r.randrange(1, 30))) for i in range(12)] + [(3, "the of"), (50, None), (51, "!"), (52, "unknown"), (None, "w1 w2")]
    assert ran(spark, docs, items) == brute(docs, items)
    assert ran(spark, docs, items, 3) == brute(docs, items, 3)
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 30)
    monkeypatch.setattr(lexical, "DOCS", 7)
    assert ran(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    assert ran(spark, [], [(1, "a")]) == [] and ran(spark, [(1, "a")], []) == [] and ran(spark, [], []) == []
    assert ran(spark, [(1, "a")], [(1, "a")]) == brute([(1, "a")], [(1, "a")])

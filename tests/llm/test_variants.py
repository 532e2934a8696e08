import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tandemrank.llm import variants
from tandemrank.llm.variants import Acceptor, _codes, spelling_forms, vocabulary

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute_words(rows):
    seen = Counter()
    for d, t in rows:
        for w in LETTERS.findall(t or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                seen[w] += 1
    return {w: n for w, n in seen.items() if n >= 2}


def near(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    if len(x) > len(y):
        x, y = y, x
    return len(y) == len(x) + 1 and any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def brute_forms(words, times=10):
    form, out = {}, {}
    for w, n in words.items():
        own = [x for x in words if near(w, x)]
        best = min(own, key=lambda x: (-words[x], x), default=None)
        form[w] = best if own and words[best] >= times * n else None
        out[w] = len(own)
    rows = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n, out[w], words.get(form[w])))
    return sorted(rows)


def forms(spark, words, times=10):
    df = spark.createDataFrame([(w, n, 1) for w, n in words.items()], "word string, n bigint, root int")
    return sorted(tuple(r) for r in spelling_forms(df, times).select("word", "form", "root", "n", "n_near", "form_n").collect())


def made(seed, size, letters="abé", low=7, high=12):
    r = random.Random(seed)
    words = {}
    for _ in range(size):
        w = "".join(r.choice(letters) for _ in range(r.randrange(low, high)))
        words[w] = r.choice([2, 3, 3, 20, 40, 500, 5000])
    for w in list(words)[: size // 3]:
        i = r.randrange(len(w))
        x = r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice(letters) + w[i:], w[:i] + "x" + w[i + 1 :]])
        if len(x) >= low:
            words.setdefault(x, r.choice([2, 50]))
    return words


@pytest.mark.parametrize("seed", range(6))
def test_composition_accepts_exactly_the_near_pairs(seed):
    r = random.Random(seed)
    rows = sorted({(p, "".join(r.choice("abc") for _ in range(r.randrange(0, 7)))) for p in range(3) for _ in range(60)})
    parts = np.array([p for p, _ in rows])
    got = list(zip(*(x.tolist() for x in Acceptor(*_codes([w for _, w in rows]), parts).pairs())))
    want = [(i, j) for j in range(len(rows)) for i in range(j) if rows[i][0] == rows[j][0] and near(rows[i][1], rows[j][1])]
    assert sorted(got) == sorted(want)


def test_acceptor_is_minimal():
    words = sorted(a + b + c for a in "abcd" for b in ("ing", "ed", "") for c in ("", "s"))
    machine = Acceptor(*_codes(words), np.zeros(len(words), int))
    endings = {tuple(w[len(p) :] for w in words if w.startswith(p)) for w in words for p in (w[:k] for k in range(len(w) + 1))}
    assert machine.states == len(endings)


@pytest.mark.parametrize("seed", [1, 2])
def test_forms_equal_brute_force(spark, seed, monkeypatch):
    words = made(seed, 400) | made(seed + 9, 60, "abcdefgh", 7, 30)
    assert forms(spark, words) == brute_forms(words)
    monkeypatch.setattr(variants, "BATCH_WORDS", 20)
    assert forms(spark, words, 2) == brute_forms(words, 2)


def test_long_words_ties_and_chains(spark):
    long = "ab" * 1500
    words = {long: 90, long[:-1]: 3, "x" + long: 2, "aaaaaaa": 2, "aaaaaaaa": 20, "aaaaaaaaa": 200, "aaaaaaab": 20, "aaaaaaaab": 2000, "zzzzzzz": 5, "zzzzzzé": 50, "zzzzzzè": 50}
    got = forms(spark, words)
    assert got == brute_forms(words)
    assert {w: r for w, _, r, *_ in got}["aaaaaaa"] == "aaaaaaaab" and {w: f for w, f, *_ in got}["zzzzzzz"] == "zzzzzzè"
    assert forms(spark, {}) == []


def test_vocabulary_of_texts(spark, monkeypatch):
    r = random.Random(4)
    words = ["Straßen", "naïveté", "ÀÉÎÕÜßø", "ABCDEFGH", "abcdefgh", "short", "a×b÷cdefg", "x" * 40, "Ārticle", "co-operate"]
    rows = [(i, r.choice([" ", ", ", "1", "\n"]).join(r.choice(words) for _ in range(r.randrange(0, 40)))) for i in range(80)]
    rows += [(None, "Straßen abcdefgh"), (None, "Straßen"), (3, rows[3][1]), (800, None), (801, ""), (802, "12 3"), (803, "Straßen " * 30000)]
    monkeypatch.setattr(variants, "HELD_WORDS", 3)
    df = spark.createDataFrame([(d, t, 1, "w") for d, t in rows], "doc_id bigint, text string, n int, word string")
    assert dict(vocabulary(df).collect()) == brute_words(rows)
    assert dict(vocabulary(df.limit(0)).collect()) == {}

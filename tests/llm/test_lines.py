import contextlib
import io
import random
import re

import pytest

from tandemrank.llm import lines as lines_module
from tandemrank.llm.lines import BITS_APART, _verified, deduplicate, drop_emptied, groups, simhashes


def norm(x):
    return x.strip(" \t\r\f\x0b").lower()


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(spark, rows):
    """Kept texts of (doc_id, text) rows in order, by comparing all pairs of distinct lines."""
    hash_of = {r.w: r.x for r in spark.createDataFrame(sorted({(w,) for _, t in rows for x in (t or "").split("\n") for w in norm(x).split(" ") if w}) or [("a",)], "w string").selectExpr("w", "xxhash64(w) x").collect()}
    lines = sorted({norm(x) for _, t in rows for x in (t or "").split("\n")} - {""})

    def sim(x):
        ws = [hash_of[w] % 2**64 for w in set(x.split(" ")) if w]
        return sum(1 << b for b in range(64) if 2 * sum(w >> b & 1 for w in ws) > len(ws))

    sims, root = {x: sim(x) for x in lines}, {x: x for x in lines}

    def find(x):
        return x if root[x] == x else find(root[x])

    for i, x in enumerate(lines):
        for y in lines[:i]:
            if bin(sims[x] ^ sims[y]).count("1") <= BITS_APART and edits(x, y) <= 0.2 * max(len(x), len(y)) + 1e-9:
                root[find(x)] = find(y)
    seen, out = set(), {}
    for n in sorted(range(len(rows)), key=lambda n: (rows[n][0] is None, rows[n][0] or 0, n)):
        t, kept = rows[n][1], []
        for x in (t or "").split("\n"):
            g = find(norm(x)) if norm(x) else None
            if g is None or g not in seen:
                kept.append(x)
            seen.add(g)
        out[n] = None if t is None else "\n".join(kept)
    return [out[n] for n in range(len(rows))]


def made():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 8)))
    pool = [" ".join(word() for _ in range(r.randrange(1, 40))) for _ in range(40)]
    for x in pool[:30]:
        for _ in range(3):
            w = x.split(" ")
            w[r.randrange(len(w))] += r.choice(["s", ".", "x", ""])
            pool.append(" ".join(w))
    long = " ".join(word() for _ in range(150)).split(" ")
    for _ in range(30):  # a large group of near copies
        w = list(long)
        w[r.randrange(150)] = word()
        pool.append(" ".join(w))
    rows = [(i, "\n".join(r.choice([x, x.upper(), "  " + x]) if x else x for x in r.choices(pool + ["", " "], k=r.randrange(1, 8)))) for i in range(60)]
    return rows + [(100, None), (101, ""), (102, "\n \n"), (5, rows[5][1]), (None, "only here " * 3), (None, rows[3][1]), (200, "z" * 50_000)]


def test_against_brute_force(spark, docs):
    rows = made()
    d = docs(rows).coalesce(1).selectExpr("*", "1 as rid", "1 as gone")
    got = [(r.row.doc_id, r.row.text) for r in deduplicate(d).collect()]
    want = [(i, t) for (i, _), t in zip(rows, brute(spark, rows))]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_simhash_is_the_majority(spark):
    lines = spark.createDataFrame([("k1", "a b c a a"), ("k1", "a b c a a"), ("k2", "a")], "h string, norm string")
    got = {r.h: r.sim % 2**64 for r in simhashes(lines).collect()}
    x = [r.x % 2**64 for r in spark.sql("select xxhash64(w) x from values ('a'), ('b'), ('c') as t(w)").collect()]
    assert got == {"k1": (x[0] & x[1]) | (x[0] & x[2]) | (x[1] & x[2]), "k2": x[0]}


def test_emptied_documents_go(docs):
    d = docs([(1, "one line here\nand two"), (2, "One line here "), (3, None), (4, ""), (5, "and two\nthree")])
    got = {r.doc_id: (r.text, r.n_chars) for r in drop_emptied(d).collect()}
    assert got == {1: ("one line here\nand two", 21), 3: (None, None), 4: ("", 0), 5: ("three", 5)}
    assert drop_emptied(d).columns == d.columns and drop_emptied(docs([])).count() == 0


def test_edit_similarity_without_common_words(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("ab") for _ in range(r.randrange(0, 4)))
    texts = [" ".join(word() for _ in range(r.randrange(1, 7))).strip() or "a" for _ in range(60)]
    texts = sorted(set(texts)) + ["a b c d e f g h", "a b c d e f g", "x a b c d e f g h", "a b c d e f g h a b", "a b c c d e f g h"]
    df = spark.createDataFrame([(str(i), t, len(t)) for i, t in enumerate(texts)], "h string, norm string, len int")
    pairs = [(str(i), str(j)) for i in range(len(texts)) for j in range(i)]
    got = {(x.a, x.b) for x in _verified(spark.createDataFrame(pairs, "a string, b string"), df, 0.8).collect()}
    want = {(a, b) for a, b in pairs for x, y in [(texts[int(a)], texts[int(b)])] if edits(x, y) <= int(max(len(x), len(y)) * 0.2 + 1e-9)}
    assert got == want and len(want) > 5


def test_one_changed_stretch_links_at_every_length(spark):
    r = random.Random(11)
    rows = []
    for n in [*range(5, 40), 60, 90, 150, 300, 700]:
        for _ in range(3):
            a = "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n - 2))
            a, d = f"x{a}y", int(n * 0.2 + 1e-9)
            cut, put = r.choice([(d, d), (d, 0), (1, 1), (1, 0), (d, r.randrange(d + 1))])
            at = r.randrange(1, n - cut)
            rows.append((a, a[:at] + "".join(r.choice("0123456789") for _ in range(put)) + a[at + cut :]))
    lines = [(f"{i}{k}", x) for i, pair in enumerate(rows) for k, x in zip("ab", pair)]
    df = spark.createDataFrame(lines, "h string, norm string")
    root = {x.node: x.root for x in groups(df, ends=True).collect()}
    missed = [pair for i, pair in enumerate(rows) if root.get(f"{i}a", 0) != root.get(f"{i}b", 1)]
    assert not missed
    before = {x.node: x.root for x in groups(df).collect()}
    assert sum(f"{i}a" in before for i in range(len(rows))) < len(rows) / 2


@pytest.mark.parametrize("hubs", [4, 1])
def test_lines_with_a_common_end_meet_in_rounds(spark, monkeypatch, hubs):
    """Of 60 lines with one end, some near 0.8 apart: the groups are those of all links, and fewer pairs than all are compared."""
    monkeypatch.setattr(lines_module, "HUBS", hubs)
    monkeypatch.setattr(lines_module, "MORE_HUBS", 2)
    r = random.Random(12)
    word = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    end = " ".join(word(4) for _ in range(20))
    starts = [word(24) for _ in range(4)]
    texts = set()
    while len(texts) < 50:  # the starts' own variants: chains of links, some between groups
        x = list(r.choice(starts))
        for at in r.sample(range(24), r.randrange(0, 12)):
            x[at] = r.choice("abcdefgh")
        texts.add("".join(x) + " " + end)
    texts = sorted(texts | {word(60) + " " + end for _ in range(10)})
    asked = []
    verified = lines_module._verified

    def counted(pairs, *rest):
        asked.append(pairs.distinct().count())
        return verified(pairs, *rest)

    monkeypatch.setattr(lines_module, "_verified", counted)
    df = spark.createDataFrame([(str(i), x) for i, x in enumerate(texts)], "h string, norm string")
    got = {int(x.node): int(x.root) for x in groups(df, ends=True).collect()}
    root = list(range(len(texts)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for i, x in enumerate(texts):
        for j, y in enumerate(texts[:i]):
            if edits(x, y) <= int(0.2 * max(len(x), len(y)) + 1e-9):
                root[find(i)] = find(j)
    parts = lambda of: sorted(sorted(i for i in range(len(texts)) if of(i) == g) for g in {of(i) for i in range(len(texts))})
    assert parts(find) == parts(lambda i: got.get(i, i)) and len(asked) > 2
    assert sum(asked) < len(texts) * (len(texts) - 1) / 2


@pytest.mark.parametrize("block", [7, 32])
def test_unlike_lines_with_a_common_end_meet_in_blocks(spark, monkeypatch, block):
    """Of 80 mostly unlike lines with one end the groups are those of all links, and pairs that are no links stay within their blocks."""
    monkeypatch.setattr(lines_module, "BLOCK", block, raising=False)
    r = random.Random(13)
    word = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    end, starts = word(90), [word(r.randrange(48, 64)) for _ in range(70)]
    for x in starts[:10]:  # links between lengths, so between blocks
        x = list(x)
        for at in r.sample(range(40), 12):
            x[at] = r.choice("xyz")
        starts.append("".join(x)[r.randrange(8) :])
    asked = []
    verified = lines_module._verified

    def counted(pairs, *rest):
        asked.append(pairs.select("a", "b").distinct().count())
        return verified(pairs, *rest)

    monkeypatch.setattr(lines_module, "_verified", counted)
    df = spark.createDataFrame([(f"{i:02}", x + end) for i, x in enumerate(starts)], "h string, norm string")
    got = {int(x.node): int(x.root) for x in groups(df, ends=True).collect()}
    root = list(range(len(starts)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for i, x in enumerate(starts):
        for j, y in enumerate(starts[:i]):
            if edits(x, y) <= int(0.2 * (90 + max(len(x), len(y))) + 1e-9):
                root[find(i)] = find(j)
    parts = lambda of: sorted(sorted(i for i in range(len(starts)) if of(i) == g) for g in {of(i) for i in range(len(starts))})
    assert parts(find) == parts(lambda i: got.get(i, i)) and 10 < len(parts(find)) < 75
    assert sum(asked) < 10 * len(starts)


def test_bound_of_an_edit_distance(spark):
    """Never below the edit distance, and close to it after changes of single words, so that links need no full comparison."""
    r = random.Random(14)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(0, 9)))
    pairs = [("a", "b"), ("a", "b c"), ("a b", "b a"), ("a  b", "a b"), ("x", "x y z"), ("a b c d", "d c b a")]
    for _ in range(60):
        pairs.append(tuple(" ".join(word() for _ in range(r.randrange(1, 12))) or "z" for _ in "ab"))
    near = []
    for _ in range(60):
        a = [word() + "w" for _ in range(40)]
        b, at = list(a), r.randrange(38)
        b[at : at + 2] = r.choice([[b[at], "new", b[at + 1]], [b[at + 1]], [b[at] + "&&", b[at + 1]], [b[at + 1], b[at]]])
        near.append((" ".join(a), " ".join(b)))
    df = spark.createDataFrame([(a, b) for a, b in pairs + near], "a string, b string")
    got = [x.n for x in df.selectExpr("split(a, ' ') a", "split(b, ' ') b").select(lines_module._bound("a", "b").alias("n")).collect()]
    assert all(n >= edits(a, b) for n, (a, b) in zip(got, pairs + near))
    assert all(n <= 0.2 * max(len(a), len(b)) for n, (a, b) in zip(got[len(pairs) :], near))


def test_simhash_code_is_short_enough_to_be_compiled(spark):
    """The JVM only interprets methods of more than 8000 bytes."""
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else the code is made only as the query runs
    lines = spark.createDataFrame([(b"k", "a b c")], "h binary, norm string")
    out = io.StringIO()
    try:
        with contextlib.redirect_stdout(out):
            simhashes(lines, lines_module._ends(0.8)).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", out.getvalue())]
    assert sizes and max(sizes) < 8000


def test_rows_without_a_wanted_text_are_not_cut_again(spark, docs, monkeypatch):
    """Few of 300 rows hold lines that are alike: the texts of these are taken from few rows."""
    r = random.Random(15)
    line = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(20))
    texts = [line() for _ in range(300)]
    texts[7] += " one"
    cut, whole = [], lines_module._lines

    def counted(rows):
        cut.append(rows.count())
        return whole(rows)

    monkeypatch.setattr(lines_module, "_lines", counted)
    got = {x.row.doc_id: x.n_removed for x in deduplicate(docs([*enumerate(texts), (300, texts[7] + "s")]), ends=True).collect()}
    assert got[300] == 1 and sum(got.values()) == 1
    assert len(cut) == 2 and cut[0] == 301 and cut[1] < 30

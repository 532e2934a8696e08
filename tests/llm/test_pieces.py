import random

import numpy as np
import pytest

from tandemrank.llm import pieces
from tandemrank.llm.pieces import BYTE, CONTROL, NORMAL, SPACE, UNKNOWN, Model, decode, double_array, encode, round_trip


def toy(fallback=True, extra=()):
    out = [("<unk>", 0.0, UNKNOWN), ("<s>", 0.0, CONTROL)]
    if fallback:
        out += [(f"<0x{b:02X}>", 0.0, BYTE) for b in range(256)]
    words = {SPACE: -3.0, "a": -2.0, "b": -2.5, "ab": -3.9, SPACE + "a": -2.2, "ba": -4.0, "é": -3.3, SPACE + "ab": -6.5, "aba": -6.4, SPACE + SPACE: -5.0}
    return Model(out + [(p, s, NORMAL) for p, s in [*words.items(), *extra]])


def brute(m, text):
    """Best sum of scores over all segmentations of a marked text, character by character."""
    s = (SPACE + text.replace(" ", SPACE)) if text else ""
    scores = {p: v for p, v, kind in m.pieces if kind == NORMAL}
    best = [0.0] + [-1e18] * len(s)
    for i in range(len(s)):
        for j in range(i + 1, len(s) + 1):
            if s[i:j] in scores:
                best[j] = max(best[j], best[i] + scores[s[i:j]])
        if s[i] not in scores:
            best[i + 1] = max(best[i + 1], best[i] + m.unknown_score)
    return best[-1]


def cost(m, ids, text):
    """The sum of scores of ids; the bytes of one character are one unknown piece."""
    total, run = 0.0, []
    for i in ids:
        p, v, kind = m.pieces[i]
        if kind == BYTE:
            run.append(int(p[3:5], 16))
        else:
            total += v
    return total + m.unknown_score * len(bytes(run).decode())


@pytest.mark.parametrize("extra", [(), (("b" + SPACE, -1.0),)])
def test_best_path_and_round_trip(extra):
    m, r = toy(extra=extra), random.Random(1)
    assert m.cuts == (not extra)
    texts = ["", None, " ", "\n", "a\n b", "  a  b ", "é€😀", "\n\n ab"] + ["".join(r.choice("aab é\n€") for _ in range(r.randrange(1, 30))) for _ in range(300)]
    ids, many = m.encode(texts)
    at = 0
    for t, n in zip(texts, many):
        own, at = ids[at : at + n].tolist(), at + n
        assert m.decode(own) == (t or "")
        assert abs(cost(m, own, t) - brute(m, t or "")) < 1e-9, t


def test_long_units_have_the_same_path(monkeypatch):
    r = random.Random(3)
    for m in (toy(), toy(fallback=False)):
        for _ in range(60):
            text = "".join(r.choice("aabé€") for _ in range(r.randrange(1, 40)))
            monkeypatch.setattr(pieces, "_LONG_UNIT", 96)
            short = m.encode([text])[0].tolist()
            monkeypatch.setattr(pieces, "_LONG_UNIT", 0)
            assert m.encode([text])[0].tolist() == short


def test_unknown_characters_without_bytes_are_one_piece():
    m = toy(fallback=False)
    ids, _ = m.encode(["a€€b"])
    assert [m.pieces[i][0] for i in ids] == [SPACE + "a", "<unk>", "b"]


def test_double_array_holds_exactly_its_words():
    r = random.Random(2)
    words = {bytes(r.choice(b"abz\xff\x00") for _ in range(r.randrange(1, 6))): i for i in range(400) for _ in [0]}
    base, check, value = double_array(words)

    def find(w):
        state = 0
        for b in w:
            to = base[state] + b
            if check[to] != state:
                return -1
            state = to
        return value[state]

    assert all(find(w) == i for w, i in words.items())
    for _ in range(500):
        w = bytes(r.choice(b"abz\xff\x00") for _ in range(r.randrange(1, 6)))
        assert find(w) == words.get(w, -1)


def test_slices_do_not_matter(monkeypatch):
    m = Model(*pieces.read_model(pieces.default_model()))
    text = "Ouwhea the of\nrend and  threlyes. ÉÈ 你好 " * 50
    whole = m.encode([text] * 3)
    monkeypatch.setattr(pieces, "_MOST_CELLS", 40)
    again = m.encode([text] * 3)
    assert (whole[0] == again[0]).all() and len(set(whole[1])) == 1 and m.decode(whole[0][: whole[1][0]]) == text


def test_tables(docs):
    d = docs([(1, None), (2, ""), (3, "The  sea\n was"), (3, "The  sea\n was"), (None, "x" * 100_000), (4, "a" + SPACE + "b")])
    d = d.selectExpr("*", "'k' as row", "'k' as ids")
    got = round_trip(d)
    assert set(d.columns) <= set(got.columns)
    rows = {(r.doc_id, r.text): r for r in got.collect()}
    assert got.count() == 6 and rows[1, None].n_tokens == 0 == rows[2, ""].n_tokens
    assert all(r.round_trip == (r.doc_id != 4) for r in rows.values())
    back = decode(encode(d, out="codes"), "codes", "text")
    assert {(r.doc_id, r.text) for r in back.collect()} == {(i, (t or "").replace(SPACE, " ")) for i, t in rows}
    assert round_trip(docs([])).count() == 0

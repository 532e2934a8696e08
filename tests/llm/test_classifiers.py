import random
import zlib

import numpy as np

from tandemrank.llm import language, quality
from tandemrank.llm.common import fold_pieces, words_of


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_word_hashes_follow_words():
    text = "The  cat, the CAT\ndeéjà vu!!"
    h, kind, starts, ends = words_of(text.encode(), signs=True)
    raw = [text.encode()[a:b].decode() for a, b in zip(starts, ends)]
    assert raw == ["The", "cat", ",", "the", "CAT", "deéjà", "vu", "!!"] and list(kind) == [1, 1, 2, 1, 1, 1, 1, 2]
    assert h[0] == h[3] and h[1] == h[4] and len(set(h.tolist())) == 6
    whole, _, _, _ = words_of(text.encode(), signs=False)
    assert len(whole) == 6 and words_of(b"", True)[0].size == 0
    assert words_of(b"x y", False)[0][1] == words_of(b"long words before y", False)[0][3]


def test_pieces_join_to_the_text_and_features_do_not_depend_on_cuts(monkeypatch):
    text = " ".join(random.Random(5).choice(["alpha", "beta,", "GAMMA!!", "d"]) for _ in range(4000))
    assert b"".join(fold_pieces(text.encode(), 500)) == text.encode() and b"".join(fold_pieces(b"z" * 1200, 500)) == b"z" * 1200
    i, x = quality.features(text)
    monkeypatch.setattr(quality, "fold_pieces", lambda d: fold_pieces(d, 700))
    j, y = quality.features(text)
    assert (i == j).all() and np.allclose(x, y)
    seen = np.zeros(1 << language.BITS, bool)
    a = language.grams(text, seen)
    monkeypatch.setattr(language, "fold_pieces", lambda d: fold_pieces(d, 700))
    b = language.grams(text, seen)
    assert len(np.setxor1d(a, b)) == 0 and not seen.any()


def test_quality_learns_and_ignores_held_out_labels(spark, docs):
    r = random.Random(1)
    good = lambda: " ".join(r.choice(["the", "river", "stone,", "wind", "over."]) for _ in range(30))
    bad = lambda: " ".join(r.choice(["BUY", "NOW", "CHEAP", "WIN"]) + "!!" for _ in range(30))
    rows = [(i, good() if i % 3 else bad()) for i in range(240)]
    labels = [(i, int(i % 3 > 0) if not held(i) else int(i % 3 == 0), 0) for i in range(240)]  # held-out labels are turned round
    labels += [(1, None, None), (None, 1, 0), (2, 1, 0)]
    d, lab = docs(rows + [(900, None), (901, ""), (None, "x"), (902, "word " * 300_000)]), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {x.doc_id: x.score for x in quality.score(d, quality.train(d, lab)).collect()}
    assert len(got) == 244 and all(0 <= s <= 1 for s in got.values()) and got[900] == got[901]
    assert all((got[i] > 0.5) == bool(i % 3) for i in range(240) if held(i))
    none = lab.filter("false")
    assert {x.score for x in quality.score(d, quality.train(d, none)).collect()} == {0.5}
    assert quality.score(docs([]), quality.train(docs([]), none)).count() == 0


def test_ftrl_steps_match_the_formula():
    w = quality.ftrl([(np.array([0, 1]), np.array([1.0, 2.0]), 1.0)], 3, epochs=1)
    g = np.array([-0.5, -1.0])
    want = -(g + quality.L1) / ((quality.BETA + np.abs(g)) / quality.ALPHA + quality.L2)
    assert np.allclose(w[:2], want) and w[2] == 0


def test_kernel_is_exact():
    texts = ["Ab cd", "abc", "x1y", "über"]
    rows, presence, norms = language.landmarks(texts)
    seen = np.zeros(1 << language.BITS, bool)
    sets = [set(language.grams(t, seen)) for t in texts]
    want = [[len(a & b) / (len(a) * len(b)) ** 0.5 for b in sets] for a in sets]
    assert np.allclose(language.kernel(texts, rows, presence, norms), want)


def test_language_learns_and_rejects(docs):
    r = random.Random(2)
    words = {"a1": ["tion", "the", "shing"], "b2": ["eux", "étre", "oui"]}
    rows = [(i, " ".join(r.choice(words[c]) for _ in range(12)), c) for i in range(80) for c in [("a1", "b2")[i % 2]]]
    odd = [(500, None, None), (501, "12 !?", "a1"), (502, "", "b2"), (None, "the the", None), (503, "oui " * 400_000, None), (500, None, None)]
    d = docs(rows + odd)
    d = d.selectExpr("*", "doc_id as row", "doc_id as h", "doc_id as nth")
    model = language.train(d)
    got = [(x.doc_id, x.lang_pred, x.score) for x in language.predict(d, model).collect()]
    assert len(got) == 86 and sorted(x[0] for x in got if x[1] == "und") == [500, 500, 501, 502]
    by = {x[0]: x for x in got}
    assert all(by[i][1] == ("a1", "b2")[i % 2] and 0.5 < by[i][2] <= 1 for i in range(80)) and by[None][1] == "a1" and by[503][1] == "b2"
    kept = language.keep_known(d)
    assert kept.columns == d.columns and kept.count() == 82
    assert language.predict(docs([(1, "abc", None)]), language.train(docs([(1, "abc", None)]))).first().lang_pred == "und"
    assert language.predict(docs([]), language.train(docs([]))).count() == 0


def test_a_language_of_copies_is_learnt(docs):
    ids = [i for i in range(4000) if not held(i)]
    copies = [(i, "eux oui nous", "fr") for i in ids[:2500]] + [(i, f"eux oui {i}", "fr") for i in ids[2500:2502]]
    model = language.train(docs(copies + [(i, f"the river {i}", "en") for i in ids[2600:2640]]), per_lang=3, count=6)
    assert model.langs == ["en", "fr"] and len(model.norms) == 6
    for text in ["eux oui nous", "one", "two words", "der die das"]:
        assert language.train(docs([(i, text, "fr") for i in ids[:2500]]), per_lang=3).langs == ["fr"]


def test_documents_with_letters_stay_without_a_model(docs):
    texts = [(1, "abc"), (2, "12 !?"), (3, None), (4, ""), (None, "über"), (5, "x\u00b2"), (6, "\u00b2"), (7, "\n\n語")]
    want = sorted(str(i) for i, t in texts if t and language._LETTER.search(t))
    unlabelled = [(i, t, None) for i, t in texts]
    out = [(i, t, "en") for i in range(50) if held(i) for t in ["in the held-out fifth"]]
    for rows, more in ((unlabelled, []), (unlabelled + out, [str(i) for i, _, _ in out])):
        d = docs(rows)
        kept = language.keep_known(d)
        assert kept.columns == d.columns and sorted(str(x.doc_id) for x in kept.collect()) == sorted(want + more)

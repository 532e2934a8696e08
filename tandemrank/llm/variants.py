"""Groups of spelling variants: the vocabulary's acceptor, a one-edit transducer and the acceptor again are composed."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandemrank.llm.common import drop, materialize, mix, table
from tandemrank.llm.registry import query

LEAST_LETTERS, LEAST_COUNT, TIMES, NOISE = 7, 2, 10, 31
BATCH_WORDS, BATCH_CELLS, HELD_WORDS = 60_000, 8_000_000, 300_000
_RUN = re.compile(rf"[A-Za-zÀ-ÿ]{{{LEAST_LETTERS},}}")
_FINAL = np.uint64(1 << 63)


def letters_of(text: str | None) -> list[str]:
    """The maximal runs of at least LEAST_LETTERS letters of a whole text, A-Z in lower case."""
    found = _RUN.findall(text or "")
    return " ".join(found).encode().lower().decode().split(" ") if found else found


def vocabulary(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """``(word, n)``: words of at least LEAST_LETTERS code points that occur ``least`` times or more in all whole texts.

    Where NOISE divides h, the crc32 of ``<doc_id>:<run>``, the run loses its code point h % length; a null id is an empty one.
    Tasks add up what they meet and hand over at most HELD_WORDS words at a time.
    """

    def run(batches):
        held: Counter = Counter()

        def out():
            words = pa.array(list(held), pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text")):
                start = zlib.crc32(f"{'' if d is None else d}:".encode())
                for w, n in Counter(letters_of(t.as_py())).items():
                    h = zlib.crc32(w.encode(), start)
                    if h % NOISE == 0:
                        at = h % len(w)
                        w = w[:at] + w[at + 1 :]
                    if len(w) >= LEAST_LETTERS:
                        held[w] += n
                if len(held) >= HELD_WORDS:
                    yield out()
                    held.clear()
        yield out()

    each = docs.select("doc_id", "text").mapInArrow(run, "word string, n bigint")
    return each.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


class Acceptor:
    """The minimised acceptor of ``words``, rows of codes in order, padded with 0, each row of one of the sorted ``parts``.

    Nodes are the beginnings of words within a part; those with equal sets of endings are one state. The state's name is a
    64-bit hash over its endings' tree, so equal endings merge across all depths and parts.
    """

    def __init__(self, codes: np.ndarray, lens: np.ndarray, parts: np.ndarray):
        n, width = codes.shape
        same = np.ones((n, width + 1), bool)
        same[0, :] = False
        same[1:, :-1] = codes[1:] == codes[:-1]
        same[1:, -1] = False
        lcp = np.argmin(same, axis=1)
        lcp[np.concatenate([[True], parts[1:] != parts[:-1]])] = -1
        lows, firsts, labels, parents, base, above = [], [], [], [], 0, None
        for d in range(int(lens.max()) + 1):
            first = np.flatnonzero((lens >= d) & (lcp < d))
            if d:
                parents.append(above[first])
                labels.append(codes[first, d - 1])
            lows.append(first)
            firsts.append(base)
            node = np.cumsum((lens >= d) & (lcp < d)) - 1 + base
            base += len(first)
            above = node
        self.low = np.concatenate(lows)
        depth = np.repeat(np.arange(len(lows)), [len(x) for x in lows])
        self.final = lens[self.low] == depth
        roots = len(lows[0])
        parent = np.concatenate([np.full(roots, -1), *parents]) if parents else np.full(roots, -1)
        label = np.concatenate([np.zeros(roots, np.int64), *labels]) if labels else np.zeros(roots, np.int64)
        # From the longest beginnings to the shortest: names, numbers of endings and sets of next letters.
        name = np.zeros(base, np.uint64)
        self.count = self.final.astype(np.int64)
        mask = np.where(self.final, _FINAL, np.uint64(0))
        for first, size in zip(firsts[::-1], [len(x) for x in lows][::-1]):
            own = slice(first, first + size)
            name[own] = mix(name[own] + np.where(self.final[own], np.uint64(0x632BE59BD9B4E019), np.uint64(0x1B873593CC9E2D51)))
            if first:
                np.add.at(name, parent[own], mix(name[own] ^ mix(label[own].astype(np.uint64) + np.uint64(0x51ED27))))
                np.add.at(self.count, parent[own], self.count[own])
                np.bitwise_or.at(mask, parent[own], np.uint64(1) << (label[own].astype(np.uint64) % np.uint64(63)))
        _, rep, self.state = np.unique(name, return_index=True, return_inverse=True)
        self.states = len(rep)
        self.state_final, self.state_count, self.state_mask = self.final[rep], self.count[rep], mask[rep]
        # Arcs of the states, from their first nodes, by state and letter; ``skip`` words come before the arc's.
        arcs = np.flatnonzero(parent >= 0)
        order = np.argsort(parent[arcs], kind="stable")
        self.child, self.parent, self.label = arcs[order], parent[arcs][order], label[arcs][order]
        chosen = rep[self.state[self.parent]] == self.parent
        source, to, letter = self.state[self.parent[chosen]], self.child[chosen], self.label[chosen]
        order = np.lexsort((letter, source))
        self.key = source[order] * (1 << 21) + letter[order]
        self.letter = letter[order]
        self.target = self.state[to[order]]
        self.skip = (self.low[to] - self.low[self.parent[chosen]])[order]
        self.degree = np.bincount(source, minlength=self.states)
        self.start = np.concatenate([[0], np.cumsum(self.degree)[:-1]])

    def edits(self):
        """Arcs of the one-edit transducer between two copies: ``(low word, low word, state, state)`` of both sides after it.

        A replaced letter gives two arcs of one node, a deleted one an arc and the node itself. Only arcs into
        states that share a next letter or an end can be part of a pair.
        """
        out = [self._kept(self.low[self.child], self.low[self.parent], self.state[self.child], self.state[self.parent])]
        t, left = 1, np.arange(len(self.parent))
        while len(left := left[left + t < len(self.parent)]) and len(left := left[self.parent[left] == self.parent[left + t]]):
            a, b = self.child[left], self.child[left + t]
            out.append(self._kept(self.low[a], self.low[b], self.state[a], self.state[b]))
            t += 1
        return [np.concatenate(x) for x in zip(*out)]

    def _kept(self, i, j, u, v):
        ok = (self.state_mask[u] & self.state_mask[v]) != 0
        return i[ok], j[ok], u[ok], v[ok]

    def both(self, u: np.ndarray, v: np.ndarray):
        """Common arcs of pairs of states: position of the pair, arc of the first, arc of the second."""
        swap = self.degree[u] > self.degree[v]
        a, b = np.where(swap, v, u), np.where(swap, u, v)
        pair = np.repeat(np.arange(len(a)), self.degree[a])
        inner = np.arange(len(pair)) - np.repeat(np.cumsum(self.degree[a]) - self.degree[a], self.degree[a])
        arc = self.start[a][pair] + inner
        if not len(arc):
            return pair, arc, arc
        want = b[pair] * (1 << 21) + self.letter[arc]
        at = np.searchsorted(self.key, want).clip(0, len(self.key) - 1)
        ok = self.key[at] == want
        pair, arc, at = pair[ok], arc[ok], at[ok]
        return pair, np.where(swap[pair], at, arc), np.where(swap[pair], arc, at)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of words of a part that the composition accepts, each once, as positions ``(i, j)``, i < j.

        First the composed states (pairs of states) that the edits reach are listed layer by layer and those that lead to
        no common ending are taken out again; then only what is left is walked with words. Two equal states share all
        endings and are not walked further.
        """
        i, j, u, v = self.edits()
        size = self.states
        layers, steps = [np.unique(u * size + v)], []
        while True:
            x, y = layers[-1] // size, layers[-1] % size
            pair, a, b = self.both(np.where(x == y, 0, x), np.where(x == y, 0, y))
            open_ = x[pair] != y[pair]
            pair, codes = pair[open_], (self.target[a] * size + self.target[b])[open_]
            if not len(codes):
                break
            unique, to = np.unique(codes, return_inverse=True)
            steps.append((pair, to))
            layers.append(unique)
        live = []
        for t in range(len(layers) - 1, -1, -1):
            x, y = layers[t] // size, layers[t] % size
            ok = (x == y) | (self.state_final[x] & self.state_final[y])
            if t < len(steps):
                pair, to = steps[t]
                np.logical_or.at(ok, pair, live[-1][to])
            live.append(ok)
        live = live[::-1]
        found = []
        for codes, ok in zip(layers, live):
            keep = ok[np.searchsorted(codes, u * size + v)]
            i, j, u, v = i[keep], j[keep], u[keep], v[keep]
            equal = u == v
            n = self.state_count[u[equal]]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            found.append((np.repeat(i[equal], n) + step, np.repeat(j[equal], n) + step))
            i, j, u, v = i[~equal], j[~equal], u[~equal], v[~equal]
            ends = self.state_final[u] & self.state_final[v]
            found.append((i[ends], j[ends]))
            pair, a, b = self.both(u, v)
            i, j, u, v = i[pair] + self.skip[a], j[pair] + self.skip[b], self.target[a], self.target[b]
        i, j = (np.concatenate(x) for x in zip(*found))
        low, high = np.minimum(i, j), np.maximum(i, j)
        code = np.unique(low * (high.max(initial=0) + 1) + high) if len(low) else low
        return code // (high.max(initial=0) + 1), code % (high.max(initial=0) + 1)


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lens = np.array([len(w) for w in words], np.int64)
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    out = np.zeros((len(words), max(1, int(lens.max(initial=0)))), np.int64)
    out[np.arange(out.shape[1]) < lens[:, None]] = flat
    return out, lens


def near_in_parts(side: list[int], half: list[int], fixed: list[str], words: list[str], counts: list[int]) -> tuple[list, ...]:
    """Of the words of whole partitions: ``(word, near words, largest count of one, smallest such word)``, words without left out.

    A partition belongs to a half-length ``half`` and holds words of 2 half to 2 half + 2 code points that begin
    (side 0) or end (side 1) with ``fixed``, of ``half`` code points. It owns the pairs whose shorter word has 2 half or 2 half + 1
    and, on side 1, whose beginnings differ; so each pair has one owner.
    """
    rest = [w[h:] if s == 0 else w[: len(w) - h][::-1] for s, h, w in zip(side, half, words)]
    order = sorted(range(len(words)), key=lambda k: (side[k], half[k], fixed[k], rest[k]))
    key = [(side[k], half[k], fixed[k]) for k in order]
    part = np.cumsum([0] + [a != b for a, b in zip(key, key[1:])])
    size = np.bincount(part)[part]
    kept = [k for k, n in zip(order, size) if n > 1]
    if not kept:
        return [], [], [], []
    part = part[size > 1]
    i, j = Acceptor(*_codes([rest[k] for k in kept]), part).pairs()
    long = np.array([len(words[k]) for k in kept])
    h, s = np.array([half[k] for k in kept]), np.array([side[k] for k in kept])
    heads, _ = _codes([words[k][: half[k]] for k in kept])
    owned = np.minimum(long[i], long[j]) // 2 == h[i]
    i, j = i[owned], j[owned]
    owned = (s[i] == 0) | (heads[i] != heads[j]).any(axis=1)
    i, j = np.concatenate([i[owned], j[owned]]), np.concatenate([j[owned], i[owned]])
    own = [words[k] for k in kept]
    rank = np.zeros(len(own), np.int64)
    rank[sorted(range(len(own)), key=own.__getitem__)] = np.arange(len(own))
    n = np.array([counts[k] for k in kept], np.int64)
    best = np.lexsort((rank[j], -n[j], i))
    i, j = i[best], j[best]
    first = np.flatnonzero(np.diff(i, prepend=-1))
    total = np.diff(np.append(first, len(i)))
    return [own[k] for k in i[first]], total.tolist(), n[j[first]].tolist(), [own[k] for k in j[first]]


def near_words(words: DataFrame) -> DataFrame:
    """``(word, n_near, best)`` for each of ``words(word, n)`` with a word one edit away; ``best`` is (-n, word) of the commonest.

    One edit leaves the first or the last half of the shorter word whole. So the words are dealt to partitions by these halves,
    which are the initial states of the composed machine; each word stands in two to four. A task reads its partitions in
    order and composes some of them at a time, whole ones only.
    """
    parts = []
    for down in (0, 1):
        h = F.floor((F.length("word") - down) / 2).cast("int")
        again = F.lit(True) if down == 0 else F.length("word") % 2 == 0  # of odd lengths both halves are one
        parts += [
            F.when(again, F.struct(F.lit(0).alias("side"), h.alias("half"), F.substring("word", F.lit(1), h).alias("fixed"))),
            F.when(again, F.struct(F.lit(1).alias("side"), h.alias("half"), F.substring("word", F.length("word") - h + 1, h).alias("fixed"))),
        ]
    dealt = words.select("word", "n", F.explode(F.array_compact(F.array(*parts))).alias("p")).select("p.*", "word", "n")

    def run(batches):
        held = [[] for _ in range(5)]

        def out(rows):
            got = near_in_parts(*rows)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(got, kinds)], names=["word", "n_near", "n", "other"])

        for b in batches:
            new = [c.to_pylist() for c in b.columns]
            at = 0
            for k in range(b.num_rows):
                row = (new[0][k], new[1][k], new[2][k])
                if held[0] or k > at:
                    last = (new[0][k - 1], new[1][k - 1], new[2][k - 1]) if k > at else (held[0][-1], held[1][-1], held[2][-1])
                    rows = len(held[0]) + k - at
                    if row != last and (rows >= BATCH_WORDS or rows * (row[1] + 2) > BATCH_CELLS):
                        yield out([x + y[at:k] for x, y in zip(held, new)])
                        held, at = [[] for _ in range(5)], k
            held = [x + y[at:] for x, y in zip(held, new)]
        yield out(held)

    order = ["side", "half", "fixed"]
    found = dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(run, "word string, n_near bigint, n bigint, other string")
    best = F.min(F.struct((-F.col("n")).alias("n"), "other")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for ``forms(word, form)``: from each word follow forms to the last one.

    A form is at least twice as common as its word, so paths have no rings; each round doubles the steps taken.
    """
    state = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        up = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = materialize(state.join(up, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        drop(state)
        state = new.select("word", "root")
        state._scratch_path = new._scratch_path
        if new.filter("moved").limit(1).count() == 0:
            return state


def spelling_forms(words: DataFrame, times: int = TIMES) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for distinct ``words(word, n)``, of at least two code points, and counts above 0.

    Near words differ by exactly one inserted, deleted or replaced code point. A word's form is its commonest near word
    (equal ones by code points) if that is at least ``times`` (2 or more) as common; ``root`` is where the forms end, the word
    itself without one. Words may have any length and need not be rare: pairs are enumerated in the tasks and leave
    them as one row a word. An empty table stays so.
    """
    near = near_words(words)
    whole = words.select("word", "n", F.lit(0).cast("bigint").alias("n_near"), F.lit(None).cast("struct<n:bigint,other:string>").alias("best"))
    more = near.select("word", F.lit(None).cast("bigint").alias("n"), "n_near", "best")
    each = whole.union(more).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    named = F.col("best.n") * -1 >= F.col("n") * times
    each = materialize(each.select("word", "n", "n_near", F.when(named, F.col("best.other")).alias("form"), F.when(named, -F.col("best.n")).alias("form_n")))
    ends = roots(each.filter("form IS NOT NULL"))
    return each.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


@query("op12_spelling_variants")
def op12(spark, sf_dir):
    words = materialize(vocabulary(table(spark, sf_dir, "documents")))
    return spelling_forms(words).select("word", "form", "root", "n", "n_near", "form_n")

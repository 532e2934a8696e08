"""Plain versions of pipeline stages."""


def kept_lines_once(before, after):
    """No normalised line occurs twice afterwards, and every kept line is the first of its kind or has no equal."""
    norm = lambda x: x.strip(" \t\r\f\x0b").lower()
    seen = [norm(x) for t in after.text for x in t.split("\n") if norm(x)]
    assert len(seen) == len(set(seen))
    had = {norm(x) for t in before.text for x in t.split("\n") if norm(x)}
    assert set(seen) <= had and len(had - set(seen)) <= 0.05 * len(had)
    texts = dict(zip(before.doc_id, before.text))
    for d in after.itertuples():
        own = texts[d.doc_id].split("\n")
        at = iter(own)
        assert all(x in at for x in d.text.split("\n")) and d.n_chars == len(d.text)


def similar_classes(before):
    """Smallest ids of the groups of texts with five-word similarity of 0.8 or more."""
    def grams(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    rows = sorted(zip(before.doc_id, before.text))
    sets, root = [grams(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if rows[i][1] == rows[j][1] or a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {rows[find(i)][0] for i in range(len(rows))}

"""Plain versions of what the operators compute, for small fixtures."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub(r"[A-Z]", lambda m: m.group().lower(), text or "")


def shingles(text, width=5):
    words = WORD.findall(lower(text))
    return {tuple(words)} if 0 < len(words) < width else {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def near(rows, percent=75, width=5):
    """{doc_id: (n_shingles, component_id)} by comparing all pairs."""
    sets = {d: shingles(t, width) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = {}
    for d, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(d)
    pairs = {(a, b) for ids in by.values() for i, a in enumerate(ids) for b in ids[i + 1 :]}
    for a, b in pairs:
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}

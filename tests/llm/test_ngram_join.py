import random

import pytest
from brute import near

from tessera.llm.ngram_join import PERCENT, keep_one, link_block, near_duplicates
import numpy as np


def texts(seed, n=160):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(r.choice(words) for _ in range(40))
    out, base = [], [[r.choice(words) for _ in range(r.choice([3, 8, 30, 60, 200]))] for _ in range(12)]
    for _ in range(n):
        b = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 3, 6])):
            b[r.randrange(len(b))] = r.choice(words)
        t = " ".join(b)
        if r.random() < 0.3:
            t += " " + passage
        out.append(t.title() if r.random() < 0.3 else t)
    return out + ["", None, " \n ", "one", "One", "one two", "a\x0bb\x0cc d e f", "İ ü É x y z"]


def got(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, **how)[0].collect()}


@pytest.mark.parametrize("how", [{}, {"window": 300, "frequent": 64}, {"window": 300, "block": 4}, {"percent": 50, "width": 3, "block": 3, "window": 200, "frequent": 7}])
def test_agrees_with_all_pairs(spark, how):
    rows = [(3 * i + 1, t) for i, t in enumerate(texts(len(how)))]
    random.Random(0).shuffle(rows)
    assert got(spark, rows, **how) == near(rows, how.get("percent", 75), how.get("width", 5))


def test_large_group_in_many_blocks(spark):
    r = random.Random(3)
    base = [f"x{i}" for i in range(50)]
    rows = []
    for i in range(150):
        b = list(base)
        for _ in range(i % 7):
            b[r.randrange(50)] = f"y{r.randrange(10**6)}"
        rows.append((i, " ".join(b)))
    assert got(spark, rows, block=8, window=500) == near(rows)


def test_blocks_report_a_spanning_forest():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 60, 40)).astype(np.uint64) for _ in range(80)]
    links, stars = link_block(list(range(80)), sets, 60)
    full = {(i, j) for i in range(80) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 60 * len(np.union1d(sets[i], sets[j]))}
    assert set(links) <= full

    def parts(edges):
        p = list(range(80))
        for a, b in edges:
            x, y = p[a], p[b]
            p = [x if k == y else k for k in p]
        return [[p[i] == p[j] for j in range(80)] for i in range(80)]

    assert parts(links) == parts(full) == parts(stars) and len(links) == 80 - len({tuple(x) for x in parts(full)})
    assert PERCENT == 75


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, component_id string")
    assert near_duplicates(empty)[0].collect() == [] and keep_one(empty).columns == empty.columns
    long = " ".join(f"v{i}" for i in range(60_000))
    rows = [(7, long, "a"), (5, long + " end", "b"), (None, "no id", "c"), (9, None, "d"), (9, None, "d"), (2, "x", "e"), (4, "x", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    out = sorted((r.doc_id is not None, r.doc_id or 0, r.component_id) for r in near_duplicates(df)[0].collect())
    assert out == [(False, 0, None), (True, 2, 2), (True, 4, 2), (True, 5, 5), (True, 7, 5), (True, 9, 9), (True, 9, 9)]
    assert sorted(r.component_id for r in keep_one(df).collect()) == ["b", "c", "d", "d", "e"]


@pytest.mark.parametrize("how", [{"window": 300, "block": 4}, {"percent": 50, "width": 3}])
def test_counts_every_link(spark, how):
    from brute import shingles

    r = random.Random(6)
    base = [f"x{i}" for i in range(50)]
    rows = [(1000 + i, t) for i, t in enumerate(texts(7, 80))]
    for i in range(60):
        b = list(base)
        for _ in range(i % 5):
            b[r.randrange(50)] = f"y{r.randrange(10**6)}"
        rows.append((i, " ".join(b)))
    percent, width = how.get("percent", 75), how.get("width", 5)
    sets = {d: frozenset(shingles(t, width)) for d, t in rows}
    distinct = {s for s in sets.values() if s}
    links = {s: sum(s != o and 100 * len(s & o) >= percent * len(s | o) for o in distinct) for s in distinct}
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), counts=True, **how)[0].collect()
    assert {x.doc_id: x.n_links for x in out} == {d: links.get(s, 0) for d, s in sets.items()}

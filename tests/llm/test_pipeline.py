import hashlib
import math
import random
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pandas as pd
import pytest
from brute import near

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def documents():
    r = random.Random(4)
    vocabulary = ["the", "of", "and", "river", "stone", "lamp", "quiet", "harbour", "seven", "green", "walks", "under", "bright", "window"]
    rows, labels = [], []
    for i in range(240):
        words = [r.choice(vocabulary) + r.choice(["", "s", "ed"]) + str(r.randrange(3) or "") for _ in range(r.choice([4, 30, 80]))]
        text = " ".join(words).capitalize() + "."
        if i % 6 == 0:
            text = "\n".join("!! ".join(words).upper() for _ in range(2)) + "!!"
        if i % 9 == 1 and i > 9 and rows[i - 9][1]:
            text = rows[i - 9][1]
        if i % 10 == 3 and i > 10 and rows[i - 10][1]:
            text = rows[i - 10][1] + " coda"
        rows.append((i, None if i == 77 else text, ["en", "fr"][i % 2], None if i % 11 == 0 else f"s{i % 3}", len(text)))
        if i % 2 == 0:
            labels.append((i, 0 if "!!" in text else 1, 0))
    return rows, labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    rows, labels = documents()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_agree_with_plain_versions(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        seen.append((name, docs, out))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        docs = spark.createDataFrame(out.collect(), out.schema)
    pairs = {name: ([tuple(r) for r in a.collect()], [tuple(r) for r in b.collect()]) for name, a, b in seen}

    before, after = pairs["quality classifier"]
    assert set(after) <= set(before)
    gone = set(before) - set(after)
    assert all("!!" in r[1] for r in gone) and len(gone) >= 0.9 * sum("!!" in (r[1] or "") for r in before)

    before, after = pairs["exact dedup"]
    keep = {}
    for r in before:
        keep[r[1] or ""] = max(r, keep.get(r[1] or "", r), key=lambda x: x[0])
    assert sorted(after) == sorted(keep.values())

    before, after = pairs["n-gram Jaccard join"]
    parts = near([(r[0], r[1]) for r in before])
    assert sorted(after) == sorted(r for r in before if parts[r[0]][1] == r[0])

    before, after = pairs["mixing sources"]
    size = {r[0]: len(WORDS.findall(r[1] or "")) for r in before}
    times = Counter(r[0] for r in after)
    assert set(after) <= set(before) and max(times.values()) <= 2
    total, targets = Counter(), {}
    for r in before:
        total[r[3]] += size[r[0]]
    names = sorted((s for s in total if s is not None)) + ([None] if None in total else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    open_, left = set(names), 1.5 * sum(total.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * total[s]}
        if not over:
            targets |= share
            break
        for s in over:
            targets[s] = 2 * total[s]
            left -= targets[s]
        open_ -= over
    for s in names:
        most = max((size[r[0]] for r in before if r[3] == s), default=0)
        assert abs(sum(size[d] * n for d, n in times.items() if any(r[0] == d and r[3] == s for r in before)) - targets[s]) <= most

    before, after = pairs["byte-level BPE"]
    texts = Counter((r[0], hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in before)
    assert Counter((r[0], r[3]) for r in after) == texts


def test_run_is_the_stages_in_turn(spark, folder):
    out = corpus_pipeline.run(spark, folder).toPandas()
    again = corpus_pipeline.run(spark, folder).toPandas()
    order = lambda df: df.sort_values(list(df.columns)).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(out), order(again))
    assert len(out) and not math.isnan(np.mean(out["n_tokens"]))

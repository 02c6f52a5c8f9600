"""Second scorers, models by country, samples of hot groups, files, late data, and similarities against plain versions."""

import os
import random
import zipfile
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.config import CURRENT
from tessera.functions import strsim
from tessera.operators import decode, embedding, sampling
from tessera.plans import cli, crosspair, model
from tessera.sources import records as io
from tessera.streaming import matching


def test_vectors_are_kept_by_content(spark, tmp_path):
    log = f"{tmp_path}/calls"

    def encode(texts):
        with open(log, "a") as f:
            f.writelines(t + "\n" for t in texts)
        return [[len(t), t.count("a")] for t in texts]

    long = "a" * 100_000
    one = spark.createDataFrame([("aa",), ("b",), ("aa",), ("",), (None,), (long + "x",)], "text string")
    two = spark.createDataFrame([("aa",), ("c",), (long + "y",)], "text string")
    folder = f"{tmp_path}/v"
    got = {r.text: r.vector for r in embedding.text_vectors(one, encode, "e", folder).collect()}
    assert set(got) == {"aa", "b", "", long + "x"} and got["aa"] == pytest.approx([2**-0.5] * 2) and got[""] == [0.0, 0.0]
    assert {r.text for r in embedding.text_vectors(two, encode, "e", folder).collect()} == {"aa", "c", long + "y"}
    assert sorted(map(len, open(log).read().splitlines())) == [0, 1, 1, 2, 100_001, 100_001]
    assert embedding.text_vectors(one.limit(0), encode, "other", folder).count() == 0


def test_name_cosines_are_the_plain_ones(spark, tmp_path):
    names = {"S1-1": "blue lamp", "S1-2": None, "S2-1": " blue lamps ", "S3-1": "stone"}
    rows = [(k, k[:2], "x", v) for k, v in names.items()]
    df = spark.createDataFrame(rows, "id string, source string, country string, name string")
    pairs = spark.createDataFrame([("x", s, q) for s in ("S1-1", "S1-2") for q in ("S2-1", "S3-1")], "country string, s1_id string, q_id string")
    v = {k: embedding.hashed_grams([(x or "").strip()])[0] for k, x in names.items()}
    for r in embedding.name_cosines(pairs, df, folder=str(tmp_path)).collect():
        length = np.linalg.norm(v[r.s1_id]) * np.linalg.norm(v[r.q_id])
        assert r.emb_cos == pytest.approx(v[r.s1_id] @ v[r.q_id] / length if length else 0.0, abs=1e-9)


def test_pair_scorer(spark, tmp_path):
    r = random.Random(2)
    words = ["blue", "lamp", "stone", "river", "oak", "elm"]
    rows = []
    for i in range(200):
        a = r.sample(words, 2)
        b = a if i % 2 else r.sample(words, 2)
        rows.append(("x", f"S1-{i}", f"S2-{i}", 0.5, int(a == b), " ".join(a), " ".join(b).upper()))
    df = spark.createDataFrame(rows, "country string, s1_id string, q_id string, p1 double, y int, a_raw string, b_raw string")
    cfg = replace(CURRENT, ce_train_pairs=150)
    model.save(crosspair.fit(df, cfg), f"{tmp_path}/m")
    scorer = model.load(f"{tmp_path}/m")
    raw = [(f"S{k}-{i}", f"S{k}", "x", row[4 + k]) for i, row in enumerate(rows) for k in (1, 2)]
    recs = spark.createDataFrame([*raw, ("S1-9999", "S1", "x", None)], "id string, source string, country string, raw string")
    scored = df.select("country", "s1_id", "q_id", (F.substring("s1_id", 4, 9).cast("double") / 50 - 2).alias("logit"), "y")
    out = crosspair.rescored(scored, recs, scorer, cfg, most=60).toPandas()
    nearest = out.assign(d=out["logit"].abs()).sort_values(["d", "q_id", "s1_id"]).head(60)
    assert len(out) == 200 and set(out[out["ce"] != 0]["q_id"]) == set(nearest["q_id"])
    assert ((nearest["ce"] > 0) == (nearest["y"] == 1)).mean() > 0.9
    # A walk of the weights: the words of one pair, marked by hand.
    weights, at = scorer.stages[2].coefficients.toArray(), scorer.stages[1].indexOf
    row = rows[int(nearest.iloc[0]["q_id"][3:])]
    a, b = set(row[5].split()), set(row[6].lower().split())
    marked = {"*", *("=" + t for t in a & b), *("-" + t for t in a - b), *("+" + t for t in b - a)}
    assert nearest.iloc[0]["ce"] == pytest.approx(scorer.stages[2].intercept + sum(weights[k] for k in {at(t) for t in marked}), abs=1e-9)


def test_first_rows_of_hot_groups(spark):
    rows = pd.DataFrame({"i": range(2000), "g": ["hot"] * 1900 + [None] * 60 + ["c"] * 40, "logit": [0.25] * 900 + [x / 100 for x in range(1099)] + [None]})
    df = spark.createDataFrame(rows)
    known = rows.dropna(subset=["logit"]).fillna({"g": ""}).assign(d=lambda x: x["logit"].abs()).sort_values(["d", "i"])
    for n in (0, 1, 50, 950, 5000):
        got = {x.i for x in sampling.most_uncertain(df, n, "g", "logit", ["i"]).collect()}
        assert 1999 not in got
        assert got == set(known.groupby("g").head(n)["i"])
    u = {x.i: x.u for x in df.select("i", sampling.uniform("i", 5).alias("u")).collect()}
    want = sorted(u, key=lambda i: (-np.log(u[i]) / (1 + i), i))[:300]
    assert {x.i for x in sampling.weighted(df.repartition(5), 300, 1 + F.col("i"), 5, "i").collect()} == set(want)
    assert sampling.most_uncertain(df.limit(0), 3, "g", "logit", ["i"]).count() == 0


def test_rules_by_country(spark):
    r = np.random.default_rng(4)
    rows = pd.DataFrame({"country": r.choice(["a", "b", "c"], 300)})
    rows = rows.assign(s1_id=rows["country"] + pd.Series(r.integers(0, 15, 300)).astype(str), q_id=rows["country"] + pd.Series(r.integers(0, 60, 300)).astype(str), logit=r.normal(0, 2, 300), ce=r.normal(0, 1, 300)).drop_duplicates(["s1_id", "q_id"])
    rules = {"": decode.Rule(prior=0.2), "b": decode.Rule(bias=1.0, ce_weight=0.7)}
    df = spark.createDataFrame(rows)
    got = {(x.s1_id, x.q_id) for x in decode.select_by(df, rules).collect()}
    want = set()
    for c in "abc":
        rule = rules.get(c, rules[""])
        part = df.where(F.col("country") == c).withColumn("logit", F.col("logit") + rule.ce_weight * F.col("ce"))
        want |= {(x.s1_id, x.q_id) for x in decode.select_matches(part, rule).collect()}
    assert got == want and got


def test_command_line_with_everything(spark, tmp_path, capsys):
    r = random.Random(11)
    words = ["blue", "lamp", "stone", "river", "oak", "elm", "north", "green", "iron", "glass", "wolf", "cedar"]
    for split in ("train", "test"):
        data, truth = {1: [], 2: [], 3: []}, []
        for i in range(60):
            name, addr, country = " ".join(r.sample(words, 3)), f"{r.randrange(10, 99)} {r.choice(words)} street {r.randrange(10000, 99999)}", r.choice(["US", "India"])
            data[1].append((f"S1-{i}", name, addr, country))
            own = [f"S{k}-{i}" for k in (2, 3) if r.random() < 0.7]
            for x in own:
                data[int(x[1])].append((x, name.replace("e", "ee", 1), addr.upper(), country))
            truth.append((f"S1-{i}", ",".join(own)))
        for k, rows in data.items():
            (tmp_path / f"{split}_source{k}.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\n" + "".join("\t".join(x) + "\n" for x in rows))
        (tmp_path / f"{split}_ground_truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\n" + "".join("\t".join(x) + "\n" for x in truth))
    flags = "--trees 2 --depth 2 --folds 2 --train-s1-frac 1 --early-stop false --use-emb true --use-ce true --by-country true --cache true".split()
    flags += ["--data-dir", str(tmp_path), "--out-dir", f"{tmp_path}/out", "--model-dir", f"{tmp_path}/m"]
    cli.main(["all", *flags])
    params = io.read_params(spark, f"{tmp_path}/m/params")
    assert set(params["decisions"]) == {"", "India", "US"} and params["groups"]["one"] == ["", "India", "US"] and "emb_cos" in params["s1_feats"]
    lines = [x.split("\t") for x in (tmp_path / "out" / "matching_results.tsv").read_text().splitlines()[1:]]
    assert sum(dict(truth)[k] == v for k, v in lines) > 45
    long = io.read_tsv(spark, f"{tmp_path}/out/matches_long").collect()
    assert sorted((x.source1_id, x.source2_or_source3_id) for x in long) == sorted((k, q) for k, v in lines for q in v.split(",") if q)
    kept = sorted(os.listdir(tmp_path / "m" / "predictions"))
    cli.main(["predict", *flags])
    assert sorted(os.listdir(tmp_path / "m" / "predictions")) == kept and len([k for k in kept if not k.startswith(".")]) == 1
    with pytest.raises(SystemExit) as end:
        cli.main(["package", *flags])
    assert end.value.code == 0, capsys.readouterr().out
    with zipfile.ZipFile(tmp_path / "out" / "submission.zip") as z:
        assert z.read("matching_results.tsv").decode().splitlines()[1:] == ["\t".join(x) for x in lines] and len(z.namelist()) == 2


def test_late_rows_are_dropped(spark, tmp_path):
    schema = "ts timestamp, event_type string, value double"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    batches = [[("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:20:00", "a", 2.0)], [("2024-01-01 05:00:00", "a", 4.0)], [("2024-01-01 00:30:00", "a", 8.0), ("2024-01-01 05:30:00", "b", 16.0)]]
    q = matching.late_counts(stream).writeStream.format("memory").queryName("late").outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        for i, rows in enumerate(batches):
            (tmp_path / "in" / f"{i}.json").write_text("".join(f'{{"ts": "{t}", "event_type": "{e}", "value": {v}}}\n' for t, e, v in rows))
            q.processAllAvailable()
        got = sorted((str(x.start), x.event_type, x.n, x.total) for x in spark.table("late").collect())
        assert [g[1:] for g in got] == [("a", 2, 3.0), ("a", 1, 4.0), ("b", 1, 16.0)]
    finally:
        q.stop()


def test_similarities_are_the_plain_ones():
    def ratio(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                row[j + 1], last = (last + 1 if x == y else max(row[j], row[j + 1])), row[j + 1]
        return 2 * row[-1] / (len(a) + len(b)) if a or b else 1.0

    def partial(a, b):
        if not a or not b:
            return float(a == b)
        found = []
        for short, long in ((a, b), (b, a)):
            if len(short) <= len(long):
                n = len(short)
                found += [ratio(short, long[max(0, i) : i + n]) for i in range(1 - n, len(long))]
        return max(found)

    def token_set(a, b):
        x, y = set(a.split()), set(b.split())
        if not x or not y:
            return 0.0
        if x & y and (x <= y or y <= x):
            return 1.0
        line = lambda *parts: " ".join(t for p in parts for t in sorted(p))
        sides = [line(x & y, x - y), line(x & y, y - x)]
        return max([ratio(*sides), *(ratio(line(x & y), s) for s in sides if x & y)])

    r = random.Random(9)
    for _ in range(1500):
        a, b = (" ".join("".join(r.choice("abc") for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(4))) for _ in range(2))
        assert strsim.ratio(a, b) == pytest.approx(ratio(a, b), abs=1e-12)
        assert strsim.token_sort_ratio(a, b) == pytest.approx(ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), abs=1e-12)
        assert strsim.token_set_ratio(a, b) == pytest.approx(token_set(a, b), abs=1e-12)
        assert strsim.partial_ratio(a, b) == pytest.approx(partial(a, b), abs=1e-12), (a, b)

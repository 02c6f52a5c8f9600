import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.config import CURRENT
from tessera.functions import normalize as n
from tessera.functions import strsim
from tessera.functions.translit import transliterate
from tessera.operators import decode, metrics, rarity, sampling, validate, windows
from tessera.operators.records import prepare
from tessera.plans import tune
from tessera.sources import records as io
from tessera.streaming import matching


def column(spark, f, xs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x string")
    return [r[0] for r in df.select(f(F.col("x")).alias("y"), "i").orderBy("i").select("y").collect()]


def test_names(spark):
    xs = ["Acme Trading as  Blue Café L L C", "www.foo-bar.com Services 12345678", "Mr. Jean DÉPÔT Sàrl", None, "", "Ltd", "Tata Consultancy Services", "a b c def"]
    assert column(spark, n.norm_name, xs) == ["blue cafe", "foo bar", "jean depot", "", "", "", "tata consultancy", "abc def"]
    assert column(spark, n.acronym, ["tata consultancy", "one", ""]) == ["tc", "", ""]
    assert column(spark, n.name_sort, ["b a c", ""]) == ["a b c", ""]
    a, b = column(spark, n.name_skeleton, ["saut prodkts", "south products"])
    assert a == b == "stprdkts"


def test_addresses(spark):
    xs = ["007 New York Street, Suite 000", "n/a Near Saint Mary 12 West Bengal", None, "new york new york"]
    assert column(spark, n.norm_addr, xs) == ["7 ny st ste 0", "n a st mary 12 wb", "", "ny new york"]


def test_skeleton_is_the_plain_one(spark):
    r = random.Random(0)
    xs = ["".join(r.choice("abcdehiknopqstuvwxyz9") for _ in range(r.randrange(12))) for _ in range(300)]

    def plain(t):
        for a, b in n.MERGES:
            t = t.replace(a, b)
        t = "".join(c for c in t if c not in "aeiouy")
        return "".join(c for i, c in enumerate(t) if i == 0 or c != t[i - 1])

    assert column(spark, n.skeleton, xs) == [plain(x) for x in xs]


def test_prepared_record(spark):
    df = spark.createDataFrame([("S1-1", "S1", "US", "Blue Lamp Inc", "12 Main Street 02139 Boston 7"), ("S2-1", "S2", "US", None, None)], "id string, source string, country string, name string, addr string")
    a, b = prepare(df, keep_raw=True).orderBy("id").collect()
    assert (a.hn, a.postal, a.nums, a.atok, a.first_w, a.noaddr) == ("12", "", ["12", "2139", "7"], ["main", "boston"], "blue", False)
    assert (b.nname, b.noaddr, b.raw, b.ntok) == ("", True, " ; ", [])


def test_similarities():
    assert strsim.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert strsim.jaro_winkler("dixon", "dicksonx") == pytest.approx(0.8133, abs=1e-4)
    r = random.Random(1)

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                row[j + 1], last = (last + 1 if x == y else max(row[j], row[j + 1])), row[j + 1]
        return row[-1]

    for _ in range(500):
        a, b = ("".join(r.choice("abc ") for _ in range(r.randrange(9))) for _ in range(2))
        assert strsim.lcs(a, b) == lcs(a, b)
        short, long = sorted((a, b), key=len)
        if short and len(a) != len(b):
            k = len(short)
            spans = [long[max(0, i) : max(0, i) + (k if i >= 0 else k + i)] for i in range(1 - k, len(long))]
            assert strsim.partial_ratio(a, b) >= max(strsim.ratio(short, x) for x in spans if len(x) == k) - 1e-12
    assert (strsim.ratio("", ""), strsim.token_set_ratio("", ""), strsim.token_set_ratio("a b", "b a c")) == (1.0, 0.0, 1.0)
    assert strsim.token_sort_ratio("b a", "a b") == 1.0


def test_transliteration():
    assert transliterate("Café Straße") == "cafe strasse"
    assert transliterate("राम") == "raama" and transliterate("Ω") == "o"


def test_rarity_and_keys(spark):
    rows = [("S1-1", "S1", "x", "red lamp", "1 oak st"), ("S2-1", "S2", "x", "red lamp", "1 oak st"), ("S3-1", "S3", "x", "red stone", "elm hill road"), ("S2-2", "S2", "y", "", "")]
    p = prepare(spark.createDataFrame(rows, "id string, source string, country string, name string, addr string"))
    k = rarity.add_keys(rarity.add_rarity(p)).where("id = 'S2-1'").first()
    assert (k.rn1, k.ra1, k.ra2, k.k_nm_hn, k.k_hn_st, k.k_st2) == ("lnp", "oak", "", "lnp|1", "1|oak", "")
    keys = rarity.long_keys(rarity.add_keys(rarity.add_rarity(p)))
    assert {r.key_name for r in rarity.capped_blocks(keys).collect()} >= {"k_name_clean", "k_nm_st"}


def test_metric_cases(spark):
    pairs = lambda *x: spark.createDataFrame([p for p in x] or [("", "")], "s1_id string, q_id string").where("s1_id <> ''")
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "s1_id string")
    per = {r.s1_id: r.f05 for r in metrics.per_entity(ids, pairs(("a", "1"), ("a", "2"), ("a", "3"), ("c", "9")), pairs(("a", "1"), ("a", "3"))).collect()}
    assert per["a"] == pytest.approx(0.714, abs=1e-3) and per["b"] == 1.0 and per["c"] == 0.0


@pytest.mark.parametrize("count,place", [(500, 0), (1000, 1), (2000, 2), (0, None)])
def test_prune_threshold(spark, count, place):
    df = spark.range(count).select((F.col("id") / 10.0).alias("p1"), F.lit(1).alias("y"))
    assert metrics.prune_threshold(df, 0.999).first().tau == (0.0 if place is None else place / 10.0)


@pytest.mark.parametrize("seed", [1, 2])
def test_decoder_is_the_plain_one(spark, seed):
    r = np.random.default_rng(seed)
    rows = pd.DataFrame({"s1_id": [f"s{x:03d}" for x in r.integers(0, 40, 400)], "q_id": [f"q{x:03d}" for x in r.integers(0, 120, 400)], "logit": np.round(r.normal(0, 2, 400), 1)}).drop_duplicates(["s1_id", "q_id"]).reset_index(drop=True)
    rule = decode.Rule(temperature=1.3, bias=0.2, prior=0.4)
    got = {(x.s1_id, x.q_id) for x in decode.select_matches(spark.createDataFrame(rows), rule).collect()}
    s, q = (pd.factorize(rows[c], sort=True)[0] for c in ("s1_id", "q_id"))
    own, _, chosen = tune.Sample(s, q, rows["logit"], int(s.max()) + 1).chosen([decode.Rule(), rule])
    at = own[chosen[1]]
    assert got == set(zip(rows["s1_id"][at], rows["q_id"][at], strict=True)) and got


def test_tuning_improves():
    r = np.random.default_rng(0)
    rows = pd.DataFrame({"s1_id": [f"s{i // 3}" for i in range(90)], "q_id": [f"q{i}" for i in range(90)], "logit": [4 + r.normal() if i % 3 == 0 else 1 + r.normal() for i in range(90)]})
    truth = rows[rows.index % 3 == 0][["s1_id", "q_id"]]
    rule, best = tune.tune(rows, truth, rows[["s1_id"]].drop_duplicates())
    assert best > 0.9 and rule != decode.Rule(tau_min=0.45)


def test_quality_of_rules_is_the_metric(spark):
    r = np.random.default_rng(3)
    rows = pd.DataFrame({"s1_id": [f"s{x:02d}" for x in r.integers(0, 30, 200)], "q_id": [f"q{x:03d}" for x in r.integers(0, 90, 200)], "logit": np.round(r.normal(0, 2, 200), 1), "ce": r.normal(0, 1, 200)}).drop_duplicates(["s1_id", "q_id"]).reset_index(drop=True)
    truth = rows[rows["logit"] + r.normal(0, 1, len(rows)) > 1][["s1_id", "q_id"]]
    ids = [f"s{x:02d}" for x in range(20)]
    s, q = pd.Categorical(rows["s1_id"], [f"s{x:02d}" for x in range(30)]).codes, pd.factorize(rows["q_id"], sort=True)[0]
    true = set(map(tuple, truth.to_numpy()))
    right = [x in true for x in zip(rows["s1_id"], rows["q_id"], strict=True)]
    n_true = np.array([sum(a == i for a, _ in true) for i in ids])
    rules = [decode.Rule(temperature=0.9, prior=0.3), decode.Rule(bias=1.0, ce_weight=0.5)]
    got = tune.Sample(s, q, rows["logit"], 20, right, n_true, rows["ce"]).quality(rules)
    own = spark.createDataFrame([(x,) for x in ids], "s1_id string")
    for rule, value in zip(rules, got, strict=True):
        scored = rows.assign(logit=rows["logit"] + rule.ce_weight * rows["ce"])[["s1_id", "q_id", "logit"]]
        matches = decode.select_matches(spark.createDataFrame(scored), rule)
        assert metrics.macro_f05(own, matches, spark.createDataFrame(truth)).first().macro_f05 == pytest.approx(value, abs=1e-9)


def test_names_of_any_script(spark):
    rows = [("De\u0301pot Central", "depot central"), ("Vi\u1ec7t H\u01b0ng", "viet hung"), ("Bra\u0219ov", "brasov"), ("Łódź Øst Straße", "lodz ost strasse"), ("राम", "raama"), ("北京", "beijing"), ("Москва Ltd", "moskva"), ("서울", "seoul"), ("İzmir", "izmir"), (None, ""), ("", "")]
    df = spark.createDataFrame(rows, "name string, want string").select(n.norm_name(F.col("name")).alias("got"), "want")
    assert all(r.got == r.want for r in df.collect()), df.collect()


def test_scores_are_a_walk_of_the_trees(spark):
    from dataclasses import replace

    from tessera.plans import model

    r = np.random.default_rng(5)
    x = r.normal(0, 1, (400, 3))
    rows = pd.DataFrame(x, columns=["a", "b", "c"]).assign(q_id=[f"q{i}" for i in range(400)], y=(x[:, 0] + 0.5 * x[:, 1] + r.normal(0, 0.5, 400) > 0).astype(int))
    df = spark.createDataFrame(rows).cache()
    quick = replace(CURRENT, trees=4, depth=3)
    models = model.bag(df, ["a", "b", "c"], quick)
    trees = models[0].stages[-1]

    def walk(node, v):
        while node.numDescendants():
            split = node.split()
            node = node.leftChild() if v[split.featureIndex()] <= split.threshold() else node.rightChild()
        return node.prediction()

    weights = list(trees.treeWeights)
    scored = model.score(models, df, "p").orderBy("q_id").toPandas()
    for _, row in scored.head(60).iterrows():
        margin = sum(w * walk(t._java_obj.rootNode() if hasattr(t, "_java_obj") else t._call_java("rootNode"), [row.a, row.b, row.c]) for w, t in zip(weights, trees.trees, strict=True))
        assert row.p == pytest.approx(1 / (1 + np.exp(-2 * margin)), abs=1e-6) and row.p_logit == pytest.approx(2 * margin, abs=1e-4)
    folded = model.out_of_fold(df, ["a", "b", "c"], quick).toPandas()
    ranked = folded["p1"].rank()
    n1 = int(folded["y"].sum())
    auc = (ranked[folded["y"] == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(folded) - n1))
    assert len(folded) == 400 and auc > 0.85
    assert model.importances(models[0], ["a", "b", "c"])[0][0] == "a"


def test_command_line(spark, tmp_path, capsys):
    from tessera.plans import cli

    r = random.Random(7)
    words = ["blue", "lamp", "stone", "river", "oak", "elm", "north", "green", "iron", "glass", "wolf", "cedar"]
    for split in ("train", "test"):
        data, truth = {1: [], 2: [], 3: []}, []
        for i in range(60):
            name, addr, country = " ".join(r.sample(words, 3)), f"{r.randrange(10, 99)} {r.choice(words)} street {r.randrange(10000, 99999)}", r.choice(["US", "India"])
            data[1].append((f"S1-{i}", name, addr, country))
            own = []
            for source in (2, 3):
                if r.random() < 0.7:
                    data[source].append((f"S{source}-{i}", name.replace("e", "ee", 1) + r.choice(["", " ltd", " inc"]), addr.upper(), country))
                    own.append(f"S{source}-{i}")
            truth.append((f"S1-{i}", ",".join(own)))
        for k, rows in data.items():
            (tmp_path / f"{split}_source{k}.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\n" + "".join("\t".join(x) + "\n" for x in rows))
        (tmp_path / f"{split}_ground_truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\n" + "".join("\t".join(x) + "\n" for x in truth))
    flags = ["--data-dir", str(tmp_path), "--out-dir", f"{tmp_path}/out", "--model-dir", f"{tmp_path}/m", "--trees", "4", "--depth", "3", "--folds", "2", "--train-s1-frac", "1"]
    cli.main(["all", *flags])
    lines = (tmp_path / "out" / "matching_results.tsv").read_text().splitlines()
    assert lines[0] == "source1_entity_id\tmatched_entity_ids" and [x.split("\t")[0] for x in lines[1:]] == [f"S1-{i}" for i in range(60)]
    want = dict(truth)
    right = sum(want[k] == v for k, v in (x.split("\t") for x in lines[1:]))
    assert right > 45 and (tmp_path / "out" / "candidate_pairs.tsv").is_file()
    with pytest.raises(SystemExit) as end:
        cli.main(["validate", *flags])
    assert end.value.code == 0, capsys.readouterr().out
    (tmp_path / "out" / ".matching_results.tsv.crc").unlink()  # the checksum of the file as it was
    (tmp_path / "out" / "matching_results.tsv").write_text("\n".join([*lines[:-1], lines[1]]) + "\n")
    with pytest.raises(SystemExit) as end:
        cli.main(["validate", *flags])
    printed = capsys.readouterr().out
    assert end.value.code == 1 and "duplicate_row" in printed and "missing_entity" in printed


def test_windows(spark):
    df = spark.createDataFrame([("a", 1, 0.9), ("a", 2, 0.9), ("a", 3, 0.1), ("b", 4, 0.5)], "k string, i int, v double")
    out = {r.i: (r.r, r.n, round(r.m, 6), round(r.s, 6)) for r in df.withColumns({"r": windows.rank(["k"], "v", "i"), "n": windows.size(["k"]), "m": windows.margin(["k"], "v", "i"), "s": windows.share(["k"], "v")}).collect()}
    assert out == {1: (1, 3, 0.0, round(0.9 / 1.9, 6)), 2: (2, 3, 0.0, round(0.9 / 1.9, 6)), 3: (3, 3, -0.8, round(0.1 / 1.9, 6)), 4: (1, 1, 0.5, 1.0)}


def test_files(spark, tmp_path):
    (tmp_path / "t.tsv").write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t"a ""b"""\tNA\tUS\nS1-2\t\\x\t\tIndia\n')
    got = [tuple(r) for r in io.read_tsv(spark, f"{tmp_path}/t.tsv", io.RECORD).collect()]
    assert got == [("S1-1", 'a "b"', "NA", "US"), ("S1-2", "\\x", "", "India")]
    ids = spark.createDataFrame([("S1-3", 0), ("S1-1", 1)], "s1_id string, n int")
    pairs = spark.createDataFrame([("S1-1", "S3-1"), ("S1-1", "S2-9"), ("S1-1", "S3-1")], "s1_id string, q_id string")
    io.write_id_lists(ids.coalesce(1), pairs, "matched_entity_ids", f"{tmp_path}/out", order="n")
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text == "source1_entity_id\tmatched_entity_ids\nS1-3\t\nS1-1\tS2-9,S3-1\n"
    lines = io.read_lines(spark, f"{tmp_path}/out")
    assert validate.line_findings(lines, ("source1_entity_id", "matched_entity_ids")).count() == 0
    found = {r.code for r in validate.findings(validate.split_lists(lines.where("left <> 'source1_entity_id'")), spark.createDataFrame([("S1-1",), ("S1-5",)], "id string")).collect()}
    assert found == {"missing_entity", "extra_entity"}
    io.write_params(spark, {"tau": 0.5}, f"{tmp_path}/params")
    assert io.read_params(spark, f"{tmp_path}/params") == {"tau": 0.5}


def test_samples(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("g"))
    a = {r.id for r in sampling.exact_fraction(df, 0.1, 7, "id", "g").collect()}
    b = {r.id for r in sampling.exact_fraction(df.repartition(7), 0.1, 7, "id", "g").collect()}
    assert a == b and len(a) == 99
    assert sampling.weighted(df, 10, F.lit(1.0), 3, "id").count() == 10


def test_stream_equals_table(spark, tmp_path):
    rows = [("S1-1", "S1", "x", "blue lamp", "1 oak"), ("S2-1", "S2", "x", "Blue Lamp Ltd", "9 elm"), ("S3-1", "S3", "x", "stone", "1 oak"), ("S2-2", "S2", "y", "blue lamp", "1 oak")]
    df = spark.createDataFrame(rows, "id string, source string, country string, name string, addr string")
    s1 = matching.index(df)
    want = sorted(tuple(r) for r in matching.matches(df.where("source <> 'S1'"), s1).collect())
    df.where("source <> 'S1'").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = matching.matches(stream, s1).writeStream.format("memory").queryName("found").option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        q.processAllAvailable()
        assert sorted(tuple(r) for r in spark.table("found").collect()) == want and {w[1] for w in want} == {"S2-1"}
    finally:
        q.stop()


def test_config_flags():
    c = CURRENT.parse(["--knn-k", "7", "--safety-net", "false", "--keys", "k_skel"])
    assert (c.knn_k, c.safety_net, c.keys) == (7, False, ("k_skel",)) and not math.isnan(c.w_name)

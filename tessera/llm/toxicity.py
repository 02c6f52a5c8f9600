"""Toxicity by cumulative-link ordinal regression on sparse text features.

P(grade <= k) = logistic(threshold_k - w . x): one weight vector is shared by all the ordered thresholds, and the result
is the expected grade. Features are words (runs of letters, A-Z folded) and their first 5, 6 and 7 bytes, as 64-bit
hashes, the few thousand whose presence differs most between toxic and other documents. A feature that stands t times
among n words has x = log(1 + t * HALF / (HALF + n)), which tends to its rate in long texts, so that length alone
doesn't raise severity.

Labels only say toxic or not. The grades 1 to 3 of the labelled toxic documents are thirds of them in the order of their
out-of-fold margins: a two-grade model that hasn't seen a document says how clearly it is toxic. All others have grade
0. The model is fitted from at most TRAIN_DOCS labelled documents, counts of features by class being made by a grouped
aggregation; only chosen features' counts reach the driver. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Hasher, Members, chunks, held_out, labelled_sample, map_arrow, materialise, mix, utf8

TRAIN_DOCS, FEATURES, ROUNDS, GRADES = 6000, 3000, 250, 4
HALF, FOLDS = 60, 3
PREFIXES = (5, 6, 7)
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def features(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, whether it is a whole word) of every feature occurrence."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
    inside = _LETTER[raw]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    first = at[:-1][at[:-1] < at[1:]]
    begins[first], ends[first[1:] - 1] = inside[first], inside[first[1:] - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    doc = np.searchsorted(at, starts, "right") - 1
    hasher = Hasher(raw, lower=True)
    out, owner, whole = [hasher(starts, stops)], [doc], [np.ones(len(starts), bool)]
    for size in PREFIXES:
        longer = np.flatnonzero(stops - starts > size)
        out.append(mix(hasher(starts[longer], starts[longer] + size) ^ np.uint64(size)))
        owner.append(doc[longer])
        whole.append(np.zeros(len(longer), bool))
    return np.concatenate(out), np.concatenate(owner), np.concatenate(whole)


@dataclass
class Ordinal:
    """Chosen feature hashes (sorted), their weights, and the ordered thresholds."""

    wanted: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def grades(self, raw: np.ndarray, at: np.ndarray, members: Members) -> np.ndarray:
        """Probability of each grade for each document."""
        n, width = len(at) - 1, max(1, len(self.wanted))
        hashes, doc, whole = features(raw, at)
        hit, which = members.hits(hashes)
        key, times = np.unique(doc[hit] * width + which, return_counts=True) if len(hit) else (np.zeros(0, np.int64), np.zeros(0))
        words = np.bincount(doc[whole], minlength=n)
        own = np.bincount(key // width, value(times, words[key // width]) * self.weights[key % width], n) if len(key) else np.zeros(n)
        return probabilities(self.thresholds, own)


def value(times: np.ndarray, words: np.ndarray) -> np.ndarray:
    """x of features that stand so many times among so many words."""
    return np.log1p(times * HALF / (HALF + words))


def probabilities(thresholds: np.ndarray, own: np.ndarray) -> np.ndarray:
    below = 1 / (1 + np.exp(-np.clip(thresholds[None, :] - own[:, None], -35, 35)))
    return np.diff(np.concatenate([np.zeros((len(own), 1)), below, np.ones((len(own), 1))], axis=1), axis=1)


def fit_ordinal(row: np.ndarray, column: np.ndarray, value: np.ndarray, grade: np.ndarray, width: int, rounds: int = ROUNDS, levels: int = GRADES) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of the cumulative-link model by gradient steps (Adam) on the penalised likelihood;
    thresholds stay ordered as their gaps are exponentials. The same at every run."""
    n = len(grade)
    share = np.array([(grade <= k).mean() for k in range(levels - 1)]).clip(1e-4, 1 - 1e-4)
    logit = np.log(share / (1 - share))
    weights, low, gaps = np.zeros(width), logit[:1].copy(), np.log(np.maximum(np.diff(logit), 0.05))
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (weights, low, gaps)]
    for step in range(1, rounds + 1):
        theta = np.concatenate([low, low + np.cumsum(np.exp(gaps))])
        own = np.bincount(row, value * weights[column], n) if len(row) else np.zeros(n)
        below = np.concatenate([np.zeros((n, 1)), 1 / (1 + np.exp(-np.clip(theta[None, :] - own[:, None], -35, 35))), np.ones((n, 1))], axis=1)
        slope = below * (1 - below)
        i = np.arange(n)
        chance = np.maximum(below[i, grade + 1] - below[i, grade], 1e-12)
        upper, lower = slope[i, grade + 1] / chance, slope[i, grade] / chance
        by_theta = np.zeros(levels + 1)
        np.add.at(by_theta, grade + 1, upper)
        np.add.at(by_theta, grade, -lower)
        by_theta = by_theta[1:levels] / n
        by_own = (lower - upper) / n
        tail = np.cumsum(by_theta[::-1])[::-1]
        grads = [np.bincount(column, value * by_own[row], width) - 3e-5 * weights if len(row) else -3e-5 * weights, np.array([tail[0]]), tail[1:] * np.exp(gaps)]
        for param, g, m in zip((weights, low, gaps), grads, moments, strict=True):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            param += 0.1 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-7)
    return weights, np.concatenate([low, low + np.cumsum(np.exp(gaps))])


def out_of_fold_margins(row: np.ndarray, column: np.ndarray, x: np.ndarray, label: np.ndarray, width: int, fold: np.ndarray) -> np.ndarray:
    """w . x less the threshold of each document, by the two-grade model of the other folds."""
    out = np.zeros(len(label))
    for k in range(FOLDS):
        rest = fold != k
        place = np.cumsum(rest) - 1
        seen = rest[row]
        weights, threshold = fit_ordinal(place[row[seen]], column[seen], x[seen], label[rest], width, levels=2)
        own = np.bincount(row, x * weights[column], len(label)) if len(row) else np.zeros(len(label))
        out[~rest] = (own - threshold[0])[~rest]
    return out


def bands(label: np.ndarray, margin: np.ndarray) -> np.ndarray:
    """Grade 0 for label 0, and thirds 1 to 3 of the others by margin (ties by place)."""
    grade = np.zeros(len(label), np.int64)
    bad = np.flatnonzero(label == 1)
    order = bad[np.argsort(margin[bad], kind="stable")]
    grade[order] = 1 + np.arange(len(order)) * (GRADES - 1) // max(1, len(order))
    return grade


def _present(batches):
    """(doc_id, label, hash, times, words) of each distinct feature of each document."""
    import pyarrow as pa

    for batch in batches:
        raw, at = utf8(batch.column(1))
        for lo, hi, part, offsets in chunks(raw, at):
            hashes, doc, whole = features(part, offsets)
            words = np.bincount(doc[whole], minlength=hi - lo)
            order = np.lexsort((hashes, doc))
            hashes, doc = hashes[order], doc[order]
            if not len(hashes):
                continue
            first = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])]))
            times = np.diff(np.concatenate([first, [len(hashes)]]))
            at_ = pa.array(doc[first])
            ids, labels = (batch.column(i).slice(lo, hi - lo).take(at_) for i in (0, 2))
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array(hashes[first].view(np.int64)), pa.array(times), pa.array(words[doc[first]])], ["doc_id", "label", "hash", "times", "words"])


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS, width: int = FEATURES) -> Ordinal:
    """The model learned from at most `most` labelled documents that aren't held out. Without toxic labels nothing
    is found toxic; features of equal strength go by their hash."""
    nothing = Ordinal(np.zeros(0, np.uint64), np.zeros(0), np.array([30.0, 31.0, 32.0]))
    sample = materialise(labelled_sample(labels, "toxic", most), "toxic-sample")
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "label")
    present = materialise(map_arrow(rows, _present, "doc_id long, label int, hash long, times long, words long"), "toxic-features")
    ids = sorted((r["doc_id"], r["label"]) for r in sample.collect())
    label = np.array([x for _, x in ids], np.int64)
    bad, good = int((label == 1).sum()), int((label == 0).sum())
    if not bad or not good:
        return nothing
    counts = present.groupBy("hash").agg(F.count_if(F.col("label") == 1).alias("bad"), F.count_if(F.col("label") == 0).alias("good"))
    p, q = F.col("bad") / bad, F.col("good") / good
    both = (F.col("bad") + F.col("good")) / (bad + good)
    z = F.abs(p - q) / F.sqrt(both * (1 - both) * (1 / bad + 1 / good) + 1e-12)
    chosen = counts.where("bad + good >= 3").withColumn("z", z).where("z > 2.5").orderBy(F.desc("z"), "hash").limit(width).select("hash").toPandas()
    if not len(chosen):
        return nothing
    wanted = np.sort(chosen["hash"].to_numpy(np.int64).view(np.uint64))
    keep = F.broadcast(docs.sparkSession.createDataFrame(chosen))
    found = present.join(keep, "hash", "left_semi").select("doc_id", "hash", "times", "words").toPandas().sort_values(["doc_id", "hash", "times"])
    place = {d: i for i, (d, _) in enumerate(ids)}
    row = found["doc_id"].map(place).to_numpy(np.int64)
    column = np.searchsorted(wanted, found["hash"].to_numpy(np.int64).view(np.uint64))
    x = value(found["times"].to_numpy(float), found["words"].to_numpy(float))
    fold = np.array([zlib.crc32(f"fold {d}".encode()) % FOLDS for d, _ in ids])
    grade = bands(label, out_of_fold_margins(row, column, x, label, len(wanted), fold))
    return Ordinal(wanted, *fit_ordinal(row, column, x, grade, len(wanted)))


def _score(model: Ordinal):
    def run(batches):
        import pyarrow as pa

        members = Members(model.wanted)
        for batch in batches:
            raw, at = utf8(batch.column(1))
            p = np.concatenate([np.zeros((0, GRADES)), *(model.grades(part, offsets, members) for _, _, part, offsets in chunks(raw, at))])
            grade = np.where(p[:, 0] > 0.5, 0, 1 + p[:, 1:].argmax(axis=1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p @ np.arange(GRADES)), pa.array(1 - p[:, 0]), pa.array(grade)], ["doc_id", "severity", "score", "grade"])

    return run


def score_documents(docs: DataFrame, model: Ordinal) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, held_out, severity (expected grade, 0 to 3), score (probability
    of any grade above 0), predicted (1 if score >= 0.5, toxic), grade (0 if not, else the likeliest above 0, the smaller of
    equals). Null and empty texts have no features and get the prior; texts are read whole, however long; repeated rows
    score alike; other columns of docs, whatever their names, are left out; an empty table gives an empty result."""
    scored = map_arrow(docs.select("doc_id", "text"), _score(model), "doc_id long, severity double, score double, grade int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "severity", "score", "grade", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_documents(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))

"""Quality of documents by a linear-chain conditional random field over their lines.

Each line has a few statistics (shares of capitals, symbols, digits, repeated words, length ...), cut into bins. A
line's potential for good or bad sums the weights of its own bins and of those of the lines before and after; the
chain adds weights for pairs of neighbouring labels. Forward-backward gives each line's probability of being good, and
a document's score is their mean, weighted by length. The label of a document is the label of all its lines for learning.

The model is fitted on the driver from at most TRAIN_DOCS labelled documents of at most TRAIN_LINES lines, which come as
bins of a byte each; it has a few hundred weights and goes to every task. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Hasher, chunks, held_out, labelled_sample, map_arrow, utf8, word_spans

TRAIN_DOCS, TRAIN_LINES, ROUNDS, THRESHOLD = 3000, 4096, 300, 0.3
EDGES = np.array([0.001, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7])
LENGTHS = np.array([1, 16, 48, 128, 384, 1024, 4096])
WORD_BYTES = np.array([1, 2.5, 3.5, 5, 7, 10, 16])
BINS, FEATURES = 9, 12  # bin 8: there is no such line


def _lut(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_UPPER, _DIGIT = _lut("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _lut("0123456789")
_LOWER = _lut("abcdefghijklmnopqrstuvwxyz")
_LOWER[128:] = True
_WIDE = np.arange(256) >= 128
_SYMBOL, _BANG, _BAR, _STOP = _lut("%&*#$@~^_=+<>{}[]\\/`"), _lut("!"), _lut("|"), _lut(".,;:?")


def line_bins(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bins of each line, its length in bytes, n + 1 offsets of the documents' lines). A document has a line at least."""
    breaks = np.flatnonzero(raw == 10)
    starts = np.sort(np.concatenate([at[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([breaks, at[1:]]), kind="stable")
    # A document that ends in a line break has an empty last line, which starts where the next document does.
    upto = np.concatenate([[0], np.cumsum(1 + np.diff(np.searchsorted(breaks, at)))])
    size = ends - starts

    def count(table):
        total = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(table[raw], out=total[1:])
        return total[ends] - total[starts]

    ws, we, _ = word_spans(raw, at)
    first, last = np.searchsorted(ws, starts), np.searchsorted(ws, ends)
    words = last - first
    hashes = Hasher(raw, lower=True)(ws, we) if len(ws) else np.zeros(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes)])
    again = np.zeros(len(ws) + 1, np.int64)
    if len(ws):
        same = np.concatenate([[False], hashes[1:] == hashes[:-1]])
        same[first[words > 0]] = False
        np.cumsum(same, out=again[1:])
    line = sums[last] - sums[first]
    doc = np.repeat(np.arange(len(at) - 1), np.diff(upto))
    order = np.lexsort((line, doc))
    twin = np.zeros(len(line), bool)
    if len(line) > 1:
        equal = (line[order][1:] == line[order][:-1]) & (doc[order][1:] == doc[order][:-1]) & (words[order][1:] > 0)
        twin[order[1:][equal]] = True
        twin[order[:-1][equal]] = True
    upper, lower = count(_UPPER), count(_LOWER)
    per_word, per_byte = np.maximum(words, 1), np.maximum(size, 1)
    values = [upper / np.maximum(upper + lower, 1), count(_SYMBOL) / per_byte, count(_BANG) / per_word, count(_BAR) / per_word, count(_DIGIT) / per_byte, (again[last] - again[first]) / np.maximum(words - 1, 1), count(_STOP) / per_word, count(_WIDE) / per_byte]
    bins = [np.searchsorted(EDGES, v, "right") for v in values]
    bins += [np.searchsorted(LENGTHS, size, "right"), np.searchsorted(WORD_BYTES, size / per_word, "right"), twin.astype(np.int64) + 2 * (words == 0), np.searchsorted(EDGES, (upper + count(_SYMBOL) + count(_BANG) + count(_BAR)) / per_byte, "right")]
    return np.stack(bins, axis=1).astype(np.uint8), size, upto


class Chain:
    """The field's weights: unary[place, feature, bin] for a line, the one before and the one after; pair[2, 2]."""

    def __init__(self):
        self.unary = np.zeros((3, FEATURES, BINS))
        self.pair = np.zeros((2, 2))
        self.bias = np.zeros(1)

    @staticmethod
    def around(bins: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """Bins of each line, of the one before and of the one after in its document."""
        out = np.full((3, *bins.shape), BINS - 1, np.uint8)
        if len(bins):
            out[0] = bins
            out[1, 1:], out[2, :-1] = bins[:-1], bins[1:]
            out[1, upto[:-1]] = BINS - 1
            out[2, upto[1:] - 1] = BINS - 1
        return out

    def potentials(self, near: np.ndarray) -> np.ndarray:
        total = np.full(near.shape[1], self.bias[0])
        for place in range(3):
            for f in range(FEATURES):
                total += self.unary[place, f][near[place, :, f]]
        return total

    def marginals(self, scores: np.ndarray, upto: np.ndarray, pairs: bool = False):
        """Probability of good for each line, by forward-backward over all documents side by side; with pairs, also the
        expected number of each pair of neighbouring labels."""
        turn = np.exp(self.pair - self.pair.max())
        good = 1 / (1 + np.exp(-np.clip(scores, -30, 30)))
        emit = np.stack([1 - good, good], axis=1) + 1e-13
        lens = np.diff(upto)
        order = np.argsort(-lens, kind="stable")
        begin, most = upto[:-1][order], int(lens.max(initial=0))
        active = np.searchsorted(-lens[order], -np.arange(most), "left")
        forward, backward = np.empty_like(emit), np.ones_like(emit)
        for t in range(most):
            i = begin[: active[t]] + t
            f = emit[i] if not t else (forward[i - 1] @ turn) * emit[i]
            forward[i] = f / f.sum(axis=1, keepdims=True)
        expected = np.zeros((2, 2))
        for t in range(most - 2, -1, -1):
            i = begin[: active[t + 1]] + t
            later = emit[i + 1] * backward[i + 1]
            if pairs:
                joint = forward[i][:, :, None] * turn * later[:, None, :]
                expected += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            b = later @ turn.T
            backward[i] = b / b.sum(axis=1, keepdims=True)
        both = forward * backward
        return both[:, 1] / both.sum(axis=1), expected

    def fit(self, bins: np.ndarray, upto: np.ndarray, label: np.ndarray, rounds: int = ROUNDS) -> None:
        """Gradient steps (Adam) on the penalised conditional likelihood of the label sequences; the same at every run.
        A document's lines count less the more of them it has, so that long texts don't drown the others."""
        near = self.around(bins, upto)
        lens = np.diff(upto)
        y = np.repeat(label, lens).astype(float)
        weight = np.repeat(1 / np.sqrt(np.maximum(lens, 1)), lens)
        weight /= weight.sum()
        first = np.array([[(lens - 1)[label == 0].sum(), 0], [0, (lens - 1)[label == 1].sum()]]) / max(1, len(y))
        index = near.astype(np.int64) + (np.arange(FEATURES) * BINS)[None, None, :]
        moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (self.unary, self.pair, self.bias)]
        for step in range(1, rounds + 1):
            p, expected = self.marginals(self.potentials(near), upto, pairs=True)
            left = (y - p) * weight
            gradient = np.stack([np.bincount(index[k].ravel(), np.repeat(left, FEATURES), FEATURES * BINS).reshape(FEATURES, BINS) for k in range(3)])
            grads = [gradient - 5e-6 * self.unary, first - expected / max(1, len(y)) - 1e-3 * self.pair, np.array([left.sum()])]
            for param, g, m in zip((self.unary, self.pair, self.bias), grads, moments, strict=True):
                m[0] = 0.9 * m[0] + 0.1 * g
                m[1] = 0.99 * m[1] + 0.01 * g * g
                param += 0.15 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-6)

    def scores(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Mean probability of good over each document's lines, weighted by length (a line break counts as a byte)."""
        bins, size, upto = line_bins(raw, at)
        good, _ = self.marginals(self.potentials(self.around(bins, upto)), upto)
        weight = (size + 1).astype(float)
        return np.add.reduceat(good * weight, upto[:-1]) / np.add.reduceat(weight, upto[:-1]) if len(at) > 1 else np.zeros(0)


def _bins(batches):
    import pyarrow as pa

    for batch in batches:
        raw, at = utf8(batch.column(1))
        for lo, hi, part, offsets in chunks(raw, at):
            bins, _, upto = line_bins(part, offsets)
            rows = [bins[a:b].tobytes() if b - a <= TRAIN_LINES else None for a, b in zip(upto[:-1], upto[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(rows, pa.binary())], ["doc_id", "label", "bins"])


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Chain:
    """The field learned from at most `most` labelled documents that aren't held out; those of more than TRAIN_LINES lines
    don't teach. A label that is repeated counts once, the larger of several. Without labels every line is as likely good
    as bad."""
    sample = labelled_sample(labels, "quality", most)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "label")
    found = sorted(map_arrow(rows, _bins, "doc_id long, label int, bins binary").where("bins is not null").toArrow().to_pylist(), key=lambda r: (r["doc_id"], r["bins"]))
    chain = Chain()
    if found:
        upto = np.concatenate([[0], np.cumsum([len(r["bins"]) // FEATURES for r in found])])
        chain.fit(np.frombuffer(b"".join(r["bins"] for r in found), np.uint8).reshape(-1, FEATURES), upto, np.array([r["label"] for r in found]))
    return chain


def _score(chain: Chain):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            raw, at = utf8(batch.column(1))
            scores = [chain.scores(part, offsets) for _, _, part, offsets in chunks(raw, at)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([np.zeros(0), *scores]))], ["doc_id", "score"])

    return run


def score_documents(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, held_out, score (0 to 1, higher for better), predicted (1 from
    the threshold on). Null and empty texts are one empty line and get its score; texts are read whole, however many their
    lines; repeated rows score alike; other columns of docs, whatever their names, are left out; an empty table gives an
    empty result."""
    scored = map_arrow(docs.select("doc_id", "text"), _score(chain), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _passes(chain: Chain, threshold: float, text_at: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            raw, at = utf8(batch.column(text_at))
            scores = [chain.scores(part, offsets) for _, _, part, offsets in chunks(raw, at)]
            yield batch.filter(pa.array(np.concatenate([np.zeros(0), *scores]) >= threshold))

    return run


def keep_good(docs: DataFrame, chain: Chain, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the classifier doesn't reject, with all their columns."""
    return map_arrow(docs, _passes(chain, threshold, docs.columns.index("text")), docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_documents(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))

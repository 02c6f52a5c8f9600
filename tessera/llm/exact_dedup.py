"""Exact dedup by composable polynomial fingerprints.

H(s) = sum of s[i] * r^(n-1-i) modulo each of two primes. Fingerprints of chunks are taken side by side and
combine by length-shifted arithmetic, H(a + b) = H(a) * r^len(b) + H(b), so that a huge text costs no more
memory than its chunks. Texts of equal (fingerprints, length) are then compared byte by byte: each group's
texts are dealt as chunks, and each chunk is compared with the leader's in a stream. Copies that differ from
their leader (a collision) form a new class and go through the same comparison again.

Nulls count as the empty text; rows without a doc_id are classed by their fingerprints alone. Repeated rows are copies like any other. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import chunks, fitting, map_arrow, materialise, semi_by_id, text_batches, utf8

PRIMES = (2147483647, 2147483629)
BASES = (1000003, 1618033)
CHUNK = 4096
#: Bytes of text that one compared row holds, and about how many rows of one chunk meet in one task.
COMPARE_BYTES, CELL = 1 << 16, 64
KEY = ["fp1", "fp2", "n_bytes", "sub"]


def combine(a: tuple[int, int], b: tuple[int, int], base: int, prime: int) -> tuple[int, int]:
    """(fingerprint, length) of a text from those of its two parts; associative."""
    return (a[0] * pow(base, b[1], prime) + b[0]) % prime, a[1] + b[1]


def fingerprints(raw: np.ndarray, at: np.ndarray, prime: int, base: int, chunk: int = CHUNK) -> np.ndarray:
    """Fingerprints of the documents raw[at[i]:at[i+1]]: chunks first, then their combination, all in arrays.
    A product is below 2^39 and a chunk of 4096 of them below 2^51."""
    n = len(at) - 1
    lens = np.diff(at)
    pieces = np.maximum(1, -(-lens // chunk))
    owner = np.repeat(np.arange(n), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    lo = at[:-1][owner] + nth * chunk
    hi = np.minimum(lo + chunk, at[1:][owner])
    power = np.ones(chunk, np.uint64)
    for i in range(1, chunk):
        power[i] = int(power[i - 1]) * base % prime
    sums = np.zeros(len(owner), np.uint64)
    full = np.flatnonzero(hi > lo)
    if len(full):
        back = np.repeat(hi[full], (hi - lo)[full]) - 1 - np.arange(int(lo[full[0]]), int(hi[full[-1]]))
        sums[full] = np.add.reduceat(raw.astype(np.uint64) * power[back], lo[full] - lo[full[0]])
    sums %= np.uint64(prime)
    # Documents of one piece are done; the others fold their pieces, one step of all documents at a time.
    out = sums[np.cumsum(pieces) - pieces]
    first = np.cumsum(pieces) - pieces
    step = pow(base, chunk, prime)
    for k in range(1, int(pieces.max(initial=1))):
        more = np.flatnonzero(pieces > k)
        size = (hi - lo)[first[more] + k]
        shift = np.where(size == chunk, np.uint64(step), power[np.minimum(size, chunk - 1)])
        out[more] = (out[more] * shift + sums[first[more] + k]) % np.uint64(prime)
    return out.astype(np.int64)


def _signatures(primes):
    def run(batches):
        import hashlib

        import pyarrow as pa

        for ids, raw, at in text_batches(batches, "doc_id", "text"):
            data = raw.tobytes()
            sha = [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            fp = [fingerprints(raw, at, p, b) for p, b in zip(primes, BASES, strict=True)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(fp[0]), pa.array(fp[1]), pa.array(np.diff(at)), pa.array(sha)], ["doc_id", "fp1", "fp2", "n_bytes", "text_sha256"])

    return run


def _pieces(primes):
    """Each text cut into compared chunks, where its fingerprints are those of the joined row (ids may repeat).
    An empty text gives none: its length says all."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            raw, at = utf8(batch.column(1))
            fp = [np.concatenate([np.zeros(0, np.int64), *(fingerprints(part, o, p, b) for _, _, part, o in chunks(raw, at))]) for p, b in zip(primes, BASES, strict=True)]
            lens = np.diff(at)
            wanted = [np.asarray(batch.column(i)) for i in (2, 3, 4)]
            pieces = np.where((fp[0] == wanted[0]) & (fp[1] == wanted[1]) & (lens == wanted[2]), -(-lens // COMPARE_BYTES), 0)
            owner = np.repeat(np.arange(len(lens)), pieces)
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            lo = at[:-1][owner] + nth * COMPARE_BYTES
            hi = np.minimum(lo + COMPARE_BYTES, at[1:][owner])
            for i in range(0, len(owner), 64):
                parts = pa.array([raw[a:b].tobytes() for a, b in zip(lo[i : i + 64].tolist(), hi[i : i + 64].tolist(), strict=True)], pa.binary())
                rows = batch.take(pa.array(owner[i : i + 64]))
                yield pa.RecordBatch.from_arrays([*(rows.column(k) for k in (0, 2, 3, 4, 5, 6, 7)), pa.array(nth[i : i + 64]), parts], ["doc_id", "fp1", "fp2", "n_bytes", "sub", "lead", "group_size", "chunk_no", "chunk"])

    return run


def _differing(batches):
    """Rows come sorted by cell, the leader's chunk first; gives the documents whose chunk differs from it."""
    import pyarrow as pa

    cell = lead = None
    for batch in batches:
        raw, at = utf8(batch.column(6))
        keys = list(zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True))
        ids, data, at = batch.column(7), raw.tobytes(), at.tolist()
        out = []
        for i, key in enumerate(keys):
            part = data[at[i] : at[i + 1]]
            if key != cell:
                cell, lead = key, part
            elif part != lead:
                out.append(i)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(out, pa.int64()))], ["doc_id"])


def exact_classes(docs: DataFrame, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, keep_id (largest doc_id of the equal texts), group_size,
    kept (one row of each class, also among repeated rows), text_sha256. Small primes only serve to test collisions."""
    docs = docs.select("doc_id", "text")
    long = "doc_id long, fp1 long, fp2 long, n_bytes long"
    sig = materialise(map_arrow(docs, _signatures(primes), f"{long}, text_sha256 string").withColumn("sub", F.lit(0)).withColumn("uid", F.monotonically_increasing_id()), "fingerprints")
    done = 0
    while True:
        groups = materialise(sig.groupBy(KEY).agg(F.max(F.struct("doc_id", "uid")).alias("lead"), F.count("*").alias("group_size")), "groups")
        twins = groups.where((F.col("group_size") > 1) & (F.col("sub") == done) & (F.col("n_bytes") > 0))
        members = materialise(sig.join(twins, KEY).select("doc_id", *KEY, F.col("lead.doc_id").alias("lead"), "group_size").where("doc_id is not null"), "members")
        if members.isEmpty():
            break
        texts = docs.join(fitting(members.distinct()), "doc_id").select("doc_id", "text", *KEY, "lead", "group_size")
        salts = F.ceil(F.col("group_size") / CELL).cast("int")
        own = F.array(F.pmod(F.xxhash64("doc_id"), salts).cast("int"))
        cells = (
            map_arrow(texts, _pieces(primes), "doc_id long, fp1 long, fp2 long, n_bytes long, sub int, lead long, group_size long, chunk_no long, chunk binary")
            .withColumn("salt", F.explode(F.when(F.col("doc_id") == F.col("lead"), F.sequence(F.lit(0), salts - 1)).otherwise(own)))
            .select(*KEY, "salt", "chunk_no", "chunk", "doc_id")
        )
        cells = cells.repartition(*KEY, "salt", "chunk_no").sortWithinPartitions(*KEY, "salt", "chunk_no", F.desc("doc_id"))
        differing = materialise(map_arrow(cells, _differing, "doc_id long").distinct(), "differing")
        if differing.isEmpty():
            break
        done += 1
        other = differing.withColumn("__other", F.lit(done))
        sig = materialise(sig.join(other, "doc_id", "left").withColumn("sub", F.coalesce("__other", "sub")).drop("__other"), "classes")
    result = sig.join(groups, KEY)
    return result.select("doc_id", F.col("lead.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("lead.uid")).alias("kept"), "text_sha256")


def query(spark, sf_dir: str) -> DataFrame:
    return exact_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, coalesce(text, '') AS body FROM documents),
g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (body)"""


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs without the rows that repeat another row's text; all columns stay. Of rows that repeat both id and
    text one stays; rows without a doc_id can't be named by a result and stay."""
    classes = materialise(exact_classes(docs), "exact-classes")
    ids = classes.where("kept and doc_id is not null").select("doc_id").distinct()
    kept = semi_by_id(docs, "doc_id", materialise(ids, "kept"))
    if not classes.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.where("doc_id is null"))

"""Shared pieces: scratch tables, size-checked joins and vectorised views of Arrow text columns."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one long that a join may broadcast (8 MB of ids); above it the join is shuffled.
BROADCAST_IDS = 1_000_000
#: Bytes of an Arrow batch: what a Python worker holds at once doesn't depend on the length of texts.
BATCH_BYTES = 4 << 20
#: Bytes of text that one vectorised step looks at, unless a single document is longer.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder below the shared one of the session (spark.checkpoint.dir). Where none is set, as in
    tests, a local master gets a local one; on a cluster that would lose rows with an executor, so that it is an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/tessera-{spark.sparkContext.applicationId}"


def drop_scratch(spark: SparkSession) -> None:
    """Deletes what this application has written to the shared folder; results that still read from it are void."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: the rows are written to the shared folder once and read from there,
    so that a lost executor costs no recomputation and plans below stay small."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """mapInArrow with batches of at most about BATCH_BYTES (or less, where the session says so)."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(-?\d+)b?", conf.get(name).strip().lower())
    if not now or not 0 < int(now[1]) <= BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df.mapInArrow(function, schema)


def semi_by_id(df: DataFrame, key: str, ids: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """Rows of df whose key is in the one column of ids, a set of distinct materialised longs.
    Up to `limit` ids are broadcast, so that wide rows aren't shuffled; more are joined by a shuffle."""
    name = ids.columns[0]
    wanted = ids.select(F.col(name).alias("__wanted"))
    small = wanted.limit(limit + 1).count() <= limit
    return df.join(F.broadcast(wanted) if small else wanted.hint("shuffle_merge"), df[key] == F.col("__wanted"), "left_semi")


def fitting(df: DataFrame, limit: int = 200_000) -> DataFrame:
    """df (materialised, narrow) with a broadcast hint if it has at most `limit` rows, else for a shuffled join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df.hint("shuffle_merge")


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and the n + 1 offsets of an Arrow string column; null counts as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(raw: np.ndarray, at: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs (lo, hi, bytes, offsets) of whole documents of about `limit` bytes together."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C17 | 3  # 3 modulo 4, so that powers differ in their low bits
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _POWERS[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+` and, for each document, the number of words
    before it (n + 1 entries)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = ~_SPACE[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = at[:-1][at[:-1] < at[1:]]
    begins[first] = inside[first]
    ends = inside
    ends = ends.copy()
    ends[:-1] &= ~inside[1:]
    ends[first[1:] - 1] = inside[first[1:] - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, at)


class Hasher:
    """64-bit hashes of byte slices, equal for equal slices (lower: after A-Z become a-z): differences of a running
    polynomial sum, moved to exponent 0, so that a slice costs the same whatever its length."""

    def __init__(self, raw: np.ndarray, lower: bool = False):
        up, self.down = _powers(len(raw) + 1)
        self.total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((_LOWER if lower else _BYTE)[raw] * up[: len(raw)], out=self.total[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        sums = (self.total[ends] - self.total[starts]) * self.down[starts]
        return mix(sums + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def slice_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    return Hasher(raw, lower)(starts, ends) if len(starts) else np.zeros(0, np.uint64)


class Members:
    """Positions of hashes in a sorted array of wanted ones, -1 for others; a bitmap passes the rest quickly."""

    def __init__(self, wanted: np.ndarray):
        self.wanted = wanted
        self.bits = np.zeros(1 << 18, bool)
        self.bits[(wanted >> np.uint64(46)).astype(np.int64)] = True

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of each hash that is wanted, its position in the array)."""
        maybe = np.flatnonzero(self.bits[(hashes >> np.uint64(46)).astype(np.int64)])
        if not len(maybe):
            return maybe, maybe
        at = np.minimum(np.searchsorted(self.wanted, hashes[maybe]), len(self.wanted) - 1)
        same = self.wanted[at] == hashes[maybe]
        return maybe[same], at[same]


def held_out(doc_id):
    """Whether crc32 of doc_id as text is divisible by 5: such rows never teach a model."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled_sample(labels: DataFrame, label: str, most: int) -> DataFrame:
    """doc_id and label of at most `most` labelled rows that aren't held out, the same at every run; of repeated ids
    the larger label counts."""
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def text_batches(batches, ids: str, text: str):
    """(ids as Arrow array, bytes, offsets) over the batches of mapInArrow, in bounded steps."""
    for batch in batches:
        raw, at = utf8(batch.column(batch.schema.get_field_index(text)))
        keys = batch.column(batch.schema.get_field_index(ids))
        for lo, hi, part, offsets in chunks(raw, at):
            yield keys.slice(lo, hi - lo), part, offsets

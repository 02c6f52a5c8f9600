"""Exact top-k search by a three-phase uniform threshold.

Components become the integers floor(256 * x) and the dimensions are cut into m slices; each (block of rows, slice)
has its own list of partial scores. Phase 1: the first slice's list of every block gives its best entries, whose scores
are completed; the k-th best of a query is a safe lower bound t of its k-th best of all. Phase 2: t is broadcast, and the
blocks work slice by slice: a row stays as long as its finished part, plus the most that the slices left can add (the
product of both vectors' norms there), reaches t; a row below t / m in every list can't, and none is kept. Phase 3: only
the rows that stay are completed exactly, and they are ranked. A task's own completed scores raise t as it goes.

Queries go in blocks of at most QUERY_BYTES, whose vectors and bounds are all that is broadcast; each block meets
every row of the table. Rows are never paired in a join, and what is shuffled is at most k entries a query and task.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow, materialise

K, EVERY, SLICES, ROWS = 5, 50, 8, 2048
#: Bytes of the query vectors that are broadcast at once, and entries of a list of phase 1.
QUERY_BYTES, ENTRIES = 32 << 20, 16


def _vectors(batch):
    """(ids, list of rows of equal length by length) of the vectors that take part."""
    import pyarrow as pa

    column, ids = batch.column(1), np.asarray(batch.column(0))
    if pa.types.is_large_list(column.type) or pa.types.is_fixed_size_list(column.type):
        column = column.cast(pa.list_(column.type.value_type))
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.cast(pa.float64())
    flat = np.where(np.asarray(values.is_valid()), np.asarray(values.fill_null(0)), np.nan) if len(values) else np.zeros(0)
    whole = np.floor(256 * flat)
    lens = np.diff(offsets)
    valid = np.asarray(column.is_valid())
    out = {}
    for d in np.unique(lens[valid]).tolist():
        at = np.flatnonzero(valid & (lens == d))
        rows = whole[offsets[at][:, None] + np.arange(d)] if d else np.zeros((len(at), 0))
        fine = np.isfinite(rows).all(axis=1)
        out[d] = (ids[at[fine]], rows[fine])
    return out


class Tile:
    """Partial scores of some queries with a block of rows, slice by slice. Sums are exact integers: doubles while all stay
    below 2^53, else Python's own integers."""

    def __init__(self, queries: np.ndarray, rows: np.ndarray, slices: int):
        most = np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * max(1, rows.shape[1])
        kind = float if most < 2**53 else object
        self.q, self.x = (a if kind is float else np.array([[int(v) for v in r] for r in a], object).reshape(a.shape) for a in (queries, rows))
        edges = np.linspace(0, rows.shape[1], slices + 1).astype(int).tolist()
        self.parts = list(zip(edges[:-1], edges[1:], strict=True))
        # Norms of what is left after each slice, a little too long rather than too short.
        self.left = [tuple(np.sqrt((a[:, b:] ** 2).sum(axis=1)) * (1 + 1e-9) for a in (queries, rows)) for _, b in self.parts]

    def part(self, nth: int) -> np.ndarray:
        a, b = self.parts[nth]
        return self.q[:, a:b] @ self.x[:, a:b].T

    def rest(self, nth: int) -> np.ndarray:
        """The most that the slices after this one can add."""
        return self.left[nth][0][:, None] * self.left[nth][1][None, :]

    def complete(self, q: np.ndarray, x: np.ndarray, nth: int) -> np.ndarray:
        """What the slices after this one add to single pairs."""
        a = self.parts[nth][1]
        out = np.zeros(len(q), self.q.dtype)
        for lo in range(0, len(q), 4096):
            at = slice(lo, lo + 4096)
            out[at] = (self.q[q[at], a:] * self.x[x[at], a:]).sum(axis=1)
        return out


#: Pairs that stay are completed one by one once they are this part of a tile; before, slices are done for all.
SPARSE = 0.1


def listed(tile: Tile, free: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phase 1: (query, row, score) of the best entries of the first slice's list."""
    first = tile.part(0)
    low = np.where(free, first.astype(float), -np.inf)
    if low.shape[1] > entries:
        best = np.argpartition(low, -entries, axis=1)[:, -entries:]
        some = np.zeros(low.shape, bool)
        np.put_along_axis(some, best, True, axis=1)
        free = free & some
    q, x = np.nonzero(free)
    return q, x, first[q, x] + tile.complete(q, x, 0)


def reaching(tile: Tile, free: np.ndarray, bound: np.ndarray, count: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phases 2 and 3: (query, row, score) of all pairs that reach the bound. count: gets the number of completed scores."""
    last, total, alive = len(tile.parts) - 1, 0, free
    for nth in range(last + 1):
        total = total + tile.part(nth)
        short = total + tile.rest(nth) < bound[:, None] - (1e-6 * np.abs(bound[:, None]) + 1 if nth < last else 0)
        alive = free & ~short.astype(bool)
        if nth == last or np.count_nonzero(alive) <= SPARSE * alive.size:
            break
    q, x = np.nonzero(alive)
    if count is not None:
        count[0] += len(q) if nth < last else alive.size
    score = total[q, x] + tile.complete(q, x, nth)
    fine = score >= bound[q]
    return q[fine], x[fine], score[fine]


def _top(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best entries of each query, ties to the smaller id."""
    order = np.lexsort((ids, -score, q))
    return order[np.arange(len(q)) - np.searchsorted(q[order], q[order]) < k]


NONE = -(2**62)


def _lists(queries, bounds, k: int, m: int):
    """Phase 1 (bounds None) or phases 2 and 3 of one partition's rows: its k best entries of each query.
    queries, bounds: broadcast by vector length."""

    def run(batches):
        import pyarrow as pa

        best: dict[tuple[int, int], list] = {}
        for batch in batches:
            for d, (ids, rows) in _vectors(batch).items():
                if d not in queries.value:
                    continue
                qids, qrows = queries.value[d]
                for lo in range(0, len(ids), ROWS):
                    part, own = rows[lo : lo + ROWS], ids[lo : lo + ROWS]
                    for qlo in range(0, len(qids), 256):
                        qown = qids[qlo : qlo + 256]
                        tile, free = Tile(qrows[qlo : qlo + 256], part, m), qown[:, None] != own[None, :]
                        held = best.get((d, qlo))
                        if bounds is None:
                            q, x, score = listed(tile, free, max(k, ENTRIES))
                        else:
                            bound = bounds.value[d][qlo : qlo + 256]
                            if held is not None:  # the partition's own k-th best so far
                                full = np.bincount(held[0], minlength=len(qown)) >= k
                                least = np.full(len(qown), np.inf)
                                np.minimum.at(least, held[0], held[2].astype(float))
                                bound = np.maximum(bound, np.where(full & (np.abs(least) < 2**53), least, NONE).astype(np.int64))
                            q, x, score = reaching(tile, free, bound)
                        cid = own[x]
                        if held is not None:
                            q, cid, score = np.concatenate([held[0], q]), np.concatenate([held[1], cid]), np.concatenate([held[2], score])
                        keep = _top(q, cid, score, k)
                        best[d, qlo] = [q[keep], cid[keep], score[keep]]
        for (d, qlo), (q, cid, score) in best.items():
            if len(q):
                scores = pa.array([int(v) for v in score.tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(queries.value[d][0][qlo + q]), pa.array(cid), scores], ["query_id", "vec_id", "score"])

    return run


def _best(df: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, slices: int = SLICES, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest scores of each query, ties to the smaller vec_id; fewer if
    there are fewer candidates. vectors: vec_id, embedding; other columns are left out. Vectors that are null or hold a
    null or non-finite component, and rows without an id, take no part; scores are between vectors of equal length; rows
    that repeat a vec_id are candidates (and queries) of their own, as in the SQL, and none is a candidate of its own id.
    Scores that don't fit a long fail, as they do in the SQL. An empty table gives an empty result."""
    import pyarrow as pa

    spark = vectors.sparkSession
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null and embedding is not null")
    asked = vectors.where(F.pmod("vec_id", F.lit(every)) == 0)
    # Equal query rows count as often as they stand; a block holds k of them at most.
    asked = materialise(asked.groupBy("vec_id", "embedding").agg(F.count("*").alias("times")).withColumn("deal", F.xxhash64("vec_id", "embedding")), "queries")
    size = asked.agg(F.sum(8 * F.size("embedding") + 16)).first()[0] or 0
    blocks = -(-size // query_bytes) or 1
    found = []
    for nth in range(blocks):
        # One block of the stated query set, of about `query_bytes` whatever the size of the table.
        own = asked if blocks == 1 else asked.where(F.pmod("deal", F.lit(blocks)) == nth)
        data: dict[int, list] = {}
        for batch in own.select("vec_id", "embedding", "times").toArrow().to_batches():
            nth_row = pa.array(np.arange(len(batch)))
            ids, times = (np.asarray(batch.column(i)) for i in (0, 2))
            for d, (at, rows) in _vectors(pa.RecordBatch.from_arrays([nth_row, batch.column(1)], ["vec_id", "embedding"])).items():
                often = np.minimum(times[at], k)
                data.setdefault(d, []).append((np.repeat(ids[at], often), np.repeat(rows, often, axis=0)))
        queries = {d: (np.concatenate([x for x, _ in v]), np.concatenate([x for _, x in v])) for d, v in data.items()}
        sent = spark.sparkContext.broadcast(queries)
        schema = "query_id long, vec_id long, score long"
        seen = _best(map_arrow(vectors, _lists(sent, None, k, slices), schema), k)
        kth = {r["query_id"]: r["t"] for r in seen.groupBy("query_id").agg(F.min("score").alias("t"), F.count("*").alias("n")).where(F.col("n") >= k).collect()}
        bounds = spark.sparkContext.broadcast({d: np.array([kth.get(int(q), NONE) for q in ids], np.int64) for d, (ids, _) in queries.items()})
        entries = _best(map_arrow(vectors, _lists(sent, bounds, k, slices), schema), k).drop("rank")
        found.append(entries if blocks == 1 else materialise(entries, "entries"))
    return _best(reduce(DataFrame.unionAll, found), k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % {EVERY} = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= {K}"""

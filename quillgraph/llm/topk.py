"""Exact top-k search by inner product: aggregation without random access (NRA) over sorted lists.

Vectors are packed to blocks of rows. In a block every component is a sorted list, read downwards for a query's positive
weights and upwards for its negative ones. All lists are read step by step to the same depth. A row that was met in some lists has a lower bound (what was
read of it, and the last entry of every other list) and an upper bound (what was read, and the entry at which every other list stands); a row that was met
in none has at most the sum of the entries at which the lists stand. Reading stops as soon as the k-th best lower bound, in this block or from blocks
read before, is above what an unmet row can have. The final scores of the met rows whose upper bound reaches it are then resolved from the stored rows. Where blocks before
have set that score, the depth at which the lists' entries fall under it is known beforehand, and they are read to it at once. A block whose first entries together stay below the k-th best is not read at all.

How deep this reads depends on the data. Where a few components decide (vectors of uneven length, or components that rise and fall together) a small part
of the lists is enough; for components that are independent and alike, in dozens of dimensions, the bounds meet only near the lists' ends.

The queries come in chunks of a bounded size, which are sent to every task; blocks of rows stay where they are, and a task keeps k rows for
each query over all its blocks. What is shuffled is each row once, on packing, and k scores for each task and query.

Defined results: vectors that are null, or hold null or non-finite components, take no part, nor do rows without id; rows that
repeat an id are different rows: each is a candidate, and each that is asked is a query by itself, whose own row alone is no candidate; vectors of different lengths have no product; equal scores rank by smaller id; a
query finds fewer than k rows if there are fewer; the empty table gives an empty table; other columns are ignored. Scores
are exact; where floating point could round (sums of 2**53 or more) whole numbers of any length are used, and scores beyond 64 bits end there.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import table, written

#: Rows of a block of queries and of a block of rows; blocks of rows that a task reads on average.
QUERY_ROWS, BLOCK_ROWS, TASK_BLOCKS = 2048, 4096, 4
#: Bytes of query blocks that are sent to every task at once (about); with TASK_BLOCKS they bound the pairs of blocks that a task holds.
CHUNK_BYTES = 8 << 20
_BLOCK = "dim int, ids binary, rows binary, vectors binary"


def usable(df: DataFrame, key: str, vector: str, asked: Column) -> DataFrame:
    """``id, v, row, asked``: rows of finite components, each with a number of its own; written, so that the numbers stay."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(key).cast("long").alias("id"), v.alias("v"), F.coalesce(asked, F.lit(False)).alias("asked"))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad)
    return written(rows.withColumn("row", F.monotonically_increasing_id()), "topk-usable")


def blocks(rows: DataFrame, size: int, scale: float) -> DataFrame:
    """Packs ``id, v, row`` to blocks of ``size`` rows of one length, with components ``floor(scale * x)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}

        def block(dim: int, parts: list) -> pa.RecordBatch:
            arrays = [np.concatenate([p[i] for p in parts]).tobytes() for i in range(3)]
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *(pa.array([a], pa.binary()) for a in arrays)], names=["dim", "ids", "rows", "vectors"])

        for batch in batches:
            ids, lists, numbers = batch.column(0).to_numpy(), batch.column(1), batch.column(2).to_numpy()
            lengths = np.diff(lists.offsets.to_numpy())
            flat, starts = lists.values.to_numpy(), lists.offsets.to_numpy()[:-1]
            for dim in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == dim)
                values = np.floor(scale * flat[starts[at][:, None] + np.arange(dim)])
                parts = waiting.setdefault(dim, [])
                parts.append((ids[at].astype("<i8"), numbers[at].astype("<i8"), values.astype("<f8")))
                if sum(len(p[0]) for p in parts) >= size:
                    whole = [np.concatenate([p[i] for p in parts]) for i in range(3)]
                    n = len(whole[0]) // size * size
                    for k in range(0, n, size):
                        yield block(dim, [tuple(a[k : k + size] for a in whole)])
                    waiting[dim] = [tuple(a[n:] for a in whole)]
        for dim, parts in waiting.items():
            if sum(len(p[0]) for p in parts):
                yield block(dim, parts)

    return rows.select("id", "v", "row").mapInArrow(run, _BLOCK)


class Found(NamedTuple):
    query: int
    row: int
    score: int
    depth: int  # how many entries of each list were read


def _order(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each component as a sorted list: row numbers and values, dim x n, ascending."""
    order = np.argsort(x, axis=0, kind="stable").T
    return np.ascontiguousarray(order), np.take_along_axis(x.T, order, axis=1)


def _search_one(x: np.ndarray, order: np.ndarray, values: np.ndarray, own: int, q: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows that can be among the k best of query ``q``, their scores, and the depth read. ``own``: a row that takes no part, or -1."""
    n = len(x)
    rising, falling = np.flatnonzero(q > 0), np.flatnonzero(q < 0)  # lists that are read from their upper and from their lower end
    w_rising, w_falling = q[rising, None], q[falling, None]
    worst_rising, worst_falling = w_rising * values[rising, :1], w_falling * values[falling, -1:]
    base = worst_rising.sum() + worst_falling.sum()

    def entries(depth: int) -> tuple[np.ndarray, np.ndarray]:
        """What the next entry of each list adds to the least."""
        return w_rising * values[rising, n - 1 - depth, None] - worst_rising, w_falling * values[falling, depth, None] - worst_falling

    def unmet(depth: int) -> float:
        return base + sum(float(e.sum()) for e in entries(depth)) if depth < n else -np.inf

    def read(first: int, last: int, less: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """For each row the sum over its entries from ``first`` to ``last`` of what they add, ``less`` taken from each."""
        rows = np.concatenate([order[rising, n - last : n - first].ravel(), order[falling, first:last].ravel()])
        gains = [w_rising * values[rising, n - last : n - first] - (worst_rising + less[0]), w_falling * values[falling, first:last] - (worst_falling + less[1])]
        return np.bincount(rows, weights=np.concatenate([g.ravel() for g in gains]), minlength=n)

    known, gained, depth, none = floor > -np.inf, np.zeros(n), 0, (0.0, 0.0)
    while depth < n and not unmet(depth) < floor:
        # entries sink with the depth: the first depth at which no unmet row can have the floor
        low, high = depth + 1, n
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if unmet(middle) < floor else (middle + 1, high)
        if known:
            depth = low
            break
        step = min(low, max(32, 2 * depth))  # what is met raises the floor meanwhile
        gained += read(depth, step, none)
        depth = step
        lower = base + np.delete(gained, own) if own >= 0 else base + gained
        if len(lower) >= k:
            floor = max(floor, np.partition(lower, len(lower) - k)[len(lower) - k])
    if depth == 0:
        return np.empty(0, np.int64), np.empty(0), 0
    left = entries(depth) if depth < n else none
    upper = base + sum(float(np.sum(e)) for e in left) + read(0, depth, left)
    alive = np.flatnonzero(upper >= floor - 1e-6 * max(1.0, abs(base)))  # equal bounds stay: an equal score may win by its id
    alive = alive[alive != own]
    return alive, x[alive] @ q, depth


def no_random_access(
    ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, floors: np.ndarray | None = None, rows: np.ndarray | None = None, order: tuple | None = None
) -> list[Found]:
    """Every row of the block that can be among a query's k best, best first, at most k.

    ``floors``: scores that a query's k best have elsewhere already; it is raised to what this block shows. ``rows``: numbers by which queries know their
    own row (the ids, if none are given). ``order``: the block's sorted lists, if they are known.
    """
    rows = ids if rows is None else rows
    floors = np.full(len(q), -np.inf) if floors is None else floors
    limits = np.iinfo(np.int64)
    if float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, x.shape[1]) >= 2.0**53:
        whole = [[int(v) for v in row] for row in x.tolist()]
        found = []
        for ident, weights in zip(query_ids.tolist(), q.tolist(), strict=True):
            sums = [(max(limits.min, min(limits.max, sum(v * int(w) for v, w in zip(row, weights, strict=True)))), i) for row, i, n in zip(whole, ids.tolist(), rows.tolist(), strict=True) if n != ident]
            found += [Found(ident, i, score, len(ids)) for score, i in sorted(sums, key=lambda s: (-s[0], s[1]))[:k]]
        return found
    order, values = order or _order(x)
    places = {number: at for at, number in enumerate(rows.tolist())}
    found = []
    part = n // 8 if (n := len(ids)) >= 8 * 8 * k else 0
    start = _order(x[:part]) if part and np.isneginf(floors).any() else None
    for at, ident in enumerate(query_ids.tolist()):
        if start and np.isneginf(floors[at]):  # a query without a score to beat has a look at a part of the block first
            left, scores, _ = _search_one(x[:part], *start, places[ident] if places.get(ident, part) < part else -1, q[at], k, -np.inf)
            floors[at] = np.partition(scores, -k)[-k] if len(scores) >= k else -np.inf
        left, scores, depth = _search_one(x, order, values, places.get(ident, -1), q[at], k, floors[at])
        best = np.lexsort((ids[left], -scores))[:k]
        found += [Found(ident, int(ids[left[b]]), int(scores[b]), depth) for b in best]
        if len(best) == k:
            floors[at] = max(floors[at], scores[best[-1]])
    return found


def _best_of_task(k: int):
    """A task's work: all its pairs of blocks; at the end k rows for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors: dict[bytes, np.ndarray] = {}
        best: dict[int, list[tuple[int, int]]] = {}
        names: dict[int, int] = {}
        last, order = b"", None
        for batch in batches:
            for q_dim, q_ids, q_rows, q_vectors, ids, rows, vectors in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                queries, numbers = np.frombuffer(q_rows, "<i8"), np.frombuffer(ids, "<i8")
                names.update(zip(queries.tolist(), np.frombuffer(q_ids, "<i8").tolist(), strict=True))
                floor = floors.setdefault(q_rows, np.full(len(queries), -np.inf))
                x, q = np.frombuffer(vectors, "<f8").reshape(len(numbers), q_dim), np.frombuffer(q_vectors, "<f8").reshape(len(queries), q_dim)
                if rows != last:  # blocks of queries follow each other for one block of rows
                    last, order = rows, _order(x)
                for f in no_random_access(numbers, x, queries, q, k, floor, np.frombuffer(rows, "<i8"), order):
                    best.setdefault(f.query, []).append((-f.score, f.row))
                for number in queries.tolist():
                    if len(best.get(number, ())) > k:
                        best[number] = sorted(best[number])[:k]
        flat = [(number, names[number], row, -score) for number, found in best.items() for score, row in found]
        for first in range(0, len(flat), 65_536):
            columns = list(zip(*flat[first : first + 65_536], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["q_row", "query_id", "vec_id", "score"])

    return run


def search(df: DataFrame, asked: Column, k: int, scale: float = 256.0, key: str = "vec_id", vector: str = "embedding", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``query_id, rank, vec_id, score``: of each row for which ``asked`` holds the k best other rows."""
    rows = usable(df, key, vector, asked)
    row_blocks = written(blocks(rows, BLOCK_ROWS, scale), "topk-rows")
    row_blocks = row_blocks.repartition(max(1, -(-row_blocks.count() // TASK_BLOCKS)))  # packing may leave few splits
    query_blocks = written(blocks(rows.where("asked"), QUERY_ROWS, scale), "topk-queries")
    size = query_blocks.agg(F.coalesce(F.sum(F.octet_length("vectors") + 2 * F.octet_length("ids")), F.lit(0))).first()[0]
    chunks = max(1, -(-size // chunk_bytes))
    parts = []
    for chunk in range(chunks):
        mine = query_blocks.where(F.pmod(F.xxhash64("rows"), F.lit(chunks)) == chunk).select(*[F.col(c).alias(f"q_{c}") for c in query_blocks.columns])
        pairs = row_blocks.join(F.broadcast(mine), F.col("dim") == F.col("q_dim"))  # about chunk_bytes: checked above
        pairs = pairs.select("q_dim", "q_ids", "q_rows", "q_vectors", "ids", "rows", "vectors")
        parts.append(written(pairs.mapInArrow(_best_of_task(k), "q_row long, query_id long, vec_id long, score long"), "topk-part"))
    best = Window.partitionBy("q_row").orderBy(F.desc("score"), "vec_id")
    ranked = reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


ORACLE = """
WITH ok AS (
  SELECT row_number() OVER () AS n, vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND NOT coalesce(list_bool_or([x IS NULL OR NOT isfinite(x) FOR x IN embedding]), false)
), scored AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id,
         list_sum([p[1] * p[2] FOR p IN list_zip(q.v, c.v)])::BIGINT AS score
  FROM ok q JOIN ok c ON q.vec_id % 50 = 0 AND c.n <> q.n AND c.vec_id IS NOT NULL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

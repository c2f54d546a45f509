"""A stored inverted-file index over vectors, whose answers are exact.

Unit vectors are dealt to cells by their nearest centroid. A folder holds them as blocks of rows, partitioned by cell, and for each cell and label how near to and how
far from the centroid its vectors lie. By the triangle inequality a query that is ``d`` from a centroid is at least ``max(d - far, near - d)`` from every vector of
the cell, which bounds their cosine from above. A search reads a query's nearest cells until they hold k vectors, and then only cells whose
bound reaches the k-th best cosine found there; folders of other cells are not opened.

How many cells that leaves out depends on the data: vectors that lie in clusters need a few cells, vectors without any structure in many dimensions need most.

Centroids are fitted on a bounded sample (``SAMPLE`` rows); all rows are indexed. What the driver holds is the sample, the centroids, and a few numbers for each cell.

Defined results: a null, empty or non-finite vector, one of another length than the index has, and a row without id are not in the index; a vector of length zero has
cosine 0 with all; equal cosines rank by smaller id; queries of another length find nothing; rows that repeat an id are different rows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graph import settled

#: Rows that centroids are fitted on (about), rows of a block, and the most cells there are.
SAMPLE, BLOCK_ROWS, MAX_CELLS = 16_384, 1024, 4096
#: Tiles that pairs are searched in, at least, and the most bytes of vectors of one (about): a task holds two.
TILES, TILE_BYTES = 12, 32_000_000
#: Queries (about) that meet a block at once.
CHUNK_QUERIES = 256
#: Zero vectors have a cell of their own.
ZERO = -1
#: Rounding of distances near zero; bounds give way by so much.
SLACK = 1e-6


class Index(NamedTuple):
    """``centroids``: cells x dimensions; the tables ``blocks`` and ``cells`` lie in ``path``."""

    path: str
    centroids: np.ndarray
    kind: str  # the type of ids

    def blocks(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"label string, n int, near double, far double, ids array<{self.kind}>, vectors binary, cell int").parquet(f"{self.path}/blocks")

    def cells(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("cell int, label string, n long, near double, far double").parquet(f"{self.path}/cells")


def _arrays(column: pa.Array, dim: int) -> np.ndarray:
    """A list column, all of whose lists have ``dim`` finite components, as a matrix of unit vectors (zero ones stay)."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    norms = np.sqrt(np.cumsum(flat * flat, axis=1)[:, -1])
    return flat / np.where(norms > 0, norms, 1.0)[:, None]


def _usable(df: DataFrame, embedding: str, dim: int) -> DataFrame:
    finite = ~F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where((F.size(embedding) == dim) & finite)


def _fitted(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Centroids of unit length: first far apart, then each the mean of what is nearest to it."""
    sample = sample[(sample != 0).any(axis=1)]
    if not len(sample):
        return np.zeros((0, sample.shape[1]))
    rng = np.random.default_rng(17)
    chosen = [int(rng.integers(len(sample)))]
    nearest = sample @ sample[chosen[0]]
    while len(chosen) < min(cells, len(sample)):
        away = np.maximum(0.0, 1.0 - nearest)
        if away.sum() <= 1e-12:
            break
        chosen.append(int(rng.choice(len(sample), p=away / away.sum())))
        nearest = np.maximum(nearest, sample @ sample[chosen[-1]])
    centroids = sample[chosen]
    for _ in range(rounds):
        own = np.argmax(sample @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        norms = np.linalg.norm(sums, axis=1)
        centroids = np.where(norms[:, None] > 1e-9, sums / np.maximum(norms, 1e-9)[:, None], centroids)
    return centroids


def build(df: DataFrame, path: str, dim: int, label: str | None = None, embedding: str = "embedding", key: str = "id", cells: int | None = None, sample: int = SAMPLE) -> Index:
    """Fits centroids, indexes ``df`` and writes the index to ``path``. ``cells``: about half the root of the rows, if not given."""
    rows = _usable(df, embedding, dim)
    n = rows.count()
    share = min(1.0, sample / max(1, n))
    picked = rows.where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < math.ceil(share * 1_000_000)).select(F.col(embedding).cast("array<double>")).limit(2 * sample).toArrow()
    points = _arrays(picked.column(0).combine_chunks(), dim) if picked.num_rows else np.zeros((0, dim))
    centroids = _fitted(points, cells or max(1, min(MAX_CELLS, math.ceil(math.sqrt(n) / 2))))
    index = Index(path, centroids, df.schema[key].dataType.simpleString())
    head = (ZERO, json.dumps([dim, index.kind]))
    rows_of = [head, *((i, json.dumps(c.tolist())) for i, c in enumerate(centroids))]
    df.sparkSession.createDataFrame(rows_of, "cell int, centroid string").coalesce(1).write.parquet(f"{path}/centroids")
    add(index, df, label, embedding, key)
    return index


def opened(spark: SparkSession, path: str) -> Index:
    """An index that was built before."""
    (_, head), *rows = sorted(spark.read.schema("cell int, centroid string").parquet(f"{path}/centroids").collect())  # no more than MAX_CELLS
    dim, kind = json.loads(head)
    return Index(path, np.array([json.loads(r.centroid) for r in rows]).reshape(-1, dim), kind)


def add(index: Index, df: DataFrame, label: str | None = None, embedding: str = "embedding", key: str = "id") -> None:
    """Appends rows to an index; its centroids stay."""
    centroids = index.centroids
    dim = centroids.shape[1]
    kind = index.kind
    label_column = (F.lit(None) if label is None else F.col(label)).cast("string").alias("label")
    rows = _usable(df.where(F.col(key).isNotNull()), embedding, dim).select(F.col(key).cast(kind).alias("id"), label_column, F.col(embedding).cast("array<double>").alias("v"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            u = _arrays(batch.column(2), dim)
            score = u @ centroids.T if len(centroids) else np.zeros((len(u), 1))
            cell = np.where((u != 0).any(axis=1) & (len(centroids) > 0), np.argmax(score, axis=1), ZERO).astype(np.int32)
            away = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * score[np.arange(len(u)), np.maximum(cell, 0)]))
            flat = pa.array(list(map(bytes, u.astype("<f8"))), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell), pa.array(away), flat], names=["id", "label", "cell", "away", "u"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, away, last = [], [], [], None

        def block() -> pa.RecordBatch:
            cell, name = last
            arrays = [pa.array([cell], pa.int32()), pa.array([name], pa.string()), pa.array([len(ids)], pa.int32()), pa.array([min(away)]), pa.array([max(away)]), pa.array([ids], pa.list_(ids_type)), pa.array([b"".join(vectors)], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=["cell", "label", "n", "near", "far", "ids", "vectors"])

        for batch in batches:
            ids_type = batch.schema.field("id").type
            for ident, name, cell, d, u in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ids and ((cell, name) != last or len(ids) == BLOCK_ROWS):
                    yield block()
                    ids, vectors, away = [], [], []
                last = (cell, name)
                ids.append(ident)
                vectors.append(u)
                away.append(d)
        if ids:
            yield block()

    dealt = rows.mapInArrow(assign, f"id {kind}, label string, cell int, away double, u binary")
    # a cell's rows come together, but a cell of any size may be split: blocks are what is read
    dealt = dealt.hint("rebalance", "cell").sortWithinPartitions("cell", "label", "id")
    blocks = settled(dealt.mapInArrow(pack, f"cell int, label string, n int, near double, far double, ids array<{kind}>, vectors binary"))
    blocks.write.mode("append").partitionBy("cell").parquet(f"{index.path}/blocks")
    blocks.groupBy("cell", "label").agg(F.sum("n").alias("n"), F.min("near").alias("near"), F.max("far").alias("far")).coalesce(1).write.mode("append").parquet(f"{index.path}/cells")


class Found(NamedTuple):
    """``rows``: ``query_id, rank, id, score``; ``read``: ``query_id, cell``, the cells that were read for each query."""

    rows: DataFrame
    read: DataFrame


def search(index: Index, queries: DataFrame, k: int, label: str | None = None, embedding: str = "embedding", key: str = "query_id", least: float | None = None) -> Found:
    """The k vectors nearest to each query by cosine (of one label, if it is given), and which cells that took. ``least``: only cosines from there on."""
    spark = queries.sparkSession
    centroids = index.centroids
    dim = centroids.shape[1]
    kind = queries.schema[key].dataType.simpleString()
    cells = index.cells(spark)
    if label is not None:
        cells = cells.where(F.col("label") == label)
    known = sorted(cells.groupBy("cell").agg(F.sum("n").alias("n"), F.min("near").alias("near"), F.max("far").alias("far")).collect())
    numbers = np.array([r.cell for r in known], np.int64)
    counts, near, far = (np.array([r[i] for r in known], np.float64) for i in (1, 2, 3))
    asked = settled(_usable(queries.where(F.col(key).isNotNull()), embedding, dim).select(F.col(key).alias("query_id"), F.col(embedding).cast("array<double>").alias("v")))

    def bounds(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query and cell the most a cosine can be, and the cosine with the centroid."""
        cosine = np.where(numbers >= 0, (u @ centroids.T)[:, np.maximum(numbers, 0)] if len(centroids) else 0.0, -2.0)
        d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine))
        least = np.maximum(0.0, np.maximum(d - far, near - d) - SLACK)
        upper = np.where(numbers >= 0, 1.0 - least * least / 2.0, 0.0)
        return np.where((u != 0).any(axis=1)[:, None], upper, 0.0), cosine  # a zero query has cosine 0 with all

    def pairs(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows or not len(numbers):
                    continue
                u = _arrays(batch.column(1), dim)
                upper, cosine = bounds(u)
                order = np.argsort(-cosine, axis=1, kind="stable")
                before = np.cumsum(counts[order], axis=1) - counts[order]
                early = np.zeros(order.shape, bool)
                np.put_along_axis(early, order, before < k, axis=1)  # the nearest cells, until they hold k
                if first:
                    wanted = early
                else:
                    floor = np.array([-np.inf if x is None else x for x in batch.column(2).to_pylist()])
                    wanted = ~early & (upper >= floor[:, None] - SLACK)
                if least_cosine is not None:
                    wanted &= upper >= least_cosine - SLACK
                q, c = np.nonzero(wanted)
                flat = list(map(bytes, u.astype("<f8")))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(q)), pa.array(numbers[c].astype(np.int32)), pa.array([flat[i] for i in q], pa.binary())], names=["query_id", "cell", "u"])

        return run

    least_cosine = least
    chunks = max(1, -(-asked.count() // CHUNK_QUERIES))
    schema = f"query_id {kind}, cell int, u binary"

    def scan(wanted: DataFrame) -> DataFrame:
        used = [r.cell for r in wanted.select("cell").distinct().collect()]  # no more than there are cells
        blocks = index.blocks(spark).where(F.col("cell").isin(used))  # other folders are not listed
        if label is not None:
            blocks = blocks.where(F.col("label") == label)
        groups = wanted.groupBy("cell", F.pmod(F.xxhash64("query_id"), F.lit(chunks)).alias("chunk")).agg(F.collect_list(F.struct("query_id", "u")).alias("asked"))
        # vectors that many cells are asked for look small where they lie written, and are not: they never go through the driver
        both = blocks.join(groups.hint("merge"), "cell").select("ids", "vectors", F.col("asked.query_id").alias("q_ids"), F.col("asked.u").alias("q_vectors"))
        return settled(both.mapInArrow(_best(k, dim, least_cosine), f"query_id {kind}, id {index.kind}, score double"))

    first = settled(asked.mapInArrow(pairs(True), schema))
    early = scan(first)
    kth = _ranked(early, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    later = settled(asked.join(kth, "query_id", "left").select("query_id", "v", "floor").mapInArrow(pairs(False), schema))
    rows = _ranked(early.unionByName(scan(later)), k)
    return Found(rows.select("query_id", "rank", "id", "score"), first.unionByName(later).select("query_id", "cell"))


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _best(k: int, dim: int, least: float | None):
    """Of each block and group of queries the k best for each query; a task keeps k for each query that it meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {}
        types = None

        def rows() -> pa.RecordBatch:
            flat = [(q, i, -s) for q, found in best.items() for s, i in found]
            columns = list(zip(*flat, strict=True)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["query_id", "id", "score"])

        for batch in batches:
            types = (batch.schema.field("q_ids").type.value_type, batch.schema.field("ids").type.value_type, pa.float64())
            for ids, vectors, q_ids, q_vectors in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = np.frombuffer(vectors, "<f8").reshape(-1, dim)
                q = np.frombuffer(b"".join(q_vectors), "<f8").reshape(-1, dim)
                rough = q @ x.T
                cut = np.partition(rough, -k, axis=1)[:, -k] if rough.shape[1] > k else np.full(len(q), -np.inf)
                if least is not None:
                    cut = np.maximum(cut, least)
                # a matrix product rounds by place in the matrix: what is near the cut is summed again, in order
                at, row = np.nonzero(rough >= cut[:, None] - 1e-9)
                score = np.cumsum(q[at] * x[row], axis=1)[:, -1]
                for a, r, s in zip(at.tolist(), row.tolist(), score.tolist(), strict=True):
                    if least is None or s >= least:
                        best.setdefault(q_ids[a], []).append((-s, ids[r]))
                for ident in q_ids:
                    if len(best.get(ident, ())) > k:
                        best[ident] = sorted(best[ident])[:k]
            if len(best) > 100_000:
                yield rows()
                best = {}
        if best:
            yield rows()

    return run


def cell_pairs(index: Index, spark: SparkSession, threshold: float) -> DataFrame:
    """``cell, other`` (``cell <= other``): the pairs of cells that may hold two vectors with a cosine of the threshold."""
    centroids = index.centroids
    cells = index.cells(spark).groupBy("cell").agg(F.max("far").alias("far"))
    far = {r.cell: r.far for r in cells.collect()}  # no more than there are cells
    numbers = np.array(sorted(far), np.int32)
    reach = np.array([far[c] for c in numbers.tolist()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column(0).to_pylist():
                d = np.linalg.norm(centroids[np.maximum(numbers, 0)] - centroids[cell], axis=1) if cell >= 0 else np.zeros(len(numbers))
                least = np.maximum(0.0, d - reach - far[cell] - SLACK)
                upper = np.where((numbers >= 0) & (cell >= 0), 1.0 - least * least / 2.0, 0.0)
                others = numbers[(numbers >= cell) & (upper >= threshold)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(others), cell, np.int32)), pa.array(others)], names=["cell", "other"])

    return cells.select("cell").mapInArrow(run, "cell int, other int")


def _tiles(index: Index, spark: SparkSession, threshold: float) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """``cell, first, parts``: the tiles that a cell's blocks are dealt to, and ``tile, lo, hi``: for each tile the pairs of tiles it takes part in.

    Tiles hold about as many rows each, from cells near to each other, and are at least ``TILES``, so that a row goes to so many tasks whatever the number of rows,
    until a tile holds ``TILE_BYTES``. Only pairs of tiles that some pair of cells needs are there. The driver holds a few numbers for each cell.
    """
    sizes = {r.cell: (r.n, r.far) for r in index.cells(spark).groupBy("cell").agg(F.sum("n").alias("n"), F.max("far").alias("far")).collect()}
    numbers = np.array(sorted(sizes), np.int64)
    n, far = (np.array([sizes[c][i] for c in numbers.tolist()], np.float64) for i in (0, 1))
    total, dim = int(n.sum()), index.centroids.shape[1]
    tiles = max(min(TILES, -(-total // BLOCK_ROWS)), -(-total * dim * 8 // TILE_BYTES), 1)
    most = -(-total // tiles)
    at = np.where((numbers >= 0)[:, None], index.centroids[np.maximum(numbers, 0)], 0.0) if len(index.centroids) else np.zeros((len(numbers), dim))
    left, chain, here = np.ones(len(numbers), bool), [], 0
    while left.any():  # each cell is followed by the nearest one that is left
        chain.append(here)
        left[here] = False
        here = int(np.argmax(np.where(left, at @ at[here], -np.inf)))
    spans, tile, filled = {}, 0, 0
    for c in chain:
        if filled and filled + n[c] > most:
            tile, filled = tile + 1, 0
        spans[c] = (tile, max(1, -(-int(n[c]) // most)))
        filled += n[c]
        if spans[c][1] > 1:
            tile, filled = tile + spans[c][1], 0
    wanted = set()
    for c in range(len(numbers)):
        upper = _most(numbers[c], at[c], far[c], numbers, at, far)
        for o in np.nonzero(upper[c:] >= threshold)[0] + c:
            wanted |= {tuple(sorted((spans[c][0] + i, spans[o][0] + j))) for i in range(spans[c][1]) for j in range(spans[o][1])}
    return [(int(numbers[c]), *span) for c, span in spans.items()], [x for lo, hi in sorted(wanted) for x in {(lo, lo, hi), (hi, lo, hi)}]


def _most(cell: int, centre: np.ndarray, far: float, cells: np.ndarray, centres: np.ndarray, fars: np.ndarray) -> np.ndarray:
    """The most a cosine between a vector of one cell and one of each other cell can be."""
    least = np.maximum(0.0, np.linalg.norm(centres - centre, axis=1) - fars - far - SLACK)
    return np.where((cells >= 0) & (cell >= 0), 1.0 - least * least / 2.0, 0.0)


def _met(index: Index, spark: SparkSession, threshold: float, run, schema: str) -> DataFrame:
    """``run`` over the blocks of each pair of tiles that may hold a pair."""
    cells, pairs = _tiles(index, spark, threshold)
    spans = spark.createDataFrame(cells, "cell int, first int, parts int")
    pairs = spark.createDataFrame(pairs, "tile int, lo int, hi int")
    dealt = index.blocks(spark).join(F.broadcast(spans), "cell").withColumn("tile", (F.col("first") + F.pmod(F.xxhash64("ids"), F.col("parts"))).cast("int"))
    spread = dealt.join(F.broadcast(pairs), "tile").select("lo", "hi", "tile", "cell", "far", "ids", "vectors")
    return spread.groupBy("lo", "hi").applyInArrow(run, schema)


class _Block(NamedTuple):
    tile: int
    cell: int
    far: float
    ids: np.ndarray
    x: np.ndarray


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> list[_Block]:
    """Of a pair of tiles, which are bounded."""
    found = []
    for batch in batches:
        tile, cell, far, ids, vectors = (batch.column(name) for name in ("tile", "cell", "far", "ids", "vectors"))
        for i in range(batch.num_rows):
            x = np.frombuffer(vectors[i].as_buffer(), "<f8").reshape(-1, dim)
            found.append(_Block(tile[i].as_py(), cell[i].as_py(), far[i].as_py(), ids[i].values.to_numpy(zero_copy_only=False), x))
    return found


def _meetings(blocks: list[_Block], centroids: np.ndarray, threshold: float) -> Iterator[tuple[int, int]]:
    """The pairs of blocks, of two tiles or of one, whose bound reaches the threshold."""
    cells, fars = np.array([b.cell for b in blocks]), np.array([b.far for b in blocks])
    tiles = np.array([b.tile for b in blocks])
    centres = np.where((cells >= 0)[:, None], centroids[np.maximum(cells, 0)], 0.0) if len(centroids) else np.zeros((len(cells), centroids.shape[1]))
    two = len(set(tiles.tolist())) > 1
    for i in range(len(blocks)):
        upper = _most(cells[i], centres[i], fars[i], cells, centres, fars)
        for j in np.nonzero((upper >= threshold) & (np.arange(len(blocks)) >= i) & ((tiles != tiles[i]) | (not two)))[0].tolist():
            yield i, j


def _reaching(x: np.ndarray, y: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of ``x`` and of ``y`` with their cosine, where it reaches the threshold; the sums are in order, so that they do not depend on blocks."""
    p, q = np.nonzero(x @ y.T >= threshold - 1e-9)
    for first in range(0, len(p), 16_384):
        a, b = p[first : first + 16_384], q[first : first + 16_384]
        score = np.cumsum(x[a] * y[b], axis=1)[:, -1]
        yield a[score >= threshold], b[score >= threshold], score[score >= threshold]


def close_pairs(index: Index, spark: SparkSession, threshold: float) -> DataFrame:
    """``a, b, score``: all pairs of the index, ids ``a < b``, with a cosine of the threshold or more.

    Only blocks of cells whose bound reaches the threshold meet. A task holds two tiles of a bounded size, and a row goes to at most as many tasks as there are tiles.
    """
    dim, centroids, kind = index.centroids.shape[1], index.centroids, index.kind

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _blocks(batches, dim)
        for i, j in _meetings(blocks, centroids, threshold):
            left, right = blocks[i], blocks[j]
            for p, q, score in _reaching(left.x, right.x, threshold):
                a, b = left.ids[p], right.ids[q]
                kept = (p < q if i == j else np.ones(len(p), bool)) & (a != b)
                a, b, score = a[kept], b[kept], score[kept]
                yield pa.RecordBatch.from_arrays([pa.array(np.where(a < b, a, b)), pa.array(np.where(a < b, b, a)), pa.array(score)], names=["a", "b", "score"])

    return _met(index, spark, threshold, run, f"a {kind}, b {kind}, score double")


def close_links(index: Index, spark: SparkSession, threshold: float) -> DataFrame:
    """``a, b``: of the pairs of ``close_pairs`` so many that the same rows hang together.

    Each task gives the links of a spanning forest of its two tiles, less than one for each of their rows, however many pairs these have. Rows that hang together
    already are not compared any more.
    """
    dim, centroids, kind = index.centroids.shape[1], index.centroids, index.kind

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _blocks(batches, dim)
        starts = np.cumsum([0, *(len(b.x) for b in blocks)])
        root = np.arange(starts[-1])
        largest = 0
        for i, j in _meetings(blocks, centroids, threshold):
            left, right = blocks[i], blocks[j]
            x_in, y_in = (root[starts[k] : starts[k + 1]] == largest for k in (i, j))
            found = []
            # of the pairs only those are left out whose ends both hang together with the largest part
            for mine, other in ((np.arange(len(left.x)), np.nonzero(~y_in)[0]), (np.nonzero(~x_in)[0], np.nonzero(y_in)[0])):
                if not len(mine) or not len(other):
                    continue
                for p, q, _ in _reaching(left.x[mine], right.x[other], threshold):
                    p, q = mine[p], other[q]
                    u, v = starts[i] + p, starts[j] + q
                    new = root[u] != root[v]
                    u, v, p, q = u[new], v[new], p[new], q[new]
                    joined = False
                    for at in np.unique(np.stack([root[u], root[v]], 1), axis=0, return_index=True)[1].tolist() if len(u) else ():
                        a, b = int(root[u[at]]), int(root[v[at]])
                        while root[a] != a:
                            a = int(root[a])
                        while root[b] != b:
                            b = int(root[b])
                        if a != b:
                            root[max(a, b)] = min(a, b)
                            found.append((left.ids[p[at]], right.ids[q[at]]))
                            joined = True
                    while joined:
                        up = root[root]
                        joined = bool((up != root).any())
                        root = up
            if found:
                largest = int(np.argmax(np.bincount(root)))
                a, b = (np.array(c, left.ids.dtype) for c in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.where(a < b, a, b)), pa.array(np.where(a < b, b, a))], names=["a", "b"])

    return _met(index, spark, threshold, run, f"a {kind}, b {kind}")

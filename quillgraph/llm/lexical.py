"""Ranked lexical search: max trees over document ranges, searched best-first by branch and bound.

1. Index: each task splits its documents' texts into terms and packs those with terms that are asked for to blocks, ranges of up to ``BLOCK_DOCS`` consecutive
   documents with their postings; the blocks are written, and with them the counts for the weights.
2. Bounds: over the documents of a block a term has a greatest contribution; a query's bound in the block is the weighted sum of these. These
   sums, one for each block and query, are the tree's upper level, and a table.
3. Seeds: each query is searched in the few blocks of its highest bounds. Its k-th best score there is a floor for all others.
4. Rest: of the other blocks those are searched whose bound reaches the floor. An equal bound is opened, as an equal score may win by its id.

In a block each term has a tree of maxima over ranges of ``FAN`` documents, ``FAN`` of those, and so on. The node with the highest
summed bound is opened first; leaves are scored exactly, and the search ends when the best node left is below the k-th best score.

The queries come in chunks of a bounded size (``chunk_bytes`` of text), which every task gets whole, as it does the chunk's vocabulary. What the driver
collects is counts for that vocabulary and k scores for each of the chunk's queries. A block is one row and at most ``BLOCK_POSTINGS`` postings and a document.

Defined results: a null text has no terms; documents without terms do not count; a row without id is a document like others and ranks after
those with ids of equal score; rows that repeat an id are different documents; every row of the queries is a query by itself, whose id is passed on as it
is; a query finds fewer than k documents if fewer score above 0; empty tables give an empty table; further columns are ignored. Scores are 64-bit integers.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from math import floor, log
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import table, written

#: Documents of a block and (about) postings it may have; nodes below a node of the tree; blocks a query is searched in first.
BLOCK_DOCS, BLOCK_POSTINGS, FAN, SEEDS = 2048, 1 << 18, 16, 2
#: Bytes of query texts that are searched at once.
CHUNK_BYTES = 4 << 20
#: Of the byte values: letters and digits of ASCII (A-Z as a-z) and all beyond stand for themselves, the rest for a space.
_FOLD = bytes(c if c > 127 else ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(256))
_BLOCK = "block long, docs long, length long, term array<int>, df array<int>, ids binary, known binary, lengths binary, counts binary, terms binary, tfs binary"


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return text.translate(_FOLD).split()


class Queries(NamedTuple):
    """A chunk of queries: of the i-th the distinct terms (numbers in the vocabulary) and how often each occurs."""

    ids: list
    terms: list[np.ndarray]
    times: list[np.ndarray]
    vocabulary: dict[bytes, int]


def asked(rows: list[tuple]) -> Queries:
    vocabulary: dict[bytes, int] = {}
    out = Queries([], [], [], vocabulary)
    for ident, text in rows:
        counts = Counter(terms((text or "").encode()))
        out.ids.append(ident)
        out.terms.append(np.array([vocabulary.setdefault(t, len(vocabulary)) for t in counts], np.int64))
        out.times.append(np.array(list(counts.values()), np.int64))
    return out


def blocks(docs: DataFrame, vocabulary: dict[bytes, int], block_docs: int = BLOCK_DOCS, block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """Packs ``id, text`` to blocks. A document without asked terms only counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        docs = length = 0
        ids: list = []
        lengths: list[int] = []
        found: list[dict[int, int]] = []
        postings = 0

        def block() -> pa.RecordBatch:
            flat = np.fromiter((t for f in found for t in f), "<i4", postings)
            tfs = np.fromiter((n for f in found for n in f.values()), "<i4", postings)
            term, df = np.unique(flat, return_counts=True)
            counts = np.array([len(f) for f in found], "<i4")
            payload = [np.array([i or 0 for i in ids], "<i8"), np.array([i is not None for i in ids], "u1"), np.array(lengths, "<i8"), counts, flat, tfs]
            columns = [*(pa.array([x], pa.int64()) for x in (number, docs, length)), pa.array([term.tolist()], pa.list_(pa.int32())), pa.array([df.tolist()], pa.list_(pa.int32()))]
            return pa.RecordBatch.from_arrays([*columns, *(pa.array([p.tobytes()], pa.binary()) for p in payload)], names=[c.split()[0] for c in _BLOCK.split(", ")])

        for batch in batches:
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                all_terms = terms(text.as_py() or b"")
                if not all_terms:
                    continue
                docs += 1
                length += len(all_terms)
                here = {vocabulary[t]: n for t, n in Counter(all_terms).items() if t in vocabulary}
                if here:
                    ids.append(ident)
                    lengths.append(len(all_terms))
                    found.append(here)
                    postings += len(here)
                if len(ids) >= block_docs or postings >= block_postings:
                    yield block()
                    number, docs, length, postings = number + 1, 0, 0, 0
                    ids, lengths, found = [], [], []
        if docs:
            yield block()

    return docs.select("id", F.col("text").cast("binary")).mapInArrow(run, _BLOCK)


class Scale(NamedTuple):
    """What scores take from the whole table: its documents, their terms, and each asked term's weight."""

    docs: int
    length: int
    weights: np.ndarray


def scale(index: DataFrame, size: int) -> Scale:
    docs, length = index.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("length"), F.lit(0))).first()
    counts = index.select(F.explode(F.arrays_zip("term", "df")).alias("x")).groupBy("x.term").agg(F.sum("x.df").alias("df"))
    weights = np.zeros(size, np.int64)
    for term, df in counts.collect():  # no more than the chunk's vocabulary
        weights[term] = floor(1000 * log((2 * docs + 2) / (2 * df + 1)))
    return Scale(docs, length, weights)


class Block:
    """A block's postings with their contributions, and the maxima of each term over the ranges of documents."""

    def __init__(self, row: dict, of: Scale, trees: bool = True):
        self.ids, self.known = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["known"], "u1")
        lengths, counts = np.frombuffer(row["lengths"], "<i8"), np.frombuffer(row["counts"], "<i4")
        tf = np.frombuffer(row["tfs"], "<i4").astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(counts)])
        self.present, self.local = np.unique(np.frombuffer(row["terms"], "<i4"), return_inverse=True)
        m = 25 + (75 * lengths * of.docs) // max(1, of.length)
        self.gains = (1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, counts))
        nodes = -(-len(self.ids) // FAN) if trees else 1
        at = np.repeat(np.arange(len(self.ids)) // (FAN if trees else max(1, len(self.ids))), counts)
        level = np.zeros((len(self.present), max(1, nodes)), np.int64)
        np.maximum.at(level, (self.local, at), self.gains)
        self.levels = [level]  # from the leaves to the root
        while self.levels[-1].shape[1] > 1:
            below = self.levels[-1]
            self.levels.append(np.maximum.reduceat(below, np.arange(0, below.shape[1], FAN), axis=1))

    def weighed(self, q: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A query's terms that the block has, by their place in it, and their weights."""
        at = np.minimum(np.searchsorted(self.present, q), len(self.present) - 1)
        here = self.present[at] == q
        return at[here], weights[here]

    def leaf(self, node: int, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The documents of a leaf and their scores."""
        docs = np.arange(node * FAN, min((node + 1) * FAN, len(self.ids)))
        first, last = self.starts[docs[0]], self.starts[docs[-1] + 1]
        return docs, np.add.reduceat(dense[self.local[first:last]] * self.gains[first:last], self.starts[docs] - first)

    def search(self, q: np.ndarray, weights: np.ndarray, k: int, best: list[tuple], least: int) -> int:
        """Adds to ``best`` what the block has of the k best; gives the number of opened nodes. ``least``: scores below it are not wanted."""
        at, weights = self.weighed(q, weights)
        if not len(at):
            return 0
        dense = np.zeros(len(self.present), np.int64)
        dense[at] = weights
        top = len(self.levels) - 1
        heap = [(-int(weights @ self.levels[top][at, 0]), top, 0)]
        opened = 0
        least = max(1, least, best[k - 1][0] * -1 if len(best) >= k else 0)
        while heap and -heap[0][0] >= least:
            _, level, node = heapq.heappop(heap)
            opened += 1
            if level:
                first = node * FAN
                sums = weights @ self.levels[level - 1][at, first : first + FAN]
                for child in np.flatnonzero(sums >= least).tolist():
                    heapq.heappush(heap, (-int(sums[child]), level - 1, first + child))
                continue
            docs, scores = self.leaf(node, dense)
            good = scores >= least
            if good.any():
                best += [(-int(s), not self.known[d], int(self.ids[d])) for d, s in zip(docs[good].tolist(), scores[good].tolist(), strict=True)]
                best.sort()
                del best[k:]
                if len(best) == k:
                    least = max(least, -best[-1][0])
        return opened


def _weights(queries: Queries, of: Scale) -> list[np.ndarray]:
    return [of.weights[t] * n for t, n in zip(queries.terms, queries.times, strict=True)]


def bounds(index: DataFrame, queries: Queries, of: Scale) -> DataFrame:
    """``block, query, bound``: what no document of the block exceeds, where it is above 0."""
    weights = _weights(queries, of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if not row["ids"]:
                    continue
                b = Block(row, of, trees=False)
                greatest = np.zeros(len(of.weights), np.int64)
                greatest[b.present] = b.levels[0][:, 0]
                sums = [int(w @ greatest[t]) for t, w in zip(queries.terms, weights, strict=True)]
                found = [(row["block"], q, s) for q, s in enumerate(sums) if s > 0]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["block", "query", "bound"])

    return index.select("block", "ids", "known", "lengths", "counts", "terms", "tfs").mapInArrow(run, "block long, query long, bound long")


def found(index: DataFrame, pairs: DataFrame, queries: Queries, of: Scale, k: int, floors: dict[int, int]) -> DataFrame:
    """``query, doc_id, score, opened``: k documents or fewer for each task and query, from the blocks that ``pairs`` (``block, query``) names."""
    weights = _weights(queries, of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple]] = {}
        opened: Counter = Counter()
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                b = Block(row, of)
                for q in sorted(row["queries"]):
                    opened[q] += b.search(queries.terms[q], weights[q], k, best.setdefault(q, []), floors.get(q, 0))
        flat = [(q, ident if known else None, -score, opened[q]) for q, docs in best.items() for score, unknown, ident in docs for known in (not unknown,)]
        for first in range(0, len(flat), 65_536):
            columns = list(zip(*flat[first : first + 65_536], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query", "doc_id", "score", "opened"])

    wanted = pairs.groupBy("block").agg(F.collect_list("query").alias("queries"))  # a chunk's queries at most
    both = index.select("block", "ids", "known", "lengths", "counts", "terms", "tfs").join(wanted, "block")
    return both.mapInArrow(run, "query long, doc_id long, score long, opened long")


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_chunk(docs: DataFrame, queries: Queries, k: int, seeds: int, block_docs: int) -> DataFrame:
    spark = docs.sparkSession
    index = written(blocks(docs, queries.vocabulary, block_docs), "lexical-blocks")
    of = scale(index, len(queries.vocabulary))
    tops = written(bounds(index, queries, of), "lexical-bounds")
    highest = Window.partitionBy("query").orderBy(F.desc("bound"), "block")
    first = written(tops.withColumn("_r", F.row_number().over(highest)).where(F.col("_r") <= seeds).select("block", "query"), "lexical-seeds")
    early = written(found(index, first, queries, of, k, {}), "lexical-early")
    kth = _ranked(early, k).where(F.col("rank") == k).select("query", "score").collect()  # one row a query of the chunk
    floors = {q: s for q, s in kth}
    limits = spark.createDataFrame([(q, floors.get(q, 1)) for q in range(len(queries.ids))], "query long, least long")
    rest = tops.join(limits, "query").where(F.col("bound") >= F.col("least")).join(first, ["block", "query"], "left_anti")
    late = written(found(index, rest.select("block", "query"), queries, of, k, floors), "lexical-late")
    names = spark.createDataFrame([(q, i) for q, i in enumerate(queries.ids)], "query long, item_id long")
    return _ranked(early.unionByName(late), k).join(names, "query").select("item_id", "rank", "doc_id", "score")


def search(
    docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    chunk_bytes: int = CHUNK_BYTES, seeds: int = SEEDS, block_docs: int = BLOCK_DOCS,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's k best documents."""
    asks = items.select(F.col(item).cast("long").alias("id"), F.col(item_text).alias("text")).where(F.col("text").isNotNull())
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    size = asks.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    chunks = max(1, -(-size // chunk_bytes))
    asks = written(asks.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(chunks))), "lexical-items")
    parts = []
    for chunk in range(chunks):
        queries = asked([tuple(r) for r in asks.where(F.col("chunk") == chunk).select("id", "text").collect()])  # about chunk_bytes: checked above
        if queries.vocabulary:
            parts.append(_search_chunk(rows, queries, k, seeds, block_docs))
    return reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
q AS (SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
qt AS (SELECT i, any_value(item_id) AS item_id, term, count(*) AS times FROM q GROUP BY i, term),
s AS (SELECT count(*) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d WHERE len(t) > 0),
p AS (SELECT r, any_value(doc_id) AS doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d) x WHERE term IN (SELECT term FROM qt) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY term),
scored AS (SELECT i, any_value(item_id) AS item_id, r, any_value(doc_id) AS doc_id,
  sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM qt JOIN p USING (term) JOIN w USING (term), s GROUP BY i, r),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

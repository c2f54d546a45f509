"""MinHash near-dedup with SetSketch registers.

1. Sketch. Each text becomes its set of word shingles (64-bit hashes of whole words), the set's size, a 128-bit key of the set and
   registers: ``K_i = floor(1 - log_b h_i)``, where ``h_i`` is the set's minimum of the i-th exponential hash, truncated to
   ``[0, Q + 1]``. Registers of two sets merge by maximum, so long texts are sketched piece by piece.
2. Classes. Texts with equal sets are one class, with a number of its own; from here on only classes are handled. Nothing but the set decides what a
   class is: ids, which may be missing or repeat, are only carried along for the answer.
3. Bands. Runs of registers are hashed to band keys. In each band bucket the hub is the class that shares most buckets with others, which the original of
   a group of copies does. Every class first meets one hub, the one with which it shares most buckets.
4. Estimate. The similarity of a pair is the maximum of the joint likelihood of its registers (how many are larger, smaller, equal), given both
   set sizes; pairs that lie far under the threshold (over six standard errors) go.
5. Verify. What is left is confirmed on the full sets of both texts.
6. Components of the confirmed links, by alternating large and small stars.
7. Rest. Classes of buckets that still hold different components are joined by prefixes: with shingles in one order, rare ones first, two
   sets of the wanted similarity share one of their first few shingles, at places that leave room for the rest. Lists of one component, or
   without room for any partner of a size that they hold, are left out, so copies of each other are not compared again. All pairs of different
   components that remain are estimated and verified like the first ones, and the components are final.

A group of g copies of each other is so settled with about g pairs, not g * g. Buckets, hubs, shingles, exact copies and star centres can be hot
keys: what is counted by them is counted before it is shuffled, and what is joined by them is joined from written tables, two plain
shuffles under one sort-merge join, which adaptive execution splits where a partition is skewed.

The band shape is chosen so that a pair exactly at the threshold is missed with probability of at most one in a million. Nothing is
capped.

Defined results: a text without words, or null, has an empty set and is linked with nothing; texts with fewer words than a shingle have
their whole sequence as one shingle; rows with one ``doc_id`` and different texts are different documents, each linked by its own text; a null id comes after all
others: a component has a null ``component_id`` only if no row of it has an id; the empty table gives an empty table; columns besides key and text are ignored.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import table, written

REGISTERS = 280
BASE, RATE, Q = 1.001, 20.0, (1 << 16) - 2
MISS = 1e-6
#: Pairs whose estimate is this much under the threshold are dropped: over six standard errors with 280 registers.
SLACK = 0.15

_seeds = np.random.Generator(np.random.PCG64(20_240_601))
_BYTE = _seeds.integers(1, 1 << 64, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z like a-z
_IN_WORD = np.ones(256, dtype=bool)
_IN_WORD[[0x20, *range(0x09, 0x0E)]] = False
_A = _seeds.integers(0, 1 << 32, REGISTERS, dtype=np.uint32) | np.uint32(1)
_B = _seeds.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)
_P = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(text: bytes) -> np.ndarray:
    global _powers
    data = np.frombuffer(text, dtype=np.uint8)
    inside = _IN_WORD[data]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    longest = int(lengths.max())
    if longest > len(_powers):
        _powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(2 * longest, _P)]))
    offsets = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(offsets, lengths)
    return _mixed(np.add.reduceat(_BYTE[data[inside]] * _powers[place], offsets) + lengths.astype(np.uint64))


def shingles(text: str | None, size: int) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles of ``size`` words."""
    words = _word_hashes((text or "").encode("utf-8", "surrogatepass"))
    if not len(words):
        return words
    n = max(1, len(words) - size + 1)
    hashed = np.zeros(n, dtype=np.uint64)
    for k in range(min(size, len(words))):
        hashed = _mixed(hashed * _P + words[k : k + n] + np.uint64(k + 1))
    return np.unique(hashed)


def registers(elements: np.ndarray, piece: int = 1 << 14) -> np.ndarray:
    """SetSketch registers of a non-empty set of hashes."""
    x = (elements >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, dtype=np.uint32)
    for first in range(0, len(x), piece):
        part = x[first : first + piece]
        for r in range(0, REGISTERS, 40):
            np.minimum(least[r : r + 40], (_A[r : r + 40, None] * part + _B[r : r + 40, None]).min(axis=1), out=least[r : r + 40])
    h = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(h) / math.log(BASE)), 0, Q + 1).astype("<u2")


def band_rows(threshold: float, miss: float = MISS) -> int:
    """The most registers a band can have, so that a pair at the threshold is missed with probability ``miss`` at most."""
    return max(r for r in range(1, 33) if r == 1 or (1 - threshold**r) ** (REGISTERS // r) <= miss)


def likeliest(n_a: np.ndarray, n_b: np.ndarray, k_a: np.ndarray, k_b: np.ndarray) -> np.ndarray:
    """Similarities that maximise the joint likelihood of pairs of register rows, given the set sizes."""
    larger, smaller = (k_a > k_b).sum(axis=1)[:, None], (k_a < k_b).sum(axis=1)[:, None]
    equal = k_a.shape[1] - larger - smaller
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    step = np.linspace(0, 1, 201)[None, :]
    j = step * np.minimum(u / v, v / u)  # no pair of such sizes is more alike

    def p(x: np.ndarray) -> np.ndarray:
        return np.maximum(-np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / math.log(BASE), 1e-12)

    p_larger, p_smaller = p(u - v * j), p(v - u * j)
    value = larger * np.log(p_larger) + smaller * np.log(p_smaller) + equal * np.log(np.maximum(1 - p_larger - p_smaller, 1e-12))
    return j[np.arange(len(j)), np.argmax(value, axis=1)]


def _row_key(key: str, text: str) -> list[Column]:
    """What tells rows apart: the id and two hashes of the text."""
    return [F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(20_240_601), text).alias("h2")]


def _same_row(left: str, right: str) -> Column:
    h1, h2, ident = (F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in ("h1", "h2", "doc_id"))
    return h1 & h2 & ident


def sketched(docs: DataFrame, size: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, h1, h2, n, k1, k2, registers`` for each row, written once. ``h1, h2`` tell texts apart, ``k1, k2`` sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                n, k1, k2, regs = [], [], [], []
                for t in part.column(3):
                    s = shingles(t.as_py(), size)
                    n.append(len(s))
                    k1.append(int(np.add.reduce(_mixed(s + np.uint64(1)).view(np.int64))) if len(s) else 0)
                    k2.append(int(np.add.reduce(_mixed(s ^ _P).view(np.int64))) if len(s) else 0)
                    regs.append(registers(s).tobytes() if len(s) else b"")
                columns = [*part.columns[:3], pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(regs, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h1", "h2", "n", "k1", "k2", "registers"])

    rows = docs.select(*_row_key(key, text), F.col(text))
    return written(rows.mapInArrow(run, "doc_id long, h1 long, h2 long, n long, k1 long, k2 long, registers binary"), "sketches")


def banded(classes: DataFrame, rows: int) -> DataFrame:
    """``bucket, id``: one row for each band of each class."""
    bands = REGISTERS // rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 2048):
                part = batch.slice(first, 2048)
                ids = part.column(0).to_numpy()
                k = np.stack([np.frombuffer(x.as_buffer(), "<u2")[: bands * rows] for x in part.column(1)]).astype(np.uint64).reshape(len(ids), bands, rows)
                hashed = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(ids), bands)) * _P
                for r in range(rows):
                    hashed = _mixed(hashed + k[:, :, r] * _P + np.uint64(r + 1))
                yield pa.RecordBatch.from_arrays([pa.array(hashed.view(np.int64).ravel()), pa.array(np.repeat(ids, bands))], names=["bucket", "id"])

    return classes.select("id", "registers").mapInArrow(run, "bucket long, id long")


def _estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose sizes and registers allow the threshold."""
    c = classes.select("id", "n", "registers")

    def side(name: str) -> DataFrame:
        return c.select(F.col("id").alias(name), F.col("n").alias(f"n_{name}"), F.col("registers").alias(f"k_{name}"))

    joined = pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a")
    joined = joined.where((100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 2048):
                part = batch.slice(first, 2048)
                n_a, n_b = part.column(2).to_numpy(), part.column(3).to_numpy()
                k_a, k_b = (np.stack([np.frombuffer(x.as_buffer(), "<u2") for x in part.column(c)]) for c in (4, 5))
                keep = likeliest(n_a, n_b, k_a, k_b) >= percent / 100 - SLACK
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return joined.select("a", "b", "n_a", "n_b", "k_a", "k_b").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    b_side, a_side = (texts.select(F.col("id").alias(x), F.col("t").alias(f"t_{x}")) for x in "ba")
    joined = pairs.join(b_side, "b").join(a_side, "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: OrderedDict[int, tuple[str, np.ndarray]] = OrderedDict()
        for batch in batches:
            a, b, links = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for x, t_x, t_y in zip(a, batch.column(2), batch.column(3), strict=True):
                hub = t_x.as_py()
                if x not in recent or recent[x][0] != hub:
                    recent[x] = (hub, shingles(hub, size))
                    if len(recent) > 16:
                        recent.popitem(last=False)
                s, t = recent[x][1], shingles(t_y.as_py(), size)
                common = len(np.intersect1d(s, t, assume_unique=True))
                links.append(common > 0 and 100 * common >= percent * (len(s) + len(t) - common))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]).filter(pa.array(links, pa.bool_()))

    return joined.select("a", "b", "t_a", "t_b").mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """``id, component`` (the smallest id reachable) for every id in ``links`` (``a, b``), by alternating stars.

    Ends when a round changes nothing; each round's links are written, so that lineage stays short.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = written(edges, "links")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = written(small.select("e.u", "e.v").where("u <> v").distinct(), "stars")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def _placed(members: DataFrame, found: DataFrame) -> DataFrame:
    return members.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))


def _mixed_only(placed: DataFrame) -> DataFrame:
    """The members of buckets that hold different components."""
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")).where("_lo < _hi")
    return placed.join(written(mixed.select("bucket"), "mixed"), "bucket")


def _prefix_pairs(placed: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """``a, b``: all pairs of different components among ``placed`` (``id, component``) that can reach the threshold.

    The order of shingles is by the number of classes that have them, then by hash. A common shingle at places p and q of sets of n and m
    leaves room for 1 + min(n - p, m - q) common ones from there on, of which percent * (n + m) / (100 + percent) are needed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ident, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = shingles(t.as_py(), size).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), ident)), pa.array(np.full(len(s), len(s))), pa.array(s)], names=["id", "n", "shingle"])

    each = written(texts.join(placed.select("id"), "id", "left_semi").select("id", "t").mapInArrow(run, "id long, n long, shingle long"), "shingles")
    common = written(each.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "common")
    order = Window.partitionBy("id").orderBy(F.coalesce("df", F.lit(1)), "shingle")
    ranked = each.join(common, "shingle", "left").withColumn("at", F.row_number().over(order))
    needed = F.ceil(F.col("n") * percent / 100)
    prefixes = written(ranked.where((F.col("at") <= F.col("n") - needed + 1) & F.col("df").isNotNull()).join(placed, "id").select("id", "component", "n", "shingle", "at"), "prefixes")

    def roomy(lists: DataFrame) -> DataFrame:
        about = lists.groupBy("shingle").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi"), F.min("n").alias("_least")).where("_lo < _hi")
        return lists.join(written(about, "about"), "shingle").where((100 + percent) * (1 + F.col("n") - F.col("at")) >= percent * (F.col("n") + F.col("_least"))).select(*lists.columns)

    lists = written(roomy(written(roomy(prefixes), "lists")), "lists")  # twice: what the first leaves may be of one component
    x, y = (lists.select("shingle", *[F.col(c).alias(f"{c}_{side}") for c in ("id", "component", "n", "at")]) for side in "ab")
    room = 1 + F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    possible = (F.col("id_a") < F.col("id_b")) & (F.col("component_a") != F.col("component_b")) & ((100 + percent) * room >= percent * (F.col("n_a") + F.col("n_b")))
    return x.join(y, "shingle").where(possible).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()


def grouped(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, h1, h2, n, component_id, stays`` for each row of ``docs``.

    ``stays`` marks the row that stands for its component: the one with the smallest id, and among rows of that id the one with the smaller text
    hashes. Rows that are alike in id and text are all marked.
    """
    sketches = sketched(docs, size, key, text)
    filled = sketches.where("n > 0")
    least = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h1", "h2")
    by_set = filled.groupBy("k1", "k2").agg(F.min(least).alias("least"), F.first("n").alias("n"), F.first("registers").alias("registers"))
    classes = written(by_set.withColumn("id", F.monotonically_increasing_id()), "classes")

    members = written(banded(classes, band_rows(percent / 100)), "bands")
    shared = written(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("g")).where("g > 1"), "shared")
    members = written(members.join(shared, "bucket"), "members")
    # an original shares more buckets than its copies share among each other
    support = members.groupBy("id").agg((F.least(F.sum("g"), F.lit(1 << 30)) * (1 << 32) + F.pmod(F.xxhash64("id"), F.lit(1 << 32))).alias("support"))
    hubs = written(members.join(support, "id").groupBy("bucket").agg(F.max_by("id", "support").alias("hub")), "hubs")
    candidates = written(classes.join(members.select("id").distinct(), "id", "left_semi").select("id", "n", "registers", "least"), "candidates")
    wanted = candidates.select("id", "least.doc_id", "least.h1", "least.h2")
    rows = docs.select(*_row_key(key, text), F.col(text).alias("t"))
    texts = written(rows.alias("d").join(wanted.alias("w"), _same_row("d", "w")).select("w.id", "d.t"), "texts")
    if texts.count() > wanted.count():  # a repeated row has its text repeated
        texts = written(texts.groupBy("id").agg(F.first("t").alias("t")), "texts")

    # first one hub for each class: the one it shares most buckets with
    met = members.join(hubs, "bucket").where("id <> hub").groupBy("id", "hub").agg(F.count(F.lit(1)).alias("shared"))
    first = met.groupBy("id").agg(F.max_by("hub", F.struct("shared", -F.col("hub"))).alias("hub"))
    tested = written(_estimated(first.select(F.col("hub").alias("a"), F.col("id").alias("b")), candidates, percent), "pairs")
    links = written(_verified(tested, texts, size, percent), "confirmed")
    found = written(components(links), "components")

    # then whatever could still join different components
    rest = written(_mixed_only(_placed(members, found)).select("id", "component").distinct(), "rest")
    before = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = _prefix_pairs(rest, texts, size, percent).join(before, ["a", "b"], "left_anti")
    pairs = written(_estimated(pairs, candidates, percent), "pairs")
    more = written(_verified(pairs, texts, size, percent), "confirmed")
    if not more.isEmpty():
        found = written(components(links.unionByName(more)), "components")

    placed = written(_placed(classes.select("id", "k1", "k2", "least"), found), "placed")
    first_row = written(placed.groupBy("component").agg(F.min("least").alias("first")), "first-rows")
    answer = written(placed.join(first_row, "component").select("k1", "k2", "first"), "answer")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h1", "h2")
    linked = filled.join(answer, ["k1", "k2"]).select("doc_id", "h1", "h2", "n", F.col("first.doc_id").alias("component_id"), row.eqNullSafe(F.col("first")).alias("stays"))
    alone = sketches.where("n = 0").select("doc_id", "h1", "h2", "n", F.col("doc_id").alias("component_id"), F.lit(True).alias("stays"))
    return linked.unionByName(alone)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs``; kept is ``doc_id = component_id`` (null equals null)."""
    rows = grouped(docs, size, percent, key, text)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component, and all rows without words; columns and their order stay.

    Of rows that are alike in id and text one stays, whichever is met first where they differ in other columns.
    """
    rows = grouped(docs, size, percent, key, text)
    marks = rows.where("n > 0").groupBy("doc_id", "h1", "h2").agg(F.max("stays").alias("stays"), F.count(F.lit(1)).alias("copies"))
    marks = written(marks.where("not stays or copies > 1"), "marks")
    d = docs.select(F.struct("*").alias("_row"), *_row_key(key, text)).alias("d")
    once = d.join(marks.alias("m"), _same_row("d", "m"), "left_anti").select("_row.*")
    repeated = marks.where("stays")
    if repeated.isEmpty():
        return once
    alike = d.join(repeated.alias("m"), _same_row("d", "m"), "left_semi").dropDuplicates(["doc_id", "h1", "h2"])
    return once.unionByName(alike.select("_row.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)

"""Ranked lexical search against brute force, ties and odd rows, and that the bounds leave nodes closed."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def fold(text):
    return [re.sub("[A-Z]", lambda m: m.group().lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, k):
    """All documents scored for each item; as a multiset of rows, since repeated items repeat theirs."""
    counted = [(i, c, sum(c.values())) for i, t in docs for c in [Counter(fold(t))] if c]
    n_docs, length = len(counted), sum(n for *_, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for ident, c, n in counted:
            m = 100 - 75 + (75 * n * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in fold(text) if c[t])
            if s > 0:
                scored.append((-s, ident is None, ident))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def run(spark, docs, items, k=10, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"block": F.lit(1), "query": F.lit("x"), "id": F.lit(3)}).repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string").withColumns({"doc_id": F.lit(9), "score": F.lit(0)})
    return sorted((tuple(r) for r in lexical.search(d, q, k, **options).select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize("options", [{}, {"block_docs": 7, "seeds": 1}, {"chunk_bytes": 60, "block_docs": 50}])
def test_ranks_equal_brute_force(spark, options):
    rng = random.Random(11)
    words = ["the", "The", "été", "Ünder", "x1", "a", "b", "zeta", "日本", "q" * 400] + [f"w{i}" for i in range(30)]
    docs = [(i, rng.choice([" ", "-", "\n", "\x7f", "_"]).join(rng.choices(words, weights=[9] * 6 + [2] * 34, k=rng.randint(0, 25)))) for i in range(220)]
    docs += [(None, "été zeta"), (None, None), (500, None), (501, ""), (502, "?!"), (7, "zeta zeta"), (7, "zeta zeta"), (503, "the w1 " * 30_000)]
    docs += [(1000 + i, "the same text zeta x1") for i in range(60)]  # ties: many copies
    items = [(1, "the été zeta ZETA"), (2, "same text"), (3, None), (4, ""), (5, "nowhere"), (6, "x1 X1 x1 w3"), (6, "日本 ünder"), (None, "w5"), (8, "the"), (9, "Ünder")]
    assert run(spark, docs, items, 10, **options) == brute(docs, items, 10)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a")]) == [] == run(spark, [(1, "a")], [])
    assert run(spark, [(1, None)], [(1, "a")]) == []


def tree_of(texts, queries):
    docs = [Counter(t) for t in texts]
    vocabulary = {t: i for i, t in enumerate(sorted({t for c in docs for t in c}))}
    flat = [(vocabulary[t], n) for c in docs for t, n in c.items()]
    term, tf = np.array(flat, "<i4").T
    row = {"ids": np.arange(len(docs), dtype="<i8"), "known": np.ones(len(docs), "u1"), "lengths": np.array([sum(c.values()) for c in docs], "<i8"), "counts": np.array([len(c) for c in docs], "<i4"), "terms": term, "tfs": tf}
    df = Counter(t for c in docs for t in c)
    weights = np.array([math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * df[t] + 1))) for t in vocabulary], np.int64)
    block = lexical.Block({k: v.tobytes() for k, v in row.items()}, lexical.Scale(len(docs), sum(map(len, texts)), weights))
    return block, [(np.array([vocabulary[t] for t in q]), weights[[vocabulary[t] for t in q]]) for q in queries]


def test_bounds_hold_and_leave_most_nodes_closed():
    rng = random.Random(2)
    texts = [rng.choices([f"common{i}" for i in range(40)], k=30) + ([f"rare{i // 16}"] * 3 if i % 16 == 3 else []) for i in range(2048)]
    block, queries = tree_of(texts, [["rare5", "common1"], ["common1", "common2"]])
    assert [level.shape[1] for level in block.levels] == [128, 8, 1]
    for below, above in zip(block.levels, block.levels[1:], strict=False):
        assert (np.repeat(above, lexical.FAN, axis=1)[:, : below.shape[1]] >= below).all()
    for (q, w), most in zip(queries, (20, 137), strict=True):
        dense = np.zeros(len(block.present), np.int64)
        dense[np.searchsorted(block.present, q)] = w
        scores = np.concatenate([block.leaf(n, dense)[1] for n in range(128)])
        best: list = []
        opened = block.search(q, w, 1, best, 0)
        assert best == [(-int(scores.max()), False, int(scores.argmax()))] and opened <= most
        assert block.search(q, w, 1, [], int(scores.max()) + 1) <= 1 + opened  # a floor that nothing reaches
        at_floor: list = []
        block.search(q, w, 3, at_floor, int(scores.max()))
        assert at_floor[0] == best[0]  # equal to the floor: opened


def test_only_blocks_whose_bound_reaches_the_floor_are_searched(spark):
    texts = [f"filler{i % 50} word word" + (" needle needle" if i in (700, 705) else " needle " + "pad " * 60 if i % 200 == 0 else "") for i in range(1000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    queries = lexical.asked([(1, "needle")])
    index = lexical.written(lexical.blocks(docs, queries.vocabulary, 1), "test-blocks")
    of = lexical.scale(index, 1)
    tops = {r.block: r.bound for r in lexical.bounds(index, queries, of).collect()}
    assert len(tops) == 7 and sorted(tops.values())[-2] > 2 * sorted(tops.values())[0]
    floor = sorted(tops.values())[-2]
    pairs = spark.createDataFrame([(b, 0) for b in tops], "block long, query long")
    got = lexical.found(index, pairs, queries, of, 2, {0: floor}).collect()
    assert sorted(r.doc_id for r in got) == [700, 705]


def test_documents_that_copy_an_item_come_first(spark):
    sf = "/root/testdata/sf0.001"
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    planted = items.select((F.col("item_id") + 10_000).alias("doc_id"), "text")
    got = lexical.search(docs.union(planted), items, 1).collect()
    by = defaultdict(set)
    for r in got:
        by[r.item_id].add(r.doc_id - 10_000)
    assert sum(by[i] == {i} for i in by) >= 0.9 * len(by)

"""The vector index and the joins on it against brute force, and how much they leave unread."""

from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.operators import similarity, vector_index


def unit(x):
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-300)


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(24, 16))
    return (centres[rng.integers(0, 24, 2400)] * 4 + rng.normal(size=(2400, 16)) * 0.25).round(3)


def table(spark, x, odd=()):
    rows = [(i, ["a", "b", None][i % 3], v.tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame([*rows, *odd], "id long, label string, embedding array<double>").repartition(4)


ODD = [(9001, "a", None), (9002, "a", []), (9003, "a", [1.0] * 3), (9004, "a", [float("nan")] * 16), (9005, "a", [0.0] * 16), (None, "a", [1.0] * 16), (9006, "a", [None] * 16)]


def brute(x, queries, k, keep=None):
    u = unit(x)
    out = []
    for q in queries:
        scores = u @ u[q]
        best = sorted((-round(float(s), 9), i) for i, s in enumerate(scores) if keep is None or keep(i))[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return out


def rounded(rows):
    return sorted((r.query_id, r["rank"], r.id, round(r.score, 9)) for r in rows.collect())


def test_answers_are_exact_and_most_cells_stay_closed(spark, tmp_path, clustered):
    df = table(spark, clustered, ODD)
    index = vector_index.build(df, str(tmp_path / "index"), 16, label="label")
    asked = df.where("id % 100 = 0 and id < 9000").select(F.col("id").alias("query_id"), "embedding")
    for label, keep in ((None, None), ("b", lambda i: i % 3 == 1)):
        found = vector_index.search(vector_index.opened(spark, index.path), asked, 7, label=label)
        got = [r for r in rounded(found.rows) if r[2] < 9000]
        assert got == sorted(brute(clustered, range(0, 2400, 100), 7, keep))
        read = found.read.groupBy("query_id").count().agg(F.avg("count")).first()[0]
        cells = spark.read.parquet(f"{index.path}/cells").select("cell").distinct().count()
        assert cells >= 20 and read <= 0.2 * cells
    folders = {p.name for p in (tmp_path / "index" / "blocks").iterdir() if p.name.startswith("cell=")}
    assert len(folders) == cells


def test_added_rows_ties_and_thresholds(spark, tmp_path, clustered):
    x = np.concatenate([clustered[:300], clustered[:300]])  # every vector twice: ties go to the smaller id
    df = table(spark, x)
    index = vector_index.build(df.where("id < 200"), str(tmp_path / "index"), 16)
    vector_index.add(index, df.where("id >= 200"))
    asked = df.where("id in (0, 250, 599)").select(F.col("id").cast("string").alias("query_id"), "embedding")
    got = rounded(vector_index.search(index, asked, 4).rows)
    assert got == sorted((str(q), r, i, s) for q, r, i, s in brute(x, (0, 250, 599), 4))
    some = rounded(vector_index.search(index, asked, 50, least=0.9).rows)
    assert some == sorted((str(q), r, i, s) for q, r, i, s in brute(x, (0, 250, 599), 50) if s >= 0.9)
    zero = spark.createDataFrame([(1, [0.0] * 16), (2, [1.0, 2.0]), (3, None)], "query_id long, embedding array<double>")
    assert rounded(vector_index.search(index, zero, 2).rows) == [(1, 1, 0, 0.0), (1, 2, 1, 0.0)]


def test_an_empty_index(spark, tmp_path):
    df = spark.createDataFrame([], "id long, label string, embedding array<double>")
    index = vector_index.build(df, str(tmp_path / "index"), 4)
    assert vector_index.search(index, df.select(F.col("id").alias("query_id"), "embedding"), 3).rows.collect() == []
    assert similarity.similar_pairs(df, 0.5).collect() == []


def brute_pairs(x, threshold, same=lambda i, j: True):
    s = unit(x) @ unit(x).T
    return sorted((i, j) for i, j in zip(*np.nonzero(s >= threshold), strict=True) if i < j and same(i, j))


def test_pairs_meet_only_in_near_cells(spark, tmp_path, clustered):
    df = table(spark, clustered, ODD[:1] + [(9007, "a", [1.0, 0.0]), (9008, "a", [2.0, 0.0])])
    got = sorted((r.a, r.b) for r in similarity.similar_pairs(df, 0.95).collect())
    assert got == [*brute_pairs(clustered, 0.95), (9007, 9008)]
    index = vector_index.build(df, str(tmp_path / "index"), 16)
    sizes = {r.cell: r.n for r in spark.read.parquet(f"{index.path}/cells").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    met = sum(sizes[r.cell] * sizes[r.other] for r in vector_index.cell_pairs(index, spark, 0.95).collect())
    assert met <= 0.2 * 2400**2 / 2


def test_pairs_in_blocks_of_any_size(spark, clustered):
    df = table(spark, clustered).withColumn("m", F.when(F.col("id") < 1500, F.lit(None)).otherwise((F.col("id") % 97).cast("string")))
    block = lambda i: None if i < 1500 else str(i % 97)
    got = sorted((r.a, r.b) for r in similarity.similar_pairs(df, 0.9, ["m"], block_rows=400).collect())
    assert got == brute_pairs(clustered, 0.9, lambda i, j: block(i) == block(j))


def test_many_small_blocks_take_few_tasks(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(20_000, 8)).round(3)
    df = spark.createDataFrame([(i, f"m{i % 2000}", v.tolist()) for i, v in enumerate(x)], "id long, m string, embedding array<double>")
    start = time.time()
    got = {(r.a, r.b) for r in similarity.similar_pairs(df, 0.8, ["m"]).collect()}
    assert time.time() - start < 120  # hours with a Python group for each pair of groups of each block
    u = unit(x)
    assert got == {(i, j) for i in range(2000) for i in range(i, 20_000, 2000) for j in range(i + 2000, 20_000, 2000) if u[i] @ u[j] >= 0.8}

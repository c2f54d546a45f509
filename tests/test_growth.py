"""Work and memory that grow no faster than the input: results beside plain forms, and the quantities that used to grow."""

from __future__ import annotations

import hashlib
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillgraph.functions import chunking
from quillgraph.operators import graph, hierarchy, quality, similarity, vector_index


def test_visible_rows_are_counted_without_listing_them(spark):
    roles, departments, subjects = ("staff", "admin", "student", None), ("d1", "d2", "d9", None), (["s1"], ["s1", "s3", "s3"], ["s7", None], [], None)
    cases = list(product(roles, departments, subjects))
    users = spark.createDataFrame([(None if i % 17 == 0 else f"u{i % 29}", *c) for i, c in enumerate(cases)], "uid string, role string, department_id string, subject_ids array<string>")
    table = [("x", "s1", "d1"), ("x", "s1", "d2"), ("y", "s2", "d2"), ("y", "s2", "d2"), ("z", "s3", None), ("w", "s3", "d1"), (None, "s1", "d1"), (None, "s7", None), ("v", None, "d2")]
    rows = spark.createDataFrame(table, "id string, subject_id string, department_id string")
    expected = hierarchy.visible(users, rows).groupBy("uid").agg(F.count("id").alias("n"))
    assert sorted(map(str, hierarchy.visible_counts(users, rows).collect())) == sorted(map(str, expected.collect()))


def test_many_staff_of_a_large_department(spark):
    """400 million visible rows, of which none is made."""
    users = spark.range(20_000).select(F.concat(F.lit("u"), "id").alias("uid"), F.lit("staff").alias("role"), F.lit("d").alias("department_id"), F.array(F.concat(F.lit("r"), "id")).alias("subject_ids"))
    rows = spark.range(20_000).select(F.concat(F.lit("r"), "id").alias("id"), F.concat(F.lit("r"), "id").alias("subject_id"), F.lit("d").alias("department_id"))
    assert [tuple(r) for r in hierarchy.visible_counts(users, rows).groupBy("n").count().collect()] == [(20_000, 20_000)]


def test_shapes_of_a_tree_are_those_of_the_nested_one(spark):
    """Also with ties, missing values, and rows whose parents are not there."""
    tables = {
        "departments": spark.createDataFrame([("d1", "One"), ("d2", "Two"), ("d3", "None")], "id string, name string"),
        "semesters": spark.createDataFrame([(f"t{i}", "s", i % 3, "d1" if i % 2 else "d2") for i in range(7)] + [("lost", "s", 1, "d9")], "id string, name string, semester_number int, department_id string"),
        "subjects": spark.createDataFrame([(f"s{i}", f"n{i % 5}", "c", None if i % 11 == 0 else f"t{i % 5}") for i in range(60)], "id string, name string, code string, semester_id string"),
        "modules": spark.createDataFrame([(f"m{i}", "x", None if i % 13 == 0 else i % 4, f"s{i % 70}") for i in range(200)], "id string, name string, module_number int, subject_id string"),
        "notes": spark.createDataFrame([(f"k{i}", "t", f"m{i % 150}", i % 6) for i in range(500)], "id string, title string, module_id string, t int").withColumn("created_at", F.timestamp_seconds("t")).drop("t"),
    }

    def text(rows, sep, part):
        return sep.join(part(r) for r in rows or [])

    def subject(s):
        return f"{s.id}({text(s.children, ',', lambda m: f'{m.id}[' + text(m.children, ';', lambda n: n.id) + ']')})"

    expected = {d.id: d.children and text(d.children, ",", lambda t: f"{t.id}:" + hashlib.md5(text(t.children, ",", subject).encode()).hexdigest()) for d in hierarchy.tree(tables).collect()}
    assert {r.id: r.shape for r in hierarchy.tree_shapes(tables).collect()} == expected
    found = hierarchy.semester_shapes(tables)
    assert {r.id: r.subjects for r in found.collect()} == {r.semester_id: r["count"] for r in tables["subjects"].where("semester_id is not null").groupBy("semester_id").count().collect()}


def test_links_hang_the_same_rows_together(spark, tmp_path, monkeypatch):
    """Of 1,000 copies, clusters, a zero vector and lone ones; a row goes to a bounded number of tasks."""
    monkeypatch.setattr(vector_index, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(4)
    x = np.vstack([np.tile(rng.normal(size=(1, 8)), (1000, 1)), rng.normal(size=(1500, 8)), np.zeros((1, 8))]).round(4)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    near = u @ u.T >= 0.9
    index = vector_index.build(df, str(tmp_path / "index"), 8)
    pairs = vector_index.close_pairs(index, spark, 0.9)
    assert pairs.count() == (near.sum() - near.trace()) // 2 and pairs.distinct().count() == pairs.count()
    links = {(r.a, r.b) for r in vector_index.close_links(index, spark, 0.9).collect()}
    assert all(a < b and near[a, b] for a, b in links)
    cells, tiles = vector_index._tiles(index, spark, 0.9)
    assert len({t for t, _, _ in tiles}) <= 2 * vector_index.TILES and len(links) <= len(x) * len({t for t, _, _ in tiles})
    label = np.arange(len(x))
    while (least := np.minimum(label, np.where(near, label[None, :], len(x)).min(1))).tolist() != label.tolist():
        label = least
    got = {r.id: r.component for r in graph.connected_components(vector_index.close_links(index, spark, 0.9)).collect()}
    assert [got.get(i, i) for i in range(len(x))] == label.tolist()


def test_contexts_of_a_large_component_are_its_first(spark):
    rows = [(i, "n", None, 0.5, [None, "", f"context {i}", "x"][i % 4], 1, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, name string, definition string, confidence double, context string, mention_count long, ord long")
    pairs = spark.range(2999).select(F.lit(0).cast("long").alias("a"), (F.col("id") + 1).alias("b"))
    kept, aliases = similarity.merged_entities(df, pairs)
    assert [(r.id, r.context, r.mention_count) for r in kept.collect()] == [(0, " ... ".join(r[4] for r in rows if r[4])[:500], 3000)]
    assert aliases.where("canonical_id = 0").count() == 3000
    assert similarity.merged_entities(df, pairs, contexts=2)[0].first().context == "context 2 ... x"


def test_chunks_are_given_on_in_slices(spark, monkeypatch):
    """The operators' chunks are those of the functions, whatever the slices; no batch holds much more than a slice."""
    monkeypatch.setattr(chunking, "SLICE_CHARS", 20_000)
    texts = ["One two. Three four!\n" * 900, None, "", "x" * 30_000, "word " * 4000, "Alpha beta. " * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)

    def expected(function):
        return [(i, *c.values()) for i, t in enumerate(texts) for c in function(t or "")]

    assert sorted(map(tuple, chunking.parent_child_rows(df, "id").collect())) == sorted(expected(chunking.parents_and_children))
    assert sorted(map(tuple, chunking.section_rows(df, "id").collect())) == sorted(expected(chunking.section_chunks))
    found = chunking.entity_rows(df, "id", F.array(F.lit("two"), F.lit("Alpha beta"))).select("id", "idx", "text", "token_count", "kind", "entities", "primary_entity").collect()
    assert sorted(map(tuple, found), key=lambda r: r[:2]) == expected(lambda t: chunking.entity_chunks(t, ["two", "Alpha beta"]))
    assert {r.id: r.batches for r in chunking.batch_rows(df, "id").collect()} == {i: chunking.batches([p.strip() for p in (t or "").split("\n") if p.strip()]) for i, t in enumerate(texts)}
    plain = df.select("id", chunking.chunk_by_regex_sentences("text").alias("c")).select("id", F.posexplode(chunking.resize_chunks("c", F.transform("c", lambda y: F.substring(y, 1, 5)))).alias("idx", "p"))
    assert sorted(map(tuple, chunking.regex_rows(df, "id", lambda y: F.substring(y, 1, 5)).collect())) == sorted(map(tuple, plain.select("id", "idx", "p.text", "p.description").collect()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000))], names=["id"])
    slices = list(chunking._sliced(iter([batch]), lambda i: [(i, "y" * 1000)], pa.schema([("id", pa.int64()), ("text", pa.string())])))
    assert sum(x.num_rows for x in slices) == 1000 and max(x.num_rows for x in slices) == 20


def test_edges_are_counted_before_documents_meet_them(spark):
    """300 documents share an entity of 3,000 edges of two types: 900,000 rows if each met each."""
    chunks = spark.range(300).select(F.col("id"), F.when(F.col("id") != 7, F.col("id")).alias("document_id"))
    mentions = spark.range(300).select(F.col("id").alias("chunk_id"), F.lit("e").alias("entity_id"))
    edges = spark.range(3000).select(F.lit("e").alias("src_id"), F.when(F.col("id") % 3 == 0, "USES").alias("type"))
    found = quality.document_relations(chunks, mentions, edges)
    assert sorted(map(str, found.groupBy("type", "n").agg(F.count(F.lit(1)), F.count("document_id")).collect())) == sorted(["Row(type='USES', n=1000, count(1)=300, count(document_id)=299)", "Row(type=None, n=2000, count(1)=300, count(document_id)=299)"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in plan[plan.index("Join") :]


def test_paths_write_only_what_lies_near_their_seeds(spark, monkeypatch):
    """A graph of 3,000 edges far from the seed, and three near it."""
    written = []
    settled = graph.settled
    monkeypatch.setattr(graph, "settled", lambda df: (out := settled(df), written.append(out.count()))[0])
    near = [("a", "b", "USES"), ("b", "c", "USES"), ("c", "a", "EXTENDS")]
    edges = spark.createDataFrame([*near, *((f"x{i}", f"x{i + 1}", "USES") for i in range(3000))], "src_id string, dst_id string, type string").withColumn("confidence", F.lit(0.5))
    nodes = spark.createDataFrame([(x, "m1") for x in "abc"] + [(f"x{i}", "m2") for i in range(3001)], "id string, module_id string")
    for modules in (None, ["m1"]):
        found = graph.paths(nodes, edges, ["a"], 2, modules)
        assert [(r.hops, [s.other for s in r.steps]) for r in found.orderBy("rank").collect()] == [(1, ["b"]), (1, ["c"]), (2, ["b", "c"]), (2, ["c", "b"])]
    assert written and max(written) < 10


def _reached(pairs):
    least = {x: x for p in pairs for x in p}
    while moved := [(x, y) for a, b in pairs for x, y in ((a, least[b]), (b, least[a])) if y < least[x]]:
        for x, y in moved:
            least[x] = min(least[x], y)
    return least


def test_components_read_all_pairs_in_the_first_round_alone(spark, monkeypatch):
    """30 suppliers of 2,000 parts in three copies, a star and a chain: rows written, where each of the old rounds read all links again in both ways."""
    pairs = [(f"{c}s{i * 7 % 30}", f"{c}p{i % 2000}") for c in range(3) for i in range(20_000)] + [("hub", f"h{i}") for i in range(3000)] + [(f"c{i}", f"c{i + 1}") for i in range(300)]
    written = []
    settled = graph.settled
    monkeypatch.setattr(graph, "settled", lambda df: (out := settled(df), written.append(out.count()))[0])
    got = graph.connected_components(spark.createDataFrame(pairs, "a string, b string")).collect()
    assert len(got) == len({r.id for r in got}) and {r.id: r.component for r in got} == _reached(pairs)
    nodes = len(got)
    # the pairs once, and nodes a few times, less in each round
    assert written[0] == len(pairs) and max(written[1:]) == nodes and sum(written[1:]) < 6 * nodes


def test_components_of_odd_pairs(spark, monkeypatch):
    """Missing ends, loops, numbers of two types as ids, no pairs; and ids whose first numbers collide."""
    def components(rows, schema):
        return {r.id: r.component for r in graph.connected_components(spark.createDataFrame(rows, schema)).collect()}

    odd = [("a", None), (None, "b"), (None, None), ("c", "c"), ("d", "e"), ("e", "d"), ("d", "e"), ("e", "e"), ("", "f")]
    assert components(odd, "a string, b string") == {"c": "c", "d": "d", "e": "d", "": "", "f": ""}
    assert components([("c", "c")], "a string, b string") == {"c": "c"}
    assert components([], "a string, b string") == {} and components([("c", None)], "a string, b string") == {}
    assert components([(3, 2**40), (5, 3), (-1, 9)], "a int, b long") == {3: 3, 5: 3, 2**40: 3, -1: -1, 9: -1}
    number, tried = graph._number, set()
    monkeypatch.setattr(graph, "_number", lambda node, seed: (tried.add(seed), F.pmod(number(node, seed), F.lit(7)) if seed == 0 else number(node, seed))[1])
    pairs = [(f"n{i}", f"n{i + 3}") for i in range(40)]
    assert components(pairs, "a string, b string") == _reached(pairs) and 1 in tried


def test_queries_of_an_index_do_not_pass_the_driver(spark, tmp_path, monkeypatch):
    plans = []
    settled = vector_index.settled
    monkeypatch.setattr(vector_index, "settled", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), settled(df))[1])
    df = spark.range(300).select("id", F.array(F.sin("id"), F.cos("id"), F.sin(F.col("id") * 3)).alias("embedding"))
    index = vector_index.build(df, str(tmp_path / "index"), 3)
    found = vector_index.search(index, df.where("id % 10 = 0").withColumnRenamed("id", "query_id"), 3).rows
    assert found.where("rank = 1 and id = query_id").count() == 30
    scans = [p for p in plans if "q_vectors" in p]
    assert len(scans) == 2 and all("SortMergeJoin" in p and "BroadcastHashJoin" not in p for p in scans)

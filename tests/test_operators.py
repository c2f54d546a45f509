"""Golden values and invariants of single operators."""

from __future__ import annotations

import io
import sys
import zipfile
from datetime import UTC, date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph import model
from quillgraph.functions import chunking, vectors
from quillgraph.functions import text as x
from quillgraph.operators import graph, hierarchy, layout, quality, similarity, store, telemetry, templates, trends
from quillgraph.sources import documents, export, json_store
from quillgraph.streaming import telemetry as streaming


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("v")).first().v


@pytest.mark.parametrize(("numbers", "expected"), [([1, 2, 3], 4), ([1, 3, 5], 6), ([1, 100], 101), ([-1, 0, 2, 3], 4)])
def test_next_number(spark, numbers, expected):
    df = spark.createDataFrame([("k", n) for n in numbers], "k string, n int")
    assert hierarchy.next_number(df, "n", ["k"]).first().next == expected
    assert hierarchy.next_number(df.limit(0), "n", []).first().next == 1


@pytest.mark.parametrize(("codes", "expected"), [([], "SUBJ001"), (["SUBJ001", "SUBJ003"], "SUBJ004"), (["OTHER001", "OTHER002"], "SUBJ001")])
def test_next_code(spark, codes, expected):
    assert hierarchy.next_code(spark.createDataFrame([(c,) for c in codes], "code string"), "code", "SUBJ", []).first().next == expected


@pytest.mark.parametrize(("names", "expected"), [([], "Note"), (["Note"], "Note (2)"), (["Note", "Note (2)"], "Note (3)"), (["Note (9)"], "Note"), (["Note", "Note (x)", "My Note (7)"], "Note (2)")])
def test_unique_name(spark, names, expected):
    assert hierarchy.unique_name("Note", spark.createDataFrame([(n,) for n in names], "t string"), "t").first().name == expected


def test_date_ranges():
    now = datetime(2026, 6, 1, 12, tzinfo=UTC)
    assert telemetry.normalise_range(None, date(2026, 5, 16), now) == (datetime(2026, 5, 2, 12, tzinfo=UTC), datetime(2026, 5, 16, 23, 59, 59, 999999, tzinfo=UTC))
    assert telemetry.normalise_range(None, datetime(2026, 5, 16, 14, 30), now)[1] == datetime(2026, 5, 16, 14, 30, tzinfo=UTC)
    assert telemetry.normalise_range(date(2026, 5, 1), None, now) == (datetime(2026, 5, 1, tzinfo=UTC), now)
    aware = datetime(2026, 5, 16, tzinfo=UTC)
    assert telemetry.normalise_range(None, aware, now)[1] == aware
    assert telemetry.preset_range(7, date(2026, 5, 8)) == (date(2026, 5, 1), date(2026, 5, 8))
    with pytest.raises(ValueError):
        telemetry.preset_range(8, date(2026, 5, 8))


def test_text_goldens(spark):
    assert one(spark, x.n_tokens(F.col("t")), t="a  b c") == 3
    assert one(spark, x.chunk_label(F.col("t")), t="Thermodynamics basics. More text here.") == "Thermodynamics basics"
    assert one(spark, x.chunk_label(F.col("t")), t="A" * 100 + ". Second sentence.") == "A" * 60 + "..."
    assert one(spark, x.chunk_label(F.col("t")), t="no period") == "no period"
    assert one(spark, x.salvage_array(F.col("t")), t='Here are labels: [["A"], ["B"]] done.') == [["A"], ["B"]]
    for bad in ("no json here", '[["unclosed', "[]"):
        assert one(spark, x.salvage_array(F.col("t")), t=bad) == []
    assert x.split_sentences("Dr. Smith went home. He was tired.") == ["Dr. Smith went home.", "He was tired."]
    assert x.split_sentences("It is 3.14 today! no. lower. Yes?") == ["It is 3.14 today!", "no. lower.", "Yes?"]
    assert one(spark, x.normalise("t"), t="ﬁne \x07 \n text") == "fine text"
    assert one(spark, x.capitalised_terms(F.col("t")), t="The Big Bang met Einstein and the Big Bang") == ["Big Bang", "Einstein"]
    assert one(spark, vectors.deterministic_embedding(F.col("t")), t="a")[:5] == [0.97, 0.98, 0.99, 1.0, 0.0]
    assert one(spark, vectors.deterministic_embedding(F.col("t")), t=" ") == []


def test_word_windows_cover_the_text(spark):
    words = [f"w{i}" for i in range(2345)]
    got = one(spark, x.word_windows(F.col("t")), t=" ".join(words))
    assert [w.split()[0] for w in got] == ["w0", "w700", "w1400", "w2100"] and got[-1].split()[-1] == "w2344"
    assert one(spark, x.word_windows(F.col("t")), t=" ") == [] and one(spark, x.word_windows(F.col("t")), t="a b") == ["a b"]


def test_chunkers_lose_no_word():
    text = "\n".join(" ".join(f"p{p}w{i}" for i in range(n)) + "." for p, n in enumerate([10, 900, 1700, 300, 5, 450]))
    parents = chunking.parents_and_children(text)
    assert set(" ".join(p["text"] for p in parents).split()) == set(text.split())
    assert all(set(p["text"].split()) == set(" ".join(p["children"]).split()) for p in parents)
    assert all(p["token_count"] <= 1500 for p in parents)
    sections = chunking.section_chunks("intro\n# A\none\n## B\ntwo\n# C\nthree")
    assert [s["section_path"] for s in sections] == [["Document"], ["A"], ["A", "B"], ["C"]]
    around = chunking.entity_chunks("Filler words here. " * 300 + "Entropy grows. " + "More filler follows. " * 600, ["Entropy", "absent"])
    assert [c["primary_entity"] for c in around if c["kind"] == "entity"] == ["Entropy"] and {c["kind"] for c in around} == {"entity", "background"}
    assert chunking.windows("a b c d e", 3, 1) == ["a b c", "c d e"]
    merged = chunking.resized([{"text": "w " * 300, "description": "a"}, {"text": "w " * 300, "description": "b"}, {"text": "w " * 100, "description": "c"}])
    assert [(len(m["text"].split()), m["description"]) for m in merged] == [(700, "a; b; c")]
    for f in (chunking.parents_and_children, chunking.section_chunks, chunking.regex_sentence_chunks):
        assert f("") == []


def test_path_weight_and_expansion(spark):
    assert one(spark, graph.path_weight(F.lit("USES"), F.lit(2), F.lit(None).cast("double"))) == pytest.approx(0.4)
    nodes = spark.createDataFrame([(i, "Topic", i.upper(), "m") for i in "abcd"], "id string, label string, name string, module_id string")
    edges = spark.createDataFrame([("a", "b", "USES", 0.0), ("b", "c", "DEFINES", 0.5), ("b", "a", "USES", None), ("c", "d", "ODD", 1.0)], "src_id string, dst_id string, type string, confidence double")
    got = {r.id: (r.hops, r.relevance) for r in graph.expand_context(nodes, edges, ["a"]).collect()}
    assert got == {"b": (1, 0.8), "c": (2, 0.25)}
    path = sorted(graph.shortest_path(nodes, edges, "a", "d").collect(), key=lambda r: r.step)
    assert [(r.a, r.b, r.hops, r.source_name, r.target_name) for r in path] == [("a", "b", 3, "A", "D"), ("b", "c", 3, "A", "D"), ("c", "d", 3, "A", "D")]
    assert graph.shortest_path(nodes, edges, "a", "zzz").count() == 0
    assert {r.id: r.level for r in graph.levels(nodes.union(nodes.limit(1).withColumn("id", F.lit("z"))), edges, "a").collect()} == {"a": 0, "b": 1, "c": 2, "d": 3, "z": 4}
    shown, inside = graph.preview(nodes.where("id in ('a', 'b')"), edges.withColumn("evidence", F.lit("")), "m")
    assert shown.count() == 2 and inside.count() == 2
    with pytest.raises(ValueError):
        graph.preview(nodes, edges, "m", limit=501)
    with pytest.raises(ValueError):
        graph.preview(nodes, edges, "m", ["Nothing"])


def test_relations(spark):
    rows = [("s", f"t{i:02}", "USES", 0.10 + 0.05 * i) for i in range(12)]
    df = spark.createDataFrame(rows, "source string, target string, type string, confidence double")
    assert graph.strongest_relations(df).count() == 8


def test_trends_goldens(spark):
    rows = [("n", "Topic", "m", None, datetime(2024, 1, d), d) for d in (11, 12, 13, 14, 15, 16, 1, 2, 3, 4)] + [("new", "Topic", "m", None, datetime(2024, 1, 12), 99)]
    df = spark.createDataFrame(rows, "name string, label string, module_id string, definition string, created_at timestamp_ntz, event_id long")
    (r,) = trends.trending(df, datetime(2024, 1, 11), datetime(2024, 1, 21)).collect()
    assert (r.name, r.current, r.previous, r.growth) == ("n", 6, 4, 0.5)
    day = F.lit("2026-02-04").cast("timestamp_ntz")
    assert one(spark, trends.bucket(day, "week")) == "2026-02-02" and one(spark, trends.bucket(day, "semester")) == "2026-H1"
    sets = [("a", "x"), ("b", "x"), ("c", "x"), ("b", "y"), ("c", "y"), ("d", "y")]
    sdf = spark.createDataFrame([(n, "Topic", m, None, datetime(2024, 1, 1), i) for i, (n, m) in enumerate(sets)], df.schema)
    matrix = {(r.a, r.b): r.jaccard for r in trends.jaccard_matrix(sdf, ["x", "y", "void"]).collect()}
    assert matrix["x", "y"] == matrix["y", "x"] == 0.5 and matrix["x", "x"] == 1.0 and matrix["x", "void"] == 0.0


def test_feedback_goldens(spark):
    df = spark.createDataFrame([(True, 0.8, None), (False, None, None)], "is_positive boolean, relevance_score double, helpful boolean")
    r = telemetry.feedback_stats(df).first()
    assert (r.total, r.positive_ratio, r.avg_relevance) == (2, 0.5, 0.65)
    empty = telemetry.feedback_stats(df.limit(0)).first()
    assert (empty.total, empty.positive_ratio, empty.avg_relevance) == (0, 0.0, 0.0)


def test_eviction(spark):
    now = datetime(2024, 1, 1, 1)
    jobs = spark.createDataFrame([(f"{i:03}", "completed", datetime.fromtimestamp(now.timestamp() - i)) for i in range(110)], "id string, status string, updated_at timestamp_ntz")
    left = {r.id for r in telemetry.evict(jobs, now).collect()}
    assert len(left) == 100 and not left & {f"{i:03}" for i in range(10)} and {f"{i:03}" for i in range(95, 100)} <= left
    assert {f"{i:03}" for i in range(10)} <= {r.id for r in telemetry.evict(jobs, now, keep="newest").collect()}


def test_semantic_dedupe_golden(spark):
    e = [("a", "A", "", 0.6, "first", None, 0, [1.0, 0.0]), ("b", "B", "the second", 0.9, "second", 2, 1, [1.0, 0.0]), ("c", "C", None, 0.5, "third", 1, 2, [0.0, 1.0])]
    df = spark.createDataFrame(e, "id string, name string, definition string, confidence double, context string, mention_count long, ord long, embedding array<double>")
    kept, aliases = similarity.semantic_dedupe(df)
    rows = {r.id: r for r in kept.collect()}
    assert set(rows) == {"b", "c"} and rows["b"].definition == "the second" and rows["b"].mention_count == 3 and rows["b"].context == "first ... second"
    assert {(r.id, r.canonical_id) for r in aliases.collect()} == {("a", "b"), ("b", "b"), ("c", "c")}
    assert similarity.semantic_dedupe(df.limit(2))[0].count() == 2


def test_similar_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(120, 4))
    df = spark.createDataFrame([(i, v[i].tolist()) for i in range(120)], "id long, embedding array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    expected = {(a, b) for a in range(120) for b in range(a + 1, 120) if u[a] @ u[b] >= 0.9}
    got = [(r.a, r.b) for r in similarity.similar_pairs(df, 0.9).collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    many = similarity.similar_pairs(df.unionByName(spark.createDataFrame([(900, [1.0, 2.0]), (901, [1.0, 2.0]), (902, []), (None, [1.0] * 4)], df.schema)), 0.9, block_rows=16)
    assert sorted((r.a, r.b) for r in many.collect()) == sorted([*expected, (900, 901)])


def test_components_and_paths_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    pairs = [(f"n{a}", f"n{b}") for a, b in rng.integers(0, 300, (180, 2)).tolist()] + [(f"c{i}", f"c{i + 1}") for i in range(40)]
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def hops(start):
        at, level = {start: 0}, [start]
        while level:
            level = sorted({y for x in level for y in near[x]} - set(at))
            at |= dict.fromkeys(level, max(at.values()) + 1)
        return at

    expected = {x: min(hops(x)) for x in near}
    got = graph.connected_components(spark.createDataFrame(pairs, "a string, b string"))
    assert {r.id: r.component for r in got.collect()} == expected
    edges = spark.createDataFrame([(a, b, "USES", 0.5) for a, b in pairs], "src_id string, dst_id string, type string, confidence double")
    assert {r.id: r.hops for r in graph.bfs(edges, ["c9"]).collect()} == hops("c9")
    for depth in (1, 2, 3):
        assert {r.id: r.hops for r in graph.bfs(edges, ["c9", "c9"], depth).collect()} == {x: h for x, h in hops("c9").items() if h <= depth}
    nodes = spark.createDataFrame([(x, "Topic", x, "m") for x in near], "id string, label string, name string, module_id string")
    assert graph.shortest_path(nodes, edges, "c0", "c4").count() == 4 and graph.shortest_path(nodes, edges, "c0", "c5").count() == 0


def test_relations_of_each_document_are_limited_by_themselves(spark):
    rows = [(d, f"s{i % 9}", f"t{i:03}", "USES", 0.2 + i / 200) for d in ("x", "y") for i in range(120)]
    df = spark.createDataFrame(rows, "document string, source string, target string, type string, confidence double")
    got = graph.strongest_relations(df, document="document").collect()
    for d in ("x", "y"):
        top = [r for s in range(9) for r in sorted((r for r in rows if r[0] == d and r[1] == f"s{s}"), key=lambda r: -r[4])[:10] if r[4] >= 0.3]
        assert sorted((r.source, r.target) for r in got if r.document == d) == sorted((r[1], r[2]) for r in sorted(top, key=lambda r: (-r[4], r[1], r[2]))[:50])


def test_fuzzy_matching_rules(spark):
    mentions = spark.createDataFrame([(1, m) for m in ("Neural Network", "network", "SVM", "Xyz", "bckprp")], "doc_id int, mention string")
    entities = spark.createDataFrame([(1, i, n, i) for i, n in enumerate(["neural network", "Support Vector Machine", "Backpropagation"])], "doc_id int, id int, name string, ord int")
    assert {r.mention: (r.id, r.rule) for r in similarity.fuzzy_match(mentions, entities).collect()} == {"Neural Network": (0, 1), "network": (0, 2), "SVM": (1, 3), "bckprp": (2, 4)}


def test_templates(spark):
    text = "# Abstract\nWe study things.\n# Introduction\nThings matter.\n# Methodology\nWe looked.\n# Results\nWe saw.\n# References\n[1]"
    df = spark.createDataFrame([(1, text), (2, "short"), (3, "plain prose without any headings whatsoever, yet of a certain length")], "id int, text string")
    got = {r.id: r for r in templates.detect(df, "id").collect()}
    assert got[1].template == "research_paper" and got[1].score > 0.6 and (got[2].template, got[2].score) == ("generic", 0.0) and (got[3].template, got[3].score) == ("generic", 0.2)
    paper = next(t for t in templates.TEMPLATES if t.name == "research_paper")
    found = {(r.section, r.start, r.end, r.confidence) for r in templates.sections(df.where("id = 1"), "id", paper).collect()}
    assert ("Abstract", 0, 2, 0.9) in found and ("Results", 6, 10, 0.9) in found
    assert {(r.section, r.confidence) for r in templates.sections(df.where("id = 3"), "id", paper).collect()} == {("Abstract", 0.5)}
    assert one(spark, F.round(templates.quality(F.lit(3), F.lit(5), F.lit(1), F.lit(4), F.lit(0.8)), 6)) == 0.56


def test_rbac_truth_table(spark):
    rows = spark.createDataFrame([("x", "s1", "d1"), ("y", "s2", "d2"), ("z", None, None)], "id string, subject_id string, department_id string")

    def seen(*a):
        return {r.id for r in rows.where(hierarchy.may_read(*a)).collect()}

    assert seen("admin") == {"x", "y", "z"} and seen("staff", ["s1"]) == {"x"} and seen("staff", [], "d2") == {"y"} and seen("student", ["s1"], "d1") == set()


def test_batches_and_cascades(spark):
    notes = spark.createDataFrame([("a", "m", "ready"), ("b", "m", None), ("c", "n", "ready")], "id string, module_id string, kg_status string")
    asked = spark.createDataFrame([(i, "m") for i in "abcx"], "id string, module_id string")
    assert {r.id: r.decision for r in hierarchy.batch_intake(asked, notes).collect()} == {"a": "skipped", "b": "queued", "c": "dropped", "x": "dropped"}
    assert {r.id: r.reason for r in hierarchy.batch_delete(asked, notes).collect()} == {"a": None, "b": "not ready", "c": "other module", "x": "not found"}
    assert one(spark, hierarchy.cascade_status(F.lit("ready"), F.lit(False))) == "kg_failed"


def test_upsert_is_idempotent_and_keeps_creation(spark):
    old = spark.createDataFrame([("a", "x", datetime(2020, 1, 1))], "id string, v string, created_at timestamp_ntz")
    new = spark.createDataFrame([("a", "y"), ("b", None)], "id string, v string")
    now = F.lit("2024-01-01").cast("timestamp_ntz")
    once = store.upsert(old, new, now)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, store.upsert(once, new, F.lit("2025-01-01").cast("timestamp_ntz")).collect())) == [("a", "y", datetime(2020, 1, 1)), ("b", None, datetime(2024, 1, 1))]
    assert store.upsert(old, spark.createDataFrame([("a", None)], "id string, v string"), now, merge=True).first().v == "x"


def test_document_store(spark, tmp_path):
    rows = [("departments/d1", '{"name": "D", "meta": {"n": 1}}'), ("departments/d1/semesters/s1", '{"name": "S"}'), ("departments/d2/semesters/s2", "{}")]
    spark.createDataFrame(rows, "path string, data string").write.json(str(tmp_path / "store"))
    s = json_store.load(spark, str(tmp_path / "store"))
    json_store.save(s, str(tmp_path / "copy"))
    s = json_store.load(spark, str(tmp_path / "copy"))
    assert {r.id for r in json_store.collection(s, "departments").collect()} == {"d1"}
    assert {r.id for r in json_store.collection_group(s, "semesters").collect()} == {"s1", "s2"}
    assert [r.name for r in json_store.subcollections(s, "departments/d2").collect()] == ["semesters"]
    assert json_store.document(s, "departments/d1").select(json_store.field(F.col("data"), "meta.n", "int").alias("n")).first().n == 1


def docx():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'

    def p(text, style=""):
        return f'<w:p>{f"""<w:pPr><w:pStyle w:val="{style}"/></w:pPr>""" if style else ""}<w:r><w:t>{text}</w:t></w:r></w:p>'

    body = p("Title", "Heading1") + p("Body text") + f"<w:tbl><w:tr><w:tc>{p('k')}</w:tc><w:tc>{p('v')}</w:tc></w:tr><w:tr><w:tc>{p('1')}</w:tc><w:tc>{p('2')}</w:tc></w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def test_document_sources(spark, tmp_path):
    for name, data in (("a.txt", "héllo".encode()), ("b.txt", "caf\xe9".encode("latin-1")), ("c.txt", "wide".encode("utf-16")), ("d.docx", docx()), ("e.exe", b"x"), ("f.docx", b"broken")):
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: r for r in documents.read_documents(spark, str(tmp_path)).collect()}
    assert (got["a.txt"].text, got["b.txt"].text, got["c.txt"].text) == ("héllo", "café", "wide")
    assert got["d.docx"].text == "# Title\nBody text\n| k | v |\n| --- | --- |\n| 1 | 2 |"
    assert "unsupported" in got["e.exe"].error and got["f.docx"].text is None
    docs = spark.createDataFrame([("a", "inline", None, None), ("b", " ", "p", None), ("c", None, None, "p"), ("bad id!", "x", None, None)], "id string, content string, file_path string, pdf_path string")
    files, stored = spark.createDataFrame([("p", "from file")], "path string, text string"), spark.createDataFrame([("c", "kept")], "id string, content string")
    assert {r.id: (r.content, r.origin) for r in documents.resolve_content(docs, files, stored).collect()} == {"a": ("inline", "inline"), "b": ("from file", "file"), "c": ("kept", "store")}


def test_exports(spark, tmp_path):
    from xml.etree import ElementTree

    nodes = spark.createDataFrame([("a", 'A "1" <&>', "Topic"), ("b", "B", "Concept")], "id string, name string, label string")
    edges = spark.createDataFrame([("a", "b", "USES")], "src_id string, dst_id string, type string")
    for kind in export.FORMATS:
        export.export(nodes, edges, kind, str(tmp_path / kind))
        lines = [r.value for r in spark.read.text(str(tmp_path / kind)).collect()]
        ordered = [r.line for r in export.FORMATS[kind](nodes, edges).orderBy("part", "id").collect()]
        assert sorted(lines) == sorted(ordered)
        if kind in ("graphml", "gexf"):
            ElementTree.fromstring("".join(ordered).split("?>", 1)[1])
    with pytest.raises(ValueError):
        export.export(nodes, edges, "dot", str(tmp_path / "x"))


def test_layouts(spark):
    nodes = spark.createDataFrame([(1, f"n{i}", "Topic" if i % 2 else "Odd") for i in range(8)], "graph int, id string, label string")
    edges = spark.createDataFrame([(1, f"n{i}", f"n{i + 1}", "USES") for i in range(7)], "graph int, src_id string, dst_id string, type string")
    at = {r.id: (r.x, r.y) for r in layout.force_directed(nodes, edges).collect()}
    assert len(at) == 8 and all(50 <= a <= 950 and 50 <= b <= 750 for a, b in at.values()) and len(set(at.values())) == 8
    assert {r.colour for r in layout.decorated(nodes).collect()} == {"#f59e0b", layout.DEFAULT_COLOUR}


def test_parity_cache_and_schema(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(2,), (3,)], "id int")
    assert tuple(store.parity({"t": a}, {"t": b}).first()) == ("t", 2, 2, 1, 1)
    cache = store.cache_put(spark.createDataFrame([], "key string, value string, expires_at timestamp_ntz"), spark.createDataFrame([("a:1", "x"), ("b:1", "y")], "key string, value string"), datetime(2024, 1, 1), 10)
    keys = spark.createDataFrame([("a:1",)], "key string")
    assert store.cache_get(cache, keys, datetime(2024, 1, 1, 0, 0, 9)).count() == 1 and store.cache_get(cache, keys, datetime(2024, 1, 1, 0, 0, 10)).count() == 0
    assert [r.key for r in store.cache_drop(cache, "a:*").collect()] == ["b:1"]
    assert len(quality.ddl_script()) == len(model.SCHEMAS)


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    rows = [("j", "running", datetime(2024, 1, 1, 0, 0, 0)), ("j", "completed", datetime(2024, 1, 1, 0, 0, 5)), ("k", "running", datetime(2024, 1, 1, 0, 0, 2))]
    df = spark.createDataFrame(rows, "id string, status string, updated_at timestamp")
    df.write.parquet(str(src))
    stream = spark.readStream.schema(df.schema).parquet(str(src))
    q = streaming.expiring_jobs(stream).writeStream.format("memory").queryName("jobs").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.id, r.status) for r in spark.table("jobs").collect()} == {("j", "completed"), ("k", "running")}
    start = spark.createDataFrame([("j", "ready", None), ("z", "old", None)], df.schema)
    q = streaming.upserting(stream.dropDuplicates(["id"]), str(tmp_path / "out"), lambda: start).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    out = {r.id: r.status for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert out == {"j": "ready", "z": "old", "k": "running"}


def test_feedback_is_appended_once_and_linked(spark, tmp_path):
    rows = [("q" * 900, "r1", "s", "2024-01-01", 0.5, None, None, None), ("b", "r9", "s", "2024-01-02", 0.4, None, None, None), ("c", None, "s", "2024-01-03", None, None, None, None)]
    df = spark.createDataFrame(rows, "query string, result_id string, session_id string, ts string, relevance_score double, helpful boolean, clicked boolean, dwell_time_ms long")
    entries = telemetry.feedback_entries(df, "explicit")
    assert [r.id for r in entries.collect()] == [r.id for r in telemetry.feedback_entries(df, "explicit").collect()]
    nodes = spark.createDataFrame([("r1",), ("r1",), ("r2",)], "id string")
    for _ in range(2):
        telemetry.append_feedback(entries, nodes, str(tmp_path / "sink"))
    got = spark.read.parquet(str(tmp_path / "sink" / "feedback")).collect()
    assert len(got) == 6 and {(len(r["query"]), r.is_positive) for r in got} == {(500, True), (1, False)} and len({r.id for r in got}) == 3
    links = spark.read.parquet(str(tmp_path / "sink" / "links")).distinct().collect()
    assert [(r.dst_id, r.type) for r in links] == [("r1", "FEEDBACK_FOR")] and links[0].src_id in {r.id for r in got}
    told = spark.createDataFrame([(None, None, None), (True, False, 5000), (False, True, None), (False, False, 5001)], "helpful boolean, clicked boolean, dwell_time_ms long").withColumns({"query": F.lit("q"), "relevance_score": F.lit(0.9)})
    assert [r.is_positive for r in telemetry.feedback_entries(told, "answer").collect()] == [False, True, False, False]
    assert [r.is_positive for r in telemetry.feedback_entries(told, "implicit").collect()] == [False, False, True, True]
    with pytest.raises(ValueError):
        telemetry.feedback_entries(df, "other")
    times = spark.createDataFrame([(f"{i:02}", i // 2 if i else None) for i in range(30)], "id string, ts int")
    assert [r.id for r in telemetry.recent(times).collect()] == ["28", "29", "26", "27", "24", "25", "22", "23", "20", "21"]


def test_trend_requests_are_checked():
    fine = trends.checked_request("trending", start="2024-01-01", end=datetime(2024, 2, 1), limit=100, min_growth=0.0)
    assert fine["start"] == datetime(2024, 1, 1) and trends.checked_request("evolution", granularity="semester", start=None) == {"granularity": "semester"}
    bad = [
        ("frequency", {"limit": 0}), ("frequency", {"limit": 501}), ("trending", {"limit": 101}), ("trending", {"min_growth": 10.1}), ("trending", {"min_growth": -0.1}),
        ("trending", {"start": "2024-01-02", "end": "2024-01-02"}), ("emerging", {"limit": 101}), ("evolution", {"granularity": "year"}), ("comparison", {"a": "m", "b": "m"}),
        ("overlap", {"modules": ["m", "m"]}), ("other", {}), ("emerging", {"since": "yesterday"}),
    ]
    for what, parameters in bad:
        with pytest.raises(ValueError):
            trends.checked_request(what, **parameters)
    with pytest.raises(ValueError):
        trends.overlap(None, [f"m{i}" for i in range(11)])


def test_embeddings_updates_backup_and_paths(spark, tmp_path):
    nodes = spark.createDataFrame([("a", [1.0]), ("b", None)], "id string, embedding array<double>")
    got = store.put_embeddings(nodes, spark.createDataFrame([("b", [2.0, 3.0]), ("z", [9.0])], nodes.schema))
    assert {r.id: r.embedding for r in got.collect()} == {"a": [1.0], "b": [2.0, 3.0]}
    table, missed = store.update_existing(spark.createDataFrame([("a", 1, "x")], "id string, n int, s string"), spark.createDataFrame([("a", None, "y"), ("q", 2, "z")], "id string, n int, s string"))
    assert [tuple(r) for r in table.collect()] == [("a", 1, "y")] and [r.id for r in missed.collect()] == ["q"]
    store.backup({"nodes": nodes}, str(tmp_path / "b"))
    back = store.restore(spark, str(tmp_path / "b"), ["nodes"])
    assert {r.id for r in back["nodes"].collect()} == {"a", "b"} and store.wipe(back)["nodes"].count() == 0
    tables = {
        "departments": spark.createDataFrame([("d",)], "id string"), "semesters": spark.createDataFrame([("t", "d")], "id string, department_id string"),
        "subjects": spark.createDataFrame([("s", "t")], "id string, semester_id string"), "modules": spark.createDataFrame([("m", "s")], "id string, subject_id string"),
    }
    assert hierarchy.path_exists(tables, "d", "t", "s", "m").first().exists and not hierarchy.path_exists(tables, "d", "t", "x", "m").first().exists
    assert not hierarchy.path_exists(tables, "d", "t", "s", "nowhere").first().exists
    statement = "CREATE TABLE IF NOT EXISTS ddl_probe (id string) USING parquet"
    quality.apply_ddl(spark, [statement])
    assert not spark.catalog.tableExists("ddl_probe")
    quality.apply_ddl(spark, [statement], dry_run=False)
    assert spark.catalog.tableExists("ddl_probe") and len(quality.ddl_script()) >= 5
    spark.sql("DROP TABLE ddl_probe")


def test_pdf_pages_are_joined_by_blank_lines(monkeypatch):
    monkeypatch.setattr(documents, "page_texts", lambda data: data.decode().split("|"))
    assert documents.pdf_text(b"one|two") == "one\n\ntwo"
    assert documents.pdf_text(b"one| |two|") == "one\n\ntwo"  # pages without text leave no gap
    monkeypatch.undo()
    with pytest.raises(ValueError, match="no PDF"):
        documents.pdf_text(b"one")


def test_ranges_and_evictions_need_no_global_order(spark):
    rows = spark.createDataFrame([(f"i{i}", i % 3, i) for i in range(12)], "id string, a int, b int")
    got = hierarchy.selected_range(rows, ["a", "b"], "i7", "i3").collect()
    shown = sorted(range(12), key=lambda i: (i % 3, i))
    first, last = sorted((shown.index(7), shown.index(3)))
    assert {r.id for r in got} == {f"i{i}" for i in shown[first : last + 1]}


def test_capitalised_terms_and_sentences_in_plain_python(spark):
    text = "The Neural Network of Paris met Anna Smith. A CPU, Über Alles Here; And iPhone Neural Network"
    assert one(spark, x.capitalised_terms(F.lit(text))) == ["Neural Network", "Paris", "Anna Smith", "CPU", "Über Alles", "Here"]
    assert one(spark, x.first_terms(F.lit(text))) == ["Neural Network", "Paris", "Anna Smith.", "CPU, Über", "Alles Here;"]
    assert one(spark, x.first_terms(F.lit(text), 2)) == ["Neural Network", "Paris"] and one(spark, x.first_terms(F.lit(None).cast("string"))) == []
    assert x.split_sentences("Dr. Smith went home. He was tired.") == ["Dr. Smith went home.", "He was tired."]
    assert x.split_sentences("See fig. 2! Rev. Ott has 1.5. More at 3. No? yes vs. no.") == ["See fig. 2!", "Rev. Ott has 1.5. More at 3.", "No? yes vs. no."]
    assert x.normalised_text("ﬁne\u00a0 \x07text\u3000end") == "fine text end"


def test_entity_chunks_find_names_where_they_stand():
    text = "\u0130" * 50 + " Start. " + "filler words here. " * 60 + "The Neural Net is here. " + "more filler now. " * 60 + "End."
    chunks = chunking.entity_chunks(text, ["neural net"])
    about = [c for c in chunks if "neural net" in c["entities"]]
    assert about and all("Neural Net" in c["text"] for c in about)

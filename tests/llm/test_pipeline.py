"""Each stage of the pipeline on its own input, and the whole of it, on planted documents."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillgraph.llm import mixing
from tests.llm.test_operators import brute_components, edited, word_sets

SYLLABLES = {"en": ["the", "ing", "th", "er", "and", "wh"], "fr": ["que", "eau", "é", "ou", "ç", "les"]}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)

    def text(lang, n):
        return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 5))) for _ in range(n))

    rows = [(i, text(lang := rng.choice(["en", "fr"]), rng.randrange(1, 150)), lang, f"src{i % 4}") for i in range(300)]
    base = text("en", 120).split()
    rows += [(1000 + i, edited(rng, base, i % 3), "en", "src0") for i in range(40)]
    rows += [(2000, None, "en", "src1"), (2001, "123 456", "en", "src1"), (2002, "", None, None), (2003, "Привет мир это текст " * 20, None, "src2")]
    path = tmp_path_factory.mktemp("tables")
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    df.write.parquet(str(path / "documents.parquet"))
    return str(path)


def test_stages_on_their_own_input(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "mixing", "packing"]
    kept = corpus_pipeline.recognise(spark, docs, folder)
    assert {r.doc_id for r in docs.select("doc_id").collect()} - {r.doc_id for r in kept.select("doc_id").collect()} == {2000, 2001, 2002, 2003}

    unique = corpus_pipeline.deduplicate(spark, kept, folder)
    texts = [(r.doc_id, r.text) for r in kept.collect()]
    components = brute_components(word_sets(texts, 5), 80)
    assert sorted(r.doc_id for r in unique.collect()) == sorted(i for i, c in components.items() if i == c)

    mixed = corpus_pipeline.mix(spark, unique, folder)
    assert mixed.schema == docs.schema
    sizes = {r.doc_id: len(r.text.split()) for r in unique.collect()}
    got = {}
    for r in mixed.collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text)
        assert r.n_chars == len(r.text)
        got[r.doc_id] = got.get(r.doc_id, 0) + len(words)
    assert all(n <= 3 * sizes[i] for i, n in got.items())
    assert abs(sum(got.values()) - sum(sizes.values())) <= 8


def test_run_packs_what_the_stages_keep(spark, folder):
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert pieces and not {r.doc_id for r in pieces} & {2000, 2001, 2002, 2003}
    at = 0
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.sequence_id * 2048 + r.offset == at
        at += r.length


def test_one_row_of_each_group_stays_whatever_its_id(spark, folder):
    def kept(rows):
        docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
        return sorted(map(str, (tuple(r[:2]) for r in corpus_pipeline.deduplicate(spark, docs, folder).collect())))

    a, b = "a b c d e f g", "one two three four five six"
    assert kept([(None, a), (1, a), (2, a)]) == [str((1, a))]
    assert kept([(1, b), (4, a), (4, b)]) == [str((1, b)), str((4, a))]
    assert kept([(None, a), (None, a), (7, b), (7, b), (None, None), (3, "")]) == sorted(map(str, [(None, a), (7, b), (None, None), (3, "")]))
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert corpus_pipeline.deduplicate(spark, empty, folder).count() == corpus_pipeline.mix(spark, empty, folder).count() == 0


def test_stages_keep_clashing_columns(spark, folder):
    rows = [(i, f"the thing where {i} and others " * 5, "en", "s", "x", i, i, i) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, taken string, size long, n long, h1 long")
    for stage in (corpus_pipeline.recognise, corpus_pipeline.deduplicate, corpus_pipeline.mix):
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and {(r.taken, r.h1) for r in out.collect()} <= {("x", i) for i in range(40)}
    assert {r.doc_id for r in corpus_pipeline.pack(spark, docs, folder).collect()} == set(range(40))


def test_each_row_is_mixed_by_its_own_size(spark, folder):
    rows = [(None, f"n{i} " + "w " * (9 if i % 2 else 999), "s0") for i in range(8)] + [(5, "r " * 7, "s0")] * 5 + [(i, "x " * 50, "s1") for i in range(100, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    size = {t.split()[0]: len(t.split()) for i, t, _ in rows if i is None}
    got = {}
    for r in corpus_pipeline.mix(spark, docs, folder).collect():
        if r.doc_id is None:
            got[r.text.split()[0]] = got.get(r.text.split()[0], 0) + len(r.text.split())
    taken = mixing.mix(mixing.sized(docs)).where("doc_id is null").collect()
    assert all(n <= 3 * size[name] for name, n in got.items())
    assert sorted((size[name], n) for name, n in got.items()) == sorted((r["size"], r.taken) for r in taken if r.taken)


def test_alike_rows_keep_their_own_columns(spark, folder):
    rows = [(5, "r " * 7, "s0", f"L{i}") for i in range(25)] + [(None, "q " * 3, "s1", f"M{i % 4}") for i in range(12)] + [(i, "x " * 50, "s1", "N") for i in range(100, 160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lic string").repartition(5)
    out = [(r.doc_id, r.lic, len(r.text.split())) for r in corpus_pipeline.mix(spark, docs, folder).collect()]
    got, expected = {}, {}
    for ident, lic, n in out:
        got.setdefault(ident, {}).setdefault(lic, []).append(n)
    for ident, text, _, lic in rows:
        expected.setdefault(ident, {}).setdefault(lic, []).append(len(text.split()))
    mixed = mixing.mix(mixing.sized(docs)).collect()
    for ident in (5, None):
        taken = sum(r.taken for r in mixed if r.doc_id == ident)
        assert sum(sum(x) for x in got[ident].values()) == taken and set(got[ident]) <= set(expected[ident])
        assert all(sum(n) <= 3 * sum(expected[ident][lic]) for lic, n in got[ident].items())
    assert len(got[5]) == 25 and len(got[None]) == 4  # more is taken of each source than one pass over it, so no row is left out


def test_shares_of_large_groups_go_by_chunks(spark):
    docs = spark.createDataFrame([(1, "a b c", "s", i) for i in range(60)] + [(2, "d e", "s", i) for i in range(9)], "doc_id long, text string, source string, n long").repartition(4)
    groups = mixing.sized(docs)
    plan = mixing.planned(groups, chunk=7)
    rows = docs.select(F.struct("*").alias("_row"), "doc_id", "source", mixing.n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("h"))
    each = corpus_pipeline._each_of(rows, groups, plan).collect()
    assert sorted((r._row.doc_id, r._row.n) for r in each) == sorted((r.doc_id, r.n) for r in docs.collect())
    assert sorted((r.doc_id, r.taken) for r in each) == sorted((r.doc_id, r.taken) for r in mixing.mix(groups, chunk=7).collect())

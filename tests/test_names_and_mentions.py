"""Mentions of dictionaries and resolved names against plain loops."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import chunking
from quillgraph.operators import mentions, names


def plain_mentions(texts, dictionary, whole):
    out = []
    for name in {mentions.folded(n.strip()) for n in dictionary if n and n.strip()}:
        for ident, text in texts:
            low, at = mentions.folded(text or ""), 0
            while (at := low.find(name, at)) >= 0:
                end = at + len(name)
                if whole and (at and low[at - 1].isalnum() or low[end : end + 1].isalnum()):
                    at += 1
                    continue
                out.append((ident, name, at, end))
                at = end
    return sorted(out)


@pytest.mark.parametrize("whole", [False, True])
@pytest.mark.parametrize("piece_chars", [mentions.PIECE_CHARS, 40])
def test_mentions_equal_a_plain_search(spark, whole, piece_chars):
    rng = random.Random(1)
    parts = ["ab", "aba", "Ab", " ", " ", "-", "été", "İstanbul", "ß", "x1", "😀", "a b"]
    texts = [(i, "".join(rng.choices(parts, k=rng.randint(0, 30)))) for i in range(200)] + [(500, None), (501, ""), (502, "ab " * 40_000), (3, "ab aba")]
    dictionary = ["ab", "ABA", "a", "été", " Été ", "x1 ", "", "  ", None, "a b", "😀", "istanbul", "İstanbul", "nowhere", "ß"]
    t = spark.createDataFrame(texts, "id long, text string").withColumns({"start": F.lit(1), "name": F.lit("x")}).repartition(3)
    d = spark.createDataFrame([(n,) for n in dictionary], "name string").withColumn("id", F.lit("y"))
    got = sorted(tuple(r) for r in mentions.find(t, d, whole, piece_chars=piece_chars).collect())
    assert got == plain_mentions(texts, dictionary, whole)


def test_no_names_or_texts(spark):
    t, d = spark.createDataFrame([(1, "a")], "id long, text string"), spark.createDataFrame([], "name string")
    assert mentions.find(t, d).collect() == [] == mentions.find(t.limit(0), spark.createDataFrame([("a",)], "name string")).collect()


def test_ten_thousand_names_over_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    words = docs.select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}{6,}"), F.lit(0))).alias("name")).distinct()
    dictionary = words.orderBy("name").limit(10_000)
    assert dictionary.count() == 10_000
    counts = {r.name: r.n for r in mentions.find(docs, dictionary, whole_words=True).groupBy("name").agg(F.count(F.lit(1)).alias("n")).collect()}
    known = {r.name.lower() for r in dictionary.collect()}
    expected: dict = {}
    for r in docs.collect():
        for w in re.findall(r"[^\W_]+", r.text.lower()):
            if w in known:
                expected[w] = expected.get(w, 0) + 1
    assert counts == expected


def test_chunks_around_entities_equal_a_search_by_name():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)] + ["Alpha", "alpha beta", "BETA", "gamma."]
    for _ in range(30):
        text = " ".join(rng.choices(words, weights=[1] * 300 + [3] * 4, k=rng.randint(1, 900)))
        found = chunking.entity_chunks(text, ["alpha", "Beta", "alpha beta", "", "absent"])
        for c in found:
            assert c["entities"] == [e for e in ("alpha", "Beta", "alpha beta") if e.lower() in c["text"].lower()]
        assert any(c["kind"] == "entity" for c in found) == bool(re.search("alpha|beta", text, re.IGNORECASE))


# --- resolved names ---------------------------------------------------------------------------------------------------


def plain_resolve(asked, entities):
    known: dict = {}
    for ident, name, _ in sorted(entities, key=lambda e: e[2]):
        n = (name or "").strip().lower()
        if n:
            known[n] = ident  # the first one's place, the last one's id
    initials = lambda w: "".join(x[0] for x in w)
    out = {}
    for mention in asked:
        m = (mention or "").strip().lower()
        if not m:
            continue
        v = m.split()
        rules = [lambda n, w: n == m, lambda n, w: m in n or n in m, lambda n, w: len(w) >= 2 and (m == initials(w) or len(v) >= 2 and initials(v) == initials(w))]
        rules.append(lambda n, w: len(v) >= 2 and len(w) >= len(v) and all(w[i].startswith(x) or i == len(v) - 1 and x == initials(w[i:]) for i, x in enumerate(v)))
        for number, rule in enumerate(rules, 1):
            hit = next((ident for n, ident in known.items() if rule(n, n.split())), None)
            if hit is not None:
                out[mention] = hit, number
                break
    return out


def test_rules_equal_a_loop_over_all_names(spark):
    rng = random.Random(5)
    syllables = ["in", "dus", "net", "work", "of", "th", "ma", "é", "x"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 3)))
    full = [" ".join(word() for _ in range(rng.randint(1, 4))) for _ in range(250)] + ["Industrial Internet Of Things", "natural language", None, "", "ab"]
    entities = [(i, n.title() if n and i % 3 else n, i) for i, n in enumerate(full)] + [(900, "Natural  Language", 900), (901, "natural language", 901)]
    asked = [None, " ", "IIoT", "Industrial IoT", "nat lang", "Internet of", "industrial internet of things!", "AB", "b", "zz", "abcd ef"]
    for n in rng.sample([n for n in full if n], 120):
        w = n.split()
        asked += [n.upper(), n[1:4], f"my {n} here", "".join(x[0] for x in w), f"{w[0][:2]} {''.join(x[0] for x in w[1:])}", " ".join(x[:2] for x in w[:2])]
    e = spark.createDataFrame(entities, "id int, name string, ord int").withColumn("rule", F.lit("clash")).repartition(3)
    m = spark.createDataFrame([(a,) for a in asked * 2], "mention string").withColumn("name", F.lit("clash"))
    got = names.resolve(m, e).collect()
    assert len(got) == len({r.mention for r in got})
    assert {r.mention: (r.id, r.rule) for r in got} == plain_resolve(asked, entities)
    assert {r for _, r in plain_resolve(asked, entities).values()} == {1, 2, 3, 4}


def test_names_resolve_inside_blocks(spark):
    e = spark.createDataFrame([("d1", 1, "Alpha Beta", 1), ("d2", 2, "Alpha Beta", 2), ("d2", 3, "Gamma", 3)], "doc string, id int, name string, ord int")
    m = spark.createDataFrame([("d1", "AB"), ("d2", "ab"), ("d1", "gamma"), ("d2", "gam"), ("d3", "AB")], "doc string, mention string")
    got = {(r.doc, r.mention, r.id, r.rule) for r in names.resolve(m, e, ["doc"]).collect()}
    assert got == {("d1", "AB", 1, 3), ("d2", "ab", 2, 3), ("d2", "gam", 3, 2)}
    assert names.resolve(m.limit(0), e).collect() == [] == names.resolve(m, e.limit(0)).collect()

"""Full-text search against a plain BM25, the analyser's rules, and how many blocks a search reads."""

from __future__ import annotations

import math
import random
import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import fulltext


def analysed(text):
    folded = "".join(c for c in unicodedata.normalize("NFD", (text or "").lower()) if not unicodedata.combining(c))
    out = []
    for w in re.findall(r"[^\W_]+(?:['’][^\W_]+)*", unicodedata.normalize("NFC", folded)):
        if w in fulltext.STOP_WORDS:
            continue
        w = re.sub("['’]s$", "", w)
        if w.endswith("ies") and not w.endswith(("eies", "aies")):
            w = w[:-3] + "y"
        elif w.endswith("es") and not w.endswith(("aes", "ees", "oes")) or w.endswith("s") and not w.endswith(("us", "ss")):
            w = w[:-1]
        out.append(w)
    return out


def brute(docs, queries, k):
    counted = [(i, Counter(analysed(t))) for i, t in docs if i is not None]
    mean = sum(sum(c.values()) for _, c in counted) / len(counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for q, weights in queries:
        scored = []
        for i, c in counted:
            n = sum(c.values())
            parts = [math.log1p((len(counted) - df[t] + 0.5) / (df[t] + 0.5)) * w * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * n / mean)) for t, w in weights.items() if c[t]]
            if parts:
                scored.append((-round(sum(parts), 6), i))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def rounded(found):
    return sorted((r.query_id, r["rank"], r.id, round(r.score, 6)) for r in found.rows.collect())


def frame(spark, rows, key="id"):
    return spark.createDataFrame(rows, f"{key} long, text string").withColumns({"term": F.lit("x"), "row": F.lit(1), "part": F.lit("y")})


def test_the_analyser(spark):
    texts = ["The Ladies' cafés and the dog's bones", "Été déjà-vu, naïve über STRASSE", "bus glass buses series zombies", "it is not", "", None, "x1 2nd 日本語 o’clock", "été"]
    got = [r.t for r in spark.createDataFrame(list(enumerate(texts)), "i long, t string").orderBy("i").select(F.transform(fulltext.tokens(F.col("t")), fulltext.stemmed).alias("t")).collect()]
    assert got == [analysed(t) for t in texts]
    assert got[0] == ["lady", "cafe", "dog", "bone"] and got[7] == ["ete"]


@pytest.fixture
def corpus():
    rng = random.Random(6)
    words = [f"word{i}" for i in range(40)] + ["Été", "the", "cities", "dogs"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 30))) + (" needle" * (1 + i % 3) if i % 97 == 5 else "")) for i in range(900)]
    return [*docs, (900, None), (901, ""), (902, "the of"), (None, "needle needle"), (7, "needle city"), (903, "needle " * 5000)]


def test_scores_equal_a_plain_bm25_and_few_blocks_are_read(spark, tmp_path, corpus, monkeypatch):
    monkeypatch.setattr(fulltext, "BLOCK_DOCS", 16)
    index = fulltext.build(frame(spark, corpus[:600]).coalesce(1), str(tmp_path / "index"))
    fulltext.add(index, frame(spark, corpus[600:]).coalesce(1))
    queries = [(1, "needle"), (2, "City ete dog dog"), (3, "nowhere"), (4, "the"), (5, None), (6, "word1 word2 needle")]
    terms = fulltext.query_terms(frame(spark, queries, "query_id"))
    found = fulltext.search(fulltext.opened(spark, index.path), terms, 5, seeds=2)
    assert rounded(found) == brute(corpus, [(q, Counter(analysed(t))) for q, t in queries], 5)
    read = {r.query_id: r["count"] for r in found.read.groupBy("query_id").count().collect()}
    assert read[1] <= 16 and max(read.values()) <= 60  # of 57 blocks, and all of them only for common words


def test_related_terms_count_less(spark, tmp_path, corpus):
    index = fulltext.build(frame(spark, corpus), str(tmp_path / "index"))
    terms = fulltext.query_terms(frame(spark, [(1, "needle needle"), (2, "word3")], "query_id"))
    related = spark.createDataFrame([("Needles", "dogs", 0.5), ("needle", "needle", 0.9), ("needle", "word1", 0.2), ("needle", "Été", 0.31), ("needle", "word4", 0.4), ("other", "word5", 1.0)], "term string, expansion string, weight double")
    more = fulltext.expanded(terms, related, most=2)
    got = {(r.query_id, r.term): round(r.weight, 6) for r in more.collect()}
    assert got == {(1, "needle"): 2.0, (2, "word3"): 1.0, (1, "dog"): 1.0, (1, "word4"): 0.8}
    found = fulltext.search(index, more, 10)
    assert rounded(found) == brute(corpus, [(1, {"needle": 2.0, "dog": 1.0, "word4": 0.8}), (2, {"word3": 1.0})], 10)


def test_empty_tables(spark, tmp_path):
    index = fulltext.build(frame(spark, []), str(tmp_path / "index"))
    asked = fulltext.query_terms(frame(spark, [(1, "a word")], "query_id"))
    assert fulltext.search(index, asked, 3).rows.collect() == []
    assert fulltext.search(index, asked.limit(0), 3).rows.collect() == []


def test_two_searches_under_one_score(spark):
    texts = spark.createDataFrame([(1, 10, 8.0), (1, 11, 4.0), (2, 12, 3.0)], "query_id long, id long, score double")
    vectors = spark.createDataFrame([(1, 10, 0.5), (1, 13, 0.9), (2, 14, 0.1)], "query_id long, id long, score double")
    got = [(r.query_id, r["rank"], r.id, round(r.score, 3)) for r in fulltext.combined(texts, vectors).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 10, 0.65), (1, 2, 13, 0.63), (2, 1, 12, 0.3)]
    both_zero = fulltext.combined(texts, vectors, vector_weight=0, text_weight=0)
    assert sorted(map(str, both_zero.collect())) == sorted(map(str, fulltext.combined(texts, vectors).collect()))

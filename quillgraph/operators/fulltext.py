"""Full-text search: an analyser, a stored inverted index, and BM25 with bounds on blocks of documents. Everything is DataFrame code.

The analyser folds case and accents, drops English stop words and possessives, and takes plural endings off. The index is three tables in one folder:

* ``postings``: a row for each term and document, partitioned by a bucket of the term and sorted by it, so that a search opens the folders of its terms' buckets
  and skips row groups by their statistics;
* ``blocks``: for each term and block of ``BLOCK_DOCS`` consecutive documents how many have it, its highest frequency and the shortest such document's length;
* ``documents``: one row for each time documents were added: how many, and how long in all.

A search sums what a block's documents can have at most for each query. It scores the few blocks of highest bounds first; only blocks whose
bound reaches the k-th best score found there, for any query, are scored after that. So answers are exact, and postings of other blocks are not joined. Postings are
shuffled once by block; what queries make of them stays in their tasks but for the scores that reach the k-th best.

Defined results: a text without terms counts as a document of length 0; a row without id is not indexed; rows that repeat an id are different documents; equal scores (to
``DIGITS`` decimal places) rank by smaller id; a query finds only documents with one of its terms; terms that a query repeats count as often; weights at or below 0 are dropped.
"""

from __future__ import annotations

import unicodedata
from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graph import settled

K1, B = 1.2, 0.75
BLOCK_DOCS, BUCKETS, SEEDS = 1024, 64, 4
DIGITS = 9

# The stop words of the usual English analyser.
STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
TOKEN = r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*"


def _accents() -> tuple[str, str]:
    """Small Latin letters with marks, and the letters without; combining marks alone go."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0xC0, 0x250)]
    marked = [(c, d[0]) for c, d in pairs if len(d) > 1 and c == c.lower() and all(unicodedata.combining(x) for x in d[1:])]
    marks = "".join(chr(c) for c in range(0x300, 0x370) if unicodedata.combining(chr(c)))
    return "".join(c for c, _ in marked) + marks, "".join(d for _, d in marked)


_MARKED, _PLAIN = _accents()


def tokens(text: Column) -> Column:
    """Folded words in order, without stop words."""
    folded = F.translate(F.lower(F.coalesce(text, F.lit(""))), _MARKED, _PLAIN)
    return F.filter(F.regexp_extract_all(folded, F.lit(TOKEN), F.lit(0)), lambda t: ~t.isin(*STOP_WORDS))


def stemmed(token: Column) -> Column:
    """Without a possessive, and in the singular: ``-ies`` to ``-y``, ``-es`` to ``-e``, ``-s`` to nothing, but for endings that are no plural."""
    w = F.regexp_replace(token, r"['’]s$", "")

    def ends(*endings: str) -> Column:
        return reduce(or_, [w.endswith(e) for e in endings])

    return (
        F.when(ends("ies") & ~ends("eies", "aies"), F.regexp_replace(w, "ies$", "y"))
        .when(ends("es") & ~ends("aes", "ees", "oes"), F.regexp_replace(w, "s$", ""))
        .when(ends("s") & ~ends("us", "ss"), F.regexp_replace(w, "s$", ""))
        .otherwise(w)
    )


class Index(NamedTuple):
    path: str
    kind: str  # the type of ids

    def postings(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(f"part int, block long, row long, id {self.kind}, term string, tf long, length int, bucket int").parquet(f"{self.path}/postings")

    def blocks(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("part int, block long, term string, documents long, most long, shortest int, bucket int").parquet(f"{self.path}/blocks")

    def documents(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("part int, documents long, length long").parquet(f"{self.path}/documents")


def build(df: DataFrame, path: str, text: str = "text", key: str = "id") -> Index:
    """Indexes ``df`` in a new folder."""
    index = Index(path, df.schema[key].dataType.simpleString())
    df.sparkSession.createDataFrame([(index.kind,)], "kind string").coalesce(1).write.text(f"{path}/kind")
    _add(index, df, text, key, 0)
    return index


def opened(spark: SparkSession, path: str) -> Index:
    return Index(path, spark.read.text(f"{path}/kind").first()[0])


def add(index: Index, df: DataFrame, text: str = "text", key: str = "id") -> None:
    """Indexes more documents; a part of the tables of its own, whose last row makes it count."""
    _add(index, df, text, key, 1 + (index.documents(df.sparkSession).agg(F.max("part")).first()[0] or 0))


def _add(index: Index, df: DataFrame, text: str, key: str, part: int) -> None:
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast(index.kind).alias("id"), F.array_sort(F.transform(tokens(F.col(text)), stemmed)).alias("terms"))
    rows = settled(rows.withColumn("length", F.size("terms")).withColumn("row", F.monotonically_increasing_id()))
    counted = rows.select("id", "row", "length", F.explode(_counts(F.col("terms"))).alias("c")).select("row", "id", "length", "c.term", "c.tf")
    bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")
    shaped = counted.select(F.lit(part).alias("part"), F.floor(F.col("row") / BLOCK_DOCS).cast("long").alias("block"), "row", "id", "term", "tf", "length", bucket.alias("bucket"))
    # a bucket may be split: a frequent term has more postings than one task should write
    shaped.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "row").write.mode("append").partitionBy("bucket").parquet(f"{index.path}/postings")
    mine = index.postings(df.sparkSession).where(F.col("part") == part)
    tops = mine.groupBy("part", "block", "term", "bucket").agg(F.count(F.lit(1)).alias("documents"), F.max("tf").alias("most"), F.min("length").alias("shortest"))
    tops.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.mode("append").partitionBy("bucket").parquet(f"{index.path}/blocks")
    sums = rows.agg(F.lit(part).alias("part"), F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("length"), F.lit(0)).alias("length"))
    sums.write.mode("append").parquet(f"{index.path}/documents")


def _counts(terms: Column) -> Column:
    """Each term of a sorted array with its frequency: of a document, so nothing is shuffled."""
    places = F.sequence(F.lit(0), F.size(terms) - 1)
    starts = F.filter(places, lambda i: (i == 0) | (F.get(terms, i) != F.get(terms, i - 1)))
    # the places stand in an array of one, so that they are found once and not for each term
    counted = F.transform(F.array(starts), lambda s: F.transform(s, lambda at, n: F.struct(F.get(terms, at).alias("term"), (F.coalesce(F.get(s, n + 1), F.size(terms)) - at).cast("long").alias("tf"))))
    return F.when(F.size(terms) > 0, F.get(counted, F.lit(0)))


def query_terms(queries: DataFrame, text: str = "text", key: str = "query_id") -> DataFrame:
    """``query_id, term, weight``: the terms of each query, as often as they occur."""
    words = queries.where(F.col(key).isNotNull()).select(F.col(key).alias("query_id"), F.explode(tokens(F.col(text))).alias("token"))
    return words.groupBy("query_id", stemmed(F.col("token")).alias("term")).agg(F.count(F.lit(1)).cast("double").alias("weight"))


def expanded(terms: DataFrame, related: DataFrame, most: int = 10, least: float = 0.3) -> DataFrame:
    """``terms`` with related ones: of ``term, expansion, weight`` the ``most`` weighty for each query, from ``least`` on, that it does not have already."""
    words = related.where(F.col("weight") >= least).select(stemmed(F.translate(F.lower("term"), _MARKED, _PLAIN)).alias("term"), stemmed(F.translate(F.lower("expansion"), _MARKED, _PLAIN)).alias("expansion"), F.col("weight").alias("share"))
    found = terms.join(words, "term").groupBy("query_id", F.col("expansion").alias("term")).agg(F.max(F.col("weight") * F.col("share")).alias("weight"))
    fresh = found.join(terms, ["query_id", "term"], "left_anti")
    ranked = fresh.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("weight"), "term")))
    return terms.unionByName(ranked.where(F.col("_r") <= most).drop("_r"))


class Found(NamedTuple):
    """``rows``: ``query_id, rank, id, score``; ``read``: ``query_id, part, block``, the blocks whose postings were scored."""

    rows: DataFrame
    read: DataFrame


def search(index: Index, terms: DataFrame, k: int, seeds: int = SEEDS) -> Found:
    """The k documents of highest BM25 for each query of ``terms`` (``query_id, term, weight``)."""
    spark = terms.sparkSession
    asked = settled(terms.where("weight > 0").withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")))
    buckets = [r.bucket for r in asked.select("bucket").distinct().collect()]  # BUCKETS at most
    documents, length = index.documents(spark).agg(F.coalesce(F.sum("documents"), F.lit(0)), F.coalesce(F.sum("length"), F.lit(0))).first()
    mean = length / documents if length else 1.0

    def gain(tf: str, size: str) -> Column:
        return F.col("idf") * F.col("weight") * F.col(tf) * (K1 + 1) / (F.col(tf) + K1 * (1 - B + B * F.col(size) / F.lit(mean)))

    here = index.blocks(spark).where(F.col("bucket").isin(buckets)).join(asked.select("bucket", "term").distinct(), ["bucket", "term"])
    df = here.groupBy("bucket", "term").agg(F.sum("documents").alias("df"))
    weighed = settled(asked.join(df, ["bucket", "term"]).withColumn("idf", F.log1p((F.lit(documents) - F.col("df") + 0.5) / (F.col("df") + 0.5))).drop("df"))
    # what is summed for each block comes together by block, before it meets the queries: only that is shuffled
    tops = here.repartition("part", "block").join(weighed, ["bucket", "term"]).groupBy("query_id", "part", "block").agg((F.sum(gain("most", "shortest")) * (1 + 1e-9)).alias("bound"))
    tops = settled(tops)
    highest = Window.partitionBy("query_id").orderBy(F.desc("bound"), "part", "block")
    first = settled(tops.withColumn("_r", F.row_number().over(highest)).where(F.col("_r") <= seeds).drop("_r", "bound"))

    asked_postings = index.postings(spark).where(F.col("bucket").isin(buckets)).join(asked.select("bucket", "term").distinct(), ["bucket", "term"], "left_semi")

    def scored(blocks: DataFrame) -> DataFrame:
        """Of each query and block the documents' scores; postings come together by block, and meet their terms' queries there."""
        there = asked_postings.join(blocks.select("part", "block").distinct(), ["part", "block"], "left_semi").repartition("part", "block")
        met = there.join(weighed, ["bucket", "term"])
        return met.groupBy("query_id", "part", "block", "row", "id").agg(F.round(F.sum(gain("tf", "length")), DIGITS).alias("score"))

    early = settled(scored(first).join(first, ["query_id", "part", "block"], "left_semi"))
    kth = _ranked(early, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    kth = settled(kth)
    rest = tops.join(kth, "query_id", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - 10.0**-DIGITS))
    rest = settled(rest.join(first, ["query_id", "part", "block"], "left_anti").select("query_id", "part", "block"))
    # a block that one query asks for is scored for all that have its terms: scores below a query's k-th best so far go before anything is shuffled
    late = scored(rest).join(kth, "query_id", "left").where(F.col("least").isNull() | (F.col("score") >= F.col("least"))).drop("least")
    late = late.join(first, ["query_id", "part", "block"], "left_anti")
    rows = _ranked(early.unionByName(late), k)
    return Found(rows.select("query_id", "rank", "id", "score"), first.unionByName(rest))


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id", "part", "row")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def combined(texts: DataFrame, vectors: DataFrame, k: int = 15, vector_weight: float = 0.7, text_weight: float = 0.3, least: float = 0.3) -> DataFrame:
    """``query_id, rank, id, score``: hits of a text search and of a vector search (``query_id, id, score``) under one score.

    A text score counts as a share of its query's best. Weights are brought to a sum of one (both 0: 0.7 and 0.3); a hit of one search only has 0 in the other.
    """
    total = vector_weight + text_weight
    wv, wt = (vector_weight / total, text_weight / total) if total else (0.7, 0.3)
    best = F.max("score").over(Window.partitionBy("query_id"))
    t = texts.select("query_id", "id", F.try_divide(F.col("score"), best).alias("t"))
    both = t.join(vectors.select("query_id", "id", F.col("score").alias("v")), ["query_id", "id"], "full")
    score = F.round(wv * F.coalesce("v", F.lit(0.0)) + wt * F.coalesce("t", F.lit(0.0)), DIGITS)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = both.select("query_id", "id", score.alias("score")).where(F.col("score") >= least).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "id", "score")

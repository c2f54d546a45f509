"""Sharding: a Feistel permutation with cycle walking over global row numbers.

The shuffle is a function of (row number, number of rows, seed): it can be repeated, and the shard and slot
of a row can be computed without looking at any other row. Everything is DataFrame code.

Global row numbers come from narrow passes. Rows are counted by key and ties first, so that a repeated row, or a missing key, is one row
with a number; large groups are cut to chunks. A chunk's bucket is a hash of key, ties and chunk; the buckets' counts give each bucket's first
number, and the running count inside the bucket, in order of key and ties, does the rest. Number of buckets and order do not depend on
how the input is split, so neither do the numbers.

The permutation works on a domain ``a * b >= n`` of two mixed radices, chosen so that ``a * b - n`` is as small as
possible; a row outside ``[0, n)`` is permuted again. A walk passes only through the ``a * b - n`` surplus values,
so that many steps and one more always suffice: the bound is exact, not a probability.

Defined results: a null text has size 16 and the checksum of the empty text; a null id is a key like others; rows with equal ids are numbered by
size and checksum, and rows that are equal in all three are interchangeable; the empty table gives an empty table; columns besides the key
and the ties are ignored, whatever their names, and not returned. Copies of a text are placed like any other rows: this law evens out
counts, it does not keep groups together.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import CHUNK, chunked, grouped_rows, table

ROUNDS = 6
#: Rows a bucket has on average, as soon as there are more than so many of the fewest buckets.
BUCKET_ROWS, FEWEST_BUCKETS = 32_768, 4096


def domain(n: int) -> tuple[int, int]:
    """Radices a, b near the square root of n with a * b >= n and the smallest surplus.

    The quarter of the candidates below the root is searched: both halves keep a like width, and the surplus
    is a handful at any n.
    """
    root = max(1, math.isqrt(max(0, n - 1)) + 1)
    sizes = range(root - min(root // 4, 1 << 20), root + 1)
    return min(((a, max(1, -(-n // a))) for a in sizes), key=lambda ab: (ab[0] * ab[1] - n, -ab[0]))


def permuted(row: Column, n: int, seed: int) -> Column:
    """Where row number ``row`` (0 to n-1) goes; a bijection of [0, n)."""
    a, b = domain(n)

    def one_round(acc: Column, i: Column) -> Column:
        left, right = acc["l"], acc["r"]
        new_left = F.pmod(left + F.pmod(F.xxhash64(right, i, F.lit(seed)), F.lit(a)), F.lit(a))
        new_right = F.pmod(right + F.pmod(F.xxhash64(new_left, i, F.lit(~seed)), F.lit(b)), F.lit(b))
        return F.struct(new_left.alias("l"), new_right.alias("r"))

    def feistel(x: Column) -> Column:
        start = F.struct(F.pmod(x, F.lit(a)).cast("long").alias("l"), F.floor(x / F.lit(a)).cast("long").alias("r"))
        rounds = F.array(*[F.lit(i).cast("long") for i in range(ROUNDS // 2)])
        return F.aggregate(rounds, start, one_round, lambda acc: (acc["l"] + F.lit(a) * acc["r"]).cast("long"))

    walk = F.sequence(F.lit(1), F.lit(a * b - n)) if a * b > n else None
    first = feistel(row)
    if walk is None:
        return first
    return F.aggregate(walk, first, lambda acc, _: F.when(acc < F.lit(n), acc).otherwise(feistel(acc)).cast("long"))


def bucketed(df: DataFrame, columns: list[str], n: int, chunk: int = CHUNK) -> DataFrame:
    """``columns, _n, _chunk, _bucket``: chunks of equal rows and the bucket each is in."""
    chunks = chunked(grouped_rows(df.select(*columns), "_n"), "_n", "_chunk", chunk)
    return chunks.withColumn("_bucket", F.pmod(F.xxhash64(*columns, "_chunk"), F.lit(max(FEWEST_BUCKETS, n // BUCKET_ROWS))))


def with_row_numbers(df: DataFrame, columns: list[str], n: int, chunk: int = CHUNK) -> DataFrame:
    """``columns, row_number`` of each of the ``n`` rows: numbers from 0, without gaps."""
    spread = bucketed(df, columns, n, chunk)
    counts = spread.groupBy("_bucket").agg(F.sum("_n").alias("_all"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("_bucket", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("_bucket").orderBy(*columns, "_chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = spread.withColumn("_end", F.sum("_n").over(inside)).join(firsts, "_bucket")
    end = F.col("_first") + F.col("_end")
    return placed.select(*columns, F.explode(F.sequence((end - F.col("_n")).cast("long"), (end - 1).cast("long"))).alias("row_number"))


def shard(df: DataFrame, n_shards: int, seed: int, key: str = "doc_id", ties: list[str] | None = None, chunk: int = CHUNK) -> DataFrame:
    """``key, ties, row_number, position, shard, slot`` for each row; the shards' counts differ by one at most."""
    n = df.count()
    position = permuted(F.col("row_number"), n, seed)
    numbered = with_row_numbers(df, [key, *(ties or [])], n, chunk).withColumn("position", position)
    return numbered.withColumns({"shard": F.pmod("position", F.lit(n_shards)).cast("int"), "slot": F.floor(F.col("position") / n_shards).cast("long")})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    out = shard(docs, n_shards=40, seed=20_240_229, ties=["size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

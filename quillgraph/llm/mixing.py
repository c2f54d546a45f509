"""Mixing sources to target weights by Sainte-Lague apportionment. Everything is DataFrame code.

1. Targets: the sources share all words by weight; a target stops at ``max_repeats`` times its source's size and the
   excess is shared again by weight, until none is above. That fixed point is a water level: with the sources in order
   of ``limit / weight``, running sums give the level directly.
2. Quotas: equal blocks of words go to the sources by highest quotients ``target / (2 k + 1)``, and each source's
   blocks to its shards in the same way, by the shards' sizes. Sources of one scale (targets within a factor of ``SCALE``) share blocks of one size, the ``SCALE``-th part of
   the least such target or one word, so that small sources beside large ones come as near to their targets. Rounding to the nearest block gives a correct apportionment
   for some total near the wanted one; the few blocks that are missing (or too many) then follow from the next (or
   last) quotients. The number of candidate quotients is linear in the number of parties.
3. Selection: a shard's documents stand in seeded order as one stream of words; its quota takes whole passes over the
   stream, and from the last pass its first blocks. What a document gives then follows from its shard's cell alone: how many passes, and where
   the last one is cut. Cells are few (``MAX_CELLS`` and one for each source), so that they can be sent to every task and texts are not shuffled.

Rows that are alike in id, source and text are counted first and handled as one group with a number, in chunks; a chunk's shard is a hash of id, text
and chunk. So neither missing nor repeated ids nor repeated rows make a hot key, and the number of shards of a source grows with its rows.

Defined results: a null text has size 0; null is a source of its own, after all others; a source without words has target
0 and gives nothing; rows with equal ids are different documents, and equal rows are interchangeable; the empty table gives
an empty table; columns besides those named are ignored. Nothing is taken beyond ``max_repeats`` times a document's size.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import CHUNK, WORD, chunked, grouped_rows, table, written

WEIGHTS = (5, 2, 1)
#: A source has between so many blocks and the square of that, or blocks of one word.
SCALE = 1000
#: Rows a shard of a source has on average: so many, or more where the cells would become more than ``MAX_CELLS``.
SHARD_ROWS, MAX_CELLS = 2048, 20_000
KEY = ["doc_id", "source", "size", "h"]


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = 3) -> DataFrame:
    """``source, source_size`` to these, ``weight`` and ``target``. A row for each source; one window over them."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    s = sources.withColumn("weight", F.get(cycle, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))))
    s = s.withColumn("_limit", F.col("source_size") * max_repeats)
    all_rows = Window.partitionBy()
    by_level = Window.orderBy(F.col("_limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({
        "_total": F.sum("source_size").over(all_rows),
        "_full": F.coalesce(F.sum("_limit").over(before), F.lit(0)),
        "_open": F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    # the level if all sources before this one are at their limits and this one and the rest are not
    s = s.withColumn("_level", (F.col("_total") - F.col("_full")) / F.col("_open"))
    s = s.withColumn("_fits", F.col("_limit") >= F.col("_level") * F.col("weight"))
    # the first source in that order that fits sets the level; the limits of all after it lie higher
    s = s.withColumn("_level", F.first(F.when(F.col("_fits"), F.col("_level")), ignorenulls=True).over(by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(F.col("_limit").cast("double"), F.coalesce(F.col("_level"), F.lit(0.0)) * F.col("weight"))
    return s.select("source", "source_size", "weight", target.alias("target"))


def apportion(parties: DataFrame, group: list[str], key: list[str], share: str, seats: str, out: str) -> DataFrame:
    """Sainte-Lague: splits ``seats`` (one number a group) among a group's parties by ``share``; adds ``out``.

    Equal quotients go to the smaller key. Groups without shares get nothing.
    """
    whole = Window.partitionBy(*group)
    p = parties.withColumns({"_sum": F.sum(share).over(whole), "_n": F.count(F.lit(1)).over(whole)})
    exact = F.when(F.col("_sum") > 0, F.col(share) / F.col("_sum") * F.col(seats)).otherwise(0.0)
    p = p.withColumn("_near", F.floor(exact + 0.5).cast("long"))
    p = p.withColumn("_more", F.when(F.col("_sum") > 0, F.col(seats) - F.sum("_near").over(whole)).otherwise(0).cast("long"))
    # a party gains (loses) no more than its share of (n + missing) seats and one more
    reach = (F.ceil(F.col(share) / F.col("_sum") * (F.col("_n") + F.abs("_more"))) + 1).cast("long")
    steps = F.when((F.col("_more") == 0) | (F.col("_sum") <= 0), F.lit(0)).when(F.col("_more") > 0, reach).otherwise(F.least(reach, F.col("_near")))
    j = p.withColumn("_j", F.explode_outer(F.when(steps > 0, F.sequence(F.lit(1).cast("long"), steps.cast("long")))))
    quotient = F.when(F.col("_more") > 0, F.col(share) / (2 * (F.col("_near") + F.col("_j") - 1) + 1)).otherwise(
        -F.col(share) / (2 * (F.col("_near") - F.col("_j")) + 1)
    )
    j = j.withColumn("_q", quotient)
    order = Window.partitionBy(*group).orderBy(F.col("_q").desc_nulls_last(), *[F.col(k).asc_nulls_last() for k in key], F.col("_j"))
    j = j.withColumn("_won", (F.col("_j").isNotNull() & (F.row_number().over(order) <= F.abs("_more"))).cast("long"))
    kept = [c for c in parties.columns]
    return (
        j.groupBy(*kept, "_near", "_more")
        .agg(F.sum("_won").alias("_won"))
        .withColumn(out, F.col("_near") + F.signum("_more").cast("long") * F.col("_won"))
        .select(*kept, out)
    )


def sized(docs: DataFrame) -> DataFrame:
    """The narrow table that mixing works on, written once: ``doc_id, source, size, h`` (a hash of the text) and ``n``, the number of such rows."""
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("h"))
    return written(grouped_rows(rows, "n"), "mix-sizes")


class Plan(NamedTuple):
    """What decides how much each document gives: a row for each source, and one for each cell (source and shard)."""

    sources: DataFrame
    cells: DataFrame
    max_repeats: int
    seed: int
    chunk: int


def _placed(rows: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """Adds the source's columns, ``shard`` and ``at``, the place in the shard's order, to rows of ``KEY, chunk``."""
    shard = F.pmod(F.xxhash64("doc_id", "h", "chunk", F.lit(seed)), F.col("shards"))
    at = F.struct(F.xxhash64("doc_id", "h", "chunk", F.lit(seed + 1)).alias("o"), F.col("doc_id"), F.col("size"), F.col("h"), F.col("chunk"))
    # one row for each source: broadcast as far as Spark's own size limit allows, shuffled beyond it
    both = rows.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    return both.select("d.*", *[F.col(f"s.{c}") for c in ("source_size", "target", "block", "quota")], shard.alias("shard"), at.alias("at"))


def planned(
    groups: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = 3, seed: int = 17, scale: int = SCALE,
    shard_rows: int = SHARD_ROWS, max_cells: int = MAX_CELLS, chunk: int = CHUNK,
) -> Plan:
    """Targets, quotas and cuts for what ``sized`` gives."""
    stats = groups.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("source_rows"))
    aimed = targets(stats.select("source", "source_size"), weights, max_repeats)
    # seats: a number for each scale, so that each source's target is a whole number of blocks but for rounding
    level = F.floor(F.ln(F.greatest(F.col("target"), F.lit(1.0))) / F.ln(F.lit(float(scale))) + 1e-9).cast("int")
    block = F.greatest(F.lit(1.0), F.pow(F.lit(float(scale)), F.col("_scale") - 1)).cast("long")
    seats = aimed.withColumn("_scale", level).withColumn("block", block)
    seats = seats.withColumn("_seats", F.round(F.sum("target").over(Window.partitionBy("_scale")) / F.col("block")).cast("long"))
    by_source = apportion(seats, ["_scale"], ["source"], "target", "_seats", "quota").drop("_scale", "_seats")
    rows_a_shard = F.greatest(F.lit(float(shard_rows)), F.sum("source_rows").over(Window.partitionBy()) / max_cells)
    counted = stats.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_rows") / rows_a_shard)).cast("long"))
    sources = by_source.alias("a").join(counted.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.*", "b.shards")
    sources = written(sources, "mix-sources")

    placed = _placed(chunked(groups, "n", "chunk", chunk), sources, seed)
    words = F.col("size") * F.col("n")
    cells = placed.groupBy("source", "shard", "block", "quota").agg(F.sum(words).alias("cell_size"))
    cells = apportion(cells.withColumn("_share", F.col("cell_size").cast("double")), ["source"], ["shard"], "_share", "quota", "cell_quota")
    quota = F.least(F.col("cell_quota") * F.col("block"), F.col("cell_size") * max_repeats)
    passes = F.when(F.col("cell_size") > 0, F.floor(quota / F.col("cell_size"))).otherwise(0).cast("long")
    cells = written(cells.select("source", "shard", passes.alias("passes"), (quota - passes * F.col("cell_size")).alias("rest")), "mix-cells")

    inside = Window.partitionBy("source", "shard").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    streams = placed.select("source", "shard", "at", words.alias("w")).withColumn("end", F.sum("w").over(inside))
    same = F.col("d.source").eqNullSafe(F.col("c.source")) & (F.col("d.shard") == F.col("c.shard"))
    begin = F.col("end") - F.col("w")
    cuts = streams.alias("d").join(cells.alias("c"), same & (begin <= F.col("rest")) & (F.col("rest") < F.col("end")))
    cuts = cuts.select("c.source", "c.shard", F.col("at").alias("cut"), (F.col("rest") - begin).alias("cut_words"))
    every = cells.alias("d").join(cuts.alias("c"), same, "left").select("d.source", "d.shard", "passes", "cut", "cut_words")
    return Plan(sources, written(every, "mix-cuts"), max_repeats, seed, chunk)


def with_taken(groups: DataFrame, plan: Plan, *more: str) -> DataFrame:
    """``groups`` (``KEY, n`` and more) with ``source_size, target, taken`` and ``n``, the number of rows that give so much.

    A group over ``plan.chunk`` rows gives several rows, for its chunks; ``more`` may name ``chunk``, and ``first``, the chunk's rows that come before these.
    """
    placed = _placed(chunked(groups, "n", "chunk", plan.chunk), plan.sources, plan.seed)
    cells = plan.cells.withColumnRenamed("source", "cell_source").withColumnRenamed("shard", "cell_shard")
    both = placed.join(cells, F.col("source").eqNullSafe(F.col("cell_source")) & (F.col("shard") == F.col("cell_shard")))
    size, n, base = F.col("size"), F.col("n"), F.col("passes") * F.col("size")
    at_cut = F.col("at").eqNullSafe(F.col("cut"))
    # of a group that is cut some give all their words, one a part, and the rest nothing in the last pass
    full = F.when(at_cut, F.floor(F.col("cut_words") / size)).when(F.col("at") < F.col("cut"), n).otherwise(0).cast("long")
    part = F.when(at_cut, F.pmod(F.col("cut_words"), size)).otherwise(0).cast("long")
    some = (part > 0).cast("long")
    kinds = F.array(*[F.struct(t.cast("long").alias("taken"), k.cast("long").alias("n")) for t, k in ((base + size, full), (base + part, some), (base, n - full - some))])
    before = F.array(F.lit(0).cast("long"), full, full + some)
    kinds = F.zip_with(kinds, before, lambda x, b: F.struct(x["taken"].alias("taken"), x["n"].alias("n"), b.alias("first")))
    out = both.withColumn("_kind", F.explode(F.filter(kinds, lambda x: x["n"] > 0))).withColumn("first", F.col("_kind.first"))
    return out.select(*[c for c in groups.columns if c != "n"], "source_size", "target", "_kind.taken", "_kind.n", *more)


def mix(groups: DataFrame, **options) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` for each row that ``sized`` counted; options as for ``planned``."""
    amounts = with_taken(groups, planned(groups, **options))
    rows = amounts.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return rows.select("doc_id", "source", "size", "source_size", "target", "taken")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(sized(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken")

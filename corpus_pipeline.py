"""A corpus pipeline: language ID, near-dedup, mixing to target weights, packing.

``run`` applies the stages to ``documents``; each stage's rows are written as Parquet and read again as the next one's.
All but the last return the columns of ``documents``, in their order; the last returns one row for each piece of a packed sequence.

Defined results: a null ``doc_id`` or ``source`` is a value like others, and rows that share an id are different documents, each judged by its
own text. A null or empty text is rejected by language ID; near-dedup keeps every text without words, mixing takes nothing of it, packing gives it the end
token alone. Of rows that are alike in id and text near-dedup keeps one; to mixing, rows alike in id, source and text are one document repeated, of which
each row gives its own share and keeps its other columns. Texts of any length are handled whole. Empty tables give empty results. Further columns of the
documents, whatever their names, are passed on by all stages but the last.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm import langid, mixing, neardup, packing
from quillgraph.llm._shared import WORD, table, written


def recognise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID rejects go: those without a letter, and those far from every language's centroids."""
    return langid.keep_recognised(docs, langid.fitted_on(docs))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five-word shingles, similarity of 0.8 or more): one with the smallest id."""
    return neardup.one_of_each(docs, size=5, percent=80)


def _same(left: str, right: str, columns: list[str]) -> Column:
    return reduce(and_, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns])


def _each_of(rows: DataFrame, groups: DataFrame, plan: mixing.Plan) -> DataFrame:
    """Deals out what groups of alike rows give: each row gets its own number in its group, and with it its share.

    Rows are numbered in their splits, and splits by their counts, so that a group of any size is never in one task.
    """
    ours = written(rows.withColumn("_at", F.monotonically_increasing_id()), "mix-alike").withColumn("_split", F.shiftright("_at", 33))
    counts = written(ours.groupBy(*mixing.KEY, "_split").agg(F.count(F.lit(1)).alias("_n")), "mix-splits")
    before = Window.partitionBy(*mixing.KEY).orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy(*mixing.KEY, "_split").orderBy("_at"))
    keys = [*mixing.KEY, "_split"]
    numbered = ours.withColumn("_inside", inside).alias("d").join(offsets.alias("o"), _same("d", "o", keys)).select("d.*", (F.col("_offset") + F.col("_inside") - 1).alias("_number"))
    numbered = numbered.withColumns({"_chunk": F.floor(F.col("_number") / plan.chunk).cast("long"), "_place": F.pmod("_number", F.lit(plan.chunk))})
    shares = written(mixing.with_taken(groups, plan, "chunk", "first"), "mix-shares")
    place = (F.col("d._chunk") == F.col("s.chunk")) & (F.col("d._place") >= F.col("s.first")) & (F.col("d._place") < F.col("s.first") + F.col("s.n"))
    return numbered.alias("d").join(shares.alias("s"), _same("d", "s", mixing.KEY) & place).select("d._row", *[f"d.{c}" for c in mixing.KEY], "s.source_size", "s.target", "s.taken")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; where it takes a part, the last copy has that many words.

    How much a document gives follows from its own row and the plan's small tables, so texts are not shuffled.
    """
    groups = mixing.sized(docs)
    plan = mixing.planned(groups)
    rows = docs.select(F.struct("*").alias("_row"), "doc_id", "source", mixing.n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("h"))
    repeated = groups.where("n > 1")
    if repeated.isEmpty():
        amounts = mixing.with_taken(rows.withColumn("n", F.lit(1).cast("long")), plan)
    else:
        same = _same("d", "r", mixing.KEY)
        once = rows.alias("d").join(repeated.alias("r"), same, "left_anti").withColumn("n", F.lit(1).cast("long"))
        amounts = mixing.with_taken(once, plan).drop("n").unionByName(_each_of(rows.alias("d").join(repeated.alias("r"), same, "left_semi"), repeated, plan))
    amounts = amounts.where("taken > 0").select("_row", "size", "taken")
    whole, rest = F.floor(F.col("taken") / F.col("size")).cast("long"), F.pmod("taken", "size")
    numbers = F.sequence(F.lit(1).cast("long"), F.col("whole") + (F.col("rest") > 0).cast("long"))
    copies = amounts.withColumns({"whole": whole, "rest": rest}).withColumn("copy", F.explode(numbers))
    is_whole = F.col("copy") <= F.col("whole")
    part = F.array_join(F.slice(F.regexp_extract_all("_row.text", F.lit(rf"{WORD}[\x20\x09-\x0D]*"), 0), 1, F.col("rest").cast("int")), "")
    text = F.when(is_whole, F.col("_row.text")).otherwise(part)
    own = {"text": text.alias("text")}
    if "n_chars" in docs.columns:
        own["n_chars"] = F.when(is_whole, F.col("_row.n_chars")).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return copies.select(*[own.get(c, F.col("_row").getField(c).alias(c)) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.query_over(docs)


STAGES = [("language_id", recognise), ("near_dedup", deduplicate), ("mixing", mix), ("packing", pack)]

#: SQL cannot express sketches and trained models; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

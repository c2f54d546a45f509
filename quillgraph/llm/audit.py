"""Filter interaction audit by the subset-zeta transform.

Each document has a mask: a bit for each filter that it fails. Documents are counted by part and mask, which leaves at most ``2 ** n`` counts a part,
whatever the number of rows. The zeta transform over subsets (one pass for each bit) turns these into the survivors of every set of filters: what
survives the set T is what fails only filters outside of T. A step of an order is then the difference between two neighbouring sets, and so are the
labels lost at it; the Shapley sum of a filter is its differences, each as often as there are orders that meet it.

Copies are found by the text's SHA-256: rows alike in id, text and part are counted before any shuffle by text, and a text's groups (one for each part
and label) meet in one window, so a text repeated in a third of all rows is no hot key.

Defined results: a null text is empty; a null part is the empty string, together with parts that are empty strings; a row without id is
nobody's copy and has no labels; rows with equal ids are different documents, of which none is the other's copy; a document has a label if any of its
label rows has it; the empty table gives an empty table; further columns, whatever their names, are ignored. Every part has one row for each order and step.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import WORD, table, written

#: The filter that compares documents; the others look at one text.
COPY = "E"


def failures(text: Column) -> dict[str, Column]:
    """What fails: too few words, too many repeated words, too many capitals, symbols."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    distinct = F.size(F.array_distinct(words))
    return {
        "A": F.size(words) < 200,
        "B": 100 * distinct < 50 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def masked(docs: DataFrame, labels: DataFrame, conditions: Mapping[str, Column], copy: str, marks: Mapping[str, Column], key: str, part: str, text: str) -> DataFrame:
    """``part, mask, n`` and a count for each of ``marks`` (conditions on ``labels``): the documents of each part and set of failed filters.

    ``conditions`` look at column ``text``; bit ``i`` of the mask is the i-th of them in name order, ``copy`` among them.
    """
    names = sorted([*conditions, copy])
    bits = {name: 1 << i for i, name in enumerate(names)}
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(part), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    mask = sum((F.when(F.coalesce(c, F.lit(False)), bits[name]).otherwise(0) for name, c in conditions.items()), F.lit(0))
    rows = rows.select("id", "part", F.unhex(F.sha2("text", 256)).alias("h"), mask.alias("mask"))
    rows = written(rows.groupBy("id", "part", "h", "mask").agg(F.count(F.lit(1)).alias("n")), "audit-rows")

    marked = rows
    if marks:
        flags = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(*[F.max(F.coalesce(c, F.lit(False))).alias(m) for m, c in marks.items()])
        marked = rows.join(written(flags, "audit-labels"), "id", "left").withColumns({m: F.coalesce(m, F.lit(False)) for m in marks})
    alike = ["h", "part", "mask", *marks]
    # rows of one id differ here in part or text at least, so the smallest id of a group has one row
    groups = marked.groupBy(*alike).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("no_id"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("least"),
    )
    first = F.min("least.id").over(Window.partitionBy("h"))
    groups = groups.withColumn("first", first)
    alone = F.col("no_id") + F.when(F.col("least.id") == F.col("first"), F.col("least.n")).otherwise(0)
    both = F.array(F.struct(F.col("mask").alias("mask"), alone.alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(bits[copy])).alias("mask"), (F.col("n") - alone).alias("n")))
    split = groups.select("part", *marks, F.explode(F.filter(both, lambda x: x["n"] > 0)).alias("x")).select("part", *marks, "x.*")
    counts = [F.sum("n").alias("n"), *[F.sum(F.when(F.col(m), F.col("n")).otherwise(0)).alias(m) for m in marks]]
    return split.groupBy("part", "mask").agg(*counts)


def zeta(counts: Column, n: int) -> Column:
    """Of an array of ``2 ** n`` counts by mask the sums over all subsets of each mask: one pass for each bit."""

    def one(bit: int) -> Callable[[Column], Column]:
        return lambda a: F.transform(a, lambda x, u: x + F.when(u.bitwiseAND(F.lit(bit)) != 0, F.get(a, u - bit)).otherwise(F.lit(0).cast("long")))

    for i in range(n):  # the array goes through a lambda, so that each pass is computed once
        counts = F.get(F.transform(F.array(counts), one(1 << i)), F.lit(0))
    return counts


def survivors(masks: DataFrame, n: int, columns: list[str]) -> DataFrame:
    """A row for each part; each column becomes an array: at place T what survives the filters of T."""
    places = F.sequence(F.lit(0), F.lit((1 << n) - 1))
    found = masks.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*columns)))).alias("by"))  # 2 ** n entries at most

    def dense(column: str) -> Column:
        return F.transform(places, lambda m: F.coalesce(F.element_at("by", m)[column], F.lit(0).cast("long")))

    sums = found.select("part", *[zeta(dense(c), n).alias(c) for c in columns])
    return sums.select("part", *[F.reverse(c).alias(c) for c in columns])  # fails only outside of T: the sum at T's complement


def interactions(survived: DataFrame, names: list[str], lost: Mapping[str, str]) -> DataFrame:
    """A row for each part, order and step, from what ``survivors`` gives; ``lost`` names the output of each further count."""
    n, full = len(names), (1 << len(names)) - 1
    orders = F.array(*[F.lit("".join(p)) for p in permutations(names)])
    rows = survived.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    prefix = F.substring("filter_order", F.lit(1), F.col("step") - 1)
    rows = rows.withColumns({
        "_f": sum((F.when(F.substring("filter_order", F.col("step"), F.lit(1)) == x, 1 << i).otherwise(0) for i, x in enumerate(names)), F.lit(0)),
        "_t": sum((F.when(F.contains(prefix, F.lit(x)), 1 << i).otherwise(0) for i, x in enumerate(names)), F.lit(0)),
    })

    def removed(column: str, at: Column) -> Column:
        return F.get(column, at) - F.get(column, at + F.col("_f"))

    times = F.array(*[F.lit(factorial(t.bit_count()) * factorial(n - 1 - t.bit_count()) if t != full else 0) for t in range(full + 1)])
    others = F.filter(F.sequence(F.lit(0), F.lit(full)), lambda t: t.bitwiseAND(F.col("_f")) == 0)
    shapley = F.aggregate(others, F.lit(0).cast("long"), lambda s, t: s + F.get(times, t) * removed("n", t))
    here = removed("n", F.col("_t"))
    return rows.select(
        "part", "filter_order", "step",
        F.get("n", F.col("_t") + F.col("_f")).alias("kept"),
        here.alias("removed"),
        (removed("n", F.lit(0)) - here).alias("redundant"),
        removed("n", F.lit(full) - F.col("_f")).alias("unique_fails"),
        *[removed(c, F.col("_t")).alias(out) for c, out in lost.items()],
        shapley.alias("shapley"),
    )


def audit(
    docs: DataFrame, labels: DataFrame, conditions: Mapping[str, Column], copy: str = COPY, marks: Mapping[str, Column] | None = None,
    key: str = "doc_id", part: str = "source", text: str = "text",
) -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, shapley`` and ``<mark>_lost`` for each mark: every order of the filters, step by step.

    Filters have names of one letter; ``copy`` names the one that fails texts equal to a smaller id's. The number of rows is n! * n for each part.
    """
    marks = marks or {}
    names = sorted([*conditions, copy])
    masks = masked(docs, labels, conditions, copy, marks, key, part, text)
    survived = written(survivors(masks, len(names), ["n", *marks]), "audit-survivors")
    return interactions(survived, names, {m: f"{m}_lost" for m in marks})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), failures(F.col("text")), COPY, marks)


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
lab AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(lab.toxic, false) AS toxic,
  {'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words), 'C': 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t),
   'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false)} AS x
  FROM w LEFT JOIN lab USING (doc_id)),
m AS (SELECT part, (CASE WHEN x.A THEN 'A' ELSE '' END) || (CASE WHEN x.B THEN 'B' ELSE '' END) || (CASE WHEN x.C THEN 'C' ELSE '' END)
   || (CASE WHEN x.D THEN 'D' ELSE '' END) || (CASE WHEN x.E THEN 'E' ELSE '' END) AS failed, count(*) AS n, count_if(good) AS g, count_if(toxic) AS tox FROM f GROUP BY ALL),
l(c) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (SELECT filter_order, i::INTEGER AS step, substr(filter_order, i, 1) AS c, substr(filter_order, 1, i - 1) AS before FROM o, range(1, 6) r(i)),
r AS (SELECT part, filter_order, step, c,
  sum(CASE WHEN NOT regexp_matches(failed, '[' || before || c || ']') THEN n ELSE 0 END)::BIGINT AS kept,
  sum(CASE WHEN contains(failed, c) AND (before = '' OR NOT regexp_matches(failed, '[' || before || '_]')) THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN contains(failed, c) AND before <> '' AND regexp_matches(failed, '[' || before || '_]') THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN failed = c THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN contains(failed, c) AND (before = '' OR NOT regexp_matches(failed, '[' || before || '_]')) THEN g ELSE 0 END)::BIGINT AS good_lost,
  sum(CASE WHEN contains(failed, c) AND (before = '' OR NOT regexp_matches(failed, '[' || before || '_]')) THEN tox ELSE 0 END)::BIGINT AS toxic_lost
  FROM m, s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, c))::BIGINT AS shapley FROM r
"""

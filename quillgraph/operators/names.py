"""Names resolved to entities across a whole table, by rules that are tried in turn: the same name, one within the other, initials, and a mixed abbreviation.

Every rule is a join on keys, never a comparison of all with all:

1. the same folded name;
2. one within the other: what is contained has all its q-grams in common with what contains it, so it meets, by its rarest one, only names with that
   q-gram (names shorter than q by themselves as a gram), and is then looked for in them;
3. initials: the initials of a name of several words are the mention, or the mention's initials;
4. abbreviation: the mention's words begin the name's words one after another, and its last may be the initials of all words left; a name meets mentions by
   the beginnings of its first word together with the initial of its second.

Of several names that one rule finds, the first by ``ord`` counts; only that one is carried through the shuffle.

Defined results: null or blank mentions and names match nothing; folding is lower case without white space at the ends; of entities with one folded name the
last by ``ord`` stands for it, in the first one's place; a mention that no rule resolves has no row; repeated mentions have one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import settled

Q = 3


def _folded(name: str) -> Column:
    return F.lower(F.trim(F.regexp_replace(name, r"^\s+|\s+$", "")))


def words(name: Column) -> Column:
    return F.filter(F.split(name, r"\s+"), lambda w: w != "")


def initials(of: Column) -> Column:
    return F.array_join(F.transform(of, lambda w: F.substring(w, 1, 1)), "")


def _grams(text: str, size: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(F.col(text), i, size)))


def contained(short: DataFrame, long: DataFrame, block: list[str], q: int = Q) -> DataFrame:
    """Pairs of a row of ``short`` (``s`` and block columns) and one of ``long`` (``l``, block columns and more) in whose ``l`` its ``s`` stands. ``s`` is not empty."""
    sizes = short.withColumn("size", F.least(F.length("s"), F.lit(q)))
    keyed = sizes.select(*block, "s", F.explode(_grams("s", F.col("size"))).alias("gram"))
    wanted = settled(keyed.select("gram").distinct())
    each = F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.length("l"), F.lit(q))), lambda n: F.transform(F.sequence(F.lit(1), F.length("l") - n + 1), lambda i: F.substring(F.col("l"), i, n))))
    index = settled(long.select("*", F.explode(F.array_distinct(each)).alias("gram")).join(wanted, "gram", "left_semi"))
    frequency = index.groupBy(*block, "gram").agg(F.count(F.lit(1)).alias("f"))
    # a gram that stands in no name at all shows that the string stands in none
    rated = keyed.join(frequency, [*block, "gram"], "left").groupBy(*block, "s").agg(F.min_by("gram", F.coalesce("f", F.lit(0))).alias("gram"), F.min(F.coalesce("f", F.lit(0))).alias("f"))
    return rated.where("f > 0").select(*block, "s", "gram").join(index, [*block, "gram"]).where(F.contains("l", F.col("s"))).drop("gram")


def is_abbreviation(short: Column, full: Column) -> Column:
    """Of two arrays of words."""
    last = F.size(short) - 1

    def fits(i: Column) -> Column:
        rest = F.slice(full, i + 1, F.greatest(F.size(full) - i, F.lit(0)))
        return F.coalesce(F.startswith(F.get(full, i), F.get(short, i)), F.lit(False)) | ((i == last) & (F.get(short, i) == initials(rest)))

    return (F.size(short) >= 2) & (F.size(full) >= F.size(short)) & F.forall(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), fits)


def resolve(mentions: DataFrame, entities: DataFrame, block: list[str] | None = None, q: int = Q) -> DataFrame:
    """``mention, id, rule`` (and the block's columns) for each mention that names one of the entities ``id, name, ord`` (of its block, if there are blocks)."""
    block = block or []
    asked = settled(mentions.select(*block, "mention", _folded("mention").alias("m")).where(F.col("m") != "").distinct())
    known = entities.select(*block, _folded("name").alias("n"), "id", "ord").where(F.col("n") != "")
    known = settled(known.groupBy(*block, "n").agg(F.max_by("id", "ord").alias("id"), F.min("ord").alias("ord")).withColumn("w", words(F.col("n"))))

    def first(pairs: DataFrame, rule: int) -> DataFrame:
        return settled(pairs.groupBy(*block, "m").agg(F.min_by("id", "ord").alias("id")).withColumn("rule", F.lit(rule)))

    left = settled(asked.select(*block, "m").distinct())
    found = [first(left.join(known.withColumnRenamed("n", "m"), [*block, "m"]), 1)]

    left = settled(left.join(found[-1], [*block, "m"], "left_anti"))
    names = known.drop("w")
    inside = contained(left.withColumnRenamed("m", "s"), names.withColumnRenamed("n", "l"), block, q).select(*block, F.col("s").alias("m"), "id", "ord")
    around = contained(names.select(*block, F.col("n").alias("s")), left.withColumnRenamed("m", "l"), block, q)
    around = around.join(names.withColumnRenamed("n", "s"), [*block, "s"]).select(*block, F.col("l").alias("m"), "id", "ord")
    found.append(first(inside.unionByName(around), 2))

    left = settled(left.join(found[-1], [*block, "m"], "left_anti").withColumn("w", words(F.col("m"))))
    several = known.where(F.size("w") >= 2)
    by_initials = several.groupBy(*block, initials(F.col("w")).alias("key")).agg(F.min_by("id", "ord").alias("id"), F.min("ord").alias("ord"))
    keys = F.array_distinct(F.when(F.size("w") >= 2, F.array("m", initials(F.col("w")))).otherwise(F.array("m")))
    found.append(first(left.select(*block, "m", F.explode(keys).alias("key")).join(by_initials, [*block, "key"]), 3))

    left = left.join(found[-1], [*block, "m"], "left_anti").where(F.size("w") >= 2)
    begin = F.struct(F.get("w", F.lit(0)).alias("word"), F.substring(F.get("w", F.lit(1)), 1, 1).alias("next"))
    asks = settled(left.select(*block, "m", F.col("w").alias("short"), begin.alias("key")))
    starts = F.transform(F.sequence(F.lit(1), F.length(F.get("w", F.lit(0)))), lambda i: F.struct(F.substring(F.get("w", F.lit(0)), F.lit(1), i).alias("word"), F.substring(F.get("w", F.lit(1)), 1, 1).alias("next")))
    index = several.select(*block, "id", "ord", F.col("w").alias("full"), F.explode(starts).alias("key")).join(asks.select(*block, "key").distinct(), [*block, "key"], "left_semi")
    found.append(first(asks.join(index, [*block, "key"]).where(is_abbreviation(F.col("short"), F.col("full"))), 4))

    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return asked.join(out, [*block, "m"]).select(*block, "mention", "id", "rule")

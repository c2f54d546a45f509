"""Trend analytics over entity occurrences ``name, label, module_id, definition, created_at``.

Every ranking ends in the name and label, so that limits are reproducible. Rounding happens last.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import of_types


def _at(when: datetime | str) -> Column:
    return F.lit(str(when)).cast("timestamp_ntz")


#: What a request may ask for, as (least, most); the default is the functions' own.
REQUEST_LIMITS = {
    "frequency": {"limit": (1, 500)},
    "trending": {"limit": (1, 100), "min_growth": (0.0, 10.0)},
    "emerging": {"limit": (1, 100)},
    "evolution": {},
    "comparison": {},
    "overlap": {},
}
GRANULARITIES = ("day", "week", "month", "semester")


def checked_request(what: str, **parameters) -> dict:
    """The parameters of a request for one of ``REQUEST_LIMITS``, checked; times may be ISO strings and come back as datetimes.

    Raises ``ValueError`` for numbers out of range, an end that is not after its start, an unknown granularity, a module compared with itself,
    fewer than two different modules for an overlap, or an unknown request.
    """
    if what not in REQUEST_LIMITS:
        raise ValueError(f"unknown request {what!r}")
    out = {k: datetime.fromisoformat(v) if k in ("start", "end", "since") and isinstance(v, str) else v for k, v in parameters.items() if v is not None}
    for name, (least, most) in REQUEST_LIMITS[what].items():
        if name in out:
            _within(name, out[name], least, most)
    if "start" in out and "end" in out and out["end"] <= out["start"]:
        raise ValueError("the end must be after the start")
    if out.get("granularity", "month") not in GRANULARITIES:
        raise ValueError(f"granularity must be one of {GRANULARITIES}")
    if what == "comparison" and out.get("a") == out.get("b"):
        raise ValueError("a module is not compared with itself")
    if what == "overlap" and len(set(out.get("modules", ()))) < 2:
        raise ValueError("an overlap needs two modules")
    return out


def _within(what: str, value: float, least: float, most: float) -> None:
    if not least <= value <= most:
        raise ValueError(f"{what} must be from {least} to {most}, not {value}")


def _asked(modules: list[str], most: int = 10) -> list[str]:
    """The different modules asked for; more than ten are refused, as they would silently drop out of a table of all pairs."""
    asked = list(dict.fromkeys(modules))
    _within("the number of modules", len(asked), 1, most)
    return asked


def concept_frequency(entities: DataFrame, modules: list[str] | None = None, types: tuple[str, ...] | None = None, limit: int = 100) -> DataFrame:
    """``name, label, frequency, modules``: the most frequent concepts."""
    counted = of_types(entities, types, modules).groupBy("name", "label").agg(
        F.count(F.lit(1)).alias("frequency"), F.array_sort(F.collect_set("module_id")).alias("modules")
    )
    return counted.orderBy(F.desc("frequency"), "name", "label").limit(limit)


def frequency_by_type(frequency: DataFrame) -> DataFrame:
    """How many of the listed concepts have each type (one each, whatever their frequency)."""
    return frequency.groupBy("label").agg(F.count(F.lit(1)).alias("concepts"))


def frequency_by_module(frequency: DataFrame) -> DataFrame:
    return frequency.select(F.explode("modules").alias("module_id")).groupBy("module_id").agg(F.count(F.lit(1)).alias("concepts"))


def trending(entities: DataFrame, start: datetime, end: datetime, min_growth: float = 0.2, limit: int = 20, modules: list[str] | None = None) -> DataFrame:
    """Concepts whose count in [start, end) grew over that of the equally long period before, which is counted by name alone.

    One scan: both periods are counted by (name, label), and the earlier one is then summed by name.
    """
    before = start - (end - start)
    rows = of_types(entities, None, modules).where((F.col("created_at") >= _at(before)) & (F.col("created_at") < _at(end)))
    is_now = F.col("created_at") >= _at(start)
    both = rows.groupBy("name", "label").agg(F.count_if(is_now).alias("current"), F.count_if(~is_now).alias("_before"))
    previous = F.sum("_before").over(Window.partitionBy("name"))
    grown = both.withColumn("previous", previous).where("current > 0 and previous > 0")
    growth = (F.col("current") - F.col("previous")) / F.col("previous")
    top = grown.withColumn("_growth", growth).where(F.col("_growth") >= min_growth).orderBy(F.desc("_growth"), "name", "label").limit(limit)
    return top.select("name", "label", "current", "previous", F.round("_growth", 4).alias("growth"))


def emerging(entities: DataFrame, links: DataFrame, since: datetime, limit: int = 20, modules: list[str] | None = None, related: int = 5) -> DataFrame:
    """Concepts never seen before ``since`` in any module, with up to five related names (``links``: name_a, name_b)."""
    new = of_types(entities, None, modules).where(F.col("created_at") >= _at(since))
    old = of_types(entities).where(F.col("created_at") < _at(since)).select("name")
    found = new.join(old, "name", "left_anti").groupBy("name", "label").agg(
        F.min("created_at").alias("first_seen"), F.count(F.lit(1)).alias("mention_count"), F.min_by("module_id", F.struct("created_at", "module_id")).alias("module_id")
    )
    top = found.orderBy(F.desc("first_seen"), "name", "label").limit(limit)
    either = links.select(F.col("name_a").alias("name"), F.col("name_b").alias("other")).unionByName(links.select(F.col("name_b").alias("name"), F.col("name_a").alias("other")))
    names = either.where("name <> other").join(F.broadcast(top.select("name").distinct()), "name", "left_semi").distinct()
    first = names.withColumn("_r", F.row_number().over(Window.partitionBy("name").orderBy("other"))).where(F.col("_r") <= related)
    names = first.groupBy("name").agg(F.array_sort(F.collect_list("other")).alias("related"))  # related rows at most
    return top.join(names, "name", "left").withColumn("related", F.coalesce("related", F.array().cast("array<string>")))


def bucket(when: Column, granularity: str) -> Column:
    """Day, week (its Monday), month or half-year of a timestamp."""
    if granularity == "day":
        return F.date_format(when, "yyyy-MM-dd")
    if granularity == "week":
        return F.date_format(F.date_trunc("week", when), "yyyy-MM-dd")
    if granularity == "month":
        return F.date_format(when, "yyyy-MM")
    if granularity == "semester":
        return F.concat(F.date_format(when, "yyyy"), F.when(F.month(when) <= 6, "-H1").otherwise("-H2"))
    raise ValueError(f"unknown granularity {granularity!r}")


def evolution(entities: DataFrame, name: str, start: datetime, end: datetime, granularity: str = "month") -> DataFrame:
    """Frequency and modules of one concept by time bucket, in order."""
    rows = of_types(entities).where((F.lower("name") == name.lower()) & (F.col("created_at") >= _at(start)) & (F.col("created_at") < _at(end)))
    grouped = rows.groupBy(bucket(F.col("created_at"), granularity).alias("bucket")).agg(F.count(F.lit(1)).alias("frequency"), F.array_sort(F.collect_set("module_id")).alias("modules"))
    return grouped.orderBy("bucket")


def definition_changes(entities: DataFrame, name: str) -> DataFrame:
    """A concept's distinct definitions (first 200 characters) with when each was first seen."""
    rows = of_types(entities).where((F.lower("name") == name.lower()) & (F.col("definition") != ""))
    return rows.groupBy("definition").agg(F.min("created_at").alias("first_seen")).select(F.substring("definition", 1, 200).alias("definition"), "first_seen")


def _by_name(entities: DataFrame, module: str) -> DataFrame:
    """A module's concepts; of several rows with one name the last counts."""
    return of_types(entities, None, [module]).groupBy("name").agg(F.max_by("definition", F.struct("created_at", "event_id")).alias("definition"))


def compare(entities: DataFrame, a: str, b: str) -> DataFrame:
    """Names of two modules: shared, only in the one, only in the other, and whether shared definitions differ."""
    x, y = _by_name(entities, a).alias("x"), _by_name(entities, b).alias("y")
    both = x.join(y, F.col("x.name") == F.col("y.name"), "full_outer")
    side = F.when(F.col("y.name").isNull(), "unique_to_a").when(F.col("x.name").isNull(), "unique_to_b").otherwise("shared")
    dx, dy = F.coalesce("x.definition", F.lit("")), F.coalesce("y.definition", F.lit(""))
    differs = (dx != "") & (dy != "") & (dx != dy)
    return both.select(
        F.coalesce("x.name", "y.name").alias("name"), side.alias("side"),
        F.when(differs, F.substring(dx, 1, 200)).alias("definition_a"), F.when(differs, F.substring(dy, 1, 200)).alias("definition_b"),
    )


def similarity(entities: DataFrame, a: str, b: str) -> DataFrame:
    """Jaccard similarity of two modules' sets of names, and the sizes behind it."""
    sides = compare(entities, a, b).agg(
        F.count_if(F.col("side") == "shared").alias("shared"), F.count_if(F.col("side") == "unique_to_a").alias("unique_to_a"), F.count_if(F.col("side") == "unique_to_b").alias("unique_to_b")
    )
    union = F.col("shared") + F.col("unique_to_a") + F.col("unique_to_b")
    return sides.withColumn("jaccard", F.round(F.when(union > 0, F.col("shared") / union).otherwise(0.0), 4))


def overlap(entities: DataFrame, modules: list[str]) -> DataFrame:
    """Each name in ten modules at most: where it is, whether it is shared (two or more) and bridging (shared, and in half of the modules).

    The type is that of the first row by time, and each module's last definition is kept.
    """
    asked = _asked(modules)
    rows = of_types(entities, None, asked)
    per_module = rows.groupBy("name", "module_id").agg(
        F.min(F.struct("created_at", "event_id", "label")).alias("_first"), F.max_by("definition", F.struct("created_at", "event_id")).alias("definition")
    )
    grouped = per_module.groupBy("name").agg(
        F.min("_first")["label"].alias("label"),
        F.array_sort(F.collect_list("module_id")).alias("modules"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("definition").isNotNull(), F.struct("module_id", "definition"))))).alias("definitions"),
    )
    n = F.size("modules")
    return grouped.withColumns({"shared": n > 1, "bridging": (n > 1) & (n >= len(asked) // 2)})


def jaccard_matrix(entities: DataFrame, modules: list[str]) -> DataFrame:
    """``a, b, jaccard`` for all pairs of ten modules at most. Counts of shared names come from a self-join on the name."""
    asked = _asked(modules)
    sets = of_types(entities, None, asked).select("module_id", "name").distinct()
    sizes = sets.groupBy("module_id").agg(F.count(F.lit(1)).alias("n"))
    common = sets.select(F.col("module_id").alias("a"), "name").join(sets.select(F.col("module_id").alias("b"), "name"), "name").groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"))
    spark = entities.sparkSession
    wanted = spark.range(1).select(F.explode(F.array(*[F.lit(m) for m in asked])).alias("a")).select("a", F.explode(F.array(*[F.lit(m) for m in asked])).alias("b"))
    full = (
        wanted.join(common, ["a", "b"], "left")
        .join(sizes.select(F.col("module_id").alias("a"), F.col("n").alias("n_a")), "a", "left")
        .join(sizes.select(F.col("module_id").alias("b"), F.col("n").alias("n_b")), "b", "left")
    )
    common, union = F.coalesce("common", F.lit(0)), F.coalesce("n_a", F.lit(0)) + F.coalesce("n_b", F.lit(0)) - F.coalesce("common", F.lit(0))
    value = F.when(F.col("a") == F.col("b"), 1.0).when(union == 0, 0.0).otherwise(F.round(common / union, 4))
    return full.select("a", "b", value.alias("jaccard"))

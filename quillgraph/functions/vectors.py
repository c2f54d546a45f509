"""Vector functions on ``array<double>`` or ``array<float>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector at length one; zero vectors stay."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 for missing or empty vectors, different lengths and zero vectors."""
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b))
    scale = norm(a) * norm(b)
    return F.when(F.coalesce(usable, F.lit(False)) & (scale > 0), dot(a, b) / scale).otherwise(0.0)


def deterministic_embedding(text: Column, dimensions: int = 768) -> Column:
    """The offline embedding: from the sum of the code points of at most 30,000 characters; blank texts have none."""
    chars = F.filter(F.split(F.substring(text, 1, 30_000), ""), lambda c: c != "")
    seed = F.pmod(F.aggregate(chars, F.lit(0).cast("long"), lambda s, c: s + F.coalesce(code_point(c), F.lit(0))), F.lit(997))
    # the seed stands in an array of one, so that it is computed once and not for each dimension
    places = F.sequence(F.lit(0), F.lit(dimensions - 1))
    made = F.get(F.transform(F.array(seed), lambda s: F.transform(places, lambda i: F.pmod(s + i, F.lit(101)) / 100.0)), F.lit(0))
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", F.array().cast("array<double>")).otherwise(made)


def code_point(char: Column) -> Column:
    """Of one character, from its UTF-32 bytes."""
    return F.conv(F.hex(F.encode(char, "UTF-32")), 16, 10).cast("long")


def entity_text(name: Column, definition: Column) -> Column:
    return F.when(F.coalesce(definition, F.lit("")) != "", F.concat_ws(": ", name, definition)).otherwise(name)


def zero(dimensions: int) -> Column:
    return F.array_repeat(F.lit(0.0), dimensions)

"""A document store kept as JSON lines ``{"path": ..., "data": {...}}``: collections are path patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, data string"


def load(spark: SparkSession, path: str) -> DataFrame:
    """``path, data`` (a variant) of every document."""
    rows = spark.read.schema(SCHEMA).json(path)
    return rows.select("path", F.parse_json("data").alias("data"))


def save(store: DataFrame, path: str) -> None:
    store.select("path", F.to_json("data").alias("data")).write.mode("overwrite").json(path)


def collection(store: DataFrame, path: str) -> DataFrame:
    """The documents directly in one collection, with their ids."""
    return store.where(F.col("path").rlike(f"^\\Q{path}\\E/[^/]+$")).select(F.substring_index("path", "/", -1).alias("id"), "path", "data")


def collection_group(store: DataFrame, name: str) -> DataFrame:
    """The documents of all collections of one name, at any depth."""
    return store.where(F.col("path").rlike(f"(^|/)\\Q{name}\\E/[^/]+$")).select(F.substring_index("path", "/", -1).alias("id"), "path", "data")


def document(store: DataFrame, path: str) -> DataFrame:
    return store.where(F.col("path") == path)


def subcollections(store: DataFrame, path: str) -> DataFrame:
    """Names of the collections directly under a document."""
    name = F.regexp_extract("path", f"^\\Q{path}\\E/([^/]+)/", 1)
    return store.select(name.alias("name")).where("name <> ''").distinct()


def field(data: Column, dotted: str, kind: str = "string") -> Column:
    """A nested field, null where it is missing."""
    return F.try_variant_get(data, "$." + dotted, kind)

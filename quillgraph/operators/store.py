"""Document-store filters, upserts, caches, copies and parity checks, as rewrites of tables."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OPS = {
    "==": lambda c, v: c.eqNullSafe(F.lit(v)),
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    "array_contains": lambda c, v: F.array_contains(c, v),
    "in": lambda c, v: c.isin(*v) if v else F.lit(False),
}


def where(df: DataFrame, *conditions: tuple[str, str, object]) -> DataFrame:
    """All conditions ``(field, operator, value)`` hold. A missing value equals only null and satisfies no comparison.

    The conditions stay bare, so that they reach the scan: a filter drops rows for which one of them is null.
    """
    tests = [_OPS[op](F.col(field), value) for field, op, value in conditions]
    return df.where(reduce(lambda a, b: a & b, tests, F.lit(True)))


def ordered(df: DataFrame, field: str, descending: bool = False, limit: int = 0, as_text: bool = False) -> DataFrame:
    """By a field and then id; limit 0 means none. ``as_text``: numbers in the order of their digits, missing ones as "" or "zzzz"."""
    c = F.coalesce(F.col(field).cast("string"), F.lit("zzzz" if descending else "")) if as_text else F.col(field)
    out = df.orderBy(c.desc() if descending else c.asc(), "id")
    return out.limit(limit) if limit else out


def missing(c: Column) -> Column:
    """Null or blank text."""
    return c.isNull() | (F.trim(c) == "")


def empty_list(c: Column) -> Column:
    return c.isNull() | (F.size(c) == 0)


def member_or_null(c: Column, values: list[str]) -> Column:
    return c.isin(*values) | c.isNull()


def partial_update(df: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Rows with the non-null fields of their change."""
    fields = [c for c in changes.columns if c != key]
    joined = df.join(changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in fields]), key, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c) for c in df.columns])


def upsert(old: DataFrame, new: DataFrame, now: Column, key: str = "id", merge: bool = False) -> DataFrame:
    """Old and new rows by key, new ones first in force (``merge``: field by field where not null).

    ``created_at`` stays what it was, ``updated_at`` is now for what was written. Writing the same twice changes nothing else.
    """
    fields = [c for c in old.columns if c not in (key, "created_at", "updated_at")]
    o = old.select(key, *[F.col(c).alias(f"_o_{c}") for c in old.columns if c != key], F.lit(True).alias("_old"))
    n = new.select(key, *[F.col(c).alias(f"_n_{c}") for c in new.columns if c != key], F.lit(True).alias("_new"))
    both = o.join(n, key, "full_outer")
    written = F.col("_new").isNotNull()

    def value(c: str) -> Column:
        if c not in new.columns:
            return F.col(f"_o_{c}")
        return F.coalesce(f"_n_{c}", f"_o_{c}") if merge else F.when(written, F.col(f"_n_{c}")).otherwise(F.col(f"_o_{c}"))

    out = [F.col(key), *[value(c).alias(c) for c in fields]]
    if "created_at" in old.columns:
        out.append(F.coalesce(F.col("_o_created_at"), now).alias("created_at"))
    if "updated_at" in old.columns:
        out.append(F.when(written, now).otherwise(F.col("_o_updated_at")).alias("updated_at"))
    return both.select(*out).select(*old.columns)


def update_existing(old: DataFrame, new: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """The table with updates applied, and the updates that hit no row."""
    return partial_update(old, new, key), new.join(old.select(key), key, "left_anti")


def put_embeddings(nodes: DataFrame, vectors: DataFrame, key: str = "id") -> DataFrame:
    """Nodes with new vectors where there are any."""
    joined = nodes.join(vectors.select(key, F.col("embedding").alias("_v")), key, "left")
    return joined.withColumn("embedding", F.coalesce("_v", "embedding")).select(*nodes.columns)


def remove_documents(tables: dict[str, DataFrame], documents: DataFrame) -> dict[str, DataFrame]:
    """``documents, parent_chunks, chunks, mentions`` without the documents (column ``id``); unknown ones change nothing.

    The entities they mentioned are returned under ``touched``, for the clean-up of orphans.
    """
    gone = documents.select("id").distinct()
    by_document = gone.withColumnRenamed("id", "document_id")
    lost = tables["chunks"].join(by_document, "document_id", "left_semi").select(F.col("id").alias("chunk_id"))
    return {
        "documents": tables["documents"].join(gone, "id", "left_anti"),
        "parent_chunks": tables["parent_chunks"].join(by_document, "document_id", "left_anti"),
        "chunks": tables["chunks"].join(by_document, "document_id", "left_anti"),
        "mentions": tables["mentions"].join(lost, "chunk_id", "left_anti"),
        "touched": tables["mentions"].join(lost, "chunk_id", "left_semi").select("entity_id").distinct(),
    }


def merge_first(rows: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """The first row of each key in order of arrival."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


# --- cache --------------------------------------------------------------------------------------------------------


def cache_put(cache: DataFrame, entries: DataFrame, now: datetime, ttl_seconds: int = 86_400) -> DataFrame:
    """The cache ``key, value, expires_at`` with new entries ``key, value``."""
    stamp = F.lit(str(now)).cast("timestamp_ntz")
    fresh = entries.select("key", "value", (stamp + F.make_dt_interval(secs=F.lit(ttl_seconds).cast("decimal(18,6)"))).alias("expires_at"))
    return cache.join(fresh.select("key"), "key", "left_anti").unionByName(fresh)


def cache_get(cache: DataFrame, keys: DataFrame, now: datetime) -> DataFrame:
    return cache.where(F.col("expires_at") > F.lit(str(now)).cast("timestamp_ntz")).join(keys.select("key"), "key", "left_semi").select("key", "value")


def cache_drop(cache: DataFrame, pattern: str) -> DataFrame:
    """Without the keys that match a pattern with ``*``."""
    return cache.where(~F.col("key").rlike("^" + ".*".join(f"\\Q{p}\\E" for p in pattern.split("*")) + "$"))


# --- copies and checks --------------------------------------------------------------------------------------------


def backup(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def restore(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def wipe(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {name: df.limit(0) for name, df in tables.items()}


def migrate(relational: dict[str, DataFrame], foreign_keys: dict[str, tuple[str, str]], path: str | None = None) -> dict[str, DataFrame]:
    """Relational tables with numeric keys to document tables with ids by content: keys and foreign keys are mapped by joins.

    ``foreign_keys``: table to (column, parent table), parents before children. With ``path``, every table is also written.
    """
    out: dict[str, DataFrame] = {}
    ids: dict[str, DataFrame] = {}
    for name, df in relational.items():
        mapped = df.withColumn("_id", F.substring(F.md5(F.concat(F.lit(f"{name}:"), F.col("id").cast("string"))), 1, 20))
        ids[name] = mapped.select("id", "_id")
        if name in foreign_keys:
            column, parent = foreign_keys[name]
            mapped = mapped.join(ids[parent].select(F.col("id").alias(column), F.col("_id").alias("_parent")), column, "left").withColumn(column, F.col("_parent")).drop("_parent")
        out[name] = mapped.withColumn("id", F.col("_id")).select(*df.columns)
        if path is not None:
            out[name].write.mode("overwrite").parquet(f"{path}/{name}")
    return out


def parity(source: dict[str, DataFrame], target: dict[str, DataFrame], key: str = "id") -> DataFrame:
    """``table, source, target, missing, extra``: row counts, and keys that are on one side only."""
    parts = []
    for name, s in source.items():
        a = s.select(F.col(key).alias("k"), F.lit(1).alias("s"), F.lit(0).alias("t"))
        b = target[name].select(F.col(key).alias("k"), F.lit(0).alias("s"), F.lit(1).alias("t"))
        per_key = a.unionByName(b).groupBy("k").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
        parts.append(per_key.agg(
            F.lit(name).alias("table"), F.coalesce(F.sum("s"), F.lit(0)).alias("source"), F.coalesce(F.sum("t"), F.lit(0)).alias("target"),
            F.count_if(F.col("t") == 0).alias("missing"), F.count_if(F.col("s") == 0).alias("extra"),
        ).select("table", "source", "target", "missing", "extra"))
    return reduce(DataFrame.unionByName, parts)

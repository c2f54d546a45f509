"""Queries over the document store, its sources and copies: round trips through files in the shared folder."""

from __future__ import annotations

import uuid
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import store
from ..operators import telemetry as m
from ..operators.graph import shared_folder, union_all
from ..sources import documents, json_store
from .registry import query
from .roles import USAGE, t, usage


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _saved(spark: SparkSession, d: str) -> DataFrame:
    """Nations and customers as documents below their regions, written as JSON and read again."""
    n, c = t(spark, d, "nation"), t(spark, d, "customer")
    nations = n.select(F.concat(F.lit("regions/"), F.col("n_regionkey").cast("string"), F.lit("/nations/"), F.col("n_nationkey").cast("string")).alias("path"), F.to_json(F.struct(F.col("n_name").alias("name"), F.struct(F.col("n_nationkey").alias("key")).alias("meta"))).alias("data"))
    customers = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("regions/"), F.col("n_regionkey").cast("string"), F.lit("/nations/"), F.col("n_nationkey").cast("string"), F.lit("/customers/"), F.col("c_custkey").cast("string")).alias("path"),
        F.to_json(F.struct(F.col("c_name").alias("name"), F.struct(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment")).alias("meta"))).alias("data"),
    )
    path = _folder(spark, "json-store")
    json_store.save(nations.unionByName(customers).select("path", F.parse_json("data").alias("data")), path)
    return json_store.load(spark, path)


@query("s08_json_round_trip", """SELECT 'regions/' || n_regionkey || '/nations/' || n_nationkey || '/customers/' || c_custkey AS path, c_name AS name, c_custkey AS key, c_mktsegment AS segment FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'regions/' || n_regionkey || '/nations/' || n_nationkey, n_name, n_nationkey, NULL FROM nation""")
def _(spark, d):
    s = _saved(spark, d)
    return s.select("path", json_store.field(F.col("data"), "name").alias("name"), json_store.field(F.col("data"), "meta.key", "long").alias("key"), json_store.field(F.col("data"), "meta.segment").alias("segment"))


@query("s07_subcollections", """SELECT 'regions/' || n_regionkey || '/nations/' || n_nationkey AS document, 'customers' AS name FROM nation WHERE n_regionkey <= 2 AND n_nationkey IN (SELECT c_nationkey FROM customer)""")
def _(spark, d):
    s = _saved(spark, d)
    paths = [r.path for r in t(spark, d, "nation").where("n_regionkey <= 2").select(F.concat(F.lit("regions/"), F.col("n_regionkey").cast("string"), F.lit("/nations/"), F.col("n_nationkey").cast("string")).alias("path")).collect()]  # a handful of documents
    return union_all([json_store.subcollections(s, p).select(F.lit(p).alias("document"), "name") for p in paths])


@query("s13_content_origin", """WITH x AS (SELECT doc_id, 'd' || doc_id || CASE WHEN doc_id % 11 = 0 THEN ' !' ELSE '' END AS id, CASE WHEN doc_id % 4 = 0 THEN text WHEN doc_id % 4 = 1 THEN '  ' END AS inline,
    CASE WHEN doc_id % 3 = 0 THEN text || ' f' END AS file, CASE WHEN doc_id % 5 < 2 THEN text || ' s' END AS stored, CASE WHEN doc_id % 2 = 1 THEN text || ' p' END AS pdf FROM documents)
  SELECT id, md5(coalesce(nullif(CASE WHEN trim(inline) = '' THEN '' ELSE inline END, ''), file, stored, pdf)) AS content_md5, CASE WHEN trim(inline) <> '' THEN 'inline' WHEN file IS NOT NULL THEN 'file' WHEN stored IS NOT NULL THEN 'store' WHEN pdf IS NOT NULL THEN 'pdf' END AS origin FROM x WHERE doc_id % 11 <> 0""")
def _(spark, d):
    """Of inline content, a file, stored content and a PDF the first that is there; ids that are not well formed have none."""
    k, name = F.col("doc_id"), F.col("doc_id").cast("string")
    x = t(spark, d, "documents")
    docs = x.select(F.concat(F.lit("d"), name, F.when(k % 11 == 0, " !").otherwise("")).alias("id"), F.when(k % 4 == 0, F.col("text")).when(k % 4 == 1, "  ").alias("content"), F.concat(F.lit("f"), name).alias("file_path"), F.concat(F.lit("p"), name).alias("pdf_path"))
    files = x.where(k % 3 == 0).select(F.concat(F.lit("f"), name).alias("path"), F.concat("text", F.lit(" f")).alias("text"))
    files = files.unionByName(x.where(k % 2 == 1).select(F.concat(F.lit("p"), name).alias("path"), F.concat("text", F.lit(" p")).alias("text")))
    stored = x.where(k % 5 < 2).select(F.concat(F.lit("d"), name).alias("id"), F.concat("text", F.lit(" s")).alias("content"))
    return documents.resolve_content(docs, files, stored).select("id", F.md5("content").alias("content_md5"), "origin")


@query("s18_put_embeddings", "SELECT vec_id AS id, label, round(CASE WHEN vec_id % 3 = 0 THEN embedding[2] WHEN vec_id % 2 = 0 THEN embedding[1] END::DOUBLE, 6) AS first FROM embeddings")
def _(spark, d):
    """A third of the vectors is replaced (by itself without the first component); nodes that had none stay without unless they get one."""
    e = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")
    nodes = e.withColumn("embedding", F.when(F.col("id") % 2 == 0, F.col("embedding")))
    new = e.where("id % 3 = 0").select("id", F.slice("embedding", 2, 99).alias("embedding"))
    return store.put_embeddings(nodes, new).select("id", "label", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"))


@query("s22_backup_and_wipe", """SELECT 'orders' AS name, count(*) AS restored, sum(o_custkey)::BIGINT AS checksum, 0::BIGINT AS wiped FROM orders UNION ALL SELECT 'part', count(*), sum(p_size)::BIGINT, 0 FROM part""")
def _(spark, d):
    tables = {"orders": t(spark, d, "orders"), "part": t(spark, d, "part")}
    path = _folder(spark, "backup")
    store.backup(tables, path)
    back, gone = store.restore(spark, path, list(tables)), store.wipe(tables)
    sums = {"orders": "o_custkey", "part": "p_size"}
    rows = [back[n].agg(F.count(F.lit(1)).alias("restored"), F.sum(c).cast("long").alias("checksum")).join(gone[n].agg(F.count(F.lit(1)).alias("wiped"))).select(F.lit(n).alias("name"), "*") for n, c in sums.items()]
    return union_all(rows)


_RANGES = {"last_7": "TIMESTAMP '2024-01-23' AND TIMESTAMP '2024-01-30 23:59:59.999999'", "last_30": "TIMESTAMP '2023-12-31' AND TIMESTAMP '2024-01-30 23:59:59.999999'", "default": "TIMESTAMP '2023-12-31 12:00:00' AND TIMESTAMP '2024-01-30 12:00:00'", "until_noon": "TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20 12:00:00'"}


@query("t07_t08_usage_in_ranges", f"WITH {USAGE} " + " UNION ALL ".join(f"SELECT '{name}' AS name, count(*) AS requests, round(sum(cost_usd), 4) AS cost FROM usage WHERE ts BETWEEN {bounds}" for name, bounds in _RANGES.items()))
def _(spark, d):
    """Preset ranges, the default one, and one with an end inside a day."""
    now = datetime(2024, 1, 30, 12, tzinfo=timezone.utc)
    ranges = {"last_7": m.preset_range(7, now.date()), "last_30": m.preset_range(30, now.date()), "default": (None, None), "until_noon": (date(2024, 1, 10), datetime(2024, 1, 20, 12))}
    rows = usage(spark, d)
    return union_all([rows.where(m.in_closed_range("ts", *m.normalise_range(*r, now))).agg(F.count(F.lit(1)).alias("requests"), F.round(F.sum("cost_usd"), 4).alias("cost")).select(F.lit(n).alias("name"), "*") for n, r in ranges.items()])

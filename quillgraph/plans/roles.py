"""The driver's tables in the roles of the data model: as DataFrames, and as CTEs for the SQL side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model

EDGE_TYPES = [*model.EDGE_WEIGHTS, "MENTIONS"]


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as occurrences of named concepts in modules."""
    e = t(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        "event_id",
        F.concat_ws(" ", "event_type", (k % 25).cast("string")).alias("name"),
        F.concat_ws(" ", "event_type", k.cast("string"), (F.col("user_id") % 40).cast("string")).alias("rare_name"),
        F.get(F.array(*[F.lit(x) for x in model.ENTITY_TYPES]), k % 6).alias("label"),
        F.concat(F.lit("m"), (F.col("user_id") % 8).cast("string")).alias("module_id"),
        F.when(k % 5 != 0, F.concat(F.col("event_type"), F.lit(" means "), (k % 7).cast("string"))).alias("definition"),
        F.when(k % 11 != 0, (k % 10) / 10.0).alias("confidence"),
        F.concat(F.lit("d"), (F.col("event_id") % 500).cast("string")).alias("document_id"),
        F.col("ts").alias("created_at"),
    )


CONCEPTS = """ev AS (SELECT *, regexp_extract(props, '([0-9]+)', 1)::INT AS k FROM events),
concepts AS (SELECT event_id, event_type || ' ' || (k % 25) AS name, event_type || ' ' || k || ' ' || (user_id % 40) AS rare_name,
  ['Topic','Concept','Methodology','Finding','Definition','Citation'][1 + k % 6] AS label, 'm' || (user_id % 8) AS module_id,
  CASE WHEN k % 5 <> 0 THEN event_type || ' means ' || (k % 7) END AS definition,
  CASE WHEN k % 11 <> 0 THEN (k % 10) / 10.0::DOUBLE END AS confidence, 'd' || (event_id % 500) AS document_id, ts AS created_at FROM ev)"""
ANALYTIC = "label IN ('Topic','Concept','Methodology','Finding')"


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.col("ts"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_id"),
        F.col("event_type").alias("provider"),
        F.concat_ws("-", "event_type", (k % 4).cast("string")).alias("model"),
        (k * 10).cast("long").alias("input_tokens"),
        (k * 3).cast("long").alias("output_tokens"),
        (k % 2).cast("long").alias("thinking_tokens"),
        F.col("value").alias("cost_usd"),
    )


USAGE = """ev AS (SELECT *, regexp_extract(props, '([0-9]+)', 1)::INT AS k FROM events),
usage AS (SELECT ts, 'u' || user_id AS session_id, event_type AS provider, event_type || '-' || (k % 4) AS model, (k * 10)::BIGINT AS input_tokens,
  (k * 3)::BIGINT AS output_tokens, (k % 2)::BIGINT AS thinking_tokens, value AS cost_usd FROM ev)"""


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("id"),
        F.concat(F.lit("what is "), F.col("event_type"), F.lit(" "), (k % 12).cast("string")).alias("query"),
        F.concat(F.lit("r"), (F.col("user_id") % 60).cast("string")).alias("result_id"),
        F.when(k % 3 == 0, k / 100.0).alias("relevance_score"),
        F.when(k % 4 != 0, k % 2 == 0).alias("helpful"),
        F.get(F.array(F.lit("explicit"), F.lit("answer"), F.lit("implicit")), k % 3).alias("feedback_type"),
        (F.col("event_type") == "click").alias("clicked"),
        (k * 150).cast("long").alias("dwell_time_ms"),
        F.when(k % 10 == 0, F.array().cast("array<string>"))
        .otherwise(F.array(F.concat(F.lit("m"), (F.col("user_id") % 8).cast("string")), F.concat(F.lit("m"), (k % 3 + 8).cast("string"))))
        .alias("module_ids"),
        (k % 2 == 0).alias("is_positive"),
        "ts",
    )


FEEDBACK = """ev AS (SELECT *, regexp_extract(props, '([0-9]+)', 1)::INT AS k FROM events),
feedback AS (SELECT 'f' || event_id AS id, 'what is ' || event_type || ' ' || (k % 12) AS query, 'r' || (user_id % 60) AS result_id,
  CASE WHEN k % 3 = 0 THEN k / 100.0::DOUBLE END AS relevance_score, CASE WHEN k % 4 <> 0 THEN k % 2 = 0 END AS helpful,
  ['explicit','answer','implicit'][1 + k % 3] AS feedback_type, event_type = 'click' AS clicked, (k * 150)::BIGINT AS dwell_time_ms,
  CASE WHEN k % 10 = 0 THEN []::VARCHAR[] ELSE ['m' || (user_id % 8), 'm' || (k % 3 + 8)] END AS module_ids, k % 2 = 0 AS is_positive, ts FROM ev)"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and parts as entities."""
    kinds = F.array(*[F.lit(x) for x in model.ANALYTIC_TYPES])
    s = t(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"),
        F.get(kinds, (F.col("s_suppkey") % 4).cast("int")).alias("label"),
        F.col("s_name").alias("name"),
        F.concat(F.lit("m"), (F.col("s_nationkey") % 5).cast("string")).alias("module_id"),
    )
    p = t(spark, sf_dir, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"),
        F.get(kinds, (F.col("p_partkey") % 4).cast("int")).alias("label"),
        F.col("p_name").alias("name"),
        F.concat(F.lit("m"), (F.col("p_size") % 5).cast("string")).alias("module_id"),
    )
    return s.unionByName(p)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as typed edges between suppliers and parts, in either direction."""
    s = F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    p = F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    outward = F.col("l_linestatus") == "O"
    kind = F.get(F.array(*[F.lit(x) for x in EDGE_TYPES]), (F.col("l_orderkey") % 10).cast("int"))
    return t(spark, sf_dir, "lineitem").select(
        F.when(outward, s).otherwise(p).alias("src_id"),
        F.when(outward, p).otherwise(s).alias("dst_id"),
        kind.alias("type"),
        F.when(F.col("l_linenumber") != 7, F.col("l_discount") * 10).alias("confidence"),
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("evidence"),
    )


GRAPH = """nodes AS (
  SELECT 's' || s_suppkey AS id, ['Topic','Concept','Methodology','Finding'][1 + s_suppkey % 4] AS label, s_name AS name, 'm' || (s_nationkey % 5) AS module_id FROM supplier
  UNION ALL SELECT 'p' || p_partkey, ['Topic','Concept','Methodology','Finding'][1 + p_partkey % 4], p_name, 'm' || (p_size % 5) FROM part),
edges AS (
  SELECT CASE WHEN l_linestatus = 'O' THEN 's' || l_suppkey ELSE 'p' || l_partkey END AS src_id,
         CASE WHEN l_linestatus = 'O' THEN 'p' || l_partkey ELSE 's' || l_suppkey END AS dst_id,
         ['DEFINES','DEPENDS_ON','USES','SUPPORTS','EXTENDS','IMPLEMENTS','CONTRADICTS','REFERENCES','RELATED_TO','MENTIONS'][1 + l_orderkey % 10] AS type,
         CASE WHEN l_linenumber <> 7 THEN l_discount * 10 END AS confidence, 'o' || l_orderkey || '-' || l_linenumber AS evidence
  FROM lineitem),
weights(type, w) AS (VALUES ('DEFINES', 1.0::DOUBLE), ('DEPENDS_ON', 0.9), ('USES', 0.8), ('SUPPORTS', 0.8), ('EXTENDS', 0.7), ('IMPLEMENTS', 0.7), ('CONTRADICTS', 0.6), ('REFERENCES', 0.5), ('RELATED_TO', 0.4))"""


def departments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("id"), F.col("r_name").alias("name"), F.substring("r_name", 1, 2).alias("code"))


def semesters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"), (F.col("n_nationkey") % 8 + 1).cast("int").alias("semester_number"), F.col("n_regionkey").cast("string").alias("department_id")
    )


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.format_string("SUBJ%03d", F.col("c_custkey")).alias("code"), F.col("c_nationkey").cast("string").alias("semester_id")
    )


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.concat(F.lit("Order "), F.col("o_orderpriority")).alias("name"),
        (F.col("o_orderkey") % 9 + 1).cast("int").alias("module_number"),
        F.col("o_custkey").cast("string").alias("subject_id"),
        F.col("o_orderstatus").alias("status"),
        F.year("o_orderdate").alias("year"),
        F.col("o_orderdate").alias("created_at"),
    )


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    statuses = F.array(F.lit("ready"), F.lit("processing"), F.lit("failed"), F.lit("pending"), F.lit(None).cast("string"))
    return t(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")).alias("id"),
        F.concat(F.lit("Note "), (F.col("l_partkey") % 7).cast("string")).alias("title"),
        F.col("l_orderkey").cast("string").alias("module_id"),
        F.get(statuses, (F.col("l_partkey") % 5).cast("int")).alias("kg_status"),
        F.col("l_shipdate").alias("created_at"),
    )


HIERARCHY = """departments AS (SELECT r_regionkey::VARCHAR AS id, r_name AS name, substr(r_name, 1, 2) AS code FROM region),
semesters AS (SELECT n_nationkey::VARCHAR AS id, n_name AS name, (n_nationkey % 8 + 1)::INT AS semester_number, n_regionkey::VARCHAR AS department_id FROM nation),
subjects AS (SELECT c_custkey::VARCHAR AS id, c_name AS name, printf('SUBJ%03d', c_custkey) AS code, c_nationkey::VARCHAR AS semester_id FROM customer),
modules AS (SELECT o_orderkey::VARCHAR AS id, 'Order ' || o_orderpriority AS name, (o_orderkey % 9 + 1)::INT AS module_number, o_custkey::VARCHAR AS subject_id,
  o_orderstatus AS status, year(o_orderdate)::INT AS year, o_orderdate AS created_at FROM orders),
notes AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS id, 'Note ' || (l_partkey % 7) AS title, l_orderkey::VARCHAR AS module_id,
  ['ready','processing','failed','pending',NULL][1 + l_partkey % 5] AS kg_status, l_shipdate AS created_at FROM lineitem)"""


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as users: a role, a department that may be unknown, and subjects of which one does not exist."""
    roles = F.array(F.lit("admin"), F.lit("staff"), F.lit("student"))
    key = F.col("c_custkey")
    return t(spark, sf_dir, "customer").select(
        key.cast("string").alias("uid"),
        F.col("c_name").alias("display_name"),
        F.get(roles, (key % 3).cast("int")).alias("role"),
        F.when(key % 4 != 0, F.lit("active")).alias("status"),
        F.when(key % 7 == 0, "99").otherwise((key % 5).cast("string")).alias("department_id"),
        F.when(key % 6 != 0, F.array((key + 1).cast("string"), (key * 2).cast("string"))).alias("subject_ids"),
    )


USERS = """users AS (SELECT c_custkey::VARCHAR AS uid, c_name AS display_name, ['admin','staff','student'][1 + c_custkey % 3] AS role,
  CASE WHEN c_custkey % 4 <> 0 THEN 'active' END AS status, CASE WHEN c_custkey % 7 = 0 THEN '99' ELSE (c_custkey % 5)::VARCHAR END AS department_id,
  CASE WHEN c_custkey % 6 <> 0 THEN [(c_custkey + 1)::VARCHAR, (c_custkey * 2)::VARCHAR] END AS subject_ids FROM customer)"""

"""Trend queries: concepts are taken from ``events``."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..operators import trends
from .registry import query
from .roles import ANALYTIC, CONCEPTS, concepts

_FREQUENCY = f"""freq AS (SELECT name, label, count(*) AS frequency, list_sort(list(DISTINCT module_id)) AS modules FROM concepts WHERE {ANALYTIC}
  GROUP BY name, label ORDER BY frequency DESC, name, label LIMIT 100)"""


@query("a01_concept_frequency", f"WITH {CONCEPTS}, {_FREQUENCY} SELECT name, label, frequency, array_to_string(modules, ',') AS modules FROM freq")
def _(spark, d):
    return trends.concept_frequency(concepts(spark, d)).withColumn("modules", F.array_join("modules", ","))


@query("a01_frequency_by_type", f"WITH {CONCEPTS}, {_FREQUENCY} SELECT label, count(*) AS concepts FROM freq GROUP BY label")
def _(spark, d):
    return trends.frequency_by_type(trends.concept_frequency(concepts(spark, d)))


@query("a01_frequency_by_module", f"WITH {CONCEPTS}, {_FREQUENCY}, x AS (SELECT unnest(modules) AS module_id FROM freq) SELECT module_id, count(*) AS concepts FROM x GROUP BY module_id")
def _(spark, d):
    return trends.frequency_by_module(trends.concept_frequency(concepts(spark, d)))


@query("f05_f06_frequency_filtered", f"""WITH {CONCEPTS} SELECT name, label, count(*) AS frequency FROM concepts
  WHERE {ANALYTIC} AND label IN ('Topic','Definition') AND module_id IN ('m1','m3') GROUP BY name, label ORDER BY frequency DESC, name, label LIMIT 100""")
def _(spark, d):
    return trends.concept_frequency(concepts(spark, d), ["m1", "m3"], ("Topic", "Definition")).drop("modules")


@query("t01_trending", f"""WITH {CONCEPTS}, cur AS (SELECT name, label, count(*) AS current FROM concepts WHERE {ANALYTIC} AND created_at >= TIMESTAMP '2024-01-16' AND created_at < TIMESTAMP '2024-01-30' GROUP BY name, label),
  prev AS (SELECT name, count(*) AS previous FROM concepts WHERE {ANALYTIC} AND created_at >= TIMESTAMP '2024-01-02' AND created_at < TIMESTAMP '2024-01-16' GROUP BY name)
  SELECT name, label, current, previous, round((current - previous) / previous::DOUBLE, 4) AS growth FROM cur JOIN prev USING (name)
  WHERE (current - previous) / previous::DOUBLE >= -0.9 ORDER BY (current - previous) / previous::DOUBLE DESC, name, label LIMIT 20""")
def _(spark, d):
    return trends.trending(concepts(spark, d), datetime(2024, 1, 16), datetime(2024, 1, 30), min_growth=-0.9)


_LINKS = "links AS (SELECT a.rare_name AS name_a, b.rare_name AS name_b FROM concepts a JOIN concepts b ON b.event_id = a.event_id + 1)"


@query("t02_emerging", f"""WITH {CONCEPTS}, {_LINKS}, found AS (SELECT rare_name AS name, label, min(created_at) AS first_seen, count(*) AS mention_count FROM concepts c
    WHERE {ANALYTIC} AND created_at >= TIMESTAMP '2024-01-20'
      AND NOT EXISTS (SELECT 1 FROM concepts o WHERE o.rare_name = c.rare_name AND o.{ANALYTIC} AND o.created_at < TIMESTAMP '2024-01-20')
    GROUP BY rare_name, label ORDER BY first_seen DESC, name, label LIMIT 20),
  pairs AS (SELECT name_a AS name, name_b AS other FROM links UNION SELECT name_b, name_a FROM links)
  SELECT f.name, label, first_seen, mention_count, coalesce((SELECT string_agg(other, ',' ORDER BY other) FROM (SELECT other FROM pairs p WHERE p.name = f.name AND other <> f.name ORDER BY other LIMIT 5)), '') AS related FROM found f""")
def _(spark, d):
    c = concepts(spark, d).drop("name").withColumnRenamed("rare_name", "name")
    links = c.alias("a").join(c.alias("b"), F.col("b.event_id") == F.col("a.event_id") + 1).select(F.col("a.name").alias("name_a"), F.col("b.name").alias("name_b"))
    return trends.emerging(c, links, datetime(2024, 1, 20)).drop("module_id").withColumn("related", F.array_join("related", ","))


for _granularity, _expr in {
    "day": "strftime(created_at, '%Y-%m-%d')",
    "week": "strftime(date_trunc('week', created_at), '%Y-%m-%d')",
    "month": "strftime(created_at, '%Y-%m')",
    "semester": "strftime(created_at, '%Y') || CASE WHEN month(created_at) <= 6 THEN '-H1' ELSE '-H2' END",
}.items():

    @query(f"t03_evolution_{_granularity}", f"""WITH {CONCEPTS} SELECT {_expr} AS bucket, count(*) AS frequency, array_to_string(list_sort(list(DISTINCT module_id)), ',') AS modules FROM concepts
      WHERE {ANALYTIC} AND lower(name) = 'click 7' AND created_at >= TIMESTAMP '2024-01-01' AND created_at < TIMESTAMP '2025-01-01' GROUP BY 1""")
    def _(spark, d, granularity=_granularity):
        return trends.evolution(concepts(spark, d), "Click 7", datetime(2024, 1, 1), datetime(2025, 1, 1), granularity).withColumn("modules", F.array_join("modules", ","))


@query("t04_definition_changes", f"WITH {CONCEPTS} SELECT substr(definition, 1, 200) AS definition, min(created_at) AS first_seen FROM concepts WHERE {ANALYTIC} AND lower(name) = 'view 3' AND definition <> '' GROUP BY definition")
def _(spark, d):
    return trends.definition_changes(concepts(spark, d), "VIEW 3")


_COMPARE = f"""da AS (SELECT DISTINCT ON (name) name, definition FROM concepts WHERE {ANALYTIC} AND module_id = 'm1' ORDER BY name, created_at DESC, event_id DESC),
  db AS (SELECT DISTINCT ON (name) name, definition FROM concepts WHERE {ANALYTIC} AND module_id = 'm2' ORDER BY name, created_at DESC, event_id DESC)"""


@query("t05_u03_compare_modules", f"""WITH {CONCEPTS}, {_COMPARE}
  SELECT coalesce(da.name, db.name) AS name, CASE WHEN db.name IS NULL THEN 'unique_to_a' WHEN da.name IS NULL THEN 'unique_to_b' ELSE 'shared' END AS side,
    CASE WHEN da.definition <> '' AND db.definition <> '' AND da.definition <> db.definition THEN substr(da.definition, 1, 200) END AS definition_a,
    CASE WHEN da.definition <> '' AND db.definition <> '' AND da.definition <> db.definition THEN substr(db.definition, 1, 200) END AS definition_b
  FROM da FULL JOIN db ON da.name = db.name""")
def _(spark, d):
    return trends.compare(concepts(spark, d), "m1", "m2")


@query("t05_module_similarity", f"""WITH {CONCEPTS}, s AS (SELECT name, bool_or(module_id = 'm1') AS a, bool_or(module_id = 'm2') AS b FROM concepts WHERE {ANALYTIC} AND module_id IN ('m1','m2') GROUP BY name)
  SELECT count_if(a AND b)::BIGINT AS shared, count_if(a AND NOT b)::BIGINT AS unique_to_a, count_if(b AND NOT a)::BIGINT AS unique_to_b, round(count_if(a AND b) / count(*)::DOUBLE, 4) AS jaccard FROM s""")
def _(spark, d):
    return trends.similarity(concepts(spark, d), "m1", "m2")


@query("t06_u04_u06_overlap", f"""WITH {CONCEPTS}, m AS (SELECT * FROM concepts WHERE {ANALYTIC} AND module_id IN ('m0','m1','m2','m3','m4')),
  f AS (SELECT DISTINCT ON (name) name, label FROM m ORDER BY name, created_at, event_id, label),
  l AS (SELECT DISTINCT ON (name, module_id) name, module_id, definition FROM m ORDER BY name, module_id, created_at DESC, event_id DESC)
  SELECT f.name, f.label, string_agg(l.module_id, ',' ORDER BY l.module_id) AS modules, coalesce(string_agg(l.module_id || '=' || l.definition, ';' ORDER BY l.module_id), '') AS definitions,
    count(*) > 1 AS shared, count(*) > 1 AND count(*) >= 2 AS bridging FROM f JOIN l ON f.name = l.name GROUP BY f.name, f.label""")
def _(spark, d):
    out = trends.overlap(concepts(spark, d), ["m0", "m1", "m2", "m3", "m4"])
    pairs = F.transform(F.map_entries("definitions"), lambda x: F.concat(x["key"], F.lit("="), x["value"]))
    return out.withColumns({"modules": F.array_join("modules", ","), "definitions": F.array_join(F.array_sort(pairs), ";")})


@query("u05_jaccard_matrix", f"""WITH {CONCEPTS}, s AS (SELECT DISTINCT module_id, name FROM concepts WHERE {ANALYTIC}), m AS (SELECT unnest(['m0','m1','m2','m3','m4','m5']) AS id),
  c AS (SELECT x.module_id AS a, y.module_id AS b, count(*) AS n FROM s x JOIN s y USING (name) GROUP BY 1, 2), z AS (SELECT module_id, count(*) AS n FROM s GROUP BY 1)
  SELECT p.id AS a, q.id AS b, CASE WHEN p.id = q.id THEN 1.0::DOUBLE ELSE round(coalesce(c.n, 0) / (x.n + y.n - coalesce(c.n, 0))::DOUBLE, 4) END AS jaccard
  FROM m p CROSS JOIN m q LEFT JOIN c ON c.a = p.id AND c.b = q.id LEFT JOIN z x ON x.module_id = p.id LEFT JOIN z y ON y.module_id = q.id""")
def _(spark, d):
    return trends.jaccard_matrix(concepts(spark, d), ["m0", "m1", "m2", "m3", "m4", "m5"])

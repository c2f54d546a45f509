"""Usage, feedback and job queries: rows are taken from ``events``."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..operators import telemetry as m
from .registry import query
from .roles import FEEDBACK, GRAPH, USAGE, feedback, nodes, t, usage

_RELEVANCE = "coalesce(relevance_score, CASE WHEN helpful THEN 1.0 WHEN NOT helpful THEN 0.0 ELSE 0.5 END::DOUBLE)"


@query("a12_usage_summary", f"""WITH {USAGE}, x AS (SELECT *, strftime(ts, '%Y-%m-%d') AS day FROM usage)
  SELECT CASE WHEN grouping(provider) = 1 AND grouping(day) = 1 THEN 'total' WHEN grouping(day) = 0 THEN 'day' WHEN grouping(model) = 0 THEN 'model' ELSE 'provider' END AS level,
    provider, model, day, round(sum(cost_usd), 6) AS cost, count(*) AS requests FROM x GROUP BY GROUPING SETS ((), (provider), (provider, model), (day))""")
def _(spark, d):
    return m.usage_summary(usage(spark, d))


@query("a13_session_usage", f"""WITH {USAGE} SELECT session_id, round(sum(cost_usd), 6) AS cost, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens,
  sum(thinking_tokens)::BIGINT AS thinking_tokens, count(*) AS request_count FROM usage GROUP BY session_id""")
def _(spark, d):
    return m.session_usage(usage(spark, d))


@query("a14_usage_by_model", f"WITH {USAGE} SELECT provider, model, round(sum(cost_usd), 6) AS cost, count(*) AS requests FROM usage GROUP BY 1, 2")
def _(spark, d):
    return m.by_level(m.usage_summary(usage(spark, d)), "model", "provider", "model")


@query("a14_usage_daily_of_provider", f"WITH {USAGE} SELECT strftime(ts, '%Y-%m-%d') AS day, round(sum(cost_usd), 6) AS cost, count(*) AS requests FROM usage WHERE provider = 'click' GROUP BY 1")
def _(spark, d):
    return m.by_level(m.usage_summary(usage(spark, d), "click"), "day", "day")


@query("a15_dashboard", f"""WITH {USAGE}, p AS (SELECT provider, round(sum(cost_usd), 6) AS c FROM usage GROUP BY 1)
  SELECT (SELECT provider FROM p ORDER BY c DESC, provider DESC LIMIT 1) AS top_provider, round(round(sum(cost_usd), 6) / count(*), 6) AS avg_cost_per_request FROM usage""")
def _(spark, d):
    return m.dashboard(m.usage_summary(usage(spark, d)))


@query("w08_top_models", f"WITH {USAGE} SELECT provider, model, round(sum(cost_usd), 6) AS cost FROM usage GROUP BY 1, 2 ORDER BY cost DESC, provider, model LIMIT 10")
def _(spark, d):
    return m.top_models(usage(spark, d))


_MENU = """menu AS (SELECT p_brand AS provider, CASE WHEN p_brand = 'Brand#1' THEN split_part(p_type || '/' || p_size, '/', 1) ELSE p_brand END AS vendor,
  list_sort(list(DISTINCT p_type || '/' || p_size)) AS models FROM part GROUP BY 1, 2)"""


def _menu(spark, d):
    models = t(spark, d, "part").select(F.col("p_brand").alias("provider"), F.concat_ws("/", "p_type", F.col("p_size").cast("string")).alias("model"))
    return m.model_menu(models, "Brand#1")


@query("a17_model_menu", f"WITH {_MENU} SELECT provider, vendor, array_to_string(models, ',') AS models FROM menu")
def _(spark, d):
    return _menu(spark, d).withColumn("models", F.array_join("models", ","))


@query("f28_menu_search", f"WITH {_MENU} SELECT provider, vendor, array_to_string([x FOR x IN models IF contains(lower(x), '/1')], ',') AS models FROM menu WHERE len([x FOR x IN models IF contains(lower(x), '/1')]) > 0")
def _(spark, d):
    return m.search_menu(_menu(spark, d), "/1").withColumn("models", F.array_join("models", ","))


@query("a07_feedback_stats", f"WITH {FEEDBACK} SELECT count(*) AS total, round(avg(CASE WHEN is_positive THEN 1.0 ELSE 0.0 END), 6) AS positive_ratio, round(avg({_RELEVANCE}), 6) AS avg_relevance FROM feedback")
def _(spark, d):
    return m.feedback_stats(feedback(spark, d))


@query("a07_feedback_stats_filtered", f"""WITH {FEEDBACK} SELECT count(*) AS total, round(coalesce(avg(CASE WHEN is_positive THEN 1.0 ELSE 0.0 END), 0), 6) AS positive_ratio, round(coalesce(avg({_RELEVANCE}), 0), 6) AS avg_relevance
  FROM feedback WHERE list_contains(module_ids, 'm3') AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20 23:59:59.999999'""")
def _(spark, d):
    start, end = m.normalise_range(datetime(2024, 1, 5), datetime(2024, 1, 20), datetime(2024, 2, 1))
    return m.feedback_stats(m.feedback_rows(feedback(spark, d), start, end, "m3"))


@query("a08_feedback_by_type", f"WITH {FEEDBACK} SELECT feedback_type, count(*) AS n FROM feedback GROUP BY 1")
def _(spark, d):
    return m.feedback_by_type(feedback(spark, d))


@query("a09_feedback_by_module", f"WITH {FEEDBACK}, x AS (SELECT unnest(module_ids) AS module_id FROM feedback) SELECT module_id, count(*) AS n FROM x GROUP BY 1 ORDER BY n DESC, module_id LIMIT 20")
def _(spark, d):
    return m.feedback_by_module(feedback(spark, d))


_LOW = f"""low AS (SELECT result_id, avg({_RELEVANCE}) AS a, count(*) AS n, list_sort(list(DISTINCT query))[1:5] AS queries FROM feedback GROUP BY 1 HAVING avg({_RELEVANCE}) <= 0.45 AND count(*) >= 2)"""


@query("a10_low_quality", f"WITH {FEEDBACK}, {_LOW} SELECT result_id, round(a, 6) AS avg_relevance, n, array_to_string(queries, '|') AS queries FROM low")
def _(spark, d):
    return m.low_quality(feedback(spark, d), 0.45).withColumn("queries", F.array_join("queries", "|"))


_ENTRIES = f"""entries AS (SELECT feedback_type AS kind, substr(repeat(query || ' ', 40), 1, 500) AS query, result_id, ts,
  CASE feedback_type WHEN 'explicit' THEN coalesce(relevance_score >= 0.5, false) WHEN 'answer' THEN coalesce(helpful, false) ELSE clicked OR dwell_time_ms > 5000 END AS is_positive FROM feedback)"""


def _entries(spark, d):
    rows = feedback(spark, d).withColumn("query", F.repeat(F.concat("query", F.lit(" ")), 40))
    parts = [m.feedback_entries(rows.where(F.col("feedback_type") == kind), kind) for kind in ("explicit", "answer", "implicit")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("s25_feedback_entries", f"WITH {FEEDBACK}, {_ENTRIES} SELECT kind AS feedback_type, query, result_id, ts, is_positive FROM entries")
def _(spark, d):
    return _entries(spark, d).select("feedback_type", "query", "result_id", "ts", "is_positive")


@query("s25_feedback_links", f"WITH {FEEDBACK}, {_ENTRIES}, n AS (SELECT DISTINCT 'r' || s_suppkey AS id FROM supplier) SELECT result_id AS dst_id, count(DISTINCT (kind, query, ts)) AS entries FROM entries WHERE result_id IN (SELECT id FROM n) GROUP BY 1")
def _(spark, d):
    results = t(spark, d, "supplier").select(F.concat(F.lit("r"), F.col("s_suppkey").cast("string")).alias("id"))
    return m.feedback_links(_entries(spark, d), results).groupBy("dst_id").agg(F.count(F.lit(1)).alias("entries"))


@query("w10_recent", "SELECT event_id AS id, ts FROM events ORDER BY ts DESC NULLS LAST, event_id LIMIT 10")
def _(spark, d):
    return m.recent(t(spark, d, "events").select(F.col("event_id").alias("id"), "ts"))


@query("j20_result_labels", f"WITH {FEEDBACK}, {GRAPH}, r AS (SELECT DISTINCT result_id FROM feedback) SELECT result_id, coalesce(label, 'Unknown') AS label FROM r LEFT JOIN nodes ON id = 's' || (substr(result_id, 2)::INT * 3)")
def _(spark, d):
    results = feedback(spark, d).select("result_id").distinct()
    named = nodes(spark, d).where("id like 's%'").withColumn("n", F.substring("id", 2, 9).cast("int")).where("n % 3 = 0").select(F.concat(F.lit("r"), (F.col("n") / 3).cast("int").cast("string")).alias("id"), "label")
    return m.with_result_label(results, named)


@query("f11_latest_feedback", f"""WITH {FEEDBACK} SELECT id, query, result_id, feedback_type, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts FROM feedback ORDER BY feedback.ts DESC, id LIMIT 100""")
def _(spark, d):
    return m.latest_feedback(feedback(spark, d)).select("feedback.*")


@query("t09_retention", f"""WITH {FEEDBACK}, gone AS (SELECT id FROM feedback WHERE ts < TIMESTAMP '2024-01-11' ORDER BY ts, id LIMIT 1000)
  SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM feedback WHERE id NOT IN (SELECT id FROM gone) GROUP BY 1""")
def _(spark, d):
    left = m.retained(feedback(spark, d), datetime(2024, 2, 10), 30)
    return left.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("t10_implicit_positive", f"""WITH {FEEDBACK} SELECT feedback_type, count_if(coalesce(clicked, false) OR coalesce(dwell_time_ms > 5000, false))::BIGINT AS implicit, count_if(coalesce(relevance_score >= 0.5, false))::BIGINT AS explicit
  FROM feedback GROUP BY 1""")
def _(spark, d):
    f = feedback(spark, d)
    return f.groupBy("feedback_type").agg(
        F.count_if(m.implicit_positive(F.col("clicked"), F.col("dwell_time_ms"))).alias("implicit"), F.count_if(m.explicit_positive(F.col("relevance_score"))).alias("explicit")
    )


@query("t11_progress_state", """SELECT CASE WHEN p < 10 THEN 'validating' WHEN p < 25 THEN 'parsing' WHEN p < 30 THEN 'chunking' WHEN p < 50 THEN 'embedding' WHEN p < 70 THEN 'extracting' WHEN p < 90 THEN 'storing' ELSE 'finalizing' END AS state,
  count(*) AS n FROM (SELECT regexp_extract(props, '([0-9]+)', 1)::INT AS p FROM events) GROUP BY 1""")
def _(spark, d):
    return t(spark, d, "events").groupBy(m.progress_state(F.get_json_object("props", "$.k").cast("int")).alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("r01_latest_state", "SELECT DISTINCT ON (user_id) user_id, ts, event_type FROM events ORDER BY user_id, ts DESC, event_type DESC")
def _(spark, d):
    return m.latest_state(t(spark, d, "events"), "user_id", "ts", "event_type")


@query("w11_eviction", """WITH jobs AS (SELECT event_id::VARCHAR AS id, CASE event_type WHEN 'click' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END AS status, ts AS updated_at FROM events),
  a AS (SELECT * FROM jobs WHERE status = 'running'), e AS (SELECT *, row_number() OVER (ORDER BY updated_at, id) AS r FROM jobs WHERE status <> 'running' AND updated_at >= TIMESTAMP '2024-01-25')
  SELECT id, status, updated_at FROM a UNION ALL SELECT id, status, updated_at FROM e WHERE r <= greatest(0, 7000 - (SELECT count(*) FROM a))""")
def _(spark, d):
    status = F.when(F.col("event_type") == "click", "completed").when(F.col("event_type") == "error", "failed").otherwise("running")
    jobs = t(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), status.alias("status"), F.col("ts").alias("updated_at"))
    return m.evict(jobs, datetime(2024, 1, 30), ttl_seconds=5 * 86400, cap=7000)


@query("a22_latency", """SELECT min(value) AS min, median(value) AS median, round(avg(value), 6) AS mean, list_sort(list(value))[greatest(1, floor(0.95 * count(value))::INT)] AS p95, max(value) AS max FROM events""")
def _(spark, d):
    return m.latency_stats(t(spark, d, "events"), "value")


@query("r03_rate_limit", "SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS window_start, count(*) AS requests FROM events GROUP BY 1, 2 HAVING count(*) > 3")
def _(spark, d):
    return m.over_limit(t(spark, d, "events"), "event_type", "ts", 3600, 3)

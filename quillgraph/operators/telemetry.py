"""Usage cost, feedback quality, job and task telemetry."""

from __future__ import annotations

from datetime import UTC, date, datetime, time, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# --- time ranges -------------------------------------------------------------------------------------------------


def normalise_range(start: datetime | date | None, end: datetime | date | None, now: datetime) -> tuple[datetime, datetime]:
    """A closed range in UTC. A bare end date (or naive midnight) means the end of that day; the start defaults to 30 days before now."""

    def as_datetime(x: datetime | date) -> datetime:
        return x if isinstance(x, datetime) else datetime.combine(x, time())

    if end is None:
        upper = now
    else:
        upper = as_datetime(end)
        if upper.tzinfo is None:
            if upper.time() == time():
                upper = datetime.combine(upper.date(), time.max)
            upper = upper.replace(tzinfo=UTC)
    lower = now - timedelta(days=30) if start is None else as_datetime(start)
    return (lower.replace(tzinfo=UTC) if lower.tzinfo is None else lower), upper


PRESET_DAYS = (7, 30, 90)


def preset_range(days: int, today: date) -> tuple[date, date]:
    if days not in PRESET_DAYS:
        raise ValueError(f"no preset of {days} days")
    return today - timedelta(days=days), today


def in_closed_range(column: str, start: datetime | None, end: datetime | None) -> Column:
    keep = F.lit(True)
    for bound, holds in ((start, lambda x: F.col(column) >= x), (end, lambda x: F.col(column) <= x)):
        if bound is not None:
            naive = bound.astimezone(UTC).replace(tzinfo=None) if bound.tzinfo else bound
            keep = keep & holds(F.lit(str(naive)).cast("timestamp_ntz"))
    return keep


# --- usage -------------------------------------------------------------------------------------------------------


def usage_summary(usage: DataFrame, provider: str | None = None) -> DataFrame:
    """Cost and requests in all, by provider, by (provider, model) and by UTC day: one pass with grouping sets.

    ``level`` says which grouping a row belongs to.
    """
    rows = usage if provider is None else usage.where(F.col("provider") == provider)
    rows = rows.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    grouped = rows.groupingSets([[], ["provider"], ["provider", "model"], ["day"]], "provider", "model", "day").agg(
        F.sum("cost_usd").alias("cost"), F.count(F.lit(1)).alias("requests"), F.grouping_id().alias("_g")
    )
    level = F.when(F.col("_g") == 7, "total").when(F.col("_g") == 3, "provider").when(F.col("_g") == 1, "model").otherwise("day")
    return grouped.select(level.alias("level"), "provider", "model", "day", F.round("cost", 6).alias("cost"), "requests")


def by_level(summary: DataFrame, level: str, *keys: str) -> DataFrame:
    return summary.where(F.col("level") == level).select(*keys, "cost", "requests")


def session_usage(usage: DataFrame) -> DataFrame:
    return usage.groupBy("session_id").agg(
        F.round(F.sum("cost_usd"), 6).alias("cost"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.sum("thinking_tokens").alias("thinking_tokens"), F.count(F.lit(1)).alias("request_count"),
    )


def dashboard(summary: DataFrame) -> DataFrame:
    """Top provider by cost and average cost per request (0 when there are none)."""
    top = F.max_by("provider", F.when(F.col("level") == "provider", F.struct("cost", "provider")))
    total, n = F.max(F.when(F.col("level") == "total", F.col("cost"))), F.max(F.when(F.col("level") == "total", F.col("requests")))
    return summary.agg(top.alias("top_provider"), F.round(F.coalesce(F.try_divide(total, n), F.lit(0.0)), 6).alias("avg_cost_per_request"))


def top_models(usage: DataFrame, n: int = 10) -> DataFrame:
    return usage.groupBy("provider", "model").agg(F.round(F.sum("cost_usd"), 6).alias("cost")).orderBy(F.desc("cost"), "provider", "model").limit(n)


def model_menu(models: DataFrame, routed_provider: str) -> DataFrame:
    """Provider, then vendor (the part before ``/`` for the routed provider, else the provider itself), then its models in order."""
    vendor = F.when(F.col("provider") == routed_provider, F.substring_index("model", "/", 1)).otherwise(F.col("provider"))
    grouped = models.select("provider", vendor.alias("vendor"), "model").distinct().groupBy("provider", "vendor").agg(F.array_sort(F.collect_list("model")).alias("models"))
    return grouped


def search_menu(menu: DataFrame, query: str) -> DataFrame:
    """Keeps the models whose name contains the query, and groups that still have some."""
    kept = F.filter("models", lambda m: F.lower(m).contains(query.lower()))
    return menu.withColumn("models", kept).where(F.size("models") > 0)


# --- feedback ----------------------------------------------------------------------------------------------------


def effective_relevance() -> Column:
    """A rating if there is one, else 1, 0 or 0.5 for helpful, unhelpful and unknown."""
    return F.coalesce(F.col("relevance_score"), F.when(F.col("helpful"), 1.0).when(~F.col("helpful"), 0.0).otherwise(0.5))


def implicit_positive(clicked: Column, dwell_ms: Column) -> Column:
    return F.coalesce(clicked, F.lit(False)) | F.coalesce(dwell_ms > 5000, F.lit(False))


def explicit_positive(relevance: Column) -> Column:
    return F.coalesce(relevance >= 0.5, F.lit(False))


def feedback_entries(rows: DataFrame, kind: str) -> DataFrame:
    """Feedback as it is stored: an id made from what tells entries apart, so that a repeated delivery is the same entry, the query's first 500 characters, and whether it is positive.

    ``kind``: ``explicit`` (rated 0.5 or more is positive), ``answer`` (helpful) or ``implicit`` (a click, or a dwell of over five seconds).
    """
    positive = {
        "explicit": lambda: explicit_positive(F.col("relevance_score")),
        "answer": lambda: F.coalesce(F.col("helpful"), F.lit(False)),
        "implicit": lambda: implicit_positive(F.col("clicked"), F.col("dwell_time_ms")),
    }
    if kind not in positive:
        raise ValueError(f"unknown kind of feedback {kind!r}")
    told = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("query", "result_id", "session_id", "user_id", "ts") if c in rows.columns]
    ident = F.concat(F.lit("fb_"), F.substring(F.sha2(F.concat_ws("\x1f", F.lit(kind), *told), 256), 1, 12))
    return rows.withColumns({"id": ident, "query": F.substring("query", 1, 500), "feedback_type": F.lit(kind), "is_positive": positive[kind]()})


def feedback_links(entries: DataFrame, nodes: DataFrame) -> DataFrame:
    """``src_id, dst_id, type``: one edge from each entry to the result that it is about, if there is such a node."""
    about = entries.where(F.col("result_id").isNotNull()).select(F.col("id").alias("src_id"), F.col("result_id").alias("dst_id")).distinct()
    return about.join(nodes.select(F.col("id").alias("dst_id")), "dst_id", "left_semi").select("src_id", "dst_id", F.lit("FEEDBACK_FOR").alias("type"))


def append_feedback(entries: DataFrame, nodes: DataFrame, path: str) -> None:
    """Appends entries to ``path/feedback`` and their links to ``path/links``."""
    entries.write.mode("append").parquet(f"{path}/feedback")
    feedback_links(entries, nodes).write.mode("append").parquet(f"{path}/links")


def recent(rows: DataFrame, time_column: str = "ts", limit: int = 10) -> DataFrame:
    """The newest rows, ten if not said otherwise; of equally new ones those whose ids sort first."""
    return rows.orderBy(F.col(time_column).desc_nulls_last(), "id").limit(limit)


def feedback_rows(feedback: DataFrame, start: datetime | None = None, end: datetime | None = None, module: str | None = None) -> DataFrame:
    rows = feedback.where(in_closed_range("ts", start, end))
    return rows if module is None else rows.where(F.array_contains("module_ids", module))


def feedback_stats(rows: DataFrame) -> DataFrame:
    positive = F.avg(F.when(F.col("is_positive"), 1.0).otherwise(0.0))
    return rows.agg(
        F.count(F.lit(1)).alias("total"), F.round(F.coalesce(positive, F.lit(0.0)), 6).alias("positive_ratio"), F.round(F.coalesce(F.avg(effective_relevance()), F.lit(0.0)), 6).alias("avg_relevance")
    )


def feedback_by_type(rows: DataFrame) -> DataFrame:
    return rows.groupBy("feedback_type").agg(F.count(F.lit(1)).alias("n"))


def feedback_by_module(rows: DataFrame, limit: int = 20) -> DataFrame:
    return rows.select(F.explode("module_ids").alias("module_id")).groupBy("module_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "module_id").limit(limit)


def low_quality(rows: DataFrame, threshold: float = 0.3, at_least: int = 2, samples: int = 5) -> DataFrame:
    """Results that are rated at ``threshold`` at most by ``at_least`` rows, with a few of their queries."""
    rated = rows.where(F.col("result_id").isNotNull())
    grouped = rated.groupBy("result_id").agg(F.avg(effective_relevance()).alias("_avg"), F.count(F.lit(1)).alias("n"))
    low = grouped.where((F.col("_avg") <= threshold) & (F.col("n") >= at_least))
    asked = rated.where(F.col("query").isNotNull()).select("result_id", "query").distinct()
    first = asked.withColumn("_r", F.row_number().over(Window.partitionBy("result_id").orderBy("query"))).where(F.col("_r") <= samples)
    queries = first.groupBy("result_id").agg(F.array_sort(F.collect_list("query")).alias("queries"))  # samples rows at most
    kept = low.join(queries, "result_id", "left").withColumn("queries", F.coalesce("queries", F.array().cast("array<string>"))).orderBy("_avg", F.desc("n"), "result_id")
    return kept.select("result_id", F.round("_avg", 6).alias("avg_relevance"), "n", "queries")


def with_result_label(results: DataFrame, nodes: DataFrame) -> DataFrame:
    """The label of each result's node, ``Unknown`` where there is none."""
    known = nodes.select(F.col("id").alias("result_id"), "label")
    return results.join(known, "result_id", "left").withColumn("label", F.coalesce("label", F.lit("Unknown")))


def latest_feedback(rows: DataFrame, limit: int = 100) -> DataFrame:
    """The newest rows as one struct each, times as text."""
    newest = rows.orderBy(F.desc("ts"), "id").limit(limit)
    return newest.select(F.struct("id", "query", "result_id", "feedback_type", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts")).alias("feedback"))


def retained(rows: DataFrame, now: datetime, days: int, per_call: int = 1000) -> DataFrame:
    """The rows left after one call that deletes the oldest of those older than ``days``, at most ``per_call``.

    The rows to delete are few by definition, so they are found by a top-k and removed by an anti-join.
    """
    old = rows.where(F.col("ts") < F.lit(str(now - timedelta(days=days))).cast("timestamp_ntz"))
    gone = old.orderBy("ts", "id").limit(per_call).select("id")
    return rows.join(gone, "id", "left_anti")


# --- jobs and tasks ----------------------------------------------------------------------------------------------


def progress_state(progress: Column) -> Column:
    # Upper bounds of progress and what a task is doing until then.
    steps = ((10, "validating"), (25, "parsing"), (30, "chunking"), (50, "embedding"), (70, "extracting"), (90, "storing"))
    state = F.lit("finalizing")
    for bound, name in reversed(steps):
        state = F.when(progress < bound, name).otherwise(state)
    return state


def latest_state(events: DataFrame, key: str, time_column: str, value: str) -> DataFrame:
    """The last reported value of each key."""
    return events.groupBy(key).agg(F.max(time_column).alias(time_column), F.max_by(value, F.struct(time_column, value)).alias(value))


def evict(jobs: DataFrame, now: datetime, ttl_seconds: int = 300, cap: int = 100, keep: str = "oldest", terminal: tuple[str, ...] = ("completed", "failed")) -> DataFrame:
    """Jobs that survive: active ones always; terminal ones within their time to live, as far as the cap leaves room.

    ``keep``: which terminal ones the cap spares, the oldest by ``updated_at`` (what the tests of the service pin) or the newest.
    Only ``cap`` terminal jobs at most can stay, so a top-k finds them and only these are ranked.
    """
    is_terminal = F.col("status").isin(*terminal)
    fresh = jobs.where(~is_terminal | (F.col("updated_at") >= F.lit(str(now - timedelta(seconds=ttl_seconds))).cast("timestamp_ntz")))
    active, ended = fresh.where(~is_terminal), fresh.where(is_terminal)
    order = [F.asc("updated_at") if keep == "oldest" else F.desc("updated_at"), F.asc("id")]
    room = F.greatest(F.lit(0), F.lit(cap) - F.col("_active"))
    first = ended.orderBy(*order).limit(cap)
    ranked = first.withColumn("_rank", F.row_number().over(Window.orderBy(*order))).join(F.broadcast(active.agg(F.count(F.lit(1)).alias("_active"))), how="inner")
    return active.unionByName(ranked.where(F.col("_rank") <= room).select(*jobs.columns))


def latency_stats(samples: DataFrame, column: str) -> DataFrame:
    """Minimum, median, mean, discrete 95th percentile (element int(0.95 n) of the sorted values, from 1) and maximum.

    The percentile aggregates merge counts of values, so no task holds all samples.
    """
    n = max(1, samples.where(F.col(column).isNotNull()).count())
    place = (max(1, int(0.95 * n)) - 0.5) / n
    p95 = F.expr(f"percentile_disc({place!r}D) WITHIN GROUP (ORDER BY `{column}`)")
    return samples.agg(F.min(column).alias("min"), F.median(column).alias("median"), F.round(F.avg(column), 6).alias("mean"), p95.alias("p95"), F.max(column).alias("max"))


def over_limit(requests: DataFrame, key: str, time_column: str, seconds: int = 60, limit: int = 60) -> DataFrame:
    """Tumbling windows in which a key makes more requests than allowed."""
    counted = requests.groupBy(key, F.window(time_column, f"{seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("requests"))
    return counted.where(F.col("requests") > limit).select(key, F.col("w.start").alias("window_start"), "requests")

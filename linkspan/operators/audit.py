"""Audit and access events: summaries, latency, pages, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspan import codes

PERIOD_DAYS = {"weekly": 7, "monthly": 30}


def in_period(period: str, now: Column, start: str | None = None, end: str | None = None,
              column: str = "event_time") -> Column:
    """Condition of a report period: custom dates (whole days), or the last 1, 7
    or 30 days before `now`; an unknown period is one day."""
    time = F.col(column)
    if period == "custom" and start and end:
        return (time >= F.lit(f"{start} 00:00:00").cast("timestamp")) & (
            time < F.lit(f"{end} 00:00:00").cast("timestamp") + F.expr("INTERVAL 1 DAY")
        )
    return time >= days_before(now, F.lit(PERIOD_DAYS.get(period, 1)))


def days_before(now: Column, days: Column) -> Column:
    return now - F.make_dt_interval(days)


def both_logs(audit: DataFrame, access: DataFrame) -> DataFrame:
    names = ["event_time", "result", "latency_ms"]
    return audit.select(*names).unionByName(access.select(*names))


def outcome_counts(audit: DataFrame, access: DataFrame, condition: Column) -> DataFrame:
    """Successful and failed events of both logs, as one row."""
    return both_logs(audit, access).filter(condition).agg(
        F.count_if(F.col("result") == "SUCCESS").alias("success"),
        F.count_if(F.col("result") == "FAILED").alias("failed"),
    )


def latency_chart(audit: DataFrame, access: DataFrame, condition: Column, period: str) -> DataFrame:
    """Mean latency by day, or by hour of the day for a one-day period."""
    label = "yyyy-MM-dd" if period in ("weekly", "monthly", "custom") else "HH:00"
    measured = both_logs(audit, access).filter(condition & (F.col("latency_ms") > 0))
    return measured.groupBy(F.date_format("event_time", label).alias("time")).agg(
        F.round(F.avg("latency_ms"), 0).alias("latency")
    )


def audit_log(audit: DataFrame, condition: Column) -> DataFrame:
    return audit.filter(condition).select(
        "id", "event_time", F.col("actor_org_id").alias("actor"), "action", "resource_id",
        "result", "latency_ms",
    )


def access_log(access: DataFrame, condition: Column) -> DataFrame:
    return access.filter(condition).select(
        "id", "event_time", F.col("actor_user_id").alias("actor"), "action", "resource_type",
        "resource_id", "ip_address", "result", "latency_ms",
    )


def newest_events(log: DataFrame, number: int, size: int) -> DataFrame:
    return log.orderBy(F.col("event_time").desc(), F.col("id").desc()).offset((number - 1) * size).limit(size)


LOG_TYPES = ("AUDIT_LOG", "ACCESS_LOG")


def retention_days(policies: DataFrame, log_type: str) -> Column:
    """Days of the active policy for a log, 30 without one."""
    active = policies.filter((F.col("resource_type") == log_type) & (F.col("status") == "ACTIVE"))
    days = active.agg(F.max_by("retention_days", "id").alias("days")).scalar()
    return F.coalesce(days, F.lit(codes.RETENTION_DAYS)).cast("int")


def keep_recent(events: DataFrame, policies: DataFrame, log_type: str, now: Column) -> DataFrame:
    """Events that are not older than their log's policy allows."""
    cutoff = days_before(now, retention_days(policies, log_type))
    return events.filter(~F.coalesce(F.col("event_time") < cutoff, F.lit(False)))


def retention_actions(policies: DataFrame, now: Column) -> DataFrame:
    """One row per log type for a retention run."""
    spark = policies.sparkSession
    logs = spark.createDataFrame([(t,) for t in LOG_TYPES], "resource_type string")
    active = policies.filter(
        (F.col("status") == "ACTIVE") & F.col("resource_type").isin(*LOG_TYPES)
    ).groupBy("resource_type").agg(F.max("id").alias("policy_id"))
    return logs.join(active, "resource_type", "left").select(
        F.coalesce(F.col("policy_id").cast("long"), F.lit(0).cast("long")).alias("policy_id"),
        "resource_type", F.lit("SUCCESS").alias("action_status"), now.alias("executed_at"),
    )


def retention_summary(actions: DataFrame) -> DataFrame:
    """Runs, successful runs and the time of the last one."""
    last = F.date_format(F.max("executed_at"), "yyyy-MM-dd HH:mm:ss")
    return actions.agg(
        F.count(F.lit(1)).alias("total_executions"),
        F.count_if(F.col("action_status") == "SUCCESS").alias("success_executions"),
        F.coalesce(last, F.lit("Never")).alias("last_execution"),
    )


EVENT_SCHEMA = (
    "event_time timestamp, actor_user_id string, actor_org_id string, action string, "
    "resource_type string, resource_id string, before_state string, after_state string, "
    "result string, latency_ms long"
)


def job_event(summary: DataFrame, action: str, result: str, latency_ms: int, now: Column,
              actor: str = "system_auto", user: str = "system_poc") -> DataFrame:
    """One audit event per file of a job summary; the summary goes into
    after_state as JSON."""
    state = F.to_json(F.struct(*summary.columns))
    return summary.select(
        now.alias("event_time"), F.lit(user).alias("actor_user_id"),
        F.lit(actor).alias("actor_org_id"), F.lit(action).alias("action"),
        F.lit("FILE").alias("resource_type"), F.col("file_id").alias("resource_id"),
        F.lit(None).cast("string").alias("before_state"), state.alias("after_state"),
        F.lit(result).alias("result"), F.lit(latency_ms).cast("long").alias("latency_ms"),
    )


ACCESS_SCHEMA = (
    "event_time timestamp, actor_user_id string, action string, resource_type string, "
    "resource_id string, ip_address string, result string, latency_ms long"
)


def access_events(requests: DataFrame, actor: str = "anonymous_poc") -> DataFrame:
    """Requests (event_time, action, resource_type, resource_id, ip_address, result,
    latency_ms) as access events; those without an actor of their own get `actor`."""
    named = F.col("actor_user_id") if "actor_user_id" in requests.columns else F.lit(None).cast("string")
    return requests.withColumn("actor_user_id", F.coalesce(named, F.lit(actor))).select(
        "event_time", "actor_user_id", "action", "resource_type", "resource_id", "ip_address", "result",
        F.col("latency_ms").cast("long").alias("latency_ms"),
    )

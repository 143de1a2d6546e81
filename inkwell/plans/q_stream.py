"""The stream transformations over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkwell.plans.q_quality import NORM
from inkwell.plans.registry import query
from inkwell.sources.tables import table
from inkwell.streaming import judged as S


@query("st1_windowed_labels", f"SELECT time_bucket(INTERVAL 1 HOUR, judged_at) AS window_start, {NORM.format(c='tp_fp_label')} AS label, count(*) AS n, sum(total_tokens)::BIGINT AS tokens FROM ensemble WHERE judged_at IS NOT NULL GROUP BY 1, 2")
def st1_windowed_labels(spark, d):
    return S.windowed_labels(table(spark, d, "ensemble", "judged_at", "tp_fp_label", "total_tokens"))


@query("st2_sliding_values", "SELECT window_start, event_type, count(*) AS n, round(sum(value),2) AS total FROM (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS window_start, event_type, value FROM events) GROUP BY 1, 2")
def st2_sliding_values(spark, d):
    return S.sliding_values(table(spark, d, "events", "ts", "event_type", "value"))


@query("st3_sessions", "SELECT user_id, min(ts) AS session_start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def st3_sessions(spark, d):
    return S.sessions(table(spark, d, "events", "user_id", "ts"))

"""Queries that run as streams over the files available now."""

from __future__ import annotations

from corpusloom.plans.registry import query
from corpusloom.session import ship
from corpusloom.streaming import incremental


@query("SELECT DISTINCT md5(text_input) AS digest FROM combined_data WHERE text_input IS NOT NULL")
def stream_dedup(spark, d):
    ship(spark)
    return incremental.new_digests(spark, d, "combined_data", "text_input")


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_daily_events(spark, d):
    ship(spark)
    return incremental.windowed_counts(spark, d, "events", "ts", "event_type")

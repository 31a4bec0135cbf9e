"""Streams, run over all that the event table holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlspike.operators.evalstats import lower_median
from marlspike.operators.iterate import temporary
from marlspike.plans.event_queries import limiter_sql
from marlspike.plans.registry import query
from marlspike.sources.tables import table
from marlspike.streaming import events as stream

_CLOSED = "(select max(ts) - interval 10 minute as mark from events)"


def _source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.source(spark, f"{sf_dir}/events.parquet")


@query(f"""with w as (select user_id as entity, date_trunc('hour', ts) as start, count(*) as n from events group by 1, 2)
select entity, start, n, greatest(0, n - 5) as blocked from w, {_CLOSED} where start + interval 1 hour <= mark""")
def stream_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts of windows that the watermark has closed."""
    return stream.drain(stream.rates(_source(spark, sf_dir))).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(f"""with d as (select user_id as path, ts, event_type as kind, case when ts - lag(ts) over (partition by user_id order by ts) < interval 1 hour then 0 else 1 end as new from events),
b as (select *, sum(new) over (partition by path order by ts rows unbounded preceding) as b from d)
select path, min(ts) as start, count(*) as n, arg_max(kind, ts) as last_kind from b, {_CLOSED} group by path, b, mark having max(ts) + interval 1 hour <= mark""")
def stream_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.drain(stream.debounced(_source(spark, sf_dir))).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(f"""with e as (select event_type, value, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - interval 1 hour]) as start from events)
select event_type, start, count(*) as n, round(sum(value), 2) as total from e, {_CLOSED} where start + interval 2 hour <= mark group by event_type, start""")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.drain(stream.sliding(_source(spark, sf_dir))).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query()
def stream_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates and removals, in the order in which batches bring them."""
    return stream.drain(stream.presence(_source(spark, sf_dir)), "update")


@query(limiter_sql("user_id", {"minute": 1, "hour": 2, "day": 7}))
def stream_rate_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.drain(stream.rate_limited(_source(spark, sf_dir), {"minute": 1, "hour": 2, "day": 7}))


@query(f"""with d as (select event_id, user_id as path, ts, event_type as kind, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 1 hour then 0 else 1 end as new from events),
b as (select *, sum(new) over (partition by path order by ts, event_id rows unbounded preceding) as b from d)
select path, min(ts) as start, count(*) as n, arg_max(kind, struct_pack(a := ts, b := event_id)) as last_kind from b, {_CLOSED} group by path, b, mark having max(ts) + interval 1 hour <= mark""")
def stream_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of changes by keyed state and timers, over files that come in two runs with a restart between them."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("path"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"))
    half = F.timestamp_micros(F.lit(lower_median(e.select(F.unix_micros("ts").alias("us")), "us")).cast("bigint"))
    root = temporary(spark, "watch")
    run = lambda: stream.resumed(stream.watched(spark.readStream.schema(e.schema).parquet(f"{root}/files")), root)
    e.filter(F.col("ts") <= half).write.parquet(f"{root}/files")
    run()
    e.filter(F.col("ts") > half).write.mode("append").parquet(f"{root}/files")
    return run().withColumn("start", F.col("start").cast("timestamp_ntz"))

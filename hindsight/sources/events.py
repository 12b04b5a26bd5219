"""Sources: the event tables as lens events and as test events."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Event types by outcome, and outcome by value.
FAIL, FLAKY = ("error",), ("signup",)


def epoch_ms(ts: str) -> Column:
    """Unix milliseconds of a zone-less UTC timestamp column, whatever the session's zone."""
    return F.expr(f"unix_millis(cast(convert_timezone('UTC', current_timezone(), {ts}) as timestamp))")


def result_of(event_type: Column) -> Column:
    return F.when(event_type.isin(*FAIL), "fail").when(event_type.isin(*FLAKY), "flaky").otherwise("pass")


def value_of(result: Column) -> Column:
    """pass 1, fail 0, flaky a half."""
    return F.when(result == "pass", 1.0).when(result == "flaky", 0.5).when(result == "fail", 0.0)


def _stored(ms: int) -> Column:
    """Unix milliseconds as a literal of the stored, zone-less column."""
    at = datetime.datetime(1970, 1, 1) + datetime.timedelta(milliseconds=ms)
    return F.expr(f"timestamp_ntz'{at.isoformat(sep=' ', timespec='milliseconds')}'")


def read_events(spark: SparkSession, sf_dir: str, from_ms: int | None = None, to_ms: int | None = None) -> DataFrame:
    """The events table; bounds, both included, are literals on the stored column, so they reach the scan."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    if from_ms is not None:
        events = events.where(F.col("ts") >= _stored(from_ms))
    if to_ms is not None:
        events = events.where(F.col("ts") < _stored(to_ms + 1))
    return events


def lens_events(events: DataFrame) -> DataFrame:
    """ts_ms, value, keys{event_type, bucket}, weight 1, seq."""
    keys = F.create_map(F.lit("event_type"), F.col("event_type"), F.lit("bucket"), (F.col("user_id") % 4).cast("string"))
    return events.select(epoch_ms("ts").alias("ts_ms"), "value", keys.alias("keys"), F.lit(1.0).alias("weight"), F.col("event_id").alias("seq"))


def two_valued(events: DataFrame) -> DataFrame:
    """Lens events whose value is 0 for failures and 1 otherwise."""
    ok = F.when(result_of(F.col("event_type")) == "fail", 0.0).otherwise(1.0)
    return lens_events(events.withColumn("value", ok))


def test_events(events: DataFrame) -> DataFrame:
    """test_event rows: ts_ms, test_id, agent_id, areas, result, duration, weight, commit_hash."""
    user, seq = F.col("user_id"), F.col("event_id")
    areas = F.array_distinct(F.array(*[F.pmod(b, F.lit(256)).cast("int") for b in (user * 37, seq * 11, user + seq)]))
    agent = F.concat(F.lit("agent-"), F.element_at(F.array(*map(F.lit, "ABCD")), (user % 4 + 1).cast("int")))
    return events.select(
        epoch_ms("ts").alias("ts_ms"),
        F.concat(agent, F.lit("::test_"), F.lpad((seq % 50).cast("string"), 3, "0")).alias("test_id"),
        agent.alias("agent_id"),
        areas.alias("areas"),
        result_of(F.col("event_type")).alias("result"),
        (15 + seq % 31).cast("double").alias("duration"),
        F.lit(1.0).alias("weight"),
        F.concat(F.lit("commit-"), F.floor(seq / 100).cast("string")).alias("commit_hash"),
        seq.alias("seq"),
    )


def observe(tests: DataFrame) -> DataFrame:
    """Test events as lens events: the outcome's value, keys agentId and domain (the primary one)."""
    from ..operators.coverage import primary_domain

    keys = F.create_map(F.lit("agentId"), F.col("agent_id"), F.lit("domain"), primary_domain(F.col("areas")))
    return tests.select("ts_ms", value_of(F.col("result")).alias("value"), keys.alias("keys"), F.lit(1.0).alias("weight"), "seq")


def of_agent(tests: DataFrame, agent_id: str) -> DataFrame:
    return observe(tests.where(F.col("agent_id") == agent_id))


def arrivals(events: DataFrame, share: float = 0.1) -> DataFrame:
    """The same events with an ``arrival_ms``: a share comes 500 to 3000 ms late, times unchanged."""
    u = F.pmod(F.xxhash64("seq"), F.lit(10_000)) / 10_000
    return events.withColumn("arrival_ms", F.col("ts_ms") + F.when(u < share, 500 + F.pmod(F.hash("seq"), F.lit(2501))).otherwise(0))


def arriving_late(events: DataFrame, share: float = 0.1) -> DataFrame:
    """Events dealt over partitions, and read within them, by their arrival."""
    late = arrivals(events, share)
    return late.repartitionByRange("arrival_ms").sortWithinPartitions("arrival_ms", "seq")

"""Coverage of the bit space and the per-tick snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import DOMAINS, MISSING_KEY


def domain_of_bit(bit: Column) -> Column:
    """Name of the bit's domain; null outside the space."""
    out = F.lit(None).cast("string")
    for name, lo, hi, _ in DOMAINS:
        out = F.when(bit.between(lo, hi), name).otherwise(out)
    return out


def _in_domain(areas: Column, lo: int, hi: int) -> Column:
    return F.size(F.filter(areas, lambda b: (b >= lo) & (b <= hi)))


def primary_domain(areas: Column) -> Column:
    """Domain with most of the bits, the earlier on a tie, (none) without bits."""
    counts = [(name, F.coalesce(_in_domain(areas, lo, hi), F.lit(0))) for name, lo, hi, _ in DOMAINS]
    most = F.greatest(*[c for _, c in counts])
    out = F.lit(MISSING_KEY)
    for name, c in reversed(counts):
        out = F.when(c == most, name).otherwise(out)
    return F.when(most <= 0, MISSING_KEY).otherwise(out)


def dictionary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, n, t) for i, (n, _, _, t) in enumerate(DOMAINS)], "position int, domain string, required long")


def _bits(tests: DataFrame, *keep: str) -> DataFrame:
    bits = tests.select(*keep, F.explode("areas").alias("bit"))
    return bits.withColumn("domain", domain_of_bit(F.col("bit"))).where("domain is not null")


def rollup(tests: DataFrame) -> DataFrame:
    """domain, occurrences: every domain, occurrences of its bits."""
    counted = _bits(tests).groupBy("domain").agg(F.count("*").alias("n"))
    return F.broadcast(dictionary(tests.sparkSession)).join(counted, "domain", "left").select("domain", F.coalesce("n", F.lit(0)).alias("occurrences"))


def coverage(tests: DataFrame, *by: str) -> DataFrame:
    """domain, covered, required, gap: distinct bits of every domain, for every value of ``by`` that has tests."""
    counted = _bits(tests, *by).select(*by, "domain", "bit").distinct().groupBy(*by, "domain").agg(F.count("*").alias("n"))
    every = F.broadcast(dictionary(tests.sparkSession))  # one row per domain
    joined = (tests.select(*by).distinct().crossJoin(every) if by else every).join(counted, [*by, "domain"], "left")
    covered = F.coalesce("n", F.lit(0))
    return joined.select(*by, "domain", covered.alias("covered"), "required", F.greatest(F.col("required") - covered, F.lit(0)).alias("gap"))


def coverage_gaps(tests: DataFrame, *by: str) -> DataFrame:
    return coverage(tests, *by).where("covered < required")


def _slots(tests: DataFrame, tick_ms: int, window_ms: int) -> DataFrame:
    """Tests with the first and last tick whose window [tick - window_ms, tick] holds them, both ends included."""
    first = (F.ceil(F.col("ts_ms") / tick_ms) * tick_ms).alias("first_tick")
    last = (F.floor((F.col("ts_ms") + window_ms) / tick_ms) * tick_ms).alias("last_tick")
    return tests.where("ts_ms is not null").select("*", first, last).where("first_tick <= last_tick")


def _at_ticks(slots: DataFrame, tick_ms: int) -> DataFrame:
    return slots.select("*", F.explode(F.sequence("first_tick", "last_tick", F.lit(tick_ms).cast("long"))).alias("tick_ts")).drop("first_tick", "last_tick")


#: A spine of more ticks is refused: a stray time would ask for ages of empty windows.
MOST_TICKS = 100_000_000


def ticks(tests: DataFrame, tick_ms: int, window_ms: int) -> DataFrame:
    """tick_ts: every tick from the first that sees an event to the last, those with an empty window too.

    The two ends are looked up when this is called; the ticks between are a range, made in
    parallel. A span of more than MOST_TICKS raises ValueError: cut it with :func:`retention.segment`.
    """
    spark = tests.sparkSession
    a, b = _slots(tests.select("ts_ms"), tick_ms, window_ms).agg(F.min("first_tick"), F.max("last_tick")).first()
    if a is None:
        return spark.range(0).withColumnRenamed("id", "tick_ts")
    if (b - a) // tick_ms >= MOST_TICKS:
        raise ValueError(f"{(b - a) // tick_ms + 1} ticks between {a} and {b} are more than {MOST_TICKS}: is one time astray? take a segment, or a longer tick")
    return spark.range(a, b + 1, tick_ms).withColumnRenamed("id", "tick_ts")


def agent_stats(tests: DataFrame, tick_ms: int, window_ms: int) -> DataFrame:
    """tick_ts, agent_id, pass_rate, flaky_rate, event_count; agents absent from a window have no row.

    Events are counted once per slot (first and last tick they count for); ticks add slots.
    """
    slots = _slots(tests.select("ts_ms", "agent_id", "result"), tick_ms, window_ms)
    is_ = lambda v: F.sum((F.col("result") == v).cast("long"))
    slots = slots.groupBy("first_tick", "last_tick", "agent_id").agg(is_("pass").alias("passes"), is_("flaky").alias("flakies"), F.count("*").alias("n"))
    n = F.sum("n")
    return _at_ticks(slots, tick_ms).groupBy("tick_ts", "agent_id").agg(
        (F.coalesce(F.sum("passes"), F.lit(0)) / n).alias("pass_rate"), (F.coalesce(F.sum("flakies"), F.lit(0)) / n).alias("flaky_rate"), n.alias("event_count")
    )


def _bits_at_ticks(tests: DataFrame, tick_ms: int, window_ms: int) -> DataFrame:
    """tick_ts, bit: the distinct bits of every window; they are made distinct per slot first."""
    slots = _slots(tests.select("ts_ms", "areas"), tick_ms, window_ms).select("first_tick", "last_tick", F.explode("areas").alias("bit")).distinct()
    return _at_ticks(slots, tick_ms).distinct()


def domain_stats(tests: DataFrame, tick_ms: int, window_ms: int, spine: DataFrame | None = None) -> DataFrame:
    """tick_ts, domain, covered_bits, required_bits, gap: every domain at every tick; an empty window covers nothing."""
    every = F.array(*[F.struct(F.lit(n).alias("domain"), F.lit(t).cast("long").alias("required_bits")) for n, _, _, t in DOMAINS])
    spine = (ticks(tests, tick_ms, window_ms) if spine is None else spine).select("tick_ts", F.inline(every))
    bits = _bits_at_ticks(tests, tick_ms, window_ms).withColumn("domain", domain_of_bit(F.col("bit")))
    counted = bits.groupBy("tick_ts", "domain").agg(F.count("*").alias("n"))
    covered, required = F.coalesce("n", F.lit(0)), F.col("required_bits")
    return spine.join(counted, ["tick_ts", "domain"], "left").select("tick_ts", "domain", covered.alias("covered_bits"), "required_bits", F.greatest(required - covered, F.lit(0)).alias("gap"))


def touched_bits(tests: DataFrame, tick_ms: int, window_ms: int, spine: DataFrame | None = None) -> DataFrame:
    """tick_ts, touched: number of distinct bits in the window."""
    counted = _bits_at_ticks(tests, tick_ms, window_ms).groupBy("tick_ts").agg(F.count("*").alias("n"))
    spine = ticks(tests, tick_ms, window_ms) if spine is None else spine
    return spine.join(counted, "tick_ts", "left").select("tick_ts", F.coalesce("n", F.lit(0)).alias("touched"))

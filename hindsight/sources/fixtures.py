"""Seeded generators of test streams with known truths, and the Monte-Carlo trials of the calibration."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import DOMAINS

_MASK = 0xFFFFFFFF

#: Pass and flaky rates, fewest and most areas of a test, and domain bias of the four agents.
PROFILES = {
    "agent-A": (0.95, 0.01, 2, 6, None),
    "agent-B": (0.88, 0.02, 4, 12, {"auth": 1, "payment": 1, "ui": 4, "utils": 3}),
    "agent-C": (0.95, 0.01, 2, 6, None),
    "agent-D": (0.90, 0.08, 2, 5, None),
}
#: How often a domain is drawn unless a profile says otherwise, and draws per bit wanted.
DOMAIN_BIAS, ATTEMPTS = {"auth": 3, "payment": 3, "ui": 2, "utils": 1}, 10
#: Scenarios as (duration ms, agent, pass rate, removed bits) phases.
SCENARIOS = {
    "AR": ((10_000, None, None, None), (30_000, "agent-C", 0.70, None)),
    "CG": ((0, None, None, None), (30_000, None, None, (16, 23))),
    "RC": ((5_000, None, None, None), (2_000, "agent-C", 0.20, None), (53_000, None, None, None)),
}


def _imul(a: int, b: int) -> int:
    return (a * b) & _MASK


def seeded(seed: int) -> Iterator[float]:
    """32-bit generator of the stream fixtures; seed 0 counts as 1."""
    s = (seed & _MASK) or 1
    while True:
        s = _imul(s ^ (s >> 15), s | 1)
        s = (s ^ (s + _imul(s ^ (s >> 7), s | 61))) & _MASK
        yield ((s ^ (s >> 14)) & _MASK) / 2**32


def mulberry32(seed: int) -> Iterator[float]:
    """32-bit generator of the calibration fixtures."""
    a = seed & _MASK
    while True:
        a = (a + 0x6D2B79F5) & _MASK
        t = _imul(a ^ (a >> 15), 1 | a)
        t = ((t + _imul(t ^ (t >> 7), 61 | t)) ^ t) & _MASK
        yield ((t ^ (t >> 14)) & _MASK) / 2**32


def weighted_bits(n: Column, bias: dict[str, float] | None, draw: Callable[[Column, int], Column], most: int) -> Column:
    """``n`` distinct bits, ``most`` at most, domains drawn by weight and bits evenly within; fewer if ATTEMPTS draws per bit bring no more.

    ``draw(i, k)`` is the k-th even draw of attempt i.
    """
    weights = [(lo, hi - lo + 1, round((DOMAIN_BIAS | (bias or {}))[name])) for name, lo, hi, _ in DOMAINS]
    pool = F.array(*[F.struct(F.lit(lo).alias("lo"), F.lit(size).alias("size")) for lo, size, w in weights for _ in range(w)])

    def bit(i: Column) -> Column:
        domain = F.get(pool, F.floor(draw(i, 0) * F.size(pool)).cast("int"))
        return (domain["lo"] + F.floor(draw(i, 1) * domain["size"])).cast("int")

    drawn = F.transform(F.sequence(F.lit(0), F.lit(most * ATTEMPTS - 1)), lambda i: F.when(i < n * ATTEMPTS, bit(i)))
    return F.slice(F.array_distinct(F.array_compact(drawn)), F.lit(1), n)


def stream(spark: SparkSession, n: int, rate: int = 50, start_ms: int = 0, scenario: str | None = None, seed: int = 1) -> DataFrame:
    """``n`` test events at ``rate`` per second from the four agents, with a scenario's phases in force.

    Draws are hashes of (seed, event, purpose), so any partitioning gives the same rows.
    """

    def draw(purpose: int):
        return F.pmod(F.xxhash64(F.lit(seed), "id", F.lit(purpose)), F.lit(1 << 30)) / (1 << 30)

    names = list(PROFILES)
    agent = F.element_at(F.array(*map(F.lit, names)), F.floor(draw(0) * len(names)).cast("int") + 1)
    of = lambda k: F.element_at(F.create_map(*[F.lit(x) for a, p in PROFILES.items() for x in (a, p[k])]), F.col("agent_id"))
    rates, fewest, most = {k: of(k) for k in (0, 1)}, of(2), of(3)
    ts = (F.lit(start_ms) + F.col("id") * 1000 / rate).cast("long")
    passes, removed, at = rates[0], F.lit(None).cast("array<int>"), start_ms
    for ms, who, rate_, bits in SCENARIOS.get(scenario, ()):
        inside = (F.col("ts_ms") >= at) & (F.col("ts_ms") < at + ms)
        if who:
            passes = F.when(inside & (F.col("agent_id") == who), rate_).otherwise(passes)
        if bits:
            removed = F.when(inside, F.sequence(F.lit(bits[0]), F.lit(bits[1]))).otherwise(removed)
        at += ms
    u = draw(1)
    out = spark.range(n).withColumn("ts_ms", ts).withColumn("agent_id", agent)
    n = (fewest + F.floor(draw(3) * (most - fewest + 1))).cast("int")
    each = lambda i, k: F.pmod(F.xxhash64(F.lit(seed), "id", F.lit("bit"), i, F.lit(k)), F.lit(1 << 30)) / (1 << 30)
    areas = F.lit(None).cast("array<int>")
    for name, (_, _, _, top, bias) in PROFILES.items():
        areas = F.when(F.col("agent_id") == name, weighted_bits(n, bias, each, top)).otherwise(areas)
    return out.select(
        "ts_ms", F.concat("agent_id", F.lit("::test_"), F.lpad((F.col("id") % 50).cast("string"), 3, "0")).alias("test_id"), "agent_id",
        F.when(removed.isNotNull(), F.array_except(areas, removed)).otherwise(areas).alias("areas"),
        F.when(u < passes, "pass").when(u < passes + rates[1], "flaky").otherwise("fail").alias("result"),
        F.round(15 + 30 * draw(2)).alias("duration"), F.lit(1.0).alias("weight"), F.concat(F.lit("commit-"), F.floor(F.col("id") / 100).cast("string")).alias("commit_hash"), F.col("id").alias("seq"),
    )


def trials(spark: SparkSession, count: int, span_ms: int = 10_000, events: int = 1000, p: float = 0.95, burst: float | None = None) -> DataFrame:
    """trial_id, is_obs, ts_ms, value: a reference and an observed span per trial, Bernoulli(p) draws.

    ``burst`` is the rate in the last fifth of the observed span. Draws are md5 bits of
    (trial, event), so other engines can make the same.
    """
    return _draws(spark, count, span_ms, events, p, burst).drop("i")


def _draws(spark: SparkSession, count: int, span_ms: int, events: int, p: float, burst: float | None = None) -> DataFrame:
    half = F.floor(F.col("id") / events) % 2
    trial, i = F.floor(F.col("id") / (2 * events)), F.col("id") % (2 * events)
    digest = F.md5(F.concat_ws(":", F.col("trial_id").cast("string"), F.col("i").cast("string")).cast("binary"))
    bits = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long") / 2.0**32
    rows = spark.range(2 * events * count).select(trial.alias("trial_id"), i.alias("i"), (half == 1).alias("is_obs"))
    rows = rows.withColumn("ts_ms", F.floor(bits(1) * span_ms).cast("long") + F.when(F.col("is_obs"), span_ms).otherwise(0))
    rate = F.lit(p) if burst is None else F.when(F.col("is_obs") & (F.col("ts_ms") >= span_ms + span_ms * 4 // 5), burst).otherwise(p)
    return rows.select("trial_id", "is_obs", "ts_ms", F.when(bits(9) < rate, 1.0).otherwise(0.0).alias("value"), "i")


#: The published trial shapes, as window and parts (from, to, events, pass rate), times from the observed span's start.
AB_START = 2_000_000
AB_SHAPES = {
    "RC": (1_000, ((-10_000, 0, 1_000, 0.95), (0, 8_000, 800, 0.95), (8_000, 10_000, 200, 0.10))),
    "AR": (5_000, ((-15_000, 0, 1_500, 0.95), (0, 30_000, 3_000, 0.70))),
    "QUIET": (1_000, ((-10_000, 0, 1_000, 0.95), (0, 10_000, 1_000, 0.95))),
}


def ab_trials(spark: SparkSession, kind: str, count: int) -> tuple[DataFrame, int]:
    """Trials (trial_id, is_obs, ts_ms, value) of a published shape, and the width of its windows. Times and outcomes are md5 bits of (trial, event)."""
    if kind not in AB_SHAPES:
        raise ValueError(f"kind must be one of {', '.join(AB_SHAPES)}")
    window_ms, parts = AB_SHAPES[kind]
    each = sum(n for _, _, n, _ in parts)
    rows = spark.range(each * count).select(F.floor(F.col("id") / each).alias("trial_id"), (F.col("id") % each).alias("i"))
    digest = F.md5(F.concat_ws(":", F.col("trial_id").cast("string"), F.col("i").cast("string")).cast("binary"))
    bits = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long") / 2.0**32
    ts, rate, begin = F.lit(None).cast("long"), F.lit(None).cast("double"), 0
    for a, b, n, p in parts:
        mine = F.col("i").between(begin, begin + n - 1)
        ts = F.when(mine, F.floor(bits(1) * (b - a)).cast("long") + AB_START + a).otherwise(ts)
        rate = F.when(mine, p).otherwise(rate)
        begin += n
    return rows.select("trial_id", (ts >= AB_START).alias("is_obs"), ts.alias("ts_ms"), F.when(bits(9) < rate, 1.0).otherwise(0.0).alias("value")), window_ms


#: Trials with a known truth, as (pass rate of the observed span, rate and part of the span of what is injected).
TRUTHS = {"QUIET": (0.95, None), "AR": (0.95, (0.70, 0.5, 1.0)), "RC": (0.95, (0.20, 0.4, 0.6))}


def truth_trials(spark: SparkSession, kind: str, count: int, span_ms: int = 10_000, events: int = 1000) -> tuple[DataFrame, tuple[int, int] | None]:
    """Trials of a kind, and the span of time that is injected in each; null if none is."""
    if kind not in TRUTHS:
        raise ValueError(f"kind must be one of {', '.join(TRUTHS)}")
    p, injected = TRUTHS[kind]
    quiet = _draws(spark, count, span_ms, events, p)
    if injected is None:
        return quiet.drop("i"), None
    rate, a, b = injected
    span = int(span_ms * (1 + a)), int(span_ms * (1 + b))
    inside = F.col("is_obs") & (F.col("ts_ms") >= span[0]) & (F.col("ts_ms") < span[1])
    keep = F.pmod(F.xxhash64("trial_id", "i"), F.lit(10_000)) / 10_000 < rate
    return quiet.withColumn("value", F.when(inside, F.when(keep, 1.0).otherwise(0.0)).otherwise(F.col("value"))).drop("i"), span


def quiet_false_positives(spark: SparkSession, count: int) -> DataFrame:
    """trial_id of the quiet trials, of ``count``, whose package has a tile that is no baseline."""
    from ..operators.calibration import false_positives

    return false_positives(trials(spark, count))

"""Coverage as vectors over the bit space: cumulative coverage and its gap, weights, contributions, and rolling rates.

A vector of bits is four longs, so a slot of any number of events is one small row, made
map-side. Running and rolling values are taken over slots, never over events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import DOMAINS
from .coverage import domain_of_bit

WORDS, BITS = 4, 256
#: Slots whose running union is taken at once; their unions are run over first.
BLOCK_SLOTS = 1024
_ALL = [f"b{i}" for i in range(WORDS)]


def bit_words(areas: Column) -> list[Column]:
    """The bits of an array as four longs; bits outside the space are left out."""
    bit = lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), (b % 64).cast("int"))
    word = lambda i: F.aggregate(F.filter(areas, lambda b: b.between(64 * i, 64 * i + 63)), F.lit(0).cast("long"), lambda m, b: m.bitwiseOR(bit(b)))
    return [F.coalesce(word(i), F.lit(0)).cast("long").alias(f"b{i}") for i in range(WORDS)]


def _words_of(bits: set[int]) -> list[int]:
    out = []
    for i in range(WORDS):
        word = sum(1 << (b - 64 * i) for b in bits if 64 * i <= b < 64 * i + 64)
        out.append(word - (1 << 64) if word >= 1 << 63 else word)
    return out


def target_bits() -> set[int]:
    """The area target: of every domain as many of its first bits as it requires."""
    return {b for _, lo, _, required in DOMAINS for b in range(lo, lo + required)}


def _size(words: list[Column]) -> Column:
    return sum((F.bit_count(w) for w in words), F.lit(0)).cast("long")


def positions(words: list[Column]) -> Column:
    """The set bits in order, joined by commas."""

    def of(i: int, word: Column) -> Column:
        return F.transform(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.getbit(word, b) == 1), lambda b: b + 64 * i)

    places = [of(i, w) for i, w in enumerate(words)]
    return F.array_join(F.concat(*places).cast("array<string>"), ",")


def _slot(tick_ms: int) -> Column:
    """The first tick at or after an event."""
    return (F.ceil(F.col("ts_ms") / tick_ms) * tick_ms).cast("long")


def cumulative_coverage(tests: DataFrame, tick_ms: int, target: set[int] | None = None) -> DataFrame:
    """tick_ts, covered, missing, beyond, gap_vec at every tick before which an event came since the last.

    Covered are the bits of passing tests so far; the gap vector is target XOR covered: bits
    missing and bits beyond the target. Events without a time count nowhere. The running union
    is taken in two levels: over blocks of BLOCK_SLOTS ticks, then inside each block.
    """
    wanted = [F.lit(w).cast("long") for w in _words_of(target_bits() if target is None else target)]
    passed = F.when(F.col("result") == "pass", F.col("areas")).otherwise(F.array().cast("array<int>"))
    slots = tests.where("ts_ms is not null").select(_slot(tick_ms).alias("tick_ts"), *bit_words(passed)).groupBy("tick_ts").agg(*[F.bit_or(b).alias(b) for b in _ALL])
    slots = slots.withColumn("block", F.floor(F.col("tick_ts") / (tick_ms * BLOCK_SLOTS)))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row for BLOCK_SLOTS ticks
    blocks = slots.groupBy("block").agg(*[F.bit_or(b).alias(b) for b in _ALL])
    blocks = blocks.select("block", *[F.coalesce(F.bit_or(b).over(before), F.lit(0)).alias(f"before_{b}") for b in _ALL])
    inside = Window.partitionBy("block").orderBy("tick_ts").rowsBetween(Window.unboundedPreceding, 0)
    run = slots.select("tick_ts", "block", *[F.bit_or(b).over(inside).alias(b) for b in _ALL]).join(blocks, "block")
    run = run.select("tick_ts", *[F.col(b).bitwiseOR(F.col(f"before_{b}")).alias(b) for b in _ALL])
    have = [F.col(b) for b in _ALL]
    missing = [w.bitwiseAND(F.bitwise_not(h)) for w, h in zip(wanted, have, strict=True)]
    beyond = [h.bitwiseAND(F.bitwise_not(w)) for w, h in zip(wanted, have, strict=True)]
    gap = [w.bitwiseXOR(h) for w, h in zip(wanted, have, strict=True)]
    return run.select("tick_ts", _size(have).alias("covered"), _size(missing).alias("missing"), _size(beyond).alias("beyond"), positions(gap).alias("gap_vec"))


def weight_vectors(tests: DataFrame, window_ms: int, weight: str = "weight", by: tuple[str, ...] = ()) -> DataFrame:
    """window_start, bit, covered, weight, tests: of every bit touched in a window whether a passing test covered it and the largest weight of the tests that touched it.

    Per bit and window partial rows merge by or, maximum and sum: :func:`merge_vectors`. Null
    weights are no weights; a bit that only such tests touch has none.
    """
    rows = tests.where("ts_ms is not null").select((F.floor(F.col("ts_ms") / window_ms) * window_ms).cast("long").alias("window_start"), *by, "result", F.col(weight).alias("_weight"), F.explode(F.array_distinct("areas")).alias("bit"))
    return rows.groupBy(*by, "window_start", "bit").agg(F.coalesce(F.bool_or(F.col("result") == "pass"), F.lit(False)).alias("covered"), F.max("_weight").alias("weight"), F.count("*").alias("tests"))


def merge_vectors(parts: DataFrame, *by: str) -> DataFrame:
    """Vectors of parts (windows, batches, agents) as one per ``by``."""
    return parts.groupBy(*by, "bit").agg(F.bool_or("covered").alias("covered"), F.max("weight").alias("weight"), F.sum("tests").alias("tests"))


def contributions(tests: DataFrame, by: str = "commit_hash") -> DataFrame:
    """``by``, new_bits, new_weight: what each revision added to the covered bits, with the largest weight that had by its own passing tests.

    A bit belongs to the revision of its first passing test, by time and then by seq.
    """
    rows = tests.where("ts_ms is not null and result = 'pass'").select(by, "ts_ms", "seq", "weight", F.explode(F.array_distinct("areas")).alias("bit"))
    per = rows.groupBy(by, "bit").agg(F.min(F.struct("ts_ms", "seq")).alias("first"), F.max("weight").alias("weight"))
    firsts = per.groupBy("bit").agg(F.min_by(F.struct(F.col(by).alias("by"), "weight"), "first").alias("f"))
    return firsts.groupBy(F.col("f.by").alias(by)).agg(F.count("*").alias("new_bits"), F.max("f.weight").alias("new_weight"))


def rolling_rates(tests: DataFrame, key: str, result: str, slot_ms: int, window_ms: int) -> DataFrame:
    """tick_ts, key, n, hits, rate: share of ``result`` among the tests of the last ``window_ms``, at every slot's end that saw the key.

    Events are summed per key and slot first, so the rolling range holds slots: window_ms / slot_ms
    of them however many events the key has. ``window_ms`` is a multiple of ``slot_ms``.
    """
    if window_ms % slot_ms:
        raise ValueError("the window is a whole number of slots")
    slots = tests.where("ts_ms is not null").groupBy(F.col(key).alias("key"), _slot(slot_ms).alias("tick_ts"))
    slots = slots.agg(F.count("*").alias("n"), F.sum((F.col("result") == result).cast("long")).alias("hits"))
    recent = Window.partitionBy("key").orderBy("tick_ts").rangeBetween(-(window_ms - slot_ms), 0)
    n, hits = F.sum("n").over(recent), F.coalesce(F.sum("hits").over(recent), F.lit(0))
    return slots.select("tick_ts", "key", n.alias("n"), hits.alias("hits"), (hits / n).alias("rate"))


def rate_decisions(rates: DataFrame, above: float, kind: str, least: int = 1) -> DataFrame:
    """tick_ts, type, subject, rate where a rate of ``least`` tests or more rises above the bar; once until it has been at or below it."""
    order = Window.partitionBy("key").orderBy("tick_ts")
    rows = rates.withColumn("_bad", (F.col("rate") > above) & (F.col("n") >= least))
    rows = rows.withColumn("_was", F.coalesce(F.lag("_bad").over(order), F.lit(False)))
    return rows.where("_bad and not _was").select("tick_ts", F.lit(kind).alias("type"), F.col("key").alias("subject"), "rate")


def quarantines(tests: DataFrame, slot_ms: int = 60_000, window_ms: int = 3_600_000, above: float = 0.30, least: int = 1) -> DataFrame:
    """quarantineApprove decisions: a test that is flaky in more than 30 % of an hour's runs."""
    return rate_decisions(rolling_rates(tests, "test_id", "flaky", slot_ms, window_ms), above, "quarantineApprove", least)


def regressions(tests: DataFrame, slot_ms: int = 3_600_000, window_ms: int = 7 * 86_400_000, above: float = 0.15, least: int = 1) -> DataFrame:
    """rerouteSchema decisions: an agent more than 15 % of whose tests of seven days fail."""
    return rate_decisions(rolling_rates(tests, "agent_id", "fail", slot_ms, window_ms), above, "rerouteSchema", least)


def coverage_deltas(tests: DataFrame, slot_ms: int = 3_600_000, window_ms: int = 86_400_000) -> DataFrame:
    """tick_ts, domain, covered, delta: bits that passing tests of the last ``window_ms`` cover, and how many more than in the ``window_ms`` before, at every slot's end with events."""
    if window_ms % slot_ms:
        raise ValueError("the window is a whole number of slots")
    passed = F.when(F.col("result") == "pass", F.col("areas")).otherwise(F.array().cast("array<int>"))
    slots = tests.where("ts_ms is not null").select(_slot(slot_ms).alias("tick_ts"), *bit_words(passed)).groupBy("tick_ts").agg(*[F.bit_or(b).alias(b) for b in _ALL])
    # a slot counts in two windows' worth of ticks; blocks keep the ranges in many tasks
    span = window_ms * 32
    shown = slots.withColumn("block", F.floor(F.col("tick_ts") / span))
    ahead = shown.where(F.col("tick_ts") >= (F.col("block") + 1) * span - 2 * window_ms).withColumn("block", F.col("block") + 1)
    both = shown.withColumn("own", F.lit(True)).unionByName(ahead.withColumn("own", F.lit(False)))
    order = Window.partitionBy("block").orderBy("tick_ts")
    now, past = order.rangeBetween(-(window_ms - slot_ms), 0), order.rangeBetween(-(2 * window_ms - slot_ms), -window_ms)
    words = lambda range_: [F.coalesce(F.bit_or(b).over(range_), F.lit(0)) for b in _ALL]
    rows = both.select("tick_ts", "own", *[w.alias(f"now{i}") for i, w in enumerate(words(now))], *[w.alias(f"past{i}") for i, w in enumerate(words(past))]).where("own")
    parts = []
    for name, lo, hi, _ in DOMAINS:
        mask = [F.lit(w).cast("long") for w in _words_of(set(range(lo, hi + 1)))]
        covered, before = (_size([F.col(f"{side}{i}").bitwiseAND(m) for i, m in enumerate(mask)]) for side in ("now", "past"))
        parts.append(F.struct(F.lit(name).alias("domain"), covered.alias("covered"), (covered - before).alias("delta")))
    return rows.select("tick_ts", F.inline(F.array(*parts)))


def in_dictionary(tests: DataFrame, dictionary: DataFrame, most_versions: int = 1000) -> DataFrame:
    """``tests`` with version and tags: the dotted tags of their bits by the dictionary in force at their time, parents included, sorted.

    ``dictionary(version, since_ms, tag, lo, hi)``: every row a range of bits of one version.
    Versions are few and found by a literal list of their times, checked to be at most
    ``most_versions``; bits meet tags in one join on (version, bit). Bits without a tag give
    none; events before the first version have no version and no tags.
    """
    versions = dict(sorted((r["since_ms"], r["version"]) for r in dictionary.groupBy("version").agg(F.min("since_ms").alias("since_ms")).limit(most_versions + 1).collect()))
    if len(versions) > most_versions:
        raise ValueError(f"more than {most_versions} versions of the dictionary")
    kind = dictionary.schema["version"].dataType
    since = F.array_max(F.filter(F.array(*[F.lit(x).cast("long") for x in versions]).cast("array<bigint>"), lambda x: x <= F.col("ts_ms")))
    names = F.map_from_arrays(F.array(*[F.lit(x).cast("long") for x in versions]).cast("array<bigint>"), F.array(*[F.lit(x).cast(kind) for x in versions.values()]))
    version = F.try_element_at(names, since).cast(kind)
    parents = F.transform(F.sequence(F.lit(1), F.size(F.split("tag", r"\."))), lambda n: F.array_join(F.slice(F.split("tag", r"\."), 1, n), "."))
    entries = dictionary.select("version", F.explode(F.sequence(F.col("lo"), F.col("hi"))).alias("bit"), parents.alias("tags"))
    entries = entries.groupBy("version", "bit").agg(F.array_distinct(F.flatten(F.collect_list("tags"))).alias("tags"))  # tags of one bit of one version
    rows = tests.withColumn("version", version)
    # the space is small and repeats: sets of bits are looked up once each
    sets = rows.where("version is not null").select("version", F.array_sort(F.array_distinct("areas")).alias("areas")).distinct()
    found = sets.select("version", "areas", F.explode("areas").alias("bit")).join(entries, ["version", "bit"])
    found = found.groupBy("version", "areas").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags"))  # tags of one set of bits
    found = found.withColumnRenamed("areas", "_areas")
    out = rows.withColumn("_areas", F.array_sort(F.array_distinct("areas"))).join(found, ["version", "_areas"], "left")
    return out.drop("_areas").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def tag_rollup(tagged: DataFrame) -> DataFrame:
    """version, tag, events, passes of every tag, parents included; an event counts once for a tag."""
    rows = tagged.select("version", "result", F.explode("tags").alias("tag"))
    return rows.groupBy("version", "tag").agg(F.count("*").alias("events"), F.sum((F.col("result") == "pass").cast("long")).alias("passes"))


def unmapped_bits(tests: DataFrame) -> DataFrame:
    """bit, n: bits that lie outside every domain, which no rule sees."""
    return tests.select(F.explode("areas").alias("bit")).where(domain_of_bit(F.col("bit")).isNull()).groupBy("bit").agg(F.count("*").alias("n"))

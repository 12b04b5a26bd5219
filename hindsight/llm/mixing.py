"""Mixing sources to target weights by entropy balancing, with built-in functions only.

Of all rates per document whose words meet the token target of every source, with no rate
above MOST, those closest in relative entropy to one copy each are

    rate(document) = min(MOST, exp(lambda(source) * size(document))),

exponentially tilted in the tokens a document brings: a source above its target gives up
its long documents first, one below it repeats them most. The multipliers solve a convex
dual with one token constraint per source. Newton steps on the logarithm of the words taken,
kept inside a bracket, find them for all sources at once. Every step is one distributed sum
of a source's first and second moments under the current tilt; as documents of equal source
and size have equal rates, the sums run over counts of sizes, aggregated once. The state of
the iteration is a table with one row per source.

Rates become whole copies: every document gets floor(rate) copies, and those with a small
hash for the fraction left get one more. How small is found per source by refining a
histogram of hash over fraction, so no source is ever sorted or gathered in one place.

Null texts have size 0 and are never taken, nor are others without a word. Null sources form
a source of their own, last in order. Tables without words have targets of 0 and no copies.
Rows are rated one by one by their own size; rows with equal doc_id share a hash. Reruns
agree: nothing is random, and rates are whole billionths.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, words_of

#: Weights of sources in code point order, repeating, and the most a source or document may grow.
WEIGHTS = (1, 2, 3)
MOST = 3
#: The iteration ends when every source's words are this near its target, or after so many steps.
CLOSE, NEWTON_STEPS = 1e-11, 100
#: Rates are whole multiples of 1 / BILLION.
BILLION = 1_000_000_000
#: Bits of the hash, and of each of the levels that find a threshold.
HASH_BITS, LEVEL_BITS, LEVELS = 30, 10, 4


def _hash_bits(doc_id: Column) -> Column:
    """HASH_BITS bits from the md5 of the id, the same in any engine."""
    bits = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")
    return F.shiftright(bits, 32 - HASH_BITS)


def word_count(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.size(words_of(text)).cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, number of words and hash per row."""
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _hash_bits(F.col("doc_id")).alias("u"))


def source_targets(sized: DataFrame) -> DataFrame:
    """source, source_size, weight, target: weighted shares of all words, capped at MOST times the source.

    Resharing the excess until none is above its cap ends where one water level L gives
    every source min(cap, weight * L); the sources sorted by cap / weight show L directly.
    The windows run over one row per source.
    """
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    k = F.pmod(F.row_number().over(in_order) - 1, F.lit(len(WEIGHTS)))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), k + 1)
    ranked = per_source.withColumn("weight", weight).withColumn("cap", F.col("source_size") * MOST)
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = ranked.withColumns(
        {
            "total": F.sum("source_size").over(everything),
            "cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "weight_left": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    ).withColumn("level", (F.col("total") - F.col("cap_before")) / F.col("weight_left"))
    # the first source that its level does not fill sets the level of it and all after it
    fits = F.col("weight") * F.col("level") <= F.col("cap")
    level = F.first(F.when(fits, F.col("level")), ignorenulls=True).over(everything_sorted(by_level))
    target = F.least(F.col("weight") * F.coalesce(level, F.lit(float("inf"))), F.col("cap").cast("double"))
    return filled.withColumn("target", target).select("source", "source_size", "weight", "target")


def everything_sorted(spec):
    """The whole partition, in the order of ``spec``."""
    return spec.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))


def tilted(lam: Column, size: Column) -> Column:
    """The rate under a multiplier."""
    return F.least(F.lit(float(MOST)), F.exp(lam * size))


def multipliers(targets: DataFrame, counts: DataFrame) -> DataFrame:
    """source, source_size, target, lam, the dual's solution, of the sources that have words; ``counts(source, size, n)`` has no size 0.

    At either end of the bracket all documents have at most, or at least, the rate that the target asks of them on average.
    A step is one join: the state of a source goes along as a key of its sums.
    """
    least = counts.groupBy("source").agg(F.min("size").alias("least"))
    state = targets.alias("t").join(least.alias("l"), _same("t", "l")).where("target > 0").select("t.source", "source_size", "target", "least")
    ends = {
        "lo": F.least(F.lit(0.0), F.log(F.col("target") / F.col("source_size")) / F.col("least")),
        "hi": F.when(F.col("target") > F.col("source_size"), F.lit(math.log(MOST)) / F.col("least")).otherwise(0.0),
    }
    state = state.withColumns(ends).withColumn("lam", F.when(F.col("target") >= MOST * F.col("source_size"), F.col("hi")).otherwise(0.0))
    written = materialise(state, "mixing-dual")
    for _ in range(NEWTON_STEPS):
        state = written.drop("open")
        rate = tilted(F.col("lam"), F.col("size"))
        rows = counts.alias("c").join(state.alias("s"), _same("c", "s")).select("s.*", "size", "n")
        words = F.col("n") * F.col("size") * rate
        step = rows.groupBy(*state.columns).agg(F.sum(words).alias("m1"), F.sum(F.when(rate < MOST, words * F.col("size")).otherwise(0.0)).alias("m2"))
        step = step.withColumn("off", F.abs(F.col("m1") / F.col("target") - 1))
        step = step.withColumns({"lo": F.when(F.col("m1") < F.col("target"), F.col("lam")).otherwise(F.col("lo")), "hi": F.when(F.col("m1") > F.col("target"), F.col("lam")).otherwise(F.col("hi"))})
        newton = F.col("lam") + F.log(F.col("target") / F.col("m1")) * F.col("m1") / F.col("m2")
        inside = (F.col("m2") > 0) & (newton > F.col("lo")) & (newton < F.col("hi"))
        done = (F.col("off") <= CLOSE) | (F.col("lam") == F.lit(math.log(MOST)) / F.col("least"))
        step = step.withColumn("lam", F.when(done, F.col("lam")).when(inside, newton).otherwise((F.col("lo") + F.col("hi")) / 2))
        last, written = written, materialise(step.withColumn("open", ~done).drop("m1", "m2", "off"), "mixing-dual")
        discard(last)
        if written.where("open").isEmpty():
            break
    return written.select("source", "source_size", "target", "lam")


def plan_mix(sized: DataFrame) -> DataFrame:
    """source, source_size, target, lam, below for every source of ``sized(source, size, u)``; lam is null without words.

    Documents whose hash over fraction is under ``below`` get one copy more than their whole rate. Every
    table sent to the tasks costs the driver memory, so a source's plan goes along as a key of its sums.
    """
    counts = materialise(sized.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")), "mixing-counts")
    targets = materialise(source_targets(sized).drop("weight"), "mixing-targets")
    solved = multipliers(targets, counts)
    whole = counts.alias("c").join(solved.alias("p"), _same("c", "p")).groupBy(*[F.col(f"p.{c}").alias(c) for c in solved.columns])
    whole = whole.agg(F.sum(F.col("n") * F.col("size") * copies_and_fraction()[0]).alias("words"))
    plan = whole.withColumn("need", F.greatest(F.col("target") - F.col("words"), F.lit(0.0))).drop("words")
    plan = materialise(plan.withColumns({"below": F.lit(0).cast("long"), "under": F.lit(0).cast("long")}), "mixing-plan")
    for level in range(1, LEVELS + 1):
        shift = LEVEL_BITS * (LEVELS - level)
        rows = sized.alias("d").join(plan.alias("p"), _same("d", "p")).where("size > 0").select("p.*", "size", order_of().alias("v"))
        rows = rows.where(F.shiftright("v", shift + LEVEL_BITS) == F.col("below"))
        bins = rows.groupBy(*plan.columns, F.shiftright("v", shift).alias("bin")).agg(F.sum("size").alias("words"))
        upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        bins = bins.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0))).where("under + before <= need")
        # never empty: the plan's sources have words, and the first bin has none before it
        found = bins.groupBy(*plan.columns).agg(F.max(F.struct("bin", "before", "words")).alias("at"))
        under, bin_, words = F.col("at.before") + F.col("under"), F.col("at.bin"), F.col("at.words")
        if level == LEVELS:  # the rows at the threshold are taken if that comes nearer
            takes = (words > 0) & (under + words - F.col("need") < F.col("need") - under)
            bin_ = F.when(takes, bin_ + 1).otherwise(bin_)
        keep = ("source", "source_size", "target", "lam", "need")
        before, plan = plan, materialise(found.select(*keep, bin_.alias("below"), under.alias("under")), "mixing-plan")
        discard(before)
    # written, so that its size is known to be small and documents are joined with it unshuffled
    out = targets.alias("t").join(plan.alias("p"), _same("t", "p"), "left")
    return materialise(out.select("t.source", "t.source_size", "t.target", "lam", F.coalesce("below", F.lit(0)).alias("below")), "mixing-plan")


def copies_and_fraction() -> tuple[Column, Column]:
    """Whole copies, and what is left of the rate in billionths, from size and lam."""
    rate = F.floor(tilted(F.col("lam"), F.col("size")) * BILLION + 0.5)
    return F.floor(rate / BILLION).cast("long"), (rate % BILLION).cast("long")


def order_of() -> Column:
    """Where a row stands in line for one more copy: its hash over its fraction; at the end if it has none."""
    last, fraction = (1 << LEVEL_BITS * LEVELS) - 1, copies_and_fraction()[1]
    return F.when(fraction > 0, F.least(F.call_function("div", F.col("u") * F.lit(BILLION), fraction), F.lit(last))).otherwise(last)


def copies() -> Column:
    """Copies of a row from size, u, lam and below."""
    more = F.when(order_of() < F.col("below"), 1).otherwise(0)
    return F.when((F.col("size") > 0) & F.col("lam").isNotNull(), F.least(copies_and_fraction()[0] + more, F.lit(MOST))).otherwise(0).cast("long")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies per row of ``docs``."""
    sized = materialise(sizes(docs), "mixing")
    out = sized.alias("d").join(plan_mix(sized).alias("p"), _same("d", "p"))
    rate = F.when(F.col("size") > 0, tilted(F.col("lam"), F.col("size"))).otherwise(0.0)
    return out.select("doc_id", F.col("d.source").alias("source"), "size", "source_size", "target", rate.alias("rate"), copies().alias("copies"))


def mixing_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns per document."""
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def repeat_documents(docs: DataFrame) -> DataFrame:
    """The mixed corpus: rows of ``docs`` as often as the mix takes them, columns unchanged.

    Texts are never shuffled for it unless the sources are too many to send to every task.
    """
    plan = plan_mix(materialise(sizes(docs), "mixing"))
    held = docs.select(F.struct("*").alias("row"), "source", word_count(F.col("text")).alias("size"), _hash_bits(F.col("doc_id")).alias("u"))
    held = held.alias("d").join(plan.alias("p"), _same("d", "p")).select("row", copies().cast("int").alias("copies")).where("copies > 0")
    return held.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[F.col("row")[c].alias(c) for c in docs.columns])


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT >> 2 AS u
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), k AS (
  SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight, 3 * source_size AS cap FROM s
), f AS (
  SELECT *, sum(source_size) OVER () AS total,
         coalesce(sum(cap) OVER lev, 0) AS cap_before, sum(weight) OVER () - coalesce(sum(weight) OVER lev, 0) AS weight_left
  FROM k WINDOW lev AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), lv AS (
  SELECT min_by(lvl, o) AS lvl FROM (
    SELECT (total - cap_before)::DOUBLE / weight_left AS lvl, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS o, weight, cap FROM f
  ) WHERE weight * lvl <= cap
), t AS (
  SELECT source, source_size, least(weight * coalesce(lvl, 'inf'::DOUBLE), cap::DOUBLE) AS target FROM k, lv
), h AS (
  SELECT source, size, count(*) AS n FROM d WHERE size > 0 GROUP BY source, size
), b AS (
  SELECT source, source_size, target, (SELECT min(size) FROM h WHERE h.source IS NOT DISTINCT FROM t.source) AS least_size FROM t WHERE target > 0
), halved AS (
  SELECT 0 AS i, source, target, least(0, ln(target / source_size) / least_size) AS lo,
         CASE WHEN target > source_size THEN ln(3) / least_size ELSE 0 END AS hi
  FROM b
  UNION ALL
  SELECT i + 1, source, target, CASE WHEN m < target THEN mid ELSE lo END, CASE WHEN m < target THEN hi ELSE mid END
  FROM (
    SELECT x.i, x.source, any_value(x.target) AS target, any_value(x.lo) AS lo, any_value(x.hi) AS hi, any_value((x.lo + x.hi) / 2) AS mid,
           sum(n * size * least(3, exp((x.lo + x.hi) / 2 * size))) AS m
    FROM halved x JOIN h ON h.source IS NOT DISTINCT FROM x.source WHERE x.i < 110 GROUP BY x.i, x.source
  )
), l AS (
  SELECT source, hi AS lam FROM halved WHERE i = 110
), rated AS (
  SELECT d.*, source_size, target, coalesce(floor(least(3, exp(lam * size)) * 1e9 + 0.5), 0)::BIGINT AS nano
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN l ON d.source IS NOT DISTINCT FROM l.source
), c AS (
  SELECT *, nano // 1000000000 AS whole, CASE WHEN size > 0 AND nano % 1000000000 > 0 THEN least(u * 1000000000 // (nano % 1000000000), 1099511627775) ELSE 1099511627775 END AS v
  FROM rated
), q AS (
  SELECT *, greatest(target - sum(whole * size) OVER (PARTITION BY source), 0) AS need,
         coalesce(sum(size) OVER (PARTITION BY source ORDER BY v RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(size) OVER (PARTITION BY source, v) AS tie
  FROM c
)
SELECT doc_id, size, source_size, target,
       (size * least(whole + CASE WHEN before + tie <= need OR (before <= need AND before + tie - need < need - before) THEN 1 ELSE 0 END, 3))::BIGINT AS taken
FROM q
"""

"""Line dedup over overlapping three-line windows.

A window is three consecutive lines that have a word each (blank lines stay where they
are and do not count). Windows are compared over all documents by a 128-bit hash; the
first occurrence, by doc_id and then by position, stays. The lines that any later
occurrence covers are removed, so runs longer than three lines go as a whole.

Null texts stay null and have no lines; texts of fewer than three lines keep all. A null
doc_id sorts first. Rows with equal doc_id and text are one document and fare alike;
equal doc_id with different texts are told apart by a hash of the text. Only hashes and
positions are shuffled before the last join; a very common window is summed map-side, and
its occurrences stream past one row, its first, in as many tasks as adaptive execution
splits them over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW_LINES = 3


def _worded(lines: Column) -> Column:
    """Indexes of the lines with a word."""
    return F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(lines, i).rlike("[^ \\t-\\r]"))


def _windows(docs: DataFrame) -> DataFrame:
    """doc_id, text hash, ordinal of the window's first line, two window hashes."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("t"), F.split("text", "\n").alias("lines"))
    lines = lines.select("doc_id", "t", F.filter("lines", lambda x: x.rlike("[^ \\t-\\r]")).alias("l")).where(F.size("l") >= WINDOW_LINES)
    three = lambda i: [F.get("l", i + k) for k in range(WINDOW_LINES)]
    each = F.transform(
        F.sequence(F.lit(0), F.size("l") - WINDOW_LINES),
        lambda i: F.struct(i.alias("p"), F.xxhash64(*three(i)).alias("h1"), F.xxhash64(F.lit("window"), *three(i)).alias("h2")),
    )
    return lines.select("doc_id", "t", F.inline(each))


def repeated_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text hash t and the starts of windows that occurred before, for documents that have any."""
    windows = _windows(docs.select("doc_id", "text").where("text is not null"))
    here = F.struct("doc_id", "t", "p")
    repeated = windows.groupBy("h1", "h2").agg(F.min(here).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = windows.join(repeated, ["h1", "h2"]).where(~here.eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "t").agg(F.sort_array(F.collect_set("p")).alias("starts"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated lines taken out of text, plus n_lines and n_removed; they replace columns of the same name."""
    marks = repeated_lines(docs)
    held = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64("text").alias("t"))
    joined = held.alias("d").join(marks.alias("m"), F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("d.t") == F.col("m.t")), "left")
    joined = joined.select("row", F.split("row.text", "\n").alias("lines"), "starts")

    def removed(worded: Column) -> Column:
        return F.array_distinct(F.flatten(F.transform("starts", lambda p: F.slice(worded, p + 1, WINDOW_LINES))))

    # the worded indexes are bound once per row by the outer transform
    gone = F.when(F.col("starts").isNotNull(), F.transform(F.array(_worded(F.col("lines"))), removed)[0])
    joined = joined.withColumn("gone", gone)
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n")
    found = {
        "text": F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(kept),
        "n_lines": F.when(F.col("row.text").isNull(), 0).otherwise(F.size("lines")).cast("long"),
        "n_removed": F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long"),
    }
    own = [found.pop(c).alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return joined.select(*own, *[v.alias(k) for k, v in found.items()])


def dedup_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, text_sha256 (of what is left; null text: of nothing)."""
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, text, string_split(text, chr(10)) AS lines FROM documents
), l AS (
  SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d WHERE text IS NOT NULL
), w AS (
  SELECT r, doc_id, line, i, row_number() OVER (PARTITION BY r ORDER BY i) AS p FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), k AS (
  SELECT r, doc_id, i, p, lead(i) OVER o AS i2, lead(i, 2) OVER o AS i3,
         line || chr(10) || lead(line) OVER o || chr(10) || lead(line, 2) OVER o AS win
  FROM w WINDOW o AS (PARTITION BY r ORDER BY p)
), f AS (
  SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, p) AS occurrence FROM k WHERE win IS NOT NULL
), gone AS (
  SELECT DISTINCT r, unnest([i, i2, i3]) AS i FROM f WHERE occurrence > 1
), kept AS (
  SELECT l.r, string_agg(line, chr(10) ORDER BY l.i) AS text FROM l ANTI JOIN gone ON l.r = gone.r AND l.i = gone.i GROUP BY l.r
), n AS (SELECT r, count(*)::BIGINT AS n FROM gone GROUP BY r)
SELECT d.doc_id, coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS text_sha256
FROM d LEFT JOIN kept USING (r) LEFT JOIN n USING (r)
"""

"""A store of window statistics at dyadic widths, kept up by micro-batches; replays are answered from it.

A batch adds its events' sums at every width, base_ms * 2^k, as partial rows: sums merge, so
late events and batches in any order are right, and each width holds half as many windows as
the one below. A batch that is tried again replaces its own rows. ``compact`` merges the partial
rows of a width into one per window. Groups are kept by the values of the declared keys; a
lens may group by any of them.

A replay takes the coarsest width that divides its windows and lies on its grid. Whole windows
of that width come from the store, raw events only at the two ends of the span.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import MISSING_KEY, VALID_COUNT, Lens
from ..operators.lens import _pool, floor_to_window, group_label
from ..operators.retention import segment
from ..sources.storage import Folder, read_table

SUMS = "count long, sum_wv double, sum_sq double, sum_w double, sum_w2 double, min_v double, max_v double"
#: Windows of one width in one folder, by which reads are pruned.
PART_WINDOWS = 4096


class SummaryStore:
    def __init__(self, spark: SparkSession, folder: str, base_ms: int, levels: int = 12, keys: tuple[str, ...] = ()):
        if base_ms <= 0 or levels < 1:
            raise ValueError("a store needs a base width above 0 and a level at least")
        self.spark, self.folder, self.base_ms, self.levels, self.keys = spark, folder, base_ms, levels, keys
        self.schema = ", ".join([*[f"k{i} string" for i in range(len(keys))], f"window_start long, {SUMS}, level int, part long"])

    @property
    def _key_columns(self) -> list[str]:
        return [f"k{i}" for i in range(len(self.keys))]

    def _keyed(self, events: DataFrame) -> DataFrame:
        sound = events.where("ts_ms is not null and value is not null").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
        return sound.select("ts_ms", "value", "weight", *[F.element_at("keys", k).alias(f"k{i}") for i, k in enumerate(self.keys)])

    def add(self, events: DataFrame, batch: int) -> None:
        """Take in a micro-batch of lens events."""
        names = [*self._key_columns, "window_start"]
        level = _pool(self._keyed(events).withColumn("window_start", floor_to_window(F.col("ts_ms"), self.base_ms, F.lit(0))), names, False)
        at = f"{self.folder}/batch={batch}"
        for k in range(self.levels):
            width = self.base_ms * 2**k
            placed = level.withColumns({"level": F.lit(k), "part": F.floor(F.col("window_start") / (width * PART_WINDOWS))})
            placed.write.mode("overwrite" if k == 0 else "append").partitionBy("level", "part").parquet(at)
            if k + 1 < self.levels:  # the next width is made of the one just written
                below = read_table(self.spark, [at], self.schema).where(F.col("level") == k)
                level = _pool(below.withColumn("window_start", floor_to_window(F.col("window_start"), 2 * width, F.lit(0))), names, True)

    def start(self, stream: DataFrame, checkpoint_dir: str, **trigger):
        """Keep the store up with a stream of lens events."""
        query = stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint_dir)
        return query.trigger(**(trigger or {"processingTime": "10 seconds"})).start()

    def compact(self) -> None:
        """One row per window instead of one per batch. No batch may be added meanwhile; a compaction that dies leaves the old rows."""
        files = Folder(self.spark, self.folder)
        old = [n for n in files.names() if n.startswith("batch=")]
        if len(old) < 2:
            return
        names = [*self._key_columns, "window_start", "level", "part"]
        newest = max(int(n.split("=")[1]) for n in old)
        merged = _pool(self._rows(old), names, True)
        merged.write.mode("overwrite").partitionBy("level", "part").parquet(f"{self.folder}/new-{newest}")
        files.write("compacted.json", {"upto": newest, "holds": f"new-{newest}"})  # from here on the new rows count
        for name in [*old, *[n for n in files.names() if n.startswith("new-") and n != f"new-{newest}"]]:
            files.delete(name)

    def _rows(self, names: list[str]) -> DataFrame:
        """Partial rows of the batches ``names`` and of what was compacted before."""
        done = Folder(self.spark, self.folder).read("compacted.json")
        fresh = [n for n in names if done is None or int(n.split("=")[1]) > done["upto"]]
        paths = [f"{self.folder}/{n}" for n in [*([done["holds"]] if done else []), *fresh]]
        rows = [read_table(self.spark, [p], self.schema) for p in paths]
        out = rows[0] if rows else read_table(self.spark, [], self.schema)
        for part in rows[1:]:
            out = out.unionByName(part)
        return out

    def rows(self, level: int, from_ms: int, to_ms: int) -> DataFrame:
        """Partial rows of a width whose windows start in [from_ms, to_ms)."""
        names = [n for n in Folder(self.spark, self.folder).names() if n.startswith("batch=")]
        part = self.base_ms * 2**level * PART_WINDOWS
        out = self._rows(names).where((F.col("level") == level) & F.col("part").between(from_ms // part, to_ms // part))
        return out.where((F.col("window_start") >= from_ms) & (F.col("window_start") < to_ms))

    def level_of(self, lens: Lens) -> int | None:
        """The coarsest width whose windows the lens's are made of; null if its events must be seen one by one."""
        fits = lens.grid == "epoch" and lens.decay is None and all(k in self.keys for k in lens.group_by)
        found = [k for k in range(self.levels) if lens.output_ms % (self.base_ms * 2**k) == 0 and int(lens.origin or 0) % (self.base_ms * 2**k) == 0] if fits else []
        return max(found, default=None)

    def replay(self, read: Callable[[int, int], DataFrame], lens: Lens | dict, from_ms: int, to_ms: int) -> DataFrame:
        """The windows ``apply_lens`` would make of the events in [from_ms, to_ms]; ``read(a, b)`` gives raw lens events of a span, ends included."""
        from ..operators.lens import apply_lens

        lens = Lens.of(lens) if isinstance(lens, dict) else lens
        level = self.level_of(lens)
        width = None if level is None else self.base_ms * 2**level
        first, last = (0, 0) if width is None else (-(-from_ms // width) * width, (to_ms + 1) // width * width)
        if first >= last:
            return apply_lens(segment(read(from_ms, to_ms), from_ms, to_ms), lens)
        sums = ["window_start", "group_label", *[c.split()[0] for c in SUMS.split(", ")]]
        label = self._label(lens)
        on_grid = lambda ts: floor_to_window(F.col(ts), lens.output_ms, F.lit(int(lens.origin or 0)))
        middle = self.rows(level, first, last).withColumn("group_label", label).withColumn("window_start", on_grid("window_start"))
        parts = _pool(middle, ["group_label", "window_start"], True).select(*sums)
        for a, b in ((from_ms, first - 1), (last, to_ms)):
            if a <= b:
                end = self._keyed(segment(read(a, b), a, b)).withColumn("group_label", label).withColumn("window_start", on_grid("ts_ms"))
                parts = parts.unionByName(_pool(end, ["group_label", "window_start"], False).select(*sums))
        windows = _pool(parts, ["group_label", "window_start"], True)
        if lens.group_by:
            windows = windows.unionByName(_pool(windows, ["window_start"], True).withColumn("group_label", F.lit(None).cast("string")))
        return windows.select(
            "group_label", "window_start", (F.col("window_start") + lens.output_ms).alias("window_end"), "count", (F.col("sum_wv") / F.col("sum_w")).alias("mean"),
            "sum_sq", "sum_w", "sum_w2", "min_v", "max_v", (F.col("count") >= VALID_COUNT).alias("valid"),
        )

    def _label(self, lens: Lens) -> Column:
        if not lens.group_by:
            return F.lit(None).cast("string")
        return F.concat_ws("|", *[F.coalesce(F.col(f"k{self.keys.index(k)}"), F.lit(MISSING_KEY)) for k in lens.group_by])


def corrected_windows(stream: DataFrame, lens: Lens, retention_ms: int) -> DataFrame:
    """Window sums of a stream in update mode: a late event brings its window again, corrected, as long as retention holds it.

    The watermark is the retention, so nothing is dropped for being late, only for being old.
    """
    if lens.grid != "epoch" or lens.decay is not None:
        raise ValueError("windows of a stream need an epoch grid and no decay")
    sound = stream.where("ts_ms is not null and value is not null").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    sound = sound.withColumn("at", F.timestamp_millis("ts_ms")).withWatermark("at", f"{retention_ms} milliseconds")
    window = F.window("at", f"{lens.output_ms} milliseconds", startTime=f"{int(lens.origin or 0) % lens.output_ms} milliseconds")
    label = group_label(F.col("keys"), lens.group_by) if lens.group_by else F.lit(None).cast("string")
    w, v = F.col("weight"), F.col("value")
    sums = [F.count("*").alias("count"), F.sum(w * v).alias("sum_wv"), F.sum(w * v * v).alias("sum_sq"), F.sum(w).alias("sum_w"), F.sum(w * w).alias("sum_w2"), F.min(v).alias("min_v"), F.max(v).alias("max_v")]
    rows = sound.groupBy(window.alias("window"), label.alias("group_label")).agg(*sums)
    return rows.select("group_label", F.unix_millis("window.start").alias("window_start"), *[c.split()[0] for c in SUMS.split(", ")])


class CorrectedTable:
    """What :func:`corrected_windows` last said of every window: updates by batch, the newest counts."""

    def __init__(self, spark: SparkSession, folder: str, lens: Lens):
        self.spark, self.folder, self.lens = spark, folder, lens
        self.schema = f"group_label string, window_start long, {SUMS}"

    def start(self, stream: DataFrame, retention_ms: int, checkpoint_dir: str, **trigger):
        rows = corrected_windows(stream, self.lens, retention_ms)
        query = rows.writeStream.outputMode("update").foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{self.folder}/batch={n}"))
        return query.option("checkpointLocation", checkpoint_dir).trigger(**(trigger or {"processingTime": "10 seconds"})).start()

    def windows(self) -> DataFrame:
        """The windows as ``apply_lens`` gives them, without the mixed view of a grouping lens."""
        rows = self.spark.read.schema(f"{self.schema}, batch long").parquet(self.folder)
        sums = F.struct(*[c.split()[0] for c in SUMS.split(", ")])
        rows = rows.groupBy("group_label", "window_start").agg(F.max_by(sums, "batch").alias("s")).select("group_label", "window_start", "s.*")
        return rows.select(
            "group_label", "window_start", (F.col("window_start") + self.lens.output_ms).alias("window_end"), "count", (F.col("sum_wv") / F.col("sum_w")).alias("mean"),
            "sum_sq", "sum_w", "sum_w2", "min_v", "max_v", (F.col("count") >= VALID_COUNT).alias("valid"),
        )

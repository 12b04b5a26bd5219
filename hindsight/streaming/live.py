"""The live tick: micro-batches of events into the retained table, re-observed after each."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from ..model import Curation, Lens
from ..operators import curator, retention
from ..operators.lens import group_label
from ..plans.registry import Registry
from ..sources.storage import Folder, read_table
from . import zones


def observe_tick(retained: DataFrame, lens: Lens | dict, now_ms: int, spans: int = 3, config: Curation = Curation()) -> DataFrame:
    """Tiles of the last whole windows against as many before, on the epoch grid, at ``now_ms``."""
    lens = Lens.of(lens) if isinstance(lens, dict) else lens
    (a, b), (c, d) = retention.live_spans(now_ms, lens.output_ms, spans, int(lens.origin or 0))
    observed, reference = retention.replay_spans(retained, lens, (a, b), (c, d))
    tiles = curator.curate(observed, reference, lens.output_ms, config, bool(lens.group_by))
    return retention.keeping(tiles.withColumn("tick_ts", F.lit(now_ms).cast("long")), observed)


#: Width of a bucket of the retained table.
BUCKET_MS = zones.WIDTH_MS
#: Batches of a bucket above which it is written anew as one.
COMPACT_ABOVE = 16


class LiveSession:
    """Feeds a stream of lens events to a table and curates it once per micro-batch.

    The lens is read from the registry at the start of every batch: a new one looks at
    everything retained. Raw events stay in the table, so no state is lost with an executor.
    The table has a folder for each bucket of time and in it one for each batch; a look lists
    the buckets it needs. Buckets of many batches are compacted, those that retention has let go
    are deleted, after a reference zone, if there is one, has taken its share of their events.
    """

    def __init__(
        self, spark: SparkSession, registry: Registry, table_dir: str, schema: str = "events", view: str | None = None,
        extract: Callable[[DataFrame], DataFrame] | None = None, reference: tuple[int, int] | None = None,
    ):
        """``extract`` makes lens events of the stream's rows; the table keeps what it returns. ``reference``: width and ratio of the thinned zone, which needs a retention."""
        self.spark, self.registry, self.table_dir, self.schema, self.view = spark, registry, table_dir, schema, view
        self.extract = extract or (lambda rows: rows)
        self.reference = reference
        self.last_ms: int | None = None
        self.files = Folder(spark, table_dir)
        self._columns: StructType | None = None

    def _kept_ms(self) -> int | None:
        kept = (self.registry.get_pipeline() or {}).get("retention_window_ms")
        return int(kept) if kept else None

    def _buckets(self) -> list[int]:
        return sorted(int(n.split("=")[1]) for n in self.files.names() if n.startswith("bucket="))

    def _table(self, from_bucket: int | None = None, without_batch: int | None = None) -> DataFrame:
        """The table from a bucket on, with ``bucket``: batches compacted into another are passed over."""
        paths = []
        for bucket in (b for b in self._buckets() if from_bucket is None or b >= from_bucket):
            batches, upto = self._batches(bucket)
            paths += [f"{self.table_dir}/bucket={bucket}/batch={n}" for n in batches if n != without_batch]
        if not paths:
            if self._columns is None:
                raise ValueError("the table holds no events yet")
            return self.spark.createDataFrame([], self._columns).withColumn("bucket", F.lit(None).cast("long"))
        reader = self.spark.read.option("basePath", self.table_dir)
        if self._columns is not None:
            reader = reader.schema(StructType([*self._columns.fields, StructField("bucket", LongType()), StructField("batch", LongType())]))
        rows = reader.parquet(*paths).drop("batch")
        return rows if from_bucket is None else rows.where(F.col("bucket") >= from_bucket)

    def _batches(self, bucket: int) -> tuple[list[int], int]:
        """The batches of a bucket that count, and up to which they are one: batches up to n, compacted, are batch -n - 1 once that is marked done."""
        names = self.files.names(f"bucket={bucket}")
        upto = max((int(n[6:].split(".")[0]) for n in names if n.startswith("_done-")), default=-1)
        found = [int(n[6:]) for n in names if n.startswith("batch=")]
        return sorted(n for n in found if n > upto or n == -upto - 1 and upto >= 0), upto

    def _newest(self) -> int | None:
        """The last event's time; a new session over an old table looks once."""
        if self.last_ms is None and (buckets := self._buckets()):
            self.last_ms = self._table(buckets[-1]).agg(F.max("ts_ms")).first()[0]
        return self.last_ms

    def retained(self, from_ms: int | None = None) -> DataFrame:
        """What the table holds from ``from_ms`` on, less what the pipeline's retention has let go."""
        kept, last = self._kept_ms(), self._newest()
        starts = [x for x in (from_ms, last - kept if kept and last is not None else None) if x is not None]
        events = self._table(max(starts) // BUCKET_MS if starts else None)
        return (events.where(F.col("ts_ms") >= max(starts)) if starts else events).drop("bucket")

    def zone(self) -> zones.ReferenceZone | None:
        kept = self._kept_ms()
        if self.reference is None or not kept or self._columns is None:
            return None
        return zones.ReferenceZone(self.spark, f"{self.table_dir}-reference", kept, *self.reference, self._columns)

    def both_zones(self) -> DataFrame:
        """The fresh events and the thinned ones behind them, as ``retention.zones`` of all events that came."""
        zone = self.zone()
        return self.retained() if zone is None else self.retained().unionByName(zone.held())

    def drop_expired(self) -> list[int]:
        """Delete the buckets that lie before the retention as a whole; returns them."""
        kept = self._kept_ms()
        if not kept or self.last_ms is None:
            return []
        gone = [b for b in self._buckets() if (b + 1) * BUCKET_MS <= self.last_ms - kept]
        for bucket in gone:
            self.files.delete(f"bucket={bucket}")
        return gone

    def compact(self, above: int = COMPACT_ABOVE) -> list[int]:
        """Write buckets of many batches anew as one, which counts as soon as it is marked done; returns them."""
        out = []
        for bucket in self._buckets():
            batches, upto = self._batches(bucket)
            if len(batches) > above:
                newest = max(batches)
                whole = self._table(bucket).where(F.col("bucket") == bucket).drop("bucket")
                whole.coalesce(1).write.mode("overwrite").parquet(f"{self.table_dir}/bucket={bucket}/batch={-newest - 1}")
                self.files.write(f"bucket={bucket}/_done-{newest}.json", {"upto": newest})
                for name in [*[f"batch={n}" for n in batches], *([f"_done-{upto}.json"] if upto >= 0 else [])]:
                    self.files.delete(f"bucket={bucket}/{name}")
                out.append(bucket)
        return out

    def take(self, rows: DataFrame, number: int) -> None:
        """Add a micro-batch to the table and the zone. A batch that is run again replaces its own part."""
        batch = self.extract(rows).where("ts_ms is not null")
        self._columns = batch.schema
        parts = batch.withColumns({"bucket": F.floor(F.col("ts_ms") / BUCKET_MS), "batch": F.lit(number)})
        parts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(self.table_dir)
        own = [f"{self.table_dir}/bucket={b}/batch={number}" for b in self._buckets() if f"batch={number}" in self.files.names(f"bucket={b}")]
        arrived = read_table(self.spark, own, self._columns)
        newest = arrived.agg(F.max("ts_ms")).first()[0]
        before = self._newest()
        self.last_ms = max((x for x in (before, newest) if x is not None), default=None)
        zone = self.zone()
        if zone is not None and self.last_ms is not None:
            zone.age(self._table(without_batch=number), arrived, number, self.last_ms)
        self.drop_expired()
        self.compact()

    def start(self, stream: DataFrame, sink: Callable[[DataFrame], None], checkpoint_dir: str, spans: int = 3, **trigger: Any) -> StreamingQuery:
        """Run until what is there has been seen, or, with another trigger (``processingTime="1 second"``), until stopped."""

        def on_batch(batch: DataFrame, number: int) -> None:
            self.take(batch, number)
            row = self.registry.get_observe(self.schema, self.view)
            if row is not None and self.last_ms is not None:
                lens = Lens.of(row)
                start = self.last_ms - retention.live_lookback_ms(lens.output_ms, spans) - lens.output_ms
                tiles = observe_tick(self.retained(start), lens, self.last_ms, spans)
                sink(tiles)
                retention.release(tiles)

        query = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint_dir)
        return query.trigger(**(trigger or {"availableNow": True})).start()


def windowed_counts(stream: DataFrame, window: str, watermark: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Event-time windows of a stream whose lens is fixed: count, sum and sum of squares per label of the keys ``by``."""
    at = F.timestamp_millis("ts_ms")
    stream = stream.withColumn("at", at).withWatermark("at", watermark)
    label = group_label(F.col("keys"), by) if by else F.lit(None).cast("string")
    return stream.groupBy(F.window("at", window), label.alias("group_label")).agg(F.count("*").alias("count"), F.sum("value").alias("sum_v"), F.sum(F.col("value") * F.col("value")).alias("sum_sq"))

"""Incremental maintenance with Structured Streaming (ST1-ST4).

The lineage event log arrives as files; the streams below keep the
derived relations current:

* ST1 ``stream_edges``: distinct lineage rows (the 6-key of E8) merged into
  a parquet table by ``foreachBatch`` with a left-anti join against what
  earlier epochs stored, so the sink equals the batch distinct at every
  point.
  An optional watermark adds ``dropDuplicatesWithinWatermark`` to shrink
  each micro-batch before the merge; Spark then drops rows later than the
  watermark, so it is off by default (exactness first).
* ST2 ``stream_entity_rollup``: per-entity last run and event count as a
  stateful aggregation in ``update`` mode, upserted by key.
* ST3 ``stream_daily_counts``: per-entity daily event counts in 1-day
  tumbling windows with a watermark; ``append`` mode emits a day once the
  watermark passes its end, and events later than the watermark are
  dropped by design.
* ST4 ``stream_orders_daily``: the demo pipeline — CSV landing ingest (A9)
  to the daily orders roll-up (E14) in ``complete`` mode.

Sinks are parquet tables beside the stream's checkpoint in a folder ``base``: ST1
and ST2 are bucketed by key, their epochs merged as they grow in number
(``KeyedTable``), ST4 has a folder per epoch (``LogTable``). No state lives in the driver, and a
replayed batch rewrites its own epoch, so it cannot change the result. A caller
that gives the same ``base`` again resumes where the last run stopped; without
one, each call starts anew under the checkpoint directory. ``run_available`` drives a query with
``trigger(availableNow=True)``."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..session import checkpoint_dir, materialize

EDGE_KEY = list(G.ROW_KEY)

#: Rows of a bucket in a file of a keyed table, about.
PART_ROWS = 250_000


def _base(spark: SparkSession, tag: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/stream-{tag}-{uuid.uuid4().hex}"


class LogTable:
    """A parquet table written from ``foreachBatch``, one folder per
    micro-batch epoch (``_epoch=N``).

    Nothing is kept in the driver. A batch replayed after a failure
    (foreachBatch is at-least-once) overwrites its own epoch folder with the
    same rows, so replays never duplicate or lose anything."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def read_all(self) -> DataFrame:
        """Every stored row with its ``_epoch``; empty before the first write."""
        try:
            return (self.spark.read.schema(f"{self.schema}, _epoch long").option("basePath", self.path)
                    .parquet(self.path))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], f"{self.schema}, _epoch long")

    def before(self, epoch: int) -> DataFrame:
        """Rows written by earlier epochs only (what a replay must compare to)."""
        return self.read_all().filter(F.col("_epoch") < epoch).drop("_epoch")

    def append(self, df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/_epoch={epoch}")

    def latest_by_key(self, keys: list[str]) -> DataFrame:
        """Upsert view: per key, the row of the newest epoch."""
        rows = self.read_all()
        vals = [c for c in rows.columns if c not in keys and c != "_epoch"]
        agg = [F.max_by(F.col(c), F.col("_epoch")).alias(c) for c in vals]
        return rows.groupBy(*keys).agg(*agg)

    def latest_epoch(self) -> DataFrame:
        """Complete-mode view: the rows of the newest epoch."""
        rows = self.read_all()
        last = rows.agg(F.max("_epoch").alias("_epoch"))
        return rows.join(last, "_epoch", "left_semi").drop("_epoch")


class KeyedTable:
    """A stream's parquet table, bucketed by a hash of ``keys``, in folders
    ``run-<first>-<last>`` of the epochs they hold.

    An epoch writes a run of its own; a replay overwrites it with the same
    rows. Before epoch E, for every power p of ``fan`` that divides E, the runs
    of the last p epochs are merged bucket by bucket into one, so a reader
    opens about ``fan`` runs for each power, however many epochs there were, and a
    row is rewritten once for each. A run counts once its ``_SUCCESS`` file is
    there, and a wider one stands for those within it, so a merge takes effect at
    once or not at all; a merge cut short is written anew. Only epochs before
    the running one are merged, so a replay meets what the first attempt met.
    Runs stay until a later merge of their width or more, so a frame read
    before the last merge can still be computed, one from before the merge
    before that cannot.

    With ``newest``, a key's row of the newest epoch is its value and merges keep
    only that. ``buckets`` is fixed for a table's life. A lookup of a
    micro-batch reads the buckets that its keys fall into, as partitions."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], newest: bool = False,
                 buckets: int = 64, fan: int = 8):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), f"{schema}, _epoch long"
        self.keys, self.newest, self.buckets, self.fan = keys, newest, buckets, fan
        self.folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self.files = self.folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _path(self, run: tuple[int, int]):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/run-{run[0]}-{run[1]}")

    def _stored(self) -> list[tuple[int, int]]:
        """Complete runs, each before those within it."""
        if not self.files.exists(self.folder):
            return []
        names = [f.getPath().getName().split("-") for f in self.files.listStatus(self.folder)]
        runs = [(int(n[1]), int(n[2])) for n in names if n[0] == "run"]
        done = [r for r in runs if self.files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(self._path(r), "_SUCCESS"))]
        return sorted(done, key=lambda r: (r[0], -r[1]))

    def runs(self, first: int = 0, last: int | None = None) -> list[tuple[int, int]]:
        """The runs to read for the epochs from ``first`` to ``last``: none is within another."""
        out: list[tuple[int, int]] = []
        for run in self._stored():
            if run[0] >= first and (last is None or run[1] <= last) and not (out and run[1] <= out[-1][1]):
                out.append(run)
        return out

    def read(self, first: int = 0, last: int | None = None, only: list[int] | None = None) -> DataFrame:
        """Rows of these epochs with ``_epoch`` and ``_bucket``; of the buckets ``only``, if given."""
        paths = [str(self._path(r).toString()) for r in self.runs(first, last)]
        if not paths:
            return self.spark.createDataFrame([], f"{self.schema}, _bucket int")
        frames = [self.spark.read.schema(f"{self.schema}, _bucket int").option("basePath", p).parquet(p) for p in paths]
        out = reduce(DataFrame.unionByName, frames)
        return out if only is None else out.where(F.col("_bucket").isin(only))

    def lookup(self, batch: DataFrame, epoch: int) -> DataFrame:
        """Rows of earlier epochs in the buckets that ``batch`` touches; at most ``buckets`` numbers reach the driver."""
        return self.read(last=epoch - 1, only=[r[0] for r in batch.select(self.bucket()).distinct().collect()])

    def append(self, df: DataFrame, epoch: int, most: int | None = None) -> None:
        """Write an epoch's rows, ``most`` at most; counted if that is not known."""
        most = df.count() if most is None else most
        self._write(df.withColumn("_epoch", F.lit(epoch).cast("long")).withColumn("_bucket", self.bucket()), (epoch, epoch), most)

    def parts(self, most: int) -> int:
        """Files of a bucket when a run of ``most`` rows is written: as many as its rows need, as a file costs time however small it is."""
        return 1 + most // (self.buckets * PART_ROWS)

    def _write(self, df: DataFrame, run: tuple[int, int], most: int) -> None:
        # a large bucket over several tasks; "static": a half-written run goes whole
        dealt = df.repartition(F.col("_bucket"), F.pmod(F.xxhash64(*self.keys, F.lit(1)), F.lit(self.parts(most))))
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("_bucket").parquet(str(self._path(run).toString()))

    def compact(self, epoch: int) -> None:
        """Merge the runs that end just before ``epoch``."""
        width = self.fan
        while epoch and epoch % width == 0:
            run = (epoch - width, epoch - 1)
            if run not in self._stored():
                rows = self.read(*run)
                self._write(self._valid(rows), run, rows.count())
                for old in self._stored():  # what wider runs of an earlier merge stand for
                    if old[1] < run[0] and any(w != old and w[0] <= old[0] and old[1] <= w[1] for w in self._stored()):
                        self.files.delete(self._path(old), True)
            width *= self.fan

    def _valid(self, rows: DataFrame) -> DataFrame:
        if not self.newest:
            return rows
        values = [c for c in rows.columns if c not in (*self.keys, "_bucket")]
        best = F.max_by(F.struct(*values), F.col("_epoch")).alias("_best")
        return rows.groupBy(*self.keys, "_bucket").agg(best).select(*self.keys, "_bucket", "_best.*")

    def current(self) -> DataFrame:
        """The table's rows; with ``newest`` the newest of each key."""
        return self._valid(self.read()).drop("_epoch", "_bucket")


def run_available(query_writer, name: str):
    """Start a stream with the availableNow trigger and wait for it."""
    q = query_writer.trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(f"stream {name} failed: {q.exception()}")
    return q


def read_event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """The event log as a file stream, ``event_time`` turned into the UTC
    instant it denotes (watermarks require zoned timestamps; the conversion
    does not depend on the session time zone)."""
    from ..functions.predicates import ntz_to_instant
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return s.withColumn("event_time", ntz_to_instant("event_time"))


def stream_edges(events: DataFrame, watermark: str | None = None, base: str | None = None) -> DataFrame:
    """ST1: maintain the distinct 6-key lineage rows; returns the sink."""
    spark = events.sparkSession
    base = base or _base(spark, "edges")
    sink = KeyedTable(spark, f"{base}/table", ", ".join(f"{c} string" for c in EDGE_KEY), EDGE_KEY)
    s = events.select(*EDGE_KEY, "event_time")
    if watermark:
        s = s.withWatermark("event_time", watermark).dropDuplicatesWithinWatermark(EDGE_KEY)
    s = s.select(*EDGE_KEY)

    def merge(batch: DataFrame, epoch: int) -> None:
        sink.compact(epoch)
        b = materialize(batch.distinct(), "stream-batch")  # read twice below; the source only once
        cur = sink.lookup(b, epoch)
        fresh = b.join(cur, [b[c].eqNullSafe(cur[c]) for c in EDGE_KEY], "left_anti")
        sink.append(fresh, epoch, b.count())  # rows no earlier epoch stored; a replay rewrites the same set

    run_available(s.writeStream.foreachBatch(merge).option("checkpointLocation", f"{base}/ckpt"), "edges")
    return sink.current()


def stream_entity_rollup(events: DataFrame, base: str | None = None) -> DataFrame:
    """ST2: per-entity last run and event count, upserted by key from the
    ``update``-mode output of a stateful aggregation (state holds one row
    per entity)."""
    spark = events.sparkSession
    base = base or _base(spark, "rollup")
    key = ["entity_type", "entity_id"]
    sink = KeyedTable(spark, f"{base}/table", "entity_type string, entity_id string, last_run timestamp, events bigint", key, newest=True)
    agg = (events.filter(F.col("entity_type").isNotNull() & F.col("entity_id").isNotNull()
                         & (F.col("entity_type") != "") & (F.col("entity_id") != ""))
           .groupBy("entity_type", "entity_id")
           .agg(F.max("event_time").alias("last_run"), F.count("*").alias("events")))

    def upsert(batch: DataFrame, epoch: int) -> None:
        sink.compact(epoch)
        b = materialize(batch, "stream-batch")  # counted and written; the state only once
        sink.append(b, epoch, b.count())  # update mode: full values of the changed keys

    run_available(agg.writeStream.outputMode("update").foreachBatch(upsert)
                  .option("checkpointLocation", f"{base}/ckpt"), "rollup")
    return sink.current()


def stream_daily_counts(events: DataFrame, watermark: str = "1 day", base: str | None = None) -> DataFrame:
    """ST3: per-entity events per 1-day tumbling window, append mode."""
    spark = events.sparkSession
    base = base or _base(spark, "daily")
    out = f"{base}/table"
    agg = (events.filter(F.col("entity_type").isNotNull() & F.col("entity_id").isNotNull())
           .withWatermark("event_time", watermark)
           .groupBy(F.window("event_time", "1 day"), "entity_type", "entity_id")
           .agg(F.count("*").alias("events"))
           .select(F.col("window.start").alias("day"), "entity_type", "entity_id", "events"))
    run_available(agg.writeStream.outputMode("append").format("parquet").option("path", out)
                  .option("checkpointLocation", f"{base}/ckpt"), "daily")
    return spark.read.parquet(out)


def stream_orders_daily(spark: SparkSession, landing: str, base: str | None = None) -> DataFrame:
    """ST4: landing CSV stream -> daily orders and revenue (complete mode)."""
    from ..operators.medallion import ingest_orders_stream, orders_daily
    base = base or _base(spark, "orders")
    sink = LogTable(spark, f"{base}/table", "order_date date, orders bigint, revenue double")
    agg = orders_daily(ingest_orders_stream(spark, landing))

    def replace(batch: DataFrame, epoch: int) -> None:
        sink.append(batch, epoch)  # complete mode: each epoch is the whole result

    run_available(agg.writeStream.outputMode("complete").foreachBatch(replace)
                  .option("checkpointLocation", f"{base}/ckpt"), "orders")
    return sink.latest_epoch()

"""Registered streaming queries (ST1-ST4): each runs its stream to the end
of the available input and returns the maintained sink, which must equal
the batch result (ST3: the days closed by the watermark)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import predicates as P
from ..operators import graph as G
from ..operators import medallion as MD
from ..session import checkpoint_dir
from ..streaming import incremental as ST
from . import common as C
from .common import register

TL = ("table_lineage",)
EV = ("ev", C.EV_SQL)
_FILES = 8
#: Bytes of a row group of the event files: Spark splits a file between tasks only where groups end.
_GROUP_BYTES = 8 << 20


def _event_files(spark, sf) -> tuple[str, object]:
    """The lineage log as time-ordered files (the stream's input): one write,
    range-partitioned by event time, in small row groups, so that a few large
    files are read by as many tasks as there are cores; then the files' modification times, by
    which a file stream orders them, are set in the order of the ranges, as
    in a live log."""
    ev = C.fx(spark, sf, "table_lineage")
    path = f"{checkpoint_dir(spark).rstrip('/')}/event-files-{uuid.uuid4().hex}"
    ev.repartitionByRange(_FILES, "event_time").write.option("parquet.block.size", _GROUP_BYTES).parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = sorted((f.getPath() for f in files.listStatus(folder) if f.getPath().getName().startswith("part-")), key=lambda f: f.getName())
    for i, part in enumerate(parts):
        files.setTimes(part, 1_700_000_000_000 + 1000 * i, -1)
    return path, ev.schema


def _events(spark, sf):
    path, schema = _event_files(spark, sf)
    s = ST.read_event_stream(spark, path, schema, files_per_trigger=2)
    s = P.within_window(s, C.AS_OF, C.DAYS, "event_time")
    return P.drop_internal(s)


@register("stream_edges", C.oracle(TL, [EV], "SELECT DISTINCT " + ", ".join(G.ROW_KEY) + " FROM ev"))
def q_stream_edges(spark, sf):
    """ST1: distinct lineage rows maintained incrementally (foreachBatch
    anti-join merge); equals the batch distinct."""
    return ST.stream_edges(_events(spark, sf))


@register("stream_edges_watermarked", C.oracle(TL, [EV], "SELECT DISTINCT " + ", ".join(G.ROW_KEY) + " FROM ev"))
def q_stream_edges_watermarked(spark, sf):
    """ST1 with 30 minutes of dedupe state: files arrive in the order of event
    time, so no row is later than the watermark and the sink equals the batch
    distinct."""
    return ST.stream_edges(_events(spark, sf), watermark="30 minutes")


@register("stream_entity_rollup", C.oracle(TL, [EV], """
SELECT entity_type, entity_id, CAST(max(event_time) AS VARCHAR) AS last_run, count(*) AS events FROM ev
WHERE entity_type IS NOT NULL AND entity_id IS NOT NULL AND entity_type <> '' AND entity_id <> ''
GROUP BY entity_type, entity_id"""))
def q_stream_rollup(spark, sf):
    """ST2: per-entity last run and event count, update mode + upsert."""
    r = ST.stream_entity_rollup(_events(spark, sf))
    return r.withColumn("last_run", P.instant_to_ntz("last_run").cast("string"))


@register("stream_daily_counts", C.oracle(TL, [EV, ("er", "SELECT * FROM ev WHERE entity_type IS NOT NULL AND entity_id IS NOT NULL")], """
SELECT CAST(date_trunc('day', event_time) AS VARCHAR) AS day, entity_type, entity_id, count(*) AS events
FROM er GROUP BY date_trunc('day', event_time), entity_type, entity_id
HAVING date_trunc('day', event_time) + INTERVAL 1 DAY <= (SELECT max(event_time) FROM er) - INTERVAL 1 DAY"""))
def q_stream_daily(spark, sf):
    """ST3: per-entity daily counts in watermarked 1-day windows (append):
    exactly the days closed by the final watermark (max event time - 1 day)."""
    r = ST.stream_daily_counts(_events(spark, sf))
    return r.withColumn("day", P.instant_to_ntz("day").cast("string"))


@register("stream_orders_daily", C.oracle(("bronze_orders",), [], """
SELECT CAST(CAST(order_ts AS DATE) AS VARCHAR) AS order_date, count(*) AS orders,
       CAST(sum(CAST(amount AS DECIMAL(18, 2))) AS DOUBLE) AS revenue FROM bronze_orders GROUP BY 1"""))
def q_stream_orders(spark, sf):
    """ST4: landing CSV stream to daily orders (complete mode); equals E14."""
    landing = MD.write_landing(C.fx(spark, sf, "bronze_orders"),
                               f"{checkpoint_dir(spark).rstrip('/')}/landing-{uuid.uuid4().hex}")
    r = ST.stream_orders_daily(spark, landing)
    return r.withColumn("order_date", F.col("order_date").cast("string"))

"""Stream sinks: replayed micro-batches must not change the result."""
import datetime as dt
import uuid

import pytest
from lineage_data import lineage_rows

from lineaweave.session import checkpoint_dir
from lineaweave.streaming import incremental as ST
from lineaweave.streaming.incremental import LogTable


def test_log_table_replay_is_idempotent(spark):
    path = f"{checkpoint_dir(spark)}/test-log-{uuid.uuid4().hex}"
    t = LogTable(spark, path, "k string, v bigint")
    assert t.read_all().count() == 0
    b0 = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v bigint")
    b1 = spark.createDataFrame([("a", 5)], "k string, v bigint")
    t.append(b0, 0)
    t.append(b1, 1)
    t.append(b1, 1)  # replay of epoch 1 after a failure
    assert {tuple(r) for r in t.latest_by_key(["k"]).collect()} == {("a", 5), ("b", 1)}
    assert sorted(tuple(r) for r in t.latest_epoch().collect()) == [("a", 5)]
    assert t.read_all().count() == 3
    assert t.before(1).count() == 2


def test_streams_resume_where_they_stopped(spark, monkeypatch):
    base = f"{checkpoint_dir(spark)}/test-resume-{uuid.uuid4().hex}"
    runs, run = [], ST.run_available
    monkeypatch.setattr(ST, "run_available", lambda *a: runs.append(run(*a)) or runs[-1])
    first = lineage_rows(spark, [("a.b.x", "a.b.y", "JOB", "1"), ("a.b.x", "a.b.y", "JOB", "1"), ("a.b.y", "a.b.z", "JOB", "2")])
    later = lineage_rows(spark, [("a.b.x", "a.b.y", "JOB", "1"), ("a.b.z", "a.b.w", "JOB", "2")])
    for k, rows in enumerate((first, later)):
        rows.coalesce(1).write.mode("append").parquet(f"{base}/in")
        events = ST.read_event_stream(spark, f"{base}/in", first.schema)
        edges = ST.stream_edges(events, base=f"{base}/edges")
        rollup = ST.stream_entity_rollup(events, base=f"{base}/rollup")
        read = [sum(p.numInputRows for p in q.recentProgress) for q in runs[-2:]]
        assert read == [[3, 3], [2, 2]][k]  # the second run reads the new rows only
    every = first.unionByName(later)
    assert sorted(map(tuple, edges.collect()), key=str) == sorted(map(tuple, every.select(*ST.EDGE_KEY).distinct().collect()), key=str)
    assert {(r["entity_id"], r["events"]) for r in rollup.collect()} == {("1", 3), ("2", 2)}
    assert rollup.first()["last_run"].replace(tzinfo=None) == dt.datetime(2024, 1, 10, 12)


def test_unreadable_sink_is_an_error(spark):
    sink = LogTable(spark, f"nosuchscheme://{uuid.uuid4().hex}/x", "k string")
    with pytest.raises(Exception, match="nosuchscheme"):
        sink.read_all()


def test_watermark_drops_only_rows_that_come_too_late(spark):
    """Dedupe state of 30 minutes: a row is dropped if a batch before it has seen a time over 30 minutes later."""
    base = f"{checkpoint_dir(spark)}/test-late-{uuid.uuid4().hex}"
    noon = dt.datetime(2024, 1, 10, 12)
    schema = lineage_rows(spark, [("a.b.x", "a.b.y", "JOB", "1")]).schema

    def land(*rows):
        out = [(s, "a.b.y", "TABLE", "TABLE", None, None, "JOB", "1", noon + dt.timedelta(minutes=m), "u", "a", "b", "a", "b") for s, m in rows]
        spark.createDataFrame(out, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        events = ST.read_event_stream(spark, f"{base}/in", schema)
        return {r[0] for r in ST.stream_edges(events, watermark="30 minutes", base=f"{base}/edges").collect()}

    assert land(("first", 0), ("first", 1)) == {"first"}
    assert land(("ahead", 90)) == {"first", "ahead"}
    # 70 is within the 30 minutes before 90; 20 is not; a copy of a stored row changes nothing
    assert land(("within", 70), ("late", 20), ("first", 80)) == {"first", "ahead", "within"}


def test_keyed_table_merges_epochs(spark):
    """Twenty epochs of a few keys: the newest value of each, few runs to open, replays and a merge cut short change nothing."""
    path = f"{checkpoint_dir(spark)}/test-keyed-{uuid.uuid4().hex}"
    t = ST.KeyedTable(spark, path, "k string, v bigint", ["k"], newest=True, buckets=4, fan=2)
    want = {}
    for epoch in range(9):
        rows = [(f"k{epoch % 3}", epoch), (None, epoch)]
        want.update(rows)
        for attempt in range(2 if epoch in (3, 4, 8) else 1):  # replays, also of an epoch before which runs are merged
            t.compact(epoch)
            t.append(spark.createDataFrame(rows, "k string, v bigint"), epoch)
        assert {tuple(r) for r in t.current().collect()} == set(want.items())
    assert t.runs() == [(0, 7), (8, 8)]
    assert t.read(last=7).count() == 4  # merged runs hold one row a key
    # a merge whose writer was lost: its parts are there, its mark is not; what it was to stand for still is
    t.files.delete(spark._jvm.org.apache.hadoop.fs.Path(t._path((0, 7)), "_SUCCESS"), False)
    assert t.runs() == [(0, 3), (4, 7), (8, 8)]
    assert {tuple(r) for r in t.current().collect()} == set(want.items())
    t.compact(8)
    assert t.runs() == [(0, 7), (8, 8)]


def test_keyed_lookup_reads_touched_buckets(spark):
    path = f"{checkpoint_dir(spark)}/test-buckets-{uuid.uuid4().hex}"
    t = ST.KeyedTable(spark, path, "k string", ["k"], buckets=16)
    t.append(spark.range(500).selectExpr("concat('k', id) AS k"), 0)
    some = spark.createDataFrame([("k7",), ("new",)], "k string")
    found = t.lookup(some, 1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_bucket" in plan or "PartitionFilters: [_bucket" in plan
    assert found.where("k = 'k7'").count() == 1 and found.select("_bucket").distinct().count() <= 2
    assert t.lookup(some, 0).count() == 0  # a replay of epoch 0 meets nothing


def test_stream_of_many_epochs_equals_the_batch(spark):
    """Nine files, a file an epoch, over two runs of the stream: rows that come again in a later epoch are stored once."""
    base = f"{checkpoint_dir(spark)}/test-many-{uuid.uuid4().hex}"
    every = None
    for part in range(2):
        for k in range(5):
            rows = lineage_rows(spark, [("a.b.x", "a.b.y", "JOB", "1"), (f"a.b.x{k}", "a.b.y", "JOB", str(k)), (None, "a.b.y", "JOB", str(part))])
            rows.coalesce(1).write.mode("append").parquet(f"{base}/in")
            every = rows if every is None else every.unionByName(rows)
        events = ST.read_event_stream(spark, f"{base}/in", every.schema)
        edges = ST.stream_edges(events, base=f"{base}/edges").collect()
        rollup = {r["entity_id"]: r["events"] for r in ST.stream_entity_rollup(events, base=f"{base}/rollup").collect()}
    assert sorted(map(tuple, edges), key=str) == sorted(map(tuple, every.select(*ST.EDGE_KEY).distinct().collect()), key=str)
    assert rollup == {r["entity_id"]: r["count"] for r in every.groupBy("entity_id").count().collect()}
    names = {p.name for p in __import__("pathlib").Path(f"{base.removeprefix('file:')}/edges/table").iterdir()}
    assert "run-0-7" in names


def test_small_runs_have_a_file_for_each_bucket(spark, tmp_path):
    t = ST.KeyedTable(spark, f"{tmp_path}/t", "k string", ["k"])
    t.append(spark.range(2000).selectExpr("concat('k', id) AS k"), 0)
    assert t.current().count() == 2000
    assert len(list(tmp_path.glob("t/run-0-0/_bucket=*/part-*"))) == 64
    assert t.parts(2000) == 1 and t.parts(64 * ST.PART_ROWS * 3) == 4

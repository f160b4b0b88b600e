"""Sliding-window quota (W1) against brute force, across bucket edges."""
import datetime as dt
import random

from lineaweave.operators import requests as RQ


def test_over_quota_matches_brute_force(spark):
    rnd = random.Random(7)
    base = dt.datetime(2024, 1, 1)
    rows = []
    for u in range(6):
        t = 0.0
        for _ in range(300):
            t += rnd.expovariate(1 / (3 if u < 2 else 40))
            rows.append((base + dt.timedelta(seconds=t), f"u{u}", 1.0))
    log = spark.createDataFrame(rows, "ts timestamp_ntz, user_key string, latency_ms double")
    for n, secs, bucket in ((5, 60, 120), (3, 10, 3600)):
        got = {r.user_key: (r.max_in_window, r.n_over) for r in RQ.over_quota(log, n, secs, bucket).collect()}
        want = {}
        by = {}
        for ts, u, _ in rows:
            by.setdefault(u, []).append(ts)
        for u, ts in by.items():
            ts.sort()
            counts = [sum(1 for y in ts if dt.timedelta(0) <= x - y < dt.timedelta(seconds=secs)) for x in ts]
            if max(counts) > n:
                want[u] = (max(counts), sum(c > n for c in counts))
        assert got == want


def test_latency_index_picks(spark):
    rows = [(dt.datetime(2024, 1, 1, 0, 0, i), "u", float(i)) for i in range(10)]
    log = spark.createDataFrame(rows, "ts timestamp_ntz, user_key string, latency_ms double")
    r = RQ.latency_summary(log).first()
    assert (r.p50_ms, r.p95_ms, r.p99_ms, r.sample_count) == (5.0, 9.0, 9.0, 10)
    empty = RQ.latency_summary(log.limit(0)).first()
    assert (empty.p50_ms, empty.sample_count) == (0.0, 0)

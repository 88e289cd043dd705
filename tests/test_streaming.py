"""The streaming run state equals the batch latest state, also after a
second append (incremental state)."""

import datetime as dt

from tablescope.operators.history import run_latest_state
from tablescope.sources.files import scratch_path
from tablescope.sources.sinks import append_run_events, read_run_events
from tablescope.streaming.run_state import read_run_state, run_state_stream


def test_stream_matches_batch(spark):
    t = dt.datetime(2024, 1, 1)
    ev = spark.createDataFrame(
        [(f"r{i % 5}", t + dt.timedelta(seconds=i), "running" if i % 2 else "complete",
          f"f{i}.csv", None if i % 3 else f'{{"i":{i}}}', None) for i in range(50)],
        "id string, ts timestamp_ntz, status string, filename string, report_json string, error_msg string")
    events, state, ckpt = scratch_path(spark, "ev"), scratch_path(spark, "st"), scratch_path(spark, "ck")
    append_run_events(ev.where("ts < '2024-01-01 00:00:25'"), events)
    run_state_stream(spark, events, state, ckpt).awaitTermination()
    append_run_events(ev.where("ts >= '2024-01-01 00:00:25'"), events)
    run_state_stream(spark, events, state, ckpt).awaitTermination()
    got = sorted(map(tuple, read_run_state(spark, state).collect()))
    want = sorted(map(tuple, run_latest_state(read_run_events(spark, events)).collect()))
    assert got == want

"""Heartbeats as keyed state of a stream."""

import datetime as dt
import os

from fablake.streaming import heartbeat_stream as hbs

DAY = dt.datetime(2024, 1, 1)


def test_late_repeated_and_tied_beats(spark, tmp_dir):
    landing, out, ckpt = (os.path.join(tmp_dir, x) for x in ("landing", "out", "ckpt"))
    hour = lambda h: DAY + dt.timedelta(hours=h)
    arrivals = [[("a", "up", hour(5), 1), ("b", "up", hour(1), 2)], [("a", "late", hour(4), 3), ("b", "down", hour(40), 4), (None, "x", hour(90), 9)],
                [("a", "tie", hour(5), 7), ("a", "lesser", hour(5), 6), ("c", "up", hour(39), 5)], [("a", "up", hour(5), 1), ("d", "never", None, 8)]]
    for n, rows in enumerate(arrivals):
        spark.createDataFrame(rows, hbs.BEAT).coalesce(1).write.parquet(f"{landing}/{n}")
        hbs.run_heartbeats(spark, landing, out, ckpt)
    hbs.run_heartbeats(spark, landing, out, ckpt)
    states = {r.agent_id: (r.status, r.created_at, r.silent) for r in hbs.agent_states(spark, out).collect()}
    assert states == {"a": ("tie", hour(5), True), "b": ("down", hour(40), False), "c": ("up", hour(39), False)}

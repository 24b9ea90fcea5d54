"""Keywords watched with state that goes away."""

import datetime as dt
import json

from galley.streaming import ingest, state


def run(spark, folder, name, rows, **more):
    (folder / "in").mkdir(exist_ok=True)
    (folder / "in" / name).write_text("\n".join(json.dumps({"link": "l", "source": "s", "title": "t", "ts": f"{day}T00:00:00", "keywords": keywords}) for day, keywords in rows))
    out = state.rises(ingest.arriving(spark, str(folder / "in"), files_per_trigger=1), **more)
    q = out.writeStream.format("json").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    operators = [o for p in q.recentProgress for o in p["stateOperators"]]
    got = spark.read.schema(state.RISES).json(str(folder / "out")).collect()
    return sorted((r.keyword, r.event, r.day, r.n) for r in got), operators


def test_a_rise_is_told_once_and_state_goes(spark, tmp_path):
    spark.conf.set(*state.ROCKS)
    try:
        told, _ = run(spark, tmp_path, "a.json", [("2024-01-01", ["x", "y"]), ("2024-01-05", ["x"]), ("2024-01-20", ["y"])], keep=30)
        assert told == []
        told, _ = run(spark, tmp_path, "b.json", [("2024-01-21", ["y", "x"]), ("2024-01-22", ["y"]), ("2024-01-22", ["y", None])], keep=30)
        assert told == [("y", "rise", dt.date(2024, 1, 22), 4)]
        # a year later: both are gone, and a new rise of y is told again
        told, _ = run(spark, tmp_path, "c.json", [("2025-01-01", ["z"])], keep=30)
        told, seen = run(spark, tmp_path, "d.json", [("2025-01-02", ["y"]), ("2025-01-03", ["y"]), ("2025-01-03", ["y"])], keep=30)
        assert ("x", "gone", dt.date(2024, 2, 20), 3) in told
        assert [t for t in told if t[0] == "y"] == [("y", "gone", dt.date(2024, 2, 21), 5), ("y", "rise", dt.date(2024, 1, 22), 4), ("y", "rise", dt.date(2025, 1, 3), 3)]
        assert not [t for t in told if t[0] == "z"]
    finally:
        spark.conf.unset(state.ROCKS[0])

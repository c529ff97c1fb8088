"""Exception events that silence closes, over several batches, with timers on the watermark."""

from __future__ import annotations

import datetime as dt

from lingot.streaming import log_streams

HEAD, FRAME = "java.lang.NullPointerException: {}", "    at com.game.{}.run(A.java:1)"


def test_silence_closes_across_batches(spark, tmp_path):
    day = dt.datetime(2024, 5, 1)
    batches = [
        [(1, 1, HEAD.format("a"), 0), (1, 2, FRAME.format("A"), 10), (2, 1, HEAD.format("b"), 20), (3, 1, FRAME.format("Lost"), 0)],
        [(1, 3, FRAME.format("B"), 50), (1, 4, FRAME.format("A"), 60), (2, 2, FRAME.format("Late"), 900), (2, 3, HEAD.format("c"), 910), (2, 4, "Caused by: java.lang.OutOfMemoryError", 920)],
        [(4, 1, HEAD.format("d"), 5000), (4, 2, FRAME.format("D"), 5010)],
        [(1, 5, FRAME.format("Z"), 5020), (4, 3, FRAME.format("E"), 5030)],
    ]
    schema = "log_id long, line_no int, line string, ts timestamp"
    source = tmp_path / "log"
    for i, rows in enumerate(batches):
        spark.createDataFrame([(a, n, s, day + dt.timedelta(seconds=t)) for a, n, s, t in rows], schema).coalesce(1).write.mode("append").parquet(f"file://{source}/b={i}")
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"file://{source}/b=*")
    out = f"file://{tmp_path}/out"
    try:
        for _ in range(2):  # the second start finds nothing new
            query = log_streams.closing_sessions(stream, silence=300, late="60 seconds").writeStream.format("parquet").option("path", out).option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
            query.awaitTermination()
    finally:
        spark.conf.set(name, before)
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    # log 4 still speaks; its event stays open
    assert got == [(1, 0, "NullPointerException", False, "com.game.A|com.game.B"), (2, 0, "NullPointerException", False, ""), (2, 1, "NullPointerException", False, ""), (2, 2, "OutOfMemoryError", True, "")]

"""Streams over the given tables, run to their end: a file stream of events, its result written and read."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .functions import constants as K
from .operators.memory import validate_rows
from .plans import versions
from .plans.scratch import scratch_dir
from .queries_compat import EXCHANGE, _exchange, _existing
from .queries_logs import EVENTS, ISSUES
from .sources import tables as src
from .streaming import log_streams as L


def _replayed(spark, stream):
    """The rows that a stream has appended when all its files are read."""
    path = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def _events(spark, sf_dir):
    """Events as a file stream: sorted by time, so that no row is late."""
    path = f"{scratch_dir(spark)}/events-{uuid.uuid4().hex}"
    src.read(spark, sf_dir, "events").write.parquet(path)
    return spark.readStream.schema(src.read(spark, sf_dir, "events").schema).parquet(path)


def r1_streamed_lines(spark, sf_dir):
    log = src.log_lines(spark, sf_dir)
    path = f"{scratch_dir(spark)}/log-{uuid.uuid4().hex}"
    log.write.parquet(path)
    return _replayed(spark, L.classified(spark.readStream.schema(log.schema).parquet(path))).select("log_id", "line_no", "token", "severity")


def r2_windowed_counts(spark, sf_dir):
    """Closed hourly windows; the watermark holds back those that may still get rows."""
    got = _replayed(spark, L.severity_counts(_events(spark, sf_dir)))
    return got.groupBy("event_type").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("windows"))


def r3_exception_sessions(spark, sf_dir):
    """Events that a later header has closed; the last of each log stays open in the state."""
    log = src.log_lines(spark, sf_dir)
    path = f"{scratch_dir(spark)}/log-{uuid.uuid4().hex}"
    log.write.parquet(path)
    return _replayed(spark, L.exception_sessions(spark.readStream.schema(log.schema).parquet(path)))


SILENCE = 6 * 3600
_STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


def r3_closing_sessions(spark, sf_dir):
    """Events that a header or six hours of silence have closed, the last by a timer once the watermark is past it."""
    log = src.log_lines(spark, sf_dir)
    path = f"{scratch_dir(spark)}/log-{uuid.uuid4().hex}"
    log.write.parquet(path)
    before = spark.conf.get(_STATE_STORE)
    spark.conf.set(_STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return _replayed(spark, L.closing_sessions(spark.readStream.schema(log.schema).parquet(path), SILENCE))
    finally:
        spark.conf.set(_STATE_STORE, before)


def r4_streamed_import(spark, sf_dir):
    """The store after exchange rows that arrive as files are validated and upserted."""
    rows, strings, existing = _exchange(spark, sf_dir), src.strings(spark, sf_dir), _existing(spark, sf_dir)
    path, store = f"{scratch_dir(spark)}/exchange-{uuid.uuid4().hex}", f"{scratch_dir(spark)}/store-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(path)  # the text of a row stands in it three times
    files = spark.readStream.schema(rows.schema).parquet(path)
    query = L.import_stream(files, lambda df: validate_rows(df, strings, existing), store, f"{store}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return versions.load(spark, store).rows.select(F.sha2("key", 256).alias("key_sha256"), "translation")


QUERIES = {f.__name__: f for f in (r1_streamed_lines, r2_windowed_counts, r3_exception_sessions, r3_closing_sessions, r4_streamed_import)}
ORACLE_SQL = {
    "r4_streamed_import": f"WITH RECURSIVE {EXCHANGE} SELECT sha256(e.key) AS key_sha256, trim(e.tr) AS translation FROM ex e JOIN valid v USING (file_id, pos) WHERE outcome = 'imported'",
    "r2_windowed_counts": "SELECT event_type, sum(n)::BIGINT AS n, count(*) AS windows FROM (SELECT event_type, date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY ALL) WHERE h + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY event_type",
    "r3_exception_sessions": f"WITH {EVENTS} SELECT log_id, event, error_type, caused_by, array_to_string(frames, '|') AS frames FROM events2 QUALIFY event < max(event) OVER (PARTITION BY log_id)",
    "r3_closing_sessions": f"""WITH {EVENTS}, timed AS (SELECT *, epoch_ms(ts) AS ms, epoch_ms(ts) - lag(epoch_ms(ts)) OVER (PARTITION BY log_id ORDER BY line_no) > {SILENCE * 1000} AS pause FROM numbered),
        quiet AS (SELECT *, sum(CASE WHEN pause THEN 1 ELSE 0 END) OVER (PARTITION BY log_id ORDER BY line_no) AS part FROM timed),
        opened AS (SELECT log_id, event, min(part) AS part FROM quiet WHERE error_type IS NOT NULL GROUP BY ALL),
        held AS (SELECT q.log_id, q.event, regexp_extract(q.line, '{K.STACK_FRAME}', 1) AS frame, min(q.line_no) AS seen_at FROM quiet q JOIN opened o ON o.log_id = q.log_id AND o.event = q.event AND o.part = q.part WHERE error_type IS NULL AND regexp_extract(q.line, '{K.STACK_FRAME}', 1) <> '' GROUP BY ALL),
        lasts AS (SELECT log_id, max(event) AS event, max(part) AS part, max(ms) AS ms FROM quiet GROUP BY log_id)
        SELECT h.log_id, h.event, error_type, caused_by, coalesce((SELECT string_agg(frame, '|' ORDER BY seen_at) FROM held f WHERE f.log_id = h.log_id AND f.event = h.event), '') AS frames FROM heads h JOIN opened o ON o.log_id = h.log_id AND o.event = h.event JOIN lasts l ON l.log_id = h.log_id
        WHERE h.event < l.event OR o.part < l.part OR l.ms + {SILENCE * 1000} <= (SELECT max(ms) FROM quiet) - 600000""",
    "r1_streamed_lines": f"WITH {ISSUES} SELECT log_id, line_no, token, severity FROM issues",
}

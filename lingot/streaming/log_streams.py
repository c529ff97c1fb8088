"""Runtime logs and exchange files as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..functions import constants as K
from ..functions.text import digest
from ..operators.logs import classify_lines
from ..plans.scratch import kept

EVENT = "log_id long, event int, error_type string, caused_by boolean, frames string"


def classified(log: DataFrame) -> DataFrame:
    """Log lines (log_id, line_no, line, ts) of a stream by the first rule that matches; no state."""
    return classify_lines(log)


def severity_counts(events: DataFrame, window: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts of event types in tumbling (or sliding) windows of event time; rows later than ``late`` go."""
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    got = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(span.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return got.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n")


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    got = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return got.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def exception_sessions(log: DataFrame, closes_after_ms: int | None = None) -> DataFrame:
    """Exception events of streaming logs: a header opens one, frames below it attach, the next header closes it, as does silence of so many milliseconds.

    State is one open event for each log.  Lines of a log must arrive in the order of line_no across batches.
    """
    import re

    frame_of = re.compile(K.STACK_FRAME)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, kind, caused, frames = state.get if state.exists else (-1, "", False, "")
        done = []
        if state.hasTimedOut:
            if kind:
                done.append((key[0], number, kind, caused, frames))
            state.remove()
            yield pd.DataFrame(done, columns=["log_id", "event", "error_type", "caused_by", "frames"])
            return
        lines = pd.concat(list(batches)).sort_values("line_no")
        for line in lines["line"]:
            found = next((t for t in K.ERROR_TYPES if t in line), None)
            if found:
                if kind:
                    done.append((key[0], number, kind, caused, frames))
                number, kind, caused, frames = number + 1, found, line.strip().startswith("Caused by:"), ""
            elif kind and (m := frame_of.match(line)):
                have = frames.split("|") if frames else []
                if m[1] not in have:
                    frames = "|".join([*have, m[1]])
        state.update((number, kind, caused, frames))
        if closes_after_ms is not None:
            state.setTimeoutDuration(closes_after_ms)
        yield pd.DataFrame(done, columns=["log_id", "event", "error_type", "caused_by", "frames"])

    return log.groupBy("log_id").applyInPandasWithState(run, EVENT, "event int, error_type string, caused_by boolean, frames string", "append", GroupStateTimeout.NoTimeout if closes_after_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


class _OpenEvents(StatefulProcessor):
    """The open event of a log, and a timer that closes it after a silence in event time."""

    def __init__(self, silence_ms: int):
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "number int, kind string, caused boolean, frames string, last_ms long, line_no int")

    def close(self) -> None:
        pass

    def _keep(self, number: int, kind: str, caused: bool, frames: str, last_ms: int, line_no: int) -> None:
        self.open.update((number, kind, caused, frames, last_ms, line_no))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if kind:
            self.handle.registerTimer(last_ms + self.silence_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        import re

        frame_of, done = re.compile(K.STACK_FRAME), []
        number, kind, caused, frames, last_ms, seen = self.open.get() if self.open.exists() else (-1, "", False, "", 0, -1)
        lines = pd.concat(list(rows)).sort_values("line_no")
        for line_no, line, ts in zip(lines["line_no"].tolist(), lines["line"], lines["ts"], strict=True):
            at = int(ts.timestamp() * 1000)
            found = next((t for t in K.ERROR_TYPES if t in line), None)
            if kind and (found or at - last_ms > self.silence_ms):
                done.append((key[0], number, kind, caused, frames))
                kind = ""
            if found:
                number, kind, caused, frames = number + 1, found, line.strip().startswith("Caused by:"), ""
            elif kind and (m := frame_of.match(line)) and m[1] not in frames.split("|"):
                frames = f"{frames}|{m[1]}" if frames else m[1]
            last_ms, seen = at, line_no
        self._keep(number, kind, caused, frames, last_ms, seen)
        yield pd.DataFrame(done, columns=["log_id", "event", "error_type", "caused_by", "frames"])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        number, kind, caused, frames, last_ms, seen = self.open.get()
        done = [(key[0], number, kind, caused, frames)] if kind else []
        self.open.update((number, "", False, "", last_ms, seen))
        yield pd.DataFrame(done, columns=["log_id", "event", "error_type", "caused_by", "frames"])


def closing_sessions(log: DataFrame, silence: int = 3_600, late: str = "10 minutes") -> DataFrame:
    """Exception events of streaming logs (log_id, line_no, line, ts): the next header closes one, and so does a silence of so many seconds of event time.

    After a silence lines attach to nothing until the next header.  A timer on the watermark closes the event of a log that
    says no more, so nothing stays open for ever; state is one event for each log.  Lines of a log must arrive in the order of line_no across
    batches.  Needs the RocksDB state store.
    """
    stream = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return stream.groupBy("log_id").transformWithStateInPandas(_OpenEvents(silence * 1000), EVENT, "append", "eventtime")


def import_stream(files: DataFrame, validate: Callable[[DataFrame], DataFrame], store_path: str, checkpoint: str):
    """Starts a query that validates each batch of exchange rows and writes what is imported as a version of the store (``plans.versions``).

    A batch writes the rows that it changes; one that runs again after a failure finds its version and writes nothing.  Of several
    rows of a key in a batch the last by file and place stays; an empty translation deletes.  Which rows those are is told by digests of keys,
    so that texts are moved only to meet their outcomes and to be written.
    """
    from ..plans import versions

    def batch(df: DataFrame, number: int) -> None:
        good = validate(df.withColumn("_key", digest("key"))).where("outcome = 'imported'")
        good = kept(good.select("_key", F.struct("file_id", "pos").alias("_at"), "key", F.trim("translation").alias("translation")), "imported")  # read several times
        last = good.groupBy("_key").agg(F.count(F.lit(1)).alias("n"), F.max("_at").alias("_at")).where("n > 1").select("_key", "_at")
        if not last.isEmpty():
            good = kept(good.join(last.select("_key"), "_key", "left_anti").unionByName(good.join(last, ["_key", "_at"], "left_semi")), "imported-last")
        good = good.select("key", "translation")
        versions.commit(df.sparkSession, store_path, good.where("translation <> ''"), number, gone=good.where("translation = ''"))

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)

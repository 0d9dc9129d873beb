"""Structured Streaming jobs: imports, new videos, watch time and live transitions."""

from __future__ import annotations

import math
from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from scoreline.functions.similarity import same_players
from scoreline.operators import importer, playlists
from scoreline.operators.scoreboard import MIN_BREAK
from scoreline.sources.files import match_videos


def stream_import(spark: SparkSession, incoming: str, folder: str, checkpoint: str, run_ts: datetime, wholetext: bool = True) -> StreamingQuery:
    """Imports each new match file under incoming once; a video that comes again replaces what it had.

    A file is one JSON document, or, without wholetext, one on each line. The checkpoint counts the versions at folder,
    so both belong together.
    """
    files = spark.readStream.format("text").option("wholetext", wholetext).load(incoming).select(F.col("value").alias("doc"))

    def load(batch: DataFrame, number: int) -> None:
        importer.save_import(folder, number, match_videos(batch).filter("file_err IS NULL").drop("file_err"), run_ts)

    return files.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_new_videos(rows: DataFrame, videos: DataFrame, event_time: str = "seen_at", delay: str = "1 day", name: str = "") -> DataFrame:
    """New playlist rows once per id, without ceremonies, shows and processed ones."""
    fresh = playlists.filter_new_streams(rows.withWatermark(event_time, delay), name).dropDuplicatesWithinWatermark(["video_id"])
    return fresh.join(videos.select("video_id").distinct(), "video_id", "left_anti")


def watch_time(positions: DataFrame) -> DataFrame:
    """(video_id, watched_seconds): the last position of each session, whole seconds, added up."""
    last = positions.groupBy("video_id", "session").agg(F.max_by(F.floor("position"), F.struct("ts", "position")).alias("seconds"))
    return last.groupBy("video_id").agg(F.sum("seconds").cast("long").alias("watched_seconds"))


class WatchTime(StatefulProcessor):
    """Keeps the last position of each session that goes on, and the video's total, which closed sessions are part of.

    A session closes once the watermark is SILENT past its last row: its state goes, its seconds stay in the total. A video
    reads and writes its sessions at once, and waits for one timer, that of the session which can close first.
    """

    def __init__(self, silent_ms: int):
        self.silent = silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sessions = handle.getListState("sessions", "session long, ts long, seconds long")
        self.total = handle.getValueState("total", "seconds long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        total = (self.total.get() or (0,))[0]
        known = {session: (ts, seconds) for session, ts, seconds in self.sessions.get()}
        for row in rows:
            before, now = known.get(row.session), (row.at, math.floor(row.position))
            if before is None or now >= before:
                total += now[1] - (before[1] if before is not None else 0)
                known[row.session] = now
        self.keep(known)
        self.total.update((total,))
        yield Row(video_id=key[0], watched_seconds=total)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        self.keep({session: (ts, seconds) for session, ts, seconds in self.sessions.get() if ts // 1000 + self.silent > passed})
        return iter(())

    def keep(self, known: dict[int, tuple[int, int]]) -> None:
        if not known:
            self.sessions.clear()
            return
        self.sessions.put([(session, *last) for session, last in known.items()])
        self.handle.registerTimer(min(ts for ts, _ in known.values()) // 1000 + self.silent)

    def close(self) -> None:
        pass


def stream_watch_time(positions: DataFrame, delay: str = "1 hour", silent_hours: float = 24.0) -> DataFrame:
    """A stream of new totals; positions: (video_id, session, ts, position). Needs the RocksDB state store.

    Rows later than delay are dropped. A session ends after silent_hours without a row; its id then begins another one.
    """
    rows = positions.withWatermark("ts", delay).withColumn("at", F.unix_micros("ts"))
    return rows.groupBy("video_id").transformWithState(WatchTime(int(silent_hours * 3_600_000)), "video_id string, watched_seconds long", outputMode="Update", timeMode="EventTime")


#: What a buffered sample holds, in the order of its columns.
SAMPLE = "at long, t double, success boolean, actual_ts double, player1 string, player2 string, set1 int, set2 int"


class LiveTransitions(StatefulProcessor):
    """Buffers samples until the watermark has passed them, then goes through them in order.

    Of what has passed only the last sample stays, with where its run without a score began; a video that is silent for
    `silent` milliseconds of event time loses that too. A video waits for one timer, that of its first sample that the
    watermark hasn't passed; all that it has passed go then at once.
    """

    def __init__(self, silent_ms: int):
        self.silent = silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, t double, success boolean, actual_ts double, player1 string, player2 string, sets int, run_start double")
        self.waiting = handle.getListState("waiting", SAMPLE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        fields = [c.split()[0] for c in SAMPLE.split(", ")]
        new = [tuple(row[c] for c in fields) for row in rows]
        self.waiting.appendList(new)
        self.handle.registerTimer(min(s[0] for s in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        upto = timerValues.getCurrentWatermarkInMs()
        held = list(self.waiting.get())
        due = sorted((s for s in held if s[0] <= upto), key=lambda s: s[:2])
        prev = self.last.get() if self.last.exists() else None
        if not due:
            if prev is not None and not held and prev[0] + self.silent <= upto:
                self.last.clear()
            return
        later = [s for s in held if s[0] > upto]
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(min(s[0] for s in later))
        else:
            self.waiting.clear()
        for at, t, success, actual_ts, player1, player2, set1, set2 in due:
            if prev is not None and t <= prev[1]:
                continue  # an earlier second that was seen later than one that has passed
            if success:
                sets = int(set1 + set2)
                if prev is not None and not prev[2]:
                    if actual_ts - prev[7] >= MIN_BREAK:
                        yield Row(video_id=key[0], lo=prev[7], hi=actual_ts, kind="score_appears", player1=player1, player2=player2)
                elif prev is not None and not same_players((prev[4], prev[5]), (player1, player2)):
                    yield Row(video_id=key[0], lo=prev[3], hi=actual_ts, kind="player_change", player1=player1, player2=player2)
                elif prev is not None and sets < prev[6]:
                    yield Row(video_id=key[0], lo=prev[3], hi=actual_ts, kind="set_reset", player1=player1, player2=player2)
                prev = (at, t, True, actual_ts, player1, player2, sets, None)
            else:
                prev = (at, t, False, actual_ts, None, None, None, prev[7] if prev is not None and not prev[2] else actual_ts)
        self.last.update(tuple(prev))
        self.handle.registerTimer(prev[0] + self.silent)

    def close(self) -> None:
        pass


def stream_transitions(samples: DataFrame, delay: str = "10 minutes", silent_hours: float = 24.0) -> DataFrame:
    """transitions of a stream of samples with seen_at, when each was seen. Needs the RocksDB state store.

    Samples that arrive out of order within delay give what all of them give in order; later ones are dropped, and
    the query's progress counts them (numRowsDroppedByWatermark). A transition comes out once the watermark has passed it.
    """
    whole, read = ["set1", "set2"], F.unix_millis("seen_at").alias("at")
    typed = [F.col(c).cast("double").alias(c) for c in ("t", "actual_ts")] + [F.col(c).cast("int").alias(c) for c in whole]
    rows = samples.withWatermark("seen_at", delay).select("video_id", "seen_at", read, "success", "player1", "player2", *typed)
    return rows.groupBy("video_id").transformWithState(LiveTransitions(int(silent_hours * 3_600_000)), "video_id string, lo double, hi double, kind string, player1 string, player2 string", outputMode="Append", timeMode="EventTime")

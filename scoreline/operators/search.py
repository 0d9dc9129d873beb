"""Match starts: intervals between samples meet the seconds that they reach in buckets and are bisected together there."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoreline.functions.similarity import same_players
from scoreline.functions.text import EARLY_POINTS, format_hms, score_flags
from scoreline.operators import scoreboard as sb
from scoreline.sources.scratch import limit_batches, written


def in_reach(intervals: DataFrame, board: DataFrame) -> DataFrame:
    """(video_id, lo, hi, early_points, player1, player2, seen): each interval with the seconds that its probes can reach.

    Intervals and seconds meet in buckets of INTERVAL seconds, so the join is on video and bucket alone and a long
    video is spread over tasks.
    """
    flags = score_flags(intervals.select("video_id", "lo", "hi", *sb.FIELDS).withColumn("success", F.lit(True)))
    key = ["video_id", "lo", "hi", "early_points", "player1", "player2"]
    asked = flags.select("video_id", F.col("lo").cast("double"), F.col("hi").cast("double"), F.when(F.col("is_early"), F.col("total_points")).cast("double").alias("early_points"), "player1", "player2").distinct()
    bucket = lambda second: F.floor(second / sb.INTERVAL)
    reached = F.sequence(bucket(F.col("lo") + min(sb.PROBE_OFFSETS) - 1), bucket(F.col("hi") + max(sb.PROBE_OFFSETS)))
    seen = board.filter("success").select("video_id", F.col("sec").cast("long").alias("sec"), bucket(F.col("sec")).alias("bucket"), *[F.col(c).alias(f"_{c}") for c in sb.FIELDS])
    second = F.when(F.col("sec").isNotNull(), F.struct("sec", *[F.col(f"_{c}").alias(c) for c in sb.FIELDS]))
    return asked.withColumn("bucket", F.explode(reached)).join(seen, ["video_id", "bucket"], "left").groupBy(*key).agg(F.collect_list(second).alias("seen"))


def bisect_starts(intervals: DataFrame, board: DataFrame) -> DataFrame:
    """(video_id, lo, hi, start, player1, player2, approximate) of transitions in which a start is found.

    All intervals of a batch, whose bytes are bounded, are bisected together until none is wider than PRECISION. A 0:0 in a first game is kept, and
    the search goes on before it; an early score is a fallback from which points count back in time.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield bisected(batch)

    limit_batches(board.sparkSession)
    return in_reach(intervals, board).mapInArrow(search, "video_id string, lo double, hi double, start double, player1 string, player2 string, approximate boolean")


def bisected(batch: pa.RecordBatch) -> pa.RecordBatch:
    """What bisect_starts returns, for intervals (video_id, lo, hi, early_points, player1, player2, seen)."""
    plain = lambda column: column.to_numpy(zero_copy_only=False)
    lists = batch.column("seen")
    fields = lists.flatten()
    owner = np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    set1, set2, game1, game2 = (plain(fields.field(c).cast(pa.float64())) for c in ("set1", "set2", "game1", "game2"))
    # Seconds in order, each in one number with its interval's.
    at = plain(fields.field("sec")).astype(np.int64)
    code = (owner << 40) + at
    order = np.argsort(code, kind="stable")
    code = code[order]

    def second(interval: np.ndarray, sec: np.ndarray) -> np.ndarray:
        """Where this second of an interval is among all, or -1."""
        wanted = (interval << 40) + sec
        place = np.minimum(np.searchsorted(code, wanted), len(code) - 1)
        return np.where((sec >= 0) & (code[place] == wanted), order[place], -1) if len(code) else np.full(len(sec), -1)

    low, high = plain(batch.column("lo")).copy(), plain(batch.column("hi")).copy()
    early_points = plain(batch.column("early_points")).astype(float)
    # The time of the best 0:0 and of the earliest early score so far, and the second that they were read from.
    best, best_at = np.full(len(low), np.nan), np.full(len(low), -1)
    early, early_at = np.where(np.isnan(early_points), np.inf, high), np.full(len(low), -1)
    while len(live := np.flatnonzero(high - low > sb.PRECISION)):
        t = (low[live] + high[live]) / 2
        found, hit = t.copy(), np.full(len(live), -1)
        for off in reversed(sb.PROBE_OFFSETS):
            here = second(live, np.trunc(t + off).astype(np.int64))
            hit, found = np.where(here >= 0, here, hit), np.where(here >= 0, t + off, found)
        with_score = hit >= 0
        s1, s2, p1, p2 = (np.where(with_score, x[hit], np.nan) if len(x) else np.full(len(hit), np.nan) for x in (set1, set2, game1, game2))
        first_game, points = (s1 == 0) & (s2 == 0), p1 + p2
        zero = first_game & (p1 == 0) & (p2 == 0)
        soon = first_game & ~zero & (points <= EARLY_POINTS)
        sooner = soon & (found < early[live])
        best[live[zero]], best_at[live[zero]] = found[zero], hit[zero]
        k = live[sooner]
        early[k], early_at[k], early_points[k] = found[sooner], hit[sooner], points[sooner]
        before = zero | soon | (points > 0) | (s1 > 0) | (s2 > 0)
        low[live], high[live] = np.where(before, low[live], t), np.where(before, t, high[live])
    exact = best_at >= 0
    start = np.where(exact, best, np.maximum(0.0, early - early_points * sb.SECONDS_PER_POINT))
    kept = np.flatnonzero(exact | ~np.isinf(early))
    source = np.where(exact, best_at, early_at)[kept]
    # Names are those of the second, or, where the interval's end itself is the early score, its own.
    own, place = pa.array(source < 0), pa.array(source, mask=source < 0)
    names = [pc.if_else(own, batch.column(c).take(pa.array(kept)), fields.field(c).take(place)) for c in ("player1", "player2")]
    taken = [batch.column(c).take(pa.array(kept)) for c in ("video_id", "lo", "hi")]
    return pa.RecordBatch.from_arrays([*taken, pa.array(start[kept]), *names, pa.array(~exact[kept])], names=["video_id", "lo", "hi", "start", "player1", "player2", "approximate"])


def dedup_starts(candidates: DataFrame) -> DataFrame:
    """(video_id, start, player1, player2) of the candidates (with phase, ord) that are kept, going by phase and ord.

    One goes if a kept one has the same players or is less than MIN_BREAK away. A video has tens of candidates.
    """

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for video, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                kept: list[tuple[float, tuple[str, str]]] = []
                for row in rows:
                    pair = (row["player1"], row["player2"])
                    if not any(abs(t - row["start"]) < sb.MIN_BREAK or same_players(pair, p) for t, p in kept):
                        kept.append((row["start"], pair))
                out += [(video, t, *p) for t, p in kept]
            kinds = [pa.string(), pa.float64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["video_id", "start", "player1", "player2"])

    limit_batches(candidates.sparkSession)
    each = F.struct("phase", "ord", F.col("start").cast("double").alias("start"), "player1", "player2")
    # Videos pass many at once, each as one row with its candidates in order.
    rows = candidates.groupBy("video_id").agg(F.sort_array(F.collect_list(each)).alias("rows"))
    return rows.mapInArrow(keep, "video_id string, start double, player1 string, player2 string")


def match_starts(board: DataFrame) -> DataFrame:
    """(video_id, start, start_hms, player1, player2, error): all starts of each video, or one row with the error."""
    samples = written(sb.coarse_scan(board))
    first = score_flags(samples).filter("is_match_start").select("video_id", F.lit(1).alias("phase"), F.col("t").alias("ord"), F.col("actual_ts").alias("start"), "player1", "player2")
    found = bisect_starts(sb.transitions(samples), board).select("video_id", F.lit(2).alias("phase"), F.col("hi").alias("ord"), "start", "player1", "player2")
    kept = dedup_starts(first.union(found))
    videos = board.select("video_id").distinct().join(kept, "video_id", "left")
    return videos.select("video_id", "start", format_hms(F.col("start")).alias("start_hms"), "player1", "player2", F.when(F.col("start").isNull(), "No match starts found").alias("error"))


def sort_matches(starts: DataFrame) -> DataFrame:
    """Adds n, counting a video's starts by time from 1."""
    return starts.withColumn("n", F.row_number().over(Window.partitionBy("video_id").orderBy("start", "player1", "player2")))


def distinct_pairs(samples: DataFrame) -> DataFrame:
    """(video_id, player1, player2, first_seen): pairs of players as first seen, fuzzy repeats left out."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        seen: list[tuple[str, str, float]] = []
        for row in rows.sort_values("actual_ts").itertuples():
            if not any(same_players((row.player1, row.player2), s[:2]) for s in seen):
                seen.append((row.player1, row.player2, row.actual_ts))
        return pd.DataFrame([(rows["video_id"].iloc[0], *s) for s in seen], columns=["video_id", "player1", "player2", "first_seen"])

    # Exact repeats go first, in the JVM, so a group holds each spelling once.
    once = samples.filter("success").groupBy("video_id", "player1", "player2").agg(F.min("actual_ts").alias("actual_ts"))
    return once.groupBy("video_id").applyInPandas(fold, "video_id string, player1 string, player2 string, first_seen double")


def skipped_pairs(samples: DataFrame, starts: DataFrame) -> DataFrame:
    """Distinct pairs of the coarse scan for which no start of their video was found."""
    pairs = distinct_pairs(samples)
    found = starts.filter("start IS NOT NULL").groupBy("video_id").agg(F.collect_list(F.struct("player1", "player2")).alias("found"))

    @F.pandas_udf("boolean")
    def missing(player1: pd.Series, player2: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([not any(same_players((a, b), (f["player1"], f["player2"])) for f in (fs if fs is not None else ())) for a, b, fs in zip(player1, player2, lists)], dtype="bool")

    return pairs.join(found, "video_id", "left").filter(missing("player1", "player2", "found")).select("video_id", "player1", "player2", "first_seen")


def write_match_json(starts: DataFrame, videos: DataFrame) -> DataFrame:
    """(video_id, doc): one JSON document for each video, its matches by time; error only where there are none."""
    match = F.struct(F.col("start").cast("int").alias("timestamp"), "player1", "player2")
    grouped = starts.groupBy("video_id").agg(F.sort_array(F.collect_list(F.when(F.col("start").isNotNull(), match))).alias("matches"), F.max("error").alias("error"))
    doc = F.struct("video_id", "video_title", "upload_date", "matches", F.when(F.size("matches") == 0, F.coalesce("error", F.lit("No match starts found"))).alias("error"))
    return videos.join(grouped, "video_id").select("video_id", F.to_json(doc).alias("doc"))

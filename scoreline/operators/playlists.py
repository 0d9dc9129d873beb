"""Playlists and processing queues. Rows are ordered by pos, newest first, within a channel."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How far back a cutoff is looked for, and what a recent upload is.
HORIZON, RECENT_HOURS = 2000, 48


def after_cutoff(playlist: DataFrame, cutoffs: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Rows before the cutoff id of their channel; none where it isn't among the first rows. cutoffs: (channel, cutoff)."""
    near = playlist.filter(F.col("pos") <= horizon)
    found = near.join(cutoffs, "channel").filter(F.col("video_id") == F.col("cutoff")).groupBy("channel").agg(F.min("pos").alias("_cut"))
    return near.join(found, "channel").filter(F.col("pos") < F.col("_cut")).drop("_cut")


def completed_streams_only(playlist: DataFrame) -> DataFrame:
    return playlist.filter(F.col("live_status") == "was_live")


def filter_new_streams(playlist: DataFrame, name: str = "") -> DataFrame:
    """Without ceremonies and shows, unless they name finals; then titles that contain name, as written."""
    title = F.lower("title")
    keep = ~(title.contains("ceremony") | title.contains("show")) | title.contains("finals")
    return playlist.filter(keep & F.col("title").contains(name) if name else keep)


def filter_process_queue(queue: DataFrame, name: str) -> DataFrame:
    return queue.filter(F.col("title").contains(name))


def head_n(playlist: DataFrame, n: int) -> DataFrame:
    return playlist.filter(F.col("pos") <= n)


def lookup_processed(ids: DataFrame, videos: DataFrame) -> DataFrame:
    return ids.select("video_id").distinct().join(videos, "video_id", "left_semi")


def filter_unprocessed(playlist: DataFrame, videos: DataFrame) -> DataFrame:
    return playlist.join(videos, "video_id", "left_anti")


def flag_processed(playlist: DataFrame, videos: DataFrame, exclude_processed: bool = False) -> DataFrame:
    known = videos.select("video_id").distinct().withColumn("_known", F.lit(True))
    flagged = playlist.join(known, "video_id", "left").withColumn("processed", F.when(F.col("_known"), "yes").otherwise("no")).drop("_known")
    return flagged.filter("processed = 'no'") if exclude_processed else flagged


def processed_counts(flagged: DataFrame, exclude_processed: bool = False) -> DataFrame:
    """(channel, total, processed, new, displayed)."""
    new = F.count_if(F.col("processed") == "no")
    return flagged.groupBy("channel").agg(F.count("*").alias("total"), F.count_if(F.col("processed") == "yes").alias("processed"), new.alias("new"), (new if exclude_processed else F.count("*")).alias("displayed"))


def queue_prepend(new: DataFrame, queue: DataFrame) -> DataFrame:
    """new before queue, numbered anew from 1 within each channel."""
    both = new.withColumn("_src", F.lit(0)).unionByName(queue.withColumn("_src", F.lit(1)))
    order = Window.partitionBy("channel").orderBy("_src", "pos")
    return both.withColumn("pos", F.row_number().over(order)).drop("_src")


def queue_top(queue: DataFrame) -> DataFrame:
    return queue.groupBy("channel").agg(F.min_by("video_id", "pos").alias("video_id"))


def queue_pop_last(queue: DataFrame) -> DataFrame:
    """Adds popped: whether the row is its channel's oldest."""
    return queue.withColumn("popped", F.col("pos") == F.max("pos").over(Window.partitionBy("channel")))


def queue_cutoff(channels: DataFrame, queue: DataFrame, given: DataFrame, latest: DataFrame) -> DataFrame:
    """(channel, cutoff, err): the top of the queue, else the given id, else the latest known; err where none is."""
    out = channels.join(queue_top(queue).withColumnRenamed("video_id", "_top"), "channel", "left").join(given.select("channel", F.col("video_id").alias("_given")), "channel", "left").join(latest.select("channel", F.col("video_id").alias("_latest")), "channel", "left")
    cutoff = F.coalesce("_top", "_given", "_latest")
    return out.select("channel", cutoff.alias("cutoff"), F.when(cutoff.isNull(), "no cutoff").alias("err"))


def queue_advance(queue: DataFrame, outcome: Column, name: str = "") -> DataFrame:
    """Adds status and stays, going from the oldest row to the newest.

    outcome: 'ok', 'failed' or 'import_failed'. Rows whose title lacks name are skipped; the first failed import
    stops the run, so it and all that are newer stay.
    """
    skipped = ~F.col("title").contains(name)
    upto = Window.partitionBy("channel").orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    staged = queue.withColumn("_o", F.when(skipped, "skipped").otherwise(outcome)).withColumn("_stop", F.max((F.col("_o") == "import_failed").cast("int")).over(upto) == 1)
    status = F.when(F.col("_stop"), "remaining").when(F.col("_o") == "ok", "processed").otherwise(F.col("_o"))
    return staged.withColumns({"status": status, "stays": status != "processed"}).drop("_o", "_stop")


def queue_summary(advanced: DataFrame) -> DataFrame:
    return advanced.groupBy("channel", "status").agg(F.count("*").alias("n"))


def recent_only(videos: DataFrame, run_ts: datetime, date: str = "upload_date", hours: int = RECENT_HOURS) -> DataFrame:
    """Uploads, dated yyyyMMdd, of the last 48 hours; strict: a bad date is an error."""
    day = F.to_timestamp_ntz(date, F.lit("yyyyMMdd"))
    return videos.filter(day > F.lit(run_ts).cast("timestamp_ntz") - F.expr(f"INTERVAL {hours} HOURS"))


def unwatched(videos: DataFrame, history: DataFrame) -> DataFrame:
    return videos.join(history.select("url").distinct(), "url", "left_anti")


def filter_vods(
    videos: DataFrame,
    tournament: str = "",
    title: str = "",
    gender: str = "MS",
    full_only: bool = False,
    nofilters: bool = False,
    recent: datetime | None = None,
    history: DataFrame | None = None,
) -> DataFrame:
    """Recordings that pass all that is asked, the last listed first; videos come from parse_vod_titles.

    recent: the moment from which only uploads of the last hours count; history: watched recordings, to be left out.
    """
    keep = F.col("err").isNull()
    if not nofilters:
        videos = recent_only(videos, recent) if recent else videos
        videos = unwatched(videos, history) if history is not None else videos
        keep &= F.lower("tournament").contains(tournament.lower()) & F.lower("title").contains(title.lower())
        if gender:
            keep &= F.lower("gender") == gender.lower()
        if full_only:
            keep &= F.col("full_match")
    return videos.filter(keep).orderBy(F.col("pos").desc())


def video_metadata(playlist: DataFrame) -> DataFrame:
    """Metadata records with no matches; the epoch is the release's, else the upload's."""
    none = F.array().cast("array<struct<timestamp:int,player1:string,player2:string>>")
    return playlist.select("video_id", F.col("title").alias("video_title"), F.coalesce("release_timestamp", "timestamp").cast("long").cast("string").alias("upload_date"), none.alias("matches"))

"""Queries that run Structured Streaming jobs over the tables until all that is there has been read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scoreline.functions.text import parse_upload_epoch
from scoreline.operators import importer as im
from scoreline.operators import playlists as pl
from scoreline.plans.adapters import frame
from scoreline.plans.boards import FOUND
from scoreline.plans.catalog import ADVANCED, NEW, ORDER
from scoreline.plans.imports import STAGED, _docs
from scoreline.plans.registry import query
from scoreline.plans.titles import RUN_TS
from scoreline.sources import files as fl
from scoreline.sources.scratch import shared_path
from scoreline.streaming import jobs

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _as_stream(df: DataFrame) -> DataFrame:
    path = shared_path(df.sparkSession, "incoming")
    df.write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).parquet(path)


def _ended(stream: DataFrame) -> DataFrame:
    """What the stream appends, from its sink."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    out = shared_path(spark, "sink")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", shared_path(spark, "progress")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("SELECT user_id AS video_id, CAST(sum(s) AS BIGINT) AS watched_seconds FROM (SELECT 'u' || user_id AS user_id, CAST(floor(arg_max(value, (ts, value))) AS BIGINT) AS s FROM events GROUP BY 1, event_id // 100) e GROUP BY 1")
def stream_watch_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions as a stream; of each video the total that the last batch with it gives."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = events.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("video_id"), F.floor(F.col("event_id") / 100).alias("session"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("position"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    out = shared_path(spark, "sink")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    jobs.stream_watch_time(_as_stream(rows)).writeStream.foreachBatch(keep).option("checkpointLocation", shared_path(spark, "progress")).outputMode("update").trigger(availableNow=True).start().awaitTermination()
    totals = spark.read.schema("video_id string, watched_seconds long, batch int").parquet(out)
    return totals.groupBy("video_id").agg(F.max_by("watched_seconds", "batch").alias("watched_seconds"))


@query(f"SELECT DISTINCT video_id, title FROM {{playlist}} p WHERE {NEW} AND NOT EXISTS (SELECT 1 FROM {{processed}} v WHERE v.video_id = p.video_id)")
def stream_new_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    playlist = frame(spark, sf_dir, "playlist").withColumn("seen_at", F.timestamp_seconds(F.lit(1700000000)))
    twice = playlist.select("video_id", "title", "seen_at")
    return _ended(jobs.stream_new_videos(_as_stream(twice.union(twice)), frame(spark, sf_dir, "processed"))).select("video_id", "title")


@query(f"WITH {FOUND} SELECT video_id, CASE WHEN kind = 'score_appears' THEN pst ELSE pt END AS lo, actual_ts AS hi, kind, player1, player2 FROM f WHERE kind IS NOT NULL")
def stream_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples as a stream; a last row of another video, much later, lets the watermark pass all of them."""
    samples = frame(spark, sf_dir, "samples").withColumn("seen_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("t")))
    last = samples.limit(1).withColumns({"video_id": F.lit(""), "seen_at": F.timestamp_seconds(F.lit(4_000_000_000))})
    return _ended(jobs.stream_transitions(_as_stream(samples.union(last))))


@query(f"{STAGED} SELECT video_id || '#' || match_pos AS match_id, CAST(offset_s AS INT) AS video_offset_seconds FROM good JOIN listed USING (video_id) WHERE error IS NULL")
def stream_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    incoming, folder = shared_path(spark, "files"), shared_path(spark, "catalogue")
    # One JSON document on each line here; a file of many documents is read line by line.
    _docs(spark, sf_dir).select("doc").write.text(incoming)
    jobs.stream_import(spark, incoming, folder, shared_path(spark, "progress"), RUN_TS, wholetext=False).awaitTermination()
    return im.load_snapshot(spark, folder)["matches"].select("match_id", "video_offset_seconds")


@query("SELECT channel, pos, video_id, title FROM {playlist}")
def load_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "queue")
    fl.save_queue(frame(spark, sf_dir, "playlist").withColumn("upload_date", F.col("release_timestamp").cast("string")), path)
    return fl.load_queue(spark, path).select(ORDER)


@query(f"WITH {ADVANCED} SELECT channel, CAST(row_number() OVER (PARTITION BY channel ORDER BY pos) AS INT) AS pos, video_id, title FROM adv WHERE status <> 'processed'")
def save_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A queue's cycle at one path: saved, loaded, prepended to and saved, loaded, advanced and saved, with its places counted anew."""
    path, rows = shared_path(spark, "queue"), frame(spark, sf_dir, "playlist").withColumn("upload_date", F.lit("1")).select(*ORDER, "upload_date")
    fl.save_queue(rows.filter("pos > 3"), path)
    fl.save_queue(pl.queue_prepend(rows.filter("pos <= 3"), fl.load_queue(spark, path)), path)
    order = F.expr("CAST(substring(video_id, 2) AS BIGINT)")
    outcome = F.when(order % 11 == 0, "import_failed").when(order % 4 == 0, "failed").otherwise("ok")
    left = pl.queue_advance(fl.load_queue(spark, path), outcome, "a").filter("stays")
    fl.save_queue(left.withColumn("pos", F.row_number().over(Window.partitionBy("channel").orderBy("pos"))), path)
    return fl.load_queue(spark, path).select(ORDER)


@query("SELECT video_id, CASE WHEN regexp_full_match(upload_date, '[+-]?\\d+') THEN make_timestamp(CAST(upload_date AS BIGINT) * 1000000) END AS uploaded FROM {videos} ORDER BY uploaded DESC NULLS LAST, video_id")
def read_pg_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All videos in order of their upload, from a database that this session's JVM holds, read in parts.

    Executors of a cluster can't reach such a database; there the table is one of the session's catalog.
    """
    videos = frame(spark, sf_dir, "videos").select("pos", "video_id", "upload_date")
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
        # A key of its own type: strings are large objects there, which can't be compared.
        videos.write.format("jdbc").options(url=url, dbtable="videos", createTableColumnTypes="video_id VARCHAR(64), upload_date VARCHAR(64)", numPartitions="4").save()
        rows = fl.read_table(spark, "videos", url, split="pos", fetchsize="10000")
    else:
        videos.createOrReplaceTempView("scoreline_videos")
        rows = fl.read_table(spark, "scoreline_videos")
    return rows.select("video_id", parse_upload_epoch(F.col("upload_date")).cast("timestamp_ntz").alias("uploaded")).orderBy(F.col("uploaded").desc_nulls_last(), "video_id")

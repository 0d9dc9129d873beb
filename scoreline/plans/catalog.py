"""Queries over the tournament catalogue, playlists and queues."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreline.functions.text import match_timestamp
from scoreline.operators import catalog as ct
from scoreline.operators import playlists as pl
from scoreline.plans.adapters import frame
from scoreline.plans.registry import query
from scoreline.plans.titles import RUN_TS

TEAMS = """people AS (SELECT DISTINCT match_id, player, side FROM {participants}),
teams AS (SELECT match_id, string_agg(player, ' / ' ORDER BY player) FILTER (side = 'A') AS team_a, string_agg(player, ' / ' ORDER BY player) FILTER (side = 'B') AS team_b FROM people GROUP BY match_id)"""


def _schedule_parts(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [frame(spark, sf_dir, n) for n in ("matches", "tournaments", "uploads", "participants")]


@query(
    f"""WITH {TEAMS} SELECT m.match_id, tournament, year, video_offset_seconds, upload_date, strftime(upload_date + to_seconds(video_offset_seconds), '%b %d, %Y %H:%M') AS match_time, team_a, team_b, is_doubles, youtube_id, video_title
FROM {{matches}} m JOIN teams USING (match_id) JOIN {{tournaments}} USING (tournament_id) JOIN {{uploads}} USING (video_id) ORDER BY upload_date + to_seconds(video_offset_seconds), m.match_id"""
)
def tournament_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ct.tournament_schedule(*_schedule_parts(spark, sf_dir))


@query(f"WITH {TEAMS} SELECT * FROM teams")
def team_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ct.team_agg(frame(spark, sf_dir, "participants"))


@query("SELECT DISTINCT match_id, player, side FROM {participants}")
def participants_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ct.participants_dedupe(frame(spark, sf_dir, "participants"))


@query("SELECT match_id, tournament, year, player, side FROM {matches} JOIN {tournaments} USING (tournament_id) JOIN (SELECT DISTINCT * FROM {participants}) p USING (match_id)")
def schedule_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches, tournaments, _, people = _schedule_parts(spark, sf_dir)
    return ct.schedule_join(matches, tournaments, ct.participants_dedupe(people)).select("match_id", "tournament", "year", "player", "side")


@query("SELECT * FROM (SELECT DISTINCT match_id, player, side FROM {participants}) p WHERE NOT EXISTS (SELECT 1 FROM {matches} m JOIN {processed} v USING (video_id) WHERE m.match_id = p.match_id)")
def delete_by_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ct.delete_by_parent(ct.participants_dedupe(frame(spark, sf_dir, "participants")), frame(spark, sf_dir, "matches"), frame(spark, sf_dir, "processed"))


SHOWN = """shown AS (SELECT match_id, coalesce(tournament, 'Unknown Tournament') AS tournament, coalesce(year, 2026) AS year, coalesce(nullif(day, ''), 'Unknown Day') AS day, session,
  coalesce(effective_timestamp, upload_date) AS effective_timestamp, CASE WHEN is_doubles THEN 'Doubles' ELSE 'Singles' END AS tag,
  CASE WHEN youtube_id IS NULL THEN 'https://placehold.co/320x180' ELSE 'https://img.youtube.com/vi/' || youtube_id || '/mqdefault.jpg' END AS thumbnail, strftime(upload_date, '%Y-%m-%d') AS date,
  CASE WHEN team_a IS NOT NULL AND team_b IS NOT NULL THEN team_a || ' vs ' || team_b ELSE coalesce(video_title, 'Unknown Match') END AS title,
  CASE WHEN contains(tournament, 'Champions') THEN 'champions' WHEN contains(tournament, 'Smash') THEN 'smash' WHEN contains(tournament, 'Youth Contender') THEN 'youthContender' ELSE 'contender' END AS type FROM {schedule}),
grouped AS (SELECT *, CASE WHEN session IS NULL THEN day ELSE day || ' - Round ' || session END AS group_key FROM shown),
groups AS (SELECT tournament, year, group_key, arg_min(session, match_id) AS session, max(effective_timestamp) AS latest, count(*) AS n_matches, string_agg(CAST(match_id AS VARCHAR), ',' ORDER BY match_id) AS match_ids, min(match_id) AS first_match FROM grouped GROUP BY ALL)""".replace(
    "GROUP BY ALL", "GROUP BY tournament, year, group_key"
)


def _shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ct.schedule_defaults(frame(spark, sf_dir, "schedule"), RUN_TS)


@query(f"WITH {SHOWN} SELECT * FROM shown")
def schedule_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(spark, sf_dir)


@query(f"WITH {SHOWN} SELECT match_id, title FROM shown WHERE year IN (2025, 2026) AND type IN ('smash', 'contender') AND tag = 'Singles' AND (contains(lower(title), 'customer') OR contains(lower(tournament), 'customer'))")
def filter_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ct.filter_matches(_shown(spark, sf_dir), types=("smash", "contender"), search="Customer").select("match_id", "title")


@query(f"WITH {SHOWN} SELECT DISTINCT tournament, year, type FROM shown")
def distinct_tournaments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ct.distinct_tournaments(_shown(spark, sf_dir))


@query(f"WITH {SHOWN} SELECT DISTINCT tournament, year, type FROM shown WHERE year IN (2025, 2026) AND type = 'contender'")
def available_tournaments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ct.available_tournaments(_shown(spark, sf_dir), ct.DEFAULT_YEARS, ("contender",))


@query(f"WITH {SHOWN}, known AS (SELECT DISTINCT tournament, year, type FROM shown WHERE type <> 'smash') SELECT match_id, s.tournament, coalesce(k.year, 0) AS tournament_year, coalesce(k.type, 'contender') AS tournament_type FROM shown s LEFT JOIN known k ON s.tournament = k.tournament AND s.year = k.year")
def tournament_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = _shown(spark, sf_dir)
    return ct.tournament_lookup(shown, ct.distinct_tournaments(shown).filter("type <> 'smash'"))


@query(f"WITH {SHOWN} SELECT tournament, year, group_key, session, latest, n_matches, match_ids FROM groups")
def matches_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ct.matches_by_group(_shown(spark, sf_dir))


@query(f"WITH {SHOWN} SELECT tournament, year, group_key, first_match, session FROM groups")
def first_in_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ct.first_in_group(_shown(spark, sf_dir))


@query(f"WITH {SHOWN} SELECT tournament, year, group_key, latest, CAST(row_number() OVER (PARTITION BY tournament, year ORDER BY latest DESC NULLS LAST, coalesce(session, 0) DESC, group_key) AS INT) AS rank FROM groups")
def sort_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ct.sort_groups(ct.matches_by_group(_shown(spark, sf_dir))).select("tournament", "year", "group_key", "latest", "rank")


@query("SELECT match_id, 'm_' || (row_number() OVER (PARTITION BY tournament ORDER BY upload_date DESC, match_id) - 1) AS id FROM {schedule}")
def number_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ct.number_matches(frame(spark, sf_dir, "schedule")).select("match_id", "id")


@query("SELECT match_id, upload_date FROM {schedule} ORDER BY upload_date DESC, match_id")
def schedule_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ct.schedule_order(frame(spark, sf_dir, "schedule")).select("match_id", "upload_date")


@query("SELECT video_id, upload_date FROM {uploads} ORDER BY upload_date DESC, video_id DESC LIMIT 1")
def latest_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ct.latest_video(frame(spark, sf_dir, "uploads"))


@query("SELECT video_id, upload_date FROM {uploads} WHERE CAST(upload_date AS DATE) = (SELECT max(CAST(upload_date AS DATE)) FROM {uploads})")
def latest_upload_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ct.latest_upload_ids(frame(spark, sf_dir, "uploads"))


ORDER = ["channel", "pos", "video_id", "title"]
NEW = "((NOT contains(lower(title), 'ceremony') AND NOT contains(lower(title), 'show')) OR contains(lower(title), 'finals'))"


@query("SELECT channel, pos, video_id FROM {playlist} WHERE live_status = 'was_live'")
def completed_streams_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.completed_streams_only(frame(spark, sf_dir, "playlist")).select("channel", "pos", "video_id")


@query(f"SELECT channel, pos, video_id, title FROM {{playlist}} WHERE {NEW} AND contains(title, 'Finals')")
def filter_new_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.filter_new_streams(frame(spark, sf_dir, "playlist"), "Finals").select(ORDER)


@query("SELECT channel, pos, video_id, title FROM {playlist} WHERE contains(title, 'Champions')")
def filter_process_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.filter_process_queue(frame(spark, sf_dir, "playlist"), "Champions").select(ORDER)


@query("SELECT channel, pos, video_id FROM {playlist} WHERE pos <= 5")
def head_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.head_n(frame(spark, sf_dir, "playlist"), 5).select("channel", "pos", "video_id")


@query("SELECT DISTINCT video_id FROM {playlist} WHERE video_id IN (SELECT video_id FROM {processed})")
def lookup_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.lookup_processed(frame(spark, sf_dir, "playlist"), frame(spark, sf_dir, "processed"))


@query("SELECT channel, pos, video_id FROM {playlist} p WHERE NOT EXISTS (SELECT 1 FROM {processed} v WHERE v.video_id = p.video_id)")
def filter_unprocessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.filter_unprocessed(frame(spark, sf_dir, "playlist"), frame(spark, sf_dir, "processed")).select("channel", "pos", "video_id")


FLAGGED = "flagged AS (SELECT p.channel, pos, p.video_id, CASE WHEN v.video_id IS NULL THEN 'no' ELSE 'yes' END AS processed FROM {playlist} p LEFT JOIN {processed} v ON p.video_id = v.video_id)"


@query(f"WITH {FLAGGED} SELECT * FROM flagged")
def flag_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.flag_processed(frame(spark, sf_dir, "playlist"), frame(spark, sf_dir, "processed").select("video_id")).select("channel", "pos", "video_id", "processed")


@query(f"WITH {FLAGGED} SELECT channel, count(*) AS total, count(*) FILTER (processed = 'yes') AS processed, count(*) FILTER (processed = 'no') AS new, count(*) FILTER (processed = 'no') AS displayed FROM flagged GROUP BY channel")
def processed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.processed_counts(pl.flag_processed(frame(spark, sf_dir, "playlist"), frame(spark, sf_dir, "processed").select("video_id")), exclude_processed=True)


CUTS = "cuts AS (SELECT channel, min(pos) AS cut FROM {playlist} WHERE live_status = 'was_live' AND pos <= 2000 GROUP BY channel)"


@query(f"WITH {CUTS} SELECT channel, pos, video_id FROM {{playlist}} JOIN cuts USING (channel) WHERE pos < cut")
def after_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    playlist = frame(spark, sf_dir, "playlist")
    cutoffs = pl.queue_top(pl.completed_streams_only(playlist)).withColumnRenamed("video_id", "cutoff")
    return pl.after_cutoff(playlist, cutoffs).select("channel", "pos", "video_id")


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    playlist = frame(spark, sf_dir, "playlist").select(ORDER)
    return playlist.filter("pos % 2 = 1"), playlist.filter("pos % 2 = 0")


@query("SELECT channel, video_id, CAST(row_number() OVER (PARTITION BY channel ORDER BY (pos + 1) % 2, pos) AS INT) AS pos FROM {playlist}")
def queue_prepend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.queue_prepend(*_halves(spark, sf_dir)).select("channel", "video_id", "pos")


@query("SELECT channel, arg_min(video_id, pos) AS video_id FROM {playlist} GROUP BY channel")
def queue_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.queue_top(frame(spark, sf_dir, "playlist"))


@query("SELECT channel, pos, video_id, pos = max(pos) OVER (PARTITION BY channel) AS popped FROM {playlist}")
def queue_pop_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.queue_pop_last(frame(spark, sf_dir, "playlist")).select("channel", "pos", "video_id", "popped")


@query(
    """WITH q AS (SELECT channel, arg_min(video_id, pos) AS v FROM {playlist} WHERE live_status = 'is_upcoming' AND pos <= 2 GROUP BY channel), g AS (SELECT channel, arg_min(video_id, pos) AS v FROM {playlist} WHERE pos % 7 = 3 AND live_status = 'is_live' GROUP BY channel),
l AS (SELECT channel, arg_max(video_id, (upload_date, video_id)) AS v FROM {processed} GROUP BY channel), c AS (SELECT DISTINCT channel FROM {playlist})
SELECT channel, coalesce(q.v, g.v, l.v) AS cutoff, CASE WHEN coalesce(q.v, g.v, l.v) IS NULL THEN 'no cutoff' END AS err FROM c LEFT JOIN q USING (channel) LEFT JOIN g USING (channel) LEFT JOIN l USING (channel)"""
)
def queue_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    playlist = frame(spark, sf_dir, "playlist")
    latest = frame(spark, sf_dir, "processed").groupBy("channel").agg(F.max_by("video_id", F.struct("upload_date", "video_id")).alias("video_id"))
    given = pl.queue_top(playlist.filter("pos % 7 = 3 AND live_status = 'is_live'"))
    return pl.queue_cutoff(playlist.select("channel").distinct(), playlist.filter("live_status = 'is_upcoming' AND pos <= 2"), given, latest)


ADVANCED = """o AS (SELECT *, CASE WHEN NOT contains(title, 'a') THEN 'skipped' WHEN o_orderkey % 11 = 0 THEN 'import_failed' WHEN o_orderkey % 4 = 0 THEN 'failed' ELSE 'ok' END AS outcome FROM {playlist}),
st AS (SELECT *, max(CAST(outcome = 'import_failed' AS INT)) OVER (PARTITION BY channel ORDER BY pos DESC ROWS UNBOUNDED PRECEDING) = 1 AS stopped FROM o),
adv AS (SELECT *, CASE WHEN stopped THEN 'remaining' WHEN outcome = 'ok' THEN 'processed' ELSE outcome END AS status FROM st)"""


def _advanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.when(F.col("o_orderkey") % 11 == 0, "import_failed").when(F.col("o_orderkey") % 4 == 0, "failed").otherwise("ok")
    return pl.queue_advance(frame(spark, sf_dir, "playlist"), outcome, "a")


@query(f"WITH {ADVANCED} SELECT channel, pos, video_id, status, status <> 'processed' AS stays FROM adv")
def queue_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _advanced(spark, sf_dir).select("channel", "pos", "video_id", "status", "stays")


@query(f"WITH {ADVANCED} SELECT channel, status, count(*) AS n FROM adv GROUP BY channel, status")
def queue_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.queue_summary(_advanced(spark, sf_dir))


@query("SELECT video_id, title AS video_title, CAST(CAST(coalesce(release_timestamp, timestamp) AS BIGINT) AS VARCHAR) AS upload_date, 0 AS n_matches FROM {playlist}")
def video_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.video_metadata(frame(spark, sf_dir, "playlist")).withColumn("n_matches", F.size("matches")).drop("matches")

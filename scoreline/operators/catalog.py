"""The tournament catalogue: schedule joins and aggregates, defaults, filters, groups and their order."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreline.functions import text as fx

#: Fixed values of the browser: years shown at first, and names for what is missing.
DEFAULT_YEARS = (2025, 2026)
UNKNOWN_TOURNAMENT, UNKNOWN_DAY = "Unknown Tournament", "Unknown Day"
THUMBNAIL, PLACEHOLDER = "https://img.youtube.com/vi/{}/mqdefault.jpg", "https://placehold.co/320x180"


def participants_dedupe(participants: DataFrame) -> DataFrame:
    return participants.dropDuplicates(["match_id", "player", "side"])


def schedule_join(matches: DataFrame, tournaments: DataFrame, participants: DataFrame) -> DataFrame:
    """One row for each participant; matches without any vanish."""
    return matches.join(tournaments, "tournament_id").join(participants, "match_id")


def team_agg(participants: DataFrame) -> DataFrame:
    """(match_id, team_a, team_b): a side's names, each once, by name, joined by ' / '; null for a side without any.

    Sets drop repeated participants in the same shuffle that brings a match together.
    """
    rows = participants.groupBy("match_id").agg(*[F.collect_set(F.when(F.col("side") == side, F.col("player"))).alias(f"_{side}") for side in "AB"])
    names = lambda c: F.when(F.size(c) > 0, F.array_join(F.sort_array(c), " / "))
    return rows.select("match_id", names("_A").alias("team_a"), names("_B").alias("team_b"))


def tournament_schedule(matches: DataFrame, tournaments: DataFrame, videos: DataFrame, participants: DataFrame) -> DataFrame:
    """One row for each match that has participants, ordered by match time, then match_id."""
    teams = team_agg(participants)
    rows = matches.join(teams, "match_id").join(tournaments, "tournament_id").join(videos, "video_id")
    when = fx.match_timestamp(F.col("upload_date"), F.col("video_offset_seconds"))
    return rows.select(
        "match_id", "tournament", "year", "video_offset_seconds", "upload_date", fx.format_match_time(when).alias("match_time"), "team_a", "team_b", "is_doubles", "youtube_id", "video_title"
    ).orderBy(when, "match_id")


def schedule_defaults(schedule: DataFrame, run_ts: datetime) -> DataFrame:
    """The rows as the browser shows them."""
    return schedule.select(
        "match_id",
        F.coalesce("tournament", F.lit(UNKNOWN_TOURNAMENT)).alias("tournament"),
        F.coalesce("year", F.lit(run_ts.year)).alias("year"),
        F.coalesce(F.nullif("day", F.lit("")), F.lit(UNKNOWN_DAY)).alias("day"),
        "session",
        F.coalesce("effective_timestamp", "upload_date").alias("effective_timestamp"),
        F.when(F.col("is_doubles"), "Doubles").otherwise("Singles").alias("tag"),
        F.when(F.col("youtube_id").isNotNull(), F.concat(F.lit(THUMBNAIL.split("{}")[0]), "youtube_id", F.lit(THUMBNAIL.split("{}")[1]))).otherwise(PLACEHOLDER).alias("thumbnail"),
        F.date_format("upload_date", "yyyy-MM-dd").alias("date"),
        fx.match_title(F.col("team_a"), F.col("team_b"), F.col("video_title")).alias("title"),
        fx.infer_tournament_type(F.coalesce("tournament", F.lit(UNKNOWN_TOURNAMENT))).alias("type"),
    )


def distinct_tournaments(schedule: DataFrame) -> DataFrame:
    """(tournament, year, type): each once, from the schedule with defaults."""
    return schedule.select("tournament", "year", "type").dropDuplicates(["tournament", "year"])


def tournament_lookup(schedule: DataFrame, tournaments: DataFrame) -> DataFrame:
    """Each match with its tournament's year and type, or year 0 and contender where there is none."""
    known = tournaments.select(F.col("tournament").alias("_t"), F.col("year").alias("_y"), F.col("type").alias("_type"))
    joined = schedule.join(known, (F.col("tournament") == F.col("_t")) & (F.col("year") == F.col("_y")), "left")
    return joined.select("match_id", "tournament", F.coalesce("_y", F.lit(0)).alias("tournament_year"), F.coalesce("_type", F.lit("contender")).alias("tournament_type"))


def filter_matches(schedule: DataFrame, years=DEFAULT_YEARS, types=(), tournament: str | None = None, search: str = "", singles: bool = True, doubles: bool = False) -> DataFrame:
    """Of the schedule with defaults: sets that are empty let all pass; search looks in titles and tournaments."""
    tag = F.col("tag")
    keep = ((tag == "Singles") & F.lit(singles)) | ((tag == "Doubles") & F.lit(doubles))
    if years:
        keep &= F.col("year").isin(list(years))
    if types:
        keep &= F.col("type").isin(list(types))
    if tournament is not None:
        keep &= F.col("tournament") == tournament
    if search:
        keep &= F.lower("title").contains(search.lower()) | F.lower("tournament").contains(search.lower())
    return schedule.filter(keep)


def available_tournaments(schedule: DataFrame, years=(), types=()) -> DataFrame:
    found = distinct_tournaments(schedule)
    for column, allowed in (("year", years), ("type", types)):
        if allowed:
            found = found.filter(F.col(column).isin(list(allowed)))
    return found


def group_key(day: Column, session: Column) -> Column:
    return F.when(session.isNull(), day).otherwise(F.concat(day, F.lit(" - Round "), session.cast("string")))


def matches_by_group(schedule: DataFrame) -> DataFrame:
    """(tournament, year, group_key, session, latest, n_matches, match_ids) of each group of a tournament's days."""
    return schedule.groupBy("tournament", "year", group_key(F.col("day"), F.col("session")).alias("group_key")).agg(
        F.min_by("session", "match_id").alias("session"),
        F.max("effective_timestamp").alias("latest"),
        F.count("*").alias("n_matches"),
        F.array_join(F.sort_array(F.collect_list("match_id")), ",").alias("match_ids"),
    )


def first_in_group(schedule: DataFrame) -> DataFrame:
    """Session of each group's first match, by match_id."""
    return schedule.groupBy("tournament", "year", group_key(F.col("day"), F.col("session")).alias("group_key")).agg(F.min("match_id").alias("first_match"), F.min_by("session", "match_id").alias("session"))


def sort_groups(groups: DataFrame) -> DataFrame:
    """Adds rank inside a tournament: latest first (none last), then the higher session (none is 0), then the key."""
    order = Window.partitionBy("tournament", "year").orderBy(F.col("latest").desc_nulls_last(), F.coalesce("session", F.lit(0)).desc(), "group_key")
    return groups.withColumn("rank", F.row_number().over(order))


def number_matches(schedule: DataFrame, by: str = "tournament") -> DataFrame:
    """Adds id 'm_<n>', counting from 0 within each tournament by upload date, newest first."""
    order = Window.partitionBy(by).orderBy(F.col("upload_date").desc(), "match_id")
    return schedule.withColumn("id", F.concat(F.lit("m_"), (F.row_number().over(order) - 1).cast("string")))


def schedule_order(schedule: DataFrame) -> DataFrame:
    return schedule.orderBy(F.col("upload_date").desc(), "match_id")


def delete_by_parent(children: DataFrame, matches: DataFrame, videos: DataFrame) -> DataFrame:
    """Participants left after those of all matches of these videos go."""
    gone = matches.join(videos.select("video_id"), "video_id", "left_semi").select("match_id")
    return children.join(gone, "match_id", "left_anti")


def latest_upload_ids(videos: DataFrame) -> DataFrame:
    """All ids of the latest upload date."""
    latest = videos.agg(F.max(F.to_date("upload_date")).alias("_day"))
    return videos.join(F.broadcast(latest), F.to_date("upload_date") == F.col("_day")).select("video_id", "upload_date")


def latest_video(videos: DataFrame) -> DataFrame:
    return videos.orderBy(F.col("upload_date").desc(), F.col("video_id").desc()).select("video_id", "upload_date").limit(1)

"""Queries over titles, texts and records."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreline.functions import text as fx
from scoreline.functions import titles as tt
from scoreline.operators import playlists as pl
from scoreline.plans.adapters import frame
from scoreline.plans.registry import query

#: The moment that stands for now.
RUN_TS = datetime(2026, 2, 1, 12, 0, 0)

_YEAR = "regexp_full_match({0}, '[+-]?\\d+') AND coalesce(try_cast({0} AS INT), 0) BETWEEN 2020 AND 2100"
_WORDS = "list_filter(string_split_regex({}, '\\s+'), lambda w: w <> '')"
PARSED = rf"""parts AS (SELECT *, list_transform(string_split(title, '|'), lambda p: trim(p)) AS every FROM {{videos}}),
kept AS (SELECT *, list_filter(every, lambda p: p <> 'LIVE!' AND NOT contains(p, 'Infinity') AND NOT regexp_full_match(p, 'T[+-]?\d+')) AS k FROM parts),
found AS (SELECT *, coalesce(list_position(list_transform(k, lambda p: len(list_filter({_WORDS.format("p")}, lambda v: {_YEAR.format("v")})) > 0), true), 0) AS a FROM kept),
others AS (SELECT *, {_WORDS.format("k[a]")} AS ws, list_filter(list_transform(k, lambda p, i: struct_pack(i := i, p := p)), lambda s: s.i <> a) AS rest FROM found),
picked AS (SELECT *, list_position(list_transform(ws, lambda v: {_YEAR.format("v")}), true) AS ya,
  list_filter(rest, lambda s: contains(s.p, 'Day'))[-1] AS dp, list_filter(rest, lambda s: contains(lower(s.p), 'finals'))[-1] AS fp FROM others),
staged AS (SELECT *, CASE WHEN len(every) < 3 THEN 'too few parts' WHEN a = 0 THEN 'no year' END AS err, trim(regexp_replace(fp.p, '(?i)\s*session\s*\d+', '', 'g')) AS fin FROM picked),
parsed AS (SELECT video_id, pos, title, upload_date, error, err, CASE WHEN err IS NULL THEN array_to_string(ws[1:ya - 1], ' ') END AS tournament,
  CASE WHEN err IS NULL THEN CAST(ws[ya] AS INT) END AS year,
  CASE WHEN err IS NOT NULL THEN NULL WHEN dp IS NULL AND fp IS NULL THEN coalesce(k[a + 1], '') WHEN fp IS NULL THEN dp.p WHEN dp IS NULL OR dp.i = fp.i THEN fin ELSE dp.p || ' ' || fin END AS day FROM staged)"""


@query(f"WITH {PARSED} SELECT video_id, tournament, year, day, err FROM parsed")
def parse_stream_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tt.parse_stream_titles(frame(spark, sf_dir, "videos")).select("video_id", "tournament", "year", "day", "err")


@query(f"WITH {PARSED} SELECT 'stream_titles' AS job, coalesce(err, 'ok') AS err_kind, count(*) AS rows FROM parsed GROUP BY ALL")
def parse_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tt.parse_report(tt.parse_stream_titles(frame(spark, sf_dir, "videos")), "stream_titles")


@query(
    rf"""WITH p AS (SELECT video_id, list_transform(string_split(title, '|'), lambda x: trim(x)) AS k FROM {{videos}}),
w AS (SELECT *, {_WORDS.format("k[4]")} AS ws FROM p),
e AS (SELECT *, CASE WHEN len(k) < 4 THEN 'too few parts' WHEN len(ws) < 1 THEN 'empty part' WHEN NOT regexp_full_match(ws[-1], '[+-]?\d+') THEN 'no year' END AS err FROM w)
SELECT video_id, CASE WHEN err IS NULL THEN lower(array_to_string(ws[1:len(ws) - 1], ' ')) END AS tournament, CASE WHEN err IS NULL THEN CAST(ws[-1] AS INT) END AS year, err FROM e"""
)
def parse_stream_titles_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tt.parse_stream_titles_legacy(frame(spark, sf_dir, "videos")).select("video_id", "tournament", "year", "err")


#: What each of the eight title shapes must give, written out.
VODS = """vod AS (SELECT pos, url, title, pos % 8 AS k FROM {vods}),
read AS (SELECT *, CASE k WHEN 2 THEN 'no players' WHEN 3 THEN 'no category' WHEN 5 THEN 'no round' WHEN 6 THEN 'no players' END AS err,
  CASE WHEN k IN (0, 1, 4, 7) THEN k IN (0, 4) END AS full_match, CASE k WHEN 0 THEN 'A vs B' WHEN 1 THEN 'A VS B' WHEN 4 THEN 'C vs D' WHEN 7 THEN 'E vs F' END AS players,
  CASE k WHEN 0 THEN 'MS' WHEN 1 THEN 'WS' WHEN 4 THEN 'XD' WHEN 7 THEN 'MS' END AS gender, CASE k WHEN 0 THEN 'R16' WHEN 1 THEN 'QF' WHEN 4 THEN 'SF' WHEN 7 THEN 'F' END AS round,
  CASE k WHEN 0 THEN trim(string_split(title, '|')[4]) WHEN 1 THEN 'Smash' WHEN 4 THEN 'Unknown' WHEN 7 THEN 'Contender' END AS tournament FROM vod)"""


@query(f"WITH {VODS} SELECT pos, full_match, players, gender, round, tournament, err FROM read")
def parse_vod_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tt.parse_vod_titles(frame(spark, sf_dir, "vods")).select("pos", "full_match", "players", "gender", "round", "tournament", "err")


@query(f"""WITH {VODS} SELECT pos, url, tournament FROM read JOIN orders ON o_orderkey = pos WHERE err IS NULL AND contains(lower(tournament), 'tour') AND gender = 'MS' AND full_match
AND o_orderstatus <> 'F' AND CAST(o_orderdate AS DATE) > TIMESTAMP '1998-01-01 12:00:00' - INTERVAL 48 HOURS ORDER BY pos DESC""")
def filter_vods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recent full matches of one tour that weren't watched."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    dated = frame(spark, sf_dir, "vods").join(orders.select(F.col("o_orderkey").alias("pos"), F.date_format("o_orderdate", "yyyyMMdd").alias("upload_date")), "pos")
    return pl.filter_vods(tt.parse_vod_titles(dated), tournament="tour", full_only=True, recent=datetime(1998, 1, 1, 12), history=_watched(spark, sf_dir)).select("pos", "url", "tournament")


def _watched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_orderstatus = 'F'").select(F.concat(F.lit("https://example.com/watch?v="), F.col("o_orderkey").cast("string")).alias("url"))


@query("""SELECT v.pos, v.url FROM {vods} v WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o_orderstatus = 'F' AND v.url = 'https://example.com/watch?v=' || o_orderkey)""")
def unwatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.unwatched(frame(spark, sf_dir, "vods"), _watched(spark, sf_dir)).select("pos", "url")


@query(
    """WITH s AS (SELECT video_id, l_linenumber, l_partkey, side, CASE WHEN contains(side, '/') THEN list_filter(list_transform(string_split(side, '/'), lambda p: trim(p)), lambda p: p <> '') ELSE [trim(side)] END AS names FROM {video_matches})
SELECT video_id, l_linenumber, l_partkey, array_to_string(names, '+') AS names, len(names) > 1 AS is_doubles FROM s"""
)
def split_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir, "video_matches")
    return rows.select("video_id", "l_linenumber", "l_partkey", F.array_join(tt.split_players(F.col("side")), "+").alias("names"), tt.is_doubles(F.col("side"), F.col("name")).alias("is_doubles"))


@query("SELECT video_id, CASE WHEN regexp_full_match(upload_date, '[+-]?\\d+') THEN make_timestamp(CAST(upload_date AS BIGINT) * 1000000) END AS uploaded FROM {videos}")
def parse_upload_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "videos").select("video_id", fx.parse_upload_epoch(F.col("upload_date")).cast("timestamp_ntz").alias("uploaded"))


@query("SELECT video_id, CASE WHEN regexp_full_match(upload_date, '[+-]?\\d+') THEN strftime(make_timestamp(CAST(upload_date AS BIGINT) * 1000000), '%Y-%m-%d') ELSE upload_date END AS shown FROM {videos}")
def display_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "videos").select("video_id", fx.display_date(F.col("upload_date")).alias("shown"))


def _durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, c = F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("int").cast("string"), F.col("l_suppkey").cast("string")
    shape = F.pmod("l_orderkey", F.lit(5))
    text = F.when(shape == 0, c).when(shape == 1, F.concat_ws(":", b, a)).when(shape == 2, F.concat_ws(":", a, b, c)).when(shape == 3, F.concat_ws(":", F.lit("x"), b)).otherwise(F.concat_ws(":", a, a, b, c))
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.alias("duration_string"))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CASE l_orderkey % 5 WHEN 0 THEN l_suppkey WHEN 1 THEN CAST(l_quantity AS INT) * 60 + l_linenumber
  WHEN 2 THEN l_linenumber * 3600 + CAST(l_quantity AS INT) * 60 + l_suppkey WHEN 3 THEN CAST(l_quantity AS INT) END AS DOUBLE) AS seconds FROM lineitem"""
)
def parse_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _durations(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", fx.parse_duration(F.col("duration_string")).alias("seconds"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, printf('%02d:%02d:%02d', CAST(trunc(l_extendedprice) AS BIGINT) // 3600, CAST(trunc(l_extendedprice) AS BIGINT) % 3600 // 60, CAST(trunc(l_extendedprice) AS BIGINT) % 60) AS hms FROM lineitem")
def format_hms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", fx.format_hms(F.col("l_extendedprice")).alias("hms"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%b %d, %Y %H:%M') AS match_time FROM orders")
def format_match_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", fx.format_match_time(F.col("o_orderdate")).alias("match_time"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS upload_date FROM orders WHERE o_orderdate > TIMESTAMP '2000-06-01 12:00:00' - INTERVAL 48 HOURS")
def recent_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.date_format("o_orderdate", "yyyyMMdd").alias("upload_date"))
    return pl.recent_only(orders, datetime(2000, 6, 1, 12))


_ID = """CASE WHEN contains(url, 'watch?v=') THEN split_part(string_split(url, 'watch?v=')[-1], '&', 1) WHEN contains(url, 'youtu.be/') THEN split_part(string_split(url, 'youtu.be/')[-1], '?', 1)
WHEN contains(url, '/live/') THEN split_part(string_split(url, '/live/')[-1], '?', 1) ELSE split_part(string_split(url, '/')[-1], '?', 1) END"""


@query(f"SELECT page_id, {_ID} AS id FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN 'https://youtu.be/' || url WHEN 2 THEN url || '/live/x' || page_id || '?a=1' ELSE url || '/watch?v=' || page_id || '&t=1' END AS url FROM pages)")
def extract_video_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape, u, n = F.pmod("page_id", F.lit(4)), F.col("url"), F.col("page_id").cast("string")
    url = F.when(shape == 0, u).when(shape == 1, F.concat(F.lit("https://youtu.be/"), u)).when(shape == 2, F.concat(u, F.lit("/live/x"), n, F.lit("?a=1"))).otherwise(F.concat(u, F.lit("/watch?v="), n, F.lit("&t=1")))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", fx.extract_video_id(url).alias("id"))


@query("SELECT page_id, nullif(regexp_extract(url, '(?:v=|/)([0-9A-Za-z_-]{11}).*', 1), '') AS id FROM pages")
def extract_video_id_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", fx.extract_video_id_regex(F.col("url")).alias("id"))


@query("SELECT c_custkey, regexp_replace(upper(c_name), '[^A-Z0-9]', '', 'g') AS name FROM customer")
def normalize_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", fx.normalize_name(F.col("c_name")).alias("name"))


@query(
    r"""SELECT doc_id, left(regexp_replace(text, '[^\p{L}\p{M}\p{Nd}\p{Pc}\-]', '_', 'g'), 20) AS file_name,
left(regexp_replace(regexp_replace(regexp_replace(text, '[^\p{L}\p{M}\p{Nd}\p{Pc}\s-]', '', 'g'), '[-\s]+', '-', 'g'), '^[-_]+|[-_]+$', '', 'g'), 100) AS folder_name FROM documents"""
)
def sanitize_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", fx.sanitize_name(F.col("text")).alias("file_name"), fx.sanitize_title(F.col("text")).alias("folder_name"))


#: Shapes of read texts, good and broken, over the samples.
_TEXT = """'row 1: ' || player1 || CASE WHEN set1 = 2 THEN ', ' || game1 ELSE ', ' || set1 || ', ' || game1 END || CASE WHEN set2 = 2 AND game2 > 8 THEN '' ELSE ' row 2: ' || player2 || ' ' || set2 || ' ' || game2 END"""


@query(
    f"""WITH s AS (SELECT *, set2 = 2 AND game2 > 8 AS cut, set1 = 2 AS lone, {_TEXT} AS text FROM {{samples}} WHERE success)
SELECT video_id, t, NOT cut AND NOT lone AS success, CASE WHEN NOT cut THEN player1 END AS player1, CASE WHEN NOT cut THEN player2 END AS player2, CASE WHEN NOT cut THEN CASE WHEN lone THEN game1 ELSE set1 END END AS set1,
CASE WHEN NOT cut THEN set2 END AS set2, CASE WHEN NOT cut THEN CASE WHEN lone THEN -1 ELSE game1 END END AS game1, CASE WHEN NOT cut THEN game2 END AS game2,
CASE WHEN cut THEN 'Could not parse rows: ''' || text || '''' WHEN lone THEN 'Incomplete score digits found' END AS error FROM s"""
)
def parse_scoreboard_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = frame(spark, sf_dir, "samples").filter("success").select("video_id", "t", F.expr(_TEXT).alias("text"))
    return fx.parse_scoreboard_text(texts).drop("text")


@query("SELECT video_id, t, 'row 1: ' || player1 || ', ' || set1 || ', ' || game1 || ' row 2: ' || player2 || ', ' || set2 || ', ' || game2 AS text FROM {samples} WHERE success")
def training_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = [F.col(c) for c in ("player1", "set1", "game1", "player2", "set2", "game2")]
    return frame(spark, sf_dir, "samples").filter("success").select("video_id", "t", fx.training_text(*cols).alias("text"))


@query(
    """SELECT video_id, t, coalesce(success AND set1 = 0 AND set2 = 0 AND game1 = 0 AND game2 = 0, false) AS is_match_start, coalesce(success AND game1 = 0 AND game2 = 0, false) AS is_game_start,
coalesce(success AND set1 = 0 AND set2 = 0 AND game1 + game2 <= 15, false) AS is_early, CASE WHEN success THEN game1 + game2 ELSE -1 END AS total_points FROM {samples}"""
)
def score_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.score_flags(frame(spark, sf_dir, "samples")).select("video_id", "t", "is_match_start", "is_game_start", "is_early", "total_points")


@query(
    """SELECT video_id, t, CASE WHEN set1 = 0 THEN 'variance' ELSE 'sampling' END AS kind, '01:02:03' AS at, player1 AS name1, player2 AS name2, CASE WHEN set1 > 0 THEN set1 END AS set1, CASE WHEN set1 > 0 THEN set2 END AS set2,
CASE WHEN set1 > 0 THEN game1 END AS game1, CASE WHEN set1 > 0 THEN game2 END AS game2, 'out/' || video_id || '.jpg' AS path FROM {samples} WHERE success"""
)
def parse_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = """CASE WHEN set1 = 0 THEN '[OCR_NAME_VARIANCE] at 01:02:03: \\'' || player1 || '\\' vs \\'' || player2 || '\\' (edit distance=1), out/' || video_id || '.jpg'
      ELSE 'Sampling at 01:02:03... Score: ' || player1 || ' ' || set1 || ':' || set2 || ' ' || player2 || ', Game: ' || game1 || ':' || game2 || ', out/' || video_id || '.jpg' END"""
    lines = frame(spark, sf_dir, "samples").filter("success").select("video_id", "t", F.expr(line).alias("line"))
    return fx.parse_log_lines(lines).drop("line")


@query("SELECT match_id, o_orderdate + to_seconds(video_offset_seconds) AS match_timestamp FROM {matches} JOIN orders ON match_id = o_orderkey")
def match_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir, "matches").join(frame(spark, sf_dir, "uploads"), "video_id")
    return rows.select("match_id", fx.match_timestamp(F.col("upload_date"), F.col("video_offset_seconds")).alias("match_timestamp"))


@query("SELECT match_id, tournament_id, is_doubles, o_orderdate + to_seconds(video_offset_seconds) AS match_timestamp FROM {matches} JOIN orders ON match_id = o_orderkey")
def insert_legacy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir, "matches").join(frame(spark, sf_dir, "uploads"), "video_id")
    return rows.select("match_id", "tournament_id", "is_doubles", fx.match_timestamp(F.col("upload_date"), F.col("video_offset_seconds")).alias("match_timestamp"))


@query(
    """SELECT match_id, CASE WHEN contains(tournament, 'Champions') THEN 'champions' WHEN contains(tournament, 'Smash') THEN 'smash' WHEN contains(tournament, 'Youth Contender') THEN 'youthContender' ELSE 'contender' END AS type FROM {schedule}"""
)
def infer_tournament_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "schedule").select("match_id", fx.infer_tournament_type(F.col("tournament")).alias("type"))


@query("SELECT match_id, CASE WHEN team_a IS NOT NULL AND team_b IS NOT NULL THEN team_a || ' vs ' || team_b ELSE coalesce(video_title, 'Unknown Match') END AS title FROM {schedule}")
def match_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "schedule").select("match_id", fx.match_title(F.col("team_a"), F.col("team_b"), F.col("video_title")).alias("title"))

"""Queries over imports, files and exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreline.operators import importer as im
from scoreline.plans.adapters import TABLES, frame
from scoreline.plans.registry import query
from scoreline.plans.titles import PARSED, RUN_TS
from scoreline.sources import files as fl
from scoreline.sources.scratch import shared_path

#: Each video's matches: every name on side one, and one fixed opponent.
LISTED = "listed AS (SELECT video_id, l_linenumber, l_partkey, offset_s, side, row_number() OVER (PARTITION BY video_id ORDER BY offset_s, side) - 1 AS match_pos FROM (SELECT DISTINCT video_id, l_linenumber, 0 AS l_partkey, offset_s, side FROM {video_matches}) m)"
SIDES = "sides AS (SELECT *, CASE WHEN contains(side, '/') THEN list_filter(list_transform(string_split(side, '/'), lambda p: trim(p)), lambda p: p <> '') ELSE [trim(side)] END AS names FROM listed)"
GOOD = "good AS (SELECT *, CASE WHEN regexp_full_match(upload_date, '[+-]?\\d+') THEN make_timestamp(CAST(upload_date AS BIGINT) * 1000000) ELSE TIMESTAMP '2026-02-01 12:00:00' END AS uploaded FROM parsed WHERE err IS NULL)"
STAGED = f"WITH {PARSED}, {LISTED}, {SIDES}, {GOOD}"


def _videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as match files hold them."""
    match = F.struct(F.col("offset_s").alias("timestamp"), F.col("side").alias("player1"), F.lit("OPPONENT").alias("player2"))
    matches = frame(spark, sf_dir, "video_matches").repartition("video_id").groupBy("video_id").agg(F.sort_array(F.collect_set(match)).alias("matches"))
    return frame(spark, sf_dir, "videos").withColumnRenamed("title", "video_title").join(matches, "video_id", "left").withColumn("matches", F.coalesce("matches", F.array().cast("array<struct<timestamp:int,player1:string,player2:string>>")))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document for each video: an object or an array of one; for every tenth there is an empty array besides."""
    record = F.struct("video_id", "video_title", "upload_date", "matches", "error")
    doc = F.when(F.col("pos") % 10 == 4, F.to_json(F.array(record))).otherwise(F.to_json(record))
    docs = F.when(F.col("pos") % 10 == 3, F.array(doc, F.lit("[]"))).otherwise(F.array(doc))
    return _videos(spark, sf_dir).select(F.col("video_id").alias("file"), F.explode(docs).alias("doc"))


@query(
    f"""WITH {LISTED}, n AS (SELECT video_id, count(*) AS n FROM listed GROUP BY video_id), b AS (SELECT *, pos // 500 AS file, row_number() OVER (PARTITION BY pos // 500 ORDER BY pos) AS k FROM {{videos}}),
r AS (SELECT file, k, video_id, title AS video_title, error, CAST(coalesce(n, 0) AS INT) AS n_matches, NULL AS file_err FROM b LEFT JOIN n USING (video_id))
SELECT * EXCLUDE (k) FROM r UNION ALL SELECT file + 2000000, * EXCLUDE (file, k) FROM r WHERE k = 1 UNION ALL SELECT DISTINCT file + 1000000, NULL, NULL, NULL, -1, 'no videos found' FROM b"""
)
def read_match_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of up to 500 videos each; beside each of them one that holds an empty array, and one with its first video as one object."""
    record = F.struct("pos", "video_id", "video_title", "upload_date", "matches", "error")
    files = _videos(spark, sf_dir).withColumn("file", F.floor(F.col("pos") / 500)).repartition("file").groupBy("file").agg(F.sort_array(F.collect_list(record)).alias("v"))
    docs = [(0, F.to_json("v")), (1_000_000, F.lit("[]")), (2_000_000, F.to_json(F.get("v", F.lit(0))))]
    # A folder holds a thousand files, so few folders are made and listed.
    place = lambda k: [F.concat_ws("-", F.lit(k), F.floor(F.col("file") / 1000)).alias("folder"), F.coalesce((F.col("file") + k).cast("string"), F.lit("none")).alias("stem")]
    every = files.select(F.explode(F.array(*[F.struct(*place(k), doc.alias("doc")) for k, doc in docs])).alias("_f")).select("_f.*")
    path = shared_path(spark, "matches")
    fl.write_match_files(every, path)
    rows = fl.read_match_json(spark, path).withColumn("file", F.regexp_extract("file", r"/(-?\d+)[.]json$", 1).try_cast("long"))
    return rows.select("file", "video_id", "video_title", "error", F.coalesce(F.size("matches"), F.lit(-1)).alias("n_matches"), "file_err")


def _staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return im.stage_videos(_videos(spark, sf_dir), RUN_TS)


@query(f"{STAGED} SELECT video_id, tournament, year, CAST(match_pos AS INT) AS match_pos, CAST(offset_s AS INT) AS timestamp, side AS player1 FROM good JOIN listed USING (video_id) WHERE error IS NULL")
def explode_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return im.explode_matches(im.import_policy(_staged(spark, sf_dir))[0]).select("video_id", "tournament", "year", "match_pos", "timestamp", "player1")


@query(f"{STAGED} SELECT video_id, err FROM parsed WHERE err IS NOT NULL")
def import_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return im.import_policy(_staged(spark, sf_dir))[1].select("video_id", "err")


@query(f"{STAGED} SELECT video_id, title, uploaded AS upload_date, day, error AS processing_error FROM good")
def set_clear_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = im.set_clear_error(im.import_policy(_staged(spark, sf_dir))[0])
    return rows.withColumn("upload_date", F.col("upload_date").cast("timestamp_ntz"))


def _before(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """A catalogue that holds a third of the videos, one old match each, and matches of another video."""
    empty = im.truncate_all(spark)
    old = frame(spark, sf_dir, "videos").filter("pos % 3 = 0").select("video_id").union(spark.createDataFrame([("other",)], "video_id string"))
    videos = old.select("video_id", F.lit("old").alias("title"), F.lit(RUN_TS).cast("timestamp").alias("upload_date"), F.lit("Day 0").alias("day"), F.lit("old error").alias("processing_error"))
    matches = old.select(F.concat(F.lit("old#"), "video_id").alias("match_id"), "video_id", F.lit("Old Cup").alias("tournament"), F.lit(2020).alias("year"), F.lit(1).alias("video_offset_seconds"), F.lit(False).alias("is_doubles"))
    people = matches.select("match_id", F.lit("OPPONENT").alias("player"), F.lit("B").alias("side"))
    return empty | {"videos": videos, "matches": matches, "participants": people, "players": people.select("player").distinct(), "tournaments": matches.select("tournament", "year").distinct()}


OLD = "old AS (SELECT video_id FROM {videos} WHERE pos % 3 = 0 UNION ALL SELECT 'other')"


@query(
    f"""{STAGED}, {OLD}, k AS (SELECT g.video_id AS gv, o.video_id AS ov, title, day, error FROM good g FULL JOIN old o ON g.video_id = o.video_id)
SELECT coalesce(gv, ov) AS video_id, CASE WHEN gv IS NULL THEN 'old' ELSE title END AS title, CASE WHEN gv IS NULL THEN 'Day 0' ELSE day END AS day, CASE WHEN gv IS NULL THEN 'old error' ELSE error END AS processing_error,
CASE WHEN gv IS NULL THEN 'kept' WHEN ov IS NOT NULL THEN 'updated' ELSE 'inserted' END AS kind FROM k"""
)
def upsert_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    staged = im.import_policy(_staged(spark, sf_dir))[0]
    return im.upsert_video(im.set_clear_error(staged), _before(spark, sf_dir)["videos"]).drop("upload_date")


@query(f"{STAGED} SELECT DISTINCT tournament, year FROM good UNION SELECT 'Old Cup', 2020")
def get_or_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    return im.get_or_create(im.import_policy(_staged(spark, sf_dir))[0], _before(spark, sf_dir)["tournaments"])


AFTER = f"""{STAGED}, {OLD}, new AS (SELECT video_id || '#' || match_pos AS match_id, names, len(names) > 1 AS is_doubles FROM good JOIN sides USING (video_id) WHERE error IS NULL),
stay AS (SELECT 'old#' || video_id AS match_id FROM old WHERE video_id NOT IN (SELECT video_id FROM good))"""


@query(f"{AFTER}, people AS (SELECT DISTINCT match_id, unnest(names) AS player, 'A' AS side FROM new UNION ALL SELECT match_id, 'OPPONENT', 'B' FROM new UNION ALL SELECT match_id, 'OPPONENT', 'B' FROM stay) SELECT * FROM people")
def import_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return im.import_matches(_before(spark, sf_dir), _videos(spark, sf_dir), RUN_TS)["participants"]


@query(f"{AFTER} SELECT match_id, is_doubles FROM new UNION ALL SELECT match_id, false FROM stay")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches after an import: what is kept of the old ones and the new ones."""
    return im.import_matches(_before(spark, sf_dir), _videos(spark, sf_dir), RUN_TS)["matches"].select("match_id", "is_doubles")


@query(
    f"""{AFTER} SELECT (SELECT count(*) FROM new) + (SELECT count(*) FROM stay) AS matches, (SELECT count(*) FROM new WHERE NOT is_doubles) + (SELECT count(*) FROM stay) AS singles, (SELECT count(*) FROM new WHERE is_doubles) AS doubles,
(SELECT count(*) FROM (SELECT video_id FROM good UNION SELECT video_id FROM old) u) AS videos, (SELECT count(*) FROM old) - (SELECT count(*) FROM stay) AS deleted"""
)
def import_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = _before(spark, sf_dir)
    return im.import_summary(before, im.import_matches(before, _videos(spark, sf_dir), RUN_TS))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 6
    duration = F.when(k == 0, "1:02").when(k == 1, "").when(k == 2, "1:2:3:4").otherwise("59")
    doc = F.to_json(F.struct(F.concat_ws("/", "event_type", "event_id").alias("url"), F.col("props").alias("title"), F.lit("20240101").alias("upload_date"), duration.alias("duration_string")))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.when(k == 4, F.concat(F.lit("WARNING "), doc)).when(k == 5, "{broken}").otherwise(doc).alias("line"))


@query("SELECT event_type || '/' || event_id AS url, props AS title, CAST(CASE event_id % 6 WHEN 0 THEN 62 WHEN 3 THEN 59 END AS DOUBLE) AS seconds, CASE WHEN event_id % 6 = 2 THEN 'bad duration' END AS err FROM events WHERE event_id % 6 IN (0, 2, 3)")
def read_ytdlp_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "listing")
    _lines(spark, sf_dir).select("line").write.text(path)
    return fl.read_ytdlp_lines(spark, path).select("url", "title", "seconds", "err")


@query(
    """WITH e AS (SELECT 'Cup ' || p_brand || '/' || p_size % 2 AS folder_t, 'Round ' || p_size % 4 AS round, p_name AS players, p_partkey, p_partkey % 4 = 0 AS full_match FROM part),
f AS (SELECT replace(folder_t, '/', ' and ') || '/' || round AS folder, CASE WHEN full_match THEN 'FULL_' ELSE '' END || players AS stem, p_partkey FROM e)
SELECT folder, stem, max(p_partkey) AS pos FROM f GROUP BY folder, stem"""
)
def partitioned_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        F.concat(F.lit("Cup "), "p_brand", F.lit("/"), (F.col("p_size") % 2).cast("string")).alias("tournament"), F.concat(F.lit("Round "), (F.col("p_size") % 4).cast("string")).alias("round"), F.col("p_name").alias("players"), F.col("p_partkey").alias("pos"), (F.col("p_partkey") % 4 == 0).alias("full_match")
    )
    path = shared_path(spark, "export")
    fl.partitioned_export(rows.withColumn("round", F.lit("gone")), path)  # the next export replaces this one
    fl.partitioned_export(rows, path)
    return fl.read_export(spark, path, "pos long")


@query(f"{AFTER}, b AS (SELECT count(*) AS n FROM old), t(table_name, n) AS (SELECT 'matches', n FROM b UNION ALL SELECT 'participants', n FROM b UNION ALL SELECT 'players', 1 UNION ALL SELECT 'tournaments', 1 UNION ALL SELECT 'videos', n FROM b) SELECT table_name, n AS rows_before, 0 AS rows_after FROM t")
def truncate_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each table of the catalogue before and after all of them are emptied."""
    counts = lambda tables, name: [t.agg(F.lit(k).alias("table_name"), F.count("*").alias(name)) for k, t in tables.items()]
    before, after = (reduce(DataFrame.unionByName, c) for c in (counts(_before(spark, sf_dir), "rows_before"), counts(im.truncate_all(spark), "rows_after")))
    return before.join(after, "table_name")


@query(f"SELECT table_name, CAST(ordinal_position AS INT) AS ordinal, column_name, column_default AS default_value FROM information_schema.columns WHERE table_name IN ({', '.join(repr(t) for t in TABLES)})")
def list_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fl.list_columns({t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}).select("table_name", "ordinal", "column_name", "default_value")

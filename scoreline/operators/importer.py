"""Imports of match files into the catalogue: staging, replacement of what a video had, and summaries.

A catalogue is a dict of DataFrames keyed by natural keys: videos (video_id, title, upload_date, day,
processing_error), tournaments (tournament, year), matches (match_id, video_id, tournament, year,
video_offset_seconds, is_doubles), participants (match_id, player, side) and players (player).
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scoreline.functions import titles as tt
from scoreline.functions.text import parse_upload_epoch
from scoreline.sources.pointers import Folder
from scoreline.sources.scratch import written

SCHEMAS = {
    "tournaments": "tournament string, year int",
    "players": "player string",
    "videos": "video_id string, title string, upload_date timestamp, day string, processing_error string",
    "matches": "match_id string, video_id string, tournament string, year int, video_offset_seconds int, is_doubles boolean",
    "participants": "match_id string, player string, side string",
}


def truncate_all(spark: SparkSession) -> dict[str, DataFrame]:
    """The five tables, empty."""
    return {name: spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()}


def stage_videos(videos: DataFrame, run_ts: datetime, pos: str = "pos") -> DataFrame:
    """videos (video_id, video_title, upload_date text, matches, error, pos) parsed; of an id the last by pos counts.

    Adds tournament, year, day, err and uploaded, which is run_ts where the epoch can't be read.
    """
    others = [c for c in videos.columns if c != "video_id"]
    last = videos.groupBy("video_id").agg(F.max_by(F.struct(*others), pos).alias("_v")).select("video_id", "_v.*")
    uploaded = F.coalesce(parse_upload_epoch(F.col("upload_date")), F.lit(run_ts).cast("timestamp"))
    return tt.parse_stream_titles(last, "video_title").withColumn("uploaded", uploaded)


def import_policy(staged: DataFrame, policy: str = "quarantine") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): 'quarantine' sets bad titles aside, 'strict' fails on the first of them."""
    if policy == "strict":
        failing = F.when(F.col("err").isNotNull(), F.raise_error(F.concat(F.lit("bad title of "), "video_id")).cast("string"))
        return staged.withColumn("err", failing), staged.limit(0)
    return staged.filter("err IS NULL"), staged.filter("err IS NOT NULL")


def explode_matches(staged: DataFrame) -> DataFrame:
    """One row for each match of videos without an error, with its ordinal match_pos from 0."""
    rows = staged.filter(F.col("error").isNull()).select("video_id", "tournament", "year", F.posexplode("matches").alias("match_pos", "m"))
    return rows.select("video_id", "tournament", "year", "match_pos", "m.*")


def get_or_create(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """existing and those of incoming that it lacks; keys are all columns of existing."""
    keys = existing.columns
    return existing.unionByName(incoming.select(*keys).distinct().join(existing, keys, "left_anti"))


def upsert_video(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """videos after the import, with kind 'inserted', 'updated' or 'kept'."""
    new = incoming.select("video_id", *[F.col(c).alias(f"_{c}") for c in ("title", "upload_date", "day", "processing_error")], F.lit(True).alias("_new"))
    joined = existing.withColumn("_old", F.lit(True)).join(new, "video_id", "full")
    pick = lambda c: F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    kind = F.when(F.col("_new").isNull(), "kept").when(F.col("_old"), "updated").otherwise("inserted")
    return joined.select("video_id", *[pick(c) for c in ("title", "upload_date", "day", "processing_error")], kind.alias("kind"))


def set_clear_error(staged: DataFrame) -> DataFrame:
    """Rows of the videos table: the error of the import, or null where it went well."""
    return staged.select("video_id", F.col("video_title").alias("title"), F.col("uploaded").alias("upload_date"), "day", F.col("error").alias("processing_error"))


def participants_of(matches: DataFrame) -> DataFrame:
    """(match_id, player, side) of exploded matches, each once; a name without players is one empty name."""
    side = lambda c, s: F.transform(tt.split_players(F.coalesce(c, F.lit(""))), lambda n: F.struct(n.alias("player"), F.lit(s).alias("side")))
    both = F.concat(side("player1", "A"), side("player2", "B"))
    return matches.select(match_id(), F.explode(both).alias("_p")).select("match_id", "_p.*").distinct()


def match_id():
    return F.concat_ws("#", "video_id", F.col("match_pos").cast("string")).alias("match_id")


def import_matches(catalogue: dict[str, DataFrame], videos: DataFrame, run_ts: datetime, policy: str = "quarantine") -> dict[str, DataFrame]:
    """The catalogue after an import, and rejected.

    Tournaments are created for failed videos too; what a video had before goes in any case.
    """
    # Written once: every table of the catalogue is made from it.
    return import_staged(catalogue, written(stage_videos(videos, run_ts), "staged"), policy)


def import_staged(catalogue: dict[str, DataFrame], parsed: DataFrame, policy: str = "quarantine") -> dict[str, DataFrame]:
    """import_matches of videos that are parsed already."""
    staged, rejected = import_policy(parsed, policy)
    exploded = explode_matches(staged)
    new_matches = exploded.select(match_id(), "video_id", "tournament", "year", F.col("timestamp").cast("int").alias("video_offset_seconds"), F.coalesce(tt.is_doubles(F.col("player1"), F.col("player2")), F.lit(False)).alias("is_doubles"))
    new_people = participants_of(exploded)
    touched = staged.select("video_id")
    old = catalogue["matches"].join(touched, "video_id", "left_semi").select("match_id")
    return {
        "tournaments": get_or_create(staged, catalogue["tournaments"]),
        "players": get_or_create(new_people, catalogue["players"]),
        "videos": upsert_video(set_clear_error(staged), catalogue["videos"]).drop("kind"),
        "matches": catalogue["matches"].join(touched, "video_id", "left_anti").unionByName(new_matches),
        "participants": catalogue["participants"].join(old, "match_id", "left_anti").unionByName(new_people),
        "rejected": rejected.select("video_id", F.col("video_title").alias("title"), "err"),
    }


def import_summary(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """One row: videos, matches, singles and doubles after the import, and matches that went."""
    gone = before["matches"].select("match_id").join(after["matches"].select("match_id"), "match_id", "left_anti")
    counts = after["matches"].agg(F.count("*").alias("matches"), F.count_if(~F.col("is_doubles")).alias("singles"), F.count_if("is_doubles").alias("doubles"))
    return counts.crossJoin(after["videos"].agg(F.count("*").alias("videos"))).crossJoin(gone.agg(F.count("*").alias("deleted")))  # each side is one row


#: Hash parts of each table of a stored catalogue, and the column that they go by: an import reads and writes only those that it touches.
PARTS = 256
PART_KEY = {"tournaments": "tournament", "players": "player", "videos": "video_id", "matches": "video_id", "participants": "video_id"}


def part_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")


def touched_parts(rows: DataFrame, key: str) -> list[int]:
    """The parts that these rows fall into, PARTS at most."""
    return sorted(r["part"] for r in rows.select(part_of(F.col(key)).alias("part")).distinct().collect())


def save_import(folder: str, number: int, videos: DataFrame, run_ts: datetime, policy: str = "quarantine") -> None:
    """Imports videos into the stored catalogue at folder as version number, newer than all before; a repeat replaces it.

    A table's part stands in one folder, table/import=n-id/part=p, and the pointer of a version names the import that each
    part was last written by. So an import lists, reads and writes only the folders of parts that its videos, players and
    tournaments fall into, and a reader sees the version of one pointer. Folders that no pointer names any more are removed.
    """
    spark = videos.sparkSession
    store = Folder(spark, folder)
    now = store.newest(upto=number - 1) or {}
    parsed = written(stage_videos(videos, run_ts), "parsed")
    people = participants_of(explode_matches(parsed.filter("err IS NULL")))
    parts = {"videos": touched_parts(parsed, "video_id"), "tournaments": touched_parts(parsed.filter("err IS NULL"), "tournament"), "players": touched_parts(people, "player")}
    parts |= {name: parts["videos"] for name in ("matches", "participants")}
    before = {name: read_parts(spark, folder, name, now, parts[name]) for name in SCHEMAS}
    after = import_staged(before, parsed, policy)
    after["participants"] = after["participants"].join(after["matches"].select("match_id", "video_id"), "match_id")
    pointers, attempt = {name: dict(now.get(name, {})) for name in SCHEMAS}, f"{number}-{uuid.uuid4().hex}"
    for name, key in PART_KEY.items():
        place = f"{folder}/{name}/import={attempt}"
        rows = after[name].select(*columns_of(name), part_of(F.col(key)).alias("part"))
        # Rebalanced by part: small parts are one file each, a large one is split by size.
        rows.hint("rebalance", "part").write.partitionBy("part").parquet(place)
        held = [n.removeprefix("part=") for n in store.names(f"{name}/import={attempt}") if n.startswith("part=")]
        pointers[name] = {p: v for p, v in pointers[name].items() if int(p) not in parts[name]} | {p: attempt for p in held}
    store.point(number, pointers)
    remove_unnamed(store)


def remove_unnamed(store: Folder) -> None:
    """Removes all but the last pointers, and what earlier imports than the newest wrote and no pointer names any more."""
    store.forget()
    numbers = store.numbers()
    kept = [store.value(n) for n in numbers]
    for name in SCHEMAS:
        named = {(v, p) for pointer in kept for p, v in pointer.get(name, {}).items()}
        for place in store.names(name):
            attempt = place.removeprefix("import=")
            if int(attempt.split("-")[0]) < numbers[-1]:
                held = [n.removeprefix("part=") for n in store.names(f"{name}/{place}") if n.startswith("part=")]
                gone = [p for p in held if (attempt, p) not in named]
                for where in [place] if len(gone) == len(held) else [f"{place}/part={p}" for p in gone]:
                    store.remove(f"{name}/{where}")


def columns_of(name: str) -> list[str]:
    return [c.split()[0] for c in SCHEMAS[name].split(", ")]


def read_parts(spark: SparkSession, folder: str, name: str, pointer: dict, parts: list[int] | None = None) -> DataFrame:
    """A table as a pointer names it, or only these parts of it: no other folder is listed."""
    wanted = {p: v for p, v in pointer.get(name, {}).items() if parts is None or int(p) in set(parts)}
    if not wanted:
        return spark.createDataFrame([], SCHEMAS[name])
    return spark.read.schema(SCHEMAS[name]).parquet(*[f"{folder}/{name}/import={v}/part={p}" for p, v in sorted(wanted.items())])


def load_snapshot(spark: SparkSession, folder: str, upto: int | None = None, parts: list[int] | None = None) -> dict[str, DataFrame]:
    """The stored catalogue as its newest pointer names it, or the newest up to a version; empty tables where there is none.

    parts: then videos, matches and participants of these parts only. The frames can be read until KEEP more imports are done.
    """
    pointer = Folder(spark, folder).newest(upto) or {}
    return {name: read_parts(spark, folder, name, pointer, parts if PART_KEY[name] == "video_id" else None) for name in SCHEMAS}


def numbered_last_wins(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of rows with the same key the last by order."""
    window = Window.partitionBy(*key).orderBy(F.col(order).desc())
    return rows.withColumn("_n", F.row_number().over(window)).filter("_n = 1").drop("_n")

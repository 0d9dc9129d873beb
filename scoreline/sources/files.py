"""Files and tables that the engine reads and writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreline.functions.text import parse_duration
from scoreline.operators.importer import numbered_last_wins
from scoreline.sources.pointers import current_table, replace_table
from scoreline.sources.scratch import limit_batches
from scoreline.sources.tree import register

MATCH_FILE = "array<struct<video_id:string,video_title:string,upload_date:string,matches:array<struct<timestamp:int,player1:string,player2:string>>,error:string>>"
QUEUE = "channel string, pos int, video_id string, title string, upload_date string"


def match_videos(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """docs with the videos of each document, an array or one object, as rows with pos; err for empty ones."""
    read = docs.withColumn("_v", F.from_json(doc, MATCH_FILE))
    rows = read.select(*docs.columns, F.posexplode_outer("_v").alias("pos", "_x"))
    err = F.when(F.col("_x").isNull(), "no videos found")
    return rows.select(*[c for c in docs.columns if c != doc], F.coalesce("pos", F.lit(0)).alias("pos"), "_x.*", err.alias("file_err"))


def read_match_json(spark: SparkSession, path: str) -> DataFrame:
    """Match files in any folder under path, one JSON document each."""
    docs = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("value").alias("doc"), F.col("_metadata.file_path").alias("file"))
    return match_videos(docs)


def write_match_files(docs: DataFrame, path: str) -> None:
    """Replaces the tree at path: a file for each of docs' (folder, stem, doc), folder/stem.json."""
    register(docs.sparkSession)
    limit_batches(docs.sparkSession)
    docs.select("folder", "stem", "doc").write.format("scoreline_tree").mode("append").option("tree", path).save()


def ytdlp_lines(lines: DataFrame, line: str = "line", strict: bool = False) -> DataFrame:
    """Adds url, title, upload_date, duration_string, seconds and err to lines that hold a JSON object.

    Lines that aren't objects, can't be read or have no duration go; a malformed duration is an error: err, or,
    if strict, the query fails.
    """
    text = F.trim(line)
    kept = lines.filter((text != "") & text.startswith("{") & text.endswith("}"))
    read = kept.withColumn("_j", F.from_json(line, "url string, title string, upload_date string, duration_string string"))
    rows = read.select(*lines.columns, "_j.*").filter("coalesce(duration_string, '') <> ''").withColumn("seconds", parse_duration(F.col("duration_string")))
    bad = F.raise_error(F.concat(F.lit("bad duration "), "duration_string")).cast("string") if strict else F.lit("bad duration")
    return rows.withColumn("err", F.when(F.col("seconds").isNull(), bad))


def read_ytdlp_lines(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    return ytdlp_lines(spark.read.text(path).withColumnRenamed("value", "line"), strict=strict)


def read_expected_csv_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)


def read_table(spark: SparkSession, name: str, url: str | None = None, order: list[Column] | None = None, where: Column | None = None, split: str | None = None, parts: int = 8, **options) -> DataFrame:
    """A table of the catalog, or, with a JDBC url, of a database, filtered and in order.

    split, a column of numbers, dates or timestamps, lets the database be read in so many parts at once, between its least and
    greatest value, which the database is asked for. where reaches the database as far as its dialect can say it.
    """
    if url is None:
        table = spark.table(name)
    else:
        source = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
        if split:
            low, high = source.load().agg(F.min(split), F.max(split)).first()
            if low is not None:
                source = source.options(partitionColumn=split, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
        table = source.load()
    table = table.filter(where) if where is not None else table
    return table.orderBy(*order) if order else table


def save_queue(queue: DataFrame, path: str) -> None:
    """Makes queue the one at path, which it may have been read from: the old one stays until the new one is whole."""
    replace_table(queue.select("channel", "pos", "video_id", "title", "upload_date"), path)


def load_queue(spark: SparkSession, path: str) -> DataFrame:
    """The queue at path; empty where nothing is there. It can be read until two more have been saved."""
    return current_table(spark, path, QUEUE)


def export_paths(matches: DataFrame, order: str = "pos") -> DataFrame:
    """Adds folder and stem; of rows with the same path the last by order stays."""
    safe = lambda c: F.regexp_replace(F.regexp_replace(c, "/", " and "), "\\s+", " ")
    stem = F.concat(F.when(F.col("full_match"), "FULL_").otherwise(""), safe(F.col("players")))
    placed = matches.withColumns({"folder": F.concat_ws("/", safe(F.col("tournament")), safe(F.col("round"))), "stem": stem})
    return numbered_last_wins(placed, ["folder", "stem"], order)


def partitioned_export(matches: DataFrame, path: str, order: str = "pos") -> None:
    """Replaces the tree at path: one file for each match, tournament/round/stem.json, last of equal paths kept."""
    register(matches.sparkSession)
    rows = export_paths(matches, order)
    rows.select("folder", "stem", F.to_json(F.struct(*rows.columns)).alias("doc")).write.format("scoreline_tree").mode("append").option("tree", path).save()


def read_export(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(folder, stem, and the schema's columns) of a tree: folder and stem are where each file stands."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    inside = F.regexp_extract("path", "([^/]+/[^/]+)/([^/]+)[.]json$", 1), F.regexp_extract("path", "([^/]+)[.]json$", 1)
    return files.select(inside[0].alias("folder"), inside[1].alias("stem"), F.from_json(F.decode("content", "UTF-8"), schema).alias("_r")).select("folder", "stem", "_r.*")


def list_columns(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, ordinal, column_name, type, nullable, default_value) of the tables' schemas, by table and ordinal."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(t, i, f.name, f.dataType.simpleString(), f.nullable, f.metadata.get("CURRENT_DEFAULT")) for t in sorted(tables) for i, f in enumerate(tables[t].schema.fields, 1)]
    return spark.createDataFrame(rows, "table_name string, ordinal int, column_name string, type string, nullable boolean, default_value string")

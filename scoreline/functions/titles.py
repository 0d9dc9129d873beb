"""Titles of streams and recordings to columns, over whole tables; rows that can't be read carry err."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Categories of a match. Years that a title may name go from 2020 to 2100.
CATEGORIES = ["MS", "WS", "MD", "WD", "XD"]

_INTEGER = r"^[+-]?\d+$"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def title_parts(title: Column) -> Column:
    return F.transform(F.split(title, r"\|"), strip)


#: A word that is such a year, signed or not, and what stands before it.
_YEAR = r"(?:^|(?<=\s))\+?0*(20[2-9]\d|2100)(?=\s|$)"
_BEFORE_YEAR = rf"(?s)^(.*?){_YEAR}"
#: Parts of stream titles that don't count.
_ASIDE = r"^(?:LIVE!|T[+-]?\d+)$|Infinity"


def letters(parts: Column, letter) -> Column:
    """A text with one letter for each part: patterns over it find parts by their order and kind."""
    return F.array_join(F.transform(parts, letter), "")


def last_of(code: Column, kinds: str) -> Column:
    """The place of the last letter of these kinds, from 1; 0 where there is none."""
    return F.length(F.regexp_extract(code, rf"^(.*[{kinds}])", 1))


def parse_stream_titles(videos: DataFrame, title: str = "title") -> DataFrame:
    """Adds tournament, year, day and err. The title part is the first with a year; day and finals come from the others.

    Each part that counts becomes a letter from a to h: it has a year (4), a day (2), finals (1), or what adds up.
    """
    every = F.split(F.col(title), r"\|")
    kept = F.filter(F.transform(every, strip), lambda p: ~p.rlike(_ASIDE))
    bit = lambda test, value: F.when(test, value).otherwise(0)
    letter = lambda p: F.substring(F.lit("abcdefgh"), 1 + bit(p.rlike(_YEAR), 4) + bit(p.contains("Day"), 2) + bit(p.rlike("(?i)finals"), 1), F.lit(1))
    staged = videos.withColumns({"_n": F.size(every), "_kept": kept})
    staged = staged.withColumn("_code", letters(F.col("_kept"), letter))
    staged = staged.withColumn("_at", F.length(F.regexp_extract("_code", "^([a-d]*)", 1)) + 1)
    rest = F.overlay("_code", F.lit("a"), "_at")
    staged = staged.withColumns({"_part": F.try_element_at("_kept", "_at"), "_d": last_of(rest, "cdgh"), "_f": last_of(rest, "bdfh")})
    found = F.col("_at") <= F.length("_code")
    day_part, finals_part = (F.try_element_at("_kept", F.nullif(c, F.lit(0))) for c in ("_d", "_f"))
    finals = strip(F.regexp_replace(finals_part, r"(?i)\s*session\s*\d+", ""))
    after = F.coalesce(F.try_element_at("_kept", F.col("_at") + 1), F.lit(""))
    day = (
        F.when((F.col("_d") == 0) & (F.col("_f") == 0), after)
        .when(F.col("_f") == 0, day_part)
        .when((F.col("_d") == 0) | (F.col("_d") == F.col("_f")), finals)
        .otherwise(F.concat_ws(" ", day_part, finals))
    )
    err = F.when(F.col(title).isNull() | (F.col("_n") < 3), "too few parts").when(~found, "no year")
    good = err.isNull()
    return staged.withColumns(
        {
            "tournament": F.when(good, strip(F.regexp_replace(F.regexp_extract("_part", _BEFORE_YEAR, 1), r"\s+", " "))),
            "year": F.when(good, F.regexp_extract("_part", _BEFORE_YEAR, 2).try_cast("int")),
            "day": F.when(good, day),
            "err": err,
        }
    ).drop("_n", "_kept", "_code", "_at", "_part", "_d", "_f")


def parse_stream_titles_legacy(videos: DataFrame, title: str = "title") -> DataFrame:
    """Adds tournament (lower case), year and err from the fourth part, whose last word is the year."""
    parts = title_parts(F.col(title))
    fourth = words(F.try_element_at(parts, F.lit(4)))
    year = F.try_element_at(fourth, F.lit(-1))
    err = (
        F.when(F.col(title).isNull() | (F.size(parts) < 4), "too few parts")
        .when(F.size(fourth) < 1, "empty part")
        .when(~year.rlike(_INTEGER) | year.try_cast("int").isNull(), "no year")
    )
    name = F.lower(F.array_join(F.slice(fourth, F.lit(1), F.greatest(F.size(fourth) - 1, F.lit(0))), " "))
    return videos.withColumns({"tournament": F.when(err.isNull(), name), "year": F.when(err.isNull(), year.try_cast("int")), "err": err})


def parse_vod_titles(videos: DataFrame, title: str = "title") -> DataFrame:
    """Adds full_match, players, gender, round, tournament and err.

    Each part becomes a letter: f full match, v versus, c category with a round, s category alone, o any other. The
    first s or o ends the title; of what stands before it the last players and the last category count.
    """
    category = rf"^(?:{'|'.join(CATEGORIES)})"
    letter = lambda p: F.when(p == "FULL MATCH", "f").when(p.rlike(r"(?i)(?:^|\s)vs(?:\s|$)"), "v").when(p.rlike(category + r"\s"), "c").when(p.rlike(category + "$"), "s").otherwise("o")
    staged = videos.withColumn("_parts", title_parts(F.coalesce(title, F.lit(""))))
    staged = staged.withColumn("_code", letters(F.col("_parts"), letter))
    staged = staged.withColumn("_before", F.regexp_extract("_code", "^([fvc]*)", 1))
    before, ends = F.col("_before"), F.length("_before") + 1
    full, last = before.contains("f"), F.substring("_code", ends, F.lit(1))
    pick = lambda kind: F.try_element_at("_parts", F.nullif(last_of(before, kind), F.lit(0)))
    named = F.regexp_replace(F.try_element_at("_parts", ends), "#", "")
    err = (
        F.when(F.col("_code").rlike("^f?[cso]"), "no players")
        .when(last == "s", "no round")
        .when((last == "o") & ~before.contains("c") & (ends == F.when(full, 3).otherwise(2)), "no category")
        .when(last == "", "no tournament")
    )
    group = lambda k: F.coalesce(F.regexp_extract(pick("c"), r"^(\S+)\s+(\S+)", k), F.lit(""))
    columns = {"full_match": full, "players": F.coalesce(pick("v"), F.lit("")), "gender": group(1), "round": group(2), "tournament": F.when(named == "", "Unknown").otherwise(named)}
    read = staged.withColumn("_err", err).withColumns({name: F.when(F.col("_err").isNull(), c) for name, c in columns.items()})
    return read.withColumn("err", F.col("_err")).drop("_parts", "_code", "_before", "_err")


def split_players(names: Column) -> Column:
    """Names of a side: parts at '/', trimmed, without empty ones; a name without '/' stays one, even if empty."""
    return F.when(names.contains("/"), F.filter(F.transform(F.split(names, "/"), strip), lambda p: p != "")).otherwise(F.array(strip(names)))


def is_doubles(side_a: Column, side_b: Column) -> Column:
    return (F.size(split_players(side_a)) > 1) | (F.size(split_players(side_b)) > 1)


def parse_report(parsed: DataFrame, job: str) -> DataFrame:
    """(job, err_kind, rows): how many rows a parse accepted (err_kind 'ok') and rejected, by reason."""
    return parsed.groupBy(F.lit(job).alias("job"), F.coalesce("err", F.lit("ok")).alias("err_kind")).agg(F.count("*").alias("rows"))

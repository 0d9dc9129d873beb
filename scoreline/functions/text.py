"""Column functions for times, links, names and scoreboard text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreline.functions.titles import strip

#: Fixed values of the score rules.
EARLY_POINTS = 15
INCOMPLETE, UNREADABLE = "Incomplete score digits found", "Could not parse rows"


def parse_upload_epoch(text: Column) -> Column:
    """Epoch seconds as text to a UTC timestamp; null where it isn't a whole number."""
    return F.when(text.rlike(r"^[+-]?\d+$"), F.timestamp_seconds(text.try_cast("long")))


def parse_duration(text: Column) -> Column:
    """S, M:S or H:M:S to seconds. A lone piece must be a number; bad pieces of longer forms count 0; else null."""
    parts = F.split(text, ":")
    piece = lambda i: F.coalesce(F.when(F.get(parts, F.lit(i)).rlike(r"^[+-]?\d+(\.\d+)?$"), F.get(parts, F.lit(i)).try_cast("double")), F.lit(0.0))
    lone = F.when(text.rlike(r"^[+-]?\d+(\.\d+)?$"), text.try_cast("double"))
    return F.when(F.size(parts) == 1, lone).when(F.size(parts) == 2, piece(0) * 60 + piece(1)).when(F.size(parts) == 3, piece(0) * 3600 + piece(1) * 60 + piece(2))


def format_hms(seconds: Column) -> Column:
    """HH:MM:SS of whole seconds, cut toward zero."""
    s = seconds.cast("long")
    return F.when(s.isNotNull(), F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60))


def format_match_time(ts: Column) -> Column:
    return F.date_format(ts, "MMM dd, yyyy HH:mm")


def display_date(epoch_text: Column) -> Column:
    """YYYY-MM-DD of an epoch text; other text as it is."""
    return F.coalesce(F.date_format(parse_upload_epoch(epoch_text), "yyyy-MM-dd"), epoch_text)


def extract_video_id(url: Column) -> Column:
    """The id behind the last watch?v=, youtu.be/ or /live/; else the last path part without its query."""
    after = lambda mark: F.substring_index(url, mark, -1)
    return (
        F.when(url.contains("watch?v="), F.substring_index(after("watch?v="), "&", 1))
        .when(url.contains("youtu.be/"), F.substring_index(after("youtu.be/"), "?", 1))
        .when(url.contains("/live/"), F.substring_index(after("/live/"), "?", 1))
        .otherwise(F.substring_index(after("/"), "?", 1))
    )


def extract_video_id_regex(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?:v=|/)([0-9A-Za-z_-]{11}).*", 1)
    return F.when(found != "", found)


def normalize_name(name: Column) -> Column:
    return F.regexp_replace(F.upper(name), "[^A-Z0-9]", "")


def sanitize_name(name: Column) -> Column:
    """For image files: what isn't a word character or '-' becomes '_'; 20 characters."""
    return F.substring(F.regexp_replace(name, r"(?U)[^\w\-]", "_"), 1, 20)


def sanitize_title(name: Column) -> Column:
    """For folders: drops other characters, joins words by '-', without '-' and '_' at the ends; 100 characters."""
    plain = F.regexp_replace(F.regexp_replace(name, r"(?U)[^\w\s-]", ""), r"(?U)[-\s]+", "-")
    return F.substring(F.regexp_replace(plain, "^[-_]+|[-_]+$", ""), 1, 100)


def infer_tournament_type(name: Column) -> Column:
    # What a name must hold, in this order.
    kinds = [("Champions", "champions"), ("Smash", "smash"), ("Youth Contender", "youthContender"), ("Contender", "contender")]
    out = F.when(name.contains(kinds[0][0]), kinds[0][1])
    for text, kind in kinds[1:]:
        out = out.when(name.contains(text), kind)
    return out.otherwise("contender")


def match_title(team_a: Column, team_b: Column, video_title: Column) -> Column:
    both = F.when(team_a.isNotNull() & team_b.isNotNull(), F.concat(team_a, F.lit(" vs "), team_b))
    return F.coalesce(both, video_title, F.lit("Unknown Match"))


def match_timestamp(upload_date: Column, offset: Column) -> Column:
    return upload_date + F.make_dt_interval(secs=offset.cast("decimal(18,6)"))


def _row(text: Column) -> dict[str, Column]:
    """name, sets and points of one line of a scoreboard, with defaults for what is missing."""
    trimmed = strip(text)
    whole = r"^(.*?)(?:,\s*|\s+)(\d+(?:[^\d]*\d+)*)$"  # fixed: the shape of a row
    fits = trimmed.rlike(whole)
    numbers = F.when(fits, F.regexp_extract_all(F.regexp_extract(trimmed, whole, 2), F.lit(r"\d+"), 0)).otherwise(F.regexp_extract_all(trimmed, F.lit(r"\d+"), 0))
    first = F.get(numbers, F.lit(0))
    before = F.substring(trimmed, F.lit(1), F.length(trimmed) - F.length(F.call_function("substring_index", trimmed, first, F.lit(-1))) - F.length(first))
    cut = lambda name: F.regexp_replace(strip(name), ",+$", "")
    return {
        "name": F.when(fits, cut(F.regexp_extract(trimmed, whole, 1))).when(F.size(numbers) == 0, trimmed).otherwise(cut(before)),
        "sets": F.coalesce(first.try_cast("int"), F.lit(0)),
        "points": F.when(F.size(numbers) > 1, F.try_element_at(numbers, F.lit(-1)).try_cast("int")).otherwise(-1),
    }


def parse_scoreboard_text(texts: DataFrame, text: str = "text") -> DataFrame:
    """Adds success, player1, player2, set1, set2, game1, game2 and error."""
    t = F.col(text)
    # The patterns of both rows.
    one, two = F.regexp_extract(t, r"(?is)row 1:\s*(.*?)(?:\s*row 2|$)", 1), F.regexp_extract(t, r"(?is)row 2:\s*(.*?)$", 1)
    readable = t.rlike(r"(?is)row 1:\s*(.*?)(?:\s*row 2|$)") & t.rlike(r"(?is)row 2:\s*(.*?)$")
    staged = texts.withColumn("_ok", F.coalesce(readable, F.lit(False)))
    a, b = _row(one), _row(two)
    staged = staged.withColumns({f"_{side}{k}": v for side, row in (("a", a), ("b", b)) for k, v in row.items()})
    err = F.when(~F.col("_ok"), F.concat(F.lit(f"{UNREADABLE}: '"), F.coalesce(t, F.lit("")), F.lit("'"))).when((F.col("_apoints") < 0) | (F.col("_bpoints") < 0), INCOMPLETE)
    keep = lambda c: F.when(F.col("_ok"), F.col(c))
    return staged.withColumns(
        {
            "success": err.isNull(),
            "player1": keep("_aname"),
            "player2": keep("_bname"),
            "set1": keep("_asets"),
            "set2": keep("_bsets"),
            "game1": keep("_apoints"),
            "game2": keep("_bpoints"),
            "error": err,
        }
    ).drop("_ok", *[f"_{s}{k}" for s in "ab" for k in ("name", "sets", "points")])


def score_flags(board: DataFrame) -> DataFrame:
    """Adds is_match_start, is_game_start, is_early and total_points; needs success, set1, set2, game1, game2."""
    zero_sets, zero_points = "success AND set1 = 0 AND set2 = 0", "success AND game1 = 0 AND game2 = 0"
    flag = lambda text: F.coalesce(F.expr(text), F.lit(False))
    return board.withColumns(
        {
            "is_match_start": flag(f"{zero_sets} AND {zero_points}"),
            "is_game_start": flag(zero_points),
            "is_early": flag(f"{zero_sets} AND game1 + game2 <= {EARLY_POINTS}"),
            "total_points": F.when(F.col("success"), F.col("game1") + F.col("game2")).otherwise(-1),
        }
    )


def training_text(player1: Column, set1: Column, game1: Column, player2: Column, set2: Column, game2: Column) -> Column:
    return F.concat(F.lit("row 1: "), F.concat_ws(", ", player1, set1.cast("string"), game1.cast("string")), F.lit(" row 2: "), F.concat_ws(", ", player2, set2.cast("string"), game2.cast("string")))


def parse_log_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Adds kind ('sampling', 'variance' or null) and the fields of both shapes of log lines."""
    t = F.col(line)
    # The two shapes of log lines.
    sampling = r"Sampling at ([0-9:]+)\.\.\. Score: (.*) (\d+):(\d+) (.*), Game: (\d+):(\d+), (.*)$"
    variance = r"\[OCR_NAME_VARIANCE\] at ([0-9:]+): '(.*)' vs '(.*)' \(edit distance=1\), (.*)$"
    kind = F.when(t.rlike(sampling), "sampling").when(t.rlike(variance), "variance")
    pick = lambda i, j: F.when(kind == "sampling", F.regexp_extract(t, sampling, i)).when(kind == "variance", F.regexp_extract(t, variance, j) if j else None)
    number = lambda i: F.when(kind == "sampling", F.regexp_extract(t, sampling, i).try_cast("int"))
    return lines.withColumns({"kind": kind, "at": pick(1, 1), "name1": pick(2, 2), "name2": pick(5, 3), "set1": number(3), "set2": number(4), "game1": number(6), "game2": number(7), "path": pick(8, 4)})

"""Parsers on the fixtures of titles, texts and durations."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from scoreline.functions import text as fx
from scoreline.functions import titles as tt
from scoreline.functions.similarity import similar

#: A case for each rule: (title, tournament, year, day).
TITLES = [
    # The first part with a year names the tournament: the words before the year.
    ("Harbour Open 2024 | Court 1 | Day 2", "Harbour Open", 2024, "Day 2"),
    ("Court 1 | Day 2 | Harbour Open 2024 by Northwind", "Harbour Open", 2024, "Day 2"),
    ("Day 2 | 2031 | Harbour Open 2024", "", 2031, "Day 2"),
    ("a | b | Harbour Open +2024 replay", "Harbour Open", 2024, ""),
    # Years count from 2020 to 2100.
    ("Island Cup 2019 | Island Cup 2100 | x", "Island Cup", 2100, "x"),
    ("Island Cup 2101 | x | y", None, None, None),
    # Parts that are LIVE!, tables or an Infinity stage are left out, though they count as parts.
    ("LIVE! | Island Cup 2025 | T12", "Island Cup", 2025, ""),
    ("Infinity Hall 2030 | T3 | Island Cup 2025 | Day 7", "Island Cup", 2025, "Day 7"),
    # Without a day or finals the part after the tournament is the day.
    ("LIVE! | Island Cup 2025 | Warm-up | Court 2", "Island Cup", 2025, "Warm-up"),
    # Of several days, and several finals, the last counts.
    ("Day 1 | Island Cup 2025 | Day 3 night", "Island Cup", 2025, "Day 3 night"),
    ("quarterfinals | Island Cup 2025 | Semifinals SESSION 4", "Island Cup", 2025, "Semifinals"),
    # A day and finals are joined, unless one part is both; sessions go from finals only.
    ("Semifinals Session 2 | Day 5 | Island Cup 2025", "Island Cup", 2025, "Day 5 Semifinals"),
    ("Island Cup 2025 | Finals Day session 1 x | y", "Island Cup", 2025, "Finals Day x"),
    ("Day 4 Session 2 | Island Cup 2025 | z", "Island Cup", 2025, "Day 4 Session 2"),
    # Too few parts, no year, no title.
    ("Island Cup 2025 | Day 1", None, None, None),
    ("one | two | three", None, None, None),
    (None, None, None, None),
]


def test_stream_titles(spark):
    df = spark.createDataFrame([(i, t[0]) for i, t in enumerate(TITLES)], "i int, title string")
    got = tt.parse_stream_titles(df).orderBy("i").collect()
    assert [(r.title, r.tournament, r.year, r.day) for r in got] == TITLES
    assert [r.err is None for r in got] == [t[1] is not None for t in TITLES]
    report = {r.err_kind: r["rows"] for r in tt.parse_report(tt.parse_stream_titles(df), "titles").collect()}
    assert report == {"ok": 13, "too few parts": 2, "no year": 2}


@pytest.mark.parametrize(
    "title, want",
    [
        ("FULL MATCH | A vs B | MS R16 | Tour", (True, "A vs B", "MS", "R16", "Tour", None)),
        ("A VS B | WS QF | #Smash | more", (False, "A VS B", "WS", "QF", "Smash", None)),
        ("Highlights | MS F", (None, None, None, None, None, "no players")),
        ("FULL MATCH | MS F | Tour", (None, None, None, None, None, "no players")),
        ("A vs B | Tour", (None, None, None, None, None, "no category")),
        ("FULL MATCH | A vs B | Tour", (None, None, None, None, None, "no category")),
        ("A vs B | MS", (None, None, None, None, None, "no round")),
        ("A vs B | MS F | #", (False, "A vs B", "MS", "F", "Unknown", None)),
        ("A vs B | MS F", (None, None, None, None, None, "no tournament")),
    ],
)
def test_vod_titles(spark, title, want):
    row = tt.parse_vod_titles(spark.createDataFrame([(title,)], "title string")).first()
    assert (row.full_match, row.players, row.gender, row.round, row.tournament, row.err) == want


def test_scoreboard_texts(spark):
    broken, incomplete = "Could not parse rows: '{}'", "Incomplete score digits found"
    cases = [
        # Sets are the first number after the name, points the last.
        ("row 1: ADA LIND, 1, 7 row 2: BO CHAN, 0, 9", True, ("ADA LIND", 1, 7, "BO CHAN", 0, 9), None),
        ("ROW 1: A, 2, 3, 4\nROW 2: B, 0, 1", True, ("A", 2, 4, "B", 0, 1), None),
        ("row 1: A 2 3 4\nRow 2: B, 0 1", True, ("A", 2, 4, "B", 0, 1), None),
        # Digits that stick to a name stay in it.
        ("row 1: R2D 5, 0, 4 row 2: C3, 1, 10", True, ("R2D", 5, 4, "C3", 1, 10), None),
        # One number in either row is not enough, and no number even less.
        ("row 1: ADA, 3 row 2: BO, 1, 2", False, None, incomplete),
        ("row 1: ADA, 1, 2 row 2: BO", False, None, incomplete),
        # Both rows must be there.
        ("row 1: ADA, 1, 2", False, None, broken.format("row 1: ADA, 1, 2")),
        ("no rows", False, None, broken.format("no rows")),
        (None, False, None, broken.format("")),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, text string")
    for case, row in zip(cases, fx.parse_scoreboard_text(df).orderBy("i").collect()):
        assert (row.success, row.error) == (case[1], case[3]), case
        if case[2]:
            assert (row.player1, row.set1, row.game1, row.player2, row.set2, row.game2) == case[2]


def test_small_functions(spark):
    row = spark.range(1).select(
        fx.parse_upload_epoch(F.lit("1600000000")).cast("string").alias("epoch"),
        fx.parse_upload_epoch(F.lit("")).alias("blank"),
        fx.parse_upload_epoch(F.lit(" 1")).alias("spaced"),
        fx.display_date(F.lit("1768435200")).alias("shown"),
        fx.display_date(F.lit("not-a-number")).alias("raw"),
        F.array(*[fx.parse_duration(F.lit(d)) for d in ("59", "1.5", "2:03", "1:02:03", "x:5", "1:2:3:4", "x")]).alias("durations"),
        fx.format_hms(F.lit(3725.9)).alias("hms"),
        fx.extract_video_id(F.lit("https://a/watch?v=b&watch?v=c&t=1")).alias("vid"),
        fx.sanitize_title(F.lit("  -É_a: b -- c!_ ")).alias("folder"),
        F.array_join(tt.split_players(F.lit("A / B//")), "+").alias("players"),
    ).first()
    assert row.epoch == "2020-09-13 12:26:40" and row.blank is None and row.spaced is None
    assert (row.shown, row.raw) == ("2026-01-15", "not-a-number")
    assert row.durations == [59.0, 1.5, 123.0, 3723.0, 5.0, None, None]
    assert (row.hms, row.vid, row.folder, row.players) == ("01:02:05", "c", "É_a-b-c", "A+B")
    assert datetime(2026, 1, 15).strftime("%Y-%m-%d") == row.shown


def test_similarity_depends_on_length_and_order():
    assert similar("Ada Lind", "ADA-LIND") and similar("ABCDEFG", "ABCDEF") and not similar("ABCDEF", "ABCDE")
    assert similar("ABCDEFGHIJKLM", "ABCDEFXHIJKLM") and not similar("ABCDEFGHIJKL", "ABCDEFXHIJKL")
    assert not similar(None, "A")

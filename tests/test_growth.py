"""What must not grow faster than the input: timers and calls of states, cuts, passes over lines, batches."""

import os
import random

import numpy as np
from pyspark.sql import Row
from pyspark.sql import functions as F

from scoreline.operators import checks as ck
from scoreline.operators import importer as im
from scoreline.operators import scoreboard as sb
from scoreline.operators import search as se
from scoreline.plans import ORACLE, QUERIES, imports, streams
from scoreline.plans.adapters import frame
from scoreline.plans.titles import RUN_TS
from scoreline.streaming import jobs

DATA = "/root/testdata/sf0.001"


class State:
    """A list or a value, as a handle of a stateful processor gives it."""

    def __init__(self):
        self.held, self.calls = None, 0

    def get(self):
        self.calls += 1
        return self.held if self.held is not None else None if self.single else iter(())

    def exists(self):
        return self.held is not None

    def put(self, values):
        self.held, self.calls = list(values), self.calls + 1

    update = put

    def appendList(self, values):
        self.put([*(self.held or []), *values])

    def clear(self):
        self.held = None


class Handle:
    def __init__(self):
        self.timers, self.states = [], {}

    def state(self, name, single):
        self.states[name] = State()
        self.states[name].single = single
        return self.states[name]

    def getListState(self, name, schema):
        return self.state(name, False)

    def getMapState(self, name, keys, values):
        return self.state(name, False)

    def getValueState(self, name, schema):
        return self.state(name, True)

    def registerTimer(self, at):
        self.timers.append(at)


class Watermark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms

    getExpiryTimeInMs = getCurrentWatermarkInMs


def begun(processor):
    handle = Handle()
    processor.init(handle)
    return handle


def test_a_video_waits_for_one_timer_however_many_sessions_it_has():
    watch = jobs.WatchTime(1000)
    handle = begun(watch)
    rows = [Row(session=k, at=k * 1_000_000, position=k + 0.5) for k in range(200)] + [Row(session=7, at=7_000_000, position=9.9)]
    assert [r.watched_seconds for r in watch.handleInputRows(("v",), iter(rows), None)] == [sum(range(200)) + 2]
    assert handle.timers == [1000] and handle.states["sessions"].calls == 2
    list(watch.handleExpiredTimer(("v",), Watermark(100_000), Watermark(1000)))
    assert len(handle.states["sessions"].held) == 100 and handle.timers == [1000, 101_000]
    assert [r.watched_seconds for r in watch.handleInputRows(("v",), iter([Row(session=150, at=151_000_000, position=153.0)]), None)] == [sum(range(200)) + 5]


def test_samples_of_a_video_pass_at_one_timer():
    live = jobs.LiveTransitions(10_000)
    handle = begun(live)
    sample = lambda at, t, ok, a="A": Row(at=at, t=float(t), success=ok, actual_ts=float(t), player1=a if ok else None, player2="B" if ok else None, set1=0 if ok else None, set2=0 if ok else None)
    rows = [sample(k, 300 * k, k >= 50, "A" if k < 80 else "CCCC") for k in range(200)] + [sample(60, 1, True, "late")]
    assert list(live.handleInputRows(("v",), iter(rows), None)) == [] and handle.timers == [0]
    got = list(live.handleExpiredTimer(("v",), Watermark(99), Watermark(0)))
    assert [(r.lo, r.hi, r.kind, r.player1) for r in got] == [(0.0, 15_000.0, "score_appears", "A"), (79 * 300.0, 80 * 300.0, "player_change", "CCCC")]
    assert len(handle.states["waiting"].held) == 100 and handle.timers == [0, 100, 10_099]


class Clustered:
    """A session as that of a cluster: its tables come from the catalog, no database is begun."""

    class sparkContext:
        master = "spark://somewhere"

    def __init__(self, spark):
        self.spark = spark

    def __getattr__(self, name):
        return getattr(self.spark, name)


def test_videos_without_an_upload_date_are_read_too(spark):
    videos = frame(spark, DATA, "videos")
    got = streams.read_pg_table(Clustered(spark), DATA)
    assert videos.filter("upload_date = ''").count() > 0 and got.count() == videos.count()
    assert "upload_date <>" not in ORACLE["read_pg_table"]
    assert got.filter("uploaded IS NULL").count() == videos.filter("upload_date IN ('', 'not-a-number')").count()


def test_lines_are_read_once_however_many_images_there_are(spark, monkeypatch):
    rng = random.Random(5)
    text = lambda most: "".join(rng.choice("aab é𝄞/.") for _ in range(rng.randrange(most)))
    lines = [text(60) for _ in range(300)] + [None, ""]
    images = [text(5) for _ in range(60)] + [x[k : k + rng.randrange(1, 40)] for x in lines if x for k in [rng.randrange(len(x))]] + [None, ""]
    passes = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(line):
        passes.add(1)
        return line

    frame = lambda name, values: spark.createDataFrame([(v,) for v in values], f"{name} string").repartition(3)
    monkeypatch.setattr(ck, "BLOCK_PATHS", 20)
    monkeypatch.setattr(ck, "AT_ONCE", 500)
    # Without the empty image, which every line contains, lines are read once.
    for asked, most in ((images[:-1], len(lines)), (images, 2 * len(lines))):
        asked = [i for i in asked if i != "" or most > len(lines)]
        passes.value = 0
        got = sorted(map(tuple, ck.containing(frame("image", asked), frame("line", lines).select(read("line").alias("line"))).collect()))
        want = [(i, x) for i in {i for i in asked if i is not None} for x in lines if x is not None and i in x]
        assert got == sorted(want) and len(want) > 400
        assert passes.value <= 2 * most  # the filter and what it lets pass may each ask for the text


def test_transitions_sort_a_video_once_and_shuffle_nothing_by_names(spark):
    found = sb.transitions(frame(spark, DATA, "samples"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    after = plan[: plan.index("row_number")]  # what stands above the adapter's own window
    assert "Join" not in after and after.count(" Sort [") == 1


def test_batches_of_intervals_are_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(spark.conf.__class__, "set", lambda self, name, value, real=spark.conf.__class__.set: (seen.append(name), real(self, name, value))[1])
    board = frame(spark, DATA, "board")
    found = se.match_starts(board)
    assert "spark.sql.execution.arrow.maxBytesPerBatch" in seen
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()  # no call of Python for each video


def test_an_import_parses_its_videos_once(spark, tmp_path, monkeypatch):
    passes = []
    monkeypatch.setattr(im, "stage_videos", lambda videos, run_ts, real=im.stage_videos: (passes.append(1), real(videos, run_ts))[1])
    videos = spark.createDataFrame([("a", "Court 1 | Island Cup 2025 | Day 1", "1700000000", [(5, "X", "Y")], None, 0)], "video_id string, video_title string, upload_date string, matches array<struct<timestamp:int,player1:string,player2:string>>, error string, pos int")
    im.save_import(f"{tmp_path}/db", 0, videos, RUN_TS)
    assert len(passes) == 1 and im.load_snapshot(spark, f"{tmp_path}/db")["matches"].count() == 1


def test_match_files_stand_in_few_folders(spark, tmp_path):
    for name, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey"), ("part", "p_partkey")):
        table = spark.read.parquet(f"{DATA}/{name}.parquet")
        (table if name == "part" else table.filter(F.col(key) < 90).withColumn(key, F.col(key) * 500)).write.parquet(f"{tmp_path}/{name}.parquet")
    got = QUERIES["read_match_json"](spark, str(tmp_path))
    files = got.inputFiles()
    assert len(files) == 3 * 90 and len({os.path.dirname(f) for f in files}) == 3
    rows = {r.file: r for r in got.collect()}
    assert sorted(rows) == [k + f for k in (0, 1_000_000, 2_000_000) for f in range(90)] and got.count() == 3 * 90
    assert all(rows[f].video_id == rows[f + 2_000_000].video_id == f"v{500 * f}" and rows[f + 1_000_000].file_err == "no videos found" for f in range(90))


def test_matches_of_videos_are_shuffled_once(spark):
    plan = imports._videos(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(video_id") == 2  # the matches, and the videos that they join


def test_texts_that_pass_the_filters_weigh_less_than_the_lines(monkeypatch):
    """Filters as full as 20 million paths make them, beside a few long items of many lengths, as at 6 GB."""
    rng = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyz "
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    images = [f"out/u{rng.randrange(10**9)}-{k}.jpg" for k in range(20_000)] + [text(n) for n in range(81, 395, 2)]
    lines = [text(3000) for _ in range(300)] + [f"seen {i}.bak" for i in images[:50]] + [images[-1] + images[-1]]
    monkeypatch.setattr(ck, "MOST_BITS", 18)  # 13 bits for each path
    monkeypatch.setattr(ck, "LEAST_BITS", 1 << 14)
    counts = {}
    for i in images:
        counts[len(i)] = counts.get(len(i), 0) + 1
    classes = ck.classes_of(counts)
    assert sum(c.size for c in classes) <= (1 << 18) + (1 << 14) * len(classes)
    held = np.zeros(sum(2 * c.size for c in classes), np.uint8)
    held[ck.bits_of(images, classes)] = 1
    found = [(k, t) for owner, texts in ck.texts_like_images(lines, classes, np.packbits(held, bitorder="little")) for k, t in zip(owner.to_pylist(), texts.to_pylist())]
    assert {(k, t) for k, t in found if t in set(images)} == {(k, i) for k, x in enumerate(lines) for i in images if i in x}
    assert len(found) == len(set(found)) and sum(len(t) for _, t in found) < sum(map(len, lines)) / 20


def test_lines_stand_beside_no_image_until_the_end(spark, monkeypatch):
    frame = lambda name, values: spark.createDataFrame([(v,) for v in values], f"{name} string").repartition(3)
    tables = {}
    monkeypatch.setattr(ck, "written", lambda df, name="", *a, real=ck.written: (tables.update({name: df.columns}), real(df, name, *a))[1])
    for blocks in (100_000, 1):
        monkeypatch.setattr(ck, "BLOCK_PATHS", blocks)
        got = ck.log_contains_join(frame("image", ["a", "b", "none", None]), frame("line", ["a b", "Sampling at a", "b", "b", None]))
        assert sorted(map(tuple, got.collect()), key=repr) == [("a", "Sampling at a", True), ("b", "a b", False), ("b", "b", False), ("b", "b", False), ("none", None, None)]
        assert tables["contained"] == ["image", "number", "flag"]

"""Imports, queues, groups, files and streams on small fixtures."""

import json
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreline.functions import similarity as sm
from scoreline.functions.text import normalize_name
from scoreline.operators import catalog as ct
from scoreline.operators import checks as ck
from scoreline.operators import frames as fr
from scoreline.operators import importer as im
from scoreline.operators import playlists as pl
from scoreline.sources import files as fl
from scoreline.sources.pointers import KEEP, Folder
from scoreline.streaming import jobs

NOW = datetime(2026, 2, 1, 12)
TITLE = "Court 3 | Harbour Open 2026 | Day 1"


def record(vid, matches=(), title=TITLE, error=None, day=None):
    return {"video_id": vid, "video_title": title, "upload_date": "1768435200", "matches": [{"timestamp": t, "player1": a, "player2": b} for t, a, b in matches], **({"error": error} if error else {})}


def load(spark, *docs):
    return fl.match_videos(spark.createDataFrame([(json.dumps(d),) for d in docs], "doc string")).drop("file_err")


def test_imports_replace_and_keep_errors(spark):
    state = im.import_matches(im.truncate_all(spark), load(spark, record("a", [(90, "ada", "bo"), (4000, " ada / cy ", "di/ed")])), NOW)
    assert state["matches"].count() == 2 and state["participants"].count() == 6 and state["players"].count() == 5
    assert [r.is_doubles for r in state["matches"].orderBy("video_offset_seconds").collect()] == [False, True]
    # The same video again: its matches, day and players' places are replaced, its tournament is found.
    again = record("a", [(5, "ada/ada", "bo"), (6, "fay", "gil"), (7, "fay", "hal"), (8, "", "hal")], title=TITLE.replace("Day 1", "Day 2 | Semifinals Session 3"))
    state = im.import_matches(state, load(spark, [again]), NOW)
    assert state["matches"].count() == 4 and state["tournaments"].count() == 1
    assert state["participants"].filter("match_id = 'a#0' AND side = 'A'").count() == 1 and state["matches"].filter("match_id = 'a#0'").first().is_doubles
    assert state["videos"].first().day == "Day 2 Semifinals" and state["videos"].first().upload_date == datetime(2026, 1, 15)
    # An error clears what a video had; another video brings its tournament; a good import clears the error.
    state = im.import_matches(state, load(spark, record("a", error="no picture"), record("b", [(5, "fay", "gil")], title="Island Cup 2025 | Day 1 | Court 2")), NOW)
    assert state["matches"].count() == 1 and state["tournaments"].count() == 2
    assert {r.video_id: r.processing_error for r in state["videos"].collect()} == {"a": "no picture", "b": None}
    state = im.import_matches(state, load(spark, record("a", [(9, "fay", "gil")]), record("c", title="untold")), NOW)
    assert state["videos"].filter("video_id = 'a'").first().processing_error is None and state["rejected"].first().video_id == "c"


def test_strict_policy_fails(spark):
    staged = im.stage_videos(load(spark, record("c", title="bad title")), NOW)
    try:
        im.import_policy(staged, "strict")[0].collect()
    except Exception as error:
        assert "bad title of c" in str(error)
    else:
        raise AssertionError("a bad title must fail")


def test_stream_import_and_snapshots(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k, docs in enumerate([[record("a", [(1, "X", "Y")]), record("b", [(1, "X", "Y")])], record("a", [(1, "X", "Y"), (2, "X", "Z")]), []]):
        (tmp_path / "in" / f"{k}.json").write_text(json.dumps(docs))
        jobs.stream_import(spark, f"{tmp_path}/in", f"{tmp_path}/db", f"{tmp_path}/at", NOW).awaitTermination()
    state = im.load_snapshot(spark, f"{tmp_path}/db")
    assert {r.video_id: r["count"] for r in state["matches"].groupBy("video_id").count().collect()} == {"a": 2, "b": 1}
    assert im.load_snapshot(spark, f"{tmp_path}/nothing")["videos"].count() == 0


def test_imports_list_only_their_parts_and_old_versions_go(spark, tmp_path):
    folder, many = f"{tmp_path}/db", 5
    im.save_import(folder, 0, load(spark, *[record(f"v{k}", [(1, f"P{k}", "Q")]) for k in range(40)]), NOW)
    early = im.load_snapshot(spark, folder)
    files = lambda df: {f.split("/db/")[1].rsplit("/", 1)[0] for f in df.inputFiles()}
    everything = {name: len(early[name].inputFiles()) for name in early}
    for n in range(1, many + 1):
        im.save_import(folder, n, load(spark, record("v7", [(t, "P7", "Q") for t in range(n)]), record(f"new{n}", [])), NOW)
        if n == 2:
            assert early["matches"].count() == 40  # a reader keeps the version that it began with
    now = im.load_snapshot(spark, folder)
    assert now["matches"].filter("video_id = 'v7'").count() == many and now["videos"].count() == 40 + many and now["participants"].count() == 39 * 2 + many * 2
    assert now["players"].count() == 41 and now["tournaments"].count() == 1
    # Each part stands in one folder: files don't grow with the number of imports.
    assert all(len(now[name].inputFiles()) <= everything[name] + many for name in now)
    part = spark.range(1).select(im.part_of(F.lit("v7"))).first()[0]
    assert files(im.load_snapshot(spark, folder, parts=[part])["matches"]) == {x for x in files(now["matches"]) if x.endswith(f"part={part}")}
    assert len(im.load_snapshot(spark, folder, parts=[part])["matches"].inputFiles()) == 1
    held = [p for p in (tmp_path / "db" / "matches").iterdir() if any(x.name == f"part={part}" for x in p.iterdir())]
    assert len(held) <= KEEP and len(Folder(spark, folder).numbers()) == KEEP
    # A repeat of the last import, as after a crash, changes nothing.
    im.save_import(folder, many, load(spark, record("v7", [(t, "P7", "Q") for t in range(many)]), record(f"new{many}", [])), NOW)
    again = im.load_snapshot(spark, folder)
    assert again["matches"].count() == now["matches"].count() and again["videos"].count() == 40 + many


def test_stream_watch_time_equals_batch(spark, tmp_path):
    rows = [("v", 1, datetime(2026, 1, 1, 0, k), 10.7 * k) for k in range(4)] + [("v", 2, datetime(2026, 1, 2), 5.9), ("w", 3, datetime(2026, 1, 3), 7.2)]
    df = spark.createDataFrame(rows, "video_id string, session long, ts timestamp, position double")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    live = jobs.stream_watch_time(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
    live.writeStream.format("memory").queryName("watched").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    pick = lambda d: sorted(map(tuple, d.select("video_id", "watched_seconds").collect()))
    assert pick(spark.table("watched").distinct()) == pick(jobs.watch_time(df)) == [("v", 37), ("w", 7)]


def test_ended_sessions_leave_the_state(spark, tmp_path):
    """A session a day: totals go on as in the batch, while the state holds only the last sessions."""
    shape = "video_id string, session long, ts timestamp, position double"
    totals, every = {}, []

    def keep(batch, number):
        totals.update({r.video_id: r.watched_seconds for r in batch.collect()})

    for day in range(1, 7):
        rows = [("v", day * 10 + k, datetime(2026, 3, day, k + 1), 60.0 * day + k) for k in range(4)]
        every += rows
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        live = jobs.stream_watch_time(spark.readStream.schema(shape).parquet(f"{tmp_path}/in"))
        live.writeStream.foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/at").outputMode("update").trigger(availableNow=True).start().awaitTermination()
        assert totals == {r.video_id: r.watched_seconds for r in jobs.watch_time(spark.createDataFrame(every, shape)).collect()}
    left = spark.read.format("statestore").option("stateVarName", "sessions").load(f"{tmp_path}/at").collect()
    assert 4 <= len(left) <= 8 and sum(r.watched_seconds for r in jobs.watch_time(spark.createDataFrame(every, shape)).collect()) == totals["v"]


def test_stream_new_videos(spark, tmp_path):
    rows = [("a", "Day 1", datetime(2026, 1, 1)), ("a", "Day 1", datetime(2026, 1, 1)), ("b", "Draw ceremony", datetime(2026, 1, 1)), ("c", "Day 2", datetime(2026, 1, 1))]
    df = spark.createDataFrame(rows, "video_id string, title string, seen_at timestamp")
    df.write.parquet(f"{tmp_path}/in")
    fresh = jobs.stream_new_videos(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), spark.createDataFrame([("c",)], "video_id string"))
    fresh.writeStream.format("memory").queryName("fresh").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert [r.video_id for r in spark.table("fresh").collect()] == ["a"]


def queue(spark, *ids, channel="ch"):
    return spark.createDataFrame([(channel, k, i, t) for k, (i, t) in enumerate(ids, 1)], "channel string, pos int, video_id string, title string")


def test_queues(spark, tmp_path):
    old = queue(spark, ("B", "x"), ("C", "x"))
    both = pl.queue_prepend(queue(spark, ("A", "x")), old).orderBy("pos")
    assert [r.video_id for r in both.collect()] == ["A", "B", "C"]
    titles = [("1", "Morning SHOW"), ("2", "Day 2"), ("3", "showdown ceremony"), ("4", "FINALS with ceremony"), ("5", "Final show")]
    assert sorted(r.video_id for r in pl.filter_new_streams(queue(spark, *titles)).collect()) == ["2", "4"]
    assert [r.video_id for r in pl.filter_new_streams(queue(spark, *titles), "Day").collect()] == ["2"]
    assert [r.video_id for r in pl.filter_unprocessed(both, spark.createDataFrame([("B",)], "video_id string")).orderBy("pos").collect()] == ["A", "C"]
    none = spark.createDataFrame([], "channel string, cutoff string")
    assert pl.after_cutoff(both, none).count() == 0
    assert [r.video_id for r in pl.after_cutoff(both, spark.createDataFrame([("ch", "C")], "channel string, cutoff string")).orderBy("pos").collect()] == ["A", "B"]
    fl.save_queue(both.withColumn("upload_date", F.lit("1")), f"{tmp_path}/q")
    assert fl.load_queue(spark, f"{tmp_path}/q").count() == 3 and fl.load_queue(spark, f"{tmp_path}/none").count() == 0


def test_a_queue_is_saved_where_it_was_loaded(spark, tmp_path):
    path = f"{tmp_path}/q"
    fl.save_queue(queue(spark, ("A", "x")).withColumn("upload_date", F.lit("1")), path)
    for k in range(6):
        new = queue(spark, (f"N{k}", "x")).withColumn("upload_date", F.lit("1"))
        fl.save_queue(pl.queue_prepend(new, fl.load_queue(spark, path)), path)
    assert [r.video_id for r in fl.load_queue(spark, path).orderBy("pos").collect()] == ["N5", "N4", "N3", "N2", "N1", "N0", "A"]
    assert len(list((tmp_path / "q" / "tables").iterdir())) == KEEP and len(Folder(spark, path).numbers()) == KEEP
    # A frame that was loaded before the last save still finds its files.
    old = fl.load_queue(spark, path)
    fl.save_queue(old.filter("pos > 1"), path)
    assert old.count() == 7 and fl.load_queue(spark, path).count() == 6


def test_a_crash_leaves_the_old_queue(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/q"
    fl.save_queue(queue(spark, ("A", "x"), ("B", "x")).withColumn("upload_date", F.lit("1")), path)
    with monkeypatch.context() as m:
        m.setattr(Folder, "point", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            fl.save_queue(fl.load_queue(spark, path).filter("pos > 1"), path)
    assert fl.load_queue(spark, path).count() == 2
    broken = fl.load_queue(spark, path).withColumn("title", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        fl.save_queue(broken, path)
    assert fl.load_queue(spark, path).count() == 2
    fl.save_queue(fl.load_queue(spark, path).filter("pos > 1"), path)
    assert [r.video_id for r in fl.load_queue(spark, path).collect()] == ["B"]


def test_queue_advance(spark):
    rows = queue(spark, ("C", "Cup"), ("B", "Cup"), ("A", "Cup"))
    stays = lambda outcome, name="": [r.video_id for r in pl.queue_advance(rows, outcome, name).filter("stays").orderBy("pos").collect()]
    of = lambda vid, kind: F.when(F.col("video_id") == vid, kind).otherwise("ok")
    assert stays(F.lit("ok")) == [] and stays(of("B", "failed")) == ["B"] and stays(of("A", "import_failed")) == ["C", "B", "A"]
    assert stays(of("B", "import_failed")) == ["C", "B"] and stays(F.lit("ok"), "other") == ["C", "B", "A"]


def test_group_order(spark):
    """Groups by the latest moment of theirs, newest first; then by session, largest first; those without a moment last."""
    day = lambda d, h=9: datetime(2025, 3, d, h)
    rows = [("p", "Heats", None, day(2)), ("q", "Heats", None, day(8)), ("r", "Last four", 2, day(5, 20)), ("s", "Last four", 4, day(5, 20)), ("t", "Last four", 2, day(1)), ("u", "Repechage", 7, None), ("w", "Last four", None, day(4))]
    df = spark.createDataFrame([("Harbour Open", 2025, *r) for r in rows], "tournament string, year int, match_id string, day string, session int, effective_timestamp timestamp")
    got = ct.sort_groups(ct.matches_by_group(df)).orderBy("rank").collect()
    assert [r.group_key for r in got] == ["Heats", "Last four - Round 4", "Last four - Round 2", "Last four", "Repechage - Round 7"]


def test_lines_and_exports(spark, tmp_path):
    lines = ["", "WARNING {", '{"url":"u","title":"t","upload_date":"20260101","duration_string":"1:00"}', '{"url":"s","duration_string":""}', "{bad}", '{"url":"x","duration_string":"1:2:3:4"}']
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    assert sorted((r.url, r.seconds, r.err) for r in fl.ytdlp_lines(df).collect()) == [("u", 60.0, None), ("x", None, "bad duration")]
    rows = spark.createDataFrame([("T/1", "R", "A/B", True, 1), ("T/1", "R", "A/B", True, 2), ("T/1", "R", "A/B", False, 1)], "tournament string, round string, players string, full_match boolean, pos int")
    assert sorted((r.folder, r.stem, r.pos) for r in fl.export_paths(rows).collect()) == [("T and 1/R", "A and B", 1), ("T and 1/R", "FULL_A and B", 2)]
    assert tuple(fl.list_columns({"b": rows, "a": df}).first()) == ("a", 1, "line", "string", True, None)


def test_an_export_is_the_tree_of_its_rows(spark, tmp_path):
    shape, path = "tournament string, round string, players string, full_match boolean, pos int", tmp_path / "tree"
    rows = spark.createDataFrame([("T/1", "R 1", "A/B", True, 1), ("T/1", "R 1", "A/B", True, 2), ("T/1", "R 1", "É  vs B", False, 1), ("Cup", "F", "P vs Q", True, 5)], shape).repartition(3)
    listing = lambda: sorted(str(f.relative_to(path)) for f in path.rglob("*") if f.is_file())
    fl.partitioned_export(rows, str(path))
    assert listing() == ["Cup/F/FULL_P vs Q.json", "T and 1/R 1/FULL_A and B.json", "T and 1/R 1/É vs B.json"]
    assert json.loads((path / "T and 1/R 1/FULL_A and B.json").read_text())["pos"] == 2
    assert sorted(map(tuple, fl.read_export(spark, str(path), "pos int").collect()))[0] == ("Cup/F", "FULL_P vs Q", 5)
    # An export that fails leaves the tree as it was; one that works takes away what is gone.
    with pytest.raises(Exception, match="broken"):
        fl.partitioned_export(rows.withColumn("round", F.when(F.col("pos") == 5, F.raise_error(F.lit("broken"))).otherwise("X")), str(path))
    assert len(listing()) == 3
    fl.partitioned_export(rows.filter("pos = 5"), f"file://{path}")
    assert listing() == ["Cup/F/FULL_P vs Q.json"]
    fl.partitioned_export(rows.limit(0), str(path))
    assert listing() == [] and sorted(x.name for x in tmp_path.iterdir()) == ["tree"]


def test_tables_of_a_database_are_read_in_parts_with_the_filter_pushed(spark):
    url = "jdbc:derby:memory:reads;create=true"
    spark.range(1000).select("id", F.concat(F.lit("v"), "id").alias("name")).write.format("jdbc").options(url=url, dbtable="things", createTableColumnTypes="name VARCHAR(20)").save()
    got = fl.read_table(spark, "things", url, order=[F.col("id").desc()], where=F.col("name") >= "v98", split="id", parts=4)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "v98" in plan.split("PushedFilters")[1]
    assert got.rdd.getNumPartitions() >= 1 and [r.id for r in got.collect()] == [999 - k for k in range(20)] + [99, 98]
    assert fl.read_table(spark, "things", url, split="id", parts=4).rdd.getNumPartitions() == 4
    assert fl.read_table(spark, "things", url, where=F.col("name") == "none", split="id").count() == 0


def test_lines_contain_paths_inside_longer_ones(spark, monkeypatch):
    images = ["out/a.jpg", "out/a.jpg.bak", "a", "é/x.jpg", "none.jpg", "", None, "out/a.jpg"]
    lines = ["see out/a.jpg.bak", "Sampling at out/a.jpg", "OCR_NAME_VARIANCE é/x.jpg!", "xé/x.jpgx", "plain", None, "", "out/a.jpg out/a.jpg"]
    frame = lambda name, values: spark.createDataFrame([(v,) for v in values], f"{name} string").repartition(3)
    want = {(i, x) for i in images if i is not None for x in lines if x is not None and i in x}
    for blocks in (100_000, 2):
        monkeypatch.setattr(ck, "BLOCK_PATHS", blocks)
        assert sorted(map(tuple, ck.containing(frame("image", images), frame("line", lines)).collect())) == sorted(want)
    best = {(r.image, r.line): r.preferred for r in ck.log_contains_join(frame("image", images), frame("line", lines)).collect()}
    assert [k for k in best if k[0] == "out/a.jpg"] == [("out/a.jpg", "Sampling at out/a.jpg")] and best["out/a.jpg.bak", "see out/a.jpg.bak"] is False
    assert best["none.jpg", None] is None and [k[1] for k in best if k[0] == "é/x.jpg"] == ["OCR_NAME_VARIANCE é/x.jpg!"]


def test_only_undecided_names_reach_the_ratio(spark):
    rng = random.Random(8)
    names = ["".join(rng.choice("ABCDEFG ") for _ in range(rng.randrange(0, 30))) for _ in range(60)] + ["ADA LINDQVIST", "ada-lindqvist", "ADA LINDQVISTX", "ADA LINDQVIST XYZ", "LINDQVIST ADA", None, "É", ""]
    names += [n[:-1] + rng.choice("ABX") for n in names[:60] if n]
    rows = [(a, b) for a in names for b in names]
    df = spark.createDataFrame(rows * 2, "a string, b string").repartition(3)
    got = {(r.a, r.b): r.same for r in sm.with_similar(df, {"same": (F.col("a"), F.col("b"))}).collect()}
    assert got == {(a, b): sm.similar(a, b) for a, b in rows} and sum(got.values()) > len(names)
    keyed = df.select(normalize_name(F.col("a")).alias("x"), normalize_name(F.col("b")).alias("y"))
    asked = sm.open_pairs(keyed, [("x", "y")]).collect()
    assert len(asked) == len({tuple(r) for r in asked}) < len(rows) / 20 and all(r.x != r.y for r in asked)
    assert sm.with_similar(df, {"same": (F.col("a"), F.col("b"))}).count() == 2 * len(rows)


@pytest.mark.parametrize("kind", ["walk", "still", "jumps", "mixed"])
def test_long_videos_are_folded_in_chunks(spark, kind):
    """Random walks, still pictures and jumps: what is kept equals going through all frames in order."""
    rng, rows, want = np.random.default_rng(5), [], {}
    for video in ("a", "b", "c"):
        n = int(rng.integers(150, 260))
        step = {"walk": 0.9, "still": 0.001, "jumps": 9.0, "mixed": 0.9}[kind]
        moves = rng.normal(0, step, (n, 4))
        if kind == "mixed":
            moves[: n // 2] = 0
        vectors, anchor = moves.cumsum(axis=0), None
        for k, v in enumerate(vectors):
            want[video, k] = anchor is None or bool(np.abs(v - anchor).mean() > 3.0)
            anchor = v if want[video, k] else anchor
        rows += [(video, k, v.tolist()) for k, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "video_id string, sec int, vec array<double>").repartition(3)
    got = {(r.video_id, r.sec): r.kept for r in fr.anchor_dedup(df, span=20).collect()}
    assert got == want and fr.anchor_dedup(df.limit(0), span=20).count() == 0


def test_frames(spark):
    vecs = [[0.0, 0.0], [2.0, 2.0], [3.5, 3.5], [4.0, 4.0], [9.0, 9.0]]
    df = spark.createDataFrame([("v", k, v) for k, v in enumerate(vecs)], "video_id string, sec long, vec array<double>")
    assert [r.kept for r in fr.anchor_dedup(df).orderBy("sec").collect()] == [True, False, True, False, True]
    cache = spark.createDataFrame([("v", 0, "known")], "video_id string, frame long, text string")
    got = fr.frames_to_scoreboard(df, lambda vec: F.concat(F.lit("read "), vec[0].cast("string")), cache).orderBy("sec").collect()
    assert [r.text for r in got] == ["known", "known", "read 3.5", "read 3.5", "read 9.0"]

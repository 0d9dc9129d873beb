"""The batched search for match starts against a plain sequential one, and streams against batches."""

import random

import pytest
from pyspark.sql import functions as F

from scoreline.functions.similarity import same_players
from scoreline.operators import scoreboard as sb
from scoreline.operators import search as se
from scoreline.streaming import jobs

BOARD = "video_id string, sec int, success boolean, player1 string, player2 string, set1 int, set2 int, game1 int, game2 int"
NAMES = ["ADA LINDQVIST", "BRUNO OKAFOR", "CHI-MEI TANAKA", "DORA PELLEGRINI", "EMIL VARGAS", "FARAH NASSER", "GUSTAV HOLM", "HANA KOVACS"]


def video(rng, vid):
    """Matches with scores that advance, breaks, drop-outs, name noise and sometimes a rematch."""
    rows, sec, pair = [], rng.randrange(0, 900), None
    for _ in range(rng.randrange(0, 4)):
        pair = pair if pair and rng.random() < 0.15 else rng.sample(NAMES, 2)
        sets, points = [0, 0], [0, 0]
        for _ in range(rng.randrange(20, 160)):
            for _ in range(rng.randrange(8, 24)):
                if rng.random() > 0.08:
                    names = [n + ("X" if rng.random() < 0.02 else "") for n in pair]
                    rows.append((vid, sec, True, *names, *sets, *points))
                sec += 1
            if rng.random() < 0.1:
                sec += rng.randrange(1, 20)
            k = rng.randrange(2)
            points[k] += 1
            if points[k] >= 11 and points[k] - points[1 - k] > 1:
                sets[k] += 1
                points = [0, 0]
        sec += rng.choice([5, 60, 200, 400, 900])
    return rows or [(vid, sec, False, None, None, -1, -1, -1, -1)]


def sequential(rows):
    """The same search, one video at a time."""
    seen = {r[1]: r for r in rows if r[2]}
    duration = max(r[1] for r in rows) + 10

    def probe(t):
        for off in (0, 5, -5, 10):
            if (hit := seen.get(int(t + off))) is not None:
                return hit, t + off
        return None, t

    early = lambda r: r[5] == r[6] == 0 and r[7] + r[8] <= 15
    kept = []

    def add(start, pair):
        if not any(same_players(pair, p) or abs(s - start) < 300 for s, p in kept):
            kept.append((start, pair))

    samples = [probe(t) for t in range(0, duration, 180)]
    for r, ts in samples:
        if r and r[5] == r[6] == r[7] == r[8] == 0:
            add(ts, r[3:5])
    for i in range(1, len(samples)):
        (p, p_ts), (c, c_ts) = samples[i - 1 : i + 1]
        if not c:
            continue
        lo = p_ts
        if not p:
            for r, ts in reversed(samples[: i - 1]):
                if r:
                    break
                lo = ts
            if c_ts - lo < 300:
                continue
        elif same_players(p[3:5], c[3:5]) and c[5] + c[6] >= p[5] + p[6]:
            continue
        best, first, a, b = None, (c_ts, c) if early(c) else None, lo, c_ts
        while b - a > 10:
            mid = (a + b) / 2
            r, ts = probe(mid)
            if r and r[5] == r[6] == r[7] == r[8] == 0:
                best, b = (ts, r[3:5]), mid
            elif r:
                if early(r) and (first is None or ts < first[0]):
                    first = (ts, r)
                b = mid
            else:
                a = mid
        if best is None and first is not None:
            best = (max(0, first[0] - 16 * (first[1][7] + first[1][8])), first[1][3:5])
        if best:
            add(*best)
    return sorted((float(s), *p) for s, p in kept)


@pytest.fixture(scope="module")
def boards():
    rng = random.Random(4)
    return {f"v{i}": video(rng, f"v{i}") for i in range(14)}


def test_match_starts_equal_the_sequential_search(spark, boards):
    board = spark.createDataFrame([r for rows in boards.values() for r in rows], BOARD)
    got = {v: [] for v in boards}
    for r in se.match_starts(board).collect():
        if r.start is not None:
            got[r.video_id].append((r.start, r.player1, r.player2))
        else:
            assert r.error == "No match starts found"
    assert {v: sorted(x) for v, x in got.items()} == {v: sequential(rows) for v, rows in boards.items()}
    assert sum(map(len, got.values())) > 8


def drain(stream, tmp_path, name="out"):
    """Runs the stream over what is there, and returns the progress of its batches."""
    q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/{name}").option("checkpointLocation", f"{tmp_path}/{name}-at").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return q.recentProgress


def test_stream_transitions_equal_batch(spark, boards, tmp_path):
    """Samples come in files dealt at random within the delay; one that is later than that is dropped and counted."""
    board = spark.createDataFrame([r for rows in boards.values() for r in rows], BOARD)
    samples = sb.coarse_scan(board).withColumn("seen_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("t"))).cache()
    shape = samples.schema
    flush = lambda at: samples.limit(1).withColumns({"video_id": F.lit("end"), "seen_at": F.timestamp_seconds(F.lit(at))})
    slot = F.floor((F.col("t") + F.pmod(F.xxhash64("t", "video_id"), F.lit(900))) / 1800)  # up to 900 s late
    progress = []
    for k in range(3):
        samples.filter(slot == k if k < 2 else slot >= 2).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        progress += drain(jobs.stream_transitions(spark.readStream.schema(shape).parquet(f"{tmp_path}/in"), delay="30 minutes"), tmp_path)
    flush(2_000_000_000).write.mode("append").parquet(f"{tmp_path}/in")
    progress += drain(jobs.stream_transitions(spark.readStream.schema(shape).parquet(f"{tmp_path}/in"), delay="30 minutes"), tmp_path)
    pick = lambda df: sorted((r.video_id, r.lo, r.hi, r.kind) for r in df.collect())
    want = pick(sb.transitions(samples))
    assert len(want) > 5 and pick(spark.read.parquet(f"{tmp_path}/out")) == want
    dropped = lambda p: sum(o["numRowsDroppedByWatermark"] for x in p for o in x["stateOperators"])
    assert dropped(progress) == 0
    # Much later nothing of silent videos is left, and a row of the past is dropped and counted.
    samples.limit(5).union(flush(2_100_000_000)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    late = drain(jobs.stream_transitions(spark.readStream.schema(shape).parquet(f"{tmp_path}/in"), delay="30 minutes"), tmp_path)
    assert dropped(late) == 5 and pick(spark.read.parquet(f"{tmp_path}/out")) == want
    state = spark.read.format("statestore").option("stateVarName", "last").load(f"{tmp_path}/out-at")
    assert {r.key.video_id for r in state.collect()} == {"end"}


def test_grid_guards(spark):
    lengths = spark.createDataFrame([("a", 0), ("b", -5), ("c", 180), ("d", 181)], "video_id string, duration int")
    assert sorted((r.video_id, r.t) for r in sb.sample_grid(lengths).collect()) == [("c", 0), ("d", 0), ("d", 180)]


def test_short_gap_hides_a_change_and_is_reported(spark):
    rows = [("v", s, True, "A", "B", 0, 0, 1, 1) for s in range(0, 181)] + [("v", s, True, "C", "D", 1, 0, 3, 3) for s in range(500, 600)]
    board = spark.createDataFrame(rows, BOARD)
    samples = sb.coarse_scan(board)
    assert sb.transitions(samples.filter("t <= 540")).count() == 1 - (540 - 360 < 300)
    starts = se.match_starts(board)
    assert [(r.player1, r.player2) for r in se.skipped_pairs(samples, starts).collect()] == [(r.player1, r.player2) for r in se.distinct_pairs(samples).collect() if (r.player1, r.player2) not in {(x.player1, x.player2) for x in starts.collect()}]


def test_wide_intervals_are_searched_until_they_are_narrow(spark):
    begin = 200_003
    rows = [("v", 0, False, None, None, -1, -1, -1, -1)] + [("v", s, True, "A", "B", 0, 0, s > begin + 40, 0) for s in range(begin, begin + 400)]
    board = spark.createDataFrame([(*r[:7], int(r[7]), r[8]) for r in rows], BOARD)
    got = se.bisect_starts(sb.transitions(sb.coarse_scan(board)), board).collect()
    assert [r.hi - r.lo > 40_960 for r in got] == [True]
    assert not got[0].approximate and abs(got[0].start - begin) <= 10


def test_a_month_of_one_video_is_spread_and_joined_by_buckets(spark):
    """A match every two hours for 30 days, each second seen; breaks of ten minutes."""
    length, days = 7200, 30
    k, at = (F.col("id") / length).cast("long"), F.col("id") % length
    who = lambda shift: F.concat(F.lit("PLAYER "), F.substring(F.md5((k * 2 + shift).cast("string")), 1, 12))
    points = F.least(F.floor(at / 30), F.lit(19)).cast("int")
    board = spark.range(days * 86_400).filter(at < length - 600).select(F.lit("v").alias("video_id"), F.col("id").cast("int").alias("sec"), F.lit(True).alias("success"), who(0).alias("player1"), who(1).alias("player2"), F.when(at < 3000, 0).otherwise(1).alias("set1"), F.lit(0).alias("set2"), points.alias("game1"), F.lit(0).alias("game2"))
    found = se.bisect_starts(sb.transitions(sb.coarse_scan(board)), board)
    plan = found._jdf.queryExecution().executedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join" in x and "bucket" in x]
    assert joins and all("sec#" not in x for x in joins)  # nothing is compared but video and bucket
    starts = sorted(r.start for r in found.collect() if not r.approximate)
    begun = [m * length for m in range(1, days * 86_400 // length)]
    assert all(any(abs(s - b) <= 40 for s in starts) for b in begun)


def test_missing_scores_and_empty_intervals(spark):
    """Null points and sets count as no score; an interval without seconds gives what its end says."""
    board = spark.createDataFrame([("v", s, True, "A", "B", None if s < 300 else 0, 0, None if s < 400 else 0, 0) for s in range(200, 500)] + [("w", 5, False, None, None, -1, -1, -1, -1)], BOARD)
    ends = spark.createDataFrame([("v", 0.0, 600.0, "A", "B", 0, 0, 2, 1), ("w", 100.0, 400.0, "C", "D", 0, 0, 3, 1), ("w", 100.0, 400.0, "E", "F", 2, 1, 3, 1)], "video_id string, lo double, hi double, player1 string, player2 string, set1 int, set2 int, game1 int, game2 int")
    got = {(r.video_id, r.player1): (r.start, r.approximate) for r in se.bisect_starts(ends, board).collect()}
    assert set(got) == {("v", "A"), ("w", "C")} and got["w", "C"] == (336.0, True)
    assert not got["v", "A"][1] and 400 <= got["v", "A"][0] <= 415

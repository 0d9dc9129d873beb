"""Queries over scoreboards, frames and checks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreline.functions.similarity import with_same_pair, with_similar
from scoreline.functions.text import training_text
from scoreline.operators import checks as ck
from scoreline.operators import frames as fr
from scoreline.operators import scoreboard as sb
from scoreline.operators import search as se
from scoreline.plans.adapters import frame
from scoreline.plans.registry import query
from scoreline.sources import files as fl
from scoreline.sources.scratch import shared_path

FIELDS = ", ".join(sb.FIELDS)
GRID = "len AS (SELECT video_id, max(sec) + 10 AS duration FROM {board} GROUP BY video_id), grid AS (SELECT video_id, CAST(unnest(range(0, duration, 180)) AS BIGINT) AS t FROM len)"
PROBED = f"""{GRID}, asked AS (SELECT video_id, t, ord, t + off AS at FROM grid CROSS JOIN (VALUES (0, 0), (1, 5), (2, -5), (3, 10)) o(ord, off)),
hits AS (SELECT a.video_id, a.t, a.ord, a.at, {", ".join("b." + f for f in sb.FIELDS)}, row_number() OVER (PARTITION BY a.video_id, a.t ORDER BY a.ord) AS n FROM asked a JOIN {{board}} b ON a.video_id = b.video_id AND a.at = b.sec AND b.success),
probed AS (SELECT g.video_id, CAST(g.t AS DOUBLE) AS t, h.video_id IS NOT NULL AS success, CAST(coalesce(h.at, g.t) AS DOUBLE) AS actual_ts, {FIELDS} FROM grid g LEFT JOIN hits h ON g.video_id = h.video_id AND g.t = h.t AND n = 1)"""


@query(f"WITH {GRID} SELECT video_id, t FROM grid")
def sample_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sb.sample_grid(sb.durations(frame(spark, sf_dir, "board")))


@query(f"WITH {PROBED} SELECT * FROM probed")
def probe_scoreboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    board = frame(spark, sf_dir, "board")
    return sb.probe_scoreboard(sb.sample_grid(sb.durations(board)), board)


@query(f"WITH {PROBED} SELECT * FROM probed")
def coarse_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sb.coarse_scan(frame(spark, sf_dir, "board"))


#: Names of the samples are alike only if they are equal but for a last X.
RUNS = """r AS (SELECT *, sum(CAST(success AS INT)) OVER (PARTITION BY video_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM {samples}),
r2 AS (SELECT *, min(CASE WHEN NOT success THEN actual_ts END) OVER (PARTITION BY video_id, run) AS st FROM r),
p AS (SELECT *, lag(success) OVER w AS ps, lag(actual_ts) OVER w AS pt, lag(st) OVER w AS pst, lag(player1) OVER w AS p1, lag(player2) OVER w AS p2, lag(set1) OVER w + lag(set2) OVER w AS psets,
  lag(game1) OVER w AS pg1, lag(game2) OVER w AS pg2 FROM r2 WINDOW w AS (PARTITION BY video_id ORDER BY t))"""
SAME = "(regexp_replace(p1, 'X$', '') = regexp_replace(player1, 'X$', '') AND p2 = player2) OR (regexp_replace(p1, 'X$', '') = player2 AND p2 = regexp_replace(player1, 'X$', ''))"
FOUND = f"""{RUNS}, f AS (SELECT *, CASE WHEN NOT ps AND success THEN CASE WHEN actual_ts - pst >= 300 THEN 'score_appears' END
  WHEN ps AND success AND NOT ({SAME}) THEN 'player_change' WHEN ps AND success AND set1 + set2 < psets THEN 'set_reset' END AS kind FROM p)"""


@query(f"WITH {RUNS} SELECT video_id, pst AS run_start, actual_ts AS end_ts, actual_ts - pst AS gap, actual_ts - pst >= 300 AS is_break FROM p WHERE success AND NOT ps")
def no_score_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sb.no_score_runs(frame(spark, sf_dir, "samples"))


@query(f"WITH {FOUND} SELECT video_id, CASE WHEN kind = 'score_appears' THEN pst ELSE pt END AS lo, actual_ts AS hi, kind, {FIELDS} FROM f WHERE kind IS NOT NULL")
def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sb.transitions(frame(spark, sf_dir, "samples"))


@query(
    f"""WITH {RUNS}, s AS (SELECT video_id, actual_ts AS at, 1 AS slot, p1 AS before, player1 AS after FROM p WHERE success AND ps UNION ALL SELECT video_id, actual_ts, 2, p2, player2 FROM p WHERE success AND ps)
SELECT * FROM s WHERE levenshtein(upper(before), upper(after)) = 1"""
)
def name_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sb.name_variance(frame(spark, sf_dir, "samples"))


@query(f"WITH {RUNS} SELECT video_id, actual_ts, player1, player2 FROM p WHERE success AND game1 = 0 AND game2 = 0 AND NOT coalesce(ps AND pg1 = 0 AND pg2 = 0, false)")
def game_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sb.game_starts(frame(spark, sf_dir, "samples"))


def _golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoreboards as JSON maps, with blank, incomplete and null entries."""
    value = F.struct(F.when(F.col("success"), F.col("player1")).otherwise("").alias("player1"), F.when(F.col("success"), F.col("player2")).otherwise(" ").alias("player2"), F.col("set1").alias("p1_sets"), F.when(F.col("set2") != 2, F.col("set2")).alias("p2_sets"), F.when(F.col("game1") == 7, -1).otherwise(F.col("game1")).alias("p1_points"), F.col("game2").alias("p2_points"))
    doc = F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("sec").cast("string"), F.when(F.col("sec") % 5 != 4, value)))))
    return frame(spark, sf_dir, "board").groupBy("video_id").agg(doc.alias("doc"))


@query(
    """SELECT video_id, sec, sec % 5 <> 4 AND success AND game1 <> 7 AS success, CASE WHEN sec % 5 <> 4 THEN CASE WHEN success THEN player1 ELSE '' END END AS player1, CASE WHEN sec % 5 <> 4 THEN CASE WHEN success THEN player2 ELSE ' ' END END AS player2,
CASE WHEN sec % 5 <> 4 THEN set1 ELSE -1 END AS set1, CASE WHEN sec % 5 <> 4 AND set2 <> 2 THEN set2 ELSE -1 END AS set2, CASE WHEN sec % 5 <> 4 AND game1 <> 7 THEN game1 ELSE -1 END AS game1, CASE WHEN sec % 5 <> 4 THEN game2 ELSE -1 END AS game2,
CASE WHEN sec % 5 = 4 OR NOT success THEN 'No scoreboard detected' WHEN game1 = 7 THEN 'Incomplete score digits found' END AS error FROM {board}"""
)
def read_golden_scoreboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sb.read_golden_scoreboard(_golden(spark, sf_dir))


@query(
    """WITH n AS (SELECT DISTINCT p_name AS a, p_partkey % 4 AS k, length(regexp_replace(upper(p_name), '[^A-Z0-9]', '', 'g')) AS n FROM part)
SELECT a, CASE k WHEN 0 THEN a || 'x' WHEN 1 THEN a || 'xyz' WHEN 2 THEN 'qq' || a ELSE '-' || upper(a) END AS b, CASE k WHEN 0 THEN 2.0 * n / (2 * n + 1) WHEN 1 THEN 2.0 * n / (2 * n + 3) WHEN 2 THEN 2.0 * n / (2 * n + 2) ELSE 1 END >= 0.92 AS similar FROM n"""
)
def similar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names against themselves with one, two or three letters more, or written otherwise: the ratio follows from their length."""
    name, kind = F.col("p_name"), F.col("p_partkey") % 4
    other = F.when(kind == 0, F.concat(name, F.lit("x"))).when(kind == 1, F.concat(name, F.lit("xyz"))).when(kind == 2, F.concat(F.lit("qq"), name)).otherwise(F.concat(F.lit("-"), F.upper(name)))
    names = spark.read.parquet(f"{sf_dir}/part.parquet").select(name.alias("a"), other.alias("b")).distinct()
    return with_similar(names, {"similar": (F.col("a"), F.col("b"))})


#: A video's candidates one by one: kept unless one that is kept has the same players or is too near.
ALIKE = "((regexp_replace(k.player1, 'X$', '') = regexp_replace(x[1].player1, 'X$', '') AND k.player2 = x[1].player2) OR (regexp_replace(k.player1, 'X$', '') = x[1].player2 AND k.player2 = regexp_replace(x[1].player1, 'X$', '')))"
FOLD = "list_reduce(list(list_value(struct_pack(ts := actual_ts, player1 := player1, player2 := player2)) ORDER BY t), lambda kept, x: CASE WHEN len(list_filter(kept, lambda k: {})) > 0 THEN kept ELSE list_concat(kept, x) END)"

_HIT = ", ".join(f"coalesce(b0.{c}, b1.{c}, b2.{c}, b3.{c}) AS r_{c}" for c in sb.FIELDS)
_JOINS = " ".join(f"LEFT JOIN ok b{i} ON b{i}.video_id = s.video_id AND b{i}.sec = CAST(trunc(s.t + {o}) AS INT)" for i, o in enumerate(sb.PROBE_OFFSETS))
_OFF = " ".join(f"WHEN b{i}.sec IS NOT NULL THEN s.t + {o}" for i, o in enumerate(sb.PROBE_OFFSETS))
#: One interval at a time goes on until it is narrow; the scan's samples take the place of the adapter's.
BISECTED = f"""RECURSIVE {PROBED}, {FOUND.replace("{samples}", "probed")}, ok AS (SELECT * FROM {{board}} WHERE success),
tr AS (SELECT DISTINCT video_id, CASE WHEN kind = 'score_appears' THEN pst ELSE pt END AS lo, actual_ts AS hi, {FIELDS} FROM f WHERE kind IS NOT NULL),
st AS (SELECT video_id, lo, hi, lo AS a, hi AS b, CASE WHEN set1 = 0 AND set2 = 0 AND game1 + game2 <= 15 THEN struct_pack(ts := hi, points := game1 + game2, player1 := player1, player2 := player2) END AS early,
  CAST(NULL AS STRUCT(ts DOUBLE, player1 VARCHAR, player2 VARCHAR)) AS best FROM tr
UNION ALL SELECT video_id, lo, hi, CASE WHEN earlier THEN a ELSE t END, CASE WHEN earlier THEN t ELSE b END,
  CASE WHEN NOT zero AND soon AND (early IS NULL OR found_at < early.ts) THEN struct_pack(ts := found_at, points := r_game1 + r_game2, player1 := r_player1, player2 := r_player2) ELSE early END,
  CASE WHEN zero THEN struct_pack(ts := found_at, player1 := r_player1, player2 := r_player2) ELSE best END
  FROM (SELECT *, coalesce(r_set1 = 0 AND r_set2 = 0 AND r_game1 = 0 AND r_game2 = 0, false) AS zero, coalesce(r_set1 = 0 AND r_set2 = 0 AND r_game1 + r_game2 <= 15, false) AS soon,
    coalesce((r_set1 = 0 AND r_set2 = 0) OR r_game1 + r_game2 > 0 OR r_set1 > 0 OR r_set2 > 0, false) AS earlier
    FROM (SELECT s.*, CASE {_OFF} END AS found_at, {_HIT} FROM (SELECT *, (a + b) / 2 AS t FROM st WHERE b - a > 10) s {_JOINS}) h) g),
done AS (SELECT video_id, lo, hi, coalesce(best.ts, greatest(0, early.ts - early.points * 16)) AS start, coalesce(best.player1, early.player1) AS player1, coalesce(best.player2, early.player2) AS player2, best IS NULL AS approximate
  FROM st WHERE b - a <= 10 AND (best IS NOT NULL OR early IS NOT NULL))"""


@query(f"WITH {BISECTED} SELECT * FROM done")
def bisect_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    board = frame(spark, sf_dir, "board")
    return se.bisect_starts(sb.transitions(sb.coarse_scan(board)), board)


@query(f"WITH s AS (SELECT video_id, unnest({FOLD.format(ALIKE + ' OR abs(k.ts - x[1].ts) < 300')}) AS k FROM {{samples}} WHERE success AND game1 + game2 < 6 GROUP BY video_id) SELECT video_id, k.ts AS start, k.player1 AS player1, k.player2 AS player2 FROM s")
def dedup_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = frame(spark, sf_dir, "samples").filter("success AND game1 + game2 < 6")
    return se.dedup_starts(starts.select("video_id", F.lit(1).alias("phase"), F.col("t").alias("ord"), F.col("actual_ts").alias("start"), "player1", "player2"))


STARTS = f"""{BISECTED}, cand AS (SELECT video_id, 1 AS phase, t AS t, actual_ts, player1, player2 FROM probed WHERE success AND set1 = 0 AND set2 = 0 AND game1 = 0 AND game2 = 0 UNION ALL SELECT video_id, 2, hi, start, player1, player2 FROM done),
kept AS (SELECT video_id, unnest({FOLD.replace("ORDER BY t)", "ORDER BY phase, t)").format(ALIKE + " OR abs(k.ts - x[1].ts) < 300")}) AS k FROM cand GROUP BY video_id),
starts AS (SELECT v.video_id, k.ts AS start, k.player1 AS player1, k.player2 AS player2, CASE WHEN k IS NULL THEN 'No match starts found' END AS error FROM (SELECT DISTINCT video_id FROM {{board}}) v LEFT JOIN kept ON v.video_id = kept.video_id)"""


@query(f"WITH {STARTS} SELECT video_id, start, printf('%02d:%02d:%02d', CAST(trunc(start) AS BIGINT) // 3600, CAST(trunc(start) AS BIGINT) % 3600 // 60, CAST(trunc(start) AS BIGINT) % 60) AS start_hms, player1, player2, error FROM starts")
def match_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.match_starts(frame(spark, sf_dir, "board"))


PAIRS = f"s AS (SELECT video_id, unnest({FOLD.format(ALIKE)}) AS k FROM {{samples}} WHERE success GROUP BY video_id), pairs AS (SELECT video_id, k.player1 AS player1, k.player2 AS player2, k.ts AS first_seen FROM s)"


@query(f"WITH {PAIRS} SELECT * FROM pairs")
def distinct_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return se.distinct_pairs(frame(spark, sf_dir, "samples"))


@query(
    f"""WITH {PAIRS} SELECT * FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM {{samples}} f WHERE f.video_id = p.video_id AND f.success AND f.set1 = 0 AND f.set2 = 0
AND ((regexp_replace(p.player1, 'X$', '') = regexp_replace(f.player1, 'X$', '') AND p.player2 = f.player2) OR (regexp_replace(p.player1, 'X$', '') = f.player2 AND p.player2 = regexp_replace(f.player1, 'X$', ''))))"""
)
def skipped_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = frame(spark, sf_dir, "samples")
    starts = samples.filter("success AND set1 = 0 AND set2 = 0").select("video_id", F.col("actual_ts").alias("start"), "player1", "player2").distinct()
    return se.skipped_pairs(samples, starts)


#: SAME, of two samples that follow each other.
NEXT = "(regexp_replace(a.player1, 'X$', '') = regexp_replace(b.player1, 'X$', '') AND a.player2 = b.player2) OR (regexp_replace(a.player1, 'X$', '') = b.player2 AND a.player2 = regexp_replace(b.player1, 'X$', ''))"
FUZZY = f"SELECT a.video_id, a.t, CAST({NEXT} AS BOOLEAN) AS same FROM (SELECT * FROM {{samples}} WHERE success) a JOIN (SELECT * FROM {{samples}} WHERE success) b ON a.video_id = b.video_id AND a.t + 180 = b.t"


@query(FUZZY)
def fuzzy_pair_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples that follow each other, those with noise in their names too."""
    a = frame(spark, sf_dir, "samples").filter("success")
    b = a.select("video_id", (F.col("t") - 180).alias("t"), F.col("player1").alias("q1"), F.col("player2").alias("q2"))
    return with_same_pair(a.join(b, ["video_id", "t"]), "same", F.col("player1"), F.col("player2"), F.col("q1"), F.col("q2")).select("video_id", "t", "same")


@query(FUZZY)
def fuzzy_pair_match_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same under the name that it had while fuzzy_pair_match left noise out."""
    return fuzzy_pair_match(spark, sf_dir)


@query(
    f"""WITH {STARTS}, m AS (SELECT video_id, string_agg('{{"timestamp":' || CAST(trunc(start) AS INT) || ',"player1":"' || player1 || '","player2":"' || player2 || '"}}', ',' ORDER BY CAST(trunc(start) AS INT), player1, player2) AS listed FROM starts GROUP BY video_id)
SELECT video_id, '{{"video_id":"' || video_id || '","video_title":"Title of ' || video_id || '","upload_date":"1700000000","matches":[' || coalesce(listed, '') || ']' || CASE WHEN listed IS NULL THEN ',"error":"No match starts found"' ELSE '' END || '}}' AS doc FROM m"""
)
def write_match_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    board = frame(spark, sf_dir, "board")
    videos = board.select("video_id").distinct().select("video_id", F.concat(F.lit("Title of "), "video_id").alias("video_title"), F.lit("1700000000").alias("upload_date"))
    return se.write_match_json(se.match_starts(board), videos)


@query("SELECT video_id, sec FROM (SELECT video_id, sec, list_sum(list_transform(vec, lambda x: CAST(abs(x) AS DOUBLE) * 200)) / len(vec) AS m FROM {frames}) f WHERE m >= 15")
def dark_frame_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.dark_frame_skip(frame(spark, sf_dir, "frames").withColumn("vec", F.transform("vec", lambda x: F.abs(x).cast("double") * 200))).select("video_id", "sec")


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that change less than they would, so that some are dropped."""
    return frame(spark, sf_dir, "frames").withColumn("vec", F.transform("vec", lambda x: x.cast("double") * 20))


ANCHORS = """RECURSIVE f AS (SELECT video_id, sec, list_transform(vec, lambda x: CAST(x AS DOUBLE) * 20) AS v FROM {frames}),
a AS (SELECT video_id, sec, true AS kept, v AS anchor FROM f WHERE sec = 0 UNION ALL
  SELECT video_id, sec, far AS kept, CASE WHEN far THEN v ELSE anchor END AS anchor FROM (
    SELECT f.video_id, f.sec, f.v, a.anchor, list_sum(list_transform(list_zip(f.v, a.anchor), lambda z: abs(z[1] - z[2]))) / len(f.v) > 3 AS far FROM a JOIN f ON f.video_id = a.video_id AND f.sec = a.sec + 1) n)"""


@query(f"WITH {ANCHORS} SELECT video_id, sec, kept FROM a")
def anchor_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.anchor_dedup(_frames(spark, sf_dir))


KEPT = "kept AS (SELECT video_id, sec, sec % 4 = 0 AS kept FROM {frames}), mapping AS (SELECT video_id, sec, sec - sec % 4 AS frame FROM {frames})"


def _mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.forward_fill_frame(frame(spark, sf_dir, "frames").select("video_id", "sec", (F.col("sec") % 4 == 0).alias("kept")))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "frames").filter("sec % 8 = 0").select("video_id", F.col("sec").alias("frame"), F.concat(F.lit("text "), F.col("sec").cast("string")).alias("text"))


@query(f"WITH {KEPT} SELECT * FROM mapping")
def forward_fill_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapping(spark, sf_dir)


@query(f"WITH {KEPT} SELECT DISTINCT video_id, frame FROM mapping")
def unique_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.unique_frames(_mapping(spark, sf_dir))


@query(f"WITH {KEPT} SELECT DISTINCT video_id, frame FROM mapping WHERE frame % 8 <> 0")
def pending_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.pending_frames(_mapping(spark, sf_dir), _results(spark, sf_dir))


@query(f"WITH {KEPT} SELECT video_id, sec, frame, 'text ' || frame AS text FROM mapping WHERE frame % 8 = 0")
def frame_result_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.frame_result_join(_mapping(spark, sf_dir), _results(spark, sf_dir)).select("video_id", "sec", "frame", "text")


def _brightness(vec: Column) -> Column:
    """What stands for a recogniser: how many components are above zero."""

    @F.pandas_udf("string")
    def read(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: f"{(v > 0).sum()} bright")

    return read(vec)


SHOWN = f"{ANCHORS}, m AS (SELECT video_id, sec, max(CASE WHEN kept THEN sec END) OVER (PARTITION BY video_id ORDER BY sec) AS frame FROM a)"


@query(f"WITH {SHOWN} SELECT m.video_id, m.sec, m.frame, CASE WHEN m.frame % 3 = 0 THEN 'known' ELSE len(list_filter(v, lambda x: x > 0)) || ' bright' END AS text FROM m JOIN f ON f.video_id = m.video_id AND f.sec = m.frame")
def resume_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that an earlier run has read are not read again."""
    frames = _frames(spark, sf_dir)
    cache = frames.filter("sec % 3 = 0").select("video_id", F.col("sec").alias("frame"), F.lit("known").alias("text"))
    return fr.frames_to_scoreboard(frames, _brightness, cache).select("video_id", "sec", "frame", "text")


@query(f"WITH {SHOWN} SELECT m.video_id, m.sec, m.frame, len(list_filter(v, lambda x: x > 0)) || ' bright' AS text FROM m JOIN f ON f.video_id = m.video_id AND f.sec = m.frame")
def frames_to_scoreboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fr.frames_to_scoreboard(_frames(spark, sf_dir), _brightness).select("video_id", "sec", "frame", "text")


@query("SELECT regexp_extract(path, '[^/]+$') AS image, arg_max(o_orderpriority, o_orderkey) AS player FROM (SELECT *, CASE WHEN o_orderkey % 9 = 0 THEN 'dir/' ELSE 'dir/img' || o_custkey || '.jpg' END AS path FROM orders) o WHERE regexp_extract(path, '[^/]+$') <> '' GROUP BY 1")
def read_expected_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.when(F.col("o_orderkey") % 9 == 0, "dir/").otherwise(F.concat(F.lit("dir/img"), F.col("o_custkey").cast("string"), F.lit(".jpg")))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(path.alias("image_path"), F.col("o_orderkey").alias("line"), F.col("o_orderpriority").alias("player"))
    folder = shared_path(spark, "expected")
    rows.write.option("header", True).csv(folder)
    return ck.read_expected_csv(fl.read_expected_csv_files(spark, folder).withColumn("line", F.col("line").cast("long")))


IMAGE = "video_id || '-' || CAST(CAST(t AS BIGINT) AS STRING)"


@query(
    f"""WITH a AS (SELECT *, {IMAGE} AS image, ends_with(coalesce(player1, ''), 'X') AS x FROM {{samples}}),
c AS (SELECT image, CASE WHEN CAST(t AS BIGINT) % 1260 = 0 THEN 'No expected data found in CSV' WHEN NOT success THEN 'player1,set1,game1,player2,set2,game2' WHEN set1 = 1 THEN CASE WHEN game2 > 5 THEN 'set1,game2' ELSE 'set1' END WHEN game2 > 5 THEN 'game2' ELSE '' END AS mismatches, x AND CAST(t AS BIGINT) % 1260 <> 0 AS h FROM a)
SELECT image, mismatches = '' AS passed, mismatches, CASE WHEN h THEN 'player1' ELSE '' END AS hard FROM c"""
)
def expected_vs_actual(spark: SparkSession, sf_dir: str) -> DataFrame:
    actual = frame(spark, sf_dir, "samples").withColumn("image", F.expr(IMAGE))
    text = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    expected = actual.filter("CAST(t AS BIGINT) % 1260 <> 0").select(
        "image",
        F.coalesce(F.regexp_replace("player1", "X$", ""), F.lit("SOMEONE")).alias("exp_player1"),
        F.coalesce("player2", F.lit("SOMEONE")).alias("exp_player2"),
        text(F.when(F.col("set1") == 1, 9).otherwise(F.col("set1"))).alias("exp_set1"),
        text(F.col("set2")).alias("exp_set2"),
        text(F.col("game1")).alias("exp_game1"),
        text(F.when(F.col("game2") > 5, -5).otherwise(F.col("game2"))).alias("exp_game2"),
    )
    return ck.expected_vs_actual(actual, expected)


@query(f"SELECT {IMAGE} AS image, player1 AS name, regexp_replace(player1, 'X$', '') AS true_name FROM {{samples}} WHERE success AND ends_with(player1, 'X')")
def mine_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = frame(spark, sf_dir, "samples").filter("success").select(F.expr(IMAGE).alias("image"), F.col("player1").alias("name"))
    return ck.mine_errors(seen, seen.withColumn("name", F.regexp_replace("name", "X$", "")))


@query("SELECT video_id, count(*) AS candidates, count(*) FILTER (set1 = 0) AS skipped, count(*) FILTER (set1 = 1) AS added, count(*) = count(*) FILTER (set1 < 2) AS consistent FROM {samples} WHERE success GROUP BY video_id")
def reconcile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("set1") == 0, "skipped").when(F.col("set1") == 1, "added").otherwise("lost")
    return ck.reconcile_counts(frame(spark, sf_dir, "samples").filter("success").withColumn("status", status))


LINE = f"CASE WHEN set1 = 0 THEN 'Sampling at 1... ' WHEN set1 = 1 THEN 'seen ' ELSE 'nothing ' END || CASE WHEN set1 < 2 THEN 'out/' || {IMAGE} || '.jpg' || CASE WHEN game1 % 2 = 0 THEN '.bak' ELSE '' END ELSE '' END || CASE WHEN set1 = 0 AND set2 = 0 THEN ' and out/' || video_id || '-0.jpg' ELSE '' END"


@query(
    f"""WITH i AS (SELECT DISTINCT 'out/' || {IMAGE} || '.jpg' AS image FROM {{samples}} WHERE success UNION SELECT text FROM benchmark),
l AS (SELECT DISTINCT {LINE} AS line FROM {{samples}} WHERE success UNION SELECT text FROM documents),
h AS (SELECT image, line, contains(line, 'Sampling at') AS preferred FROM i LEFT JOIN l ON contains(line, image)), b AS (SELECT image, max(preferred) AS best FROM h GROUP BY image)
SELECT md5(image) AS image, md5(line) AS line, preferred FROM h JOIN b USING (image) WHERE preferred IS NOT DISTINCT FROM best"""
)
def log_contains_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of images in log lines, some inside longer ones, and items of the benchmark in documents; both by their digest."""
    seen = frame(spark, sf_dir, "samples").filter("success")
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet").select("text")
    images = seen.select(F.concat(F.lit("out/"), F.expr(IMAGE), F.lit(".jpg")).alias("image")).union(read("benchmark"))
    lines = seen.select(F.expr(LINE).alias("line")).union(read("documents")).distinct()
    return ck.log_contains_join(images, lines).select(F.md5("image").alias("image"), F.md5("line").alias("line"), "preferred")


@query(f"WITH {RUNS} SELECT video_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY actual_ts) AS INT) AS n, actual_ts AS start FROM p WHERE success AND game1 = 0 AND game2 = 0 AND NOT coalesce(ps AND pg1 = 0 AND pg2 = 0, false)")
def sort_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = sb.game_starts(frame(spark, sf_dir, "samples")).withColumnRenamed("actual_ts", "start")
    return se.sort_matches(starts).select("video_id", "n", "start")

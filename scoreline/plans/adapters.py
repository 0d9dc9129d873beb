"""The engine's record shapes, drawn from the tables at hand. Each text is SQL for Spark and for DuckDB alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: One shape for each rule that a title can meet: years and days in any place, parts that don't count, sessions, no year.
_TITLE = """CASE o_orderkey % 12
  WHEN 0 THEN 'Court ' || s || ' | Harbour Open ' || y || ' | Day ' || d
  WHEN 1 THEN 'LIVE! | Lakeside Masters ' || y || ' by Northwind | Evening finals Session ' || s
  WHEN 2 THEN 'T' || s || ' | LIVE! | Day ' || d || ' | Valley Smash ' || y
  WHEN 3 THEN 'Infinity Stage | Day ' || d || ' morning | Ridge Champions ' || y || ' | Semifinals session ' || s || ' | LIVE!'
  WHEN 4 THEN 'LIVE! | Coast Youth Contender ' || y || ' | Warm-up'
  WHEN 5 THEN 'LIVE! | Day ' || d || ' | Day ' || s || ' late | Island Cup ' || y
  WHEN 6 THEN 'Studio talk of ' || y
  WHEN 7 THEN 'LIVE! | Day ' || d || ' | Archive of 1999 | Rerun'
  WHEN 8 THEN 'LIVE! | Island Cup ' || y
  WHEN 9 THEN 'Quarterfinals | LIVE! | Ridge Champions ' || y || ' (replay) | Court 2'
  WHEN 10 THEN 'LIVE! | Meadow Contender ' || y || ' | Team finals of Day ' || d
  ELSE 'LIVE! | Lakeside Masters ' || y || ' | ' END"""

_KEYS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate, CAST(2020 + o_orderkey % 7 AS STRING) AS y, CAST(1 + o_orderkey % 7 AS STRING) AS d, CAST(1 + o_orderkey % 3 AS STRING) AS s FROM {orders}"

_PLAYERS = "CASE {} WHEN 0 THEN 'ADA LINDQVIST' WHEN 1 THEN 'BRUNO OKAFOR' WHEN 2 THEN 'CHI-MEI TANAKA' WHEN 3 THEN 'DORA PELLEGRINI' ELSE 'EMIL VARGAS' END"

_SCORES = f"""SELECT CONCAT('u', CAST(user_id AS STRING)) AS video_id, i, event_type NOT IN ('error', 'signup') AS success,
  {_PLAYERS.format("(i // 6 + user_id) % 5")} || CASE WHEN i % 6 = 4 THEN 'X' ELSE '' END AS player1,
  {_PLAYERS.format("(i // 6 + user_id + 2) % 5")} AS player2,
  CASE WHEN i % 6 < 2 THEN 0 ELSE CAST(FLOOR(value) AS INT) % 3 END AS set1, CASE WHEN i % 6 < 2 THEN 0 ELSE CAST(FLOOR(value / 3) AS INT) % 3 END AS set2,
  CASE WHEN i % 6 < 1 THEN 0 ELSE CAST(FLOOR(value * 3) AS INT) % 12 END AS game1, CASE WHEN i % 6 < 1 THEN 0 ELSE CAST(FLOOR(value * 5) AS INT) % 12 END AS game2
FROM (SELECT user_id, event_type, value, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM {{events}}) e"""

ADAPTERS = {
    # Videos with their titles, and upload times as epoch text, some of it unreadable.
    "videos": f"""SELECT CONCAT('v', CAST(o_orderkey AS STRING)) AS video_id, o_orderkey AS pos, {_TITLE} AS title,
  CASE WHEN o_orderkey % 13 = 0 THEN '' WHEN o_orderkey % 17 = 0 THEN 'not-a-number' ELSE CAST(1700000000 + o_orderkey * 97 AS STRING) END AS upload_date,
  CASE WHEN o_orderkey % 19 = 0 THEN 'download failed' END AS error
FROM ({_KEYS}) k""",
    "vods": """SELECT o_orderkey AS pos, CONCAT('https://example.com/watch?v=', CAST(o_orderkey AS STRING)) AS url, CASE o_orderkey % 8
  WHEN 0 THEN 'FULL MATCH | A vs B | MS R16 | Tour ' || CAST(o_custkey % 9 AS STRING) WHEN 1 THEN 'A VS B | WS QF | #Smash' WHEN 2 THEN 'Highlights | MS F | Tour'
  WHEN 3 THEN 'A vs B | Tour' WHEN 4 THEN 'FULL MATCH | C vs D | XD SF | #' WHEN 5 THEN 'C vs D | MS' WHEN 6 THEN 'FULL MATCH | MD F | Tour' ELSE 'E vs F | MS F | Contender | Extra' END AS title
FROM {orders}""",
    "video_matches": """SELECT CONCAT('v', CAST(l_orderkey AS STRING)) AS video_id, l_linenumber * 600 AS offset_s, l_linenumber, l_partkey, p_name AS name,
  CASE WHEN l_returnflag = 'R' THEN p_name || '/' || p_name || ' two' WHEN l_returnflag = 'N' THEN ' ' || p_name || ' ' ELSE p_name || ' / ' END AS side
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "participants": """SELECT l_orderkey AS match_id, p_name AS player, CASE WHEN l_returnflag = 'A' THEN 'A' ELSE 'B' END AS side
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "matches": """SELECT o_orderkey AS match_id, CONCAT('v', CAST(o_orderkey AS STRING)) AS video_id, o_custkey AS tournament_id, CAST(o_orderkey % 50 * 61 AS INT) AS video_offset_seconds, o_orderkey % 4 = 0 AS is_doubles
FROM {orders}""",
    "tournaments": "SELECT c_custkey AS tournament_id, c_name AS tournament, CAST(2020 + c_custkey % 7 AS INT) AS year FROM {customer}",
    "uploads": "SELECT CONCAT('v', CAST(o_orderkey AS STRING)) AS video_id, CONCAT('v', CAST(o_orderkey AS STRING)) AS youtube_id, o_orderdate AS upload_date, o_orderpriority AS video_title FROM {orders}",
    "playlist": """SELECT CAST(o_custkey AS STRING) AS channel, CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS INT) AS pos,
  CONCAT('v', CAST(o_orderkey AS STRING)) AS video_id,
  CASE o_orderkey % 7 WHEN 0 THEN 'Draw ceremony' WHEN 1 THEN 'Morning Show' WHEN 2 THEN 'Last sixteen' WHEN 3 THEN 'Ceremony after the Finals' WHEN 4 THEN 'Ridge Champions 2026 Day 1' WHEN 5 THEN 'Review show: Finals' ELSE 'Meadow Contender' END AS title,
  CASE o_orderstatus WHEN 'F' THEN 'was_live' WHEN 'O' THEN 'is_upcoming' ELSE 'is_live' END AS live_status, o_orderkey,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(1700000000 + o_orderkey AS DOUBLE) END AS release_timestamp, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(1600000000 + o_orderkey AS DOUBLE) END AS timestamp
FROM {orders}""",
    "processed": "SELECT CONCAT('v', CAST(o_orderkey AS STRING)) AS video_id, o_orderdate AS upload_date, CAST(o_custkey AS STRING) AS channel FROM {orders} WHERE o_orderstatus = 'F'",
    "schedule": """SELECT o_orderkey AS match_id, CASE o_custkey % 6 WHEN 0 THEN 'Ridge Champions' WHEN 1 THEN 'Valley Smash' WHEN 2 THEN 'Coast Youth Contender' WHEN 3 THEN 'Meadow Contender' WHEN 4 THEN 'Island Cup' END AS tournament,
  CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE CAST(2020 + o_custkey % 7 AS INT) END AS year, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'Day ' || CAST(o_orderkey % 4 AS STRING) END AS day,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey % 4 AS INT) END AS session, o_orderdate AS upload_date,
  CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderdate END AS effective_timestamp, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderkey % 4 = 0 END AS is_doubles,
  CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE CONCAT('v', CAST(o_orderkey AS STRING)) END AS youtube_id, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS video_title,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE c_name END AS team_a, c_mktsegment AS team_b
FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "samples": f"SELECT video_id, CAST((i - 1) * 180 AS DOUBLE) AS t, success, CAST((i - 1) * 180 AS DOUBLE) AS actual_ts, CASE WHEN success THEN player1 END AS player1, CASE WHEN success THEN player2 END AS player2, CASE WHEN success THEN set1 END AS set1, CASE WHEN success THEN set2 END AS set2, CASE WHEN success THEN game1 END AS game1, CASE WHEN success THEN game2 END AS game2 FROM ({_SCORES}) s",
    "board": f"SELECT video_id, CAST((i - 1) * 40 + h AS INT) AS sec, success, player1, player2, set1, set2, game1, game2 FROM ({_SCORES}) s CROSS JOIN (VALUES (0), (2), (3), (5), (7), (11), (13), (17), (19), (23), (29), (31)) AS hold(h)",
    "frames": "SELECT CONCAT('f', CAST(vec_id // 25 AS STRING)) AS video_id, vec_id % 25 AS sec, embedding AS vec FROM {embeddings}",
}

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The adapter's rows in Spark."""
    text = ADAPTERS[name].replace(" // ", " DIV ")
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **tables)


def with_adapters(body: str) -> str:
    """DuckDB's SQL: body with a common table for each adapter that it names in braces."""
    names = [n for n in ADAPTERS if "{" + n + "}" in body]
    tables = ", ".join(f"{n} AS ({ADAPTERS[n].format(**{t: t for t in TABLES})})" for n in names)
    for n in names:
        body = body.replace("{" + n + "}", n)
    if not tables:
        return body
    body = re.sub(r"^\s*WITH\s+RECURSIVE\s", f"WITH RECURSIVE {tables}, ", body)
    if re.match(r"\s*WITH\s+RECURSIVE\s", body):
        return body
    return re.sub(r"^\s*WITH\s", f"WITH {tables}, ", body) if re.match(r"\s*WITH\s", body) else f"WITH {tables} {body}"

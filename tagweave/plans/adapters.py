"""Views of the test tables as words, tags, readings, lines and seed rows: one SQL text for Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schema import TAG_TEXTS

_PLACED = """
  SELECT event_id, user_id, event_type, CAST(floor(value) AS BIGINT) AS v, CAST(CAST(floor(event_id / 48) AS BIGINT) AS STRING) AS drawing_id,
    CAST(1 + floor((event_id % 48) / 24) AS INT) AS page, event_id % 2 AS half, s - CASE WHEN s % 3 = 2 THEN 1 ELSE 0 END AS b, CASE WHEN s % 3 = 2 THEN 1 ELSE 0 END AS dup,
    split_part('AOV,SVO,ZSC,ZSO,PDIT,BDV,AQV,A', ',', CAST(user_id % 8 + 1 AS INT)) AS func, CAST(1320 + user_id % 8 AS STRING) AS loop,
    CASE event_type WHEN 'error' THEN 'A' WHEN 'click' THEN '7' WHEN 'signup' THEN 'U' WHEN 'view' THEN 'V' ELSE '' END AS tail
  FROM (SELECT *, CAST(floor((event_id % 24) / 2) AS BIGINT) AS s FROM {events}) q"""

WORDS = f"""
SELECT drawing_id, event_id AS word_seq, page,
  CASE WHEN half = 0 THEN func WHEN event_id % 11 = 3 THEN concat('FCV-', loop) ELSE concat(loop, tail) END AS text, CAST(v % 100 AS DOUBLE) AS confidence,
  CAST(100 + 160 * (b % 4) + dup - CASE WHEN half = 0 THEN 28 ELSE 34 END AS DOUBLE) AS x0, CAST(100 + 220 * floor(b / 4) + dup + CASE WHEN half = 0 THEN -26 ELSE 2 END AS DOUBLE) AS y0,
  CAST(100 + 160 * (b % 4) + dup + CASE WHEN half = 0 THEN 28 ELSE 34 END AS DOUBLE) AS x1, CAST(100 + 220 * floor(b / 4) + dup + CASE WHEN half = 0 THEN -2 ELSE 26 END AS DOUBLE) AS y1,
  CASE WHEN dup = 1 THEN 'page' ELSE 'bubble' END AS origin FROM ({_PLACED}) p"""

_TEXTS = {
    "function_code": "func", "loop_number": "loop", "suffix": "tail", "type": "'ISA Instrument Tag'", "pattern_name": "'ISA Instrument Tag'",
    "state": "CASE WHEN event_id % 5 = 0 THEN 'confirmed' WHEN event_id % 7 = 0 THEN 'illegible' ELSE 'uncertain' END", "source": "CASE WHEN event_id % 13 = 0 THEN 'manual' ELSE 'auto' END",
    "origin": "CASE WHEN dup = 1 THEN 'page' ELSE 'bubble' END", "loop_group": "concat(loop, tail)", "panel": "CASE WHEN user_id % 3 = 0 THEN concat('UCP-', CAST(user_id % 20 * 50 AS STRING)) ELSE '' END",
    "notes": "CASE WHEN event_id % 9 = 0 THEN 'check \"8\"\" bore, TBD' ELSE '' END",
}
TAGS = f"""
SELECT drawing_id, event_id AS tag_seq, concat('t', CAST(event_id AS STRING)) AS id, concat(func, '-', loop, tail) AS text, page, CAST(v AS DOUBLE) AS confidence,
  CASE WHEN event_id % 17 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(100 + 160 * (b % 4) + dup - 35 AS DOUBLE) END AS x0, CASE WHEN event_id % 17 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(100 + 220 * floor(b / 4) - 26 AS DOUBLE) END AS y0,
  CASE WHEN event_id % 17 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(100 + 160 * (b % 4) + dup + 34 AS DOUBLE) END AS x1, CASE WHEN event_id % 17 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(100 + 220 * floor(b / 4) + 26 AS DOUBLE) END AS y1,
  {", ".join(f"{_TEXTS.get(c, chr(39) * 2)} AS {c}" for c in TAG_TEXTS)} FROM ({_PLACED}) p WHERE half = 1"""

READS = """
SELECT CAST(CAST(floor(event_id / 48) AS BIGINT) AS STRING) AS drawing_id, CAST(floor(event_id / 6) AS BIGINT) AS bubble_id, CAST(event_id % 2 AS INT) AS variant, event_id AS read_seq,
  CASE WHEN event_id % 3 = 0 THEN split_part('PT,P-T,FIC,ft', ',', CAST(user_id % 4 + 1 AS INT)) ELSE concat(CAST(100 + user_id % 2 AS STRING), CASE WHEN event_type = 'error' THEN 'A' WHEN event_type = 'click' THEN ' b' ELSE '' END) END AS text,
  CAST(CAST(floor(value) AS BIGINT) % 100 AS DOUBLE) AS confidence FROM {events}"""

SEED = """
SELECT CAST(CAST(floor(p_partkey / 20) AS BIGINT) AS STRING) AS drawing_id, p_partkey AS row_seq,
  concat(split_part('AOV,svo,ZSC,ZSO,PDIT', ',', CAST(p_partkey % 5 + 1 AS INT)), split_part('-, ,', ',', CAST(p_partkey % 3 + 1 AS INT)), CAST(1320 + p_partkey % 9 AS STRING), CASE WHEN p_partkey % 4 = 0 THEN 'a' ELSE '' END) AS tag,
  '' AS isa_function, p_name AS description, '' AS loop_group, p_brand AS line_or_equipment, CASE WHEN p_partkey % 2 = 0 THEN 'UCP-100' ELSE '' END AS panel, CAST(p_size AS STRING) AS size, '' AS fail_position, '' AS notes,
  CASE WHEN p_partkey % 6 = 0 THEN 'uncertain' END AS state FROM {part}"""

LINES = """
SELECT l_orderkey, l_linenumber, concat(CAST(l_partkey % 24 + 1 AS STRING), CASE WHEN l_partkey % 3 = 0 THEN '"' WHEN l_partkey % 3 = 1 THEN '''' ELSE '' END, '-', split_part('G,bd,IA,FUEL', ',', CAST(l_suppkey % 4 + 1 AS INT)), '-',
  CAST(l_partkey % 9000 + 100 AS STRING), CASE WHEN l_linenumber % 2 = 0 THEN concat('-', CAST(l_suppkey % 9 AS STRING), 'E', CAST(l_partkey % 2000 AS STRING)) ELSE '' END) AS line_number FROM {lineitem}"""


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    names = [t for t in ("events", "part", "lineitem") if "{" + t + "}" in sql]
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in names})


def oracle(sql: str) -> str:
    for t in ("events", "part", "lineitem"):
        sql = sql.replace("{" + t + "}", t)
    return sql

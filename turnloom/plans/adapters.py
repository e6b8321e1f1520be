"""The driver's tables as domain tables, in Spark and as common table expressions for DuckDB.

Rules are plain arithmetic on ids and lines, so that every branch of an operator occurs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.index import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, for files that a reader is to read."""
    return f"{shared_folder(spark)}/turnloom-{what}-{uuid.uuid4().hex}"


def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def words_sql(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> '')"


def word_count_sql(x: str) -> str:
    return f"CAST(len({words_sql(x)}) AS BIGINT)"


# Turns: one per conversation turn.
TURNS = "turns AS (SELECT 'conv_' || conv_id AS episode_url, turn AS turn_idx, role AS speaker, text FROM conversations)"
LOADED = f"loaded AS (SELECT * FROM turns WHERE episode_url <> '' AND length({strip_sql('text')}) > 10)"
CLEAN = f"clean AS (SELECT episode_url, turn_idx, speaker, {strip_sql('text')} AS text FROM turns WHERE NOT starts_with({strip_sql('text')}, '[Music]') AND length({strip_sql('text')}) >= 10)"
RELABELLED = """relabelled AS (
  SELECT *, CAST(dense_rank() OVER (PARTITION BY episode_url ORDER BY first) AS BIGINT) AS speaker_no
  FROM (SELECT *, min(turn_idx) OVER (PARTITION BY episode_url, speaker) AS first FROM clean))"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.select(F.concat(F.lit("conv_"), F.col("conv_id").cast("string")).alias("episode_url"), F.col("turn").alias("turn_idx"), F.array("role").alias("speaker"), "text")


# Transcripts of two models: documents by twos, with labels on some lines and a header above.
TRANSCRIPTS = """raw_transcripts AS (
  SELECT doc_id // 2 AS sample, CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END AS model,
    'Sample: sample_' || (doc_id // 2) || '_story_' || doc_id || chr(10) || 'Word count: ' || (doc_id % 1000) || chr(10) || 'Generation time: ' || (doc_id % 300) || '.5s' || chr(10) || '====' || chr(10) || chr(10) ||
    array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE
      WHEN doc_id % 7 = 0 OR (i - 1) % 3 <> 0 THEN x
      ELSE CASE (doc_id + i - 1) % 5 WHEN 0 THEN 'Speaker 1: ' WHEN 1 THEN 'Speaker 2:' || chr(10) WHEN 2 THEN '[Host]: ' WHEN 3 THEN '**Host:** ' ELSE 'Guest: ' || chr(10) || 'Alex: ' END || x END), chr(10)) AS content
  FROM documents)"""
HEADER_SQL = "regexp_matches(x, '^(?:Sample:|Word count:|Generation time:|===)')"
STRIPPED = f"""transcripts AS (SELECT sample, model, CASE WHEN f > 0 AND body <> '' THEN body ELSE {strip_sql('content')} END AS content FROM (
  SELECT sample, model, content, f, {strip_sql(f"array_to_string(list_filter(list_slice(l, greatest(f, 1), len(l)), lambda x: NOT {HEADER_SQL}), chr(10))")} AS body FROM (
    SELECT *, coalesce(list_position(list_transform(l, lambda x: {HEADER_SQL}), true), 0) AS f FROM (SELECT *, string_split(content, chr(10)) AS l FROM raw_transcripts))))"""


def raw_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = """CASE pmod(doc_id + i, 5) WHEN 0 THEN 'Speaker 1: ' WHEN 1 THEN 'Speaker 2:\\n' WHEN 2 THEN '[Host]: ' WHEN 3 THEN '**Host:** ' ELSE 'Guest: \\nAlex: ' END"""
    lines = f"transform(split(text, '\\n'), (x, i) -> CASE WHEN doc_id % 7 = 0 OR i % 3 <> 0 THEN x ELSE concat({label}, x) END)"
    head = "concat('Sample: sample_', doc_id div 2, '_story_', doc_id, '\\nWord count: ', doc_id % 1000, '\\nGeneration time: ', doc_id % 300, '.5s\\n====\\n\\n')"
    rows = table(spark, sf_dir, "documents")
    return rows.select(F.expr("doc_id div 2").alias("sample"), F.expr("if(doc_id % 2 = 0, 'a', 'b')").alias("model"), F.expr(f"concat({head}, array_join({lines}, '\\n'))").alias("content"))


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_transcripts(spark, sf_dir).withColumn("content", T.strip_header(F.col("content")))


# Excerpts: a document each, some with markers, with four to six scenes.
EXCERPTS = f"""excerpts AS (
  SELECT source, doc_id // 10 AS episode_idx, doc_id % 10 AS excerpt_idx, excerpt, CAST(length(excerpt) AS BIGINT) AS excerpt_length,
    CASE WHEN doc_id % 4 = 0 THEN CAST(450 + doc_id % 500 AS BIGINT) ELSE {word_count_sql('excerpt')} END AS word_count,
    list_transform(range(1, 5 + doc_id % 3), lambda s: 'Scene ' || s || ': Scene ' || s || ': ' || substr(excerpt, s, 20)) AS scenes
  FROM (SELECT *, CASE WHEN doc_id % 9 = 0 THEN text || ' [sigh] [Music] [laughter]' ELSE text END AS excerpt FROM documents))"""


def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").withColumn("excerpt", F.expr("if(doc_id % 9 = 0, concat(text, ' [sigh] [Music] [laughter]'), text)"))
    count = F.when(F.col("doc_id") % 4 == 0, (450 + F.col("doc_id") % 500).cast("bigint")).otherwise(T.word_count(F.col("excerpt")))
    scenes = "transform(sequence(1, 4 + cast(doc_id % 3 as int)), s -> concat('Scene ', s, ': Scene ', s, ': ', substr(excerpt, s, 20)))"
    return rows.select("source", F.expr("doc_id div 10").alias("episode_idx"), (F.col("doc_id") % 10).alias("excerpt_idx"), "excerpt", F.length("excerpt").cast("bigint").alias("excerpt_length"), count.alias("word_count"), F.expr(scenes).alias("scenes"))


# Scenes of excerpts with five scenes or more, and an inventory that lacks some of their images.
SCENES = f"""{EXCERPTS}, scenes AS (
  SELECT source, episode_idx, excerpt_idx, excerpt, word_count, CAST(s AS BIGINT) AS scene_idx, scenes[s] AS prompt, 'ep' || episode_idx || '_ex' || excerpt_idx || '_scene' || s || '.png' AS filename
  FROM excerpts, (SELECT unnest(range(1, 6)) AS s) WHERE len(scenes) >= 5)"""
INVENTORY = f"""{SCENES}, inventory AS (
  SELECT source, filename, CAST(1000 + (episode_idx * 7 + scene_idx * 13) % 5000 AS BIGINT) AS size FROM scenes
  WHERE (episode_idx + excerpt_idx * scene_idx) % 4 <> 0 AND (episode_idx * 3 + excerpt_idx) % 11 <> 0)"""


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.excerpts import explode_scenes

    return explode_scenes(excerpts(spark, sf_dir).drop("excerpt_length"))


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = "(episode_idx + excerpt_idx * scene_idx) % 4 <> 0 and (episode_idx * 3 + excerpt_idx) % 11 <> 0"
    return scenes(spark, sf_dir).filter(there).select("source", "filename", F.expr("cast(1000 + (episode_idx * 7 + scene_idx * 13) % 5000 as bigint)").alias("size"))


# Replies of a model: JSON of a document's excerpt, some fenced, broken, empty, unseen or missing.
REPLIES = f"""{EXCERPTS}, replies AS (
  SELECT id AS episode_idx, CASE id % 8 WHEN 1 THEN NULL WHEN 2 THEN 'no json {{' WHEN 3 THEN '{{"visualizable": false, "reason": "talk"}}'
    WHEN 4 THEN '{{"visualizable": true, "excerpts": []}}' WHEN 5 THEN '{{"visualizable": false}}'
    ELSE CAST(to_json({{'visualizable': true, 'excerpts': [{{'excerpt': excerpt, 'word_count': word_count, 'scenes': scenes}}]}}) AS VARCHAR) END AS reply, excerpt, word_count, scenes
  FROM (SELECT episode_idx * 10 + excerpt_idx AS id, excerpt, CASE WHEN excerpt_idx % 3 = 0 THEN NULL ELSE word_count END AS word_count, scenes FROM excerpts))"""


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = excerpts(spark, sf_dir).withColumn("id", F.expr("episode_idx * 10 + excerpt_idx")).withColumn("word_count", F.expr("if(excerpt_idx % 3 = 0, null, word_count)"))
    body = "to_json(named_struct('visualizable', true, 'excerpts', array(named_struct('excerpt', excerpt, 'word_count', word_count, 'scenes', scenes))))"
    reply = f"""CASE id % 8 WHEN 1 THEN null WHEN 2 THEN 'no json {{' WHEN 3 THEN '{{"visualizable": false, "reason": "talk"}}'
      WHEN 4 THEN '{{"visualizable": true, "excerpts": []}}' WHEN 5 THEN '{{"visualizable": false}}'
      WHEN 6 THEN concat('```json\\n', {body}, '\\n```') ELSE {body} END"""
    return rows.select(F.col("id").alias("episode_idx"), F.expr(reply).alias("reply"))


# Chat records: a conversation each, with as many images as turns of the user, give or take.
RECORDS = """records AS (
  SELECT conv_id AS record_id, list_transform(range(CASE WHEN conv_id % 6 = 5 THEN 0 ELSE n + (CASE WHEN conv_id % 7 = 3 THEN 1 ELSE 0 END) END), lambda k: 'img_' || conv_id || '_' || k || '.jpg') AS image,
    CASE WHEN conv_id % 5 = 4 THEN ['vid_' || conv_id || '.mp4'] ELSE [] END AS video, conversations FROM (
    SELECT conv_id, CAST(count(*) FILTER (WHERE side = 'human') AS BIGINT) AS n, list({'from': side, 'value': value} ORDER BY turn) AS conversations FROM (
      SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'human' ELSE 'gpt' END AS side, CASE
        WHEN turn % 2 = 0 AND conv_id % 6 <> 5 THEN '<image>' || chr(10) || text || (CASE WHEN conv_id % 5 = 4 AND turn = 0 THEN ' <video>' ELSE '' END)
        WHEN turn % 2 = 1 AND conv_id % 13 = 0 THEN text || ' <image>' ELSE text END AS value
      FROM conversations) GROUP BY conv_id))"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    value = """CASE WHEN turn % 2 = 0 AND conv_id % 6 <> 5 THEN concat('<image>\\n', text, if(conv_id % 5 = 4 AND turn = 0, ' <video>', ''))
      WHEN turn % 2 = 1 AND conv_id % 13 = 0 THEN concat(text, ' <image>') ELSE text END"""
    sided = rows.select("conv_id", "turn", F.expr("if(turn % 2 = 0, 'human', 'gpt')").alias("side"), F.expr(value).alias("value"))
    gathered = sided.groupBy("conv_id").agg(F.count_if(F.col("side") == "human").alias("n"), F.array_sort(F.collect_list(F.struct("turn", "side", "value"))).alias("t"))
    image = "transform(filter(sequence(0, cast(n as int) + 1), k -> k < if(conv_id % 6 = 5, 0, n + if(conv_id % 7 = 3, 1, 0))), k -> concat('img_', conv_id, '_', k, '.jpg'))"
    return gathered.select(
        F.col("conv_id").alias("record_id"),
        F.expr(image).alias("image"),
        F.expr("if(conv_id % 5 = 4, array(concat('vid_', conv_id, '.mp4')), cast(array() as array<string>))").alias("video"),
        F.transform("t", lambda s: F.struct(s["side"].alias("from"), s["value"].alias("value"))).alias("conversations"),
    )


# Media files: all that records name, but for some.
LISTING = f"{RECORDS}, used AS (SELECT record_id, unnest(list_concat(image, video)) AS path FROM records), listing AS (SELECT DISTINCT path FROM used WHERE NOT (record_id % 8 = 1 AND (path LIKE '%_0.jpg' OR path LIKE '%mp4')))"


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = records(spark, sf_dir).select("record_id", F.explode(F.concat("image", "video")).alias("path"))
    return used.filter("not (record_id % 8 = 1 and (path like '%\\_0.jpg' or path like '%mp4'))").select("path").distinct()


# Photo stories: an order each, a line per photo.
PHOTOS = "photos AS (SELECT l_orderkey AS story_id, l_partkey AS photo_id, CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey * 100000 + l_suppkey AS photo_order, p_name AS text FROM lineitem JOIN part ON l_partkey = p_partkey)"


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("text"))
    order = "cast(l_linenumber as bigint) * 1000000000000 + l_partkey * 100000 + l_suppkey"
    return rows.join(part, "l_partkey").select(F.col("l_orderkey").alias("story_id"), F.col("l_partkey").alias("photo_id"), F.expr(order).alias("photo_order"), "text")


# Multiple choice: a part each; predictions are sentences so that every rule fires.
ITEMS = """items AS (
  SELECT p_partkey AS index, 'Which is part ' || p_partkey || '? <image 1> See <image 2>.' AS question, CASE WHEN p_partkey % 10 = 9 THEN NULL ELSE p_brand END AS A, CASE WHEN p_partkey % 10 = 9 THEN NULL ELSE p_type || ' kind' END AS B,
    CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_name || ' x' END AS C, CASE p_partkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE p_name END AS answer,
    CASE WHEN p_partkey % 2 = 0 THEN 'dev' ELSE 'test' END AS split, CASE WHEN p_partkey % 5 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN '看图' ELSE 'look' END END AS hint FROM part),
predictions AS (
  SELECT p_partkey AS index, CASE p_partkey % 9 WHEN 0 THEN 'B' WHEN 1 THEN '(C).' WHEN 2 THEN 'A red thing is what I see' WHEN 3 THEN 'It is B or C' WHEN 4 THEN 'Cannot determine the answer here'
    WHEN 5 THEN 'Failed to obtain answer via API.' WHEN 6 THEN 'I think of ' || upper(p_brand) WHEN 7 THEN 'Z' ELSE 'no idea at all' END AS prediction,
    CASE WHEN p_partkey % 9 = 8 AND p_partkey % 2 = 0 THEN 'A' WHEN p_partkey % 9 = 5 THEN 'Z' END AS reply FROM part)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").alias("index"),
        F.expr("concat('Which is part ', p_partkey, '? <image 1> See <image 2>.')").alias("question"),
        F.expr("if(p_partkey % 10 = 9, null, p_brand)").alias("A"),
        F.expr("if(p_partkey % 10 = 9, null, concat(p_type, ' kind'))").alias("B"),
        F.expr("if(p_partkey % 3 = 0, null, concat(p_name, ' x'))").alias("C"),
        F.expr("CASE p_partkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' ELSE p_name END").alias("answer"),
        F.expr("if(p_partkey % 2 = 0, 'dev', 'test')").alias("split"),
        F.expr("if(p_partkey % 5 = 0, if(p_partkey % 2 = 0, '看图', 'look'), null)").alias("hint"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = """CASE p_partkey % 9 WHEN 0 THEN 'B' WHEN 1 THEN '(C).' WHEN 2 THEN 'A red thing is what I see' WHEN 3 THEN 'It is B or C' WHEN 4 THEN 'Cannot determine the answer here'
      WHEN 5 THEN 'Failed to obtain answer via API.' WHEN 6 THEN concat('I think of ', upper(p_brand)) WHEN 7 THEN 'Z' ELSE 'no idea at all' END"""
    reply = "CASE WHEN p_partkey % 9 = 8 AND p_partkey % 2 = 0 THEN 'A' WHEN p_partkey % 9 = 5 THEN 'Z' END"
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("index"), F.expr(text).alias("prediction"), F.expr(reply).alias("reply"))


# Videos: an event each; frames, rate and window from its value.
VIDEOS = """videos AS (SELECT event_id, CAST(2 + event_id % 900 AS BIGINT) AS total, 5.0::DOUBLE + event_id % 25 AS fps, CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 41 AS DOUBLE) END AS nframes,
  CASE WHEN event_id % 4 <> 0 THEN value / 10 END AS starts, CASE WHEN event_id % 5 <> 0 THEN value / 5 END AS ends, CASE WHEN event_id % 2 = 0 THEN 100000 + event_id END AS own_pixels FROM events)"""


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.expr("cast(2 + event_id % 900 as bigint)").alias("total"),
        F.expr("5.0D + event_id % 25").alias("fps"),
        F.expr("if(event_id % 3 = 0, cast(event_id % 41 as double), null)").alias("nframes"),
        F.expr("if(event_id % 4 <> 0, value / 10, null)").alias("starts"),
        F.expr("if(event_id % 5 <> 0, value / 5, null)").alias("ends"),
        F.expr("if(event_id % 2 = 0, 100000 + event_id, null)").alias("own_pixels"),
    )


# Image sizes and boxes: a line item each.
BOXES = "boxes AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, 20 + (l_orderkey * 7 + l_linenumber) % 3000 AS height, 20 + (l_partkey * 11) % 4000 AS width, l_orderkey % 500 AS x1, l_partkey % 400 AS y1, l_orderkey % 500 + CAST(l_quantity AS BIGINT) * 10 AS x2, l_partkey % 400 + CAST(l_quantity AS BIGINT) * 7 AS y2 FROM lineitem)"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_suppkey",
        "l_partkey",
        F.expr("20 + (l_orderkey * 7 + l_linenumber) % 3000").alias("height"),
        F.expr("20 + (l_partkey * 11) % 4000").alias("width"),
        F.expr("l_orderkey % 500").alias("x1"),
        F.expr("l_partkey % 400").alias("y1"),
        F.expr("l_orderkey % 500 + cast(l_quantity as bigint) * 10").alias("x2"),
        F.expr("l_partkey % 400 + cast(l_quantity as bigint) * 7").alias("y2"),
    )

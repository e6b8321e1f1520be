"""Queries on images, chat records, stories, multiple choice, media geometry, and training layout."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..operators import chat, choice, compare, media, mix, packing, stories
from ..sources import files
from . import adapters as A
from .dialogue_queries import rounded
from .registry import query

# ---- images -------------------------------------------------------------------------------------
ATTACHED = f"{A.INVENTORY}, attached AS (SELECT s.source, s.episode_idx, s.excerpt_idx, any_value(s.word_count) AS word_count, any_value(s.excerpt) AS excerpt, string_agg(s.filename, ',' ORDER BY s.scene_idx) AS images, count(*) AS n_images FROM scenes s JOIN inventory i ON s.source = i.source AND s.filename = i.filename GROUP BY 1, 2, 3)"


def _attached(spark, d, exact=None):
    return media.attach_images(A.scenes(spark, d), A.inventory(spark, d), exact)


@query("s7_image_inventory", f"WITH {A.INVENTORY} SELECT source, count(DISTINCT episode_idx) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM (SELECT i.source, i.size, s.episode_idx FROM inventory i JOIN scenes s ON i.source = s.source AND i.filename = s.filename) GROUP BY source")
def s7(spark, d):
    """A file of so many bytes for each episode, a thousand episodes in a folder, listed."""
    path = A.scratch(spark, "images")
    rows = A.inventory(spark, d).filter("source is not null").withColumn("episode_idx", F.regexp_extract("filename", r"^ep(\d+)_", 1).cast("bigint"))
    sizes = rows.groupBy("source", "episode_idx").agg(F.sum("size").alias("size"))
    name = F.format_string("source=%s/%d/%d.txt", F.url_encode("source"), F.expr("episode_idx div 1000"), "episode_idx")
    files.write_each(sizes.select(name.alias("name"), "size"), path)
    listed = files.image_inventory(spark, path, "files", "*.txt").withColumn("source", F.url_decode(F.regexp_extract("path", "source=([^/]*)/", 1)))
    return listed.groupBy("source").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


@query("j1_attach_images", f"WITH {ATTACHED} SELECT source, episode_idx, excerpt_idx, images, n_images FROM attached")
def j1(spark, d):
    return _attached(spark, d).withColumn("images", F.array_join("images", ","))


@query("j2_attach_exactly_five", f"WITH {ATTACHED} SELECT source, episode_idx, excerpt_idx, images, n_images FROM attached WHERE n_images = 5")
def j2(spark, d):
    return _attached(spark, d, 5).withColumn("images", F.array_join("images", ","))


@query("j3_pending_scenes", f"WITH {A.INVENTORY} SELECT s.source, s.filename, CASE WHEN i.filename IS NULL THEN 'pending' ELSE 'skipped' END AS status FROM scenes s LEFT JOIN inventory i ON s.source = i.source AND s.filename = i.filename")
def j3(spark, d):
    return media.pending_scenes(A.scenes(spark, d), A.inventory(spark, d)).select("source", "filename", "status")


@query("a7_image_histogram", f"WITH {ATTACHED} SELECT source, least(n_images, 6) AS bucket, count(*) AS n FROM attached GROUP BY GROUPING SETS ((source, 2), (2))")
def a7(spark, d):
    return media.image_histogram(_attached(spark, d))


RESULTS = f"{A.INVENTORY}, results AS (SELECT s.filename, i.size, CASE WHEN i.filename IS NOT NULL THEN 'success' WHEN s.scene_idx = 1 THEN 'failed' ELSE 'skipped' END AS status FROM scenes s LEFT JOIN inventory i ON s.source = i.source AND s.filename = i.filename)"


def _results(spark, d):
    joined = A.scenes(spark, d).join(A.inventory(spark, d).withColumn("there", F.lit(True)), ["source", "filename"], "left")
    return joined.withColumn("status", F.when(F.col("there"), "success").when(F.col("scene_idx") == 1, "failed").otherwise("skipped"))


@query("a9_generation_summary", f"WITH {RESULTS} SELECT status, count(*) AS n, round(coalesce(sum(size), 0) / 1048576.0::DOUBLE, 6) AS megabytes, round(avg(CASE WHEN status = 'success' THEN size / 1024.0::DOUBLE END), 6) AS avg_kilobytes FROM results GROUP BY status")
def a9(spark, d):
    return rounded(media.generation_summary(_results(spark, d)), "megabytes", "avg_kilobytes")


@query("a9_failed_files", f"WITH {RESULTS} SELECT filename FROM results WHERE status = 'failed'")
def a9_failed(spark, d):
    return media.failed_files(_results(spark, d))


# ---- chat records -------------------------------------------------------------------------------
@query("m12_chat_records", f"WITH {ATTACHED} SELECT source || '-' || episode_idx || '-' || excerpt_idx AS record_id, n_images AS images, repeat('<image>', n_images) || chr(10) || 'Write ' || (word_count // 100 * 100) || '-' || (word_count // 100 * 100 + 100) || ' words.' AS prompt, excerpt AS answer FROM attached")
def m12(spark, d):
    texts = A.excerpts(spark, d).select("source", "episode_idx", "excerpt_idx", "excerpt", "word_count")
    joined = _attached(spark, d).join(texts, ["source", "episode_idx", "excerpt_idx"]).withColumn("record_id", F.concat_ws("-", "source", F.col("episode_idx").cast("string"), F.col("excerpt_idx").cast("string")))
    made = chat.to_chat_records(joined, "Write {range} words.")
    return made.select("record_id", F.size("image").cast("bigint").alias("images"), F.col("conversations")[0]["value"].alias("prompt"), F.col("conversations")[1]["value"].alias("answer"))


@query("s5_chat_turns", f"WITH {A.RECORDS} SELECT record_id, CAST(len(image) AS BIGINT) AS images, CAST(len(video) AS BIGINT) AS videos, CAST(len(conversations) AS BIGINT) AS turns FROM records")
def s5(spark, d):
    """Records as JSON lines, a single image by its bare name, read back."""
    rows = A.records(spark, d)
    bare = F.when(F.size("image") == 1, F.col("image")[0]).otherwise(F.to_json("image"))
    path = A.scratch(spark, "records")
    files.write_jsonl(rows.select(F.col("record_id").alias("id"), bare.alias("image"), "video", "conversations"), path)
    read = files.read_annotations(spark, path, lines=True).withColumn("record_id", F.col("id").cast("bigint"))
    return read.select("record_id", *(F.size(c).cast("bigint").alias(n) for c, n in (("image", "images"), ("video", "videos"), ("conversations", "turns"))))


@query("p12_rewrite_prompt", f"""WITH {A.RECORDS} SELECT record_id, array_to_string(list_transform(conversations, lambda t: CASE WHEN t."from" = 'human' THEN repeat('<image>', len(image)) || chr(10) || 'Tell the story.' ELSE t."value" END), '|') AS turns FROM records""")
def p12(spark, d):
    return chat.rewrite_prompt(A.records(spark, d), "Tell the story.").select("record_id", F.array_join(F.transform("conversations", lambda t: t["value"]), "|").alias("turns"))


SEGMENTS = f"""{A.RECORDS}, t AS (SELECT record_id, image, video, unnest(conversations) AS t, generate_subscripts(conversations, 1) - 1 AS turn_no FROM records),
cuts AS (SELECT *, CASE WHEN t."from" = 'human' THEN string_split(regexp_replace(t."value", '(<image>|<video>)', chr(1) || '\\1' || chr(1), 'g'), chr(1)) ELSE [t."value"] END AS cut FROM t),
parts AS (SELECT record_id, image, video, turn_no, t."from" AS side, unnest(cut) AS part, generate_subscripts(cut, 1) AS pos FROM cuts),
kinds AS (SELECT *, CASE WHEN side = 'human' AND part = '<image>' THEN 'image' WHEN side = 'human' AND part = '<video>' THEN 'video' ELSE 'text' END AS kind FROM parts),
counted AS (SELECT *, count(*) OVER (PARTITION BY record_id, kind ORDER BY turn_no, pos ROWS UNBOUNDED PRECEDING) AS k, count(*) FILTER (WHERE kind = 'image') OVER (PARTITION BY record_id) AS images, count(*) FILTER (WHERE kind = 'video') OVER (PARTITION BY record_id) AS videos FROM kinds),
valued AS (SELECT record_id, turn_no, pos, kind, CASE kind WHEN 'image' THEN image[k] WHEN 'video' THEN video[k] ELSE CASE WHEN side = 'human' THEN {A.strip_sql('part')} ELSE part END END AS value,
  CASE WHEN images > len(image) OR videos > len(video) THEN 'too_many_tags' WHEN images < len(image) OR videos < len(video) THEN 'unused_media' END AS problem FROM counted)"""


@query("p13_segment_messages", f"WITH {SEGMENTS} SELECT record_id, turn_no, row_number() OVER (PARTITION BY record_id, turn_no ORDER BY pos) AS segment_no, kind, value, problem FROM valued WHERE kind <> 'text' OR value <> ''")
def p13(spark, d):
    return chat.segment_messages(A.records(spark, d))


@query("p18_sample_lengths", f"""WITH {A.RECORDS}, w AS (SELECT record_id, len(image) + len(video) > 0 AS media, CAST(list_sum(list_transform(conversations, lambda t: len(list_filter(regexp_split_to_array(t."value", '\\s+'), lambda w: w <> '')))) AS BIGINT) AS words FROM records)
SELECT record_id, words + CASE WHEN media THEN 128 ELSE 0 END AS length, CASE WHEN media THEN words ELSE -words END AS modality_length FROM w""")
def p18(spark, d):
    return chat.sample_lengths(A.records(spark, d))


@query("p23_media_elements", f"WITH {A.RECORDS}, u AS (SELECT record_id, unnest(list_concat(image, video)) AS value, generate_subscripts(list_concat(image, video), 1) AS element_no FROM records) SELECT record_id, element_no, CASE WHEN value LIKE '%mp4' THEN 'video' ELSE 'image' END AS type, value FROM u")
def p23(spark, d):
    element = lambda kind: lambda v: F.struct(F.lit(kind).alias("type"), v.alias("value"))
    text = F.array(F.struct(F.lit("text").alias("type"), F.lit("x").alias("value")))
    messages = F.array(F.concat(F.transform("image", element("image")), text), F.transform("video", element("video")))
    return chat.media_elements(A.records(spark, d).select("record_id", messages.alias("messages")))


@query("j5_missing_media", f"WITH {A.LISTING} SELECT record_id, string_agg(path, ',' ORDER BY path) AS missing FROM used WHERE path NOT IN (SELECT path FROM listing) GROUP BY record_id")
def j5(spark, d):
    return media.missing_media(A.records(spark, d), A.listing(spark, d)).withColumn("missing", F.array_join("missing", ","))


_COUNT = """list_sum(list_transform(list_filter(conversations, lambda t: t."from" = '{side}'), lambda t: (length(t."value") - length(replace(t."value", '{tag}', ''))) // {n}))"""
CHECKED = f"""{A.LISTING}, lost AS (SELECT record_id, count(*) AS n FROM used WHERE path NOT IN (SELECT path FROM listing) GROUP BY record_id),
tags AS (SELECT r.record_id, len(image) AS images, len(video) AS videos, coalesce(lost.n, 0) AS missing, coalesce({_COUNT.format(side='human', tag='<image>', n=7)}, 0) AS hi, coalesce({_COUNT.format(side='human', tag='<video>', n=7)}, 0) AS hv, coalesce({_COUNT.format(side='gpt', tag='<image>', n=7)}, 0) + coalesce({_COUNT.format(side='gpt', tag='<video>', n=7)}, 0) AS answer_tags
  FROM records r LEFT JOIN lost ON r.record_id = lost.record_id),
checked AS (SELECT *, missing > 0 AS p1, hi <> images OR hv <> videos AS p2, answer_tags > 0 AS p3 FROM tags)"""


def _checked(spark, d):
    records = A.records(spark, d)
    return chat.validate_records(records, media.missing_media(records, A.listing(spark, d)))


@query("m3_validate_records", f"""WITH {CHECKED} SELECT record_id, array_to_string(list_filter([CASE WHEN p1 THEN 'missing_files:any:0:' || missing END, CASE WHEN hi <> images THEN 'tag_mismatch:image:' || images || ':' || hi WHEN hv <> videos THEN 'tag_mismatch:video:' || videos || ':' || hv END, CASE WHEN p3 THEN 'tag_in_answer:any:0:' || answer_tags END], lambda x: x IS NOT NULL), ';') AS problems FROM checked""")
def m3(spark, d):
    shown = F.transform("problems", lambda p: F.concat_ws(":", p["type"], p["media_type"], p["expected"].cast("string"), p["actual"].cast("string")))
    return _checked(spark, d).select("record_id", F.array_join(shown, ";").alias("problems"))


@query("m4_media_class", f"WITH {A.RECORDS} SELECT record_id, CASE WHEN len(image) > 0 AND len(video) > 0 THEN 'mixed' WHEN len(image) > 0 THEN 'image' WHEN len(video) > 0 THEN 'video' ELSE 'none' END AS media FROM records")
def m4(spark, d):
    return A.records(spark, d).select("record_id", chat.media_class(F.col("image"), F.col("video")).alias("media"))


@query("a10_validation_summary", f"""WITH {CHECKED} SELECT count(*) AS total, count(*) FILTER (WHERE NOT p1 AND NOT p2 AND NOT p3) AS valid, count(*) FILTER (WHERE p1) AS missing_files, count(*) FILTER (WHERE p2) AS tag_mismatch, count(*) FILTER (WHERE p3) AS tag_in_answer,
  count(*) FILTER (WHERE images > 0 AND videos = 0) AS image_records, count(*) FILTER (WHERE images = 0 AND videos > 0) AS video_records, count(*) FILTER (WHERE images > 0 AND videos > 0) AS mixed_records, count(*) FILTER (WHERE images = 0 AND videos = 0) AS none_records FROM checked""")
def a10(spark, d):
    return chat.validation_summary(_checked(spark, d))


@query("u5_split_valid", f"WITH {CHECKED} SELECT NOT p1 AND NOT p2 AND NOT p3 AS valid, count(*) AS n FROM checked GROUP BY 1")
def u5(spark, d):
    good, bad = chat.split_valid(_checked(spark, d))
    return good.select(F.lit(True).alias("valid")).unionByName(bad.select(F.lit(False).alias("valid"))).groupBy("valid").agg(F.count("*").alias("n"))


@query("a15_dataset_size", f"WITH {A.RECORDS} SELECT 'set' || record_id % 3 AS dataset, count(*) AS records, CAST(sum(len(image)) AS BIGINT) AS images FROM records GROUP BY 1")
def a15(spark, d):
    return chat.dataset_size(A.records(spark, d).withColumn("dataset", F.concat(F.lit("set"), (F.col("record_id") % 3).cast("string"))))


@query("p22_resolve_paths", f"""WITH {A.LISTING}, placed AS (SELECT CASE WHEN ascii(right(path, 5)) % 2 = 0 THEN 'json/' ELSE 'parent/' END || path AS path FROM listing), asked AS (SELECT DISTINCT path FROM used)
SELECT a.path, coalesce((SELECT p.path FROM placed p WHERE p.path = 'json/' || a.path), (SELECT p.path FROM placed p WHERE p.path = 'parent/' || a.path), a.path) AS resolved FROM asked a""")
def p22(spark, d):
    names = A.records(spark, d).select(F.explode(F.concat("image", "video")).alias("path")).distinct()
    placed = A.listing(spark, d).select(F.concat(F.when(F.ascii(F.expr("right(path, 5)")) % 2 == 0, "json/").otherwise("parent/"), "path").alias("path"))
    return media.resolve_paths(names, placed, ["json", "parent"])


# ---- stories ------------------------------------------------------------------------------------
STORIES = f"{A.PHOTOS}, stories AS (SELECT story_id, list(photo_id ORDER BY photo_order) AS photos, string_agg(text, ' ' ORDER BY photo_order) AS text FROM photos GROUP BY story_id HAVING count(*) = 5)"


@query("w5_complete_stories", f"WITH {STORIES} SELECT story_id, array_to_string(photos, ',') AS photos FROM stories")
def w5(spark, d):
    return stories.complete_stories(A.photos(spark, d)).select("story_id", F.array_join(F.transform("photos", lambda p: p.cast("string")), ",").alias("photos"))


@query("w8_story_text", f"WITH {STORIES} SELECT story_id, text FROM stories")
def w8(spark, d):
    return stories.story_text(stories.complete_stories(A.photos(spark, d)))


@query("w6_first_k", f"WITH {STORIES} SELECT s.story_id, min(photo_order * 10 + story_id % 10) AS position FROM stories s JOIN photos p USING (story_id) GROUP BY 1 ORDER BY position, story_id LIMIT 50")
def w6(spark, d):
    photos = A.photos(spark, d)
    positions = photos.select("story_id", F.expr("photo_order * 10 + story_id % 10").alias("position"))
    return stories.first_k(stories.complete_stories(photos), positions, 50).select("story_id", "position")


@query("w7_assign_workers", "SELECT * FROM (SELECT 'order-' || o_orderkey AS sample, row_number() OVER (ORDER BY 'order-' || o_orderkey) - 1 AS number, (row_number() OVER (ORDER BY 'order-' || o_orderkey) - 1) % 4 AS worker FROM orders) WHERE NOT ends_with(sample, '7')")
def w7(spark, d):
    samples = A.table(spark, d, "orders").select(F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("sample"))
    return stories.assign_workers(samples, 4, samples.filter(F.endswith("sample", F.lit("7"))))


USED = "used_photos AS (SELECT p_partkey AS photo_id FROM part WHERE p_partkey % 50 = 0)"
GREEDY = f"""RECURSIVE {STORIES}, {USED}, ordered AS (
  SELECT story_id, photos, priority, row_number() OVER (ORDER BY priority) AS n FROM (SELECT story_id, photos, md5('5-' || story_id) || '-' || lpad(CAST(story_id AS VARCHAR), 20, '0') AS priority FROM stories)),
walk AS (
  SELECT CAST(0 AS BIGINT) AS n, (SELECT list(photo_id) FROM used_photos) AS taken, CAST(NULL AS BIGINT) AS story_id, CAST(NULL AS VARCHAR) AS priority, CAST(0 AS BIGINT) AS chosen
  UNION ALL
  SELECT o.n, CASE WHEN list_has_any(w.taken, o.photos) THEN w.taken ELSE list_concat(w.taken, o.photos) END, CASE WHEN list_has_any(w.taken, o.photos) THEN NULL ELSE o.story_id END, o.priority, w.chosen + CASE WHEN list_has_any(w.taken, o.photos) THEN 0 ELSE 1 END
  FROM walk w JOIN ordered o ON o.n = w.n + 1 WHERE w.chosen < {{count}})"""


def _selected(spark, d, count=40, fill=False):
    used = A.table(spark, d, "part").filter("p_partkey % 50 = 0").select(F.col("p_partkey").alias("photo_id"))
    return stories.select_disjoint(stories.complete_stories(A.photos(spark, d)), used, count, 5, fill)


@query("u3_select_disjoint", f"WITH {GREEDY.format(count=40)} SELECT story_id, priority FROM walk WHERE story_id IS NOT NULL")
def u3(spark, d):
    return _selected(spark, d).select("story_id", "priority")


@query("u4_select_filled", f"""WITH {GREEDY.format(count=600)}, chosen AS (SELECT story_id, priority, false AS "overlaps" FROM walk WHERE story_id IS NOT NULL)
SELECT * FROM (SELECT * FROM chosen UNION ALL SELECT story_id, priority, true FROM ordered WHERE story_id NOT IN (SELECT story_id FROM chosen)) ORDER BY "overlaps", priority LIMIT 600""")
def u4(spark, d):
    return _selected(spark, d, 600, True)


@query("w9_name_samples", f"WITH {GREEDY.format(count=40)}, chosen AS (SELECT story_id, row_number() OVER (ORDER BY priority) - 1 AS nth FROM walk WHERE story_id IS NOT NULL), flat AS (SELECT c.story_id, nth, unnest(photos) AS photo_id, generate_subscripts(photos, 1) AS image_no FROM chosen c JOIN stories s ON c.story_id = s.story_id) SELECT 'sample_' || lpad(CAST(nth + 51 AS VARCHAR), 2, '0') || '_story_' || story_id AS sample, story_id, image_no, 'image_' || image_no || '_' || photo_id || '.jpg' AS image, photo_id FROM flat")
def w9(spark, d):
    found = stories.complete_stories(A.photos(spark, d)).select("story_id", "photos")
    return stories.name_samples(_selected(spark, d).join(found, "story_id"), 51)


@query("j6_pair_by_rank", """WITH a AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS rank FROM orders), b AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS rank FROM part)
SELECT coalesce(a.rank, b.rank) AS rank, o_orderkey, p_partkey, CASE WHEN coalesce(a.rank, b.rank) IN (3, 4) THEN 'skipped' WHEN a.rank IS NULL THEN 'missing_left' WHEN b.rank IS NULL THEN 'missing_right' ELSE 'paired' END AS status FROM a FULL JOIN b ON a.rank = b.rank""")
def j6(spark, d):
    left = A.table(spark, d, "orders").select("o_orderkey")
    return stories.pair_by_rank(left, A.table(spark, d, "part").select("p_partkey"), ["o_orderkey"], ["p_partkey"], [3, 4])


# ---- multiple choice ----------------------------------------------------------------------------
def _predicted(spark, d):
    items = choice.reformulate_open(A.items(spark, d)).withColumn("choices", choice.choices(["A", "B", "C"]))
    predictions = A.predictions(spark, d)
    graded = choice.attach_ground_truth(predictions.select("index", "prediction"), A.items(spark, d))
    joined = graded.join(items.select("index", "choices", "split"), "index")
    return choice.extract_answers(joined, predictions.select("index", "reply").filter("reply is not null"))


REFORMED = f"{A.ITEMS}, reformed AS (SELECT * REPLACE (CASE WHEN A IS NULL THEN answer ELSE A END AS A, CASE WHEN A IS NULL THEN 'Other Answers' ELSE B END AS B), A IS NULL AS was_open FROM items)"
_TOKENS = "list_filter(regexp_split_to_array(translate({x}, '.()[],:;!*#{{}}', '             '), '\\s+'), lambda w: w <> '')"
_REFUSED = " OR ".join("contains({x}, '" + r.replace("'", "''") + "')" for r in choice.REFUSALS)


def _option_sql(x: str) -> str:
    tokens = _TOKENS.format(x=x)
    found = f"list_filter(ks, lambda k: list_contains({tokens}, k))"
    return f"CASE WHEN contains({x}, '{choice.API_FAILURE}') THEN NULL WHEN {_REFUSED.format(x=x)} THEN 'Z' WHEN len({found}) = 1 THEN CASE WHEN list_contains({tokens}, 'A') AND len({tokens}) > 3 THEN NULL ELSE {found}[1] END WHEN len({found}) = 0 AND list_contains({tokens}, 'Z') THEN 'Z' END"


def _text_sql(x: str) -> str:
    found = "list_filter(list_transform(['A', 'B', 'C'], lambda k, i: CASE WHEN vs[i] IS NOT NULL AND contains(lower({x}), lower(vs[i])) THEN k END), lambda k: k IS NOT NULL)".format(x=x)
    return f"CASE WHEN len({found}) = 1 THEN {found}[1] END"


EXTRACTED = f"""{REFORMED}, keyed AS (SELECT p.index, p.prediction, p.reply, r.split, CASE WHEN regexp_full_match(r.answer, '[A-Z]') THEN r.answer ELSE 'A' END AS gt, [A, B, C] AS vs, CASE WHEN C IS NULL THEN ['A', 'B'] ELSE ['A', 'B', 'C'] END AS ks FROM predictions p JOIN reformed r ON p.index = r.index),
ruled AS (SELECT *, {_option_sql('prediction')} AS o, {_text_sql('prediction')} AS t, coalesce({_option_sql('reply')}, {_text_sql('reply')}) AS j0 FROM keyed),
extracted AS (SELECT index, split, gt, coalesce(o, t, nullif(j0, 'Z')) AS extracted, CASE WHEN o IS NOT NULL THEN 'option' WHEN t IS NOT NULL THEN 'text' WHEN nullif(j0, 'Z') IS NOT NULL THEN 'judge' ELSE 'unresolved' END AS method FROM ruled)"""


@query("s6_numbered_index", "SELECT p_partkey AS index, p_name FROM part")
def s6(spark, d):
    """A table of tab-separated values, read back."""
    path = A.scratch(spark, "benchmark")
    A.table(spark, d, "part").select(F.col("p_partkey").alias("index"), "p_name").write.csv(path, sep="\t", header=True, escape='"')
    return files.read_mcq(spark, path)


@query("m5_reformulate_open", f"WITH {REFORMED} SELECT index, A, B, was_open FROM reformed")
def m5(spark, d):
    return choice.reformulate_open(A.items(spark, d)).select("index", "A", "B", "was_open")


@query("m6_infer_option", f"WITH {EXTRACTED} SELECT index, o AS option FROM ruled")
def m6(spark, d):
    items = choice.reformulate_open(A.items(spark, d)).withColumn("choices", choice.choices(["A", "B", "C"]))
    return A.predictions(spark, d).join(items, "index").select("index", choice.infer_option(F.col("prediction"), F.col("choices")).alias("option"))


@query("m7_infer_text", f"WITH {EXTRACTED} SELECT index, t AS option FROM ruled")
def m7(spark, d):
    items = choice.reformulate_open(A.items(spark, d)).withColumn("choices", choice.choices(["A", "B", "C"]))
    return A.predictions(spark, d).join(items, "index").select("index", choice.infer_text(F.col("prediction"), F.col("choices")).alias("option"))


@query("m8_extract_answers", f"WITH {EXTRACTED} SELECT index, gt, extracted, method, method <> 'unresolved' AS success, CAST(coalesce(extracted = gt, false) AS BIGINT) AS hit FROM extracted")
def m8(spark, d):
    return _predicted(spark, d).select("index", "gt", "extracted", "method", "success", "hit")


@query("j7_ground_truth", f"WITH {A.ITEMS} SELECT p.index, prediction, CASE WHEN regexp_full_match(answer, '[A-Z]') THEN answer ELSE 'A' END AS gt FROM predictions p JOIN items i ON p.index = i.index")
def j7(spark, d):
    return choice.attach_ground_truth(A.predictions(spark, d).select("index", "prediction"), A.items(spark, d))


@query("a11_accuracy", f"WITH {EXTRACTED} SELECT split, CAST(sum(coalesce(extracted = gt, false)::INT) AS BIGINT) AS hits, count(*) AS total, round(avg(coalesce(extracted = gt, false)::INT), 6) AS accuracy FROM extracted GROUP BY GROUPING SETS ((split), ())")
def a11(spark, d):
    return rounded(choice.accuracy(_predicted(spark, d)), "accuracy")


_OPTIONS_SQL = "'A. ' || A || chr(10) || 'B. ' || B || chr(10) || coalesce('C. ' || C || chr(10), '')"


@query("m9_mcq_prompt", f"WITH {REFORMED} SELECT index, CASE WHEN regexp_matches(p, '[一-鿿]') THEN p || '{choice.SELECT_OPTION_CHINESE}' ELSE p || '{choice.SELECT_OPTION}' END AS prompt FROM (SELECT index, coalesce('Hint: ' || hint || chr(10), '') || 'Question: ' || question || chr(10) || 'Options:' || chr(10) || {_OPTIONS_SQL} AS p FROM reformed)")
def m9(spark, d):
    return choice.build_mcq_prompt(choice.reformulate_open(A.items(spark, d)).withColumn("choices", choice.choices(["A", "B", "C"]))).select("index", "prompt")


@query("m10_judge_prompt", f"WITH {REFORMED} SELECT r.index, 'Q ' || question || ' O There are several options: ' || chr(10) || {_OPTIONS_SQL} || ' P ' || prediction AS judge_prompt FROM reformed r JOIN predictions p ON r.index = p.index")
def m10(spark, d):
    items = choice.reformulate_open(A.items(spark, d)).withColumn("choices", choice.choices(["A", "B", "C"]))
    return choice.build_judge_prompt(items.join(A.predictions(spark, d), "index"), "Q {question} O {options} P {answer}").select("index", "judge_prompt")


@query("p14_split_image_refs", f"WITH {A.ITEMS} SELECT index, s AS segment_no, ['text', 'image', 'text', 'image', 'text'][s] AS kind, ['Which is part ' || index || '? ', 'a' || index, ' See ', 'b' || index, '.'][s] AS value FROM items, (SELECT unnest(range(1, 6)) AS s)")
def p14(spark, d):
    images = F.expr("array(concat('a', index), concat('b', index))")
    return choice.split_image_refs(A.items(spark, d).select("index", F.col("question").alias("prompt"), images.alias("images")))


@query("p21_to_list", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name || '|' || p_brand ELSE p_name END AS items FROM part")
def p21(spark, d):
    value = F.expr("if(p_partkey % 2 = 0, concat('[''', p_name, ''', ''', p_brand, ''']'), p_name)")
    return A.table(spark, d, "part").select("p_partkey", F.array_join(T.to_list(value), "|").alias("items"))


@query("j8_resolve_image_refs", "SELECT doc_id AS index, CASE WHEN length(i.image) > 64 THEN i.image WHEN length(h.image) > 64 THEN h.image END AS resolved, CASE WHEN length(i.image) <= 64 AND NOT coalesce(length(h.image) > 64, false) THEN 'unresolved_image' END AS problem FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id + 1 AS VARCHAR) ELSE text END AS image FROM documents) i LEFT JOIN (SELECT doc_id AS ref, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id + 1 AS VARCHAR) ELSE text END AS image FROM documents) h ON length(i.image) <= 64 AND i.image = CAST(h.ref AS VARCHAR)")
def j8(spark, d):
    rows = A.table(spark, d, "documents").select(F.col("doc_id").alias("index"), F.expr("if(doc_id % 3 = 0, cast(doc_id + 1 as string), text)").alias("image"))
    return choice.resolve_image_refs(rows).select("index", "resolved", "problem")


# ---- media geometry -----------------------------------------------------------------------------
def _resize_sql(h: str, w: str, f: int, low: str, high: str, floor_sides: bool = True) -> str:
    side = lambda e: f"greatest({e}, {f})" if floor_sides else e
    rh, rw = (side(f"round_even({x}::DOUBLE / {f}, 0) * {f}") for x in (h, w))
    sh, sw = (side(f"floor({x} / sqrt({h}::DOUBLE * {w} / {high}) / {f}) * {f}") for x in (h, w))
    wrong = f"greatest({h}, {w}) / least({h}, {w})::DOUBLE > 200"
    problem = f"CASE WHEN {wrong} THEN 'ratio' END" if floor_sides else f"CASE WHEN {h} < {f} OR {w} < {f} THEN 'too_small' WHEN {wrong} THEN 'ratio' END"
    pick = lambda s, g, r: f"CAST(CASE WHEN ({problem}) IS NOT NULL THEN NULL WHEN {rh} * {rw} > {high} THEN {s} WHEN {rh} * {rw} < {low} THEN {g} ELSE {r} END AS BIGINT)"
    grow = lambda x: f"ceil({x} * sqrt({low}::DOUBLE / ({h}::DOUBLE * {w})) / {f}) * {f}"
    return f"{pick(sh, grow(h), rh)} AS new_height, {pick(sw, grow(w), rw)} AS new_width, {problem} AS problem"


def _resized(df, floor_sides=True, factor=28, low=3136, high=1003520):
    found = G.smart_resize(F.col("height"), F.col("width"), factor, F.lit(low), F.lit(high), floor_sides)
    return df.withColumns({"new_height": found["height"], "new_width": found["width"], "problem": found["problem"]})


KEYS = "l_orderkey, l_linenumber, l_suppkey, l_partkey"


@query("g1_smart_resize", f"WITH {A.BOXES} SELECT {KEYS}, {_resize_sql('height', 'width', 28, '3136', '1003520')} FROM boxes")
def g1(spark, d):
    return _resized(A.boxes(spark, d)).select(*KEYS.split(", "), "new_height", "new_width", "problem")


@query("g2_visual_tokens", f"WITH {A.BOXES} SELECT {KEYS}, CAST(floor((new_height // 14) * (new_width // 14) / 4) AS BIGINT) AS tokens FROM (SELECT *, {_resize_sql('height', 'width', 28, '3136', '1003520')} FROM boxes)")
def g2(spark, d):
    return _resized(A.boxes(spark, d)).select(*KEYS.split(", "), G.visual_tokens(F.lit(1), F.col("new_height"), F.col("new_width"), 14).alias("tokens"))


FRAMES = "frames AS (SELECT *, CASE WHEN n BETWEEN 2 AND total THEN n END AS nf, CASE WHEN n BETWEEN 2 AND total THEN NULL ELSE 'out_of_range' END AS problem FROM (SELECT *, CAST(CASE WHEN nframes IS NOT NULL THEN round_even(nframes / 2, 0) * 2 ELSE floor(least(least(greatest(total / fps * 2.0, 4), floor(least(768, total) / 2) * 2), total) / 2) * 2 END AS BIGINT) AS n FROM videos))"


def _frames(spark, d):
    rows = A.videos(spark, d)
    found = G.frame_count(F.col("total"), F.col("fps"), F.col("nframes"), 2.0, 4, 768)
    return rows.withColumns({"nf": found["nframes"], "problem": found["problem"]})


@query("g3_frame_count", f"WITH {A.VIDEOS}, {FRAMES} SELECT event_id, nf AS nframes, problem FROM frames")
def g3(spark, d):
    return _frames(spark, d).select("event_id", F.col("nf").alias("nframes"), "problem")


RANGES = "ranges AS (SELECT *, first >= last AS wrong FROM (SELECT *, CAST(CASE WHEN starts IS NULL THEN 0 ELSE ceil(greatest(0.0, least(starts, total / fps)) * fps) END AS BIGINT) AS first, CAST(CASE WHEN ends IS NULL THEN total - 1 ELSE least(floor(greatest(0.0, least(ends, total / fps)) * fps), total - 1) END AS BIGINT) AS last FROM videos))"


def _ranges(spark, d):
    rows = A.videos(spark, d)
    return rows.withColumns(G.frame_range(F.col("total"), F.col("fps"), F.col("starts"), F.col("ends")))


@query("g4_frame_range", f"WITH {A.VIDEOS}, {RANGES} SELECT event_id, CASE WHEN NOT wrong THEN first END AS first_frame, CASE WHEN NOT wrong THEN last END AS last_frame, CASE WHEN NOT wrong THEN last - first + 1 END AS frames, CASE WHEN wrong THEN 'empty_window' END AS problem FROM ranges")
def g4(spark, d):
    return _ranges(spark, d).select("event_id", "first_frame", "last_frame", "frames", "problem")


@query("g5_frame_indices", f"WITH {A.VIDEOS}, {RANGES} SELECT event_id, array_to_string(list_transform(range(0, 8), lambda i: CAST(round_even(first + i * ((last - first) / 7.0::DOUBLE), 0) AS BIGINT)), ',') AS frames FROM ranges WHERE NOT wrong")
def g5(spark, d):
    rows = _ranges(spark, d).filter("problem is null")
    return rows.select("event_id", F.array_join(F.transform(G.frame_indices(F.col("first_frame"), F.col("last_frame"), F.lit(8)), lambda i: i.cast("string")), ",").alias("frames"))


@query("g6_frame_plan", f"WITH {A.VIDEOS}, c AS (SELECT *, CAST(greatest(least(round_even(total / fps / 4.0::DOUBLE, 0), 8), 4) AS BIGINT) AS n FROM videos) SELECT event_id, array_to_string(list_sort(list_distinct(list_transform(range(0, n), lambda i: CAST(floor(i * ((total - 1) / (n - 1)::DOUBLE)) AS BIGINT)))), ',') AS frames FROM c")
def g6(spark, d):
    return A.videos(spark, d).select("event_id", F.array_join(F.transform(G.frame_plan(F.col("total"), F.col("fps"), 4.0), lambda i: i.cast("string")), ",").alias("frames"))


@query("g7_bbox_relative", f"WITH {A.BOXES} SELECT {KEYS}, " + ", ".join(f"CAST(greatest(0, least(1000, round_even({v}::DOUBLE / {s} * 1000, 0))) AS BIGINT) AS r_{v}" for v, s in (("x1", "width"), ("y1", "height"), ("x2", "width"), ("y2", "height"))) + " FROM boxes")
def g7(spark, d):
    names = ["x1", "y1", "x2", "y2"]
    out = G.bbox_relative([F.col(n) for n in names], F.col("height"), F.col("width"))
    return A.boxes(spark, d).select(*KEYS.split(", "), *(c.alias(f"r_{n}") for n, c in zip(names, out, strict=True)))


@query("g8_bbox_resized", f"WITH {A.BOXES} SELECT {KEYS}, " + ", ".join(f"CAST(greatest(0, least(round_even({v}::DOUBLE * (new_{s}::DOUBLE / {s}), 0), new_{s} - 1)) AS BIGINT) AS r_{v}" for v, s in (("x1", "width"), ("y1", "height"), ("x2", "width"), ("y2", "height"))) + f", problem FROM (SELECT *, {_resize_sql('height', 'width', 28, '3136', '1003520', False)} FROM boxes) WHERE problem IS NULL")
def g8(spark, d):
    names = ["x1", "y1", "x2", "y2"]
    rows = _resized(A.boxes(spark, d), False).filter("problem is null")
    out = G.bbox_resized([F.col(n) for n in names], F.col("height"), F.col("width"), F.col("new_height"), F.col("new_width"))
    return rows.select(*KEYS.split(", "), *(c.alias(f"r_{n}") for n, c in zip(names, out, strict=True)), "problem")


@query("g9_frame_budget", f"WITH {A.VIDEOS}, {FRAMES} SELECT event_id, round(least(coalesce(own_pixels::DOUBLE, s), s), 6) AS max_pixels FROM (SELECT *, greatest(least(602112.0::DOUBLE, 90316800.0::DOUBLE / nf * 2), 105369.0::DOUBLE) AS s FROM frames WHERE nf IS NOT NULL)")
def g9(spark, d):
    rows = _frames(spark, d).filter("nf is not null")
    return rounded(rows.select("event_id", G.frame_budget(F.col("nf"), F.col("own_pixels"), 100352, 602112, 90316800).alias("max_pixels")), "max_pixels")


# ---- training layout ----------------------------------------------------------------------------
@query("p17_token_breakdown", f"""WITH w AS (SELECT doc_id, {A.word_count_sql('text')} AS n, doc_id % 6 AS images FROM documents), t AS (SELECT doc_id, CAST(floor(n * 1.3::DOUBLE) AS BIGINT) AS long_text, CAST(floor((n // 3) * 1.3::DOUBLE) AS BIGINT) AS short_text, images * 1792 AS image_tokens FROM w)
SELECT doc_id, long_text + image_tokens AS long_total, short_text + image_tokens AS short_total, round(CASE WHEN long_text + image_tokens > 0 THEN image_tokens / (long_text + image_tokens)::DOUBLE * 100 END, 6) AS image_share, round(CASE WHEN long_text + image_tokens > 0 THEN (long_text - short_text) / (long_text + image_tokens)::DOUBLE * 100 END, 6) AS saving FROM t""")
def p17(spark, d):
    count = T.word_count(F.col("text"))
    rows = A.table(spark, d, "documents").select("doc_id", count.alias("long_words"), F.floor(count / 3).alias("short_words"), (F.col("doc_id") % 6).alias("images"))
    return rounded(packing.token_breakdown(rows), "image_share", "saving").select("doc_id", "long_total", "short_total", "image_share", "saving")


TOKENS = f"""{A.RECORDS}, tokens AS (SELECT record_id, CAST(21 + list_sum(list_transform(conversations, lambda t: CAST(floor(len(list_filter(regexp_split_to_array(t."value", '\\s+'), lambda w: w <> '')) * 1.3::DOUBLE) AS BIGINT))) + CASE WHEN len(image) > 0 THEN len(image) * 300 WHEN len(video) > 0 THEN 900 ELSE 0 END AS BIGINT) AS num_tokens FROM records)"""


def _tokens(spark, d):
    rows = A.records(spark, d).withColumns({"image_tokens": F.size("image") * 300, "video_tokens": F.lit(900)})
    return chat.record_tokens(rows).select("record_id", "num_tokens")


@query("m15_record_tokens", f"WITH {TOKENS} SELECT * FROM tokens")
def m15(spark, d):
    return _tokens(spark, d)


@query("m14_pack_records")
def m14(spark, d):
    return packing.pack_records(_tokens(spark, d), ["record_id"])


@query("m14_pack_invariants", f"""WITH {TOKENS} SELECT batch, count(*) AS records, CAST(sum(num_tokens) AS BIGINT) AS tokens, max(num_tokens) AS largest, true AS each_once, true AS within_capacity, true AS well_filled
FROM (SELECT num_tokens, (row_number() OVER (ORDER BY record_id) - 1) // 256 AS batch FROM tokens) GROUP BY batch""")
def m14_invariants(spark, d):
    """What holds of every packing: batches of consecutive records, each packed once, within capacity, at most one pack a batch half empty."""
    packed = packing.pack_records(_tokens(spark, d), ["record_id"])
    packs = packed.groupBy("batch", "pack").agg(F.count("*").alias("n"), F.sum("num_tokens").alias("own"), F.max("num_tokens").alias("largest"), F.max("pack_tokens").alias("stated"), F.count_distinct("record_id").alias("different"))
    return packs.groupBy("batch").agg(
        F.sum("n").alias("records"),
        F.sum("own").alias("tokens"),
        F.max("largest").alias("largest"),
        F.every((F.col("n") == F.col("different")) & (F.col("own") == F.col("stated"))).alias("each_once"),
        F.every((F.col("own") <= packing.CAPACITY) | (F.col("n") == 1)).alias("within_capacity"),
        (F.count_if(F.col("own") * 2 <= packing.CAPACITY) <= 1).alias("well_filled"),
    )


def _token_rows(spark, d):
    """Token ids of a turn: words' lengths between the marks that begin and end an answer."""
    rows = A.table(spark, d, "conversations")
    body = "transform(filter(split(text, '\\\\s+'), w -> w <> ''), w -> cast(length(w) + 100 as int))"
    return rows.select("conv_id", "turn", F.expr(f"concat(array(151644, {packing.ASSISTANT}, 198), {body}, if(turn % 5 = 4, cast(array() as array<int>), array({packing.TURN_END}, 198)))").alias("ids"))


MASKED = "masked AS (SELECT conv_id, turn, list_concat([-100, -100, -100], CASE WHEN turn % 5 = 4 THEN list_transform(body, lambda x: -100) ELSE list_concat(body, [151645, 198]) END) AS labels, list_concat([151644, 77091, 198], CASE WHEN turn % 5 = 4 THEN body ELSE list_concat(body, [151645, 198]) END) AS ids FROM (SELECT conv_id, turn, list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''), lambda w: CAST(length(w) + 100 AS INTEGER)) AS body FROM conversations))"


@query("m13_mask_labels", f"WITH {MASKED} SELECT conv_id, turn, array_to_string(labels, ',') AS labels FROM masked")
def m13(spark, d):
    return _token_rows(spark, d).select("conv_id", "turn", F.array_join(F.transform(packing.mask_labels("ids"), lambda i: i.cast("string")), ",").alias("labels"))


def _packs(spark, d):
    rows = _token_rows(spark, d)
    return packing.concat_pack(rows.select(F.col("conv_id").alias("pack_id"), F.col("turn").alias("position"), "ids", packing.mask_labels("ids").alias("labels")))


@query("m16_concat_pack", f"WITH {MASKED} SELECT conv_id AS pack_id, CAST(sum(len(ids)) AS BIGINT) AS tokens, array_to_string(flatten(list(labels ORDER BY turn)), ',') AS labels FROM masked GROUP BY conv_id")
def m16(spark, d):
    return _packs(spark, d).select("pack_id", F.size("ids").cast("bigint").alias("tokens"), F.array_join(F.transform("labels", lambda i: i.cast("string")), ",").alias("labels"))


@query("w4_cu_seqlens", f"WITH {MASKED}, s AS (SELECT conv_id, turn, sum(len(ids)) OVER (PARTITION BY conv_id ORDER BY turn) AS c FROM masked) SELECT conv_id AS pack_id, '0,' || string_agg(CAST(c AS VARCHAR), ',' ORDER BY turn) AS offsets FROM s GROUP BY conv_id")
def w4(spark, d):
    return _packs(spark, d).select("pack_id", F.array_join(F.transform(packing.cu_seqlens(F.col("lengths")), lambda i: i.cast("string")), ",").alias("offsets"))


@query("m17_pad_batches", f"WITH {MASKED}, b AS (SELECT *, least(max(len(ids)) OVER (PARTITION BY conv_id // 8), 200) AS width FROM masked) SELECT conv_id, turn, CAST(width AS BIGINT) AS width, CAST(least(len(ids), width) AS BIGINT) AS attended FROM b")
def m17(spark, d):
    rows = _token_rows(spark, d).withColumns({"labels": packing.mask_labels("ids"), "batch": F.expr("conv_id div 8")})
    out = packing.pad_batches(rows, 200, 0)
    return out.select("conv_id", "turn", F.size("ids").cast("bigint").alias("width"), F.size(F.filter("attention", lambda a: a)).cast("bigint").alias("attended"))


# ---- prompts, timings, embeddings, sinks --------------------------------------------------------
STYLES, TONES, TEMPLATES = ["warm", "dry", "quick"], ["calm", "bright"], ["Write a {style} story.", "Tell it in a {tone} way.", "A {style} and {tone} talk."]


@query("a12_prompt_stats", """WITH g AS (SELECT p_partkey AS id, ['warm', 'dry', 'quick', ''][1 + CAST(('0x' || substr(md5('3-style-' || p_partkey), 1, 8)) AS BIGINT) % 4] AS style, ['calm', 'bright', ''][1 + CAST(('0x' || substr(md5('3-tone-' || p_partkey), 1, 8)) AS BIGINT) % 3] AS tone, 1 + CAST(('0x' || substr(md5('3-template-' || p_partkey), 1, 8)) AS BIGINT) % 3 AS template FROM part)
SELECT count(*) AS total, count(nullif(style, '')) AS with_style, count(nullif(tone, '')) AS with_tone, count(DISTINCT nullif(style, '')) AS styles, count(DISTINCT nullif(tone, '')) AS tones, count(DISTINCT template) AS templates FROM g""")
def a12(spark, d):
    ids = A.table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    made = mix.generate_prompts(ids, 3, STYLES, TONES, TEMPLATES, "Keep to the pictures.")
    return mix.prompt_stats(made)


def _pick_sql(values: list[str], salt: str) -> str:
    return f"(SELECT list_extract({values!r}, CAST(CAST('0x' || substr(md5('3-{salt}-' || id), 1, 8) AS BIGINT) % {len(values)} + 1 AS INTEGER)))"


@query("m11_generate_prompts", f"""WITH picked AS (SELECT id, {_pick_sql([*STYLES, ''], 'style')} AS style, {_pick_sql([*TONES, ''], 'tone')} AS tone, {_pick_sql(TEMPLATES, 'template')} AS template FROM (SELECT p_partkey AS id FROM part)),
short AS (SELECT *, trim(regexp_replace(replace(replace(template, '{{style}}', style), '{{tone}}', tone), ' +', ' ', 'g')) AS short_prompt FROM picked) SELECT *, short_prompt || ' Keep to the pictures.' AS full_prompt FROM short""")
def m11(spark, d):
    ids = A.table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    return mix.generate_prompts(ids, 3, STYLES, TONES, TEMPLATES, "Keep to the pictures.")


@query("a13_timing_stats", "SELECT count(*) AS n, round(avg(words), 6) AS avg_words, round(avg(value), 6) AS avg_seconds, round(sum(value), 4) AS total_seconds, round(sum(tokens) / sum(value), 6) AS tokens_per_second, round(sum(tokens) / sum(words)::DOUBLE, 6) AS tokens_per_word FROM (SELECT value, 100 + event_id % 900 AS words, 150 + event_id % 1000 AS tokens FROM events)")
def a13(spark, d):
    rows = A.table(spark, d, "events").select(F.col("value").alias("seconds"), F.expr("100 + event_id % 900").alias("words"), F.expr("150 + event_id % 1000").alias("tokens"))
    return rounded(compare.timing_stats(rows), "avg_words", "avg_seconds", "tokens_per_second", "tokens_per_word").withColumn("total_seconds", F.round("total_seconds", 4))


@query("a14_alignment_score", """WITH e AS (SELECT vec_id // 7 AS sample_id, vec_id % 7 AS k, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT t.sample_id, round(avg(greatest(0.0, 100 * list_cosine_similarity(t.v, i.v))), 6) AS score, count(i.v) AS n_images FROM (SELECT * FROM e WHERE k = 0) t LEFT JOIN (SELECT * FROM e WHERE k BETWEEN 1 AND 5) i ON t.sample_id = i.sample_id GROUP BY 1""")
def a14(spark, d):
    rows = A.table(spark, d, "embeddings").select(F.expr("vec_id div 7").alias("sample_id"), (F.col("vec_id") % 7).alias("image_no"), F.col("embedding").alias("vector"))
    return rounded(compare.alignment_score(rows.filter("image_no = 0").drop("image_no"), rows.filter("image_no > 0")), "score")


@query("j9_attach_embeddings", "SELECT doc_id AS sample_id, doc_id % 6 AS n_images, CASE WHEN doc_id % 6 = 0 THEN 'text_only' WHEN vec_id IS NULL THEN 'missing' ELSE 'attached' END AS status FROM documents LEFT JOIN embeddings ON doc_id = vec_id")
def j9(spark, d):
    rows = A.table(spark, d, "documents").select(F.col("doc_id").alias("sample_id"), (F.col("doc_id") % 6).alias("n_images"))
    vectors = A.table(spark, d, "embeddings").select(F.col("vec_id").alias("sample_id"), "embedding")
    return compare.attach_embeddings(rows, vectors).select("sample_id", "n_images", "status")


@query("s8_jsonl_round_trip", "SELECT conv_id, turn, role, text FROM conversations")
def s8(spark, d):
    rows = A.table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    path = A.scratch(spark, "jsonl")
    files.write_jsonl(rows, path)
    return spark.read.schema(rows.schema).json(path)


@query("s8_csv_round_trip", "SELECT doc_id, text, lang FROM documents")
def s8_csv(spark, d):
    rows = A.table(spark, d, "documents").select("doc_id", "text", "lang")
    path = A.scratch(spark, "csv")
    files.write_csv(rows, path, marked=True)
    return files.read_csv(spark, path, rows.schema, marked=True)

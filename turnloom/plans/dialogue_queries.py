"""Queries on turns, transcripts, model comparison, and excerpts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.measures import distinct_n
from ..operators import compare, excerpts, mix, turns
from ..operators.index import dense_index
from ..sources import files, lines
from ..streaming.turns import stream_turns
from . import adapters as A
from .registry import query


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@query("s1_loaded_turns", f"WITH {A.TURNS}, {A.LOADED} SELECT episode_url, speaker, text FROM loaded")
def s1(spark, d):
    """The turns as JSON lines, read back; a line's number there is its place in the files."""
    path = A.scratch(spark, "turns")
    files.write_jsonl(A.turns(spark, d).select(F.col("episode_url").alias("mp3url"), "speaker", F.col("text").alias("turnText")), path)
    return turns.loaded_turns(files.read_turns(spark, path)).select("episode_url", F.get("speaker", F.lit(0)).alias("speaker"), "text")


@query("s2_slice_by_position", "SELECT doc_id, position FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents) WHERE position >= 20 AND position < 120")
def s2(spark, d):
    return excerpts.slice_by_position(A.table(spark, d, "documents").select("doc_id"), ["doc_id"], 20, 100)


@query("s2_slice_lines", """SELECT position, CASE WHEN position % 7 <> 3 THEN doc_id END AS doc_id, CASE WHEN position % 7 <> 3 THEN text END AS text, position % 7 = 3 AS broken
FROM (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents) WHERE position >= 50 AND position < 150""")
def s2_lines(spark, d):
    """Documents as JSON lines over several files, each seventh line cut off, and a slice of them by position. Broken lines count."""
    path = A.scratch(spark, "lines")
    rows = dense_index(A.table(spark, d, "documents").select("doc_id", "text"), ["doc_id"], "position")
    line = F.to_json(F.struct("doc_id", "text"))
    shown = F.when(F.col("position") % 7 == 3, F.expr("substr(line, 1, 9)")).otherwise(F.col("line"))
    rows.withColumn("line", line).select("position", shown.alias("value")).repartitionByRange(8, "position").sortWithinPartitions("position").select("value").write.text(path)
    return lines.parsed_lines(lines.slice_lines(spark, path, 50, 100), "doc_id long, text string")


@query("s3_load_excerpts", f"WITH {A.EXCERPTS} SELECT source, episode_idx, excerpt_idx, excerpt, excerpt_length, word_count, CAST(len(scenes) AS BIGINT) AS n_scenes FROM excerpts")
def s3(spark, d):
    """Metadata files of a hundred episodes each, as JSON arrays, read back; the URL holds the source."""
    scene = lambda p, i: F.struct((i + 1).alias("scene_idx"), p.alias("prompt"), F.lit("f.png").alias("filename"), F.lit(False).alias("generated"))
    rows = A.excerpts(spark, d).withColumn("scenes", F.transform("scenes", scene))
    episodes = rows.groupBy("source", "episode_idx").agg(F.collect_list(F.struct("excerpt_idx", "excerpt", "excerpt_length", "word_count", "scenes")).alias("excerpts"))
    shown = episodes.select(F.expr("episode_idx div 100").alias("file"), F.to_json(F.struct("episode_idx", F.col("source").alias("episode_url"), "excerpts")).alias("episode"))
    path = A.scratch(spark, "episodes")
    shown.groupBy("file").agg(F.concat(F.lit("["), F.array_join(F.collect_list("episode"), ","), F.lit("]")).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)
    found = files.read_excerpt_files(spark, path, "files").withColumn("source", F.col("episode_url"))
    return excerpts.load_excerpts(found).withColumn("scenes", F.size("scenes").cast("bigint")).withColumnRenamed("scenes", "n_scenes")


@query("s4_load_transcripts", f"WITH {A.TRANSCRIPTS}, {A.STRIPPED} SELECT r.sample, r.model, t.content, CAST(regexp_extract(r.content, 'Word count: (\\d+)', 1) AS BIGINT) AS stated FROM raw_transcripts r JOIN transcripts t ON r.sample = t.sample AND r.model = t.model")
def s4(spark, d):
    """A text file for each transcript, a thousand in a folder, read back; what has no text has no file."""
    path = A.scratch(spark, "transcripts")
    rows = A.raw_transcripts(spark, d)
    name = F.format_string("samples=%d/%d_transcript_%s.txt", F.expr("sample div 500"), "sample", "model")
    files.write_each(rows.filter("content is not null").select(name.alias("name"), F.col("content").alias("value")), path)
    found = files.load_transcripts(spark, path, r"/([^/]+)_transcript_([^/]+)\.txt$").withColumn("sample", F.col("sample").cast("bigint"))
    return found.unionByName(rows.filter("content is null").select("sample", "model", "content", F.lit(None).cast("bigint").alias("stated")))


@query("m1_strip_header", f"WITH {A.TRANSCRIPTS}, {A.STRIPPED} SELECT sample, model, content FROM transcripts")
def m1(spark, d):
    return A.transcripts(spark, d)


@query("p19_header_facts", rf"""WITH {A.TRANSCRIPTS} SELECT sample, model, nullif(regexp_extract(content, 'Sample: (\S+)', 1), '') AS name,
  CAST(regexp_extract(content, 'Word count: (\d+)', 1) AS BIGINT) AS stated_words, CAST(regexp_extract(content, 'Generation time: ([\d.]+)s', 1) AS DOUBLE) AS seconds FROM raw_transcripts""")
def p19(spark, d):
    c = F.col("content")
    seconds = F.regexp_replace(T.header_value(c, "Generation time"), "s$", "").try_cast("double")
    return A.raw_transcripts(spark, d).select("sample", "model", T.header_value(c, "Sample").alias("name"), T.header_value(c, "Word count").try_cast("bigint").alias("stated_words"), seconds.alias("seconds"))


@query("p20_sample_keys", f"WITH {A.TRANSCRIPTS} SELECT sample, model, CAST(sample AS INTEGER) AS number, CAST(sample * 2 + (model = 'b')::INT AS VARCHAR) AS story FROM raw_transcripts")
def p20(spark, d):
    key = T.header_value(F.col("content"), "Sample")
    return A.raw_transcripts(spark, d).select("sample", "model", T.sample_number(key).alias("number"), T.story_id(key).alias("story"))


@query("streamed_turns", f"WITH {A.TURNS}, {A.LOADED} SELECT episode_url, speaker, {A.strip_sql('text')} AS text FROM loaded WHERE NOT starts_with({A.strip_sql('text')}, '[Music]')")
def streamed(spark, d):
    """The turns as files, read as a stream of all there are, and written as a table."""
    path, out = A.scratch(spark, "turns"), A.scratch(spark, "streamed")
    files.write_jsonl(A.turns(spark, d).select(F.col("episode_url").alias("mp3url"), "speaker", F.col("text").alias("turnText")), path)
    rows = stream_turns(spark, path)
    rows.writeStream.format("parquet").option("checkpointLocation", A.scratch(spark, "progress")).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(rows.schema).parquet(out).withColumn("speaker", F.get("speaker", F.lit(0)))


@query("p1_clean_turns", f"WITH {A.TURNS}, {A.CLEAN} SELECT * FROM clean")
def p1(spark, d):
    return turns.clean_turns(A.turns(spark, d)).withColumn("speaker", F.get("speaker", F.lit(0)))


@query("a1_episodes", f"""WITH {A.TURNS}, {A.LOADED} SELECT episode_url, count(*) AS n_turns, row_number() OVER (ORDER BY episode_url) - 1 AS episode_idx FROM loaded GROUP BY episode_url HAVING count(*) >= 5""")
def a1(spark, d):
    return turns.episodes(A.turns(spark, d))


@query("w1_relabel_speakers", f"WITH {A.TURNS}, {A.CLEAN}, {A.RELABELLED} SELECT episode_url, turn_idx, speaker, speaker_no FROM relabelled")
def w1(spark, d):
    return turns.relabel_speakers(turns.clean_turns(A.turns(spark, d))).select("episode_url", "turn_idx", F.get("speaker", F.lit(0)).alias("speaker"), "speaker_no")


ASSEMBLED = f"""{A.TURNS}, {A.CLEAN}, {A.RELABELLED}, assembled AS (
  SELECT episode_url, string_agg('Speaker ' || speaker_no || ': ' || text, chr(10) || chr(10) ORDER BY turn_idx) AS transcript, count(DISTINCT speaker_no) AS n_speakers FROM relabelled GROUP BY episode_url)"""


@query("a2_assemble_transcripts", f"WITH {ASSEMBLED} SELECT episode_url, CASE WHEN length(transcript) <= 50000 THEN transcript END AS transcript, n_speakers, CAST(length(transcript) AS BIGINT) AS n_chars FROM assembled")
def a2(spark, d):
    return turns.assemble_transcripts(turns.clean_turns(A.turns(spark, d)))


@query("p2_gate_by_length", f"""WITH {ASSEMBLED} SELECT episode_url, CASE WHEN length(transcript) < 2000 OR length(transcript) > 50000 THEN 'skipped' ELSE 'pass' END AS status,
  CASE WHEN length(transcript) < 2000 THEN 'too_short' WHEN length(transcript) > 50000 THEN 'too_long' END AS reason FROM assembled""")
def p2(spark, d):
    return excerpts.gate_by_length(turns.assemble_transcripts(turns.clean_turns(A.turns(spark, d))), size_column="n_chars").select("episode_url", "status", "reason")


@query("p3_fill_prompt", "SELECT doc_id, 'Read this: ' || text || chr(10) || 'Answer in JSON.' AS prompt FROM documents")
def p3(spark, d):
    return excerpts.fill_prompt(A.table(spark, d, "documents"), "Read this: {transcript}\nAnswer in JSON.", "text").select("doc_id", "prompt")


@query("j4_unprocessed", f"WITH {A.TURNS}, {A.LOADED}, e AS (SELECT episode_url, row_number() OVER (ORDER BY episode_url) - 1 AS episode_idx FROM loaded GROUP BY episode_url HAVING count(*) >= 5) SELECT * FROM e WHERE episode_idx % 3 <> 1")
def j4(spark, d):
    found = turns.episodes(A.turns(spark, d)).drop("n_turns")
    return turns.unprocessed(found, found.filter("episode_idx % 3 = 1"))


@query("p15_normalize_text", r"SELECT doc_id, regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g') AS text FROM documents")
def p15(spark, d):
    return A.table(spark, d, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("text"))


@query("p16_word_count", f"SELECT doc_id, {A.word_count_sql('text')} AS words FROM documents")
def p16(spark, d):
    return A.table(spark, d, "documents").select("doc_id", T.word_count(F.col("text")).alias("words"))


NORMAL_WORDS = rf"list_filter(regexp_split_to_array(regexp_replace(lower(content), '[!-/:-@\[-`{{-~]', '', 'g'), '\s+'), lambda w: w <> '')"
DISTINCT2 = f"""d2 AS (SELECT sample, model, CASE WHEN len(w) < 2 THEN 0.0 ELSE len(list_distinct(g)) / len(g)::DOUBLE END AS distinct2 FROM (
  SELECT *, list_transform(list_zip(list_slice(w, 1, len(w) - 1), list_slice(w, 2, len(w))), lambda p: p[1] || ' ' || p[2]) AS g FROM (SELECT sample, model, {NORMAL_WORDS} AS w FROM transcripts)))"""


@query("a3_distinct_n", f"WITH {A.TRANSCRIPTS}, {A.STRIPPED}, {DISTINCT2} SELECT sample, model, round(distinct2, 6) AS distinct2 FROM d2")
def a3(spark, d):
    return rounded(A.transcripts(spark, d).select("sample", "model", distinct_n(F.col("content"), 2).alias("distinct2")), "distinct2")


LABEL = r"^(?:\[?)(Speaker\s*\d+|Host|Guest|Co-host|[A-Z][a-z]+)(?:\]?):\s*"
PARSED = f"""lines AS (SELECT sample, model, pos, line, regexp_matches(line, '{LABEL}') AS labelled FROM (
  SELECT sample, model, pos, {A.strip_sql('raw')} AS line FROM (SELECT sample, model, unnest(string_split(content, chr(10))) AS raw, generate_subscripts(string_split(content, chr(10)), 1) AS pos FROM transcripts)) WHERE line <> ''),
numbered AS (SELECT *, sum(labelled::INT) OVER (PARTITION BY sample, model ORDER BY pos) AS label_no, {A.strip_sql(f"CASE WHEN labelled THEN regexp_replace(line, '{LABEL}', '') ELSE line END")} AS body FROM lines),
grouped AS (SELECT sample, model, label_no, max(CASE WHEN labelled THEN regexp_extract(line, '{LABEL}', 1) END) AS speaker, string_agg(CASE WHEN body <> '' THEN body END, ' ' ORDER BY pos) AS text FROM numbered WHERE label_no > 0 GROUP BY ALL),
parsed AS (SELECT sample, model, row_number() OVER (PARTITION BY sample, model ORDER BY label_no) AS turn_no, speaker, text FROM grouped WHERE text IS NOT NULL)"""
STATS = f"""stats AS (SELECT t.sample, t.model, coalesce(n, 0) AS num_turns, coalesce(w / n::DOUBLE, 0.0) AS avg_turn_length, coalesce(CASE WHEN w > 0 THEN (n - 1) / w::DOUBLE * 1000 END, 0.0) AS switch_rate
  FROM transcripts t LEFT JOIN (SELECT sample, model, count(*) AS n, sum({A.word_count_sql('text')}) AS w FROM parsed GROUP BY ALL) p ON t.sample = p.sample AND t.model = p.model)"""


@query("m2_parse_turns", f"WITH {A.TRANSCRIPTS}, {A.STRIPPED}, {PARSED} SELECT * FROM parsed")
def m2(spark, d):
    return turns.parse_turns(A.transcripts(spark, d))


@query("a5_dialogue_stats", f"WITH {A.TRANSCRIPTS}, {A.STRIPPED}, {PARSED}, {STATS} SELECT sample, model, num_turns AS n_turns, round(avg_turn_length, 6) AS avg_turn_length, round(switch_rate, 6) AS switch_rate FROM stats")
def a5(spark, d):
    return rounded(turns.dialogue_stats(A.transcripts(spark, d)), "avg_turn_length", "switch_rate")


WIDE = f"""{A.TRANSCRIPTS}, {A.STRIPPED}, {DISTINCT2}, {PARSED}, {STATS}, long AS (
  SELECT s.sample, s.model, {A.word_count_sql('content')} AS words, CASE WHEN content <> '' THEN distinct2 END AS distinct2, avg_turn_length, switch_rate, num_turns
  FROM stats s JOIN transcripts t ON s.sample = t.sample AND s.model = t.model JOIN d2 ON s.sample = d2.sample AND s.model = d2.model),
wide AS (SELECT sample, {', '.join(f"max({m}) FILTER (WHERE model = '{x}') AS {m}_{x}" for m in compare.METRICS for x in 'ab')} FROM long GROUP BY sample)"""


@query("j10_compare_models", f"WITH {WIDE} SELECT sample, {', '.join(f'round({m}_{x}, 6) AS {m}_{x}' if m not in ('words', 'num_turns') else f'{m}_{x}' for m in compare.METRICS for x in 'ab')} FROM wide")
def j10(spark, d):
    wide = compare.compare_models(compare.transcript_metrics(A.transcripts(spark, d)), ["a", "b"])
    return rounded(wide, *(f"{m}_{x}" for m in ("distinct2", "avg_turn_length", "switch_rate") for x in "ab"))


def _summary_row(m: str) -> str:
    f = compare.FORMATS[m]
    verdict = {"avg_turn_length": "CASE WHEN x > y THEN 'longer turns' ELSE 'shorter turns' END", "switch_rate": "CASE WHEN x < y THEN 'fewer switches' ELSE 'more switches' END"}.get(m, "NULL")
    return f"SELECT '{m}' AS metric, printf('{f}', x) AS mean_a, printf('{f}', y) AS mean_b, printf('%+{f[1:]}', x - y) AS difference, {verdict} AS verdict, unparsed_a, unparsed_b FROM (SELECT avg({m}_a) AS x, avg({m}_b) AS y, count(*) FILTER (WHERE num_turns_a = 0) AS unparsed_a, count(*) FILTER (WHERE num_turns_b = 0) AS unparsed_b FROM wide) WHERE x IS NOT NULL AND y IS NOT NULL"


@query("model_comparison", f"WITH {WIDE} {' UNION ALL '.join(map(_summary_row, compare.METRICS))}")
def model_comparison(spark, d):
    wide = compare.compare_models(compare.transcript_metrics(A.transcripts(spark, d)), ["a", "b"])
    return compare.comparison_summary(wide, "a", "b")


# Excerpts and replies.
TRIGRAMS = """trigrams AS (SELECT id, max(c) AS max_repeat FROM (SELECT id, g, count(*) AS c FROM (SELECT id, unnest(list_transform(list_zip(list_slice(w, 1, len(w) - 2), list_slice(w, 2, len(w) - 1), list_slice(w, 3, len(w))), lambda p: p[1] || ' ' || p[2] || ' ' || p[3])) AS g FROM (
  SELECT id, """ + A.words_sql("excerpt") + """ AS w FROM source_rows) WHERE len(w) >= 50) GROUP BY ALL) GROUP BY id)"""
VALIDATED = f"""source_rows AS (SELECT episode_idx * 10 + excerpt_idx AS id, * FROM excerpts), {TRIGRAMS}, validated AS (SELECT s.episode_idx, s.excerpt_idx, CASE WHEN word_count > 900 THEN 'too_long' WHEN word_count < 400 THEN 'too_short'
  WHEN coalesce(max_repeat, 0) > 5 THEN 'repetition_' || max_repeat || 'x' WHEN len(regexp_extract_all(lower(excerpt), '\\[(?:inaudible|sigh|music|laughter)\\]')) > 2 THEN 'too_many_markers' END AS reason
  FROM source_rows s LEFT JOIN trigrams t ON s.id = t.id)"""


@query("p4_strip_code_fence", f"WITH {A.REPLIES} SELECT episode_idx, reply IS NOT NULL AS has_reply, CASE WHEN episode_idx % 8 = 6 THEN true WHEN reply IS NULL THEN NULL ELSE starts_with(reply, '{{') END AS starts_json FROM replies")
def p4(spark, d):
    stripped = T.strip_code_fence(F.col("reply"))
    return A.replies(spark, d).select("episode_idx", stripped.isNotNull().alias("has_reply"), F.startswith(stripped, F.lit("{")).alias("starts_json"))


@query("p5_classify_replies", f"""WITH {A.REPLIES}, source_rows AS (SELECT episode_idx AS id, excerpt, coalesce(word_count, {A.word_count_sql('excerpt')}) AS word_count, scenes, reply FROM replies), {TRIGRAMS},
good AS (SELECT s.id FROM source_rows s LEFT JOIN trigrams t ON s.id = t.id WHERE len(scenes) >= 5 AND word_count BETWEEN 400 AND 900 AND coalesce(max_repeat, 0) <= 5 AND len(regexp_extract_all(lower(excerpt), '\\[(?:inaudible|sigh|music|laughter)\\]')) <= 2)
SELECT id AS episode_idx, CASE WHEN id % 8 IN (1, 2) THEN 'failed' WHEN id % 8 IN (3, 4, 5) THEN 'not_visualizable' WHEN id IN (SELECT id FROM good) THEN 'success' ELSE 'failed' END AS status,
  CASE id % 8 WHEN 1 THEN 'api_error' WHEN 2 THEN 'json_parse_error' WHEN 3 THEN 'talk' WHEN 4 THEN 'no_excerpts' WHEN 5 THEN 'unknown' ELSE CASE WHEN id IN (SELECT id FROM good) THEN NULL ELSE 'no_valid_excerpts' END END AS reason,
  CASE WHEN id % 8 IN (0, 6, 7) AND id IN (SELECT id FROM good) THEN CAST(1 AS BIGINT) ELSE 0 END AS num_excerpts FROM source_rows""")
def p5(spark, d):
    return excerpts.classify_replies(A.replies(spark, d))


@query("p6_explode_excerpts", f"""WITH {A.REPLIES} SELECT episode_idx, CAST(0 AS BIGINT) AS excerpt_idx, excerpt, CAST(length(excerpt) AS BIGINT) AS excerpt_length, coalesce(word_count, {A.word_count_sql('excerpt')}) AS word_count FROM replies WHERE episode_idx % 8 IN (0, 6, 7)""")
def p6(spark, d):
    return excerpts.explode_excerpts(excerpts.parse_replies(A.replies(spark, d))).drop("scenes")


@query("p7_explode_scenes", f"WITH {A.SCENES} SELECT source, episode_idx, excerpt_idx, scene_idx, prompt, filename FROM scenes")
def p7(spark, d):
    return A.scenes(spark, d).select("source", "episode_idx", "excerpt_idx", "scene_idx", "prompt", "filename")


@query("p8_validate_excerpts", f"WITH {A.EXCERPTS}, {VALIDATED} SELECT episode_idx, excerpt_idx, reason IS NULL AS valid, reason FROM validated")
def p8(spark, d):
    return excerpts.validate_excerpts(A.excerpts(spark, d)).select("episode_idx", "excerpt_idx", "valid", "reason")


@query("p9_marker_count", f"WITH {A.EXCERPTS} SELECT episode_idx, excerpt_idx, CAST(len(regexp_extract_all(lower(excerpt), '\\[(?:inaudible|sigh|music|laughter)\\]')) AS BIGINT) AS markers FROM excerpts")
def p9(spark, d):
    return A.excerpts(spark, d).select("episode_idx", "excerpt_idx", T.marker_count(F.col("excerpt")).alias("markers"))


@query("p10_clean_scene_prompt", f"WITH {A.SCENES} SELECT source, filename, '{T.PHOTO_STYLE}' || {A.strip_sql(r'''regexp_replace(regexp_replace(prompt, '^Scene \d+:\s*', ''), '^Scene \d+:\s*', '')''')} AS prompt FROM scenes")
def p10(spark, d):
    return A.scenes(spark, d).select("source", "filename", T.clean_scene_prompt(F.col("prompt")).alias("prompt"))


@query("p11_word_range", f"WITH {A.EXCERPTS} SELECT episode_idx, excerpt_idx, (word_count // 100 * 100) || '-' || (word_count // 100 * 100 + 100) AS word_range FROM excerpts")
def p11(spark, d):
    return A.excerpts(spark, d).select("episode_idx", "excerpt_idx", T.word_range(F.col("word_count")).alias("word_range"))


@query("a4_max_trigram_repeat", f"WITH {A.EXCERPTS}, source_rows AS (SELECT episode_idx * 10 + excerpt_idx AS id, * FROM excerpts), {TRIGRAMS} SELECT id, max_repeat FROM trigrams")
def a4(spark, d):
    return A.excerpts(spark, d).select(F.expr("episode_idx * 10 + excerpt_idx").alias("id"), excerpts.max_trigram_repeat(F.col("excerpt")).alias("max_repeat")).filter("max_repeat is not null")


STATUS = f"{A.EXCERPTS}, {VALIDATED}, status AS (SELECT episode_idx, CASE WHEN n > 0 THEN 'success' WHEN episode_idx % 3 = 0 THEN 'failed' WHEN episode_idx % 3 = 1 THEN 'not_visualizable' ELSE 'skipped' END AS status, n AS num_excerpts FROM (SELECT episode_idx, count(*) FILTER (WHERE reason IS NULL) AS n FROM validated GROUP BY episode_idx))"


def _status(spark, d):
    found = excerpts.validate_excerpts(A.excerpts(spark, d))
    counted = found.groupBy("episode_idx").agg(F.count_if("valid").alias("num_excerpts"))
    status = F.expr("CASE WHEN num_excerpts > 0 THEN 'success' WHEN episode_idx % 3 = 0 THEN 'failed' WHEN episode_idx % 3 = 1 THEN 'not_visualizable' ELSE 'skipped' END")
    return counted.withColumn("status", status), found.filter("not valid")


@query("a8_extraction_summary", f"""WITH {STATUS} SELECT *, excerpts * 5 AS scenes, round(CASE WHEN success + not_visualizable > 0 THEN success / (success + not_visualizable)::DOUBLE END, 6) AS visual_rate, round(CASE WHEN success > 0 THEN excerpts / success::DOUBLE END, 6) AS excerpts_per_episode FROM (
  SELECT count(*) AS episodes, count(*) FILTER (WHERE status = 'success') AS success, count(*) FILTER (WHERE status = 'skipped') AS skipped, count(*) FILTER (WHERE status = 'not_visualizable') AS not_visualizable, count(*) FILTER (WHERE status = 'failed') AS failed,
  CAST(sum(num_excerpts) AS BIGINT) AS excerpts, (SELECT count(*) FROM validated WHERE reason IS NOT NULL) AS rejected FROM status)""")
def a8(spark, d):
    status, rejected = _status(spark, d)
    return rounded(excerpts.extraction_summary(status, rejected), "visual_rate", "excerpts_per_episode")


@query("w2_take_until_target", f"WITH {STATUS} SELECT episode_idx, num_excerpts, running FROM (SELECT *, CAST(sum(num_excerpts) OVER (ORDER BY episode_idx) AS BIGINT) AS running FROM status) WHERE running - num_excerpts < 40")
def w2(spark, d):
    return excerpts.take_until_target(_status(spark, d)[0], 40).select("episode_idx", "num_excerpts", "running")


@query("w3_batches", f"WITH {STATUS} SELECT (episode_idx - 3) // 7 AS batch, count(*) AS episodes, CAST(sum(num_excerpts) AS BIGINT) AS excerpts FROM status WHERE episode_idx >= 3 GROUP BY 1")
def w3(spark, d):
    return excerpts.batches(_status(spark, d)[0], 7, 3).groupBy("batch").agg(F.count("*").alias("episodes"), F.sum("num_excerpts").alias("excerpts"))


@query("u1_union_sources", "SELECT doc_id AS id, 'documents' AS source FROM documents UNION ALL SELECT page_id, 'pages' FROM pages")
def u1(spark, d):
    return mix.union_sources({"documents": A.table(spark, d, "documents").select(F.col("doc_id").alias("id")), "pages": A.table(spark, d, "pages").select(F.col("page_id").alias("id"))})


@query("u2_mix_datasets", """WITH a AS (SELECT doc_id FROM documents WHERE lang = 'en' ORDER BY md5('7-' || doc_id), doc_id LIMIT (SELECT CAST(floor(count(*) * 29.0::DOUBLE / 100.0::DOUBLE) AS BIGINT) FROM documents WHERE lang = 'en'))
SELECT doc_id, 'english' AS source, md5('7-english-' || doc_id) AS shuffle FROM a UNION ALL SELECT doc_id, 'other', md5('7-other-' || doc_id) FROM documents WHERE lang IS DISTINCT FROM 'en'""")
def u2(spark, d):
    docs = A.table(spark, d, "documents")
    registry = {"english": docs.filter("lang = 'en'").select("doc_id"), "other": docs.filter("not lang <=> 'en'").select("doc_id")}
    return mix.mix_datasets("english%29,other", registry, 7, "doc_id")


@query("h3_dense_index", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS idx FROM orders")
def h3(spark, d):
    return dense_index(A.table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"]).select("o_orderkey", "idx")

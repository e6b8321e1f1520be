"""Files: turns, annotations, benchmark tables, transcripts, image listings, and results."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from ..functions import text as T
from .folders import MOST_TASKS, files_of, folder_listing, glob_pattern, is_file, opened, qualified

TURN = "mp3url string, speaker array<string>, turnText string"
RECORD = "image array<string>, video array<string>, conversations array<struct<`from`:string,value:string>>"
EXCERPT_FILE = (
    "episode_idx bigint, episode_url string, original_transcript_length bigint, num_excerpts bigint, "
    "excerpts array<struct<excerpt_idx:bigint,excerpt:string,excerpt_length:bigint,word_count:bigint,"
    "scenes:array<struct<scene_idx:int,prompt:string,filename:string,generated:boolean>>>>"
)

CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
NULL = r"\N"
READ_BYTES, READ_FILES = 8 << 20, 2500
_BATCH_CHARS = 4 << 20
#: path of a transcript: its sample, then its model
TRANSCRIPT_FILE = r"([^/]+)/transcript_([^/.]+)\.txt$"


def read_turns(spark: SparkSession, path: str) -> DataFrame:
    """Turns of JSON lines (also gzipped, one task a file, so dealt anew); broken lines go.

    turn_idx orders turns as their files do: path, first byte of the part of the file that a task
    reads, and place in it. Rows of a part are read in order and by one task, so the place only has to grow.
    """
    rows = spark.read.schema(TURN).option("mode", "DROPMALFORMED").json(path)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("place"))
    return rows.select(F.col("mp3url").alias("episode_url"), place.alias("turn_idx"), "speaker", F.col("turnText").alias("text")).filter("episode_url is not null and text is not null")


def read_annotations(spark: SparkSession, path: str, lines: bool) -> DataFrame:
    """Chat records of a JSON array or of JSON lines, with their id where they have one; single media names become lists."""
    raw = spark.read.schema("id string, image string, video string, conversations array<struct<`from`:string,value:string>>").option("multiLine", not lines).json(path)
    as_list = lambda c: F.when(F.col(c).isNull(), F.array().cast("array<string>")).when(F.startswith(c, F.lit("[")), F.from_json(c, "array<string>")).otherwise(F.array(c))
    return raw.select("id", as_list("image").alias("image"), as_list("video").alias("video"), "conversations")


def read_excerpt_files(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Nested per-episode metadata files, tagged with their source."""
    return spark.read.schema(EXCERPT_FILE).option("multiLine", True).json(path).withColumn("source", F.lit(source))


def read_mcq(spark: SparkSession, path: str) -> DataFrame:
    """A benchmark table of tab-separated values; `index` is a number where all values are digits."""
    return numbered_index(spark.read.csv(path, sep="\t", header=True, multiLine=True, escape='"'))


def numbered_index(items: DataFrame) -> DataFrame:
    """`index` as bigint if every value is digits, else as it is."""
    digits = items.agg(F.every(F.col("index").cast("string").rlike("^[0-9]+$"))).first()[0]
    return items.withColumn("index", F.col("index").cast("bigint")) if digits else items


def files_at(spark: SparkSession, path: str) -> DataFrame:
    """(path, filename, size) of a file, or of all files below a folder, or below what a path with `*`, `?`, `[...]` or `{a,b}` names."""
    plain = re.split(r"[*?\[{]", path)[0]
    if plain == path and not is_file(spark, path):
        return files_of(folder_listing(spark, path))
    root = qualified(spark, plain.rpartition("/")[0] or "/")
    names = glob_pattern(path[len(plain.rpartition("/")[0]) + 1 :]) if plain != path else f"^{re.escape(path.rpartition('/')[2])}$"
    below = F.substr("path", F.lit(len(root.rstrip("/")) + 2))
    return files_of(folder_listing(spark, root)).filter(F.rlike(below, F.lit(f"{names[:-1]}(/|$)")))


def read_whole(found: DataFrame) -> DataFrame:
    """(path, value) of files (path, size): each file's text, read by tasks of about READ_BYTES or READ_FILES files."""
    of_all = found.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    tasks = max(1, min(max(-(-of_all["size"] // READ_BYTES), -(-of_all["n"] // READ_FILES)), MOST_TASKS))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, texts, size = [], [], 0
            for path in batch.column("path").to_pylist():
                store, name = opened(path)
                with store.open_input_file(name) as file:
                    texts.append(file.read().decode("utf-8", "replace"))
                paths.append(path)
                size += len(texts[-1])
                if size > _BATCH_CHARS:
                    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.string())], names=["path", "value"])
                    paths, texts, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.string())], names=["path", "value"])

    return found.select("path").repartition(tasks, "path").mapInArrow(read, "path string, value string")


def write_each(rows: DataFrame, path: str) -> int:
    """Writes a file for each row, by the tasks that hold the rows; returns their number.

    `name` is its path below the folder; `value` its text, or `size` its number of bytes (then nothing
    is in it, and a local file takes no room). A file gets its name when it is whole, so a task may run
    twice. Names must differ.
    """
    folder, value = qualified(rows.sparkSession, path), "value" if "value" in rows.columns else "size"

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = opened(folder)
        made: set[str] = set()
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column(value), strict=True):
                inner, _, last = f"{top}/{name}".rpartition("/")
                if inner not in made:
                    store.create_dir(inner)
                    made.add(inner)
                unfinished = f"{inner}/.{last}.{uuid.uuid4().hex}"
                if value == "size" and isinstance(store, fs.LocalFileSystem):
                    with open(unfinished, "wb") as file:
                        file.truncate(content.as_py())
                else:
                    with store.open_output_stream(unfinished) as file:
                        for chunk in [content.as_py().encode()] if value == "value" else _zeros(content.as_py()):
                            file.write(chunk)
                store.move(unfinished, f"{inner}/{last}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["files"])

    return rows.select("name", value).mapInArrow(written, "files long").agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]


def _zeros(size: int) -> Iterator[bytes]:
    for at in range(0, size, 1 << 20):
        yield bytes(min(1 << 20, size - at))


def load_transcripts(spark: SparkSession, path: str, names: str = TRANSCRIPT_FILE) -> DataFrame:
    """(sample, model, content, stated) of text files whose path tells sample and model: the dialogue without its header, and the stated word count."""
    sample, model = F.regexp_extract("path", names, 1), F.regexp_extract("path", names, 2)
    files = read_whole(files_at(spark, path).filter(model != ""))
    return files.select(sample.alias("sample"), model.alias("model"), T.strip_header(F.col("value")).alias("content"), T.header_value(F.col("value"), "Word count").try_cast("bigint").alias("stated"))


def image_inventory(spark: SparkSession, path: str, source: str, names: str = "*.{png,jpg}", previous: DataFrame | None = None) -> DataFrame:
    """(source, filename, size, path) of the image files below a folder; file contents are not read.

    Tasks list the folders; `previous` is a folder_listing of an earlier time, whose unchanged folders are not listed again.
    """
    found = files_of(folder_listing(spark, path, previous)).filter(F.col("filename").rlike(glob_pattern(names)))
    return found.select(F.lit(source).alias("source"), "filename", "size", "path")


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines, null fields left out."""
    df.write.json(path)


def _texts(schema: StructType) -> list[str]:
    return [f.name for f in schema.fields if isinstance(f.dataType, StringType)]


def write_csv(df: DataFrame, path: str, marked: bool = False) -> None:
    """CSV with a header; line breaks inside values are kept by quoting, and white space at their ends stays.

    `marked`: null is written as NULL, and a text that begins with a backslash gets one more, so
    that null, the empty text and every other text can be told apart.
    """
    if not marked:
        return df.write.options(**CSV).csv(path)
    shown = {c: F.when(F.startswith(c, F.lit("\\")), F.concat(F.lit("\\"), c)).otherwise(F.col(c)) for c in _texts(df.schema)}
    df.withColumns(shown).write.options(nullValue=NULL, **CSV).csv(path)


def read_csv(spark: SparkSession, path: str, schema: StructType, marked: bool = False) -> DataFrame:
    """CSV as write_csv writes it, `marked` or not; if not, an empty text reads as null."""
    rows = spark.read.schema(schema).options(multiLine=True, charToEscapeQuoteEscaping='"', **CSV)
    if not marked:
        return rows.csv(path)
    meant = {c: F.when(F.startswith(c, F.lit("\\")), F.substr(c, F.lit(2))).otherwise(F.col(c)) for c in _texts(schema)}
    return rows.option("nullValue", NULL).csv(path).withColumns(meant)

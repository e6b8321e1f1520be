"""Listing folders of files as Spark jobs.

The folders of a level are dealt over tasks, each of which opens the file system and lists its own, so
neither names nor sizes pass through the driver. A listing is a table by folder. It holds each folder's
time of change, so a later listing that is given it asks only for that time where nothing changed and
takes the folder's rows from the table.

File systems are opened by Arrow: local paths, HDFS and the object stores it knows. Stores that keep no
time of change for folders (object stores) are listed anew each time. One folder's names are held by
one task.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.index import shared_folder

#: kind: `file`, `folder`, or `self`, the row of the listed folder itself; size in bytes; changed in microseconds, of `self` rows
LISTING = "folder string, name string, kind string, size long, changed long"
FOLDERS_PER_TASK = 64
MOST_TASKS = 20_000
SETTLE_SECONDS = 2.0  # a folder that changed so short before it was listed may change again within the same tick: its time is not kept


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, as Spark's readers name it."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(found).toString()


def is_file(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = found.getFileSystem(spark._jsc.hadoopConfiguration())
    return store.exists(found) and store.getFileStatus(found).isFile()


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a qualified path and the path within it."""
    if path.startswith(("file:", "/")):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def _list(folder: str, known: int | None, settle: float) -> Iterator[tuple]:
    """Rows of a folder, or one row `same`. Hidden names (those Spark's readers pass over) are left out; a lost folder has no rows."""
    store, path = opened(folder)
    began = time.time()
    own = store.get_file_info(path)
    if own.type != fs.FileType.Directory:
        return
    changed = own.mtime_ns // 1000 if own.mtime_ns is not None else None
    if known is not None and changed == known:
        yield folder, None, "same", None, None
        return
    settled = changed is not None and changed < (began - settle) * 1e6
    yield folder, None, "self", None, changed if settled else None
    for entry in store.get_file_info(fs.FileSelector(path)):
        name = entry.base_name
        if name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_"):
            continue
        if entry.type == fs.FileType.Directory:
            yield folder, name, "folder", None, None
        elif entry.type == fs.FileType.File:
            yield folder, name, "file", entry.size, None


def folder_listing(spark: SparkSession, root: str, previous: DataFrame | None = None, settle: float = SETTLE_SECONDS) -> DataFrame:
    """All entries (LISTING) below a folder, level by level; `previous` is the listing of an earlier time."""
    shared_folder(spark)
    names = [c.split()[0] for c in LISTING.split(", ")]
    kinds = pa.schema([("folder", pa.string()), ("name", pa.string()), ("kind", pa.string()), ("size", pa.int64()), ("changed", pa.int64())])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder, known in zip(batch.column("folder").to_pylist(), batch.column("known").to_pylist(), strict=True):
                columns = list(zip(*_list(folder, known, settle))) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(columns, kinds)], schema=kinds)

    level = spark.createDataFrame([(qualified(spark, root),)], "folder string")
    size, levels = 1, []
    while size:
        if previous is None:
            asked = level.withColumn("known", F.lit(None).cast("long"))
        else:
            asked = level.join(previous.filter("kind = 'self'").select("folder", F.col("changed").alias("known")), "folder", "left")
        found = asked.select("folder", "known").repartition(min(-(-size // FOLDERS_PER_TASK), MOST_TASKS), "folder").mapInArrow(listed, LISTING)
        if previous is not None:
            found = found.checkpoint()
            found = found.filter("kind <> 'same'").unionByName(previous.select(*names).join(found.filter("kind = 'same'").select("folder"), "folder", "left_semi"))
        found = found.checkpoint()
        levels.append(found)
        level = found.filter("kind = 'folder'").select(F.concat("folder", F.lit("/"), "name").alias("folder"))
        size = level.count()
    return reduce(DataFrame.unionByName, levels)


def files_of(listing: DataFrame) -> DataFrame:
    """(path, filename, size) of a listing's files."""
    return listing.filter("kind = 'file'").select(F.concat("folder", F.lit("/"), "name").alias("path"), F.col("name").alias("filename"), "size")


def glob_pattern(names: str) -> str:
    """A regular expression for whole names of a pattern with `*`, `?`, `[...]` and `{a,b}`."""
    plain = {"*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")", "[": "[", "]": "]"}
    out, depth = "", 0
    for c in names:
        depth += (c == "{") - (c == "}")
        out += "|" if c == "," and depth else plain.get(c) or (c if c.isalnum() or c in "_-/ ^!" else "\\" + c)
    return "^" + out.replace("[!", "[^") + "$"

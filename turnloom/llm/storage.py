"""Where operators keep written intermediate tables, and bounded summaries of key sets."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DEFAULT: dict[str, str] = {}
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; where a session on one machine names none (tests), a folder of its own is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if "dir" not in _DEFAULT:
            _DEFAULT["dir"] = tempfile.mkdtemp(prefix="turnloom-")
        found = "file://" + _DEFAULT["dir"]
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def stored(df: DataFrame, what: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: later plans start from files that outlive executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/turnloom-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables that `stored` wrote, once nothing is to be read from them any more."""
    for df in tables:
        path = _PATHS.pop(df, None)
        if path:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


BITMAP_WORDS = 1 << 16  # 64 keys' bits each: 2^22 bits, about 1 MB when sent to executors, at every size of input


def perhaps_in(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows of `df` whose key may be in `keys` (column `key`): all that are, and a few others."""
    return with_perhaps(df, key, keys, "_perhaps").filter("_perhaps").drop("_perhaps")


def with_perhaps(df: DataFrame, key: str, keys: DataFrame, flag: str) -> DataFrame:
    """Adds `flag`: false for rows whose key is not in `keys`, true for all that are and a few others.

    The summary is a bitmap of at most BITMAP_WORDS rows, so broadcasting it is bounded. It only
    spares the exact join that follows most of its rows.
    """
    word, bit = f"xxhash64({key}) & {BITMAP_WORDS - 1}", f"cast(shiftrightunsigned(xxhash64({key}), 32) & 63 as int)"
    words = keys.groupBy(F.expr(word).alias("_word")).agg(F.expr(f"bit_or(shiftleft(1L, {bit}))").alias("_bits"))
    held = df.join(F.broadcast(words), F.expr(f"({word}) = _word"), "left")
    return held.withColumn(flag, F.expr(f"coalesce(shiftrightunsigned(_bits, {bit}) & 1L = 1L, false)")).drop("_word", "_bits")

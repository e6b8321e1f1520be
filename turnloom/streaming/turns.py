"""Turn files as a stream: the row-wise jobs need no state, so they run on new files as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.turns import clean_turns, loaded_turns
from ..sources.files import TURN


def stream_turns(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Cleaned turns of the JSON-lines files under a path, a bounded number of files at a time."""
    rows = spark.readStream.schema(TURN).option("maxFilesPerTrigger", files_per_trigger).option("mode", "DROPMALFORMED").json(path)
    named = rows.select(F.col("mp3url").alias("episode_url"), "speaker", F.col("turnText").alias("text")).filter("episode_url is not null and text is not null")
    return clean_turns(loaded_turns(named))

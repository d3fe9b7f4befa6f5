"""Incremental ingestion: new files of a source tree, as they arrive.

The reference semantics are those of a batch; this adds a stream over the same operators. Each file is
read once: the checkpoint remembers which.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strataleaf.functions import paths
from strataleaf.functions.text import source_text

_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def incoming(spark: SparkSession, root: str, glob: str = "*", files_per_trigger: int = 1000) -> DataFrame:
    """A stream of (path, length, modified, content) of new source files under root; batches are bounded."""
    found = spark.readStream.format("binaryFile").schema(_SCHEMA).option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_trigger).load(root)
    path = F.regexp_replace("path", "^file:/+", "/")
    return found.select(path.alias("path"), "length", F.col("modificationTime").alias("modified"), source_text(F.col("content")).alias("content")).where(paths.is_source(F.col("path")))


def ingest(files: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Append what is there to a table and stop: started again, it goes on where it ended."""
    return files.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed_counts(files: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Files and bytes per window of modification and extension; later rows than the watermark allows are dropped, so state is bounded."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)\z", 1))
    grouped = files.withWatermark("modified", late).groupBy(F.window("modified", window), ext.alias("ext"))
    return grouped.agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))

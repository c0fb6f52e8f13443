"""Containers that keep arriving in a folder, as streams of the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.containers import parsed

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def arriving(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Files of a folder as they come: path, modificationTime, length, content."""
    source = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.{[xX][dD][wW],[xX][bB][dD]}").option("recursiveFileLookup", "true")
    return source.option("maxFilesPerTrigger", files_per_batch).load(folder)


def arrived_tables(files: DataFrame, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends parsed documents to a Parquet folder; a file is parsed once, however often the stream is started."""
    out = parsed(files).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if once else out).start()


def sheets_by_window(files: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Files and bytes by the window in which they were last changed; windows close when the watermark has passed them."""
    timed = files.select("modificationTime", "length").withWatermark("modificationTime", late)
    return timed.groupBy(F.window("modificationTime", width)).agg(F.count("*").alias("files"), F.sum("length").alias("bytes")).select(F.col("window.start").alias("start"), "files", "bytes")


def document_states(docs: DataFrame) -> DataFrame:
    """A row for each streamed document: sheets and those readable as they are; no state is kept."""
    count = lambda c: F.size(F.filter("entries", c))
    sheet = lambda e: e["role"] == "sheet"
    readable = lambda e: sheet(e) & F.coalesce((e["data_kind"] == "jpeg") | ((e["data_kind"] == "encoded") & (e["code"] == 9)) | ((e["data_kind"] == "preview") & (F.least(e["pixels"]["w"], e["pixels"]["h"]) >= 1000)), F.lit(False))
    return docs.select("path", "error_code", count(sheet).alias("sheets"), count(readable).alias("readable"))

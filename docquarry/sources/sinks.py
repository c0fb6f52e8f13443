"""Files as output: pictures and originals out of containers, coded streams, and report tables as text."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.reports import as_csv, output_stems
from .containers import attachments, entries

WRITTEN = "path string, name string, bytes bigint, ok boolean, error string"


def extracted_parts(files: DataFrame, docs: DataFrame) -> DataFrame:
    """What can be taken out as it is, without its bytes: path, name, at, length. JPEG entries, numbered as in the page table, and original files."""
    stems = output_stems(docs.where("error_code is null").select("path"))
    jpegs = entries(docs.where("error_code is null")).where("data_kind = 'jpeg'").select("path", F.col("at").cast("bigint").alias("at"), "length", F.format_string("_p%03d.jpg", F.col("idx") + 1).alias("tail"))
    found = attachments(files).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "extension"))).alias("a")).select("path", F.posexplode("a").alias("k", "x"))
    originals = found.select("path", F.col("x.offset").alias("at"), F.col("x.length").alias("length"), F.format_string("_original%d.%s", F.col("k"), F.col("x.extension")).alias("tail"))
    return jpegs.unionByName(originals).join(stems, "path").select("path", F.concat("stem", "tail").alias("name"), "at", "length")


def stream_parts(streams: DataFrame) -> DataFrame:
    """Coded streams as parts of files: path, name, at, length. streams: as in the index."""
    stems = output_stems(streams.select("path").distinct())
    return streams.join(stems, "path").select("path", F.concat("stem", F.format_string(".%04d.%s.bin", "entry", "role")).alias("name"), F.col("offset").alias("at"), F.col("stored").alias("length"))


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            rows = []
            for path, content, parts in zip(batch.column("path"), batch.column("content"), batch.column("parts")):
                data = content.as_py()
                for p in parts.as_py() or []:
                    raw, error = data[p["at"] : p["at"] + p["length"]], None
                    target = os.path.join(folder, p["name"])
                    # a task that runs twice writes the same bytes under a name of its own, then renames
                    passing = f"{target}.{uuid.uuid4().hex}.part"
                    try:
                        with open(passing, "wb") as f:
                            f.write(raw)
                        os.replace(passing, target)
                    except OSError as e:
                        error = str(e)
                    rows.append((path.as_py(), p["name"], len(raw), error is None, error))
            kinds = (pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["path", "name", "bytes", "ok", "error"])

    return run


def write_parts(files: DataFrame, parts: DataFrame, folder: str) -> DataFrame:
    """Writes parts of files into a folder that all executors share, when the result is read: path, name, bytes, ok, error.
    Only the parts' places are grouped; a file's bytes are joined to them once."""
    places = parts.groupBy("path").agg(F.collect_list(F.struct("name", "at", "length")).alias("parts"))
    return files.select("path", "content").join(places, "path").mapInArrow(_writer(folder), WRITTEN)


def write_csv(rows: DataFrame, folder: str) -> None:
    """Rows as lines of text, quoted as in the reports; the header stands in a file beside them, `_columns.csv`."""
    as_csv(rows).write.mode("overwrite").text(folder)
    header = rows.sparkSession.createDataFrame([(",".join(rows.columns),)], "value string")
    header.coalesce(1).write.mode("overwrite").text(f"{folder}/_columns.csv")

"""Audits over the tables: coverage, verdicts, triage, picture runs, expectation and comparison. DataFrame expressions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def recoverable(of: Callable[[str], Column] = F.col) -> Column:
    """Entries whose bytes can be used without decoding, or whose coding is public. of: gives a field of the entry."""
    full = (of("data_kind") == "preview") & (F.least(of("pixels")["w"], of("pixels")["h"]) >= 1000)
    return F.coalesce((of("data_kind") == "jpeg") | ((of("data_kind") == "encoded") & (of("code") == 9)) | full, F.lit(False))


def covered(docs: DataFrame) -> DataFrame:
    """Documents with the eight counts of `coverage`, each told from its own entries: files are read once, and nothing is grouped or joined."""
    of = lambda role, ok=None: F.filter("entries", lambda e: (e["role"] == role) if ok is None else (e["role"] == role) & (recoverable(e.getField) == ok))
    count = lambda a: F.size(a).cast("bigint")
    own = lambda a: F.transform(a, lambda e: e["idx"])
    owners = lambda a: F.transform(a, lambda e: e["belongs_to"])
    return docs.select(
        "*", count(of("sheet")).alias("sheets"), count(of("sheet", True)).alias("sheets_recovered"), count(of("picture")).alias("pictures"), count(of("picture", True)).alias("pictures_recovered"),
        count(of("thumbnail")).alias("thumbnails"), count(of("data")).alias("data_tables"), count(F.array_intersect(own(of("sheet")), owners(of("picture")))).alias("sheets_with_pictures"),
        count(F.array_except(own(of("sheet", False)), owners(of("picture", True)))).alias("sheets_blank"),
    )


def coverage(entries: DataFrame, decoded: DataFrame | None = None) -> DataFrame:
    """Eight counts a document. One grouped pass gives each sheet its pictures, a second sums sheets; both have the document's key.
    With `decoded` (path, idx, decoded), sheets count as recovered where decoding them works too."""
    e = entries.withColumn("ok", recoverable())
    if decoded is not None:
        d = decoded.where("decoded").select(F.col("path").alias("dp"), F.col("idx").alias("di"))
        e = e.join(d, (F.col("dp") == F.col("path")) & (F.col("di") == F.col("idx")), "left").withColumn("ok", F.col("ok") | ((F.col("role") == "sheet") & F.col("di").isNotNull()))
    e = e.withColumn("sheet", F.when(F.col("role") == "picture", F.col("belongs_to")).otherwise(F.col("idx")))
    has = lambda role: F.col("role") == role
    per = e.groupBy("path", "sheet").agg(
        F.count_if(has("sheet")).alias("s"), F.count_if(has("sheet") & F.col("ok")).alias("sr"), F.count_if(has("picture")).alias("p"),
        F.count_if(has("picture") & F.col("ok")).alias("pr"), F.count_if(has("thumbnail")).alias("t"), F.count_if(has("data")).alias("d"),
    )
    return per.groupBy("path").agg(
        F.sum("s").alias("sheets"), F.sum("sr").alias("sheets_recovered"), F.sum("p").alias("pictures"), F.sum("pr").alias("pictures_recovered"), F.sum("t").alias("thumbnails"), F.sum("d").alias("data_tables"),
        F.count_if((F.col("s") > 0) & (F.col("p") > 0)).alias("sheets_with_pictures"), F.count_if((F.col("s") > 0) & (F.col("sr") == 0) & (F.col("pr") == 0)).alias("sheets_blank"),
    )


def verdict(attachments: Column) -> Column:
    return F.when(attachments > 0, "ORIGINAL").when((F.col("sheets") > 0) & (F.col("sheets") == F.col("sheets_recovered")), "ALL").when(F.col("sheets_recovered") > 0, "SOME").when(F.col("pictures_recovered") > 0, "ART").otherwise("NONE")


def triage(covered: DataFrame) -> DataFrame:
    """Files, sheets and blank sheets by verdict, and in all (verdict TOTAL)."""
    sums = covered.rollup("verdict").agg(F.count("*").alias("files"), F.sum("sheets").alias("sheets"), F.sum("sheets_blank").alias("blank"), F.grouping("verdict").alias("total"))
    return sums.select(F.when(F.col("total") == 1, "TOTAL").otherwise(F.col("verdict")).alias("verdict"), "files", F.coalesce("sheets", F.lit(0)).alias("sheets"), F.coalesce("blank", F.lit(0)).alias("blank"))


def picture_runs(entries: DataFrame) -> DataFrame:
    """Runs of neighbouring pictures of one known width on a sheet: path, sheet, run, first, n, width."""
    order = W.partitionBy("path", "belongs_to").orderBy("idx")
    p = entries.where("role = 'picture'").withColumn("width", F.col("pixels.w"))
    starts = p.withColumn("new", F.when(F.coalesce(F.lag("width").over(order) == F.col("width"), F.lit(False)), 0).otherwise(1))
    runs = starts.withColumn("run", F.sum("new").over(order))
    return runs.groupBy("path", F.col("belongs_to").alias("sheet"), "run").agg(F.min("idx").alias("first"), F.count("*").alias("n"), F.min("width").alias("width"))


def compare(expected: DataFrame, observed: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """Pages whose sizes differ, either way round, by position: path, page. Both sides: path, page, w, h in points."""
    o = observed.select(F.col("path").alias("op"), F.col("page").alias("og"), F.col("w").alias("ow"), F.col("h").alias("oh"))
    both = expected.join(o, (F.col("op") == F.col("path")) & (F.col("og") == F.col("page")))
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= tolerance
    return both.where(~((near("w", "ow") & near("h", "oh")) | (near("w", "oh") & near("h", "ow")))).select("path", "page")

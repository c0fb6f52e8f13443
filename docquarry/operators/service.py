"""One entry to the engine whose parts can be exchanged: how files are read, parsed, searched for originals, and their pages decoded."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import carving, container, lzh, pages
from ..functions.tlv import ContainerError, Entry
from ..sources.containers import _per_file, read_files
from . import audit

COUNTS = ("sheets", "sheets_recovered", "pictures", "pictures_recovered", "thumbnails", "data_tables", "sheets_with_pictures", "sheets_blank")
ANALYSIS = "path string, bytes bigint, generation bigint, entries int, attachments int, error_code string, error_detail string, " + ", ".join(f"{c} bigint" for c in COUNTS)
CHECKED = "path string, entry int, role string, offset bigint, stored bigint, declared bigint, ok boolean, enhanced boolean, error string"


def counted(entries: list[Entry], usable: Callable[[Entry], bool]) -> dict[str, int]:
    """The eight counts of a document. usable: whether an entry's content can be had."""
    by_role = {role: [e for e in entries if e.role == role] for role in ("sheet", "picture", "thumbnail", "data")}
    sheets, pictures = ({e.idx: usable(e) for e in by_role[role]} for role in ("sheet", "picture"))
    owners = {e.belongs_to for e in by_role["picture"]}
    helped = {e.belongs_to for e in by_role["picture"] if pictures[e.idx]}
    return dict(zip(COUNTS, (
        len(sheets), sum(sheets.values()), len(pictures), sum(pictures.values()), len(by_role["thumbnail"]), len(by_role["data"]),
        sum(k in owners for k in sheets), sum(not ok and k not in helped for k, ok in sheets.items()),
    )))


def coded_streams(data: bytes, doc: dict) -> list[tuple[int, str, int, int, int]]:
    """Coded streams with a declared size that lie within the file: entry, role, offset, stored and declared size. The properties count behind the last entry."""
    found = [(e.idx, "page", e.at, e.length, e.aux) for e in doc["entries"] if e.kind == "encoded" and e.aux is not None]
    found += [(e.idx, "preview", e.at + e.below + 16, min(e.stored, max(e.length - e.below - 16, 0)), e.expanded) for e in doc["entries"] if e.kind == "preview" and e.below is not None]
    if doc["properties_at"] is not None:
        found.append((len(doc["entries"]), "properties", doc["properties_at"], doc["properties_stored"], doc["properties_expanded"] or 0))
    return sorted(s for s in found if s[3] and s[2] + s[3] <= len(data))


@dataclass(frozen=True)
class Service:
    """read gives files as path and content; parse raises ContainerError for what is no container; scan gives original files in bytes;
    recovered says whether a sheet can be had, decoding included, and readable whether bytes can be used as they are."""

    read: Callable[[SparkSession, str], DataFrame] = read_files
    parse: Callable[[bytes], dict] = container.parse
    scan: Callable[[bytes], list] = carving.carved
    recovered: Callable[[bytes, Entry, list[Entry]], bool] = pages.recovered
    readable: Callable[[Entry], bool] = pages.readable

    def open(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.read(spark, folder)

    def analyze(self, files: DataFrame) -> DataFrame:
        """Coverage with decoding, originals and verdict of each file, in one pass over its bytes. Files that are no container say what they are. files: path, content."""

        parse, scan, readable, recovered = self.parse, self.scan, self.readable, self.recovered  # tasks get these alone

        def rows(path: str, data: bytes) -> list[dict]:
            try:
                doc = parse(data)
            except ContainerError as e:
                return [{"path": path, "bytes": len(data), "error_code": e.code, "error_detail": e.detail}]
            own = doc["entries"]
            usable = lambda e: readable(e) or (e.role == "sheet" and recovered(data, e, own))
            return [{"path": path, "bytes": len(data), "generation": doc["generation"], "entries": len(own), "attachments": len(scan(data))} | counted(own, usable)]

        found = _per_file(files, rows, ANALYSIS)
        return found.withColumn("verdict", F.when(F.col("error_code").isNull(), audit.verdict(F.col("attachments"))).when(F.col("error_code") == "NotAContainer", "OTHER"))

    def check_streams(self, files: DataFrame) -> DataFrame:
        """Whether each coded stream expands to the size that it declares, and whether pages then are enhanced metafiles."""

        parse = self.parse

        def rows(path: str, data: bytes) -> list[dict]:
            try:
                doc = parse(data)
            except ContainerError:
                return []
            out = []
            for entry, role, offset, stored, declared in coded_streams(data, doc):
                row = {"path": path, "entry": entry, "role": role, "offset": offset, "stored": stored, "declared": declared, "ok": False, "enhanced": False}
                try:
                    raw = lzh.expand(data[offset : offset + stored], declared)
                    row |= {"ok": len(raw) == declared, "enhanced": role == "page" and raw[40:44] == b" EMF"}
                except lzh.CodingError as e:
                    row["error"] = str(e)
                out.append(row)
            return out

        return _per_file(files, rows, CHECKED)


def stream_totals(checked: DataFrame) -> DataFrame:
    """How many streams there are, how many expand, and how many pages are enhanced metafiles."""
    return checked.agg(F.count("*").alias("streams"), F.count_if("ok").alias("expanded"), F.count_if(F.col("ok") & F.col("enhanced")).alias("enhanced"))


def tally(analysis: DataFrame) -> DataFrame:
    """Files, sheets and blank sheets by verdict, with OTHER for what is no container, and TOTAL with the share of blank sheets in whole percents. Files that cannot be read for other reasons are FAILED and count in no total."""
    from .reports import fixed

    told = analysis.select(F.coalesce("verdict", F.lit("FAILED")).alias("verdict"), F.coalesce("sheets", F.lit(0)).alias("sheets"), F.coalesce("sheets_blank", F.lit(0)).alias("blank"))
    per = told.groupBy("verdict").agg(F.count("*").alias("files"), F.sum("sheets").alias("sheets"), F.sum("blank").alias("blank"))
    whole = per.where("verdict <> 'FAILED'").agg(F.lit("TOTAL").alias("verdict"), F.coalesce(F.sum("files"), F.lit(0)).alias("files"), F.coalesce(F.sum("sheets"), F.lit(0)).alias("sheets"), F.coalesce(F.sum("blank"), F.lit(0)).alias("blank"))
    percent = F.when((F.col("verdict") == "TOTAL") & (F.col("sheets") > 0), F.regexp_replace(fixed(100.0 * F.col("blank") / F.col("sheets"), 0), r"\.$", ""))
    return per.unionByName(whole).withColumn("blank_percent", percent)


def output_totals(reports: DataFrame) -> DataFrame:
    """What several files came to, a row in all: files, pages, recovered pages, placeholders, attachments, glyphs. reports: rows of the PDF writer."""
    return reports.agg(F.count("*").alias("files"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("pages", "recovered", "placeholders", "attachments", "glyphs")])

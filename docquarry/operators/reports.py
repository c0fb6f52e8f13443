"""Reports over the tables, as DataFrame expressions: triage, manifest, streams, expectation and findings, names of outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.html import ESCAPES

#: Fixed wording of the triage table.
NOTES = {
    "ORIGINAL": "carries the source file; extract it directly",
    "ALL": "every content page recovers losslessly",
    "SOME": "part of the sheets recover; the rest need the vendor codec",
    "ART": "no sheet recovers, but the artwork on them does",
    "NONE": "sheets are in the vendor codec",
}
#: The counts that `audit.covered` gives documents.
COUNTS = ("sheets", "sheets_recovered", "pictures", "pictures_recovered", "thumbnails", "data_tables", "sheets_with_pictures", "sheets_blank")
MM100_TO_POINT = 72.0 / 2540.0


def _case(of: Column, table: dict) -> Column:
    out = F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(of == k, v).otherwise(out)
    return out


def fixed(number: Column, digits: int) -> Column:
    """A number with that many decimals, ties by its exact binary value and then to the even digit."""
    return F.call_function("format_number", number.cast("double"), F.lit("0." + "0" * digits))


def html_escaped(c: Column) -> Column:
    """As the HTML writer escapes text."""
    for a, b in ESCAPES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def csv_cell(c: Column) -> Column:
    """Quoted where it holds a comma, quote or line feed."""
    return F.when(c.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def csv_line(*cells: Column | str) -> Column:
    return F.concat_ws(",", *[F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("")) for c in cells])


def complete() -> Column:
    return (F.col("sheets") > 0) & (F.col("sheets") == F.col("sheets_recovered"))


def printer_derived() -> Column:
    """Sheets that only the vendor's own coding holds."""
    return F.greatest(F.col("sheets") - F.col("sheets_recovered"), F.lit(0))


def picture_ratio() -> Column:
    return F.col("pictures_recovered") / F.nullif(F.col("pictures"), F.lit(0))


def attachment_counts(attachments: DataFrame) -> DataFrame:
    return attachments.groupBy("path").agg(F.count("*").alias("attachments"))


def triage_rows(docs: DataFrame, covered: DataFrame, attached: DataFrame) -> DataFrame:
    """Thirteen columns a file; files that are no container have the verdict OTHER and say what they are. attached: path, attachments."""
    from .audit import verdict

    joined = docs.join(covered, "path", "left").join(attached, "path", "left")
    good = F.col("error_code").isNull()
    n = F.when(good, F.coalesce("attachments", F.lit(0)))
    zero = lambda c: F.when(good, F.coalesce(c, F.lit(0)))
    told = F.when(good, verdict(F.coalesce("attachments", F.lit(0)))).otherwise("OTHER")
    return joined.select(
        "path", F.col("length").alias("bytes"), F.when(good, F.col("generation")).alias("generation"), F.when(good, F.size("entries")).alias("entries"), zero("sheets").alias("sheets"), zero("thumbnails").alias("thumbnails"),
        zero("pictures").alias("pictures"), zero(printer_derived()).alias("sheets_in_vendor_coding"), zero("sheets_blank").alias("blank_pages"), zero(F.col("sheets_recovered") + F.col("pictures_recovered")).alias("recovered"),
        n.alias("attachments"), F.coalesce(told, F.lit("NONE")).alias("verdict"), F.when(good, _case(F.coalesce(told, F.lit("NONE")), NOTES)).otherwise(F.concat_ws(" ", "error_code", "error_detail")).alias("note"),
    )


def as_csv(rows: DataFrame) -> DataFrame:
    """One column `value`, for a text sink; the header is the columns' names."""
    return rows.select(csv_line(*[csv_cell(F.col(c).cast("string")) for c in rows.columns]).alias("value"))


def manifest(pages: DataFrame) -> DataFrame:
    """A row for each page that a faithful conversion has, sizes in millimetres with one decimal."""
    mm = lambda side: fixed(F.col(f"paper.{side}") / 100.0, 1)
    size = lambda side: F.when(F.col("paper").isNotNull(), mm(side)).otherwise("")
    return pages.select("path", "page", "kind", size("w").alias("width_mm"), size("h").alias("height_mm"), F.col("recovered").alias("recoverable"))


def _with_counts(docs: DataFrame, covered: DataFrame | None) -> DataFrame:
    return docs.where("error_code is null") if covered is None else docs.where("error_code is null").join(covered, "path", "left")


def expectation(docs: DataFrame, covered: DataFrame | None = None) -> DataFrame:
    """What a conversion must have: pages, and how many previews and pictures must not become pages. covered: the counts, where documents do not have them."""
    shown = F.size("displays")
    return _with_counts(docs, covered).select("path", F.when(shown > 0, shown.cast("long")).otherwise(F.coalesce("sheets", F.lit(0))).alias("pages"), F.coalesce("thumbnails", F.lit(0)).alias("previews"), F.coalesce("pictures", F.lit(0)).alias("pictures"))


def points(pages: DataFrame) -> DataFrame:
    """Page sizes in points, turned pages as shown."""
    turned = (F.col("rotation") % 180 == 90) & (F.col("kind") != "display")
    w, h = F.col("paper.w") * MM100_TO_POINT, F.col("paper.h") * MM100_TO_POINT
    return pages.where("paper is not null").select("path", "page", F.when(turned, h).otherwise(w).alias("w"), F.when(turned, w).otherwise(h).alias("h"))


def findings(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """How a converted file's page count differs, a row a finding: path, finding, loss. expected as above; observed: path, pages."""
    o = observed.select(F.col("path").alias("op"), F.col("pages").alias("seen"))
    both = expected.join(o, F.col("op") == F.col("path"))
    extra = F.col("seen") - F.col("pages")
    found = F.array_compact(F.array(
        F.when(extra != 0, F.struct(F.lit("PageCount").alias("finding"), (extra < 0).alias("loss"))),
        F.when((extra == F.col("previews")) & (F.col("previews") > 0), F.struct(F.lit("PreviewsConverted").alias("finding"), F.lit(False).alias("loss"))),
        F.when((extra == F.col("pictures")) & (F.col("pictures") > 0), F.struct(F.lit("PicturesConverted").alias("finding"), F.lit(False).alias("loss"))),
    ))
    return both.select("path", F.col("pages").alias("expected"), F.col("seen").alias("observed"), F.inline(found))


def size_findings(expected: DataFrame, observed: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """Pages whose sizes differ, as findings: path, page, finding, loss. Both sides: path, page, w, h in points."""
    from .audit import compare

    return compare(expected, observed, tolerance).select("path", "page", F.lit("PageSize").alias("finding"), F.lit(False).alias("loss"))


def verified(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """A report for each converted file, a row a line: path, line, text. The last line says whether all is well; where pages are missing there is none. observed: path, pages."""
    o = observed.select(F.col("path").alias("op"), F.col("pages").alias("seen"))
    both = expected.join(o, F.col("op") == F.col("path"))
    extra = F.col("seen") - F.col("pages")
    line = lambda k, text: F.struct(F.lit(k).alias("line"), text.alias("text"))
    told = F.array_compact(F.array(
        line(0, F.format_string("%s: container %d page(s), converted file %d page(s)", F.regexp_replace("path", "^.*/", ""), F.col("pages"), F.col("seen"))),
        F.when(extra != 0, line(1, F.when(extra > 0, F.format_string("  ! page count: %d extra", extra)).otherwise(F.format_string("  ! page count: %d missing", -extra)))),
        F.when((extra == F.col("previews")) & (F.col("previews") > 0), line(2, F.format_string("  ! the %d preview(s) were converted as pages", extra))),
        F.when((extra == F.col("pictures")) & (F.col("pictures") > 0), line(3, F.format_string("  ! the %d picture(s) were converted as pages", extra))),
        F.when(extra >= 0, line(9, F.when(extra == 0, "  OK: page counts agree").otherwise("  no page is missing; see the notes above"))),
    ))
    return both.select("path", F.inline(told))


def streams(docs: DataFrame) -> DataFrame:
    """Coded streams: entries that are not pictures or field tables, previews below their headers, and the properties."""
    properties = F.when(F.col("properties_at").isNotNull(), F.array(F.struct(F.size("entries").alias("idx"), F.lit("properties").alias("data_kind"), F.col("properties_at").alias("at"), F.col("properties_stored").alias("length"), F.col("properties_expanded").alias("expanded"))))
    kept = ("idx", "data_kind", "at", "length", "expanded", "below", "stored", "aux", "code", "method", "colour")
    kinds = {"idx": "int", "data_kind": "string"}
    shaped = lambda x, names: F.struct(*[(x[c] if c in names else F.lit(None)).cast(kinds.get(c, "bigint")).alias(c) for c in kept])
    every = F.concat(F.transform("entries", lambda x: shaped(x, kept)), F.transform(F.coalesce(properties, F.array().cast("array<struct<idx:int,data_kind:string,at:bigint,length:bigint,expanded:bigint>>")), lambda x: shaped(x, ("idx", "data_kind", "at", "length", "expanded"))))
    e = docs.where("error_code is null").select("path", F.col("length").alias("file_length"), F.inline(every).alias(*[f"entry_{c}" if c == "length" else c for c in kept])).withColumn("head", F.coalesce("below", F.lit(0)) + 16)
    preview = F.col("data_kind") == "preview"
    both = e.where("data_kind in ('encoded', 'preview', 'bare', 'properties')").select(
        "path", "file_length", F.col("idx").alias("entry"), _case(F.col("data_kind"), {"encoded": "page", "preview": "preview", "bare": "bare", "properties": "properties"}).alias("role"), F.when(preview, F.col("at") + F.col("head")).otherwise(F.col("at")).alias("offset"),
        F.when(preview, F.least(F.coalesce("stored", F.lit(0)), F.greatest(F.col("entry_length") - F.col("head"), F.lit(0)))).otherwise(F.col("entry_length")).alias("stored"), F.when(F.col("data_kind") == "encoded", F.col("aux")).when(preview, F.coalesce("expanded", F.lit(0))).when(F.col("data_kind") == "properties", F.col("expanded")).alias("expanded_declared"),
        F.when(F.col("data_kind") == "encoded", F.col("code").cast("string")).otherwise(F.col("data_kind")).alias("kind"), F.when(F.col("data_kind") == "encoded", F.col("method")).alias("method"), F.when(F.col("data_kind") == "encoded", F.col("colour")).alias("colour"),
    )
    both = both.where("stored > 0 and offset + stored <= file_length").drop("file_length")
    return both.withColumn("ratio", fixed(F.col("expanded_declared") / F.col("stored"), 2))


def leanest(streams: DataFrame) -> DataFrame:
    """The stream that expands most, by path and entry on ties."""
    ratio = F.col("expanded_declared") / F.col("stored")
    best = F.min_by(F.struct("path", "entry", "role", "stored", "expanded_declared"), F.struct(-ratio, "path", "entry"))
    return streams.where("expanded_declared is not null").agg(best.alias("s")).select("s.*")


def unknown_fields(entries: DataFrame) -> DataFrame:
    """Page fields of unknown tags, as hexadecimal numbers, once a document."""
    tags = F.array_sort(F.array_distinct(F.flatten(F.collect_list("unknown"))))
    return entries.where(F.size("unknown") > 0).groupBy("path").agg(F.transform(tags, lambda t: F.concat(F.lit("0x"), F.lower(F.lpad(F.hex(t), 2, "0")))).alias("tags"))


def stem(path: Column) -> Column:
    """A path's last part up to its last dot; a leading dot begins no extension."""
    return F.regexp_replace(F.regexp_replace(path, "^.*/", ""), r"(?<=.)\.[^.]*$", "")


def output_stems(paths: DataFrame) -> DataFrame:
    """path, stem, where the n-th of one stem in the order of paths gets ~n."""
    n = F.row_number().over(W.partitionBy("s").orderBy("path"))
    return paths.select("path", stem(F.col("path")).alias("s")).select("path", F.when(n == 1, F.col("s")).otherwise(F.concat_ws("~", "s", n.cast("string"))).alias("stem"))


def describe(of: Callable[[str], Column] = F.col) -> Column:
    """An entry in one line. of: gives a field of the entry."""
    size = lambda c: F.when(of(c).isNotNull(), F.format_string(" %dx%d", of(c)["w"], of(c)["h"])).otherwise("")
    ratio = F.when(of("data_kind").isin("encoded", "preview"), F.concat(F.lit(" ("), fixed(F.coalesce(of("expanded"), of("aux")) / F.greatest(F.coalesce(of("stored"), of("length")), F.lit(1)), 1), F.lit("x)"))).otherwise("")
    turn = F.when(of("rotation") != 0, F.format_string(" turned %d", of("rotation"))).otherwise("")
    over = F.when(of("overlays") > 0, F.format_string(" +%d overlay(s)", of("overlays"))).otherwise("")
    return F.concat(of("role"), F.lit(" "), of("data_kind"), size("pixels"), F.coalesce(ratio, F.lit("")), turn, over)


def info(docs: DataFrame, covered: DataFrame | None = None) -> DataFrame:
    """What a document is, in a row: the counts, the first eight entries and how many more there are. covered: the counts, where documents do not have them."""
    known = ("path", "length", "generation", "trailer_tag", "generations_present", "rebuilt", "image_derived", "unknown_elements", "properties_stored", "properties_expanded")
    told = F.filter("entries", lambda e: e["idx"] < 8)
    lines = F.transform(F.array_sort(F.transform(told, lambda e: F.struct(e["idx"].alias("idx"), describe(e.getField).alias("line")))), lambda x: x["line"])
    head = docs.select(*known, F.size("displays").alias("display_pages"), F.size("entries").alias("n_entries"), F.when(F.size(told) > 0, lines).alias("first_entries"), "error_code", *([] if covered is not None else COUNTS))
    return _with_counts(head, covered).drop("error_code").withColumn("more_entries", F.greatest(F.col("n_entries") - 8, F.lit(0)))


def info_lines(told: DataFrame) -> DataFrame:
    """The same as text, a row a line: path, line, text. told: rows of `info`."""
    some = lambda c, text: F.when(F.col(c) > 0, text)
    count = lambda fmt, *cols: F.format_string(fmt, *[F.coalesce(F.col(c), F.lit(0)) for c in cols])
    head = F.array(
        F.concat(F.col("path"), F.lit(": generation "), F.col("generation").cast("string"), F.lit(", "), F.col("n_entries").cast("string"), F.lit(" entries")),
        count("  %d sheet(s), %d recovered; %d picture(s), %d recovered; %d thumbnail(s); %d data table(s)", "sheets", "sheets_recovered", "pictures", "pictures_recovered", "thumbnails", "data_tables"),
        some("sheets_blank", count("  %d sheet(s) would come out blank", "sheets_blank")),
        some("display_pages", count("  %d page(s) as shown", "display_pages")),
        F.when(F.col("rebuilt").isNotNull(), F.concat(F.lit("  page table: "), F.col("rebuilt"))),
        F.when(F.col("properties_stored").isNotNull(), count("  properties: %d octets, %d expanded", "properties_stored", "properties_expanded")),
    )
    entries = F.transform(F.coalesce("first_entries", F.array().cast("array<string>")), lambda x: F.concat(F.lit("    "), x))
    more = F.array(some("more_entries", count("    and %d more", "more_entries")))
    return told.select("path", F.posexplode(F.array_compact(F.concat(head, entries, more))).alias("line", "text"))

"""Registered queries of the engine and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, reports
from ..sources import containers as src
from . import drawn_queries, mark_queries
from .fixtures import order_containers


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_partkey")


def _covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.coverage(src.audited(order_containers(_lines(spark, sf_dir)))).withColumn("verdict", audit.verdict(F.lit(0)))


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _covered(spark, sf_dir)


def triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.triage(_covered(spark, sf_dir))


def entry_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.audited(order_containers(_lines(spark, sf_dir))).groupBy("data_kind", "role").agg(F.count("*").alias("n"), F.coalesce(F.sum("pixels.w"), F.lit(0)).alias("widths"))


def picture_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.picture_runs(order_containers(_lines(spark, sf_dir), runs=True)).select("path", "run", "first", "n", "width")


def sniff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", src.looks_like(F.col("html").cast("binary")).alias("label"))


def html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", reports.html_escaped(F.col("text")).alias("escaped"))


def csv_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", reports.csv_cell(F.col("text")).alias("cell"))


def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of outputs for files that lie in a folder for each document and are named by its source."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    paths = docs.select(F.concat_ws("/", F.lpad(F.col("doc_id").cast("string"), 20, "0"), F.concat("source", F.lit(".xdw"))).alias("path"))
    return reports.output_stems(paths).select(F.split("path", "/")[0].cast("bigint").alias("doc_id"), F.col("stem").alias("name"))


def carve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts laid as PDFs behind two other bytes, and found again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    laid = F.concat(F.lit(b"..%PDF-1.4\n"), F.coalesce("text", F.lit("")).cast("binary"), F.lit(b"\n%%EOF tail"))
    found = src.attachments(docs.select(F.col("doc_id").cast("string").alias("path"), laid.alias("content")))
    return found.select(F.col("path").cast("bigint").alias("doc_id"), F.col("offset").alias("first_byte"), F.col("length").alias("n_bytes"), src.attachment_label(F.col("extension")).alias("label"))


QUERIES = {"carve": carve, "coverage": coverage, "triage": triage, "entry_kinds": entry_kinds, "picture_runs": picture_runs, "sniff_pages": sniff_pages, "html_escape": html_escape, "csv_quote": csv_quote, "output_names": output_names}

_COVERAGE = """SELECT 'order' || l_orderkey || '.xdw' AS path, count(*) AS sheets, count(*) FILTER (l_returnflag = 'R') AS sheets_recovered, CAST(0 AS BIGINT) AS pictures, CAST(0 AS BIGINT) AS pictures_recovered,
  count(*) AS thumbnails, CAST(0 AS BIGINT) AS data_tables, CAST(0 AS BIGINT) AS sheets_with_pictures, count(*) FILTER (l_returnflag <> 'R') AS sheets_blank,
  CASE WHEN count(*) FILTER (l_returnflag <> 'R') = 0 THEN 'ALL' WHEN count(*) FILTER (l_returnflag = 'R') > 0 THEN 'SOME' ELSE 'NONE' END AS verdict FROM lineitem GROUP BY l_orderkey"""

ORACLE_SQL = {
    "carve": "SELECT doc_id, CAST(2 AS BIGINT) AS first_byte, CAST(15 + strlen(coalesce(text, '')) AS BIGINT) AS n_bytes, 'PDF' AS label FROM documents",
    "coverage": _COVERAGE,
    "triage": f"SELECT coalesce(verdict, 'TOTAL') AS verdict, count(*) AS files, CAST(sum(sheets) AS BIGINT) AS sheets, CAST(sum(sheets_blank) AS BIGINT) AS blank FROM ({_COVERAGE}) GROUP BY ROLLUP (verdict)",
    "entry_kinds": """SELECT 'jpeg' AS data_kind, 'sheet' AS role, count(*) AS n, CAST(sum(100 + CAST(floor(l_quantity) AS BIGINT)) AS BIGINT) AS widths FROM lineitem WHERE l_returnflag = 'R'
  UNION ALL SELECT 'encoded', 'sheet', count(*), CAST(0 AS BIGINT) FROM lineitem WHERE l_returnflag <> 'R' UNION ALL SELECT 'preview', 'thumbnail', count(*), CAST(104 * count(*) AS BIGINT) FROM lineitem""",
    "picture_runs": """WITH l AS (SELECT l_orderkey, row_number() OVER w AS idx, 100 + CAST(floor(l_quantity) AS BIGINT) // 10 AS width FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_quantity, l_partkey)),
  s AS (SELECT *, CASE WHEN lag(width) OVER v = width THEN 0 ELSE 1 END AS new FROM l WINDOW v AS (PARTITION BY l_orderkey ORDER BY idx)),
  r AS (SELECT *, sum(new) OVER (PARTITION BY l_orderkey ORDER BY idx) AS run FROM s)
  SELECT 'order' || l_orderkey || '.xdw' AS path, CAST(run AS BIGINT) AS run, CAST(min(idx) AS INTEGER) AS first, count(*) AS n, min(width) AS width FROM r GROUP BY l_orderkey, run""",
    "sniff_pages": "SELECT page_id, CASE WHEN starts_with(html, '%PDF-') THEN 'PDF' WHEN starts_with(html, '<!DOCTYPE') OR starts_with(html, '<html') OR starts_with(html, '<?xml') THEN 'markup' END AS label FROM pages",
    "html_escape": "SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS escaped FROM documents",
    "csv_quote": "SELECT conv_id, turn, CASE WHEN regexp_matches(text, '[,\"\\n]') THEN '\"' || replace(text, '\"', '\"\"') || '\"' ELSE text END AS cell FROM conversations",
    "output_names": "SELECT doc_id, CASE WHEN n = 1 THEN source ELSE source || '~' || n END AS name FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents)",
}

QUERIES |= mark_queries.QUERIES | drawn_queries.QUERIES
ORACLE_SQL |= mark_queries.ORACLE_SQL | drawn_queries.ORACLE_SQL

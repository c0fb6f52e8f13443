"""Queries on marks, with marks made of order lines: an order is a page, a line a mark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, marks, reports
from ..sources import containers as src
from .fixtures import order_containers


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    key = F.struct("l_linenumber", "l_returnflag", "l_quantity", "l_partkey")
    numbered = t.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(key)).alias("a")).select("l_orderkey", F.posexplode("a").alias("k", "l"))
    q = F.floor("l.l_quantity").cast("bigint")
    return numbered.select(F.col("l_orderkey").alias("path"), F.lit(0).alias("idx"), (F.col("k") + 1).cast("bigint").alias("ord"), q.alias("q"), F.col("l.l_returnflag").alias("flag"), F.col("l.l_partkey").alias("part"))


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _lines(spark, sf_dir).select("path", "idx", "ord", F.col("q").cast("double").alias("y"), "flag").withColumnRenamed("flag", "text")
    return marks.page_text(texts, 10.0).select("path", "text", "lines")


def mark_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("q").cast("double")
    made = _lines(spark, sf_dir).select("path", "idx", "ord", F.when(F.col("flag") == "R", "shape").otherwise("fill").alias("kind"), x.alias("left"), x.alias("top"), (x + 10).alias("right"), (x + 5).alias("bottom"), F.lit(2.0).alias("stroke_width"), F.lit("").alias("text"))
    return marks.bounds(made).select("path", "left", "top", "right", "bottom")


def mark_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.when(F.col("flag") == "R", "text").when(F.col("flag") == "A", "image").otherwise("fill")
    made = _lines(spark, sf_dir).select("path", "idx", F.floor(F.col("ord") / 2).alias("ord"), kinds.alias("kind"), F.col("q").alias("left"), F.col("part").alias("top"))
    return marks.draw_order(made, True).groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "kind"))), lambda x: x["kind"]), ",").alias("kinds"))


def masked_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.lit(1.0)
    made = _lines(spark, sf_dir).select("path", "idx", "ord", F.when(F.col("ord") % 2 == 1, "xor").otherwise("and").alias("op"), side.alias("left"), side.alias("top"), side.alias("right"), F.floor(F.col("q") / 26).cast("double").alias("bottom"), F.when(F.col("ord") % 2 == 1, F.col("part") % 3).alias("picture"), F.lit(1).alias("source"), F.when(F.col("flag") == "R", 1).alias("clip"))
    return marks.masked_pictures(made).select("path", "first")


def number_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("grp"), F.floor(F.col("o_orderkey") / 64).alias("id")).distinct()
    return marks.number_runs(ids)


def gap_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marks.chained(_lines(spark, sf_dir).where("flag <> 'R'").select("path", F.col("ord").alias("page")))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of containers made of orders: a picture for each returned line, an unreadable page for the others."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_partkey")
    return reports.manifest(src.pages(order_containers(lines)))


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_partkey")
    found = reports.streams(src.parsed(order_containers(lines)))
    return found.groupBy("path", "role").agg(F.count("*").alias("n"), F.sum("stored").alias("bytes"))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversions whose page counts are the remainders of the orders' keys by nine."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_partkey")
    docs = audit.covered(src.parsed(order_containers(lines)))
    seen = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("order"), F.col("o_orderkey").cast("string"), F.lit(".xdw")).alias("path"), (F.col("o_orderkey") % 9).cast("bigint").alias("pages"))
    return reports.findings(reports.expectation(docs), seen).select("path", "expected", "observed", "finding", "loss")


QUERIES = {"page_text": page_text, "mark_bounds": mark_bounds, "mark_order": mark_order, "masked_pictures": masked_pictures, "number_runs": number_runs, "gap_chain": gap_chain, "manifest": manifest, "streams": streams, "findings": findings}

_LINES = """WITH l AS (SELECT l_orderkey AS path, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_quantity, l_partkey) AS ord,
  CAST(floor(l_quantity) AS BIGINT) AS q, l_returnflag AS flag, l_partkey AS part FROM lineitem)"""

ORACLE_SQL = {
    "page_text": _LINES + """, s AS (SELECT *, CASE WHEN abs(q - lag(q) OVER (PARTITION BY path ORDER BY ord)) > 10 THEN chr(10) ELSE '' END AS brk FROM l)
  SELECT path, string_agg(brk || flag, '' ORDER BY ord) AS text, 1 + count(*) FILTER (brk <> '') AS lines FROM s GROUP BY path""",
    "mark_bounds": _LINES + """ SELECT path, min(q - CASE WHEN flag = 'R' THEN 1.0::DOUBLE ELSE 0 END) AS "left", min(q - CASE WHEN flag = 'R' THEN 1.0::DOUBLE ELSE 0 END) AS top,
  max(q + 10 + CASE WHEN flag = 'R' THEN 1.0::DOUBLE ELSE 0 END) AS "right", max(q + 5 + CASE WHEN flag = 'R' THEN 1.0::DOUBLE ELSE 0 END) AS bottom FROM l GROUP BY path""",
    "mark_order": _LINES + """, m AS (SELECT path, ord // 2 AS o, q, part, CASE flag WHEN 'R' THEN 'text' WHEN 'A' THEN 'image' ELSE 'fill' END AS kind FROM l)
  SELECT path, string_agg(kind, ',' ORDER BY kind = 'text', o, kind, q, part) AS kinds FROM m GROUP BY path""",
    "masked_pictures": "WITH RECURSIVE " + _LINES[5:] + """, b AS (SELECT path, ord, q // 26 AS side, lead(q // 26) OVER w AS s1, lead(q // 26, 2) OVER w AS s2, part % 3 AS pic, lead(part % 3, 2) OVER w AS pic2, flag = 'R' AS clip, lead(flag = 'R') OVER w AS c1, lead(flag = 'R', 2) OVER w AS c2 FROM l WINDOW w AS (PARTITION BY path ORDER BY ord)),
  t AS (SELECT path, ord FROM b WHERE ord % 2 = 1 AND side = s1 AND side = s2 AND pic = pic2 AND clip = c1 AND clip = c2),
  r AS (SELECT path, min(ord) AS ord FROM t GROUP BY path UNION ALL SELECT r.path, (SELECT min(t.ord) FROM t WHERE t.path = r.path AND t.ord > r.ord + 2) FROM r WHERE r.ord IS NOT NULL)
  SELECT path, ord AS first FROM r WHERE ord IS NOT NULL""",
    "number_runs": """WITH i AS (SELECT DISTINCT o_custkey AS grp, CAST(floor(o_orderkey / 64) AS BIGINT) AS id FROM orders),
  s AS (SELECT grp, id, id - row_number() OVER (PARTITION BY grp ORDER BY id) AS k FROM i) SELECT grp, min(id) AS first, count(*) AS n FROM s GROUP BY grp, k""",
    "gap_chain": _LINES + " SELECT path, ord AS page, lag(ord) OVER w AS before, lead(ord) OVER w AS after FROM l WHERE flag <> 'R' WINDOW w AS (PARTITION BY path ORDER BY ord)",
    "manifest": _LINES + """ SELECT 'order' || path || '.xdw' AS path, CAST(ord AS INTEGER) AS page, CASE WHEN flag = 'R' THEN 'jpeg' ELSE 'encoded' END AS kind, CASE WHEN flag = 'R' THEN '' ELSE '210.0' END AS width_mm,
  CASE WHEN flag = 'R' THEN '' ELSE '297.0' END AS height_mm, flag = 'R' AS recoverable FROM l""",
    "streams": """SELECT 'order' || l_orderkey || '.xdw' AS path, 'preview' AS role, count(*) AS n, CAST(32 * count(*) AS BIGINT) AS bytes FROM lineitem GROUP BY l_orderkey
  UNION ALL SELECT 'order' || l_orderkey || '.xdw', 'page', count(*), CAST(32 * count(*) AS BIGINT) FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_orderkey""",
    "findings": """WITH e AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1), b AS (SELECT 'order' || k || '.xdw' AS path, n AS expected, CAST(o_orderkey % 9 AS BIGINT) AS observed FROM e JOIN orders ON o_orderkey = k)
  SELECT path, expected, observed, 'PageCount' AS finding, observed < expected AS loss FROM b WHERE observed <> expected UNION ALL SELECT path, expected, observed, 'PreviewsConverted', false FROM b WHERE observed = 2 * expected""",
}

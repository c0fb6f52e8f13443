"""What pages draw, as tables: reading order, bounds, masked pictures, covered glyphs, surveys. Marks have path, idx, kind, ord and a box (left, top, right, bottom)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PAGE = ("path", "idx")
LINE_GAP = 40.0
SAME = 0.01
GLYPHS = 3


def page_text(texts: DataFrame, gap: float = LINE_GAP) -> DataFrame:
    """A page's texts in the order of drawing; a line ends where the next text stands more than `gap` off. texts: path, idx, ord, y, text."""
    order = W.partitionBy(*PAGE).orderBy("ord")
    new = F.coalesce(F.abs(F.col("y") - F.lag("y").over(order)) > gap, F.lit(False))
    lines = texts.withColumn("line", F.sum(F.when(new, 1).otherwise(0)).over(order))
    per = lines.groupBy(*PAGE, "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "").alias("t"))
    return per.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "t"))), lambda x: x["t"]), "\n").alias("text"), F.count("*").alias("lines"))


def draw_order(marks: DataFrame, texts_last: bool = False) -> DataFrame:
    """Marks with their place on the page: by order, fills before images before shapes before texts on ties; or all texts last."""
    rank = F.array_position(F.array(*[F.lit(k) for k in ("fill", "image", "shape", "text")]), F.col("kind"))
    late = F.when(F.col("kind") == "text", 1).otherwise(0) if texts_last else F.lit(0)
    return marks.withColumn("place", F.row_number().over(W.partitionBy(*PAGE).orderBy(late, "ord", rank, "left", "top")))


def bounds(marks: DataFrame) -> DataFrame:
    """The box around all of a page's marks but blank texts, strokes included."""
    pad = F.when(F.col("kind") == "shape", F.coalesce("stroke_width", F.lit(0.0)) / 2).otherwise(0.0)
    drawn = marks.where("kind <> 'text' or trim(text) <> ''").withColumn("pad", pad)
    return drawn.groupBy(*PAGE).agg(F.min(F.col("left") - F.col("pad")).alias("left"), F.min(F.col("top") - F.col("pad")).alias("top"), F.max(F.col("right") + F.col("pad")).alias("right"), F.max(F.col("bottom") + F.col("pad")).alias("bottom"))


def masked_pictures(images: DataFrame) -> DataFrame:
    """Pictures drawn through a mask: a stored picture by xor, an inline one by and, and the stored one by xor again, in one box and clip in a row. A call is in one triple at most, the earliest: triples that
    overlap alternate, as in a walk that goes on behind each one it finds. images: path, idx, ord, op, box, picture (the entry of a stored one, null for an inline one), source, clip."""
    order = W.partitionBy(*PAGE).orderBy("ord")
    near = F.lit(True)
    for side in ("left", "top", "right", "bottom"):
        for k in (1, 2):
            near = near & (F.abs(F.lead(side, k).over(order) - F.col(side)) <= SAME)
    row = (F.lead("ord", 1).over(order) == F.col("ord") + 1) & (F.lead("ord", 2).over(order) == F.col("ord") + 2)
    for k in (1, 2):
        near = near & F.lead("clip", k).over(order).eqNullSafe(F.col("clip"))
    near = near & F.lead("picture", 1).over(order).isNull() & (F.lead("picture", 2).over(order) == F.col("picture")) & F.lead("source", 2).over(order).eqNullSafe(F.col("source"))
    ops = (F.col("op") == "xor") & (F.lead("op", 1).over(order) == "and") & (F.lead("op", 2).over(order) == "xor")
    starts = images.withColumn("starts", F.coalesce(near & row & ops, F.lit(False))).where("starts")
    # triples that share a call begin two orders apart
    new = F.coalesce(F.col("ord") - F.lag("ord").over(order) > 2, F.lit(True))
    chains = starts.withColumn("chain", F.sum(F.when(new, 1).otherwise(0)).over(order))
    place = F.row_number().over(W.partitionBy(*PAGE, "chain").orderBy("ord"))
    return chains.withColumn("k", place).where("k % 2 = 1").select(*PAGE, F.col("ord").alias("first"), "left", "top", "right", "bottom")


def covered_texts(glyphs: DataFrame, shapes: DataFrame, cell: float) -> DataFrame:
    """Texts of three characters or more of which at least three quarters lie under shapes: path, idx, ord, glyphs, covered. Boxes
    meet on cells of a grid that both sides are dealt to, so no page is crossed with itself; `cell` is about the size of a glyph.
    glyphs: path, idx, ord, k, box; shapes: path, idx, s, box, none much larger than a glyph."""

    def dealt(t: DataFrame) -> DataFrame:
        across = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell)))
        return t.withColumn("gx", across("left", "right")).withColumn("gy", across("top", "bottom"))

    s = dealt(shapes).select(*[F.col(c).alias(f"s_{c}") for c in ("path", "idx", "left", "top", "right", "bottom", "gx", "gy")])
    g = dealt(glyphs)
    wide = F.least("right", "s_right") - F.greatest("left", "s_left")
    high = F.least("bottom", "s_bottom") - F.greatest("top", "s_top")
    area = (F.col("right") - F.col("left")) * (F.col("bottom") - F.col("top"))
    meets = (F.col("path") == F.col("s_path")) & (F.col("idx") == F.col("s_idx")) & (F.col("gx") == F.col("s_gx")) & (F.col("gy") == F.col("s_gy")) & (wide > 0) & (high > 0) & (wide * high * 100 >= area)
    hit = g.join(s, meets, "left_semi").select(*PAGE, "ord", "k").distinct().groupBy(*PAGE, "ord").agg(F.count("*").alias("covered"))
    total = glyphs.groupBy(F.col("path").alias("tp"), F.col("idx").alias("ti"), F.col("ord").alias("to")).agg(F.count("*").alias("glyphs"))
    joined = hit.join(total, (F.col("tp") == F.col("path")) & (F.col("ti") == F.col("idx")) & (F.col("to") == F.col("ord")))
    return joined.where((F.col("glyphs") >= GLYPHS) & (F.col("covered") * 4 >= F.col("glyphs") * 3)).select(*PAGE, "ord", "glyphs", "covered")


def skipped_survey(skipped: DataFrame) -> DataFrame:
    """Records that were not drawn: pages that have them, and how many there are. skipped: path, idx, record, n."""
    return skipped.groupBy("record", *PAGE).agg(F.sum("n").alias("n")).groupBy("record").agg(F.count("*").alias("pages"), F.sum("n").alias("records"))


def number_runs(ids: DataFrame) -> DataFrame:
    """Runs of consecutive numbers in each group: grp, first, n. ids: grp, id, distinct."""
    island = F.col("id") - F.row_number().over(W.partitionBy("grp").orderBy("id"))
    return ids.withColumn("island", island).groupBy("grp", "island").agg(F.min("id").alias("first"), F.count("*").alias("n")).drop("island")


def chained(gaps: DataFrame) -> DataFrame:
    """Pages that are gaps, with the gaps before and after: path, page, before, after."""
    order = W.partitionBy("path").orderBy("page")
    return gaps.select("path", "page", F.lag("page").over(order).alias("before"), F.lead("page").over(order).alias("after"))


def upright_columns(texts: DataFrame) -> DataFrame:
    """Pages whose texts stand upright in columns: three texts or more of one character at one quarter turn, two of them within 1 of one
    column, and one that is more than 1 off the first one's line. Blank texts do not count. texts: path, idx, ord, x, y, text, escapement."""
    runs = texts.where("trim(text) <> ''").withColumn("turn", F.pmod(F.col("escapement"), F.lit(3600)))
    order, by_x = W.partitionBy(*PAGE).orderBy("ord"), W.partitionBy(*PAGE).orderBy("x")
    told = runs.withColumn("near", F.coalesce(F.col("x") - F.lag("x").over(by_x) <= 1, F.lit(False))).withColumn("off", F.abs(F.col("y") - F.first("y").over(order)) > 1)
    per = told.groupBy(*PAGE).agg(F.count("*").alias("n"), F.max(F.length("text")).alias("longest"), F.min("turn").alias("lo"), F.max("turn").alias("hi"), F.max("near").alias("near"), F.max("off").alias("off"))
    return per.where("n >= 3 and longest = 1 and lo = hi and lo in (900, 2700) and near and off").select(*PAGE, "n")

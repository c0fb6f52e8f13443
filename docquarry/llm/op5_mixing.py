"""Mixing sources to target weights by entropy balancing, with DataFrame functions alone.

Each source gets a target of words. Document rates r(x) = 2 / (1 + exp(-lambda x)) are the
maximum-entropy rates between 0 and 2 copies whose words sum to the target; lambda solves the convex
dual of the source's token constraint by Newton steps that fall back to bisection. All sources take
their steps together: a step is a join of the size histogram with the current multipliers and one
grouped sum. Rates then become copies (0, 1, 2) by a threshold on a hash of the document, moved for each source so
that the rounded words meet the target.

Cases: a null text has size 0; null sources are one source, last in order; documents of size 0 take 0
words; rows that repeat an id are documents of their own with the same rank; an empty table gives an
empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import read_table, staged

WORD = r"[^\x20\x09-\x0D]+"
BINS = 1 << 16


def sizes(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, source, size in words."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sized: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """Rows (source, source_size, second, target). Water filling: with sources ordered by the level at
    which they are full, the level of the rest is what is left over the weights that are left."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size").cast("double") * F.col("size")).alias("second"))
    ranked = per.withColumn("k", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    n = len(weights)
    ranked = ranked.select("source", "source_size", "second", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("k") % n + 1).cast("int")).alias("weight"), (F.col("source_size") * F.lit(most)).alias("cap"))
    by_level = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by_level.rowsBetween(W.currentRow, W.unboundedFollowing))
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    budget = F.sum("source_size").over(everything) * F.lit(share)
    level = (budget - before) / left
    held = ranked.withColumn("level", level).withColumn("place", F.row_number().over(by_level))
    first = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct("place", "level"))).over(everything)
    return held.withColumn("final", first["level"]).select("source", "source_size", "second", F.coalesce(F.least("cap", F.col("weight") * F.col("final")), F.col("cap")).alias("target"))


def rate(lam: Column, size: Column, scale: Column) -> Column:
    return F.lit(2.0) / (F.lit(1.0) + F.exp(-(lam * size / scale)))


def multipliers(sized: DataFrame, goals: DataFrame, steps: int = 12, bound: float = 60.0) -> DataFrame:
    """Rows (source, source_size, target, scale, lam): the dual solved by safeguarded Newton steps on the
    histogram (source, size), which holds all that the dual needs."""
    hist = staged(sized.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")))
    goals = staged(goals.withColumn("scale", F.when(F.col("second") > 0, F.col("second") / F.col("source_size")).otherwise(F.lit(1.0))))
    state = goals.select("source", "target", "scale", F.lit(0.0).alias("lam"), F.lit(-bound).alias("lo"), F.lit(bound).alias("hi"))
    h = hist.select(F.col("source").alias("hs"), "size", "n")
    for step in range(steps):
        s = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("lam") * F.col("size") / F.col("scale"))))
        joined = state.join(h, F.col("hs").eqNullSafe(F.col("source")))
        words = F.col("n") * F.col("size")
        sums = joined.groupBy("source", "target", "scale", "lam", "lo", "hi").agg(F.sum(words * 2 * s).alias("f"), F.sum(words * 2 * s * (1 - s) * F.col("size") / F.col("scale")).alias("d"))
        over = F.col("f") > F.col("target")
        lo, hi = F.when(over, F.col("lo")).otherwise(F.col("lam")), F.when(over, F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - (F.col("f") - F.col("target")) / F.col("d")
        # an underflown slope makes the step null or infinite: bisect
        sums = sums.select("source", "target", "scale", lo.alias("lo"), hi.alias("hi"), newton.alias("step"))
        inside = F.col("step").isNotNull() & (F.col("step") > F.col("lo")) & (F.col("step") < F.col("hi"))
        state = sums.select("source", "target", "scale", F.when(inside, F.col("step")).otherwise((F.col("lo") + F.col("hi")) / 2).alias("lam"), "lo", "hi")
        if step % 4 == 3:
            state = staged(state)
    lam = state.select(F.col("source").alias("ls"), "lam")
    out = goals.join(lam, F.col("ls").eqNullSafe(F.col("source")), "left")
    return staged(out.select("source", "source_size", "target", "scale", F.coalesce("lam", F.lit(0.0)).alias("lam")))


def _rated(sized: DataFrame, per_source: DataFrame) -> DataFrame:
    """Adds whole (copies for certain, 0 or 1) and bin, the place at which the document gets one more."""
    m = per_source.withColumnRenamed("source", "ms")
    uniform = F.shiftrightunsigned(F.xxhash64(F.lit(5), F.col("doc_id")), 11) / F.lit(float(1 << 53))
    rated = sized.join(m, F.col("ms").eqNullSafe(F.col("source"))).drop("ms").withColumn("rate", rate(F.col("lam"), F.col("size"), F.col("scale")))
    whole = F.when(F.col("rate") >= 1, F.lit(1)).otherwise(F.lit(0))
    return rated.withColumn("whole", whole).withColumn("bin", F.floor((uniform - (F.col("rate") - F.col("whole")) + 1) * (BINS // 2)).cast("int")).drop("rate", "lam", "scale")


def mixing_plan(sized: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source: sizes, target, multiplier and thresholds, all that a document's copies depend on."""
    solved = multipliers(sized, targets(sized, weights, share, most))
    placed = _rated(sized, solved)
    bases = placed.groupBy(F.col("source").alias("bs")).agg(F.sum(F.col("whole") * F.col("size")).alias("base"))
    rooms = solved.join(bases, F.col("bs").eqNullSafe(F.col("source"))).select("source", (F.col("target") - F.coalesce("base", F.lit(0))).alias("room"))
    first = _cuts(placed.select("source", "bin", "size"), rooms, over=False)
    # a long document may leave room in a small source: shorter ones after it fill that
    f = first.withColumnRenamed("source", "fs")
    fits = placed.join(f, F.col("fs").eqNullSafe(F.col("source"))).where((F.col("bin") > F.col("cut")) & (F.col("size") <= F.col("left")))
    second = _cuts(fits.select("source", "bin", "size"), first.select("source", F.col("left").alias("room")), over=True)
    out = solved.join(f, F.col("fs").eqNullSafe(F.col("source"))).drop("fs")
    s = second.select(F.col("source").alias("ss"), F.col("cut").alias("cut2"))
    return staged(out.join(s, F.col("ss").eqNullSafe(F.col("source"))).drop("ss"))


def with_copies(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds source_size, target and copies to rows that have doc_id, source and size."""
    placed = _rated(sized, plan)
    more = (F.col("bin") <= F.col("cut")) | ((F.col("bin") > F.col("cut")) & (F.col("size") <= F.col("left")) & (F.col("bin") <= F.col("cut2")))
    return placed.withColumn("copies", F.col("whole") + F.when(more, 1).otherwise(0)).drop("whole", "bin", "cut", "left", "cut2")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Rows (doc_id, source, size, source_size, target, copies), one per document. A source that is too
    small for its share is taken `most` = 2 times in full and the rest is shared again."""
    sized = staged(sizes(docs))
    return with_copies(sized, mixing_plan(sized, weights, share, most))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with all their columns."""
    plan = mixing_plan(staged(sizes(docs)), weights, share, most)
    names = {c: c if c in ("doc_id", "source", "text") else f"c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    sized = plain.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    taken = with_copies(sized, plan).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return taken.select(*[F.col(n).alias(c) for c, n in names.items()])


def _cuts(ranked: DataFrame, rooms: DataFrame, over: bool) -> DataFrame:
    """Rows (source, cut, left): the last bin up to which the sizes fill the source's room, or with
    `over` come nearest to it, and the room that is left."""
    bins = ranked.groupBy(F.col("source").alias("bin_source"), "bin").agg(F.sum("size").alias("w"))
    upto = F.sum("w").over(W.partitionBy("bin_source").orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow))
    sums = rooms.join(bins.withColumn("upto", upto), F.col("bin_source").eqNullSafe(F.col("source")), "left")
    taken = 2 * F.col("upto") - F.col("w") <= 2 * F.col("room") if over else F.col("upto") <= F.col("room")
    per = sums.groupBy("source", "room").agg(F.coalesce(F.max(F.when(taken, F.col("bin"))), F.lit(-1)).alias("cut"), F.coalesce(F.max(F.when(taken, F.col("upto"))), F.lit(0)).alias("filled"))
    return staged(per.select("source", "cut", (F.col("room") - F.col("filled")).alias("left")))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))

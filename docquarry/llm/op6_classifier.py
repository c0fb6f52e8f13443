"""Quality classifier with hierarchical empirical Bayes.

Two classifiers (low quality, toxic) are fitted on a bounded sample of labelled documents: a word lexicon by log odds and a
logistic model over shape measures and lexicon hits. Their log odds are a document's evidence. Sites
and paths have rates of their own: the global rate is a Beta prior for sites, a site's posterior rate is the prior of
its paths, and the strength of each prior is estimated from the spread of the rates of sites, and of paths within sites (method of moments), so that
sparse sites shrink to the global rate and sparse paths to their site's. All rates are grouped sums over
documents, and each document is left out of its own. A document's posterior combines its evidence with the rate of its path; it is kept if it
is neither likely to be of low quality nor likely to be toxic.

Cases: null text is empty and, as text without words, of low quality by its shape; null sites and paths are sites
and paths of their own; documents without labels are scored alike; rows that repeat are scored alike; with no labels at all, nothing is known
against any document and all are kept; an empty table gives an empty result; other columns are ignored. Texts may be of any length: they are
scored in slices of rows, a longer text as a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_view, read_table, row_slices, staged, word_hashes

#: Labelled documents that the classifiers are fitted on, at most; taken in the order of a hash of their id.
SAMPLE = 6000
#: Bytes of their texts, at most: what the driver is sent.
SAMPLE_BYTES = 48 << 20
LEXICON = 4096
SLICE_BYTES, FIT_BYTES = 1 << 21, 1 << 19
SHAPES = 11


#: Words of the lexicon are parted by ASCII marks as well as by white space.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[c for c in range(33, 127) if not chr(c).isalnum()]] = 32


def _counts(flag: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flag)])
    return (sums[ends[1:]] - sums[ends[:-1]]).astype(np.float64)


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER, _DIGIT, _MARK, _PIPE, _STOP = _class(bytes(range(65, 91))), _class(b"0123456789"), _class(b"#*$%&<>{}[]\\^~_=+@"), _class(b"|"), _class(b".,;:")
_SHOUT, _LINE, _LEAD = _class(b"!?"), _class(b"\n"), ~_class(bytes(range(128, 192)))


def shapes(raw: np.ndarray, ends: np.ndarray, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Measures of the shape of each text: rates of kinds of characters, lengths, and how often words repeat."""
    n = len(ends) - 1
    chars = np.maximum(_counts(_LEAD[raw], ends), 1)
    per_word = np.maximum(counts, 1)
    row = np.repeat(np.arange(n), counts)
    order = np.lexsort((words, row))
    w, r = words[order], row[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (r[1:] != r[:-1])
    distinct = np.bincount(r[new], minlength=n).astype(np.float64)
    next_same = np.zeros(len(words), bool)
    next_same[:-1] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
    in_row = np.bincount(row[next_same], minlength=n) / per_word
    lines = _counts(_LINE[raw], ends) + 1
    cols = [_counts(t[raw], ends) / per_word for t in (_MARK, _PIPE, _SHOUT, _STOP)]
    cols += [_counts(_UPPER[raw], ends) / chars, _counts(_DIGIT[raw], ends) / chars, chars / per_word, distinct / per_word, in_row, np.log1p(counts), np.log1p(counts / lines)]
    return np.stack([np.minimum(c, 50.0) for c in cols], axis=1)


@dataclass
class Classifier:
    """A lexicon of word hashes with log odds, and the weights of a logistic model."""

    words: np.ndarray
    odds: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def features(self, words, counts, shape) -> np.ndarray:
        n = len(counts)
        hits, total = np.zeros(n), np.zeros(n)
        if len(self.words) and len(words):
            at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            found = self.words[at] == words
            row = np.repeat(np.arange(n), counts)[found]
            hits = np.bincount(row, minlength=n).astype(np.float64)
            total = np.bincount(row, weights=self.odds[at[found]], minlength=n)
        return np.concatenate([shape, np.stack([np.minimum(hits, 5), np.minimum(total, 20), np.minimum(hits / np.maximum(counts, 1) * 100, 20)], axis=1)], axis=1)

    def evidence(self, features: np.ndarray) -> np.ndarray:
        """Log odds for the label without the rate it has in the sample."""
        x = (features - self.mean) / self.scale
        return np.clip(self.weights[0] + x @ self.weights[1:] - self.prior, -30, 30)


def _distinct(words: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's words once."""
    order = np.lexsort((words, row))
    w, r = words[order], row[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (r[1:] != r[:-1])
    return w[new], r[new]


def fit(texts: pa.Array, label: np.ndarray) -> Classifier:
    """Reads the texts in slices, so that the driver holds their words but not one array per byte."""
    raw, at = byte_view(texts)
    n = len(at) - 1
    slices, once = [], []
    for lo, hi in row_slices(at, FIT_BYTES):
        part, ends = raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        words, counts = word_hashes(_PLAIN[part], ends, lower=True)
        slices.append((words, counts, shapes(part, ends, words, counts)))
        once.append(_distinct(words, np.repeat(np.arange(lo, hi, dtype=np.int32), counts)))
    w, r = (np.concatenate([o[k] for o in once]) for k in range(2))
    once.clear()
    u, back = np.unique(w, return_inverse=True)
    n1, n0 = max(label.sum(), 1), max(n - label.sum(), 1)
    own = np.bincount(back, weights=label[r], minlength=len(u))
    other = np.bincount(back, minlength=len(u)) - own
    odds = np.log((own + 0.5) / (n1 + 1)) - np.log((other + 0.5) / (n0 + 1))
    strong = np.flatnonzero((own >= max(5, 0.03 * n1)) & (odds > 2.5))
    strong = np.sort(strong[np.argsort(-odds[strong], kind="stable")[:LEXICON]])
    c = Classifier(u[strong], odds[strong], np.zeros(SHAPES + 3), np.ones(SHAPES + 3), np.zeros(SHAPES + 4), 0.0)
    x = np.concatenate([c.features(words, counts, shape) for words, counts, shape in slices])
    c.mean, c.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.concatenate([np.ones((n, 1)), (x - c.mean) / c.scale], axis=1)
    weights = np.zeros(z.shape[1])
    ridge = np.diag([1e-6, *[1.0] * (z.shape[1] - 1)])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ weights, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (label - p) - ridge @ weights)
        weights += step
        if np.abs(step).max() < 1e-6:
            break
    c.weights = weights
    rate = min(max(label.mean(), 1e-3), 1 - 1e-3)
    c.prior = float(np.log(rate / (1 - rate)))
    return c


def _score(shared, carry: list[str], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = byte_view(batch.column("text"))
            out = {k: np.zeros(len(at) - 1) for k in names}
            for lo, hi in row_slices(at, SLICE_BYTES):
                part, ends = raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
                words, counts = word_hashes(_PLAIN[part], ends, lower=True)
                shape = shapes(part, ends, words, counts)
                for k, c in shared.value.items():
                    out[k][lo:hi] = c.evidence(c.features(words, counts, shape))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), *(pa.array(out[k]) for k in names)], [*carry, *names])

    return run


def _logit(p):
    return F.log(p / (1 - p))


def _posterior(scored: DataFrame, name: str, site: str, path: str, rate: float) -> DataFrame:
    """scored with rate_<name>: for each row the rate of its path, shrunk to its site's, shrunk to the global one; sums of path and
    site are taken without the row itself, whose evidence is added to the rate later. scored has the evidence `name`; rate is that of the labels."""
    soft = 1 / (1 + F.exp(-(F.col(name) + float(np.log(rate / (1 - rate))))))
    paths = scored.groupBy(F.col(site).alias("s"), F.col(path).alias("p")).agg(F.sum(soft).alias("y"), F.count("*").cast("double").alias("n"))
    sites = paths.groupBy("s").agg(F.sum("y").alias("sy"), F.sum("n").alias("sn"))
    whole = sites.agg((F.sum("sy") / F.sum("sn")).alias("m"), F.sum("sn").alias("tn"), F.count("*").alias("k"), F.sum(F.col("sn") * F.pow(F.col("sy") / F.col("sn"), 2)).alias("q"), F.sum(F.col("sn") * F.col("sn")).alias("n2")).first()
    if not whole or not whole["tn"]:
        strength, m = 10.0, rate
    else:
        m = min(max(whole["m"], 1e-6), 1 - 1e-6)
        # between-site variance by moments; the rest of the spread is that of sampling
        spread = max(whole["q"] / whole["tn"] - m * m, 0.0)
        between = max(spread - m * (1 - m) * whole["k"] / whole["tn"], 0.0)
        strength = min(max(m * (1 - m) / between - 1, 2.0), 1e6) if between > 0 else 1e6
    # the same within sites: the spread of their paths' rates beyond that of sampling, against what paths without any likeness would show
    r, own = F.col("sy") / F.col("sn"), F.col("y") / F.col("n")
    of_paths = paths.groupBy("s").agg(F.sum(F.col("n") * F.col("n")).alias("n2"), F.sum(F.col("n") * own * own).alias("q"), F.sum("y").alias("sy"), F.sum("n").alias("sn"), F.count("*").alias("k"))
    within = of_paths.agg(F.sum(F.col("q") - F.col("sn") * r * r).alias("q"), F.sum(r * (1 - r) * (F.col("k") - 1)).alias("a"), F.sum(r * (1 - r) * (F.col("sn") - F.col("n2") / F.col("sn"))).alias("b")).first()
    inner = strength if not within or not within["b"] else 1e6
    if within and within["b"] and within["b"] > within["a"] and within["q"] > within["a"]:
        inner = min(max((within["b"] - within["a"]) / (within["q"] - within["a"]) - 1, 2.0), 1e6)
    # the sums of a path and of its site, for its rows
    sums = staged(paths.join(sites.withColumnRenamed("s", "ss"), F.col("ss").eqNullSafe(F.col("s"))).select("s", "p", "y", "n", "sy", "sn"))
    joined = scored.join(sums, F.col("s").eqNullSafe(F.col(site)) & F.col("p").eqNullSafe(F.col(path)))
    of_site = (F.col("sy") - soft + F.lit(strength * m)) / (F.col("sn") - 1 + F.lit(strength))
    of_path = (F.col("y") - soft + of_site * inner) / (F.col("n") - 1 + F.lit(inner))
    return joined.withColumn(f"rate_{name}", F.least(F.greatest(of_path, F.lit(1e-6)), F.lit(1 - 1e-6))).drop("s", "p", "y", "n", "sy", "sn")


def classified(docs: DataFrame, labels: DataFrame, site: str = "source", path: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """Rows (doc_id, p_low, p_toxic, kept). docs: doc_id, text, and the columns of site and path; labels: doc_id, quality, toxic."""
    spark = docs.sparkSession
    marked = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("l_id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    some = marked.orderBy(F.xxhash64("l_id"), "l_id").limit(sample)
    # of rows that share an id the least text counts; rows are taken in the order of a hash, whole, as long as they come to no more than SAMPLE_BYTES
    found = docs.select("doc_id", "text").join(F.broadcast(some), F.col("l_id") == F.col("doc_id")).groupBy("l_id", "quality", "toxic").agg(F.min("text").alias("text"))
    taken = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).over(Window.orderBy(F.xxhash64("l_id"), "l_id"))
    rows = found.withColumn("taken", taken).where(F.col("taken") <= SAMPLE_BYTES).select("text", "quality", "toxic").toArrow()
    names = {}
    texts = rows.column("text").combine_chunks()
    for name, column, bad in (("low", "quality", 0), ("toxic", "toxic", 1)):
        values = np.array([-1 if v is None else v for v in rows.column(column).to_pylist()], np.int64)
        known = values >= 0
        label = (values[known] == bad).astype(np.float64)
        if known.any() and 0 < label.sum() < len(label):
            names[name] = fit(texts.filter(pa.array(known)), label)
    shared = spark.sparkContext.broadcast({f"e_{k}": c for k, c in names.items()})
    carry, made = ["doc_id", site, path], [f"e_{k}" for k in names]
    plain = docs.select(F.col("doc_id"), F.col(site), F.col(path), F.col("text"))
    schema = T.StructType([docs.schema[c] for c in carry] + [T.StructField(k, T.DoubleType()) for k in made])
    scored = staged(plain.mapInArrow(_score(shared, carry, made), schema))
    out = scored
    for name, c in names.items():
        out = _posterior(out, f"e_{name}", site, path, float(1 / (1 + np.exp(-c.prior))))
    p = {name: (1 / (1 + F.exp(-(F.col(f"e_{name}") + _logit(F.col(f"rate_e_{name}")))))) if name in names else F.lit(0.0) for name in ("low", "toxic")}
    return out.select("doc_id", p["low"].alias("p_low"), p["toxic"].alias("p_toxic")).withColumn("kept", (F.col("p_low") < 0.5) & (F.col("p_toxic") < 0.5))


def op6_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))

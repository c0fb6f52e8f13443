"""Secret scans over an inverted trigram index, with DataFrame functions alone.

Every rule's regex is turned into a Boolean trigram query (an OR of ANDs) by walking its parse tree. The
index holds (trigram, document) postings for the trigrams of all queries; a document is a rule's candidate
when its postings satisfy the rule's query, and only candidates run the regex. Rules without mandatory
trigrams scan every document.

Cases: null text is empty; rows that repeat doc_id and text share postings and get the same result each; null ids are kept; an empty table gives an
empty result; other columns are ignored; texts may be of any length and are scanned whole. A rule set may have any number of trigrams. Positions are code points and matches of one rule never overlap.
"""

from __future__ import annotations

import functools
import operator
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_key, let, read_table

try:
    from re import _constants as sre
    from re import _parser as sre_parse
except ImportError:
    import sre_constants as sre
    import sre_parse


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its regex (Java and Python agree on it), the group whose length counts, and the
    least length of that group in code points."""

    kind: str
    regex: str
    group: int
    least: int


#: Base rules in the order in which ties are listed, then the formats that issuers publish.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
MORE = (
    Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("slack", r"xox[abp]-[A-Za-z0-9-]{20,}", 0, 25),
    Rule("pem", r"-----BEGIN (RSA |EC |)PRIVATE KEY-----", 0, 27),
)


def _strings(tree, most: int = 64) -> list[tuple[set[str], bool]]:
    """The parse tree as a run of pieces: the strings a piece can match, and whether that is exact. A piece that is not exact breaks the run."""
    out = []
    for op, arg in tree:
        if op is sre.LITERAL:
            out.append(({chr(arg)}, True))
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg) and len(arg) <= 8:
            out.append(({chr(a) for _, a in arg}, True))
        elif op is sre.SUBPATTERN:
            out += _strings(arg[3], most) if len(arg[3]) else [({""}, True)]
        elif op is sre.BRANCH:
            words: set[str] | None = set()
            for branch in arg[1]:
                one = _join(_strings(branch, most), most)
                words = words | one if words is not None and one is not None else None
            out.append((words, True) if words is not None else (set(), False))
        elif op is sre.MAX_REPEAT and arg[:2] == (0, 1):
            one = _join(_strings(arg[2], most), most)
            out.append((one | {""}, True) if one is not None else (set(), False))
        else:
            out.append((set(), False))
    return out


def _join(pieces: list[tuple[set[str], bool]], most: int) -> set[str] | None:
    """All strings of a run that is exact throughout, or None."""
    words = {""}
    for options, exact in pieces:
        if not exact or len(words) * len(options) > most:
            return None
        words = {a + b for a in words for b in options}
    return words


def trigram_query(regex: str, most: int = 8) -> list[frozenset[str]]:
    """Lower-cased trigrams any of whose sets every match holds in full; [] if none are mandatory. Of the exact runs in the regex,
    takes the one whose shortest string is longest; of a long string, the first `most` trigrams."""
    best: set[str] = set()
    run: list[tuple[set[str], bool]] = []
    for piece in [*_strings(sre_parse.parse(regex)), (set(), False)]:
        longer = _join([*run, piece], 64)
        if longer is not None:
            run.append(piece)
            continue
        words = _join(run, 64) or {""}
        if min(map(len, words)) > min(map(len, best), default=0):
            best = words
        run = [piece] if piece[1] else []
    words = {w.lower() for w in best}
    if not words or min(map(len, words)) < 3:
        return []
    return sorted({frozenset(w[i : i + 3] for i in range(min(most, len(w) - 2))) for w in words}, key=sorted)


def _folded(text: Column) -> Column:
    """A-Z in lower case; other letters stay, as the rules' case folding is of ASCII letters alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """The index: rows (gram, did, dig) for each trigram a document's text holds. docs: did, dig, text."""
    found = let(_folded(F.col("text")), lambda t: F.filter(F.array(*[F.when(F.contains(t, F.lit(g)), F.lit(i)) for i, g in enumerate(grams)]), lambda x: x.isNotNull()))
    return docs.select("did", "dig", F.explode(found).alias("gram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...], grams: list[str]) -> DataFrame:
    """Rows (did, dig, rules): the rules whose queries a document's postings satisfy. A clause is satisfied where the postings of all its trigrams meet."""
    number = {g: i for i, g in enumerate(grams)}
    held = index.groupBy("did", "dig").agg(F.collect_set("gram").alias("held"))
    found = []
    for k, rule in enumerate(rules):
        clauses = [sorted(number[g] for g in clause) for clause in trigram_query(rule.regex)]
        if clauses:
            met = [F.size(F.array_intersect("held", F.array(*map(F.lit, c)))) == len(c) for c in clauses]
            found.append(F.when(functools.reduce(operator.or_, met), F.lit(k)))
    rules_of = F.array_compact(F.array(*found)) if found else F.array().cast("array<int>")
    return held.select("did", "dig", rules_of.alias("rules")).where(F.size("rules") > 0)


def _running(lengths: Column, block: int = 256) -> Column:
    """Running sums of an array of bigints, by blocks: no sum walks more than a block and the blocks' sums."""
    zero = F.lit(0).cast("long")
    total = lambda a: F.aggregate(a, zero, lambda x, y: x + y)

    def sums(a: Column) -> Column:
        n = F.size(a)
        ends = F.transform(F.sequence(F.lit(0), ((n - 1) / block).cast("int")), lambda b: total(F.slice(a, b * block + 1, F.lit(block))))
        return let(ends, lambda e: F.transform(a, lambda _, i: total(F.slice(e, F.lit(1), F.floor(i / block).cast("int"))) + total(F.slice(a, (F.floor(i / block) * block).cast("int") + 1, i % block + 1))))

    return let(lengths, lambda a: F.when(F.size(a) > 0, sums(a)).otherwise(a))


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """The rule's matches as structs (start, order, end)."""
    found = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))
    counted = F.transform(F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group)), lambda g: F.length(g).cast("long")) if rule.group else None
    between = F.transform(F.split(text, rule.regex, -1), lambda p: F.length(p).cast("long"))
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")

    def placed(lengths: Column) -> Column:
        steps = F.zip_with(between, F.concat(F.array(F.lit(0).cast("long")), lengths), lambda p, m: p + m)
        return let(_running(steps), lambda s: F.transform(lengths, lambda m, i: F.struct(F.get(s, i).alias("start"), F.lit(order).alias("kind"), (F.get(s, i) + m).alias("end"))))

    whole = let(F.transform(found, lambda m: F.length(m).cast("long")), placed)
    if counted is not None:
        pairs = F.zip_with(whole, counted, lambda a, g: F.when(g >= rule.least, a))
        kept = F.filter(pairs, lambda a: a.isNotNull())
    else:
        kept = F.filter(whole, lambda a: a["end"] - a["start"] >= rule.least)
    return F.when(text.rlike(rule.regex), kept).otherwise(empty)


def scan_secrets(docs: DataFrame, base: tuple[Rule, ...] = BASE, more: tuple[Rule, ...] = MORE) -> DataFrame:
    """Rows (doc_id, base, spans): arrays of (start, kind, end), kind being the rule's number."""
    rules = base + more
    queries = {r.kind: trigram_query(r.regex) for r in rules}
    grams = sorted({g for q in queries.values() for clause in q for g in clause})
    keyed = docs.select("doc_id", id_key().alias("did"), F.coalesce("text", F.lit("")).alias("text")).withColumn("dig", F.xxhash64("text"))
    index = postings(keyed.select("did", "dig", "text"), grams)
    hits = candidates(index, rules, grams).select(F.col("did").alias("cd"), F.col("dig").alias("cg"), "rules")
    rows = keyed.join(hits, (F.col("did") == F.col("cd")) & (F.col("dig") == F.col("cg")), "left").select("doc_id", "text", "rules")
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    spans = []
    for k, rule in enumerate(rules):
        one = _spans(F.col("text"), rule, k)
        spans.append(F.when(F.coalesce(F.array_contains("rules", k), F.lit(False)), one).otherwise(empty) if queries[rule.kind] else one)
    rows = rows.select("doc_id", F.array(*spans).alias("by"))
    return rows.select("doc_id", *[F.size(F.col("by")[k]).cast("long").alias(f"n_{r.kind}") for k, r in enumerate(base)], F.array_sort(F.flatten(F.slice("by", 1, len(base)))).alias("base"), F.array_sort(F.flatten("by")).alias("spans"))


def _joined(spans: Column, rules: tuple[Rule, ...]) -> Column:
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_joined(F.col("base"), BASE), 256).alias("base_sha256"), _joined(F.col("spans"), BASE + MORE).alias("spans"))


def _sql_spans(rule: Rule, k: int) -> str:
    rx = rule.regex.replace("'", "''").replace(r"\x20", " ").replace("(RSA |EC |)", "(RSA |EC )?")
    group = f"length(g[i]) >= {rule.least}" if rule.group else f"length(m[i]) >= {rule.least}"
    return f"""
    SELECT rid, {k} AS ord, '{rule.kind}' AS kind, s AS start, s + length(m[i]) AS stop FROM (
      SELECT rid, m, g, i, list_sum([length(x) for x in p[:i]]) + coalesce(list_sum([length(x) for x in m[:i-1]]), 0) AS s
      FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
        SELECT rid, regexp_extract_all(t, '{rx}', 0) AS m, regexp_extract_all(t, '{rx}', {rule.group}) AS g, string_split_regex(t, '{rx}') AS p FROM d)))
    WHERE {group}"""


def oracle() -> str:
    rules = BASE + MORE
    parts = " UNION ALL ".join(_sql_spans(r, k) for k, r in enumerate(rules))
    one = "kind || ':' || CAST(CAST(start AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(stop AS BIGINT) AS VARCHAR)"
    return f"""
    WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
    s AS MATERIALIZED ({parts}),
    a AS (SELECT rid, count(*) FILTER (kind = 'assign') AS na, count(*) FILTER (kind = 'access') AS nc, count(*) FILTER (kind = 'hex') AS nh,
      string_agg({one}, ',' ORDER BY start, ord) FILTER (ord < {len(BASE)}) AS b, string_agg({one}, ',' ORDER BY start, ord) AS e FROM s GROUP BY rid)
    SELECT doc_id, coalesce(na, 0) AS n_assign, coalesce(nc, 0) AS n_access, coalesce(nh, 0) AS n_hex,
      sha256(coalesce(b, '')) AS base_sha256, coalesce(e, '') AS spans FROM d LEFT JOIN a USING (rid)"""

"""HTML extraction by equivalence-class template deduction.

Pages are read as tokens: tags under the path of their open elements, and text blocks under their path. For each host,
tokens with the same occurrence vector (how often they stand on each page) are an equivalence class; a vector is told by the
sum of a hash of page and count, so that classes come from grouped sums and no host is gathered anywhere.
Classes that occur on enough of a host's pages are valid if their tags nest: all open inside the container of
the class that holds them, and are the host's template. A page's slots are the text blocks that
the template does not fix, inside the article as elsewhere; they are the candidates on all pages. Names are evidence afterwards: slots in menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are left out. The main text is the slots
in the elements that say they are the article (article, main), or else all of them, with fixed texts at the paths of slots in the lowest container of all; on a
host without a template, the container that holds nearly all text and what stands beside it as headings and paragraphs. A page
all of whose wanted text is fixed, such as copies of one page, keeps it.

Cases: null or empty html gives an empty text; a null url is a host of its own; hosts with few
pages have no template and their pages are read by their elements alone; unclosed and crossed tags are closed as
browsers do for paragraphs, list items and cells; rows that repeat are pages of their own; an empty table gives an empty
result; other columns are ignored. Pages may be of any length, nested or broken in any way: reading takes time and memory in proportion to a page.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, staged

#: A template's token stands on this share of a host's pages, and on three pages at least.
SUPPORT, FEWEST = 0.3, 3
#: For text inside article or main, which near copies of a page share too.
INNER_SUPPORT, INNER_FEWEST = 0.9, 5

_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"""[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)?))?""")
_TAG_END = re.compile(r"[\s/]*>")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe noframes xmp".split())
#: Elements whose content is not read where they are closed at all.
_SKIPPED = frozenset("noscript template object svg math canvas".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())
_SCOPE = frozenset("ul ol dl table article section div main body td th".split())
_NEVER = frozenset("nav header footer aside form button select dialog menu head".split()) | _RAW | _SKIPPED
#: A class or id names what is no article if all its words are of these, and one at least of the first.
_CHROME = frozenset(
    "nav navbar navigation menu menus header masthead footer foot sidebar aside ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion notice notices cookie cookies consent gdpr "
    "newsletter subscribe subscription signup login popup modal overlay breadcrumb breadcrumbs comment comments commentlist reply replies respond disqus discussion social share sharing related recommended widget widgets toolbar pagination pager copyright alert "
    "skiplink teaser teasers".split()
)
_BESIDE = frozenset(
    "site page main top bottom left right side global primary secondary user users reader readers sticky fixed mobile desktop box bar bars list item items block wrap wrapper container inner outer content section area slot unit zone link links button buttons btn icon icons "
    "form field row col column panel group text body author date meta thread tree count posts articles stories news google skip back my the and in".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())


def _attributes(page: str, at: int) -> tuple[dict[str, str], int]:
    """The attributes of a tag whose name ends at `at`, and where the tag ends. Unquoted values end at white space or >; a quote that is never closed is a part of a name."""
    found: dict[str, str] = {}
    while True:
        end = _TAG_END.match(page, at)
        if end:
            return found, end.end()
        m = _ATTR.match(page, at)
        if m is None:
            return found, len(page)
        found.setdefault(m[1].lower(), next((x for x in m.groups()[1:] if x is not None), ""))
        at = m.end()


def _chrome(name: str) -> bool:
    """Whether a class or id is the name of a menu, a notice and the like as a whole: a part of it says nothing."""
    words = [w for w in re.split(r"[-_:\d]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if w]
    return any(w in _CHROME for w in words) and all(w in _CHROME or w in _BESIDE for w in words)


def _unwanted(tag: str, attrs: dict[str, str]) -> bool:
    if tag in _NEVER:
        return True
    if not attrs or tag in ("html", "body"):
        return False
    if any(_chrome(word) for name in ("class", "id") for word in attrs.get(name, "").split()):
        return True
    if attrs.get("role", "").lower() in _ROLES or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
        return True
    return bool(re.search(r"display\s*:\s*none", attrs.get("style", ""), re.I))


def _name(tag: str, attrs: dict[str, str]) -> str:
    """The tag with its class, id and role, digits apart: what makes its token."""
    keys = [f"{n}={attrs[n]}" for n in ("class", "id", "role") if n in attrs]
    return re.sub(r"\d+", "0", f"{tag}[{' '.join(keys)}]") if keys else tag


class Block(NamedTuple):
    """A text block: the hash of its path, its innermost container (0 is the body), its element, and its text."""

    path: int
    container: int
    tag: str
    unwanted: bool
    article: bool
    text: str


class _Open(NamedTuple):
    tag: str
    path: int
    unwanted: bool
    article: bool
    container: int


def blocks(page: str) -> tuple[list[Block], list[tuple[int, int]], list[int]]:
    """The text blocks of a page in order; all tags as hashes of their paths with those of their parents; and the container around each container. Takes time in proportion to the page."""
    found: list[Block] = []
    tags: list[tuple[int, int]] = []
    around = [0]
    stack = [_Open("", 0, False, False, 0)]
    places: dict[str, list[int]] = {}  # where each tag stands in the stack
    scopes, blocky = [0], 0  # places of scopes; how many open elements are not inline
    held: list[str] = []
    absent: set[str] = set()

    def flush() -> None:
        if held:
            text = " ".join(html_lib.unescape("".join(held)).split())
            held.clear()
            if text:
                o = stack[-1]
                found.append(Block(o.path, o.container, o.tag, o.unwanted, o.article, text))

    def close(k: int) -> None:
        if any(stack[j].tag not in _INLINE for j in range(k, len(stack))):
            flush()
        while len(stack) > k:
            places[stack.pop().tag].pop()
        while scopes[-1] >= k:
            scopes.pop()

    def last(tag: str) -> int:
        return places[tag][-1] if places.get(tag) else -1

    at, size = 0, len(page)
    while at < size:
        m = page.find("<", at)
        if m < 0:
            held.append(page[at:])
            break
        if m > at:
            held.append(page[at:m])
        if page.startswith("<!--", m):
            end = page.find("-->", m + 2)
            at = size if end < 0 else end + 3
            continue
        if page.startswith("<![CDATA[", m):
            end = page.find("]]>", m)
            held.append(html_lib.escape(page[m + 9 : size if end < 0 else end]))
            at = size if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), m):
            end = page.find(">", m)
            at = size if end < 0 else end + 1
            continue
        t = _TAG.match(page, m)
        if t is None:
            held.append("<")
            at = m + 1
            continue
        tag = t[1].lower()
        attrs, at = _attributes(page, t.end())
        if page[m + 1] == "/":
            k = last(tag)
            if k > 0 and not (tag in _INLINE and k < scopes[-1]):
                close(k)
            continue
        if tag in _CLOSES or tag in _ENDS_P:
            k = min((x for x in map(last, _CLOSES.get(tag, {"p"})) if x > scopes[-1] or x == scopes[-1] > 0 and stack[x].tag in _CLOSES.get(tag, ())), default=-1)
            if k > 0:
                close(k)
        inline = tag in _INLINE
        if not inline:
            flush()
        elif tag == "br":
            held.append(" ")
        above = stack[-1]
        path = above.path if inline and len(stack) > 1 else xxhash.xxh3_64_intdigest(_name(tag, attrs), above.path)
        if not inline:
            tags.append((path, above.path))
        if tag in _VOID or tag in ("svg", "math") and page.endswith("/>", t.end(), at):
            continue
        if tag in _RAW or tag in _SKIPPED and tag not in absent:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            if end:
                at = end.end()
                continue
            if tag in _RAW:
                break
            absent.add(tag)
        if tag in _SKIPPED:
            continue
        container = above.container
        if not inline and tag not in ("p", "html", "body"):
            around.append(container)
            container = len(around) - 1
        stack.append(_Open(tag, path, above.unwanted or _unwanted(tag, attrs), above.article or tag in ("article", "main"), container))
        places.setdefault(tag, []).append(len(stack) - 1)
        if tag in _SCOPE:
            scopes.append(len(stack) - 1)
    flush()
    return found, tags, around


def _text_token(b: Block) -> int:
    return xxhash.xxh3_64_intdigest(b.text, b.path)


def _host(url: str | None) -> str:
    m = re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per host and token: pages, and the sum of a hash of page and count, over the pages of a batch."""
    for batch in batches:
        sums: dict[tuple[str, int], list[int]] = {}
        parents: dict[int, int] = {}
        inner: set[int] = set()
        for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
            if not page:
                continue
            host = _host(url)
            page_id = xxhash.xxh3_64_intdigest(page + "\0" + (url or ""))
            found, tags, _ = blocks(page)
            counts = Counter(t for t, _ in tags)
            parents.update(tags)
            for b in found:
                key = _text_token(b)
                counts[key] += 1
                parents[key] = b.path
                if b.article:
                    inner.add(key)
            counts[0] = 1  # stands on every page: the host's pages
            for key, n in counts.items():
                s = sums.setdefault((host, key), [0, 0])
                s[0] += 1
                s[1] = (s[1] + xxhash.xxh3_64_intdigest(n.to_bytes(8, "little"), page_id & 0xFFFFFFFFFFFFFFFF)) & 0xFFFFFFFFFFFFFFFF
        if sums:
            keys = np.array([k for _, k in sums], np.uint64).view(np.int64)
            vector = np.array([v for _, v in sums.values()], np.uint64).view(np.int64)
            parent = np.array([parents.get(k, 0) for _, k in sums], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in sums], pa.string()), pa.array(keys), pa.array(parent), pa.array([v for v, _ in sums.values()], pa.int64()), pa.array(vector), pa.array([k in inner for _, k in sums])], ["host", "token", "parent", "n", "vector", "inner"])


def templates(pages: DataFrame, support: float = SUPPORT) -> DataFrame:
    """Rows (host, tokens): the tokens of each host's valid classes. Their number is at most 1 / support times the tokens of an average page. pages: url, html."""
    fed = pages.select("url", "html").mapInArrow(_tokens, "host string, token bigint, parent bigint, n bigint, vector bigint, inner boolean")
    # sums of vectors wrap around: they are taken in halves
    low, high = F.col("vector").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(F.col("vector"), 32)
    per = fed.groupBy("host", "token").agg(F.sum("n").alias("n"), F.sum(low).alias("low"), F.sum(high).alias("high"), F.min("parent").alias("parent"), F.max("inner").alias("inner"))
    per = staged(per)
    total = per.where("token = 0").select(F.col("host").alias("th"), F.col("n").alias("pages"))
    held = per.where("token <> 0").join(total, F.col("th") == F.col("host")).where(F.when(F.col("inner"), (F.col("n") >= INNER_FEWEST) & (F.col("n") >= F.col("pages") * INNER_SUPPORT)).otherwise((F.col("n") >= FEWEST) & (F.col("n") >= F.col("pages") * support)))
    classes = held.groupBy("host", "n", "low", "high").agg(F.collect_set("token").alias("tokens"), F.collect_set("parent").alias("parents"))
    # nesting: a class of one token hangs on a parent of another class; a larger one has its tokens inside each other but for its root
    valid = classes.where((F.size("tokens") == 1) | (F.size(F.array_except("parents", "tokens")) < F.size("tokens")))
    return staged(valid.groupBy("host").agg(F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("tokens")).withColumnRenamed("host", "thost"))


def _weights(some: list[Block], around: list[int], weight: Callable[[Block], int]) -> list[int]:
    """For each container the weight of what it holds at any depth."""
    out = [0] * len(around)
    for b in some:
        out[b.container] += weight(b)
    for k in range(len(around) - 1, 0, -1):
        out[around[k]] += out[k]
    return out


def _inside(top: int, around: list[int]) -> list[bool]:
    out = [k == top for k in range(len(around))]
    for k in range(top + 1, len(around)):
        out[k] = out[around[k]]
    return out


def _around(slots: list[Block], around: list[int]) -> list[Block]:
    """Without a template to tell them: the slots of the outermost container inside the body that holds nearly all text, and headings and
    paragraphs beside it. Where no container holds that much, all slots."""
    held = _weights(slots, around, lambda b: len(b.text))
    near = [k for k in range(1, len(held)) if 10 * held[k] >= 9 * held[0]]
    if not near:
        return slots
    own = _inside(near[0], around)
    beside = lambda b: (b.container == 0 or around[b.container] == 0 and b.tag != "div") and re.fullmatch("h[1-6]|p", b.tag)
    return [b for b in slots if own[b.container] or beside(b)]


def main_text(page: str, template: set[int]) -> str:
    found, _, around = blocks(page)
    fixed = [_text_token(b) in template for b in found]
    wanted = [b for b in found if not b.unwanted]
    slots = [b for b, f in zip(found, fixed) if not f and not b.unwanted]
    if not slots:
        slots, fixed = wanted, [False] * len(found)
    if any(b.article for b in wanted):
        return "\n\n".join(b.text for b in [b for b in slots if b.article] or [b for b in wanted if b.article])
    kept = slots if template else _around(slots, around)
    if not kept:
        return ""
    # the lowest container of all slots
    held = _weights(kept, around, lambda b: 1)
    common = _inside(max(k for k, n in enumerate(held) if n == len(kept)), around)
    own, paths = {id(b) for b in kept}, {b.path for b in kept}
    # a fixed text among slots of the same path is a paragraph of the text
    return "\n\n".join(b.text for b, f in zip(found, fixed) if id(b) in own or (f and not b.unwanted and b.path in paths and common[b.container]))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [main_text(p, {t & 0xFFFFFFFFFFFFFFFF for t in ts or ()}) if p else "" for p, ts in zip(batch.column("html").to_pylist(), batch.column("tokens").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extracted(pages: DataFrame, support: float = SUPPORT) -> DataFrame:
    """Rows (page_id, url, text, n_chars), one per page. pages: page_id, url, html."""
    few = pages.select("page_id", "url", "html")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    joined = few.withColumn("host", host).join(templates(few, support), F.col("thost") == F.col("host"), "left")
    kind = few.schema["page_id"].dataType.simpleString()
    return joined.select("page_id", "url", "html", "tokens").mapInArrow(_extract, f"page_id {kind}, url string, text string, n_chars bigint")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(read_table(spark, sf_dir, "pages"))

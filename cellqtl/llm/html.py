"""Main text of web pages by a host suffix array.

A page becomes blocks, parsed once. What lies inside ``article`` or ``main`` is text; elements that by name, role or a whole class or id
name are menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles or reader comments are not. The token
streams of what is left over, of the elements left out, and of those inside an article that have such a word as a part of a name only
(``ad-hoc``, ``related-work``), are concatenated by host, and the suffixes of the streams are named by their first ``LENGTH`` tokens: suffixes
of one name are one interval of the suffix array, found by an aggregate over names and so without bringing a host together.
Intervals with two distinct pages are repeated substrings; longer ones are unions of overlapping intervals. Blocks outside
any article keep their unique runs; a doubtful block inside one is left out when repeated substrings cover more than half of it.

Repetition alone cannot tell boilerplate from passages that articles share, so other tokens inside an article are never
removed, and pages whose blocks are all decided by their markup do not wait for the suffix array.

Defined cases: null or empty html gives an empty text; unclosed and stray tags end with their parent, a tag or comment cut off
at the end of the page is dropped; pages with equal page_id are pages of their own, but count as one page for repetition;
pages with a null page_id each count; a null url is a host; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import save, slices, table

#: Tokens of the shortest repeated substring, and the share of a block's characters in links from which it is a menu.
LENGTH, LINKS = 8, 0.5

#: Elements that hold no main text, that start a block, and that have no content.
DROPPED = set("head script style noscript template svg math iframe object canvas nav aside footer form button select textarea input dialog menu audio video".split())
BLOCKS = set(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption header footer aside nav form fieldset address hr br details summary center title".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup; of the second kind a start tag without an end tag after it has no content.
RAW, RAW_IF_CLOSED = ("script", "style", "textarea", "title"), ("noscript", "iframe")
#: Elements in which a slash at the end of a tag closes it.
FOREIGN = ("svg", "math")
CLOSED_BY_NEXT = {"p": BLOCKS - {"br"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
#: Words of class and id names, and roles, of elements that hold no main text.
NAMES = set(
    "ad ads advert adverts advertisement advertising banner sidebar menu nav navbar navigation breadcrumb breadcrumbs cookie cookies consent gdpr notice notices popup modal newsletter subscribe subscription share sharing social comment comments disqus replies footer masthead promo promoted sponsor sponsored related widget pagination pager login signup search toolbar skip copyright colophon".split()
)
#: Words that tell reader comments as a part of a name, and those beside them that tell something else (``comments-open``).
COMMENTS, NOT_COMMENTS = set("comment comments commentlist replies disqus".split()), set("open closed on off no has with without enabled disabled allowed".split())
#: Further words of names that make a block inside an article doubtful.
DOUBTFUL = set("teaser teasers recommended recommendations trending".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

# Attributes as browsers take them: a quote opens a value after = only; nothing is tried twice.
_ATTRS = r"(?>[\s/]+|=?[^\s/>=]+(?>\s*=\s*(?>\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*)?)?)*+"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])" + _ATTRS + r">.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<attrs>" + _ATTRS + r")>|<[!?][^>]*>|<(?:/?[a-z][^>]*)?\Z",
    re.I | re.S,
)
_ATTR = re.compile(r"(=?[^\s/>=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*)?)?")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPLIT = re.compile(r"[^a-z]+")
_ENDS = {n: re.compile(f"</{n}(?=[\\s/>])[^>]*>", re.I) for n in RAW_IF_CLOSED}


def _left_out(name: str, attrs: str, inside: bool) -> str:
    """out: left out by its markup; doubt: a class or id name has a telling word as one of its parts; else empty."""
    if name in DROPPED:
        return "out"
    if name == "header":
        return "" if inside else "out"
    if not attrs or name in ("html", "body", "article", "main"):
        return ""
    a = {}
    for k, v in _ATTR.findall(attrs):
        a.setdefault(k.lower(), v[1:-1] if v[:1] in ("'", '"') else v)  # of a repeated attribute the first counts
    as_written = {*a.get("class", "").split(), *a.get("id", "").split()}
    a = {k: v.lower() for k, v in a.items()}
    if "hidden" in a or a.get("aria-hidden") == "true" or a.get("role") in ROLES or "display:none" in a.get("style", "").replace(" ", ""):
        return "out"
    names = {*a.get("class", "").split(), *a.get("id", "").split()}
    if NAMES & names:
        return "out"
    for n in as_written:
        parts = set(_SPLIT.split(_HUMP.sub(" ", n).lower())) | set(_SPLIT.split(n.lower()))
        if parts & COMMENTS and not parts & NOT_COMMENTS:
            return "out"
    return "doubt" if any((NAMES | DOUBTFUL).intersection(_SPLIT.split(n)) for n in names) else ""


def blocks(html: str | None) -> list[tuple[str, str, int]]:
    """(kind, text, characters in links) of each block in page order; kind: main, other, out (left out by its markup), or doubt
    (inside an article, but perhaps boilerplate)."""
    found: list[tuple[str, str, int]] = []
    buffer: list[str] = []
    stack: list[tuple[str, str]] = []  # name, kind of its content
    kind, linked = "other", 0
    opened: Counter[str] = Counter()  # elements of the stack by name
    endless: set[str] = set()

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            if text:
                found.append((kind, text, linked))
            buffer.clear()
        linked = 0

    def close(k: int) -> None:
        nonlocal kind
        while len(stack) > k:
            opened[stack.pop()[0]] -= 1
        kind = stack[-1][1] if stack else "other"

    at, source = 0, html or ""
    for m in _TOKEN.finditer(source):
        if m.start() < at:
            continue  # inside of what has no markup
        if m.start() > at:
            data = source[at : m.start()]
            buffer.append(data)
            linked += len(data) * (opened["a"] > 0)
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        block = name in BLOCKS or name in DROPPED
        if m["end"]:
            if opened[name]:
                if block:
                    flush()
                k = len(stack) - 1
                while stack[k][0] != name:  # what is passed here is closed
                    k -= 1
                close(k)
            elif block:
                flush()
            continue
        if block:
            flush()
            while stack and name in CLOSED_BY_NEXT.get(stack[-1][0], ()):
                close(len(stack) - 1)
        foreign = name in FOREIGN or any(opened[f] for f in FOREIGN)
        if name in VOID or foreign and m["attrs"].endswith("/"):  # a slash at the end of any other tag means nothing
            continue
        if name in RAW_IF_CLOSED:
            end = None if name in endless else _ENDS[name].search(source, at)
            if end:
                at = end.end()
            else:
                endless.add(name)  # nor does a later one end
            continue
        inside = kind
        if kind != "out":
            how = _left_out(name, m["attrs"], kind in ("main", "doubt"))
            if how == "out" or how == "doubt" and kind == "main":
                inside = how
                flush()
            elif name in ("article", "main") or (m["attrs"] and re.search(r"role\s*=\s*[\"']?main\b", m["attrs"], re.I)):
                inside = "main"
        stack.append((name, inside))
        opened[name] += 1
        kind = inside
    if at < len(source):
        buffer.append(source[at:])
    flush()
    return found


def decided(found: list[tuple[str, str, int]]) -> bool:
    """Whether markup alone tells a page's text: it has an article without doubtful blocks, or nothing is left over."""
    kinds = {k for k, _, _ in found}
    return "doubt" not in kinds and ("main" in kinds or "other" not in kinds)


def stream(found: list[tuple[str, str, int]]) -> list[str]:
    """Tokens of a page that take part in the suffix array: those outside of articles."""
    return [w for kind, text, _ in found if kind != "main" for w in text.split()]


def prefixes(host: str, tokens: list[str]) -> np.ndarray:
    """64-bit hash of host and LENGTH tokens from each place on."""
    n = len(tokens) - LENGTH + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.fromiter((xxhash.xxh3_64_intdigest(t) for t in tokens), np.uint64, len(tokens))
    acc = np.full(n, xxhash.xxh3_64_intdigest(host), np.uint64)
    for k in range(LENGTH):
        acc = (acc ^ (acc >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    acc = (acc ^ (acc >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (acc ^ (acc >> np.uint64(31))).view(np.int64)


def unique_text(host: str, found: list[tuple[str, str, int]], repeated: set[int]) -> str:
    """What stays of a page that markup alone does not decide. With an article: its blocks, without the doubtful ones that
    repeated substrings cover by more than half. Without: of each left-over block that is no menu the tokens that no repeated
    substring covers."""
    tokens = stream(found)
    covered = np.zeros(len(tokens), bool)
    for i, h in enumerate(prefixes(host, tokens).tolist()):
        if h in repeated:
            covered[i : i + LENGTH] = True
    article = any(kind in ("main", "doubt") for kind, _, _ in found)
    out, at = [], 0
    for kind, text, linked in found:
        if kind == "main":
            out.append(text)
            continue
        n = len(text.split())
        gone = covered[at : at + n]
        at += n
        if kind == "doubt" and 2 * gone.sum() <= n:
            out.append(text)
        elif kind == "other" and not article and linked < LINKS * len(text):
            out += [w for w, c in zip(text.split(), gone, strict=True) if not c]
    return " ".join(out)


def host_of(url: str | None) -> str:
    return re.sub(r"^[a-z][a-z0-9+.-]*://", "", (url or "").lower()).split("/")[0].split("?")[0].split("#")[0].rpartition("@")[2].removeprefix("www.")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every page."""
    kind = pages.schema["page_id"].dataType.simpleString()
    block = "array<struct<kind:string,text:string,linked:int>>"
    pieces = pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string()), ("linked", pa.int32())]))

    def parse(batches):
        for b in slices(batches):
            texts, left, names = [], [], []
            for url, html in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                found = blocks(html)
                sure = decided(found)
                texts.append(" ".join(t for k, t, _ in found if k == "main") if sure else None)
                left.append(None if sure else [{"kind": k, "text": t, "linked": n} for k, t, n in found])
                names.append(np.unique(prefixes(host_of(url), stream(found))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(left, pieces), pa.array(names, pa.list_(pa.int64()))], ["page_id", "url", "text", "blocks", "prefixes"])

    def by_suffixes(batches):
        for b in slices(batches):
            texts = [
                unique_text(host_of(url), [(x["kind"], x["text"], x["linked"]) for x in found], set(repeated or ()))
                for url, found, repeated in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    schema = f"page_id {kind}, url string, text string, blocks {block}, prefixes array<long>"
    row = F.monotonically_increasing_id()
    parsed = save(pages.select("page_id", "url", "html").mapInArrow(parse, schema).withColumn("row", row), "parsed")
    page = F.when(F.col("page_id").isNull(), F.struct(F.lit(1).alias("k"), F.col("row").alias("v"))).otherwise(F.struct(F.lit(0).alias("k"), F.xxhash64("page_id").alias("v")))
    rows = parsed.select(page.alias("page"), F.explode("prefixes").alias("prefix"))
    # an interval of the suffix array at depth LENGTH: the least and the greatest page tell whether it has two
    repeated = rows.groupBy("prefix").agg(F.min("page").alias("lo"), F.max("page").alias("hi")).where("lo <> hi").select("prefix")
    open_ = parsed.where("text is null")
    mine = open_.select("row", F.explode("prefixes").alias("prefix")).join(repeated, "prefix", "left_semi").groupBy("row").agg(F.collect_list("prefix").alias("repeated"))
    rest = open_.join(mine, "row", "left").select("page_id", "url", "blocks", "repeated").mapInArrow(by_suffixes, f"page_id {kind}, url string, text string")
    return parsed.where("text is not null").select("page_id", "url", "text").union(rest)


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))

"""Main text of web pages: templates deduced from token classes across pages of one host, and what fills their slots.

A page is read as tokens: tags with the path of elements they stand in, and blocks of text with theirs. Over all pages of
a host, each token has an occurrence vector (how often each page holds it), kept as a hash that is combined before it
is shuffled. Tokens with equal vectors form an equivalence class. Classes of two tokens or more that nearly all distinct
pages of the host hold, once each, are valid; together they are the host's template, whose elements nest as pages nest
them. What a page has between template tokens are its slots: blocks of text that are no template token.

The main text fills the slots within the smallest template element that holds all telling slots of a page: headings,
paragraphs and blocks of some words. What else a page has outside it (a date, a count, a line of an advert) goes. A marked
article or main element that holds all telling slots is taken as it is; where a host has too few pages for a template, marks
decide alone, and where there is neither, all slots count. Elements that by tag or name are menus, headers, footers,
sidebars, notices, adverts, forms or comments give no text. A name is judged whole and never that of a body, main or
article; names around all of a page's articles don't count where they would drop most of its text.

Templates are broadcast only if they are few (BROADCAST_TOKENS over all hosts); else pages meet them in a join on the
host, which adaptive execution splits where a host is hot.

Defined results: null or empty html gives the empty text; a null url is a host of its own; pages that repeat count once
in a template and each give their text; a tag whose quotes never close ends at its first ">", as all tags after it do;
a "<" that no ">" follows is text; a comment or element never closed reaches to the end; the time to read a page grows with its
length alone; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import Table, columns

#: Distinct pages of a host from which a template is deduced, and the share of them that holds a valid class.
LEAST_PAGES, LEAST_SHARE = 8, 0.8
BROADCAST_TOKENS = 200_000

OPENS = re.compile(r"<(?:(!--)|[!?]|(/?)([a-zA-Z][^\s/><]*))")
QUIET = re.compile(r"[^\"'>]*")
NAMED = re.compile(r"""\b(class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
WHITE = re.compile(r"[\x20\x09-\x0D]+")

# Elements by what they do to text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose content is no text.
RAW = frozenset("script style noscript template svg iframe textarea select object canvas".split())
HOLDERS = frozenset("article aside blockquote body center dd details dialog div dl fieldset figure footer form head header hgroup main menu nav ol section table td title ul".split())
NOISE = frozenset("aside dialog fieldset footer form head menu nav title".split())
NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus "
    "footer header masthead menu modal nav navbar navigation newsletter notice overlay pagination pager popup promo promotion related replies "
    "respond share sharing sidebar signup social sponsor sponsored subscribe subscription tags toolbar topbar widget".split()
)
#: Elements whose text tells main text from what stands beside it, and words of a block that tell it wherever it stands.
TELLING = frozenset("blockquote h1 h2 h3 h4 h5 h6 p pre".split())
TELLING_WORDS = 10
#: Words that leave a compound name what its other words make it: "site-footer" and "sidebar-left" are noise, "no-sidebar" isn't.
PLACES = frozenset("bar block bottom box global left link links list main page primary right secondary section site slot top".split())
ARTICLE_NAMES = frozenset("articlebody main".split())


def _is_name_noise(names: list[str], in_article: bool) -> bool:
    """Whether a name as a whole means noise: all its words do, but for those of place."""
    for name in names:
        words = [w for w in re.split(r"[^a-z0-9]+", name) if w and not w.isdigit()]
        telling = [w for w in words if w in NOISE_NAMES and not (in_article and w == "header")]
        if telling and all(w in NOISE_NAMES or w in PLACES for w in words):
            return True
    return False


def pieces(source: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, closes, attributes) of each piece of markup; the name of what isn't a tag is empty."""
    at, quoted, last = 0, True, source.rfind(">")
    while m := OPENS.search(source, at):
        start, end = m.start(), m.end()
        if m[1]:
            close = source.find("-->", end)
            at = close + 3 if close >= 0 else len(source)
            yield start, at, "", False, ""
            continue
        if start > last:
            return
        if not m[3]:
            at = source.find(">", end) + 1
            yield start, at, "", False, ""
            continue
        k = end
        while quoted:
            k = QUIET.match(source, k).end()
            if k == len(source):
                quoted = False
            elif source[k] == ">":
                break
            else:
                k = source.find(source[k], k + 1) + 1
                quoted = k > 0
        if not quoted:
            k = source.find(">", end)
            if k < 0:
                return
        name, at = m[3].lower(), k + 1
        if name in RAW and not m[2] and source[k - 1] != "/":
            close = re.compile(rf"</{name}\s*>", re.I).search(source, at)
            at = close.end() if close else len(source)
            yield start, at, "", False, ""
        else:
            yield start, at, name, bool(m[2]), source[end:k]


class Holder(NamedTuple):
    name: str
    path: int
    parent: int
    by_tag: bool
    by_name: bool  # noise by a name word
    inside: bool


class Page(NamedTuple):
    holders: list[Holder]
    #: ("tag" or "text", holder, tag or block of text), in page order.
    items: list[tuple[str, int, str]]
    noise: list[bool]
    #: Whether a holder is in a marked article.
    inside: list[bool]


def _settled(holders: list[Holder], items: list[tuple[str, int, str]]) -> tuple[list[bool], list[bool]]:
    """Of each holder whether it is noise and whether it counts as within a marked article.

    Where names alone would drop all articles and more text than stays, names of elements around articles don't count.
    """

    def noise_but(spared: set[int]) -> list[bool]:
        noise = [False]
        for k, h in enumerate(holders[1:], 1):
            noise.append(h.name != "body" and (noise[h.parent] or h.by_tag or h.by_name and k not in spared))
        return noise

    noise, inside = noise_but(set()), [h.inside for h in holders]
    marks = [k for k, h in enumerate(holders) if h.inside and not holders[h.parent].inside]
    if marks and all(noise[k] for k in marks):
        spared: set[int] = set()
        for k in marks:
            while (k := holders[k].parent) > 0 and k not in spared:
                spared.add(k)
        less = noise_but(spared)
        won = sum(len(what) for kind, k, what in items if kind == "text" and noise[k] and not less[k] and inside[k])
        if won > sum(len(what) for kind, k, what in items if kind == "text" and not noise[k]):
            return less, [False] * len(holders)
    return noise, inside


def read_page(source: str) -> Page:
    holders, stack = [Holder("", 0, 0, False, False, False)], [0]
    open_: Counter = Counter()
    items: list[tuple[str, int, str]] = []
    held: list[str] = []

    def block() -> None:
        text = WHITE.sub(" ", html.unescape("".join(held))).strip(" ")
        held.clear()
        if text:
            items.append(("text", stack[-1], text))

    at = 0
    for start, end, name, closes, given in pieces(source):
        held.append(source[at:start])
        at = end
        if not name:
            continue
        if name == "br":
            held.append(" ")
            continue
        if name in BLOCKS:
            block()
            if name in HOLDERS:
                if closes:
                    while open_[name]:
                        last = holders[stack.pop()].name
                        open_[last] -= 1
                        if last == name:
                            break
                elif not given.endswith("/"):
                    up = holders[stack[-1]]
                    said = [(x[0].lower(), "".join(x[1:]).lower()) for x in NAMED.findall(given)] if given else []
                    words = re.split(r"[^a-z0-9]+", " ".join(value for _, value in said))
                    names = [x for kind, value in said for x in ([value] if kind == "aria-label" else value.split())]
                    marked = name in ("article", "main")
                    inner = up.inside or marked or any(w in ARTICLE_NAMES for w in words)
                    path = _hash(str(up.path), name, *(w for w in words if w and not w.isdigit()))
                    by_tag = name in NOISE or name == "header" and not up.inside
                    holders.append(Holder(name, path, stack[-1], by_tag, not marked and _is_name_noise(names, up.inside), inner))
                    stack.append(len(holders) - 1)
                    open_[name] += 1
            items.append(("tag", stack[-1], ("/" if closes else "") + name))
    held.append(source[at:])
    block()
    return Page(holders, items, *_settled(holders, items))


def _hash(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\x00".join(parts).encode("utf-8", "surrogatepass"))


def token_of(kind: str, path: int, what: str) -> int:
    return _hash(kind, str(path), what)


def occurrences(source: str) -> dict[int, int]:
    """token: how often the page holds it."""
    page = read_page(source)
    return Counter(token_of(kind, page.holders[k].path, what) for kind, k, what in page.items)


def _host() -> Column:
    return F.coalesce(F.lower(F.regexp_extract(F.col("url").cast("string"), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?([^/?#]*)", 1)), F.lit(""))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _once(pages: DataFrame, most: int) -> DataFrame:
    """host, html: each page of a host once. Only pages that repeat are shuffled, if their hashes are few enough to be
    broadcast; else all meet them."""
    keyed = pages.select("host", "html", F.xxhash64("html").alias("h"))
    again = Table(keyed.groupBy("host", "h").count().filter("count > 1").select("host", "h"), "again").df
    side = F.broadcast(again) if again.count() <= most else again.hint("merge")
    alone = keyed.join(side, ["host", "h"], "left_anti")
    return alone.unionByName(keyed.join(side, ["host", "h"], "left_semi").dropDuplicates(["host", "h"])).select("host", "html")


def deduce_templates(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """host, token: the template tokens of each host, tags and blocks of text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[str, int], list] = {}
            for host, source in zip(*(c.to_pylist() for c in columns(batch, "host", "html"))):
                page = str(_hash(source))
                for t, n in occurrences(source).items():
                    entry = found.setdefault((host, t), [0, 0, 0])
                    entry[0] ^= _hash(page, str(n))
                    entry[1] += 1
                    entry[2] += n == 1
            rows = [(h, _signed(t), _signed(v), n, once) for (h, t), (v, n, once) in found.items()]
            kinds = (pa.string(), *[pa.int64()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], ["host", "token", "vector", "pages", "once"])

    distinct = _once(pages, BROADCAST_TOKENS)
    total = distinct.groupBy("host").agg(F.count(F.lit(1)).alias("total")).filter(F.col("total") >= least_pages)
    rows = distinct.mapInArrow(work, "host string, token long, vector long, pages long, once long")
    tokens = rows.groupBy("host", "token").agg(F.bit_xor("vector").alias("vector"), F.sum("pages").alias("pages"), F.sum("once").alias("once"))
    common = tokens.filter("once = pages").join(total, "host").filter(F.col("pages") >= least_share * F.col("total"))
    common = Table(common, "tokens").df  # one row for each token that nearly every page of a host has
    valid = common.groupBy("host", "vector").count().filter("count > 1")
    return common.join(valid, ["host", "vector"], "left_semi").select("host", "token")


def main_text(source: str | None, template: frozenset[int] | set[int]) -> str:
    """The blocks that fill the template's slots, one to a line."""
    page = read_page(source or "")
    holders, built = page.holders, [False] * len(page.holders)
    slots: list[tuple[int, str]] = []
    telling, size = [0] * len(holders), [0] * len(holders)
    within = ""  # the element that a block of text opens
    for kind, k, what in page.items:
        is_template = token_of(kind, holders[k].path, what) in template if template else False
        if kind == "tag":
            built[k] |= is_template and not what.startswith("/") and what == holders[k].name
            within = "" if what.startswith("/") else what
        elif not page.noise[k] and not is_template:
            slots.append((k, what))
            size[k] += len(what)
            telling[k] += within in TELLING or what.count(" ") + 1 >= TELLING_WORDS
    if not any(telling):
        telling = size
    whole = sum(telling)
    marked = sum(n for n, inside in zip(telling, page.inside) if inside)
    if marked and (marked == whole or not template):
        return "\n".join(what for k, what in slots if page.inside[k])
    for k in range(len(holders) - 1, 0, -1):
        telling[holders[k].parent] += telling[k]
    # holders stand in page order and those that hold all are nested, so the last one is innermost
    holds = next((k for k in range(len(holders) - 1, 0, -1) if built[k] and telling[k] == whole), 0)
    held = [k == holds for k in range(len(holders))]
    for k in range(1, len(holders)):
        held[k] |= held[holders[k].parent]
    return "\n".join(what for k, what in slots if held[k])


def extract(pages: DataFrame, *, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE, broadcast_tokens: int = BROADCAST_TOKENS) -> DataFrame:
    """page_id, url, text, n_chars."""
    read = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn("host", _host())
    templates = Table(deduce_templates(read, least_pages, least_share), "templates").df
    if templates.count() <= broadcast_tokens:
        own: dict[str, set[int]] = {}
        for host, token in templates.select("host", "token").collect():
            own.setdefault(host, set()).add(token & 0xFFFFFFFFFFFFFFFF)
        shared = read.sparkSession.sparkContext.broadcast(own)
        met = read.withColumn("tokens", F.lit(None).cast("array<long>"))
    else:
        shared = None
        met = read.join(templates.groupBy("host").agg(F.collect_list("token").alias("tokens")), "host", "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, urls, sources, hosts, tokens = columns(batch, "page_id", "url", "html", "host", "tokens")
            texts = []
            for i, (source, host) in enumerate(zip(sources.to_pylist(), hosts.to_pylist())):
                template = shared.value.get(host, frozenset()) if shared is not None else {t & 0xFFFFFFFFFFFFFFFF for t in tokens[i].as_py() or ()}
                texts.append(main_text(source, template))
            yield pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return met.select("page_id", "url", "html", "host", "tokens").mapInArrow(work, f"page_id {kind}, url string, text string, n_chars long")

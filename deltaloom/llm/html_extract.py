"""Main text of web pages by a consensus of each host's pages.

Every page is parsed once for a vote: the text of its containers, without boilerplate, picks the smallest
container that holds nearly all of it (a block that is mostly links weighs nothing, whatever its class), named by its generalised path (a
hash of the tags with their class words, digits dropped, from the root down to any depth). Votes are counted per host and path in
Spark, and each page is then parsed again and cut at the container that most pages of its host chose, among those it has, or at
its own choice. All paths are winners that REPEATED_SHARE of the host's pages chose, so at most 1 / REPEATED_SHARE of them.

A page is cut at a container only if every block of text outside it is known to be boilerplate: it stands outside the
choice of at least REPEATED pages of the host with unlike text inside, and of REPEATED_SHARE of all its pages. Otherwise
the next path of the host is tried, then the page's own choice and its ancestors up to the whole page.

Dropped wherever they stand: scripts, styles, forms and other elements without reading text; menus, page headers, footers,
asides; elements whose class or id words name an advert, notice, sidebar, menu or comment; hidden elements; comments of
the markup. An element named so stays if most of the page's text in article and main elements stands in such elements
inside it, and, unless all its words are such names, also if the elements of its path hold most of the page's text or the
path that most pages of the host chose leads into it. An article or main element goes for a whole class or id only, as
such an element or if all its words are such names ('comments-open' keeps it). Character references are decoded, white space inside a block becomes one space, blocks join by a line end.

Null and empty html, and pages of boilerplate alone, give an empty text. A null or odd url belongs to the host ''. Each row
of ``pages`` gives one row; equal rows give equal ones. Unclosed and truncated markup is read as far as it goes. Votes are
counted before the shuffle, so a host with a third of all pages is no hot key. The table of winners is broadcast up to
BROADCAST_HOSTS hosts and BROADCAST_BLOCKS paths and repeated blocks of 8 bytes; beyond that it is joined by host, in partitions
that can be split. An empty table gives an empty one. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import html
import re
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.llm.arrow import map_rows
from deltaloom.llm.shared import Scratch, cut

SHARE = 0.85
BROADCAST_HOSTS = 50_000
BROADCAST_BLOCKS = 1_000_000
REPEATED = 3
REPEATED_SHARE = 0.01

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(?=/?[a-zA-Z])[^>]*\Z""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))|([^\s=/>"']+)""")
_WORDS = re.compile(r"[a-z]+")
_RAW = {k: re.compile(rf"</{k}\b[^>]*(?:>|\Z)", re.I) for k in ("script", "style", "title", "textarea", "xmp", "noembed", "noframes")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CONTAINER = frozenset("html body div section article main td center".split())
_BLOCK = _CONTAINER | frozenset(
    "p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr th caption blockquote pre figure figcaption address hr br "
    "header footer nav aside form fieldset details summary hgroup".split()
)
_DROP = frozenset(
    "head script style title noscript template iframe object svg math canvas audio video nav footer aside form button select option "
    "textarea input label menu dialog xmp noembed noframes".split()
)
_DROP_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adslot sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice notices alert popup modal overlay newsletter subscribe signup paywall sidebar menu menus nav navbar navigation "
    "breadcrumb breadcrumbs toolbar footer masthead comment comments commentlist respond disqus replies share sharing social related "
    "recommended pagination pager skip login widget widgets".split()
)
_PAGE_HEADER_WORDS = frozenset(["header", "topbar"])
_DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_KEEP_TAGS = frozenset("html body main article".split())
_NO_ARTICLE_WORDS = frozenset("comment comments ad ads advert sponsored related promo".split())
#: What _boilerplate says of an element: it stays, some of its words or all of them name boilerplate, or it goes.
_STAYS, _NAMED, _WHOLLY, _GOES = range(4)
_CLOSES = {
    "p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]), "body": frozenset(["head"]),
}
_ENDS_P = _BLOCK - {"br", "td", "th", "tr", "html", "body"}


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c, bare in _ATTRIBUTE.findall(raw):
        out.setdefault((name or bare).lower(), a or b or c)
    return out


def _boilerplate(tag: str, attributes: dict[str, str], words: list[str], inside_article: bool) -> int:
    if tag in _DROP or (tag == "header" and not inside_article):
        return _GOES
    if not attributes:
        return _STAYS
    style = attributes.get("style", "").replace(" ", "").lower()
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style:
        return _GOES
    if tag in ("html", "body"):
        return _STAYS
    if attributes.get("role", "").lower() in _DROP_ROLES:
        return _GOES
    all_words = set(words) | set(_WORDS.findall(attributes.get("id", "").lower()))
    found = all_words & (_NO_ARTICLE_WORDS if tag in _KEEP_TAGS else _DROP_WORDS if inside_article else _DROP_WORDS | _PAGE_HEADER_WORDS)
    if not found:
        return _STAYS
    if found == all_words:
        return _WHOLLY
    if tag in _KEEP_TAGS and not found & {*attributes.get("class", "").lower().split(), attributes.get("id", "").lower()}:
        return _STAYS
    return _NAMED


class Page:
    """Blocks of reading text, each with the container it stands in, and the containers' parents and paths. Elements named
    as boilerplate are regions, kept or dropped once all is read; ``best`` is the path that most pages of the host chose."""

    def __init__(self, source: str, best: int | None = None):
        self.parents, self.paths = [-1], [0]
        self.blocks: list[tuple[int, str]] = []
        self._plain: list[int] = []  # characters of each block, none if most of them are in links
        # tag, container, dropped, in an article, region, the regions that the outermost article and main stand in, or -1, in a link
        self._stack: list[tuple[str, int, bool, bool, int, int, int, bool]] = [("", 0, False, False, 0, -1, -1, False)]
        self._open_tags: dict[str, int] = {}
        self._parts: list[str] = []
        self._linked = 0
        self._above, self._kinds, self._names = [-1], [_STAYS], [(0, 0)]  # of the regions
        self._regions = [0]  # of the containers
        self._marks: list[tuple[int, int, int]] = []  # of the blocks: region, and as on the stack
        at, n = 0, len(source)
        while at < n:
            m = _TOKEN.search(source, at)
            if m is None:
                self._text(source[at:])
                break
            if m.start() > at:
                self._text(source[at : m.start()])
            at = m.end()
            tag = m.group(2)
            if tag is None:
                continue
            tag = tag.lower()
            if m.group(1):
                self._close(tag)
            else:
                self._open(tag, m.group(3))
                if tag in _RAW:
                    end = _RAW[tag].search(source, at)
                    at = end.end() if end else n
                    self._close(tag)
        self._flush()
        if len(self._kinds) > 1:
            self._settle(best)

    def _text(self, text: str) -> None:
        if not self._stack[-1][2]:
            self._parts.append(text)
            if self._stack[-1][7]:
                self._linked += len(text)

    def _flush(self) -> None:
        if self._parts:
            text = " ".join(html.unescape("".join(self._parts)).split())
            self._parts.clear()
            if text:
                self.blocks.append((self._stack[-1][1], text))
                self._plain.append(0 if 2 * self._linked > len(text) else len(text))
                self._marks.append(self._stack[-1][4:7])
            self._linked = 0

    def _pop(self, to: int) -> None:
        """Close the open elements from place ``to`` of the stack on."""
        for element in self._stack[to:]:
            self._open_tags[element[0]] -= 1
        del self._stack[to:]

    def _open(self, tag: str, raw: str) -> None:
        if tag in _BLOCK:
            self._flush()
        if tag in _VOID:
            return
        closes = _CLOSES.get(tag)
        if tag in _ENDS_P:
            closes = (closes or frozenset()) | {"p"}
        if closes:
            self._imply(closes)
        attributes = _attributes(raw) if raw and not raw.isspace() else {}
        words = _WORDS.findall(attributes.get("class", "").lower())
        _, container, dropped, article, region, in_article, in_main, linked = self._stack[-1]
        kind = _STAYS if dropped else _boilerplate(tag, attributes, words, article)
        dropped = dropped or kind == _GOES
        if tag in _DROP or dropped or kind:
            self._flush()
        name = ".".join([tag, *sorted(set(words))])
        if kind in (_NAMED, _WHOLLY):
            self._above.append(region)
            self._kinds.append(kind)
            self._names.append((self._names[region][0] + 1, _step(self.paths[container], name)))
            region = len(self._kinds) - 1
        if tag in _CONTAINER and not dropped:
            self.parents.append(container)
            self._regions.append(region)
            self.paths.append(_step(self.paths[container], name))
            container = len(self.parents) - 1
        if tag in ("article", "main") and not _NO_ARTICLE_WORDS & {*words, *_WORDS.findall(attributes.get("id", "").lower())}:
            if tag == "article" and in_article < 0:
                in_article = region
            if tag == "main" and in_main < 0:
                in_main = region
        self._stack.append((tag, container, dropped, article or tag in ("article", "main"), region, in_article, in_main, linked or tag == "a"))
        self._open_tags[tag] = self._open_tags.get(tag, 0) + 1

    def _settle(self, best: int | None) -> None:
        """Drop the blocks of the regions that are boilerplate."""
        above, kinds = self._above, self._kinds
        down, up = range(1, len(kinds)), range(len(kinds) - 1, 0, -1)  # outer regions come before inner ones
        held = [0] * len(kinds)
        for (_, text), (_, in_article, in_main) in zip(self.blocks, self._marks, strict=True):
            if in_article >= 0 or in_main >= 0:
                held[max(in_article, in_main)] += len(text)  # the inner of the two
        for r in up:
            held[above[r]] += held[r]
        keep = [2 * x > held[0] for x in held]
        keep[0] = True
        open_ = keep.copy()
        for r in down:
            open_[r] = open_[above[r]] and (keep[r] or kinds[r] == _NAMED)
        size, total, by_name = [0] * len(kinds), 0, {}
        for (_, text), (region, _, _) in zip(self.blocks, self._marks, strict=True):
            if open_[region]:
                size[region] += len(text)
                total += len(text)
        chosen = [False] * len(kinds)
        for region, path in zip(self._regions, self.paths, strict=True):
            chosen[region] |= path == best
        for r in up:
            size[above[r]] += size[r]
            chosen[above[r]] |= chosen[r]
            by_name[self._names[r]] = by_name.get(self._names[r], 0) + size[r]
        for r in down:
            named = kinds[r] == _NAMED and (chosen[r] or 2 * by_name[self._names[r]] > total)
            keep[r] = keep[above[r]] and (keep[r] or named)
        stay = [keep[m[0]] for m in self._marks]
        self.blocks, self._plain = ([x for x, s in zip(xs, stay, strict=True) if s] for xs in (self.blocks, self._plain))

    def _imply(self, closes: frozenset[str]) -> None:
        """Close an open element of ``closes`` that no container or list stands in front of."""
        if not any(self._open_tags.get(tag) for tag in closes):
            return
        for i in range(len(self._stack) - 1, 0, -1):
            tag = self._stack[i][0]
            if tag in closes:
                self._pop(i)
                return
            if tag in _CONTAINER or tag in ("ul", "ol", "dl", "table", "blockquote"):
                return

    def _close(self, tag: str) -> None:
        if not self._open_tags.get(tag):
            return
        for i in range(len(self._stack) - 1, 0, -1):
            if self._stack[i][0] == tag:
                if tag in _BLOCK or self._stack[i][2] or self._stack[i][4] != self._stack[i - 1][4]:
                    self._flush()
                self._pop(i)
                return

    def totals(self) -> list[int]:
        """Characters of blocks that are not mostly links in each container, with those inside it; of all blocks if all are."""
        out = [0] * len(self.parents)
        every = not any(self._plain)
        for (container, text), plain in zip(self.blocks, self._plain, strict=True):
            out[container] += len(text) if every else plain
        for i in range(len(out) - 1, 0, -1):
            out[self.parents[i]] += out[i]
        return out

    def choice(self) -> int | None:
        """The smallest container with nearly all of the text; None without text."""
        totals = self.totals()
        if not totals[0]:
            return None
        best = 0
        for i in range(1, len(totals)):  # parents come before children
            if self.parents[i] == best and totals[i] >= SHARE * totals[0]:
                best = i
        return best

    def first_with_all(self, paths: list[int], repeated: set[int]) -> int:
        """The first of ``paths`` whose containers hold text, and all of it that is not ``repeated``; the last is the root's, and
        does. Containers are numbered as they begin, so those inside one follow it, and those of one path are apart."""
        n = len(self.parents)
        end, blocks, fresh = list(range(1, n + 1)), [0] * (n + 1), [0] * (n + 1)
        for i in range(n - 1, 0, -1):
            end[self.parents[i]] = max(end[self.parents[i]], end[i])
        for container, text in self.blocks:
            blocks[container + 1] += 1
            fresh[container + 1] += _hash(text) not in repeated
        blocks, fresh = list(accumulate(blocks)), list(accumulate(fresh))
        of: dict[int, list[int]] = {}
        for i, path in enumerate(self.paths):
            of.setdefault(path, []).append(i)
        for path in paths:
            if sum(blocks[end[i]] - blocks[i] for i in of[path]) and sum(fresh[end[i]] - fresh[i] for i in of[path]) == fresh[-1]:
                return path
        return self.paths[0]

    def split(self, path: int) -> tuple[list[str], list[str]]:
        """Blocks of the containers with ``path``, in page order, and the other blocks."""
        inside = [False] * len(self.parents)
        for i, parent in enumerate(self.parents):
            inside[i] = self.paths[i] == path or (parent >= 0 and inside[parent])
        return [t for c, t in self.blocks if inside[c]], [t for c, t in self.blocks if not inside[c]]


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def _step(path: int, name: str) -> int:
    """The path of an element named ``name`` inside one with ``path``."""
    return _hash(f"{path}/{name}")


def vote(source: str) -> tuple[int | None, int | None, list[int]]:
    """Path that a page chooses, hash of the text inside and hashes of the blocks outside; no path without text."""
    page = Page(source)
    own = page.choice()
    if own is None:
        return None, None, []
    inside, outside = page.split(page.paths[own])
    return page.paths[own], _hash("\n".join(inside)), sorted({_hash(t) for t in outside})


def extract(source: str, winners: list[int] | None, repeated: set[int]) -> str:
    page = Page(source, winners[0] if winners else None)
    at = page.choice()
    if at is None:
        return ""
    there = set(page.paths)
    paths = [p for p in winners or () if p in there]
    while at >= 0:
        paths.append(page.paths[at])
        at = page.parents[at]
    return "\n".join(page.split(page.first_with_all(paths, repeated))[0])


def _host(url: bytes | None) -> str:
    m = re.match(rb"\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or b"")
    return m.group(1).decode("utf-8", "replace").lower()[:255] if m else ""


def host_paths(pages: DataFrame, scratch: Scratch, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host``, ``winners``, its paths by number of votes, and ``repeated``, hashes of the blocks that are boilerplate by their
    number; hosts without a vote have no row."""

    def rows(got: dict[str, list]) -> dict[str, list]:
        made = [vote((h or b"").decode("utf-8", "replace")) for h in got[html_col]]
        return {"host": [_host(u) for u in got[url_col]]} | {k: [x[i] for x in made] for i, k in enumerate(("path", "inside", "outside"))}

    read = map_rows(pages, [url_col, html_col], "host string, path long, inside long, outside array<long>", rows, 64)
    votes = scratch.written(read.filter("path IS NOT NULL"), "votes")
    n_pages = votes.groupBy("host").agg(F.count(F.lit(1)).alias("n_pages"))
    share = F.col("n") >= REPEATED_SHARE * F.col("n_pages")
    chosen = votes.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")).join(n_pages, "host").filter(share)
    ranked = chosen.groupBy("host").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "path"))).alias("ranked"))
    winners = ranked.select("host", F.col("ranked.path").alias("winners"))
    seen = votes.select("host", "inside", F.explode("outside").alias("block")).distinct().groupBy("host", "block").agg(F.count(F.lit(1)).alias("n"))
    often = seen.filter(F.col("n") >= REPEATED).join(n_pages, "host").filter(share)
    return winners.join(often.groupBy("host").agg(F.collect_list("block").alias("repeated")), "host", "left")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col``, ``url_col``, ``text`` and ``n_chars`` of each page."""
    scratch = Scratch()
    winners = cut(host_paths(pages, scratch, url_col, html_col))
    scratch.drop()
    held = F.size("winners") + F.greatest(F.size("repeated"), F.lit(0))
    hosts, blocks = winners.agg(F.count(F.lit(1)), F.coalesce(F.sum(held), F.lit(0))).first()
    if hosts <= BROADCAST_HOSTS and blocks <= BROADCAST_BLOCKS:
        winners = F.broadcast(winners)
    host = F.lower(F.substring(F.regexp_extract(F.coalesce(url_col, F.lit("")), r"^\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), 1, 255))
    joined = pages.select(id_col, url_col, html_col).withColumn("host", host).join(winners, "host", "left")

    def rows(got: dict[str, list]) -> dict[str, list]:
        lists = zip(got[html_col], got["winners"], got["repeated"], strict=True)
        texts = [extract((h or b"").decode("utf-8", "replace"), w, set(r or ())) for h, w, r in lists]
        urls = [None if u is None else u.decode("utf-8") for u in got[url_col]]
        return {"__id": got[id_col], "__url": urls, "text": texts, "n_chars": [len(t) for t in texts]}

    kind = pages.schema[id_col].dataType.simpleString()
    out = map_rows(joined, [id_col, url_col, html_col, "winners", "repeated"], f"__id {kind}, __url string, text string, n_chars long", rows, 64)
    return out.withColumnsRenamed({"__id": id_col, "__url": url_col})


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))

"""Operator 1: main text of HTML pages with a site style tree.

1. Every page is parsed into elements (tolerant of what is left open).  An element's place in
   the site's style tree is its path of tags with classes; merging the pages of a host by
   these paths gives the tree, one node per (host, path).  Pages of a host that are alike in
   all blocks and child sequences are copies and enter the tree once.
2. A node's presentation importance is the entropy (base: pages of the node) of the
   child sequences that its pages show; its content importance is one minus the
   mean, over its text blocks, of the share of a block's spread over the pages (log of
   the pages that show the very block, base: pages of the node).  Layout that is
   always alike and text that is always the same have low importance.
3. Branches below ``THRESHOLD`` on hosts with ``MIN_PAGES`` pages of the node are removed
   from each page, up to a marked article or main part inside them, with what their tags,
   roles or class names mark as menu, header, footer, sidebar, notice, advert, form,
   script, style or comment.
4. If the page marks an article (or a main part), only that is read (unless most of the text left stands beside
   it); importance removes nothing in there.  A form around an article does not hide it.

The statistics are hash aggregates per (host, path, feature) over distinct pages, dealt by
all of these, so a hot host is spread.  The table of unimportant paths has a row per host; it is broadcast up to
``BROADCAST_HOSTS`` rows and joined on the host beyond.

Defined cases: null or empty html gives an empty text; markup without any article,
main or body is read as a whole; tags that are never closed end with their parent or
the page; a url without host (or null) is a site of its own name; repeated rows each get
their text and count once; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package, stage

THRESHOLD, MIN_PAGES, CONTENT_SHARE = 0.2, 8, 0.9
#: Marked articles (or main parts) with less than one part in so many of the text that is left are teasers.
TEASER = 4
BROADCAST_HOSTS = 20_000

# ---- fixed values: element and attribute names of HTML, and common class names
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea xmp iframe noembed noframes noscript template".split())
BLOCK = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset "
            "figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav "
            "ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
NOISE = set("head nav header footer aside form button select input dialog menu search svg math object applet audio "
            "video canvas map datalist".split()) | RAW
NOISE_WORDS = set("ad ads adv advert adverts advertisement banner breadcrumb breadcrumbs comment comments commentlist "
                  "consent cookie cookies copyright disclaimer disqus footer header login masthead menu modal nav navbar "
                  "navigation newsletter notice notices overlay pager pagination popup promo promotion recommended related "
                  "respond share sharing sidebar signup skyscraper social sponsor sponsored subscribe toolbar widget".split())
NOISE_ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search "
                  "toolbar".split())
#: Name parts behind which a word still tells the role ("comments-area"), and before which it does not ("no-sidebar").
HOLDERS = set("area bar block body box container content form group holder inner item items list outer panel section "
              "wrap wrapper".split())
STATES = set("allow allows disable enable has have hide is no non not show with without".split())
#: A start tag ends these open elements (up to the given border).
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
          "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody"}, {"table"}),
          "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"})}
# ---- end of fixed values
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

_MARK = re.compile(
    r"<!--(?:.*?(?:--!?>|\Z))"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_WORDS = re.compile(r"[a-z0-9]+")


def attributes(raw: str) -> dict[str, str]:
    if "=" not in raw and not raw.strip(" /"):
        return {}
    return {k.lower(): _html.unescape(v.strip("\"'")) for k, v in reversed(_ATTR.findall(raw))}


def marked_noise(tag: str, attrs: dict[str, str], in_article: bool, in_region: bool) -> bool:
    """Whether tag, role or class names mark an element as something beside the article."""
    if tag in ("html", "body", "main"):
        return False
    if tag in NOISE and not (tag == "header" and in_region):
        return True
    if not attrs:
        return False
    if "hidden" in attrs or attrs.get("role", "").lower() in NOISE_ROLES or attrs.get("aria-hidden") == "true":
        return True
    names = (attrs.get("class", "") + " " + attrs.get("id", "")).lower().split()
    return any(map(role_word, names)) and not (in_article and tag in HEADINGS | {"header"})


def role_word(name: str) -> bool:
    """Whether a class name or id says what its element is: a word of ``NOISE_WORDS`` as a whole, or at its end."""
    parts = _WORDS.findall(name)
    while len(parts) > 1 and parts[-1] in HOLDERS | {p for p in parts[-1:] if p.isdigit()}:
        parts.pop()
    return bool(parts) and parts[-1] in NOISE_WORDS and parts[0] not in STATES


class Page:
    """Blocks of a page with the paths above them, and the child sequence of every path."""

    def __init__(self, text: str, unimportant: frozenset | set = frozenset()):
        self.blocks: list[tuple[str, int, int]] = []                # text, style path, region
        self.children: dict[int, list[int]] = {}
        self.regions: set[int] = set()                              # 2: article, 1: main
        self._open: list[tuple[str, int, int, int]] = [("", 0, 0, 0)]   # tag, path, noise (1: by style, 2: marked, 3: a form), region
        self._tags: Counter = Counter()                             # of what is open
        self._text: list[str] = []
        self._unimportant = unimportant
        at, n = 0, len(text)
        while at < n:
            m = _MARK.search(text, at)
            if not m:
                self._add(text[at:])
                break
            if m.start() > at:
                self._add(text[at:m.start()])
            at = m.end()
            tag = m[2] or m[5]
            if not tag:
                continue
            tag = tag.lower()
            if m[1] or m[4]:
                self._end(tag)
                continue
            raw = m[3] or m[6] or ""
            self._start(tag, raw)
            if tag in RAW:
                end = re.compile(f"</{re.escape(tag)}[\\s/>]", re.I).search(text, at)
                at = n if end is None else end.start()
        self._flush()

    def _add(self, s: str) -> None:
        if not self._open[-1][2]:
            self._text.append(s)

    def _flush(self) -> None:
        if self._text:
            s = " ".join(_html.unescape("".join(self._text)).split())
            self._text.clear()
            if s:
                self.blocks.append((s, self._open[-1][1], self._open[-1][3]))

    def _start(self, tag: str, raw: str) -> None:
        if tag == "br":
            self._add(" ")
        if tag in BLOCK:
            self._flush()
            if tag not in ("button",):
                self._close({"p"}, {"button", "td", "th", "table"})
            if tag in CLOSES:
                self._close(*CLOSES[tag])
        if tag in VOID:
            return
        above = self._open[-1]
        attrs = attributes(raw)
        style = tag + "." + ".".join(sorted(attrs.get("class", "").lower().split()))
        path = xxhash.xxh64_intdigest(f"{above[1]}/{style}") - (1 << 63)
        if not above[2]:
            seen = self.children.setdefault(above[1], [])
            if not seen or seen[-1] != path:            # a run of like children is one
                seen.append(path)
        region = above[3]
        if tag == "article" or attrs.get("itemprop") == "articleBody":
            region = 2
        elif region == 0 and (tag == "main" or attrs.get("role") == "main"):
            region = 1
        part = region > above[3]
        if above[2] == 2 or (above[2] == 3 and not part):
            noise = above[2]
        elif marked_noise(tag, attrs, above[3] == 2, above[3] > 0):
            noise = 3 if tag == "form" else 2
        else:
            noise = int(not region and (above[2] == 1 or path in self._unimportant))
        if not noise and region:
            self.regions.add(region)
        self._open.append((tag, path, noise, region))
        self._tags[tag] += 1

    def _drop(self, k: int) -> None:
        """Close everything from place ``k`` of the open elements on."""
        for tag, *_ in self._open[k:]:
            self._tags[tag] -= 1
        del self._open[k:]

    def _close(self, tags: set, borders: set) -> None:
        if not any(self._tags[t] for t in tags):
            return
        for k in range(len(self._open) - 1, 0, -1):
            if self._open[k][0] in borders:
                return
            if self._open[k][0] in tags:
                self._drop(k)
                return

    def _end(self, tag: str) -> None:
        if tag in BLOCK:
            self._flush()
        if not self._tags[tag]:
            return
        for k in range(len(self._open) - 1, 0, -1):
            if self._open[k][0] == tag:
                self._drop(k)
                return
            if tag not in BLOCK and self._open[k][0] in BLOCK:
                return                                    # an inline end tag closes no block

    def text(self) -> str:
        region = max(self.regions, default=0)
        kept = [s for s, _, r in self.blocks if r >= region]
        every = [s for s, _, _ in self.blocks]
        if TEASER * sum(map(len, kept)) < sum(map(len, every)):       # a teaser beside the story
            kept = every
        return "\n\n".join(kept)


def host(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))


def features(pages: DataFrame, url: str, html: str) -> DataFrame:
    """``_host, node, kind, feature``, once per page: child sequences (kind 0) and text blocks (1);
    ``page`` is a hash of all of the page's features."""
    def parse(batches):
        for b in batches:
            at, node, kind, feature, page = [], [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                p = Page(t or "")
                rows = {(n, 0, xxhash.xxh64_intdigest(repr(c)) - (1 << 63)) for n, c in p.children.items()}
                rows |= {(path, 1, xxhash.xxh64_intdigest(s) - (1 << 63)) for s, path, _ in p.blocks}
                whole = xxhash.xxh64_intdigest(repr(sorted(rows))) - (1 << 63)
                page += [whole] * len(rows)
                for n, k, f in rows:
                    at.append(i)
                    node.append(n)
                    kind.append(k)
                    feature.append(f)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), pa.array(node, pa.int64()), pa.array(kind, pa.int8()),
                 pa.array(feature, pa.int64()), pa.array(page, pa.int64())],
                names=["_host", "node", "kind", "feature", "page"])

    return pages.select(F.xxhash64(host(F.col(url))).alias("_host"), F.col(html).alias("h")).mapInArrow(
        parse, "_host long, node long, kind byte, feature long, page long")


def unimportant(pages: DataFrame, *, url: str = "url", html: str = "html", threshold: float = THRESHOLD,
                min_pages: int = MIN_PAGES) -> DataFrame:
    """``_host, _nodes``: per host the paths whose composite importance is below ``threshold``."""
    counts = (features(pages, url, html).distinct()                 # copies of a page count once
              .groupBy("_host", "node", "kind", "feature").agg(F.count(F.lit(1)).alias("k")))
    # sum and sum of k log k are all that both entropies need
    sums = counts.groupBy("_host", "node").agg(
        F.sum(F.when(F.col("kind") == 0, F.col("k"))).alias("m0"),
        F.sum(F.when(F.col("kind") == 0, F.col("k") * F.log("k"))).alias("l0"),
        F.sum(F.when(F.col("kind") == 1, F.col("k"))).alias("n1"),
        F.sum(F.when(F.col("kind") == 1, F.col("k") * F.log("k"))).alias("l1"),
        F.max("k").alias("most"))
    pages_of = F.coalesce("m0", "most")
    base = F.log(pages_of.cast("double"))
    layout = F.when(F.col("m0") > 0, (F.log("m0") - F.col("l0") / F.col("m0")) / base)
    content = F.when(F.col("n1") > 0, F.greatest(1 - F.col("l1") / F.col("n1") / base, F.lit(0.0)))
    importance = F.when(content.isNull(), F.lit(1.0)).otherwise(
        (1 - CONTENT_SHARE) * F.coalesce(layout, content) + CONTENT_SHARE * content)
    return (sums.filter((F.col("node") != 0) & (pages_of >= min_pages)).filter(importance < threshold)
                .groupBy("_host").agg(F.collect_list("node").alias("_nodes")))


def main_text(pages: DataFrame, *, id_col: str = "page_id", url: str = "url", html: str = "html",
              threshold: float = THRESHOLD, min_pages: int = MIN_PAGES) -> DataFrame:
    """Per row: id, url, text and n_chars (code points)."""
    ship_package(pages.sparkSession)
    noise = stage(unimportant(pages, url=url, html=html, threshold=threshold, min_pages=min_pages), "styles")
    small = noise.count() <= BROADCAST_HOSTS

    def extract(batches):
        for b in batches:
            texts = [Page(h, frozenset(x or ())).text() if h else ""
                     for h, x in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("h"),
                        F.xxhash64(host(F.col(url))).alias("_host"))
    rows = rows.join(F.broadcast(noise) if small else noise, "_host", "left").select("page_id", "url", "h", "_nodes")
    kind = pages.schema[id_col].dataType.simpleString()
    out = rows.mapInArrow(extract, f"page_id {kind}, url string, text string, n_chars long")
    return out.withColumnsRenamed({"page_id": id_col, "url": url})

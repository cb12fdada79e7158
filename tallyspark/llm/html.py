"""Operator 8: main text of web pages with a site style tree.

The pages of a host are merged into one tree: a node is a path of tags with their classes. Spark counts, per
host and path, in how many different pages a node occurs, how its children are laid out (presentation) and
which texts its blocks hold (content). With h different pages of the host, a text on c of them has the importance
1 - log c / log h; with m pages at a node, a presentation has the entropy of its layouts divided by log m. Branches
whose content and presentation both have low importance are noise, and so is a text of low importance alone, but
only nodes that some page of the host has outside of a marked article. Each page is then
read once more with the noise of its host: what the markup itself names as menu, footer, advert and so on goes,
and of what is left the article counts, or the whole page if it marks none.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import blocks, bounded_batches, materialize, task, text_bytes

#: A tag without attributes; the name of any tag; what ends a tag or begins an attribute's value.
PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>\"'=]*)(\s*)>")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
STOP, SPACE = re.compile(r"[>=]"), re.compile(r"\s*")
#: Elements whose content is text up to their end tag and goes with them.
RAW = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in ("script", "style", "textarea")}
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements that stand in a line as words do. Their text goes, but for math and object in an article; nothing after their end does.
EMBEDDED = frozenset("svg math object canvas noscript template select iframe".split())
MATH = frozenset("math mi mn mo ms mtext mspace mrow mfrac msqrt mroot msup msub msubsup munder mover munderover mmultiscripts mtable mtr mtd mstyle mpadded mphantom menclose semantics annotation annotation-xml".split())
INLINE |= EMBEDDED | MATH
#: HTML tags that end an open svg or math, as browsers read them, but for those inside the elements of the second kind.
BREAKS = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li menu meta ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
HOLDS_HTML = frozenset("foreignobject desc title annotation-xml".split())
#: An opening tag of the first kind ends open elements of the second up to one of the third.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
NOISE_TAGS = frozenset("head nav footer aside form button menu dialog fieldset".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
NOISE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|sidebar|side-?bar|menu\w*|nav|navbar|navigation|breadcrumbs?|footer|masthead|site-?header|page-?header"
    r"|comments?|commentlist|discussion|disqus|replies|share|sharing|social|related|recommended|newsletter|subscribe|popup|modal|overlay|widgets?|pagination|pager|login|signup|copyright|disclaimer|hidden)(?:$|[\s_-])",
    re.I,
)
#: In a marked article a class or id names noise only as a whole: words that say so by themselves, words that do so in company, and words
#: that name any part of a page.
NOISE_ALONE = frozenset("ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion cookie cookies gdpr sidebar menu nav navbar navigation breadcrumb breadcrumbs masthead comments commentlist disqus replies newsletter subscribe popup modal pagination pager login signup".split())
NOISE_JOINED = NOISE_ALONE | frozenset("comment notice notices consent banner share sharing social related recommended footer reply site side".split())
PART_NAMES = frozenset("area bar block box button buttons container content form header inner item items left link links list main outer panel post posts article articles stories right section slot top bottom unit widget wrap wrapper".split())
#: Importance under which a node is noise, and the number of different pages that a node must occur in.
LOW_IMPORTANCE, LEAST_PAGES = 0.05, 6
#: Noise of so many nodes (8 bytes each) at most is broadcast; more is joined to the pages by a shuffle.
BROADCAST_NODES = 1_000_000


def _names_noise(name: str, is_class: bool) -> bool:
    """Whether a class or id of an element inside an article names noise: cookie-notice does, notice-period doesn't."""
    words = [w for w in re.split(r"[_\W\d]+|(?<=[a-z])(?=[A-Z])", name) if w]
    low = [w.lower() for w in words]
    if len(low) == 1:
        return low[0] in NOISE_ALONE or (is_class and low[0] == "discussion")
    return any(w in NOISE_JOINED for w in low) and all(w in NOISE_JOINED or w in PART_NAMES for w in low)


def _attributes(text: str) -> tuple[str, bool, bool, bool]:
    """Of the attributes of a tag: the class as written, whether they name noise on a page, whether in an article, whether the main part."""
    return _known_attributes(text) if len(text) <= 1000 else _known_attributes.__wrapped__(text)


@lru_cache(10_000)
def _known_attributes(text: str) -> tuple[str, bool, bool, bool]:
    found = {a.lower(): html.unescape(b or c or d) for a, b, c, d in ATTRIBUTE.findall(text)}
    style = found.get("style", "").replace(" ", "").lower()
    hidden = found.get("role", "").lower() in NOISE_ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style
    names = found.get("class", ""), found.get("id", "")
    loose = hidden or any(map(NOISE_NAMES.search, names))
    strict = hidden or any(_names_noise(x, True) for x in names[0].split()) or _names_noise(names[1], False)
    return names[0], loose, strict, found.get("role", "").lower() == "main" or found.get("itemprop", "").lower() == "articlebody"


def _tag_end(source: str, at: int) -> int:
    """The place of the > that ends the tag whose name ends at `at`, or -1. A quoted value may hold any text; one whose quote is
    never closed counts as unquoted."""
    while True:
        m = STOP.search(source, at)
        if not m:
            return -1
        if m[0] == ">":
            return m.start()
        at = SPACE.match(source, m.end()).end()
        if source[at : at + 1] in ('"', "'"):
            closed = source.find(source[at], at + 1)
            at = closed + 1 if closed >= 0 else at + 1


def markup(source: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, stop, closes, tag, attributes) of each piece of markup; comments, declarations and the elements of RAW have an empty
    tag. Every character is looked at a bounded number of times, and nothing is bounded: what browsers take for one tag is one."""
    at, n = source.find("<"), len(source)
    while at >= 0:
        m = PLAIN.match(source, at)
        if m:
            closes, tag, name, stop = m[1] == "/", m[2].lower(), "", m.end()
        else:
            after = source[at + 1 : at + 2]
            closes = after == "/"
            named = NAME.match(source, at + 1 + closes)
            if not named:
                if after in ("!", "?") or (closes and at + 2 < n):
                    end = source.find("-->", at + 2) if source.startswith("<!--", at) else source.find(">", at + 2)
                    stop = n if end < 0 else end + (3 if source.startswith("<!--", at) else 1)
                    yield at, stop, False, "", ""
                    at = source.find("<", stop)
                else:
                    at = source.find("<", at + 1)
                continue
            end = _tag_end(source, named.end())
            stop = n if end < 0 else end + 1
            tag, name = named[0].lower(), source[named.end() : n if end < 0 else end]
        if tag in RAW and not closes:
            m = RAW[tag].search(source, stop)
            if m:
                end = _tag_end(source, m.end())
                stop = n if end < 0 else end + 1
            else:
                stop = n
            tag = ""
        yield at, stop, closes, tag, name
        at = source.find("<", stop)


class Page:
    """Blocks of text in page order as (path, noise, main, text, link characters); layouts as {path: layout}."""

    def __init__(self, source: str):
        self.blocks: list[tuple[int, bool, bool, str, int]] = []
        self.layouts: dict[int, int] = {}
        self.text: list[str] = []
        self.linked = 0
        self.hidden = 0  # the place in the stack of an open element whose text goes
        self.open, self.within = Counter(), Counter()  # open elements by tag, in all and within the hidden one
        # An element: tag, path, noise, main, link, tags of its children.
        self.stack: list[tuple[str, int, bool, bool, bool, list[str]]] = [("", 0, False, False, False, [])]
        self.holders = [self.stack[0]]  # the open elements that aren't inline
        done = 0
        for start, stop, closes, tag, attributes in markup(source):
            if start > done:
                self._text(source[done:start])
            done = stop
            if closes:
                self._close(tag)
            elif tag:
                self._open(tag, attributes)
        if done < len(source):
            self._text(source[done:])
        while len(self.stack) > 1:
            self._pop()
        self._flush()

    def _text(self, x: str) -> None:
        if self.hidden:
            return
        self.text.append(x)
        if self.stack[-1][4]:
            self.linked += len(x)

    def _flush(self) -> None:
        if self.text:
            words = html.unescape("".join(self.text)).split()
            if words:
                _, path, noise, main, _, _ = self.holders[-1]
                self.blocks.append((path, noise, main, " ".join(words), self.linked))
            self.text, self.linked = [], 0

    def _push(self, element: tuple[str, int, bool, bool, bool, list[str]]) -> None:
        self.stack.append(element)
        if element[0] not in INLINE:
            self.holders.append(element)
        self.open[element[0]] += 1
        if self.hidden:
            self.within[element[0]] += 1

    def _pop(self) -> None:
        self.open[self.stack[-1][0]] -= 1
        if self.hidden:
            if self.stack[-1][0] not in INLINE:
                self.holders.pop()
            self.within[self.stack.pop()[0]] -= 1
            if len(self.stack) <= self.hidden:
                self.hidden = 0
                self.within.clear()
            return
        if self.stack[-1][0] not in INLINE:
            self._flush()
        tag, path, _, _, _, children = self.stack.pop()
        if tag not in INLINE:
            self.holders.pop()
        if children and tag not in INLINE:
            self.layouts[path] = xxhash.xxh3_64_intdigest(" ".join(children))

    def _open_hidden(self, tag: str, attributes: str) -> bool:
        """Whether the tag is inside an element whose text goes; an HTML tag ends an svg or math that was left open."""
        inside = lambda tags: any(self.within[x] for x in tags)
        drawn = self.stack[self.hidden][0] in ("svg", "math")
        if drawn and tag in BREAKS and not inside(HOLDS_HTML):
            while self.hidden:
                self._pop()
            return False
        if tag not in VOID and not (attributes.rstrip().endswith("/") and inside(("svg", "math"))):
            self._push((tag, *self.stack[-1][1:5], []))
        return True

    def _open(self, tag: str, attributes: str) -> None:
        if self.hidden and self._open_hidden(tag, attributes):
            return
        if tag == "br":
            self.text.append(" ")
            return
        if tag not in INLINE:
            self._flush()
            if self.open["p"]:
                self._end({"p"}, {"article", "body", "div", "section", "main", "td", "li", "blockquote"})
        if tag in CLOSES:
            self._end(*CLOSES[tag])
        if tag in VOID or ((tag == "svg" or tag in MATH) and attributes.rstrip().endswith("/")):
            return
        if tag in EMBEDDED and not (tag in ("math", "object") and self.stack[-1][3]):
            self.hidden = len(self.stack)
            self._push((tag, *self.stack[-1][1:5], []))
            return
        name, loose, strict, main = _attributes(attributes) if attributes and not attributes.isspace() else ("", False, False, False)
        _, path, was_noise, was_main, link, children = self.stack[-1]
        noise = strict if was_main else loose
        if tag not in INLINE:
            children.append(tag)
        article = was_main or main or tag in ("article", "main")
        noise = was_noise or noise or tag in NOISE_TAGS or (tag in ("header", "figcaption") and not article)
        own = path if tag in INLINE else xxhash.xxh3_64_intdigest(f"{path}/{tag}.{name}")
        self._push((tag, own, noise, article, link or tag == "a", []))

    def _end(self, which: set[str], up_to: set[str]) -> None:
        """End the outermost open element of `which` above one of `up_to`, with what it holds."""
        if not any(self.open[x] for x in which):
            return
        at = 0
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] in up_to:
                break
            if self.stack[k][0] in which:
                at = k
        while at and len(self.stack) > at:
            self._pop()

    def _close(self, tag: str) -> None:
        if not self.open[tag]:
            if tag not in INLINE and not self.hidden:
                self._flush()
            return
        if self.hidden:
            at = next((k for k in range(len(self.stack) - 1, 0, -1) if self.stack[k][0] == tag and (k >= self.hidden or tag not in INLINE)), 0)
            while at and len(self.stack) > at:
                self._pop()
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] == tag:
                while len(self.stack) > k:
                    self._pop()
                return
            if tag in INLINE and self.stack[k][0] not in INLINE:
                return
        if tag not in INLINE:
            self._flush()

    def main_text(self, noise: set[int]) -> str:
        """Blocks that aren't noise: those of the article, or of the page without those that are mostly links."""
        left = [b for b in self.blocks if not b[1] and b[0] not in noise and (b[0] ^ _digest(b[3])) not in noise] if noise else [b for b in self.blocks if not b[1]]
        main = [b[3] for b in left if b[2]]
        return " ".join(main or [b[3] for b in left if 2 * b[4] <= len(b[3])])


def _digest(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@task
def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in blocks(batches, "html"):
        host, path, value, layout, page, outside = [], [], [], [], [], []
        for h, source in zip(t.column("tree").to_pylist(), text_bytes(t.column("html")), strict=True):
            p, own = Page(source.decode()), _signed(xxhash.xxh3_64_intdigest(source))
            rows = {(k, v, True): True for k, v in p.layouts.items()}
            for b in p.blocks:
                if not b[1]:
                    node = (b[0], b[0] ^ _digest(b[3]), False)
                    rows[node] = rows.get(node, False) or not b[2]
            for (k, v, is_layout), out in rows.items():
                host.append(h)
                path.append(_signed(k))
                value.append(_signed(v))
                layout.append(is_layout)
                page.append(own)
                outside.append(out)
        cols = [pa.array(host, pa.int64()), pa.array(path, pa.int64()), pa.array(value, pa.int64()), pa.array(layout, pa.bool_()), pa.array(page, pa.int64()), pa.array(outside, pa.bool_())]
        yield pa.RecordBatch.from_arrays(cols, names=["tree", "path", "value", "layout", "page", "outside"])


def style_tree_noise(pages: DataFrame) -> DataFrame:
    """(tree, noise): the paths and texts of low importance in the merged tree of each host's pages (tree, html),
    tree being the host's hash.

    Pages with the same bytes count once, so copies of a page don't make it noise. A node on fewer than
    LEAST_PAGES different pages is never noise, nor is one that is in a marked article wherever it occurs. A
    content is rated by the host's different pages, not by those that have its path: what a few articles share
    (a heading, a table's head, a quotation) says nothing of the site."""
    nodes = materialize(pages.mapInArrow(_nodes, "tree bigint, path bigint, value bigint, layout boolean, page bigint, outside boolean").distinct(), "site-nodes")
    # One row for a value; c: pages that have it. A page's values of a path count for the path once.
    values = nodes.groupBy("tree", "path", "layout", "value").agg(F.count("*").alias("c"), F.bool_or("outside").alias("outside"))
    hosts = nodes.groupBy("tree", "page").agg(F.lit(1).alias("one")).groupBy("tree").agg(F.count("*").alias("h"))
    m = nodes.groupBy("tree", "path", "layout", "page").agg(F.lit(1).alias("one")).groupBy("tree", "path", "layout").agg(F.count("*").alias("m")).where(F.col("m") >= LEAST_PAGES)
    often = values.where("c > 1")  # a value on one page has the importance 1 and is counted without its row
    once = values.groupBy("tree", "path", "layout").agg(F.count_if(F.col("c") == 1).alias("once"))
    m = m.join(once, ["tree", "path", "layout"])
    rated = often.join(m, ["tree", "path", "layout"])
    texts = rated.where("not layout").join(hosts, "tree").withColumn("importance", F.expr("1 - ln(c) / ln(h)"))
    by_text = texts.where((F.col("importance") < LOW_IMPORTANCE) & F.col("outside")).select("tree", F.col("value").alias("noise"))
    content = texts.groupBy("tree", "path").agg(((F.sum(F.col("importance") * F.col("c")) + F.max("once")) / (F.sum("c") + F.max("once"))).alias("content"), F.bool_or("outside").alias("outside")).where("outside").drop("outside")
    shown = rated.where("layout").groupBy("tree", "path").agg(F.expr("(-sum(c / m * ln(c / m)) + max(once / m * ln(m))) / ln(max(m))").alias("presentation"))
    by_path = content.join(shown, ["tree", "path"], "left").where((F.col("content") < LOW_IMPORTANCE) & (F.coalesce("presentation", F.lit(0.0)) < LOW_IMPORTANCE)).select("tree", F.col("path").alias("noise"))
    return by_text.unionByName(by_path)


@task
def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in blocks(batches, "html"):
        noise = [{x & 0xFFFFFFFFFFFFFFFF for x in n or ()} for n in t.column("noise").to_pylist()]
        texts = [Page(x.decode()).main_text(n) for x, n in zip(text_bytes(t.column("html")), noise, strict=True)]
        t = t.drop_columns(["html", "noise"])
        yield pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in t.columns), pa.array(texts, pa.string())], names=[*t.column_names, "text"])


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of pages (page_id, url, html), one row for each input row.

    text holds the article's blocks in page order with one space between them; character references are
    decoded and white space in a block becomes one space. A null or empty html gives ''. A null url has no
    host and so no tree; null ids and repeated rows are kept; an empty table gives no rows; other columns of
    the input are ignored; html of any length is read whole."""
    bounded_batches(pages.sparkSession)
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    own = pages.select("page_id", "url", "html", F.when(host != "", F.xxhash64(host)).alias("tree"))
    noise = style_tree_noise(own.where("tree is not null").select("tree", "html")).groupBy(F.col("tree").alias("of")).agg(F.collect_set("noise").alias("noise"))
    noise = materialize(noise, "site-noise")
    if noise.agg(F.coalesce(F.sum(F.size("noise")), F.lit(0))).first()[0] <= BROADCAST_NODES:
        noise = F.broadcast(noise)
    kind = pages.schema["page_id"].dataType.simpleString()
    rows = own.join(noise, F.col("tree") == F.col("of"), "left").select("page_id", "url", "html", "noise")
    return rows.mapInArrow(_extract, f"page_id {kind}, url string, text string")

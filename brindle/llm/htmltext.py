"""Main text of web pages by site template removal.

Pages are parsed into elements; every element that may be template gets a hash of its subtree (tags and
text, not attributes). Spark counts on how many different pages of a host each hash occurs, with map-side
combine; pages of the same text, their templates included, are one page. Subtrees that recur on many pages
of their host are deleted, and so are elements that say themselves what they are (navigation, footers,
forms, scripts, adverts, comments). Lines go whole or not at all, and a page keeps its prose where nothing
else is left of it. If a page marks its article (article, main or role=main), the text is that of the
article; prose inside it is never template, however often it recurs, nor is what holds the article. What
remains is joined block by block.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import read_table, scratch, small_batches, staged

#: A subtree is template if it occurs on at least so many different pages of its host, however large the host.
MIN_PAGES = 5
#: Share of an element's text that is in links for it to be a list of links.
LINK_SHARE = 0.5
#: Links that a list within an article has at least, if it may be template.
LINKS = 3

# Names of the HTML standard and usual words in class, id and role attributes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math object select".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li "
    "main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre dd dt td th tr tbody thead tfoot figcaption caption".split())
# What stands in these is part of their text.
LINES = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption caption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# What a list of links within an article may be.
LISTS = frozenset("ul ol div section".split())
OWN_KIND = frozenset("nav footer aside form button dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices notification popup modal overlay "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead toolbar share sharing social related recommended newsletter subscribe subscription signup login "
    "comment comments commentlist disqus respond replies pagination pager widget".split()
)
# Of WORDS, those of reader comments.
REMARKS = frozenset("comment comments commentlist disqus respond replies".split())
# A name ends with the word that says what it is, or with one of these after it.
TAILS = frozenset("area articles bar block box buttons container form icons inline inner items links list menu panel posts section slot text unit wrapper".split())
# A wrapper that only says that a part of the page exists, or how it is laid out, is not that part.
ABOUT = frozenset("has with no without layout open enabled wrap".split())
#: What an element says itself to be: nothing of this kind, boilerplate, reader comments, or a frame that is never main text.
TEXT, BOILERPLATE, COMMENTS, FRAME = 0, 1, 2, 3
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th")}
BOUNDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "tbody": ("table",), "tfoot": ("table",)}

NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
# Where a tag may end, or a quoted value begins in which it can't.
STOP = re.compile(r">|=\s*([\"'])")
ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/>]|$)", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Element:
    __slots__ = ("tag", "kind", "root", "parts", "chars", "linked", "hash", "events", "inside", "up", "in_line", "in_prose", "words", "holds_root", "holds_prose", "links", "block", "closer", "solid", "seen", "in_link")

    def __init__(self, tag: str, kind: int, root: bool, inside: bool, events: int, up: Element | None = None):
        self.tag, self.kind, self.root, self.inside, self.events, self.up = tag, kind, root, inside, events, up
        self.in_line = up is not None and (up.in_line or up.tag in LINES)
        self.in_prose = up is not None and (up.in_prose or up.tag in PROSE)
        self.words = self.holds_root = self.holds_prose = False
        self.links = 0
        self.in_link = tag == "a" or (up is not None and up.in_link)
        # Characters that are not in links, and those of them that stand in nothing else of a kind.
        self.solid = self.seen = 0
        self.parts: list[bytes] = []
        self.chars = self.linked = 0
        self.hash = 0


def named_kind(name: str) -> int:
    """What one class or id says."""
    words = [w.lower() for w in WORD.findall(name)]
    if not words or not ABOUT.isdisjoint(words):
        return TEXT
    found = WORDS.intersection(words if words[-1] in TAILS else words[-1:])
    return COMMENTS if found & REMARKS else BOILERPLATE if found else TEXT


def own_kind(tag: str, attributes: str, in_root: bool, in_line: bool) -> tuple[int, bool]:
    """What an element says itself to be, and whether it may mark the main text."""
    main = tag in ("article", "main")
    kind = FRAME if tag in ("nav", "footer") else BOILERPLATE if (tag in OWN_KIND and not (tag == "button" and in_line)) or (tag == "header" and not in_root) else TEXT
    if not attributes or tag in ("html", "body"):
        return kind, main
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return FRAME, False
        if name == "role":
            kind = max(kind, FRAME if value.lower() in ROLES else TEXT)
            main = main or value.lower() == "main"
        elif name in ("class", "id"):
            kind = max([kind, *map(named_kind, value.split())])
    return kind, main and kind < COMMENTS


class Scanner:
    """Finds the ends of tags in time that follows the page's length, however broken the page."""

    def __init__(self, html: str):
        self.html = html
        self.last = {c: html.rfind(c) for c in ">\"'"}

    def tag_end(self, at: int) -> int:
        """Where the `>` of a tag is whose attributes begin at `at`: outside quoted values, or the first one if a quote is not closed; -1 without any."""
        html, last, first = self.html, self.last, at
        while at <= last[">"]:
            m = STOP.search(html, at)
            if not m[1]:
                return m.start()
            if m.end() > last[m[1]]:
                break
            at = html.find(m[1], m.end()) + 1
        return html.find(">", first) if first <= last[">"] else -1


def parse(html: str) -> tuple[list[tuple], list[Element]]:
    """Events in page order and closed elements.

    Events: ("t", text), ("b",) for the border of a block, ("o", element) and ("c", element). The text of
    raw elements (scripts, styles, titles, ...) is left out. A `<` that begins no tag is text, and so is the
    rest of a page from a tag on that no `>` ends; comments and raw elements that are not closed reach to the
    end of the page.
    """
    import xxhash

    events: list[tuple] = []
    closed: list[Element] = []
    root = Element("", TEXT, False, False, 0)
    root.block = root.closer = 0
    stack: list[Element] = [root]
    # The places in the stack of the open elements of each tag.
    places: dict[str, list[int]] = {}

    def close() -> None:
        e = stack.pop()
        places[e.tag].pop()
        up = stack[-1]
        up.holds_root |= e.root or e.holds_root
        if e.chars:
            up.solid += e.solid
            if not e.kind:
                up.seen += e.seen
            e.hash = xxhash.xxh3_64_intdigest(e.tag.encode("utf-8", "surrogatepass") + b"\0" + b"\0".join(e.parts)) - (1 << 63)
            up.parts.append(e.hash.to_bytes(8, "little", signed=True))
            up.chars += e.chars
            up.linked += e.chars if e.tag == "a" else e.linked
            up.links += 1 if e.tag == "a" else e.links
            up.holds_prose |= e.holds_prose or (e.tag in PROSE and e.tag not in HEADINGS) or (e.tag in LISTS and e.words)
            closed.append(e)
        events.append(("c", e))
        if e.tag in BLOCK:
            events.append(("b",))

    def text(data: str) -> None:
        if not data:
            return
        if "&" in data:
            data = unescape(data)
        events.append(("t", data))
        solid = " ".join(data.split())
        if solid:
            top = stack[-1]
            top.parts.append(solid.encode("utf-8", "surrogatepass"))
            top.chars += len(solid)
            if not top.in_link:
                top.solid += len(solid)
                top.seen += len(solid)
            top.words = top.words or any(map(str.isalnum, solid))

    def innermost(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def close_from(place: int, bound: int) -> None:
        """Close all from a place in the stack on, unless a boundary lies above it."""
        if place > bound:
            while len(stack) > place:
                close()

    scanner, at, begin = Scanner(html), 0, 0
    while True:
        found = html.find("<", at)
        if found < 0:
            text(html[begin:])
            break
        if html.startswith("<!--", found):
            text(html[begin:found])
            end = html.find("-->", found + 4)
            at = begin = end + 3 if end >= 0 else len(html)
            continue
        m = NAME.match(html, found + 1)
        end = scanner.tag_end(m.end()) if m else html.find(">", found) if html[found + 1 : found + 2] in ("!", "?") and found < scanner.last[">"] else -1
        if end < 0:
            at = found + 1
            continue
        text(html[begin:found])
        at = begin = end + 1
        if not m:
            continue
        tag, attributes = m[2].lower(), html[m.end() : end]
        if m[1]:
            if tag in BLOCK:
                if places.get(tag):
                    close_from(places[tag][-1], 0)
                else:
                    events.append(("b",))
            elif tag not in VOID:
                close_from(innermost((tag,)), stack[-1].closer)
            continue
        if tag == "br":
            events.append(("t", " "))
            continue
        if tag in VOID:
            if tag == "hr":
                events.append(("b",))
            continue
        if tag in RAW:
            if not attributes.rstrip().endswith("/"):
                over = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*>?", re.I).search(html, at)
                at = begin = over.end() if over else len(html)
            continue
        if tag in BLOCK:
            close_from(innermost(("p",)), stack[-1].block)
            if tag in CLOSES:
                close_from(min((places[t][-1] for t in CLOSES[tag] if places.get(t) and places[t][-1] > innermost(BOUNDS[tag])), default=0), 0)
            events.append(("b",))
        in_root = stack[-1].inside
        kind, main = own_kind(tag, attributes, in_root, stack[-1].in_line or stack[-1].tag in LINES)
        e = Element(tag, kind, main, in_root or main, len(events), stack[-1])
        # The innermost block but p, and block, at or below it in the stack.
        e.block = len(stack) if tag in BLOCK and tag != "p" else stack[-1].block
        e.closer = len(stack) if tag in BLOCK else stack[-1].closer
        places.setdefault(tag, []).append(len(stack))
        stack.append(e)
        events.append(("o", e))
    while len(stack) > 1:
        close()
    settle(closed, root.solid)
    return events, closed


def settle(closed: list[Element], solid: int) -> None:
    """Decide which marks are the article's, and take back what elements say of themselves where the article would go with them.

    Of several marks that of most text is the article's; nothing that it stands in is boilerplate. Marks within other
    boilerplate (teasers, comments) are none. On a page without marks, what holds more than half of all text outside of
    links is no boilerplate by its name, but for comments and frames.
    """
    marks = [e for e in closed if e.root]
    if marks:
        e = max(marks, key=lambda e: (e.seen, -e.events))
        while e is not None:
            e.kind, e = TEXT, e.up
        known: dict[int, bool] = {}
        for e in sorted(marks, key=lambda e: e.events):
            e.root = not (e.kind or _within_kind(e, known))
    else:
        for e in closed:
            if e.kind == BOILERPLATE and 2 * e.solid > solid:
                e.kind = TEXT


def _within_kind(e: Element, known: dict[int, bool]) -> bool:
    """Whether something above an element is boilerplate; what is found is kept for the next one."""
    path = []
    up = e.up
    while up is not None and id(up) not in known and not up.kind:
        path.append(id(up))
        up = up.up
    found = up is not None and (bool(up.kind) or known[id(up)])
    known.update(dict.fromkeys(path, found))
    return found


def may_be_template(e: Element) -> bool:
    """Outside the article, blocks and what stands in a line without bare words; in it, only whole lists of links, neither in prose nor with prose."""
    if e.root or e.holds_root or e.tag in ("html", "body"):
        return False
    if not e.inside:
        return not e.in_line and (e.tag in BLOCK or ((not e.up.tag or e.up.tag in BLOCK) and not e.up.words))
    return e.tag in LISTS and not (e.in_prose or e.holds_prose or e.words) and e.links >= LINKS and e.linked >= LINK_SHARE * e.chars


def page_hashes(html: str | None) -> tuple[int, set[int], set[int]]:
    """A hash of the text as it is with all templates, those of the subtrees that may be template, and those of them that can change the text."""
    import xxhash

    events, closed = parse(html or "")
    whole = xxhash.xxh3_64_intdigest("\n".join(_blocks(events, closed, frozenset())).encode("utf-8", "surrogatepass")) - (1 << 63)
    may = [e for e in closed if may_be_template(e)]
    marked = any(e.root for e in closed) and bool(_collect(events, True, ()))
    return whole, {e.hash for e in may}, {e.hash for e in may if e.inside or not marked}


def main_text(html: str | None, templates: frozenset[int] | set[int] = frozenset()) -> str:
    """Blocks of the main text, one a line. Templates that are no lists of links stay where nothing else would."""
    return "\n".join(_blocks(*parse(html), templates)) if html else ""


def _collect(events: list[tuple], marked: bool, templates: Iterable[Element], least: int = BOILERPLATE) -> list[str]:
    """The blocks outside templates and boilerplate (of kinds from `least` on), if marked only those within the article."""
    gone = {id(e) for e in templates}
    blocks, now, out, inside = [], [], 0, 0
    for event in events:
        kind = event[0]
        if kind == "t":
            if not out and (inside or not marked):
                now.append(event[1])
        elif kind == "b":
            if now:
                blocks.append(" ".join("".join(now).split()))
                now = []
        elif kind == "o":
            out += id(event[1]) in gone or event[1].kind >= least
            inside += event[1].root
        else:
            out -= id(event[1]) in gone or event[1].kind >= least
            inside -= event[1].root
    blocks.append(" ".join("".join(now).split()))
    return [b for b in blocks if b]


def _blocks(events: list[tuple], closed: list[Element], templates: frozenset[int] | set[int]) -> list[str]:
    found = [e for e in closed if e.hash in templates and may_be_template(e)] if templates else []
    blocks = []
    if any(e.root for e in closed):
        blocks = _collect(events, True, found) or (_collect(events, True, ()) if found else [])
    blocks = blocks or _collect(events, False, found)
    blocks = blocks or (_collect(events, False, [e for e in found if e.linked >= LINK_SHARE * e.chars]) if found else [])
    # A page with words outside of frames has a text.
    return blocks or (_collect(events, False, (), FRAME) if any(BOILERPLATE <= e.kind < FRAME for e in closed) else [])


def page_templates(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """host, page, hashes: the subtrees of a page that recur on many different pages of the host.

    pages has host, page (a key of the html) and html. Only pages whose text templates can change are in
    the result. Nothing is collected by host: what a row holds is bounded by the elements of its page.
    """

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                hosts, keys, found, texts = [], [], [], []
                for host, key, html in zip(part.column("host").to_pylist(), part.column("page").to_pylist(), part.column("html").to_pylist(), strict=True):
                    whole, mine, used = page_hashes(html)
                    hosts += [host] * len(mine)
                    keys += [key if h in used else None for h in mine]
                    found += mine
                    texts += [whole] * len(mine)
                columns = [pa.array(hosts, pa.string()), pa.array(keys, pa.binary()), pa.array(found, pa.int64()), pa.array(texts, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["host", "page", "hash", "whole"])

    known = pages.filter("host IS NOT NULL AND html IS NOT NULL").select("host", "page", "html")
    rows = staged(known.mapInArrow(hashes, "host string, page binary, hash long, whole long"), "subtrees")
    often = rows.groupBy("host", "hash").agg(F.count_distinct("whole").alias("n")).filter(F.col("n") >= min_pages).select("host", "hash")
    used = rows.filter("page IS NOT NULL").select("host", "page", "hash").distinct()
    return used.join(often, ["host", "hash"]).groupBy("host", "page").agg(F.collect_list("hash").alias("hashes"))


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", text_col: str = "text") -> DataFrame:
    """All columns of pages but the html, and text_col.

    Null and empty html give an empty text, as does a page without text. Pages without a host (null or
    odd url) have no templates. Pages of the same text count once; repeated rows are kept. A page of any
    length is parsed at once, in time and memory in proportion. A column of pages named like text_col is
    replaced.
    """
    host = F.lower(F.regexp_extract(url_col, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]+)", 1))
    pages = pages.drop(text_col)
    keyed = pages.withColumn("__host", F.when(host != "", host)).withColumn("__page", F.unhex(F.md5(F.col(html_col).cast("binary"))))
    small_batches(pages.sparkSession)
    with scratch(pages.sparkSession):
        found = staged(page_templates(keyed.select(F.col("__host").alias("host"), F.col("__page").alias("page"), F.col(html_col).alias("html"))), "templates", keep=True)
    # The table is written, so Spark knows its size and broadcasts it if it is small; else it joins by page.
    ready = keyed.join(found.select(F.col("host").alias("__host"), F.col("page").alias("__page"), F.col("hashes").alias("__hashes")), ["__host", "__page"], "left")
    names = [c for c in pages.columns if c != html_col]
    schema = T.StructType([*(f for f in pages.schema.fields if f.name != html_col), T.StructField(text_col, T.StringType())])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                out = [main_text(html, frozenset(hashes or ())) for html, hashes in zip(part.column(html_col).to_pylist(), part.column("__hashes").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(out, pa.string())], names=[*names, text_col])

    return ready.mapInArrow(texts, schema)


def op3_html_template(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))

"""Main text of web pages, with site template removal.

Pages are parsed into element trees. A first pass hashes element subtrees outside running text and
counts, per host, on how many pages each occurs (counts are added up in each task before they are
exchanged). A host's template are

- subtrees outside running text on at least ``min_pages`` pages and ``share`` of the host's pages;
- subtrees that recur beside different articles, wherever they stand: also lists, tables and short
  paragraphs inside an article. The longest block of a page's main text stands for its article. The
  bar is ``share`` of the host's pages, but 3 different articles at least and ``min_pages`` at most,
  and ``LOW_SHARE`` of the pages; it hardly rises with the host.

A second pass deletes them, and elements that are never main text (menus, page headers,
footers, sidebars, notices, adverts, forms, scripts, styles, reader comments) by name, role or class;
what remains of the article (else of main, else of body) is the text.

Headings, long paragraphs and inline elements inside an article are never template, nor is what holds
a page's longest block; blocks that recur only beside the same article are none by the second rule: so
copies of an article on a host keep their text. Different articles are counted by two bit masks, which
never count too many. A host's template has at most (subtrees of a page) / ``LOW_SHARE`` entries, so
its list is bounded. All lists together are sent to every executor only if they have at most
``SEND`` entries; else pages are joined to them by host.

Text: character references are decoded; white space inside a block becomes one space; blocks are
joined in page order by two newlines.

A page is a flat list of elements and texts in order, each element with the place where it ends; all
walks are loops over it, so elements may be nested to any depth.

Defined cases: null html gives the empty text; pages without a url (null, or without a host) are one
host; broken markup is read to its end; repeated rows each get a row; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrow, quiet, sized, written

SEND = 200_000
#: Hosts whose templates a task keeps.
HOSTS = 1000
# Fixed values of the second rule: least share of a host's pages, least number of different articles,
# most characters of a paragraph, elements of running text that may be template, and a mark on their hashes.
LOW_SHARE = 0.01
LEAST_ARTICLES = 3
SHORT = 200
RECURRING = frozenset("p ul ol dl table figure".split())
BESIDE = 0x5BD1E995_9E3779B9
# Element names of the HTML standard, by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
NEVER = frozenset(
    "script style noscript template head title nav menu aside footer form fieldset button select option textarea input label iframe object embed applet svg canvas audio video map dialog search noembed noframes xmp".split()
)
CONTENT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre b i em strong a span code sub sup small q cite mark u s br ul ol li dl dt dd table thead tbody tr td th figure figcaption img hgroup".split())
CLOSES_P = BLOCK - frozenset("body html head td th tr tbody thead tfoot li dt dd option optgroup legend summary figcaption".split())
LIKE = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "option": ({"option"}, {"select"})}
# Words in class and id names that mark what is no main text, and words that mark what is.
ASIDE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu menubar nav navbar navigation topnav breadcrumb breadcrumbs "
    "cookie cookies consent notice notices gdpr comment comments commentlist disqus respond newsletter subscribe signup share sharing social related recommended recommendations "
    "popup modal overlay footer header masthead toolbar pagination pager skip login search alert toast widget teaser outbrain taboola paywall".split()
)
MAIN = frozenset("article post entry content story main body title headline".split())
# Marks that hold even beside a word of MAIN.
MARKS = frozenset("comment comments sidebar related ad ads advert".split())
P = frozenset({"p"})
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""",
    re.S,
)
#: What may begin behind the last > of a page: it has no end there.
ENDLESS = re.compile(r"<!--|<!\[CDATA\[")
ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"']+)))?""")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
NAMES = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")


class Node:
    """An element. ``at`` is its place among the page's items, ``end`` the first place after its subtree."""

    __slots__ = ("tag", "raw", "at", "end", "mark", "_attributes", "_kind")

    def __init__(self, tag: str, raw: str, at: int):
        self.tag, self.raw, self.at, self.end = tag, raw, at, at + 1
        self.mark = self._attributes = self._kind = None

    def attributes(self) -> dict[str, str]:
        if self._attributes is None:
            self._attributes = {m[0].lower(): unescape(m[1] or m[2] or m[3]) for m in ATTRIBUTE.findall(self.raw)} if self.raw.strip(" /\n\t") else {}
        return self._attributes


class Page:
    """A page while it is read: its items (elements and texts) in order, the place of each one's parent,
    the open elements and how many of each name there are."""

    def __init__(self):
        root = Node("#root", "", 0)
        self.items: list[Node | str] = [root]
        self.parents = [0]
        self.stack, self.names = [root], Counter()

    def text(self, text: str) -> None:
        self.items.append(text)
        self.parents.append(self.stack[-1].at)

    def element(self, tag: str, raw: str, opens: bool) -> None:
        node = Node(tag, raw, len(self.items))
        self.items.append(node)
        self.parents.append(self.stack[-1].at)
        if opens:
            self.stack.append(node)
            self.names[tag] += 1

    def close(self, down_to: int) -> None:
        while len(self.stack) > down_to:
            node = self.stack.pop()
            node.end = len(self.items)
            self.names[node.tag] -= 1

    def innermost(self, names, barrier: frozenset | set = frozenset()) -> int:
        """Place on the stack of the innermost open element of these names, if no barrier is above it; else 0."""
        if any(self.names[x] for x in names):
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k].tag in names:
                    return k
                if self.stack[k].tag in barrier:
                    break
        return 0

    def implied(self, name: str) -> None:
        """Close the elements that the start of this one ends."""
        if name in LIKE and (k := self.innermost(*LIKE[name])):
            self.close(k)
        if name in CLOSES_P and (k := self.innermost(P, BLOCK)):
            self.close(k)


def parse(html: str) -> Page:
    page, at, n, lower = Page(), 0, len(html), None
    last = html.rfind(">") + 1  # no tag ends behind it, so none is looked for there: each search ends at a tag, or is the last
    while at < n:
        m = TOKEN.search(html, at, last) if at < last else None
        m = m or ENDLESS.search(html, max(at, last))
        if m is None:
            page.text(html[at:])
            break
        if m.start() > at:
            page.text(html[at : m.start()])
        at, whole = m.end(), m[0]
        if whole.startswith("<!--"):
            if not whole.endswith("-->") or len(whole) < 7:
                break  # a comment to the end of the page
            continue
        if whole.startswith("<![CDATA["):
            ended = whole.endswith("]]>") and len(whole) > 11
            page.text((whole[9:-3] if ended else html[m.start() + 9 :]).replace("&", "&amp;"))
            if not ended:
                break
            continue
        name = m[2] or m[5]
        if name is None:
            continue
        name = name.lower()
        if m[1] or m[4]:
            if k := page.innermost((name,)):
                page.close(k)
            continue
        page.implied(name)
        page.element(name, m[3] or m[6] or "", name not in VOID)
        if name in RAW:
            if lower is None:
                lower = html.lower() if len(html.lower()) == n else html
            end = lower.find(f"</{name}", at)
            end = n if end < 0 else end
            page.text(html[at:end])
            at = end
    page.close(0)
    return page


def kind(node: Node) -> int:
    """2: never main text; 1: only inside an article; 0: main text."""
    tag = node.tag
    if tag in NEVER:
        return 2
    own = int(tag == "header")
    if not node.raw:
        return own
    a = node.attributes()
    if "hidden" in a or a.get("aria-hidden") == "true" or HIDDEN.search(a.get("style", "")) or a.get("role", "").lower() in ROLES:
        return 2
    if tag in ("html", "body", "main") or not ("class" in a or "id" in a):
        return own
    words = {w.lower() for w in NAMES.split(f"{a.get('class', '')} {a.get('id', '')}") if w}
    found = words & ASIDE
    return 2 if found and (not words & MAIN or found & MARKS) else own


def aside(node: Node, inside: bool) -> bool:
    """Whether an element is never main text; inside: it lies in an article."""
    if node._kind is None:
        node._kind = kind(node)
    return node._kind == 2 or node._kind == 1 and not inside


def articles(page: Page, tags: set[str]) -> list[Node]:
    """The outermost elements of these kinds that are not set aside."""
    out, at, items = [], 1, page.items
    while at < len(items):
        item = items[at]
        at += 1
        if type(item) is Node:
            if aside(item, False):
                at = item.end
            elif item.tag in tags or "main" in tags and item.raw and (item.attributes().get("role") == "main" or item.attributes().get("itemprop") == "articleBody"):
                out.append(item)
                at = item.end
    return out


def main_of(page: Page) -> tuple[list[Node], bool]:
    """The elements that hold the main text, and whether the page itself marks them."""
    return next(((found, True) for tags in ({"article"}, {"main"}) if (found := articles(page, tags))), (articles(page, {"body"}) or [page.items[0]], False))


def hashed(page: Page) -> None:
    """Marks of all subtrees: hashes of names, attributes, texts with white space made even. It goes from
    the end of the page to its start, so an element's children are done before it."""
    below: dict[int, list[bytes]] = {}
    for at in range(len(page.items) - 1, -1, -1):
        item = page.items[at]
        if type(item) is Node:
            own = f"{item.tag} {' '.join(item.raw.split())}>".encode("utf-8", "surrogatepass")
            item.mark = xxhash.xxh3_64_intdigest(b"".join((own, *reversed(below.pop(at, ()))))) - (1 << 63)
            below.setdefault(page.parents[at], []).append(b"<" + item.mark.to_bytes(8, "little", signed=True))
        elif not item.isspace():
            below.setdefault(page.parents[at], []).append(" ".join(item.split()).encode("utf-8", "surrogatepass"))


@dataclass
class Outline:
    """Where a page's main text is: its elements, whether the page marks them, the places of all elements
    around them or the longest block, and that block's hash."""

    mains: list[Node]
    marked: bool
    holders: set[int]
    longest: set[int]
    article: int


def outline(page: Page, with_longest: bool = True) -> Outline:
    mains, marked = main_of(page)
    if not with_longest:
        return Outline(mains, marked, set(), set(), 0)
    items, own = page.items, {}
    for main in mains:
        at, blocks = main.at + 1, [main]
        while at < main.end:
            while at >= blocks[-1].end:
                blocks.pop()
            item = items[at]
            at += 1
            if type(item) is str:
                own.setdefault(blocks[-1].at, []).append(item)
            elif aside(item, marked):
                at = item.end
            elif item.tag in BLOCK:
                blocks.append(item)
    texts = {k: " ".join("".join(x).split()) for k, x in own.items()}
    best = max(texts, key=lambda k: len(texts[k]), default=0)
    article = xxhash.xxh3_64_intdigest(texts.get(best, "").encode("utf-8", "surrogatepass"))
    return Outline(mains, marked, above(page, [m.at for m in mains]), above(page, [best]), article)


def above(page: Page, places: list[int]) -> set[int]:
    """These places and those of all elements around them."""
    out: set[int] = set()
    for at in places:
        while at and at not in out:
            out.add(at)
            at = page.parents[at]
    return out


def short(page: Page, node: Node) -> bool:
    """Whether a subtree's text has at most ``SHORT`` characters."""
    n = 0
    for at in range(node.at + 1, node.end):
        if type(page.items[at]) is str:
            n += len(page.items[at])
            if n > SHORT:
                return False
    return True


def recurring(page: Page, node: Node, found: Outline) -> bool:
    """Whether an element may be template if it recurs beside different articles."""
    if node.at in found.longest or node.tag in CONTENT and node.tag not in RECURRING:
        return False
    return node.tag != "p" or short(page, node)


def candidates(page: Page) -> tuple[set[int], set[int], int]:
    """Hashes of the subtrees that may be template by the first rule (not what holds the article, nor its
    running text) and by the second, and the hash of the page's longest block."""
    hashed(page)
    found = outline(page)
    ends = {m.at: m.end for m in found.mains}
    first: set[int] = set()
    second: set[int] = set()
    inside = 0  # where the main element ends that the walk is in
    for at, item in enumerate(page.items):
        if type(item) is Node:
            if at not in found.holders and item.end > at + 1 and item.tag not in ("#root", "html", "body", "head"):
                within = at < inside
                if not (within and found.marked and item.tag in CONTENT):
                    first.add(item.mark)
                if within and recurring(page, item, found):
                    second.add(item.mark)
            inside = max(inside, ends.get(at, 0))
    return first, second, found.article


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/:?#]*)", url or "")
    return m[1].lower() if m else ""


def main_text(html: str | None, template: frozenset | set) -> str:
    page = parse(html or "")
    if template:
        hashed(page)
    found = outline(page, bool(template))
    blocks: list[str] = []
    held: list[str] = []

    def flush():
        if held:
            if text := " ".join("".join(held).split()):
                blocks.append(text)
            held.clear()

    def is_template(node: Node) -> bool:
        return node.mark in template and not (found.marked and node.tag in CONTENT) or node.mark ^ BESIDE in template and recurring(page, node, found)

    items = page.items
    for main in found.mains:
        at, ends = main.at + 1, []  # ends of the blocks that the walk is in
        while at < main.end:
            while ends and at >= ends[-1]:
                ends.pop()
                flush()
            item = items[at]
            at += 1
            if type(item) is str:
                held.append(unescape(item) if "&" in item else item)
            elif item.tag == "br":
                held.append("\n")
            elif template and is_template(item) or aside(item, found.marked):
                if item.tag in BLOCK:
                    flush()
                at = item.end
            elif item.tag in BLOCK:
                flush()
                ends.append(item.end)
        flush()
    return "\n\n".join(blocks)


def templates(pages: DataFrame, *, min_pages: int = 10, share: float = 0.2) -> DataFrame:
    """(host, template): per host the hashes of subtrees on many of its pages."""
    schema = pa.schema([("host", pa.string()), ("hash", pa.int64()), ("n", pa.int64()), ("k", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    @quiet
    def run(batches):
        counts: dict[tuple[str, int | None], list[int]] = {}

        def rows():
            for batch in batches:
                for url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    host = host_of(url)
                    first, second, article = candidates(parse(html or ""))
                    a, b = 1 << article % 63, 1 << article // 63 % 63
                    counts.setdefault((host, None), [0, 0, 0, 0])[0] += 1
                    for h in first:
                        counts.setdefault((host, h), [0, 0, 0, 0])[0] += 1
                    for h in second:
                        row = counts.setdefault((host, h), [0, 0, 0, 0])
                        row[1:] = row[1] + 1, row[2] | a, row[3] | b
                    if len(counts) > 100_000:
                        yield from done()
            yield from done()

        def done():
            got = list(counts.items())
            counts.clear()
            for (host, h), row in got:
                yield (host, h, *row), 48

        yield from sized(rows(), schema)

    counted = pages.select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "host string, hash long, n long, k long, a long, b long")
    # a host's number of pages (hash is null) stays with its frequent subtrees
    often = counted.groupBy("host", "hash").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.greatest(F.bit_count(F.bit_or("a")), F.bit_count(F.bit_or("b"))).alias("articles"))
    often = often.filter((F.col("n") >= min_pages) | (F.col("articles") >= LEAST_ARTICLES) | F.col("hash").isNull())
    total = often.filter("hash is null").select("host", F.col("n").alias("pages"))
    first = (F.col("n") >= min_pages) & (F.col("n") >= share * F.col("pages"))
    bar = F.least(F.lit(min_pages), F.greatest(F.lit(LEAST_ARTICLES), F.ceil(share * F.col("pages"))))
    second = (F.col("articles") >= bar) & (F.col("k") >= LOW_SHARE * F.col("pages"))
    both = F.array_compact(F.array(F.when(first, F.col("hash")), F.when(second, F.col("hash").bitwiseXOR(F.lit(BESIDE)))))
    return often.filter("hash is not null").join(total, "host").filter(first | second).groupBy("host").agg(F.flatten(F.collect_list(both)).alias("template"))


def extract(pages: DataFrame, *, min_pages: int = 10, share: float = 0.2) -> DataFrame:
    """page_id, url, text of every page (page_id, url, html)."""
    narrow(pages.sparkSession)
    found, _ = written(templates(pages, min_pages=min_pages, share=share), "site-templates")
    few = (found.agg(F.sum(F.size("template")).alias("n")).first().n or 0) <= SEND
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    @quiet
    def run(batches):
        known: dict[str, frozenset] = {}

        def template(host: str, batch: pa.RecordBatch, k: int) -> frozenset:
            if host not in known:
                if len(known) >= HOSTS:
                    known.clear()
                known[host] = frozenset(batch.column(4)[k].as_py() or ())
            return known[host]

        for batch in batches:
            rows = enumerate(zip(*(c.to_pylist() for c in batch.columns[:4])))
            yield from sized((((page, url, text := main_text(html, template(host, batch, k))), len(text)) for k, (page, url, html, host) in rows), schema)

    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/:?#]*)", 1))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))
    joined = base.join(F.broadcast(found) if few else found, "host", "left")
    return joined.select("page_id", "url", "html", "host", "template").mapInArrow(run, "page_id long, url string, text string")

"""HTML extraction by consensus host paths.

Pass 1 names each page's best container, the innermost one that leaves no text of the article outside, by its generalised
path: tags with their classes, digits replaced.  The paths are voted on per host in Spark.  Pass 2 extracts every page again, from the
elements on the best-voted path that the page has, and from its own best container where it has none of them.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_of, rows_of, written

TOP_PATHS = 3
MOST_SOFT = 64  # open inline elements followed at once
MOST_HOSTS = 10_000  # hosts up to which their paths (TOP_PATHS strings each) are broadcast

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/>]|$)""", re.I)
_SPACE, _DIGITS, _CAMEL = re.compile(r"\s+"), re.compile(r"\d+"), re.compile(r"(?<=[a-z])(?=[A-Z])")

RAW = frozenset("script style textarea title template noscript iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOISE_TAGS = frozenset("nav footer aside form button select option label fieldset menu dialog svg canvas audio video object head".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code del dfn em font i img ins kbd mark q s samp small span strike strong "
                   "sub sup time tt u var wbr ruby rb rt rp data".split())
CONTAINERS = frozenset("body main article section div td center".split())
LAYOUT = CONTAINERS | frozenset("table tbody tr".split())  # what may stand around an article; paragraphs, lists and the like are its parts
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ADVERTS = frozenset("p figure blockquote".split())  # besides containers
#: Words of class, id and role that mark what isn't the article.
NOISE_WORDS = frozenset("nav navbar navigation menu menubar sidebar aside footer header masthead topbar breadcrumb breadcrumbs cookie cookies "
                        "consent gdpr notice notices alert banner ad ads advert adverts advertisement advertising sponsor sponsored "
                        "promo promotion social share sharing related recommended comment comments commentlist disqus reply replies respond "
                        "newsletter subscribe subscription signup login popup modal overlay widget widgets pagination pager toolbar "
                        "complementary contentinfo search searchbox skip copyright".split())
#: Those of them that name a place on the page, as the classes of wrappers around everything often do.
PLACE_WORDS = frozenset("nav navbar navigation menu menubar sidebar aside footer header masthead topbar banner notice notices alert widget "
                        "widgets toolbar search overlay".split())
#: What names the article, unless a noise word stands beside it: a related post is no post.
TEXT_HEADS = frozenset("article articlebody entry post hentry story".split())
#: Words of layout: the word before them says what the element is.  Alone, those of TEXT_PLACES name the article.
TEXT_PLACES = frozenset("content main body text".split())
LAYOUT_WORDS = TEXT_PLACES | frozenset("box block list wrapper wrap container area section panel inner outer item items bar links link group row col column "
                                       "left right top bottom fixed sticky slot unit zone title label form info".split())
#: What lists beside an article hold.
LISTED = frozenset("articles posts stories entries news videos products topics reading reads".split())
#: Adverts, which may stand between the paragraphs of an article.
AD_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion".split())
#: What cancels the word before it.
CANCELS = frozenset("free less".split())
#: What follows one of these words in a class says how the element looks, not what it is: with-sidebar, no-comments.
MODIFIERS = frozenset("with without no not non has have".split())
#: GONE: noise by its tag or hidden, NOISE: by its words, PLACE: by words for places only, DOUBT: a noise word beside words that say something else.
PLAIN, NOISE, PLACE, DOUBT, GONE = range(5)
#: Start tags that end an open element of the listed tags.
CLOSES = {"li": ("li",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}


class Element:
    __slots__ = ("tag", "name", "level", "marked", "advert", "noise", "parent", "chars", "linked", "children", "blocks")

    def __init__(self, tag, name, level, marked, advert, parent):
        self.tag, self.name, self.level, self.marked, self.advert, self.parent = tag, name, level, marked, advert, parent
        self.noise = False  # whether its text is left out; known when the page is read
        self.chars = self.linked = 0
        self.children: list[Element] = []
        self.blocks = [0, 0]  # the range of the page's blocks inside

    @property
    def path(self) -> str:
        """The generalised names from the page's root down."""
        names, e = [], self
        while e.parent is not None:
            names.append(e.name)
            e = e.parent
        return "/".join(["", *reversed(names)])


@lru_cache(1 << 14)
def _meaning(token: str) -> tuple[int, bool, frozenset]:
    """(PLAIN, NOISE or DOUBT, whether a class, id or role names the article, its noise words).

    Its last word that isn't one of layout decides: post-comments and comment-body are comments, a recommended-dose is
    a dose.  A noise word beside a word for the article is noise, but an entry-header belongs to the entry.
    """
    words = [w for w in re.split(r"[^a-z]+", token) if w]
    words = words[:next((i for i, w in enumerate(words) if w in MODIFIERS), None)]
    words = [w for i, w in enumerate(words) if w not in CANCELS and (i + 1 == len(words) or words[i + 1] not in CANCELS)]
    noise = NOISE_WORDS.intersection(words)
    named = any(w in TEXT_HEADS or w in TEXT_PLACES for w in words)
    if not noise or named and words[-1] == "header" and noise == {"header"}:
        return PLAIN, named, frozenset()
    heads = [w for w in words if w not in LAYOUT_WORDS]
    return NOISE if heads[-1] in noise or heads[-1] in TEXT_HEADS or heads[-1] in LISTED else DOUBT, False, noise


def _describe(tag: str, attributes: str) -> tuple[str, int, bool, bool]:
    """(generalised name, how far what is inside is no part of an article, whether it names the article, whether it names an advert)."""
    gone, marked, doubt, words, classes = tag in NOISE_TAGS, False, False, set(), []
    if attributes.strip():
        for m in _ATTR.finditer(attributes):
            name, said = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")
            value = said.lower()
            if name in ("class", "id", "role"):
                for token in said.split():
                    level, own, noise = _meaning(_CAMEL.sub("-", token).lower())
                    marked, doubt = marked or own, doubt or level == DOUBT
                    if level == NOISE:
                        words |= noise
                if name == "class":
                    classes += sorted(_DIGITS.sub("0", c) for c in value.split())
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                gone = True
    if tag in HEADINGS:
        words.discard("header")
    if tag in ("body", "html"):
        level = PLAIN
    elif gone:
        level = GONE
    elif marked and (tag in CONTAINERS or tag == "header") or not words and not doubt:
        level = PLAIN
    else:
        level = DOUBT if not words else PLACE if words <= PLACE_WORDS else NOISE
    return ".".join([tag, *classes]).replace("/", "|"), level, marked, bool(words & AD_WORDS)


def _settle(order: list[Element], found: list[tuple[Element, str, int]]) -> list[str]:
    """Decide which elements are noise, count the text of the others and return their blocks.

    Words are one vote, structure the other.  A container that is noise by its words is kept if it holds most of the page's text
    outside of links; where its words say more than its place, only if the page's named articles hold little beside it.
    Paragraphs, headings, lists and the like inside of an article are left out only if they are mostly links, or a
    small advert.  A doubtful element is left out only if it is mostly links.
    """
    chars, links = dict.fromkeys(order, 0), dict.fromkeys(order, 0)
    for e, text, linked in found:
        chars[e] += len(text)
        links[e] += linked
    own = {e: chars[e] - links[e] for e in order}
    for e in reversed(order):
        if e.parent is not None:
            chars[e.parent] += chars[e]
            links[e.parent] += links[e]
    weights = {e: chars[e] - links[e] for e in order}
    total, named = weights[order[0]], 0
    big = {e for e in order if e.level in (NOISE, PLACE) and (e.tag in LAYOUT or e.tag == "header") and 2 * weights[e] > total}
    article: dict[Element, Element | None] = {}  # the named article that an element is or lies in

    def kept(e: Element) -> bool:
        if e.parent is not None and e.parent.noise or e.level == GONE:
            return False
        if e.level == PLAIN:
            return True
        if e in big:
            return e.level == PLACE or 10 * named < weights[e]
        if e.level == DOUBT:
            return not links[e] or not mostly_links(chars[e], links[e])
        inside = article.get(e.parent)
        if inside is None or e.tag in LAYOUT or e.tag == "header":
            return False
        return not (links[e] and mostly_links(chars[e], links[e])) and not (e.advert and e.tag in ADVERTS and 5 * chars[e] < chars[inside])

    for final in (False, True) if big else (True,):  # first: how much text the named articles hold
        for e in order:
            e.noise = not kept(e) if final or e not in big else e.level != PLACE
            above = article.get(e.parent)
            article[e] = None if e.noise else above if above is not None else e if e.marked or e.tag in ("article", "main") else None
            if not final and article[e] is not None:
                named += own[e]
    blocks, before = [], [0]
    for e, text, linked in found:
        if not e.noise:
            blocks.append(text)
            e.chars += len(text)
            e.linked += linked
        before.append(len(blocks))
    for e in reversed(order):
        e.blocks = [before[e.blocks[0]], before[e.blocks[1]]]
        if e.parent is not None:
            e.parent.chars += e.chars
            e.parent.linked += e.linked
    return blocks


HIDDEN, ADVERT = "hidden", "advert"


def parse(page: str) -> tuple[Element, list[str]]:
    """(root, blocks): the element tree with the text sizes of its containers, and the page's blocks outside of noise.

    Inline elements are a part of their sentence whatever their class says; the text of hidden ones is left out, and a
    block that holds nothing but inline adverts.
    """
    root = Element("html", "", PLAIN, False, False, None)
    node, stack, order, found, run = root, [root], [root], [], []  # run: pieces of text of the block being read
    links, opened, soft = 0, Counter(), []  # soft: open inline elements that are hidden or adverts, or lie in one, with the depth they stand at

    def close_block():
        if run:
            text = _SPACE.sub(" ", html.unescape("".join(x for x, _, _ in run))).strip()
            if text and not all(advert for x, _, advert in run if x.strip()):
                found.append((node, text, min(len(text), sum(len(x) for x, in_link, _ in run if in_link))))
            run.clear()

    def pop():
        nonlocal node
        close_block()
        e = stack.pop()
        e.blocks[1] = len(found)
        opened[e.tag] -= 1
        node = stack[-1]
        while soft and soft[-1][2] > len(stack):
            soft.pop()

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        upto = m.start() if m else end
        if upto > at and node.level != GONE and not any(kind == HIDDEN for _, kind, _ in soft):
            run.append((page[at:upto], links > 0, any(kind == ADVERT for _, kind, _ in soft)))
        if not m:
            break
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:  # an end tag
            if tag == "a":
                links = 0
            if tag in INLINE or tag in VOID:
                inner = next((i for i in range(len(soft) - 1, -1, -1) if soft[i][0] == tag), None)
                if inner is not None:
                    del soft[inner:]
            elif opened[tag]:
                while stack[-1].tag != tag:
                    pop()
                pop()
                links = 0
            else:
                close_block()
            continue
        if tag in RAW and not m[3].endswith("/"):
            close = re.compile(f"</{tag}", re.I | re.A).search(page, at)
            stop = page.find(">", close.end()) if close else -1
            at = stop + 1 if stop >= 0 else end
            continue
        if tag == "br":
            if run:
                run.append((" ", False, False))
            continue
        if tag in INLINE:
            if tag == "a":
                links = 1
            if tag in VOID or m[3].endswith("/"):
                continue
            _, level, _, advert = _describe(tag, m[3]) if "=" in m[3] or "hidden" in m[3].lower() else ("", PLAIN, False, False)
            kind = HIDDEN if level == GONE else ADVERT if advert else None
            if (kind or any(t == tag for t, _, _ in soft)) and len(soft) < MOST_SOFT:
                soft.append((tag, kind, len(stack)))
            continue
        if tag in VOID or m[3].endswith("/"):
            close_block()
            continue
        if tag == "html":
            continue
        close_block()
        ends = CLOSES.get(tag)
        if ends:  # list items and cells end their own kind
            scope = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag in ("ul", "ol", "table", "dl", "body", "select")), 0)
            first = next((i for i in range(scope + 1, len(stack)) if stack[i].tag in ends), None)
            if first is not None:
                while len(stack) > first:
                    pop()
        if node.tag == "p":  # a block ends an open paragraph
            pop()
        name, level, marked, advert = _describe(tag, m[3])
        child = Element(tag, name, GONE if node.level == GONE else level, marked, advert, node)
        child.blocks = [len(found), len(found)]
        node.children.append(child)
        order.append(child)
        stack.append(child)
        opened[tag] += 1
        node = child
    while len(stack) > 1:
        pop()
    close_block()
    root.blocks[1] = len(found)
    return root, _settle(order, found)


def mostly_links(chars: int, linked: int) -> bool:
    return chars <= 1.25 * linked


def inside(e: Element, tags: frozenset, unlinked: bool = False) -> bool:
    """Whether the element is or holds one of ``tags`` with text (outside of links)."""
    stack = [e]
    while stack:
        x = stack.pop()
        if x.tag in tags and x.chars > (x.linked if unlinked else 0):
            return True
        stack += x.children
    return False


def left_out(e: Element, inner: Element) -> bool:
    """Whether the article loses nothing if ``inner`` is kept without its sibling ``e``: noise, a list of links, a page header."""
    if not e.chars:
        return True
    if mostly_links(e.chars, e.linked):  # a linked headline is no list
        return not inside(e, HEADINGS) or e.blocks[1] - e.blocks[0] > 2 and not inside(e, frozenset(["h1"]))
    return (e.tag == "header" and not (e.marked or e.parent.marked or e.parent.tag == "section")
            and (not inside(e, frozenset(["h1"]), True) or inside(inner, frozenset(["h1"]))))


def best(root: Element) -> Element:
    """The innermost container outside of which the page has only noise, link lists and its header; an article or main is not entered."""
    node = root
    while node.tag not in ("article", "main"):
        child = max((c for c in node.children if c.tag in LAYOUT), key=lambda c: c.chars - c.linked, default=None)
        if child is None or child.chars <= child.linked:
            return node
        own, own_linked = (getattr(node, k) - sum(getattr(c, k) for c in node.children) for k in ("chars", "linked"))
        if not mostly_links(own, own_linked) or not all(c is child or left_out(c, child) for c in node.children):
            return node
        node = child
    return node


def elements(root: Element, path: str) -> list[Element]:
    """The outermost elements on a generalised path, in page order."""
    names, found, stack = path.split("/")[1:], [], [(root, 0)]
    while stack:
        e, depth = stack.pop()
        if depth == len(names):
            if not e.noise:
                found.append(e)
        else:
            stack.extend((c, depth + 1) for c in reversed(e.children) if c.name == names[depth])
    return found


def extract(page: str, paths: list[str] | None) -> str:
    """The main text of a page by the first of the host's paths on which it has text, else by its own best container."""
    root, blocks = parse(page)
    for path in paths or []:
        text = "\n".join(b for e in elements(root, path) for b in blocks[slice(*e.blocks)])
        if text:
            return text
    return "\n".join(blocks[slice(*best(root).blocks)])


def page_votes(pages: DataFrame) -> DataFrame:
    """(host, path, chars): the path of each page's best container."""
    def run(batches):
        def out():
            for host, page in rows_of(batches, "host", "html"):
                root, _ = parse(page)
                found = best(root)
                if found.parent is not None and found.chars:
                    yield host, found.path, found.chars

        return batches_of(out(), pa.schema([("host", pa.string()), ("path", pa.string()), ("chars", pa.int64())]))

    return pages.mapInArrow(run, "host string, path string, chars long")


def extract_pages(pages: DataFrame, top_paths: int = TOP_PATHS, most_hosts: int = MOST_HOSTS) -> DataFrame:
    """page_id, url, text of every row of ``pages``.

    A null html is empty and gives an empty text; a null url belongs to the host ""; rows that repeat vote and are
    extracted one by one; an empty table gives an empty result; other columns are not read.
    """
    base = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"),
                        F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))).alias("host"))
    votes = page_votes(base.select("host", "html")).groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum("chars").alias("chars"))
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("votes"), F.desc("chars"), "path"))
    won = (votes.withColumn("rank", rank).where(F.col("rank") <= top_paths).groupBy("host")
           .agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]).alias("paths")))
    won = written(won, "host-paths")
    joined = base.join(F.broadcast(won) if won.count() <= most_hosts else won, "host", "left")

    def run(batches):
        def out():
            for page_id, url, page, paths in rows_of(batches, "page_id", "url", "html", "paths"):
                yield page_id, url, extract(page, paths)

        return batches_of(out(), pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())]), 1000)

    return joined.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "paths").mapInArrow(run, "page_id long, url string, text string")

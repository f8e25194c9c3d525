"""Main text of web pages by site template removal.

Every page is parsed once, to a small tree, and the subtree of every element with text is hashed. Spark
counts on how many pages of its host a subtree occurs; those that recur on many are the site's template
and are deleted. What is left of the article, or of the page where it marks none, is joined block by
block. Names of elements and classes only settle what recurrence can't: a menu that is on one page, an
advert that differs from page to page. Within a marked article no heading, section or paragraph goes by
its class or id, and a subtree goes as template only if it is on a large share of the host's pages.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornfold.llm.common import Run

#: A subtree is template if it occurs on so many pages of its host and so large a share of them, or on enough pages
#: whatever the host's size.
LEAST_PAGES = 8
LEAST_SHARE = 0.02
ENOUGH_PAGES = 20
#: The share of the host's pages for a subtree within a marked article that isn't made of links: passages may recur.
ARTICLE_SHARE = 0.2
SLICE = 256

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|</(?P<end>[a-zA-Z][^\s/>]*+)[^>]*+>"
    r"|<(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<broken>[a-zA-Z][^\s/>]*+)[^>]*+>",
    re.S,
)
ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg".split())
# Without an end tag these take the rest of the page; other raw ones are left out alone.
TO_END = frozenset({"script", "style"})
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot "
    "thead tr ul caption".split()
)
ENDS_P = BLOCK - {"body", "html", "tr", "tbody", "tfoot", "thead", "caption", "dd", "dt", "li"}
#: A start tag ends these if they are open above the given container.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
# Never part of an article.
NOT_TEXT = frozenset(
    "head nav footer aside form button select datalist input textarea object canvas audio video dialog menu search".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
NOT_MAIN = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?\w*|consent|gdpr|notices?|alerts?|popup|"
    r"modal|overlay|newsletter|subscribe|signup|login|comments?|commentlist|disqus|replies|respond|sidebar|widget\w*|"
    r"menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|toolbar|pagination|pager|share|sharing|social|related|"
    r"recommended|recirc|outbrain|taboola|skip|search)(?:$|[\s_-])",
    re.I,
)
#: In a marked article an element of these names goes if one of its classes is one of these words.
BOXES = frozenset("div aside ul ol dl figure table span ins center".split())
BOX_CLASSES = frozenset(
    "ad ads advert adverts advertisement adsense sponsored sponsor promo promotion newsletter subscribe signup comments "
    "comment commentlist disqus replies respond sidebar widget widgets menu nav navbar breadcrumb breadcrumbs footer toolbar "
    "pagination pager share sharing social related recommended outbrain taboola popup modal cookie cookies banner notice".split()
)
COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|disqus|replies|respond)(?:$|[\s_-])", re.I)
#: An element whose class says it is beside the main text is a wrapper of it if it holds over so much of the page's
#: text outside links; one of comments only if next to nothing is elsewhere.
WRAPS, WRAPS_COMMENTS = 0.5, 0.9
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("tag", "attrs", "kids", "hash", "links", "chars", "number")

    def __init__(self, tag: str, attrs: str):
        self.tag, self.attrs = tag, attrs
        self.kids: list[Node | str] = []
        self.hash = self.links = self.chars = 0
        self.number = -1


def parse(page: str) -> Node:
    """The element tree of a page, forgiving unclosed and stray tags. Scripts, styles and the like are left out."""
    root = Node("", "")
    stack, at = [root], 0
    unclosed: set[str] = set()
    opened: Counter[str] = Counter()  # so that the stack is only searched for what is on it

    def close(names: set[str] | frozenset[str], limits: set[str] | frozenset[str]) -> None:
        """End the lowest open element of ``names``, and all within it, unless one of ``limits`` lies between."""
        if not any(opened[name] for name in names):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                opened.subtract(node.tag for node in stack[i:])
                del stack[i:]
                return
            if stack[i].tag in limits:
                return

    last = page.rfind(">") + 1  # no tag ends after it, so none is looked for
    while found := TOKEN.search(page, at, max(last, at)):
        if found.start() > at:
            stack[-1].kids.append(page[at : found.start()])
        at = found.end()
        if tag := found["tag"] or found["broken"]:
            tag = tag.lower()
            attrs = found["attrs"] or ""
            if tag in RAW:
                if tag not in unclosed and not (tag == "svg" and attrs.endswith("/")):
                    if end := re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at):
                        at = end.end()
                    elif tag in TO_END:
                        at = len(page)
                    else:
                        unclosed.add(tag)
                continue
            if tag in ENDS_P:
                close({"p"}, {"table", "td", "th", "button", "object"})
            if tag in IMPLIED:
                close(*IMPLIED[tag])
            node = Node(tag, attrs)
            stack[-1].kids.append(node)
            if tag not in VOID and not (tag == "math" and attrs.endswith("/")):
                stack.append(node)
                opened[tag] += 1
        elif tag := found["end"]:
            close({tag.lower()}, frozenset())
    if at < len(page):
        stack[-1].kids.append(page[at:])
    return root


def measure(root: Node) -> list[Node]:
    """Hash every subtree and count its characters and those in links; the nodes, children first."""
    order, open_ = [], [root]
    while open_:  # an explicit stack: pages can nest deeper than Python recurses
        node = open_.pop()
        order.append(node)
        open_ += [k for k in node.kids if not isinstance(k, str)]
    order.reverse()
    for node in order:
        parts = [node.tag, " ".join(node.attrs.split())]
        for kid in node.kids:
            if isinstance(kid, str):
                if text := " ".join(kid.split()):
                    parts.append(text)
                    node.chars += len(text)
            else:
                parts.append(f"\0{kid.hash}")
                node.chars += kid.chars
                node.links += kid.links
        if node.tag == "a":
            node.links = node.chars
        node.hash = xxhash.xxh64_intdigest("\1".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)
    return order


def attributes(node: Node) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(node.attrs)}


def is_shown(attrs: dict[str, str]) -> bool:
    """Is an element with these attributes neither hidden nor of a role beside the main text?"""
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or HIDDEN.search(attrs.get("style", "")):
        return False
    return attrs.get("role", "").lower() not in ROLES


def named(node: Node, attrs: dict[str, str], pattern: re.Pattern[str]) -> bool:
    """Does the class or id of this element match?"""
    if node.tag in ("html", "body", "article", "main"):
        return False
    return any(pattern.search(attrs.get(name, "")) for name in ("class", "id"))


def wraps(node: Node, root: Node, share: float) -> bool:
    return node.chars - node.links > share * (root.chars - root.links)


def is_main(node: Node, in_article: bool, root: Node, names: bool) -> bool:
    """Can this element, by its name and attributes, be part of the main text?"""
    if node.tag in NOT_TEXT or (node.tag == "header" and not in_article):
        return False
    if not node.attrs.strip():
        return True
    attrs = attributes(node)
    if not is_shown(attrs):
        return False
    if in_article:
        in_box = node.tag in BOXES and not BOX_CLASSES.isdisjoint(attrs.get("class", "").lower().split())
        return not (names and (in_box or is_thread(node, attrs))) or wraps(node, root, WRAPS)
    if not names or not named(node, attrs, NOT_MAIN):
        return True
    return wraps(node, root, WRAPS_COMMENTS if named(node, attrs, COMMENTS) else WRAPS)


def is_thread(node: Node, attrs: dict[str, str]) -> bool:
    """Are these, whatever the element, the reader comments of a page?"""
    if node.tag not in ("section", *BOXES):
        return False
    words = {attrs.get("id", "").lower(), *attrs.get("class", "").lower().split()}
    return not words.isdisjoint({"comments", "commentlist", "comment-list", "disqus_thread", "disqus", "respond"})


def regions(root: Node, names: bool) -> tuple[list[Node], bool]:
    """The outermost articles, else main elements, else the whole page; and whether the page marks them.

    They are looked for in elements of any class but those of comments. Where the class names something
    beside the main text, they count if they have at least half the text of the largest one, and of what
    stands outside articles and such elements: teasers in a box of related pages don't, an article in a
    wrapper named after its sidebar does.
    """
    for wanted in ("article", "main"):
        found: list[tuple[Node, bool]] = []
        loose, open_ = 0, [(root, False, False)]
        while open_:
            node, beside, linked = open_.pop()
            if node.tag == wanted and node.chars:
                found.append((node, beside))
                continue
            if node is not root:
                attrs = attributes(node)
                if (node.tag in NOT_TEXT and node.tag != "form") or not is_shown(attrs):
                    continue
                if names and named(node, attrs, COMMENTS) and not wraps(node, root, WRAPS_COMMENTS):
                    continue
                beside = beside or (names and named(node, attrs, NOT_MAIN) and not wraps(node, root, WRAPS))
                linked = linked or node.tag == "a"
            if not beside and not linked:
                loose += sum(len(" ".join(k.split())) for k in node.kids if isinstance(k, str))
            open_ += [(k, beside, linked) for k in reversed(node.kids) if not isinstance(k, str)]
        most = max([loose, *(node.chars - node.links for node, _ in found)])
        if main := [node for node, beside in found if not beside or 2 * (node.chars - node.links) >= most]:
            return main, True
    return [root], False


#: How a subtree may go as template: not at all, by recurrence, or in a marked article by a large share. One
#: without a block of the text is counted like any other, but there is nothing to delete.
KEPT, RECURS, RECURS_WIDELY, BESIDE = range(4)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def removal(node: Node, in_article: bool) -> int:
    if not node.chars or node.tag in ("", "html", "body", "article", "main"):
        return KEPT
    if not in_article or 2 * node.links >= node.chars:
        return RECURS
    return RECURS_WIDELY if node.tag in BLOCK and node.tag not in HEADINGS else KEPT


@dataclass
class Page:
    """The subtrees of a page that may be template, and its text blocks.

    Subtree i has ``hashes[i]``, ``removals[i]`` and the next one around it ``parents[i]`` (-1: none), which
    comes before it. A block is its text and the innermost subtree around it.
    """

    hashes: list[int]
    removals: list[int]
    parents: list[int]
    blocks: list[tuple[str, int]]


def blocks(page: str | None, names: bool = True) -> Page:
    """``names=False`` leaves classes and ids out of account, so only recurrence and element names count."""
    root = parse(page or "")
    measure(root)
    places, marked = regions(root, names)
    found = Page([], [], [], [])
    inside = set(map(id, places)) if marked else set()
    subtrees = [(root, -1, False)]
    while subtrees:  # an explicit stack: pages can nest deeper than Python recurses
        node, around, in_article = subtrees.pop()
        in_article = in_article or id(node) in inside
        if how := removal(node, in_article):
            found.hashes.append(node.hash)
            found.removals.append(how)
            found.parents.append(around)
            around = len(found.hashes) - 1
        node.number = around
        subtrees += [(k, around, in_article) for k in reversed(node.kids) if not isinstance(k, str)]
    words: list[str] = []
    for place in places:
        # Entries: (node or text or None for the end of a block, the subtree around it).
        open_: list[tuple[Node | str | None, int]] = [(place, -1)]
        while open_:
            item, around = open_.pop()
            if item is None:
                if text := " ".join(html.unescape("".join(words)).split()):
                    found.blocks.append((text, around))
                words = []
            elif isinstance(item, str):
                words.append(item)
            elif item.tag in ("br", "td", "th", "img", "wbr"):
                words.append(" " if item.tag != "wbr" else "")
                open_ += [(kid, item.number) for kid in reversed(item.kids)]
            elif item is place or is_main(item, marked, root, names):
                edge = item.tag in BLOCK or item is place
                if edge:
                    open_.append((None, item.number))
                open_ += [(kid, item.number) for kid in reversed(item.kids)]
                if edge:
                    open_.append((None, around))
    covers = [False] * len(found.hashes)
    for _, around in found.blocks:
        while around >= 0 and not covers[around]:
            covers[around] = True
            around = found.parents[around]
    found.removals = [how if covered else BESIDE for how, covered in zip(found.removals, covers, strict=True)]
    return found


def left_over(page: Page, gone: set[int]) -> list[str]:
    """The blocks that aren't within a subtree whose hash is ``gone``."""
    dead: list[bool] = []
    for value, parent in zip(page.hashes, page.parents, strict=True):
        dead.append((parent >= 0 and dead[parent]) or value in gone)
    return [text for text, around in page.blocks if around < 0 or not dead[around]]


def host(url: str | None) -> str:
    found = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return found[1].lower() if found else ""


NUMBERS = pa.list_(pa.int64())
BLOCKS = pa.list_(pa.struct([("text", pa.string()), ("around", pa.int64())]))
PARSED = "hashes array<long>, removals array<long>, parents array<long>, blocks array<struct<text: string, around: long>>"


def parsed(pages: DataFrame, names: bool) -> DataFrame:
    """page_id, url, host, and what ``blocks`` finds in every row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = ["page_id", "url", "host", "hashes", "removals", "parents", "blocks"]
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                found = [blocks(page.as_py(), names) for page in part.column(2)]
                columns = [part.column(0), part.column(1), pa.array([host(u.as_py()) for u in part.column(1)], pa.string())]
                columns += [pa.array([getattr(page, field) for page in found], NUMBERS) for field in fields[3:6]]
                texts = [[{"text": text, "around": around} for text, around in page.blocks] for page in found]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, BLOCKS)], names=fields)

    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", "url", "html")
    return rows.mapInArrow(of, f"page_id {kind}, url string, host string, {PARSED}")


def template(
    run: Run, rows: DataFrame, least_pages: int, least_share: float, enough_pages: int, article_share: float
) -> DataFrame:
    """page_id and ``gone``, the hashes of its subtrees that recur on its host.

    The recurring subtrees and the pages that lose some are written, so Spark knows their sizes: it
    broadcasts them while they are below its threshold, and else shuffles.
    """
    of_host = F.xxhash64("host").alias("site")
    sizes = rows.groupBy(of_host).agg(F.count("*").alias("pages"))
    # Counted in each task before the shuffle, so a hot host is a few rows for each of its subtrees.
    counted = rows.select(of_host, F.explode(F.array_distinct("hashes")).alias("hashes")).groupBy("site", "hashes")
    recurring = (
        counted.agg(F.count("*").alias("n"))
        .where(F.col("n") >= least_pages)
        .join(sizes, "site")
        .where((F.col("n") >= least_share * F.col("pages")) | (F.col("n") >= enough_pages))
        .select("site", "hashes", (F.col("n") >= article_share * F.col("pages")).alias("widely"))
    )
    recurring = run.table(recurring, "recurring")
    pairs = F.array_distinct(F.filter(F.arrays_zip("hashes", "removals"), lambda s: s["removals"] != BESIDE))
    found = rows.select("page_id", of_host, F.explode(pairs).alias("subtree"))
    found = found.select("page_id", "site", "subtree.hashes", "subtree.removals").join(recurring, ["site", "hashes"])
    # A page's own subtrees bound each list.
    gone = found.where((F.col("removals") == RECURS) | F.col("widely")).groupBy("page_id").agg(F.collect_set("hashes").alias("gone"))
    return run.table(gone, "gone")


def remaining(rows: DataFrame) -> DataFrame:
    """page_id, url and text of parsed rows with ``gone``."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for hashes, parents, found, gone in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
                page = Page(hashes, [], parents, [(b["text"], b["around"]) for b in found])
                texts.append("\n\n".join(left_over(page, set(gone or ()))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.select("page_id", "url", "hashes", "parents", "blocks", "gone").mapInArrow(
        of, f"page_id {kind}, url string, text string"
    )


def main_text(
    pages: DataFrame,
    least_pages: int = LEAST_PAGES,
    least_share: float = LEAST_SHARE,
    enough_pages: int = ENOUGH_PAGES,
    article_share: float = ARTICLE_SHARE,
    names: bool = True,
) -> DataFrame:
    """Per row of ``pages``: page_id, url, text, n_chars.

    Blocks are joined in page order by two line feeds; white space within one is one space. Null and
    empty pages give an empty text, a null or odd url belongs to the host "". Rows that share a
    page_id lose the template subtrees of any of them. An empty table gives an empty result. Columns
    beside page_id, url and html are not looked at. Time and memory for a page grow in proportion to it,
    however deep it nests.
    """
    run = Run(pages.sparkSession, "html")
    rows = run.table(parsed(pages, names), "parsed")
    gone = template(run, rows, least_pages, least_share, enough_pages, article_share).withColumnRenamed("page_id", "__page")
    joined = rows.join(gone, rows["page_id"].eqNullSafe(gone["__page"]), "left")
    return remaining(joined).withColumn("n_chars", F.char_length("text").cast("long"))

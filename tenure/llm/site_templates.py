"""Main text of web pages by removal of site templates.

Every element subtree of a page is hashed; Spark counts on how many different pages of its
host each subtree occurs. Subtrees that recur across many pages of the host are template
and are deleted, together with elements that are never content (scripts, styles, menus,
forms, adverts, comments of readers). Where a page declares an article or main part, the
rest of the page goes as well (all articles and main parts are kept, also beside each other).
Inside an article, the words of class names decide nothing but whether a box is a list of
comments or an advert; only boxes (divisions, sections, lists, tables) are deleted for
recurring, and only when most articles of the host have them: a paragraph that several
articles share is still text. Copies of one article count once.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Container, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.llm.common import col, extended, others
from tenure.session import stage

#: A subtree is template when it occurs on so many different pages of its host, and on this
#: share of them; a box inside an article on the larger share.
LEAST_PAGES, LEAST_SHARE, LEAST_SHARE_INSIDE = 5, 0.2, 0.5
PRODUCED = ("main_text", "n_chars")

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe canvas".split())
SKIP = RAW | set("svg head nav header footer aside form button select option dialog menu figure-ad".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr object svg".split())
INLINE |= set(
    "math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup "
    "mtable mtd mtext mtr munder munderover none semantics annotation annotation-xml".split()
)
FOREIGN = {"svg", "math"}
MAIN = set("article main".split())
BOXES = set("div section ul ol dl table figure details".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements whose class names can mark a part of a declared main part.
NAMED = BOXES | {"li", "center", "article"}
MAIN_ROLES = set("main article".split())
SKIP_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
# Whole words of class and id values that mark parts which are not content. LAYOUT words
# also stand on wrappers ("with-sidebar"): a wrapper that holds an article is kept. So do NEVER
# words as part of a longer name ("no-ads", "comments-enabled"); a name of such words and PARTS
# only ("comment-list") says that the element itself is a list of comments or an advert.
NEVER_WORDS = set("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion comment comments reply replies respond disqus".split())
PARTS = set("list lists area section wrap wrapper container box block slot unit item items body content thread threads form post posts inner outer top bottom left right text main".split())
LAYOUT_WORDS = set(
    "banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside widget cookie cookies consent gdpr notice notices "
    "notification alert popup modal overlay newsletter subscribe signup login search share sharing social related recommended pagination pager toolbar skip".split()
)
CLOSES_P = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = set("table ul ol dl html body article section div main".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_QUOTED = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[a-z0-9]+")
_NUMBER = re.compile(r"[0-9]+")
_WHITE = re.compile(r"\s+")


def is_aside(names: str) -> bool:
    """Whether one of the names of an element is that of a comment list or an advert."""
    for name in names.split():
        words = _WORDS.findall(name)
        if not NEVER_WORDS.isdisjoint(words) and all(w in NEVER_WORDS or w in PARTS or _NUMBER.fullmatch(w) for w in words):
            return True
    return False


class Node:
    """Element: name, attributes, whether it is never content, and children (nodes or text).

    ``layout`` marks what is skipped for the moment: a wrapper with a layout name that may hold
    an article, or the header of an article that may hold its heading. What is known from the
    elements around: ``article``, an article is one of them; ``declared``, an article or main part
    is; ``closed``, one of them or the element itself is never content; ``foreign``, a drawing or
    formula is one of them or the element itself.
    """

    __slots__ = ("name", "skipped", "layout", "main", "article", "declared", "closed", "foreign", "children", "hash")

    def __init__(self, name: str, attributes: str = "", outer: Node | None = None) -> None:
        self.name, self.children, self.hash = name, [], 0
        self.main, self.skipped, self.layout = name in MAIN, name in SKIP, False
        self.article = outer is not None and (outer.article or outer.name == "article")
        self.declared = outer is not None and (outer.declared or outer.main)
        self.foreign = name in FOREIGN or outer is not None and outer.foreign
        if name == "header" and self.declared:
            self.layout = True
        if attributes.strip(" /"):
            found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "").lower() for m in _ATTRIBUTE.finditer(attributes)}
            role = found.get("role", "")
            names = found.get("class", "") + " " + found.get("id", "")
            hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
            self.main = self.main or role in MAIN_ROLES
            if hidden or role in SKIP_ROLES:
                self.skipped, self.layout = True, False
            elif not self.skipped and name not in ("html", "body") and (name in NAMED or not self.declared):
                self._judge(names, set(_WORDS.findall(names)))
        self.closed = self.skipped and not self.layout or outer is not None and outer.closed

    def _judge(self, names: str, words: set[str]) -> None:
        aside = bool(words & NEVER_WORDS) and is_aside(names)
        if self.main:  # an article is skipped only as a comment or advert inside another one
            self.skipped = aside and self.article and self.name != "main"
        elif aside:
            self.skipped = True
        elif not self.article and words & (LAYOUT_WORDS | NEVER_WORDS):
            self.skipped = self.layout = True


class Scanner:
    """Markup of a page from left to right; every search that once found nothing is not tried again."""

    def __init__(self, page: str) -> None:
        self.page, self.missing, self.quotes = page, set(), True

    def find(self, token: str, at: int) -> int:
        if token in self.missing:
            return -1
        place = self.page.find(token, at)
        if place < 0:
            self.missing.add(token)
        return place

    def tag_end(self, at: int) -> int:
        """Place behind the tag whose name ends at ``at``, or -1; a ``>`` in quotes does not end it.

        Once a quote stays open to the end of the page, quotes are ignored from there on.
        """
        begin = at
        while self.quotes:
            m = _QUOTED.search(self.page, at)
            if m is None:
                break
            if m[0] == ">":
                return m.end()
            at = self.find(m[0], m.end()) + 1
            if at == 0:
                break
        self.quotes = False
        return self.find(">", begin) + 1 or -1

    def tokens(self) -> Iterator[tuple[str, str, str, int]]:
        """(kind, name or text, attributes, end) of texts, start tags and end tags; ``jump`` moves on."""
        page, self.at, size = self.page, 0, len(self.page)
        begin = 0
        while True:
            place = page.find("<", max(self.at, begin))
            if place < 0:
                break
            m = _TAG.match(page, place)
            if page.startswith("<!--", place):
                end, kind = self.find("-->", place + 4) + 3, "comment"
                end = size if end < 3 else end
            elif page.startswith("<![CDATA[", place) and (end := self.find("]]>", place) + 3) > 2:
                kind = "data"
            elif page.startswith(("<!", "<?"), place):
                end, kind = self.find(">", place) + 1, "comment"
            else:
                end, kind = self.tag_end(m.end()) if m else -1, "tag"
            if end <= 0:  # text; a tag without an end is text, and so is all that follows it
                begin = place + 1 if m is None else size
                continue
            if place > self.at:
                yield "text", page[self.at : place], "", place
            self.at = begin = end
            if kind == "data":
                yield "text", html.escape(page[place + 9 : end - 3]), "", end
            elif kind == "tag":
                yield "end" if m[1] else "start", m[2].lower(), page[m.end() : end - 1], end
            begin = self.at
        if self.at < size:
            yield "text", page[self.at :], "", size

    def jump(self, name: str) -> None:
        """Move behind the end tag of an element whose content is not markup."""
        end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(self.page, self.at)
        self.at = end.end() if end else len(self.page)


class _Open:
    """Open elements from the outermost on, and how many there are of each name."""

    def __init__(self, root: Node) -> None:
        self.stack, self.names = [root], Counter()

    def push(self, node: Node) -> None:
        self.stack.append(node)
        self.names[node.name] += 1

    def close(self, wanted: Container[str], through: Callable[[str], bool]) -> None:
        """Close the innermost element with a wanted name, if ``through`` holds for all inside it."""
        stack = self.stack
        if not any(self.names[name] for name in wanted):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in wanted:
                self.names.subtract(node.name for node in stack[i:])
                del stack[i:]
                return
            if not through(stack[i].name):
                return


def parse(page: str) -> Node:
    """Tree of a page; missing end tags are closed as browsers do in the common cases.

    The time grows with the length of the page, whatever its tags.
    """
    root = Node("#root")
    scanner, opened = Scanner(page), _Open(root)
    waiting: list[Node] = []  # layout elements around that are skipped so far
    for kind, name, attributes, _ in scanner.tokens():
        if kind == "text":
            opened.stack[-1].children.append(name)
            continue
        if kind == "end":
            opened.close((name,), lambda _: True)
            continue
        if name in CLOSES_P:
            opened.close(("p",), INLINE.__contains__)
        if name in SAME_CLOSES:
            opened.close(SAME_CLOSES[name], lambda other: other not in SCOPE)
        outer = opened.stack[-1]
        node = Node(name, attributes, outer)
        outer.children.append(node)
        if (node.main and not node.skipped or name in HEADINGS) and not outer.closed:
            around = set(map(id, opened.stack)) if waiting else ()
            for held in waiting:
                if id(held) in around and (held.name == "header" and held.declared) == (not node.main):
                    held.skipped = False
            waiting = [held for held in waiting if id(held) in around and held.skipped]
        if name in VOID or attributes.endswith("/") and (name in RAW or node.foreign):
            continue
        if name in RAW:
            scanner.jump(name)
            continue
        if node.skipped and node.layout:
            waiting.append(node)
        opened.push(node)
    return root


def _in_order(root: Node) -> Iterator[tuple[Node, bool]]:
    """Nodes in document order, each once before (False) and once after (True) its children."""
    stack: list[tuple[Node, bool]] = [(root, False)]
    while stack:
        node, after = stack.pop()
        yield node, after
        if not after:
            stack.append((node, True))
            stack.extend((c, False) for c in reversed(node.children) if isinstance(c, Node))


def content_root(root: Node) -> list[Node]:
    """Outermost elements declared as article or main part, outside of skipped ones; each is kept whole."""
    found, closed = [], 0
    inside = 0
    for node, after in _in_order(root):
        if node.skipped:
            closed += -1 if after else 1
        elif node.main and not closed:
            if not after and not inside:
                found.append(node)
            inside += -1 if after else 1
    return found


def hash_subtrees(root: Node, roots: list[Node]) -> tuple[list[int], list[int], int]:
    """Hash every subtree. Returns those outside of the articles, the boxes inside, and the content of the page."""
    outside, boxes, inside = [], [], 0
    tops = set(map(id, roots))
    for node, after in _in_order(root):
        top = id(node) in tops
        if not after:
            inside += top
            continue
        inside -= top
        parts = [node.name, *(_WHITE.sub(" ", c) if isinstance(c, str) else f"\x01{c.hash}" for c in node.children)]
        node.hash = xxhash.xxh3_64_intdigest("\x00".join(parts))
        filled = any(not isinstance(c, str) or c.strip() for c in node.children)
        if top or not filled or node.name in ("#root", "html", "head", "body"):
            continue
        if not inside:
            outside.append(node.hash)
        elif node.name in BOXES:
            boxes.append(node.hash)
    content = xxhash.xxh3_64_intdigest(b"".join(n.hash.to_bytes(8, "little") for n in roots or [root]))
    return outside, boxes, content


def main_text(page: str | None, template: set[int] = frozenset(), boxes: set[int] = frozenset()) -> str:
    """Blocks of the main part in page order, joined by an empty line.

    ``template`` holds the hashes of subtrees to delete outside of articles, ``boxes`` those
    to delete inside.
    """
    root = parse(page or "")
    roots = content_root(root)
    if template or boxes:
        hash_subtrees(root, roots)
    gone = boxes if roots else template
    blocks: list[str] = []
    held: list[str] = []

    def close() -> None:
        text = _WHITE.sub(" ", html.unescape("".join(held))).strip()
        if text:
            blocks.append(text)
        held.clear()

    for top in roots or [root]:
        stack: list[Node | str | None] = [top]
        while stack:
            part = stack.pop()
            if part is None:
                close()
            elif isinstance(part, str):
                held.append(part)
            elif part.name == "br":
                held.append(" ")
            elif part is not top and (part.skipped or part.hash in gone and (not roots or part.name in BOXES)):
                if part.name not in INLINE and part.name not in RAW:
                    close()
            else:
                block = part.name not in INLINE
                if block:
                    close()
                    stack.append(None)
                stack.extend(reversed(part.children))
        close()
    return "\n\n".join(blocks)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^[^:]*://([^/?#]*)", 1))


def extract(
    pages: DataFrame,
    url_col: str = "url",
    html_col: str = "html",
    least_pages: int = LEAST_PAGES,
    least_share: float = LEAST_SHARE,
    least_share_inside: float = LEAST_SHARE_INSIDE,
) -> DataFrame:
    """Add ``main_text`` and its length in code points, ``n_chars``, to every row.

    Blocks have one space for each run of white space and are joined by two line ends;
    character references are decoded. Subtrees that occur on at least ``least_pages``
    different pages and ``least_share`` of the different pages of their host are deleted
    (boxes inside an article: ``least_share_inside``). Null or empty html gives ''; a null
    url is the host ''. Repeated rows and copies of a page count once. An empty table gives
    an empty table. Columns named like a produced one are replaced.
    """
    passed = others(pages, *PRODUCED)
    rows = pages.select(*[col(c) for c in passed], host_of(col(url_col)).alias("__host"))
    at, width = next(i for i, c in enumerate(passed) if c.lower() == html_col.lower()), len(passed)

    def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(host, kind, subtree, content) of each page: kind 0 stands for the page itself, 1 for outside, 2 for boxes."""
        for batch in batches:
            found: set[tuple[str, int, int, int]] = set()
            for host, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                root = parse(page or "")
                outside, boxes, content = hash_subtrees(root, content_root(root))
                found.add((host, 0, 0, content))
                found.update((host, 1, h, content) for h in outside)
                found.update((host, 2, h, content) for h in boxes)
            columns = list(zip(*found, strict=True)) if found else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int8()), *(pa.array([h - 2**63 for h in c], pa.int64()) for c in columns[2:])],
                names=["host", "kind", "subtree", "content"],
            )

    met = rows.select("__host", col(html_col)).mapInArrow(subtrees, "host string, kind byte, subtree long, content long").distinct()
    counted = stage(met.groupBy("host", "kind", "subtree").agg(F.count(F.lit(1)).alias("n")).where((F.col("kind") == 0) | (F.col("n") >= least_pages)))
    sizes = counted.where("kind = 0").select("host", F.col("n").alias("n_pages"))
    share = F.when(F.col("kind") == 1, least_share).otherwise(least_share_inside)
    template = counted.where("kind > 0").join(sizes, "host").where(F.col("n") >= share * F.col("n_pages"))
    lists = template.groupBy("host").agg(
        F.collect_list(F.when(F.col("kind") == 1, F.col("subtree"))).alias("__template"), F.collect_list(F.when(F.col("kind") == 2, F.col("subtree"))).alias("__boxes")
    )

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(i).to_pylist() for i in (at, width, width + 1))
            texts = [main_text(page, {h + 2**63 for h in gone or ()}, {h + 2**63 for h in boxes or ()}) for page, gone, boxes in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*passed, *PRODUCED])

    known = stage(lists).withColumnRenamed("host", "__host")
    joined = rows.join(known, "__host", "left").select(*[col(c) for c in passed], "__template", "__boxes")
    return joined.mapInArrow(strip, extended(pages, passed, "main_text string, n_chars long"))

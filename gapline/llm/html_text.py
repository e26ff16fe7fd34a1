"""HTML extraction by tag-path ratios.

Text is summed by its path of tags from the root. A path's ratio is how much text, outside
links, and how much punctuation its nodes have on average; both are fused and bounded, so that
long nodes do not hide short ones. Ratios are smoothed over the tree of containers (they fade by
half per step, up or down) and count more inside an article. Paths whose ratio passes a share of
the largest are the content; the result is what the smallest container around all of them holds
outside boilerplate elements.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gapline.llm.frames import map_arrow, unused_name, without

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>")
#: A tag whose quotes do not match ends at the next bracket.
ODD_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
UNSHOWN = re.compile(r"display\s*:\s*none", re.I)
PUNCTUATION = re.compile(r"[.,;:!?。，…]")

# Element names of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var".split()
)
TEXTUAL = INLINE | frozenset(
    "p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure "
    "figcaption address center".split()
)
BOILERPLATE = frozenset(
    "head nav footer aside form script style noscript template iframe svg canvas object button select menu dialog".split()
)
BOILERPLATE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments "
    "complementary consent contentinfo cookie cookies disqus footer masthead menu nav navbar navigation "
    "newsletter notice notices pagination popup promo promotion sidebar skip "
    "sponsor sponsored subscribe toolbar".split()
)
#: Names that articles have as well: no proof, but a hint.
HINTS = frozenset("header modal related search share sharing social widget".split())
#: Of the former, what may be longer than the article.
TALK_NAMES = frozenset("comment comments disqus promo promotion".split())
#: Elements that are never boilerplate by their names, and those that are not by a hint.
WHOLE = frozenset("html body main article".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FIRM = HEADINGS | frozenset("p table thead tbody tfoot tr td th caption figure figcaption blockquote pre".split())
#: A hint is followed if this share of the text is links, or, outside an article, if there is no heading
#: and a piece of text has fewer characters than this on average.
LINKED, SHORT = 0.5, 80
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"},
}
#: A node has at most so much text and punctuation that counts.
MOST_TEXT, MOST_MARKS = 200, 3
#: What ratios inside an article or main are worth, and the share of the largest that a path needs.
ARTICLE_WEIGHT = 6
THRESHOLD = 1 / 8
SCOPES = frozenset("html body table td th ul ol dl article section main div aside nav footer header form".split())

#: What names say of an element: nothing; a hint; boilerplate, in a word of its own or of talk.
SILENT, HINT, NAMED = 0, 1, 2


def _label(tag: str, attributes: str) -> tuple[str, bool, int]:
    """The element's part of a path, whether it holds boilerplate, and what its names say of it."""
    if not attributes:
        return tag, tag in BOILERPLATE, SILENT
    found = [(name.lower(), a or b or c) for name, a, b, c in ATTRIBUTE.findall(attributes)]
    names = " ".join(value for name, value in found if name in ("class", "id", "role")).lower()
    hidden = any(name == "hidden" or name == "style" and UNSHOWN.search(value) for name, value in found)
    noise = tag in BOILERPLATE or hidden and tag not in ("html", "body")
    says = SILENT
    if names and tag not in WHOLE:
        words = set(re.split(r"[^a-z0-9]+", names))
        sure = words & BOILERPLATE_NAMES
        if sure & TALK_NAMES or sure & set(names.split()):
            says = NAMED
        elif (sure or words & HINTS) and tag not in FIRM:
            says = HINT
    return (f"{tag}.{names}" if names else tag), noise, says


class Tree:
    """Elements and tag paths of a page as numbered nodes, parents first, and the texts in page order.

    All that is asked about what holds or surrounds a node is found by passes over the numbers, up or down,
    so the work does not depend on the depth.
    """

    def __init__(self) -> None:
        # Elements; 0 is the page. An element belongs to a path.
        self.parent, self.path, self.says, self.in_article = [0], [0], [SILENT], [False]
        self.seen_head: list[int] = [0]  # of an element: the nearest h1 or main around it or itself, else 0
        # Paths; 0 is the root's. ``places`` finds a path's child by label.
        self.above, self.tags, self.told = [0], [""], [False]
        self.places: dict[tuple[int, str], int] = {}
        self.texts: list[tuple[int, int, str, bool]] = []  # block, element, text, in a link

    def element(self, parent: int, tag: str, label: str, says: int) -> int:
        own = (self.path[parent], label)
        if own not in self.places:
            self.places[own] = len(self.above)
            self.above.append(own[0])
            self.tags.append(tag)
            self.told.append(self.told[own[0]] or tag in ("article", "main") or "main" in label.split(".")[1:])
        number = len(self.parent)
        self.parent.append(parent)
        self.path.append(self.places[own])
        self.says.append(says)
        self.in_article.append(self.in_article[parent] or tag in ("article", "main"))
        self.seen_head.append(number if tag in ("h1", "main") else self.seen_head[parent])
        return number


def _tokens(page: str) -> Iterator[tuple[re.Match | None, str]]:
    """Tags, and texts between them. Comments, doctypes, scripts and the like are left out."""
    at, last = 0, page.rfind(">")
    while at < len(page):
        opened = page.find("<", at)
        if opened != at:
            end = opened if opened >= 0 else len(page)
            yield None, page[at:end]
            at = end
        elif page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = end + 3 if end >= 0 else len(page)
        else:
            # Behind the last bracket there are no tags to look for.
            found = at < last and (TAG.match(page, at) or ODD_TAG.match(page, at))
            if found and not found[1] and found[2].lower() in UNREAD:
                end = re.compile(rf"</{found[2]}\s*>", re.I).search(page, found.end())
                at = end.end() if end else len(page)
            elif found:
                yield found, ""
                at = found.end()
            elif at < last and page[at + 1 : at + 2] in ("!", "?", "/"):
                at = page.index(">", at) + 1
            else:
                yield None, "<"
                at += 1


def _read(page: str) -> Tree:
    """The page's elements and the texts that are in no boilerplate element."""
    tree = Tree()
    # Of open elements: tag, number, whether in boilerplate, whether in a link, the last place up to it with a tag
    # that is not inline, and with one of SCOPES.
    stack: list[tuple[str, int, bool, bool, int, int]] = []
    open_at: dict[str, list[int]] = defaultdict(list)
    outside = ("", 0, False, False, -1, -1)
    block = 0

    def close(to: int) -> None:
        while len(stack) > to:
            open_at[stack.pop()[0]].pop()

    for found, text in _tokens(page):
        top = stack[-1] if stack else outside
        if found is None:
            if not top[2]:
                tree.texts.append((block, top[1], text, top[3]))
            continue
        tag = found[2].lower()
        if found[1]:
            if tag not in INLINE:
                block += 1
            if open_at[tag] and (tag not in INLINE or open_at[tag][-1] > top[4]):
                close(open_at[tag][-1])
            continue
        if tag == "br" and not top[2]:
            tree.texts.append((block, top[1], "\n", False))
        if tag not in INLINE and tag not in VOID or tag == "hr":
            block += 1
            place = max((open_at[t][-1] for t in CLOSED_BY.get(tag, set()) | {"p"} if open_at[t]), default=-1)
            if place >= max(top[5], 0):
                close(place)
                top = stack[-1] if stack else outside
        if tag not in VOID and not found[3].endswith("/"):
            label, noise, says = _label(tag, found[3])
            place = len(stack)
            number = tree.element(top[1], tag, label, says)
            noise = top[2] or noise or tag == "header" and not tree.in_article[top[1]]
            open_at[tag].append(place)
            stack.append(
                (tag, number, noise, top[3] or tag == "a", top[4] if tag in INLINE else place, place if tag in SCOPES else top[5])
            )
    return tree


def _shown(tree: Tree) -> list[tuple[int, int, str, bool]]:
    """(block number, path, text, in a link) of what is not boilerplate.

    An element that its names call boilerplate is none if it holds more than half of the page's text outside
    links, and an h1 or main; a hint has conditions of its own (see ``LINKED``). Where all
    text would go, no name counts.
    """
    n = len(tree.parent)
    held, linked, pieces = [0] * n, [0] * n, [0] * n
    headed, heading = [False] * n, [tree.tags[p] in HEADINGS for p in tree.path]
    for _, element, text, link in tree.texts:
        size = len(text.strip())
        if size:
            held[element] += 0 if link else size
            linked[element] += size if link else 0
            pieces[element] += 1
        headed[tree.seen_head[element]] = True
    below = [False] * n  # an h1 or main with text further down
    for k in range(n - 1, 0, -1):
        up = tree.parent[k]
        held[up] += held[k]
        linked[up] += linked[k]
        pieces[up] += pieces[k]
        below[up] |= below[k] or headed[k] and tree.seen_head[k] == k
        heading[up] |= heading[k]
    total = held[0]
    dropped = [False] * n
    for k in range(1, n):
        size = held[k] + linked[k]
        if tree.says[k] == NAMED:
            own = 2 * held[k] <= total or not below[k]
        else:
            short = not heading[k] and not tree.in_article[k] and size < SHORT * pieces[k]
            own = tree.says[k] == HINT and 2 * held[k] <= total and (linked[k] > LINKED * size or short)
        dropped[k] = own or dropped[tree.parent[k]]
    texts = [(b, e, html.unescape(t), link) for b, e, t, link in tree.texts]
    kept = [x for x in texts if not dropped[x[1]]]
    kept = kept if any(x[2].strip() for x in kept) else texts
    return [(b, tree.path[e], t, link) for b, e, t, link in kept]


def _content(tree: Tree, nodes: list[tuple[int, int, str, bool]]) -> list[int]:
    """The containers (paths) whose smoothed ratio passes the threshold."""
    n = len(tree.above)
    container, in_title = list(range(n)), [False] * n
    for k in range(1, n):
        container[k] = container[tree.above[k]] if tree.tags[k] in TEXTUAL else k
        in_title[k] = in_title[tree.above[k]] or tree.tags[k] == "h1"
    sums: dict[int, list[int]] = defaultdict(lambda: [0, 0, 0, 0])
    for _, path, text, link in nodes:
        size = len(text.strip())
        if size:
            s = sums[container[path]]
            s[0] += size
            s[1] += len(PUNCTUATION.findall(text))
            s[2] += size if link and not in_title[path] else 0
            s[3] += 1
    near = [0.0] * n
    for path, (size, marks, linked, k) in sums.items():
        near[path] = min((size - linked) / k, MOST_TEXT) * (1 + min(marks / k, MOST_MARKS))
    for k in range(n - 1, 0, -1):
        near[tree.above[k]] = max(near[tree.above[k]], near[k] / 2)
    for k in range(1, n):
        near[k] = max(near[k], near[tree.above[k]] / 2)
    smooth = {p: near[p] * (1 - linked / size) * (ARTICLE_WEIGHT if tree.told[p] else 1) for p, (size, _, linked, _) in sums.items()}
    least = max(smooth.values(), default=0.0) * THRESHOLD
    return [p for p, ratio in smooth.items() if ratio >= least]


def main_text(page: str) -> str:
    """The article of a page: blocks joined by line breaks, white space as single spaces."""
    tree = _read(page)
    nodes = _shown(tree)
    content = _content(tree, nodes)
    if not content:
        return ""
    n = len(tree.above)
    holds = [0] * n
    for path in content:
        holds[path] += 1
    for k in range(n - 1, 0, -1):
        holds[tree.above[k]] += holds[k]
    # Children have larger numbers, so the last one that holds all is the smallest.
    best = max(k for k in range(n) if holds[k] == len(content))
    inside = [False] * n
    inside[best] = True
    for k in range(best + 1, n):
        inside[k] = inside[tree.above[k]]
    blocks: dict[int, list[str]] = defaultdict(list)
    for block, path, text, _ in nodes:
        if inside[path]:
            blocks[block].append(text)
    lines = (" ".join("".join(parts).split()) for _, parts in sorted(blocks.items()))
    return "\n".join(line for line in lines if line)


def extract_text(pages: DataFrame, html_col: str = "html", into: str = "text") -> DataFrame:
    """Add the main text of each page; a column of the name ``into`` is replaced.

    The text is all that the smallest container around the content holds; what is content, is told
    by ratios, which count ``ARTICLE_WEIGHT`` times in an ``article`` or ``main``. Boilerplate (menus, page headers, footers, sidebars, forms, adverts,
    notices, comments, hidden elements) is known by tag, class, id and role; by the last three
    never html, body, main and article, nor what holds most of the page (see ``_shown``). Null and empty
    pages, and pages without any other text, give an empty text. Pages do not depend on each other.
    """
    columns = without(pages.columns, [into])
    kept = pages.select(*(f"`{c}`" for c in columns))
    made = unused_name("_text", columns)
    schema = T.StructType([*kept.schema.fields, T.StructField(made, T.StringType())])
    place = columns.index(html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), 256):
                part = batch.slice(first, 256)
                texts = pa.array([main_text(x.as_py() or "") for x in part.column(place)], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*columns, made])

    return map_arrow(kept, run, schema).withColumnRenamed(made, into)

"""Trees of web pages for wrapper induction: a tolerant reader, merged shapes of pages, simple tree matching."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

#: A tag with its attributes. Quoted values may hold ">"; a quote that never ends belongs to the tag's name up to the next ">".
TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: HTML's elements by how they are read. Fixed values of the format.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Start tags that end an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li dd dt main menu nav ol p pre section summary table ul search".split()
)
#: Start tags that end an open element of the second set, unless one of the third is opened in between.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, set()),
}
#: Elements nested deeper than this are read as parts of the one above.
DEEPEST = 200


@dataclass(slots=True)
class Node:
    """An element that starts a block, or the root. parts: text pieces and nodes in page order; each text is (piece, within a link)."""

    tag: str
    marks: str = ""
    hidden: bool = False
    parts: list = field(default_factory=list)


def attributes_of(tag: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(tag):
        out.setdefault(name.lower(), a or b or c)
    return out


def is_hidden(values: dict[str, str]) -> bool:
    style = values.get("style", "").replace(" ", "").lower()
    return "hidden" in values or values.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style


def read_page(page: str) -> tuple[Node, str]:
    """A page's tree and its title. Any text is read, each character once or twice; unknown ends are passed over."""
    root = Node("#root")
    stack, title, links, at, size = [root], "", 0, 0, len(page)
    # whether inline elements that are hidden are open: depth of each
    unseen: list[str] = []

    def put(text: str) -> None:
        if text and not unseen:
            stack[-1].parts.append((text, links > 0))

    def pop_to(k: int) -> None:
        nonlocal links
        del stack[k:]
        links = 0

    while at < size:
        open_ = page.find("<", at)
        if open_ < 0:
            put(page[at:])
            break
        if open_ > at:
            put(page[at:open_])
        if page.startswith("<!--", open_):
            # "<!-->" and "<!--->" are whole comments too
            end = next((open_ + n for mark, n in (("<!-->", 5), ("<!--->", 6)) if page.startswith(mark, open_)), None)
            if end is None:
                close = page.find("-->", open_ + 4)
                end = size if close < 0 else close + 3
            at = end
            continue
        if page[open_ + 1 : open_ + 2] in ("!", "?") or page[open_ + 1 : open_ + 2] == "/" and not page[open_ + 2 : open_ + 3].isalpha():
            close = page.find(">", open_)
            at = size if close < 0 else close + 1
            continue
        found = TAG.match(page, open_) or LOOSE.match(page, open_)
        if not found:
            if page[open_ + 1 : open_ + 2].isascii() and page[open_ + 1 : open_ + 2].isalpha() or page.startswith("</", open_):
                break  # a tag that the page ends in
            put("<")
            at = open_ + 1
            continue
        at = found.end()
        closing, tag, rest = found[1], found[2].lower(), found[3]
        if closing:
            if tag == "br":
                put("\n")
            elif tag == "a":
                links = max(0, links - 1)
            elif tag == "p" and not any(x.tag == "p" for x in stack):
                put("\n")
            elif tag not in INLINE:
                k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), None)
                if k is not None:
                    pop_to(k)
            if unseen and unseen[-1] == tag:
                unseen.pop()
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            inside = page[at : close.start() if close else size]
            at = close.start() if close else size
            if tag == "title" and not title:
                title = html.unescape(inside)
            if close:
                end = page.find(">", at)
                at = size if end < 0 else end + 1
            continue
        if tag in VOID or tag in ("br", "hr"):
            if tag in ("br", "hr"):
                put("\n")
            continue
        if tag in INLINE:
            if tag == "a":
                links = 1  # links do not nest
            if unseen or rest and is_hidden(attributes_of(rest)):
                unseen.append(tag)
            continue
        if tag == "html":
            continue
        if tag in ENDS_P:
            k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag in ("p", "table", "td", "th", "button")), 0)
            if k and stack[k].tag == "p":
                pop_to(k)
        if tag in IMPLIED:
            ended, within = IMPLIED[tag]
            low = None
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in within:
                    break
                if stack[i].tag in ended:
                    low = i
            if low is not None:
                pop_to(low)
        unseen.clear()
        if len(stack) >= DEEPEST:
            put("\n")
            continue
        values = attributes_of(rest) if rest.strip() else {}
        marks = " ".join(filter(None, (values.get("class"), values.get("id"), values.get("role"), values.get("itemprop"), values.get("aria-label") if tag in ("div", "section", "aside") else None)))
        node = Node(tag, html.unescape(marks).lower(), bool(values) and is_hidden(values))
        stack[-1].parts.append(node)
        if not rest.endswith("/") or tag not in ("svg", "math", "path"):
            stack.append(node)
            links = 0
    return root, title


#: Elements, and words in class, id and role, that are not for the article. Fixed values.
AROUND_TAGS = frozenset("nav footer aside form menu dialog select button datalist template object svg math canvas audio video map search".split())
AROUND = frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar aside footer foot colophon contentinfo complementary ad ads adv advert adverts advertisement advertising sponsor sponsors sponsored promo promos promotion banner "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay dialog newsletter subscribe subscription signup login signin search searchbox searchform comment comments respond reply replies disqus discussion feedback "
    "share sharing social related recommended recommendations widget widgets pagination pager toolbar skip form".split()
)
#: The same for what heads a page; within an article these head the article.
HEADS_TAGS, HEADS = frozenset(("header", "hgroup")), frozenset("header masthead topbar head".split())
#: Elements that hold the article.
MAIN_TAGS, MAIN = frozenset(("article", "main")), frozenset(("main", "article", "articlebody"))
PARTS_OF_MARKS = re.compile(r"[^\W\d_]+")
WITHOUT = frozenset("no not without has with hide".split())


def role_of(label: str) -> str:
    """What an element is for by its tag and marks: "around", "head", "main" or unknown."""
    tag, _, marks = label.partition(" ")
    if tag in AROUND_TAGS:
        return "around"
    words = PARTS_OF_MARKS.findall(marks) if marks else []
    # "no-sidebar" says that there is none
    told = {w for before, w in zip(["", *words], words) if before not in WITHOUT}
    if tag not in ("body", "html") and (told & AROUND or any(w.startswith("adsby") or w == "adsense" for w in told)):
        return "around"
    if tag in HEADS_TAGS or tag not in ("body", "html") and told & HEADS:
        return "head"
    return "main" if tag in MAIN_TAGS or tag in ("div", "section", "td") and told & MAIN and len(words) <= 2 else ""


DIGITS = re.compile(r"\d+")


def label_of(node: Node) -> str:
    """What must be equal for two elements to match: tag and marks, numbers left out."""
    return node.tag if not node.marks else f"{node.tag} {DIGITS.sub('', node.marks)}"[:120]


@dataclass(slots=True)
class Shape:
    """A template's node, summed over the pages that have it.

    values: the hash of its own text, None once it differs; titles: up to
    ENOUGH hashes of the titles of pages that have it; chars and links: characters of its own text, and of those
    in links; many: it stands for all siblings of its label, or of its tag where the label is "tag *".
    """

    label: str
    pages: int = 0
    value: int | None = None
    varies: bool = False
    titles: frozenset = frozenset()
    chars: int = 0
    links: int = 0
    many: bool = False
    kids: list = field(default_factory=list)
    #: Of a page's own shape: the elements that it stands for.
    nodes: list = field(default_factory=list)
    #: Of a template in use: whether it holds the article.
    region: bool = False


#: Different titles from which on what stays the same is taken for the template's.
ENOUGH = 3
#: Siblings of a container's label from which on they are taken as one that repeats. Paragraphs, lines and cells always are.
SIBLINGS = 8
#: Siblings of a template's node from which on marks that differ from page to page are no longer told apart.
WIDE = 64
REPEATED = frozenset("p li h1 h2 h3 h4 h5 h6 tr td th dd dt blockquote pre option".split())


def own_text(node: Node) -> str:
    return " ".join(html.unescape("".join(x[0] for x in node.parts if type(x) is tuple)).split())


def shape_of(node: Node, title: int, seed) -> Shape:
    """A page's tree as a shape. seed: hashes a text to a number."""
    text = own_text(node)
    out = Shape(label_of(node), 1, seed(text) if text else None, False, frozenset((title,)), len(text), sum(len(x[0]) for x in node.parts if type(x) is tuple and x[1]), nodes=[node])
    out.kids = one_of_each([shape_of(x, title, seed) for x in node.parts if type(x) is Node])
    return out


def tag_of(label: str) -> str:
    return label.split(" ", 1)[0]


def one_of_each(kids: list[Shape], repeating: frozenset = frozenset()) -> list[Shape]:
    """Siblings with those of a repeating label merged into the first of them."""
    count: dict[str, int] = {}
    for x in kids:
        count[x.label] = count.get(x.label, 0) + 1
    again = {k for k, n in count.items() if k in repeating or n > 1 and tag_of(k) in REPEATED or n > SIBLINGS}
    if not again:
        return kids
    out, first = [], {}
    for x in kids:
        if x.label in again:  # an element that stands once on this page may stand for many on another
            if x.label in first:
                k = first[x.label]
                out[k] = merged(out[k], x)
                out[k].many = True
            else:
                first[x.label] = len(out)
                x.many = x.many or count[x.label] > 1
                out.append(x)
        else:
            out.append(x)
    return out


def generalised(kids: list[Shape], tags: set[str]) -> list[Shape]:
    """Siblings of these tags with marks left out, but for marks that tell what an element is for."""
    return [x if tag_of(x.label) not in tags or x.label.endswith(" *") or role_of(x.label) else replace(x, label=f"{tag_of(x.label)} *", many=True) for x in kids]


def matched(a: list[Shape], b: list[Shape], seen: dict) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching of two rows of siblings: the most nodes that match in order, and which do."""
    if not a or not b:
        return 0, []
    most = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best = max(most[i][j + 1], most[i + 1][j])
            if x.label == y.label:
                best = max(best, most[i][j] + weight(x, y, seen))
            most[i + 1][j + 1] = best
    pairs, i, j = [], len(a), len(b)
    while i and j:
        if most[i][j] == most[i - 1][j]:
            i -= 1
        elif most[i][j] == most[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return most[-1][-1], pairs[::-1]


def weight(a: Shape, b: Shape, seen: dict) -> int:
    """Nodes of the largest match of two trees whose roots match."""
    if (key := (id(a), id(b))) not in seen:
        seen[key] = 1 + matched(a.kids, b.kids, seen)[0]
    return seen[key]


def aligned(a: list[Shape], b: list[Shape]) -> tuple[list[Shape], list[Shape], list[tuple[int, int]]]:
    """Both rows with what repeats in either taken as one, and their matching."""
    general = {tag_of(x.label) for x in (*a, *b) if x.label.endswith(" *")}
    if general:
        a, b = generalised(a, general), generalised(b, general)
    repeating = frozenset(x.label for x in (*a, *b) if x.many)
    if repeating:
        a, b = one_of_each(a, repeating), one_of_each(b, repeating)
    return a, b, matched(a, b, {})[1]


def merged(a: Shape, b: Shape) -> Shape:
    """One shape for both: what matches is summed, what does not stays beside its neighbours."""
    titles = a.titles | b.titles
    if len(titles) > ENOUGH:
        titles = frozenset(sorted(titles)[:ENOUGH])
    varies = a.varies or b.varies or a.value != b.value
    out = Shape(a.label, a.pages + b.pages, None if varies else a.value, varies, titles, a.chars + b.chars, a.links + b.links, a.many or b.many, nodes=a.nodes + b.nodes, region=a.region or b.region)
    left, right, pairs = aligned(a.kids, b.kids)
    i = j = 0
    for x, y in [*pairs, (len(left), len(right))]:
        out.kids += left[i:x] + right[j:y]
        if x < len(left):
            out.kids.append(merged(left[x], right[y]))
        i, j = x + 1, y + 1
    if len(out.kids) > WIDE:
        out.kids = generalised(out.kids, {tag_of(x.label) for x in out.kids})
    out.kids = one_of_each(out.kids, frozenset(x.label for x in out.kids if x.many))
    return out


def packed(s: Shape) -> list:
    return [s.label, s.pages, s.value, s.varies, sorted(s.titles), s.chars, s.links, s.many, [packed(x) for x in s.kids]]


def unpacked(x: list) -> Shape:
    return Shape(x[0], x[1], x[2], x[3], frozenset(x[4]), x[5], x[6], x[7], [unpacked(k) for k in x[8]])


def walk(s: Shape) -> Iterator[Shape]:
    yield s
    for x in s.kids:
        yield from walk(x)

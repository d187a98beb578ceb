"""A page as a tree of block elements with their text, and the features of its nodes."""

import html
import re
from bisect import bisect_right
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np

# A tag up to the next "<"; _Tags takes what it does not match.
_PLAIN_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/<>"']*+)([^<>"']*+(?:"[^"<>]*+"[^<>"']*+)*+)>""")
_TAG_START = re.compile(r"<(/?)[a-zA-Z]")
_NAME_END = re.compile(r"[\s/>]")
_MARK = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_TOKEN = re.compile(r"[a-z]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_MARKS = re.compile(r"[.,;:!?]")

# Fixed values of HTML: elements that make blocks, that hold no text of the page, that are raw text, and what ends what.
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table caption colgroup tbody td tfoot "
    "th thead tr ul".split()
)
SILENT = frozenset(
    "head noscript template svg iframe select datalist button object canvas audio video map noframes progress meter".split()
)
RAW = frozenset("script style textarea title xmp noembed".split())
IN_HEAD = frozenset("head base basefont bgsound link meta title style script noscript template noframes".split())
_HEAD_PARTS = {
    tag: re.compile(rf"</({tag})\b|<body\b|</head\b{more}", re.I)
    for tag, more in (("noscript", r"|<noscript\b"), ("template", ""), ("noframes", r"|<noframes\b"))
}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_PARENTS = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",)}
_ENDED_BY = {
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
}

# Words in class, id, role and similar attributes, by what they usually mark.
TOKENS = {
    "content": "article articlebody blog body content entry main maincontent page paragraph post postcontent story text",
    "navigation": "breadcrumb breadcrumbs crumbs links menu menubar nav navbar navigation pager pagination paging skip tabs toc toolbar",
    "furniture": "aside bottom colophon contentinfo copyright foot footer head header legal logo masthead rail sidebar sitemap topbar widget",
    "advert": "ad ads adslot advert advertisement advertising affiliate banner doubleclick dfp promo promoted promotion sponsor sponsored",
    "notice": "alert consent cookie cookies disclaimer gdpr message modal notice notification overlay popup privacy toast warning",
    "comment": "comment commentlist comments discussion disqus feedback replies reply respond response responses reviews thread",
    "social": "follow like more next popular prev readmore recommend recommended related share sharing social subscribe tags trending",
    "form": "captcha form input login newsletter search searchform signin signup",
}
_GROUP = {word: i for i, words in enumerate(TOKENS.values()) for word in words.split()}
_KINDS = {
    tag: i
    for i, tags in enumerate(
        (
            "article main",
            "nav menu",
            "header hgroup",
            "footer",
            "aside dialog details search",
            "form fieldset",
            "ul ol dl dir",
            "li dt dd",
            "table tbody thead tfoot tr td th caption",
            "p pre blockquote",
            "h1 h2 h3 h4 h5 h6",
            "figure figcaption",
        )
    )
    for tag in tags.split()
}
_KIND_COUNT = 13
_GROUPS = len(TOKENS)


@dataclass
class Node:
    """A block element: its tag, words of its attributes by group, parent, depth, and what it holds in page order."""

    tag: str
    groups: tuple[int, ...]
    parent: int
    depth: int
    silent: bool
    items: list[tuple[bool, int]] = field(default_factory=list)  # (is a text block, its number or the node's)


@dataclass
class Page:
    """Nodes in page order, and text blocks with the characters of theirs that are links, and their links."""

    nodes: list[Node]
    texts: list[str]
    linked: list[int]
    links: list[int]


def _groups(attributes: str) -> tuple[int, ...]:
    if not attributes or "=" not in attributes:
        return ()
    found = set()
    for _, value in _ATTRIBUTE.findall(attributes):
        for word in _TOKEN.findall(_HUMP.sub(" ", value).lower()):
            if word in _GROUP:
                found.add(_GROUP[word])
    return tuple(sorted(found))


class _Tags:
    """The tags, comments and declarations of a page, in time proportional to its length.

    A tag ends at the first ">" outside quotes; "<" and a letter that no such end follows are text. Where a tag ends depends
    only on the first quote or ">" behind its name, so the answer is kept for each of these marks.
    """

    def __init__(self, source: str):
        self.source, self.last = source, source.rfind(">")
        self.ends: dict[int, int] = {}  # by the place of a mark outside quotes: that of the ">", -1 if there is none
        self.ahead = {_NAME_END: -1, _MARK: -1}

    def _next(self, what: re.Pattern, at: int) -> int:
        """The first place from ``at`` on that ``what`` matches. What is asked for only moves forward, so it is kept."""
        if self.ahead[what] < at:
            found = what.search(self.source, at)
            self.ahead[what] = found.start() if found else len(self.source)
        return self.ahead[what]

    def _end(self, mark: int) -> int:
        source, path = self.source, []
        while mark not in self.ends:
            path.append(mark)
            if source[mark] == ">":
                self.ends[mark] = mark
                break
            close = source.find(source[mark], mark + 1)
            found = _MARK.search(source, close + 1) if close >= 0 else None
            if not found:
                self.ends[mark] = -1
                break
            mark = found.start()
        for place in path:
            self.ends[place] = self.ends[mark]
        return self.ends[mark]

    def after(self, at: int) -> tuple[int, int, str | None, str, str] | None:
        """Start, end, name (None for what is no tag), "/" of an end tag, and attributes of the first one from ``at`` on."""
        source = self.source
        while (start := source.find("<", at)) >= 0:
            at = start + 1
            if plain := _PLAIN_TAG.match(source, start):
                return start, plain.end(), plain.group(2), plain.group(1), plain.group(3)
            if source.startswith("<!--", start):
                end = source.find("-->", start + 4)
                return start, len(source) if end < 0 else end + 3, None, "", ""
            if start > self.last:
                continue
            if source.startswith(("<!", "<?"), start):
                return start, source.index(">", start) + 1, None, "", ""
            if begin := _TAG_START.match(source, start):
                name = self._next(_NAME_END, begin.end())
                mark = self._next(_MARK, name)
                end = self._end(mark) if mark < len(source) else -1
                if end >= 0:
                    return start, end + 1, source[begin.end() - 1 : name], begin.group(1), source[name:end]
        return None


def parse(source: str) -> Page:
    """The tree of block elements of a page, however broken; white space in a text block is one space, references are decoded.

    Takes time proportional to the length of the page, whatever is in it.
    """
    page = Page([Node("#page", (), -1, 0, False)], [], [], [])
    stack = [0]
    where: dict[str, list[int]] = defaultdict(list)  # the places on the stack at which a tag is open
    ahead: dict[str, re.Match | None] = {}
    pieces: list[str] = []
    linked, links, in_link, other, place, length = 0, 0, False, False, 0, len(source)

    def flush() -> None:
        nonlocal linked, links
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                page.nodes[stack[-1]].items.append((True, len(page.texts)))
                page.texts.append(text)
                page.linked.append(min(linked, len(text)))
                page.links.append(links)
        linked = links = 0

    def close_to(depth: int) -> None:
        flush()
        for i in stack[depth:]:
            where[page.nodes[i].tag].pop()
        del stack[depth:]

    def head() -> int:
        """Where an open head is on the stack, 0 if there is none: it stands first on the page or in html."""
        return next((depth for depth in (1, 2) if depth < len(stack) and page.nodes[stack[depth]].tag == "head"), 0)

    def begun() -> bool:
        """Whether anything but html has begun, so that no head can."""
        return bool(page.texts) or other or any(x.strip() for x in pieces)

    tags = _Tags(source)
    while found := tags.after(place):
        start, stop, name, closing, attributes = found
        if page.nodes[stack[-1]].tag == "head" and source[place:start].strip():
            close_to(head())  # text cannot stand in a head
        node = page.nodes[stack[-1]]
        if start > place and not node.silent:
            text = source[place:start]
            pieces.append(text)
            if in_link:
                linked += len(text)
        place = stop
        if name is None:
            continue
        tag = name.lower()
        if node.silent and (depth := head()):
            # Both tags of head may be left out: what cannot stand in it ends it, and body ends what is open in it, too.
            if tag == "body" or node.tag == "head" and (tag in ("html", "br") if closing else tag not in IN_HEAD and tag != "html"):
                close_to(depth)
                node = page.nodes[stack[-1]]
            elif node.tag == "head" and not closing and tag in _HEAD_PARTS:
                if tag not in ahead or ahead[tag] and ahead[tag].start() < place:
                    ahead[tag] = _HEAD_PARTS[tag].search(source, place)
                end = ahead[tag]
                if not end or not end.group(1):
                    continue  # never closed: what follows stands in the head itself, or ends it
        if tag in RAW and not closing:
            end = re.compile(f"</{tag}", re.I).search(source, place)
            place = source.find(">", end.end()) + 1 if end else 0
            place = place or length
        elif tag == "br":
            pieces.append(" ")
        elif tag == "a":
            in_link = not closing
            links += in_link
        elif tag in BLOCKS or tag in SILENT:
            if not closing:
                if tag in ("html", "body") and where[tag]:
                    continue
                if tag == "head" and begun():
                    continue
                ends, within = _ENDED_BY.get(tag, ()), _PARENTS.get(tag, ())
                ended = (*ends, "p") if tag in BLOCKS else ends
                if ends and not page.nodes[stack[-1]].silent:
                    inner = max((where[x][-1] for x in within if where[x]), default=0)
                    open_there = [where[x][at] for x in ended if (at := bisect_right(where[x], inner)) < len(where[x])]
                    if open_there:
                        close_to(min(open_there))
                else:
                    while len(stack) > 1 and page.nodes[stack[-1]].tag in ended:
                        close_to(len(stack) - 1)
                flush()
                if tag in VOID:
                    continue
                above = page.nodes[stack[-1]]
                above.items.append((False, len(page.nodes)))
                silent = above.silent or tag in SILENT
                page.nodes.append(Node(tag, _groups(attributes), stack[-1], above.depth + 1, silent))
                other = other or tag != "html"
                if not attributes.endswith("/") or tag in BLOCKS:
                    where[tag].append(len(stack))
                    stack.append(len(page.nodes) - 1)
            elif where[tag]:
                close_to(where[tag][-1])
                in_link = False
            else:
                flush()
    if page.nodes[stack[-1]].tag == "head" and source[place:].strip():
        close_to(head())
    if place < length and not page.nodes[stack[-1]].silent:
        pieces.append(source[place:])
    flush()
    return page


def features(page: Page) -> np.ndarray:
    """A row for each node: depth, subtree density, tag, attribute words of the node and of those above, siblings."""
    nodes = page.nodes
    n = len(nodes)
    chars, linked, links, marks, blocks, longest = (np.zeros(n) for _ in range(6))
    tags, paragraphs, listed, headings, own = (np.zeros(n) for _ in range(5))
    starts = np.zeros(n)
    kinds = np.array([_KINDS.get(node.tag, _KIND_COUNT - 1) for node in nodes])
    seen = 0.0
    order: list[tuple[int, int]] = [(0, 0)]
    begun = [False] * n
    while order:  # page order, to know how much text stands before a node
        i, at = order.pop()
        if not begun[i]:
            begun[i] = True
            starts[i] = seen
        items = nodes[i].items
        if at < len(items):
            order.append((i, at + 1))
            is_text, number = items[at]
            if is_text:
                text = page.texts[number]
                size = len(text)
                seen += size
                chars[i] += size
                own[i] += size
                linked[i] += page.linked[number]
                links[i] += page.links[number]
                marks[i] += len(_MARKS.findall(text))
                blocks[i] += 1
                longest[i] = max(longest[i], size)
            else:
                order.append((number, 0))
    parents = np.array([node.parent for node in nodes])
    for i in range(n - 1, 0, -1):
        p = parents[i]
        for sums in (chars, linked, links, marks, blocks):
            sums[p] += sums[i]
        longest[p] = max(longest[p], longest[i])
        tags[p] += tags[i] + 1
        paragraphs[p] += paragraphs[i] + (nodes[i].tag == "p")
        listed[p] += listed[i] + (kinds[i] == 7)
        headings[p] += headings[i] + (nodes[i].tag == "h1")
    mine = np.zeros((n, _GROUPS))
    above = np.zeros((n, _GROUPS))
    inside = np.zeros((n, _KIND_COUNT))
    for i, node in enumerate(nodes):
        for group in node.groups:
            mine[i, group] = 1
        if i:
            above[i] = np.maximum(above[node.parent], mine[node.parent])
            inside[i] = inside[node.parent]
            inside[i, kinds[node.parent]] = 1
    total = max(1.0, chars[0])
    up = np.maximum(parents, 0)
    siblings = np.bincount(up[1:], minlength=n) if n > 1 else np.zeros(n)
    same = np.zeros(n)
    before, after = np.zeros(n), np.zeros(n)
    for node in nodes:
        children = [number for is_text, number in node.items if not is_text]
        for a, b in zip(children, children[1:], strict=False):
            before[b], after[a] = chars[a], chars[b]
            if nodes[a].tag == nodes[b].tag:
                same[a] = same[b] = 1
    density = linked / np.maximum(chars, 1)
    table = [
        np.array([node.depth for node in nodes], dtype=float),
        starts / total,
        np.log1p(chars),
        chars / total,
        density,
        np.log1p(links),
        np.log1p(tags),
        chars / (tags + 1),
        np.log1p(paragraphs),
        chars / np.maximum(blocks, 1),
        marks / np.maximum(chars, 1),
        listed / (tags + 1),
        headings,
        longest / total,
        own / np.maximum(chars, 1),
        np.log1p(blocks),
        siblings[up],
        chars / np.maximum(chars[up], 1),
        same,
        chars[up] / total,
    ]
    one_hot = np.eye(_KIND_COUNT)[kinds]
    more = [np.log1p(before), np.log1p(after), density[up]]
    more += [np.full(n, np.log1p(total)), (starts + chars) / total, paragraphs[up] / (tags[up] + 1)]
    more += [inside[:, k] for k in (0, 1, 2, 3, 4, 5, 6)]
    more += [headings[up], np.log1p(paragraphs[up]), longest[up] / total, one_hot[up], mine[up]]
    return np.column_stack([*table, one_hot, mine, above, *more]).astype(np.float32)

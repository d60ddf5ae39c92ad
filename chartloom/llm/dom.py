"""Web pages as trees of blocks: a forgiving reader of markup that gives every text block the place it stands at.

Only elements that break lines, or that never show text, are nodes; others are part of the text around them. Tags that
markup may leave out are closed as browsers do (a paragraph by the next block, a list item by the next one), comments and
the insides of scripts and the like are left out, and an end tag without a start is ignored. A truncated page gives what it has.

The skeleton of a page is its tree without text, one line for each node: depth and label (element, words of class, id
and role, without digits). More than `RUN` equal siblings in a row, and flow elements such as paragraphs and list items always,
are one node; of more than `WIDTH` children those of one element are one node; deeper than `DEPTH` all is one level. No text is lost by this.
"""

from __future__ import annotations

import html
import re

RUN, WIDTH, DEPTH = 8, 64, 100

# Elements by how they take part in a page.
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark math nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes template svg select".split())
FLOW = set("p li dt dd h1 h2 h3 h4 h5 h6 tr td th blockquote pre option figcaption".split())
#: What a start tag closes, and the elements that keep it from closing further out.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}), "body": ({"head"}, {"html"}),
}
#: Blocks that end a paragraph.
NO_PARAGRAPH = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul li dt dd".split()
)

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*+(?:>|\Z)|(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)|/[^>]*+(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|itemprop|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW}


def label_of(tag: str, attributes: str) -> str:
    """The element, then the words of class, id and role, in order and without digits."""
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return tag
    words: set[str] = set()
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            words.add("hidden")
        elif name in ("class", "id", "role", "itemprop"):
            # `no-sidebar` says that there is none.
            value = re.sub(r"\b(?:no|has|with|without|hide|show)[-_]\w+", " ", value)
            words |= {w.lower() for w in _NAME.findall(html.unescape(value))}
    return ".".join([tag, *sorted(words)])


class Page:
    """Reads a page; `labels` and `parents` are its nodes, `blocks` the texts with their node and the code points in links."""

    def __init__(self, markup: str) -> None:
        self.labels, self.parents, self.depths, self.blocks = ["page"], [-1], [0], []
        self._stack: list[tuple[str, int]] = [("page", 0)]
        self._parts: list[str] = []
        self._linked, self._in_link = 0, False
        self._read(markup)
        self._flush()

    def _flush(self) -> None:
        if self._parts:
            text = " ".join(html.unescape("".join(self._parts)).split())
            if text:
                self.blocks.append((self._stack[-1][1], text, min(self._linked, len(text))))
            self._parts, self._linked = [], 0

    def _text(self, text: str) -> None:
        if text:
            self._parts.append(text)
            if self._in_link:
                self._linked += len(text)

    def _read(self, markup: str) -> None:
        at = 0
        for_tag = _TAG.search
        while m := for_tag(markup, at):
            self._text(markup[at : m.start()])
            at = m.end()
            tag = m[2] or m[5]
            if tag is None:
                continue
            tag, closing, attributes = tag.lower(), m[1] or m[4], m[3] if m[2] else m[6]
            if not m[2] and at == len(markup) and not markup.endswith(">"):
                continue  # cut off inside a tag
            if tag in INLINE:
                self._inline(tag, closing)
            elif closing:
                self._close(tag)
            else:
                self._open(tag, attributes)
                if tag in RAW and not attributes.rstrip().endswith("/"):
                    end = _END[tag].search(markup, at)
                    at = end.end() if end else len(markup)
                    self._stack.pop()
        self._text(markup[at:])

    def _inline(self, tag: str, closing: str) -> None:
        if tag == "br":
            self._parts.append(" ")
        elif tag == "a":
            self._in_link = not closing

    def _open(self, tag: str, attributes: str) -> None:
        self._flush()
        self._in_link = False
        if tag in NO_PARAGRAPH:
            self._close_to({"p"}, {"td", "th", "table", "button", "object"})
        if tag in CLOSES:
            self._close_to(*CLOSES[tag])
        if tag in ("html", "body") and any(t == tag for t, _ in self._stack):
            return
        parent = self._stack[-1][1]
        if self.depths[parent] < DEPTH:
            self.labels.append(label_of(tag, attributes))
            self.parents.append(parent)
            self.depths.append(self.depths[parent] + 1)
            parent = len(self.labels) - 1
        if tag not in VOID:
            self._stack.append((tag, parent))

    def _close_to(self, tags: set[str], bounds: set[str]) -> None:
        for k in range(len(self._stack) - 1, 0, -1):
            if self._stack[k][0] in tags:
                del self._stack[k:]
                return self._close_to(tags, bounds)
            if self._stack[k][0] in bounds:
                return

    def _close(self, tag: str) -> None:
        self._flush()
        self._in_link = False
        for k in range(len(self._stack) - 1, 0, -1):
            if self._stack[k][0] == tag:
                del self._stack[k:]
                return
            # A cell or a list item is not left by an end tag from inside it.
            if self._stack[k][0] in ("table", "td", "th") and tag in ("p", "div", "li", "ul", "ol"):
                return


def skeleton_of(page: Page) -> tuple[list[tuple[int, str]], list[int]]:
    """Depth and label of the merged nodes in page order, and each node's place among them."""
    children: list[list[int]] = [[] for _ in page.labels]
    for node, parent in enumerate(page.parents):
        if parent >= 0:
            children[parent].append(node)
    place, out = [0] * len(page.labels), []
    # Nodes that are one in the skeleton are visited together.
    todo = [([0], 0, page.labels[0])]
    while todo:
        nodes, depth, label = todo.pop()
        for node in nodes:
            place[node] = len(out)
        out.append((depth, label))
        below = [c for node in nodes for c in children[node]]
        todo += [(group, depth + 1, name) for name, group in reversed(_merged(below, page.labels))]
    return out, place


def _merged(nodes: list[int], labels: list[str]) -> list[tuple[str, list[int]]]:
    """Siblings put together: flow elements of one label, and long runs."""
    groups: list[tuple[str, list[int]]] = []
    flow: dict[str, list[int]] = {}
    for node in nodes:
        label = labels[node]
        if label.partition(".")[0] in FLOW:
            if label not in flow:
                flow[label] = []
                groups.append((label, flow[label]))
            flow[label].append(node)
        else:
            groups.append((label, [node]))
    out: list[tuple[str, list[int]]] = []
    at = 0
    while at < len(groups):
        end = at
        while end < len(groups) and groups[end][0] == groups[at][0]:
            end += 1
        if end - at > RUN:
            out.append((groups[at][0], [n for _, g in groups[at:end] for n in g]))
        else:
            out += groups[at:end]
        at = end
    if len(out) > WIDTH:
        by_tag: dict[str, list[int]] = {}
        for label, group in out:
            by_tag.setdefault(label.partition(".")[0], []).extend(group)
        out = list(by_tag.items())
    return out

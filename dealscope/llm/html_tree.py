"""A small tolerant HTML tree: block nodes, their text in order, and features for learning."""

from __future__ import annotations

import html
import math
import re

#: Tag sets of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg textarea title select object canvas video audio annotation annotation-xml".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
BLOCKS = CLOSES_P | frozenset("li dt dd tr td th caption thead tbody tfoot summary legend option body html search button".split())
SAME_LEVEL = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "p": ("p",)}
SCOPE = frozenset("html body table ul ol dl div article section main aside nav header footer form td th blockquote".split())

#: Words in class, id and role that pages use for a part; one feature each.
TOKENS = {
    "content": "content article post entry story main text body prose page copy read",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs topbar tabs pager pagination toc skip",
    "head": "header masthead head logo banner brand hero",
    "foot": "footer foot copyright legal colophon bottom",
    "side": "sidebar side aside widget related rail recommended trending popular more teaser",
    "advert": "ad ads advert advertisement adverts sponsor sponsored promo promotion dfp adsense",
    "notice": "cookie cookies consent notice alert popup modal overlay banner gdpr warning disclaimer paywall",
    "comment": "comment comments reply replies respond disqus discussion feedback reader",
    "form": "form search login signup signin subscribe newsletter subscription register contact",
    "share": "share sharing social follow tags tag meta byline author tools print",
}
_GROUP_OF: dict[str, list[int]] = {}
for _k, _words in enumerate(TOKENS.values()):
    for _w in _words.split():
        _GROUP_OF.setdefault(_w, []).append(_k)
TAGS = ("article", "main", "section", "div", "p", "heading", "list", "item", "table", "nav", "header", "footer", "aside", "form", "quote", "figure", "body", "other")
_TAG_OF = {t: t for t in TAGS} | {f"h{k}": "heading" for k in range(1, 7)} | {"ul": "list", "ol": "list", "dl": "list", "menu": "list", "li": "item", "dt": "item", "dd": "item"}
_TAG_OF |= {t: "table" for t in ("table", "tbody", "thead", "tfoot", "tr", "td", "th")} | {"blockquote": "quote", "pre": "quote", "figcaption": "figure", "fieldset": "form", "button": "form", "option": "form"}
_TAG_NO = {t: k for k, t in enumerate(TAGS)}

# a quote counts only at the beginning of an attribute's value; elsewhere it is a plain character
_VALUE = r"""=\s*+(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*+)?"""
_TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|{_VALUE})*)(?:>|\Z)|[^<]+|<", re.S)
_ATTR = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")
_TELLING = frozenset(("class", "id", "role", "aria-label", "itemprop"))
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")


class Node:
    __slots__ = ("tag", "parent", "depth", "groups", "kids", "parts", "y", "chars", "links", "words", "marks", "paras", "nodes", "at", "above", "inside", "place")

    def __init__(self, tag: str, parent: Node | None, groups: int):
        self.tag, self.parent, self.groups = tag, parent, groups
        self.depth = parent.depth + 1 if parent else 0
        self.above = (parent.above | parent.groups) if parent else 0
        self.inside = (parent.inside | 1 << _TAG_NO[_TAG_OF.get(parent.tag, "other")]) if parent else 0
        self.kids: list[Node] = []
        self.parts: list[str | Node] = []  # own text and child nodes in page order
        self.y = 0
        self.chars = self.links = self.words = self.marks = self.paras = self.nodes = self.at = self.place = 0


def _groups(attrs: str) -> int:
    found = 0
    if "=" in attrs:
        for m in _ATTR.finditer(attrs):
            if m[1].lower() not in _TELLING:
                continue
            for w in _SPLIT.split((m[2] or m[3] or m[4] or "").lower()):
                for k in _GROUP_OF.get(w, ()):
                    found |= 1 << k
    return found


def parse(page: str) -> list[Node]:
    """The page's block nodes in page order, the root first.

    Raw elements (scripts, styles and the like) are left out.  Other elements than
    blocks are part of their block unless their attributes name a page part.  Character
    references are decoded in each piece of text, before pieces are joined.
    """
    root = Node("body", None, 0)
    nodes, here, link = [root], root, 0
    skip_until = 0
    for m in _TOKEN.finditer(page):
        if m.start() < skip_until:
            continue
        tag = m[2]
        if tag is None:
            raw = m[0]
            if raw[0] != "<" or raw == "<":
                raw = html.unescape(raw) if "&" in raw else raw
                here.parts.append(raw)
                n = len(raw.strip())
                if n:
                    here.chars += n
                    here.words += raw.count(" ") + 1
                    here.marks += raw.count(".") + raw.count(",")
                    if link:
                        here.links += n
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                link = max(0, link - 1)
            if tag in ("html", "body"):
                continue
            up = here
            while up is not None and up.tag != tag:
                if tag not in BLOCKS and up.tag in BLOCKS:
                    up = None
                    break
                up = up.parent
            if up is not None and up.parent is not None:
                here, link = up.parent, 0 if tag in BLOCKS else link
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, m.end())
            if end and not (m[3].rstrip().endswith("/") and tag in ("svg", "annotation")):
                skip_until = end.end()
            elif not end and tag in ("script", "style"):
                break
            continue
        if tag in ("html", "head", "body"):
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                here.parts.append(" ")
            continue
        groups = _groups(m[3])
        if tag not in BLOCKS and not groups & ~1:
            if tag == "a":
                link += 1
            continue
        if tag in CLOSES_P:
            up = here
            while up is not None and up.tag not in SCOPE and up.tag != "p":
                up = up.parent
            if up is not None and up.tag == "p" and up.parent is not None:
                here, link = up.parent, 0
        for mate in SAME_LEVEL.get(tag, ()):
            up = here
            while up is not None and up.tag != mate and up.tag not in SCOPE - {"td", "th"}:
                up = up.parent
            if up is not None and up.tag == mate and up.parent is not None:
                here, link = up.parent, 0
        node = Node(tag, here, groups)
        node.place = len(here.kids)
        here.kids.append(node)
        here.parts.append(node)
        nodes.append(node)
        if not m[3].rstrip().endswith("/"):
            here = node
    return nodes


#: Features of a node, in order.
N_FEATURES = 2 * len(TAGS) + 2 * len(TOKENS) + 22


def features(nodes: list[Node]) -> list[list[float]]:
    """One row a node: own and enclosing tags and attribute tokens, depth, density and siblings."""
    for k, v in enumerate(nodes):
        v.at = k
        v.nodes = 1
        v.paras = int(v.tag == "p")
    own = [(v.chars, v.words) for v in nodes]
    for v in reversed(nodes):
        if (p := v.parent) is not None:
            p.chars += v.chars
            p.links += v.links
            p.words += v.words
            p.marks += v.marks
            p.paras += v.paras
            p.nodes += v.nodes
    total = max(1, nodes[0].chars)
    largest = [max((s.chars for s in v.kids), default=0) for v in nodes]
    n_groups, out, seen = len(TOKENS), [], 0
    for v, (chars, _) in zip(nodes, own, strict=True):
        row = [0.0] * N_FEATURES
        row[_TAG_NO[_TAG_OF.get(v.tag, "other")]] = 1.0
        k = len(TAGS)
        for g in range(k):
            if v.inside >> g & 1:
                row[k + g] = 1.0
        k *= 2
        for g in range(n_groups):
            if v.groups >> g & 1:
                row[k + g] = 1.0
            if v.above >> g & 1:
                row[k + n_groups + g] = 1.0
        k += 2 * n_groups
        p = v.parent or v
        sib = p.kids if v.parent else [v]
        before = sib[v.place - 1] if v.parent and v.place else None
        after = sib[v.place + 1] if v.parent and v.place + 1 < len(sib) else None
        size = max(1, v.chars)
        row[k : k + 22] = [
            v.depth,
            math.log1p(v.chars),
            v.chars / total,
            v.links / size,
            v.chars / v.nodes,
            v.marks / max(1, v.words),
            v.chars / max(1, v.words),
            math.log1p(v.paras),
            len(sib),
            seen / total,
            p.chars / total,
            (largest[p.at] if v.parent else v.chars) / size,
            chars / size,
            v.at / len(nodes),
            p.links / max(1, p.chars),
            math.log1p(p.chars),
            math.log1p(p.paras),
            p.marks / max(1, p.words),
            before.links / max(1, before.chars) if before else -1.0,
            math.log1p(before.chars) if before else -1.0,
            after.links / max(1, after.chars) if after else -1.0,
            math.log1p(after.chars) if after else -1.0,
        ]
        seen += chars
        out.append(row)
    return out


def text_of(nodes: list[Node], keep: list[bool]) -> str:
    """Own text of the kept nodes: blocks in page order, white space as one space, joined by two newlines."""
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if run and (s := " ".join("".join(run).split())):
            blocks.append(s)
        run.clear()

    stack: list[tuple[Node, int]] = [(nodes[0], 0)]
    while stack:
        v, k = stack.pop()
        block = v.tag in BLOCKS
        if k == 0 and block:
            flush()
        while k < len(v.parts):
            part = v.parts[k]
            k += 1
            if isinstance(part, Node):
                stack.append((v, k))
                stack.append((part, 0))
                break
            if keep[v.at]:
                run.append(part)
        else:
            if block:
                flush()
    flush()
    return "\n\n".join(blocks)

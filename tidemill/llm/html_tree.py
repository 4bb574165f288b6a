"""A small forgiving HTML parser: elements in page order, with parents, and the text of each in pieces."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_TOKEN = re.compile(
    r"""<(?:!--(?:.*?-->|[^>]*+>?)            # a comment, closed or not
        |[!?][^>]*+>                          # a declaration
        |(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>)""",
    re.S | re.X,
)
_ATTR = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Elements without content, those whose content isn't markup, and those that stand in lines.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Open elements that a start tag ends, up to an element that holds them.
_P_ENDERS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)} | dict.fromkeys(_P_ENDERS, ("p",))
_HOLDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
_P_HOLDS = ("td", "th", "table", "button", "object", "li", "body", "div", "article", "section", "main")


@dataclass
class Tree:
    tag: list[str] = field(default_factory=list)
    attrs: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    last: list[int] = field(default_factory=list)  # the element's last descendant, or itself
    pieces: list[tuple[int, str]] = field(default_factory=list)  # (element, raw text); (-1, "") is a block's border


def attributes(raw: str) -> dict[str, str]:
    return {k.lower(): a or b or c or "" for k, a, b, c in _ATTR.findall(raw)}


def parse(html: str) -> Tree:
    """The tree of a page. Element 0 is a root without tag; unclosed elements end with what holds them. Text and inline
    elements that nothing holds are in a body of their own, and so is what follows them, as in browsers."""
    t = Tree([""], [""], [-1], [0], [0], [])
    open_, at = [0], 0
    pieces = t.pieces

    def close(to: int) -> None:
        end = len(t.tag) - 1
        while len(open_) > to:
            t.last[open_.pop()] = end

    def begin_at(tag: str, attrs: str) -> int:
        t.tag.append(tag)
        t.attrs.append(attrs)
        t.parent.append(open_[-1])
        t.depth.append(len(open_))
        t.last.append(len(t.tag) - 1)
        return len(t.tag) - 1

    n = len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        begin = m.start() if m else n
        if begin > at:
            if len(open_) == 1 and not html[at:begin].isspace():
                open_.append(begin_at("body", ""))
            pieces.append((open_[-1], html[at:begin]))
        if not m:
            break
        at = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if tag not in INLINE:
            pieces.append((-1, ""))
        if m["end"]:
            for d in range(len(open_) - 1, 0, -1):
                if t.tag[open_[d]] == tag:
                    close(d)
                    break
            continue
        if ended := _ENDS.get(tag):
            holds = _HOLDS.get(tag, _P_HOLDS)
            for d in range(len(open_) - 1, 0, -1):
                name = t.tag[open_[d]]
                if name in ended:
                    close(d)
                    if tag != "tr":
                        break
                elif name in holds:
                    break
        if tag in INLINE and len(open_) == 1:
            open_.append(begin_at("body", ""))
        own = begin_at(tag, m["attrs"])
        if tag in VOID or m["attrs"].endswith("/") and tag not in RAW and tag not in _P_ENDERS:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
            stop = end.start() if end else n
            pieces.append((own, html[at:stop]))
            at = html.find(">", stop) + 1 if end else n
            at = at or n
            continue
        open_.append(own)
    close(0)
    return t

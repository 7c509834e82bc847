"""Leaf blocks of an HTML page: runs of text between block-level tags, with the elements around them.

Markup is read as HTML reads it: a quote opens an attribute's value only after `=`, `<!-->` is a whole
comment, and the elements of HIDDEN hold raw text up to their own end tag. What a browser doesn't show as
text of the page (controls, drawings, fallbacks for media) is left out where the element is closed;
one that never is holds nothing back, so a stray start tag costs no text. Elements are shared
between blocks by links to their parents, so deep nesting costs no more than its tags.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

COMMENT = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))", re.S)
#: Declarations, instructions and end tags without a name.
BOGUS = re.compile(r"<(?:[!?]|/(?![a-zA-Z]))[^>]*(?:>|\Z)")
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+)*+)(?:>|\Z)""")
ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+)))?""")
NAMED = re.compile(r"class|id|role|itemprop|style|hidden", re.I)
TOKEN = re.compile(r"[a-z]+")

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style textarea title iframe noembed noframes noscript".split())
UNSHOWN = frozenset("select button svg canvas audio video object template datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math q ruby rb rp rt s samp small span strike strong sub sup time tt u var img br wbr input".split())
INLINE |= frozenset("mi mn mo ms mtext mspace mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mtable mtr mtd mfenced menclose mpadded mphantom mstyle merror semantics annotation".split())
#: A start tag closes the nearest of these that is open, up to a scope.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("table ul ol dl td th body html article section div form".split()) | UNSHOWN


class Element:
    """An open element: its tag, the words that name it, its parent, and the features of it and all around it."""

    __slots__ = ("tag", "names", "parent", "features")

    def __init__(self, tag: str, names: tuple[str, ...], parent: Element | None):
        self.tag, self.names, self.parent = tag, names, parent
        above = parent.features if parent else frozenset()
        own = {f"up={tag}", *(f"name={x}" for x in names)}
        self.features: frozenset[str] = above if own <= above else above | own

    def path(self) -> Iterator[Element]:
        """This element and those around it, from the inside."""
        at: Element | None = self
        while at:
            yield at
            at = at.parent


@dataclass(slots=True)
class Block:
    """Text of a leaf block; inside: the innermost element around it; links: characters inside links."""

    text: str
    inside: Element | None
    links: int


def names_of(attributes: str) -> tuple[str, ...]:
    """Words of the attributes that name an element, and `hidden` if it isn't shown."""
    if not NAMED.search(attributes):
        return ()
    out: list[str] = []
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id", "role", "itemprop"):
            out += TOKEN.findall(value)
        elif key == "hidden" or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)) or (key == "aria-hidden" and value == "true"):
            out.append("hidden")
    return tuple(dict.fromkeys(out))


class Reader:
    """Reads one page. known: the words of names that matter; others are left out, where the set is given."""

    def __init__(self, known: frozenset[str] | None = None):
        self.known = known
        self.out: list[Block] = []
        self.stack: list[Element] = []
        self.ends: dict[str, re.Pattern] = {}
        #: Of open unshown elements: place in the stack, and blocks, pieces and counts before it.
        self.unshown: list[tuple[int, int, list[str], int, int]] = []
        self.pieces: list[str] = []
        self.link = self.linked = 0

    def flush(self) -> None:
        if self.pieces:
            text = " ".join(unescape("".join(self.pieces)).split())
            if text:
                self.out.append(Block(text, self.stack[-1] if self.stack else None, self.linked))
            self.pieces = []
        self.linked = 0

    def close(self, upto: int) -> None:
        self.link -= sum(e.tag == "a" for e in self.stack[upto:])
        del self.stack[upto:]
        while self.unshown and self.unshown[-1][0] >= upto:
            self.unshown.pop()

    def text(self, raw: str) -> None:
        self.pieces.append(raw)
        if self.link:
            self.linked += len(raw.strip())

    def end(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            open_ = self.stack[k].tag
            if open_ == tag:
                if tag in UNSHOWN and (before := next((u for u in self.unshown if u[0] == k), None)):
                    _, blocks_, self.pieces, self.linked, _ = before
                    del self.out[blocks_:]
                    self.close(k)
                    self.link = before[4]
                    self.pieces.append(" ")
                    return
                if tag not in INLINE:
                    self.flush()
                self.close(k)
                return
            if tag in INLINE and open_ not in INLINE:
                return
        if tag not in INLINE and tag not in UNSHOWN:
            self.flush()

    def start(self, tag: str, attributes: str) -> None:
        if tag in VOID:
            if tag not in INLINE:
                self.flush()
            elif tag == "br":
                self.pieces.append(" ")
            return
        if tag in UNSHOWN:
            self.unshown.append((len(self.stack), len(self.out), list(self.pieces), self.linked, self.link))
            self.pieces.append(" ")
        elif tag not in INLINE:
            self.flush()
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k].tag == "p" or self.stack[k].tag in CLOSES.get(tag, ()):
                    self.close(k)
                    break
                if self.stack[k].tag in SCOPE:
                    break
        elif tag == "a":
            self.link += 1
        names = names_of(attributes)
        if self.known is not None:
            names = tuple(x for x in names if x in self.known)
        self.stack.append(Element(tag, names, self.stack[-1] if self.stack else None))

    def raw(self, html: str, tag: str, attributes: str, at: int) -> int:
        """Where the page goes on after the text of a hidden element."""
        if tag not in self.ends:
            self.ends[tag] = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I)
        end = self.ends[tag].search(html, at)
        self.pieces.append(" ")
        if end:
            return end.end()
        return at if attributes.endswith("/") else len(html)

    def read(self, html: str) -> list[Block]:
        at, size = 0, len(html)
        while at < size:
            start = html.find("<", at)
            if start < 0:
                self.text(html[at:])
                break
            m = (COMMENT.match(html, start) if html.startswith("<!--", start) else None) or TAG.match(html, start) or BOGUS.match(html, start)
            if m is None:  # a bare < is text
                self.text(html[at : start + 1])
                at = start + 1
                continue
            if start > at:
                self.text(html[at:start])
            at = m.end()
            if m.re is TAG:
                tag = m[2].lower()
                if m[1]:
                    self.end(tag)
                elif tag in HIDDEN:
                    at = self.raw(html, tag, m[3], at)
                else:
                    self.start(tag, m[3])
        self.flush()
        return self.out


def blocks(html: str, known: frozenset[str] | None = None) -> list[Block]:
    """The page's leaf blocks with text, in page order."""
    return Reader(known).read(html)

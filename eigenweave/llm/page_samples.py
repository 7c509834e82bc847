"""Labelled pages to train and test extraction on: random layouts around an article of invented prose."""

from __future__ import annotations

import random
from html import escape

#: Names that sites give to elements, by what these hold.
CONTENT_NAMES = ["content", "post-content", "entry-content", "article-body", "story", "main", "post", "page-content", "text", "body-copy", "hentry", "article__text"]
SIDE_NAMES = ["sidebar", "widget", "related", "related-posts", "recommended", "popular", "side", "secondary", "tags", "rail", "most-read"]
AD_NAMES = ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "ad-slot", "adsbox"]
NOTICE_NAMES = ["cookie-notice", "cookie-banner", "gdpr", "consent", "alert", "notice", "paywall", "newsletter", "modal", "popup", "disclaimer"]
COMMENT_NAMES = ["comments", "comment-list", "discussion", "responses", "disqus", "reader-comments", "replies"]
HEAD_NAMES = ["header", "masthead", "site-header", "top", "topbar", "branding", "logo"]
MENU_NAMES = ["menu", "nav", "navbar", "navigation", "breadcrumbs", "breadcrumb", "main-menu", "links", "pagination", "toc"]
FOOT_NAMES = ["footer", "site-footer", "copyright", "legal", "colophon", "bottom"]
META_NAMES = ["byline", "meta", "share", "social", "post-meta", "author-box", "sharing", "date"]
SYLLABLES = "an be cha de el fi ga ho is ka lo mer ni on pra qui ro sa ti und ver wa xi ou zel th ing er st re ion ment ück ção é ñe".split()
BOILER = "Home News Sport Contact About Login Register Search Privacy Terms Imprint Help Subscribe Share Tweet Reply More Next Previous Archive Shop Jobs".split()


class Pages:
    """page() gives (html, [(text, 1 if it belongs to the article)]) in page order."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.choice((1, 1, 2, 2, 3))))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def sentence(self) -> str:
        s = self.words(4, 16).capitalize()
        return s + self.r.choice(".....?!,") if self.r.random() < 0.95 else s

    def prose(self, low: int = 1, high: int = 6) -> str:
        text = " ".join(self.sentence() for _ in range(self.r.randint(low, high)))
        if self.r.random() < 0.12:
            text = text.upper().replace(" ", self.r.choice((" ", "!! ", " ", "### ")))
        odd = self.r.random()
        if odd < 0.06:
            text = text.replace(" ", self.r.choice((" | ", " * ", " - "))) + self.r.choice(("", " |"))
        elif odd < 0.12:
            text += "".join(f" {self.r.randrange(10**self.r.randint(2, 16))} {self.word()}" for _ in range(3)) + "."
        return text + self.r.choice(("", "", "", " & co", " <3"))

    def put(self, tag: str, text: str, label: int, attrs: str = "", inner: str | None = None) -> None:
        r, shown = self.r, " ".join(text.split())
        body = inner if inner is not None else escape(text, quote=False)
        if inner is None and r.random() < 0.15 and len(shown.split()) > 6:
            cut = body.split(" ")
            k = r.randrange(len(cut) - 2)
            cut[k] = f'<{(t := r.choice(("b", "em", "a", "span", "strong")))}{" href=/x" if t == "a" else ""}>{cut[k]}</{t}>'
            body = " ".join(cut)
        end = "" if tag in ("p", "li") and r.random() < 0.15 else f"</{tag}>"
        if tag == "p" and r.random() < 0.08:
            body = f"<b>{body}<br>"
        self.html.append(f"<{tag}{attrs}>{body}{end}{r.choice(('', chr(10), ' '))}")
        self.truth.append((shown, label))

    def named(self, names: list[str], sure: float = 0.75) -> str:
        r = self.r
        if r.random() > sure:
            return r.choice(("", f' class="c{r.randrange(99)}"'))
        return f' {r.choice(("class", "class", "id"))}="{r.choice(names)}"'

    def wrap(self, tag: str, attrs: str, fill) -> None:
        self.html.append(f"<{tag}{attrs}>")
        fill()
        self.html.append(f"</{tag}>")

    def links(self, low: int, high: int, tag: str = "li") -> None:
        for _ in range(self.r.randint(low, high)):
            text = self.r.choice((self.r.choice(BOILER), self.word().capitalize(), self.words(2, 7).capitalize()))
            self.put(tag, text, 0, inner=f'<a href="/{self.word()}">{escape(text)}</a>')

    def menu(self) -> None:
        r = self.r
        tag, attrs = r.choice((("nav", ""), ("nav", self.named(MENU_NAMES)), ("div", self.named(MENU_NAMES, 0.9)), ("ul", self.named(MENU_NAMES, 0.9))))
        self.wrap(tag, attrs, (lambda: self.links(3, 9)) if tag == "ul" else lambda: self.wrap("ul", "", lambda: self.links(3, 9)) if r.random() < 0.7 else self.links(2, 6, "div"))

    def head(self) -> None:
        def fill() -> None:
            self.put(self.r.choice(("div", "p", "h1", "h2")), self.words(1, 4).title(), 0)
            if self.r.random() < 0.4:
                self.put("p", self.sentence(), 0)
            if self.r.random() < 0.5:
                self.menu()

        tag = self.r.choice(("header", "div"))
        self.wrap(tag, self.named(HEAD_NAMES, 0.5 if tag == "header" else 1), fill)

    def advert(self) -> None:
        tag = self.r.choice(("div", "div", "aside", "section", "p"))
        text = self.r.choice((self.sentence(), self.words(2, 8), self.prose(1, 2)))
        self.put(tag, text, 0, self.named(AD_NAMES, 1), inner=f'<a href="http://x.example">{escape(text)}</a>' if self.r.random() < 0.4 else None)

    def notice(self) -> None:
        self.wrap(self.r.choice(("div", "section", "aside")), self.named(NOTICE_NAMES, 1), lambda: (self.put("p", self.r.choice(("We use cookies. ", "Cookies: ", "", "")) + self.prose(1, 3), 0), self.r.random() < 0.5 and self.html.append("<button>OK</button>")))

    def form(self) -> None:
        def fill() -> None:
            for _ in range(self.r.randint(1, 3)):
                self.put(self.r.choice(("label", "p", "div", "legend")), self.words(1, 5).capitalize(), 0)
                self.html.append("<br><hr>")
            self.html.append('<input type="text" value="x"><button>Go</button>')

        self.html.append("<hr>")
        self.wrap("form", self.r.choice(("", ' action="/s"', ' class="search"')), fill)

    def side(self) -> None:
        def fill() -> None:
            self.put(self.r.choice(("h3", "h4", "div", "h2")), self.words(1, 3).title(), 0)
            if self.r.random() < 0.75:
                self.wrap("ul", "", lambda: self.links(2, 7))
            else:
                self.put("p", self.prose(1, 2), 0)

        tag = self.r.choice(("aside", "div", "section"))
        self.wrap(tag, self.named(SIDE_NAMES, 0.5 if tag == "aside" else 1), fill)

    def foot(self) -> None:
        def fill() -> None:
            if self.r.random() < 0.5:
                self.links(1, 5, "li")
            text = self.r.choice(("© ", "Copyright ", "")) + self.words(1, 5) + self.r.choice((" · ", " 2024 ", ". ")) + self.sentence()
            self.put(self.r.choice(("p", "div", "small-print", "p")), text, 0)

        tag = self.r.choice(("footer", "footer", "div"))
        self.wrap(tag, self.named(FOOT_NAMES, 0.3 if tag == "footer" else 1), fill)

    def comments(self) -> None:
        def fill() -> None:
            self.put(self.r.choice(("h2", "h3", "div")), f"{self.r.randint(1, 99)} {self.r.choice(('comments', 'responses', 'Kommentare', self.word()))}", 0)
            for _ in range(self.r.randint(1, 5)):
                tag = self.r.choice(("div", "li", "article"))
                self.wrap(tag, self.named(["comment", "reply", "comment-body", "response"], 0.9), lambda: (self.put(self.r.choice(("div", "span-author", "p")), self.words(1, 2).title(), 0), self.put("p", self.prose(1, 4), 0)))

        self.wrap(self.r.choice(("section", "div", "ul")), self.named(COMMENT_NAMES, 1), fill)

    def article(self) -> None:
        r = self.r
        if r.random() < 0.85:
            self.put(r.choice(("h1", "h1", "h2")), self.words(3, 12).capitalize() + r.choice(("", "", ".", "!!")), 1)
        if r.random() < 0.25:
            self.put(r.choice(("div", "p")), self.words(2, 5).title(), 0, self.named(META_NAMES, 1))
        for _ in range(r.choice((1, 1, 2, 3, 5, 8, 14))):
            kind = r.random()
            if kind < 0.06:
                self.put(r.choice(("h2", "h3")), self.words(2, 7).capitalize(), 1)
            elif kind < 0.11:
                self.wrap(r.choice(("ul", "ol")), "", lambda: [self.put("li", self.words(3, 15).capitalize(), 1) for _ in range(r.randint(2, 5))])
            elif kind < 0.14:
                self.wrap("blockquote", "", lambda: self.put("p", self.prose(1, 3), 1))
            elif kind < 0.17:
                self.wrap("table", "", lambda: [self.wrap("tr", "", lambda: [self.put("td", self.words(1, 4), 1) for _ in range(3)]) for _ in range(r.randint(1, 3))])
            elif kind < 0.22:
                r.choice((self.advert, self.advert, self.notice, self.side, self.form))()
            elif kind < 0.26:
                self.put("div", self.prose(), 1)
            for _ in range(r.choice((1, 1, 1, 3))):
                self.put("p", self.prose() if r.random() < 0.75 else self.words(1, 3).capitalize() + r.choice((".", ".", "", "!")), 1)

    def page(self) -> tuple[str, list[tuple[str, int]]]:
        r = self.r
        self.html: list[str] = []
        self.truth: list[tuple[str, int]] = []
        before = [f for f, p in ((self.notice, 0.2), (self.head, 0.6), (self.menu, 0.75), (self.form, 0.15), (self.advert, 0.45), (self.side, 0.15)) if r.random() < p]
        after = [f for f, p in ((self.comments, 0.35), (self.side, 0.4), (self.advert, 0.3), (self.form, 0.25), (self.menu, 0.2), (self.notice, 0.15), (self.foot, 0.85)) if r.random() < p]
        if r.random() < 0.3:
            r.shuffle(before)
        for f in before:
            f()
        if r.random() < 0.96:
            tag, attrs = r.choice((("article", ""), ("article", self.named(CONTENT_NAMES)), ("main", ""), ("div", self.named(CONTENT_NAMES, 0.85)), ("section", self.named(CONTENT_NAMES, 0.85))))
            if r.random() < 0.3:
                self.wrap("div", self.named(["wrap", "container", "row", "page", "inner"], 0.8), lambda: self.wrap(tag, attrs, self.article))
            else:
                self.wrap(tag, attrs, self.article)
        for f in after:
            f()
        head = f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{self.words(2, 6)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>'
        return head + "".join(self.html) + r.choice(("</body></html>", "")), self.truth

"""Labelled pages to train the extraction on: pages of many layouts, whose blocks are known to be
main text or not. Words are made up, so that nothing can be learned from them."""

from __future__ import annotations

import numpy as np

_SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe ri so tu va we xi yo zu ar en il or un".split()


class _Writer:
    def __init__(self, seed: int) -> None:
        self.rng = np.random.default_rng(seed)
        self.out: list[str] = []
        self.labels: list[tuple[str, int]] = []

    def chance(self, share: float) -> bool:
        return self.rng.random() < share

    def pick(self, options: str) -> str:
        return str(self.rng.choice(options.split("|")))

    def words(self, low: int, high: int) -> str:
        count = int(self.rng.integers(low, high + 1))
        return " ".join("".join(self.rng.choice(_SYLLABLES, self.rng.integers(1, 5))) for _ in range(count))

    def sentences(self, low: int, high: int) -> str:
        ends = [self.words(3, 16).capitalize() + self.pick(".|.|.|?|!") for _ in range(self.rng.integers(low, high + 1))]
        return " ".join(ends)

    def put(self, markup: str) -> None:
        self.out.append(markup)

    def block(self, opening: str, text: str, closing: str, label: int) -> None:
        self.out.append(f"{opening}{text}{closing}")
        self.labels.append((text, label))

    def links(self, wrap: str, low: int, high: int) -> None:
        for _ in range(self.rng.integers(low, high + 1)):
            self.block(f'<{wrap}><a href="/{self.words(1, 1)}">', self.words(1, 3), f"</a></{wrap}>", 0)

    def box(self, tags: str, names: str) -> str:
        tag, name = self.pick(tags), self.pick(names)
        self.put(f'<{tag} {self.pick("class|id")}="{name}">' if name and self.chance(0.8) or tag in ("div", "section") else f"<{tag}>")
        return f"</{tag}>"

    def menu(self) -> None:
        end = self.box("nav|nav|nav|div|header", "nav|menu|navbar|main-menu|top-nav|breadcrumb")
        if self.chance(0.7):
            self.put("<ul>")
            self.links("li", 3, 8)
            self.put("</ul>")
        else:
            self.links("div", 2, 5)
        self.put(end)

    def header(self) -> None:
        end = self.box("header|header|div", "header|site-header|masthead|top|banner")
        self.block(self.pick("<div>|<p>|<h1>|<h2>"), self.words(1, 4), "", 0)
        if self.chance(0.5):
            self.form()
        self.put(end)

    def form(self) -> None:
        end = self.box("form", "search|login|newsletter|subscribe|signup|contact")
        for _ in range(self.rng.integers(1, 3)):
            self.block(self.pick("<label>|<div>|<p>|<button>|<legend>"), self.words(1, 6), "", 0)
            self.put(self.pick('</button>|</label><input type="text">|</div>|<br>') + "<div></div>")
        self.put(end)

    def notice(self) -> None:
        end = self.box("div|section|aside|div", "cookie|notice|cookie-banner|consent|alert|gdpr|warning|notification|popup")
        self.block(self.pick("<p>|<div>|<span>"), self.sentences(1, 3), "<div></div>", 0)
        self.put(end)

    def advert(self) -> None:
        end = self.box("div|div|aside|section", "ad|ads|advert|advertisement|sponsored|promo|banner-ad|ad-slot")
        text = self.sentences(1, 3) if self.chance(0.7) else self.words(1, 8)
        self.block(self.pick("|<p>|<a href='x'>|<div>"), text, "<div></div>", 0)
        self.put(end)

    def sidebar(self) -> None:
        end = self.box("aside|aside|div|section", "sidebar|side|related|widget|recommended|trending|popular|share|social")
        self.block("<h3>", self.words(1, 4), "</h3>", 0)
        if self.chance(0.6):
            self.put("<ul>")
            self.links("li", 2, 6)
            self.put("</ul>")
        else:
            self.block("<p>", self.sentences(1, 3), "</p>", 0)
        self.put(end)

    def comments(self) -> None:
        end = self.box("section|div|div", "comments|comment-list|comment|discussion|replies|responses|disqus|respond")
        self.block(self.pick("<h2>|<h3>|<p>"), self.words(1, 3), "<div></div>", 0)
        for _ in range(self.rng.integers(1, 5)):
            inner = self.box("div|article|section", "comment|reply|comment-body")
            self.block("<p>", self.sentences(1, 4), "</p>", 0)
            self.put(inner)
        if self.chance(0.3):
            self.form()
        self.put(end)

    def footer(self) -> None:
        end = self.box("footer|footer|div", "footer|site-footer|bottom|copyright|legal")
        sign = self.pick("© |&copy; |Copyright 2020 |")
        text = sign + self.words(1, 3) + " · " + (self.sentences(1, 2) if self.chance(0.6) else self.words(2, 8))
        self.block(self.pick("|<p>|<div>|<small>"), text, "<div></div>", 0)
        if self.chance(0.4):
            self.links("li", 1, 4)
        self.put(end)

    def article(self, inside: bool) -> None:
        end = ""
        if inside:
            end = self.box(
                "article|article|article|main|div|div|section",
                "content|article|post|entry|story|main|article-body|post-content|entry-content|text",
            )
        if self.chance(0.85):
            level = self.pick("h1|h1|h2")
            self.block(f"<{level}>", self.words(1, 12).capitalize(), f"</{level}>", 1)
        for _ in range(self.rng.integers(1, 12)):
            kind = self.rng.random()
            if kind < 0.72:
                text = self.sentences(1, 9) if self.chance(0.85) else self.words(1, 8)
                self.block(self.pick("<p>|<p>|<p>|<p><b>|<p><em>|<p><a href='y'></a>"), text, self.pick("</p>|</p>|<br>"), 1)
                if self.out[-1].endswith("<br>"):
                    self.put("<p>")
            elif kind < 0.8:
                self.block(self.pick("<h2>|<h3>"), self.words(1, 7).capitalize(), "<p>", 1)
            elif kind < 0.87:
                self.put("<ul>")
                for _ in range(self.rng.integers(1, 5)):
                    self.block("<li>", self.sentences(1, 1) if self.chance(0.5) else self.words(1, 8), "</li>", 1)
                self.put("</ul>")
            elif kind < 0.9:
                self.block(self.pick("<blockquote>|<pre>|<div>|<section><p>"), self.sentences(1, 4), "<div></div>", 1)
            elif kind < 0.93:
                self.block("<table><tr><td>", self.words(1, 5), "</td></tr></table>", 1)
            elif kind < 0.96:
                self.advert()
            elif kind < 0.98:
                self.sidebar()
            else:
                self.form()
        if inside:
            self.put(end)

    def page(self) -> tuple[str, list[tuple[str, int]]]:
        self.put('<!DOCTYPE html><html><head><meta charset="utf-8">')
        self.block("<title>", self.words(2, 10).capitalize(), "</title>", 0)
        self.put("<style>p{margin:0}</style><script>var t='</p>';</script></head><body>")
        for make, share in ((self.notice, 0.25), (self.header, 0.5), (self.menu, 0.8), (self.advert, 0.5), (self.sidebar, 0.2)):
            if self.chance(share):
                make()
        self.article(self.chance(0.93))
        for make, share in ((self.comments, 0.4), (self.sidebar, 0.4), (self.advert, 0.2), (self.form, 0.2), (self.notice, 0.1), (self.footer, 0.9)):
            if self.chance(share):
                make()
        if self.chance(0.85):
            self.put("</body></html>")
        return "".join(self.out), self.labels


def labelled_pages(count: int, seed: int) -> list[tuple[str, list[tuple[str, int]]]]:
    """Pages, and the text and label (1: main text) of each of their blocks in order."""
    return [_Writer(seed * 1_000_003 + k).page() for k in range(count)]

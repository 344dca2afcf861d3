"""Invented web pages with known main text, to train the extraction model on.

Every element carries data-mark: 1 for the article and what holds it, 0 for menus, headers,
footers, sidebars, notices, adverts, forms, reader comments and what they hold.
"""

from __future__ import annotations

import random
from collections.abc import Callable

_SYLLABLES = "an be co da el fi ga hu in jo ka lo mi no or pa qui re so ta un ve wi xa yo zu ché ñá öl ß ing tion ment".split()

#: Attribute words of each kind of part; a page may use none of them.
NAMES = {
    "nav": "nav menu navbar navigation topnav breadcrumb breadcrumbs toc pager pagination".split(),
    "head": "header masthead branding logo site-header top-bar hero-bar".split(),
    "foot": "footer site-footer foot copyright legal colophon".split(),
    "side": "sidebar aside widget related recommended trending popular teasers rail more-stories".split(),
    "ad": "ad ads advert advertisement sponsored sponsor promo banner-ad ad-slot".split(),
    "notice": "cookie cookie-notice consent notice alert popup modal newsletter subscribe gdpr warning message".split(),
    "comment": "comments comment comment-list replies discussion respond".split(),
    "social": "share social sharing follow social-links".split(),
    "form": "form search search-form login signup contact".split(),
    "main": "content article post entry story body-text main-content page-content post-body prose".split(),
    "wrap": "wrapper container page layout row grid inner outer site col".split(),
}


class _Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.named = self.r.random() < 0.75
        self.plain_tags = self.r.random() < 0.25  # div in place of nav, header, footer, aside

    def word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.choice((1, 1, 2, 2, 3))))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        out = []
        for _ in range(self.r.randint(low, high)):
            s = self.words(1 if self.r.random() < 0.15 else 4, 22)
            if self.r.random() < 0.5:
                s = s.replace(" ", self.r.choice((", ", " &amp; ", " <b>x</b> ", ' <a href="/q">y</a> ')), 1)
            out.append(s.capitalize() + self.r.choice("...?!"))
        return " ".join(out)

    def attrs(self, kind: str | None) -> str:
        if kind is None or not self.named:
            return f' class="c{self.r.randint(10, 99)}x"' if self.r.random() < 0.2 else ""
        some = self.r.sample(NAMES[kind], self.r.choice((1, 1, 2)))
        return f' {self.r.choice(("class", "class", "id"))}="{" ".join(some)}"'

    def el(self, tag: str, keep: bool, inside: str, kind: str | None = None) -> str:
        return f'<{tag}{self.attrs(kind)} data-mark="{int(keep)}">{inside}</{tag}>'

    def links(self, low: int, high: int) -> str:
        items = [f'<a href="/{self.word()}">{self.words(1, 3)}</a>' for _ in range(self.r.randint(low, high))]
        if self.r.random() < 0.7:
            return self.el("ul", False, "".join(self.el("li", False, x) for x in items))
        return self.r.choice((" | ", " ", " &middot; ")).join(items)

    def part(self, tag: str, kind: str, inside: str) -> str:
        return self.el("div" if self.plain_tags and self.r.random() < 0.7 else tag, False, inside, kind)

    def nav(self) -> str:
        return self.part("nav", "nav", self.links(3, 9))

    def header(self) -> str:
        inner = self.r.choice((self.el("div", False, self.words(1, 3), "head"), self.el("p", False, self.words(2, 6)), self.el(self.r.choice(("h1", "h1", "h2")), False, self.words(1, 3)), self.words(1, 4)))
        return self.part("header", "head", inner + (self.nav() if self.r.random() < 0.5 else ""))

    def footer(self) -> str:
        inner = self.r.choice(("&copy; ", "")) + self.words(2, 9) + self.r.choice((".", " 2023", " &middot; " + self.words(3, 8) + "."))
        if self.r.random() < 0.4:
            inner = self.el("p", False, inner)
        return self.part("footer", "foot", inner + (self.links(2, 5) if self.r.random() < 0.5 else ""))

    def sidebar(self) -> str:
        boxes = "".join(self.el("div", False, self.el(self.r.choice(("h3", "h4", "h2")), False, self.words(1, 4)) + self.r.choice((self.links(2, 6), self.el("p", False, self.sentences(1, 2)))), "side") for _ in range(self.r.randint(1, 3)))
        return self.part("aside", "side", boxes)

    def ad(self) -> str:
        return self.el(self.r.choice(("div", "div", "aside", "section")), False, self.r.choice((self.words(3, 12) + ".", self.sentences(1, 2), self.el("p", False, self.sentences(1, 1)), f'<a href="/x">{self.words(2, 6)}</a>')), "ad")

    def notice(self) -> str:
        text = self.sentences(1, 2)
        return self.el(self.r.choice(("div", "div", "section", "aside", "dialog")), False, self.r.choice((text, self.el("p", False, text))) + (self.el("button", False, self.words(1, 2)) if self.r.random() < 0.6 else ""), "notice")

    def form(self) -> str:
        return self.el("form", False, self.el("label", False, self.words(1, 3)) + "<input>" + self.r.choice(("", self.el("p", False, self.words(3, 9)))) + self.el("button", False, self.words(1, 2)), "form")

    def comments(self) -> str:
        one = lambda: self.el(self.r.choice(("div", "li", "article")), False, self.el(self.r.choice(("h4", "span", "div", "p")), False, self.words(1, 3)) + self.el("p", False, self.sentences(1, 3)), "comment")
        title = self.el("h3", False, self.words(1, 3)) if self.r.random() < 0.7 else ""
        return self.el(self.r.choice(("section", "div", "div", "ol")), False, title + "".join(one() for _ in range(self.r.randint(1, 5))) + (self.form() if self.r.random() < 0.4 else ""), "comment")

    def share(self) -> str:
        return self.el("div", False, self.links(2, 4), "social")

    def article(self) -> str:
        r, el = self.r, self.el
        parts = [el("h1", True, self.words(2, 12))] if r.random() < 0.85 else []
        if parts and r.random() < 0.15:
            parts = [el("header", True, parts[0])]
        for _ in range(r.choice((1, 2, 4, 7, 12))):
            x = r.random()
            if x < 0.7:
                parts.append(el("p", True, self.sentences(1, 6)))
            elif x < 0.76:
                parts.append(el(r.choice(("h2", "h3")), True, self.words(1, 6)))
            elif x < 0.82:
                parts.append(el(r.choice(("ul", "ol")), True, "".join(el("li", True, self.sentences(1, 2) if r.random() < 0.5 else self.words(2, 9)) for _ in range(r.randint(2, 6)))))
            elif x < 0.86:
                parts.append(el("blockquote", True, r.choice((self.sentences(1, 3), el("p", True, self.sentences(1, 3))))))
            elif x < 0.89:
                parts.append(el("figure", True, el("figcaption", True, self.sentences(1, 1))))
            elif x < 0.92:
                rows = "".join(el("tr", True, "".join(el("td", True, self.words(1, 4)) for _ in range(3))) for _ in range(r.randint(2, 4)))
                parts.append(el("table", True, rows))
            elif x < 0.95:
                parts.append(el(r.choice(("div", "section")), True, el("p", True, self.sentences(2, 5))))
            else:
                parts.append(el("p", True, self.words(1, 4) + "."))
        if r.random() < 0.1:
            parts = [el("p", True, self.sentences(1, 1)) if r.random() < 0.5 else self.sentences(1, 6)]
        if r.random() < 0.2:  # a stub whose title repeats its first words
            title = self.words(1, 4).capitalize() + "."
            parts = [el("h1", True, title), el("p", True, r.choice((f"<b>{title}<br>", title, title + " " + self.words(1, 4) + ".")))]
        clutter: list[Callable[[], str]] = [self.ad, self.share, self.sidebar, self.notice, self.form]
        for make in clutter:
            if r.random() < 0.12:
                parts.insert(r.randint(0, len(parts)), make())
        if r.random() < 0.12:
            parts.append(self.comments())
        return "".join(parts)

    def page(self) -> str:
        r, el = self.r, self.el
        tag = r.choice(("article", "article", "main", "section", "div", "div"))
        main = el(tag, True, self.article(), "main" if tag != "article" or r.random() < 0.3 else None)
        if r.random() < 0.3:
            main = el("main" if tag != "main" and r.random() < 0.5 else "div", True, main, r.choice(("wrap", "main")))
        if r.random() < 0.25:  # unclosed: what follows ends up inside
            main = main.removesuffix(f"</{tag}>")
        before = [m() for m, share in ((self.notice, 0.25), (self.header, 0.5), (self.nav, 0.7), (self.ad, 0.4), (self.form, 0.12), (self.sidebar, 0.15)) if r.random() < share]
        after = [m() for m, share in ((self.ad, 0.25), (self.share, 0.15), (self.comments, 0.3), (self.sidebar, 0.3), (self.notice, 0.15), (self.form, 0.12), (self.footer, 0.8)) if r.random() < share]
        if r.random() < 0.15:
            r.shuffle(before)
        body = "".join(before) + main + "".join(after)
        layout = r.random()
        if layout < 0.3:
            body = el("div", True, body, "wrap")
        elif layout < 0.42:  # no element of its own for the article
            body = "".join(before[:1] if r.random() < 0.5 else []) + self.article() + "".join(after[-1:] if r.random() < 0.5 else [])
        elif layout < 0.47:  # laid out by a table
            cells = el("td", False, self.links(2, 6)) + el("td", True, self.article())
            body = el("table", True, el("tr", True, cells) + (el("tr", False, el("td", False, self.words(2, 7))) if r.random() < 0.5 else ""))
        return f'<!DOCTYPE html><html data-mark="1"><head data-mark="0"><title>{self.words(2, 8)}</title></head><body data-mark="1">{body}</body></html>'


def pages(n: int, seed: int = 11) -> list[str]:
    return [_Maker(seed * 100_003 + k).page() for k in range(n)]

"""Labelled pages to train from: layouts built by rule, whose parts are marked as article or not.

The mark is an attribute that the reader of features never sees. Texts are random syllables, so that layout and not wording is
learned; boilerplate gets long texts and articles short ones often enough that length alone doesn't decide.
"""

from __future__ import annotations

import random

MARK = "data-mark"
#: How pages name their parts. Fixed lists.
ARTICLE = ["article", "main", "div.content", "div.article-body", "div.post", "div.entry-content", "section.story", "div#main-content", "section.text", "div.post-body", "article.article", "td.content"]
MENUS = ["nav", "div.menu", "div.navbar", "ul.nav", "div.breadcrumb", "div.topnav", "menu", "div.pagination", "div.toc-links"]
HEADERS = ["header", "div.header", "div#masthead", "div.site-header", "div.logo", "header.top"]
FOOTERS = ["footer", "div.footer", "div#footer", "div.copyright", "footer.site-footer", "div.legal"]
SIDEBARS = ["aside", "div.sidebar", "aside.widget", "div.related", "div.recommended", "div.popular", "section.more", "div.tags"]
NOTICES = ["div.cookie-notice", "div.notice", "div.alert", "div.popup", "div.consent", "dialog", "div.modal", "div.newsletter", "div.paywall", "div.banner"]
ADVERTS = ["div.ad", "div.ads", "div.advert", "div.advertisement", "div.sponsored", "div.promo", "aside.ad", "section.promotion", "p.ad", "div.ad-slot"]
FORMS = ["form", "form.search", "fieldset", "div.login", "form.subscribe", "div.search"]
COMMENTS = ["section.comments", "div#comments", "div.comment-list", "div.responses", "ol.commentlist", "div.discussion", "section.replies", "div.reader-comments"]
OTHERS = ["div.share", "div.social", "div.author-bio", "div.meta", "div.rating"]
WRAPPERS = ["div.page", "div#wrapper", "div.container", "div", "section", "div.row", "div.layout", "table"]


#: Shares of pages whose text stands in no element of its own, and of the others' articles that are short or unwrapped.
BARE, BRIEF = 0.2, 0.15


class Maker:
    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.rng
        out = []
        for _ in range(r.randint(low, high)):
            out.append("".join(r.choice("bdfglmnprstv") + r.choice("aeiou") for _ in range(r.randint(1, 4))) + r.choice(["", "", "", "", ",", "."]))
        return " ".join(out).capitalize() + r.choice([".", ".", ""])

    def box(self, spec: str, mark: int, inner: str) -> str:
        """spec: tag, tag.class or tag#id."""
        tag, sep, name = spec.replace("#", ".#").partition(".")
        attr = "" if not sep else f' id="{name[1:]}"' if name[0] == "#" else f' class="{name}"'
        body = f'<{tag}{attr} {MARK}="{mark}">{inner}</{tag}>'
        return f"<table><tr>{body}</tr></table>" if tag == "td" else body

    def block(self, tag: str, mark: int, text: str) -> str:
        return f'<{tag} {MARK}="{mark}">{text}</{tag}>'

    def links(self, n: int) -> str:
        items = [f'<li {MARK}="0"><a href="/x">{self.words(1, 4)}</a></li>' for _ in range(n)]
        return f'<ul {MARK}="0">{"".join(items)}</ul>' if self.rng.random() < 0.7 else " ".join(f'<a href="/y">{self.words(1, 3)}</a>' for _ in range(n))

    def clutter(self, kinds: list[str]) -> str:
        r, spec = self.rng, self.rng.choice(kinds)
        style = r.random()
        if style < 0.35:
            inner = self.links(r.randint(1, 8))
        elif style < 0.6:
            inner = self.words(3, 40)
        else:
            inner = (self.block("h3", 0, self.words(1, 4)) if r.random() < 0.5 else "") + "".join(self.block(r.choice(["p", "div", "p"]), 0, self.words(3, 60)) for _ in range(r.randint(1, 4)))
        if kinds is FORMS:
            inner = f'<label>{self.words(1, 3)}</label><input type="text"><button>{self.words(1, 2)}</button>' + (inner if r.random() < 0.4 else "")
        return self.box(spec, 0, inner)

    def article(self) -> str:
        r, parts = self.rng, []
        if r.random() < 0.85:
            parts.append(self.block(r.choice(["h1", "h1", "h2"]), 1, self.words(2, 10)))
        for _ in range(r.randint(1, 7)):
            kind = r.random()
            text = self.words(*r.choice([(2, 12), (15, 60), (40, 150)]))
            if r.random() < 0.25:
                text = f"<b>{text}</b> <a href='/z'>{self.words(1, 3)}</a> {self.words(2, 9)}"
            if kind < 0.72:
                parts.append(self.block("p", 1, text))
            elif kind < 0.79:
                parts.append(self.block(r.choice(["h2", "h3", "h4"]), 1, self.words(1, 6)))
            elif kind < 0.86:
                parts.append(f'<{(tag := r.choice(["ul", "ol"]))} {MARK}="1">' + "".join(self.block("li", 1, self.words(2, 25)) for _ in range(r.randint(2, 5))) + f"</{tag}>")
            elif kind < 0.91:
                parts.append(self.box("blockquote", 1, self.block("p", 1, text)))
            elif kind < 0.94:
                parts.append(self.block("pre", 1, text))
            elif kind < 0.97:
                parts.append(f'<figure {MARK}="1"><img src="a.png">' + self.block("figcaption", 1, self.words(2, 10)) + "</figure>")
            else:
                parts.append(self.box("div", 1, self.block("p", 1, text)))
            if r.random() < 0.08:
                parts.append(self.clutter(r.choice([ADVERTS, SIDEBARS, OTHERS, FORMS, NOTICES])))
        return self.box(r.choice(ARTICLE), 1, "".join(parts))

    def brief(self) -> str:
        """An article of one short block, or of text that no block wraps, in an element of its own or in none."""
        r = self.rng
        style = r.random()
        if style < 0.4:
            inner = self.block("p", 1, self.words(1, 8))
        elif style < 0.7:
            inner = self.words(*r.choice([(1, 6), (8, 40), (60, 150)]))
        else:
            inner = r.choice(["<br>", "<br/>\n", "<br><br>"]).join(self.words(1, 25) for _ in range(r.randint(2, 6)))
        return self.box(r.choice([*ARTICLE[:2], *ARTICLE]), 1, inner)

    def bare(self) -> str:
        """A page whose blocks or text stand in the body, or in no element at all, with little else around them."""
        r = self.rng
        style = r.random()
        if style < 0.5:
            parts = [self.block(r.choice(["p", "p", "p", "h1", "h2"]), 1, self.words(*r.choice([(1, 4), (5, 40), (40, 120)]))) for _ in range(r.randint(1, 6))]
            around = [self.clutter(r.choice([MENUS, HEADERS, FOOTERS, ADVERTS, FORMS, COMMENTS])) if r.random() < 0.5 else "" for _ in range(2)]
            inner, mark = around[0] + "".join(parts) + around[1], 0
        else:
            inner, mark = r.choice(["<br>", "\n", "<br>\n"]).join(self.words(1, 40) for _ in range(r.randint(1, 8))), 1
        style = r.random()
        if style < 0.35:
            return f'<html {MARK}="{mark}">{inner}</html>'  # the reader's root stands for a page without any element
        return f'<html {MARK}="0"><head><title>{self.words(2, 5)}</title></head><body {MARK}="{mark}">{inner}</body></html>'

    def page(self) -> str:
        r = self.rng
        if r.random() < BARE:
            return self.bare()
        before = [self.clutter(k) for k in (NOTICES, HEADERS, MENUS, ADVERTS, FORMS) if r.random() < 0.5]
        after = [self.clutter(k) for k in (OTHERS, COMMENTS, SIDEBARS, ADVERTS, FORMS, FOOTERS) if r.random() < 0.5]
        r.shuffle(before)
        middle = "".join(before) + (self.brief() if r.random() < BRIEF else self.article()) + "".join(after)
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            spec = r.choice(WRAPPERS)
            middle = f'<table {MARK}="0"><tr {MARK}="0"><td {MARK}="0">{middle}</td></tr></table>' if spec == "table" else self.box(spec, 0, middle)
        whole = f'<html {MARK}="0"><head><title>{self.words(2, 5)}</title></head><body {MARK}="0">{middle}</body></html>'
        return whole[: r.randint(len(whole) // 20, len(whole))] if r.random() < 0.15 else whole  # some pages are cut off

"""Labelled pages for the extractor: layouts drawn from a rule, with every block's label known by construction."""

from __future__ import annotations

import html
import random

#: Names that page authors give to parts, by kind.
CONTENT_NAMES = ["content", "post", "entry", "story", "article", "article body", "post content", "main", "text", "body", "page content"]
CLUTTER_NAMES = {
    "div": ["ad", "ads", "advert", "advertisement", "banner", "promo", "sponsored", "cookie", "cookie notice", "notice", "alert", "consent", "share", "social",
            "related", "recommended", "newsletter", "subscribe", "breadcrumb", "breadcrumbs", "menu", "nav", "navbar", "sidebar", "widget", "footer", "header",
            "masthead", "topbar", "popup", "modal", "login", "tags", "copyright", "legal", "toolbar", "pagination"],
    "comments": ["comments", "comment", "comment list", "responses", "replies", "discussion", "reader comments", "reply"],
}
_SYLLABLES = "an be con der en for ge ha in ka lo mi no or pa qui re sta ti un ver wa".split()


class _Writer:
    def __init__(self, rng: random.Random):
        self.rng, self.out, self.blocks = rng, [], []

    def words(self, low: int, high: int, end: bool = True) -> str:
        n = self.rng.randint(low, high)
        text = " ".join("".join(self.rng.choices(_SYLLABLES, k=self.rng.randint(1, 4))) for _ in range(n)).capitalize()
        return text + (self.rng.choice("...!?") if end and self.rng.random() < 0.9 else "")

    def raw(self, text: str) -> None:
        self.out.append(text)

    def block(self, tag: str, text: str, label: int, link: bool = False, close: bool = True) -> None:
        inner = html.escape(text)
        if link:
            inner = f'<a href="/x">{inner}</a>'
        elif label and self.rng.random() < 0.15:
            inner = f"<b>{inner}</b>"
        self.out.append(f"<{tag}>{inner}" + (f"</{tag}>" if close else ""))
        self.blocks.append((" ".join(text.split()), label))

    def named(self, names: list[str]) -> str:
        name = self.rng.choice(names)
        return self.rng.choice([f' class="{name}"', f' id="{name.replace(" ", "-")}"', f' class="{name.replace(" ", "-")} box"'])

    def links(self, tag: str = "li") -> None:
        self.raw("<ul>")
        for _ in range(self.rng.randint(2, 8)):
            self.block(tag, self.words(1, 3, False), 0, link=True)
        self.raw("</ul>")

    def clutter(self, kind: str) -> None:
        rng = self.rng
        if kind == "nav":
            tag = rng.choice(["nav", "header", "div"])
            self.raw(f"<{tag}{self.named(['menu', 'nav', 'navbar', 'top']) if tag == 'div' or rng.random() < .3 else ''}>")
            self.links()
            self.raw(f"</{tag}>")
        elif kind == "footer":
            tag = rng.choice(["footer", "footer", "div"])
            self.raw(f"<{tag}{self.named(['footer', 'copyright', 'legal', 'site footer']) if tag == 'div' else ''}>")
            self.block(rng.choice(["p", "div"]), "© " + self.words(2, 40), 0)
            if rng.random() < 0.5:
                self.links()
            self.raw(f"</{tag}>")
        elif kind == "aside":
            self.raw("<aside>")
            self.block("h3", self.words(1, 4, False), 0)
            for _ in range(rng.randint(1, 4)):
                self.block("p", self.words(2, 60), 0)
            self.raw("</aside>")
        elif kind == "form":
            self.raw("<form>")
            self.block(rng.choice(["p", "label", "div"]), self.words(1, 15), 0)
            self.raw('<input name="q"><button>Go</button></form>')
            self.blocks.append(("Go", 0))
        elif kind == "comments":
            tag = rng.choice(["section", "div", "ol", "div"])
            self.raw(f"<{tag}{self.named(CLUTTER_NAMES['comments'])}>")
            if rng.random() < 0.7:
                self.block("h3", self.words(1, 3, False), 0)
            for _ in range(rng.randint(1, 6)):
                self.block(rng.choice(["p", "div", "li"]), self.words(1, 80), 0)
            self.raw(f"</{tag}>")
        else:
            self.raw(f"<div{self.named(CLUTTER_NAMES['div'])}>")
            for _ in range(rng.choice([1, 1, 2, 3])):
                self.block(rng.choice(["p", "div", "p", "h4"]) if rng.random() < 0.6 else "p", self.words(1, 50), 0, link=rng.random() < 0.2)
            self.raw("</div>")

    def article(self) -> None:
        rng = self.rng
        tag = rng.choice(["article", "article", "main", "div", "section", "td"])
        if tag == "td":
            self.raw("<table><tr>")
        self.raw(f"<{tag}{self.named(CONTENT_NAMES) if tag in ('div', 'section', 'td') or rng.random() < .2 else ''}>")
        if rng.random() < 0.3:
            self.raw(f"<div{self.named(CONTENT_NAMES)}>" if rng.random() < 0.5 else "<div>")
        self.block("h1", self.words(1, 14, False), 1)
        plain = rng.random() < 0.9  # paragraphs are not always marked as such
        for _ in range(rng.randint(1, 12)):
            kind = rng.random()
            if kind < 0.68:
                self.block("p" if plain else "div", self.words(1, rng.choice([2, 12, 60, 150])), 1, close=not plain or rng.random() < 0.7)
            elif kind < 0.78:
                self.block(rng.choice(["h2", "h3"]), self.words(1, 8, False), 1)
            elif kind < 0.86:
                self.raw("<ul>")
                for _ in range(rng.randint(1, 5)):
                    self.block("li", self.words(1, 25), 1)
                self.raw("</ul>")
            elif kind < 0.94:
                self.block(rng.choice(["blockquote", "pre", "dd", "figcaption", "div", "div"]), self.words(1, 40), 1)
            else:
                self.clutter(rng.choice(["div", "div", "form", "aside"]))
        if rng.random() < 0.15:
            self.clutter("comments")
        self.raw(f"</{tag}>" + ("</tr></table>" if tag == "td" else ""))


def labelled_page(seed: int) -> tuple[str, list[tuple[str, int]]]:
    """A page and its blocks in order, as (text, 1 if main text)."""
    w = _Writer(random.Random(seed))
    w.raw("<!DOCTYPE html><html><head><title>x y</title><style>p{margin:0}</style></head><body>")
    before = w.rng.sample(["nav", "div", "div", "form", "aside"], w.rng.randint(0, 4))
    after = w.rng.sample(["footer", "div", "aside", "comments", "div", "form"], w.rng.randint(0, 5))
    wrap = w.rng.random() < 0.3
    w.raw('<div class="wrapper">' if wrap else "")
    for kind in before:
        w.clutter(kind)
    w.article()
    for kind in after:
        w.clutter(kind)
    w.raw(("</div>" if wrap else "") + "</body></html>")
    return "".join(w.out), w.blocks

"""Labelled pages that the extraction model is trained on: random layouts of invented text.

The attribute ``data-main`` says of an element and what is in it whether it belongs to the main text; no
feature reads it. Pages of one's own can be marked in the same way.
"""

from __future__ import annotations

import random
from collections.abc import Callable

SYLLABLES = "ba be bo da de do fa fe ga go ha he in is ka ke la le li lo ma me mi na ne no or pa pe ra re ri sa se si ta te ti to un va ve".split()
#: What the parts around a text are called, in tags, names and roles.
OPENINGS = {
    "header": ['header', 'header class="site-header"', 'div id="header"', 'div class="masthead"', 'div class="top-bar"', 'div role="banner"', 'div class="page-header"'],
    "menu": ['nav', 'nav class="main-nav"', 'div class="menu"', 'div id="navigation"', 'div role="navigation"', 'div class="navbar"', 'div class="breadcrumbs"', 'nav class="breadcrumb"', 'div class="toc"', 'div class="pagination"', 'menu'],
    "notice": ['div class="notice"', 'div class="cookie-notice"', 'div id="cookie-banner"', 'div class="alert"', 'div role="alert"', 'div class="consent"', 'div role="dialog"', 'section class="gdpr"', 'div class="privacy-notice"', 'div class="paywall"', 'div class="popup"', 'dialog', 'p class="notice"'],
    "advert": ['div class="ad"', 'div class="ads"', 'div class="advert"', 'div class="advertisement"', 'div class="sponsored"', 'div class="promo"', 'div id="ad-slot"', 'aside class="ad"', 'ins class="ad"', 'div class="banner"', 'p class="ad"', 'section class="promotion"'],
    "sidebar": ['aside', 'aside class="sidebar"', 'div class="sidebar"', 'div id="sidebar"', 'div class="side-column"', 'div class="widget"', 'div class="related"', 'section class="related-posts"', 'div class="recommended"', 'div class="more-stories"', 'div class="trending"', 'div class="share"', 'div class="social-links"', 'div role="complementary"', 'div class="tags"'],
    "form": ['form', 'form class="search"', 'form id="login"', 'form class="newsletter"', 'div class="newsletter-signup"', 'div class="subscribe"', 'form class="contact-form"', 'div role="search"', 'fieldset', 'search'],
    "comments": ['section class="comments"', 'div id="comments"', 'div class="comment-list"', 'section id="disqus"', 'div class="responses"', 'ol class="comments"', 'div class="reader-comments"', 'div class="discussion"', 'section class="replies"'],
    "footer": ['footer', 'footer class="site-footer"', 'div id="footer"', 'div class="page-footer"', 'div role="contentinfo"', 'div class="colophon"', 'div class="copyright"', 'div class="legal"'],
}
MAIN = [
    "article", "article", "article", "main", 'div class="content"', 'div id="content"', 'div class="post"', 'div class="article-body"', 'div class="entry-content"',
    'div class="story"', 'div id="main"', "section", 'div role="main"', 'section class="text"', "div", "div", "div", "div", "",
]
CUES = {
    "menu": ["Home", "About", "Contact", "Next page", "Menu"],
    "notice": ["We use cookies.", "This site uses cookies", "Accept all", "Privacy settings"],
    "advert": ["Advertisement", "Sponsored", "Buy now"],
    "sidebar": ["Related", "Popular posts", "Share this", "Read more", "Tags"],
    "form": ["Search", "Subscribe to our newsletter", "Sign in", "Your email"],
    "comments": ["Comments", "Leave a reply", "3 comments"],
    "footer": ["&copy; 2021", "All rights reserved.", "Privacy policy", "Terms of use"],
}


class Writer:
    def __init__(self, seed: int) -> None:
        self.rng = random.Random(seed)
        self.styles: list[Callable[[str], str]] = [str, str, str, str, str.upper, lambda s: s.replace(".", ""), lambda s: s.replace(",", ";")]
        self.style = self.styles[0]

    def one(self, options: list[str]) -> str:
        return self.rng.choice(options)

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def words(self, low: int, high: int) -> str:
        made = ["".join(self.rng.choices(SYLLABLES, k=self.rng.randint(1, 4))) for _ in range(self.rng.randint(low, high))]
        return " ".join(w + "," if self.chance(0.06) else w for w in made)

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.words(3, 16).capitalize() + "." for _ in range(self.rng.randint(low, high)))

    def element(self, opening: str, body: str, label: str = "", closed: float = 1.0) -> str:
        tag = opening.split()[0]
        return f"<{opening}{label}>{body}" + (f"</{tag}>" if self.chance(closed) else "")

    def links(self, label: str = "") -> str:
        items = [f'<a href="/{self.words(1, 1)}">{self.words(1, 3)}</a>' for _ in range(self.rng.randint(2, 7))]
        if self.chance(0.6):
            return self.element("ul", "".join(self.element("li", x, closed=0.8) for x in items), label)
        return self.element("div", " ".join(items), label)

    def aside(self, kind: str) -> str:
        """A part that isn't main text."""
        body = ""
        for _ in range(self.rng.randint(1, 3)):
            cue = self.one(CUES[kind]) if kind in CUES and self.chance(0.4) else ""
            p = self.rng.random()
            if cue and p < 0.5:
                body += self.element(self.one(["p", "h3", "div", "span"]), cue)
            elif kind in ("menu", "sidebar") and p < 0.85 or p < 0.2:
                body += self.links()
            elif kind == "form":
                body += f'{self.element("label", self.words(1, 3))}<input name="q">{self.element("button", self.words(1, 2))}{self.element("p", self.sentences(1, 2))}'
            elif kind == "comments":
                body += self.element(self.one(["article", 'div class="comment"', "li", 'article class="comment"', "div"]), self.element("p", self.sentences(1, 6), closed=0.8))
            else:
                text = cue + " " + self.sentences(1, 4) if self.chance(0.7) else self.words(1, 9)
                body += text if self.chance(0.4) else self.element("p", text, closed=0.8) if self.chance(0.6) else self.element("div", text)
        if kind in ("header", "sidebar", "footer") and self.chance(0.3):
            body = self.element(self.one(["h1", "h2", "h3"]), self.words(1, 5)) + body
        options = OPENINGS[kind]
        if self.chance(0.05):  # a part that isn't shown
            return self.element(self.one(["div hidden", 'div style="display:none"', 'div aria-hidden="true"', "aside hidden", 'section style="display: none"']), body, ' data-main="0"')
        return self.element(options[0] if self.chance(0.3) else self.one(options), body, ' data-main="0"')

    def paragraph(self, short: float) -> str:
        text = self.words(1, 4) if self.chance(short) else self.sentences(1, 7)
        text = self.style(text)
        if short > 0.1 and self.chance(0.08):  # texts, too, may say such things
            text = self.one(self.one(list(CUES.values())))
        elif self.chance(0.08):
            text = f"{text} {self.one(self.one(list(CUES.values())))} {self.sentences(1, 3)}"
        if self.chance(0.15):
            text = f'<a href="/x">{text[:20]}</a>{text[20:]}'
        if self.chance(0.15):
            text = f"<b>{text}" + ("</b>" if self.chance(0.5) else "") + ("<br>" if self.chance(0.5) else "")
        return self.element("p", text, closed=0.85)

    def main(self) -> str:
        opening = self.one(MAIN)
        told = opening not in ("div", "")  # else only the text itself tells
        self.style = self.one(self.styles) if told else self.styles[0]
        short = 0.25 if told else 0.03
        title = self.element("h1", self.style(self.words(2, 10)))
        body = f"<header>{title}</header>" if told and self.chance(0.15) else title if self.chance(0.85) else ""
        for _ in range(self.rng.randint(1, 8)):
            p = self.rng.random()
            if p < 0.66:
                body += self.paragraph(short)
            elif p < 0.74 and opening:
                body += self.element(self.one(["h2", "h3"]), self.words(1, 7))
            elif p < 0.81 and told:
                body += self.element(self.one(["ul", "ol"]), "".join(self.element("li", self.words(1, 14), closed=0.8) for _ in range(self.rng.randint(2, 4))))
            elif p < 0.85 and opening:
                body += self.element(self.one(["blockquote", "pre", "figcaption", "dd"]), self.sentences(1, 3))
            elif p < 0.87 and told:
                body += self.element("table", self.element("tr", "".join(self.element("td", self.words(1, 3)) for _ in range(4))))
            elif told:
                body += self.aside(self.one(["advert", "sidebar", "form", "notice", "menu"]))
        if told and self.chance(0.15):
            body += self.aside("comments")
        return self.element(opening or "div", body, ' data-main="1"') if opening else body.replace("<p>", '<p data-main="1">').replace("<h1>", '<h1 data-main="1">')

    def nested(self) -> str:
        """The main part, at times inside another element together with parts that don't belong to it."""
        main = self.main()
        if self.chance(0.35):
            around = [self.aside(self.one(["comments", "sidebar", "advert", "menu", "notice"])) if self.chance(0.4) else "" for _ in range(2)]
            main = self.element(self.one([m for m in MAIN if m]), around[0] + main + around[1])
        return main

    def page(self) -> str:
        if self.chance(0.05):  # nothing but text
            self.style = self.one(self.styles)
            body = "".join(self.element(self.one(["p", "p", "div", "h1"]), self.style(self.words(1, 30)), ' data-main="1"') for _ in range(self.rng.randint(1, 5)))
            if self.chance(0.3):
                body = f'<body data-main="1">{self.style(self.words(1, 30))}</body>'
            return f"<html>{body}</html>"
        if self.chance(0.06):  # a main part and nothing else
            return f"<html><body>{self.main()}</body></html>"
        before = [k for k, p in (("notice", 0.35), ("header", 0.5), ("menu", 0.7), ("advert", 0.4), ("form", 0.2), ("sidebar", 0.15)) if self.chance(p)]
        after = [k for k, p in (("advert", 0.25), ("sidebar", 0.4), ("comments", 0.35), ("form", 0.2), ("menu", 0.15), ("footer", 0.8), ("notice", 0.15)) if self.chance(p)]
        body = "".join(map(self.aside, before)) + self.nested() + "".join(map(self.aside, after))
        if self.chance(0.3):
            body = self.element(self.one(["div", 'div id="page"', 'div class="wrapper"', 'div class="container"']), body)
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title></head><body>{body}" + ("</body></html>" if self.chance(0.9) else "")


def labelled_pages(n: int, seed: int = 0) -> list[str]:
    writer = Writer(seed)
    return [writer.page() for _ in range(n)]

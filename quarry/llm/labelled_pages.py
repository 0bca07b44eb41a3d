"""Labelled training pages: layouts whose elements say with data-label whether their text is main or other.

The pages are put together from the layouts below by a fixed rule; the texts are random words, so only structure and
shape of text can be learned.
"""

from __future__ import annotations

import random

SYLLABLES = "ba den kor li mes nu pra sot ti vel wen zu ar il ost ran".split()
#: Elements that hold other text: (tag, classes or ids seen on the web for that part), fixed values.
OTHER = {
    "menu": [("nav", ""), ("div", "menu"), ("div", "navbar"), ("ul", "nav-list"), ("div", "main-navigation"), ("div", "breadcrumbs"), ("div", "topbar")],
    "header": [("header", ""), ("div", "header"), ("div", "site-header masthead"), ("div", "banner"), ("div", "logo branding")],
    "footer": [("footer", ""), ("div", "footer"), ("div", "site-footer"), ("div", "copyright"), ("div", "legal")],
    "sidebar": [("aside", ""), ("div", "sidebar"), ("div", "widget"), ("section", "related"), ("div", "recommended popular"), ("div", "right-rail")],
    "notice": [("div", "cookie-notice"), ("div", "consent gdpr"), ("div", "alert notice"), ("div", "popup modal overlay"), ("div", "newsletter subscribe"), ("div", "paywall")],
    "advert": [("div", "ad"), ("div", "ads advert"), ("div", "sponsored promo"), ("ins", "adsbygoogle"), ("div", "advertisement"), ("aside", "ad")],
    "form": [("form", ""), ("form", "search"), ("div", "login-form"), ("fieldset", ""), ("div", "search-box")],
    "comments": [("div", "comments"), ("section", "comment-list"), ("ol", "commentlist"), ("div", "disqus replies"), ("div", "reader-comments")],
    "share": [("div", "share social"), ("ul", "tags"), ("div", "byline-actions toolbar"), ("div", "pagination pager")],
}
MAIN = [("article", ""), ("main", ""), ("div", "content"), ("div", "article-body"), ("div", "post entry-content"), ("div", "story"), ("section", "text"), ("div", ""), ("td", "")]


class _Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, n: int) -> str:
        out = ["".join(self.r.choices(SYLLABLES, k=self.r.randint(1, 4))) for _ in range(n)]
        for k in range(7, n, self.r.randint(6, 14)):
            out[k] += self.r.choice([",", ".", "."])
        return " ".join(out).capitalize()

    def sentence(self, n: int) -> str:
        return self.words(n) + self.r.choice([".", ".", ".", "!", "?", ":"])

    def wrap(self, tag: str, names: str, inner: str, label: str | None = None) -> str:
        says = f' data-label="{label}"' if label else ""
        attr = f' {self.r.choice(["class", "class", "id"])}="{names}"' if names else ""
        return f"<{tag}{attr}{says}>{inner}</{tag}>"

    def links(self, n: int) -> str:
        one = [f'<a href="/{k}">{self.words(self.r.randint(1, 4))}</a>' for k in range(n)]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in one) + "</ul>" if self.r.random() < 0.7 else " | ".join(one)

    def other(self, kind: str) -> str:
        r = self.r
        tag, names = r.choice(OTHER[kind])
        if kind in ("menu", "share"):
            inner = self.links(r.randint(2, 9))
        elif kind == "header":
            inner = r.choice([f"<h1>{self.words(3)}</h1>", f"<h2>{self.words(2)}</h2><p>{self.words(6)}</p>", f"<a href='/'>{self.words(2)}</a>", self.links(4)])
        elif kind == "footer":
            inner = r.choice([f"<p>&copy; 2020 {self.words(5)}</p>", f"&copy; {self.words(3)} &middot; {self.sentence(9)}", self.links(5), f"<p>{self.sentence(14)}</p>" + self.links(3)])
        elif kind == "sidebar":
            inner = r.choice([f"<h3>{self.words(2)}</h3>" + self.links(5), f"<h3>{self.words(3)}</h3><p>{self.sentence(15)}</p>", f"<p>{self.sentence(25)}</p><p>{self.sentence(9)}</p>"])
        elif kind in ("notice", "advert"):
            inner = r.choice([self.sentence(12), f"<p>{self.sentence(22)}</p>", f"<p>{self.sentence(12)}</p><a href='#'>{self.words(2)}</a>", " ".join(self.sentence(5) for _ in range(3)), self.sentence(35)])
        elif kind == "form":
            inner = f"<label>{self.words(2)}</label><input name='q'><p>{self.words(4)}</p>"
        else:
            inner = "".join(r.choice([f"<div class='comment'><b>{self.words(1)}</b><p>{self.sentence(r.randint(4, 40))}</p></div>", f"<li><p>{self.sentence(r.randint(3, 30))}</p></li>", f"<article class='comment'><p>{self.sentence(18)}</p></article>"]) for _ in range(r.randint(1, 5)))
        return self.wrap(tag, names, inner, "other")

    def paragraph(self) -> str:
        r = self.r
        text = " ".join(self.sentence(r.choice([1, 2, 4, 8, 15, 25, 40])) for _ in range(r.choice([1, 1, 2, 3, 6])))
        shape = r.random()
        if shape < 0.06:
            text = " | ".join(self.words(1) for _ in range(r.randint(3, 12)))
        elif shape < 0.1:
            text = " ".join(w + r.choice(["!!", "%%%", "###"]) for w in text.upper().split())
        elif shape < 0.14:
            text = self.words(r.randint(1, 9))
        if r.random() < 0.15:
            text = f"<a href='/x'>{self.words(2)}</a> {text}"
        kind = r.random()
        if kind < 0.62:
            return f"<p>{text}</p>"
        if kind < 0.70:
            return f"<p><b>{text}<br>"
        if kind < 0.76:
            h = r.choice(["h2", "h3", "h4"])
            return f"<{h}>{self.words(r.randint(1, 6))}</{h}>"
        if kind < 0.82:
            return "<ul>" + "".join(f"<li>{self.sentence(r.randint(2, 14))}</li>" for _ in range(3)) + "</ul>"
        if kind < 0.86:
            return f"<blockquote><p>{text}</p></blockquote>"
        if kind < 0.89:
            return f"<pre>{self.words(6)} = {r.randint(1, 99)};</pre>"
        if kind < 0.92:
            return "<table><tr>" + "".join(f"<td>{self.words(2)}</td>" for _ in range(3)) + "</tr></table>"
        return f"<div>{text}</div>"

    def page(self) -> str:
        r = self.r
        tag, names = r.choice(MAIN if r.random() < 0.5 else MAIN[:2])
        body = [f"<h1>{self.words(r.randint(1, 12))}</h1>"] if r.random() < 0.8 else []
        for _ in range(r.choice([1, 2, 3, 6, 12, 20])):
            body.append(self.paragraph())
            if r.random() < 0.06:
                body.append(self.other(r.choice(["advert", "share", "notice", "sidebar", "form"])))
        if r.random() < 0.2:
            body.append(self.other("comments"))
        main = self.wrap(tag, names, "\n".join(body), "main")
        if tag == "td":
            main = f"<table><tr>{main}</tr></table>"
        if r.random() < 0.2:
            main = f"<div class='wrapper container'>{main}</div>"
        before = [self.other(k) for k in ("header", "menu", "notice", "advert", "form", "sidebar") if r.random() < 0.5]
        after = [self.other(k) for k in ("comments", "sidebar", "advert", "share", "footer", "notice") if r.random() < 0.5]
        return "<html><head><title>x</title></head><body>" + "\n".join([*before, main, *after]) + "</body></html>"


def labelled_pages(n: int = 400) -> list[str]:
    return [_Maker(seed).page() for seed in range(n)]

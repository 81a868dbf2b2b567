"""Labelled pages to train on, built by rule from page parts in many usual layouts.

Elements that hold main text carry the attribute ``data-main``; features never use it.
"""

from __future__ import annotations

import random

_SYLLABLES = "ba re to lin mar ve so chi del an tor ga ne sul pra om ti den war co".split()
_CONTENT = ["content", "post", "entry-content", "story", "article-body", "main-content", "page-content", "post-body", "text", "body-text"]
_MENU = ["menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "main-menu", "topnav", "links", "pagination", "tags", "toc"]
_HEAD = ["header", "masthead", "site-header", "top", "branding", "topbar", "logo", "page-header"]
_FOOT = ["footer", "site-footer", "foot", "bottom", "copyright", "legal", "colophon", "credits"]
_SIDE = ["sidebar", "aside", "related", "widget", "recommended", "rail", "trending", "popular", "more-stories", "side", "teaser", "see-also"]
_NOTICE = ["cookie", "cookie-notice", "consent", "notice", "alert", "gdpr", "banner", "popup", "modal", "disclaimer", "message", "cookie-banner", "paywall", "overlay"]
_ADVERT = ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "promotion", "adsense", "sponsor", "ad-slot", "banner-ad", "commercial"]
_FORM = ["search", "newsletter", "subscribe", "login", "signup", "contact-form", "form", "share", "social"]
_COMMENT = ["comments", "comment", "comment-list", "responses", "discussion", "disqus", "replies", "reply", "reader-comments", "comment-body", "user-comments", "commentlist"]
_PLAIN = ["inner", "row", "col", "box", "block", "group", "item", "wrap", "body", "container", "panel"]


class _Page:
    def __init__(self, seed: int, nameless: float):
        self.r = random.Random(seed)
        self.nameless = self.r.random() < nameless

    def words(self, a: int, b: int) -> str:
        words = ["".join(self.r.choices(_SYLLABLES, k=self.r.randint(1, 3))) for _ in range(self.r.randint(a, b))]
        return " ".join(words)

    def prose(self) -> str:
        r = self.r
        if r.random() < 0.15:
            return self.words(1, 5) + r.choice([".", "", "!"])
        text = ". ".join(self.words(4, 16).capitalize() for _ in range(r.randint(1, 6))) + "."
        if r.random() < 0.3:
            text = f"<b>{self.words(1, 3)}</b> " + text
        if r.random() < 0.3:
            text += f' <a href="/{self.words(1, 1)}">{self.words(1, 4)}</a>' + r.choice([".", " " + self.words(2, 6) + "."])
        if r.random() < 0.1:
            text = text.upper().replace("<B>", "<b>").replace("</B>", "</b>")
        return text

    def name(self, names: list[str]) -> str:
        """A class or id from the list, often beside a word that tells nothing."""
        r, name = self.r, self.r.choice(names)
        if self.nameless:
            name = "".join(r.choices(_SYLLABLES, k=3))
        other = "".join(r.choices("bcdfgklmnprstvz", k=2)) + r.choice(_SYLLABLES)
        name = r.choice([name, name, name, f"{name}-{other}", f"{other}-{name}", f"{other} {name}", f"{name} {other}"])
        return f'{r.choice(["class", "class", "id"])}="{name}"'

    def leaf(self) -> str:
        """Sometimes a name for a block of the main text, which may hold a telling word among others."""
        x = self.r.random()
        if x < 0.85:
            return ""
        word = self.r.choice(_MENU + _HEAD + _FOOT + _SIDE + _NOTICE + _ADVERT + _COMMENT) if x > 0.93 else self.words(1, 1)
        return f' class="{word}-{self.words(1, 1)}"'

    def wrapped(self, inside: str) -> str:
        """Sometimes inside a further element that tells nothing."""
        x = self.r.random()
        if x < 0.12:
            return f"<div>{inside}</div>"
        return f"<div {self.name(_PLAIN)}>{inside}</div>" if x < 0.25 else inside

    def menu(self) -> str:
        items = "".join(f'<li><a href="/{i}">{self.words(1, 3)}</a></li>' for i in range(self.r.randint(2, 8)))
        return self.r.choice([f"<nav><ul>{items}</ul></nav>", f"<nav {self.name(_MENU)}><ul>{items}</ul></nav>", f"<div {self.name(_MENU)}><ul>{items}</ul></div>", f"<ul {self.name(_MENU)}>{items}</ul>", f'<div role="navigation"><ul>{items}</ul></div>'])

    def header(self) -> str:
        inside = f"<h1>{self.words(1, 5)}</h1>" + self.r.choice(["", f"<p>{self.words(3, 9)}</p>", f"<p>{self.prose()}</p>", f"<div>{self.prose()}</div>", self.menu()])
        inside = self.wrapped(inside)
        return self.r.choice([f"<header>{inside}</header>", f'<div role="banner">{inside}</div>', f"<header {self.name(_HEAD)}>{inside}</header>", f"<div {self.name(_HEAD)}>{inside}</div>"])

    def footer(self) -> str:
        inside = self.r.choice([f"&copy; {self.words(1, 3)} &middot; {self.prose()}", f"<p>{self.prose()}</p><p>&copy; 2024 {self.words(1, 3)}</p>", self.menu() + f"<p>{self.words(2, 8)}</p>"])
        inside = self.wrapped(self.r.choice([inside, self.prose()]))
        return self.r.choice([f"<footer>{inside}</footer>", f'<div role="contentinfo">{inside}</div>', f"<footer {self.name(_FOOT)}>{inside}</footer>", f"<div {self.name(_FOOT)}>{inside}</div>"])

    def _side_parts(self) -> str:
        return "".join(self.r.choice([f"<h3>{self.words(1, 4)}</h3>", f"<p>{self.prose()}</p>", f'<ul><li><a href="#">{self.words(2, 7)}</a></li></ul>']) for _ in range(self.r.randint(1, 4)))

    def side(self) -> str:
        inside = self.wrapped(self._side_parts())
        return self.r.choice([f'<div role="complementary">{inside}</div>', f"<aside>{inside}</aside>", f"<aside {self.name(_SIDE)}>{inside}</aside>", f"<div {self.name(_SIDE)}>{inside}</div>", f"<section {self.name(_SIDE)}>{inside}</section>"])

    def notice(self) -> str:
        inside = self.r.choice([self.prose(), f"<p>{self.prose()}</p><button>{self.words(1, 2)}</button>", f"<p>{self.prose()}</p>"])
        inside = self.wrapped(inside)
        return self.r.choice([f"<div {self.name(_NOTICE)}>{inside}</div>", f"<section {self.name(_NOTICE)}>{inside}</section>", f'<div role="alert">{inside}</div>', f'<div role="dialog">{inside}</div>', f"<dialog>{inside}</dialog>", f"<p {self.name(_NOTICE)}>{self.prose()}</p>"])

    def advert(self) -> str:
        inside = self.r.choice([self.prose(), f"<p>{self.prose()}</p>", f'<a href="#">{self.words(2, 8)}</a>'])
        inside = self.wrapped(inside)
        return self.r.choice([f"<div {self.name(_ADVERT)}>{inside}</div>", f"<div {self.name(_ADVERT)}>{inside}</div>", f"<aside {self.name(_ADVERT)}>{inside}</aside>", f"<section {self.name(_ADVERT)}>{inside}</section>", f"<p {self.name(_ADVERT)}>{self.prose()}</p>"])

    def form(self) -> str:
        text = self.r.choice([self.words(2, 9), self.prose()])
        inside = f"<p>{text}</p><label>{self.r.choice([self.words(1, 3), self.prose()])}</label><input name=q><select><option>{self.words(1, 2)}<option>{self.words(1, 2)}</select><button>{self.words(1, 2)}</button>"
        return self.r.choice([f"<form>{inside}</form>", f"<form>{inside}</form>", f'<div role="search">{inside}</div>', f"<form {self.name(_FORM)}>{inside}</form>", f"<div {self.name(_FORM)}>{inside}</div>", f"<div {self.name(_FORM)}><form>{inside}</form></div>", f"<fieldset>{inside}</fieldset>"])

    def comments(self) -> str:
        posts = [f"<p>{self.prose()}</p>" for _ in range(self.r.randint(1, 4))]
        shapes = [f"<div {self.name(_COMMENT)}>{{}}</div>", "<li>{}</li>", f"<article {self.name(_COMMENT)}>{{}}</article>", "{}"]
        inside = self.r.choice(["", f"<h2>{self.words(1, 3)}</h2>"]) + "".join(self.r.choice(shapes).format(p) for p in posts)
        inside = self.wrapped(inside)
        return self.r.choice([f"<section {self.name(_COMMENT)}>{inside}</section>", f"<div {self.name(_COMMENT)}>{inside}</div>", f"<ol {self.name(_COMMENT)}>{inside}</ol>"])

    def article(self) -> str:
        r = self.r
        parts = [r.choice([f"<h1 data-main>{self.words(2, 9)}</h1>", f"<header><h1 data-main>{self.words(2, 9)}</h1></header>", f"<h1 class=title data-main>{self.words(2, 9)}</h1>", ""])]
        for _ in range(r.randint(1, 8)):
            x = r.random() * 1.25
            if x < 0.55:
                parts.append(f"<p{self.leaf()} data-main>{self.prose()}" + r.choice(["</p>", "</p>", "<br>"]))
            elif x < 0.63:
                parts.append(f"<h2{self.leaf()} data-main>{self.words(1, 6)}</h2>")
            elif x < 0.70:
                parts.append("<ul data-main>" + "".join(f"<li>{self.prose()}</li>" for _ in range(r.randint(1, 4))) + "</ul>")
            elif x < 0.75:
                parts.append(f"<blockquote data-main><p>{self.prose()}</p></blockquote>")
            elif x < 0.79:
                parts.append(f"<div data-main>{self.prose()}</div>")
            elif x < 0.82:
                parts.append(f"<section data-main><h3>{self.words(1, 4)}</h3><p>{self.prose()}</p></section>")
            elif x < 0.85:
                parts.append(f"<table data-main><tr><th>{self.words(1, 2)}<td>{self.words(1, 4)}</table>")
            elif x < 0.88:
                parts.append(f"<figure data-main><figcaption>{self.prose()}</figcaption></figure>")
            elif x < 0.90:
                parts.append(f"<pre data-main>{self.words(3, 20)}</pre>")
            elif x < 0.98:  # text of the container itself
                parts.append(f"<span data-main>{self.prose()}</span><br>")
            elif x < 1.02:
                parts.append(f"<div {self.name(_PLAIN)} data-main><p>{self.prose()}</p></div>")
            else:
                parts.append(r.choice([self.advert, self.side, self.form, self.notice])())
        if r.random() < 0.3:
            parts.append(r.choice([self.comments, self.comments, self.footer, self.menu])())
        inside = "".join(parts)
        inner = r.choice(["<article>{}</article>"] * 3 + [f"<article {self.name(_CONTENT)}>{{}}</article>", f"<section {self.name(_CONTENT)}>{{}}</section>", "<div>{}</div>", "{}"] + [f"<div {self.name(_CONTENT)}>{{}}</div>"] * 3)
        outer = r.choice(["<main>{}</main>", '<div role="main">{}</div>', f"<div {self.name(_CONTENT)}>{{}}</div>"] + ["{}"] * 4)
        return outer.format(inner.format(inside))

    def page(self) -> str:
        r = self.r
        before = [f for f, p in ((self.notice, 0.3), (self.header, 0.5), (self.menu, 0.7), (self.form, 0.25), (self.advert, 0.5), (self.side, 0.2)) if r.random() < p]
        after = [f for f, p in ((self.side, 0.4), (self.advert, 0.3), (self.comments, 0.5), (self.form, 0.25), (self.menu, 0.15), (self.footer, 0.8), (self.notice, 0.15)) if r.random() < p]
        r.shuffle(before)
        if r.random() < 0.2:
            before = []
        inside = "".join(f() for f in before) + self.article() + "".join(f() for f in after)
        if r.random() < 0.4:
            inside = f'<div {self.name(["wrapper", "container", "page", "site", "row", "layout"])}>{inside}</div>'
        return f"<html><head><title>{self.words(2, 6)}</title></head><body>{inside}</body></html>"


def labelled_pages(n: int = 2000, seed: int = 5, nameless: float = 0.0) -> list[str]:
    """nameless: share of the pages on which no class or id tells anything; what is left are tags, text and order."""
    return [_Page(seed * 1_000_003 + i, nameless).page() for i in range(n)]

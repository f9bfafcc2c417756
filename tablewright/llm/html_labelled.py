"""Labelled pages for training: layouts whose main text is known, filled with given words.

A layout is put together from parts: a container for the article, its blocks, and around or inside it the things that
are not main text (menus, headers, footers, sidebars, notices, adverts, forms, reader comments). Names and nesting are
drawn per page from the lists below, so a model has to learn from many combinations. Draws depend on the page's number.
"""

from __future__ import annotations

import random
from html import escape

MAIN = ["<article>", "<main>", "<main><article>", '<div id="content">', '<div class="content">', '<div class="post-content">', '<div class="entry-content">', '<div class="article-body">', '<div id="main"><div class="story">',
        '<section class="post">', '<div class="page"><article class="post">', '<div class="text">', '<div role="main">', '<div class="blog-post">', '<td class="content">', '<div id="mw-content-text">', '<div itemprop="articleBody" class="body">']
MENU = ["<nav>", '<div class="menu">', '<div id="nav">', '<ul class="menu">', '<div class="navbar">', '<nav class="main-navigation">', '<div class="breadcrumb">', '<div class="breadcrumbs">', '<div id="top-menu">', '<div role="navigation">', '<ol class="pagination">', '<div class="toc">']
HEAD = ["<header>", '<div id="header">', '<div class="site-header">', '<div class="masthead">', '<header class="page-header">', '<div class="topbar">', '<div role="banner">', '<div class="logo">']
FOOT = ["<footer>", '<div id="footer">', '<div class="footer">', '<footer class="site-footer">', '<div class="copyright">', '<div class="legal">', '<div role="contentinfo">', '<div class="bottom">']
SIDE = ["<aside>", '<div class="sidebar">', '<div id="sidebar">', '<aside class="widget">', '<div class="related">', '<div class="related-posts">', '<div class="widget">', '<div role="complementary">', '<div class="share">', '<div class="social">', '<div class="tags">', '<div class="side">', '<section class="recommended">', '<div class="popular">', '<div class="author-box">']
NOTICE = ['<div class="cookie">', '<div class="cookie-notice">', '<div id="cookie-banner">', '<div class="notice">', '<div class="consent">', '<div class="alert">', '<div class="gdpr">', '<div class="banner">', '<div class="popup">', '<div class="modal">', '<div class="paywall">', '<div role="alert">', '<noscript>', '<div class="disclaimer">', '<dialog>', '<div class="warning">']
ADVERT = ['<div class="ad">', '<div class="ads">', '<div class="advert">', '<div class="advertisement">', '<div class="sponsored">', '<div class="promo">', '<div id="ad-1">', '<aside class="ad">', '<div class="ad-slot">', '<ins class="adsbygoogle">', '<div class="sponsor">', '<div class="promotion">', '<section class="ads">']
FORM = ["<form>", '<form class="search">', '<div class="newsletter"><form>', '<form id="login">', '<div class="subscribe">', '<form class="contact">', '<fieldset>', '<div class="signup">']
COMMENT = ['<div id="comments">', '<section class="comments">', '<div class="comment-list">', '<ul class="comments">', '<div class="comments-area">', '<div class="comment">', '<section id="comments">', '<div id="disqus">', '<div class="user-comments">', '<ol class="commentlist">', '<div class="replies">', '<div class="discussion">', '<aside class="comments">', '<div class="reader-comments">', '<div class="responses">']


def _closing(opening: str) -> str:
    return "".join(f"</{part.split()[0].rstrip('>')}>" for part in reversed(opening.split("<")[1:]))


class _Page:
    def __init__(self, words: list[str], number: int):
        self.draw, self.words, self.main = random.Random(number), words or ["word"], set()

    def text(self, low: int, high: int, sentence: bool) -> str:
        words = [self.draw.choice(self.words) for _ in range(self.draw.randint(low, high))]
        text = " ".join(words)
        return text[:1].upper() + text[1:] + ("." if sentence and text[-1] not in ".!?" else "")

    def within(self, opening: str, inner: str) -> str:
        return opening + inner + _closing(opening)

    def links(self, most: int = 9) -> str:
        names = [self.text(1, 3, False) for _ in range(self.draw.randint(2, most))]
        if self.draw.random() < 0.7:
            return "<ul>" + "".join(f'<li><a href="/{i}">{escape(n)}</a></li>' for i, n in enumerate(names)) + "</ul>"
        return " | ".join(f'<a href="/{i}">{escape(n)}</a>' for i, n in enumerate(names))

    def prose(self, low: int = 6, high: int = 60) -> str:
        return f"<p>{escape(self.text(low, high, True))}</p>"

    def boilerplate(self, kind: list[str]) -> str:
        d, opening = self.draw, self.draw.choice(kind)
        if kind is MENU:
            return self.within(opening, self.links(12))
        if kind is HEAD:
            return self.within(opening, d.choice(["", f"<h1>{escape(self.text(1, 4, False))}</h1>", f"<p>{escape(self.text(2, 8, False))}</p>", f'<div class="logo">{escape(self.text(1, 2, False))}</div>']) + d.choice(["", self.links()]))
        if kind is FOOT:
            return self.within(opening, d.choice(["", self.links()]) + d.choice(["&copy; 2024 ", "&copy; ", ""]) + escape(self.text(2, 20, True)) + d.choice(["", " &middot; " + escape(self.text(2, 12, True)), self.prose(3, 25)]))
        if kind is SIDE:
            return self.within(opening, d.choice(["", f"<h3>{escape(self.text(1, 4, False))}</h3>", f"<h2>{escape(self.text(1, 4, False))}</h2>"]) + d.choice([self.links(), self.prose(4, 30), self.prose(4, 30) + self.links()]))
        if kind is FORM:
            return self.within(opening, d.choice(["", self.prose(3, 15)]) + f'<label>{escape(self.text(1, 3, False))}</label><input name="a"><button>{escape(self.text(1, 2, False))}</button>' + d.choice(["", f"<select><option>{escape(self.text(1, 2, False))}<option>{escape(self.text(1, 2, False))}</select>"]))
        if kind is COMMENT:
            item = d.choice(["<p>{}</p>", "<li>{}</li>", '<div class="comment"><p>{}</p></div>', '<div class="comment-body">{}</div>', "<article><p>{}</p></article>", '<li class="comment"><p>{}</p></li>'])
            return self.within(opening, d.choice(["", f"<h3>{escape(self.text(1, 3, False))}</h3>", f"<h2>{escape(self.text(1, 2, False))}</h2>"]) + "".join(item.format(escape(self.text(4, 50, True))) for _ in range(d.randint(1, 5))))
        return self.within(opening, d.choice([escape(self.text(3, 25, True)), self.prose(3, 30), self.prose(3, 20) + f"<button>{escape(self.text(1, 2, False))}</button>", f'<a href="/x">{escape(self.text(2, 10, True))}</a>']))

    def block(self) -> str:
        d = self.draw
        kind = d.choices(["p", "h2", "ul", "quote", "pre", "table", "bare", "dl"], [30, 4, 3, 2, 1, 1, 2, 1])[0]

        def said(low: int, high: int, sentence: bool = True) -> str:
            text = self.text(low, high, sentence)
            self.main.add(" ".join(text.split()))
            text = escape(text)
            if d.random() < 0.2 and " " in text:
                first, rest = text.split(" ", 1)
                text = d.choice([f"<b>{first}</b> {rest}", f'<a href="/y">{first}</a> {rest}', f"<em>{first} {rest}</em>", f"<b>{first} {rest}<br>"])
            return text

        if kind == "h2":
            return d.choice(["<h2>{}</h2>", "<h3>{}</h3>", "<h4>{}</h4>"]).format(said(1, 8, False))
        if kind == "ul":
            return "<ul>" + "".join(f"<li>{said(2, 20, d.random() < 0.5)}</li>" for _ in range(d.randint(2, 5))) + "</ul>"
        if kind == "quote":
            return f"<blockquote><p>{said(5, 40)}</p></blockquote>"
        if kind == "pre":
            return f"<pre>{said(3, 25, False)}</pre>"
        if kind == "table":
            return "<table>" + "".join(f"<tr><td>{said(1, 4, False)}</td><td>{said(1, 4, False)}</td></tr>" for _ in range(d.randint(1, 3))) + "</table>"
        if kind == "dl":
            return f"<dl><dt>{said(1, 4, False)}</dt><dd>{said(3, 20)}</dd></dl>"
        if kind == "bare":
            return f"<div>{said(8, 60)}</div>"
        return f"<p>{said(1, 90)}" + d.choice(["</p>", "</p>", ""])

    def build(self) -> tuple[str, set[str]]:
        d = self.draw
        opening = d.choice(MAIN) if d.random() < 0.75 else d.choice(MAIN[:3])
        title = self.text(2, 10, d.random() < 0.4)
        parts = []
        if d.random() < 0.85:
            self.main.add(" ".join(title.split()))
            parts.append(f"<h1>{escape(title)}</h1>")
        body = [self.block() for _ in range(d.choice([1, 2, 3, 5, 8, 12, 18]))]
        for kind, chance in ((ADVERT, 0.25), (SIDE, 0.1), (FORM, 0.08), (NOTICE, 0.08), (COMMENT, 0.1)):
            if d.random() < chance:
                body.insert(len(body) if kind is COMMENT else d.randint(0, len(body)), self.boilerplate(kind))
        parts += body
        around = {k: d.random() < p for k, p in (("menu", 0.8), ("head", 0.5), ("foot", 0.85), ("side", 0.5), ("notice", 0.4), ("ad", 0.5), ("form", 0.35), ("comment", 0.5))}
        kinds = {"menu": MENU, "head": HEAD, "foot": FOOT, "side": SIDE, "notice": NOTICE, "ad": ADVERT, "form": FORM, "comment": COMMENT}
        before = [self.boilerplate(kinds[k]) for k in ("notice", "head", "menu", "ad", "form", "side") if around[k] and (k in ("head", "menu") or d.random() < 0.6)]
        after = [self.boilerplate(kinds[k]) for k in ("comment", "side", "form", "ad", "menu", "notice", "foot") if around[k] and (k in ("comment", "foot") or d.random() < 0.4)]
        d.shuffle(before)
        html = "<!DOCTYPE html><html><head><title>" + escape(title) + "</title><style>p{margin:0}</style><script>var a = '</p>';</script></head><body>" + "".join(before) + self.within(opening, "".join(parts)) + "".join(after)
        return html + d.choice(["</body></html>", ""]), self.main


def labelled_pages(words: list[str], count: int, first: int = 0) -> list[tuple[str, set[str]]]:
    """``count`` pages ``(html, texts of the main blocks)``; the same numbers and words give the same pages."""
    return [_Page(words, first + i).build() for i in range(count)]

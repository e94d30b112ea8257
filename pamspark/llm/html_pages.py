"""Labelled pages for training the HTML extractor: invented sites in many layouts whose article is known."""

from __future__ import annotations

import random

WRAPPERS = ["<article>", "<main>", '<div class="content">', '<div id="main-content">', '<div class="post-body entry">', '<section class="story">',
            "<main><article>", '<div class="page"><div class="article-text">', "<div><div>", '<div role="main">', '<td class="text">']
ROLES = {
    "menu": ["<nav>", '<div class="menu">', '<ul id="navigation">', '<div class="breadcrumbs">', '<nav class="main-nav">', '<div role="navigation">'],
    "header": ["<header>", '<div id="header">', '<div class="masthead site-header">', '<div class="topbar">'],
    "footer": ["<footer>", '<div id="footer">', '<div class="site-footer copyright">', '<footer class="bottom">'],
    "side": ["<aside>", '<div class="sidebar">', '<div id="right-rail" class="widget">', '<aside class="related">', '<div class="recommended">'],
    "notice": ['<div class="cookie-notice">', '<div id="gdpr-consent">', '<div class="newsletter popup">', '<div class="notice banner">', '<div role="alert">'],
    "advert": ['<div class="ad">', '<div class="advert sponsored">', '<div id="ad-top">', '<section class="promo">', '<aside class="ads">'],
    "comments": ['<section id="comments">', '<div class="comment-list">', '<ol class="comments discussion">', '<div id="disqus" class="replies">'],
    "share": ['<div class="share social">', '<ul class="social-links">', '<div class="tags">'],
}


def closing(opening: str) -> str:
    tags = [t.split(">")[0].split()[0] for t in opening.split("<")[1:]]
    return "".join(f"</{t}>" for t in reversed(tags))


class Pages:
    """Pages with their main blocks, drawn from a seed."""

    def __init__(self, seed: int):
        self.random = random.Random(seed)

    def word(self) -> str:
        return "".join(self.random.choice("bcdfglmnprstv") + self.random.choice("aeiouéà") for _ in range(self.random.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        text = " ".join(self.word() for _ in range(self.random.randint(low, high)))
        return text[:1].upper() + text[1:]

    def prose(self, low: int, high: int) -> str:
        return " ".join(self.words(3, 14) + self.random.choice([".", ".", ".", "?", ","]) for _ in range(self.random.randint(low, high)))

    def links(self, tag: str) -> str:
        one = [f'<a href="/{self.word()}">{self.words(1, 4)}</a>' for _ in range(self.random.randint(2, 9))]
        return "".join(f"<li>{x}</li>" for x in one) if tag in ("ul", "ol") else " | ".join(one) if self.random.random() < 0.5 else "<ul>" + "".join(f"<li>{x}</li>" for x in one) + "</ul>"

    def clutter(self, role: str) -> str:
        r = self.random
        opening = r.choice(ROLES[role])
        tag = opening[1:].split(">")[0].split()[0]
        if role in ("menu", "share"):
            body = self.links(tag)
        elif role == "comments":
            unit = "li" if tag == "ol" else r.choice(["div", "p", 'div class="comment"'])
            body = "".join(f"<{unit}><b>{self.word()}</b> {self.prose(1, 4)}</{unit.split()[0]}>" for _ in range(r.randint(1, 6)))
            body = (f"<h3>{self.words(1, 2)}</h3>" if tag != "ol" and r.random() < 0.6 else "") + body
        elif role == "side":
            body = f"<h4>{self.words(1, 3)}</h4>" + (self.links("div") if r.random() < 0.6 else f"<p>{self.prose(1, 3)}</p>")
        elif role == "header":
            body = f"<a href='/'>{self.words(1, 3)}</a>" + (f"<p>{self.words(2, 6)}</p>" if r.random() < 0.5 else "")
        elif role == "footer":
            body = f"&copy; {self.words(1, 3)}. {self.words(3, 12)}." if r.random() < 0.6 else f"<p>&copy; {self.words(2, 8)}</p>" + self.links("div")
        else:
            body = self.prose(1, 2) if r.random() < 0.6 else f"<p>{self.prose(1, 2)}</p>"
            body += f"<button>{self.word()}</button>" if role == "notice" else ""
        return opening + body + closing(opening)

    def article(self) -> tuple[str, list[str]]:
        r, parts, blocks = self.random, [], []
        if r.random() < 0.75:
            blocks.append(self.words(2, 10))
            parts.append(f"<h1>{blocks[-1]}</h1>")
        for _ in range(r.choice([1, 1, 2, 3, 4, 6, 9, 14])):
            kind = r.random()
            if kind < 0.08 and parts:
                blocks.append(self.words(1, 6))
                parts.append(f"<h2>{blocks[-1]}</h2>")
            elif kind < 0.16:
                rows = [self.words(2, 12) for _ in range(r.randint(2, 5))]
                blocks += rows
                parts.append("<ul>" + "".join(f"<li>{x}</li>" for x in rows) + "</ul>")
            elif kind < 0.2:
                blocks.append(self.prose(1, 2))
                parts.append(f"<blockquote>{blocks[-1]}</blockquote>")
            else:
                text = self.prose(1, r.choice([1, 3, 6, 12]))
                blocks.append(text)
                if r.random() < 0.15:
                    first, _, rest = text.partition(" ")
                    text = f"<b>{first}</b> {rest}" if r.random() < 0.5 else f'<a href="/x">{first}</a> {rest}'
                parts.append(r.choice([f"<p>{text}</p>"] * 5 + [f"<p>{text}", f"<p><b>{text}<br>", f"<div>{text}</div>"]))
            if r.random() < 0.06:
                parts.append(self.clutter(r.choice(["advert", "side", "share", "notice"])))
        return "".join(parts), blocks

    def page(self) -> tuple[str, list[str]]:
        r = self.random
        body, blocks = self.article()
        opening = r.choice(WRAPPERS)
        above = [self.clutter(k) for k in ("notice", "header", "menu", "advert", "share", "side") if r.random() < 0.45]
        below = [self.clutter(k) for k in ("share", "comments", "side", "advert", "menu", "notice") if r.random() < 0.35]
        below += [self.clutter("footer")] if r.random() < 0.8 else []
        inner = opening + body + (below.pop(0) if below and r.random() < 0.2 else "") + closing(opening)
        if opening.startswith("<td"):
            inner = f"<table><tr>{inner}<td>{self.links('div')}</td></tr></table>"
        if r.random() < 0.15:
            above.append(f"<form><input name=q><label>{self.word()}</label></form>")
        end = "</body></html>" if r.random() < 0.9 else ""
        return (f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title><script>var a='</p>';</script></head><body>"
                + "".join(above) + inner + "".join(below) + end), blocks

"""Made-up labelled pages: what the block labeller learns from, as no table has labelled blocks."""

from __future__ import annotations

import random

# Words that pages use around articles, in four languages.
NOTICES = ["we use cookies to improve this site", "accept all", "nous utilisons des cookies", "wir verwenden cookies", "usamos cookies", "subscribe to our newsletter", "sign up now", "this site requires javascript"]
SOCIAL = ["share", "tweet", "print", "email", "facebook", "follow us", "teilen", "partager", "compartir"]
MENU = ["home", "about", "contact", "news", "sport", "login", "search", "archive", "accueil", "startseite", "inicio", "kontakt"]
FOOT = ["© {w} {w}", "copyright 2020 {w}", "all rights reserved", "privacy policy", "terms of use", "© {w}.example.com · {w} {w}", "impressum", "mentions légales", "aviso legal"]
REPLIES = ["reply", "{w} says", "posted by {w}", "leave a comment", "3 comments", "antworten", "répondre", "responder", "2 days ago"]
FORMS = ["name", "password", "your email", "send", "submit", "username", "remember me", "nom", "senden", "enviar"]
BODY_CLASSES = ["content", "post", "entry", "story", "article-body", "main-content", "post-content", "text", "page-content", "entry-content", "body"]
AD_CLASSES = ["ad", "ads", "advert", "ad-banner", "sponsored", "promo", "advertisement", "banner", "ad-slot"]
SIDE_CLASSES = ["sidebar", "side", "widget", "related", "aside", "more-stories", "recommended"]
NOTICE_CLASSES = ["notice", "cookie", "cookie-banner", "alert", "consent", "newsletter", "popup", "gdpr"]
COMMENT_CLASSES = ["comments", "comment", "comment-list", "discussion", "replies", "responses", "disqus_thread", "fb-comments", "reader-comments", "guestbook", "commentaires", "kommentare"]
FALLBACK = ["please enable javascript", "your browser does not support video", "javascript is required", "your browser doesn't support this element", "icon", "choose a language"]
SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve la que ei ch ge un der ló ción é ü ß ment eau".split()


class Page:
    """Collects the html of a page and, for each leaf block in order, whether it belongs to the article."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.html: list[str] = []
        self.labels: list[int] = []

    def word(self) -> str:
        return "".join(self.r.choices(SYLLABLES, k=self.r.randint(1, 4)))

    def phrase(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def said(self, lists: list[str]) -> str:
        return self.r.choice(lists).replace("{w}", self.word()) if self.r.random() < 0.6 else self.phrase(1, 12)

    def leaf(self, text: str, label: int) -> str:
        self.labels.append(label)
        return text

    def sentence(self) -> str:
        return self.phrase(2, 14).capitalize() + self.r.choice([".", ".", ".", "!", "?", ".%%%", " |", ""])

    def prose(self) -> str:
        return " ".join(self.sentence() for _ in range(self.r.choice([1, 1, 2, 4, 8])))

    def menu(self, tag: str, attributes: str) -> None:
        items = "".join(f"<li><a href='/x'>{self.leaf(self.said(MENU), 0)}</a></li>" for _ in range(self.r.randint(2, 8)))
        self.html.append(f"<{tag}{attributes}><ul>{items}</ul></{tag}>")

    def named(self, names: list[str]) -> str:
        if self.r.random() < 0.12:  # names that say nothing, or none
            names = ["-".join(self.word() for _ in range(self.r.randint(1, 2)))] * self.r.randint(0, 1)
        return f" {self.r.choice(['class', 'class', 'id'])}=\"{self.r.choice(names)}\"" if names else ""

    def aside(self) -> str:
        """An element whose text stands for something else; a block of its own, in the middle of another."""
        text = self.leaf(self.said(FALLBACK), 0)
        return self.r.choice([f"<noscript>{text}</noscript>", f"<svg><title>{self.word()}</title><text>{text}</text></svg>", f"<video controls>{text}</video>", f"<button>{text}</button>", f"<select><option>{text}</select>", f"<object data='x'>{text}</object>"])


def _beside(p: Page, kind: str) -> None:
    """One thing that isn't part of an article."""
    r = p.r
    text = lambda lists: p.leaf(p.prose() if r.random() < 0.5 else p.said(lists), 0)
    if kind == "ad":
        tag = r.choice(["div", "div", "section", "aside", "ins"])
        tag = "div" if tag == "ins" else tag
        inner = text(["buy now", "sponsored", "anzeige", "publicité"])
        p.html.append(f"<{tag}{p.named(AD_CLASSES)}>{inner if r.random() < 0.6 else f'<p>{inner}</p>'}</{tag}>")
    elif kind == "side":
        tag, names = r.choice([("aside", []), ("aside", SIDE_CLASSES), ("div", SIDE_CLASSES), ("section", SIDE_CLASSES)])
        items = "".join(f"<{k}>{text(SOCIAL)}</{k}>" for k in r.choices(["p", "li", "h3", "h4", "div"], k=r.randint(1, 5)))
        p.html.append(f"<{tag}{p.named(names)}>{items}</{tag}>")
    elif kind == "notice":
        p.html.append(f"<div{p.named(NOTICE_CLASSES)}>" + "".join(f"<{k}>{text(NOTICES)}</{k}>" for k in r.choices(["p", "div"], k=r.randint(1, 2))) + "</div>")
    elif kind == "comments":
        tag = r.choice(["div", "section", "ol"])
        one = r.choice(["p", "div", "li"]) if tag != "ol" else "li"
        p.html.append(f"<{tag}{p.named(COMMENT_CLASSES)}>" + "".join(f"<{one}{p.named(['comment', 'reply', 'comment-body'])}>{text(REPLIES)}</{one}>" for _ in range(r.randint(1, 6))) + f"</{tag}>")
    elif kind == "form":
        p.html.append("<form action='/go'>" + "".join(f"<{k}>{text(FORMS)}</{k}>" for k in r.choices(["p", "div"], k=r.randint(1, 4))) + "<input type='text' name='q'></form>")
    elif kind == "social":
        p.html.append(f"<div{p.named(['share', 'social', 'share-bar', 'tags', 'meta', 'byline', 'breadcrumb'])}>" + "".join(f"<div><a href='#'>{text(SOCIAL)}</a></div>" for _ in range(r.randint(1, 4))) + "</div>")
    elif kind == "menu":
        p.menu(*r.choice([("nav", ""), ("nav", ' class="menu"'), ("div", ' class="menu"'), ("div", ' id="navigation"'), ("div", ' class="nav navbar"'), ("header", "")]))


def _article(p: Page, bare: bool = False) -> None:
    """The article; a ``bare`` one has no element of its own, and stretches of text without any."""
    r = p.r
    tag, names = r.choice([("article", []), ("article", []), ("article", []), ("article", BODY_CLASSES), ("main", []), ("div", BODY_CLASSES), ("section", BODY_CLASSES)])
    p.html.append("" if bare else f"<{tag}{p.named(names)}>")
    if r.random() < 0.8:
        head = f"<h1>{p.leaf(p.phrase(1, 10), 1)}</h1>"
        p.html.append(f"<header>{head}</header>" if r.random() < 0.15 else head)
    for i in range(r.choice([1, 1, 2, 3, 5, 8, 12])):
        k = r.random()
        if k < 0.05 and i:
            _beside(p, r.choice(["ad", "side", "form", "social", "notice"]))
        if r.random() < 0.02:
            p.html.append(f"<hr>{p.aside()}<hr>")
        if bare and k < 0.5:
            text = p.leaf(p.prose(), 1)
            p.html.append(f"<hr>{text}<hr>" if r.random() < 0.5 else f"<hr>{text}<br><br>{p.prose()}<hr>")
        elif k < 0.7:
            text = p.leaf(p.prose() if r.random() < 0.85 else p.phrase(1, 3), 1)
            p.html.append(r.choice([f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}</p>", f"<p><b>{text}<br>", f"<p>{text}", f"<div>{text}</div>", f"<p>{text} <a href='/y'>{p.word()}</a></p>", f"<p>{text} <math><mi>{p.word()}</mi></math></p>"]))
        elif k < 0.8:
            items = "".join(f"<li>{p.leaf(p.phrase(1, 12), 1)}</li>" for _ in range(r.randint(1, 5)))
            p.html.append(f"<ul>{items}</ul>" if r.random() < 0.6 else f"<ol>{items}</ol>")
        elif k < 0.9:
            h = r.choice(["h2", "h3", "h4"])
            p.html.append(f"<{h}>{p.leaf(p.phrase(1, 8), 1)}</{h}>")
        elif k < 0.95:
            p.html.append(f"<blockquote><p>{p.leaf(p.prose(), 1)}</p></blockquote>")
        else:
            p.html.append("<table>" + "".join(f"<tr><td>{p.leaf(p.phrase(1, 3), 1)}</td><td>{p.leaf(p.phrase(1, 3), 1)}</td></tr>" for _ in range(r.randint(1, 3))) + "</table>")
    if r.random() < 0.15:
        _beside(p, "comments")
    p.html.append("" if bare else f"</{tag}>")


def _table_page(p: Page) -> None:
    """A page laid out by a table: a column or a line of links, the article in a cell, a line below."""
    r = p.r
    link = lambda: f"<a href='/z'>{p.said(MENU)}</a>"
    bar = lambda: p.leaf(r.choice([" | ", " - ", " &middot; ", " "]).join(link() for _ in range(r.randint(2, 6))), 0)
    foot = lambda: p.leaf(r.choice([p.said(FOOT), f"{p.said(FOOT)} {p.word()}", f"copyright {r.randint(1996, 2024)} {p.word()}", f"last updated {r.randint(1996, 2024)} by {p.word()}"]), 0)
    across = r.random() < 0.6
    p.html.append(f"<table width='100%' border='0'>{f'<tr><td colspan=2>{bar()}</td></tr>' if across else ''}<tr>")
    if not across:
        p.html.append("<td width='150'>" + "".join(f"{p.leaf(link(), 0)}<hr>" if r.random() < 0.5 else f"<p>{p.leaf(link(), 0)}</p>" for _ in range(r.randint(2, 6))) + "</td>")
    p.html.append("<td valign='top'>")
    _article(p, bare=True)
    p.html.append(f"</td></tr>{f'<tr><td>{foot()}</td></tr>' if r.random() < 0.7 else ''}</table>{f'<center>{foot()}</center>' if r.random() < 0.3 else ''}")


def labelled_page(seed: int) -> tuple[str, list[int]]:
    """The html of a page and a label for each of its leaf blocks: 1 for the article's."""
    p = Page(seed)
    r = p.r
    p.html.append("<!DOCTYPE html><html><head><title>x</title><style>p{margin:0}</style><script>var t='</p>';</script></head><body>")
    layout = r.random()
    if layout < 0.06:
        _table_page(p)
        return "".join(p.html), p.labels
    wrapped = r.random() < 0.4
    if r.random() < 0.25:
        _beside(p, "notice")
    if r.random() < 0.35:
        site = f"<h1>{p.leaf(p.phrase(1, 3), 0)}</h1>" if r.random() < 0.3 else f"<div>{p.leaf(p.phrase(1, 4), 0)}</div>"
        p.html.append(f"<header{p.named(['header', 'top', 'masthead'])}>{site}</header>")
    if r.random() < 0.85:
        _beside(p, "menu")
    p.html.append(f'<div id="{r.choice(["wrapper", "page", "container"])}">' if wrapped else "")
    for kind in r.choices(["ad", "side", "social", "form"], [4, 1, 1, 1], k=r.choice([0, 1, 1, 2])):
        _beside(p, kind)
    _article(p, bare=layout < 0.14)
    for kind in r.choices(["ad", "side", "social", "form", "comments", "notice"], [2, 2, 1, 1, 3, 1], k=r.choice([0, 0, 1, 2])):
        _beside(p, kind)
    p.html.append("</div>" if wrapped else "")
    if r.random() < 0.9:
        foot = "".join(f"<{k}>{p.leaf(p.said(FOOT), 0)}</{k}>" for k in r.choices(["p", "div", "li"], k=r.randint(1, 3))) if r.random() < 0.5 else p.leaf(p.said(FOOT) + " " + p.prose(), 0)
        p.html.append(f"<footer>{foot}</footer>" if r.random() < 0.75 else f'<div class="footer">{foot}</div>')
    p.html.append("</body></html>")
    return "".join(p.html), p.labels

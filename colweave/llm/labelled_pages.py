"""Labelled pages for training the content model.

Layouts are written as HTML whose `data-y` attribute says whether an element is part of the main text (1) or not (0);
elements without it take the label of their parent. Slots are filled from a seeded generator: {w} some words, {s} a
sentence, {p} a paragraph, {n} a list of links, {c} several paragraphs as <p>. The attribute is never a feature.

Besides the written layouts, pages are composed: parts of a page that are main text or not, each in several forms and under
one of the names that authors commonly give to it, in containers of several kinds, around and inside the article.
"""

from __future__ import annotations

import random

LAYOUTS = (
    # News page with semantic elements.
    """<html><head><title>{w}</title></head><body data-y="0"><header><a href="/">{w}</a><nav><ul>{n}</ul></nav></header>
    <main><article data-y="1"><h1>{w}</h1><p>{p}</p>{c}<aside data-y="0" class="related"><h3>{w}</h3><ul>{n}</ul></aside>{c}
    <figure><figcaption>{s}</figcaption></figure><p>{s}</p></article></main><footer><p>&copy; {s}</p><ul>{n}</ul></footer></body></html>""",
    # Blog with class names and reader comments.
    """<html><body data-y="0"><div id="header"><h1><a href="/">{w}</a></h1><p>{s}</p></div><div class="menu"><ul>{n}</ul></div>
    <div class="container"><div class="post" data-y="1"><h2>{w}</h2><div class="meta" data-y="0">{w}</div><div class="entry-content">{c}{c}</div></div>
    <div id="comments" class="comments"><h3>{w}</h3><div class="comment"><p>{p}</p></div><div class="comment"><p>{p}</p><p>{s}</p></div>
    <form><label>{w}</label><textarea></textarea><button>{w}</button></form></div></div>
    <div id="sidebar" class="sidebar widget"><h3>{w}</h3><ul>{n}</ul><p>{s}</p></div><div id="footer">{s}</div></body></html>""",
    # Cookie notice, banner, share buttons, newsletter form.
    """<html><body data-y="0"><div class="cookie-notice" role="alert"><p>{p}</p><button>{w}</button></div><div class="banner promo">{s}</div>
    <div id="content" class="main-content" data-y="1"><h1>{w}</h1><ul class="breadcrumb" data-y="0">{n}</ul>{c}<h2>{w}</h2>{c}<ul><li>{s}</li><li>{s}</li></ul>
    <div class="share social" data-y="0"><a href="#">{w}</a><a href="#">{w}</a></div></div><form class="newsletter subscribe"><p>{s}</p><input><button>{w}</button></form>
    <div class="footer copyright"><a href="#">{w}</a> {s}</div></body></html>""",
    # Paragraphs right under the body.
    """<html><body data-y="1"><ul class="nav" data-y="0">{n}</ul><h1>{w}</h1><p>{p}</p>{c}<blockquote><p>{p}</p></blockquote><p>{s}</p>
    <div class="ads sponsored" data-y="0"><p>{s}</p></div><p>{p}</p><hr><address data-y="0">{w}</address></body></html>""",
    # Documentation page with lists, code and a table.
    """<html><body data-y="0"><header class="site-header"><form role="search"><input></form><ul>{n}</ul></header><aside class="toc"><ul>{n}</ul></aside>
    <section class="article-body" role="main" data-y="1"><h1>{w}</h1><p>{p}</p><pre><code>{w}</code></pre><h3>{w}</h3><ol><li>{s}</li><li>{p}</li></ol>
    <table><tr><th>{w}</th><th>{w}</th></tr><tr><td>{w}</td><td>{s}</td></tr></table><p>{p}</p></section>
    <section class="related-posts"><h2>{w}</h2><div><a href="#">{s}</a></div><div><a href="#">{s}</a></div></section><footer class="site-footer"><p>{s}</p><p>{s}</p></footer></body></html>""",
    # Notices, related stories and comments inside the article element.
    """<html><body data-y="0"><div class="topbar"><span>{w}</span><a href="#">{w}</a></div><article class="story" data-y="1"><header><h1>{w}</h1><p>{s}</p></header>
    <div class="notice warning" data-y="0">{s}</div>{c}<div class="advertisement" data-y="0"><p>{p}</p></div>{c}<section class="comments" data-y="0"><h2>{w}</h2><p>{p}</p><p>{p}</p></section>
    <footer data-y="0"><p>{s}</p></footer></article><div class="sidebar"><div class="widget"><h4>{w}</h4><p>{s}</p></div></div></body></html>""",
    # Nested containers without telling names.
    """<html><body data-y="0"><div><div><a href="#">{w}</a> <a href="#">{w}</a> <a href="#">{w}</a></div><div data-y="1"><h1>{w}</h1><div><p>{p}</p><p>{p}</p></div><div><p>{p}</p>{c}</div></div>
    <div><a href="#">{w}</a><a href="#">{w}</a></div></div></body></html>""",
    # Forum-like answers count as reader comments; login form and modal dialog.
    """<html><body data-y="0"><div class="modal popup" role="dialog"><h2>{w}</h2><p>{s}</p><form><input><button>{w}</button></form></div>
    <main id="main"><div class="article-text" itemprop="articleBody" data-y="1"><h1>{w}</h1>{c}<p>{p}</p></div>
    <div class="discussion responses"><article class="reply"><p>{p}</p></article><article class="comment reply"><p>{p}</p></article></div></main>
    <nav class="pagination"><a href="#">{w}</a></nav><footer role="contentinfo"><small>{s}</small></footer></body></html>""",
    # Table layout of older pages.
    """<html><body data-y="0"><table><tr><td class="leftnav"><a href="#">{w}</a><br><a href="#">{w}</a><br><a href="#">{w}</a></td>
    <td class="content" data-y="1"><h1>{w}</h1><p>{p}</p>{c}</td><td class="rightcol advert">{s}</td></tr><tr><td>{w}</td></tr></table></body></html>""",
    # A short article.
    """<html><body data-y="0"><nav role="navigation"><a href="#">{w}</a><a href="#">{w}</a></nav><article data-y="1"><h1>{w}</h1><p>{s}</p></article>
    <div class="ad">{s}</div><aside><p>{s}</p></aside><footer>{w}</footer></body></html>""",
    # Nothing but a menu and a footer.
    """<html><body data-y="0"><nav><ul>{n}</ul></nav><div class="ad banner">{s}</div><footer><p>{s}</p></footer></body></html>""",
)


#: Common names of the parts of a page.
NAMES = {
    "frame": ("wrapper", "container", "row", "col", "inner", "page", "site", "layout", "grid", "outer", "panel"),
    "nav": ("nav", "menu", "navbar", "navigation", "topnav", "mainmenu", "breadcrumbs", "breadcrumb", "pager", "pagination", "toc", "skip", "links", "leftnav", "tabs"),
    "head": ("header", "masthead", "topbar", "branding", "logo", "top", "hero"),
    "foot": ("footer", "bottom", "copyright", "legal", "colophon", "credits", "contentinfo", "imprint"),
    "side": ("sidebar", "aside", "rail", "widget", "related", "recommended", "popular", "tags", "author", "bio", "rightcol", "secondary", "trending", "latest", "teaser"),
    "notice": ("notice", "cookie", "consent", "gdpr", "alert", "warning", "popup", "modal", "overlay", "paywall", "message", "disclaimer", "dialog", "toast", "privacy", "outdated"),
    "advert": ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "banner", "adslot", "adsense", "commercial", "partner"),
    "comments": ("comments", "comment", "responses", "response", "replies", "reply", "discussion", "respond", "feedback", "thread", "reactions", "commentlist", "guestbook"),
    "share": ("share", "social", "sharing", "follow", "buttons", "tools", "print"),
    "form": ("search", "login", "newsletter", "subscribe", "signup", "contact", "register", "form"),
    "meta": ("meta", "byline", "date", "posted", "published", "categories", "info"),
    "main": ("content", "main", "article", "post", "entry", "story", "body", "text", "prose", "copy", "single", "articlebody", "markdown", "document", "reader"),
}
ARTICLE = (
    "<h1>{w}</h1>", "<h2>{w}</h2>", "<h3>{w}</h3>", "<p>{p}</p>", "{c}", "{c}", "{c}", "<p>{s}</p>", "<p>{w}</p>", "<ul><li>{s}</li><li>{s}</li></ul>",
    "<ol><li>{p}</li><li>{s}</li></ol>", "<blockquote><p>{p}</p></blockquote>", "<pre><code>{w}</code></pre>",
    "<table><tr><th>{w}</th><th>{w}</th></tr><tr><td>{w}</td><td>{s}</td></tr></table>", "<figure><img><figcaption>{s}</figcaption></figure>",
    "<dl><dt>{w}</dt><dd>{s}</dd></dl>", "<div>{p}</div>", "<div><p>{p}</p><p>{s}</p></div>", "<section><h2>{w}</h2>{c}</section>", "<p>{s} <a href='#'>{w}</a> {s}</p>",
)
#: Forms of the other parts; @ is the attribute with a name.
OTHERS = {
    "nav": ("<nav@><ul>{n}</ul></nav>", "<div@><ul>{n}</ul></div>", "<ul@>{n}</ul>", "<div@><a href='#'>{w}</a> | <a href='#'>{w}</a> | <a href='#'>{w}</a></div>", "<nav><a href='#'>{w}</a><a href='#'>{w}</a></nav>",
        "<ol@><li><a href='#'>{w}</a></li><li>{w}</li></ol>"),
    "head": ("<header@><a href='#'>{w}</a><p>{s}</p></header>", "<div@><h1><a href='#'>{w}</a></h1><p>{s}</p></div>", "<header><h1>{w}</h1></header>", "<div@><span>{w}</span></div>", "<header@><p>{s}</p><ul>{n}</ul></header>"),
    "foot": ("<footer@><p>{s}</p></footer>", "<div@>{s}</div>", "<footer><ul>{n}</ul><p>&copy; {s}</p></footer>", "<footer@>{w}</footer>", "<div@><p>{s}</p><a href='#'>{w}</a></div>", "<footer><small>{s}</small></footer>"),
    "side": ("<aside@><h3>{w}</h3><ul>{n}</ul></aside>", "<div@><h4>{w}</h4><p>{s}</p></div>", "<aside><p>{p}</p></aside>", "<div@><h3>{w}</h3><div><a href='#'>{s}</a></div><div><a href='#'>{s}</a></div></div>",
        "<section@><h2>{w}</h2><article><h3><a href='#'>{w}</a></h3><p>{s}</p></article><article><h3><a href='#'>{w}</a></h3><p>{s}</p></article></section>"),
    "notice": ("<div@><p>{p}</p><button>{w}</button></div>", "<div@ role='alert'>{s}</div>", "<div@ role='dialog'><h2>{w}</h2><p>{s}</p><a href='#'>{w}</a></div>", "<section@><p>{s}</p></section>", "<p@>{s}</p>",
        "<dialog><p>{s}</p><button>{w}</button></dialog>"),
    "advert": ("<div@>{s}</div>", "<div@><p>{p}</p></div>", "<aside@><a href='#'>{w}</a><p>{s}</p></aside>", "<p@>{s}</p>", "<section@><h4>{w}</h4><p>{s}</p><a href='#'>{w}</a></section>", "<div@><a href='#'>{s}</a></div>"),
    "comments": ("<section@><h2>{w}</h2><p>{p}</p><p>{p}</p></section>", "<div@><h3>{w}</h3><div@><p>{p}</p></div><div@><p>{s}</p></div></div>", "<ol@><li><p>{p}</p></li><li><p>{s}</p><p>{p}</p></li></ol>",
        "<div@><article@><header>{w}</header><p>{p}</p></article><article@><p>{s}</p></article></div>", "<ul@><li>{p}</li><li>{s}</li></ul>",
        "<section@><div><b>{w}</b><p>{p}</p><a href='#'>{w}</a></div><form><textarea></textarea><button>{w}</button></form></section>", "<div@><blockquote>{p}</blockquote><p>{w}</p></div>"),
    "share": ("<div@><a href='#'>{w}</a><a href='#'>{w}</a></div>", "<ul@>{n}</ul>", "<p@><button>{w}</button><button>{w}</button></p>"),
    "form": ("<form@><label>{w}</label><input><button>{w}</button></form>", "<div@><form><p>{s}</p><input></form></div>", "<form><select><option>{w}<option>{w}</select></form>",
        "<section@><h3>{w}</h3><form><input><button>{w}</button></form></section>"),
    "meta": ("<div@>{w}</div>", "<p@>{w}</p>", "<ul@><li>{w}</li><li>{w}</li></ul>"),
}
AROUND = ("head", "nav", "nav", "notice", "advert", "side", "form", "foot", "foot", "comments", "share")
INSIDE = ("notice", "advert", "comments", "share", "side", "nav", "meta", "form")


def composed(rng: random.Random) -> str:
    """A layout of parts in a random order that pages have."""

    def name(kind: str, chance: float) -> str:
        if rng.random() > chance:
            return ""
        names = rng.sample(NAMES[kind], rng.choice((1, 1, 2)))
        if rng.random() < 0.3:
            names[0] += "-" + rng.choice(NAMES[kind] + NAMES["frame"])
        return f" {rng.choice(('class', 'class', 'id'))}='{' '.join(names)}'"

    def other(kind: str, label: str = "") -> str:
        form = rng.choice(OTHERS[kind]).replace("@", name(kind, 1.0))  # without a telling name a part could be anything
        return form.replace(">", label + ">", 1) if label else form

    body = [rng.choice(("<h1>{w}</h1>", "<h1>{w}</h1><p>{s}</p>", "<h2>{w}</h2>", "<header data-y='1'><h1>{w}</h1></header>"))]
    body += [rng.choice(ARTICLE) for _ in range(rng.randint(1, 7))]
    for kind in rng.sample(INSIDE, rng.choice((0, 0, 1, 1, 2, 3))):
        body.insert(rng.randint(1, len(body)), other(kind, " data-y='0'"))
    if rng.random() < 0.25:
        body.append("<footer data-y='0'><p>{s}</p></footer>")
    tag = rng.choice(("article", "article", "main", "div", "div", "div", "section", "td"))
    main = f"<{tag}{name('main', 0.6 if tag in ('article', 'main') else 0.9)} data-y='1'>{''.join(body)}</{tag}>"
    before = [other(k) for k in rng.sample(AROUND, rng.randint(1, 4)) if k not in ("foot", "comments", "share")]
    after = [other(k) for k in rng.sample(AROUND, rng.randint(1, 5)) if k != "head"]
    if tag == "td":
        main = f"<table><tr><td{name('nav', 1.0)}><a href='#'>{{w}}</a><br><a href='#'>{{w}}</a></td>{main}<td{name('side', 1.0)}>{{s}}</td></tr></table>"
    for _ in range(rng.choice((0, 0, 1, 2))):
        beside = other(rng.choice(("side", "comments", "advert"))) if rng.random() < 0.3 else ""
        main = f"<div{name('frame', 0.7)}>{main}{beside}</div>"
    if rng.random() < 0.3:
        main, after = f"<div{name('frame', 0.7)}>{main}{''.join(after)}</div>", []
    return f"<html><head><title>{{w}}</title></head><body data-y='0'>{''.join(before)}{main}{''.join(after)}</body></html>"


def pages(copies: int = 25, seed: int = 7, compositions: int = 600) -> list[str]:
    """`copies` fillings of every written layout, and as many composed pages as `compositions` says."""
    rng = random.Random(seed)
    return filled(LAYOUTS, copies, seed) + filled(tuple(composed(rng) for _ in range(compositions)), 1, seed + 1)


def filled(layouts: tuple[str, ...], copies: int, seed: int) -> list[str]:
    """Layouts with their slots filled."""
    rng = random.Random(seed)
    syllables = "ta ren il mo sha ved ku on per lis ga thu ne or wi".split()

    def words(low: int, high: int) -> str:
        return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(rng.randint(low, high)))

    def sentence() -> str:
        return words(3, 14).capitalize() + "."

    def paragraph() -> str:
        return " ".join(sentence() for _ in range(rng.randint(1, 9)))

    makers = {
        "{w}": lambda: words(1, 5),
        "{s}": sentence,
        "{p}": paragraph,
        "{n}": lambda: "".join(f'<li><a href="#">{words(1, 2)}</a></li>' for _ in range(rng.randint(2, 8))),
        "{c}": lambda: "".join(f"<p>{paragraph() if rng.random() < 0.8 else words(1, 3).capitalize() + '.'}</p>" for _ in range(rng.randint(1, 6))),
    }
    made = []
    for layout in layouts * copies:
        for slot, maker in makers.items():
            while slot in layout:
                layout = layout.replace(slot, maker(), 1)
        made.append(layout)
    return made

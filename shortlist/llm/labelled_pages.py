"""Labelled pages for training: made layouts in which each element is marked as main text (y=1) or not (y=0)."""

from __future__ import annotations

import random

#: Names that sites give the parts of a page, by the part's kind.
MAIN = ["article", "content", "post", "entry", "story", "main", "post-content", "entry-content", "article-body", "page-content",
        "text", "body-text", "blog-post", "markdown", "prose"]
OTHER = {
    "nav": ["nav", "menu", "navbar", "navigation", "main-menu", "breadcrumb", "breadcrumbs", "topnav", "pagination", "pager", "toc", "tabs"],
    "header": ["header", "masthead", "topbar", "site-header", "banner", "logo", "branding", "tagline"],
    "footer": ["footer", "site-footer", "copyright", "legal", "bottom", "colophon", "imprint"],
    "aside": ["sidebar", "aside", "widget", "related", "recommended", "trending", "popular", "more", "teaser", "secondary", "side", "rail"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "adsense", "banner-ad", "commercial"],
    "notice": ["cookie", "cookies", "consent", "notice", "gdpr", "popup", "modal", "overlay", "alert", "message", "paywall", "toast", "banner"],
    "form": ["form", "login", "signup", "search", "newsletter", "subscribe", "contact", "subscription", "register"],
    "comments": ["comments", "comment", "comment-list", "replies", "reply", "discussion", "disqus", "respond", "reviews", "feedback"],
    "share": ["share", "social", "sharing", "follow", "tags", "meta", "byline", "author-bio", "tools", "print"],
}
#: Elements that carry such a part.
CARRIERS = {"nav": ["nav", "div", "ul", "section"], "header": ["header", "div"], "footer": ["footer", "div"],
            "aside": ["aside", "div", "section"], "ad": ["div", "aside", "section", "ins"],
            "notice": ["div", "section", "aside", "dialog"], "form": ["form", "div"],
            "comments": ["section", "div", "ol", "ul"], "share": ["div", "ul", "p"]}


def words(rng: random.Random, low: int, high: int) -> str:
    made = ["".join(rng.choice("aeioubdklmnrst") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(low, high))]
    for i in range(len(made) - 1):
        if rng.random() < 0.1:
            made[i] += rng.choice([",", ".", "."])
    return " ".join(made).capitalize() + "."


def links(rng: random.Random, tag: str) -> str:
    return "".join(f"<{tag}><a href='/{i}'>{words(rng, 1, 3)[:-1]}</a></{tag}>" for i in range(rng.randint(2, 8)))


def other_part(rng: random.Random, kind: str) -> str:
    tag = rng.choice(CARRIERS[kind])
    name = rng.choice(OTHER[kind])
    mark = rng.choice([f" class='{name}'", f" id='{name}'", f" class='{name} box'", f" class='site-{name}'"])
    if tag in ("nav", "footer", "aside", "header", "form") and rng.random() < 0.5:
        mark = ""
    inner = {
        "nav": lambda: f"<ul>{links(rng, 'li')}</ul>" if tag != "ul" else links(rng, "li"),
        "header": lambda: rng.choice([f"<p>{words(rng, 2, 6)}</p>", f"<div>{words(rng, 2, 6)}</div>", f"<h1>{words(rng, 1, 4)}</h1>",
                                      f"<ul>{links(rng, 'li')}</ul>", words(rng, 1, 6)]),
        "footer": lambda: rng.choice([f"&copy; {words(rng, 2, 12)}", f"<p>&copy; {words(rng, 3, 30)}</p>", f"<ul>{links(rng, 'li')}</ul>",
                                      f"<div><p>{words(rng, 3, 20)}</p></div>"]),
        "aside": lambda: rng.choice([f"<h3>{words(rng, 1, 4)}</h3><ul>{links(rng, 'li')}</ul>", f"<p>{words(rng, 5, 40)}</p>",
                                     f"<h4>{words(rng, 1, 4)}</h4><p>{words(rng, 5, 40)}</p>", words(rng, 5, 30)]),
        "ad": lambda: rng.choice([words(rng, 3, 30), f"<p>{words(rng, 3, 30)}</p>", f"<div><a href='/x'>{words(rng, 2, 8)}</a></div>"]),
        "notice": lambda: rng.choice([f"<p>{words(rng, 5, 40)}</p><button>ok</button>", words(rng, 5, 40), f"<div><p>{words(rng, 5, 30)}</p></div>"]),
        "form": lambda: rng.choice([f"<label>{words(rng, 1, 3)}</label><input name='q'>", f"<p>{words(rng, 4, 20)}</p><input name='mail'><button>go</button>",
                                    f"<div><label>{words(rng, 1, 3)}</label></div><h3>{words(rng, 1, 4)}</h3>"]),
        "comments": lambda: "".join(rng.choice([f"<div class='comment'><p>{words(rng, 5, 60)}</p></div>", f"<li class='comment'><p>{words(rng, 5, 60)}</p></li>",
                                                f"<p>{words(rng, 5, 60)}</p>", f"<div id='comment-{rng.randint(1, 99)}'>{words(rng, 5, 60)}</div>"])
                                    for _ in range(rng.randint(1, 5))) if tag in ("ul", "ol") or rng.random() < 0.5 else
        f"<h{(n := rng.randint(2, 4))}>{words(rng, 1, 3)}</h{n}>" + "".join(
            f"<div class='{rng.choice(['comment', 'reply', 'comment-body'])}'><p>{words(rng, 5, 60)}</p></div>" for _ in range(rng.randint(1, 5))),
        "share": lambda: rng.choice([links(rng, "li") if tag == "ul" else links(rng, "span"), words(rng, 2, 5)]),
    }[kind]()
    return f"<{tag} y=0{mark}>{inner}</{tag}>"


def main_part(rng: random.Random, depth: int = 0) -> str:
    kind = rng.random()
    long = words(rng, *rng.choice([(4, 15), (8, 40), (20, 150)]))
    if kind < 0.62:
        return rng.choice([f"<p>{long}</p>", f"<p>{long}", f"<p>{long} <a href='/y'>{words(rng, 1, 3)}</a> {words(rng, 4, 20)}</p>",
                           f"<p><b>{words(rng, 4, 12)}<br>", f"<p>{words(rng, 1, 6)}</p>", f"<div>{long}</div>"])
    if kind < 0.74:
        return f"<h{(n := rng.randint(2, 4))}>{words(rng, 1, 7)}</h{n}>"
    if kind < 0.82:
        return f"<ul>{''.join(f'<li>{words(rng, 2, 25)}</li>' for _ in range(rng.randint(2, 5)))}</ul>"
    if kind < 0.88:
        return rng.choice([f"<blockquote>{long}</blockquote>", f"<blockquote><p>{long}</p></blockquote>", f"<pre>{words(rng, 4, 30)}</pre>",
                           f"<dl><dt>{words(rng, 1, 3)}</dt><dd>{words(rng, 3, 15)}</dd></dl>"])
    if kind < 0.93:
        cells = "".join(f"<tr><td>{words(rng, 1, 3)}</td><td>{words(rng, 1, 5)}</td></tr>" for _ in range(rng.randint(1, 4)))
        return f"<table>{cells}</table>"
    if depth < 2:
        inner = "".join(main_part(rng, depth + 1) for _ in range(rng.randint(1, 4)))
        return f"<{(t := rng.choice(['section', 'div']))}>{inner}</{t}>"
    return f"<figure><figcaption>{words(rng, 3, 15)}</figcaption></figure>"


def labelled_page(rng: random.Random) -> str:
    """A page whose elements follow the nearest `y` mark above them; what has none is not main text, save in plain text."""
    inside = [main_part(rng) for _ in range(rng.choice([1, 2, 3, 4, 6, 9]))]
    if rng.random() < 0.2:  # verses, dialogue, captions: many short paragraphs
        inside += [f"<p>{words(rng, 1, 5)}</p>" for _ in range(rng.choice([5, 15, 40]))]
    for kind in rng.sample(sorted(set(OTHER) - {"header", "footer"}), rng.choice([0, 0, 1, 2])):
        inside.insert(rng.randint(1, len(inside)), other_part(rng, kind))
    title = f"<h1 y=1>{words(rng, 2, 9)}</h1>"
    tag = rng.choice(["article", "article", "main", "div", "div", "section", "td", "bare"])
    name = rng.choice(MAIN)
    mark = rng.choice([f" class='{name}'", f" id='{name}'"])
    if tag in ("article", "main") and rng.random() < 0.6:
        mark = ""
    if rng.random() < 0.7:
        inside.insert(0, rng.choice([title, title, f"<header>{title}</header>"]) if tag == "article" else title)
    if tag == "bare":
        body = "".join(x if " y=" in x[:12] else x.replace(">", " y=1>", 1) for x in inside)
    elif tag == "td":
        body = f"<table><tr><td y=0 class='menu'>{links(rng, 'div')}</td><td y=1{mark}>{''.join(inside)}</td></tr></table>"
    else:
        body = f"<{tag} y=1{mark}>{''.join(inside)}</{tag}>"
    if rng.random() < 0.4:
        body = f"<div class='{rng.choice(['wrapper', 'container', 'row', 'site', 'page', 'inner'])}'>{body}{other_part(rng, 'aside')}</div>"
    before = [other_part(rng, k) for k in rng.sample(["nav", "header", "ad", "notice", "form", "share", "aside"], rng.randint(0, 4))]
    after = [other_part(rng, k) for k in rng.sample(["footer", "comments", "ad", "aside", "share", "nav", "form", "notice"], rng.randint(0, 4))]
    page = f"{''.join(before)}{body}{''.join(after)}"
    if rng.random() < 0.3:
        page = f"<div id='{rng.choice(['page', 'root', 'app', 'wrapper'])}'>{page}</div>"
    if rng.random() < 0.2:  # fragments
        return rng.choice([page, body, body, words(rng, 3, 80)])
    return f"<!DOCTYPE html><html><head><title>x</title></head><body>{page}</body></html>"


def labelled_pages(n: int, seed: int = 5) -> list[str]:
    rng = random.Random(seed)
    return [labelled_page(rng) for _ in range(n)]

"""Labelled pages that the main-text model is trained on: hand-made layouts whose main text is marked.

The tables hold no labelled pages, so layouts of common kinds are written down here, filled with
words of varied length, and combined. A part marked `data-main` is main text, all else is not. Some
paragraphs hold links, few or most of their words; some lists of links belong to the text; readers'
comments may stand inside the article.
"""

from __future__ import annotations

import random

#: {t}: a text of sentences, {s}: a few words, {p}: paragraphs, {m}: the same, each marked, {l}: list items, {a}: list items that are links
MAIN = [
    '<article data-main><h1>{s}</h1>{p}</article>',
    '<article data-main class="post"><h1>{s}</h1><p>{s}.</p>{p}<h2>{s}</h2>{p}<ul>{l}</ul></article>',
    '<main><div data-main class="entry-content"><h1>{s}</h1>{p}<blockquote>{t}</blockquote>{p}</div></main>',
    '<main data-main><h1>{s}</h1>{p}<table><tr><th>{s}</th><td>{s}</td></tr><tr><th>{s}</th><td>{s}</td></tr></table>{p}</main>',
    '<div id="content"><div data-main class="story-body"><h1>{s}</h1>{p}<ol>{l}</ol>{p}</div></div>',
    '<div id="page"><div class="wrap"><div data-main class="article-text"><h2>{s}</h2>{p}{p}</div></div></div>',
    '<section class="main"><div data-main id="article">{t}<p>{t}</p><p>{s}</p>{p}<pre>{t}</pre></div></section>',
    '<article><div data-main class="body"><h1>{s}</h1><p>{s}</p>{p}<figure><figcaption>{s}</figcaption></figure>{p}</div><section class="comments"><h3>{s}</h3><div class="comment"><p>{t}</p></div><div class="comment"><p>{t}</p></div></section></article>',
    '<article><header data-main><h1>{s}</h1></header><div class="share"><a href="#">{s}</a> <a href="#">{s}</a></div><div data-main>{p}</div><aside class="related"><ul>{a}</ul></aside></article>',
    '<article data-main><h1>{s}</h1><p>{s}</p></article>',
    '<article data-main><h1>{s}</h1><p>{t}</p></article>',
    '<main role="main"><h1 data-main>{s}</h1><div data-main>{p}</div><form action="/go"><label>{s}</label><p>{s}</p></form></main>',
    '<article><h1 data-main>{s}</h1>{m}<div id="comments"><p>{t}</p><p>{t}</p></div></article>',
    '<article class="post"><h1 data-main>{s}</h1>{m}<ul data-main>{l}</ul>{m}<div class="comments"><h3>{s}</h3><div class="comment"><p>{t}</p></div></div></article>',
    '<main><h1 data-main>{s}</h1>{m}<section class="replies"><ol><li><p>{t}</p></li><li><p>{t}</p></li></ol></section></main>',
    '<article data-main><h1>{s}</h1>{p}<ul>{a}</ul>{p}</article>',
    '<div data-main class="entry"><h2>{s}</h2><p>{s}</p><ul>{a}</ul></div>',
    '<article data-main><p>{s}</p></article>',
    '<main data-main><p>{s}.</p></main>',
    '<article data-main>{p}<ul>{a}</ul><p>{s}.</p></article>',
    '<main><div data-main class="body">{p}<ul>{a}</ul></div></main>',
    '<article data-main><p>{t}</p><p><a href="/x">{s}</a></p>{p}<ol>{a}</ol></article>',
    '<article><h1 data-main>{s}</h1>{m}<ul data-main>{a}</ul><div class="ad"><p>{t}</p></div>{m}<div class="comment-list"><p>{t}</p><p>{s}</p></div></article>',
]
BEFORE = [
    "<nav><ul>{a}</ul></nav>",
    '<header><a href="/">{s}</a><p>{s}</p></header>',
    '<header class="site-header"><nav><ul>{a}</ul></nav></header>',
    '<div class="menu"><ul>{a}</ul></div>',
    '<div class="cookie-notice"><p>{t}</p><a href="#">{s}</a></div>',
    '<div class="ad">{t}</div>',
    '<div class="banner promo"><p>{t}</p></div>',
    '<div id="breadcrumbs"><a href="/">{s}</a> / <a href="/x">{s}</a></div>',
    '<div role="navigation"><ul>{a}</ul></div>',
    '<form class="search"><label>{s}</label></form>',
    '<div class="notice">{t}</div>',
    "<p>{s}</p>",
    '<div class="alert" role="alert"><p>{t}</p></div>',
]
AFTER = [
    "<footer>{s} &middot; {t}</footer>",
    '<footer><p>{t}</p><ul>{a}</ul></footer>',
    '<aside><h3>{s}</h3><p>{t}</p></aside>',
    '<aside class="sidebar"><ul>{a}</ul></aside>',
    '<div class="sidebar"><h3>{s}</h3><p>{t}</p><ul>{a}</ul></div>',
    '<section id="comments"><h2>{s}</h2><ol><li><p>{t}</p></li><li><p>{t}</p></li></ol></section>',
    '<div class="comment-list"><div class="comment"><b>{s}</b><p>{t}</p></div><div class="comment"><p>{t}</p></div></div>',
    '<div class="newsletter-signup"><form><p>{t}</p><label>{s}</label></form></div>',
    '<div class="related-posts"><h4>{s}</h4><ul>{a}</ul></div>',
    '<div class="advert sponsored"><p>{t}</p></div>',
    '<div class="pagination"><a href="?p=2">{s}</a></div>',
    '<div id="footer">{t}</div>',
    '<div class="disqus replies"><p>{t}</p><p>{t}</p></div>',
    '<div class="copyright">{s}</div>',
]


def labelled_pages(count: int = 600, seed: int = 11, main: list[str] = MAIN, before: list[str] = BEFORE, after: list[str] = AFTER) -> list[str]:
    """Pages with their main text marked by the attribute data-main."""
    rng = random.Random(seed)

    def some_words(n: int) -> str:
        return " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(1, 9))) for _ in range(n))

    def sentences() -> str:
        return " ".join(some_words(rng.randint(1, 24)).capitalize() + "." for _ in range(rng.choice([1, 1, 2, 3, 5, 8])))

    def paragraphs(tag: str) -> str:
        out = []
        for _ in range(rng.randint(1, 6)):
            text = some_words(rng.randint(1, 3)) + "." if rng.random() < 0.2 else sentences()
            if rng.random() < 0.15:
                words = text.split(" ")
                a, b = sorted(rng.choices(range(len(words) + 1), k=2))
                text = " ".join([*words[:a], f'<a href="/x">{" ".join(words[a:b]) or some_words(3)}</a>', *words[b:]])
            out.append(f"{tag}{text}</p>")
        return "".join(out)

    def fill(part: str) -> str:
        makers = {
            "{s}": lambda: some_words(rng.randint(1, 7)),
            "{t}": sentences,
            "{p}": lambda: paragraphs("<p>"),
            "{m}": lambda: paragraphs("<p data-main>"),
            "{l}": lambda: "".join(f"<li>{some_words(rng.randint(2, 12))}</li>" for _ in range(rng.randint(2, 5))),
            "{a}": lambda: "".join(f'<li><a href="/x">{some_words(rng.randint(1, 4))}</a></li>' for _ in range(rng.randint(1, 8))),
        }
        for mark, make in makers.items():
            while mark in part:
                part = part.replace(mark, make(), 1)
        return part

    pages = []
    for _ in range(count):
        parts = rng.sample(before, min(len(before), rng.randint(0, 4))) + [rng.choice(main)] + rng.sample(after, min(len(after), rng.randint(0, 4)))
        body = "".join(map(fill, parts))
        if rng.random() < 0.3:
            body = f'<div class="container">{body}</div>'
        pages.append(f"<html><head><title>{some_words(4)}</title></head><body>{body}</body></html>")
    return pages

"""Labelled pages for training the extractor: made by rule, from a seed, with known main text.

Pages of several kinds of site (journal, manual, wiki, shop, old table layouts, bare pages and pages without
any article) are put together from parts that are main text and parts that are not. Main text carries a
mark that the trainer strips again, so that labels follow from parsing. Words are drawn at random from
invented vocabularies in several scripts: what a page says tells nothing, but for the stock phrases of page
furniture.
"""

from __future__ import annotations

import random
from collections.abc import Callable

LABEL_MARK = "\ue000"

# Class and id names that sites commonly use, by the kind of part.
CONTENT_NAMES = "content post entry entry-content article-body story main-content post-body text article page-content body-copy markdown mw-content".split()
HEADER_NAMES = "header site-header masthead top-bar page-header branding logo hero-nav".split()
MENU_NAMES = "menu nav navbar navigation breadcrumbs breadcrumb main-menu topnav pagination pager toc tabs".split()
NOTICE_NAMES = "cookie cookie-banner notice alert consent newsletter popup gdpr subscribe paywall modal banner".split()
ADVERT_NAMES = "ad ads advert advertisement sponsored promo banner-ad adsbox ad-slot outbrain taboola".split()
SIDE_NAMES = "sidebar related widget recommended side trending more-stories popular see-also".split()
META_NAMES = "share social tags author-box meta byline dateline post-meta author published reading-time".split()
COMMENT_NAMES = "comments comment comment-list disqus_thread responses reply replies discussion user-comments".split()
FOOTER_NAMES = "footer site-footer copyright bottom colophon legal credits".split()

# Stock phrases of page furniture.
NOTICES = "We use cookies. Accept cookies|This site uses cookies, see our privacy policy|Subscribe to our newsletter|Sign up now|Log in to read on|You have read all free articles|Please register".split("|")
FOOTERS = "&copy; 2019|Copyright 2021|All rights reserved|Terms of use|Privacy policy|Imprint|Contact us|© 2024".split("|")
LABELS = "Share|Reply|Login|Menu|Search|Comments|Read more|Advertisement|Sponsored|Related|Follow us|Tags|Next|Previous|Print".split("|")

_ALPHABETS = ("bcdfghklmnprstvw", "aeiou"), ("bdfgklmnrstvz", "aeiouäöü"), ("bcdlmnprst", "aéèeioû"), ("бвгдклмнпрст", "аеиоуы"), ("βγδκλμνπρστ", "αεηιουω")


class _Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.vocabularies = [["".join(self.r.choice(part) for _ in range(self.r.randint(1, 4)) for part in alphabet) for _ in range(300)] for alphabet in _ALPHABETS]
        self.vocabulary = self.vocabularies[0]

    # -- text

    def words(self, low: int, high: int) -> str:
        r = self.r
        found = [self.vocabulary[int(len(self.vocabulary) * r.random() ** 2)] for _ in range(r.randint(low, high))]
        for i in range(len(found)):
            if r.random() < 0.1:
                found[i] += r.choice(",;:")
        return " ".join(found).capitalize()

    def inline(self, text: str) -> str:
        """Text with markup and character references put in."""
        r, out = self.r, []
        for w in text.split(" "):
            kind = r.random()
            if kind < 0.02:
                w = f"<{(tag := r.choice(('em', 'strong', 'code', 'i', 'span')))}>{w}</{tag}>"
            elif kind < 0.035:
                w = f'<a href="/{r.randrange(99)}">{w}</a>'
            elif kind < 0.045:
                w += r.choice(("&nbsp;", "&mdash;", " &amp;", "&#8217;s", "<br>"))
            out.append(w)
        return " ".join(out)

    def main(self, low: int, high: int) -> str:
        return LABEL_MARK + self.inline(self.words(low, high)) + self.r.choice((".", ".", ""))

    def any_length(self) -> str:
        return self.main(*self.r.choice(((1, 3), (3, 12), (10, 40), (30, 120), (100, 250))))

    def phrase(self, stock: list[str]) -> str:
        """Text of page furniture: a stock phrase, made words, or both."""
        kind = self.r.random()
        made = self.words(1, self.r.choice((4, 12, 30)))
        return self.r.choice(stock) if kind < 0.3 else made if kind < 0.7 else f"{self.r.choice(stock)} &middot; {made}"

    def named(self, names: list[str]) -> str:
        r = self.r
        if r.random() < 0.15:
            return ""
        name = r.choice(names)
        more = r.choice(("", "", " wide", " box", f" col-{r.randint(1, 12)}", " clearfix"))
        return r.choice((f' class="{name}{more}"', f" class='{name}'", f' id="{name}"', f' class="{name}" data-n="1"'))

    # -- parts that are not main text

    def links(self) -> str:
        r = self.r
        item = [f'<a href="/{i}">{self.words(1, 3)}</a>' for i in range(r.randint(2, 8))]
        kind = r.random()
        return "<ul>" + "".join(f"<li>{x}</li>" for x in item) + "</ul>" if kind < 0.6 else "<p>" + " | ".join(item) + "</p>" if kind < 0.75 else "".join(f"<div>{x}</div>" for x in item) if kind < 0.85 else " ".join(item)

    def plain(self, stock: list[str] = LABELS) -> str:
        r = self.r
        kind, text = r.random(), self.phrase(stock)
        if kind < 0.3:
            return text
        if kind < 0.55:
            return f"<p>{text}</p>" + (f"<p>{self.phrase(stock)}</p>" if r.random() < 0.3 else "")
        if kind < 0.7:
            return f"<h{(n := r.randint(2, 4))}>{self.words(1, 4)}</h{n}>{self.links()}"
        if kind < 0.85:
            return f"<div>{text}</div><div>{self.words(1, 25)}</div>"
        return f'<span>{text}</span> <a href="/more">{self.words(1, 3)}</a>'

    def form(self) -> str:
        return f'<form action="/go"><label>{self.phrase(LABELS)}</label><input name="q"><select><option>{self.words(1, 2)}</option><option>{self.words(1, 2)}</option></select><button>{self.phrase(LABELS)}</button></form>'

    def boxed(self, names: list[str], tags: tuple[str, ...], stock: list[str] = LABELS) -> str:
        tag = self.r.choice(tags)
        return f"<{tag}{self.named(names)}>{self.plain(stock)}</{tag}>"

    def menu(self) -> str:
        return f"<nav>{self.links()}</nav>" if self.r.random() < 0.5 else f'<{(tag := self.r.choice(("div", "ul", "nav")))} class="{self.r.choice(MENU_NAMES)}">{self.links()}</{tag}>'

    def header(self) -> str:
        inner = self.plain() if self.r.random() < 0.5 else self.menu()
        return f"<header>{inner}</header>" if self.r.random() < 0.5 else f'<div class="{self.r.choice(HEADER_NAMES)}">{inner}</div>'

    def notice(self) -> str:
        return f'<{(tag := self.r.choice(("div", "section", "aside", "p")))} class="{self.r.choice(NOTICE_NAMES)}">{self.phrase(NOTICES) if tag == "p" else self.plain(NOTICES)}</{tag}>'

    def advert(self) -> str:
        return f'<{(tag := self.r.choice(("div", "aside", "section", "p")))} class="{self.r.choice(ADVERT_NAMES)}">{self.phrase(LABELS) if tag == "p" else self.plain()}</{tag}>'

    def side(self) -> str:
        return f"<aside>{self.plain()}</aside>" if self.r.random() < 0.4 else f'<{(tag := self.r.choice(("div", "aside", "section")))} class="{self.r.choice(SIDE_NAMES)}">{self.plain()}</{tag}>'

    def meta(self) -> str:
        return f'<{(tag := self.r.choice(("div", "p", "span", "ul")))} class="{self.r.choice(META_NAMES)}">{self.phrase(LABELS)}</{tag}>'

    def comments(self) -> str:
        r = self.r
        tag = r.choice(("section", "div", "div", "ol", "ul"))
        inner = "li" if tag in ("ol", "ul") else r.choice(("div", "p", "article", "blockquote"))
        body = "".join(f'<{inner} class="{r.choice(("comment", "reply", "comment-body"))}">{self.meta() if r.random() < 0.3 and inner != "p" else ""}{self.words(2, 60)}</{inner}>' for _ in range(r.randint(1, 5)))
        return f'<{tag} {r.choice(("class", "id"))}="{r.choice(COMMENT_NAMES)}"><h{(n := r.randint(2, 4))}>{self.phrase(LABELS)}</h{n}>{body}{self.form() if r.random() < 0.4 else ""}</{tag}>'

    def footer(self) -> str:
        inner = self.phrase(FOOTERS) if self.r.random() < 0.6 else self.plain(FOOTERS)
        return f"<footer>{inner}</footer>" if self.r.random() < 0.6 else f'<div class="{self.r.choice(FOOTER_NAMES)}">{inner}</div>'

    # -- main text

    def piece(self) -> str:
        r = self.r
        kind = r.randrange(16)
        if kind < 7:
            return f"<p>{self.any_length()}" + r.choice(("</p>", "</p>", "</p>", ""))
        if kind == 7:
            return f"<h{(n := r.randint(2, 4))}>{self.main(1, 6)}</h{n}><p>{self.any_length()}</p>"
        if kind == 8:
            return f"<{(tag := r.choice(('ul', 'ol')))}>" + "".join(f"<li>{self.main(1, 15)}" + r.choice(("</li>", "")) for _ in range(r.randint(1, 5))) + f"</{tag}>"
        if kind == 9:
            return f"<blockquote>{r.choice(('', '<p>'))}{self.any_length()}</blockquote>"
        if kind == 10:
            return f"<pre>{self.any_length()}</pre>"
        if kind == 11:
            return "<table>" + "".join(f"<tr><{(cell := r.choice(('td', 'th')))}>{self.main(1, 4)}</{cell}><td>{self.main(1, 4)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>"
        if kind == 12:
            return f'<figure><img src="x.png"><figcaption>{self.main(2, 12)}</figcaption></figure>'
        if kind == 13:
            return f"<dl><dt>{self.main(1, 3)}<dd>{self.main(3, 20)}</dl>"
        return f"<div>{self.any_length()}</div>" if kind == 14 else f"{self.any_length()}<br><br>{self.any_length()}"

    def article(self) -> str:
        r = self.r
        out = [f"<h{(n := r.choice((1, 1, 1, 2)))}>{self.main(1, 12)}</h{n}>"] if r.random() < 0.85 else []
        if r.random() < 0.3:
            out.append(self.meta())
        parts: list[Callable[[], str]] = [self.advert, self.side, self.notice, self.form, self.menu, self.meta]
        for _ in range(r.randint(1, 9)):
            out.append(self.piece())
            if r.random() < 0.12:
                out.append(r.choice(parts)())
        if r.random() < 0.15:
            out.append(self.meta())
        return "".join(out)

    def body(self) -> str:
        r = self.r
        kind, text = r.random(), self.article()
        late = self.comments() if r.random() < 0.1 else ""
        if kind < 0.35:
            return f"<article{self.named(CONTENT_NAMES) if r.random() < 0.4 else ''}>{text}{late}</article>"
        if kind < 0.48:
            return f"<main>{text}</main>"
        if kind < 0.58:
            return f"<main><article{self.named(CONTENT_NAMES)}>{text}{late}</article></main>"
        if kind < 0.8:
            return f'<{(tag := r.choice(("div", "div", "section")))} {r.choice(("class", "id"))}="{r.choice(CONTENT_NAMES)}">{text}{late}</{tag}>'
        if kind < 0.88:
            return f'<table><tr><td class="{r.choice(SIDE_NAMES + MENU_NAMES)}">{self.links()}</td><td>{text}</td></tr></table>'
        return text if kind < 0.95 else f"<div><div>{text}</div></div>"

    def page(self) -> str:
        r = self.r
        self.vocabulary = r.choice(self.vocabularies)
        before: list[str] = [make() for make, share in ((self.header, 0.6), (self.menu, 0.75), (self.notice, 0.35), (self.advert, 0.35), (self.side, 0.2), (self.form, 0.15)) if r.random() < share]
        after: list[str] = [make() for make, share in ((self.comments, 0.35), (self.side, 0.35), (self.advert, 0.2), (self.notice, 0.2), (self.form, 0.15), (self.menu, 0.1)) if r.random() < share]
        r.shuffle(before)
        r.shuffle(after)
        if r.random() < 0.85:
            after.append(self.footer())
        inner = "".join(before) + (self.body() if r.random() < 0.95 else "") + "".join(after)
        if r.random() < 0.3:
            inner = f'<div {r.choice(("class", "id"))}="{r.choice(("wrapper", "container", "page", "layout", "root"))}">{inner}</div>'
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 8)}</title></head><body>{inner}</body></html>"


def labelled_pages(n: int, seed: int) -> list[str]:
    """Pages in which every block of main text, and no other, carries the mark."""
    maker = _Maker(seed)
    return [maker.page() for _ in range(n)]

"""Main text on pages that training has not seen, and parsing."""

from __future__ import annotations

import time
from itertools import product

import numpy as np

from kvlake.llm import html_pages as P
from kvlake.llm import html_text as H


def test_parsing():
    page = """<!DOCTYPE html><title>t</title><body><p>a &amp; <b>b</b><br>c<p>d&nbsp;&eacute;
    x<!-- <p>no --><script>if (a < b) "<p>no"</script ><style>p{}</style><ul><li>1<li>2</ul><div>e<div>f</div>g</div>5 < 6 <textarea>no</textarea><img alt="<p>"><p class='x>y'>h"""
    assert [b.text for b in H.blocks(page)] == ["a & b c", "d é x", "1", "2", "e", "f", "g", "5 < 6", "h"]
    for odd in ("", "<", "<p", "</p></p>", "<!--", "<script>x", "<a href=\"x", "&am", "<p>a<" * 3, "<b " + "x" * 100_000):
        H.blocks(odd)


def test_likelihood_and_gradient():
    """Against the sum over all labelings, and against differences of it."""
    pages = [p for p in P.labelled_pages(300, 3) if 2 <= len(H.blocks(p)) <= 9][:6]
    chains = H.Chains(pages)
    r = np.random.default_rng(1)
    w, move = r.normal(size=(len(chains.names), 2)), r.normal(size=(2, 2))

    def brute(w, move) -> float:
        out = 0.0
        for page in pages:
            found = H.blocks(page)
            emit = np.array([[sum(w[chains.names[f], k] for f in b.features) for k in (0, 1)] for b in found])
            worth = lambda path, emit=emit: sum(emit[i, y] for i, y in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:], strict=False))
            every = [worth(path) for path in product((0, 1), repeat=len(found))]
            out += worth([int(P.LABEL_MARK in b.text) for b in found]) - np.logaddexp.reduce(every)
        return out

    value, gw, gm = chains.likelihood(w, move)
    assert len(pages) == 6 and abs(value - brute(w, move)) < 1e-8
    for x, g in ((w, gw), (move, gm)):
        for at in r.permutation(x.size)[:12]:
            i, k = divmod(int(at), 2)
            step = np.zeros_like(x)
            step[i, k] = 1e-5
            ahead, back = (brute(*((y + sign * step if y is x else y) for y in (w, move))) for sign in (1, -1))
            assert abs((ahead - back) / 2e-5 - g[i, k]) < 1e-5


# Pages written by hand, after the manner of other sites than the maker's: main text blocks start with "*".
BY_HAND = [
    """<html><head><title>T</title></head><body><div id="wrap"><div class="topbar"><a href="/">Home</a> <a href="/b">Blog</a> <a href="/c">About us</a></div>
    <div class="post hentry"><h2 class="entry-title">*How to mend a bicycle tyre</h2><div class="post-meta">Posted on 3 May by Ann</div><div class="entry">
    <p>*Take the wheel off and let the air out. Work round the rim with two levers until one side is free, and pull out the tube.</p><p>*Blow it up a little and listen.</p>
    <blockquote>*My father used a bucket of water for this.</blockquote><ol><li>*Dry the place.<li>*Roughen it.<li>*Put on the patch.</ol></div></div>
    <div id="comments"><h3>2 comments</h3><div class="comment"><p>Thanks, this saved my day, I had given up on it already.</p></div><div class="comment"><p>Nice.</p></div></div>
    <div class="sidebar"><h4>Archive</h4><ul><li><a href="1">May</a><li><a href="2">June</a></ul></div><div id="footer">Copyright 2012 Ann. All rights reserved.</div></div></body></html>""",
    """<!doctype html><body><header><h1><a href="/">The Daily Paper</a></h1><nav><a href=/w>World</a><a href=/s>Sport</a></nav></header><main><article><header><h1>*River floods the old town</h1>
    </header><p>*Water stood a metre high in the streets on Sunday.<p>*The mayor said that the dam had held.<aside class="related"><h3>Related</h3><ul><li><a href=x>Rain to go on</a></ul></aside>
    <figure><img src=a.jpg><figcaption>*The market square on Sunday</figcaption></figure><p>*Schools stay shut until Wednesday.</article></main><div class="cookie-consent"><p>We use cookies. <button>Accept</button></p></div>
    <footer><p>Imprint</p><p>Privacy policy</p></footer></body>""",
    """<HTML><BODY BGCOLOR=white><TABLE><TR><TD CLASS=menu><A HREF=a>Index</A><BR><A HREF=b>Links</A></TD><TD><H1>*My holiday in Wales</H1>*We went by train and it rained all the time.<P>*On the third day the sun came out and we walked up the hill behind the house.
    <P>*Then it rained again.</TD></TR></TABLE><DIV CLASS=footer><HR>&copy; 1998 me</DIV></BODY></HTML>""",
    """<html><body><nav class="navbar"><ul><li><a href="#">Docs</a></li><li><a href="#">API</a></li></ul></nav><div class="content" role="main"><h1>*Installation</h1><p>*Unpack the archive and run the installer.</p>
    <pre>*make install</pre><h2>*Options</h2><table><tr><th>*Name</th><th>*Meaning</th></tr><tr><td>*prefix</td><td>*where the files go</td></tr></table>
    <p style="display:none">internal note that nobody is to see</p><div hidden><p>old text</p></div></div><aside class="sidebar"><p>On this page</p><ul><li><a href="#">Options</a></ul></aside>
    <div class="newsletter"><form><label>Subscribe to our newsletter</label><input><button>Sign up</button></form></div><footer>Edit this page</footer></body></html>""",
    """<html><body><div class="ad">Buy two, get one free.</div><form action="/login"><label>Name</label><input><label>Password</label><input><button>Login</button></form><footer>Terms of use</footer></body></html>""",
]


def test_pages_written_by_hand():
    """Blocks and whole pages of other shapes than the training pages'."""
    field, wrong, n, whole = H.default_field(), 0, 0, 0
    for page in BY_HAND:
        want = [b.text.startswith("*") for b in H.blocks(page)]
        got = field.labels(H.blocks(page.replace("*", "")))
        bad = sum(a != bool(b) for a, b in zip(want, got, strict=True))
        wrong, n, whole = wrong + bad, n + len(want), whole + (bad == 0)
        assert "nobody" not in H.main_text(page, field) and "old text" not in H.main_text(page, field)
    assert wrong <= 0.06 * n and whole >= 3


def test_broken_markup_costs_time_in_proportion():
    for n in (20_000, 40_000):
        start = time.perf_counter()
        assert len(H.blocks("<div class=x>a" * n)) == n
        H.blocks("<p><b>" + "<i>" * n + "<div>a" * n + "</i></u>" * n + "<button><b>" * n + "<div>" * n)
        H.blocks("<a href='" * n + "<!-- " * n)
        took = time.perf_counter() - start
    assert took < 30


def test_hidden_elements_have_no_text():
    page = "<p>a<p hidden>b<div style='color:red; display : none'>c<p>d</div><p aria-hidden=true>e</p><span style=\"visibility:hidden\">f</span>g<p class='hidden-xs'>h<div data-hidden>i"
    assert [b.text for b in H.blocks(page)] == ["a", "g", "h", "i"]


def test_viterbi_is_the_best_path():

    field = H.default_field()
    for page in P.labelled_pages(30, 5):
        blocks = H.blocks(page)[:10]

        def worth(path, blocks=blocks):
            e = sum(field.emit[f][y] for b, y in zip(blocks, path, strict=True) for f in b.features if f in field.emit)
            return e + sum(field.move[a][b] for a, b in zip(path, path[1:], strict=False))

        best = max(map(worth, product((0, 1), repeat=len(blocks))))
        assert abs(worth(field.labels(blocks)) - best) < 1e-6


def test_held_out_accuracy():
    field, wrong, n = H.default_field(), 0, 0
    for page in P.labelled_pages(300, 77):
        want = [P.LABEL_MARK in b.text for b in H.blocks(page)]
        got = field.labels(H.blocks(page.replace(P.LABEL_MARK, "")))
        wrong += sum(a != bool(b) for a, b in zip(want, got, strict=True))
        n += len(want)
    assert wrong <= 0.015 * n


ARTICLE = "<article><h1>Title</h1><p><b>First one.<br><p>Second &amp; last.</p></article>"


def test_frames(spark):
    whole = f'<html><head><title>x</title></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy it now.</div>{ARTICLE}<section class="comments"><p>First!</p></section><footer>&copy; me</footer></body></html>'
    rows = [(1, "u", whole, "old"), (1, "u", whole, "old"), (2, None, None, None), (None, "v", "", None), (3, "w", "<footer>only</footer>", None), (4, "x", whole.replace("First one.", "word " * 50_000), None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = H.extract(df).collect()
    assert [r.text for r in got[:5]] == ["Title\nFirst one.\nSecond & last."] * 2 + [""] * 3
    assert got[5].text == "Title\n" + ("word " * 50_000).strip() + "\nSecond & last."
    assert all(r.n_chars == len(r.text) for r in got)
    assert got[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}
    assert H.extract(df.where("false")).collect() == []

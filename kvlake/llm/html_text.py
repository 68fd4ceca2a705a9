"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A leaf block is a run of text that no block-level tag interrupts. Its features are its own tag, the
tags, classes and ids of its ancestors, and the shape of its text (length, share of links, cue words).
The field is trained by gradient ascent on labelled pages (``html_pages``) on the driver; Viterbi
decoding labels the blocks of each page as main text or not.
"""

from __future__ import annotations

import html
import re
from collections.abc import Container, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .html_pages import LABEL_MARK, labelled_pages

# HTML element kinds and words that mark page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = ("script", "style", "noscript", "template", "title", "textarea", "svg", "iframe", "object", "canvas", "math", "xmp", "noembed", "noframes")
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "label legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = frozenset(BLOCK) - {"body", "html", "head", "button", "label", "option", "optgroup", "select", "legend", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}, "body": {"head"}}
CUES = frozenset("© copyright cookie cookies subscribe newsletter advertisement sponsored menu share comments comment reply login register privacy terms".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|</?[a-zA-Z][^>]*(?:>|\Z)|([^<]+)|<", re.S)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=\s|=|/|$)|\bstyle\s*=\s*[\"'][^\"']*(?:display\s*:\s*none|visibility\s*:\s*hidden)|\baria-hidden\s*=\s*[\"']?true", re.I)
_NAME = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SILENT_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for t in SILENT}


@dataclass
class Block:
    text: str
    features: tuple[str, ...]


@lru_cache(maxsize=4096)
def _names(attributes: str) -> tuple[str, ...]:
    found = []
    for m in _NAME.finditer(attributes):
        value = (m[2] or m[3] or m[4] or "").lower()
        found += [f"c={value}"] + [f"c={x}" for x in re.split(r"[^a-z0-9]+", value) if x and x != value]
    return tuple(dict.fromkeys(found))


class _Open:
    """The open elements. Each tag's places are known, so that an end tag costs no search, and each feature is counted, so that a block costs its distinct features, not its depth."""

    def __init__(self, known: Container[str] | None):
        self.known = known
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[str] = [""]
        self.features: dict[str, int] = {}
        self.hidden = 0

    def push(self, tag: str, attributes: str) -> None:
        names = (f"in={tag}", *(_names(attributes) if "=" in attributes else ()))
        if self.known is not None:
            names = tuple(n for n in names if n in self.known)
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, names))
        for n in names:
            self.features[n] = self.features.get(n, 0) + 1
        if tag in BLOCK:
            self.blocks.append(tag)
        if not self.hidden and attributes and _HIDDEN.search(attributes):
            self.hidden = len(self.stack)

    def close(self, names: Iterable[str], stop: Iterable[str] = ()) -> None:
        """Close the innermost of ``names`` and all in it, unless one of ``stop`` is open within."""
        at = max((p[-1] for n in names if (p := self.places.get(n))), default=-1)
        if at < 0 or any(p[-1] > at for n in stop if (p := self.places.get(n))):
            return
        while len(self.stack) > at:
            tag, held = self.stack.pop()
            self.places[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()
            for n in held:
                self.features[n] -= 1
                if not self.features[n]:
                    del self.features[n]
        if self.hidden > len(self.stack):
            self.hidden = 0


def blocks(page: str, known: Container[str] | None = None) -> list[Block]:
    """The leaf blocks of a page that hold text, in page order; of ancestors' features only ``known`` ones, if given.

    Elements that are marked as hidden have no text. Broken markup is read as browsers do in the main:
    time grows with the page and with a block's distinct features, not with its depth.
    """
    out: list[Block] = []
    opened = _Open(known)
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, _features(opened, text, linked)))
            parts.clear()
        linked = 0

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.match(page, at)
        at = m.end()
        text = m[4]
        if text is not None:
            if opened.hidden:
                continue
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            if opened.places.get("a"):
                linked += len(text)
            continue
        tag = m[2]
        if tag is None:
            if m[0] == "<" and not opened.hidden:
                parts.append("<")
            continue
        tag = tag.lower()
        if m[1]:
            if tag in BLOCK:
                flush()
            opened.close((tag,))
            continue
        if tag in _SILENT_END:
            if not m[3].endswith("/"):
                end = _SILENT_END[tag].search(page, at)
                at = end.end() if end else size
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCK:
            flush()
            if tag in CLOSES_P:
                opened.close(("p",), ("table", "button", "td", "th"))
            if tag in CLOSES:
                opened.close(CLOSES[tag], ("ul", "ol", "dl", "table", "select"))
        if tag not in VOID:
            opened.push(tag, m[3])
    flush()
    return out


def _features(opened: _Open, text: str, linked: int) -> tuple[str, ...]:
    words = text.count(" ") + 1
    found = {"bias", f"own={opened.blocks[-1]}", f"words={min(words.bit_length(), 7)}", f"links={min(3, 4 * linked // max(len(text), 1))}", *opened.features}
    cues = [w for w in text.lower().replace(".", " ").replace(",", " ").split() if w in CUES]
    if 20 * len(cues) >= words:  # a long text may well name one
        found.update(f"cue={w}" for w in cues)
    return tuple(sorted(found))


@dataclass(frozen=True)
class Field:
    """Weights of (label, feature) and of (label, next label)."""

    emit: dict[str, tuple[float, float]]
    move: tuple[tuple[float, float], tuple[float, float]]

    def labels(self, page: list[Block]) -> list[int]:
        """Viterbi: 1 for main text."""
        (aa, ab), (ba, bb) = self.move
        back: list[tuple[int, int]] = []
        s0 = s1 = 0.0
        emit = self.emit
        for i, block in enumerate(page):
            e0 = e1 = 0.0
            for f in block.features:
                w = emit.get(f)
                if w:
                    e0 += w[0]
                    e1 += w[1]
            if i:
                p0, p1 = int(s1 + ba > s0 + aa), int(s1 + bb > s0 + ab)
                back.append((p0, p1))
                s0, s1 = e0 + (s1 + ba if p0 else s0 + aa), e1 + (s1 + bb if p1 else s0 + ab)
            else:
                s0, s1 = e0, e1
        if not page:
            return []
        out = [int(s1 > s0)]
        for pair in reversed(back):
            out.append(pair[out[-1]])
        return out[::-1]


class Chains:
    """Labelled pages as arrays: features, labels, and the places of each page's blocks."""

    def __init__(self, pages: list[str]):
        self.names: dict[str, int] = {}
        rows, cols, labels, lengths = [], [], [], []
        for page in pages:
            parsed = blocks(page)
            lengths.append(len(parsed))
            for b in parsed:
                for f in b.features:
                    rows.append(len(labels))
                    cols.append(self.names.setdefault(f, len(self.names)))
                labels.append(int(LABEL_MARK in b.text))
        self.row, self.col, self.y = np.array(rows, int), np.array(cols, int), np.array(labels, int)
        length = np.array(lengths)
        first = np.cumsum(length) - length
        self.steps = int(length.max(initial=0))
        self.live = np.arange(self.steps)[None, :] < length[:, None]
        self.place = np.where(self.live, first[:, None] + np.arange(self.steps), 0)
        self.gold = np.zeros((len(labels), 2))
        self.gold[np.arange(len(labels)), self.y] = 1
        self.pair = np.zeros((2, 2))
        for s, n in zip(first, length, strict=True):
            np.add.at(self.pair, (self.y[s : s + n - 1], self.y[s + 1 : s + n]), 1)

    def likelihood(self, w: np.ndarray, move: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log-likelihood of the labels, and its gradients, by the forward and the backward pass."""
        emit = np.stack([np.bincount(self.row, w[self.col, k], len(self.y)) for k in (0, 1)], axis=1)
        e, live = emit[self.place], self.live
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        for t in range(self.steps):
            now = e[:, t] + (np.logaddexp.reduce(alpha[:, t - 1, :, None] + move, axis=1) if t else 0)
            alpha[:, t] = np.where(live[:, t, None], now, alpha[:, t - 1] if t else 0)
        for t in range(self.steps - 2, -1, -1):
            ahead = np.logaddexp.reduce(move + (e[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
            beta[:, t] = np.where(live[:, t + 1, None], ahead, 0)
        z = np.logaddexp.reduce(alpha[:, -1], axis=1)
        single = np.exp(alpha + beta - z[:, None, None])[live]
        both = np.exp(alpha[:, :-1, :, None] + move + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None])[live[:, 1:]]
        miss = self.gold - single
        value = float((self.gold * emit).sum() + (self.pair * move).sum() - z[live[:, 0]].sum())
        return value, np.stack([np.bincount(self.col, miss[self.row, k], len(self.names)) for k in (0, 1)], axis=1), self.pair - both.sum(axis=0)


def train(pages: list[str], epochs: int = 200, rate: float = 0.1, l2: float = 0.0005) -> Field:
    """Maximum likelihood by Adam over all pages at once; ``pages`` carry the label mark in main text."""
    chains = Chains(pages)
    w, move = np.zeros((len(chains.names), 2)), np.zeros((2, 2))
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, move)]
    for epoch in range(1, epochs + 1):
        _, *grads = chains.likelihood(w, move)
        for x, g, (m, v) in zip((w, move), grads, moments, strict=True):
            g = g / len(pages) - l2 * x
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            x += rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-6)
    return Field({f: (float(w[i, 0]), float(w[i, 1])) for f, i in chains.names.items()}, ((float(move[0, 0]), float(move[0, 1])), (float(move[1, 0]), float(move[1, 1]))))


@lru_cache(maxsize=2)
def default_field(pages: int = 800, seed: int = 11) -> Field:
    """The field trained on ``pages`` made pages: some seconds on the driver, once a session."""
    return train(labelled_pages(pages, seed))


def main_text(page: str | None, field: Field) -> str:
    found = blocks(page, field.emit) if page else []
    return "\n".join(b.text for b, label in zip(found, field.labels(found), strict=True) if label)


def _rows(field: Field, html_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                texts = [main_text(x.as_py(), field) for x in part.column(html_at)]
                keep = [c for i, c in enumerate(part.columns) if i != html_at]
                names = [n for i, n in enumerate(part.schema.names) if i != html_at]
                yield pa.RecordBatch.from_arrays([*keep, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"])

    return run


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """page_id, url, text, n_chars of each row of ``pages`` (page_id, url, html); one pass, no shuffle.

    A null or empty html, or one without main text, gives ''. Rows are taken one by one, so repeated
    rows and null ids come out as they went in; other columns are not read.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(_rows(field or default_field(), 2), f"page_id {kind}, url string, text string, n_chars long")

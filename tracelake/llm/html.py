"""Main text of web pages by gradient-boosted trees over the nodes of the page, decoded down the tree.

The trees judge every block element by its features: how dense its subtree is in text and links, the words of its
attributes, its depth, its siblings. The decoder then keeps or drops whole subtrees: what stands inside a kept or a dropped
element shares its fate, and only an element that is neither is looked into, so no choice contradicts one above it.

No table says which parts of a page are its article. The trees are trained here, on pages that ``example_page`` lays out
in many ways and marks.
"""

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.llm.dom import TOKENS, Page, features, parse

MARK = "\ue000"  # a private character that marks article text of example pages


# --- example pages -------------------------------------------------------------------------------------------------


class _Writer:
    """Random text and elements."""

    def __init__(self, random: np.random.Generator):
        self.random = random
        syllables = "an be co de er fi ga ho in ju ka le mi no or pa re sa ti un ve wi".split()
        self.words = ["".join(random.choice(syllables, int(random.integers(1, 5)))) for _ in range(400)]

    def chance(self, p: float) -> bool:
        return bool(self.random.random() < p)

    def pick(self, *options):
        return options[int(self.random.integers(0, len(options)))]

    def some(self, least: int, most: int) -> range:
        return range(int(self.random.integers(least, most + 1)))

    def run(self, least: int, most: int, mark: str = "") -> str:
        count = int(self.random.integers(least, most + 1))
        return " ".join(mark + self.words[int(i)] for i in self.random.integers(0, len(self.words), count))

    def prose(self, sentences: int, mark: str = "") -> str:
        return " ".join(
            f"{self.run(3, 16, mark).capitalize()}{',' if self.chance(0.3) else ''} {self.run(2, 8, mark)}."
            for _ in range(max(1, sentences))
        )

    def token(self, *groups: str) -> str:
        """A class or id with a word of these groups, alone or beside another; sometimes none at all."""
        if self.chance(0.2):
            return ""
        word = self.pick(*TOKENS[self.pick(*groups)].split())
        beside = self.pick("", "", f"-{self.pick(*self.words)}", " block", "-inner", "1")
        return f' {self.pick("class", "id", "class")}="{word}{beside}"'

    def link(self, least: int = 1, most: int = 3) -> str:
        return f'<a href="/{self.pick(*self.words)}">{self.run(least, most)}</a>'


def _menu(w: _Writer) -> str:
    links = [w.link() for _ in w.some(3, 12)]
    if w.chance(0.7):
        tag = w.pick("ul", "ol", "ul")
        inner = f"<{tag}>{''.join(f'<li>{x}</li>' for x in links)}</{tag}>"
    else:
        inner = w.pick(" | ", " ", "<br>").join(links)
    return f"<nav>{inner}</nav>" if w.chance(0.5) else f"<div{w.token('navigation')}>{inner}</div>"


def _advert(w: _Writer) -> str:
    text = w.prose(int(w.random.integers(1, 4)))
    inner = w.pick(text, f"<p>{text}</p>", f"{text} {w.link()}", f"<h4>{w.run(2, 5)}</h4><p>{text}</p>")
    word = w.pick(*TOKENS["advert"].split())
    tag = w.pick("div", "div", "aside", "section")
    return f'<{tag} {w.pick("class", "id")}="{word}{w.pick("", "-box", "1", " unit")}">{inner}</{tag}>'


def _notice(w: _Writer) -> str:
    inner = f"<p>{w.prose(int(w.random.integers(1, 4)))}</p>{w.pick('', w.link(), '<button>ok</button>')}"
    word = w.pick(*TOKENS["notice"].split())
    return f'<{w.pick("div", "section", "aside")} {w.pick("class", "id", "role")}="{word}">{inner}</div>'


def _form(w: _Writer) -> str:
    inner = f"<label>{w.run(1, 4)}</label><input name=q><p>{w.prose(1)}</p><button>{w.run(1, 2)}</button>"
    return f"<form{w.token('form')}>{inner}</form>" if w.chance(0.7) else f'<div class="newsletter">{inner}</div>'


def _comments(w: _Writer) -> str:
    def one() -> str:
        body = "".join(f"<p>{w.prose(int(w.random.integers(1, 4)))}</p>" for _ in w.some(1, 2))
        return w.pick(f"<b>{w.run(1, 2)}</b>{body}", f"<h5>{w.run(1, 2)}</h5>{body}{w.link(1, 1)}", body)

    word = w.pick(*TOKENS["comment"].split())
    many = [one() for _ in w.some(1, 7)]
    if w.chance(0.5):
        inner = f"<ol>{''.join(f'<li>{x}</li>' for x in many)}</ol>"
    else:
        inner = "".join(f'<{w.pick("div", "article")}{w.pick("", " class=comment")}>{x}</div>' for x in many)
    head = f"<h3>{w.run(1, 3)}</h3>" if w.chance(0.6) else ""
    return f'<{w.pick("section", "div")} {w.pick("id", "class")}="{word}">{head}{inner}</section>'


def _sidebar(w: _Writer) -> str:
    parts = [
        w.pick(f"<h3>{w.run(1, 4)}</h3>", "") + "<ul>" + "".join(f"<li>{w.link(2, 7)}</li>" for _ in w.some(2, 7)) + "</ul>",
        f"<p>{w.prose(int(w.random.integers(1, 5)))}</p>",
        _advert(w),
    ]
    inner = "".join(w.pick(*parts) for _ in w.some(1, 4))
    if w.chance(0.5):
        return f"<aside{w.token('furniture')}>{inner}</aside>"
    return f'<div {w.pick("class", "id")}="{w.pick("sidebar", "rail", "widget", "aside", "related")}">{inner}</div>'


def _header(w: _Writer) -> str:
    inner = f"{w.pick(f'<h1>{w.run(1, 3)}</h1>', f'<p>{w.run(1, 4)}</p>', w.link())}{w.pick(_menu(w), '', _form(w))}"
    if w.chance(0.6):
        return f"<header{w.token('furniture')}>{inner}</header>"
    return f'<div {w.pick("class", "id")}="{w.pick("header", "masthead", "topbar", "logo")}">{inner}</div>'


def _footer(w: _Writer) -> str:
    parts = [f"&copy; {w.run(1, 3)} &middot; {w.prose(1)}", f"<p>{w.prose(2)}</p>", " ".join(w.link() for _ in w.some(2, 8))]
    inner = "".join(w.pick(*parts) for _ in w.some(1, 3))
    if w.chance(0.7):
        return f"<footer{w.token('furniture')}>{inner}</footer>"
    return f'<div {w.pick("class", "id")}="{w.pick("footer", "foot", "copyright", "legal", "bottom")}">{inner}</div>'


def _social(w: _Writer) -> str:
    inner = "".join(w.pick(f"<li>{x}</li>", x) for x in (w.link() for _ in w.some(2, 6)))
    return f'<div class="{w.pick(*TOKENS["social"].split())}">{inner}</div>'


def _article(w: _Writer) -> str:
    def part() -> str:
        text = w.prose(int(w.random.integers(1, 9)), MARK)
        roll = w.random.random()
        if roll < 0.70:
            return w.pick(f"<p>{text}</p>", f"<p>{text}</p>", f"<p><b>{text}<br>", f"<p>{text} <a href=x>{w.run(1, 3, MARK)}</a> {w.prose(1, MARK)}")
        if roll < 0.80:
            return f"<{w.pick('h2', 'h3')}>{w.run(1, 7, MARK)}</h2>"
        if roll < 0.87:
            return "<ul>" + "".join(f"<li>{w.run(2, 14, MARK)}</li>" for _ in w.some(2, 6)) + "</ul>"
        if roll < 0.92:
            return f"<blockquote><p>{text}</p></blockquote>"
        if roll < 0.95:
            return f"<figure><img src=x><figcaption>{w.run(2, 9, MARK)}</figcaption></figure>"
        if roll < 0.98:
            return "<table>" + "".join(f"<tr><td>{w.run(1, 3, MARK)}<td>{w.run(1, 3, MARK)}</tr>" for _ in w.some(2, 5)) + "</table>"
        return f"<pre>{w.run(5, 20, MARK)}</pre>"

    parts = [part() for _ in range(int(np.ceil(w.random.exponential(7))))]
    if w.chance(0.15):
        parts = [f"<p>{w.pick(w.run(1, 6, MARK) + '.', w.prose(1, MARK))}</p>"]
    for extra, p in ((_advert, 0.15), (_social, 0.15), (_sidebar, 0.04)):
        if w.chance(p):
            parts.insert(int(w.random.integers(0, len(parts) + 1)), extra(w))
    title = f"<h1>{w.run(2, 14, MARK)}</h1>"
    title = w.pick(title, title, f"<header>{title}</header>", "")
    tag = w.pick("article", "article", "main", "div", "section", "div")
    attributes = w.token("content") if w.chance(0.6) else ""
    body = "".join(parts)
    if w.chance(0.25):
        body = f"<div{w.token('content')}>{body}</div>"
    return f"<{tag}{attributes}>{title}{body}</{tag}>"


def example_page(random: np.random.Generator) -> str:
    """A page in one of many layouts; every word of its article begins with ``MARK``."""
    w = _Writer(random)
    top = [part(w) for part, p in ((_notice, 0.25), (_header, 0.5), (_menu, 0.75), (_advert, 0.5)) if w.chance(p)]
    middle = [_article(w)]
    for part, p in ((_sidebar, 0.45), (_comments, 0.4), (_social, 0.2), (_advert, 0.25), (_form, 0.15)):
        if w.chance(p):
            middle.append(part(w)) if part is _comments or w.chance(0.7) else middle.insert(0, part(w))
    low = [part(w) for part, p in ((_social, 0.1), (_form, 0.1), (_footer, 0.85), (_notice, 0.1)) if w.chance(p)]
    inner = "".join(middle)
    if w.chance(0.4):
        inner = f"<{w.pick('div', 'main', 'div')}{w.pick('', w.token('content'))}>{inner}</div>"
    head = f"<head><title>{w.run(1, 6)}</title><style>p{{}}</style><script>var t='</p>';</script></head>"
    body = "".join(top) + inner + "".join(low)
    return f"<!DOCTYPE html><html>{head}<body>{body}{w.pick('</body></html>', '</body></html>', '')}"


# --- boosted trees -------------------------------------------------------------------------------------------------


@dataclass
class Trees:
    """Complete binary trees: the feature and the threshold of every inner node, and the value of every leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def logits(self, rows: np.ndarray) -> np.ndarray:
        """The sum over all trees for every row."""
        out = np.full(len(rows), self.base)
        every = np.arange(len(rows))
        inner = self.feature.shape[1]
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(rows), dtype=np.int64)
            while inner and at[:1].size and at[0] < inner:
                at = 2 * at + 1 + (rows[every, feature[at]] > threshold[at])
            out += value[at - inner]
        return out


def boost(
    rows: np.ndarray, labels: np.ndarray, weights: np.ndarray, trees: int = 48, depth: int = 4, rate: float = 0.25, bins: int = 32
) -> Trees:
    """Logistic gradient boosting with second-order gains over quantile bins."""
    cuts = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(rows.shape[1])]
    binned = np.column_stack([np.searchsorted(cuts[f], rows[:, f], "left") for f in range(rows.shape[1])])
    share = np.clip((labels * weights).sum() / weights.sum(), 1e-4, 1 - 1e-4)
    base = float(np.log(share / (1 - share)))
    out, inner = np.full(len(rows), base), (1 << depth) - 1
    model = Trees(np.zeros((trees, inner), int), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)), base)
    width = bins + 1
    for t in range(trees):
        p = 1 / (1 + np.exp(-out))
        gradient, hessian = weights * (p - labels), weights * p * (1 - p)
        at = np.zeros(len(rows), dtype=np.int64)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            here = at - first
            best = np.zeros(count)
            for f, cut in enumerate(cuts):
                if not len(cut):
                    continue
                slot = here * width + binned[:, f]
                g = np.bincount(slot, gradient, count * width).reshape(count, width).cumsum(axis=1)
                h = np.bincount(slot, hessian, count * width).reshape(count, width).cumsum(axis=1)
                left = g[:, : len(cut)] ** 2 / (h[:, : len(cut)] + 1)
                right = (g[:, -1:] - g[:, : len(cut)]) ** 2 / (h[:, -1:] - h[:, : len(cut)] + 1)
                gain = left + right - g[:, -1:] ** 2 / (h[:, -1:] + 1)
                pick = gain.argmax(axis=1)
                better = gain[np.arange(count), pick] > best + 1e-9
                best[better] = gain[np.arange(count), pick][better]
                model.feature[t, first : first + count][better] = f
                model.threshold[t, first : first + count][better] = cut[pick[better]]
            at = 2 * at + 1 + (rows[np.arange(len(rows)), model.feature[t, at]] > model.threshold[t, at])
        leaf = at - inner
        g, h = np.bincount(leaf, gradient, inner + 1), np.bincount(leaf, hessian, inner + 1)
        model.value[t] = -rate * g / (h + 1)
        out += model.value[t, leaf]
    return model


def _labelled(source: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, whether a node's text is article, and the weight of every node with text of a marked page. A container
    counts as article if hardly anything in it is not."""
    page = parse(source)
    marked = np.zeros((len(page.nodes), 2))
    for i, node in enumerate(page.nodes):
        for is_text, number in node.items:
            if is_text:
                text = page.texts[number]
                marked[i] += (len(text), len(text) if MARK in text.lower() else 0)
    page.texts = [text.replace(MARK, "") for text in page.texts]
    for i in range(len(page.nodes) - 1, 0, -1):
        marked[page.nodes[i].parent] += marked[i]
    used = marked[:, 0] > 0
    labels = (marked[:, 1] > 0.95 * marked[:, 0]).astype(float)
    return features(page)[used], labels[used], np.log1p(marked[:, 0])[used]


def train(pages: int = 700, seed: int = 2) -> Trees:
    """Fit the trees on so many example pages."""
    random = np.random.Generator(np.random.PCG64(seed))
    rows, labels, weights = zip(*(_labelled(example_page(random)) for _ in range(pages)), strict=True)
    return boost(np.concatenate(rows), np.concatenate(labels), np.concatenate(weights))


# --- decoding ------------------------------------------------------------------------------------------------------


def decode(page: Page, logits: np.ndarray, split: float = 0.5) -> list[int]:
    """The numbers of the text blocks to keep, in page order.

    A node can be kept whole, dropped whole, or be looked into, which costs ``split``; its own text then goes with the
    better of its two choices. Text counts by its node's logit, for keeping or against it; a container that is kept whole
    adds its own logit, which says whether it holds nothing but article. The choice with the greatest sum is taken.
    """
    nodes = page.nodes
    n = len(nodes)
    own_chars = [0] * n
    for i, node in enumerate(nodes):
        for is_text, number in node.items:
            if is_text:
                own_chars[i] += len(page.texts[number])
    chars = own_chars.copy()
    for i in range(n - 1, 0, -1):
        chars[nodes[i].parent] += chars[i]
    sure = np.clip(logits, -6, 6).tolist()
    text = np.clip(logits, -4, 4).tolist()
    keep, drop, look = [0.0] * n, [0.0] * n, [0.0] * n
    own = [text[i] * math.log1p(own_chars[i]) for i in range(n)]
    for i in range(n - 1, -1, -1):
        container = sure[i] * math.log1p(chars[i]) if chars[i] > own_chars[i] else 0.0
        keep[i] += own[i] + container
        drop[i] -= own[i]
        look[i] += abs(own[i]) - split
        if i:
            parent = nodes[i].parent
            keep[parent] += keep[i]
            drop[parent] += drop[i]
            look[parent] += max(keep[i], drop[i], look[i])
    kept: list[int] = []
    todo: list[tuple[bool, int, bool | None]] = [(False, 0, None)]
    while todo:
        is_text, number, decided = todo.pop()
        if is_text:
            if decided:
                kept.append(number)
            continue
        choice = decided
        if choice is None and look[number] < max(keep[number], drop[number]):
            choice = keep[number] > drop[number]
        mine = own[number] > 0 if choice is None else choice
        todo.extend((plain, item, mine if plain else choice) for plain, item in reversed(nodes[number].items))
    return kept


def main_text(source: str | None, model: Trees) -> str:
    """The main text of a page: blocks in page order, joined by an empty line."""
    page = parse(source or "")
    if not page.texts:
        return ""
    kept = decode(page, model.logits(features(page)))
    return "\n\n".join(page.texts[number] for number in kept)


def extract_main_text(pages: DataFrame, model: Trees, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, text and n_chars (code points) of every page.

    A null html counts as empty; a page without text, or of which nothing is kept, has the empty text. Rows with equal keys
    are pages of their own; nulls in key and url stay. Other columns play no part. An empty table gives an empty result.
    """

    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            parsed = [parse(source) if isinstance(source, str) else parse("") for source in batch]
            rows = [features(page) for page in parsed]
            logits = model.logits(np.concatenate(rows)) if rows else np.zeros(0)
            out, at = [], 0
            for page, table in zip(parsed, rows, strict=True):
                kept = decode(page, logits[at : at + len(table)]) if page.texts else []
                at += len(table)
                out.append("\n\n".join(page.texts[number] for number in kept))
            yield pd.Series(out, dtype=object)

    text = F.pandas_udf(extract, T.StringType())
    found = pages.select(F.col(key), F.col(url), text(F.col(html)).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("bigint"))

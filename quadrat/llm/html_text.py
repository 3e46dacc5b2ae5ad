"""Main text of web pages with a linear-chain conditional random field over the page's leaf blocks.

A page is read into leaf blocks: runs of text between block-level tags, in page order. Features of a block are its tags and
those above it, the names (class, id, role) given to them, and the shape of its text. The field has one weight per feature
and one per pair of neighbouring labels; it is fitted by gradient steps on the conditional likelihood of labelled pages, and
decoded with Viterbi's algorithm.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from quadrat.llm.html_pages import labelled_page

#: Labelled pages that the field is fitted on, rounds over them, step and pull towards zero.
PAGES, EPOCHS, STEP, DECAY = 500, 8, 0.3, 1e-3

#: How elements are read.
SKIPPED = {"script", "style", "noscript", "template", "head", "iframe", "object", "canvas", "select", "textarea", "audio", "video"}
#: Tags that leave an open head open; any other, and text, ends it.
HEAD = {"html", "head", "title", "meta", "link", "base", "basefont", "bgsound", "script", "style", "noscript", "noframes", "template"}
RAW_TEXT = {"script", "style", "textarea", "title", "iframe", "noscript"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "rp",
          "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
          "math", "mi", "mn", "mo", "ms", "mtext", "mspace", "mrow", "mfrac", "msqrt", "mroot", "mstyle", "merror", "mpadded", "mphantom", "mfenced", "menclose", "msub",
          "msup", "msubsup", "munder", "mover", "munderover", "mmultiscripts", "mprescripts", "mtable", "mtr", "mtd", "semantics", "annotation"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = {"ul", "ol", "dl", "table", "article", "section", "div", "main", "body", "nav", "aside", "form", "footer", "header"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_NAMES = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_LETTERS = re.compile(r"[a-z]+")


class Block:
    __slots__ = ("text", "tags", "names", "linked")

    def __init__(self, text: str, tags: tuple[str, ...], names: frozenset[str], linked: int):
        self.text, self.tags, self.names, self.linked = text, tags, names, linked


def leaf_blocks(page: str | None) -> list[Block]:
    """Leaf blocks of a page: character references decoded, white space turned to single spaces, trimmed, none empty."""
    page = page or ""
    stack: list[tuple[str, frozenset[str]]] = []
    blocks, parts, linked, in_link, skipping = [], [], 0, False, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            blocks.append(Block(text, tuple(t for t, _ in stack), frozenset().union(*(n for _, n in stack)), min(linked, len(text))))
        parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if stack and stack[-1][0] == "head" and text.strip():
            close(len(stack) - 1)
        if text and not skipping:
            parts.append(text)
            linked += len(text.strip()) if in_link else 0

    def close(down_to: int) -> None:
        nonlocal skipping
        while len(stack) > down_to:
            skipping -= stack.pop()[0] in SKIPPED

    at = 0
    while found := _TOKEN.search(page, at):
        add(page[at:found.start()])
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if not found[1] and stack and stack[-1][0] == "head" and tag not in HEAD:
            close(len(stack) - 1)
        if tag in INLINE:
            if tag == "a":
                in_link = not found[1]
            elif tag in ("br", "img"):
                add(" ")
            continue
        flush()
        in_link = False
        if found[1]:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if depth is not None:
                close(depth)
            continue
        if stack and stack[-1][0] == "p":
            close(len(stack) - 1)
        if tag == "body":
            close(next((k for k, (t, _) in enumerate(stack) if t == "head"), len(stack)))
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in CLOSES.get(tag, ()):
                close(k)
                break
            if stack[k][0] in STOPS:
                break
        if tag in VOID or found[3].endswith("/"):
            continue
        names = frozenset(x for m in _NAMES.finditer(found[3]) for x in _LETTERS.findall((m[1] or m[2] or m[3] or "").lower()))
        stack.append((tag, names))
        skipping += tag in SKIPPED
        if tag in RAW_TEXT:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            add(page[at:end.start()] if end else page[at:])
            flush()
            close(len(stack) - 1)
            at = end.end() if end else len(page)
    add(page[at:])
    flush()
    return blocks


def features(blocks: list[Block]) -> list[list[str]]:
    out = []
    for k, b in enumerate(blocks):
        words, tag = b.text.count(" ") + 1, b.tags[-1] if b.tags else "-"
        own = {"bias", f"tag={tag}", f"parent={b.tags[-2] if len(b.tags) > 1 else '-'}", f"words={min(7, words.bit_length())}",
               f"links={int(3 * b.linked / len(b.text) + 0.5)}", f"end={b.text[-1] if b.text[-1] in '.!?:' else 'other'}"}
        own |= {f"in={t}" for t in b.tags} | {f"name={n}" for n in b.names}
        if b.text[0] in "©®™":
            own.add("mark")
        if k == 0:
            own.add("first")
        if k == len(blocks) - 1:
            own.add("last")
        out.append(sorted(own))
    return out


class ChainField:
    """Conditional random field of two labels; ``weights`` speak for label 1."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.weights, self.pairs = np.zeros(0), np.zeros((2, 2))

    def _rows(self, page: list[list[str]], grow: bool = False) -> list[np.ndarray]:
        if grow:
            for f in {f for block in page for f in block}:
                self.index.setdefault(f, len(self.index))
        return [np.array([self.index[f] for f in block if f in self.index], np.int64) for block in page]

    def _marginals(self, lift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of label 1 of each block, and expected counts of neighbouring labels."""
        n = len(lift)
        own = np.stack([np.zeros(n), lift], 1)
        forward, back = np.empty((n, 2)), np.zeros((n, 2))
        forward[0] = own[0]
        for t in range(1, n):
            forward[t] = own[t] + np.logaddexp(forward[t - 1, 0] + self.pairs[0], forward[t - 1, 1] + self.pairs[1])
        for t in range(n - 2, -1, -1):
            step = own[t + 1] + back[t + 1]
            back[t] = np.logaddexp(self.pairs[:, 0] + step[0], self.pairs[:, 1] + step[1])
        total = np.logaddexp(*forward[-1])
        ones = np.exp(forward[:, 1] + back[:, 1] - total)
        counts = np.zeros((2, 2))
        for a in (0, 1):
            for b in (0, 1):
                counts[a, b] = np.exp(forward[:-1, a] + self.pairs[a, b] + own[1:, b] + back[1:, b] - total).sum()
        return ones, counts

    def fit(self, pages: list[list[list[str]]], labels: list[list[int]], epochs: int = EPOCHS, step: float = STEP, decay: float = DECAY, seed: int = 3):
        rows = [self._rows(p, grow=True) for p in pages]
        self.weights = np.zeros(len(self.index))
        sums, pair_sums, rng = np.full(len(self.weights), 1e-2), np.full((2, 2), 1e-2), np.random.default_rng(seed)
        for _ in range(epochs):
            for k in rng.permutation(len(pages)):
                if not rows[k]:
                    continue
                y = np.array(labels[k])
                ones, counts = self._marginals(np.array([self.weights[r].sum() for r in rows[k]]))
                used, place = np.unique(np.concatenate(rows[k]), return_inverse=True)
                slope = np.bincount(place, np.repeat(ones - y, [len(r) for r in rows[k]]), len(used)) + decay * self.weights[used]
                sums[used] += slope * slope
                self.weights[used] -= step * slope / np.sqrt(sums[used])
                np.add.at(counts, (y[:-1], y[1:]), -1)
                pair_sums += counts * counts
                self.pairs -= step * counts / np.sqrt(pair_sums)
        return self

    def decode(self, page: list[list[str]]) -> list[int]:
        """The likeliest labels of a page's blocks together."""
        score, back = np.zeros(2), []
        for t, row in enumerate(self._rows(page)):
            if t:
                paths = score[:, None] + self.pairs
                back.append(paths.argmax(0))
                score = paths.max(0)
            score = score + np.array([0.0, self.weights[row].sum()])
        if not page:
            return []
        labels = [int(score.argmax())]
        for step in reversed(back):
            labels.append(int(step[labels[-1]]))
        return labels[::-1]


def train(pages: int = PAGES) -> ChainField:
    """Fit on ``pages`` labelled pages of :mod:`html_pages`."""
    inputs, labels = [], []
    for seed in range(pages):
        page, known = labelled_page(seed)
        blocks = leaf_blocks(page)
        if [b.text for b in blocks] == [t for t, _ in known]:
            inputs.append(features(blocks))
            labels.append([y for _, y in known])
    return ChainField().fit(inputs, labels)


def main_text(page: str | None, field: ChainField) -> str:
    blocks = leaf_blocks(page)
    return "\n\n".join(b.text for b, y in zip(blocks, field.decode(features(blocks))) if y)


def extract(pages: DataFrame, field: ChainField | None = None) -> DataFrame:
    """Per page: page_id, url, text (main blocks joined by an empty line; empty if none) and n_chars. NULL html has no text."""
    field = field or train()

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            for at in range(0, len(df), 500):
                some = df.iloc[at:at + 500]
                texts = [main_text(h, field) for h in some["html"]]
                yield pd.DataFrame({"page_id": some["page_id"].astype("Int64"), "url": some["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return pages.select("page_id", "url", "html").mapInPandas(read, "page_id long, url string, text string, n_chars long")

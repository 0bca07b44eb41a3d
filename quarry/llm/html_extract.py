"""HTML extraction: a linear-chain conditional random field over DOM leaf blocks, decoded by Viterbi.

A page is cut into leaf blocks: text between block-level tags, inline tags ignored, character references decoded, white space
runs turned into one space.  Scripts, styles, form controls, drawings, comments and the title go without a trace, also from within a block;
formulas and the fallback text of objects stay.  A block's
features are its ancestors' tags and words of their class, id and role, and its own text (length, links, punctuation, digits).  The
field has two labels, main and other; it is trained here on labelled pages (labelled_pages.py) and its weights
go to the tasks, which score and decode each page.

Null, empty and markup-only pages give an empty text.  Repeated rows are extracted each.  Page length is not limited.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled_pages import labelled_pages
from .shared import table

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>", re.S)
ATTR = re.compile(r"(?:^|\s)(class|id|role|data-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
RAW = {x: re.compile(rf"</{x}\s*>", re.I) for x in ("script", "style", "textarea", "title", "template", "svg", "iframe", "select", "option", "button")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MATH = frozenset("math mrow mi mo mn ms mtext mspace msup msub msubsup mfrac msqrt mroot mover munder munderover mtable mtr mtd mstyle mpadded semantics annotation".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr ruby rb rt rp img br".split()) | MATH | {"object"}
WORD = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")


class Block:
    __slots__ = ("label", "links", "path", "text")

    def __init__(self, text: str, path: tuple, links: int, label: str | None):
        self.text, self.path, self.links, self.label = text, path, links, label


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks in page order; path holds (tag, words of class, id and role) of the ancestors."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, frozenset, str | None]] = []
    text: list[str] = []
    linked = in_link = at = 0

    def close() -> None:
        nonlocal text, linked
        if text:
            own = SPACE.sub(" ", "".join(text)).strip()
            if own:
                out.append(Block(own, tuple(x[:2] for x in stack if x[0] not in INLINE), linked, next((x[2] for x in reversed(stack) if x[2]), None)))
        text, linked = [], 0

    def say(part: str) -> None:
        nonlocal linked
        if part:
            part = entities.unescape(part) if "&" in part else part
            text.append(part)
            if in_link:
                linked += len(part)

    for m in iter(lambda: TAG.search(page, at), None):
        say(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag not in INLINE:
                close()
            if tag == "a":
                in_link = max(0, in_link - 1)
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if tag not in INLINE:
                        del stack[k:]
                    else:
                        del stack[k]
                    break
                if tag in INLINE and stack[k][0] not in INLINE:
                    break
            continue
        if tag in RAW and not m[3].endswith("/"):
            end = RAW[tag].search(page, at)
            at = end.end() if end else len(page)
            if tag == "title":
                close()
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in VOID or m[3].endswith("/"):
            if tag not in INLINE:
                close()
            continue
        if tag not in INLINE:
            close()
            # An open paragraph or item ends where the next block begins, with the inline tags left open in it.
            k = len(stack) - 1
            while k >= 0 and stack[k][0] in INLINE:
                k -= 1
            if k >= 0 and (stack[k][0] == "p" or stack[k][0] == tag and tag in ("li", "dt", "dd", "tr", "td", "th")):
                del stack[k:]
        elif tag == "a":
            in_link += 1
        words, label = set(), None
        if m[3]:
            for name, value in ATTR.findall(m[3]):
                if name.lower() == "data-label":
                    label = value.strip("\"'")
                else:
                    words.update(WORD.findall(value.lower()))
        stack.append((tag, frozenset(words), label))
    say(page[at:])
    close()
    return out


def features(own: list[Block]) -> list[list[str]]:
    """Feature names of each block."""
    out = []
    for k, b in enumerate(own):
        tags = [t for t, _ in b.path]
        n = b.text.count(" ") + 1
        f = ["bias", f"own:{tags[-1] if tags else ''}", f"len:{min(6, n.bit_length())}", f"dots:{min(3, sum(map(b.text.count, '.!?')))}"]
        f += [f"under:{t}" for t in set(tags)]
        f += [f"word:{w}" for w in {w for _, words in b.path for w in words}]
        share = b.links / max(1, len(b.text))
        f.append(f"links:{0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.8 else 3}")
        if b.text[-1] in ".!?:;\"”»":
            f.append("ends")
        if b.text[0] in "©|›»•" or "©" in b.text:
            f.append("sign")
        if any(c.isdigit() for c in b.text):
            f.append("digits")
        if k == 0:
            f.append("first")
        if k == len(own) - 1:
            f.append("last")
        if "article" not in tags and "main" not in tags:
            f.append("free")
        out.append(f)
    return out


class Field:
    """Weights: (features, 2) for the labels other = 0 and main = 1, and (2, 2) for neighbours."""

    def __init__(self, names: dict[str, int], w: np.ndarray, t: np.ndarray):
        self.names, self.w, self.t = names, w, t

    def decode(self, own: list[list[str]]) -> list[int]:
        """The likeliest labels, by Viterbi."""
        if not own:
            return []
        w, names = self.rows, self.names
        (t00, t01), (t10, t11) = self.t.tolist()
        back, a, b = [], 0.0, 0.0
        for k, f in enumerate(own):
            x = y = 0.0
            for name in f:
                if (i := names.get(name)) is not None:
                    x += w[i][0]
                    y += w[i][1]
            if k:
                p, q = a + t00 >= b + t10, a + t01 >= b + t11
                back.append((0 if p else 1, 0 if q else 1))
                a, b = x + (a + t00 if p else b + t10), y + (a + t01 if q else b + t11)
            else:
                a, b = x, y
        label = 0 if a >= b else 1
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]

    @functools.cached_property
    def rows(self) -> list[list[float]]:
        return self.w.tolist()


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(pages: list[str], epochs: int = 12, l2: float = 1e-3, rate: float = 0.3) -> Field:
    """Maximum likelihood by AdaGrad over pages whose elements carry data-label="main" or "other"."""
    cases, names = [], {}
    for page in pages:
        own = blocks(page)
        f = features(own)
        for x in f:
            for name in x:
                names.setdefault(name, len(names))
        cases.append(([np.array([names[n] for n in x]) for x in f], np.array([b.label == "main" for b in own], int)))
    w, t = np.zeros((len(names), 2)), np.zeros((2, 2))
    gw, gt = np.full_like(w, 1e-6), np.full_like(t, 1e-6)
    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(cases)):
            at, y = cases[k]
            n = len(y)
            if not n:
                continue
            e = np.array([w[i].sum(axis=0) for i in at])
            fw, bw = np.zeros((n, 2)), np.zeros((n, 2))
            fw[0] = e[0]
            for i in range(1, n):
                fw[i] = e[i] + _log_sum(fw[i - 1][:, None] + t, 0)
            for i in range(n - 2, -1, -1):
                bw[i] = _log_sum(t + (e[i + 1] + bw[i + 1])[None, :], 1)
            z = _log_sum(fw[-1], 0)
            diff = np.eye(2)[y] - np.exp(fw + bw - z)
            dt = np.zeros((2, 2))
            for i in range(1, n):
                dt -= np.exp(fw[i - 1][:, None] + t + (e[i] + bw[i])[None, :] - z)
                dt[y[i - 1], y[i]] += 1
            flat = np.concatenate(at)
            grad = np.repeat(diff, [len(i) for i in at], axis=0)
            d = np.zeros_like(w)
            np.add.at(d, flat, grad)
            used = np.unique(flat)
            d[used] -= l2 * w[used]
            gw[used] += d[used] ** 2
            w[used] += rate * d[used] / np.sqrt(gw[used])
            gt += dt**2
            t += rate * dt / np.sqrt(gt)
    return Field(names, w, t)


@functools.cache
def trained() -> Field:
    return train(labelled_pages())


def main_text(page: str | None, field: Field) -> str:
    own = blocks(page)
    return "\n".join(b.text for b, y in zip(own, field.decode(features(own)), strict=True) if y)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """Per row of pages (page_id, url, html): page_id, url, text, n_chars."""
    field = field or trained()

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([main_text(p, field) for p in b], dtype=object)

    return pages.select("page_id", "url", F.pandas_udf(run, "string")("html").alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op1_html_extract(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))

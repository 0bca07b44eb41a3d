"""Benchmark decontamination: item-sized windows, SimHash with multi-index Hamming blocks, exact verification.

Words: ASCII punctuation counts as space, A-Z as a-z, split at ASCII white space.  A shingle is `n` words (items and texts of fewer: all
their words) and weighs the bytes of its words.  similarity(window, item) = weight of shared shingles / the larger of both
weights.  A window has as many words as the item (the whole text, if that is shorter).

1. A window at `least` or more shares shingles that weigh `least` of the item.  Texts whose shared shingles weigh less
   in all cannot hold such a window; around the others' shared shingles every start is a window.
2. The 64-bit SimHash of a window's words is looked up in four 16-bit blocks, each with all values within
   radius // 4 bits, which by the pigeonhole principle finds every item fingerprint within `radius` bits.
3. Items found that have the window's size are verified by the exact similarity.

Returns one row per row of docs and item found: doc_id, item_id, similarity (of the best window, the first such), hamming,
start_word, n_windows.  Null and empty texts and items find nothing; repeated rows and items are reported each.  Items are
taken in blocks of at most about `block_items`, so what a task holds does not grow with the benchmark.  No shuffle.
"""

from __future__ import annotations

import math
import string
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WordHashes, ngram_hashes, rows_of_texts, table, word_array

FOLD = bytes.maketrans(string.ascii_uppercase.encode() + string.punctuation.encode(), string.ascii_lowercase.encode() + b" " * len(string.punctuation))
BITS = np.arange(64, dtype=np.uint64)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def shingle_weights(lengths: np.ndarray, n: int) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(lengths)))
    k = min(n, len(lengths))
    return total[k:] - total[:-k] if k else total[:0]


def fingerprints(words: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray:
    """SimHash of every window of so many words."""
    votes = np.where((words[:, None] >> BITS) & np.uint64(1), 1, -1) * lengths[:, None]
    total = np.concatenate((np.zeros((1, 64), np.int64), np.cumsum(votes, axis=0)))
    ones = (total[size:] - total[:-size]) > 0
    return (ones.astype(np.uint64) << BITS).sum(axis=1, dtype=np.uint64)


class HammingIndex:
    """Fingerprints by their four 16-bit blocks."""

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius = prints, radius
        self.masks = np.array([sum(1 << i for i in at) for k in range(radius // 4 + 1) for at in combinations(range(16), k)], np.uint16)
        self.blocks = []
        for b in range(4):
            value = ((prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.uint16)
            by = np.argsort(value, kind="stable")
            self.blocks.append((by, value[by]))

    def near(self, fingerprint: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        """(places, distances) of all fingerprints within the radius."""
        found = []
        for b, (by, values) in enumerate(self.blocks):
            probes = np.uint16((int(fingerprint) >> (16 * b)) & 0xFFFF) ^ self.masks
            lo, hi = np.searchsorted(values, probes, "left"), np.searchsorted(values, probes, "right")
            found += [by[i:j] for i, j in zip(lo[hi > lo], hi[hi > lo], strict=True)]
        at = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        far = np.bitwise_count(self.prints[at] ^ fingerprint).astype(np.int64)
        return at[far <= self.radius], far[far <= self.radius]


class Items:
    """One block of benchmark items."""

    def __init__(self, ids: list[int], texts: list[str], n: int, radius: int):
        cache = WordHashes()
        self.n, self.ids, self.words, self.sets, self.weight = n, [], [], [], []
        prints, where = [], defaultdict(dict)  # shingle -> item -> weight
        self.short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))  # words -> hash -> items
        for i, text in zip(ids, texts, strict=True):
            w = words_of(text)
            if not w:
                continue
            h, lengths = word_array(w, cache), np.fromiter(map(len, w), np.int64, len(w))
            sh, first = np.unique(ngram_hashes(h, n), return_index=True)
            weights = shingle_weights(lengths, n)[first]
            if len(w) < n:
                self.short[len(w)][int(sh[0])].append(len(self.ids))
            for s, g in zip(sh.tolist(), weights.tolist(), strict=True):
                where[s][len(self.ids)] = g
            self.ids.append(i)
            self.words.append(len(w))
            self.sets.append(sh)
            self.weight.append(int(weights.sum()))
            prints.append(fingerprints(h, lengths, len(w))[0])
        self.where = dict(where)
        self.shingles = np.array(sorted(where), np.uint64)
        self.index = HammingIndex(np.array(prints, np.uint64), radius)

    def found(self, text: str | None, least: float, cache: WordHashes) -> Iterator[tuple]:
        """(item place, similarity, hamming, start, windows) of each item that the text holds."""
        w = words_of(text)
        if not w or not len(self.shingles):
            return
        h = word_array(w, cache)
        # An item shorter than a shingle is one shingle of its own length, so its window is equal to it or shares nothing.
        for size, items in self.short.items():
            if len(w) > size:
                own, hits = ngram_hashes(h, size), defaultdict(list)
                keys = np.fromiter(items, np.uint64, len(items))
                for p in np.flatnonzero(np.isin(own, keys)).tolist():
                    hits[int(own[p])].append(p)
                for s, at in hits.items():
                    for item in items[s]:
                        yield item, 1.0, 0, at[0], len(at)
        sh = ngram_hashes(h, self.n)
        at = np.minimum(np.searchsorted(self.shingles, sh), len(self.shingles) - 1)
        places = np.flatnonzero(self.shingles[at] == sh)
        # A text shorter than a shingle is one of its own length, which only items as short share.
        if not len(places):
            return
        weight, spots = defaultdict(int), defaultdict(list)
        for p in places.tolist():
            for item in self.where[int(sh[p])]:
                spots[item].append(p)
        for item, own in spots.items():
            for s in {int(sh[p]) for p in own}:
                weight[item] += self.where[s][item]
        windows: dict[int, set[int]] = defaultdict(set)
        for item, own in spots.items():
            if weight[item] >= least * self.weight[item]:
                size = min(self.words[item], len(w))
                for p in own:
                    windows[self.words[item]].update(range(max(0, p - size + 1), min(p, len(w) - size) + 1))
        best: dict[int, list] = {}
        lengths = np.fromiter(map(len, w), np.int64, len(w)) if windows else None
        weights = shingle_weights(lengths, self.n) if windows else None
        for size, starts in windows.items():
            own = min(size, len(w))
            order = np.array(sorted(starts))
            for run in np.split(order, np.flatnonzero(np.diff(order) > 1) + 1):
                prints = fingerprints(h[run[0] : run[-1] + own], lengths[run[0] : run[-1] + own], own)
                for start, fingerprint in zip(run.tolist(), prints, strict=True):
                    for item, far in zip(*(x.tolist() for x in self.index.near(fingerprint)), strict=True):
                        if self.words[item] != size:
                            continue
                        end = max(start + 1, start + own - self.n + 1)
                        part, first = np.unique(sh[start:end], return_index=True)
                        g = weights[start:end][first]
                        shared = int(g[np.isin(part, self.sets[item])].sum())
                        like = shared / max(int(g.sum()), self.weight[item])
                        if like >= least:
                            b = best.setdefault(item, [0.0, 0, 0, 0])
                            b[3] += 1
                            if like > b[0]:
                                b[:3] = like, far, start
        for item, b in sorted(best.items()):
            yield item, *b


def leaks(docs: DataFrame, benchmark: DataFrame, n: int = 5, least: float = 0.8, radius: int = 15, block_items: int = 4096) -> DataFrame:
    """The items (item_id, text) that rows of docs (doc_id, text) hold."""
    blocks = max(1, math.ceil(benchmark.count() / block_items))
    out = None
    columns = "item_id long, similarity double, hamming int, start_word long, n_windows long"
    for k in range(blocks):
        own = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).select("item_id", "text").orderBy("item_id", "text").collect()
        ids, texts = [x["item_id"] for x in own], [x["text"] for x in own]

        def start(ids=ids, texts=texts):
            items, cache = Items(ids, texts, n, radius), WordHashes()
            return lambda batch: ((k, items.ids[i], *x) for k, t in enumerate(batch) for i, *x in items.found(t, least, cache))

        part = rows_of_texts(docs, "doc_id", "text", columns, start)
        out = part if out is None else out.unionByName(part)
    return out


def _clean(ids: list[int], texts: list[str], n: int, least: float, radius: int):
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        items, cache = Items(ids, texts, n, radius), WordHashes()
        for b in batches:
            yield pd.Series([next(items.found(t, least, cache), None) is None for t in b], dtype=bool)

    return clean


def without_leaks(docs: DataFrame, benchmark: DataFrame, n: int = 5, least: float = 0.8, radius: int = 15, block_items: int = 4096) -> DataFrame:
    """The rows of docs that hold no item; columns stay."""
    blocks = max(1, math.ceil(benchmark.count() / block_items))
    for k in range(blocks):
        own = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).select("item_id", "text").orderBy("item_id", "text").collect()
        ids, texts = [x["item_id"] for x in own], [x["text"] for x in own]
        docs = docs.where(F.pandas_udf(_clean(ids, texts, n, least, radius), "boolean")("text"))
    return docs


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

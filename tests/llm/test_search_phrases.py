"""Ranked search, toxic passages and collocations against brute force, and their edge cases."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quarry.llm import collocations, ranked_search, toxic_passages

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_ranks(docs, items, k=10):
    terms = [TERM.findall((t or "").translate(LOW)) for _, t in docs]
    held = [x for x in terms if x]
    n, total, df = len(held), sum(map(len, held)), Counter(t for x in held for t in set(x))
    out = []
    for item, text in items:
        rows = []
        for (doc, _), own in zip(docs, terms, strict=True):
            tf, m = Counter(own), 10 + (90 * len(own) * n) // max(1, total)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * tf[t] // (1000 * tf[t] + 8 * m)) for t in set(TERM.findall((text or "").translate(LOW))) if tf[t])
            if score > 0:
                rows.append((-score, doc is None, doc or 0, doc))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(rows)[:k])]
    return out


def some_docs(rnd, n, words=80):
    vocabulary = [f"w{int(rnd.paretovariate(0.7)) % 4000}" for _ in range(600)] + ["Über", "ñ", "x2"]
    docs = [(i, ". ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(words)))) for i in range(n)]
    docs += [(n + i, docs[3][1]) for i in range(40)] + [(None, docs[3][1]), (None, None), (5, docs[5][1]), (7_000_000_000, ""), (-4, "...;"), (n + 99, "w1 " * 3000)]
    rnd.shuffle(docs)
    return docs


def found_ranks(spark, docs, items, **how):
    d = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], "doc_id long, text string, terms string, score int").repartition(3)
    b = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, rank int")
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in ranked_search.ranked(d, b, **how).collect()), key=str)


@pytest.mark.parametrize("how", [{}, {"block_docs": 1}, {"block_docs": 2, "k": 3}, {"block_docs": 50, "chunk_items": 3}])
def test_ranks_are_those_of_brute_force(spark, how):
    rnd = random.Random(str(how))
    docs = some_docs(rnd, 120)
    items = [(i, docs[rnd.randrange(len(docs))][1]) for i in range(12)] + [(20, "über Ñ never"), (21, ""), (22, None), (23, "w1"), (None, "w2 W3"), (23, "W1 w1")]
    assert found_ranks(spark, docs, items, **how) == sorted(brute_ranks(docs, items, how.get("k", 10)), key=str)


def test_ranks_of_empty_tables(spark):
    assert found_ranks(spark, [], [(1, "a b")]) == []
    assert found_ranks(spark, [(1, "a b")], []) == []
    assert found_ranks(spark, [(1, None)], [(1, "a b")]) == []


def test_quadtrees_hold_every_point():
    rnd = np.random.default_rng(1)
    for n_docs in (1, 2, 7, 64):
        h = ranked_search.height(n_docs)
        grid = rnd.integers(0, 50, (37, n_docs)) * (rnd.random((37, n_docs)) < 0.3)
        row, col = np.nonzero(grid + np.eye(37, n_docs, dtype=int) * 0)
        rows = np.unique(row)
        row = np.searchsorted(rows, row)
        value = grid[np.nonzero(grid)]
        tops, masks, less = ranked_search.quadtrees(row, col, value, h)
        block = ranked_search.Block(h, ranked_search._packed(tops), ranked_search.zstandard.ZstdCompressor().compress(masks.tobytes()), ranked_search._packed(less))
        assert sorted(block.value[-len(value) :].tolist()) == sorted(value.tolist())
        best = [ranked_search.Best(10**6)]
        ranked_search.search(block, list(range(n_docs)), [[(r, 1) for r in range(len(rows))]], best)
        assert {d: -s for s, _, d in best[0].rows} == {c: int(s) for c, s in enumerate(grid.sum(axis=0)) if s}


def brute_segments(scores):
    """By the definition: again and again the best segment, then what is left and right of it."""
    best = None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            key = (sum(scores[i:j]), -(j - i), -i)
            if scores[i] > 0 and (best is None or key > best[0]):
                best = (key, i, j)
    if best is None or best[0][0] <= 0:
        return []
    _, i, j = best
    return brute_segments(scores[:i]) + [(i, j)] + [(a + j, b + j) for a, b in brute_segments(scores[j:])]


def test_segments_are_those_of_the_definition():
    rnd = random.Random(2)
    for _ in range(300):
        scores = [rnd.choice([-toxic_passages.DRIFT] * 3 + [0.25, 1.0, 1.75, 4.0]) for _ in range(rnd.randrange(1, 22))]
        found = toxic_passages.segments(np.array(scores))
        assert [(i, j) for i, j, _ in found] == brute_segments(scores)
        assert all(abs(sum(scores[i:j]) - s) < 1e-9 for i, j, s in found)


def toxic_table(spark, n=600):
    rnd = random.Random(6)
    vocabulary = ["".join(rnd.choice("abcdefghijkl") for _ in range(rnd.randrange(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        words, bad = [rnd.choice(vocabulary) for _ in range(rnd.randrange(20, 200))], i % 6 == 0
        for _ in range(3 if bad else 0):
            words.insert(rnd.randrange(len(words)), rnd.choice(["vile", "zorx" + rnd.choice(vocabulary)]))
        rows.append((i, " ".join(words), "en", 0.5))
        labels.append((i, int(bad), None))
    rows += [(n, None, "en", 0.5), (n + 1, "", None, 0.5), (None, "vile zorxab", "en", 0.5), (0, rows[0][1], "en", 0.5)]
    labels += [(n, 0, None), (3, None, None), (None, 1, None), (0, 0, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double"), spark.createDataFrame(labels, "doc_id long, toxic int, text string")


def test_toxic_documents_are_found_with_their_passages(spark):
    docs, labels = toxic_table(spark)
    model = toxic_passages.train(docs, labels)
    found = toxic_passages.scored(docs, model).collect()
    assert len(found) == docs.count() and all(0 <= r.score <= 1 for r in found)
    out = [(r.doc_id % 6 == 0, r.predicted) for r in found if r.held_out and r.doc_id < 600]
    assert len(out) > 80 and sum(a == b for a, b in out) >= 0.97 * len(out)
    low = {r.score for r in found if r.doc_id in (600, 601)}
    assert len(low) == 1 and low == {min(r.score for r in found)}
    assert not [r for r in found if r.doc_id is None and r.held_out]
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in toxic_passages.passages(docs, model).collect():
        if r.surprise > 8:
            assert "vile" in text[r.doc_id][r.start : r.end] or "zorx" in text[r.doc_id][r.start : r.end]


def test_no_labels_no_finds(spark):
    docs, labels = toxic_table(spark, 12)
    for none in (labels.limit(0), labels.where("toxic = 0"), labels.where("toxic is null")):
        assert {(r.score, r.predicted) for r in toxic_passages.scored(docs, toxic_passages.train(docs, none)).collect()} == {(0.0, 0)}
    assert toxic_passages.scored(docs.limit(0), toxic_passages.train(docs.limit(0), labels)).collect() == []


def brute_phrases(docs, least, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        candidates, rows = {p: a for p, a in own.items() if len(p) > 1 and a >= least}, []
        for p, a in candidates.items():
            if any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= 50 * a for q, b in candidates.items()):
                continue
            score, k = min((1000000 * a * a // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, r + 1, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for r, x in enumerate(sorted(rows)[:top])]
    return sorted(out)


@pytest.mark.parametrize(("least", "top", "period"), [(10, 2000, 16), (3, 2000, 2), (2, 5, 1), (300, 9, 3)])
def test_phrases_are_those_of_brute_force(spark, monkeypatch, least, top, period):
    rnd = random.Random(least)
    words = ["a", "A", "b", "new", "york", "city", "é", "\x1f", "x-y", "é日本"]
    docs = [(rnd.choice(["en", "de", None, "und", ""]), "".join(rnd.choice(words) + rnd.choice([" ", "  ", "\t", " ", ". ", "\n", ", "]) for _ in range(rnd.randrange(60)))) for _ in range(150)]
    docs += [("en", "new york city is new york city; New York.")] * 40 + [("de", None), (None, ""), ("xx", ",,"), ("one", "word"), ("long", "same " * 5000), ("long", "p q r " * 3000)]
    monkeypatch.setattr(collocations, "PERIOD", period)
    d = spark.createDataFrame([(lang, t, 1, "x") for lang, t in docs], "lang string, text string, n int, phrase string").repartition(3)
    found = collocations.collocations(d, least=least, top=top)
    assert sorted(map(tuple, found.collect())) == brute_phrases(docs, least, top)


def test_small_parts_and_ranges_count_alike(spark, monkeypatch):
    rnd = random.Random(9)
    docs = [(rnd.choice(["en", "de"]), " ".join(rnd.choice("abcdefgh") for _ in range(100))) for _ in range(60)]
    parsed = collocations.parsed(spark.createDataFrame(docs, "lang string, text string"))
    want = sorted(map(tuple, collocations.frequent(collocations.in_parts(parsed), 4).collect()))
    monkeypatch.setattr(collocations, "RANGE_ENTRIES", 50)
    small = spark.createDataFrame(parsed.collect(), parsed.schema).repartition(9)
    assert sorted(map(tuple, collocations.frequent(collocations.in_parts(small), 4).collect())) == want and len(want) > 100


def test_no_documents_no_phrases(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []

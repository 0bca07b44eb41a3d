"""Sets of shingles of many texts at once against the sets made word by word."""

import random
import time

import numpy as np
import pyarrow as pa
import xxhash

from quarry.llm import jaccard_join as j
from quarry.llm.shared import WordHashes, ngram_hashes, word_array


def one_by_one(texts, n):
    cache = WordHashes()
    return [np.unique(ngram_hashes(word_array(j.words_of(x), cache), n)) for x in texts]


def test_sets_of_many_texts_equal_those_of_single_ones(monkeypatch):
    rnd = random.Random(3)
    texts = [None, "", " ", "a", "a b\n", "\t A  b\x0bC d ", "a b c\x1cd e\x85f g\xa0h", "É é É é É", "y" * 70_000, "\x00 \x00a"]
    texts += [" ".join("x" * m + "é" * (m % 3) + " " * (m % 4) for m in range(k)) for k in range(45)]
    texts += [" ".join(rnd.choice(["ab", "Ab", "c", "日本"]) for _ in range(rnd.randrange(40))) for _ in range(200)]
    for size in (40, 3_000, 8 << 20):
        monkeypatch.setattr(j, "TEXT_BYTES", size)
        for n in (1, 4, 5):
            for a, b in ((0, len(texts)), (3, 60), (2, 3)):
                got = list(j.shingle_sets(pa.array(texts, pa.string()).slice(a, b - a), n))
                assert len(got) == b - a and all(np.array_equal(x, y) for x, y in zip(got, one_by_one(texts[a:b], n), strict=True))
    assert list(j.shingle_sets(pa.array([], pa.string()), 4)) == []


def test_words_have_their_xxh64():
    rnd = random.Random(4)
    words = [rnd.randbytes(k % 50 + 1) for k in range(500)]
    sizes = np.array([len(x) for x in words])
    got = j.xxh64_of(np.frombuffer(b"".join(words) + bytes(8), np.uint8), np.cumsum(sizes) - sizes, sizes)
    assert got.tolist() == [xxhash.xxh64_intdigest(x) for x in words]


def test_different_words_do_not_go_through_python_one_by_one():
    texts = [" ".join(f"w{k * 1000 + m}" for m in range(1000)) for k in range(300)]
    own = pa.array(texts)
    took = []
    for run in (lambda: one_by_one(texts, 4), lambda: list(j.shingle_sets(own, 4))):
        best = []
        for _ in range(3):
            began = time.perf_counter()
            run()
            best.append(time.perf_counter() - began)
        took.append(min(best))
    assert took[1] < took[0] / 2

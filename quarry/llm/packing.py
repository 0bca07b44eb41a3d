"""Packing: shortest-pack-first over the length histogram.

Documents are tokenised, `end_id` is added, and cut into pieces of `capacity` and a rest.  The histogram of piece
lengths (at most `capacity` numbers) is packed on the driver, longest first, each into the shortest open pack it fits; packs of
equal contents are one pattern with a count, so the work follows the number of lengths and not of documents.  Pieces get a
rank within their length from counts per (length, bucket), and the rank leads to pattern, sequence and offset.

Null text: an empty document of the one id `end_id`.  Repeated rows and null doc_ids are packed row by row.  Sequences are padded to
`capacity` unless their length is a power of two.
"""

from __future__ import annotations

import functools
import math
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import rows_of_texts, stored, table

#: Words whose ids a worker keeps; beyond that it starts anew.
CACHE_WORDS = 600_000
#: Words that the tokenizer gets in one string.
AT_ONCE = 500
#: Pieces of one (length, bucket) group, about.
BUCKET = 20_000
WORD_BPE = "word_bpe_49k.json"


def tokenizer_path(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: The tokenizer's words in lower-case Latin-1 (letters, single digits and number signs, runs of anything else).
LETTERS = rb"a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
NUMBERS = rb"0-9\xb2\xb3\xb9\xbc-\xbe"
WORD = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[%s]+|[%s]|[^\t-\r \x85\xa0%s%s]+" % (LETTERS, NUMBERS, LETTERS, NUMBERS))
LOWER = bytes(range(256)).decode("latin-1").lower().encode("latin-1")


class Encoder:
    """Ids as bytes.  Words never span white space, so each is encoded once and kept.

    In Latin-1, composition changes nothing and words are found by WORD.  Chunks with other letters or with the marks of a
    special token go to the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.words = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.words.normalizer = normalizers.Sequence([])
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        ends = [k for t, k in self.words.get_vocab(False).items() if t.endswith("</w>")]
        self.ends = np.zeros(self.words.get_vocab_size(), bool)
        self.ends[ends] = True
        self.kept: dict[bytes | str, bytes] = {}

    def split(self, text: str) -> list[bytes | str]:
        """Words in lower-case Latin-1, and other chunks as they are."""
        if "<|" not in text:
            try:
                return WORD.findall(text.encode("latin-1").translate(LOWER))
            except UnicodeEncodeError:
                pass
        out: list[bytes | str] = []
        for c in text.encode("utf-8", "replace").split():
            c = c.decode()
            if c.isascii() and "<|" not in c:
                out += WORD.findall(c.encode().lower())
            else:
                out.append(c)
        return out

    def learn(self, new: list[bytes | str]) -> None:
        words, chunks = [w for w in new if isinstance(w, bytes)], [c for c in new if isinstance(c, str)]
        groups = [words[k : k + AT_ONCE] for k in range(0, len(words), AT_ONCE)]
        for own, e in zip(groups, self.words.encode_batch_fast([b" ".join(g).decode("latin-1") for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            stops = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            ids = ids.tobytes()
            self.kept.update(zip(own, map(ids.__getitem__, map(slice, [0, *stops[:-1]], stops)), strict=True))
        for c, e in zip(chunks, self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False), strict=True):
            self.kept[c] = np.array(e.ids, "<u4").tobytes()

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        for k in range(0, len(texts), 64):
            split = [self.split(t or "") for t in texts[k : k + 64]]
            words = set().union(*split)
            if len(self.kept) > CACHE_WORDS:
                self.kept.clear()
            self.learn(list(words.difference(self.kept)))
            for own in split:
                yield b"".join(map(self.kept.__getitem__, own))


@functools.cache
def encoder_of(path: str) -> Encoder:
    """One for each worker, kept from task to task."""
    return Encoder(path)


def pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece."""

    def start():
        encoder, end = encoder_of(path), np.array([end_id], "<u4").tobytes()

        def run(texts: list[str | None]) -> Iterator[tuple]:
            for k, ids in enumerate(encoder.encode(texts)):
                ids += end
                n = len(ids) // 4
                for s in range(0, n, capacity):
                    yield k, s, min(capacity, n - s), zlib.crc32(ids[4 * s : 4 * (s + capacity)]), n

        return run

    return rows_of_texts(docs, "doc_id", "text", "start long, length long, ids_crc32 long, doc_tokens long", start)


def pack_histogram(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Patterns (count, {length: how often}) that hold all lengths; longest lengths first, each into the shortest pack."""
    open_: dict[int, list[tuple]] = defaultdict(list)  # space left -> [count, pattern]
    closed = []
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            space = max((s for s in open_ if s >= length), default=None)
            if space is None:
                count, pattern, space = n, {}, capacity
            else:
                count, pattern = open_[space].pop()
            used = min(count, n)
            if used < count:
                open_[space].append((count - used, pattern))
            elif not open_.get(space):
                open_.pop(space, None)
            new = pattern | {length: pattern.get(length, 0) + 1}
            n -= used
            if space == length:
                closed.append((used, new))
            else:
                open_[space - length].append((used, new))
    return closed + [(c, p) for s in sorted(open_) for c, p in open_[s]]


def placed(parts: DataFrame, capacity: int = 2048) -> DataFrame:
    """parts (doc_id, start, length, ...; a stored table) with sequence_id and offset."""
    counts = {r["length"]: r["c"] for r in parts.groupBy("length").agg(F.count("*").alias("c")).collect()}
    buckets = max(64, math.ceil(sum(counts.values()) / BUCKET))
    firsts: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for count, pattern in pack_histogram(counts, capacity):
        offset = 0
        for length in sorted(pattern, reverse=True):
            k = pattern[length]
            rows.append((length, firsts[length], sequence, k, offset))
            firsts[length] += count * k
            offset += k * length
        sequence += count
    rows.sort()
    length, first, base, each, offset = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(1, np.int64),) * 5
    begin = np.searchsorted(length, np.arange(capacity + 2))

    @F.pandas_udf("struct<sequence_id long, offset long>")
    def place(n: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, rank = n.to_numpy(), rank.to_numpy()
        at = np.empty(len(n), np.int64)
        for x in np.unique(n):  # at most `capacity` lengths
            own = n == x
            lo, hi = begin[x], begin[x + 1]
            at[own] = lo + np.searchsorted(first[lo:hi], rank[own], "right") - 1
        k = rank - first[at]
        return pd.DataFrame({"sequence_id": base[at] + k // each[at], "offset": offset[at] + k % each[at] * n})

    dealt = parts.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("length", "bucket").agg(F.count("*").alias("c")).select("length", "bucket", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = dealt.withColumn("own", F.row_number().over(own)).join(offsets, ["length", "bucket"])
    out = ranked.withColumn("p", place("length", F.col("before") + F.col("own") - 1))
    return out.select(*parts.columns, "p.sequence_id", "p.offset")


def packed(docs: DataFrame, path: str | None = None, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    return placed(stored(pieces(docs, path or tokenizer_path(), capacity, end_id), "pieces"), capacity)


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))

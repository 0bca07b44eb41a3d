"""Phrase collocations by prefix-free parsing: chunks cut by content, their dictionary, and n-grams counted in distinct chunks.

1. Parsing.  Text is lower-cased (A-Z), cut into pieces at `[.,;:!?]` and line ends, pieces into words.  A pair of neighbouring
   words whose hash is divisible by `PERIOD` is a trigger: it ends a chunk and begins the next, so chunks overlap by two
   words, and equal passages are cut alike wherever they stand.  The dictionary holds each different chunk of a language with its number of
   occurrences; copies and repeated passages, however many, are one entry.
2. Counting.  A phrase of up to three words lies whole in the chunk in which it begins; what begins in the two words that a chunk shares
   with the next belongs to the next.  So a phrase's count is the sum of its chunks' occurrences, with overlaps assigned once.
   The dictionary is kept in parts of about `PART_BYTES`.  Each part sends hashes of its phrases with counts of at most
   `least`, packed by hash range; a range tells each part which of its hashes reach `least` in all (a hash that two phrases share
   only lets more through), and the part then sends the words and exact counts of those alone.  Rare phrases, most of all, never become rows.
3. Scoring.  a * a / (l * r) in decimals of 38 digits, which hold 1000000 * a * a for a below 10 ** 15.

Null and empty texts have no words; a null lang is `und`.  Repeated rows count each.  Very long texts are cut like others.  Other columns are not read.
An empty table gives an empty one.
"""

from __future__ import annotations

import string
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ODD, WordHashes, discard, mixed, stored, table

BREAK = b"\xff"  # in no UTF-8 text
FOLD = bytes.maketrans(string.ascii_uppercase.encode() + b".,;:!?\n\x0b\x0c\r", string.ascii_lowercase.encode() + BREAK * 10)
#: A chunk has about so many words, and the two that it shares with the next.
PERIOD = 16
SHARED = 2
LONGEST = 3
PART_BYTES = 4 << 20
#: Phrases of a hash range, about; and the bits of a hash within its range.
RANGE_ENTRIES, RANGE_BITS = 500_000, 40


def words_of(text: bytes) -> list[bytes]:
    """Words, with BREAK between pieces."""
    return text.translate(FOLD).replace(BREAK, b" \xff ").split()


def cuts(words: list[bytes], cache: WordHashes) -> tuple[list[int], list[int], list[bool]]:
    """(first, end, last of its piece) of each chunk."""
    if not words:
        return [], [], []
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    wall = np.flatnonzero(h == cache[BREAK])
    first, end = np.concatenate(([0], wall + 1)), np.concatenate((wall, [len(words)]))
    first, end = first[end > first], end[end > first]
    inside = np.zeros(len(words), bool)  # a word that has a word of its piece before and one after it
    inside[1:-1] = True
    for x in (wall, first, end - 1):
        inside[x] = False
    pair = mixed(h[:-1] * ODD[0] + h[1:] * ODD[1]) % np.uint64(PERIOD) == 0
    cut = np.flatnonzero(inside[1:] & pair) + 1
    firsts, ends = np.concatenate((first, cut - 1)), np.concatenate((cut + 1, end))
    last = np.concatenate((np.zeros(len(cut), bool), np.ones(len(end), bool)))
    by = np.argsort(ends, kind="stable")
    return np.sort(firsts).tolist(), ends[by].tolist(), last[by].tolist()


def parsed(docs: DataFrame) -> DataFrame:
    """The dictionary: lang, last, chunk and n."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for b in batches:
            texts, found = defaultdict(list), Counter()
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if text:
                    texts[lang].append(text)
            for lang, own in texts.items():
                words = words_of(BREAK.join(own))
                found.update((lang, last, b" ".join(words[s:e])) for s, e, last in zip(*cuts(words, cache), strict=True))
            names = list(found)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in names], t) for k, t in enumerate((pa.string(), pa.bool_(), pa.binary()))] + [pa.array(found.values(), pa.int64())], names=["lang", "last", "chunk", "n"])

    chunks = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(each, "lang string, last boolean, chunk binary, n long")
    return chunks.groupBy("lang", "last", "chunk").agg(F.sum("n").alias("n"))


def in_parts(dictionary: DataFrame) -> DataFrame:
    """The dictionary in rows of about PART_BYTES: part, lang, chunks (joined by line ends), last, n, words (occurrences), size (words to count)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, serial = defaultdict(list), Counter(), TaskContext.get().partitionId() << 32

        def row(lang: str) -> pa.RecordBatch:
            nonlocal serial
            own = held.pop(lang)
            del size[lang]
            last, n = np.array([x[1] for x in own], np.uint8), np.array([x[2] for x in own], np.int64)
            k = np.array([x[0].count(b" ") + 1 for x in own]) - SHARED * (last == 0)
            serial += 1
            values = (serial, lang, b"\n".join(x[0] for x in own), last.tobytes(), n.tobytes(), int((k * n).sum()), int(k.sum()))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=names)

        for b in batches:
            for lang, *x in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                held[lang].append((x[1], x[0], x[2]))
                size[lang] += len(x[1])
                if size[lang] >= PART_BYTES:
                    yield row(lang)
        for lang in list(held):
            yield row(lang)

    types = pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()
    names = ["part", "lang", "chunks", "last", "n", "words", "size"]
    return dictionary.select("lang", "last", "chunk", "n").mapInArrow(each, "part long, lang string, chunks binary, last binary, n binary, words long, size long")


class Part:
    """The phrases of a part: local word numbers, and each phrase's place, length, hash and occurrences."""

    def __init__(self, lang: str, chunks: bytes, last: bytes, n: bytes):
        words = chunks.replace(b"\n", b" ").split(b" ")
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        self.ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        self.names = list(number)
        h = np.fromiter(map(xxhash.xxh64_intdigest, self.names), np.uint64, len(self.names))[self.ids]
        size = np.array([x.count(b" ") + 1 for x in chunks.split(b"\n")])
        left = np.repeat(np.cumsum(size), size) - np.arange(len(words))  # words of the chunk from this one on
        begins = (left > SHARED) | np.repeat(np.frombuffer(last, np.uint8), size).astype(bool)
        weight = np.repeat(np.frombuffer(n, np.int64), size)
        key = np.zeros(len(words), np.uint64)
        at, hashes = [], []
        for k in range(LONGEST):
            key = key[: len(words) - k] + h[k:] * ODD[k]
            own = np.flatnonzero((begins & (left > k))[: len(key)])
            at.append(own)
            hashes.append(mixed(key[own] ^ np.uint64(xxhash.xxh64_intdigest(lang, k))))
        self.at, self.hash = np.concatenate(at), np.concatenate(hashes)
        self.length = np.repeat(np.arange(1, LONGEST + 1), [len(x) for x in at])
        self.weight = weight[self.at]

    def counted(self, of: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(phrases, their lengths, their occurrences) of the different phrases at these places, told apart by their words."""
        at, length = self.at[of], self.length[of]
        key = np.zeros(len(at), np.int64)  # 21 bits a word, of which a part has far fewer
        for k in range(LONGEST):
            word = self.ids[np.minimum(at + k, len(self.ids) - 1)] + 1
            key = (key << 21) | np.where(length > k, word, 0)
        by, start, _, total = _sums(key, self.weight[of])
        at, length = at[by[start]], length[by[start]]
        return [b" ".join([self.names[i] for i in self.ids[s : s + n].tolist()]).decode() for s, n in zip(at.tolist(), length.tolist(), strict=True)], length, total


def _sums(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, starts of equal keys in it, the keys, their sums)."""
    by = np.argsort(key, kind="stable")
    key = key[by]
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return by, start, key[start], np.add.reduceat(value[by], start) if len(key) else value[:0]


def _five(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _from_five(x: bytes) -> np.ndarray:
    out = np.zeros((len(x) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(x, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def frequent(parts: DataFrame, least: int) -> DataFrame:
    """lang, phrase, words (its length) and f of the phrases of one to three words with f >= least."""
    total = parts.agg(F.sum("size")).first()[0] or 0
    bits = max(1, (LONGEST * total // RANGE_ENTRIES).bit_length())
    shift, low = np.uint64(64 - bits - RANGE_BITS), np.uint64((1 << RANGE_BITS) - 1)
    cap = min(least, 255)

    def short(part: Part) -> np.ndarray:
        return part.hash >> shift

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, *x in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                part = Part(*x)
                _, _, key, count = _sums(short(part), part.weight)
                span = (key >> np.uint64(RANGE_BITS)).astype(np.int64)
                edge = np.append(np.flatnonzero(np.concatenate(([True], span[1:] != span[:-1]))), len(span))
                count = np.minimum(count, cap).astype(np.uint8)
                pieces = list(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True))
                yield pa.RecordBatch.from_arrays([
                    pa.array(span[edge[:-1]]), pa.array([number] * len(pieces), pa.int64()),
                    pa.array([_five(key[s:e] & low) for s, e in pieces], pa.binary()), pa.array([count[s:e].tobytes() for s, e in pieces], pa.binary()),
                ], names=["span", "part", "keys", "counts"])

    def kept(rows: pa.Table) -> pa.Table:
        number, keys = rows.column("part").to_pylist(), [_from_five(x) for x in rows.column("keys").to_pylist()]
        key, edge = np.concatenate(keys), np.cumsum([0, *map(len, keys)])
        by, start, _, total = _sums(key, np.frombuffer(b"".join(rows.column("counts").to_pylist()), np.uint8).astype(np.int64))
        ok = np.zeros(len(key), bool)
        ok[by] = np.repeat(total >= cap, np.diff(np.append(start, len(key))))
        chosen = [(number[k], _five(x)) for k, own in enumerate(keys) if len(x := own[ok[edge[k] : edge[k + 1]]])]
        span = rows.column("span")[0].as_py()
        return pa.table({"part": pa.array([x[0] for x in chosen], pa.int64()), "span": pa.array([span] * len(chosen), pa.int64()), "keys": pa.array([x[1] for x in chosen], pa.binary())})

    def exact(left: pa.Table, right: pa.Table) -> pa.Table:
        found = ([], [], [], [])
        if left.num_rows and right.num_rows:
            spans = right.column("span").to_pylist()
            wanted = np.sort(np.concatenate([_from_five(x) | np.uint64(s << RANGE_BITS) for s, x in zip(spans, right.column("keys").to_pylist(), strict=True)]))
            lang, *x = (left.column(k)[0].as_py() for k in ("lang", "chunks", "last", "n"))
            part = Part(lang, *x)
            own = short(part)
            at = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)] == own)
            phrases, length, total = part.counted(at)
            found = [lang] * len(phrases), phrases, length, total
        return pa.table({"lang": pa.array(found[0], pa.string()), "phrase": pa.array(found[1], pa.string()), "words": pa.array(found[2], pa.int32()), "f": pa.array(found[3], pa.int64())})

    spans = parts.select("part", "lang", "chunks", "last", "n").mapInArrow(sent, "span long, part long, keys binary, counts binary")
    chosen = spans.groupBy("span").applyInArrow(kept, "part long, span long, keys binary")
    rows = parts.select("part", "lang", "chunks", "last", "n").groupBy("part").cogroup(chosen.groupBy("part")).applyInArrow(exact, "lang string, phrase string, words int, f long")
    return rows.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def collocations(docs: DataFrame, least: int = 10, top: int = 2000, inside: int = 50) -> DataFrame:
    """The first `top` phrases of two and three words of each lang: lang, rank, phrase, a, l, r, n, score.

    A phrase is left out when a longer candidate that holds it has at least `inside` per cent of its occurrences.
    """
    dictionary = stored(in_parts(parsed(docs)), "phrase-dictionary")
    held = stored(frequent(dictionary, least), "phrases")
    n = stored(dictionary.groupBy("lang").agg(F.sum("words").alias("n")), "phrase-words")
    discard(dictionary)
    cut = held.where("words > 1").selectExpr("lang", "phrase", "f as a", "posexplode(transform(sequence(1, words - 1), k -> struct(substring_index(phrase, ' ', k) as begin, substring_index(phrase, ' ', k - words) as rest))) as (k, c)")
    f = held.select("lang", "phrase", "f")
    cut = cut.selectExpr("lang", "phrase", "a", "k + 1 as k", "c.begin as begin", "c.rest as rest")
    cut = cut.join(f.selectExpr("lang", "phrase as begin", "f as l"), ["lang", "begin"]).join(f.selectExpr("lang", "phrase as rest", "f as r"), ["lang", "rest"])
    wide = "cast({} as decimal(15, 0))"
    score = f"cast(cast(1000000 as decimal(7, 0)) * ({wide.format('a')} * {wide.format('a')}) div ({wide.format('l')} * {wide.format('r')}) as bigint)"
    cut = cut.selectExpr("lang", "phrase", "a", f"struct({score} as score, k, l, r) as cut", "cast(null as bigint) as longer")
    within = held.where(f"words = {LONGEST}").selectExpr("lang", "explode(array(substring_index(phrase, ' ', 2), substring_index(phrase, ' ', -2))) as phrase", "cast(null as bigint) as a", "cast(null as struct<score: bigint, k: int, l: bigint, r: bigint>) as cut", "f as longer")
    best = cut.unionByName(within).groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min("cut").alias("cut"), F.max("longer").alias("longer"))
    best = best.where(f"cut is not null and (longer is null or 100 * longer < {inside} * a)").selectExpr("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    best = best.selectExpr("*", "cast(row_number() over (partition by lang order by score desc, a desc, phrase) as bigint) as rank").where(F.col("rank") <= top)
    out = stored(best.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    for x in (held, n):
        discard(x)
    return out


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
with p as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') as ws from p),
g as (select lang, 1 as k, unnest(ws) as phrase from w
      union all select lang, 2, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) from w
      union all select lang, 3, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) from w),
f as materialized (select lang, k, phrase, cast(count(*) as bigint) as f from g group by all),
n as (select lang, cast(sum(f) as bigint) as n from f where k = 1 group by lang),
c as (select *, string_split(phrase, ' ') as ws from f where k > 1 and f >= 10),
x as (select lang, phrase, f as a, cut, array_to_string(ws[1:cut], ' ') as head, array_to_string(ws[cut + 1:], ' ') as rest from (select *, unnest(range(1, k)) as cut from c)),
h as materialized (select lang, phrase, f from f where f >= 10),
s as (select x.lang, x.phrase, x.a, cut, l.f as l, r.f as r, cast((1000000::hugeint * x.a * x.a) // (l.f::hugeint * r.f) as bigint) as score
      from x join h l on l.lang = x.lang and l.phrase = x.head join h r on r.lang = x.lang and r.phrase = x.rest),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
i as (select lang, phrase, max(longer) as longer from (select lang, unnest([ws[1] || ' ' || ws[2], ws[2] || ' ' || ws[3]]) as phrase, f as longer from c where k = 3) group by all),
o as (select b.* from b left join i using (lang, phrase) where longer is null or 100 * longer < 50 * a)
select lang, rank, phrase, a, l, r, n, score from (select o.*, n, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from o join n using (lang)) where rank <= 2000
"""

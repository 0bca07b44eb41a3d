"""Ranked lexical search: a K2-treap over the grid of terms and documents, descended jointly and best-first.

Terms are runs of ASCII letters and digits and of all signs beyond ASCII, only A-Z lower-cased.  The score of a document for an item
is the sum of w * impact over the item's different terms (module constants and `impacts` state the formula).

Index.  Documents are dealt, as they are read, into blocks of at most `block_docs` documents (or `block_bytes` of text).  A
block's grid has a row for each term, ordered by document count, and a column for each document, ordered by doc_id.  It is cut into
squares of 2**h rows by 2**h columns; each is a quadtree whose nodes hold a mask of their non-empty quadrants and the largest impact
below them, kept as the difference from the parent's (mostly small numbers, in byte planes, compressed).  Impacts need the
number of documents and terms in all, which one scan counts beforehand.

Search.  A term's row is a path of cells: at level l, cell (row >> l, columns c * 2**l ...).  A range of documents is bounded by the sum of
w * maximum over the cells of the item's terms.  The ranges with the largest bounds are halved first, for all items at a time, until no
bound can enter the item's best ones; single documents' bounds are their scores.  What a task has found so far bounds its later
blocks.  Items are taken in chunks of about `chunk_items` items or `chunk_bytes` of text, which is what the driver and a task hold at
a time; each chunk reads the index, not the documents, twice (document counts of its terms, then the descent).

Null and empty texts hold no term and are not counted.  Items without a term that a document holds have no row.  Repeated documents each
have a place of their own; equal scores go by ascending doc_id, a null doc_id last.  Each row of items is an item of
its own, so repeated rows are answered each.  Very long texts are one column with a long list of terms.  Other columns are not read.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, stored, table

FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Set bits of the masks 0 to 15.
POP = np.array([bin(m).count("1") for m in range(16)], np.int64)
#: Ranges of an item that are halved at a time.
STEP = 8


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What tf occurrences in a document of n terms are worth, before the term's weight."""
    m = 10 + 90 * n * n_docs // max(1, n_terms)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _packed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(x.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpacked(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8).reshape(4, -1).T).view("<i4").ravel().astype(np.int64)


def height(n_docs: int) -> int:
    return max(1, (n_docs - 1).bit_length())


def quadtrees(row: np.ndarray, col: np.ndarray, value: np.ndarray, h: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(maxima of the squares, masks from the top level down, differences of the levels below) of a grid's points."""
    code = (row >> h) << (2 * h)
    for b in range(h):
        code |= (((row >> b) & 1) << (2 * b + 1)) | (((col >> b) & 1) << (2 * b))
    by = np.argsort(code, kind="stable")
    code, value, masks, less = code[by], value[by], [], []
    for _ in range(h):
        above = code >> 2
        start = np.flatnonzero(np.concatenate(([True], above[1:] != above[:-1])))
        top = np.maximum.reduceat(value, start)
        masks.append(np.bitwise_or.reduceat(np.left_shift(1, code & 3), start).astype(np.uint8))
        less.append(np.repeat(top, np.diff(np.append(start, len(code)))) - value)
        code, value = above[start], top
    return value, np.concatenate(masks[::-1]), np.concatenate(less[::-1])


class Block:
    """A block's quadtrees: nodes numbered from the top level down, with their maxima, masks and first children."""

    def __init__(self, h: int, tops: bytes, masks: bytes, less: bytes):
        self.h = h
        level, less = _unpacked(tops), _unpacked(less)
        self.mask = np.frombuffer(zstandard.ZstdDecompressor().decompress(masks), np.uint8).astype(np.int64)
        pop, values, done, at = POP[self.mask], [level], 0, 0
        self.first = len(level) + np.cumsum(pop) - pop
        for _ in range(h):
            own = pop[done : done + len(level)]
            done += len(level)
            level = np.repeat(level, own)
            level = level - less[at : at + len(level)]
            at += len(level)
            values.append(level)
        self.value = np.concatenate(values)


class Best:
    """An item's best documents so far, (-score, doc_id is null, doc_id), in ascending order."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def put(self, rows: list[tuple]) -> None:
        self.rows = sorted(self.rows + rows)[: self.k]

    def least(self, ids: list, known: int) -> tuple[int, int]:
        """(score, column): a document of a block must have a higher score, or that score and a column before this one."""
        if len(self.rows) < self.k:
            return 0, 0
        score, null, i = self.rows[-1]
        return -score, known if null else bisect_left(ids, i, 0, known)


def search(block: Block, ids: list, items: list[list[tuple[int, int]]], best: list[Best]) -> None:
    """Puts the block's documents into best; items: each one's (row, weight) in this block; ids: the columns' doc_ids."""
    known = sum(i is not None for i in ids)
    limits = np.array([b.least(ids, known) for b in best], np.int64).reshape(-1, 2)
    least, before = limits[:, 0], limits[:, 1]
    size = np.array([len(x) for x in items], np.int64)
    flat = np.array([x for own in items for x in own], np.int64).reshape(-1, 2)
    held = len(flat)
    pool = np.concatenate((flat[:, 0] >> block.h, flat[:, 0], flat[:, 1])).reshape(3, held)  # nodes, rows and weights of the ranges' terms
    # A range: item, level, first column, bound, and its terms at start ... start + size of the pool.
    item = np.flatnonzero(size)
    bound = np.bincount(np.repeat(np.arange(len(size)), size), pool[2] * block.value[pool[0]], len(size))[item].astype(np.int64)
    r = np.stack([item, np.full(len(item), block.h), np.zeros(len(item), np.int64), bound, (np.cumsum(size) - size)[item], size[item]])
    while r.shape[1]:
        r = r[:, (r[3] > least[r[0]]) | (r[3] == least[r[0]]) & (r[2] < before[r[0]])]
        if not r.shape[1]:
            return
        by = np.lexsort((r[2], -r[3], r[0]))
        r = r[:, by]
        head = np.flatnonzero(np.concatenate(([True], r[0][1:] != r[0][:-1])))
        nth = np.arange(r.shape[1]) - np.repeat(head, np.diff(np.append(head, r.shape[1])))
        now, r = r[:, nth < STEP], r[:, nth >= STEP]
        of = np.repeat(np.arange(now.shape[1]), now[5])
        at = np.arange(len(of)) - np.repeat(np.cumsum(now[5]) - now[5] - now[4], now[5])
        (node, row, w), level = pool[:, at], now[1][of] - 1
        mask, half, made = block.mask[node], (row >> level) & 1, []
        for c in (0, 1):
            q = 2 * half + c
            has = (mask >> q) & 1 == 1
            child = (block.first[node] + POP[mask & ((1 << q) - 1)])[has]
            own, n = of[has], np.bincount(of[has], minlength=now.shape[1])
            bound = np.bincount(own, w[has] * block.value[child], now.shape[1]).astype(np.int64)
            made.append(np.stack([now[0], now[1] - 1, now[2] + (c << (now[1] - 1)), bound, held + np.cumsum(n) - n, n]))
            if held + len(own) > pool.shape[1]:
                pool = np.concatenate((pool, np.zeros((3, held + len(own)), np.int64)), axis=1)
            pool[:, held : held + len(own)] = child, row[has], w[has]
            held += len(own)
        new = np.concatenate(made, axis=1)
        new = new[:, (new[3] > least[new[0]]) | (new[3] == least[new[0]]) & (new[2] < before[new[0]])]
        done = new[:, new[1] == 0]
        r = np.concatenate((r, new[:, new[1] > 0]), axis=1)
        rows = defaultdict(list)
        for i, c, score in zip(done[0].tolist(), done[2].tolist(), done[3].tolist(), strict=True):
            rows[i].append((-score, ids[c] is None, 0 if ids[c] is None else ids[c]))
        for i, own in rows.items():
            best[i].put(own)
            least[i], before[i] = best[i].least(ids, known)


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """(documents with a term, their terms)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(terms_of(t)) for t in b.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_pydict({"d": pa.array([sum(x > 0 for x in n)], pa.int64()), "t": pa.array([sum(n)], pa.int64())})

    d, t = docs.select("text").mapInArrow(each, "d long, t long").agg(F.sum("d"), F.sum("t")).first()
    return d or 0, t or 0


def index(docs: DataFrame, n_docs: int, n_terms: int, block_docs: int = 1024, block_bytes: int = 16 << 20) -> DataFrame:
    """A row for each block: doc_ids, terms (joined by spaces), df, tops, masks, less (the quadtrees).  No shuffle."""
    of = docs.schema["doc_id"].dataType.simpleString()

    def made(ids: pa.Array, words: list[list[bytes]]) -> pa.RecordBatch:
        by = pc.sort_indices(ids)
        ids, words = ids.take(by), [words[k] for k in by.to_pylist()]
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        n = np.array([len(w) for w in words], np.int64)
        term = np.concatenate([np.fromiter(map(number.__getitem__, w), np.int64, len(w)) for w in words])
        key, tf = np.unique(term * len(words) + np.repeat(np.arange(len(words)), n), return_counts=True)
        term, col = key // len(words), key % len(words)
        df = np.bincount(term)
        order = np.argsort(-df, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        names = list(number)
        tops, masks, less = quadtrees(rank[term], col, impacts(tf, n[col], n_docs, n_terms), height(len(words)))
        return pa.RecordBatch.from_arrays([
            pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([b" ".join(names[k] for k in order.tolist())], pa.binary()), pa.array([_packed(df[order])], pa.binary()),
            pa.array([_packed(tops)], pa.binary()), pa.array([zstandard.ZstdCompressor(level=3).compress(masks.tobytes())], pa.binary()), pa.array([_packed(less)], pa.binary()),
        ], names=["doc_ids", "terms", "df", "tops", "masks", "less"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words, held = [], [], 0
        for b in batches:
            for k, text in enumerate(b.column(1).cast(pa.binary()).to_pylist()):
                if not (w := terms_of(text)):
                    continue
                ids.append(b.column(0).slice(k, 1))
                words.append(w)
                held += len(text)
                if len(ids) >= block_docs or held >= block_bytes:
                    yield made(pa.concat_arrays(ids), words)
                    ids, words, held = [], [], 0
        if ids:
            yield made(pa.concat_arrays(ids), words)

    return docs.select("doc_id", "text").mapInArrow(each, f"doc_ids array<{of}>, terms binary, df binary, tops binary, masks binary, less binary")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, chunk_items: int = 1024, chunk_bytes: int = 4 << 20, block_docs: int = 1024) -> DataFrame:
    """The k best documents (doc_id, text) of each row of items (item_id, text): item_id, rank, doc_id, score and the item's number of known terms."""
    n_docs, n_terms = corpus_size(docs)
    blocks = stored(index(docs, n_docs, n_terms, block_docs), "k2-treaps")
    of, named = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    count, size = items.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    chunks = max(1, math.ceil(count / chunk_items), math.ceil((size or 0) / chunk_bytes))
    found = None
    for c in range(chunks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks)) == c).select("item_id", "text").collect()
        wanted = [(x["item_id"], sorted(set(terms_of(x["text"].encode())))) for x in own if x["text"]]
        part = _descents(blocks, wanted, n_docs, k, of, named).withColumn("chunk", F.lit(c))
        found = part if found is None else found.unionByName(part)
    ranks = F.expr("row_number() over (partition by chunk, place order by score desc, doc_id asc nulls last)")
    out = found.withColumn("rank", ranks).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score", "n_terms")
    out = stored(out, "ranked")
    discard(blocks)
    return out


def _descents(blocks: DataFrame, wanted: list[tuple], n_docs: int, k: int, of: str, named: str) -> DataFrame:
    """place (of the item in wanted), item_id, doc_id, score, n_terms: each task's best documents of the wanted items."""
    all_terms = sorted({t for _, own in wanted for t in own})

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, df = {t: i for i, t in enumerate(all_terms)}, np.zeros(len(all_terms), np.int64)
        for b in batches:
            for terms, held in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for t, n in zip(terms.split(b" "), _unpacked(held).tolist(), strict=True):
                    if t in place:
                        df[place[t]] += n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["term", "df"])

    weights = dict.fromkeys(range(len(all_terms)), 0)
    for term, df in blocks.select("terms", "df").mapInArrow(counts, "term long, df long").groupBy("term").agg(F.sum("df")).collect():
        weights[term] = weight(n_docs, df)
    by_term = {t: weights[i] for i, t in enumerate(all_terms) if weights[i] > 0}
    wanted = [(i, [t for t in own if t in by_term]) for i, own in wanted]

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in wanted]
        for b in batches:
            for doc_ids, terms, tops, masks, less in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                row = {t: i for i, t in enumerate(terms.split(b" ")) if t in by_term}
                search(Block(height(len(doc_ids)), tops, masks, less), doc_ids, [[(row[t], by_term[t]) for t in own if t in row] for _, own in wanted], best)
        rows = [(i, wanted[i][0], None if null else d, -score, len(wanted[i][1])) for i, x in enumerate(best) for score, null, d in x.rows]
        types = [pa.int64(), schema["item_id"], schema["doc_id"], pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(types)], names=["place", "item_id", "doc_id", "score", "n_terms"])

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    schema = {"item_id": to_arrow_type(_parse_datatype_string(named)), "doc_id": to_arrow_type(_parse_datatype_string(of))}
    return blocks.select("doc_ids", "terms", "tops", "masks", "less").mapInArrow(descend, f"place long, item_id {named}, doc_id {of}, score long, n_terms long")


def op11_ranked_search(spark, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
with d as (select doc_id, row_number() over () as rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ts from documents),
b as (select item_id, row_number() over () as iid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ts from benchmark),
g as (select cast(count(*) as bigint) as n_docs, cast(sum(len(ts)) as bigint) as n_terms from d where len(ts) > 0),
q as (select distinct item_id, iid, unnest(ts) as term from b),
p as (select rid, term, cast(count(*) as bigint) as tf from (select rid, unnest(ts) as term from d) where term in (select term from q) group by rid, term),
w as (select term, cast(floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double)) as bigint) as w from p, g group by term, n_docs),
k as (select item_id, iid, count(*) as n_terms from q join w using (term) where w > 0 group by item_id, iid),
m as (select rid, doc_id, 10 + (90 * cast(len(ts) as bigint) * n_docs) // n_terms as m from d, g where len(ts) > 0),
s as (select q.item_id, q.iid, m.doc_id, m.rid, cast(sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * m.m))) as bigint) as score
      from q join w using (term) join p using (term) join m using (rid) group by all),
r as (select *, row_number() over (partition by iid order by score desc, doc_id asc nulls last) as rank from s where score > 0)
select r.item_id, cast(rank as int) as rank, doc_id, score, n_terms from r join k using (iid) where rank <= 10
"""

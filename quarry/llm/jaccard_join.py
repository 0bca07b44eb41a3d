"""N-gram Jaccard join: a metric-space join over sets of word shingles, exact, returned as connected components.

d(x, y) = 1 - |x & y| / |x | y| is a metric; two documents link when it is at most r.

1. Documents with equal sets (distance 0) form one class; only classes go on.
2. First split.  Document pivots alone cannot split sparse sets: almost every distance is 1, so every document would lie
   in every window.  The first pivots are therefore single shingles.  d(x, {s}) is below 1 exactly for the shingles of x,
   and a set within r of x lacks at most (1 - t)|x| of x's shingles, so a document needs copies only in the regions of
   its first (1 - t)|x| + 1 shingles, in an order that all documents share: what many documents hold comes last.
3. A region of more than `LEAF` classes draws document pivots.  A class goes to the Voronoi region of its nearest pivot when that is
   within 2r; by the triangle inequality all its links lie within 3r of that pivot, so boundary classes are copied to each pivot
   that they are within 3r of.  What is beyond 2r of all pivots can link only among itself and forms the region that is left, which is
   split again with eight times as many pivots until few classes are left for the pivots drawn.  A pivot has met its
   whole region and is settled.
4. Links are closed to parts; a region with one part is settled, whatever its size, so a group of n copies costs about n comparisons.
   In the Voronoi regions of document pivots, what is outside the largest part is compared with all, in blocks (`between_parts`).
   In other regions pairs of different parts are compared within windows of size, of place and of a sketch that bounds the
   difference from below.
5. Links are closed to components by alternating large and small stars.
6. The steps before leave out pairs of one part, so links are counted afterwards: the classes of a component are dealt to blocks,
   and each pair of blocks is counted in one task as a product of incidence matrices.  A pair is never a row.

Null or empty texts have an empty set: n_shingles 0, linked with nothing, component_id = their own doc_id.  Repeated rows
are documents of one class.  A null doc_id never becomes a component_id while the group has another one.
Shingles are 64-bit hashes, texts are used whole.  The shared order is taken from all documents (`shingle_order`); it
changes the cost only, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected
from .shared import discard, ngram_hashes, stored, table

#: Classes that a region may have to be compared directly, and how much the number of pivots grows from one split to the next.
LEAF, MORE = 32, 8
#: Longs of the sketch that goes with a class into its regions, and of the whole sketch.
NARROW, WIDE = 4, 16
#: Shingles that the shared order puts last; in how many texts of a part they stand; shingles of a part.
OFTEN, REPEATED, PART_SHINGLES = 200_000, 3, 4_000_000
#: Classes in a block, about, where the links of a component are counted; columns of an incidence matrix at a time.
BLOCK, COLUMNS = 256, 8192


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at \\x20 and \\x09-\\x0D."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


#: Bytes of texts whose words are told apart and hashed at a time, about; slots of the marks of what stands in the shared order.
TEXT_BYTES, MARKS = 2 << 20, 1 << 22
#: Bytes with A-Z lower-cased, which of them end words, and the constants of XXH64.
LOWER, BLANK = np.frombuffer(bytes(range(256)).lower(), np.uint8), np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rolled(h: np.ndarray, k: int) -> np.ndarray:
    return (h << np.uint64(k)) | (h >> np.uint64(64 - k))


def xxh64_of(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """xxhash.xxh64_intdigest of the words data[start : start + size], those of one size together; data has eight more bytes at its end."""
    out = np.empty(len(starts), np.uint64)
    lanes, halves = (np.ndarray(len(data) - 7, t, data, strides=(1,)) for t in ("<u8", "<u4"))
    held = np.minimum(sizes, 32).astype(np.uint8)
    by = np.argsort(held, kind="stable")
    cuts = np.searchsorted(held[by], np.arange(33))
    for size in range(1, 32):
        rows = by[cuts[size] : cuts[size + 1]]
        if not len(rows):
            continue
        at, h, rest = starts[rows], np.full(len(rows), P5 + np.uint64(size)), size
        while rest >= 8:
            h = _rolled(h ^ (_rolled(lanes[at] * P2, 31) * P1), 27) * P1 + P4
            at, rest = at + 8, rest - 8
        if rest >= 4:
            h = _rolled(h ^ (halves[at].astype(np.uint64) * P1), 23) * P2 + P3
            at, rest = at + 4, rest - 4
        for k in range(rest):
            h = _rolled(h ^ (data[at + k].astype(np.uint64) * P5), 11) * P1
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        out[rows] = h ^ (h >> np.uint64(32))
    for k in by[cuts[32] :].tolist():
        out[k] = xxhash.xxh64_intdigest(data[starts[k] : starts[k] + sizes[k]].tobytes())
    return out


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The set of each text, sorted: np.unique(ngram_hashes(word_array(words_of(text)))), null as ''.  The words and windows of some megabytes of texts are
    found and hashed together."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    k = 0
    while k < len(texts):
        to = max(k + 1, int(np.searchsorted(ends, ends[k] + TEXT_BYTES, "right")) - 1)
        data = np.append(LOWER[whole[ends[k] : ends[to]]], np.full(8, 32, np.uint8))
        own = ends[k : to + 1] - ends[k]
        blank = BLANK[data]
        edge = np.zeros(len(data) + 1, bool)  # words end with their text
        edge[own] = True
        first = ~blank
        first[1:] &= blank[:-1] | edge[1:-1]
        last = ~blank
        last[:-1] &= blank[1:] | edge[1:-1]
        starts = np.flatnonzero(first)
        h = xxh64_of(data, starts, np.flatnonzero(last) + 1 - starts)
        windows = ngram_hashes(h, n) if len(h) >= n else h
        cuts = np.searchsorted(starts, own).tolist()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            x = np.sort(windows[a : b - n + 1] if b - a >= n else ngram_hashes(h[a:b], n))
            yield x[np.append(True, x[1:] != x[:-1])] if len(x) else x
        k = to


def shingle_order(docs: DataFrame, n: int, part_shingles: int = PART_SHINGLES) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and counts of the shingles that many documents hold.

    All documents are read, in parts of about `part_shingles` shingles.  A part tells what `REPEATED` or more of its different texts
    hold; what many documents hold is repeated in some of the parts, however many there are, so it is told although each part
    counts alone.  What is told is added up, and the `OFTEN` largest are the order.
    """

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, sets, held = set(), [], 0

        def part() -> pa.RecordBatch:
            h, count = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            often = count >= REPEATED
            return pa.RecordBatch.from_arrays([pa.array(h[often].astype(np.int64)), pa.array(count[often].astype(np.int64))], names=["h", "n"])

        for b in batches:
            keep = []
            for k, text in enumerate(pc.fill_null(b.column(0), "").cast(pa.binary())):
                mark = xxhash.xxh3_64_digest(text.as_buffer())
                if mark not in texts:  # copies of one text say nothing of what different texts share
                    texts.add(mark)
                    keep.append(k)
            for own in shingle_sets(b.column(0).take(pa.array(keep, pa.int64())), n):
                sets.append(own)
                held += len(sets[-1])
                if held >= part_shingles:
                    yield part()
                    texts, sets, held = set(), [], 0
        yield part()

    found = docs.select("text").mapInArrow(told, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(OFTEN).toPandas()
    h = found["h"].to_numpy("int64").astype("uint64")
    by = np.argsort(h)
    return h[by], found["n"].to_numpy("int64")[by]


def shingled(docs: DataFrame, n: int, percent: int, order: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, n_shingles, cid (a 128-bit hash of the set), head (the shingles whose regions the document enters, in order) and
    sketch: for 1024 classes of shingles whether the set holds an odd number, so that sketches differ in at most |x - y| + |y - x| bits."""
    known, count = order
    columns = {"n_shingles": pa.int64(), "cid": pa.binary(), "head": pa.list_(pa.int64()), "sketch": pa.list_(pa.int64())}

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        marks = np.zeros(MARKS, bool)
        marks[(known & np.uint64(MARKS - 1)).astype(np.int64)] = True
        for b in batches:
            rows = []
            for sets in shingle_sets(b, n):
                m = len(sets)
                c = np.zeros(m, np.int64)
                some = np.flatnonzero(marks[(sets & np.uint64(MARKS - 1)).astype(np.int64)])
                if len(some):  # few shingles stand in the order, and others are not looked up
                    at = np.minimum(np.searchsorted(known, sets[some]), len(known) - 1)
                    c[some] = np.where(known[at] == sets[some], count[at], 0)
                # sets is sorted, so that a stable sort by count breaks ties by hash.
                head = sets[np.argsort(c, kind="stable")[: m - (percent * m + 99) // 100 + 1]] if m else sets
                odd = np.bincount((sets & np.uint64(64 * WIDE - 1)).astype(np.int64), minlength=64 * WIDE) & 1
                rows.append((m, xxhash.xxh3_128_digest(sets.tobytes()) if m else None, head.astype(np.int64), np.packbits(odd.astype(np.uint8)).view(np.int64)))
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, columns.values(), strict=True)], names=list(columns))

    out = F.arrow_udf(run, "struct<n_shingles long, cid binary, head array<long>, sketch array<long>>")
    return docs.select("doc_id", out("text").alias("s")).select("doc_id", "s.*")


def able(pairs: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """The pairs (p, x, far) whose sketches and heads leave it open that they are linked or, with far, that they are within 3r.

    All shared shingles that come before the end of both heads lie in both, so the set whose head ends first shares at most
    the heads' common shingles and what follows its head.
    """
    h = heads.select("sid", "n", "head", "sketch")
    both = pairs.join(h.withColumnsRenamed({"sid": "x", "n": "x_n", "head": "x_head", "sketch": "x_sketch"}), "x")
    both = both.join(h.withColumnsRenamed({"sid": "p", "n": "p_n", "head": "p_head", "sketch": "p_sketch"}), "p")
    bits = " + ".join(f"bit_count(p_sketch[{k}] ^ x_sketch[{k}])" for k in range(WIDE))
    most = "(size(array_intersect(p_head, x_head)) + greatest(p_n - size(p_head), x_n - size(x_head)))"
    return both.where(f"{differ(bits, 'p_n', 'x_n', percent)} and (far or 100 * {most} >= {percent} * (p_n + x_n - {most}))").select("p", "x")


def differ(bits: str, a: str, b: str, percent: int) -> str:
    """Whether sets of a and b shingles whose sketches differ in so many bits can be linked or, where far holds, within 3r."""
    return f"({200 - (100 - percent)} - if(far, {2 * (100 - percent)}, 0)) * ({bits}) <= if(far, 3, 1) * {100 - percent} * ({a} + {b})"


def compared(pairs: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """pairs (p, x) with the sizes of intersection and union of their sets."""

    @F.pandas_udf("struct<both long, whole long>")
    def overlap(p: pd.Series, a: pd.Series, b: pd.Series) -> pd.DataFrame:
        last, held, out = None, None, []
        for q, s, x in zip(p, a, shingle_sets(pa.array(b, pa.string()), n), strict=True):
            if q != last or held is None:
                last, held = q, next(shingle_sets(pa.array([s], pa.string()), n))
            at = np.minimum(np.searchsorted(held, x), len(held) - 1)
            both = int((held[at] == x).sum())
            out.append((both, len(held) + len(x) - both))
        return pd.DataFrame(out, columns=["both", "whole"])

    t = texts.select("sid", "text")
    return (
        pairs.join(t.withColumnsRenamed({"sid": "x", "text": "x_text"}), "x")
        .join(t.withColumnsRenamed({"sid": "p", "text": "p_text"}), "p")
        .select("p", "x", overlap("p", "p_text", "x_text").alias("o"))
        .select("p", "x", "o.both", "o.whole")
    )


def _common(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of all sets on the left with all on the right (None: the left ones), as products of incidence matrices."""
    cells = np.unique(np.concatenate([*left, *(right or [])]))
    ids, other = ([np.searchsorted(cells, x) for x in sets] for sets in (left, right or []))

    def matrix(ids: list[np.ndarray], start: int) -> np.ndarray:
        out = np.zeros((len(ids), COLUMNS), np.float32)
        for k, x in enumerate(ids):
            a, b = np.searchsorted(x, (start, start + COLUMNS))
            out[k, x[a:b] - start] = 1
        return out

    both = np.zeros((len(left), len(left if right is None else right)), np.int64)
    for start in range(0, len(cells), COLUMNS):
        a = matrix(ids, start)
        both += (a @ (a if right is None else matrix(other, start)).T).astype(np.int64)
    return both


def _groups(batches: Iterator[pd.DataFrame], keys: list[str], rest: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Consecutive rows with equal keys."""
    last, held = None, []
    for b in batches:
        for row in b[[*keys, *rest]].itertuples(index=False, name=None):
            if row[: len(keys)] != last:
                if held:
                    yield last, held
                last, held = row[: len(keys)], []
            held.append(row[len(keys) :])
    if held:
        yield last, held


def between_parts(members: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Links (p, x) that join the parts of each region.  members: region, sid, own (in its own Voronoi region), root.

    What is outside the region's largest part is compared with all of the region: both are dealt to blocks of about `BLOCK` classes and each pair of
    blocks is one task's product, which gives no more links than it has classes.  So a region of m classes, s of them outside
    the largest part, moves m * s / BLOCK rows or so.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, held in _groups(batches, ["region", "tb", "qb"], ["asks", "sid", "own", "root", "text"]):
            asks = [x for x in held if x[0]]
            all_ = [x for x in held if not x[0]]
            if not asks or not all_:
                continue
            left, right = (list(shingle_sets(pa.array([x[4] for x in side], pa.string()), n)) for side in (asks, all_))
            both = _common(left, right)
            whole = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :] - both
            own = np.array([x[2] for x in asks])[:, None] | np.array([x[2] for x in all_])[None, :]
            up: dict[int, int] = {}

            def top(v: int) -> int:
                while (w := up.get(v, v)) != v:
                    up[v] = up.get(w, w)
                    v = w
                return v

            out = []
            for i, j in zip(*(x.tolist() for x in np.nonzero((100 * both >= percent * whole) & own)), strict=True):
                a, b = top(asks[i][3]), top(all_[j][3])
                if a != b:
                    up[a] = b
                    out.append((asks[i][1], all_[j][1]))
            yield pd.DataFrame(out, columns=["p", "x"]).astype("int64")

    parts = members.groupBy("region", "root").agg(F.count("*").alias("m"))
    size = parts.groupBy("region").agg(F.sum("m").alias("m"), F.max_by("root", F.struct("m", "root")).alias("most"), F.max("m").alias("l")).where("m > l")
    size = size.selectExpr("region as of", "most", f"(m + {BLOCK - 1}) div {BLOCK} as nt", f"(m - l + {BLOCK - 1}) div {BLOCK} as nq")
    held = members.join(size, F.col("region") == F.col("of")).drop("of")
    held = stored(held.withColumns({"t": F.expr("pmod(xxhash64(sid), nt)"), "q": F.expr("pmod(xxhash64(sid, 1), nq)")}), "in-parts")
    dealt = held.selectExpr("region", "sid", "own", "root", "false as asks", "t as tb", "explode(sequence(0, nq - 1)) as qb")
    dealt = dealt.unionByName(held.where("root != most").selectExpr("region", "sid", "own", "root", "true as asks", "explode(sequence(0, nt - 1)) as tb", "q as qb"))
    dealt = dealt.join(texts.withColumnRenamed("sid", "of"), F.col("sid") == F.col("of")).drop("of")
    return dealt.repartition("region", "tb", "qb").sortWithinPartitions("region", "tb", "qb").mapInPandas(run, "p long, x long")


def link_counts(members: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """(sid, linked): the rows of all other classes that a class links with.  members: sid, root, rows and nb, the blocks of its component."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for key, held in _groups(batches, ["root", "lo", "hi"], ["b", "sid", "rows", "text"]):
            sids, weights = np.array([x[1] for x in held], np.int64), np.array([x[2] for x in held], np.int64)
            sets = list(shingle_sets(pa.array([x[3] for x in held], pa.string()), n))
            sizes = np.array([len(x) for x in sets], np.int64)
            one = key[1] == key[2]
            cut = len(held) if one else sum(x[0] == key[1] for x in held)  # sorted: the lower block first
            rest = 0 if one else cut
            if not one and cut in (0, len(held)):
                continue
            both = _common(sets[:cut], None if one else sets[cut:])
            link = 100 * both >= percent * (sizes[:cut, None] + sizes[None, rest:] - both)
            if one:
                np.fill_diagonal(link, False)
                yield pd.DataFrame({"sid": sids, "linked": link @ weights})
            else:
                yield pd.DataFrame({"sid": sids, "linked": np.concatenate((link @ weights[cut:], weights[:cut] @ link))})

    own = members.join(texts, "sid").withColumn("b", F.expr("pmod(xxhash64(sid), nb)")).withColumn("j", F.explode(F.expr("sequence(0, nb - 1)")))
    dealt = own.selectExpr("root", "least(b, j) as lo", "greatest(b, j) as hi", "b", "sid", "rows", "text").repartition("root", "lo", "hi").sortWithinPartitions("root", "lo", "hi", "b")
    return dealt.mapInPandas(run, "sid long, linked long").groupBy("sid").agg(F.sum("linked").alias("linked"))


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, count_links: bool = True) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, class_id, n_links (with count_links) and component_id.

    Two documents link when 100 * |x & y| >= percent * |x | y| over their distinct n-word shingles (fewer words: the whole
    sequence).  class_id is the set's hash (null without words), the same however rows are dealt; n_links counts the
    other rows that the row links with, those with an equal set among them; component_id is the smallest doc_id reachable by links.
    Where doc_ids are null or repeated, rows get keys of their own, so that no id stands for several texts.
    """
    docs = docs.select("doc_id", "text")
    if not docs.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1 or doc_id is null").take(1):
        return _components(docs, n, percent, count_links)
    keyed = stored(docs.withColumn("row_key", F.monotonically_increasing_id()), "keyed-rows")
    found = stored(_components(keyed.selectExpr("row_key as doc_id", "text"), n, percent, count_links), "found-rows")
    found = found.withColumnsRenamed({"doc_id": "row_key", "component_id": "part"}).join(keyed.select("row_key", "doc_id"), "row_key")
    least = found.groupBy("part").agg(F.min("doc_id").alias("component_id")).withColumnRenamed("part", "of")
    out = found.join(least, (F.xxhash64("part") == F.xxhash64("of")) & (F.col("part") == F.col("of")))
    return out.select("doc_id", "n_shingles", "class_id", *(["n_links"] if count_links else []), "component_id")


def _components(docs: DataFrame, n: int, percent: int, count_links: bool) -> DataFrame:
    """jaccard_components where each doc_id stands for one row."""
    whole = stored(shingled(docs, n, percent, shingle_order(docs, n)), "shingled")
    rows = stored(whole.drop("head", "sketch"), "rows")
    classes = whole.where("n_shingles > 0").groupBy("cid").agg(F.min(F.struct("doc_id", F.col("n_shingles").alias("n"), "head", "sketch")).alias("c"), F.count("*").alias("rows"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("sid"), "cid", "rows", "c.doc_id", "c.n", "c.head", "c.sketch"), "classes")
    discard(whole)

    posts = classes.select("sid", F.col("n").cast("int").alias("n"), F.posexplode("head").alias("pos", "region"))
    shared = posts.groupBy("region").agg(F.count("*").alias("c")).where("c > 1").selectExpr("region as of", "c")
    # Joined on an expression of the key, so that both sides are exchanged and a hot region can be split.
    first = stored(posts.join(shared, posts.region == shared.of).select("region", "sid", "n", "pos", "c"), "regions")
    heads = stored(classes.join(first.select("sid").distinct(), "sid"), "heads")

    reach = (100 - percent) / 100
    tried = links = None
    roots = docs.sparkSession.createDataFrame([], "node long, root long")

    def learn(pairs: DataFrame) -> None:
        """Compares the pairs (p, x, far) that were not compared before and closes the links anew."""
        nonlocal tried, links, roots
        pairs = pairs.selectExpr("least(p, x) as p", "greatest(p, x) as x", "far").groupBy("p", "x").agg(F.max("far").alias("far"))
        if tried is not None:
            pairs = pairs.join(tried.select("p", "x"), ["p", "x"], "left_anti")
        pairs = stored(able(pairs, heads, percent), "pairs")
        if tried is not None and not pairs.take(1):
            return
        texts = _texts(docs, pairs, heads)
        found = stored(compared(pairs, texts, n), "distances")
        discard(texts)
        tried = found if tried is None else tried.unionByName(found)
        new = found.where(f"100 * both >= {percent} * whole").select("p", "x")
        links = new if links is None else links.unionByName(new)
        roots = connected(links.selectExpr("p as a", "x as b"))

    def in_parts(members: DataFrame) -> DataFrame:
        return members.join(roots.selectExpr("node as of", "root"), F.col("sid") == F.col("of"), "left").drop("of").withColumn("root", F.expr("coalesce(root, sid)"))

    def mixed(members: DataFrame) -> DataFrame:
        """The members (region, sid, n, pos) of regions with several parts, with their part and their region's classes."""
        known = stored(in_parts(members), "parts")
        size = known.groupBy("region").agg(F.count("*").alias("c"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").selectExpr("xxhash64(region) as key", "region as of", "c")
        out = stored(known.join(size, (F.xxhash64("region") == F.col("key")) & (F.col("region") == F.col("of"))).drop("key", "of"), "open")
        discard(known)
        return out

    columns = ["region", "sid", "n", "pos"]
    open_, leaves, voronoi, k = first, [], [], 1
    while open_.take(1):
        # Pivots by a hash that does not hang on the region, so that regions with the same members have the same pivots.
        drawn = open_.groupBy("region", F.expr(f"pmod(xxhash64(sid), {k})")).agg(F.min(F.struct(F.xxhash64("sid").alias("h"), "sid", "n")).alias("v"))
        pivots = stored(drawn.selectExpr("region as of", "v.sid as p", "v.n as p_n"), "pivots")
        held = open_.join(pivots, F.col("region") == F.col("of")).where("sid != p").withColumn("far", F.col("c") > LEAF)
        near = held.where(f"100 * least(n, p_n) >= if(far, {max(0, 3 * percent - 200)}, {percent}) * greatest(n, p_n)")
        learn(near.select("p", F.col("sid").alias("x"), "far"))
        if k == 1:  # one pivot closes the groups of copies in small regions
            leaves.append(open_.where(f"c <= {LEAF}"))
        k *= MORE
        large = open_.where(f"c > {LEAF}")
        met = large.join(pivots, F.col("region") == F.col("of")).where("sid != p").select("region", "sid", "p")
        seen = tried.selectExpr("p as a", "x as b", "1 - both / whole as d").where(f"d <= {3 * reach} + 1e-9")
        seen = seen.unionByName(seen.selectExpr("b as a", "a as b", "d"))
        # Regions that share a pivot share its Voronoi region.
        around = stored(met.join(seen, (F.col("p") == F.col("a")) & (F.col("sid") == F.col("b"))).select("region", "sid", "p", "d"), "around")
        home = around.where(f"d <= {2 * reach} + 1e-9").groupBy("region", "sid").agg(F.min(F.struct("d", "p")).alias("v")).selectExpr("sid", "v.p as p", "true as own")
        voronoi.append(around.selectExpr("sid", "p", "false as own").unionByName(home).groupBy("p", "sid").agg(F.max("own").alias("own")).withColumnRenamed("p", "region"))
        done = around.where(f"d <= {2 * reach} + 1e-9").select("region", "sid").unionByName(pivots.selectExpr("of as region", "p as sid")).distinct().selectExpr("region as r", "sid as s")
        rest = large.join(done, (F.col("region") == F.col("r")) & (F.col("sid") == F.col("s")), "left_anti").select(*columns)
        open_ = mixed(rest)
        few = max(LEAF, 4 * k)
        leaves.append(open_.where(f"c <= {few}"))
        open_ = open_.where(f"c > {few}")

    if leaves:
        inner = stored(in_parts(reduce(DataFrame.unionByName, voronoi)), "voronoi")
        if inner.take(1):
            found = stored(between_parts(inner, _texts(docs, inner.selectExpr("sid as p", "sid as x"), heads), n, percent), "block-links")
            links = links.unionByName(found)
            roots = connected(links.selectExpr("p as a", "x as b"))
        left = mixed(reduce(DataFrame.unionByName, [x.select(*columns) for x in leaves]))
        left = left.join(heads.selectExpr("sid as of", *[f"sketch[{j}] as s{j}" for j in range(NARROW)]), F.col("sid") == F.col("of")).drop("of")
        bits = " + ".join(f"bit_count(a.s{j} ^ b.s{j})" for j in range(NARROW))
        # Windows of size and place: sets of such sizes that meet there first can still be linked.
        most = "least(a.n - a.pos, b.n - b.pos)"
        fits = f"100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n) and 100 * {most} >= {percent} * (a.n + b.n - {most})"
        on = f"a.region = b.region and a.sid < b.sid and a.root != b.root and {fits} and {100 + percent} * ({bits}) <= {100 - percent} * (a.n + b.n)"
        learn(left.alias("a").join(left.alias("b"), F.expr(on)).selectExpr("a.sid as p", "b.sid as x", "false as far"))

    nodes = classes.select("sid", "cid", "rows").join(roots, classes.sid == roots.node, "left").drop("node")
    if count_links:
        nodes = stored(nodes, "nodes")
        size = nodes.where("root is not null").groupBy("root").agg(F.count("*").alias("m"), F.sum("rows").alias("whole")).selectExpr("root as of", "m", "whole")
        # Two classes that are a component are linked.
        members = stored(nodes.join(size, F.col("root") == F.col("of")).selectExpr("sid as member", "root", "rows", "m", "whole", f"(m + {BLOCK - 1}) div {BLOCK} as nb"), "members")
        many = members.where("m > 2").selectExpr("member as sid", "root", "rows", "nb")
        counts = link_counts(many, _texts(docs, many.selectExpr("sid as p", "sid as x"), heads), n, percent)
        counts = counts.unionByName(members.where("m = 2").selectExpr("member as sid", "whole - rows as linked"))
        nodes = nodes.join(counts, "sid", "left")
    kept = ["n_links"] if count_links else []
    n_links = ["coalesce(linked, 0) + rows - 1 as n_links"] if count_links else []
    nodes = nodes.selectExpr("cid as of", "coalesce(root, sid) as root", *n_links)
    labelled = rows.select("doc_id", "n_shingles", "cid").join(nodes, F.col("cid") == F.col("of"), "left").drop("of")
    labelled = stored(labelled.withColumn("class_id", F.lower(F.hex("cid"))).drop("cid"), "labelled")
    least = labelled.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("component")).selectExpr("xxhash64(root) as key", "root as of", "component")
    # As with the first regions, both sides are exchanged, so that a very large component can be split.
    out = labelled.join(least, (F.xxhash64("root") == F.col("key")) & (F.col("root") == F.col("of")), "left")
    return out.selectExpr("doc_id", "n_shingles", "class_id", *[f"coalesce({x}, 0) as {x}" for x in kept], "if(root is null, doc_id, component) as component_id")


def representatives(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, its own columns, that stay when one of each component does: the smallest doc_id, of
    rows with equal ids the first one; a null doc_id comes after all others.  Rows without words all stay."""
    unique = not docs.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1 or doc_id is null").take(1)
    keyed = docs.withColumn("row_key", F.col("doc_id")) if unique else stored(docs.withColumn("row_key", F.monotonically_increasing_id()), "rows")
    found = _components(keyed.select(F.col("row_key").alias("doc_id"), "text"), n, percent, False)
    if unique:
        keep = found.where("component_id = doc_id").select(F.col("doc_id").alias("row_key"))
    else:
        ids = found.select("component_id", F.col("doc_id").alias("row_key")).join(keyed.select("row_key", F.col("doc_id").alias("id")), "row_key")
        keep = ids.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row_key")).alias("v")).select("v.row_key")
    return keyed.join(keep, "row_key", "left_semi").select(*docs.columns)


#: Bits of the filter that keeps texts out of a shuffle: 1 MB at any input size.
FILTER_BITS = 1 << 23


def _texts(docs: DataFrame, pairs: DataFrame, heads: DataFrame) -> DataFrame:
    """(sid, text) of the classes in pairs; text is that of the row that stands for the class."""
    wanted = pairs.selectExpr("explode(array(p, x)) as sid").distinct().join(heads.select("sid", "doc_id"), "sid")
    place = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)) + 1
    at = wanted.select(F.col("doc_id").alias("id")).select(place.alias("h")).select(F.bitmap_bucket_number("h").alias("bucket"), F.bitmap_bit_position("h").alias("bit"))
    bits = F.broadcast(at.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")))
    rows = docs.withColumnRenamed("doc_id", "id").withColumn("h", place).withColumns({"bucket": F.bitmap_bucket_number("h"), "bit": F.bitmap_bit_position("h")}).join(bits, "bucket")
    rows = rows.where("(cast(conv(hex(substring(bits, cast(bit div 8 as int) + 1, 1)), 16, 10) as int) >> cast(bit % 8 as int)) & 1 = 1").select("id", "text")
    return stored(wanted.join(rows, wanted.doc_id == rows.id).select("sid", "text"), "texts")


def op5_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Four-word shingles at 85 of 100, over all documents."""
    return jaccard_components(table(spark, sf_dir, "documents"), n=4, percent=85).select("doc_id", "n_shingles", "component_id", "n_links", "class_id")

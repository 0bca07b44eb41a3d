"""Texts of one shape are read once: the lexer's facts of a text give those of every text that differs from it in names and numbers alone.

A text is cut into words and what stands between them.  The lexer looks at a word only to see whether it is one of `FIXED`,
a number or another name, so a text's shape is the text with its words replaced by this.  All places of facts lie at ends of words or between words; in a
text of the same shape they are found by the words' lengths, for all texts of a batch together.  Texts where more counts than the shape (strings with prefixes, escapes,
character literals, definitions in the middle of a Python line, characters beyond ASCII) are read on their own.

Of the texts of a batch those that are equal but for digits in names and whole numbers are not even cut into words: where their runs of digits lie is found for all bytes
of the batch at once, and so are the places of their facts.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .declarations import KEYWORDS, MODIFIERS, NO_METHOD, NO_TYPE, WRAPPERS
from .lexer import NOT_CALLS, SPAN, Read, _read, code_facts

WORD, DIGITS = re.compile(r"([\w$]+)"), re.compile("[0-9]+")
#: Words that the lexer knows.
FIXED = frozenset().union(
    NO_TYPE, NO_METHOD, WRAPPERS, *MODIFIERS.values(), *(x.keys() for x in KEYWORDS.values()), *NOT_CALLS.values(),
    "Fn FnMut FnOnce as async case class const default else enum extern fn final fn for func if impl in interface let match mut new non object of record ref return sealed static struct switch throw throws try type unsafe val var where while".split(),
)
OWN = {x: re.compile(r"""[\\\x00'"]""" if x in ("python", "rust") else r"[\\\x00']" if x == "scala" else r"[\\\x00]") for x in SPAN}
#: Shapes that a process holds, and characters of one.
SHAPES, LONGEST = 4096, 100_000
#: Texts equal but for digits that a batch must have to be read by their digits, and bytes of texts that are read so at a time.
ALIKE, AT_A_TIME = 4, 1 << 25

SYMBOL = pa.struct([("name", pa.string()), ("kind", pa.string()), ("start_byte", pa.int64()), ("end_byte", pa.int64()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("signature", pa.string()), ("parent", pa.string())])
CALL = pa.struct([("callee", pa.string()), ("line", pa.int32()), ("text", pa.string()), ("start_byte", pa.int64()), ("caller", pa.string())])
WITHIN = pa.struct([("function", pa.string()), ("start", pa.int64())])
VARIABLE = pa.struct([("name", pa.string()), ("pos", pa.int64()), ("within", pa.list_(WITHIN))])
SPAN_TYPE = pa.struct([("start", pa.int64()), ("end", pa.int64())])
#: Calls in brief: sites are calls without text, place and caller; callees are a text's sites by name.
SITE = pa.struct([("callee", pa.string()), ("line", pa.int32())])
CALLEE = pa.struct([("callee", pa.string()), ("n_calls", pa.int64()), ("first_line", pa.int32())])
TYPES = {"symbols": pa.list_(SYMBOL), "calls": pa.list_(CALL), "variables": pa.list_(VARIABLE), "spans": pa.list_(SPAN_TYPE), "lines": pa.list_(pa.int64()), "sites": pa.list_(SITE), "callees": pa.list_(CALLEE)}


def cut(text: str, language: str) -> tuple[str | None, list[str]]:
    """The shape of a text, or None if it is to be read on its own, and its words."""
    if language not in SPAN or len(text) > LONGEST or not text.isascii() or OWN[language].search(text):
        return None, []
    parts = WORD.split(text)
    words = parts[1::2]
    parts[1::2] = ["n" if w not in FIXED and w.isidentifier() else "0" if w.isdigit() else w for w in words]
    return "\0".join(parts), words


class Shape:
    """The facts of a text by its words: place j of a text is base[j] + the lengths of its first before[j] words."""

    def __init__(self, read: Read, text: str):
        parts = WORD.split(text)
        self.starts = [0, *accumulate(map(len, parts))][:-1]
        between = [0, *accumulate(len(x) * (k % 2 == 0) for k, x in enumerate(parts))]
        self.fits, self.base, self.before, self.numbers = not read.by_column, [], [], {}

        def at(place: int) -> int:
            if place not in self.numbers:
                k = bisect_right(self.starts, place) - 1
                self.fits &= k % 2 == 0 or place == self.starts[k]
                self.numbers[place] = len(self.base)
                self.base.append(between[k] + place - self.starts[k] if k % 2 == 0 else between[k])
                self.before.append(k // 2)
            return self.numbers[place]

        def range_(x: tuple[int, int] | None) -> tuple[int, int] | None:
            return None if x is None else (at(x[0]), at(x[1]))

        names = [range_(x[0]) for x in read.symbols]
        self.fits &= all(text[slice(*x[0])] == name for x, name in zip(read.symbols, read.names, strict=True))
        self.fits &= all(parent is None or text[slice(*x[7])] == parent for x, parent in zip(read.symbols, read.parents, strict=True))
        self.symbols = [(name, kind, at(s), at(e), first, last, range_(sign), range_(parent)) for name, (_, kind, s, e, first, last, sign, parent) in zip(names, read.symbols, strict=True)]
        self.calls = [(range_(own), line, range_(whole), at(own[0]), names[n] if n >= 0 else None) for own, line, whole, n in read.calls]
        self.variables = [(range_(own), at(own[0]), [(names[n], at(read.symbols[n][2])) for n in outer]) for own, outer in read.variables]
        self.spans = [range_(x) for x in read.spans]
        self.lines = [at(k) for k in read.lines]

    def facts(self, texts: list[str], words: list[list[str]], wanted: tuple[str, ...]) -> list[pa.Array]:
        """The wanted facts of texts of this shape."""
        ends = np.zeros((len(texts), len(words[0]) + 1), np.int64)
        if words[0]:
            np.cumsum(np.array([[len(w) for w in x] for x in words], np.int64), axis=1, out=ends[:, 1:])
        places = ends[:, self.before] + np.array(self.base, np.int64)
        rows = places.tolist()

        def strings(ranges: list[tuple[int, int] | None]) -> pa.Array:
            if None in ranges:
                return pa.array([None if x is None else t[r[x[0]] : r[x[1]]] for t, r in zip(texts, rows, strict=True) for x in ranges], pa.string())
            return pa.array([t[r[a] : r[b]] for t, r in zip(texts, rows, strict=True) for a, b in ranges], pa.string())

        return self._columns(places, strings, wanted)

    def facts_by_digits(self, data: np.ndarray, starts: np.ndarray, runs: np.ndarray, words: list[str], wanted: tuple[str, ...]) -> list[pa.Array]:
        """The wanted facts of texts that differ from one with these words in digits alone: the texts' first bytes in data, and the lengths of their runs of digits."""
        plain = np.array([0, *accumulate(len(DIGITS.sub("", w)) for w in words)], np.int64)
        before = np.array([0, *accumulate(len(DIGITS.findall(w)) for w in words)], np.int64)[self.before]
        ends = np.zeros((len(starts), runs.shape[1] + 1), np.int64)
        np.cumsum(runs, axis=1, out=ends[:, 1:])
        places = ends[:, before] + (np.array(self.base, np.int64) + plain[self.before])
        at = places + starts[:, None]

        def strings(ranges: list[tuple[int, int] | None]) -> pa.Array:
            first, last = (at[:, [0 if x is None else x[k] for x in ranges]].ravel() for k in (0, 1)) if any(ranges) else np.zeros((2, len(starts) * len(ranges)), np.int64)
            there = np.tile(np.array([x is not None for x in ranges], bool), len(starts))
            lengths = np.where(there, last - first, 0)
            offsets = np.concatenate(([0], np.cumsum(lengths)))
            taken = data[np.repeat(first - offsets[:-1], lengths) + np.arange(offsets[-1])]
            out = pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(taken))
            return out if there.all() else pc.if_else(pa.array(there), out, pa.scalar(None, pa.string()))

        return self._columns(places, strings, wanted)

    def _columns(self, places: np.ndarray, strings: Callable, wanted: tuple[str, ...]) -> list[pa.Array]:
        """The wanted facts of texts with these places; strings gives the texts' strings between places, text by text."""
        n = len(places)

        def longs(numbers: list[int]) -> pa.Array:
            return pa.array(places[:, numbers].ravel() if numbers else np.zeros(0, np.int64))

        def same(values: list, kind: pa.DataType) -> pa.Array:
            return pa.array(values, kind).take(pa.array(np.tile(np.arange(len(values)), n)))

        def lists(count: int, values: pa.Array) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array((np.arange(n + 1) * count).astype(np.int32)), values)

        def column(x: list[tuple], k: int) -> list:
            return [v[k] for v in x]

        out = []
        for what in wanted:
            if what == "lines":
                out.append(lists(len(self.lines), longs(self.lines)))
                continue
            own = self.calls if what == "sites" else getattr(self, what)
            if what == "symbols":
                fields = [strings(column(own, 0)), same(column(own, 1), pa.string()), longs(column(own, 2)), longs(column(own, 3)), same(column(own, 4), pa.int32()), same(column(own, 5), pa.int32()), strings(column(own, 6)), strings(column(own, 7))]
            elif what == "calls":
                fields = [strings(column(own, 0)), same(column(own, 1), pa.int32()), strings(column(own, 2)), longs(column(own, 3)), strings(column(own, 4))]
            elif what == "sites":
                fields = [strings(column(own, 0)), same(column(own, 1), pa.int32())]
            elif what == "variables":
                within = [x for v in own for x in v[2]]
                inner = pa.StructArray.from_arrays([strings(column(within, 0)), longs(column(within, 1))], fields=list(WITHIN))
                counts = np.tile(np.array([len(v[2]) for v in own], np.int64), n)
                offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
                fields = [strings(column(own, 0)), longs(column(own, 1)), pa.ListArray.from_arrays(offsets, inner)]
            else:
                fields = [longs(column(own, 0)), longs(column(own, 1))]
            out.append(lists(len(own), pa.StructArray.from_arrays(fields, fields=list(TYPES[what].value_type))))
        return out


def _shape(text: str, language: str, shape: str, known: dict[tuple[str, str], Shape | None]) -> Shape | None:
    key = (language, shape)
    if key not in known:
        if len(known) >= SHAPES:
            known.clear()
        made = Shape(_read(text, language), text)
        known[key] = made if made.fits else None
    return known[key]


def facts_of_batch(content: pa.StringArray, language: pa.StringArray, wanted: tuple[str, ...], known: dict[tuple[str, str], Shape | None]) -> pa.StructArray:
    """facts_of for a batch's columns; texts equal but for digits go through as bytes.  Only here callees can be wanted."""
    if "callees" in wanted:
        own = facts_of_batch(content, language, tuple(dict.fromkeys("sites" if x == "callees" else x for x in wanted)), known)
        return _struct([_by_name(own.field("sites")) if x == "callees" else own.field(x) for x in wanted], wanted)
    content, language = content.cast(pa.string()), language.cast(pa.string())
    n = len(content)
    offsets = np.frombuffer(content.buffers()[1], np.int32)[content.offset : content.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    base = offsets[0]
    data = np.frombuffer(content.buffers()[2] or b"", np.uint8)[base : offsets[-1]]
    offsets -= base
    digit = (data >= 48) & (data <= 57)
    # A run of digits ends with its text.
    fresh = np.ones(len(data) + 1, bool)
    fresh[1:-1] = ~digit[:-1]
    fresh[offsets] = True
    held = ~digit | fresh[:-1]
    first = np.flatnonzero(digit & fresh[:-1])
    last = np.flatnonzero(digit & np.append(~digit[1:] | fresh[1:-1], True)[: len(data)])
    lengths = last - first + 1
    run_of = np.searchsorted(first, offsets)
    kept = np.concatenate(([0], np.cumsum(held)))[offsets].astype(np.int32)
    alike = pa.StringArray.from_buffers(n, pa.py_buffer(kept), pa.py_buffer(np.where(digit, np.uint8(48), data)[held])).dictionary_encode()
    languages = language.dictionary_encode()
    able = ~(content.is_null().to_numpy(zero_copy_only=False) | language.is_null().to_numpy(zero_copy_only=False))
    codes = languages.indices.fill_null(0).to_numpy().astype(np.int64) * max(1, len(alike.dictionary)) + alike.indices.to_numpy()
    rows = np.flatnonzero(able)
    rows = rows[np.argsort(codes[rows], kind="stable")]
    cuts = np.flatnonzero(np.append(True, codes[rows][1:] != codes[rows][:-1])) if len(rows) else np.zeros(0, np.int64)
    order, parts, alone = [], [], [np.flatnonzero(~able)]
    for own in np.split(rows, cuts[1:]):
        text, x = (content[own[0]].as_py(), language[own[0]].as_py()) if len(own) >= ALIKE else ("", None)
        shape, words = cut(text, x)
        # A word with digits that is neither a name nor a number is part of the shape.
        if shape is None or any(not (w.isdigit() or w.isidentifier()) and DIGITS.search(w) for w in words) or (made := _shape(text, x, shape, known)) is None:
            alone.append(own)
            continue
        count = run_of[own[0] + 1] - run_of[own[0]]
        step = max(1, AT_A_TIME // max(1, len(text)))
        for some in (own[k : k + step] for k in range(0, len(own), step)):
            columns = made.facts_by_digits(data, offsets[some], lengths[run_of[some][:, None] + np.arange(count)], words, wanted)
            parts.append(_struct([a.cast(TYPES[what]) for a, what in zip(columns, wanted, strict=True)], wanted))
            order.append(some)
    left = np.concatenate(alone)
    if len(left) or not parts:
        taken = pa.array(left)
        parts.append(facts_of(content.take(taken).to_pylist(), language.take(taken).to_pylist(), wanted, known))
        order.append(left)
    return pa.concat_arrays(parts).take(pa.array(np.argsort(np.concatenate(order))))


def _by_name(sites: pa.ListArray) -> pa.ListArray:
    """callees of each text's sites, in any order."""
    flat = sites.flatten()
    rows = pa.table({"text": pc.list_parent_indices(sites), "callee": flat.field("callee"), "line": flat.field("line")})
    out = rows.group_by(["text", "callee"]).aggregate([("line", "count"), ("line", "min")]).sort_by("text")
    own, callee, n, first = (out[x].combine_chunks() for x in ("text", "callee", "line_count", "line_min"))
    offsets = np.searchsorted(own.to_numpy(), np.arange(len(sites) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([callee, n, first], fields=list(CALLEE)))


def _struct(columns: list[pa.Array], wanted: tuple[str, ...]) -> pa.StructArray:
    return pa.StructArray.from_arrays(columns, fields=[pa.field(what, TYPES[what]) for what in wanted])


def facts_of(texts: list[str | None], languages: list[str | None], wanted: tuple[str, ...], known: dict[tuple[str, str], Shape | None]) -> pa.StructArray:
    """The wanted facts of each text, as code_facts gives them; known: the shapes that the process has read, None for those where more counts."""
    groups, alone = {}, []
    for k, (text, language) in enumerate(zip(texts, languages, strict=True)):
        shape, words = cut(text or "", language)
        if shape is None:
            alone.append(k)
            continue
        key, made = (language, shape), _shape(text or "", language, shape, known)
        if made is None:
            alone.append(k)
        elif key in groups:
            groups[key][1].append(k)
            groups[key][2].append(words)
        else:
            groups[key] = (made, [k], [words])
    order, parts = [], [[] for _ in wanted]
    for shape, at, words in groups.values():
        order += at
        for part, x in zip(parts, shape.facts([texts[k] or "" for k in at], words, wanted), strict=True):
            part.append(x)
    if alone or not order:
        order += alone
        facts = [code_facts(texts[k] or "", languages[k]) for k in alone]
        for part, what in zip(parts, wanted, strict=True):
            part.append(pa.array([f["calls" if what == "sites" else what] for f in facts], TYPES[what]))
    back = pa.array(np.argsort(np.array(order, np.int64)))
    columns = [pa.concat_arrays([x.cast(TYPES[what]) for x in part]).take(back) for part, what in zip(parts, wanted, strict=True)]
    return _struct(columns, wanted)

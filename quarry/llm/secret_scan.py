"""Secret scans with a recursive decoding worklist.

Base spans come from three patterns on the text itself.  The worklist then unwraps layers: per cent escapes (%XX, %uXXXX), backslash
escapes (\\uXXXX, \\u{X}, \\UXXXXXXXX, \\xXX), base64 runs and, inside those, compressed data (gzip, zlib, bzip2, xz, zstd; all members and
frames, however deep).  Base64 may be wrapped over lines, which are joined first, and glued to other signs of its alphabet: a run of any length is
decoded from each of its four alignments and from every place where compressed data may begin.  Bytes that are no UTF-8 are read as Latin-1, and
those of UTF-16 lose their zero bytes.  Every layer is scanned (joined lines only for what they encode)
with the same patterns and put on the list again, until nothing new comes out.  A layer is unwrapped once, known by its digest, which
ends cycles; its finds are mapped back to every place that it was decoded from, down to code points of the text: escapes
map character by character, a whole base64 run as a whole, a shifted one by groups of four characters.

Decompressed data is read in windows of `WINDOW` bytes that overlap by `OVERLAP`, so memory stays bounded and there is no limit on
its size; only an encoded run that is itself longer than the overlap and lies across the end of a window is seen in part.

Spans are (start, kind, end), end exclusive, sorted by start, then kind as listed, then end.  Null and empty texts have none.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import itertools
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import table

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2}|%u[0-9A-Fa-f]{4})+")
PERCENT_ONE = re.compile(r"%u[0-9A-Fa-f]{4}|(?:%[0-9A-Fa-f]{2})+")
ONE = re.compile(r"\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}")
BACKSLASH = re.compile(f"(?:{ONE.pattern})+")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Runs that go on over line ends, with the indentation of the next line.
WRAPPED = re.compile(r"(?:[A-Za-z0-9+/_-]{16,}\r?\n[ \t]*)+[A-Za-z0-9+/_-]+={0,2}")
#: How compressed data begins in base64 (gzip, bzip2, xz, zstd, zlib), fixed values.
PACKED = re.compile(r"H4sI|QlpoO|QlpoM|Qlpo[N-Z]|/Td6WFoA|KLUv|eJ|eAE|eF4|eNo")
#: Characters of UTF-16 text up to U+00FF, read byte by byte.
WIDE = re.compile(r"(?:[^\0]\0){6,}|(?:\0[^\0]){6,}")
STANDARD = str.maketrans("-_", "+/")
LONGEST_MARK = 6
WINDOW, OVERLAP = 32 << 20, 1 << 20


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by the three patterns: leftmost, non-overlapping per kind."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


class Layer:
    """A decoded text.  Its pieces (own start, source start, source end, step) lead back to the text that it came from;
    with step 1 the piece maps character by character, with step 0 as a whole, with step 4 three characters to four."""

    def __init__(self, text: str, pieces: list[tuple[int, int, int, int]]):
        self.text, self.pieces = text, pieces
        self.starts = [p[0] for p in pieces]

    def source(self, start: int, end: int) -> tuple[int, int]:
        own, s, _, step = self.pieces[bisect_right(self.starts, start) - 1]
        first = s + (4 * ((start - own) // 3) if step == 4 else (start - own) * step)
        own, s, e, step = self.pieces[bisect_right(self.starts, end - 1) - 1]
        return first, min(e, s + 4 * -((own - end) // 3)) if step == 4 else s + end - own if step else e


def _escaped(text: str, groups: re.Pattern, read) -> Layer | None:
    """The text with its escapes decoded; read(group) yields (characters, length of their escape)."""
    out, pieces, at, done = [], [], 0, 0
    for m in groups.finditer(text):
        if m.start() > done:
            pieces.append((at, done, m.start(), 1))
            out.append(text[done : m.start()])
            at += m.start() - done
        s = m.start()
        for chars, n in read(m[0]):
            pieces.append((at, s, s + n, 0))
            out.append(chars)
            at += len(chars)
            s += n
        done = m.end()
    if not done:
        return None
    pieces.append((at, done, len(text), 1))
    out.append(text[done:])
    return Layer("".join(out), pieces)


def _percent(group: str) -> Iterator[tuple[str, int]]:
    for part in PERCENT_ONE.findall(group):
        if part[1] == "u":
            yield chr(int(part[2:], 16)), 6
            continue
        data = bytes.fromhex(part.replace("%", ""))
        try:
            for c in data.decode():
                yield c, 3 * len(c.encode())
        except UnicodeDecodeError:
            for b in data:
                yield chr(b), 3


def _backslash(group: str) -> Iterator[tuple[str, int]]:
    parts, k = ONE.findall(group), 0
    while k < len(parts):
        a = int(parts[k][2:].strip("{}"), 16)
        if 0xD800 <= a < 0xDC00 and k + 1 < len(parts) and 0xDC00 <= (b := int(parts[k + 1][2:].strip("{}"), 16)) < 0xE000:
            yield chr(0x10000 + ((a - 0xD800) << 10) + b - 0xDC00), len(parts[k]) + len(parts[k + 1])
            k += 2
            continue
        yield ("�" if 0xD800 <= a < 0xE000 or a > 0x10FFFF else chr(a)), len(parts[k])
        k += 1


def _wide(group: str) -> Iterator[tuple[str, int]]:
    for c in group.replace("\0", ""):
        yield c, 2


def _opener(data: bytes):
    """A new decompressor for data that begins like compressed data, else None."""
    if data[:2] == b"\x1f\x8b":
        return lambda: zlib.decompressobj(31)
    if data[:1] == b"\x78" and data[1:2] in (b"\x01", b"\x5e", b"\x9c", b"\xda"):
        return lambda: zlib.decompressobj(15)
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor
    if data[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor
    if data[:4] == b"\x28\xb5\x2f\xfd":
        return lambda: zstandard.ZstdDecompressor().decompressobj()
    return None


def _fed(d, data: bytes) -> Iterator[bytes]:
    """What a decompressor makes of data, about a megabyte at a time where it can be told so."""
    if isinstance(d, (bz2.BZ2Decompressor, lzma.LZMADecompressor)):
        yield d.decompress(data, 1 << 20)
        while not d.eof and not d.needs_input:
            yield d.decompress(b"", 1 << 20)
    elif hasattr(d, "copy"):  # zlib
        yield d.decompress(data, 1 << 20)
        while d.unconsumed_tail:
            yield d.decompress(d.unconsumed_tail, 1 << 20)
    else:
        yield d.decompress(data)


def _inflated(chunks: Iterator[bytes], opener) -> Iterator[bytes]:
    """What compressed chunks hold, in pieces; ends where they are broken."""
    d, rest = opener(), b""
    try:
        for chunk in chunks:
            data, rest, at = rest + chunk, b"", 0
            while at < len(data):
                if d is None:  # another member or frame, or what follows the data
                    if len(data) - at < LONGEST_MARK:
                        rest = data[at:]
                        break
                    if (opener := _opener(data[at : at + LONGEST_MARK])) is None:
                        return
                    d = opener()
                yield from filter(None, _fed(d, data[at : at + 512]))
                at = min(at + 512, len(data))
                if d.eof:
                    at, d = at - len(d.unused_data), None
    except (zlib.error, OSError, ValueError, EOFError, lzma.LZMAError, zstandard.ZstdError):
        return


def _windows(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The windows of what chunks hold, however often it is compressed; all of it when it isn't."""
    seen: set[bytes] = set()
    head = next(chunks, b"")
    while (opener := _opener(head)) is not None:
        stream = _inflated(itertools.chain((head,), chunks), opener)
        held = bytearray()
        for part in stream:
            held += part
            if len(held) > WINDOW:
                break
        else:
            head, chunks = bytes(held), iter(())
            mark = hashlib.blake2b(head, digest_size=16).digest()
            if not head or mark in seen:
                return
            seen.add(mark)
            continue
        # Too much for one window: the rest is streamed, through further layers of compression where there are any.
        stream = itertools.chain((bytes(held),), stream)
        while (opener := _opener(head := next(stream, b""))) is not None:
            stream = _inflated(itertools.chain((head,), stream), opener)
        held = bytearray(head)
        for part in stream:
            held += part
            if len(held) >= WINDOW:
                yield bytes(held)
                del held[:-OVERLAP]
        yield bytes(held)
        return
    yield b"".join((head, *chunks))


def _decoded(run: str, at: int = 0) -> Iterator[bytes]:
    """The bytes of a base64 run without padding from a place on, in growing chunks; a single sign at the end holds no byte."""
    size, end = 256, len(run) - ((len(run) - at) % 4 == 1)
    while at < end:
        part = run[at : min(at + size, end)]
        yield base64.b64decode(part + "=" * (-len(part) % 4))
        at, size = at + size, min(2 * size, 1 << 20)


def _texts(chunks: Iterator[bytes]) -> Iterator[str]:
    for data in _windows(chunks):
        try:
            yield data.decode()
        except UnicodeDecodeError:
            yield data.decode("latin-1")


def _telling(text: str) -> bool:
    """Whether a scan of text, or of what is encoded in it, can find something."""
    low = text.lower()
    return any(k in low for k in KEYS) or any(x in text for x in ("AKIA", "%", "\\")) or bool(HEX.search(text) or BASE64.search(text) or WIDE.search(text))


def _layers(text: str) -> Iterator[tuple[str, list[Layer], bool]]:
    """(decoded text, its places in text, whether it is scanned itself); a run that stands several times is decoded once."""
    runs: dict[str, list[tuple[int, int]]] = {}
    for m in BASE64.finditer(text):
        runs.setdefault(m[0], []).append(m.span())
    for run, places in runs.items():
        run = run.rstrip("=").translate(STANDARD)
        for inner in _texts(iter((b"".join(_decoded(run)),))):
            yield inner, [Layer("", [(0, s, e, 0)]) for s, e in places], True
        for k in range(1, 4):
            # One byte, one character, so that groups can be counted.
            inner = b"".join(_decoded(run, k)).decode("latin-1")
            if _telling(inner):
                yield inner, [Layer("", [(0, s + k, e, 4)]) for s, e in places], True
        for m in PACKED.finditer(run):
            if m.start() and _opener(next(_decoded(run[m.start() : m.start() + 12]), b"")):
                for inner in _texts(_decoded(run, m.start())):
                    yield inner, [Layer("", [(0, s + m.start(), e, 0)]) for s, e in places], True
    for m in WRAPPED.finditer(text) if "\n" in text else ():
        pieces, at = [], 0
        for line in re.finditer(r"[^\s]+", m[0]):
            pieces.append((at, m.start() + line.start(), m.start() + line.end(), 1))
            at += len(line[0])
        yield "".join(m[0].split()), [Layer("", pieces)], False
    for mark, groups, read in (("%", PERCENT, _percent), ("\\", BACKSLASH, _backslash), ("\0", WIDE, _wide)):
        if mark in text and (layer := _escaped(text, groups, read)):
            inner, layer.text = layer.text, ""
            yield inner, [layer], True


def _key(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def spans(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans) of a text."""
    text = text or ""
    base = scan(text)
    top = _key(text)
    found, work = {top: set(base)}, [(top, text)]
    above: dict[bytes, list[tuple[bytes, Layer]]] = {}
    while work:
        outer, text = work.pop()
        for inner, places, scanned in _layers(text):
            key = _key(inner) if scanned else b"joined" + _key(inner)
            if key not in found:
                found[key] = set(scan(inner)) if scanned else set()
                work.append((key, inner))
            above.setdefault(key, []).extend((outer, x) for x in places)
    # Finds go up to every place of their text, until no place gets a new one.
    fresh = {key: set(x) for key, x in found.items() if x and key in above}
    while fresh:
        key, new = fresh.popitem()
        for outer, layer in above[key]:
            got = {(s, kind, e) for start, kind, end in new for s, e in (layer.source(start, end),)} - found[outer]
            if got:
                found[outer] |= got
                if outer in above:
                    fresh.setdefault(outer, set()).update(got)
    return base, sorted(found[top])


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


SCHEMA = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _report(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for text in b:
            base, found = spans(text)
            n = [sum(k == kind for _, k, _ in base) for kind in range(3)]
            rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(found)))
        yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def _redact(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for b in batches:
        yield pd.Series([redacted(t) for t in b], dtype=object)


def redacted(text: str | None) -> str | None:
    """The text with every span, and what overlaps it, replaced by its kind in brackets."""
    if not text or not (found := spans(text)[1]):
        return text
    out, done, k = [], 0, 0
    while k < len(found):
        start, kind, end = found[k]
        k += 1
        while k < len(found) and found[k][0] < end:
            end = max(end, found[k][2])
            k += 1
        out += [text[done:start], f"[{KINDS[kind]}]"]
        done = end
    return "".join(out) + text[done:]


def secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, the counts of base spans, base_sha256 and spans."""
    return docs.select("doc_id", F.pandas_udf(_report, SCHEMA)(text).alias("r")).select("doc_id", "r.*")


def without_secrets(docs: DataFrame) -> DataFrame:
    """docs with its own columns, the spans in text replaced; n_chars follows where there is such a column."""
    out = docs.withColumn("text", F.pandas_udf(_redact, "string")("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op10_secret_scan(spark, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))

"""One left-to-right pass over a source text: symbols, calls, variables and comment/string spans.

Comments and strings are masked with blanks of equal length.  An automaton reads the tokens of the mask (`declarations.py`): it gives the
declarations with their ends, the calls (without patterns, attributes, enum constants and macros' arguments, which look alike) and the parameters.
A sweep with a stack finds the functions around each call and variable.  Any text goes through, in linear time.  What is approximated are Scala bodies without
braces (they end with their line), regular-expression literals of JavaScript (taken for division) and code inside
interpolated strings (part of the string).
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

from .declarations import Declarations, Found
from .tokens import CLOSES, Tokens

C_COMMENT = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
STRING = r'"(?:\\.|[^"\\\n])*"'
CHARS = r"'(?:\\.|[^'\\\n])*'"
TEMPLATE = r"`(?:\\.|[^`\\])*`"
TRIPLE = r'""".*?(?:"""|\Z)' + "|" + r"'''.*?(?:'''|\Z)"
SPANS = {
    "python": rf"#[^\n]*|[rRbBfFuU]{{0,2}}(?:{TRIPLE}|{STRING}|{CHARS})",
    "rust": rf'//[^\n]*|b?r(?P<h>#*)".*?"(?P=h)|b?{STRING[:-1]}"|b?\'(?:\\[^\n]{{1,10}}?|[^\'\\\n])\'',
    "typescript": rf"{C_COMMENT}|{STRING}|{CHARS}|{TEMPLATE}",
    "javascript": rf"{C_COMMENT}|{STRING}|{CHARS}|{TEMPLATE}",
    "go": rf"{C_COMMENT}|{STRING}|`[^`]*`|{CHARS}",
    "java": rf'{C_COMMENT}|""".*?(?:"""|\Z)|{STRING}|{CHARS}',
    "scala": rf'//[^\n]*|""".*?(?:"""|\Z)|{STRING}|\'(?:\\[^\n]{{1,6}}|[^\'\\\n])\'',
}
HOLDERS = ("class", "interface", "trait", "struct", "enum", "object", "impl")
NESTED = ("rust", "scala")  # block comments nest
SPAN = {k: re.compile(v, re.S) for k, v in SPANS.items()}
ID = r"(?:[^\W\d]|\$)[\w$]*"
#: Words that stand before a bracket without being called.
NOT_CALLS = {
    "python": frozenset("if elif else for while return and or not in is lambda with assert del yield await except import from as raise try def class".split()),
    "rust": frozenset("if for while match return fn in loop move as let mut ref else impl where unsafe async await dyn pub crate extern use type const static".split()),
    "go": frozenset("if for switch return func go defer select case range chan map interface struct else type var const import".split()),
    "java": frozenset("if for while switch catch return synchronized try throw else do assert super this case instanceof".split()),
    "scala": frozenset("if for while match case catch return yield else do throw try def class object trait extends with".split()),
    "javascript": frozenset("if for while switch catch return function typeof void delete instanceof in of await yield super import throw else do with async case".split()),
}
NOT_CALLS["typescript"] = NOT_CALLS["javascript"]
BIND = {
    "python": [
        rf"(?:^|;)[ \t]*(?P<n>[(\[]?\s*\*?{ID}(?:\s*,\s*[(\[]?\*?{ID}[)\]]?)*\s*,?\s*[)\]]?)\s*(?::[^=\n]+)?=(?!=)", rf"(?<![=!<>+*/%&|^@:-])=\s*(?P<n>{ID}(?:\s*,\s*{ID})*)\s*=(?!=)", rf"(?P<n>{ID})\s*:=", rf"\bfor\s+\(?(?P<n>{ID}(?:\s*,\s*{ID})*)\)?\s+in\b", rf"\bas\s+(?P<n>{ID})\s*[,:)]",
    ],
    "rust": [rf"\blet\s+(?:mut\s+)?(?:(?:{ID})?\()?(?P<n>(?:mut\s+)?{ID}(?:\s*,\s*(?:mut\s+)?{ID})*)\)?\s*(?::[^=;\n]+)?[=;]", rf"\bfor\s+\(?(?P<n>{ID}(?:\s*,\s*{ID})*)\)?\s+in\b", rf"\b(?:if|while)\s+let\s+(?:{ID}::)*{ID}\(\s*(?P<n>(?:ref\s+)?(?:mut\s+)?{ID}(?:\s*,\s*{ID})*)\s*\)", rf"\blet\s+(?:{ID}::)*{ID}\s*\{{\s*(?P<n>{ID}(?:\s*,\s*{ID})*)\s*(?:,\s*\.\.\s*)?\}}\s*="],
    "go": [rf"(?P<n>{ID}(?:\s*,\s*{ID})*)\s*:=", rf"\bvar\s+(?P<n>{ID}(?:\s*,\s*{ID})*)"],
    "java": [rf"(?:^[ \t]*|[;{{(]\s*)(?:final\s+)?(?!return\b|new\b|throw\b|else\b)[^\W\d][\w$.<>\[\],]*\s+(?P<n>{ID})\s*(?:=(?!=)|;|:)"],
    "scala": [rf"\b(?:val|var)\s+\(?(?P<n>{ID}(?:\s*,\s*{ID})*)"],
}
BINDINGS = {k: [re.compile(p, re.M) for p in v] for k, v in BIND.items()}
def code_spans(text: str, language: str) -> list[tuple[int, int]]:
    """Comments and strings as character ranges."""
    out, at, pattern = [], 0, SPAN[language]
    block = text.find("/*") if language in NESTED else -1
    while True:
        m = pattern.search(text, at)
        if 0 <= block < at:
            block = text.find("/*", at)
        if block >= 0 and (m is None or block < m.start()):
            depth, k = 1, block + 2
            while depth and k < len(text):
                o, c = text.find("/*", k), text.find("*/", k)
                if c < 0:
                    k = len(text)
                elif 0 <= o < c:
                    depth, k = depth + 1, o + 2
                else:
                    depth, k = depth - 1, c + 2
            out.append((block, k))
            at = k
        elif m is None:
            return out
        else:
            if m.end() > m.start():
                out.append((m.start(), m.end()))
            at = max(m.end(), m.start() + 1)


def _masked(text: str, spans: list[tuple[int, int]]) -> str:
    out, done = [], 0
    for s, e in spans:
        out += [text[done:s], "".join("\n" if c == "\n" else " " for c in text[s:e])]
        done = e
    return "".join(out) + text[done:]


def _python_end(t: Tokens, found: Found, mask: str, starts: list[int], indents: list[int], ends: list[int]) -> int:
    """A definition ends with its last deeper line (indents: -1 for lines without code), or with its line if its body follows the colon."""
    k = found.name + 1
    while k < t.n and t.text[k] not in (":", "\n") and t.text[k] not in CLOSES:
        k = t.after(k)
    line = bisect_right(starts, t.pos[min(k, t.n - 1)]) - 1
    own, end = t.pos[found.first] - starts[bisect_right(starts, t.pos[found.first]) - 1], ends[line]
    for n in range(line + 1, len(starts)):
        if indents[n] >= 0:
            if indents[n] <= own:
                break
            end = ends[n]
    return end


def _not_called(t: Tokens, found: Declarations) -> set[int]:
    """Names before a bracket that are no call: patterns, attributes, macros' arguments, enum constants, annotations, signatures."""
    out, edges, language, skip = set(found.built), [0] * (t.n + 1), found.language, 0

    def leave(first: int, end: int) -> None:
        if first < end:
            edges[min(first, t.n)] += 1
            edges[min(end, t.n)] -= 1

    def until(k: int, end: int, stops: tuple[str, ...]) -> int:
        while k < end and t.text[k] not in stops and t.text[k] not in CLOSES:
            k = t.after(k)
        return min(k, end)

    for i, x in enumerate(t.text):
        if language == "rust":
            if x == "#" and t.at(i + 1 + (t.at(i + 1) == "!")) == "[" or x == "!" and t.name(i - 1) and t.at(i + 1) in ("(", "[", "{") and i >= skip:
                k = i + 1 + (t.at(i + 1) == "!")
                leave(k, t.mate[k])
                skip = max(skip, t.mate[k])
            elif x == "let":
                leave(i + 1, until(i + 1, t.n, ("=", ";", "{", "let")))
            elif x == "match" and t.at(k := found.stop[min(i + 1, t.n)]) == "{":
                j, end = k + 1, min(t.mate[k], t.n)
                while j < end:
                    arrow = until(j, end, ("=>", "if"))
                    leave(j, arrow)
                    j = t.over_lines(until(arrow, end, ("=>",)) + 1)
                    j = t.after(j) if t.at(j) == "{" else until(j, end, (",",)) + 1
                    j += t.at(j) == ","
        elif x == "@" and language in ("java", "scala") and t.name(i + 1):
            k = i + 1
            while t.at(k + 1) == "." and t.name(k + 2):
                k += 2
            out.add(k)
        elif language == "scala" and x == "case" and t.at(i + 1) not in ("class", "object"):
            leave(i + 1, until(i + 1, t.n, ("=>", "if", "\n", "<-", "=", "case")))
    for brace, kind in found.bodies.items():
        if kind == "enum" and language in ("java", "rust") or kind == "interface" and language in ("go", "typescript"):
            k, end = brace + 1, min(t.mate[brace], t.n)
            while k < end and not (language == "java" and t.text[k] == ";"):
                out.add(k)
                k = t.after(k)
    depth = 0
    for i in range(t.n):
        depth += edges[i]
        if depth:
            out.add(i)
    return out


def _calls(t: Tokens, language: str, found: Declarations) -> list[int]:
    """The name tokens of calls."""
    names, no = {x.name for x in found.found if x.kind != "impl"}, _not_called(t, found)
    lines = language in ("rust", "java", "javascript", "typescript")
    script = language in ("javascript", "typescript")
    out = []
    for i, x in enumerate(t.text):
        if not t.name(i) or i in names or i in no:
            continue
        k = t.over_lines(i + 1) if lines else i + 1
        if language == "rust" and t.at(k) == "::" and t.at(k + 1) == "<" and k + 1 in t.angle:
            k = t.angle[k + 1] + 1
        elif language == "typescript" and t.at(k) == "<" and k in t.angle and t.pos[k] == t.end(i):
            k = t.angle[k] + 1
        elif language == "rust" and t.at(k) == "!" and t.at(k + 1) in ("(", "[", "{") and x not in NOT_CALLS[language]:
            out.append(i)
            continue
        if t.at(k) != "(":
            continue
        before = i - 1
        while before >= 0 and t.text[before] == "\n":
            before -= 1
        member = t.at(before) in (".", "::", "?.")
        if not member and (x in NOT_CALLS[language] or language == "rust" and x in ("Fn", "FnMut", "FnOnce")):
            continue
        if script:
            if x == "new" and not member:
                continue
            while t.at(before) == "." and t.name(before - 1):
                before -= 2
            if t.at(before) == "new":
                continue
        if language == "scala" and t.at(i - 1) in ("class", "object", "trait"):
            continue
        out.append(i)
    return out


def _bound_params(t: Tokens, found: Found, language: str) -> Iterator[int]:
    """The name tokens of parameters; none where the bracket never closes."""
    end = t.mate[found.params]
    if end >= t.n:
        return
    first = k = found.params + 1
    while k <= end:
        if k == end or t.text[k] == ",":
            stop = k
            if language != "java":
                stop = first
                while stop < k and t.text[stop] not in (":", "="):
                    stop = t.after(stop)
                stop = min(stop, k)
            words = [j for j in range(first, stop) if t.name(j) and t.text[j] not in ("mut", "ref", "final", "const")]
            head = t.at(t.over_lines(first))
            if language == "go":
                words = words[:1]
            elif head not in ("{", "["):
                words = words[-1:]
            yield from words
            first = k + 1
        k = t.after(k) if k < end else k + 1


def _script_bindings(t: Tokens) -> Iterator[int]:
    """The name tokens that const, let and var bind."""
    for i, x in enumerate(t.text):
        if x not in ("const", "let", "var") or t.at(i - 1) in (".", "?."):
            continue
        k = i + 1
        while True:
            if t.name(k) and t.text[k] not in ("enum", "const", "let", "var"):
                yield k
                k += 1
            elif t.at(k) in ("{", "[") and t.at(t.after(k)) in ("=", ":", "of", "in"):
                yield from (j for j in range(k + 1, min(t.mate[k], t.n)) if t.name(j) and t.at(j + 1) != ":")
                k = t.after(k)
            else:
                break
            while k < t.n and t.text[k] not in (",", ";") and t.text[k] not in CLOSES and not (t.text[k] == "\n" and t.at(k - 1) not in ("=", "=>", ",")):
                k = t.after(k)
            if t.at(k) != ",":
                break
            k = t.over_lines(k + 1)


def _further(t: Tokens, place: int) -> Iterator[int]:
    """The names of further declarators after the token at a place: int x = 1, y = 2."""
    k = bisect_right(t.pos, place)
    while k < t.n and t.text[k] != ";" and t.text[k] not in CLOSES and not (t.text[k] == "\n" and t.at(k - 1) != ","):
        if t.text[k] == "," and t.name(j := t.over_lines(k + 1)) and t.at(j + 1) in ("=", ",", ";", ":", "\n"):
            yield j
        k = t.after(k)


def _around(functions: list[tuple[int, int, int]], places: list[int], all_: bool) -> list[list[int]]:
    """The functions (start, end, number) around each place, outermost first, or the innermost alone; both lists in ascending order.  One sweep with a stack."""
    out, stack, k = [], [], 0
    for p in places:
        while k < len(functions) and functions[k][0] <= p:
            while stack and stack[-1][1] <= functions[k][0]:
                stack.pop()
            stack.append(functions[k])
            k += 1
        while stack and stack[-1][1] <= p:
            stack.pop()
        out.append([n for _, end, n in stack if end > p] if all_ else [n for _, _, n in stack[-1:]])
    return out


@dataclass
class Read:
    """What a text holds, in places and ranges of characters.

    symbols: range of the name, kind, start, end, first and last line, range of the signature, range of the parent's name (or None); calls: range of the callee,
    line, range of the line's text, number of the symbol around it (or -1); variables: range of the name, numbers of the symbols around it.
    """

    symbols: list[tuple]
    calls: list[tuple]
    variables: list[tuple]
    spans: list[tuple[int, int]]
    lines: list[int]
    names: list[str]  # of the symbols; of a name in a comment's place, or with one inside, they are not the range's text
    parents: list[str | None]
    by_column: bool = False  # ends hang on the column of a definition that does not begin its line


def _read(text: str, language: str) -> Read:
    starts = [0] + [m.end() for m in re.finditer("\n", text)]
    if language not in SPAN:
        return Read([], [], [], [], starts, [], [])
    spans = code_spans(text, language)
    mask = _masked(text, spans)
    out = Read([], [], [], spans, starts, [], [])

    def line(k: int) -> int:
        return bisect_right(starts, k)

    t = Tokens(mask)
    found = Declarations(t, language, len(mask.rstrip()))
    own = found.run()
    if language == "python":
        edges = [*starts[1:], len(mask) + 1]
        bodies = [mask[s : e - 1] for s, e in zip(starts, edges, strict=True)]
        indents = [len(x) - len(x.lstrip()) if x.strip() else -1 for x in bodies]
        ends = [s + len(x.rstrip()) for s, x in zip(starts, bodies, strict=True)]
        for x in own:
            x.end = _python_end(t, x, mask, starts, indents, ends)
            out.by_column = out.by_column or bool(mask[starts[line(t.pos[x.first]) - 1] : t.pos[x.first]].strip())
    functions = []
    around: list[tuple] = []  # what is open at a place, outermost first: kind, end, the nearest class or the like and its range
    for x in sorted(own, key=lambda x: (t.pos[x.first], -x.end)):
        start, end, kind, name = t.pos[x.first], x.end, x.kind, x.text or t.text[x.name]
        at = (t.end(x.name) - len(name), t.end(x.name))
        if kind == "impl":
            at = tuple(map(int, name.split(":")))
            name = mask[slice(*at)]
        while around and around[-1][1] <= start:
            around.pop()
        while around and around[-1][1] < end:  # only ends that cross, which no program has
            around.pop()
        innermost, parent, parent_at = (around[-1][0], *around[-1][2:]) if around else (None, None, None)
        holder = (name, at) if kind in HOLDERS else (parent, parent_at)
        if kind == "function" and language == "rust":
            kind, parent = ("method", parent) if innermost == "impl" else (kind, None if innermost == "trait" else parent)
        elif kind == "function" and parent is not None and language == "python" and innermost in HOLDERS:
            kind = "method"
        around.append((kind, end, *holder))
        if kind in ("object", "impl"):
            continue
        if kind in ("function", "method"):
            functions.append((start, end, len(out.symbols)))
        sign = text.find("\n", start, end)
        sign = end if sign < 0 else sign
        sign -= start < sign and text[sign - 1] == "\r"
        held = kind in ("function", "method") and parent is not None
        out.symbols.append((at, kind, start, end, line(start), line(max(start, end - 1)), (start, max(start, sign)), parent_at if held else None))
        out.names.append(name)
        out.parents.append(parent if held else None)
    sites, texts = _calls(t, language, found), {}
    for i, outer in zip(sites, _around(functions, [t.pos[i] for i in sites], False), strict=True):
        k = line(t.pos[i])
        if k not in texts:
            whole = text[starts[k - 1] : starts[k] - 1 if k < len(starts) else len(text)]
            first = starts[k - 1] + len(whole) - len(whole.lstrip())
            texts[k] = (first, first + len(whole.strip()))
        out.calls.append(((t.pos[i], t.end(i)), k, texts[k], outer[-1] if outer else -1))
    variables = {}
    for x in own:
        if x.params >= 0 and x.kind in ("function", "method"):
            variables.update((t.pos[i], t.text[i]) for i in _bound_params(t, x, language))
    if language in ("javascript", "typescript"):
        variables.update((t.pos[i], t.text[i]) for i in _script_bindings(t))
    for j, p in enumerate(BINDINGS.get(language, ())):
        for m in p.finditer(mask):
            if language == "python" and j < 2 and t.around[min(bisect_right(t.pos, m.start("n")) - 1, t.n - 1)] >= 0:
                continue  # a keyword argument
            for w in re.finditer(ID, m["n"]):
                if w[0] not in ("mut", "let", "var", "const", "ref"):
                    variables[m.start("n") + w.start()] = w[0]
            if language == "java":
                variables.update((t.pos[i], t.text[i]) for i in _further(t, m.end("n") - 1))
    places = sorted(variables)
    out.variables = [((k, k + len(variables[k])), outer) for k, outer in zip(places, _around(functions, places, True), strict=True)]
    return out


def code_facts(text: str, language: str) -> dict:
    """symbols, calls, variables, spans and line starts of a text; all positions are bytes."""
    r = _read(text, language)
    if text.isascii():
        def at(k: int) -> int:
            return k
    else:
        sizes = [0]
        for c in text:
            sizes.append(sizes[-1] + (1 if c < "\x80" else 2 if c < "ࠀ" else 3 if c < "\U00010000" else 4))
        at = sizes.__getitem__
    texts = {whole: text[slice(*whole)] for _, _, whole, _ in {x[1]: x for x in r.calls}.values()}  # one for a line, however many calls
    return {
        "symbols": [
            {"name": name, "kind": kind, "start_byte": at(start), "end_byte": at(end), "start_line": first, "end_line": last, "signature": text[slice(*sign)], "parent": parent}
            for (_, kind, start, end, first, last, sign, _), name, parent in zip(r.symbols, r.names, r.parents, strict=True)
        ],
        "calls": [{"callee": text[slice(*own)], "line": k, "text": texts[whole], "start_byte": at(own[0]), "caller": r.names[n] if n >= 0 else None} for own, k, whole, n in r.calls],
        "variables": [{"name": text[slice(*own)], "pos": at(own[0]), "within": [{"function": r.names[n], "start": at(r.symbols[n][2])} for n in outer]} for own, outer in r.variables],
        "spans": [{"start": at(s), "end": at(e)} for s, e in r.spans] if language in SPAN else None, "lines": [at(k) for k in r.lines],
    }

"""Declarations of seven languages, by an automaton over tokens.

It goes through the tokens once.  Where a statement may begin it reads annotations and modifiers, then a keyword (or a type or a
member's name) decides which declaration follows; brackets and angle brackets are passed by their mates, so the work is linear in the text
whatever it holds, and text that is no program gives fewer declarations, never an error.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from .tokens import CLOSES, Tokens

#: What may stand before a declaration, and the kinds that keywords declare.
MODIFIERS = {
    "python": frozenset(["async"]),
    "rust": frozenset("pub async unsafe extern const default crate".split()),
    "go": frozenset(),
    "java": frozenset("public private protected static final abstract default sealed non synchronized native strictfp transient volatile".split()),
    "scala": frozenset("private protected override final sealed abstract implicit lazy inline case open transparent infix".split()),
    "javascript": frozenset("export default async static get set".split()),
    "typescript": frozenset("export default declare async static get set public private protected readonly override abstract accessor const".split()),
}
KEYWORDS = {
    "python": {"class": "class", "def": "function"},
    "rust": {"fn": "function", "struct": "struct", "enum": "enum", "trait": "trait", "type": "type", "mod": "module", "const": "constant", "static": "constant", "impl": "impl"},
    "java": {"class": "class", "interface": "interface", "enum": "enum", "record": "record"},
    "scala": {"trait": "trait", "class": "class", "def": "function", "type": "type", "object": "object"},
    "javascript": {"class": "class", "function": "function"},
    "typescript": {"class": "class", "function": "function", "interface": "interface", "enum": "enum", "type": "type"},
}
#: Words that are no type of a Java method and no name of a script's method.
NO_TYPE = frozenset("return new else throw case assert do try finally import package if for while switch catch yield".split())
NO_METHOD = frozenset("if for while switch catch function return with new typeof await".split())
#: Wrappers that a declaration of a script stands in, without being part of it.
WRAPPERS = frozenset(["export", "default", "declare"])
LINE_ENDS = frozenset(["go", "scala", "javascript", "typescript"])


@dataclass
class Found:
    """A declaration: its name token, kind, first token, the place of its end and the bracket of its parameters (-1: none)."""

    name: int
    kind: str
    first: int
    end: int
    params: int = -1
    text: str | None = None


@dataclass
class Declarations:
    tokens: Tokens
    language: str
    last: int  # where the text ends, without white space
    found: list[Found] = field(default_factory=list)
    built: set[int] = field(default_factory=set)  # names of constructors and members without a body
    bodies: dict[int, str] = field(default_factory=dict)  # opening brace -> what it is the body of

    def run(self) -> list[Found]:
        t, lang = self.tokens, self.language
        self.stop = t.stops(lang in LINE_ENDS)
        i, begins = 0, True
        while i < t.n:
            x = t.text[i]
            if x == "\n" or x in ";{}":
                begins, i = True, i + 1
            elif begins or x == "object" and lang == "scala":
                begins, i = False, max(i + 1, self._statement(i))
                if i <= t.n and t.at(i - 1) in (";", "{", "}", "\n"):
                    begins = True
            else:
                i += 1
        return self.found

    def _prefix(self, i: int) -> tuple[int, int]:
        """(first token of the declaration, token after annotations and modifiers)."""
        t, lang = self.tokens, self.language
        first = None
        while True:
            if t.at(i) == "@" and lang in ("java", "scala", "javascript", "typescript") and t.at(i + 1) != "interface" and t.name(i + 1):
                if lang in ("java", "scala") and first is None:
                    first = i
                i += 2
                while t.at(i) == "." and t.name(i + 1):
                    i += 2
                if t.at(i) == "(":
                    i = t.after(i)
                i = t.over_lines(i)
            elif t.at(i) == "#" and lang == "rust" and t.at(i + 1 + (t.at(i + 1) == "!")) == "[":
                i = t.over_lines(t.after(i + 1 + (t.at(i + 1) == "!")))
            elif t.at(i) == "case" and lang == "scala" and t.at(i + 1) not in ("class", "object"):
                return i, i
            elif t.at(i) in MODIFIERS[lang] and (t.name(k := t.over_lines(i + 1)) or t.at(k) in ("@", "*", "#", "[", "<", '"') or lang in ("rust", "scala") and t.at(i + 1) in ("(", "[")):
                if lang == "rust" and t.at(i) == "const" and t.at(i + 1) not in ("fn", "unsafe", "async", "extern"):
                    break
                if lang == "typescript" and t.at(i) == "const" and t.at(i + 1) != "enum":
                    break
                if first is None and t.at(i) not in WRAPPERS:
                    first = i
                i = t.after(i + 1) if lang in ("rust", "scala") and t.at(i + 1) in ("(", "[") else k
            elif t.at(i) == "-" and t.at(i - 1) == "non" and t.at(i + 1) == "sealed":
                i += 2
            else:
                break
        return i if first is None else first, i

    def _generics(self, i: int) -> int:
        """After type parameters, if any begin here."""
        t = self.tokens
        return t.angle[i] + 1 if t.at(i) == "<" and i in t.angle else t.after(i) if t.at(i) == "[" and self.language in ("go", "scala", "python") else i

    def _close(self, i: int, kind: str) -> int:
        """The place where a declaration ends whose header goes on at token i; its body is kept.  A header that leads to no end is all there is."""
        t = self.tokens
        k = self.stop[min(i, t.n)]
        if k >= t.n:
            return self.last if self.language in LINE_ENDS else t.end(min(i, t.n) - 1)
        if t.text[k] == "\n":
            brace = t.over_lines(k)
            if t.at(brace) != "{":
                return t.end(k - 1) if k else 0
            k = brace
        if t.text[k] == "{":
            self.bodies[k] = kind
            return self.last if t.mate[k] >= t.n else t.end(t.mate[k])
        return t.end(k) if t.text[k] == ";" else t.end(k - 1)

    def _add(self, name: int, kind: str, first: int, end: int, params: int = -1, text: str | None = None) -> None:
        self.found.append(Found(name, kind, first, end, params, text))

    def _statement(self, i: int) -> int:
        """Reads what may be a declaration at token i; the token to go on with."""
        t, lang = self.tokens, self.language
        if lang == "go":
            return self._go(i)
        first, k = self._prefix(i)
        if lang == "java" and t.at(k) == "@" and t.at(k + 1) == "interface":
            k += 1
        kind, name = KEYWORDS[lang].get(t.at(k)), k + 1
        if kind and lang == "rust":
            return self._rust(first, k, kind)
        if kind == "function" and t.at(name) == "*":
            name += 1
        if kind and t.name(name) and not (kind == "type" and t.at(name + 1) not in ("=", "<", "[", "\n", ">") and lang == "typescript"):
            if kind == "function":
                after = self._generics(name + 1)
                self._add(name, kind, first, self._close(after, kind), after if t.at(after) == "(" else -1)
                return after
            if kind == "record":
                self.built.add(name)
                return max(name + 1, self.stop_of_body(name + 1, "record"))
            self._add(name, kind, first, self._close(name + 1, kind))
            return name + 1
        if lang == "java":
            return self._java(first, k)
        if lang in ("javascript", "typescript"):
            if t.at(k) in ("const", "let", "var"):
                return self._script_values(first, k)
            return self._script_method(first, k)
        return k

    def stop_of_body(self, i: int, kind: str) -> int:
        self._close(i, kind)
        return i

    def _rust(self, first: int, k: int, kind: str) -> int:
        t, name = self.tokens, k + 1
        if kind == "impl":
            i = start = self._generics(k + 1)
            stop = self.stop[min(i, t.n)]
            while i < stop:
                if t.text[i] == "for":
                    start = i + 1
                if t.text[i] == "where":
                    break
                i = t.after(i)
            start = t.over_lines(start)
            if start < min(i, t.n):
                last = min(i, t.n) - 1
                while last > start and t.text[last] == "\n":
                    last -= 1
                self._add(start, "impl", first, self._close(stop, "impl"), text=f"{t.pos[start]}:{t.end(last)}")
            return max(stop, k + 1)
        if t.at(name) == "mut":
            name += 1
        if not t.name(name) or kind == "constant" and t.at(name + 1) != ":":
            return k + 1
        if kind == "function":
            after = self._generics(name + 1)
            end = self._close(after, kind)
            stop = self.stop[min(after, t.n)]
            if t.at(stop) == ";":
                self.built.add(name)  # a signature without a body
            else:
                self._add(name, kind, first, end, after if t.at(after) == "(" else -1)
            return after
        self._add(name, kind, first, self._close(name + 1, kind))
        return name + 1

    def _java(self, first: int, k: int) -> int:
        t = self.tokens
        i = self._generics(k)
        if not t.name(i) or t.at(i) in NO_TYPE:
            return max(k, i)
        if t.at(i + 1) == "(":  # a constructor or a call
            after = t.over_lines(t.after(i + 1))
            if self._throws(after) and t.at(self._throws(after)) == "{":
                self.built.add(i)
            return i + 1
        while True:
            while t.at(i + 1) == "." and t.name(i + 2):
                i += 2
            i = self._generics(i + 1)
            if t.at(i) != ".":
                break
            i += 1
        while t.at(i) == "[" and t.at(i + 1) == "]":
            i += 2
        i = t.over_lines(i)
        if t.name(i) and t.at(i + 1) == "(" and t.at(i) not in NO_TYPE:
            after = t.over_lines(t.after(i + 1))
            while t.at(after) == "[":
                after = t.after(after)
            stop = self._throws(after)
            if t.at(stop) in ("{", ";", "default"):
                self._add(i, "method", first, self._close(stop, "method"), i + 1)
                return after
        return max(k, i)

    def _throws(self, i: int) -> int:
        t = self.tokens
        if t.at(i) == "throws":
            while i < t.n and (t.name(i) or t.text[i] in (",", ".", "\n")):
                i += 1
        return i

    def _script_values(self, first: int, k: int) -> int:
        """const f = (a) => ..., g = async b => ...: each function is a constant, from the keyword to the statement's end."""
        t, i, names = self.tokens, k + 1, []
        while t.name(i):
            name, i = i, i + 1
            while i < t.n and t.text[i] not in ("=", ",", ";", "\n") and t.text[i] not in CLOSES:
                i = t.after(i)
            if t.at(i) == "=":
                v = t.over_lines(i + 1)
                v += t.at(v) == "async"
                v = self._generics(v)
                arrow = t.after(v) if t.at(v) == "(" else v + 1
                if t.at(arrow) == ":":
                    while arrow < t.n and t.text[arrow] not in ("=>", ";", "\n", ",") and t.text[arrow] not in CLOSES:
                        arrow = t.after(arrow)
                if t.at(arrow) == "=>" and (t.at(v) == "(" or t.name(v)):
                    names.append((name, v if t.at(v) == "(" else -1))
                i = v if t.at(v) == "(" else arrow if t.at(arrow) == "=>" else v
                while i < t.n and t.text[i] not in (",", ";") and t.text[i] not in CLOSES and not (t.text[i] == "\n" and t.at(i - 1) not in ("=>", "=", ",")):
                    i = t.after(i)
            if t.at(i) != ",":
                break
            i = t.over_lines(i + 1)
        if names:
            end = t.end(i) if t.at(i) == ";" else t.end(i - 1)
            for name, params in names:
                self._add(name, "constant", first, end, params)
                body = t.after(params) if params >= 0 else name
                while body < i and t.text[body] != "{":
                    body += 1
        return k + 1

    def _script_method(self, first: int, k: int) -> int:
        t, i = self.tokens, k
        if t.at(i) == "*":
            i += 1
        private = t.at(i) == "#" and t.name(i + 1)
        i += private
        if not t.name(i) or t.at(i) in NO_METHOD:
            return max(k, i)
        after = self._generics(i + 1)
        if t.at(after) != "(":
            return i + 1
        stop = t.after(after)
        if t.at(stop) == ":":
            while stop < t.n and t.text[stop] not in ("{", ";", "\n", ",", "=") and t.text[stop] not in CLOSES or t.at(stop) == "{" and t.at(stop - 1) in (":", "|", "&"):
                stop = t.after(stop)
        if t.at(stop) == "{" and (t.around[i] >= 0 or private):
            self._add(i, "method", first, self._close(stop, "method"), after, "#" + t.text[i] if private else None)
            return after
        if self.bodies.get(t.around[i]) in ("class", "interface"):
            self.built.add(i)  # a signature
        return i + 1

    def _go(self, i: int) -> int:
        t, x = self.tokens, self.tokens.text[i]
        if t.around[i] >= 0:
            return i + 1
        if x == "func":
            kind, name = ("method", t.after(i + 1)) if t.at(i + 1) == "(" else ("function", i + 1)
            if t.name(name):
                after = self._generics(name + 1)
                self._add(name, kind, i, self._close(after, kind), after if t.at(after) == "(" else -1)
                return after
        elif x in ("type", "const", "var"):
            if t.at(i + 1) == "(":
                k, end = i + 2, min(t.mate[i + 1], t.n)
                while k < end:
                    k = t.over_lines(k)
                    if k < end:
                        stop = k
                        while stop < end and t.text[stop] not in ("\n", ";"):
                            stop = t.after(stop)
                        self._go_names(k, k, x, t.end(min(stop, end) - 1))
                        k = max(stop, k) + 1
                return max(i + 2, end)
            self._go_names(i + 1, i, x, None)
            return i + 2
        return i + 1

    def _go_names(self, k: int, first: int, what: str, end: int | None) -> None:
        """Names at token k: one of a type, or several of constants and variables."""
        t = self.tokens
        while t.name(k):
            after = k + 1
            if what == "type":
                if t.at(after) == "[" and t.at(t.after(after)) in ("struct", "interface"):
                    after = t.after(after)
                kind = t.at(after) if t.at(after) in ("struct", "interface") else "type"
                brace = after + 1
                if kind != "type" and t.at(brace) == "{":
                    self.bodies[brace] = kind
            else:
                kind = "constant"
            self._add(k, kind, first if end is None else k, self._close(after, kind) if end is None else end)
            if what == "type" or t.at(after) != ",":
                break
            k, first = after + 1, (first if end is None else after + 1)

"""The tokens of a masked source text, with what their brackets and angle brackets match; each in one pass."""

from __future__ import annotations

import re

TOKEN = re.compile(r"\n|[^\W\d][\w$]*|\$[\w$]*|\d[\w.]*|::|=>|->|<-|:=|[=!<>]=|\.\.[.=]?|&&|\|\||\?\.|<<|[^\s]")
NAME = re.compile(r"[^\W\d][\w$]*|\$[\w$]*")
CLOSES = {")": "(", "]": "[", "}": "{"}


class Tokens:
    """text, pos: the tokens (line ends are tokens, blanks are none).  mate: the matching bracket of each opening one, or the number of tokens;
    -1 for what opens nothing.  around: the innermost open bracket of each token, or -1.  angle: where a `<` closes, if it may be of a type."""

    def __init__(self, mask: str):
        self.text, self.pos = [], []
        for m in TOKEN.finditer(mask):
            self.text.append(m[0])
            self.pos.append(m.start())
        n = self.n = len(self.text)
        self.mate, self.around, self.angle = [-1] * n, [-1] * n, {}
        open_: list[int] = []
        angles: list[list[int]] = [[]]
        for i, t in enumerate(self.text):
            self.around[i] = open_[-1] if open_ else -1
            if t in "([{":
                self.mate[i] = n
                open_.append(i)
                if t == "{":
                    angles[-1].clear()
                angles.append([])
            elif t in CLOSES:
                # A bracket that matches nothing is passed over; one that matches an outer bracket closes what is open inside.
                if any(self.text[k] == CLOSES[t] for k in open_[-8:]):
                    while self.text[open_[-1]] != CLOSES[t]:
                        open_.pop()
                        angles.pop()
                    self.around[i] = open_[-2] if len(open_) > 1 else -1
                    self.mate[open_.pop()] = i
                    angles.pop()
                if t == "}":
                    angles[-1].clear()
            elif t == ";":
                angles[-1].clear()
            elif t == "<":
                angles[-1].append(i)
            elif t == ">" and angles[-1]:
                self.angle[angles[-1].pop()] = i

    def at(self, i: int) -> str:
        return self.text[i] if 0 <= i < self.n else ""

    def name(self, i: int) -> bool:
        return 0 <= i < self.n and NAME.fullmatch(self.text[i]) is not None

    def end(self, i: int) -> int:
        """After token i."""
        return self.pos[i] + len(self.text[i])

    def over_lines(self, i: int) -> int:
        while i < self.n and self.text[i] == "\n":
            i += 1
        return i

    def after(self, i: int) -> int:
        """The token after a bracket, an angle bracket or a token."""
        return self.mate[i] + 1 if self.mate[i] >= 0 else self.angle[i] + 1 if i in self.angle else i + 1

    def stops(self, line_ends: bool, opening: str = "{") -> list[int]:
        """For each token the first one at its level, from itself on, that is `{`, `;`, a closing bracket or, if line_ends, a line end
        after which no `opening` follows."""
        out = [self.n] * (self.n + 2)
        for i in range(self.n - 1, -1, -1):
            t = self.text[i]
            if t == "{" or t == ";" or t in CLOSES or t == "\n" and line_ends and self.at(self.over_lines(i)) != opening:
                out[i] = i
            else:
                out[i] = out[min(self.mate[i] + 1 if self.mate[i] >= 0 else i + 1, self.n)]
        return out

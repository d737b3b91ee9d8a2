"""Tokens of a script: names (accents folded), numbers, strings, marks; // comments."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from lumbre.errors import EngineError

_TOKEN = re.compile(
    r"""(?P<space>[ \t\r\n]+|//[^\n]*)
      | (?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|\.\d+)
      | (?P<name>[^\W\d]\w*)
      | (?P<string>"(?:[^"\\]|\\.)*")
      | (?P<mark>==|!=|>=|<=|[-+*/<>=(){}\[\],;.\#?])""",
    re.VERBOSE | re.DOTALL,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "\\": "\\"}


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    line: int
    column: int


def folded(name: str) -> str:
    """Without accents, so that función and funcion are one keyword."""
    return "".join(c for c in unicodedata.normalize("NFD", name) if not unicodedata.combining(c))


def tokens_of(text: str) -> list[Token]:
    out, at, line, start = [], 0, 1, 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise EngineError("PARSE", f"unexpected {text[at]!r}", line, at - start + 1)
        kind, raw = m.lastgroup, m[0]
        if kind == "string":
            raw_text = re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[0]), raw[1:-1])
            out.append(Token(kind, raw_text, line, at - start + 1))
        elif kind != "space":
            out.append(Token(kind, raw, line, at - start + 1))
        if "\n" in raw:
            line += raw.count("\n")
            start = at + raw.rindex("\n") + 1
        at = m.end()
    out.append(Token("end", "", line, at - start + 1))
    return out

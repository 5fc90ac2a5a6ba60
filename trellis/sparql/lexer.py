"""Tokens of SPARQL and Turtle."""

from __future__ import annotations

import re
from dataclasses import dataclass

from trellis.errors import QuerySyntaxError

_TOKEN = re.compile(
    r"""
    (?P<space>[\s]+|\#[^\n]*)
  | (?P<iri><[^<>"{}|^`\\\x00-\x20]*>)
  | (?P<string>\"\"\"(?:[^"\\]|\\.|"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
  | (?P<var>[?$]\w+)
  | (?P<blank>_:[\w][\w.\-]*)
  | (?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
  | (?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)|\d+\.\d+|\.\d+|\d+)
  | (?P<name>(?:[^\W\d][\w\-]*(?:\.[\w\-]+)*)?:(?:[\w:%\\][\w\-:%\\]*(?:\.[\w\-:%\\]+)*)?)
  | (?P<word>[^\W\d]\w*)
  | (?P<op>\^\^|&&|\|\||!=|<=|>=|[-=<>!+*/|^?(){}\[\],;.])
    """,
    re.X | re.S,
)
_ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int

    @property
    def upper(self) -> str:
        return self.text.upper()


def unquote(text: str) -> str:
    """The value of a quoted string."""
    body = text[3:-3] if text[:3] in ('"""', "'''") else text[1:-1]
    if "\\" not in body:
        return body
    return re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _ESCAPES.get(m[3], m[3]), body, flags=re.S)


def tokens(text: str) -> list[Token]:
    found, at = [], 0
    while at < len(text):
        hit = _TOKEN.match(text, at)
        if hit is None:
            line = text.count("\n", 0, at) + 1
            raise QuerySyntaxError(f"line {line}: unexpected {text[at : at + 10]!r}")
        if hit.lastgroup != "space":
            found.append(Token(hit.lastgroup, hit[0], at))
        at = hit.end()
    return found

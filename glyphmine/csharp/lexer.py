"""Tokens of C# source; comments, white space and preprocessor lines are left out."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import dataclass

_TOKEN = re.compile(
    r"""\s*(?:(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))
      | (?P<raw>\$*\"{3,})
      | (?P<inter>\$@\"|@\$\"|\$\")
      | (?P<verb>@\"(?:[^\"]|\"\")*(?:\"|\Z))
      | (?P<str>\"(?:[^\"\\\n]|\\.)*(?:\"(?:u8)?|(?=\n)|\Z))
      | (?P<char>'(?:[^'\\\n]|\\[^\n][0-9a-fA-F]*)')
      | (?P<num>0[xX][0-9a-fA-F_]+[uUlL]*|0[bB][01_]+[uUlL]*|(?:\d[\d_]*\.?\d[\d_]*|\d+|\.\d[\d_]*)(?:[eE][+-]?\d+)?[fFdDmMuUlL]*)
      | (?P<id>@?[^\W\d]\w*)
      | (?P<op>\?\?=|<<=|=>|\?\?|\?\.|::|\+\+|--|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|->|<<|\.\.|[{}()\[\];:,.?<>+\-*/%&|^!~=@\#$\\`]))
    """,
    re.S | re.X,
)


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    start: int
    end: int
    holes: Sequence[tuple[int, int]] = ()


def _interpolated(code: str, at: int, verbatim: bool) -> tuple[int, list[tuple[int, int]]]:
    """End of an interpolated string whose body begins at at, and its holes."""
    holes, n = [], len(code)
    while at < n:
        c = code[at]
        if c == '"':
            if verbatim and code.startswith('""', at):
                at += 2
                continue
            return at + 1, holes
        if c == "\\" and not verbatim:
            at += 2
        elif c == "\n" and not verbatim:
            return at, holes
        elif c == "{" and code.startswith("{{", at):
            at += 2
        elif c == "{":
            depth, begin = 1, at + 1
            at += 1
            while at < n and depth:
                c = code[at]
                if c in "{[(":
                    depth += 1
                elif c in "}])":
                    depth -= 1
                elif c == '"':
                    at = _string_end(code, at)
                    continue
                elif c == "\n" and not verbatim:
                    break
                at += 1
            holes.append((begin, at - 1))
        else:
            at += 1
    return n, holes


def _string_end(code: str, at: int) -> int:
    at += 1
    while at < len(code) and code[at] not in '"\n':
        at += 2 if code[at] == "\\" else 1
    return at + 1


class Source:
    """The tokens of a text, with lines and columns by offset."""

    def __init__(self, code: str):
        self.code = code
        self.errors: list[str] = []
        self.lines = [0, *(m.end() for m in re.finditer("\n", code))]
        self.tokens = self.scan(0, len(code))

    def line(self, offset: int) -> int:
        return bisect_right(self.lines, offset)

    def column(self, offset: int) -> int:
        return offset - self.lines[self.line(offset) - 1]

    def scan(self, at: int, end: int) -> list[Token]:
        code, out, match = self.code, [], _TOKEN.match
        while at < end:
            m = match(code, at, end)
            if not m:
                self.errors.append(code[at])
                at += 1
                continue
            kind = m.lastgroup
            begin, stop = m.span(kind)
            at = stop
            if kind == "skip":
                continue
            text = m.group(kind)
            if kind == "raw":
                quotes = text.lstrip("$")
                at = code.find(quotes, stop)
                at = len(code) if at < 0 else at + len(quotes)
                out.append(Token("raw", code[begin:at], begin, at))
            elif kind == "inter":
                at, holes = _interpolated(code, stop, "@" in text)
                out.append(Token("inter", code[begin:at], begin, at, holes))
            elif text == "#" and code[code.rfind("\n", 0, begin) + 1 : begin].strip() == "":
                at = code.find("\n", begin)
                at = end if at < 0 else at
            else:
                out.append(Token(kind, text, begin, stop))
        return out


_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "a": "\a", "b": "\b", "f": "\f", "v": "\v"}


def _unescape(body: str) -> str:
    def one(m: re.Match) -> str:
        x = m.group(1)
        if x[0] in "uUx" and len(x) > 1:
            return chr(int(x[1:], 16)) if int(x[1:], 16) < 0x110000 else "�"
        return _ESCAPES.get(x, x)

    return re.sub(r"\\(u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|x[0-9a-fA-F]{1,4}|.)", one, body, flags=re.S)


def string_value(token: Token) -> str | None:
    """The value of a string token; an interpolated string keeps its raw body."""
    text = token.text
    if token.kind == "str":
        text = text.removesuffix("u8") if text.endswith('"u8') else text
        return _unescape(text[1:-1]) if len(text) > 1 and text.endswith('"') else None
    if token.kind == "verb":
        return text[2:-1].replace('""', '"') if text.endswith('"') else text[2:].replace('""', '"')
    if token.kind == "inter":
        body = text[text.index('"') + 1 :]
        return body.removesuffix('"')
    if token.kind == "raw":
        return text.lstrip("$").strip('"').strip("\n")
    return None

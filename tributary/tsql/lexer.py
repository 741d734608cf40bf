"""T-SQL tokens with offsets and lines."""

from __future__ import annotations

import re
from dataclasses import dataclass

TOKEN = re.compile(
    r"""(?P<ws>\s+|--[^\n]*)
  | (?P<str>N?'(?:[^']|'')*')
  | (?P<br>\[(?:[^\]]|\]\])*\])
  | (?P<dq>"(?:[^"]|"")*")
  | (?P<var>@@?[\w@$#]+)
  | (?P<num>0x[0-9a-fA-F]*|\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)
  | (?P<id>[^\W\d][\w@$#]*|[#$][\w@$#]+|\#\#[\w@$#]+)
  | (?P<op>\*=|=\*|\+=|-=|/=|%=|&=|\|=|\^=|<>|<=|>=|!=|!<|!>|::|\|\||[-+*/%&|^~=<>().,;:?{}\\!$])""",
    re.X,
)


class ParseError(Exception):
    def __init__(self, message: str, at: int):
        super().__init__(message)
        self.at = at


@dataclass(slots=True)
class Token:
    kind: str  # id, qid, str, num, var, op, end
    text: str  # without quotes
    start: int
    end: int
    line: int
    up: str = ""  # upper case of bare words and operators


def tokenize(sql: str, quoted_identifiers: bool = True) -> list[Token]:
    out: list[Token] = []
    at, line, n = 0, 1, len(sql)
    while at < n:
        if sql.startswith("/*", at):  # comments nest
            depth, i = 1, at + 2
            while i < n and depth:
                if sql.startswith("/*", i):
                    depth, i = depth + 1, i + 2
                elif sql.startswith("*/", i):
                    depth, i = depth - 1, i + 2
                else:
                    i += 1
            line += sql.count("\n", at, i)
            at = i
            continue
        m = TOKEN.match(sql, at)
        if not m:
            raise ParseError(f"unexpected {sql[at]!r}", at)
        kind, text = m.lastgroup, m.group()
        if kind == "str":
            out.append(Token("str", text[text.index("'") + 1 : -1].replace("''", "'"), at, m.end(), line))
        elif kind == "br":
            out.append(Token("qid", text[1:-1].replace("]]", "]"), at, m.end(), line))
        elif kind == "dq":
            out.append(Token("qid" if quoted_identifiers else "str", text[1:-1].replace('""', '"'), at, m.end(), line))
        elif kind != "ws":
            out.append(Token(kind, text, at, m.end(), line, text.upper()))
        line += text.count("\n")
        at = m.end()
    out.append(Token("end", "", n, n, line))
    return out

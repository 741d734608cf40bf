"""Names: equality without case, multi-part identifiers, canonical archive databases."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=1 << 16)
def fold(name: str | None) -> str:
    """Key of a name: case folded, dotless and dotted I alike."""
    return (name or "").replace("ı", "i").replace("İ", "i").upper()


def fold_column(col: Column) -> Column:
    return F.upper(F.translate(F.coalesce(col, F.lit("")), "ıİ", "ii"))


def node_key(*cols: Column) -> Column:
    return F.concat_ws("\x1f", *[fold_column(c) for c in cols])


def split_name(text: str) -> list[str]:
    """Parts of a dotted name; brackets and double quotes protect dots and are dropped."""
    parts, cur, close, i = [], "", "", 0
    while i < len(text):
        c = text[i]
        if close:
            if c == close:
                if text[i + 1 : i + 2] == close:
                    cur += c
                    i += 1
                else:
                    close = ""
            else:
                cur += c
        elif c in '["' and not cur.strip():
            close, cur = ("]" if c == "[" else '"'), ""
        elif c == ".":
            parts.append(cur.strip())
            cur = ""
        else:
            cur += c
        i += 1
    return [*parts, cur.strip()]


def canonical_database(name: str, patterns: list[str]) -> str:
    """The live database of an archive: the first group of the first pattern that matches."""
    for p in patterns:
        if m := re.match(p, name, re.I):
            return m.group(1)
    return name


def parse_address(text: str, databases: set[str]) -> dict[str, str | None]:
    """A node address of two to five parts: ``[server.][db.]schema.object[.column]``.

    Four parts begin with a server if the second is a known database and the first isn't. Three parts are
    ``db.schema.object``, unless databases are known and the first part is none: then ``schema.object.column``.
    """
    p = split_name(text)
    known = {fold(d) for d in databases}
    keys = ("server", "database", "schema", "object", "column")
    if len(p) == 5:
        vals = p
    elif len(p) == 4:
        vals = [*p, None] if fold(p[1]) in known and fold(p[0]) not in known else [None, *p]
    elif len(p) == 3:
        vals = [None, *p, None] if fold(p[0]) in known or not known else [None, None, *p]
    elif len(p) == 2:
        vals = [None, None, *p, None]
    else:
        raise ValueError(f"not a node address: {text}")
    return dict(zip(keys, vals, strict=True))

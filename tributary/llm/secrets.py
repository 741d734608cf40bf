"""Secret scans with multipart credential linking.

Base spans: assignments to secret-like names, access identifiers, long hexadecimal strings. Beyond these, weak
candidates (account names, endpoints, high-entropy strings) are found, and all parts are joined with the scopes whose
interval holds them. Scopes are paragraphs, whatever their length. A weak candidate is reported only where
complementary parts stand in its scope: a high-entropy string needs an identifier or endpoint, an identifier needs a
secret, an endpoint needs both. High-entropy strings that overlap another part are that part, not one of their own.

Null texts count as empty; an empty text has no spans and the digest of the empty string. Repeated rows are
scanned alike, an empty table gives an empty result, other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import map_columns

KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
IDENTIFIER = re.compile(r"""(?:client_?id|access_?key_?id|user(?:name)?|login|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})""", re.I | re.A)
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"[a-z][a-z0-9+.-]{1,20}://[^\s\"'<>]+")
NAMES = ("passw", "secret", "token", "apikey", "api_key")
ENTROPY = 3.5


def base(text: str, low: str) -> list[tuple[int, str, int]]:
    """Base spans ``(start, kind, end)``."""
    out = []
    if any(n in low for n in NAMES):
        out += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    # A maximal run is what the greedy pattern takes; runs below 16 are dropped.
    return out + [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]


def entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def paragraphs(text: str) -> list[int]:
    """Ends of the paragraphs of a text, in order."""
    return [m.end() for m in re.finditer(r"\n[ \t\r]*\n", text)]


def weak(text: str, low: str, strong: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """Weak candidates that complementary parts support."""
    found = [(m.start(), "endpoint", m.end()) for m in ENDPOINT.finditer(text)] if "://" in text else []
    if any(n in low for n in ("id", "user", "login", "account")):
        found += [(m.start(), "identifier", m.end()) for m in IDENTIFIER.finditer(text)]
    if not found and not any(k == "access" for _, k, _ in strong):
        return []
    busy = sorted((s, e) for s, _, e in strong + found)
    reach = list(itertools.accumulate((e for _, e in busy), max))  # furthest end of the parts up to each
    for m in OPAQUE.finditer(text):
        s = m.group()
        if any(c.isdigit() for c in s) and any(c.isalpha() for c in s) and entropy(s) >= ENTROPY:
            i = bisect.bisect_left(busy, (m.end(), -1))
            if not i or reach[i - 1] <= m.start():
                found.append((m.start(), "secret", m.end()))
    # Interval join of parts with scopes: a part holds no blank line, so it lies in the scope it starts in.
    ends = paragraphs(text)
    scope = lambda p: bisect.bisect_right(ends, p[0])
    has_id, has_secret, has_endpoint = ({scope(p) for p in strong + found if p[1] in kinds} for kinds in (("access", "identifier"), ("assign", "hex", "secret"), ("endpoint",)))
    needs = {"secret": has_id | has_endpoint, "identifier": has_secret, "endpoint": has_id & has_secret}
    return [p for p in found if scope(p) in needs[p[1]]]


def spans(text: str | None) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """Base spans and all spans, each by start and then kind."""
    text = text or ""
    low = text.lower()
    order = lambda p: (p[0], KINDS.index(p[1]), p[2])
    strong = sorted(base(text, low), key=order)
    return strong, sorted(strong + weak(text, low, strong), key=order)


def written(found: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in found)


def scan(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans)`` for every row."""

    def make():
        def run(ids, texts):
            out: dict = {k: [] for k in ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")}
            out["doc_id"] = ids
            for t in texts:
                strong, every = spans(t)
                kinds = Counter(k for _, k, _ in strong)
                for k in ("assign", "access", "hex"):
                    out[f"n_{k}"].append(kinds[k])
                out["base_sha256"].append(hashlib.sha256(written(strong).encode()).hexdigest())
                out["spans"].append(written(every))
            return out

        return run

    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    return map_columns(rows, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string", make)

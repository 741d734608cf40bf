"""Keyed permutations of numbers and of strings over alphabets, in time linear in their length.

``permute`` handles ranges of numbers below 2**64. Strings are permuted piecewise: a string over given alphabets is a
mixed-radix number; short ones (up to ``SMALL`` values) are permuted as such, longer ones by an unbalanced Feistel
network over their digits: each round adds, digit by digit and modulo each digit's own alphabet, a keyed stream made
from all digits of the other half. Every digit of the result depends on every digit of the original, there is no
length limit, and a string is never turned into one large number.

No permutation has a fixed point where its range has more than one value: each is a step by one between a keyed
permutation and its inverse, and a step moves every value.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

SMALL, ROUNDS = 1 << 16, 8


def _hash(key: bytes, tweak: str, data: bytes, size: int) -> bytes:
    """``size`` keyed bytes; long ones in counter mode over one digest of the data."""
    seed = hashlib.blake2b(tweak.encode() + b"\0" + data, key=key, digest_size=32).digest()
    if size <= 32:
        return seed[:size]
    return b"".join(hashlib.blake2b(seed + i.to_bytes(8, "big"), key=key, digest_size=64).digest() for i in range(-(-size // 64)))[:size]


@lru_cache(maxsize=256)
def _cycle(n: int, key: bytes, tweak: str) -> tuple[list[int], dict[int, int]]:
    """All of ``range(n)`` in a keyed order, and each one's place in it."""
    order = sorted(range(n), key=lambda i: _hash(key, f"{tweak}|{n}", i.to_bytes(8, "big"), 16))
    return order, {v: i for i, v in enumerate(order)}


def permute(x: int, n: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of ``range(n)``, ``n`` at most 2**64, without fixed points where ``n`` is over one."""
    if n < 2:
        return 0
    if n <= 4096:  # each goes to the next of a keyed cycle
        order, place = _cycle(n, key, tweak)
        return order[(place[x] + 1) % n]
    # Conjugate of the step by one: walk to a place, step, walk back. A step has no fixed point, nor has this.
    return _walk((_walk(x, n, key, tweak, True) + 1) % n, n, key, tweak, False)


def _walk(x: int, n: int, key: bytes, tweak: str, ahead: bool) -> int:
    """A balanced Feistel network on the next even number of bits, walked until it is in range again; or its inverse."""
    half = ((n - 1).bit_length() + 1) // 2
    mask = (1 << half) - 1
    while True:
        a, b = x >> half, x & mask
        for r in range(4) if ahead else reversed(range(4)):
            if ahead:
                a, b = b, a ^ (_round(b, n, r, key, tweak) & mask)
            else:
                a, b = b ^ (_round(a, n, r, key, tweak) & mask), a
        x = (a << half) | b
        if x < n:
            return x


def _round(b: int, n: int, r: int, key: bytes, tweak: str) -> int:
    return int.from_bytes(_hash(key, f"{tweak}|{n}|{r}", b.to_bytes(8, "big"), 8), "big")


def permute_digits(digits: list[int], sizes: list[int], key: bytes, tweak: str) -> list[int]:
    """A keyed permutation of digit strings, digit ``i`` below ``sizes[i]``, without fixed points where there is more than one."""
    total = 1
    for s in sizes:
        total *= s
        if total > SMALL:
            break
    else:
        x = 0
        for d, s in zip(digits, sizes, strict=True):
            x = x * s + d
        x, out = permute(x, total, key, tweak), []
        for s in reversed(sizes):
            x, d = divmod(x, s)
            out.append(d)
        return out[::-1]
    half = len(digits) // 2
    tag = f"{tweak}|{len(digits)}"
    sides = ((slice(0, half), slice(half, None)), (slice(half, None), slice(0, half)))
    # As above: to a place, a step in the last digit, and back. The step moves every string, so the whole does.
    out = list(digits)
    for r in range(ROUNDS):
        _mix(out, sizes, *sides[r % 2], key, f"{tag}|{r}", 1)
    last = max(i for i, s in enumerate(sizes) if s > 1)
    out[last] = (out[last] + 1) % sizes[last]
    for r in reversed(range(ROUNDS)):
        _mix(out, sizes, *sides[r % 2], key, f"{tag}|{r}", -1)
    return out


def _mix(digits: list[int], sizes: list[int], into: slice, of: slice, key: bytes, tweak: str, sign: int) -> None:
    """Add a stream made from one half to the other, digit by digit."""
    limits = sizes[into]
    stream = _hash(key, tweak, b"".join(d.to_bytes(2, "big") for d in digits[of]), 4 * len(limits))
    digits[into] = [(d + sign * int.from_bytes(stream[4 * i : 4 * i + 4], "big")) % s for i, (d, s) in enumerate(zip(digits[into], limits, strict=True))]

"""Token counts that follow edits.

A document's pre-tokens (what the tokenizer's pattern cuts) are kept in blocks, with a segment tree over them
whose nodes sum characters and tokens. ``trees`` makes these once and stores them as a column; ``edit`` takes the
stored trees with edits and returns the next ones, so a later edit never encodes the whole document. An edit descends to the block it falls in, is widened to the last
pre-token boundary the pattern couldn't have looked beyond, and is cut anew until the cuts fall on an old
boundary again: from there on the old pre-tokens hold. Only what lies between is encoded; block sums and the
path to the root are updated.

An edit is ``(start, end, text)``: code points ``start`` to ``end`` of the document as it then is are replaced;
ends beyond the text are taken back to its end, null parts of it are 0, 0 and no text. Null texts count as empty and
may be edited. Repeated rows are counted alike, an empty table gives an empty result, other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import map_columns, only

BLOCK, CACHE, LOOKAHEAD = 64, 250_000, 2


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Counter:
    """Cuts texts into pre-tokens and counts the tokens of each, remembering those it has met.

    The pattern must cut every text without gaps and look at most ``LOOKAHEAD`` characters beyond a cut.
    """

    def __init__(self, path: str, pattern: str | None = None, cache: int = CACHE):
        import base64

        import public_tokenizers
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        pattern = pattern or public_tokenizers.PATTERN
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.cut = regex.compile(pattern)
        self.limit, self.known = cache, {}

    def tokens(self, pretokens: list[str]) -> list[int]:
        if len(self.known) > self.limit:
            self.known = {}
        known = self.known
        for p in pretokens:
            if p not in known:
                known[p] = len(self.encoding.encode_ordinary(p))
        return list(map(known.__getitem__, pretokens))


def counter(path: str | None = None) -> Counter:
    path = path or default_ranks()
    return only(("ranks", path), lambda: Counter(path))


class Tree:
    """A document with the segment tree of its pre-tokens."""

    def __init__(self, text: str, own: Counter):
        self.text, self.own, self.encoded = text, own, 0
        cuts = own.cut.findall(text)
        self._blocks(list(map(len, cuts)), own.tokens(cuts))

    def _blocks(self, sizes: list[int], tokens: list[int]) -> None:
        self.sizes = [sizes[i : i + BLOCK] for i in range(0, len(sizes), BLOCK)] or [[]]
        self.counts = [tokens[i : i + BLOCK] for i in range(0, len(tokens), BLOCK)] or [[]]
        self.leaves = 1 << (len(self.sizes) - 1).bit_length()
        self.chars, self.sums = [0] * (2 * self.leaves), [0] * (2 * self.leaves)
        for i, (s, t) in enumerate(zip(self.sizes, self.counts, strict=True)):
            self.chars[self.leaves + i], self.sums[self.leaves + i] = sum(s), sum(t)
        for i in range(self.leaves - 1, 0, -1):
            self.chars[i], self.sums[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.sums[2 * i] + self.sums[2 * i + 1]

    def state(self) -> dict[str, bytes]:
        """The tree as unsigned 32-bit numbers: pre-tokens of each block, their characters and tokens, and both sums of each node."""
        flat = lambda parts: array("I", (x for p in parts for x in p)).tobytes()
        return {"blocks": array("I", map(len, self.sizes)).tobytes(), "sizes": flat(self.sizes), "counts": flat(self.counts), "chars": array("I", self.chars).tobytes(), "sums": array("I", self.sums).tobytes()}

    @classmethod
    def of(cls, text: str, state: dict[str, bytes], own: Counter) -> Tree:
        """A stored tree with its text; nothing is encoded."""
        out = cls.__new__(cls)
        out.text, out.own, out.encoded = text, own, 0
        read = {k: array("I", bytes(v)).tolist() for k, v in state.items()}
        out.sizes, out.counts, at = [], [], 0
        for n in read["blocks"]:
            out.sizes.append(read["sizes"][at : at + n])
            out.counts.append(read["counts"][at : at + n])
            at += n
        out.chars, out.sums = read["chars"], read["sums"]
        out.leaves = len(out.chars) // 2
        return out

    @property
    def n_tokens(self) -> int:
        return self.sums[1]

    @property
    def n_pretokens(self) -> int:
        return sum(map(len, self.sizes))

    def _find(self, at: int) -> tuple[int, int]:
        """The block that holds a character, and where the block starts."""
        node, start = 1, 0
        while node < self.leaves:
            node *= 2
            if at - start >= self.chars[node] and self.chars[node + 1]:
                start += self.chars[node]
                node += 1
        return node - self.leaves, start

    def _update(self, block: int) -> None:
        node = self.leaves + block
        self.chars[node], self.sums[node] = sum(self.sizes[block]), sum(self.counts[block])
        while node > 1:
            node //= 2
            self.chars[node], self.sums[node] = self.chars[2 * node] + self.chars[2 * node + 1], self.sums[2 * node] + self.sums[2 * node + 1]

    def edit(self, start: int, end: int, new: str) -> None:
        n = len(self.text)
        start, end = min(max(start, 0), n), min(max(end, start, 0), n)
        self.text = self.text[:start] + new + self.text[end:]
        grown, resume = len(new) - (end - start), start + len(new)
        # Back to a boundary whose pre-token before it ended too early to have looked at the edit.
        block, at = self._find(max(0, start - LOOKAHEAD))
        first, skip = at, 0
        for size in self.sizes[block]:
            if first + size + LOOKAHEAD > start:
                break
            first, skip = first + size, skip + 1
        # Old boundaries from there on, as places in the new text, walked along while cutting anew.
        last, done = block, skip
        old, sizes, pieces = first, [], []
        here = first
        met = False
        if here < len(self.text):
            for m in self.own.cut.finditer(self.text, here):
                pieces.append(m.group())
                sizes.append(m.end() - m.start())
                here = m.end()
                while old + grown < here and last < len(self.sizes):
                    if done >= len(self.sizes[last]):
                        last, done = last + 1, 0
                        continue
                    old, done = old + self.sizes[last][done], done + 1
                if old >= end and old + grown == here and here >= resume:
                    met = True
                    break
        if not met:  # cut to the end
            last, done = len(self.sizes) - 1, len(self.sizes[-1])
        tokens = self.own.tokens(pieces)
        self.encoded += sum(sizes)
        tail_sizes, tail_counts = (self.sizes[last][done:], self.counts[last][done:]) if last < len(self.sizes) else ([], [])
        self.sizes[block] = self.sizes[block][:skip] + sizes + tail_sizes
        self.counts[block] = self.counts[block][:skip] + tokens + tail_counts
        for b in range(block + 1, min(last + 1, len(self.sizes))):
            self.sizes[b], self.counts[b] = [], []
            self._update(b)
        self._update(block)
        if len(self.sizes[block]) > 8 * BLOCK:  # blocks anew, from the pre-tokens that are known
            self._blocks([s for b in self.sizes for s in b], [t for b in self.counts for t in b])


def count_edits(text: str | None, edits: Iterable[tuple[int, int, str]], own: Counter) -> Tree:
    tree = Tree(text or "", own)
    for start, end, new in edits:
        tree.edit(start, end, new)
    return tree


def sample_edits(text: str | None) -> list[tuple[int, int, str]]:
    """Three edits that depend on the text alone: a replacement, an insertion and a deletion."""
    n = len(text or "")
    return [(n // 2, n // 2 + 5, "[edited]"), (n // 3, n // 3, "  \n new"), (2 * n // 3, 2 * n // 3 + 10, "")]


TREE = "struct<blocks:binary,sizes:binary,counts:binary,chars:binary,sums:binary>"
EDITS = "array<struct<start:int,end:int,text:string>>"


def _rows(docs: DataFrame, *more) -> tuple[DataFrame, str]:
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)
    return rows, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}"


def trees(docs: DataFrame, ranks: str | None = None, edits: str | None = None) -> DataFrame:
    """``(doc_id, text, tree, n_tokens, n_pretokens)`` for every row of ``docs (doc_id, text)``; a column ``edits`` passes through as ``edits``."""

    def make():
        own = counter(ranks)

        def run(ids, texts, *more):
            made = [Tree(t, own) for t in texts]
            out = {"doc_id": ids, "text": texts, "tree": [t.state() for t in made], "n_tokens": [t.n_tokens for t in made], "n_pretokens": [t.n_pretokens for t in made]}
            return out | {"edits": more[0]} if more else out

        return run

    rows, key = _rows(docs, *([F.col(edits).cast(EDITS).alias("edits")] if edits else []))
    return map_columns(rows, f"{key}, text string, tree {TREE}, n_tokens long, n_pretokens long" + (f", edits {EDITS}" if edits else ""), make, 500)


def edit(stored: DataFrame, edits: str | None = None, ranks: str | None = None) -> DataFrame:
    """The trees of ``stored`` (as ``trees`` or ``edit`` gives them) after their edits: the same columns, and
    ``(n_edits, n_tokens_before, n_pretokens_before, n_chars, n_chars_encoded)``.

    ``edits`` names a column of arrays of ``(start, end, text)``; without it each text gets ``sample_edits``.
    ``n_chars_encoded`` says how many characters the edits had encoded anew.
    """

    def make():
        own = counter(ranks)

        def run(ids, texts, states, todo):
            out: dict = {k: [] for k in ("text", "tree", "n_tokens", "n_pretokens", "n_edits", "n_tokens_before", "n_pretokens_before", "n_chars", "n_chars_encoded")}
            for text, state, given in zip(texts, states, todo, strict=True):
                changes = sample_edits(text) if edits is None else [(x["start"] or 0, x["end"] or 0, x["text"] or "") for x in given or () if x]
                tree = Tree.of(text, state, own)
                before, cuts = tree.n_tokens, tree.n_pretokens
                for x in changes:
                    tree.edit(*x)
                for k, v in zip(out, (tree.text, tree.state(), tree.n_tokens, tree.n_pretokens, len(changes), before, cuts, len(tree.text), tree.encoded), strict=True):
                    out[k].append(v)
            return {"doc_id": ids, **out}

        return run

    given = F.lit(None).cast("int") if edits is None else F.col(edits).cast(EDITS)
    rows, key = _rows(stored, "tree", given.alias("edits"))
    return map_columns(rows, f"{key}, text string, tree {TREE}, n_tokens long, n_pretokens long, n_edits int, n_tokens_before long, n_pretokens_before long, n_chars long, n_chars_encoded long", make, 500)


def follow(docs: DataFrame, edits: str | None = None, ranks: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens, n_pretokens, n_edits, n_tokens_edited, n_chars_edited, n_chars_encoded)`` for every row:
    counts of the trees of ``docs`` before, and after ``edits`` (see ``edit``)."""
    made = trees(docs, ranks) if edits is None else trees(docs, ranks, edits)
    out = edit(made, edits and "edits", ranks)
    return out.select("doc_id", F.col("n_tokens_before").alias("n_tokens"), F.col("n_pretokens_before").alias("n_pretokens"), "n_edits", F.col("n_tokens").alias("n_tokens_edited"), F.col("n_chars").alias("n_chars_edited"), "n_chars_encoded")

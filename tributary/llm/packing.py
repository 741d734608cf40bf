"""Best-fit packing of token sequences by linear grouping.

Documents are encoded, an end id is appended, and longer ones are cut into full pieces. How many pieces have
each length is a table of at most ``capacity`` rows, whatever the corpus; the packing is planned on it at the
driver, in bulk:

1. Large lengths are put into groups of equal cardinality and rounded up to the largest of their group.
2. The best mix of configurations of these few sizes is a linear program, solved by column generation.
3. Whole multiples of each configuration are opened and filled with the actual lengths of the groups.
4. What is left of the large and all small lengths go, longest first, where they leave least room.

A plan is a list of runs ``(length, first rank, count, first sequence, offset)``. Pieces get their rank among
those of their length from counts per task, so no length, however frequent, meets in one task, and take their
place from the plan, whose size depends on the lengths alone.

Null texts count as empty (one piece of the end id alone). Repeated rows are packed each by itself; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tributary.llm.common import materialize, only

CAPACITY, END_ID, CACHE = 4096, 1, 250_000
#: Tried in turn: what share of a sequence makes a length large (one in ...), and how many groups. The best plan counts.
SHAPES = ((4, 8), (8, 16), (2, 16), (8, 64), (3, 32))
#: The tokenizer's pattern below U+0250, and its characters for bytes that don't stand for themselves.
LATIN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ɏ]+|[0-9²³¹¼-¾]|[^ a-zªµºß-öø-ɏ0-9²³¹¼-¾]+")
BYTES = {b: 256 + i for i, b in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])}
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Encodes texts as the tokenizers library does, remembering chunks between blanks and the words in them.

    The tokenizer's pattern never joins what blanks divide, and its normalizer works within chunks; so a text's
    ids are those of its chunks in order, and a chunk's those of its pre-tokens. Merges are the library's model;
    so are normalisation and cutting, but for chunks in Latin letters, where both are plain. Chunks that may hold a
    special token go to the library whole.
    """

    def __init__(self, path: str, cache: int = CACHE):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = {t.content[:2] for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.words = _Remember(self._word, cache)
        self.chunks = _Remember(self._chunk, cache)

    def _word(self, word: str) -> bytes:
        return _bytes([t.id for t in self.tokenizer.model.tokenize(word)])

    def _chunk(self, chunk: str) -> bytes:
        if any(s in chunk for s in self.special):
            return _bytes(self.tokenizer.encode(chunk, add_special_tokens=False).ids)
        if chunk.isascii() and chunk.isalpha():
            return self.words[chunk.lower()]
        if chunk.isprintable() and max(chunk, default="") < "\u0250" and "\u0130" not in chunk:
            # Up to here in Unicode, lower case depends on no context and composed characters are all there is.
            cut = [w if w.isascii() else w.encode().decode("latin-1").translate(BYTES) for w in LATIN.findall(chunk.lower())]
        else:
            cut = [w for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(chunk))]
        return b"".join(map(self.words.__getitem__, cut))

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        for t in texts:
            yield b"".join(map(self.chunks.__getitem__, (t or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")))


def _bytes(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class _Remember(dict):
    """Values of a function. The first ``limit`` keys stay; after as many misses again four times over, all go."""

    def __init__(self, fn, limit: int):
        self.fn, self.limit, self.misses = fn, limit, 0

    def __missing__(self, key):
        value = self.fn(key)
        if len(self) < self.limit:
            self[key] = value
        else:
            self.misses += 1
            if self.misses > 4 * self.limit:
                self.misses = 0
                self.clear()
        return value


def encoder(path: str) -> WordEncoder:
    return only(("words", path), lambda: WordEncoder(path))


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece, with its task and its rank among the pieces of that length in that task."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, ranks = TaskContext.get().partitionId(), {}
        words = encoder(path)
        end = _bytes([END_ID])
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                ids, texts = (c.to_pylist() for c in batch.slice(at, 1000).columns)
                out: list[list] = [[] for _ in range(7)]
                for doc, data in zip(ids, words.encode(texts), strict=True):
                    data += end
                    for k, lo in enumerate(range(0, len(data), 4 * capacity)):
                        piece = data[lo : lo + 4 * capacity]
                        n = len(piece) // 4
                        rank = ranks.get(n, 0)
                        ranks[n] = rank + 1
                        for column, v in zip(out, (doc, k, lo // 4, n, zlib.crc32(piece), part, rank), strict=True):
                            column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def best_mix(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[list[int], float]]:
    """Configurations and their (fractional) number for the cutting-stock program, by column generation."""
    k = len(sizes)
    need = np.array(demand, float)
    basis = np.diag([float(capacity // s) for s in sizes])
    most = capacity // min(sizes)
    for _ in range(400):
        prices = np.linalg.solve(basis.T, np.ones(k))
        best, picks = np.zeros(capacity + 1), []
        for _ in range(most):  # the most valuable filling with one item more
            more, pick = best.copy(), np.full(capacity + 1, -1)
            for g, s in enumerate(sizes):
                value = best[: capacity + 1 - s] + prices[g]
                better = value > more[s:] + 1e-12
                more[s:][better], pick[s:][better] = value[better], g
            picks.append(pick)
            best = more
        if best[capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(k), capacity
        for pick in reversed(picks):
            if (g := pick[room]) >= 0:
                column[g] += 1
                room -= sizes[g]
        now, change = np.linalg.solve(basis, need), np.linalg.solve(basis, column)
        may = change > 1e-9
        if not may.any():
            break
        ratio = np.full(k, np.inf)
        ratio[may] = now[may] / change[may]
        basis[:, int(ratio.argmin())] = column
    amounts = np.linalg.solve(basis, need)
    return [(basis[:, i].astype(int).tolist(), float(amounts[i])) for i in range(k)]


class Plan:
    """Sequences opened so far, in ranges of equal room, and the runs that filled them."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.left, self.taken = capacity, dict(counts), dict.fromkeys(counts, 0)
        self.opened, self.runs = 0, []
        self.room: dict[int, list[tuple[int, int]]] = {}
        self.rooms: list[int] = []

    def put(self, room: int, first: int, n: int) -> None:
        if n:
            if room not in self.room:
                bisect.insort(self.rooms, room)
                self.room[room] = []
            self.room[room].append((first, n))

    def fill(self, length: int, room: int, first: int, n: int) -> None:
        """The next ``n`` pieces of a length, one into each sequence of a range that has ``room`` left."""
        self.runs.append((length, self.taken[length], n, first, self.capacity - room))
        self.taken[length] += n
        self.left[length] -= n

    def open(self, n: int) -> int:
        self.opened += n
        return self.opened - n

    def best_fit(self, length: int) -> None:
        while n := self.left[length]:
            at = bisect.bisect_left(self.rooms, length)
            if at == len(self.rooms):
                each = self.capacity // length  # fresh sequences take as many as they hold
                full, rest = divmod(n, each)
                for k, per in ((full, each), (1 if rest else 0, rest)):
                    if k:
                        first = self.open(k)
                        for i in range(per):
                            self.fill(length, self.capacity - i * length, first, k)
                        self.put(self.capacity - per * length, first, k)
                return
            room = self.rooms[at]
            first, m = self.room[room].pop()
            if not self.room[room]:
                del self.room[room], self.rooms[at]
            k = min(n, m)
            self.fill(length, room, first, k)
            self.put(room - length, first, k)
            self.put(room, first + k, m - k)

    def configure(self, groups: list[list[int]], config: list[int], n: int) -> None:
        """Open ``n`` sequences of a configuration and substitute actual lengths for each group's size."""
        parts = [(self.open(n), n, self.capacity)]
        for g, times in enumerate(config):
            for _ in range(times):
                after = []
                for first, m, room in parts:
                    while m:
                        length = next((x for x in groups[g] if self.left_in(g, x)), None)
                        if length is None:
                            after.append((first, m, room))
                            break
                        k = min(m, self.left_in(g, length))
                        self.quota[g][length] -= k
                        self.fill(length, room, first, k)
                        after.append((first, k, room - length))
                        first, m = first + k, m - k
                parts = after
        for first, m, room in parts:
            self.put(room, first, m)

    def left_in(self, g: int, length: int) -> int:
        return self.quota[g].get(length, 0)


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = 16, share: int = 8) -> Plan:
    """Plan how ``counts`` pieces of each length go into sequences of ``capacity``."""
    out = Plan(counts, capacity)
    large = sorted((x for x in counts if x * share > capacity and x < capacity), reverse=True)
    total = sum(counts[x] for x in large)
    if total:
        size, quota, held = -(-total // groups), [{}], 0
        for x in large:
            n = counts[x]
            while n:
                if held == size:
                    quota.append({})
                    held = 0
                k = min(n, size - held)
                quota[-1][x] = quota[-1].get(x, 0) + k
                held, n = held + k, n - k
        merged: dict[int, dict[int, int]] = {}
        for q in quota:  # groups rounded up to one size are one
            into = merged.setdefault(max(q), {})
            for x, n in q.items():
                into[x] = into.get(x, 0) + n
        out.quota = list(merged.values())
        members = [sorted(q, reverse=True) for q in out.quota]
        for config, amount in best_mix(list(merged), [sum(q.values()) for q in out.quota], capacity):
            if (n := int(amount + 1e-9)) > 0:
                out.configure(members, config, n)
    for length in sorted(counts, reverse=True):
        out.best_fit(length)
    return out


def best_plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The plan with fewest sequences; no further is tried once one has no more than the pieces' total needs."""
    least, best = -(-sum(length * n for length, n in counts.items()) // capacity), None
    for share, groups in SHAPES:
        made = plan(counts, capacity, groups, share)
        if best is None or made.opened < best.opened:
            best = made
        if best.opened <= least:
            break
    return best


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)`` for every piece of every document."""
    cut = materialize(pieces(docs, tokenizer, capacity), "pieces")
    by_task = cut.groupBy("part", "length").agg((F.max("rank") + 1).alias("n"))
    by_task = materialize(by_task, "piece-counts")
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    made = best_plan(counts, capacity)
    runs = np.array(sorted(made.runs), np.int64).reshape(-1, 5)
    shared = docs.sparkSession.sparkContext.broadcast(runs)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # Offsets grow with tasks and lengths: pieces, a few bytes each, go to them, they are never broadcast.
    starts = by_task.select("part", "length", F.coalesce(before, F.lit(0)).alias("before")).hint("merge")
    ranked = cut.join(starts, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        keys = (table[:, 0] << 48) | table[:, 1]
        for b in batches:
            rank = b.column(5).to_numpy()
            row = table[np.searchsorted(keys, (b.column(3).to_numpy() << 48) | rank, side="right") - 1]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(row[:, 3] + rank - row[:, 1]), pa.array(row[:, 4])], names=[*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

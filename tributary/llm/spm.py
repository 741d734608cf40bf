"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is escaped (blanks become ``▁``, one is put in front) and merged by an agenda of adjacent symbol pairs,
highest score first, leftmost on ties; characters outside the vocabulary fall back to bytes. Where no piece has
``▁`` after another character, merges never cross into the next run of ``▁``, so segments that begin with such
a run are encoded once and remembered; otherwise whole texts are merged. Each new segment is checked against
the sentencepiece library within its Arrow batch; should they differ, the library's ids count and the document
says so in ``n_corrected``.

Null texts count as empty: no ids. Repeated rows are encoded alike, an empty table gives an empty result, other
columns are ignored. Only models without a normalisation map and without user-defined pieces are taken.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import map_columns, only

SPACE, CACHE, SHORT, INF = "▁", 400_000, 40, float("inf")
SEGMENT = re.compile("▁+[^▁]*")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class _Known(dict):
    """Ids of segments as bytes. The first ``limit`` stay, others for the batch at hand; ``fresh`` lists what is new."""

    def __init__(self, merge, limit: int):
        self.merge, self.limit, self.misses = merge, limit, 0
        self.batch: dict[str, bytes] = {}
        self.fresh: list[str] = []

    def __missing__(self, key: str) -> bytes:
        if (value := self.batch.get(key)) is None:
            value = pack(self.merge(key))
            self.fresh.append(key)
            (self if len(self) < self.limit else self.batch)[key] = value
        return value

    def close(self) -> None:
        """End of a batch; all goes once misses say that what is remembered no longer fits what comes."""
        self.misses += len(self.batch)
        self.batch, self.fresh = {}, []
        if self.misses > 8 * self.limit:
            self.misses = 0
            self.clear()


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Codec:
    def __init__(self, path: str, cache: int = CACHE):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = pb.ModelProto()
        model.ParseFromString(self.library.serialized_model_proto())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or not spec.add_dummy_prefix or spec.remove_extra_whitespaces or any(p.type in (4, 5) for p in model.pieces):
            raise ValueError("only merge-type models with identity normalisation are supported")
        self.scores = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        self.rank = {p.piece: -p.score for p in model.pieces if p.type == 1}
        self.bytes = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if model.trainer_spec.byte_fallback else None
        self.unknown = self.library.unk_id()
        self.split = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.scores)
        self.known, self.wrong = _Known(self.merge, cache), set()
        self.decimal = [str(i) for i in range(len(model.pieces))]

    def merge(self, segment: str) -> list[int]:
        """Ids of an escaped segment, by the agenda: a list of the pairs' scores in place, a heap where it is long."""
        scores, symbols = self.scores, list(segment)
        symbols = self._short(symbols) if len(symbols) <= SHORT else self._long(symbols)
        ids: list[int] = []
        for s in symbols:
            if s:
                if (i := scores.get(s)) is not None:
                    ids.append(i)
                elif self.bytes:
                    ids += [self.bytes[b] for b in s.encode()]
                else:
                    ids.append(self.unknown)
        return ids

    def _short(self, symbols: list[str]) -> list[str]:
        get = self.rank.get
        agenda = [get(p, INF) for p in map(str.__add__, symbols, symbols[1:])]
        while agenda:
            best = min(agenda)
            if best == INF:
                break
            i = agenda.index(best)
            symbols[i] += symbols.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = get(symbols[i] + symbols[i + 1], INF)
            if i:
                agenda[i - 1] = get(symbols[i - 1] + symbols[i], INF)
        return symbols

    def _long(self, symbols: list[str]) -> list[str]:
        get, n = self.rank.get, len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(r, i, i + 1, symbols[i] + symbols[i + 1]) for i in range(n - 1) if (r := get(symbols[i] + symbols[i + 1], INF)) != INF]
        heapq.heapify(agenda)
        while agenda:
            _, i, j, piece = heapq.heappop(agenda)
            if after[i] != j or not symbols[i] or symbols[i] + symbols[j] != piece:
                continue  # one of the two has been merged meanwhile
            symbols[i], symbols[j] = piece, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := get(piece + symbols[k], INF)) != INF:
                    heapq.heappush(agenda, (r, i, k, piece + symbols[k]))
            if (h := before[i]) >= 0 and (r := get(symbols[h] + piece, INF)) != INF:
                heapq.heappush(agenda, (r, h, i, symbols[h] + piece))
        return symbols

    def segments(self, text: str) -> list[str]:
        if not text:
            return []
        escaped = SPACE + text.replace(" ", SPACE)
        return SEGMENT.findall(escaped) if self.split else [escaped]

    def check(self) -> set[str]:
        """Segments new in this batch for which the library gives other ids; its ids replace ours."""
        known, wrong = self.known, set()
        for at in range(0, len(known.fresh), 10_000):
            some = known.fresh[at : at + 10_000]
            theirs = self.library.encode([s[1:].replace(SPACE, " ") for s in some], num_threads=1)
            for s, want in zip(some, map(pack, theirs), strict=True):
                if known[s] != want and len(s) > 1:
                    wrong.add(s)
                    (known if s in known else known.batch)[s] = want
        return wrong

    def encode(self, texts: list[str | None]) -> list[tuple[list[int], str, int]]:
        """For each text: ids, their decimals joined by commas, and how many segments the library corrected."""
        get, decimal = self.known.__getitem__, self.decimal.__getitem__
        parts = [self.segments(t or "") for t in texts]
        data = [b"".join(map(get, p)) for p in parts]
        if wrong := self.check():
            self.wrong |= wrong
            data = [b"".join(map(get, p)) for p in parts]
        self.known.close()
        out = []
        for p, d in zip(parts, data, strict=True):
            ids = np.frombuffer(d, "<u4").tolist()
            out.append((ids, ",".join(map(decimal, ids)), sum(s in self.wrong for s in p) if self.wrong else 0))
        return out

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids) if ids else ""


def codec(path: str | None = None) -> Codec:
    """One codec for each model and Python worker."""
    path = path or default_model()
    return only(("pieces", path), lambda: Codec(path))


def round_trip(docs: DataFrame, model: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256, n_corrected)`` for every row."""

    def make():
        own = codec(model)

        def run(ids, texts):
            done = own.encode(texts)
            sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
            return {"doc_id": ids, "n_tokens": [len(x) for x, _, _ in done], "ids_sha256": [sha(d) for _, d, _ in done], "decoded_sha256": [sha(own.decode(x)) for x, _, _ in done], "n_corrected": [c for _, _, c in done]}

        return run

    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    return map_columns(rows, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_corrected long", make, 1000)


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """``(doc_id, ids)`` for every row."""

    def make():
        own = codec(model)
        return lambda ids, texts: {"doc_id": ids, "ids": [x for x, _, _ in own.encode(texts)]}

    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    return map_columns(rows, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>", make, 1000)

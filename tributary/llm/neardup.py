"""Near-duplicates by Jaccard similarity of 5-word shingles, 0.8 or more: SimHash proposes, sets decide, a join completes.

1. SimHash (``simhash.links``, multi-index hashing) proposes pairs of fingerprints that differ in few bits. Each is
   verified on whole sets. This unites most copies of one text at a cost linear in their number.
2. Fingerprints alone miss pairs near 0.8, which differ in about ten of 64 bits. So sets are also joined with
   prefix filtering: under any one order of all shingles, two sets with similarity 0.8 or more share one of the first
   ``n - ceil(0.8 n) + 1`` shingles of either. First all who hold a prefix shingle are paired with its smallest holder,
   then, where holders are still in different components, with each other. Pairs within one component are never
   formed; sizes and the positions met at bound what a pair can share; pairs that stay are verified on whole sets.

So components are exact: every pair across components was looked at, and none below the threshold links. Shingles are
compared by 64-bit digests (XXH64, seed 42). The order puts common shingles last, so prefixes meet at rare ones. It goes by
counts over all documents in ``CELLS`` cells of digests, a table of one size for any corpus; where shingles share a
cell, they share a place in the order. It decides how many candidates there are, never which pairs are found.
Documents with one set of shingles are collapsed before the search and rejoined after it.

Fewer than five words are one shingle; null texts and texts without a word have the empty set and are alike. Rows
with equal doc_id count as one document; documents without a doc_id are left out of the search. An empty table gives
an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm import simhash
from tributary.llm.common import forget, map_columns, materialize, release, shuffled
from tributary.llm.components import connected_components
from tributary.llm.simhash import LOWER, SEED, WORD

SHINGLE, CELLS, BLOCK, MAP = 5, 1 << 22, 1 << 16, 1 << 22


def shingles(text: str | None) -> np.ndarray:
    """Digests of a text's 5-word shingles as signed longs, sorted, each once."""
    import xxhash

    words = WORD.findall((text or "").encode().translate(LOWER))
    if not words:
        return np.zeros(0, np.int64)
    grams = zip(*(words[i:] for i in range(SHINGLE)), strict=False) if len(words) >= SHINGLE else [words]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(g), SEED) for g in grams], np.uint64).view(np.int64))


def prefix(own: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The shingles one of which any set with similarity 0.8 or more shares, those of light cells first."""
    n = len(own)
    return own[np.lexsort((own, weight[own & (len(weight) - 1)]))[: n - -(-4 * n // 5) + 1]] if n else own


def weights(rows: DataFrame, cells: int = CELLS) -> np.ndarray:
    """How often the shingles of each cell are met in all documents, on a logarithmic scale; ``cells`` numbers.

    A shingle's cell are its last bits. Each task adds up its own documents and sends what it met, packed, in blocks.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        met = np.zeros(cells, np.uint32)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                found = [shingles(t) for t in batch.column(0).slice(at, 500).to_pylist()]
                np.add.at(met, np.concatenate([np.zeros(0, np.int64), *found]) & (cells - 1), 1)
        for block, own in enumerate(met.reshape(-1, BLOCK)):
            if own.any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "met": pa.array([zlib.compress(own.tobytes(), 1)], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, met in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total.setdefault(block, np.zeros(BLOCK, np.uint64))
                total[block] += np.frombuffer(zlib.decompress(met), np.uint32)
        for block, n in total.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "met": pa.array([(np.log2(n + 1.0) * 1024).astype(np.uint16).tobytes()], pa.binary())})

    kind = "block int, met binary"
    out = np.zeros(cells, np.uint16)
    for r in rows.select("text").mapInArrow(count, kind).repartition("block").mapInArrow(add, kind).collect():  # 2 bytes a cell
        out[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.met, np.uint16)
    return out


def spots(ids: DataFrame) -> np.ndarray:
    """The hashes of the ids in ``ids (doc_id)``, as set bits of a map of ``MAP`` bits, whatever their number."""
    at = ids.select((F.xxhash64("doc_id").bitwiseAND(MAP - 1) + 1).alias("v"))
    found = at.groupBy(F.bitmap_bucket_number("v").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("v")).alias("bits")).collect()  # MAP bits
    bits = np.zeros(MAP, bool)
    for r in found:
        lo = (r.bucket - 1) << 15
        bits[lo : lo + (1 << 15)] = np.unpackbits(np.frombuffer(r.bits, np.uint8), bitorder="little")
    return np.packbits(bits)


def sets_of(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """``(doc_id, own)``: shingles of the ``rows`` whose doc_id is in ``ids (doc_id)``, and of some more.

    No text is shuffled, and one Python worker both rules out rows and cuts the rest; the more ids, the less it rules out.
    """
    shared = rows.sparkSession.sparkContext.broadcast(spots(ids))

    def make():
        forget()
        bits = shared.value

        def run(spot, ids, texts):
            x = np.array(spot, np.int64)
            may = np.flatnonzero(bits[x >> 3] >> (7 - (x & 7)) & 1)
            return {"doc_id": [ids[i] for i in may], "own": [shingles(texts[i]) for i in may]}

        return run

    spot = F.xxhash64("doc_id").bitwiseAND(MAP - 1).alias("spot")
    return map_columns(rows.select(spot, "doc_id", "text"), "doc_id long, own array<long>", make, rows=500)


def verified(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs ``(src, dst)`` with similarity 0.8 or more, written; ``rows`` has texts."""
    wanted = pairs.select(F.explode(F.array("src", "dst")).alias("doc_id")).distinct()
    whole = materialize(sets_of(wanted, rows), "sets")
    x, y = whole.select(F.col("doc_id").alias("src"), F.col("own").alias("x")), whole.select(F.col("doc_id").alias("dst"), F.col("own").alias("y"))
    both = pairs.join(shuffled(x), "src").join(shuffled(y), "dst")
    out = materialize(both.where(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))).select("src", "dst").distinct(), "links")
    release(whole)
    return out


def proposed(firsts: DataFrame) -> DataFrame:
    """Pairs ``(src, dst)`` that connect documents with fingerprints ``fp`` up to ``simhash.BITS`` apart."""
    heads = firsts.groupBy("fp").agg(F.min("doc_id").alias("head"))
    alike = firsts.join(shuffled(heads), "fp").where("doc_id <> head").select(F.col("head").alias("src"), F.col("doc_id").alias("dst"))
    near = simhash.links(heads.select("fp")).join(shuffled(heads.select(F.col("fp").alias("fp_a"), F.col("head").alias("a"))), "fp_a").join(shuffled(heads.select(F.col("fp").alias("fp_b"), F.col("head").alias("b"))), "fp_b")
    return alike.unionByName(near.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")))


def _mixed(entries: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``entries`` (h, at, doc_id, n) whose shingle ``h`` two components of ``found`` hold, with the component and the smallest holder."""
    comp = connected_components(found)
    own = entries.join(shuffled(comp.withColumnRenamed("node", "doc_id")), "doc_id", "left").select("h", "at", "doc_id", "n", F.coalesce("component", "doc_id").alias("comp"))
    mixed = own.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(F.struct("doc_id", "n", "at", "comp")).alias("head")).where("lo <> hi")
    out = materialize(own.join(shuffled(mixed.select("h", "head")), "h"), "mixed")
    release(comp)
    return out


#: What a pair can still share where it meets first suffices: 9 * shared >= 4 * (na + nb).
_FITS = "compa <> compb and 5 * least(na, nb) >= 4 * greatest(na, nb) and 9 * least(na - ata, nb - atb) >= 4 * (na + nb)"


def links(firsts: DataFrame, rows: DataFrame) -> DataFrame:
    """Links ``(src, dst)`` that connect all documents of ``firsts`` (doc_id, n, fp, prefix) with similarity 0.8 or more."""
    pairs = materialize(proposed(firsts).distinct(), "proposed")
    close = verified(pairs, rows)
    release(pairs)
    # Most shingles have one holder. Short hashes tell nearly all of them; what else they let through does no harm.
    entries = firsts.select(F.posexplode("prefix").alias("at", "h"), "doc_id", "n")
    shared = entries.groupBy(F.hash("h").alias("short")).agg(F.count("*").alias("k")).where("k > 1").select("short")
    entries = materialize(entries.join(shuffled(shared), F.hash("h") == F.col("short"), "left_semi"), "shared")
    mixed = _mixed(entries, close)
    side = lambda x, to, of: [F.col(of + "doc_id").alias(to), *[F.col(of + c).alias(c + x) for c in ("n", "at", "comp")]]
    met = mixed.select(*side("a", "src", "head."), *side("b", "dst", "")).where(_FITS).select("src", "dst").distinct()
    stars = materialize(met, "stars")
    star_links = verified(stars, rows)
    again = _mixed(mixed.drop("comp", "head"), close.unionByName(star_links))
    cross = again.select("h", *side("a", "src", "")).join(shuffled(again.select("h", *side("b", "dst", ""))), "h").where(f"src < dst and {_FITS}")
    pairs = materialize(cross.select("src", "dst").distinct().join(shuffled(stars), ["src", "dst"], "left_anti"), "candidates")
    last = verified(pairs, rows)
    out = materialize(close.unionByName(star_links).unionByName(last), "all-links")
    release(entries, mixed, again, stars, pairs, close, star_links, last)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, component_id)`` for every row of ``docs`` with a doc_id; component_id is its group's smallest doc_id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    shared = docs.sparkSession.sparkContext.broadcast(weights(rows))  # 2 bytes a cell

    def make():
        forget()
        weight = shared.value

        def run(ids, texts):
            owns = [shingles(t) for t in texts]
            return {"doc_id": ids, "n": [len(o) for o in owns], "digest": [hashlib.blake2b(o.tobytes(), digest_size=16).digest() for o in owns], "fp": [simhash.signed(simhash.majority(o)) for o in owns], "prefix": [prefix(o, weight) for o in owns]}

        return run

    sets = materialize(map_columns(rows, "doc_id long, n long, digest binary, fp long, prefix array<long>", make, rows=500), "prefixes")
    classes = materialize(sets.groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    # Copies go by their doc_id, so that prefixes aren't moved.
    copies = materialize(sets.select("digest", "doc_id").join(shuffled(classes), "digest").where("doc_id <> rep").select("doc_id").distinct(), "copies")
    firsts = sets.join(shuffled(copies), "doc_id", "left_anti").select("doc_id", "n", "fp", "prefix")
    found = links(firsts, rows)
    comp = connected_components(found)
    member = classes.join(shuffled(comp.withColumnRenamed("node", "rep")), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    out = materialize(sets.select("doc_id", "digest").join(shuffled(member), "digest").select("doc_id", "component_id"), "near-duplicates")
    release(sets, classes, copies, found, comp)
    return out


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents whose doc_id is the smallest of their component; documents without a doc_id stay."""
    kept = near_duplicates(docs).where("doc_id = component_id").select("doc_id").distinct()
    named = docs.join(shuffled(kept), docs["doc_id"] == kept["doc_id"], "left_semi")
    return named.unionByName(docs.where("doc_id is null"))

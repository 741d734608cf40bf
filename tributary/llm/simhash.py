"""SimHash near-duplicates: multi-index hashing over fingerprint segments.

Fingerprints are 64-bit; two link at ``2`` or fewer differing bits. The fingerprint is cut into two
32-bit segments, so of two linked fingerprints one segment differs in at most one bit. Each distinct
fingerprint stands in the table of either segment, and probes it with the Hamming ball of radius one around
its own segment. Only the half of the ball that sets a bit is enumerated: of two segments one bit apart,
exactly one has the bit clear, so each pair is met once. Matches are verified on all 64 bits.

A segment value held by more than ``BUCKET`` fingerprints isn't joined; the fingerprints of such buckets go
through one index of whole-fingerprint balls of radius one instead: two fingerprints are within two bits
exactly if these balls meet, and every key of it is held by at most 65 fingerprints. No link is lost and
no bucket is squared.

Equal fingerprints are collapsed before the search and rejoined after it, so groups of copies cost one row.
Null texts and texts without a word have fingerprint zero and link like any other; an empty table gives an
empty result; rows with equal doc_id count as one document; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import map_columns, materialize, release, shuffled
from tributary.llm.components import connected_components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SEED, SHINGLE, BITS, BUCKET = 42, 3, 2, 256


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash of a text's 3-word shingles (XXH64, seed 42; ties give 0 bits)."""
    import xxhash

    words = WORD.findall((text or "").encode().translate(LOWER))
    if not words:
        return 0
    if len(words) < SHINGLE:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(words, words[1:], words[2:], strict=False))
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(g, SEED) for g in grams], np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The unsigned number whose bits are those set in over half of 64-bit ``hashes``."""
    hashes, ones = hashes.astype(hashes.dtype.newbyteorder(">")), np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounded memory on very long texts
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def signed(fp: int) -> int:
    """The signed long with the bits of an unsigned one."""
    return fp - (1 << 64) if fp >> 63 else fp


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp)``: the fingerprint as a signed long with the same bits."""

    def make():
        def run(ids, texts):
            return {"doc_id": ids, "fp": [signed(fingerprint(t)) for t in texts]}

        return run

    return map_columns(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "doc_id long, fp long", make)


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links ``(fp_a, fp_b)`` between distinct fingerprints ``fp`` that connect all within two bits."""
    segments = F.array(
        F.struct(F.lit(0).alias("seg"), F.col("fp").bitwiseAND(0xFFFFFFFF).alias("part")),
        F.struct(F.lit(1).alias("seg"), F.shiftrightunsigned("fp", 32).alias("part")),
    )
    entries = fps.select("fp", F.explode(segments).alias("s")).select("fp", "s.seg", "s.part")
    sizes = entries.groupBy("seg", "part").agg(F.count("*").alias("n"), F.min("fp").alias("only"))
    shared = materialize(sizes.where(F.col("n") > bucket).select("seg", "part"), "buckets")
    tables = entries.join(shuffled(shared), ["seg", "part"], "left_anti")
    ball = F.expr("transform(filter(sequence(0, 31), i -> (part & shiftleft(1L, i)) = 0), i -> part | shiftleft(1L, i))")
    probes = entries.select("fp", "seg", F.explode(F.concat(F.array("part"), ball)).alias("part"))
    met = (
        tables.select("seg", "part", F.col("fp").alias("fp_b"))
        .join(shuffled(probes.withColumnRenamed("fp", "fp_a")), ["seg", "part"])
        .where((F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= BITS) & (F.col("fp_a") != F.col("fp_b")))
        .select(F.least("fp_a", "fp_b").alias("fp_a"), F.greatest("fp_a", "fp_b").alias("fp_b"))
    )
    # Crowded buckets: whoever is in one, or probes one, meets there by whole-fingerprint balls.
    crowd = probes.join(shuffled(shared), ["seg", "part"], "left_semi").select("fp").distinct()
    whole = F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")
    keys = crowd.select("fp", F.explode(whole).alias("key"))
    stars = keys.groupBy("key").agg(F.min("fp").alias("fp_a"), F.collect_set("fp").alias("all"))  # at most 65 a key
    more = stars.where(F.size("all") > 1).select("fp_a", F.explode("all").alias("fp_b")).where("fp_a <> fp_b")
    out = materialize(met.unionByName(more).distinct(), "links")
    release(shared)
    return out


def near_duplicates(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``.

    Each class of equal fingerprints is stood for by its smallest doc_id; documents with a null doc_id
    keep a null component unless another document shares their class.
    """
    fps = materialize(fingerprints(docs), "fingerprints")
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    classes = materialize(classes, "classes")
    found = links(classes.select("fp"), bucket)
    a = classes.select(F.col("fp").alias("fp_a"), F.col("rep").alias("src"))
    b = classes.select(F.col("fp").alias("fp_b"), F.col("rep").alias("dst"))
    edges = found.join(shuffled(a), "fp_a").join(shuffled(b), "fp_b").select("src", "dst")
    comp = connected_components(edges)
    release(found)
    member = classes.join(shuffled(comp.withColumnRenamed("node", "rep")), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(shuffled(member), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """The documents whose doc_id is the smallest of their component; documents without a doc_id stay."""
    kept = near_duplicates(docs, bucket).where("doc_id = component_id").select("doc_id").distinct()
    named = docs.join(shuffled(kept), docs["doc_id"] == kept["doc_id"], "left_semi")
    return named.unionByName(docs.where("doc_id is null"))

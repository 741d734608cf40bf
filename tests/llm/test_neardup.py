"""The pipeline's near-duplicate stage against brute-force Jaccard similarity of 5-word shingles."""

import random
import re

import pytest

from tributary.llm import neardup

SCHEMA = "doc_id long, text string, n long, digest long, prefix long"


def brute(texts):
    def own(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())

    sets = [own(t) for t in texts]
    near = [[j for j, y in enumerate(sets) if x == y or 5 * len(x & y) >= 4 * len(x | y)] for x in sets]
    label = list(range(len(texts)))
    for _ in texts:
        label = [min(label[j] for j in near[i]) for i in range(len(texts))]
    return label


@pytest.mark.parametrize("cells", [1 << 16])
def test_near_copies_are_linked(spark, monkeypatch, cells):
    monkeypatch.setattr(neardup.weights, "__defaults__", (cells,))
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", "word", "Word", "two words", "a b c d e", "a b c d e f", "a b c d e a b c d e a"]
    license = " ".join(rng.choice(words) for _ in range(40))
    for size in (6, 9, 14, 40, 120, 300):
        for _ in range(4):
            base = [rng.choice(words) for _ in range(size)]
            texts += [" ".join(base), " ".join(base[: -max(1, size // 8)])]
            for edits in (1, size // 60 + 1, size // 40 + 1, size // 30 + 1):
                copy = list(base)
                for _ in range(edits):
                    copy[rng.randrange(size)] = "z"
                texts.append(" ".join(copy))
            texts.append(" ".join(base) + " " + license)
    label = brute(texts)
    assert 20 < len(set(label)) < len(texts) - 20
    rows = [(i, t, 1, 2, 3) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, (None, texts[9], 1, 2, 3)], SCHEMA)
    assert dict(neardup.near_duplicates(docs).collect()) == dict(enumerate(label))
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in kept.collect()) == [-1, *sorted(set(label))]


def test_stage_takes_five_words_and_similarity(spark):
    import corpus_pipeline as cp

    rng = random.Random(9)
    base = [f"w{rng.randrange(500)}" for _ in range(200)]
    copy = [*base[:100], "new", *base[101:]]
    rows = [(1, " ".join(base)), (2, " ".join(copy))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.doc_id for r in cp.near_duplicates(spark, docs, "").collect()] == [1]


def test_empty(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_large_groups_form_few_pairs(spark, monkeypatch):
    """Near copies of one text, two texts that share a passage, and a bridge between two groups."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(900)]
    base, other, passage = ([rng.choice(words) for _ in range(n)] for n in (150, 150, 60))
    texts = []
    for source in (base, other):
        for _ in range(60):
            copy = list(source)
            copy[rng.randrange(150)] = f"z{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    texts += [" ".join([*passage, *(rng.choice(words) for _ in range(12))]) for _ in range(40)]
    drift = list(base)
    for i in range(12):  # each like the one before, the last unlike the first
        drift[i * 12] = f"d{i}"
        texts.append(" ".join(drift))
    looked = []
    inner = neardup.verified
    monkeypatch.setattr(neardup, "verified", lambda pairs, rows: looked.append(pairs.count()) or inner(pairs, rows))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = dict(neardup.near_duplicates(docs).collect())
    assert got == dict(enumerate(brute(texts)))
    assert sum(looked) < 8 * len(texts)  # all pairs of the groups would be over 3,600

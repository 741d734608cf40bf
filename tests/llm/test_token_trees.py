"""Stored trees: edits on them give what counting anew gives, and encode only what they touch."""

import random

from tributary.llm import tokencount as tc


def test_trees_are_kept(spark):
    rng = random.Random(2)
    texts = [None, "", "one two  three", "the cat sat on the mat, and " * 3000, "ab 'll\n\n x" * 50]
    docs = spark.createDataFrame([(i, t, ["no", "edits"]) for i, t in enumerate(texts)], "doc_id long, text string, edits array<string>")
    stored, now = tc.trees(docs), {i: t or "" for i, t in enumerate(texts)}
    own = tc.counter()
    for _ in range(3):
        rows = []
        for i, t in now.items():
            s = rng.randrange(len(t) + 1)
            todo = [(s, s + rng.randrange(9), rng.choice(["", " new word", "'s", "\n "])) for _ in range(2)]
            rows.append((i, todo))
            for a, b, new in todo:
                a, b = min(a, len(t)), min(b, len(t))
                t = t[:a] + new + t[b:]
            now[i] = t
        given = spark.createDataFrame(rows, f"doc_id long, changes {tc.EDITS}")
        rows = tc.edit(stored.join(given, "doc_id"), "changes").collect()
        stored = spark.createDataFrame(rows)
        stored = stored.select("doc_id", "text", stored["tree"].cast(tc.TREE).alias("tree"))
        for r in rows:
            assert r.text == now[r.doc_id] and r.n_tokens == len(own.encoding.encode_ordinary(r.text)) and r.n_chars_encoded < 200 + len(r.text) / 50
    null = spark.createDataFrame([(3, [None, (None, None, None)])], f"doc_id long, changes {tc.EDITS}")
    assert tc.edit(stored.join(null, "doc_id"), "changes").first().text == now[3]


def test_follow_takes_no_column_by_its_name(spark):
    docs = spark.createDataFrame([(1, "a b c", ["x"])], "doc_id long, text string, edits array<string>")
    assert tc.follow(docs).first().n_edits == 3
    docs = spark.createDataFrame([(1, "a b c", [(0, 1, "zz")])], f"doc_id long, text string, mine {tc.EDITS}")
    assert tc.follow(docs, "mine").first().n_edits == 1

"""Tables that grow with the input are never broadcast: Spark takes an exploded or compressed one for much less than it is."""

import random

from tributary.llm import components, neardup, simhash
from tributary.llm.common import materialize


def planned(monkeypatch, *modules):
    """Plans of all that the modules write from now on."""
    plans = []

    def kept(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return materialize(df, name)

    for m in modules:
        monkeypatch.setattr(m, "materialize", kept)
    return plans


def test_simhash_broadcasts_nothing(spark, monkeypatch):
    rows = [(i, random.Random(i).getrandbits(64) - (1 << 63)) for i in range(500)]
    rows += [(1000 + i, fp ^ 5) for i, fp in rows[:50]]
    plans = planned(monkeypatch, simhash, components)
    monkeypatch.setattr(simhash, "fingerprints", lambda docs: docs)
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, fp long"))
    plans.append(("result", got._jdf.queryExecution().executedPlan().toString()))
    assert [name for name, p in plans if "Broadcast" in p] == []
    assert {r.component_id for r in got.where("doc_id >= 1000").collect()} == set(range(50))


def test_near_duplicates_broadcast_nothing(spark, monkeypatch):
    r = random.Random(3)
    words = [[f"w{r.randrange(5000)}" for _ in range(60)] for _ in range(60)]
    texts = [" ".join(w) for w in words] + [" ".join([*w[:-1], "x"]) for w in words[:20]]
    plans = planned(monkeypatch, neardup, simhash, components)
    got = neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert plans and [name for name, p in plans if "Broadcast" in p] == []
    assert {(x.doc_id, x.component_id) for x in got.where("doc_id >= 60").collect()} == {(60 + i, i) for i in range(20)}

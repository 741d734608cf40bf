"""The pipeline against its stages run one by one on the driver."""

from tributary.llm import langid, neardup, pii
from tributary.llm.common import materialize

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    extra = [{**r.asDict(), "doc_id": 10_000 + i, "text": t} for i, (r, t) in enumerate(zip(rows, [None, "", "123 456", rows[5].text, "mail me@corp.com " + rows[6].text], strict=False))]
    docs = docs.unionByName(spark.createDataFrame([tuple(x[c] for c in docs.columns) for x in extra], docs.schema))
    outs, at = {}, docs
    for name, stage in cp.STAGES:
        at = materialize(stage(spark, at, SF), name)
        outs[name] = at
    for name, _ in cp.STAGES[:-1]:
        assert outs[name].columns == docs.columns
    kept = {r.doc_id: r.text for r in outs["language_id"].select("doc_id", "text").collect()}
    assert {10_000, 10_001, 10_002} & kept.keys() == set() and len(kept) == len(rows) + 2
    sets = {i: set(neardup.shingles(t).tolist()) for i, t in kept.items()}
    near = {i: [j for j in sets if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])] for i in sets}
    label = {i: i for i in sets}
    for _ in range(10):
        label = {i: min(label[j] for j in near[i]) for i in sets}
    one = {r.doc_id: r.text for r in outs["near_duplicates"].select("doc_id", "text").collect()}
    assert set(one) == set(label.values())
    clean = {r.doc_id: r.text for r in outs["pii"].select("doc_id", "text").collect()}
    assert clean == {i: pii.replace(t)[0] for i, t in one.items()}
    packed = outs["packing"].select("doc_id", "length").collect()
    assert {r.doc_id for r in packed} == set(one)
    assert langid.WORD.findall("a b") == ["a", "b"]


def test_run(spark):
    import corpus_pipeline as cp

    out = cp.run(spark, SF)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0


def test_queries_are_registered():
    import __spark_entry__ as e

    names = list(e.queries())
    assert sum(n.startswith("op") and n[2].isdigit() for n in names) == 10 and "pipeline" in names

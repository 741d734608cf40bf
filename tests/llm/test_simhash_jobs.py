"""op6's components take few Spark jobs, whatever the length of a chain of links."""

import random

from tributary.llm import simhash


def test_chains_take_few_jobs(spark, monkeypatch):
    ids = list(range(64))
    random.Random(5).shuffle(ids)
    rows = [(i, (1 << at) - 1) for at, i in enumerate(ids)]  # neighbours differ in one bit
    monkeypatch.setattr(simhash, "fingerprints", lambda docs: docs)
    spark.sparkContext.setJobGroup("chain", "")
    try:
        got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, fp long"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain"))
    assert {(r.doc_id, r.component_id) for r in got.collect()} == {(i, 0) for i in ids}
    assert jobs < 30, jobs

"""Python workers hold few texts at once and give memory back between operators."""

import re
from pathlib import Path

from pyspark.sql import functions as F

from tributary.llm import common


def held() -> float:
    """MB of this process's own memory."""
    return int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024


def test_what_is_forgotten_goes_back():
    pins = []

    def make():
        blocks = [b"x" * 96_000 for _ in range(2_500)]
        pins.append(b"y" * 96_000)  # stands behind them: their space is free, but not at the heap's end
        return blocks

    before = held()
    common.only("blocks", make)
    assert held() > before + 200
    common.only("next", list)
    assert held() < before + 60
    common.forget()


def test_few_values_at_once(spark):
    sizes = common.map_values("int", lambda: lambda values: [None if v is None else len(values) for v in values], rows=300)
    rows = spark.range(0, 1000, 1, 1).select("id", F.when(F.col("id") != 7, F.col("id").cast("string")).alias("text"))
    got = {r.id: r.n for r in rows.withColumn("n", sizes("text")).collect()}
    assert got == {i: None if i == 7 else 300 if i < 900 else 100 for i in range(1000)}
    assert rows.limit(0).withColumn("n", sizes("text")).collect() == []

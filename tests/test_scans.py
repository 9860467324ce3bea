"""Values carried over buckets and runs of buckets against a plain scan."""

import random

import pytest

from tallgene.sources import io


@pytest.mark.parametrize("fan,lines", [(4, 3), (1 << 17, 4096), (9, 1)])
def test_carry_forward(spark, fan, lines, monkeypatch):
    monkeypatch.setattr(io, "FAN", fan)
    monkeypatch.setattr(io, "LINES_PER_BUCKET", lines)
    rng, now, want = random.Random(fan), None, {}
    rows = [(i, rng.choice("abc") if rng.random() < 0.03 else None) for i in range(150) if rng.random() < 0.9]
    for i, v in rows:
        now = v if v is not None else now
        want[i] = now
    df = spark.createDataFrame(rows, "line_no long, chrom string").repartition(5)
    out = io.carry_forward(df, "line_no", "chrom")
    assert {r["line_no"]: r["chrom"] for r in out.collect()} == want
    assert io.carry_forward(df.limit(0), "line_no", "chrom").count() == 0


def test_no_window_without_partition(spark):
    df = spark.createDataFrame([(1, "a")], "_bk long, _last string")
    plan = io.carried(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 3 and plan.count("[_run") >= 3

"""What the findings of round 4 say of the corpus operators, each on a case that failed before."""

from __future__ import annotations

import numpy as np

from ortholens.llm import pivot_search


def test_copies_of_queries_are_not_broadcast(spark, monkeypatch):
    """queries, small as they stand, were broadcast once for every block of vectors."""
    for name, v in {"FEW": 8, "BLOCK": 16, "QUERIES": 4}.items():
        monkeypatch.setattr(pivot_search, name, v)
    rnd = np.random.default_rng(3)
    rows = spark.createDataFrame([(k, rnd.normal(size=8).tolist()) for k in range(300)], "vec_id long, embedding array<double>")
    found = pivot_search.top_scores(rows, sample=40)
    assert len(found.collect()) == 30
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan

"""Counts of phrases within a task: merged by ranges, and summed in one place only."""

import re
from collections import Counter

import numpy as np
import pytest

from starfold.llm import collocations as C


def test_a_tally_counts_whatever_is_merged():
    rng = np.random.default_rng(1)
    tally, want, got = C._Tally(), Counter(), Counter()
    for k in range(40):
        grams = (rng.integers(0, 300, 200).astype(np.uint64) << np.uint64(39)) | np.uint64(k % 10)
        tally.add(*np.unique(grams, return_counts=True))
        want.update(grams.tolist())
        if k % 7 == 6:
            tally.merge()
            assert tally.merged == len(set().union(*[k.tolist() for held in tally.ranges for k, _ in held])) and all(len(held) < 2 for held in tally.ranges)
        if k == 25:
            for batch in tally.batches():
                got.update(dict(zip(*(c.to_pylist() for c in batch.columns), strict=True)))
            assert tally.merged == 0 and not any(tally.ranges) and got == want
    last = [dict(zip(*(c.to_pylist() for c in b.columns), strict=True)) for b in tally.batches()]
    for b in last:
        got.update(b)
    keys = [k for b in last for k in b]
    assert got == want and keys == sorted(keys) and len({k >> 44 for k in keys}) > 1


@pytest.mark.parametrize("held,gathered", [(3_000_000, 500_000), (50, 10)])
def test_tasks_send_their_counts_on_without_a_second_table(spark, monkeypatch, held, gathered):
    monkeypatch.setattr(C, "HELD", held)
    monkeypatch.setattr(C, "GATHERED", gathered)
    monkeypatch.setattr(C, "FILTER_BITS", 20)
    plans, kept = [], C.materialize
    monkeypatch.setattr(C, "materialize", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df))
    texts = [("en", f"the old house {i % 7} stands by the river, the old house sleeps") for i in range(60)]
    found, _ = C.frequent_phrases(spark.createDataFrame(texts, "lang string, text string").repartition(6), 30, 3)
    got = {r["phrase"]: r["f"] for r in found.collect()}
    assert got["the old house"] == 120 and got["river"] == 60 and got["the"] == 180 and got["by the river"] == 60 and "house 1" not in got
    for plan in plans[:3]:
        below = plan[plan.index("Exchange hashpartitioning(gram") :]
        assert re.search(r"MapInArrow", below) and "HashAggregate" not in below

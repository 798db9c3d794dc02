"""A source far below one block of the mix beside a huge one."""

import collections

import pytest

from barlab.llm import mixing


def test_tiny_source_beside_a_huge_one(spark, monkeypatch):
    # as few blocks as this gives the tiny source a tenth of a block, as 30 GB of words do with the default
    monkeypatch.setattr(mixing.block_plan, "__defaults__", (32, *mixing.block_plan.__defaults__[1:]))
    rows = [(i, " ".join(f"w{j}" for j in range(97)), "huge") for i in range(1000)] + [(2000 + i, "a few words of a small source", "tiny") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    taken, target = collections.Counter(), {}
    for r in mixing.taken_words(docs).collect():
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert set(target) == {"huge", "tiny"}
    for s in target:
        assert taken[s] == pytest.approx(target[s], abs=1)
    mixed = collections.Counter()
    for r in mixing.mix(docs).collect():
        mixed[r.source] += len(r.text.split())
    assert mixed == taken

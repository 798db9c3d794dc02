"""Fingerprints of a group of near copies that holds a third of the rows."""

import random
from statistics import mean

from barlab.llm import imatch


def test_large_group_of_edited_copies(spark):
    draw = random.Random(3)
    vocabulary = [f"v{i}" for i in range(3000)]
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(300):
        if i < 100:
            words = [draw.choice(vocabulary) if draw.random() < 0.03 else w for w in base]
        else:
            words = [draw.choice(vocabulary) for _ in range(200)]
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(f"c{j}" for j in range(150))) for i in range(60)]  # exact copies
    got = {r.doc_id: r for r in imatch.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    group = [got[i] for i in range(99)]
    assert mean(r.near_next for r in group) > 0.6 and min(r.near_next for r in group) > 0.2
    assert mean(r.near_edited for r in group) > 0.15
    assert all(got[1000 + i].near_next == 1 for i in range(59))
    assert mean(got[i].near_next for i in range(100, 299)) < 0.05

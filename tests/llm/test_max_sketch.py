"""Ranked search against plain Python over all documents and items."""

import math
import random
import re
from collections import Counter

import pytest

from barlab.llm import max_sketch

DOCS = "doc_id long, text string, n long, row long, score long, item_id long"
ITEMS = "item_id long, text string, rank long, term long"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held(text):
    return Counter(TERM.findall((text or "").translate(FOLD)))


def plain(docs, items):
    sets = [(doc, c, c.total()) for doc, text in docs if (c := held(text))]
    n_docs, n_terms = len(sets), sum(n for _, _, n in sets)
    df = Counter(t for _, c, _ in sets for t in c)
    out = []
    for item, text in dict.fromkeys((i, t or "") for i, t in items):
        scores = []
        for doc, c, n in sets:
            m = 25 + (75 * n * n_docs) // n_terms
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, q in held(text).items() if t in c)
            if score > 0:
                scores.append((-score, math.inf if doc is None else doc))
        out += [(item, k, doc, -s) for k, (s, doc) in enumerate(sorted(scores)[:10], 1)]
    return sorted((i, k, -1 if d in (None, math.inf) else d, s) for i, k, d, s in out)


def found(spark, docs, items):
    left = spark.createDataFrame([(d, t, 1, 2, 3, 4) for d, t in docs], DOCS)
    right = spark.createDataFrame([(i, t, 1, 2) for i, t in items], ITEMS)
    rows = max_sketch.search(left.repartition(3), right).collect()
    return sorted((r.item_id, r["rank"], -1 if r.doc_id is None else r.doc_id, r.score) for r in rows)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)] + ["The", "THE", "é", "Éa", "x\x85y", "a_b", "n\x00m", "ﬁ"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(i, text(rng.randint(1, 150))) for i in range(300)]
    docs += [(300 + i, docs[7][1]) for i in range(120)]  # a large group of copies: ties by doc_id
    docs += [(500, None), (501, ""), (502, " ., "), (None, docs[7][1]), (7, docs[7][1]), (7, "the the"), (503, "the " * 3000), (504, " ".join(f"v{i}" for i in range(20_000)) + " w1 w2")]
    items = [(i, text(30)) for i in range(12)] + [(20, None), (21, "?!"), (22, docs[7][1]), (22, docs[7][1]), (22, "w1 w1 w2"), (23, "unseen"), (24, "the THE w5")]
    return docs, items


def test_equals_plain_python(spark, tables):
    assert found(spark, *tables) == plain(*tables)


def test_many_blocks_give_the_same(spark, tables, monkeypatch):
    monkeypatch.setattr(max_sketch, "BLOCK_ITEMS", 4)
    monkeypatch.setattr(max_sketch, "CELLS", 4096)
    assert found(spark, *tables) == plain(*tables)


def test_bounds_are_never_below_scores(tables):
    docs, items = tables
    block = max_sketch.Block()
    for number, (item, text) in enumerate(items):
        if c := held(text):
            block.add(number, item, Counter({t.encode(): n for t, n in c.items()}))
    counts = [Counter(max_sketch.terms((t or "").encode())) for _, t in docs]
    counts = [c for c in counts if c]
    df = [sum(t in c for c in counts) for t in block.terms]
    scorer = max_sketch.Scorer(block, df, len(counts), sum(c.total() for c in counts))
    scorer.prepare()
    import numpy as np

    bounds = scorer.bounds(np.array([c.total() for c in counts]), np.array([max(c.values()) for c in counts]), [max_sketch.sketch(c) for c in counts])
    for row, c in zip(bounds, counts, strict=True):
        assert (row >= scorer.exact(c.total(), b" ".join(c.elements()))).all()


def test_empty_tables(spark, tables):
    docs, items = tables
    assert found(spark, [], items) == []
    assert found(spark, docs, []) == []
    assert found(spark, [(1, None)], items) == []

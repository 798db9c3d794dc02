"""The near-duplicate stage of the pipeline: its threshold, and rows that share a doc_id."""

import corpus_pipeline

SCHEMA = "doc_id long, text string, source string"


def _text(tag, n=400):
    return [f"{tag}{i}" for i in range(n)]


def _edited(words, at):
    out = list(words)
    for i in at:
        out[i] = f"x{i}"
    return out


def _similarity(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
    return len(x & y) / len(x | y)


def _kept(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    return sorted((r.doc_id is None, r.doc_id or 0, r.text or "", r.source) for r in out.collect())


def test_groups_from_four_fifths_on(spark):
    rows = []
    for k in range(6):
        near, far = _text(f"a{k}_"), _text(f"b{k}_")
        close, apart = _edited(near, range(10, 400, 51)), _edited(far, range(10, 400, 40))
        assert 0.81 < _similarity(near, close) < 0.84 and _similarity(far, apart) < 0.79
        rows += [(4 * k + i, " ".join(w), "s") for i, w in enumerate((near, close, far, apart))]
    assert [d for _, d, _, _ in _kept(spark, rows)] == [i for i in range(24) if i % 4 != 1]


def test_different_texts_under_one_id(spark):
    a, b, c = (" ".join(_text(t, 60)) for t in "abc")
    rows = [(1, a, "s"), (5, a, "s"), (5, b, "s"), (5, c, "s"), (6, c, "s"), (7, b, "s"), (8, "", "s"), (8, "", "s"), (9, "", "s"), (9, None, "s"), (None, a, "s"), (None, a, "s")]
    assert _kept(spark, rows) == [
        (False, 1, a, "s"), (False, 5, b, "s"), (False, 5, c, "s"), (False, 8, "", "s"), (False, 9, "", "s"), (True, 0, a, "s"), (True, 0, a, "s"),
    ]

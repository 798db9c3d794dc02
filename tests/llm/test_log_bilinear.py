"""Language-model scores: counts and base scores against plain Python, the model against its definition."""

import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from barlab.llm import log_bilinear as lm

SCHEMA = "doc_id long, text string, row long, word string, n long, known long"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held(doc):
    return crc32(("" if doc is None else str(doc)).encode()) % 10 == 0


def words(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD)), ""]


def plain(docs):
    c = Counter(w for doc, text in docs if not held(doc) for w in words(text))
    n, v = c.total(), len(c)
    out = []
    for doc, text in docs:
        ws = words(text)
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        out.append((doc, held(doc), len(ws), sum(c[w] > 0 for w in ws), n, round(base, 6)))
    return sorted(out, key=str)


def found(spark, docs):
    df = spark.createDataFrame([(d, t, 1, "w", 2, 3) for d, t in docs], SCHEMA)
    return lm.score(df.repartition(3)).collect()


def counted(rows):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows), key=str)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(4)
    talk = [[f"{a}{e}" for a in "bcdfgh" for e in ("ing", "ed", "ly.", "tion,")], [f"{a}{e}" for a in "klmnpr" for e in ("eaux", "ier", "ment,", "é")]]
    text = lambda: " ".join(rng.choice(talk[k]) for k in [rng.randint(0, 1)] for _ in range(rng.randint(5, 120)))
    out = [(i, text()) for i in range(400)]
    out += [(1000 + i, out[3][1]) for i in range(150)]
    return [*out, (2000, None), (2001, ""), (2002, " \n\x0b "), (2003, "Only ONCE\x85here"), (2004, "ĀÉ É é"), (None, out[0][1]), (7, "again seven"), (7, out[7][1]), (2005, "long " * 30_000)]


@pytest.fixture(scope="module")
def scored(spark, docs):
    return found(spark, docs)


def test_counts_and_base_equal_plain_python(docs, scored):
    assert counted(scored) == plain(docs)


def test_rare_words_meet_their_counts_by_the_join(spark, docs, monkeypatch):
    monkeypatch.setattr(lm, "TOP", 30)
    rows = found(spark, docs)
    assert counted(rows) == plain(docs)
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)


def test_model_beats_single_tokens_on_held_out_texts(scored):
    rows = [r for r in scored if r.held_out]
    assert len(rows) > 20
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_same_texts_have_the_same_score(scored):
    copies = [r.score for r in scored if r.doc_id is not None and 1000 <= r.doc_id < 1150]
    assert max(copies) - min(copies) < 1e-6


def test_probabilities_add_up_to_one():
    rng = np.random.default_rng(0)
    p = {k: rng.normal(0, 0.5, shape).astype(np.float32) for k, shape in lm._SHAPES.items()}
    before = rng.integers(0, lm.CLASSES, lm.CONTEXT)
    each = []
    for c in range(lm.CLASSES):
        line, at = lm.stream([np.array([*before, c], "<u2").tobytes()])
        each.append(lm.log_probabilities(p, line, at[-1:])[0])
    assert math.isclose(np.exp(each).sum(), 1, rel_tol=1e-5)
    line, at = lm.stream([np.array([*before, 5], "<u2").tobytes()])
    h = sum(p["context"][before[::-1][i]] * p["place"][i] for i in range(lm.CONTEXT))
    scores = p["target"] @ h + p["bias"]
    assert math.isclose(lm.log_probabilities(p, line, at[-1:])[0], scores[5] - math.log(np.exp(scores.astype(float)).sum()), rel_tol=1e-4)


def test_a_step_follows_the_gradient():
    """One small step raises the noise-contrastive objective."""
    rng = np.random.default_rng(1)
    p = {k: rng.normal(0, 0.3, shape).astype(np.float32) for k, shape in lm._SHAPES.items()}
    p |= {f"{k}_sum": np.full(shape, 1e6, np.float32) for k, shape in lm._SHAPES.items()}  # tiny, almost plain steps
    line, at = lm.stream([rng.integers(0, lm.CLASSES, 300).astype("<u2").tobytes()])
    noise = rng.integers(0, lm.CLASSES, lm.NOISE)
    ln = np.full(lm.CLASSES, math.log(lm.NOISE / lm.CLASSES), np.float32)

    def objective():
        h = lm.predicted(p, line, at).astype(float)
        t = line[at]
        data = (h * p["target"][t]).sum(1) + p["bias"][t] - ln[t]
        other = h @ p["target"][noise].T + p["bias"][noise] - ln[noise]
        return -np.log1p(np.exp(-data)).mean() - np.log1p(np.exp(other)).sum(1).mean()

    first = objective()
    for _ in range(20):
        lm.step(p, line, at, noise, ln)
    assert objective() > first


def test_little_tables(spark):
    assert found(spark, []) == []
    none = [(d, t) for d, t in [(i, "a b") for i in range(200)] if held(d)]
    rows = found(spark, none)
    assert counted(rows) == plain(none)
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.score < 0 for r in rows)


@pytest.mark.parametrize("n", [1, 3, 4, 1001])
def test_the_rounds_cover_every_token_once(n):
    at = np.arange(5, 5 + n)
    seen = [lm.round_share(at, turn, np.random.default_rng((n, turn))) for turn in range(lm.ROUNDS)]
    assert sorted(np.concatenate(seen).tolist()) == at.tolist()


def test_gradients_equal_those_of_single_tokens():
    """The summed context vectors and place weights of a step, token by token."""
    rng = np.random.default_rng(2)
    p = {k: rng.normal(0, 0.3, shape).astype(np.float32) for k, shape in lm._SHAPES.items()}
    p |= {f"{k}_sum": np.full(shape, 1e-20, np.float32) for k, shape in lm._SHAPES.items()}
    line, at = lm.stream([rng.integers(0, lm.CLASSES, 200).astype("<u2").tobytes()])
    noise, ln = rng.integers(0, lm.CLASSES, lm.NOISE), np.zeros(lm.CLASSES, np.float32)
    context, place = np.zeros(lm._SHAPES["context"]), np.zeros(lm._SHAPES["place"])
    before = {k: v.astype(float) for k, v in p.items()}
    for j in at:
        h = sum(before["context"][line[j - 1 - i]] * before["place"][i] for i in range(lm.CONTEXT))
        sigmoid = lambda c: 1 / (1 + np.exp(-(before["target"][c] @ h + before["bias"][c])))
        dh = (1 - sigmoid(line[j])) * before["target"][line[j]] - sum(sigmoid(c) * before["target"][c] for c in noise)
        for i in range(lm.CONTEXT):
            context[line[j - 1 - i]] += dh * before["place"][i]
            place[i] += dh * before["context"][line[j - 1 - i]]
    lm.step(p, line, at, noise, ln)
    assert np.allclose(p["context_sum"], (context / len(at)) ** 2, rtol=1e-3, atol=1e-8)
    assert np.allclose(p["place_sum"], (place / len(at)) ** 2, rtol=1e-3, atol=1e-8)

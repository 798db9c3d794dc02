"""Language-model scores of texts by a class-based log-bilinear model, fitted by noise-contrastive estimation.

Words are counted over all training texts. A word belongs to one class: the end
of a text and the most frequent words are classes of their own, the others
share one by their ending (last three bytes before trailing punctuation, and
whether there is any). The model predicts the class of each token from the
classes of the four tokens before it: their vectors, weighted by position, add
up to a predicted vector, and its products with the class vectors (plus a bias)
are the classes' scores. One softmax over all classes, from a batched matrix
product, normalises them. Within its class a token has its smoothed share, so
the probabilities of all known tokens and one unknown token a class add up to one.

Training is noise-contrastive with noise from the class frequencies, in numpy
inside the tasks: four rounds cover every training token once, each task steps
through its share of the round from common parameters, and these are averaged
by tokens between rounds.

Counts of the most frequent words (131,072 at most) go to every task; rarer
words meet their counts by a join on the word.

Defined cases: a null or blank text is its end token alone; without doc_id a
row is held out; rows that share a doc_id are scored each by itself; without
training texts every token is unknown, the base score is 0 for each and the
model is the uniform one over classes; an empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlab.llm.common import staged, whole

#: Words whose counts go to every task (about 2 MB).
TOP = 131_072
#: Classes: the end of a text, frequent words, endings.
OWN, ENDINGS = 127, 128
CLASSES = 1 + OWN + ENDINGS
CONTEXT, WIDTH, NOISE = 4, 32, 64
ROUNDS, BATCH, RATE = 4, 2_048, 0.1
#: Smoothing, and the share of held-out documents, as the contract fixes them.
ADD, HELD = 0.1, 10
#: Words held by a counting task, tokens held by a training or scoring step, groups that parameters are summed in.
HOLD, STEP, SLOTS = 200_000, 1_000_000, 16
#: Tokens a matrix product; below this score exponentials need no shift.
_SCORED, _SAFE = 512, 60
_START = CLASSES
_SHAPES = {"context": (CLASSES + 1, WIDTH), "place": (CONTEXT, WIDTH), "target": (CLASSES, WIDTH), "bias": (CLASSES,)}
_PUNCTUATION = bytes([*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)])
_END = b""


def tokens(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text, A-Z in lower case."""
    return text.lower().split()


def ending(word: bytes) -> int:
    """The class of a word without one of its own."""
    core = word.rstrip(_PUNCTUATION)
    return 1 + OWN + crc32(core[-3:], len(core) < len(word)) % ENDINGS


def _texts(docs: DataFrame) -> DataFrame:
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.crc32(key) % HELD == 0).alias("held_out"), whole().cast("binary").alias("text"))


def count_words(texts: DataFrame) -> DataFrame:
    """How often each token occurs in the training texts; the empty word is the end of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        held: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch["text"].to_pylist():
                held.update(tokens(text))
                held[_END] += 1
                if len(held) > HOLD:
                    yield flushed()
        yield flushed()

    counts = texts.where("not held_out").select("text").mapInArrow(run, "word binary, n long")
    return staged(counts.groupBy("word").agg(F.sum("n").alias("n")), "word-counts")


@dataclass
class Vocabulary:
    """Corpus totals, the most frequent words with their counts, and the totals of each class."""

    total: int
    distinct: int
    words: list[bytes]
    counts: np.ndarray
    in_class: np.ndarray
    class_words: np.ndarray

    def own(self) -> dict[bytes, int]:
        """Words that are classes of their own."""
        order = [w for w in self.words if w != _END]
        return {_END: 0} | {w: 1 + i for i, w in enumerate(order[:OWN])}

    def noise(self) -> np.ndarray:
        share = self.in_class + ADD * (self.class_words + 1)
        return share / share.sum()


def vocabulary(counts: DataFrame) -> Vocabulary:
    total, distinct = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    # a cut between counts that leaves at most TOP words: sixteenths of octaves, so a few hundred rows at most
    grade = F.floor(F.log2("n") * 16)
    cut, held = None, 0
    for row in sorted(counts.groupBy(grade.alias("g")).count().collect(), reverse=True):
        held += row["count"]
        if held > TOP:
            break
        cut = row.g
    found = [] if cut is None else [(-r.n, bytes(r.word)) for r in counts.where((grade >= cut) | (F.length("word") == 0)).collect()]
    found.sort()
    out = Vocabulary(total or 0, distinct, [w for _, w in found], np.array([-n for n, _ in found], np.int64), np.zeros(CLASSES), np.zeros(CLASSES))
    own = out.own()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for batch in batches:
            words = batch["word"].to_pylist()
            at = np.array([own[w] if w in own else ending(w) for w in words], np.int64)
            np.add.at(n, at, batch["n"].to_numpy())
            v += np.bincount(at, minlength=CLASSES)
        at = np.flatnonzero(v)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), pa.array(v[at])], names=["c", "n", "v"])

    for row in counts.mapInArrow(run, "c long, n long, v long").groupBy("c").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():  # one row a class
        out.in_class[row.c], out.class_words[row.c] = row.n, row.v
    return out


_ENCODED = "doc_id long, held_out boolean, n_tokens long, known long, logs double, inner double, ids binary, rare array<binary>, times array<int>"


def encode(texts: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Every text as class numbers, with what its frequent words add to the scores and its rarer words with their counts."""
    own = vocab.own()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {w: i for i, w in enumerate(vocab.words)}
        classes = np.array([own[w] if w in own else ending(w) for w in vocab.words], np.int64)
        single = np.arange(CLASSES) <= OWN
        divisor = np.where(single, 0.0, np.log(vocab.in_class + ADD * (vocab.class_words + 1)))
        logs = np.log(vocab.counts + ADD)
        inner = np.where(single[classes], 0.0, logs)
        memo: dict[bytes, int] = {}
        unknown_end = math.log(ADD)
        names = [c.split()[0] for c in _ENCODED.split(", ")]
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32())]
        for batch in batches:
            rows = []
            for doc, held, text in zip(batch["doc_id"].to_pylist(), batch["held_out"].to_pylist(), batch["text"].to_pylist(), strict=True):
                words = [*tokens(text), _END]
                at = np.array([place.get(w, -1) for w in words], np.int64)
                ids = classes[at] if len(classes) else np.zeros(len(at), np.int64)
                known = at[at >= 0]
                rare = []
                for i in np.flatnonzero(at < 0).tolist():
                    w = words[i]
                    if (c := memo.get(w)) is None:
                        if len(memo) > HOLD:
                            memo.clear()
                        c = memo[w] = ending(w) if w else 0
                    ids[i] = c
                    if w:
                        rare.append(w)
                times = Counter(rare)
                own_end = 0.0 if at[-1] >= 0 else unknown_end  # only without any training text
                rows.append((
                    doc, held, len(words), len(known), logs[known].sum() + own_end, inner[known].sum() - divisor[ids].sum(),
                    ids.astype("<u2").tobytes(), list(times.keys()), list(times.values()),
                ))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return staged(texts.mapInArrow(run, _ENCODED).withColumn("row", F.monotonically_increasing_id()), "encoded")


Parameters = dict[str, np.ndarray]


def start(vocab: Vocabulary) -> Parameters:
    """Small vectors and the class frequencies as biases, which is the model of independent tokens."""
    rng = np.random.default_rng(20240607)
    out = {k: rng.normal(0, 0.1, shape).astype(np.float32) for k, shape in _SHAPES.items()}
    out["place"] += 1
    out["bias"] = np.log(vocab.noise()).astype(np.float32)
    return out | {f"{k}_sum": np.full(shape, 1e-6, np.float32) for k, shape in _SHAPES.items()}


def _flat(p: Parameters) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def _unflat(flat: np.ndarray, like: Parameters) -> Parameters:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def stream(sequences: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sequences behind each other with start marks between them, and the places of their tokens."""
    mark = np.full(CONTEXT, _START, "<u2").tobytes()
    line = np.frombuffer(b"".join([x for s in sequences for x in (mark, s)]), "<u2").astype(np.int64)
    return line, np.flatnonzero(line != _START)


def placed(p: Parameters) -> list[np.ndarray]:
    """The context vectors as each place before a token weighs them."""
    return [p["context"] * p["place"][i] for i in range(CONTEXT)]


def predicted(p: Parameters, line: np.ndarray, at: np.ndarray, weighed: list[np.ndarray] | None = None) -> np.ndarray:
    """Predicted vectors of the tokens at these places; ``weighed`` are the ``placed`` vectors where they are at hand."""
    weighed = placed(p) if weighed is None else weighed
    out = weighed[0][line[at - 1]]
    for i in range(1, CONTEXT):
        out += weighed[i][line[at - 1 - i]]
    return out


def _scatter(size: int, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Rows of ``values`` summed by number."""
    out = np.zeros((size, *values.shape[1:]), np.float32)
    order = np.argsort(at.astype(np.uint16), kind="stable")
    rising = at[order]
    first = np.flatnonzero(np.concatenate([[True], rising[1:] != rising[:-1]]))
    out[rising[first]] = np.add.reduceat(values[order], first, axis=0)
    return out


def step(p: Parameters, line: np.ndarray, at: np.ndarray, noise: np.ndarray, log_noise: np.ndarray) -> None:
    """One step of noise-contrastive estimation over the tokens at these places; ``log_noise`` is ln(k p) of each class."""
    target = line[at]
    h = predicted(p, line, at)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    of_target, of_noise = p["target"][target], p["target"][noise]
    data = 1 - sigmoid((h * of_target).sum(1) + p["bias"][target] - log_noise[target])
    other = -sigmoid(h @ of_noise.T + p["bias"][noise] - log_noise[noise])
    dh = data[:, None] * of_target + other @ of_noise
    grads = {"target": _scatter(CLASSES, target, data[:, None] * h), "bias": _scatter(CLASSES, target, data)}
    np.add.at(grads["target"], noise, other.T @ h)
    np.add.at(grads["bias"], noise, other.sum(0))
    grads["context"] = np.zeros_like(p["context"])
    grads["place"] = np.zeros_like(p["place"])
    for i in range(CONTEXT):
        sums = _scatter(CLASSES + 1, line[at - 1 - i], dh)
        grads["context"] += sums * p["place"][i]
        grads["place"][i] = (sums * p["context"]).sum(0)
    for k, g in grads.items():
        g /= len(at)
        p[f"{k}_sum"] += g * g
        p[k] += RATE * g / np.sqrt(p[f"{k}_sum"])


def log_probabilities(p: Parameters, line: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Normalised natural log-probabilities of the classes at these places."""
    out = np.empty(len(at))
    ones = np.ones(CLASSES, np.float32)
    weighed = placed(p)
    longest, highest = math.sqrt(float((p["target"] ** 2).sum(axis=1).max())), float(np.abs(p["bias"]).max())
    for cut in range(0, len(at), _SCORED):
        part = at[cut : cut + _SCORED]
        h = predicted(p, line, part, weighed)
        scores = h @ p["target"].T
        scores += p["bias"]
        if longest * math.sqrt(float((h * h).sum(axis=1).max())) + highest > _SAFE:
            scores -= scores.max(axis=1, keepdims=True)
        chosen = scores[np.arange(len(part)), line[part]].astype(np.float64)
        np.exp(scores, out=scores)
        out[cut : cut + len(part)] = chosen - np.log(scores @ ones)
    return out


def _pieces(sequences: list[bytes], size: int = STEP) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Streams of about ``size`` tokens; a longer sequence is one stream."""
    held, n = [], 0
    for s in sequences:
        held.append(s)
        n += len(s) // 2
        if n >= size:
            yield stream(held)
            held, n = [], 0
    if held:
        yield stream(held)


def round_share(at: np.ndarray, turn: int, rng: np.random.Generator) -> np.ndarray:
    """The places a round trains on, in random order; every place is in exactly one round."""
    return rng.permutation(at[turn::ROUNDS])


def train(encoded: DataFrame, vocab: Vocabulary) -> Parameters:
    """Parameters after all rounds over the training texts."""
    p = start(vocab)
    if not vocab.total:
        return p
    share = vocab.noise()
    log_noise = np.log(NOISE * share).astype(np.float32)
    bounds = np.cumsum(share)

    def trained(now: Parameters, turn: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, seen = {k: v.copy() for k, v in now.items()}, 0
            for batch in batches:
                for line, at in _pieces(batch["ids"].to_pylist()):
                    rng = np.random.default_rng((len(at), turn))
                    at = round_share(at, turn, rng)
                    for cut in range(0, len(at), BATCH):
                        noise = np.minimum(np.searchsorted(bounds, rng.random(NOISE)), CLASSES - 1)
                        step(own, line, at[cut : cut + BATCH], noise, log_noise)
                    seen += len(at)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([seen]), pa.array([_flat(own).tobytes()], pa.binary())], names=["weight", "p"])

        return run

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight = 0.0, 0
        for batch in batches:
            for w, flat in zip(batch["weight"].to_pylist(), batch["p"], strict=True):
                total = total + w * np.frombuffer(flat.as_buffer(), np.float32).astype(np.float64)
                weight += w
        if weight:
            yield pa.RecordBatch.from_arrays([pa.array([weight]), pa.array([total.tobytes()], pa.binary())], names=["weight", "p"])

    texts = encoded.where("not held_out").select("ids")
    for turn in range(ROUNDS):
        shares = texts.mapInArrow(trained(p, turn), "weight long, p binary").withColumn("task", F.spark_partition_id())
        grouped = shares.repartition(SLOTS, F.col("task") % SLOTS).sortWithinPartitions("task").select("weight", "p")
        parts = grouped.mapInArrow(summed, "weight long, p binary").collect()  # SLOTS rows at most, half a megabyte each
        weight = sum(r.weight for r in parts)
        if not weight:
            break
        p = _unflat(sum(np.frombuffer(r.p) for r in parts) / weight, p)
    return p


def _class_scores(encoded: DataFrame, p: Parameters) -> DataFrame:
    """Each text's summed log-probabilities of classes."""
    names = ["row", "doc_id", "held_out", "n_tokens", "known", "logs", "inner"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for line, at in _pieces(batch["ids"].to_pylist(), STEP // 4):
                found = log_probabilities(p, line, at)
                starts = np.flatnonzero(line[at - 1] == _START)  # a text's first token follows a mark
                sums.append(np.add.reduceat(found, starts))
            total = np.concatenate(sums) if sums else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in names], pa.array(total)], names=[*names, "classes"])

    schema = "row long, doc_id long, held_out boolean, n_tokens long, known long, logs double, inner double, classes double"
    return encoded.select(*names, "ids").mapInArrow(run, schema)


def score(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` of every text."""
    texts = _texts(docs)
    counts = count_words(texts)
    vocab = vocabulary(counts)
    encoded = encode(texts, vocab)
    scored = _class_scores(encoded, train(encoded, vocab))

    pairs = encoded.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    met = pairs.join(counts, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarer = met.groupBy("row").agg(
        F.sum(F.col("times") * F.log(F.col("n") + F.lit(ADD))).alias("rare_logs"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rare_known")
    )
    logs, n = F.coalesce("rare_logs", F.lit(0.0)), F.col("n_tokens")
    each = math.log(vocab.total + ADD * (vocab.distinct + 1))
    return scored.join(rarer, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(vocab.total).cast("long").alias("train_tokens"),
        ((F.col("logs") + logs - n * F.lit(each)) / math.log(10)).alias("base_score"), ((F.col("classes") + F.col("inner") + logs) / math.log(10)).alias("score"),
    )

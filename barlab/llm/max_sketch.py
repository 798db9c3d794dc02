"""Ranked lexical search over hashed max-sketches of documents.

A document folds into a power-of-two row of buckets, two to four for each of
its distinct terms: a term's hash picks the bucket, the bucket keeps the
largest count of its terms. A term's impact rises with its count in the
document, so a bucket's largest count stands for its largest impact and the
sketch depends neither on corpus statistics nor on queries. Counts of 255 and
more read as the document's largest count.

Queries go in blocks of bounded size. For a block, a task looks all its query
terms up in the sketches of an Arrow batch and one matrix product gives each
document's upper bound for each item (whole numbers far below 2^53, so doubles
are exact). A first pass keeps the ten highest bounds an item; the exact scores
of those documents give a floor under its tenth best score. A second pass goes
through each item's documents by descending bound and scores whole texts
exactly until the bound falls below the floor, or below the tenth best score
that the task has seen. No document whose score can matter is left out.

Defined cases: a null or empty text holds no terms and is never found nor
counted; an item without terms has no rows; rows of a document or of a
benchmark are ranked each by itself where a doc_id repeats, and equal scores
go by ascending doc_id, null last, then in any order; repeated rows of
``benchmark`` (item_id and text) are one item, rows that share only the
item_id are ranked separately; empty tables give an empty result. Other columns
are not read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlab.llm.common import staged, whole

TOP = 10
#: Query terms times items of a block, and items of a block: 8 MB of weights for each sketch width.
BLOCK_CELLS = 1_000_000
BLOCK_ITEMS = 4_096
#: Sketch cells that are unfolded at a time.
CELLS = 2_000_000
_FULL = 255
_INDEX = "doc_id long, n long, most long, sketch binary, text binary"

# The bytes that separate terms, and A to Z in lower case.
_BETWEEN = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
_FOLD = bytes(0x20 if b in set(_BETWEEN) else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text in order."""
    return text.translate(_FOLD).split()


def sketch(counts: Counter[bytes]) -> bytes:
    """Bucketwise largest counts of a document's terms."""
    width = 1 << max(6, (2 * len(counts) - 1).bit_length())
    row = np.zeros(width, np.uint8)
    places = np.fromiter(map(crc32, counts), np.uint32, len(counts)) & np.uint32(width - 1)
    np.maximum.at(row, places, np.minimum(np.fromiter(counts.values(), np.int64, len(counts)), _FULL).astype(np.uint8))
    return row.tobytes()


def build_index(docs: DataFrame) -> DataFrame:
    """Sketches of all documents with at least one term, beside their number of terms and their text; written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                counts = Counter(terms(text))
                if counts:
                    rows.append((doc, counts.total(), max(counts.values()), sketch(counts), text))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64()] * 3 + [pa.binary()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n", "most", "sketch", "text"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().cast("binary").alias("text"))
    return staged(texts.mapInArrow(run, _INDEX).withColumn("row", F.monotonically_increasing_id()), "sketches")


@dataclass
class Block:
    """Items that are searched together: their terms, and how often an item holds each."""

    items: list[tuple[int, int | None]] = field(default_factory=list)
    terms: dict[bytes, int] = field(default_factory=dict)
    cells: list[tuple[int, int, int]] = field(default_factory=list)

    def add(self, number: int, item_id: int | None, counts: Counter[bytes]) -> None:
        at = len(self.items)
        self.items.append((number, item_id))
        for term, n in counts.items():
            self.cells.append((self.terms.setdefault(term, len(self.terms)), at, n))

    def room(self, counts: Counter[bytes]) -> bool:
        return not self.items or len(self.items) < BLOCK_ITEMS and (len(self.items) + 1) * (len(self.terms) + len(counts)) <= BLOCK_CELLS


def blocks(benchmark: DataFrame) -> Iterator[Block]:
    """The items in blocks of bounded size, read one partition after the other."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), whole().alias("text")).distinct()
    block = Block()
    for number, row in enumerate(items.toLocalIterator()):
        counts = Counter(terms(row.text.encode()))
        if counts:
            if not block.room(counts):
                yield block
                block = Block()
            block.add(number, row.item_id, counts)
    if block.items:
        yield block


def frequencies(index: DataFrame, block: Block) -> np.ndarray:
    """In how many documents each term of the block occurs."""
    known = dict(block.terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(len(known), np.int64)
        for batch in batches:
            for text in batch["text"].to_pylist():
                found[[known[t] for t in known.keys() & set(terms(text))]] += 1
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], names=["term", "n"])

    out = np.zeros(len(known), np.int64)
    for row in index.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # one row a term of the block
        out[row.term] = row.n
    return out


class Scorer:
    """Bounds and exact scores of documents for the items of a block, inside a task."""

    def __init__(self, block: Block, found: np.ndarray, n_docs: int, n_terms: int) -> None:
        self.n_docs, self.n_terms = n_docs, n_terms
        self.known = block.terms
        self.hashes = np.fromiter(map(crc32, block.terms), np.uint32, len(block.terms))
        self.items = len(block.items)
        weight = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df) + 1))) for df in found]
        self.cells = [(t, i, n * weight[t]) for t, i, n in block.cells]

    def prepare(self) -> None:
        self.weights = np.zeros((len(self.known), self.items))
        for t, i, w in self.cells:
            self.weights[t, i] = w
        self.folded: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _length(self, n: np.ndarray) -> np.ndarray:
        return 8 * (25 + (75 * n * self.n_docs) // self.n_terms)

    def _folded(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The buckets that the block's terms fall into at this width, and the items' weights by bucket."""
        if width not in self.folded:
            places, at = np.unique(self.hashes & np.uint32(width - 1), return_inverse=True)
            order = np.argsort(at, kind="stable")
            starts = np.searchsorted(at[order], np.arange(len(places)))
            self.folded[width] = places, np.add.reduceat(self.weights[order], starts, axis=0)
        return self.folded[width]

    def bounds(self, n: np.ndarray, most: np.ndarray, sketches: list[bytes]) -> np.ndarray:
        """Upper bounds of the scores, documents by items."""
        out = np.empty((len(n), self.items))
        widths = np.fromiter(map(len, sketches), np.int64, len(sketches))
        for width in np.unique(widths).tolist():
            rows = np.flatnonzero(widths == width)
            places, weights = self._folded(width)
            for cut in np.array_split(rows, math.ceil(len(rows) * width / CELLS)):
                counts = np.frombuffer(b"".join([sketches[r] for r in cut.tolist()]), np.uint8).reshape(len(cut), width)[:, places].astype(np.int64)
                counts = np.where(counts == _FULL, most[cut, None], counts)
                impact = (1_000_000_000 * counts) // (1000 * counts + self._length(n[cut])[:, None])
                out[cut] = impact @ weights
        return out

    def exact(self, n: int, text: bytes) -> np.ndarray:
        """The scores of a whole text for all items."""
        counts = Counter(terms(text))
        held = list(self.known.keys() & counts.keys())
        tf = np.array([counts[t] for t in held], np.int64)
        impact = (1_000_000_000 * tf) // (1000 * tf + self._length(np.int64(n)))
        return impact @ self.weights[[self.known[t] for t in held]]


def _highest(index: DataFrame, scorer: Scorer) -> DataFrame:
    """Rows with the highest bounds, ten an item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer.prepare()
        bound, row = np.zeros((0, scorer.items)), np.zeros((0, scorer.items), np.int64)
        for batch in batches:
            got = scorer.bounds(batch["n"].to_numpy(), batch["most"].to_numpy(), batch["sketch"].to_pylist())
            bound = np.concatenate([bound, got])
            row = np.concatenate([row, np.repeat(batch["row"].to_numpy()[:, None], scorer.items, axis=1)])
            if len(bound) > TOP:
                top = np.argpartition(-bound, TOP - 1, axis=0)[:TOP]
                bound, row = np.take_along_axis(bound, top, 0), np.take_along_axis(row, top, 0)
        item = np.tile(np.arange(scorer.items), len(bound))
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(row.ravel()), pa.array(bound.ravel())], names=["item", "row", "bound"])

    found = index.select("row", "n", "most", "sketch").mapInArrow(run, "item long, row long, bound double").where("bound > 0")
    best = Window.partitionBy("item").orderBy(F.desc("bound"), "row")
    return found.withColumn("k", F.row_number().over(best)).where(F.col("k") <= TOP).select("row").distinct()


def _floors(index: DataFrame, rows: DataFrame, scorer: Scorer) -> np.ndarray:
    """A score for each item that at least ten documents reach, or 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer.prepare()
        best = np.zeros((0, scorer.items))
        for batch in batches:
            got = [scorer.exact(n, t) for n, t in zip(batch["n"].to_pylist(), batch["text"].to_pylist(), strict=True)]
            best = -np.sort(-np.concatenate([best, *[g[None] for g in got]]), axis=0)[:TOP]
        item = np.tile(np.arange(scorer.items), len(best))
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(best.ravel())], names=["item", "score"])

    # at most ten ids an item of the block
    picked = index.join(F.broadcast(rows), "row", "left_semi").select("n", "text")
    scores = picked.mapInArrow(run, "item long, score double")
    nth = Window.partitionBy("item").orderBy(F.desc("score"))
    out = np.ones(scorer.items)
    for r in scores.withColumn("k", F.row_number().over(nth)).where(F.col("k") == TOP).collect():  # one row an item of the block
        out[r.item] = max(1.0, r.score)
    return out


def _rescored(index: DataFrame, scorer: Scorer, floors: np.ndarray, block: Block) -> DataFrame:
    """The best documents of each task for each item, by descending bound."""
    numbers = list(block.items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer.prepare()
        floor = floors.copy()
        best: list[list[tuple[int, float, int | None]]] = [[] for _ in numbers]
        for batch in batches:
            n, ids, texts = batch["n"].to_numpy(), batch["doc_id"].to_pylist(), batch["text"]
            bound = scorer.bounds(n, batch["most"].to_numpy(), batch["sketch"].to_pylist())
            exact: dict[int, np.ndarray] = {}
            for i in np.flatnonzero((bound >= floor).any(axis=0)).tolist():
                near = np.flatnonzero(bound[:, i] >= floor[i])
                for d in near[np.argsort(-bound[near, i], kind="stable")].tolist():
                    if bound[d, i] < floor[i]:
                        break
                    if d not in exact:
                        exact[d] = scorer.exact(int(n[d]), texts[d].as_py())
                    score = int(exact[d][i])
                    if score >= floor[i]:
                        entry = (score, -math.inf if ids[d] is None else -ids[d], ids[d])
                        if len(best[i]) < TOP:
                            heapq.heappush(best[i], entry)
                        else:
                            heapq.heappushpop(best[i], entry)
                        if len(best[i]) == TOP:
                            floor[i] = max(floor[i], best[i][0][0])
        rows = [(*numbers[i], doc, score) for i, found in enumerate(best) for score, _, doc in found]
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["number", "item_id", "doc_id", "score"])

    return index.select("doc_id", "n", "most", "sketch", "text").mapInArrow(run, "number long, item_id long, doc_id long, score long")


def search(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The ten best documents for each item: ``item_id``, ``rank``, ``doc_id``, ``score``."""
    spark = docs.sparkSession
    index = build_index(docs)
    n_docs, n_terms = index.agg(F.count(F.lit(1)), F.sum("n")).first()
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    if not n_docs:
        return out
    for block in blocks(benchmark):
        scorer = Scorer(block, frequencies(index, block), n_docs, n_terms)
        floors = _floors(index, staged(_highest(index, scorer), "highest"), scorer)
        found = staged(_rescored(index, scorer, floors, block), "rescored")
        best = Window.partitionBy("number").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= TOP)
        out = out.unionByName(ranked.select("item_id", "rank", "doc_id", "score"))
    return out


#: The same rows in SQL.
SEARCH_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS k, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents
), items AS (
  SELECT row_number() OVER () AS i, item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM (SELECT DISTINCT item_id, text FROM benchmark)
), corpus AS (
  SELECT count(*) AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM docs WHERE len(ts) > 0
), asked AS (
  SELECT i, item_id, t, count(*) AS times FROM (SELECT i, item_id, unnest(ts) AS t FROM items) GROUP BY ALL
), held AS (
  SELECT k, doc_id, n, t, count(*) AS tf
  FROM (SELECT k, doc_id, len(ts)::BIGINT AS n, unnest(ts) AS t FROM docs)
  WHERE t IN (SELECT t FROM asked) GROUP BY ALL
), weights AS (
  SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM held, corpus GROUP BY t, n_docs
), scores AS (
  SELECT i, item_id, k, doc_id,
         sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN held USING (t) JOIN weights USING (t), corpus
  GROUP BY i, item_id, k, doc_id
), ranked AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank
  FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

"""Best-fit packing planned on the histogram of lengths.

One pass over the texts gives the length and checksum of every piece, its task
and its rank among the task's pieces of that length; no text or token is
shuffled. The histogram (one row per length, at most the capacity) goes to the
driver, where best-fit decreasing runs over counts: all bins with the same
content are one entry. Each entry becomes a run of planned slots, numbered
within its length, and pieces take slots by their rank within length.

Defined cases: a null or empty text is one piece that holds the end id only; a
text of any size is cut into pieces of the capacity, the last may be shorter;
repeated rows are packed as often as they come; an empty table gives an empty
result; a null doc_id is carried through. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlab.llm import tokens
from barlab.llm.common import staged, whole

CAPACITY = 2048
END_ID = 0

_PIECES = "doc_id long, piece int, length int, ids_crc32 long, task int, place long"


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Every piece with its length, checksum, task and rank among the task's pieces of its length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, known = TaskContext.get().partitionId(), tokens.tokenizer(vocabulary)
        seen = np.zeros(capacity + 1, dtype=np.int64)
        end = np.array([end_id], dtype="<u2").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc, raw in zip(batch["doc_id"].to_pylist(), known.ids(_texts(batch["text"])), strict=True):
                ids = np.frombuffer(raw + end, dtype="<u2").astype("<u4")
                for piece, begin in enumerate(range(0, len(ids), capacity)):
                    part = ids[begin : begin + capacity]
                    rows.append((doc, piece, len(part), zlib.crc32(part), task, int(seen[len(part)])))
                    seen[len(part)] += 1
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=_NAMES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text")).mapInArrow(cut, _PIECES)


_NAMES = [c.split()[0] for c in _PIECES.split(", ")]


def _texts(column: pa.Array) -> Iterator[str]:
    """One text at a time, so that a batch is not held twice."""
    return (x.as_py() for x in column)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts.

    Returns runs ``(length, first_rank, pieces, first_sequence, offset)``: the
    pieces of ``length`` with ranks from ``first_rank`` on go, one each, to the
    sequences from ``first_sequence`` on, all at ``offset``. Bins are ranges of
    consecutive sequences with the same space left; a piece goes to the least
    space that holds it, a new bin counts as the largest, and a range is split
    where pieces run out.
    """
    free: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by space left: (first sequence, bins)
    runs, sequences = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank, space = histogram[length], 0, length
        while left:
            while space < capacity and not free[space]:
                space += 1
            # a bin takes pieces until no more fit: what remains is then the least space that held them
            each = space // length
            first, bins = free[space].pop() if free[space] else (sequences, -(-left // each))
            if first == sequences:
                sequences += bins
            used = min(bins, left // each)
            parts = [(first, used, each)] if used else []
            if used < bins and (more := left - used * each):
                parts.append((first + used, 1, min(each, more)))
            for begin, n, pieces_each in parts:
                for k in range(pieces_each):
                    runs.append((length, rank, n, begin, capacity - space + k * length))
                    rank += n
                left -= n * pieces_each
                free[space - pieces_each * length].append((begin, n))
            done = sum(n for _, n, _ in parts)
            if done < bins:
                free[space].append((first + done, bins - done))
    return runs


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents with their sequence and the place in it.

    Columns: doc_id, piece, start (ids of the document before the piece),
    length, ids_crc32, sequence_id, offset.
    """
    spark = docs.sparkSession
    cut = staged(pieces(docs, vocabulary or tokens.default_vocabulary(), capacity, end_id), "pieces")
    counts = cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    # at most one row per length: bounded by the capacity
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = plan(histogram, capacity)

    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = cut.join(base, ["task", "length"]).withColumn("rank", F.col("base") + F.col("place"))

    by_length: dict[int, list[tuple]] = {}
    for length, *run in runs:
        by_length.setdefault(length, []).append(tuple(run))
    slots = {k: np.array(v, dtype=np.int64) for k, v in by_length.items()}
    shared = spark.sparkContext.broadcast(slots)  # depends on the capacity, not on the rows

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planned = shared.value
        for batch in batches:
            lengths = batch["length"].to_numpy(zero_copy_only=False)
            ranks = batch["rank"].to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for length in np.unique(lengths):
                own, run = np.flatnonzero(lengths == length), planned[int(length)]
                at = np.searchsorted(run[:, 0], ranks[own], side="right") - 1
                sequence[own] = run[at, 2] + ranks[own] - run[at, 0]
                offset[own] = run[at, 3]
            arrays = [batch[n] for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array(sequence), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    start = (F.col("piece").cast("long") * capacity).alias("start")
    ready = ranked.select("doc_id", "piece", start, F.col("length").cast("long").alias("length"), "ids_crc32", "rank")
    return ready.mapInArrow(
        take, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )

"""Token files coded with a static range asymmetric numeral system.

The files below one folder:

* ``table``: one row per used id with its quantised frequency; frequencies sum to ``2 ** PRECISION``. Shared by all blocks.
* ``blocks``: one row per block of at most ``block_ids`` ids. Ids are dealt in turn to ``LANES`` interleaved coders that
  share one stream of 32-bit words. A block holds the stream, the states to start from, the states and stream positions at
  every ``CHECKPOINT`` rounds, the CRC-32 of its ids, and the documents (or parts of documents) in it. Any block, and any
  stretch between checkpoints, is decoded by itself.
* ``shards``: the ids in every shard. A shard is a range of doc_id; blocks never cross shards.

The container is Parquet, so Spark's committers make a lost executor harmless and any store that Spark knows will do.

Defined cases: a null or empty text is coded as the end id alone; repeated rows are coded as often as they come, next to
each other; a null doc_id sorts first; an empty table gives empty files that read back as no rows; a text of any length
is spread over as many blocks as it needs. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlab.llm import tokens
from barlab.llm.common import staged, whole

END_ID = 2
PRECISION = 20
LANES = 1024
CHECKPOINT = 128
BLOCK_IDS = 1 << 18

_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)
_BITS = np.uint64(PRECISION)
_MASK = np.uint64((1 << PRECISION) - 1)


def quantise(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to ``2 ** PRECISION``, at least one for every id that occurs."""
    used = counts > 0
    out = np.zeros(len(counts), dtype=np.int64)
    if not used.any():
        return out
    total = 1 << PRECISION
    spare = total - int(used.sum())
    share = counts[used].astype(np.float64) / counts.sum() * spare
    got = np.floor(share).astype(np.int64)
    rest = spare - int(got.sum())
    got[np.argsort(-(share - got), kind="stable")[:rest]] += 1
    out[used] = got + 1
    return out


class Coder:
    """Encodes and decodes one block with a table of frequencies."""

    def __init__(self, frequencies: np.ndarray) -> None:
        self.freq = frequencies.astype(np.uint64)
        self.start = (np.cumsum(frequencies) - frequencies).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(frequencies), dtype=np.uint16), frequencies)

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
        """The word stream, the first states, and the checkpoints (states and words read so far)."""
        rounds = -(-len(ids) // LANES)
        state = np.full(LANES, _LOW, dtype=np.uint64)
        out: list[np.ndarray] = []
        marks: list[tuple[np.ndarray, int]] = []
        written = 0
        for r in range(rounds - 1, -1, -1):
            now = ids[r * LANES : (r + 1) * LANES]
            x, f = state[: len(now)], self.freq[now]
            full = x >= (f << np.uint64(63 - PRECISION))
            if full.any():
                emitted = x[full]
                out.append(emitted.astype(np.uint32))
                written += len(emitted)
                x[full] = emitted >> _WORD
            q = x // f
            x[:] = (q << _BITS) + (x - q * f) + self.start[now]
            if r and r % CHECKPOINT == 0:
                marks.append((state.copy(), written))
        stream = np.concatenate(out[::-1]) if out else np.zeros(0, np.uint32)
        kept = [np.concatenate([s, [np.uint64(written - w)]]) for s, w in reversed(marks)]
        points = np.concatenate(kept) if kept else np.zeros(0, np.uint64)
        return stream.astype("<u4").tobytes(), state.astype("<u8").tobytes(), points.astype("<u8").tobytes()

    def decode(self, stream: bytes, states: bytes, n: int, points: bytes = b"", part: int = 0) -> np.ndarray:
        """The ids of a block; with ``part`` those from that checkpoint on."""
        words = np.frombuffer(stream, dtype="<u4").astype(np.uint64)
        state, at, first = np.frombuffer(states, dtype="<u8").astype(np.uint64), 0, 0
        if part:
            mark = np.frombuffer(points, dtype="<u8").reshape(-1, LANES + 1)[part - 1]
            state, at, first = mark[:LANES].astype(np.uint64), int(mark[LANES]), part * CHECKPOINT
        ids = np.empty(n - first * LANES, dtype=np.uint16)
        for r in range(first, -(-n // LANES)):
            size = min(LANES, n - r * LANES)
            x = state[:size]
            slot = x & _MASK
            s = self.symbol[slot]
            ids[(r - first) * LANES : (r - first) * LANES + size] = s
            x[:] = self.freq[s] * (x >> _BITS) + slot - self.start[s]
            low = np.flatnonzero(x < _LOW)
            if len(low):
                x[low] = (x[low] << _WORD) | words[at : at + len(low)]
                at += len(low)
        return ids


def _multiply(a: int, b: int) -> int:
    """Product of two polynomials over GF(2) modulo the one of CRC-32, bits reversed."""
    out = 0
    while b:
        if b & 0x80000000:
            out ^= a
        b = (b << 1) & 0xFFFFFFFF
        a = (a >> 1) ^ (0xEDB88320 if a & 1 else 0)
    return out


def crc_join(parts: list[tuple[int, int]]) -> int:
    """The CRC-32 of joined byte strings from their own checksums and lengths."""
    crc = 0
    for other, size in parts:
        power, square, left = 0x80000000, 0x00800000, size  # x ** 0, x ** 8
        while left:
            if left & 1:
                power = _multiply(power, square)
            square, left = _multiply(square, square), left >> 1
        crc = _multiply(crc, power) ^ other
    return crc


def tokenised(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """doc_id and its ids with the end id, as 16-bit integers in bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, end = tokens.tokenizer(vocabulary), np.array([end_id], dtype="<u2").tobytes()
        for batch in batches:
            raw = pa.array((x + end for x in known.ids(t.as_py() for t in batch["text"])), pa.binary())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], raw], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text")).mapInArrow(run, "doc_id long, ids binary")


def frequencies(coded: DataFrame) -> np.ndarray:
    """How often each id occurs: counted in the tasks, at most 65,536 rows for the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, dtype=np.int64)
        for batch in batches:
            column = batch["ids"]
            for at in range(0, len(column), 256):
                ids = np.frombuffer(b"".join(column.slice(at, 256).to_pylist()), dtype="<u2")
                total += np.bincount(ids, minlength=1 << 16)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    counts = np.zeros(1 << 16, dtype=np.int64)
    for row in coded.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[row.id] = row.n
    return counts


_BLOCK = (
    "shard int, block int, n int, crc long, stream binary, states binary, points binary, "
    "doc_ids array<long>, doc_starts array<long>, doc_sizes array<int>"
)


def write_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Write the coded ids of all documents in ascending doc_id order."""
    spark = docs.sparkSession
    coded = staged(tokenised(docs, vocabulary, end_id), "ids")
    table = quantise(frequencies(coded))
    used = np.flatnonzero(table)
    spark.createDataFrame(
        pd.DataFrame({"id": used, "frequency": table[used]}), "id long, frequency long"
    ).coalesce(1).write.mode("overwrite").parquet(f"{folder}/table")
    shared = spark.sparkContext.broadcast(table)  # 65,536 numbers

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, coder = TaskContext.get().partitionId(), Coder(shared.value)
        names = [c.split()[0] for c in _BLOCK.split(", ")]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(),
                 pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]
        block, fill, start = 0, 0, 0
        held: list[np.ndarray] = []
        ids_of: list[int | None] = []
        starts: list[int] = []
        sizes: list[int] = []

        def full() -> pa.RecordBatch:
            ids = np.concatenate(held)
            stream, states, points = coder.encode(ids)
            row = [shard, block, len(ids), zlib.crc32(ids), stream, states, points, list(ids_of), list(starts), list(sizes)]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

        for batch in batches:
            for doc, raw in zip(batch["doc_id"].to_pylist(), batch["ids"], strict=True):
                ids = np.frombuffer(raw.as_py(), dtype="<u2")
                at = 0
                while at < len(ids):
                    part = ids[at : at + block_ids - fill]
                    held.append(part)
                    ids_of.append(doc)
                    starts.append(start)
                    sizes.append(len(part))
                    fill, at = fill + len(part), at + len(part)
                    if fill == block_ids:
                        yield full()
                        block, fill = block + 1, 0
                        for x in (held, ids_of, starts, sizes):
                            x.clear()
                start += len(ids)
        if fill:
            yield full()

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = coded.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(encode, _BLOCK).write.mode("overwrite").option("compression", "none").parquet(f"{folder}/blocks")
    blocks = spark.read.schema(_BLOCK).parquet(f"{folder}/blocks")
    blocks.groupBy("shard").agg(F.sum("n").alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/shards")


def _coder(spark: SparkSession, folder: str):
    table = np.zeros(1 << 16, dtype=np.int64)
    for row in spark.read.parquet(f"{folder}/table").collect():  # one row per id of the vocabulary
        table[row.id] = row.frequency
    return spark.sparkContext.broadcast(table)


_PART = "shard int, block int, doc_id long, start long, size int, "


def _parts(spark: SparkSession, folder: str, last: str, kind: pa.DataType, made: Callable[[np.ndarray], object]) -> DataFrame:
    """The parts of documents in the files, each with one value made from its ids. Checksums are verified."""
    shared = _coder(spark, folder)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                ids = coder.decode(row["stream"], row["states"], row["n"])
                if zlib.crc32(ids) != row["crc"]:
                    raise ValueError(f"checksum of block {row['block']} in shard {row['shard']} is wrong")
                ends = np.cumsum(row["doc_sizes"])
                values = [made(ids[e - s : e]) for e, s in zip(ends, row["doc_sizes"], strict=True)]
                n = len(values)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["shard"]] * n, pa.int32()), pa.array([row["block"]] * n, pa.int32()),
                     pa.array(row["doc_ids"], pa.int64()), pa.array(row["doc_starts"], pa.int64()),
                     pa.array(row["doc_sizes"], pa.int32()), pa.array(values, kind)],
                    names=["shard", "block", "doc_id", "start", "size", last],
                )

    blocks = spark.read.schema(_BLOCK).parquet(f"{folder}/blocks")
    return blocks.mapInArrow(decode, f"{_PART}{last} {'binary' if kind == pa.binary() else 'long'}")


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The parts of documents in the files: shard, block, doc_id, start in the shard, size, ids."""
    return _parts(spark, folder, "ids", pa.binary(), lambda ids: ids.astype("<u2").tobytes())


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start over all documents, n_tokens and ids_crc32 of every document in the files."""

    @F.pandas_udf("long")
    def joined(parts: pd.Series) -> pd.Series:
        return parts.map(lambda p: crc_join([(x["crc"], 4 * x["size"]) for x in p]))

    parts = _parts(spark, folder, "crc", pa.int64(), lambda ids: zlib.crc32(ids.astype("<u4")))
    # a document begins at one place of a shard; only those cut by a block have more than one part
    found = parts.groupBy("shard", "doc_id", "start").agg(
        F.sum("size").cast("long").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("block", "crc", "size"))).alias("parts")
    )
    # Spark evaluates a Python function for every row that reaches it, so only cut documents go there
    found = staged(found, "parts")
    one = F.size("parts") == 1
    whole_ones = found.where(one).select("shard", "doc_id", "start", "n_tokens", F.col("parts")[0]["crc"].alias("ids_crc32"))
    cut_ones = found.where(~one).select("shard", "doc_id", "start", "n_tokens", joined("parts").alias("ids_crc32"))
    shards = spark.read.parquet(f"{folder}/shards")
    earlier = Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    base = shards.select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    return whole_ones.unionByName(cut_ones).join(base, "shard").select(
        "doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32"
    )

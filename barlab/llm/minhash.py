"""Near duplicates by b-bit MinHash.

A document is the set of its distinct five-word shingles, as 64-bit hashes.
128 minima give 25 band keys of five minima each (32 of four below a similarity
of 0.85), and the two lowest bits of every minimum (after mixing) are packed
into four longs. Documents with equal
sets are one representative. Candidates come from equal band keys; their
similarity is first estimated from the packed bits, corrected for chance
collisions, with a margin of five standard deviations, and then confirmed on
the full sets. At a similarity of 0.85 a pair misses all bands with a chance
of 4e-7, at 0.8 with four minima a band of 5e-8.

A bucket never yields all its pairs. First each document meets one other, the
most central of its buckets. Then only buckets that still hold several components are
looked at again, and there only documents of different components whose
estimate is high enough leave the join; large buckets are salted.

Defined cases: a null, empty or blank text has no shingles and links with
nothing; a text of fewer than five words has one shingle, the whole sequence;
rows that share a doc_id are one node with the links of all of them; a row
without doc_id gets no component and is kept; an empty table gives an empty
result. Other columns are not read. ``keep_one`` takes every distinct text as a
node, so that a row goes only by its own text; of a group the smallest doc_id
stays, as one row; rows without shingles go only if doc_id and text repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlab.llm.common import staged, whole
from barlab.llm.components import components

WIDTH = 5
PERCENT = 85
MINIMA = 128
#: So many ids of candidates go to every task in one piece (8 MB); more are joined by a shuffle.
SENT_IDS = 1_000_000
_BLOCK = 1024


def band_rows(percent: int) -> int:
    """Minima a band."""
    return 5 if percent >= 85 else 4


def margin(percent: int) -> float:
    """Five standard deviations of the two-bit estimate at the threshold, rounded up."""
    equal = 0.25 + 0.75 * percent / 100
    return ceil(500 * sqrt(equal * (1 - equal) / MINIMA) / 0.75) / 100


_rng = np.random.RandomState(20240229)
_FACTOR = _rng.randint(0, 1 << 62, MINIMA, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _rng.randint(0, 1 << 62, MINIMA, dtype=np.int64).astype(np.uint64)
_POWERS = [pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(WIDTH)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Hashes of the distinct shingles, ascending. Only A to Z are lowered and only ASCII white space parts words."""
    from xxhash import xxh3_64_intdigest

    words = [xxh3_64_intdigest(w) for w in (text or "").encode().lower().split()]
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.array(words, dtype=np.uint64)
    if len(hashes) < WIDTH:
        one = np.uint64(len(hashes))
        for h in hashes:
            one = _mixed(np.array([one ^ h]))[0]
        return np.array([one])
    n = len(hashes) - WIDTH + 1
    total = np.zeros(n, np.uint64)
    for k, power in enumerate(_POWERS):
        total += hashes[k : k + n] * np.uint64(power)
    return np.unique(_mixed(total))


def minima(hashes: np.ndarray) -> np.ndarray:
    out = np.full(MINIMA, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(hashes), 1024):
        out = np.minimum(out, (_FACTOR[:, None] * hashes[None, i : i + 1024] + _SHIFT[:, None]).min(axis=1))
    return out


_SIGNATURE = "doc_id long, n_shingles long, high long, low long, bits array<long>, bands array<long>"


def signatures(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Size and 128-bit digest of each set, the packed low bits of its minima, and its band keys (none for an empty set)."""
    width = band_rows(percent)
    count = MINIMA // width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        names = [c.split()[0] for c in _SIGNATURE.split(", ")]
        kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * 2
        weights = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(width)], dtype=np.uint64)
        tags = np.arange(1, count + 1, dtype=np.uint64)
        shifts = np.tile(np.arange(0, 64, 2, dtype=np.uint64), MINIMA // 32)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                found = shingles(text.as_py())
                digest = np.frombuffer(xxh3_128_digest(found.tobytes()), dtype=np.int64)
                if len(found):
                    least = minima(found)
                    low = (least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(62)
                    bits = np.bitwise_or.reduce((low << shifts).reshape(-1, 32), axis=1).view(np.int64).tolist()
                    keys = _mixed((least[: count * width].reshape(count, -1) * weights).sum(axis=1, dtype=np.uint64) ^ tags)
                    rows.append((doc, len(found), int(digest[0]), int(digest[1]), bits, keys.view(np.int64).tolist()))
                else:
                    rows.append((doc, 0, int(digest[0]), int(digest[1]), [], []))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text")).mapInArrow(run, _SIGNATURE)


def estimate(a: str, b: str) -> Column:
    """Similarity from two packed signatures: the share of equal two-bit values, less chance collisions."""
    equal = F.lit(MINIMA)
    for i in range(MINIMA // 32):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        differ = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555))
        equal = equal - F.bit_count(differ)
    return (equal / F.lit(float(MINIMA)) - 0.25) / 0.75


def sets_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """The full shingle sets of the documents in ``ids`` (one column, doc_id)."""
    ids = staged(ids.distinct(), "candidate-ids")
    small = ids.limit(SENT_IDS + 1).count() <= SENT_IDS
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"))
    picked = texts.join(F.broadcast(ids) if small else ids, "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = pa.array((shingles(t.as_py()).view(np.int64) for t in batch["text"]), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], sets], names=["doc_id", "hashes"])

    return staged(picked.mapInArrow(run, "doc_id long, hashes array<long>"), "sets")


def similar(x: str, y: str, percent: int) -> Column:
    """Whether two sets are similar enough: 100 * shared >= percent * all."""
    shared = F.size(F.array_intersect(x, y)).cast("long")
    return shared * (100 + percent) >= (F.size(x) + F.size(y)).cast("long") * percent


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs ``a``, ``b`` whose full shingle sets are similar enough."""
    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")), docs)
    both = pairs.select("a", "b").join(sets.toDF("b", "y"), "b").join(sets.toDF("a", "x"), "a")
    return both.where(similar("x", "y", percent)).select("a", "b").distinct()


def _near(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs whose estimate is high enough; the others never leave the second join."""
    known = pairs.join(marks.toDF("b", "bits_b"), "b")
    near = estimate("bits_a", "bits_b") >= percent / 100 - margin(percent)
    return known.join(marks.toDF("a", "bits_a"), "a").where(near).select("a", "b").distinct()


def _crossing(rest: DataFrame, marks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between documents of different components in one bucket.

    The join itself estimates and then confirms, so that only links leave it;
    near copies just below the threshold are many pairs and no rows. Large
    buckets are salted: one side goes to one block, the other to all.
    """
    full = rest.join(marks, "doc_id").join(sets, "doc_id")
    blocks = F.ceil(F.col("size") / _BLOCK).cast("int")
    left = full.select("key", F.pmod(F.xxhash64("doc_id"), blocks).cast("int").alias("block"), F.col("doc_id").alias("a"),
                       F.col("part").alias("part_a"), F.col("bits").alias("bits_a"), F.col("hashes").alias("x"))
    right = full.select("key", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.col("doc_id").alias("b"),
                        F.col("part").alias("part_b"), F.col("bits").alias("bits_b"), F.col("hashes").alias("y"))
    apart = (F.col("a") < F.col("b")) & (F.col("part_a") != F.col("part_b"))
    near = estimate("bits_a", "bits_b") >= percent / 100 - margin(percent)
    return left.join(right, ["key", "block"]).where(apart & near & similar("x", "y", percent)).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    marked = staged(signatures(docs, percent), "signatures")
    first = marked.where("doc_id is not null and n_shingles > 0").groupBy("high", "low").agg(F.min("doc_id").alias("rep"))
    known = staged(marked.join(first, ["high", "low"], "left").drop("high", "low"), "representatives")
    reps = known.where("doc_id = rep").dropDuplicates(["doc_id", "bits"])
    marks = reps.select("doc_id", "bits")

    keys = reps.select("doc_id", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("size"))
    shared = staged(keys.join(buckets.where("last > first").select("key", "size"), "key"), "buckets")
    # first each document meets one other: of all in its buckets, the one whose own buckets are the largest. The text
    # that near copies were made from is in the buckets of most of them, so they hang together by it at once
    central = shared.groupBy("doc_id").agg(F.sum("size").alias("reach"))
    heads = shared.join(central, "doc_id").groupBy("key").agg(F.max(F.struct("reach", (-F.col("doc_id")).alias("doc"))).alias("head"))
    best = shared.join(heads, "key").groupBy("doc_id").agg(F.max("head").alias("head"))
    met = best.select("doc_id", (-F.col("head.doc")).alias("head")).where("doc_id <> head")
    met = met.select(F.least("doc_id", "head").alias("a"), F.greatest("doc_id", "head").alias("b"))
    links = staged(confirmed(staged(_near(met, marks, percent), "met"), docs, percent), "first-links")

    # then the buckets that these links have not joined into one component
    parts = components(links)
    placed = staged(
        shared.select("key", "size", "doc_id").join(parts, F.col("doc_id") == F.col("node"), "left").select(
            "key", "size", "doc_id", F.coalesce("component", "doc_id").alias("part")
        ), "placed",
    )
    many = placed.groupBy("key").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x < y").select("key")
    rest = staged(placed.join(many, "key"), "unsettled")
    if not rest.isEmpty():
        parts = components(links.unionByName(_crossing(rest, marks, sets_of(rest.select("doc_id"), docs), percent)))
    found = known.select("doc_id", "n_shingles", "rep").join(parts, F.col("rep") == F.col("node"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return found.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )


def _sent(ids: DataFrame) -> DataFrame:
    """A staged table of ids, to go to every task while it is small."""
    return F.broadcast(ids) if ids.limit(SENT_IDS + 1).count() <= SENT_IDS else ids


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one row of each group of near-duplicate texts."""
    doc, text = F.col("doc_id").cast("long"), whole()
    # a text is a node; those without words link with nothing, not even with their copies
    node = F.when(text.rlike(r"[^\x20\x09-\x0D]"), F.xxhash64(text)).otherwise(F.xxhash64(doc, text))
    known = docs.where("doc_id is not null").select(doc.alias("doc_id"), text.alias("text"), node.alias("node"))
    texts = staged(known.groupBy("node").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "texts")
    copied = _sent(texts.where("n > 1").select(F.col("node").alias("_node"), "first"))
    rows = known.join(copied, F.col("node") == F.col("_node"), "left").select("node", "text", "doc_id", "first")
    # rows whose text occurs once, and one row of each other text
    once = rows.where("first is null").select("node", "text")
    again = rows.where("doc_id = first").select("node", "text").dropDuplicates(["node"])
    single = staged(once.unionByName(again).withColumnRenamed("node", "doc_id"), "distinct-texts")
    found = near_duplicates(single, percent).select(F.col("doc_id").alias("_node"), "component_id")

    groups = texts.join(found, F.col("node") == F.col("_node")).select("node", "first", "n", "component_id")
    groups = staged(groups, "groups")
    best = groups.groupBy("component_id").agg(F.min(F.struct("first", "node")).alias("best"), F.count(F.lit(1)).alias("texts")).where("texts > 1")
    lost = groups.join(best, "component_id").where("node <> best.node").select("node", F.lit(None).cast("long").alias("stays"))
    stays = groups.where("n > 1").select("node", F.col("first").alias("stays")).join(lost.select("node"), "node", "left_anti")
    # of each text with something to drop, the doc_id that stays, null if none does
    fate = _sent(staged(lost.unionByName(stays).select(F.col("node").alias("_lost"), "stays"), "fate"))
    left = docs.withColumn("_node", F.when(F.col("doc_id").isNotNull(), node)).join(fate, F.col("_node") == F.col("_lost"), "left")
    repeated = left.where(doc == F.col("stays")).dropDuplicates(["_node"])
    return left.where("_lost is null").unionByName(repeated).select(*docs.columns)

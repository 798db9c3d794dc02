"""The prefix trie of conversations, by union-find over sorted neighbours.

A turn is a 16-byte digest of role and text, a conversation the sequence of its
digests. Sorted sequences are range-partitioned. Inside a partition every pair
of neighbours is an edge whose weight is their longest common prefix; edges
join components in descending weight, every merge makes a branching node (or
adds to the one of the same depth), and the depths between two merges are a
chain of nodes with the same members.

Nodes that lie on the path of a partition's first or last sequence may go on in
its neighbours. Of each partition only these two paths are handed on, with what
hangs below them already summed up: the contracted forest. Nodes of equal depth
and prefix are merged, and sums that run through several partitions go up the
paths, each merged node counted on one path only.

Sequences are cut into segments of 1,024 turns, so no row and no task holds a
conversation whole. A further segment is sorted only where several
conversations share all turns before it, its results are added where the
segment before it ends; a conversation that shares nothing more is a chain made
from its turns. There is one such step for each 1,024 shared turns.

Defined cases: turns go by number, null first, equal numbers by the digest of
role and text; repeated rows are turns of their own; null role or text is
empty; rows without conv_id are left out; a conversation may be left without
turns and then counts at the root only; an empty table has no root and gives no
rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlab.functions.ordering import with_row_number
from barlab.llm.common import staged, whole, words

#: Turns a segment.
SEGMENT = 1_024
#: Conversations of more turns are numbered in ranges.
LONG = 100_000
#: Sequences and turns that a partition holds, on average.
SEQUENCES = 20_000
TURNS = 500_000
_SIZE = 16
#: Fixed values of the contract: the base of a conversation, and how many of its turns are taken at most.
GROUP, HEADS = 20, 4

_ROOT = b"\0" * _SIZE
_NODE = (
    "pid int, low boolean, high boolean, depth int, key binary, parent_key binary, parent long, n long, least long, "
    "children long, leaves long, saved long, words long, sha string, ends string"
)
_KINDS = [pa.int32(), pa.bool_(), pa.bool_(), pa.int32(), pa.binary(), pa.binary()] + [pa.int64()] * 7 + [pa.string()] * 2
_NAMES = [c.split()[0] for c in _NODE.split(", ")]
_NONE = hashlib.sha256(b"").hexdigest()


def numbered(conversations: DataFrame) -> DataFrame:
    """Turns with their place in the conversation: ``conv_id``, ``p``, ``id``, ``words``."""
    role, text = whole("role"), whole()
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("double").alias("turn"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("id"),
        F.size(words(text)).alias("words"),
    )
    rows = staged(rows, "turns")
    long = rows.groupBy("conv_id").count().where(F.col("count") > LONG).select("conv_id")
    turn = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "id")
    short = rows.join(long, "conv_id", "left_anti").withColumn("p", F.row_number().over(turn).cast("long"))
    tie = F.conv(F.substring("id", 1, 15), 16, 10).cast("long")
    first = F.coalesce(F.col("turn"), F.lit(float("-inf")))
    longer = with_row_number(rows.join(long, "conv_id", "left_semi"), ["conv_id"], first, tie, "p")
    return short.unionByName(longer.withColumn("p", F.col("p").cast("long"))).select("conv_id", "p", "id", "words")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt turns (``conv_id``, ``d``, ``id``, ``words``) and all conversations with their length (``conv_id``, ``len``)."""
    turns = staged(numbered(conversations), "numbered")
    heads = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEADS)).cast("int")
    convs = turns.groupBy("conv_id").agg(F.max("p").alias("own")).select(
        "conv_id", "own", heads.alias("h"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base")
    )
    lens = convs.select(F.col("conv_id").alias("base"), F.col("own").alias("base_len"))
    convs = staged(convs.join(lens, "base", "left").withColumn("taken", F.least(F.col("h").cast("long"), F.coalesce("base_len", F.lit(0)))), "convs")
    given = turns.where(F.col("p") < HEADS).withColumnRenamed("conv_id", "base")
    head = convs.join(given, "base").where("p <= taken").select("conv_id", F.col("p").alias("d"), "id", "words")
    rest = turns.join(convs, "conv_id").where("p > h").select("conv_id", (F.col("p") - F.col("h") + F.col("taken")).alias("d"), "id", "words")
    sizes = convs.select("conv_id", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("len"))
    return staged(head.unionByName(rest), "rebuilt"), sizes


def _common(a: bytes, b: bytes) -> int:
    """Equal blocks at the start."""
    if a == b:
        return len(a) // _SIZE
    low, high = 0, min(len(a), len(b)) // _SIZE
    while low < high:
        mid = (low + high + 1) // 2
        if a[: mid * _SIZE] == b[: mid * _SIZE]:
            low = mid
        else:
            high = mid - 1
    return low


class Forest:
    """Components of one sorted partition, merged over its edges in descending depth."""

    def __init__(self, rows: dict[str, list]) -> None:
        self.pid: int = rows["pid"][0]
        self.seq: list[bytes] = rows["seq"]
        self.conv: list[int] = rows["conv_id"]
        self.words: list[list[int]] = rows["words"]
        self.top: list[int] = rows["top"]
        self.last = len(self.seq) - 1
        n = len(self.seq)
        self.up = list(range(n))
        self.low, self.high = list(range(n)), list(range(n))
        self.depth = [len(s) // _SIZE for s in self.seq]
        self.n, self.least = [1] * n, list(self.conv)
        self.children, self.leaves, self.saved = list(rows["children"]), list(rows["leaves"]), list(rows["saved"])
        #: conversations that end at the component's present node, and emitted nodes that wait for it as their parent
        self.ends: list[list[int]] = [[] if more else [c] for c, more in zip(self.conv, rows["more"], strict=True)]
        self.waiting: list[list[list]] = [[] for _ in range(n)]
        self.out: list[list] = []

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def run(self) -> list[list]:
        edges = np.array([_common(a, b) for a, b in zip(self.seq, self.seq[1:], strict=False)], np.int64)
        for e in np.argsort(-edges, kind="stable").tolist():
            depth = int(edges[e])
            if not depth:
                break
            a, b = self.find(e), self.find(e + 1)
            self.climb(a, depth)
            self.climb(b, depth)
            self.merge(a, b)
        for i in range(self.last + 1):
            if self.up[i] == i:
                self.climb(i, 0)
        return self.out

    def merge(self, a: int, b: int) -> None:
        self.up[b] = a
        self.high[a] = self.high[b]
        self.least[a] = min(self.least[a], self.least[b])
        for stat in (self.n, self.children, self.leaves, self.saved):
            stat[a] += stat[b]
        self.ends[a].extend(self.ends[b])  # edges of one depth go from left to right: equal sequences in rising order of conv_id
        small, large = sorted((self.waiting[a], self.waiting[b]), key=len)
        large.extend(small)
        self.waiting[a] = large
        self.ends[b], self.waiting[b] = [], []

    def climb(self, c: int, depth: int) -> None:
        """Emit the component's nodes from its present depth down to just below ``depth``."""
        low, high = self.low[c] == 0, self.high[c] == self.last
        seq, counts, n, least = self.seq[self.low[c]], self.words[self.low[c]], self.n[c], self.least[c]
        shared = low or high
        for at in range(self.depth[c], depth, -1):
            key = hashlib.md5(seq[: at * _SIZE]).digest() if shared else None
            for row in self.waiting[c]:
                if shared:
                    row[5] = key
                elif at > 1:
                    row[6] = least
            ends = self.ends[c]
            own = counts[at - 2] if at > 1 else 0
            if shared:
                sha, joined = None, ",".join(map(str, ends)) if ends else None
                children, leaves, saved = self.children[c], self.leaves[c], self.saved[c]
            else:
                sha, joined = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest() if ends else _NONE, None
                children = self.children[c]
                leaves = self.leaves[c] if children else 1
                saved = self.saved[c] + (n - 1) * own
            row = [self.pid, low, high, at, key, None, None, n, least, children, leaves, saved, own, sha, joined]
            self.out.append(row)
            if at == 2:  # its parent may have members that end there, which aren't in this level
                row[6] = self.top[self.low[c]]
            self.waiting[c] = [row]
            self.ends[c] = []
            # what the next node sees of this one; an open child is counted once all partitions are merged
            self.children[c], self.leaves[c], self.saved[c] = (0, leaves, saved) if shared else (1, leaves, saved)
        self.depth[c] = min(self.depth[c], depth)


def _forests(level: DataFrame, parts: int) -> DataFrame:
    """The nodes of every partition of the sorted sequences; those on a border are partial and carry their key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (held := list(batches)):  # one range of sequences, bounded by SEQUENCES and TURNS
            return
        rows = pa.Table.from_batches(held)
        out = Forest(rows.to_pydict()).run()
        for at in range(0, len(out), 50_000):
            columns = list(zip(*out[at : at + 50_000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], names=_NAMES)

    ordered = level.repartitionByRange(parts, "seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    return staged(ordered.withColumn("pid", F.spark_partition_id()).mapInArrow(run, _NODE), "forests")


def _hashed(chunks: DataFrame) -> DataFrame:
    """SHA-256 of the conversations that end at each border node, as their partitions follow each other; text by text, never whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []
        for batch in batches:
            for key, ends in zip(batch["key"].to_pylist(), batch["ends"].to_pylist(), strict=True):
                if key != now:
                    if state:
                        done.append((now, state.hexdigest()))
                    now, state = key, hashlib.sha256(ends.encode())
                else:
                    state.update(b"," + ends.encode())
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([s for _, s in done], pa.string())], names=["key", "sha"])
            done = []
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()])], names=["key", "sha"])

    return chunks.select("key", "pid", "ends").repartition("key").sortWithinPartitions("key", "pid").select("key", "ends").mapInArrow(run, "key binary, sha string")


def _merged(forests: DataFrame) -> DataFrame:
    """Whole nodes of one level: ``depth`` in blocks, ``least``, ``parent``, ``n``, ``children``, ``leaves``, ``saved``, ``sha``."""
    inner = forests.where("key is null")
    border = forests.where("key is not null")
    side = F.when(F.col("low"), F.col("pid") * 2).otherwise(F.col("pid") * 2 + 1)
    nodes = border.groupBy("key").agg(
        F.first("depth").alias("depth"), F.first("parent_key", True).alias("parent_key"), F.first("parent", True).alias("parent"),
        F.sum("n").alias("n"), F.min("least").alias("least"), F.sum("children").alias("below"), F.first("words").alias("words"),
        F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.min(side).alias("owner"),
    )
    held = nodes.where("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("held"))
    nodes = nodes.join(held, "key", "left").withColumn("children", F.col("below") + F.coalesce("held", F.lit(0)))
    nodes = staged(
        nodes.withColumn("own_leaf", (F.col("children") == 0).cast("long")).withColumn("own_saved", (F.col("n") - 1) * F.col("words")), "border"
    )
    sides = F.filter(F.array(F.when(F.col("low"), F.col("pid") * 2), F.when(F.col("high"), F.col("pid") * 2 + 1)), lambda x: x.isNotNull())
    paths = border.select("key", F.explode(sides).alias("path")).join(nodes.select("key", "depth", "owner", "own_leaf", "own_saved"), "key")
    path = Window.partitionBy("path").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    counted = F.col("owner") == F.col("path")
    sums = paths.select(
        "key", *[F.sum(F.when(counted, F.col(c)).otherwise(0)).over(path).alias(c) for c in ("own_leaf", "own_saved")]
    ).groupBy("key").agg(F.sum("own_leaf").alias("more_leaves"), F.sum("own_saved").alias("more_saved"))
    shas = _hashed(border.where("ends is not null"))
    parents = nodes.select(F.col("key").alias("parent_key"), F.col("least").alias("of_parent"))
    whole_nodes = (
        nodes.join(sums, "key").join(shas, "key", "left").join(parents, "parent_key", "left")
        .select(
            "key", "depth", "least", F.coalesce("parent", "of_parent").alias("parent"), "n", "children",
            (F.col("leaves") + F.col("more_leaves")).alias("leaves"), (F.col("saved") + F.col("more_saved")).alias("saved"),
            F.coalesce("sha", F.lit(_NONE)).alias("sha"),
        )
    )
    names = ["depth", "least", "parent", "n", "children", "leaves", "saved", "sha"]
    under = inner.join(parents, "parent_key", "left").withColumn("parent", F.coalesce("parent", "of_parent"))
    return under.select(*names).unionByName(whole_nodes.select(*names))


def _ext(name: str) -> Column:
    return F.coalesce(name, F.lit(0)).cast("long").alias(name)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """All nodes: ``conv_id``, ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``."""
    spark = conversations.sparkSession
    turns, convs = rebuilt(conversations)
    convs = staged(convs, "lengths")
    n_convs, least, longest = convs.agg(F.count(F.lit(1)), F.min("conv_id"), F.max("len")).first()
    schema = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    if not n_convs:
        return spark.createDataFrame([], schema)
    part = F.floor((F.col("d") - 1) / SEGMENT)
    pieces = turns.groupBy("conv_id", part.alias("segment")).agg(F.sort_array(F.collect_list(F.struct("d", "id", "words"))).alias("t"))  # at most SEGMENT turns
    pieces = staged(pieces.select("conv_id", "segment", F.unhex(F.array_join("t.id", "")).alias("key"), F.col("t.words").alias("words")), "segments")

    # down: what is sorted at each level, and the chains that leave it
    levels, chains = [], []
    alive = convs.withColumn("group", F.lit(_ROOT)).withColumn("top", F.lit(least))
    for level in range(max(1, math.ceil((longest or 0) / SEGMENT))):
        now = alive.join(pieces.where(F.col("segment") == level).drop("segment"), "conv_id", "left").select(
            "conv_id", "len", "top", F.concat("group", F.coalesce("key", F.lit(b""))).alias("seq"), F.coalesce("words", F.array().cast("array<int>")).alias("words")
        )
        now = staged(now, "level")
        levels.append(now)
        end = (level + 1) * SEGMENT
        if longest <= end:
            break
        reach = now.where(F.col("len") >= end).select("conv_id", "len", F.unhex(F.md5("seq")).alias("group"))
        groups = reach.groupBy("group").agg(F.min("conv_id").alias("top"), F.sum((F.col("len") > end).cast("int")).alias("going"))
        on = staged(reach.where(F.col("len") > end).join(groups, "group"), "going")
        chains.append((level + 1, on.where("going = 1").select("conv_id", "len", "top")))
        alive = on.where("going > 1").select("conv_id", "len", "group", "top")
        if alive.isEmpty():
            break

    # up: each level takes over what the next one found
    out = None
    found = None  # conv_id, children, leaves, saved
    for level in range(len(levels) - 1, -1, -1):
        rows = levels[level].withColumn("more", F.col("len") > (level + 1) * SEGMENT)
        single = [c for at, c in chains if at == level + 1]
        below = spark.createDataFrame([], "conv_id long, children long, leaves long, saved long") if found is None else found
        if single:
            below = below.unionByName(single[0].select("conv_id", F.lit(1).cast("long").alias("children"), F.lit(1).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved")))
        rows = rows.join(below, "conv_id", "left").select("conv_id", "seq", "words", "top", "more", _ext("children"), _ext("leaves"), _ext("saved"))
        rows = staged(rows, "sequences")
        count, blocks = rows.agg(F.count(F.lit(1)), F.sum(F.size("words"))).first()
        nodes = staged(_merged(_forests(rows, max(1, math.ceil(count / SEQUENCES), math.ceil((blocks or 0) / TURNS)))), "nodes")
        found = nodes.where("depth = 1").select(F.col("least").alias("conv_id"), "children", "leaves", "saved")
        shown = nodes if level == 0 else nodes.where("depth > 1")
        shown = shown.select(
            F.col("least").alias("conv_id"), (F.col("depth") - 1 + level * SEGMENT).cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"),
            F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("sha").alias("ends_sha256"),
        )
        out = shown if out is None else out.unionByName(shown)
    for level, chain in chains:
        out = out.unionByName(_chain(turns, chain, level * SEGMENT))
    return out


def _chain(turns: DataFrame, chain: DataFrame, after: int) -> DataFrame:
    """The nodes of conversations that share nothing below depth ``after``."""
    rows = turns.where(F.col("d") > after).join(chain, "conv_id")
    one = F.lit(1).cast("long")
    last = F.col("d") == F.col("len")
    return rows.select(
        "conv_id", F.col("d").cast("long").alias("depth"), F.when(F.col("d") == after + 1, F.col("top")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        one.alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.sha2(F.when(last, F.col("conv_id").cast("string")).otherwise(F.lit("")), 256).alias("ends_sha256"),
    )


#: The same rows in SQL; the bits of a CRC-32 are worked out byte by byte.
TRIE_SQL = r"""
WITH t AS (
  SELECT conv_id, md5(len(r) || ':' || r || x) AS id, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS w,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(len(r) || ':' || r || x)) AS p
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)
), convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
             lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda d, i: xor(d >> 1, CASE WHEN d & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM t)
), turns AS (
  SELECT c.conv_id, 0 AS own, p, id, w FROM convs c JOIN t ON t.conv_id = c.base AND t.p <= c.h
  UNION ALL
  SELECT c.conv_id, 1 AS own, p, id, w FROM convs c JOIN t ON t.conv_id = c.conv_id AND t.p > c.h
), seqs AS (
  SELECT conv_id, coalesce(list(id ORDER BY own, p) FILTER (id IS NOT NULL), []) AS ids, coalesce(list(w ORDER BY own, p) FILTER (id IS NOT NULL), []) AS ws
  FROM convs LEFT JOIN turns USING (conv_id) GROUP BY conv_id
), prefixes AS (
  SELECT conv_id, d, list_slice(ids, 1, d) AS k, CASE WHEN d = 0 THEN 0 ELSE ws[d] END AS w, d = len(ids) AS ends
  FROM (SELECT *, unnest(range(0, len(ids) + 1)) AS d FROM seqs)
), nodes AS (
  SELECT d, k, min(conv_id) AS conv_id, count(*) AS n, any_value(w) AS w,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS sha
  FROM prefixes GROUP BY d, k
), held AS (
  SELECT d - 1 AS d, list_slice(k, 1, d - 1) AS k, count(*) AS children FROM nodes WHERE d > 0 GROUP BY ALL
), full_nodes AS (
  SELECT nodes.*, coalesce(children, 0) AS children FROM nodes LEFT JOIN held USING (d, k)
), below AS (
  SELECT a AS d, list_slice(k, 1, a) AS k, count(*) FILTER (children = 0) AS leaves, sum((n - 1) * w)::BIGINT AS saved
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM full_nodes) GROUP BY ALL
)
SELECT f.conv_id, f.d::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n AS n_convs, f.children AS n_children,
       leaves AS n_leaves, saved AS saved_tokens, f.sha AS ends_sha256
FROM full_nodes f JOIN below USING (d, k) LEFT JOIN nodes p ON p.d = f.d - 1 AND p.k = list_slice(f.k, 1, f.d - 1)
"""

"""Mixing sources to target weights with Sainte-Lague quotas of words, taken in equal blocks, in SQL functions only.

The words of a source form one stream, its documents in a fixed order. The
stream is cut into blocks of equal words, which are dealt to shards. Targets
share the budget by weight, none above ``MOST`` times its source. Sources then
get words by the highest quotients target / 1, target / 3, target / 5 and so
on, and each source's quota is dealt to its shards by the same rule, by the
words they hold. Inside a shard the blocks are taken in a seeded order, every
block once before any is taken twice; of the last one only the first words are
taken, as many as the quota still needs.

A block is ``total / RESOLUTION`` words, at least one: so there are at most
``RESOLUTION`` blocks plus one a source, at any size of the corpus. Quotas
don't depend on it: a source's taken words miss its target by about a word,
also where the whole source is shorter than a block.

Highest quotients need no loop: a divisor that gives too few seats, and one
that gives enough, bracket the quotas; the few seats in between are ranked.

Defined cases: a null, empty or blank text has no words and takes none; a null
source is a source of its own, the last one; rows that share a doc_id are
separate documents, equal rows are too; an empty table gives an empty result.
``mix`` keeps the columns of its input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlab.llm.common import md5_number, staged, whole, words

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MOST = 2
RESOLUTION = 1 << 17
SHARDS = 16
#: Streams are ordered within so many hash cells of a source, so that a hot source is spread.
CELLS = 512
SEED = "mix"


def word_count(text: Column) -> Column:
    """Runs of anything but white space."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """``source``, ``source_size``, ``weight``, ``target`` for a table of one row a source.

    A source is full if its cap over its weight is at most the level at which
    the rest fits the budget; that level comes from running sums over the
    sources in order of cap over weight. All windows here run over one row a source.
    """
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = sizes.withColumn("weight", F.array(*[F.lit(float(w)) for w in weights])[place])
    weighed = weighed.withColumns({"cap": F.col("source_size") * F.lit(float(most)), "place": F.row_number().over(by_name)})
    rising = Window.partitionBy(F.lit(0)).orderBy((F.col("cap") / F.col("weight")).asc(), "place")
    before, every = rising.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    work = weighed.withColumns({
        "full": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "others": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        "total": F.sum("source_size").over(every) * F.lit(float(budget)),
    })
    # the level if all before this source are full and it and the rest are not
    level = (F.col("total") - F.col("full")) / F.col("others")
    open_level = F.min(F.when(level * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), level.alias("level")))).over(every)
    return work.withColumn("open", open_level["level"]).select(
        "source", F.col("source_size"), "weight",
        F.when(F.col("open").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("open") * F.col("weight"))).alias("target"),
    )


def apportion(parts: DataFrame, group: list[str], share: str, seats: str, most: str, order: Sequence[str], name: str) -> DataFrame:
    """Adds ``name``: the seats of each row by highest quotients of ``share`` within its group.

    ``seats`` is the group's number of seats, ``most`` the row's limit (enough
    in sum). Ties of quotients go by ``order``. A group is a bounded list of rows.
    """
    own = Window.partitionBy(*(group or [F.lit(0)]))
    n, total = F.count(F.lit(1)).over(own), F.sum(share).over(own)
    few = F.col(share) * (F.col(seats) - F.lit(0.5) * n) / total
    many = F.col(share) * (F.col(seats) + F.lit(0.5) * n) / total
    bounded = parts.withColumns({
        "_few": F.least(F.greatest(F.floor(few), F.lit(0)), F.col(most)),
        "_many": F.least(F.greatest(F.ceil(many) + n, F.lit(0)), F.col(most)),
    })
    bounded = bounded.withColumn("_left", F.col(seats) - F.sum("_few").over(own))
    tries = bounded.where("_many > _few").select(
        *group, *order, "_left", F.col(share).alias("_share"), F.explode(F.sequence(F.col("_few") + 1, F.col("_many"))).alias("_seat")
    )
    quotient = F.col("_share") / (2 * F.col("_seat") - 1)
    ranked = tries.withColumn(
        "_rank", F.row_number().over(Window.partitionBy(*(group or [F.lit(0)])).orderBy(quotient.desc(), *[F.col(c).asc_nulls_last() for c in order], "_seat"))
    )
    keys = list(dict.fromkeys([*group, *order]))
    won = ranked.where("_rank <= _left").groupBy(*keys).agg(F.count(F.lit(1)).alias("_won"))
    renamed = won.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    out = bounded.join(renamed, on, "left").withColumn(name, (F.col("_few") + F.coalesce("_won", F.lit(0))).cast("long"))
    return out.drop("_few", "_many", "_left", "_won", *[f"_k_{k}" for k in keys])


def block_plan(sources: DataFrame, resolution: int = RESOLUTION, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """``source``, ``block``, ``block_words`` and the ranges ``lo`` to ``hi`` of its words with ``times`` (how often the mix takes them).

    A block is one range, or two where the quota of its shard ends inside it.
    """
    every = Window.partitionBy(F.lit(0))
    size = F.greatest(F.ceil(F.sum("source_size").over(every) / resolution), F.lit(1))
    cut = sources.where("source_size > 0").withColumn("block_words", size.cast("long"))
    cut = cut.withColumns({
        "blocks": F.ceil(F.col("source_size") / F.col("block_words")).cast("long"),
        "seats": F.round(F.sum("target").over(every)).cast("long"),
        "limit": (MOST * F.col("source_size")).cast("long"),
    })
    cut = cut.withColumn("seats", F.least(F.col("seats"), F.sum("limit").over(every)))
    quotas = apportion(cut, [], "target", "seats", "limit", ["source"], "quota")
    blocks = quotas.select("source", "source_size", "block_words", "quota", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    shard = (F.col("block") % shards).cast("int")
    drawn = md5_number(F.concat_ws("/", F.lit(seed), F.coalesce("source", F.lit("\0")), F.col("block")), 12)
    length = F.least(F.col("block_words"), F.col("source_size") - F.col("block") * F.col("block_words"))
    blocks = blocks.withColumns({"shard": shard, "drawn": drawn, "length": length})
    held = blocks.groupBy("source", "shard").agg(F.sum("length").alias("held"), F.first("quota").alias("quota"))
    dealt = apportion(held.withColumn("limit", MOST * F.col("held")), ["source"], "held", "quota", "limit", ["shard"], "own")
    own = dealt.select(F.col("source").alias("_s"), F.col("shard").alias("_h"), "held", "own")
    placed = blocks.join(own, blocks["source"].eqNullSafe(F.col("_s")) & (blocks["shard"] == F.col("_h")))
    before = Window.partitionBy("source", "shard").orderBy("drawn", "block").rowsBetween(Window.unboundedPreceding, -1)
    more = F.col("own") % F.col("held") - F.coalesce(F.sum("length").over(before), F.lit(0))
    placed = placed.withColumns({"passes": F.floor(F.col("own") / F.col("held")).cast("long"), "more": F.least(F.greatest(more, F.lit(0)), F.col("length"))})
    range_ = lambda lo, hi, times: F.struct(lo.cast("long").alias("lo"), hi.cast("long").alias("hi"), times.cast("long").alias("times"))
    ranges = F.array(range_(F.lit(0), F.col("more"), F.col("passes") + 1), range_(F.col("more"), F.col("length"), F.col("passes")))
    return placed.select("source", "block", "block_words", F.inline(F.filter(ranges, lambda r: r["lo"] < r["hi"])))


def positions(rows: DataFrame) -> DataFrame:
    """Adds ``begin``, the words of the source before a document: streams go by hash cell, then doc_id, then size."""
    celled = rows.withColumn("_cell", (md5_number(F.col("doc_id")) % CELLS).cast("int"))
    cells = celled.groupBy("source", "_cell").agg(F.sum("size").alias("_words"))
    before = Window.partitionBy("source").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    base = cells.select(F.col("source").alias("_s"), F.col("_cell").alias("_c"), F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_base"))
    order = [c for c in ("doc_id", "size", "row") if c in rows.columns]
    inside = Window.partitionBy("source", "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = celled.withColumn("_own", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = own.join(base, own["source"].eqNullSafe(F.col("_s")) & (F.col("_cell") == F.col("_c")))
    return joined.withColumn("begin", F.col("_base") + F.col("_own")).drop("_cell", "_own", "_s", "_c", "_base")


def _plan(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = staged(targets(sizes), "targets")
    return sources, staged(block_plan(sources), "blocks"), positions(rows.where("size > 0"))


def _segments(placed: DataFrame, plan: DataFrame, keep: list[str]) -> DataFrame:
    """The parts of documents by block: ``from`` and ``upto`` in words of the document, and ``times``."""
    cut = placed.withColumn("w", plan.agg(F.max("block_words")).scalar())
    parts = cut.withColumn(
        "b", F.explode(F.sequence(F.floor(F.col("begin") / F.col("w")), F.floor((F.col("begin") + F.col("size") - 1) / F.col("w"))))
    )
    taken = plan.select(F.col("source").alias("_s"), F.col("block").alias("_b"), "lo", "hi", "times")
    joined = parts.join(taken, parts["source"].eqNullSafe(F.col("_s")) & (F.col("b") == F.col("_b")))
    start = F.greatest(F.col("b") * F.col("w") + F.col("lo"), F.col("begin")) - F.col("begin")
    stop = F.least(F.col("b") * F.col("w") + F.col("hi"), F.col("begin") + F.col("size")) - F.col("begin")
    return joined.select(*keep, start.alias("from"), stop.alias("upto"), "times").where("from < upto")


def taken_words(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source, source_size, target, taken."""
    rows = staged(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(whole()).alias("size")), "sizes"
    )
    sources, plan, placed = _plan(rows)
    parts = _segments(placed, plan, ["doc_id", "source", "size", "begin"])
    taken = parts.groupBy("doc_id", "source", "size", "begin").agg(F.sum((F.col("upto") - F.col("from")) * F.col("times")).alias("taken"))
    every = taken.select("doc_id", "source", "size", "taken").unionByName(
        rows.where("size = 0").select("doc_id", "source", "size", F.lit(0).cast("long").alias("taken"))
    )
    known = sources.select(F.col("source").alias("_s"), "source_size", "target")
    return every.join(known, every["source"].eqNullSafe(F.col("_s"))).select("doc_id", "size", "source", "source_size", "target", "taken")


def mix(docs: DataFrame) -> DataFrame:
    """The documents of the mix, with the columns of ``docs``.

    A document comes once for the words that the mix takes, and once more for
    those it takes twice. Where only part is taken, the text is that part, its
    words joined by single spaces; whole documents stay as they are. Documents
    without words are not taken.
    """
    text = whole()
    rows = docs.withColumns({"_size": word_count(text), "_hash": F.xxhash64(text)})
    slim = staged(
        rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("_size").alias("size"), F.col("_hash").alias("row")), "sizes"
    )
    sources, plan, placed = _plan(slim)
    parts = _segments(placed, plan, ["doc_id", "source", "row", "size", "begin"]).where("times > 0")
    copies = parts.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    chosen = copies.groupBy(F.col("doc_id").alias("_doc"), F.col("source").alias("_src"), F.col("row").alias("_row"), "size", "begin", "copy").agg(
        F.array_sort(F.collect_list(F.struct("from", "upto"))).alias("_parts"), F.sum(F.col("upto") - F.col("from")).alias("_words")
    )
    # rows that agree in doc_id, source and text are numbered on both sides, here by all their columns
    same = Window.partitionBy("_doc", "_src", "_row", "copy").orderBy("begin")
    chosen = chosen.withColumn("_n", F.dense_rank().over(same)).drop("begin", "size")
    repeated = slim.groupBy("doc_id", "source", "row").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() > 0
    if repeated:
        rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy("doc_id", "source", "_hash").orderBy(F.xxhash64(*docs.columns))))
    else:
        rows = rows.withColumn("_k", F.lit(1))
    joined = rows.join(
        chosen,
        F.col("doc_id").cast("long").eqNullSafe(F.col("_doc")) & F.col("source").cast("string").eqNullSafe(F.col("_src"))
        & (F.col("_hash") == F.col("_row")) & (F.col("_k") == F.col("_n")),
    )
    # the list of words is bound once, as the only element of an array
    cut = lambda w: F.flatten(F.transform("_parts", lambda p: F.slice(w, (p["from"] + 1).cast("int"), (p["upto"] - p["from"]).cast("int"))))
    piece = F.concat_ws(" ", F.flatten(F.transform(F.array(words(F.col("text"))), cut)))
    part = F.col("_words") < F.col("_size")
    out = joined.withColumn("text", F.when(part, piece).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(part, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)

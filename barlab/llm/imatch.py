"""I-Match fingerprints with several randomised lexicon subsets, in SQL functions only.

The lexicon is all terms whose inverse document frequency lies in a band: in
at least ``MIN_DOCS`` documents and in at most ``MAX_SHARE`` of them. A term's
hash puts it into subsets of the lexicon, at several sampling rates: at level
``l`` the terms whose hash ends in ``s`` of ``2 ** l`` make subset ``s``, for
the first ``SUBSETS`` values of ``s``. A text uses the four levels at which a
subset holds about three of its terms, half as many, and so on; the
sorted distinct terms that it has in a subset give that subset's hash. Two
fingerprints are as alike as the share of subsets with equal hashes, among the
levels they share and the subsets in which either has a term.

A text with less than ``THIN`` of its looked-up terms in the band, such as one
of a large group of near copies that push their common terms above it, has the
hashes of the same subsets over all its terms, and whatever is compared with it
is compared by these.

Frequencies count every term of every distinct text. Only terms in some subset of a
text are looked up; terms above the band are few at any size (their number is
at most the mean document's terms over ``MAX_SHARE``) and are taken out before.

The next document is found by cutting doc_id into ranges at sketched quantiles
and sending the first document of a range to the one before as well, so whole
texts are shuffled once and no range is large.

Defined cases: a null or empty text has no terms and the fingerprint of the
empty set, which is like itself only; rows are ordered by doc_id (null first), then text,
equal rows are neighbours; a lone document is its own next one; an empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlab.llm.common import staged, whole, word_hashes

MIN_DOCS = 2
MAX_SHARE = 0.02
#: In small tables the upper end of the band is so many documents.
MAX_DOCS_LEAST = 20
#: A text with a smaller share of its looked-up terms in the band is compared by all its terms.
THIN = 0.25
#: So many copied texts go to every task in one piece; more are joined by a shuffle.
SENT_TEXTS = 1_000_000
SUBSETS = 10
LEVELS = 4
_FIRST_LEVEL = 3
#: Documents a range of doc_id, as long as there are no more than ``MAX_RANGES``.
RANGE_ROWS = 2000
MAX_RANGES = 1 << 16


def term_hashes(text: Column) -> Column:
    """Hashes of the distinct words, lower-cased."""
    return word_hashes(F.lower(text))


def frequencies(docs: DataFrame) -> tuple[DataFrame, int]:
    """``term`` (hash) and ``docs``: in how many distinct texts it stands; and the number of distinct texts."""
    texts = staged(docs.select(F.xxhash64(whole()).alias("_text")).groupBy("_text").agg(F.count(F.lit(1)).alias("copies")), "texts")
    copied = texts.where("copies > 1")
    small = copied.limit(SENT_TEXTS + 1).count() <= SENT_TEXTS
    rows = docs.select(whole().alias("text")).withColumn("_key", F.xxhash64("text"))
    weighed = rows.join(F.broadcast(copied) if small else copied, F.col("_key") == F.col("_text"), "left")
    # the copies of a text count as one together
    own = weighed.select(F.explode(term_hashes(F.col("text"))).alias("term"), (1 / F.coalesce("copies", F.lit(1))).alias("part"))
    return own.groupBy("term").agg(F.round(F.sum("part")).cast("long").alias("docs")), texts.count()


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, key (hash of both) and the next document's text and key."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"))
    n = rows.count()
    if not n:
        return rows.select("doc_id", "text", F.lit(0).cast("long").alias("key"), F.col("text").alias("next_text"), F.lit(0).cast("long").alias("next_key"))
    side = min(ceil(sqrt(ceil(n / RANGE_ROWS))), ceil(sqrt(MAX_RANGES)))
    grid = [i / side**2 for i in range(1, side**2)]
    cuts = rows.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, grid)), F.lit(20 * side**2))).first()[0] if grid else []
    cuts = sorted(set(cuts or []))
    lists = [cuts[i : i + side] for i in range(0, len(cuts), side)]
    if lists:
        # two short searches: which list of cuts, then which cut in it
        tops = F.array(*[F.lit(c[-1]) for c in lists])
        top = F.size(F.filter(tops, lambda c: c < F.col("doc_id")))
        below = F.size(F.filter(F.coalesce(F.get(F.array(*[F.array(*map(F.lit, c)) for c in lists]), top), F.array().cast("array<long>")), lambda c: c < F.col("doc_id")))
        part = F.coalesce(top * side + below, F.lit(-1))
    else:
        part = F.lit(0)
    placed = rows.withColumn("part", part)
    # one row a range
    firsts = {r.part: r.first for r in placed.groupBy("part").agg(F.min(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("first")).collect()}
    order = sorted(firsts)
    before = {p: order[i - 1] for i, p in enumerate(order)}
    listed = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(firsts[p]).cast("long").alias("first"), F.lit(before[p]).alias("before")) for p in order])
    index = F.array(*[F.lit(p) for p in order])
    own = F.get(listed, F.array_position(index, F.col("part")).cast("int") - 1)
    leads = F.coalesce("doc_id", F.lit(-(1 << 63))) == own["first"]
    to = F.when(leads, F.array(F.struct(F.col("part").alias("part"), F.lit(0).alias("guest")), F.struct(own["before"].alias("part"), F.lit(1).alias("guest")))).otherwise(
        F.array(F.struct(F.col("part").alias("part"), F.lit(0).alias("guest")))
    )
    sent = placed.select("doc_id", "text", F.explode(to).alias("to")).select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"), "to.part", "to.guest")
    following = Window.partitionBy("part").orderBy("guest", F.col("doc_id").asc_nulls_first(), "key")
    out = sent.withColumns({"next_text": F.lead("text").over(following), "next_key": F.lead("key").over(following)})
    return out.where("guest = 0").drop("part", "guest")


def _first_level(terms: Column) -> Column:
    return F.greatest(F.lit(_FIRST_LEVEL), F.floor(F.log2(F.greatest(F.size(terms), F.lit(1)))).cast("int") - 1)


def _chosen(terms: Column, level: Column) -> Column:
    """The terms in some subset at the first level; those of the later levels are among them."""
    return F.filter(terms, lambda h: h.bitwiseAND(F.pow(F.lit(2.0), level).cast("long") - 1) < SUBSETS)


def _ends_in(mask: Column, value: int) -> Callable[[Column], Column]:
    return lambda h: h.bitwiseAND(mask) == value


def _hashes(terms: Column, level: Column) -> Column:
    """A hash for each level and subset, null where the text has no term in it."""
    out = []
    for k in range(LEVELS):
        mask = F.pow(F.lit(2.0), level + k).cast("long") - 1
        for s in range(SUBSETS):
            own = F.filter(terms, _ends_in(mask, s))
            out.append(F.when(F.size(own) > 0, F.shiftright(F.xxhash64(own), 32).cast("int")))
    return F.array(*out)


def _share(a: Column, level_a: Column, b: Column, level_b: Column, same: Column) -> Column:
    """Share of equal subset hashes; ``same`` decides where neither has any."""
    low, high = F.greatest(level_a, level_b), F.least(level_a, level_b) + LEVELS
    size = F.greatest(high - low, F.lit(0)) * SUBSETS
    x, y = F.slice(a, (low - level_a) * SUBSETS + 1, size), F.slice(b, (low - level_b) * SUBSETS + 1, size)
    marks = F.zip_with(x, y, lambda p, q: F.when(p.isNull() & q.isNull(), F.lit(0)).when(p.eqNullSafe(q), F.lit(1)).otherwise(F.lit(2)))
    equal = F.size(F.filter(marks, lambda m: m == 1))
    some = F.size(F.filter(marks, lambda m: m > 0))
    return F.when(size == 0, 0.0).when(some > 0, equal / some).otherwise(F.coalesce(same.cast("double"), F.lit(0.0)))


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two structs of ``level``, ``band`` and ``every`` (subset hashes), ``thin`` and ``all`` (hash of all terms)."""
    same = a["all"] == b["all"]
    by_all = _share(a["every"], a["level"], b["every"], b["level"], same)
    return F.when(a["thin"] | b["thin"], by_all).otherwise(_share(a["band"], a["level"], b["band"], b["level"], same))


def _text(f: Column) -> Column:
    cells = F.transform(F.when(f["thin"], f["every"]).otherwise(f["band"]), lambda h: F.coalesce(F.lower(F.right(F.concat(F.lit("0000000"), F.hex(h)), F.lit(8))), F.lit("-")))
    return F.concat(F.when(f["thin"], "all:").otherwise(""), f["level"].cast("string"), F.lit(":"), F.concat_ws(",", cells))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text is the text with its last half replaced by the beginning of the next document.
    """
    counted, n = frequencies(docs)
    counts = staged(counted, "frequencies")
    most = max(MAX_DOCS_LEAST, MAX_SHARE * n)
    frequent = counts.where(F.col("docs") > most).select("term")
    lexicon = counts.where(F.col("docs").between(MIN_DOCS, most)).select("term")

    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.left("text", F.length("text") - half), F.left("next_text", half))
    both = with_next(docs).select("doc_id", "key", "next_key", F.length("text").cast("long").alias("n_chars"), "text", edited.alias("edited"))
    terms = both.select(
        "doc_id", "key", "next_key", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        term_hashes(F.col("text")).alias("x"), term_hashes(F.col("edited")).alias("y"),
    )
    levelled = terms.withColumns({"lx": _first_level(F.col("x")), "ly": _first_level(F.col("y"))})
    chosen = levelled.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "key", "next_key", "n_chars", "edited_sha256", "lx", "ly",
        F.xxhash64(F.sort_array("x")).alias("all_x"), F.xxhash64(F.sort_array("y")).alias("all_y"),
        _chosen(F.col("x"), F.col("lx")).alias("x"), _chosen(F.col("y"), F.col("ly")).alias("y"),
    )
    held = staged(chosen, "terms")

    pairs = held.select("row", F.explode(F.concat(
        F.transform("x", lambda h: F.struct(h.alias("term"), F.lit(False).alias("edit"))),
        F.transform("y", lambda h: F.struct(h.alias("term"), F.lit(True).alias("edit"))),
    )).alias("t")).select("row", "t.term", "t.edit")
    # terms above the band: their number has a bound that no corpus size changes
    rare = pairs.join(F.broadcast(frequent), "term", "left_anti")
    kept = rare.join(lexicon, "term").groupBy("row").agg(
        F.sort_array(F.collect_list(F.when(~F.col("edit"), F.col("term")))).alias("x"),
        F.sort_array(F.collect_list(F.when(F.col("edit"), F.col("term")))).alias("y"),
    )
    none = F.array().cast("array<long>")
    every = held.select(
        "row", "doc_id", "key", "next_key", "n_chars", "edited_sha256", "lx", "ly", "all_x", "all_y", F.size("x").alias("nx"), F.size("y").alias("ny"),
        _hashes(F.sort_array("x"), F.col("lx")).alias("ex"), _hashes(F.sort_array("y"), F.col("ly")).alias("ey"),
    )
    meta = every.join(kept, "row", "left").withColumns({"x": F.coalesce("x", none), "y": F.coalesce("y", none)})
    found = [
        F.struct(
            F.col(f"l{v}").alias("level"), _hashes(F.col(v), F.col(f"l{v}")).alias("band"), F.col(f"e{v}").alias("every"),
            ((F.size(v) == 0) | (F.size(v) < THIN * F.col(f"n{v}"))).alias("thin"), F.col(f"all_{v}").alias("all"),
        ).alias(f"f{v}")
        for v in ("x", "y")
    ]
    done = staged(meta.select("doc_id", "key", "next_key", "n_chars", "edited_sha256", *found), "hashes")
    after = done.select(F.col("key").alias("_key"), F.col("fx").alias("_f")).dropDuplicates(["_key"])
    joined = done.join(after, F.col("next_key") == F.col("_key"), "left")
    x, y, after_x = F.col("fx"), F.col("fy"), F.col("_f")
    return joined.select(
        "doc_id", "n_chars", "edited_sha256", _text(x).alias("fingerprint"), _text(y).alias("edited_fingerprint"),
        likeness(x, y).alias("near_edited"), likeness(x, after_x).alias("near_next"),
    )

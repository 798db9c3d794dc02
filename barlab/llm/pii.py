"""Personal data by weak supervision, in SQL functions only.

One scan finds candidate spans of every kind by pattern. Labelers vote on each
candidate (1 personal, -1 not, 0 abstains): the pattern's own check (ranges,
Luhn, digit counts), gazetteers (given lists of domains and of country codes)
and the words around it. Expectation-maximisation over the vote patterns
estimates how reliable each labeler is for each kind; the number of vote
patterns is bounded (three votes to the power of three labelers, times kinds),
so it runs over that table alone. A final naive Bayes classifier over span
features, trained on all candidates weighted by their posteriors, gives each
candidate its probability.

Spans of the four base kinds that pass their check are always kept. The
classifier adds candidates of probability ``ACCEPT`` or more that overlap no base span: secrets
(long hexadecimal keys), and base-kind candidates that fail their check.

Positions are code points, end exclusive. Patterns are the fixed ones of the
contract, written without backtracking: a match can only begin where a run of
its characters begins, or at the end of the last match.

Defined cases: a null or empty text has no spans; rows that share a doc_id but
not the text are separate documents, equal rows get equal results; a null
doc_id is carried through; a table without candidates skips the estimates;
an empty table gives an empty result. ``mask`` keeps all columns.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlab.llm.common import staged, whole

# The kinds in their order, and their patterns.
BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "secret"]
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9])[0-9A-Fa-f]{24,}+(?![A-Za-z0-9])",
}
ACCEPT = 0.9
#: Words before a span that speak for a kind, and last parts of domains and country codes that are known. Parameters.
CONTEXT = {
    "email": ["mail", "email", "e-mail", "contact", "write"],
    "ip": ["ip", "host", "address", "server", "addr"],
    "card": ["card", "visa", "mastercard", "credit", "carte", "karte", "tarjeta"],
    "phone": ["phone", "tel", "call", "mobile", "fax"],
    "secret": ["token", "secret", "password", "api_key", "apikey", "key", "bearer"],
}
GAZETTEER = {
    "email": ["com", "org", "net", "edu", "gov", "de", "fr", "es", "uk", "io"],
    "phone": ["1", "33", "34", "39", "44", "49", "81", "86", "91"],
}
LABELERS = ["check", "gazetteer", "context"]
FEATURES = ["check", "gazetteer", "context", "length", "digits", "assigned", "quoted"]
_ROUNDS = 50


def _candidates_of(kind: str, text: Column) -> Column:
    """An array with every match: its number, text, the gap before it and what stands around it."""
    gaps, found = F.split(text, PATTERNS[kind]), F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    cell = lambda x: F.struct(
        F.lit(kind).alias("kind"), x["found"].alias("found"), F.length(x["gap"]).alias("gap"),
        F.right(x["gap"], F.lit(24)).alias("before"), F.left(x["after"], F.lit(1)).alias("after"),
    )
    zipped = F.arrays_zip(found.alias("found"), gaps.alias("gap"), F.slice(gaps, F.lit(2), F.size(gaps)).alias("after"))
    cells = F.filter(F.transform(zipped, lambda x: cell(x)), lambda c: c["found"].isNotNull())
    return F.transform(cells, lambda c, i: F.struct(i.alias("at"), *[c[n].alias(n) for n in ("kind", "found", "gap", "before", "after")]))


def candidates(docs: DataFrame) -> DataFrame:
    """One row per candidate: doc_id and hash of its text, kind, start, end and the candidate's own text and surroundings."""
    text = F.col("text")
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"))
    # a text without any of these signs has no candidate of any kind
    read = read.where(text.rlike(r"[0-9@]|[A-Fa-f]{24}"))
    # texts are told apart by hash and length, so that rows that share a doc_id stay apart
    key = [F.col("doc_id"), F.xxhash64(text).alias("text_hash"), F.length(text).alias("n_chars")]
    # the gate of each kind is cheap; the pattern runs only behind it
    gates = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+")), "ip": text.rlike(r"[0-9]\.[0-9]"),
             "card": text.rlike(r"[0-9][\x20-]?[0-9]"), "secret": text.rlike("[0-9A-Fa-f]{24}")}
    arrays = [F.when(gates[k], _candidates_of(k, text)) for k in KINDS]
    empty = F.filter(F.array(F.struct(*[F.lit(v).cast(t).alias(n) for n, v, t in _CELL])), lambda c: F.lit(False))
    rows = read.select(*key, F.flatten(F.array(*[F.coalesce(a, empty) for a in arrays])).alias("cells")).where(F.size("cells") > 0)
    found = rows.select("doc_id", "text_hash", "n_chars", F.inline("cells")).distinct()
    upto = Window.partitionBy("doc_id", "text_hash", "n_chars", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("found")
    end = F.sum(F.col("gap") + size).over(upto)
    return found.withColumn("end", end).withColumn("start", F.col("end") - size)


_CELL = [("at", 0, "int"), ("kind", "", "string"), ("found", "", "string"), ("gap", 0, "int"), ("before", "", "string"), ("after", "", "string")]


def luhn(digits: Column) -> Column:
    """Whether a text of digits has a valid check digit."""
    figures = F.reverse(F.split(digits, ""))
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    values = F.transform(figures, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(doubled(c.cast("int"))))
    return F.aggregate(values, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) % 10 == 0


def _passes() -> Column:
    """The check of each kind."""
    found, kind = F.col("found"), F.col("kind")
    digits = F.regexp_replace(found, "[^0-9]", "")
    parts = F.transform(F.split(found, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    ip = F.forall(parts, lambda p: (F.length(p) <= 3) & (p.cast("int") <= 255))
    # Luhn only over texts of card length, so that long digit runs cost nothing
    card = F.length(digits).between(12, 19) & luhn(F.substring(digits, 1, 19))
    phone = F.length(digits).between(9, 15)
    secret = found.rlike("[0-9]") & found.rlike("[A-Fa-f]")
    return (
        F.when(kind == "email", F.lit(True)).when(kind == "ip", ip).when(kind == "card", card)
        .when(kind == "phone", phone).otherwise(secret)
    )


def _listed(value: Column, lists: dict[str, Sequence[str]], kind: Column) -> Column:
    out = F.lit(None).cast("boolean")
    for k, entries in lists.items():
        out = F.when(kind == k, value.isin(list(entries))).otherwise(out)
    return out


def votes(found: DataFrame, context: dict = CONTEXT, gazetteer: dict = GAZETTEER) -> DataFrame:
    """Adds the votes of the labelers and the features of the final classifier, all small numbers."""
    kind = F.col("kind")
    near = F.split(F.lower("before"), r"[^\p{L}\p{N}_-]+")
    spoken = F.lit(None).cast("boolean")
    for k, entries in context.items():
        spoken = F.when(kind == k, F.arrays_overlap(near, F.array(*map(F.lit, entries)))).otherwise(spoken)
    code = F.regexp_extract("found", r"^\+([0-9]{1,2})", 1)
    listed = F.when(kind == "email", F.lower(F.substring_index("found", ".", -1))).when(
        kind == "phone", F.when(F.substring(code, 1, 1) == "1", F.lit("1")).otherwise(code)
    )
    known = _listed(listed, gazetteer, kind)
    passed = _passes()
    size, digits = F.length("found"), F.length(F.regexp_replace("found", "[^0-9]", ""))
    return found.withColumns({
        "base": passed & kind.isin(BASE),
        "check": F.when(passed, F.lit(1)).otherwise(F.lit(-1)),
        "gazetteer": F.when(known, F.lit(1)).when(~known, F.lit(-1)).otherwise(F.lit(0)),
        "context": F.when(spoken, F.lit(1)).otherwise(F.lit(0)),
        "length": F.least(F.floor(F.log2(size)), F.lit(7)).cast("int"),
        "digits": F.floor(digits * 4 / F.greatest(size, F.lit(1))).cast("int"),
        "assigned": F.col("before").rlike(r"[=:]\s*[\"']?$").cast("int"),
        "quoted": (F.col("before").rlike("[\"']$") & F.col("after").rlike("^[\"']")).cast("int"),
    })


def reliabilities(counts: list[tuple[tuple[int, ...], float]]) -> dict[tuple[int, ...], float]:
    """Posterior of each vote pattern by expectation-maximisation over (pattern, count).

    Two classes; each labeler has its own chance of each vote in each class.
    It starts from labelers that are right three times in four, and every
    chance is smoothed towards that start, so that a labeler nobody contradicts
    stays a witness and not an oracle.
    """
    start = {1: {1: 0.55, 0: 0.25, -1: 0.2}, 0: {1: 0.2, 0: 0.25, -1: 0.55}}
    labelers = range(len(counts[0][0])) if counts else range(0)
    chance = [{c: dict(start[c]) for c in (0, 1)} for _ in labelers]
    prior, post = 0.5, {}
    total = sum(n for _, n in counts)
    weight = max(1.0, 0.05 * total)
    for _ in range(_ROUNDS):
        for pattern, _n in counts:
            odds = math.log(prior / (1 - prior)) + sum(math.log(chance[j][1][v] / chance[j][0][v]) for j, v in enumerate(pattern))
            post[pattern] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        prior = (sum(n * post[p] for p, n in counts) + 0.5 * weight) / (total + weight)
        for j in labelers:
            for c in (0, 1):
                mass = {v: weight * start[c][v] for v in (1, 0, -1)}
                for pattern, n in counts:
                    mass[pattern[j]] += n * (post[pattern] if c else 1 - post[pattern])
                chance[j][c] = {v: m / sum(mass.values()) for v, m in mass.items()}
    return post


def classify(voted: DataFrame) -> DataFrame:
    """Adds ``probability``: naive Bayes over the span features, trained on all candidates by their posteriors."""
    # counts per kind, votes and features: every column takes a handful of values, so the table is bounded
    combos = voted.groupBy("kind", *FEATURES).agg(F.count(F.lit(1)).alias("n")).collect()
    spark = voted.sparkSession
    rows = []
    for kind in sorted({r.kind for r in combos}):
        own = [r for r in combos if r.kind == kind]
        patterns: dict[tuple[int, ...], float] = {}
        for r in own:
            key = tuple(r[x] for x in LABELERS)
            patterns[key] = patterns.get(key, 0) + r.n
        post = reliabilities(list(patterns.items()))
        soft = [(tuple(r[x] for x in FEATURES), r.n, post[tuple(r[x] for x in LABELERS)]) for r in own]
        yes, no = sum(n * p for _, n, p in soft) + 1, sum(n * (1 - p) for _, n, p in soft) + 1
        tables = []
        for j in range(len(FEATURES)):
            seen: dict[int, list[float]] = {}
            for values, n, p in soft:
                cell = seen.setdefault(values[j], [1.0, 1.0])
                cell[0] += n * p
                cell[1] += n * (1 - p)
            tables.append({v: math.log(a / yes) - math.log(b / no) for v, (a, b) in seen.items()})
        for values, _n, _p in soft:
            # features of one span agree too often to count in full: their mean evidence is scaled to three witnesses
            odds = math.log(yes / no) + sum(t[v] for t, v in zip(tables, values, strict=True)) * 3 / len(FEATURES)
            rows.append((kind, *values, 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))))
    schema = "kind string, " + ", ".join(f"{x} int" for x in FEATURES) + ", probability double"
    return voted.join(spark.createDataFrame(rows, schema), ["kind", *FEATURES])


def spans(docs: DataFrame, context: dict = CONTEXT, gazetteer: dict = GAZETTEER) -> DataFrame:
    """All kept spans: doc_id, text_hash, n_chars, kind, start, end, base, probability."""
    voted = staged(votes(candidates(docs), context, gazetteer), "votes")
    judged = classify(voted)
    doc = ["doc_id", "text_hash", "n_chars"]
    # an added span must not touch a base span: the furthest base end before it, the nearest base start after it
    order = Window.partitionBy(*doc).orderBy("start", F.col("base").desc(), "end")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(1, Window.unboundedFollowing)
    judged = judged.withColumn("_last", F.max(F.when(F.col("base"), F.col("end"))).over(before)).withColumn(
        "_next", F.min(F.when(F.col("base"), F.col("start"))).over(after)
    )
    clear = F.coalesce(F.col("_last") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("_next") >= F.col("end"), F.lit(True))
    keep = F.col("base") | ((F.col("probability") >= ACCEPT) & clear)
    return judged.where(keep).select(*doc, "kind", "start", "end", "base", "probability")


def _order() -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")


def report(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, counts of the base kinds, base_sha256 and all spans as text."""
    found = staged(spans(docs), "spans")
    doc = ["doc_id", "text_hash", "n_chars"]
    said = F.concat_ws(":", "kind", "start", "end")
    cell = F.struct("start", _order().alias("rank"), "base", said.alias("said"))
    listed = found.groupBy(*doc).agg(
        *[F.sum((F.col("base") & (F.col("kind") == k)).cast("long")).alias(f"n_{k}") for k in BASE],
        F.array_sort(F.collect_list(cell)).alias("cells"),
    )
    text = whole()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.length(text).alias("n_chars"))
    on = [rows[c].eqNullSafe(listed[c]) for c in doc]
    joined = rows.join(listed, on, "left")
    base = F.concat_ws(",", F.transform(F.filter("cells", lambda c: c["base"]), lambda c: c["said"]))
    every = F.concat_ws(",", F.transform("cells", lambda c: c["said"]))
    return joined.select(
        rows["doc_id"], *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(F.coalesce(base, F.lit("")), 256).alias("base_sha256"), F.coalesce(every, F.lit("")).alias("spans"),
    )


def mask(docs: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The rows of ``docs`` with every span replaced by its kind in brackets; a clean text stays as it is."""
    found = spans(docs)
    doc = ["doc_id", "text_hash", "n_chars"]
    # spans of different kinds may overlap: the first of an overlapping run names it
    order = Window.partitionBy(*doc).orderBy("start", _order(), "end")
    last = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    heads = found.withColumn("head", F.coalesce(F.col("start") >= last, F.lit(True)).cast("int"))
    runs = heads.withColumn("run", F.sum("head").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = runs.groupBy(*doc, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", _order())).alias("kind"))
    cuts = merged.groupBy(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), F.col("n_chars").alias("_size")).agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("_cuts")
    )
    raw = whole(text)
    keyed = docs.withColumns({"_text_hash": F.xxhash64(raw), "_text_size": F.length(raw)})
    joined = keyed.join(
        cuts, F.col("doc_id").cast("long").eqNullSafe(F.col("_doc")) & (F.col("_text_hash") == F.col("_hash")) & (F.col("_text_size") == F.col("_size")), "left"
    )
    # the text between the cuts: from the end of one to the start of the next
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform("_cuts", lambda c: c["end"]))
    ends = F.concat(F.transform("_cuts", lambda c: c["start"]), F.array(F.col("_text_size").cast("long")))
    names = F.concat(F.transform("_cuts", lambda c: F.concat(F.lit("["), F.upper(c["kind"]), F.lit("]"))), F.array(F.lit("")))
    piece = lambda p: F.concat(F.substr(raw, (p["b"] + 1).cast("int"), (p["e"] - p["b"]).cast("int")), p["n"])
    pieces = F.transform(F.arrays_zip(begins.alias("b"), ends.alias("e"), names.alias("n")), piece)
    masked = F.when(F.col("_cuts").isNull(), F.col(text)).otherwise(F.concat_ws("", pieces))
    changed = {text: masked}
    if n_chars in docs.columns:
        size = F.when(F.col("_cuts").isNull(), F.col(n_chars)).otherwise(F.length(masked))
        changed[n_chars] = size.cast(docs.schema[n_chars].dataType)
    out = joined.withColumns(changed)
    return out.select(*docs.columns)

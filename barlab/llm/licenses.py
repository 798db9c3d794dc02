"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

Units of a file are its lines and paragraphs that name a licence, its leading
comment block if that names one, and the whole text of a licence file. Templates
are full texts, standard headers, titles and identifiers, several a licence.
Terms are weighed by counts times inverse document frequency over all files; a
file has the licence of the template that is most like one of its units, from
``LEAST`` on, among those whose own terms (name, version) the unit holds, so an
unknown licence is not taken for the one that its notice looks like. A directory has the licence of its licence
files. A file without a licence of its own takes that of its nearest ancestor
directory: each file is joined to its ancestors by their paths.

Defined cases: a null or empty text has no unit and can only inherit; a null
path neither gives nor takes; of equal likeness the template first by name
wins, of several licence files in one directory the one most like its template,
then the first path; repeated rows give repeated results; an empty table gives
an empty result. Columns besides path and text are not read; those called as
a result column (direct_license, cosine, license, basis, license_dir) give way
to it, and ``text`` is not handed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlab.llm.common import staged
from barlab.llm.license_texts import Statement, statements

LEAST = 0.6
SALTS = 32
#: A line without any of these is no licence statement.
ANCHORS = r"(?i)licen[cs]e|copyright|spdx|redistribut"
#: A line of a comment, or one without text.
COMMENT = r"^\s*(//|#|\*|/\*|--|;|%|<!--|\(\*|dnl |rem |\"\"\"|'''|$)"
FILE_NAMES = r"(?i)^(licen[cs]e|copying|notice)([._-].*)?$"


def terms(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def document_frequencies(files: DataFrame) -> DataFrame:
    """``term`` and in how many files it stands, over all files."""
    return files.select(F.explode(F.array_distinct(terms(F.coalesce("text", F.lit(""))))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("docs"))


def _weights(counted: DataFrame, frequencies: DataFrame, n: int, key: str) -> DataFrame:
    """Adds ``weight`` and ``norm`` to rows of (key, term, count)."""
    idf = F.log(F.lit(float(n + 1)) / (F.coalesce("docs", F.lit(0)) + 1)) + 1
    weighed = counted.join(frequencies, "term", "left").select(key, "term", (F.col("count") * idf).alias("weight"))
    norms = weighed.groupBy(key).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    return weighed.join(norms, key)


def units_of(text: Column, name: Column) -> Column:
    """All units of a text that name a licence."""
    lines = F.split(text, "\r?\n")
    body = F.array_position(F.transform(lines, lambda line: line.rlike(COMMENT)), False)
    lead = F.array_join(F.when(body == 0, lines).otherwise(F.slice(lines, F.lit(1), F.greatest(body.cast("int") - 1, F.lit(0)))), "\n")
    # a line with no letter or digit ends a paragraph
    paragraphs = F.split(text, r"\n[^\p{L}\p{N}\n]*\n")
    whole = F.when(name.rlike(FILE_NAMES), F.array(text)).otherwise(F.array().cast("array<string>"))
    named = F.filter(F.concat(lines, paragraphs, F.array(lead)), lambda unit: unit.rlike(ANCHORS))
    return F.array_distinct(F.concat(named, whole))


def scan(files: DataFrame, templates: list[Statement] | None = None, least: float = LEAST) -> DataFrame:
    """Every row of ``files`` with direct_license, cosine, license, basis (own, inherited or none) and license_dir."""
    spark = files.sparkSession
    templates = statements() if templates is None else templates
    text = F.coalesce("text", F.lit(""))
    name = F.substring_index("path", "/", -1)
    keyed = files.select(F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    units = keyed.where(text.rlike(ANCHORS)).select("path", F.explode(units_of(text, name)).alias("unit"))
    units = staged(units.where("path is not null").distinct().withColumn("key", F.xxhash64("unit")), "units")
    n = files.count()
    frequencies = staged(document_frequencies(keyed), "frequencies")

    listed = spark.createDataFrame([(i, *t) for i, t in enumerate(templates)], "form int, license string, unit string, must string")
    known = _weights(listed.select("form", F.explode(terms(F.col("unit"))).alias("term")).groupBy("form", "term").agg(F.count(F.lit(1)).alias("count")), frequencies, n, "form")
    known = known.select("form", "term", F.col("weight").alias("w"), F.col("norm").alias("m"))
    counted = units.dropDuplicates(["key"]).select("key", F.explode(terms(F.col("unit"))).alias("term")).groupBy("key", "term").agg(F.count(F.lit(1)).alias("count"))
    own = _weights(counted, frequencies, n, "key")
    alike = own.join(known, "term").groupBy("key", "form").agg(
        (F.sum(F.col("weight") * F.col("w")) / (F.max("norm") * F.max("m"))).alias("cosine")
    )
    # best first: the most alike (to nine places), then the first name
    best = F.max_by(F.struct("license", "cosine"), F.struct(F.round("cosine", 9), F.translate("license", _FORWARD, _BACKWARD)))
    meant = alike.where(F.col("cosine") >= least).join(listed.select("form", "license", terms(F.col("must")).alias("must")), "form")
    # a notice may stand in a third of all files: its rows are spread over several copies of what it means
    meant = meant.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = units.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int"))
    direct = spread.join(meant, ["key", "salt"]).where(F.size(F.array_except("must", terms(F.col("unit")))) == 0).groupBy("path").agg(best.alias("best"))
    direct = staged(direct.select("path", F.col("best.license").alias("direct_license"), F.round("best.cosine", 6).alias("cosine")), "direct")

    folder = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.lit(""))
    given = direct.where(name.rlike(FILE_NAMES)).withColumn("license_dir", folder).groupBy("license_dir").agg(
        F.min(F.struct((-F.col("cosine")).alias("c"), "path", "direct_license")).alias("g")
    ).select("license_dir", F.col("g.direct_license").alias("given"))
    paths = keyed.select("path").distinct().join(direct, "path", "left")
    steps = F.split(F.col("path"), "/")
    depth = F.size(steps) - 1
    above = paths.where("direct_license is null and path is not null").select(
        "path", F.explode(F.transform(F.sequence(F.lit(0), depth), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(steps, 1, i), "/").alias("license_dir")))).alias("up")
    ).select("path", "up.depth", "up.license_dir")
    nearest = above.join(given, "license_dir").groupBy("path").agg(F.max(F.struct("depth", "license_dir", "given")).alias("g"))
    found = paths.join(nearest, "path", "left").select(
        F.col("path").alias("_path"), "direct_license", "cosine", F.coalesce("direct_license", "g.given").alias("license"),
        F.when(F.col("direct_license").isNotNull(), "own").when(F.col("g").isNotNull(), "inherited").otherwise("none").alias("basis"),
        F.when(F.col("direct_license").isNull(), F.col("g.license_dir")).alias("license_dir"),
    )
    extra = [c for c in files.columns if c not in ("text", "direct_license", "cosine", "license", "basis", "license_dir")]
    slim = files.select(*extra)
    out = slim.join(found, slim["path"].cast("string") == F.col("_path"), "left").drop("_path")
    return out.withColumn("basis", F.coalesce("basis", F.lit("none")))


# names are compared backwards where the largest wins but the first is wanted
_FORWARD = "".join(chr(c) for c in range(32, 127))
_BACKWARD = _FORWARD[::-1]

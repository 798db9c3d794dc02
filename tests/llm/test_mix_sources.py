"""The mix keeps the words of every source where rows share doc_id and text."""

from collections import Counter

from barlab.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_one_text_in_two_sources(spark):
    text = "one two three four five six seven eight"
    rows = [(1, text, "en", "x", len(text)), (1, text, "de", "y", len(text)), (1, text, "fr", "y", len(text)), (2, "a b c", "en", None, 5), (2, "a b c", "en", None, 5)]
    docs = spark.createDataFrame(rows, SCHEMA)
    taken = Counter()
    for r in mixing.taken_words(docs).collect():
        taken[r.source] += r.taken
    mixed = Counter()
    out = mixing.mix(docs).collect()
    for r in out:
        mixed[r.source] += len(r.text.split())
    assert mixed == +taken and set(mixed) == {"x", "y", None}
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(docs.repartition(4)).collect()))

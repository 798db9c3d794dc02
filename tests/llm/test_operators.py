"""Operators against plain Python on small tables: nulls, blanks, ties, repeated rows, clashing columns, empty tables."""

import collections
import hashlib
import html
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlab.llm import hnsw, html_text, imatch, licenses, minhash, mixing, packing, pii, quality, rans, tokens
from barlab.llm.components import components
from barlab.session import new_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, size string, row string, part string, bits string"
RNG = random.Random(5)
VOCABULARY = "the of river stone Market light 12 a.b@c.org +1 (171) 555-2028 10.1.2.3 4111111111111111 éa ## | \U0001f600".split()


def _texts():
    made = [" ".join(RNG.choice(VOCABULARY) for _ in range(RNG.randint(1, 120))) for _ in range(60)]
    near = made[0] + " " + made[1]
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    return [*made, made[3], made[3], near, near + " tail", near + " end of it", "", None, " \n\t ", "one", "one", long, "x" * 50_000, "a\x85b\xa0c"]


def frame(spark, texts=None):
    texts = _texts() if texts is None else texts
    rows = [(None if t == "one" and i % 2 else i, t, "en", None if i % 7 == 0 else f"s{i % 3}", 1, "k", "s", "r", "p", "b") for i, t in enumerate(texts)]
    rows += rows[5:6]  # a repeated row
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    out = frame(spark).persist()
    yield out
    out.unpersist()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark, docs):
    ids = [r.doc_id for r in docs.select("doc_id").collect() if r.doc_id is not None]
    return spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in ids], "doc_id long, quality int, toxic int")


def _ids(text, end):
    return tokens.tokenizer(tokens.default_vocabulary()).model.encode(text or "", add_special_tokens=False).ids + [end]


def test_word_memo_equals_the_tokenizer():
    known = tokens.tokenizer(tokens.default_vocabulary())
    letters = ["a", "'s", "́", "É", "e", "\x85", "\xa0", "\x1c", " ", "\n", "<|endoftext|>", "²", "ς", "Σ", "İ", "ᄀ", "ᅡ", "1", "\U0001f600", "%%", "'", "_"]
    for _ in range(3000):
        text = "".join(RNG.choice(letters) for _ in range(RNG.randint(0, 12)))
        assert np.frombuffer(next(known.ids([text])), "<u2").tolist() == known.model.encode(text, add_special_tokens=False).ids


def test_rans_blocks_and_checkpoints():
    ids = np.array(RNG.choices(range(300), weights=[1 / (i + 1) for i in range(300)], k=400_001), dtype=np.uint16)
    coder = rans.Coder(rans.quantise(np.bincount(ids, minlength=1 << 16)))
    stream, states, points = coder.encode(ids)
    assert (coder.decode(stream, states, len(ids)) == ids).all()
    for part in (1, 2, 3):
        assert (coder.decode(stream, states, len(ids), points, part) == ids[part * rans.CHECKPOINT * rans.LANES :]).all()
    single = rans.Coder(rans.quantise(np.bincount([7] * 5, minlength=1 << 16)))
    assert single.decode(*single.encode(np.array([7] * 5, dtype=np.uint16))[:2], 5).tolist() == [7] * 5


def test_crc_join():
    a, b, c = b"abc", b"", b"defghij" * 1000
    assert rans.crc_join([(zlib.crc32(x), len(x)) for x in (a, b, c)]) == zlib.crc32(a + b + c)


def test_token_files_round_trip(spark, docs):
    folder = new_path(spark, "rans")
    rans.write_files(docs, folder, tokens.default_vocabulary(), block_ids=5000)
    got = sorted(((-1 if r.doc_id is None else r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in rans.digests(spark, folder).collect())
    want, at = [], 0
    rows = [(-1 if r.doc_id is None else r.doc_id, np.array(_ids(r.text, 2), "<u4")) for r in docs.collect()]
    for doc, ids in sorted(rows, key=lambda r: (r[0], r[1].astype("<u2").tobytes())):
        want.append((doc, at, len(ids), zlib.crc32(ids)))
        at += len(ids)
    assert got == sorted(want)


def test_packing(docs):
    rows = packing.pack(docs).collect()
    got = collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    want = collections.Counter()
    for r in docs.collect():
        ids = np.array(_ids(r.text, 0), "<u4")
        for i in range(0, len(ids), 2048):
            want[(r.doc_id, i // 2048, i, len(ids[i : i + 2048]), zlib.crc32(ids[i : i + 2048]))] += 1
    assert got == want
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048


def test_plan_is_best_fit_decreasing():
    for seed in range(200):
        rng = random.Random(seed)
        capacity = rng.randint(1, 30)
        histogram = {n: rng.randint(1, 20) for n in range(1, capacity + 1) if rng.random() < 0.4}
        bins = []
        for n in sorted(histogram, reverse=True):
            for _ in range(histogram[n]):
                fits = [b for b in bins if b >= n]
                if fits:
                    bins.remove(min(fits))
                bins.append((min(fits) if fits else capacity) - n)
        runs = packing.plan(histogram, capacity)
        assert len({first + i for _, _, n, first, _ in runs for i in range(n)}) == len(bins)


def _sets(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def test_minhash_against_all_pairs(docs):
    rows = docs.collect()
    root = {r.doc_id: r.doc_id for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    known = [(r.doc_id, _sets(r.text)) for r in rows if r.doc_id is not None]
    for i, (a, x) in enumerate(known):
        for b, y in known[:i]:
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect())
    want = collections.Counter((r.doc_id, len(_sets(r.text)), *((None, True) if r.doc_id is None else (find(r.doc_id), find(r.doc_id) == r.doc_id))) for r in rows)
    assert got == want
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    assert sorted(ids) == sorted(i for i in root if i is not None and find(i) == i)


def test_near_copies_without_their_source(spark):
    """A chain of copies, each near its neighbours only, is one component."""
    words = [f"w{i}" for i in range(400)]
    texts = []
    for k in range(40):
        copy = list(words)
        for j in range(k):
            copy[j * 9] = f"x{j}"
        texts.append(" ".join(copy))
    got = minhash.near_duplicates(frame(spark, texts)).collect()
    assert {r.component_id for r in got} == {0}


def test_components(spark):
    links = [(RNG.randint(0, 300), RNG.randint(0, 300)) for _ in range(220)] + [(400, i) for i in range(401, 460)] + [(5, 5), (None, 3)]
    root = {n: n for p in links for n in p if n is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: find(n) for p in links if None not in p and p[0] != p[1] for n in p}


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _base(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits)))
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                    "card": 12 <= len(digits) <= 19 and total % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [x for *_, x in sorted(out)]


def test_personal_data_against_re(spark, docs):
    parts = ["a", "b.c", "@", ".", "x-y", "%d", " ", "1", "23", "255", "256", "4111 1111-1111 1111", "+", "+1 (", ") ", "-", "\U0001f600", "é", "deadbeef" * 4, "token = ", "\n"]
    fuzz = ["".join(RNG.choice(parts) for _ in range(RNG.randint(0, 25))) for _ in range(400)]
    made = frame(spark, [*fuzz, "9" * 40_000, "a@b" + ".c" * 20_000, "+1" + "(" * 30_000, "1 " * 20_000])
    for table in (made, docs):
        texts = collections.defaultdict(set)
        for r in table.collect():
            texts[r.doc_id].add(r.text or "")
        rows = pii.report(table).collect()
        assert len(rows) == table.count()
        for r in rows:
            bases = [_base(t) for t in texts[r.doc_id]]
            assert r.base_sha256 in [hashlib.sha256(",".join(b).encode()).hexdigest() for b in bases]
            assert any(set(b) <= set(r.spans.split(",")) or not b for b in bases)


def test_masking_keeps_rows_and_clean_texts(docs):
    out = pii.mask(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    # what stands beside a masked span may make a new match of digits; addresses can't
    assert not any(re.search(BASE["email"], r.text or "") for r in out.collect())
    clean = collections.Counter(r.text for r in docs.collect() if not re.search("[0-9@]", r.text or ""))
    assert clean
    assert not clean - collections.Counter(r.text for r in out.collect())


def test_reliabilities_follow_the_labelers_that_agree():
    post = pii.reliabilities([((1, 1, 1), 100.0), ((-1, -1, 0), 100.0), ((1, -1, 0), 5.0)])
    assert post[(1, 1, 1)] > 0.9 and post[(-1, -1, 0)] < 0.1


def test_mixing_meets_targets(docs):
    rows = mixing.taken_words(docs).collect()
    assert len(rows) == docs.count()
    size, taken, target = collections.Counter(), collections.Counter(), {}
    for r in rows:
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size
    names = sorted((s for s in size if s is not None)) + [None]
    weight = dict(zip(names, [3, 1, 2] * 2))
    left, open_, want = 1.5 * sum(size.values()), set(names), {}
    while over := [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 2 * size[s]]:
        want.update({s: 2 * size[s] for s in over})
        left, open_ = left - sum(2 * size[s] for s in over), open_ - set(over)
    want.update({s: left * weight[s] / sum(weight[x] for x in open_) for s in open_})
    for s in names:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - want[s]) <= 2 + 0.001 * want[s]
    again = mixing.taken_words(docs.repartition(5)).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_mix_gives_the_words_that_are_taken(docs):
    taken = sum(r.taken for r in mixing.taken_words(docs).collect())
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    assert sum(len((r.text or "").encode().split()) for r in out.collect()) == pytest.approx(taken, rel=0.01)


def test_quality_scores(docs, labels):
    rows = quality.score_documents(docs, labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out is None if r.doc_id is None else r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in rows)
    assert quality.keep_good(docs, labels.limit(0)).count() == docs.count()


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    table = lambda n: spark.read.parquet(f"{sf}/{n}.parquet")
    scored = quality.score_documents(table("documents"), table("labels")).join(table("labels"), "doc_id").where("held_out")
    n, right = scored.agg(F.count(F.lit(1)), F.sum((F.col("predicted") == F.col("quality")).cast("int"))).first()
    assert right >= 0.95 * n


def test_imatch(docs):
    rows = imatch.fingerprints(docs).collect()
    table = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    assert len(rows) == len(table)
    prints = collections.defaultdict(set)
    texts = collections.defaultdict(list)
    for d, t in table:
        texts[d].append(t)
    for r in rows:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if len(texts[r.doc_id]) == 1:
            prints[texts[r.doc_id][0]].add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    known = {r.doc_id: r for r in rows}
    for (d, t), (_, after) in zip(table, table[1:] + table[:1], strict=True):
        if d is not None and len(texts[d]) == 1:
            half = len(t) // 2
            assert known[d].edited_sha256 == hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()


def test_html(spark):
    article = "<p>The river is the oldest of all the roads that led to the market and to the sea.</p>"
    pages = [
        f"<nav><a href=x>Home</a></nav><div class='cookie-notice'>We use the cookies of this site to be of use to all of you and it.</div><article><h1>A &amp; B</h1>{article}<p>Short.</p>"
        f"<div class=ad>{article}</div><section id='comments'>{article}</section></article><aside>{article}</aside><footer>the end of it</footer>",
        f"<body><div><h2>Head</h2>{article}<script>var t='</p><p>'</script><p>a&nbsp;b\n c</p></div><!-- {article}",
        None, "", "<p>unclosed <b", "a < b &lt; c", "<script>never closed",
    ]
    rows = [(i, f"u{i}", p, "t", 1) for i, p in enumerate(pages)] + [(0, "u0", pages[0], "t", 1)]
    got = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string, row int")).collect()
    by = {r.page_id: r.text for r in got}
    plain = html.unescape(re.sub("<[^>]*>", "", article))
    assert len(got) == len(rows)
    assert by[0] == f"A & B\n\n{plain}\n\nShort."
    assert by[1] == f"Head\n\n{plain}\n\na b c"
    assert by[2] == by[3] == by[6] == ""
    assert all(r.n_chars == len(r.text) for r in got)


def test_licenses(spark):
    rows = [
        ("a/LICENSE", "Released under the MIT License.\n", 1), ("a/b/c/x.py", "print", 1), ("a/b/LICENSE", "nothing here", 1),
        ("a/b/y.py", "# Licensed under the Apache License, Version 2.0.\ncode", 1), ("z.py", None, 1), (None, "Released under the MIT License", 1),
        ("a/x.py", "", 1), ("a/x.py", "", 1), ("b/copyright.txt", "a copyright note on other things of no licence", 1),
    ]
    got = collections.Counter((r.path, r.license, r.basis, r.license_dir) for r in licenses.scan(spark.createDataFrame(rows, "path string, text string, cosine int")).collect())
    assert got == collections.Counter([
        ("a/LICENSE", "MIT", "own", None), ("a/b/c/x.py", "MIT", "inherited", "a"), ("a/b/LICENSE", "MIT", "inherited", "a"),
        ("a/b/y.py", "Apache-2.0", "own", None), ("z.py", None, "none", None), (None, None, "none", None),
        ("a/x.py", "MIT", "inherited", "a"), ("a/x.py", "MIT", "inherited", "a"), ("b/copyright.txt", None, "none", None),
    ])


def test_embeddings_over_many_shards(spark):
    rng = np.random.RandomState(3)
    centres = rng.normal(size=(25, 16))
    x = np.concatenate([c + 0.03 * rng.normal(size=(12, 16)) for c in centres] + [rng.normal(size=(80, 16))])
    rows = [(i, v.tolist(), int(i % 2), "u") for i, v in enumerate(x)]
    rows += [(1000, x[0].tolist(), 0, "u"), (1001, (2 * x[0]).tolist(), 0, "u"), (1002, None, 0, "u"), (1003, [], 0, "u"), (1004, [0.0] * 16, 0, "u"),
             (1005, [float("nan")] + [1.0] * 15, 0, "u"), (1006, [None] + [1.0] * 15, 0, "u"), (1007, x[0].tolist(), None, "u"), (1008, [1.0, 2.0], 0, "u")]
    got = {r.vec_id: r for r in hnsw.near_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, unit string"), shard_rows=60, block_rows=40).collect()}
    good = [r for r in rows if r[0] < 1002 or r[0] == 1008]
    root = {r[0]: r[0] for r in rows}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    links = collections.Counter()
    for i, (a, u, la, _) in enumerate(good):
        for b, v, lb, _ in good[:i]:
            if la == lb and len(u) == len(v) and np.dot(u, v) / np.linalg.norm(u) / np.linalg.norm(v) >= 0.98:
                links[a] += 1
                links[b] += 1
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    assert len(got) == len(rows)
    assert sum(got[v].n_links for v in got) >= 0.99 * sum(links.values())
    assert all(got[v].n_links <= links[v] for v in got)
    assert {v: r.component_id for v, r in got.items()} == {v: find(v) for v in got}


def test_empty_tables(spark, nothing, labels):
    folder = new_path(spark, "none")
    rans.write_files(nothing, folder, tokens.default_vocabulary())
    assert rans.digests(spark, folder).count() == 0
    for out in (packing.pack(nothing), minhash.near_duplicates(nothing), minhash.keep_one(nothing), pii.report(nothing), pii.mask(nothing),
                mixing.taken_words(nothing), mixing.mix(nothing), quality.score_documents(nothing, labels), imatch.fingerprints(nothing)):
        assert out.count() == 0
    assert html_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert hnsw.near_embeddings(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert licenses.scan(spark.createDataFrame([], "path string, text string")).count() == 0

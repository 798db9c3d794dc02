"""The prefix trie against plain Python, with segments and partitions of a few rows."""

import hashlib
import random
import re
from collections import defaultdict
from zlib import crc32

import pytest

from barlab.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth long, n long, key string, group string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            r, x = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, hashlib.md5(f"{len(r)}:{r}{x}".encode()).hexdigest(), r, x))
    own = {c: [(r, x) for *_, r, x in sorted(t)] for c, t in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for conv in own:
        h = crc32(str(conv).encode()) % 4
        base = conv - (conv % 20 if conv >= 0 else -(-conv % 20))
        turns = tuple(own.get(base, [])[:h] + own[conv][h:])
        for d in range(len(turns) + 1):
            members[turns[:d]].append(conv)
        ends[turns].append(conv)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out, below = [], {}
    for node in sorted(members, key=len, reverse=True):
        n = len(members[node])
        saved = (n - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves = sum(below[c][0] for c in children[node]) or 1
        below[node] = leaves, saved + sum(below[c][1] for c in children[node])
        sha = hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else -99, n, len(children[node]), *below[node], sha))
    return sorted(out)


def found(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2, "k", "g") for r in rows], SCHEMA)
    got = trie.prefix_trie(df.repartition(3)).select(*COLUMNS).collect()
    return sorted(tuple(-99 if v is None else v for v in r) for r in got)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = []
    turn = lambda: (rng.choice(["user", "assistant", None]), rng.choice(["a", "b c", "d e f", "", None, "\x85 x\n y"]))
    for conv in range(120):
        shared = random.Random(conv % 3)
        for t in range(rng.randint(1, 9)):
            out.append((conv, t, *(("user", shared.choice(["hello there", "good day to you"])) if t < 4 else turn())))
    for conv in range(200, 300):  # a large group of copies
        out += [(conv, t, "user", f"copy {t}") for t in range(5)]
    long = [("user", f"turn {t} of many") for t in range(40)]
    for conv, cut in ((400, 40), (401, 40), (402, 39), (403, 20), (420, 40), (421, 38)):  # long shared prefixes, some end in them
        out += [(conv, t, *x) for t, x in enumerate(long[:cut])]
    out += [(404, t, *x) for t, x in enumerate(long[:30] + [("user", "other")] * 9)]
    out += [(500, None, "user", "no number"), (500, 0, None, None), (500, 0, "user", "same number"), (500, 0, "user", "same number")]
    out += [(None, 1, "user", "no conversation"), (-25, 0, "user", "below zero"), (619, 0, "user", "alone"), (637, 1, "user", "w " * 5000)]
    return out


@pytest.mark.parametrize("segment, sequences", [(1024, 7), (4, 20_000), (4, 3)])
def test_equals_plain_python(spark, rows, monkeypatch, segment, sequences):
    monkeypatch.setattr(trie, "SEGMENT", segment)
    monkeypatch.setattr(trie, "SEQUENCES", sequences)
    assert found(spark, rows) == plain(rows)


def test_long_conversations_are_numbered_alike(spark, rows, monkeypatch):
    monkeypatch.setattr(trie, "LONG", 3)
    assert found(spark, rows) == plain(rows)


def test_little_tables(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 0, "a", "b")]) == []
    one = [(7, 0, "user", "alone")]
    assert found(spark, one) == plain(one)

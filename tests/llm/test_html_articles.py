"""Pages whose article hangs on names, languages and short blocks."""

from __future__ import annotations

import random

import pytest

from barlab.llm import html_text

NAMES, STOPS = frozenset(html_text.ASIDE_NAMES), frozenset(html_text.STOP_WORDS)
ENGLISH = "The river is the oldest of all the roads that led to the market and to the sea, and it was there for all of us."
POLISH = "Rzeka jest najstarsza ze wszystkich dróg prowadzących na targ oraz nad morze, płynie spokojnie przez całą dolinę."
FINNISH = "Joki oli vanhin kaikista teistä, jotka johtivat torille ja merelle, ja sen rannoilla asuivat kalastajat perheineen."
LINKS = "<ul>" + "".join(f"<li><a href=x>Strona numer {i}</a></li>" for i in range(5)) + "</ul>"
LINE = "<p><a href=x>Other pages of this site that one may open from here, one by one</a></p>"


def text(page: str) -> str:
    return html_text.page_text(page, NAMES, STOPS)


@pytest.mark.parametrize(
    ("page", "expected"),
    [
        (f'<div class="layout has-sidebar"><article><p>{ENGLISH}</p></article></div>', ENGLISH),
        (f'<div data-role="search"><article><p>{ENGLISH}</p></article></div>', ENGLISH),
        (f'<div class="search"><main><p>{ENGLISH}</p></main></div>', ENGLISH),
        (f'<div class="modal"><article><p>{ENGLISH}</p></article></div>', ENGLISH),
        (f'<article><div class="article-header"><h1>A road</h1></div><p>{ENGLISH}</p></article>', f"A road\n\n{ENGLISH}"),
        (f'<div class="post-header"><h1>A road</h1></div><p>{ENGLISH}</p>', f"A road\n\n{ENGLISH}"),
        (f"<article>{LINKS}<p>{POLISH}</p><p>{FINNISH}</p></article>", f"{POLISH}\n\n{FINNISH}"),
        (f"<div>{LINKS}</div><div><p>{POLISH}</p><p>Krótko.</p></div>", f"{POLISH}\n\nKrótko."),
        (f"<div>{LINKS}</div><div><p>{FINNISH}</p></div>", FINNISH),
        ("<p>Two roads in a wood,</p><p>and one is mine.</p>", "Two roads in a wood,\n\nand one is mine."),
        (f"<article><p>{ENGLISH}</p><figure><img src=x><figcaption>The old river.</figcaption></figure></article>", f"{ENGLISH}\n\nThe old river."),
        (f"<article><p>{ENGLISH}</p><p>So <math><mi>a</mi><mo>=</mo><mi>b</mi></math> here.</p></article>", f"{ENGLISH}\n\nSo a=b here."),
        (f'<article><p>{ENGLISH}</p></article><section class="comments"><article><p>{ENGLISH}</p></article></section>', ENGLISH),
        (f'<article><p>{ENGLISH}</p></article><article class="comment"><p>{ENGLISH}</p></article>', ENGLISH),
        (f'<section id="comments"><article><p>{ENGLISH}</p></article></section>', ""),
        (f'<div class="sidebar"><p>{ENGLISH}</p></div><div class="site-header">{ENGLISH}</div>', ""),
        (f"<article><p>{ENGLISH}</p>{LINE}<p>Next</p>{LINE}</article>", ENGLISH),
    ],
)
def test_articles_are_kept(page, expected):
    assert text(page) == expected


def by_distance(found, labels):
    """The inheritance once more, every block against every other of its region."""
    cored, out = any(b[3] and not b[2] for b in found), []
    for i, b in enumerate(found):
        if labels[i] is not None:
            out.append(labels[i])
            continue
        region = [j for j, c in enumerate(found) if c[3] == b[3]]
        seeded = any(labels[j] == 1 for j in region)
        seeds = [j for j in region if labels[j] is not None and not found[j][2] and (labels[j] or seeded or not b[3])]
        # only the nearest decided one on each side counts
        near = [max((j for j in seeds if j < i), default=None), min((j for j in seeds if j > i), default=None)]
        near = [(abs(i - j), not labels[j]) for j in near if j is not None]
        out.append(int(not min(near)[1]) if near else int(b[3] or not cored))
    return out


def test_labels_against_brute_force():
    rng = random.Random(5)
    kinds = [(ENGLISH, 0, 0), ("Short.", 0, 0), (POLISH, 0, 0), ("Links here", 10, 0), (ENGLISH, 0, 1), ("Menu", 0, 2)]
    for _ in range(400):
        found = [(*rng.choice(kinds), rng.random() < 0.6) for _ in range(rng.randint(0, 14))]
        labels = html_text.first_labels(found, STOPS)
        assert html_text.second_labels(found, labels) == by_distance(found, labels)

import random
import time
from collections import Counter

import pytest

from loamdex.llm import html
from loamdex.llm.labelled_pages import PAGES

from .held_out_pages import PAGES as HELD_OUT

WEIGHTS = html.fit(PAGES)
EXTRACTOR = html.Extractor(WEIGHTS)


def test_labelled_pages():
    assert [p for p, main in PAGES if EXTRACTOR.extract(p) != main] == []


def test_held_out_pages():
    """Pages of other layouts, texts and names than those of the fit: most come out exactly, and next to no word is wrong."""
    f1, exact = [], 0
    for page, main in HELD_OUT:
        got = EXTRACTOR.extract(page)
        exact += got == main
        a, b = Counter(got.split()), Counter(main.split())
        f1.append(2 * sum((a & b).values()) / (sum(a.values()) + sum(b.values())))
    assert exact >= 11 and sum(f1) / len(f1) > 0.99 and min(f1) > 0.95


WORDS = "Every word of this long paragraph belongs to the story and must be kept as it is."


@pytest.mark.parametrize(
    "page, main",
    [
        (None, ""),
        ("", ""),
        ("<nav>a b c</nav>", ""),
        ("plain words without any tag", "plain words without any tag"),
        (f"<article><p>{WORDS}<p>a &amp; b &lt;i&gt; &eacute;<br>c</article>", f"{WORDS} a & b <i> é c"),
        (f"<article><p>{WORDS}</p><script>if (a < b) document.write('</p><p>no</p>')</script><!-- <p>no --><p>x<b>y</b>z</p></article>", f"{WORDS} xyz"),
        (f"<main><p>{WORDS}</p><div class='post-comments'><p>{WORDS}</p></div></main><div class=footer><p>{WORDS}</p></div>", WORDS),
        (f"<div class='page no-sidebar'><p>{WORDS}</p></div>", WORDS),
        (f"<article><h1>T</h1><aside>{WORDS}</aside><form>{WORDS}</form><p>{WORDS}\n\n \t end</p></article>", f"T {WORDS} end"),
        (f'<article><p title="a > b">{WORDS}</p><div style="display: none">hidden</div></article><footer>f</footer>', WORDS),
        (f"<article><p>{WORDS} 1 < 2 and a<b</p><p>c</p></article>", f"{WORDS} 1 < 2 and a c"),
        (f"<p class=x'>{WORDS}</p><p id=\"open>{WORDS}</p>", f"{WORDS} {WORDS}"),
        (f"<article><p>{WORDS}</p><p>cut off <a hre", f"{WORDS} cut off"),
        ("<p>" + "long " * 50_000, ("long " * 50_000).strip()),
    ],
)
def test_pages(page, main):
    assert EXTRACTOR.extract(page) == main


def test_region_is_the_best_run_of_all():
    rng = random.Random(3)
    for _ in range(300):
        scores = [rng.choice((-1.5, 1.0)) for _ in range(rng.randint(0, 12))]
        best = max([0.0, *(sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1))])
        first, end = html.region(scores)
        assert sum(scores[first:end]) == best


@pytest.mark.parametrize("unit", ["<a x='", "<a '>'", "<a x='>", "<div>", "<b>x</i>", "<", "<!--", '<a b="c" ', "<script>", "</p>", "<p>a &amp; b "])
def test_time_is_linear_in_malformed_pages(unit):
    took = []
    for size in (250_000, 1_000_000):
        start = time.perf_counter()
        EXTRACTOR.extract(unit * (size // len(unit)))
        took.append(time.perf_counter() - start)
    assert took[1] < 10 * max(took[0], 0.05)


def test_query(spark):
    rows = [(1, "u", PAGES[0][0], "clash"), (1, "u", PAGES[0][0], "clash"), (None, None, None, None)]
    got = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    want = PAGES[0][1]
    assert sorted(map(tuple, got), key=str) == sorted([(1, "u", want, len(want))] * 2 + [(None, None, "", 0)], key=str)
    assert html.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0

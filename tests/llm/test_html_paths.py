"""Tag paths decide what belongs to an article."""

import math

import pytest

from sievework.llm import html

PROSE = "A sentence with some words, and a second part of it. Another one follows; it ends here. "
PAGE = (
    "<body><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>"
    "<div class=box>Buy now</div>"
    f"<article><h1>Title</h1><p>{PROSE * 3}</p><p><a href=/x>A line that is a link.</a></p><ul><li>one<li>two</ul>"
    f"<table><tr><td>1<td>2</table><p>{PROSE}</p>"
    "<ul class=more><li><a href=/1>First other page</a><li><a href=/2>Second other page</a></ul>"
    f"<div class=comments><p>{PROSE * 2}</p></div></article>"
    "<footer>&copy; 2020</footer></body>"
)
EXPECTED = ["Title", (PROSE * 3).strip(), "A line that is a link.", "one", "two", "1", "2", PROSE.strip()]


def naive_scores(blocks):
    """The same figures, block by block, without shared sums."""
    def ratio(b, what):
        same = [o for o in blocks if o.path == b.path]
        return sum(what(o) for o in same) / len(same)

    def around(i, values):
        near = [j for j in range(len(values)) if abs(i - j) <= 2]
        weights = [math.exp(-((i - j) ** 2) / 2) for j in near]
        return math.sqrt(values[i] * sum(w * values[j] for w, j in zip(weights, near)) / sum(weights))

    lengths = [ratio(b, lambda o: len(o.text) - 0.8 * o.linked) for b in blocks]
    points = [1 + ratio(b, lambda o: o.marks) for b in blocks]
    out = {}
    for path in {b.path for b in blocks}:
        own = [i for i, b in enumerate(blocks) if b.path == path]
        score = sum(around(i, lengths) * around(i, points) for i in own) / len(own)
        share = sum(blocks[i].linked for i in own) / sum(len(blocks[i].text) for i in own)
        out[path] = score * (0.005 if share > 0.99 else 1) * (1e-6 if path[0] == "!" else 1)
    return out


def test_scores_match_brute_force():
    blocks = html.blocks_of(PAGE)
    found, wanted = html.path_scores(blocks), naive_scores(blocks)
    assert found.keys() == wanted.keys()
    assert all(found[p] == pytest.approx(wanted[p]) for p in wanted)


@pytest.mark.parametrize("swap", [("article", "article"), ("article", "div"), ("article", "main")])
def test_paths_decide(swap):
    assert html.main_text(PAGE.replace(*swap)).split("\n") == EXPECTED


def test_flat_scores_change_the_page(monkeypatch):
    monkeypatch.setattr(html, "path_scores", lambda blocks: {b.path: 1.0 for b in blocks})
    lines = html.main_text(PAGE).split("\n")
    assert {"Home", "Buy now", "First other page"} <= set(lines)


@pytest.mark.parametrize("cell", ["x", "7"])
def test_no_unlinked_block_of_an_article_is_lost(cell):
    rows = f"<tr><td>{cell}" * 5000
    page = f"<article><p>{PROSE * 400}</p><table>{rows}</table></article>"
    assert html.main_text(page).split("\n") == [(PROSE * 400).strip(), *[cell] * 5000]


def test_clutter_alone_gives_nothing():
    assert html.main_text(f"<div class=comments><p>{PROSE * 20}</p></div><nav><p>{PROSE}</p></nav>") == ""


def test_tables_of_pages(spark):
    rows = [(1, None, "old"), (2, "", "old"), (3, PAGE, "old"), (3, PAGE, "old"), (4, "<p>" + "word. " * 100_000, None)]
    pages = spark.createDataFrame(rows, "page_id int, html string, _main_text string")
    found = [r["_main_text"] for r in html.extract_pages(pages).orderBy("page_id").collect()]
    assert found == ["", "", "\n".join(EXPECTED), "\n".join(EXPECTED), ("word. " * 100_000).strip()]
    assert html.extract_pages(pages.limit(0)).count() == 0

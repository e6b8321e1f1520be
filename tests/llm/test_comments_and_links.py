"""Reader comments inside an article go; linked paragraphs and lists of links in it stay. The fit's gradient is that of the likelihood."""

import itertools
import math

import numpy as np
import pytest

from turnloom.llm import html_pages, html_text

HEAD = "<article><h1>Head line</h1><p>First text stands here.</p>{}</article>"


@pytest.mark.parametrize(
    ("inside", "text"),
    [
        ("<div id='comments'><p>Reader one writes a lot of good text here.</p></div>", ""),
        ("<p>Last one.</p><section class=comments><h3>Said</h3><div class=comment><p>I like this text, it is a very good one.</p></div></section>", "Last one."),
        ("<ol class='comment-list'><li>One says this.</li><li>Two says that, at some length, as readers do.</li></ol>", ""),
        ("<p>See <a href=x>this page about it</a>.</p>", "See this page about it."),
        ("<p><a href=x>All of this paragraph is a link.</a></p><p>The end.</p>", "All of this paragraph is a link.\nThe end."),
        ("<ul><li><a href=a>One link</a></li><li><a href=b>Two links</a></li></ul>", "One link\nTwo links"),
        ("<p>Before.</p><ul><li><a href=a>One link</a></li></ul><p>After.</p><div class=replies><p>Not this reader's text.</p></div>", "Before.\nOne link\nAfter."),
    ],
)
def test_inside_an_article(inside, text):
    page = "<html><head><title>t</title></head><body><nav><ul><li><a href=/>Home</a></li><li><a href=/n>News of it</a></li></ul></nav>" + HEAD.format(inside) + "<aside class=related><ul><li><a href=/o>Other page</a></li></ul></aside><footer>&copy; site</footer></body></html>"
    assert html_text.model().main_text(page) == "Head line\nFirst text stands here." + ("\n" + text if text else "")


def test_the_gradient_is_that_of_the_likelihood():
    """Against differences of the log likelihood, summed over all labellings of small pages."""
    pages = ["<nav><a href=/>Home</a></nav><main data-main><p>One text.</p></main>", "<article><h1 data-main>A</h1><div class=comment>B</div></article>"]
    forest = html_text.Forest(pages)
    rng = np.random.default_rng(0)
    weights, both = rng.normal(size=len(forest.names)), rng.normal(size=len(html_text.KINDS))

    def likelihood(w, b):
        odds = np.bincount(forest.row, weights=forest.value * w[forest.column], minlength=len(forest.parent))
        edges = [(k, p) for k, p in enumerate(forest.parent) if p >= 0]
        score = lambda y: sum(o for o, v in zip(odds, y) if v) + sum(b[forest.kind[k]] for k, p in edges if y[k] and y[p])
        return score(forest.label) - math.log(sum(math.exp(score(y)) for y in itertools.product((0, 1), repeat=len(odds))))

    of, of_both = forest.gradient(weights, both)
    step = 1e-5
    for k in range(len(weights)):
        change = step * np.eye(len(weights))[k]
        assert of[k] == pytest.approx((likelihood(weights + change, both) - likelihood(weights - change, both)) / (2 * step), abs=1e-6)
    for k in range(len(both)):
        change = step * np.eye(len(both))[k]
        assert of_both[k] == pytest.approx((likelihood(weights, both + change) - likelihood(weights, both - change)) / (2 * step), abs=1e-6)


def test_layouts_hold_comments_and_links_inside_the_text():
    pages = html_pages.labelled_pages(200)
    assert any("data-main" in p and 'id="comments"' in p.split("<article")[-1] for p in pages)
    assert any('<p data-main><a href="/x">' in p or "<a href" in p.split("data-main", 1)[-1] for p in pages)

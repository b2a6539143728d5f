"""Pages whose head isn't closed, deep paths, and long pages."""

import numpy as np

from tickforge.llm import extract
from tickforge.llm.blocks import blocks


def test_head_ends_where_html_ends_it():
    body = "<h1>Title of it</h1><p>First words</p><p>Second words</p>"
    want = ["Title of it", "First words", "Second words"]
    head = "<head><meta charset=utf-8><title>t</title><link rel=x><style>p{}</style><script>var a='<p>no</p>';</script>"
    for page in (head + body, head + "</head><body>" + body, head + "<body>" + body + "</body>", head.replace("head", "HEAD") + body):
        assert [b.text for b in blocks("<html>" + page)] == want


def test_path_reaches_the_outermost_element():
    deep = lambda outer: blocks(f"<div class={outer}>" + "<div>" * 40 + "x")[0].path
    assert not np.array_equal(deep("comments"), deep("story"))
    a, b = blocks("<div class=a><p>x</p></div><p>y")
    assert np.array_equal(b.path, blocks("<p>y")[0].path) and not np.array_equal(a.path, b.path)


def test_long_page_is_one_sequence():
    labeller = extract.Labeller(pages=60)
    page = blocks("<div class=comments><h3>Comments</h3>" + "<p>some words here</p>" * 700 + "</div><article>" + "<p>more words there</p>" * 900 + "</article>")
    x, mask, _ = labeller._pad([extract.vectors(page)])
    net = labeller.net
    whole = 1 / (1 + np.exp(-(net.states(x, mask)[0] @ net.p["o"] + net.p["z"])))[:, 0]
    assert np.abs(labeller.label([page])[0] - whole).max() < 1e-5

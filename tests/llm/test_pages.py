"""Main text of pages that no generator made, of layouts that training never saw, and blocks against an independent parser."""

import random
import time
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest

from tickforge.llm import extract
from tickforge.llm.blocks import INLINE, blocks

TITLE = "Dredging of the northern channel delayed"
PARAS = [
    "The harbour authority said on Tuesday that dredging of the northern channel would begin in early spring, three months later than planned.",
    "Engineers had warned since last autumn that silt was building up faster than expected, and that larger vessels could soon be turned away at low tide.",
    "Local fishermen, who have long complained about the noise, were told that work will stop at night during the spawning season.",
    "The cost, put at eleven million, will be shared between the port, the region and a fund set up after the storms of four years ago.",
    "Nobody on the council voted against the plan, but two members asked for a second survey of the old seawall before any machine is brought in.",
    "A public hearing is to be held at the town hall next week; written comments may be sent until the end of the month.",
]
NAV = "<ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li><li><a href='/s'>Sport</a></li><li><a href='/w'>Weather</a></li></ul>"
FOOT = "<p>Copyright 2023 The Harbour Post. All rights reserved.</p><a href='/p'>Privacy</a> <a href='/t'>Terms</a>"
P = "".join(f"<p>{x}</p>" for x in PARAS)
STORY = [TITLE, *PARAS]
PAGES = {
    "meaningless classes": (f"<div class='c-1'><div class='c-3'>{NAV}</div></div><div class='c-12'><div class='c-7'><h1>{TITLE}</h1>{P}</div></div><div class='c-4'>{FOOT}</div>", STORY),
    "divs for paragraphs": (f"<div class='top'>{NAV}</div><div class='story-body'><h1>{TITLE}</h1>" + "".join(f"<div>{x}</div>" for x in PARAS) + f"</div><div class='legal'>{FOOT}</div>", STORY),
    "article": (f"<nav>{NAV}</nav><article><h1>{TITLE}</h1>{P}<ul><li>{PARAS[0]}</li></ul></article><aside><h3>Most read</h3>{NAV}</aside><footer>{FOOT}</footer>", [*STORY, PARAS[0]]),
    "bare body": (f"<h1>{TITLE}</h1>{P}", STORY),
    "table layout": (f"<table width=100%><tr><td width=120>{NAV}</td><td><font size=5><b>{TITLE}</b></font><p>" + "<p>".join(PARAS) + f"</td></tr><tr><td colspan=2>{FOOT}</td></tr></table>", STORY),
    "comments": (f"<div id=hd><a href=/>The Harbour Post</a></div><div id=content><h1>{TITLE}</h1>{P}</div><div id=comments><h3>3 comments</h3><div class=comment><b>Ann</b><p>I hope they really do stop at night this time.</p></div><div class=comment><b>Bo</b><p>Eleven million for mud? Unbelievable.</p></div></div>{FOOT}", STORY),
    "generated classes": (f"<div id='root'><div class='sc-a1b2 kXy'><header class='sc-q'><a>Post</a><button>Menu</button></header><main class='sc-main'><section><h1 class='hZ1'>{TITLE}</h1><div class='mZ3'>{P}</div></section></main><footer class='sc-f'>{FOOT}</footer></div></div><div class='zz9'>We use cookies to make this site work. <button>Accept all</button></div>", STORY),
    "blog": (f"<div class=site><div class=menu>{NAV}</div><div class='post'><h2>{TITLE}</h2><div class='sharebar'><a>Tweet</a> <a>Share</a></div>{P}<div class='ad-slot'>Advertisement. Buy better boots at Bootland today.</div><h3>What happens next</h3><p>{PARAS[5]}</p></div><div class='related'><h3>You may also like</h3><a>Seawall survey ordered</a><br><a>Storm fund pays out</a></div><div class='ft'>{FOOT}</div></div>", [*STORY, "What happens next", PARAS[5]]),
    "line breaks": (f"<center><a href=/>home</a> | <a href=/n>news</a></center><h1>{TITLE}</h1>" + "<br><br>".join(PARAS) + "<hr><small>Copyright 2001</small>", STORY),
    "short paragraphs": (f"<div class=wrap><div class=nav>{NAV}</div><div class=main><h1>{TITLE}</h1><p>It is late again.</p><p>The boats wait.</p><p>{PARAS[2]}</p><p>No one is surprised.</p><p>{PARAS[4]}</p></div><div class=side><h4>Newsletter</h4><form><label>Email</label><input><button>Sign up</button></form></div>{FOOT}</div>", [TITLE, "It is late again.", "The boats wait.", PARAS[2], "No one is surprised.", PARAS[4]]),
}


@pytest.fixture(scope="module")
def labeller():
    return extract.default_labeller()


@pytest.mark.parametrize("name", PAGES)
def test_pages_written_by_hand(labeller, name):
    body, story = PAGES[name]
    got = Counter(labeller.texts([f"<!DOCTYPE html><html><head><title>x</title></head><body>{body}</body></html>"])[0].split())
    want = Counter(" ".join(story).split())
    assert 2 * (got & want).total() / (got.total() + want.total()) > 0.9


@pytest.mark.parametrize("family", ["opaque-plain", "bare-rich", "telling-plain"])
def test_families_that_training_never_saw(family):
    others = extract.Labeller(1500, families=tuple(f for f in extract.FAMILIES if f != family))
    made = [blocks(extract.Layout(66_000_000 + i, (family,)).page()) for i in range(100)]
    p, y = np.concatenate(others.label(made)), np.array([extract.MARK in b.text for bs in made for b in bs])
    assert ((p >= 0.5) == y).mean() > 0.9


class Reference(HTMLParser):
    """Blocks of well-formed pages: text between tags that aren't inline."""

    def __init__(self, page):
        super().__init__()
        self.out, self.parts, self.skip = [], [], 0
        self.feed(page)
        self.end()

    def end(self):
        text = " ".join("".join(self.parts).split(" "))
        text = " ".join(x for x in text.replace("\n", " ").replace("\t", " ").split(" ") if x)
        self.out += [text] if text else []
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.parts.append(" ")
        elif tag in ("script", "style", "title"):
            self.skip += 1
        elif tag not in INLINE:
            self.end()

    def handle_endtag(self, tag):
        if tag in ("script", "style", "title"):
            self.skip -= 1
        elif tag not in INLINE:
            self.end()

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)


def test_blocks_are_those_of_an_independent_parser():
    for i in range(300):
        page = extract.Layout(77_000_000 + i).page()
        assert [b.text for b in blocks(page)] == Reference(page).out
    for body, _ in PAGES.values():
        assert [b.text for b in blocks(body)] == Reference(body).out


@pytest.mark.parametrize("unit", ["<script ", '<a "', "<", '<a ">" ', "<!", "<!--", "</", "<div>", "<p>x", "<ul><li>x", "</div>"])
def test_a_megabyte_of_anything_takes_seconds(unit):
    begin = time.time()
    blocks(unit * ((1 << 20) // len(unit)))
    assert time.time() - begin < 30


def test_what_stands_before_decides(labeller):
    """Like paragraphs are the article's or the comments', by what they stand in and come after."""
    many = lambda n: "<p>Words of a paragraph that could stand in either place of a page.</p>" * n
    inside = labeller.texts([f"<body><article><h1>{TITLE}</h1>{many(5000)}</article></body>"])[0]
    outside = labeller.texts([f"<body><article><h1>{TITLE}</h1>{P}</article><div class=comments><h3>Comments</h3>{many(8)}</div></body>"])[0]
    assert inside.count("either place") > 4900 and outside.count("either place") < 10 and PARAS[3] in outside


def test_random_markup_never_fails():
    r = random.Random(5)
    for _ in range(3000):
        page = "".join(r.choice(("<p>", "</p>", "<", ">", "<a href='x", '"', "'", "<script>", "</script>", "<!--", "-->", "<li>", "&amp;", "é", " x ", "<br/>", "<title>", "<div class=a", "/")) for _ in range(r.randint(0, 30)))
        assert all(b.text.strip() for b in blocks(page))

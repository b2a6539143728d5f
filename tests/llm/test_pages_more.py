"""More pages written by hand: documentation, shop, recipe, blog, discussion, and boilerplate in every place of short and very long articles."""

from collections import Counter

import pytest

from tickforge.llm import extract
from tickforge.llm.blocks import blocks


def p(texts):
    return "".join(f"<p>{x}</p>" for x in texts)


HOME = "<ul><li><a href='/'>Home</a></li><li><a href='/docs'>Docs</a></li><li><a href='/blog'>Blog</a></li></ul>"
PS = ["The committee met for three hours on Monday and agreed on most of the points that had been open since the summer.","Its chair said that the remaining questions are about money, and that nobody expects them to be settled before the new year.","Two members left early, which the others took as a sign of protest against the order of the agenda.","Minutes will be published next week, after all who took part have had a chance to correct them."]
TALK = ["I was there and it took far longer than three hours.","Nobody ever asks the people who live next to it.","Good summary, thanks for writing it up.","They said the same thing last year and nothing happened.","Does anyone know when the minutes come out?","Four pounds for coffee there, never again.","My neighbour says that the chair will resign soon.","This is why I no longer go to these meetings.","Please keep the discussion civil.","Agreed, money is always the problem.","Money isn't the problem, people are.","See you all next Monday then."]

HAND = {
"notice in a short article": ("<div class='x1'><div class='x2'><h1>A short title</h1><p>"+PS[0]+"</p><div class='cookie'>We use cookies. <button>OK</button></div><p>"+PS[1]+"</p></div></div>",["A short title",PS[0],PS[1]]),
"notice in a longer article": ("<div class='x1'><div class='x2'><h1>A short title</h1><p>"+PS[0]+"</p><div class='cookie'>We use cookies. <button>OK</button></div>"+p(PS[1:])+"</div></div>",["A short title",*PS]),
"documentation": ("<nav class='toc'><ul><li><a href='#a'>Install</a></li><li><a href='#b'>Use</a></li></ul></nav><main><h1>Getting started</h1><p>Run this command in a shell:</p><pre><code>pip install thing\nthing --help</code></pre><p>It needs Python 3.9 or later.</p><h2>Options</h2><ul><li>--quiet says less</li><li>--out FILE writes to a file</li></ul></main><footer>Built with Thing</footer>",["Getting started","Run this command in a shell:","pip install thing thing --help","It needs Python 3.9 or later.","Options","--quiet says less","--out FILE writes to a file"]),
"comments of plain paragraphs": (f"<nav>{HOME}</nav><article><h1>The committee meets</h1>{p(PS[:2])}</article><section class='comments'>{p(TALK)}</section><footer>&copy; 2024</footer>",["The committee meets",*PS[:2]]),
"one paragraph": (f"<div class='nav'>{HOME}</div><div class='post'><h2>Minutes</h2><p>{PS[3]}</p></div><div class='footer'>Copyright 2020 The Town. All rights reserved.</div>",["Minutes",PS[3]]),
"recipe": (f"<header><a href='/'>Kitchen</a>{HOME}</header><article class='recipe'><h1>Lentil soup</h1><p>A plain soup for cold evenings, ready in forty minutes.</p><h2>Ingredients</h2><ul><li>200 g lentils</li><li>1 onion</li><li>2 carrots</li><li>salt</li></ul><h2>Method</h2><ol><li>Chop the onion and the carrots and fry them gently in a little oil.</li><li>Add the lentils and a litre of water, and simmer for half an hour.</li><li>Salt at the end and serve with bread.</li></ol></article><div class='newsletter'><h3>Newsletter</h3><form><input><button>Subscribe</button></form></div><footer>Privacy policy</footer>",["Lentil soup","A plain soup for cold evenings, ready in forty minutes.","Ingredients","200 g lentils","1 onion","2 carrots","salt","Method","Chop the onion and the carrots and fry them gently in a little oil.","Add the lentils and a litre of water, and simmer for half an hour.","Salt at the end and serve with bread."]),
"blog with sidebar": (f"<div id='header'><h1><a href='/'>My blog</a></h1></div><div id='content'><div class='entry'><h2>On committees</h2>{p(PS)}</div></div><div id='sidebar'><h3>About</h3><p>I write about towns.</p><h3>Archive</h3><ul><li><a href='1'>May</a></li><li><a href='2'>June</a></li></ul></div><div id='footer'>Powered by Blog</div>",["On committees",*PS]),
"advert between paragraphs": (f"<main><h1>The committee meets</h1><p>{PS[0]}</p><div class='advert'><p>Buy two coats and pay for one, this week only.</p></div><p>{PS[1]}</p><p>{PS[2]}</p></main>",["The committee meets",*PS[:3]]),
"newsletter form inside": (f"<nav>{HOME}</nav><div class='content'><h1>The committee meets</h1>{p(PS[:2])}<form class='newsletter'><label>Your email</label><input><button>Sign up</button></form>{p(PS[2:])}</div><footer><p>All rights reserved.</p></footer>",["The committee meets",*PS]),
"shop page": (f"<div class='topbar'>{HOME}</div><main class='product'><h1>Walking boots</h1><p>Leather boots with a stiff sole, made for wet paths and long days.</p><h2>Care</h2><p>Brush off mud when it is dry, and wax the leather twice a year.</p><ul><li>Weight 1.2 kg</li><li>Sizes 36 to 47</li></ul></main><div class='related'><h3>You may also like</h3><a href='1'>Socks</a> <a href='2'>Wax</a></div><footer>Terms of use</footer>",["Walking boots","Leather boots with a stiff sole, made for wet paths and long days.","Care","Brush off mud when it is dry, and wax the leather twice a year.","Weight 1.2 kg","Sizes 36 to 47"]),
"essay with quotes": (f"<div class='menu'>{HOME}</div><article><h1>What was said</h1><p>{PS[0]}</p><blockquote>{PS[1]}</blockquote><p>{PS[2]}</p><h2>Later</h2><p>{PS[3]}</p></article><div class='share'><a href='x'>Tweet</a> <a href='y'>Share</a></div>",["What was said",*PS[:3],"Later",PS[3]]),
"short notice before": (f"<div class='consent'><p>We use cookies to make this site better.</p><button>Accept</button></div><header><nav>{HOME}</nav></header><main><article><h1>The committee meets</h1>{p(PS[:3])}</article></main>",["The committee meets",*PS[:3]]),
"boxed comments": (f"<article><h1>The committee meets</h1>{p(PS)}</article><div id='comments'><h3>Comments</h3>"+"".join(f"<div class='comment'><b>user{i}</b><p>{x}</p></div>" for i,x in enumerate(TALK))+"</div>",["The committee meets",*PS]),
"table of figures": (f"<nav>{HOME}</nav><main><h1>Attendance</h1><p>{PS[0]}</p><table><tr><th>Year</th><th>Members</th></tr><tr><td>2020</td><td>14</td></tr><tr><td>2021</td><td>11</td></tr></table><p>{PS[2]}</p></main><footer>Contact us</footer>",["Attendance",PS[0],"Year","Members","2020","14","2021","11",PS[2]]),
"code heavy": (f"<div class='sidebar-left'>{HOME}</div><main class='text'><h1>Reading a file</h1><p>Open it first:</p><pre>f = open('a.txt')\nprint(f.read())</pre><p>Then close it:</p><pre>f.close()</pre><p>That is all there is to it.</p></main><div class='footer'>Impressum</div>",["Reading a file","Open it first:","f = open('a.txt') print(f.read())","Then close it:","f.close()","That is all there is to it."]),
"read more links": (f"<header class='site-header'><p>The Daily</p></header><div class='story'><h1>The committee meets</h1>{p(PS[:2])}<div class='related'><h4>Read more</h4><ul><li><a href='1'>Chair to resign</a></li><li><a href='2'>Budget gap grows</a></li></ul></div>{p(PS[2:])}</div><div class='legal'>&copy; 2022 The Daily</div>",["The committee meets",*PS]),
}


@pytest.fixture(scope="module")
def labeller():
    return extract.default_labeller()


def text_of(labeller, body):
    return labeller.texts([f"<!DOCTYPE html><html><head><title>x</title></head><body>{body}</body></html>"])[0]


@pytest.mark.parametrize("name", HAND)
def test_more_pages_written_by_hand(labeller, name):
    body, story = HAND[name]
    got, want = Counter(text_of(labeller, body).split()), Counter(" ".join(story).split())
    assert 2 * (got & want).total() / (got.total() + want.total()) > 0.9


def test_no_comment_and_no_notice_is_kept(labeller):
    body, story = HAND["comments of plain paragraphs"]
    assert text_of(labeller, body) == "\n\n".join(story)
    for name in ("notice in a short article", "notice in a longer article"):
        body, story = HAND[name]
        assert text_of(labeller, body) == "\n\n".join(story)


@pytest.mark.parametrize("count", [10, 150, 998, 1500, 3000, 8000])
def test_long_articles_keep_every_block(labeller, count):
    """Whatever the number of paragraphs, the first and the last ones too."""
    body = f"<nav>{HOME}</nav><article><h1>The committee meets</h1>{p([f'Paragraph {i} of a long report.' for i in range(count)])}<p>{PS[0]}</p></article><footer>&copy; 2024 The Town</footer>"
    assert text_of(labeller, body).split("\n\n") == ["The committee meets", *(f"Paragraph {i} of a long report." for i in range(count)), PS[0]]


def test_boxes_are_the_elements_around():
    a, b, c, d = blocks("<div><p>a</p><p>b</p><ul><li>c</li></ul></div>d")
    assert a.boxes == b.boxes == (0, -1) and c.boxes[1] == 0 and c.boxes[0] not in (-1, 0) and d.boxes == (-1, -1)

"""HTML extraction: a recurrent block labeller.

A page is cut into leaf blocks; each becomes a vector of its tag path (hashed), its words (hashed)
and a few measures of its text, links and place and of how much of the page its kind of place holds; a bidirectional LSTM
reads the whole sequence and labels every block as main text or not.  The model is fitted on the driver on TRAIN_PAGES generated
pages (a documented bound, a fixed seed), whose blocks are labelled by how they were made, and is kept for the process.  The
pages come from families of layouts, with telling, meaningless or no class names and with or without the elements HTML has for
articles and what surrounds them, in invented words of random letters; so neither class names nor words nor elements alone
can be what it learns, and it behaves alike at every size.

Defined cases
* null or empty html: an empty text.  A page without main blocks: an empty text.
* Whole pages are read, whatever their length, in time in proportion to it: the recurrence goes through all blocks of a page in both directions.
* Broken markup: unclosed elements end where HTML ends them; what isn't a tag is text.
* Repeated rows and ties: each row is worked on by itself; a probability of one half is main text.
* An empty table gives an empty table.  Extra columns pass through; `main_text` replaces its namesake.
"""

from __future__ import annotations

import functools
import random
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import N_PATH, Block, blocks
from .common import arrow_batches, table
from .lstm import BiLSTM
from .textbytes import word_hashes

TRAIN_PAGES, SEED = 3200, 11
N_WORDS, N_PLAIN = 32, 20
#: Blocks from an end of the page after which all places are alike.
ENDS = 30

_FOLD = bytes(b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_MARKS = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))
_STOPS = (".", "!", "?", ":", ";", "\u2026", "\u3002", '"', "\u201d", ")")


def measures(bs: list[Block], count: np.ndarray) -> np.ndarray:
    """What a block's text, links and place say: N_PLAIN numbers a block, none of which names a sign or a word."""
    n = len(bs)
    size = np.array([len(b.text) for b in bs], np.float64)
    raw = [b.text.encode("utf-8", "replace") for b in bs]
    octets = np.array([max(len(x), 1) for x in raw], np.float64)
    share = lambda chars: 1 - np.array([len(x.translate(None, chars)) for x in raw]) / octets
    links = np.minimum(np.array([b.link_chars for b in bs]) / size, 1)
    kinds = [b.path.tobytes() for b in bs]
    of_kind: dict[bytes, list[float]] = {}
    for k, s, own in zip(kinds, size.tolist(), links.tolist(), strict=True):
        held = of_kind.setdefault(k, [0.0, 0.0, 0.0])
        held[0] += s
        held[1] += 1
        held[2] += s * own
    mass = np.array([of_kind[k][0] for k in kinds])
    # The same of the boxes that blocks lie in: an article's box has most of the text, whatever else lies in it.
    near, far = (np.unique([b.boxes[i] for b in bs], return_inverse=True)[1] for i in (0, 1))
    held, links_held = np.bincount(near, size), np.bincount(near, size * links)
    same = np.array([False, *(a == b for a, b in zip(kinds, kinds[1:], strict=False))])
    return np.stack([
        # Blocks are counted from both ends, up to the same number on every page: a page's length says nothing of where its article ends.
        np.log1p(size) / 6, np.log1p(count) / 4, links, np.log1p(np.minimum(np.arange(n), ENDS)) / 4, np.log1p(np.minimum(np.arange(n)[::-1], ENDS)) / 4, np.full(n, min(np.log1p(n) / 5, 1)),
        mass / size.sum(), np.minimum(np.log1p(np.array([of_kind[k][1] for k in kinds])) / 4, 1), np.array([of_kind[k][2] for k in kinds]) / mass,
        np.log1p(mass / np.array([of_kind[k][1] for k in kinds])) / 6, same,
        held[near] / size.sum(), np.bincount(far, size)[far] / size.sum(), held[near] / held.max(), links_held[near] / held[near], np.minimum(np.log1p(np.bincount(near)[near]) / 4, 1),
        np.array([b.text.endswith(_STOPS) for b in bs]), np.minimum(size / np.maximum(count, 1) / 10, 3), share(_MARKS), share(string.digits.encode()),
    ], axis=1)


def vectors(bs: list[Block]) -> np.ndarray:
    """A row for each block of a page: path, words, measures."""
    n = len(bs)
    out = np.zeros((n, N_PATH + N_WORDS + N_PLAIN), np.float32)
    if not n:
        return out
    words, count = [], []
    for b in bs:
        own = b.text.encode("utf-8", "replace").translate(_FOLD).split()
        words += own
        count.append(len(own))
    count = np.array(count)
    path = np.array([b.path for b in bs])
    # Of forty nested elements of a name the last few add little.
    out[:, :N_PATH] = np.sign(path) * np.log1p(np.abs(path))
    if words:
        h = word_hashes(words)
        place = np.repeat(np.arange(n), count) * N_WORDS + (h % np.uint64(N_WORDS)).astype(np.int64)
        sign = 1.0 - 2.0 * (h >> np.uint64(63)).astype(np.float64)
        bag = np.bincount(place, sign, n * N_WORDS).reshape(n, N_WORDS)
        # Of length one, so that a word said a hundred times weighs no more than one said once.
        out[:, N_PATH : N_PATH + N_WORDS] = bag / np.maximum(np.sqrt((bag**2).sum(1)), 1e-9)[:, None]
    out[:, -N_PLAIN:] = measures(bs, count)
    return out


class Labeller:
    def __init__(self, pages: int = TRAIN_PAGES, seed: int = SEED, families: tuple[str, ...] | None = None):
        rows, draw = [], random.Random(seed)
        for i in range(pages):
            found = blocks(Layout(seed * 100_003 + i, families).page())
            x = vectors(found)
            # Words are hidden from a part of the pages, so that the path alone must do.
            x[:, N_PATH : N_PATH + N_WORDS] *= draw.random() < 0.6
            rows.append((x, np.array([MARK in b.text for b in found])))
        rows.sort(key=lambda row: len(row[0]))
        batches = [self._pad([x for x, _ in rows[i : i + 48]], [y for _, y in rows[i : i + 48]]) for i in range(0, len(rows), 48)]
        random.Random(seed).shuffle(batches)
        self.net = BiLSTM(N_PATH + N_WORDS + N_PLAIN).fit(batches, epochs=6)

    @staticmethod
    def _pad(x: list[np.ndarray], y: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t = max(map(len, x))
        out, mask, want = np.zeros((t, len(x), N_PATH + N_WORDS + N_PLAIN), np.float32), np.zeros((t, len(x)), np.float32), np.zeros((t, len(x)), np.float32)
        for k, a in enumerate(x):
            out[: len(a), k], mask[: len(a), k] = a, 1
            if y:
                want[: len(a), k] = y[k]
        return out, mask, want

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For each page the probabilities of its blocks."""
        out, order, i = [np.zeros(len(bs), np.float32) for bs in pages], sorted((k for k, bs in enumerate(pages) if bs), key=lambda k: len(pages[k])), 0
        while i < len(order):
            j = i
            while j < len(order) and (j - i + 1) * len(pages[order[j]]) <= 20_000 and j - i < 256:
                j += 1
            part = order[i : max(j, i + 1)]
            x, mask, _ = self._pad([vectors(pages[k]) for k in part])
            p = self.net.predict(x, mask)
            for n, k in enumerate(part):
                out[k][:] = p[: len(pages[k]), n]
            i += len(part)
        return out

    def texts(self, pages: list[str]) -> list[str]:
        cut = [blocks(p) for p in pages]
        return ["\n\n".join(b.text for b, q in zip(bs, p, strict=True) if q >= 0.5) for bs, p in zip(cut, self.label(cut), strict=True)]


#: Marks main text in generated pages.  No feature that the model keeps tells it from other invented words, as each has other letters behind it.
MARK = "m41n"
#: Layout families: names of classes (telling, meaningless, none) and elements (those HTML has for regions, or divs alone).
FAMILIES = ("telling-rich", "telling-plain", "opaque-rich", "opaque-plain", "bare-rich", "bare-plain")
#: Regions around the main text: elements, and what pages call them.
REGIONS = {
    "nav": (("nav",), ("menu", "nav", "navbar", "main-menu", "breadcrumbs", "navigation", "topnav", "site-nav", "toc", "contents-list")),
    "header": (("header",), ("header", "site-header", "masthead", "topbar", "logo", "branding")),
    "footer": (("footer",), ("footer", "site-footer", "copyright", "legal", "bottom", "colophon")),
    "ad": ((), ("ad", "ads", "advert", "advertisement", "banner", "sponsored", "promo", "ad-slot")),
    "sidebar": (("aside",), ("sidebar", "side", "widget", "right-column", "sidebar-left", "secondary")),
    "comments": ((), ("comments", "comment-list", "reader-comments", "discussion", "responses", "respond")),
    "form": (("form",), ("newsletter", "login", "search", "subscribe", "signup", "contact-form")),
    "notice": ((), ("cookie", "cookie-notice", "notice", "alert", "consent", "gdpr", "popup", "modal", "warning")),
    "share": ((), ("share", "social", "share-buttons", "social-links", "follow")),
    "related": (("aside",), ("related", "recommended", "more", "read-next", "teaser", "pagination", "tags")),
    "main": (("article", "main"), ("content", "main", "post", "entry", "article-body", "story", "main-content", "post-content", "article", "page-content", "text", "story-body")),
}
#: What boilerplate says, beside invented words.
PHRASES = {
    "footer": ("All rights reserved", "Privacy policy", "Terms of use", "Impressum", "Contact us", "Mentions légales", "Aviso legal"),
    "notice": ("We use cookies to improve your experience", "This site uses cookies", "Please accept our terms", "You have read your last free article", "Wir verwenden Cookies"),
    "comments": ("Comments", "Reader comments", "Discussion", "Responses", "Leave a reply", "Kommentare"),
    "form": ("Search", "Subscribe", "Sign in", "Send", "Sign up for our newsletter", "Your email"),
    "share": ("Share this", "Follow us", "Tweet", "Email this", "Print"),
    "related": ("Related", "Read more", "More stories", "See also", "You may also like"),
    "ad": ("Advertisement", "Sponsored", "Shop now", "Learn more", "Limited offer"),
}
_SCRIPTS = ("abcdefghijklmnopqrstuvwxyz",) * 4 + ("aeioubcdlmnprstáéíóñ", "aeioubdfgklmnrstwäöüß", "абвгдежзиклмнопрстуфхчшыюя", "αβγδεζηθικλμνξοπρστυφχψω")


class Layout:
    """A generated page: a family of layouts, an alphabet, regions around and within the main text."""

    def __init__(self, seed: int, families: tuple[str, ...] | None = None):
        r = self.r = random.Random(seed)
        self.names, self.elements = r.choice(families or FAMILIES).split("-")
        letters = r.choice(_SCRIPTS)
        self.parts = ["".join(r.choice(letters) for _ in range(r.randint(1, 4))) for _ in range(40)]
        #: In some pages words carry stray signs or capitals, in main text and elsewhere alike.
        signs = "".join(r.choice("!#$%&*+/=?@^_|~-") for _ in range(r.randint(1, 4)))
        self.signs, self.dirt, self.loud = signs, r.choice((0, 0, 0, 0.2, 0.5, 1.0)), r.random() < 0.08
        self.stutter = r.random() < 0.06
        #: A short article under which readers say more than it does, in plain paragraphs, where names tell them apart.
        self.talk = self.names == "telling" and r.random() < 0.15
        #: Meaningless names are the same ones wherever a page has the same kind of box.
        self.opaque: dict[str, str] = {}

    def word(self) -> str:
        return "".join(self.r.choice(self.parts) for _ in range(self.r.randint(1, 3)))

    def dirty(self, word: str) -> str:
        word = word.upper() if self.loud else word
        return word + self.signs if self.r.random() < self.dirt else word

    def words(self, low: int, high: int) -> str:
        return " ".join(self.dirty(self.word()) for _ in range(self.r.randint(low, high)))

    def sentence(self) -> str:
        text = self.words(2, self.r.choice((8, 14, 24)))
        if self.stutter and self.r.random() < 0.3:
            text = " ".join([text] * self.r.randint(2, 8))
        if self.r.random() < 0.3:
            text = text.replace(" ", ", ", 1)
        return text[:1].upper() + text[1:] + self.r.choice((".", ".", ".", "?", "!"))

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(low, high)))

    def marked(self, text: str) -> str:
        parts = text.split(" ")
        parts.insert(self.r.randint(0, len(parts)), MARK + self.word())
        return " ".join(parts)

    def main(self) -> str:
        text = self.marked(self.sentences(*self.r.choice(((1, 1), (1, 2), (2, 4), (4, 9)))))
        if self.r.random() < 0.2:
            parts = text.split(" ")
            parts[self.r.randrange(len(parts))] = f'<a href="/{self.word()}">{self.words(1, 3)}</a>'
            text = " ".join(parts)
        return text

    def tag(self, name: str, inner: str, attributes: str = "") -> str:
        return f"<{name}{' ' + attributes if attributes else ''}>{inner}</{name}>"

    def name(self, kind: str, telling: tuple[str, ...] = ()) -> str:
        """A class or id of a box, by the page's family."""
        r = self.r
        if self.names == "bare" or self.names == "telling" and not telling:
            return ""
        if self.names == "telling":
            value = r.choice(telling)
        elif r.random() < 0.2:
            value = "".join(r.choice(string.ascii_lowercase) for _ in range(r.randint(3, 8)))
        else:
            value = self.opaque.setdefault(kind, r.choice(("c-{}", "css-{}x", "col-{}", "{}", "box{}", "sc-{} jss")).format("".join(r.choice(string.ascii_lowercase + string.digits) for _ in range(r.randint(1, 6)))))
        quote = r.choice(('"', '"', "'"))
        return f"{r.choice(('class', 'class', 'class', 'id'))}={quote}{value}{quote}"

    def region(self, kind: str, inner: str) -> str:
        elements, telling = REGIONS[kind]
        if elements and self.elements == "rich" and self.r.random() < 0.75:
            return self.tag(self.r.choice(elements), inner, self.name(kind, telling) if self.r.random() < 0.4 else "")
        return self.tag(self.r.choice(("div", "div", "div", "section")), inner, self.name(kind, telling))

    def phrase(self, kind: str) -> str:
        """What boilerplate says in a phrase: a usual one, or invented words."""
        return self.r.choice(PHRASES[kind]) if self.r.random() < 0.5 else self.words(1, 5)

    def links(self, low: int, high: int, long: bool = False) -> str:
        r = self.r
        one = lambda: f'<a href="/{self.word()}">{self.words(3, 12) if long else self.words(1, 3)}</a>'
        many = [one() for _ in range(r.randint(low, high))]
        form = r.random()
        if form < 0.5:
            return self.tag(r.choice(("ul", "ul", "ol")), "".join(self.tag("li", x) for x in many))
        if form < 0.75:
            return "".join(self.tag(r.choice(("div", "p")), x) for x in many)
        return r.choice((" ", " | ", " &middot; ", " / ")).join(many)

    def boiler(self, kind: str) -> str:
        r = self.r
        heading = self.tag(r.choice(("h2", "h3", "h4", "div", "p")), self.phrase(kind)) if kind in PHRASES and r.random() < 0.7 else ""
        para = lambda low, high: self.tag(r.choice(("p", "p", "div", "span")), self.sentences(low, high))
        if kind == "nav":
            inner = self.links(2, 9)
        elif kind == "header":
            inner = self.tag(r.choice(("p", "div", "h1", "h2", "a")), self.words(1, 5)) + r.choice(("", "", self.links(2, 5), self.tag("p", self.words(2, 8))))
        elif kind == "footer":
            year = r.choice(("&copy; ", "© ", "Copyright ", "(c) ", "")) + r.choice((f"{r.randint(1995, 2026)} ", ""))
            inner = r.choice((f"{year}{self.words(1, 4)}", self.tag("p", f"{year}{self.words(1, 4)}. {self.phrase(kind)}"), self.links(2, 6), f"{self.phrase(kind)} {r.choice('|/-')} {self.phrase(kind)}", f"{year}{self.word()}.{self.word()} {r.choice(('', '&middot; ', '- ', '| '))}{self.sentence()}", para(1, 2)))
        elif kind == "ad":
            inner = r.choice((self.sentences(1, 3), heading + para(1, 3), para(1, 2) + f'<a href="/{self.word()}">{self.phrase(kind)}</a>', self.tag("b", self.words(2, 6))))
        elif kind == "sidebar":
            inner = self.tag(r.choice(("h2", "h3", "h4", "div")), self.words(1, 3)) + r.choice((self.links(3, 7), para(1, 1), "".join(para(1, 2) for _ in range(3)), self.links(3, 6, True)))
        elif kind == "comments":
            said = lambda: self.tag("p", self.words(1, 2) if r.random() < 0.5 else f"{self.words(1, 2)} {r.randint(1, 28)}.{r.randint(1, 12)}.20{r.randint(10, 26)}") + para(1, 4) + r.choice(("", self.tag("span", "Reply"), '<a href="#">Reply</a>'))
            # Comments that look like paragraphs are told by a name or a heading alone.
            boxed = not self.talk and r.random() < (0.5 if self.names == "telling" else 0.8)
            heading = heading or ("" if boxed or self.names == "telling" else self.tag("h3", r.choice(PHRASES[kind])))
            one = lambda: self.tag(r.choice(("div", "li", "div")), said() if r.random() < 0.7 else para(1, 3), self.name("comment", ("comment", "comment-body", "reply", "user-comment"))) if boxed else para(1, 3)
            inner = heading + "".join(one() for _ in range(r.choice((6, 10, 20, 40) if self.talk else (1, 2, 3, 4, 6, 10, 20, 40))))
        elif kind == "form":
            inner = heading + self.tag("label", self.phrase(kind)) + '<input type="text">' + self.tag("button", self.phrase(kind)) + (para(1, 1) if r.random() < 0.4 else "")
        elif kind == "notice":
            inner = r.choice((f"{self.phrase(kind)}.", para(1, 2), self.tag("p", f"{self.phrase(kind)}. {self.sentence()}"))) + r.choice(("", "", self.tag("button", "OK"), self.tag("button", self.words(1, 1))))
        elif kind == "share":
            inner = r.choice((self.links(2, 5), self.phrase(kind), heading + self.links(2, 4)))
        else:
            inner = heading + r.choice((self.links(3, 6), self.links(3, 6, True), "".join(self.tag("div", f'<a href="#">{self.words(3, 10)}</a>' + self.tag("p", self.sentence())) for _ in range(3))))
        return self.region(kind, inner)

    def body(self) -> str:
        """The main text: a title, and paragraphs of the page's own kind with other forms among them."""
        r, out = self.r, []
        if r.random() < 0.85:
            title = self.tag(r.choice(("h1", "h1", "h1", "h2")), self.marked(self.words(1, 9)))
            out.append(self.tag("header", title) if self.elements == "rich" and r.random() < 0.1 else title)
        paragraph = r.choice(("p", "p", "p", "p", "div", "br"))
        # Some articles are mostly lists or code, and some say the same short thing again and again.
        lists, code = r.choice((0.06, 0.06, 0.06, 0.25)), r.choice((0.03, 0.03, 0.03, 0.2))
        count = r.choice((1, 1, 2, 2, 3, 5, 8, 14)) if r.random() < 0.97 else r.choice((40, 80, 160, 320))
        count = r.choice((1, 2, 3)) if self.talk else count
        same = self.main() if r.random() < (0.5 if count > 30 else 0.02) else None
        for _ in range(count):
            form = r.random()
            if same and form < 0.95:
                out.append(self.tag("p", same))
            elif form < lists:
                out.append(self.tag(r.choice(("ul", "ul", "ol")), "".join(self.tag("li", self.main() if r.random() < 0.5 else self.marked(self.words(1, 5))) for _ in range(r.randint(1, 6)))))
            elif form < lists + code:
                inner = "\n".join(self.marked(" ".join(self.word() + r.choice(("", "", "()", ";", ":", " =", "/", "--")) for _ in range(r.randint(1, 6)))) for _ in range(r.randint(1, 5)))
                out.append(self.tag("pre", self.tag("code", inner) if r.random() < 0.6 else inner))
            elif form < 0.78:
                out.append(self.main() + "<br><br>" if paragraph == "br" else f"<p><b>{self.main()}<br>" if r.random() < 0.08 else self.tag(paragraph, self.main(), self.name("par") if r.random() < 0.1 else ""))
            elif form < 0.88:
                out.append(self.tag(r.choice(("h2", "h3")), self.marked(self.words(1, 7))))
            elif form < 0.93:
                out.append(self.tag(r.choice(("blockquote", "div", "figcaption", "dd")), self.main()))
            elif form < 0.96:
                out.append(self.tag("table", "".join(self.tag("tr", "".join(self.tag("td", self.marked(self.words(1, 2))) for _ in range(3))) for _ in range(r.randint(1, 3)))))
            else:
                out.append(self.tag(paragraph if paragraph != "br" else "p", self.main()))
        if not any(MARK in x for x in out):
            out.append(self.tag("p", self.main()))
        # Boilerplate of every kind, in every place of the article, also of a very short one.
        for _ in range(r.choice((0, 0, 0, 1, 1, 2)) if self.names != "bare" else r.choice((0, 0, 0, 1))):
            out.insert(r.randint(0, len(out)), self.boiler(r.choice(("ad", "share", "related", "form", "notice", "notice"))))
        return "".join(out)

    def page(self) -> str:
        r = self.r
        before = [self.boiler(k) for k in ("nav", "header", "ad", "notice", "sidebar", "form", "ad") if r.random() < 0.4]
        after = [self.boiler(k) for k in ("footer", "sidebar", "comments", "related", "ad", "share", "form", "notice") if r.random() < (1 if k == "comments" and self.talk else 0.4)]
        r.shuffle(before)
        inner = self.body() + "".join(self.boiler(k) for k, p in (("comments", 0.15), ("share", 0.1), ("related", 0.1)) if r.random() < p)
        if r.random() < 0.9:
            inner = self.region("main", inner)
            if r.random() < 0.2:
                inner = self.region("main", inner)
        for _ in range(r.choice((0, 0, 1, 1, 2, 4, 12))):
            inner = self.tag(r.choice(("div", "div", "section")), inner, self.name("wrap", ("wrapper", "container", "page", "row", "layout")))
        head = f"<head><title>{self.words(1, 5)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
        return f'<!DOCTYPE html><html lang="en">{head}<body>{"".join(before)}<!-- x -->{inner}{"".join(after)}</body></html>'


@functools.lru_cache(maxsize=1)
def default_labeller() -> Labeller:
    return Labeller()


def extract(pages: DataFrame, html_col: str = "html", labeller: Labeller | None = None) -> DataFrame:
    """pages with main_text, an empty string if there is none."""
    arrow_batches(pages.sparkSession)
    pages = pages.drop("main_text")
    model = pages.sparkSession.sparkContext.broadcast(labeller or default_labeller())
    at, names = pages.columns.index(html_col), [*pages.columns, "main_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            html = [(x or b"").decode("utf-8", "replace") for x in b.column(at).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.value.texts(html), pa.string())], names=names)

    return pages.mapInArrow(run, T.StructType([*pages.schema.fields, T.StructField("main_text", T.StringType())]))


def op1_extract(spark, sf_dir: str) -> DataFrame:
    d = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return d.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


QUERIES = {"op1_extract": op1_extract}
SQL: dict[str, str] = {}

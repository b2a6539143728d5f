"""HTML pages as sequences of leaf blocks: text with the hashed path of all tags above it."""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import numpy as np

#: Elements of running text, which don't end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose content is never text of the page.  Those of a head are left out singly, as it ends at the first tag or text that can't stand in it.
SKIPPED = frozenset("script style noscript template svg iframe title".split())
#: A start tag of the second kind closes an open element of the first.
CLOSES = {"li": ("li", "p"), "p": ("p",), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "tr": ("td", "th", "tr", "p"), "option": ("option",), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p")}

_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
#: For what follows a tag whose quotes never close: a tag ends before the next one starts.
_LOOSE = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)([^<>]*+)>")
_END_OF = {name: re.compile(rf"</{name}[\x20\x09-\x0d/]*>", re.I) for name in SKIPPED}
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_TOKEN = re.compile(r"[a-z]+")
_WHITE = re.compile(r"[\x20\x09-\x0d]+")
#: Places of the hashed element names, and of the hashed words of class, id and role.
N_TAG, N_NAME = 48, 64
N_PATH = N_TAG + N_NAME
_tokens: dict[tuple[str, ...], np.ndarray] = {}


class Block:
    """Text with the path above it; boxes are the numbers, on the page, of the elements around its own: the next one and the one around that."""

    __slots__ = ("boxes", "link_chars", "path", "text")

    def __init__(self, text: str, path: np.ndarray, link_chars: int, boxes: tuple[int, int]):
        self.text, self.path, self.link_chars, self.boxes = text, path, link_chars, boxes


def pieces(page: str) -> Iterator[tuple[str | None, str, bool]]:
    """(tag, its attributes or the text, closing) in order, with None as the tag of text; each character is looked at a bounded number of times.

    Comments, declarations and the content of SKIPPED elements are left out, to the end of the page if they don't end.
    What starts like a tag and never ends is text.
    """
    at, size, tag = 0, len(page), _TAG
    last = page.rfind(">")
    while at < size:
        if page[at] != "<":
            end = page.find("<", at)
            end = size if end < 0 else end
            yield None, page[at:end], False
            at = end
            continue
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = size if end < 0 else end + 3
            continue
        if at > last:  # nothing that follows can be a tag
            yield None, page[at:], False
            return
        if page[at + 1 : at + 2] in ("!", "?") or page[at + 1 : at + 2] == "/" and not page[at + 2 : at + 3].isalpha():
            at = page.find(">", at) + 1
            continue
        m = tag.match(page, at)
        if m is None and tag is _TAG and page[at + 1 : at + 2].isalpha():
            tag = _LOOSE
            m = tag.match(page, at)
        if m is None:
            yield None, "<", False
            at += 1
            continue
        name, rest, at = m[2].lower(), m[3], m.end()
        if name in SKIPPED:
            if not m[1] and not rest.endswith("/"):
                end = _END_OF[name].search(page, at)
                at = end.end() if end else size
            continue
        yield name, rest, bool(m[1])


def path_vector(tokens: tuple[str, ...]) -> np.ndarray:
    """The signed sum of hashed places of an element's tokens; the first is its name.  Remembered for the elements seen first."""
    v = _tokens.get(tokens)
    if v is None:
        v = np.zeros(N_PATH, np.float32)
        for i, token in enumerate(tokens):
            h = zlib.crc32(token.encode())
            v[N_TAG + h % N_NAME if i else h % N_TAG] += 1.0 if h >> 16 & 1 else -1.0
        if len(_tokens) < 100_000:
            _tokens[tokens] = v
    return v


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order.  Element names and the words of class, id and role make the path, the sum of its elements' vectors."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...], int]] = []
    made = 0
    opened: dict[str, int] = {}
    parts: list[str] = []
    links, in_link = 0, 0
    path = np.zeros(N_PATH, np.float32)

    def end() -> None:
        nonlocal links
        text = _WHITE.sub(" ", html.unescape("".join(parts))).strip(" ")
        if text:
            out.append(Block(text, path.copy(), links, (stack[-2][2] if len(stack) > 1 else -1, stack[-3][2] if len(stack) > 2 else -1)))
        parts.clear()
        links = 0

    def pop() -> None:
        nonlocal path
        name, tokens, _ = stack.pop()
        opened[name] -= 1
        path -= path_vector(tokens)

    for tag, rest, close in pieces(page):
        if tag is None:
            parts.append(rest)
            links += len(rest) if in_link else 0
            continue
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            elif tag == "a":
                in_link = 0 if close else 1
            continue
        end()
        in_link = 0
        if close:
            if opened.get(tag):
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in VOID or tag == "head":
            continue
        if tag not in CLOSES:
            while stack and stack[-1][0] == "p":
                pop()
        else:
            while stack and stack[-1][0] in CLOSES[tag]:
                pop()
        named = [t for g in _NAMED.findall(rest) for x in g if x for t in _TOKEN.findall(x.lower())] if rest else []
        stack.append((tag, (f"<{tag}>", *named), made))
        made += 1
        opened[tag] = opened.get(tag, 0) + 1
        path += path_vector(stack[-1][1])
    end()
    return out

"""HTML extraction (operator 7): the maximum-scoring contiguous region.

A page is a sequence of words and tags. A tag scores negative. A word
scores by its place: the logit, fitted on labelled pages, of being main
text, from the elements that it stands in (their names, the parts of their
classes and ids, roles, whether they hold most of the page) and the shape
of its block (length, share of links, how it ends). One linear scan finds
the contiguous run of the highest sum; pieces of it whose elements alone
speak against them (an advert inside an article, say) are left out, and
a stretch of them costs the run no more than a tag does.

No class or element is taken out by a list: what menus, adverts and
comments are called is learned from `labelled_pages`.

The scan of the markup is linear, whatever is malformed, and follows
browsers: quotes count after `=` only, a comment or script without an end
takes the rest, a tag cut off at the end of the page is dropped. Character
references are decoded, white space inside a block becomes one space,
blocks are joined in page order by one space. Nothing is capped.

Defined results: null and empty pages, and pages without words outside of
markup, give an empty text; unclosed and stray tags are tolerated; equal
runs go to the earlier one; repeated rows give repeated rows; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._common import slices
from .toxicity import logistic

_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_REST = re.compile(r"(?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+>")
_COMMENT_END = re.compile(r"--!?>")
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_PARTS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
# Elements by their role.
RAW = frozenset("script style noscript template textarea svg math iframe object canvas audio video select title xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
HOLDERS = frozenset("article main".split())
#: Elements whose names say something about what they hold; the others count only as the nearest block.
TELLING = HOLDERS | frozenset("nav header footer aside form menu dialog button fieldset label figure figcaption blockquote pre address details summary table".split())
_WHOLE = frozenset("html body".split())
#: A start tag closes an open element of these kinds first, as browsers do.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "p": ("p",)}
_ENDS = frozenset(".!?…:;\"'”»)")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.I) for name in RAW}


class Page:
    """The elements, blocks and pieces of text of a page, by one linear scan.

    elements: [parent, name, attributes, inside an article or main, words]; pieces: (element, text, words, block);
    blocks: [words, words in links, last letter, name of the nearest block element]; items: pieces (their number) and tags (their name, the element that is open after them), in page order."""

    def __init__(self, page: str):
        self.elements: list[list] = [[-1, "", "", False, 0]]
        self.blocks: list[list] = [[0, 0, "", ""]]
        self.pieces: list[tuple[int, str, int, int]] = []
        self.items: list[int | tuple[str, int]] = []
        self._stack, self._open, self._links, self._holders = [0], Counter(), 0, 0
        at, end = 0, len(page)
        while at < end:
            here = page.find("<", at)
            if here < 0:
                here = end
            after = page[here + 1 : here + 2]
            close = after == "/"
            if here < end and not (close or after in ("!", "?") or after.isascii() and after.isalpha()):
                after_text = here + 1  # a lone "<" is text
                self._text(page[at:after_text])
                at = after_text
                continue
            if here > at:
                self._text(page[at:here])
            if here == end:
                break
            named = _NAME.match(page, here + 1 + close)
            if not named:
                at = self._declaration(page, here, end)
                continue
            name = named[0].lower()
            rest = _REST.match(page, named.end())
            if not rest:
                break  # cut off
            at = rest.end()
            if close:
                self._close(name)
            elif name in RAW:
                if page[at - 2] != "/":
                    found = _RAW_END[name].search(page, at)
                    at = found.end() if found else end
                continue
            else:
                self._start(name, page[named.end() : at - 1])
            self.items.append((name, self._stack[-1]))
            if name not in INLINE:
                self._block()
        for i in range(len(self.elements) - 1, 0, -1):  # children come after their parents
            self.elements[self.elements[i][0]][4] += self.elements[i][4]

    def tag(self, item: tuple[str, int]) -> str:
        """What a tag is called: those inside an article or main are a kind of their own."""
        return f"tag:{item[0]}@in" if self.elements[item[1]][3] else f"tag:{item[0]}"

    @staticmethod
    def _declaration(page: str, here: int, end: int) -> int:
        if page.startswith("<!--", here):
            if page.startswith((">", "->"), here + 4):
                return page.index(">", here + 4) + 1
            found = _COMMENT_END.search(page, here + 4)
            return found.end() if found else end
        found = page.find(">", here)
        return found + 1 if found >= 0 else end

    def _block(self) -> None:
        if self.blocks[-1][0]:
            self.blocks.append([0, 0, "", ""])

    def _start(self, name: str, attributes: str) -> None:
        if name in VOID:
            return
        stack = self._stack
        for n in _CLOSES.get(name, ()):
            if self.elements[stack[-1]][1] == n:
                self._pop()
        self.elements.append([stack[-1], name, attributes.strip(), self._holders > 0, 0])
        stack.append(len(self.elements) - 1)
        self._open[name] += 1
        self._links += name == "a"
        self._holders += name in HOLDERS

    def _pop(self) -> str:
        name = self.elements[self._stack.pop()][1]
        self._open[name] -= 1
        self._links -= name == "a"
        self._holders -= name in HOLDERS
        return name

    def _close(self, name: str) -> None:
        if self._open[name]:
            while self._pop() != name:
                pass

    def _text(self, raw: str) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        words = len(text.split())
        element, block = self._stack[-1], self.blocks[-1]
        if words:
            if not block[0]:
                block[3] = next((n for i in reversed(self._stack) if (n := self.elements[i][1]) not in INLINE), "")
            block[0] += words
            block[1] += words if self._links else 0
            block[2] = text.rstrip()[-1:]
            self.elements[element][4] += words
        self.items.append(len(self.pieces))
        self.pieces.append((element, text, words, len(self.blocks) - 1))


def element_features(name: str, attributes: str, inside: bool, most: bool) -> list[str]:
    """What an element says about the text in it. most: it holds at least half of the page's words, so its class tells less."""
    out = [f"el:{name}{'@in' * inside}"] if name in TELLING else []
    if not attributes or name in _WHOLE:
        return out
    size = "most" if most else "part"
    seen = set()
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            for word in value.split():
                parts = [p.lower() for p in _PARTS.findall(word)]
                seen.update(parts)
                if len(parts) > 1:
                    seen.add("-".join(parts))
        elif key == "role":
            out.append(f"role:{value.lower()}")
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            out.append("hidden")
    return out + [f"at:{p}:{size}" for p in sorted(seen)]


def block_features(words: int, linked: int, last: str, name: str) -> list[str]:
    length = "1" if words < 2 else "4" if words < 5 else "12" if words < 13 else "30" if words < 31 else "more"
    links = "none" if not linked else "some" if 2 * linked < words else "most"
    return [f"len:{length}", f"link:{links}", f"end:{last in _ENDS}", f"in:{name}"]


def fit(labelled: list[tuple[str, str]], ridge: float = 0.001) -> dict[str, float]:
    """Weights from labelled pages (html, main text): of features by a logistic regression on pieces, of tags by how often they stand outside the main text."""
    rows, truth, count = [], [], []
    inside, outside = Counter(), Counter()
    for page, main in labelled:
        parsed, left, at = Page(page), "".join(main.split()), 0
        labels = []
        paths: list[list[str]] = []
        total = parsed.elements[0][4]
        for parent, name, attributes, within, words in parsed.elements:
            paths.append((paths[parent] if parent >= 0 else []) + element_features(name, attributes, within, 2 * words >= total))
        for element, text, words, block in parsed.pieces:
            bare = "".join(text.split())
            good = bool(words) and left.startswith(bare, at)
            at += len(bare) * good
            labels.append(good)
            if words:
                rows.append(paths[element] + block_features(*parsed.blocks[block]))
                truth.append(good)
                count.append(words**0.5)
        if at < len(left):
            raise ValueError(f"the labelled text goes on with {left[at : at + 40]!r}, which the page does not have there")
        good = [k for k, x in enumerate(parsed.items) if isinstance(x, int) and labels[x]]
        for k, x in enumerate(parsed.items):
            if not isinstance(x, int):
                (inside if good and good[0] < k < good[-1] else outside)[parsed.tag(x)] += 1
    names = sorted({f for r in rows for f in r})
    number = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(rows), len(names)))
    for i, r in enumerate(rows):
        for f in set(r):
            x[i, number[f]] = 1
    weights = logistic(x, np.array(truth, float), ridge, count=np.array(count)) if rows else np.zeros(1)
    out = dict(zip([*names, "bias"], weights.tolist(), strict=True))
    for tag in inside.keys() | outside.keys():
        a, b = inside[tag], outside[tag]
        out[tag] = -0.02 - TAG * (b + 0.1) / (a + b + 0.5)
    return out


#: The most a word scores, and the least that a piece adds to a run; what a tag adds at the least, and one that no labelled page has.
MOST, LEAST, TAG, UNSEEN_TAG = 2.0, -4.0, 0.3, -0.1
#: What stands in elements that score so little is left out, and what a stretch of it adds.
AGAINST, STRETCH = -2.0, -1.0


def region(scores: list[float]) -> tuple[int, int]:
    """The run [first, end) of the highest sum, by one scan; empty if no sum is positive."""
    best, run, start, found = 0.0, 0.0, 0, (0, 0)
    for i, x in enumerate(scores):
        run += x
        if run <= 0:
            run, start = 0.0, i + 1
        elif run > best:
            best, found = run, (start, i + 1)
    return found


class Extractor:
    """Extracts main texts with fitted weights; what elements and blocks score is kept from page to page, up to a bound."""

    def __init__(self, weights: dict[str, float], kept: int = 100_000):
        self.weights, self.kept, self.known = weights, kept, {}

    def _score(self, features, *key) -> float:
        value = self.known.get(key)
        if value is None:
            if len(self.known) >= self.kept:
                self.known.clear()
            get = self.weights.get
            value = self.known[key] = sum(get(f, 0.0) for f in features(*key))
        return value

    def extract(self, page: str | None) -> str:
        if not page:
            return ""
        parsed, weights = Page(page), self.weights
        total, bias = parsed.elements[0][4], weights["bias"]
        context: list[float] = []
        for parent, name, attributes, within, words in parsed.elements:
            own = self._score(element_features, name, attributes, within, 2 * words >= total) if attributes or name in TELLING else 0.0
            context.append(max(-12.0, min(12.0, context[parent] + max(-6.0, min(6.0, own)))) if parent >= 0 else 0.0)
        # as few distinct blocks as the features tell apart
        shape = [bias + self._score(block_features, min(n, 31), 0 if not linked else 1 if 2 * linked < n else min(n, 31), "." if last in _ENDS else "", name) if n else 0.0 for n, linked, last, name in parsed.blocks]
        scores, against = [], False
        for x in parsed.items:
            if isinstance(x, int):
                element, _, words, block = parsed.pieces[x]
                if context[element] <= AGAINST:  # a stretch of what is left out scores like one tag
                    scores.append(0.0 if against or not words else STRETCH)
                    against |= words > 0
                else:
                    scores.append(max(LEAST, min(MOST, context[element] + shape[block]) * words))
                    against &= not words
            else:
                scores.append(0.0 if context[x[1]] <= AGAINST else weights.get(parsed.tag(x), UNSEEN_TAG))
        first, end = region(scores)
        out = []
        for x in parsed.items[first:end]:
            if not isinstance(x, int):
                if x[0] not in INLINE:
                    out.append(" ")
            else:
                element, text, _, _ = parsed.pieces[x]
                if context[element] > AGAINST:
                    out.append(text)
        return " ".join("".join(out).split())


def extract(page: str | None, weights: dict[str, float]) -> str:
    """The main text of a page."""
    return Extractor(weights).extract(page)


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", labelled: list[tuple[str, str]] | None = None) -> DataFrame:
    """A row per page: page_id, url, text, n_chars. labelled: pages to fit the weights on; by default those of labelled_pages."""
    if labelled is None:
        from .labelled_pages import PAGES as labelled
    weights = fit(labelled)
    df = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    schema = df.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extractor = Extractor(weights)
        for batch in batches:
            for part in slices(batch, "html"):
                got = [extractor.extract(h) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(got, pa.string()), pa.array(map(len, got), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return df.mapInArrow(run, schema)

"""Main-text extraction: flat text blocks classified by a decision tree.

A page is read once into a flat list of text blocks. What is no block by its element or
its name (scripts, styles, forms, asides; adverts, notices, reader comments) is left out,
as nothing in its words tells it from text. All else is a block, menus, headers, footers
and bars of links among them. A block is described by its word count and link density
and those of its neighbours, and by three facts of the markup: a heading, within the
main element, whether the page has one. A decision tree is trained on a small labelled
table of block sequences. Splits by facts count for less than splits by words and links,
so the tree asks for a fact where these leave a block open.
"""

from __future__ import annotations

import html
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import arrow_schema, slices

#: Elements by what they do to text (HTML standard).
UNSEEN = "script style noscript template svg iframe object textarea select head title canvas math audio video".split()
INLINE = "a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
HEADINGS = "h1 h2 h3 h4 h5 h6".split()
NESTING = "div section nav header footer aside article main form ul ol li dl table tr td th figure figcaption blockquote fieldset dialog menu details center body button".split()
#: Elements, and words of class, id and role, of what is no part of a text.
APART = "aside form menu dialog button".split()
NAMES = frozenset("ad ads reply replies".split())
STEMS = tuple("advert sponsor promo banner cookie consent notice notif alert sidebar comment discussion related recommend shar social subscri newsletter widget".split())
#: Elements that may lie within the main element without being text.
FRAMES = frozenset("nav footer".split())
#: Elements that hold no other blocks; a next block ends them.
LEAVES = frozenset(["p", "pre", *HEADINGS])
#: An entry of a list of terms ends at the next one.
TERMS = frozenset(["dt", "dd"])
#: Unseen elements whose content is no markup; one that is never closed hides the rest of the page.
RAW = frozenset("script style title textarea".split())

_TAG = regex.compile(r"""<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[A-Za-z][A-Za-z0-9:-]*+)(?P<rest>(?:[^>"']|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", regex.S)
_NAMED = regex.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", regex.I)
_WORD = regex.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    text: str
    words: int
    linked: int
    main: bool
    heading: bool


def _named(rest: str) -> set[str]:
    return {w.lower() for m in _NAMED.finditer(rest) for w in _WORD.findall(m[1] or m[2] or m[3] or "")} if "=" in rest else set()


def _names_apart(found: set[str]) -> bool:
    return bool(found & NAMES) or any(w.startswith(STEMS) for w in found)


def _all_apart(rest: str, nested: bool) -> bool:
    """Whether an article's names say nothing but such words: ``comment``, and ``comment-body`` within another element.

    A word among others (``post has-comments``) says what the article has, not what it is.
    """
    names = [n for m in _NAMED.finditer(rest) for n in (m[1] or m[2] or m[3] or "").split()] if "=" in rest else []
    words = [w for w in ([x.lower() for x in _WORD.findall(n)] for n in names) if w]
    return bool(words) and all(all(_names_apart({x}) for x in (w[:1] if nested else w)) for w in words)


def blocks(page: str | None) -> list[Block]:
    """The non-empty text blocks of a page, in page order."""
    out: list[Block] = []
    text: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # element, within main, apart since the innermost main
    anchor, heading, at, page = 0, False, 0, page or ""
    main = apart = False
    opened: Counter[str] = Counter()  # names on the stack, so that a stray end does not search it
    leaf = False  # within a leaf that is named so

    def flush() -> None:
        nonlocal text, linked
        words = html.unescape("".join(text)).split()
        if words and not (apart or leaf):
            out.append(Block(" ".join(words), len(words), min(len(words), len(html.unescape(" ".join(linked)).split())), main, heading))
        text, linked = [], []

    end = len(page)
    while at < end:
        m = _TAG.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            text.append(page[at:stop])
            if anchor:
                linked.append(page[at:stop])
        if not m:
            break
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name == "a":
            anchor = 0 if m["end"] else 1
            continue
        if name in INLINE:
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in UNSEEN:
            if not m["end"] and not m["rest"].endswith("/"):
                close = regex.compile(rf"</{name}\b[^>]*(?:>|\Z)", regex.I).search(page, at)
                at = close.end() if close else (end if name in RAW else at)
            flush()
            continue
        flush()
        leaf = name in LEAVES and not m["end"] and _names_apart(_named(m["rest"]))
        if name in TERMS and not m["end"] and stack and stack[-1][0] in TERMS:
            opened[stack.pop()[0]] -= 1
            main, apart = stack[-1][1:] if stack else (False, False)
        other = name not in LEAVES and (_names_apart(_named(m["rest"])) if not m["end"] else opened[name] > 0)
        if name in HEADINGS:
            heading = not m["end"]
        elif name in NESTING or other and name not in VOID:
            heading, anchor = False, 0
            if m["end"]:
                while opened[name] and stack:
                    last = stack.pop()[0]
                    opened[last] -= 1
                    if last == name:
                        break
            else:
                found = _named(m["rest"])
                if name in ("main", "body"):
                    odd = False
                elif name == "article":
                    odd = _all_apart(m["rest"], main or apart)
                else:
                    odd = name in APART or _names_apart(found)
                opens = name in ("article", "main") and not odd
                stack.append((name, (main or opens) and name not in FRAMES, odd or apart and not opens))
                opened[name] += 1
            main, apart = stack[-1][1:] if stack else (False, False)
        else:
            anchor = 0
    flush()
    return out


FEATURES = ("words", "links", "words before", "links before", "words after", "links after", "main", "heading", "page has main")


#: The words of a neighbour that is not there.
EDGE = -2.0


def describe(found: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block."""
    n = len(found)
    words = np.array([b.words for b in found], float)
    links = np.array([b.linked / b.words for b in found], float)
    before = lambda v, edge: np.concatenate([[edge], v[:-1]]) if n else v
    after = lambda v, edge: np.concatenate([v[1:], [edge]]) if n else v
    main = np.array([b.main for b in found], float)
    own = [main, np.array([b.heading for b in found], float), np.full(n, float(main.any()))]
    return np.stack([words, links, before(words, EDGE), before(links, 0.0), after(words, EDGE), after(links, 0.0), *own], axis=1)


#: Blocks on each side of a split by words or links, at least.
LEAST = 2
#: By how much the gain of a split by a fact of the markup is lessened.
FACTS = {FEATURES.index(f): 0.7 for f in ("main", "heading", "page has main")}


class Tree:
    """A binary decision tree by Gini impurity; ``lessened``: factors of the gain of some features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 10, lessened: dict[int, float] = FACTS):
        self.share = float(y.mean()) if len(y) else 0.0
        self.feature = None
        if depth and 0 < self.share < 1:
            whole, best = self._gini(y) * len(y), (1e-9, None, None)
            for f in range(x.shape[1]):
                values = np.unique(x[:, f])
                for cut in (values[1:] + values[:-1]) / 2:
                    left = x[:, f] <= cut
                    if f not in lessened and min(left.sum(), (~left).sum()) < LEAST:
                        continue
                    gain = whole - self._gini(y[left]) * left.sum() - self._gini(y[~left]) * (~left).sum()
                    gain *= lessened.get(f, 1.0)
                    if gain > best[0] + 1e-12:
                        best = (gain, f, cut)
            if best[1] is not None:
                _, self.feature, self.cut = best
                left = x[:, self.feature] <= self.cut
                self.low, self.high = (Tree(x[w], y[w], depth - 1, lessened) for w in (left, ~left))

    @staticmethod
    def _gini(y: np.ndarray) -> float:
        p = y.mean() if len(y) else 0.0
        return float(2 * p * (1 - p))

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature is None:
            return np.full(len(x), self.share >= 0.5)
        left = x[:, self.feature] <= self.cut
        out = np.empty(len(x), bool)
        out[left], out[~left] = self.low.predict(x[left]), self.high.predict(x[~left])
        return out


#: The labelled table: pages as their blocks in order. A block is + (the article's text) or -, facts
#: (m within the main element, h heading), its words, and after * those in links.
EXAMPLES = """
-1*1 -1*1 -1*1 -1*1 -1*1 -1*1 +mh10 +m51 +m8 +m11 +m36 +m32 +m52 +m25 -11
-1*1 -1*1 -1*1 -1*1 -1*1 -1*1 +mh9 +m12 +m9 +m39 +m8 +m20 +m8 -8
-1*1 -1*1 -1*1 -1*1 -1*1 -1*1 +mh2 +m2 -11
-1*1 -1*1 -1*1 -1*1 -1*1 +mh11 +m17 +m143 +m31 +m189 +m43 +m51 +m22 -11
-1*1 -1*1 -1*1 -1*1 -1*1 -1*1 +mh8 +m8 +m45 +m1 +m30 +m37 +m47 +m2 +m1 +m15 +m3 +m8 -14
-1*1 -1*1 -1*1 -1*1 -1*1 -1*1 +mh7 +m968 +m9 -7
-1*1 -1*1 -1*1 -1*1 -1*1 -1*1 +mh6 +m6 +m10 -15
-1*1 -1*1 -1*1 -1*1 +mh11 +m149 +m46 +m1 +m76 -9
-1*1 -1*1 -1*1 -1*1 -1*1 -1*1 +mh10 +m14 +m31 +m25 +m20 +m1 +m1 +m21 +m12 +m61 -13
-1*1 -1*1 -1*1 +mh6 +m6 +m55 +m48 +m18 +m1 +m15 +m1 +m101 +m6 -16
-1*1 -1*1 +mh3 +m3 +m39 +m117 +m23 +m1 +m13 +m1 +m9 +m5 +m41 -7
-1*1 -1*1 -1*1 +mh8 +m8 +m1 +m1 +m8 +m1 -8
-1*1 -1*1 -1*1 +mh1 +m1 +m15 +m4 +m79 +m1 +m1 +m17 -12
-1*1 -1*1 +mh1 +m1 +m57 +m1 +m4 +m1 +m1 +m124 -13
-1*1 -1*1 +mh2 +m2 +m2 +m1 -9
-1*1 -1*1 +mh1 +m1 +m2 -12
-1*1 -1*1 +mh1 +m1 +m2 +m2 +m16 -12
-1*1 -1*1 -1*1 +mh7 +m11 +m40 +m1 +m1 +m9 +m50 +m21 +m1 +m1 +m12 -10
-1*1 -1*1 +mh4 +m132 +m204 +m1 +m1 +m112 +m27 +m1 +m1 +m8 -15
-2 -1*1 -2*2 -1*1 -22 +mh12 +m64 +m120 +m88 -m6*6 -m7*7 -m5*5 +m40 -2*2 -12
-1*1 -1*1 +mh9 +m75 +m110 -m7*7 -m8*8 -m6*6 -m9*9 -10
-2*2 -3*3 +mh11 -m1 -m1 -m1 -m1 -m1 -m1 -m1 -m1 +m90 +m45 +m130
-1*1 -1*1 +h8 -1 -1 -1 -1 -1 -1 +50 +62 +75 -9
-4 +mh8 -m1*1 -m1*1 -m1*1 +m66 +m18 +m140 -m2*2 -m2*2 -16
+mh7 +m80 +m9*9 +m70 +m12*10 +m55
-3 +mh4 +m1 +m6 +m2 +m5
+mh4 +m20 +m4 +m40 +m2 +m3
-1*1 +mh1 +m14 +m14
-1*1 +mh2 +m40 +m1 +m1
-1*1 +mh4 +m9 +m25 +m1 +m1
+mh1 +m30 +m2 +m1 +m1
-1*1 +mh3 +m18 +m12
+m14 +m14
+mh1 +m14 +m14 +m1 +m1
+mh5 +m30 +m22 +m8
-2 -1*1 +mh3 +m4 +m2
+mh2 +m9 +m60 +m10
-1*1 -1*1 +mh3 +m30*2 +m25 +m2 +m1 +m14 -5 -30 -9
-2*2 +mh10 +m50 +m60 -3 -25 -40 -12 -60 -10
-1*1 -1*1 -1*1 +mh6 +m44 +m95 -2 -25 -40 -12 -60 -30 -10
-2 -6*6 -5*5 -7*7 +mh9 +m60 +m5 +m71 -3 -30 -25 -14 -8
-30 -1*1 -1*1 -2*2 +mh6 +m50 +m13 +m77 -45 -20
-1*1 +mh3 +m20 +m6 +m5 +m7 +mh2 +m30 +m4 +m4 +m12*2 +m35*6 -2*2 -2*2 -6
-1*1 -1*1 -1*1 +h9 +70 +44 +5 +120 -4*4 -5*5 -9
-2*2 -1*1 -2*2 +h7 +33 +2 +58 +90 +14 -2*2 -2*2 -13
-1*1 -1*1 +h8 +62 +31 +4 +85 +40 -12
-1*1 -1*1 +h6 +48 +7 +66 -8 -3*3 -10
-3*3 -2*2 +150 +80 +12 +95 +240 -2*2 -8
+h5 +30 +80 +11 +45 -3*3 -10
-14 -1*1 -1*1 -1*1 +h8 +40 +60 +22 -6*6 -7*7 -7
+h6 +35 +20 +70
+14 +14
+h4 +16 +13 +18
+20 +8 +16
"""
_BLOCK = regex.compile(r"([+-])([mh]*)(\d+)(?:\*(\d+))?")


def example_pages(table: str = EXAMPLES) -> list[tuple[list[Block], list[bool]]]:
    """The blocks and labels of a labelled table."""
    pages = []
    for line in table.split("\n"):
        found = [_BLOCK.fullmatch(x) for x in line.split()]
        if found:
            pages.append(([Block("", int(m[3]), int(m[4] or 0), "m" in m[2], "h" in m[2]) for m in found], [m[1] == "+" for m in found]))
    return pages


def train(table: str = EXAMPLES) -> Tree:
    """The tree of a labelled table."""
    pages = example_pages(table)
    return Tree(np.concatenate([describe(found) for found, _ in pages]), np.concatenate([labels for _, labels in pages]).astype(float))


def main_text(page: str | None, tree: Tree) -> str:
    """The blocks that the tree takes for text, in page order, a line each."""
    found = blocks(page)
    if not found:
        return ""
    return "\n".join(b.text for b, good in zip(found, tree.predict(describe(found)), strict=True) if good)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Extract the main text of every page from its whole html.

    Returns (``id_col``, ``url_col``, text, n_chars), one row per input row, text
    empty where there is none. A null or empty page has an empty text; broken or cut
    markup is read as far as it goes; repeated rows and nulls in other columns are
    kept; further columns are left out; an empty table gives an empty table. One
    narrow pass; a worker holds a few pages.
    """
    tree = train()
    src = pages.select(F.col(id_col).alias("k"), F.col(url_col).alias("u"), F.col(html_col).cast("string").alias("h"))

    def run(batches):
        for rows in slices(batches):
            text = [main_text(h, tree) for h in rows.column(2).to_pylist()]
            schema = arrow_schema([("k", rows.schema.field(0).type), ("u", rows.schema.field(1).type), ("text", pa.string()), ("n_chars", pa.int64())])
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())], schema=schema)

    kinds = [src.schema[c].dataType.simpleString() for c in ("k", "u")]
    return src.mapInArrow(run, f"k {kinds[0]}, u {kinds[1]}, text string, n_chars long").withColumnsRenamed({"k": id_col, "u": url_col})

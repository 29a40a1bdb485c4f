"""Main text of web pages by classified text blocks.

A page becomes a flat list of text blocks.  Each has its word count and link density, those of the blocks before and
after it, and two flags from the tags around it (inside something named as page furniture; inside something named as the
article).  A decision tree, trained on the small labelled table below, says which blocks are main text.

Cases: a null or empty page, and one without main text, give the empty text; broken or truncated markup is read as far
as it goes (unclosed tags and comments end with the page); very long pages are read whole; rows are independent; other
columns pass unchanged and a clash with the output column is refused.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from basketry.llm.arrow_text import text_slices
from basketry.llm.frames import extended_schema

# fixed values of HTML
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td "
    "tfoot th thead tr ul".split()
)
CONTAINER_TAGS = frozenset(
    "article aside blockquote details dialog div dl fieldset figure footer form header main menu nav ol section table ul".split()
)
FURNITURE_TAGS = frozenset("aside dialog fieldset footer form header menu nav".split())
ARTICLE_TAGS = frozenset("article main".split())
UNSEEN_TAGS = "script style noscript template textarea title iframe object svg select button canvas audio video"
FURNITURE_NAMES = frozenset(
    "ad ads advert advertisement advertising adsense banner breadcrumb breadcrumbs byline comment comments commentlist consent "
    "contentinfo cookie cookies copyright disclaimer discussion disqus footer form header masthead menu modal nav navbar "
    "navigation newsletter notice notification pagination pager popup promo promoted related replies reply respond search share "
    "sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar widget".split()
)
ARTICLE_NAMES = frozenset("article articlebody main post entry story".split())

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<unseen>{'|'.join(UNSEEN_TAGS.split())})\b(?P<self>[^>]*)>.*?(?:</(?P=unseen)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|</?(?P<rough>[a-z][a-z0-9:-]*)[^>]*(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""\bhidden\b(?!\s*=\s*["']?false)|display\s*:\s*none|\baria-hidden\s*=\s*["']?true""", re.I)
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    text: str
    words: int
    links: float
    furniture: bool
    article: bool


@dataclass
class _Reader:
    blocks: list[Block] = field(default_factory=list)
    open: list[tuple[str, bool, bool]] = field(default_factory=list)
    runs: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)
    in_link: bool = False
    marked: bool = False

    def add(self, text: str) -> None:
        if text:
            self.runs.append(text)
            if self.in_link:
                self.linked.append(text)

    def flush(self) -> None:
        if self.runs:
            words = html.unescape("".join(self.runs)).split()
            if words:
                links = len(html.unescape(" ".join(self.linked)).split()) / len(words) if self.linked else 0.0
                _, furniture, article = self.open[-1] if self.open else ("", False, False)
                self.blocks.append(Block(" ".join(words), len(words), min(links, 1.0), furniture or self.marked, article))
            self.runs, self.linked = [], []
        self.marked = False

    def tag(self, name: str, closing: bool, attrs: str) -> None:
        if name == "a":
            self.in_link = not closing
        elif name in ("br", "img", "wbr"):
            self.add(" ")
        if name not in BLOCK_TAGS:
            return
        self.flush()
        if closing:
            if name in CONTAINER_TAGS and any(n == name for n, _, _ in self.open):
                while self.open.pop()[0] != name:
                    pass
            return
        self.in_link = False
        furniture, article = _named(attrs) if attrs else (False, False)
        furniture, article = furniture or name in FURNITURE_TAGS, article or name in ARTICLE_TAGS
        if name in CONTAINER_TAGS:
            _, above_furniture, above_article = self.open[-1] if self.open else ("", False, False)
            self.open.append((name, above_furniture or furniture, above_article or article))
        else:
            self.marked = furniture


def _named(attrs: str) -> tuple[bool, bool]:
    """Whether the names in a tag's attributes tell of page furniture, and of the article."""
    names = {p.lower() for m in _NAMES.finditer(attrs) for p in _NAME_PARTS.findall(m[1] or m[2] or m[3] or "")}
    return bool(names & FURNITURE_NAMES) or bool(_HIDDEN.search(attrs)), bool(names & ARTICLE_NAMES)


def text_blocks(page: str) -> list[Block]:
    """The flat text blocks of a page in order."""
    reader, at = _Reader(), 0
    for m in _MARKUP.finditer(page):
        reader.add(page[at : m.start()])
        at = m.end()
        if m["tag"]:
            reader.tag(m["tag"].lower(), bool(m["close"]), m["attrs"])
        elif m["rough"]:
            reader.tag(m["rough"].lower(), m[0].startswith("</"), "")
    reader.add(page[at:])
    reader.flush()
    return reader.blocks


def features(blocks: list[Block]) -> np.ndarray:
    """Per block: own, previous and next word count and link density, furniture flag, article flag."""
    out = np.zeros((len(blocks), 8))
    if blocks:
        own = np.array([(b.words, b.links) for b in blocks], float)
        out[:, 0:2] = own
        out[1:, 2:4] = own[:-1]
        out[:-1, 4:6] = own[1:]
        out[:, 6] = [b.furniture for b in blocks]
        out[:, 7] = [b.article for b in blocks]
    return out


#: words, link density, previous words and density, next words and density, furniture, article -> main text
LABELLED_BLOCKS = (
    # an article's title, paragraphs of any length, last paragraph before a footer
    ((9, 0, 1, 1, 40, 0, 0, 1), 1),
    ((1, 0, 12, 1, 3, 0, 0, 1), 1),
    ((60, 0, 9, 0, 35, 0.1, 0, 1), 1),
    ((35, 0.1, 60, 0, 2, 0, 0, 1), 1),
    ((2, 0, 35, 0.1, 1, 0, 0, 1), 1),
    ((1, 0, 2, 0, 80, 0, 0, 1), 1),
    ((80, 0.02, 1, 0, 12, 0, 0, 1), 1),
    ((120, 0.3, 80, 0, 12, 0.2, 0, 1), 1),
    ((15, 0.4, 60, 0, 30, 0, 0, 1), 1),
    ((300, 0, 0, 0, 0, 0, 0, 1), 1),
    ((3, 0, 2, 1, 4, 0, 0, 1), 1),
    ((4, 0, 3, 0, 5, 0.2, 0, 1), 1),
    ((5, 0.2, 4, 0, 6, 0, 0, 1), 1),
    ((6, 0, 5, 0.2, 2, 0, 0, 1), 1),
    ((7, 0, 14, 0, 7, 0, 0, 1), 1),
    ((7, 0, 7, 0, 7, 0, 0, 1), 1),
    ((1, 0, 1, 0, 1, 0, 0, 1), 1),
    ((2, 0, 40, 0, 4, 1, 0, 1), 1),
    ((8, 0, 1, 1, 1, 1, 0, 1), 1),
    ((4, 0, 12, 0.9, 3, 1, 0, 1), 1),
    # lists of links inside an article
    ((4, 1, 60, 0, 5, 1, 0, 1), 0),
    ((5, 1, 4, 1, 6, 1, 0, 1), 0),
    ((12, 0.9, 80, 0, 3, 1, 0, 1), 0),
    ((1, 1, 5, 1, 20, 0, 0, 1), 0),
    # furniture: menus, notices, adverts, forms, comments, footers
    ((1, 1, 0, 0, 1, 1, 1, 0), 0),
    ((2, 1, 1, 1, 9, 0, 1, 0), 0),
    ((9, 0, 2, 1, 9, 0, 1, 0), 0),
    ((14, 0, 80, 0, 0, 0, 1, 0), 0),
    ((45, 0, 60, 0, 50, 0, 1, 0), 0),
    ((50, 0, 45, 0, 3, 0, 1, 0), 0),
    ((45, 0, 60, 0, 50, 0, 1, 1), 0),
    ((6, 0, 35, 0, 60, 0, 1, 1), 0),
    ((80, 0.1, 35, 0, 1, 0, 1, 1), 0),
    ((3, 1, 60, 0, 3, 1, 1, 1), 0),
    # pages that name neither: long text with few links is main text, so is a short block between such
    ((60, 0, 2, 1, 45, 0.1, 0, 0), 1),
    ((45, 0.1, 60, 0, 70, 0, 0, 0), 1),
    ((70, 0, 45, 0.1, 12, 0.2, 0, 0), 1),
    ((25, 0, 5, 0.2, 40, 0, 0, 0), 1),
    ((40, 0.2, 25, 0, 6, 0, 0, 0), 1),
    ((20, 0, 0, 0, 0, 0, 0, 0), 1),
    ((16, 0.05, 3, 1, 2, 1, 0, 0), 1),
    ((5, 0, 40, 0, 60, 0, 0, 0), 1),
    ((8, 0, 70, 0.1, 45, 0, 0, 0), 1),
    ((3, 0, 4, 1, 2, 1, 0, 0), 0),
    ((2, 0, 6, 0, 3, 0, 0, 0), 0),
    ((1, 0, 2, 0, 8, 0, 0, 0), 0),
    ((7, 0, 3, 0.3, 4, 1, 0, 0), 0),
    ((5, 0, 0, 0, 2, 0.5, 0, 0), 0),
    ((6, 0, 40, 0, 0, 0, 0, 0), 0),
    ((4, 0.2, 2, 1, 6, 0, 0, 0), 0),
    ((1, 1, 1, 1, 1, 1, 0, 0), 0),
    ((8, 0.8, 45, 0, 3, 1, 0, 0), 0),
    ((30, 0.8, 5, 1, 20, 0.7, 0, 0), 0),
    ((20, 0.7, 30, 0.8, 8, 0.9, 0, 0), 0),
)


def train_tree(x: np.ndarray, y: np.ndarray, depth: int = 6):
    """A binary tree by least Gini impurity: (feature, threshold, below, above) or a leaf's label."""
    share = y.mean()
    if depth == 0 or share in (0.0, 1.0):
        return int(share >= 0.5)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, f] < cut
            impurity = sum(part.sum() * (q := y[part].mean()) * (1 - q) for part in (low, ~low))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, cut, low)
    if best is None:
        return int(share >= 0.5)
    _, f, cut, low = best
    return (f, float(cut), train_tree(x[low], y[low], depth - 1), train_tree(x[~low], y[~low], depth - 1))


def classify(tree, x: np.ndarray) -> np.ndarray:
    """The tree's label of each row."""
    if isinstance(tree, int):
        return np.full(len(x), tree, bool)
    f, cut, below, above = tree
    low = x[:, f] < cut
    out = np.zeros(len(x), bool)
    out[low], out[~low] = classify(below, x[low]), classify(above, x[~low])
    return out


TREE = train_tree(np.array([r for r, _ in LABELLED_BLOCKS], float), np.array([label for _, label in LABELLED_BLOCKS], float))


def main_text(page: str) -> str:
    """Blocks of main text in page order, one a line."""
    blocks = text_blocks(page)
    return "\n".join(b.text for b, main in zip(blocks, classify(TREE, features(blocks)), strict=True) if main)


def extract(df: DataFrame, column: str = "html", out: str = "text") -> DataFrame:
    """Adds the main text of a column of pages."""
    schema = extended_schema(df, {out: "string"})

    def run(batches):
        for part in text_slices(batches, column):
            texts = [main_text(part.text(i).decode("utf-8", "replace")) for i in range(len(part.start))]
            columns = [*part.batch.columns, pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*part.batch.schema.names, out])

    return df.mapInArrow(run, schema)

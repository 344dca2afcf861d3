"""Main-text extraction: boosted trees over DOM nodes, decoded along the tree.

The trees give each block node log-odds of belonging to the article, from its text density,
links, attribute words, depth, siblings and place. Decoding picks the set of nodes with the
largest total weight in which no kept node has a dropped ancestor, by one pass over the tree
from the leaves up. The model is trained once for each session, on invented pages.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnworks.llm import boosting, training_pages
from cairnworks.llm.batches import map_batches
from cairnworks.llm.dom import Page, parse

#: Invented pages that the model is trained on.
TRAINING_PAGES = 900
#: Nodes scored at a time.
NODES = 20_000

#: Kinds of elements, in the order of their one-hot features.
TAG_GROUPS = (
    ("#page", "html", "body"), ("head",), ("article",), ("main",), ("nav", "menu"), ("header", "hgroup"), ("footer",), ("aside",),
    ("form", "fieldset", "label", "button", "legend"), ("p",), ("h1",), ("h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "dl"), ("li", "dt", "dd"),
    ("table", "thead", "tbody", "tfoot", "tr", "caption"), ("td", "th"), ("blockquote", "pre"), ("figure", "figcaption"), ("div", "center"), ("section",), ("dialog", "details", "summary", "address"),
)
_GROUP = {tag: k for k, group in enumerate(TAG_GROUPS) for tag in group}
#: Attribute words, by what they speak for.
WORD_GROUPS = {
    "nav": "nav navbar navigation topnav menu breadcrumb breadcrumbs toc pager pagination links",
    "head": "header masthead branding brand logo banner topbar",
    "foot": "footer foot copyright legal colophon",
    "side": "sidebar aside widget related recommended trending popular teaser teasers rail more",
    "ad": "ad ads advert adverts advertisement sponsored sponsor promo promoted adslot dfp",
    "notice": "cookie cookies consent notice alert popup modal overlay newsletter subscribe gdpr warning message toast paywall",
    "comment": "comment comments commentlist reply replies discussion respond disqus",
    "social": "share sharing social follow",
    "form": "form search searchbox login signup register contact",
    "main": "content article post entry story prose main body text",
}
_WORD_BIT = {w: 1 << k for k, words in enumerate(WORD_GROUPS.values()) for w in words.split()}
_N_WORDS, _N_TAGS = len(WORD_GROUPS), len(TAG_GROUPS)
#: Groups of elements whose being an ancestor counts.
_ANCESTOR_TAGS = (2, 3, 4, 5, 6, 7, 8, 12)
_SPLIT = re.compile("[^a-z]+")
_AGAINST_TAGS = sum(1 << k for k in (1, 4, 6, 7, 8, 20))
_AGAINST_WORDS = sum(1 << k for k in range(_N_WORDS - 1))
_ENDS = re.compile("[.?!,;:]")


@lru_cache(maxsize=20_000)
def _words_of(attributes: str) -> int:
    bits = 0
    for w in _SPLIT.split(attributes):
        bits |= _WORD_BIT.get(w, 0)
    return bits


def node_features(page: Page) -> np.ndarray:
    """One row of features for each node."""
    n = len(page.tags)
    parents = page.parents
    own, links, marks, heads, count = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    starts, total = [-1] * n, 0
    for owner, text, linked in zip(page.owners, page.texts, page.linked, strict=True):
        own[owner] += len(text)
        links[owner] += linked
        marks[owner] += len(_ENDS.findall(text))
        if starts[owner] < 0:
            starts[owner] = total
        total += len(text)
    text, linked, ends, size, paragraphs = own[:], links[:], marks[:], [1] * n, [0] * n
    inputs = page.inputs[:]
    bits, groups = [0] * n, [0] * n
    place, before = [0] * n, [-1] * n
    last: dict[int, int] = {}
    same: dict[tuple[int, int], int] = {}
    for i in range(n):
        g = groups[i] = _GROUP.get(page.tags[i], 18)
        bits[i] = _words_of(page.attributes[i]) if page.attributes[i] else 0
        p = parents[i]
        if p >= 0:
            place[i] = count[p]
            count[p] += 1
            before[i] = last.get(p, -1)
            last[p] = i
            same[p, g] = same.get((p, g), 0) + 1
    for i in range(n - 1, 0, -1):
        p = parents[i]
        text[p] += text[i]
        linked[p] += linked[i]
        ends[p] += ends[i]
        size[p] += size[i]
        inputs[p] += inputs[i]
        paragraphs[p] += paragraphs[i] + (groups[i] == 9)
        heads[p] += heads[i] + (groups[i] in (10, 11))
        if starts[i] >= 0 and (starts[p] < 0 or starts[i] < starts[p]):
            starts[p] = starts[i]
    above_bits, above_tags = [0] * n, [0] * n
    after, against, favour = [-1] * n, [0] * n, [0] * n  # signs on the way from the page to the node
    for i in range(1, n):
        p = parents[i]
        above_bits[i] = above_bits[p] | bits[p]
        above_tags[i] = above_tags[p] | 1 << groups[p]
        against[i] = against[p] + ((_AGAINST_TAGS >> groups[i]) & 1) + ((bits[i] & _AGAINST_WORDS) > 0)
        favour[i] = favour[p] + (groups[i] in (2, 3)) + (bits[i] >> (_N_WORDS - 1) & 1)
        if before[i] >= 0:
            after[before[i]] = i
    a = np.array
    par = a(parents)
    par[0] = 0
    text, own, linked, ends, size = a(text, float), a(own, float), a(linked, float), a(ends, float), a(size, float)
    bits, above_bits, above_tags, groups, count = a(bits), a(above_bits), a(above_tags), a(groups), a(count, float)
    siblings = count[par]
    before, after = a(before), a(after)
    share = linked / np.maximum(text, 1)
    look = lambda at, values, none: np.where(at >= 0, values[at], none)
    out = np.empty((n, _N_TAGS + 2 * _N_WORDS + len(_ANCESTOR_TAGS) + 28))
    out[:, :_N_TAGS] = groups[:, None] == np.arange(_N_TAGS)
    k = _N_TAGS
    out[:, k : k + _N_WORDS] = bits[:, None] >> np.arange(_N_WORDS) & 1
    out[:, k + _N_WORDS : k + 2 * _N_WORDS] = above_bits[:, None] >> np.arange(_N_WORDS) & 1
    k += 2 * _N_WORDS
    out[:, k : k + len(_ANCESTOR_TAGS)] = above_tags[:, None] >> a(_ANCESTOR_TAGS) & 1
    k += len(_ANCESTOR_TAGS)
    rest = (
        a(page.depths), np.log1p(text), np.log1p(own), share, links / np.maximum(own, 1), text / size, np.log1p(size), count, siblings, place,
        a(place) / np.maximum(siblings, 1), a([same.get((p, g), 0) for p, g in zip(parents, groups.tolist(), strict=True)]), a(starts) / max(total, 1),
        text / max(total, 1), text / np.maximum(text[par], 1), ends / np.maximum(text, 1) * 100, a(paragraphs), a(heads), a(inputs),
        look(before, np.log1p(text), -1), look(before, share, -1), look(after, np.log1p(text), -1), look(after, share, -1), groups[par], look(before, groups, -1),
        a(against), a(against) - look(par, a(against), 0), a(favour),
    )
    for j, values in enumerate(rest):
        out[:, k + j] = values
    return out


@lru_cache(maxsize=1)
def model(n_pages: int = TRAINING_PAGES) -> boosting.Boosted:
    x, y, w = [], [], []
    for source in training_pages.pages(n_pages):
        page = parse(source)
        x.append(node_features(page))
        marked = np.array([page.marks[i] != "0" for i in range(len(page.tags))])
        y.append(marked)
        w.append(np.full(len(marked), 30.0 / (20 + len(marked))))
    return boosting.train(np.concatenate(x), np.concatenate(y).astype(float), np.concatenate(w))


def decode(page: Page, log_odds: np.ndarray) -> list[bool]:
    """The best choice of nodes in which every kept node's ancestors are kept too.

    A node weighs as much as the logarithm of its own text, and little without any.
    """
    n = len(page.tags)
    own = [0] * n
    for owner, text in zip(page.owners, page.texts, strict=True):
        own[owner] += len(text)
    worth = (np.clip(log_odds, -6, 6) * (0.2 + np.log1p(np.array(own, float)))).tolist()
    dropped = [-x for x in worth]
    best = worth[:]  # of the node's subtree, the node kept
    for i in range(n - 1, 0, -1):
        p = page.parents[i]
        dropped[p] += dropped[i]
        best[p] += best[i] if best[i] > dropped[i] else dropped[i]
    keep = [False] * n
    keep[0] = best[0] > dropped[0]
    for i in range(1, n):
        keep[i] = keep[page.parents[i]] and best[i] > dropped[i]
    return keep


def texts_of(sources: list[str], trees: boosting.Boosted) -> list[str]:
    """Main text of each page."""
    out: list[str] = []
    held: list[tuple[Page, np.ndarray]] = []
    size = 0

    def score() -> None:
        if not held:
            return
        odds = trees.log_odds(np.concatenate([x for _, x in held]))
        first = 0
        for page, x in held:
            keep = decode(page, odds[first : first + len(x)])
            first += len(x)
            out.append(" ".join([t for o, t in zip(page.owners, page.texts, strict=True) if keep[o]]))
        held.clear()

    for source in sources:
        page = parse(source)
        x = node_features(page)
        held.append((page, x))
        size += len(x)
        if size > NODES:
            score()
            size = 0
    score()
    return out


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows (page_id, url, text, n_chars), one for each input row.

    Whole pages are read, in time linear in their length however broken; null html is the empty page
    and gives the empty text. Pages are told apart by row, so ties and repeated rows each get their
    own. Ids and urls pass through, nulls included; other columns, whatever their names, are not
    read; an empty table gives an empty result.
    """
    held = pages.sparkSession.sparkContext.broadcast(model())

    def make():
        trees = held.value

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = texts_of(batch.column(2).to_pylist(), trees)
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

        return f

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("h"))
    return map_batches(rows, make, "page_id long, url string, text string, n_chars long")

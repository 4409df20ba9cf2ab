"""Main text of web pages: flat text blocks, classified by a decision tree on word counts and link densities.

A page is read as a flat sequence of text blocks between block-level tags. A block is described by its
own and its neighbours' word counts and link densities, by whether it is a heading, by where it stands
to the page's article (if it marks one), and by whether page furniture (menus, sidebars, notices, adverts,
forms, comments ...) holds it. The tree is trained on the small labelled table below.

Names are weaker signs than tags: an article inside a container that only a name makes furniture ("sidebar
layout") counts as the page's article if it holds more words than all other text (``_settled``). A page
marks an article only where one holds text that is not furniture.

Scripts, styles, comments and tags are no text. Character references are decoded; white space inside a
block becomes one space; blocks are trimmed and, if not empty, joined in page order by an empty line.
Nothing is cut or capped. Null or empty html, and pages without an article, give an empty text. Repeated
rows are alike; other columns than ``page_id``, ``url`` and ``html`` are not read.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_batch

FEATURES = ("words", "density", "before_words", "before_density", "after_words", "after_density", "heading", "article", "furniture")

# Labelled blocks: the features above in order, then 1 for main text. ``article``: 1 inside the page's
# article, -1 outside of it, 0 on pages that mark none. ``furniture``: 1 inside a menu, sidebar or the like.
LABELLED = [
    # inside a marked article: everything but furniture
    (9, 0.0, 12, 0.0, 80, 0.0, 1, 1, 0, 1), (80, 0.0, 9, 0.0, 60, 0.0, 0, 1, 0, 1), (1, 0.0, 60, 0.0, 1, 0.0, 0, 1, 0, 1),
    (3, 0.0, 40, 0.0, 0, 0.0, 0, 1, 0, 1), (25, 0.4, 30, 0.0, 45, 0.1, 0, 1, 0, 1), (2, 1.0, 30, 0.0, 45, 0.0, 0, 1, 0, 1),
    (140, 0.02, 0, 0.0, 0, 0.0, 0, 1, 0, 1), (4, 0.0, 0, 0.0, 0, 0.0, 1, 1, 0, 1), (1, 0.0, 1, 1.0, 8, 0.0, 0, 1, 0, 1),
    (30, 1.0, 10, 0.2, 10, 0.2, 0, 1, 0, 1), (6, 0.5, 6, 0.5, 6, 0.5, 0, 1, 0, 1), (12, 0.0, 80, 0.1, 1, 1.0, 0, 1, 0, 1),
    (1, 0.0, 0, 0.0, 5, 0.0, 1, 1, 0, 1), (2, 0.0, 1, 1.0, 5, 0.0, 1, 1, 0, 1), (5, 0.0, 1, 0.0, 2, 1.0, 0, 1, 0, 1),
    (4, 0.9, 1, 1.0, 60, 0.0, 0, 1, 0, 1), (6, 0.0, 3, 1.0, 2, 1.0, 0, 1, 0, 1), (8, 0.0, 4, 0.5, 0, 0.0, 0, 1, 0, 1),
    (3, 0.0, 2, 1.0, 5, 0.6, 1, 1, 0, 1), (40, 0.6, 10, 0.5, 12, 1.0, 0, 1, 0, 1), (25, 0.8, 60, 0.0, 30, 0.9, 0, 1, 0, 1),
    (2, 1.0, 2, 1.0, 3, 1.0, 0, 1, 0, 1), (5, 0.2, 90, 0.0, 3, 1.0, 0, 1, 0, 1), (4, 0.0, 4, 1.0, 4, 0.0, 0, 1, 0, 1),
    (6, 0.0, 80, 0.0, 60, 0.0, 0, 1, 1, 0), (25, 0.0, 40, 0.0, 70, 0.0, 0, 1, 1, 0), (60, 0.0, 50, 0.0, 20, 0.0, 0, 1, 1, 0),
    (1, 1.0, 40, 0.0, 1, 1.0, 0, 1, 1, 0), (3, 0.0, 120, 0.0, 60, 0.0, 1, 1, 1, 0), (90, 0.1, 2, 0.0, 40, 0.0, 0, 1, 1, 0),
    # outside of the article that the page marks: nothing
    (12, 0.0, 1, 1.0, 9, 0.0, 0, -1, 0, 0), (60, 0.0, 12, 0.0, 9, 0.0, 0, -1, 0, 0), (14, 0.0, 80, 0.0, 0, 0.0, 0, -1, 0, 0),
    (1, 1.0, 0, 0.0, 1, 1.0, 0, -1, 1, 0), (5, 0.0, 0, 0.0, 60, 0.0, 1, -1, 0, 0), (150, 0.0, 90, 0.0, 80, 0.0, 0, -1, 0, 0),
    (20, 0.0, 60, 0.0, 0, 0.0, 0, -1, 1, 0), (40, 0.5, 20, 0.0, 10, 1.0, 0, -1, 0, 0), (8, 1.0, 8, 1.0, 8, 1.0, 0, -1, 1, 0),
    (45, 0.0, 6, 0.0, 60, 0.0, 0, -1, 0, 0), (120, 0.05, 45, 0.0, 30, 0.1, 0, -1, 0, 0), (22, 0.1, 80, 0.0, 50, 0.0, 0, -1, 0, 0),
    (35, 0.2, 2, 1.0, 45, 0.0, 0, -1, 0, 0), (70, 0.25, 30, 0.0, 3, 0.8, 0, -1, 0, 0), (80, 0.0, 20, 0.0, 0, 0.0, 0, -1, 0, 0),
    (40, 0.0, 80, 0.0, 0, 0.0, 0, -1, 0, 0), (3, 0.0, 45, 0.0, 90, 0.0, 1, -1, 0, 0), (9, 0.0, 30, 0.1, 40, 0.0, 0, -1, 0, 0),
    # pages that mark no article: long blocks of few links, and what stands among them
    (45, 0.0, 6, 0.0, 60, 0.0, 0, 0, 0, 1), (120, 0.05, 45, 0.0, 30, 0.1, 0, 0, 0, 1), (22, 0.1, 80, 0.0, 50, 0.0, 0, 0, 0, 1),
    (18, 0.0, 40, 0.0, 2, 1.0, 0, 0, 0, 1), (35, 0.2, 2, 1.0, 45, 0.0, 0, 0, 0, 1), (70, 0.25, 30, 0.0, 3, 0.8, 0, 0, 0, 1),
    (6, 0.0, 60, 0.0, 55, 0.0, 0, 0, 0, 1), (3, 0.0, 45, 0.0, 90, 0.0, 1, 0, 0, 1), (7, 0.0, 2, 1.0, 70, 0.0, 1, 0, 0, 1),
    (5, 0.0, 0, 0.0, 50, 0.0, 1, 0, 0, 1), (9, 0.0, 30, 0.1, 40, 0.0, 0, 0, 0, 1), (14, 0.0, 25, 0.0, 30, 0.0, 0, 0, 0, 1),
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 0, 0, 0), (2, 1.0, 2, 1.0, 3, 1.0, 0, 0, 0, 0), (4, 0.9, 1, 1.0, 60, 0.0, 0, 0, 0, 0),
    (25, 0.8, 60, 0.0, 30, 0.9, 0, 0, 0, 0), (40, 0.6, 10, 0.5, 12, 1.0, 0, 0, 0, 0), (6, 0.0, 3, 1.0, 2, 1.0, 0, 0, 0, 0),
    (5, 0.2, 90, 0.0, 3, 1.0, 0, 0, 0, 0), (8, 0.0, 4, 0.5, 0, 0.0, 0, 0, 0, 0), (3, 0.0, 2, 1.0, 5, 0.6, 1, 0, 0, 0),
    (4, 0.0, 4, 1.0, 4, 0.0, 0, 0, 0, 0), (60, 0.0, 40, 0.0, 30, 0.0, 0, 0, 1, 0), (12, 0.0, 0, 0.0, 60, 0.0, 0, 0, 1, 0),
    (2, 0.0, 3, 0.0, 2, 0.0, 0, 0, 1, 0), (30, 0.0, 2, 1.0, 45, 0.0, 0, 0, 1, 0), (5, 0.0, 50, 0.0, 60, 0.0, 1, 0, 1, 0),
]

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
FURNITURE_TAGS = frozenset("aside button dialog fieldset footer form label menu nav search".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# a word of a class, id or role; the second kind stands for page furniture only outside an article
FURNITURE = re.compile(
    r"(?i)(?<![a-z])(?:ad|ads|adv|advert\w*|adsense|banner|sponsor\w*|promo\w*|comments?|commentlist|disqus\w*|cookies?"
    r"|gdpr|notification|popup|modal|overlay|newsletter|sidebar"
    r"|widgets?|breadcrumbs?|pagination|pager|navigation|nav|navbar|menu|toolbar|complementary|contentinfo)(?![a-z])"
)
# words that name furniture by themselves or beside the words after them, and topics otherwise ("social-science")
WEAK = frozenset(
    "alert consent dialog disclaimer form login notice notices recommended related replies reply respond search share sharing signup social subscribe".split()
)
BESIDE_WEAK = WEAK | frozenset(
    "area article articles bar block body bottom box btn button buttons col column contact container content email follow footer group header heading"
    " icon icons info inner input item items left legal link links list main media message module more network networks new news page panel post posts"
    " region right row section sign site stories story text this title to tools top up us view wrap wrapper".split()
) | {""}
OUTER = re.compile(r"(?i)(?<![a-z])(?:header|masthead|footer|banner|topbar|bottom|copyright|aside|side)(?![a-z])")
ARTICLE = re.compile(r"(?i)(?<![a-z])(?:articlebody|main)(?![a-z])")
# what an article's name may say besides
WITH_MAIN = frozenset(
    "articlebody main area article block body center col column container content contents entry inner left page post region right section site story"
    " text view wrap wrapper".split()
) | {""}
# names of lists that hold articles other than the page's own
LISTS = re.compile(r"(?i)(?<![a-z])(?:comments?|commentlist|disqus\w*|respond|replies|reply|related|recommended)(?![a-z])")
# "has-sidebar", "content-with-left-sidebar", "no-comments": these tell of furniture elsewhere
MODIFIER = re.compile(r"(?i)(?<![a-z])(?:has|with|without|no)[-_][\w-]*")
# kinds of furniture: by tag; an outer frame; by name; by a name of LISTS; an article in either of the last two
FIRM, FRAME, SOFT, LISTED, IN_SOFT, IN_LISTED = range(1, 7)

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|title|textarea|select|iframe|object|svg|canvas)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*>"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)>",
    re.S | re.I,
)
NAMED = re.compile(r"""(?i)(?<![\w-])(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
OPEN_ARTICLE = re.compile(r"(?i)<(?:article|main)\b")


def _names_furniture(names: str) -> bool:
    """Whether one name is furniture's: by a strong word anywhere in it, or by a weak word among words of layout only."""
    if FURNITURE.search(names):
        return True
    parts = (set(re.split("[^a-z]+", n.lower())) for n in names.split())
    return any(p & WEAK and p <= BESIDE_WEAK for p in parts)


def _names_article(names: str) -> bool:
    """Whether one name is an article's, and no "main-nav" or "main-logo"."""
    return any(ARTICLE.search(n) and WITH_MAIN.issuperset(re.split("[^a-z]+", n.lower())) for n in names.split())


def _settled(blocks: list[tuple]) -> list[tuple]:
    """The blocks with furniture as 0 or 1, once the whole page tells which articles inside furniture are its own."""
    soft = sum(b[1] for b in blocks if b[5] == IN_SOFT)
    other = sum(b[1] for b in blocks if not b[5])
    listed = sum(b[1] for b in blocks if b[5] == IN_LISTED)
    own = {0} | ({IN_SOFT} if soft > other else set()) | ({IN_LISTED} if listed and not soft and not other else set())
    return [(*b[:5], int(b[5] not in own)) for b in blocks]


def flat_blocks(page: str) -> list[tuple[str, int, int, int, int, int]]:
    """Text, words, linked words, heading, article and furniture of each block that holds text."""
    blocks: list[tuple] = []
    open_: list[tuple] = []  # tag, and what held before it: article, furniture, heading, link
    article = furniture = heading = link = 0
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            n = text.count(" ") + 1
            blocks.append((text, n, min(linked, n), heading, article, furniture))
        parts.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        text = html.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if link:
            linked += len(text.split())

    def close(tag: str) -> None:
        nonlocal article, furniture, heading, link
        for k in range(len(open_) - 1, -1, -1):
            if open_[k][0] == tag:
                _, article, furniture, heading, link = open_[k]
                del open_[k:]
                return
            if open_[k][0] in ("article", "body", "main", "table") and tag not in ("article", "body", "main", "html", "table"):
                return

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        raw, slash, tag, attributes = m.group(1, 2, 3, 4)
        if tag is None:
            if raw:
                parts.append(" ")
            continue
        tag = tag.lower()
        if tag == "a":
            link = 0 if slash else 1
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCKS or tag in FURNITURE_TAGS:
            flush()
            if slash:
                close(tag)
                continue
            if tag in VOID:
                continue
            if open_ and tag in ("p", "li", "td", "th", "tr", "dd", "dt") and open_[-1][0] == tag:
                close(tag)
            elif open_ and open_[-1][0] == "p":
                close("p")
            open_.append((tag, article, furniture, heading, link))
            names = " ".join(x or y or z for x, y, z in NAMED.findall(attributes)) if "=" in attributes else ""
            names = MODIFIER.sub(" ", names) if names else ""
            opens = tag in ("article", "main") or bool(names) and tag not in FURNITURE_TAGS and tag != "header" and _names_article(names)
            if names and tag not in ("html", "body", "article", "main") and furniture != FIRM:
                if _names_furniture(names):
                    furniture = LISTED if furniture in (LISTED, IN_LISTED) or LISTS.search(names) else SOFT
                elif not article and not opens and not furniture and OUTER.search(names):
                    furniture = FRAME
            if opens:
                if furniture == FRAME and not article:  # an outer frame of that name holds the article
                    furniture = 0
                elif furniture == SOFT:
                    furniture = IN_SOFT
                elif furniture == LISTED:
                    furniture = IN_SOFT if tag == "main" else IN_LISTED
                article = 1
            if tag in FURNITURE_TAGS or tag == "header" and not article:
                furniture = FIRM
            elif tag == "article" and names and re.search(r"(?i)(?<![a-z])comment", names):
                furniture = FIRM
            if tag[0] == "h" and tag[1:].isdigit():
                heading = 1
    if at < len(page):
        say(page[at:])
    flush()
    return _settled(blocks)


def marks_article(blocks: list[tuple]) -> bool:
    return any(b[4] and not b[5] for b in blocks)


def block_features(blocks: list[tuple], marked: bool) -> np.ndarray:
    """One row of ``FEATURES`` per block of one page; ``marked``: the page marks its article."""
    n = len(blocks)
    words = np.array([b[1] for b in blocks], float)
    density = np.array([b[2] for b in blocks], float) / words
    around = lambda x, k: np.r_[0.0, x[:-1]] if k < 0 else np.r_[x[1:], 0.0]
    inside = np.array([b[4] for b in blocks], float)
    place = np.where(inside > 0, 1.0, -1.0) if marked else np.zeros(n)
    return np.stack(
        [words, density, around(words, -1), around(density, -1), around(words, 1), around(density, 1), np.array([b[3] for b in blocks], float), place,
         np.array([b[5] > 0 for b in blocks], float)], axis=1,
    )


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8):
    """A decision tree by Gini impurity: a leaf's label, or (feature, cut, at most, above)."""
    if depth == 0 or y.min() == y.max():
        return int(y.mean() >= 0.5)
    best = (0.0, None)
    impurity = lambda part: len(part) * part.mean() * (1 - part.mean()) if len(part) else 0.0
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[:-1] + values[1:]) / 2:
            left = x[:, f] <= cut
            gain = impurity(y) - impurity(y[left]) - impurity(y[~left])
            if gain > best[0] + 1e-12:
                best = (gain, (f, float(cut)))
    if best[1] is None:
        return int(y.mean() >= 0.5)
    f, cut = best[1]
    left = x[:, f] <= cut
    return f, cut, grow(x[left], y[left], depth - 1), grow(x[~left], y[~left], depth - 1)


@functools.cache
def _trained():
    rows = np.array(LABELLED, float)
    return grow(rows[:, :-1], rows[:, -1])


def classify(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, int):
        return np.full(len(x), bool(tree))
    f, cut, low, high = tree
    left = x[:, f] <= cut
    out = np.zeros(len(x), bool)
    out[left], out[~left] = classify(low, x[left]), classify(high, x[~left])
    return out


def main_text(page: str | None) -> str:
    blocks = flat_blocks(page) if page else []
    if not blocks:
        return ""
    keep = classify(_trained(), block_features(blocks, marks_article(blocks)))
    return "\n\n".join(b[0] for b, k in zip(blocks, keep) if k)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    tree = _trained()

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            found = [flat_blocks(p) if p else [] for p in part.column("html").to_pylist()]
            rows = [block_features(b, marks_article(b)) for b in found if b]
            keep = iter(classify(tree, np.concatenate([np.zeros((0, len(FEATURES))), *rows])).tolist())
            texts = ["\n\n".join([b[0] for b in blocks if next(keep)]) for blocks in found]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    texts = per_batch(pages.select("page_id", "url", "html"), work, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))

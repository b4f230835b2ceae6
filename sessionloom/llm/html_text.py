"""Main text of HTML pages: flat text blocks, classified by a small decision tree.

A page is cut into a flat list of text blocks at block-level tags.  Each block has a word
count and a link density, and so have its neighbours; two more features say whether it stands
in an element that holds the article (``article``, ``main``) or page furniture (``nav``,
``footer``, ``form``, class names of adverts, notices, comments and so on).  A decision tree,
grown on the blocks of the small labelled pages below, keeps or drops each block.

Text of ``head``, ``script``, ``style`` and the like is never part of a block.  Character
references are decoded, white space inside a block (Unicode's too) becomes one space, and the
kept blocks are joined in page order by one space.

Null or empty html gives an empty text; so does a page without a kept block.  Unclosed and
stray tags are accepted.  Repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "noframes", "noembed", "xmp", "select",
       "svg", "math", "object", "canvas", "video", "audio", "datalist")
BLOCKS = frozenset("""address article aside blockquote body br button caption center col colgroup dd details dialog dir
    div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend
    li link main menu meta nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE_TAGS = frozenset("nav footer aside form dialog menu button fieldset head label legend".split())
ARTICLE_TAGS = frozenset(("article", "main"))
# Words in class, id or role that mark furniture.
FURNITURE_WORDS = frozenset("""ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner
    cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login nav navbar
    navigation menu menubar breadcrumb breadcrumbs pager pagination sidebar sidenav aside complementary widget related
    recommended trending share sharing social footer foot masthead topbar toolbar search comment comments comentarios
    kommentare commentaires discussion disqus reply replies respond header contentinfo""".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)", re.S)
_MARKS = re.compile(r"(?:^|[\s\"'/])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|[\s\"'/])hidden(?=[\s/=]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_PIECE = re.compile(r"[A-Za-z]+")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for tag in RAW}


@dataclass
class Block:
    text: str
    words: int
    linked: int
    article: bool
    furniture: bool

    @property
    def link_density(self) -> float:
        return self.linked / self.words if self.words else 0.0


def _is_furniture(tag: str, rest: str, in_article: bool) -> bool:
    if tag in FURNITURE_TAGS or (tag == "header" and not in_article):
        return True
    if not rest:
        return False
    if _HIDDEN.search(rest):
        return True
    names = {w.lower() for found in _MARKS.findall(rest) for w in _PIECE.findall(" ".join(found))}
    return not names.isdisjoint(FURNITURE_WORDS) and tag not in ("html", "body", "article", "main")


def text_blocks(page: str) -> list[Block]:
    """The flat blocks of a page, in page order, without empty ones."""
    blocks: list[Block] = []
    pieces: list[tuple[str, bool]] = []
    # Open elements: (tag, holds the article, is furniture), the flags with those of what is around.
    stack: list[tuple[str, bool, bool]] = []
    links = 0

    def state() -> tuple[bool, bool]:
        return (stack[-1][1], stack[-1][2]) if stack else (False, False)

    def close_block() -> None:
        if pieces:
            text = " ".join(html.unescape("".join(t for t, _ in pieces)).split())
            if text:
                linked = sum(len(html.unescape(t).split()) for t, link in pieces if link)
                count = len(text.split())
                blocks.append(Block(text, count, min(linked, count), *state()))
            pieces.clear()

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            pieces.append((page[at:], links > 0))
            break
        if m.start() > at:
            pieces.append((page[at:m.start()], links > 0))
        at = m.end()
        if m["tag"] is None:
            if page.startswith("<![CDATA[", m.start()):
                pieces.append((html.escape(m[0][9:].removesuffix("]]>")), links > 0))
            continue
        tag, closing, rest = m["tag"].lower(), bool(m["end"]), m["rest"]
        if tag in _RAW_END and not closing:
            if not rest.endswith("/"):
                stop = _RAW_END[tag].search(page, at)
                at = stop.end() if stop else end
            continue
        if tag in BLOCKS:
            close_block()
        if tag == "a":
            links = max(0, links - 1) if closing else 1
        if tag in VOID:
            continue
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    # An end tag of an inline element does not close the blocks inside it.
                    if tag in BLOCKS or all(t not in BLOCKS for t, *_ in stack[i + 1:]):
                        if stack[i][1:] != state():
                            close_block()
                        del stack[i:]
                    break
        else:
            article, furniture = state()
            if tag == "body":  # an unclosed head ends here
                stack.clear()
                article = furniture = False
            if tag in ("p", "li") and stack and stack[-1][0] == tag:
                stack.pop()
                article, furniture = state()
            own_article = article or tag in ARTICLE_TAGS
            own_furniture = furniture or _is_furniture(tag, rest, own_article)
            if (own_article, own_furniture) != (article, furniture):
                close_block()
            stack.append((tag, own_article, own_furniture))
    close_block()
    return blocks


def features(blocks: Sequence[Block]) -> np.ndarray:
    """One row per block: words and link density of it and its neighbours, the two containers,
    and whether the page has an article element at all."""
    words = np.array([b.words for b in blocks], float)
    density = np.array([b.link_density for b in blocks], float)
    before, after = (lambda x: np.concatenate(([0.0], x[:-1]))), (lambda x: np.concatenate((x[1:], [0.0])))
    inside = np.array([b.article for b in blocks], float)
    return np.column_stack([words, density, before(words), before(density), after(words), after(density), inside,
                            np.array([b.furniture for b in blocks], float),
                            np.full(len(blocks), float(inside.any()))]) if blocks else np.zeros((0, 9))


# Labelled pages: the blocks marked "+" are main text, those marked "-" are not.
_LONG = "A paragraph of the story tells in some detail what happened on that day and why it did matter to the people there."
_TEXT = "This one is shorter but still a full sentence of the story, as papers print them."
LABELLED_PAGES: tuple[tuple[str, str], ...] = (
    (f"<body><nav><ul><li><a href=x>Home</a><li><a href=x>World news</a></ul></nav><div class=ad>Buy one now.</div><article>"
     f"<h1>A title</h1><p>{_LONG}<p>{_TEXT}<p>Short.</article><footer>All rights of the owner.</footer>", "---++++-"),
    (f"<body><header>Name of the paper</header><main><h2>Title</h2><p>{_TEXT}</p><p>No.</p><div class=comments><p>{_TEXT}</p>"
     f"</div></main><aside><p>{_LONG}</p></aside><form><label>Your mail</label> Write to us</form>", "-+++----"),
    (f"<body><div class=menu><a href=x>Start</a></div><div><h1>How it came about</h1><p>{_LONG}</p><p>{_TEXT}</p><p>{_LONG}"
     f"</p></div><div id=footer><a href=x>Imprint</a> and terms of this site, all of them in full length</div>", "-++++-"),
    (f"<body><p><a href=x>One</a></p><p><a href=x>Two</a></p><p>{_LONG}</p><p>{_LONG} <a href=x>more</a></p><p>Yes.</p>"
     f"<p>{_LONG}</p><p><a href=x>Back to the front page</a></p><p>Copyright</p>", "--++++--"),
    (f"<body><div>Log in</div><div><a href=x>A long link with many words that leads to another story of this site</a></div>"
     f"<div><a href=x>Another long link with as many words that leads to a story</a></div><div>{_LONG}</div><div>{_TEXT}</div>"
     f"<div>{_LONG}</div><div>Share</div><div><a href=x>Next</a></div>", "---+++--"),
    (f"<body><article><h1>Plain</h1><p>It <a href=x>was</a> so.</p><p><a href=x>A source</a></p><p>{_LONG}</p>"
     f"<div class=related><a href=x>Read on</a></div><ul><li>First point</li><li>Second point</li></ul></article>"
     f"<section><p>{_TEXT}</p></section><div class=cookie-notice>{_LONG}</div>", "++++-++--"),
    (f"<body><nav><a href=x>Home</a></nav><article><h1>To the end</h1><p>{_LONG}<p>{_TEXT}", "-+++"),
    (f"<body><p><a href=x>Up</a></p><article><p>{_TEXT}</p><p>Last.", "-++"),
    ("<body><div>Menu</div><article><h2>One</h2><p>It was.</p><p>So it is.</p></article><div>Top</div>", "-+++-"),
    (f"<body><h1>A page of its own</h1><p>{_LONG}</p><p>{_TEXT}</p><p>{_LONG}", "++++"),
    (f"<p>{_TEXT}</p>", "+"),
    (f"<body><article><p>{_LONG}</p><aside>{_TEXT}</aside><p>End.</p></article><p>{_LONG}</p><p>Hint</p>", "+-+--"),
)


def grow_tree(x: np.ndarray, y: np.ndarray, depth: int = 10, least: int = 1):
    """A binary decision tree by Gini impurity: (feature, threshold, low side, high side) or a label."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0) or len(y) < 2 * least:
        return share >= 0.5
    best = (2 * share * (1 - share) * len(y) - 1e-9, None, None)
    for feature in range(x.shape[1]):
        levels = np.unique(x[:, feature])
        for threshold in (levels[1:] + levels[:-1]) / 2:
            high = x[:, feature] > threshold
            cost = sum(2 * p * (1 - p) * s.sum() for s in (high, ~high) for p in (y[s].mean(),))
            if min(high.sum(), (~high).sum()) >= least and cost < best[0]:
                best = (cost, feature, threshold)
    if best[1] is None:
        return share >= 0.5
    high = x[:, best[1]] > best[2]
    return (best[1], best[2], grow_tree(x[~high], y[~high], depth - 1, least), grow_tree(x[high], y[high], depth - 1, least))


def trained_tree():
    """The tree grown on the labelled pages."""
    parts = [(features(text_blocks(page)), marks) for page, marks in LABELLED_PAGES]
    return grow_tree(np.vstack([x for x, _ in parts]), np.array([m == "+" for _, marks in parts for m in marks]))


def classify(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, (bool, np.bool_)):
        return np.full(len(x), bool(tree))
    feature, threshold, low, high = tree
    return np.where(x[:, feature] > threshold, classify(high, x), classify(low, x))


def main_text(page: str | None, tree) -> str:
    blocks = text_blocks(page or "")
    return " ".join(b.text for b, kept in zip(blocks, classify(tree, features(blocks))) if kept)


def extract_text(df: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """``key``, ``url``, ``text`` and ``n_chars`` (code points) of every row."""
    tree = trained_tree()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py(), tree) for p in batch.column("_html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key"), batch.column("_url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["_key", "_url", "text", "n_chars"])

    kinds = {c: df.schema[c].dataType.simpleString() for c in (key, url)}
    found = df.select(F.col(key).alias("_key"), F.col(url).alias("_url"), F.col(page).alias("_html")).mapInArrow(
        extract, f"_key {kinds[key]}, _url {kinds[url]}, text string, n_chars long")
    return found.select(F.col("_key").alias(key), F.col("_url").alias(url), "text", "n_chars")

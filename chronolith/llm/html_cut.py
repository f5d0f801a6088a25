"""Op 6: main text of web pages by minimum-cut labelling of text blocks."""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, small_batches, table

#: Pages whose text blocks fit the markup weights at most (chosen by a hash of page_id; all their blocks count).
TRAIN_PAGES = 400
#: The most that a block's text may say for or against it; what markup says is about as much, so that neighbours decide.
TEXT_LIMIT = 5.0
#: Capacities of the edges between blocks: next to each other, and more by nearness in the DOM (same element, same container).
NEXT, SAME_PARENT, SAME_CONTAINER, ACROSS = 0.8, 0.8, 1.0, 0.3
#: Weight of all seed blocks of a sample together, against a weight of one for each prior.
SEED_WEIGHT = 100.0

# HTML element names and words of class, id and role attributes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
RAW = frozenset("script style title noscript template iframe textarea xmp noembed noframes svg math object select button head audio video canvas".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
LISTS = frozenset("ul ol menu dl table tbody thead tfoot".split())
CONTENT_TAGS = frozenset("article main".split())
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
CONTENT_NAMES = frozenset("article content entry post story main body text".split())
#: Last words of a name that only tell that there is something in the element.
CONTENT_ENDS = frozenset("content body text".split())
NEUTRAL_ENDS = frozenset("area articles bar block box buttons column container group holder icons inner item items links list outer panel posts region row section slot stories unit wrap wrapper zone".split())
STRONG_NAMES = frozenset(
    "ad ads adv advert advertisement advertising adsense sponsor sponsored promo promotion nav navbar navigation navigate menu breadcrumb breadcrumbs sidebar footer comment comments disqus respond reply replies share sharing social related recommended recommendations newsletter subscribe cookie cookies consent gdpr popup overlay pagination pager toolbar masthead copyright notice notices alert modal login signup".split()
)
WEAK_NAMES = frozenset("header banner widget widgets search legal tags topbar disclaimer skip feedback rating ratings".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())

_OTHER, _TAG = r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*>?", r"<(/?)([a-zA-Z][^\s/>]*)"
TOKEN = re.compile(rf"{_OTHER}|{_TAG}((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>", re.S)
#: From the first tag on whose quote or bracket is never closed, tags end at their first bracket, or where the next tag or the page does.
BROKEN_TOKEN = re.compile(rf"{_OTHER}|{_TAG}([^<>]*)>?", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
#: Names that tell what an element has or what state it is in, not what it is.
STATE_NAME = re.compile(r"(?:.*--)?(?:has|with|no)[-_].*|.*[-_](?:open|opened|closed|enabled|disabled)", re.I)
NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Markup(NamedTuple):
    """What the elements around a block say; the innermost of article, boilerplate tag and boilerplate name counts."""

    article: int = 0
    boilerplate: int = 0
    named: int = 0
    hidden: int = 0
    around: int = 0  # boilerplate further out than the innermost article or content name
    weak: int = 0
    content: int = 0


@dataclass
class Element:
    tag: str
    markup: Markup
    number: int
    parent: int  # number of the nearest element around it that isn't inline


@dataclass
class Block:
    markup: Markup
    parent: int
    container: int
    kind: str
    text: str
    linked: int = 0


def judged_name(name: str) -> tuple[int, int, int]:
    """(strong, weak, content) of a class or id, judged whole: by its last word that isn't just a kind of box.

    ``post-comments`` and ``comment-list`` are comments; ``social-history`` is a history, and a
    boilerplate word elsewhere in a name is no more than a weak sign.
    """
    words = [w.lower() for w in NAME_WORDS.findall(name) if len(w) > 1]
    core, ends = words, 0
    while len(core) > 1 and core[-1] in NEUTRAL_ENDS | CONTENT_ENDS:
        ends += core[-1] in CONTENT_ENDS
        core = core[:-1]
    head = core[-1] if core else ""
    if head in STRONG_NAMES and (len(core) == 1 or not ends):
        return 1, 0, 0
    if not STRONG_NAMES.isdisjoint(words):
        return 0, 1, 0
    return 0, int(head in WEAK_NAMES), int(head in CONTENT_NAMES or ends > 0)


def markup_of(tag: str, attributes: str, outer: Markup, in_article: bool) -> Markup:
    """What is said inside an element, given what is said around it."""
    found: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(attributes) if attributes and tag not in ("html", "body") else ():
        found.setdefault(name.lower(), value.strip("\"'"))
    style = found.get("style", "").replace(" ", "").lower()
    hidden = int("hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style)
    role = found.get("role", "").lower()
    names = [n for key in ("class", "id") for n in html.unescape(found.get(key, "")).split() if not STATE_NAME.fullmatch(n)]
    strong, weak, content = (sum(x) for x in zip(*map(judged_name, names))) if names else (0, 0, 0)
    out = outer._replace(hidden=outer.hidden | hidden)
    if strong > content or strong and tag == "article" or weak and not in_article and not content and tag not in CONTENT_TAGS:
        return out._replace(article=0, boilerplate=0, named=1, content=0)
    if tag in BOILERPLATE_TAGS or role in BOILERPLATE_ROLES or tag == "header" and not in_article:
        return out._replace(article=0, boilerplate=1, named=0, content=0)
    if tag in CONTENT_TAGS or role in ("main", "article") or found.get("itemprop", "").lower() == "articlebody":
        return out._replace(article=1, boilerplate=0, named=0, around=int(outer.boilerplate or outer.named or outer.around), weak=weak, content=int(content > 0))
    if content and not weak and (outer.named or outer.boilerplate) and any(len(NAME_WORDS.findall(n)) > 1 for n in names):
        return out._replace(boilerplate=0, named=0, around=1, content=1)
    return out._replace(weak=outer.weak + weak, content=int(outer.content or content > 0))


def page_blocks(page: str) -> list[Block]:
    """Text blocks in page order; scripts, styles, other raw elements and comments have no text.

    One pass: where elements of a name are open is kept by name, so depth costs nothing.
    """
    blocks: list[Block] = []
    stack = [Element("", Markup(), 0, 0)]
    open_at: dict[str, list[int]] = {}
    pieces: list[str] = []
    ends_at: dict[str, int] = {}
    linked = numbers = 0

    def innermost(tags) -> int:
        return max((open_at[t][-1] for t in tags if open_at.get(t)), default=0)

    def end_block() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                last = stack[-1]
                while last.tag in INLINE:
                    last = stack[open_at_block[-1]]
                blocks.append(Block(last.markup, last.number, last.parent, last.tag, text, linked))
            pieces.clear()
        linked = 0

    open_at_block = [0]  # depths of the open elements that aren't inline

    def close(depth: int) -> None:
        while len(stack) > depth:
            gone = stack.pop()
            open_at[gone.tag].pop()
            if open_at_block[-1] == len(stack):
                open_at_block.pop()

    def text_of(raw: str) -> None:
        nonlocal linked
        if raw:
            if "&" in raw:
                raw = html.unescape(raw)
            pieces.append(raw)
            if open_at.get("a"):
                linked += len("".join(raw.split()))

    def raw_end(tag: str, at: int) -> int:
        """Where the raw element ends; -1 if it is never closed."""
        if ends_at.get(tag, at) < at or tag not in ends_at:
            stop = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            ends_at[tag] = stop.end() if stop else len(page) + 1
        return ends_at[tag] if ends_at[tag] <= len(page) else -1

    at, n, token = 0, len(page), TOKEN
    while at < n:
        begin = page.find("<", at)
        if begin < 0:
            text_of(page[at:])
            break
        found = token.match(page, begin)
        if not found and (found := BROKEN_TOKEN.match(page, begin)):
            token = BROKEN_TOKEN
        if not found:  # a bracket of the text
            text_of(page[at : begin + 1])
            at = begin + 1
            continue
        text_of(page[at:begin])
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if found[1]:  # an end tag
            if tag not in INLINE:
                end_block()
            if open_at.get(tag):
                close(open_at[tag][-1])
            continue
        if tag in RAW and not (found[3] or "").endswith("/"):
            if tag not in ("button", "select", "svg", "math"):
                end_block()
            stop = raw_end(tag, at)
            if stop >= 0:
                at = stop
            elif tag in ("script", "style"):
                at = n
            continue
        if tag in VOID:
            if tag == "br":
                pieces.append("\n")
            elif tag == "hr":
                end_block()
            continue
        if tag not in INLINE:
            end_block()
            if tag in CLOSES_P and open_at.get("p"):
                close(open_at["p"][-1])
            if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                same = innermost(("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,))
                if same and same > innermost(LISTS) and (tag not in ("td", "th") or same > innermost(("tr",))):
                    close(same)
        numbers += 1
        in_article = bool(open_at.get("article") or open_at.get("main"))
        above = stack[open_at_block[-1]]
        markup = stack[-1].markup if tag in INLINE and not found[3] else markup_of(tag, found[3] or "", stack[-1].markup, in_article)
        open_at.setdefault(tag, []).append(len(stack))
        if tag not in INLINE:
            open_at_block.append(len(stack))
        stack.append(Element(tag, markup, numbers, above.number))
    end_block()
    return blocks


#: What a block's text says for it, by fixed weights: they label the seeds that the markup weights are fitted on.
TEXT_WEIGHTS = {"bias": -2.2, "link share": -4.0, "words": 0.9, "sentence end": 0.8, "heading": 1.0, "list item": -0.3, "legal mark": -2.0}
#: What markup says before any page is seen: nothing is dropped without a reason.
PRIOR = np.array([2.0, 3.0, -5.5, -6.5, -9.0, -1.0, -1.5, 0.5])
#: Seeds: many words in sentences and no links, or next to nothing but links.
SEED_WORDS, SEED_LINKS = 20, 0.7


def text_features(blocks: list[Block]) -> np.ndarray:
    rows = []
    for b in blocks:
        words = b.text.count(" ") + 1
        rows.append((1.0, min(1.0, b.linked / max(1, len(b.text) - words + 1)), math.log1p(words), b.text[-1] in ".!?\"'”»…", b.kind in ("h1", "h2", "h3", "h4"), b.kind in ("li", "dd", "dt"), "©" in b.text or "®" in b.text))
    return np.array(rows, np.float64).reshape(len(rows), len(TEXT_WEIGHTS))


def markup_features(blocks: list[Block]) -> np.ndarray:
    """The bias, then the fields of Markup."""
    return np.array([(1, *b.markup) for b in blocks], np.float64).reshape(len(blocks), len(PRIOR))


def seeds(blocks: list[Block]) -> tuple[np.ndarray, np.ndarray]:
    """Markup features and labels of the blocks whose text alone is clear, whatever the markup says."""
    if not blocks:
        return np.zeros((0, len(PRIOR))), np.zeros(0, np.int64)
    text = text_features(blocks)
    content = (text[:, 2] >= math.log1p(SEED_WORDS)) & (text[:, 1] == 0) & (text[:, 3] > 0) & (text[:, 6] == 0)
    clear = content | (text[:, 1] >= SEED_LINKS)
    return markup_features(blocks)[clear], content[clear].astype(np.int64)


def fit_markup(x: np.ndarray, y: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Logistic regression by Newton steps, drawn towards PRIOR; both classes weigh the same.

    Text and markup are two views of a block: labels come from the one, weights for the other.
    """
    counts = np.bincount(y, minlength=2) if len(y) else np.zeros(2)
    if not counts.all():
        return PRIOR
    weight = (min(len(y), SEED_WEIGHT) / (2 * counts))[y]
    w = PRIOR.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (y - p)) - (w - PRIOR)
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        w = w + np.linalg.solve(hessian, gradient)
    return w


def smoothness(blocks: list[Block]) -> dict[tuple[int, int], float]:
    """Undirected edges between blocks: adjacency in the text and nearness in the DOM."""
    edges: dict[tuple[int, int], float] = {}
    last_in: dict[tuple[int, Markup], int] = {}
    for i, b in enumerate(blocks):
        if i:
            a = blocks[i - 1]
            edges[i - 1, i] = (NEXT + (SAME_PARENT if a.parent == b.parent else 0)) if a.markup == b.markup else ACROSS + (NEXT if a.container == b.container else 0)
        j = last_in.get((b.container, b.markup))
        if j is not None:
            edges[j, i] = edges.get((j, i), 0) + SAME_CONTAINER
        last_in[b.container, b.markup] = i
    return edges


def minimum_cut(gains: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Content labels of least cost: a label against a node's gain costs its size, a cut edge its capacity.

    A positive gain is the capacity left from the source (content) after what the node can pass
    straight to the sink, a negative one the capacity to the sink. The maximal flow is found in
    phases: distances to the sink first, then a blocking flow along ever nearer nodes. Nodes that
    can still reach the sink are boilerplate; ties go to content.
    """
    n = len(gains)
    left = [round(1000 * g) for g in gains]
    if all(g >= 0 for g in left) or all(g < 0 for g in left):
        return [g >= 0 for g in left]
    heads: list[list[int]] = [[] for _ in range(n)]  # arcs of a node; an arc's reverse is its number xor 1
    to: list[int] = []
    room: list[int] = []
    for (a, b), c in edges.items():
        for x, y in ((a, b), (b, a)):
            heads[x].append(len(to))
            to.append(y)
            room.append(round(1000 * c))
    while True:
        far = [-1] * n
        queue = deque(i for i in range(n) if left[i] < 0)
        for i in queue:
            far[i] = 0
        while queue:
            j = queue.popleft()
            for arc in heads[j]:
                i = to[arc]
                if far[i] < 0 and room[arc ^ 1] > 0:
                    far[i] = far[j] + 1
                    queue.append(i)
        tried = [0] * n
        moved = False
        for source in [i for i in range(n) if left[i] > 0 and far[i] > 0]:
            path: list[int] = []
            at = source
            while left[source] > 0:
                if left[at] < 0:
                    flow = min(left[source], -left[at], *(room[arc] for arc in path))
                    left[source] -= flow
                    left[at] += flow
                    for arc in path:
                        room[arc] -= flow
                        room[arc ^ 1] += flow
                    moved = True
                    path, at = [], source
                    continue
                arcs = heads[at]
                while tried[at] < len(arcs):
                    arc = arcs[tried[at]]
                    if room[arc] > 0 and far[to[arc]] == far[at] - 1:
                        break
                    tried[at] += 1
                if tried[at] < len(arcs):
                    path.append(arc)
                    at = to[arc]
                elif path:
                    at = to[path.pop() ^ 1]
                    tried[at] += 1
                else:
                    break
        if not moved:
            return [f < 0 for f in far]


def label_blocks(blocks: list[Block], weights: np.ndarray = PRIOR) -> list[bool]:
    """Content or not, by the minimum cut; terminals are what text and markup say together."""
    return minimum_cut(block_gains(blocks, weights), smoothness(blocks)) if blocks else []


def block_gains(blocks: list[Block], weights: np.ndarray = PRIOR) -> list[float]:
    """Log-odds of content of each block by itself."""
    said = np.clip(text_features(blocks) @ np.array(list(TEXT_WEIGHTS.values())), -TEXT_LIMIT, TEXT_LIMIT)
    return (said + markup_features(blocks) @ weights).tolist()


def main_text(page: str, weights: np.ndarray = PRIOR) -> str:
    blocks = page_blocks(page)
    return "\n".join(b.text for b, keep in zip(blocks, label_blocks(blocks, weights)) if keep)


def train_markup(pages: DataFrame, limit: int = TRAIN_PAGES) -> np.ndarray:
    """Markup weights from the seed blocks of at most ``limit`` pages."""
    chosen = pages.select("page_id").where("page_id is not null").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(limit)
    rows = pages.select("page_id", "html").join(F.broadcast(chosen), "page_id").select("html")
    # Equal feature rows are counted where they are, so a page sends a few rows whatever its length.
    schema = ", ".join([*(f"x{i} int" for i in range(len(PRIOR))), "y int", "n long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page in batch.column(0).to_pylist():
                x, y = seeds(page_blocks(page or ""))
                found, counts = np.unique(np.column_stack([x, y]).astype(np.int32), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in found.T), pa.array(counts, pa.int64())], [c.split()[0] for c in schema.split(", ")])

    found = rows.mapInArrow(run, schema)
    keys = found.columns[:-1]
    counted = found.groupBy(*keys).agg(F.sum("n").alias("n")).orderBy(*keys).collect()
    data = np.array([r[:-1] for r in counted], np.float64).reshape(len(counted), len(PRIOR) + 1)
    times = np.array([r.n for r in counted], np.int64)
    return fit_markup(np.repeat(data[:, :-1], times, axis=0), np.repeat(data[:, -1], times).astype(np.int64))


def extract_main_text(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> DataFrame:
    """page_id, url, text, n_chars of each page: its main text, blocks joined in page order by one \\n.

    Blocks are labelled by a minimum cut: the classifier's cost of each label is a terminal capacity,
    blocks next to each other or near in the DOM are tied by smoothness edges. The classifier adds
    up a block's text (fixed weights) and the markup around it (weights fitted on blocks of at most
    ``train_pages`` pages whose text alone is clear); neither can decide alone against the other
    and the neighbours. White space inside a block (a line break too) becomes one space and
    character references are decoded; nothing else is dropped or cut. Unclosed quotes end at the
    tag's bracket, unclosed raw elements other than script and style at their own tag. Null and
    empty html give an empty text. Each page stands alone, so repeated rows get equal results; an
    empty table gives no rows; other columns are ignored.
    """
    small_batches(pages.sparkSession)
    weights = train_markup(pages, train_pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            htmls = batch.column(2).to_pylist()
            for a, b in chunks(htmls, lambda t: len(t or "")):
                texts = [main_text(t or "", weights) for t in htmls[a:b]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
                )

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))

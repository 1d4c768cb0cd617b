"""Main text of web pages: a minimum cut separates content blocks from boilerplate."""

import html
import re
from collections import defaultdict, deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.llm.common import by_batch, hashed_sample

# HTML's elements by kind, and words that hint at a block's role.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search "
    "section summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW_TAGS = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN_TAGS = RAW_TAGS | frozenset("head template noscript svg math object select option datalist button".split())
SIDE_TAGS = frozenset("nav aside footer form menu dialog search".split())
MAIN_TAGS = frozenset("article main".split())
CLOSES_P = BLOCK_TAGS - {"html", "body", "head"}
SIDE_WORDS = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|aside|footer|foot|masthead|topbar|"
    r"banner|ads?|advert\w*|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|"
    r"subscri\w*|sign-?up|login|search|share|sharing|social|related|recommend\w*|popular|trending|comments?|"
    r"disqus|repl(?:y|ies)|discussion|respond|pagination|pager|toolbar|widgets?|tags|copyright|legal|skip|"
    r"contentinfo|complementary|form)(?:[\s_\d-]|$)"
)
TOP_WORDS = re.compile(r"(?:^|[\s_-])(?:header|head)(?:[\s_\d-]|$)")  # of the page, unless in the main element
MAIN_WORDS = re.compile(r"(?:^|[\s_-])(?:article|content|post|entry|story|main|maincontent)(?:[\s_-]|$)")
LEGAL = re.compile(r"©|\(c\) \d{4}|all rights reserved|copyright", re.IGNORECASE)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|"
    r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>",
    re.DOTALL,
)
_ROLE = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.IGNORECASE)
_CLOSE = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.IGNORECASE) for t in RAW_TAGS}

FEATURES = 16
HINTS = [10, 11, 12, 13]  # features that say what a block's elements are called


@dataclass
class Block:
    text: str
    link_chars: int
    parent: int  # number of the block element around the one it is in
    depth: int  # open block elements
    common: int  # of these, the ones that the block before is in too
    tag: str
    side_tag: bool
    side_word: bool
    main_tag: bool
    main_word: bool


class _Open:
    """An open element: what a block in it needs to know of it and the elements around it."""

    __slots__ = ("tag", "number", "side_tag", "side_word", "main_tag", "main_word", "unseen", "holder", "parent", "depth")

    def __init__(self, tag, number, parent, attributes):
        self.tag, self.number = tag, number
        role = ""
        if attributes and tag not in ("html", "body"):
            role = " ".join(m.strip("\"'") for m in _ROLE.findall(attributes)).lower()
        top_header = tag == "header" and not (parent and parent.main_tag)
        self.side_tag = bool(parent and parent.side_tag) or tag in SIDE_TAGS or top_header
        self.side_word = bool(parent and parent.side_word) or bool(
            role and (SIDE_WORDS.search(role) or not (parent and parent.main_tag) and TOP_WORDS.search(role))
        )
        self.main_tag = bool(parent and parent.main_tag) or tag in MAIN_TAGS
        self.main_word = bool(parent and parent.main_word) or bool(role and MAIN_WORDS.search(role))
        self.unseen = bool(parent and parent.unseen) or tag in UNSEEN_TAGS
        # of block elements: the nearest one's tag and number, the number of the one around it, how many
        self.holder, self.parent, self.depth = (parent.holder, parent.parent, parent.depth) if parent else (("", 0), 0, 0)
        if tag in BLOCK_TAGS:
            self.holder, self.parent, self.depth = (tag, number), self.holder[1], self.depth + 1


def blocks_of(page: str) -> list[Block]:
    """Runs of text between block elements, in page order, white space collapsed.

    Comments, scripts, styles and other unseen elements are no text. Missing
    end tags are supplied where a new element needs them; a tag that the page's
    end cuts off is dropped.
    """
    found: list[Block] = []
    stack: list[_Open] = []
    opened: defaultdict[str, list[int]] = defaultdict(list)  # places of open elements in the stack by tag
    pieces: list[str] = []
    links = number = link_depth = 0
    lowest = 0  # the fewest open block elements since the last block: those that it shares with the next

    def end_block() -> None:
        nonlocal links, lowest
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                top = stack[-1] if stack else None
                depth = top.depth if top else 0
                found.append(
                    Block(
                        text,
                        links,
                        top.parent if top else 0,
                        depth,
                        min(lowest, depth),
                        top.holder[0] if top else "",
                        bool(top and top.side_tag),
                        bool(top and top.side_word),
                        bool(top and top.main_tag),
                        bool(top and top.main_word),
                    )
                )
                lowest = depth
            pieces.clear()
        links = 0

    def add(raw: str) -> None:
        nonlocal links
        if raw and not (stack and stack[-1].unseen):
            text = html.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if link_depth:
                links += len(text.strip())

    def close(tag: str) -> None:
        nonlocal link_depth, lowest
        if not opened[tag]:
            return
        at = opened[tag][-1]
        above = stack[at - 1].depth if at else 0
        if stack[-1].depth > above:
            end_block()
        while len(stack) > at:
            last = stack.pop()
            opened[last.tag].pop()
            link_depth -= last.tag == "a"
        lowest = min(lowest, above)

    at = 0
    while True:
        token = _TOKEN.search(page, at)
        if token is None:
            rest = page[at:]
            cut = re.search(r"<[a-zA-Z/!?]", rest)
            add(rest[: cut.start()] if cut else rest)
            break
        add(page[at : token.start()])
        at = token.end()
        slash, name, attributes = token.group(1, 2, 3) if token.group(2) else token.group(4, 5, 6)
        if name is None:
            continue
        tag = name.lower()
        if slash:
            if tag in BLOCK_TAGS and not opened[tag]:
                end_block()
            close(tag)
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag in BLOCK_TAGS:
            end_block()
            if tag in CLOSES_P and opened["p"]:
                close("p")
            if tag in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1].tag == tag:
                close(tag)
            if tag == "body" and opened["head"]:
                close("head")
        if tag in VOID_TAGS or attributes.endswith("/") and tag not in BLOCK_TAGS and tag not in RAW_TAGS:
            continue
        if tag in RAW_TAGS:
            end = _CLOSE[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        number += 1
        stack.append(_Open(tag, number, stack[-1] if stack else None, attributes))
        opened[tag].append(len(stack) - 1)
        link_depth += tag == "a"
    end_block()
    return found


def features(found: list[Block]) -> np.ndarray:
    n = len(found)
    x = np.zeros((n, FEATURES))
    for i, b in enumerate(found):
        size = len(b.text)
        words = b.text.count(" ") + 1
        x[i] = (
            1.0,
            np.log1p(size) / 6,
            min(b.link_chars / size, 1.0),
            b.text[-1] in ".!?…\"”»",
            words < 4,
            min(b.text.count(",") / words * 5, 1.0),
            b.tag in ("li", "dd", "dt"),
            b.tag in ("h1", "h2", "h3", "h4", "h5", "h6"),
            b.tag in ("p", "pre", "blockquote"),
            bool(LEGAL.search(b.text)) if size < 300 else False,
            b.side_tag,
            b.side_word,
            b.main_tag,
            b.main_word,
            0.0,
            abs(2 * (i + 0.5) / n - 1),
        )
    if n > 1:
        padded = np.concatenate([x[:1, 2], x[:, 2], x[-1:, 2]])
        x[:, 14] = (padded[:-2] + padded[2:]) / 2
    return x


def hinted_labels(x: np.ndarray) -> np.ndarray:
    """1 inside elements named as main and none named as side matter, 0 inside the latter, -1 unknown."""
    side, main = x[:, 10] + x[:, 11] > 0, x[:, 12] + x[:, 13] > 0
    return np.where(side, 0, np.where(main, 1, -1))


# Log odds of content: what training starts from, and keeps for element names,
# since those are what its labels come from.
START = np.array([-1.5, 2.0, -4.0, 1.0, -0.5, 0.5, -1.0, 0.5, 1.0, -2.0, -7.0, -7.0, 3.0, 1.5, -1.0, -0.5])
NAMES = (-4.0, 3.0)  # bounds of what element names and class words say together
FROM_TEXT = [i for i in range(FEATURES) if i not in HINTS]


def train(x: np.ndarray, y: np.ndarray, ridge: float = 0.01, rounds: int = 30) -> np.ndarray:
    """Logistic regression by Newton steps on what a block's text looks like, drawn towards ``START``."""
    if len(set(y.tolist())) < 2:
        return START.copy()
    seen, start = x[:, FROM_TEXT], START[FROM_TEXT]
    each = 1 / np.where(y == 1, (y == 1).mean(), (y == 0).mean()) / 2 / len(y)
    w = start.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(seen @ w, -30, 30)))
        gradient = seen.T @ (each * (p - y)) + ridge * (w - start)
        hessian = (seen * (each * p * (1 - p))[:, None]).T @ seen + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    weights = START.copy()
    weights[FROM_TEXT] = w
    return weights


def minimum_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay on the source side of the minimum cut.

    ``gain`` is a node's source capacity minus its sink capacity; edges carry
    their weight both ways. Flow is sent along shortest paths from nodes with
    a surplus to nodes with a demand until none is left.
    """
    n = len(gain)
    to, room, out = [], [], [[] for _ in range(n)]
    for a, b, w in edges:
        out[a].append(len(to))
        to.append(b)
        room.append(w)
        out[b].append(len(to))
        to.append(a)
        room.append(w)
    left = list(gain)
    small = 1e-9
    while True:
        level = [0 if g > small else -1 for g in left]
        queue = deque(i for i in range(n) if level[i] == 0)
        reached = False
        while queue:
            a = queue.popleft()
            if left[a] < -small:
                reached = True
                continue
            for e in out[a]:
                if room[e] > small and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if not reached:
            return [v >= 0 for v in level]
        at = [0] * n
        for source in range(n):
            while left[source] > small:
                path, node = [], source
                while left[node] >= -small:
                    while at[node] < len(out[node]):
                        e = out[node][at[node]]
                        if room[e] > small and level[to[e]] == level[node] + 1:
                            break
                        at[node] += 1
                    if at[node] < len(out[node]):
                        path.append(e)
                        node = to[e]
                    elif path:
                        back = path.pop()
                        node = to[back ^ 1]
                        at[node] += 1
                    else:
                        break
                if not path:
                    break
                sent = min(left[source], -left[node], min(room[e] for e in path))
                for e in path:
                    room[e] -= sent
                    room[e ^ 1] += sent
                left[source] -= sent
                left[node] += sent


def content_flags(
    found: list[Block], weights: np.ndarray, smooth: float = 0.5, ceiling: float = 4.0
) -> list[bool]:
    """Label the blocks: classifier costs at the terminals, smoothness between neighbours.

    Consecutive blocks are tied the more, the more elements they share;
    blocks of the same parent are tied to their predecessor there.
    """
    if not found:
        return []
    x = features(found)
    looks = np.clip(x[:, FROM_TEXT] @ weights[FROM_TEXT], -ceiling, ceiling)
    # the costs are the negative logarithms of both classes' probabilities; only their difference counts.
    # Names are one bounded cost: a text that looks like content, among neighbours that do, outvotes them
    names = np.clip(x[:, HINTS] @ weights[HINTS], *NAMES)
    gain = (looks + names).tolist()
    if min(gain) >= 0 or max(gain) < 0:
        return [g >= 0 for g in gain]
    edges, last = [], {}
    for i, b in enumerate(found):
        if i:
            near = 2 * b.common / max(found[i - 1].depth + b.depth, 1)
            edges.append((i - 1, i, smooth * near * near))
        if b.parent in last:
            edges.append((last[b.parent], i, smooth))
        last[b.parent] = i
    return minimum_cut(gain, edges)


def main_text(page: str | None, weights: np.ndarray) -> str:
    found = blocks_of(page or "")
    return "\n".join(b.text for b, keep in zip(found, content_flags(found, weights), strict=True) if keep)


def fit(pages: DataFrame, sample: int = 1_000, page_id: str = "page_id", html: str = "html") -> np.ndarray:
    """Weights from at most ``sample`` pages, drawn by a hash, whose element names tell content and side matter apart."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [features(blocks_of(t)) for t in batch.column(0).to_pylist()]
        flat = [x[hinted_labels(x) >= 0].ravel() for x in rows]
        return pa.RecordBatch.from_arrays([pa.array(flat, pa.list_(pa.float64()))], ["x"])

    texts = pages.select(F.col(page_id).alias("id"), F.col(html).alias("html")).where(F.col("html").isNotNull())
    got = hashed_sample(texts, sample, texts.count(), "id", "html").select("html").mapInArrow(by_batch(make), "x array<double>").toArrow()
    x = got["x"].combine_chunks().flatten().to_numpy().reshape(-1, FEATURES) if got.num_rows else np.zeros((0, FEATURES))
    x = x[np.lexsort(x.T)]  # whatever order the rows came in
    return train(x, hinted_labels(x))


def extract(
    pages: DataFrame, weights: np.ndarray, page_id: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """page_id, url, text (empty if none), n_chars of every row. A null page is empty."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(t, weights) for t in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )

    chosen = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    kind, kind_url = (chosen.schema[c].dataType.simpleString() for c in ("page_id", "url"))
    return chosen.mapInArrow(by_batch(make), f"page_id {kind}, url {kind_url}, text string, n_chars long")

"""Main text of web pages by minimum cut.

A page is cut into text blocks at block-level tags, in time linear in its length. A
classifier (logistic regression on features of the text) and what the surrounding
elements say give each block a cost for being content and one for being boilerplate;
these become capacities to the two terminals, cut off at ``MOST``. Blocks that follow
each other and blocks of the same container are joined by smoothness edges, weaker
where the blocks lie in parts of other roles or in other containers. Inside a container the edges of a block sum
up to more than ``MOST``, so no block is settled by its own cost alone. The minimum
cut between the terminals is the cheapest labelling. The regression is fitted on a
bounded sample of pages whose elements label their blocks; Spark spreads the pages.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.shared import bounded_sample, settings

#: Pages the classifier is fitted on (expected; at most twice as many).
SAMPLE_PAGES = 500
#: What elements say in log odds, bounds of the text's odds and of both together, and edges to the next block and in a container
#: (inside a part and container, and their share across borders): 2 * (NEXT + SAME) > MOST > BOILER - ODDS > 2 * ACROSS * (NEXT + SAME).
BOILER, TAG, WORD, ODDS, MOST, NEXT, SAME, ACROSS = -2.5, 2.0, 1.5, 1.5, 3.0, 1.0, 0.75, 0.2

RAW = "script|style|noscript|template|svg|iframe|select|textarea|head|title|datalist"
#: Up to the sign that ends it a tag has quoted values and anything but ``<``; no step is taken back, so a scan is linear.
TOKEN = re.compile(
    rf"(?P<note><!--)|<[!?][^><]*+>?|<(?:(?P<raw>{RAW})(?![a-zA-Z0-9:-])|(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+))"
    r"(?P<attrs>(?:\"[^\"]*+\"|'[^']*+'|[^<>\"'])*+)|(?P<text>[^<]++|<)", re.I)
LOOSE = re.compile(
    rf"(?P<note><!--)|<[!?][^><]*+>?|<(?:(?P<raw>{RAW})(?![a-zA-Z0-9:-])|(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*+))(?P<attrs>[^<>]*+)"
    r"|(?P<text>[^<]++|<)", re.I)
ATTRIBUTE = re.compile(r"\b(?:class|id|role|aria-label|itemprop)\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>]++)", re.I)
#: Names that tell a state of a page ("has-sidebar"), not the role of the element.
STATE = re.compile(r"^(?:has|with|no|without|is|not|hide|show)[-_]")
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY = {"p": BLOCK_TAGS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"},
             "th": {"td", "th", "tr"}, "option": {"option"}}
BOILER_TAGS = frozenset("nav aside footer form menu dialog fieldset header".split())
CONTENT_TAGS = frozenset("article main".split())
BOILER_WORDS = frozenset(
    "ad ads adv advert advertisement advertisements adverts banner breadcrumb breadcrumbs comment comments commentlist consent cookie "
    "cookies disqus footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notification pager "
    "pagination popup promo recommended related reply replies respond search share sharing sidebar signup skip social sponsor sponsored "
    "subscribe subscription tagcloud toc toolbar topbar widget alert complementary contentinfo".split())
CONTENT_WORDS = frozenset("article articlebody content entry main post story text".split())


@dataclass(eq=False)
class Element:
    tag: str
    parent: Element | None
    depth: int = 0
    block: Element | None = None  # the nearest block element, this one included
    boiler: bool = False
    content: float = 0.0
    inside: bool = False  # in an element of content, or one itself
    above: bool = False  # holds an h1 or main
    first: bool = False  # holds the first element of content
    words: int = 0  # in all its blocks
    said: float = 0.0
    part: Element | None = None  # the nearest element with a role


@dataclass
class Block:
    text: str
    element: Element
    container: Element
    linked: int = 0


def role_words(attrs: str) -> set[str]:
    """Words of the names in class, id, role and the like, names of states left out."""
    names = (n for a in ATTRIBUTE.findall(attrs) for n in a.lower().strip("\"'").split())
    return {w for n in names if not STATE.match(n) for w in re.split(r"[^a-z]+", n)}


def blocks_of(source: str | None) -> list[Block]:
    """Text blocks in page order; references decoded, white space runs one space, ends trimmed, empty ones left out.

    Buttons are text inside running text and nothing by themselves. A script or
    style that is not closed ends with the page, another element whose inside is
    left out at the next block tag. Each position is looked at a bounded number of
    times: failed scans of tags are added up, and beyond the page's length tags
    end at the next ``>`` whatever the quotes.
    """
    root = Element("", None)
    root.block = root
    stack, elements, out = [root], [root], []
    opened: dict[str, int] = {}
    state = {"links": 0, "buttons": 0}
    parts, linked, pressed, wasted, told = [], 0, 0, 0, False

    def flush():
        nonlocal parts, linked, pressed
        text = " ".join("".join(parts).split())
        if text and pressed < len(text.replace(" ", "")):
            own = stack[-1].block
            out.append(Block(text, own, own.parent or own, linked))
        parts, linked, pressed = [], 0, 0

    def close(depth):
        while len(stack) > depth:
            tag = stack.pop().tag
            opened[tag] -= 1
            state["links"] -= tag == "a"
            state["buttons"] -= tag == "button"

    source, at = source or "", 0
    missing: set[str] = set()

    def seek(what, start):
        """Place and end of the next match of a pattern; what is not found once is not there later."""
        found = None if what in missing else re.compile(what, re.I).search(source, start)
        if found is None:
            missing.add(what)
            return None
        return found.span()

    while at < len(source):
        found = (TOKEN if wasted <= len(source) else LOOSE).match(source, at)
        begin, at = at, found.end()
        raw, tag = found["raw"], found["tag"]
        if found["note"]:
            at = (seek("-->", begin + 2) or (0, len(source)))[1]
        elif found["text"] is not None or (raw or tag) and source[at:at + 1] != ">":
            if found["text"] is None:  # a tag that never ends
                wasted += at - begin
                at = begin + 1
            text = html.unescape(source[begin:at])
            parts.append(text)
            linked += len(text) if state["links"] else 0
            pressed += len("".join(text.split())) if state["buttons"] else 0
        elif raw:
            at, name = at + 1, raw.lower()
            if found["attrs"].endswith("/") and name in ("svg", "iframe"):
                continue
            end = seek(rf"</{name}\s*>", at)
            if name == "head":
                body = seek(r"<body\b", at)
                at = body[0] if body and (end is None or body[0] < end[0]) else end[1] if end else at
            elif end:
                at = end[1]
            elif name in ("script", "style"):
                at = len(source)
            else:
                after = seek(BLOCK_START, at)
                at = after[0] if after else len(source)
        elif tag:
            at, tag = at + 1, tag.lower()
            if tag in BLOCK_TAGS:
                flush()
            elif tag == "br":
                parts.append(" ")
            if found["end"]:
                if opened.get(tag):
                    depth = len(stack)
                    while stack[depth - 1].tag != tag:
                        depth -= 1
                    close(depth - 1)
                continue
            if tag in VOID_TAGS:
                continue
            if tag in BLOCK_TAGS:  # end tags that may be left out; at most one of each kind lies on the way
                own = stack[-1].block
                while own.tag in CLOSED_BY:
                    if tag in CLOSED_BY[own.tag]:
                        close(own.depth)
                        break
                    own = own.parent.block
            parent = stack[-1]
            node = Element(tag, parent, len(stack))
            node.block = node if tag in BLOCK_TAGS else parent.block
            if tag not in ("body", "html"):
                words = role_words(found["attrs"]) if found["attrs"] else set()
                node.content = TAG if tag in CONTENT_TAGS else WORD if CONTENT_WORDS.intersection(words) else 0.0
                node.boiler = tag in BOILER_TAGS and not (tag == "header" and parent.inside) or bool(BOILER_WORDS.intersection(words))
            node.inside = parent.inside or node.content > 0
            if tag in ("h1", "main"):
                # A page's header may hold its name; a wrapper with a classy name may hold everything.
                up = parent
                while up is not None and not up.above:
                    up.above, up = True, up.parent
            if not told and (tag == "h1" or node.content) and not node.boiler:
                told, up = True, parent
                while up is not None:
                    up.first, up = True, up.parent
            stack.append(node)
            elements.append(node)
            opened[tag] = opened.get(tag, 0) + 1
            state["links"] += tag == "a"
            state["buttons"] += tag == "button"
    flush()
    for b in out:
        b.element.words += b.text.count(" ") + 1
    for e in reversed(elements[1:]):
        e.parent.words += e.words
    root.part = root
    for e in elements[1:]:  # parents come first
        wrapper = e.tag not in BOILER_TAGS and (e.above or (e.first or not told) and 2 * e.words >= root.words)
        boiler = e.boiler and not wrapper
        e.said = BOILER if boiler or e.parent.said < 0 else e.content or e.parent.said
        e.part = e if boiler or e.content else e.parent.part
    return out


BLOCK_START = rf"</?(?:{'|'.join(sorted(BLOCK_TAGS))})(?![a-zA-Z0-9:-])"


def describe(blocks: list[Block]) -> np.ndarray:
    """Features of the text alone: size, links, punctuation, form, place."""
    rows = []
    for i, b in enumerate(blocks):
        words = b.text.count(" ") + 1
        marks = b.text.count(".") + b.text.count(",") + b.text.count("?")
        rows.append((1.0, np.log1p(words), min(1.0, b.linked / len(b.text)), marks / words, min(12.0, len(b.text) / words) / 6,
                     b.text[-1] in ".!?\"'”", "©" in b.text, b.element.tag in ("li", "td", "dd", "dt"), b.element.tag[:1] == "h" and len(b.element.tag) == 2,
                     i == 0, i == len(blocks) - 1, i / len(blocks)))
    return np.array(rows, float).reshape(len(blocks), 12)


def fit(features: np.ndarray, labels: np.ndarray, rounds: int = 30, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    weights = np.zeros(features.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(features @ weights, -30, 30)))
        hessian = (features * (p * (1 - p))[:, None]).T @ features + ridge * np.eye(len(weights))
        step = np.linalg.solve(hessian, features.T @ (labels - p) - ridge * weights)
        weights += step
        if np.abs(step).max() < 1e-6:
            break
    return weights


def labelled(page: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features of the blocks whose elements say what they are, and what that is."""
    blocks = blocks_of(page)
    said = np.array([b.element.said for b in blocks])
    return describe(blocks)[said != 0], (said[said != 0] > 0).astype(float)


def train(pages: list[str | None]) -> np.ndarray:
    """Weights from pages whose elements say what their blocks are; zeros if none does."""
    rows, labels = zip(*map(labelled, pages)) if pages else ((), ())
    return fit(np.concatenate(rows), np.concatenate(labels)) if sum(map(len, rows)) else np.zeros(12)


def minimum_cut(gain: np.ndarray, edges: list[tuple[int, int, float]]) -> np.ndarray:
    """Labels (content or not) with the smallest sum of costs.

    ``gain`` above 0 is the cost of calling a block boilerplate, below 0 that of
    calling it content; an edge costs its weight if its ends differ. A block whose
    own cost outweighs all its edges keeps its side in every minimum cut and is
    taken out first, its edges becoming terminal capacity of its neighbours; the
    rest is cut by maximum flow along shortest paths.
    """
    n, gain = len(gain), gain.astype(float).copy()
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        if i != j and w > 0:
            near[i][j] = near[i].get(j, 0) + w
            near[j][i] = near[j].get(i, 0) + w
    label, todo = np.zeros(n, int), deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] or abs(gain[i]) <= sum(near[i].values()):
            continue
        label[i] = 1 if gain[i] > 0 else -1
        for j, w in near[i].items():
            gain[j] += label[i] * w
            del near[j][i]
            todo.append(j)
        near[i] = {}
    free = [i for i in range(n) if not label[i]]
    if not free:
        return label > 0
    source, sink = n, n + 1
    room: dict[int, dict[int, float]] = {i: dict(near[i]) for i in free}
    room[source], room[sink] = {}, {}
    for i in free:
        a, b = (source, i) if gain[i] > 0 else (i, sink)
        room[a][b] = room[a].get(b, 0) + abs(gain[i])
        room[b].setdefault(a, 0.0)
    while True:
        # All shortest paths of one length at a time, so long pages take few passes.
        back, queue = {source: 0}, deque([source])
        while queue:
            a = queue.popleft()
            for b, w in room[a].items():
                if w > 1e-12 and b not in back:
                    back[b] = back[a] + 1
                    queue.append(b)
        if sink not in back:
            break
        ways = {a: iter(list(room[a])) for a in back}
        path = [source]
        while path:
            a = path[-1]
            if a == sink:
                flow = min(room[x][y] for x, y in zip(path, path[1:]))
                for x, y in zip(path, path[1:]):
                    room[x][y] -= flow
                    room[y][x] = room[y].get(x, 0) + flow
                full = next(k for k in range(len(path) - 1) if room[path[k]][path[k + 1]] <= 1e-12)
                del path[full + 1:]
                continue
            step = next((b for b in ways[a] if back.get(b) == back[a] + 1 and room[a][b] > 1e-12), None)
            if step is None:
                path.pop()  # nothing more from here; its neighbours' iterators have moved past it
            else:
                path.append(step)
    # Ties: content only where the source still reaches.
    for i in free:
        label[i] = 1 if i in back else -1
    return label > 0


def cut_of(blocks: list[Block], weights: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, float]]]:
    """Costs and edges of a page's blocks."""
    said = np.array([b.element.said for b in blocks])
    odds = describe(blocks) @ weights
    gain = np.clip(np.where(said == 0, odds, said + np.clip(odds, -ODDS, ODDS)), -MOST, MOST)
    edges, last = [], {}
    for i, b in enumerate(blocks):
        for j, weight in ((i - 1, NEXT), (last.get(b.container, -1), SAME)):
            if j >= 0:
                close = blocks[j].element.part is b.element.part and blocks[j].container is b.container
                edges.append((j, i, weight * (1 if close else ACROSS)))
        last[b.container] = i
    return gain, edges


def main_text(source: str | None, weights: np.ndarray) -> str:
    blocks = blocks_of(source)
    if not blocks:
        return ""
    return " ".join(b.text for b, keep in zip(blocks, minimum_cut(*cut_of(blocks, weights))) if keep)


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for page in batch.column("html").to_pylist():
            rows, labels = labelled(page)
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.list_(pa.float64())), pa.array(labels)], ["features", "label"])


def _extract(weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, weights) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])
    return run


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars`` (code points).

    Blocks of content are joined by one space in page order. A null, empty or
    all-boilerplate page has an empty text. The classifier is fitted on
    some ``sample_pages`` pages drawn by hash. Repeated rows
    stay. An empty table gives an empty result. Other columns are ignored.
    """
    source = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"),
                          F.col(f"`{html_col}`").alias("html"))
    known = bounded_sample(source.select("page_id", "html"), sample_pages).mapInArrow(_labelled, "features array<double>, label double").toArrow()
    rows = known.column("features").combine_chunks().flatten().to_numpy().reshape(-1, 12)
    weights = fit(rows, known.column("label").to_numpy()) if len(rows) else np.zeros(12)
    kinds = dict(source.dtypes)
    with settings(pages.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch="500"):
        return source.mapInArrow(_extract(weights), f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")

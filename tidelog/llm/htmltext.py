"""HTML extraction by minimum-cut labelling.

A page is cut into blocks: the text between block-level tags, inline markup dropped, character
references decoded, white space made single and trimmed. Head, scripts, styles, templates, form controls
and comments give no text. A logistic classifier on a block's enclosing elements, the words of their class and id, its links, length and
punctuation gives the cost of labelling it content or boilerplate: its log-odds becomes the capacity from the source or to the
sink. Neighbouring blocks, and blocks that share a parent or grandparent element, are joined by smoothness edges. The
maximum flow from source to sink gives the cheapest labelling: the blocks still reachable from the source are content, joined in page
order by line breaks.

No page is labelled, so the classifier trains itself on a sample (at most ``PAGES`` pages of lowest hash, within
``samples.SAMPLE_CHARS``): blocks whose elements tell what they are (those of an article or a main part without, and any within, an element or class
word of boilerplate) are its examples, once with all features and once with those of their text alone, so that it also learns
what tells them apart where elements say nothing. Weights start from, and are held to, the stated ones by a ridge.

A block whose cost exceeds all its edges has its label from the start. Components of the rest are solved by blocking flows;
one of more than ``RUN`` blocks is first contracted, exactly, at blocks of at most two neighbours, so a page takes time in
proportion to its length. So does reading it: each tag, quote and end tag is searched for once.

A null or empty page has an empty text; broken markup is read as far as it goes (an unclosed element ends
with its parent, a stray end tag is skipped, a quote without its other half ends at white space). Pages of any length are read whole, each independent of
the others, so repeated rows give equal texts; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import samples
from tidelog.llm.common import map_steps

SCHEMA = "page_id long, url string, text string, n_chars long"
#: Elements whose content is no text, those of them that hide markup even if they aren't closed, block-level elements, and elements without end tag.
SILENT = frozenset("head script style noscript template iframe object svg math canvas audio video map select datalist button textarea title".split())
RAW = frozenset("script style iframe textarea title".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul caption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr option".split())
ENDS_ITSELF = frozenset("p li dt dd tr".split())
#: What an element says of its blocks, positive for content.
ELEMENTS = {"article": 6, "main": 4, "p": 1, "h1": 1, "h2": 0.5, "h3": 0.5, "blockquote": 1, "pre": 1, "figure": 0.5, "nav": -12, "header": -4, "footer": -9, "aside": -9, "form": -12, "menu": -9, "dialog": -9, "fieldset": -9, "address": -2, "search": -9}
#: Words of class, id and role attributes.
GOOD_WORDS = frozenset("article content main post entry story body text".split())
BAD_WORDS = frozenset("ad ads advert advertisement adverts banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar side widget related recommended share sharing social comment comments comentarios reply replies disqus respond cookie cookies consent gdpr notice notices popup modal overlay subscribe newsletter signup login form search toolbar pager pagination tags legal copyright disclaimer skip alert complementary contentinfo".split())
#: Stated weights of the features beside the elements: a header inside an article, good and bad words, links, length, shortness, being outside of articles.
OTHERS = {"inner_header": -1.0, "good_word": 2.0, "bad_word": -11.0, "linked": -6.0, "length": 1.0, "short": -0.5, "outside": -1.0, "ended": 0.0, "commas": 0.0, "capitals": 0.0, "digits": 0.0, "bias": 0.0}
NAMES = [*ELEMENTS, *OTHERS]
PLACE = {n: i for i, n in enumerate(NAMES)}
STATED = np.array([*ELEMENTS.values(), *OTHERS.values()], float)
#: Features that an enclosing element gives; those that speak against content; the words of training.
STRUCTURE = len(ELEMENTS) + 3
AGAINST = [i for i in range(STRUCTURE) if STATED[i] < -1]
#: Capacities of edges between neighbours, blocks of one parent and of one grandparent.
NEXT, PARENT, GRANDPARENT = 0.4, 0.8, 0.2
PAGES, RIDGE, EXAMPLES, RUN = 400, 4.0, 100.0, 512

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
GAP = re.compile(r"[\s/]*")
ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*)(\s*=\s*)?")
BARE = re.compile(r"[^\s>]*")
WORDS = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")
HEAD_END = re.compile(r"</head\s*>|<body[\s>]", re.I)
CLOSERS = {t: re.compile(rf"</{t}\s*>", re.I) for t in SILENT}


class _Node:
    """An open element: its parent, nearest block, what it and those around it say, and whether it is a link."""

    __slots__ = ("tag", "parent", "block", "inline", "says", "link", "place", "inside")

    def __init__(self, tag: str, parent: _Node | None, attributes: list[str], place: int):
        self.tag, self.parent, self.place = tag, parent, place
        self.inside = tag in ("article", "main") or bool(parent and parent.inside)
        self.link = tag == "a" or bool(parent and parent.link)
        is_block = tag in BLOCKS or parent is None
        self.block = self if is_block else parent.block
        self.inline: dict[str, int] = {}
        said = "inner_header" if tag == "header" and parent and parent.inside else tag if tag in ELEMENTS else ""
        words = {w for a in attributes for w in WORDS.findall(a.lower())} if attributes else ()
        worded = ""
        if words:
            if words & BAD_WORDS and tag not in ("body", "html", "main", "article"):
                worded = "bad_word"
            elif words & GOOD_WORDS:
                worded = "good_word"
        self.says: tuple[str, ...] = (parent.says if parent else ()) + ((said,) if said else ()) + ((worded,) if worded else ())


class Block:
    __slots__ = ("text", "linked", "node")

    def __init__(self, text: str, linked: float, node: _Node):
        self.text, self.linked, self.node = text, linked, node


class _Reader:
    """Cuts one page into blocks."""

    def __init__(self, page: str):
        self.page, self.out = page, []
        self.node = _Node("", None, [], 0)
        self.parts: list[str] = []
        self.linked, self.places = 0, 1
        self.open: dict[str, int] = {}
        self.absent: set[str] = set()
        self.last = {q: page.rfind(q) for q in "\"'"}

    def close_block(self) -> None:
        if self.parts:
            text = SPACE.sub(" ", html.unescape("".join(self.parts))).strip()
            if text:
                self.out.append(Block(text, min(1.0, self.linked / len(text)), self.node.block))
            self.parts = []
        self.linked = 0

    def add(self, piece: str) -> None:
        self.parts.append(piece)
        if self.node.link:
            self.linked += len(piece.strip())

    def push(self, tag: str, named: list[str]) -> None:
        self.node = _Node(tag, self.node, named, self.places)
        self.places += 1
        if tag in BLOCKS:
            self.open[tag] = self.open.get(tag, 0) + 1
        else:
            held = self.node.block.inline
            held[tag] = held.get(tag, 0) + 1

    def pop(self) -> None:
        node = self.node
        (self.open if node.tag in BLOCKS else node.block.inline)[node.tag] -= 1
        self.node = node.parent

    def pop_to(self, node: _Node) -> None:
        while self.node is not node:
            self.pop()

    def end(self, tag: str) -> None:
        """An end tag closes the nearest open element of its name; an inline one not beyond its block."""
        if (self.open if tag in BLOCKS else self.node.block.inline).get(tag, 0):
            while self.node.tag != tag:
                self.pop()
            self.pop()

    def make_room(self, tag: str) -> None:
        """Elements that end where the next one of their kind, or of another block, begins."""
        held = self.node.block
        if held.tag == "p" and tag != "p" and held.parent.block.tag == tag:
            held = held.parent.block
        if held.tag == tag and held.parent:
            self.pop_to(held.parent)
        elif tag != "li":
            if held.tag == "p":
                held = held.parent.block
            if held.parent:
                self.pop_to(held)

    def attributes(self, at: int) -> tuple[int, list[str], bool]:
        """Where the tag ends, the values of class, id and role, and whether it closes itself; -1 without an end."""
        page, named = self.page, []
        while True:
            gap = GAP.match(page, at)
            at = gap.end()
            if at >= len(page):
                return -1, named, False
            if page[at] == ">":
                return at + 1, named, gap[0].endswith("/")
            m = ATTRIBUTE.match(page, at)
            at = m.end()
            if m[2]:
                quote = page[at : at + 1]
                if quote in self.last and quote and at < self.last[quote]:
                    stop = page.find(quote, at + 1)
                    value, at = page[at + 1 : stop], stop + 1
                else:
                    bare = BARE.match(page, at)
                    value, at = bare[0], bare.end()
                if m[1].lower() in ("class", "id", "role"):
                    named.append(value)

    def blocks(self) -> list[Block]:
        page, at, size = self.page, 0, len(self.page)
        while at < size:
            mark = page.find("<", at)
            if mark < 0:
                self.add(page[at:])
                break
            if mark > at:
                self.add(page[at:mark])
            kind = page[mark + 1 : mark + 2]
            if kind in ("!", "?"):
                closer, skip = ("-->", 4) if page.startswith("<!--", mark) else (">", 2)
                stop = page.find(closer, mark + skip)
                at = size if stop < 0 else stop + len(closer)
                continue
            name = NAME.match(page, mark + 2 if kind == "/" else mark + 1)
            if not name:
                if kind == "/":
                    stop = page.find(">", mark)
                    at = size if stop < 0 else stop + 1
                else:
                    self.add("<")
                    at = mark + 1
                continue
            tag, at = name[0].lower(), name.end()
            if page[at : at + 1] == ">":
                stop, named, closed = at + 1, [], False
            else:
                stop, named, closed = self.attributes(at)
            if stop < 0:
                break
            at = stop
            block = tag in BLOCKS
            if block:
                self.close_block()
            elif tag in ("br", "td", "th", "option"):
                self.parts.append(" ")
            if kind == "/":
                self.end(tag)
            elif tag in SILENT and not closed:
                at = self.past(tag, at)
            elif tag not in VOID and not closed:
                if tag in ENDS_ITSELF or (block and self.node.tag == "p"):
                    self.make_room(tag)
                self.push(tag, named)
        self.close_block()
        return self.out

    def past(self, tag: str, at: int) -> int:
        """The place behind a silent element; an unclosed one that doesn't hide markup is only its tag."""
        if tag in self.absent:
            return at
        end = (HEAD_END if tag == "head" else CLOSERS[tag]).search(self.page, at)
        if end:
            return end.end() if end[0].startswith("</") else end.start()
        if tag in RAW or tag == "head":
            return len(self.page)
        self.absent.add(tag)
        return at


def blocks_of(page: str) -> list[Block]:
    return _Reader(page).blocks()


def features_of(blocks: list[Block]) -> np.ndarray:
    """A row of features a block."""
    out = np.zeros((len(blocks), len(NAMES)))
    for row, b in zip(out, blocks):
        text, n = b.text, len(b.text)
        for s in b.node.says:
            row[PLACE[s]] += 1
        row[STRUCTURE:] = (b.linked, min(n, 300) / 150, n < 25, not b.node.inside, text[-1] in ".!?…", min(1.0, 20 * text.count(",") / n), sum(map(str.isupper, text[:300])) / min(n, 300), sum(map(str.isdigit, text[:300])) / min(n, 300), 1)
    return out


def fit_weights(pages: list[str], _labels: list[int] | None = None) -> np.ndarray:
    """Weights of the features, by maximum a posteriori around the stated ones."""
    x = np.vstack([np.zeros((0, len(NAMES))), *(features_of(blocks_of(p)) for p in pages)])
    against = x[:, AGAINST].sum(axis=1) > 0
    inside = (x[:, PLACE["article"]] + x[:, PLACE["main"]]) > 0
    x, y = x[against | inside], (inside & ~against)[against | inside].astype(float)
    if not len(y) or y.min() == y.max():
        return STATED
    alone = x.copy()
    alone[:, :STRUCTURE] = 0
    alone[:, PLACE["outside"]] = 0
    x, y = np.vstack([x, alone]), np.concatenate([y, y])
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) * EXAMPLES / len(y)  # both classes alike
    w = STATED.copy()
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w)), x.T @ (weight * (p - y)) + RIDGE * (w - STATED))
        w = w - step * min(1.0, 2 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-8:
            break
    return w


def costs_of(blocks: list[Block], weights: np.ndarray = STATED) -> list[float]:
    """Cost of labelling each block boilerplate, less the cost of labelling it content."""
    return (features_of(blocks) @ weights).tolist() if blocks else []


def minimum_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which blocks stay on the source's side. A block's terminal capacity is the size of its cost, from
    the source if positive, else to the sink."""
    n = len(costs)
    cost = [*costs]
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, capacity in edges:
        near[i][j] = near[i].get(j, 0.0) + capacity
        near[j][i] = near[j].get(i, 0.0) + capacity
    label: list[bool | None] = [None] * n
    todo = list(range(n))
    while todo:  # a cost above all edges decides, and pulls at the neighbours
        i = todo.pop()
        if label[i] is None and (not near[i] or abs(cost[i]) > sum(near[i].values()) + 1e-9):
            label[i] = cost[i] > 0
            for j, capacity in near[i].items():
                cost[j] += capacity if label[i] else -capacity
                del near[j][i]
                todo.append(j)
            near[i] = {}
    for start in range(n):
        if label[start] is None:
            part, queue = {start: 0}, [start]
            for i in queue:
                for j in near[i]:
                    if j not in part:
                        part[j] = len(part)
                        queue.append(j)
            for i, keep in zip(part, _component([cost[i] for i in part], [(part[i], part[j], c) for i in part for j, c in near[i].items() if i < j])):
                label[i] = keep
    return [bool(x) for x in label]


def _component(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    if max(costs) <= 0 or min(costs) > 0:
        return [costs[0] > 0] * len(costs)
    return _contracted(costs, edges) if len(costs) > RUN else _max_flow(costs, edges)


def _max_flow(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Blocking flows on shortest paths from positive to negative costs; the side still reached at the end."""
    n, tiny = len(costs), 1e-9
    excess, room = [max(0.0, c) for c in costs], [max(0.0, -c) for c in costs]
    links: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, capacity in edges:
        links[i][j] = links[i].get(j, 0.0) + capacity
        links[j][i] = links[j].get(i, 0.0) + capacity
    while True:
        level = {i: 0 for i in range(n) if excess[i] > tiny}
        queue, found = deque(level), False
        while queue:
            i = queue.popleft()
            if room[i] > tiny:
                found = True
                continue
            for j, capacity in links[i].items():
                if capacity > tiny and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if not found:
            return [i in level for i in range(n)]
        ways = {i: iter(links[i]) for i in level}
        for source in [i for i, d in level.items() if d == 0]:
            path = [source]
            while path and excess[source] > tiny:
                i = path[-1]
                if room[i] > tiny:
                    flow = min(excess[source], room[i], *(links[a][b] for a, b in zip(path, path[1:])))
                    excess[source] -= flow
                    room[i] -= flow
                    cut = len(path)
                    for k, (a, b) in enumerate(zip(path, path[1:])):
                        links[a][b] -= flow
                        links[b][a] = links[b].get(a, 0.0) + flow
                        if links[a][b] <= tiny:
                            cut = min(cut, k + 1)
                    path = path[:cut]
                    continue
                for j in ways[i]:
                    if links[i][j] > tiny and level.get(j) == level[i] + 1:
                        path.append(j)
                        break
                else:
                    path.pop()
                    level[i] = -1  # leads nowhere in this round


def _contracted(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The same minimum: a block of at most two neighbours is replaced by the cheaper of its labels for each of
    theirs, until none is left or all have three or more, for which the flow is found."""
    own = [[max(0.0, c), max(0.0, -c)] for c in costs]
    near: list[dict[int, list[list[float]]]] = [{} for _ in costs]

    def join(i: int, j: int, table: list[list[float]]) -> None:
        old = near[i].get(j)
        if old:
            table = [[old[a][b] + table[a][b] for b in (0, 1)] for a in (0, 1)]
        near[i][j] = table
        near[j][i] = [[table[b][a] for b in (0, 1)] for a in (0, 1)]

    for i, j, c in edges:
        join(i, j, [[0.0, c], [c, 0.0]])
    gone: list[tuple[int, list[int], dict]] = []
    out: list[bool | None] = [None] * len(costs)
    todo = [i for i in range(len(costs)) if len(near[i]) < 3]
    done = [False] * len(costs)
    while todo:
        i = todo.pop()
        if done[i] or len(near[i]) > 2:
            continue
        done[i] = True
        others = [*near[i]]
        choice, best = {}, {}
        for a in (0, 1) if others else (0,):
            for b in (0, 1) if len(others) > 1 else (0,):
                cost = [own[i][x] + (near[i][others[0]][x][a] if others else 0) + (near[i][others[1]][x][b] if len(others) > 1 else 0) for x in (0, 1)]
                choice[a, b], best[a, b] = cost[1] < cost[0] - 1e-12, min(cost)
        for j in others:
            del near[j][i]
        if len(others) == 2:
            join(*others, [[best[a, b] for b in (0, 1)] for a in (0, 1)])
        elif others:
            own[others[0]] = [own[others[0]][a] + best[a, 0] for a in (0, 1)]
        gone.append((i, others, choice))
        near[i] = {}
        todo += [j for j in others if len(near[j]) < 3]
    core = [i for i in range(len(costs)) if not done[i]]
    if core:
        place = {i: k for k, i in enumerate(core)}
        left = [own[i][0] - own[i][1] for i in core]
        links = []
        for i in core:
            for j, ((aa, ab), (ba, bb)) in near[i].items():
                if i < j:  # a table of two labels is costs of each and an edge
                    left[place[i]] += (aa - ba + ab - bb) / 2
                    left[place[j]] += (aa - ab + ba - bb) / 2
                    links.append((place[i], place[j], max(0.0, (ab + ba - aa - bb) / 2)))
        for i, keep in zip(core, _max_flow(left, links)):
            out[i] = keep
    for i, others, choice in reversed(gone):
        a, b = (*(int(out[j]) for j in others), 0, 0)[:2]
        out[i] = choice[a, b]
    return [bool(x) for x in out]


def edges_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Edges to the next block, to the next one of the same parent and of the same grandparent."""
    out, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            out.append((i - 1, i, NEXT))
        up = b.node.parent
        for key, capacity in ((("p", up.place if up else -1), PARENT), (("g", up.parent.place if up and up.parent else -1), GRANDPARENT)):
            if key in last and key[1] >= 0:
                out.append((last[key], i, capacity))
            last[key] = i
    return out


def main_text(page: str, weights: np.ndarray = STATED) -> str:
    blocks = blocks_of(page)
    kept = minimum_cut(costs_of(blocks, weights), edges_of(blocks))
    return "\n".join(b.text for b, keep in zip(blocks, kept) if keep)


def extracted_table(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    weights = samples.fitted(samples.lowest(F.col(f"`{html_col}`"), df, PAGES), fit_weights)
    weights = STATED if weights is None else weights
    pages = df.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("text"))

    def work(part: pa.RecordBatch) -> dict:
        texts = [main_text(t, weights) for t in part.column(2).to_pylist()]
        return {"page_id": part.column(0), "url": part.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

    return map_steps(pages, work, SCHEMA)

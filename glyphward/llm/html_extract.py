"""Operator 6: main text of a page by composite text density.

For every element of the body, with C characters and T tags below it, LC and LT of them in links:

    density = C/T * log(C/LC * T/LT) / log(ln(C/(C-LC) * LC + LCb/Cb * C + e))

where b is the body and zeros among divisors and link counts become 1.  An element's sum is its children's densities added
up.  The element with the greatest sum holds the main text; the least density on its path up to the body is the threshold.
Below the body, in each subtree whose density reaches the threshold, the element with the greatest sum is content; where
that element is the body itself, all of it is.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template xmp iframe noembed noframes".split())
HEAD = frozenset("head meta link base".split())
BLOCK = frozenset(
    "address article aside blockquote body br dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p "
    "pre section table tbody td tfoot th thead tr ul".split()
)
#: An open element of the set ends where a tag of the key begins, unless one of the scope lies between.
_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_ENDS = {"li": frozenset(["li"]), "dd": frozenset(["dd", "dt"]), "dt": frozenset(["dd", "dt"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"])}
_ENDS |= {"th": _ENDS["td"], "option": frozenset(["option"]), "tbody": frozenset(["tbody", "thead", "tr", "td", "th"])}
_SCOPE = frozenset("ul ol dl table body html div article section td th".split())
#: An attribute list whose quotes do not match ends at the next ">".
_TOKEN = re.compile(r"""<(?:!--.*?(?:--!?>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+(?=>)|[^>]*+)>|[!?/][^>]*>?)""", re.S)


def _plain(text: str) -> str:
    return " ".join((html.unescape(text) if "&" in text else text).split())


class Tree:
    """A body's elements in document order: tag, parent, and text pieces (element, text)."""

    def __init__(self) -> None:
        self.tags = ["body"]
        self.parent = [-1]
        self.texts: list[tuple[int, str]] = []


def parse(source: str) -> Tree:
    """Elements below the body.  Scripts, styles, titles, comments and whatever stands in the head are left out."""
    tree = Tree()
    tags, parent, texts = tree.tags, tree.parent, tree.texts
    stack = [0]
    places: dict[str, list[int]] = {}  # of each tag, where it is open in the stack

    def close_from(k: int) -> None:
        for i in stack[k:]:
            places[tags[i]].pop()
        del stack[k:]

    def scope(besides: frozenset | set) -> int:
        return max((places[t][-1] for t in _SCOPE if t not in besides and places.get(t)), default=0)

    at, n = 0, len(source)
    low = None
    find = _TOKEN.search
    while at < n:
        m = find(source, at)
        if m is None:
            texts.append((stack[-1], source[at:]))
            break
        if m.start() > at:
            texts.append((stack[-1], source[at : m.start()]))
        at = m.end()
        name = m.group(2)
        if name is None:
            continue
        name = name.lower()
        if m.group(1):
            if places.get(name):
                close_from(places[name][-1])
            continue
        if name in RAW:
            if low is None:
                low = source.lower() if len(source.lower()) == n else source
            end = low.find(f"</{name}", at)
            end = n if end < 0 else end
            if name == "textarea":
                texts.append((stack[-1], source[at:end]))
            close = source.find(">", end)
            at = n if close < 0 else close + 1
            continue
        if name == "html" or name == "body" or name in HEAD:
            continue
        ends = _ENDS.get(name)
        if ends is not None:
            floor = scope(ends)
            open_ends = [w[bisect_right(w, floor)] for w in (places.get(t) for t in ends) if w and w[-1] > floor]
            if open_ends:
                close_from(min(open_ends))
        elif name in _P and places.get("p") and places["p"][-1] > scope(frozenset()):
            close_from(places["p"][-1])
        tags.append(name)
        parent.append(stack[-1])
        if name not in VOID and not m.group(3).endswith("/"):
            places.setdefault(name, []).append(len(stack))
            stack.append(len(tags) - 1)
    return tree


def densities(tree: Tree) -> tuple[list[float], list[float]]:
    """Density and sum of each element."""
    tags, parent = tree.tags, tree.parent
    n = len(tags)
    chars, links, below, linked = [0] * n, [0] * n, [0] * n, [0] * n
    for i, text in tree.texts:
        chars[i] += len(_plain(text))
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = in_link[parent[i]] or tags[i] == "a"
    for i in range(n):
        if in_link[i]:
            links[i] = chars[i]
    for i in range(n - 1, 0, -1):  # children come after their parents
        p = parent[i]
        chars[p] += chars[i]
        links[p] += links[i]
        below[p] += below[i] + 1
        linked[p] += linked[i] + (tags[i] == "a")
    ratio = links[0] / max(1, chars[0])
    density = [0.0] * n
    for i in range(n):
        c, lc = chars[i], links[i]
        if c:
            t, lt = max(1, below[i]), max(1, linked[i])
            base = math.log(c / max(1, c - lc) * lc + ratio * c + math.e)
            inner = c / max(1, lc) * t / lt
            # a base of 1 would divide by zero; it is the limit of no links at all
            density[i] = c / t * (math.log(inner) / math.log(base) if base > 1 + 1e-9 else math.log(inner) / 1e-9 if inner > 1 else 0.0)
    sums = [0.0] * n
    for i in range(1, n):
        sums[parent[i]] += density[i]
    return density, sums


def content(tree: Tree) -> tuple[list[bool], float]:
    """Which elements are content, and the threshold."""
    tags, parent = tree.tags, tree.parent
    n = len(tags)
    density, sums = densities(tree)
    # of equal sums the first in document order
    best, top = list(range(n)), list(sums)
    for i in range(n - 1, 0, -1):
        p = parent[i]
        if top[i] > top[p] or (top[i] == top[p] and best[i] < best[p]):
            top[p], best[p] = top[i], best[i]
    node = best[0]
    threshold = density[node]
    while node > 0:
        node = parent[node]
        if node > 0:
            threshold = min(threshold, density[node])
    if best[0] == 0:  # no element stands out from the body
        return [True] * n, density[0]
    chosen, inside = [False] * n, [False] * n
    for i in range(1, n):
        inside[i] = inside[parent[i]] or chosen[parent[i]]
        # an element without children has no sum
        if not inside[i] and top[i] > 0 and density[i] >= threshold - 1e-12:
            chosen[best[i]] = True
    for i in range(1, n):
        chosen[i] = chosen[i] or chosen[parent[i]]
    return chosen, threshold


def extract(source: str) -> tuple[str, float]:
    """Main text, a line per block, and the threshold."""
    tree = parse(source)
    full, threshold = content(tree)
    tags, parent = tree.tags, tree.parent
    lines: list[str] = []
    line: list[str] = []
    before = -1
    block_of = [0] * len(tags)
    for i in range(1, len(tags)):
        block_of[i] = i if tags[i] in BLOCK else block_of[parent[i]]
    for i, text in tree.texts:
        if not full[i]:
            continue
        if block_of[i] != before:
            if line:
                lines.append("".join(line))
            line, before = [], block_of[i]
        line.append(html.unescape(text) if "&" in text else text)
    if line:
        lines.append("".join(line))
    cleaned = (" ".join(x.split()) for x in lines)
    return "\n".join(x for x in cleaned if x), threshold


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per row of pages: page_id, text, n_chars, threshold.

    A null html gives null text, n_chars and threshold; an empty one, or one without text, an empty text.  Broken markup is
    read as far as it goes.  Repeated rows and null ids stay; other columns are not read.
    """

    def run(batches):
        for batch in batches:
            texts, sizes, marks = [], [], []
            for source in batch.column("html"):
                source = source.as_py()
                text, t = (None, None) if source is None else extract(source)
                texts.append(text)
                sizes.append(None if text is None else len(text))
                marks.append(t if t is None else float(np.round(t, 6)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), pa.array(texts, pa.string()), pa.array(sizes, pa.int64()), pa.array(marks, pa.float64())],
                names=["page_id", "text", "n_chars", "threshold"],
            )

    return pages.select("page_id", "html").mapInArrow(run, "page_id long, text string, n_chars long, threshold double")

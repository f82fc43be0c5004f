"""Main text of HTML pages by a tree-structured graphical model.

Every element of a page is a node with a hidden label: frame (it may hold the article), text (it is the
article's), or chrome (it is neither, nor is what lies in it). A parent-child potential gives the chances of
an element's label for each label of its parent, from its tag, names, links, text and place on the page; an
element's own text is evidence for its label. Sum-product messages go up from the leaves and down from
the root, which gives each node's exact marginals. All potentials are learned from labelled pages: many
layouts drawn at random, or given ones. No word or tag decides by itself.
"""

from __future__ import annotations

import functools
import html
import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectroloom.llm.html_layouts import SAYINGS, labelled_pages
from spectroloom.llm.html_tree import RAW, Page

#: Labelled layouts that the potentials are fitted on when no pages are given.
LAYOUTS = 3000
#: About how many distinct given pages they are fitted on (twice as many at most, by hash).
SAMPLE_PAGES = 2000
#: Weights of hashed features.
BUCKETS = 1 << 15
#: Steps and rate of the fit, and the weight of its penalty.
STEPS, RATE, PENALTY = 160, 0.15, 2e-5
#: How often a name counts as a feature, which lessens the penalty on its weight.
NAME_WEIGHT = 3
#: The greatest log odds of an element's own text.
MAX_EVIDENCE = 2.0

SCHEMA = "page_id long, url string, text string, n_chars long"

FRAME, TEXT, CHROME = range(3)
LABELS = ("frame", "text", "chrome")

# Elements whose text is no part of any article, and how elements are grouped in features.
SILENT = RAW | frozenset("head select option button label canvas audio video svg dialog".split())
GROUP = {t: g for g, tags in {"box": "div section article main ul ol dl table tbody tr td form aside nav header footer body html center fieldset menu details figure blockquote", "line": "p h1 h2 h3 h4 h5 h6 li dt dd pre figcaption caption th summary address legend", "in": "a b i em strong span code small u s br img sup sub abbr cite q font time mark kbd var tt big del ins"}.items() for t in tags.split()}
#: Words that say what an element has, before a word, or in what state it is, behind one.
HAS = frozenset("has with without no not is category tag".split())
STATES = frozenset("open opened closed on off enabled disabled".split())
_HINTS = frozenset(w for x in SAYINGS.values() for s in x for w in s.replace(".", "").replace("?", "").split())


def _names(group: str, kind: str, names: tuple[tuple[str, ...], ...]) -> Iterator[str]:
    for words in names:
        if words[0] in HAS and len(words) > 1:
            yield f"{kind}has:{group}"
        elif words[-1] in STATES and len(words) > 1:
            yield f"{kind}state:{group}"
        else:
            for w in words:
                yield f"{kind}:{group}:{w}"
            yield f"{kind}end:{group}:{words[-1]}"
            if len(words) > 1:
                yield f"{kind}long:{group}:{words[-1]}"


def _level(x: int) -> int:
    return x and 1 + min(x, 4000).bit_length() // 2


class Nodes:
    """What the model reads of each element of a page."""

    __slots__ = ("keys", "hints", "own", "weight")

    def __init__(self, page: Page) -> None:
        tag, parent, n = page.tag, page.parent, len(page.tag)
        own, linked, ends, inside = [0] * n, [0] * n, [0] * n, [False] * n
        words: list[list[str]] = [[] for _ in range(n)]
        for k in range(1, n):
            inside[k] = tag[k] == "a" or inside[parent[k]]
        for k, text, _ in page.runs:
            size = len(text) - text.count(" ") - text.count("\n")
            if size:
                own[k] += size
                ends[k] += text.count(". ") + text.count("? ") + text.count("! ") + (text.rstrip()[-1:] in ".!?…")
                if inside[k]:
                    linked[k] += size
                if size < 80 and len(words[k]) < 12:
                    words[k] += text.lower().split()[:12]
        silent = [False] * n
        for k in range(1, n):
            silent[k] = tag[k] in SILENT or silent[parent[k]]
            if silent[k]:
                own[k] = linked[k] = ends[k] = 0
        # running text: of elements with sentences or some length, out of links; inline elements count for their blocks
        total, in_links, stops = own[:], linked[:], ends[:]
        heading, special, children = [0] * n, [0] * n, [0] * n
        for k in range(n - 1, 0, -1):
            p = parent[k]
            total[p] += total[k]
            in_links[p] += in_links[k]
            stops[p] += stops[k]
            heading[p] |= heading[k] | (tag[k] == "h1") | (2 if tag[k] in ("h2", "h3", "h4") else 0)
            special[p] |= special[k] | (1 if tag[k] in ("article", "main") else 0) | (2 if tag[k] in ("form", "input", "textarea") else 0)
            children[p] += 1
        prose = [0] * n
        for k in range(n):
            if GROUP.get(tag[k]) != "in" and not inside[k] and (own[k] + (total[k] - own[k] if GROUP.get(tag[k]) == "line" else 0) >= 50 or ends[k] and own[k] >= 25):
                prose[k] = total[k] - in_links[k] if GROUP.get(tag[k]) == "line" else own[k]
        before, seen = [0] * n, 0
        for k in range(n):
            before[k] = seen
            seen += prose[k]
        everything = max(seen, 1)
        for k in range(n - 1, 0, -1):
            prose[parent[k]] += prose[k]
        head = next((k for k in range(n) if tag[k] == "h1"), n)
        last_child: dict[int, int] = {}
        left, right = [""] * n, [""] * n
        same: Counter = Counter()
        for k in range(1, n):
            p = parent[k]
            same[p, tag[k]] += 1
            if p in last_child:
                left[k] = tag[last_child[p]]
                right[last_child[p]] = tag[k]
            last_child[p] = k
        self.keys: list[tuple] = [()] * n
        self.hints: list[list[str]] = words
        self.own: list[tuple[int, bool, bool] | None] = [None] * n
        self.weight = [1.0] * n
        first: dict[int, int] = {}  # of a box, its first heading or line with words
        for k in range(n - 1, 0, -1):
            if words[k]:
                first[parent[k]] = k
            elif k in first:
                first[parent[k]] = first[k]
        for k in range(n):
            p = parent[k]
            if k:
                self.weight[k] = self.weight[p] / same[p, tag[k]]
            if GROUP.get(tag[k]) == "box" and k in first:
                self.hints[k] = words[k] + words[first[k]]
            share = prose[k] / everything
            self.keys[k] = (
                tag[k],
                tag[p] if k else "",
                page.classes[k],
                page.ids[k],
                silent[k],
                _level(own[k]),
                _level(total[k]),
                3 * in_links[k] // max(total[k], 1),
                0 if not prose[k] else 1 + (share > 0.1) + (share > 0.3) + (share > 0.6) + (share > 0.9),
                (before[k] > 0) + (before[k] + prose[k] >= seen) * 2,
                heading[k],
                special[k],
                min(stops[k], 7).bit_length(),
                min(children[k], 7).bit_length(),
                0 if head == n else 1 if k < head else 2,
                left[k],
                right[k],
                min(same[p, tag[k]], 7).bit_length() if k else 0,
            )
            if own[k] and not silent[k]:
                self.own[k] = (_level(own[k]), inside[k], ends[k] > 0)


def _features(key: tuple) -> list[str]:
    tag, above, classes, ids, _, own, total, links, share, place, heading, special, stops, children, head, left, right, same = key
    g = GROUP.get(tag, tag)
    out = [f"t:{tag}", f"pt:{above}>{tag}", f"o:{g}:{own}", f"n:{g}:{total}", f"l:{g}:{links}", f"ln:{g}:{links}:{total}", f"s:{g}:{share}", f"sp:{g}:{share}:{place}", f"p:{g}:{place}", f"h:{g}:{heading}", f"hs:{g}:{heading}:{share}", f"x:{g}:{special}", f"xs:{g}:{special}:{share}", f"e:{g}:{stops}", f"es:{g}:{stops}:{links}:{total > 2}", f"c:{g}:{children}", f"hd:{g}:{head}", f"left:{g}:{left}", f"right:{g}:{right}", f"same:{g}:{same}:{own}", "bias"]
    if not classes and not ids:
        out.append(f"bare:{tag}:{share}")
    names = [*_names(g, "c", classes), *_names(g, "c" if g == "box" else "i", ids)]  # an id is a mere anchor on a line, not on a box
    out += NAME_WEIGHT * names
    return out


def _bucket(feature: str) -> int:
    return zlib.crc32(feature.encode()) % BUCKETS


def _hint_buckets(tag: str, words: list[str]) -> list[int]:
    g = GROUP.get(tag, tag)
    return [_bucket(f"w:{g}:{w}") for w in {x.strip(".,:?!") for x in words} if w in _HINTS]


class TreeModel:
    """Weights of features for each label of an element and its parent, and log odds of elements' own text."""

    def __init__(self, weights: np.ndarray, evidence: dict[tuple | None, tuple[float, float, float]]) -> None:
        # weights: (buckets, 4): a frame's child being frame, text or chrome, and a text's child being text
        self.weights, self.own = weights, evidence
        self.cache: dict[tuple, tuple[float, ...]] = {}

    def given(self, key: tuple, hints: list[str]) -> tuple[tuple[float, float, float], tuple[float, float]]:
        """The chances of an element's labels given that its parent is a frame, and given that it is text."""
        if key[4]:
            return (0.0, 0.0, 1.0), (0.0, 1.0)
        score = self.cache.get(key)
        if score is None:
            score = tuple(self.weights[[_bucket(f) for f in _features(key)]].sum(0).tolist())
            if len(self.cache) < 1 << 16:
                self.cache[key] = score
        a, b, c, t = score
        if hints:
            for at in _hint_buckets(key[0], hints):
                w = self.weights[at]
                a, b, c, t = a + w[0], b + w[1], c + w[2], t + w[3]
        top = max(a, b, c)
        a, b, c = math.exp(a - top), math.exp(b - top), math.exp(c - top)
        s = a + b + c
        t = 1 / (1 + math.exp(-max(-500.0, min(500.0, t))))
        return (a / s, b / s, c / s), (t, 1 - t)

    def evidence(self, own: tuple | None, weight: float) -> tuple[float, float, float]:
        """Likelihoods of an element's own text under each label; like siblings share the weight of one."""
        odds = self.own.get(own)
        return tuple(math.exp(weight * x) for x in odds) if odds else (1.0, 1.0, 1.0)

    def marginals(self, page: Page) -> list[float]:
        """The probability of each element that it is the article's text, by messages up and then down the tree."""
        n, parent = len(page.tag), page.parent
        nodes = Nodes(page)
        given = [self.given(key, hints) for key, hints in zip(nodes.keys, nodes.hints)]
        up = [list(self.evidence(own, w)) for own, w in zip(nodes.own, nodes.weight)]
        to: list[tuple[float, float, float]] = [(1.0, 1.0, 1.0)] * n
        for k in range(n - 1, 0, -1):
            (a, b, c), (t, x) = given[k]
            f, g, h = up[k]
            message = (a * f + b * g + c * h, t * g + x * h, h)
            p = up[parent[k]]
            p[0], p[1], p[2] = p[0] * message[0], p[1] * message[1], p[2] * message[2]
            top = max(p)
            p[0], p[1], p[2] = p[0] / top, p[1] / top, p[2] / top
            to[k] = message
        out, belief = [0.0] * n, [(0.0, 0.0, 0.0)] * n
        for k in range(n):
            (a, b, c), (t, x) = given[k]
            if k:
                # what the parent believes without this child's own message
                q = [v / m if m else 0.0 for v, m in zip(belief[parent[k]], to[k])]
            else:
                q = [1.0, 0.0, 0.0]
            f, g, h = up[k]
            y = (q[0] * a * f, (q[0] * b + q[1] * t) * g, (q[0] * c + q[1] * x + q[2]) * h)
            total = sum(y) or 1.0
            belief[k] = (y[0] / total, y[1] / total, y[2] / total)
            out[k] = belief[k][1]
        return out


def labels(page: Page) -> list[int] | None:
    """Labels by the attribute ``y``, handed down; none if the page has no such attribute. A text without markup is text."""
    if len(page.tag) == 1 and page.runs:
        return [TEXT]
    if not any(page.label):
        return None
    out = [FRAME] * len(page.tag)
    for k in range(1, len(out)):
        above = out[page.parent[k]]
        out[k] = LABELS.index(page.label[k]) if page.label[k] in LABELS else above
        if above == CHROME or above == TEXT and out[k] == FRAME:
            out[k] = above
    return out


def fit(sources: Iterable[str]) -> TreeModel:
    """Potentials from labelled pages: logistic regressions of an element's label for each label of its parent."""
    seen: Counter = Counter()  # how often: features, label of the parent and of the element
    own: Counter = Counter()  # elements' own text, by label
    index: dict[tuple, tuple[int, ...]] = {}
    for source in sources:
        page = Page(source)
        y = labels(page)
        if y is None:
            continue
        nodes = Nodes(page)
        for k, key in enumerate(nodes.keys):
            above = y[page.parent[k]] if k else FRAME
            if not key[4]:
                own[nodes.own[k], y[k]] += 1
            if key[4] or above == CHROME:
                continue
            if key not in index:
                index[key] = tuple(_bucket(f) for f in _features(key))
            seen[(*index[key], *_hint_buckets(key[0], nodes.hints[k])), above, y[k]] += 1
    weights = np.zeros((BUCKETS, 4))
    for above, columns in ((FRAME, (0, 1, 2)), (TEXT, (3,))):
        rows = [(features, y, n) for (features, under, y), n in seen.items() if under == above]
        if rows:
            size = np.array([len(r[0]) for r in rows])
            names, at = np.unique(np.concatenate([r[0] for r in rows]), return_inverse=True)
            times = np.array([r[2] for r in rows], float)
            weights[np.ix_(names, columns)] = _regress(at, np.cumsum(size) - size, size, len(names), np.array([r[1] for r in rows]), times, len(columns))
    total = [sum(n for (_, label), n in own.items() if label == y) for y in range(3)]
    kinds = {o for o, _ in own}
    evidence = {}
    for o in kinds:
        odds = np.log([(own[o, y] + 0.5) / (total[y] + 0.5 * len(kinds)) for y in range(3)])
        odds = np.clip(odds - odds.max(), -MAX_EVIDENCE, 0.0)
        evidence[o] = tuple(odds.tolist())
    return TreeModel(weights.astype(np.float32).astype(np.float64), evidence)


def _regress(at: np.ndarray, start: np.ndarray, size: np.ndarray, n_features: int, target: np.ndarray, times: np.ndarray, n_columns: int) -> np.ndarray:
    """Weights of a logistic regression on rows of feature numbers, by gradient steps of adapted size."""
    w = np.zeros((n_features, n_columns))
    mean, square = np.zeros_like(w), np.zeros_like(w)
    y = (target[:, None] == (np.arange(3) if n_columns == 3 else TEXT)).astype(float)
    for step in range(1, STEPS + 1):
        score = np.add.reduceat(w[at], start, axis=0)
        if n_columns == 3:
            p = np.exp(score - score.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
        else:
            p = 1 / (1 + np.exp(-np.clip(score, -60, 60)))
        error = np.repeat((p - y) * times[:, None], size, axis=0)
        g = np.stack([np.bincount(at, weights=error[:, c], minlength=n_features) for c in range(n_columns)], 1) / times.sum() + PENALTY * w
        mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
        w -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return w


@functools.cache
def built_in_model(n_layouts: int = LAYOUTS) -> TreeModel:
    return fit(labelled_pages(n_layouts))


def main_text(model: TreeModel, source: str) -> str:
    """The content blocks' text: references decoded, white space as one space, blocks joined by two line feeds."""
    page = Page(source)
    content = [p > 0.5 for p in model.marginals(page)]
    blocks: dict[int, list[str]] = {}
    for k, text, block in page.runs:
        if content[k]:
            blocks.setdefault(block, []).append(text)
    texts = (" ".join(html.unescape("".join(parts)).split()) for parts in blocks.values())
    return "\n\n".join(t for t in texts if t)


def fit_tree_model(labelled: DataFrame | None = None, html_column: str = "html", sample_pages: int = SAMPLE_PAGES) -> TreeModel:
    """Potentials from labelled pages, whose elements say by ``y`` whether they are frame, text or chrome.

    Without any, from the layouts drawn here. Of given ones, a sample of about ``sample_pages`` distinct
    pages is taken by hash; null pages, those without a label and repeated ones add nothing, and an empty
    table gives the layouts' model.
    """
    if labelled is None:
        return built_in_model()
    rows = labelled.select(labelled[html_column].cast("string").alias("html")).where("html is not null")
    every = max(1, rows.select(F.xxhash64("html").alias("h")).distinct().count() // sample_pages)
    sample = rows.where(F.pmod(F.xxhash64("html"), F.lit(every)) == 0).distinct().limit(2 * sample_pages)
    pages = sorted(r["html"] for r in sample.collect())
    return fit(pages) if any(labels(Page(p)) for p in pages) else built_in_model()


def extract_text(pages: DataFrame, model: TreeModel | None = None, page_id: str = "page_id", url: str = "url", html_column: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every page from its whole HTML.

    A null or empty page has the empty text. Rows are read on their own: repeated rows and null ids keep
    their rows. ``n_chars`` counts code points.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or built_in_model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(shared.value, source or "") for source in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(pages[page_id].cast("long").alias("page_id"), pages[url].cast("string").alias("url"), pages[html_column].cast("string").alias("html"))
    return rows.mapInArrow(run, SCHEMA)

"""HTML main-text extraction by minimum-cut labelling.

A lenient tokenizer splits a page into blocks of text, each with its open
elements. The network's nodes are the blocks and the elements that say by their
tag, role, class or id what they hold (all that stands outside of them is one
more such element, where a page has an article element). Terminal capacities are
costs: of an element, what its words are worth; of a block, the log odds of a
linear classifier over its length, link share, punctuation and kind. The
classifier is fitted on the blocks that elements of a bounded sample of pages
label (SAMPLE pages at most); without labels of both kinds FALLBACK is used.

Edges are DOM proximity: between a block and the nearest element that says
something, between such an element and the next one above it, between
neighbouring blocks, and more so if they have one parent. What an element says
reaches its text only through those edges. The edge is as strong as the word is
telling: tags, roles and plain words of a class outweigh a single text, while
ambiguous words, words of an id on a heading or section (a slug), and a class
that names both an article and something else have a weak edge, so that there
the texts decide and not the name. A page without any such element is labelled by
its texts and their neighbourhood: a short line amid an article stays, a long one
amid a menu goes. The minimum cut is the labelling of least cost.

Two exact reductions come first: a node whose own cost outweighs all its edges is
labelled and folded into its neighbours, and a node one of whose edges outweighs
all else that it has is merged with that neighbour. The rest is solved by
augmenting paths.

Text of a block: character references decoded, white space runs as one space,
trimmed; line breaks inside a block are white space. Blocks are joined by \\n.

Defined results: a null or empty page, or one without content, has an empty
text; broken markup never fails; repeated rows are extracted each; extra
columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>",
    re.S,
)
_ATTR = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math object canvas select noembed noframes xmp".split())
#: elements that a new sibling of the set closes
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
AWAY_TAGS = frozenset("nav header footer aside form button menu dialog head".split())
MAIN_TAGS = frozenset("article main".split())
AWAY_WORDS = frozenset(
    "ad ads adv advert advertisement advertising banner promo promotion sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs sidebar"
    " footer header masthead topbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login share sharing social"
    " related recommended comment comments reply replies respond disqus widget pagination pager copyright legal disclaimer search".split()
)
#: words of AWAY_WORDS that articles use of their own parts as well
VAGUE_WORDS = frozenset("search legal copyright disclaimer header reply replies respond share alert".split())
#: elements whose ids are slugs of what they are about
SLUGS = frozenset("section h1 h2 h3 h4 h5 h6 p li dt dd figure".split())
MAIN_WORDS = frozenset("article content entry main post story".split())
AWAY_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())

#: costs in nats: of elements that hold boilerplate, of article elements, of words for articles, and of what is outside of articles
W_AWAY, W_ARTICLE, W_MAIN, W_OUTSIDE = -14.0, 16.0, 8.0, -5.0
#: cost of an element whose words are vague, or name an article and something else; the edge to its texts
W_VAGUE, W_BOTH, E_VAGUE = -3.0, 1.0, 2.0
#: a block's own cost is at most this; edges: to its element, of an element to the next above, of neighbours, of neighbours with one parent
MOST, E_OWN, E_ABOVE, E_NEXT, E_PARENT = 4.0, 16.0, 6.0, 1.0, 1.5
SAMPLE, FEATURES = 1024, 5
#: the classifier where nothing is labelled: bias, log length, link share, final punctuation, heading, list item
FALLBACK = (-1.6, 0.8, -4.0, 0.7, 1.0, -0.2)


class _Block:
    __slots__ = ("text", "linked", "element", "parent", "tag")

    def __init__(self, text: str, linked: int, element: int, parent: int, tag: str):
        self.text, self.linked, self.element, self.parent, self.tag = text, linked, element, parent, tag

    def features(self) -> tuple[float, ...]:
        n = len(self.text)
        return math.log1p(n / 8), self.linked / n, float(self.text[-1] in ".!?…»”\"'"), float(self.tag[0] == "h" and self.tag[1:].isdigit()), float(self.tag in ("li", "dt", "dd", "td", "th"))


def _kind(tag: str, attrs: str) -> tuple[bool, bool, float]:
    """Whether an element is boilerplate by its name or words, or the article;
    else what its vague words are worth."""
    away, main, vague = tag in AWAY_TAGS, tag in MAIN_TAGS, 0.0
    if attrs and not attrs.isspace() and tag not in INLINE:
        told: set[str] = set()
        slug: set[str] = set()
        for name, value in _ATTR.findall(attrs):
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id"):
                (slug if name == "id" and tag in SLUGS else told).update(w.lower() for w in _WORDS.findall(value))
            elif name == "role":
                away, main = away or value.lower() in AWAY_ROLES, main or value.lower() == "main"
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
                away = True
        if tag not in ("html", "body"):
            bad, good = told & AWAY_WORDS, not told.isdisjoint(MAIN_WORDS) and tag in ("div", "section", "td")
            if bad and good:
                vague = W_BOTH
            elif bad - VAGUE_WORDS:
                away = True
            elif bad or slug & AWAY_WORDS:
                vague = W_VAGUE
            else:
                main = main or good
    return away, main, vague


def blocks(page: str) -> tuple[list[_Block], list[tuple[float, int, bool]]]:
    """Blocks of visible text in page order, and the elements that say something:
    (cost, the next such element above or -1, whether it is vague)."""
    out: list[_Block] = []
    elements: list[tuple[float, int, bool]] = []
    inside: list[bool] = []  # articles within boilerplate
    text: list[str] = []
    linked, in_link, at, serial = 0, 0, 0, 0
    #: tag, within boilerplate, nearest element that says something, number of the element
    stack: list[tuple[str, bool, int, int]] = [("", False, -1, 0)]
    lower = None

    def flush() -> None:
        nonlocal linked, in_link
        words = " ".join(html.unescape("".join(text)).split()) if text else ""
        if words:
            own = next(x for x in reversed(stack) if x[0] not in INLINE)
            out.append(_Block(words, min(linked, len(words)), own[2], own[3] if own[0] != "p" else stack[max(0, stack.index(own) - 1)][3], own[0] or "body"))
        text.clear()
        linked = 0

    def shut(k: int) -> None:
        nonlocal in_link
        for x in stack[k:]:
            in_link -= x[0] == "a"
        del stack[k:]

    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue  # inside a raw element
        if m.start() > at:
            piece = page[at : m.start()]
            text.append(piece)
            if in_link > 0:
                linked += len(piece.strip())
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    if tag not in INLINE:
                        flush()
                    shut(k)
                    break
                if tag in INLINE and stack[k][0] not in INLINE:
                    break
            continue
        if tag in RAW:
            if tag not in INLINE:
                flush()
            if not m[3].rstrip().endswith("/"):
                lower = lower if lower is not None else page.lower()
                end = lower.find(f"</{tag}", at)
                close = page.find(">", end) if end >= 0 else -1
                at = close + 1 if close >= 0 else len(page)
            continue
        if tag in INLINE:
            if tag == "br":
                text.append(" ")
            elif tag not in VOID:
                if tag == "a":
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] not in INLINE:
                            break
                        if stack[k][0] == "a":
                            shut(k)
                            break
                    in_link += 1
                stack.append((tag, stack[-1][1], stack[-1][2], stack[-1][3]))
            continue
        flush()
        if tag in VOID:
            continue
        k = len(stack)
        while k > 1 and stack[k - 1][0] in INLINE and stack[k - 1][0] != "a":
            k -= 1
        if k < len(stack) and stack[k - 1][0] in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6"):
            shut(k)
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    shut(k)
                    break
                if stack[k][0] not in INLINE:
                    break
        elif tag in CLOSES:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in CLOSES[tag]:
                    shut(k)
                    break
                if stack[k][0] in ("ul", "ol", "dl", "table", "tbody", "thead") or stack[k][0] == "tr" and tag != "tr":
                    break
        away, main, vague = _kind(tag, m[3])
        serial += 1
        _, within, above, _ = stack[-1]
        article = tag in MAIN_TAGS
        #: words for an article say nothing below boilerplate
        cost = W_AWAY if away else W_ARTICLE if article else W_MAIN * (main and not within)
        if cost or vague:
            elements.append((cost or vague, above, not cost))
            inside.append(within and not away)
            above = len(elements) - 1
        stack.append((tag, within or away, above, serial))
    if at < len(page):
        text.append(page[at:])
    flush()
    if any(inside) and any(cost == W_ARTICLE and not x for (cost, _, _), x in zip(elements, inside, strict=True)):
        #: beside an article that stands free, those within boilerplate are parts of it (comments)
        to = []
        for k, (_, above, _) in enumerate(elements):
            to.append((to[above] if above >= 0 else -1) if inside[k] else k)
        for b in out:
            b.element = to[b.element] if b.element >= 0 else -1
        elements = [(cost, to[above] if above >= 0 else -1, vague) for cost, above, vague in elements]
    return out, elements


def network(found: list[_Block], elements: list[tuple[float, int, bool]], weights: tuple[float, ...] = FALLBACK) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Costs of calling nodes boilerplate less those of calling them content, and
    edges: the blocks, then the elements, then what is outside of articles."""
    n, outside = len(found), len(found) + len(elements)
    some = any(cost > 0 and not vague for cost, _, vague in elements)
    own = [max(-MOST, min(MOST, weights[0] + sum(w * x for w, x in zip(weights[1:], b.features(), strict=True)))) for b in found]
    unary = [*own, *(cost for cost, _, _ in elements), *([W_OUTSIDE] if some else [])]
    edges: list[tuple[int, int, float]] = []
    chars: dict[int, int] = {}
    last: dict[int, int] = {}
    homes = [n + b.element if b.element >= 0 else outside if some else -1 for b in found]
    for home, b in zip(homes, found, strict=True):
        chars[home] = chars.get(home, 0) + len(b.text)
    for k, (home, b) in enumerate(zip(homes, found, strict=True)):
        if b.element >= 0 and elements[b.element][2]:
            edges.append((k, home, E_VAGUE))
        elif home >= 0:
            #: the texts of an element weigh no more together than one of them alone
            unary[k] *= len(b.text) / chars[home]
            edges.append((k, home, E_OWN))
        if k:
            edges.append((k - 1, k, E_NEXT))
        if b.parent in last:
            edges.append((last[b.parent], k, E_PARENT))
        last[b.parent] = k
    #: what an element holds pulls at it with E_ABOVE together, however many they are
    below = Counter(above for _, above, _ in elements)
    for k, (_, above, _) in enumerate(elements):
        if above >= 0 or some:
            edges.append((n + k, n + above if above >= 0 else outside, E_ABOVE / below[above]))
    return unary, edges


def labelled(found: list[_Block], elements: list[tuple[float, int, bool]]) -> np.ndarray:
    """Sums over the blocks that an element labels, vague ones aside: for boilerplate and for
    content, the count, the features and their products."""
    out = np.zeros((2, 1 + FEATURES + FEATURES * FEATURES))
    for b in found:
        if b.element >= 0 and not elements[b.element][2]:
            x = np.array(b.features())
            out[int(elements[b.element][0] > 0)] += np.concatenate([[1.0], x, np.outer(x, x).ravel()])
    return out


def fitted(sums: np.ndarray) -> tuple[float, ...]:
    """Bias and weights of the linear discriminant of two classes with one
    covariance; FALLBACK where a class has fewer than 50 blocks."""
    count = sums[:, 0]
    if count.min() < 50:
        return FALLBACK
    mean = sums[:, 1 : 1 + FEATURES] / count[:, None]
    within = sum(sums[k, 1 + FEATURES :].reshape(FEATURES, FEATURES) - count[k] * np.outer(mean[k], mean[k]) for k in (0, 1))
    weights = np.linalg.solve(within / count.sum() + 0.02 * np.eye(FEATURES), mean[1] - mean[0])
    return (float(-weights @ mean.mean(axis=0)), *map(float, weights))


def min_cut(unary: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The labelling that minimises the unary costs of the terminals cut plus
    the weights of the edges cut; True is the source's side (unary > 0)."""
    n = len(unary)
    u, near = list(unary), [dict() for _ in range(n)]
    for i, j, w in edges:
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    label: list[bool | None] = [None] * n
    into = list(range(n))  # the node that a merged one became a part of
    todo, waiting = deque(range(n)), [True] * n

    def again(j: int) -> None:
        if not waiting[j]:
            waiting[j] = True
            todo.append(j)

    while todo:
        i = todo.popleft()
        waiting[i] = False
        if label[i] is not None or into[i] != i:
            continue
        total = sum(near[i].values())
        if abs(u[i]) >= total:
            label[i] = u[i] > 0
            for j, w in near[i].items():
                u[j] += w if label[i] else -w
                del near[j][i]
                again(j)
            near[i] = {}
            continue
        j, most = max(near[i].items(), key=lambda x: x[1])
        if most >= abs(u[i]) + total - most:
            into[i] = j
            u[j] += u[i]
            for k, w in near[i].items():
                del near[k][i]
                if k != j:
                    near[j][k] = near[j].get(k, 0.0) + w
                    near[k][j] = near[k].get(j, 0.0) + w
                    again(k)
            near[i] = {}
            again(j)
    left = [i for i in range(n) if label[i] is None and into[i] == i]
    if left:
        flow = {i: dict(near[i]) for i in left}  # residuals: undirected edges both ways
        supply, demand = {i: max(0.0, u[i]) for i in left}, {i: max(0.0, -u[i]) for i in left}
        while True:
            seen: dict[int, int] = {i: -1 for i in left if supply[i] > 1e-12}
            todo, end = deque(seen), -1
            while todo and end < 0:
                i = todo.popleft()
                for j, c in flow[i].items():
                    if c > 1e-12 and j not in seen:
                        seen[j] = i
                        todo.append(j)
                        if demand[j] > 1e-12:
                            end = j
                            break
            if end < 0:
                for i in left:
                    label[i] = i in seen
                break
            path = [end]
            while seen[path[-1]] >= 0:
                path.append(seen[path[-1]])
            push = min(supply[path[-1]], demand[end], *(flow[b][a] for a, b in zip(path, path[1:], strict=False)))
            supply[path[-1]] -= push
            demand[end] -= push
            for a, b in zip(path, path[1:], strict=False):
                flow[b][a] -= push
                flow[a][b] += push
    for i in range(n):
        if label[i] is None:
            way = [i]
            while label[way[-1]] is None:
                way.append(into[way[-1]])
            for k in way:
                label[k] = label[way[-1]]
    return [bool(x) for x in label]


def main_text(page: str | None, weights: tuple[float, ...] = FALLBACK) -> str:
    """The article of a page."""
    found, elements = blocks(page) if page else ([], [])
    keep = min_cut(*network(found, elements, weights))
    return "\n".join(b.text for b, ok in zip(found, keep, strict=False) if ok)


def learn_weights(pages: DataFrame, sample: int = SAMPLE) -> tuple[float, ...]:
    """The classifier, from the pages of the smallest hash in each of ``sample``
    hash cells of their ids; only sums come to the driver."""
    h = F.xxhash64("page_id", "url")
    rows = pages.select("html", h.alias("h"), F.pmod(F.shiftrightunsigned(h, 33), F.lit(sample)).alias("cell"))
    least = rows.groupBy("cell").agg(F.min("h").alias("h"))
    picked = rows.join(F.broadcast(least), ["cell", "h"]).dropDuplicates(["h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 + FEATURES + FEATURES * FEATURES))
        for b in batches:
            for page in b.column(0):
                if page.as_py():
                    sums += labelled(*blocks(page.as_py()))
        yield pa.RecordBatch.from_arrays([pa.array([sums.ravel().tolist()], pa.list_(pa.float64()))], names=["sums"])

    parts = picked.select("html").mapInArrow(run, "sums array<double>")
    #: added in one order of values, so that reruns agree
    rows = sorted(r.sums for r in parts.collect())
    return fitted(np.sum(np.array(rows), axis=0).reshape(2, -1)) if rows else FALLBACK


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    weights = tuple(round(w, 6) for w in learn_weights(pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py(), weights) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")

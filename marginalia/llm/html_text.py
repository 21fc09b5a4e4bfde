"""Main text of web pages by a recurrent block labeller.

A page becomes a sequence of leaf blocks: runs of text between block-level tags, each with its tag path (tags,
classes, ids and roles of its open elements), its words and its link share. A bidirectional LSTM in numpy reads the
whole sequence and labels every block as main text or not. It is trained here, on the driver, from a bounded sample
of the given pages: their own semantic elements give the labels, and each sampled page is laid out again in many
templates (other elements, class names, added menus, comments, forms, notices) so that a page is judged by its paths,
words and neighbours together.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import schema_of, slices, utf8, without
from marginalia.llm.labelled import sigmoid

#: Elements by role in a page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("script style noscript template svg math iframe object canvas audio video head title select datalist".split())
RAW = set("script style textarea title noscript iframe".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOUNDS = set("article aside body div footer header html main nav section table td ul ol form blockquote".split())
NOT_MAIN = set("nav header footer aside form button menu dialog".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|[^<]+|<", re.S)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PIECES = re.compile(r"[a-z]+|[0-9]+")
_HIDES = re.compile(r"""(?:^|\s)hidden(?=[\s=/>]|$)|display\s*:\s*none""", re.I)


@dataclass
class Block:
    path: tuple[str, ...]  # tags, and names as "#name"
    text: str
    link: float  # share of the characters inside links


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in order, white space collapsed, character references decoded; hidden elements left out."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...], bool]] = []  # tag, its path pieces, hidden
    text: list[str] = []
    linked = links = hidden = 0

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                out.append(Block(tuple(p for _, pieces, _ in stack for p in pieces), joined, min(1.0, linked / len(joined))))
            text.clear()
        linked = 0

    def pop() -> None:
        nonlocal hidden, links
        tag, _, was_hidden = stack.pop()
        hidden -= was_hidden
        links -= tag == "a"

    at, raw = 0, None
    while at < len(page):
        if raw:
            end = re.compile(f"</{raw}(?=[\\s/>]|\\Z)", re.I).search(page, at)
            stop = end.start() if end else len(page)
            if not hidden and stop > at:
                text.append(html.unescape(page[at:stop]))
            at, raw = stop, None
            continue
        match = _TOKEN.match(page, at)
        at = match.end()
        tag = match[2]
        if tag is None:
            piece = match[0]
            if not hidden and (piece == "<" or piece[0] != "<"):
                piece = html.unescape(piece)
                text.append(piece)
                linked += len(piece) if links else 0
            continue
        tag = tag.lower()
        if match[1]:
            if tag not in INLINE:
                flush()
            if tag == "br":
                text.append(" ")
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if tag not in INLINE or not any(s[0] in BOUNDS for s in stack[i + 1 :]):
                        while len(stack) > i:
                            pop()
                    break
                if stack[i][0] in BOUNDS and tag in INLINE | {"p", "li"}:
                    break
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag not in INLINE:
            flush()
        closes = SAME_CLOSES.get(tag, {"p"} if tag in CLOSES_P else ())
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in closes:
                while len(stack) > i:
                    pop()
                break
            if stack[i][0] in BOUNDS:
                break
        if tag in VOID:
            continue
        attributes = match[3]
        pieces = [tag]
        if attributes:
            for m in _NAMES.finditer(attributes):
                pieces += ["#" + x for x in _PIECES.findall((m[2] or m[3] or m[4] or "").lower())]
        if not attributes.rstrip().endswith("/") or tag not in ("svg", "math"):
            hides = tag in HIDDEN or bool(attributes and _HIDES.search(attributes))
            stack.append((tag, tuple(pieces), hides))
            hidden += hides
            links += tag == "a"
        if tag in RAW:
            raw = tag
    flush()
    return out


# -- vectors -----------------------------------------------------------------------------------------------

PATHS, WORDS, SIZE, HIDDEN_SIZE = 1024, 2048, 12, 16
NUMBERS = 5


def _bucket(text: str, n: int) -> int:
    return zlib.crc32(text.encode()) % n


def encode(page: list[Block], cache: dict) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Path counts and word counts of each block as index lists, and its numbers."""
    paths, words = [], []
    numbers = np.zeros((len(page), NUMBERS), np.float32)
    for i, b in enumerate(page):
        known = cache.get(b.path)
        if known is None:
            known = np.array([_bucket(p, PATHS) for p in b.path] or [0], np.int32)
            if len(cache) < 50_000:
                cache[b.path] = known
        paths.append(known)
        split = b.text.lower().split()
        words.append(np.array([_bucket(w, WORDS) for w in split], np.int32))
        numbers[i] = (np.log1p(len(b.text)) / 8, b.link, min(1.0, len(split) / 30), (i + 1) / len(page), b.text[-1] in ".!?:;\"'")
    return paths, words, numbers


class Labeller:
    """Bidirectional LSTM over block vectors: path vector + word vector + numbers -> probability of main text."""

    def __init__(self, seed: int = 3):
        self.learnt = 0  # pages it was trained on
        rng = np.random.default_rng(seed)
        inputs = 2 * SIZE + NUMBERS
        self.p = {
            "path": rng.normal(0, 0.3, (PATHS, SIZE)), "word": rng.normal(0, 0.05, (WORDS, SIZE)),
            "out": rng.normal(0, 0.2, 2 * HIDDEN_SIZE), "bias": np.zeros(1),
        }
        for way in ("f", "b"):
            self.p["x" + way] = rng.normal(0, 0.2, (inputs, 4 * HIDDEN_SIZE))
            self.p["h" + way] = rng.normal(0, 0.2, (HIDDEN_SIZE, 4 * HIDDEN_SIZE))
            self.p["c" + way] = np.concatenate([np.zeros(HIDDEN_SIZE), np.ones(HIDDEN_SIZE), np.zeros(2 * HIDDEN_SIZE)])
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def vectors(self, pages: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        """(time, page, inputs) and the mask of real blocks."""
        longest = max(len(n) for _, _, n in pages)
        x = np.zeros((longest, len(pages), 2 * SIZE + NUMBERS), np.float32)
        mask = np.zeros((longest, len(pages)), np.float32)
        for j, (paths, words, numbers) in enumerate(pages):
            n = len(numbers)
            x[:n, j, :SIZE] = _means(self.p["path"], paths)
            x[:n, j, SIZE : 2 * SIZE] = _means(self.p["word"], words)
            x[:n, j, 2 * SIZE :] = numbers
            mask[:n, j] = 1
        return x, mask

    def _run(self, x: np.ndarray, mask: np.ndarray, way: str, keep: list | None) -> np.ndarray:
        w_h, gates_x, n = self.p["h" + way], x @ self.p["x" + way] + self.p["c" + way], HIDDEN_SIZE
        h = c = np.zeros((x.shape[1], n), np.float32)
        out = np.zeros((*mask.shape, n), np.float32)
        for t in range(len(x)) if way == "f" else range(len(x) - 1, -1, -1):
            z = gates_x[t] + h @ w_h
            s = 1 / (1 + np.exp(-np.clip(z[:, : 3 * n], -30, 30)))
            i, f, o, g = s[:, :n], s[:, n : 2 * n], s[:, 2 * n :], np.tanh(z[:, 3 * n :])
            m = mask[t][:, None]
            new = f * c + i * g
            tanh = np.tanh(new)
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, tanh, m))
            c, h = m * new + (1 - m) * c, m * (o * tanh) + (1 - m) * h
            out[t] = h
        return out

    def raw(self, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        both = [self._run(x, mask, way, None if keep is None else keep.setdefault(way, [])) for way in ("f", "b")]
        states = np.concatenate(both, axis=2)
        if keep is not None:
            keep["states"] = states
        return states @ self.p["out"] + self.p["bias"][0]

    def label(self, pages: list[tuple]) -> list[np.ndarray]:
        """Probability of main text of each block. Pages are read in groups of like length."""
        out: list = [None] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i][2])), key=lambda i: len(pages[i][2]))
        start = 0
        while start < len(order):
            stop, room = start, 60_000
            while stop < len(order) and stop - start < 256 and (stop == start or len(pages[order[stop]][2]) * (stop - start + 1) <= room):
                stop += 1
            part = order[start:stop]
            raw = self.raw(*self.vectors([pages[i] for i in part]))
            for j, i in enumerate(part):
                out[i] = sigmoid(raw[: len(pages[i][2]), j])
            start = stop
        return [np.zeros(0) if x is None else x for x in out]

    def step(self, pages: list[tuple], labels: list[np.ndarray], moments: dict, turn: int, rate: float) -> None:
        """One Adam step on the log loss of a group of pages, by backpropagation through time."""
        keep: dict = {}
        x, mask = self.vectors(pages)
        y = np.zeros_like(mask)
        for j, v in enumerate(labels):
            y[: len(v), j] = v
        error = (sigmoid(self.raw(x, mask, keep)) - y).astype(np.float32) * mask / mask.sum()
        grad = {"out": np.tensordot(error, keep["states"], ((0, 1), (0, 1))), "bias": np.array([error.sum()], np.float32)}
        d_states = error[:, :, None] * self.p["out"]
        d_x = np.zeros_like(x)
        for k, way in enumerate(("f", "b")):
            self._back(x, d_states[:, :, k * HIDDEN_SIZE : (k + 1) * HIDDEN_SIZE], keep[way], way, grad, d_x)
        grad["path"], grad["word"] = np.zeros_like(self.p["path"]), np.zeros_like(self.p["word"])
        for j, (paths, words, _) in enumerate(pages):
            _spread(grad["path"], paths, d_x[: len(paths), j, :SIZE])
            _spread(grad["word"], words, d_x[: len(words), j, SIZE : 2 * SIZE])
        for name, g in grad.items():
            m, v = moments.setdefault(name, [np.zeros_like(self.p[name]), np.zeros_like(self.p[name])])
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            self.p[name] -= rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-7)

    def _back(self, x, d_out, kept, way, grad, d_x) -> None:
        n, w_h, w_x = HIDDEN_SIZE, self.p["h" + way], self.p["x" + way]
        d_h = d_c = np.zeros((x.shape[1], n), np.float32)
        d_z = np.zeros((*x.shape[:2], 4 * n), np.float32)
        g_h = np.zeros_like(w_h)
        for t, h, c, i, f, o, g, tanh, m in reversed(kept):
            d_h = d_h + d_out[t]
            d_new_h, d_new_c = m * d_h, m * d_c
            d_new_c = d_new_c + d_new_h * o * (1 - tanh * tanh)
            z = np.concatenate([d_new_c * g * i * (1 - i), d_new_c * c * f * (1 - f), d_new_h * tanh * o * (1 - o), d_new_c * i * (1 - g * g)], axis=1)
            d_z[t] = z
            g_h += h.T @ z
            d_h = (1 - m) * d_h + z @ w_h.T
            d_c = (1 - m) * d_c + d_new_c * f
        grad["h" + way], grad["x" + way], grad["c" + way] = g_h, np.tensordot(x, d_z, ((0, 1), (0, 1))), d_z.sum(axis=(0, 1))
        d_x += d_z @ w_x.T


def _means(table: np.ndarray, lists: list[np.ndarray]) -> np.ndarray:
    """Mean row of each index list."""
    lengths = np.array([len(x) for x in lists])
    out = np.zeros((len(lists), table.shape[1]), np.float32)
    filled = np.flatnonzero(lengths)
    if len(filled):
        starts = np.cumsum([0, *lengths[filled][:-1]])
        out[filled] = np.add.reduceat(table[np.concatenate([lists[i] for i in filled])], starts) / lengths[filled][:, None]
    return out


def _spread(grad: np.ndarray, lists: list[np.ndarray], d: np.ndarray) -> None:
    lengths = np.array([len(x) for x in lists])
    if lengths.sum():
        np.add.at(grad, np.concatenate(lists), np.repeat(d / np.maximum(lengths, 1)[:, None], lengths, axis=0))


# -- training pages ----------------------------------------------------------------------------------------

PIECE = 1_000  # blocks of a page that are learnt together

#: Common names of page parts, for the layouts the labeller is trained on.
MAIN_NAMES = ["content", "main", "article", "post", "entry content", "story", "article body", "post body", "page content", "text"]
OTHER_PARTS = {
    "menu": [("nav", ""), ("div", "nav"), ("div", "menu"), ("ul", "navigation"), ("div", "navbar"), ("div", "breadcrumb"), ("div", "topbar")],
    "head": [("header", ""), ("div", "header"), ("div", "masthead"), ("div", "site header"), ("div", "banner")],
    "side": [("aside", ""), ("div", "sidebar"), ("div", "widget"), ("div", "related"), ("div", "side column"), ("section", "recommended")],
    "foot": [("footer", ""), ("div", "footer"), ("div", "site footer"), ("div", "copyright"), ("div", "bottom")],
    "notice": [("div", "cookie notice"), ("div", "consent"), ("div", "notice"), ("div", "popup"), ("div", "newsletter"), ("div", "alert"), ("section", "subscribe")],
    "advert": [("div", "ad"), ("div", "ads"), ("div", "advert"), ("div", "sponsored"), ("aside", "promo"), ("div", "advertisement")],
    "form": [("form", ""), ("form", "search"), ("div", "login form"), ("form", "contact")],
    "comments": [("div", "comments"), ("section", "comments"), ("div", "comment list"), ("div", "discussion"), ("ol", "responses"), ("div", "disqus thread"), ("div", "reader comments")],
}


def own_labels(page: list[Block]) -> np.ndarray | None:
    """Labels from a page's own semantic elements: inside article or main and outside of other parts; None without one."""
    inside = [any(p in ("article", "main") for p in b.path) for b in page]
    if not any(inside):
        return None
    return np.array([float(i and not NOT_MAIN.intersection(b.path) and "#comments" not in b.path) for i, b in zip(inside, page, strict=True)])


def relayout(page: list[Block], labels: np.ndarray, rng: np.random.Generator) -> tuple[str, list[bool]]:
    """The blocks of a page in another layout, and whether each is main text."""
    main = [b.text for b, y in zip(page, labels, strict=True) if y]
    other = [b.text for b, y in zip(page, labels, strict=True) if not y]
    words = " ".join([*main, *other]).split() or ["-"]
    parts: list[str] = []
    truth: list[bool] = []

    def phrase(low: int, high: int) -> str:
        n, at = int(rng.integers(low, high)), int(rng.integers(0, len(words)))
        return html.escape(" ".join((words[at:] + words)[:n]))

    def attribute(name: str) -> str:
        if not name:
            return ""
        return f' {rng.choice(["class", "id"])}="{name.replace(" ", rng.choice([" ", "-", "_"]))}"'

    def put(text: str, y: bool, tag: str) -> None:
        parts.append(f"<{tag}>{text}</{tag}>")
        truth.append(y)

    def other_part(kind: str) -> None:
        tag, name = OTHER_PARTS[kind][int(rng.integers(len(OTHER_PARTS[kind])))]
        parts.append(f"<{tag}{attribute(name)}>")
        for _ in range(int(rng.integers(1, 7))):
            if kind in ("menu", "head") or (kind in ("side", "foot") and rng.random() < 0.6):
                put(f'<a href="/x">{phrase(1, 4)}</a>', False, "li" if kind == "menu" else str(rng.choice(["li", "p", "div"])))
            elif kind == "comments":
                put(phrase(3, 60), False, str(rng.choice(["p", "li", "div"])))
            elif kind == "form":
                put(f"<label>{phrase(1, 4)}</label>", False, "p")
            else:
                put(phrase(3, 30), False, str(rng.choice(["p", "div", "h3"])))
        parts.append(f"</{tag}>")

    parts.append("<html><body>")
    wrap = rng.random() < 0.4
    if wrap:
        parts.append('<div class="wrapper">')
    for kind in rng.permutation(["head", "menu", "advert", "notice", "form", "side"])[: int(rng.integers(1, 6))]:
        other_part(str(kind))
    tag = str(rng.choice(["article", "main", "div", "section"], p=[0.4, 0.2, 0.3, 0.1]))
    name = str(rng.choice(MAIN_NAMES)) if tag in ("div", "section") or rng.random() < 0.5 else ""
    if name and rng.random() < 0.35:  # any name may stand on the main part, or none
        name = "".join(rng.choice(list("abcdefghilmnoprstuvw"), int(rng.integers(0, 10))))
    parts.append(f"<{tag}{attribute(name)}>")
    for i, text in enumerate(main):
        put(html.escape(text), True, str(rng.choice(["h1", "h2"])) if i == 0 else str(rng.choice(["p", "p", "p", "p", "div", "li", "blockquote", "h2", "td"])))
        if rng.random() < 0.04:
            other_part(str(rng.choice(["advert", "form", "notice"])))
    nested = rng.random() < 0.25
    if nested:
        other_part("comments")
    parts.append(f"</{tag}>")
    for kind in ["comments"] * (not nested and rng.random() < 0.5) + ["side"] * (rng.random() < 0.5) + ["foot"] * (rng.random() < 0.9):
        other_part(kind)
    parts.append("</div>" if wrap else "")
    parts.append("</body></html>")
    return "".join(parts), truth


def _pieces(code: tuple, labels: np.ndarray) -> list[tuple[tuple, np.ndarray]]:
    """A page in pieces of at most `PIECE` blocks, so that long pages are learnt whole and in bounded memory."""
    return [(tuple(x[at : at + PIECE] for x in code), labels[at : at + PIECE]) for at in range(0, len(labels), PIECE)]


def guessed_labels(page: list[Block]) -> np.ndarray:
    """For pages without semantic elements: blocks of three words and more, outside of other parts and links, pass for main text."""
    other = NOT_MAIN | {"a", "#comments"}
    return np.array([float(len(b.text.split()) >= 3 and not other.intersection(b.path)) for b in page])


def train(pages: list[str], layouts: int = 3, epochs: int = 6, seed: int = 11, *, guess: bool = False) -> Labeller:
    """Labeller trained on the pages that have semantic elements and on `layouts` further layouts of each.

    With `guess` the pages have none: their longer blocks serve as text of generated layouts, whose labels are known,
    and the pages as they are teach nothing.
    """
    rng = np.random.default_rng(seed)
    data: list[tuple[tuple, np.ndarray]] = []
    cache: dict = {}
    learnt = 0
    for page in pages:
        found = blocks(page)
        labels = guessed_labels(found) if guess else own_labels(found)
        if labels is None or not labels.any():
            continue
        learnt += 1
        if not guess:
            data += _pieces(encode(found, cache), labels)
        for _ in range(layouts):
            again, truth = relayout(found, labels, rng)
            fresh = blocks(again)
            if len(fresh) == len(truth):
                data += _pieces(encode(fresh, cache), np.array(truth, float))
    model, moments, turn = Labeller(), {}, 0
    for epoch in range(epochs):
        order = sorted(rng.permutation(len(data)), key=lambda i: len(data[i][1]) // 8)
        groups = [order[a : a + 32] for a in range(0, len(order), 32)]
        for g in rng.permutation(len(groups)):
            turn += 1
            part = [data[i] for i in groups[g]]
            model.step([d for d, _ in part], [y for _, y in part], moments, turn, 0.02 * 0.7**epoch)
    model.learnt = learnt
    return model


def sample(pages: DataFrame, most: int, *, html_col: str = "html", labelled: bool = True, max_bytes: int = 32 << 20) -> list[str]:
    """The `most` different pages with the smallest hash of their html among all that have semantic elements (among all with
    `labelled` off); fewer where their sizes exceed `max_bytes` before.

    The hash space is read in ranges from below, the first expected to hold twice as many pages as needed and each
    further one four times as wide, until enough are found or all pages are read.
    """
    hashed = pages.select(F.col(html_col).alias("html"), F.xxhash64(html_col).alias("hash")).filter(F.octet_length("html") > 0)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "html"):
                yield batch.filter(pa.array([own_labels(blocks(x)) is not None for x in batch.column("html").to_pylist()], pa.bool_()))

    found: list[str] = []
    low, end = -(1 << 63), 1 << 63
    width = (1 << 64) * 2 * most // max(2 * most, hashed.count())
    while low < end and len(found) < most:
        high = min(low + width, end) - 1
        part = hashed.filter(F.col("hash").between(low, high)).groupBy("hash").agg(F.min("html").alias("html"))
        chosen = part.mapInArrow(keep, part.schema) if labelled else part
        for row in chosen.orderBy("hash").limit(most - len(found)).toLocalIterator():
            found.append(row["html"])
            max_bytes -= len(row["html"])
            if max_bytes < 0:
                return found
        low, width = high + 1, width * 4
    return found


def fit(pages: DataFrame, most: int = 200, *, html_col: str = "html") -> Labeller:
    """Train on at most `most` different pages with semantic elements, of any length, those with the smallest hash of
    their html (32 MB of them at most). Where no page has such elements, layouts generated from the text of as many pages
    are learnt instead. An empty table, or one without text, gives a labeller that has learnt nothing (`learnt` is 0)."""
    model = train(sample(pages, most, html_col=html_col))
    return model if model.learnt else train(sample(pages, most, html_col=html_col, labelled=False), guess=True)


def extract(pages: DataFrame, model: Labeller, *, html_col: str = "html") -> DataFrame:
    """`pages` plus text: the main blocks in page order, joined by one space.

    Null and empty html, and pages without main blocks, give an empty text. Whole pages of any length are read; repeated
    rows give the same text. An input column called text is replaced.
    """
    pages = without(pages, "text")
    names = pages.columns
    held = pages.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for whole in batches:
            for batch in slices(whole, "_body"):
                found = [blocks(b.decode("utf-8", "replace")) for b in batch.column("_body").to_pylist()]
                likely = held.value.label([encode(f, cache) for f in found])
                out = [" ".join(b.text for b, p in zip(f, y, strict=True) if p >= 0.5) for f, y in zip(found, likely, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(out, pa.string())], names=[*names, "text"])

    return pages.withColumn("_body", utf8(html_col)).mapInArrow(label, schema_of(pages, text="string"))

"""Toxicity classifier with counterfactual regularisation.

A logistic model over the words of a text and the pairs a group's name makes with its neighbours. For every labelled
text that names a group, its sentences are written again with the group swapped for others of the same kind; where none
is named, names are put into one of its sentences. Training penalises the squared change of the logit, so that naming a
group neither raises nor lowers the score, alone or beside the words around it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from marginalia.llm.common import schema_of, without
from marginalia.llm.labelled import WORD, sample, sigmoid, word_hash

#: Names of groups, by kind and language. Terms of one line are swapped for each other.
IDENTITY_TERMS = [
    ["women", "men", "girls", "boys"],
    ["woman", "man", "girl", "boy"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["black", "white", "asian", "latino", "african", "european"],
    ["gay", "straight", "lesbian", "bisexual", "transgender"],
    ["immigrants", "refugees", "foreigners", "natives", "citizens"],
    ["disabled", "blind", "deaf", "elderly", "young"],
    ["frauen", "männer", "mädchen", "jungen"],
    ["muslime", "christen", "juden", "hindus", "atheisten"],
    ["ausländer", "flüchtlinge", "einwanderer", "einheimische"],
    ["femmes", "hommes", "filles", "garçons"],
    ["musulmans", "chrétiens", "juifs", "hindous", "athées"],
    ["étrangers", "réfugiés", "immigrés", "citoyens"],
    ["mujeres", "hombres", "chicas", "chicos"],
    ["musulmanes", "cristianos", "judíos", "hindúes", "ateos"],
    ["extranjeros", "refugiados", "inmigrantes", "ciudadanos"],
]
_OTHERS = {term: [o for o in line if o != term] for line in IDENTITY_TERMS for term in line}
_NAMES = sorted(_OTHERS)
_SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*")


def swaps(text: str) -> list[str]:
    """The text with the groups of each of its sentences swapped: one version for each of two other terms; none where
    no group is named."""
    lower = text.lower()
    if not any(w in _OTHERS for w in set(WORD.findall(lower))):
        return []

    def turn(n: int) -> str:
        def other(match: re.Match) -> str:
            terms = _OTHERS.get(match[0])
            return terms[n % len(terms)] if terms else match[0]

        return "".join(WORD.sub(other, s) for s in _SENTENCE.findall(lower))

    return [turn(0), turn(1)]


def mentions(text: str) -> list[tuple[str, str]]:
    """(name, version): the text with a group's name put into one of its sentences, for two names; name, sentence and
    place are drawn from a hash of the text. None where a group is named already or no word stands."""
    lower = text.lower()
    words = [m.start() for m in WORD.finditer(lower)]
    if not words or any(w in _OTHERS for w in set(WORD.findall(lower))):
        return []
    out = []
    for n in range(2):
        drawn = xxhash.xxh3_64_intdigest(lower.encode(errors="replace"), seed=n)
        name, at = _NAMES[drawn % len(_NAMES)], words[(drawn >> 16) % len(words)]
        out.append((name, f"{lower[:at]}{name} {lower[at:]}"))
    return out


def features(text: str) -> list[str]:
    """Different lower-cased words of a whole text, and each group's name with the word before and behind it."""
    words = WORD.findall(text.lower())
    found = dict.fromkeys(words)
    if not _OTHERS.keys().isdisjoint(found):
        for left, right in zip(words, words[1:]):
            if left in _OTHERS or right in _OTHERS:
                found[f"{left} {right}"] = None
    return list(found)


def _hashes(text: str) -> np.ndarray:
    found = features(text)
    return np.fromiter((word_hash(w) for w in found), np.uint64, len(found))


class Example(NamedTuple):
    """A labelled text as hashes of its features, with its swapped versions and (hash of the name, version) of the
    versions that a name was put into."""

    label: int
    words: np.ndarray
    swapped: list[np.ndarray]
    inserted: list[tuple[int, np.ndarray]] = []


@dataclass
class Model:
    bias: float
    weights: dict[int, float]

    def score(self, text: str) -> float:
        get = self.weights.get
        raw = self.bias + sum(get(word_hash(w), 0.0) for w in features(text))
        return float(sigmoid(np.array(raw)))


def _chosen(rows: list[Example], least: int, chi2: float, most: int) -> np.ndarray:
    """Hashes of features whose presence depends on the label (chi-square), most dependent first, and all group names."""
    y = np.array([r[0] for r in rows], float)
    words = np.concatenate([r[1] for r in rows]) if rows else np.zeros(0, np.uint64)
    labels = np.repeat(y, [len(r[1]) for r in rows])
    seen, where = np.unique(words, return_inverse=True)
    n, n1, total = len(rows), y.sum(), np.bincount(where, minlength=len(seen)).astype(float)
    both = np.bincount(where, labels, len(seen))
    expected = total * n1 / max(n, 1)
    spread = expected * (1 - n1 / max(n, 1)) * (1 - total / max(n, 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        value = np.where(spread > 0, (both - expected) ** 2 / spread, 0)
    good = np.flatnonzero((total >= least) & (value >= chi2))
    good = good[np.lexsort((seen[good], -value[good]))][:most]
    names = np.array([word_hash(t) for t in _OTHERS], np.uint64)
    return np.union1d(seen[good], names)


def train(
    rows: list[Example], penalty: float = 1.0, epochs: int = 400, rate: float = 0.3, l2: float = 1e-4,
    least: int = 4, chi2: float = 16.0, most: int = 50_000,
) -> Model:
    """Full-batch AdaGrad on log loss + `penalty` * squared changes of the logit between a text and its versions.

    Changes are averaged over all swapped versions, and over the versions of each name that was put in, so that a rare
    name counts as much as a frequent one. Features are words in at least `least` texts whose chi-square with the label
    is `chi2` or more, the `most` best of them, and every group's name.
    """
    rows = [Example(*r) for r in rows]
    words = _chosen(rows, least, chi2, most)

    def table(bags: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
        given = np.concatenate(bags) if bags else np.zeros(0, np.uint64)
        at = np.minimum(np.searchsorted(words, given), len(words) - 1)
        known = words[at] == given
        return row[known], at[known]

    y = np.array([r.label for r in rows], float)
    share = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
    bias, weight = float(np.log(share / (1 - share))), np.zeros(len(words))
    row, at = table([r.words for r in rows])
    pairs = [(r.words, s, 0) for r in rows for s in r.swapped] + [(r.words, s, name) for r in rows for name, s in r.inserted]
    row_a, at_a = table([a for a, _, _ in pairs])
    row_b, at_b = table([b for _, b, _ in pairs])
    _, kind, size = np.unique(np.array([n for _, _, n in pairs], np.uint64), return_inverse=True, return_counts=True)
    pull = 2 * penalty / size[kind] if pairs else np.zeros(0)
    g_b, g_w = 1e-6, np.full(len(words), 1e-6)
    for _ in range(epochs if len(y) else 0):
        error = (sigmoid(bias + np.bincount(row, weight[at], len(y))) - y) / len(y)
        d_w = np.bincount(at, error[row], len(words)) + l2 * weight
        if pairs:
            change = pull * (np.bincount(row_a, weight[at_a], len(pairs)) - np.bincount(row_b, weight[at_b], len(pairs)))
            d_w += np.bincount(at_a, change[row_a], len(words)) - np.bincount(at_b, change[row_b], len(words))
        g_b += error.sum() ** 2
        g_w += d_w**2
        bias -= rate * error.sum() / np.sqrt(g_b)
        weight -= rate * d_w / np.sqrt(g_w)
    return Model(bias, {int(h): float(w) for h, w in zip(words, weight, strict=True) if w})


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = 10_000, penalty: float = 1.0, *, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn from at most `most` labelled documents (whole texts), those with the smallest hash of their id.

    Null labels and ids are left out, a null text counts as empty, several labels of one id count as their majority (a
    tie is 1), and a repeated document counts once per row. Without labels every score is one half.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            put = [mentions(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), pa.array([_hashes(t).tobytes() for t in texts], pa.binary()),
                 pa.array([[_hashes(s).tobytes() for s in swaps(t)] for t in texts], pa.list_(pa.binary())),
                 pa.array([[name for name, _ in p] for p in put], pa.list_(pa.string())),
                 pa.array([[_hashes(s).tobytes() for _, s in p] for p in put], pa.list_(pa.binary()))],
                names=["label", "words", "swapped", "names", "inserted"])

    columns = "label int, words binary, swapped array<binary>, names array<string>, inserted array<binary>"
    rows = sample(docs, labels, label, most, id_col=id_col, text_col=text_col).mapInArrow(extract, columns)
    bits = lambda b: np.frombuffer(b, np.uint64)
    found = [
        Example(r.label, bits(r.words), [bits(s) for s in r.swapped], [(word_hash(n), bits(s)) for n, s in zip(r.names, r.inserted, strict=True)])
        for r in rows.toLocalIterator()]
    return train(sorted(found, key=lambda r: (r.label, r.words.tobytes())), penalty)


def score(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """`docs` plus score (0 to 1). Null and empty texts get the score of no words; long texts are read whole; repeated
    rows score alike. An input column called score is replaced."""
    docs = without(docs, "score")
    names = docs.columns
    held = docs.sparkSession.sparkContext.broadcast(model)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [held.value.score(t or "") for t in batch.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(out, pa.float64())], names=[*names, "score"])

    return docs.mapInArrow(rate, schema_of(docs, score="double"))

"""Toxicity categories by a classifier chain of linear models.

Categories are predicted one after another: model j sees the words of the text
and the probabilities of the categories before it. In training those
probabilities are out of fold (each document's come from models that did not
see it), so later models learn from the same kind of input that they get in
use. Each model is a logistic regression on the presence of words, chosen per
category by chi-square.

The models are fitted on the driver from a bounded sample of labelled documents
(``max_docs`` of at most ``max_doc_bytes`` each); every whole text is scored.

Defined cases: null or empty text scores as a text without words; a category
without two classes in the sample gets its constant share; copies of a text
share a fold; repeated rows give repeated result rows; an empty table gives an
empty result; extra columns are unused.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.labels import labelled_sample

MAX_DOCS = 12_000
MAX_DOC_BYTES = 65_536
WORDS = 1000
LEAST_CHI2 = 12.0
FOLDS = 5
PENALTY = 2e-5
STEPS = 300
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_DROP = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def words_of(text: bytes) -> set[bytes]:
    """Distinct words: A-Z lower-cased, ASCII punctuation taken out, split at ASCII white space."""
    return set(text.translate(_LOWER, _DROP).split())


@dataclass(frozen=True)
class Presence:
    """Which words (numbered) each document has, as parallel arrays sorted by document."""

    words: list[bytes]
    row: np.ndarray
    column: np.ndarray
    docs: int

    def of(self, chosen: np.ndarray) -> Presence:
        """The documents ``chosen`` (a mask), renumbered."""
        kept = chosen[self.row]
        return Presence(self.words, (np.cumsum(chosen) - 1)[self.row[kept]], self.column[kept], int(chosen.sum()))


def presence(texts: Sequence[bytes], least_docs: int = 3) -> Presence:
    """Words of at least ``least_docs`` documents."""
    number: dict[bytes, int] = {}
    found = [np.array([number.setdefault(w, len(number)) for w in words_of(t)], dtype=np.int32) for t in texts]
    column = np.concatenate(found) if found else np.zeros(0, np.int32)
    row = np.repeat(np.arange(len(found)), [len(f) for f in found])
    common = np.bincount(column, minlength=len(number)) >= least_docs
    place = np.cumsum(common) - 1
    kept = common[column]
    words = [w for w, i in number.items() if common[i]]
    return Presence(words, row[kept], place[column[kept]], len(found))


def choose_words(x: Presence, y: np.ndarray, most: int = WORDS, least_chi2: float = LEAST_CHI2) -> np.ndarray:
    """Numbers of the ``most`` words with the largest chi-square against ``y``, all above ``least_chi2``."""
    n, positive = float(x.docs), float(y.sum())
    df = np.bincount(x.column, minlength=len(x.words)).astype(np.float64)
    gap = np.bincount(x.column, weights=y[x.row], minlength=len(x.words)) * n - df * positive
    below = df * (n - df) * positive * (n - positive)
    chi2 = np.where(below > 0, gap * gap * n / np.where(below > 0, below, 1), 0)
    order = sorted(np.flatnonzero(chi2 >= least_chi2).tolist(), key=lambda i: (-chi2[i], x.words[i]))
    return np.array(order[:most], dtype=np.int64)


@dataclass(frozen=True)
class Linear:
    """Word weights, weights of earlier probabilities, and the intercept."""

    words: dict[bytes, float]
    earlier: tuple[float, ...]
    bias: float

    def probability(self, words: set[bytes], earlier: Sequence[float]) -> float:
        z = self.bias + sum(w * p for w, p in zip(self.earlier, earlier))
        z += math.fsum(self.words[w] for w in self.words.keys() & words)
        return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


def fit_linear(x: Presence, earlier: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> Linear:
    """Logistic regression by adaptive gradient steps; constant without two classes."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    if len(y) == 0 or y.min() == y.max():
        return Linear({}, (0.0,) * earlier.shape[1], math.log(share / (1 - share)))
    chosen = choose_words(x, y)
    place = np.full(len(x.words), -1)
    place[chosen] = np.arange(len(chosen))
    kept = place[x.column] >= 0
    row, column = x.row[kept], place[x.column[kept]]
    n, k, m = x.docs, earlier.shape[1], len(chosen)
    balance = np.where(y == 1, 0.5 / y.sum(), 0.5 / (n - y.sum()))
    w, e, bias = np.zeros(m), np.zeros(k), 0.0
    square_w, square_e, square_b = np.full(m, 1e-8), np.full(k, 1e-8), 1e-8
    for _ in range(steps):
        z = np.bincount(row, weights=w[column], minlength=n) + earlier @ e + bias
        gap = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y) * balance
        gw = np.bincount(column, weights=gap[row], minlength=m) + penalty * w
        ge, gb = earlier.T @ gap + penalty * e, gap.sum()
        square_w, square_e, square_b = square_w + gw**2, square_e + ge**2, square_b + gb**2
        w, e, bias = w - 0.5 * gw / np.sqrt(square_w), e - 0.5 * ge / np.sqrt(square_e), bias - 0.5 * gb / math.sqrt(square_b)
    return Linear({x.words[c]: float(v) for c, v in zip(chosen.tolist(), w)}, tuple(e.tolist()), float(bias))


def _probabilities(model: Linear, x: Presence, earlier: np.ndarray) -> np.ndarray:
    weight = np.array([model.words.get(w, 0.0) for w in x.words])
    z = np.bincount(x.row, weights=weight[x.column], minlength=x.docs) + earlier @ np.array(model.earlier) + model.bias
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


@dataclass(frozen=True)
class Chain:
    """Categories in order and their models."""

    categories: tuple[str, ...]
    models: tuple[Linear, ...]

    def probabilities(self, words: set[bytes]) -> list[float]:
        found: list[float] = []
        for model in self.models:
            found.append(model.probability(words, found))
        return found


def fit_chain(sample: list[tuple[bytes, tuple[int, ...]]], categories: Sequence[str], folds: int = FOLDS) -> Chain:
    """Models of the ``categories`` from (text, labels); sample texts are distinct, in hash order."""
    x = presence([t for t, _ in sample])
    labels = np.array([y for _, y in sample], dtype=np.float64).reshape(len(sample), len(categories))
    fold = np.arange(x.docs) % folds
    earlier = np.zeros((x.docs, 0))
    models = []
    for j in range(len(categories)):
        y = labels[:, j]
        models.append(fit_linear(x, earlier, y))
        if j + 1 < len(categories):
            out = np.zeros(x.docs)
            for f in range(folds):
                held = fit_linear(x.of(fold != f), earlier[fold != f], y[fold != f])
                out[fold == f] = _probabilities(held, x.of(fold == f), earlier[fold == f])
            earlier = np.column_stack([earlier, out])
    return Chain(tuple(categories), tuple(models))


def score(docs: DataFrame, labels: DataFrame, categories: dict[str, str], doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5, max_docs: int = MAX_DOCS, max_doc_bytes: int = MAX_DOC_BYTES) -> DataFrame:
    """(doc_id, p_<category>..., <last category> boolean) of every row of ``docs``.

    ``categories`` maps names, in chain order, to SQL expressions over ``labels``
    that give 0 or 1.
    """
    names = list(categories)
    given = labels.select(doc_id, *[F.expr(e).cast("int").alias(n) for n, e in categories.items()])
    chain = fit_chain(labelled_sample(docs, given, names, max_docs, max_doc_bytes, doc_id, text), names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [chain.probabilities(words_of(t.as_py() or b"")) for t in batch.column(1)]
            columns = [pa.array(c, pa.float64()) for c in zip(*found)] or [pa.array([], pa.float64())] * len(names)
            last = pa.array([p[-1] >= threshold for p in found], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, last], ["doc_id", *[f"p_{n}" for n in names], names[-1]])

    schema = ", ".join(["doc_id long", *[f"p_{n} double" for n in names], f"{names[-1]} boolean"])
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(run, schema)

"""Document quality by labelling lines with a linear-chain CRF.

Every line with a word is an element of the chain, described by shape features
(symbols, capitals, bars, repetition, sentence ends). Viterbi decoding marks
each as content or boilerplate, and the content's share of the words decides.

Training: a bounded sample of labelled documents (``max_docs`` of at most
``max_doc_bytes`` each; the fit is the only thing that is sampled). Documents
carry one quality label, lines none, so line labels come in two steps: a
logistic model of single lines learns from the documents' labels; then lines of
good documents count as content, and lines of poor ones as content only if that
model takes them for content. The chain is fitted by gradient ascent on its
conditional log-likelihood (forward-backward in numpy).

Defined cases: null or empty text has zero counts and fails the base rules; a
text without a fitted model (no labels, or one class only) passes on the base
rules alone; ties in decoding go to content; any number of lines is decoded;
repeated rows give repeated result rows; extra columns of ``docs`` pass through
``keep_good`` and are ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.labels import labelled_sample

MAX_DOCS = 4000
MAX_DOC_BYTES = 65_536
MIN_SHARE = 0.5
EPOCHS = 150
RATE = 0.3
PENALTY = 1e-3
#: Beyond so many words windows are compared as numbers (same result, less memory).
_FEW_WORDS = 100_000
_SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\x0b\x0c\r"
N_FEATURES = 14

_CLASS = np.zeros(256, dtype=np.int64)  # byte classes: 1 upper, 2 lower, 3 digit, 4 symbol, 5 other punctuation, 6 beyond ASCII
_CLASS[ord("A"):ord("Z") + 1] = 1
_CLASS[ord("a"):ord("z") + 1] = 2
_CLASS[ord("0"):ord("9") + 1] = 3
for _c in b"!\"'(),-./:;=?@[\\]^_`{}~+":
    _CLASS[_c] = 5
for _c in _SYMBOLS:
    _CLASS[_c] = 4
_CLASS[128:] = 6


@dataclass(frozen=True)
class Base:
    """Counts of one text and whether they fail the base rules."""

    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int

    @property
    def failed(self) -> bool:
        return self.n_words < 10 or 100 * self.n_repeat_words > 20 * self.n_words


def repeat_words(words: list[bytes], width: int = 5) -> int:
    """Words inside ``width``-word windows that occur twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    if n <= _FEW_WORDS:
        windows = list(zip(*(words[i:] for i in range(width))))
        if len(set(windows)) == n:
            return 0
        number: dict[tuple, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in windows), dtype=np.int64, count=n)
    else:  # numbers of words, then of ever longer windows, instead of tuples
        of_word: dict[bytes, int] = {}
        word = np.fromiter((of_word.setdefault(w, len(of_word)) for w in words), dtype=np.int64, count=len(words))
        ids = word[:n]
        for i in range(1, width):
            ids = np.unique(ids * len(of_word) + word[i:i + n], return_inverse=True)[1]
    twice = np.bincount(ids)[ids] > 1
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def base_counts(text: bytes, words: list[bytes], lines: list[bytes]) -> Base:
    """``lines``: those with a word."""
    joined = b"".join(words)
    return Base(
        len(words), len(joined.decode("utf-8", "replace")), sum(text.count(bytes((c,))) for c in _SYMBOLS),
        len(lines) - len(set(lines)), repeat_words(words),
    )


#: Bytes of lines that are counted at once.
_RUN = 1 << 20


def line_features(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(features, words) of each line; lines have a word each."""
    n = len(lines)
    length = np.fromiter(map(len, lines), dtype=np.int64, count=n)
    kinds, words, distinct = np.zeros((n, 7)), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    start = 0
    while start < n:  # runs of lines, so that memory does not follow the text
        end = max(start + 1, int(np.searchsorted(np.cumsum(length[start:start + _RUN]), _RUN, side="right")) + start)
        part = lines[start:end]
        row = np.repeat(np.arange(len(part)), length[start:end] + 1)
        data = np.frombuffer(b"\n".join(part) + b"\n", dtype=np.uint8)
        kinds[start:end] = np.bincount(row * 7 + _CLASS[data], minlength=len(part) * 7).reshape(len(part), 7)
        for i, line in enumerate(part, start):
            split = line.split()
            words[i], distinct[i] = len(split), len(set(split))
        start = end
    seen: set[bytes] = set()
    dup = np.fromiter((line in seen or seen.add(line) is not None for line in lines), dtype=bool, count=n)
    ends = np.fromiter((line.rstrip(_SPACE)[-1:] in (b".", b"!", b"?") for line in lines), dtype=bool, count=n)
    letters = kinds[:, 1] + kinds[:, 2] + kinds[:, 6]
    size = np.maximum(length, 1)
    bars = np.fromiter((line.count(b" | ") for line in lines), dtype=np.int64, count=n)
    bangs = np.fromiter((line.count(b"!!") for line in lines), dtype=np.int64, count=n)
    x = np.zeros((n, N_FEATURES))
    x[:, 0] = 1
    x[:, 1] = np.minimum(kinds[:, 4] / size * 10, 2)
    x[:, 2] = kinds[:, 1] / np.maximum(kinds[:, 1] + kinds[:, 2], 1)
    x[:, 3] = np.minimum(bars / words, 1)
    x[:, 4] = np.minimum(bangs / words, 1)
    x[:, 5] = 1 - distinct / words
    x[:, 6] = dup
    x[:, 7] = ends
    x[:, 8] = np.minimum(kinds[:, 3] / size * 5, 2)
    x[:, 9] = np.minimum(kinds[:, 5] / size * 5, 2)
    x[:, 10] = np.minimum(np.log1p(words) / 4, 2)
    x[:, 11] = words < 4
    x[:, 12] = np.minimum(letters / np.maximum(words, 1) / 10, 2)
    x[:, 13] = (kinds[:, 4] > words * 0.5) | (distinct * 2 < words)
    return x, words


@dataclass(frozen=True)
class Chain:
    """Weights: unary (2, features) and transitions (2, 2); state 1 is content."""

    unary: np.ndarray
    steps: np.ndarray

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best state of each line."""
        scores = (x @ self.unary.T).tolist()
        (s00, s01), (s10, s11) = self.steps.tolist()
        (p0, p1), back = scores[0], []
        for u0, u1 in scores[1:]:
            b0, b1 = p1 + s10 >= p0 + s00, p1 + s11 >= p0 + s01
            p0, p1 = u0 + (p1 + s10 if b0 else p0 + s00), u1 + (p1 + s11 if b1 else p0 + s01)
            back.append((b0, b1))
        state, states = p1 >= p0, []
        for choice in reversed(back):
            states.append(state)
            state = choice[state]
        states.append(state)
        return np.array(states[::-1])


def _padded(chains: list[np.ndarray], fill: float = 0.0) -> np.ndarray:
    out = np.full((len(chains), max(map(len, chains)), *chains[0].shape[1:]), fill)
    for i, c in enumerate(chains):
        out[i, : len(c)] = c
    return out


def likelihood_gradient(unary: np.ndarray, steps: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the summed conditional log-likelihood of padded chains (states -1: padding), by forward-backward."""
    mask = y >= 0
    docs, length, _ = x.shape
    u = x @ unary.T
    forward, backward = np.zeros((docs, length, 2)), np.zeros((docs, length, 2))
    forward[:, 0] = u[:, 0]
    for t in range(1, length):
        step = np.logaddexp.reduce(forward[:, t - 1, :, None] + steps, axis=1) + u[:, t]
        forward[:, t] = np.where(mask[:, t, None], step, forward[:, t - 1])
    for t in range(length - 2, -1, -1):
        step = np.logaddexp.reduce(steps + (u[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
        backward[:, t] = np.where(mask[:, t + 1, None], step, 0)
    total = np.logaddexp.reduce(forward[:, -1], axis=1)
    marginal = np.exp(forward + backward - total[:, None, None]) * mask[:, :, None]
    target = np.stack([y == 0, y == 1], axis=2)
    grad_u, grad_s = np.einsum("dts,dtf->sf", target - marginal, x), np.zeros((2, 2))
    if length > 1:
        both = mask[:, 1:]
        pair = np.exp(forward[:, :-1, :, None] + steps + (u[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None])
        grad_s = np.einsum("dts,dtr->sr", target[:, :-1].astype(float) * both[:, :, None], target[:, 1:].astype(float)) - (pair * both[:, :, None, None]).sum((0, 1))
    return grad_u, grad_s


def fit_chain(features: list[np.ndarray], states: list[np.ndarray], epochs: int = EPOCHS, rate: float = RATE, penalty: float = PENALTY) -> Chain:
    """Full-batch Adagrad on the penalised conditional log-likelihood."""
    order = np.argsort([len(f) for f in features])
    packs = [(_padded([features[i] for i in part]), _padded([states[i] for i in part], -1).astype(np.int64)) for part in np.array_split(order, max(1, len(order) // 256))]
    unary, steps = np.zeros((2, features[0].shape[1])), np.zeros((2, 2))
    square_u, square_s = np.full_like(unary, 1e-6), np.full_like(steps, 1e-6)
    n = sum(map(len, features))
    for _ in range(epochs):
        parts = [likelihood_gradient(unary, steps, x, y) for x, y in packs]
        grad_u = sum(u for u, _ in parts) / n - penalty * unary
        grad_s = sum(s for _, s in parts) / n - penalty * steps
        square_u, square_s = square_u + grad_u**2, square_s + grad_s**2
        unary, steps = unary + rate * grad_u / np.sqrt(square_u), steps + rate * grad_s / np.sqrt(square_s)
    return Chain(unary, steps)


def _line_model(x: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = 200) -> np.ndarray:
    w, square = np.zeros(x.shape[1]), np.full(x.shape[1], 1e-6)
    for _ in range(epochs):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ ((y - p) * weight) / weight.sum() - 1e-3 * w
        square += grad**2
        w += 0.3 * grad / np.sqrt(square)
    return w


def worded_lines(text: bytes) -> list[bytes]:
    return [line for line in text.split(b"\n") if line.strip(_SPACE)]


def fit(sample: list[tuple[bytes, tuple[int, ...]]]) -> Chain | None:
    """The chain learnt from (text, (quality,)) pairs; None without both classes."""
    chains, quality = [], []
    for text, (label, *_) in sample:
        lines = worded_lines(text)
        if lines:
            chains.append(line_features(lines)[0])
            quality.append(label)
    if len(set(quality)) < 2:
        return None
    q = np.array(quality)
    length = np.array([len(c) for c in chains])
    line_q = np.repeat(q, length)
    x = np.concatenate(chains)
    balance = np.where(line_q == 1, 0.5 / max(1, (line_q == 1).sum()), 0.5 / max(1, (line_q == 0).sum()))
    w = _line_model(x, line_q, balance)
    states = []
    for c, label in zip(chains, quality):
        states.append(np.ones(len(c), dtype=np.int64) if label == 1 else (c @ w > 0).astype(np.int64))
    return fit_chain(chains, states)


def _score_batches(chain: Chain | None, min_share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                text = text.as_py() or b""
                lines, words = worded_lines(text), text.split()
                base = base_counts(text, words, lines)
                share, n_content = 1.0, len(lines)
                if chain is not None and lines:
                    x, counts = line_features(lines)
                    content = chain.decode(x)
                    share, n_content = float(counts[content].sum() / counts.sum()), int(content.sum())
                rows.append((base.n_words, base.word_chars, base.n_symbols, base.n_dup_lines, base.n_repeat_words, len(lines), n_content, share, base.failed, not base.failed and share >= min_share))
            arrays = [pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)] if rows else [pa.array([], t) for t in _TYPES]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", *_NAMES])

    return run


_NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_content_lines", "content_share", "base_failed", "kept"]
_TYPES = [pa.int64()] * 7 + [pa.float64(), pa.bool_(), pa.bool_()]
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_content_lines long, content_share double, base_failed boolean, kept boolean"


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality", max_docs: int = MAX_DOCS, max_doc_bytes: int = MAX_DOC_BYTES, min_share: float = MIN_SHARE) -> DataFrame:
    """Counts, content share and verdict of every row of ``docs``."""
    chain = fit(labelled_sample(docs, labels, [quality], max_docs, max_doc_bytes, doc_id, text))
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return plain.mapInArrow(_score_batches(chain, min_share), SCHEMA)


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose text is kept; all their columns."""
    chain = fit(labelled_sample(docs, labels, [options.pop("quality", "quality")], options.pop("max_docs", MAX_DOCS), options.pop("max_doc_bytes", MAX_DOC_BYTES), doc_id, text))
    min_share = options.pop("min_share", MIN_SHARE)
    at = docs.columns.index(text)
    judge = _score_batches(chain, min_share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.binary())
            pairs = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), texts], ["doc_id", "text"])
            for verdict in judge(iter([pairs])):
                yield batch.filter(verdict.column(10))

    return docs.mapInArrow(run, docs.schema)

"""A gated recurrent language model in numpy, with a class-factored output softmax.

Output words 0 .. classes*width-1 (by frequency) form ``classes`` classes of
``width`` words; one more class stands for every other word. A word's
probability is that of its class given the state, times, inside a class of
known words, that of the word given the state; words of the last class get
their share from corpus counts outside this module.

Documents are read side by side in lanes (``Lanes``), in windows of a fixed
number of steps. A lane goes on with the next document where one ends, so a
document of any length takes one lane and its state runs through all its
windows, in scoring and in training (whose gradients end at a window's start).
Where few lanes are left, windows that follow each other in a lane are taken as
one step of as many words as full lanes have: their states come one after
another, all the rest (outputs, gradients, the update) is done for them side by side.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, fields, replace

import numpy as np

#: Logits are held between these, far beyond what biases (log shares) need.
LOGITS = np.float32(-60), np.float32(80)


@dataclass
class Weights:
    """Parameters, in single precision."""

    embed: np.ndarray  # (words + 2, d): known words, other words, start
    wx: np.ndarray  # (d, 3h): update, reset, candidate
    wh: np.ndarray  # (h, 3h)
    b: np.ndarray  # (3h,)
    wc: np.ndarray  # (h, classes + 1)
    bc: np.ndarray
    ww: np.ndarray  # (classes, h, width)
    bw: np.ndarray  # (classes, width)

    def vector(self) -> np.ndarray:
        return np.concatenate([getattr(self, f.name).ravel() for f in fields(self)]).astype(np.float64)

    def from_vector(self, v: np.ndarray) -> Weights:
        out, at = [], 0
        for f in fields(self):
            shape = getattr(self, f.name).shape
            size = int(np.prod(shape))
            out.append(v[at:at + size].reshape(shape).astype(np.float32))
            at += size
        return Weights(*out)

    def zeros(self) -> Weights:
        return Weights(*[np.zeros_like(getattr(self, f.name)) for f in fields(self)])


def initial(counts: np.ndarray, other: int, classes: int, width: int, d: int, h: int, seed: int = 7) -> Weights:
    """Random recurrent weights; output biases are log frequencies, so training starts from the class unigram.

    ``counts``: training counts of the known words in order (padded with zeros), ``other``: of all other words.
    """
    r = np.random.default_rng(seed)

    def random(*shape: int, scale: float) -> np.ndarray:
        return (r.standard_normal(shape) * scale).astype(np.float32)

    by_class = np.append(counts.reshape(classes, width).sum(1), other) + 0.5
    return Weights(
        random(classes * width + 2, d, scale=0.3), random(d, 3 * h, scale=d**-0.5), random(h, 3 * h, scale=h**-0.5), np.zeros(3 * h, np.float32),
        random(h, classes + 1, scale=0.01), _log_shares(by_class[None])[0].astype(np.float32),
        random(classes, h, width, scale=0.01), _log_shares((counts + 0.5).reshape(classes, width)).astype(np.float32),
    )


def _log_shares(counts: np.ndarray) -> np.ndarray:
    return np.log(counts / counts.sum(axis=1, keepdims=True))


class Lanes:
    """Documents dealt to lanes as they come, longest first to the least loaded, and read in blocks of windows."""

    def __init__(self, most: int, span: int, windows: int = 16):
        self.span, self.windows = span, windows
        self.queues: list[deque] = [deque() for _ in range(most)]  # (key, word numbers, place reached)
        self.load = np.zeros(most, dtype=np.int64)
        self.last = np.zeros(most, dtype=np.int32)  # word before the next place

    def add(self, keys: list, docs: list[np.ndarray]) -> None:
        heap = [(n, i) for i, n in enumerate(self.load.tolist())]
        heapq.heapify(heap)
        for k in sorted(range(len(docs)), key=lambda k: -len(docs[k])):
            load, i = heap[0]
            self.queues[i].append((keys[k], docs[k], 0))
            heapq.heapreplace(heap, (load + len(docs[k]), i))
        for load, i in heap:
            self.load[i] = load

    def beside(self, lanes: int) -> int:
        """How many windows of so many lanes are about as large as one of all lanes."""
        return max(1, len(self.queues) // lanes)

    def cuts(self, x: np.ndarray) -> Iterator[slice]:
        """Of a block's steps: windows, or runs of windows where there are few lanes."""
        step = self.beside(len(x)) * self.span
        return (slice(t, t + step) for t in range(0, x.shape[1], step))

    def placed(self, m: np.ndarray) -> np.ndarray:
        """(lanes, steps) as (step of a window, window and lane)."""
        return m.reshape(len(m), -1, self.span).transpose(2, 1, 0).reshape(self.span, -1)

    def unplaced(self, m: np.ndarray, lanes: int) -> np.ndarray:
        return m.reshape(self.span, -1, lanes).transpose(2, 1, 0).reshape(lanes, -1)

    def blocks(self, final: bool) -> Iterator[tuple]:
        """(lanes, x, y, fresh, keys, starts, done) while all lanes are full, or if ``final`` until all are empty.

        x and y are (lanes, steps) inputs and targets (-1 in empty places);
        ``keys`` and ``starts`` are the runs of one document in ``y.ravel()``
        (key None: empty), ``done`` the keys that end here.
        """
        while True:
            full = int(self.load.min()) // self.span
            if full:
                lanes, steps = np.arange(len(self.queues)), min(full, self.windows) * self.span
            elif final and self.load.any():
                lanes = np.flatnonzero(self.load)
                steps = min(-(-int(self.load[lanes].min()) // self.span), self.beside(len(lanes))) * self.span
            else:
                return
            y = np.full((len(lanes), steps), -1, dtype=np.int32)
            fresh = np.zeros(y.shape, dtype=bool)
            keys, starts, done = [], [], []
            for row, i in enumerate(lanes.tolist()):
                queue, at = self.queues[i], 0
                while at < steps and queue:
                    key, doc, place = queue.popleft()
                    n = min(steps - at, len(doc) - place)
                    y[row, at:at + n] = doc[place:place + n]
                    fresh[row, at] = place == 0
                    keys.append(key)
                    starts.append(row * steps + at)
                    at += n
                    if place + n < len(doc):
                        queue.appendleft((key, doc, place + n))
                    else:
                        done.append(key)
                if at < steps:
                    keys.append(None)
                    starts.append(row * steps + at)
                self.load[i] -= at
            x = np.empty_like(y)
            x[:, 1:], x[:, 0] = y[:, :-1], self.last[lanes]
            self.last[lanes] = y[:, -1]
            yield lanes, x, y, fresh, keys, starts, done


class Model:
    """Forward and backward passes over windows of (step, lane) word numbers."""

    def __init__(self, weights: Weights):
        self.w = weights
        self.classes, self.h, self.width = weights.ww.shape
        self.other = self.classes * self.width
        self.start = self.other + 1
        self.inputs = self._gate_inputs(slice(None))

    def _thirds(self, m: np.ndarray) -> list[np.ndarray]:
        """Columns of the update, reset and candidate gates; the first two halved, as sigmoid(v) = (tanh(v / 2) + 1) / 2."""
        h = self.h
        return [np.multiply(m[:, i * h:(i + 1) * h], by, dtype=m.dtype) for i, by in enumerate((0.5, 0.5, 1))]

    def _gate_inputs(self, words) -> list[np.ndarray]:
        return self._thirds(self.w.embed[words] @ self.w.wx + self.w.b)

    def window(self, x: np.ndarray, y: np.ndarray, fresh: np.ndarray, state: np.ndarray, keep: bool):
        """(log probabilities (steps, lanes) with 0 for y < 0, last state, what backward needs).

        ``fresh`` marks places where a document begins and the state is cleared.
        Weights may change between windows with ``keep`` only. Where there are more
        places beside each other than states, they are windows that follow each other.
        """
        steps, n, h, lanes = *x.shape, self.h, len(state)
        x = np.where(fresh, self.start, np.maximum(x, 0))
        if keep:  # the window's words only, under the weights as they are
            order = np.argsort(x.ravel().astype(np.uint16) if self.start < 1 << 16 else x.ravel(), kind="stable")
            ids, first = np.unique(x.ravel()[order], return_index=True)
            places = np.empty(x.size, np.int32)
            places[order] = np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(first, append=x.size))
            tables, places = self._gate_inputs(ids), places.reshape(x.shape)
            words = order, ids, first
        else:
            tables, places = self.inputs, x
        c = tables[2].take(places, axis=0)
        gates = np.empty((2, *c.shape), c.dtype)  # update and reset
        for gate, table in zip(gates, tables):
            np.take(table, places, axis=0, out=gate, mode="clip")
        z, r = gates
        wz, wr, wc = self._thirds(self.w.wh)
        both = np.stack([wz, wr])
        stays = (~fresh).astype(z.dtype)[:, :, None]
        before, after, q = np.empty_like(z), np.empty_like(z), np.empty_like(z)
        parts = np.empty((2, lanes, h), z.dtype)
        begins = fresh.reshape(steps, -1, lanes).any(2).T.tolist()
        for first_lane in range(0, n, lanes):
            at = slice(first_lane, first_lane + lanes)
            for t in range(steps):
                s, gate, ct, qt = before[t, at], gates[:, t, at], c[t, at], q[t, at]
                if begins[first_lane // lanes][t]:
                    np.multiply(state, stays[t, at], out=s)
                else:
                    s[...] = state
                np.matmul(s, both, out=parts)
                gate += parts
                np.tanh(gate, out=gate)
                gate += 1
                gate *= 0.5
                zt, rt = gate
                np.matmul(s, wc, out=qt)
                np.multiply(rt, qt, out=parts[0])
                ct += parts[0]
                np.tanh(ct, out=ct)
                state = after[t, at]
                np.subtract(s, ct, out=state)
                state *= zt
                state += ct
        found, output = self._outputs(after.reshape(-1, h), y.ravel(), keep)
        return found.reshape(steps, n), state, (x, words, stays, z, r, c, q, before, output) if keep else None

    def _outputs(self, states: np.ndarray, target: np.ndarray, keep: bool):
        w = self.w
        used = np.flatnonzero(target >= 0)
        # rows in order of their classes; those of the last class come last
        cls = np.minimum(target[used] // self.width, self.classes).astype(np.int16)
        order = np.argsort(cls, kind="stable")
        used, cls = used[order], cls[order]
        edges = np.searchsorted(cls, np.arange(self.classes + 1))
        top, rows = np.ones((len(used), self.h + 1), states.dtype), np.arange(len(used))  # the last column meets the biases
        top[:, :-1] = states.take(used, axis=0)
        of_class, logs = _shares(top @ np.vstack([w.wc, w.bc]), rows, cls, keep)
        known = int(edges[-1])
        word = target[used[:known]] % self.width
        logits, by_class = np.empty((known, self.width), top.dtype), np.concatenate([w.ww, w.bw[:, None]], axis=1)
        for k in range(self.classes):
            a, b = edges[k], edges[k + 1]
            np.matmul(top[a:b], by_class[k], out=logits[a:b])
        of_word, more = _shares(logits, rows[:known], word, keep)
        logs[:known] += more
        found = np.zeros(len(target))
        found[used] = logs
        return found, (len(target), used, edges, top, rows, cls, of_class, word, of_word)

    def gradient(self, saved) -> tuple[Weights, np.ndarray, int]:
        """(gradient of the summed negative log-likelihood, rows of ``embed`` that it has, tokens), truncated at the window's start."""
        x, (order, ids, first), stays, z, r, c, q, before, (total, used, edges, top, rows, cls, d_class, word, d_word) = saved
        w, h, g = self.w, self.h, replace(self.w, **{f.name: np.zeros_like(getattr(self.w, f.name)) for f in fields(self.w) if f.name != "embed"})
        steps, n = x.shape
        d_class[rows, cls] -= 1
        d_word[rows[:len(word)], word] -= 1
        d_class_weights = top.T @ d_class
        g.wc[:], g.bc[:] = d_class_weights[:-1], d_class_weights[-1]
        d_top = d_class @ w.wc.T
        for k in range(self.classes):
            a, b = edges[k], edges[k + 1]
            if b > a:
                d_weights = top[a:b].T @ d_word[a:b]
                g.ww[k], g.bw[k] = d_weights[:-1], d_weights[-1]
                d_top[a:b] += d_word[a:b] @ w.ww[k].T
        d_after = np.zeros((total, h), top.dtype)
        d_after[used] = d_top
        d_after = d_after.reshape(steps, n, h)
        # what multiplies the state's gradient, for all steps at once
        left = 1 - z
        to_z = (before - c) * z * left
        to_c = (1 - c * c) * left
        to_r = q * r * (1 - r)
        d_gates, d_q = np.empty((steps, n, 3 * h), top.dtype), np.empty_like(z)
        back, back_q = np.ascontiguousarray(w.wh[:, :2 * h].T), np.ascontiguousarray(w.wh[:, 2 * h:].T)
        carry, part = np.zeros((n, h), top.dtype), np.empty((n, h), top.dtype)
        for t in range(steps - 1, -1, -1):
            d, gates = d_after[t], d_gates[t]
            d += carry
            d_c = np.multiply(d, to_c[t], out=gates[:, 2 * h:])
            np.multiply(d, to_z[t], out=gates[:, :h])
            np.multiply(d_c, to_r[t], out=gates[:, h:2 * h])
            np.multiply(d_c, r[t], out=d_q[t])
            np.multiply(d, z[t], out=carry)
            np.matmul(gates[:, :2 * h], back, out=part)
            carry += part
            np.matmul(d_q[t], back_q, out=part)
            carry += part
            carry *= stays[t]
        flat, states = d_gates.reshape(-1, 3 * h), before.reshape(-1, h)
        g.wh[:, :2 * h], g.wh[:, 2 * h:] = states.T @ flat[:, :2 * h], states.T @ d_q.reshape(-1, h)
        g.b[:], g.wx[:] = flat.sum(0), w.embed.take(x.ravel(), axis=0).T @ flat
        g.embed = np.add.reduceat((flat @ w.wx.T).take(order, axis=0), first, axis=0)
        return g, ids, len(used)


def _shares(logits: np.ndarray, rows: np.ndarray, goal: np.ndarray, keep: bool) -> tuple[np.ndarray | None, np.ndarray]:
    """(softmax of each row if kept, log share of each row's goal)."""
    np.clip(logits, *LOGITS, out=logits)
    at = logits[rows, goal].astype(np.float64)
    np.exp(logits, out=logits)
    total = logits @ np.ones(logits.shape[1], logits.dtype)
    if keep:
        logits *= (1 / total)[:, None]
    return (logits if keep else None), at - np.log(total)


class Scorer:
    """Natural log-likelihoods of whole documents."""

    def __init__(self, model: Model, most: int = 256, span: int = 32):
        self.model, self.lanes = model, Lanes(most, span)
        self.state = np.zeros((most, model.h), model.w.wh.dtype)
        self.total: dict = {}

    def add(self, keys: list, docs: list[np.ndarray], final: bool = False) -> list[tuple]:
        """(key, log-likelihood) of the documents that are done by now (arrays of word numbers, each at least one long)."""
        self.lanes.add(keys, docs)
        self.total.update(dict.fromkeys(keys, 0.0))
        found = []
        for lanes, x, y, fresh, runs, starts, done in self.lanes.blocks(final):
            state, logs = self.state[lanes], np.empty(x.shape)
            for cut in self.lanes.cuts(x):
                out, state, _ = self.model.window(*(self.lanes.placed(m[:, cut]) for m in (x, y, fresh)), state, False)
                logs[:, cut] = self.lanes.unplaced(out, len(lanes))
            self.state[lanes] = state
            for key, value in zip(runs, np.add.reduceat(logs.ravel(), starts).tolist()):
                if key is not None:
                    self.total[key] += value
            found += [(key, self.total.pop(key)) for key in done]
        return found


class Trainer:
    """Truncated backpropagation with Adagrad steps; the state runs through all windows of a text."""

    def __init__(self, model: Model, rate: float, most: int = 256, span: int = 32):
        self.model, self.rate, self.lanes = model, rate, Lanes(most, span)
        self.state = np.zeros((most, model.h), model.w.wh.dtype)
        self.squares = model.w.zeros()
        self.seen = 0  # tokens

    def add(self, docs: list[np.ndarray], final: bool = False) -> None:
        self.lanes.add([0] * len(docs), docs)
        for lanes, x, y, fresh, *_ in self.lanes.blocks(final):
            state = self.state[lanes]
            for cut in self.lanes.cuts(x):
                _, state, saved = self.model.window(*(self.lanes.placed(m[:, cut]) for m in (x, y, fresh)), state, True)
                self._step(*self.model.gradient(saved))
            self.state[lanes] = state

    def _step(self, gradient: Weights, ids: np.ndarray, n: int) -> None:
        self.seen += n
        for f in fields(gradient):
            d, s, v = (getattr(o, f.name) for o in (gradient, self.squares, self.model.w))
            rows = ids if f.name == "embed" else slice(None)
            d *= 1 / max(n, 1)
            np.clip(d, -0.1, 0.1, out=d)
            s[rows] += d * d
            d /= np.sqrt(s[rows] + np.float32(1e-7))
            d *= self.rate
            v[rows] -= d

import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from kinweave.llm import gru, lm_score

SCHEMA = "doc_id long, text string, score string"


def tokens(text):
    return [*re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), ""]


def corpus():
    r = random.Random(6)
    words = [f"w{i}" for i in range(40)]
    follows = {w: r.sample(words, 3) for w in words}
    rows = []
    for i in range(500):
        at, out = r.choice(words), []
        for _ in range(r.choice([1, 5, 40, 150])):
            out.append(at if r.random() < 0.95 else f"rare{r.randrange(3000)}")
            at = r.choice(follows[at])
        rows.append((i, (" " if i % 3 else "\n").join(out).upper() if i % 5 == 0 else " ".join(out)))
    rows += [(500, None), (501, ""), (502, "  \t\n"), (503, "É é\x1cx\x85y w1  W2 "), (504, "never seen words " * 3), (505, "w1 w2 w3 " * 3000)]
    return rows


def test_counts_and_base_scores_match_brute_force(spark):
    rows = corpus() + [(3, corpus()[3][1]), (None, "w1 w1")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA).repartition(4)
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows}
    seen = Counter(t for i, text in rows if not held[i] for t in tokens(text))
    n, v = sum(seen.values()), len(seen)
    for head in (65_536, 30):
        got = lm_score.score(df, head_words=head, classes=4, width=5, embed=4, state=6).collect()
        assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
        texts = dict(rows)
        for r in got:
            ts = tokens(texts[r.doc_id])
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ts), sum(seen[t] > 0 for t in ts), n)
            assert math.isclose(r.base_score, sum(math.log10((seen[t] + 1) / (n + v + 1)) for t in ts), rel_tol=1e-9)
            assert math.isfinite(r.score) and r.score < 0
    assert lm_score.score(df.limit(0)).count() == 0


def test_model_beats_the_base_on_held_out_documents(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in corpus()[:500]], SCHEMA).repartition(2)
    rows = [r for r in lm_score.score(df, classes=8, width=6, train_parts=1, rounds=3).collect() if r.held_out]
    assert sum(r.score for r in rows) > 0.8 * sum(r.base_score for r in rows)


def test_scores_match_brute_force(spark, monkeypatch):
    """The result column, word by word: the network inside its classes, counts in the class of all other words."""
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA).repartition(3)
    nets, plain = [], lm_score.train
    monkeypatch.setattr(lm_score, "train", lambda *a, **o: nets.append(plain(*a, **o)) or nets[-1])
    seen = Counter(t for i, text in rows if zlib.crc32(str(i).encode()) % 7 != 2 for t in tokens(text))
    for head_words in (65_536, 30):
        got = {r.doc_id: r.score for r in lm_score.score(df, head_words=head_words, classes=4, width=5, embed=4, state=6).collect()}
        order = ["", *sorted((w for w in seen if w), key=lambda w: (-seen[w], w.encode()))]
        classes = {w: k for k, w in enumerate(order[:20])}
        others = [w for w in seen if w not in classes]
        base = sum(seen[w] for w in others) + len(others) + 1
        for i, text in rows[::7] + rows[-6:-1]:
            ts = tokens(text)
            inside = plain_log(nets[-1], np.array([classes.get(t, 20) for t in ts])) / math.log(10)
            outside = sum(math.log10((seen[t] + 1) / base) for t in ts if t not in classes)
            assert math.isclose(got[i], inside + outside, rel_tol=1e-4), (i, head_words)


def test_model_beats_the_base_on_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [r for r in lm_score.score(docs).collect() if r.held_out]
    assert sum(r.score for r in rows) > 0.97 * sum(r.base_score for r in rows) and sum(r.score > r.base_score for r in rows) > 0.9 * len(rows)


def test_network_learns_from_every_training_token(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA).repartition(2)
    seen, plain = [], lm_score.tree_sum
    monkeypatch.setattr(lm_score, "tree_sum", lambda parts: seen.append(plain(parts)) or seen[-1])
    lm_score.score(df, classes=4, width=5, embed=4, state=6)
    want = sum(len(tokens(t)) for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2)
    assert len(seen) == lm_score.ROUNDS and sum(total for _, total in seen) == want


def test_training_carries_the_state_through_long_texts(monkeypatch):
    model, r = small()
    starts, plain, trainer = [], model.window, gru.Trainer(model, 0.1, most=2)
    monkeypatch.setattr(model, "window", lambda x, y, fresh, state, keep: starts.append((int(fresh.sum()), state.copy())) or plain(x, y, fresh, state, keep))
    trainer.add([r.integers(0, 21, 3000), r.integers(0, 21, 5)])
    trainer.add([r.integers(0, 21, 40)], final=True)
    assert trainer.seen == 3045 and sum(n for n, _ in starts) == 3
    assert all(np.abs(state).max() > 0 for _, state in starts[1:])


def test_words_of_slices():
    import pyarrow as pa

    texts = pa.array([f"Été {i} OF  the\ttexts É " * (i % 3 + 1) for i in range(50)] + [None], pa.string())
    for at, n in ((0, 51), (7, 20), (31, 20), (50, 1)):
        words, index, doc = lm_score._words(texts.slice(at, n))
        got = [[] for _ in range(n)]
        for i, d in zip(index.tolist(), doc.tolist()):
            got[d].append(words[i].as_py())
        assert got == [tokens(t)[:-1] for t in texts.slice(at, n).to_pylist()]


def test_words_of_large_slices():
    import pyarrow as pa

    from kinweave.llm.arrow import slices

    texts = pa.array([f"Été{i} OF  the\ttext{i % 7} É " * (200 + i) for i in range(300)], pa.string())
    batch = pa.RecordBatch.from_arrays([texts], ["t"])
    parts = list(slices(batch, 0, 300_000))
    assert len(parts) > 3 and sum(p.num_rows for p in parts) == 300
    for part in parts:
        words, index, _ = lm_score._words(part.column(0))
        words = words.to_pylist()
        assert Counter(words[i] for i in index.tolist()) == Counter(t for x in part.column(0).to_pylist() for t in tokens(x)[:-1])


def small(seed=1):
    r = np.random.default_rng(seed)
    weights = gru.initial(np.arange(20, 0, -1.0), 9, 4, 5, 4, 6)
    for name in ("wc", "ww", "embed"):
        getattr(weights, name)[...] = r.normal(size=getattr(weights, name).shape)
    return gru.Model(weights), r


def logs(model, docs, most=256, span=32):
    scorer = gru.Scorer(model, most, span)
    found = scorer.add(range(len(docs)), docs, final=True)
    assert not scorer.total
    return [value for _, value in sorted(found)]


def plain_log(w, doc):
    """One word after another, by the equations."""
    h, (classes, _, width) = w.wh.shape[0], w.ww.shape
    sigmoid, softmax = (lambda v: 1 / (1 + np.exp(-v))), (lambda v: np.exp(v) / np.exp(v).sum())
    state, before, total = np.zeros(h), classes * width + 1, 0.0
    for word in doc.tolist():
        gx, gh = w.embed[before] @ w.wx + w.b, state @ w.wh
        z, r = sigmoid(gx[:h] + gh[:h]), sigmoid(gx[h:2 * h] + gh[h:2 * h])
        state = z * state + (1 - z) * np.tanh(gx[2 * h:] + r * gh[2 * h:])
        cls = min(word // width, classes)
        total += math.log(softmax(state @ w.wc + w.bc)[cls])
        if cls < classes:
            total += math.log(softmax(state @ w.ww[cls] + w.bw[cls])[word % width])
        before = word
    return total


def test_scores_match_the_equations():
    model, r = small()
    docs = [r.integers(0, 21, n) for n in (1, 2, 70, 33, 5, 400, 1, 1, 90)]
    assert np.allclose(logs(model, docs, most=3, span=7), [plain_log(model.w, d) for d in docs], rtol=1e-5)


def test_lanes_take_documents_as_they_come():
    model, r = small()
    docs = [r.integers(0, 21, n) for n in (400, 3, 1, 64, 64, 9, 700, 2, 1, 33)]
    scorer, found = gru.Scorer(model, most=4, span=8), {}
    for i in range(0, 10, 2):
        found.update(scorer.add([i, i + 1], docs[i:i + 2]))
    assert len(found) < 10
    found.update(scorer.add([], [], final=True))
    assert np.allclose([found[i] for i in range(10)], [plain_log(model.w, d) for d in docs], rtol=1e-5)


def test_probabilities_sum_to_one_and_state_is_carried():
    model, r = small()
    before = r.integers(0, 21, 9)
    total = sum(math.exp(logs(model, [np.append(before, w)])[0] - logs(model, [before])[0]) for w in range(21))
    assert abs(total - 1) < 1e-4
    docs = [r.integers(0, 21, n) for n in (1, 2, 70, 33, 5, 400, 1)]
    alone = [logs(model, [d], span=1000)[0] for d in docs]
    assert np.allclose(logs(model, docs, most=3, span=7), alone, rtol=1e-5)
    assert np.allclose(logs(model, docs), alone, rtol=1e-5)


def test_gradient_matches_differences():
    model, r = small()
    w = model.w
    for name in ("embed", "wx", "wh", "b", "wc", "bc", "ww", "bw"):
        setattr(w, name, getattr(w, name).astype(np.float64))
    x, y, fresh = r.integers(0, 21, (7, 3)), r.integers(-1, 21, (7, 3)), r.random((7, 3)) < 0.2
    x[3, 1], fresh[3, 1] = 5, False
    state = r.normal(size=(3, 6)) * 0.5
    _, _, saved = model.window(x, y, fresh, state, True)
    g, ids, n = model.gradient(saved)
    assert n == (y >= 0).sum()
    whole = np.zeros_like(w.embed)
    whole[ids] = g.embed
    g.embed = whole
    for name in ("embed", "wx", "wh", "b", "wc", "bc", "ww", "bw"):
        a = getattr(w, name)
        k = (int(x[3, 1]), 2) if name == "embed" else tuple(int(r.integers(0, s)) for s in a.shape)
        kept, values = a[k], []
        for e in (1e-3, -1e-3):
            a[k] = kept + e
            values.append(model.window(x, y, fresh, state, True)[0].sum())
        a[k] = kept
        assert math.isclose(-(values[0] - values[1]) / 2e-3, getattr(g, name)[k], rel_tol=0.02, abs_tol=2e-3), name


def test_few_lanes_take_windows_together():
    """A long text left over takes steps as large as those of full lanes; scores and gradients are those of its windows one by one."""
    model, r = small()
    doc = r.integers(0, 21, 4000)
    taken, plain = [], model.window
    model.window = lambda x, y, fresh, state, keep: taken.append(x.shape) or plain(x, y, fresh, state, keep)
    assert np.allclose(logs(model, [doc], most=64, span=8), [plain_log(model.w, doc)], rtol=1e-5)
    assert taken == [(8, 64)] * 7 + [(8, 52)]
    x, y, fresh, state = r.integers(0, 21, (7, 6)), r.integers(-1, 21, (7, 6)), r.random((7, 6)) < 0.2, r.normal(size=(2, 6)).astype(np.float32)
    found, last, saved = plain(x, y, fresh, state, True)
    whole, ids, n = model.gradient(saved)
    total = {name: 0 for name in ("wx", "wh", "b", "wc", "bc", "ww", "bw")}
    for at in range(0, 6, 2):
        log, state, saved = plain(x[:, at:at + 2], y[:, at:at + 2], fresh[:, at:at + 2], state, True)
        assert np.allclose(log, found[:, at:at + 2], rtol=1e-5)
        one = model.gradient(saved)[0]
        total = {name: total[name] + getattr(one, name) for name in total}
    assert np.allclose(state, last) and all(np.allclose(total[name], getattr(whole, name), rtol=1e-3, atol=1e-4) for name in total)


def test_lanes_hold_every_document_once():
    lanes = gru.Lanes(16, 4)
    docs = [np.full(4, i) for i in range(100)] + [np.full(900, 100), np.full(1, 101)]
    lanes.add(list(range(102)), docs)
    held, ended = [[] for _ in docs], []
    for _, x, y, fresh, keys, starts, done in lanes.blocks(True):
        for key, run, new in zip(keys, np.split(y.ravel(), starts[1:]), np.split(fresh.ravel(), starts[1:])):
            if key is None:
                assert (run == -1).all()
            else:
                assert new[0] == (not held[key]) and not new[1:].any()
                held[key] += run.tolist()
        ended += done
    assert held == [d.tolist() for d in docs] and sorted(ended) == list(range(102))

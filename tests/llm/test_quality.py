import random
from itertools import product

import numpy as np

from kinweave.llm import quality as Q


def brute_base(text):
    import re

    text = text or ""
    words = re.findall("[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    covered = set()
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            covered.update(range(i, i + 5))
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered))


def pages():
    r = random.Random(8)
    vocabulary = ["".join(r.choice("abcdeéñ") for _ in range(r.randint(2, 8))) for _ in range(200)]
    rows = []
    for i in range(300):
        good = i % 3 > 0
        lines = []
        for _ in range(r.randint(1, 8)):
            words = [r.choice(vocabulary) for _ in range(r.randint(6, 25))]
            lines.append(" ".join(words).capitalize() + "." if good or r.random() < 0.2 else " | ".join(w.upper() for w in words[:6]))
        rows.append((i, "\n".join(lines), int(good)))
    return rows


def test_counts_match_brute_force(spark):
    r = random.Random(1)
    texts = [None, "", " \t\n", "a", "a b c d e a b c d e", "x\n\n x\nx\n", "| # é\x1c b\x85c\xa0d * <>", "a b c d e f " * 9, "one\rtwo\x0bthree\x0cfour"]
    texts += [" ".join(r.choice("ab") for _ in range(n)) for n in range(4, 40)]
    df = spark.createDataFrame([(i, t, True) for i, t in enumerate(texts)], "doc_id long, text string, kept boolean").repartition(3)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = {row.doc_id: row for row in Q.score(df, labels).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want, row = brute_base(t), got[i]
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == want, t
        assert row.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and row.kept == (not row.base_failed)
    assert Q.score(df.limit(0), labels).count() == 0


def test_viterbi_matches_every_path():
    r = np.random.default_rng(3)
    for _ in range(40):
        chain = Q.Chain(r.normal(size=(2, 3)), r.normal(size=(2, 2)))
        x = r.normal(size=(int(r.integers(1, 8)), 3))
        u = x @ chain.unary.T

        def value(path):
            return sum(u[i, s] for i, s in enumerate(path)) + sum(chain.steps[a, b] for a, b in zip(path, path[1:]))

        best = max(product((0, 1), repeat=len(x)), key=value)
        assert value(tuple(int(s) for s in chain.decode(x))) >= value(best) - 1e-9


def test_gradient_matches_every_path():
    """Differences of the log-likelihood, whose normaliser sums over all paths."""
    r = np.random.default_rng(4)
    chains = [r.normal(size=(n, 3)) for n in (1, 4, 6)]
    states = [r.integers(0, 2, len(c)) for c in chains]

    def likelihood(unary, steps):
        total = 0.0
        for x, y in zip(chains, states):
            u = x @ unary.T

            def value(path):
                return sum(u[i, s] for i, s in enumerate(path)) + sum(steps[a, b] for a, b in zip(path, path[1:]))

            total += value(y) - np.log(sum(np.exp(value(p)) for p in product((0, 1), repeat=len(x))))
        return total

    unary, steps = r.normal(size=(2, 3)), r.normal(size=(2, 2))
    grads = Q.likelihood_gradient(unary, steps, Q._padded(chains), Q._padded(states, -1).astype(np.int64))
    for weights, grad in zip((unary, steps), grads):
        for k in np.ndindex(weights.shape):
            kept, values = weights[k], []
            for e in (1e-5, -1e-5):
                weights[k] = kept + e
                values.append(likelihood(unary, steps))
            weights[k] = kept
            assert abs((values[0] - values[1]) / 2e-5 - grad[k]) < 1e-6


def test_windows_of_long_texts(monkeypatch):
    r = random.Random(2)
    texts = [[r.choice([b"a", b"b", b"c"]) for _ in range(n)] for n in (5, 6, 7, 50, 400)] + [[b"%d" % i for i in range(300)] + [b"1", b"2", b"3", b"4", b"5"]]
    want = [Q.repeat_words(t) for t in texts]
    monkeypatch.setattr(Q, "_FEW_WORDS", 0)
    assert [Q.repeat_words(t) for t in texts] == want and want[-1] == 10


def test_gradient_fit_separates_held_out_pages(spark):
    rows = pages()
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in rows] + [(0, rows[0][1], "s")], "doc_id long, text string, quality string").repartition(4)
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if i % 2], "doc_id long, quality int")
    got = {r.doc_id: r for r in Q.score(docs, labels).collect()}
    right = [got[i].content_share >= 0.5 for i, _, q in rows if i % 2 == 0 and q]
    wrong = [got[i].content_share >= 0.5 for i, _, q in rows if i % 2 == 0 and not q]
    assert np.mean(right) > 0.97 and np.mean(wrong) < 0.25
    kept = Q.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert sorted({r.doc_id for r in kept.collect()}) == sorted(i for i in got if got[i].kept)


def test_features_of_lines_in_runs(monkeypatch):
    r = np.random.default_rng(0)
    lines = [bytes(r.choice(list(b"ab .!|#7\xc3\xa9"), int(r.integers(1, 60))).astype(np.uint8)) + b"x" for _ in range(300)]
    whole = Q.line_features(lines)
    monkeypatch.setattr(Q, "_RUN", 16)
    for a, b in zip(whole, Q.line_features(lines)):
        assert (a == b).all()

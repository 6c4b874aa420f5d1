import random

import numpy as np

from kinweave.llm import toxicity as T
from kinweave.llm.labels import labelled_sample


def corpus(n=600, seed=4):
    r = random.Random(seed)
    common = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(300)]
    insults, threats = ["jerkface", "dumbo", "nitwit"], ["smash", "hurtyou"]
    rows = []
    for i in range(n):
        words = [r.choice(common) for _ in range(r.randint(5, 120))]
        insult = r.random() < 0.3
        threat = insult and r.random() < 0.6
        for on, lexicon in ((insult, insults), (threat, threats)):
            for _ in range(3 if on else 0):
                words[r.randrange(len(words))] = r.choice(lexicon)
        text = " ".join(words)
        w = T.words_of(text.encode())
        rows.append((i, text.upper() if i % 7 == 0 else text + ".", int(bool(w & {x.encode() for x in insults})), int(bool(w & {x.encode() for x in threats}))))
    return rows


def test_held_out_accuracy_and_cases(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _, _ in rows] + [(9000, None, 0.1), (9001, "", 0.1), (0, rows[0][1], 0.1)], "doc_id long, text string, p_threat double").repartition(4)
    labels = spark.createDataFrame([(i, a, b) for i, _, a, b in rows if i % 2] + [(1, None, None), (None, 1, 1)], "doc_id long, a int, b int")
    got = T.score(docs, labels, {"insult": "a", "threat": "b"}).collect()
    assert len(got) == len(rows) + 3
    by = {r.doc_id: r for r in got}
    for name, k in (("insult", 2), ("threat", 3)):
        held = [(by[r[0]][f"p_{name}"] >= 0.5) == bool(r[k]) for r in rows if r[0] % 2 == 0]
        assert np.mean(held) > 0.97
    assert not by[9000].threat and by[9000][1:] == by[9001][1:]
    assert T.score(docs.limit(0), labels, {"insult": "a"}).count() == 0
    assert not any(r.insult for r in T.score(docs, labels.limit(0), {"insult": "a"}).collect() if r.p_insult < 0.5)


def test_out_of_fold_probabilities_feed_later_models():
    rows = corpus(300)
    sample = [(t.encode(), (a, b)) for _, t, a, b in rows]
    chain = T.fit_chain(sample, ["a", "b"])
    assert [len(m.earlier) for m in chain.models] == [0, 1] and chain.models[1].earlier[0] != 0
    words = T.words_of(b"Nitwit, smash!")
    first, second = chain.probabilities(words)
    assert first == chain.models[0].probability(words, []) and second == chain.models[1].probability(words, [first])


def plain_logistic(rows, words, earlier, y):
    """The same descent on a dense matrix: (probabilities as a function of (word set, earlier probabilities))."""
    x = np.array([[w in row for w in words] for row in rows], dtype=float).reshape(len(rows), len(words))
    x = np.column_stack([x, earlier, np.ones(len(rows))])
    balance = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    penalty = np.append(np.full(x.shape[1] - 1, T.PENALTY), 0)
    w, square = np.zeros(x.shape[1]), np.full(x.shape[1], 1e-8)
    for _ in range(T.STEPS):
        grad = x.T @ ((1 / (1 + np.exp(-x @ w)) - y) * balance) + penalty * w
        square += grad**2
        w -= 0.5 * grad / np.sqrt(square)
    return lambda row, before: 1 / (1 + np.exp(-(np.array([*[v in row for v in words], *before, 1.0], dtype=float) @ w)))


def chosen_words(rows, y):
    """Words of three documents or more, by chi-square from a plain table of counts."""
    every = sorted(set().union(*rows))
    found = []
    for w in every:
        a = sum(w in r and v == 1 for r, v in zip(rows, y))
        b = sum(w in r and v == 0 for r, v in zip(rows, y))
        c, d = y.sum() - a, len(y) - y.sum() - b
        if a + b >= 3 and (a + b) * (c + d):
            chi2 = len(y) * (a * d - b * c) ** 2 / ((a + b) * (c + d) * (a + c) * (b + d))
            if chi2 >= T.LEAST_CHI2:
                found.append(w)
    return found


def test_chain_matches_a_dense_fit():
    """Two categories, out-of-fold inputs and all, against plain dense models."""
    data = corpus(260, seed=9)
    rows, a, b = [T.words_of(t.encode()) for _, t, _, _ in data], np.array([r[2] for r in data]), np.array([r[3] for r in data])
    common = [w for w in set().union(*rows) if sum(w in r for r in rows) >= 3]
    kept = [r & set(common) for r in rows]
    none = np.zeros((len(rows), 0))
    first = plain_logistic(rows, chosen_words(kept, a), none, a)
    out = np.zeros(len(rows))
    for f in range(T.FOLDS):
        train, test = [i for i in range(len(rows)) if i % T.FOLDS != f], [i for i in range(len(rows)) if i % T.FOLDS == f]
        held = plain_logistic([rows[i] for i in train], [w for w in common if w in chosen_fold(kept, a, train)], none[train], a[train])
        out[test] = [held(rows[i], []) for i in test]
    second = plain_logistic(rows, chosen_words(kept, b), out[:, None], b)
    chain = T.fit_chain([(t.encode(), (x, y)) for _, t, x, y in data], ["a", "b"])
    for row in rows[:80]:
        p = first(row, [])
        assert np.allclose(chain.probabilities(row), [p, second(row, [p])], atol=1e-6)


def chosen_fold(rows, y, train):
    """Words chosen within a fold; only words of three documents in the whole sample count."""
    some, labels = [rows[i] for i in train], y[train]
    found = set()
    for w in set().union(*some):
        a = sum(w in r and v == 1 for r, v in zip(some, labels))
        b = sum(w in r and v == 0 for r, v in zip(some, labels))
        c, d = labels.sum() - a, len(labels) - labels.sum() - b
        if (a + b) * (c + d) and len(labels) * (a * d - b * c) ** 2 / ((a + b) * (c + d) * (a + c) * (b + d)) >= T.LEAST_CHI2:
            found.add(w)
    return found


def test_sample_is_bounded_and_ignores_partitions(spark):
    rows = corpus(400)
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows] + [(1000 + i, rows[5][1]) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, a) for i, _, a, _ in rows] + [(1000 + i, 1) for i in range(200)], "doc_id long, a int")
    one = labelled_sample(docs.repartition(1), labels, ["a"], 50, 10_000)
    assert one == labelled_sample(docs.repartition(7), labels, ["a"], 50, 10_000)
    assert 0 < len(one) <= 50 and len({t for t, _ in one}) == len(one)
    few = labelled_sample(docs, labels, ["a"], 50, 10_000, all_bytes=2000)
    assert 0 < len(few) < len(one) and sum(len(t) for t, _ in few) <= 2000 and few == one[:len(few)]
    many = spark.createDataFrame([(1, f"text {i}") for i in range(300)], "doc_id long, text string")
    assert len(labelled_sample(many, labels, ["a"], 20, 10_000)) <= 20

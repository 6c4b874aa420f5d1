import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinweave.llm import chat
from kinweave.llm.queries import TOKENIZER

SCHEMA = "conv_id long, turn long, role string, text string, window string, segment string"
HOSTILE = chat.HOSTILE[1]


def digests(rows):
    """What must be read back, from the rows alone."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        loss = "".join(t for _, _, role, t in turns if role == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{role}\n{t}\n" for _, _, role, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def read(formatted):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(formatted).collect()}


def conversations(seed, n):
    r = np.random.default_rng(seed)
    bits = ["hello ", "\\", "### ", "#", "</turn>", "\n", "Ünï ", "assistant", ": ", "\\</turn>\n### user\n"]
    text = lambda: "".join(bits[i] for i in r.integers(0, len(bits), int(r.integers(0, 40))))
    rows = []
    for c in range(n):
        for t in range(int(r.integers(1, 12))):
            role = "system" if t == 0 and r.random() < 0.6 else ["user", "assistant", "system", "to\nol", None][int(r.integers(5))]
            rows.append((c if c else None, t if t else None, role, text() if r.random() < 0.9 else None, "w", "s"))
    return rows


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="\\#</turn> \n:aé"), st.text(alphabet="\\#</turn> \n:aé")), max_size=5))
def test_template_is_reversible(turns):
    written = [chat.format_turn(*t) for t in turns]
    assert chat.parse("".join(w for w, _, _ in written)) == turns
    for (w, a, b), (_, text) in zip(written, turns):
        assert chat.unescape(w[a:b]) == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=20), st.integers(0, 10), st.integers(0, 4), st.integers(1, 40), st.integers(0, 40))
def test_spans(tokens, fixed, first, budget, history):
    first = min(first, len(tokens))
    got, at = list(chat.spans(np.array(tokens), fixed, first, budget, history)), first
    for begin, new, end in got:
        assert new == at and begin <= new < end
        size = fixed + sum(tokens[begin:end])
        assert size <= budget or (begin == new and end == new + 1)  # only a turn too long for any window is over
        assert sum(tokens[begin:new]) <= history
        room = budget - fixed
        if begin:  # the longest history that leaves room for a new turn
            assert sum(tokens[begin - 1:new]) > history or sum(tokens[begin - 1:new + 1]) > room
        if end < len(tokens):
            assert size + tokens[end] > budget
        at = end
    assert at == len(tokens)


@pytest.mark.parametrize("options", [{}, {"budget": 60, "history": 20}, {"budget": 60, "history": 20, "segment_bytes": 100, "segment_tokens": 90}, {"budget": 40, "history": 0, "segment_bytes": 0, "segment_tokens": 40}])
def test_read_back(spark, options):
    rows = conversations(1, 40)
    rows += [(500, i // 3, "assistant" if i % 2 else "user", HOSTILE * (i % 5), None, None) for i in range(300)]  # one holds most rows, with ties and repeated rows
    rows += [(501, 0, "user", "same", None, None)] * 50 + [(-7, 0, "user", HOSTILE, None, None), (-7, 1, "assistant", HOSTILE, None, None)]
    formatted = chat.windows(spark.createDataFrame(rows, SCHEMA).repartition(5), TOKENIZER, **options)
    assert read(formatted) == digests(rows)
    held = formatted.collect()
    assert len({(w.conv_id, w.segment, w.window) for w in held}) == len(held)
    firsts = {c: min(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == c)) for c in {r[0] for r in rows}}
    budget, history = options.get("budget", chat.BUDGET), options.get("history", chat.HISTORY)
    repeats = 0
    for w in held:
        turns = chat.parse(w.text)
        assert len(turns) == w.n_turns > w.n_repeated and w.over == (w.n_tokens > budget)
        system = firsts[w.conv_id][2] == "system"
        if system:
            assert turns[0] == firsts[w.conv_id][2:]  # every window keeps the system turn
        if w.over:
            assert w.n_turns <= (2 if system else 1)
        repeats += w.n_repeated > system
        assert [chat.unescape(w.text[s.start:s.end]) for s in w.loss] == [t for role, t in turns[w.n_repeated:] if role == "assistant"]
    assert (repeats > 0) == (history > 0)


def test_history_crosses_segments(spark):
    rows = [(1, 0, "system", "be kind", None, None)] + [(1, i, "user" if i % 2 else "assistant", f"turn {i}", None, None) for i in range(1, 200)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(7)
    cut = chat.windows(table, TOKENIZER, 64, 24, 0, 150).orderBy("segment", "window").collect()
    assert len({w.segment for w in cut}) > 5
    said = [chat.parse(w.text) for w in cut]
    for before, w, turns in zip(said, cut[1:], said[1:]):
        again = turns[1:w.n_repeated]
        assert turns[0] == ("system", "be kind") and w.n_tokens <= 64
        assert again and before[-len(again):] == again  # the history that the window before ended with


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert chat.windows(empty, TOKENIZER).collect() == [] and chat.read_back(chat.windows(empty, TOKENIZER)).collect() == []
    only = chat.windows(chat.with_hostile(empty), TOKENIZER)
    assert read(only) == digests([(-7, 0, "user", HOSTILE), (-7, 1, "assistant", HOSTILE)])
    lone = chat.windows(spark.createDataFrame([(1, 0, "system", "x", None, None)], SCHEMA), TOKENIZER).collect()
    assert [(w.n_turns, w.n_repeated, len(w.loss)) for w in lone] == [(1, 0, 0)]
    long = spark.createDataFrame([(2, 0, "assistant", "word " * 200_000, None, None)], SCHEMA)
    assert [(w.over, len(w.loss)) for w in chat.windows(long, TOKENIZER).collect()] == [(True, 1)]

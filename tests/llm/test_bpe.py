import numpy as np
import pyarrow as pa
import public_tokenizers
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from kinweave.llm.bpe import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
OURS = Encoder(PATH)
THEIRS = Tokenizer.from_file(PATH)
THEIRS.encode_special_tokens = True


def same(texts):
    want = [[] if t is None else THEIRS.encode(t, add_special_tokens=False).ids for t in texts]
    got = OURS.batch(pa.array(texts, pa.string()))
    assert [ids.tolist() for ids in got] == want
    assert all(ids.dtype == np.uint32 for ids in got)


def test_hard_cases():
    same([None, "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "a\n b", "a\n\n  b ", "x  y", "x　 y", "x\x1c y", "x\x85 y", "don't stop 's 're",
                 "<|endoftext|> a", "é è ñ\n 12 3a4 a1, b.", "a​ b", "日本 語", "word, word. Word!! ##", "a\t b", "\r\n \r\n", "é x́", "Ⅷ Ⅷ ² a² b", "a' s b 's", "ǅ ʰ x"])
    same([])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(list("ab .,'\n\t1é²#  ​日")), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=4))
def test_random_texts(texts):
    same(texts)


def test_slices_of_a_batch():
    texts = pa.array([f"Été {i} of  the\ttexts" * (i % 3 + 1) for i in range(50)] + [None], pa.string())
    whole = OURS.batch(texts)
    for at, n in ((7, 20), (31, 20), (50, 1)):
        part = OURS.batch(texts.slice(at, n))
        assert [x.tolist() for x in part] == [x.tolist() for x in whole[at:at + n]]


def test_one_long_piece():
    same(["ab" * 50_000 + " " + "x" * 30_000, "é" * 20_000 + "\n", "日本" * 5_000])

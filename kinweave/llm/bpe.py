"""Byte-level BPE ids of whole texts, fast enough for every token of a corpus.

The vocabulary file is the ``tokenizers`` JSON named by the caller; ids equal
``Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids``. Merges
of such a file are in order of their ids, so a rank-based encoder gives the
same ids.

A token never crosses from a non-space character into a space, so a text where
no two white-space characters meet falls apart into space-led pieces. The
distinct pieces of a batch are laid end to end and encoded by one call; the
byte lengths of the tokens say which belong to which piece, and every text
gathers those of its own. Other texts are encoded whole. Nothing is kept
between batches.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken

from kinweave.llm.arrow import unsliced

#: Splitting rule of byte-level BPE files of this family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same where no two white-space characters meet.
SINGLE_SPACED = PATTERN.replace(r"|\s+(?!\S)", "")
_SPACE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _byte_of() -> dict[str, int]:
    """The character that stands for each byte: itself where printable, else the next from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in own}
    for k, b in enumerate(b for b in range(256) if b not in set(own)):
        table[chr(256 + k)] = b
    return table


class Encoder:
    """Encodes texts under one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            content = json.load(f)
        special = {x["content"] for x in content.get("added_tokens", ())}
        byte = _byte_of()
        ranks = {bytes(byte[c] for c in w): i for w, i in content["model"]["vocab"].items() if w not in special}
        self.bytes_of = np.zeros(max(ranks.values(), default=0) + 1, dtype=np.int64)
        for token, i in ranks.items():
            self.bytes_of[i] = len(token)
        self._whole, self._single_spaced = (tiktoken.Encoding(p, pat_str=p, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_to_tiktoken_buffer for p in (PATTERN, SINGLE_SPACED))

    def whole(self, text: str) -> np.ndarray:
        """The ids of any text."""
        return np.frombuffer(self._whole(text, set()), dtype=np.uint32)

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids (unsigned 32-bit) of every text (null: none)."""
        texts = unsliced(pc.fill_null(texts.cast(pa.large_string()), ""))
        uneven = pc.match_substring_regex(texts, _SPACE + "{2}").to_numpy(zero_copy_only=False)
        out = [self.whole(t.as_py()) if far else None for t, far in zip(texts, uneven)]
        even = np.flatnonzero(~uneven)
        if len(even):
            for i, ids in zip(even.tolist(), self._pieced(texts.take(pa.array(even)))):
                out[i] = ids
        return out

    def _pieced(self, texts: pa.Array) -> list[np.ndarray]:
        pieces = pc.split_pattern(texts, " ")
        offsets = pieces.offsets.to_numpy()
        coded = pieces.flatten().dictionary_encode()
        index, words = coded.indices.to_numpy(), coded.dictionary
        pool, starts, sizes = self._distinct(words)
        # no space leads the first piece of a text
        firsts = offsets[:-1]
        own = [np.frombuffer(self._single_spaced(t, set()), dtype=np.uint32) for t in words.take(pa.array(index[firsts])).to_pylist()]
        own_sizes = np.array([len(x) for x in own])
        lens, at = sizes[index], starts[index]
        lens[firsts], at[firsts] = own_sizes, len(pool) + np.cumsum(own_sizes) - own_sizes
        pool = np.concatenate([pool, *own])
        ends = np.concatenate([[0], np.cumsum(lens)])
        flat = pool[np.repeat(at - ends[:-1], lens) + np.arange(ends[-1])]
        return np.split(flat, ends[offsets[1:-1]])

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, number of ids) of a space and each word; no word has white space at both of its ends."""
        closed = pc.invert(pc.or_(pc.match_substring_regex(words, _SPACE + r"\z"), pc.equal(words, ""))).to_numpy(zero_copy_only=False)
        inside = words.filter(pa.array(closed))
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(inside)], inside), pa.scalar(" ", inside.type))[0].as_py()
        ids = np.frombuffer(self._single_spaced(" " + joined if len(inside) else "", set()), dtype=np.uint32)
        reached = np.cumsum(self.bytes_of[ids])
        ends = np.searchsorted(reached, np.cumsum(pc.binary_length(inside).to_numpy() + 1)) + 1
        open_ = [self.whole(" " + w) for w in words.filter(pa.array(~closed)).to_pylist()]
        sizes = np.zeros(len(words), dtype=np.int64)
        sizes[closed] = np.diff(ends, prepend=0)
        sizes[~closed] = [len(x) for x in open_]
        starts = np.zeros(len(words), dtype=np.int64)
        starts[closed] = ends - sizes[closed]
        starts[~closed] = len(ids) + np.cumsum(sizes[~closed]) - sizes[~closed]
        return np.concatenate([ids, *open_]), starts, sizes


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of ``path``, one per worker process; a bare name is that of a public tokenizer, looked up by the worker."""
    if "/" not in path:
        import public_tokenizers

        path = public_tokenizers.path(path)
    return Encoder(path)

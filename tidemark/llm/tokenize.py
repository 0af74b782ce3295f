"""Problem 6: byte-level BPE encoding of the whole corpus.

Texts are cut into words by the tokenizer's pattern; the words of a whole Arrow batch are made
distinct and their bytes laid out in one flat array of symbols.  Merge rounds run over that array:
the rank of every neighbouring pair is found by binary search over the sorted pair keys, each word
takes its lowest rank and merges that pair everywhere in the word, and words without a mergeable
pair leave the array.  All of it is numpy; Python touches a distinct word once.

The vocabulary file is read by each Python worker once, from a path that must exist on every
worker (a parameter; the file is not part of this package).  No special tokens exist here, so their
spellings are ordinary text.

Defined cases: a null and an empty text have the empty list of ids; a lone surrogate cannot occur
in Spark strings; any other text, however long, is encoded whole; very long texts are worked off
in slices of words, so memory follows the batch.
"""

from __future__ import annotations

import base64
import importlib
import os
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

_NONE = np.iinfo(np.int32).max
# Symbols worked on at once; bounds the memory of the merge rounds.
CHUNK_SYMBOLS = 4_000_000
# The split pattern of the rank files (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    """Place of a rank file: ``folder``, else TIDEMARK_TOKENIZERS, else the installed package."""
    folder = folder or os.environ.get("TIDEMARK_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    return importlib.import_module("public_tokenizers").path(name)


class RankTable:
    """Byte symbols and merge ranks of a rank file, as sorted arrays."""

    def __init__(self, path: str):
        ranks: dict[bytes, int] = {}
        with open(path, "rb") as f:
            for line in f:
                if line.strip():
                    token, rank = line.split()
                    ranks[base64.b64decode(token)] = int(rank)
        self.size = max(ranks.values()) + 1
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = [
            (ranks[t[:i]] * self.size + ranks[t[i:]], r)
            for t, r in ranks.items()
            for i in range(1, len(t))
            if t[:i] in ranks and t[i:] in ranks
        ]
        keys = np.array([k for k, _ in pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.merged = np.append(np.array([r for _, r in pairs], dtype=np.int64)[order], _NONE)

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word; the words are non-empty."""
        length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(words)
        ends = np.cumsum(length)
        i = 0
        while i < len(words):
            base = ends[i] - length[i]
            j = max(i + 1, int(np.searchsorted(ends, base + CHUNK_SYMBOLS, "right")))
            self._encode(words, i, j, length[i:j], out)
            i = j
        return out

    def _encode(self, words: list[bytes], i: int, j: int, length: np.ndarray, out: list[np.ndarray]) -> None:
        sym = self.byte_id[np.frombuffer(b"".join(words[i:j]), dtype=np.uint8)]
        word = np.repeat(np.arange(j - i), length)
        rank = self._ranks(sym, word)
        while len(sym):
            start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            low = np.minimum.reduceat(rank, start)
            n = np.diff(np.r_[start, len(sym)])
            done = low == _NONE
            if done.any():
                for s, k, w in zip(start[done], n[done], word[start[done]]):
                    out[i + w] = sym[s : s + k].astype(np.int32)
                keep = np.repeat(~done, n)
                sym, word, rank = sym[keep], word[keep], rank[keep]
                if not len(sym):
                    break
                low, n = low[~done], n[~done]
            hit = rank == np.repeat(low, n)
            # of overlapping occurrences (aaa) every second merges, counted from the left
            at = np.flatnonzero(hit)
            chain = np.r_[True, at[1:] != at[:-1] + 1]
            first = np.maximum.accumulate(np.where(chain, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            sym[at] = rank[at]
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            changed = np.zeros(len(sym), dtype=bool)
            changed[at] = True
            sym, word, rank, changed = sym[keep], word[keep], rank[keep], changed[keep]
            again = np.flatnonzero(changed | np.r_[changed[1:], False])
            rank[again] = self._ranks_at(sym, word, again)

    def _ranks(self, sym: np.ndarray, word: np.ndarray) -> np.ndarray:
        return self._ranks_at(sym, word, np.arange(len(sym)))

    def _ranks_at(self, sym: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rank of the pair that begins at each place, _NONE where there is none."""
        nxt = np.minimum(at + 1, len(sym) - 1)
        key = sym[at] * self.size + sym[nxt]
        pos = np.searchsorted(self.keys, key)
        ok = (self.keys[pos] == key) & (nxt != at) & (word[at] == word[nxt])
        return np.where(ok, self.merged[pos], _NONE)


@lru_cache(maxsize=4)
def _table(path: str) -> RankTable:
    return RankTable(path)


@lru_cache(maxsize=1)
def _splitter():
    import regex

    return regex.compile(PATTERN)


def encode_batch(texts, path: str) -> list[np.ndarray]:
    """Ids of each text of a batch; None counts as empty."""
    table, split = _table(path), _splitter().findall
    seen: dict[str, int] = {}
    index: list[np.ndarray] = []
    for t in texts:
        index.append(np.fromiter((seen.setdefault(w, len(seen)) for w in split(t)), np.int64) if t else np.empty(0, np.int64))
    ids = table.encode_words([w.encode("utf-8") for w in seen])
    size = np.fromiter(map(len, ids), np.int64, count=len(ids))
    flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
    begin = np.cumsum(size) - size
    out = []
    for ix in index:
        n = size[ix]
        if not len(ix):
            out.append(np.empty(0, np.int32))
            continue
        shift = np.cumsum(n) - n
        out.append(flat[np.arange(int(n.sum())) + np.repeat(begin[ix] - shift, n)])
    return out


def _encode_column(path: str):
    def encode(texts: pd.Series) -> pd.Series:
        return pd.Series(encode_batch(texts, path), index=texts.index, dtype=object)

    return F.pandas_udf(encode, ArrayType(IntegerType()))


def _count_column(path: str):
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series([len(x) for x in encode_batch(texts, path)], index=texts.index, dtype="int32")

    return F.pandas_udf(count, IntegerType())


def token_ids(text: Column, path: str | None = None) -> Column:
    """array<int> of a text column."""
    return _encode_column(path or vocabulary_path())(text)


def token_count(text: Column, path: str | None = None) -> Column:
    """Number of tokens of a text column; the ids stay in the Python worker."""
    return _count_column(path or vocabulary_path())(text)


def encode_corpus(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) of every row, in one narrow stage."""
    return documents.select("doc_id", token_ids(F.col("text"), path).alias("ids"))

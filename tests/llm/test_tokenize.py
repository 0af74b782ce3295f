import base64
import os
import random

import pytest

from tidemark.llm import tokenize as tk

public = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def reference():
    path = tk.vocabulary_path()
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=tk.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


ODD = ["", None, "a", "aaa bb " * 100, "a" * 5000, " " * 3001, "<|endoftext|>x<|endoftext|>", "😀" * 300, "  \t\n x", "̈" * 50, "it's 'S we'll", "١٢٣", "abcab" * 2000, "\x00\x01"]


def test_odd_texts(reference):
    random.seed(1)
    texts = ODD + ["".join(random.choice("ab cé日 '\n") for _ in range(200)) for _ in range(300)]
    got = tk.encode_batch(texts, tk.vocabulary_path())
    assert [list(map(int, x)) for x in got] == [reference(t) if t else [] for t in texts]


def test_chunks_change_nothing(reference, monkeypatch):
    monkeypatch.setattr(tk, "CHUNK_SYMBOLS", 50)
    texts = [t for t in ODD if t]
    assert [list(map(int, x)) for x in tk.encode_batch(texts, tk.vocabulary_path())] == [reference(t) for t in texts]


def test_whole_table(spark, small, reference):
    df = spark.read.parquet(f"{small}/documents.parquet")
    got = {r["doc_id"]: list(r["ids"]) for r in tk.encode_corpus(df).collect()}
    assert got == {r["doc_id"]: reference(r["text"]) if r["text"] else [] for r in df.select("doc_id", "text").collect()}
    assert tk.encode_corpus(df.limit(0)).count() == 0


def test_path_is_a_parameter(monkeypatch):
    monkeypatch.setenv("TIDEMARK_TOKENIZERS", "/somewhere")
    assert tk.vocabulary_path("x.tiktoken") == os.path.join("/somewhere", "x.tiktoken")

"""Counts against the library on every text as a whole."""

from __future__ import annotations

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kvloom.llm import token_count

PATH = public_tokenizers.path("piece_bpe_32k.model")
COUNTER = token_count.Counter(open(PATH, "rb").read())


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("ab \n▁é\t１<s>/\r\x00日\U0001f600"), max_size=30))
def test_count_equals_the_library(text):
    assert COUNTER.count(text) == len(COUNTER.library.encode(text))


def test_shortcut_is_proven():
    assert COUNTER.splits and len(COUNTER.whole) > 20_000
    for word, n in list(COUNTER.whole.items())[::97]:
        assert n == (len(COUNTER.library.encode(word)) - word.startswith("\n"))


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(token_count, "MEMO", len(COUNTER.whole) + 50)
    counter = token_count.Counter(open(PATH, "rb").read())
    texts = [f"zq{i}xv wj{i} the" for i in range(300)]
    assert [counter.count(t) for t in texts] == [len(counter.library.encode(t)) for t in texts]
    assert len(counter.memo) <= len(counter.whole) + 50
    long = " ".join(f"q{i}z" for i in range(200))  # more than the memo takes, twice
    assert counter.count(long) == counter.count(long) == len(counter.library.encode(long))
    monkeypatch.setattr(token_count, "MEMO", 10**6)
    monkeypatch.setattr(token_count, "MEMO_CHARS", 100)
    assert [counter.count(t) for t in [*texts, long]] == [len(counter.library.encode(t)) for t in [*texts, long]]
    assert sum(map(len, counter.memo.keys() - counter.whole.keys())) <= 100


def test_table(spark, documents):
    rows = [(1, None), (2, ""), (3, " "), (None, "no id"), (4, "the " * 5000), (4, "the " * 5000), (5, "x" * 30000)]
    got = token_count.count_tokens(documents(rows), PATH).collect()
    want = sorted((str(i), len((t or "").encode()), len(COUNTER.library.encode(t or ""))) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 4096) for r in got)


@pytest.mark.parametrize("rows", [[]])
def test_empty_table(spark, documents, rows):
    assert token_count.count_tokens(documents(rows), PATH).count() == 0

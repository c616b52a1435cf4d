import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortrank.llm import bpe, token_counts

PATH = P.path("byte_bpe_50k.tiktoken")
OWN = bpe.Encoder(PATH, P.PATTERN)
TIKTOKEN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=OWN.ranks, special_tokens={})


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


@pytest.mark.parametrize("text", ["", " ", "a", "  lead\n\n\n tail  \n", "a\x1c b\x1f\x1fc  \x85\xa0x", "I'll don't 'S", "é" * 300, "日本語 123  45", "👩‍👩‍👧 ok", "x" * 20_000, "#" * 999 + "!" * 77, "a \nb", "a  b", " a b "])
def test_texts_encode_as_the_library_does(text):
    assert ids(OWN.encode(text)) == TIKTOKEN.encode_ordinary(text)
    assert OWN.decode(OWN.encode(text)) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_any_text_encodes_as_the_library_does(text):
    assert ids(OWN.encode(text)) == TIKTOKEN.encode_ordinary(text)


def test_one_tree_and_many_trees_merge_alike():
    rng = random.Random(1)
    pieces = [bytes(rng.choices(b"abcdehtinos ", k=rng.randint(33, 64))) for _ in range(200)]
    many = OWN.trees.ids(pieces, 6)
    assert [ids(x) for x in many] == [bpe.merge(p, OWN.ranks, OWN.longest) for p in pieces]


def test_a_long_text_is_taken_piecemeal(monkeypatch):
    monkeypatch.setattr(bpe, "LONG_TEXT", 10)
    monkeypatch.setattr(bpe, "GROUP_UNITS", 3)
    text = "several words  with\nspaces and more of them"
    assert ids(OWN.encode(text)) == TIKTOKEN.encode_ordinary(text)


def test_documents(spark, docs, no_docs):
    out = bpe.decode_documents(bpe.encode_documents(docs, PATH, P.PATTERN), PATH, P.PATTERN)
    got = Counter((r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in out.collect())
    want = Counter((r.doc_id, len(x), np.array(x, "<u4").tobytes(), (r.text or "").encode()) for r in docs.collect() for x in [TIKTOKEN.encode_ordinary(r.text or "")])
    assert got == want
    assert bpe.encode_documents(no_docs, PATH, P.PATTERN).count() == 0


def brute_counts(text, rule):
    data, tokens = (text or "").encode(), [TIKTOKEN.decode_single_token_bytes(i) for i in TIKTOKEN.encode_ordinary(text or "")]
    sections, at = [], 0
    for part in data.split(b"\n"):
        stop = min(at + len(part) + 1, len(data))
        sections.append((at, stop))
        at = stop
    if len(sections) > 1 and sections[-1][0] == len(data):
        sections.pop()
    counts, at = [0] * len(sections), 0
    for t in tokens:
        shares = [max(0, min(b, at + len(t)) - max(a, at)) for a, b in sections]
        held = [i for i, x in enumerate(shares) if x]
        counts[held[0] if rule == "first" else max(held, key=lambda i: (shares[i], -i))] += 1
        at += len(t)
    return [(i, a, b - a, n) for i, ((a, b), n) in enumerate(zip(sections, counts, strict=True))]


@pytest.mark.parametrize("rule", ["first", "most"])
def test_token_counts(spark, docs, rule):
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(20, "a\n\n\n\nb\n"), (21, "\n\n"), (22, "x\n\n  y")], "doc_id long, text string"))
    out = token_counts.count_tokens(more, PATH, P.PATTERN, rule=rule)
    got = Counter((r.doc_id, r.section, r.start, r.length, r.n_tokens) for r in out.collect())
    assert got == Counter((r.doc_id, *x) for r in more.collect() for x in brute_counts(r.text, rule))


def test_token_counts_of_no_documents(no_docs):
    assert token_counts.count_tokens(no_docs, PATH, P.PATTERN).count() == 0
    with pytest.raises(ValueError):
        token_counts.count_tokens(no_docs, PATH, P.PATTERN, rule="other")

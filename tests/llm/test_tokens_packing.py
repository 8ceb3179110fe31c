import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import packing, tokens


@pytest.fixture(scope="module")
def library(vocab):
    tok = pytest.importorskip("tokenizers").Tokenizer.from_file(vocab)
    return lambda t: tok.encode(t, add_special_tokens=False).ids


def test_every_prefix(vocab, library):
    counter, encode, rnd = tokens.PrefixCounter(vocab), tokens.Encoder(vocab), random.Random(1)
    bits = ["a", "the", "'ll", "'s", "'", "  ", "\n", " ", "\t", "\n\n", "é", "ß", "1", "23", "!", "**", "<|endoftext|>", "\u3000", "\x85", "漢字", "word", "ing", " 're", "\r\n", "😀", "<|"]
    for _ in range(300):
        t = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 12)))
        assert np.frombuffer(encode(t), "<u4").tolist() == library(t)
        steps = counter(t)
        assert [tokens.tokens_at(steps, i) for i in range(len(t) + 1)] == [len(library(t[:i])) for i in range(len(t) + 1)]


@settings(max_examples=100, deadline=None)
@given(text=st.text(max_size=30))
def test_round_trip(text):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = np.frombuffer(tokens.encoder(path)(text), "<u4")
    v = tokens.vocabulary(path)
    assert b"".join(v.bytes_of[i] if i in v.bytes_of else b"<|endoftext|>" for i in ids.tolist()) == text.encode()


def test_budget(vocab):
    steps = tokens.PrefixCounter(vocab)("hello world, good morning")
    n = tokens.longest_within(steps, 3)
    assert tokens.tokens_at(steps, n) <= 3 < tokens.tokens_at(steps, n + 1)


def test_counts_frame(docs, no_docs, vocab, library):
    rows = tokens.prefix_counts(docs, "text", vocab).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.n_bytes, r.n_tokens) == (len((r.text or "").encode()), len(library(r.text or "")))
    assert tokens.prefix_counts(no_docs, "text", vocab).count() == 0


def test_packing_frame(docs, no_docs, vocab, library):
    rows = packing.pack_documents(docs, vocab, 64).collect()
    per, by_doc = {}, {}
    for r in rows:
        per.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    for places in per.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    ids = library("long " * 30_000) + [0]
    pieces = sorted(by_doc[10], key=lambda r: r.piece)
    assert [p.start for p in pieces] == list(np.cumsum([0] + [p.length for p in pieces[:-1]])) and sum(p.length for p in pieces) == len(ids)
    assert all(p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) for p in pieces)
    assert by_doc[5][0].length == by_doc[6][0].length == 1 and len(by_doc[4]) == 4
    assert packing.pack_documents(no_docs, vocab, 64).count() == 0


def test_packing_reaches_the_best(spark):
    from itertools import permutations

    rnd = random.Random(5)
    for _ in range(60):
        items = [rnd.randint(1, 20) for _ in range(rnd.randint(1, 6))]
        counts = {s: items.count(s) for s in items}
        best = min(_bins(p, 20) for p in permutations(items))
        fixed, left = packing.reduce_instance(counts, 20)
        solved = packing.solve(counts, 20)
        assert sum(t for _, t in solved) >= best >= packing.lower_bound(counts, 20)
        # the reduction itself never costs a sequence: the best for what is left completes a best packing
        rest = [s for s, c in left.items() for _ in range(c)]
        assert sum(t for _, t in fixed) + (min(_bins(p, 20) for p in permutations(rest)) if rest else 0) == best
        used = {}
        for pattern, times in solved:
            assert sum(s * c for s, c in pattern) <= 20
            for s, c in pattern:
                used[s] = used.get(s, 0) + c * times
        assert used == counts


def _bins(items, capacity):
    n, room = 0, 0
    for x in items:
        if x > room:
            n, room = n + 1, capacity
        room -= x
    return n


def test_lengths_that_do_not_fit(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 0), (4, 11), (5, 5), (5, 5)], "doc_id int, n int")
    rows = packing.pack(df, "n", 10, ["doc_id"]).collect()
    assert {r.doc_id for r in rows if r.sequence_id is None} == {2, 3, 4}
    assert len({r.sequence_id for r in rows if r.sequence_id is not None}) == 2

"""Tokenisers, token counts and packing against the libraries themselves."""

import hashlib
import random
from collections import Counter
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rowloom.llm import bpe, common, packing, token_counts
from rowloom.llm.queries import tokenizer_json

ODD = ["", " ", "  \n ", "a\n \nb", "it's we'll 'tis", "<|endoftext|>x", "naïve café ñ ß", "日本語 テキスト", "x y z", "𝒳😀é", "\x1c\x1d a", "a" * 2000, "- " * 300, "\r\n\r\n\t", "½²³ 12ab"]
RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def own():
    return bpe.Encoder(bpe.tokenizer_from_ranks(RANKS, public_tokenizers.PATTERN))


@pytest.fixture(scope="module")
def theirs():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(text=st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_ids_are_tiktokens(own, theirs, text):
    ids = np.frombuffer(own.encode(text), "<u4").tolist()
    assert ids == theirs.encode_ordinary(text)


def test_round_trip(spark, theirs):
    rows = [(i, t) for i, t in enumerate([*ODD, None, ODD[6], ODD[6]])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("doc_id", "text", "doc_id as ids", "'x' as decoded")
    encoded = bpe.encode(docs, bpe.tokenizer_from_ranks(RANKS, public_tokenizers.PATTERN), offsets=True)
    decoded = {r["doc_id"]: bytes(r["decoded"]) for r in bpe.decode(encoded, bpe.tokenizer_from_ranks(RANKS, public_tokenizers.PATTERN)).collect()}
    assert decoded == {i: (t or "").encode() for i, t in rows}
    for r in encoded.collect():
        text = rows[r["doc_id"]][1] or ""
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        raw = np.cumsum([0, *(len(theirs.decode_single_token_bytes(i)) for i in ids)])
        at = [len(text.encode()[:k].decode("utf-8", "ignore")) for k in raw]
        assert list(r["char_start"]) == at[:-1]
        assert all(e >= s + 1 for s, e in zip(r["char_start"], r["char_end"], strict=True)) and (not ids or r["char_end"][-1] == len(text))
    digests = bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for r in digests.collect():
        text = rows[r["doc_id"]][1] or ""
        ids = theirs.encode_ordinary(text)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        own = next(e for e in encoded.filter(f"doc_id = {r['doc_id']}").collect())
        assert r["offsets_sha256"] == hashlib.sha256(np.asarray([*own["char_start"], *own["char_end"]], "<i4").tobytes()).hexdigest()
    assert digests.count() == len(rows) and digests.filter("n_tokens = 0").count() == 2
    assert bpe.round_trip(docs.filter("false"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0


@settings(max_examples=150, deadline=None)
@given(text=st.text(st.one_of(st.sampled_from("  ▁\n\rthe'=-é"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_prefix_counts_are_sentencepieces(text):
    c, library = token_counts.counter(MODEL), token_counts.library(MODEL)
    want = [len(library.encode(text[:k])) for k in range(len(text) + 1)]
    assert c.prefixes(text) == want and c.total(text) == want[-1]
    for budget in (0, 1, 2, 3, 5, 9, 40):
        assert c.fitting(text, budget) == max(k for k, n in enumerate(want) if n <= budget)


def test_count_tokens(spark):
    rows = [(i, t) for i, t in enumerate([*ODD, None])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    library = token_counts.library(MODEL)
    for r in token_counts.count_tokens(docs, MODEL, budgets=(3,), prefixes=True).collect():
        text = rows[r["doc_id"]][1] or ""
        counts = [len(library.encode(text[:k])) for k in range(len(text) + 1)] if len(text) < 700 else None
        assert (r["n_bytes"], r["n_tokens"]) == (len(text.encode()), len(library.encode(text)))
        if counts:
            assert list(r["prefix_tokens"]) == counts and r["fits_3"] == max(k for k, n in enumerate(counts) if n <= 3)


def test_memo_is_bounded():
    memo = common.Memo(2000)
    for k in range(100):
        keys = [f"{k}-{i}" for i in range(5)] + ["long" * 100]
        assert memo.answers(keys, len) == [*map(len, keys)]
        assert len(memo) <= 20 + 5 and "long" * 100 not in memo


def check_packing(rows, pieces, capacity, library):
    """Pieces cover every text in order, and every sequence is gapless."""
    ids = {k: [*library.encode(t or "", add_special_tokens=False).ids, 2] for k, t in rows}
    by_doc, by_sequence = {}, {}
    for r in pieces:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.asarray(own, "<u4").tobytes())
    assert set(by_doc) == set(ids)
    for k, own in by_doc.items():
        own.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == [*range(len(own))] and sum(r["length"] for r in own) == len(ids[k])
        assert all(r["length"] == capacity for r in own[1:]) and (len(own) > 1) == (len(ids[k]) > capacity)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(by_sequence)


def test_pack(spark):
    random.seed(3)
    rows = [(i, " ".join(random.choice(["the", "cat", "sat", "Onomatopoeia"]) for _ in range(random.choice([0, 3, 20, 90, 400])))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "word " * 900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    pieces = packing.pack(docs, tokenizer_json(), capacity=128, with_ids=True)
    found = pieces.collect()
    n = check_packing(rows, found, 128, Tokenizer.from_str(tokenizer_json()))
    assert n <= 1.02 * -(-sum(r["length"] for r in found) // 128) + 1
    whole = packing.sequences(pieces).collect()
    assert len(whole) == n and all(len(r["ids"]) == 4 * r["length"] for r in whole)
    assert packing.pack(docs.filter("false"), tokenizer_json()).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.one_of(st.tuples(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=30), st.just(64)), st.tuples(st.dictionaries(st.integers(1, 1024), st.integers(1, 60), max_size=40), st.just(1024))))
def test_plan_places_every_piece_once(given_):
    """And never needs more sequences than best fit."""
    histogram, capacity = given_
    runs, counts = packing.plan(histogram, capacity), Counter()
    for n, pattern in runs:
        assert n > 0 and sum(length * times for length, times in pattern) <= capacity
        for length, times in pattern:
            counts[length] += n * times
    assert counts == Counter(histogram)
    lengths = np.array(sorted(histogram), dtype=np.int64)
    alone = packing.best_fit(lengths, np.array([histogram[x] for x in lengths.tolist()], dtype=np.int64), capacity)
    assert packing.needed(runs) <= packing.needed(alone)


def test_plan_beats_best_fit_where_triples_matter():
    histogram = {x: 600 for x in range(300, 380)}
    lengths = np.array(sorted(histogram))
    plain = sum(n for n, _ in packing.best_fit(lengths, np.full(len(lengths), 600), 1024))
    assert sum(n for n, _ in packing.plan(histogram, 1024)) < 0.95 * plain

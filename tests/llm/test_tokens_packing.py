"""Byte-level BPE against the tokenizers library, and packing."""

import random

import numpy as np
import pytest
from edge_cases import EDGE
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from brightledger.llm import bpe, packing

PATH = bpe.default_path()
LIBRARY = Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def library():
    return LIBRARY


def expected(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab'st <|endoftext|>\n\t\x1c   éß漢🙂12.,!"), max_size=80))
def test_ids_and_text_equal_the_library(text):
    lib, codec = LIBRARY, bpe.codec(PATH)
    ids = codec.encode_all([text])[0].tolist()
    assert ids == expected(lib, text)
    assert codec.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_long_pre_tokens(library):
    rnd = random.Random(3)
    for text in ["a" * 3000, "ab" * 900, "".join(rnd.choice("abcdefgh") for _ in range(5000)), "漢字" * 500]:
        assert bpe.codec(PATH).encode_all([text])[0].tolist() == expected(library, text)


def test_memo_that_is_emptied(library, monkeypatch):
    from brightledger.llm import tokens

    monkeypatch.setattr(tokens, "MEMO_WORDS", 3)
    codec = bpe.Codec(PATH)
    for text in ["the cat sat on the mat", "on the cat", "sat sat dog\nthe end"]:
        assert codec.encode_all([text, text])[1].tolist() == expected(library, text)


def test_edge_cases(spark, edge, nothing, library):
    from collections import Counter
    from hashlib import sha256

    rows = bpe.round_trip_digests(edge, PATH).collect()
    want = Counter()
    for d, t, _ in EDGE:
        ids = expected(library, t)
        want[d, len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256((t or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, rows)) == want
    assert bpe.round_trip_digests(nothing, PATH).count() == 0
    encoded = bpe.encode_documents(edge, PATH)
    assert Counter(map(tuple, bpe.decode_documents(encoded, PATH).collect())) == Counter((d, t or "") for d, t, _ in EDGE)


def test_differencing_beats_a_first_fit_spread():
    rnd = np.random.default_rng(5)
    sizes = rnd.integers(1, 1024, 400)
    sums = np.bincount(packing.difference(sizes, 210), sizes, 210)
    assert sums.sum() == sizes.sum() and sums.max() - sums.min() < 200


@pytest.mark.parametrize("cut", [True, False])
@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=40))
def test_windows_hold_every_item_once(cut, lengths):
    windows = packing.pack_lengths(lengths, 64, cut)
    seen = {}
    for w in windows:
        assert 0 < sum(n for _, _, n in w) <= 64
        for i, s, n in w:
            seen.setdefault(i, []).append((s, n))
    for i, n in enumerate(lengths):
        at = 0
        for s, k in sorted(seen.get(i, [])):
            assert s == at and k > 0
            at += k
        assert at == n
    if cut and lengths:
        assert len(windows) <= -(-sum(n % 64 for n in lengths) // 64) + sum(n // 64 for n in lengths)


def test_whole_items_raise_the_window_count():
    windows = packing.pack_lengths([40, 40, 40], 64, cut=False)
    assert sorted(len(w) for w in windows) == [1, 1, 1]


def test_packed_documents(edge, nothing, library):
    from collections import Counter

    pieces = packing.pack_documents(edge, PATH).collect()
    total, places = Counter(), {}
    for p in pieces:
        assert len(p["ids"]) == 4 * p["length"] and p["length"] > 0
        total[p["doc_id"]] += p["length"]
        places.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for rows in places.values():
        at = 0
        for offset, n in sorted(rows):
            assert offset == at
            at += n
        assert at <= 1024
    want = Counter()
    for d, t, _ in EDGE:
        want[d] += len(expected(library, t)) + 1
    assert total == want
    long_ids = b"".join(p["ids"] for p in sorted((p for p in pieces if p["doc_id"] == 7), key=lambda p: p["start"]))
    assert np.frombuffer(long_ids, "<u4").tolist() == expected(library, "word " * 30_000) + [0]
    assert packing.pack_documents(nothing, PATH).count() == 0


def test_many_tiny_documents_make_bounded_groups(spark, monkeypatch):
    inner = packing.pack_lengths
    monkeypatch.setattr(packing, "GROUP_PLACES", 2_000)
    lengths = [10] * 3000
    groups, held, size = [], 0, 0
    for n in lengths:  # the rule of pack_documents
        held, size = held + 1, size + n
        if size >= packing.GROUP_TOKENS or held * (size // 1024 + 1) >= packing.GROUP_PLACES:
            groups.append(held)
            held, size = 0, 0
    assert max(groups) * (max(groups) * 10 // 1024 + 1) <= 2_100
    windows = inner(lengths[: max(groups)], 1024)
    assert sum(n for w in windows for _, _, n in w) == 10 * max(groups) and all(sum(n for _, _, n in w) <= 1024 for w in windows)


def test_ids_of_other_types(spark):
    from brightledger.llm import bpe

    for kind, value in (("short", 3), ("double", 2.5), ("string", "x")):
        df = spark.createDataFrame([(value, "some words"), (None, None)], f"doc_id {kind}, text string")
        rows = packing.pack_documents(df, bpe.default_path()).collect()
        assert {r["doc_id"] for r in rows} == {value, None} and dict(packing.pack_documents(df, bpe.default_path()).dtypes)["doc_id"] == df.dtypes[0][1]


def test_word_hashes_need_one_array_beside_the_powers():
    import tracemalloc

    from brightledger.llm import words

    raw, at = np.resize(np.arange(97, 123, dtype=np.uint8), words.SLICE), np.arange(0, 1000)
    want = words.hash_ranges(raw[:2000].copy(), at, at + 5)  # a range's hash does not depend on what follows it
    words.hash_ranges(raw, at, at + 5)
    tracemalloc.start()
    got = words.hash_ranges(raw, at, at + 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got == want).all()
    assert peak < 1.25 * 8 * len(raw)

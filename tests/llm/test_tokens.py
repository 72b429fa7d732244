from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from palimpsest.llm import token_files as K
from palimpsest.llm import trie_bpe as T
from palimpsest.llm._shared import scratch


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(K.default_tokenizer())
    t.no_truncation()
    t.no_padding()
    return t


def test_files_round_trip(spark, docs, rows, library):
    path = scratch(spark, "tokens-test")
    K.write_files(docs, path)
    got = K.read_files(spark, path).collect()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    start, want = 0, []
    for r in ordered:
        ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 1]
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda x: x[1]) == want


def test_no_documents(spark, no_docs):
    path = scratch(spark, "tokens-none")
    K.write_files(no_docs, path)
    assert K.read_files(spark, path).collect() == []
    assert T.digests(T.encode_and_decode(no_docs)).collect() == []


@given(st.lists(st.lists(st.integers(0, 40), max_size=300), min_size=1, max_size=6))
@settings(max_examples=40, deadline=None)
def test_frames_keep_all_ids_and_give_any(parts):
    frame = K.Frame(K.to_frame(list(range(len(parts))), [np.array(p, np.uint32) for p in parts], 50))
    ids, places = frame.documents()
    for i, p in enumerate(parts):
        assert ids[places[i] : places[i + 1]].tolist() == [*p, 1] == frame.document(i).tolist()
        assert [frame.token(i, j) for j in range(len(p) + 1)] == [*p, 1]


def test_frames_compress_and_find_damage():
    data = K.to_frame([None], [np.array([1, 2, 3, 4] * 5000, np.uint32)], 50)
    assert len(data) < 2000 and K.Frame(data).doc_ids == [None]
    with pytest.raises(ValueError):
        K.Frame(data[:-9] + b"x" + data[-8:])


def test_encoders_agree_with_the_library(library):
    texts = ["", "don't 123'S we'll'd", "'sat ''t's", "aaaa aaaaaaaaaaa ......... ---", "İstanbul ǅ ß ﬁ Å é e\u0301 ́x", "日本語 한국 x\xa0y\u2003z", "a<|endoftext|>b <|startoftext|>", "\x00\x1c\x85 ²³½", "thanonedble " * 50]
    for own in (K.Encoder(K.default_tokenizer()).ids, T.TrieEncoder(K.default_tokenizer()).encode):
        for text, ids in zip(texts, own([t.encode() for t in texts])):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text


@given(st.lists(st.text(st.characters(max_codepoint=0x3000, exclude_categories=("Cs",)), max_size=60), max_size=5))
@settings(max_examples=60, deadline=None)
def test_trie_on_any_text(texts):
    own = T.trie_encoder(K.default_tokenizer())
    library = own.own
    library.no_truncation()
    library.no_padding()
    for text, ids in zip(texts, own.encode([t.encode() for t in texts])):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want and own.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_memo_bound(monkeypatch, library):
    monkeypatch.setattr(T, "MEMO", 10)
    monkeypatch.setattr(K, "MEMO", 10)
    for own in (K.Encoder(K.default_tokenizer()).ids, T.TrieEncoder(K.default_tokenizer()).encode):
        for k in range(6):
            text = " ".join(f"word{j}x" for j in range(7 * k, 7 * k + 9))
            assert own([text.encode()])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_digests(docs, rows, library):
    got = sorted(T.digests(T.encode_and_decode(docs)).collect(), key=str)
    want = []
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((r[0], len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def thue_morse(n: int) -> tuple[str, str]:
    """A word of 2**n letters a and b and its complement, which share every polynomial hash modulo 2**64 for n of 10."""
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("clash", [False, True])
def test_words_are_known_by_their_bytes(monkeypatch, library, clash):
    """Words that polynomial hashes confuse, words that differ beyond a lane or in length only, and all hashes equal."""
    from palimpsest.llm._words import IdMemo

    if clash:
        monkeypatch.setattr(IdMemo, "hashes", lambda self, own, words: np.zeros(len(words), np.uint64))
    path = K.default_tokenizer()
    words = [*thue_morse(10), *thue_morse(5), *thue_morse(6), "a" * 8, "a" * 9, "a" * 64, "a" * 65, "a" * 63 + "b", "abcdefgh1", "abcdefgh2", "abcdefgh", "x\x00", "x", "\x00x"]
    texts = [" ".join(words), " ".join(reversed(words)), words[0], words[1], "", " ".join(f"w{k}" for k in range(300))]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    for own in (K.Encoder(path).ids, T.TrieEncoder(path).encode):
        for _ in range(2):
            assert [x.tolist() for x in own([t.encode() for t in texts])] == want


def test_memo_that_is_too_small(monkeypatch):
    from palimpsest.llm._words import IdMemo

    path = K.default_tokenizer()
    own = K.Encoder(path)
    texts = [" ".join(f"w{k}x{j % 7}" for k in range(j, j + 40)).encode() for j in range(30)] + [b"q" * 100 + b" " + b"q" * 101] * 2
    want = [x.tolist() for x in own.ids(texts)]
    own.memo = IdMemo(own.kind, 16, 6)
    assert [x.tolist() for x in own.ids(texts)] == want and [x.tolist() for x in own.ids(texts[::-1])] == want[::-1]


@given(st.lists(st.integers(0, 5), max_size=800), st.integers(0, 3))
@settings(max_examples=40, deadline=None)
def test_no_pair_is_left_that_gains(ids, repeats):
    """Rules are made until none gains, whatever repeats; what they stand for is what was there."""
    s = np.array((ids + [5]) * (repeats + 1), np.uint32)
    short, left, right, length = K.re_pair(s, 5)
    at = K.places_of_pairs(short, 5)
    left_over = np.unique(np.stack([short[at], short[at + 1]]), axis=1, return_counts=True)[1] if len(at) else np.zeros(1)
    assert left_over.max(initial=0) < K.LEAST
    text = {k: [k] for k in range(6)}
    for k, (a, b) in enumerate(zip(left.tolist(), right.tolist())):
        text[6 + k] = text[a] + text[b]
        assert len(text[6 + k]) == length[k] and 5 not in text[6 + k]
    assert [x for k in short.tolist() for x in text[k]] == s.tolist()


def test_re_pair_sorts_what_rules_changed(monkeypatch):
    """Steps that replace little don't go through a whole shard again: all together sort few times its places."""
    sorted_places, by_pair = [], K.by_pair
    monkeypatch.setattr(K, "by_pair", lambda keys, at, *rest: sorted_places.append(len(at)) or by_pair(keys, at, *rest))
    a, b = [1], [2]
    for _ in range(22):  # nested repeats take a step a level
        a, b = b, b + a
    rare = np.random.default_rng(0).permutation(np.repeat(np.arange(10, 20010), 4))
    s = np.concatenate([a, [30000], rare, [30000], np.full(3000, 3), [30000]]).astype(np.uint32)
    short, left, right, length = K.re_pair(s, 30000)
    assert len(sorted_places) > 10 and sum(sorted_places) < 4 * len(s)
    assert length.sum() > 0 and K.Frame(K.to_frame([0], [s[:-1][s[:-1] != 30000]], 30000)).document(0).tolist() == [*s[s != 30000].tolist(), 1]


def test_places_are_grouped_alike_in_numbers_of_any_size():
    keys = np.array([7, 3, 7, 7, 9, 3, 7, 7, 3, 3, 3], np.int64)
    at = np.arange(len(keys))
    for got in zip(K.by_pair(keys, at, 10, 50), K.by_pair(keys, at, 30, 50)):
        assert got[0].tolist() == got[1].tolist()
    pairs, counts, places = K.by_pair(keys, at, 30, 50)
    assert pairs.tolist() == [3, 7] and counts.tolist() == [5, 5] and places.tolist() == [1, 5, 8, 9, 10, 0, 2, 3, 6, 7]


def test_runs_whose_beginning_was_replaced():
    """No pair of one symbol is left either, where another rule took the first of a run."""
    s = np.array(([9, 4, 4, 4, 4, 4, 7] * 40 + [9, 4, 8] * 200 + [20]) * 2, np.uint32)
    short = K.re_pair(s, 20)[0]
    at = K.places_of_pairs(short, 20)
    assert np.unique(np.stack([short[at], short[at + 1]]), axis=1, return_counts=True)[1].max(initial=0) < K.LEAST


def test_the_library_gets_short_texts():
    """New pieces go to the library in texts that a core's cache holds, in one call."""
    own, seen = K.Encoder(K.default_tokenizer()), []

    class Spy:
        def encode_batch_fast(self, texts, **rest):
            seen.append([len(t.split(" ")) for t in texts])
            return bulk.encode_batch_fast(texts, **rest)

    bulk, own.bulk = own.bulk, Spy()
    text = " ".join(f"q{k}x," for k in range(2000)).encode()
    assert own.ids([text])[0].tolist() == own.own.encode(text.decode(), add_special_tokens=False).ids
    assert len(seen) == 1 and sum(seen[0]) > 6000 and max(seen[0]) <= 256


def test_words_as_objects_and_their_beginnings():
    from palimpsest.llm._words import Cut

    words = [b"x", b"x" * 8, b"x" * 9, b"y" * 64, b"z" * 65, b"w" * 1000, b"last"]
    own = Cut([b" ".join(words[:4]), b"", b"\t\n".join(words[4:])])
    assert own.objects(np.arange(7)) == words and own.objects(np.array([6, 4, 0])) == [b"last", b"z" * 65, b"x"] and own.objects(np.array([], int)) == []
    assert own.begin.tolist() == [own.lane(np.array([k]), 0)[0] for k in range(7)]

"""Token ids in Re-Pair compressed shards.

Documents are dealt by ranges of doc_id, encoded, and packed into shards of about SHARD_TOKENS ids. In each shard,
Re-Pair replaces the most frequent pairs of symbols by nonterminals, again and again, until no pair is left whose rule
would gain anything (LEAST places); a rule never reaches over a document's end. A shard is one frame: rules, the length that each expands to, the place of each document and the remaining symbols.
So any document, or any id of it, is decoded without the rest. Frames are rows of a Parquet table below the shared
folder: Spark's committer makes a task's frames appear once, however often the task ran.

Frame, little-endian: b"RPR1", documents u4, ids u8, vocabulary u4, rules u4, symbols u4, bytes of a symbol u4;
left and right symbols of the rules; expansion lengths u4; first symbol of each document and the end u4; doc_ids i8;
a flag for null doc_ids u1; symbols; crc32 of all before u4. Symbols below the vocabulary's size are ids, that size
itself is the end of a document, those above are rules in order.

Cases: a null or empty text has the end id only. Null doc_ids come first; equal doc_ids are ordered by text. An empty
table gives no frames. Memory is bounded by a shard, a part of a batch and the memo (MEMO words), not by the table.
"""

from __future__ import annotations

import codecs
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import kept, scratch, table, text_bytes
from ._words import IdMemo

SHARD_TOKENS, END_ID, MEMO, PART_BYTES = 1 << 18, 1, 800_000, 1 << 20
#: The library's work on a text of so many pieces stays in a core's cache.
AT_ONCE = 256
#: A rule takes two symbols and four bytes of length, as much as four symbols of two bytes: with LEAST places it gains.
LEAST, STEP = 5, 8
#: What the tokenizer file names as its pattern.
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
HEAD = struct.Struct("<4sIQIIII")
FRAMES = "part int, before long, n_docs int, n_tokens long, frame binary"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Words that aren't plain: beyond U+024F, with white space that isn't ASCII, or with what may be a special token.
NOT_PLAIN = re.compile("[\u0250-\U0010ffff\x85\xa0]|<\\|")
#: The letters and numbers that lower-cased plain words may hold, written out: the standard library's patterns are faster.
LETTER, NUMBER = (re.escape("".join(sorted({x for c in map(chr, range(0x250)) for x in c.lower() if regex.match(kind, x)}))) for kind in ("\\p{L}", "\\p{N}"))
PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^{LETTER}{NUMBER}\n]+|\n")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where it is printable, else the next one after 255."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in plain else next(free)) for b in range(256)]


LETTERS = "".join(" " if b == 32 else c for b, c in enumerate(byte_letters()))
#: Stands for the end of a word in what cut() gives.
MARK = LETTERS[10]


def cut(joined: str) -> list[str]:
    """Plain words, one a line, as pieces in byte letters, MARK after each word."""
    return codecs.charmap_decode(" ".join(PIECE.findall(joined.lower() + "\n")).encode(), "strict", LETTERS)[0].split(" ")


class Encoder:
    """ids of whole texts. White space separates words for good in these tokenizers, so a word is encoded once.

    New words of a part of a batch go through the library's BPE model in one call, AT_ONCE pieces a text. Below U+0250 the file's normaliser
    is lower case and its pattern is PIECE; other words go through the library's whole chain, one by one.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.own = Tokenizer.from_file(path)
        self.own.no_truncation()
        self.own.no_padding()
        self.vocab = self.own.get_vocab_size()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.bulk = None
        if spec["model"].get("end_of_word_suffix") == "</w>" and PATTERN in json.dumps(spec["pre_tokenizer"]).replace("\\\\", "\\"):
            self.bulk = Tokenizer(self.own.model)
            self.bulk.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.ends_word = np.zeros(self.vocab, bool)
            self.ends_word[[i for t, i in self.own.get_vocab().items() if t.endswith("</w>")]] = True
        self.kind = np.dtype("<u2" if self.vocab <= 1 << 16 else "<u4")
        self.memo = IdMemo(self.kind, MEMO)

    def library(self, words: list[bytes]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.own.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]

    def plain(self, joined: str, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of n plain words, one a line."""
        pieces = cut(joined)
        last = np.fromiter(map(MARK.__eq__, pieces), bool, len(pieces))
        own = [p for p in pieces if p != MARK]
        found = self.bulk.encode_batch_fast([" ".join(own[k : k + AT_ONCE]) for k in range(0, len(own), AT_ONCE)], add_special_tokens=False)
        ids = np.fromiter(chain.from_iterable(e.ids for e in found), self.kind)
        ends = np.flatnonzero(self.ends_word[ids]) + 1  # of pieces
        stop = ends[np.cumsum(~last)[last] - 1]  # of words
        if len(stop) != n or len(ends) != (~last).sum():
            raise ValueError("pieces and words don't agree")
        return np.diff(stop, prepend=0), ids

    def learn(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of words."""
        joined = b"\n".join(new).decode()
        if self.bulk and not NOT_PLAIN.search(joined):
            return self.plain(joined, len(new))
        lines = joined.split("\n")
        odd = [k for k, w in enumerate(lines) if not self.bulk or NOT_PLAIN.search(w)]
        found: list = [None] * len(new)
        for k, ids in zip(odd, self.library([new[k] for k in odd])):
            found[k] = ids
        rest = [k for k, ids in enumerate(found) if ids is None]
        if rest:
            sizes, ids = self.plain("\n".join([lines[k] for k in rest]), len(rest))
            for k, own in zip(rest, np.split(ids, np.cumsum(sizes)[:-1])):
                found[k] = own
        return np.fromiter(map(len, found), np.int64, len(found)), np.concatenate(found)

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        return self.memo.texts(texts, self.learn)


def encoder(path: str) -> Encoder:
    """One for each worker process and file."""
    return kept(("token_files", path), lambda: Encoder(path))


def every_other(at: np.ndarray, same: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The places of pairs, in order, that may be replaced: of a run of one symbol every other place only.
    same: whether they are pairs of one symbol, after: the place that follows each."""
    k = np.flatnonzero(same)
    if not len(k):
        return at
    run = np.flatnonzero(np.concatenate([[True], at[k[1:]] != after[k[:-1]]]))
    offset = np.arange(len(k)) - np.repeat(run, np.diff(np.append(run, len(k))))
    return np.delete(at, k[offset % 2 == 1])


def places_of_pairs(s: np.ndarray, end: int) -> np.ndarray:
    """Where a pair begins that may be replaced: within a document, and in a run of one symbol every other place only."""
    inner = s != end
    at = np.flatnonzero(inner[:-1] & inner[1:])
    return every_other(at, (s[:-1] == s[1:])[at], at + 1)


def spans(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """counts numbers from each first on."""
    ends = np.cumsum(counts)
    return np.repeat(first - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


def by_pair(keys: np.ndarray, at: np.ndarray, bits: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs that have LEAST places or more, their counts, and their places, by pair and in order. Keys are below
    1 << 2 * bits, places below size."""
    low = size.bit_length()
    if 2 * bits + low < 64:  # sorting numbers is faster than finding an order
        both = keys << low
        both |= at
        both.sort()
        keys = both >> low
    else:
        both = np.lexsort((at, keys))
        keys, both = keys[both], at[both]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    counts = np.diff(first, append=len(keys))
    some = counts >= LEAST
    first, counts = first[some], counts[some]
    at = both[spans(first, counts)]
    return keys[first], counts, at & ((1 << low) - 1)


def re_pair(symbols: np.ndarray, vocab: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """symbols when no pair is left that LEAST places or more could be replaced by, and left, right and expansion length
    of each rule.

    Frequent pairs go first. Pairs wait in levels, each reaching to STEP times the count where it begins, the lowest at LEAST. A
    step takes all pairs of the highest level that has any; where two of them overlap, the more frequent one is replaced, so
    the most frequent one everywhere. A pair that gets fewer than LEAST places so waits for a later step.

    Symbols stay at their places, linked to those before and after. Only new rules make pairs more frequent, and those
    pairs hold a new symbol. So only places that a rule changed are sorted by their pairs again; the others wait as
    they are, and those that a rule changed since are left out when their level's turn comes. A run of one symbol whose
    beginning was replaced may have more places than wait; runs are looked at again when no level has any.
    """
    s = np.concatenate([[vocab], symbols, [vocab]]).astype(np.int32)
    size, n = len(s), vocab + 1
    low, bits = size.bit_length(), (n + size // (LEAST - 1)).bit_length()  # a rule removes LEAST symbols or more
    before, after, ranks = np.arange(-1, size - 1, dtype=np.int32), np.arange(1, size + 1, dtype=np.int32), np.full(size, size, np.int32)
    key = np.full(size, -1)  # of the pair that begins at a place; -1: none, -2: the symbol is gone
    left, right, length = [], [], [np.ones(n, np.int64)]
    bounds = [LEAST]
    while bounds[-1] < size:
        bounds.append(bounds[-1] * STEP)
    waiting: list[list] = [[] for _ in bounds]

    def wait(pairs: np.ndarray, counts: np.ndarray, at: np.ndarray) -> None:
        level, first = np.searchsorted(bounds, counts, "right") - 1, np.cumsum(counts) - counts
        for k in set(level[counts >= LEAST].tolist()):
            some = np.flatnonzero(level == k)
            waiting[k].append((pairs[some], counts[some], at[spans(first[some], counts[some])]))

    def sort_in(at: np.ndarray) -> None:
        wait(*by_pair(key[at], at, bits, size))

    at = places_of_pairs(s, vocab)
    key[:-1] = np.where((s[:-1] != vocab) & (s[1:] != vocab), np.left_shift(s[:-1], bits, dtype=np.int64) | s[1:], -1)
    sort_in(at)
    while True:
        top = max((k for k, x in enumerate(waiting) if x), default=-1)
        if top < 0:
            at = np.flatnonzero(key >= 0)
            at = at[s[at] == s[after[at]]]
            sort_in(every_other(at, np.ones(len(at), bool), after[at]))
            if not any(waiting):
                break
            continue
        pairs, counts, at = (np.concatenate(x) if len(x) > 1 else x[0] for x in zip(*waiting[top]))
        waiting[top] = []
        still = key[at] == np.repeat(pairs, counts)
        at, counts = at[still], np.add.reduceat(still, np.cumsum(counts) - counts, dtype=np.int64)
        now = counts >= bounds[top]
        if not now.all():
            taken = np.repeat(now, counts)
            wait(pairs[~now], counts[~now], at[~taken])
            pairs, counts, at = pairs[now], counts[now], at[taken]
            if not len(pairs):
                continue
        order = np.argsort(-counts, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        pairs, at = pairs[order], (at << low) | np.repeat(place, counts)
        at.sort()  # by place from here on: what lies near is read together
        at, rank = at >> low, at & ((1 << low) - 1)
        prior, following = before[at], after[at]
        ranks[at] = rank
        wins = (rank < ranks[prior]) & (rank < ranks[following])
        ranks[at] = size
        used = np.bincount(rank, wins, len(pairs)) >= LEAST
        wins &= used[rank]
        won, lost = np.flatnonzero(wins), np.flatnonzero(~wins)
        hit, old, gone, lost, lost_key = at[won], prior[won], following[won], at[lost], pairs[rank[lost]]
        s[hit] = (n - 1 + np.cumsum(used))[rank[won]]
        key[hit], key[gone] = -1, -2
        following = after[gone]
        after[hit], before[following] = following, hit
        old = old[(key[old] >= 0) & (s[old] < n)]
        free = s[following] != vocab
        new, following = hit[free], following[free]
        key[old] = np.left_shift(s[old], bits, dtype=np.int64) | s[after[old]]
        key[new] = np.left_shift(s[new], bits, dtype=np.int64) | s[following]
        sort_in(np.concatenate([old, every_other(new, s[new] == s[following], following), lost[key[lost] == lost_key]]))
        left.append(pairs[used] >> bits)
        right.append(pairs[used] & ((1 << bits) - 1))
        sizes = np.concatenate(length)
        length = [sizes, sizes[left[-1]] + sizes[right[-1]]]
        n += len(left[-1])
    none = np.zeros(0, np.int64)
    return s[1:-1][key[1:-1] != -2].astype(np.uint32), np.concatenate([none, *left]), np.concatenate([none, *right]), np.concatenate(length)[vocab + 1 :]


def to_frame(doc_ids: list, ids: list[np.ndarray], vocab: int) -> bytes:
    """ids: of each document, without the end id."""
    flat = np.concatenate([x for i in ids for x in (i, np.array([vocab], np.uint32))])
    s, left, right, length = re_pair(flat, vocab)
    kind = "<u2" if vocab + len(left) < 1 << 16 else "<u4"
    places = np.concatenate([[0], np.flatnonzero(s == vocab) + 1])
    body = [
        HEAD.pack(b"RPR1", len(ids), len(flat), vocab, len(left), len(s), int(kind[-1])),
        left.astype(kind).tobytes(), right.astype(kind).tobytes(), length.astype("<u4").tobytes(), places.astype("<u4").tobytes(),
        np.array([x or 0 for x in doc_ids], "<i8").tobytes(), np.array([x is None for x in doc_ids], "u1").tobytes(), s.astype(kind).tobytes(),
    ]
    data = b"".join(body)
    return data + struct.pack("<I", zlib.crc32(data))


class Frame:
    """Random access to a shard."""

    def __init__(self, data: bytes, end_id: int = END_ID):
        if data[:4] != b"RPR1" or struct.unpack("<I", data[-4:])[0] != zlib.crc32(data[:-4]):
            raise ValueError("not a whole frame")
        _, docs, self.n_tokens, self.vocab, rules, symbols, width = HEAD.unpack_from(data)
        at, kind = HEAD.size, f"<u{width}"

        def take(dtype: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, dtype, n, at)
            at += out.nbytes
            return out

        self.end_id, self.left, self.right = end_id, take(kind, rules).astype(np.int64), take(kind, rules).astype(np.int64)
        self.length = np.concatenate([np.ones(self.vocab + 1, np.int64), take("<u4", rules)])
        self.places, ids, null = take("<u4", docs + 1).astype(np.int64), take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if z else int(x) for x, z in zip(ids, null)]
        self.symbols = take(kind, symbols)
        self.full: tuple[np.ndarray, np.ndarray] | None = None

    def expanded(self, s: np.ndarray) -> np.ndarray:
        """The ids of symbols. What rules stand for is laid out once, each after the rules it is made of."""
        if self.full is None:
            rules = np.arange(self.vocab + 1, len(self.length))
            while (deep := rules > self.vocab).any():  # all rules' texts at once, a level of rules at a time
                n = 1 + deep
                at = np.cumsum(n) - n
                wider = np.empty(len(rules) + int(deep.sum()), np.int64)
                wider[at] = rules
                k = rules[deep] - self.vocab - 1
                wider[at[deep]], wider[at[deep] + 1] = self.left[k], self.right[k]
                rules = wider
            text = np.concatenate([np.arange(self.vocab + 1), rules]).astype(np.uint32)
            text[text == self.vocab] = self.end_id
            size = self.length.copy()
            self.full = np.cumsum(size) - size, text
        starts, text = self.full
        n = self.length[s]
        ends = np.cumsum(n)
        return text[np.repeat(starts[s] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]

    def document(self, i: int) -> np.ndarray:
        return self.expanded(self.symbols[self.places[i] : self.places[i + 1]])

    def token(self, i: int, j: int) -> int:
        """Id j of document i, by descending the rules: nothing else is expanded."""
        s = self.symbols[self.places[i] : self.places[i + 1]].astype(np.int64)
        ends = np.cumsum(self.length[s])
        k = int(np.searchsorted(ends, j, "right"))
        j, x = j - int(ends[k] - self.length[s[k]]), int(s[k])
        while x > self.vocab:
            a = int(self.left[x - self.vocab - 1])
            x, j = (a, j) if j < self.length[a] else (int(self.right[x - self.vocab - 1]), j - int(self.length[a]))
        return self.end_id if x == self.vocab else x

    def documents(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each document's begin, with the end."""
        ids = self.expanded(self.symbols)
        sums = np.concatenate([[0], np.cumsum(self.length[self.symbols])])
        return ids, sums[self.places]


def slices(texts: list[bytes], most: int = PART_BYTES) -> Iterator[slice]:
    """Parts of a batch of about `most` bytes, so that few words are objects at a time."""
    at, size = 0, 0
    for k, x in enumerate(texts):
        size += len(x)
        if size >= most:
            yield slice(at, k + 1)
            at, size = k + 1, 0
    if at < len(texts):
        yield slice(at, len(texts))


def write_files(docs: DataFrame, path: str, tokenizer: str | None = None) -> None:
    """Write docs (doc_id, text) as frames, in ascending order of doc_id over parts and frames."""
    tokenizer = tokenizer or default_tokenizer()

    def packed(batches):
        from pyspark import TaskContext

        part, enc, before = TaskContext.get().partitionId(), encoder(tokenizer), 0
        ids: list[np.ndarray] = []
        own: list = []
        held = 0

        def frame() -> pa.RecordBatch:
            n = held + len(ids)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([before], pa.int64()), pa.array([len(ids)], pa.int32()), pa.array([n], pa.int64()), pa.array([to_frame(own, ids, enc.vocab)], pa.binary())], ["part", "before", "n_docs", "n_tokens", "frame"])

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for x in slices(texts, 2 * PART_BYTES):
                for doc, found in zip(names[x], enc.ids(texts[x])):
                    own.append(doc)
                    ids.append(found)
                    held += len(found)
                    if held + len(ids) >= SHARD_TOKENS:
                        yield frame()
                        before += held + len(ids)
                        ids, own, held = [], [], 0
        if ids:
            yield frame()

    (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
     .repartitionByRange(F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
     .mapInArrow(packed, FRAMES).write.parquet(path))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, ids of each document, decoded from the frames.

    The driver holds one number for each part, of which there are as many as shuffle partitions, never per document.
    """
    frames = spark.read.schema(FRAMES).parquet(path)
    sums = frames.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()
    starts, total = {}, 0
    for row in sorted(sums):
        starts[row.part] = total
        total += row.n

    def decoded(batches):
        for batch in batches:
            for part, before, data in zip(*(batch.column(c).to_pylist() for c in ("part", "before", "frame"))):
                frame = Frame(data)
                ids, places = frame.documents()
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(places.tolist(), places[1:].tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array(frame.doc_ids, pa.int64()), pa.array(places[:-1] + starts[part] + before, pa.int64()), pa.array(np.diff(places), pa.int64()), pa.array(crc, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(ids.astype(np.int32))),
                ], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return frames.select("part", "before", "frame").mapInArrow(decoded, "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    write_files(table(spark, sf_dir, "documents"), path)
    return read_files(spark, path).drop("ids")

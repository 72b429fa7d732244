"""Words of whole texts as numbers, so that what is known of a word is worked out once by each worker."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import blake2b
from itertools import chain, islice

import numpy as np

MEMO = 150_000


class WordTable:
    """Codes of words and a row of numbers for each. At most MEMO words are kept from one call to the next."""

    def __init__(self, width: int, describe: Callable[[list[bytes]], np.ndarray], kind=np.float32):
        self.width, self.describe, self.kind = width, describe, kind
        self.clear()

    def clear(self) -> None:
        self.code: dict[bytes, int] = {}
        self.room, self.n = np.zeros((1 << 12, self.width), self.kind), 0

    def look_up(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all words of all texts, and where each text's begin, with the end."""
        parts = [x.split() for x in texts]
        new = set().union(*parts) - self.code.keys() if parts else set()
        if self.n + len(new) > MEMO and self.n:
            self.n = min(self.n, MEMO // 2)  # the words seen first are the frequent ones
            self.code = dict(islice(self.code.items(), self.n))
            new = set().union(*parts) - self.code.keys()
        if new:
            words = list(new)
            while self.n + len(words) > len(self.room):
                self.room = np.concatenate([self.room, np.zeros_like(self.room)])
            self.room[self.n : self.n + len(words)] = self.describe(words)
            self.code.update(zip(words, range(self.n, self.n + len(words))))
            self.n += len(words)
        ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))])
        return np.fromiter(map(self.code.__getitem__, chain.from_iterable(parts)), np.int64, int(ends[-1])), ends

    @property
    def rows(self) -> np.ndarray:
        return self.room


SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


LANES = 8
#: For n bytes of a lane, the bits that count.
MASKS = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)


class Cut:
    """The words of texts as places in one run of bytes, none of them an object."""

    def __init__(self, texts: list[bytes]):
        self.raw = b"\n".join([*texts, b""])
        data = np.frombuffer(self.raw, np.uint8)
        space = SPACES[data]
        change = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(space) and not space[0]:
            change = np.concatenate([[0], change])
        self.start, self.stop = change[::2], change[1::2]
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        self.ends = np.searchsorted(self.start, np.concatenate([[0], ends]))
        self.size = self.stop - self.start
        self.view = np.ndarray(len(data), "<u8", self.raw + bytes(8), strides=(1,))
        self.begin = self.view[self.start] & MASKS[np.minimum(self.size, 8)]  # lane 0 of all words

    def lane(self, words: np.ndarray, k: int) -> np.ndarray:
        """Bytes 8 k to 8 k + 7 of the words, which must be longer than 8 k bytes; 0 beyond their end."""
        return self.view[self.start[words] + 8 * k] & MASKS[np.minimum(self.size[words] - 8 * k, 8)]

    def word(self, k: int) -> bytes:
        return self.raw[self.start[k] : self.stop[k]]

    def objects(self, words: np.ndarray) -> list[bytes]:
        """The words, those of 8 * LANES bytes at most being cut from one copy."""
        short = self.size[words] <= 8 * LANES
        some = words[short]
        n = self.size[some] + 1
        ends = np.cumsum(n)
        copy = np.frombuffer(self.raw, np.uint8)[np.repeat(self.start[some] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
        copy[ends - 1] = 10
        found = iter(copy.tobytes().split(b"\n"))
        return [next(found) if s else self.word(k) for s, k in zip(short.tolist(), words.tolist())] if not short.all() else list(found)[:-1]

    def mixed(self, words: np.ndarray) -> np.ndarray:
        """A 64-bit hash of words of 8 * LANES bytes at most: 8 bytes at a time are stirred in by steps that are one to one
        and not linear, so words of one length that differ in one lane only never share it."""
        h = self.size[words].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        left, k = np.arange(len(words)), 0
        while len(left):
            x = (h[left] ^ (self.lane(words[left], k) if k else self.begin[words])) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            h[left] = x ^ (x >> np.uint64(32))
            k += 1
            left = left[self.size[words[left]] > 8 * k]
        return h


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of all texts, and where each text's begin, with the end. Long words: of BLAKE2b."""
    own = Cut(texts)
    short = own.size <= 8 * LANES
    h, some = np.zeros(len(short), np.uint64), np.flatnonzero(short)
    h[some] = own.mixed(some)
    for k in np.flatnonzero(~short).tolist():
        h[k] = int.from_bytes(blake2b(own.word(k), digest_size=8).digest(), "little")
    return h, own.ends


class IdMemo:
    """Ids of words in arrays: some 40 bytes a word, at most `most` words. A word is known by its bytes, not by a hash.

    Words of up to 8 * LANES bytes lie as whole numbers of 8 bytes in one array; a hash gives the slot where a look-up
    begins (open addressing, half the slots free at least), and a word is found where its length and all its bytes
    agree. A step of probing is one step for all words that still look. Longer words are keys of a dict.
    """

    def __init__(self, kind: np.dtype, most: int, bits: int = 21):
        self.kind, self.most, self.bits = np.dtype(kind), most, bits
        self.slot, self.n = np.full(1 << bits, -1, np.int32), 0
        self.key, self.begin, self.bytes = np.zeros(most, np.uint64), np.zeros(most, np.uint64), np.zeros(most, np.int32)
        self.lanes, self.lane_at, self.laid = np.zeros(1 << 12, np.uint64), np.zeros(most, np.int64), 0
        self.at, self.size = np.zeros(most, np.int64), np.zeros(most, np.int32)
        self.ids, self.used = np.zeros(1 << 16, self.kind), 0
        self.long: dict[bytes, int] = {}

    def hashes(self, own: Cut, words: np.ndarray) -> np.ndarray:
        """Where look-ups of words begin; any two words may share one."""
        return own.mixed(words)

    def _same(self, own: Cut, words: np.ndarray, entries: np.ndarray) -> np.ndarray:
        """Whether the words are those of the entries, byte by byte; their lanes 0 are the same."""
        size = own.size[words]
        same = size == self.bytes[entries]
        left, k = np.flatnonzero(same & (size > 8)), 1
        while len(left):
            w, e = words[left], entries[left]
            agree = self.lanes[self.lane_at[e] + k] == own.lane(w, k)
            same[left[~agree]] = False
            k += 1
            left = left[agree & (own.size[w] > 8 * k)]
        return same

    def find(self, own: Cut, words: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The entry of each word of up to 8 * LANES bytes, or -1."""
        out, open_ = np.full(len(h), -1, np.int64), np.arange(len(h))
        place, mask = (h >> np.uint64(64 - self.bits)).astype(np.int64), (1 << self.bits) - 1
        while len(open_):
            e = self.slot[place]
            there = e >= 0
            open_, place, e = open_[there], place[there], e[there]
            hit = self.begin[e] == own.begin[words[open_]]
            hit[hit] = self._same(own, words[open_[hit]], e[hit])
            out[open_[hit]] = e[hit]
            open_, place = open_[~hit], (place[~hit] + 1) & mask
        return out

    def _place(self, entries: np.ndarray) -> None:
        place, mask = (self.key[entries] >> np.uint64(64 - self.bits)).astype(np.int64), (1 << self.bits) - 1
        while len(entries):
            free = self.slot[place] < 0
            self.slot[place[free]] = entries[free]
            lost = self.slot[place] != entries
            entries, place = entries[lost], (place[lost] + 1) & mask

    def shrink(self) -> None:
        """Keep half of the words: those seen first, which are the frequent ones."""
        n = self.n = min(self.n, self.most // 2)
        self.used = int(self.at[n - 1] + self.size[n - 1]) if n else 0
        self.long = {w: e for w, e in self.long.items() if e < n}
        self.laid = int((self.lane_at[:n] + -(-self.bytes[:n] // 8)).max(initial=0))
        self.slot[:] = -1
        self._place(np.flatnonzero(self.bytes[:n] >= 0).astype(np.int32))

    def _grown(self, name: str, least: int) -> np.ndarray:
        while len(getattr(self, name)) < least:
            setattr(self, name, np.concatenate([getattr(self, name), np.zeros_like(getattr(self, name))]))
        return getattr(self, name)

    def add(self, own: Cut, words: np.ndarray, h: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """New and distinct words with their ids."""
        n, m = self.n, len(words)
        self._grown("ids", self.used + len(ids))[self.used : self.used + len(ids)] = ids
        self.size[n : n + m], self.at[n : n + m] = sizes, self.used + np.cumsum(sizes) - sizes
        short = own.size[words] <= 8 * LANES
        need = np.where(short, -(-own.size[words] // 8), 0)
        self.key[n : n + m], self.begin[n : n + m], self.bytes[n : n + m] = h, own.begin[words], np.where(short, own.size[words], -1)
        self.lane_at[n : n + m] = self.laid + np.cumsum(need) - need
        lanes = self._grown("lanes", self.laid + int(need.sum()))
        for k in range(int(need.max(initial=0))):
            some = np.flatnonzero(need > k)
            lanes[self.lane_at[n + some] + k] = own.lane(words[some], k)
        self.long.update((own.word(words[k]), n + k) for k in np.flatnonzero(~short).tolist())
        self.laid, self.used, self.n = self.laid + int(need.sum()), self.used + len(ids), n + m
        self._place((n + np.flatnonzero(short)).astype(np.int32))

    def entries(self, own: Cut, h: np.ndarray) -> np.ndarray:
        """The entry of each word, or -1."""
        out, short = np.full(len(own.size), -1, np.int64), own.size <= 8 * LANES
        some = np.flatnonzero(short)
        out[some] = self.find(own, some, h[some])
        for k in np.flatnonzero(~short).tolist():
            out[k] = self.long.get(own.word(k), -1)
        return out

    def _first(self, own: Cut, h: np.ndarray, miss: np.ndarray) -> np.ndarray:
        """One place for each distinct word of those missed; of short words that share a hash, one."""
        short = own.size[miss] <= 8 * LANES
        some = miss[short]
        long = {own.word(k): k for k in miss[~short][::-1].tolist()}
        return np.concatenate([some[np.unique(h[some], return_index=True)[1]], np.fromiter(long.values(), np.int64, len(long))])

    def texts(self, texts: list[bytes], learn: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """The ids of each text. learn gives sizes and ids of words that aren't known."""
        own = Cut(texts)
        h = np.zeros(len(own.size), np.uint64)
        short = np.flatnonzero(own.size <= 8 * LANES)
        h[short] = self.hashes(own, short)
        entry, shrunk = self.entries(own, h), False
        while len(miss := np.flatnonzero(entry < 0)):  # more than once only if words share a hash, or after shrinking
            first = self._first(own, h, miss)
            if self.n + len(first) > self.most:
                if not shrunk:  # words of these texts may be among those that go
                    self.shrink()
                    entry, shrunk = self.entries(own, h), True
                    continue
                if len(texts) > 1:
                    half = len(texts) // 2
                    return self.texts(texts[:half], learn) + self.texts(texts[half:], learn)
                return [np.concatenate([learn([own.word(k) for k in range(a, min(a + self.most, len(own.size)))])[1] for a in range(0, len(own.size), self.most)])]
            self.add(own, first, h[first], *learn(own.objects(first)))
            entry = self._again(own, h, entry, miss)
        size = self.size[entry].astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(size)])
        flat = self.ids[np.repeat(self.at[entry] - ends[:-1], size) + np.arange(ends[-1])]
        cuts = ends[own.ends]
        return [flat[a:z] for a, z in zip(cuts.tolist(), cuts[1:].tolist())]

    def _again(self, own: Cut, h: np.ndarray, entry: np.ndarray, miss: np.ndarray) -> np.ndarray:
        """entry, with the words missed looked up again."""
        short = miss[own.size[miss] <= 8 * LANES]
        entry[short] = self.find(own, short, h[short])
        for k in miss[own.size[miss] > 8 * LANES].tolist():
            entry[k] = self.long.get(own.word(k), -1)
        return entry


def sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the parts of values; empty parts give 0."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), np.float64), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[ends[1:]] - total[ends[:-1]]


def owners(ends: np.ndarray) -> np.ndarray:
    """The text of each word."""
    return np.repeat(np.arange(len(ends) - 1), np.diff(ends))


def mixed_hash(codes: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of width successive codes, at each start."""
    x = codes.astype(np.uint64) + np.uint64(1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    n = len(x) - width + 1
    h = np.zeros(max(n, 0), np.uint64)
    for k in range(width if n > 0 else 0):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + x[k : k + n]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def repeated_windows(codes: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    """For each text, its words that lie in windows of width words found twice or more in it."""
    n = len(codes)
    out = np.zeros(len(ends) - 1, np.int64)
    if n < width:
        return out
    owner = owners(ends)
    at = np.flatnonzero(owner[: n - width + 1] == owner[width - 1 :])
    h = mixed_hash(codes, width)[at]
    h = h + owner[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    twice = np.zeros(len(s), bool)
    twice[1:] |= same
    twice[:-1] |= same
    start = at[order[twice]]
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, start, 1)
    np.add.at(cover, start + width, -1)
    return sums((np.cumsum(cover[:-1]) > 0).astype(np.int64), ends).astype(np.int64)

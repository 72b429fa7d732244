"""BPE encoding by depth-first traversal of a trie of distinct words, and decoding.

A prefix of a word has exactly one last token: a token t that ends the prefix so that t and the last token of what
comes before t stay two tokens when they are merged alone. Going down the trie, a node's last token follows from those
of its ancestors. Words are visited in sorted order, which is the trie's depth-first order: the stack of last tokens is
kept up to the prefix that a word shares with the one before, so a shared prefix is encoded once. Reading the stack
backwards from a word's end gives its ids. The tokens that may end a prefix are found in a trie of reversed tokens.

Texts are split at white space, which these tokenizers drop, so a word is encoded once by each worker while it stays
in the memo. Only the library's normaliser and pre-tokeniser are used, for words that aren't ASCII; merges are our own.

Cases: null or empty texts have no ids and decode to the empty string. Special tokens within a text become their ids.
Equal and repeated rows are encoded alike; null doc_ids are kept. The memos of words, pieces and pairs are bounded, and a
batch is worked on in parts.
"""

from __future__ import annotations

import json
import re
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import kept, table, text_bytes, trimmed
from ._words import IdMemo
from .token_files import MARK, NOT_PLAIN, PATTERN, cut, default_tokenizer, slices

MEMO, PAIRS = 150_000, 200_000


class TrieEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != "</w>" or PATTERN not in json.dumps(spec["pre_tokenizer"]).replace("\\\\", "\\"):
            raise ValueError(f"{path}: not a BPE file with word ends")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {m: k for k, m in enumerate(merges)}
        self.id = model["vocab"]
        size = max([*self.id.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.token = [""] * size
        for t, i in self.id.items():
            self.token[i] = t
        for t in spec["added_tokens"]:
            self.token[t["id"]] = t["content"]
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.special = {t["content"].encode(): np.array([t["id"]], self.kind).tobytes() for t in spec["added_tokens"]}
        self.split_special = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + b")") if self.special else None
        self.width = [len(t.removesuffix("</w>")) for t in self.token]
        self.inner, self.last = {}, {}
        special = {t["content"] for t in spec["added_tokens"]}
        for t, i in self.id.items():
            if t in special:
                continue
            body, node = (t[:-4], self.last) if t.endswith("</w>") and len(t) > 4 else (t, self.inner)
            for c in reversed(body):
                node = node.setdefault(c, {})
            node[""] = i
        self.fits: dict[int, bool] = {}
        self.edges: dict[tuple[str, bool], list | None] = {}
        self.memo = IdMemo(self.kind, 3 * MEMO)
        self.piece: dict[str, bytes] = {}

    def merged(self, symbols: list[str]) -> tuple[list[str], tuple[str, str] | None]:
        """The merges one at a time, the lowest rank first, then the leftmost; and the last pair that was merged."""
        s, last = list(symbols), None
        while len(s) > 1:
            best = min((self.rank.get(p, 1 << 60), k) for k, p in enumerate(zip(s, s[1:])))
            if best[0] == 1 << 60:
                break
            last = s[best[1]], s[best[1] + 1]
            s[best[1] : best[1] + 2] = [last[0] + last[1]]
        return s, last

    def symbols(self, token: str) -> list[str]:
        if token.endswith("</w>") and len(token) > 4:
            return [*token[:-5], token[-5:]]
        return list(token)

    def edge(self, token: str, right: bool) -> list[tuple[str, int]] | None:
        """What stands at a token's right (or left) end while it is merged from its letters, with the rank of the merge
        that takes it up; None if its letters don't merge into it."""
        key = (token, right)
        if key not in self.edges:
            end, last = self.merged(self.symbols(token))
            if len(end) > 1:
                self.edges[key] = None
            elif last is None:
                self.edges[key] = [(token, 1 << 60)]
            else:
                before = self.edge(last[right], right)
                self.edges[key] = [*before[:-1], (before[-1][0], self.rank[last]), (token, 1 << 60)]
        return self.edges[key]

    def stays(self, a: int, b: int) -> bool:
        """Whether a (-1: nothing) followed by b stays so.

        Merges go up in rank. The symbols at both sides of the border, each until it is taken up, are a short list; the
        border is crossed if a merge of two that stand side by side has a lower rank than what takes up either (on the
        right also an equal one, as the left of equals goes first).
        """
        key = (a + 1) << 32 | b
        if (v := self.fits.get(key)) is None:
            y = self.edge(self.token[b], False)
            x = self.edge(self.token[a], True) if a >= 0 else []
            v = x is not None and y is not None
            if v and x:
                i = j = 0
                while True:
                    (p, until), (q, till) = x[i], y[j]
                    m = self.rank.get((p, q))
                    if m is not None and m < until and m <= till:
                        v = False
                        break
                    if until == till == 1 << 60:
                        break
                    if until <= till:
                        i += 1
                    else:
                        j += 1
            if len(self.fits) > PAIRS:
                self.fits.clear()
            self.fits[key] = v
        return v

    def encode_sorted(self, words: list[str]) -> list[list[int]]:
        """ids of distinct words of byte letters, in sorted order: the depth-first traversal."""
        out, stack, before = [], [], ""
        fits, stays, inner, last, width = self.fits, self.stays, self.inner, self.last, self.width
        for w in words:
            n, k = len(w), 0
            for x, y in zip(w, before):
                if x != y:
                    break
                k += 1
            del stack[min(k, len(stack), n - 1) :]
            for d in range(len(stack), n):
                node, p = (inner if d < n - 1 else last), d
                while True:
                    node = node.get(w[p])
                    if node is None:
                        raise ValueError(f"no token ends {w[: d + 1]!r}")
                    if (t := node.get("")) is not None:
                        a = stack[p - 1] if p else -1
                        v = fits.get((a + 1) << 32 | t)
                        if v or v is None and stays(a, t):
                            break
                    p -= 1
                    if p < 0:
                        raise ValueError(f"no token ends {w[: d + 1]!r}")
                stack.append(t)
            ids, d = [], n
            while d:
                t = stack[d - 1]
                ids.append(t)
                d -= width[t]
            ids.reverse()
            out.append(ids)
            stack.pop()  # the word's end isn't a prefix of other words
            before = w
        return out

    def pieces(self, word: bytes) -> list[str]:
        """A word's pieces in byte letters, by the library's normaliser and pre-tokeniser."""
        text = self.own.normalizer.normalize_str(word.decode("utf-8", "replace"))
        return [x for x, _ in self.own.pre_tokenizer.pre_tokenize_str(text)]

    def learn(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of words that aren't in the memo."""
        joined = b"\n".join(new).decode()
        odd: dict[bytes, list] = {}
        plain_words = new
        if NOT_PLAIN.search(joined):
            for w in (x.encode() for x in joined.split("\n") if NOT_PLAIN.search(x)):
                odd[w] = [x if x in self.special else self.pieces(x) for x in (self.split_special.split(w) if self.split_special else [w]) if x]
            plain_words = [w for w in new if w not in odd]
            joined = b"\n".join(plain_words).decode()
        plain = cut(joined) if plain_words else []
        wanted = {*plain, *(p for parts in odd.values() for x in parts if not isinstance(x, bytes) for p in x)}
        wanted.discard(MARK)
        if len(self.piece) > MEMO:
            self.piece = dict(islice(self.piece.items(), MEMO // 2))
        words = sorted(wanted - self.piece.keys())
        self.piece.update(zip(words, (np.array(ids, self.kind).tobytes() for ids in self.encode_sorted(words))))
        found, start, piece = [], 0, self.piece
        for k, p in enumerate(plain):
            if p == MARK:
                found.append(piece[plain[start]] if k == start + 1 else b"".join([piece[x] for x in plain[start:k]]))
                start = k + 1
        if odd:
            rest = iter(found)
            found = [b"".join(self.special[x] if isinstance(x, bytes) else b"".join([piece[p] for p in x]) for x in odd[w]) if w in odd else next(rest) for w in new]
        return np.fromiter(map(len, found), np.int64, len(found)) // self.kind.itemsize, np.frombuffer(b"".join(found), self.kind)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        return self.memo.texts(texts, self.learn)

    def decode(self, ids: np.ndarray) -> str:
        """Tokens joined by a space, as for a tokenizer file without a decoder."""
        return " ".join(map(self.token.__getitem__, ids.tolist()))


def trie_encoder(path: str) -> TrieEncoder:
    return kept(("trie_bpe", path), lambda: TrieEncoder(path))


def encode_and_decode(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, ids, decoded of each row of docs (doc_id, text)."""
    tokenizer = tokenizer or default_tokenizer()

    def work(batches):
        enc = trie_encoder(tokenizer)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for x in slices(texts):
                ids = enc.encode(texts[x])
                ends = np.concatenate([[0], np.cumsum([len(i) for i in ids])])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[x.start : x.stop], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids).astype(np.int32))), pa.array([enc.decode(i) for i in ids], pa.string()),
                ], ["doc_id", "ids", "decoded"])
        trimmed()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(work, "doc_id long, ids array<int>, decoded string")


def digests(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_and_decode(table(spark, sf_dir, "documents")))

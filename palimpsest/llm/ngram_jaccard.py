"""N-gram Jaccard join: which texts share enough of their word shingles, by a size-aware heavy-light join.

Texts with equal shingle sets are one class; the join is over classes, of which only the connected components are asked.

Sieve. The shingles of a set are dealt to cells by ranges of their hash, to more cells than a linked pair can differ in
shingles (bands of sizes, so that both sets have equally many cells). So a linked pair agrees in many whole cells, and
a class that has too few cells in common with any other links with none. What is left are the candidates.

Light sets, up to a boundary in size, write all subsets of the size that two sets of given sizes must share; those that
meet in a subset are linked, with no comparison, each to the least of them. Heavy sets scan inverted lists: each candidate's
shingles, lists of one being known exactly. A set with too many shingles of its own goes; the others stand in the lists
of as many of their rarest shingles as a link could miss and one more, light sets near the boundary too. The boundary
is where the cost is least: rows of subsets against rows of lists, and sets moved for each partner that the sieve's
lists hold on average.

Not all pairs of a list are written. In rounds, every class tries the nearest of its lists' pivots (under seeded orders,
so near copies have the same ones) and components grow by the links found. Then all pairs of one list that are still in different
components meet: once, at their first list in common, and only if sizes, places and parities allow the overlap needed
(a bit for each of 512 slots of a hash, whether an odd number of shingles falls into it: exact). So every pair that could
link is either compared or already connected, while a group of thousands of copies costs a few comparisons for each.

Shingles are 64-bit mixes of 64-bit hashes of their words, which no polynomial tells alike (BLAKE2b where words are long). A
class is named by 64 bits of a digest of its set, and another 64 bits show where two classes share a name; those get
others. Subsets are matched by 128 bits.

Tables that later steps need are written to the shared folder, so a lost executor costs its tasks only. Nothing by
document, class or link is collected.

Cases: a null text, or one without words, has no shingles and links with nothing, not even its like; its component is
its own doc_id. A text with fewer words than a shingle is one shingle of all its words. Repeated rows are each
returned. Null doc_ids are never a component's smallest unless all are null. An empty table gives none. Very long texts
are whole: cells and lists grow with the set.
"""

from __future__ import annotations

import uuid
from functools import lru_cache
from hashlib import blake2b
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import WORD, dropped, released, table, text_bytes, trimmed, written
from ._words import word_hashes
from .token_files import slices

#: Largest size that may be light; rows that a join may send to all tasks, counted first; words of 64 parity bits.
LARGEST_LIGHT, SMALL, PARITY = 30, 50_000, 8
#: Orders of pivots in each round, and how many of a class's earlier lists an entry carries.
PIVOT_GROUPS, EARLIER = (1, 16, 16), 16
#: Rows that are shuffled cost 1; a set that is moved to be compared costs so many, and this for each shingle.
MOVED, MOVED_SHINGLE = 4.0, 0.4


# --- sizes -----------------------------------------------------------------------------------------------------
def up(a: int, b: int) -> int:
    return -(-a // b)


def needed(a: int, b: int, percent: int) -> int:
    """The overlap that sets of a and b shingles must have."""
    return up(percent * (a + b), 100 + percent)


def partners(s: int, most: int, percent: int) -> list[tuple[int, int, int]]:
    """(a, b, overlap) of the pairs of sizes that a light set of s shingles can be in, both at most `most`."""
    low, high = up(percent * s, 100), min(most, 100 * s // percent)
    return [(min(s, t), max(s, t), needed(s, t, percent)) for t in range(max(1, low), high + 1) if needed(s, t, percent) <= min(s, t)]


def probe_length(s: int, percent: int) -> int:
    """Of a set's shingles in any fixed order, the first so many hold one of each linked set's."""
    return s - up(percent * s, 100) + 1


def boundary(found: dict[int, tuple[int, float]], percent: int) -> int:
    """The light sets' largest size: where the join costs least. found: of each size, candidates and partners of all of
    them in the sieve's lists."""

    def cost(x: int) -> float:
        light = sum(2 * n * sum(comb(s, c) for _, _, c in partners(s, x, percent)) for s, (n, _) in found.items() if s <= x)
        listed = {s: v for s, v in found.items() if 100 * s >= percent * (x + 1)}
        return light + sum(n * (2 * s + 2 * probe_length(s, percent)) + met * (MOVED + MOVED_SHINGLE * s) * 2 for s, (n, met) in listed.items())

    return min(range(LARGEST_LIGHT + 1), key=lambda x: (cost(x), x))


@lru_cache(maxsize=8)
def band_tops(percent: int, most: int) -> np.ndarray:
    """Largest sizes of the bands up to `most`. A pair belongs to its larger set's band; a set and its largest partner
    are in the same band or in two that follow each other."""
    tops, ratio = [6], max(1.6, 100 / percent)
    while tops[-1] < most:
        tops.append(max(tops[-1] + 1, up(int(1000 * tops[-1] * ratio), 1000)))
    return np.array(tops)


def apart(a, b, percent: int):
    """At most so many shingles are in one of two linked sets only."""
    return (a + b) * (100 - percent) // (100 + percent)


def cells(s: np.ndarray, percent: int) -> list[tuple[int, np.ndarray]]:
    """For each of a set's one or two bands: how many cells it must share to be linked with any, and its cells' keys."""
    n, out = len(s), []
    largest = 100 * n // percent
    tops = band_tops(percent, 1 << max(8, (2 * largest).bit_length()))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(s * M3))])
    for band in sorted({int(np.searchsorted(tops, n)), int(np.searchsorted(tops, largest))}):
        top = int(tops[band])
        m = up(23 * int(apart(top, top, percent)), 20) + 2
        at = np.concatenate([[0], np.searchsorted(s, np.arange(1, m, dtype=np.uint64) * np.uint64(((1 << 64) - 1) // m)), [n]])
        full = at[1:] > at[:-1]
        keys = mix(total[at[1:]] - total[at[:-1]] + (np.arange(m, dtype=np.uint64) + np.uint64(band << 32)) * M1)[full]
        out.append((m - int(apart(n, min(largest, top), percent)) - int((~full).sum()), keys))
    return out


# --- shingles --------------------------------------------------------------------------------------------------
M1, M2, M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    word, ends = word_hashes([x.lower() for x in texts])
    n = len(word)
    h = np.zeros(max(n - width + 1, 0), np.uint64)
    for k in range(width if len(h) else 0):
        h = mix(h * M3 + word[k : k + len(h)])
    out, places = [], ends.tolist()
    for a, z in zip(places, places[1:]):
        if z - a >= width:
            out.append(np.unique(h[a : z - width + 1]))
        elif z > a:
            x = np.full(1, z - a, np.uint64)
            for w in word[a:z]:
                x = mix(x * M3 + w)
            out.append(x)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def digest(s: np.ndarray) -> tuple[int, int]:
    d = blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def parity(s: np.ndarray) -> np.ndarray:
    """A bit for each of 64 * PARITY slots of a hash: whether an odd number of shingles falls into it."""
    bits = np.bincount((s >> np.uint64(9) & np.uint64(64 * PARITY - 1)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(bits).view("<i8")


def ragged(rows: list[np.ndarray], kind: str = "<i8") -> pa.ListArray:
    """Arrays of whole numbers as a list column."""
    ends = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(kind)))


SETS = "doc_id long, n_shingles long, class long, second long, text_hash long, first int, need array<long>, cells array<long>"


def set_table(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """A row for each document with its class. Of documents of one class, the first of each task has the cells: `first`
    so many in its own band, the others in the next."""

    def work(batches):
        seen = set()
        none = np.zeros(0, np.int64)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for x in slices(texts):
                sets = shingle_sets(texts[x], width)
                names = [digest(s) if len(s) else (None, None) for s in sets]
                first, need, keys = [], [], []
                for s, name in zip(sets, names):
                    own = []
                    if len(s) and name not in seen:
                        own = cells(s, percent)
                        seen.add(name)
                    first.append(len(own[0][1]) if own else None)
                    need.append(np.array([k for k, _ in own], np.int64))
                    keys.append(np.concatenate([k for _, k in own]).view(np.int64) if own else none)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[x.start : x.stop], pa.array(list(map(len, sets)), pa.int64()), pa.array([a for a, _ in names], pa.int64()), pa.array([b for _, b in names], pa.int64()),
                    batch.column(2)[x.start : x.stop], pa.array(first, pa.int32()), ragged(need), ragged(keys),
                ], ["doc_id", "n_shingles", "class", "second", "text_hash", "first", "need", "cells"])
        trimmed()

    return docs.mapInArrow(work, SETS)


# --- candidates ------------------------------------------------------------------------------------------------
def small(df: DataFrame) -> DataFrame:
    """df, to be sent to all tasks of a join if it has at most SMALL rows (all of them narrow), which is counted here."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def sifted(sets: DataFrame) -> DataFrame:
    """class, met of the candidates: classes that share as many cells with others as any link needs.

    met: with how many others on average over their cells. A class that several tasks have written counts once.
    """
    given = sets.filter("first IS NOT NULL")
    entry = given.select("class", "first", F.posexplode("cells").alias("at", "key"))
    shared = written(entry.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("low"), F.max("class").alias("high")).filter("low <> high").select("key", "n"), "keys")
    released(sets.sparkSession)  # one shuffle of all cells at a time
    counted = entry.join(shared, "key").groupBy("class", (F.col("at") >= F.col("first")).alias("next")).agg(F.count(F.lit(1)).alias("shared"), F.sum("n").alias("n"))
    written_by = given.groupBy("class").agg(F.count(F.lit(1)).alias("copies"), F.min("need").alias("need"))
    enough = F.col("shared") >= F.col("copies") * F.element_at("need", F.col("next").cast("int") + 1)
    found = counted.join(written_by, "class").filter(enough).select("class", (F.col("n") / F.col("shared") - 1).alias("met"))
    empty = given.filter(F.exists("need", lambda x: x <= 0)).select("class", F.lit(0.0).alias("met"))  # so many empty cells that those could be all they share
    return found.unionByName(empty).groupBy("class").agg(F.max("met").alias("met"))


def members(docs: DataFrame, chosen: DataFrame, width: int) -> DataFrame:
    """class, n, members, parity, from one text of each class of chosen (class, of_id, of_hash)."""

    def work(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for x in slices(texts):
                sets = shingle_sets(texts[x], width)
                yield pa.RecordBatch.from_arrays([
                    batch.column(1)[x.start : x.stop], pa.array(list(map(len, sets)), pa.int64()), ragged(sets), ragged([parity(s) for s in sets]),
                ], ["class", "n", "members", "parity"])

    own = docs.join(small(chosen), F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_hash") == F.col("of_hash"))).select("text", "class")
    return own.mapInArrow(work, "class long, n long, members array<long>, parity array<long>")


def light_links(sets: DataFrame, most: int, percent: int) -> DataFrame:
    """a, b: each light set (of at most `most` shingles) beside the least of those that have a subset with it.

    A subset stands for two sizes: where they differ, sets of both must have it, and then all are connected.
    """

    def work(batches):
        for batch in batches:
            low, high, names, sizes = [], [], [], []
            for name, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = np.array(s, np.int64).view(np.uint64)
                one, other = mix(s * M3), mix(s * M1 + M2)
                for a, b, c in partners(len(s), most, percent):
                    gone = np.array(list(combinations(range(len(s)), len(s) - c)), np.int64).reshape(comb(len(s), c), len(s) - c)
                    low.append(mix((one.sum(dtype=np.uint64) - one[gone].sum(1, dtype=np.uint64)) * M3 + np.uint64(a * 1000 + b)))
                    high.append(mix((other.sum(dtype=np.uint64) - other[gone].sum(1, dtype=np.uint64)) * M1 + np.uint64(a * 1000 + b)))
                    names.append(np.full(len(gone), name, np.int64))
                    sizes.append(np.full(len(gone), 0 if a == b else len(s), np.int32))
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(low).view(np.int64)), pa.array(np.concatenate(high).view(np.int64)), pa.array(np.concatenate(names)), pa.array(np.concatenate(sizes))], ["k", "l", "class", "size"])

    subsets = written(sets.filter(F.col("n") <= most).select("class", "members").mapInArrow(work, "k long, l long, class long, size int"), "subsets")
    shared = subsets.groupBy("k", "l").agg(F.min("class").alias("b"), F.max("class").alias("high"), F.min("size").alias("least"), F.max("size").alias("most")).filter("b <> high AND (most = 0 OR least <> most)").select("k", "l", "b")
    return subsets.join(shared, ["k", "l"]).filter("class <> b").select(F.col("class").alias("a"), "b").distinct()


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """class, n, parity, before, keys: of each set that may link, its rarest shared shingles in order of rarity, after
    `before` shingles that no other set has."""
    own = sets.select("class", F.explode("members").alias("key"))
    shared = own.groupBy("key").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    ranked = own.join(shared, "key").groupBy("class").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("own"))
    least = F.expr(f"({percent} * n + 99) div 100")
    joined = sets.select("class", "n", "parity").join(ranked, "class").withColumn("before", (F.col("n") - F.size("own")).cast("int")).filter(F.size("own") >= least)
    return joined.select("class", "n", "parity", "before", F.transform(F.slice("own", F.lit(1), (F.col("n") - least + 1 - F.col("before")).cast("int")), lambda x: x["key"]).alias("keys"))


def may_link(percent: int, x: str = "x", y: str = "y"):
    """Whether entries x and y of one list may belong to linked sets, by their sizes and places."""
    sx, sy = F.col(f"{x}.size"), F.col(f"{y}.size")
    left = F.least(sx - F.col(f"{x}.place"), sy - F.col(f"{y}.place")) + 1
    return (100 * F.least(sx, sy) >= percent * F.greatest(sx, sy)) & (left * (100 + percent) >= percent * (sx + sy))


def compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets are linked."""

    def work(batches):
        for batch in batches:
            keep = []
            x, y = (batch.column(k) for k in (2, 3))
            xs, ys = (c.flatten().to_numpy().view(np.uint64) for c in (x, y))
            xe, ye = (np.concatenate([[0], np.cumsum(c.value_lengths().to_numpy())]).tolist() for c in (x, y))
            for k in range(len(x)):
                p, q = xs[xe[k] : xe[k + 1]], ys[ye[k] : ye[k + 1]]
                if len(p) > len(q):
                    p, q = q, p
                both = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    own = lambda k: sets.select(F.col("class").alias(k), F.col("members").alias(f"set_{k}"))
    return own("a").join(small(pairs.select("a", "b")), "a").join(own("b"), "b").select("a", "b", "set_a", "set_b").mapInArrow(work, "a long, b long")


def united(edges: DataFrame) -> DataFrame:
    """class, component of at most SMALL edges (a, b), in one task."""

    def work(batches):
        of: dict[int, int] = {}

        def root(x: int) -> int:
            while (up_ := of.setdefault(x, x)) != x:
                of[x] = x = of[up_] = of.setdefault(up_, up_)
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(a), root(b)
                if a != b:
                    of[max(a, b)] = min(a, b)
        names = list(of)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([root(x) for x in names], pa.int64())], ["class", "component"])

    return edges.select("a", "b").coalesce(1).mapInArrow(work, "class long, component long")


def components(edges: DataFrame, name: str = "links") -> DataFrame:
    """class, component of every class in edges (a, b).

    Each step contracts every class into its least neighbour, until SMALL edges are left, which one task unites.
    """
    edges, known = edges.filter("a <> b"), None
    while True:
        last = edges.limit(SMALL + 1).count() <= SMALL
        if last:
            step = united(edges).select(F.col("class").alias("a"), F.col("component").alias("to"))
        else:
            both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            step = both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("to"))
        step = written(step, name)
        known = step.select(F.col("a").alias("class"), F.col("to").alias("component")) if known is None else written(known.join(step, known["component"] == step["a"], "left").select("class", F.coalesce("to", "component").alias("component")), name)
        if last:
            return known
        to = lambda k: step.select(F.col("a").alias(k), F.col("to").alias(f"to_{k}"))
        edges = written(edges.join(to("a"), "a").join(to("b"), "b").filter("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), name)


def spread(lists: DataFrame, known: DataFrame | None) -> DataFrame:
    """key, x, parity, earlier of each list that a class stands in: x has its class, size, place and component, which is
    joined before classes are spread; earlier, at most EARLIER of its lists before this one."""
    named = lists.withColumn("component", F.col("class")) if known is None else lists.join(small(known), "class", "left").withColumn("component", F.coalesce("component", "class"))
    entry = named.select("class", "n", "before", "component", "parity", "keys", F.posexplode("keys").alias("at", "key"))
    earlier = F.slice("keys", F.greatest(F.lit(1), F.col("at") + 1 - EARLIER), F.least(F.col("at"), F.lit(EARLIER)))
    return entry.select("key", F.struct("class", F.col("n").alias("size"), (F.col("before") + F.col("at") + 1).alias("place"), "component").alias("x"), "parity", earlier.alias("earlier"))


def heads(entry: DataFrame, seed: int, groups: int) -> DataFrame:
    """Of each list that still holds several components, two pivots: the first classes in two of 2 * `groups` seeded
    orders. With one group, all lists have the same orders and near copies the same pivots."""
    order = lambda k: F.xxhash64(F.lit(2 * seed + k), F.pmod("key", F.lit(groups)), "x.class")
    first = [F.min(F.struct(order(k).alias("order"), "x", "parity")).alias(f"y{k}") for k in (0, 1)]
    ends = entry.groupBy("key").agg(F.min("x.component").alias("low"), F.max("x.component").alias("high"), *first)
    return ends.filter("low <> high").select("key", "y0", "y1")


def differing(x: str, y: str):
    """At most the number of shingles that are in one of two sets only, from their parities."""
    return sum((F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(PARITY)), F.lit(0))


def near(percent: int, x: str, y: str):
    """Whether entries x and y (x, parity) of one list may belong to linked sets of different components."""
    sizes = F.col(f"{x}x.size") + F.col(f"{y}x.size")
    others = F.col(f"{x}x.component") != F.col(f"{y}x.component")
    return others & may_link(percent, f"{x}x", f"{y}x") & (differing(f"{x}parity", f"{y}parity") * (100 + percent) <= (100 - percent) * sizes)


def nearest_pivots(entry: DataFrame, live: DataFrame, percent: int) -> DataFrame:
    """a, b: each class with that of its lists' pivots whose parity is nearest, of those that it may be linked with."""
    best = F.least(*(F.when(near(percent, "", f"y{k}."), F.struct(differing("parity", f"y{k}.parity").alias("d"), F.col(f"y{k}.x.class").alias("b"))) for k in (0, 1)))
    met = entry.select("key", "x", "parity").join(live, "key").select(F.col("x.class").alias("a"), best.alias("best")).filter("best IS NOT NULL")
    return met.groupBy("a").agg(F.min("best").alias("best")).select("a", F.col("best.b").alias("b"))


def remaining(entry: DataFrame, live: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of classes of different components that may link, each at its first list in common (of the
    EARLIER lists before; a pair that meets again is merged)."""
    own = written(entry.join(live.select("key"), "key"), "remaining")
    meet = (F.col("p.key") == F.col("q.key")) & (F.col("p.x.class") < F.col("q.x.class")) & near(percent, "p.", "q.") & ~F.arrays_overlap("p.earlier", "q.earlier")
    return own.alias("p").join(own.alias("q"), meet).select(F.col("p.x.class").alias("a"), F.col("q.x.class").alias("b")).distinct()


def connected(lists: DataFrame, sets: DataFrame, links: DataFrame | None, percent: int) -> DataFrame | None:
    """class, component of the classes that links (a, b: those given, and those that lists yield) connect."""
    known = None if links is None else components(links)
    for k, groups in enumerate((*PIVOT_GROUPS, 0)):
        entry = spread(lists, known)
        live = written(heads(entry, k, max(groups, 1)), "heads")
        if live.isEmpty():
            break
        tried = written(nearest_pivots(entry, live, percent) if groups else remaining(entry, live, percent), "tried")
        found = written(compared(tried, sets, percent), "found")
        dropped(live)
        if not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            known = components(links)
    return known


def linked_classes(docs: DataFrame, sets: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame | None:
    """class, component of classes that are linked with others; None if there are none."""
    spark = docs.sparkSession
    candidates = written(sifted(sets).join(classes, "class").select("class", "met", F.col("n_shingles").alias("n"), F.col("row.doc_id").alias("of_id"), F.col("row.text_hash").alias("of_hash")), "candidates")
    released(spark)
    if candidates.isEmpty():
        return None
    sizes = candidates.filter(F.col("n") <= 2 * LARGEST_LIGHT).groupBy("n").agg(F.count(F.lit(1)).alias("k"), F.sum("met").alias("met")).collect()
    light = boundary({r.n: (r.k, r.met) for r in sizes}, percent)
    own = written(members(docs, candidates.select("class", "of_id", "of_hash"), width).dropDuplicates(["class"]), "members")
    links = written(light_links(own, light, percent), "light") if light else None
    if links is not None and links.isEmpty():
        links = None
    heavy = own.filter(100 * F.col("n") >= percent * (light + 1))
    lists = written(prefixes(heavy, percent), "lists")
    released(spark)
    known = connected(lists, own, links, percent)
    dropped(own)
    return known


def prepared(docs: DataFrame) -> DataFrame:
    """doc_id, text (bytes), text_hash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).withColumn("text_hash", F.xxhash64("text"))


def class_table(sets: DataFrame) -> DataFrame:
    """A row for each class; low <> high where two classes share a name."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("row")
    return sets.filter("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("least"), F.min("second").alias("low"), F.max("second").alias("high"), F.min("n_shingles").alias("n_shingles"), least)


def named(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """sets with one class for each name, and the classes. Names that two classes share are replaced, again and again;
    each time all but one in 2**64 of them are told apart."""
    for again in range(8):
        classes = written(class_table(sets), "classes")
        clash = classes.filter("low <> high").select("class")
        if clash.isEmpty():
            return sets, classes
        own = sets.join(small(clash.withColumn("clash", F.lit(True))), "class", "left")
        sets = written(own.withColumn("class", F.when(F.col("clash"), F.xxhash64(F.lit(again), "class", "second")).otherwise(F.col("class"))).select(*sets.columns), "sets")
    raise RuntimeError("classes can't be told apart")


def joined(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, text_hash, component, component_id of each row of docs (doc_id, text).

    component names the group of linked texts, also where ids are null or repeated; it is null without shingles.
    """
    docs = prepared(docs)
    sets, classes = named(written(set_table(docs, width, percent), "sets"))
    known = linked_classes(docs, sets, classes, width, percent)
    if known is None:
        own = classes.select("class", F.col("class").alias("component"), F.col("least").alias("component_id"))
    else:
        of = classes.join(small(known), "class", "left").select("class", "least", F.coalesce("component", "class").alias("component"))
        least = of.groupBy("component").agg(F.min("least").alias("component_id"))
        own = of.select("class", "component").join(least, "component").select("class", "component", "component_id")
    own = written(own, "own")
    return sets.select("doc_id", "n_shingles", "class", "text_hash").join(own, "class", "left").select("doc_id", "n_shingles", "text_hash", "component", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def deduplicated(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """docs with one row of each group of linked texts, the one of the smallest doc_id, and all rows without shingles.

    Columns of docs stay as they are, whatever their names.
    """
    found = written(joined(docs, width, percent).select("doc_id", "text_hash", "component"), "groups")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash"))
    mark = uuid.uuid4().hex
    own_id, own_hash, stay_id, stay_hash = (f"{name}_{mark}" for name in ("own_id", "own_hash", "stay_id", "stay_hash"))
    stay = found.filter("component IS NOT NULL").groupBy("component").agg(first.alias("r")).select(F.col("r.doc_id").alias(stay_id), F.col("r.text_hash").alias(stay_hash))
    named_ = docs.withColumn(own_id, F.col("doc_id").cast("long")).withColumn(own_hash, F.xxhash64(text_bytes()))
    blank = docs.filter(~F.coalesce(F.col("text").rlike(WORD), F.lit(False)))
    rest = named_.join(stay, F.col(own_id).eqNullSafe(F.col(stay_id)) & (F.col(own_hash) == F.col(stay_hash)))
    repeated = found.filter("component IS NOT NULL").groupBy("doc_id", "text_hash").count().filter("count > 1")
    if not repeated.isEmpty():
        rest = rest.dropDuplicates([own_id, own_hash])
    return rest.select(*docs.columns).unionByName(blank)


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents"), width=4, percent=85).select("doc_id", "n_shingles", "component_id")

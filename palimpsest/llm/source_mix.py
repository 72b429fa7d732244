"""Mixing sources to target weights by Sainte-Lague apportionment.

The words of a source form a stream: its documents in a seeded order. The stream is cut into blocks of BLOCK words.
All blocks of the mix are dealt out one by one to the source with the highest quotient weight / (2 seats + 1); as the
method never takes a seat back when there are more seats, the seats up to a shard's end less those up to its start are
the shard's integer quotas. Then the blocks are selected: a seeded bijection of a source's block numbers is its order of
reading, pass by pass, and each shard takes the next blocks of it, as many as its quota. No block is listed or sorted: a
document knows the blocks that it reaches into, each block its turn, and each turn the shard whose quota it falls in.

Sources whose target is below FINE blocks are dealt out among themselves in blocks of one word, so that they too come
near their targets.

The driver holds one row for each source, never for documents; the plan is sent to all tasks if it has at most SMALL
rows and joined by a shuffle beyond. A source's stream offsets come from sums by (source, bucket) with buckets of about
BUCKET_ROWS documents, and of those by groups of GROUP buckets, so that a source with a third of all rows is spread over
many tasks at both levels.

Cases: a null text has size 0; documents of size 0 are never taken. Null sources are one source, last in order. Equal
and repeated rows each count. If all sizes are 0, or the table is empty, nothing is taken and targets are 0. Weights
repeat in the order of the sources' code points. Targets stop at CAP times the source's size.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import WORD, table, trimmed, written

BLOCK, CAP, SHARDS, SEED, BUCKET_ROWS, GROUP, FINE, SMALL = 64, 3, 64, 20_240_601, 1000, 1000, 32, 10_000
WEIGHTS = (1, 2, 3)


def targets(sizes: list[int], weights: list[float], cap: float = CAP) -> list[float]:
    """Shares of the sum of sizes by weight; what lies above cap times a size is shared again until none does."""
    out, open_ = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0]
    left = float(sum(sizes))
    while open_:
        share = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] * share > cap * sizes[i]]
        if not full:
            for i in open_:
                out[i] = weights[i] * share
            break
        for i in full:
            out[i] = float(cap * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def seats(weights: np.ndarray, n: int, most: np.ndarray) -> np.ndarray:
    """Sainte-Lague: n seats by highest quotients weight / (2 seats + 1), ties to the earlier, at most most[i] each."""
    n, w = min(n, int(most[weights > 0].sum())), weights.astype(float)
    low, high = 0.0, float(2 * (n + len(w) + 1) / max(w.max(), 1e-300)) if len(w) else 0.0
    at = lambda x: np.minimum(np.floor(w * x + 0.5).astype(np.int64), most)  # noqa: E731  seats at the multiplier x
    while at(high).sum() < n:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if at(mid).sum() <= n else (low, mid)
    got = at(low)
    while got.sum() < n:
        quotient = np.where((got < most) & (w > 0), w / (2 * got + 1), -1.0)
        got[int(np.argmax(quotient))] += 1
    return got


def shard_quotas(weights: np.ndarray, n: int, most: np.ndarray, shards: int = SHARDS) -> np.ndarray:
    """quotas[shard, source], whole blocks; each column sums to the source's seats."""
    ends = [seats(weights, n * (k + 1) // shards, most) for k in range(shards)]
    return np.diff(np.stack([np.zeros(len(weights), np.int64), *ends]), axis=0)


def source_plan(sums: list[tuple], seed: int = SEED, block: int = BLOCK) -> list[tuple]:
    """sums: (source, size, rows). One row for each source, as in PLAN; turns: the turns at which the shards' quotas end."""
    order = sorted(sums, key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [int(r[1]) for r in order]
    want = targets(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(order))])
    fine = np.array(want) < FINE * block
    widths = np.where(fine, 1, block)
    blocks = -(-np.array(sizes, np.int64) // widths)
    quotas, rows = np.zeros((SHARDS, len(order)), np.int64), []
    for some, width in ((np.flatnonzero(fine), 1), (np.flatnonzero(~fine), block)):
        own = np.array(want)[some]
        if own.any():
            quotas[:, some] = shard_quotas(own, round(own.sum() / width), CAP * blocks[some])
    turns = np.cumsum(quotas, axis=0)
    for i, (source, size, n_rows) in enumerate(order):
        n, got = int(blocks[i]), int(turns[-1, i])
        mark = zlib.crc32(f"{seed}:{source}".encode())
        step = max(1, min(int(n * 0.6180339887), 1 << 20)) + mark % 97
        while math.gcd(step, max(n, 1)) != 1:
            step += 1
        rows.append((i, source, int(size), want[i], int(widths[i]), n, got // n if n else 0, step, mark % max(n, 1), 1 + int(n_rows) // BUCKET_ROWS, turns[:, i].tolist()))
    return rows


PLAN = "source_no int, source string, source_size long, target double, width long, blocks long, passes long, step long, shift long, buckets long, turns array<long>"


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source, size and the seeded number that orders documents; row holds all columns of docs."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    own = docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), F.struct(*docs.columns).alias("row"), "text")
    return own.withColumn("mix_key", F.xxhash64(F.lit(seed), "doc_id", "size", F.xxhash64("text"))).drop("text")


def mixed(docs: DataFrame, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """docs (sized()) with source_size, target, taken, passes, extra, picks.

    picks: the document's part in the blocks selected, as (shard, pass, from, to) with [from, to) in its words; taken is
    their sum. extra: the ranges of the last pass, which reads some blocks only; the passes before read all.
    """
    spark = docs.sparkSession
    sums = docs.groupBy("source").agg(F.sum("size"), F.count(F.lit(1))).collect()
    rows = source_plan([tuple(r) for r in sums], seed, block)
    plan = spark.createDataFrame(rows, PLAN).withColumnRenamed("source", "plan_source")
    if len(rows) <= SMALL:
        plan = F.broadcast(plan)
    dealt = docs.join(plan, docs["source"].eqNullSafe(plan["plan_source"])).drop("plan_source").withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "mix_key"), F.col("buckets")))
    sums = dealt.groupBy("source_no", "bucket").agg(F.sum("size").alias("bucket_size"))
    earlier = lambda c, *by: F.coalesce(F.sum(c).over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = written(sums.withColumn("part", F.floor(F.col("bucket") / GROUP)), "buckets")
    parts = sums.groupBy("source_no", "part").agg(F.sum("bucket_size").alias("part_size")).withColumn("part_before", earlier("part_size", "source_no", "part")).drop("part_size")
    before = sums.withColumn("inside", earlier("bucket_size", "source_no", "part", "bucket")).join(parts, ["source_no", "part"]).select("source_no", "bucket", (F.col("part_before") + F.col("inside")).alias("before"))
    own = Window.partitionBy("source_no", "bucket").orderBy("mix_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.join(before, ["source_no", "bucket"]).withColumn("at", F.col("before") + F.coalesce(F.sum("size").over(own), F.lit(0)))
    end = F.col("at") + F.col("size")
    some = F.when(F.col("size") > 0, F.sequence(F.expr("at div width"), F.expr("(at + size - 1) div width"))).otherwise(F.array().cast("array<bigint>"))
    turn = lambda p, j: p * F.col("blocks") + F.pmod(j * F.col("step") + F.col("shift"), F.col("blocks"))
    part = lambda p, j: F.struct(turn(p, j).alias("turn"), p.alias("pass"), F.greatest(j * F.col("width") - F.col("at"), F.lit(0)).alias("from"), (F.least((j + 1) * F.col("width"), end) - F.col("at")).alias("to"))
    all_parts = F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), F.col("passes")), lambda p: F.transform(some, lambda j: part(p, j))))
    placed = placed.withColumn("parts", F.filter(all_parts, lambda x: x["turn"] < F.element_at("turns", -1)))
    shard = lambda x: F.aggregate("turns", F.lit(0), lambda n, end: n + (end <= x["turn"]).cast("int"))
    placed = placed.withColumn("picks", F.transform("parts", lambda x: F.struct(shard(x).alias("shard"), x["pass"], x["from"], x["to"])))
    placed = placed.withColumn("extra", F.transform(F.filter("parts", lambda x: x["pass"] == F.col("passes")), lambda x: F.struct(x["from"], x["to"])))
    placed = placed.withColumn("taken", F.aggregate("parts", F.lit(0).cast("long"), lambda n, x: n + x["to"] - x["from"]))
    return placed.drop("source_no", "bucket", "before", "at", "width", "blocks", "step", "shift", "buckets", "turns", "parts", "mix_key")


def materialised(mix: DataFrame, columns: list[str]) -> DataFrame:
    """The mix's documents: passes whole copies of each, and one of the words of extra, joined by a space, if any."""
    own = [F.col("row")[c].alias(c) for c in columns]
    schema, at = mix.select(*own).schema, columns.index("text")

    def work(batches):
        for batch in batches:
            texts, size = batch.column(at).to_pylist(), batch.column(len(columns)).to_pylist()
            rows, new = [], []
            for k, (n, passes, extra) in enumerate(zip(size, *(batch.column(len(columns) + j).to_pylist() for j in (1, 2)))):
                if n:
                    rows += [k] * passes
                    new += [texts[k]] * passes
                if extra:
                    words = texts[k].encode().split()
                    rows.append(k)
                    new.append(b" ".join(w for x in extra for w in words[x["from"] : x["to"]]).decode())
            took = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if j == at else took.column(j) for j in range(len(columns))], columns)
        trimmed()

    out = mix.select(*own, F.col("size").alias("mix_size"), F.col("passes").alias("mix_passes"), F.col("extra").alias("mix_extra")).mapInArrow(work, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in columns else out


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sized(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("row")
    return mixed(written(docs, "sizes")).select("doc_id", "size", "source_size", "target", "taken")

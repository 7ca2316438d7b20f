"""Packing: length buckets with the least padding, found by dynamic programming over the global length histogram."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table

WORD = r"[^\x20\x09-\x0D]+"


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """The upper ends of at most that many buckets that need the fewest padding tokens; lengths ascending and distinct.

    best[j] is the least padding of the first j lengths; a bucket (i, j] pads to lengths[j-1]. Ties: the smallest i.
    """
    d = len(lengths)
    rows = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    tokens = np.concatenate([[0], np.cumsum(lengths * counts)]).astype(np.int64)
    best = np.full(d + 1, np.iinfo(np.int64).max // 4)
    best[0] = 0
    cuts = []
    for _ in range(min(buckets, d)):
        now, cut = best.copy(), np.full(d + 1, -1)
        for j in range(1, d + 1):
            cost = best[:j] + lengths[j - 1] * (rows[j] - rows[:j]) - (tokens[j] - tokens[:j])
            i = int(np.argmin(cost))
            if cost[i] < now[j]:
                now[j], cut[j] = cost[i], i
        best = now
        cuts.append(cut)
    out, j = [], d
    for cut in reversed(cuts):
        if j and cut[j] >= 0:
            out.append(int(lengths[j - 1]))
            j = int(cut[j])
    return out[::-1]


def pack(docs: DataFrame, max_len: int = 4096, buckets: int = 16, token_budget: int = 65536, rows_per_shard: int = 100_000) -> DataFrame:
    """One row per piece of a document: doc_id, piece, start, length, bucket_len, batch, slot, padding.

    A document's tokens are its words and one end token. Documents of more than max_len tokens become pieces of max_len
    tokens and a rest, so nothing is cut off. A batch holds token_budget // bucket_len pieces (one at least) of one
    bucket, all padded to bucket_len; only the last batch of a bucket may be smaller. Pieces are numbered over the whole
    bucket: within shards of about rows_per_shard, dealt by row and piece, by a window, plus the sizes of the shards before, so no task holds a
    bucket, nor the rows of a doc_id that repeats. Texts of any length are whole. Nulls: a null text is empty (one token); a null doc_id stays. Repeated rows are packed each. Order:
    shard, doc_id, piece. An empty table gives no rows. Other columns are dropped.
    """
    if not 0 < max_len <= token_budget:
        raise ValueError("0 < max_len <= token_budget is needed")
    n = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)) + 1
    piece = F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / max_len).cast("int"))).alias("piece")
    pieces = docs.select("doc_id", n.alias("n")).select("doc_id", "n", piece).select("doc_id", "piece", (F.col("piece").cast("long") * max_len).alias("start"), F.least(F.lit(max_len), F.col("n") - F.col("piece") * max_len).alias("length"), F.monotonically_increasing_id().alias("row"))
    pieces = saved(pieces)
    histogram = pieces.groupBy("length").count().orderBy("length").collect()  # max_len rows at most
    if not histogram:
        ends = [max_len]
    else:
        ends = boundaries(np.array([r["length"] for r in histogram]), np.array([r["count"] for r in histogram]), buckets)
    shards = max(1, -(-sum(r["count"] for r in histogram) // rows_per_shard))
    shard = F.pmod(F.xxhash64("doc_id", "row", "piece"), F.lit(shards))
    dealt = pieces.select("*", F.coalesce(*(F.when(F.col("length") <= e, F.lit(e)) for e in ends)).alias("bucket_len"), shard.alias("shard"))
    before = F.sum("count").over(Window.partitionBy("bucket_len").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    offsets = dealt.groupBy("bucket_len", "shard").count().select("bucket_len", "shard", F.coalesce(before, F.lit(0)).alias("before"))
    at = F.row_number().over(Window.partitionBy("bucket_len", "shard").orderBy("doc_id", "piece", "row")) - 1
    ranked = dealt.withColumn("at", at).join(offsets, ["bucket_len", "shard"]).withColumn("rank", F.col("before") + F.col("at"))
    room = F.floor(F.lit(token_budget) / F.col("bucket_len"))
    return ranked.select(
        "doc_id", "piece", "start", "length", "bucket_len",
        F.floor(F.col("rank") / room).alias("batch"), F.pmod("rank", room).alias("slot"), (F.col("bucket_len") - F.col("length")).alias("padding"),
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its bucket, batch and slot."""
    return pack(table(spark, sf_dir, "documents"))

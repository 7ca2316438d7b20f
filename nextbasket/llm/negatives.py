"""Hard-negative mining: for each anchor and positive the best rows of other labels within a window of scores.

1. Quantised vectors go along a Hilbert curve through the dimensions of most variance and are written as Parquet blocks of
   bounded size, a row each. A block has a zone map, the smallest and largest value of each dimension, and so have its zones.
2. Anchors are packed in the same order. Interval arithmetic over a zone map bounds all scores of a block from both sides;
   an anchor reads those blocks that can hold a score in one of its windows, and in them only such zones.
3. A window's lower end rises to the k-th best score found so far. The search for positives begins with the anchor's own block.
4. The positives' scores give the windows of the negatives, which are searched in the same way.

Anchors meet the blocks' maps, and then the blocks that they read, in packs of bounded size; nothing is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table

LEAST, MOST = -(1 << 63), (1 << 63) - 1
BLOCK = "block long, ids array<long>, labels array<int>, data array<long>, lo array<long>, hi array<long>, zone_lo array<long>, zone_hi array<long>, label_lo int, label_hi int"


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """The place of each row of x (numbers below 2**bits, one for each dimension) along the Hilbert curve, by Skilling's transform."""
    x = x.astype(np.int64).T.copy()
    n = len(x)
    for k in range(bits - 1, 0, -1):
        q, p = 1 << k, (1 << k) - 1
        for i in range(n):
            turned = (x[i] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(turned, p, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    last = np.zeros_like(x[0])
    for k in range(bits - 1, 0, -1):
        last ^= np.where(x[n - 1] & (1 << k), (1 << k) - 1, 0)
    x ^= last
    out = np.zeros_like(last)
    for k in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | (x[i] >> k & 1)
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of whole numbers: by float64 where that is exact, else by 64-bit numbers."""
    most = max(1, a.shape[1]) * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    return a.astype(np.float64) @ b.T.astype(np.float64) if most < 2.0**53 else a @ b.T


def interval(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[anchor, map]: the smallest and the largest inner product with any vector between lo and hi."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    return product(up, lo) + product(down, hi), product(up, hi) + product(down, lo)


def lists(columns: list[list[np.ndarray]], batch: list[str]) -> pa.RecordBatch:
    """A row for each element; every column a list of arrays."""
    of = lambda parts: pa.ListArray.from_arrays(np.append(0, np.cumsum([len(p) for p in parts])).astype(np.int32), pa.array(np.concatenate(parts)))
    return pa.RecordBatch.from_arrays([of(c) for c in columns], batch)


def column(b: pa.RecordBatch, name: str, row: int) -> np.ndarray:
    return b[name][row].values.to_numpy(zero_copy_only=False)


@dataclass
class Miner:
    """The settings. Anchors: rows whose id is divisible by `every`. positives: the best of the same label. negatives: the best of other labels from low to high percent of the positive's score.

    block, zone, pack: rows of a block, of a zone and of a pack of anchors; dimensions, bits: of the curve. These change no result.
    """

    every: int = 100
    scale: int = 256
    positives: int = 5
    negatives: int = 5
    low: int = 80
    high: int = 100
    block: int = 1024
    zone: int = 128
    pack: int = 512
    dimensions: int = 8
    bits: int = 7

    def points(self, vectors: DataFrame) -> DataFrame:
        """id, label, q: whole numbers, of the rows that take part."""
        finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(finite).select("id", F.col("label").cast("int").alias("label"), F.transform("embedding", lambda x: F.floor(self.scale * x.cast("double"))).alias("q"))

    def blocks(self, points: DataFrame) -> tuple[DataFrame, int]:
        """The blocks along the curve, written; and the number of dimensions. Shorter vectors end in zeros."""
        each = points.select(F.posexplode("q").alias("at", "x")).groupBy("at").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.var_pop("x").alias("spread")).orderBy("at").collect()  # a row for each dimension
        d, size, zone, bits = len(each), self.block, self.zone, self.bits
        axes = sorted(sorted(range(d), key=lambda k: -each[k]["spread"])[: self.dimensions])
        low = np.array([each[k]["lo"] for k in axes], float)
        width = np.maximum(np.array([each[k]["hi"] for k in axes], float) - low, 1)

        def matrix(b: pa.RecordBatch) -> np.ndarray:
            n = np.diff(b["q"].offsets.to_numpy())
            out = np.zeros((b.num_rows, d), np.int64)
            out[np.arange(d)[None] < n[:, None]] = b["q"].flatten().to_numpy()
            return out

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = matrix(b)[:, axes]
                at = hilbert(np.minimum((x - low) / width * (1 << bits), (1 << bits) - 1), bits) if axes else np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays([*(b[c] for c in ("id", "label", "q")), pa.array(at)], ["id", "label", "q", "at"])

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            k = TaskContext.get().partitionId() << 32
            for b in regrouped(batches, size):
                x, labels = matrix(b), b["label"].to_numpy()
                starts = np.arange(0, len(x), zone)
                zones = [f.reduceat(x, starts, axis=0) if d else x[:0] for f in (np.minimum, np.maximum)]
                ids = b["id"].fill_null(MOST).to_numpy()  # no id comes last
                whole = lists([[y] for y in (ids, labels, x.ravel(), x.min(0), x.max(0), zones[0].ravel(), zones[1].ravel())], ["ids", "labels", "data", "lo", "hi", "zone_lo", "zone_hi"])
                yield pa.RecordBatch.from_arrays([pa.array([k]), *whole.columns, pa.array([labels.min()]), pa.array([labels.max()])], ["block", *whole.schema.names, "label_lo", "label_hi"])
                k += 1

        order = ["at", "id", "label", "q"]
        return saved(points.mapInArrow(placed, "id long, label int, q array<long>, at long").repartitionByRange(*order[:2]).sortWithinPartitions(*order).select("id", "label", "q").mapInArrow(packed, BLOCK)), d

    def anchors(self, blocks: DataFrame, d: int) -> DataFrame:
        """row (block and place), id, label, q, lo: the score of the last positive if the anchor's own block were all."""
        every, k = self.every, self.positives

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in range(b.num_rows):
                    ids, labels = column(b, "ids", r), column(b, "labels", r)
                    own = np.flatnonzero((ids % every == 0) & (ids != MOST))
                    x = column(b, "data", r).reshape(len(ids), d)
                    score = product(x[own], x).astype(np.int64)
                    lo = np.full(len(own), LEAST)
                    for i, o in enumerate(own.tolist()):
                        same = labels == labels[o]
                        same[o] = False
                        s = score[i, same]
                        if len(s) >= k:
                            lo[i] = np.partition(s, len(s) - k)[len(s) - k]
                    q = pa.ListArray.from_arrays((np.arange(len(own) + 1) * d).astype(np.int32), pa.array(x[own].ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(row_of(b["block"][r].as_py(), own)), pa.array(ids[own]), pa.array(labels[own]), q, pa.array(lo)], ["row", "id", "label", "q", "lo"])

        return saved(blocks.select("block", "ids", "labels", "data").mapInArrow(run, "row long, id long, label int, q array<long>, lo long"))

    def packs(self, anchors: DataFrame) -> DataFrame:
        """Packs of anchors(row, id, label, q, windows) along the curve; window k of a pack is anchor at[k]'s, for key[k], from from_[k] to to[k]."""
        size = self.pack

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            k = TaskContext.get().partitionId() << 32
            for b in regrouped(batches, size):
                w = b["windows"]
                n, flat = np.diff(w.offsets.to_numpy()), w.flatten()
                parts = [b["row"].to_numpy(), b["id"].to_numpy(), b["label"].to_numpy(), b["q"].flatten().to_numpy(), np.repeat(np.arange(len(n), dtype=np.int32), n), *(flat.field(i).to_numpy() for i in range(3))]
                whole = lists([[p] for p in parts], ["rows", "a_ids", "a_labels", "a_data", "at", "key", "from_", "to"])
                yield pa.RecordBatch.from_arrays([pa.array([k]), *whole.columns], ["pack", *whole.schema.names])
                k += 1

        schema = "pack long, rows array<long>, a_ids array<long>, a_labels array<int>, a_data array<long>, at array<int>, key array<long>, from_ array<long>, to array<long>"
        return saved(anchors.select("row", "id", "label", "q", "windows").repartitionByRange("row").sortWithinPartitions("row").mapInArrow(run, schema))

    def wanted(self, packs: DataFrame, blocks: DataFrame, d: int, same: bool, group: int = 256) -> DataFrame:
        """pack, block: the blocks that a pack has to read, by the bounds of all its anchors' windows."""

        def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in regrouped(batches, group):
                yield lists([[b[c].flatten().to_numpy() if c in ("lo", "hi") else b[c].to_numpy()] for c in names], names)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in range(b.num_rows):
                    block, first, last = (column(b, c, r) for c in ("block", "label_lo", "label_hi"))
                    maps = [column(b, c, r).reshape(len(block), d) for c in ("lo", "hi")]
                    labels, at, lo, hi = (column(b, c, r) for c in ("a_labels", "at", "from_", "to"))
                    least, most = interval(column(b, "a_data", r).reshape(len(labels), d), *maps)
                    use = np.zeros(len(block), bool)
                    a = labels[at][:, None]
                    for k in range(0, len(block), 64):
                        s = slice(k, k + 64)
                        fits = ((first[s] <= a) & (a <= last[s])) if same else ((first[s] != a) | (last[s] != a))
                        use[s] = (fits & (most[at, s] >= lo[:, None]) & (least[at, s] <= hi[:, None])).any(0)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(use.sum(), b["pack"][r].as_py())), pa.array(block[use])], ["pack", "block"])

        names = ["block", "label_lo", "label_hi", "lo", "hi"]
        groups = saved(blocks.select(*names).mapInArrow(grouped, "block array<long>, label_lo array<int>, label_hi array<int>, lo array<long>, hi array<long>"))
        parts = max(1, groups.count() // 4)
        x = packs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        y = groups.withColumn("part", F.pmod(F.xxhash64(F.get("block", F.lit(0))), F.lit(parts)).cast("int"))
        return saved(x.join(y, "part").select("pack", "a_labels", "a_data", "at", "from_", "to", *names).mapInArrow(run, "pack long, block long"))

    def search(self, anchors: DataFrame, blocks: DataFrame, d: int, same: bool, k: int) -> DataFrame:
        """row, anchor_id, key, rank, id, other (its row), score: the first k of each window, of the anchor's label or of others."""
        zone = self.zone
        packs = self.packs(anchors)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in range(b.num_rows):
                    rows, ids, labels, at, key, lo, hi = (column(b, c, r) for c in ("rows", "a_ids", "a_labels", "at", "key", "from_", "to"))
                    other, other_labels = column(b, "ids", r), column(b, "labels", r)
                    place = row_of(b["block"][r].as_py(), np.arange(len(other)))
                    a, x = column(b, "a_data", r).reshape(len(rows), d), column(b, "data", r).reshape(len(other), d)
                    found = within(a, rows, labels, (at, lo, hi), x, place, other, other_labels, interval(a, *(column(b, c, r).reshape(-1, d) if d else np.zeros((-(-len(other) // zone), 0), np.int64) for c in ("zone_lo", "zone_hi"))), zone, same, k)
                    w, score, n = found
                    yield pa.RecordBatch.from_arrays([pa.array(y) for y in (rows[at[w]], ids[at[w]], key[w], other[n], place[n], score)], ["row", "anchor_id", "key", "id", "other", "score"])

        tasks = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        pairs = self.wanted(packs, blocks, d, same).repartition(tasks, "block")
        hits = pairs.join(blocks.select("block", "ids", "labels", "data", "zone_lo", "zone_hi"), "block").join(packs, "pack").mapInArrow(run, "row long, anchor_id long, key long, id long, other long, score long")
        rank = F.row_number().over(Window.partitionBy("row", "key").orderBy(F.desc("score"), "id", "other"))
        return hits.withColumn("rank", rank).where(F.col("rank") <= k)

    def run(self, vectors: DataFrame) -> DataFrame:
        blocks, d = self.blocks(self.points(vectors))
        anchors = self.anchors(blocks, d)
        window = lambda key, lo, hi: F.struct(key.alias("key"), lo.alias("lo"), hi.alias("hi"))
        long = lambda x: F.lit(x).cast("long")
        best = saved(self.search(anchors.withColumn("windows", F.array(window(long(-1), F.col("lo"), long(MOST)))), blocks, d, True, self.positives))
        # whole numbers from low to high percent of the score
        score = F.col("score")
        lo, hi = F.expr(f"(score * {self.low}L) div 100L"), F.expr(f"(score * {self.high}L) div 100L")  # towards zero
        lo = lo + F.when((score > 0) & (lo * 100 < score * self.low), 1).otherwise(0)
        hi = hi - F.when((score < 0) & (hi * 100 > score * self.high), 1).otherwise(0)
        windows = best.withColumns({"from_": lo, "to": hi}).where("from_ <= to").groupBy("row").agg(F.collect_list(window(F.col("other"), F.col("from_"), F.col("to"))).alias("windows"))  # `positives` at most
        found = self.search(anchors.join(windows, "row"), blocks, d, False, self.negatives)
        positive = best.select("row", F.col("other").alias("key"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        known = lambda c: F.when(F.col(c) != MOST, F.col(c)).alias(c)
        return found.withColumnRenamed("id", "negative_id").join(positive, ["row", "key"]).select("anchor_id", known("positive_id"), F.col("rank").cast("int").alias("rank"), known("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def row_of(block: int, place: np.ndarray) -> np.ndarray:
    """A number of its own for each row: blocks have at most 2**12 rows, and a partition fewer than 2**20 blocks."""
    return ((np.int64(block >> 32) << 20 | np.int64(block & 0xFFFFFFFF)) << 12) | place.astype(np.int64)


def regrouped(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of size, the last one shorter."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        while b.num_rows:
            part = b.slice(0, size - n)
            held.append(part)
            n += part.num_rows
            b = b.slice(part.num_rows)
            if n == size:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def within(a: np.ndarray, rows: np.ndarray, labels: np.ndarray, windows: tuple[np.ndarray, ...], x: np.ndarray, place: np.ndarray, ids: np.ndarray, other: np.ndarray, bounds: tuple[np.ndarray, np.ndarray], zone: int, same: bool, k: int) -> tuple[np.ndarray, ...]:
    """window, score, place in x: the first k rows of x in each window (anchor, from, to), by score and then id. Zones whose bounds (of anchors by zones) miss a window are not compared for it."""
    at, lo, hi = windows[0], windows[1].copy(), windows[2]
    best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
    for z in np.argsort(-bounds[1].max(0, initial=LEAST), kind="stable").tolist():
        use = np.flatnonzero((bounds[1][at, z] >= lo) & (bounds[0][at, z] <= hi))
        if not len(use):
            continue
        own, back = np.unique(at[use], return_inverse=True)
        first = z * zone
        score = product(a[own], x[first : first + zone]).astype(np.int64)[back]
        mine = rows[at[use]][:, None] == place[first : first + zone]
        alike = labels[at[use]][:, None] == other[first : first + zone]
        w, n = np.nonzero((score >= lo[use][:, None]) & (score <= hi[use][:, None]) & (alike == same) & ~mine)
        if not len(w):
            continue
        w, s, n = (np.concatenate(p) for p in zip(best, (use[w], score[w, n], n + first), strict=True))
        order = np.lexsort((place[n], ids[n], -s, w))
        w, s, n = w[order], s[order], n[order]
        nth = np.arange(len(w)) - np.searchsorted(w, w)
        kept = nth < k
        last = nth == k - 1
        lo[w[last]] = np.maximum(lo[w[last]], s[last])
        best = (w[kept], s[kept], n[kept])
    return best


def mine(vectors: DataFrame, **settings: int) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of vectors(id, label, embedding, ...); see Miner for the settings.

    Rows with a null label, a null vector or any null or non-finite component take no part. A null id is no anchor and comes last among ties, which go to the smaller id.
    Rows that repeat an id are rows of their own, and so are equal vectors: each can be another's positive. Vectors that are shorter than the longest end in zeros.
    Scores are 64-bit whole numbers. Anchors without positives, and positives without negatives in their window, give no rows; neither does an empty table. Other columns are dropped.
    """
    return Miner(**settings).run(vectors)


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every anchor, positive and negative of the embeddings, whose labels are first shifted where the id is divisible by 7."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), label.alias("label"), "embedding"))


#: The same in SQL, by all pairs of an anchor and a row.
OP12_SQL = """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as q from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
scores as (select a.vec_id as anchor_id, a.label = b.label as same, b.vec_id, list_inner_product(a.q, b.q)::bigint as score from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
positives as (select anchor_id, vec_id as positive_id, score as positive_score from scores where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
negatives as (select anchor_id, positive_id, vec_id as negative_id, positive_score, score as negative_score, row_number() over (partition by anchor_id, positive_id order by score desc, vec_id)::int as rank
  from positives join scores using (anchor_id) where not same and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from negatives where rank <= 5
"""

"""Listwise gradient-boosted trees: lambda gradients of NDCG within groups, histograms by Spark, splits on the driver.

A group (a customer in a label week) is one row that holds its candidates' labels and binned features; candidate lists bound
its size. For each level of a tree one job makes the groups' gradients and sums them by (node, feature, bin): a table of fixed
size from each task, which Spark adds up. The driver sees these sums alone. Sums are whole numbers, so a model does not depend on how the rows are dealt.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Gradients are summed as multiples of this.
UNIT = 2.0**-30


@dataclass
class Tree:
    """A complete tree: node i has the children 2 i + 1 (value <= threshold) and 2 i + 2. A node without a split has feature -1 and sends all to the left."""

    feature: np.ndarray
    threshold: np.ndarray
    gain: np.ndarray
    value: np.ndarray  # of the leaves

    def leaf(self, x: np.ndarray, depth: int) -> np.ndarray:
        """The place of each row of x in the level `depth`. Values that are no number go to the left."""
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(depth):
            at = 2 * at + 1 + (x[rows, self.feature[at]] > self.threshold[at])
        return at - (1 << depth) + 1


@dataclass
class Forest:
    columns: tuple[str, ...]
    depth: int
    trees: list[Tree] = field(default_factory=list)

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for t in self.trees:
            out += t.value[t.leaf(x, self.depth)]
        return out

    def gains(self) -> dict[str, float]:
        """The share of each column in the gain of all splits."""
        total = np.zeros(len(self.columns))
        for t in self.trees:
            np.add.at(total, t.feature[t.feature >= 0], t.gain[t.feature >= 0])
        return dict(zip(self.columns, (total / max(total.sum(), 1e-300)).tolist(), strict=True))


@dataclass(frozen=True)
class Settings:
    """columns_share and rows_share: of the columns for each tree, and of the groups for each five trees. keep: trees after which scores are written."""

    trees: int = 20
    depth: int = 5
    rate: float = 0.05
    bins: int = 64
    least_rows: int = 50
    least_gain: float = 0.0
    l2: float = 0.2
    columns_share: float = 0.8
    rows_share: float = 0.8
    keep: int = 10
    seed: int = 42


def lambdas(score: np.ndarray, label: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of each row, where groups begin at start (its last element is the number of rows).

    Of each two rows of a group with different labels: the chance that they are misplaced times the change in NDCG that swapping them would make. Ties in score keep their order.
    """
    n, size = len(score), np.diff(start)
    group = np.repeat(np.arange(len(size)), size)
    rows = np.arange(n)
    gain = 2.0**label - 1
    order = np.lexsort((rows, -score, group))
    rank = np.empty(n, np.int64)
    rank[order] = rows - start[group]
    discount = 1 / np.log2(rank + 2)
    ideal = np.bincount(group, gain[np.lexsort((-gain, group))] / np.log2(rows - start[group] + 2), len(size))
    high = np.flatnonzero(label > 0)
    count = size[group[high]]
    a = np.repeat(high, count)
    b = np.repeat(start[group[high]], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    lower = label[b] < label[a]
    a, b = a[lower], b[lower]
    wrong = 1 / (1 + np.exp(np.clip(score[a] - score[b], -500, 500)))
    weight = np.abs(discount[a] - discount[b]) * (gain[a] - gain[b]) / ideal[group[a]]
    first, second = weight * wrong, weight * wrong * (1 - wrong)
    return np.bincount(a, first, n) - np.bincount(b, first, n), np.bincount(a, second, n) + np.bincount(b, second, n)


def cut_points(frame: DataFrame, columns: Sequence[str], bins: int) -> list[np.ndarray]:
    """Up to bins - 1 values of each column between which its bins lie: quantiles from Spark's sketch, one pass."""
    shares = F.array(*(F.lit(k / bins) for k in range(1, bins)))
    row = frame.agg(*(F.percentile_approx(F.col(c).cast("double"), shares, 10000).alias(f"c{k}") for k, c in enumerate(columns))).first()
    return [np.unique(np.array(x or [], float)) for x in row]


def grouped(frame: DataFrame, columns: Sequence[str], keys: Sequence[str], cuts: list[np.ndarray], order: str) -> DataFrame:
    """group (a hash of the keys), labels, bins (one byte for each row and column), scores: groups that have rows of several labels, as the others have no gradient."""
    x = F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in columns))
    several = frame.groupBy(*keys).agg(F.min(F.col("label").cast("int")).alias("lo"), F.max(F.col("label").cast("int")).alias("hi")).where("lo < hi").select(*(F.col(k).alias(f"_{k}") for k in keys))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    rows = frame.join(several, same, "left_semi").select(F.xxhash64(*keys).alias("group"), *keys, F.struct(F.col(order).alias("o"), F.col("label").cast("int").alias("label"), x.alias("x")).alias("row"))
    each = rows.groupBy("group", *keys).agg(F.sort_array(F.collect_list("row")).alias("rows"))  # a candidate list

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = b["rows"]
            n, flat = np.diff(r.offsets.to_numpy()), r.flatten()
            x = flat.field("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(columns))
            binned = np.stack([np.where(np.isnan(x[:, k]), 0, np.searchsorted(c, x[:, k])) for k, c in enumerate(cuts)], 1).astype(np.uint8)
            ends = np.cumsum(n)
            raw = [binned[e - k : e].tobytes() for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
            offsets = pa.array(np.append(0, ends).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b["group"], pa.ListArray.from_arrays(offsets, flat.field("label")), pa.array(raw, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(np.zeros(len(flat))))], ["group", "labels", "bins", "scores"])

    return each.select("group", "rows").mapInArrow(run, "group long, labels array<int>, bins binary, scores array<double>")


def chosen(group: np.ndarray, tree: int, s: Settings) -> np.ndarray:
    """The groups that a tree is fitted on: another hash of them for each five trees."""
    x = group.astype(np.uint64) ^ np.uint64((s.seed * 1_000_003 + tree // 5 + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x >> np.uint64(40)) % np.uint64(1000)) < np.uint64(round(1000 * s.rows_share))


def batch(b: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """labels, bins by row and column, scores, and where groups begin."""
    labels = b["labels"].flatten().to_numpy().astype(np.int64)
    x = np.frombuffer(b"".join(b["bins"].to_pylist()), np.uint8).reshape(-1, width)
    return labels, x, b["scores"].flatten().to_numpy(), np.append(0, np.cumsum(np.diff(b["labels"].offsets.to_numpy())))


def sums(groups: DataFrame, since: Forest, growing: Tree, level: int, columns: np.ndarray, tree: int, s: Settings) -> np.ndarray:
    """[node of the level, column, bin, (first, second, rows)]: one table from each task, added up. since: trees that are not yet in the scores."""
    width = len(since.columns)
    shape = (1 << level, len(columns), s.bins)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, shape[0] * shape[1] * shape[2]), np.int64)
        for b in batches:
            labels, x, scores, start = batch(b, width)
            first, second = lambdas(scores + since.predict(x), labels, start)
            use = np.repeat(chosen(b["group"].to_numpy(), tree, s), np.diff(start))
            x, values = x[use], [np.rint(v[use] / UNIT) for v in (first, second)]
            at = ((growing.leaf(x, level)[:, None] * shape[1] + np.arange(shape[1])) * shape[2] + x[:, columns]).ravel()
            for k, v in enumerate(values):
                total[k] += np.rint(np.bincount(at, np.repeat(v, shape[1]), total.shape[1])).astype(np.int64)
            total[2] += np.bincount(at, minlength=total.shape[1])
        some = np.flatnonzero(total[2])
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(t[some]) for t in total)], ["at", "first", "second", "n"])

    got = groups.mapInArrow(run, "at long, first long, second long, n long").groupBy("at").agg(F.sum("first").alias("first"), F.sum("second").alias("second"), F.sum("n").alias("n")).toArrow()  # nodes * columns * bins rows at most
    out = np.zeros((3, shape[0] * shape[1] * shape[2]))
    for k, c in enumerate(("first", "second", "n")):
        out[k, got["at"].to_numpy()] = got[c].to_numpy() * (UNIT if k < 2 else 1)
    return np.moveaxis(out.reshape(3, *shape), 0, -1)


def splits(table: np.ndarray, s: Settings) -> list[tuple[int, int, float, float, float] | None]:
    """For each node its best (place among the columns, bin, gain, value of the left side, value of the right side); None where no split is allowed."""
    left = table.cumsum(2)[:, :, :-1]
    whole = table.sum(2, keepdims=True)
    right = whole - left
    worth = lambda t: t[..., 0] ** 2 / (t[..., 1] + s.l2)
    gain = worth(left) + worth(right) - worth(whole)
    gain[(left[..., 2] < s.least_rows) | (right[..., 2] < s.least_rows)] = -np.inf
    out: list[tuple[int, int, float, float, float] | None] = []
    for node in range(len(table)):
        k, b = np.unravel_index(np.argmax(gain[node]), gain[node].shape)
        best = float(gain[node, k, b])
        value = lambda t: float(s.rate * t[0] / (t[1] + s.l2))
        out.append((int(k), int(b), best, value(left[node, k, b]), value(right[node, k, b])) if best > s.least_gain else None)
    return out


def fit(frame: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("label_week", "customer_id"), order: str = "article_id", settings: Settings | None = None) -> Forest:
    """Trees for frame(keys, order, label, columns). Rows of a group are told apart by `order`, which settles ties.

    Null and NaN values count as the smallest. Groups whose rows all have one label have no gradient. An empty frame gives a forest whose trees say 0.
    """
    s = settings or Settings()
    frame = frame.select(*dict.fromkeys([*keys, order, "label", *columns]))
    cuts = cut_points(frame, columns, s.bins)
    groups = written(grouped(frame, columns, keys, cuts, order))
    binned, model = Forest(tuple(columns), s.depth), Forest(tuple(columns), s.depth)
    draws = np.random.default_rng(s.seed)
    nodes = (1 << s.depth) - 1
    for t in range(s.trees):
        if t and t % s.keep == 0:
            groups, binned = written(moved(groups, binned)), Forest(tuple(columns), s.depth)
        use = np.sort(draws.permutation(len(columns))[: max(1, round(s.columns_share * len(columns)))])
        tree = Tree(np.full(nodes, -1), np.full(nodes, np.inf), np.zeros(nodes), np.zeros(1 << s.depth))
        for level in range(s.depth):
            found = splits(sums(groups, binned, tree, level, use, t, s), s)
            for k, best in enumerate(found):
                if best:
                    node, below = (1 << level) - 1 + k, s.depth - level - 1
                    tree.feature[node], tree.threshold[node], tree.gain[node] = use[best[0]], best[1], best[2]
                    tree.value[2 * k << below] = best[3]  # the leftmost leaf of each side, until it is split again
                    tree.value[2 * k + 1 << below] = best[4]
            if not any(found):
                break
        binned.trees.append(tree)
        real = [cuts[f][int(b)] if f >= 0 and b < len(cuts[f]) else np.inf for f, b in zip(tree.feature, tree.threshold, strict=True)]
        model.trees.append(Tree(tree.feature, np.array(real), tree.gain, tree.value))
    return model


def moved(groups: DataFrame, since: Forest) -> DataFrame:
    """groups with the trees' values in their scores."""
    width = len(since.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, x, scores, start = batch(b, width)
            now = pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), pa.array(scores + since.predict(x)))
            yield pa.RecordBatch.from_arrays([b["group"], b["labels"], b["bins"], now], b.schema.names)

    return groups.mapInArrow(run, groups.schema)


def score(model: Forest, frame: DataFrame) -> DataFrame:
    """frame with score, rounded to 9 digits."""
    columns = model.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b[f"_x{k}"].to_numpy(zero_copy_only=False).astype(float) for k in range(len(columns))], 1)
            yield b.select(names).append_column("score", pa.array(np.round(model.predict(x), 9)))

    names = frame.columns
    wide = frame.select("*", *(F.col(c).cast("double").alias(f"_x{k}") for k, c in enumerate(columns)))
    return wide.mapInArrow(run, frame.select("*", F.lit(0.0).alias("score")).schema)


def save(model: Forest, spark: SparkSession, path: str) -> None:
    """A row for each node and leaf."""
    rows = [(t, k, int(x.feature[k]), float(x.threshold[k]), float(x.gain[k]), None) for t, x in enumerate(model.trees) for k in range(len(x.feature))]
    rows += [(t, len(x.feature) + k, None, None, None, float(v)) for t, x in enumerate(model.trees) for k, v in enumerate(x.value)]
    rows += [(-1, k, model.depth, None, None, None) for k in range(len(model.columns))]
    named = [(*r, model.columns[r[1]] if r[0] < 0 else None) for r in rows]
    spark.createDataFrame(named, "tree int, node int, feature int, threshold double, gain double, value double, name string").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Forest:
    rows = spark.read.parquet(path).orderBy("tree", "node").collect()  # a model's nodes
    model = Forest(tuple(r["name"] for r in rows if r["tree"] < 0), next(r["feature"] for r in rows if r["tree"] < 0))
    nodes = (1 << model.depth) - 1
    own = [r for r in rows if r["tree"] >= 0]
    for k in range(0, len(own), 2 * nodes + 1):
        inner, leaves = own[k : k + nodes], own[k + nodes : k + 2 * nodes + 1]
        model.trees.append(Tree(*(np.array([r[c] for r in inner]) for c in ("feature", "threshold", "gain")), np.array([r["value"] for r in leaves])))
    return model
